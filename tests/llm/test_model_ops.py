"""Operators 1, 5, 6, 7 and 10 and the pipeline against brute force or held-out accuracy on small inputs."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from copyhound.llm import op1_jaccard_join, op5_language, op6_suffix_tree, op7_itq_neardup, op10_line_crf
from copyhound.llm.components import components

WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "pu", "ra") for b in ("ba", "de", "fi", "go", "hu", "ji", "kel", "mos")]


def union_find(pairs):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return root


# --- components -------------------------------------------------------------------
def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(300)] + [(1000 + k, 1001 + k) for k in range(60)] + [(2000, 2000 + k) for k in range(1, 50)]
    root = union_find(pairs)
    got = components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {r.v: r.label for r in got} == {v: root(v) for p in pairs for v in p if p[0] != p[1]}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- op1 ----------------------------------------------------------------------------
def near_copies(rng: random.Random, n: int) -> list[str]:
    """Groups of texts at all distances around the threshold, short texts, and a passage that many share."""
    out = []
    passage = " ".join(rng.choice(WORDS) for _ in range(30))
    for _ in range(n):
        base = [rng.choice(WORDS) + str(rng.randint(0, 50)) for _ in range(rng.choice((1, 3, 5, 12, 40, 80)))]
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 1 + len(copy) // 25)):
                copy[rng.randrange(len(copy))] = "edit" + str(rng.randint(0, 9))
            out.append(" ".join(copy) if rng.random() < 0.8 else "  " + "\n".join(copy).upper())
        if rng.random() < 0.3:
            out.append(passage + " " + " ".join(rng.choice(WORDS) + str(rng.randint(0, 999)) for _ in range(rng.randint(0, 8))))
    return out


def shingle_set(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[j:j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute_groups(rows, k, percent):
    sets = [shingle_set(t, k) for _, t in rows]
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    root = union_find(pairs)
    least = {}
    for k_, (d, _) in enumerate(rows):
        least[root(k_)] = min([x for x in (least.get(root(k_)), d) if x is not None], default=None)
    return Counter((d, len(sets[j]), least[root(j)] if sets[j] else d) for j, (d, _) in enumerate(rows))


@pytest.mark.parametrize("k, percent", [(4, 85), (5, 80)])
def test_jaccard_groups(spark, k, percent):
    texts = near_copies(random.Random(k), 50) + [None, "", " \n\t", "one", "ONE", "one", "two words", "Two  Words", "x " * 3000]
    order = list(range(len(texts)))
    random.Random(1).shuffle(order)
    rows = list(zip(order, texts)) + [(None, "lone text of a null id"), (0, "a different text with an id that is there"), (None, texts[0])]
    df = spark.createDataFrame([(d, t, 1, "clash") for d, t in rows], "doc_id long, text string, n long, sig string")
    got = op1_jaccard_join.jaccard_groups(df, k, percent).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_groups(rows, k, percent)


def test_one_large_group_of_near_copies(spark):
    """All within twice the radius of a centre; the pivots of several rounds connect them, without all their pairs."""
    rng = random.Random(9)
    base = [f"w{j}" for j in range(120)]
    rows = []
    for d in range(400):
        copy = list(base)
        for j in rng.sample(range(120), rng.randint(0, 3)):
            copy[j] = f"e{rng.randint(0, 10 ** 6)}"
        rows.append((d, " ".join(copy)))
    got = op1_jaccard_join.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_groups(rows, 4, 85)


def test_no_documents_or_words(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert op1_jaccard_join.jaccard_groups(none).count() == 0
    blank = spark.createDataFrame([(1, None), (2, " ")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in op1_jaccard_join.jaccard_groups(blank).collect()) == [(1, 0, 1), (2, 0, 2)]


# --- op5 ----------------------------------------------------------------------------
LANGUAGES = {"aa": "the of and shing thorn with", "bb": "der und schön über nicht eine", "cc": "что это было когда они"}


def sentences(rng, n):
    return [(lang, " ".join(rng.choice(words.split()) for _ in range(rng.randint(3, 30)))) for lang, words in LANGUAGES.items() for _ in range(n)]


def test_language(spark):
    rng = random.Random(4)
    train = spark.createDataFrame([(t, lang) for lang, t in sentences(rng, 60)] + [(None, "aa"), ("no label", None)], "text string, lang string")
    model = op5_language.train(train)
    assert model.languages == ["aa", "bb", "cc"]
    test = sentences(rng, 40)
    odd = [None, "", "123 !? \n", "日本"]
    df = spark.createDataFrame([(k, t, lang, 0.5) for k, (lang, t) in enumerate(test + [("zz", t) for t in odd])], "doc_id long, text string, lang string, score double")
    got = {r.doc_id: r for r in op5_language.predict(df, model).collect()}
    assert all(got[k].lang_pred == lang and 0 <= got[k].score <= 1 for k, (lang, _) in enumerate(test))
    assert [got[len(test) + k].lang_pred for k in range(3)] == ["und"] * 3 and got[len(test) + 3].lang_pred != "und"
    none = op5_language.train(train.where("false"))
    assert {r.lang_pred for r in op5_language.predict(df, none).collect()} == {"und"}
    assert op5_language.predict(df.where("false"), model).count() == 0


def test_language_counts_are_those_of_a_plain_loop(spark):
    model = op5_language.train(spark.createDataFrame([("Ab c", "x"), ("b-a b", "x"), ("zz", "y")], "text string, lang string"))
    bits = op5_language.BUCKET_BITS
    assert model.log_prob.shape == (len(op5_language.ORDERS) << bits, 2)
    for order, grams in ((1, "ab c b a b".replace(" ", "")), (2, ["ab", "b.", ".c", "b.", ".a", "a.", ".b"]), (3, [".a.", ".c", "ab."])):
        prob = np.exp(model.log_prob[:, 0].astype(float))[order - 1 << bits:order << bits]
        assert math.isclose(prob.sum(), 1, rel_tol=1e-4)
        if order < 3:  # counts + 0.5, of all grams of the order
            least = prob.min()
            want = sorted(Counter(grams).values())
            assert sorted(np.round(prob[prob > 1.5 * least] / least / 2 - 0.5).astype(int).tolist()) == want


# --- op6 ----------------------------------------------------------------------------
def corpus(rng, n):
    out = []
    for _ in range(n):
        w = []
        while len(w) < rng.randint(5, 60):
            w += ["new", "york", "city"] if rng.random() < 0.3 else [rng.choice(WORDS)] * rng.randint(1, 2)
        out.append(" ".join(w))
    return out


def test_suffix_tree(spark):
    rng = random.Random(8)
    rows = list(enumerate(corpus(rng, 400) + ["", "Unseen WORDS only here", "New YORK", " "])) + [(None, None), (3, "york")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    training = docs.where("doc_id < 300")
    tree, counts = op6_suffix_tree.train(training, p_word=1e-4, p_context=1e-3, p_pair=1e-4)
    tokens = lambda t: (t or "").encode().lower().split() + [None]
    c = Counter(x for d, t in rows if d is not None and d < 300 for x in tokens(t))
    total = sum(c.values())
    assert (tree.total, tree.distinct) == (total, len(c))
    assert tree.retained.sum() > 3, "new -> york -> city must be states"
    p = lambda x: (c[x] + 0.5) / (total + 0.5 * (len(c) + 1))
    got = Counter()
    sums = Counter()
    for r in op6_suffix_tree.score(docs, tree, counts).collect():
        got[r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)] += 1
        sums["base"] += r.base_score
        sums["score"] += r.score
    want = Counter((d, len(tokens(t)), sum(c[x] > 0 for x in tokens(t)), round(sum(math.log10(p(x)) for x in tokens(t)), 6)) for d, t in rows)
    assert got == want
    assert sums["score"] > sums["base"]


def test_suffix_tree_distributions_sum_to_one(spark):
    docs = spark.createDataFrame(list(enumerate(corpus(random.Random(1), 300))), "doc_id long, text string")
    tree, _ = op6_suffix_tree.train(docs, p_word=1e-6, p_context=1e-3, p_pair=1e-4)
    words = np.arange(tree.words.count)
    unseen = 0.5 / tree.mass  # one class for all words that training doesn't have
    assert math.isclose((10 ** tree.log_base).sum() + unseen, 1, rel_tol=1e-9)
    for node in np.flatnonzero(tree.retained):
        rest = 10 ** tree.log_prob(np.array([node]), np.array([-1]))[0] * unseen
        assert math.isclose((10 ** tree.log_prob(np.full(len(words), node), words)).sum() + rest, 1, rel_tol=1e-6)


def test_suffix_tree_keeps_rare_contexts_and_equals_brute_force(spark):
    """A context seen twice counts among any number of other words, and scores are those of plain dictionaries."""
    rng = random.Random(4)
    texts = corpus(rng, 300) + ["zig zag zug"] * 2 + [f"{a} very much so then {a}" for a in WORDS[:6] for _ in range(40)] + [" ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(40)) for _ in range(200)]
    held = ["zig zag zug", "new zag zug york city", texts[7] + " zig unseen zag zug", ""]
    docs = spark.createDataFrame(list(enumerate(texts + held)), "doc_id long, text string")
    tokens = lambda t: t.lower().split() + [None]
    n = Counter(tuple(x[i - d:i + 1]) for t in texts for x in [tokens(t)] for i in range(len(x)) for d in range(min(5, i + 1)))
    total, distinct = sum(c for g, c in n.items() if len(g) == 1), sum(len(g) == 1 for g in n)
    back, delta = {}, {}
    p0 = lambda w: (n[w,] + 0.5) / (total + 0.5 * (distinct + 1))

    def p(s, w):
        if not s:
            return p0(w)
        if s not in back:
            return p(s[1:], w)
        return max(n[*s, w] - 0.75, 0) * (n[*s, w] >= 2) / n[s] + back[s] * p(s[1:], w)

    for d in (1, 2, 3, 4):
        follow = {}
        for g, c in n.items():
            if len(g) == d + 1 and c >= 2:
                follow.setdefault(g[:-1], []).append((g[-1], c))
        for s, after in follow.items():
            b = min(max(1 - sum(c - 0.75 for _, c in after) / n[s], 1e-9), 1)
            gain = (n[s] - sum(c for _, c in after)) * math.log10(b)
            for w, c in after:
                gain += c * (math.log10((c - 0.75) / n[s] + b * p(s[1:], w)) - math.log10(p(s[1:], w)))
            delta[s] = (b, gain > 0.5 * (len(after) + 1) * math.log10(max(n[s], 2)))
        back |= {s: b for s, (b, ok) in delta.items() if ok and len(s) == d}
    assert ("zig",) in back and any(len(s) == 4 for s in back)
    want = [sum(math.log10(p(tuple(x[max(0, i - 4):i]), x[i])) for i in range(len(x))) for x in map(tokens, texts + held)]
    for few in ({}, {"p_word": 2.0 ** -5, "p_context": 2.0 ** -5, "p_pair": 2.0 ** -5}, {"p_word": 1.0, "p_context": 1.0, "p_pair": 1.0}):  # what is broadcast changes nothing
        tree, counts = op6_suffix_tree.train(docs.where(f"doc_id < {len(texts)}"), depth=4, **few)
        got = {r.doc_id: r.score for r in op6_suffix_tree.score(docs, tree, counts).collect()}
        assert max(abs(got[k] - x) for k, x in enumerate(want)) < 1e-6


def test_suffix_tree_without_training_or_documents(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 1), (2, None, "y", 2)], "doc_id long, text string, block string, sums int")
    tree, counts = op6_suffix_tree.train(docs.where("false"))
    assert {(r.doc_id, r.n_tokens, r.n_known, r.base_score) for r in op6_suffix_tree.score(docs, tree, counts).collect()} == {(1, 3, 0, 0.0), (2, 1, 0, 0.0)}
    tree, counts = op6_suffix_tree.train(docs)
    assert op6_suffix_tree.score(docs.where("false"), tree, counts).count() == 0


# --- op7 ----------------------------------------------------------------------------
def test_itq_neardup(spark):
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(150):
        centre = rng.normal(size=48)
        for _ in range(rng.integers(1, 6)):
            rows.append((centre + rng.normal(size=48) * rng.choice([0.0, 0.1, 0.25, 0.4])).astype(np.float32).tolist())
    rows += [rows[0]] * 40 + [(np.array(rows[1]) * 3).tolist()]
    hub = rng.normal(size=48)
    rows += [(hub + rng.normal(size=48) * 0.1).astype(np.float32).tolist() for _ in range(300)]
    odd = [None, [], [0.0] * 48, [float("nan")] + [1.0] * 47, [None] + [1.0] * 47, [float("inf")] * 48, [1.0, 2.0], [2.0, 4.0]]
    data = [(k, v, "x") for k, v in enumerate(rows + odd)] + [(None, rows[2], "x")]
    got = op7_itq_neardup.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<float>, kept string"))
    got = {(r.vec_id if r.vec_id is not None else len(rows) + len(odd)): r for r in got.collect()}
    every = rows + [rows[2]]
    ids = list(range(len(rows))) + [len(rows) + len(odd)]
    x = np.array(every, float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    links = np.array([got[k].n_links for k in ids])
    assert (links <= near.sum(axis=1)).all() and links.sum() >= 0.98 * near.sum()
    for k in range(len(rows), len(rows) + 6):
        assert (got[k].n_links, got[k].component_id, got[k].kept) == (0, k, True)
    assert got[len(rows) + 6].n_links == 1 and got[len(rows) + 7].component_id == len(rows) + 6
    assert got[0].n_links >= 40 and not got[len(rows) - 301 - 5].kept
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert op7_itq_neardup.near_duplicates(none).count() == 0


@pytest.mark.parametrize("strength", [0.0, 1.0, 2.0, 3.0])
def test_codes_of_vectors_with_a_common_direction(strength):
    """Of pairs with cosines from 0.9 on, the tables reach nearly all, whatever the number of vectors that cuts the code."""
    rng = np.random.default_rng(1)
    x = strength * np.eye(64)[0] + rng.normal(size=(4000, 64)) / 8
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.normal(size=x.shape)
    side -= (side * x).sum(axis=1, keepdims=True) * x
    c = rng.uniform(0.9, 1, size=(len(x), 1))
    y = c * x + np.sqrt(1 - c * c) * side / np.linalg.norm(side, axis=1, keepdims=True)
    rotation = op7_itq_neardup.Rotation(x)
    a, b = rotation.code(x), rotation.code(y)
    assert np.bitwise_count(a ^ b).max() <= op7_itq_neardup.FARTHEST
    for points in (10_256, 51_282, 10 ** 7, 10 ** 9):
        t = op7_itq_neardup.Tables(64, points)
        found = np.zeros(len(x), bool)
        for k in range(len(t.cuts)):
            found |= np.bitwise_count(t.sub(a, k) ^ t.sub(b, k)) <= t.near
        assert found.mean() >= 0.97


def test_links_of_vectors_with_a_common_direction(spark):
    rng = np.random.default_rng(8)
    x = 2.0 * np.eye(48)[0] + rng.normal(size=(700, 48)) / 7
    x = np.concatenate([x, x[:100] + rng.normal(size=(100, 48)) * 0.04])
    got = op7_itq_neardup.near_duplicates(spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>"))
    links = np.array([r.n_links for r in sorted(got.collect(), key=lambda r: r.vec_id)])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.9).sum(axis=1) - 1
    assert (links <= near).all() and links.sum() >= 0.98 * near.sum() > 0


def test_substring_tables_find_every_pair_within_the_radius():
    t = op7_itq_neardup.Tables(64, 51282)
    assert sum(n for _, n in t.cuts) == 64 and (t.near + 1) * len(t.cuts) > op7_itq_neardup.RADIUS


# --- op10 ---------------------------------------------------------------------------
def quality_docs(rng, n):
    out = []
    for k in range(n):
        good = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(4, 25))).capitalize() + "." for _ in range(rng.randint(1, 8))]
        if rng.random() < 0.5:
            out.append((k, "\n".join(good), 1))
            continue
        bad = rng.choice([" ".join([rng.choice(WORDS)] * 30), " | ".join(rng.choice(WORDS) for _ in range(20)), " ".join(rng.choice(WORDS) + "$$$" for _ in range(20)),
                          " ".join(rng.choice(WORDS).upper() + "!!" for _ in range(20))])
        out.append((k, "\n".join(good[:1] + [bad] * rng.randint(2, 5)), 0))
    return out


def test_line_crf(spark):
    rows = quality_docs(random.Random(6), 500)
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows] + [(900, None), (901, ""), (902, "\n" * 5000)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y, 0) for k, _, y in rows] + [(7777, 1, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    chain = op10_line_crf.train(docs.where("doc_id < 300"), labels)
    got = {r.doc_id: r for r in op10_line_crf.classify(docs.withColumn("score", F.lit("clash")), chain).collect()}
    held = [(got[k].predicted, y) for k, _, y in rows if k >= 300]
    assert np.mean([a == b for a, b in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values()) and len(got) == 503
    assert op10_line_crf.classify(docs.where("false"), chain).count() == 0
    one = op10_line_crf.train(docs, labels.where("quality = 1"))
    assert {r.predicted for r in op10_line_crf.classify(docs, one).collect()} == {1}


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(3)
    chain = op10_line_crf.LineChain()
    chain.move = rng.normal(size=(2, 2))
    score, bounds = rng.normal(size=9), np.array([0, 4, 5, 9])
    good, log_z, moves = chain.marginals(score, bounds, pairs=True)
    want, z_sum, want_moves = np.zeros(9), 0.0, np.zeros((2, 2))
    for a, b in zip(bounds[:-1], bounds[1:]):
        paths = [[m >> j & 1 for j in range(b - a)] for m in range(1 << (b - a))]
        weight = np.array([math.exp(sum(score[a + j] * y for j, y in enumerate(p)) + sum(chain.move[p[j], p[j + 1]] for j in range(len(p) - 1))) for p in paths])
        z_sum += math.log(weight.sum())
        for p, w in zip(paths, weight / weight.sum()):
            want[a:b] += np.array(p) * w
            for j in range(len(p) - 1):
                want_moves[p[j], p[j + 1]] += w
    assert np.allclose(good, want) and math.isclose(log_z, z_sum) and np.allclose(moves, want_moves)


# --- pipeline -----------------------------------------------------------------------
def test_pipeline_stages(spark):
    import corpus_pipeline

    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language ID", "quality classifier", "n-gram Jaccard join", "secret scans", "packing"]
    stages = dict(corpus_pipeline.STAGES)
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = stages["language ID"](spark, docs, sf)
    assert kept.columns == docs.columns and kept.where("not rlike(text, '[a-zA-Z\\u00c0-\\u00ff]')").count() == 0
    good = stages["quality classifier"](spark, kept, sf)
    assert good.columns == docs.columns
    some = spark.createDataFrame([(9, "a b c d e f g", "en", "s", 1), (4, "A b  c d e f g", "en", "s", 1), (4, "a b c d e f g h i j k l m n o p", "en", "s", 1),
                                  (7, None, "en", "s", 0), (8, " ", "en", "s", 0), (4, "A b  c d e f g", "en", "s", 1), (None, "else", "en", "s", 0)], docs.schema)
    one = stages["n-gram Jaccard join"](spark, some, sf)
    assert Counter((r.doc_id, r.text) for r in one.collect()) == Counter(
        {(4, "A b  c d e f g"): 1, (4, "a b c d e f g h i j k l m n o p"): 1, (7, None): 1, (8, " "): 1, (None, "else"): 1})
    masked = stages["secret scans"](spark, spark.createDataFrame([(1, "x password=abcdef123 y", "en", "s", 22)], docs.schema), sf)
    assert masked.columns == docs.columns and [(r.text, r.n_chars) for r in masked.collect()] == [("x [SECRET] y", 12)]
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), sf).count() == 0, name


def test_pipeline_rows_equal_the_stages_by_brute_force(spark):
    """The rows of run(): documents that the models keep, one of each group of near copies, masked, cut into pieces."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    from copyhound.llm import op2_secrets, op9_packing
    from copyhound.llm.tokens import vocabulary_path

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = docs.collect()
    pred = {r.doc_id: r for r in op5_language.predict(docs, op5_language.train(docs)).collect()}
    kept = [r for r in rows if pred[r.doc_id].lang_pred != "und" and pred[r.doc_id].score >= 0.5]
    frame = spark.createDataFrame(kept, docs.schema)
    score = {r.doc_id: r.predicted for r in op10_line_crf.classify(frame, op10_line_crf.train(frame, labels)).collect()}
    kept = [r for r in kept if score[r.doc_id] == 1]
    groups = brute_groups([(r.doc_id, r.text) for r in kept], 5, 80)
    kept = [r for r in kept if any(d == r.doc_id and c == d for d, _, c in groups)]
    clean = {r.doc_id: r.text for r in op2_secrets.redacted(spark.createDataFrame(kept, docs.schema)).collect()}
    t = Tokenizer.from_file(vocabulary_path())
    t.encode_special_tokens = True
    want = set()
    for r in kept:
        ids, at = t.encode(clean[r.doc_id], add_special_tokens=False).ids + [0], 0
        for size in op9_packing.binary_lengths(len(ids)):
            want.add((r.doc_id, at, int(size), zlib.crc32(np.array(ids[at:at + size], "<u4").tobytes()), len(ids)))
            at += size
    got = corpus_pipeline.run(spark, sf).collect()
    assert {(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got} == want and len(got) == len(want)


def test_letters_are_those_of_unicode():
    import unicodedata

    import pyarrow as pa

    from copyhound.llm import blocks as B

    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    got = []
    for _, _, data, off in B.text_blocks(pa.array([chr(c) for c in points])):
        code, bounds = op5_language.code_points(data, off)
        got += B.per_row((op5_language.letter_table()[code] == 2).astype(np.int64), bounds).tolist()
    assert [c for c, n in zip(points, got) if n] == [c for c in points if unicodedata.category(chr(c)).startswith("L")]


def test_language_by_brute_force(spark):
    """Counts, posteriors and und in plain Python, with each n-gram's bucket taken from the operator."""
    import pyarrow as pa

    from copyhound.llm import blocks as B

    def cells(text):
        out = []
        for _, _, data, off in B.text_blocks(pa.array([text])):
            code, bounds = op5_language.code_points(data, off)
            for k, order in enumerate(op5_language.ORDERS):
                out += [(k, int(b)) for b in op5_language.gram_buckets(code, bounds, order)[1]]
        return out

    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(w) for _ in range(rng.randint(1, 9))), lang) for i in range(60)
            for lang, w in (("aa", ["the", "of", "and"]), ("bb", ["der", "und", "für", "the"]))]
    tests = [None, "", "12 ٣ ４！", "\U0001F600 €", "º", "the für", "der der", "xyz", "日本"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = op5_language.train(docs)
    got = op5_language.predict(spark.createDataFrame(list(enumerate(tests)), "doc_id long, text string"), model).collect()
    counts = {lang: {} for lang in ("aa", "bb")}
    for _, text, lang in rows:
        for cell in cells(text):
            counts[lang][cell] = counts[lang].get(cell, 0) + 1
    total = {(lang, k): sum(n for (j, _), n in c.items() if j == k) + 0.5 * 2 ** op5_language.BUCKET_BITS for lang, c in counts.items() for k in range(3)}
    for r in sorted(got, key=lambda r: r.doc_id):
        text = tests[r.doc_id]
        if not any(ch.isalpha() for ch in text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        logs = {lang: np.log(0.5) + sum(np.log((c.get(cell, 0) + 0.5) / total[lang, cell[0]]) for cell in cells(text)) for lang, c in counts.items()}
        best = max(sorted(logs), key=lambda x: logs[x])
        assert r.lang_pred == best and abs(r.score - 1 / sum(np.exp(v - logs[best]) for v in logs.values())) < 1e-4


def test_the_lines_learned_from_are_bounded(spark):
    texts = pa.chunked_array([pa.array(["a", "x\n" * 9, None]), pa.array(["b\nc", ""])], pa.string())
    assert [op10_line_crf._bounded(texts, most) for most in (100, 15, 14, 12, 11, 1, 0)] == [5, 5, 4, 3, 2, 1, 0]
    assert op10_line_crf._bounded(pa.chunked_array([], pa.string()), 4) == 0
    docs = spark.createDataFrame([(k, "\n" * 40) for k in range(6)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(6)], "doc_id long, quality int")
    chain = op10_line_crf.train(docs, labels, most_lines=40)  # none fits: as without labels
    assert [r.score for r in op10_line_crf.classify(docs, chain).collect()] == [0.5] * 6
