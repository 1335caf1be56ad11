"""Operators 11, 12 and 13 against plain loops: nulls, empty and long values, ties, repeated rows, odd columns, empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from copyhound.llm import blocks as B
from copyhound.llm import op11_prefix_trie, op12_contamination, op13_spelling


def plain_trie(rows):
    """op11 by its definition; rows: (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, tie, role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        built[c] = own.get(base, [])[:h] + own[c][h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    sha = lambda p: hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], sha(p)) for p, m in members.items())


def conversations():
    rng = random.Random(11)
    rows = []
    for c in [*range(90, 130), 200, 201, 205, 299, -3, -150, 1000]:
        for t in range(rng.randint(0, 7)):
            rows.append((c, t, rng.choice(["user", "system", None]), rng.choice(["a", "bb", "", None, "日本", "x" * 50])))
    rows += [(c, t, "user", f"copy {t}") for c in range(300, 700) for t in range(3)]  # a group of copies
    rows += [(c, t, "user", "first" if t == 0 else f"{c} {t}") for c in range(800, 860) for t in range(2)]  # one first turn
    rows += [(5000, t, "user", f"long {t % 7}") for t in range(400)] + [(5001, t, "user", f"long {t % 7}") for t in range(300)]
    rows += [(7, 1, "user", "tie"), (7, 1, "user", "other"), (7, 1, "user", "tie"), (7, None, "user", "first"), (7, None, None, None), (None, 1, "user", "lost")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("chunk, band", [(40, 4), (1 << 16, 512)])
def test_prefix_trie(spark, chunk, band):
    rows = conversations()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, chunk string").repartition(5)
    got = op11_prefix_trie.prefix_trie(df, chunk, band)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=lambda r: (r[0], r[1])) == sorted(plain_trie(rows), key=lambda r: (r[0], r[1]))


def test_prefix_trie_without_rows(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert op11_prefix_trie.prefix_trie(df).count() == 0
    df = spark.createDataFrame([(None, 1, "user", "x")], "conv_id long, turn long, role string, text string")
    assert op11_prefix_trie.prefix_trie(df).count() == 0


def test_double_array_holds_each_path_and_no_other():
    rng = random.Random(5)
    paths = sorted({tuple([0] + [rng.randint(1, 9) for _ in range(rng.randint(0, 6))]) for _ in range(400)} | {(0, x) for x in range(1, 300)})
    labels = np.array([x for p in paths for x in p])
    bounds = np.append(0, np.cumsum([len(p) for p in paths]))
    slot, base, check = op11_prefix_trie.packed(*op11_prefix_trie.edges(labels, bounds))
    prefixes = {p[:k] for p in paths for k in range(len(p) + 1)}
    assert len(slot) == len(prefixes) == len(set(slot.tolist()))

    def there(p):
        s = 0
        for x in p:
            t = int(base[s]) + x
            if not 0 <= t < len(check) or check[t] != s:
                return False
            s = t
        return True

    assert all(there(p) for p in prefixes)
    others = [tuple([0] + [rng.randint(1, 9) for _ in range(rng.randint(1, 6))]) for _ in range(3000)]
    assert all(there(p) == (p in prefixes) for p in others)


def plain_hits(text, items, window):
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    w = word.findall(lower(text))
    hit, ids = set(), set()
    for item, t in items:
        v = word.findall(lower(t))
        if item is None or not v:
            continue
        size = min(len(v), window)
        windows = {tuple(v[k:k + size]) for k in range(len(v) - size + 1)}
        for k in range(len(w) - size + 1):
            if tuple(w[k:k + size]) in windows:
                hit |= set(range(k, k + size))
                ids.add(str(item))
    places = [m.span() for m in word.finditer(lower(text))]
    spans = []
    for k in sorted(hit):
        if k - 1 in hit:
            spans[-1] = (spans[-1][0], places[k][1])
        else:
            spans.append(places[k])
    return len(w), len(hit), sorted(ids), spans


@pytest.mark.parametrize("window, most_words", [(4, 200_000), (4, 30), (10, 200_000)])
def test_contamination(spark, window, most_words):
    rng = random.Random(12)
    words = ["a", "b", "é", "日本", "c1", "D"]
    some = lambda n: "".join(rng.choice(words) + rng.choice([" ", ", ", "\n", "--", "_"]) for _ in range(n))
    items = [(k, some(rng.randint(1, 30))) for k in range(12)] + [(20, ""), (21, None), (None, "a b c1 d"), (3, some(9)), (22, "d é"), (23, " é "), (24, "unseen words")]
    texts = [None, "", "...", "d", some(3000), "x " + items[4][1].upper() + " y", items[5][1] + "zz" + items[6][1]] + [some(rng.randint(0, 60)) for _ in range(80)]
    rows = [(k if k != 8 else None, t) for k, t in enumerate(texts)] + [(6, texts[6])]
    docs = spark.createDataFrame([(*r, 5, "clash") for r in rows], "doc_id long, text string, n_words int, hits string").repartition(3)
    bench = spark.createDataFrame([(*r, "clash") for r in items], "item_id long, text string, part string")
    got = op12_contamination.contaminated(docs, bench, window, most_words).collect()
    found = Counter((r.doc_id, r.text, r.n_words, sum(h.stop - h.start for h in r.hits), tuple(r.item_ids), tuple((s.start, s.stop) for s in r.spans)) for r in got)
    want = []
    for doc_id, text in rows:
        n, hit, ids, spans = plain_hits(text, items, window)
        want.append((doc_id, text, n, hit, tuple(ids), tuple(spans)))
    assert found == Counter(want)
    assert any(w[3] for w in want) and not all(w[3] for w in want)


def test_contamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    row = op12_contamination.contaminated(docs, none).first()
    assert (row.n_words, row.hits, row.item_ids, row.spans) == (2, [], [], [])
    assert op12_contamination.contaminated(docs.where("false"), none).count() == 0


def test_states_do_not_depend_on_lanes():
    rng = random.Random(3)
    items = [(str(k), " ".join(rng.choice("abcd") for _ in range(rng.randint(1, 14)))) for k in range(40)]
    t = op12_contamination.Automaton(items, 6)
    symbols = np.array([rng.randint(-1, 3) for _ in range(5000)])
    whole = t.states(symbols, 5000)
    assert all((t.states(symbols, lane) == whole).all() for lane in (1, 7, 64, 999))


def plain_forms(rows, least_length, least_count, times):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            if len(run) >= least_length:
                counts[run] += 1
    counts = {w: n for w, n in counts.items() if n >= least_count}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))

    form, found = {}, {}
    for w, n in counts.items():
        others = [v for v in counts if near(w, v)]
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= times * n else None
        found[w] = len(others)
    out = []
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, found[w], counts[form[w]] if form[w] else None))
    return sorted(out)


def test_spelling_forms(spark):
    rng = random.Random(13)
    pool = ["".join(rng.choice("abÀé") for _ in range(rng.randint(3, 5))) for _ in range(60)] + ["aaaa", "aaaaa", "aaa", "ÿÿÿ×", "a" * 400, "a" * 399, "b" * 600]
    weight = [3 ** rng.randint(0, 5) for _ in pool]
    rows = [(k if k % 50 else None, " ".join(rng.choices(pool, weight, k=30)) + rng.choice([" 日本 a1b", ", ABé ", "\n"])) for k in range(300)]
    rows += [(1, None), (2, ""), (3, "éa"), rows[7], rows[7]]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n int, key string").repartition(4)
    got = op13_spelling.spelling_forms(docs, 3, 2, 4)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = plain_forms(rows, 3, 2, 4)
    assert sorted(map(tuple, got.collect())) == want
    assert any(w[1] and w[2] != w[1] for w in want)


def test_spelling_without_words(spark):
    docs = spark.createDataFrame([(1, None), (2, "1 2 3"), (3, "once")], "doc_id long, text string")
    assert op13_spelling.spelling_forms(docs).count() == 0
    assert op13_spelling.spelling_forms(docs.where("false")).count() == 0


def test_crc32_of_runs():
    rng = random.Random(2)
    texts = [bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 7, 40, 300, 3000]))) for _ in range(60)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    end = np.cumsum([len(t) for t in texts])
    before = np.array([zlib.crc32(b"x" * k) for k in range(60)], np.uint32)
    got = op13_spelling.crc32_runs(data, end - [len(t) for t in texts], end, before)
    assert got.tolist() == [zlib.crc32(t, int(b)) for t, b in zip(texts, before)]
    assert len(B.runs(np.zeros(0, bool), np.zeros(1, np.int64))[0]) == 0
