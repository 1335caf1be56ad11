"""check_code (X7): files -> blocks -> candidate blocks -> score -> floor -> best per url -> top-10, over the code
views; and the whole-file path (X6).

Submissions and corpus are the whole code table; a file never matches its own corpus entry. Candidates are all blocks of
the corpus that are similar enough (``candidates="grams"``, an exact join), or the blocks of the files that a block's terms
find in the token index (``"hits"``, with budgets: ``C.REFERENCE_BUDGET`` is what the reference's search allows)."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copyhound import config as C
from copyhound.functions import text as T
from copyhound.operators import blocks as B
from copyhound.operators import lookup as L
from copyhound.operators import report as R
from copyhound.operators import terms as TM
from copyhound.operators.gram_join import top_sources
from copyhound.operators.similarity import best_block_match, pair_similarity
from copyhound.plans import code_views as V
from copyhound.session import kept, shuffled
from copyhound.sources.tables import read_table

REPO_SQL = "concat('repo', p_partkey % 120)"


def corpus_files(spark: SparkSession, sf_dir: str, langs=None) -> DataFrame:
    """S3: the known-code corpus (corpus_id, repository, file_path, url, content,
    language, indexed_at, license)."""
    c = V.code_files(spark, sf_dir, langs).selectExpr(
        "path AS corpus_id", f"{REPO_SQL} AS repository", "path AS file_path",
        f"concat('https://code.example.org/', {REPO_SQL}, '/', path) AS url",
        "code AS content", "language", "p_partkey AS indexed_at")
    return L.attach_license(c, licenses(spark, sf_dir))


def licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read_table(spark, sf_dir, "supplier")
    n = read_table(spark, sf_dir, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey).select(
        F.concat(F.lit("repo"), F.col("s_suppkey").cast("string")).alias("repository"),
        F.col("n_name").alias("license"))


def submitted_files(spark: SparkSession, sf_dir: str, langs=None) -> DataFrame:
    return V.code_files(spark, sf_dir, langs).select("path", "language", "code", F.col("path").alias("self_id"))


def score_texts(pairs: DataFrame, left: DataFrame, right: DataFrame, lkey, rkey, token_k: int) -> DataFrame:
    """pairs with ``similarity`` (X1 on token grams) of left (lkey, norm) and right (rkey, norm). Every pair of different
    normalized texts is scored once, however many files share them."""
    l = left.select(*lkey, F.md5("norm").alias("lmd"), "norm")
    r = right.select(*rkey, F.md5("norm").alias("rmd"), "norm")
    # read for the different pairs of texts and for the result: the search for candidates isn't run twice
    both = kept(pairs.join(shuffled(l.drop("norm")), list(lkey)).join(shuffled(r.drop("norm")), list(rkey)), "candidate-pairs", "zstd")
    texts = lambda d, c: d.groupBy(c).agg(F.first("norm").alias("norm"))
    scored = pair_similarity(both.select("lmd", "rmd").distinct(), texts(l, "lmd"), texts(r, "rmd"), "lmd", "rmd", k=token_k, unit="token")
    return both.join(shuffled(scored.select("lmd", "rmd", "similarity")), ["lmd", "rmd"]).drop("lmd", "rmd")


def similar_sources(mine: DataFrame, theirs: DataFrame, cfg: C.CheckConfig, token_k: int) -> DataFrame:
    """The similar corpus files of each row of mine (path, language, norm, and columns that don't clash): mine's columns and
    corpus_id, url, similarity, source_rank, cname. theirs: (language, norm, corpus_id, url, posting_rank, cname). One more
    than ``cfg.top_code`` a text, since one of them may be the file itself."""
    text = lambda d: d.withColumns({"scope": F.col("language"), "id": F.md5("norm")})
    mine, theirs = text(mine), text(theirs)
    texts = mine.select("scope", "id", "norm").unionByName(theirs.select("scope", "id", "norm")).groupBy("scope", "id").agg(F.first("norm").alias("norm"))
    postings = theirs.select("scope", "id", "url", "posting_rank", F.struct("corpus_id", "cname").alias("detail"))
    found = top_sources(texts, postings, cfg.top_code + 1, round(100 * cfg.code_floor), token_k, "token", kept, mine.select("scope", "id"))
    found = found.select("scope", "id", "url", "similarity", F.col("posting_rank").alias("source_rank"), "detail.corpus_id", "detail.cname")
    return mine.drop("norm").join(shuffled(found), ["scope", "id"]).drop("scope", "id")


def corpus_blocks(corpus: DataFrame) -> DataFrame:
    """The corpus's blocks with their normalized text, extracted once and kept as a table."""
    rows = B.block_rows(corpus.select("corpus_id", F.col("content").alias("code"), "language"), ["corpus_id"])
    return kept(rows.withColumn("norm", T.normalize("code", "language")), "corpus-blocks")


def check_code(files: DataFrame, corpus: DataFrame, cfg: C.CheckConfig = C.CheckConfig(), token_k: int = 3, known: DataFrame | None = None) -> DataFrame:
    """Code matches per file: path, url, repository, file_path, license, similarity,
    original_block, matched_block, block_type, match_rank. ``known``: the corpus_blocks, where they are stored already."""
    key = ["path"]
    # block rows feed terms, scoring and the report: extracted once and kept as tables
    fblocks = kept(B.block_rows(files, key).withColumn("norm", T.normalize("code", "language")), "file-blocks")
    cblocks = corpus_blocks(corpus) if known is None else known
    if cfg.candidates == "grams":
        theirs = cblocks.select("language", "norm", "corpus_id", F.col("block_rank").alias("posting_rank"), F.col("name").alias("cname"))
        theirs = theirs.join(shuffled(corpus.select("corpus_id", "url")), "corpus_id")
        best = similar_sources(fblocks.select(*key, "language", "norm", "block_id", "block_rank", F.col("name").alias("original_block"), "block_type"), theirs, cfg, token_k)
        best = best.join(shuffled(files.select(*key, "self_id")), key).where("self_id <> corpus_id")
        return reported(best, corpus, cfg, key)
    index = kept(L.build_term_index(corpus), "term-index", "zstd")
    terms = TM.select_terms(fblocks, [*key, "block_id"], "code", "language", L.term_df(index), cfg.terms_per_text)
    if cfg.max_terms_per_block is not None:
        terms = terms.where(F.col("term_rank") <= cfg.max_terms_per_block)
    if cfg.max_blocks_per_file is not None:
        keep = fblocks.where(F.col("block_rank") <= cfg.max_blocks_per_file).select(*key, "block_id")
        terms = terms.join(shuffled(keep), [*key, "block_id"], "left_semi")
    selfs = files.select(*key, "self_id")
    hits = L.lookup_terms(terms.join(shuffled(selfs), key), index, [*key, "block_id"], cfg.hits_per_term, self_col="self_id")
    pairs = L.hit_block_pairs(hits, cblocks, [*key, "block_id"])
    scored = score_texts(pairs, fblocks.select(*key, "block_id", "norm"), cblocks.select("corpus_id", F.col("block_id").alias("cblock_id"), "norm"),
                         [*key, "block_id"], ["corpus_id", "cblock_id"], token_k)
    best = best_block_match(scored, [*key, "block_id", "corpus_id"])
    if cfg.extra.get("stage") == "best":
        return best
    best = R.match_floor(best, "code", floor=cfg.code_floor)
    best = best.join(shuffled(fblocks.select(*key, "block_id", "block_rank", F.col("name").alias("original_block"),
                                             "block_type")), [*key, "block_id"])
    return reported(best.join(shuffled(corpus.select("corpus_id", "url")), "corpus_id"), corpus, cfg, key)


def reported(best: DataFrame, corpus: DataFrame, cfg: C.CheckConfig, key: list[str]) -> DataFrame:
    """P1 and P2 of block matches: the best of each file and url, and of these the top of each file."""
    dedup = R.dedup_url(best, key, "url", tiebreak=["block_rank", "block_id"])
    if cfg.extra.get("stage") == "dedup":
        return dedup
    top = R.top_matches(dedup, key, cfg.top_code, tiebreak=["url"])
    top = top.join(shuffled(corpus.select("corpus_id", "repository", "file_path", "license")), "corpus_id")
    return top.select(*key, "url", "repository", "file_path", "license", "similarity",
                      F.col("original_block"), F.col("cname").alias("matched_block"), "block_type", "match_rank")


def check_files(files: DataFrame, corpus: DataFrame, cfg: C.CheckConfig = C.CheckConfig(), token_k: int = 3) -> DataFrame:
    """Matches of whole files, for files without a block match. Both sides are B8's text, normalized. With candidates
    by hits, terms are those of the whole file, with five hits each in the reference's budget."""
    mine = files.select("path", "language", "self_id", B.fallback_block("code").alias("code"))
    theirs = corpus.select("corpus_id", "language", B.fallback_block("content").alias("code"))
    if cfg.candidates == "grams":
        texts = kept(mine.select("path", "language", "self_id", T.normalize("code", "language").alias("norm")), "file-texts")
        known = corpus.select("corpus_id", "url").join(shuffled(theirs.select("corpus_id", "language", T.normalize("code", "language").alias("norm"))), "corpus_id")
        known = kept(known.select("language", "norm", "corpus_id", "url", F.lit(0).alias("posting_rank"), F.lit("").alias("cname")), "corpus-texts")
        best = similar_sources(texts, known, cfg, token_k).where("self_id <> corpus_id").drop("cname", "source_rank")
        top = R.top_matches(R.dedup_url(best, ["path"], "url", tiebreak=["corpus_id"]), ["path"], cfg.top_code, tiebreak=["url"])
        return top.join(shuffled(corpus.select("corpus_id", "repository", "license")), "corpus_id").select("path", "url", "repository", "license", "similarity", "match_rank")
    index = kept(L.build_term_index(corpus), "term-index", "zstd")
    terms = TM.select_terms(mine, ["path"], "code", "language", L.term_df(index), cfg.terms_per_text)
    hits = L.lookup_terms(terms.join(shuffled(mine.select("path", "self_id")), "path"), index, ["path"], cfg.hits_per_term, self_col="self_id")
    norm = lambda d, k: d.select(k, T.normalize("code", "language").alias("norm"))
    scored = score_texts(hits.select("path", "corpus_id").distinct(), norm(mine, "path"), norm(theirs, "corpus_id"), ["path"], ["corpus_id"], token_k)
    best = R.match_floor(scored, "code", floor=cfg.code_floor).join(shuffled(corpus.select("corpus_id", "url", "repository", "license")), "corpus_id")
    top = R.top_matches(R.dedup_url(best, ["path"], "url", tiebreak=["corpus_id"]), ["path"], cfg.top_code, tiebreak=["url"])
    return top.select("path", "url", "repository", "license", "similarity", "match_rank")


def code_matches(spark: SparkSession, sf_dir: str, langs=None) -> DataFrame:
    return check_code(submitted_files(spark, sf_dir, langs), corpus_files(spark, sf_dir, langs))


def best_matches(spark: SparkSession, sf_dir: str, langs=None) -> DataFrame:
    """X5 output: best candidate block per (block, corpus file), before the floor."""
    cfg = replace(C.REFERENCE_BUDGET, extra={"stage": "best"})
    b = check_code(submitted_files(spark, sf_dir, langs), corpus_files(spark, sf_dir, langs), cfg)
    return b.select("path", "block_id", "corpus_id", F.col("cname").alias("matched_block"), "similarity")
