"""Term index and retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from copyhound import config as C
from copyhound.functions import text as T
from copyhound.session import shuffled

# FIXED VALUES: an index token is an identifier, which may hold $, or a dotted name; parts without $ count too
TOKEN = r"[A-Za-z_$][A-Za-z0-9_$]*(?:\.[A-Za-z_$][A-Za-z0-9_$]*)*"
PARTS = [r"[A-Za-z_$][A-Za-z0-9_$]*", r"[A-Za-z_][A-Za-z0-9_]*"]


def build_term_index(corpus: DataFrame, id_col: str = "corpus_id", text_col: str = "content",
                     lang_col: str = "language", order_col: str = "indexed_at") -> DataFrame:
    """(term, language, corpus_id, indexed_at) postings, one per distinct token of
    a file. Dotted names and names with $ are indexed whole and per identifier, which a text without dots or $ needn't be searched for."""
    found = [F.regexp_extract_all(F.col(text_col), F.lit(p), F.lit(0)) for p in (TOKEN, *PARTS)]
    parts = [F.when(F.col(text_col).contains(mark), x).otherwise(F.array().cast("array<string>")) for mark, x in zip(".$", found[1:])]
    toks = F.array_distinct(F.concat(found[0], *parts))
    return corpus.select(F.explode(toks).alias("term"), lang_col, id_col, order_col)


def lookup_phrases(terms: DataFrame, index: DataFrame, corpus: DataFrame, key_cols, lang_col: str = "language",
                   id_col: str = "corpus_id", text_col: str = "content") -> DataFrame:
    """R2 for terms of several words: the corpus files that hold the words of a phrase one after another.

    A phrase's least frequent word picks the files (an equi-join with its postings), whose text is then searched;
    white space of any length counts as one space."""
    phrases = terms.where(F.col("term").rlike(T.WHITE)).withColumn("phrase", F.trim(T.rx_replace("term", T.WHITE + "+", " ")))
    phrases = phrases.select(*key_cols, lang_col, "phrase")
    distinct = phrases.select(lang_col, "phrase").distinct()
    words = distinct.select(lang_col, "phrase", F.explode(F.regexp_extract_all("phrase", F.lit(TOKEN), F.lit(0))).alias("term"))
    rarest = words.join(shuffled(term_df(index, lang_col)), ["term", lang_col]).groupBy(lang_col, "phrase").agg(F.min(F.struct("df", "term")).alias("r"))
    files = rarest.select(lang_col, "phrase", F.col("r.term").alias("term")).join(shuffled(index.select("term", lang_col, id_col)), ["term", lang_col])
    text = corpus.select(id_col, T.rx_replace(text_col, T.WHITE + "+", " ").alias("flat"))
    found = files.join(shuffled(text), id_col).where(F.col("flat").contains(F.col("phrase"))).select(lang_col, "phrase", id_col)
    return phrases.join(shuffled(found), [lang_col, "phrase"])


def term_df(index: DataFrame, lang_col: str = "language") -> DataFrame:
    """Corpus document frequency per (term, language) — partial aggregation map-side."""
    return index.groupBy("term", lang_col).agg(F.count(F.lit(1)).cast("long").alias("df"))


def newest_postings(index: DataFrame, k: int | None, lang_col: str = "language",
                    order_col: str = "indexed_at", id_col: str = "corpus_id") -> DataFrame:
    """The ``k`` newest postings of every (term, language) with their hit_rank.
    Planned as a WindowGroupLimit, so at most k rows per term leave each map task."""
    w = Window.partitionBy("term", lang_col).orderBy(F.col(order_col).desc(), F.col(id_col).asc())
    p = index.withColumn("hit_rank", F.row_number().over(w).cast("int"))
    return p if k is None else p.where(F.col("hit_rank") <= k)


def lookup_terms(terms: DataFrame, index: DataFrame, key_cols, k: int | None = None,
                 self_col: str | None = None, lang_col: str = "language", id_col: str = "corpus_id",
                 order_col: str = "indexed_at") -> DataFrame:
    """R2: inner equi-join of (unit, term, language) with the newest postings of the
    term, at most ``k`` hits per term after excluding the unit's own corpus entry
    (``self_col``): k+1 postings are fetched so the exclusion loses nothing."""
    extra = 0 if self_col is None else 1
    post = newest_postings(index, None if k is None else k + extra, lang_col, order_col, id_col)
    t = terms.where(F.trim("term") != "")
    j = t.join(shuffled(post), ["term", lang_col])
    if self_col is not None:
        j = j.where(F.col(self_col) != F.col(id_col))
    if k is not None:
        w = Window.partitionBy(*key_cols, "term").orderBy("hit_rank")
        j = j.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")
    return j


def search_budget(blocks: DataFrame, terms: DataFrame, key_cols, max_blocks: int | None = C.MAX_BLOCKS_PER_FILE,
                  max_terms: int | None = C.MAX_TERMS_PER_BLOCK, max_lookups: int | None = C.MAX_LOOKUPS_PER_FILE
                  ) -> DataFrame:
    """Per file at most ``max_blocks`` blocks (by block_rank), ``max_terms`` terms
    per block (by term_rank) and ``max_lookups`` lookups in (block_rank, term_rank) order."""
    b = blocks if max_blocks is None else blocks.where(F.col("block_rank") <= max_blocks)
    t = terms if max_terms is None else terms.where(F.col("term_rank") <= max_terms)
    bt = t.join(shuffled(b.select(*key_cols, "block_id", "block_rank")), [*key_cols, "block_id"])
    w = Window.partitionBy(*key_cols).orderBy("block_rank", "term_rank")
    bt = bt.withColumn("lookup_no", F.row_number().over(w).cast("int"))
    return bt if max_lookups is None else bt.where(F.col("lookup_no") <= max_lookups)


def attach_license(corpus: DataFrame, licenses: DataFrame, repo_col: str = "repository") -> DataFrame:
    """License per repository, 'Unknown' when missing. ``licenses`` is one row per
    repository (a dimension table), joined by key."""
    return (corpus.join(licenses.select(repo_col, F.col("license").alias("_lic")), repo_col, "left")
            .withColumn("license", F.coalesce(F.col("_lic"), F.lit("Unknown"))).drop("_lic"))


def hit_block_pairs(hits: DataFrame, corpus_blocks: DataFrame, key_cols, id_col: str = "corpus_id") -> DataFrame:
    """R9 'hits': every query block paired with every block of each corpus file it hit."""
    h = hits.select(*key_cols, "block_id", id_col).dropDuplicates([*key_cols, "block_id", id_col])
    cb = corpus_blocks.select(id_col, F.col("block_id").alias("cblock_id"), F.col("block_rank").alias("cblock_rank"),
                              F.col("name").alias("cname"))
    return h.join(shuffled(cb), id_col)

