"""Registered queries and DuckDB oracles for terms, index, lookup and check_code
(T1-T5, R1, R2, R6, R9, R10, X5, X7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copyhound import config as C
from copyhound.functions import text as T
from copyhound.operators import blocks as B
from copyhound.operators import lookup as L
from copyhound.operators import terms as TM
from copyhound.operators.gram_join import gram_pairs, gram_sets
from copyhound.plans import blocks_q as BQ
from copyhound.plans import code_check as CC
from copyhound.plans import code_views as V
from copyhound.plans.catalog import register
from copyhound.plans.normalization import normalize_sql
from copyhound.session import shuffled


def q(p: str) -> str:
    return p.replace("'", "''")


def ex(c: str, p: str, g: int = 1) -> str:
    return f"regexp_extract_all({c}, '{q(p)}', {g})"


def calls_sql(c: str) -> str:
    o, m = ex(c, TM.CALL, 1), ex(c, TM.CALL, 2)
    return (f"flatten(list_transform(list_filter(list_transform({o}, lambda x, i: [x, {m}[i]]), "
            f"lambda z: length(z[1]) > 2 AND length(z[2]) > 2), lambda z: z))")


def nonempty(x: str) -> str:
    return f"list_filter({x}, lambda t: t <> '')"


def terms_python_sql(c: str) -> str:
    imports = (f"list_filter(list_transform(flatten(list_transform({ex(c, TM.PY_IMPORT, 2)}, "
               f"lambda x: string_split(x, ','))), lambda x: regexp_replace(x, '^{T.WHITE}+|{T.WHITE}+$', '', 'g')), lambda x: x <> '')")
    words = f"flatten(list_transform({ex(c, TM.PY_STRING)}, lambda s: regexp_extract_all(s, '{q(TM.WORD4)}', 0)))"
    assigns = f"list_filter({ex(c, TM.PY_ASSIGN)}, lambda x: length(x) > 2)"
    return (f"list_concat({ex(c, TM.PY_DEF)}, {ex(c, TM.PY_CLASS)}, {nonempty(ex(c, TM.PY_IMPORT, 1))}, {imports}, "
            f"{calls_sql(c)}, {assigns}, {words})")


def terms_js_sql(c: str) -> str:
    return f"list_concat({ex(c, TM.JS_FUNC)}, {ex(c, TM.JS_CLASS)}, {ex(c, TM.JS_ARROW)}, {calls_sql(c)})"


def terms_java_sql(c: str) -> str:
    return f"list_concat({ex(c, TM.JAVA_CLASS)}, {ex(c, TM.JAVA_METHOD)}, {calls_sql(c)})"


def terms_generic_sql(c: str) -> str:
    parts = ", ".join(nonempty(ex(c, p)) for p in C.GENERIC_TERM_PATTERNS)
    return f"list_concat({parts}, {calls_sql(c)})"


def raw_terms_sql(c: str, lang: str) -> str:
    return (f"CASE WHEN {lang} = 'python' THEN {terms_python_sql(c)} "
            f"WHEN {lang} IN ('javascript', 'typescript') THEN {terms_js_sql(c)} "
            f"WHEN {lang} = 'java' THEN {terms_java_sql(c)} ELSE {terms_generic_sql(c)} END")


def candidate_terms_sql(c: str, lang: str) -> str:
    stop = ", ".join(f"'{w}'" for w in C.COMMON_WORDS)
    return f"list_distinct(list_filter({raw_terms_sql(c, lang)}, lambda t: t NOT IN ({stop}) AND length(t) > 2))"


# --- T1-T4: candidate terms of whole files -----------------------------------
for _n, _langs in (("t1_terms_python", ["python"]), ("t2_terms_js", ["javascript"]), ("t3_terms_java", ["java"]),
                   ("t4_terms_generic", ["c", "go"])):
    register(_n, f"SELECT path, unnest({candidate_terms_sql('code', 'language')}) AS term FROM {V.code_files_sql(_langs)} c")(
        (lambda langs: lambda s, d: V.code_files(s, d, langs).select(
            "path", F.explode(TM.candidate_terms("code", "language")).alias("term")))(_langs))


# --- corpus, index ------------------------------------------------------------
def corpus_sql(langs=None) -> str:
    return f"""(SELECT c.path AS corpus_id, concat('repo', c.p_partkey % 120) AS repository, c.path AS file_path,
       concat('https://code.example.org/', concat('repo', c.p_partkey % 120), '/', c.path) AS url,
       c.code AS content, c.language, c.p_partkey AS indexed_at, coalesce(l.license, 'Unknown') AS license
FROM {V.code_files_sql(langs)} c LEFT JOIN
     (SELECT concat('repo', s_suppkey) AS repository, n_name AS license FROM supplier JOIN nation ON s_nationkey = n_nationkey) l
     ON concat('repo', c.p_partkey % 120) = l.repository)"""


def index_sql(langs=None) -> str:
    a, b, c = (f"regexp_extract_all(content, '{p}', 0)" for p in (L.TOKEN, *L.PARTS))
    tok = f"list_distinct(list_concat(list_concat({a}, {b}), {c}))"
    return f"(SELECT unnest({tok}) AS term, language, corpus_id, indexed_at FROM {corpus_sql(langs)} co)"


@register("s3_read_corpus", f"SELECT corpus_id, repository, file_path, url, language, indexed_at, license FROM {corpus_sql()} c")
def q_s3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CC.corpus_files(spark, sf_dir).drop("content")


@register("r6_attach_license", f"SELECT repository, license, CAST(count(*) AS BIGINT) AS n_files FROM {corpus_sql()} c GROUP BY ALL")
def q_r6(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = CC.corpus_files(spark, sf_dir)
    return c.groupBy("repository", "license").agg(F.count(F.lit(1)).cast("long").alias("n_files"))


@register("r1_build_term_index", f"SELECT term, language, CAST(count(*) AS BIGINT) AS df, max(indexed_at) AS newest FROM {index_sql()} i GROUP BY ALL")
def q_r1(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = L.build_term_index(CC.corpus_files(spark, sf_dir))
    return i.groupBy("term", "language").agg(F.count(F.lit(1)).cast("long").alias("df"),
                                             F.max("indexed_at").alias("newest"))


# --- the check_code chain over all five languages, with the budgets of C.REFERENCE_BUDGET ----
LANGS4 = BQ.REGEX_LANGS


def chain_sql(stage: str, langs=LANGS4, k_hits: int = C.HITS_PER_TERM, tk: int = 3, files: str | None = None) -> str:
    """The whole chain up to ``stage``, for the code views as submissions or for ``files`` (path, language, code)."""
    tokens = "regexp_extract_all({x}, '" + q(T.CODE_TOKEN) + "', 0)"
    def grams(x):
        t = tokens.format(x=x)
        return f"list_transform(range(1, len({t}) - {tk - 2}), lambda i: array_to_string({t}[i:i + {tk - 1}], ' '))"
    return f"""
WITH fb AS ({BQ.blocks_sql(langs, files)}),
fbn AS (SELECT *, {normalize_sql('code', 'language')} AS norm FROM fb),
co AS {corpus_sql(langs)},
cb0 AS ({BQ.blocks_sql(langs)}),
cbn AS (SELECT *, {normalize_sql('code', 'language')} AS norm FROM cb0),
ix AS {index_sql(langs)},
dfs AS (SELECT term, language, count(*) AS df FROM ix GROUP BY ALL),
ct AS (SELECT path, block_id, language, unnest({candidate_terms_sql('code', 'language')}) AS term FROM fb),
tr AS (SELECT ct.path, ct.block_id, ct.language, ct.term,
              row_number() OVER (PARTITION BY ct.path, ct.block_id ORDER BY coalesce(d.df, {2 ** 62}), ct.term) AS term_rank
       FROM ct LEFT JOIN dfs d USING (term, language)),
terms AS (SELECT * FROM tr WHERE term_rank <= {C.TERMS_PER_TEXT}),
post AS (SELECT *, row_number() OVER (PARTITION BY term, language ORDER BY indexed_at DESC, corpus_id) AS hit_rank FROM ix),
hj AS (SELECT t.path, t.block_id, t.term, t.term_rank, p.corpus_id, p.hit_rank
       FROM terms t JOIN post p USING (term, language)
       WHERE trim(t.term) <> '' AND p.hit_rank <= {k_hits + 1} AND t.path <> p.corpus_id),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path, block_id, term ORDER BY hit_rank) AS r FROM hj) WHERE r <= {k_hits}),
pairs AS (SELECT DISTINCT h.path, h.block_id, h.corpus_id, c.block_id AS cblock_id, c.block_rank AS cblock_rank, c.name AS cname
          FROM hits h JOIN cbn c ON c.path = h.corpus_id),
lg AS (SELECT path, block_id, g, count(*) AS c1 FROM (SELECT path, block_id, unnest({grams('norm')}) AS g FROM fbn) GROUP BY ALL),
rg AS (SELECT path AS corpus_id, block_id AS cblock_id, g, count(*) AS c2 FROM (SELECT path, block_id, unnest({grams('norm')}) AS g FROM cbn) GROUP BY ALL),
lt AS (SELECT path, block_id, CAST(greatest(len({tokens.format(x='norm')}) - {tk - 1}, 0) AS BIGINT) AS lgr FROM fbn),
rt AS (SELECT path AS corpus_id, block_id AS cblock_id, CAST(greatest(len({tokens.format(x='norm')}) - {tk - 1}, 0) AS BIGINT) AS rgr FROM cbn),
sh AS (SELECT p.path, p.block_id, p.corpus_id, p.cblock_id, sum(least(c1, c2)) AS shared
       FROM pairs p JOIN lg ON lg.path = p.path AND lg.block_id = p.block_id
            JOIN rg ON rg.corpus_id = p.corpus_id AND rg.cblock_id = p.cblock_id AND rg.g = lg.g GROUP BY ALL),
scored AS (SELECT p.*, CASE WHEN lgr + rgr > 0 THEN 2 * coalesce(sh.shared, 0) / (lgr + rgr) ELSE 0.0 END AS similarity
           FROM pairs p LEFT JOIN sh USING (path, block_id, corpus_id, cblock_id) JOIN lt USING (path, block_id) JOIN rt USING (corpus_id, cblock_id)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path, block_id, corpus_id ORDER BY similarity DESC, cblock_rank) AS r FROM scored) WHERE r = 1),
fl AS (SELECT b.*, f.block_rank, f.name AS original_block, f.block_type, co.url, co.repository, co.file_path, co.license
       FROM best b JOIN fb f USING (path, block_id) JOIN co USING (corpus_id) WHERE b.similarity >= {C.CODE_MATCH_FLOOR}),
dd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path, url ORDER BY similarity DESC, block_rank, block_id) AS r2 FROM fl) WHERE r2 = 1),
top AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY similarity DESC, url) AS match_rank FROM dd)
{stage}"""


X7_SELECT = (f"SELECT path, url, repository, file_path, license, similarity, original_block, cname AS matched_block, "
             f"block_type, CAST(match_rank AS INTEGER) AS match_rank FROM top WHERE match_rank <= {C.TOP_CODE_MATCHES}")


def _similar_sql(mine: str, theirs: str, tk: int = 3) -> str:
    """CTEs of all similar texts, counted pair by pair: ``near`` (mine's rows, url, corpus_id, similarity, cname). mine (path,
    language, norm, ...) and theirs (language, norm, corpus_id, url, posting_rank, cname) are names of CTEs before."""
    toks = f"regexp_extract_all(norm, '{q(T.CODE_TOKEN)}', 0)"
    grams = f"list_transform(range(1, len({toks}) - {tk - 2}), lambda i: array_to_string({toks}[i:i + {tk - 1}], ' '))"
    return f"""
tx AS MATERIALIZED (SELECT *, row_number() OVER () AS i FROM (SELECT language, norm FROM {mine} UNION SELECT language, norm FROM {theirs})),
gr AS MATERIALIZED (SELECT language, i, g, count(*) AS c FROM (SELECT language, i, unnest({grams}) AS g FROM tx) GROUP BY ALL),
codes AS (SELECT language, g, row_number() OVER () AS e FROM gr GROUP BY language, g HAVING count(*) > 1),
ge AS MATERIALIZED (SELECT i::INTEGER AS i, e::INTEGER AS e, c::INTEGER AS c FROM gr JOIN codes USING (language, g)),
sizes AS MATERIALIZED (SELECT i, sum(c) AS t FROM gr GROUP BY i),
pr AS (SELECT a.i AS a, b.i AS b, sum(least(a.c, b.c)) AS shared FROM ge a JOIN ge b ON a.e = b.e AND a.i < b.i GROUP BY ALL),
half AS MATERIALIZED (SELECT a, b, 2 * shared / (x.t + y.t) AS similarity FROM pr JOIN sizes x ON x.i = a JOIN sizes y ON y.i = b WHERE 2 * shared / (x.t + y.t) >= {C.CODE_MATCH_FLOOR}),
known AS MATERIALIZED (SELECT i, url, corpus_id, posting_rank, cname, row_number() OVER (PARTITION BY i ORDER BY url) AS u FROM (
  SELECT tx.i, k.*, row_number() OVER (PARTITION BY tx.i, url ORDER BY posting_rank, corpus_id, cname) AS r FROM {theirs} k JOIN tx USING (language, norm)) WHERE r = 1),
most AS (SELECT {C.TOP_CODE_MATCHES + 1} * max(n) AS n FROM (SELECT count(DISTINCT i) AS n FROM known GROUP BY url)),
sim AS (SELECT a, b, similarity FROM half UNION ALL SELECT b, a, similarity FROM half UNION ALL SELECT i, i, 1.0 FROM sizes),
ranked AS (SELECT a, b, similarity, rank() OVER (PARTITION BY a ORDER BY similarity DESC) AS r FROM sim SEMI JOIN known ON known.i = sim.b),
near AS (SELECT m.*, known.url, known.corpus_id, known.posting_rank, known.cname, ranked.similarity
         FROM {mine} m JOIN tx USING (language, norm) JOIN ranked ON ranked.a = tx.i AND ranked.r <= (SELECT n FROM most)
              JOIN known ON known.i = ranked.b AND known.u <= {C.TOP_CODE_MATCHES + 1} WHERE m.path <> known.corpus_id)"""


def gram_chain_sql(stage: str, langs=LANGS4, files: str | None = None) -> str:
    """The chain over all similar blocks up to ``stage``, for the code views as submissions or for ``files`` (path, language, code)."""
    return f"""
WITH fbn AS MATERIALIZED (SELECT path, language, block_id, block_rank, name AS original_block, block_type, {normalize_sql('code', 'language')} AS norm FROM ({BQ.blocks_sql(langs, files)}) b),
co AS MATERIALIZED {corpus_sql(langs)},
cbn AS MATERIALIZED (SELECT b.language, {normalize_sql('b.code', 'b.language')} AS norm, co.corpus_id, co.url, b.block_rank AS posting_rank, b.name AS cname
        FROM ({BQ.blocks_sql(langs)}) b JOIN co ON co.corpus_id = b.path),
{_similar_sql('fbn', 'cbn')},
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path, block_id, url ORDER BY similarity DESC, posting_rank, corpus_id, cname) AS r FROM near) WHERE r = 1),
dd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path, url ORDER BY similarity DESC, block_rank, block_id) AS r2 FROM best) WHERE r2 = 1),
top AS (SELECT d.*, co.repository, co.file_path, co.license, row_number() OVER (PARTITION BY path ORDER BY similarity DESC, d.url) AS match_rank FROM dd d JOIN co USING (corpus_id))
{stage}"""


@register("x7_check_code", gram_chain_sql(X7_SELECT))
def q_x7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best matches of each file among all blocks of the corpus."""
    return CC.code_matches(spark, sf_dir, LANGS4)


@register("x7_reference_budget", chain_sql(X7_SELECT))
def q_x7_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the candidates that the reference's search gives: five terms a block, the three newest files of each."""
    return CC.check_code(CC.submitted_files(spark, sf_dir, LANGS4), CC.corpus_files(spark, sf_dir, LANGS4), C.REFERENCE_BUDGET)


GRAM_PAIRS_FLOOR = 90


@register("r9_gram_pairs", f"""
WITH fbn AS (SELECT DISTINCT path, language, {normalize_sql('code', 'language')} AS norm FROM ({BQ.blocks_sql(LANGS4)}) b),
none AS (SELECT language, norm, path AS corpus_id, path AS url, 0 AS posting_rank, '' AS cname FROM fbn WHERE false),
{_similar_sql('fbn', 'none')}
SELECT x.language, sha256(x.norm) AS text_a, sha256(y.norm) AS text_b, h.similarity
FROM (SELECT a, b, similarity FROM half UNION ALL SELECT b, a, similarity FROM half) h JOIN tx x ON x.i = h.a JOIN tx y ON y.i = h.b WHERE h.similarity >= {GRAM_PAIRS_FLOOR / 100} AND x.norm < y.norm""")
def q_r9_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R9 `grams`: every pair of different normalized blocks of a language that are at least 90 % similar; r9_gram_members lists
    the blocks of each text."""
    texts = block_texts(spark, sf_dir).select("language", "norm").distinct()
    texts = CC.kept(texts.select(F.col("language").alias("scope"), F.sha2("norm", 256).alias("id"), "norm"), "texts")
    names, elements, sets = gram_sets(texts, 3, keep=CC.kept)
    names = names.join(shuffled(texts), ["scope", "id"])
    name = lambda c: names.select(F.col("i").alias(c), F.col("scope").alias("language"), F.col("id").alias(f"text_{c}"), F.col("norm").alias(f"{c}_norm"))
    pairs = gram_pairs(elements, sets, GRAM_PAIRS_FLOOR).where("a < b").join(shuffled(name("a")), "a").join(shuffled(name("b").drop("language")), "b")
    swap = F.col("a_norm") < F.col("b_norm")
    pair = lambda x, y: F.when(swap, F.col(x)).otherwise(F.col(y))
    return pairs.select("language", pair("text_a", "text_b").alias("text_a"), pair("text_b", "text_a").alias("text_b"), "similarity")


@register("r9_gram_members", f"SELECT path, language, CAST(block_id AS INTEGER) AS block_id, sha256({normalize_sql('code', 'language')}) AS text FROM ({BQ.blocks_sql(LANGS4)}) b")
def q_r9_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_texts(spark, sf_dir).select("path", "language", "block_id", F.sha2("norm", 256).alias("text"))


def block_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = B.block_rows(CC.submitted_files(spark, sf_dir, LANGS4), ["path"])
    return blocks.select("path", "language", "block_id", T.normalize("code", "language").alias("norm"))


@register("t5_select_terms", chain_sql("SELECT path, CAST(block_id AS INTEGER) AS block_id, term, CAST(term_rank AS INTEGER) AS term_rank FROM terms"))
def q_t5(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = CC.submitted_files(spark, sf_dir, LANGS4)
    fb = B.block_rows(f, ["path"])
    dfs = L.term_df(L.build_term_index(CC.corpus_files(spark, sf_dir, LANGS4)))
    return TM.select_terms(fb, ["path", "block_id"], "code", "language", dfs, C.TERMS_PER_TEXT).select("path", "block_id", "term", "term_rank")


@register("r2_lookup_terms", chain_sql("SELECT path, CAST(block_id AS INTEGER) AS block_id, term, corpus_id, CAST(hit_rank AS INTEGER) AS hit_rank FROM hits"))
def q_r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = CC.submitted_files(spark, sf_dir, LANGS4)
    fb = B.block_rows(f, ["path"])
    index = L.build_term_index(CC.corpus_files(spark, sf_dir, LANGS4))
    terms = TM.select_terms(fb, ["path", "block_id"], "code", "language", L.term_df(index), C.TERMS_PER_TEXT)
    hits = L.lookup_terms(terms.join(shuffled(f.select("path", "self_id")), "path"), index, ["path", "block_id"],
                          C.HITS_PER_TERM, self_col="self_id")
    return hits.select("path", "block_id", "term", "corpus_id", "hit_rank")


@register("r9_candidate_pairs", chain_sql("SELECT path, CAST(block_id AS INTEGER) AS block_id, corpus_id, CAST(cblock_id AS INTEGER) AS cblock_id FROM pairs"))
def q_r9(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = CC.submitted_files(spark, sf_dir, LANGS4)
    corpus = CC.corpus_files(spark, sf_dir, LANGS4)
    fb = B.block_rows(f, ["path"])
    cb = B.block_rows(corpus.select("corpus_id", F.col("content").alias("code"), "language"), ["corpus_id"])
    index = L.build_term_index(corpus)
    terms = TM.select_terms(fb, ["path", "block_id"], "code", "language", L.term_df(index), C.TERMS_PER_TEXT)
    hits = L.lookup_terms(terms.join(shuffled(f.select("path", "self_id")), "path"), index, ["path", "block_id"],
                          C.HITS_PER_TERM, self_col="self_id")
    return L.hit_block_pairs(hits, cb, ["path", "block_id"]).select("path", "block_id", "corpus_id", "cblock_id")


@register("r10_search_budget", f"""
WITH fb AS ({BQ.blocks_sql(LANGS4)}),
ct AS (SELECT path, block_id, block_rank, unnest({candidate_terms_sql('code', 'language')}) AS term FROM fb WHERE block_rank <= {C.MAX_BLOCKS_PER_FILE}),
tr AS (SELECT *, row_number() OVER (PARTITION BY path, block_id ORDER BY term) AS term_rank FROM ct),
bt AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY block_rank, term_rank) AS lookup_no FROM tr WHERE term_rank <= {C.MAX_TERMS_PER_BLOCK})
SELECT path, CAST(block_id AS INTEGER) AS block_id, term, CAST(lookup_no AS INTEGER) AS lookup_no FROM bt WHERE lookup_no <= {C.MAX_LOOKUPS_PER_FILE}""")
def q_r10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference budget: 5 blocks, 2 terms per block, 4 lookups per file."""
    fb = B.block_rows(CC.submitted_files(spark, sf_dir, LANGS4), ["path"])
    terms = TM.select_terms(fb, ["path", "block_id"], "code", "language", None, n=None)
    return L.search_budget(fb, terms, ["path"]).select("path", "block_id", "term", "lookup_no")


@register("x5_best_block_match", chain_sql("SELECT path, CAST(block_id AS INTEGER) AS block_id, corpus_id, cname AS matched_block, similarity FROM best"))
def q_x5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CC.best_matches(spark, sf_dir, LANGS4)


# --- R2 for phrases -------------------------------------------------------------
@register("r2_lookup_phrases", f"""
WITH t AS (SELECT DISTINCT language, trim(regexp_replace(term, '{T.WHITE}+', ' ', 'g')) AS phrase
           FROM (SELECT language, unnest({candidate_terms_sql('code', 'language')}) AS term FROM {V.code_files_sql()} c) x WHERE regexp_matches(term, '{T.WHITE}')),
co AS (SELECT corpus_id, language, regexp_replace(content, '{T.WHITE}+', ' ', 'g') AS flat FROM {corpus_sql()} c)
SELECT language, phrase, CAST(count(*) AS BIGINT) AS n_files, min(corpus_id) AS first_file FROM t JOIN co USING (language) WHERE contains(flat, phrase) GROUP BY ALL""")
def q_r2_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Import terms that span several words, found as phrases: each distinct phrase with the files that hold it."""
    files = V.code_files(spark, sf_dir)
    corpus = CC.corpus_files(spark, sf_dir)
    terms = files.select("language", F.explode(TM.candidate_terms("code", "language")).alias("term")).distinct()
    hits = L.lookup_phrases(terms, L.build_term_index(corpus), corpus, []).distinct()
    return hits.groupBy("language", "phrase").agg(F.count(F.lit(1)).cast("long").alias("n_files"), F.min("corpus_id").alias("first_file"))


# --- X6: whole files --------------------------------------------------------------
def files_sql(files: str | None = None) -> str:
    """Whole-file matches of the code views, or of ``files`` (path, language, code), with the code views."""
    from copyhound.plans.blocks_q import strip_sql
    keep = " OR ".join(f"starts_with({strip_sql('l')}, '{p}')" for p in C.FALLBACK_SKIP_PREFIXES)
    body = lambda x: f"array_to_string(list_filter(string_split({x}, chr(10)), lambda l: {strip_sql('l')} <> '' AND NOT ({keep})), chr(10))"
    toks = lambda x: f"regexp_extract_all({x}, '{q(T.CODE_TOKEN)}', 0)"
    grams = lambda x: f"list_transform(range(1, len({toks(x)}) - 1), lambda i: array_to_string({toks(x)}[i:i + 2], ' '))"
    k = C.HITS_PER_TERM_FALLBACK
    return f"""
WITH f0 AS (SELECT path, language, {body('code')} AS code FROM (SELECT path, language, code FROM {V.code_files_sql()} v{f" UNION ALL SELECT path, language, code FROM {files} x" if files else ""}) c),
asked AS (SELECT path FROM {files or V.code_files_sql()} y),
f AS (SELECT *, {normalize_sql('code', 'language')} AS norm FROM f0),
ix AS {index_sql()}, dfs AS (SELECT term, language, count(*) AS df FROM ix GROUP BY ALL),
ct AS (SELECT path, language, unnest({candidate_terms_sql('code', 'language')}) AS term FROM f0 SEMI JOIN asked USING (path)),
tr AS (SELECT ct.*, row_number() OVER (PARTITION BY path ORDER BY coalesce(df, {2 ** 62}), term) AS r FROM ct LEFT JOIN dfs USING (term, language)),
post AS (SELECT *, row_number() OVER (PARTITION BY term, language ORDER BY indexed_at DESC, corpus_id) AS hit_rank FROM ix),
hj AS (SELECT tr.path, tr.term, post.corpus_id, post.hit_rank FROM tr JOIN post USING (term, language)
       WHERE r <= {C.TERMS_PER_TEXT} AND trim(tr.term) <> '' AND post.hit_rank <= {k + 1} AND tr.path <> post.corpus_id),
pairs AS (SELECT DISTINCT path, corpus_id FROM (SELECT *, row_number() OVER (PARTITION BY path, term ORDER BY hit_rank) AS n FROM hj) WHERE n <= {k}),
g AS (SELECT path, g, count(*) AS c FROM (SELECT path, unnest({grams('norm')}) AS g FROM f) GROUP BY ALL),
t AS (SELECT path, greatest(len({toks('norm')}) - 2, 0) AS n FROM f),
sh AS (SELECT p.path, p.corpus_id, sum(least(a.c, b.c)) AS s FROM pairs p JOIN g a ON a.path = p.path JOIN g b ON b.path = p.corpus_id AND b.g = a.g GROUP BY ALL),
sc AS (SELECT p.*, CASE WHEN x.n + y.n > 0 THEN 2 * coalesce(s, 0) / (x.n + y.n) ELSE 0.0 END AS similarity
       FROM pairs p JOIN t x ON x.path = p.path JOIN t y ON y.path = p.corpus_id LEFT JOIN sh ON sh.path = p.path AND sh.corpus_id = p.corpus_id),
fl AS (SELECT sc.*, url, repository, license FROM sc JOIN {corpus_sql()} co USING (corpus_id) WHERE similarity >= {C.CODE_MATCH_FLOOR}),
dd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path, url ORDER BY similarity DESC, corpus_id) AS u FROM fl) WHERE u = 1)
SELECT path, url, repository, license, similarity, CAST(match_rank AS INTEGER) AS match_rank
FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY similarity DESC, url) AS match_rank FROM dd) WHERE match_rank <= {C.TOP_CODE_MATCHES}"""


def gram_files_sql(files: str | None = None) -> str:
    """Whole-file matches among all files of the corpus."""
    from copyhound.plans.blocks_q import strip_sql
    keep = " OR ".join(f"starts_with({strip_sql('l')}, '{p}')" for p in C.FALLBACK_SKIP_PREFIXES)
    body = lambda x: f"array_to_string(list_filter(string_split({x}, chr(10)), lambda l: {strip_sql('l')} <> '' AND NOT ({keep})), chr(10))"
    return f"""
WITH fm AS MATERIALIZED (SELECT path, language, {normalize_sql('code', 'language')} AS norm FROM (SELECT path, language, {body('code')} AS code FROM {files or V.code_files_sql()} x)),
co AS MATERIALIZED {corpus_sql()},
ck AS MATERIALIZED (SELECT language, {normalize_sql('code', 'language')} AS norm, corpus_id, url, 0 AS posting_rank, '' AS cname
       FROM (SELECT language, {body('content')} AS code, corpus_id, url FROM co)),
{_similar_sql('fm', 'ck')},
dd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path, url ORDER BY similarity DESC, corpus_id) AS r2 FROM near) WHERE r2 = 1)
SELECT path, url, repository, license, similarity, CAST(match_rank AS INTEGER) AS match_rank
FROM (SELECT d.path, d.url, d.similarity, co.repository, co.license, row_number() OVER (PARTITION BY path ORDER BY similarity DESC, d.url) AS match_rank FROM dd d JOIN co USING (corpus_id))
WHERE match_rank <= {C.TOP_CODE_MATCHES}"""


@register("x6_whole_file_match", gram_files_sql())
def q_x6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CC.check_files(CC.submitted_files(spark, sf_dir), CC.corpus_files(spark, sf_dir))


@register("x6_reference_budget", files_sql())
def q_x6_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CC.check_files(CC.submitted_files(spark, sf_dir), CC.corpus_files(spark, sf_dir), C.FALLBACK_BUDGET)
