"""Secret scans in DataFrame functions: three base patterns, and a randomness test battery for everything else.

A candidate is a run of 20 or more characters of the usual encodings. Its encoding is inferred (hex, base32, else
base64), and three tests ask whether it could be uniform over that alphabet: chi-squared over classes of the alphabet,
a runs test about the middle of the alphabet, and lag-1 serial correlation of the symbols' values. Fisher's method
combines them; a candidate that they reject is ordinary text. The others are discoveries only under false-discovery
control: under ordinary text (one case nearly throughout, or nearly only digits and signs) a string of n characters
has a mix of character classes as far off as its own with probability at most exp(-n * divergence), so the p-value
falls with the length. Random base32 is mostly capitals as capital text is, so its bound comes from the letters:
capital text is as unlike English letter frequencies as s with probability at most its likelihood ratio to uniform.
Benjamini-Hochberg at level ALPHA over the different candidates of the corpus in a length class gives the cut. What reaches the driver for it is one number for each class.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from copyhound.functions import text as T
from copyhound.llm.shared import documents

ALPHA = 0.001
RANDOM_P = 0.001
BINS_PER_DECADE = 4
MOST_BINS = 400
#: The kinds in the order that breaks ties of start.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Stands for a candidate's character that a base span holds.
_TAKEN = "\x01"
#: The alphabets in order of their digits.
_HEX, _BASE32, _BASE64 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
#: Letters A to Z in a thousand letters of English text.
_ENGLISH = (82, 15, 28, 43, 127, 22, 20, 61, 70, 1.5, 7.7, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 9.8, 24, 1.5, 20, 0.7)
_SPAN = "array<struct<start:int,rank:int,stop:int>>"


def _let(value: Column, use) -> Column:
    return F.element_at(F.transform(F.array(value), use), 1)


def found(text: Column, pattern: str) -> Column:
    """array<struct<start, stop, m>> of the leftmost non-overlapping matches, in code points, end exclusive.

    The pieces between the matches and the matches themselves alternate, so a match ends where the pieces and matches
    up to it end."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(h: Column) -> Column:
        sizes = F.zip_with(F.slice(gaps, F.lit(1), F.size(h)), h, lambda g, m: F.char_length(g) + F.char_length(m))
        return F.zip_with(h, T.running(sizes, lambda a, x: a + x, 0), lambda m, end: F.struct(
            (end - F.char_length(m)).cast("int").alias("start"), end.cast("int").alias("stop"), m.alias("m")))

    none = F.array().cast("array<struct<start:int,stop:int,m:string>>")
    return F.when(F.regexp_like(text, F.lit(pattern)), _let(hits, placed)).otherwise(none)


def _spans(matches: Column, rank: int) -> Column:
    return F.transform(matches, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["stop"].alias("stop")))


def _assigned(match: Column) -> Column:
    return F.char_length(F.regexp_extract(match, ASSIGN, 2)) >= 6


def base_spans(text: Column) -> list[Column]:
    """The spans of assign, access and hex."""
    assign = F.filter(found(text, ASSIGN), lambda x: _assigned(x["m"]))
    return [_spans(assign, 0), _spans(found(text, ACCESS), 1), _spans(found(text, HEX), 2)]


def _two_sided(z: Column) -> Column:
    """2 * (1 - Phi(|z|)) by a rational approximation of the error function (absolute error below 2e-7)."""
    x = F.abs(z) / F.lit(2 ** 0.5)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.greatest(poly * F.exp(-x * x), F.lit(1e-300))


def _share(s: Column, class_: str) -> Column:
    return F.char_length(F.regexp_replace(s, f"[^{class_}]", "")).cast("double")


def _chi_squared(s: Column, n: Column, classes: list[tuple[str, float]]) -> Column:
    """p-value of observed class counts against their shares; two classes have 1 degree of freedom, three have 2."""
    out = F.lit(0.0)
    for class_, share in classes:
        out = out + F.pow(_share(s, class_) - n * share, 2) / (n * share)
    return _let(out, lambda x: _two_sided(F.sqrt(x)) if len(classes) == 2 else F.greatest(F.exp(-x / 2), F.lit(1e-300)))


def _sequence_tests(values: Column, n: Column, middle: Column) -> Column:
    """Fisher's sum (-2 ln p) of the runs test and the lag-1 serial correlation of the symbols' values."""
    low = F.size(F.filter(values, lambda v: v < middle)).cast("double")
    ahead = F.slice(values, F.lit(2), F.size(values) - 1)
    behind = F.slice(values, F.lit(1), F.size(values) - 1)
    runs = 1 + F.size(F.filter(F.zip_with(behind, ahead, lambda a, b: (a < middle) != (b < middle)), lambda x: x)).cast("double")
    mean = F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / n

    def of_runs(m: Column) -> Column:
        expected = 1 + 2 * m * (n - m) / n
        spread = (expected - 1) * (expected - 2) / (n - 1)
        return F.when((m == 0) | (m == n) | (spread <= 0), F.lit(1e-300)).otherwise(_two_sided((runs - expected) / F.sqrt(spread)))

    def of_order(m: Column) -> Column:
        spread = F.aggregate(values, F.lit(0.0), lambda a, v: a + (v - m) * (v - m))
        joint = F.aggregate(F.zip_with(behind, ahead, lambda a, b: (a - m) * (b - m)), F.lit(0.0), lambda a, v: a + v)
        return F.when(spread <= 0, F.lit(1e-300)).otherwise(_two_sided((joint / spread + 1 / n) * F.sqrt(n)))

    return -2 * F.log(_let(low, of_runs)) - 2 * F.log(_let(mean, of_order))


def random_p(s: Column) -> Column:
    """The combined p-value of the battery: small when s can't be uniform over the alphabet of its inferred encoding."""
    n = F.char_length(s).cast("double")
    values = lambda alphabet, x: F.transform(F.split(x, ""), lambda c: (F.instr(F.lit(alphabet), c) - 1).cast("double"))
    third = lambda p_chi, sums: _let(-2 * F.log(p_chi) + sums, lambda x: F.exp(-x / 2) * (1 + x / 2 + x * x / 8))
    plain = F.regexp_replace(F.translate(s, "-_", "+/"), "=", "")
    is_hex = s.rlike("^([0-9a-f]+|[0-9A-F]+)$")
    hex_ = third(_chi_squared(F.lower(s), n, [("0-4", 5 / 16), ("5-9", 5 / 16), ("a-f", 6 / 16)]), _let(values(_HEX, F.lower(s)), lambda v: _sequence_tests(v, n, F.lit(8))))
    base32 = third(_chi_squared(s, n, [("A-M", 13 / 32), ("N-Z", 13 / 32), ("2-7", 6 / 32)]), _let(values(_BASE32, s), lambda v: _sequence_tests(v, n, F.lit(16))))
    base64 = third(_chi_squared(plain, n, [("A-Z", 26 / 64), ("a-z", 26 / 64), ("0-9+/", 12 / 64)]), _let(values(_BASE64, plain), lambda v: _sequence_tests(v, n, F.lit(32))))
    return F.when(is_hex, hex_).when(s.rlike("^[A-Z2-7]+$"), base32).otherwise(base64)


def _base32_gap(s: Column) -> Column:
    """ln of the likelihood ratio of uniform base32 to capital text: English letters, of which one in 50 is followed by
    a number, whose digits go on in 7 of 10 cases. A run of one character counts once."""
    once = F.regexp_replace(s, r"(.)\1+", "$1")
    gain = F.array(*[F.lit(math.log(sum(_ENGLISH) / 26 / x)) for x in _ENGLISH])
    letters = F.aggregate(F.split(F.regexp_replace(once, "[2-7]", ""), ""), F.lit(0.0), lambda a, c: a + F.coalesce(F.get(gain, F.ascii(c) - 65), F.lit(0.0)))
    digits, numbers = _share(once, "2-7"), F.size(F.regexp_extract_all(once, F.lit("[2-7]+"), F.lit(0)))
    ended = numbers - F.when(once.rlike("[2-7]$"), 1).otherwise(0)
    begun, on, back, plain = (math.log(x) for x in (6 / 32 / 0.02, 6 / 32 / 0.7, 26 / 32 / 0.3, 26 / 32 / 0.98))
    return letters + begun * numbers + on * (digits - numbers) + back * ended + plain * (F.char_length(once) - digits - ended)


def text_bin(s: Column) -> Column:
    """-log10 of the bound on the p-value under ordinary text, in BINS_PER_DECADE bins a decade."""
    n = F.char_length(s).cast("double")
    shares = [_share(s, c) / n for c in ("a-z", "A-Z", "0-9+/_=-")]
    gap = lambda usual: sum((F.when(x > 0, x * F.log(x / u)).otherwise(0.0) for x, u in zip(shares, usual)), F.lit(0.0))
    least = F.least(gap((0.90, 0.05, 0.05)), gap((0.05, 0.90, 0.05)), gap((0.05, 0.05, 0.90)))
    is_base32 = s.rlike("^[A-Z2-7]+$") & ~s.rlike("^[0-9A-F]+$")
    far = F.when(is_base32, F.greatest(_base32_gap(s), F.lit(0.0))).otherwise(n * least)
    return F.least(F.lit(MOST_BINS), F.floor(far / F.lit(2.302585092994046) * BINS_PER_DECADE)).cast("int")


def length_class(s: Column) -> Column:
    n = F.char_length(s)
    return F.when(n < 24, 0).when(n < 32, 1).when(n < 48, 2).when(n < 80, 3).otherwise(4)


def discovery_bins(docs: DataFrame, alpha: float = ALPHA) -> dict[int, int]:
    """The least bin that Benjamini-Hochberg accepts in each length class, over all different candidates of docs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    one = docs.select(F.explode(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))).alias("s"))
    one = one.select(F.xxhash64("s").alias("h"), length_class(F.col("s")).alias("class"), text_bin(F.col("s")).alias("bin")).distinct()
    bins = one.groupBy("class", "bin").agg(F.count("*").alias("n"))
    above = W.partitionBy("class").orderBy(F.col("bin").desc()).rowsBetween(W.unboundedPreceding, 0)
    bins = bins.withColumn("found", F.sum("n").over(above)).withColumn("all", F.sum("n").over(W.partitionBy("class")))
    passing = bins.where(F.pow(F.lit(10.0), -F.col("bin") / BINS_PER_DECADE) <= alpha * F.col("found") / F.col("all"))
    return {r["class"]: r["bin"] for r in passing.groupBy("class").agg(F.min("bin").alias("bin")).collect()}


def scanned(docs: DataFrame, alpha: float = ALPHA, base: str = "scan_base", spans: str = "scan_spans") -> DataFrame:
    """docs with two columns, `base` and `spans` by name: sorted arrays of (start, rank of the kind, stop) in code points.

    Null text counts as empty: no spans. An added span never overlaps a base span. Other columns stay as they are, but
    for those named so, which are replaced."""
    cuts = discovery_bins(docs, alpha)
    text = F.coalesce(F.col("text"), F.lit(""))
    bases = F.sort_array(F.concat(*base_spans(text)))
    limit = lambda s: F.coalesce(*[F.when(length_class(s) == c, F.lit(b)) for c, b in sorted(cuts.items())], F.lit(MOST_BINS + 1))
    out = docs.withColumn(base, bases)
    every = found(text, CANDIDATE)
    free = F.when((F.size(base) > 0) & F.regexp_like(text, F.lit(CANDIDATE)), _let(every, lambda c: _free(text, c))).otherwise(every)
    more = F.filter(free, lambda x: (text_bin(x["m"]) >= limit(x["m"])) & (random_p(x["m"]) >= RANDOM_P))
    return out.withColumn(spans, F.sort_array(F.concat(base, _spans(more, 3))))


def _free(text: Column, candidates: Column) -> Column:
    """The candidates that no base span overlaps, in one pass over the text for each kind: with a span's characters marked in
    place, the runs stay where they are, and a run that holds a mark is taken."""
    clean = F.translate(text, _TAKEN, " ")
    runs = CANDIDATE.replace("[", f"[{_TAKEN}", 1)

    def marked(t: Column, pattern: str, counts) -> Column:
        gaps = F.split(t, pattern, -1)
        hits = F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda m: F.when(counts(m), F.translate(m, _LETTERS, _TAKEN * len(_LETTERS))).otherwise(m))
        whole = _let(gaps, lambda g: _let(hits, lambda h: F.concat(
            F.array_join(F.zip_with(F.slice(g, F.lit(1), F.size(h)), h, lambda a, b: F.concat(a, b)), ""), F.element_at(g, -1))))
        found_in = _let(whole, lambda w: F.transform(F.regexp_extract_all(w, F.lit(runs), F.lit(0)), lambda r: F.contains(r, F.lit(_TAKEN))))
        return F.when(F.regexp_like(t, F.lit(pattern)), found_in)  # null: nothing is taken

    every = lambda m: F.lit(True)
    taken = _let(clean, lambda t: F.array(marked(t, ASSIGN, _assigned), marked(t, ACCESS, every), marked(t, HEX, every)))
    return _let(taken, lambda k: F.filter(candidates, lambda x, i: ~F.exists(k, lambda flags: F.coalesce(F.get(flags, i), F.lit(False)))))


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kind = lambda x: F.element_at(F.array(*map(F.lit, KINDS)), x["rank"] + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", kind(x), x["start"].cast("string"), x["stop"].cast("string"))), ",")


def redacted(docs: DataFrame, mark: str = "[SECRET]", alpha: float = ALPHA) -> DataFrame:
    """docs with every span of its text replaced by a mark (overlapping spans by one); n_chars, if there, is counted anew
    for texts that change."""
    spans = "scan_spans"
    while {spans, f"{spans}_base", f"{spans}_text"} & set(docs.columns):
        spans = f"_{spans}"
    found_in = scanned(docs, alpha, f"{spans}_base", spans)
    text = F.col("text")
    size = 1 << 12  # the text in pieces, so that taking out a part doesn't count through all before it
    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))

    def part(c: Column, begin: Column, end: Column) -> Column:
        first = F.floor(begin / size).cast("int")
        near = F.array_join(F.slice(c, first + 1, F.floor(end / size).cast("int") - first + 1), "")
        return F.substr(near, (begin - first * size + 1).cast("int"), (end - begin).cast("int"))

    def masked(c: Column, x: Column) -> Column:
        before = lambda reach, i: F.when(i == 0, F.lit(0)).otherwise(F.get(reach, i - 1))  # noqa: E731  where the spans before end
        reach = T.running(F.transform(x, lambda s: s["stop"]), F.greatest, 0)
        return _let(reach, lambda e: F.concat(
            F.array_join(F.transform(x, lambda s, i: F.when(s["start"] >= before(e, i), F.concat(part(c, before(e, i), s["start"]), F.lit(mark))).otherwise("")), ""),
            part(c, F.element_at(e, -1), F.char_length(text))))

    clean = f"{spans}_text"  # under a name of its own: inside a lambda, `text` could mean a new column of that name
    found_in = found_in.withColumn(clean, F.when(F.size(spans) > 0, _let(chunks, lambda c: _let(F.col(spans), lambda x: masked(c, x)))).otherwise(text))
    counted = F.when(F.size(spans) > 0, F.char_length(clean).cast("long")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None
    return found_in.select(*[F.col(clean).alias(c) if c == "text" else counted.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = scanned(documents(spark, sf_dir).select("doc_id", "text")).drop("text")
    count = lambda rank: F.size(F.filter("scan_base", lambda x: x["rank"] == rank)).cast("long")
    return spans.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                        F.sha2(span_text(F.col("scan_base")), 256).alias("base_sha256"), span_text(F.col("scan_spans")).alias("spans"))
