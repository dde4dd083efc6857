"""Secret scan: fixed patterns, and a randomness battery for the tokens no pattern names.

Tokens of 20 or more characters with a letter and a digit get an encoding from their symbols
(hexadecimal, base 32, 62, 64 and its URL form). Under the hypothesis that a token's symbols
are uniform over its alphabet, three tests give p-values: chi-squared of the symbol counts,
the number of runs above and below the alphabet's middle, and lag-one serial correlation;
three times the least is the token's p-value. Ordinary names and paths fail at once, as their
letters are not uniform. Tokens that pass are reported as kind ``random``.

What counts as failing is a false-discovery decision over the whole table: in every stratum of
encoding and length the Benjamini-Hochberg rule dismisses tokens such that at most ``alpha``
of the dismissed are expected to be truly random. Its p-values are rounded up to tenths of a
decade, so the rule works on a count table of fixed size.

Everything is DataFrame operations: a pattern's matches and the text between them come as
arrays, and running sums of their lengths give the places.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import likely, row_key, written

ALPHA = 0.05
#: Pattern, a cheap test that every match passes, and the least length of group 2 or the match.
BASE = {
    "assign": (r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
               r"(?i:passw|secret|token|api_?key)", 8),
    "access": (r"AKIA[A-Z0-9]+", r"AKIA", 16),
    "hex": (r"[0-9a-f]{32,}", r"[0-9a-f]{32}", 32),
}
# One or two signs of padding belong to a token unless more of it, or a value, follows.
RANDOM = (r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+(?:={1,2}(?![A-Za-z0-9+/_=-]))?", r"[A-Za-z0-9+/_-]{20}", 20)
KINDS = [*BASE, "random"]
_DIGITS, _UPPER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = _UPPER.lower()
#: Encodings by precedence: name, what a token looks like, alphabet.
ENCODINGS = [
    ("hex", "^[0-9a-f]+$", _DIGITS + "abcdef"), ("hex_upper", "^[0-9A-F]+$", _DIGITS + "ABCDEF"),
    ("base32", "^[A-Z2-7]+$", _UPPER + "234567"), ("base62", "^[0-9A-Za-z]+$", _UPPER + _LOWER + _DIGITS),
    ("base64url", "^[0-9A-Za-z_-]+$", _UPPER + _LOWER + _DIGITS + "-_"),
    ("base64", "", _UPPER + _LOWER + _DIGITS + "+/"),
]


def _matches(text: Column, kind: str) -> Column:
    """Array of (kind, gap before the match, match) over one text; null where there is none."""
    pattern, test, _ = BASE.get(kind, RANDOM)
    pairs = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1),
                       lambda m, gap: F.struct(F.char_length(gap).alias("gap"), m.alias("match")))
    return F.when(text.rlike(test), F.filter(pairs, lambda p: p["match"].isNotNull()))


def _places(keyed: DataFrame) -> DataFrame:
    """``doc_key, kind, start, stop, match`` of each pattern match, failing ones included."""
    found = keyed.select("doc_key", F.explode(F.array(*[
        F.struct(F.lit(k).alias("kind"), _matches(F.col("text"), k).alias("m")) for k in KINDS])).alias("x"))
    rows = found.where("size(x.m) > 0").select(
        "doc_key", "x.kind", F.posexplode("x.m").alias("nth", "m")).select(
        "doc_key", "kind", "nth", "m.gap", "m.match").distinct()
    upto = Window.partitionBy("doc_key", "kind").orderBy("nth")
    stop = F.sum(F.col("gap") + F.char_length("match")).over(upto)
    return rows.select("doc_key", "kind", (stop - F.char_length("match")).alias("start"),
                       stop.alias("stop"), "match")


def _passes() -> Column:
    """Length rules of the fixed patterns."""
    value = F.regexp_extract("match", BASE["assign"][0], 2)
    return F.when(F.col("kind") == "assign", F.char_length(value) >= BASE["assign"][2]).otherwise(
        F.char_length("match") >= F.when(F.col("kind") == "access", BASE["access"][2]).otherwise(BASE["hex"][2]))


def _upper_tail(z: Column) -> Column:
    """Chance that a standard normal value exceeds z (rational approximation of erfc)."""
    x = F.abs(z) / 2 ** 0.5
    t = 1 / (1 + 0.3275911 * x)
    poly = reduce(lambda acc, c: acc * t + c, (1.061405429, -1.453152027, 1.421413741, -0.284496736, 0.254829592))
    tail = poly * t * F.exp(-x * x) / 2
    return F.greatest(F.lit(1e-30), F.when(z >= 0, tail).otherwise(1 - tail))


def battery(tokens: DataFrame, token: str) -> DataFrame:
    """``tokens`` with ``encoding, length, p_chi, p_runs, p_serial, p``; ``token`` names the column.

    Tokens without a letter or without a digit have no encoding and a null p.
    """
    body = F.regexp_replace(token, "=+$", "")
    kind = F.lit(None).cast("string")
    for name, looks, _ in reversed(ENCODINGS):
        kind = F.lit(name) if not looks else F.when(body.rlike(looks), name).otherwise(kind)
    kind = F.when(body.rlike("[0-9]") & body.rlike("[A-Za-z]"), kind)
    chars = F.filter(F.split(body, ""), lambda c: c != "")
    alphabets = F.create_map(*[F.lit(x) for name, _, a in ENCODINGS for x in (name, a)])
    df = tokens.withColumn("encoding", kind).withColumn("chars_", chars).withColumn(
        "alphabet_", alphabets[F.col("encoding")])
    df = df.withColumn("length", F.size("chars_")).withColumn("k_", F.char_length("alphabet_")).withColumn(
        "v_", F.expr("transform(chars_, c -> cast(instr(alphabet_, c) - 1 as double))"))
    n, k = F.col("length"), F.col("k_")
    squares = F.expr("aggregate(array_distinct(chars_), 0D, (s, c) -> s + pow(size(filter(chars_, x -> x = c)), 2))")
    chi = (squares * k / n - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
    df = df.withColumn("p_chi", _upper_tail(chi)).withColumn(
        "high_", F.expr("transform(v_, v -> cast(v >= k_ / 2 as int))"))
    n1 = F.expr("cast(aggregate(high_, 0, (s, x) -> s + x) as double)")
    df = df.withColumn("n1_", n1).withColumn("n2_", n - F.col("n1_")).withColumn("runs_", 1 + F.expr(
        "aggregate(zip_with(slice(high_, 1, length - 1), slice(high_, 2, length - 1), (a, b) -> int(a <> b)), 0, "
        "(s, x) -> s + x)"))
    twice = 2 * F.col("n1_") * F.col("n2_")
    spread = twice * (twice - n) / (n * n * (n - 1))
    z_runs = (F.col("runs_") - 1 - twice / n) / F.sqrt(spread)
    df = df.withColumn("p_runs", F.when(spread > 0, F.least(F.lit(1.0), 2 * _upper_tail(F.abs(z_runs)))).otherwise(1.0))
    df = df.withColumn("mean_", F.expr("aggregate(v_, 0D, (s, x) -> s + x) / length"))
    power = F.expr("aggregate(v_, 0D, (s, x) -> s + (x - mean_) * (x - mean_))")
    cross = F.expr("aggregate(zip_with(slice(v_, 1, length - 1), slice(v_, 2, length - 1), "
                   "(a, b) -> (a - mean_) * (b - mean_)), 0D, (s, x) -> s + x)")
    df = df.withColumn("power_", power).withColumn("cross_", cross)
    z_serial = (F.col("cross_") / F.col("power_") + 1 / n) * F.sqrt(n)
    df = df.withColumn("p_serial", F.when(F.col("power_") > 0, F.least(
        F.lit(1.0), 2 * _upper_tail(F.abs(z_serial)))).otherwise(1.0))
    p = F.least(F.lit(1.0), 3 * F.least("p_chi", "p_runs", "p_serial"))
    return df.withColumn("p", F.when(F.col("encoding").isNotNull(), p)).drop(
        *[c for c in df.columns if c.endswith("_") and c not in tokens.columns])


def dismissed(tested: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Tokens with a column ``structured``: true where the false-discovery rule of the token's
    encoding and length class rejects randomness."""
    strata = tested.withColumn("length_class", F.floor(2 * F.log2("length")).cast("int")).withColumn(
        "decade", F.least(F.lit(300), F.floor(-10 * F.log10("p")).cast("int")))
    counts = strata.groupBy("encoding", "length_class", "decade").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("encoding", "length_class")
    down = whole.orderBy(F.col("decade").desc())
    limit = counts.withColumn("share", F.sum("n").over(down) / F.sum("n").over(whole)).where(
        F.pow(F.lit(10.0), -F.col("decade") / 10) <= alpha * F.col("share")).groupBy(
        "encoding", "length_class").agg(F.min("decade").alias("cut"))
    return strata.join(limit, ["encoding", "length_class"], "left").withColumn(
        "structured", F.coalesce(F.col("decade") >= F.col("cut"), F.lit(False))).drop("decade", "cut", "length_class")


def secret_spans(keyed: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """``doc_key, kind, start, stop`` of every secret in ``keyed(doc_key, text)``.

    Offsets are code points, stop is exclusive. A ``random`` span touches no fixed-pattern span.
    """
    places = written(_places(keyed), "places")
    base = places.where(F.col("kind") != "random").where(_passes()).drop("match")
    tested = battery(places.where(F.col("kind") == "random").drop("kind"), "match").where("p is not null")
    rest = dismissed(written(tested.select("doc_key", "start", "stop", "encoding", "length", "p"), "tested"),
                     alpha).where("not structured").select("doc_key", F.lit("random").alias("kind"), "start", "stop")
    line = Window.partitionBy("doc_key").orderBy("start", (F.col("kind") == "random").cast("int"), "stop")
    is_base = F.col("kind") != "random"
    return base.union(rest).withColumn("before_", F.max(F.when(is_base, F.col("stop"))).over(
        line.rowsBetween(Window.unboundedPreceding, -1))).withColumn("after_", F.min(F.when(
            is_base, F.col("start"))).over(line.rowsBetween(1, Window.unboundedFollowing))).where(
        is_base | ((F.coalesce("before_", F.lit(0)) <= F.col("start")) & (
            F.coalesce(F.col("after_"), F.col("stop")) >= F.col("stop")))).drop("before_", "after_")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"),
                       row_key(F.col("doc_id"), F.col("text")).alias("doc_key"))


def _joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(F.array(*map(F.lit, KINDS)), s["nth"] + 1), s["start"], s["stop"])))


def secret_scan(docs: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans,
    n_random``.

    ``spans`` lists kind:start:stop by start, then kind, comma-joined; ``base_sha256`` hashes
    the same list without the random kind. Null text counts as empty: zeros, an empty list.
    Repeated rows each get their result; null ids stay; other columns are ignored; an empty
    table gives no rows.
    """
    keyed = _keyed(docs)
    nth = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1
    found = secret_spans(keyed, alpha).withColumn("nth", nth).groupBy("doc_key").agg(
        *[F.sum((F.col("kind") == k).cast("long")).alias(f"n_{k}") for k in KINDS],
        F.sort_array(F.collect_list(F.struct("start", "nth", "stop"))).alias("list"))
    found = found.select(
        F.col("doc_key").alias("k"), *[f"n_{k}" for k in KINDS], _joined(F.col("list")).alias("spans"),
        _joined(F.filter("list", lambda s: s["nth"] < len(BASE))).alias("base"))
    zero = [F.coalesce(f"n_{k}", F.lit(0)).alias(f"n_{k}") for k in KINDS]
    return keyed.select("doc_id", "doc_key").join(found, F.col("doc_key") == F.col("k"), "left").select(
        "doc_id", *zero[:-1], F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"), zero[-1])


def redact(docs: DataFrame, mark: str = "<SECRET>", alpha: float = ALPHA) -> DataFrame:
    """``docs`` with every secret span of ``text`` replaced by ``mark``; other rows and columns stay.

    Spans that overlap or touch are replaced as one. Rows that a bitmap rules out pass without
    a shuffle.
    """
    key = "redact_key_"
    keyed = docs.withColumn(key, row_key(F.col("doc_id"), F.col("text")))
    spans = secret_spans(keyed.where("text is not null").select(F.col(key).alias("doc_key"), "text"), alpha)
    line = Window.partitionBy("doc_key").orderBy("start", "stop")
    apart = F.col("start") > F.coalesce(F.max("stop").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    merged = spans.withColumn("apart", apart.cast("int")).withColumn("island", F.sum("apart").over(
        line.rowsBetween(Window.unboundedPreceding, 0))).groupBy("doc_key", "island").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop")).groupBy("doc_key").agg(
        F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("cuts_")).withColumnRenamed("doc_key", "cut_key_")
    kept = F.transform(F.sequence(F.lit(0), F.size("cuts_")), lambda i: F.substring(
        F.col("text"), F.when(i == 0, 1).otherwise(F.col("cuts_")[i - 1]["stop"] + 1).cast("int"),
        (F.when(i < F.size("cuts_"), F.get("cuts_", i)["start"]).otherwise(F.char_length("text"))
         - F.when(i == 0, 0).otherwise(F.col("cuts_")[i - 1]["stop"])).cast("int")))
    text = F.when(F.col("cuts_").isNull(), F.col("text")).otherwise(F.array_join(kept, mark))
    merged = written(merged, "cuts")
    near = likely(keyed, key, merged.select("cut_key_"))
    changed = near.where("likely_").join(merged, F.col(key) == F.col("cut_key_"), "left").select(
        *[text.alias("text") if c == "text" else F.col(c) for c in docs.columns])
    return near.where("not likely_").select(*docs.columns).union(changed)
