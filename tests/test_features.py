"""Feature functions on hand-computed values."""

import math

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from taplight import functions as X


def one(spark, expr, **values):
    cols = [F.lit(v).alias(k) if not isinstance(v, list) else
            F.array(*[F.lit(x) for x in v]).alias(k) for k, v in values.items()]
    return spark.range(1).select(*cols).select(expr.alias("out")).first()[0]


def bytes_entropy(text):
    data = text.encode()
    counts = [data.count(b) for b in set(data)]
    return -sum(c / len(data) * math.log2(c / len(data)) for c in counts) if data else 0.0


@pytest.mark.parametrize("text", ["", "a", "aaaa", "ab", "google", "é", "naïve-ñ", "0123456789abcdef"])
def test_entropy(spark, text):
    assert one(spark, X.shannon_entropy(F.col("t")), t=text) == pytest.approx(bytes_entropy(text))


@settings(max_examples=3, deadline=None)
@given(st.lists(st.text(max_size=20), min_size=30, max_size=60))
def test_entropy_bounds(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for text, h in df.select("t", X.shannon_entropy(F.col("t"))).collect():
        assert h == pytest.approx(bytes_entropy(text), abs=1e-9)
        assert -1e-9 <= h <= 8


@pytest.mark.parametrize("name,ratio", [("abc.com", 2.0), ("xyz", 3.0), ("aei", 0.0), ("", 0.0)])
def test_consonant_vowel_ratio(spark, name, ratio):
    assert one(spark, X.consonant_vowel_ratio(F.col("n")), n=name) == ratio


@pytest.mark.parametrize("name,ratio", [("a1b2", 0.5), ("...", 0.0), ("123", 1.0), ("é1", 0.5)])
def test_digit_ratio(spark, name, ratio):
    assert one(spark, X.digit_ratio(F.col("n")), n=name) == ratio


def test_ngrams(spark):
    assert one(spark, X.ngram_log_score(F.col("n"), 2), n="the") \
        == pytest.approx(math.log(0.0317) + math.log(0.0306))
    assert one(spark, X.ngram_log_score(F.col("n"), 3), n="Xing") \
        == pytest.approx(math.log(1e-10) + math.log(0.0069))
    assert one(spark, X.ngram_log_score(F.col("n"), 2), n="a") == 0.0


@pytest.mark.parametrize("host,label", [
    ("www.google.co.uk", "google"), ("jusblkekwjj.ru", "jusblkekwjj"), ("localhost", "localhost"),
    ("", ""), ("A.B.Example.COM.", "example"), ("co.uk", "co")])
def test_registrable_label(spark, host, label):
    assert one(spark, X.registrable_label(F.col("h")), h=host) == label


def test_lengths(spark):
    assert one(spark, X.domain_length(F.col("n")), n=".abc.de.") == 6
    assert one(spark, X.tld_length(F.col("n")), n="abc.info") == 4
    assert one(spark, X.tld_length(F.col("n")), n="label") == 5
    assert one(spark, X.has_dictionary_word(F.col("n")), n="my-LOGIN-page.com") is True
    assert one(spark, X.has_dictionary_word(F.col("n")), n="qwrtz") is False


def test_timing(spark):
    assert one(spark, X.inter_arrival_times(F.col("s")), s=[1.0, 3.0, 6.0]) == [2.0, 3.0]
    assert one(spark, X.inter_arrival_times(F.col("s")), s=[1.0]) == []
    assert one(spark, X.coefficient_of_variation(F.col("s")), s=[5.0]) == 1.0
    assert one(spark, X.coefficient_of_variation(F.col("s")), s=[2.0, 2.0, 2.0]) == 0.0
    assert one(spark, X.coefficient_of_variation(F.col("s")), s=[1.0, 3.0]) \
        == pytest.approx(math.sqrt(2) / 2)
    assert one(spark, X.jitter(F.col("s")), s=[1.0, 3.0]) == 0.5


def test_periodicity_is_bounded_by_variation(spark):
    """With all gaps positive the score cannot pass the squared variation."""
    df = spark.range(200).select(F.transform(F.sequence(F.lit(1), F.lit(24)), lambda i: F.lit(1.0)
                                 + F.pmod(F.xxhash64("id", i), F.lit(1000)) / 400.0).alias("g"))
    rows = df.select(X.coefficient_of_variation(F.col("g")).alias("cv"),
                     X.fft_periodicity(F.col("g"))["periodicity_score"].alias("s")).collect()
    assert all(r.s <= r.cv ** 2 + 1e-9 for r in rows) and any(r.s > 0 for r in rows)


def test_periodicity_needs_four_positive_gaps(spark):
    assert one(spark, X.fft_periodicity(F.col("g"))["periodicity_score"], g=[1.0, 2.0, 0.0, 3.0]) == 0.0


def test_flow_key_treats_missing_ports_as_zero(spark):
    df = spark.createDataFrame([("TCP", "1.1.1.1", None, "2.2.2.2", 80),
                                ("tcp", "1.1.1.1", 0, "2.2.2.2", 80)],
                               "p string, s string, sp int, d string, dp int")
    keys = [r[0] for r in df.select(X.flow_key(*[F.col(c) for c in df.columns])).collect()]
    assert keys[0] == keys[1] and len(keys[0]) == 16


def test_ja3_leaves_out_grease_and_keeps_order(spark):
    lists = [[0x0A0A, 49195, 4865], [0, 0xFAFA, 10], [29], [0]]
    got = one(spark, X.ja3_standard(F.lit(771), *[F.col(c) for c in "abcd"]),
              **dict(zip("abcd", lists)))
    import hashlib
    assert got == hashlib.md5(b"771,49195-4865,0-10,29,0").hexdigest()


def test_flag_round_trip(spark):
    df = spark.range(64).select(F.col("id").cast("int").alias("b"))
    rows = df.select("b", X.tcp_flags_encode(X.tcp_flags_decode(F.col("b"))).alias("c")).collect()
    assert all(r.b == r.c for r in rows)
    assert one(spark, X.tcp_flags_encode(F.col("f")), f=["S", "ack", "nope"]) == 0x12
    assert one(spark, X.tcp_flags_decode(F.lit(0x12), letters=True)) == "SA"
