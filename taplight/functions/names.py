"""Name features: entropy, letter ratios, n-grams, labels."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import settings as S

__all__ = [
    "shannon_entropy", "entropy_from_counts", "consonant_vowel_ratio", "digit_ratio",
    "ngram_log_score", "domain_length", "tld_length", "has_dictionary_word",
    "vowel_count", "consonant_count", "with_dga_features", "registrable_label",
    "dns_name_shape", "clean_name",
]


def clean_name(name: Column) -> Column:
    """Lower case, edge dots removed."""
    return F.lower(F.regexp_replace(name, r"^\.+|\.+$", ""))


def _run_log_sum(text: Column) -> Column:
    """Sum of c*log2(c) over the counts c of a text's characters, in the characters' order."""
    ordered = F.array_join(F.sort_array(F.split(text, "")), "")
    # A character that stands once adds nothing.
    lengths = F.transform(F.regexp_extract_all(ordered, F.lit(r"(?s)(.)\1+"), F.lit(0)),
                          lambda run: F.length(run).cast("double"))
    return F.aggregate(lengths, F.lit(0.0), lambda total, c: total + c * F.log2(c))


def shannon_entropy(text: Column) -> Column:
    """Bits per byte of the UTF-8 form; empty or null gives 0."""
    one_a_byte = F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")
    n = F.octet_length(text).cast("double")
    entropy = F.log2(n) - _run_log_sum(one_a_byte) / n
    return F.when(F.coalesce(F.octet_length(text), F.lit(0)) > 0, entropy).otherwise(0.0)


def entropy_from_counts(df: DataFrame, keys: Sequence[str], count: str = "n") -> DataFrame:
    """Entropy of a frequency table, one row per key group."""
    n = F.col(count).cast("double")
    positive = F.when(n > 0, n * F.log2(n)).otherwise(0.0)
    grouped = df.groupBy(*keys).agg(F.sum(n).alias("total"), F.sum(positive).alias("_s"))
    entropy = F.when(F.col("total") > 0,
                     F.log2("total") - F.col("_s") / F.col("total")).otherwise(0.0)
    return grouped.select(*keys, F.col("total").cast("bigint").alias("total"),
                          entropy.alias("entropy"))


def _count_of(text: Column, keep: str) -> Column:
    """Characters of ``text`` inside the regex class ``keep``."""
    return F.length(F.regexp_replace(text, f"[^{keep}]", ""))


def vowel_count(name: Column) -> Column:
    return _count_of(F.lower(name), "aeiou")


def consonant_count(name: Column) -> Column:
    return _count_of(F.lower(name), r"\p{L}") - vowel_count(name)


def _consonants_to_vowels(vowels: Column, consonants: Column) -> Column:
    return F.when(vowels == 0, consonants.cast("double")).otherwise(consonants / vowels)


def consonant_vowel_ratio(name: Column) -> Column:
    return _consonants_to_vowels(vowel_count(clean_name(name)), consonant_count(clean_name(name)))


def _digits_to_all(text: Column) -> Column:
    total = _count_of(text, r"\p{L}\p{N}")
    return F.when(total == 0, 0.0).otherwise(_count_of(text, r"\p{Nd}") / total)


def digit_ratio(name: Column) -> Column:
    return _digits_to_all(clean_name(name))


def ngram_log_score(text: Column, n: int = 2) -> Column:
    """Sum of ln p over the sliding n-grams; shorter text gives 0."""
    known = [(g, p) for g, p in S.NGRAM_PROBABILITY.items() if len(g) == n]
    unknown = F.log(F.lit(S.NGRAM_UNKNOWN))
    if known:
        table = F.create_map(*[x for g, p in known for x in (F.lit(g), F.log(F.lit(p)))])

    def score(lower):
        def log_p(i):
            gram = F.substring(lower, i, F.lit(n))
            # A map is searched key by key, a list is hashed.
            return F.when(gram.isin(*[g for g, _ in known]), table[gram]).otherwise(unknown) if known else unknown

        count = F.length(lower) - F.lit(n - 1)
        total = F.aggregate(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), F.lit(0.0),
                            lambda acc, i: acc + log_p(i))
        return F.when(count < 1, 0.0).otherwise(total)

    # Bound once, so the lower-cased text is not rebuilt for every n-gram.
    return F.get(F.transform(F.array(F.lower(text)), score), F.lit(0))


def domain_length(name: Column) -> Column:
    return F.coalesce(F.length(F.regexp_replace(name, r"^\.+|\.+$", "")), F.lit(0))


def tld_length(name: Column) -> Column:
    """Length of the part after the last dot; the whole name when there is none."""
    return F.coalesce(F.length(F.substring_index(F.lower(name), ".", -1)), F.lit(0))


def has_dictionary_word(name: Column, words: Sequence[str] = S.DICTIONARY_WORDS) -> Column:
    return _has_word(clean_name(name), words)


def _has_word(text: Column, words: Sequence[str] = S.DICTIONARY_WORDS) -> Column:
    hits = [text.contains(w) for w in words if len(w) >= 3]
    return reduce(lambda a, b: a | b, hits, F.lit(False))


def with_dga_features(df: DataFrame, name: str = "domain") -> DataFrame:
    """All name features of one column."""
    raw, text = F.col(name), F.col("_clean")
    vowels = F.col("_vowels")
    # The cleaned name and its counts are columns of their own, so that each is made once a row.
    counted = df.withColumn("_clean", clean_name(raw)).withColumn("_vowels", vowel_count(text)).withColumn(
        "_consonants", _count_of(F.lower(text), r"\p{L}") - vowels)
    return counted.withColumns({
        "domain_entropy": shannon_entropy(text),
        "bigram_log_likelihood_2": ngram_log_score(text, 2),
        "bigram_log_likelihood_3": ngram_log_score(text, 3),
        "consonant_vowel_ratio": _consonants_to_vowels(vowels, F.col("_consonants")),
        "digit_ratio": _digits_to_all(text),
        "domain_length": domain_length(raw),
        "tld_length": tld_length(raw),
        "has_dictionary_word": _has_word(text),
        "vowel_count": vowel_count(raw),
        "consonant_count": consonant_count(raw),
    }).drop("_clean", "_vowels", "_consonants")


def registrable_label(host: Column) -> Column:
    """Owner label: 'www.site.co.uk' and 'site.com' both give 'site'."""
    labels = F.filter(F.split(F.lower(F.trim(F.coalesce(host, F.lit("")))), r"\."),
                      lambda x: x != "")
    n = F.size(labels)
    suffix = F.concat_ws(".", F.slice(labels, F.greatest(n - 1, F.lit(1)), F.lit(2)))
    return F.when(n == 0, F.lit("")) \
            .when(n == 1, F.get(labels, F.lit(0))) \
            .when((n >= 3) & suffix.isin(*S.TWO_LEVEL_SUFFIXES), F.get(labels, n - 3)) \
            .otherwise(F.get(labels, n - 2))


def dns_name_shape(query: Column) -> Column:
    """Struct of label count, longest label, name length and first-label entropy."""
    name = F.regexp_replace(F.coalesce(query, F.lit("")), r"^\.+|\.+$", "")
    labels = F.filter(F.split(name, r"\."), lambda x: x != "")
    longest = F.coalesce(F.array_max(F.transform(labels, lambda x: F.length(x))), F.lit(0))
    return F.struct(F.size(labels).alias("label_count"), longest.alias("longest_label"),
                    F.length(name).alias("query_length"),
                    shannon_entropy(F.get(labels, F.lit(0))).alias("first_label_entropy"))
