"""Catalogue: scalar feature functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as X
from .. import settings as S
from .registry import query

_MAP = {n: "MAP {" + ", ".join(f"'{g}': {p}::DOUBLE" for g, p in S.NGRAM_PROBABILITY.items()
                               if len(g) == n) + "}" for n in (2, 3)}
_SUFFIXES = ", ".join(f"'{s}'" for s in S.TWO_LEVEL_SUFFIXES)
_WORDS = " OR ".join(f"contains(lower(domain), '{w}')" for w in S.DICTIONARY_WORDS)
_ENT = """ent AS (SELECT name_id, -sum(p*log2(p)) AS h FROM (
  SELECT name_id, count(*) / sum(count(*)) OVER (PARTITION BY name_id) AS p FROM (
    SELECT name_id, unnest(regexp_extract_all(hex({col}), '..')) AS b FROM {src})
  GROUP BY name_id, b) GROUP BY name_id)"""


def _count(text: str, keep: str) -> str:
    return f"length(regexp_replace({text}, '[^{keep}]', '', 'g'))"


_VOWELS = _count("lower(domain)", "aeiou")
_CONSONANTS = f"({_count('lower(domain)', chr(92) + 'p{L}')} - {_VOWELS})"
_ALNUM = _count("lower(domain)", "\\p{L}\\p{N}")
_DIGITS = _count("lower(domain)", "\\p{Nd}")


def _ngram(n: int, col: str = "domain") -> str:
    return (f"CASE WHEN length({col}) < {n} THEN 0.0 ELSE list_sum([ln(coalesce({_MAP[n]}"
            f"[substr(lower({col}), i, {n})], 1e-10::DOUBLE)) "
            f"for i in range(1, length({col}) - {n} + 2)]) END")


_RATIO = f"CASE WHEN {_VOWELS} = 0 THEN {_CONSONANTS}::DOUBLE ELSE {_CONSONANTS} / {_VOWELS} END"
_DIGIT = f"CASE WHEN {_ALNUM} = 0 THEN 0.0 ELSE {_DIGITS} / {_ALNUM} END"
_TLD = "length(split_part(lower(domain), '.', -1))"
_LABEL = f"""CASE WHEN len(parts) = 1 THEN parts[1]
  WHEN len(parts) >= 3 AND parts[-2] || '.' || parts[-1] IN ({_SUFFIXES}) THEN parts[-3]
  ELSE parts[-2] END"""


def _name(v):
    return v.names.select("name_id", "domain")


@query("shannon_entropy", f"WITH {_ENT.format(col='domain', src='names_v')} "
       "SELECT name_id, round(h, 6) AS entropy FROM ent", ["names_v"])
def _(v):
    return v.names.select("name_id", F.round(X.shannon_entropy(F.col("domain")), 6).alias("entropy"))


@query("entropy_from_counts", """
  SELECT dst_ip, CAST(sum(n) AS BIGINT) AS total, round(-sum(p*log2(p)), 6) AS entropy FROM (
    SELECT dst_ip, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY dst_ip) AS p
    FROM flows_v GROUP BY dst_ip, src_ip) GROUP BY dst_ip""", ["flows_v"])
def _(v):
    counts = v.flows.groupBy("dst_ip", "src_ip").agg(F.count(F.lit(1)).alias("n"))
    return X.entropy_from_counts(counts, ["dst_ip"]).withColumn("entropy", F.round("entropy", 6))


@query("consonant_vowel_ratio", f"SELECT name_id, round({_RATIO}, 6) AS ratio FROM names_v",
       ["names_v"])
def _(v):
    return v.names.select("name_id", F.round(
        X.consonant_vowel_ratio(F.col("domain")), 6).alias("ratio"))


@query("digit_ratio", f"SELECT name_id, round({_DIGIT}, 6) AS ratio FROM names_v", ["names_v"])
def _(v):
    return v.names.select("name_id", F.round(X.digit_ratio(F.col("domain")), 6).alias("ratio"))


@query("ngram_log_score", f"""SELECT name_id, round({_ngram(2)}, 5) AS bigram,
  round({_ngram(3)}, 5) AS trigram FROM names_v""", ["names_v"])
def _(v):
    d = F.col("domain")
    return v.names.select("name_id", F.round(X.ngram_log_score(d, 2), 5).alias("bigram"),
                          F.round(X.ngram_log_score(d, 3), 5).alias("trigram"))


@query("domain_length", "SELECT name_id, CAST(length(domain) AS INTEGER) AS n FROM names_v",
       ["names_v"])
def _(v):
    return v.names.select("name_id", X.domain_length(F.col("domain")).alias("n"))


@query("tld_length", f"SELECT name_id, CAST({_TLD} AS INTEGER) AS n FROM names_v", ["names_v"])
def _(v):
    return v.names.select("name_id", X.tld_length(F.col("domain")).alias("n"))


@query("has_dictionary_word", f"""SELECT doc_id, {_WORDS.replace('domain', 'text')} AS hit
  FROM documents""")
def _(v):
    return v.table("documents").select("doc_id", X.has_dictionary_word(F.col("text")).alias("hit"))


@query("vowel_count", f"SELECT name_id, CAST({_VOWELS} AS INTEGER) AS n FROM names_v", ["names_v"])
def _(v):
    return v.names.select("name_id", X.vowel_count(F.col("domain")).alias("n"))


@query("consonant_count", f"SELECT name_id, CAST({_CONSONANTS} AS INTEGER) AS n FROM names_v",
       ["names_v"])
def _(v):
    return v.names.select("name_id", X.consonant_count(F.col("domain")).alias("n"))


@query("dga_features", f"""WITH {_ENT.format(col='lower(domain)', src='names_v')}
  SELECT name_id, domain, round(h, 6) AS domain_entropy,
    round({_ngram(2)}, 5) AS bigram_log_likelihood_2, round({_ngram(3)}, 5) AS bigram_log_likelihood_3,
    round({_RATIO}, 6) AS consonant_vowel_ratio, round({_DIGIT}, 6) AS digit_ratio,
    CAST(length(domain) AS INTEGER) AS domain_length, CAST({_TLD} AS INTEGER) AS tld_length,
    {_WORDS} AS has_dictionary_word, CAST({_VOWELS} AS INTEGER) AS vowel_count,
    CAST({_CONSONANTS} AS INTEGER) AS consonant_count
  FROM names_v JOIN ent USING (name_id)""", ["names_v"])
def _(v):
    out = X.with_dga_features(_name(v))
    return out.withColumns({c: F.round(c, 5 if "bigram" in c else 6) for c in (
        "domain_entropy", "bigram_log_likelihood_2", "bigram_log_likelihood_3",
        "consonant_vowel_ratio", "digit_ratio")})


@query("registrable_label", f"""
  WITH p AS (SELECT name_id, list_filter(string_split(lower(domain), '.'), lambda x: x <> '') AS parts
             FROM names_v) SELECT name_id, {_LABEL} AS label FROM p""", ["names_v"])
def _(v):
    return v.names.select("name_id", X.registrable_label(F.col("domain")).alias("label"))


@query("dns_name_shape", f"""
  WITH q AS (SELECT flow_id AS name_id, dns_query, split_part(dns_query, '.', 1) AS first
             FROM flows_v WHERE dns_query <> ''), {_ENT.format(col='first', src='q')}
  SELECT name_id AS flow_id, CAST(len(string_split(dns_query, '.')) AS INTEGER) AS label_count,
    CAST(list_max([length(p) for p in string_split(dns_query, '.')]) AS INTEGER) AS longest_label,
    CAST(length(dns_query) AS INTEGER) AS query_length, round(h, 6) AS first_label_entropy
  FROM q JOIN ent USING (name_id)""", ["flows_v"])
def _(v):
    s = v.flows.where(F.col("dns_query") != "").select(
        "flow_id", X.dns_name_shape(F.col("dns_query")).alias("s")).select("flow_id", "s.*")
    return s.withColumn("first_label_entropy", F.round("first_label_entropy", 6))


@query("inter_arrival_times", """SELECT flow_id, unnest(gaps) AS gap,
  generate_subscripts(gaps, 1) - 1 AS i FROM gaps_v""", ["gaps_v"])
def _(v):
    return v.gaps.select("flow_id", F.posexplode("gaps").alias("i", "gap")) \
            .withColumn("i", F.col("i").cast("bigint"))


_MEAN = "list_avg(gaps)"
_CV = """CASE WHEN len(gaps) < 2 OR list_avg(gaps) = 0 THEN 1.0
  ELSE list_stddev_samp(gaps) / list_avg(gaps) END"""
_JIT = """CASE WHEN len(gaps) < 2 OR list_avg(gaps) = 0 THEN 1.0
  ELSE list_avg([abs(g - list_avg(gaps)) for g in gaps]) / list_avg(gaps) END"""


@query("coefficient_of_variation", f"SELECT flow_id, round({_CV}, 6) AS cv FROM gaps_v", ["gaps_v"])
def _(v):
    return v.gaps.select("flow_id", F.round(
        X.coefficient_of_variation(F.col("gaps")), 6).alias("cv"))


@query("jitter", f"SELECT flow_id, round({_JIT}, 6) AS jitter FROM gaps_v", ["gaps_v"])
def _(v):
    return v.gaps.select("flow_id", F.round(X.jitter(F.col("gaps")), 6).alias("jitter"))


def dft_ctes(source: str, ident: str, gaps: str) -> str:
    """Naive DFT of the positive gaps: powers, total, dominant bin per series."""
    return f"""pos AS (SELECT {ident}, list_filter({gaps}, lambda g: g > 0) AS a FROM {source}),
  pw AS (SELECT {ident}, len(a) AS n, k,
      list_sum([a[j+1]*cos(2*pi()*k*j/len(a)) for j in range(len(a))])**2
      + list_sum([a[j+1]*sin(2*pi()*k*j/len(a)) for j in range(len(a))])**2 AS p
    FROM (SELECT *, unnest(range(len(a) // 2)) AS k FROM pos WHERE len(a) >= 4)),
  tot AS (SELECT {ident}, n, sum(p) AS total FROM pw GROUP BY ALL),
  clean AS (SELECT {ident}, n, k, total, p, round(p / total, 9) AS share
    FROM pw JOIN tot USING ({ident}, n)),
  dft AS (SELECT {ident}, n, total, arg_max(k, (share, -k)) AS k,
    arg_max(p, (share, -k)) AS p FROM clean
    WHERE k > 0 GROUP BY ALL)"""


@query("fft_periodicity", f"""WITH {dft_ctes('gaps_v', 'flow_id', 'gaps')}
  SELECT flow_id, round(k / n, 6) AS dominant_freq, round(p / total, 6) AS periodicity_score,
    round(n / k, 6) AS dominant_period FROM dft""", ["gaps_v"])
def _(v):
    out = v.gaps.select("flow_id", X.fft_periodicity(F.col("gaps")).alias("f"))
    return out.select("flow_id", *[F.round(f"f.{c}", 6).alias(c) for c in (
        "dominant_freq", "periodicity_score", "dominant_period")])


@query("beacon_features", f"""WITH {dft_ctes('gaps_v', 'flow_id', 'gaps')}
  SELECT s.flow_id, round({_CV}, 6) AS inter_arrival_cv, round(p/total, 6) AS periodicity_score,
    round(n / (k * (s.packet_count / greatest(s.duration_seconds, 1.0))), 4) AS dominant_period,
    round({_JIT}, 6) AS jitter, 0.5::DOUBLE AS destination_rarity,
    round(1 - least({_CV}, 1.0), 6) AS timing_consistency,
    CAST(len(s.ts) AS INTEGER) AS observation_count, len(s.ts) >= 8 AS is_sufficient_observations
  FROM series_v s JOIN gaps_v g ON s.flow_id = g.flow_id JOIN dft d ON s.flow_id = d.flow_id""",
       ["series_v", "gaps_v"])
def _(v):
    out = X.with_beacon_features(v.series).select(
        "flow_id", "inter_arrival_cv", "periodicity_score", "dominant_period", "jitter",
        "destination_rarity", "timing_consistency", "observation_count",
        "is_sufficient_observations")
    return out.withColumns({**{c: F.round(c, 6) for c in (
        "inter_arrival_cv", "periodicity_score", "jitter", "timing_consistency")},
        "dominant_period": F.round("dominant_period", 4)})


@query("destination_rarity", """SELECT dst_ip, count(*) AS flows,
  round(1.0 / count(*), 8)::DOUBLE AS rarity FROM flows_v GROUP BY dst_ip""", ["flows_v"])
def _(v):
    return X.destination_rarity(v.flows).withColumn("rarity", F.round("rarity", 8))


@query("packet_rate", """SELECT flow_id, round(CASE WHEN duration_seconds > 0
  THEN packet_count / duration_seconds ELSE 0 END, 6) AS rate FROM flows_v""", ["flows_v"])
def _(v):
    return v.flows.select("flow_id", F.round(X.packet_rate(
        F.col("packet_count"), F.col("duration_seconds")), 6).alias("rate"))


@query("byte_rate", """SELECT flow_id, round(CASE WHEN duration_seconds > 0
  THEN bytes_transferred / duration_seconds ELSE 0 END, 5) AS rate FROM flows_v""", ["flows_v"])
def _(v):
    return v.flows.select("flow_id", F.round(X.byte_rate(
        F.col("bytes_transferred"), F.col("duration_seconds")), 5).alias("rate"))


@query("syn_flood_ratio", """SELECT flow_id, count(*) FILTER (contains(flags,'S') AND NOT
    contains(flags,'A')) AS syn_count, count(*) FILTER (contains(flags,'A')) AS ack_count,
    count(*) AS total_packets,
    round(count(*) FILTER (contains(flags,'S') AND NOT contains(flags,'A'))
      / greatest(count(*) FILTER (contains(flags,'A')), 1), 6) AS syn_to_ack_ratio,
    round(count(*) FILTER (contains(flags,'S') AND NOT contains(flags,'A')) / count(*), 6) AS syn_rate
  FROM packets_v GROUP BY flow_id""", ["packets_v"])
def _(v):
    from ..operators.flows import with_flow_key
    out = X.syn_flood_ratio(with_flow_key(v.packets), "flow_id")
    return out.withColumns({c: F.round(c, 6) for c in ("syn_to_ack_ratio", "syn_rate")})


@query("amplification_ratio", """
  WITH both_ways AS (SELECT protocol, src_ip, src_port, dst_ip, dst_port,
      packet_size AS bytes_transferred FROM packets_v
    UNION ALL SELECT protocol, dst_ip, dst_port, src_ip, src_port, packet_size * 3 FROM packets_v
    WHERE packet_size > 80),
  s AS (SELECT protocol, src_ip, src_port, dst_ip, dst_port,
      CAST(sum(bytes_transferred) AS BIGINT) AS b FROM both_ways GROUP BY ALL)
  SELECT a.protocol, a.src_ip, a.src_port, a.dst_ip, a.dst_port, a.b AS request_bytes,
    r.b AS response_bytes, round(r.b / greatest(a.b, 1), 6) AS amplification_ratio
  FROM s a JOIN s r ON a.protocol = r.protocol AND a.src_ip = r.dst_ip AND a.src_port = r.dst_port
    AND a.dst_ip = r.src_ip AND a.dst_port = r.src_port""", ["packets_v"])
def _(v):
    p = v.packets
    there = p.select("protocol", "src_ip", "src_port", "dst_ip", "dst_port",
                     F.col("packet_size").cast("bigint").alias("bytes_transferred"))
    back = p.where(F.col("packet_size") > 80).select(
        "protocol", F.col("dst_ip").alias("src_ip"), F.col("dst_port").alias("src_port"),
        F.col("src_ip").alias("dst_ip"), F.col("src_port").alias("dst_port"),
        (F.col("packet_size") * 3).cast("bigint").alias("bytes_transferred"))
    return X.amplification_ratio(there.unionByName(back)).withColumn(
        "amplification_ratio", F.round("amplification_ratio", 6))


@query("ddos_features", """SELECT flow_id, round(packet_count / duration_seconds, 6) AS packet_rate,
    round(bytes_transferred / duration_seconds, 5) AS byte_rate, duration_seconds, packet_count,
    bytes_transferred, CAST(len(dst_ports) AS INTEGER) AS dst_port_count,
    1 AS src_port_count FROM flows_v""", ["flows_v"])
def _(v):
    return X.with_ddos_features(v.flows).select(
        "flow_id", F.round("packet_rate", 6).alias("packet_rate"),
        F.round("byte_rate", 5).alias("byte_rate"), "duration_seconds", "packet_count",
        "bytes_transferred", "dst_port_count", "src_port_count")


# Outbound is the flow's bytes; the return side is a fixed share of its packets.
def _two_way(v):
    return v.flows.withColumns({"outbound_bytes": F.col("bytes_transferred"),
                                "inbound_bytes": F.col("packet_count") * 40})


_TWO = """two AS (SELECT *, bytes_transferred AS o, packet_count*40 AS i FROM flows_v)"""
_LIKELY = "(o / greatest(i, 1) > 10 AND o + i > 10485760)"


@query("byte_direction_ratio", f"""WITH {_TWO} SELECT flow_id, round(o / greatest(i,1), 6) AS ratio,
    o + i AS total_bytes, {_LIKELY} AS exfil_likely FROM two""", ["flows_v"])
def _(v):
    out = _two_way(v).select("flow_id", X.byte_direction_ratio(
        F.col("outbound_bytes"), F.col("inbound_bytes")).alias("r")).select("flow_id", "r.*")
    return out.withColumn("ratio", F.round("ratio", 6))


@query("byte_skew", f"""WITH {_TWO} SELECT flow_id, round(abs(o-i)/(o+i), 6) AS skew FROM two""",
       ["flows_v"])
def _(v):
    return _two_way(v).select("flow_id", F.round(X.byte_skew(
        F.col("outbound_bytes"), F.col("inbound_bytes")), 6).alias("skew"))


@query("session_duration_stats", """SELECT flow_id,
    round(bytes_transferred / duration_seconds, 5) AS throughput_bytes_sec,
    duration_seconds > 60 AS is_long_duration,
    bytes_transferred / duration_seconds > 100000 AS is_high_throughput FROM flows_v""", ["flows_v"])
def _(v):
    out = v.flows.select("flow_id", X.session_duration_stats(
        F.col("bytes_transferred"), F.col("duration_seconds")).alias("s")).select("flow_id", "s.*")
    return out.withColumn("throughput_bytes_sec", F.round("throughput_bytes_sec", 5))


@query("exfil_features", f"""WITH {_TWO} SELECT flow_id, round(o / greatest(i,1), 6) AS ratio,
    o + i AS total_bytes, {_LIKELY} AS exfil_likely, round(abs(o-i)/(o+i), 6) AS byte_skew,
    {_LIKELY} OR (duration_seconds > 60 AND o / duration_seconds < 10000) AS exfil_alert
  FROM two""", ["flows_v"])
def _(v):
    return X.with_exfil_features(_two_way(v)).select(
        "flow_id", F.round("ratio", 6).alias("ratio"), "total_bytes", "exfil_likely",
        F.round("byte_skew", 6).alias("byte_skew"), "exfil_alert")


@query("one_sided_exfil_features", """SELECT flow_id,
    bytes_transferred::DOUBLE AS outbound_bytes_abs,
    round(bytes_transferred / greatest(packet_count, 1), 6) AS bytes_per_packet,
    round(bytes_transferred / greatest(duration_seconds, 1.0), 5) AS throughput_bytes_sec,
    bytes_transferred > 1048576 AND bytes_transferred / greatest(packet_count, 1) > 500
      AS exfil_likely FROM flows_v""", ["flows_v"])
def _(v):
    out = v.flows.select("flow_id", X.one_sided_exfil_features(
        F.col("bytes_transferred"), F.col("packet_count"),
        F.col("duration_seconds")).alias("e")).select("flow_id", "e.*")
    return out.withColumns({"bytes_per_packet": F.round("bytes_per_packet", 6),
                            "throughput_bytes_sec": F.round("throughput_bytes_sec", 5)})


def _hello(v):
    """ClientHello-like code lists from order columns."""
    o, k = v.table("orders"), F.col("o_orderkey")
    return o.select(
        F.concat(F.lit("o"), k.cast("string")).alias("flow_id"),
        F.lit("TLS 1.2").alias("tls_version"),
        F.array((k % 7 + 4865).cast("int"), F.lit(0x1A1A), (k % 5 + 49195).cast("int"),
                F.lit(156)).alias("ciphers"),
        F.array((k % 3 + 10).cast("int"), F.lit(0x0A0A), F.lit(0)).alias("extensions"),
        F.when(k % 11 == 0, F.array().cast("array<int>"))
         .otherwise(F.array(F.lit(0xFAFA), (k % 4 + 23).cast("int"))).alias("curves"),
        F.array(F.lit(0), (k % 2).cast("int")).alias("point_formats"),
        F.when(k % 13 == 0, "").otherwise(F.concat(F.lit("host"), (k % 17).cast("string"),
                                                   F.lit(".example.org"))).alias("hostname"),
        F.array((k % 1400).cast("bigint"), (k % 600).cast("bigint"),
                (k % 90).cast("bigint")).alias("packet_sizes"))


_HELLO = """hello AS (SELECT 'o' || CAST(o_orderkey AS VARCHAR) AS flow_id,
    [CAST(o_orderkey % 7 + 4865 AS INTEGER), 6682, CAST(o_orderkey % 5 + 49195 AS INTEGER), 156] AS c,
    [CAST(o_orderkey % 3 + 10 AS INTEGER), 2570, 0] AS e,
    CASE WHEN o_orderkey % 11 = 0 THEN [] ELSE [64250, CAST(o_orderkey % 4 + 23 AS INTEGER)] END AS u,
    [0, CAST(o_orderkey % 2 AS INTEGER)] AS p,
    CASE WHEN o_orderkey % 13 = 0 THEN ''
      ELSE 'host' || CAST(o_orderkey % 17 AS VARCHAR) || '.example.org' END AS hostname,
    [o_orderkey % 1400, o_orderkey % 600, o_orderkey % 90] AS sizes FROM orders)"""


def _sorted(col: str) -> str:
    return (f"CASE WHEN len({col}) = 0 THEN ' ' ELSE "
            f"array_to_string(list_sort([CAST(x AS VARCHAR) for x in {col}]), ':') END")


_JA3 = f"md5('TLS 1.2:' || {_sorted('c')} || ':' || {_sorted('e')} || ':' || {_sorted('u')} || ':' || {_sorted('p')})"
_HOST = "CASE WHEN hostname = '' THEN ' ' ELSE hostname END"
_JA4 = f"sha256({_JA3} || ':' || {_HOST} || ':' || {_sorted('e')} || ':0.000')"
_GREASE = ", ".join(str(g) for g in S.GREASE)


def _clean(col: str) -> str:
    return f"list_filter({col}, lambda x: x NOT IN ({_GREASE}))"


def _dash(col: str) -> str:
    return f"coalesce(array_to_string({col}, '-'), '')"


@query("ja3_metadata_hash", f"WITH {_HELLO} SELECT flow_id, {_JA3} AS ja3 FROM hello")
def _(v):
    return _hello(v).select("flow_id", X.ja3_metadata_hash(
        F.col("tls_version"), F.col("ciphers"), F.col("extensions"), F.col("curves"),
        F.col("point_formats")).alias("ja3"))


@query("ja4_metadata_hash", f"WITH {_HELLO} SELECT flow_id, {_JA4} AS ja4 FROM hello")
def _(v):
    return X.with_tls_features(_hello(v)).select("flow_id", F.col("ja4_hash").alias("ja4"))


@query("ja3_standard", f"""WITH {_HELLO} SELECT flow_id, md5('771,' || {_dash(_clean('c'))} || ',' ||
    {_dash(_clean('e'))} || ',' || {_dash(_clean('u'))} || ',' || {_dash('p')}) AS ja3,
    CAST(len({_clean('c')}) AS INTEGER) AS ciphers_count,
    CAST(len({_clean('e')}) AS INTEGER) AS extensions_count,
    CAST(len({_clean('u')}) AS INTEGER) AS curves_count, CAST(len(p) AS INTEGER) AS point_formats_count
  FROM hello""")
def _(v):
    lists = [F.col(c) for c in ("ciphers", "extensions", "curves", "point_formats")]
    return _hello(v).select("flow_id", X.ja3_standard(F.lit(771), *lists).alias("ja3"),
                            X.ja3_counts(*lists).alias("n")).select("flow_id", "ja3", "n.*")


@query("packet_size_sequence", f"""WITH {_HELLO} SELECT flow_id,
    array_to_string([CAST(coalesce(sizes[i], 0) AS BIGINT) for i in range(1, 21)], ' ') AS sizes
  FROM hello""")
def _(v):
    seq = X.packet_size_sequence(F.col("packet_sizes")).cast("array<bigint>").cast("array<string>")
    return _hello(v).select("flow_id", F.array_join(seq, " ").alias("sizes"))


@query("size_sequence_stats", f"""WITH {_HELLO} SELECT flow_id, round(list_avg(sizes), 6) AS mean_size,
    list_median(sizes)::DOUBLE AS median_size, round(list_stddev_pop(sizes), 6) AS std_size,
    list_min(sizes)::DOUBLE AS min_size, list_max(sizes)::DOUBLE AS max_size FROM hello""")
def _(v):
    out = _hello(v).select("flow_id", X.size_sequence_stats(
        F.col("packet_sizes")).alias("s")).select("flow_id", "s.*")
    return out.withColumns({c: F.round(c, 6) for c in ("mean_size", "std_size")})


@query("tls_features", f"""WITH {_HELLO} SELECT flow_id, {_JA3} AS ja3_hash, {_JA4} AS ja4_hash,
    CAST(len(c) AS INTEGER) AS ciphers_count, CAST(len(e) AS INTEGER) AS extensions_count,
    CAST(len(u) AS INTEGER) AS curves_count, CAST(len(p) AS INTEGER) AS point_formats_count,
    substr(hostname, 1, 32) AS hostname_prefix FROM hello""")
def _(v):
    return X.with_tls_features(_hello(v)).select(
        "flow_id", "ja3_hash", "ja4_hash", "ciphers_count", "extensions_count", "curves_count",
        "point_formats_count", "hostname_prefix")


@query("scan_type", """SELECT src_ip, CASE WHEN p > h THEN 'horizontal' WHEN h > p THEN 'vertical'
    ELSE 'mixed' END AS scan_type FROM (SELECT src_ip, count(DISTINCT dst_port) p,
    count(DISTINCT dst_ip) h FROM flows_v GROUP BY src_ip)""", ["flows_v"])
def _(v):
    n = v.flows.groupBy("src_ip").agg(F.countDistinct("dst_port").alias("p"),
                                      F.countDistinct("dst_ip").alias("h"))
    return n.select("src_ip", X.scan_type(F.col("p"), F.col("h")).alias("scan_type"))


@query("scan_features", """
  WITH h AS (SELECT src_ip, count(DISTINCT dst_ip) AS hosts FROM flows_v GROUP BY src_ip),
  j AS (SELECT f.*, hosts, CAST(len(dst_ports) AS INTEGER) AS ports FROM flows_v f JOIN h USING (src_ip))
  SELECT flow_id, src_ip, ports AS unique_dst_ports, hosts AS unique_dst_hosts,
    CASE WHEN ports > hosts THEN 'horizontal' WHEN hosts > ports THEN 'vertical' ELSE 'mixed' END
      AS scan_type, ports > hosts AS is_horizontal_scan, hosts > ports AS is_vertical_scan,
    round(ports / greatest(hosts, 1), 6) AS fan_out_ratio, ports > 20 OR hosts > 15 AS port_scan_alert
  FROM j""", ["flows_v"])
def _(v):
    return X.scan_features(v.flows).select(
        "flow_id", "src_ip", "unique_dst_ports", "unique_dst_hosts", "scan_type",
        "is_horizontal_scan", "is_vertical_scan", F.round("fan_out_ratio", 6).alias("fan_out_ratio"),
        "port_scan_alert")


@query("tcp_flags_decode", """SELECT l_orderkey, l_linenumber, array_to_string(list_filter([
    CASE WHEN bits & 2 <> 0 THEN 'SYN' END, CASE WHEN bits & 16 <> 0 THEN 'ACK' END,
    CASE WHEN bits & 8 <> 0 THEN 'PSH' END, CASE WHEN bits & 1 <> 0 THEN 'FIN' END,
    CASE WHEN bits & 4 <> 0 THEN 'RST' END, CASE WHEN bits & 32 <> 0 THEN 'URG' END],
    lambda x: x IS NOT NULL), ',') AS names FROM
    (SELECT DISTINCT l_orderkey, l_linenumber, (l_orderkey + l_linenumber) % 64 AS bits FROM lineitem)""")
def _(v):
    rows = v.table("lineitem").select("l_orderkey", "l_linenumber").distinct()
    bits = ((F.col("l_orderkey") + F.col("l_linenumber")) % 64).cast("int")
    return rows.select("l_orderkey", "l_linenumber",
                       F.array_join(X.tcp_flags_decode(bits), ",").alias("names"))


@query("tcp_flags_encode", """SELECT DISTINCT l_orderkey, l_linenumber,
    CAST((l_orderkey + l_linenumber) % 64 AS INTEGER) AS bits FROM lineitem""")
def _(v):
    rows = v.table("lineitem").select("l_orderkey", "l_linenumber").distinct()
    bits = ((F.col("l_orderkey") + F.col("l_linenumber")) % 64).cast("int")
    return rows.select("l_orderkey", "l_linenumber",
                       X.tcp_flags_encode(X.tcp_flags_decode(bits)).alias("bits"))
