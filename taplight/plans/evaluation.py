"""Catalogue: models, scoring and studies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ddos, dns, evaluation as E, exfil, models as M
from ..session import cut_lineage
from .detectors import _EXFIL, _RATED_S, _RATE_HIT, _SMALL, _TUNNEL, _small
from .registry import query


def _labelled(v):
    """Flows with a label by line number, standing in for a labelled stream."""
    line = F.substring("flow_id", 2, 20).cast("bigint") % 8
    label = F.when(line == 1, "ddos").when(line == 2, "exfiltration").when(line == 6, "dns_tunnel") \
             .when(line == 7, "benign_keepalive").otherwise("benign")
    return _small(v).withColumn("label", label)


def _found(flows):
    """Verdicts of the detectors that judge each flow by itself."""
    parts = [ddos.ddos_rate_rule(flows).select("flow_id", F.lit("ddos").alias("threat_class")),
             exfil.exfil_rule(flows).select("flow_id", F.lit("exfiltration").alias("threat_class")),
             dns.dns_tunnel_score(flows).select("flow_id", F.lit("dns_tunnel").alias("threat_class"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _both_directions(flows):
    """Labelled flows with the features that need the return direction, which the tables don't hold.

    A stand-in, like the label: attacks go largely unanswered, other flows are answered in kind, and
    udp answers are up to 23 times the request.
    """
    odd = 1 + F.col("src_port") % 24

    def ratio(count, label):
        answer = F.when(F.col("label") == label, F.floor(F.col(count) / odd)).otherwise(F.col(count))
        return F.col(count) / F.greatest(answer, F.lit(1))

    values = (ratio("packet_count", "ddos"), F.when(F.col("protocol") == "udp", odd - 1).otherwise(0).cast("double"),
              ratio("bytes_transferred", "exfiltration"))
    return flows.withColumn("raw_features", F.map_concat("raw_features", F.create_map(
        *[x for n, v in zip(E.TWO_SIDED, values) for x in (F.lit(n), v)])))


def _found_by_direction(flows):
    """The same verdicts, and those of the rules on the features that the ablation takes away and adds."""
    parts = [rules(flows).select("flow_id", F.explode("classes").alias("threat_class"))
             for rules in (E.two_sided_rules, E.one_sided_rules)]
    return _found(flows).unionByName(parts[0]).unionByName(parts[1])


_LABEL = """CASE flow_no % 8 WHEN 1 THEN 'ddos' WHEN 2 THEN 'exfiltration' WHEN 6 THEN 'dns_tunnel'
    WHEN 7 THEN 'benign_keepalive' ELSE 'benign' END"""
_DET = f"""{_RATED_S}, {_TUNNEL.replace('FROM flows_v', 'FROM flows_s')},
  det AS (SELECT flow_id, 'ddos' AS c FROM rated WHERE {_RATE_HIT}
    UNION ALL SELECT flow_id, 'exfiltration' FROM flows_s WHERE {_EXFIL}
    UNION ALL SELECT flow_id, 'dns_tunnel' FROM sc WHERE points >= 50),
  lab AS (SELECT flow_id, {_LABEL} AS label FROM flows_s),
  out AS (SELECT lab.*, coalesce(cs, []) AS cs FROM lab LEFT JOIN
    (SELECT flow_id, list_distinct(list(c)) AS cs FROM det GROUP BY 1) USING (flow_id))"""


def _prf_sql(tp: str = "tp", fp: str = "fp", fn: str = "fn") -> str:
    return f"""round(CASE WHEN {tp}+{fp} > 0 THEN {tp}/({tp}+{fp}) ELSE 0 END, 4)::DOUBLE AS precision,
    round(CASE WHEN {tp}+{fn} > 0 THEN {tp}/({tp}+{fn}) ELSE 0 END, 4)::DOUBLE AS recall,
    round(CASE WHEN {tp} > 0 THEN 2*{tp}/(2*{tp}+{fp}+{fn}) ELSE 0 END, 4)::DOUBLE AS f1"""


@query("stratified_split", """WITH r AS (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY
    ('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':42'), 1, 8))::BIGINT, doc_id) AS r,
    count(*) OVER (PARTITION BY label) AS n FROM scored_v)
  SELECT doc_id, label, r <= floor(n*0.8) AS is_train FROM r""", ["scored_v"])
def _(v):
    return E.stratified_split(v.scored, "label", "doc_id").select("doc_id", "label", "is_train")


@query("binary_metrics", f"""WITH c AS (SELECT count(*) AS n, count(*) FILTER (label=1 AND pred=1) AS tp,
    count(*) FILTER (label=0 AND pred=1) AS fp, count(*) FILTER (label=1 AND pred=0) AS fn,
    count(*) FILTER (label=0 AND pred=0) AS tn FROM scored_v),
  a AS (SELECT sum(CASE WHEN p.score > q.score THEN 1.0 WHEN p.score = q.score THEN 0.5 ELSE 0 END)
      / count(*) AS auc FROM scored_v p, scored_v q WHERE p.label = 1 AND q.label = 0)
  SELECT *, round((tp+tn)/n, 4)::DOUBLE AS accuracy, round(fp/greatest(fp+tn, 1), 4)::DOUBLE AS fpr,
    {_prf_sql()}, round((SELECT auc FROM a), 4)::DOUBLE AS auc FROM c""", ["scored_v"])
def _(v):
    return E.binary_metrics(v.scored, "label", "pred", "score")


@query("per_class_detection_rate", f"""WITH {_DET} SELECT label, count(*) AS n,
    round(avg(CASE WHEN list_contains(cs, label) THEN 1 ELSE 0 END), 4)::DOUBLE AS detected_correct_class,
    round(avg(CASE WHEN len(cs) > 0 THEN 1 ELSE 0 END), 4)::DOUBLE AS any_alert FROM out GROUP BY label""",
       ["flows_v"])
def _(v):
    flows = _labelled(v)
    return E.per_class_detection_rate(flows.select("flow_id", "label"), _found(flows))


@query("multi_seed_summary", """SELECT lang, round(avg(score), 4) AS mean, round(min(score), 4) AS min,
    round(max(score), 4) AS max FROM scored_v GROUP BY lang""", ["scored_v"])
def _(v):
    return E.multi_seed_summary(v.scored, ["lang"], "score")


@query("one_sided_ablation", f"""WITH {_DET}, s AS (SELECT m AS mode, c AS class,
    count(*) FILTER (label = c AND list_contains(cs, c)) AS tp,
    count(*) FILTER (label IN ('benign','benign_keepalive') AND list_contains(cs, c)) AS fp,
    count(*) FILTER (label = c AND NOT list_contains(cs, c)) AS fn
  FROM out, (VALUES ('bidirectional'),('unidirectional'),('recovered')) t(m),
    (VALUES ('ddos'),('exfiltration'),('dns_tunnel')) u(c) GROUP BY ALL)
  SELECT *, {_prf_sql()} FROM s""", ["flows_v"])
def _(v):
    return E.one_sided_ablation(cut_lineage(_labelled(v)), _found, ("ddos", "exfiltration", "dns_tunnel"))


def _answer(count: str, label: str) -> str:
    return f"{count} / greatest(CASE WHEN {_LABEL} = '{label}' THEN {count} // (1 + src_port % 24) ELSE {count} END, 1)"


@query("ablation_cost", f"""WITH {_DET}, modes(mode) AS (VALUES ('bidirectional'),('unidirectional'),('recovered')),
  sided AS (SELECT *, {_answer('packet_count', 'ddos')} AS syn_to_ack, {_answer('bytes_transferred', 'exfiltration')} AS outbound,
    CASE WHEN protocol = 'udp' THEN src_port % 24 ELSE 0 END AS amplified,
    packet_count / greatest(coalesce(duration_seconds, 0), 1e-6) AS pps FROM flows_s),
  seen AS (SELECT flow_id, c, mode FROM det, modes
    UNION ALL SELECT flow_id, 'ddos', 'bidirectional' FROM sided WHERE syn_to_ack > 10 OR amplified > 20
    UNION ALL SELECT flow_id, 'exfiltration', 'bidirectional' FROM sided WHERE outbound > 10
    UNION ALL SELECT flow_id, 'ddos', 'recovered' FROM sided
      WHERE pps > 50 OR (dst_port IN (53,123,161,389,1900,11211) AND pps > 20)
    UNION ALL SELECT flow_id, 'exfiltration', 'recovered' FROM sided
      WHERE bytes_transferred > 1000000 AND bytes_transferred / greatest(packet_count, 1) > 500),
  classes AS (SELECT flow_id, mode, list_distinct(list(c)) AS cs FROM seen GROUP BY ALL),
  judged AS (SELECT flow_id, label, mode, coalesce(classes.cs, []) AS cs
    FROM (SELECT * FROM lab, modes) LEFT JOIN classes USING (flow_id, mode)),
  s AS (SELECT mode, c AS class,
    count(*) FILTER (label = c AND list_contains(cs, c)) AS tp,
    count(*) FILTER (label IN ('benign','benign_keepalive') AND list_contains(cs, c)) AS fp,
    count(*) FILTER (label = c AND NOT list_contains(cs, c)) AS fn
  FROM judged, (VALUES ('ddos'),('exfiltration'),('dns_tunnel')) u(c) GROUP BY ALL), f AS (SELECT *, {_prf_sql()} FROM s),
  w AS (SELECT class, max(f1) FILTER (mode = 'bidirectional') AS bidirectional,
    max(f1) FILTER (mode = 'unidirectional') AS unidirectional, max(f1) FILTER (mode = 'recovered') AS recovered
    FROM f GROUP BY class)
  SELECT *, round(bidirectional - unidirectional, 4) AS cost, round(recovered - unidirectional, 4) AS regained FROM w""",
       ["flows_v"])
def _(v):
    scores = E.one_sided_ablation(cut_lineage(_both_directions(_labelled(v))), _found_by_direction,
                                  ("ddos", "exfiltration", "dns_tunnel"))
    return E.ablation_cost(scores)


@query("one_sided_rules", f"""WITH {_SMALL} SELECT flow_id, array_to_string(list_filter([
    CASE WHEN packet_count/greatest(duration_seconds, 1e-6) > 50 OR (dst_port IN (53,123,161,389,1900,11211)
      AND packet_count/greatest(duration_seconds, 1e-6) > 20) THEN 'ddos' END,
    CASE WHEN bytes_transferred > 1000000 AND bytes_transferred/greatest(packet_count,1) > 500
      THEN 'exfiltration' END], lambda x: x IS NOT NULL), ',') AS classes FROM flows_s""", ["flows_v"])
def _(v):
    flows = E.add_one_sided_substitutes(E.strip_two_sided(_small(v)))
    return E.one_sided_rules(flows).select("flow_id", F.array_join("classes", ",").alias("classes"))


_DRAW = "('0x' || substr(md5(flow_id || ':{what}:' || CAST(trial AS VARCHAR) || ':42'{i}), 1, 8))::BIGINT / 4294967296.0::DOUBLE"
_PACKET = _DRAW.format(what="packet", i=" || ':' || CAST(i AS VARCHAR)")
_KEEP = _DRAW.format(what="keep", i="")


@query("packet_loss_resample", f"""WITH c AS (SELECT *, [start_time + i*(duration_seconds/(packet_count-1))
      for i in range(packet_count)] AS ts FROM slow_v, unnest([0.0, 0.01, 0.02, 0.05, 0.1, 0.2]::DOUBLE[]) l(loss),
      range(5) t(trial)),
  k AS (SELECT *, [i for i in range(packet_count) if {_PACKET} >= loss] AS drawn FROM c),
  kept AS (SELECT *, CASE WHEN len(drawn) > 0 THEN drawn
      ELSE [CAST(floor({_KEEP}*packet_count) AS BIGINT)] END AS ks FROM k)
  SELECT flow_id, loss, trial, CAST(CASE WHEN loss = 0 THEN packet_count
      ELSE greatest(1, round_even(packet_count*(len(ks)/packet_count), 0)) END AS BIGINT) AS packet_count,
    CAST(CASE WHEN loss = 0 THEN bytes_transferred
      ELSE round_even(bytes_transferred*(len(ks)/packet_count), 0) END AS BIGINT) AS bytes_transferred,
    round(CASE WHEN loss > 0 AND len(ks) >= 2 THEN greatest(ts[ks[-1]+1] - ts[ks[1]+1], 0.001)
      ELSE duration_seconds END, 3)::DOUBLE AS duration_seconds FROM kept""", ["slow_v"])
def _(v):
    # The supplier table is a small file, which one task would read and multiply.
    out = E.packet_loss_resample(v.slow, partitions=int(v.spark.conf.get("spark.sql.shuffle.partitions")))
    return out.select("flow_id", "loss", "trial", "packet_count", "bytes_transferred",
                      F.round("duration_seconds", 3).alias("duration_seconds"))


@query("loss_study")
def _(v):
    return E.loss_study(cut_lineage(_labelled(v)), _found)


_RATES = f"""{_DET}, rates AS (SELECT label AS metric, CASE WHEN label LIKE 'benign%' THEN 'false_positive'
    ELSE 'detection' END AS kind, round(avg(CASE WHEN len(cs) > 0 THEN 1 ELSE 0 END), 4)::DOUBLE AS rate
  FROM out GROUP BY label)"""


def _rates(v, shift: float = 0.0):
    flows = _labelled(v)
    table = E.per_class_detection_rate(flows.select("flow_id", "label"), _found(flows))
    kind = F.when(F.col("label").startswith("benign"), "false_positive").otherwise("detection")
    return table.select(F.col("label").alias("metric"), kind.alias("kind"),
                        F.round(F.col("any_alert") + shift, 4).alias("rate"))


@query("regression_gate", f"""WITH {_RATES} SELECT metric, kind, rate AS baseline,
    round(rate - 0.01, 4) AS current, kind = 'false_positive' AS holds FROM rates""", ["flows_v"])
def _(v):
    return E.regression_gate(_rates(v), _rates(v, -0.01))


@query("gate_passes", f"""WITH {_RATES} SELECT coalesce(bool_and(kind = 'false_positive'), true) AS passes
    FROM rates""", ["flows_v"])
def _(v):
    return E.gate_passes(E.regression_gate(_rates(v), _rates(v, -0.01)))


def _language_metrics(v, value):
    return v.table("documents").where("lang is not null").groupBy(F.col("lang").alias("artifact")).agg(
        value.cast("string").alias("value")).withColumn("metric", F.lit("texts"))


@query("stale_artifacts", """SELECT lang AS artifact FROM documents WHERE lang IS NOT NULL GROUP BY lang
    HAVING count(*) <> count(DISTINCT text)""")
def _(v):
    # Stored figures count all texts of a language, the fresh ones each text once.
    def rolled(rows):
        return E.evaluation_rollup(rows, [r["artifact"] for r in rows.select("artifact").collect()])
    return E.stale_artifacts(rolled(_language_metrics(v, F.count(F.lit(1)))),
                             rolled(_language_metrics(v, F.count_distinct("text"))))


@query("evaluation_rollup", """WITH a AS (SELECT lang AS artifact, count(*) AS n FROM documents GROUP BY 1)
  SELECT w AS artifact, CASE WHEN n IS NULL THEN 'unavailable' ELSE 'available' END AS status,
    CASE WHEN n IS NOT NULL THEN '{"rows":"' || CAST(n AS VARCHAR) || '"}' END AS metrics
  FROM (SELECT artifact FROM a UNION SELECT 'missing') t(w) LEFT JOIN a ON w = artifact""")
def _(v):
    found = v.table("documents").groupBy(F.col("lang").alias("artifact")).agg(
        F.count(F.lit(1)).cast("string").alias("value")).withColumn("metric", F.lit("rows"))
    wanted = [r["artifact"] for r in found.select("artifact").distinct().collect()]
    return E.evaluation_rollup(found, [*wanted, "missing"]).drop("fingerprint")


@query("threshold_eval", """WITH r AS (SELECT list_stddev_samp(gaps)/list_avg(gaps) < 0.1 AS hit,
    CAST(string_split(flow_id, '.')[4] AS INTEGER) % 60 < 10 AS y FROM gaps_v)
  SELECT count(*) FILTER (y AND hit) AS tp, count(*) FILTER (NOT y AND NOT hit) AS tn,
    count(*) FILTER (NOT y AND hit) AS fp, count(*) FILTER (y AND NOT hit) AS fn,
    round(avg(CASE WHEN y = hit THEN 1 ELSE 0 END), 4)::DOUBLE AS accuracy FROM r""", ["gaps_v"])
def _(v):
    from ..functions import coefficient_of_variation
    y = F.get(F.split("flow_id", r"\."), F.lit(3)).cast("int") % 60 < 10
    return E.threshold_eval(v.gaps, y, coefficient_of_variation(F.col("gaps")) < 0.1)


@query("length_confound_report", """WITH r AS (SELECT label, length(domain) AS l FROM names_v),
  s AS (SELECT round(avg(l) FILTER (label=0), 2) AS benign_len_mean,
    median(l) FILTER (label=0)::DOUBLE AS benign_len_median,
    CAST(min(l) FILTER (label=0) AS INTEGER) AS benign_len_min, CAST(max(l) FILTER (label=0) AS INTEGER) AS benign_len_max,
    round(avg(l) FILTER (label=1), 2) AS dga_len_mean, median(l) FILTER (label=1)::DOUBLE AS dga_len_median,
    CAST(min(l) FILTER (label=1) AS INTEGER) AS dga_len_min, CAST(max(l) FILTER (label=1) AS INTEGER) AS dga_len_max FROM r),
  b AS (SELECT greatest(benign_len_min, dga_len_min) lo, least(benign_len_max, dga_len_max) hi FROM s),
  o AS (SELECT round(100*avg(CASE WHEN l BETWEEN lo AND hi THEN 1 ELSE 0 END) FILTER (label=0), 1)::DOUBLE AS length_overlap_benign_pct,
    round(100*avg(CASE WHEN l BETWEEN lo AND hi THEN 1 ELSE 0 END) FILTER (label=1), 1)::DOUBLE AS length_overlap_dga_pct FROM r, b),
  h AS (SELECT label, l, count(*) AS c FROM r GROUP BY ALL),
  a AS (SELECT sum(CASE WHEN p.l > q.l THEN 1.0 WHEN p.l = q.l THEN 0.5 ELSE 0 END * p.c * q.c)
      / sum(p.c * q.c) AS auc FROM h p, h q WHERE p.label = 1 AND q.label = 0)
  SELECT s.*, o.*, round(greatest(auc, 1 - auc), 4)::DOUBLE AS length_only_auc FROM s, o, a""", ["names_v"])
def _(v):
    return E.length_confound_report(v.names)


# ---------------------------------------------------------------------- models
def _names(v):
    return cut_lineage(M.name_matrix(v.names.dropDuplicates(["domain"])))


@query("train_dga")
def _(v):
    rows = E.stratified_split(_names(v), "label", "domain")
    model = M.train_dga(rows.where("is_train"))
    held = M.score_names(rows.where("NOT is_train"), model).withColumn(
        "pred", (F.col("dga_probability") > 0.5).cast("int"))
    return E.binary_metrics(held, "label", "pred", "dga_probability")


@query("cross_validated_auc")
def _(v):
    return E.cross_validated_auc(_names(v))


@query("dga_detect")
def _(v):
    found = M.dga_detect(v.flows, M.train_dga(_names(v)))
    return found.select("flow_id", "threat_class", "severity", F.round("confidence", 6).alias("confidence"))


def _tls(v):
    """ClientHello features labelled by order priority, as a stand-in for known samples."""
    m = M.tls_matrix(v.flows.withColumn("sizes", F.array(
        F.col("bytes_transferred") % 1400, F.col("packet_count") % 600)), "sizes")
    return cut_lineage(m.withColumn("label", (F.col("ciphers_count") > 18).cast("int")))


@query("train_tls")
def _(v):
    rows = _tls(v)
    scored = M.train_tls(rows).transform(rows)
    return E.binary_metrics(scored, "label", "prediction")


@query("feature_importance_top")
def _(v):
    return M.feature_importance_top(v.spark, M.train_tls(_tls(v)))


@query("tls_malware_detect")
def _(v):
    rows = _tls(v)
    return M.tls_malware_detect(rows, M.train_tls(rows)).select(
        "flow_id", "threat_class", "severity", F.round("confidence", 6).alias("confidence"))


@query("fingerprint_lookup", """SELECT flow_id, f.ja3, 'malware' AS label FROM flows_v f JOIN
    (SELECT DISTINCT md5(CAST(c_custkey % 50 AS VARCHAR)) AS ja3 FROM customer WHERE c_custkey % 50 < 5) k
    ON f.ja3 = k.ja3""", ["flows_v"])
def _(v):
    key = F.col("c_custkey") % 50
    known = v.table("customer").where(key < 5).select(
        F.md5(key.cast("string")).alias("ja3"), F.lit("malware").alias("label"),
        F.lit("family").alias("family"))
    return M.fingerprint_lookup(v.flows, known).select("flow_id", "ja3", "label")


def _forest(v):
    from ..operators.common import with_rates
    rated = cut_lineage(with_rates(_labelled(v)))
    benign = rated.where(F.col("label").startswith("benign"))
    reference = benign.where(F.col("label") == "benign_keepalive")
    return rated, reference, M.isolation_forest(benign, ("pkt_rate", "byte_rate"))


@query("isolation_forest")
def _(v):
    rated, _reference, forest = _forest(v)
    return forest.transform(rated).groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean_score"),
        F.count_if(F.col("score") < 0).alias("anomalous"))


@query("ddos_calibration")
def _(v):
    _rated, reference, forest = _forest(v)
    return ddos.ddos_calibration(forest.transform(reference))


@query("ddos_isolation_forest")
def _(v):
    rated, reference, forest = _forest(v)
    known = ddos.ddos_calibration(forest.transform(reference))
    return ddos.ddos_forest_detect(forest.transform(rated), known) \
        .select("flow_id", "threat_class", "severity", "confidence")


@query("exfil_forest")
def _(v):
    from ..functions import one_sided_exfil_features
    # Stored, since fitting reads the flows twice and scoring once more.
    flows = cut_lineage(v.flows.select("flow_id", "bytes_transferred", "packet_count", "duration_seconds"))
    feats = flows.withColumn("_f", one_sided_exfil_features(
        F.col("bytes_transferred"), F.col("packet_count"), F.col("duration_seconds")))
    rows = feats.select("*", "_f.outbound_bytes_abs", "_f.bytes_per_packet", "_f.throughput_bytes_sec")
    names = ("outbound_bytes_abs", "bytes_per_packet", "throughput_bytes_sec")
    forest = M.isolation_forest(rows.where(~F.col("_f.exfil_likely")), names)
    scored = forest.transform(rows).drop("_f", *names)
    return exfil.exfil_rule(scored, "score").select("flow_id", "severity", "confidence")
