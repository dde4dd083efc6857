"""Learned detectors: boosted trees for names, a forest for TLS, isolation forests."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import registrable_label, size_sequence_stats, with_dga_features
from .common import detections, evidence, text

NAME_FEATURES = ("domain_entropy", "bigram_log_likelihood_2", "bigram_log_likelihood_3",
                 "consonant_vowel_ratio", "digit_ratio", "tld_length", "has_dictionary_word")
TLS_FEATURES = ("ciphers_count", "extensions_count", "curves_count", "point_formats_count",
                "mean_size", "median_size", "std_size", "min_size", "max_size")


# ------------------------------------------------------------- generated names
def name_matrix(names: DataFrame, name: str = "domain") -> DataFrame:
    return with_dga_features(names, name).withColumns(
        {c: F.col(c).cast("double") for c in NAME_FEATURES})


def train_dga(names: DataFrame, rounds: int = 200, features: Sequence[str] = NAME_FEATURES,
              seed: int = 42) -> PipelineModel:
    """Boosted trees over the name features; length is left out on purpose."""
    trees = GBTClassifier(labelCol="label", featuresCol="features", maxIter=rounds, stepSize=0.05,
                          maxDepth=5, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"),
                            trees]).fit(names)


def score_names(names: DataFrame, model: PipelineModel) -> DataFrame:
    scored = model.transform(names)
    return scored.withColumn("dga_probability", F.get(vector_to_array("probability"), F.lit(1))) \
                 .drop("features", "rawPrediction", "probability", "prediction")


def dga_detect(flows: DataFrame, model: PipelineModel) -> DataFrame:
    """Flows whose queried owner label scores above one half."""
    asked = flows.where(F.coalesce("dns_query", F.lit("")) != "") \
                 .withColumn("domain", registrable_label(F.col("dns_query")))
    p = F.col("_p")
    # Exploding keeps the hits and scores each row once; a filter would move below the column and score hits again.
    scored = score_names(name_matrix(asked), model).withColumnRenamed("dga_probability", "_all")
    hits = scored.withColumn("_p", F.explode(F.filter(F.array("_all"), lambda x: x > 0.5))) \
        .withColumn("_conf", F.greatest(p, 1 - p))
    items = F.array(
        evidence("domain_entropy", F.round("domain_entropy", 3), 0.3,
                 text("Domain entropy: %.3f", F.col("domain_entropy"))),
        evidence("bigram_log_likelihood_3", F.round("bigram_log_likelihood_3", 4), 0.25,
                 text("Bigram log-likelihood: %.4f", F.col("bigram_log_likelihood_3"))),
        evidence("digit_ratio", F.round("digit_ratio", 3), 0.2,
                 text("Digit ratio: %.3f", F.col("digit_ratio"))),
        evidence("consonant_vowel_ratio", F.round("consonant_vowel_ratio", 3), 0.15,
                 text("Consonant-vowel ratio: %.3f", F.col("consonant_vowel_ratio"))))
    return detections(hits, "dga", "dga", F.when(F.col("_conf") > 0.6, "high").otherwise("medium"),
                      F.col("_conf"), items, "boosted_trees_dga_v1")


# ------------------------------------------------------------------------ TLS
def tls_matrix(flows: DataFrame, sizes: str | None = None) -> DataFrame:
    """Flows with a fingerprint or ClientHello counts, and their nine features."""
    raw = F.col("raw_features")
    counts = {c: F.coalesce(F.try_element_at(raw, F.lit(c)), F.lit(0.0)) for c in TLS_FEATURES[:4]}
    listed = F.coalesce(F.arrays_overlap(F.map_keys(raw), F.array(*[
        F.lit(c) for c in TLS_FEATURES[:3]])), F.lit(False))
    stats = size_sequence_stats(F.col(sizes) if sizes else F.lit(None).cast("array<double>"))
    return flows.where((F.coalesce("ja3", F.lit("")) != "") | listed) \
                .withColumns(counts).withColumn("_s", stats).select("*", "_s.*").drop("_s")


def train_tls(samples: DataFrame, seed: int = 42) -> PipelineModel:
    """Balanced forest: 100 trees, depth 10, at least five rows per leaf."""
    # Only what the forest reads. A forest takes at most 100 classes, so their sizes are broadcast:
    # a join by label would gather each class in one task.
    rows = samples.select("label", *TLS_FEATURES)
    classes = rows.groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
    sizes = classes.agg(F.sum("_n").alias("_total"), F.count(F.lit(1)).alias("_k"))
    weighted = rows.join(F.broadcast(classes), "label").join(F.broadcast(sizes)).withColumn(  # one row
        "weight", F.col("_total") / (F.col("_k") * F.col("_n"))).drop("_n", "_total", "_k")
    stages = [VectorAssembler(inputCols=list(TLS_FEATURES), outputCol="raw"),
              StandardScaler(inputCol="raw", outputCol="features", withMean=True),
              RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=100,
                                     maxDepth=10, minInstancesPerNode=5, weightCol="weight",
                                     seed=seed)]
    return Pipeline(stages=stages).fit(weighted)


def top_importances(model: PipelineModel, names: Sequence[str] = TLS_FEATURES,
                    n: int = 5) -> list[tuple[str, float]]:
    shares = [(f, float(s)) for f, s in zip(names, model.stages[-1].featureImportances.toArray())]
    return sorted(shares, key=lambda x: -x[1])[:n]


def feature_importance_top(spark, model: PipelineModel, names: Sequence[str] = TLS_FEATURES,
                           n: int = 5) -> DataFrame:
    return spark.createDataFrame(top_importances(model, names, n),
                                 "feature string, importance double")


def tls_malware_detect(matrix: DataFrame, model: PipelineModel) -> DataFrame:
    scored = model.transform(matrix).where(F.col("prediction") == 1) \
        .withColumn("_conf", F.get(vector_to_array("probability"), F.lit(1)))
    items = F.array(*[
        evidence(name, F.round(name, 2), round(share, 4),
                 text(f"{name}: %.2f (importance: {share:.3f})", F.col(name)))
        for name, share in top_importances(model)])
    return detections(scored, "tls", "tls_malware",
                      F.when(F.col("_conf") > 0.7, "high").otherwise("medium"),
                      F.col("_conf"), items, "random_forest_ja3_v1")


def fingerprint_lookup(flows: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """Flows whose JA3 is on a labelled list, with label and family."""
    listed = fingerprints.groupBy("ja3").agg(F.min(F.struct("label", "family")).alias("_l")) \
                         .select("ja3", "_l.label", "_l.family")
    return flows.where(F.coalesce("ja3", F.lit("")) != "").join(listed, "ja3")


# ----------------------------------------------------------- isolation forest
def _average_path(n):
    """Expected depth of an unsuccessful search among ``n`` points."""
    n = np.asarray(n, dtype=float)
    harmonic = np.log(np.maximum(n - 1, 1)) + np.euler_gamma
    return np.where(n > 2, 2 * harmonic - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


#: Rows that go down a tree together, few enough to stay in a processor's cache.
_SCORED = 4_000
_NODES = "tree int, node int, feature int, threshold double, left int, right int, depth double"


def _grow(pdf: pd.DataFrame, features: Sequence[str], seed: int, max_depth: int) -> pd.DataFrame:
    tree = int(pdf["_tree"].iloc[0])
    points = pdf.sort_values("_pick")[list(features)].to_numpy(dtype=float)
    rng = np.random.default_rng([seed, tree])
    rows, queue = [], [(0, np.arange(len(points)), 0)]
    taken = 1
    while queue:
        node, members, depth = queue.pop()
        x = points[members]
        low, high = x.min(axis=0), x.max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth >= max_depth or len(members) <= 1 or not usable.size:
            rows.append((tree, node, -1, 0.0, -1, -1, depth + float(_average_path(len(members)))))
            continue
        feature = int(rng.choice(usable))
        cut = float(rng.uniform(low[feature], high[feature]))
        goes_left = x[:, feature] <= cut
        rows.append((tree, node, feature, cut, taken, taken + 1, 0.0))
        queue += [(taken, members[goes_left], depth + 1), (taken + 1, members[~goes_left], depth + 1)]
        taken += 2
    return pd.DataFrame(rows, columns=[c.split()[0] for c in _NODES.split(", ")])


@dataclass
class IsolationForest:
    """Fitted trees (a few hundred nodes each, so a fixed size) and the score offset."""

    features: tuple[str, ...]
    nodes: dict[str, np.ndarray]
    roots: np.ndarray
    sample: int
    offset: float = 0.0

    def raw_score(self, df: DataFrame) -> Column:
        shared = df.sparkSession.sparkContext.broadcast((self.nodes, self.roots))
        norm = float(_average_path(self.sample))

        levels = math.ceil(math.log2(self.sample))  # as deep as ``isolation_forest`` lets trees grow

        @F.pandas_udf("double")
        def score(*columns: pd.Series) -> pd.Series:
            nodes, roots = shared.value
            leaf = nodes["feature"] < 0
            here = np.arange(len(leaf))
            # A leaf leads back to itself, so that all rows go down as many levels.
            feature = np.where(leaf, 0, nodes["feature"])
            child = np.column_stack([np.where(leaf, here, nodes["right"]),
                                     np.where(leaf, here, nodes["left"])]).ravel()
            all_rows = np.column_stack([c.to_numpy(dtype=float) for c in columns])
            total = np.zeros(len(all_rows))
            for at_row in range(0, len(all_rows), _SCORED):
                x = all_rows[at_row:at_row + _SCORED]
                flat, first = x.ravel(), np.arange(len(x)) * x.shape[1]
                part = total[at_row:at_row + _SCORED]
                for root in roots:
                    at = np.full(len(x), root)
                    for _ in range(levels):
                        at = child[2 * at + (flat[first + feature[at]] <= nodes["threshold"][at])]
                    part += nodes["depth"][at]
            return pd.Series(-np.exp2(-total / len(roots) / norm))

        return score(*[F.col(f).cast("double") for f in self.features])

    def transform(self, df: DataFrame, name: str = "score") -> DataFrame:
        """Adds the decision score: negative is anomalous."""
        return df.withColumn(name, self.raw_score(df) - self.offset)


def isolation_forest(df: DataFrame, features: Sequence[str], ident: str = "flow_id",
                     trees: int = 100, sample: int = 256, contamination: float = 0.05,
                     seed: int = 42) -> IsolationForest:
    """Fit on benign rows. Each tree grows, in its own task, on a hash sample of 256 rows.

    Splits are uniform between a node's extremes, so scaling the features first would not
    change them. The offset is the contamination quantile of the training scores, from a
    mergeable sketch.
    """
    pick = F.xxhash64(F.col(ident).cast("string"), F.lit(seed))
    rows = df.select(ident, *[F.col(f).cast("double").alias(f) for f in features])
    pool = rows.withColumn("_pick", pick).orderBy("_pick", ident).limit(trees * sample)
    drawn = pool.withColumn("_tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))) \
                .withColumn("_pick", F.xxhash64(F.col("_pick"), F.col("_tree")))
    order = Window.partitionBy("_tree").orderBy("_pick", ident)
    chosen = drawn.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= sample)
    depth = math.ceil(math.log2(sample))
    grown = chosen.groupBy("_tree").applyInPandas(
        lambda pdf: _grow(pdf, features, seed, depth), _NODES)
    # At most trees * (2 * sample - 1) nodes: a bound that does not depend on the data.
    table = grown.toPandas().sort_values(["tree", "node"], ignore_index=True)
    base = table.groupby("tree").size().cumsum().shift(fill_value=0)
    shift = table["tree"].map(base).to_numpy()
    nodes = {"feature": table["feature"].to_numpy(), "threshold": table["threshold"].to_numpy(),
             "left": table["left"].to_numpy() + shift, "right": table["right"].to_numpy() + shift,
             "depth": table["depth"].to_numpy()}
    model = IsolationForest(tuple(features), nodes, base.to_numpy(), sample)
    cut = rows.select(model.raw_score(rows).alias("s")).agg(
        F.percentile_approx("s", contamination, 100_000)).first()[0]
    model.offset = float(cut)
    return model

