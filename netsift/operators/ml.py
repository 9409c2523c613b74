"""Preparation, classification and anomaly models over wide feature tables."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import anomaly_confidence
from .evaluate import classification_metrics, quantiles

# Class names in order of their index.
CLASS_NAMES = ("BENIGN", "VOLUMETRIC_DDOS", "BOTNET_C2_BEACONING", "DGA_DNS_TUNNELLING", "ENCRYPTED_MALWARE", "RECON_PORT_SCAN", "DATA_EXFILTRATION")
# The models' features in order.
FEATURE_NAMES = (
    "duration", "total_packets", "total_bytes", "bytes_forward", "bytes_backward", "packets_per_sec", "bytes_per_sec", "packet_size_mean", "iat_mean", "iat_std", "periodicity_score", "jitter", "burst_rate",
    "dns_query_count", "unique_domain_count", "domain_length_mean", "domain_entropy", "ngram_score", "dns_query_rate", "session_resumption", "tls_packet_size_mean",
    "unique_dst_ips", "unique_dst_ports", "connection_attempt_rate", "failed_connection_ratio", "fan_out", "outbound_bytes", "outbound_rate", "upload_download_ratio", "destination_count", "large_transfer_score",
    "entity_flow_count_1m", "entity_unique_destinations_1m", "entity_new_destinations_5m", "entity_avg_connection_interval", "entity_periodicity",
    "ja3_JA3_A", "ja3_JA3_B", "ja3_JA3_C", "ja3_JA3_D", "ja3_JA3_E", "ja4_JA4_A", "ja4_JA4_B", "ja4_JA4_C", "ja4_JA4_D", "ja4_JA4_E", "ja4_JA4_SUS_1", "ja4_JA4_SUS_2", "ja4_JA4_SUS_3",
    "tls_version_NONE", "tls_version_TLS1.2", "tls_version_TLS1.3",
)
# Which column or expression of a context fills a feature, where the names differ.
CONTEXT_FEATURES = {
    "duration": "duration_sec", "total_packets": "packet_count", "total_bytes": "byte_count", "packets_per_sec": "pps", "periodicity_score": "periodicity", "domain_length_mean": "query_length_mean", "domain_entropy": "entropy_mean",
    "connection_attempt_rate": "connection_rate", "failed_connection_ratio": "failed_ratio", "fan_out": "unique_dst_ips + unique_dst_ports", "upload_download_ratio": "up_down_ratio", "destination_count": "destinations",
    "large_transfer_score": "large_transfers", "entity_flow_count_1m": "flow_count", "entity_unique_destinations_1m": "unique_dst_ips",
}


def clean_features(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns in order as doubles; null, NaN and infinite become 0."""
    x = lambda c: F.col(c).cast("double")
    return df.withColumns({c: F.when(x(c).isNull() | F.isnan(x(c)) | (F.abs(x(c)) == float("inf")), 0.0).otherwise(x(c)) for c in columns})


def to_ml_features(contexts: DataFrame, keep: tuple[str, ...] = ("seq",)) -> DataFrame:
    """The models' features in order, as doubles, from what the contexts hold; 0 where that is nothing or not finite.

    Fingerprints and TLS versions become one column for each known value.
    """
    have = set(contexts.columns)

    def source(name: str):
        for prefix, column, form in (("ja3_JA3_", "ja3", "ja3_JA3_{}"), ("ja4_JA4_", "ja4", "ja4_JA4_{}"), ("tls_version_", "tls_version", "tls_version_{}")):
            if name.startswith(prefix):
                return (F.upper(column) == name[len(prefix) :]).cast("double") if column in have else F.lit(0.0)
        text = name if name in have else CONTEXT_FEATURES.get(name)
        return F.expr(text).cast("double") if text and set(re.findall(r"[a-z]\w+", text)) <= have else F.lit(0.0)

    x = {n: source(n) for n in FEATURE_NAMES}
    return contexts.select(*keep, *(F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v).alias(n) for n, v in x.items()))


def validate_features(df: DataFrame, columns: list[str], forbidden: tuple[str, ...] = (), label: str | None = None, classes: int = 7) -> DataFrame:
    """A row per violation: missing, forbidden, not numeric, null or not finite values, labels out of range."""
    spark = df.sparkSession
    types = dict(df.dtypes)
    found = [(c, "missing", 1) for c in columns if c not in types] + [(c, "forbidden", 1) for c in forbidden if c in types]
    numeric = [c for c in columns if types.get(c) in ("tinyint", "smallint", "int", "bigint", "float", "double") or types.get(c, "").startswith("decimal")]
    found += [(c, "not numeric", 1) for c in columns if c in types and c not in numeric]
    fixed = spark.createDataFrame(found, "column string, problem string, n long")
    checks = [F.struct(F.lit(c).alias("column"), F.lit("null or not finite").alias("problem"), F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf"))).alias("n")) for c in numeric]
    if label:
        checks.append(F.struct(F.lit(label).alias("column"), F.lit("label out of range").alias("problem"), F.count_if(F.col(label).isNull() | ~F.col(label).between(0, classes - 1)).alias("n")))
    if not checks:
        return fixed
    counted = df.agg(*(c.alias(f"c{i}") for i, c in enumerate(checks))).select(F.explode(F.array(*(F.col(f"c{i}") for i in range(len(checks))))).alias("c")).select("c.*").where("n > 0")
    return fixed.unionByName(counted)


def feature_name_diff(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns that are missing from the table, and those that it has besides."""
    rows = [(c, "missing") for c in columns if c not in df.columns] + [(c, "extra") for c in df.columns if c not in columns]
    return df.sparkSession.createDataFrame(rows, "column string, status string")


def map_labels(df: DataFrame, raw: str, names: tuple[str, ...] = CLASS_NAMES) -> DataFrame:
    """The label's index; an unknown name is an error when the row is read."""
    table = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])
    known = F.element_at(table, F.col(raw))
    return df.withColumn("label", F.when(known.isNull(), F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(F.col(raw), F.lit("null"))))).otherwise(known))


def fit_preprocessor(train: DataFrame, numeric: list[str], categorical: list[str]) -> dict:
    """Exact medians of the numeric columns and the sorted values of the categorical ones, in one pass each.

    Vocabularies are of fingerprint and version columns and come to the driver.
    """
    rows = train.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in numeric))).alias("p")).select("p.*")
    medians = {r["feature"]: r["q0"] for r in quantiles(rows, "value", [0.5], ("feature",)).collect()} if numeric else {}
    words = train.agg(*(F.array_sort(F.collect_set(c)).alias(c) for c in categorical)).first() if categorical else {}
    return {"medians": {c: medians.get(c) for c in numeric}, "words": {c: list(words[c]) for c in categorical}}


def apply_preprocessor(df: DataFrame, state: dict, keep: list[str] = ()) -> DataFrame:
    """Fill with the training medians, one-hot by the training vocabulary; unseen and null are all zeros."""
    filled = [F.coalesce(F.col(c).cast("double"), F.lit(m)).alias(c) for c, m in state["medians"].items()]
    hot = [F.coalesce((F.col(c) == w).cast("int"), F.lit(0)).alias(f"{c}_{w}") for c, ws in state["words"].items() for w in ws]
    return df.select(*keep, *filled, *hot)


def _assemble(df: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="__features", handleInvalid="error").transform(df)


def train_forest(df: DataFrame, columns: list[str], label: str = "label", trees: int = 100, depth: int = 15, seed: int = 42):
    model = RandomForestClassifier(featuresCol="__features", labelCol=label, numTrees=trees, maxDepth=depth, minInstancesPerNode=2, seed=seed)
    # the copy leaves the training summary behind: that holds the session, which no task can carry once it has observed metrics
    return model.fit(_assemble(df, columns)).copy()


def predict_classes(model, df: DataFrame, columns: list[str]) -> DataFrame:
    """Class index, its probability, and whether it is a threat."""
    p = vector_to_array("probability")
    out = model.transform(_assemble(df, columns)).withColumn("__p", p)
    return out.withColumns({"class_index": (F.array_position("__p", F.array_max("__p")) - 1).cast("int"), "class_confidence": F.array_max("__p")}).withColumn("is_threat", F.col("class_index") > 0).select(*df.columns, "class_index", "class_confidence", "is_threat")


def _side_by_side(spark: SparkSession, f: Callable, items: Iterable, parallelism: int) -> list:
    """``f`` of each item, some at a time: small fits leave most of a cluster idle, so their jobs share it."""
    with ThreadPoolExecutor(parallelism) as pool:
        return list(pool.map(inheritable_thread_target(spark)(f), items))


def train_boosted(df: DataFrame, columns: list[str], label: str = "label", classes: int | None = None, rounds: int = 20, rate: float = 0.05, depth: int = 5, seed: int = 42, validation: str | None = None, parallelism: int = 4) -> list:
    """One boosted model against the rest for each class, ``parallelism`` at a time over one cached input; with a validation flag, early stopping."""
    data = _assemble(df, columns).persist()
    n = classes or data.agg(F.max(label)).first()[0] + 1
    early = {"validationIndicatorCol": validation} if validation else {}

    def fit(k: int):
        gbt = GBTClassifier(featuresCol="__features", labelCol="__own", maxIter=rounds, stepSize=rate, maxDepth=depth, seed=seed, **early)
        return gbt.fit(data.withColumn("__own", (F.col(label) == k).cast("double")))

    models = _side_by_side(df.sparkSession, fit, range(n), parallelism)
    data.unpersist()
    return models


def predict_boosted(models: list, df: DataFrame, columns: list[str]) -> DataFrame:
    """The class whose model gives the largest probability, and its share of all."""
    out = _assemble(df, columns)
    for k, m in enumerate(models):
        out = m.transform(out).withColumn(f"__p{k}", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")
    p = F.array(*(F.col(f"__p{k}") for k in range(len(models))))
    total = F.aggregate(p, F.lit(0.0), lambda s, x: s + x)
    return out.withColumns({"class_index": (F.array_position(p, F.array_max(p)) - 1).cast("int"), "class_confidence": F.array_max(p) / total}).select(*df.columns, "class_index", "class_confidence")


def _path_norm(n: float) -> float:
    """The mean depth of an unsuccessful search among n."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def train_isolation_forest(df: DataFrame, columns: list[str], trees: int = 100, sample: int = 256, contamination: float = 0.05, seed: int = 42, id_col: str = "id") -> dict:
    """Isolation trees, each grown on its own sample in its own task; the offset is the scores' percentile.

    Samples are drawn by a hash of tree and row id, so a rerun draws the same.
    The trees' nodes, at most ``trees * 2 * sample`` rows, come to the driver.
    """
    n = df.count()
    p = min(1.0, 1.5 * sample / max(n, 1))
    draw = F.pmod(F.xxhash64(F.col(id_col), "tree", F.lit(seed)), F.lit(1 << 30))
    rows = df.select(id_col, *(F.col(c).cast("double").alias(c) for c in columns), F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")).withColumn("__d", draw).where(F.col("__d") < int(p * (1 << 30)))
    rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy("tree").orderBy("__d"))).where(F.col("__n") <= sample)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        rng = np.random.default_rng(seed * 100_003 + tree)
        x = pdf.sort_values("__n")[columns].to_numpy()
        limit, nodes, todo = math.ceil(math.log2(max(2, len(x)))), [], [(np.arange(len(x)), 0, -1, 0)]
        while todo:
            rows, depth, parent, side = todo.pop()
            me = len(nodes)
            nodes.append([tree, me, -1, 0.0, -1, -1, depth + _path_norm(len(rows))])
            if parent >= 0:
                nodes[parent][4 + side] = me
            spread = np.flatnonzero(np.ptp(x[rows], axis=0) > 0) if len(rows) > 1 else []
            if depth < limit and len(spread):
                f = int(rng.choice(spread))
                t = float(rng.uniform(x[rows, f].min(), x[rows, f].max()))
                nodes[me][2:4] = f, t
                left = x[rows, f] <= t
                todo += [(rows[~left], depth + 1, me, 1), (rows[left], depth + 1, me, 0)]
        return pd.DataFrame(nodes, columns=["tree", "node", "feature", "threshold", "left", "right", "path"])

    nodes = rows.groupBy("tree").applyInPandas(grow, "tree int, node int, feature int, threshold double, left int, right int, path double").toPandas()
    forest = [g.sort_values("node") for _, g in nodes.groupby("tree")]
    model = {"trees": [{c: g[c].to_numpy() for c in ("feature", "threshold", "left", "right", "path")} for g in forest], "columns": columns, "norm": _path_norm(min(sample, n)), "offset": 0.0}
    model["offset"] = anomaly_scores(model, df).transform(lambda s: quantiles(s, "decision", [contamination])).select("q0").first()[0] if n else 0.0
    return model


def anomaly_scores(model: dict, df: DataFrame) -> DataFrame:
    """``decision`` (lower is odder), the verdict below 0 and its confidence; trees are broadcast, rows scored in Arrow batches."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(*cols: pd.Series) -> pd.Series:
        m = shared.value
        x = np.stack([c.to_numpy(dtype=float) for c in cols], axis=1)
        total, at = np.zeros(len(x)), np.arange(len(x))
        for t in m["trees"]:
            node = np.zeros(len(x), int)
            while True:
                f = t["feature"][node]
                inner = f >= 0
                if not inner.any():
                    break
                down = x[at, np.maximum(f, 0)] <= t["threshold"][node]
                node = np.where(inner, np.where(down, t["left"][node], t["right"][node]), node)
            total += t["path"][node]
        mean = total / max(1, len(m["trees"]))
        return pd.Series(-np.power(2.0, -mean / max(m["norm"], 1e-9)))

    out = df.withColumn("decision", score(*(F.col(c).cast("double") for c in model["columns"])) - F.lit(model["offset"]))
    return out.withColumn("is_anomaly", F.col("decision") < 0).withColumn("anomaly_confidence", anomaly_confidence("decision", "is_anomaly"))


def with_folds(df: DataFrame, k: int = 5, label: str | None = None, group: str | None = None, seed: int = 42, id_col: str = "id") -> DataFrame:
    """A fold per row: whole groups together, or spread evenly within each label."""
    if group:
        return df.withColumn("fold", F.pmod(F.xxhash64(F.col(group), F.lit(seed)), F.lit(k)).cast("int"))
    order = Window.partitionBy(label).orderBy(F.xxhash64(F.col(id_col), F.lit(seed)))
    return df.withColumn("fold", (F.row_number().over(order) % k).cast("int"))


def cross_validate(df: DataFrame, columns: list[str], k: int = 5, label: str = "label", trees: int = 20, depth: int = 8, parallelism: int = 4, **folds) -> DataFrame:
    """Accuracy and macro metrics of a forest on each held-out fold; ``parallelism`` folds at a time, over one cached input.

    With ``group``, whole groups are held out, and a group in two folds is an
    error. The fold's predictions are counted before the cache is freed.
    """
    data = with_folds(df, k, label=label, **folds).persist()
    if folds.get("group") and data.groupBy(folds["group"]).agg(F.count_distinct("fold").alias("n")).where("n > 1").take(1):
        raise ValueError("a group stands in more than one fold")

    def judge(fold: int) -> DataFrame:
        model = train_forest(data.where(F.col("fold") != fold), columns, label, trees, depth)
        held = predict_classes(model, data.where(F.col("fold") == fold), columns)
        found = classification_metrics(held, label, "class_index").withColumn("fold", F.lit(fold))
        return df.sparkSession.createDataFrame(found.collect(), found.schema)  # one row

    out = reduce(DataFrame.unionByName, _side_by_side(df.sparkSession, judge, range(k), parallelism))
    data.unpersist()
    return out


def feature_ablation(df: DataFrame, groups: dict[str, list[str]], test: DataFrame, label: str = "label", trees: int = 20) -> DataFrame:
    """Metrics without each family of features, and with it alone."""
    every = [c for g in groups.values() for c in g]
    out = None
    for name, own in groups.items():
        for mode, columns in (("without", [c for c in every if c not in own]), ("only", own)):
            if columns:
                row = classification_metrics(predict_classes(train_forest(df, columns, label, trees, 8), test, columns), label, "class_index").withColumns({"family": F.lit(name), "mode": F.lit(mode)})
                out = row if out is None else out.unionByName(row)
    return out


def perturb(df: DataFrame, columns: list[str], share: float, seed: int = 42) -> DataFrame:
    """Each value times 1 + U(-share, share)."""
    return df.withColumns({c: F.col(c) * (1 - share + 2 * share * F.rand(seed + i)) for i, c in enumerate(columns)})
