"""Whole runs: contexts to incidents, evaluation, ablation, audits."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from . import correlate as C
from . import detectors as D
from . import evaluate as E
from . import features as X
from . import flows as L
from . import ml as M
from . import windows as W


def union_signals(*parts: DataFrame) -> DataFrame:
    """Signals of several sources in one table, numbered in the order given."""
    return reduce(DataFrame.unionByName, [p.withColumn("source_order", F.lit(i)) for i, p in enumerate(parts)])


def provenance(detector: str = "detector", start: str = "window_start", end: str = "window_end", observed: tuple[str, ...] = (), version: str = "1.0.0") -> Column:
    """Who decided, why, from which features and over which window, as one struct."""
    return F.struct(F.col(detector).alias("detector_id"), F.lit(version).alias("detector_version"), F.col("reasons").alias("decision_reason"), F.struct(*observed).alias("observed_features") if observed else F.lit(None).alias("observed_features"), F.col(start).alias("window_start"), F.col(end).alias("window_end"))


def find(df: DataFrame, column: str, value) -> DataFrame:
    """The rows with that id; none is an empty table."""
    return df.where(F.col(column) == value)


def benign_only(df: DataFrame, label: str = "label") -> DataFrame:
    return df.where(F.col(label) == 0)


def column_group(df: DataFrame, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> DataFrame:
    """Columns that begin with one of ``include`` (all, if empty) and with none of ``exclude``."""
    chosen = [c for c in df.columns if (not include or c.startswith(include)) and not (exclude and c.startswith(exclude))]
    return df.select(*chosen)


def entity_events(contexts: DataFrame, flows: DataFrame, signals: DataFrame, history: int = 60) -> DataFrame:
    """Each entity's last z-score (three places), its known destinations and active signals; a snapshot has no new destinations."""
    z = W.pps_zscore(contexts, history=history).groupBy("entity").agg(F.round(F.max_by("zscore", F.struct("ts", "seq")), 3).alias("zscore"), F.count(F.lit(1)).alias("observations"))
    seen = W.first_seen_destination(flows).groupBy(F.col("src_ip").alias("entity")).agg(F.count_if("is_new_destination").alias("known_destinations"), F.max_by("is_new_destination", F.struct("ts", "seq")).alias("last_is_new"))
    active = D.active_signals(signals).groupBy("entity").agg(F.count(F.lit(1)).alias("active_signals"))
    return X.context_join(z, seen, active).withColumns({"active_signals": F.coalesce("active_signals", F.lit(0)), "new_destinations": F.lit(0)})


def _counted(df: DataFrame, path: str) -> tuple[DataFrame, Observation]:
    """Write a table, count its rows on the way, and read it back."""
    rows = Observation()
    df.observe(rows, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), rows


def run_pipeline(packets: DataFrame, gap_seconds: float = 300.0, flow_gap_seconds: float = 30.0, enabled: list[str] | None = None, ml: Callable[[DataFrame], DataFrame] | None = None, history: int = 60, folder: str | None = None) -> dict[str, DataFrame]:
    """Packets to flows, contexts, signals, incidents, alerts and counters.

    Each packet's context is the state of its flow and source by then, with
    the source's deviation from its own baseline. Rules run over the contexts
    in one scan; ``ml`` may add signals of other detector types from the same
    contexts.

    With ``folder``, flows, active signals, incidents and alerts are written
    there once each and read back, incidents and alerts from the signals as
    written, and ``stats`` are the counts observed while writing. Without,
    nothing is written, and every table, the counts too, is a plan of its own.
    """
    seen = Observation()
    flows = L.build_flows(packets.observe(seen, F.count(F.lit(1)).alias("n")) if folder else packets, f"{int(flow_gap_seconds)} seconds")
    contexts = W.pps_zscore(X.packet_contexts(packets, flow_gap_seconds), history=history)
    told = ("pps", "syn_ratio", "bytes_per_sec", "periodicity", "jitter", "unique_dst_ips", "unique_dst_ports", "outbound_bytes", "up_down_ratio", "zscore", "is_new_destination")
    signals = D.run_detectors(contexts, enabled, keep=("entity", "ts", "seq", "target", *told)).withColumn("detector_type", F.lit("DETERMINISTIC_BASELINE"))
    if ml:
        signals = signals.unionByName(ml(contexts), allowMissingColumns=True)
    grouped = C.group_signals(D.active_signals(signals), gap_seconds)
    rows = {"packets": seen}
    if folder:
        flows, rows["flows"] = _counted(flows, f"{folder}/flows")
        grouped, rows["signals"] = _counted(grouped, f"{folder}/signals")
    incidents = C.build_incidents(grouped.withColumn("evidence", C.evidence_items(grouped.columns)))
    if folder:
        incidents, rows["incidents"] = _counted(incidents, f"{folder}/incidents")
    alerts = C.build_alerts(grouped, incidents)
    if folder:
        alerts, rows["alerts"] = _counted(alerts, f"{folder}/alerts")
        stats = packets.sparkSession.createDataFrame([(k, o.get["n"]) for k, o in rows.items()], "counter string, n long")
    else:
        stats = run_stats(packets=packets, flows=flows, signals=grouped, incidents=incidents, alerts=alerts)
    return {"flows": flows, "contexts": contexts, "signals": signals, "incidents": incidents, "alerts": alerts, "stats": stats}


def run_stats(**tables: DataFrame) -> DataFrame:
    """A row with the number of rows of each table."""
    return reduce(DataFrame.unionByName, [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("counter"), "n") for k, t in tables.items()])


def evaluate_captures(packets: DataFrame, events: DataFrame, throttle_seconds: float = 1.0, tolerance_seconds: float = 5.0, min_confidence: float = 0.1, flow_gap_seconds: float = 30.0, enabled: list[str] | None = None) -> DataFrame:
    """Decisions of throttled instants against ground truth: ``decision_id, entity, peer, ts, predicted, truth``.

    Each source is judged at most once in ``throttle_seconds``, by the state
    that its flow and itself have by then. An instant's decision is its most
    confident active signal's class, BENIGN where none is active; its truth
    is the first listed event of its source or its destination. Packets with
    ``capture_id`` have state, and events, of their own capture alone;
    ``seq`` numbers the packets over all captures.
    """
    capture = ["capture_id"] if "capture_id" in packets.columns else []
    ends = packets.select(*capture, F.col("src_ip").alias("entity"), F.col("dst_ip").alias("peer"), "ts", "seq")
    instants = W.throttle(ends, [*capture, "entity"], throttle_seconds)
    # an address of one capture is not that address of another
    scoped = packets.withColumns({c: F.concat_ws("|", *capture, c) for c in ("src_ip", "dst_ip")}) if capture else packets
    contexts = X.packet_contexts(scoped, flow_gap_seconds, "half_open").join(instants.select("seq"), "seq", "left_semi")
    signals = D.run_detectors(contexts, enabled, keep=("entity", "ts", "seq"))
    top = D.top_signal(D.active_signals(signals, min_confidence), ("seq",)).select("seq", "predicted")
    decisions = instants.join(top, "seq", "left").select(F.col("seq").alias("decision_id"), *capture, "entity", "peer", "ts", F.coalesce("predicted", F.lit("BENIGN")).alias("predicted"))
    return E.align_ground_truth(decisions, events, tolerance_seconds)


# Which signal sources each mode takes.
MODES = {"rules": ("rules",), "classifier": ("classifier",), "anomaly": ("anomaly",), "fused": ("rules", "classifier", "anomaly")}


def ablate_modes(signals: DataFrame, truth: DataFrame, key: str = "decision_id") -> DataFrame:
    """Right and wrong decisions of each mode over the same instants, in one pass: signals are laid out by the modes that take them."""
    modes = F.array(*(F.struct(F.lit(m).alias("mode"), F.array(*map(F.lit, s)).alias("sources")) for m, s in MODES.items()))
    laid = signals.select("*", F.explode(modes).alias("m")).where(F.array_contains("m.sources", F.col("source"))).withColumn("mode", F.col("m.mode"))
    best = laid.groupBy(key, "mode").agg(F.max_by("threat_class", F.struct("confidence", "threat_class")).alias("predicted"))
    every = truth.select(key, "truth", F.explode(F.array(*map(F.lit, MODES))).alias("mode"))
    joined = every.join(best, [key, "mode"], "left").withColumn("predicted", F.coalesce("predicted", F.lit("BENIGN")))
    return joined.groupBy("mode").agg(F.count(F.lit(1)).alias("decisions"), F.count_if(F.col("predicted") == F.col("truth")).alias("correct"), F.count_if((F.col("truth") == "BENIGN") & (F.col("predicted") != "BENIGN")).alias("false_alarms"))


def train_val_gap(metrics: DataFrame, over: float = 0.05) -> DataFrame:
    """Training less validation for each metric; a macro F1 gap over the limit is overfitting."""
    gap = metrics.groupBy("metric").agg((F.max(F.when(F.col("split") == "train", F.col("value"))) - F.max(F.when(F.col("split") == "val", F.col("value")))).alias("gap"))
    return gap.withColumn("overfit", (F.col("metric") == "macro_f1") & (F.col("gap") > over))


def confidence_by_correctness(predictions: DataFrame) -> DataFrame:
    """Confidence of all, right and wrong predictions, by grouping sets in one pass."""
    p = predictions.withColumn("correct", F.col("predicted") == F.col("label"))
    return p.rollup("correct").agg(F.grouping("correct").alias("overall"), F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("mean"), F.min("confidence").alias("min"), F.max("confidence").alias("max"))


def importance_by_domain(importance: DataFrame, families: DataFrame) -> DataFrame:
    """Share of the gain by feature family."""
    total = importance.join(families, "feature", "left").groupBy(F.coalesce("family", F.lit("other")).alias("family")).agg(F.sum("gain").alias("gain"))
    return total.withColumn("share", F.col("gain") / F.sum("gain").over(Window.partitionBy()))


def top_features(importance: DataFrame, k: int = 20) -> DataFrame:
    return importance.orderBy(F.desc("gain"), "feature").limit(k)


def strongest_weakest_class(metrics: DataFrame) -> DataFrame:
    return metrics.where("f1 is not null").agg(F.max_by("name", F.struct("f1", "name")).alias("strongest"), F.min_by("name", F.struct("f1", "name")).alias("weakest"))


def prepare_dataset(splits: DataFrame, numeric: list[str], categorical: list[str], raw_label: str, entity: str, names: tuple[str, ...], split: str = "split") -> tuple[DataFrame, dict]:
    """Labels mapped, features filled and encoded by the training split; entities in two splits are an error."""
    leak = E.entity_leakage(splits, entity, split).take(1)
    if leak:
        raise ValueError(f"entity {leak[0][0]} stands in more than one split")
    state = M.fit_preprocessor(splits.where(F.col(split) == "train"), numeric, categorical)
    return M.apply_preprocessor(M.map_labels(splits, raw_label, names), state, [entity, split, "label"]), state


def single_feature_baselines(train: DataFrame, test: DataFrame, columns: list[str], label: str = "label", k: int = 15, bins: int = 10) -> DataFrame:
    """A small forest on each of the ``k`` features that tell most about the label."""
    best = [r["feature"] for r in E.mutual_information(train, columns, label, bins).orderBy(F.desc("mi")).limit(k).collect()]
    rows = [E.classification_metrics(M.predict_classes(M.train_forest(train, [c], label, 10, 5), test, [c]), label, "class_index").withColumn("feature", F.lit(c)) for c in best]
    return reduce(DataFrame.unionByName, rows)


def final_evaluation(models: dict, test: DataFrame, columns: list[str], label: str = "label", val: DataFrame | None = None) -> DataFrame:
    """Metrics of every fitted forest on the held-out split; with ``val``, also there, and validation less test."""
    parts = {"test": test} | ({"val": val} if val is not None else {})
    rows = [E.classification_metrics(M.predict_classes(m, df, columns), label, "class_index").withColumns({"model": F.lit(n), "split": F.lit(s)}) for n, m in models.items() for s, df in parts.items()]
    every = reduce(DataFrame.unionByName, rows)
    if val is None:
        return every
    of = lambda s, c: F.max(F.when(F.col("split") == s, F.col(c))).over(Window.partitionBy("model"))
    return every.withColumns({f"{c}_gap": of("val", c) - of("test", c) for c in ("accuracy", "macro_f1")})


def scores_under_noise(model, df: DataFrame, columns: list[str], percents: tuple[int, ...] = (5, 10, 20), label: str = "label", seed: int = 42) -> DataFrame:
    """Metrics of a fitted forest on features moved by up to each per cent, and how far they fall below the clean ones."""
    rows = [E.classification_metrics(M.predict_classes(model, M.perturb(df, columns, p / 100, seed) if p else df, columns), label, "class_index").withColumn("pct", F.lit(p)) for p in (0, *percents)]
    every = reduce(DataFrame.unionByName, rows)
    clean = every.where("pct = 0").select(F.col("accuracy").alias("clean_accuracy"), F.col("macro_f1").alias("clean_macro_f1"))
    # one row beside a row for each per cent
    told = every.join(clean).withColumns({"accuracy_drop": F.col("clean_accuracy") - F.col("accuracy"), "macro_f1_drop": F.col("clean_macro_f1") - F.col("macro_f1")})
    return told.drop("clean_accuracy", "clean_macro_f1")


def audit_report(df: DataFrame, columns: list[str], label: str, entity: str, split: str = "split", categories: tuple[str, ...] = (), families: dict[str, list[str]] | None = None) -> dict[str, DataFrame]:
    """The parts of an audit of a labelled table, each a table of its own.

    Violations, entities in more than one split, balance, statistics and
    centroids of classes, mutual information, folds by entity, single
    features, and a forest's training against its held-out metrics and under
    noise. ``categories`` adds how far each category of a column belongs to
    one class, ``families`` the metrics without and with each family alone.
    """
    train, test = df.where(F.col(split) == "train"), df.where(F.col(split) == "test")
    cv = M.cross_validate(df, columns, 3, label, 10, 5, group=entity)
    forest = M.train_forest(train, columns, label, 10, 5)
    metrics = [E.long_metrics(E.classification_metrics(M.predict_classes(forest, part, columns), label, "class_index"), ()).withColumn("split", F.lit(name)) for name, part in (("train", train), ("val", test))]
    report = {
        "centroids": E.class_centroids(df, columns, label), "folds": E.fold_summary(E.long_metrics(cv)), "single_features": single_feature_baselines(train, test, columns, label),
        "violations": M.validate_features(df, columns), "leakage": E.entity_leakage(df, entity, split), "balance": E.class_balance(df, label, split), "class_stats": E.class_feature_stats(df, columns, label),
        "information": E.mutual_information(df, columns, label), "gap": train_val_gap(reduce(DataFrame.unionByName, metrics)), "noise": scores_under_noise(forest, test, columns, label=label),
    }
    if categories:
        report["concentration"] = reduce(DataFrame.unionByName, [E.category_concentration(df, c, label).select(F.lit(c).alias("feature"), F.col("category").cast("string").alias("category"), "active", "dominant", "dominant_pct", "concentrated") for c in categories])
    if families:
        report["ablation"] = M.feature_ablation(train, families, test, label, 10)
    return report


def save_model(model, path: str, metadata: DataFrame) -> None:
    """An MLlib model with a one-row table of its features, labels and seed beside it."""
    model.write().overwrite().save(f"{path}/model")
    metadata.coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def load_model(kind, path: str, spark: SparkSession | None = None, features: list[str] | None = None, labels: list[str] | None = None):
    """The model; with a session, also its metadata as a table.

    With ``features`` or ``labels``, those that the model was saved with must
    be the same in the same order, and as many as it has weights for; else it
    is an error, as predictions would be of other columns or classes. They
    are columns of the metadata, arrays or texts parted by commas.
    """
    model = kind.load(f"{path}/model")
    if spark is None:
        return model
    metadata = spark.read.json(f"{path}/metadata")
    row = metadata.first()
    for name, want in (("features", features), ("labels", labels)):
        if want is None:
            continue
        saved = row[name] if name in metadata.columns else None
        saved = saved.split(",") if isinstance(saved, str) else saved
        if saved != list(want):
            raise ValueError(f"the model's {name} are {saved}, not {list(want)}")
    for name, want, attribute in (("features", features, "numFeatures"), ("classes", labels, "numClasses")):
        if want is not None and getattr(model, attribute, len(want)) != len(want):
            raise ValueError(f"the model has {getattr(model, attribute)} {name}, not {len(want)}")
    return model, metadata
