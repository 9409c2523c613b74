"""Ground truth, confusion matrices, metrics and data audits."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def align_ground_truth(decisions: DataFrame, events: DataFrame, tolerance_seconds: float = 5.0, bin_seconds: float = 86_400.0) -> DataFrame:
    """Each decision with the first listed event of either of its ends whose time, widened by the tolerance, holds it; else BENIGN.

    A decision's ends are ``entity`` and, where it has the column, ``peer``.
    Where both tables have ``capture_id``, events count within their capture
    only. Intervals are laid over time bins, and each (entity, bin) is swept
    once in order of time with the events begun so far in a heap, so that an
    entity with many events at once makes no pairs of decision and event.
    """
    tol, width = int(tolerance_seconds * 1e6), int(bin_seconds * 1e6)
    within = ["capture_id"] if "capture_id" in decisions.columns and "capture_id" in events.columns else []
    group = F.to_json(F.array(*(F.col(c).cast("string") for c in (*within, "__end", "bin")))).alias("key")
    lo, hi = F.unix_micros("start_ts") - tol, F.unix_micros("end_ts") + tol
    begun = events.select(*within, F.col("entity").alias("__end"), F.col("threat_class").alias("truth"), F.col("event_order").cast("long").alias("order"), lo.alias("at"), hi.alias("hi")).where("at <= hi").withColumn("bin", F.explode(F.sequence(F.floor(F.col("at") / width), F.floor(F.col("hi") / width))))
    ends = F.array_distinct(F.array("entity", *(["peer"] if "peer" in decisions.columns else [])))
    us = F.unix_micros("ts")
    asked = decisions.select("decision_id", *within, us.alias("at"), F.floor(us / width).alias("bin"), F.explode(ends).alias("__end")).where("at is not null")
    known = " and ".join(f"{c} is not null" for c in (*within, "__end"))
    steps = asked.where(known).select("decision_id", group, "at").unionByName(begun.where(known).select(group, "at", "hi", "order", "truth"), allowMissingColumns=True).select("decision_id", "key", "at", "hi", "order", "truth")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, open_, no = None, [], 0
        for batch in batches:
            rows, orders, truths = [], [], []
            for i, (key, at, hi, order, truth) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(1, 6)))):
                if key != here:
                    here, open_ = key, []
                if hi is not None:
                    no += 1
                    heapq.heappush(open_, (order, no, hi, truth))
                    continue
                # time only goes on: an event that has ended holds no later decision
                while open_ and open_[0][2] < at:
                    heapq.heappop(open_)
                if open_:
                    rows.append(i)
                    orders.append(open_[0][0])
                    truths.append(open_[0][3])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(orders, pa.int64()), pa.array(truths, pa.string())], names=["decision_id", "order", "truth"])

    swept = steps.repartition("key").sortWithinPartitions("key", "at", F.desc_nulls_last("hi"))
    hits = swept.mapInArrow(sweep, steps.select("decision_id", "order", "truth").schema).groupBy("decision_id").agg(F.min_by("truth", "order").alias("truth"))
    return decisions.join(hits, "decision_id", "left").withColumn("truth", F.coalesce("truth", F.lit("BENIGN")))


def events_overlapping(events: DataFrame, windows: DataFrame, bin_seconds: float = 86_400.0) -> DataFrame:
    """Pairs of event and window whose closed intervals meet, each pair once (in its first common bin)."""
    width = int(bin_seconds * 1e6)

    def laid(df, a, b):
        return df.withColumns({f"__{a}": F.unix_micros(a), f"__{b}": F.unix_micros(b)}).withColumn("bin", F.explode(F.sequence(F.floor(F.col(f"__{a}") / width), F.floor(F.col(f"__{b}") / width))))

    both = laid(events, "start_ts", "end_ts").join(laid(windows, "window_start", "window_end"), "bin")
    meet = F.greatest("__start_ts", "__window_start") <= F.least("__end_ts", "__window_end")
    return both.where(meet & (F.col("bin") == F.floor(F.greatest("__start_ts", "__window_start") / width))).drop("bin", "__start_ts", "__end_ts", "__window_start", "__window_end")


def confusion_matrix(decisions: DataFrame, classes: DataFrame) -> DataFrame:
    """Counts of every (truth, predicted), zeros included; ``classes`` is the small table of ``name``."""
    counts = decisions.groupBy("truth", "predicted").agg(F.count(F.lit(1)).alias("n"))
    names = classes.agg(F.collect_set("name").alias("names"))
    grid = names.select("names", F.explode("names").alias("truth")).select("truth", F.explode("names").alias("predicted"))
    return grid.join(counts, ["truth", "predicted"], "left").select("truth", "predicted", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def class_metrics(cm: DataFrame) -> DataFrame:
    """True and false positives and negatives and the rates of each class; undefined rates are null."""
    cells = cm.select(F.explode(F.array(F.struct(F.col("truth").alias("name"), F.lit(True).alias("is_truth"), (F.col("truth") == F.col("predicted")).alias("hit"), "n"), F.struct(F.col("predicted").alias("name"), F.lit(False).alias("is_truth"), (F.col("truth") == F.col("predicted")).alias("hit"), "n"))).alias("c")).select("c.*")
    n = F.col("n")
    zero = F.lit(0)
    sums = cells.groupBy("name").agg(
        F.sum(F.when(F.col("is_truth") & F.col("hit"), n).otherwise(zero)).alias("tp"), F.sum(F.when(~F.col("is_truth") & ~F.col("hit"), n).otherwise(zero)).alias("fp"),
        F.sum(F.when(F.col("is_truth") & ~F.col("hit"), n).otherwise(zero)).alias("fn"),
    )
    total = cm.agg(F.sum("n").alias("__all"))
    m = sums.join(F.broadcast(total)).withColumn("tn", F.col("__all") - F.col("tp") - F.col("fp") - F.col("fn")).withColumn("support", F.col("tp") + F.col("fn"))
    m = m.withColumns({"precision": F.try_divide("tp", F.col("tp") + F.col("fp")), "recall": F.try_divide("tp", "support"), "fpr": F.try_divide("fp", F.col("fp") + F.col("tn"))})
    f1 = F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    status = F.when(F.col("support") > 0, "TESTED").otherwise("NOT_TESTED")
    return m.withColumns({"f1": f1, "status": status}).drop("__all")


def summary_metrics(metrics: DataFrame, benign: str = "BENIGN") -> DataFrame:
    """Macro means over the threats that have values, the benign false-alarm rate and the threat miss rate."""
    threat, own = F.col("name") != benign, F.col("name") == benign
    return metrics.agg(
        F.avg(F.when(threat, F.col("precision"))).alias("macro_precision"), F.avg(F.when(threat, F.col("recall"))).alias("macro_recall"), F.avg(F.when(threat, F.col("f1"))).alias("macro_f1"),
        (1 - F.max(F.when(own, F.col("recall")))).alias("benign_false_alarm_rate"), F.max(F.when(own, F.col("fpr"))).alias("threat_miss_rate"),
    )


def binary_anomaly_metrics(decisions: DataFrame, benign: str = "BENIGN") -> DataFrame:
    attack, alarm = F.col("truth") != benign, F.col("predicted") != benign
    c = decisions.agg(F.count_if(attack & alarm).alias("tp"), F.count_if(~attack & alarm).alias("fp"), F.count_if(attack & ~alarm).alias("fn"), F.count_if(~attack & ~alarm).alias("tn"))
    c = c.withColumns({"precision": F.try_divide("tp", F.col("tp") + F.col("fp")), "recall": F.try_divide("tp", F.col("tp") + F.col("fn")), "false_alarm_rate": F.try_divide("fp", F.col("fp") + F.col("tn"))})
    return c.withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def values_at(df: DataFrame, value: str, ranks: dict[str, Callable[[Column], Column]], by: tuple[str, ...] = (), bins: int = 4096) -> DataFrame:
    """``by, n`` and, for each name, the value at a rank (from 0) that is given as a function of n; nulls do not count.

    Exact without sorting or gathering all: a histogram of equal ranges tells
    which range holds each rank, and only the values of those are counted.
    """
    keys = list(by) or ["__all"]
    x = df.where(F.col(value).isNotNull()).select(*by, *([] if by else [F.lit(0).alias("__all")]), F.col(value).cast("double").alias("__v"))
    ends = x.groupBy(*keys).agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"), F.count(F.lit(1)).alias("n"))
    width = F.col("__hi") - F.col("__lo")
    place = F.when(width > 0, F.least(F.lit(bins - 1), F.floor((F.col("__v") - F.col("__lo")) / width * bins))).otherwise(0).cast("int")
    placed = x.join(ends, keys).select(*keys, "__v", place.alias("__bin"))
    upto = Window.partitionBy(*keys).orderBy("__bin").rowsBetween(Window.unboundedPreceding, 0)
    hist = placed.groupBy(*keys, "__bin").agg(F.count(F.lit(1)).alias("__c")).withColumn("__end", F.sum("__c").over(upto)).withColumn("__begin", F.col("__end") - F.col("__c"))
    asked = ends.select(*keys, "n", F.explode(F.array(*(F.struct(F.lit(k).alias("name"), f(F.col("n")).cast("long").alias("rank")) for k, f in ranks.items()))).alias("a")).select(*keys, "n", "a.name", "a.rank")
    held = hist.join(asked, keys).where("rank >= __begin and rank < __end").select(*keys, "__bin", "__begin", "n", "name", "rank")
    counts = placed.join(held.select(*keys, "__bin").distinct(), [*keys, "__bin"], "left_semi").groupBy(*keys, "__bin", "__v").agg(F.count(F.lit(1)).alias("__c"))
    within = Window.partitionBy(*keys, "__bin").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("__stop", F.sum("__c").over(within))
    found = counts.join(held, [*keys, "__bin"]).where("rank < __begin + __stop and rank >= __begin + __stop - __c")
    out = found.groupBy(*keys, "n").agg(*(F.max(F.when(F.col("name") == k, F.col("__v"))).alias(k) for k in ranks))
    return out if by else out.drop("__all")


def quantiles(df: DataFrame, value: str, fractions: list[float], by: tuple[str, ...] = ()) -> DataFrame:
    """``by, n, q0, q1, ...``: exact quantiles, interpolated between the two values beside their place."""
    ranks = {}
    for i, q in enumerate(fractions):
        ranks |= {f"lo{i}": lambda n, q=q: F.floor((n - 1) * q), f"hi{i}": lambda n, q=q: F.ceil((n - 1) * q)}
    part = lambda q: (F.col("n") - 1) * q - F.floor((F.col("n") - 1) * q)
    return values_at(df, value, ranks, by).select(*by, "n", *((F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * part(q)).alias(f"q{i}") for i, q in enumerate(fractions)))


def latency_percentiles(df: DataFrame, value: str = "latency") -> DataFrame:
    """The interpolated median, and the value at position int(.95 n)."""
    at = values_at(df, value, {"lo": lambda n: F.floor((n - 1) / 2), "hi": lambda n: F.ceil((n - 1) / 2), "p95": lambda n: F.floor(n * 0.95)})
    return at.select(F.col("n").alias("total"), ((F.col("lo") + F.col("hi")) / 2).alias("median"), "p95")


def score_distribution(df: DataFrame, by: list[str], value: str = "score") -> DataFrame:
    q = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]
    sums = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    p = quantiles(df, value, q, tuple(by)).drop("n").withColumnsRenamed({f"q{i}": f"p{round(x * 100)}" for i, x in enumerate(q)})
    return sums.join(p, list(by), "left")


def threshold_sweep(scores: DataFrame, percents: tuple[int, ...] = (1, 5, 10, 15, 20, 25, 30), value: str = "score", attack: str = "is_attack") -> DataFrame:
    """Rates if the scores up to each percentile count as anomalous: one pass counts for all thresholds, which are a few numbers."""
    found = quantiles(scores, value, [p / 100 for p in percents]).first()
    if not found:
        return scores.sparkSession.createDataFrame([], "pct int, threshold double, tp long, fp long, fn long, tn long, precision double, recall double, fpr double, fnr double, accuracy double")
    bad, counts = F.col(attack), []
    for i, p in enumerate(percents):
        alarm = F.col(value) <= found[f"q{i}"]
        counts.append(F.struct(F.lit(p).alias("pct"), F.lit(found[f"q{i}"]).alias("threshold"), F.count_if(alarm & bad).alias("tp"), F.count_if(alarm & ~bad).alias("fp"), F.count_if(~alarm & bad).alias("fn"), F.count_if(~alarm & ~bad).alias("tn")).alias(f"c{i}"))
    c = scores.agg(*counts).select(F.explode(F.array(*(f"c{i}" for i in range(len(percents))))).alias("c")).select("c.*")
    c = c.withColumns({"precision": F.try_divide("tp", F.col("tp") + F.col("fp")), "recall": F.try_divide("tp", F.col("tp") + F.col("fn")), "fpr": F.try_divide("fp", F.col("fp") + F.col("tn"))})
    return c.withColumns({"fnr": 1 - F.col("recall"), "accuracy": (F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))})


def classification_metrics(predictions: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """Accuracy, and macro and support-weighted precision, recall and F1; division by zero counts 0."""
    pairs = predictions.select(F.col(label).cast("string").alias("truth"), F.col(predicted).cast("string").alias("predicted")).groupBy("truth", "predicted").agg(F.count(F.lit(1)).alias("n"))
    m = class_metrics(pairs).where("support > 0 or fp > 0")
    zero = F.lit(0.0)
    m = m.withColumns({c: F.coalesce(F.col(c), zero) for c in ("precision", "recall", "f1")})
    macro = [F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")]
    weighted = [(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(f"weighted_{c}") for c in ("precision", "recall", "f1")]
    return m.agg((F.sum("tp") / F.sum("support")).alias("accuracy"), *macro, *weighted)


def class_balance(df: DataFrame, label: str = "label", split: str = "split") -> DataFrame:
    counts = df.groupBy(split, label).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(split)))


def _long(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """(feature, value, label) rows by one scan."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns)))
    return df.select(F.col(label).alias("label"), pairs.alias("p")).select("label", "p.*")


def class_feature_stats(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    rows = _long(df, columns, label).where(F.col("label").isNotNull())
    out = rows.groupBy("feature", "label").agg(F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"))
    p = quantiles(rows, "value", [0.1, 0.5, 0.9], ("feature", "label")).drop("n").toDF("feature", "label", "p10", "median", "p90")
    return out.join(p, ["feature", "label"], "left")


def category_concentration(df: DataFrame, column: str, label: str, over: float = 70.0) -> DataFrame:
    """For each category: how many rows, the commonest class, its share, and whether that is over the limit."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("category"), F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    out = counts.groupBy("category").agg(F.sum("n").alias("active"), F.max_by("label", F.struct("n", "label")).alias("dominant"), (100.0 * F.max("n") / F.sum("n")).alias("dominant_pct"))
    return out.withColumn("concentrated", F.col("dominant_pct") > over)


def mutual_information(df: DataFrame, columns: list[str], label: str, bins: int = 10) -> DataFrame:
    """Bits that each feature's equal-width bins tell about the label, ranked; those over .85 of the best are flagged."""
    rows = _long(df, columns, label)
    ends = rows.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    bin_no = F.least(F.lit(bins - 1), F.floor((F.col("value") - F.col("lo")) / F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / bins).otherwise(1.0)))
    cells = rows.join(F.broadcast(ends), "feature").groupBy("feature", bin_no.alias("bin"), "label").agg(F.count(F.lit(1)).alias("n"))
    by = lambda *k: F.sum("n").over(Window.partitionBy("feature", *k))
    parts = cells.withColumns({"nb": by("bin"), "nl": by("label"), "all": by()})
    mi = parts.groupBy("feature").agg(F.sum(F.col("n") / F.col("all") * F.log2(F.col("n") * F.col("all") / (F.col("nb") * F.col("nl")))).alias("mi"))
    return mi.withColumn("flagged", F.col("mi") > 0.85 * F.max("mi").over(Window.partitionBy()))


def _digamma(n: Column) -> Column:
    """The digamma function of a whole number: its asymptotic series at n + 6, less the terms between."""
    x = n.cast("double") + 6
    series = F.log(x) - 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * F.pow(x, F.lit(4))) - 1 / (252 * F.pow(x, F.lit(6)))
    return series - sum((1 / (n + j) for j in range(1, 6)), 1 / n.cast("double"))


def neighbour_information(df: DataFrame, columns: list[str], label: str, k: int = 3, id_col: str = "id", sample: int | None = 5000, seed: int = 42) -> DataFrame:
    """What each number tells about the label, in nats, by nearest neighbours: ``feature, mi``, never negative.

    A row's distance to its ``k``-th nearest row of its class (of one column;
    the last, where the class has fewer) takes in ``m`` rows of any class, itself
    included, that are nearer (equal ones, where the distance is 0). The
    information is psi(N) + mean psi(k) - mean psi(class size) - mean psi(m);
    classes of one row take no part. Neighbours in order of value are found
    by lags within the class, ``m`` by a running count over rows and ends.
    Only the ``sample`` rows of least id hash are read; None reads all.
    """
    rows = df.where(F.col(label).isNotNull())
    if sample is not None:
        rows = rows.orderBy(F.xxhash64(F.col(id_col), F.lit(seed)), id_col).limit(sample)
    value = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns)))
    long = rows.select(F.col(id_col).alias("id"), F.col(label).alias("label"), value.alias("v")).select("id", "label", "v.feature", "v.x").where("x is not null and not isnan(x)")
    own = Window.partitionBy("feature", "label")
    order = own.orderBy("x", "id")
    gaps = [F.abs(side("x", j).over(order) - F.col("x")) for j in range(1, k + 1) for side in (F.lag, F.lead)]
    near = long.withColumns({"size": F.count(F.lit(1)).over(own), "gaps": F.array_sort(F.array_compact(F.array(*gaps)))}).where("size > 1")
    near = near.withColumn("k", F.least(F.lit(k), F.col("size") - 1).cast("int")).withColumn("d", F.element_at("gaps", F.col("k")))
    # rows below the upper end, less those up to the lower one; of distance 0, rows up to the value less those below it
    end = lambda x, o, sign: F.struct(x.alias("at"), F.lit(o).alias("o"), F.lit(0).alias("row"), F.lit(sign).alias("sign"))
    none = F.col("d") == 0
    ends = F.when(none, F.array(end(F.col("x"), 2, 1), end(F.col("x"), 0, -1))).otherwise(F.array(end(F.col("x") + F.col("d"), 0, 1), end(F.col("x") - F.col("d"), 2, -1)))
    point = F.struct(F.col("x").alias("at"), F.lit(1).alias("o"), F.lit(1).alias("row"), F.lit(0).alias("sign"))
    laid = near.select("feature", "id", "k", "size", F.explode(F.concat(F.array(point), ends)).alias("e")).select("feature", "id", "k", "size", "e.*")
    upto = Window.partitionBy("feature").orderBy("at", "o").rowsBetween(Window.unboundedPreceding, 0)
    m = laid.withColumn("below", F.sum("row").over(upto)).groupBy("feature", "id").agg(F.sum(F.col("below") * F.col("sign")).alias("m"), F.first("k").alias("k"), F.first("size").alias("size"))
    psi = lambda c: F.avg(_digamma(F.col(c)))
    mi = m.groupBy("feature").agg(F.greatest(F.lit(0.0), _digamma(F.count(F.lit(1))) + psi("k") - psi("size") - psi("m")).alias("mi"))
    return mi


def split_overlap(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    return a.select(column).intersect(b.select(column))


def entity_leakage(df: DataFrame, entity: str, split: str = "split") -> DataFrame:
    """Entities that stand in more than one split."""
    return df.groupBy(entity).agg(F.count_distinct(split).alias("splits")).where("splits > 1")


def top_confusions(cm: DataFrame, k: int = 5) -> DataFrame:
    return cm.where((F.col("truth") != F.col("predicted")) & (F.col("n") > 0)).orderBy(F.desc("n"), "truth", "predicted").limit(k)


def detection_by_condition(decisions: DataFrame, keys: list[str]) -> DataFrame:
    """For each condition, whether the expected class was ever predicted, and from how many signals."""
    hit = F.bool_or(F.col("predicted") == F.col("expected"))
    return decisions.groupBy(*keys).agg(F.when(hit, "DETECTED").otherwise("EVADED").alias("outcome"), F.count(F.lit(1)).alias("signals"))


def manifest_summary(captures: DataFrame) -> DataFrame:
    """Counts per class, per split and in all, by one pass over grouping sets."""
    captures.createOrReplaceTempView("__netsift_captures")
    return captures.sparkSession.sql("SELECT traffic_class, split, count(1) AS captures, sum(events) AS events FROM __netsift_captures GROUP BY GROUPING SETS ((traffic_class), (split), ())")


def class_centroids(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    return df.groupBy(label).agg(*(F.avg(c).alias(c) for c in columns))


def long_metrics(cv: DataFrame, keys: tuple[str, ...] = ("fold",)) -> DataFrame:
    """A row for each metric of each fold."""
    names = [c for c in cv.columns if c not in keys]
    return cv.select(*keys, F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names))).alias("m")).select(*keys, "m.*")


def fold_summary(cv: DataFrame) -> DataFrame:
    return cv.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
