"""Tables, splits, manifests and sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import MANIFEST, SCHEMAS


def read_table(spark: SparkSession, name: str, path: str, fmt: str = "parquet") -> DataFrame:
    """A table with its declared schema; rows that do not fit it are an error."""
    reader = spark.read.schema(SCHEMAS[name])
    return (reader if fmt == "parquet" else reader.option("mode", "FAILFAST").option("header", True)).format(fmt).load(path)


def read_labeled_splits(spark: SparkSession, folder: str, schema: str, splits: tuple[str, ...] = ("train", "val", "test")) -> DataFrame:
    parts = [spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(f"{folder}/{s}.csv").withColumn("split", F.lit(s)) for s in splits]
    return reduce(DataFrame.unionByName, parts)


def read_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Captures, their labelled events, and violations of order and containment."""
    raw = spark.read.schema(MANIFEST).option("multiLine", True).option("mode", "FAILFAST").json(path)
    captures = raw.select(F.explode("captures").alias("capture_id", "c")).select("capture_id", "c.*")
    t = F.try_to_timestamp
    captures = captures.withColumns({"start_ts": t("capture_start_iso"), "end_ts": t("capture_end_iso")})
    events = captures.select("capture_id", F.col("start_ts").alias("c0"), F.col("end_ts").alias("c1"), F.posexplode("labeled_events").alias("event_order", "e"))
    events = events.select("capture_id", "c0", "c1", "event_order", "e.*").withColumns({"start_ts": t(F.col("time_window.start_time_iso")), "end_ts": t(F.col("time_window.end_time_iso"))})
    bad_capture = captures.where("start_ts is null or end_ts is null or start_ts > end_ts").select("capture_id", F.lit(None).cast("string").alias("event_id"), F.lit("capture bounds").alias("problem"))
    order = events.where("start_ts is null or end_ts is null or start_ts > end_ts").select("capture_id", "event_id", F.lit("event order").alias("problem"))
    outside = events.where("start_ts < c0 or end_ts > c1").select("capture_id", "event_id", F.lit("event outside its capture").alias("problem"))
    return captures.drop("labeled_events"), events.drop("c0", "c1", "time_window"), bad_capture.unionByName(order).unionByName(outside)


def captures_by(captures: DataFrame, **values: str) -> DataFrame:
    """Captures of one class, split or both, by equality."""
    return captures.where(reduce(lambda a, b: a & b, [F.col(k) == v for k, v in values.items()], F.lit(True)))


def as_json(df: DataFrame) -> DataFrame:
    """One JSON text per row, keys in order."""
    return df.select(F.to_json(F.struct(*sorted(df.columns))).alias("json"))


def alerts_from_json(lines: DataFrame, column: str = "value") -> DataFrame:
    """Alerts from JSON texts; a malformed one is an error."""
    return lines.select(F.from_json(column, SCHEMAS["alerts"], {"mode": "FAILFAST"}).alias("a")).select("a.*")


def write_alerts(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def export_splits(df: DataFrame, folder: str, split: str = "split") -> DataFrame:
    """Write the rows by split and a manifest of their counts and columns; return the manifest."""
    df.write.mode("overwrite").partitionBy(split).parquet(f"{folder}/data")
    features = F.lit(",".join(c for c in df.columns if c != split))
    manifest = df.groupBy(split).agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", features)
    manifest.write.mode("overwrite").json(f"{folder}/manifest")
    return manifest


def stream_packets(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """A folder of packet tables as a stream, so many files at a time, oldest first."""
    return spark.readStream.schema(SCHEMAS["packets"]).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
