"""Scalar functions: Column in, Column out, no Python per row."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Second-level labels that belong to a country's suffix.
SECOND_LEVEL = ("co", "com", "org", "net", "gov", "ac", "edu")
# IP protocol numbers by name.
PROTOCOLS = {6: "TCP", 17: "UDP", 1: "ICMP"}
# Severity by least confidence.
SEVERITY_BANDS = (("HIGH", 0.7), ("MEDIUM", 0.4), ("LOW", 0.1))


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def shannon_entropy(s) -> Column:
    """Bits per character over code points; the empty string has 0, null stays null."""
    s = _c(s)
    chars = F.split(s, "")
    n = F.length(s)
    shares = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
    bits = F.aggregate(shares, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))
    return F.when(s.isNull(), None).when(n == 0, 0.0).otherwise(bits)


def has_subdomain(query) -> Column:
    """More labels than a registered name has: over three, or three whose middle one is no country's second level."""
    labels = F.filter(F.split(F.lower(_c(query)), r"\."), lambda x: x != "")
    n = F.size(labels)
    country = F.element_at(labels, -2).isin(*SECOND_LEVEL) & (F.length(F.element_at(labels, -1)) == 2)
    return F.when(_c(query).isNull(), False).when(n <= 2, False).when(n == 3, ~country).otherwise(True)


def ramp(x, lo: float, hi: float) -> Column:
    """0 up to ``lo``, 1 from ``hi``, linear between; null stays null."""
    x = _c(x).cast("double")
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - lo) / (hi - lo))))


def min_threshold_score(observed, threshold: float) -> Column:
    """The share of the threshold that is reached, at most 1."""
    return F.lit(1.0) if threshold <= 0 else ramp(observed, 0.0, threshold)


def max_threshold_score(observed, threshold: float) -> Column:
    """1 at zero, 0 from the threshold on."""
    return F.when(_c(observed) <= 0, 1.0).otherwise(0.0) if threshold <= 0 else 1 - ramp(observed, 0.0, threshold)


def jitter_pct(mean, std) -> Column:
    return F.when(_c(mean) == 0, 0.0).otherwise(F.try_divide(_c(std), _c(mean)) * 100)


def periodicity_cv(mean, std) -> Column:
    """1 less the coefficient of variation, at least 0."""
    return F.when(_c(mean) == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.try_divide(_c(std), _c(mean))))


def periodicity_linear(jitter) -> Column:
    """1 at no jitter, 0 from 50 per cent."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - _c(jitter) / 50))


def anomaly_confidence(score, anomalous) -> Column:
    """Logistic of the decision value, steep by 20, in the verdict's direction; four places."""
    s = _c(score)
    return F.round(1 / (1 + F.exp(F.when(_c(anomalous), s).otherwise(-s) * 20)), 4)


def epoch_to_iso(micros) -> Column:
    return F.date_format(F.timestamp_micros(_c(micros)), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def iso_to_ts(text) -> Column:
    """The instant of an ISO-8601 text; null where it is none."""
    return F.try_to_timestamp(_c(text))


def epoch_seconds(ts) -> Column:
    return F.unix_micros(_c(ts)) / 1e6


def bucket_id(ts, width_seconds: float) -> Column:
    return F.floor(F.unix_micros(_c(ts)) / (width_seconds * 1e6)).cast("long")


def non_negative_finite(x) -> Column:
    """The number, or 0 where it is null, NaN, infinite or negative."""
    x = _c(x).cast("double")
    return F.when(x.isNull() | F.isnan(x) | (x == float("inf")), 0.0).otherwise(F.greatest(x, F.lit(0.0)))


def node_type(target) -> Column:
    """DOMAIN for dotted names; addresses and address ranges are EXTERNAL_IP."""
    t = _c(target)
    return F.when(t.rlike(r"\.") & ~t.rlike(r"^[0-9.]+(/[0-9]+)?$"), "DOMAIN").otherwise("EXTERNAL_IP")


def nonempty(x) -> Column:
    return F.nullif(F.trim(_c(x)), F.lit(""))


def protocol_name(protocol) -> Column:
    p = _c(protocol)
    out = F.when(p.isNull(), "N/A")
    for number, name in PROTOCOLS.items():
        out = out.when(p == number, name)
    return out.otherwise("UNKNOWN")


def severity_band(confidence) -> Column:
    c, out = _c(confidence), F
    for name, least in SEVERITY_BANDS:
        out = out.when(c >= least, name)
    return out.otherwise("INFO")


def ddos_severity_band(confidence) -> Column:
    return F.when(_c(confidence) >= 0.9, "CRITICAL").otherwise(severity_band(confidence))


def stable_id(prefix: str, *keys) -> Column:
    """A prefix and eight hex digits that depend on the keys alone."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *[_c(k).cast("string") for k in keys]), 256), 1, 8))


def scan_type(ips, ports, ip_threshold: int = 5, port_threshold: int = 5) -> Column:
    wide, deep = _c(ips) >= ip_threshold, _c(ports) >= port_threshold
    return F.when(wide & deep, "BROAD").when(wide, "HORIZONTAL").when(deep, "VERTICAL").otherwise("NONE")


def evidence_count(indicators) -> Column:
    return F.greatest(F.lit(1), F.coalesce(F.size(F.map_keys(_c(indicators))), F.lit(1)))


def register_sql(spark: SparkSession) -> None:
    """Make entropy, ramp and has_subdomain callable from SQL text, as SQL function bodies."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION ramp(x DOUBLE, lo DOUBLE, hi DOUBLE) RETURNS DOUBLE RETURN greatest(0.0D, least(1.0D, (x - lo) / (hi - lo)))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION shannon_entropy(s STRING) RETURNS DOUBLE RETURN CASE WHEN length(s) = 0 THEN 0.0D ELSE aggregate(transform(array_distinct(split(s, '')), c -> size(filter(split(s, ''), x -> x = c)) / length(s)), 0.0D, (a, p) -> a - p * log2(p)) END")
    names = ", ".join(f"'{x}'" for x in SECOND_LEVEL)
    labels = "filter(split(lower(q), '[.]'), x -> x <> '')"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION has_subdomain(q STRING) RETURNS BOOLEAN RETURN CASE WHEN q IS NULL OR size({labels}) <= 2 THEN false WHEN size({labels}) = 3 THEN NOT (element_at({labels}, -2) IN ({names}) AND length(element_at({labels}, -1)) = 2) ELSE true END")
