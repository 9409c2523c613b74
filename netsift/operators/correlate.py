"""Signals to correlation groups, incidents and alerts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import evidence_count, severity_band, stable_id

# Attack stage and recommended action of each threat class.
STAGES = {
    "RECON_PORT_SCAN": "RECONNAISSANCE",
    "DGA_DNS_TUNNELLING": "COMMAND_AND_CONTROL_STAGING",
    "BOTNET_C2_BEACONING": "C2_ESTABLISHMENT",
    "ENCRYPTED_MALWARE": "MALWARE_EXECUTION",
    "DATA_EXFILTRATION": "EXFILTRATION",
    "VOLUMETRIC_DDOS": "IMPACT_DENIAL_OF_SERVICE",
    "UNKNOWN_ANOMALY": "ANOMALOUS_BEHAVIOUR",
}
ACTIONS = {
    "VOLUMETRIC_DDOS": "Apply traffic rate limiting and upstream filter rules at gateway edge.",
    "RECON_PORT_SCAN": "Inspect source host for unauthorized discovery utilities or scanning tools.",
    "BOTNET_C2_BEACONING": "Isolate host endpoint; perform memory and process inspection for persistent C2 implant.",
    "DGA_DNS_TUNNELLING": "Sinkhole resolving domains and inspect local resolver logs for encoded tunnel queries.",
    "ENCRYPTED_MALWARE": "Correlate host process hash with JA3/JA4 fingerprint and terminate suspect process.",
    "DATA_EXFILTRATION": "Sever outbound communication path for host and audit transferred data volumes.",
    "UNKNOWN_ANOMALY": "Conduct forensic capture review on host baseline deviation.",
}
ACTION_ELSE = "Perform forensic investigation on active host."


def _lookup(table: dict[str, str], column: str, other: str) -> Column:
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.col(column)), F.lit(other))


def attack_stage(threat: str = "threat_class") -> Column:
    return _lookup(STAGES, threat, "UNKNOWN_STAGE")


def recommended_action(threat: str = "threat_class") -> Column:
    return _lookup(ACTIONS, threat, ACTION_ELSE)


def group_signals(signals: DataFrame, gap_seconds: float = 300.0, key: str = "entity", order: tuple[str, ...] = ("ts", "detector_order")) -> DataFrame:
    """Each signal with its group's number: a pause of an entity longer than the gap begins a group."""
    w = Window.partitionBy(key).orderBy(*order)
    pause = F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(w)
    return signals.withColumn("group_no", F.sum((F.coalesce(pause, F.lit(0)) > int(gap_seconds * 1e6)).cast("int")).over(w))


def risk(confidence: Column, classes: Column, types: Column, zscore: Column) -> Column:
    """Composite risk of the highest confidence, bonuses for several classes, several detector types and a deviating baseline."""
    more = F.least(F.lit(0.25), 0.1 * (classes - 1)) + F.when(types > 1, 0.1).otherwise(0.0)
    far = F.when(zscore > 2, F.least(F.lit(0.15), 0.03 * (zscore - 2))).otherwise(0.0)
    return F.least(F.lit(0.99), confidence + more + far)


def risk_severity(risk_column: Column, critical: Column, high: Column) -> Column:
    return F.when((risk_column >= 0.9) | critical, "CRITICAL").when((risk_column >= 0.7) | high, "HIGH").when(risk_column >= 0.4, "MEDIUM").otherwise("LOW")


def _risk_parts() -> list[Column]:
    """What a group's risk is made of; classes and types are few, so their sets are summed map-side without laying rows out twice."""
    return [
        F.count(F.lit(1)).alias("signals"), F.max("confidence").alias("c"), F.size(F.collect_set("threat_class")).cast("long").alias("classes"), F.size(F.collect_set("detector_type")).cast("long").alias("types"),
        F.coalesce(F.max("zscore"), F.lit(0.0)).alias("z"), F.bool_or(F.col("severity") == "CRITICAL").alias("crit"), F.bool_or(F.col("severity") == "HIGH").alias("hi"),
    ]


def _with_risk(a: DataFrame) -> DataFrame:
    a = a.withColumn("risk", risk(F.col("c"), F.col("classes"), F.col("types"), F.col("z")))
    return a.withColumn("severity", risk_severity(F.col("risk"), F.col("crit"), F.col("hi"))).drop("c", "types", "z", "crit", "hi")


def composite_risk(grouped: DataFrame, key: tuple[str, ...] = ("entity", "group_no")) -> DataFrame:
    """Risk and severity of whole groups."""
    a = grouped.groupBy(*key).agg(
        *_risk_parts()
    )
    return _with_risk(a).select(*key, "signals", "classes", "risk", "severity")


def risk_progression(grouped: DataFrame, key: tuple[str, ...] = ("entity", "group_no"), order: tuple[str, ...] = ("ts", "detector_order")) -> DataFrame:
    """The group's risk after each signal."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    classes = F.size(F.collect_set("threat_class").over(w))
    types = F.size(F.collect_set("detector_type").over(w))
    return grouped.withColumn("running_risk", risk(F.max("confidence").over(w), classes, types, F.coalesce(F.col("zscore"), F.lit(0.0))))


def active_groups(grouped: DataFrame, as_of, gap_seconds: float = 300.0, key: tuple[str, ...] = ("entity", "group_no")) -> DataFrame:
    last = grouped.groupBy(*key).agg(F.max("ts").alias("last_ts"))
    return last.where(F.unix_micros("last_ts") >= F.unix_micros(F.lit(as_of)) - int(gap_seconds * 1e6))


def threat_stages(signals: DataFrame) -> DataFrame:
    return signals.select("entity", "ts", "threat_class", attack_stage().alias("stage"), "confidence")


# Evidence texts by threat class, with the measured value of each.
EVIDENCE = (
    ("VOLUMETRIC_DDOS", "pps", "High packet velocity: %.1f packets/sec"),
    ("VOLUMETRIC_DDOS", "syn_ratio * 100", "Abnormal SYN flag ratio: %.1f%%"),
    ("VOLUMETRIC_DDOS", "bytes_per_sec / 1024", "Bandwidth volume: %.1f KB/s"),
    ("BOTNET_C2_BEACONING", "periodicity", "High connection periodicity: score %.2f / 1.00"),
    ("BOTNET_C2_BEACONING", "jitter", "Low timing jitter: %.1f%%"),
    ("BOTNET_C2_BEACONING", "connection_count", "Persistent repeated callbacks: %d connections"),
    ("DGA_DNS_TUNNELLING", "entropy_mean", "Elevated domain character entropy: %.2f"),
    ("DGA_DNS_TUNNELLING", "query_length_mean", "Abnormal query string length: mean %.1f chars"),
    ("DGA_DNS_TUNNELLING", "nullif(nxdomain_count, 0)", "High NXDOMAIN failure frequency: %d failures"),
    ("ENCRYPTED_MALWARE", "ja3", "Observable TLS JA3 fingerprint: %s"),
    ("ENCRYPTED_MALWARE", "ja4", "Observable TLS JA4 fingerprint: %s"),
    ("ENCRYPTED_MALWARE", "sni", "Target Server Name Indication (SNI): %s"),
    ("RECON_PORT_SCAN", "unique_dst_ports", "Rapid port discovery sweep: %d unique ports"),
    ("RECON_PORT_SCAN", "unique_dst_ips", "High destination fan-out: %d target IPs"),
    ("DATA_EXFILTRATION", "outbound_bytes / 1048576", "Large outbound transfer volume: %.2f MB"),
    ("DATA_EXFILTRATION", "up_down_ratio", "Asymmetric outbound byte ratio: %.1f"),
)


def told(value: Column) -> Column:
    """A number for a text: to nine places, so that the last bits, which depend on the order of a sum, tip no half; ``%.nf`` then rounds decimals half up."""
    return F.round(value.cast("double"), 9)


def evidence_items(columns: list[str]) -> Column:
    """Evidence texts of a signal from the feature columns at hand; a plain line where there is none."""
    lines = []
    for threat, value, text in EVIDENCE:
        if any(c in columns for c in re.findall(r"[a-z]\w+", value) if c != "nullif"):
            v = F.expr(value)
            v = v.cast("long") if "%d" in text else v.cast("string") if "%s" in text else told(v)
            lines.append(F.when((F.col("threat_class") == threat) & v.isNotNull(), F.format_string(text, v)))
    if "zscore" in columns:
        lines.append(F.when(F.col("zscore") > 2, F.format_string("Traffic velocity deviates significantly (+%.1fσ) from host baseline", told(F.col("zscore")))))
    if "is_new_destination" in columns:
        lines.append(F.when(F.col("is_new_destination"), F.lit("Target endpoint is a newly observed destination for this host")))
    found = F.array_compact(F.array(*lines)) if lines else F.array().cast("array<string>")
    plain = F.format_string("Automated detector signal: %s confidence %.2f", F.col("detector_type"), told(F.col("confidence")))
    return F.when(F.size(found) > 0, found).otherwise(F.array(plain))


def _at() -> Column:
    """A signal's place in time: signals of one instant go by their detectors' order."""
    return F.struct(F.unix_micros("ts").alias("us"), F.col("detector_order").alias("o"))


def incident_timeline(grouped: DataFrame, key: tuple[str, ...] = ("entity", "group_no")) -> DataFrame:
    """The stages of every incident in order of time, a row each: ``place`` counts from 1."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy("ts", "detector_order"))
    return grouped.select(*key, place.alias("place"), "ts", "threat_class", attack_stage().alias("stage"), "confidence")


def incident_evidence(grouped: DataFrame, key: tuple[str, ...] = ("entity", "group_no"), evidence: str = "evidence") -> DataFrame:
    """The different evidence texts of every incident, a row each: in how many signals, and where it first stood.

    Texts are summed by incident before the shuffle, so an incident that says
    one thing a million times is one row. ``place`` orders them by their first sight.
    """
    texts = grouped.select(*key, "ts", _at().alias("at"), F.posexplode(evidence).alias("no", "text"))
    told = texts.groupBy(*key, "text").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("at", "no")).alias("first"), F.min("ts").alias("first_ts"))
    place = F.row_number().over(Window.partitionBy(*key).orderBy("first", "text"))
    return told.select(*key, place.alias("place"), "text", "times", "first_ts")


def build_incidents(grouped: DataFrame, key: tuple[str, ...] = ("entity", "group_no"), evidence: str = "evidence", listed: bool = True) -> DataFrame:
    """One incident per group: first and last sight, the action of the most confident signal, and its risk.

    ``listed`` adds its stages and evidence in order of time as arrays, which
    are as long as the group; without, the row is of fixed size, whatever the
    group's (``n_stages`` counts), and ``incident_timeline`` and
    ``incident_evidence`` tell the same as rows.
    """
    body = grouped.groupBy(*key).agg(
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), *([F.array_sort(F.collect_list(F.struct(_at().alias("at"), attack_stage().alias("stage"), F.col(evidence).alias("evidence")))).alias("r")] if listed else []),
        F.max_by("threat_class", F.struct("confidence", -F.unix_micros("ts"), -F.col("detector_order"))).alias("main_class"), *_risk_parts(),
    )
    body = _with_risk(body).withColumns({"n_stages": F.col("signals"), "recommended_action": recommended_action("main_class")})
    if listed:
        body = body.withColumns({"stages": F.transform("r", lambda x: x["stage"]), "evidence_items": F.array_distinct(F.flatten(F.transform("r", lambda x: x["evidence"])))}).drop("r")
    return body.withColumn("incident_id", stable_id("INC-", *key, F.unix_micros("first_seen")))


def alert_summary(columns: list[str]) -> Column:
    """A sentence with the class, both ends and up to five measured values."""
    # Formats of the measured values.
    shown = (("pps", "%.1f pps"), ("syn_ratio", "SYN ratio %.2f"), ("periodicity", "periodicity %.2f"), ("jitter", "jitter %.1f%%"), ("entropy_mean", "DNS entropy %.2f"))
    parts = F.array_compact(F.array(*(F.when(F.col(c).isNotNull(), F.format_string(t, F.col(c))) for c, t in shown if c in columns)))
    details = F.when(F.size(parts) > 0, F.concat(F.lit(" ("), F.array_join(parts, ", "), F.lit(")"))).otherwise("")
    name = F.initcap(F.replace(F.col("threat_class"), F.lit("_"), F.lit(" ")))
    return F.concat(name, F.lit(" activity detected from "), F.col("entity"), F.lit(" toward "), F.coalesce(F.col("target") if "target" in columns else F.lit(None).cast("string"), F.lit("external infrastructure")), details, F.lit("."))


def build_alerts(signals: DataFrame, incidents: DataFrame | None = None, key: tuple[str, ...] = ("entity", "group_no")) -> DataFrame:
    """An alert per signal; with incidents, linked to the group's incident and told in its terms."""
    alert = signals.withColumns({"alert_id": stable_id("ALT-", "entity", F.unix_micros("ts"), "detector_order"), "summary": alert_summary(signals.columns), "evidence_count": evidence_count("indicators") if "indicators" in signals.columns else F.greatest(F.lit(1), F.size("reasons"))})
    if incidents is None:
        return alert
    own = incidents.select(*key, "incident_id", F.col("risk").alias("__r"), F.col("n_stages").alias("__n"))
    text = F.format_string("Correlated Incident %s: %s on %s (Risk: %.2f, Stages: %d)", "incident_id", "threat_class", "entity", told(F.col("__r")), "__n")
    return alert.join(own, list(key)).withColumn("summary", text).drop("__r", "__n")


def fused_prediction(progression: DataFrame, key: tuple[str, ...] = ("entity", "group_no"), min_risk: float = 0.4) -> DataFrame:
    """The class of the signal at the highest running risk; BENIGN below ``min_risk``."""
    best = progression.groupBy(*key).agg(F.max_by("threat_class", F.struct("running_risk", -F.unix_micros("ts"), -F.col("detector_order"))).alias("c"), F.max("running_risk").alias("risk"))
    return best.select(*key, F.when(F.col("risk") >= min_risk, F.col("c")).otherwise("BENIGN").alias("predicted"), "risk")


def latest(df: DataFrame, n: int, by: str = "ts", tie: str = "alert_id") -> DataFrame:
    """The last ``n`` rows (at most 1000)."""
    return df.orderBy(F.desc(by), tie).limit(min(n, 1000))


def combine_ml(classified: DataFrame, anomalies: DataFrame, key: str = "sample_id") -> DataFrame:
    """The classifier's threat where it has one, else the anomaly verdict, else nothing."""
    both = classified.join(anomalies, key)
    threat = F.col("class_index") > 0
    return both.where(threat | F.col("is_anomaly")).withColumns(
        {"threat_class": F.when(threat, F.col("class_name")).otherwise("UNKNOWN_ANOMALY"), "detector_type": F.when(threat, "LIGHTWEIGHT_ML").otherwise("UNSUPERVISED_ANOMALY"), "confidence": F.when(threat, F.col("class_confidence")).otherwise(F.col("anomaly_confidence"))}
    ).withColumn("severity", severity_band("confidence"))
