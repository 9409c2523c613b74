"""Rule detectors: context rows to signal rows, in expressions only."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ddos_severity_band, max_threshold_score, min_threshold_score, ramp, severity_band

_0 = F.lit


def _reasons(*pairs: tuple[Column, str]) -> Column:
    """The names whose condition holds, in order."""
    return F.array_compact(F.array(*(F.when(cond, F.lit(name)) for cond, name in pairs)))


def _signal(threat: str, detector: str, score: Column, confidence: Column, severity: Column, reasons: Column) -> Column:
    return F.struct(F.lit(threat).alias("threat_class"), F.lit(detector).alias("detector"), score.alias("score"), confidence.alias("confidence"), severity.alias("severity"), reasons.alias("reasons"))


def ddos(pps: str = "pps", syn: str = "syn_ratio") -> Column:
    """Half for the packet rate (ramp 1000 to 5000 a second), half for a SYN share over .8; a share over .5 only gives a reason."""
    p, s = F.col(pps), F.coalesce(F.col(syn), F.lit(0.0))
    score = 0.5 * F.coalesce(ramp(p, 1000.0, 5000.0), F.lit(0.0)) + F.when(s > 0.8, 0.5).otherwise(0.0)
    # Reason names.
    reasons = _reasons((p > 5000, "critical_packet_velocity_exceeded"), ((p > 1000) & (p <= 5000), "suspicious_packet_velocity_observed"), (s > 0.8, "critical_tcp_syn_flood_ratio"), ((s > 0.5) & (s <= 0.8), "elevated_tcp_syn_ratio"))
    return _signal("VOLUMETRIC_DDOS", "ddos", score, score, ddos_severity_band(score), reasons)


def c2(periodicity: str = "periodicity", jitter: str = "jitter", observations: str = "observations", least: int = 5) -> Column:
    """.6 for periodicity and .4 for low jitter; few observations hold score and confidence down; no features, no score."""
    p, j, n = F.col(periodicity), F.col(jitter), F.coalesce(F.col(observations), F.lit(0))
    known = p.isNotNull() & j.isNotNull()
    full = F.least(p * 0.6, F.lit(0.6)) + F.when(j < 50, 0.4 * (1 - j / 50)).otherwise(0.0)
    few = n < least
    score = F.when(~known, 0.0).when(few, F.least(full, F.lit(0.4))).otherwise(full)
    confidence = F.when(~known, 0.0).when(few, F.least(score, F.lit(0.3))).otherwise(F.least(score, F.lit(0.85)))
    reasons = _reasons((p >= 0.8, "high_temporal_periodicity_observed"), (j <= 15, "low_inter_arrival_jitter_beacon"), (known & few, "insufficient_observations_penalty_applied"))
    return _signal("BOTNET_C2_BEACONING", "c2", score, confidence, severity_band(confidence), reasons)


# DNS components as column, ramp and weight.
DNS_PARTS = (("entropy_mean", 3.0, 4.5, 0.3), ("query_length_mean", 20.0, 50.0, 0.25), ("nxdomain_count", 2.0, 20.0, 0.2), ("txt_record_ratio", 0.1, 0.8, 0.15), ("subdomain_count", 5.0, 30.0, 0.1))


def _weighted(parts: tuple) -> tuple[Column, Column]:
    """The mean of the ramps that have data, and the weight of those."""
    total, weight = F.lit(0.0), F.lit(0.0)
    for name, lo, hi, w in parts:
        total = total + F.coalesce(ramp(name, lo, hi) * w, F.lit(0.0))
        weight = weight + F.when(F.col(name).isNotNull(), w).otherwise(0.0)
    return F.coalesce(F.try_divide(total, weight), F.lit(0.0)), weight


def dns() -> Column:
    """Weighted mean over the DNS features at hand; what is missing lowers the confidence, not the score."""
    score, weight = _weighted(DNS_PARTS)
    confidence = score * weight * 0.9
    reasons = _reasons((F.col("entropy_mean") >= 3.0, "high_shannon_domain_entropy"), (F.col("query_length_mean") >= 20, "elevated_dns_query_length"), (F.col("nxdomain_count") >= 2, "burst_nxdomain_responses"))
    return _signal("DGA_DNS_TUNNELLING", "dns", score, confidence, severity_band(confidence), reasons)


def encrypted(periodicity: str = "periodicity", jitter: str = "jitter") -> Column:
    """.3 for odd TLS metadata and .7 for beacon-like timing, by how complete the metadata is."""
    fields = [F.col(c) for c in ("ja3", "ja4", "sni", "alpn")]
    have = [f.isNotNull() & (f != "") for f in fields]
    complete = sum((h.cast("int") for h in have[1:]), have[0].cast("int")) / F.lit(4.0)
    odd = F.when(have[0] & ~have[2], 0.5).otherwise(0.0) + F.when(have[2] & ~have[3], 0.2).otherwise(0.0)
    p, j = F.col(periodicity), F.coalesce(F.col(jitter), F.lit(0.0))
    timing = F.least(F.least(p * 0.7, F.lit(0.7)) + F.when(j < 50, 0.3 * (1 - j / 50)).otherwise(0.0), F.lit(1.0))
    any_tls = have[0] | have[1] | have[2] | have[3]
    score = F.when(any_tls, odd * 0.3 + F.coalesce(timing, F.lit(0.0)) * 0.7).otherwise(0.0)
    confidence = score * complete * 0.85
    reasons = _reasons((have[0], "suspicious_ja3_fingerprint_match"), (any_tls & p.isNotNull(), "correlated_temporal_periodicity_observed"))
    return _signal("ENCRYPTED_MALWARE", "encrypted", score, confidence, severity_band(confidence), reasons)


# Reconnaissance and exfiltration components.
RECON_PARTS = (("unique_dst_ips", 3.0, 30.0, 0.35), ("unique_dst_ports", 5.0, 100.0, 0.35), ("connection_rate", 0.5, 20.0, 0.2), ("failed_ratio", 0.3, 0.9, 0.1))
EXFIL_PARTS = (("outbound_bytes", 1e7, 5e8, 0.35), ("outbound_rate", 1e5, 1e7, 0.3), ("up_down_ratio", 2.0, 50.0, 0.25), ("large_transfers", 1.0, 10.0, 0.1))


def recon() -> Column:
    """Weighted fan-out, port spread, rate and failures; too few flows give confidence .1 and no score."""
    total = F.lit(0.0)
    for name, lo, hi, w in RECON_PARTS:
        total = total + F.coalesce(ramp(name, lo, hi), F.lit(0.0)) * w
    score = F.when(F.col("sufficient"), total).otherwise(0.0)
    confidence = F.when(F.col("sufficient"), total * F.least(F.col("flow_count") / 3.0, F.lit(1.0)) * 0.9).otherwise(0.1)
    severity = F.when(F.col("sufficient"), severity_band(confidence)).otherwise("INFO")
    names = ("horizontal_host_sweep_fanout", "vertical_port_scan_fanout", "elevated_connection_attempt_rate", "high_failed_connection_ratio")
    tests = [(F.col(c) >= lo, name) for (c, lo, _, _), name in zip(RECON_PARTS, names)]
    return _signal("RECON_PORT_SCAN", "recon", score, confidence, severity, _reasons(tests[1], tests[0], *tests[2:]))


def exfil() -> Column:
    """Weighted volume, rate, ratio and large transfers, over those known; confidence falls with what is missing."""
    mean, weight = _weighted(EXFIL_PARTS)
    ok = F.col("sufficient") & F.col("direction_available")
    score = F.when(ok, mean).otherwise(0.0)
    confidence = F.when(ok, mean * F.least(F.col("flow_count") / 3.0, F.lit(1.0)) * weight * 0.9).otherwise(0.0)
    tests = [(F.col(c) >= lo) for c, lo, _, _ in EXFIL_PARTS]
    reasons = _reasons((tests[0], "high_outbound_byte_volume"), (tests[2], "high_upload_to_download_imbalance"), (tests[1], "elevated_outbound_byte_rate"), (tests[3], "large_transfer_frequency_observed"))
    return _signal("DATA_EXFILTRATION", "exfil", score, confidence, severity_band(confidence), reasons)


@dataclass(frozen=True)
class DetectorSpec:
    """A detector of one's own: a name, the columns it needs, and an expression that gives the signal struct."""

    name: str
    needs: tuple[str, ...]
    expr: Callable[[], Column]


@dataclass(frozen=True)
class PythonDetector:
    """A detector of one's own in Python, beside the expressions in one scan.

    ``evaluate`` takes a frame of the columns ``needs``, and gives one of
    ``score`` and ``confidence``, row for row, and ``reasons``, ``severity``
    and ``threat_class`` if it likes; the severity is else the confidence's
    band. Rows for which it raises have the error as their status and no
    signal; the others of the batch keep theirs.
    """

    name: str
    needs: tuple[str, ...]
    evaluate: Callable[[pd.DataFrame], pd.DataFrame]
    threat_class: str = "UNKNOWN_ANOMALY"

    def told(self, frame: pd.DataFrame) -> pd.DataFrame:
        """What ``evaluate`` gives for a frame, all columns filled."""
        found = self.evaluate(frame)
        if len(found) != len(frame):
            raise ValueError(f"{self.name} gave {len(found)} rows for {len(frame)}")
        out = pd.DataFrame({"threat_class": found.get("threat_class", self.threat_class), "score": found["score"].to_numpy(float), "confidence": found["confidence"].to_numpy(float)}, index=frame.index)
        out["severity"] = found["severity"].to_numpy() if "severity" in found else None
        out["reasons"] = list(found["reasons"]) if "reasons" in found else [[] for _ in range(len(out))]
        out["error"] = None
        return out

    def isolated(self, frame: pd.DataFrame) -> pd.DataFrame:
        """The same; where it raises, row by row, so that an error stays with the row that caused it."""
        if not len(frame):
            return self.failed(frame, "")
        try:
            return self.told(frame)
        except Exception as error:  # noqa: BLE001  anything that a detector may raise is a status, not the job's end
            if len(frame) == 1:
                return self.failed(frame, f"{type(error).__name__}: {error}")
        return pd.concat([self.isolated(frame.iloc[k : k + 1]) for k in range(len(frame))])

    def failed(self, frame: pd.DataFrame, error: str) -> pd.DataFrame:
        n = len(frame)
        return pd.DataFrame({"threat_class": [None] * n, "score": [None] * n, "confidence": [None] * n, "severity": [None] * n, "reasons": [[] for _ in range(n)], "error": [error] * n}, index=frame.index)

    def column(self) -> Column:
        @F.pandas_udf("threat_class string, score double, confidence double, severity string, reasons array<string>, error string")
        def run(frame: pd.DataFrame) -> pd.DataFrame:
            return self.isolated(frame)

        return run(F.struct(*self.needs))


BUILT_IN = (
    DetectorSpec("ddos", ("pps", "syn_ratio"), ddos),
    DetectorSpec("c2", ("periodicity", "jitter", "observations"), c2),
    DetectorSpec("dns", tuple(p[0] for p in DNS_PARTS), dns),
    DetectorSpec("encrypted", ("ja3", "ja4", "sni", "alpn", "periodicity", "jitter"), encrypted),
    DetectorSpec("recon", (*(p[0] for p in RECON_PARTS), "sufficient", "flow_count"), recon),
    DetectorSpec("exfil", (*(p[0] for p in EXFIL_PARTS), "sufficient", "flow_count", "direction_available"), exfil),
)


def detect(contexts: DataFrame, spec: DetectorSpec | str) -> DataFrame:
    """The contexts with one detector's signal columns."""
    spec = next(s for s in BUILT_IN if s.name == spec) if isinstance(spec, str) else spec
    return contexts.withColumn("__s", spec.expr()).select(*contexts.columns, "__s.*")


def run_detectors(contexts: DataFrame, enabled: list[str] | None = None, extra: tuple[DetectorSpec | PythonDetector, ...] = (), keep: tuple[str, ...] = ("entity", "ts")) -> DataFrame:
    """All enabled detectors over one scan: a signal row each, in registration order.

    A detector whose columns the contexts lack gives a row with the status
    ``no input``, one in Python that raises a row with the status ``error:``
    and what it raised. A name may be registered once.
    """
    specs = [*BUILT_IN, *extra]
    if len({s.name for s in specs}) < len(specs):
        raise ValueError("a detector of that name is registered already")
    chosen = [s for s in specs if enabled is None or s.name in enabled]
    there = {s.name: all(c in contexts.columns for c in s.needs) for s in chosen}
    # what is in Python runs before, in one step over the same rows
    python = {s.name: f"__python_{k}" for k, s in enumerate(chosen) if isinstance(s, PythonDetector) and there[s.name]}
    if python:
        contexts = contexts.withColumns({python[s.name]: s.column() for s in chosen if s.name in python})
    empty = F.lit(None)
    rows = []
    for k, s in enumerate(chosen):
        status = F.lit("ok" if there[s.name] else "no input")
        if not there[s.name]:
            body = _signal(None, s.name, empty.cast("double"), empty.cast("double"), empty.cast("string"), F.array().cast("array<string>"))
        elif s.name in python:
            p = F.col(python[s.name])
            severity = F.coalesce(p["severity"], F.when(p["error"].isNull(), severity_band(p["confidence"])))
            body = F.struct(p["threat_class"].alias("threat_class"), F.lit(s.name).alias("detector"), p["score"].alias("score"), p["confidence"].alias("confidence"), severity.alias("severity"), p["reasons"].alias("reasons"))
            status = F.when(p["error"].isNull(), "ok").otherwise(F.concat(F.lit("error: "), p["error"]))
        else:
            body = s.expr()
        rows.append(F.struct(F.lit(k).alias("detector_order"), status.alias("status"), *(body[f].alias(f) for f in ("threat_class", "detector", "score", "confidence", "severity", "reasons"))))
    return contexts.select(*keep, F.explode(F.array(*rows)).alias("s")).select(*keep, "s.*")


def detect_syn_flood(flows: DataFrame, min_packets: int = 20, min_seconds: float = 1.0, min_rate: float = 50.0, min_syn: float = 0.8, max_ack: float = 0.1) -> DataFrame:
    """Alerts for flows over all five thresholds; the confidence is the mean of their scores."""
    over = (F.col("packet_count") >= min_packets) & (F.col("duration_sec") >= min_seconds) & (F.col("packet_rate") >= min_rate) & (F.col("syn_ratio") >= min_syn) & (F.col("ack_ratio") <= max_ack)
    scores = [min_threshold_score("packet_count", min_packets), min_threshold_score("duration_sec", min_seconds), min_threshold_score("packet_rate", min_rate), min_threshold_score("syn_ratio", min_syn), max_threshold_score("ack_ratio", max_ack)]
    return flows.where(over).withColumns({"threat_class": F.lit("SYN_FLOOD_SUSPECTED"), "confidence": F.round(sum(scores[1:], scores[0]) / 5, 4), "severity": F.lit("HIGH")})


def active_signals(signals: DataFrame, min_confidence: float = 0.1) -> DataFrame:
    return signals.where((F.col("confidence") >= min_confidence) & (F.col("severity") != "INFO"))


def top_signal(signals: DataFrame, key: tuple[str, ...] = ("entity", "ts")) -> DataFrame:
    """The most confident signal's class (the first detector's on a tie)."""
    return signals.groupBy(*key).agg(F.max_by("threat_class", F.struct("confidence", -F.col("detector_order"))).alias("predicted"), F.max("confidence").alias("confidence"))
