"""Declared schemas of the tables that are read; nothing is inferred."""

FIVE = "src_ip string, src_port int, dst_ip string, dst_port int, protocol int"
FLAGS = "tcp_syn long, tcp_ack long, tcp_fin long, tcp_rst long, tcp_psh long, tcp_urg long"
SCHEMAS = {
    "packets": f"seq long, ts timestamp, {FIVE}, packet_length long, {FLAGS}",
    "flows": f"{FIVE}, start_ts timestamp, end_ts timestamp, packet_count long, byte_count long, syn_count long, ack_count long, fin_count long, rst_count long, psh_count long, urg_count long",
    "dns_records": "key string, seq long, query string, rcode string, qtype string",
    "tls_records": "key string, seq long, ja3 string, ja4 string, sni string, alpn string",
    "alerts": "alert_id string, entity string, threat_class string, severity string, confidence double, summary string, incident_id string",
}
EVENT = "event_id string, traffic_class string, source_ips array<string>, time_window struct<start_time_iso: string, end_time_iso: string>"
MANIFEST = f"captures map<string, struct<primary_label: string, split: string, capture_start_iso: string, capture_end_iso: string, duration_sec: double, packet_count: long, labeled_events: array<struct<{', '.join(x.replace(' ', ': ', 1) for x in EVENT.split(', ', 3))}>>>>"
