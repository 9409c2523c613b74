import json
import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from netsift.plans import queries as plans
from netsift.plans import streams  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def compare(spark, small, name, sql, query):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    df = query(spark, small)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    expect = sorted((tuple(plain(dict(zip(names, r))[c]) for c in columns) for r in cursor.fetchall()), key=repr)
    assert got == expect, name


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query_equals_sql(spark, small, name):
    compare(spark, small, name, plans.ORACLE_SQL[name], plans.QUERIES[name])


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE_SQL)))
def test_query_gives_rows(spark, small, name):
    assert plans.QUERIES[name](spark, small).count() > 0


@pytest.fixture(scope="module")
def beyond(spark, small, tmp_path_factory):
    """The small tables with events of more than 65,536 users, and values whose texts end in a half."""
    folder = tmp_path_factory.mktemp("beyond")
    for t in TABLES:
        if t != "events":
            (folder / f"{t}.parquet").symlink_to(f"{small}/{t}.parquet")
    sql = f"SELECT event_id, ts, user_id % 20 + (event_id % 3) * 65530 AS user_id, event_type, CASE WHEN event_id % 2 = 0 THEN 108 + 56 * (event_id % 3) ELSE value END AS value, props FROM '{small}/events.parquet'"
    duckdb.connect().execute(f"COPY ({sql}) TO '{folder}/events.parquet'")
    return str(folder)


@pytest.mark.parametrize("name", ["capture_ranges", "stream_captures", "incidents", "incident_evidence", "incident_alerts"])
def test_query_equals_sql_beyond_the_small_tables(spark, beyond, name):
    compare(spark, beyond, name, plans.ORACLE_SQL[name], plans.QUERIES[name])


def test_frames_hold_addresses_of_four_bytes_only(spark, small):
    from netsift.sources.capture_source import encode_frames

    p = plans.V.packets(spark, small).limit(1)
    assert encode_frames(p).count() == 1
    with pytest.raises(Exception, match="not an IPv4 address: 10.0.351.3"):
        encode_frames(p.withColumn("src_ip", plans.F.lit("10.0.351.3"))).collect()


def test_manifest_is_a_document_for_each_capture(spark, small):
    from netsift.cluster import shared_dir

    root = Path(shared_dir(spark).removeprefix("file:"))
    before = set(root.glob("manifest-*"))
    assert plans.QUERIES["manifest_events"](spark, small).count() > 0
    (folder,) = set(root.glob("manifest-*")) - before
    assert sorted(len(json.loads(f.read_text())["captures"]) for f in folder.rglob("*.json")) == [1] * 7


def test_model_queries(spark, small):
    """What models learn is beyond SQL: their queries are held to the table they read and to what must hold of any model."""
    labels = {r.vec_id: r.label for r in spark.read.parquet(f"{small}/embeddings.parquet").where("label is not null").collect()}
    forest = {r.id: r for r in plans.QUERIES["forest_predictions"](spark, small).collect()}
    boosted = {r.id: r for r in plans.QUERIES["boosted_predictions"](spark, small).collect()}
    for found, least in ((forest, 0.7), (boosted, 0.4)):
        assert found.keys() == labels.keys() and all(found[i].label == labels[i] for i in labels)
        assert {r.class_index for r in found.values()} <= set(labels.values()) and all(1 / 10 < r.confidence <= 1 for r in found.values())
        learned = [found[i].class_index == labels[i] for i in labels if i % 5]
        assert sum(learned) > least * len(learned)
    assert all(r.is_threat == (r.class_index > 0) for r in forest.values())
    odd = {r.id: r for r in plans.QUERIES["anomaly_scores"](spark, small).collect()}
    assert odd.keys() == labels.keys() and all(r.is_anomaly == (r.decision < 0) for r in odd.values() if abs(r.decision) > 1e-6)
    assert 0 < sum(r.is_anomaly for r in odd.values()) <= 0.06 * len(odd) + 1 and all(0 <= r.anomaly_confidence <= 1 for r in odd.values())
    folds = plans.QUERIES["cross_validate"](spark, small).collect()
    assert sorted(r.fold for r in folds) == [0, 1, 2] and all(0 <= r[c] <= 1 for r in folds for c in r.asDict() if c != "fold")
    told = plans.QUERIES["combine_ml"](spark, small).collect()
    assert {r.sample_id for r in told} <= labels.keys() and {r.detector_type for r in told} <= {"LIGHTWEIGHT_ML", "UNSUPERVISED_ANOMALY"}
    assert all((r.threat_class == "UNKNOWN_ANOMALY") == (r.detector_type == "UNSUPERVISED_ANOMALY") for r in told)


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 15 and all(r.confidence >= 0.1 for r in rows)
