"""The pipeline's stages, each on its own input, and the queries against SQL."""

import random
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from netsift.cluster import shared_dir
from netsift.llm import queries, simhash
from netsift.llm.common import stash, table
from netsift.llm.graph import components
from netsift.llm.simhash import shingles
from tests.llm.test_operators import docs
from tests.test_queries import compare


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, small, name):
    compare(spark, small, name, queries.ORACLE_SQL[name], queries.QUERIES[name])


def test_stages(spark, small):
    docs = table(spark, small, "documents")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text or "" for r in docs.collect()}
        docs = stash(stage(spark, docs, small), name)
        if name != "packing":
            assert docs.columns == columns
            seen[name] = (before, {r.doc_id: r.text or "" for r in docs.collect()})
    toxic = {r.doc_id: r.toxic for r in table(spark, small, "labels").collect()}
    before, after = seen["toxicity"]
    dropped = [toxic[i] for i in before if i in toxic and i not in after]
    assert sum(dropped) >= 0.6 * sum(toxic.values()) and dropped.count(0) <= 0.02 * len(toxic)
    before, after = seen["line_dedup"]
    assert set(before) == set(after)
    before, after = seen["near_dedup"]
    grams = {i: frozenset(shingles(t, 5)) for i, t in before.items()}
    ids = sorted(before)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            union = len(grams[a] | grams[b])
            if len(grams[a] & grams[b]) >= 0.8 * union:
                root[max(find(a), find(b))] = min(find(a), find(b))
    assert set(after) == {i for i in ids if find(i) == i}
    before, after = seen["decontamination"]
    bench = [" ".join(r.text.split()) for r in table(spark, small, "benchmark").collect()]
    dirty = {i for i, t in before.items() if any(b in " ".join(t.split()) for b in bench)}
    assert dirty == set(before) - set(after)
    assert {r.doc_id for r in docs.collect()} == set(after)


@pytest.mark.parametrize(("words", "edits"), [(15, 1), (20, 1), (30, 1), (50, 1), (50, 2), (110, 2)])
def test_near_duplicates_of_short_texts(spark, words, edits):
    """Pairs whose last words, or one in the middle of long ones, differ, against brute force."""
    r, rows = random.Random(words), []
    for i in range(300):
        text = [f"w{r.randrange(5000)}" for _ in range(words)]
        edited = [*text[: words - edits], *(f"x{r.randrange(5000)}" for _ in range(edits))]
        if words >= 50 and i % 2:  # one edit with five runs changed
            edited = [*text[:20], f"y{i}", *text[21:]]
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(edited))]
    grams = {i: frozenset(shingles(t, 5)) for i, t in rows}
    alike = [i for i in range(0, 600, 2) if len(grams[i] & grams[i + 1]) >= 0.8 * len(grams[i] | grams[i + 1])]
    kept = {x.doc_id for x in simhash.dedup(docs(spark, rows)).collect()}
    assert {i for i in range(0, 600, 2)} <= kept and len(alike) >= 150
    missed = [i for i in alike if i + 1 in kept]
    assert len(missed) <= 0.02 * len(alike) and all(i + 1 in kept for i in range(0, 600, 2) if i not in alike)


def test_strangers_that_share_a_passage_are_not_read(spark, monkeypatch):
    """Texts of one passage in common, and else different, are told apart by the bounds; those alike stay found, against brute force."""
    r, rows = random.Random(5), []
    for g in range(40):
        passage = [f"p{g}_{k}" for k in range(9)]
        for _ in range(12):
            own = [f"w{r.randrange(10**6)}" for _ in range(22)]
            rows.append((len(rows), " ".join([*own[:11], *passage, *own[11:]])))
        rows.append((len(rows), f"{rows[-1][1]} z"))
    grams = {i: frozenset(shingles(t, 5)) for i, t in rows}
    want = {i for i, _ in rows if not (i % 13 == 12 and len(grams[i] & grams[i - 1]) >= 0.8 * len(grams[i] | grams[i - 1]))}
    compared = []

    def counted(df, name, by=None):
        out = stash(df, name, by)
        if name == "pairs":
            compared.append(out.count())
        return out

    monkeypatch.setattr(simhash, "stash", counted)
    assert {x.doc_id for x in simhash.dedup(docs(spark, rows), segments=0).collect()} == want and len(want) == 480
    assert sum(compared) <= 80


def test_parities_differ_in_no_more_bits_than_sets():
    r = np.random.default_rng(3)
    for n, shared in ((1, 0), (40, 30), (700, 500), (4000, 0)):
        x = r.integers(0, 1 << 63, 2 * n - shared, dtype=np.uint64)
        a, b = simhash.parities(x[:n]), simhash.parities(x[n - shared :])
        assert len(a) == simhash.PARITIES // 64 and np.bitwise_count(a ^ b).sum() <= 2 * (n - shared)


def test_rounds_leave_one_table_of_few_files(spark):
    """A small graph is not written as a file for each partition, and each round's table goes when the next one is written."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    folder = Path(shared_dir(spark).removeprefix("file:"))
    before = set(folder.glob("edges-*"))
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        found = components(spark.range(200).selectExpr("id AS a", "id + 1 AS b"))
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    left = set(folder.glob("edges-*")) - before
    assert len(left) == 1 and len(list(left.pop().glob("*.parquet"))) == 1
    assert {(r.node, r.component) for r in found.collect()} == {(i, 0) for i in range(201)}
