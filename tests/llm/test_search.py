"""Licence scans, hard negatives and ranked search against brute force, and on odd tables."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from netsift.llm import licences, negatives, queries, ranked
from netsift.llm.words import word_blocks, words_of
from tests.llm.test_operators import ODD, docs, prose

CLASHES = ("id", "key", "n", "at", "part", "body", "item", "rank", "score", "places", "spans", "label_", "w", "terms", "tfs")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def terms_of(text):
    return re.findall(WORD, lower(text))


def test_words_in_blocks():
    r = random.Random(5)
    text = "".join(r.choice("abZ9 .-_é\n\t中@[`{") for _ in range(5000))
    body = text.encode()
    assert [w.decode() for w in words_of(body)] == terms_of(text)
    for block in (1, 7, 100, 9999):
        assert [w for words in word_blocks(body, block) for w in words] == words_of(body)
    assert list(word_blocks(None)) == [] and list(word_blocks(b"")) == []


# --- licences


def base_brute(text):
    words, places = terms_of(text), []
    for phrase, label in licences.PHRASES.items():
        want = phrase.split()
        places += [(i, label) for i in range(len(words) - len(want) + 1) if words[i : i + len(want)] == want]
    return words, sorted(places)


def longest_brute(words, end, cut):
    """The longest run of words before ``end`` that some template holds, and all its ends there."""
    for n in range(min(end, max(map(len, cut))), 0, -1):
        ends = {(t, e) for t, c in enumerate(cut) for e in range(n, len(c) + 1) if c[e - n : e] == words[end - n : end]}
        if ends:
            return n, ends
    return 0, set()


def test_automaton_equals_brute_force():
    r = random.Random(2)
    for _ in range(30):
        cut = [[r.choice("abcd") for _ in range(r.randrange(1, 30))] for _ in range(4)]
        a = licences.Automaton({"a b": "x", "b": "y"}, [(str(i), " ".join(c)) for i, c in enumerate(cut)])
        named = [*cut, ["a", "b"], ["b"]]
        words = [r.choice("abcde") for _ in range(60)]
        s = length = 0
        for i, w in enumerate(words, 1):
            c = a.vocabulary.get(w.encode())
            while s and c not in a.steps[s]:
                s, length = a.links[s], a.lengths[a.links[s]]
            s, length = (a.steps[s][c], length + 1) if c in a.steps[s] else (0, 0)
            n, ends = longest_brute(words, i, named)
            assert length == n and a.places[s] == {(t, e) for t, e in ends if t < 4}
            assert sorted(x for size, x in a.phrases[s] if length >= size) == sorted(x for p, x in (("a b", "x"), ("b", "y")) if words[max(0, i - len(p.split())) : i] == p.split())


def matches_brute(words, cut, min_run):
    """Runs that some template holds and that go on in none of these with the next word."""
    found, before = {}, (0, set())
    for i in range(1, len(words) + 2):
        now = longest_brute(words, i, cut) if i <= len(words) else (0, set())
        if before[0] >= min_run and now[0] != before[0] + 1:
            for t, e in before[1]:
                found.setdefault(t, []).append((i - 1 - before[0], e - before[0], before[0]))
        before = now
    return {t: sorted(m) for t, m in found.items()}


@pytest.mark.parametrize("block", [1, 13, 1 << 20])
def test_scan_equals_brute_force(monkeypatch, block):
    monkeypatch.setattr(licences, "word_blocks", lambda body: word_blocks(body, block))
    r = random.Random(3)
    cut = [[r.choice("abcdefgh") for _ in range(n)] for n in (25, 30, 12)]
    phrases = {"a b": "x", "c d e": "y"}
    a = licences.Automaton(phrases, [(str(i), " ".join(c)) for i, c in enumerate(cut)])
    kept, named = {}, [*cut, *(p.split() for p in phrases)]
    licences_chain = licences.chain
    monkeypatch.setattr(licences, "chain", lambda m, size, need, gap: kept.setdefault(size, m) and licences_chain(m, size, need, gap))
    for _ in range(30):
        words = []
        for _ in range(r.randrange(1, 8)):
            t, i = r.choice(cut), r.randrange(12)
            words += t[i : i + r.randrange(3, 30)] + [r.choice("abxyz") for _ in range(r.randrange(4))]
        kept.clear()
        n, places, spans, share = licences.scan(" ".join(words).encode(), a, min_run=3, min_share=0.6, short=20, max_gap=5)
        # a run that goes on only inside a phrase goes on as well
        assert n == len(words) and kept == {len(cut[t]): m for t, m in matches_brute(words, named, 3).items() if t < 3}
        want = sorted((i, label) for p, label in phrases.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
        assert sorted(places) == want and 0 <= share <= 1
        for t, start, end, matched in spans:
            assert matched >= (12 if t == 2 else math.ceil(0.6 * len(cut[t]))) and end - start >= matched


def test_chain():
    # an edit within a template, another copy of it, and a match out of order
    assert licences.chain([(0, 0, 10), (12, 12, 8), (40, 0, 20)], 20, 12, 5) == [(0, 20, 18), (40, 60, 20)]
    assert licences.chain([(0, 10, 10), (12, 0, 8)], 20, 12, 5) == []
    assert licences.chain([(0, 0, 10), (8, 8, 8)], 20, 12, 5) == [(0, 16, 16)]
    assert licences.chain([(0, 0, 10), (20, 10, 10)], 20, 12, 5) == []


def test_licence_query_equals_brute_force(spark, small):
    got = {r.doc_id: r for r in queries.op11_licences(spark, small).collect()}
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    found = 0
    for r in rows:
        words, places = base_brute(r.text)
        g = got[r.doc_id]
        assert (g.n_words, g.n_base, g.first_word, g.last_word) == (len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None)
        assert g.base_labels == ",".join(sorted({x for _, x in places})) and {x for _, x in places} <= {x for x in g.labels.split(",") if x}
        assert 0 <= g.score <= 1 and (g.score > 0 or not places)
        found += bool(places)
    assert found


def test_licences_on_odd_rows(spark):
    mit = dict(licences.TEMPLATES[::-1])["MIT"]
    apache = licences.TEMPLATES[4][1]
    cut = mit.split()
    rows = [*ODD, (10, mit), (11, prose(1, 50) + "\n# " + "\n# ".join(mit.split("\n")) + "\n" + prose(2, 50)), (12, " ".join(cut[:80] + ["quite", "other"] + cut[83:])), (13, " ".join(cut[:60])),
            (14, apache + "\n" + prose(3, 20) + "\n" + mit), (15, "MIT License. Gnu GENERAL public-license; CC BY-NC 4.0"), (16, "x " * 300_000 + "mit license"), (17, "mit\u0000license mit éllicense")]
    df = docs(spark, rows).withColumns({c: F.lit(7) for c in CLASHES})
    out = licences.scan_licences(df)
    got = {r.doc_id: r for r in licences.digest(out).collect()}
    assert out.count() == len(rows) and licences.scan_licences(df.limit(0)).count() == 0
    assert got[1].n_words == got[2].n_words == 0 and got[1].labels == "" and got[1].score == 0 and got[1].first_word is None
    assert got[10].labels == "MIT" and got[10].score == 1 and got[11].labels == "MIT" and got[12].labels == "MIT" and 0.9 < got[12].score < 1
    assert got[13].labels == "" and 0.2 < got[13].score < 0.6
    assert got[14].labels == "Apache-2.0,MIT,apache" and got[14].n_base == 1
    assert got[15].base_labels == "cc-by,gpl,mit" and (got[15].first_word, got[15].last_word) == (0, 6)
    assert (got[16].n_words, got[16].first_word) == (300_002, 300_000) and got[17].n_base == 1
    span = out.where("doc_id = 11").first().spans[0]
    assert (span.start, span.end, span.label) == (50, 50 + len(words_of(mit.encode())), "MIT")


# --- hard negatives


def negatives_brute(rows):
    x = {}
    for i, v, label in rows:
        if i is None or label is None or not v or any(c is None or not math.isfinite(c) for c in v):
            continue
        one = ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * c) for c in v])
        x[i] = min(x.get(i, one), one)
    out = []
    for a, (label, v) in x.items():
        if a % 100:
            continue
        scored = sorted((-sum(p * q for p, q in zip(v, w)), i, m) for i, (m, w) in x.items() if i != a and len(w) == len(v))
        for ps, p, _ in [s for s in scored if s[2] == label][:5]:
            near = [(-s, i) for s, i, m in scored if m != label and 30 * -ps <= 100 * -s <= 90 * -ps][:10]
            out += [(a, p, k, i, -ps, s) for k, (s, i) in enumerate(near, 1)]
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit(7) for c in CLASHES})


def mined(df, **options):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    v = negatives.labelled_vectors(df, label=moved)
    return negatives.hard_negatives(v, v.where("vec_id % 100 = 0").selectExpr("vec_id AS anchor_id"), **options)


@pytest.mark.parametrize("spread", [0.02, 0.3])
def test_negatives_equal_brute_force(spark, spread):
    r = np.random.default_rng(7)
    centres = r.normal(size=(6, 12))
    rows = [(i, [float(x) for x in np.float32(centres[i % 6] * 0.3 + r.normal(size=12) * spread)], int(r.integers(0, 4))) for i in range(900)]
    rows += [(1000 + i, rows[5][1], 1) for i in range(100)]  # ties
    rows += [(2000, None, 1), (2100, rows[0][1], None), (2200, [], 2), (2300, [0.0] * 12, 2), (2400, [float("nan")] * 12, 1), (2500, [None] * 12, 1), (2600, [0.5, 0.5], 1), (2601, [0.5, 0.25], 1), (2602, [0.25, 0.25], 3), (None, rows[1][1], 2), (100, rows[100][1], rows[100][2])]
    df = vectors(spark, rows)
    want = negatives_brute(rows)
    assert len(want) > 200
    for block, anchors in ((64, 3), (16_384, 2048)):
        got = sorted(tuple(x) for x in mined(df.repartition(3), block=block, anchor_block=anchors).collect())
        assert got == want
    assert mined(df.limit(0)).count() == 0


def test_threshold_stops_early():
    # one direction that few rows have: what lies far down the lists is never read
    r = np.random.default_rng(1)
    v = r.integers(-40, 40, size=(20_000, 8))
    v[:40] = 300 + r.integers(0, 20, size=(40, 8))
    lists = negatives.Lists(np.arange(20_000), np.zeros(20_000, int), v)
    whole = np.array([-(2**62)]), np.array([2**62])
    w = negatives.Windows(*whole, 5)
    depth = negatives.search(lists, np.full(8, 100), -1, 0, True, w)
    assert depth < 200 and w.ids.tolist() == np.lexsort((np.arange(20_000), -(v.sum(axis=1))))[:5].tolist()


# --- ranked search


def ranked_brute(rows, items, k=20):
    cut = [(i, Counter(terms_of(t))) for i, t in rows]
    sizes = [sum(c.values()) for _, c in cut]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in cut for t in c)
    out = []
    for item, text in items:
        want, scored = Counter(terms_of(text)), []
        for (i, c), size in zip(cut, sizes):
            score = 0
            for t, times in want.items():
                if c[t]:
                    m = 75 + (25 * size * n) // total
                    score += times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
            if score > 0:
                scored.append((-score, i is not None, i or 0))
        out += [(item, rank, i if known else None, -s) for rank, (s, known, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("cells", "block_bytes"), [(16_000_000, 32 << 20), (3000, 1500)])
def test_ranking_equals_brute_force(spark, cells, block_bytes):
    r = random.Random(9)
    rows = [*ODD, *((100 + i, prose(i, r.randrange(1, 200), 300)) for i in range(400)), *((600 + i, prose(3, 50, 300)) for i in range(30)), (None, prose(3, 50, 300)), (700, "Zürich w1 W1 " * 3), (701, "w5 " * 5000)]
    items = [(i, prose(1000 + i, 25, 320)) for i in range(12)] + [(20, None), (21, ""), (22, "zürich A b"), (None, "w1 w2"), (23, prose(3, 50, 300)), (24, "unheard of"), (23, "w7")]
    df = docs(spark, rows).withColumns({c: F.lit(7) for c in CLASHES})
    bench = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit(1) for c in ("part", "item", "body", "doc_id")})
    out = ranked.rank_documents(df.repartition(3), bench, cells=cells, block_bytes=block_bytes)
    got = sorted((tuple(x[c] for c in ("item_id", "rank", "doc_id", "score")) for x in out.collect()), key=repr)
    assert got == ranked_brute(rows, items)
    for a, b in ((df.limit(0), bench), (df, bench.limit(0)), (df.where("doc_id < 3"), bench)):
        assert ranked.rank_documents(a, b).count() == 0


def test_best_positions_stop_early():
    # a term of few documents and one of all: most of the long list is never read
    n = 20_000
    rare = np.arange(30)
    terms = np.concatenate([np.zeros(n, int), np.ones(30, int)])
    doc = np.concatenate([np.arange(n), rare])
    order = np.argsort(doc, kind="stable")
    ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n))])
    lists = ranked.ImpactLists(np.arange(n), np.zeros(n, bool), 75 + np.arange(n) % 50, ends, terms[order], np.ones(n + 30, np.int64), np.array([10, 7000]))
    best = ranked.Best(20)
    scored, _ = ranked.search(lists, np.array([0, 1]), np.array([1, 1]), best)
    assert scored < 2000 and set(best.ids.tolist()) <= set(range(30))

