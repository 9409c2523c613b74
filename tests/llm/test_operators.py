"""Each operator against brute force, and its defined results on odd tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from netsift.llm import decontamination, html, lines, packing, passages, quality, queries, repeats, simhash, topk, toxicity
from netsift.llm.graph import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, extra=True):
    """Documents from (id, text[, source]); with columns whose names an operator might use itself."""
    df = spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows], SCHEMA)
    return df.withColumns({c: F.lit(7) for c in ("key", "id", "n", "line", "w", "at", "seed", "fp", "spans", "group")}) if extra else df


def prose(seed, n, vocabulary=5000):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


ODD = [(1, None), (2, ""), (None, "a b c"), (3, "a b c"), (3, "a b c"), (4, " \n\t "), (5, "x" * 5000), (6, "é ü\n" * 300)]


# --- line dedup


def line_brute(rows, least):
    sites, first = {}, {}
    order = lambda x: (x is not None, x or 0)
    for i, t, s in rows:
        for no, line in enumerate((t or "").split("\n") if t is not None else []):
            if line.strip(" "):
                sites.setdefault(line.strip(" "), set()).add(s)
                place = (order(i), no)
                first[line.strip(" ")] = min(first.get(line.strip(" "), place), place)
    out = []
    for i, t, _ in rows:
        if t is None:
            out.append((i, None))
            continue
        out.append((i, "\n".join(x for no, x in enumerate(t.split("\n")) if len(sites.get(x.strip(" "), ())) < least or first[x.strip(" ")] == (order(i), no))))
    return out


def test_lines_equal_brute_force(spark):
    r = random.Random(1)
    rows = [(i, "\n".join(r.choice(["all rights", "cookies ", f"own {i}", "", "rare"]) for _ in range(r.randrange(6))), f"s{r.randrange(14)}") for i in range(80)]
    rows += [(200, None, "s1"), (None, "all rights\nx", "s2"), (201, "", None)]
    got = [(x.doc_id, x.text) for x in lines.dedup_lines(docs(spark, rows), min_sites=8).collect()]
    assert sorted(got, key=repr) == sorted(line_brute(rows, 8), key=repr)


def test_lines_exact_near_the_threshold(spark):
    rows = [(i, "edge", f"s{i}") for i in range(9)] + [(100 + i, "over", f"s{i}") for i in range(10)]
    kept = [x.text for x in lines.dedup_lines(docs(spark, rows), min_sites=10, lg_k=4).collect()]
    assert kept.count("edge") == 9 and kept.count("over") == 1 and kept.count("") == 9
    out = lines.dedup_lines(docs(spark, rows), min_sites=10)
    assert out.columns == docs(spark, rows).columns


# --- repeats


def repeats_brute(rows, length):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if b[s : s + length] in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(b[s : s + length])
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), len(re.findall(b"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("options", [{}, {"salt_rows": 2, "shard_bytes": 3000}])
def test_repeats_equal_brute_force(spark, options):
    a, b = prose(1, 120), prose(2, 90)
    rows = [(i, t) for i, t in enumerate([a, prose(3, 40) + a[100:400] + prose(4, 30), b, b, a + b, "x" * 700, "xy" * 300, "xy" * 300 + a[:150], None, "", "short", "é" * 200, a[50:149], a[50:150]])]
    rows += [(30 + k, prose(50 + k, 20) + " " + a[:260] + " " + prose(70 + k, 20)) for k in range(8)] + [(None, a[:200])]
    got = repeats.remove_repeats(docs(spark, rows), **options).collect()
    assert sorted((tuple(r) for r in got), key=repr) == repeats_brute(rows, 100)


def test_repeats_in_long_runs(spark):
    # a run of one byte, and a text of one line over and over, with copies and parts of both
    rows = [(1, "x" * 1_000_000), (2, "one line\n" * 20_000), (3, "x" * 150 + "y"), (4, "one line\n" * 20_000), (5, "one line\n" * 15), (6, "x" * 1_000_000 + "z")]
    got = {r.doc_id: r for r in repeats.remove_repeats(docs(spark, rows)).collect()}
    assert (got[1].n_removed, got[1].n_spans) == (999_999, 1) and got[2].n_removed == 180_000 - 9
    assert (got[3].n_removed, got[5].n_removed, got[6].n_removed) == (150, 135, 1_000_000)
    assert (got[4].n_removed, got[4].n_spans, got[4].kept_sha256) == (180_000, 1, hashlib.sha256(b"").hexdigest())


def test_anchors_in_blocks_find_the_same_repeats():
    r = np.random.default_rng(9)
    data = r.integers(97, 100, 5000).astype(np.uint8)
    data[3000:3600] = data[1000:1600]
    ends = np.array([900, 2500, 5000])
    whole = repeats.anchors(data, ends, 100)
    for block in (64, 999):
        cut = repeats.anchors(data, ends, 100, block)
        # every start has the same anchor hash, whichever block it stands in
        spread = [np.repeat(x[0], x[2] - x[1] + 1) for x in (whole, cut)]
        places = [np.concatenate([np.arange(a, b + 1) for a, b in zip(x[1], x[2])]) for x in (whole, cut)]
        assert np.array_equal(*spread) and np.array_equal(*places) and np.array_equal(np.repeat(whole[3], whole[2] - whole[1] + 1), np.repeat(cut[3], cut[2] - cut[1] + 1))


def test_window_minima():
    x = np.random.default_rng(1).integers(0, 50, 500).astype(np.uint64)
    for width in (1, 2, 7, 81, 500):
        assert repeats._window_minima(x, width).tolist() == [min(x[i : i + width]) for i in range(500 - width + 1)]


def test_repeated_rows_are_one_document(spark):
    t = prose(9, 60)
    got = repeats.remove_repeats(docs(spark, [(1, t), (1, t)])).collect()
    assert [r.n_removed for r in got] == [0, 0]
    assert repeats.remove_repeats(docs(spark, ODD)).count() == len(ODD)
    assert repeats.remove_repeats(docs(spark, ODD).limit(0)).count() == 0


def test_suffix_array_and_prefixes():
    r = np.random.default_rng(3)
    for n, letters in ((1, 1), (2, 1), (400, 1), (700, 2), (999, 4)):
        x = r.integers(97, 97 + letters, n).astype(np.uint8)
        text = x.tobytes()
        sa = repeats.suffix_array(x)
        assert sa.tolist() == sorted(range(n), key=lambda i: text[i:])
        lcp = repeats.common_prefixes(x, sa, 50, lane=64)
        for k in range(1, n):
            a, b = text[sa[k - 1] :], text[sa[k] :]
            m = next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
            assert lcp[k] == min(m, 50)


def test_shards_of_repetitive_contexts():
    # pieces of a few long strings, cut and joined anew, so that many suffixes agree in a little more than the length
    r = random.Random(17)
    for _ in range(8):
        pool = ["".join(r.choice("abc ") for _ in range(60)) for _ in range(4)]
        contexts = [(i, i, 0, "".join(x[r.randrange(9) :] for x in r.choices(pool, k=r.randrange(1, 6))).encode()) for i in range(60)]
        doc, _, start, _, first, _, _ = repeats.shard_repeats(contexts, 40)
        seen, want = {}, set()
        for i, _, _, body in contexts:
            for s in range(len(body) - 39):
                if seen.setdefault(body[s : s + 40], (i, s)) != (i, s):
                    want.add((i, s))
        assert set(zip(doc[~first].tolist(), start[~first].tolist())) == want


# --- top-k


def test_topk_equals_brute_force(spark):
    r = np.random.default_rng(5)
    v = r.normal(size=(700, 12)).astype(np.float32)
    v[650:] = v[:50]  # ties
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (1000, [float("nan")] * 12), (1100, [None] * 12), (1200, []), (None, v[0].tolist()), (1300, v[0][:5].tolist()), (0, v[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    whole = topk.integer_vectors(df)
    got = {}
    for x in topk.top_k(whole, whole.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id")), block=3).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    z = np.floor(v.astype(float) * 1024).astype(np.int64)
    assert set(got) == {0, 100, 200, 300, 400, 500, 600}
    for q in got:
        s = z @ z[q]
        best = sorted((-int(s[i]), i) for i in range(700) if i != q)[:10]
        assert sorted(got[q]) == [(k + 1, i, -t) for k, (t, i) in enumerate(best)]
    big = topk.integer_vectors(spark.createDataFrame([(i, [float(x) for x in r.integers(-(1 << 20), 1 << 20, 3)]) for i in range(40)], "vec_id long, embedding array<double>"))
    table = {x.vec_id: x.v for x in big.collect()}
    best = sorted((-sum(a * b for a, b in zip(table[0], table[i])), i) for i in range(1, 40))[:10]
    assert [(x.vec_id, x.score) for x in topk.top_k(big, big.where("vec_id = 0").select(F.col("vec_id").alias("query_id"))).orderBy("rank").collect()] == [(i, -s) for s, i in best]
    few = whole.where("vec_id < 3")
    assert topk.top_k(few, few.select(F.col("vec_id").alias("query_id"))).count() == 6
    assert topk.top_k(whole.limit(0), few.select(F.col("vec_id").alias("query_id"))).count() == 0


# --- packing


def test_packing_round_trip(spark):
    rows = [(i, prose(i, n)) for i, n in enumerate([1, 5, 400, 3000, 700, 90])] + [*ODD, (50, "a  b\n\n c"), (51, "x <|endoftext|> y")]
    got = packing.pack(docs(spark, rows).coalesce(1), **queries.tokenizer_paths()).collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_paths()["json_path"])
    pieces, sequences = {}, {}
    for p in got:
        pieces.setdefault((p.doc_id, p.doc_tokens), []).append(p)
        sequences.setdefault(p.sequence_id, []).append(p)
    for i, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        own = sorted(pieces[i, len(ids)], key=lambda p: p.start)
        copies = sum(1 for r in rows if (r[0], r[1]) == (i, text))
        assert sum(p.length for p in own) == copies * len(ids)
        for p in own:
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
    for s in sequences.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == 1024 or at & (at - 1) == 0
    assert packing.pack(docs(spark, rows).limit(0), **queries.tokenizer_paths()).count() == 0


def test_ids_of_odd_strings_equal_the_tokenizer():
    from tokenizers import Tokenizer

    paths, r = queries.tokenizer_paths(), random.Random(15)
    whole, own = Tokenizer.from_file(paths["json_path"]), packing.encoder(**paths)
    letters = [" ", "  ", "\n", "\t", "\r\n", "\u00a0", "\u3000", "a", "Ab", "'s", "'LL", "1234", "é", "ß", "中文", "🙂", "\u200b", "<|endoftext|>", "_", "--", "\x00", "e\u0301", "٣", "ي"]
    for _ in range(3000):
        text = "".join(r.choice(letters) for _ in range(r.randrange(12)))
        assert np.frombuffer(own.encode(text), np.uint32).tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


def test_tightest_window():
    tree = packing.CapacityTree(1024)
    for c in (5, 700, 1024):
        tree.add(c, 1)
    assert [tree.tightest(n) for n in (1, 5, 6, 700, 701, 1024)] == [5, 5, 700, 700, 1024, 1024]
    tree.add(1024, -1)
    assert tree.tightest(900) == -1


# --- toxicity and quality


def test_toxicity_held_out(spark):
    bad = ["vileword", "nastything", "uglyname"]
    rows, labels = [], []
    for i in range(300):
        words = prose(i, 60).split()
        toxic = i % 3 == 0
        if toxic:
            for k in range(1 + i % 4):
                words.insert(7 * k, bad[(i + k) % 3])
        rows.append((i, " ".join(words)))
        if i < 200:
            labels.append((i, int(toxic)))
    labels += [(None, 1), (7, None)]
    df = docs(spark, rows + [(None, None), (900, ""), (901, "vileword " * 5)])
    model = toxicity.fit(df, spark.createDataFrame(labels, "doc_id long, toxic int"), label_col="toxic")
    assert (np.diff(model["theta"]) > 0).all()
    got = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    assert all(got[i].toxic == (i % 3 == 0) for i in range(200, 300))
    assert got[901].severity > got[300 - 3].severity - 1 and got[900].toxic == 0
    kept = toxicity.score(df, model, keep=True)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect() if r.doc_id is not None} == {i for i in range(300) if i % 3} | {900}
    none = toxicity.fit(df, spark.createDataFrame([], "doc_id long, toxic int"), label_col="toxic")
    assert toxicity.score(df, none).agg(F.max("severity")).first()[0] < 1e-6


def test_quality_held_out(spark, small):
    import pandas as pd

    r = queries.op7_quality(spark, small).toPandas().merge(pd.read_parquet(f"{small}/labels.parquet"), on="doc_id")
    held = r[r.held_out]
    assert (held.predicted == held.quality).mean() > 0.9
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in zip(r.doc_id, r.held_out))


def test_quality_of_odd_texts(spark):
    model = quality.fit(docs(spark, [(i, prose(i, 30)) for i in range(8)]), spark.createDataFrame([(i, i % 2) for i in range(8)] + [(None, 1)], "doc_id long, label int"))
    got = quality.score(docs(spark, ODD), model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    empty = quality.fit(docs(spark, ODD).limit(0), spark.createDataFrame([], "doc_id long, label int"))
    assert quality.score(docs(spark, ODD), empty).count() == len(ODD)


# --- SimHash


def fingerprint_brute(text, size):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    words = [re.sub(rb"[A-Z]", lambda m: m[0].lower(), w) for w in words]
    grams = [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_equals_brute_force(spark):
    rows = [(i, prose(i // 3, 80) + (" tail" if i % 3 == 1 else "")) for i in range(30)] + ODD
    got = simhash.near_duplicates(docs(spark, rows)).collect()
    fp = {}
    for i, t in rows:
        fp.setdefault(i, set()).add(fingerprint_brute(t, 3))
    assert {(r.doc_id, int(r.fingerprint, 16)) for r in got} == {(i, f) for i, fs in fp.items() for f in fs} and len(got) == len(rows)
    prints = sorted({f for fs in fp.values() for f in fs})
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a in prints:
        for b in prints:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    least = {}
    for i, fs in fp.items():
        for f in fs:
            if i is not None:
                least[find(f)] = min(least.get(find(f), i), i)
    assert all(r.component_id == least[find(int(r.fingerprint, 16))] for r in got)
    assert simhash.near_duplicates(docs(spark, rows).limit(0)).count() == 0


def test_shingles_in_blocks():
    r = random.Random(14)
    for n in (0, 1, 2, 3, 4, 50):
        text = "".join(r.choice("Ab \t\n\x0b") for _ in range(n))
        for block in (1, 3, 7, 1000):
            assert [s for b in simhash.shingle_blocks(text, 3, block) for s in b] == simhash.shingles(text, 3)


def test_gray_index_finds_every_link():
    r = np.random.default_rng(2)
    x = np.concatenate([r.integers(0, 1 << 62, 400), np.arange(300)]).astype(np.uint64)
    key = np.repeat([1, 2], 350)
    got = {tuple(sorted(p)) for i, j in simhash.GrayIndex(x, key).links(3) for p in zip(i.tolist(), j.tolist())}
    assert got == {(a, b) for a in range(700) for b in range(a + 1, 700) if key[a] == key[b] and int(x[a] ^ x[b]).bit_count() <= 3}


def test_large_groups_are_dealt_again(spark):
    r = random.Random(4)
    prints = sorted({0x1234_0000_0000_0000 ^ sum(1 << b for b in r.sample(range(48), 4)) for _ in range(300)})
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    edges = simhash.linked(df, most=20)
    got = {x.node: x.component for x in components(edges).collect()}
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a in prints:
        for b in prints:
            if a < b and (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    groups = {}
    for p in prints:
        groups.setdefault(find(p), set()).add(p)
    mine = {}
    for p in prints:
        mine.setdefault(got.get(p, p), set()).add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 200: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_dedup_keeps_one_of_each_group(spark):
    base = prose(1, 300).split()
    near = [*base[:150], "changed", *base[151:]]
    far = [w if i % 4 else f"x{i}" for i, w in enumerate(base)]
    rows = [(9, " ".join(base)), (3, " ".join(near)), (15, " ".join(far)), (16, prose(2, 50)), (17, prose(2, 50)), (17, prose(2, 50)), *ODD]
    df = docs(spark, rows)
    out = simhash.dedup(df)
    assert out.columns == df.columns
    got = sorted((r.doc_id for r in out.collect() if r.doc_id and r.doc_id > 2), key=repr)
    assert got == [15, 16, 3, 5, 6]
    assert simhash.dedup(df.limit(0)).count() == 0


def test_dedup_behind_shared_passages(spark):
    # every text holds one of two long licences, so the segments of these have heads that are alike to nothing else
    r, rows, want = random.Random(41), [], set()
    licences = [prose(800 + k, 160) for k in (0, 1)]
    for k in range(40):
        words = prose(600 + k, 240).split()
        other = list(words)
        for i in r.sample(range(240), 5 if k % 4 else 60):
            other[i] = f"edit{k}x{i}"
        rows += [(2 * k, f"{' '.join(words)} {licences[k % 2]}"), (2 * k + 1, f"{' '.join(other)} {licences[k % 2]}")]
        a, b = (frozenset(simhash.shingles(t, 5)) for _, t in rows[-2:])
        want |= {2 * k} if len(a & b) >= 0.8 * len(a | b) else {2 * k, 2 * k + 1}
    assert len(want) == 50
    assert {x.doc_id for x in simhash.dedup(docs(spark, rows), few=4).collect()} == want


def test_dedup_of_texts_without_shared_segments(spark):
    # no word ends a segment, so each text is one segment, which the edits change, as they do more than three bits of the whole
    words = [f"w{i}" for i in range(3000)]
    hashes, _ = simhash.word_hashes([" ".join(words).encode()])
    words = [w for w, end in zip(words, simhash.mix(hashes, simhash.ODD[7]) & np.uint64(15)) if end]
    r, rows = random.Random(43), []
    for k in range(30):
        mine = r.sample(words, 306)
        other = mine[:300]
        for n, i in enumerate(range(20, 300, 50)):
            other[i] = mine[300 + n]
        rows += [(2 * k, " ".join(mine[:300])), (2 * k + 1, " ".join(other))]
    assert {x.doc_id for x in simhash.dedup(docs(spark, rows)).collect()} == {2 * k for k in range(30)}


def test_dedup_of_long_texts_is_exact(spark):
    # pairs of long texts with similarities close to 0.8 on either side, each pair on words of its own
    rows, want = [], set()
    for k in range(24):
        words = [f"p{k}x{w}" for w in prose(500 + k, 1000).split()]
        other = words[: 1000 - 104 - k % 8 * 3] + [f"q{k}y{i}" for i in range(104 + k % 8 * 3)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
        a, b = (frozenset(simhash.shingles(t, 5)) for _, t in rows[-2:])
        want |= {2 * k} if len(a & b) >= 0.8 * len(a | b) else {2 * k, 2 * k + 1}
    assert 24 < len(want) < 48
    assert {r.doc_id for r in simhash.dedup(docs(spark, rows)).collect()} == want



# --- decontamination


def test_overlaps_tolerate_substitutions(spark):
    item = [f"q{i}" for i in range(30)]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, "too short"), (4, " ".join(f"z{i}" for i in range(9)))], "item_id long, text string")
    hole = item[3:25]
    hole[6], hole[13] = "other", "words"
    rows = [(1, f"{prose(1, 20)} {' '.join(item).upper()}! {prose(2, 20)}"), (2, f"{prose(3, 5)} {' '.join(hole)}"), (3, " ".join(item[:8])), (4, prose(4, 40)), (5, " ".join(f"z{i}" for i in range(9))), (6, " ".join(item[::-1])), *ODD, (None, " ".join(item))]
    df = docs(spark, rows)
    bad = decontamination.contaminated(df, bench).collect()
    assert sorted((r.doc_id for r in bad), key=repr) == sorted([1, 2, 5, None], key=repr)
    kept = decontamination.decontaminate(df, bench)
    assert kept.columns == df.columns and kept.count() == len(rows) - 4
    by_shuffle = decontamination.contaminated(df, bench, max_broadcast_seeds=0)
    assert sorted(map(tuple, by_shuffle.collect()), key=repr) == sorted(map(tuple, bad), key=repr)
    # every change that the share allows, in items of 8 to 13 words
    import itertools

    items = {n: [f"i{n}x{k}" for k in range(n)] for n in range(8, 14)}
    changed = [(n, s) for n in items for k in range(n - -(-n * 4 // 5) + 1) for s in itertools.combinations(range(n), k)]
    texts = [(k, " ".join(["before", "it", *(f"c{k}" if i in s else w for i, w in enumerate(items[n])), "after"])) for k, (n, s) in enumerate(changed)]
    found = decontamination.overlaps(docs(spark, texts), spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string"))
    assert {(x.doc_id, x.item_id) for x in found.collect()} == {(k, n) for k, (n, _) in enumerate(changed)}
    assert decontamination.contaminated(df.limit(0), bench).count() == 0 and decontamination.contaminated(df, bench.limit(0)).count() == 0


# --- passages


def test_compact_windows_cover_every_run():
    r = np.random.default_rng(6)
    h = r.integers(0, 1 << 60, 200).astype(np.uint64)
    starts, counts = np.array([0, 120, 125]), np.array([120, 5, 75])
    owner, left, centre, right = passages.compact_windows(h, starts, counts, 10)
    found = list(zip(left.tolist(), centre.tolist(), right.tolist()))
    assert not (owner == 1).any()
    for lo, hi in ((0, 120), (125, 200)):
        for i in range(lo, hi):
            for j in range(i + 9, hi):
                c = i + int(h[i : j + 1].argmin())
                assert sum(a <= i and j <= b and m == c for a, m, b in found) == 1
    assert all(starts[o] <= a <= m <= b < starts[o] + counts[o] for o, (a, m, b) in zip(owner, found))
    # a text of one word over and over has one window
    assert len(passages.compact_windows(np.full(5000, 3, np.uint64), np.array([0]), np.array([5000]), 46)[0]) == 1


def test_passages(spark):
    p, q = prose(1, 70), prose(2, 55)
    edited = p.split()
    edited[35] = "edit"
    rows = [(1, f"{prose(11, 40)} {p} {prose(12, 30)}"), (2, f"{prose(13, 90)} {p}"), (3, f"{prose(14, 10)} {' '.join(edited)} {prose(15, 60)}"), (4, prose(16, 200)), (5, q), (6, q), (6, q), (7, prose(1, 30)), *ODD, (8, p.upper() + " " + prose(17, 20))]
    got = passages.near_passages(docs(spark, rows)).collect()
    pairs = {(r.doc_id, r.of_doc_id) for r in got}
    assert (6, 5) in pairs and {2, 3, 8} <= {r.doc_id for r in got} and not {4, 7} & {r.doc_id for r in got}
    assert all(r.similarity >= 0.8 and r.doc_id > r.of_doc_id and r.n_words >= 50 for r in got)
    two = next(r for r in got if r.doc_id == 2 and r.of_doc_id == 1)
    assert (two.start, two.n_words, two.of_start) == (90, 70, 40)
    assert passages.near_passages(docs(spark, rows).limit(0)).count() == 0


def test_passages_behind_other_heads(spark):
    # documents 1 to 46 each hold one five-word run of the passage by chance, so each of its minima has an unrelated head;
    # 101 repeats 100 whole, of which 90 has only the first half
    p, q = prose(21, 50).split(), prose(22, 60).split()
    rows = [(i + 1, f"{prose(300 + i, 60)} {' '.join(p[i : i + 5])} {prose(400 + i, 60)}") for i in range(46)]
    rows += [(60, f"{prose(23, 30)} {' '.join(p)} {prose(24, 30)}"), (61, f"{prose(25, 40)} {' '.join(p)} {prose(26, 20)}")]
    rows += [(90, f"{prose(27, 30)} {' '.join(q[:25])} {prose(28, 60)}"), (100, f"{prose(29, 30)} {' '.join(q)}"), (101, f"{' '.join(q)} {prose(30, 30)}")]
    got = {(r.doc_id, r.of_doc_id, r.start, r.n_words, r.of_start) for r in passages.near_passages(docs(spark, rows)).collect()}
    assert got == {(61, 60, 40, 50, 30), (101, 100, 0, 60, 30)}


def test_passages_behind_a_common_middle(spark):
    # 44 words in the middle of each passage stand in all 240 documents, and make keys of strangers; only pairs share all 60
    middle, rows = prose(50, 44), []
    for k in range(120):
        p = f"{prose(60_000 + k, 8)} {middle} {prose(61_000 + k, 8)}"
        rows += [(k, f"{prose(62_000 + k, 30)} {p} {prose(63_000 + k, 30)}"), (1000 + k, f"{prose(64_000 + k, 30)} {p} {prose(65_000 + k, 30)}")]
    want = {(1000 + k, k) for k in range(120)}
    got = {(x.doc_id, x.of_doc_id) for x in passages.near_passages(docs(spark, rows)).collect()}
    assert got == want


def test_rare_places_hold_a_token_of_every_passage():
    # texts with runs alike, of tokens of few or many texts: some token that is rare in one is rare in the other
    r = np.random.default_rng(8)
    for n in range(150):
        base = r.choice(400 if n % 2 else 60, 70, replace=n % 2 == 0)
        texts = []
        for side in (0, 1):
            own = base.copy()
            at = r.choice(70, int(r.integers(9)), replace=False)
            own[at] = 500 + 100 * side + np.arange(len(at))
            texts.append(np.r_[r.integers(0, 400, r.integers(60)), own[: r.integers(46, 71)], r.integers(0, 400, r.integers(60))].astype(np.uint32))
        common = np.intersect1d(*texts)
        rank = np.full(800, -1)
        rank[common] = r.permutation(800)[: len(common)]  # any order will do
        found = [set(t[passages.rare_places(rank[t], t, 46, 0.8, cells=2000)].tolist()) for t in texts]
        if passages.alike(texts[0], texts[1], 0.8, 46):
            assert found[0] & found[1]
            assert all(passages.held_places(rank[t] >= 0, t, np.arange(len(t)), np.arange(len(t)), 46, 0.8).any() for t in texts)
    assert not len(passages.rare_places(np.where(np.arange(200) % 100 < 30, np.arange(200), -1), np.arange(200, dtype=np.uint32), 46, 0.8))


def test_runs_longer_than_a_window_are_found_within_others():
    # texts that differ at places of chance: wherever a run of 46 tokens or more is alike in line, a passage is found
    r = np.random.default_rng(3)
    for _ in range(500):
        a = np.arange(92, dtype=np.uint32)
        b = a.copy()
        b[r.choice(92, int(r.integers(18, 26)), replace=False)] += 1000
        same = np.r_[0, np.cumsum(a == b)]
        runs = [(same[j] - same[i]) / (2 * (j - i) - same[j] + same[i]) for i in range(47) for j in range(i + 46, 93)]
        assert bool(passages.alike(a, b, 0.8, 46)) == (max(runs) >= 0.8)


def test_strangers_of_a_key_are_not_compared(spark, monkeypatch):
    # a line of 32 words stands in all 150 texts, and makes keys of strangers; the last of each 10 repeats the one before
    line, rows, compared, stash = prose(70, 32), [], [], passages.stash
    for k in range(150):
        of = k - 1 if k % 10 == 9 else k
        rows.append((k, f"{prose(70_000 + of, 40)} {line} {prose(71_000 + of, 40)} {prose(72_000 + k, 9)}"))

    def counted(df, name, *args, **kwargs):
        out = stash(df, name, *args, **kwargs)
        if name == "candidates":
            compared.append(out.count())
        return out

    monkeypatch.setattr(passages, "stash", counted)
    got = {(x.doc_id, x.of_doc_id) for x in passages.near_passages(docs(spark, rows)).collect()}
    assert got == {(k, k - 1) for k in range(9, 150, 10)}
    assert sum(compared[1:]) <= 30  # after those against the first document of each key


def passage_pairs_brute(rows, words, size, share):
    """Pairs of ids with two runs of ``words`` words whose sets of runs of ``size`` words are alike."""
    grams = {i: [tuple(t.lower().split()[k : k + size]) for k in range(len(t.split()) - size + 1)] for i, t in rows}
    n, found = words - size + 1, set()
    for i, a in grams.items():
        for j, b in grams.items():
            common = set(a) & set(b)
            if i >= j or len(common) < share * n / 2:
                continue
            x, y = ([set(g[k : k + n]) for k in range(len(g) - n + 1)] for g in (a, b))
            if any(len(p & q) >= share * len(p | q) for p in x if len(p & common) >= n / 2 for q in y):
                found.add((i, j))
    return found


def reached(pairs):
    """Each id's group under the links."""
    root = {}

    def find(p):
        while root.setdefault(p, p) != p:
            p = root[p]
        return p

    for a, b in pairs:
        root[find(a)] = find(b)
    return {p: find(p) for p in list(root)}


def test_passages_equal_brute_force(spark):
    # passages of 50 to 80 words, some with a word changed, in texts of their own
    r, rows = random.Random(31), []
    for k in range(60):
        p = prose(900 + k, 50 + k % 31).split()
        q = list(p)
        if k % 3:
            q[r.randrange(len(q))] = "changed"
        rows += [(2 * k, f"{prose(2000 + k, r.randrange(40))} {' '.join(p)} {prose(3000 + k, r.randrange(40))}"), (2 * k + 1, f"{prose(4000 + k, r.randrange(40))} {' '.join(q)} {prose(5000 + k, r.randrange(40))}")]
    want = passage_pairs_brute(rows, 50, 5, 0.8)
    assert len(want) > 50
    group = reached([(x.doc_id, x.of_doc_id) for x in passages.near_passages(docs(spark, rows)).collect()])
    lost = [p for p in want if group.get(p[0], -1) != group.get(p[1], -2)]
    assert len(lost) <= 0.03 * len(want)
    clean = {i for i, _ in rows} - {i for p in want for i in p}
    assert not clean & set(group)


def test_passages_quoted_in_parts_before(spark):
    # earlier documents quote runs of 19 words of passages that later ones repeat whole
    rows, r = [], random.Random(32)
    for k in range(100):
        p = prose(7000 + k, 60).split()
        for q in range(3):
            at = r.randrange(42)
            rows.append((10 * k + q, f"{prose(10_000 + 3 * k + q, 40)} {' '.join(p[at : at + 19])} {prose(20_000 + 3 * k + q, 40)}"))
        rows += [(10 * k + 5 + d, f"{prose(30_000 + 2 * k + d, 30)} {' '.join(p)} {prose(40_000 + 2 * k + d, 30)}") for d in (0, 1)]
    got = {(x.doc_id, x.of_doc_id) for x in passages.near_passages(docs(spark, rows)).collect()}
    assert got <= {(10 * k + 6, 10 * k + 5) for k in range(100)} and len(got) >= 98


# --- pages


def test_page_text():
    line = html.lines_of('<nav>menu</nav><p class="cookie-notice">c<p>foo<b>bar</b>baz&nbsp;&amp;<article><h1>T</h1><aside>s</aside>one<br>two<div id=comments>x</div><script>if (a<b) "</p>"</script></article><form>f</form>&copy')
    assert [t for t, role in line if role == 1] == ["T", "one", "two"]
    assert [t for t, role in line if role == 0] == ["foobarbaz &", "©"]
    assert html.lines_of("") == [] and html.lines_of("<p>cut <b") == [("cut", 0)]


def test_marks_count_by_whole_tokens():
    text = lambda page, want: " ".join(t for t, role in html.lines_of(page) if role == want)
    article = '<article class="post share-price">{}</article>'
    own = '<h1 id="search">A</h1><section id="related-work">B</section><p class="share-price">C</p><div class="form-factor">D</div><p>E</p><h2 class="menu">F</h2><p id="comments">G</p><div data-class="ad">H</div><div class="header banner">I</div><div id="notice">J</div>'
    assert text(article.format(own), 1) == "A B C D E F G H I J"
    foreign = ['<div class="x share-buttons">', "<ul id=comments>", "<div class=ad>", "<div class='comment-list'>", '<div role="navigation">', '<p class="related">', '<div class="entry-footer">', '<div class="cookie_notice">', '<div id="ads">', "<form>", "<aside>", '<section class="newsletter-signup">']
    for tag in foreign:
        assert text(article.format(f"<p>A</p>{tag}B</{tag[1:].split()[0].strip('>')}><p>C</p>"), 1) == "A C", tag
    outside = '<div id="top-nav">a</div><div class="site-header">b</div><div id="sidebar">c</div><div class="search">d</div><div id="nav-research">E</div><div class="form-factor">F</div>'
    assert text(outside, 0) == "E F" and text('<article class="comment">r</article><main id="search">M</main>', 1) == "M"


def test_page_text_after_open_controls():
    text = lambda page, want: " ".join(t for t, role in html.lines_of(page) if role == want)
    assert text("<datalist><option value=a></datalist><article>one</article>", 1) == "one"
    assert text("<article>one <select><option>x<option>y</select>two</article><form><option>z</option></form>", 1) == "one two"
    assert text("<article>one <math><mi>x</mi></math> <object>two</object><button>b</button></article>", 1) == "one x two"
    assert text("<option>a<article>one</article>", 1) == "one" and text("<p>one</p><button>b</button><select><option>c</select>", 0) == "one"


def test_shared_lines_are_a_longest_common_subsequence():
    r = random.Random(8)
    for _ in range(60):
        a, b = ([r.randrange(6) for _ in range(r.randrange(9))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert len(html.shared_lines(a, b)) == table[-1][-1]


def test_extract(spark):
    page = lambda body: f"<html><head><title>t</title></head><body><div>Site menu</div><div>{body}</div><div>Imprint</div></body></html>"
    rows = [(1, "http://a.example/x/1", page("first story")), (2, "http://www.a.example/x/2?p=1", page("second story")), (3, "http://b.example/", page("alone")), (4, "http://c.example/1", "<article>same</article>"), (5, "http://c.example/2", "<article>same</article>"), (6, None, None), (None, "http://a.example/x/3", ""), (7, "http://d.example", page("copy")), (7, "http://d.example", page("copy"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit(1), "host": F.lit(2)})
    got = {(r.page_id, r.url): r for r in html.extract(df, partitions=1).collect()}
    assert got[1, rows[0][1]].text == "first story" and got[2, rows[1][1]].text == "second story"
    assert got[3, rows[2][1]].text == "Site menu alone Imprint" and got[4, rows[3][1]].text == got[5, rows[4][1]].text == "same"
    assert got[6, None].text == "" and got[7, rows[7][1]].text == "Site menu copy Imprint" and all(r.n_chars == len(r.text) for r in got.values())
    assert html.extract(df).count() == len(rows) and html.extract(df.limit(0)).count() == 0


def test_page_differencing_equals_brute_force(spark):
    # a host of many pages without marks: a frame of its own for each section, copies among them; any number of ranges
    r, rows = random.Random(12), []
    for i in range(60):
        section = i // 20
        body = [f"story {i if i % 7 else 1} part {k}" for k in range(3)]
        lines_ = ["Site menu", f"Section {section}", *body, *(["Now with offers"] if r.random() < 0.5 else []), "Imprint"]
        rows.append((i, f"http://h.example/{section}/{i:03d}?q={i}", "".join(f"<div>{x}</div>" for x in lines_)))
    rows += [(100 + k, f"http://h.example/0/003?copy={k}", rows[3][2]) for k in range(5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = [sorted((x.page_id, x.text) for x in html.extract(pages, partitions=n).collect()) for n in (1, 7, 50)]
    assert got[0] == got[1] == got[2]
    # brute force: one page of each list of lines, by least path, against the ones beside it
    own = {i: tuple(t for t, _ in html.lines_of(h)) for i, _, h in rows}
    place = {}
    for i, u, _ in rows:
        path = u.split("?")[0]
        place[own[i]] = min(place.get(own[i], path), path)
    line = sorted(place, key=lambda x: place[x])

    def longest(a, b):
        if not a or not b:
            return []
        table = [[()] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = (*table[i][j], i) if x == y else max(table[i][j + 1], table[i + 1][j], key=len)
        return table[-1][-1]

    want = []
    for i, _, _ in rows:
        k = line.index(own[i])
        gone = {x for other in [*line[max(k - 1, 0) : k], *line[k + 1 : k + 2]] for x in longest(own[i], other)}
        want.append((i, " ".join(t for x, t in enumerate(own[i]) if x not in gone)))
    assert got[0] == sorted(want)
    assert all("Imprint" not in t and "menu" not in t for _, t in want)


def test_pages_that_mark_an_article_are_differenced_too(spark):
    # menus without marks around marked articles: every page's shared lines are found, among pages that mark none as well
    rows = []
    for k in range(12):
        body = [f"story {k}", "a common quote", f"end {k}"]
        inner = "".join(f"<p>{x}</p>" for x in body)
        rows.append((k, f"http://m.example/{k:02d}", f"<div>Menu</div>{f'<article>{inner}</article>' if k % 3 else inner}<div>Own {k}</div><div>Imprint</div>"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for n in (1, 5):
        got = {r.page_id: r for r in html.extract(df, partitions=n).collect()}
        for k in range(12):
            own = [[t for t, _ in html.lines_of(rows[i][2])] for i in (k - 1, k, k + 1) if 0 <= i < 12]
            mine = own[min(k, 1)]
            shared = set().union(*(html.shared_lines(mine, other) for other in own if other is not mine))
            assert (got[k].n_lines, got[k].n_shared) == (len(mine), len(shared)) == (6, 3)
            assert got[k].text == (f"story {k} a common quote end {k}" if k % 3 else f"story {k} end {k} Own {k}")


def test_extract_passes_marked_content_whole(spark, small):
    # the tables' pages mark their article: what stays is the article's own text, whatever its neighbours share
    got = {r.page_id: r.text for r in queries.op10_html(spark, small).collect()}
    for r in spark.read.parquet(f"{small}/pages.parquet").collect():
        inner = re.search(r"<article[^>]*>(.*?)</article>", r.html or "", re.S)
        if inner and "<" not in re.sub(r"</?(?:p|h1|b|br|i|em|strong)\b[^>]*>", "", inner[1]):
            import html as entities

            plain = " ".join(entities.unescape(re.sub(r"</?(?:b|i|em|strong)\b[^>]*>", "", re.sub(r"</?(?:p|h1|br)\b[^>]*>", " ", inner[1]))).split())
            assert got[r.page_id] == plain
