"""Removal of long byte strings that occur earlier, by per-shard suffix arrays."""

from __future__ import annotations

import hashlib
import itertools
import operator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash

GRAM = 20
_MULTIPLIER = 0x9E3779B97F4A7C15
_NULL_ID = np.iinfo(np.int64).min


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes that start at each position, from three words of eight bytes."""
    n = len(data) - 7
    word = np.empty(n, np.uint64)
    for k in range(8):
        part = len(range(k, n, 8))
        word[k::8] = data[k : k + 8 * part].view("<u8")
    m = len(data) - GRAM + 1
    with np.errstate(over="ignore"):
        out = word[:m] * np.uint64(_MULTIPLIER)
        out += word[8 : 8 + m] * np.uint64(0xC2B2AE3D27D4EB4F)
        out += word[GRAM - 8 : GRAM - 8 + m] * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return out


def _window_minima(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours: blocks' running minima from either end, two of which cover a window."""
    n = len(x) - width + 1
    blocks = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    blocks[: len(x)] = x
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    back = np.minimum.accumulate(blocks, axis=1).ravel()
    return np.minimum(ahead[:n], back[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, ends: np.ndarray, length: int, block: int = 1 << 20) -> tuple[np.ndarray, ...]:
    """Content-defined anchors of documents laid end to end: ``hashes, first, last, owner, twice``.

    Each start of a ``length``-byte string belongs to the gram of least hash
    inside the string (the leftmost such); the starts ``first..last`` of a
    document that follow each other with one hash make one context. Equal
    strings have equal anchor hashes wherever they stand. The strings of a
    context all differ, unless it is marked ``twice``: then the gram itself
    comes again within it, as in a run of one byte. ``block`` starts are
    worked on at a time, at some 50 bytes each, so that a very long text costs
    no more; a context that a block cuts is two.
    """
    parts = []
    for at in range(0, max(1, len(data) - length + 1), block):
        part = data[at : at + block + length - 1]
        h, first, last, twice = _anchors(part, ends[(ends > at) & (ends < at + len(part))] - at, length)
        parts.append((h, first + at, last + at, np.searchsorted(ends, first + at, side="right"), twice))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _anchors(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """The same for one block: ``hashes, first, last, twice``."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none.astype(np.uint64), none, none, none.astype(bool)
    h = gram_hashes(data)
    # the upper half of the hash, then the place: the least is the leftmost of equal ones
    place = np.arange(len(h), dtype=np.uint64)
    own = _window_minima((h & ~np.uint64(0xFFFFFFFF)) | place, length - GRAM + 1) & np.uint64(0xFFFFFFFF)
    fits = np.ones(len(own), bool)
    for end in ends.tolist():  # strings do not cross documents
        fits[max(0, end - length + 1) : end] = False
    starts = np.flatnonzero(fits)
    if not len(starts):
        return none.astype(np.uint64), none, none, none.astype(bool)
    at = own[starts].astype(np.int64)
    moved = np.r_[True, at[1:] != at[:-1]]
    step = np.flatnonzero(moved)
    value, owner = h[at[step]], np.searchsorted(ends, starts[step], side="right")
    new = np.r_[True, (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])]
    heads = step[new]
    twice = np.diff(np.r_[np.flatnonzero(new), len(step)]) > 1
    return value[new], starts[heads], starts[np.r_[heads[1:], len(starts)] - 1], twice


def suffix_array(data: np.ndarray) -> np.ndarray:
    """All suffixes in order.

    Larsson and Sadakane's refinement: groups by the first eight bytes are
    sorted again by the rank of the suffix as far on as they are sorted
    already, which doubles the depth; groups of one are left alone. All are
    sorted to the end: the common prefixes need the whole order.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    word = np.zeros(n, np.uint64)
    for k in range(8):
        word = (word << np.uint64(8)) | padded[k : k + n]
    sa = np.argsort(word)
    ordered = word[sa]
    head = np.r_[True, ordered[1:] != ordered[:-1]]
    group = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank = np.empty(n + 1, np.int64)
    rank[sa] = group
    rank[n] = -1
    done = 8
    while True:
        # slots of groups of more than one
        slots = np.flatnonzero(~(head & np.r_[head[1:], True]))
        if not len(slots):
            break
        suffix = sa[slots]
        key = rank[suffix] * (n + 2) + rank[np.minimum(suffix + done, n)] + 1
        order = np.argsort(key)
        key, suffix = key[order], suffix[order]
        sa[slots] = suffix
        new = np.r_[True, key[1:] != key[:-1]]
        head[slots] = new
        rank[suffix] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        done *= 2
    return sa


def common_prefixes(data: np.ndarray, sa: np.ndarray, most: int, lane: int = 64) -> np.ndarray:
    """Common prefix, up to ``most``, of each suffix in order with the one before it.

    Kasai's method: along the text a suffix's prefix is at least the last
    one's less one. The text is cut into lanes that advance side by side.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    out = np.zeros(n, np.int32)
    base = np.arange(0, n, lane)
    have = np.zeros(len(base), np.int64)
    padded = np.concatenate([data.astype(np.int16), np.full(most + 1, -1, np.int16)])
    for step in range(lane):
        i = base + step
        if i[-1] >= n:
            base, have = base[:-1], have[:-1]
            if not len(base):
                break
            i = base + step
        j = before[i]
        have = np.where(j < 0, 0, np.maximum(have - 1, 0))
        live = np.flatnonzero((j >= 0) & (have < most))
        while len(live):
            a, b = i[live] + have[live], j[live] + have[live]
            same = (padded[a] == padded[b]) & (a < n) & (b < n)
            live = live[same]
            have[live] += 1
            live = live[have[live] < most]
        out[i] = have
    return out[sa]


def _earlier(doc: np.ndarray, key: np.ndarray, start: np.ndarray) -> np.ndarray:
    return np.lexsort((start, key, doc))


def shard_repeats(contexts: list[tuple[int, int, int, bytes]], length: int) -> tuple[np.ndarray, ...]:
    """All starts in a shard's contexts: ``doc, key, start, class, first``.

    A context is (doc, key, offset of its bytes in the document, bytes);
    starts that leave ``length`` bytes in it count. Starts of equal strings
    share a class; ``first`` marks all that equal the least of the class.
    """
    if not contexts:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(bool), none.astype(bool), none, none.astype(np.uint8)
    sizes = np.array([len(c[3]) for c in contexts])
    data = np.frombuffer(b"".join(c[3] for c in contexts), np.uint8)
    ends = np.cumsum(sizes)
    sa = suffix_array(data)
    lcp = common_prefixes(data, sa, length)
    owner = np.repeat(np.arange(len(contexts)), sizes)[sa]
    valid = sa + length <= ends[owner]
    classes = np.cumsum(lcp < length)[valid]
    sa, owner = sa[valid], owner[valid]
    doc = np.array([c[0] for c in contexts], np.int64)[owner]
    key = np.array([c[1] for c in contexts], np.int64)[owner]
    start = sa - (ends - sizes)[owner] + np.array([c[2] for c in contexts], np.int64)[owner]
    order = np.lexsort((start, key, doc, classes))
    doc, key, start, classes, at = doc[order], key[order], start[order], classes[order], sa[order]
    head = np.r_[True, classes[1:] != classes[:-1]] if len(classes) else np.zeros(0, bool)
    lead = np.maximum.accumulate(np.where(head, np.arange(len(head)), 0)) if len(head) else np.zeros(0, np.int64)
    first = (doc == doc[lead]) & (key == key[lead]) & (start == start[lead])
    return doc, key, start, head, first, at, data


def _runs(doc: np.ndarray, key: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Byte ranges covered by strings at the given starts: ``doc, key, from, to``."""
    order = _earlier(doc, key, start)
    doc, key, start = doc[order], key[order], start[order]
    if not len(doc):
        return doc, key, start, start
    head = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]) | (start[1:] > start[:-1] + 1)])
    last = np.r_[head[1:], len(doc)] - 1
    return doc[head], key[head], start[head], start[last] + length


def merge_runs(known: dict, strings: np.ndarray, doc: np.ndarray, key: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, ...]:
    """Merge one shard's sorted distinct strings into those known, by binary search.

    Returns ``doc, key, start`` of the occurrences that turn out not to be the first.
    """
    if not len(known["s"]):
        known |= {"s": strings, "doc": doc, "key": key, "start": start}
        return doc[:0], key[:0], start[:0]
    at = np.searchsorted(known["s"], strings)
    inside = np.minimum(at, len(known["s"]) - 1)
    same = known["s"][inside] == strings
    k = inside[same]
    mine = (doc[same], key[same], start[same])
    theirs = (known["doc"][k], known["key"][k], known["start"][k])
    less = (mine[0] < theirs[0]) | (mine[0] == theirs[0]) & ((mine[1] < theirs[1]) | (mine[1] == theirs[1]) & (mine[2] < theirs[2]))
    equal = (mine[0] == theirs[0]) & (mine[1] == theirs[1]) & (mine[2] == theirs[2])
    late = [np.where(less, t, m)[~equal] for m, t in zip(mine, theirs)]
    for name, m, t in zip(("doc", "key", "start"), mine, theirs):
        known[name][k] = np.where(less, m, t)
        known[name] = np.insert(known[name], at[~same], {"doc": doc, "key": key, "start": start}[name][~same])
    known["s"] = np.insert(known["s"], at[~same], strings[~same])
    return tuple(late)


def _chunks(rows, most: int):
    """Rows (…, bytes last) in lists of about ``most`` bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def remove_repeats(docs: DataFrame, *, length: int = 100, shard_bytes: int = 2_000_000, salt_rows: int = 4096, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every row (with ``texts``, also ``kept``, the bytes left).

    Every byte covered by a ``length``-byte string that also starts earlier
    (in a document of smaller id, or before in its own) is removed. Strings
    are judged on the whole input and do not cross documents.

    Of equal texts the least document stands for all: the others of
    ``length`` bytes or more go whole, and only it is searched.

    1. Each start belongs to an anchor inside its string, so equal strings
       have equal anchors. Anchor hashes are counted with map-side sums; those
       that occur once cannot hold a repeat.
    2. The bytes around the others go to shards by anchor hash, a hash that
       very many share to several shards by a salt of document and place.
    3. Each shard sorts its suffixes (Larsson-Sadakane), takes common
       prefixes (Kasai), and finds all but the first start of each string.
    4. What is first in a salted shard is merged with the same hash's other
       shards: ranges of the sorted strings, by binary search.

    Null texts count as empty. Null ids come before all others. Rows that
    share id and text are one document, each with its result; rows that share
    only the id are told apart, and ordered, by a hash of the text. An empty
    table gives no rows; other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(id_col).cast("long"), text).alias("key"), text.alias("text"))

    def anchored(batches):
        """``keys, hashes, owner`` of the anchors of some documents at a time."""
        rows = ((k, t.as_py()) for b in batches for k, t in zip(b.column(0).to_pylist(), b.column(2)))
        for chunk in _chunks(rows, 120_000):
            data = np.frombuffer(b"".join(r[1] for r in chunk), np.uint8)
            h, _, _, owner, twice = anchors(data, np.cumsum([len(r[1]) for r in chunk]), length)
            yield np.array([r[0] for r in chunk], np.int64), h.view(np.int64), owner, twice

    def hashes_only(batches):
        for group in itertools.batched((np.r_[h, h[twice]] for _, h, _, twice in anchored(batches)), 30):
            h, n = np.unique(np.concatenate(group), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], names=["h", "n"])

    def with_place(batches):
        for keys, h, owner, _ in anchored(batches):
            no = np.arange(len(h)) - np.searchsorted(owner, owner)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(keys[owner]), pa.array(no.astype(np.int32))], names=["h", "key", "no"])

    plain = base.select("key", "doc_id", "text")
    # classes of equal texts, known by two hashes and the length
    equal = ["h1", "h2", "size"]
    members = base.select("key", F.coalesce("doc_id", F.lit(_NULL_ID)).alias("doc"), F.xxhash64("text").alias("h1"), F.xxhash64("text", F.lit(1)).alias("h2"), F.length("text").alias("size"))
    leads = members.where(F.col("size") >= length).groupBy(*equal).agg(F.min(F.struct("doc", "key")).alias("lead"), F.min("key").alias("a"), F.max("key").alias("b")).where("a <> b")
    copies = stash(members.join(leads, equal).where(F.col("key") != F.col("lead.key")).select("key", F.lit(True).alias("copy")).distinct(), "copies")
    often = plain.mapInArrow(hashes_only, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1")
    often = often.select("h", F.ceil(F.col("n") / salt_rows).cast("int").alias("parts"))
    places = plain.mapInArrow(with_place, "h long, key long, no int").join(often, "h").groupBy("key").agg(F.collect_set(F.struct("no", "parts")).alias("places")).join(copies, "key", "left_anti")
    places = stash(places, "places")

    def squeeze(batches):
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                b = batch.slice(at, 500)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([pack.compress(t.as_py()) for t in b.column(2)], pa.binary())], names=["key", "doc_id", "text"])

    squeezed = plain.mapInArrow(squeeze, "key long, doc_id long, text binary")

    def contexts(batches):
        unpack = zstandard.ZstdDecompressor()
        names = ["h", "salt", "hot", "doc", "key", "at", "bytes", "twice"]

        def documents():
            for batch in batches:
                lists = batch.column(3)
                flat, edges = lists.flatten(), np.cumsum(np.r_[0, lists.value_lengths().to_numpy()])
                no, parts = flat.field("no").to_numpy(), flat.field("parts").to_numpy()
                for i, (key, doc, body) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2))):
                    own = slice(edges[i], edges[i + 1])
                    yield key, _NULL_ID if doc is None else doc, no[own], parts[own], unpack.decompress(body.as_py())

        for chunk in _chunks(documents(), 120_000):
            data = b"".join(r[4] for r in chunk)
            h, first, last, owner, twice = anchors(np.frombuffer(data, np.uint8), np.cumsum([len(r[4]) for r in chunk]), length)
            counts = np.array([len(r[2]) for r in chunk])
            whose = np.repeat(np.arange(len(chunk)), counts)
            have = np.bincount(owner, minlength=len(chunk))
            no, parts = np.concatenate([r[2] for r in chunk]), np.concatenate([r[3] for r in chunk])
            there = no < have[whose]
            whose, parts, no = whose[there], parts[there], no[there]
            place = (np.cumsum(have) - have)[whose] + no
            key, doc = (np.array([r[k] for r in chunk], np.int64)[whose] for k in (0, 1))
            begin = np.cumsum([0, *(len(r[4]) for r in chunk)])[whose]
            a, b = first[place], last[place] + length
            pieces = [data[x:y] for x, y in zip(a.tolist(), b.tolist())]
            with np.errstate(over="ignore"):
                salt = ((key + (a - begin) * np.int64(_MULTIPLIER >> 1)) >> np.int64(20)) % parts
            for at in range(0, len(pieces), 5000):
                part = slice(at, at + 5000)
                columns = [h[place[part]].view(np.int64), salt[part], parts[part] > 1, doc[part], key[part], (a - begin)[part]]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(pieces[part], pa.binary()), pa.array(twice[place[part]])], names=names)

    around = squeezed.join(places, "key").mapInArrow(contexts, "h long, salt long, hot boolean, doc long, key long, at long, bytes binary, twice boolean")

    def shards(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.column(6).nbytes
            if size >= shard_bytes:
                table = pa.Table.from_batches(held).combine_chunks()
                h, salt = table.column(0).to_numpy(), table.column(1).to_numpy()
                cuts = np.flatnonzero((h[1:] != h[:-1]) | (salt[1:] != salt[:-1]))
                if len(cuts):  # the last hash may go on in the next batch
                    yield from found(table.slice(0, cuts[-1] + 1))
                    table = table.slice(cuts[-1] + 1)
                held, size = table.to_batches(), table.column(6).nbytes
        if held:
            yield from found(pa.Table.from_batches(held))

    def found(table):
        h, salt, hot, doc, key, at, twice = (table.column(k).to_numpy() for k in (0, 1, 2, 3, 4, 5, 7))
        body = table.column(6).to_pylist()
        # equal contexts share all their strings: the least of them stands for the rest
        digest = np.fromiter(map(hash, body), np.int64, len(body))
        order = np.lexsort((at, key, doc, digest, salt, h))
        h, salt, hot, doc, key, at, twice, digest = (x[order] for x in (h, salt, hot, doc, key, at, twice, digest))
        body = [body[i] for i in order.tolist()]
        group = np.r_[True, (h[1:] != h[:-1]) | (salt[1:] != salt[:-1])]
        same = np.fromiter(map(operator.eq, body[1:], body[:-1]), bool, len(body) - 1)
        head = group | np.r_[True, (digest[1:] != digest[:-1]) | ~same]
        lead = np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))
        late = np.flatnonzero((doc != doc[lead]) | (key != key[lead]) | (at != at[lead]))
        sizes = np.fromiter(map(len, body), np.int64, len(body))
        runs = [doc[late], key[late], at[late], (at + sizes)[late]]
        # one context alone has no string twice, and needs no sorting unless other shards hold its hash
        number = np.cumsum(group) - 1
        keep = np.flatnonzero(head & ((np.bincount(number, weights=head)[number] > 1) | hot | twice))
        kept = [(d, k, a, body[i]) for d, k, a, i in zip(doc[keep].tolist(), key[keep].tolist(), at[keep].tolist(), keep.tolist())]
        s_doc, s_key, s_start, first_of, first, place, data = shard_repeats(kept, length)
        sorted_runs = _runs(s_doc[~first], s_key[~first], s_start[~first], length)
        runs = [np.concatenate([x, y]).astype(np.int64) for x, y in zip(runs, sorted_runs)]
        for lo in range(0, len(runs[0]), 50_000):
            piece = [pa.array(x[lo : lo + 50_000]) for x in runs]
            n = len(piece[0])
            yield pa.RecordBatch.from_arrays([*piece, pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], names=["doc", "key", "from", "to", "salt", "string"])
        if hot.any():
            # the first of each string in the salted contexts, for the merge
            own = np.repeat(keep, sizes[keep])
            out = np.flatnonzero(first_of & hot[own[place]]) if len(place) else []
            rows = [(s_doc[i], s_key[i], s_start[i], s_start[i] + length, salt[own[place[i]]], data[place[i] : place[i] + length].tobytes()) for i in out]
            for lo in range(0, len(rows), 5000):
                yield _batch(rows[lo : lo + 5000], ["doc", "key", "from", "to", "salt", "string"])

    schema = "doc long, key long, from long, to long, salt long, string binary"
    results = stash(around.repartition("h", "salt").sortWithinPartitions("h", "salt").mapInArrow(shards, schema), "shards")
    gone = results.where("string is null").select("doc", "key", "from", "to")
    firsts = results.where("string is not null")

    def merged(batches):
        known = {"s": np.zeros(0, f"S{length + 1}"), "doc": None, "key": None, "start": None}
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        for _, run in itertools.groupby(rows, key=lambda r: r[4]):
            run = list(run)
            # one more byte, as numpy drops zeros at the end
            strings = np.array([r[5] + b"\1" for r in run], f"S{length + 1}")
            late = merge_runs(known, strings, *(np.array([r[i] for r in run], np.int64) for i in range(3)))
            runs = _runs(*late, length)
            if len(runs[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in runs], names=["doc", "key", "from", "to"])

    late = firsts.repartitionByRange("string").sortWithinPartitions("salt", "string").mapInArrow(merged, "doc long, key long, from long, to long")
    spans = gone.unionByName(late).groupBy("key").agg(F.collect_list(F.struct("from", "to")).alias("spans"))

    def cut(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for doc, body, spans, copy in zip(*batch.columns[1:5]):
                body, kept, end, n, removed = unpack.decompress(body.as_py()), [], 0, 0, 0
                for span in [(0, len(body))] if copy.as_py() else sorted((s["from"], s["to"]) for s in spans.as_py() or []):
                    if not n or span[0] > end:
                        kept.append(body[end : span[0]])
                        n += 1
                        removed += span[1] - span[0]
                        end = span[1]
                    elif span[1] > end:
                        removed += span[1] - end
                        end = span[1]
                kept = b"".join([*kept, body[end:]])
                rows.append((doc.as_py(), len(body), removed, n, hashlib.sha256(kept).hexdigest(), *([kept] if texts else [])))
                if len(rows) == 500:
                    yield _batch(rows, names)
                    rows = []
            if rows:
                yield _batch(rows, names)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if texts else [])]
    return squeezed.join(spans, "key", "left").join(copies, "key", "left").select("key", "doc_id", "text", "spans", "copy").mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if texts else ""))


_TYPES = {"hot": pa.bool_(), "bytes": pa.binary(), "string": pa.binary(), "kept": pa.binary(), "kept_sha256": pa.string()}


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), _TYPES.get(n, pa.int64())) for n, c in zip(names, zip(*rows))], names=names)


#: The same in SQL: every string of 100 bytes numbered by its starts (told apart by their MD5), islands of those that come later.
SQL = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
p AS (SELECT doc_id, unnest(range(1, octet_length(b) - 98)) AS s, b FROM d WHERE octet_length(b) >= 100),
n AS (SELECT doc_id, s, row_number() OVER (PARTITION BY md5_number(array_slice(b, s, s + 99)) ORDER BY doc_id, s) AS no FROM p),
late AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER w + 100 THEN 0 ELSE 1 END AS new FROM n WHERE no > 1 WINDOW w AS (PARTITION BY doc_id ORDER BY s)),
runs AS (SELECT doc_id, min(s) AS first, max(s) + 99 AS last FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS run FROM late) GROUP BY doc_id, run),
gaps AS (
  SELECT doc_id, last + 1 AS first, coalesce(lead(first) OVER (PARTITION BY doc_id ORDER BY first) - 1, 9223372036854775807) AS last FROM runs
  UNION ALL SELECT doc_id, 1, min(first) - 1 FROM runs GROUP BY doc_id
),
kept AS (SELECT g.doc_id, unhex(string_agg(hex(array_slice(d.b, g.first, least(g.last, octet_length(d.b)))), '' ORDER BY g.first)) AS k FROM gaps g JOIN d USING (doc_id) WHERE g.first <= least(g.last, octet_length(d.b)) GROUP BY g.doc_id),
r AS (SELECT doc_id, CAST(sum(last - first + 1) AS BIGINT) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id)
SELECT d.doc_id, CAST(octet_length(d.b) AS BIGINT) AS n_bytes, coalesce(r.n_removed, 0) AS n_removed, coalesce(r.n_spans, 0) AS n_spans,
       CASE WHEN r.doc_id IS NULL THEN sha256(d.b) ELSE sha256(coalesce(k.k, ''::BLOB)) END AS kept_sha256
FROM d LEFT JOIN r USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""
