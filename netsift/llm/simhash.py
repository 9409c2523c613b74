"""SimHash near-dedup by a Gray-order hierarchical index."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import few_files, fresh, release, sized_broadcast, stash, tidy
from .graph import components
from .hashing import ODD, mix, runs_of, token_hashes, word_hashes

BITS = 64
#: Bits of a set of shingles that tell whether an odd number of its hashes fall there.
PARITIES = 1024
_WHITE = re.compile(rb"[ \t-\r]")


def shingles(text: str, size: int) -> list[bytes]:
    """Runs of ``size`` words of the text, A-Z lower-cased, joined by blanks, repeats included.

    Words are what ASCII white space parts. Fewer words: the whole sequence;
    none: no shingle.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    return [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)]


def shingle_blocks(text: str, size: int, block: int = 1 << 20) -> Iterator[list[bytes]]:
    """The same some megabytes of text at a time, so that a very long text is never laid out as words as a whole."""
    body = text.encode("utf-8", "surrogatepass").lower()
    at, words, begun = 0, [], False
    while at < len(body):
        white = _WHITE.search(body, at + block)
        end = white.start() if white else len(body)
        words += body[at:end].split()
        at = end
        if len(words) > size or begun and len(words) == size:
            yield [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)]
            words, begun = words[len(words) - size + 1 :], True
    if words and not begun:
        yield [b" ".join(words)]


def fingerprint(hashes: list[int] | np.ndarray) -> int:
    """Bit i is 1 if it is set in more than half of the hashes."""
    return fingerprint_of([hashes])


def fingerprint_of(blocks: Iterable[list[int] | np.ndarray]) -> int:
    """The same over blocks of hashes."""
    counts, n = np.zeros(BITS, np.int64), 0
    for hashes in blocks:
        h = np.array(hashes, "<u8")
        n += len(h)
        for at in range(0, len(h), 8192):
            part = np.unpackbits(h[at : at + 8192].view(np.uint8), bitorder="little").reshape(-1, BITS)
            counts += part.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little") if n else 0


def fingerprints(docs: DataFrame, *, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_hash, fp`` (the fingerprint as a signed long) for every row; null texts count as empty."""

    def run(batches):
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            fps = [fingerprint_of([digest(s, 42) for s in block] for block in shingle_blocks(t.as_py() or "", size)) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(fps, "<u8").view("<i8"))], names=["doc_id", "text_hash", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, text_hash long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each word in Gray order: the binary number whose Gray code it is."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


class GrayIndex:
    """Hierarchy over fingerprints in Gray order, group by group.

    Neighbours in Gray order share most bits. A node stands for a run of
    ``fan`` nodes below it and holds the bits they agree on, a mask and a
    pattern, and the range of its group keys. Two nodes differ at least where
    both masks are set and the patterns differ, so a pair over the limit, or
    of groups that do not meet, is pruned with all the pairs below; bits that
    a level adds to the masks add to the difference.
    """

    def __init__(self, x: np.ndarray, key: np.ndarray, fan: int = 4):
        self.order = np.lexsort((gray_rank(x), key))
        self.fan = fan
        pattern, mask = x[self.order], np.full(len(x), ~np.uint64(0))
        first = last = key[self.order]
        self.levels = [(pattern, mask, first, last)]
        while len(pattern) > fan:
            starts = np.arange(0, len(pattern), fan)
            ones, ors = np.bitwise_and.reduceat(pattern, starts), np.bitwise_or.reduceat(pattern, starts)
            mask = np.bitwise_and.reduceat(mask, starts) & ~(ones ^ ors)
            pattern = ones & mask
            first, last = first[starts], last[np.append(starts[1:], len(last)) - 1]
            self.levels.append((pattern, mask, first, last))

    def links(self, limit: int, block: int = 1 << 18):
        """Pairs (i, j) of positions in the input, of one group and at most ``limit`` differing bits, in blocks."""
        top, step = len(self.levels) - 1, np.arange(self.fan)
        a, b = np.triu_indices(len(self.levels[top][0]))
        stack = [(top, a.astype(np.int64), b.astype(np.int64))]
        while stack:
            level, a, b = stack.pop()
            pattern, mask, first, last = self.levels[level]
            near = (first[b] <= last[a]) & (np.bitwise_count((pattern[a] ^ pattern[b]) & mask[a] & mask[b]) <= limit)
            a, b = a[near], b[near]
            if level == 0:
                apart = a < b
                if apart.any():
                    yield self.order[a[apart]], self.order[b[apart]]
                continue
            below, most = len(self.levels[level - 1][0]), block // self.fan**2
            for at in range(0, len(a), most):
                over, under = a[at : at + most] * self.fan, b[at : at + most] * self.fan
                c = np.broadcast_to(over[:, None, None] + step[:, None], (len(over), self.fan, self.fan)).ravel()
                d = np.broadcast_to(under[:, None, None] + step, (len(over), self.fan, self.fan)).ravel()
                ok = (c < below) & (d < below) & (c <= d)
                stack.append((level - 1, c[ok], d[ok]))


def _split(bits: list[int], parts: int) -> list[list[int]]:
    edges = [round(k * len(bits) / parts) for k in range(parts + 1)]
    return [bits[a:b] for a, b in itertools.pairwise(edges)]


def _spread(prints: DataFrame, limit: int, most: int, levels: int = 3) -> DataFrame:
    """``key, fp``: groups of fingerprints such that all pairs within ``limit`` bits meet in some group.

    Of ``limit + 1`` blocks of bits, two such fingerprints agree on one at
    least: the group's key is a block's number and value. Groups of more than
    ``most`` are dealt again by blocks of the bits that are left (pairs in
    one group agree on its block), so a value that very many share spreads.
    """

    def by_blocks(df: DataFrame, bits: list[int], path: str) -> DataFrame:
        keyed = []
        for k, block in enumerate(_split(bits, limit + 1)):
            value = F.lit(0).cast("long")
            for at, bit in enumerate(block):
                value = value.bitwiseOR(F.shiftleft(F.shiftrightunsigned(F.col("fp"), bit).bitwiseAND(F.lit(1)), at))
            keyed.append(F.struct(F.lit(f"{path}{k}").alias("path"), F.xxhash64(F.col("key"), F.lit(f"{path}{k}"), value).alias("key")))
        return df.select("fp", F.explode(F.array(*keyed)).alias("g")).select(F.col("g.key").alias("key"), F.col("g.path").alias("path"), "fp")

    now = by_blocks(prints.select("fp", F.lit(0).cast("long").alias("key")), list(range(BITS)), "")
    done = None
    blocks = [("", list(range(BITS)))]
    for level in range(levels):
        # the value of a block is only worth a second dealing where a group is large
        now = stash(now, "groups")
        large = now.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("key")
        if level == levels - 1 or not large.take(1):
            return now.select("key", "fp") if done is None else done.unionByName(now.select("key", "fp"))
        small = now.join(large, "key", "left_anti").select("key", "fp")
        done = small if done is None else done.unionByName(small)
        again, deeper = None, []
        hot = now.join(large, "key", "left_semi")
        for path, bits in blocks:
            for k, block in enumerate(_split(bits, limit + 1)):
                own = f"{path}{k}"
                left = [b for b in bits if b not in block]
                deeper.append((own, left))
                dealt = by_blocks(hot.where(F.col("path") == own).select("fp", "key"), left, own)
                again = dealt if again is None else again.unionByName(dealt)
        now, blocks = again, deeper
    return done


def linked(prints: DataFrame, *, limit: int = 3, most: int = 50_000) -> DataFrame:
    """Edges ``a, b`` between distinct fingerprints that span all links of at most ``limit`` bits.

    Each task indexes some of its groups at a time, finds every link in them,
    and returns for each fingerprint one edge to the smallest that it reaches
    within the groups: as many edges as fingerprints at most, with the same
    components as all links.
    """

    def edges(key, fp):
        root = np.arange(len(fp))
        for i, j in GrayIndex(fp.view(np.uint64), key).links(limit):
            root = _join(root, i, j)
        moved = np.flatnonzero(root != np.arange(len(fp)))
        a, b = fp[moved], fp[root[moved]]
        for at in range(0, len(a), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(a[at : at + 50_000]), pa.array(b[at : at + 50_000])], names=["a", "b"])

    def run(batches, rows: int = 200_000):
        """Whole groups at a time: the rows come in order of the key."""
        held, size = [], 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            size += batch.num_rows
            if size >= rows:
                key, fp = (np.concatenate(x) for x in zip(*held))
                cut = int(np.searchsorted(key, key[-1]))
                if cut:
                    yield from edges(key[:cut], fp[:cut])
                held, size = [(key[cut:], fp[cut:])], len(key) - cut
        if size:
            yield from edges(*(np.concatenate(x) for x in zip(*held)))

    groups = _spread(prints.select("fp").distinct(), limit, most)
    return groups.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def _join(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Components after links i-j were added, as each position's smallest member."""
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return root
        i, j = i[apart], j[apart]
        low, high = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
        np.minimum.at(root, high, low)
        while True:
            deeper = root[root]
            if (deeper == root).all():
                break
            root = deeper


def near_duplicates(docs: DataFrame, *, size: int = 3, limit: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row.

    Fingerprints link at ``limit`` or fewer differing bits; a component's id
    is the smallest id in it. Null texts count as empty and, like all texts
    without words, have the fingerprint 0, which links like any other. Equal
    texts share a fingerprint and so a component. Null ids take part, but
    give no component its id (it is null where there is no other). An empty
    table gives no rows; other columns are not read.
    """
    found = stash(fingerprints(docs, size=size, id_col=id_col, text_col=text_col), "fingerprints")
    of = components(linked(found, limit=limit)).select(F.col("node").alias("fp"), F.col("component").alias("__c"))
    prints = found.groupBy("fp").agg(F.min("doc_id").alias("first")).join(of, "fp", "left").withColumn("__c", F.coalesce("__c", "fp"))
    prints = stash(prints, "components")
    least = prints.groupBy("__c").agg(F.min("first").alias("component_id"))
    by_print = prints.join(least, "__c").select("fp", "component_id")
    return found.join(by_print, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "text_hash")


def _majorities(hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Fingerprints of the ranges ``first..last`` (exclusive, in order, none empty) of hashes."""
    if not len(first):
        return np.zeros(0, np.uint64)
    bits = np.unpackbits(np.append(hashes, np.uint64(0)).astype("<u8").view(np.uint8), bitorder="little").reshape(-1, BITS)
    counts = np.add.reduceat(bits, np.stack([first, last], axis=1).ravel(), axis=0, dtype=np.int32)[::2]
    return np.packbits(2 * counts > (last - first)[:, None], axis=1, bitorder="little").view("<u8").ravel()


def _short(body: bytes) -> np.ndarray:
    """The one shingle of a text of fewer words than a shingle has."""
    words = body.lower().split()
    return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)] if words else [], np.uint64)


def parities(hashes: np.ndarray) -> np.ndarray:
    """Bits set where an odd number of the different ``hashes`` fall, as 64-bit words: sets with k hashes not in common differ in k bits at most."""
    odd = np.bincount((mix(hashes, ODD[4]) % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def text_sketches(bodies: list[bytes], size: int, segments: int, sketch: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray], list[int], list[np.ndarray]]:
    """For each text: its fingerprint over runs of ``size`` words, those of some segments, its least run hashes, how many different ones it has, and their parities.

    A segment is a run of words up to one whose hash says so (sixteen words
    on average), so an edit changes only the segments that it touches; the
    ``segments`` of least fingerprint are taken, the same ones in texts alike.
    They are a first look only; what they miss is found by ``_rarest``.
    """
    n = len(bodies)
    word, owner = word_hashes(bodies)
    token, starts, counts = runs_of(word, owner, n, size)
    words = np.bincount(owner, minlength=n)
    begin = np.cumsum(words) - words
    long = np.flatnonzero(counts)
    fps = np.zeros(n, np.uint64)
    fps[long] = _majorities(token, starts[long], (starts + counts)[long])

    new = np.r_[True, (owner[1:] != owner[:-1]) | (mix(word[:-1], ODD[7]) & np.uint64(15) == 0)] if len(word) else np.zeros(0, bool)
    left = np.flatnonzero(new)
    right = np.r_[left[1:], len(word)]
    whose = owner[left]
    fits = right - left >= size
    left, right, whose = left[fits], right[fits], whose[fits]
    first = starts[whose] + left - begin[whose]
    own = _majorities(token, first, first + (right - left) - size + 1)
    order = np.lexsort((own, mix(own, ODD[6]), whose))
    own, whose = own[order], whose[order]
    keep = np.r_[True, (own[1:] != own[:-1]) | (whose[1:] != whose[:-1])] if len(own) else np.zeros(0, bool)
    own, whose = own[keep], whose[keep]
    edges = np.searchsorted(whose, np.arange(n + 1))
    parts = [own[a : min(b, a + segments)] for a, b in itertools.pairwise(edges.tolist())]

    every = [np.unique(token[a : a + c]) for a, c in zip(starts.tolist(), counts.tolist())]
    for i in np.flatnonzero(counts == 0).tolist():
        every[i] = _short(bodies[i])
        fps[i] = fingerprint(every[i])
    return fps, parts, [x[:sketch] for x in every], [len(x) for x in every], [parities(x) for x in every]


def _text_chunks(batch: pa.RecordBatch, column: int, limit: int = 200_000):
    """``(rows, texts)`` of a batch, some texts at a time; null counts as empty."""
    bodies, held, at = [], 0, 0
    for i, text in enumerate(batch.column(column)):
        bodies.append((text.as_py() or "").encode("utf-8", "surrogatepass"))
        held += len(bodies[-1])
        if held >= limit or i + 1 == batch.num_rows:
            yield batch.slice(at, len(bodies)), bodies
            at, bodies, held = i + 1, [], 0


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = pa.array(np.cumsum([0, *map(len, parts)]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*parts, np.zeros(0, np.uint64)]).view(np.int64)))


def _sketches(docs: DataFrame, size: int, segments: int, sketch: int) -> DataFrame:
    """``key, fp, parts, least, n, odd`` of every text."""

    def run(batches):
        for batch in batches:
            for rows, bodies in _text_chunks(batch, 1):
                fps, parts, least, sizes, odd = text_sketches(bodies, size, segments, sketch)
                columns = [rows.column(0), pa.array(fps.view(np.int64)), _lists(parts), pa.array([x.astype("<u8").tobytes() for x in least], pa.binary()), pa.array(sizes, pa.int64()), _lists(odd)]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "fp", "parts", "least", "n", "odd"])

    return docs.select("key", "text").mapInArrow(run, "key binary, fp long, parts array<long>, least binary, n long, odd array<long>")


def _rarest(texts: DataFrame, size: int, similarity: float, often: int = 16, slots: int = 1 << 23, counts: int = 2) -> DataFrame:
    """``key, unit, place``: of each text's runs, as many, in one order for all texts, as two texts alike must share one of, and their places in it.

    Of n different runs, at least a share of ``similarity`` stands in any text
    alike, so the first n - similarity * n + 1 of any common order hold a
    shared one. The order is by how many texts a run would be a key of, by
    powers of two over ``often`` as told by a table of fixed size, then by
    hash: runs of many texts are keys of those only that hold little else.
    What comes first once the many are last is counted anew.
    """

    def firsts(rank: np.ndarray | None):
        def run(batches):
            for batch in batches:
                for rows, bodies in _text_chunks(batch, 1):
                    token, starts, counts = token_hashes(bodies, size)
                    units = []
                    for a, c, body in zip(starts.tolist(), counts.tolist(), bodies):
                        own = np.unique(token[a : a + c]) if c else _short(body)
                        if rank is not None and len(own):
                            own = own[np.argsort(rank[(own & np.uint64(slots - 1)).astype(np.int64)], kind="stable")]
                        units.append(own[: len(own) - int(np.ceil(len(own) * similarity - 1e-9)) + 1])
                    yield pa.RecordBatch.from_arrays([rows.column(0), _lists(units)], names=["key", "units"])

        found = texts.select("key", "text").mapInArrow(run, "key binary, units array<long>")
        return found.select("key", F.posexplode("units").alias("place", "unit"))

    slot, rank = F.col("unit").bitwiseAND(slots - 1), None
    for _ in range(counts):
        many = firsts(rank).groupBy("unit").agg(F.count(F.lit(1)).alias("texts")).where(F.col("texts") > often)
        ranks = many.groupBy(slot.alias("slot")).agg((1 + F.floor(F.log2(F.max("texts") / often))).cast("long").alias("rank"))
        # eight slots a row: at most slots / 8 rows, whatever the number of texts
        with tidy(texts.sparkSession):
            eight = ranks.groupBy(F.shiftright("slot", 3).alias("at")).agg(F.bit_or(F.expr("shiftleft(rank, cast(8 * (slot & 7) as int))")).alias("ranks")).toArrow()
        told = np.zeros(slots >> 3, np.int64)
        told[eight["at"].to_numpy()] = eight["ranks"].to_numpy()
        told = told.view(np.uint8)
        rank = told if rank is None else np.maximum(rank, told)
    return firsts(rank)


def _similarity(a: np.ndarray, b: np.ndarray, sketch: int) -> float:
    """Jaccard similarity by the least hashes of the union; exact where both sets are whole."""
    union = np.union1d(a, b)
    if len(a) >= sketch or len(b) >= sketch:
        union = union[:sketch]
    both = np.intersect1d(a, b, assume_unique=True)
    return np.isin(union, both, assume_unique=True).sum() / len(union) if len(union) else 1.0


def dedup(docs: DataFrame, *, size: int = 5, similarity: float = 0.8, limit: int = 3, segments: int = 8, sketch: int = 256, margin: float = 0.15, turns: int = 2, few: int = 16, apart: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near duplicates: that of the smallest id.

    Equal texts (by a hash of 128 bits) are one class. Texts are candidates if
    their SimHash fingerprints over runs of ``size`` words link within
    ``limit`` bits in the Gray-order index, or if they share the fingerprint
    of a segment: three bits alone find few of the pairs near 0.8. Of these,
    texts whose fingerprints differ in more than ``apart`` bits wait for the
    exact rest (at a similarity of 0.8 they differ in about 10, give or take
    3). At last all texts are candidates that share one of the rarest of their
    shingles, so many that any two at
    ``similarity`` share one. Candidates link if the Jaccard similarity of
    their shingle sets is ``similarity`` or more. The ``sketch`` least hashes
    decide texts of fewer shingles (exactly) and estimates more than
    ``margin`` from the limit, six standard errors at 0.8; all other pairs are
    verified by their whole sets. Groups are the connected components of the
    links.

    The texts of one segment or linked fingerprint are set
    against the least of them. Those that do not link to it are dealt again
    against the next, ``turns`` times; then all that are left are set against
    each other where they are ``few`` at most. That joins most; the exact rest
    makes up for what it leaves, the larger units too. Texts that
    share a rare shingle, and that no links join yet, are all set against each
    other unless their sizes, the places of the shingle or the parities of
    their hashes forbid it, all exact bounds: first against some of each
    shingle, then against eight times as many each turn, so what these join is
    not compared again. A shingle of n strangers takes n * n / 2 comparisons
    of these bounds; sets are read of the pairs only that they allow.

    Null texts count as empty, and all empty texts are equal. A null id comes
    before all others. Of repeated rows one stays. All columns stay as they
    are; an empty table stays empty.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key, row_id = F.unhex(F.md5(text.cast("binary"))), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    id_, key_ = fresh(docs, "id", "key")
    keyed = docs.select(key.alias("key"), row_id.alias("id"), text.alias("text"))
    found = stash(_sketches(keyed, size, segments, sketch).dropDuplicates(["key"]), "sketches")

    # whole fingerprints: texts of one fingerprint, and fingerprints that link
    reach = components(linked(found, limit=limit)).select(F.col("node").alias("fp"), F.col("component").alias("unit"))
    whole = found.select("key", "fp").join(reach, "fp", "left").select("key", "fp", F.coalesce("unit", "fp").alias("unit"), F.lit(0).alias("kind"))
    parts = found.select("key", "fp", F.explode("parts").alias("unit"), F.lit(1).alias("kind"))
    units = whole.unionByName(parts)

    def judged(batches):
        for batch in batches:
            a, b = ([np.frombuffer(x, "<u8") for x in batch.column(i).to_pylist()] for i in (2, 3))
            found = np.array([_similarity(x, y, sketch) for x, y in zip(a, b)])
            whole = np.array([len(x) < sketch and len(y) < sketch for x, y in zip(a, b)], bool)
            clear = whole | (np.abs(found - similarity) > margin)
            keep = ~clear | (found >= similarity)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(clear, pa.bool_())], names=["a", "b", "clear"]).filter(pa.array(keep, pa.bool_()))

    def sets(batches):
        for batch in batches:
            for rows, bodies in _text_chunks(batch, 1):
                token, starts, counts = token_hashes(bodies, size)
                hashes = [np.unique(token[a : a + c]) if c else _short(body) for a, c, body in zip(starts.tolist(), counts.tolist(), bodies)]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([x.astype("<u8").tobytes() for x in hashes], pa.binary())], names=["key", "all"])

    def alike(batches):
        for batch in batches:
            a, b = ([np.frombuffer(x, "<u8") for x in batch.column(i).to_pylist()] for i in (2, 3))
            both = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(a, b)]
            ok = pa.array([n / (len(x) + len(y) - n) >= similarity for n, x, y in zip(both, a, b)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], names=["a", "b"])

    def ends(pairs: DataFrame) -> DataFrame:
        """The texts of pairs; if they are not too many, tables are not dealt out for them."""
        return sized_broadcast(pairs.select("key").unionByName(pairs.select(F.col("of").alias("key"))).distinct(), 200_000)

    def verified(pairs: DataFrame, most: int | None = None) -> DataFrame:
        """The pairs ``key, of``, ``most`` at most, that are alike, as ``a, b``."""
        pairs = stash(few_files(pairs.distinct(), most), "asked")
        rows = pairs.count()
        least = found.select("key", "least").join(ends(pairs), "key", "left_semi")
        mine = pairs.join(least.withColumnRenamed("least", "x"), "key")
        both = mine.join(least.select(F.col("key").alias("of"), F.col("least").alias("y")), "of").select("key", "of", "x", "y")
        verdict = stash(few_files(both.mapInArrow(judged, "a binary, b binary, clear boolean"), rows), "verdicts")
        release(pairs)
        whole = verdict.where("clear").select("a", "b")
        if not verdict.where(~F.col("clear")).take(1):
            return whole
        # estimates near the limit decide nothing: those pairs are verified by all their shingles
        unclear = verdict.where(~F.col("clear")).select(F.col("a").alias("key"), F.col("b").alias("of"))
        full = stash(few_files(keyed.select("key", "text").join(ends(unclear), "key", "left_semi").dropDuplicates(["key"]).mapInArrow(sets, "key binary, all binary"), 2 * rows), "sets")
        exact = unclear.join(full.withColumnRenamed("all", "x"), "key").join(full.select(F.col("key").alias("of"), F.col("all").alias("y")), "of").select("key", "of", "x", "y")
        links = stash(few_files(whole.unionByName(exact.mapInArrow(alike, "a binary, b binary")), rows), "links")
        for done in (verdict, full):
            release(done)
        return links

    def with_least(df: DataFrame, most: int | None = None) -> DataFrame:
        """The units of two texts or more, with the least text and the number of each."""
        told = df.groupBy("kind", "unit").agg(F.min(F.struct("key", "fp")).alias("h"), F.count(F.lit(1)).alias("n")).where("n > 1")
        return stash(df.join(told.select("kind", "unit", F.col("h.key").alias("of"), F.col("h.fp").alias("of_fp"), "n"), ["kind", "unit"]), "units")

    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("of_fp"))) <= apart
    rest, links = with_least(units), None
    for turn in range(turns + 1):
        most = rest.count()
        more = verified(rest.where("key <> of").where(near).select("key", "of"), most)
        links = more if links is None else links.unionByName(more)
        linked_to = more.select(F.col("a").alias("key"), F.col("b").alias("of"))
        asked, rest = rest, with_least(rest.where("key <> of").join(linked_to, ["key", "of"], "left_anti").select("kind", "unit", "key", "fp"), most)
        release(asked)
        if turn == turns or not rest.take(1):
            break
    small = rest.where(F.col("n") <= few)
    others = small.select("kind", "unit", F.col("key").alias("of"), F.col("fp").alias("of_fp"))
    pairs = small.select("kind", "unit", "key", "fp").join(others, ["kind", "unit"]).where("key > of").where(near).select("key", "of")
    links = links.unionByName(verified(pairs))

    release(rest)

    # the rest is exact: of texts that share one of their rarest runs, all that no links join yet are set against each other, some heads at a time
    joined = components(links).select(F.col("node").alias("key"), "component")
    texts = found.count()
    group = stash(few_files(found.select("key").join(joined, "key", "left").withColumn("component", F.coalesce("component", "key")), texts), "groups")
    by_key = Window.partitionBy("unit").orderBy("key")
    of_unit = Window.partitionBy("unit")
    rest = _rarest(keyed, size, similarity).repartition("unit").withColumns({"no": F.dense_rank().over(by_key), "first": F.min("key").over(of_unit), "last": F.max("key").over(of_unit)})
    rest = rest.where("first <> last").drop("first", "last").dropDuplicates(["unit", "key"])
    # sets alike differ in so many hashes at most; those before the first shared one are not shared
    alone = (1 - similarity) / (1 + similarity) * (F.col("n") + F.col("of_n")) + 1e-6
    odd = sum((F.bit_count(F.col("odd")[k].bitwiseXOR(F.col("of_odd")[k])) for k in range(1, PARITIES // 64)), F.bit_count(F.col("odd")[0].bitwiseXOR(F.col("of_odd")[0])))
    later = 1 + F.least(F.col("n") - F.col("place") - 1, F.col("of_n") - F.col("of_place") - 1)
    can = (F.least("n", "of_n") >= similarity * F.greatest("n", "of_n") - 1e-6) & (F.col("n") + F.col("of_n") - 2 * later <= alone) & (odd <= alone)
    rest, asked, done, step = stash(rest, "rarest"), None, 0, 4 * few
    while True:
        held = rest.join(group, "key")
        told = held.groupBy("unit").agg(F.max("no").alias("most"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").where(F.col("most") > done + 1).select("unit")
        held, before = stash(few_files(held.join(told, "unit", "left_semi").where(F.col("no") > done), rest.count()), "waiting"), rest
        rest = held.drop("component")
        release(before)
        if not rest.take(1):
            break
        sized = held.join(found.select("key", "n", "odd"), "key")
        heads = sized.where(F.col("no") <= done + step).select("unit", F.col("key").alias("of"), *(F.col(c).alias(f"of_{c}") for c in ("n", "odd", "place", "component")))
        pairs = sized.join(heads, "unit").where("key > of and component <> of_component").where(can).select("key", "of").distinct()
        pairs = stash(pairs.join(asked, ["key", "of"], "left_anti") if asked else pairs, "pairs")
        asked = asked.unionByName(pairs) if asked else pairs
        done, step = done + step, 8 * step
        if not pairs.take(1):
            continue
        # what the new links join, as components of the groups so far
        of_a, of_b = (group.select(F.col("key").alias(c), F.col("component").alias(f"of_{c}")) for c in ("a", "b"))
        more = components(verified(pairs).join(of_a, "a").join(of_b, "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b")))
        more = more.select(F.col("node").alias("component"), F.col("component").alias("now"))
        group, before = stash(few_files(group.join(more, "component", "left").select("key", F.coalesce("now", "component").alias("component")), texts), "groups"), group
        release(before)
    release(rest)
    release(found)
    group = group.withColumnRenamed("component", "group")

    ids = keyed.groupBy("key").agg(F.min("id").alias("id")).join(group, "key")
    stay = ids.groupBy("group").agg(F.min(F.struct("id", "key")).alias("s")).select(F.col("s.id").alias(id_), F.col("s.key").alias(key_))
    marked = docs.withColumns({id_: row_id, key_: key})
    return marked.join(stay, [id_, key_], "left_semi").dropDuplicates([id_, key_]).select(*docs.columns)
