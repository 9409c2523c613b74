"""Packing of tokenised documents into training sequences."""

from __future__ import annotations

import base64
import re
import zlib
from array import array
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ENCODERS: dict[tuple[str, str], "Encoder"] = {}

#: Two white-space characters together: only there does the pattern's look-ahead matter.
_RUN = re.compile(r"\s\s")


class Encoder:
    """Token ids of a text as little-endian 32-bit bytes.

    Without the pattern's look-ahead, which tells runs of white space apart,
    the ids come a third faster; texts with such runs take the whole pattern,
    texts that hold the special token's name the tokenizers library.
    """

    def __init__(self, json_path: str, ranks_path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}

        def ids_of(pattern: str):
            return tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

        self.fast = ids_of(public_tokenizers.PATTERN.replace(r"\s+(?!\S)|", ""))
        self.whole = ids_of(public_tokenizers.PATTERN)
        self.plain = Tokenizer.from_file(json_path)
        self.special = [t.content for t in self.plain.get_added_tokens_decoder().values()]

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            ids = self.plain.encode(text, add_special_tokens=False).ids
        else:
            ids = (self.whole if _RUN.search(text) else self.fast)(text)
        return array("I", ids).tobytes()


def encoder(json_path: str, ranks_path: str) -> Encoder:
    """One encoder per Python worker."""
    key = (json_path, ranks_path)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]


class CapacityTree:
    """Segment tree over remaining capacities 0..size: which have an open window."""

    def __init__(self, size: int):
        self.base = 1 << size.bit_length()
        self.open = [0] * (2 * self.base)

    def add(self, capacity: int, n: int) -> None:
        node = self.base + capacity
        while node:
            self.open[node] += n
            node >>= 1

    def tightest(self, need: int) -> int:
        """The least capacity >= need with an open window; -1 if there is none."""
        node = self.base + need
        if self.open[node]:
            return need
        while node > 1:
            if not node & 1 and self.open[node + 1]:
                node += 1
                while node < self.base:
                    node = 2 * node + (not self.open[2 * node])
                return node - self.base
            node >>= 1
        return -1


def best_fit_decreasing(lengths: list[int], window: int) -> list[list[tuple[int, int, int]]]:
    """Windows of (document, start, length) pieces.

    Overlong documents are first cut into full windows; the rests go, longest
    first, to the tightest open window. Windows still not full then lend
    their pieces, emptiest window first, to the gaps of the fullest, and the
    one that stays part full is cut at powers of two, which need no padding.
    """
    full, rests = [], []
    for doc, n in enumerate(lengths):
        for start in range(0, n - window + 1, window):
            full.append([(doc, start, window)])
        if n % window:
            rests.append((n % window, doc, n - n % window))
    rests.sort(key=lambda r: (-r[0], r[1]))
    tree, at = CapacityTree(window), defaultdict(list)
    bins: list[list[tuple[int, int, int]]] = []
    for n, doc, start in rests:
        capacity = tree.tightest(n)
        if capacity < 0:
            bins.append([])
            k, capacity = len(bins) - 1, window
        else:
            k = at[capacity].pop()
            tree.add(capacity, -1)
        bins[k].append((doc, start, n))
        if left := capacity - n:
            at[left].append(k)
            tree.add(left, 1)
    partial = sorted((window - left, k) for left, ks in at.items() for k in ks)
    filled = {k: window - left for left, ks in at.items() for k in ks}
    out = full + [b for k, b in enumerate(bins) if k not in filled]
    lo, hi = 0, len(partial) - 1
    while lo < hi:
        giver, taker = bins[partial[lo][1]], bins[partial[hi][1]]
        gap = window - sum(p[2] for p in taker)
        while gap and giver:
            doc, start, n = giver.pop()
            take = min(gap, n)
            taker.append((doc, start + n - take, take))
            gap -= take
            if n > take:
                giver.append((doc, start, n - take))
        if not gap:
            out.append(taker)
            hi -= 1
        if not giver:
            lo += 1
    if lo == hi:
        rest, left = bins[partial[lo][1]], sum(p[2] for p in bins[partial[lo][1]])
        while left:
            size, part = 1 << (left.bit_length() - 1), []
            left -= size
            while size:
                doc, start, n = rest.pop()
                take = min(size, n)
                part.append((doc, start, take))
                size -= take
                if n > take:
                    rest.append((doc, start + take, n - take))
            out.append(part)
    return out


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, *, json_path: str, ranks_path: str, window: int = 1024, block_tokens: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack documents into sequences of at most ``window`` tokens; a row per piece.

    A document is its text's ids and the end id 0. Each task packs its own
    documents in blocks of ``block_tokens``, so that nothing is shuffled and
    memory stays bounded; a block leaves no padding. Null texts count as
    empty (only the end id), null ids stay null, repeated rows are packed as
    often as they come, an empty table gives no rows, other columns are not
    read. Sequence ids are unique over the table: the task's number times
    2^33 and a counter.
    """

    def flush(ids: list, blobs: list[bytes], first: int):
        blob = {k: np.frombuffer(b, "<u4") for k, b in enumerate(blobs)}
        rows = [[] for _ in range(7)]
        sequences = best_fit_decreasing([len(b) // 4 for b in blobs], window)
        for k, sequence in enumerate(sequences):
            offset = 0
            for doc, start, n in sequence:
                piece = blob[doc][start : start + n]
                for column, value in zip(rows, (ids[doc], start, n, zlib.crc32(piece.tobytes()), len(blob[doc]), first + k, offset)):
                    column.append(value)
                offset += n
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        for at in range(0, len(rows[0]), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 20_000], pa.int64()) for c in rows], names=names)
        return len(sequences)

    def run(batches):
        enc = encoder(json_path, ranks_path)
        base = TaskContext.get().partitionId() << 33
        ids, blobs, held = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                blob = enc.encode(text.as_py() or "") + b"\0\0\0\0"
                ids.append(doc_id.as_py())
                blobs.append(blob)
                held += len(blob) // 4
                if held >= block_tokens:
                    base += yield from flush(ids, blobs, base)
                    ids, blobs, held = [], [], 0
        if ids:
            yield from flush(ids, blobs, base)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)
