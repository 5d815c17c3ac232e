"""Packing of token sequences: order-preserving dynamic programming over cut points.

Documents are tokenised, closed with one end id, and laid end to end in the order of
their partition. Windows are cut at document ends (free) and sentence ends (a truncation, at
a cost of ``SENTENCE_CUT`` tokens). Only where a stretch between two of these is longer than a
window, so that a window in it would hold none, there are cut points inside it: at word
starts, one in ``STEP`` tokens (at ``WORD_CUT``), and every ``FREE_STEP`` tokens where words
are wanting too (at ``FREE_CUT``). Windows of at most ``length`` tokens are chosen so that
padding plus these costs is least: f(j) = min over i within reach of f(i) + p(i), plus
length - p(j) plus the cost of cutting at j; a monotone queue gives that sliding minimum in
constant time per cut point. The stream is cut in blocks of bounded size; a block's best
window end near its end is where the next one starts, so memory doesn't grow with a
partition. It does with the longest single text: some 4 bytes a token for its ids, and 150
for each of its sentences while its windows are chosen.

The last window of a partition is split at powers of two, which need no padding (at most
eleven cuts, wherever they fall). No shuffle: each input partition is packed by itself, and
sequence ids carry its number.

Null text is an empty document: just its end id. Repeated rows are packed each; an empty
table gives no pieces; extra columns are not read. A document longer than a sequence is
cut; each id lies in exactly one piece.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfold.llm.tokens import PATTERN, byte_letters

LENGTH, END_ID = 2048, 1
SENTENCE_CUT, WORD_CUT, STEP, FREE_CUT, FREE_STEP = 4, 10, 12, 24, 64
#: Tokens after which a block is packed, and bytes of ids in a batch sent back.
BLOCK, BATCH = 96 * 2048, 4 << 20


class Ids:
    """Ids of whole texts by one byte-level BPE file."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = {c: b for b, c in enumerate(byte_letters())}
        ranks = {bytes(map(byte.__getitem__, t)): i for t, i in spec["model"]["vocab"].items()}
        made = [spec["model"]["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        if made != sorted(made):
            raise ValueError("ids don't follow the order of merges in this vocabulary")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_at = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.ordinary = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        size = max([*ranks.values(), *self.special.values()]) + 1
        self.ends = np.zeros(size, bool)
        self.ends[[i for t, i in ranks.items() if t[-1:] in b".!?\n"]] = True
        self.starts = np.zeros(size, bool)
        self.starts[[i for t, i in ranks.items() if t[:1] == b" "]] = True

    def _ids(self, text: str) -> bytes:
        return array("I", self.ordinary(text)).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as native unsigned 32-bit integers; special strings as the library has them."""
        if self.special_at is None or "<" not in text or not self.special_at.search(text):
            return self._ids(text)
        return b"".join(array("I", [self.special[x]]).tobytes() if k % 2 else self._ids(x) for k, x in enumerate(self.special_at.split(text)))


@lru_cache(maxsize=2)
def ids_of(path: str) -> Ids:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Ids(path)


def cut_points(ends: np.ndarray, words: np.ndarray, documents: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions after which a window may end, ascending, and the cost of each.

    ``ends``: positions after sentence ends; ``words``: before words; ``documents``: after
    documents. All ascending and above 0; the last document's is the largest."""
    at = np.union1d(documents, ends)
    cost = np.where(np.isin(at, documents, assume_unique=True), 0, SENTENCE_CUT)
    for spare, price, step in ((words, WORD_CUT, min(STEP, length)), (None, FREE_CUT, min(FREE_STEP, length))):
        wide = np.flatnonzero(np.diff(at, prepend=0) > length)
        if not len(wide):
            break
        inside = []
        for w in wide.tolist():
            start, end = int(at[w - 1]) if w else 0, int(at[w])
            own = np.arange(start + step, end, step) if spare is None else spare[np.searchsorted(spare, start, "right") : np.searchsorted(spare, end)]
            inside.append(own if spare is None else own[np.diff((own - start) // step, prepend=-1) > 0])
        extra = np.concatenate(inside).astype(at.dtype)
        at, cost = np.concatenate([at, extra]), np.concatenate([cost, np.full(len(extra), price)])
        order = np.argsort(at, kind="stable")
        at, cost = at[order], cost[order]
    return at, cost


def windows(at: list[int], cost: list[int], length: int, final: bool) -> list[int]:
    """Ends of the windows of least padding plus cutting costs over positions 0..at[-1].

    If not ``final``, the last end is the cheapest one within a window of at[-1]."""
    n = len(at)
    best, back = [0] * (n + 1), [0] * (n + 1)
    place = [0, *at]
    queue = deque([(0, 0)])  # (f + place, index), ascending: the head is the minimum in reach
    pop, popleft, push = queue.pop, queue.popleft, queue.append
    for j in range(1, n + 1):
        p = place[j]
        low = p - length
        while place[queue[0][1]] < low:
            popleft()
        value, i = queue[0]
        back[j] = i
        f = best[j] = value + length - p + cost[j - 1]
        f += p
        while queue and queue[-1][0] >= f:
            pop()
        push((f, j))
    j = n
    if not final:
        while j > 1 and place[j - 1] > place[n] - length:
            j -= 1
        j = min(range(j, n + 1), key=lambda k: (best[k], -k))
    out = []
    while j:
        out.append(place[j])
        j = back[j]
    return out[::-1]


class Packer:
    """Packs one partition's documents in order; ``add`` and ``finish`` return pieces
    (document, start, length, ids, document tokens, sequence, offset)."""

    def __init__(self, length: int, ends: np.ndarray, starts: np.ndarray, first: int):
        self.length, self.ends, self.starts, self.sequence = length, ends, starts, first
        self.docs: deque = deque()  # (document, ids, tokens used already)
        self.held = 0

    def add(self, doc: int, ids: bytes) -> list[tuple]:
        self.docs.append((doc, ids, 0))
        self.held += len(ids) // 4
        return self._pack(False) if self.held >= max(BLOCK, 4 * self.length) else []

    def finish(self) -> list[tuple]:
        return self._pack(True) if self.held else []

    def _pack(self, final: bool) -> list[tuple]:
        whole = np.frombuffer(b"".join([memoryview(ids)[4 * used :] for _, ids, used in self.docs]), np.uint32)
        docs = np.cumsum([len(ids) // 4 - used for _, ids, used in self.docs])
        words = np.flatnonzero(self.starts[whole])
        at, cost = cut_points(np.flatnonzero(self.ends[whole]) + 1, words[words > 0], docs, self.length)
        ends = windows(at.tolist(), cost.tolist(), self.length, final)
        if final:  # the last window as powers of two
            last = ends[-2] if len(ends) > 1 else 0
            rest = ends[-1] - last
            if rest < self.length:
                ends.pop()
                while rest:
                    step = 1 << (rest.bit_length() - 1)
                    last, rest = last + step, rest - step
                    ends.append(last)
        out, start = [], 0
        for end in ends:
            offset = 0
            while start + offset < end:
                doc, ids, used = self.docs[0]
                tokens = len(ids) // 4
                n = min(tokens - used, end - start - offset)
                out.append((doc, used, n, ids[4 * used : 4 * (used + n)], tokens, self.sequence, offset))
                offset += n
                if used + n == tokens:
                    self.docs.popleft()
                else:
                    self.docs[0] = doc, ids, used + n
            start = end
            self.sequence += 1
        self.held -= start
        return out


def pack(df: DataFrame, vocabulary: str, length: int = LENGTH, end_id: int = END_ID, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per piece: key, start, length, ids (binary, little-endian unsigned 32-bit),
    doc_tokens, sequence_id, offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder = ids_of(vocabulary)
        ends = coder.ends.copy()
        if end_id < len(ends):
            ends[end_id] = False
        packer = Packer(length, ends, coder.starts, TaskContext.get().partitionId() << 36)
        tail, names, ready, size, keys, n = array("I", [end_id]).tobytes(), schema.names, [], 0, {}, 0

        def batch(pieces: list[tuple]) -> pa.RecordBatch:
            cols = [*zip(*pieces)]
            first = pa.array([keys[d] for d in cols[0]], kind)
            for k in range(min(keys), pieces[-1][0]):  # pieces come in order
                del keys[k]
            rest = [pa.array(c, t) for c, t in zip(cols[1:], (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()))]
            return pa.RecordBatch.from_arrays([first, *rest], names=names)

        kind = None
        for b in batches:
            kind = b.column(0).type
            for k, x in zip(b.column(0), b.column(1)):
                keys[n] = k.as_py()
                got = packer.add(n, coder.encode(x.as_py() or "") + tail)
                n += 1
                ready += got
                size += sum(4 * g[2] for g in got)
                if size > BATCH:
                    yield batch(ready)
                    ready, size = [], 0
        ready += packer.finish()
        if ready:
            yield batch(ready)

    some = df.select(key, F.col(text).alias("__text"))
    schema = T.StructType([some.schema.fields[0], *(T.StructField(n, t) for n, t in (("start", T.LongType()), ("length", T.LongType()), ("ids", T.BinaryType()), ("doc_tokens", T.LongType()), ("sequence_id", T.LongType()), ("offset", T.LongType())))])
    return some.mapInArrow(run, schema)


def digest(df: DataFrame, vocabulary: str) -> DataFrame:
    out = pack(df, vocabulary)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
