"""Token counts of a byte-level BPE vocabulary, without making identifiers.

A text is cut into pieces at single spaces or line feeds between other characters, where
tokens of this kind never join; each piece is pre-split by the vocabulary's pattern and each part
is merged with a heap and a linked list: repeatedly the adjacent pair of lowest rank,
leftmost first, is popped and joined. The count of a part is its bytes less its merges.
Counts of pieces are remembered per worker in two generations of bounded size, so
memory doesn't grow with the corpus.

Null text counts as empty (0 tokens); special strings in a text are one token each, as
the library has it by default; repeated rows are counted each; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame

#: Entries of the younger generation of remembered pieces, per worker.
REMEMBER = 400_000
#: Longer pieces are not remembered.
LONG = 64
#: The usual pre-split pattern of byte-level BPE; a fixed value of the format.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: bytes
    that print as themselves keep their place, the others follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    letters, extra = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in letters:
            letters[b], extra = chr(256 + extra), extra + 1
    return [letters[b] for b in range(256)]


class HeapMerger:
    """Counts what is left of a symbol sequence after all merges.

    ``ranks`` maps left << 20 | right to the pair's rank, ``joined`` a rank to the symbol
    that the pair becomes. Heap entries are rank << 40 | position: the lowest rank comes
    first, then the leftmost; an entry is stale when its position's pair has changed."""

    def __init__(self, ranks: dict[int, int], joined: list[int]):
        self.ranks, self.joined = ranks, joined

    def count(self, symbols: list[int]) -> int:
        n = left = len(symbols)
        get, joined = self.ranks.get, self.joined
        now = [get(a << 20 | b) for a, b in zip(symbols, symbols[1:])]
        heap = [r << 40 | i for i, r in enumerate(now) if r is not None]
        if not heap:
            return n
        heapify(heap)
        now.append(None)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        while heap:
            x = heappop(heap)
            i, rank = x & 0xFFFFFFFFFF, x >> 40
            if now[i] != rank:
                continue
            j = after[i]
            k = after[i] = after[j]
            a = symbols[i] = joined[rank]
            now[j] = now[i] = None
            left -= 1
            if k < n:
                before[k] = i
                r = now[i] = get(a << 20 | symbols[k])
                if r is not None:
                    heappush(heap, r << 40 | i)
            p = before[i]
            if p >= 0:
                r = now[p] = get(symbols[p] << 20 | a)
                if r is not None:
                    heappush(heap, r << 40 | p)
        return left


class Generations:
    """A bounded memory of computed values: what was used since the last turn-over stays."""

    def __init__(self, compute, most: int = REMEMBER):
        self.young: dict = {}
        self.old: dict = {}
        self.compute, self.most = compute, most

    def fill(self, keys) -> None:
        """Make sure that the younger generation holds every key of one call's list."""
        young, old, compute = self.young, self.old, self.compute
        if len(young) > self.most:
            self.old, self.young = young, {}
            young, old = self.young, self.old
        for k in keys:
            if k not in young:
                v = old.get(k)
                young[k] = compute(k) if v is None else v


class Counter:
    """Token counts of one vocabulary file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        ranks, joined = {}, []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            ranks[vocab[a] << 20 | vocab[b]] = rank
            joined.append(vocab[a + b])
        self.symbol = [vocab[c] for c in byte_letters()]
        self.merger = HeapMerger(ranks, joined)
        self.split = regex.compile(PATTERN).findall
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.parts = Generations(self._count_part)
        self.pieces = Generations(self._count_piece)
        self.beside, self.alone = re.compile(r"\s\s"), re.compile(r"(?<=\S)(?= \S)")

    def _count_part(self, part: str) -> int:
        return self.merger.count([*map(self.symbol.__getitem__, part.encode())])

    def _count_plain(self, piece: str) -> int:
        """A word, or a word and one mark, needs no pattern: letters stand together."""
        word = piece[1:] if piece[:1] == " " else piece
        if word.isalpha():
            return self._count_part(piece)
        if word[:-1].isalpha() and word[-1] in ".,;:!?":
            if len(piece) >= LONG:
                return self._count_part(piece[:-1]) + 1
            self.parts.fill((piece[:-1],))
            return self.parts.young[piece[:-1]] + 1
        return sum(map(self._count_part, self.split(piece)))

    def _count_piece(self, piece: str) -> int:
        """A piece after a single space, or after a single line feed that it starts with."""
        if piece[:1] == "\n":
            return 1 + (self._count_plain(piece[1:]) if len(piece) > 1 else 0)
        return self._count_plain(" " + piece)

    def _count_text(self, text: str) -> int:
        if self.beside.search(text):  # a cut is exact only where a white space stands alone
            return sum(map(self._count_plain, self.alone.split(text)))
        pieces = ("\n" + text).replace("\n", " \n").split(" ")[1:]
        long = -1  # for the line feed put before
        if max(map(len, pieces)) >= LONG:
            long += sum(map(self._count_piece, [p for p in pieces if len(p) >= LONG]))
            pieces = [p for p in pieces if len(p) < LONG]
        values = [*map(self.pieces.young.get, pieces)]
        if None in values:
            self.pieces.fill(pieces)
            values = map(self.pieces.young.__getitem__, pieces)
        return long + sum(values)

    def count(self, text: str) -> int:
        if self.special is None or "<" not in text or not self.special.search(text):
            return self._count_text(text) if text else 0
        total = 0
        for k, part in enumerate(self.special.split(text)):
            total += (k > 0) + (self._count_text(part) if part else 0)
        return total


@lru_cache(maxsize=4)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(df: DataFrame, vocabulary: str, limit: int = 1024, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) for every row.

    ``vocabulary``: path of a byte-level BPE file that every executor can open.
    One narrow pass: no shuffle, one row in memory at a time besides Arrow's batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary).count
        for batch in batches:
            n_bytes, n_tokens = [], []
            for x in batch.column(batch.num_columns - 1):
                s = x.as_py() or ""
                n_bytes.append(len(s.encode()))
                n_tokens.append(count(s))
            cols = [batch.column(i) for i in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())], names=[*keys, "n_bytes", "n_tokens", "over_limit"])

    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    some = df.select(*keys, F.col(text).alias("__text"))
    schema = T.StructType([*some.schema.fields[:-1], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])
    return some.mapInArrow(run, schema)
