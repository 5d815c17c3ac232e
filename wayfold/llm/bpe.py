"""Word-piece BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over the last 16 bytes cuts a text where its low bits are zero, so equal
passages give equal chunks wherever they stand, in whichever document. A chunk is encoded
once per worker, as it stands, and then taken from a bounded memory. Its first and last words
may be cut apart, so each join is repaired: the last ``WINDOW`` words of the left chunk and
the first of the right one are encoded anew as one text, which replaces what the two chunks
said there, provided that its first token agrees with the left chunk's and its last with the
right chunk's at these places. Where they don't agree the window is doubled, up to
``WIDEST`` words; then the text is encoded as a whole. Windows begin and end at a space, and no
step of this kind of vocabulary (white space is dropped, accents compose within a word,
patterns never cross white space) looks across one, so agreement there is exact.

Within a chunk or a window, words between spaces are encoded one by one, each once per worker
as far as a second bounded memory holds it, which is the same as the whole for this kind of
vocabulary and spares the library most calls.

A chunk without enough words joins the next one before anything is encoded. The memory is
of a worker, not of the cluster: sharing all distinct chunks would move every text
through a shuffle. ``Encoder.seen`` and ``Encoder.reused`` count bytes of chunks and of those
that came from memory; results don't depend on it.

Null text counts as empty: no tokens, empty decoding. Special strings in a text are
tokens, as the library has it by default. Repeated rows are encoded each; very long texts
take memory of a few times their length; an empty table gives no rows; extra columns pass
through ``encode`` only if named as keys.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Remembered chunks and words of one generation, per worker; longer ones aren't remembered.
CHUNKS, LONG, WORDS, LONG_WORD = 25_000, 4096, 250_000, 64
#: Mean bytes of a chunk (a power of two) and the least.
MEAN, LEAST = 256, 32
#: Words on each side of a join that are encoded anew, at first and at most.
WINDOW, WIDEST = 2, 16
#: Bytes of results in a batch sent back.
BATCH = 8 << 20

#: One random-looking number per byte value for the rolling hash, from a fixed seed.
_GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, 256, dtype=np.uint32)


def boundaries(data: bytes) -> list[int]:
    """Ends of the content-defined chunks of ``data`` (UTF-8), never inside a character; the
    last is its length."""
    n = len(data)
    if n <= MEAN:
        return [n]
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for k in (1, 2, 4, 8):  # doubling: the sum over 2k bytes from two over k bytes
        later = h.copy()
        later[k:] += h[:-k] * np.uint32(2**k)
        h = later
    ends, last = [], 0
    for e in (np.flatnonzero(h & np.uint32((MEAN - 1) << 8) == 0) + 1).tolist():
        while e < n and data[e] & 0xC0 == 0x80:
            e += 1
        if LEAST <= e - last and e < n:
            ends.append(e)
            last = e
    ends.append(n)
    return ends


def first_words(chunk: str, k: int) -> str | None:
    """The first k words (parted by single spaces) of a chunk that holds more, else None."""
    at = -1
    for _ in range(k):
        at = chunk.find(" ", at + 1)
        if at < 0:
            return None
    return chunk[:at]


def last_words(chunk: str, k: int) -> str | None:
    at = len(chunk)
    for _ in range(k):
        at = chunk.rfind(" ", 0, at)
        if at < 0:
            return None
    return chunk[at + 1 :]


class Encoder:
    """Exact ids and decodings of one vocabulary file, with the reuse above."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer, self.plain = Tokenizer.from_file(path), Tokenizer.from_str(json.dumps(spec | {"normalizer": None}))
        for t in (self.tokenizer, self.plain):
            t.no_truncation()
            t.no_padding()
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.names = [" " + (self.tokenizer.id_to_token(i) or "") for i in range(size)]
        self.young: dict[str, tuple[bytes, int, int]] = {}
        self.old: dict[str, tuple[bytes, int, int]] = {}
        self.words: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}
        self.most, self.most_words, self.seen, self.reused, self.widened = CHUNKS, WORDS, 0, 0, 0
        self.mark = dict(zip(".,", self._library([".", ","])))

    def _library(self, words: list[str]) -> list[bytes]:
        """The library's ids. Lower-case ASCII is what its normaliser makes of ASCII, so such
        words spare it."""
        simple = [x.isascii() and x.islower() and "<" not in x for x in words]
        some = iter(self.plain.encode_batch_fast([x for x, s in zip(words, simple) if s], add_special_tokens=False))
        rest = iter(self.tokenizer.encode_batch_fast([x for x, s in zip(words, simple) if not s], add_special_tokens=False))
        return [array("I", next(some if s else rest).ids).tobytes() for s in simple]

    def _remember(self, words) -> None:
        """Encode in one call what neither generation of words holds. ASCII letters stay
        letters under the normaliser and never join a mark that follows, so a word of them
        before one is remembered without it; other letters may turn into a letter and a
        combining mark, which does join it."""
        young, old, missing, marked = self.words, self.old_words, {}, []
        for w in words:
            v = old.get(w)
            if v is not None:
                young[w] = v
            elif w[-1:] in self.mark and w.isascii() and w[:-1].isalpha():
                marked.append(w)
                if w[:-1] not in young:
                    missing[w[:-1]] = None
            else:
                missing[w] = None
        if missing:
            young.update(zip(missing, self._library([*missing])))
        for w in marked:
            young[w] = young[w[:-1]] + self.mark[w[-1]]

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids of each text. ASCII is lower-cased first, as the vocabulary does, but for
        special strings, which must keep their case."""
        if len(self.words) > self.most_words:
            self.old_words, self.words = self.words, {}
        listed = [(x.lower() if x.isascii() and "<|" not in x else x).split(" ") for x in texts]
        every = set().union(*listed)
        if len(max(every, key=len, default="")) > LONG_WORD:  # not remembered
            long = [w for w in every if len(w) > LONG_WORD]
            self._remember(every.difference(self.words, long))
            known = dict(zip(long, self._library(long)))
            get = lambda w: known.get(w) or self.words[w]
        else:
            self._remember(every.difference(self.words))
            get = self.words.__getitem__
        return [b"".join(map(get, words)) for words in listed]

    def chunks(self, text: str) -> list[str]:
        """The chunks of a text; each but a single one has words to spare at both ends."""
        data, out, start, before = text.encode(), [], 0, 0
        ends = boundaries(data)
        spaces = np.searchsorted(np.flatnonzero(np.frombuffer(data, np.uint8) == 32), ends)
        for end, n in zip(ends, spaces.tolist()):
            if n - before >= 2 * WINDOW:
                out.append(data[start:end].decode())
                start, before = end, n
        if start < len(data):
            rest = data[start:].decode()
            out = [*out[:-1], out[-1] + rest] if out else [rest]
        return out

    def _learn(self, chunks: list[str]) -> list[tuple[bytes, int, int]]:
        """For each chunk its ids, and how many bytes of them its first and last words are."""
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}
        found, missing = {}, []
        for c in dict.fromkeys(chunks):
            known = self.young.get(c) or self.old.get(c)
            if known is None:
                missing.append(c)
            else:
                found[c] = self.young[c] = known
        self.seen += sum(map(len, chunks))
        self.reused += sum(map(len, chunks)) - sum(map(len, missing))
        if missing:
            got = self.ids([*missing, *(first_words(c, WINDOW) or "" for c in missing), *(last_words(c, WINDOW) or "" for c in missing)])
            n = len(missing)
            for i, c in enumerate(missing):
                found[c] = got[i], len(got[n + i]), len(got[2 * n + i])
                if len(c) <= LONG:
                    self.young[c] = found[c]
        return [found[c] for c in chunks]

    @staticmethod
    def _agrees(left: bytes, tail: int, window: bytes, right: bytes, head: int) -> bool:
        """Whether the window's outer tokens are those of the chunks it overlaps."""
        return 0 < tail <= len(left) and 0 < head <= len(right) and len(window) > 4 and window[:4] == left[len(left) - tail : len(left) - tail + 4] and window[-4:] == right[head - 4 : head]

    def _widen(self, a: str, b: str, left: bytes, right: bytes) -> tuple[int, bytes, int] | None:
        k = 2 * WINDOW
        while k <= WIDEST:
            tail, head = last_words(a, k), first_words(b, k)
            if tail is None or head is None:
                return None
            t, w, h = self.ids([tail, tail + head, head])
            if self._agrees(left, len(t), w, right, len(h)):
                return len(t), w, len(h)
            k *= 2
        return None

    def _joined(self, text: str) -> bytes:
        chunks = self.chunks(text)
        known = self._learn(chunks)
        pairs = [*zip(chunks, chunks[1:])]
        windows = self.ids([last_words(a, WINDOW) + first_words(b, WINDOW) for a, b in pairs]) if pairs else []
        out, start = [], 0  # start: bytes of the chunk's ids that a join before has replaced
        for i, (a, b) in enumerate(pairs):
            (left, _, tail), (right, head, _) = known[i], known[i + 1]
            window = windows[i]
            if not self._agrees(left, tail, window, right, head):
                self.widened += 1
                wider = self._widen(a, b, left, right)
                if wider is None:
                    return self._library([text])[0]
                tail, window, head = wider
            if start + tail > len(left):
                return self._library([text])[0]
            out += (left[start : len(left) - tail], window)
            start = head
        return b"".join([*out, known[-1][0][start:]]) if known else b""

    def encode(self, text: str) -> tuple[bytes, str]:
        """Ids as little-endian unsigned 32-bit integers, and their decoding."""
        out = self._joined(text.replace("\n", " ").replace("\t", " "))  # white space only parts words here
        return out, "".join(map(self.names.__getitem__, np.frombuffer(out, "<u4").tolist()))[1:]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(df: DataFrame, vocabulary: str, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, ids (binary, little-endian unsigned 32-bit) and decoded (string) of every row.

    ``vocabulary``: path of a tokenizer file that every executor can open; its
    pre-tokenizer must drop white space. One narrow pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(vocabulary).encode
        for batch in batches:
            ids, decoded, first, size = [], [], 0, 0
            for i, x in enumerate(batch.column(batch.num_columns - 1)):
                a, b = code(x.as_py() or "")
                ids.append(a)
                decoded.append(b)
                size += len(a) + len(b)
                if size > BATCH or i + 1 == batch.num_rows:
                    some = [batch.column(k).slice(first, len(ids)) for k in range(len(keys))]
                    yield pa.RecordBatch.from_arrays([*some, pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], names=[*keys, "ids", "decoded"])
                    ids, decoded, first, size = [], [], i + 1, 0

    some = df.select(*keys, F.col(text).alias("__text"))
    schema = T.StructType([*some.schema.fields[:-1], T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])
    return some.mapInArrow(run, schema)


def digest(df: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, and hashes of the ids and of the decoded text."""
    out = encode(df, vocabulary)
    return out.select("doc_id", F.floor(F.octet_length("ids") / 4).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
