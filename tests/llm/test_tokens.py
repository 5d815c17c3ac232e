import hashlib
import unicodedata

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from wayfold.llm import bpe, packing, tokens

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def byte():
    return Tokenizer.from_file(BYTE)


@pytest.fixture(scope="module")
def word():
    return Tokenizer.from_file(WORD)


def ids(t, text):
    return t.encode(text or "", add_special_tokens=False).ids


def test_counts(docs, texts, byte, no_docs):
    got = tokens.count_tokens(docs, BYTE).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        if r.doc_id is not None:
            n = len(ids(byte, texts[r.doc_id]))
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((texts[r.doc_id] or "").encode()), n, n > 1024), texts[r.doc_id]
    assert tokens.count_tokens(no_docs, BYTE).count() == 0


def test_memory_of_pieces_turns_over(byte):
    c = tokens.Counter(BYTE)
    c.pieces.most = c.parts.most = 5
    for k in range(60):
        text = f"abc{k} def{k}. ghi x{k % 3}"
        assert c.count(text) == len(ids(byte, text))
    assert len(c.pieces.young) < 20


def test_heap_merges_lowest_rank_leftmost():
    m = tokens.HeapMerger({1 << 20 | 1: 0, 2 << 20 | 2: 1}, [2, 3])
    assert [m.count([1] * n) for n in range(6)] == [0, 1, 1, 2, 1, 2]


def test_encoding_and_decoding(docs, texts, word, no_docs):
    got = bpe.digest(docs, WORD).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        if r.doc_id is not None:
            want = ids(word, texts[r.doc_id])
            assert r.n_tokens == len(want), texts[r.doc_id]
            assert r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256(word.decode(want, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.digest(no_docs, WORD).count() == 0


def test_chunks_are_shared_wherever_a_passage_stands():
    passage = " ".join(f"w{i * 7919 % 1000}" for i in range(600)).encode()
    cut = lambda d: {d[a:b] for a, b in zip([0, *bpe.boundaries(d)], bpe.boundaries(d))}
    a, b = cut(b"some head " * 9 + passage), cut(b"another one" * 30 + passage)
    assert len(a & b) >= 5
    assert bpe.boundaries(b"") == [0] and bpe.boundaries(b"x" * 5000)[-1] == 5000


def test_chunk_memory_turns_over(word):
    e = bpe.Encoder(WORD)
    e.most = e.most_words = 3
    for k in range(25):
        text = f"Chunk {k} of many. " * 40 + "é" * k + "tail" * 60
        assert e.encode(text) == expected(word, text)
    assert len(e.young) < 20 and len(e.words) < 200


def expected(word, text):
    want = ids(word, text)
    return np.array(want, "<u4").tobytes(), word.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("every", [1, 7, 40])
def test_joins_anywhere_are_repaired(word, monkeypatch, every):
    """Cuts every few characters: inside words, accents, specials, marks and runs of spaces."""

    def cut(data):
        ends = [e for e in range(every, len(data), every) if data[e] & 0xC0 != 0x80]
        return [*ends, len(data)]

    monkeypatch.setattr(bpe, "boundaries", cut)
    texts = ["The stone's übermäßig e\u0301te\u0301 <|endoftext|>x <|ENDOFTEXT|> don't 3.14 a  b   c    d \n\n e " * 6, "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 4, "  " * 50 + "x" + "  " * 50, "日本 語 \U0001f600 \u0301a ne\u0308st ΣΑΣ İstanbul ſ " * 8, "nospace" * 50]
    for text in texts:
        e = bpe.Encoder(WORD)
        assert e.encode(text) == expected(word, text)
    e = bpe.Encoder(WORD)
    assert e.encode(("ab " * 9 + " " * 30) * 12) == expected(word, ("ab " * 9 + " " * 30) * 12)


def test_disagreement_widens_and_then_encodes_the_whole(word, monkeypatch):
    monkeypatch.setattr(bpe, "boundaries", lambda data: [*range(60, len(data), 60), len(data)])
    text = "one two three four five six seven eight nine ten eleven twelve " * 8
    e = bpe.Encoder(WORD)
    agrees = bpe.Encoder._agrees
    for refused, widened in ((1, 1), (10**6, 1)):  # one window that doesn't agree; none ever does
        left = [refused]

        def fussy(*args):
            left[0] -= 1
            return left[0] < 0 and agrees(*args)

        monkeypatch.setattr(bpe.Encoder, "_agrees", staticmethod(fussy))
        e = bpe.Encoder(WORD)
        assert e.encode(text) == expected(word, text) and e.widened == widened


def test_a_passage_of_many_texts_is_encoded_once(word):
    passage = " ".join(f"w{i * 7919 % 1000}" for i in range(6000))
    e = bpe.Encoder(WORD)
    for k in range(8):
        text = f"text {k} " * (k + 3) + passage + f" end {k}"
        assert e.encode(text) == expected(word, text)
    assert e.reused > 0.7 * e.seen


def test_packing(docs, texts, byte, no_docs):
    got = packing.pack(docs, BYTE).collect()
    pieces, sequences = {}, {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
        assert len(r.ids) == 4 * r.length > 0
    assert set(pieces) == {*range(len(texts)), None}
    for d, own in pieces.items():
        own.sort(key=lambda r: r.start)
        want = [*ids(byte, texts[d] if d is not None else "a text without an id"), 1]
        assert b"".join(bytes(r.ids) for r in own) == np.array(want, "<u4").tobytes()
        assert {r.doc_tokens for r in own} == {len(want)}
    padding = total = 0
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [0, *np.cumsum([r.length for r in own])[:-1]]
        n = sum(r.length for r in own)
        assert n <= 2048
        padding += 0 if n & (n - 1) == 0 else 2048 - n
        total += n
    assert padding < 0.03 * total
    assert packing.pack(no_docs, BYTE).count() == 0


def test_cuts_are_at_documents_and_sentences(byte):
    """Elsewhere only in stretches longer than a window, and in a partition's last window."""
    rng = np.random.default_rng(4)
    words = ["stone", " river", " cloud", " light", " moon"]
    coder = packing.ids_of(BYTE)
    ends = coder.ends.copy()
    ends[packing.END_ID] = False
    packer, out, docs = packing.Packer(256, ends, coder.starts, 0), [], []
    for k in range(300):
        text = "".join(str(rng.choice(words)) + ("." if k % 10 and rng.random() < 0.06 else "") for _ in range(int(rng.integers(1, 400))))
        docs.append(np.frombuffer(coder.encode(text), np.uint32).tolist() + [packing.END_ID])
        out += packer.add(k, np.array(docs[-1], np.uint32).tobytes())
    out += packer.finish()
    stream = np.array(sum(docs, []), np.uint32)
    place = {d: int(s) for d, s in enumerate(np.cumsum([0, *map(len, docs)])[:-1])}
    bounds = np.union1d(np.flatnonzero(ends[stream]) + 1, np.cumsum([*map(len, docs)]))
    cuts, size = {}, {}
    for doc, start, n, _, _, sequence, _ in out:
        cuts[sequence] = max(cuts.get(sequence, 0), place[doc] + start + n)
        size[sequence] = size.get(sequence, 0) + n
    elsewhere = padding = 0
    last = max(s for s, n in size.items() if n & (n - 1) or n == 256)
    for s, cut in cuts.items():
        padding += 0 if size[s] & (size[s] - 1) == 0 else 256 - size[s]
        at = np.searchsorted(bounds, cut)
        if s <= last and bounds[at] != cut:
            elsewhere += 1
            assert bounds[at] - (bounds[at - 1] if at else 0) > 256
    assert 0 < elsewhere < 0.2 * len(cuts) and padding < 0.12 * len(stream)


def test_windows_are_optimal():
    import random

    r = random.Random(2)
    for _ in range(150):
        length = r.randint(5, 20)
        at = sorted({*r.sample(range(1, 60), r.randint(1, 12)), *range(length, 61, length), 60})
        cost = [r.choice([0, 3, 6]) for _ in at]
        place, f = [0, *at], {0: 0}
        for j in range(1, len(place)):
            f[j] = min(f[i] + length - (place[j] - place[i]) + cost[j - 1] for i in range(j) if place[j] - place[i] <= length)
        start, spent = 0, 0
        for e in packing.windows(at, cost, length, True):
            assert e - start <= length
            spent += length - (e - start) + cost[at.index(e)]
            start = e
        assert start == at[-1] and spent == f[len(at)]


def test_bpe_of_every_letter_before_a_stop_and_a_comma(word):
    """All letters and marks, and all code points below U+3000, against the library."""
    own = bpe.Encoder(WORD)
    points = [c for c in map(chr, [*range(1, 0xD800), *range(0xE000, 0x110000)]) if ord(c) < 0x3000 or unicodedata.category(c)[0] in "LM" and not 0x3400 <= ord(c) < 0xA000]
    for i in range(0, len(points), 50_000):
        texts = [f"a{c}. {c}," for c in points[i : i + 50_000]]
        want = [np.array(e.ids, np.uint32).tobytes() for e in word.encode_batch_fast(texts, add_special_tokens=False)]
        got = own.ids([x.replace("\n", " ").replace("\t", " ") for x in texts])
        assert [t for t, a, b in zip(texts, got, want) if a != b] == []
    assert len(points) > 50_000
