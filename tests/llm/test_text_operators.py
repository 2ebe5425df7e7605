"""Token counts, BPE and media against the library, an exact round trip and plain readings."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from studymill.llm import bpe, media, token_counts
from studymill.llm.bpe import NEVER
from studymill.llm.common import default_tokenizer

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def lib():
    return tokenizers.Tokenizer.from_file(default_tokenizer())


def test_counts_equal_the_library(docs, empty, lib):
    got = token_counts.count_tokens(docs).collect()
    assert len(got) == docs.count()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in got:
        t = texts[r.doc_id] or ""
        n = len(lib.encode(t, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 1024)
    assert token_counts.count_tokens(empty).count() == 0


@pytest.mark.parametrize("chunk,overlap", [(40, 4), (64, 8), (300, 16)])
def test_spliced_chunks_equal_the_whole(lib, chunk, overlap):
    counter, rng = token_counts.Counter(default_tokenizer(), 50, chunk, overlap), random.Random(3)
    odd = ["a" * 500, " " * 300, "<|endoftext|>" * 30, "é漢 \n\n  x" * 60, "we'll it's <|endoftext|>  1234 !!" * 20]
    odd += ["".join(rng.choice(["a", "b", " ", "  ", "\n", "1", "'s", "é", "!", "<|endoftext|>", "<|"]) for _ in range(400)) for _ in range(20)]
    for t in odd:
        assert counter.count(t) == len(lib.encode(t, add_special_tokens=False).ids)


def test_bpe_equals_the_library_and_comes_back(docs, empty, lib):
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in bpe.encode_digests(docs).collect():
        ids = lib.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        back = lib.decode(ids, skip_special_tokens=False)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()
    for r in bpe.token_table(docs).collect():
        assert r.ids == lib.encode(texts[r.doc_id] or "", add_special_tokens=False).ids and r.decoded == (texts[r.doc_id] or "")
    assert bpe.encode_digests(empty).count() == 0


def test_long_words_merge_in_the_same_order():
    coder, rng = bpe.ByteBpe(default_tokenizer()), random.Random(5)
    for _ in range(30):
        ids = [coder.first[rng.choice(b"aabcdeinrst")] for _ in range(rng.randint(1, 200))]
        assert coder.merged(list(ids), [coder.pairs.get(a << 20 | b, NEVER) for a, b in zip(ids, ids[1:])]) == coder.merged_long(list(ids))


def test_media_round_trip(docs, empty):
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = media.media_features(media.to_media(docs)).collect()
    assert len(got) == len(docs.collect())
    for r in got:
        n, payload = media.payload_of(texts[r.doc_id])
        assert len(payload) % 192 == 0 and len(payload) > 0
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    assert media.media_features(media.to_media(empty)).count() == 0


def test_all_png_filters_are_undone():
    rng = np.random.default_rng(2)
    want = rng.integers(0, 256, (12, 9), np.uint8)
    raw = np.zeros((12, 10), np.uint8)
    for y in range(12):
        raw[y, 0] = kind = [0, 1, 2, 3, 4, 4, 3, 2, 1, 1, 0, 4][y]
        for x in range(9):
            a = int(want[y, x - 1]) if x else 0
            b = int(want[y - 1, x]) if y else 0
            c = int(want[y - 1, x - 1]) if x and y else 0
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            raw[y, x + 1] = (int(want[y, x]) - [0, a, b, (a + b) // 2, paeth][kind]) % 256
    assert (media.unfiltered(raw) == want).all()


def test_a_damaged_png_is_an_error():
    png = bytearray(media.png_bytes(b"x" * 192))
    png[60] ^= 1
    with pytest.raises(ValueError):
        media.read_png(bytes(png))


def test_png_chunks_out_of_order_are_refused():
    rng = random.Random(4)
    payload = bytes(rng.randrange(256) for _ in range(192 * 900))
    good, at, parts = media.png_bytes(payload), 8, []
    while at < len(good):
        n = int.from_bytes(good[at : at + 4], "big") + 12
        parts.append(good[at : at + n])
        at += n
    assert media.read_png(good).tobytes() == payload and [x[4:8] for x in parts] == [b"IHDR", *[b"IDAT"] * (len(parts) - 2), b"IEND"] and len(parts) > 3
    text = media.chunk(b"tEXt", b"k\0v")
    head, first, rest, end = parts[0], parts[1], b"".join(parts[2:-1]), parts[-1]
    assert media.read_png(good[:8] + head + text + first + rest + end).tobytes() == payload
    for bad in (first + head + rest + end, head + head + first + rest + end, head + first + text + rest + end, text + head + first + rest + end):
        with pytest.raises(ValueError):
            media.read_png(good[:8] + bad)


def test_cosine_hash_against_the_plain_sum():
    """The feature re-derived by its definition: means of the cells, the plain double sum of each coefficient, the median."""
    rng = np.random.default_rng(2)
    for rows in (1, 5, 33, 100):
        x = rng.integers(0, 256, (rows, 192)).astype(np.uint8)
        cut = lambda n, k: [range(n * i // 32, n * (i + 1) // 32) if n >= 32 else [i * n // 32] for i in range(32)][k]
        cells = [[np.mean([x[r, c] for r in cut(rows, i) for c in cut(192, j)]) for j in range(32)] for i in range(32)]
        low = []
        for u in range(8):
            for v in range(8):
                low.append(round(sum(cells[i][j] * np.cos(np.pi * u * (2 * i + 1) / 64) * np.cos(np.pi * v * (2 * j + 1) / 64) for i in range(32) for j in range(32)), 6))
        middle = sorted(low[1:])[31]
        assert media.cosine_hash(x) == f"{int(''.join('1' if z > middle else '0' for z in low), 2):016x}"


def test_op2_merges_a_word_once_where_the_pipeline_merges_it_again(monkeypatch):
    """The query's memo holds more words than the pipeline's; results don't depend on its size."""
    from studymill.llm import queries

    asked = {}
    monkeypatch.setattr(queries.bpe, "encode_digests", lambda df, **kw: asked.update(kw))
    monkeypatch.setattr(queries, "documents", lambda spark, sf_dir: None)
    queries.op2(None, "")
    assert asked["memo"] > 2 * 120_000
    words = ["w" + "".join(chr(97 + k // 26**j % 26) for j in range(3)) for k in range(60)]
    merged, found = {}, {}
    for memo in (4, 200):  # 120 stretches in all
        coder = bpe.ByteBpe(default_tokenizer(), memo)
        merged[memo], plain = [], coder._coded
        monkeypatch.setattr(coder, "_coded", lambda w, seen=merged[memo], plain=plain: seen.append(w) or plain(w))
        found[memo] = [coder.spaced[w + sign] for _ in range(2) for w in words for sign in ("", ",")]
    assert found[4] == found[200] and found[4][1] == coder.stretch(" " + words[0] + ",")
    assert len(merged[200]) == len(words) < len(merged[4])


def test_cuts_at_spaces_hold_the_whole_text():
    for t in ("a b, c", "one", "x (y) z.\nQ r"):
        assert " ".join(bpe.at_spaces(t)) == t == "".join(bpe.stretches(t))
    for t in ("", " a", "a ", "a  b", "a \nb"):
        assert bpe.at_spaces(t) is None and bpe.stretches(t) is None
