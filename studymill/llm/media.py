"""Media columns: texts stored as PNG images in a binary column (operator 7).

Method: the payload's bytes are the grey samples of an 8-bit PNG image of 192 columns. The writer filters each line (no
filter, difference to the left or to the line above, whichever has the smallest sum of absolute values), compresses the
lines with zlib and cuts them into chunks with CRC-32 sums. The reader tests signature, chunk order, sums and sizes,
decompresses, and undoes the filters with numpy (all five filter types). From the samples read back come the digests
and a hash: the signs of the low-frequency coefficients of a discrete cosine transform of the image, averaged to 32 by
32 cells, about their median.

Defined results: a null text is the empty text, whose payload is one line of spaces; equal texts have equal values;
repeated rows give repeated results; other columns are not read. A damaged image raises an error in the reader.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, map_rows

WIDTH, LEVEL, CHUNK = 192, 6, 1 << 16
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def png_bytes(payload: bytes, width: int = WIDTH) -> bytes:
    """A grey 8-bit PNG of the payload, whose length is a positive multiple of the width."""
    lines = np.frombuffer(payload, np.uint8).reshape(-1, width)
    left, above = lines.copy(), lines.copy()
    left[:, 1:] -= lines[:, :-1]
    above[1:] -= lines[:-1]
    forms = (lines, left, above)
    cost = np.stack([np.abs(x.view(np.int8).astype(np.int16)).sum(axis=1) for x in forms])
    kind = cost.argmin(axis=0).astype(np.uint8)
    out = np.empty((len(lines), width + 1), np.uint8)
    out[:, 0] = kind
    for k, x in enumerate(forms):
        out[kind == k, 1:] = x[kind == k]
    packed = zlib.compress(out.tobytes(), LEVEL)
    head = chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(lines), 8, 0, 0, 0, 0))
    return SIGNATURE + head + b"".join(chunk(b"IDAT", packed[i : i + CHUNK]) for i in range(0, len(packed), CHUNK)) + chunk(b"IEND", b"")


def unfiltered(raw: np.ndarray) -> np.ndarray:
    """The samples of filtered lines (one byte a sample, the first column has the filter types)."""
    kinds, lines = raw[:, 0], raw[:, 1:]
    if kinds.max(initial=0) > 4:
        raise ValueError("unknown PNG filter")
    out = np.zeros_like(lines)
    at, n = 0, len(lines)
    while at < n:
        end, k = at + 1, kinds[at]
        while end < n and kinds[end] == k:
            end += 1
        part = lines[at:end]
        prior = out[at - 1] if at else np.zeros(lines.shape[1], np.uint8)
        if k == 0:
            out[at:end] = part
        elif k == 1:
            out[at:end] = np.cumsum(part, axis=1, dtype=np.uint8)
        elif k == 2:
            out[at:end] = np.cumsum(np.vstack([prior, part]), axis=0, dtype=np.uint8)[1:]
        else:
            for i in range(at, end):
                up = (out[i - 1] if i else prior).astype(int)
                a = c = 0
                for x in range(lines.shape[1]):
                    b = int(up[x])
                    if k == 3:
                        guess = (a + b) >> 1
                    else:
                        pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                        guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                    a, c = (int(lines[i, x]) + guess) & 255, b
                    out[i, x] = a
        at = end
    return out


def read_png(media: bytes) -> np.ndarray:
    """The samples of a grey 8-bit PNG without interlacing; every chunk's sum is tested, and that the header comes first and once, and the data in one row."""
    if media[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, size, packed, ended, before = 8, None, [], False, b""
    while at < len(media) and not ended:
        (n,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        data = media[at + 8 : at + 8 + n]
        if len(data) != n or struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(data, zlib.crc32(kind)):
            raise ValueError(f"damaged PNG chunk {kind!r}")
        if (kind == b"IHDR") != (at == 8) or (kind == b"IDAT" and packed and before != b"IDAT"):
            raise ValueError(f"PNG chunk {kind!r} out of order")
        if kind == b"IHDR":
            w, h, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", data)
            if (depth, colour, interlaced) != (8, 0, 0):
                raise ValueError("only grey 8-bit images without interlacing")
            size = h, w
        elif kind == b"IDAT":
            packed.append(data)
        ended, before = kind == b"IEND", kind
        at += 12 + n
    if size is None or not ended:
        raise ValueError("PNG without header or end")
    raw = zlib.decompress(b"".join(packed))
    if len(raw) != size[0] * (size[1] + 1):
        raise ValueError("PNG data of a wrong length")
    return unfiltered(np.frombuffer(raw, np.uint8).reshape(size[0], size[1] + 1))


def _cosines(n: int, low: int) -> np.ndarray:
    k, x = np.arange(low)[:, None], np.arange(n)[None, :]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * n))


GRID, LOW = 32, 8
BASIS = _cosines(GRID, LOW)


def cells(samples: np.ndarray, axis: int, n: int = GRID) -> np.ndarray:
    """Means over n stretches of an axis as equal as can be; lines are repeated where there are fewer."""
    size = samples.shape[axis]
    if size < n:
        return np.take(samples, np.arange(n) * size // n, axis=axis).astype(float)
    cuts = np.arange(n) * size // n
    return np.add.reduceat(samples, cuts, axis=axis, dtype=float) / np.expand_dims(np.diff([*cuts, size]), 1 - axis)


def cosine_hash(samples: np.ndarray) -> str:
    """64 bits: whether each of the 8 by 8 lowest coefficients is above their median."""
    low = (BASIS @ cells(cells(samples, 0), 1) @ BASIS.T).round(6).ravel()
    bits = low > np.median(low[1:])
    return np.packbits(bits).tobytes().hex()


def payload_of(text: str | None, width: int = WIDTH) -> tuple[int, bytes]:
    data = (text or "").encode()
    return len(data), data + b" " * (-len(data) % width if data else width)


def to_media(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: the binary column."""

    def make():
        def run(ids, texts):
            return [(i, n, png_bytes(p)) for i, (n, p) in zip(ids, map(payload_of, texts), strict=True)]

        return run

    return map_rows(df.select(doc_id, text), make, f"{doc_id} {dict(df.dtypes)[doc_id]}, n_bytes bigint, media binary")


def media_features(df: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes and what is read back from the column media."""

    def make():
        def run(ids, sizes, medias):
            out = []
            for i, n, m in zip(ids, sizes, medias, strict=True):
                samples = read_png(m)
                back = samples.tobytes()
                out.append((i, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(m), hashlib.sha256(m).hexdigest(), cosine_hash(samples)))
            return out

        return run

    schema = f"{doc_id} {dict(df.dtypes)[doc_id]}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return map_rows(df.select(doc_id, "n_bytes", F.col("media")), make, schema)


def op7(spark, sf_dir):
    return media_features(to_media(documents(spark, sf_dir)))
