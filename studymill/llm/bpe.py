"""Byte-level BPE encoding and decoding (operator 2).

Method: contiguous rank array. For each short word the part ids and the ranks of adjacent pairs lie in two arrays;
the smallest rank is searched again and again, the boundary there is deleted and the two neighbouring ranks are
refreshed. Words of many bytes, for which that costs the square of their length, use a heap of the same pairs in the
same order (rank, then position).

Defined results: a null text is the empty text; the empty text has no tokens and decodes to the empty text; special
strings in a text become their special ids, as is the library's default; ties of rank go to the leftmost pair.
Repeated rows give repeated results; columns other than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re

import regex
from pyspark.sql import DataFrame

from .common import Memo, default_tokenizer, map_rows

#: The pre-tokenising pattern of byte-level BPE vocabularies of this family (fixed value), with white space spelled as
#: the Unicode property: this regex module's \s also holds U+001C to U+001F, which the property doesn't.
SPACE, NO_SPACE = r"\p{White_Space}", r"\P{White_Space}"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|{SPACE}+(?!{NO_SPACE})|{SPACE}+"
SHORT = 48
#: After ASCII letters, each of these signs is a pre-token of its own where a stretch ends with it.
MARKS = frozenset(".,;:!?")
#: A space where a cut would not be a boundary of the pattern in every case: beside white space, or at an end.
ODD_SPACE = re.compile(r" \s|\s |\A\s|\s\Z")
NEVER = 1 << 60
#: Entries of each generation of a memo: what fits beside the pipeline's other stages. The query alone has room for more, and
#: then fewer words are merged again.
MEMO, ROOMY = 120_000, 300_000


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files: itself if printable, else the next from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = {chr(b): b for b in plain}, 256
    for b in sorted(set(range(256)) - set(plain)):
        out[chr(spare)] = b
        spare += 1
    return out


class ByteBpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str, memo: int = MEMO):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: bytes(map(letters.__getitem__, s)) if all(c in letters for c in s) else s.encode() for s, i in vocab.items()}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.first = [vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        #: pair of ids -> rank << 20 | merged id
        self.pairs = {vocab[a] << 20 | vocab[b]: r << 20 | vocab[a + b] for r, (a, b) in enumerate(pairs)}
        #: ranks of the pairs of single bytes
        self.of_bytes = [[self.pairs.get(a << 20 | b, NEVER) for b in self.first] for a in self.first]
        self.findall = regex.compile(PATTERN).findall
        self.specials = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.names = {i: str(i) for i in self.bytes_of}
        self.words = Memo(self._word, 120_000)
        self.known = Memo(self.stretch, memo)
        #: by what follows the space that begins the stretch
        self.spaced = Memo(lambda s: self.stretch(" " + s), memo)
        self.pieces = Memo(self._coded, 100_000)

    def _word(self, word: str) -> tuple[int, ...]:
        data = word.encode("utf-8", "surrogatepass")
        ids = list(map(self.first.__getitem__, data))
        if len(ids) > SHORT:
            return tuple(self.merged_long(ids))
        table = self.of_bytes
        return tuple(self.merged(ids, [table[a][b] for a, b in zip(data, data[1:])]))

    def _coded(self, word: str) -> tuple[str, bytes]:
        ids = self._word(word)
        return ",".join(map(self.names.__getitem__, ids)), b"".join(map(self.bytes_of.__getitem__, ids))

    def stretch(self, s: str) -> tuple[str, bytes]:
        """(ids joined by commas, the bytes that the decoder makes of these ids) of a text without special strings."""
        if s.isascii():
            body = s[1:] if s[:1] == " " else s
            if body.isalpha():
                return self._coded(s)
            if body[-1:] in MARKS and body[:-1].isalpha():
                (a, x), (b, y) = self.known[s[:-1]] if body is s else self.spaced[body[:-1]], self.pieces[s[-1]]
                return f"{a},{b}", x + y
        found = [self.pieces[w] for w in self.findall(s)]
        return ",".join(a for a, _ in found), b"".join(x for _, x in found)

    def has_special(self, text: str) -> bool:
        return any(s in text for s in self.special)

    def merged(self, ids: list[int], ranks: list[int]) -> list[int]:
        """The parts ids of a word, whose neighbours have these ranks, after all merges."""
        get = self.pairs.get
        never = NEVER
        while ranks and (best := min(ranks)) != never:
            i = ranks.index(best)
            ids[i] = new = best & 0xFFFFF
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << 20 | new, never)
            if i < len(ranks):
                ranks[i] = get(new << 20 | ids[i + 1], never)
        return ids

    def merged_long(self, ids: list[int]) -> list[int]:
        """The same merges in the same order, in n log n steps."""
        n, get = len(ids), self.pairs.get
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get(ids[i] << 20 | ids[i + 1], NEVER)) != NEVER]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue  # one of the two parts has changed since
            ids[i], ids[j], k = r & 0xFFFFF, -1, after[j]
            after[i] = k
            if k >= 0:
                before[k] = i
            for x, y in ((before[i], i), (i, k)):
                if x >= 0 and y >= 0 and (q := get(ids[x] << 20 | ids[y], NEVER)) != NEVER:
                    heapq.heappush(heap, (q, x, ids[x], ids[y]))
        return [x for x in ids if x >= 0]

    def plain(self, text: str) -> list[int]:
        out: list[int] = []
        for w in self.findall(text):
            out += self.words[w]
        return out

    def encode(self, text: str) -> list[int]:
        if not self.has_special(text):
            return self.plain(text)
        return [i for k, part in enumerate(self.specials.split(text)) for i in ([self.special[part]] if k % 2 else self.plain(part))]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def at_spaces(text: str) -> list[str] | None:
    """The text cut at each single space; None where that would not be a boundary of the pattern in every case.

    A space between two characters that are no white space always begins a new pre-token: white-space runs can't end
    there and no other alternative holds a space but as its first character.
    """
    if not text or ODD_SPACE.search(text):
        return None
    return text.split(" ")


def stretches(text: str) -> list[str] | None:
    """The same cuts, but each space stays with what follows it."""
    parts = at_spaces(text)
    return parts and [parts[0], *(" " + p for p in parts[1:])]


def token_table(df: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, ids array<int>, decoded: the operator's full results."""

    def make():
        bpe = ByteBpe(path or default_tokenizer())

        def run(ids, texts):
            out = []
            for i, t in zip(ids, texts, strict=True):
                got = bpe.encode(t or "")
                out.append((i, got, bpe.decode(got)))
            return out

        return run

    return map_rows(df.select(doc_id, text), make, f"{doc_id} {dict(df.dtypes)[doc_id]}, ids array<int>, decoded string")


def encode_digests(df: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, memo: int = MEMO) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: every whole text encoded, and decoded from the ids alone.

    Texts are handled in stretches between proven pre-token boundaries. A stretch's ids, and the bytes that the decoder
    makes of these ids alone, are reused where it comes again; the text's ids and bytes are those of its stretches, one
    after the other, for the decoder maps each id to its bytes. UTF-8 is decoded from the bytes of the whole text.
    """

    def make():
        bpe = ByteBpe(path or default_tokenizer(), memo)
        spaced = bpe.spaced.__getitem__

        def run(ids, texts):
            out = []
            for i, t in zip(ids, texts, strict=True):
                t = t or ""
                parts = None if bpe.has_special(t) else at_spaces(t)
                if parts is None:
                    got = bpe.encode(t)
                    joined, back = ",".join(map(str, got)), b"".join(map(bpe.bytes_of.__getitem__, got))
                else:
                    found, made = zip(bpe.known[parts[0]], *map(spaced, parts[1:]), strict=True)
                    joined, back = ",".join(found), b"".join(made)
                back = back.decode("utf-8", "replace").encode()
                out.append((i, joined.count(",") + 1 if joined else 0, hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(back).hexdigest()))
            return out

        return run

    return map_rows(df.select(doc_id, text), make, f"{doc_id} {dict(df.dtypes)[doc_id]}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
