"""Token counts of whole texts (operator 1).

Method: overlap resynchronisation. A huge text is encoded by the library in overlapping chunks with offsets. A place
where both of two neighbouring chunks begin a pre-token, far enough from the left chunk's end that nothing unseen could
change it, is a boundary of the whole text too; the two token sequences are spliced there. Where the overlap holds no
such place it is doubled, up to the whole left chunk, and then the left chunk itself is lengthened.

Why a common boundary is proven: the pattern is matched from left to right and looks one character ahead and none back.
If the left chunk starts at a boundary, its boundaries are the text's own, but for the last ones, whose match could
grow or whose look-ahead could change (``GUARD`` characters, which also cover a special string cut in two). From a
common boundary on, the right chunk is matched as the whole text is.

Defined results: a null text counts as empty, with 0 tokens; repeated rows give repeated results; other columns are not
read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from .bpe import stretches
from .common import Memo, default_tokenizer, map_rows

HUGE, CHUNK, OVERLAP = 32_768, 16_384, 256


class Counter:
    def __init__(self, path: str, huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, processors

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.with_offsets = Tokenizer.from_file(path)
        self.with_offsets.no_truncation()
        self.with_offsets.no_padding()
        self.with_offsets.post_processor = processors.ByteLevel(trim_offsets=False)  # offsets keep the leading space; ids stay
        self.guard = 2 + max([0, *(len(t.content) for t in self.lib.get_added_tokens_decoder().values())])
        self.huge, self.chunk, self.overlap = huge, chunk, overlap
        self.memo = Memo(self.whole, 400_000)

    def whole(self, text: str) -> int:
        return len(self.lib.encode(text, add_special_tokens=False))

    def chunk_starts(self, text: str, at: int, end: int) -> tuple[list[int], int]:
        """Offsets in the text at which the tokens of text[at:end] begin, but only of pre-tokens' first ones; their number."""
        got = self.with_offsets.encode(text[at:end], add_special_tokens=False)
        starts, last = [], None
        for k, (w, (a, _)) in enumerate(zip(got.word_ids, got.offsets, strict=True)):
            if w != last or w is None:
                starts.append((at + a, k))
            last = w
        return starts, len(got)

    def spliced(self, text: str) -> int:
        """Tokens of the text, from overlapping chunks."""
        total, at, size = 0, 0, self.chunk
        left, n_left = self.chunk_starts(text, 0, size)
        end = min(size, len(text))
        skip = 0  # tokens of the left chunk before its boundary, counted already
        while end < len(text):
            overlap, found = min(self.overlap, end - at), None
            while True:
                begin, until = end - overlap, min(len(text), end - overlap + size)
                right, n_right = self.chunk_starts(text, begin, max(until, end + 1))
                ours = dict(right)
                for p, k in left:
                    if p >= begin and k > skip and p <= end - self.guard and p in ours:
                        found = (p, k, ours[p])
                        break
                if found or overlap >= end - at:
                    break
                overlap = min(2 * overlap, end - at)
            if found:
                p, k, j = found
                total += k - skip
                at, skip = p, j
                left, n_left, end = right, n_right, min(len(text), max(until, end + 1))
            else:  # no boundary in the whole left chunk: it needs more text
                first = next((p for p, k in left if k == skip), at)
                end = min(len(text), end + (end - first))
                left, n_left = self.chunk_starts(text, first, end)
                at, skip = first, 0
        return total + n_left - skip

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if len(text) > self.huge:
            return self.spliced(text)
        parts = stretches(text)
        return self.whole(text) if parts is None else sum(map(self.memo.__getitem__, parts))


def count_tokens(df: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text."""

    def make():
        counter = Counter(path or default_tokenizer())

        def run(ids, texts):
            out = []
            for i, t in zip(ids, texts, strict=True):
                n = counter.count(t)
                out.append((i, len((t or "").encode()), n, n > limit))
            return out

        return run

    return map_rows(df.select(doc_id, text), make, f"{doc_id} {dict(df.dtypes)[doc_id]}, n_bytes bigint, n_tokens bigint, over_limit boolean")
