"""Substring deduplication by sliding sentence spans (operator 4).

Method: a text is cut into sentences; every run of several consecutive sentences is hashed; equal runs meet in one
global join; and sentences covered by a run that isn't the first of its kind are removed.

A sentence ends after . ! or ? (also the full-width ones) with closing signs, at a line's end, and before a word that
begins with a capital letter - so that a passage pasted into the middle of a sentence begins a sentence of its own. From
LONG words after such a beginning on, a sentence is also cut after words that a hash picks, which depends on no more
than the last LONG words. A run starts at every sentence and holds two of them, or as many more as ``least`` words need:
that is given by the sentences themselves, so a passage has the same runs wherever it stands. Words are compared as they are, white space
between them is not.

The first of equal runs is the one of the smallest (doc_id, place). The join needs a run only once for each document and
decides which document has the first; where a document repeats a run itself, that is seen in its own text. So the rows
that are shuffled are three integers, and the smallest document is combined before the shuffle. The third is a second
hash of 32 bits of the same words, which must be that of the first document too before anything is removed. A text without
any repeated run is returned unchanged, character by character; of a line that loses words, the rest is joined by single
spaces.

Defined results: null and empty texts are returned as they are; rows without id are returned unchanged and take no part;
rows repeated exactly, and different texts of one id, count as one document, whose sentences aren't removed for their
own sake; a text of which nothing stays is the empty text. Ids are cast to long: one that is no number raises, or is taken as
no id where casts are lenient. Other columns are carried under names of their own and given back as they were. Of a very
long text a task holds the words and a number for each.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MIX_A, MIX_B, Memo, documents, lean, mixed, settled, stored

LONG, PICK = 8, 4
#: Words of a run at least, in the queries: shorter repeats, down to two sentences of a word each, stand in clean texts by
#: chance. The operator's own default is none: every run of two sentences.
LEAST = 20
ENDS = ".!?。！？…"
CLOSING = "\"')]}»”’"


def word_code(word: str) -> int:
    """62 bits of the word's hash | whether it ends a sentence | whether it begins with a capital."""
    bare = word.rstrip(CLOSING)
    return xxhash.xxh3_64_intdigest(word.encode()) & ~3 | (bare[-1:] in ENDS and bare != "") << 1 | word[0].isupper()


class Sentences:
    """Cuts texts into sentences, and hashes words."""

    def __init__(self):
        self.code = Memo(word_code, 120_000).__getitem__

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of the words, index of each sentence's first word)."""
        lines = [x for x in map(str.split, text.split("\n")) if x]
        n = sum(map(len, lines))
        if not n:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        h = np.fromiter(map(self.code, itertools.chain.from_iterable(lines)), np.uint64, n)
        upper, ends = (h & np.uint64(1)).astype(bool), (h & np.uint64(2)).astype(bool)
        begins = np.zeros(n, bool)
        begins[np.cumsum([0, *map(len, lines)])[:-1]] = True
        begins[0] |= upper[0]
        begins[1:] |= ends[:-1] | (upper[1:] & ~upper[:-1])  # a word in capitals after another one is no new sentence
        h = mixed(h >> np.uint64(2))
        place = np.arange(n)
        far = place - np.maximum.accumulate(np.where(begins, place, 0)) >= LONG
        begins[1:] |= far[1:] & (h[:-1] % np.uint64(PICK) == 0)
        return h, np.flatnonzero(begins)


#: Of the second hash: odd, like the first one's factor, and unrelated to it.
SECOND = MIX_B | 1


def runs_of(h: np.ndarray, at: np.ndarray, least: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, second hash, first sentence, number of sentences) of the run that starts at each sentence and is complete."""
    n = len(h)
    ends = np.r_[at[1:], n]
    # the first sentence whose end is least words away, the next one at least
    last = np.maximum(np.searchsorted(ends, at + least), np.arange(len(at)) + 1)
    ok = last < len(at)
    first, last = np.flatnonzero(ok), last[ok]
    # hash of words [a, b): difference of sums of hash * power, times the power that moves it to a common place
    a, b = at[first], ends[last]

    def value(factor: int) -> np.ndarray:
        powers, back = (np.cumprod(np.full(n, np.uint64(x)), dtype=np.uint64) for x in (factor, pow(factor, -1, 1 << 64)))
        sums = np.r_[np.uint64(0), np.cumsum(h * powers, dtype=np.uint64)]
        return mixed((sums[b] - sums[a]) * back[a] ^ (b - a).astype(np.uint64))

    return value(MIX_A).view(np.int64), (value(SECOND) >> np.uint64(32)).astype(np.uint32).view(np.int32), first, last - first + 1


def span_rows(docs: DataFrame, least: int = 0) -> DataFrame:
    """(span, second, doc_id): the runs of sentences of each document, each once."""

    def run(batches):
        cut = Sentences()
        for x in batches:
            for at in range(0, x.num_rows, 64):
                part = x.slice(at, 64)
                spans, seconds, ids = [np.empty(0, np.int64)], [np.empty(0, np.int32)], [np.empty(0, np.int64)]
                for i, t in zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), strict=True):
                    h, starts = cut(t)
                    if len(starts) > 1:
                        span, second, _, _ = runs_of(h, starts, least)
                        span, first = np.unique(span, return_index=True)
                        spans.append(span)
                        seconds.append(second[first])
                        ids.append(np.full(len(span), i, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (spans, seconds, ids)], ["span", "second", "doc_id"])

    return docs.where("doc_id is not null and text is not null").mapInArrow(lean(run), "span long, second int, doc_id long")


def repeated_spans(docs: DataFrame, least: int = 0) -> DataFrame:
    """(gone_id, spans): the runs of each document that a document of a smaller id has too; stored, and the runs of all documents aren't kept."""

    def found() -> DataFrame:
        spans = stored(span_rows(docs, least), "spans")  # both sides of the join; the texts are cut once
        shared = spans.groupBy("span", "second").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("span", "second", "lo")
        later = spans.join(stored(shared, "repeated"), ["span", "second"]).where("doc_id > lo")
        return later.groupBy(F.col("doc_id").alias("gone_id")).agg(F.collect_list("span").alias("spans"))

    return settled(found, "gone")


def without(text: str, spans: list[int] | None, cut: Sentences, least: int = 0) -> tuple[str, int, int]:
    """(the text without the sentences of these runs and of its own repeated runs, sentences it had, words removed)."""
    h, at = cut(text)
    if len(at) < 2:
        return text, len(at), 0
    value, _, first, n = runs_of(h, at, least)
    again = np.ones(len(value), bool)
    again[np.unique(value, return_index=True)[1]] = False
    if spans:
        again |= np.isin(value, np.array(spans, np.int64))
    if not again.any():
        return text, len(at), 0
    # a sentence is gone if a run over it is: +1 where such a run starts, -1 behind its end
    edges = np.zeros(len(at) + 1, np.int64)
    np.add.at(edges, first[again], 1)
    np.add.at(edges, first[again] + n[again], -1)
    drop = np.repeat(np.cumsum(edges[:-1]) > 0, np.diff(np.r_[at, len(h)]))
    out, k = [], 0
    for line in text.split("\n"):
        words = line.split()
        keep = ~drop[k : k + len(words)]
        k += len(words)
        if keep.all():
            out.append(line)
        elif keep.any():
            out.append(" ".join(w for w, kept in zip(words, keep) if kept))
    return "\n".join(out), len(at), int(drop.sum())


def dedup_substrings(df: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 0) -> DataFrame:
    """The rows of df with repeated sentences removed, and n_sentences, n_removed_words besides. least: words of a run at least."""
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    gone = repeated_spans(docs, least)
    names = [f"c{k}" for k in range(len(df.columns))]  # the caller's names may clash with ours
    wide = df.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(df.columns, names, strict=True)))
    id_at, text_at = names[df.columns.index(doc_id)], names[df.columns.index(text)]
    met = wide.join(gone, F.col(id_at).cast("long") == F.col("gone_id"), "left").drop("gone_id")
    types = dict(wide.dtypes)

    def run(batches):
        cut = Sentences()
        for x in batches:
            for at in range(0, x.num_rows, 64):
                part = x.slice(at, 64)
                texts, sizes, words = [], [], []
                for i, t, spans in zip(part[id_at].to_pylist(), part[text_at].to_pylist(), part["spans"].to_pylist(), strict=True):
                    got = (t, 0, 0) if t is None or i is None else without(t, spans, cut, least)
                    for c, v in zip((texts, sizes, words), got, strict=True):
                        c.append(v)
                cols = [pa.array(texts, pa.string()) if n == text_at else part[n] for n in names]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(sizes, pa.int32()), pa.array(words, pa.int32())], [*names, "n_sentences", "n_removed_words"])

    out = met.mapInArrow(lean(run), ", ".join(f"{n} {types[n]}" for n in names) + ", n_sentences int, n_removed_words int")
    return out.select(*(F.col(n).alias(c) for c, n in zip(df.columns, names, strict=True)), "n_sentences", "n_removed_words")


def op4(spark, sf_dir):
    out = dedup_substrings(documents(spark, sf_dir).select("doc_id", "text"), least=LEAST)
    return out.select("doc_id", "text", "n_removed_words", (F.col("n_removed_words") > 0).alias("changed"))
