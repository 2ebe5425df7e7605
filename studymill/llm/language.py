"""Language identification of mixed-language text (operator 12).

Method: a text's words are scored by each learned language; the script of a word narrows the candidates to the languages
that are written in it; and the Viterbi path over the words, with a penalty for each change of language, labels spans.
The document's language is the one of most letters, and its score is their share of all letters.

A word is a run of letters; of a run longer than PIECE, each PIECE letters are a word. A word's score is the sum over its
hashed runs of 1 to 4 letters, with a mark at either end, of the log of their share in the language over their share in
all languages. Runs that no language has say nothing.

The model is learnt from a sample, which a hash of the id picks, of about TRAIN documents of each language (all, if there
are fewer), each different text once: sums of a table of 4 * 65,536 buckets for each language, which is all that reaches
the driver. All whole documents are labelled.

Long texts: the path is followed in blocks of BLOCK words at once, each from every possible language before it, and the
blocks are joined by the best sums, which gives the same path as one pass. Beyond MANY languages a text is one block.

Defined results: a text that is null or has no letter is "und" with score 0, and so is every text if nothing could be
learned; letters of a script that no learned language uses say nothing about the language; ties go to the language first
in order; documents without language, id or text aren't learnt from, and held_out of a row without id is null; repeated
rows have equal results; only id, text and language are read, so other columns can't clash; an empty table has no rows; of
a very long text a task holds some 40 bytes for each character.
"""

from __future__ import annotations

import functools
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MIX_A, documents

#: Documents of each language in the training sample, about.
TRAIN = 2048
ORDERS, BITS = (1, 2, 3, 4), 16
DIM = 1 << BITS
#: Letters of a word at most; words of a block; languages up to which blocks are used; characters of a batch, about.
PIECE, BLOCK, MANY, BATCH = 32, 256, 32, 1 << 19
#: Cost of a change of language, in the unit of the scores; share of a language's letters from which a script is one of its own.
PENALTY, OWN_SCRIPT = 10.0, 0.005
UNKNOWN = "und"

#: First and last code points of scripts' blocks.
SCRIPTS = {
    "Latin": [(0x41, 0x24F), (0x250, 0x2AF), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)],
    "Greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "Cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "Armenian": [(0x530, 0x58F)],
    "Hebrew": [(0x590, 0x5FF)],
    "Arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "Devanagari": [(0x900, 0x97F)],
    "Bengali": [(0x980, 0x9FF)],
    "Gurmukhi": [(0xA00, 0xA7F)],
    "Gujarati": [(0xA80, 0xAFF)],
    "Tamil": [(0xB80, 0xBFF)],
    "Telugu": [(0xC00, 0xC7F)],
    "Kannada": [(0xC80, 0xCFF)],
    "Malayalam": [(0xD00, 0xD7F)],
    "Thai": [(0xE00, 0xE7F)],
    "Georgian": [(0x10A0, 0x10FF), (0x1C90, 0x1CBF)],
    "Hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "Kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F)],
    "Han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)],
}


@functools.lru_cache(1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """(lower-case form of each code point that is a letter, else 0; number of its script, 0 of those without a name here)."""
    lower, script = np.zeros(sys.maxunicode + 1, np.uint32), np.zeros(sys.maxunicode + 1, np.uint8)
    for c in range(sys.maxunicode + 1):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            lower[c] = ord(low) if len(low) == 1 else c
    for k, ranges in enumerate(SCRIPTS.values(), 1):
        for first, last in ranges:
            script[first : last + 1] = k
    return lower, script


class Words:
    """The words of a batch of texts, as positions in all their code points."""

    def __init__(self, texts: list[str | None]):
        size = np.array([len(t or "") + 1 for t in texts], np.int64)
        self.doc_at = np.cumsum(size) - size  # a sign that is no letter stands behind each text
        points = np.frombuffer("".join(f"{t or ''}\0" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        lower, script = tables()
        self.low = lower[points]
        letter = self.low > 0
        place = np.arange(len(points))
        first = letter & ~np.r_[False, letter[:-1]]
        since = place - np.maximum.accumulate(np.where(first, place, 0))
        self.start = np.flatnonzero(letter & (since % PIECE == 0))
        before = np.r_[0, np.cumsum(letter)]
        bounds = np.r_[self.start, len(points)]
        self.letters = before[bounds[1:]] - before[bounds[:-1]]
        self.script = script[points[self.start]]
        self.doc = np.searchsorted(self.doc_at, self.start, "right") - 1

    def grams(self, lo: int, hi: int, order: int):
        """(positions of letters from lo on and before hi, hashes of the runs of letters that belong to them)."""
        low = np.zeros(hi - lo + 8, np.uint64)  # low[k + 4]: the code point at lo + k
        a, b = max(0, lo - 4), min(len(self.low), hi + 4)
        low[a - lo + 4 : b - lo + 4] = self.low[a:b]
        letter = low > 0
        n = len(low) - order + 1
        h = np.full(n, np.uint64(order))
        for k in range(order):
            h = h * np.uint64(MIX_A) + low[k : k + n]
        bucket = (h * np.uint64(MIX_A)) >> np.uint64(64 - BITS)
        if order == 1:
            at = np.flatnonzero(letter)
            own = at
        elif order == 2:
            at = np.flatnonzero(letter[:-1] | letter[1:])
            own = at + ~letter[at]
        else:
            inner = letter[1 : 1 + n].copy()
            for k in range(2, order - 1):
                inner &= letter[k : k + n]
            at = np.flatnonzero(inner)
            own = at + 1
        here = (own >= 4) & (own < hi - lo + 4)
        return own[here] + (lo - 4), bucket[at[here]].astype(np.int64)

    def windows(self, step: int = BATCH):
        return [(lo, min(lo + step, len(self.low))) for lo in range(0, len(self.low), step)]


class Model:
    """languages; logs: [order, bucket, language]; own: [script, language], whether it is a candidate."""

    def __init__(self, languages: list[str], counts: np.ndarray, letters: np.ndarray):
        """counts: [order, bucket, language]; letters: [script, language]."""
        self.languages = languages
        pool = counts.sum(axis=2)
        share = (pool + 1e-9) / np.maximum(1, pool.sum(axis=1, keepdims=True))
        strength = 200.0  # counts that the shares in all languages are worth
        logs = np.log((counts / share[:, :, None] + strength) / (counts.sum(axis=1, keepdims=True) + strength))
        self.logs = np.where(pool[:, :, None] > 0, logs, 0).astype(np.float32)
        self.own = letters >= OWN_SCRIPT * np.maximum(1, letters.sum(axis=0))
        self.own[~self.own.any(axis=1)] = True

    def scores(self, words: Words) -> np.ndarray:
        """[word, language]."""
        out = np.zeros((len(words.start), len(self.languages)))
        for lo, hi in words.windows():
            here = np.zeros((hi - lo, len(self.languages)), np.float32)
            for k, order in enumerate(ORDERS):
                at, bucket = words.grams(lo, hi, order)
                if order == 2:  # a letter may own two
                    twice = np.r_[at[1:] == at[:-1], False][: len(at)]
                    here[at[twice] - lo] += self.logs[k][bucket[twice]]
                    at, bucket = at[~twice], bucket[~twice]
                here[at - lo] += self.logs[k][bucket]
            a, b = np.searchsorted(words.start, [lo, hi])
            cuts = words.start[a:b] - lo
            if a and (not len(cuts) or cuts[0]):  # the rest of a word that began before
                out[a - 1] += here[: cuts[0] if len(cuts) else None].sum(axis=0)
            if len(cuts):
                out[a:b] += np.add.reduceat(here, cuts, axis=0)
        return np.where(self.own[words.script], out / len(ORDERS), -1e4)


def best_path(score: np.ndarray, first: np.ndarray, penalty: float = PENALTY, block: int = BLOCK) -> np.ndarray:
    """The best label of each word. score: [word, label]; first: where each text's words begin, none of them empty."""
    n, m = score.shape
    if not n:
        return np.empty(0, np.int64)
    ends = np.r_[first[1:], n]
    if m > MANY:
        block = int((ends - first).max())
    blocks = -(-(ends - first) // block)
    text = np.repeat(np.arange(len(first)), blocks)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    start = first[text] + nth * block
    size = np.minimum(start + block, ends[text]) - start
    # a column for each block and label before it; one alone for a text's first block
    of = np.repeat(np.arange(len(start)), np.where(nth > 0, m, 1))
    entry = np.arange(len(of)) - np.searchsorted(of, of)
    order = np.argsort(-size[of], kind="stable")
    column = np.empty(len(of), np.int64)
    column[order] = np.arange(len(of))
    begin, length = start[of][order], size[of][order]
    v = np.zeros((len(of), m))
    held = np.flatnonzero((nth > 0)[of][order])
    v[held] = -1e12
    v[held, entry[order][held]] = 0
    steps = int(length[0])
    top, changed = np.zeros((steps, len(of)), np.int16), np.zeros((steps, len(of), m), bool)
    alive = np.searchsorted(-length, -np.arange(steps), "left")  # columns longer than t
    for t in range(steps):
        k = alive[t]
        w = v[:k]
        best = w.argmax(axis=1)
        other = w[np.arange(k), best] - penalty
        change = other[:, None] > w
        v[:k] = np.where(change, other[:, None], w) + score[begin[:k] + t]
        top[t, :k], changed[t, :k] = best, change
    # the blocks of a text, joined
    exit_, chosen = np.empty(len(start), np.int64), np.empty(len(start), np.int64)
    at = np.searchsorted(of, np.arange(len(start)))  # first column of each block, before sorting
    single = np.flatnonzero(blocks == 1)
    head = np.cumsum(blocks) - blocks
    exit_[head[single]] = v[column[at[head[single]]]].argmax(axis=1)
    chosen[head[single]] = column[at[head[single]]]
    for d in np.flatnonzero(blocks > 1):
        b = head[d]
        vec, came = v[column[at[b]]], []
        for j in range(b + 1, b + blocks[d]):
            sums = vec[:, None] + v[column[at[j] + np.arange(m)]]
            came.append(sums.argmax(axis=0))
            vec = sums.max(axis=0)
        now = int(vec.argmax())
        for j in range(b + blocks[d] - 1, b, -1):
            exit_[j] = now
            now = int(came[j - b - 1][now])
            chosen[j] = column[at[j] + now]
        exit_[b], chosen[b] = now, column[at[b]]
    # back through all blocks at once
    order = np.argsort(-size, kind="stable")
    start, size, now, chosen = start[order], size[order], exit_[order], chosen[order]
    out = np.empty(n, np.int64)
    alive = np.searchsorted(-size, -np.arange(steps), "left")
    for t in range(steps - 1, -1, -1):
        k = alive[t]
        out[start[:k] + t] = now[:k]
        change = changed[t, chosen[:k], now[:k]]
        now[:k] = np.where(change, top[t, chosen[:k]], now[:k])
    return out


def labelled(texts: list[str | None], model: Model, penalty: float = PENALTY) -> tuple[list[str], list[float], list[list[dict]]]:
    """(language, score, spans) of each text."""
    n, m = len(texts), len(model.languages)
    language, score, spans = [UNKNOWN] * n, [0.0] * n, [[] for _ in texts]
    words = Words(texts)
    if not m or not len(words.start):
        return language, score, spans
    first = np.flatnonzero(np.r_[True, words.doc[1:] != words.doc[:-1]])
    label = best_path(model.scores(words), first, penalty)
    total = np.bincount(words.doc * m + label, words.letters, n * m).reshape(n, m)
    best, whole = total.argmax(axis=1), total.sum(axis=1)
    for d in np.flatnonzero(whole):
        language[d], score[d] = model.languages[best[d]], float(total[d, best[d]] / whole[d])
    begins = np.flatnonzero(np.r_[True, (words.doc[1:] != words.doc[:-1]) | (label[1:] != label[:-1])])
    last = np.r_[begins[1:], len(label)] - 1
    d = words.doc[begins]
    start = words.start[begins] - words.doc_at[d]
    end = words.start[last] + words.letters[last] - words.doc_at[d]
    for row in zip(d.tolist(), start.tolist(), end.tolist(), label[begins].tolist(), strict=True):
        spans[row[0]].append({"start": row[1], "end": row[2], "lang": model.languages[row[3]]})
    return language, score, spans


def batches_of(texts: list[str | None]):
    """(first, end) of runs of texts of about BATCH characters."""
    at, size = 0, 0
    for k, t in enumerate(texts):
        if size and size + len(t or "") > BATCH:
            yield at, k
            at, size = k, 0
        size += len(t or "") + 1
    if at < len(texts):
        yield at, len(texts)


def remainder(doc_id):
    """crc32 of the id as text, modulo 5: 0 is held out."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5


def fit(docs: DataFrame, train: int = TRAIN) -> Model:
    """docs: doc_id, text, lang, all of them to be learnt from."""
    spark = docs.sparkSession
    known = docs.where("doc_id is not null and text is not null and lang is not null")
    number = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    languages = sorted(number)
    if not languages:
        return Model([], np.zeros((len(ORDERS), DIM, 0)), np.zeros((len(SCRIPTS) + 1, 0)))
    rates = spark.createDataFrame([(x, k, min(1.0, train / number[x])) for k, x in enumerate(languages)], "of string, place int, rate double")
    picked = F.pmod(F.xxhash64("doc_id", F.lit("language sample")), F.lit(1 << 30)) < F.col("rate") * (1 << 30)
    sample = known.join(F.broadcast(rates), known["lang"] == rates["of"]).where(picked).select("place", "text").dropDuplicates()
    n_grams = len(ORDERS) * DIM

    def run(batches):
        found: dict[int, np.ndarray] = {}
        for x in batches:
            places, texts = x["place"].to_numpy(), x["text"].to_pylist()
            for lo, hi in batches_of(texts):
                for p in np.unique(places[lo:hi]).tolist():
                    words = Words([t for t, q in zip(texts[lo:hi], places[lo:hi].tolist(), strict=True) if p == q])
                    total = found.setdefault(p, np.zeros(n_grams + len(SCRIPTS) + 1, np.int64))
                    for a, b in words.windows():
                        for k, order in enumerate(ORDERS):
                            total[k * DIM : (k + 1) * DIM] += np.bincount(words.grams(a, b, order)[1], minlength=DIM)
                    total[n_grams:] += np.bincount(words.script, words.letters, len(SCRIPTS) + 1).astype(np.int64)
        for p, total in found.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), p, np.int32)), pa.array(at.astype(np.int32)), pa.array(total[at])], ["place", "feature", "n"])

    each = sample.mapInArrow(run, "place int, feature int, n long").groupBy("place", "feature").agg(F.sum("n").alias("n"))
    got = each.toArrow()  # a row for each language and bucket at most
    counts = np.zeros((n_grams + len(SCRIPTS) + 1, len(languages)))
    counts[got["feature"].to_numpy(), got["place"].to_numpy()] = got["n"].to_numpy()
    return Model(languages, counts[:n_grams].reshape(len(ORDERS), DIM, -1), counts[n_grams:])


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", penalty: float = PENALTY) -> DataFrame:
    """doc_id, lang_pred, score, spans (start, end, lang): one row for each row of docs; places count code points."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 1 MB for each language

    def run(batches):
        for x in batches:
            texts = x["text"].to_pylist()
            for lo, hi in batches_of(texts):
                language, score, spans = labelled(texts[lo:hi], shared.value, penalty)
                cols = [pa.array(language, pa.string()), pa.array(score, pa.float64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])))]
                yield pa.RecordBatch.from_arrays([x["doc_id"].slice(lo, hi - lo), *cols], ["doc_id", "lang_pred", "score", "spans"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, lang_pred string, score double, spans array<struct<start:long,end:long,lang:string>>")


def op12(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    found = identify(docs, fit(docs.where(remainder(F.col("doc_id")) != 0)))
    return found.select("doc_id", (remainder(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score")
