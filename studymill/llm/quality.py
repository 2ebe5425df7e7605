"""Quality classifier from weak labels (operator 6).

Method: heuristic labellers, which overlap and may abstain, vote on every document. Expectation-maximisation over the
counts of the vote patterns (3 to the number of labellers at most, so any corpus fits) estimates how often each labeller
votes what in either class, and gives the posterior of every pattern. A linear scorer over hashed features - shapes of
words and of pairs of words, repetition, lengths - learns the posteriors from a sample of about TRAIN documents, which
a hash picks among all (4 * TRAIN at most, and documents of equal features once); every whole document is then scored.
Texts are read once: votes and features are stored.

Low quality comes in kinds, of which a labeller sees one or two, so votes of bad documents aren't independent as the model
takes them to be. The bounds SEES and WRONG keep the estimate from taking one kind for the whole class. A test holds the
estimate against simulated votes of known accuracies.

A document is rejected if its score, the probability of low quality, is at least one half.

Defined results: a text without words (null, empty, white space) has the score 1 and is rejected; texts of one or two
words are scored like others; repeated rows have equal scores; an empty table gives no rows; the sample decides nothing
but the scorer's weights, and is the same for the same table; further columns are carried under names of their own and
given back as they were; no labeller accuses a text of under FEW words, and "variety" says nothing below 30: of these the
scorer alone decides; of a very long text a task holds the words and a number for each; counts of letters in a word of over 32,767 characters are
scaled to that length.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, documents, lean, shingle_hashes, stored

#: Documents from which the scorer learns, about; and hashed features.
TRAIN, DIM = 8192, 1024
SHAPES = 512
LABELLERS = ("repeats", "marks", "capitals", "letters", "letterless", "separators", "phrases", "variety")


_h = xxhash.xxh3_64_intdigest
SIGNS = "!#$%&*+=<>@^~?|\\/_-"


def shape_number(form: str) -> int:
    return _h(form.encode()) % SHAPES << 24


PLAIN = {tail: shape_number("a" + tail) for tail in ("", ".", ",", ";", ":")}


LONGEST = (1 << 15) - 1


def word_code(word: str) -> int:
    """hash 24 bits | shape 9 | letters 15 | capitals 15 | signs at the end, from low to high bits."""
    code, n = _h(word.encode()) & 0xFFFFFF, len(word)
    stem = word if word.isalpha() else word[:-1]
    if n <= LONGEST and stem.islower() and stem.isalpha() and (shape := PLAIN.get(word[len(stem) :])) is not None:
        return code | shape | len(stem) << 33
    letters, capitals = sum(map(str.isalpha, word)), sum(map(str.isupper, word))
    if n > LONGEST:
        letters, capitals = -(-letters * LONGEST // n), -(-capitals * LONGEST // n)
    kinds = ("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word)
    form = "".join(k for k, _ in itertools.groupby(kinds))
    tail = n - len(word.rstrip(SIGNS)) > 1
    return code | shape_number(form + "2" * tail) | letters << 33 | capitals << 48 | tail << 63


class Reader:
    def __init__(self):
        self.memo = Memo(word_code, 150_000)

    def signals(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """(the labellers' signals, the words' shapes); None without words."""
        words = (text or "").split()
        n = len(words)
        if not n:
            return None
        code = np.fromiter(map(self.memo.__getitem__, words), np.uint64, n)
        h, letters = code & np.uint64(0xFFFFFF), (code >> np.uint64(33)).astype(np.int64) & LONGEST
        capitals, tails, bare = (code >> np.uint64(48)).astype(np.int64) & LONGEST, code >> np.uint64(63), letters == 0
        lengths = np.fromiter(map(len, words), np.int64, n)
        total, size = max(1, int(letters.sum())), max(1, int(np.minimum(lengths, LONGEST).sum()))
        again = float((h[1:] == h[:-1]).mean()) if n > 1 else 0.0
        runs = shingle_hashes(h, 3)
        return np.array([
            again,
            float(tails.mean()),
            float(capitals.sum()) / total,
            1 - min(1.0, float(letters.sum()) / size),
            float(bare.mean()),
            float(np.unique(h[bare], return_counts=True)[1].max(initial=0)) / n,
            1 - len(np.unique(runs)) / len(runs),
            1 - len(np.unique(h)) / n if n >= 30 else 0.0,
        ]), (code >> np.uint64(24)).astype(np.int64) & (SHAPES - 1)


EMPTY = np.empty(0)

#: Of each labeller: votes "good" up to the first bound and "bad" from the second on, abstains between.
BOUNDS = np.array([[0.05, 0.25], [0.02, 0.2], [0.2, 0.45], [0.1, 0.24], [0.05, 0.2], [0.04, 0.18], [0.2, 0.45], [0.5, 0.65]])


#: Shares of fewer words say nothing bad: every labeller abstains instead.
FEW = 20


def votes(signals: np.ndarray, n: int) -> np.ndarray:
    """1: bad, 0: good, 2: abstains. n: words of the text."""
    return np.where(signals >= BOUNDS[:, 1], 1 if n >= FEW else 2, np.where(signals <= BOUNDS[:, 0], 0, 2))


def hashed_features(signals: np.ndarray, shapes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, values) of the document's hashed features."""
    n, half = len(shapes), DIM // 2
    one = np.bincount(shapes % half, minlength=half) / n
    two = np.bincount((shapes[1:] * 31 + shapes[:-1]) % half, minlength=half) / max(1, n - 1)
    dense = np.r_[np.sqrt(one), np.sqrt(two)]
    steps = np.minimum(signals * 10, 9).astype(int)  # each signal's tenth, as a feature of its own
    for k, step in enumerate(steps):
        dense[xxhash.xxh3_64_intdigest(f"{k}/{step}") % DIM] += 1
    at = np.flatnonzero(dense)
    return at, dense[at]


def features(df: DataFrame, text: str, kept: list[str]) -> DataFrame:
    """The columns of kept, and pattern (a digit for each labeller's vote; null without words), places, vals."""
    types = dict(df.dtypes)

    def run(batches):
        read = Reader()
        for x in batches:
            pattern, places, values = [], [], []
            for at in range(0, x.num_rows, 64):
                for t in x["text_read"].slice(at, 64).to_pylist():
                    s = read.signals(t)
                    pattern.append("".join(map(str, votes(s[0], len(s[1])))) if s else None)
                    where, value = hashed_features(*s) if s else (EMPTY, EMPTY)
                    places.append(where)
                    values.append(value)
            cuts = pa.array(np.cumsum([0, *map(len, places)]), pa.int32())
            lists = [pa.ListArray.from_arrays(cuts, pa.array(np.concatenate([EMPTY, *c]).astype(kind))) for c, kind in ((places, np.int16), (values, np.float32))]
            yield pa.RecordBatch.from_arrays([*(x[c] for c in kept), pa.array(pattern, pa.string()), *lists], [*kept, "pattern", "places", "vals"])

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in kept), "pattern string, places array<smallint>, vals array<float>"])
    return df.select(*kept, F.col(text).alias("text_read")).mapInArrow(lean(run), schema)


#: Bounds of what is estimated. Low quality comes in kinds and a labeller sees one or two, so none is taken to see more
#: than SEES of the bad documents, or to accuse more than WRONG of the good ones.
SEES, WRONG = 0.6, 0.01


def estimate(patterns: list[tuple[str, int]], rounds: int = 200) -> tuple[dict[str, float], np.ndarray, float]:
    """(posterior of "bad" of each pattern, share of accusing votes[class, labeller], share of bad documents) by expectation-maximisation."""
    if not patterns:
        return {}, np.zeros((2, len(LABELLERS))), 0.0
    v = np.array([[int(c) for c in p] for p, _ in patterns])
    n = np.array([c for _, c in patterns], float)
    accuses, acquits = (v == 1).astype(float), (v == 0).astype(float)  # who abstains says nothing
    share, accused = 0.1, np.array([np.full(v.shape[1], WRONG), np.full(v.shape[1], 0.3)])  # [class, labeller]
    for _ in range(rounds):
        logs = np.log([1 - share, share]) + accuses @ np.log(accused).T + acquits @ np.log(1 - accused).T
        bad = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -500, 500)))
        share = float(np.clip((n * bad).sum() / n.sum(), 1e-4, 0.5))
        for c, w, low, high in ((0, n * (1 - bad), 1e-4, WRONG), (1, n * bad, 0.05, SEES)):
            accused[c] = np.clip((w @ accuses + 0.5) / (w @ (accuses + acquits) + 1), low, high)
    return dict(zip((p for p, _ in patterns), bad.tolist(), strict=True)), accused, share


def fit_linear(rows: list, rounds: int = 300) -> np.ndarray:
    """Weights and, last, the bias of a logistic scorer of the posteriors. rows: (places, values, posterior)."""
    x, y = np.zeros((len(rows), DIM + 1), np.float32), np.empty(len(rows), np.float32)
    for k, (at, values, p) in enumerate(rows):
        x[k, at], x[k, -1], y[k] = values, 1, p
    weight = np.where(y > 0.5, 0.5 / max(1e-6, float(y.mean())), 0.5 / max(1e-6, 1 - float(y.mean()))) if len(y) else y
    w, m, s = np.zeros(DIM + 1), np.zeros(DIM + 1), np.zeros(DIM + 1)
    for k in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-(x @ w.astype(np.float32))))
        g = x.T @ (weight * (p - y)) / max(1, len(y)) + 1e-4 * np.r_[w[:-1], 0]
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(s / (1 - 0.99**k)) + 1e-8)
    return w


def fit(table: DataFrame, train: int = TRAIN) -> tuple[np.ndarray, np.ndarray, float]:
    """(weights, the labellers' estimated votes, share of bad documents) from the rows that features() made."""
    known = table.where("pattern is not null")
    patterns = [(r.pattern, r.n) for r in known.groupBy("pattern").agg(F.count("*").alias("n")).collect()]  # 3 ** len(LABELLERS) at most
    posterior, accused, share = estimate(sorted(patterns))
    every = max(1, -(-sum(n for _, n in patterns) // train))
    order = F.xxhash64("places", "vals")
    some = known.where(F.pmod(order, F.lit(every)) == 0).select("pattern", "places", "vals").distinct().orderBy(order, "pattern", "places", "vals").limit(4 * train)
    rows = [(r.places, r.vals, posterior[r.pattern]) for r in some.collect()]
    return fit_linear(sorted(rows, key=lambda r: (r[2], r[0], r[1]))), accused, share


def scored(df: DataFrame, text: str = "text", keep: list[str] | None = None, train: int = TRAIN) -> DataFrame:
    """The columns of keep (all of df), with quality_score, the probability of low quality, and quality_keep besides."""
    keep = df.columns if keep is None else keep
    names = [f"c{k}" for k in range(len(keep))]  # the caller's names may clash with ours
    wide = df.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)), F.col(text).alias("text_scored"))
    table = stored(features(wide, "text_scored", names), "features")
    weights = fit(table, train)[0]
    types = dict(table.dtypes)

    def run(batches):
        for x in batches:
            lists = x["places"]
            place, value = lists.flatten().to_numpy().astype(int), x["vals"].flatten().to_numpy()
            row = np.repeat(np.arange(x.num_rows), np.diff(lists.offsets.to_numpy()))
            total = np.bincount(row, weights[place] * value, minlength=x.num_rows) + weights[-1]
            score = np.where(x["pattern"].is_null().to_numpy(zero_copy_only=False), 1.0, 1 / (1 + np.exp(-np.clip(total, -500, 500))))
            yield pa.RecordBatch.from_arrays([*(x[n] for n in names), pa.array(score, pa.float64())], [*names, "quality_score"])

    out = table.mapInArrow(run, ", ".join(f"{n} {types[n]}" for n in names) + ", quality_score double")
    return out.select(*(F.col(n).alias(c) for c, n in zip(keep, names, strict=True)), "quality_score", (F.col("quality_score") < 0.5).alias("quality_keep"))


def op6(spark, sf_dir):
    out = scored(documents(spark, sf_dir), keep=["doc_id"])
    return out.select("doc_id", F.col("quality_score").alias("score"), F.col("quality_keep").alias("kept"), F.col("quality_keep").cast("int").alias("quality"))
