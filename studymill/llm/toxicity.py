"""Toxicity as an ordinal grade (operator 3).

Method: cumulative-link ordinal regression. P(grade >= k) = sigmoid(w x - t_k): the weights w of the sparse text
features are shared by all thresholds t_1 < t_2 < t_3. Output is the expected severity, the sum of the three
probabilities, from 0 to 3; a document is toxic if P(grade >= 1) is at least one half.

Features are words without outer signs, in lower case, and their beginnings of 3 to 5 letters (so that inflected forms
of one stem share a feature), valued log(1 + count). Those are kept which labelled toxic documents have in MIN_DOCS
documents at least and which labelled clean ones hardly have.

Labels tell toxic or not: an ordinal outcome that is censored above grade 0. Grades of the toxic documents are therefore
estimated before the model is fitted, out of sample: FOLDS models of toxic or not, each fitted without one fold of the
documents, give every document a linear predictor that hasn't seen its label, and the toxic ones are graded 1, 2 or 3 by
the thirds of these predictors. Shared weights and all thresholds are then fitted to these grades by likelihood.

The model is fitted on at most TRAIN labelled documents, which a hash picks; all whole documents are scored.

Defined results: a null or empty text has no features and so the lowest severity; rows without a label or with a null
label aren't learnt from; of several labels of a document the greatest counts, and of several texts of one id the one of
the least hash is learnt from; without labelled toxic rows there are no features and every severity is 0; repeated rows
have equal results; only id and text are read and returned, so other columns can't clash; a very long text is counted word
by word, and holds a count for each feature it has; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, documents

#: Labelled rows, at most, and columns of the model. Features beyond so many share columns by their hash; none is left out.
TRAIN, COLUMNS = 20_000, 1024
MIN_DOCS, MIN_SHARE = 4, 0.8
GRADES, FOLDS = 3, 5
#: Labels that are broadcast; more of them are joined by shuffle.
BROADCAST_LABELS = 200_000
OUTER = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„’‘…¡¿–—"


def features_of(word: str) -> list[int]:
    w = word.lower().strip(OUTER)
    if not w or not w[0].isalpha():
        return []
    forms = ["w:" + w] + [f"{k}:{w[:k]}" for k in (3, 4, 5) if len(w) > k]
    return [xxhash.xxh3_64_intdigest(f.encode()) >> 1 for f in forms]


def sampled_labels(labels: DataFrame, train: int) -> DataFrame:
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train)


def screened(labelled: DataFrame) -> list[int]:
    """Hashes of the features that tell toxic documents, all of them, those of most documents first. labelled: text, toxic."""

    def run(batches):
        memo = Memo(features_of, 300_000)
        for x in batches:
            for at in range(0, x.num_rows, 64):
                part = x.slice(at, 64)
                found, toxic = [], []
                for t, y in zip(part["text"].to_pylist(), part["toxic"].to_pylist(), strict=True):
                    got = {f for w in set((t or "").split()) for f in memo[w]}
                    found += got
                    toxic += [y] * len(got)
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(toxic, pa.int32())], ["feature", "toxic"])

    each = labelled.select("text", "toxic").mapInArrow(run, "feature long, toxic int")
    n = each.groupBy("feature").agg(F.sum((F.col("toxic") > 0).cast("int")).alias("bad"), F.count("*").alias("n"))
    told = n.where((F.col("bad") >= MIN_DOCS) & (F.col("bad") >= MIN_SHARE * F.col("n")))
    return told.orderBy(F.desc("bad"), "feature").select("feature").toArrow()["feature"].to_pylist()  # words of train documents at most


def counts(text: str | None, memo: Memo) -> dict[int, int]:
    """Count of each known feature's column."""
    out: dict[int, int] = {}
    for places in map(memo.__getitem__, (text or "").split()):
        for p in places:
            out[p] = out.get(p, 0) + 1
    return out


def known_features(vocabulary: list[int], columns: int = COLUMNS) -> Memo:
    place = {f: k if k < columns else f % columns for k, f in enumerate(vocabulary)}
    return Memo(lambda w: tuple(place[f] for f in features_of(w) if f in place), 400_000)


class Ordinal:
    """Proportional-odds regression with non-negative steps between its thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, grades: int = GRADES, rounds: int = 400, ridge: float = 1e-4, times: np.ndarray | None = None) -> Ordinal:
        """x: documents by features, y: grades from 0, times: how many documents are such a row."""
        n, d = x.shape
        times = np.ones(n) if times is None else times
        total = max(1.0, float(times.sum()))
        p = np.zeros(d + grades)  # weights, first threshold, logs of the steps
        m, s = np.zeros_like(p), np.zeros_like(p)
        over = (y[:, None] >= np.arange(1, grades + 1)).astype(float)
        mean = times @ over / total
        share, rest = 0.5 / np.clip(mean, 0.02, 0.98), 0.5 / np.clip(1 - mean, 0.02, 0.98)  # each threshold's two sides weigh alike
        cost = np.where(over > 0, share, rest) * (times / total)[:, None]
        for k in range(1, rounds + 1):
            steps = np.exp(p[d + 1 :])
            t = p[d] + np.r_[0, np.cumsum(steps)]
            z = 1 / (1 + np.exp(-np.clip((x @ p[:d].astype(x.dtype)).astype(float)[:, None] - t, -30, 30)))
            e = cost * (z - over)
            g = np.r_[(e.sum(axis=1).astype(x.dtype) @ x).astype(float) + ridge * p[:d], -e.sum(), np.array([-e[:, j + 1 :].sum() * steps[j] for j in range(grades - 1)])]
            m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
            p -= 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(s / (1 - 0.99**k)) + 1e-8)
        return cls(p[:d], p[d] + np.r_[0, np.cumsum(np.exp(p[d + 1 :]))])

    def over(self, found: dict[int, int]) -> np.ndarray:
        """P(grade >= k) for k from 1 on."""
        eta = sum(self.weights[f] * np.log1p(c) for f, c in found.items())
        return 1 / (1 + np.exp(-np.clip(eta - self.thresholds, -500, 500)))


def graded(x: np.ndarray, toxic: np.ndarray, fold: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Grades from 0 to GRADES: 0 of clean documents, the third of the out-of-fold predictor of toxic ones."""
    score = np.zeros(len(x))
    for k in np.unique(fold):
        here = fold == k
        score[here] = x[here] @ Ordinal.fit(x[~here], toxic[~here], grades=1, times=times[~here]).weights if (~here).any() else 0
    bad = toxic > 0
    cuts = np.quantile(np.repeat(score[bad], times[bad]), np.arange(1, GRADES) / GRADES) if bad.any() else []
    return np.where(bad, 1 + np.searchsorted(cuts, score, side="left"), 0)


def fit(docs: DataFrame, labels: DataFrame, train: int = TRAIN) -> tuple[Ordinal | None, list[int]]:
    chosen = sampled_labels(labels, train).withColumnRenamed("doc_id", "of")
    if train <= BROADCAST_LABELS:
        chosen = F.broadcast(chosen)
    labelled = docs.join(chosen, docs["doc_id"] == chosen["of"]).groupBy("of", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    vocabulary = screened(labelled)
    if not vocabulary:
        return None, []

    def run(batches):
        memo = known_features(vocabulary)
        for x in batches:
            for at in range(0, x.num_rows, 64):
                part = x.slice(at, 64)
                got = [sorted(counts(t, memo).items()) for t in part["text"].to_pylist()]
                cols = [pa.array([[x[k] for x in c] for c in got], pa.list_(pa.int32())) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*cols, part["toxic"]], ["places", "counts", "toxic"])

    alike = labelled.select("text", "toxic").mapInArrow(run, "places array<int>, counts array<int>, toxic int").groupBy("places", "counts", "toxic").agg(F.count("*").alias("times"))
    rows = sorted(alike.collect(), key=lambda r: (r.toxic, r.places, r["counts"]))  # train rows at most
    x, toxic, times = np.zeros((len(rows), min(COLUMNS, len(vocabulary))), np.float32), np.zeros(len(rows), int), np.array([r.times for r in rows])
    for k, r in enumerate(rows):
        x[k, r.places], toxic[k] = np.log1p(r["counts"]), r.toxic > 0
    # documents alike are in one fold, whatever their label
    fold = np.array([xxhash.xxh3_64_intdigest(str((r.places, r["counts"]))) % FOLDS for r in rows])
    return Ordinal.fit(x, graded(x, toxic, fold, times), times=times), vocabulary


def severity(docs: DataFrame, labels: DataFrame, train: int = TRAIN) -> DataFrame:
    """doc_id, expected_severity, p_toxic, grade, toxic. docs: doc_id, text; labels: doc_id, toxic."""
    docs = docs.select("doc_id", "text")
    model, vocabulary = fit(docs, labels, train)

    def run(batches):
        memo = known_features(vocabulary)
        for x in batches:
            got = []
            for at in range(0, x.num_rows, 64):
                for t in x["text"].slice(at, 64).to_pylist():
                    got.append(model.over(counts(t, memo)) if model else np.zeros(GRADES))
            p = np.array(got).reshape(-1, GRADES)
            cols = [p.sum(axis=1), p[:, 0], (p >= 0.5).sum(axis=1).astype(np.int32), p[:, 0] >= 0.5]
            yield pa.RecordBatch.from_arrays([x["doc_id"], *map(pa.array, cols)], ["doc_id", "expected_severity", "p_toxic", "grade", "toxic"])

    return docs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, expected_severity double, p_toxic double, grade int, toxic boolean")


def op3(spark, sf_dir):
    return severity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
