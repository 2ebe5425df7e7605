"""Importance resampling toward a target distribution (operator 13), by DataFrame functions alone.

Method: the features of a text, runs of 1 to WIDTH consecutive words, are exploded and hashed (CRC-32 modulo BUCKETS);
grouped counts of the buckets over all documents and over all texts of the target give each bucket's gain, the log ratio
of its shares; the table of gains, BUCKETS rows at most, is broadcast and joined to the documents' features, whose gains
are summed; a seeded Gumbel number is added; and the documents with the highest scores are drawn without replacement.

The ranking is a distributed sort: documents are dealt by ranges of their score and written in order with their number
within their range; the counts of the ranges, a row for each, give the offsets, which are broadcast. No window holds all
rows, and no rank needs another shuffle.

A document's sum is combined within the task that explodes it, so one row for each document is shuffled, and a row for
each bucket and task of the counts. Documents are exploded twice, once for either.

Defined results: a null or empty text has no features, the weight 0 and isn't eligible if LEAST is positive; rows
repeated exactly are rows of their own with one score each, and are drawn apart; ties go to the smaller id, rows without
id last, then to fewer features and the smaller weight; a row without id has the seeded number of the empty id; an empty
target has T = 0 and gives every bucket its smoothed gain; an empty table has no rows; only the id and the text of a
table are read, so its other columns can't clash; a very long text is one array of words in its task.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, stored

#: A word, once A-Z is lower case: letters, digits and what isn't ASCII.
TOKEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WIDTH, BUCKETS, SEED = 1, 10_000, "2024"
#: Words of an eligible document, and the percentage of them that is drawn.
LEAST, PERCENT = 20, 10


def words_of(text):
    return F.regexp_extract_all(F.translate(text, string.ascii_uppercase, string.ascii_lowercase), F.lit(TOKEN), F.lit(0))


def runs_of(words, width: int):
    """All runs of 1 to width words, each joined by single spaces."""
    if width == 1:
        return words
    of = lambda k: F.transform(F.sequence(F.lit(1), F.size(words) - (k - 1)), lambda i: F.array_join(F.slice(words, i, k), " "))
    return F.flatten(F.array(words, *(F.when(F.size(words) >= k, of(k)).otherwise(F.array().cast("array<string>")) for k in range(2, width + 1))))


def bucket_rows(df: DataFrame, text: str, width: int, buckets: int, *keep: str) -> DataFrame:
    """The columns of keep, n_words and bucket: a row for each feature, and one with a null bucket for a text without any."""
    words = df.select(*keep, words_of(F.col(text)).alias("words"))
    each = words.select(*keep, F.coalesce(F.size("words"), F.lit(0)).alias("n_words"), F.explode_outer(runs_of(F.col("words"), width)).alias("feature"))
    return each.select(*keep, "n_words", (F.crc32(F.encode("feature", "UTF-8")) % buckets).cast("int").alias("bucket"))


def bucket_counts(df: DataFrame, text: str, width: int, buckets: int, name: str) -> DataFrame:
    return bucket_rows(df, text, width, buckets).where("bucket is not null").groupBy("bucket").agg(F.count("*").alias(name))


def gains(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text", width: int = WIDTH, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain: 1000 times the log ratio of the bucket's smoothed shares in target and docs, rounded down; rows of buckets that docs use."""
    both = bucket_counts(docs, text, width, buckets, "s").join(bucket_counts(target, target_text, width, buckets, "t"), "bucket", "full")
    both = both.select("bucket", F.coalesce("s", F.lit(0)).cast("double").alias("s"), F.coalesce("t", F.lit(0)).cast("double").alias("t"))
    total = both.agg(F.sum("s").alias("s_all"), F.sum("t").alias("t_all"))
    ratio = (F.col("t") + 1) * (F.col("s_all") + buckets) / ((F.col("s") + 1) * (F.col("t_all") + buckets))
    return both.where("s > 0").crossJoin(F.broadcast(total)).select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))  # total is one row


def gumbel(doc_id, seed: str = SEED):
    """1000 times a Gumbel number from 32 bits of the id's SHA-256, rounded down."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def weights(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", width: int = WIDTH, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features, weight: a row for each row of docs."""
    gain = F.broadcast(gains(docs, target, text, target_text, width, buckets))  # buckets rows at most
    # the number tells rows apart within this one job; a task that runs again numbers its rows as before
    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    met = bucket_rows(own, "text", width, buckets, "row", "doc_id").join(gain, "bucket", "left")
    summed = met.groupBy("row", "doc_id", "n_words").agg(F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).cast("long").alias("weight"))
    return summed.drop("row")


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", width: int = WIDTH, buckets: int = BUCKETS, seed: str = SEED, least: int = LEAST, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_features, weight, score, rank: a row for each row of docs; rank is null of those that aren't drawn."""
    scored = weights(docs, target, doc_id, text, target_text, width, buckets)
    scored = scored.select("doc_id", "n_features", "weight", (F.col("weight") + gumbel(F.col("doc_id"), seed)).alias("score"), (F.col("n_words") >= least).alias("eligible"))
    order = [F.desc("eligible"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight")]
    # the number of a row: its range in the high bits, its place within the range in the low 33
    placed = scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("number", F.monotonically_increasing_id())
    placed = stored(placed.select("*", F.shiftright("number", 33).alias("part"), F.col("number").bitwiseAND((1 << 33) - 1).alias("place")).drop("number"), "ranges")
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"), F.count_if("eligible").alias("n_eligible"))  # a row for each range
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = sizes.select(F.col("part").alias("of"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"), F.floor(F.sum("n_eligible").over(every) * percent / 100).alias("drawn"))
    rank = F.col("offset") + F.col("place") + 1
    out = placed.join(F.broadcast(offsets), F.col("part") == F.col("of"))
    return out.select("doc_id", "n_features", "weight", "score", F.when(F.col("eligible") & (rank <= F.col("drawn")), rank).alias("rank"))


def op13(spark, sf_dir):
    return resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: CRC-32 by its table of 256 entries, made by its rule, over the different words only.
ORACLE = r"""
WITH RECURSIVE
bits AS (
  SELECT CAST(i AS BIGINT) AS i, CAST(i AS BIGINT) AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS entry FROM bits WHERE k = 8),
d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
dw AS (SELECT r, word, count(*) AS n FROM (SELECT r, unnest(w) AS word FROM d) GROUP BY ALL),
bw AS (SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM b) GROUP BY word),
hexed AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM dw UNION SELECT word FROM bw)),
summed AS (
  SELECT word, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(CAST(len(h) // 2 AS BIGINT)), lambda k: CAST('0x' || h[2 * k + 1 : 2 * k + 2] AS BIGINT))),
    lambda a, x: xor(a >> 8, entry[CAST(xor(a, x) & 255 AS INT) + 1])) AS c
  FROM hexed, crc),
place AS (SELECT word, xor(c, 4294967295) % 10000 AS bucket FROM summed),
ds AS (SELECT bucket, sum(n) AS s FROM dw JOIN place USING (word) GROUP BY bucket),
bt AS (SELECT bucket, sum(n) AS t FROM bw JOIN place USING (word) GROUP BY bucket),
g AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM ds) + 10000)::DOUBLE
    / ((s + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM bt) + 10000)::DOUBLE))) AS BIGINT) AS gain
  FROM ds LEFT JOIN bt USING (bucket)),
weight AS (SELECT r, CAST(sum(n * gain) AS BIGINT) AS weight FROM dw JOIN place USING (word) JOIN g USING (bucket) GROUP BY r),
scored AS (
  SELECT d.r, doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score,
    len(w) >= 20 AS eligible
  FROM d LEFT JOIN weight USING (r)),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY eligible DESC, score DESC, doc_id NULLS LAST, n_features, weight) AS rank, count(*) FILTER (eligible) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN eligible AND rank <= 10 * n // 100 THEN rank END AS rank FROM ranked
"""
