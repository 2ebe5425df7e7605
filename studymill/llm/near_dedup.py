"""Near-duplicate detection on word shingles (operator 8).

Method: HyperMinHash. Each document has M registers, which hold of a bucket's least hash the number of leading zeros and
10 mantissa bits. Bands of compressed registers are the blocking keys; a pair that shares a key is estimated from its
equal registers, corrected for the equal registers that chance gives, and what may reach the threshold is verified on
the full shingle sets.

Buckets: a set of over FILL * M shingles is dealt over the M buckets by one hash. In a smaller set buckets would stay
empty and say nothing, so each of its shingles enters every bucket, by the bucket's own hash. Sets so large that a
linked partner may be above the limit have both sketches, so any two sets that can be linked share one kind.

No pairs of a whole group: documents with equal sets are one node. In a bucket of the blocking table only the pairs with
one of two centres are tested (the smallest id and the one of the least hash). Buckets whose rows are then still in
several components are searched completely, but for pairs within one component, which can't change the result: small
ones by pairs; the sets of all documents in larger ones by an exact search over their rarest shingles (crowded_pairs).
So a group of near copies, or of texts around one passage, costs rows in proportion to its size, and no link between
components is left out.

Probability that a pair at the threshold 0.8 shares no band of 5 registers among 36: 6e-7; that its estimate falls below
the threshold less 5 standard deviations: 3e-7.

Defined results: a text without words (or null) has an empty set, is its own component and kept; a text with fewer words
than a shingle has its whole sequence as the one shingle; documents with equal sets, repeated rows among them, are
linked; rows without id have no component and are kept; different texts of one id are one document, which is linked if
any of them is (n_shingles is the row's own). Ids are cast to long: one that is no number raises, or is taken as no id where
casts are lenient. Only id and text are read and returned, so other columns can't clash. Of a very long text a task holds
the words and a number for each shingle, and its set travels as one array.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, forget, gathered, lean, map_rows, mixed, shingle_hashes, stored
from .components import components

BANDS, ROWS = 36, 5
M = BANDS * ROWS
FILL, MANTISSA = 16, 10
#: Rows of a bucket that is searched by pairs in the plan; rows a side of a cell of the exact search of larger ones.
SMALL, CELL, SALTS = 24, 4096, 8
#: The order of the exact search counts shingles by 2 ** ORDER_BITS buckets: 48 MB on the driver, and broadcast, at most.
ORDER_BITS = 22
#: Bits of the filter that keeps texts of no candidate pair out of the shuffle; 16 MB at most.
FILTER_BITS = 1 << 27
_rng = np.random.Generator(np.random.PCG64(20240229))
FACTORS, SHIFTS = _rng.integers(0, 2**64, M, np.uint64) | np.uint64(1), _rng.integers(0, 2**64, M, np.uint64)


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, with A-Z in lower case."""
    return (text or "").encode().lower().split()


def compressed(least: np.ndarray) -> np.ndarray:
    """Registers of least hashes: leading zeros << MANTISSA | the bits after the leading one."""
    zeros = 63 - np.floor(np.log2(np.maximum(least, 1).astype(np.float64))).astype(np.int64).clip(0, 63)
    bits = (least << np.minimum(zeros + 1, 63).astype(np.uint64)) >> np.uint64(64 - MANTISSA)
    return (zeros << MANTISSA | bits.astype(np.int64)).astype(">u2")


def small_sketch(shingles: np.ndarray) -> bytes:
    least = np.full(M, ~np.uint64(0))
    for at in range(0, len(shingles), 512):
        part = shingles[at : at + 512]
        np.minimum(least, (part[None, :] * FACTORS[:, None] + SHIFTS[:, None]).min(axis=1), out=least)
    return compressed(least).tobytes()


def large_sketch(shingles: np.ndarray) -> bytes:
    bucket = ((shingles >> np.uint64(32)) * np.uint64(M)) >> np.uint64(32)
    value, order = mixed(shingles), np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    least, first = np.full(M, ~np.uint64(0)), np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    least[bucket[first]] = np.minimum.reduceat(value[order], first)
    return compressed(least).tobytes()


def sketches(df: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, set_key, small, large."""
    limit = FILL * M

    def make():
        hashed = WordHashes()

        def run(ids, texts):
            out = []
            for i, t in zip(ids, texts, strict=True):
                s = np.unique(shingle_hashes(hashed(words_of(t)), width))
                n = len(s)
                if not n:
                    out.append((i, 0, None, None, None))
                    continue
                small = small_sketch(s) if n * percent <= limit * 100 else None
                large = large_sketch(s) if n > limit else None
                out.append((i, n, xxhash.xxh3_128_digest(s.tobytes()), small, large))
            return out

        return run

    return map_rows(df, make, "doc_id long, n_shingles long, set_key binary, small binary, large binary")


def expected_by_chance(na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Probability that the registers of two disjoint sets of these sizes (a bucket's) are equal."""
    total = np.zeros(len(na))
    for zeros in range(64):
        high, low = 2.0**-zeros, 2.0 ** -(zeros + 1)
        total += low / 2**MANTISSA * na * nb / (na + nb) * (np.exp(-(na + nb) * low) - np.exp(-(na + nb) * high))
    return np.minimum(total, 0.5)


def estimates(equal: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the numbers of equal registers, corrected for chance."""
    chance = expected_by_chance(na, nb)
    return (equal / M - chance) / (1 - chance)


def floor_of(percent: int) -> float:
    p = percent / 100
    return p - 5 * np.sqrt(p * (1 - p) / M)


def band_rows(nodes: DataFrame) -> DataFrame:
    """(band, doc_id): the blocking keys of all nodes."""
    kinds = F.filter(F.array(F.struct(F.lit(0).alias("kind"), F.col("small").alias("regs")), F.struct(F.lit(1).alias("kind"), F.col("large").alias("regs"))), lambda x: x["regs"].isNotNull())
    each = nodes.select("doc_id", F.explode(kinds).alias("s")).select("doc_id", "s.kind", "s.regs", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("k"))
    part = F.substring(F.col("regs"), F.col("k") * (2 * ROWS) + 1, F.lit(2 * ROWS))
    return each.select(F.xxhash64("kind", "k", part).alias("band"), "doc_id")


def estimated(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose estimate may reach the threshold."""
    least = floor_of(percent)
    of = lambda s: nodes.select(*(F.col(c).alias(f"{c}_{s}") for c in ("doc_id", "n_shingles", "small", "large")))
    met = pairs.join(of("a"), F.col("a") == F.col("doc_id_a")).join(of("b"), F.col("b") == F.col("doc_id_b"))
    met = met.where(F.least("n_shingles_a", "n_shingles_b") * 100 >= F.greatest("n_shingles_a", "n_shingles_b") * percent)
    is_small = F.col("small_a").isNotNull() & F.col("small_b").isNotNull()
    met = met.select("a", "b", is_small.alias("is_small"), "n_shingles_a", "n_shingles_b", *(F.when(is_small, F.col(f"small_{s}")).otherwise(F.col(f"large_{s}")).alias(f"regs_{s}") for s in "ab")).where("regs_a is not null and regs_b is not null")

    def run(batches):
        for x in batches:
            if x.num_rows:
                a, b = (np.frombuffer(b"".join(x[c].to_pylist()), np.uint16).reshape(-1, M) for c in ("regs_a", "regs_b"))
                share = np.where(x["is_small"].to_numpy(zero_copy_only=False), 1.0, 1.0 / M)
                e = estimates((a == b).sum(axis=1), x["n_shingles_a"].to_numpy() * share, x["n_shingles_b"].to_numpy() * share)
                yield x.select(["a", "b"]).filter(pa.array(e >= least))

    return gathered(met).mapInArrow(run, "a long, b long")


def shingle_sets(docs: DataFrame, ids: DataFrame, width: int, repeated: bool = True, n: int | None = None) -> DataFrame:
    """(doc_id, shingles) of at least the documents with these ids (n rows at most, counted if not given; an id may come again); a filter of bounded size keeps most others out. repeated: ids may stand in several rows, of which each different set is kept once."""
    n = ids.count() if n is None else n
    if n * 8 > FILTER_BITS:  # the filter would be full: the texts are shuffled instead
        docs, words = docs.join(ids.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi"), None
    else:
        bits = 1 << max(10, min(27, (16 * n).bit_length()))
        bit = F.pmod(F.xxhash64("id"), F.lit(bits))
        got = gathered(ids.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(64)).cast("int"))).alias("set"))).toArrow()  # bits / 64 rows at most
        words = np.zeros(bits // 64, np.int64)
        words[got["word"].to_numpy()] = got["set"].to_numpy()
        docs = docs.withColumn("bit", F.pmod(F.xxhash64("doc_id"), F.lit(bits)))

    def run(batches):
        hashed = WordHashes()
        for x in batches:
            if words is not None:
                bit = x["bit"].to_numpy()
                x = x.filter(pa.array((words[bit >> 6] >> (bit & 63)) & 1 == 1))
            for at in range(0, x.num_rows, 64):
                part = x.slice(at, 64)
                sets = [np.unique(shingle_hashes(hashed(words_of(t)), width)).view(np.int64) for t in part["text"].to_pylist()]
                cuts = np.cumsum([0, *map(len, sets)])
                flat = pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64))
                key = pa.array([xxhash.xxh3_64_intdigest(x.tobytes()) >> 1 for x in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([part["doc_id"], key, pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), flat)], ["doc_id", "key", "shingles"])

    sets = docs.where("doc_id is not null").mapInArrow(lean(run), "doc_id long, key long, shingles array<long>")
    if repeated:
        sets = sets.groupBy("doc_id", "key").agg(F.first("shingles").alias("shingles"))
    return sets.select("doc_id", "shingles")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets reach the threshold; a pair of ids with several sets may come again."""
    of = lambda s: sets.select(F.col("doc_id").alias(f"doc_{s}"), F.col("shingles").alias(f"set_{s}"))
    met = pairs.join(of("a"), F.col("a") == F.col("doc_a")).join(of("b"), F.col("b") == F.col("doc_b"))
    both = F.size(F.array_intersect("set_a", "set_b"))
    return met.where(both * 100 >= (F.size("set_a") + F.size("set_b") - both) * percent).select("a", "b")


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("id"))


def labelled(bands: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return bands.withColumn("component", F.col("doc_id"))
    return bands.join(labels, bands["doc_id"] == labels["id"], "left").select("band", "doc_id", F.coalesce("component", "doc_id").alias("component"))


def star_pairs(bands: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Pairs of each bucket's two centres, the smallest id and the one of the least hash, with its rows of other components."""
    rows = labelled(bands, labels)
    ranks = F.col("doc_id"), F.xxhash64("doc_id", F.lit(7))
    centres = [F.min_by(c, rank).alias(f"{c}_{k}") for k, rank in enumerate(ranks) for c in ("doc_id", "component")]
    mixed_up = rows.groupBy("band").agg(*centres, F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    both = F.array(*(F.struct(F.col(f"doc_id_{k}").alias("centre"), F.col(f"component_{k}").alias("own")) for k in range(len(ranks))))
    met = rows.join(mixed_up.select("band", both.alias("centres")), "band").select("doc_id", "component", F.inline("centres")).where("component <> own")
    return met.select(F.least("centre", "doc_id").alias("a"), F.greatest("centre", "doc_id").alias("b")).distinct()


def few_pairs(rows: DataFrame) -> DataFrame:
    """Pairs of different components in buckets of up to SMALL rows (band, doc_id, component, n)."""
    few = rows.where(F.col("n") <= SMALL)
    other = few.select("band", F.col("doc_id").alias("other"), F.col("component").alias("other_component"))
    return few.join(other, "band").where("doc_id < other and component <> other_component").select(F.col("doc_id").alias("a"), F.col("other").alias("b")).distinct()


def common_buckets(crowded: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of the shingles' buckets that several components share: 2 ** ORDER_BITS of them at most."""

    def run(batches):
        for x in batches:
            for at in range(0, x.num_rows, 256):
                part = x.slice(at, 256)
                flat, component = part["shingles"].flatten().to_numpy(), np.repeat(part["component"].to_numpy(), part["shingles"].value_lengths().to_numpy())
                bucket, place, n = np.unique(order_bucket(flat), return_inverse=True, return_counts=True)
                lo, hi = np.full(len(bucket), np.iinfo(np.int64).max), np.full(len(bucket), np.iinfo(np.int64).min)
                np.minimum.at(lo, place, component)
                np.maximum.at(hi, place, component)
                yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(n), pa.array(lo), pa.array(hi)], ["bucket", "n", "lo", "hi"])

    each = crowded.select("component", "shingles").mapInArrow(run, "bucket int, n long, lo long, hi long")
    got = each.groupBy("bucket").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi").orderBy("bucket").select("bucket", "n").toArrow()
    return got["bucket"].to_numpy(), got["n"].to_numpy()


def order_bucket(shingles: np.ndarray) -> np.ndarray:
    return (mixed(shingles.view(np.uint64)) >> np.uint64(64 - ORDER_BITS)).astype(np.int32)


def first_places(crowded: DataFrame, percent: int) -> DataFrame:
    """(token, doc_id, component, n, place): the first shingles of each set, rare ones first, that other components may have too."""
    bucket, count = common_buckets(crowded)

    def run(batches):
        for x in batches:
            for at in range(0, x.num_rows, 256):
                part = x.slice(at, 256)
                size = part["shingles"].value_lengths().to_numpy().astype(np.int64)
                flat, row = part["shingles"].flatten().to_numpy(), np.repeat(np.arange(len(size)), size)
                which = order_bucket(flat)
                found = np.minimum(np.searchsorted(bucket, which), max(0, len(bucket) - 1))
                often = np.where(bucket[found] == which, count[found], 0) if len(bucket) else np.zeros(len(flat), np.int64)
                order = np.lexsort((flat, often, row))
                place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
                flat, often = flat[order], often[order]
                keep = (often > 0) & (place < (size - -(-percent * size // 100) + 1)[row])
                cols = (flat[keep], part["doc_id"].to_numpy()[row[keep]], part["component"].to_numpy()[row[keep]], size[row[keep]], place[keep])
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], ["token", "doc_id", "component", "n", "place"])

    return gathered(crowded).mapInArrow(run, "token long, doc_id long, component long, n long, place long")


def crowded_pairs(crowded: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of different components among these sets (doc_id, component, shingles) that may be linked: an exact search.

    All sets are put in one order of shingles, rare ones first. Two linked sets have their first common shingle early in
    both, at places that leave enough shingles behind it; so sets meet by (shingle, size class), the smaller one among
    few first places, and a pair is kept only if its sizes and places allow a link. Such meetings are dealt into cells
    of CELL rows a side, which hold numbers alone, and return what passes. A shingle that all of a group shares comes
    last in each of its sets, behind the ones that tell them apart.
    """
    return meeting_pairs(stored(first_places(crowded, percent), "places"), percent)


def meeting_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of crowded_pairs, from the stored rows of first_places."""
    size_class = lambda n: F.floor(F.log(n.cast("double")) / float(np.log(100 / min(percent, 99)))).cast("int")
    least = F.ceil(F.col("n") * percent / 100).cast("long")
    most = F.floor((F.col("n") - F.col("place")) * (100 + percent) / percent).cast("long") - F.col("n")  # sizes of partners
    role = lambda smaller: lambda c: F.struct(c.alias("size_class"), F.lit(smaller).alias("smaller"))
    small = F.when(F.col("place") < F.col("n") - F.ceil(F.col("n") * (2 * percent) / (100 + percent)) + 1, F.transform(F.array(size_class(F.col("n"))), role(True)))
    large = F.when(least <= most, F.transform(F.sequence(size_class(least), size_class(F.least("n", most))), role(False)))
    none = F.array().cast("array<struct<size_class:int,smaller:boolean>>")
    met = rows.select("*", F.inline(F.concat(F.coalesce(small, none), F.coalesce(large, none))))
    key = ["token", "size_class"]
    groups = met.groupBy(*key).agg(F.count_if("smaller").alias("n_small"), F.count_if(~F.col("smaller")).alias("n_large"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi and n_small > 0 and n_large > 0")
    groups = groups.select(*key, F.ceil(F.col("n_small") / CELL).cast("int").alias("small_cells"), F.ceil(F.col("n_large") / CELL).cast("int").alias("large_cells"))
    # salted: the rows of a common shingle are joined in several tasks, and its cells dealt anew
    met = met.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).join(groups.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), [*key, "salt"])
    own = lambda cells: F.pmod(F.xxhash64("doc_id"), F.col(cells)).cast("int")
    every = lambda cells: F.sequence(F.lit(0), F.col(cells) - 1)
    cells = F.when(F.col("smaller"), F.transform(every("large_cells"), lambda c: F.struct(own("small_cells").alias("i"), c.alias("j")))).otherwise(F.transform(every("small_cells"), lambda c: F.struct(c.alias("i"), own("large_cells").alias("j"))))
    met = met.select("*", F.inline(cells))

    def run(t: pa.Table) -> pa.Table:
        side = t["smaller"].to_numpy()
        (x_id, x_c, x_n, x_p), (y_id, y_c, y_n, y_p) = ([t[c].to_numpy()[k] for c in ("doc_id", "component", "n", "place")] for k in (side, ~side))
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for at in range(0, len(x_id), 256):
            s = slice(at, at + 256)
            n = x_n[s, None] + y_n[None, :]
            shared = -(-percent * n // (100 + percent))
            may = (x_c[s, None] != y_c) & (x_n[s, None] <= y_n) & (x_n[s, None] * 100 >= y_n * percent)
            may &= (x_n[s, None] - x_p[s, None] >= shared) & (y_n - y_p >= shared)
            i, j = np.nonzero(may)
            a.append(x_id[s][i])
            b.append(y_id[j])
        a, b = np.concatenate(a), np.concatenate(b)
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return met.groupBy(*key, "i", "j").applyInArrow(run, "a long, b long").distinct()


def near_duplicates(df: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of df."""
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    table = stored(sketches(docs, width, percent), "sketches")
    whole = table.where("n_shingles > 0 and doc_id is not null")
    sets = stored(gathered(whole.groupBy("set_key").agg(F.min("doc_id").alias("rep"))), "groups")
    nodes = stored(gathered(table.join(sets, "set_key").where("doc_id = rep").dropDuplicates(["set_key"]).select("doc_id", "n_shingles", "small", "large")), "nodes")
    bands = band_rows(nodes)
    several = stored(gathered(whole.groupBy("doc_id").agg(F.min("set_key").alias("lo"), F.max("set_key").alias("hi"), F.count("*").alias("n")).where("n > 1")), "several")
    repeated = not several.isEmpty()
    edges = stored(whole.join(several.where("lo < hi").select("doc_id"), "doc_id").join(sets, "set_key").where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct(), "edges")
    labels = None if edges.isEmpty() else components(edges)
    pairs = stored(estimated(star_pairs(bands, labels), nodes, percent), "pairs")
    if n_pairs := pairs.count():
        full = stored(shingle_sets(docs, ends(pairs), width, repeated, 2 * n_pairs), "sets")
        edges = edges.unionByName(stored(gathered(verified(pairs, full, percent)), "edges"))
        forget(pairs, full, labels)
        labels = components(edges)
    # what still lies in several components of one bucket
    rows = labelled(bands, labels)
    open_bands = rows.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("band", "n")
    rest = stored(gathered(rows.join(open_bands, "band")), "open")
    few = stored(estimated(few_pairs(rest), nodes, percent), "pairs")
    crowded = stored(gathered(rest.where(F.col("n") > SMALL).groupBy(F.col("doc_id").alias("id")).agg(F.min("component").alias("component"))), "crowded")
    full = stored(shingle_sets(docs, ends(few).unionByName(crowded.select("id")), width, repeated, 2 * few.count() + crowded.count()), "sets")
    places = stored(first_places(full.join(crowded, full["doc_id"] == crowded["id"]), percent), "places")
    many = estimated(meeting_pairs(places, percent), nodes, percent)
    found = stored(gathered(verified(few.unionByName(many).distinct(), full, percent)), "edges")
    forget(rest, few, crowded, full, places, nodes)
    if not found.isEmpty():
        edges = edges.unionByName(found)
        forget(labels)
        labels = components(edges)
    out = table.select("doc_id", "n_shingles", "set_key").join(sets, "set_key", "left")
    if labels is not None:
        out = out.join(labels, out["rep"] == labels["id"], "left")
    else:
        out = out.withColumn("component", F.lit(None).cast("long"))
    component = F.coalesce("component", "rep", "doc_id")
    return gathered(out).select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op8(spark, sf_dir):
    from .common import documents

    return near_duplicates(documents(spark, sf_dir), width=4)
