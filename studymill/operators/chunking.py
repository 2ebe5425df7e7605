"""Chunking of paged texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from studymill.functions.text import trimmed, words

#: words, overlap of each density (fixed values).
DENSITY = {"standard": (2000, 0.15), "comprehensive": (1800, 0.18), "boards": (1500, 0.20)}
#: A window is lengthened by up to EXTEND words to a sentence's end; one of fewer than LEAST words is no chunk.
EXTEND, LEAST = 40, 20


def word_windows(pages: DataFrame, size: int, overlap: float) -> DataFrame:
    """WIN01: pages(pdf_id, page, text) to chunks(pdf_id, chunk, text, start_page, end_page, word_count).

    The words of a document are one array with their pages in another; windows are ranges of it, so nothing but the
    pages of one document meets in a row.
    """
    step = size - int(size * overlap)
    docs = pages.where(F.col("text").isNotNull()).groupBy("pdf_id").agg(F.sort_array(F.collect_list(F.struct("page", "text"))).alias("pages"))
    docs = docs.select("pdf_id", F.flatten(F.transform("pages", lambda p: F.transform(words(p["text"]), lambda w: F.struct(w.alias("w"), p["page"].alias("page"))))).alias("ws"))
    docs = docs.withColumn("n", F.size("ws")).where("n > 0")
    starts = F.sequence(F.lit(0), F.col("n") - 1, F.lit(step))

    def end_of(i):
        near = F.least(i + size, F.col("n"))
        far = F.least(near + EXTEND, F.col("n"))
        stops = F.filter(F.sequence(near, far), lambda e: (e == far) | F.element_at("ws", e)["w"].rlike("[.?!]$"))
        return F.get(stops, 0)

    spans = F.transform(starts, lambda i: F.struct(i.alias("a"), end_of(i).alias("b")))
    docs = docs.withColumn("spans", spans)
    # the first window that reaches the end is the last one
    before = lambda k: F.get(F.col("spans"), k - 1)["b"]
    kept = F.filter("spans", lambda s, k: (s["b"] - s["a"] >= LEAST) & ((k == 0) | (before(k) < F.col("n"))))
    each = docs.select("pdf_id", "ws", F.posexplode(kept).alias("chunk", "s"))
    part = F.slice("ws", F.col("s.a") + 1, F.col("s.b") - F.col("s.a"))
    return each.select(
        "pdf_id", F.col("chunk").cast("long").alias("chunk"), F.array_join(F.transform(part, lambda x: x["w"]), " ").alias("text"),
        F.element_at("ws", F.col("s.a") + 1)["page"].alias("start_page"), F.element_at("ws", F.col("s.b"))["page"].alias("end_page"), (F.col("s.b") - F.col("s.a")).cast("long").alias("word_count"),
    )


def is_heading(line: Column) -> Column:
    """A line in capitals, or one whose long words all begin with capitals, of ten words at most."""
    title = line.rlike("^[A-Z]") & F.forall(F.split(line, " "), lambda w: (F.length(w) <= 3) | w.rlike("^[A-Z]"))
    return (F.size(words(line)) <= 10) & (((line == F.upper(line)) & line.rlike("[A-Z]")) | title)


def structural_chunks(pages: DataFrame, size: int, overlap: float) -> DataFrame:
    """WIN02: pages(pdf_id, page, text) to chunks(pdf_id, chunk, text, start_page, end_page, word_count) along headings and breaks.

    Lines become blocks in one fold over the words of each line: a block ends before a heading, and at a blank line when
    it has three lines and 0.6 * size words. Blocks become groups by running sums: one of size / 4 words or more begins a
    group, and so does the one after a block of size words. A group of fewer than LEAST words gives no chunk, one of up
    to 1.5 * size words gives one, others give windows. The lines of one document meet in a row, no more.
    """
    text = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), trimmed)
    docs = pages.select("pdf_id", "page", text.alias("texts")).groupBy("pdf_id").agg(F.sort_array(F.collect_list(F.struct("page", "texts"))).alias("pages"))
    line = lambda p: F.transform(p["texts"], lambda t: F.struct(t.alias("text"), p["page"].cast("long").alias("page"), F.size(words(t)).alias("n"), (is_heading(t) & (t != "")).alias("heading")))
    docs = docs.select("pdf_id", F.flatten(F.transform("pages", line)).alias("ls"))

    span = lambda b, e: F.array(F.struct(b.cast("int").alias("b"), e.cast("int").alias("e")))
    state = lambda done, b, at, segs, n: F.struct(done.alias("done"), b.cast("int").alias("b"), at.cast("int").alias("at"), segs.cast("int").alias("segs"), n.cast("int").alias("n"))

    def ends(s: Column, x: Column) -> Column:
        broken = (x["text"] == "") & (s["segs"] > 2) & (s["n"] > 0.6 * size)
        closed, after = F.concat(s["done"], span(s["b"], s["at"])), s["at"] + 1
        return F.when(x["heading"] & (s["segs"] > 0), state(closed, s["at"], after, F.lit(1), x["n"])).when(broken, state(closed, after, after, F.lit(0), F.lit(0))).otherwise(state(s["done"], s["b"], after, s["segs"] + 1, s["n"] + x["n"]))

    none = F.array().cast("array<struct<b:int,e:int>>")
    spans = F.aggregate("ls", state(none, F.lit(0), F.lit(0), F.lit(0), F.lit(0)), ends, lambda s: F.concat(s["done"], span(s["b"], s["at"])))
    cut = docs.withColumn("spans", spans).select("pdf_id", "ls", F.posexplode("spans").alias("k", "s"))
    lines = F.slice("ls", F.col("s.b") + 1, F.col("s.e") - F.col("s.b"))
    blocks = cut.select("pdf_id", "k", lines.alias("ls")).where(F.exists("ls", lambda x: x["text"] != ""))
    whole = F.aggregate("ls", F.lit(0), lambda n, x: n + x["n"])
    blocks = blocks.select("pdf_id", "k", F.flatten(F.transform("ls", lambda x: words(x["text"]))).alias("ws"), whole.alias("n"), F.get("ls", 0)["page"].alias("first"), F.array_max(F.transform("ls", lambda x: x["page"])).alias("last"))

    order = Window.partitionBy("pdf_id").orderBy("k")
    begins = (F.col("n") >= size // 4) | (F.coalesce(F.lag("n").over(order), F.lit(size)) >= size)
    groups = blocks.withColumn("begins", begins).withColumn("g", F.sum(F.col("begins").cast("int")).over(order))
    groups = groups.groupBy("pdf_id", "g").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("k", "ws"))), lambda x: x["ws"])).alias("ws"), F.min_by("first", "k").alias("start_page"), F.max("last").alias("end_page"))
    groups = groups.withColumn("n", F.size("ws")).where(F.col("n") >= LEAST)
    starts = F.when(F.col("n") <= 1.5 * size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("n") - LEAST, F.lit(size - int(size * overlap))))
    each = groups.select("*", F.explode(starts).alias("at"))
    part = F.when(F.col("n") <= 1.5 * size, F.col("ws")).otherwise(F.slice("ws", F.col("at") + 1, F.lit(size)))
    place = Window.partitionBy("pdf_id").orderBy("g", "at")
    return each.select("pdf_id", (F.row_number().over(place) - 1).cast("long").alias("chunk"), F.array_join(part, " ").alias("text"), "start_page", "end_page", F.size(part).cast("long").alias("word_count"))
