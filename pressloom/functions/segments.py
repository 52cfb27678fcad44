"""Transcripts: cues without echoes, blocks of about 2000 characters, their rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressloom.functions.columns import url_hash

TARGET, MOST, TAIL, TITLE = 2000, 2300, 300, 150
END = r"[.!?…]['\"»)]?\s*$"


def clean_cues(rows: DataFrame, video: str = "video", position: str = "pos", text: str = "text") -> DataFrame:
    """Rows of cues without blank ones and without those that repeat the cue before."""
    t = F.trim(F.regexp_replace(text, "\n", " "))
    full = rows.withColumn(text, t).filter(F.length(text) > 0)
    before = F.lag(text).over(Window.partitionBy(video).orderBy(position))
    return full.withColumn("__before", before).filter(F.col("__before").isNull() | (F.col("__before") != F.col(text))).drop("__before")


def segments(cues: Column) -> Column:
    """array<struct<start, text>> of an array<struct<t double, text string>> in order.

    A block is closed before a cue that would carry it beyond the most, and after
    one that ends a sentence once the target is reached. A short tail joins the
    block before it. One fold over the array: no shuffle, no Python.
    """
    empty = "named_struct('done', CAST(array() AS array<struct<start: double, text: string>>), 'start', CAST(NULL AS double), 'text', '', 'n', 0)"

    def closed(acc: Column) -> Column:
        return F.concat(acc["done"], F.array(F.struct(F.coalesce(acc["start"], F.lit(0.0)).alias("start"), acc["text"].alias("text"))))

    def pack(done: Column, start: Column, text: Column, n: Column) -> Column:
        return F.struct(done.alias("done"), start.cast("double").alias("start"), text.alias("text"), n.cast("int").alias("n"))

    def fold(acc: Column, c: Column) -> Column:
        size = F.length(c["text"]) + 1
        full = (acc["n"] > 0) & (acc["n"] + size > MOST)
        done = F.when(full, closed(acc)).otherwise(acc["done"])
        fresh = full | (acc["n"] == 0)
        start = F.when(fresh, c["t"]).otherwise(acc["start"])
        text = F.when(fresh, c["text"]).otherwise(F.concat(acc["text"], F.lit(" "), c["text"]))
        n = F.when(fresh, size).otherwise(acc["n"] + size)
        ends = (n >= TARGET) & c["text"].rlike(END)
        after = F.concat(done, F.array(F.struct(F.coalesce(start, F.lit(0.0)).cast("double").alias("start"), text.alias("text"))))
        return F.when(ends, pack(after, F.lit(None).cast("double"), F.lit(""), F.lit(0))).otherwise(pack(done, start, text, n))

    def finish(acc: Column) -> Column:
        out = F.when(acc["n"] > 0, closed(acc)).otherwise(acc["done"])
        k = F.size(out)
        short = (k > 1) & (F.length(F.element_at(out, -1)["text"]) < TAIL)
        joined = F.concat(F.slice(out, 1, k - 2), F.array(F.struct(F.element_at(out, -2)["start"].alias("start"), F.concat(F.element_at(out, -2)["text"], F.lit(" "), F.element_at(out, -1)["text"]).alias("text"))))
        return F.when(short, joined).otherwise(out)

    return F.aggregate(F.coalesce(cues, F.expr("CAST(array() AS array<struct<t: double, text: string>>)")), F.expr(empty), fold, finish)


def segment_rows(videos: DataFrame) -> DataFrame:
    """id, url, title, content, segment of each block of url, title, cues."""
    rows = videos.withColumn("s", segments(F.col("cues"))).withColumn("parts", F.size("s"))
    rows = rows.select("*", F.posexplode("s").alias("segment", "block")).drop("s")
    title = F.concat(F.trim(F.left("title", F.lit(TITLE))), F.lit(" ["), (F.col("segment") + 1).cast("string"), F.lit("/"), F.col("parts").cast("string"), F.lit("]"))
    return rows.select(url_hash(F.concat(F.col("url"), F.lit("#seg"), F.col("segment").cast("string"))).alias("id"), F.concat(F.col("url"), F.lit("&t="), F.col("block.start").cast("long").cast("string"), F.lit("s")).alias("url"), title.alias("title"), F.col("block.text").alias("content"), "segment")
