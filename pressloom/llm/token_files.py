"""Token ids as ORC: run-length encoded ids in ascending doc_id order, with row indexes and Bloom filters."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pressloom.llm.shared import new_path, texts
from pressloom.llm.textkit import encoder

END = 0


def crc_of(ids: np.ndarray) -> int:
    """Unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def _encoded(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                part = whole.slice(at, 200)
                ids = [np.append(x, np.uint32(END)) for x in encode(part.column("text").to_pylist())]
                ends = np.cumsum([0, *map(len, ids)])
                values = pa.array(np.concatenate(ids).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(ends)), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)], ["doc_id", "n_tokens", "ids"])

    return run


def write_tokens(docs: DataFrame, path: str, vocabulary: str, partitions: int | None = None) -> str:
    """Write doc_id, n_tokens, ids (the text's, then 0) of every row to ORC files at path, ordered by doc_id across and within files.

    Rows are dealt by ranges of doc_id, so that each file holds one range and is
    written by one task. Stripes can be read in parallel; a filter on doc_id
    skips files and stripes by their minima and maxima, row groups by the row
    index, and the rest by the Bloom filter. Null text counts as empty: its ids
    are the end id alone. Null ids come first; repeated ids keep their rows.
    """
    rows = texts(docs)
    rows = rows.repartitionByRange(partitions, "doc_id") if partitions else rows.repartitionByRange("doc_id")
    rows = rows.sortWithinPartitions("doc_id").mapInArrow(_encoded(vocabulary), "doc_id long, n_tokens long, ids array<int>")
    options = {"compression": "snappy", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": "1000", "orc.stripe.size": str(16 << 20)}
    rows.write.options(**options).orc(path)
    return path


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The files as a DataFrame; filters on doc_id are pushed into the ORC reader."""
    return spark.read.schema("doc_id long, n_tokens long, ids array<int>").orc(path)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in batches:
        ids = part.column("ids")
        ends, values = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False)
        crc = [crc_of(values[i:j]) for i, j in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([part.column("file"), part.column("doc_id"), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())], ["file", "doc_id", "n_tokens", "ids_crc32"])


def index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files; start counts the ids of all documents before it.

    A file's offset is the sum over the files of smaller ids (a row for each
    file), a document's place in its file a running sum over that file, whose
    size the writer bounds.
    """
    rows = read_tokens(spark, path).select(F.input_file_name().alias("file"), "doc_id", "ids").mapInArrow(_digest, "file string, doc_id long, n_tokens long, ids_crc32 long")
    files = read_tokens(spark, path).groupBy(F.input_file_name().alias("file")).agg(F.sum("n_tokens").alias("tokens"), F.min("doc_id").alias("low"), F.min("doc_id").isNull().alias("nulls"), F.max("doc_id").alias("high"))
    before = F.sum("tokens").over(Window.orderBy(F.col("low").asc_nulls_first(), "high", "file").rowsBetween(Window.unboundedPreceding, -1))
    files = files.select("file", F.coalesce(before, F.lit(0)).alias("base"))
    inside = Window.partitionBy("file").orderBy(F.col("doc_id").asc_nulls_first(), "ids_crc32", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return rows.join(files, "file").select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Write docs to a new path in the shared folder, then index what the files hold."""
    spark = docs.sparkSession
    return index(spark, write_tokens(docs, new_path(spark, "tokens.orc"), vocabulary))
