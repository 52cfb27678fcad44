"""Words that are one edit apart, found by dense tiles of code points, and the forms and roots that follow."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressloom.llm.shared import Scratch, settle

#: Words that one side of a tile holds.
BLOCK = 1024
#: Rows of small buckets that are compared in one tile.
TOGETHER = 96
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "[A-Za-z\xc0-\xff]+"


def words(docs: DataFrame, least_length: int, least_count: int, typos: int = 97) -> DataFrame:
    """word, n: runs of letters of whole texts, A-Z lower-cased, of so many code points and occurrences at least.

    If `typos` divides the crc32 of 'doc_id:run', the run loses its code point
    crc32 % length, everywhere in that document.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.translate(F.col("text").cast("string"), _UPPER, _LOWER).alias("text"))
    runs = rows.select("id", F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (h % F.char_length("run")).cast("int")
    word = F.when(h % typos == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))).otherwise(F.col("run"))
    return runs.select(word.alias("word")).filter(F.char_length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def _tiles(rows: DataFrame) -> DataFrame:
    """bucket, longer, side, i, j, block, word, n: every word in each tile in which it is compared.

    Of two words one edit apart, common prefix and suffix reach the longer length
    less one, so one of them reaches half of that. Words are compared if they
    share a prefix, or a suffix, of that half, once for each longer length they
    can be part of. A bucket of many words is cut into blocks by hash, and every
    pair of its blocks is a tile of its own.
    """
    length = F.char_length("word")
    longer = F.explode(F.array(length, length + 1)).alias("longer")
    half = F.expr("longer div 2").cast("int")
    keyed = rows.select("word", "n", longer).select("word", "n", "longer", F.explode(F.array(F.struct(F.lit("p").alias("side"), F.substring("word", F.lit(1), half).alias("key")), F.struct(F.lit("s").alias("side"), F.substring("word", F.char_length("word") - half + 1, half).alias("key")))).alias("x"))
    keyed = keyed.select("word", "n", "longer", "x.side", F.concat_ws(" ", "longer", "x.side", "x.key").alias("bucket"))
    sizes = keyed.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1").select("bucket", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    dealt = keyed.join(sizes, "bucket").withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select("bucket", "longer", "side", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "word", "n")


def _matrices(words: np.ndarray, longer: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points from the left and from the right, padded with 0; and which words have the longer length."""
    left = np.array(words, f"U{longer}").view(np.uint32).reshape(len(words), longer)
    left = left.astype(np.uint8) if left.max() < 256 else left
    full = left[:, -1] != 0
    right = left.copy()
    right[~full, 1:], right[~full, 0] = left[~full, :-1], 0
    return left.T.copy(), right.T.copy(), full


def near_pairs(x: np.ndarray, y: np.ndarray, longer: int, side: str, mask: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs, one of x and one of y, that are one edit apart and whose longer word has that length.

    All words share the first (side p) or last (side s) longer // 2 code points,
    or those that mask pairs do. Pairs that share both are left to side p.
    """
    half = longer // 2
    a_left, a_right, a_full = _matrices(x, longer)
    b_left, b_right, b_full = _matrices(y, longer)

    def common(a: np.ndarray, b: np.ndarray, order: range, known: int) -> np.ndarray:
        alive = np.ones((a.shape[1], b.shape[1]), bool)
        out = np.full(alive.shape, known, np.uint8 if longer < 128 else np.int32)
        for c in order:
            alive &= a[c][:, None] == b[c][None, :]
            if not alive.any():
                break
            out += alive
        return out

    prefix = common(a_left, b_left, range(half if side == "p" else 0, longer), half if side == "p" else 0)
    suffix = common(a_right, b_right, range(longer - 1 - (half if side == "s" else 0), -1, -1), half if side == "s" else 0)
    near = prefix + suffix >= longer - 1
    near &= a_full[:, None] | b_full[None, :]
    if side == "s":
        near &= prefix < half
    if mask is not None:
        near &= mask
    return np.nonzero(near)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def pairs(tile: dict[str, np.ndarray], same: bool) -> pa.RecordBatch:
        longer, side, word, n = int(tile["longer"][0]), tile["side"][0], tile["word"], tile["n"]
        if same:
            at = np.arange(len(word))
            mask = at[:, None] < at[None, :]
            if (tile["bucket"] != tile["bucket"][0]).any():
                mask &= tile["bucket"][:, None] == tile["bucket"][None, :]
            i, j = near_pairs(word, word, longer, side, mask)
        else:
            first = np.flatnonzero(tile["block"] == tile["i"])
            second = np.flatnonzero(tile["block"] != tile["i"])
            if not len(first) or not len(second):
                return out([], [], [])
            i, j = near_pairs(word[first], word[second], longer, side, None)
            i, j = first[i], second[j]
        return out(np.concatenate([word[i], word[j]]), np.concatenate([word[j], word[i]]), np.concatenate([n[j], n[i]]))

    def out(word, other, n) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(other, pa.string()), pa.array(n, pa.int64())], ["word", "other", "other_n"])

    def tiles(rows: dict[str, np.ndarray], last: bool) -> Iterator[pa.RecordBatch]:
        """The whole tiles of the rows; what is left of a tile that may go on stays in `held`."""
        nonlocal held
        total = len(rows["word"])
        fresh = np.ones(total, bool)
        fresh[1:] = (rows["bucket"][1:] != rows["bucket"][:-1]) | (rows["i"][1:] != rows["i"][:-1]) | (rows["j"][1:] != rows["j"][:-1])
        starts = np.flatnonzero(fresh).tolist()
        ends = [*starts[1:], total] if last else starts[1:]
        k = 0
        while k < len(ends):
            start, end = starts[k], ends[k]
            same = rows["i"][start] == rows["j"][start]
            while same and k + 1 < len(ends) and ends[k + 1] - start <= TOGETHER and rows["i"][end] == rows["j"][end] and rows["longer"][end] == rows["longer"][start] and rows["side"][end] == rows["side"][start]:
                k += 1
                end = ends[k]
            k += 1
            if end - start > 1:
                yield pairs({c: v[start:end] for c, v in rows.items()}, same)
        held = None if last else {c: v[starts[-1] :] for c, v in rows.items()}

    held: dict[str, np.ndarray] | None = None
    for batch in batches:
        if batch.num_rows:
            rows = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
            yield from tiles({c: np.concatenate([held[c], v]) for c, v in rows.items()} if held else rows, False)
    if held:
        yield from tiles(held, True)


def near_words(rows: DataFrame) -> DataFrame:
    """word, other, other_n: both directions of every two distinct words (word, n) that differ by one inserted, deleted or replaced code point."""
    tiles = _tiles(rows)
    dealt = tiles.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return dealt.mapInArrow(_compared, "word string, other string, other_n long")


def _roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """word, root of every word that has a form; as n doubles with each form, the chains and so the rounds are few."""
    roots = scratch.settle(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        moved = scratch.settle(roots.join(ahead, "root", "left").select("word", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("moved")), "roots")
        roots = moved.drop("moved")
        if moved.filter("moved").isEmpty():
            return roots


def variants(docs: DataFrame, least_length: int = 5, least_count: int = 3, times: int = 2) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of at least so many code points and occurrences.

    n_near: words one edit away. form: the near word of largest n (ties: first in
    code-point order) if its n is `times` the word's at least, else null; root:
    the last word on the way from form to form, the word itself without one.

    Null and empty texts have no words; a null doc_id counts as an empty one;
    repeated rows count as often as they are there; other columns are left out;
    no rows give no rows. Occurrences are summed before words cross the network.
    """
    scratch = Scratch(docs.sparkSession)
    rows = scratch.settle(words(docs, least_length, least_count), "words")
    near = near_words(rows).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus"), "other")).alias("best"))
    formed = (-F.col("best.minus")) >= times * F.col("n")
    rows = scratch.settle(
        rows.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("best.other")).alias("form"), F.when(formed, -F.col("best.minus")).alias("form_n")), "forms"
    )
    roots = _roots(rows.filter(F.col("form").isNotNull()), scratch)
    out = settle(rows.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word")), "variants")
    scratch.drop()
    return out
