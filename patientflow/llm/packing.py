"""Filling fixed-capacity containers with items by harmonic packing (problem 7)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..plans.runtime import table

CAPACITY = 1_024
#: Lengths up to capacity / CLASSES share the last class, whose bins are filled one after the other.
CLASSES = 64


def one_per_key(df: DataFrame, key: str, size: F.Column) -> DataFrame:
    """``key`` and the greatest length among its rows (redelivered copies; null lengths count 0); null keys are left out."""
    return df.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("bigint").alias("item")).agg(F.max(F.coalesce(size, F.lit(0))).cast("bigint").alias("length"))


def pieces(items: DataFrame, capacity: int) -> DataFrame:
    """``item, piece, start, length``: items longer than the capacity are cut into full pieces and a rest, others stay whole. Items of length 0 give none."""
    at = F.explode(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / capacity).cast("int"))).alias("piece")
    cut = items.where("length > 0").select("item", "length", at)
    start = F.col("piece").cast("bigint") * capacity
    return cut.select("item", "piece", start.alias("start"), F.least(F.lit(capacity).cast("bigint"), F.col("length") - start).alias("length"))


def _fill(batches: Iterator[pa.RecordBatch], capacity: int, classes: int) -> Iterator[pa.RecordBatch]:
    """Numbers the bins of each class within this partition; class j takes j pieces to a bin."""
    part = TaskContext.get().partitionId()
    seen = np.zeros(classes + 1, np.int64)  # pieces of each class so far
    room, bin_no = 0, -1  # of the last class, whose pieces are small: next fit
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        size = b.column(3).to_numpy()
        k = np.minimum(capacity // size, classes)
        number = np.empty(n, np.int64)
        order = np.argsort(k, kind="stable")
        kind, start, count = np.unique(k[order], return_index=True, return_counts=True)
        for c, s, m in zip(kind, start, count):
            rows = order[s : s + m]
            if c < classes:
                number[rows] = (seen[c] + np.arange(m)) // c
                seen[c] += m
                continue
            for r in rows:
                if size[r] > room:
                    room, bin_no = capacity, bin_no + 1
                room -= size[r]
                number[r] = bin_no
        name = np.char.add(np.char.add(np.char.add(k.astype(str), f"-{part}-"), number.astype(str)), "")
        yield pa.RecordBatch.from_arrays([pa.array(name.tolist()), pa.array(k.astype(np.int32)), *[b.column(i) for i in range(4)]], ["bin", "class", "item", "piece", "start", "length"])


def harmonic_bins(items: DataFrame, capacity: int = CAPACITY, classes: int = CLASSES) -> DataFrame:
    """Assigns every piece to a container: ``bin, class, item, piece, start, length``.

    Class j holds the pieces of length in (capacity / (j + 1), capacity / j],
    j of which always fit. Each partition fills bins of its own, so nothing is
    shuffled, and leaves at most one bin per class unfilled. No item is
    split unless it exceeds the capacity; items of length 0 need no
    container; an empty table gives an empty result; ties and repeated lengths are ordinary.
    """
    cut = pieces(items, capacity).sortWithinPartitions("item", "piece")  # a fixed order, should a task run again
    return cut.mapInArrow(lambda it: _fill(it, capacity, classes), "bin string, class int, item bigint, piece int, start bigint, length bigint")


def assemble(bins: DataFrame, sequences: DataFrame, item: str, tokens: str) -> DataFrame:
    """The containers' content: ``bin, n_pieces, tokens``; at most ``capacity`` tokens a row."""
    one = sequences.where(F.col(item).isNotNull()).groupBy(F.col(item).cast("bigint").alias("item")).agg(F.max(F.struct(F.size(tokens), tokens)).alias("s"))
    cut = bins.join(one, "item").select("bin", "item", "piece", F.slice(F.col(f"s.{tokens}"), F.col("start").cast("int") + 1, F.col("length").cast("int")).alias("t"))
    packed = cut.groupBy("bin").agg(F.sort_array(F.collect_list(F.struct("item", "piece", "t"))).alias("x"))
    return packed.select("bin", F.size("x").alias("n_pieces"), F.flatten("x.t").alias("tokens"))


def _items(spark, sf_dir: str) -> DataFrame:
    return one_per_key(table(spark, sf_dir, "processed_dataset"), "person_id", F.when(F.col("input_ids").isNotNull(), F.size("input_ids")))


def p7_found(spark, sf_dir: str) -> DataFrame:
    """Persons whose sequence had to be cut, from the packing itself."""
    return harmonic_bins(_items(spark, sf_dir)).where("piece = 1").select(F.col("item").alias("person_id")).distinct()


def p7_bins(spark, sf_dir: str) -> DataFrame:
    """Where each piece of each sequence went."""
    return harmonic_bins(_items(spark, sf_dir)).select("bin", F.col("item").alias("person_id"), "piece", "start", "length")


def p7_classes(spark, sf_dir: str) -> DataFrame:
    """Pieces and tokens of each class of lengths."""
    return harmonic_bins(_items(spark, sf_dir)).groupBy("class").agg(F.count("*").alias("n_pieces"), F.sum("length").alias("n_tokens"))


def p7_fill(spark, sf_dir: str) -> DataFrame:
    """Containers, tokens and the share of room used, per class and in all (class null)."""
    b = harmonic_bins(_items(spark, sf_dir)).groupBy("class", "bin").agg(F.sum("length").alias("t"))
    return b.rollup("class").agg(F.count("*").alias("n_bins"), F.sum("t").alias("n_tokens"), (F.sum("t") / (F.count("*") * CAPACITY)).alias("filled"))


def p7_checked(spark, sf_dir: str) -> DataFrame:
    """Per person the tokens packed, whether they stand in order without gap, whether only a too long sequence was cut, and whether all of its containers hold."""
    from pyspark.sql import Window

    b = harmonic_bins(_items(spark, sf_dir))
    load = F.sum("length").over(Window.partitionBy("bin"))
    b = b.select("item", "piece", "start", "length", load.alias("load"))
    p = b.groupBy("item").agg(F.sum("length").alias("n_tokens"), F.count("*").alias("n"), F.max(F.col("start") + F.col("length")).alias("end"), F.max("load").alias("load"), F.count_distinct("start").alias("starts"))
    ordered = (F.col("end") == F.col("n_tokens")) & (F.col("starts") == F.col("n"))
    return p.select(F.col("item").alias("person_id"), "n_tokens", ordered.alias("ordered"), (F.col("n") == F.ceil(F.col("n_tokens") / CAPACITY)).alias("whole"), (F.col("load") <= CAPACITY).alias("fits"))


def p7_packed(spark, sf_dir: str) -> DataFrame:
    """The packed token lists."""
    t = table(spark, sf_dir, "processed_dataset")
    return assemble(harmonic_bins(_items(spark, sf_dir)), t, "person_id", "input_ids")


_LEN = "WITH l AS (SELECT person_id, max(coalesce(len(input_ids), 0)) AS n FROM processed_dataset WHERE person_id IS NOT NULL GROUP BY 1)"
SQL = {
    "p7_checked": f"{_LEN} SELECT person_id, n AS n_tokens, true AS ordered, true AS whole, true AS fits FROM l WHERE n > 0",
    "p7_found": f"{_LEN} SELECT person_id FROM l WHERE n > {CAPACITY}",
    "p7_classes": f"""{_LEN}, p AS (SELECT n, unnest(range(0, (n - 1) // {CAPACITY} + 1)) AS i FROM l WHERE n > 0),
s AS (SELECT least({CAPACITY}, n - i * {CAPACITY}) AS size FROM p)
SELECT least({CAPACITY} // size, {CLASSES}) AS class, count(*) AS n_pieces, CAST(sum(size) AS BIGINT) AS n_tokens FROM s GROUP BY 1""",
}
QUERIES = {"p7_found": p7_found, "p7_checked": p7_checked, "p7_bins": p7_bins, "p7_classes": p7_classes, "p7_fill": p7_fill, "p7_packed": p7_packed}
