"""Joins and ranks that stay whole and balanced when one key holds a large part of the rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .runtime import checkpointed, partitions, persisted

#: A key is hot if it holds more rows than this share of a partition; there are fewer than HOT_PER_PARTITION * partitions such keys.
HOT_PER_PARTITION = 4


def heavy(df: DataFrame, columns: list[str]) -> tuple[int, list[dict]]:
    """Rows of ``df`` and, for each column, its heavy values with a count that is never too low.

    One scan without a shuffle: each task keeps a frequent-items sketch of
    fixed size, so that every value with more than 1/(4 * partitions) of the
    rows is among them (the sketch errs by 1/(36 * partitions) at most); others may be too.
    Nulls are counted under None.
    """
    n = HOT_PER_PARTITION * partitions(df.sparkSession)
    most = min(1_000_000, max(1_024, 32 * n))
    names = [F.expr(f"approx_top_k(`{c}`, {min(most, 4 * n)}, {most})").alias(f"k{i}") for i, c in enumerate(columns)]
    r = df.agg(F.count(F.lit(1)).alias("n"), *names).first()
    return r[0], [{x[0]: x[1] for x in (r[f"k{i}"] or [])} for i in range(len(columns))]


def hot_keys(df: DataFrame, key: str) -> list:
    """Keys with more than 1/(4 * partitions) of the rows: fewer than 4 * partitions values, and a few near that share."""
    n = HOT_PER_PARTITION * partitions(df.sparkSession)
    total, (counts,) = heavy(df.select(key), [key])
    return sorted(k for k, c in counts.items() if k is not None and c * n > max(total, n))


#: Rows that one task takes of a key before the key is spread over more of them.
ROWS_PER_TASK = 100_000


def salts(counts: dict, total: int, n: int) -> dict:
    """How many tasks each heavy key needs, in proportion to its load; keys that one task can take are left out.

    A task's share is total / n, so all keys together get fewer than 2 n salts.
    """
    share = max(ROWS_PER_TASK, total / n)
    return {k: math.ceil(c / share) for k, c in counts.items() if k is not None and c > share}


def salt_count(key: Column, spread: dict) -> Column:
    """How many salts the key has: those of ``spread``, rounded up to a power of two, else one. Keys are looked up in hash sets, one for each power."""
    sets: dict[int, list] = {}
    for k, m in spread.items():
        sets.setdefault(1 << (m - 1).bit_length(), []).append(k)
    out = F.lit(1)
    for m, keys in sets.items():
        out = F.when(key.isin(keys), m).otherwise(out)
    return out


def spread_join(left: DataFrame, right: DataFrame, key: str, spread: dict | None = None) -> DataFrame:
    """Inner equi-join of two sides that may both repeat a key; heavy left keys are salted in proportion to their rows, their right rows repeated per salt."""
    if spread is None:
        total, (counts,) = heavy(left.select(key), [key])
        spread = salts(counts, total, partitions(left.sparkSession))
    if not spread:
        return left.join(right, key)
    n = salt_count(F.col(key), spread)
    salted = left.withColumn("_s", F.pmod(F.xxhash64(*left.columns), n).cast("int"))
    return salted.join(right.withColumn("_s", F.explode(F.sequence(F.lit(0), n - 1))), [key, "_s"]).drop("_s")


def skew_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", hot: list | None = None) -> DataFrame:
    """Equi-join of ``left`` with a ``right`` that is unique on ``key``; hot left keys are joined without moving the left rows.

    ``right`` restricted to the hot keys has at most one row per hot key, hence
    fewer than 4 * partitions rows: that bound makes the broadcast safe. All
    other keys take the shuffle join. ``how``: inner, left, left_semi, left_anti.
    Rows with a null key match nothing, as in SQL.
    """
    hot = hot_keys(left, key) if hot is None else hot
    if not hot:
        return left.join(right, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    rest = left.where(~is_hot).join(right, key, how)
    return left.where(is_hot).join(F.broadcast(right.where(F.col(key).isin(hot))), key, how).unionByName(rest)


def global_rank(df: DataFrame, order: list[Column], name: str = "rank", per: str | None = None) -> DataFrame:
    """Adds the 0-based rank over the whole table (or within each value of ``per``) without a single-task window.

    Rows are range-partitioned by ``order`` (after ``per``), written once, and
    numbered inside each partition; the driver only sees one count per
    partition and ``per`` value. ``order`` should be total. ``per`` must have few values.
    """
    spark = df.sparkSession
    keys = ([F.col(per)] if per else []) + order
    part = checkpointed(df.repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys)).withColumn("_p", F.spark_partition_id())
    group = F.col(per).cast("string") if per else F.lit("")
    counts = part.groupBy("_p", F.coalesce(group, F.lit("\0")).alias("_g")).count().collect()
    offsets, seen = [], {}
    for p, g, n in sorted((r[0], r[1], r[2]) for r in counts):
        offsets.append((p, g, seen.get(g, 0)))
        seen[g] = seen.get(g, 0) + n
    if not offsets:
        return part.withColumn(name, F.lit(0).cast("bigint")).drop("_p")
    # monotonically_increasing_id counts the rows of a partition in order; its least value per group starts that group.
    part = part.withColumn("_i", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)).withColumn("_g", F.coalesce(group, F.lit("\0")))
    starts = part.groupBy("_p", "_g").agg(F.min("_i").alias("_s")).join(spark.createDataFrame(offsets, "_p int, _g string, _o bigint"), ["_p", "_g"])
    return part.join(F.broadcast(starts), ["_p", "_g"]).withColumn(name, F.col("_i") - F.col("_s") + F.col("_o")).drop("_p", "_g", "_i", "_s", "_o")


#: Bytes of a side that may be broadcast.
BROADCAST_BYTES = 64 << 20


def width(df: DataFrame) -> Column:
    """About the bytes of a row: texts by their length, nested values by their JSON text, all else eight."""
    size = F.lit(16)
    for f in df.schema.fields:
        kind, c = f.dataType.typeName(), F.col(f"`{f.name}`")
        if kind in ("string", "binary", "varchar", "char"):
            size = size + F.coalesce(F.octet_length(c), F.lit(0)) + 16
        elif kind in ("array", "map", "struct"):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) + 16
        else:
            size = size + 8
    return size


def broadcast_if_small(df: DataFrame, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Writes ``df`` once and marks it for broadcast if its rows take at most ``most_bytes``; else leaves the join to Spark."""
    kept = persisted(df, "side")
    return F.broadcast(kept) if (kept.agg(F.sum(width(kept))).first()[0] or 0) <= most_bytes else kept


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], salts: int = 20, seed: int = 0) -> DataFrame:
    """Inner equi-join whose left rows are spread by a hash salt, the right ones repeated per salt; the result does not depend on the salt."""
    salt = F.pmod(F.xxhash64(*left.columns, F.lit(seed)), F.lit(salts)).cast("int")
    repeated = right.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    # Spark's estimate leaves out the repeats, so it might broadcast them; they must not go through the driver.
    return left.withColumn("_s", salt).join(repeated.hint("merge"), [*keys, "_s"]).drop("_s")
