"""References to records that do not exist (problem 2)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..plans.runtime import partitions, table
from ..plans.skew import HOT_PER_PARTITION, heavy, salt_count, salts

#: Runs are cut where ``key >> BLOCK_BITS`` changes, so a run holds at most 4,096 keys and never leaves its block.
BLOCK_BITS = 12
#: In ``since``: the key's rows are all deleted.
DELETED = np.iinfo(np.int64).max
#: A live key without a load time is never late; a reference without one cannot be late.
ALWAYS, NEVER = np.iinfo(np.int64).min, np.iinfo(np.int64).max


@dataclass(frozen=True)
class Parent:
    """A referenced table. ``loaded`` and ``deleted`` may be None: then keys are never late or deleted."""

    name: str
    key: str
    loaded: str | None = "loaded_at"
    deleted: str | None = "deleted_at"


@dataclass(frozen=True)
class References:
    """The reference columns of one table, each with its parent's name."""

    name: str
    row_id: str
    columns: tuple[tuple[str, str], ...]
    loaded: str | None = "loaded_at"


def _micros(c: F.Column) -> F.Column:
    """Order-preserving bigint of a time of any kind."""
    return F.unix_micros(c.cast("timestamp"))


def parent_keys(df: DataFrame, parent: Parent) -> DataFrame:
    """One row per non-null key: block, key, since (DELETED, or the earliest load time of a row that is not deleted)."""
    live = F.lit(True) if parent.deleted is None else F.col(parent.deleted).isNull()
    since = F.lit(ALWAYS) if parent.loaded is None else F.coalesce(_micros(F.col(parent.loaded)), F.lit(ALWAYS))
    rows = df.select(F.col(parent.key).cast("bigint").alias("key"), F.when(live, since).otherwise(F.lit(DELETED)).alias("since")).where("key is not null")
    return rows.groupBy("key").agg(F.min("since").alias("since")).select(F.shiftright("key", BLOCK_BITS).alias("block"), "key", "since")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compresses sorted (block, key, since) into (block, start, end, since[]) of contiguous keys."""
    held: tuple | None = None
    names = ["block", "start", "end", "since"]

    def pack(b: np.ndarray, k: np.ndarray, s: np.ndarray, cut: np.ndarray) -> pa.RecordBatch:
        """cut: where runs start, and the total at the end."""
        values = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(s[: cut[-1]]))
        return pa.RecordBatch.from_arrays([pa.array(b[cut[:-1]]), pa.array(k[cut[:-1]]), pa.array(k[cut[1:] - 1]), values], names)

    for batch in batches:
        b, k, s = (batch.column(i).to_numpy() for i in range(3))
        if held is not None:
            b, k, s = (np.concatenate(x) for x in zip(held, (b, k, s)))
        if not len(k):
            continue
        new = np.flatnonzero((k[1:] != k[:-1] + 1) | (b[1:] != b[:-1])) + 1
        cut = np.concatenate(([0], new))
        held = b[cut[-1] :], k[cut[-1] :], s[cut[-1] :]  # the last run may go on: at most one block
        if len(cut) > 1:
            yield pack(b, k, s, cut)
    if held is not None and len(held[0]):
        yield pack(*held, np.array([0, len(held[0])]))


def key_runs(df: DataFrame, parent: Parent) -> DataFrame:
    """Contiguous runs of the parent's keys: ``block, start, end, since`` (one load time per key of the run)."""
    keys = parent_keys(df, parent)
    by = keys.repartition(partitions(df.sparkSession), "block").sortWithinPartitions("block", "key")
    return by.mapInArrow(_runs, "block bigint, start bigint, end bigint, since array<bigint>")


def reference_rows(df: DataFrame, refs: References, hot: list[int]) -> DataFrame:
    """Long form: no, parent, key, row_id, first_loaded (earliest load time of the row's id; NEVER if unknown).

    One shuffle by row id, where all reference columns go together; rows
    without any reference are left out first where load times do not matter.
    ``hot`` are row ids of many rows: they, and the rows without id, are
    reduced to their distinct references with map-side combine and get
    their few earliest times by a broadcast of one row an id.
    """
    names = [c for c, _ in refs.columns]
    keys = [f"r{i}" for i in range(len(names))]
    rows = df.select(F.col(refs.row_id).cast("bigint").alias("row_id"), *[F.col(c).cast("bigint").alias(k) for c, k in zip(names, keys)], *([_micros(F.col(refs.loaded)).alias("t")] if refs.loaded else []))
    if refs.loaded:
        special = F.col("row_id").isNull() | (F.col("row_id").isin(hot) if hot else F.lit(False))
        few = rows.where(special).groupBy("row_id", *keys).agg(F.min("t").alias("t"))
        first = few.groupBy(F.col("row_id").alias("i")).agg(F.min("t").alias("first_loaded"))
        few = few.join(F.broadcast(first), F.col("row_id").eqNullSafe(F.col("i"))).drop("i", "t")
        rows = rows.where(~special).withColumn("first_loaded", F.min("t").over(Window.partitionBy("row_id"))).drop("t").unionByName(few)
    else:
        rows = rows.where(F.coalesce(*keys).isNotNull()).groupBy("row_id", *keys).agg(F.lit(NEVER).alias("first_loaded"))
    each = F.array(*[F.when(F.col(k).isNotNull(), F.struct(F.lit(i).alias("no"), F.lit(p).alias("parent"), F.col(k).alias("key"))) for i, (k, (_, p)) in enumerate(zip(keys, refs.columns))])
    return rows.select("row_id", F.coalesce("first_loaded", F.lit(NEVER)).alias("first_loaded"), F.explode(F.array_compact(each)).alias("r")).select(F.col("r.no").alias("no"), F.col("r.parent").alias("parent"), F.col("r.key").alias("key"), "row_id", "first_loaded")


def _asof(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by (at, key, tag): each reference meets the preceding run start of its place and block.

    Columns: at (parent and salt), key, tag (-1: a run), x (a run's end, or the
    row id), first_loaded, since (runs only).
    """
    held = None  # the run row in force, as a batch of one row
    for batch in batches:
        t = pa.Table.from_batches([held, batch] if held is not None else [batch]).combine_chunks()
        if not t.num_rows:
            continue
        b = t.to_batches()[0]
        where, keys, tags = (b.column(i).to_numpy() for i in range(3))
        run = tags < 0
        at, refs = np.flatnonzero(run), np.flatnonzero(~run)
        if len(refs):
            key, loaded = keys[refs], b.column(4).to_numpy(zero_copy_only=False)[refs]
            kind = np.zeros(len(refs), np.int8)  # 0 missing, 1 deleted, 2 late, 3 holds
            if len(at):
                w = np.searchsorted(at, refs) - 1  # the preceding run row
                run_at = at[np.maximum(w, 0)]
                end = b.column(3).take(pa.array(run_at)).to_numpy(zero_copy_only=False)
                mine = (w >= 0) & (where[run_at] == where[refs]) & (keys[run_at] <= key) & (key <= end)
                lists = b.column(5)
                flat, offset = lists.values.to_numpy(), lists.offsets.to_numpy()[run_at]
                since = flat[np.where(mine, offset + key - keys[run_at], 0)]
                kind = np.where(~mine, 0, np.where(since == DELETED, 1, np.where(since > loaded, 2, 3))).astype(np.int8)
            bad = kind < 3
            if bad.any():
                yield pa.RecordBatch.from_arrays([pa.array(tags[refs[bad]]), b.column(3).take(pa.array(refs[bad])), pa.array(loaded[bad]), pa.array(kind[bad].astype(np.int32))], ["tag", "row_id", "first_loaded", "kind"])
        if len(at):
            held = pa.Table.from_batches([b.slice(int(at[-1]), 1)]).combine_chunks().to_batches()[0]


#: Bits of a block's hot number below a parent's number in ``at``; more salts than that share places, which costs only balance.
SALT_BITS = 24


def orphan_references(tables: dict[str, DataFrame], parents: list[Parent], references: list[References]) -> DataFrame:
    """Every row with a non-null reference that does not hold: ``table_name, column_name, row_id, kind, first_loaded``.

    kind: ``missing`` (no row has the key), ``deleted`` (all its rows are
    deleted) or ``late`` (its earliest live row was loaded after the earliest
    row of the referring id). Null references are none; row ids may be null;
    repeated rows give one result row; versions of one id with other references
    are judged each; empty tables give an empty result, an empty parent makes
    every reference missing. first_loaded (timestamp) is null where the
    referring table has no load time.

    Parent keys become contiguous runs that carry their keys' load times.
    References and runs meet in one shuffle by (parent, salt, block of 4,096
    keys) and one sorted sweep. One scan of each table finds its heavy blocks
    and row ids without a shuffle; a heavy block gets salts in proportion to
    its references (all of them together fewer than four times the partitions) and its runs are repeated per salt.
    """
    spark = next(iter(tables.values())).sparkSession
    n = partitions(spark)
    by_name = {p.name: i for i, p in enumerate(parents)}
    total, load, hot_ids = 0, {}, {}
    for r in references:
        blocks = [F.shiftright(F.col(c).cast("bigint"), BLOCK_BITS).alias(f"b{i}") for i, (c, _) in enumerate(r.columns)]
        rows, found = heavy(tables[r.name].select(F.col(r.row_id).cast("bigint").alias("row_id"), *blocks), ["row_id", *[f"b{i}" for i in range(len(blocks))]])
        total += rows * len(blocks)
        hot_ids[r.name] = [k for k, c in found[0].items() if k is not None and c * HOT_PER_PARTITION * n > max(rows, HOT_PER_PARTITION * n)]
        for (_, p), counts in zip(r.columns, found[1:]):
            for k, c in counts.items():
                if k is not None:
                    load[by_name[p], k] = load.get((by_name[p], k), 0) + c
    spread = {k * len(parents) + p: m for (p, k), m in salts(load, total, n).items()}
    many = lambda p, key: salt_count(F.shiftright(key, BLOCK_BITS) * len(parents) + p, spread)
    place = lambda p, salt: (F.shiftleft(p.cast("bigint"), SALT_BITS) + salt).cast("bigint")
    tags, refs = [], None
    for r in references:
        base = len(tags)
        tags += [(r.name, c) for c, _ in r.columns]
        one = reference_rows(tables[r.name], References(r.name, r.row_id, tuple((c, str(by_name[p])) for c, p in r.columns), r.loaded), hot_ids[r.name]).withColumn("tag", F.col("no") + base)
        refs = one if refs is None else refs.unionByName(one)
    salt = F.pmod(F.xxhash64("row_id", "key", "first_loaded"), many(F.col("parent").cast("int"), F.col("key")))
    refs = refs.select(place(F.col("parent").cast("int"), salt).alias("at"), "key", F.col("tag").cast("int").alias("tag"), F.col("row_id").alias("x"), "first_loaded", F.lit(None).cast("array<bigint>").alias("since"))
    runs = None
    for p in parents:
        i = F.lit(by_name[p.name])
        one = key_runs(tables[p.name], p).withColumn("salt", F.explode(F.sequence(F.lit(0), many(i, F.col("start")) - 1)))
        one = one.select(place(i, F.col("salt")).alias("at"), F.col("start").alias("key"), F.lit(-1).alias("tag"), F.col("end").alias("x"), F.lit(0).cast("bigint").alias("first_loaded"), "since")
        runs = one if runs is None else runs.unionAll(one)
    sweep = refs.unionAll(runs).repartition(n, "at", F.shiftright("key", BLOCK_BITS)).sortWithinPartitions("at", "key", "tag")
    found = sweep.mapInArrow(_asof, "tag int, row_id bigint, first_loaded bigint, kind int").distinct()
    names = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(c).alias("c")) for t, c in tags])
    return found.select(names[F.col("tag")].t.alias("table_name"), names[F.col("tag")].c.alias("column_name"), "row_id", F.array(*map(F.lit, ("missing", "deleted", "late")))[F.col("kind")].alias("kind"), F.when(F.col("first_loaded") != NEVER, F.timestamp_micros("first_loaded")).alias("first_loaded"))


PARENTS = [Parent("person", "person_id"), Parent("visit_occurrence", "visit_occurrence_id")]
PERSON, VISIT = ("person_id", "person"), ("visit_occurrence_id", "visit_occurrence")
REFERENCES = [
    References("visit_occurrence", "visit_occurrence_id", (PERSON, ("preceding_visit_occurrence_id", "visit_occurrence"))),
    References("condition_occurrence", "condition_occurrence_id", (PERSON, VISIT)),
    References("measurement", "measurement_id", (PERSON, VISIT)),
    References("patient_splits", "person_id", (PERSON,), None),
    References("processed_dataset", "person_id", (PERSON,), None),
]


def _orphans(spark, sf_dir: str) -> DataFrame:
    names = {*[p.name for p in PARENTS], *[r.name for r in REFERENCES]}
    return orphan_references({t: table(spark, sf_dir, t) for t in sorted(names)}, PARENTS, REFERENCES)


def p2_found(spark, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).drop("first_loaded")


def p2_report(spark, sf_dir: str) -> DataFrame:
    """Orphan references per table, column, kind and month of the row's first loading (null: the table has no load time)."""
    month = F.date_format("first_loaded", "yyyy-MM").alias("month")
    return _orphans(spark, sf_dir).groupBy("table_name", "column_name", "kind", month).agg(F.count("*").alias("n_rows"))


def _sql() -> str:
    keys = ", ".join(f"{p.name}_k AS (SELECT {p.key} AS k, min(loaded_at) FILTER (deleted_at IS NULL) AS since, bool_and(deleted_at IS NOT NULL) AS gone FROM {p.name} WHERE {p.key} IS NOT NULL GROUP BY 1)" for p in PARENTS)
    parts = []
    for r in REFERENCES:
        first = f"min(loaded_at) OVER (PARTITION BY {r.row_id})" if r.loaded else "NULL::TIMESTAMP"
        for c, p in r.columns:
            parts.append(f"SELECT DISTINCT '{r.name}' AS table_name, '{c}' AS column_name, r AS row_id, CASE WHEN k IS NULL THEN 'missing' WHEN gone THEN 'deleted' ELSE 'late' END AS kind, f AS first_loaded FROM (SELECT {r.row_id} AS r, {c} AS x, {first} AS f FROM {r.name}) LEFT JOIN {p}_k ON x = k WHERE x IS NOT NULL AND (k IS NULL OR gone OR since > f)")
    return f"WITH {keys}, o AS ({' UNION ALL '.join(parts)}) "


SQL = {
    "p2_found": _sql() + "SELECT table_name, column_name, row_id, kind FROM o",
    "p2_report": _sql() + "SELECT table_name, column_name, kind, strftime(first_loaded, '%Y-%m') AS month, count(*) AS n_rows FROM o GROUP BY ALL",
}
QUERIES = {"p2_found": p2_found, "p2_report": p2_report}
