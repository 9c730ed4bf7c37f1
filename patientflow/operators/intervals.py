"""Overlapping and gapped intervals: continuous periods and the gaps between them (problem 6)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from ..plans.runtime import checkpointed, partitions, persisted, table

LEAST = np.iinfo(np.int64).min


def latest_version(df: DataFrame, key: str, version: str, columns: list[str]) -> DataFrame:
    """Of each non-null ``key`` the row with the greatest ``version`` (null: least); among ties the greatest other columns."""
    rest = [c for c in columns if c not in (key, version)]
    picked = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(version, *rest)).alias("_v"))
    return picked.select(key, *[F.col(f"_v.{c}").alias(c) for c in (version, *rest)])


def _fragments(batches: Iterator[pa.RecordBatch], carry: dict[int, tuple]) -> Iterator[pa.RecordBatch]:
    """Rescan of one partition: one row per stretch of an island in it. carry: the entity and greatest end before each partition."""
    p = TaskContext.get().partitionId()
    entity, reach = carry.get(p, (None, LEAST))  # the state: current entity and its greatest end so far
    run = None  # the open fragment: [entity, start, end, n, prev_end, continues]
    seq, kind = 0, None
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        ents, kind = b.column(0), b.column(0).type
        e = ents.to_numpy(zero_copy_only=False)
        s, t = (b.column(i).cast(pa.int64()).to_numpy() for i in (1, 2))
        fresh = np.ones(n, bool)  # first row of its entity
        fresh[1:] = e[1:] != e[:-1]
        fresh[0] = entity is None or e[0] != entity
        first = np.flatnonzero(fresh)
        top = t.copy()  # greatest end up to and with the row, within its entity
        for i, j in zip([0, *first[first > 0]], [*first[first > 0], n]):
            if i == 0 and not fresh[0]:
                top[0] = max(top[0], reach)
            if j - i > 1:
                np.maximum.accumulate(top[i:j], out=top[i:j])
        before = np.empty(n, np.int64)
        before[1:], before[0] = top[:-1], reach
        before[fresh] = LEAST
        new = fresh | (s > before)
        at = np.flatnonzero(new)
        out: list[list] = []
        if run is None and not new[0]:  # continues the island that the partition before left open
            run = [e[0], s[0], t[0], 0, None, True]
        edges = [*at, n]
        if (k := edges[0]) > 0:
            run[2], run[3] = max(run[2], int(t[:k].max())), run[3] + k
        for i, j in zip(edges[:-1], edges[1:]):
            if run is not None:
                out.append([p, seq, *run])
                seq += 1
            run = [e[i], int(s[i]), int(t[i:j].max()), j - i, None if fresh[i] else int(before[i]), False]
        entity, reach = e[-1], int(top[-1])
        if out:
            yield _batch(out, kind)
    if run is not None:
        yield _batch([[p, seq, *run]], kind)


def _batch(rows: list[list], kind: pa.DataType) -> pa.RecordBatch:
    cols = list(zip(*rows))
    us = pa.timestamp("us")
    return pa.RecordBatch.from_arrays(
        [pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], kind), pa.array(cols[3], pa.int64()).cast(us), pa.array(cols[4], pa.int64()).cast(us), pa.array(cols[5], pa.int64()), pa.array(cols[6], pa.int64()).cast(us), pa.array(cols[7], pa.bool_())],
        ["part", "seq", "entity", "start", "end", "n", "prev_end", "continues"],
    )


def merge_intervals(df: DataFrame, entity: str, start: str, end: str) -> DataFrame:
    """Merges overlapping and touching intervals of an entity into periods.

    Returns one row per period: ``entity, start, end, n`` (intervals in it) and
    ``prev_end`` (end of the entity's period before, null for its first), so
    that gaps need no further window. Rows without entity or start are left
    out; an end that is null or before the start counts as the start; repeated
    rows count each in ``n``; other columns are ignored. Times are
    timestamp_ntz; an empty table gives an empty result.

    Rows are range-sorted by (entity, start) over all partitions, so an entity
    of any size is spread. Each partition gives one summary (its last entity
    and that entity's greatest end); the summaries are combined in order on
    the driver (one row per partition), and the rescan labels islands with the
    carried state. Islands that cross partitions are stitched by their first fragment.
    """
    spark = df.sparkSession
    rows = df.select(F.col(entity).alias("entity"), F.col(start).cast("timestamp_ntz").alias("start"), F.col(end).cast("timestamp_ntz").alias("end")).where("entity is not null and start is not null")
    rows = rows.withColumn("end", F.greatest("start", F.coalesce("end", "start")))
    by = checkpointed(rows.repartitionByRange(partitions(spark), "entity", "start").sortWithinPartitions("entity", "start", "end"))
    micros = F.col("l.end").cast("string")
    ends = by.groupBy(F.spark_partition_id().alias("p")).agg(F.max(F.struct("entity", "end")).alias("l")).select("p", F.col("l.entity").alias("e"), micros.alias("t")).collect()
    carry, at = {}, (None, LEAST)
    last = {r.p: (r.e, int(np.datetime64(r.t.replace(" ", "T"), "us").astype(np.int64))) for r in ends}
    for p in range(max(last, default=-1) + 1):
        carry[p] = at
        if p in last:
            e, t = last[p]
            at = (e, max(t, at[1]) if e == at[0] else t)
    kind = by.schema["entity"].dataType
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("seq", T.LongType()), T.StructField("entity", kind), *[T.StructField(c, T.TimestampNTZType()) for c in ("start", "end")], T.StructField("n", T.LongType()), T.StructField("prev_end", T.TimestampNTZType()), T.StructField("continues", T.BooleanType())])
    found = persisted(by.mapInArrow(lambda it: _fragments(it, carry), schema), "fragments")
    # The first fragment of a partition may continue; the root of its chain is the last fragment of the nearest earlier partition with rows.
    edge = found.groupBy("part").agg(F.max(F.struct("seq", "continues")).alias("l"), F.max("continues").alias("c")).collect()
    root, roots = None, []
    for r in sorted(edge, key=lambda r: r.part):
        if r.c:
            roots.append((r.part, *root))
        if not r.l.continues:
            root = (r.part, r.l.seq)
    known = spark.createDataFrame(roots, "part int, root_part int, root_seq bigint")
    key = found.join(F.broadcast(known), "part", "left").select(F.when(F.col("continues"), F.col("root_part")).otherwise(F.col("part")).alias("rp"), F.when(F.col("continues"), F.col("root_seq")).otherwise(F.col("seq")).alias("rs"), "entity", "start", "end", "n", "prev_end")
    return key.groupBy("rp", "rs", "entity").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n"), F.max("prev_end").alias("prev_end")).drop("rp", "rs")


GAP_SECONDS = 365 * 86_400


def valid_visits(visits: DataFrame) -> DataFrame:
    """The holding version of each visit, without withdrawn visits and those without person or start."""
    held = latest_version(visits, "visit_occurrence_id", "loaded_at", ["deleted_at", "person_id", "visit_start_datetime", "visit_end_datetime"])
    return held.where("deleted_at is null and person_id is not null and visit_start_datetime is not null")


def visit_periods(visits: DataFrame) -> DataFrame:
    """Continuous periods of each person's valid visits."""
    return merge_intervals(valid_visits(visits), "person_id", "visit_start_datetime", "visit_end_datetime")


def _text(c: str) -> F.Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def periods_and_gaps(periods: DataFrame, gap_seconds: int = GAP_SECONDS) -> DataFrame:
    """Rows (kind, person_id, start_at, end_at): periods of two or more visits, and gaps longer than ``gap_seconds``."""
    span = F.expr("timestampdiff(MICROSECOND, prev_end, start)")
    kinds = F.array(
        F.when(F.col("n") >= 2, F.struct(F.lit("period").alias("kind"), F.col("start").alias("a"), F.col("end").alias("b"))),
        F.when(span > gap_seconds * 1_000_000, F.struct(F.lit("gap").alias("kind"), F.col("prev_end").alias("a"), F.col("start").alias("b"))),
    )
    return periods.select(F.col("entity").alias("person_id"), F.explode(F.array_compact(kinds)).alias("k")).select("k.kind", "person_id", _text("k.a").alias("start_at"), _text("k.b").alias("end_at"))


def p6_found(spark, sf_dir: str) -> DataFrame:
    return periods_and_gaps(visit_periods(table(spark, sf_dir, "visit_occurrence")))


def p6_periods(spark, sf_dir: str) -> DataFrame:
    """Every period, also of a single visit."""
    p = visit_periods(table(spark, sf_dir, "visit_occurrence"))
    return p.select(F.col("entity").alias("person_id"), _text("start").alias("start_at"), _text("end").alias("end_at"), F.col("n").alias("n_visits"))


_P6 = """
WITH held AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY visit_occurrence_id ORDER BY loaded_at DESC NULLS LAST,
    deleted_at DESC NULLS LAST, person_id DESC NULLS LAST, visit_start_datetime DESC NULLS LAST, visit_end_datetime DESC NULLS LAST) rn
    FROM visit_occurrence WHERE visit_occurrence_id IS NOT NULL) WHERE rn = 1),
v AS (SELECT person_id, visit_start_datetime s, greatest(visit_start_datetime, coalesce(visit_end_datetime, visit_start_datetime)) e
  FROM held WHERE deleted_at IS NULL AND person_id IS NOT NULL AND visit_start_datetime IS NOT NULL),
m AS (SELECT *, max(e) OVER (PARTITION BY person_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) pm FROM v),
i AS (SELECT *, sum(CASE WHEN pm IS NULL OR s > pm THEN 1 ELSE 0 END) OVER (PARTITION BY person_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) g FROM m),
p AS (SELECT person_id, g, min(s) a, max(e) b, count(*) n FROM i GROUP BY 1, 2),
l AS (SELECT *, lead(a) OVER (PARTITION BY person_id ORDER BY g) nx FROM p)
"""
SQL = {
    "p6_found": _P6 + """
SELECT 'period' AS kind, person_id, strftime(a, '%Y-%m-%d %H:%M:%S') AS start_at, strftime(b, '%Y-%m-%d %H:%M:%S') AS end_at FROM p WHERE n >= 2
UNION ALL SELECT 'gap', person_id, strftime(b, '%Y-%m-%d %H:%M:%S'), strftime(nx, '%Y-%m-%d %H:%M:%S') FROM l WHERE epoch_us(nx) - epoch_us(b) > 31536000000000""",
    "p6_periods": _P6 + "SELECT person_id, strftime(a, '%Y-%m-%d %H:%M:%S') AS start_at, strftime(b, '%Y-%m-%d %H:%M:%S') AS end_at, n AS n_visits FROM p",
}
QUERIES = {"p6_found": p6_found, "p6_periods": p6_periods}
