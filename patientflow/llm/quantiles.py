"""Percentiles of very large numeric columns from mergeable rank-interval summaries (problem 3)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..plans.runtime import partitions, persisted, table
from ..plans.skew import broadcast_if_small
from .ngrams import BLANKS

#: A summary is a sorted list of (value, rmin, rmax): the rank of the value in its data lies between rmin and rmax.
SUMMARY = "group string, node bigint, n bigint, value array<double>, rmin array<bigint>, rmax array<bigint>"
#: Summaries of a group that are merged at once, about.
FAN_IN = 16
#: Values of all groups that a task holds (16 MB) before it summarises the largest groups and lets them go.
HELD = 1 << 21


def exact(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The summary of a few values without any uncertainty."""
    v = np.sort(values)
    r = np.arange(1, len(v) + 1, dtype=np.int64)
    return v, r, r.copy()


def merge(a: tuple, b: tuple) -> tuple:
    """Union of two summaries; the rank uncertainties of both add up where they meet."""
    if not len(a[0]) or not len(b[0]):
        return b if not len(a[0]) else a

    def lift(x: tuple, y: tuple, side: str) -> tuple[np.ndarray, np.ndarray]:
        before = np.searchsorted(y[0], x[0], side)  # values of y that stand before x's; ties: a first
        low = np.concatenate([[0], y[1]])[before]
        high = np.concatenate([y[2] - 1, [y[2][-1]]])[before]
        return x[1] + low, x[2] + high

    (la, ha), (lb, hb) = lift(a, b, "left"), lift(b, a, "right")
    v = np.concatenate([a[0], b[0]])
    order = np.argsort(v, kind="stable")
    return v[order], np.concatenate([la, lb])[order], np.concatenate([ha, hb])[order]


def compress(s: tuple, keep: int) -> tuple:
    """At most ``keep`` + 2 tuples, adding at most n / (2 keep) to the rank error: the tuple nearest to each evenly spaced rank, and both ends."""
    v, lo, hi = s
    if len(v) <= keep + 2:
        return s
    n = hi[-1]
    mid = (lo + hi) / 2
    target = np.linspace(1, n, keep + 1)
    i = np.clip(np.searchsorted(mid, target), 1, len(mid) - 1)
    i = np.where(target - mid[i - 1] <= mid[i] - target, i - 1, i)
    at = np.unique(np.concatenate([[0], i, [len(v) - 1]]))
    return v[at], lo[at], hi[at]


def error(s: tuple) -> float:
    """The accumulated rank error: no rank is further than this from a kept tuple's interval."""
    _, lo, hi = s
    return float(max((hi - lo).max(), ((hi[1:] - lo[:-1]) / 2).max())) if len(lo) > 1 else float((hi - lo).max())


def merge_all(found: list[tuple], keep: int) -> tuple:
    """The union of summaries, compressed once: however many are merged, the compression adds n / (2 keep) only once."""
    while len(found) > 1:
        found = [merge(*found[i : i + 2]) if i + 1 < len(found) else found[i] for i in range(0, len(found), 2)]
    return compress(found[0], keep)


def _rows(found: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*found))
    lists = [pa.array([x[i] for x in cols[3]], pa.list_(t)) for i, t in enumerate((pa.float64(), pa.int64(), pa.int64()))]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), *lists], ["group", "node", "n", "value", "rmin", "rmax"])


def _leaves(batches: Iterator[pa.RecordBatch], keep: int, most: int) -> Iterator[pa.RecordBatch]:
    """Summaries of this partition's groups: one for each, or more where all groups together hold more than ``most`` values."""
    part = TaskContext.get().partitionId()
    held: dict[str, list[np.ndarray]] = {}
    size: dict[str, int] = {}

    def close(groups: list[str]) -> pa.RecordBatch:
        out = []
        for g in groups:
            s = compress(exact(np.concatenate(held.pop(g))), keep)
            out.append((g, part, size.pop(g), s))
        return _rows(out)

    total = 0
    for b in batches:
        if not b.num_rows:
            continue
        c = b.column(0).dictionary_encode()
        code, v = c.indices.to_numpy(), b.column(1).to_numpy()
        order = np.argsort(code, kind="stable")
        cut = np.flatnonzero(np.diff(code[order])) + 1
        for rows in np.split(order, cut):
            g = c.dictionary[int(code[rows[0]])].as_py()
            held.setdefault(g, []).append(v[rows])
            size[g] = size.get(g, 0) + len(rows)
        total += len(v)
        if total > most:  # the largest groups go, until half is free
            go = []
            for g in sorted(size, key=lambda g: (-size[g], g)):
                if total <= most // 2:
                    break
                total -= size[g]
                go.append(g)
            for i in range(0, len(go), GROUPS_AT_ONCE):
                yield close(go[i : i + GROUPS_AT_ONCE])
    left = sorted(held)
    for i in range(0, len(left), GROUPS_AT_ONCE):
        yield close(left[i : i + GROUPS_AT_ONCE])


def _read(b: pa.RecordBatch) -> Iterator[tuple[str, int, int, tuple]]:
    lists = [b.column(i) for i in (3, 4, 5)]
    flat, at = [x.values.to_numpy() for x in lists], [x.offsets.to_numpy() for x in lists]
    for i, (g, node, n) in enumerate(zip(*(b.column(j).to_pylist() for j in range(3)))):
        yield g, node, n, tuple(f[o[i] : o[i + 1]] for f, o in zip(flat, at))


def _merged(batches: Iterator[pa.RecordBatch], keep: int) -> Iterator[pa.RecordBatch]:
    """Merges neighbouring rows of one (group, node), in one compression."""
    now, found = None, []

    def close() -> pa.RecordBatch:
        s = merge_all(found, keep)
        return _rows([(*now, int(s[2][-1]), s)])

    for b in batches:
        for g, node, _, s in _read(b):
            if (g, node) != now:
                if now is not None:
                    yield close()
                now, found = (g, node), []
            found.append(tuple(x.copy() for x in s))
    if now is not None:
        yield close()


#: Groups in one batch of summaries.
GROUPS_AT_ONCE = 1_000


def leaf_tuples(epsilon: float) -> int:
    """Tuples of a leaf such that its one compression adds at most epsilon / 2 * n."""
    return math.ceil(1 / epsilon)


def merged_tuples(epsilon: float, levels: int) -> int:
    """Tuples of a merged summary such that the compressions of all levels add at most epsilon / 2 * n."""
    return math.ceil(max(1, levels) / epsilon)


def summarise(df: DataFrame, group: str, value: str, epsilon: float) -> DataFrame:
    """Leaf summaries, one per group and partition: ``group, node, n, value, rmin, rmax``; nothing is shuffled, so hot groups do no harm.

    Null, NaN and infinite values and null groups are left out.
    """
    rows = df.select(F.col(group).cast("string").alias("group"), F.col(value).cast("double").alias("value")).where("group is not null and value is not null and not isnan(value) and abs(value) < double('inf')")
    keep = leaf_tuples(epsilon)
    return rows.mapInArrow(lambda it: _leaves(it, keep, HELD), SUMMARY)


def combine(summaries: DataFrame, epsilon: float, fan_in: int = FAN_IN) -> DataFrame:
    """Merges summaries of any number of partitions, days or loads into one per group, about ``fan_in`` at a time.

    Several tables of summaries are combined by a union before. Summaries are
    dealt to the leaves of a tree as deep as the greatest number of them in a
    group asks for; each level merges and compresses once, and the tuples kept
    follow from the real depth. Only summaries are shuffled.
    """
    now = persisted(summaries, "summaries")
    spark = summaries.sparkSession
    most = now.groupBy("group").count().agg(F.max("count")).first()[0] or 1
    levels = max(1, math.ceil(math.log(most, fan_in) - 1e-9))
    keep = merged_tuples(epsilon, levels)
    now = now.withColumn("node", F.pmod(F.xxhash64("node", "n", "value"), F.lit(fan_in**levels)).cast("bigint"))
    for _ in range(levels):
        by = now.withColumn("node", F.floor(F.col("node") / fan_in).cast("bigint")).repartition(partitions(spark), "group", "node").sortWithinPartitions("group", "node", "n", "value")
        now = by.mapInArrow(lambda it: _merged(it, keep), SUMMARY)
    return now


def _answers(batches: Iterator[pa.RecordBatch], shares: list[float]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for g, _, n, (value, lo, hi) in _read(b):
            want = [max(1, math.ceil(q * n - 1e-9)) for q in shares]
            off = [np.maximum(hi - k, k - lo) for k in want]
            at = [int(x.argmin()) for x in off]
            yield pa.RecordBatch.from_arrays([pa.array([g]), pa.array([n]), pa.array([[float(value[i]) for i in at]], pa.list_(pa.float64())), pa.array([[int(x[i]) for x, i in zip(off, at)]], pa.list_(pa.int64())), pa.array([error((None, lo, hi))])], ["group", "n", "quantiles", "rank_errors", "max_error"])


def quantiles(summaries: DataFrame, shares: list[float]) -> DataFrame:
    """Per group: n, the value of rank ceil(share * n) for each share, a proven bound of each answer's rank error, and the summary's."""
    return summaries.mapInArrow(lambda it: _answers(it, shares), "group string, n bigint, quantiles array<double>, rank_errors array<bigint>, max_error double")


EPSILON = 0.001
SHARES = (1, 5, 25, 50, 75, 95, 99)


def lab_values(spark, sf_dir: str) -> DataFrame:
    """concept_id, unit, value of the finite values at labs' positions; a null unit meets a null unit.

    All rows count, redelivered ones too; concept ids without outer blanks. Positions beyond the end of an array have no value or unit.
    """
    labs = table(spark, sf_dir, "lab_stats").select(F.btrim("concept_id", F.lit(BLANKS)).alias("c"), F.col("unit").alias("u")).where("c is not null").distinct()
    finite = F.filter(F.arrays_zip("concept_ids", "values", F.coalesce("units", F.array().cast("array<string>")).alias("units")), lambda x: x["values"].isNotNull() & ~F.isnan(x["values"]) & (F.abs(x["values"]) < float("inf")))
    at = table(spark, sf_dir, "processed_dataset").select(F.explode(finite).alias("x")).select(F.btrim("x.concept_ids", F.lit(BLANKS)).alias("concept_id"), F.col("x.units").alias("unit"), F.col("x.values").alias("value"))
    small = broadcast_if_small(labs)
    return at.join(small, (F.col("concept_id") == F.col("c")) & F.col("unit").eqNullSafe(F.col("u"))).select("concept_id", "unit", "value")


def lab_summaries(values: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    return summarise(values.withColumn("lab", F.to_json(F.struct("concept_id", "unit"))), "lab", "value", epsilon)


def _split(df: DataFrame) -> DataFrame:
    lab = F.from_json("group", "concept_id string, unit string")
    return df.withColumn("_l", lab).withColumn("concept_id", F.col("_l.concept_id")).withColumn("unit", F.col("_l.unit"))


def lab_percentiles(summaries: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    q = _split(quantiles(combine(summaries, epsilon), [p / 100 for p in SHARES]))
    return q.select("concept_id", "unit", F.col("n").alias("n_values"), *[F.col("quantiles")[i].alias(f"p{p:02d}") for i, p in enumerate(SHARES)], F.array_max("rank_errors").alias("max_rank_error"))


def p3_percentiles(spark, sf_dir: str) -> DataFrame:
    return lab_percentiles(lab_summaries(lab_values(spark, sf_dir)))


def p3_sizes(spark, sf_dir: str) -> DataFrame:
    """Per lab its values and the tuples of its combined summary: the summary's size does not grow with the data."""
    return _split(combine(lab_summaries(lab_values(spark, sf_dir)), EPSILON)).select("concept_id", "unit", F.col("n").alias("n_values"), F.size("value").alias("n_tuples"))


def p3_combined(spark, sf_dir: str) -> DataFrame:
    """As p3_percentiles, from the summaries of two separate loads (odd and even values by hash) that are combined afterwards."""
    v = lab_values(spark, sf_dir)
    half = F.pmod(F.xxhash64("value"), F.lit(2))
    both = [lab_summaries(v.where(half == i)) for i in (0, 1)]
    return lab_percentiles(both[0].unionAll(both[1]))


def p3_verified(spark, sf_dir: str) -> DataFrame:
    """Per lab the number of values and whether the true ranks of all its percentiles lie within epsilon * n, counted over all values."""
    v, q = lab_values(spark, sf_dir), broadcast_if_small(p3_percentiles(spark, sf_dir))
    same = (v.concept_id == q.concept_id) & v.unit.eqNullSafe(q.unit)
    below = [F.sum(F.when(F.col("value") < F.col(f"p{p:02d}"), 1).otherwise(0)).alias(f"b{p}") for p in SHARES]
    upto = [F.sum(F.when(F.col("value") <= F.col(f"p{p:02d}"), 1).otherwise(0)).alias(f"u{p}") for p in SHARES]
    c = v.join(q, same).groupBy(q.concept_id, q.unit).agg(F.count("*").alias("n_values"), *below, *upto)
    ok = F.lit(True)
    for p in SHARES:
        rank = F.greatest(F.lit(1), F.ceil(F.lit(p / 100) * F.col("n_values") - 1e-9))
        slack = EPSILON * F.col("n_values") + 1e-9
        ok = ok & (F.col(f"b{p}") + 1 - slack <= rank) & (rank <= F.col(f"u{p}") + slack)
    return c.select("concept_id", "unit", "n_values", ok.cast("int").alias("within"))


_VALUES = """
WITH labs AS (SELECT DISTINCT trim(concept_id, ' ' || chr(9) || chr(10) || chr(13)) AS c, unit AS u FROM lab_stats WHERE concept_id IS NOT NULL),
x AS (SELECT trim(unnest(concept_ids), ' ' || chr(9) || chr(10) || chr(13)) AS c, unnest(units) AS u, unnest("values") AS v FROM processed_dataset),
f AS (SELECT labs.c AS concept_id, labs.u AS unit, v FROM x JOIN labs ON x.c = labs.c AND x.u IS NOT DISTINCT FROM labs.u WHERE v IS NOT NULL AND isfinite(v))
"""
SQL = {"p3_verified": _VALUES + "SELECT concept_id, unit, count(*) AS n_values, 1 AS within FROM f GROUP BY ALL"}
QUERIES = {"p3_percentiles": p3_percentiles, "p3_sizes": p3_sizes, "p3_combined": p3_combined, "p3_verified": p3_verified}
