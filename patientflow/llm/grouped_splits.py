"""Splits that keep related records together (problem 5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.runtime import counted, new_path, partitions, persisted, table
from ..plans.skew import HOT_PER_PARTITION, global_rank, heavy, skew_join

SHARES = (("train", 0.8), ("validation", 0.1), ("test", 0.1))


def split_name(c: str = "split") -> Column:
    """train, validation or test; ``val`` and ``valid`` mean validation, anything else is null."""
    s = F.lower(F.btrim(c, F.lit(" \t\n\r")))
    return F.when(s.isin("val", "valid"), "validation").when(s.isin("train", "validation", "test"), s)


def record_number(c: str) -> Column:
    """Letters in upper case and digits without leading zeros; null if no digit is other than 0."""
    digits = F.ltrim(F.regexp_replace(c, "[^0-9]", ""), F.lit("0"))
    return F.when(F.length(digits) > 0, F.concat(F.upper(F.regexp_replace(c, r"[^\p{L}]", "")), F.lit("|"), digits))


def group_edges(members: DataFrame) -> DataFrame:
    """Edges (a, b), a < b, from rows (key, node): each member of a key to the key's least node. Nulls link nothing.

    A key with a third of all rows costs one aggregate with map-side combine
    and a join in which hot keys are not moved.
    """
    rows = members.where("key is not null and node is not null").distinct()
    rows = persisted(rows, "members")
    least = rows.groupBy("key").agg(F.min("node").alias("a"))
    star = skew_join(rows, least, "key").where("node <> a")
    return star.select("a", F.col("node").alias("b")).distinct()


def spanning_forest(edges: DataFrame, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Minimum-edge contraction: labels (node, root) of all nodes with an edge, and the forest's edges (a, b).

    Each round every component takes its least edge in the total order (a, b);
    edges taken from both sides make the smaller component the root; chains
    are shortened by doubling; edges are relabelled, loops dropped and parallel
    edges reduced to the least. Components at least halve, so there are at most
    log2(nodes) rounds. The forest is written round by round to ``path`` (or
    the shared folder); every round's tables are written too, so lost
    executors cost one round. Heavy nodes are looked for once a round. Labels
    are put together at the end, from the last round to the first. An empty table gives empty results.
    """
    spark = edges.sparkSession
    path = path or new_path(spark, "forest")
    rows = F.count(F.lit(1))
    now, left = counted(edges.select("a", "b", F.col("a").alias("u"), F.col("b").alias("v")), "edges", n=rows)
    steps: list[DataFrame] = []
    while left["n"]:
        hot = _hot(now)
        both = now.select("u", "v", "a", "b").unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v"), "a", "b"))
        taken = both.groupBy("u").agg(F.min(F.struct("a", "b", "v")).alias("m")).select("u", "m.v", "m.a", "m.b")
        # An edge is taken by one of its two components or by both; then the smaller one is the root.
        hook = taken.groupBy("a", "b").agg(F.min("u").alias("lo"), F.max("u").alias("hi"), F.max("v").alias("v"))
        twice = F.col("lo") != F.col("hi")
        hook.select("a", "b", F.when(twice, F.col("hi")).otherwise(F.col("lo")).alias("node"), F.when(twice, F.col("lo")).otherwise(F.col("v")).alias("root")).write.parquet(f"{path}/round={len(steps)}")
        step = _roots(spark.read.schema("a bigint, b bigint, node bigint, root bigint").parquet(f"{path}/round={len(steps)}").select("node", "root"), hot)
        steps.append(step)
        near = skew_join(now, step.select(F.col("node").alias("u"), F.col("root").alias("ru")), "u", "left", hot["u"]).select("v", "a", "b", F.coalesce("ru", "u").alias("u"))
        near = skew_join(near, step.select(F.col("node").alias("v"), F.col("root").alias("rv")), "v", "left", hot["v"]).select("u", "a", "b", F.coalesce("rv", "v").alias("v"))
        near = near.where("u <> v").groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.min(F.struct("a", "b")).alias("m")).select("m.a", "m.b", "u", "v")
        now, left = counted(near, "edges", n=rows)
    if not steps:
        return spark.createDataFrame([], "node bigint, root bigint"), spark.createDataFrame([], "a bigint, b bigint")
    # A round's nodes point to roots of that round, which may be nodes of a later one.
    labels = steps.pop()
    while steps:
        moved = skew_join(steps.pop(), labels.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        labels = persisted(moved.unionAll(labels), "labels")
    labels = labels.unionAll(labels.select(F.col("root").alias("node"), "root").distinct())
    return labels, spark.read.schema("a bigint, b bigint").parquet(path).select("a", "b")


def _hot(edges: DataFrame) -> dict[str, list]:
    """Nodes at very many edges' ends u and v, and as either."""
    n = HOT_PER_PARTITION * partitions(edges.sparkSession)
    total, counts = heavy(edges.select("u", "v"), ["u", "v"])
    out = {c: sorted(k for k, x in found.items() if x * n > max(total, n)) for c, found in zip("uv", counts)}
    return {**out, "either": sorted({*out["u"], *out["v"]})}


def _roots(step: DataFrame, hot: dict[str, list]) -> DataFrame:
    """Follows (node, root) to the end by doubling; a node that has no row of its own is a root.

    A row is done when its root is one; only the others are followed further.
    Many rows can point to a node at first only if it has many edges.
    """
    up = step.select(F.col("node").alias("root"), F.col("root").alias("to"))
    # Where "to" is null the root has no row; else the row now points to its root's root, which may be an end or not.
    first = skew_join(step, up, "root", "left", hot["either"]).select("node", F.coalesce("to", "root").alias("root"), F.col("to").isNull().alias("done"))
    step, left = counted(first, "steps", n=F.count_if(~F.col("done")))
    while left["n"]:
        up = step.select(F.col("node").alias("root"), F.col("root").alias("to"), F.col("done").alias("end"))
        # A node without a row is an end; one whose row is done points to it.
        open_ = skew_join(step.where("not done").drop("done"), up, "root", "left").select("node", F.coalesce("to", "root").alias("root"), F.coalesce("end", F.lit(True)).alias("done"))
        step, left = counted(step.where("done").unionByName(open_), "steps", n=F.count_if(~F.col("done")))
    return step.select("node", "root")


def deal(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """A split for each node: ``node, root, size, split``; all nodes of a root share it.

    Roots are ordered by size band (powers of two, largest first) and, within
    a band, by a hash, and dealt systematically: of each ten consecutive
    roots the fifth goes to test, the tenth to validation, the others to train.
    """
    named = persisted(nodes.select("node").distinct().join(labels, "node", "left").select("node", F.coalesce("root", "node").alias("root")), "named")
    sizes = named.groupBy("root").agg(F.count("*").alias("size")).withColumn("band", F.floor(F.log2("size")).cast("int"))
    ranked = global_rank(sizes, [F.desc("band"), F.xxhash64("root"), F.col("root")])
    at, low = F.col("rank"), F.lit(0.0)
    parts = dict(SHARES)
    turn = lambda share, shift: F.floor((at + 1) * share + shift) > F.floor(at * share + shift)
    split = F.when(turn(parts["validation"], 1e-9), "validation").when(turn(parts["test"], 0.5 + 1e-9), "test").otherwise("train")
    dealt = persisted(ranked.select("root", "size", split.alias("split")), "dealt")
    return skew_join(named, dealt, "root").select("node", "root", "size", "split")


def torn(current: DataFrame, labels: DataFrame) -> DataFrame:
    """Nodes of ``current`` (node, split) whose group has more than one split: ``node``. Rows without node or split are left out."""
    named = current.where("node is not null and split is not null").distinct().join(labels, "node", "left").select("node", "split", F.coalesce("root", "node").alias("root"))
    named = persisted(named, "named")
    bad = named.groupBy("root").agg(F.min("split").alias("x"), F.max("split").alias("y")).where("x <> y").select("root")
    return skew_join(named, bad, "root", "left_semi").select("node").distinct()


def person_labels(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Groups of persons that share a location or a record number, over all rows of person."""
    p = table(spark, sf_dir, "person")
    place = F.when(F.col("location_id") != 0, F.concat(F.lit("L"), F.col("location_id").cast("string")))
    number = F.concat(F.lit("R"), record_number("person_source_value"))
    members = p.select(F.col("person_id").cast("bigint").alias("node"), F.explode(F.array(place, number)).alias("key"))
    return spanning_forest(group_edges(members))


def _current(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "patient_splits").select(F.col("person_id").alias("node"), split_name().alias("split"))


def p5_found(spark, sf_dir: str) -> DataFrame:
    labels, _ = person_labels(spark, sf_dir)
    return torn(_current(spark, sf_dir), labels).select(F.col("node").alias("person_id"))


def p5_splits(spark, sf_dir: str) -> DataFrame:
    """The new split of every person of patient_splits."""
    labels, _ = person_labels(spark, sf_dir)
    nodes = _current(spark, sf_dir).where("node is not null")
    return deal(nodes, labels).select(F.col("node").alias("person_id"), F.col("root").alias("group_id"), "size", "split")


def p5_checked(spark, sf_dir: str) -> DataFrame:
    """One row on the new splits: persons, groups in more than one split, and whether each share is met up to one group of the greatest size in each band."""
    s = persisted(p5_splits(spark, sf_dir), "splits")
    torn_ = s.groupBy("group_id").agg(F.count_distinct("split").alias("k")).agg(F.count_if(F.col("k") > 1).alias("n_torn"))
    n, most = F.count("*"), F.max("size")
    bands = F.floor(F.log2(most)) + 1
    near = F.lit(True)
    for name, share in SHARES:
        near = near & (F.abs(F.count_if(F.col("split") == name) - n * share) <= 2 * bands * most + 1)
    return s.agg(n.alias("n_persons"), near.alias("near")).join(F.broadcast(torn_), F.lit(True))


def p5_shares(spark, sf_dir: str) -> DataFrame:
    """Persons and groups of each new split."""
    s = p5_splits(spark, sf_dir)
    return s.groupBy("split").agg(F.count("*").alias("n_persons"), F.count_distinct("group_id").alias("n_groups"))


def p5_groups(spark, sf_dir: str) -> DataFrame:
    """Sizes of the groups among all persons of person: how many groups of each size above one."""
    labels, _ = person_labels(spark, sf_dir)
    return labels.groupBy("root").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n_groups"))


_GROUPS = r"""
WITH RECURSIVE m AS (
  SELECT DISTINCT person_id AS p, 'L' || location_id AS k FROM person WHERE location_id <> 0 AND person_id IS NOT NULL
  UNION SELECT DISTINCT person_id, 'R' || upper(regexp_replace(person_source_value, '[^\p{L}]', '', 'g')) || '|' || ltrim(regexp_replace(person_source_value, '[^0-9]', '', 'g'), '0')
  FROM person WHERE person_id IS NOT NULL AND ltrim(regexp_replace(person_source_value, '[^0-9]', '', 'g'), '0') <> ''),
e AS (SELECT DISTINCT a.p AS a, b.p AS b FROM m a JOIN m b USING (k) WHERE a.p <> b.p),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
g AS (SELECT a AS p, least(a, min(b)) AS root FROM r GROUP BY a)
"""
SQL = {
    "p5_found": _GROUPS + """,
s AS (SELECT DISTINCT person_id, CASE WHEN x IN ('val', 'valid') THEN 'validation' ELSE x END AS split FROM
  (SELECT person_id, lower(trim(split, ' ' || chr(9) || chr(10) || chr(13))) AS x FROM patient_splits) WHERE x IN ('train', 'validation', 'val', 'valid', 'test') AND person_id IS NOT NULL),
n AS (SELECT s.*, coalesce(root, person_id) AS root FROM s LEFT JOIN g ON p = person_id),
t AS (SELECT root FROM n GROUP BY 1 HAVING count(DISTINCT split) > 1)
SELECT DISTINCT person_id FROM n WHERE root IN (SELECT root FROM t)""",
    "p5_groups": _GROUPS + ", z AS (SELECT root, count(*) AS size FROM g GROUP BY 1) SELECT size, count(*) AS n_groups FROM z GROUP BY 1",
}
SQL["p5_checked"] = "SELECT count(DISTINCT person_id) AS n_persons, true AS near, 0 AS n_torn FROM patient_splits"
QUERIES = {"p5_checked": p5_checked, "p5_found": p5_found, "p5_splits": p5_splits, "p5_shares": p5_shares, "p5_groups": p5_groups}
