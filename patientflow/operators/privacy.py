"""Privacy risk of synthetic cohorts: nearest neighbours, membership and attribute inference, re-identification."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import tokens as tk
from ..functions.neighbours import TOKENS, Nearest, Rows, joined
from ..functions.tokens import sequences
from ..plans.registry import Registry
from ..plans.runtime import partitions, persisted, table
from ..plans.skew import salted_join
from .sequences import clinical_set, demographics, members, partition_set

MEMBER_THRESHOLD = 5.0
#: Rows of the target, and of the source, that a task holds at once; rows that a share of sets has at least.
BLOCK, SOURCE_ROWS, LEAST_ROWS = 2_000, 20_000, 1_000
#: Bytes of the target shares that one task meets.
GROUP_BYTES = 32 << 20


def vectors(seqs: DataFrame, key: str, c: str) -> DataFrame:
    """``id, age, gender, race, concepts``: the age scaled by the data set's greatest, rows without a readable age left out, one row per key."""
    one = seqs.where(F.size(c) > 4).groupBy(F.col(key).alias("id")).agg(F.max(c).alias("t"))
    rows = one.select("id", *demographics(F.col("t")), clinical_set(F.col("t")).alias("concepts")).where("age >= 0")
    top = rows.agg(F.max("age")).first()[0] or 1
    return rows.select("id", (F.col("age") / F.lit(float(top or 1))).alias("age"), F.coalesce("gender", F.lit("")).alias("gender"), F.coalesce("race", F.lit("")).alias("race"), "concepts")


def _numbered(a: pa.Array, tag: str, words: list[str]) -> np.ndarray:
    """Each value's number; ``words`` gets the distinct ones, with the tag before them."""
    d = a.dictionary_encode(null_encoding="encode")
    words += [f"{tag}{w!r}" for w in d.dictionary.to_pylist()]
    return d.indices.to_numpy().astype(np.int64) + len(words) - len(d.dictionary)


_BLOB = pa.schema([("id", pa.int64()), ("age", pa.float64()), ("size", pa.int32()), ("code", pa.binary())])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a partition as one: ids, ages and sets of numbers, with what the numbers stand for. Gender and race are items like concepts: two that differ are two more items that only one side has."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    words: list[str] = []
    lists = t.column("concepts")
    n = lists.value_lengths().fill_null(0).to_numpy()
    row = np.arange(t.num_rows)
    code = np.concatenate([_numbered(lists.flatten(), "c", words), _numbered(t.column("gender"), "g", words), _numbered(t.column("race"), "r", words)])
    key = np.unique(np.concatenate([np.repeat(row, n), row, row]) * len(words) + code)
    size = np.bincount(key // len(words), minlength=t.num_rows).astype(np.int32)
    parts = [t.column("id").to_numpy(), t.column("age").to_numpy(zero_copy_only=False).astype(float), size, (key % len(words)).astype(np.int32)]
    data = [pa.compress(x.tobytes(), codec="zstd", asbytes=True) for x in parts]
    yield pa.RecordBatch.from_arrays([pa.array([int(t.column("place")[0].as_py())], pa.int32()), pa.array([t.num_rows]), pa.array([len(key)]), *[pa.array([x], pa.binary()) for x in data], pa.array([words], pa.list_(pa.string()))], PACKED)


PACKED = ["place", "n", "items", "ids", "ages", "sizes", "codes", "words"]


def packed(rows: DataFrame) -> DataFrame:
    """Rows of ``id, age, gender, race, concepts`` in shares by the hash of the id, each written as one row of small arrays; what is packed already stays as it is."""
    if rows.columns == PACKED:
        return rows
    n = rows.count()
    places = max(1, min(partitions(rows.sparkSession), -(-n // LEAST_ROWS)), -(-n // SOURCE_ROWS))
    r = rows.select(F.pmod(F.xxhash64(F.col("id").cast("bigint")), F.lit(places)).cast("int").alias("place"), F.col("id").cast("bigint").alias("id"), F.col("age").cast("double").alias("age"), "gender", "race", "concepts")
    kind = "place int, n bigint, items bigint, ids binary, ages binary, sizes binary, codes binary, words array<string>"
    return persisted(r.repartitionById(places, "place").mapInArrow(_pack, kind), "packed")


def _unpacked(r: dict, words: dict[str, int], side: str) -> Rows:
    """A share's rows; ``words`` gets the items that it lacks, and numbers stand for its items."""
    raw = lambda c, kind, n: np.frombuffer(pa.decompress(r[side + c], n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind)
    n, items = r[side + "n"], r[side + "items"]
    number = np.array([words.setdefault(w, len(words)) for w in r[side + "words"]], np.int64)
    return Rows(raw("ids", np.int64, n), raw("ages", np.float64, n), np.concatenate([[0], np.cumsum(raw("sizes", np.int32, n), dtype=np.int64)]), number[raw("codes", np.int32, items)])


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Iterator[pa.RecordBatch]]]:
    """Rows sorted by (place, side) as each place's source rows (side 0) and its target rows (side 1) in blocks."""
    runs = ((key, b.slice(i, j - i)) for b in batches if b.num_rows for key, i, j in _runs(b))
    key, held = None, []
    for place, group in groupby(runs, lambda x: x[0][0]):
        key, held = None, []
        blocks = groupby(group, lambda x: x[0][1])
        key, first = next(blocks)
        held = [b for _, b in first]
        if key:  # no source row is here
            continue
        rest = next(blocks, None)
        if rest is None:
            continue
        source = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        yield source, (part for _, b in rest[1] for part in _sliced(b))


def _runs(b: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], int, int]]:
    place, side = b.column(0).to_numpy(), b.column(1).to_numpy()
    cut = [0, *(np.flatnonzero((np.diff(place) != 0) | (np.diff(side) != 0)) + 1).tolist(), len(place)]
    return (((int(place[i]), int(side[i])), i, j) for i, j in zip(cut[:-1], cut[1:]))


def _sliced(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    return (b.slice(i, BLOCK) for i in range(0, b.num_rows, BLOCK))


def _nearest(batches: Iterator[pa.RecordBatch], other: bool) -> Iterator[pa.RecordBatch]:
    """Pairs of a source share and a target share; small target shares are put together before they are looked through."""
    found: dict[int, tuple[Nearest, dict[str, int], list[Rows]]] = {}
    for b in batches:
        for i in range(b.num_rows):
            r = b.slice(i, 1).to_pylist()[0]
            if r["place"] not in found:
                words: dict[str, int] = {}
                found[r["place"]] = Nearest(_unpacked(r, words, ""), other), words, []
            best, words, waiting = found[r["place"]]
            waiting.append(_unpacked(r, words, "t_"))
            if sum(len(x.code) for x in waiting) >= 2 * TOKENS:
                best.add(joined(waiting), len(words))
                waiting.clear()
    for place, (best, words, waiting) in found.items():
        if waiting:
            best.add(joined(waiting), len(words))
        i = np.flatnonzero(best.dist < np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), place, np.int32)), pa.array(i), pa.array(best.source.id[i]), pa.array(best.dist[i]), pa.array(best.match[i])], ["place", "row", "id", "dist", "match_id"])


def against(source: DataFrame, target: DataFrame) -> DataFrame:
    """Source and target rows of the same columns, brought together for a comparison of all source rows with all target rows: ``place, side, ...`` sorted.

    A place holds at most about SOURCE_ROWS source rows (side 0) and then sees
    the whole target (side 1), block by block: the target is sent once for each place, no pairs are.
    """
    n = partitions(source.sparkSession)
    places = max(n, -(-source.count() // SOURCE_ROWS))
    left = source.select(F.pmod(F.xxhash64("id"), F.lit(places)).cast("int").alias("place"), F.lit(0).alias("side"), *source.columns)
    right = target.select(F.explode(F.sequence(F.lit(0), F.lit(places - 1))).alias("place"), F.lit(1).alias("side"), *source.columns)
    return left.unionByName(right).repartitionById(n, F.col("place") % n).sortWithinPartitions("place", "side")


def nearest(source: DataFrame, target: DataFrame, other: bool = False) -> DataFrame:
    """``id, dist, match_id``: squared distance to the nearest target row, ties to the least id.

    ``other`` leaves out the row of the same id (a table against itself). An
    empty target gives no rows. Both may be :func:`packed`. Each source share meets all target shares, which
    are read again for it and never copied; bounds leave out pairs that cannot be nearest, see :class:`Nearest`.
    """
    a = packed(source)
    b = a if target is source else packed(target)
    places = (a.agg(F.max("place")).first()[0] or 0) + 1
    groups = -(-(b.agg(F.sum(sum(F.octet_length(c) for c in ("ids", "ages", "sizes", "codes")))).first()[0] or 1) // GROUP_BYTES)
    right = b.select(*[F.col(c).alias(f"t_{c}") for c in PACKED]).repartition(groups)
    pairs = a.repartitionById(places, "place").join(right.hint("shuffle_replicate_nl"))
    found = pairs.mapInArrow(lambda it: _nearest(it, other), "place int, row bigint, id bigint, dist double, match_id bigint")
    if groups > 1:
        found = found.groupBy("place", "row", "id").agg(F.min(F.struct("dist", "match_id")).alias("m")).select("id", "m.*")
    return found.select("id", "dist", "match_id")


def membership(train_dist: DataFrame, evaluation_dist: DataFrame, threshold: float = MEMBER_THRESHOLD) -> DataFrame:
    """Accuracy, precision, recall and F1 of calling a distance below the threshold a member."""
    rows = train_dist.select("dist", F.lit(1).alias("label")).unionByName(evaluation_dist.select("dist", F.lit(0).alias("label")))
    return classification_metrics(rows.select((F.col("dist") < threshold).cast("int").alias("pred"), "label"))


def classification_metrics(rows: DataFrame) -> DataFrame:
    """``accuracy, precision, recall, f1`` of (pred, label) in 0 and 1; a quotient by zero is 0."""
    both, pred, label = F.sum(F.col("pred") * F.col("label")), F.sum("pred"), F.sum("label")
    agg = rows.agg(both.alias("tp"), pred.alias("p"), label.alias("l"), F.count("*").alias("n"), F.sum((F.col("pred") == F.col("label")).cast("int")).alias("ok"))
    part = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return agg.select(part("ok", "n").alias("accuracy"), part("tp", "p").alias("precision"), part("tp", "l").alias("recall"), F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("p") + F.col("l")), F.lit(0.0)).alias("f1"))


def adversarial_accuracy(real: DataFrame, synthetic: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """One row ``aa``: how often the nearest row of the other set is farther than the nearest of the own set. ``own``: ``nearest(synthetic, synthetic, other=True)``, if it is there already."""

    def share(a: DataFrame, b: DataFrame, within: DataFrame) -> DataFrame:
        j = nearest(a, b).join(within.select("id", F.col("dist").alias("own")), "id", "left")
        return j.agg(F.avg((F.col("dist") > F.coalesce("own", F.lit(0.0))).cast("int")).alias("share"))

    a, b = packed(real), packed(synthetic)
    return share(a, b, nearest(a, a, other=True)).unionAll(share(b, a, nearest(b, b, other=True) if own is None else own)).agg(F.avg("share").alias("aa"))


def set_overlap(known: Column, guessed: Column) -> list[Column]:
    """precision, recall and F1 of a guessed set; a quotient by zero is 0."""
    both, a, b = F.size(F.array_intersect(known, guessed)), F.size(known), F.size(guessed)
    part = lambda x, y: F.coalesce(F.try_divide(x.cast("double"), y), F.lit(0.0))
    return [part(both, b).alias("precision"), part(both, a).alias("recall"), part(2 * both, a + b).alias("f1")]


def attribute_inference(real: DataFrame, synthetic: DataFrame, common: Column | list[str], sensitive: Column | list[str] | None = None) -> DataFrame:
    """``id, match_id, precision, recall, f1``: sensitive concepts of each real row guessed from its nearest synthetic row by common ones.

    ``common`` and ``sensitive`` are lists of concepts; without the second all others are sensitive.
    Precision divides by the matched row's set.
    """
    cut = lambda d: d.withColumn("concepts", members(F.col("concepts"), common))
    near = nearest(cut(real), cut(synthetic))
    a = real.select("id", partition_set(F.col("concepts"), common, sensitive)[1].alias("known"))
    b = synthetic.select(F.col("id").alias("match_id"), partition_set(F.col("concepts"), common, sensitive)[1].alias("guessed"))
    return near.join(a, "id").join(b, "match_id").select("id", "match_id", *set_overlap(F.col("known"), F.col("guessed")))


# Levels of each attribute (age, gender, race, seven groups of common attributes; 0 is the most general one) and thresholds.
MAX_LEVELS = [1, 0, 0] + [1] * 7
GROUPS = len(MAX_LEVELS) - 3
AGE_BASES = {0: 10, 1: 1}
SENSITIVE_MATCHES, LAMBDA = 17, 0.23
#: Share of the real rows from which a sensitive concept counts as known.
WIDESPREAD = 0.5


def lattice(levels: list[int] = MAX_LEVELS) -> list[tuple[int, ...]]:
    """All nodes of the generalization lattice but the bottom one, level by level: small and of fixed size."""
    nodes = sorted(product(*[range(n + 1) for n in levels]), key=lambda x: (sum(x), x))
    return nodes[1:]


QUASI = ["age", "gender", "race", "common"]


def _nodes() -> Column:
    """The nodes of the lattice as an array of ``node, base, keep``: its levels as a text, the age's base, 1 for each group of common attributes that stays."""
    return F.array(*[F.struct(F.lit("".join(map(str, x))).alias("node"), F.lit(AGE_BASES[x[0]]).alias("base"), F.array(*map(F.lit, x[3:])).alias("keep")) for x in lattice()])


def at_node(rows: DataFrame, k: str) -> DataFrame:
    """``node`` and the rows with ``age, common`` generalized as the node in column k says; ``groups`` are the texts of the groups of common attributes."""
    common = F.array_join(F.zip_with("groups", f"{k}.keep", lambda g, keep: F.when(keep == 1, g).otherwise("*")), "|")
    return rows.withColumn("node", F.col(f"{k}.node")).withColumn("age", F.ceil(F.col("age") / F.col(f"{k}.base"))).withColumn("common", common).drop("groups", k)


def lattice_sizes(rows: DataFrame) -> DataFrame:
    """``node, age, gender, race, common, n``: sizes of the classes of every node, from the distinct rows, one expansion over all sets of groups and one aggregate."""
    names = [f"g{i}" for i in range(GROUPS)]
    keys = ["age", "gender", "race", "groups"]
    # Each distinct row becomes 256, so they are spread by number and not by their size.
    ages = F.explode(F.array(*[F.struct(F.lit(level).alias("level"), F.ceil(F.col("age") / base).alias("age")) for level, base in AGE_BASES.items()]))
    x = class_sizes(rows, keys).repartition(partitions(rows.sparkSession), F.xxhash64(*keys)).select(ages.alias("a"), "gender", "race", *[F.col("groups")[i].alias(g) for i, g in enumerate(names)], "n")
    x = x.select("a.level", "a.age", "gender", "race", *names, "n")
    kept = ", ".join(f"1 - grouping({g})" for g in names)
    common = ", ".join(f"if(grouping({g}) = 1, '*', {g})" for g in names)
    text = f"""SELECT concat(level, '00', {kept}) AS node, age, gender, race, concat_ws('|', {common}) AS common, sum(n) AS n
    FROM {{x}} GROUP BY level, age, gender, race, CUBE ({", ".join(names)})"""
    return rows.sparkSession.sql(text, x=x).where(F.col("node").contains("1"))  # all but the bottom one


def quasi_identifiers(rows: DataFrame, age_base: int) -> DataFrame:
    """``age, gender, race, common`` with the age divided by its base and rounded up and all common attributes."""
    return rows.withColumn("age", F.ceil(F.col("age") / age_base)).withColumn("common", F.array_join("groups", "|")).drop("groups")


def class_sizes(rows: DataFrame, keys: list[str] = QUASI) -> DataFrame:
    """``keys, n``: sizes of equivalence classes; one aggregate with map-side combine."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def reid_risk(sample: DataFrame, population: DataFrame, synthetic: DataFrame, least: int = SENSITIVE_MATCHES, lam: float = LAMBDA) -> DataFrame:
    """``node, a_term, b_term``: the two risks of re-identification at every node of the lattice.

    All three tables have ``id, age, gender, race, groups, sensitive``. A sample row
    learns something new if a synthetic row of its class shares more than
    ``least`` sensitive concepts (both have at least ``least``). Its class sizes
    in sample and population weigh it. Null attributes match nothing. Concepts
    that half of the sample has are no news and left out of its sensitive ones.

    Pairs are compared once, in the classes of the most general node: what they differ in tells the nodes
    where they share a class. Skewed classes are left to the adaptive join; only distinct differences per row go on.
    """
    enough = F.size("sensitive") >= least
    known = _array(majority(sample.select(F.col("sensitive").alias("concepts")), WIDESPREAD))
    # Bases divide each other, so rows of one class at any node share the widest age.
    wide = F.ceil(F.col("age") / max(AGE_BASES.values())).alias("wide")
    left = sample.withColumn("sensitive", F.array_except("sensitive", known)).where(enough).select("id", "age", wide, "gender", "race", "groups", "sensitive")
    right = synthetic.where(enough).select(F.col("age").alias("age2"), wide, "gender", "race", F.col("groups").alias("groups2"), F.col("sensitive").alias("other"))
    pairs = left.join(right, ["wide", "gender", "race"]).where(F.size(F.array_intersect("sensitive", "other")) > least)
    differ = F.zip_with("groups", "groups2", lambda a, b: (a != b).cast("int"))
    found = pairs.select("id", (F.col("age") == F.col("age2")).alias("exact"), differ.alias("differ")).distinct()
    same = F.filter(_nodes(), lambda k: (F.col("exact") | (k["base"] > 1)) & ~F.exists(F.zip_with(k["keep"], F.col("differ"), lambda a, b: a * b), lambda x: x == 1))
    new = found.select("id", F.explode(same).alias("k")).distinct()
    j = at_node(new.join(sample.select("id", "age", "gender", "race", "groups"), "id"), "k")
    keys = ["node", *QUASI]
    j = j.join(lattice_sizes(sample).withColumnRenamed("n", "f"), keys).join(lattice_sizes(population).withColumnRenamed("n", "F_"), keys)
    n, big = sample.count(), population.count()
    w = (1 + lam) / 2
    sums = j.groupBy("node").agg(F.sum(F.lit(w) / F.col("f")).alias("a"), F.sum(F.lit(w) / F.col("F_")).alias("b"))
    every = sample.sparkSession.range(1).select(F.explode(_nodes()).alias("k")).select("k.node")
    return every.join(sums, "node", "left").select("node", (F.coalesce("a", F.lit(0.0)) / F.lit(float(big or 1))).alias("a_term"), (F.coalesce("b", F.lit(0.0)) / F.lit(float(n or 1))).alias("b_term"))


R = Registry()


def _cohorts(spark, sf_dir: str) -> dict[str, DataFrame]:
    """Train, evaluation and synthetic stand-ins: persons with a sequence, in three disjoint parts by hash."""
    from .splits import uniform

    v = persisted(vectors(sequences(spark, sf_dir), "person_id", "t"), "vectors").withColumn("u", uniform("id", seed=11))
    return {"train": v.where("u < 0.4").drop("u"), "evaluation": v.where("u >= 0.4 and u < 0.6").drop("u"), "synthetic": v.where("u >= 0.6").drop("u"), "all": v.drop("u")}


_V = tk.SEQUENCES_SQL + """, o AS (SELECT person_id AS id, max(t) AS t FROM s WHERE len(t) > 4 GROUP BY 1),
d AS (SELECT id, coalesce(TRY_CAST(substr(t[2], 5) AS INT), -1) AS a, t[3] AS gender, t[4] AS race, list_distinct([x FOR x IN t[5:] IF regexp_matches(x, '^[0-9]+$')]) AS c FROM o),
v AS (SELECT id, a / max(a) OVER ()::DOUBLE AS age, gender, race, c, (('0x' || substr(md5(concat_ws('|', id::VARCHAR, '11')), 1, 12))::BIGINT + 0.5) / 281474976710656.0 AS u FROM d WHERE a >= 0),
tr AS (SELECT * FROM v WHERE u < 0.4), ev AS (SELECT * FROM v WHERE u >= 0.4 AND u < 0.6), sy AS (SELECT * FROM v WHERE u >= 0.6)"""


def _pairs(a: str, b: str, name: str, same: bool = False) -> str:
    return f""", {name} AS (SELECT x.id, min(round((x.age - y.age) ** 2 + 2 * (x.gender <> y.gender)::INT + 2 * (x.race <> y.race)::INT + len(x.c) + len(y.c) - 2 * len(list_intersect(x.c, y.c)), 9)) AS dist FROM {a} x, {b} y {'WHERE x.id <> y.id' if same else ''} GROUP BY x.id)"""


@R.query("nn_distance", _V + _pairs("ev", "sy", "n") + " SELECT * FROM n")
def nn_distance(spark, sf_dir: str) -> DataFrame:
    """Distance of each evaluation person to the nearest synthetic one."""
    c = _cohorts(spark, sf_dir)
    return nearest(c["evaluation"], c["synthetic"]).select("id", "dist")


@R.query("nn_self_distance", _V + _pairs("v", "v", "n", True) + " SELECT * FROM n")
def nn_self_distance(spark, sf_dir: str) -> DataFrame:
    c = _cohorts(spark, sf_dir)
    return nearest(c["all"], c["all"], other=True).select("id", "dist")


@R.query("membership_metrics", _V + _pairs("sy", "tr", "a") + _pairs("sy", "ev", "b") + """, r AS (SELECT (dist < 5)::INT AS p, 1 AS l FROM a UNION ALL SELECT (dist < 5)::INT, 0 FROM b), g AS (SELECT sum(p * l) AS tp, sum(p) AS p, sum(l) AS l, count(*) AS n, sum((p = l)::INT) AS ok FROM r)
SELECT ok / n AS accuracy, coalesce(tp / nullif(p, 0), 0) AS precision, coalesce(tp / nullif(l, 0), 0) AS recall, coalesce(2 * tp / nullif(p + l, 0), 0) AS f1 FROM g""")
def membership_metrics(spark, sf_dir: str) -> DataFrame:
    c = _cohorts(spark, sf_dir)
    return membership(nearest(c["synthetic"], c["train"]), nearest(c["synthetic"], c["evaluation"]))


@R.query("nnaa_privacy_loss", _V + _pairs("tr", "sy", "ts") + _pairs("sy", "tr", "st") + _pairs("tr", "tr", "tt", True) + _pairs("sy", "sy", "ss", True) + _pairs("ev", "sy", "es") + _pairs("sy", "ev", "se") + _pairs("ev", "ev", "ee", True) + """,
x AS (SELECT ((SELECT avg((ts.dist > tt.dist)::INT) FROM ts JOIN tt USING (id)) + (SELECT avg((st.dist > ss.dist)::INT) FROM st JOIN ss USING (id))) / 2 AS aa_train, ((SELECT avg((es.dist > ee.dist)::INT) FROM es JOIN ee USING (id)) + (SELECT avg((se.dist > ss.dist)::INT) FROM se JOIN ss USING (id))) / 2 AS aa_test)
SELECT aa_train, aa_test, aa_test - aa_train AS privacy_loss FROM x""")
def nnaa_privacy_loss(spark, sf_dir: str) -> DataFrame:
    """Adversarial accuracy against train and evaluation, and their difference."""
    c = _cohorts(spark, sf_dir)
    made = packed(c["synthetic"])
    own = persisted(nearest(made, made, other=True), "own")  # both accuracies need it
    a = adversarial_accuracy(c["train"], made, own).select(F.lit(0).alias("k"), F.col("aa").alias("aa_train"))
    b = adversarial_accuracy(c["evaluation"], made, own).select(F.lit(0).alias("k"), F.col("aa").alias("aa_test"))
    return a.join(b, "k").select("aa_train", "aa_test", (F.col("aa_test") - F.col("aa_train")).alias("privacy_loss"))


def _array(concepts: list[str]) -> Column:
    return F.array(*[F.lit(x) for x in concepts]).cast("array<string>")


#: Share of the persons from which a concept counts as one of the common attributes of these tables.
COMMON = 0.2


def prevalence(rows: DataFrame) -> DataFrame:
    """``concept_id, n, prevalence, is_majority``: the share of the rows that have each concept, and whether half of them do."""
    total = rows.agg(F.count("*").alias("total"))
    n = rows.select(F.explode(F.array_distinct("concepts")).alias("concept_id")).groupBy("concept_id").agg(F.count("*").alias("n"))
    share = F.col("n") / F.col("total")
    return n.join(F.broadcast(total), F.lit(True)).select("concept_id", "n", share.alias("prevalence"), (share >= WIDESPREAD).alias("is_majority"))


def majority(rows: DataFrame, share: float = COMMON) -> list[str]:
    """Concepts in at least ``share`` of the rows: at most mean set size / share of them."""
    n = rows.count()
    return sorted(r[0] for r in rows.select(F.explode("concepts").alias("c")).groupBy("c").count().where(F.col("count") >= share * n).select("c").collect())


_COMMON = ", k AS (SELECT x FROM (SELECT unnest(c) AS x FROM v) GROUP BY x HAVING count(*) >= 0.2 * (SELECT count(*) FROM v))"


@R.query("majority_attributes", _V + f", k AS (SELECT unnest(c) AS concept_id FROM v), n AS (SELECT concept_id, count(*) AS n, count(*) / (SELECT count(*) FROM v) AS prevalence FROM k GROUP BY 1) SELECT *, prevalence >= {WIDESPREAD} AS is_majority FROM n")
def majority_attributes(spark, sf_dir: str) -> DataFrame:
    """The share of the persons that have each concept, and whether half of them do."""
    return prevalence(_cohorts(spark, sf_dir)["all"])


@R.query("attribute_inference_f1", _V + _COMMON + """, kl AS (SELECT list(x) AS l FROM k), w AS (SELECT id, age, gender, race, u, list_intersect(c, l) AS c, [q FOR q IN c IF NOT list_contains(l, q)] AS z FROM v, kl),
m AS (SELECT a.id, arg_min(b.id, (round((a.age - b.age) ** 2 + 2 * (a.gender <> b.gender)::INT + 2 * (a.race <> b.race)::INT + len(a.c) + len(b.c) - 2 * len(list_intersect(a.c, b.c)), 9), b.id)) AS match_id FROM w a, w b WHERE a.u < 0.4 AND b.u >= 0.6 GROUP BY a.id),
ov AS (SELECT m.id, m.match_id, len(list_intersect(a.z, b.z)) AS i, len(a.z) AS na, len(b.z) AS nb FROM m JOIN w a ON a.id = m.id JOIN w b ON b.id = m.match_id)
SELECT id, match_id, coalesce(i / nullif(nb, 0), 0) AS precision, coalesce(i / nullif(na, 0), 0) AS recall, coalesce(2 * i / nullif(na + nb, 0), 0) AS f1 FROM ov""")
def attribute_inference_f1(spark, sf_dir: str) -> DataFrame:
    """Sensitive concepts of train persons guessed from the nearest synthetic person."""
    c = _cohorts(spark, sf_dir)
    return attribute_inference(c["train"], c["synthetic"], majority(c["all"]))


_DOMAIN = "(SELECT list(DISTINCT concept_id::VARCHAR) AS l FROM concept WHERE domain_id = '{}' AND concept_id IS NOT NULL)"


@R.query("attribute_inference_configured", _V + f""", kl AS {_DOMAIN.format("Condition")}, zl AS {_DOMAIN.format("Drug")}, w AS (SELECT id, age, gender, race, u, list_intersect(c, kl.l) AS c, list_intersect(c, zl.l) AS z FROM v, kl, zl),
m AS (SELECT a.id, arg_min(b.id, (round((a.age - b.age) ** 2 + 2 * (a.gender <> b.gender)::INT + 2 * (a.race <> b.race)::INT + len(a.c) + len(b.c) - 2 * len(list_intersect(a.c, b.c)), 9), b.id)) AS match_id FROM w a, w b WHERE a.u < 0.4 AND b.u >= 0.6 GROUP BY a.id),
ov AS (SELECT m.id, m.match_id, len(list_intersect(a.z, b.z)) AS i, len(a.z) AS na, len(b.z) AS nb FROM m JOIN w a ON a.id = m.id JOIN w b ON b.id = m.match_id)
SELECT id, match_id, coalesce(i / nullif(nb, 0), 0) AS precision, coalesce(i / nullif(na, 0), 0) AS recall, coalesce(2 * i / nullif(na + nb, 0), 0) AS f1 FROM ov""")
def attribute_inference_configured(spark, sf_dir: str) -> DataFrame:
    """As attribute_inference_f1, with two configured lists: conditions are known, drugs are guessed."""
    c = _cohorts(spark, sf_dir)
    k = table(spark, sf_dir, "concept").where("concept_id is not null")
    listed = lambda d: sorted(r[0] for r in k.where(F.col("domain_id") == d).select(F.col("concept_id").cast("string")).distinct().collect())
    return attribute_inference(c["train"], c["synthetic"], listed("Condition"), listed("Drug"))


def _reid(spark, sf_dir: str) -> dict[str, DataFrame]:
    """Sample, population and synthetic tables of the re-identification risk."""
    t = F.col("t")
    one = sequences(spark, sf_dir).where(F.size("t") > 4).groupBy(F.col("person_id").alias("id")).agg(F.max("t").alias("t"))
    rows = persisted(one.select("id", *demographics(t), clinical_set(t).alias("concepts")).where("age >= 0"), "reid")
    common = majority(rows)
    # Each group of common attributes is generalized as a whole; all of them are in one.
    groups = F.array(*[F.array_join(F.array_intersect(F.array_sort("concepts"), _array(common[i::GROUPS])), " ") for i in range(GROUPS)])
    rows = rows.select("id", "age", F.coalesce("gender", F.lit("")).alias("gender"), F.coalesce("race", F.lit("")).alias("race"), groups.alias("groups"), F.array_except("concepts", _array(common)).alias("sensitive"))
    from .splits import uniform

    rows = persisted(rows, "reid_rows").withColumn("u", uniform("id", seed=12))
    return {"all": rows, "population": rows.where("u < 0.6"), "sample": rows.where("u < 0.3"), "synthetic": rows.where("u >= 0.6")}


_REID = tk.SEQUENCES_SQL + f""", o AS (SELECT person_id AS id, max(t) AS t FROM s WHERE len(t) > 4 GROUP BY 1),
d AS (SELECT id, coalesce(TRY_CAST(substr(t[2], 5) AS INT), -1) AS age, coalesce(t[3], '') AS gender, coalesce(t[4], '') AS race, list_sort(list_distinct([x FOR x IN t[5:] IF regexp_matches(x, '^[0-9]+$')])) AS c FROM o),
e AS (SELECT *, (('0x' || substr(md5(concat_ws('|', id::VARCHAR, '12')), 1, 12))::BIGINT + 0.5) / 281474976710656.0 AS u FROM d WHERE age >= 0),
k AS (SELECT x, (row_number() OVER (ORDER BY x) - 1) % {GROUPS} AS g FROM (SELECT unnest(c) AS x FROM e) GROUP BY x HAVING count(*) >= 0.2 * (SELECT count(*) FROM e)),
kl AS (SELECT list(x) AS l, [{", ".join(f"coalesce(list(x) FILTER (g = {i}), [])" for i in range(GROUPS))}] AS gl FROM k),
q AS (SELECT id, u, age, gender, race, [array_to_string([x FOR x IN c IF list_contains(y, x)], ' ') FOR y IN gl] AS groups, [x FOR x IN c IF NOT list_contains(l, x)] AS z FROM e, kl),
nodes AS (SELECT lv || '00' || array_to_string(keep, '') AS node, CASE lv WHEN 0 THEN {AGE_BASES[0]} ELSE {AGE_BASES[1]} END AS base, keep FROM (SELECT unnest([0, 1]) AS lv), (SELECT [(m >> ({GROUPS - 1} - i)) & 1 FOR i IN range({GROUPS})] AS keep FROM range({1 << GROUPS}) r(m)) WHERE lv + list_sum(keep) > 0)"""
_AT_NODE = f"node, ceil(age / base::DOUBLE) AS age, gender, race, [CASE keep[i] WHEN 1 THEN groups[i] ELSE '*' END FOR i IN range(1, {GROUPS + 1})] AS common"


@R.query("equivalence_class_size", _REID + f", po AS (SELECT count(*) AS n FROM q GROUP BY ceil(age / {AGE_BASES[0]}::DOUBLE), gender, race, groups) SELECT n AS size, count(*) AS n_classes FROM po GROUP BY 1")
def equivalence_class_size(spark, sf_dir: str) -> DataFrame:
    """How many classes of persons have which size."""
    rows = quasi_identifiers(_reid(spark, sf_dir)["all"], AGE_BASES[0])
    return class_sizes(rows).groupBy(F.col("n").alias("size")).agg(F.count("*").alias("n_classes"))


@R.query("reid_risk", _REID + f""", kn AS (SELECT x FROM (SELECT unnest(z) AS x FROM q WHERE u < 0.3) GROUP BY x HAVING count(*) >= {WIDESPREAD} * (SELECT count(*) FROM q WHERE u < 0.3)), kz AS (SELECT coalesce(list(x), []) AS l FROM kn),
a AS (SELECT id, age, ceil(age / {AGE_BASES[0]}::DOUBLE) AS wide, gender, race, groups, [x FOR x IN z IF NOT list_contains(l, x)] AS z FROM q, kz WHERE u < 0.3),
b AS (SELECT age, ceil(age / {AGE_BASES[0]}::DOUBLE) AS wide, gender, race, groups, z FROM q WHERE u >= 0.6 AND len(z) >= {SENSITIVE_MATCHES}),
pr AS (SELECT DISTINCT a.id, a.age = b.age AS exact, [(a.groups[i] <> b.groups[i])::INT FOR i IN range(1, {GROUPS + 1})] AS differ FROM a JOIN b USING (wide, gender, race) WHERE len(a.z) >= {SENSITIVE_MATCHES} AND len(list_intersect(a.z, b.z)) > {SENSITIVE_MATCHES}),
nw AS (SELECT DISTINCT id, node FROM pr, nodes WHERE (exact OR base > 1) AND len([i FOR i IN range(1, {GROUPS + 1}) IF keep[i] = 1 AND differ[i] = 1]) = 0),
po AS (SELECT {_AT_NODE}, count(*) AS n FROM q, nodes WHERE u < 0.6 GROUP BY ALL), sn AS (SELECT id, {_AT_NODE} FROM q, nodes WHERE u < 0.3), sa AS (SELECT node, age, gender, race, common, count(*) AS n FROM sn GROUP BY ALL),
t AS (SELECT node, sum({(1 + LAMBDA) / 2} / sa.n) AS a, sum({(1 + LAMBDA) / 2} / po.n) AS b FROM nw JOIN sn USING (id, node) JOIN sa USING (node, age, gender, race, common) JOIN po USING (node, age, gender, race, common) GROUP BY 1)
SELECT node, coalesce(a, 0) / (SELECT count(*) FROM q WHERE u < 0.6) AS a_term, coalesce(b, 0) / (SELECT count(*) FROM q WHERE u < 0.3) AS b_term FROM nodes LEFT JOIN t USING (node)""")
def reid_risk_query(spark, sf_dir: str) -> DataFrame:
    """Risk at every node of the lattice, with the operator's own threshold."""
    c = _reid(spark, sf_dir)
    return reid_risk(c["sample"], c["population"], c["synthetic"])


@R.query("lattice_counts", _REID + f", b AS (SELECT {_AT_NODE}, count(*) AS n FROM q, nodes GROUP BY ALL) SELECT node, count(*) AS n_classes, min(n) AS smallest, sum((n = 1)::INT) AS n_unique FROM b GROUP BY 1")
def lattice_counts(spark, sf_dir: str) -> DataFrame:
    """Classes of every node of the lattice, all from one scan: the nodes are exploded into the grouping key."""
    g = lattice_sizes(_reid(spark, sf_dir)["all"])
    return g.groupBy("node").agg(F.count("*").alias("n_classes"), F.min("n").alias("smallest"), F.sum((F.col("n") == 1).cast("int")).alias("n_unique"))


@R.query("salted_join", "SELECT v.visit_concept_id, count(*) AS n FROM condition_occurrence c JOIN visit_occurrence v ON c.person_id = v.person_id GROUP BY 1")
def salted_join_query(spark, sf_dir: str) -> DataFrame:
    """Conditions and visits of the same person, by a salted join."""
    c = table(spark, sf_dir, "condition_occurrence").select("person_id", "condition_occurrence_id")
    v = table(spark, sf_dir, "visit_occurrence").select("person_id", "visit_concept_id")
    return salted_join(c, v, ["person_id"]).groupBy("visit_concept_id").agg(F.count("*").alias("n"))


@R.query("blocked_nearest", "SELECT a.vec_id, round(min(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 4) AS dist FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id GROUP BY 1")
def blocked_nearest(spark, sf_dir: str) -> DataFrame:
    """Distance of each dense vector to its nearest other one, by matrix blocks."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("bigint").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return nearest_dense(e, e).select(F.col("id").alias("vec_id"), F.round("dist", 4).alias("dist"))


def _dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for source, blocks in _places(batches):
        ids, a = source.column(2).to_numpy(), np.array(source.column(3).to_pylist(), float)
        best, match = np.full(len(ids), np.inf), np.full(len(ids), -1)
        for t in blocks:
            other, m = t.column(2).to_numpy(), np.array(t.column(3).to_pylist(), float)
            for i in range(0, len(ids), BLOCK):
                own = slice(i, i + BLOCK)
                d = (a[own] * a[own]).sum(1)[:, None] + (m * m).sum(1)[None, :] - 2 * a[own] @ m.T
                d[ids[own][:, None] == other[None, :]] = np.inf
                k = d.argmin(1)
                near = d[np.arange(len(k)), k]
                better = near < best[own]
                best[own] = np.where(better, near, best[own])
                match[own] = np.where(better, other[k], match[own])
        ok = best < np.inf
        yield pa.RecordBatch.from_arrays([pa.array(ids[ok]), pa.array(np.sqrt(np.maximum(best[ok], 0))), pa.array(match[ok])], ["id", "dist", "match_id"])


def nearest_dense(source: DataFrame, target: DataFrame) -> DataFrame:
    """``id, dist, match_id``: Euclidean distance of (id, v) to the nearest target of another id, block by block; vectors have one length and no nulls."""
    return against(source.select("id", "v"), target.select("id", "v")).mapInArrow(_dense, "id bigint, dist double, match_id bigint")
