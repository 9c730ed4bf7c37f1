"""Deterministic splits and samples. All randomness is a hash of keys and a seed, so results repeat on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import tokens as tk
from ..functions.tokens import SEQUENCES_SQL, sequences
from ..plans.registry import Registry
from ..plans.runtime import partitions, persisted, table
from ..plans.skew import broadcast_if_small, global_rank


def draw(*keys: str, seed: int = 0) -> Column:
    """A hexadecimal text to order by: the md5 of the keys and the seed."""
    return F.md5(F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("~")) for k in keys], F.lit(str(seed))).cast("binary"))


def uniform(*keys: str, seed: int = 0) -> Column:
    """A number in (0, 1) from the same md5 (its first 48 bits)."""
    return (F.conv(F.substring(draw(*keys, seed=seed), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def chronological_split(df: DataFrame, date: str, key: str, train: float = 0.8, test: float = 0.5) -> DataFrame:
    """Adds ``split``: the earliest share is train; the rest is divided into validation and test by draw. Null dates come first."""
    r = persisted(global_rank(df, [F.asc_nulls_first(date), F.col(key)]), "ranked")
    n = r.count()
    first = int(round(train * n, 6))
    late = F.when(uniform(key) < test, "test").otherwise("validation")
    return r.withColumn("split", F.when(F.col("rank") < first, "train").otherwise(late)).drop("rank")


def split_by_patient(df: DataFrame, person: str, train: float = 0.8, validation: float = 0.5, seed: int = 0) -> DataFrame:
    """Adds ``split`` such that a person is in one split; ``validation`` is its share of what train leaves. Null persons get null."""
    ids = persisted(global_rank(df.where(F.col(person).isNotNull()).select(person).distinct(), [draw(person, seed=seed), F.col(person)]), "ids")
    n = ids.count()
    a = int(round(train * n, 6))
    b = a + int(round((1 - train) * n * validation, 6))
    named = ids.select(person, F.when(F.col("rank") < a, "train").when(F.col("rank") < b, "validation").otherwise("test").alias("split"))
    return df.join(named, person, "left")


def random_split(df: DataFrame, key: str, shares: list[tuple[str, float]], seed: int = 0) -> DataFrame:
    """Adds ``split`` by the rank of a hash, so shares are exact to a row."""
    r = persisted(global_rank(df, [draw(key, seed=seed), F.col(key)]), "ranked")
    n, at, c = r.count(), 0.0, None
    for name, share in shares[:-1]:
        at += share
        c = F.when(F.col("rank") < int(round(at * n, 6)), name) if c is None else c.when(F.col("rank") < int(round(at * n, 6)), name)
    last = shares[-1][0]
    return r.withColumn("split", F.lit(last) if c is None else c.otherwise(last)).drop("rank")


def uniform_sample(df: DataFrame, n: int, *keys: str, seed: int = 0) -> DataFrame:
    """n rows by the order of a hash: a top-n with partial results per partition."""
    return df.orderBy(draw(*keys, seed=seed), *keys).limit(n)


def skip_take(df: DataFrame, n: int, *keys: str, seed: int = 0) -> DataFrame:
    """Adds ``part``: the first n rows in the order of a hash are ``taken``, the others are the ``rest``."""
    r = global_rank(df.withColumn("_h", draw(*keys, seed=seed)), [F.col("_h"), *[F.col(k) for k in keys]])
    return r.withColumn("part", F.when(F.col("rank") < n, "taken").otherwise("rest")).drop("_h", "rank")


def fraction_sample(df: DataFrame, share: float, *keys: str, seed: int = 0) -> DataFrame:
    """Each row with probability ``share`` by its hash; all rows if 1."""
    return df if share >= 1 else df.where(uniform(*keys, seed=seed) < share)


def few_shot(df: DataFrame, key: str, shots: int, share: float = 0.2, seed: int = 0) -> DataFrame:
    """``shots`` (at least 2) rows with ``split``: max(int(n * share), 1) of them validation, the others train."""
    n = max(shots, 2)
    picked = uniform_sample(df, n, key, seed=seed)
    r = global_rank(picked, [draw(key, seed=seed + 1), F.col(key)])
    return r.withColumn("split", F.when(F.col("rank") < max(int(n * share), 1), "validation").otherwise("train")).drop("rank")


def weighted_sample(df: DataFrame, n: int, weight: str, *keys: str, seed: int = 0) -> DataFrame:
    """n rows without replacement with chances by weight (least -ln(u) / w); null and non-positive weights are never drawn."""
    return df.where(F.col(weight) > 0).orderBy(-F.ln(uniform(*keys, seed=seed)) / F.col(weight), *keys).limit(n)


#: Values that a table of weights may have: it is drawn from by an array in every row's plan.
MOST_WEIGHTS = 10_000


def weighted_draws(values: DataFrame, weight: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """n draws with replacement: ``draw, key`` by the inverse distribution of a table of at most ``MOST_WEIGHTS`` rows (checked)."""
    rows = sorted(values.where(F.col(weight) > 0).select(key, F.col(weight).cast("double")).limit(MOST_WEIGHTS + 1).collect())
    if len(rows) > MOST_WEIGHTS:
        raise ValueError(f"more than {MOST_WEIGHTS} weights")
    spark, total, upto, at = values.sparkSession, sum(w for _, w in rows), [], 0.0
    for _, w in rows:
        at += w / total
        upto.append(at)
    u = uniform("draw", seed=seed)
    names = F.array(*[F.lit(k) for k, _ in rows]) if rows else F.array()
    place = F.size(F.filter(F.array(*[F.lit(x) for x in upto[:-1]]), lambda x: x <= u)) if len(upto) > 1 else F.lit(0)
    return spark.range(n if rows else 0).select(F.col("id").alias("draw")).select("draw", F.get(names, place).alias(key))


def _keep_first(batches, keys: list[str], order: list[str], n: int):
    """Rows sorted by keys and order, the first n of each group; at most twice the result and a batch are held."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def first(t: pa.Table) -> pa.Table:
        t = t.sort_by([(c, "ascending") for c in [*keys, *order]]).combine_chunks()
        new = np.ones(t.num_rows, bool)
        if t.num_rows > 1:
            same = np.ones(t.num_rows - 1, bool)
            for c in keys:
                a, b = t.column(c).slice(1), t.column(c).slice(0, t.num_rows - 1)
                equal = pc.fill_null(pc.equal(a, b), False).to_numpy() | (pc.is_null(a).to_numpy() & pc.is_null(b).to_numpy())
                same &= equal
            new[1:] = ~same
        at = np.arange(t.num_rows)
        return t.filter(pa.array(at - np.maximum.accumulate(np.where(new, at, 0)) < n))

    held, limit = None, 1 << 17
    for b in batches:
        held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        if held.num_rows > limit:
            held = first(held)
            limit = max(1 << 17, 2 * held.num_rows)
    if held is not None and held.num_rows:
        yield from first(held).to_batches(max_chunksize=10_000)


def reservoir(df: DataFrame, keys: list[str], n: int, *ids: str, seed: int = 0) -> DataFrame:
    """At most n rows per group by the order of a hash. Each task keeps its own n of each group before the shuffle, whatever n is, so hot groups arrive small."""
    from pyspark.sql import Window

    h = df.withColumn("_h", draw(*ids, seed=seed))
    part = h.mapInArrow(lambda it: _keep_first(it, keys, ["_h", *ids], n), h.schema)
    return part.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy("_h", *ids))).where(F.col("_k") <= n).drop("_h", "_k")


def shuffled_within_rank(df: DataFrame, rank: str, key: str, seed: int = 0) -> DataFrame:
    """Adds ``place``, from 0: by rank, then by hash; over all partitions."""
    return global_rank(df.withColumn("_h", draw(key, seed=seed)), [F.col(rank), F.col("_h"), F.col(key)], "place").drop("_h")


def prompts(seqs: DataFrame, key: str, c: str, n: int, least: int, most: int, size: int = 4, seed: int = 0) -> DataFrame:
    """The first ``size`` tokens of n sequences with a length in range, drawn by hash."""
    rows = uniform_sample(seqs.where(F.size(c).between(least, most)).select(key, c), n, key, seed=seed)
    return rows.select(key, F.slice(c, 1, size).alias("prompt"))


# Races that are one, and the weights of the age groups in order. Ages below 0 and from 100 on are invalid.
RACES = {"38003613": "8557", "38003610": "8557", "38003579": "8515", "44814653": "0"}
AGE_WEIGHTS = list(range(10, 0, -1))


def remap(c: Column, pairs: dict[str, str]) -> Column:
    """Values by a small map; others stay."""
    m = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    return F.coalesce(m[c], c)


def causal_split(rows: DataFrame, n_train: int, seed: int = 1) -> DataFrame:
    """``rows`` (person_id, year, age, race, gender) with ``prob, adjusted_prob, split``: train drawn with weights that favour the young, validation the rest.

    Rows of unknown gender ``0`` or of an invalid age group take no part; an age group's weight is its share times its place's weight.
    """
    low = F.regexp_extract("age", r"^age:(-?[0-9]+)-", 1).try_cast("int")
    clean = rows.where((F.col("gender") != "0") & low.between(0, 99))
    groups = sorted((r[0], r[1]) for r in clean.groupBy("age").count().collect())  # about ten
    total = sum(n for _, n in groups)
    probs = [(a, n / total, n / total * w) for (a, n), w in zip(groups, AGE_WEIGHTS + [0] * len(groups))]
    all_ = sum(p for _, _, p in probs) or 1.0
    spark = rows.sparkSession
    p = spark.createDataFrame([(a, x, y / all_) for a, x, y in probs], "age string, prob double, adjusted_prob double")
    joined = persisted(clean.join(F.broadcast(p), "age"), "causal")
    train = weighted_sample(joined, n_train, "adjusted_prob", "person_id", seed=seed).select("person_id").withColumn("t", F.lit(1)).distinct()
    return joined.join(broadcast_if_small(train), "person_id", "left").withColumn("split", F.when(F.col("t").isNotNull(), "train").otherwise("validation")).drop("t")


R = Registry()


def _md5(c: str, seed: int = 0) -> str:
    return f"md5(concat_ws('|', {c}::VARCHAR, '{seed}'))"


def _persons(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "person").where("person_id is not null")


@R.query("split_chronological", f"""WITH o AS (SELECT visit_occurrence_id AS id, min(visit_start_date) AS d FROM visit_occurrence GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY d NULLS FIRST, id) - 1 AS k, count(*) OVER () AS n FROM o)
SELECT id, d, CASE WHEN k < floor(0.8 * n) THEN 'train' WHEN (('0x' || substr({_md5('id')}, 1, 12))::BIGINT + 0.5) / 281474976710656.0 < 0.5 THEN 'test' ELSE 'validation' END AS split FROM r""")
def split_chronological(spark, sf_dir: str) -> DataFrame:
    """Visits by their first start date."""
    v = table(spark, sf_dir, "visit_occurrence").groupBy(F.col("visit_occurrence_id").alias("id")).agg(F.min("visit_start_date").alias("d"))
    return chronological_split(v, "d", "id")


@R.query("split_by_patient", f"""WITH i AS (SELECT person_id, row_number() OVER (ORDER BY {_md5('person_id')}, person_id) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT person_id FROM visit_occurrence WHERE person_id IS NOT NULL)),
s AS (SELECT person_id, CASE WHEN k < floor(0.8 * n) THEN 'train' WHEN k < floor(0.8 * n) + floor((1 - 0.8) * n * 0.5) THEN 'validation' ELSE 'test' END AS split FROM i)
SELECT split, count(*) AS n_visits, count(DISTINCT v.person_id) AS n_persons FROM visit_occurrence v LEFT JOIN s USING (person_id) GROUP BY 1""")
def split_by_patient_query(spark, sf_dir: str) -> DataFrame:
    v = split_by_patient(table(spark, sf_dir, "visit_occurrence"), "person_id")
    return v.groupBy("split").agg(F.count("*").alias("n_visits"), F.count_distinct("person_id").alias("n_persons"))


@R.query("split_hash", f"""WITH d AS (SELECT DISTINCT person_id FROM person), r AS (SELECT person_id, row_number() OVER (ORDER BY {_md5('person_id', 3)}, person_id) - 1 AS k, count(*) OVER () AS n FROM d)
SELECT person_id, CASE WHEN k < floor(0.8 * n) THEN 'train' WHEN k < floor(0.9 * n) THEN 'validation' ELSE 'test' END AS split FROM r""")
def split_hash(spark, sf_dir: str) -> DataFrame:
    return random_split(_persons(spark, sf_dir).select("person_id").distinct(), "person_id", [("train", 0.8), ("validation", 0.1), ("test", 0.1)], seed=3)


@R.query("few_shot", f"""WITH p AS (SELECT person_id FROM (SELECT DISTINCT person_id FROM person) ORDER BY {_md5('person_id')}, person_id LIMIT 50), r AS (SELECT person_id, row_number() OVER (ORDER BY {_md5('person_id', 1)}, person_id) - 1 AS k FROM p)
SELECT person_id, CASE WHEN k < 10 THEN 'validation' ELSE 'train' END AS split FROM r""")
def few_shot_query(spark, sf_dir: str) -> DataFrame:
    return few_shot(_persons(spark, sf_dir).select("person_id").distinct(), "person_id", 50)


@R.query("uniform_sample", f"SELECT person_id FROM (SELECT DISTINCT person_id FROM person) ORDER BY {_md5('person_id', 7)}, person_id LIMIT 100")
def uniform_sample_query(spark, sf_dir: str) -> DataFrame:
    return uniform_sample(_persons(spark, sf_dir).select("person_id").distinct(), 100, "person_id", seed=7)


@R.query("fraction_sample", f"SELECT person_id FROM (SELECT DISTINCT person_id FROM person) WHERE (('0x' || substr({_md5('person_id', 5)}, 1, 12))::BIGINT + 0.5) / 281474976710656.0 < 0.25")
def fraction_sample_query(spark, sf_dir: str) -> DataFrame:
    return fraction_sample(_persons(spark, sf_dir).select("person_id").distinct(), 0.25, "person_id", seed=5)


def _u(*keys: str, seed: int = 0) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(f'{k}::VARCHAR' for k in keys)}, '{seed}')), 1, 12))::BIGINT + 0.5) / 281474976710656.0"


@R.query("weighted_sample", f"WITH v AS (SELECT person_id, count(*) AS count FROM visit_occurrence WHERE person_id IS NOT NULL GROUP BY 1) SELECT person_id, count FROM v ORDER BY -ln({_u('person_id')}) / count, person_id LIMIT 100")
def weighted_sample_query(spark, sf_dir: str) -> DataFrame:
    """A hundred persons with chances by their number of visits."""
    v = table(spark, sf_dir, "visit_occurrence").where("person_id is not null").groupBy("person_id").count()
    return weighted_sample(v, 100, "count", "person_id")


@R.query("weighted_draws", f"WITH v AS (SELECT visit_concept_id, count(*)::DOUBLE AS w FROM visit_occurrence WHERE visit_concept_id IS NOT NULL GROUP BY 1), c AS (SELECT visit_concept_id, sum(w) OVER (ORDER BY visit_concept_id) / sum(w) OVER () AS hi, (sum(w) OVER (ORDER BY visit_concept_id) - w) / sum(w) OVER () AS lo FROM v), d AS (SELECT draw, {_u('draw')} AS u FROM range(1000) r(draw)) SELECT draw, visit_concept_id FROM d JOIN c ON u >= lo AND u < hi")
def weighted_draws_query(spark, sf_dir: str) -> DataFrame:
    """A thousand visit types with chances by their frequency."""
    v = table(spark, sf_dir, "visit_occurrence").where("visit_concept_id is not null").groupBy("visit_concept_id").count()
    return weighted_draws(v, "count", "visit_concept_id", 1000)


@R.query("reservoir", f"SELECT measurement_concept_id, measurement_id, loaded_at FROM (SELECT *, row_number() OVER (PARTITION BY measurement_concept_id ORDER BY md5(concat_ws('|', measurement_id::VARCHAR, coalesce(epoch_us(loaded_at)::VARCHAR, '~'), '0')), measurement_id, loaded_at) AS k FROM (SELECT DISTINCT measurement_concept_id, measurement_id, loaded_at FROM measurement)) WHERE k <= 20")
def reservoir_query(spark, sf_dir: str) -> DataFrame:
    """At most twenty measurements of each concept."""
    m = table(spark, sf_dir, "measurement").select("measurement_concept_id", "measurement_id", "loaded_at").distinct().withColumn("t", F.unix_micros(F.col("loaded_at").cast("timestamp")))
    return reservoir(m, ["measurement_concept_id"], 20, "measurement_id", "t").drop("t")


@R.query("prompt_sample", SEQUENCES_SQL + f", u AS (SELECT person_id, max(array_to_string(t, ' ')) AS x FROM s GROUP BY 1) SELECT person_id, array_to_string(string_split(x, ' ')[:4], ' ') AS prompt FROM u WHERE len(string_split(x, ' ')) BETWEEN 20 AND 512 ORDER BY {_md5('person_id')}, person_id LIMIT 64")
def prompt_sample(spark, sf_dir: str) -> DataFrame:
    one = sequences(spark, sf_dir).groupBy("person_id").agg(F.max(F.array_join("t", " ")).alias("x"))
    s = one.select("person_id", F.split("x", " ").alias("t"))
    return prompts(s, "person_id", "t", 64, 20, 512).select("person_id", F.array_join("prompt", " ").alias("prompt"))


def _ages(spark, sf_dir: str) -> DataFrame:
    """person_id, year, age group, race, gender of one sequence of each person."""
    t = F.col("t")
    one = sequences(spark, sf_dir).where(F.size("t") > 4).groupBy("person_id").agg(F.max("t").alias("t"))
    return one.select("person_id", t[0].alias("year"), tk.age_group(t[1]).alias("age"), t[3].alias("race"), t[2].alias("gender"))


_AGES = SEQUENCES_SQL + """, o AS (SELECT person_id, max(t) AS t FROM s WHERE len(t) > 4 GROUP BY 1), a AS (SELECT person_id, 'age:' || (TRY_CAST(substr(t[2], 5) AS INT) // 10 * 10) || '-' || (TRY_CAST(substr(t[2], 5) AS INT) // 10 * 10 + 10) AS age, t[3] AS gender, t[4] AS race FROM o),
c AS (SELECT age, count(*) AS n FROM a WHERE gender <> '0' AND age IS NOT NULL AND TRY_CAST(regexp_extract(age, '^age:(-?[0-9]+)-', 1) AS INT) BETWEEN 0 AND 99 GROUP BY 1),
w AS (SELECT age, n, n / sum(n) OVER () AS prob, greatest(11 - row_number() OVER (ORDER BY age), 0) AS w FROM c)"""


@R.query("causal_age_probabilities", _AGES + " SELECT age, prob, prob * w / sum(prob * w) OVER () AS adjusted_prob, n AS n_persons FROM w")
def causal_age_probabilities(spark, sf_dir: str) -> DataFrame:
    return causal_split(_ages(spark, sf_dir), 10).groupBy("age", "prob", "adjusted_prob").agg(F.count("*").alias("n_persons"))


@R.query("causal_split", _AGES + f", ap AS (SELECT age, prob * w / sum(prob * w) OVER () AS q FROM w), j AS (SELECT a.*, q FROM a JOIN ap USING (age) WHERE gender <> '0'), tr AS (SELECT person_id FROM j WHERE q > 0 ORDER BY -ln({_u('person_id', seed=1)}) / q, person_id LIMIT (SELECT count(*) // 2 FROM o)) SELECT person_id, age, race, gender, CASE WHEN person_id IN (FROM tr) THEN 'train' ELSE 'validation' END AS split FROM j")
def causal_split_query(spark, sf_dir: str) -> DataFrame:
    """Half of the persons for train, weighted to the young; validation the others."""
    rows = persisted(_ages(spark, sf_dir), "ages")
    return causal_split(rows, rows.count() // 2).select("person_id", "age", "race", "gender", "split")


@R.query("causal_races", SEQUENCES_SQL + ", o AS (SELECT person_id, max(t) AS t FROM s WHERE len(t) > 4 GROUP BY 1) SELECT CASE t[4] WHEN '38003613' THEN '8557' WHEN '38003610' THEN '8557' WHEN '38003579' THEN '8515' WHEN '44814653' THEN '0' ELSE t[4] END AS race, count(*) AS n_persons FROM o GROUP BY 1")
def causal_races(spark, sf_dir: str) -> DataFrame:
    """Persons of each race after races that are one were joined; the split itself keeps them as they are."""
    return _ages(spark, sf_dir).groupBy(remap(F.col("race"), RACES).alias("race")).agg(F.count("*").alias("n_persons"))


@R.query("shuffled_ranks", f"WITH p AS (SELECT DISTINCT person_id, coalesce(year_of_birth // 10, 0) AS rank FROM person WHERE person_id IS NOT NULL) SELECT *, row_number() OVER (ORDER BY rank, {_md5('person_id', 3)}, person_id) - 1 AS place FROM p")
def shuffled_ranks(spark, sf_dir: str) -> DataFrame:
    """Persons in the order of their decade of birth, shuffled within it."""
    p = _persons(spark, sf_dir).where("person_id is not null").select("person_id", F.coalesce(F.floor(F.col("year_of_birth") / 10).cast("int"), F.lit(0)).alias("rank")).distinct()
    return shuffled_within_rank(p, "rank", "person_id", seed=3)


@R.query("skip_take", f"WITH p AS (SELECT DISTINCT person_id FROM person WHERE person_id IS NOT NULL) SELECT person_id, CASE WHEN row_number() OVER (ORDER BY {_md5('person_id', 4)}, person_id) <= 100 THEN 'taken' ELSE 'rest' END AS part FROM p")
def skip_take_query(spark, sf_dir: str) -> DataFrame:
    """A hundred persons for validation, all others for train."""
    return skip_take(_persons(spark, sf_dir).where("person_id is not null").select("person_id").distinct(), 100, "person_id", seed=4)
