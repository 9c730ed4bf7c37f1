"""Sampling filters over tables of next-token probabilities, and the simulated data of the time-embedding study."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from ..functions.tokens import SEQUENCES_SQL, sequences
from ..plans.registry import Registry
from ..plans.runtime import persisted
from .splits import uniform


def transitions(seqs: DataFrame, c: str) -> DataFrame:
    """``context, token, n, p``: counts and shares of each token after each token."""
    both = F.arrays_zip(F.slice(c, 1, F.size(c) - 1).alias("context"), F.slice(c, 2, F.size(c) - 1).alias("token"))
    pairs = seqs.where(F.size(c) > 1).select(F.explode(both).alias("x"))
    n = pairs.groupBy("x.context", "x.token").agg(F.count("*").alias("n"))
    return n.select("context", "token", "n", (F.col("n") / F.sum("n").over(Window.partitionBy("context"))).alias("p"))


def _again(df: DataFrame, p: Column) -> DataFrame:
    return df.select("context", "token", (p / F.sum(p).over(Window.partitionBy("context"))).alias("p"))


def _best() -> WindowSpec:
    return Window.partitionBy("context").orderBy(F.desc("p"), "token")


def top_k(df: DataFrame, k: int) -> DataFrame:
    """The k most probable tokens of each context (ties by text), with shares anew."""
    return _again(df.withColumn("r", F.row_number().over(_best())).where(F.col("r") <= k), F.col("p"))


def top_p(df: DataFrame, share: float) -> DataFrame:
    """The fewest tokens whose shares reach ``share``: those before which less was reached."""
    before = F.sum("p").over(_best().rowsBetween(Window.unboundedPreceding, -1))
    return _again(df.withColumn("b", F.coalesce(before, F.lit(0.0))).where(F.col("b") < share - 1e-12), F.col("p"))


def top_mix(df: DataFrame, k: int, share: float) -> DataFrame:
    """The k most probable tokens, with shares anew, and of those the fewest that reach ``share``."""
    return top_p(top_k(df, k), share)


def beams(df: DataFrame, contexts: DataFrame, steps: int, width: int) -> DataFrame:
    """``key, rank, tokens, p``: the ``width`` most probable continuations of ``steps`` tokens of each (key, context), found step by step from as many at each.

    Only a context's ``width`` most probable tokens can go on, so they are taken first. Ties by the tokens' text.
    """
    next_ = persisted(df.withColumn("r", F.row_number().over(_best())).where(F.col("r") <= width).select("context", F.col("token").alias("t"), F.col("p").alias("q")), "best")
    now = contexts.select("key", "context", F.lit(1.0).alias("p"), F.lit("").alias("tokens"))
    best = Window.partitionBy("key").orderBy(F.desc(F.round("p", 12)), "tokens")
    for _ in range(steps):
        now = now.join(next_, "context").select("key", F.col("t").alias("context"), (F.col("p") * F.col("q")).alias("p"), F.concat_ws(" ", F.when(F.col("tokens") != "", F.col("tokens")), F.col("t")).alias("tokens"))
        now = now.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= width)
    return now.select("key", "rank", "tokens", "p")


def temperature(df: DataFrame, t: float) -> DataFrame:
    """Shares to the power 1 / t."""
    return _again(df, F.pow("p", F.lit(1.0 / t)))


def epsilon_cutoff(df: DataFrame, least: float) -> DataFrame:
    """Tokens of at least ``least``; of a context without any the most probable one."""
    return _again(df.withColumn("r", F.row_number().over(_best())).where((F.col("p") >= least) | (F.col("r") == 1)), F.col("p"))


def repetition_penalty(df: DataFrame, seen: DataFrame, penalty: float) -> DataFrame:
    """Shares of tokens in ``seen`` (context, token) to the power of ``penalty``: a logarithm below 0 multiplied by it."""
    j = df.join(seen.select("context", "token").distinct().withColumn("s", F.lit(True)), ["context", "token"], "left")
    return _again(j, F.when(F.col("s"), F.pow("p", F.lit(penalty))).otherwise(F.col("p")))


def draw_next(df: DataFrame, contexts: DataFrame, seed: int = 0) -> DataFrame:
    """``key, context, token`` drawn for each (key, context) by inverse distribution and a hash."""
    upto = F.sum("p").over(_best().rowsBetween(Window.unboundedPreceding, 0))
    t = df.withColumn("hi", upto).withColumn("lo", F.col("hi") - F.col("p"))
    u = contexts.withColumn("u", uniform("key", "context", seed=seed))
    return u.join(t, "context").where((F.col("lo") <= F.col("u")) & (F.col("u") < F.col("hi"))).select("key", "context", "token")


#: Times of the simulation run from 0 to one less; so do the days between the two marks.
TIMES = 21


def simulated(spark, n: int, seed: int = 0) -> DataFrame:
    """``id, x1, x2, t1, t2, y``: two binary marks at two times, and a label by rules on the marks and the days d between them.

    A first mark of 1 with d divisible by 4 asks for a second mark of 0, one of 0 with d divisible by 3 for a second mark of 1;
    else either but not both count up to 7 days, both up to 14 and any up to 21.
    """
    # The rules' inputs come from hashes, so every cluster makes the same table.
    pick = lambda name, k: F.floor(uniform("id", seed=seed * 10 + name) * k).cast("int")
    r = spark.range(n).select("id", pick(1, 2).alias("x1"), pick(2, 2).alias("x2"), pick(3, TIMES).alias("t1"), (pick(3, TIMES) + pick(4, TIMES)).alias("t2"))
    d, x1, x2 = F.col("t2") - F.col("t1"), F.col("x1"), F.col("x2")
    y = F.when((x1 == 1) & (d % 4 == 0), 1 - x2).when((x1 == 0) & (d % 3 == 0), x2)
    y = y.when(d <= 7, x1.bitwiseXOR(x2)).when(d <= 14, x1.bitwiseAND(x2)).when(d <= 21, x1.bitwiseOR(x2)).otherwise(0)
    return r.withColumn("y", y.cast("int"))


def ids_by_first_place(tokens: DataFrame, token: str, place: str) -> DataFrame:
    """``token, id``: ids from 1 in the order of first appearance. For small vocabularies: one window over the distinct tokens of a bounded simulation."""
    first = tokens.groupBy(token).agg(F.min(place).alias("_f"))
    return first.select(token, F.row_number().over(Window.orderBy("_f", token)).alias("id"))


def aligned_metrics(a: DataFrame, b: DataFrame, step: str = "step") -> DataFrame:
    """The metrics of two runs at the steps that both have."""
    return a.withColumnRenamed("value", "value_a").join(b.withColumnRenamed("value", "value_b"), step)


R = Registry()
_N = SEQUENCES_SQL + """, e AS (SELECT unnest(t[:len(t) - 1]) AS context, unnest(t[2:]) AS token FROM s WHERE len(t) > 1), k AS (SELECT context, token, count(*) AS n FROM e GROUP BY ALL),
p AS (SELECT context, token, n / sum(n) OVER (PARTITION BY context) AS p FROM k), o AS (SELECT *, row_number() OVER w AS r, coalesce(sum(p) OVER (PARTITION BY context ORDER BY p DESC, token ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM p WINDOW w AS (PARTITION BY context ORDER BY p DESC, token))"""


def _next(spark, sf_dir: str) -> DataFrame:
    return transitions(sequences(spark, sf_dir), "t").drop("n")


@R.query("top_k_next", _N + " SELECT context, token, p / sum(p) OVER (PARTITION BY context) AS p FROM o WHERE r <= 5")
def top_k_next(spark, sf_dir: str) -> DataFrame:
    return top_k(_next(spark, sf_dir), 5)


@R.query("top_p_next", _N + " SELECT context, token, p / sum(p) OVER (PARTITION BY context) AS p FROM o WHERE b < 0.8 - 1e-12")
def top_p_next(spark, sf_dir: str) -> DataFrame:
    return top_p(_next(spark, sf_dir), 0.8)


@R.query("top_mix_next", _N + ", a AS (SELECT context, token, p / sum(p) OVER (PARTITION BY context) AS p FROM o WHERE r <= 20), c AS (SELECT *, coalesce(sum(p) OVER (PARTITION BY context ORDER BY p DESC, token ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM a) SELECT context, token, p / sum(p) OVER (PARTITION BY context) AS p FROM c WHERE b < 0.8 - 1e-12")
def top_mix_next(spark, sf_dir: str) -> DataFrame:
    return top_mix(_next(spark, sf_dir), 20, 0.8)


def _beam(k: int) -> str:
    before = "b" + str(k - 1) if k > 1 else "(SELECT DISTINCT context AS key, context, 1.0::DOUBLE AS p, '' AS tokens FROM o)"
    return f"b{k} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY round(p, 12) DESC, tokens) AS rank FROM (SELECT key, n.token AS context, b.p * n.p AS p, trim(tokens || ' ' || n.token) AS tokens FROM {before} b JOIN (SELECT context, token, p FROM o WHERE r <= 3) n ON n.context = b.context)) WHERE rank <= 3)"


@R.query("beam_next", _N + ", " + ", ".join(map(_beam, (1, 2, 3))) + " SELECT key, rank, tokens, round(p, 9) AS p FROM b3")
def beam_next(spark, sf_dir: str) -> DataFrame:
    """The three most probable continuations of three tokens of every token."""
    n = persisted(_next(spark, sf_dir), "next")
    return beams(n, n.select(F.col("context").alias("key"), "context").distinct(), 3, 3).withColumn("p", F.round("p", 9))


@R.query("temperature_next", _N + " SELECT context, token, p ** 2 / sum(p ** 2) OVER (PARTITION BY context) AS p FROM o")
def temperature_next(spark, sf_dir: str) -> DataFrame:
    return temperature(_next(spark, sf_dir), 0.5)


@R.query("epsilon_next", _N + " SELECT context, token, p / sum(p) OVER (PARTITION BY context) AS p FROM o WHERE p >= 0.01 OR r = 1")
def epsilon_next(spark, sf_dir: str) -> DataFrame:
    return epsilon_cutoff(_next(spark, sf_dir), 0.01)


@R.query("penalty_next", _N + ", q AS (SELECT context, token, CASE WHEN token = context THEN p ** 1.5 ELSE p END AS p FROM o) SELECT context, token, p / sum(p) OVER (PARTITION BY context) AS p FROM q")
def penalty_next(spark, sf_dir: str) -> DataFrame:
    """A token after itself is penalised."""
    n = _next(spark, sf_dir)
    return repetition_penalty(n, n.where("context = token"), 1.5)


@R.query("draw_next", _N + """, q AS (SELECT context, token, p / sum(p) OVER (PARTITION BY context) AS p FROM o WHERE b < 0.95 - 1e-12), c AS (SELECT context, token, sum(p) OVER w AS hi, sum(p) OVER w - p AS lo FROM q WINDOW w AS (PARTITION BY context ORDER BY p DESC, token ROWS UNBOUNDED PRECEDING)),
l AS (SELECT person_id AS key, t[len(t) - 1] AS context FROM s WHERE len(t) > 5), d AS (SELECT *, (('0x' || substr(md5(concat_ws('|', key::VARCHAR, context, '0')), 1, 12))::BIGINT + 0.5) / 281474976710656.0 AS u FROM l) SELECT key, d.context, token FROM d JOIN c ON d.context = c.context AND u >= lo AND u < hi""")
def draw_next_query(spark, sf_dir: str) -> DataFrame:
    """A next token for the last token of each sequence."""
    s = sequences(spark, sf_dir).where("size(t) > 5").select(F.col("person_id").alias("key"), F.get("t", F.size("t") - 2).alias("context"))
    return draw_next(top_p(_next(spark, sf_dir), 0.95), s)


def _u(name: int, n: int) -> str:
    return f"CAST(floor((('0x' || substr(md5(concat_ws('|', id::VARCHAR, '{name}')), 1, 12))::BIGINT + 0.5) / 281474976710656.0 * {n}) AS INT)"


_SIMULATED = f"WITH i AS (SELECT id FROM range(20000) r(id)), r AS (SELECT id, {_u(1, 2)} AS x1, {_u(2, 2)} AS x2, {_u(3, TIMES)} AS t1, {_u(3, TIMES)} + {_u(4, TIMES)} AS t2 FROM i)"


@R.query("simulation_rules", _SIMULATED + """ SELECT *, CASE WHEN x1 = 1 AND (t2 - t1) % 4 = 0 THEN (x2 = 0)::INT WHEN x1 = 0 AND (t2 - t1) % 3 = 0 THEN (x2 = 1)::INT
WHEN t2 - t1 <= 7 THEN (x1 <> x2)::INT WHEN t2 - t1 <= 14 THEN (x1 = 1 AND x2 = 1)::INT WHEN t2 - t1 <= 21 THEN (x1 = 1 OR x2 = 1)::INT ELSE 0 END AS y FROM r""")
def simulation_rules(spark, sf_dir: str) -> DataFrame:
    return simulated(spark, 20_000)


@R.query("simulation_token_ids", _SIMULATED + """, t AS (SELECT id * 4 AS p, 'c-' || x1 AS token FROM r UNION ALL SELECT id * 4 + 1, 'c-' || x2 FROM r UNION ALL SELECT id * 4 + 2, 't-' || t1 FROM r UNION ALL SELECT id * 4 + 3, 't-' || t2 FROM r), f AS (SELECT token, min(p) AS p FROM t GROUP BY 1)
SELECT token, row_number() OVER (ORDER BY p, token) AS id FROM f""")
def simulation_token_ids(spark, sf_dir: str) -> DataFrame:
    """Ids of marks and times in the order in which rows show them: both marks, then both times."""
    s = simulated(spark, 20_000)
    parts = F.posexplode(F.array(*[F.concat(F.lit(f"{k}-"), c) for k, c in (("c", "x1"), ("c", "x2"), ("t", "t1"), ("t", "t2"))])).alias("k", "token")
    return ids_by_first_place(s.select("id", parts).select("token", (F.col("id") * 4 + F.col("k")).alias("place")), "token", "place")


@R.query("aligned_metrics", f"WITH i AS (SELECT id FROM range(20000) r(id)), r AS (SELECT id // 100 AS step, {_u(1, 2)} AS x1, {_u(2, 2)} AS x2, id FROM i) SELECT a.step, a.v AS value_a, b.v AS value_b FROM (SELECT step, avg(x1) AS v FROM r GROUP BY 1) a JOIN (SELECT step, avg(x2) AS v FROM r WHERE step % 2 = 0 GROUP BY 1) b USING (step)")
def aligned_metrics_query(spark, sf_dir: str) -> DataFrame:
    s = simulated(spark, 20_000).withColumn("step", F.floor(F.col("id") / 100))
    m = lambda c, rows: rows.groupBy("step").agg(F.avg(c).alias("value"))
    return aligned_metrics(m("x1", s), m("x2", s.where("step % 2 = 0")))
