"""Time-to-event analytics over simulated or recorded continuations of sequences."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import tokens as tk
from ..functions.tokens import SEQUENCES_SQL, sequences
from ..plans.registry import Registry
from ..plans.runtime import table

CENSORED = "0"
TIME_BUCKET = 90


@dataclass(frozen=True)
class TaskConfig:
    """A prediction task. Bounds of -1 are open."""

    task_name: str
    outcome_events: list[str] = field(default_factory=list)
    include_descendants: bool = False
    future_visit_start: int = 0
    future_visit_end: int = -1
    prediction_window_start: int = 0
    prediction_window_end: int = 365
    max_new_tokens: int = 128

    @classmethod
    def from_file(cls, path: str) -> TaskConfig:
        """Reads JSON, or flat YAML of scalars and lists."""
        from ..sources.config import read_config

        return cls(**read_config(path))


def descendants(outcomes: DataFrame, ancestor: DataFrame) -> DataFrame:
    """``concept``: the outcomes and, of numeric ones, all descendants in the closure table."""
    down = outcomes.where(tk.is_clinical_event(F.col("concept"))).join(ancestor, F.col("concept") == F.col("ancestor_concept_id").cast("string"))
    return outcomes.select("concept").union(down.select(F.col("descendant_concept_id").cast("string"))).distinct()


def outcomes_of(task: TaskConfig, spark, ancestor: DataFrame | None = None) -> list[str]:
    """The task's outcomes and, if it includes descendants, those of the closure table: at most the vocabulary."""
    if not task.include_descendants or ancestor is None:
        return sorted({*task.outcome_events})
    given = spark.createDataFrame([(x,) for x in task.outcome_events], "concept string")
    return sorted(r[0] for r in descendants(given, ancestor).collect())


def first_hit(tokens: Column, outcomes: list[str], task: TaskConfig) -> Column:
    """``struct(event, days)`` of a continuation: the first outcome in the window, ``0`` if censored before, null if neither.

    The walk is a fold over the row's array with the state (visits, days,
    event), so nothing is exploded or shuffled. A token counts as visit start
    first, then is tested for being beyond the window, then moves the clock or may hit.
    """
    start = F.struct(F.lit(0).alias("v"), F.lit(0).alias("d"), F.lit(None).cast("string").alias("e"))
    beyond = lambda v, d: (F.lit(task.future_visit_end != -1) & (v > task.future_visit_end)) | (F.lit(task.prediction_window_end != -1) & (d > task.prediction_window_end))

    def step(s: Column, t: Column) -> Column:
        v = s["v"] + tk.is_visit_start(t).cast("int")
        att = tk.is_att_token(t)
        hit = ~att & (v >= task.future_visit_start) & (s["d"] >= task.prediction_window_start) & t.isin(outcomes or [""])
        event = F.when(beyond(v, s["d"]), F.lit(CENSORED)).when(hit, t)
        days = F.when(att & event.isNull(), s["d"] + F.coalesce(tk.interval_days(t), F.lit(0))).otherwise(s["d"])
        return F.when(s["e"].isNotNull(), s).otherwise(F.struct(v.alias("v"), days.alias("d"), event.alias("e")))

    end = F.aggregate(tokens, start, step)
    open_ = task.future_visit_end == -1 and task.prediction_window_end == -1
    event = F.coalesce(end["e"], F.lit(CENSORED)) if open_ else end["e"]
    return F.when(event.isNotNull(), F.struct(event.alias("event"), end["d"].alias("days")))


def summarise(trials: DataFrame, keys: list[str]) -> DataFrame:
    """Per key over trials (event, days): ``n, average_time, median_time, standard_deviation, most_likely_time, event_probability``.

    The deviation is of the population; the most likely month bucket breaks ties by its earliest time.
    """
    t = trials.withColumn("bucket", tk.month_bucket(F.col("days")))
    b = t.groupBy(*keys, "bucket").agg(F.count("*").alias("n"), F.min("days").alias("d"))
    mode = b.groupBy(*keys).agg(F.max_by("bucket", F.struct("n", (-F.col("d")).alias("d"))).alias("most_likely_time"))
    s = t.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("days").alias("average_time"), F.median("days").alias("median_time"), F.stddev_pop("days").alias("standard_deviation"), F.avg((F.col("event") != CENSORED).cast("int")).alias("event_probability"))
    return s.join(mode, keys)


def bucket_probabilities(trials: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, time_interval, probability`` of each month bucket."""
    b = trials.groupBy(*keys, tk.month_bucket(F.col("days")).alias("time_interval")).agg(F.count("*").alias("n"))
    return b.select(*keys, "time_interval", (F.col("n") / F.sum("n").over(Window.partitionBy(*keys))).alias("probability"))


def time_bucket(interval: Column, size: int = TIME_BUCKET) -> Column:
    """``M4`` to a range of days, LT to ``>= 1095 days``."""
    base = F.floor((F.substring(interval, 2, 9).try_cast("int") + 1) * 30 / (size + 1)).cast("int")
    return F.when(interval == "LT", ">= 1095 days").when(tk.is_att_token(interval), F.concat(base * size, F.lit(" days - "), (base + 1) * size, F.lit(" days")))


def cumulative(probabilities: DataFrame, keys: list[str], size: int = TIME_BUCKET) -> DataFrame:
    """``keys, time_bucket, probability, cumulative`` by falling probability (ties by text)."""
    g = probabilities.groupBy(*keys, time_bucket(F.col("time_interval"), size).alias("time_bucket")).agg(F.sum("probability").alias("probability"))
    by = Window.partitionBy(*keys).orderBy(F.desc(F.round("probability", 12)), "time_bucket").rowsBetween(Window.unboundedPreceding, 0)
    return g.select(*keys, "time_bucket", "probability", F.sum("probability").over(by).alias("cumulative"))


def without_done(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys have no result yet."""
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")


def prompt_truncation(c: Column, most: int, header: int = 0) -> Column:
    """The most recent ``most`` tokens from their first visit start on; shorter sequences stay whole.

    ``header`` tokens of the start are kept before them, within ``most``; usually none are.
    """
    tail = F.slice(c, -(most - header), most - header)
    at = F.array_position(F.transform(tail, lambda x: F.when(tk.is_visit_start(x), "s").otherwise("")), "s").cast("int")
    cut = F.when(at > 0, F.slice(tail, at, most)).otherwise(tail)
    return F.when(F.size(c) < most, c).otherwise(F.concat(F.slice(c, 1, header), cut) if header else cut)


# The prediction tasks.
TASKS = [
    TaskConfig("cabg_prediction", ["43528001", "43528003", "43528004", "43528002", "4305852", "4168831", "2107250", "2107216", "2107222", "2107231", "4336464", "4231998", "4284104", "2100873"], True, 0, -1, 0, 365, 1024),
    TaskConfig("30_day_readmission_prediction", ["9201", "262", "8971", "8920"], False, 0, -1, 0, 30, 128),
    TaskConfig("next_visit_type_prediction", ["9202", "9203", "581477", "9201", "5083", "262", "38004250", "8883", "38004238", "38004251", "38004222", "38004268", "38004228", "32693", "8971", "38004269", "38004193", "32036", "8782"], False, 0, 1),
    TaskConfig("t2dm_hf_prediction", ["316139"], True, 0, -1, 30, -1, 512),
]

R = Registry()
READMISSION = TaskConfig("readmission", ["9201", "262"], future_visit_start=1, prediction_window_end=365)
_LONG = SEQUENCES_SQL + """, i AS (SELECT row_number() OVER () AS rn, person_id, t[5:] AS t FROM s), e AS (SELECT rn, person_id, generate_subscripts(t, 1) AS p, unnest(t) AS x FROM i WHERE len(t) > 0),
d AS (SELECT *, x IN ('VS', '[VS]') AS vs, regexp_matches(x, '^[DWMY][0-9]') OR x = 'LT' OR starts_with(x, 'VS-') OR (starts_with(x, 'i-') AND NOT starts_with(x, 'i-H')) AS att,
 coalesce(CASE WHEN x = 'LT' THEN 1095 WHEN starts_with(x, 'i-') OR starts_with(x, 'VS-') THEN TRY_CAST(substr(split_part(x, '-', 2), 2) AS INT) ELSE TRY_CAST(substr(x, 2) AS BIGINT) * CASE x[1] WHEN 'D' THEN 1 WHEN 'W' THEN 7 WHEN 'M' THEN 30 WHEN 'Y' THEN 365 END END, 0) AS n FROM e),
w AS (SELECT *, count(*) FILTER (vs) OVER q AS v, coalesce(sum(CASE WHEN att THEN n ELSE 0 END) OVER (PARTITION BY rn ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d WINDOW q AS (PARTITION BY rn ORDER BY p ROWS UNBOUNDED PRECEDING)),
h AS (SELECT rn, person_id, min(CASE WHEN before > 365 THEN p END) AS c, min(CASE WHEN NOT att AND v >= 1 AND before >= 0 AND x IN ('9201', '262') THEN p END) AS o FROM w GROUP BY ALL),
r AS (SELECT h.person_id, CASE WHEN c IS NOT NULL AND (o IS NULL OR c <= o) THEN '0' ELSE w.x END AS event, before AS days FROM h JOIN w ON w.rn = h.rn AND w.p = least(coalesce(c, o), coalesce(o, c)) WHERE c IS NOT NULL OR o IS NOT NULL)"""


def _hits(spark, sf_dir: str) -> DataFrame:
    s = sequences(spark, sf_dir).select("person_id", F.slice("t", 5, F.greatest(F.size("t"), F.lit(1))).alias("t"))
    return s.select("person_id", first_hit(F.col("t"), READMISSION.outcome_events, READMISSION).alias("h")).where("h is not null").select("person_id", "h.event", "h.days")


@R.query("tte_first_hit", _LONG + " SELECT person_id, event, days FROM r")
def tte_first_hit(spark, sf_dir: str) -> DataFrame:
    """First stay of each recorded sequence within a year, or its censoring."""
    return _hits(spark, sf_dir)


@R.query("tte_summary", _LONG + """, b AS (SELECT event, CASE WHEN days >= 1095 THEN 'LT' ELSE 'M' || CAST(floor(days / 30) AS INT) END AS k, count(*) AS n, min(days) AS d FROM r GROUP BY 1, 2), m AS (SELECT event, arg_max(k, (n, -d)) AS most_likely_time FROM b GROUP BY 1)
SELECT event, count(*) AS n, avg(days) AS average_time, median(days) AS median_time, stddev_pop(days) AS standard_deviation, avg((event <> '0')::INT) AS event_probability, any_value(most_likely_time) AS most_likely_time FROM r JOIN m USING (event) GROUP BY 1""")
def tte_summary(spark, sf_dir: str) -> DataFrame:
    return summarise(_hits(spark, sf_dir), ["event"])


_BUCKETS = _LONG + """, b AS (SELECT event, CASE WHEN days >= 1095 THEN 'LT' ELSE 'M' || CAST(floor(days / 30) AS INT) END AS k, count(*) AS n FROM r GROUP BY 1, 2), p AS (SELECT event, k, n / sum(n) OVER (PARTITION BY event) AS probability FROM b),
g AS (SELECT event, CASE WHEN k = 'LT' THEN '>= 1095 days' ELSE ((CAST(substr(k, 2) AS INT) + 1) * 30 // 91 * 90) || ' days - ' || (((CAST(substr(k, 2) AS INT) + 1) * 30 // 91 + 1) * 90) || ' days' END AS time_bucket, sum(probability) AS probability FROM p GROUP BY 1, 2)"""


@R.query("tte_time_buckets", _BUCKETS + " SELECT event, k AS time_interval, probability FROM p")
def tte_time_buckets(spark, sf_dir: str) -> DataFrame:
    return bucket_probabilities(_hits(spark, sf_dir), ["event"])


@R.query("tte_cumulative", _BUCKETS + " SELECT event, time_bucket, probability, sum(probability) OVER (PARTITION BY event ORDER BY round(probability, 12) DESC, time_bucket ROWS UNBOUNDED PRECEDING) AS cumulative FROM g")
def tte_cumulative(spark, sf_dir: str) -> DataFrame:
    return cumulative(bucket_probabilities(_hits(spark, sf_dir), ["event"]), ["event"])


@R.query("concept_descendants", "WITH a AS (SELECT DISTINCT domain_id, concept_id FROM concept WHERE concept_id IS NOT NULL), r AS (SELECT domain_id, min(concept_id) AS root FROM a WHERE domain_id IS NOT NULL GROUP BY 1) SELECT concept_id::VARCHAR AS concept FROM a JOIN r USING (domain_id) WHERE root IN (SELECT root FROM r WHERE domain_id IN ('Measurement', 'Visit')) UNION SELECT '[DEATH]'")
def concept_descendants(spark, sf_dir: str) -> DataFrame:
    """Outcomes expanded over a closure table (here each domain's least concept is the ancestor of the domain)."""
    a = table(spark, sf_dir, "concept").where("concept_id is not null").select("domain_id", "concept_id").distinct()
    roots = a.where("domain_id is not null").groupBy("domain_id").agg(F.min("concept_id").alias("ancestor_concept_id"))
    closure = a.join(roots, "domain_id").select("ancestor_concept_id", F.col("concept_id").alias("descendant_concept_id"))
    outcomes = roots.where(F.col("domain_id").isin("Measurement", "Visit")).select(F.col("ancestor_concept_id").cast("string").alias("concept")).union(spark.createDataFrame([("[DEATH]",)], "c string"))
    return descendants(outcomes, closure)


@R.query("resume_anti_join", "SELECT DISTINCT person_id, condition_start_date FROM condition_occurrence c WHERE person_id IS NOT NULL AND condition_start_date IS NOT NULL AND NOT EXISTS (SELECT 1 FROM visit_occurrence v WHERE v.person_id = c.person_id AND v.visit_start_date = c.condition_start_date)")
def resume_anti_join(spark, sf_dir: str) -> DataFrame:
    """Persons and condition dates that have no visit starting on that date: the two-key form of resuming."""
    todo = table(spark, sf_dir, "condition_occurrence").select("person_id", "condition_start_date").where("person_id is not null and condition_start_date is not null").distinct()
    done = table(spark, sf_dir, "visit_occurrence").select("person_id", F.col("visit_start_date").alias("condition_start_date"))
    return without_done(todo, done, ["person_id", "condition_start_date"])


def _closure(spark, sf_dir: str) -> DataFrame:
    """A stand-in for the closure table: each task's first outcome has the concepts of one domain below it."""
    c = table(spark, sf_dir, "concept").where("concept_id is not null").select("domain_id", F.col("concept_id").alias("descendant_concept_id")).distinct()
    roots = F.when(F.col("domain_id") == "Procedure", 43528001).when(F.col("domain_id") == "Condition", 316139).cast("bigint")
    return c.select(roots.alias("ancestor_concept_id"), "descendant_concept_id").where("ancestor_concept_id is not null")


def _task_sql(task: TaskConfig) -> str:
    """(task, person_id, event, days) of one task over the tokens ``w`` with visit number v and days before."""
    beyond = " OR ".join([f"v > {task.future_visit_end}"] * (task.future_visit_end != -1) + [f"before > {task.prediction_window_end}"] * (task.prediction_window_end != -1)) or "false"
    given = ", ".join(f"'{x}'" for x in task.outcome_events)
    domain = {"cabg_prediction": "Procedure", "t2dm_hf_prediction": "Condition"}.get(task.task_name, "") if task.include_descendants else ""
    hit = f"(x IN ({given}) OR x IN (SELECT concept_id::VARCHAR FROM concept WHERE domain_id = '{domain}' AND concept_id IS NOT NULL))"
    open_ = task.future_visit_end == -1 and task.prediction_window_end == -1
    return f"""SELECT '{task.task_name}' AS task, person_id, CASE WHEN o IS NULL OR c <= o THEN '0' ELSE (SELECT any_value(x) FROM w y WHERE y.rn = h.rn AND y.p = h.o) END AS event,
 CASE WHEN c IS NULL AND o IS NULL THEN total ELSE (SELECT any_value(before) FROM w y WHERE y.rn = h.rn AND y.p = least(coalesce(c, o), coalesce(o, c))) END AS days
FROM (SELECT rn, person_id, min(p) FILTER ({beyond}) AS c, min(p) FILTER (NOT att AND v >= {task.future_visit_start} AND before >= {task.prediction_window_start} AND {hit}) AS o, sum(CASE WHEN att THEN n ELSE 0 END) AS total FROM w GROUP BY ALL) h
WHERE {'true' if open_ else 'c IS NOT NULL OR o IS NOT NULL'}"""


@R.query("tte_tasks", _LONG[: _LONG.index("h AS (SELECT rn")].rstrip().rstrip(",") + ", a AS (" + " UNION ALL ".join(map(_task_sql, TASKS)) + ") SELECT task, person_id, event, CAST(days AS BIGINT) AS days FROM a")
def tte_tasks(spark, sf_dir: str) -> DataFrame:
    """First hit or censoring of every recorded sequence for each prediction task, outcomes with their descendants where the task says so."""
    s = sequences(spark, sf_dir).select("person_id", F.slice("t", 5, F.greatest(F.size("t"), F.lit(1))).alias("t")).where("size(t) > 0")
    closure = _closure(spark, sf_dir)
    each = F.array(*[F.struct(F.lit(x.task_name).alias("task"), first_hit(F.col("t"), outcomes_of(x, spark, closure), x).alias("h")) for x in TASKS])
    return s.select("person_id", F.explode(each).alias("x")).where("x.h is not null").select("x.task", "person_id", "x.h.event", F.col("x.h.days").cast("bigint").alias("days"))


@R.query("tte_prompts", SEQUENCES_SQL + ", l AS (SELECT person_id, t, list_position([CASE WHEN x IN ('VS', '[VS]') THEN 's' ELSE '' END FOR x IN list_slice(t, len(t) - 63, len(t))], 's') AS k FROM s) SELECT person_id, array_to_string(CASE WHEN len(t) < 64 THEN t ELSE list_slice(t, len(t) - 64 + greatest(coalesce(k, 0), 1), len(t)) END, ' ') AS t FROM l")
def tte_prompts(spark, sf_dir: str) -> DataFrame:
    return sequences(spark, sf_dir).select("person_id", F.array_join(prompt_truncation(F.col("t"), 64), " ").alias("t"))


@R.query("tte_prompts_with_header", SEQUENCES_SQL + ", l AS (SELECT person_id, t, list_position([CASE WHEN x IN ('VS', '[VS]') THEN 's' ELSE '' END FOR x IN list_slice(t, len(t) - 59, len(t))], 's') AS k FROM s) SELECT person_id, array_to_string(CASE WHEN len(t) < 64 THEN t ELSE list_concat(t[:4], list_slice(t, len(t) - 60 + greatest(coalesce(k, 0), 1), len(t))) END, ' ') AS t FROM l")
def tte_prompts_with_header(spark, sf_dir: str) -> DataFrame:
    """As tte_prompts, with the four header tokens before the most recent ones."""
    return sequences(spark, sf_dir).select("person_id", F.array_join(prompt_truncation(F.col("t"), 64, 4), " ").alias("t"))
