"""Derived tables: condition eras and observation periods."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from ..plans.registry import Registry
from ..plans.runtime import table
from ..plans.skew import global_rank

ERA_GAP_DAYS = 30
PERIOD_TYPE = 44814725
#: Dates outside are taken as spurious; recent periods are lifted to ``as_of``.
FIRST_YEAR, RECENT_MONTHS = 1985, 12
AS_OF = "2026-06-30"


def condition_era(conditions: DataFrame, gap_days: int = ERA_GAP_DAYS, by_type: bool = False) -> DataFrame:
    """Eras of each person, concept and condition type: start, end and the number of distinct start dates.

    A null end is the day after the start. A condition that starts at most
    ``gap_days`` after the latest end before it continues the era, across types;
    eras of several types give a row each, with the common end. Rows without
    person, concept or start give nothing; repeated rows count once.

    One shuffle by (person, concept): running maximum of the ends, a count of
    breaks, and an aggregate on the same partitioning; no range join.
    """
    key = ["person_id", "condition_concept_id"]
    rows = conditions.select(*key, "condition_type_concept_id", F.col("condition_start_date").alias("s"), F.coalesce("condition_end_date", F.date_add("condition_start_date", 1)).alias("e")).where("person_id is not null and condition_concept_id is not null and s is not null")
    by = Window.partitionBy(*key).orderBy("s", "e")
    before = F.max("e").over(by.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(before.isNull() | (F.col("s") > F.date_add(before, gap_days)), 1).otherwise(0)
    marked = rows.withColumn("new", new).withColumn("era", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    eras = marked.groupBy(*key, "era", "condition_type_concept_id").agg(F.min("s").alias("condition_era_start_date"), F.max("e").alias("e"), F.count_distinct("s").cast("bigint").alias("condition_occurrence_count"))
    end = F.max("e").over(Window.partitionBy(*key, "era"))
    return eras.select(*key, *(["condition_type_concept_id"] if by_type else []), "condition_era_start_date", end.alias("condition_era_end_date"), "condition_occurrence_count")


@dataclass(frozen=True)
class Domain:
    """A table whose dates widen the observation period."""

    name: str
    start: str
    end: str


DOMAINS = [Domain("visit_occurrence", "visit_start_date", "visit_end_date"), Domain("condition_occurrence", "condition_start_date", "condition_start_date"), Domain("procedure_occurrence", "procedure_date", "procedure_date"), Domain("drug_exposure", "drug_exposure_start_date", "drug_exposure_start_date")]
MEASUREMENT = Domain("measurement", "measurement_date", "measurement_date")


def observation_period(person: DataFrame, tables: dict[str, DataFrame], domains: list[Domain], as_of: str = AS_OF) -> DataFrame:
    """First and last date of each person over the given domain tables; ends of the last year are lifted to ``as_of``.

    Domains without a table are left out. Dates before 1985 or after ``as_of``
    and persons unknown to ``person`` give nothing; so do persons whose ends are all null.
    One shuffle of partial aggregates serves all domains.
    """
    today = F.lit(as_of).cast("date")
    used = [d for d in domains if d.name in tables]
    rows = None
    for i, d in enumerate(used):
        one = tables[d.name].select("person_id", F.lit(i).alias("i"), F.col(d.start).cast("date").alias("s"), F.col(d.end).cast("date").alias("e")).where((F.col("s") >= F.lit(f"{FIRST_YEAR}-01-01").cast("date")) & (F.col("s") <= today) & F.col("person_id").isNotNull())
        rows = one if rows is None else rows.unionAll(one)
    # One aggregate for all domains, with map-side combine: a domain whose ends are all null does not count, so each keeps its own bounds.
    bounds = rows.groupBy("person_id").agg(*[f(F.when(F.col("i") == i, F.col(c))).alias(f"{c}{i}") for i in range(len(used)) for c, f in (("s", F.min), ("e", F.max))])
    starts = [F.when(F.col(f"e{i}").isNotNull(), F.col(f"s{i}")) for i in range(len(used))]
    ends = [F.col(f"e{i}") for i in range(len(used))]
    whole = bounds.select("person_id", (F.least(*starts) if len(used) > 1 else starts[0]).alias("s"), (F.greatest(*ends) if len(used) > 1 else ends[0]).alias("e")).where("e is not null")
    whole = whole.join(person.where("person_id is not null").select("person_id"), "person_id", "left_semi")
    end = F.when(F.col("e") >= F.add_months(today, -RECENT_MONTHS), today).otherwise(F.col("e"))
    return whole.select("person_id", F.col("s").alias("observation_period_start_date"), end.alias("observation_period_end_date"), F.lit(PERIOD_TYPE).alias("period_type_concept_id"))


R = Registry()
# The sweep over ordered start and padded end events, ended where as many ends as starts were met, and a range join back.
_ERA = """
WITH c AS (SELECT person_id AS p, condition_concept_id AS k, condition_type_concept_id AS ty, condition_start_date AS s, coalesce(condition_end_date, condition_start_date + 1) AS e FROM condition_occurrence
  WHERE person_id IS NOT NULL AND condition_concept_id IS NOT NULL AND condition_start_date IS NOT NULL),
ev AS (SELECT p, k, s AS d, 0 AS closing FROM c UNION ALL SELECT p, k, e + 30, 1 FROM c),
run AS (SELECT *, sum(1 - closing) OVER w AS opened, sum(closing) OVER w AS closed FROM ev WINDOW w AS (PARTITION BY p, k ORDER BY d, closing ROWS UNBOUNDED PRECEDING)),
ends AS (SELECT DISTINCT p, k, d - 30 AS e FROM run WHERE opened = closed),
x AS (SELECT c.p, c.k, c.ty, c.s, min(ends.e) AS e FROM c JOIN ends ON c.p = ends.p AND c.k = ends.k AND ends.e >= c.s GROUP BY ALL)
SELECT p AS person_id, k AS condition_concept_id, {extra} min(s) AS condition_era_start_date, e AS condition_era_end_date, count(*) AS condition_occurrence_count FROM x GROUP BY p, k, ty, e"""


@R.query("condition_era", _ERA.format(extra=""))
def condition_era_query(spark, sf_dir: str) -> DataFrame:
    return condition_era(table(spark, sf_dir, "condition_occurrence"))


@R.query("condition_era_by_type", _ERA.format(extra="ty AS condition_type_concept_id,"))
def condition_era_by_type(spark, sf_dir: str) -> DataFrame:
    return condition_era(table(spark, sf_dir, "condition_occurrence"), by_type=True)


@R.query("condition_era_numbered", "WITH q AS (" + _ERA.format(extra="ty AS condition_type_concept_id,") + """)
SELECT row_number() OVER (ORDER BY condition_concept_id, person_id, condition_era_start_date, condition_era_end_date, condition_type_concept_id NULLS FIRST, condition_occurrence_count) AS condition_era_id, * FROM q""")
def condition_era_numbered(spark, sf_dir: str) -> DataFrame:
    """Eras with a surrogate key by concept, numbered over all partitions."""
    order = [F.col(c) for c in ("condition_concept_id", "person_id", "condition_era_start_date", "condition_era_end_date", "condition_type_concept_id", "condition_occurrence_count")]
    return global_rank(condition_era_by_type(spark, sf_dir), order).select((F.col("rank") + 1).alias("condition_era_id"), *order)


def _period_sql(domains: list[Domain]) -> str:
    parts = " UNION ALL ".join(f"SELECT person_id, min({d.start}) AS s, max({d.end}) AS e FROM {d.name} WHERE year({d.start}) >= 1985 AND {d.start} <= DATE '{AS_OF}' GROUP BY 1" for d in domains)
    return f"""SELECT person_id, s AS observation_period_start_date, CASE WHEN e >= DATE '{AS_OF}' - INTERVAL 12 MONTH THEN DATE '{AS_OF}' ELSE e END AS observation_period_end_date, {PERIOD_TYPE} AS period_type_concept_id
FROM (SELECT person_id, min(s) AS s, max(e) AS e FROM ({parts}) WHERE e IS NOT NULL GROUP BY 1) WHERE person_id IN (SELECT person_id FROM person)"""


def _period(spark, sf_dir: str, domains: list[Domain]) -> DataFrame:
    return observation_period(table(spark, sf_dir, "person"), {d.name: table(spark, sf_dir, d.name) for d in domains}, domains)


@R.query("observation_period", _period_sql(DOMAINS[:2]))
def observation_period_query(spark, sf_dir: str) -> DataFrame:
    """Over visits and conditions, the domain tables at hand."""
    return _period(spark, sf_dir, DOMAINS[:2])


@R.query("observation_period_with_measurement", _period_sql([*DOMAINS[:2], MEASUREMENT]))
def observation_period_with_measurement(spark, sf_dir: str) -> DataFrame:
    return _period(spark, sf_dir, [*DOMAINS[:2], MEASUREMENT])
