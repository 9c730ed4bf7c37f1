"""Cohorts over relational tables: subsetting, merging real and synthetic data, cleaning before an upload."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.registry import Registry
from ..plans.runtime import persisted, table
from ..plans.skew import broadcast_if_small

FIRST_DATE, LAST_DATE = "1900-01-01", "9999-01-01"


def subset(tables: dict[str, DataFrame], persons: DataFrame, key: str = "person_id", existing: frozenset[str] = frozenset()) -> dict[str, DataFrame]:
    """Each table's rows of the persons of a sample (semi-join: repeated sample rows do no harm); tables in ``existing`` are skipped."""
    ids = broadcast_if_small(persons.select(key).distinct())
    return {n: d.join(ids, key, "left_semi") for n, d in tables.items() if n not in existing}


def subset_with_copies(df: DataFrame, persons: DataFrame, key: str = "person_id") -> DataFrame:
    """As an inner join: a person who is twice in the sample has all rows twice."""
    return df.join(persons.select(key), key)


def in_date_range(df: DataFrame, column: str, first: str = FIRST_DATE, last: str = LAST_DATE) -> DataFrame:
    """Rows whose date lies strictly between the bounds; null dates are left out."""
    c = F.col(column).cast("date")
    return df.where((c > F.lit(first).cast("date")) & (c < F.lit(last).cast("date")))


def cast_by_name(df: DataFrame, compat: bool = False) -> DataFrame:
    """Columns with concept_id in their name to int, with date to date, in one projection; what cannot be cast becomes null.

    ``*_datetime`` stays a timestamp; with ``compat`` it loses its time like any date.
    """

    def one(name: str) -> Column:
        if "concept_id" in name:
            return F.col(name).try_cast("int").alias(name)
        if "datetime" in name and not compat:
            return F.col(name).try_cast("timestamp_ntz").alias(name)
        if "date" in name:
            return F.col(name).try_cast("date").alias(name)
        return F.col(name)

    return df.select([one(c) for c in df.columns])


@dataclass(frozen=True)
class Merge:
    """The merged splits and the offsets of synthetic ids."""

    splits: DataFrame
    person_offset: int
    visit_offset: int


def prepare_merge(real_person: DataFrame, patient_splits: DataFrame, synthetic_person: DataFrame, real_visits: DataFrame, test_only: bool = False) -> Merge:
    """``person_id, split, is_real, new_person_id``: synthetic persons are train and get ids above all real ones; real ones keep theirs.

    The offsets are the greatest real ids before any filter. ``test_only`` keeps real persons of the test split.
    """
    real = real_person.select("person_id").join(patient_splits.select("person_id", "split"), "person_id").withColumn("is_real", F.lit(1))
    top = real.agg(F.max("person_id")).first()[0] or 0
    visit_top = real_visits.agg(F.max("visit_occurrence_id")).first()[0] or 0
    if test_only:
        real = real.where("split = 'test'")
    synthetic = synthetic_person.select("person_id").withColumn("split", F.lit("train")).withColumn("is_real", F.lit(0))
    both = real.unionByName(synthetic)
    new = F.when(F.col("is_real") == 1, F.col("person_id")).otherwise(F.col("person_id") + F.lit(top))
    return Merge(persisted(both.withColumn("new_person_id", new), "splits"), top, visit_top)


def merge_table(real: DataFrame, synthetic: DataFrame, merge: Merge, synthetic_visits: DataFrame | None = None) -> DataFrame:
    """Rows of both with the common columns, ``is_real, split, original_person_id`` and new person and visit ids.

    Synthetic visit ids are shifted above the real ones; with ``synthetic_visits``
    given, rows whose visit is null or unknown there are left out.
    """
    common = [c for c in synthetic.columns if c in real.columns]

    def one(df: DataFrame, flag: int) -> DataFrame:
        s = merge.splits.where(F.col("is_real") == flag)
        return df.select(common).join(s, "person_id").withColumnRenamed("person_id", "original_person_id").withColumnRenamed("new_person_id", "person_id")

    b = one(synthetic, 0)
    if "visit_occurrence_id" in common:
        if synthetic_visits is not None:
            b = b.join(synthetic_visits.select("visit_occurrence_id").distinct(), "visit_occurrence_id", "left_semi")
        b = b.withColumn("visit_occurrence_id", F.col("visit_occurrence_id") + F.lit(merge.visit_offset))
    return one(real, 1).unionByName(b)


def looked_up(rows: DataFrame, facts: DataFrame, keys: list[str], defaults: dict[str, object]) -> DataFrame:
    """``rows`` with the columns of ``defaults`` from the row of ``facts`` of the same keys, or their default. ``facts`` must be unique on the keys; null keys meet nothing."""
    j = rows.join(broadcast_if_small(facts.select(*keys, *defaults)), keys, "left")
    return j.withColumns({c: F.coalesce(F.col(c), F.lit(d)) for c, d in defaults.items()})


def classifier_label(label: str = "label", index_date: str = "index_date") -> list[Column]:
    """``classifier_label`` (1 if the label is above 0) and the index date in seconds."""
    return [(F.coalesce(F.col(label), F.lit(0)) > 0).cast("int").alias("classifier_label"), F.unix_timestamp(F.col(index_date).cast("timestamp")).alias("index_seconds")]


R = Registry()
_T = "lower(trim(split))"


def _sample(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "patient_splits").where(F.lower(F.trim("split")) == "test").select("person_id")


@R.query("cohort_subset", f"SELECT visit_occurrence_id, v.person_id FROM visit_occurrence v JOIN (SELECT person_id FROM patient_splits WHERE {_T} = 'test') p ON p.person_id = v.person_id")
def cohort_subset(spark, sf_dir: str) -> DataFrame:
    """Visits of the test persons, once per sample row."""
    return subset_with_copies(table(spark, sf_dir, "visit_occurrence"), _sample(spark, sf_dir)).select("visit_occurrence_id", "person_id")


@R.query("cohort_semi", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t} WHERE person_id IN (SELECT person_id FROM patient_splits WHERE {_T} = 'test')" for t in ("person", "visit_occurrence", "condition_occurrence", "measurement")))
def cohort_semi(spark, sf_dir: str) -> DataFrame:
    """Rows of each table in the cohort of the test persons."""
    names = ("person", "visit_occurrence", "condition_occurrence", "measurement")
    out = None
    for n, d in subset({n: table(spark, sf_dir, n) for n in names}, _sample(spark, sf_dir)).items():
        one = d.agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n")
        out = one if out is None else out.unionAll(one)
    return out


@R.query("cohort_anti", "SELECT DISTINCT person_id FROM person WHERE person_id NOT IN (SELECT person_id FROM patient_splits WHERE person_id IS NOT NULL)")
def cohort_anti(spark, sf_dir: str) -> DataFrame:
    """Persons without a row in patient_splits."""
    return table(spark, sf_dir, "person").select("person_id").distinct().join(table(spark, sf_dir, "patient_splits").select("person_id"), "person_id", "left_anti")


_SPLITS = """WITH u AS (SELECT person_id, min(lower(trim(split))) AS split FROM patient_splits WHERE person_id IS NOT NULL GROUP BY 1), p AS (SELECT DISTINCT person_id FROM person),
r AS (SELECT p.person_id, split FROM p JOIN u USING (person_id)), top AS (SELECT max(person_id) AS m FROM r), y AS (SELECT person_id FROM p),
m AS (SELECT person_id, split, 1 AS is_real, person_id AS new_person_id FROM r UNION ALL SELECT person_id, 'train', 0, person_id + (SELECT m FROM top) FROM y)"""


def _merge(spark, sf_dir: str, test_only: bool = False) -> Merge:
    """The whole person table stands in for the synthetic one too."""
    p = table(spark, sf_dir, "person").select("person_id").distinct()
    s = table(spark, sf_dir, "patient_splits").where("person_id is not null").groupBy("person_id").agg(F.min(F.lower(F.trim("split"))).alias("split"))
    return prepare_merge(p, s, p, table(spark, sf_dir, "visit_occurrence"), test_only)


@R.query("patient_splits_merge", _SPLITS + " SELECT * FROM m")
def patient_splits_merge(spark, sf_dir: str) -> DataFrame:
    return _merge(spark, sf_dir).splits


@R.query("merge_real_synthetic", _SPLITS + """, v AS (SELECT max(visit_occurrence_id) AS m FROM visit_occurrence), c AS (SELECT person_id, visit_occurrence_id, condition_occurrence_id, condition_concept_id FROM condition_occurrence)
SELECT m.person_id AS original_person_id, new_person_id AS person_id, split, is_real, condition_occurrence_id, condition_concept_id, CASE WHEN is_real = 1 THEN visit_occurrence_id ELSE visit_occurrence_id + (SELECT m FROM v) END AS visit_occurrence_id
FROM c JOIN m USING (person_id) WHERE is_real = 1 OR visit_occurrence_id IN (SELECT visit_occurrence_id FROM visit_occurrence)""")
def merge_real_synthetic(spark, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "condition_occurrence").select("person_id", "visit_occurrence_id", "condition_occurrence_id", "condition_concept_id")
    return merge_table(c, c, _merge(spark, sf_dir), table(spark, sf_dir, "visit_occurrence"))


@R.query("merge_test_only", _SPLITS + " SELECT split, is_real, count(*) AS n FROM m WHERE is_real = 0 OR split = 'test' GROUP BY ALL")
def merge_test_only(spark, sf_dir: str) -> DataFrame:
    return _merge(spark, sf_dir, True).splits.groupBy("split", "is_real").agg(F.count("*").alias("n"))


@R.query("upload_clean_filter", "SELECT measurement_id, measurement_date, measurement_concept_id::INT AS measurement_concept_id, measurement_datetime FROM measurement WHERE measurement_date > DATE '1900-01-01' AND measurement_date < DATE '9999-01-01'")
def upload_clean_filter(spark, sf_dir: str) -> DataFrame:
    """Measurements in the date range, cast by their names."""
    m = table(spark, sf_dir, "measurement").select("measurement_id", "measurement_date", "measurement_concept_id", "measurement_datetime")
    return cast_by_name(in_date_range(m, "measurement_date"))


@R.query("concept_cast", "SELECT visit_occurrence_id, visit_concept_id::INT AS visit_concept_id, visit_start_date::DATE AS visit_start_date, visit_start_datetime::DATE AS visit_start_datetime FROM visit_occurrence")
def concept_cast(spark, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "visit_occurrence").select("visit_occurrence_id", "visit_concept_id", "visit_start_date", "visit_start_datetime")
    return cast_by_name(v, compat=True)


@R.query("classifier_labels", "SELECT doc_id, CASE WHEN coalesce(flagged, 0) > 0 THEN 1 ELSE 0 END AS classifier_label, epoch_us(created_at) // 1000000 AS index_seconds FROM documents JOIN review_labels USING (doc_id)")
def classifier_labels(spark, sf_dir: str) -> DataFrame:
    """Labels and index times in the form of a classifier's input."""
    d = table(spark, sf_dir, "documents").select("doc_id", "created_at").join(table(spark, sf_dir, "review_labels"), "doc_id")
    return d.select("doc_id", *classifier_label("flagged", "created_at"))


@R.query("demographics_lookup", """WITH d AS (SELECT v.person_id, v.visit_start_date AS at, max(year(v.visit_start_date) - p.year_of_birth) AS age, max(p.gender_concept_id) AS gender FROM visit_occurrence v JOIN person p ON p.person_id = v.person_id WHERE v.visit_start_date IS NOT NULL GROUP BY ALL)
SELECT condition_occurrence_id, c.person_id, condition_start_date AS at, coalesce(age, 0) AS age, coalesce(gender, 0) AS gender FROM condition_occurrence c LEFT JOIN d ON d.person_id = c.person_id AND d.at = c.condition_start_date""")
def demographics_lookup(spark, sf_dir: str) -> DataFrame:
    """Age and gender at each condition from the person's visit on that date, 0 without one."""
    p, v = table(spark, sf_dir, "person").select("person_id", "year_of_birth", "gender_concept_id"), table(spark, sf_dir, "visit_occurrence").where("visit_start_date is not null")
    d = v.join(p, "person_id").groupBy("person_id", F.col("visit_start_date").alias("at")).agg(F.max(F.year("visit_start_date") - F.col("year_of_birth")).alias("age"), F.max("gender_concept_id").alias("gender"))
    c = table(spark, sf_dir, "condition_occurrence").select("condition_occurrence_id", "person_id", F.col("condition_start_date").alias("at"))
    return looked_up(c, d, ["person_id", "at"], {"age": 0, "gender": 0})
