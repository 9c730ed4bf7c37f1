"""Areas under curves and other measures of binary predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..plans.registry import Registry
from ..plans.runtime import persisted, table


def curve(rows: DataFrame, score: str, label: str) -> DataFrame:
    """``score, p, n``: positives and negatives of each distinct score; null scores and labels are left out.

    Everything else works on this table, so equal scores are one step of the curve.
    """
    r = rows.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    return r.groupBy(F.col(score).cast("double").alias("score")).agg(F.sum((F.col(label) > 0).cast("bigint")).alias("p"), F.sum((F.col(label) <= 0).cast("bigint")).alias("n"))


def _cumulated(c: DataFrame) -> DataFrame:
    """Adds ``tp, fp``: positives and negatives with a higher or the same score, by partial sums of range-sorted partitions."""
    from ..plans.runtime import checkpointed, partitions
    from pyspark.sql import Window

    spark = c.sparkSession
    part = checkpointed(c.repartitionByRange(partitions(spark), F.desc("score")).sortWithinPartitions(F.desc("score"))).withColumn("_p", F.spark_partition_id())
    sums = sorted(tuple(r) for r in part.groupBy("_p").agg(F.sum("p"), F.sum("n")).collect())
    p = n = 0
    base = []
    for i, a, b in sums:
        base.append((i, p, n))
        p, n = p + a, n + b
    known = spark.createDataFrame(base, "_p int, _a bigint, _b bigint")
    by = Window.partitionBy("_p").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    return part.join(F.broadcast(known), "_p").select("score", "p", "n", (F.sum("p").over(by) + F.col("_a")).alias("tp"), (F.sum("n").over(by) + F.col("_b")).alias("fp"))


def roc_auc(rows: DataFrame, score: str, label: str) -> DataFrame:
    """One row ``roc_auc``: the share of pairs of a positive and a negative in the right order, ties half; null without both kinds."""
    c = _cumulated(persisted(curve(rows, score, label), "curve"))
    a = c.agg(F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2.0)).alias("x"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return a.select(F.try_divide(F.col("x"), F.col("p") * F.col("n")).alias("roc_auc"))


def pr_auc(rows: DataFrame, score: str, label: str) -> DataFrame:
    """One row ``pr_auc``: trapezoids under precision over recall, from recall 0 at precision 1."""
    from pyspark.sql import Window

    c = _cumulated(persisted(curve(rows, score, label), "curve"))
    # The step before is known from the row itself.
    before_tp, before_fp = F.col("tp") - F.col("p"), F.col("fp") - F.col("n")
    now = F.col("tp") / (F.col("tp") + F.col("fp"))
    last = F.coalesce(F.try_divide(before_tp, before_tp + before_fp), F.lit(1.0))
    a = c.agg(F.sum(F.col("p") * (now + last) / 2.0).alias("x"), F.sum("p").alias("p"))
    return a.select(F.try_divide(F.col("x"), F.col("p")).alias("pr_auc"))


R = Registry()
# Visits that are stays.
STAYS = (9201, 262, 8971, 8920)


def prediction_table(rows: DataFrame) -> DataFrame:
    """The output of a prediction: ``subject_id, prediction_time, predicted_boolean_probability, predicted_boolean_value, boolean_value``; null without a probability."""
    p = F.col("probability").cast("double")
    return rows.select(F.col("person_id").cast("bigint").alias("subject_id"), "prediction_time", p.alias("predicted_boolean_probability"), (p >= 0.5).cast("int").alias("predicted_boolean_value"), F.col("label").cast("int").alias("boolean_value"))


_PREDICTIONS = f"""WITH v AS (SELECT DISTINCT visit_occurrence_id, person_id, visit_concept_id, visit_start_datetime FROM visit_occurrence WHERE visit_occurrence_id IS NOT NULL AND person_id IS NOT NULL AND visit_concept_id IS NOT NULL AND visit_start_datetime IS NOT NULL),
w AS (SELECT *, lag(visit_concept_id) OVER q AS before, lead(visit_concept_id) OVER q IS NULL AS latest, (visit_concept_id IN {STAYS})::INT AS y FROM v WINDOW q AS (PARTITION BY person_id ORDER BY visit_start_datetime, visit_occurrence_id, visit_concept_id)),
pr AS (SELECT before, avg(y) AS probability FROM w WHERE before IS NOT NULL AND NOT latest GROUP BY 1),
pt AS (SELECT person_id AS subject_id, visit_start_datetime AS prediction_time, round(probability, 6) AS predicted_boolean_probability, (round(probability, 6) >= 0.5)::INT AS predicted_boolean_value, y AS boolean_value FROM w JOIN pr USING (before) WHERE latest)"""
_SCORES = _PREDICTIONS + """, s AS (SELECT boolean_value AS label, predicted_boolean_probability AS score FROM pt),
c AS (SELECT score, sum((label > 0)::INT) AS p, sum((label <= 0)::INT) AS n FROM s GROUP BY 1), k AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp FROM c WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"""


def _predictions(spark, sf_dir: str) -> DataFrame:
    """Whether each person's last visit is a stay, predicted from the visit before it by how often stays follow such visits earlier on."""
    from pyspark.sql import Window

    c = ["visit_occurrence_id", "person_id", "visit_concept_id", "visit_start_datetime"]
    v = table(spark, sf_dir, "visit_occurrence").select(*c).dropna().distinct()
    by = Window.partitionBy("person_id").orderBy("visit_start_datetime", "visit_occurrence_id", "visit_concept_id")
    w = persisted(v.withColumns({"before": F.lag("visit_concept_id").over(by), "latest": F.lead("visit_concept_id").over(by).isNull(), "label": F.col("visit_concept_id").isin(*STAYS).cast("int")}).where("before is not null"), "visits")
    share = w.where("not latest").groupBy("before").agg(F.round(F.avg("label"), 6).alias("probability"))
    return prediction_table(w.where("latest").withColumnRenamed("visit_start_datetime", "prediction_time").join(share, "before"))


@R.query("prediction_table", _PREDICTIONS + " SELECT * FROM pt")
def prediction_table_query(spark, sf_dir: str) -> DataFrame:
    """The prediction table, written and read again."""
    return persisted(_predictions(spark, sf_dir), "predictions")


def _scores(spark, sf_dir: str) -> DataFrame:
    return prediction_table_query(spark, sf_dir).select(F.col("boolean_value").alias("label"), F.col("predicted_boolean_probability").alias("score"))


@R.query("roc_auc", _SCORES + " SELECT sum(n * (tp - p / 2.0)) / nullif(sum(p) * sum(n), 0) AS roc_auc FROM k")
def roc_auc_query(spark, sf_dir: str) -> DataFrame:
    return roc_auc(_scores(spark, sf_dir), "score", "label")


@R.query("pr_auc", _SCORES + " SELECT sum(p * (tp / (tp + fp) + coalesce((tp - p) / nullif(tp - p + fp - n, 0), 1)) / 2.0) / nullif(sum(p), 0) AS pr_auc FROM k")
def pr_auc_query(spark, sf_dir: str) -> DataFrame:
    return pr_auc(_scores(spark, sf_dir), "score", "label")


@R.query("classification_metrics", _SCORES + ", x AS (SELECT (score >= 0.5)::INT AS p, (label > 0)::INT AS l FROM s), g AS (SELECT sum(p * l) AS tp, sum(p) AS p, sum(l) AS l, count(*) AS n, sum((p = l)::INT) AS ok FROM x) SELECT ok / n AS accuracy, coalesce(tp / nullif(p, 0), 0) AS precision, coalesce(tp / nullif(l, 0), 0) AS recall, coalesce(2 * tp / nullif(p + l, 0), 0) AS f1 FROM g")
def classification_metrics_query(spark, sf_dir: str) -> DataFrame:
    from .privacy import classification_metrics

    s = _scores(spark, sf_dir)
    return classification_metrics(s.select((F.col("score") >= 0.5).cast("int").alias("pred"), (F.col("label") > 0).cast("int").alias("label")))
