"""Statistics, bins and units of lab values."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import tokens as tk
from ..plans.registry import Registry
from ..plans.runtime import persisted, table
from ..plans.skew import broadcast_if_small, global_rank
from .splits import uniform

BINS, FREEDOM, OUTLIER_STD = 10, 3, 2.0
NA = "N/A"


def normal_cdf(x: float) -> float:
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


def numeric_values(seqs: DataFrame, tokens: str = "concept_ids", masks: str = "value_indicators", values: str = "values", units: str = "units") -> DataFrame:
    """``concept_id, unit, value`` of marked positions whose number is finite and not 0; a null unit is N/A, blanks around concepts are cut, null concepts left out."""
    z = F.filter(F.arrays_zip(tokens, masks, values, F.coalesce(units, F.array().cast("array<string>")).alias(units)), lambda x: (x[masks] == 1) & x[values].isNotNull() & ~F.isnan(x[values]) & (F.abs(x[values]) < float("inf")) & (x[values] != 0))
    rows = seqs.select(F.explode(z).alias("x")).select(F.btrim(f"x.{tokens}", F.lit(tk.BLANKS)).alias("concept_id"), F.coalesce(f"x.{units}", F.lit(NA)).alias("unit"), F.col(f"x.{values}").cast("double").alias("value"))
    return rows.where("concept_id is not null")


KEY = ["concept_id", "unit"]


def ranked(values: DataFrame) -> DataFrame:
    """Adds the 0-based ``r`` of each value within its (concept, unit) and the group's size ``n``.

    One range sort over all partitions ranks everything, so a group of any
    size is spread; groups only contribute a start and a count.
    """
    # A number of its own makes the order total, so that one value that many rows share is spread too; ranks of ties may change places.
    rows = values.select(*KEY, "value").withColumn("_row", F.monotonically_increasing_id())
    all_ = global_rank(rows, [F.col("concept_id"), F.col("unit"), F.col("value"), F.col("_row")]).drop("_row")
    g = all_.groupBy(*KEY).agg(F.min("rank").alias("s"), F.count("*").alias("n"))
    return all_.join(broadcast_if_small(g), KEY).select(*KEY, "value", (F.col("rank") - F.col("s")).alias("r"), "n")


def _quantile(q: float) -> Column:
    """Linear interpolation between the two ranks around q * (n - 1)."""
    at = F.lit(q) * (F.col("n") - 1)
    low = F.floor(at)
    part = at - low
    v = F.when(F.col("r") == low, F.col("value") * (1 - part)).otherwise(0.0) + F.when((F.col("r") == low + 1), F.col("value") * part).otherwise(0.0)
    return F.sum(v)


def trimmed(r: DataFrame, std: float = OUTLIER_STD) -> DataFrame:
    """Values within the quantiles of a normal's -std and +std, both inclusive, with the rank ``r`` and number ``total`` before."""
    q = r.groupBy(*KEY).agg(_quantile(normal_cdf(-std)).alias("lo"), _quantile(normal_cdf(std)).alias("hi"))
    eps = 1e-9  # the interpolation's rounding must not drop the bound itself
    return r.join(broadcast_if_small(q), KEY).where((F.col("value") >= F.col("lo") - eps * F.abs("lo")) & (F.col("value") <= F.col("hi") + eps * F.abs("hi"))).select(*KEY, "value", "r", F.col("n").alias("total"))


def numeric_stats(values: DataFrame) -> DataFrame:
    """``n, mean, std`` (population) per concept and unit over all values: one aggregate with map-side combine."""
    return values.groupBy(*KEY).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def lab_bins(trimmed_values: DataFrame, bins: int = BINS, freedom: int = FREEDOM) -> DataFrame:
    """Statistics with bins of equal counts: ``concept_id, unit, mean, std, count, bins[bin_index, start_val, end_val]``.

    Edges are the values at ranks k * (n // bins), the outer ones infinite;
    groups with fewer than bins * (freedom + 1) values have none and are left out.
    """
    if "r" in trimmed_values.columns:  # what is left of ranked values is a stretch of their ranks
        g = trimmed_values.groupBy(*KEY).agg(F.min("r").alias("low"), F.count("*").alias("n"))
        r = trimmed_values.join(broadcast_if_small(g), KEY).select(*KEY, "value", (F.col("r") - F.col("low")).alias("r"), "n")
    else:
        r = ranked(trimmed_values.select(*KEY, "value"))
    step = F.floor(F.col("n") / bins)
    stats = trimmed_values.groupBy(*KEY).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.first("total").alias("count"))
    edges = r.where((F.col("n") >= bins * (freedom + 1)) & (F.col("r") % step == 0) & (F.col("r") > 0) & (F.col("r") < step * bins)).groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("r", "value"))).value.alias("e"))
    inf = float("inf")
    at = F.concat(F.array(F.lit(-inf)), "e", F.array(F.lit(inf)))
    b = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.struct(i.alias("bin_index"), at[i].alias("start_val"), at[i + 1].alias("end_val")))
    return stats.join(edges, KEY).select(*KEY, "mean", "std", "count", b.alias("bins"))


def bin_of(value: Column, bins: Column) -> Column:
    """``BIN:k`` of the first bin that holds the value (on an edge the lower one), BIN:unknown without one."""
    hit = F.get(F.filter(bins, lambda b: (b["start_val"] <= value) & (value <= b["end_val"])), F.lit(0))
    return F.coalesce(tk.value_bin(hit["bin_index"]), F.lit("BIN:unknown"))


def assign_bins(values: DataFrame, stats: DataFrame) -> DataFrame:
    """Adds ``bin`` to (concept_id, unit, value); groups without statistics are BIN:unknown. Statistics must be unique per group."""
    return values.join(broadcast_if_small(stats.select(*KEY, "bins")), KEY, "left").withColumn("bin", bin_of(F.col("value"), F.col("bins"))).drop("bins")


def value_of_bin(index: Column, bins: Column, u: Column) -> Column:
    """A value of the bin for a draw u in [0, 1): linear between its edges; outer bins reach as far beyond as their neighbour is wide. Null without bins."""
    b = F.get(bins, index)
    near = F.get(bins, F.when(index == 0, 1).otherwise(index - 1))
    width = F.when(F.abs(near["end_val"] - near["start_val"]) < float("inf"), near["end_val"] - near["start_val"]).otherwise(0.0)
    low = F.when(b["start_val"] > -float("inf"), b["start_val"]).otherwise(b["end_val"] - width)
    high = F.when(b["end_val"] < float("inf"), b["end_val"]).otherwise(b["start_val"] + width)
    return F.when((index >= 0) & b.isNotNull(), low + (high - low) * u)


def sample_bins(stats: DataFrame, per_bin: int, seed: int = 0) -> DataFrame:
    """``per_bin`` draws from each bin of each group, by hashes."""
    u = uniform("concept_id", "unit", "i", "k", seed=seed)
    rows = stats.select(*KEY, "bins", F.posexplode("bins").alias("i", "b")).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(per_bin))))
    return rows.select(*KEY, F.col("i").alias("bin_index"), "k", value_of_bin(F.col("i"), F.col("bins"), u).alias("value"))


def merge_stats(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pooled ``n, mean, std`` (population) of two tables of statistics; groups of one side only are kept. Associative, so loads merge in any order."""
    both = a.select(*KEY, "n", "mean", "std").unionByName(b.select(*KEY, "n", "mean", "std")).where("n > 0")
    mean = F.sum(F.col("n") * F.col("mean")) / F.sum("n")
    square = F.sum(F.col("n") * (F.col("std") * F.col("std") + F.col("mean") * F.col("mean"))) / F.sum("n")
    return both.groupBy(*KEY).agg(F.sum("n").alias("n"), mean.alias("mean"), F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("std"))


def merge_counts(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of counts ``n`` per key of both tables."""
    return a.unionByName(b).groupBy(*keys).agg(F.sum("n").alias("n"))


#: Values drawn from each side when bins are fitted anew.
REFIT_DRAWS = 10_000


def merge_bins(a: DataFrame, b: DataFrame, draws: int = REFIT_DRAWS, bins: int = BINS) -> DataFrame:
    """``concept_id, unit, bins`` of two tables of statistics: groups of both are fitted anew on as many draws from either, whatever their counts; others keep theirs."""
    both = a.select(*KEY).join(b.select(*KEY), KEY)
    per = draws // bins
    sides = [sample_bins(x.join(both, KEY, "left_semi"), per, seed) for seed, x in enumerate((a, b))]
    drawn = sides[0].unionByName(sides[1]).select(*KEY, "value").withColumn("total", F.lit(2 * draws).cast("bigint"))
    fitted = lab_bins(drawn).select(*KEY, "bins")
    rest = [x.join(both, KEY, "left_anti").select(*KEY, "bins") for x in (a, b)]
    return fitted.unionByName(rest[0]).unionByName(rest[1])


def unit_distribution(stats: DataFrame) -> DataFrame:
    """``p`` of each unit of a concept, and the cumulative share below it (for draws)."""
    by = Window.partitionBy("concept_id")
    upto = by.orderBy("unit").rowsBetween(Window.unboundedPreceding, -1)
    return stats.select(*KEY, (F.col("n") / F.sum("n").over(by)).alias("p"), (F.coalesce(F.sum("n").over(upto), F.lit(0)) / F.sum("n").over(by)).alias("below"))


def random_unit(concepts: DataFrame, distribution: DataFrame, seed: int = 0) -> DataFrame:
    """``key, concept_id, unit`` drawn by the distribution; N/A for a concept without units."""
    u = uniform("key", "concept_id", seed=seed)
    rows = concepts.withColumn("u", u).join(broadcast_if_small(distribution), "concept_id", "left")
    hit = F.col("unit").isNull() | ((F.col("u") >= F.col("below")) & (F.col("u") < F.col("below") + F.col("p")))
    return rows.groupBy("key", "concept_id").agg(F.coalesce(F.max(F.when(hit, F.col("unit"))), F.lit(NA)).alias("unit"))


def value_token(mask: Column, number: Column, text: Column, bin_: Column) -> Column:
    """A position's value token: BIN:NONE where unmarked, the bin of a number, else the text itself."""
    return F.when(F.coalesce(mask, F.lit(0)) != 1, "BIN:NONE").when(number.isNotNull() | text.isNull(), F.coalesce(bin_, F.lit("BIN:unknown"))).otherwise(text)


def normalised_values(rows: DataFrame, stats: DataFrame, distribution: DataFrame, seed: int = 0) -> DataFrame:
    """Generated (key, pos, concept_id, token) to ``key, pos, concept_id, number, text, is_numeric, unit``, up to the first [END] of each key.

    For a bin a unit of the concept is drawn and, if the concept has bins in
    that unit, a number of the bin; else the number stays null. A token of
    digits is kept as text. Where the token is no bin, the unit is N/A.
    """
    end = rows.where(F.col("concept_id") == tk.END).groupBy("key").agg(F.min("pos").alias("_end"))
    kept = rows.join(end, "key", "left").where(F.col("_end").isNull() | (F.col("pos") < F.col("_end"))).drop("_end")
    binned = tk.is_value_bin(F.col("token"))
    u = uniform("key", "pos", "concept_id", seed=seed)
    # One row of units and shares for each concept, drawn from in place.
    units = distribution.groupBy("concept_id").agg(F.array_sort(F.collect_list(F.struct("unit", "p", "below"))).alias("_units"))
    j = kept.join(broadcast_if_small(units), "concept_id", "left")
    drawn = F.get(F.filter("_units", lambda x: (u >= x["below"]) & (u < x["below"] + x["p"])), F.lit(0))["unit"]
    j = j.withColumn("unit", F.when(binned, F.coalesce(drawn, F.lit(NA))).otherwise(NA)).drop("_units")
    j = j.join(broadcast_if_small(stats.select(*KEY, "bins")), KEY, "left")
    index = F.regexp_extract("token", "^BIN:([0-9]+)$", 1).try_cast("int")
    number = F.when(binned & (index < F.size("bins")), value_of_bin(index, F.col("bins"), uniform("key", "pos", "concept_id", seed=seed + 1)))
    text = F.when(F.col("token").rlike("^[0-9]+$"), F.col("token"))
    return j.select("key", "pos", "concept_id", number.alias("number"), text.alias("text"), number.isNotNull().cast("int").alias("is_numeric"), "unit")


R = Registry()
_T = "trim({}, ' ' || chr(9) || chr(10) || chr(13))"
_VALUES = f"""
WITH x AS (SELECT {_T.format('unnest(concept_ids)')} AS concept_id, coalesce(unnest(units), 'N/A') AS unit, unnest("values") AS value, unnest(value_indicators) AS m FROM processed_dataset),
f AS (SELECT concept_id, unit, value FROM x WHERE m = 1 AND value IS NOT NULL AND isfinite(value) AND value <> 0 AND concept_id IS NOT NULL)"""
_TRIMMED = _VALUES + f""", q AS (SELECT concept_id, unit, count(*) AS total, quantile_cont(value, {normal_cdf(-OUTLIER_STD)!r}) AS lo, quantile_cont(value, {normal_cdf(OUTLIER_STD)!r}) AS hi FROM f GROUP BY ALL),
t AS (SELECT f.*, total FROM f JOIN q USING (concept_id, unit) WHERE value >= lo - 1e-9 * abs(lo) AND value <= hi + 1e-9 * abs(hi))"""
_BINS = _TRIMMED + f""", r AS (SELECT *, row_number() OVER (PARTITION BY concept_id, unit ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY concept_id, unit) AS n FROM t),
e AS (SELECT concept_id, unit, r // (n // {BINS}) AS k, value FROM r WHERE n >= {BINS * (FREEDOM + 1)} AND r % (n // {BINS}) = 0 AND r > 0 AND r < n // {BINS} * {BINS}),
b AS (SELECT DISTINCT concept_id, unit, unnest(range({BINS})) AS bin_index FROM e),
bins AS (SELECT b.*, coalesce(l.value, '-inf'::DOUBLE) AS start_val, coalesce(h.value, 'inf'::DOUBLE) AS end_val FROM b LEFT JOIN e l ON l.concept_id = b.concept_id AND l.unit = b.unit AND l.k = bin_index LEFT JOIN e h ON h.concept_id = b.concept_id AND h.unit = b.unit AND h.k = bin_index + 1)"""


def _values(spark, sf_dir: str) -> DataFrame:
    return numeric_values(table(spark, sf_dir, "processed_dataset"))


def _stats(spark, sf_dir: str) -> DataFrame:
    return lab_bins(trimmed(ranked(_values(spark, sf_dir))))


@R.query("lab_numeric_stats", _VALUES + " SELECT concept_id, unit, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS std FROM f GROUP BY ALL")
def lab_numeric_stats(spark, sf_dir: str) -> DataFrame:
    return numeric_stats(_values(spark, sf_dir))


@R.query("lab_trimmed_stats", _TRIMMED + " SELECT concept_id, unit, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS std, any_value(total) AS total FROM t GROUP BY ALL")
def lab_trimmed_stats(spark, sf_dir: str) -> DataFrame:
    t = trimmed(ranked(_values(spark, sf_dir)))
    return t.groupBy(*KEY).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.first("total").alias("total"))


@R.query("lab_bins", _BINS + " SELECT * FROM bins")
def lab_bins_query(spark, sf_dir: str) -> DataFrame:
    return _stats(spark, sf_dir).select(*KEY, F.inline("bins"))


@R.query("lab_bin_assign", _BINS + """, a AS (SELECT f.concept_id, f.unit, f.value, min(bin_index) AS k FROM f LEFT JOIN bins ON f.concept_id = bins.concept_id AND f.unit = bins.unit AND value BETWEEN start_val AND end_val GROUP BY ALL),
c AS (SELECT concept_id, unit, value, count(*) AS m FROM f GROUP BY ALL)
SELECT concept_id, unit, coalesce('BIN:' || k, 'BIN:unknown') AS bin, sum(m) AS n FROM a JOIN c USING (concept_id, unit, value) GROUP BY ALL""")
def lab_bin_assign(spark, sf_dir: str) -> DataFrame:
    """How many values of each group fall into each bin."""
    return assign_bins(_values(spark, sf_dir), persisted(_stats(spark, sf_dir), "stats")).groupBy(*KEY, "bin").agg(F.count("*").alias("n"))


_EDGES = f"""ed AS (SELECT b.concept_id, b.unit, b.bin_index, CASE WHEN b.bin_index = 0 THEN b.end_val - (n.end_val - n.start_val) ELSE b.start_val END AS lo, CASE WHEN b.bin_index = {BINS - 1} THEN b.start_val + (n.end_val - n.start_val) ELSE b.end_val END AS hi
 FROM bins b JOIN bins n ON b.concept_id = n.concept_id AND b.unit = n.unit AND n.bin_index = CASE WHEN b.bin_index = 0 THEN 1 ELSE b.bin_index - 1 END)"""
_UNITS = """ud AS (SELECT concept_id, unit, count(*) / sum(count(*)) OVER (PARTITION BY concept_id) AS p, coalesce(sum(count(*)) OVER (PARTITION BY concept_id ORDER BY unit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(count(*)) OVER (PARTITION BY concept_id) AS below FROM f GROUP BY concept_id, unit)"""


def _u(keys: str, seed: int) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', {keys}, '{seed}')), 1, 12))::BIGINT + 0.5) / 281474976710656.0"


@R.query("lab_bin_samples", _BINS + f", {_EDGES}, k AS (SELECT *, unnest(range(1, 101)) AS k FROM ed) SELECT concept_id, unit, bin_index, k, round(lo + (hi - lo) * {_u('concept_id, unit, bin_index::VARCHAR, k::VARCHAR', 0)}, 4) AS value FROM k")
def lab_bin_samples(spark, sf_dir: str) -> DataFrame:
    """A hundred draws from each bin."""
    return sample_bins(_stats(spark, sf_dir), 100).withColumn("value", F.round("value", 4))


_MERGE = """WITH a AS (SELECT trim(concept_id, ' ' || chr(9) || chr(10) || chr(13)) AS concept_id, coalesce(unit, 'N/A') AS unit, count AS n, mean, std FROM (SELECT DISTINCT concept_id, unit, count, mean, std FROM lab_stats WHERE concept_id IS NOT NULL) WHERE count > 0),"""


@R.query("lab_stats_merge", _VALUES.replace("\nWITH ", _MERGE + " ") + """, b AS (SELECT concept_id, unit, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS std FROM f GROUP BY ALL), u AS (SELECT * FROM a UNION ALL SELECT * FROM b)
SELECT concept_id, unit, sum(n) AS n, sum(n * mean) / sum(n) AS mean, sqrt(greatest(sum(n * (std * std + mean * mean)) / sum(n) - (sum(n * mean) / sum(n)) ** 2, 0)) AS std FROM u GROUP BY ALL""")
def lab_stats_merge(spark, sf_dir: str) -> DataFrame:
    """The earlier cohort's statistics pooled with those of the sequences."""
    old = table(spark, sf_dir, "lab_stats").where("concept_id is not null").select("concept_id", "unit", "count", "mean", "std").distinct()
    old = old.select(F.btrim("concept_id", F.lit(tk.BLANKS)).alias("concept_id"), F.coalesce("unit", F.lit(NA)).alias("unit"), F.col("count").alias("n"), "mean", "std")
    return merge_stats(old, numeric_stats(_values(spark, sf_dir)))


@R.query("lab_categorical_stats", "SELECT measurement_concept_id AS concept_id, value_source_value AS value, count(*) AS n FROM measurement WHERE coalesce(value_source_value, '') <> '' AND measurement_concept_id IS NOT NULL GROUP BY ALL")
def lab_categorical_stats(spark, sf_dir: str) -> DataFrame:
    """How often each concept has each text value."""
    m = table(spark, sf_dir, "measurement").where("value_source_value <> '' and measurement_concept_id is not null")
    return m.groupBy(F.col("measurement_concept_id").alias("concept_id"), F.col("value_source_value").alias("value")).agg(F.count("*").alias("n"))


@R.query("unit_distribution", _VALUES + " SELECT concept_id, unit, count(*) / sum(count(*)) OVER (PARTITION BY concept_id) AS p FROM f GROUP BY concept_id, unit")
def unit_distribution_query(spark, sf_dir: str) -> DataFrame:
    return unit_distribution(numeric_stats(_values(spark, sf_dir))).drop("below")


@R.query("random_units", _VALUES + f", {_UNITS}, c AS (SELECT DISTINCT person_id AS key, concept_id FROM (SELECT person_id, {_T.format('unnest(concept_ids)')} AS concept_id FROM processed_dataset WHERE person_id IS NOT NULL) WHERE concept_id IN (SELECT concept_id FROM ud)), d AS (SELECT *, {_u('key::VARCHAR, concept_id', 0)} AS u FROM c) SELECT key, d.concept_id, unit FROM d JOIN ud ON d.concept_id = ud.concept_id AND u >= below AND u < below + p")
def random_units(spark, sf_dir: str) -> DataFrame:
    """A unit drawn for each distinct concept of each person's values."""
    c = table(spark, sf_dir, "processed_dataset").where("person_id is not null").select(F.col("person_id").alias("key"), F.explode("concept_ids").alias("c")).select("key", F.btrim("c", F.lit(tk.BLANKS)).alias("concept_id"))
    d = unit_distribution(numeric_stats(_values(spark, sf_dir)))
    known = d.select("concept_id").distinct()
    return random_unit(c.join(known, "concept_id", "left_semi").distinct(), d)


@R.query("lab_token_ids", _VALUES + " SELECT DISTINCT concept_id AS token FROM f UNION SELECT DISTINCT measurement_concept_id::VARCHAR FROM measurement WHERE coalesce(value_source_value, '') <> '' AND measurement_concept_id IS NOT NULL")
def lab_token_ids(spark, sf_dir: str) -> DataFrame:
    """Tokens of all numeric and categorical labs."""
    numeric = _values(spark, sf_dir).select(F.col("concept_id").alias("token"))
    text = lab_categorical_stats(spark, sf_dir).select(F.col("concept_id").cast("string").alias("token"))
    return numeric.unionByName(text).distinct()


@R.query("value_tokens", _BINS + f""", i AS (SELECT row_number() OVER () AS rn, {_T.format('unnest(concept_ids)')} AS concept_id, coalesce(unnest(units), 'N/A') AS unit, unnest("values") AS value, unnest(value_indicators) AS m FROM processed_dataset WHERE concept_ids IS NOT NULL),
a AS (SELECT i.rn, m, i.concept_id, i.unit, i.value, min(bin_index) AS k FROM (SELECT row_number() OVER () AS id, * FROM i) i LEFT JOIN bins ON m = 1 AND i.concept_id = bins.concept_id AND i.unit = bins.unit AND value BETWEEN start_val AND end_val AND NOT isnan(value) GROUP BY id, i.rn, m, i.concept_id, i.unit, i.value)
SELECT CASE WHEN coalesce(m, 0) <> 1 THEN 'BIN:NONE' WHEN k IS NULL THEN 'BIN:unknown' ELSE 'BIN:' || k END AS token, count(*) AS n FROM a GROUP BY 1""")
def value_tokens(spark, sf_dir: str) -> DataFrame:
    """Counts of the value tokens of all positions."""
    return _tokens(spark, sf_dir, _stats(spark, sf_dir)).groupBy("token").agg(F.count("*").alias("n"))


def _tokens(spark, sf_dir: str, stats: DataFrame) -> DataFrame:
    """key, pos, concept_id, token of all positions of the sequences."""
    rows = table(spark, sf_dir, "processed_dataset").where("concept_ids is not null").select(F.col("person_id").alias("key"), F.posexplode(F.arrays_zip("concept_ids", "units", "values", "value_indicators")).alias("pos", "x"))
    rows = rows.select("key", "pos", F.btrim("x.concept_ids", F.lit(tk.BLANKS)).alias("concept_id"), F.coalesce("x.units", F.lit(NA)).alias("unit"), F.when(~F.isnan("x.values"), F.col("x.values")).alias("value"), F.col("x.value_indicators").alias("m"))
    return assign_bins(rows, stats).select("key", "pos", "concept_id", value_token(F.col("m"), F.col("value"), F.lit(None), F.col("bin")).alias("token"))


@R.query("measurement_value_tokens", _BINS + """, m AS (SELECT row_number() OVER () AS rn, measurement_concept_id::VARCHAR AS concept_id, coalesce(unit_source_value, 'N/A') AS unit, CASE WHEN NOT isnan(value_as_number) THEN value_as_number END AS value, nullif(value_source_value, '') AS text FROM measurement),
a AS (SELECT rn, value, text, min(bin_index) AS k FROM m LEFT JOIN bins ON m.concept_id = bins.concept_id AND m.unit = bins.unit AND value BETWEEN start_val AND end_val GROUP BY ALL)
SELECT CASE WHEN value IS NULL AND text IS NULL THEN 'BIN:NONE' WHEN value IS NULL THEN text WHEN k IS NULL THEN 'BIN:unknown' ELSE 'BIN:' || k END AS token, count(*) AS n FROM a GROUP BY 1""")
def measurement_value_tokens(spark, sf_dir: str) -> DataFrame:
    """Counts of the value tokens of measurements, by the bins of the sequences: numbers by their bin, texts as they are."""
    m = table(spark, sf_dir, "measurement")
    rows = m.select(F.col("measurement_concept_id").cast("string").alias("concept_id"), F.coalesce("unit_source_value", F.lit(NA)).alias("unit"), F.when(~F.isnan("value_as_number"), F.col("value_as_number")).alias("value"), F.when(F.col("value_source_value") != "", F.col("value_source_value")).alias("text"))
    marked = (F.col("value").isNotNull() | F.col("text").isNotNull()).cast("int")
    return assign_bins(rows, _stats(spark, sf_dir)).select(value_token(marked, F.col("value"), F.col("text"), F.col("bin")).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


_KEYS = "i.key::VARCHAR, i.pos::VARCHAR, i.concept_id"


@R.query("normalised_values", _BINS + f""", i AS (SELECT person_id AS key, generate_subscripts(concept_ids, 1) - 1 AS pos, {_T.format('unnest(concept_ids)')} AS concept_id, coalesce(unnest(units), 'N/A') AS unit, unnest("values") AS value, unnest(value_indicators) AS m FROM (SELECT DISTINCT ON (person_id) * FROM processed_dataset WHERE person_id IS NOT NULL AND concept_ids IS NOT NULL ORDER BY person_id, concept_ids DESC)),
tk AS (SELECT i.key, i.pos, i.concept_id, CASE WHEN coalesce(m, 0) <> 1 THEN 'BIN:NONE' ELSE coalesce('BIN:' || min(bin_index), 'BIN:unknown') END AS token FROM i LEFT JOIN bins ON i.concept_id = bins.concept_id AND i.unit = bins.unit AND value BETWEEN start_val AND end_val AND NOT isnan(value) GROUP BY i.key, i.pos, i.concept_id, m),
kp AS (SELECT * FROM tk i WHERE pos < coalesce((SELECT min(pos) FROM tk j WHERE j.key = i.key AND j.concept_id = '[END]'), 1000000000) AND concept_id IS NOT NULL),
{_UNITS},
dr AS (SELECT i.key, i.pos, i.concept_id, token, coalesce(min(ud.unit), 'N/A') AS unit FROM kp i LEFT JOIN ud ON i.concept_id = ud.concept_id AND {_u(_KEYS, 0)} >= below AND {_u(_KEYS, 0)} < below + p GROUP BY ALL),
{_EDGES}
SELECT i.key, i.pos, i.concept_id, round(lo + (hi - lo) * {_u(_KEYS, 1)}, 4) AS number, CASE WHEN regexp_matches(token, '^[0-9]+$') THEN token END AS text, (lo IS NOT NULL)::INT AS is_numeric, i.unit
FROM dr i LEFT JOIN ed ON i.concept_id = ed.concept_id AND i.unit = ed.unit AND token = 'BIN:' || bin_index""")
def normalised_values_query(spark, sf_dir: str) -> DataFrame:
    """Value tokens of each person's sequence back to numbers, units and texts."""
    stats = persisted(_stats(spark, sf_dir), "stats")
    t = table(spark, sf_dir, "processed_dataset").where("person_id is not null and concept_ids is not null")
    one = t.groupBy("person_id").agg(F.max_by(F.struct("concept_ids", "units", "values", "value_indicators"), "concept_ids").alias("x"))
    rows = one.select(F.col("person_id").alias("key"), F.posexplode(F.arrays_zip("x.concept_ids", "x.units", "x.values", "x.value_indicators")).alias("pos", "x"))
    rows = rows.select("key", "pos", F.btrim("x.concept_ids", F.lit(tk.BLANKS)).alias("concept_id"), F.coalesce("x.units", F.lit(NA)).alias("unit"), F.when(~F.isnan("x.values"), F.col("x.values")).alias("value"), F.col("x.value_indicators").alias("m")).where("concept_id is not null")
    tokens = assign_bins(rows, stats).select("key", "pos", "concept_id", value_token(F.col("m"), F.col("value"), F.lit(None), F.col("bin")).alias("token"))
    d = unit_distribution(numeric_stats(_values(spark, sf_dir)))
    return normalised_values(tokens, stats, d).withColumn("number", F.round("number", 4))


def _halves(spark, sf_dir: str) -> list[DataFrame]:
    """The values of persons with even ids, and of all others, as two cohorts."""
    p = table(spark, sf_dir, "processed_dataset")
    even = F.coalesce(F.col("person_id") % 2 == 0, F.lit(False))
    return [numeric_values(p.where(even)), numeric_values(p.where(~even))]


_SIDE = "SELECT concept_id, unit, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS std FROM f WHERE {} GROUP BY ALL"
_SIDES = f"""
WITH x AS (SELECT coalesce(person_id % 2 = 0, false) AS even, {_T.format('unnest(concept_ids)')} AS concept_id, coalesce(unnest(units), 'N/A') AS unit, unnest("values") AS value, unnest(value_indicators) AS m FROM processed_dataset),
f AS (SELECT even, concept_id, unit, value FROM x WHERE m = 1 AND value IS NOT NULL AND isfinite(value) AND value <> 0 AND concept_id IS NOT NULL),
q AS (SELECT even, concept_id, unit, quantile_cont(value, {normal_cdf(-OUTLIER_STD)!r}) AS lo, quantile_cont(value, {normal_cdf(OUTLIER_STD)!r}) AS hi FROM f GROUP BY ALL),
t AS (SELECT even, concept_id, unit, count(*) AS n FROM f JOIN q USING (even, concept_id, unit) WHERE value >= lo - 1e-9 * abs(lo) AND value <= hi + 1e-9 * abs(hi) GROUP BY ALL),
w AS (SELECT DISTINCT concept_id, unit FROM t WHERE n >= {BINS * (FREEDOM + 1)})"""


@R.query("vocabulary_expand_stats", _SIDES + f", g AS (SELECT concept_id, unit, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS std FROM f GROUP BY ALL) SELECT g.*, CASE WHEN w.concept_id IS NULL THEN 0 ELSE {BINS} END AS n_bins, true AS contiguous FROM g LEFT JOIN w USING (concept_id, unit)")
def vocabulary_expand_stats(spark, sf_dir: str) -> DataFrame:
    """The statistics of two cohorts merged as a tokenizer is expanded: pooled moments, and bins fitted anew where both have them."""
    a, b = _halves(spark, sf_dir)
    pooled = merge_stats(numeric_stats(a), numeric_stats(b))
    sides = [persisted(lab_bins(trimmed(ranked(x))), "side_bins") for x in (a, b)]
    bins = merge_bins(*sides)
    whole = F.forall(F.sequence(F.lit(1), F.size("bins") - 1), lambda i: F.get("bins", i)["start_val"] == F.get("bins", i - 1)["end_val"])
    j = pooled.join(broadcast_if_small(bins), KEY, "left")
    return j.select(*KEY, "n", "mean", "std", F.when(F.col("bins").isNull(), 0).otherwise(F.size("bins")).alias("n_bins"), F.coalesce(whole, F.lit(True)).alias("contiguous"))


@R.query("lab_categorical_merge", "SELECT measurement_concept_id AS concept_id, value_source_value AS value, count(*) AS n FROM measurement WHERE coalesce(value_source_value, '') <> '' AND measurement_concept_id IS NOT NULL GROUP BY ALL")
def lab_categorical_merge(spark, sf_dir: str) -> DataFrame:
    """Text values counted in two loads apart (before and from 2020 on, by the measurement's date) and merged."""
    m = table(spark, sf_dir, "measurement").where("value_source_value <> '' and measurement_concept_id is not null")
    late = F.coalesce(F.col("measurement_date") >= F.lit("2020-01-01").cast("date"), F.lit(False))
    count = lambda d: d.groupBy(F.col("measurement_concept_id").alias("concept_id"), F.col("value_source_value").alias("value")).agg(F.count("*").alias("n"))
    return merge_counts(count(m.where(late)), count(m.where(~late)), ["concept_id", "value"])
