"""Scalar functions on the tokens of patient sequences. All take and return columns; null gives null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.registry import Registry
from ..plans.runtime import table

# Special tokens, visit types and the days of a token's unit.
START, END, PAD, OOV, LINEAR = "[START]", "[END]", "[PAD]", "[OOV]", "[LINEAR_PROB]"
VISIT_CONCEPTS = ["9202", "9203", "581477", "9201", "5083", "262", "38004250", "0", "8883", "38004238", "38004251", "38004222", "38004268", "38004228", "32693", "8971", "38004269", "38004193", "32036", "8782"]
INPATIENT_VISITS = [9201, 262, 8971, 8920]
DAYS = {"D": 1, "W": 7, "M": 30, "Y": 365}
LONG_TERM = 1095
BLANKS = " \t\n\r"


def is_visit_start(c: Column) -> Column:
    return c.isin("VS", "[VS]")


def is_visit_end(c: Column) -> Column:
    return c.isin("VE", "[VE]")


def is_att_token(c: Column) -> Column:
    """A token of time between visits or within a stay; hour tokens are none."""
    return c.rlike("^[DWMY][0-9]") | (c == "LT") | c.startswith("VS-") | (c.startswith("i-") & ~c.startswith("i-H"))


def is_inpatient_att_token(c: Column) -> Column:
    """Days within a stay: only the unit D counts."""
    return c.rlike("^(VS-|i-)D[0-9]")


def is_clinical_event(c: Column) -> Column:
    return c.rlike("^[0-9]+$")


def is_artificial_token(c: Column) -> Column:
    return c.isin(*VISIT_CONCEPTS) | is_visit_start(c) | is_visit_end(c) | is_att_token(c) | (c == END)


def interval_days(c: Column, strict: bool = False) -> Column:
    """Days of a time token; in VS- and i- tokens the unit letter is ignored. Other tokens give null, or an error if ``strict``."""
    number = F.substring(c, 2, 12).try_cast("int")
    part = F.get(F.split(c, "-"), F.lit(1))
    inner = F.when(part.startswith("LT"), LONG_TERM).otherwise(F.substring(part, 2, 12).try_cast("int"))
    head = F.substring(c, 1, 1)
    days = F.when(c == "LT", LONG_TERM).when(c.startswith("VS-") | c.startswith("i-"), inner)
    for unit, n in DAYS.items():
        days = days.when(head == unit, number * n)
    if strict:
        days = F.when(days.isNull() & c.isNotNull(), F.raise_error(F.concat(F.lit("Invalid time token: "), c)).cast("int")).otherwise(days)
    return days


def time_tuple(days: Column, inpatient: Column) -> Column:
    """Three sub-tokens of years, months and days; negative days are an error."""
    year, month, day = F.floor(days / 365), F.floor(days % 365 / 30), days % 365 % 30
    parts = F.array(F.concat(F.lit("year:"), year), F.concat(F.lit("month:"), month), F.concat(F.when(inpatient, "i-day:").otherwise("day:"), day))
    parts = F.when(days.isNotNull(), parts)
    return F.when(days < 0, F.raise_error(F.lit("the time interval must not be negative")).cast("array<string>")).otherwise(parts)


def artificial_time_tokens() -> Column:
    """The array D0 to D1999, W0 to W3, M0 to M11, LT."""
    def numbered(unit: str, n: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.concat(F.lit(unit), i))

    return F.concat(numbered("D", 2000), numbered("W", 4), numbered("M", 12), F.array(F.lit("LT")))


def is_known_time_token(c: Column) -> Column:
    """Membership in :func:`artificial_time_tokens` without the array."""
    return c.rlike("^(D(0|[1-9][0-9]{0,2}|1[0-9]{3})|W[0-3]|M([0-9]|1[01])|LT)$")


def value_bin(index: Column) -> Column:
    return F.concat(F.lit("BIN:"), index)


def is_value_bin(c: Column) -> Column:
    return c.startswith("BIN:")


def age_group(age_token: Column) -> Column:
    """``age:37`` to ``age:30-40``; null if the age is no number."""
    low = F.floor(F.substring(age_token, 5, 12).try_cast("int") / 10) * 10
    return F.concat(F.lit("age:"), low, F.lit("-"), low + 10)


def month_bucket(days: Column, long_term: int = LONG_TERM) -> Column:
    """``M<months of 30 days>`` below ``long_term`` days, else LT."""
    return F.when(days >= long_term, "LT").otherwise(F.concat(F.lit("M"), F.floor(days / 30)))


def time_to_visit(tokens: Column, most: int = 30) -> Column:
    """Per token its days as double; -100 for others, unreadable ones and stays of more than ``most`` days."""

    def one(t: Column) -> Column:
        d = interval_days(t)
        ok = is_att_token(t) & d.isNotNull() & ~(is_inpatient_att_token(t) & (d > most))
        return F.when(F.coalesce(ok, F.lit(False)), d.cast("double")).otherwise(-100.0)

    return F.transform(tokens, one)


def age_in_years(birth: Column, at: Column) -> Column:
    """Completed years by calendar and time of day; 29 February becomes 28 in other years."""
    years = F.year(at) - F.year(birth)
    return years - F.when(at < birth + F.make_ym_interval(years, F.lit(0)), 1).otherwise(0)


def whole_days(later: Column, earlier: Column) -> Column:
    """Floor of the difference in days, by time and not by calendar."""
    micros = F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))
    return F.floor(micros / 86_400_000_000).cast("int")


def day_start(c: Column) -> Column:
    return F.date_format(c.cast("date"), "yyyy-MM-dd'T'00:00:00")


def day_end(c: Column) -> Column:
    return F.date_format(c.cast("date"), "yyyy-MM-dd'T'23:59:59.999999")


def prefixed_concept(c: Column, prefix: str) -> Column:
    """``Gender/8507`` or ``8507`` to the number, anything else to 0."""
    return F.coalesce(F.when(c.startswith(prefix), F.substring(c, len(prefix) + 1, 30)).otherwise(c).try_cast("bigint"), F.lit(0).cast("bigint"))


def year_of(c: Column) -> Column:
    """The year of ``year:2016``, 1900 if it cannot be read."""
    return F.coalesce(F.substring(c, 6, 12).try_cast("int"), F.lit(1900))


def age_of(c: Column) -> Column:
    """The age of ``age:27``, -1 if it cannot be read."""
    return F.coalesce(F.substring(c, 5, 12).try_cast("int"), F.lit(-1))


def terms(c: str | Column = "concept_ids") -> Column:
    """Tokens without outer blanks; null and empty ones are left out, a null array is empty."""
    kept = F.filter(F.transform(c, lambda x: F.btrim(x, F.lit(BLANKS))), lambda x: F.length(x) > 0)
    return F.coalesce(kept, F.array().cast("array<string>"))


def without_start(c: Column) -> Column:
    """The sequence without a leading [START]."""
    return F.when(F.lower(F.get(c, F.lit(0))).contains("start"), F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0)))).otherwise(c)


#: SQL: one row per person and distinct cleaned sequence without a leading start token.
SEQUENCES_SQL = """
WITH raw AS (SELECT person_id, [y FOR y IN [trim(x, ' ' || chr(9) || chr(10) || chr(13)) FOR x IN coalesce(concept_ids, [])] IF y <> ''] AS t FROM processed_dataset WHERE person_id IS NOT NULL),
s AS (SELECT DISTINCT person_id, CASE WHEN contains(lower(t[1]), 'start') THEN t[2:] ELSE t END AS t FROM raw)
"""


def sequences(spark, sf_dir: str) -> DataFrame:
    """``person_id, t``: each person's distinct cleaned sequences without a leading start token."""
    p = table(spark, sf_dir, "processed_dataset").where("person_id is not null")
    return p.select("person_id", terms().alias("t")).select("person_id", without_start(F.col("t")).alias("t")).distinct()


R = Registry()


@R.query("token_classes", SEQUENCES_SQL + """, k AS (SELECT DISTINCT unnest(t) AS token FROM s),
d AS (SELECT token, CASE WHEN token = 'LT' THEN 1095 WHEN starts_with(token, 'VS-') OR starts_with(token, 'i-') THEN
  CASE WHEN starts_with(split_part(token, '-', 2), 'LT') THEN 1095 ELSE TRY_CAST(substr(split_part(token, '-', 2), 2) AS INT) END
  ELSE TRY_CAST(substr(token, 2) AS INT) * CASE token[1] WHEN 'D' THEN 1 WHEN 'W' THEN 7 WHEN 'M' THEN 30 WHEN 'Y' THEN 365 END END AS days FROM k)
SELECT token, token IN ('VS', '[VS]') AS visit_start, token IN ('VE', '[VE]') AS visit_end,
 regexp_matches(token, '^[DWMY][0-9]') OR token = 'LT' OR starts_with(token, 'VS-') OR (starts_with(token, 'i-') AND NOT starts_with(token, 'i-H')) AS att,
 regexp_matches(token, '^(VS-|i-)D[0-9]') AS inpatient_att, regexp_matches(token, '^[0-9]+$') AS clinical, token IN (""" + ", ".join(f"'{x}'" for x in VISIT_CONCEPTS) + """) OR token IN ('VS', '[VS]', 'VE', '[VE]', '[END]') OR regexp_matches(token, '^[DWMY][0-9]') OR token = 'LT' OR starts_with(token, 'VS-') OR (starts_with(token, 'i-') AND NOT starts_with(token, 'i-H')) AS artificial, days,
 'year:' || (days // 365) || ' month:' || (days % 365 // 30) || CASE WHEN regexp_matches(token, '^(VS-|i-)D[0-9]') THEN ' i-day:' ELSE ' day:' END || (days % 365 % 30) AS sub_time,
 CASE WHEN days >= 1095 THEN 'LT' WHEN days IS NOT NULL THEN 'M' || (days // 30) END AS bucket,
 CASE WHEN starts_with(token, 'age:') THEN 'age:' || (TRY_CAST(substr(token, 5) AS INT) // 10 * 10) || '-' || (TRY_CAST(substr(token, 5) AS INT) // 10 * 10 + 10) END AS age_group FROM d""")
def token_classes(spark, sf_dir: str) -> DataFrame:
    """Every token with its class, days, sub-tokens, month bucket and age group."""
    t = F.col("token")
    k = sequences(spark, sf_dir).select(F.explode("t").alias("token")).distinct()
    d = k.select(t, is_visit_start(t).alias("visit_start"), is_visit_end(t).alias("visit_end"), is_att_token(t).alias("att"), is_inpatient_att_token(t).alias("inpatient_att"), is_clinical_event(t).alias("clinical"), F.coalesce(is_artificial_token(t), F.lit(False)).alias("artificial"), interval_days(t).alias("days"))
    days = F.col("days")
    return d.select("*", F.when(days.isNotNull(), F.array_join(time_tuple(days, F.col("inpatient_att")), " ")).alias("sub_time"), F.when(days.isNotNull(), month_bucket(days)).alias("bucket"), F.when(t.startswith("age:"), age_group(t)).alias("age_group"))



@R.query("artificial_time_tokens", "SELECT 'D' || i AS token FROM range(2000) r(i) UNION ALL SELECT 'W' || i FROM range(4) r(i) UNION ALL SELECT 'M' || i FROM range(12) r(i) UNION ALL SELECT 'LT'")
def artificial_tokens(spark, sf_dir: str) -> DataFrame:
    return spark.range(1).select(F.explode(artificial_time_tokens()).alias("token"))


@R.query("time_to_visit", SEQUENCES_SQL + """, i AS (SELECT person_id, unnest(t) AS x FROM s),
d AS (SELECT person_id, x, CASE WHEN x = 'LT' THEN 1095 WHEN starts_with(x, 'i-') OR starts_with(x, 'VS-') THEN TRY_CAST(substr(split_part(x, '-', 2), 2) AS INT)
 ELSE TRY_CAST(substr(x, 2) AS INT) * CASE x[1] WHEN 'D' THEN 1 WHEN 'W' THEN 7 WHEN 'M' THEN 30 WHEN 'Y' THEN 365 END END AS n,
 regexp_matches(x, '^[DWMY][0-9]') OR x = 'LT' OR starts_with(x, 'VS-') OR (starts_with(x, 'i-') AND NOT starts_with(x, 'i-H')) AS att, regexp_matches(x, '^(VS-|i-)D[0-9]') AS inp FROM i)
SELECT person_id, count(*) AS n_tokens, sum(CASE WHEN att AND n IS NOT NULL AND NOT (inp AND n > 30) THEN n ELSE -100 END)::DOUBLE AS total FROM d GROUP BY 1""")
def time_to_visit_sums(spark, sf_dir: str) -> DataFrame:
    """Tokens per person and the sum of their time-to-visit values."""
    x = sequences(spark, sf_dir).select("person_id", F.explode(time_to_visit(F.col("t"))).alias("v"))
    return x.groupBy("person_id").agg(F.count("*").alias("n_tokens"), F.sum("v").alias("total"))


@R.query("visit_ages", """
WITH p AS (SELECT person_id, min(birth_datetime) AS birth FROM person WHERE birth_datetime IS NOT NULL GROUP BY 1)
SELECT visit_occurrence_id, v.person_id, date_diff('year', birth, visit_start_datetime) - CASE WHEN visit_start_datetime < birth + to_years(CAST(date_diff('year', birth, visit_start_datetime) AS INT)) THEN 1 ELSE 0 END AS age,
CAST(floor((epoch_us(visit_end_datetime) - epoch_us(visit_start_datetime)) / 86400000000.0) AS INT) AS days, strftime(visit_start_datetime::DATE, '%Y-%m-%dT00:00:00') AS day_start, strftime(visit_start_datetime::DATE, '%Y-%m-%dT23:59:59.999999') AS day_end
FROM visit_occurrence v JOIN p ON v.person_id = p.person_id WHERE visit_start_datetime IS NOT NULL""")
def visit_ages(spark, sf_dir: str) -> DataFrame:
    """Age at each visit row, its length in whole days, and the bounds of its first day."""
    birth = table(spark, sf_dir, "person").where("birth_datetime is not null").groupBy("person_id").agg(F.min("birth_datetime").alias("birth"))
    v = table(spark, sf_dir, "visit_occurrence").where("visit_start_datetime is not null").join(birth, "person_id")
    at, end = F.col("visit_start_datetime"), F.col("visit_end_datetime")
    return v.select("visit_occurrence_id", "person_id", age_in_years(F.col("birth"), at).alias("age"), whole_days(end, at).alias("days"), day_start(at).alias("day_start"), day_end(at).alias("day_end"))
