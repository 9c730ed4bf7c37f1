"""Patient sequences: building them from events, and projections, filters, slices and truncations of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import tokens as tk
from ..functions.tokens import SEQUENCES_SQL, sequences
from ..plans.registry import Registry
from ..plans.runtime import persisted, table
from .splits import uniform

HEADER = 4


def demographics(c: Column) -> list[Column]:
    """year, age, gender and race from the first four tokens."""
    return [tk.year_of(F.get(c, F.lit(0))).alias("year"), tk.age_of(F.get(c, F.lit(1))).alias("age"), F.get(c, F.lit(2)).alias("gender"), F.get(c, F.lit(3)).alias("race")]


def clinical_set(c: Column, skip: int = HEADER) -> Column:
    """Sorted distinct numeric tokens after ``skip`` tokens."""
    return F.sort_array(F.filter(F.array_distinct(F.slice(c, skip + 1, F.greatest(F.size(c), F.lit(1)))), tk.is_clinical_event))


def members(concepts: Column, listed: Column | list[str]) -> Column:
    """The concepts of a set that are in a list. A list of the program becomes one hash set for all rows, an array column one a row."""
    if isinstance(listed, Column):
        return F.array_intersect(concepts, listed)
    return F.filter(concepts, lambda x: x.isin(listed) if listed else F.lit(False))


def partition_set(concepts: Column, common: Column | list[str], sensitive: Column | list[str] | None = None) -> tuple[Column, Column]:
    """The common and the sensitive members of a set of concepts, by two lists; without a second one all others are sensitive."""
    known = members(concepts, common)
    rest = F.array_except(concepts, known) if sensitive is None else members(concepts, sensitive)
    return F.sort_array(known), F.sort_array(rest)


def valid_sequence(c: Column) -> Column:
    """Not empty after the header, ended by a visit end or [END], with a year in the first token."""
    return (F.size(c) > HEADER) & F.get(c, F.size(c) - 1).isin("VE", "[VE]", tk.END) & F.lower(F.get(c, F.lit(0))).contains("year")


def plausible_birth_year(c: Column, as_of_year: int) -> Column:
    born = F.substring(F.get(c, F.lit(0)), 6, 12).try_cast("int") - F.substring(F.get(c, F.lit(1)), 5, 12).try_cast("int")
    return F.coalesce(born.between(1900, as_of_year), F.lit(False))


def died(c: Column) -> Column:
    """The last token but one is [DEATH]."""
    return F.coalesce(F.get(c, F.size(c) - 2) == "[DEATH]", F.lit(False))


@dataclass(frozen=True)
class BuildOptions:
    """How events become tokens."""

    hour_tokens: bool = True
    discharge_tokens: bool = True
    inpatient_time_tokens: bool = True
    inpatient_types: tuple[str, ...] = ("9201", "262", "8971", "8920", "9203")
    long_term: int = tk.LONG_TERM


def att_token(days: Column, long_term: int = tk.LONG_TERM) -> Column:
    """Days to a time token: D below a week, W below 30 days, M below ``long_term``, else LT."""
    return F.when(days >= long_term, "LT").when(days >= 30, F.concat(F.lit("M"), F.floor(days / 30))).when(days >= 7, F.concat(F.lit("W"), F.floor(days / 7))).otherwise(F.concat(F.lit("D"), days))


def build_sequences(person: DataFrame, visits: DataFrame, events: DataFrame, options: BuildOptions = BuildOptions()) -> DataFrame:
    """Sequences from tables: ``person_id, concept_ids, concept_value_masks, number_as_values, concept_as_values, units, is_numeric_types, num_of_concepts, num_of_visits``.

    person: ``person_id, birth, gender, race`` (unique persons); visits:
    ``person_id, visit_id, visit_type, start, end, discharge`` (unique visit_id);
    events: ``visit_id, time, code, number, text, unit``. Visits without start,
    events without time or code, and visits without events are skipped, the latter still count as visits.
    Within a visit an event of equal time (the day outside of stays), code, text and
    unit stands once; its number is no part of its identity; the time tokens before a skipped repetition
    stay. Ties in time are ordered by code, text, unit, number.

    The clock within a visit is the running maximum of event times, in stays
    capped by the visit's end, so windows over one partitioning by person suffice.
    """
    o = options
    v = visits.where("start is not null and person_id is not null").select("person_id", "visit_id", "visit_type", "start", "end", "discharge", F.coalesce(F.col("visit_type").isin(*o.inpatient_types), F.lit(False)).alias("stay"))
    e = events.where("time is not null and code is not null and visit_id is not null").select("visit_id", "time", "code", "number", "text", F.coalesce("unit", F.lit("N/A")).alias("unit"))
    j = v.join(e, "visit_id")
    # The join's partitioning by visit serves the windows within a visit, so a person with very many events is spread.
    in_visit = Window.partitionBy("person_id", "start", "visit_id").orderBy("time", "code", "text", "unit", "number")
    same = Window.partitionBy("person_id", "start", "visit_id", F.when(F.col("stay"), F.col("time")).otherwise(F.date_trunc("day", "time")), "code", "text", "unit").orderBy("time", "number")
    j = j.withColumn("n", F.row_number().over(in_visit)).withColumn("dup", F.row_number().over(same) > 1)
    seen = F.max(F.when(~F.col("dup"), F.col("time"))).over(in_visit.rowsBetween(Window.unboundedPreceding, -1))
    clock = F.greatest("start", F.coalesce(F.when(F.col("stay") & seen.isNotNull(), F.least(seen, F.coalesce("end", seen))).otherwise(seen), "start"))
    j = j.withColumn("clock", clock)
    gap = tk.whole_days(F.col("time"), F.col("clock"))
    seconds = (F.unix_micros(F.col("time").cast("timestamp")) - F.unix_micros(F.col("clock").cast("timestamp"))) / 1_000_000
    hours = F.when(gap > 0, F.hour("time")).otherwise(F.floor(seconds / 3600)).cast("int")
    token = lambda code, mask=F.lit(0), number=F.lit(0.0), text=F.lit("0"), unit=F.lit("N/A"), numeric=F.lit(0): F.struct(code.alias("code"), mask.alias("mask"), number.cast("double").alias("number"), text.alias("text"), unit.alias("unit"), numeric.alias("numeric"))
    days = F.when(F.col("stay") & F.lit(o.inpatient_time_tokens) & (gap > 0), token(F.concat(F.lit("i-D"), gap)))
    hour = F.when(F.col("stay") & F.lit(o.hour_tokens) & (hours > 0), token(F.concat(F.lit("i-H"), hours)))
    event = F.when(~F.col("dup"), token(F.col("code"), (F.col("number").isNotNull() | F.col("text").isNotNull()).cast("int"), F.coalesce("number", F.lit(0.0)), F.coalesce("text", F.lit("0")), F.col("unit"), F.col("number").isNotNull().cast("int")))
    j = j.withColumn("tokens", F.array_compact(F.array(days, hour, event)))
    per = j.groupBy("person_id", "start", "visit_id").agg(F.first("visit_type").alias("visit_type"), F.first("end").alias("end"), F.first("discharge").alias("discharge"), F.first("stay").alias("stay"), F.max(F.when(~F.col("dup"), F.col("time"))).alias("last"), F.flatten(F.sort_array(F.collect_list(F.struct("n", "tokens"))).tokens).alias("tokens"))
    seen = F.greatest("start", F.coalesce("last", "start"))
    per = per.withColumn("left", F.when(F.col("stay") & F.col("end").isNotNull(), F.col("end")).otherwise(seen))
    by = Window.partitionBy("person_id").orderBy("start", "visit_id")
    wait = F.greatest(tk.whole_days(F.col("start"), F.lag("left").over(by)), F.lit(0))
    plain = lambda c: token(c)
    head = F.array_compact(F.array(F.when(F.lag("left").over(by).isNotNull(), plain(att_token(wait, o.long_term))), plain(F.lit("[VS]")), plain(F.coalesce("visit_type", F.lit("0"))), F.when(F.col("stay") & F.lit(o.hour_tokens) & (F.hour("start") > 0), plain(F.concat(F.lit("i-H"), F.hour("start"))))))
    tail = F.array_compact(F.array(F.when(F.col("stay") & F.lit(o.discharge_tokens), plain(F.coalesce("discharge", F.lit("0")))), plain(F.lit("[VE]"))))
    per = per.select("person_id", "start", "visit_id", F.concat(head, F.col("tokens"), tail).alias("tokens"))
    whole = per.groupBy("person_id").agg(F.flatten(F.sort_array(F.collect_list(F.struct("start", "visit_id", "tokens"))).tokens).alias("tokens"))
    first = v.groupBy("person_id").agg(F.min("start").alias("first"), F.count("*").alias("num_of_visits"))
    full = whole.join(first, "person_id").join(person, "person_id")
    header = F.array(*[plain(c) for c in (F.concat(F.lit("year:"), F.year("first")), F.concat(F.lit("age:"), tk.age_in_years(F.col("birth"), F.col("first"))), F.coalesce("gender", F.lit("0")), F.coalesce("race", F.lit("0")))])
    t = F.concat(header, "tokens")
    names = {"concept_ids": "code", "concept_value_masks": "mask", "number_as_values": "number", "concept_as_values": "text", "units": "unit", "is_numeric_types": "numeric"}
    full = full.withColumn("t", t)
    return full.select("person_id", *[F.col(f"t.{f}").alias(n) for n, f in names.items()], F.size("t").alias("num_of_concepts"), F.col("num_of_visits").cast("int").alias("num_of_visits"))


def prompts_at_visits(seqs: DataFrame, key: str, c: str) -> DataFrame:
    """``key, pos, year, age, gender, race`` at every visit start (pos from 0): the header moved on by the days before it.

    A header that cannot be read counts as year 1900 and age 0, and its year and age are ``unknown``.
    """
    head = [F.get(c, F.lit(2)).alias("gender"), F.get(c, F.lit(3)).alias("race"), F.substring(F.get(c, F.lit(0)), 6, 12).try_cast("int").alias("y"), F.substring(F.get(c, F.lit(1)), 5, 12).try_cast("int").alias("a")]
    # A fold inside the row keeps the days so far and notes them at visit starts: no shuffle, and an array as long as the visits.
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("d"), F.array().cast("array<struct<pos:int,s:int>>").alias("w"))

    def step(s: Column, x: Column) -> Column:
        days = F.when(F.coalesce(tk.is_att_token(x), F.lit(False)), F.coalesce(tk.interval_days(x), F.lit(0))).otherwise(0)
        noted = F.when(F.coalesce(tk.is_visit_start(x), F.lit(False)), F.concat(s["w"], F.array(F.struct(s["i"].alias("pos"), s["d"].alias("s"))))).otherwise(s["w"])
        return F.struct((s["i"] + 1).alias("i"), (s["d"] + days).alias("d"), noted.alias("w"))

    rows = seqs.select(key, *head, F.explode(F.aggregate(c, start, step)["w"]).alias("w")).withColumn("pos", F.col("w.pos"))
    known = F.col("y").isNotNull() & F.col("a").isNotNull()
    year = F.year(F.date_add(F.make_date(F.when(known, F.col("y")).otherwise(1900), F.lit(1), F.lit(1)), F.col("w.s")))
    return rows.select(key, "pos", F.when(known, F.concat(F.lit("year:"), year)).otherwise("year:unknown").alias("year"), F.when(known, F.concat(F.lit("age:"), year - (F.col("y") - F.col("a")))).otherwise("age:unknown").alias("age"), "gender", "race")


def truncate_right(c: Column, most: int) -> Column:
    """Sequences longer than ``most``: up to, without, the last visit end among the first ``most`` tokens (all of these if none)."""
    head = F.slice(c, 1, most)
    last = F.size(head) - F.array_position(F.reverse(F.transform(head, lambda x: F.when(tk.is_visit_end(x), "e").otherwise("")), ), "e").cast("int")
    ended = F.exists(head, tk.is_visit_end)
    return F.when(F.size(c) <= most, c).when(ended, F.slice(head, 1, last)).otherwise(head)


def truncate_left(c: Column, most: int) -> Column:
    """The last ``most`` tokens, from the first visit start among them (all of these if none)."""
    tail = F.slice(c, -most, most)
    at = F.array_position(F.transform(tail, lambda x: F.when(tk.is_visit_start(x), "s").otherwise("")), "s").cast("int")
    return F.when(F.size(c) <= most, c).when(at > 0, F.slice(tail, at, most)).otherwise(tail)


def truncate_recent(seqs: DataFrame, key: str, c: str, most: int) -> DataFrame:
    """``key, c``: the most recent visits that fit with a renewed header; without any, the last ``most`` tokens. Shorter ones stay. Keys must be unique."""
    n = F.size(c)
    long = seqs.where(n > most)
    at = prompts_at_visits(long.select(key, c), key, c).join(long.select(key, n.alias("n")), key).where(F.col("n") - F.col("pos") <= most - HEADER)
    first = at.groupBy(key).agg(F.min(F.struct("pos", "year", "age", "gender", "race")).alias("f"))
    header = F.array("f.year", "f.age", F.coalesce("f.gender", F.lit("0")), F.coalesce("f.race", F.lit("0")))
    cut = long.select(key, c).join(first, key, "left").select(key, F.when(F.col("f").isNotNull(), F.concat(header, F.slice(c, F.col("f.pos") + 1, F.size(c)))).otherwise(F.slice(c, -most, most)).alias(c))
    return seqs.where(n <= most).select(key, c).unionByName(cut)


def slice_candidates(c: Column, most: int) -> Column:
    """Positions (from 0) of the visit starts at which a slice of ``most`` tokens may begin."""
    at = F.sequence(F.lit(0), F.greatest(F.size(c) - 1, F.lit(0)))
    last = F.least(F.size(c), F.size(c) - most + HEADER)
    return F.filter(at, lambda i: (i >= HEADER) & (i < last) & tk.is_visit_start(F.get(c, i)))


def slices(seqs: DataFrame, key: str, c: str, most: int) -> DataFrame:
    """``key, first, last, year, age, gender, race``: from every visit start where a slice may begin to the last visit end inside its window, with the header renewed for it. Keys must be unique."""
    rows = seqs.select(key, c, F.explode(slice_candidates(F.col(c), most)).alias("first"))
    window = F.slice(c, F.col("first") + 1, most - HEADER)
    back = F.array_position(F.reverse(F.transform(window, lambda x: F.when(tk.is_visit_end(x), "e").otherwise(""))), "e").cast("int")
    rows = rows.select(key, "first", F.when(back > 0, F.col("first") + F.size(window) - back).otherwise(F.col("first")).alias("last"))
    return rows.join(prompts_at_visits(seqs, key, c).withColumnRenamed("pos", "first"), [key, "first"])


def random_slice(seqs: DataFrame, key: str, c: str, most: int, seed: int = 0) -> DataFrame:
    """``key, first, last, year, age, gender, race``: one of :func:`slices` drawn by a hash of key and seed; (0, 0) and no header without a candidate."""
    some = F.size(slice_candidates(F.col(c), most))
    pick = F.get(slice_candidates(F.col(c), most), F.floor(uniform(key, seed=seed) * some).cast("int"))
    drawn = seqs.select(key, F.coalesce(pick, F.lit(-1)).alias("first"))
    return drawn.join(slices(seqs, key, c, most), [key, "first"], "left").withColumn("first", F.greatest("first", F.lit(0))).withColumn("last", F.coalesce("last", F.lit(0)))


def pretraining_cut(seqs: DataFrame, key: str, c: str, most: int, seed: int = 0, share: float = 0.5) -> DataFrame:
    """``key, c``: of sequences longer than ``most`` a drawn slice with its renewed header (for a ``share`` of them, by hash, if there is one), else the start up to the last visit end; shorter ones whole."""
    cut = random_slice(seqs, key, c, most, seed).join(seqs.select(key, c), key)
    header = F.array("year", "age", F.coalesce("gender", F.lit("0")), F.coalesce("race", F.lit("0")))
    part = F.concat(header, F.slice(c, F.col("first") + 1, F.col("last") - F.col("first") + 1))
    taken = (F.size(c) > most) & (uniform(key, seed=seed + 1) < share) & F.col("year").isNotNull()
    return cut.select(key, F.when(taken, part).otherwise(truncate_right(F.col(c), most)).alias(c))


R = Registry()
_S = SEQUENCES_SQL
MOST = 64


@R.query("demographic_projection", _S + "SELECT person_id, coalesce(TRY_CAST(substr(t[1], 6) AS INT), 1900) AS year, coalesce(TRY_CAST(substr(t[2], 5) AS INT), -1) AS age, t[3] AS gender, t[4] AS race, coalesce(TRY_CAST(substr(t[1], 6) AS INT) - TRY_CAST(substr(t[2], 5) AS INT) BETWEEN 1900 AND 2026, false) AS plausible FROM s")
def demographic_projection(spark, sf_dir: str) -> DataFrame:
    t = F.col("t")
    return sequences(spark, sf_dir).select("person_id", *demographics(t), plausible_birth_year(t, 2026).alias("plausible"))



@R.query("clinical_concept_set", _S + "SELECT person_id, array_to_string(list_sort(list_distinct([x FOR x IN t[5:] IF regexp_matches(x, '^[0-9]+$')])), ' ') AS concepts FROM s")
def clinical_concept_set(spark, sf_dir: str) -> DataFrame:
    return sequences(spark, sf_dir).select("person_id", F.array_join(clinical_set(F.col("t")), " ").alias("concepts"))


@R.query("common_sensitive_partition", _S + """, x AS (SELECT person_id, t, unnest(list_distinct([x FOR x IN t[5:] IF regexp_matches(x, '^[0-9]+$')])) AS c FROM s),
a AS (SELECT c FROM x GROUP BY c HAVING count(*) * 2 >= (SELECT count(*) FROM s))
SELECT person_id, count(*) FILTER (c IN (FROM a)) AS n_common, count(*) FILTER (c NOT IN (FROM a)) AS n_sensitive FROM x GROUP BY person_id, t""")
def common_sensitive_partition(spark, sf_dir: str) -> DataFrame:
    """Sizes of each sequence's common concepts (in at least half of the sequences) and of the others."""
    s = sequences(spark, sf_dir).select("person_id", clinical_set(F.col("t")).alias("c"))
    n = s.count()
    common = s.select(F.explode("c").alias("k")).groupBy("k").count().where(F.col("count") * 2 >= n).agg(F.collect_list("k").alias("common"))
    # At most a set's size times two concepts stand in half of all sets; the one-row table is safe to send.
    j = s.join(F.broadcast(common), F.lit(True)).where("size(c) > 0")
    known, rest = partition_set(F.col("c"), F.col("common"))
    return j.select("person_id", F.size(known).alias("n_common"), F.size(rest).alias("n_sensitive"))


@R.query("sequence_filters", _S + """SELECT person_id, len(t) AS n, len(t) > 4 AND t[-1] IN ('VE', '[VE]', '[END]') AND contains(lower(t[1]), 'year') AS valid, coalesce(t[-2] = '[DEATH]', false) AS died,
 len([x FOR x IN t IF x IN ('VE', '[VE]')]) AS n_visits FROM s WHERE len(t) BETWEEN 20 AND 2048""")
def sequence_filters(spark, sf_dir: str) -> DataFrame:
    """Length filter, validity, death label and visit count."""
    t = F.col("t")
    return sequences(spark, sf_dir).where(F.size("t").between(20, 2048)).select("person_id", F.size("t").alias("n"), valid_sequence(t).alias("valid"), died(t).alias("died"), F.size(F.filter(t, tk.is_visit_end)).alias("n_visits"))


_PROMPTS = _S + """, i AS (SELECT person_id, t, unnest(range(1, len(t) + 1)) AS i FROM s),
d AS (SELECT person_id, t, i, t[i] AS x, coalesce(CASE WHEN t[i] = 'LT' THEN 1095 WHEN starts_with(t[i], 'i-') AND NOT starts_with(t[i], 'i-H') OR starts_with(t[i], 'VS-') THEN TRY_CAST(substr(split_part(t[i], '-', 2), 2) AS INT)
 WHEN regexp_matches(t[i], '^[DWMY][0-9]') THEN TRY_CAST(substr(t[i], 2) AS INT) * CASE t[i][1] WHEN 'D' THEN 1 WHEN 'W' THEN 7 WHEN 'M' THEN 30 ELSE 365 END END, 0) AS n FROM i),
c AS (SELECT *, sum(n) OVER (PARTITION BY person_id, t ORDER BY i ROWS UNBOUNDED PRECEDING) AS days, TRY_CAST(substr(t[1], 6) AS INT) AS y, TRY_CAST(substr(t[2], 5) AS INT) AS a FROM d),
p AS (SELECT person_id, t, i - 1 AS pos, y IS NOT NULL AND a IS NOT NULL AS known, year(make_date(coalesce(y, 1900), 1, 1) + CAST(days AS INT)) AS yy, y - a AS born FROM c WHERE x IN ('VS', '[VS]'))
"""


@R.query("sequence_demographics_at_visits", _PROMPTS + "SELECT person_id, pos, CASE WHEN known THEN 'year:' || yy ELSE 'year:unknown' END AS year, CASE WHEN known THEN 'age:' || (yy - born) ELSE 'age:unknown' END AS age, t[3] AS gender, t[4] AS race FROM p")
def sequence_demographics_at_visits(spark, sf_dir: str) -> DataFrame:
    return prompts_at_visits(sequences(spark, sf_dir), "person_id", "t")


@R.query("sequence_truncate_right", _S + f"""SELECT person_id, array_to_string(CASE WHEN len(t) <= {MOST} THEN t WHEN len([i FOR i IN range(1, {MOST + 1}) IF t[i] IN ('VE', '[VE]')]) > 0 THEN t[:list_max([i FOR i IN range(1, {MOST + 1}) IF t[i] IN ('VE', '[VE]')]) - 1] ELSE t[:{MOST}] END, ' ') AS t FROM s""")
def sequence_truncate_right(spark, sf_dir: str) -> DataFrame:
    return sequences(spark, sf_dir).select("person_id", F.array_join(truncate_right(F.col("t"), MOST), " ").alias("t"))


@R.query("sequence_truncate_left", _S + f"""SELECT person_id, array_to_string(CASE WHEN len(t) <= {MOST} THEN t ELSE t[coalesce(list_min([i FOR i IN range(len(t) - {MOST - 1}, len(t) + 1) IF t[i] IN ('VS', '[VS]')]), len(t) - {MOST - 1}):] END, ' ') AS t FROM s""")
def sequence_truncate_left(spark, sf_dir: str) -> DataFrame:
    return sequences(spark, sf_dir).select("person_id", F.array_join(truncate_left(F.col("t"), MOST), " ").alias("t"))


@R.query("sequence_truncate_recent", _PROMPTS + f""", f AS (SELECT person_id, t, min(pos) AS pos FROM p WHERE len(t) > {MOST} AND len(t) - pos <= {MOST - HEADER} GROUP BY ALL),
h AS (SELECT p.* FROM p JOIN f USING (person_id, t, pos))
SELECT s.person_id, array_to_string(CASE WHEN len(s.t) <= {MOST} THEN s.t WHEN h.pos IS NULL THEN s.t[len(s.t) - {MOST - 1}:] ELSE list_concat([CASE WHEN known THEN 'year:' || yy ELSE 'year:unknown' END, CASE WHEN known THEN 'age:' || (yy - born) ELSE 'age:unknown' END, coalesce(s.t[3], '0'), coalesce(s.t[4], '0')], s.t[h.pos + 1:]) END, ' ') AS t
FROM s LEFT JOIN h ON s.person_id = h.person_id AND s.t = h.t""")
def sequence_truncate_recent(spark, sf_dir: str) -> DataFrame:
    s = sequences(spark, sf_dir).groupBy("person_id", "t").agg(F.lit(1)).select(F.struct("person_id", F.md5(F.array_join("t", " ").cast("binary"))).alias("k"), "t")
    return truncate_recent(s, "k", "t", MOST).select("k.person_id", F.array_join("t", " ").alias("t"))


@R.query("sequence_slices", _S + f""", c AS (SELECT person_id, t, [i - 1 FOR i IN range(5, len(t) - {MOST - HEADER} + 1) IF t[i] IN ('VS', '[VS]')] AS c FROM s) SELECT person_id, len(c) AS n_candidates FROM c""")
def sequence_slices(spark, sf_dir: str) -> DataFrame:
    """How many visit starts a random slice of each sequence may begin at."""
    return sequences(spark, sf_dir).select("person_id", F.size(slice_candidates(F.col("t"), MOST)).alias("n_candidates"))


def _one(spark, sf_dir: str) -> DataFrame:
    """One sequence a person, the greatest of several."""
    return persisted(sequences(spark, sf_dir).groupBy("person_id").agg(F.max("t").alias("t")), "one")


def _u(seed: int) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', person_id::VARCHAR, '{seed}')), 1, 12))::BIGINT + 0.5) / 281474976710656.0"


_SLICES = _PROMPTS.rstrip() + f""", o AS (SELECT person_id, max(t) AS t FROM s GROUP BY 1), sc AS (SELECT person_id, t, [i - 1 FOR i IN range({HEADER + 1}, least(len(t), len(t) - {MOST - HEADER}) + 1) IF t[i] IN ('VS', '[VS]')] AS cs FROM o),
sl AS (SELECT person_id, t, unnest(cs) AS first FROM sc), se AS (SELECT sl.*, coalesce(list_max([j FOR j IN range(first + 1, least(first + {MOST - HEADER}, len(t)) + 1) IF t[j] IN ('VE', '[VE]')]) - 1, first) AS last FROM sl),
sh AS (SELECT se.*, CASE WHEN known THEN 'year:' || yy ELSE 'year:unknown' END AS year, CASE WHEN known THEN 'age:' || (yy - born) ELSE 'age:unknown' END AS age FROM se JOIN p ON se.person_id = p.person_id AND se.t = p.t AND se.first = p.pos),
dn AS (SELECT person_id, t, coalesce(cs[CAST(floor({_u(0)} * len(cs)) AS INT) + 1], -1) AS pick FROM sc),
dr AS (SELECT dn.person_id, dn.t, greatest(pick, 0) AS first, coalesce(last, 0) AS last, year, age, CASE WHEN year IS NOT NULL THEN dn.t[3] END AS gender, CASE WHEN year IS NOT NULL THEN dn.t[4] END AS race FROM dn LEFT JOIN sh ON dn.person_id = sh.person_id AND pick = sh.first)"""


@R.query("sequence_slice_headers", _SLICES + " SELECT person_id, first, last, year, age, t[3] AS gender, t[4] AS race FROM sh")
def sequence_slice_headers(spark, sf_dir: str) -> DataFrame:
    """Every possible slice of each person's sequence, with its renewed header."""
    return slices(_one(spark, sf_dir), "person_id", "t", MOST)


@R.query("sequence_random_slices", _SLICES + " SELECT person_id, first, last, year, age, gender, race FROM dr")
def sequence_random_slices(spark, sf_dir: str) -> DataFrame:
    return random_slice(_one(spark, sf_dir), "person_id", "t", MOST)


@R.query("sequence_pretraining_cut", _SLICES + f""", rc AS (SELECT *, CASE WHEN len(t) <= {MOST} THEN t WHEN len([i FOR i IN range(1, {MOST + 1}) IF t[i] IN ('VE', '[VE]')]) > 0 THEN t[:list_max([i FOR i IN range(1, {MOST + 1}) IF t[i] IN ('VE', '[VE]')]) - 1] ELSE t[:{MOST}] END AS r FROM dr)
SELECT person_id, array_to_string(CASE WHEN len(t) > {MOST} AND {_u(1)} < 0.5 AND year IS NOT NULL THEN list_concat([year, age, coalesce(gender, '0'), coalesce(race, '0')], t[first + 1 : last + 1]) ELSE r END, ' ') AS t FROM rc""")
def sequence_pretraining_cut(spark, sf_dir: str) -> DataFrame:
    """Sequences cut for pretraining: by draw a slice or the start."""
    return pretraining_cut(_one(spark, sf_dir), "person_id", "t", MOST).select("person_id", F.array_join("t", " ").alias("t"))


def built_sequences(spark, sf_dir: str) -> DataFrame:
    """Sequences of all persons from the valid visits, and the conditions and measurements in them."""
    from .intervals import latest_version

    text = lambda c: F.col(c).cast("string")
    person = table(spark, sf_dir, "person").where("person_id is not null and birth_datetime is not null")
    person = person.groupBy("person_id").agg(F.max(F.struct("loaded_at", "birth_datetime", "gender_concept_id", "race_concept_id")).alias("p")).select("person_id", F.col("p.birth_datetime").alias("birth"), F.col("p.gender_concept_id").cast("string").alias("gender"), F.col("p.race_concept_id").cast("string").alias("race"))
    v = latest_version(table(spark, sf_dir, "visit_occurrence"), "visit_occurrence_id", "loaded_at", ["deleted_at", "person_id", "visit_concept_id", "visit_start_datetime", "visit_end_datetime", "discharged_to_concept_id"]).where("deleted_at is null")
    visits = v.select("person_id", F.col("visit_occurrence_id").alias("visit_id"), text("visit_concept_id").alias("visit_type"), F.col("visit_start_datetime").alias("start"), F.col("visit_end_datetime").alias("end"), text("discharged_to_concept_id").alias("discharge"))
    c = table(spark, sf_dir, "condition_occurrence").select(F.col("visit_occurrence_id").alias("visit_id"), F.col("condition_start_datetime").alias("time"), text("condition_concept_id").alias("code"), F.lit(None).cast("double").alias("number"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("unit"))
    m = table(spark, sf_dir, "measurement").select(F.col("visit_occurrence_id").alias("visit_id"), F.col("measurement_datetime").alias("time"), text("measurement_concept_id").alias("code"), F.col("value_as_number").alias("number"), text("value_as_concept_id").alias("text"), F.col("unit_source_value").alias("unit"))
    return build_sequences(person, visits, c.unionByName(m))


@R.query("event_sequences")
def event_sequences(spark, sf_dir: str) -> DataFrame:
    """Sequences built from the tables; tested against a step-by-step build on small fixtures."""
    return built_sequences(spark, sf_dir)


@R.query("event_sequence_counts", """
WITH v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY visit_occurrence_id ORDER BY loaded_at DESC NULLS LAST, deleted_at DESC NULLS LAST, person_id DESC NULLS LAST, visit_concept_id DESC NULLS LAST, visit_start_datetime DESC NULLS LAST) rn FROM visit_occurrence WHERE visit_occurrence_id IS NOT NULL) WHERE rn = 1 AND deleted_at IS NULL AND visit_start_datetime IS NOT NULL AND person_id IS NOT NULL),
e AS (SELECT visit_occurrence_id, condition_start_datetime AS t, condition_concept_id AS c, NULL AS x, 'N/A' AS u FROM condition_occurrence UNION ALL SELECT visit_occurrence_id, measurement_datetime, measurement_concept_id, value_as_concept_id, coalesce(unit_source_value, 'N/A') FROM measurement),
j AS (SELECT DISTINCT person_id, visit_occurrence_id, c, x, u, CASE WHEN visit_concept_id IN (9201, 262, 8971, 8920, 9203) THEN t ELSE date_trunc('day', t) END AS t FROM v JOIN e USING (visit_occurrence_id) WHERE t IS NOT NULL AND c IS NOT NULL),
n AS (SELECT person_id, count(*) AS n_events, count(DISTINCT visit_occurrence_id) AS n_with_events FROM j GROUP BY 1)
SELECT n.person_id, n_events, n_with_events, (SELECT count(*) FROM v WHERE v.person_id = n.person_id) AS num_of_visits FROM n WHERE n.person_id IN (SELECT person_id FROM person WHERE birth_datetime IS NOT NULL)""")
def event_sequence_counts(spark, sf_dir: str) -> DataFrame:
    """Distinct events, visits with events and all visits in each built sequence."""
    s = built_sequences(spark, sf_dir)
    c, unit = F.col("concept_ids"), F.col("units")
    starts = F.size(F.filter(c, lambda x: x == "[VS]"))
    stays = F.size(F.filter(F.sequence(F.lit(1), F.size(c) - 1), lambda i: (F.get(c, i - 1) == "[VS]") & F.get(c, i).isin(*BuildOptions().inpatient_types)))
    att = F.size(F.filter(c, lambda x: x.rlike("^([DWM][0-9]+|LT|i-[DH][0-9]+)$")))
    n = F.size(c) - HEADER - 3 * starts - stays - att
    return s.select("person_id", n.cast("bigint").alias("n_events"), starts.cast("bigint").alias("n_with_events"), F.col("num_of_visits").cast("bigint").alias("num_of_visits"))
