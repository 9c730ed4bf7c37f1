"""Patient sequences back to relational tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions import tokens as tk
from ..plans.registry import Registry
from ..plans.runtime import persisted, table
from ..plans.skew import broadcast_if_small, global_rank
from .sequences import HEADER, plausible_birth_year, valid_sequence

# Discharge and death concepts, domains of concepts missing from the vocabulary, and type concepts of the rows.
DIED = 4216643
DISCHARGES = [4216643, 4021968, 4146681, 4161979]
OTHER_DOMAINS = {1525734: "Drug", 779414: "Drug", 722117: "Drug", 722118: "Drug", 722119: "Drug", 905420: "Drug", 1525543: "Drug"}
VISIT_TYPE, CONDITION_TYPE, DRUG_TYPE, PROCEDURE_TYPE, NUMERIC_OPERATOR, DEATH_TYPE, DISCHARGE_DEATH = 44818702, 32817, 38000177, 38000178, 4172703, 32817, 32823
KNOWN_TIME = tk.is_known_time_token

VS, VE, TIME, STAY_DAYS, STAY_HOURS, CONCEPT, SKIP, DEATH, OTHER = range(9)
FACTS = "key bigint, pos int, kind string, visit int, concept bigint, time timestamp_ntz, until timestamp_ntz, number double, unit string"


def _classify(word: str) -> tuple[int, int]:
    """Class and number of one distinct token."""
    if word in ("VS", "[VS]"):
        return VS, 0
    if word in ("VE", "[VE]"):
        return VE, 0
    if word == "[DEATH]":
        return DEATH, 0
    if word in (tk.OOV, "START", tk.END):
        return SKIP, 0
    if word == "LT":
        return TIME, tk.LONG_TERM
    head, rest = word[:1], word[1:]
    if head in "DWM" and rest.isascii() and rest.isdigit() and str(int(rest)) == rest and int(rest) < {"D": 2000, "W": 4, "M": 12}[head]:
        return TIME, int(rest) * tk.DAYS[head]
    for prefix, kind in (("i-D", STAY_DAYS), ("VS-D", STAY_DAYS), ("i-H", STAY_HOURS)):
        number = word[len(prefix) :].removesuffix("-VE")
        if word.startswith(prefix) and number.isascii() and number.isdigit():
            return kind, int(number)
    number = word.removeprefix("Visit/")
    if number.isascii() and number.isdigit() and len(number) < 19:
        return CONCEPT, int(number)
    return OTHER, 0


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, year, gender, race, tokens, numbers, units) to facts; every column is computed for all tokens of a batch at once."""
    for b in batches:
        tokens = b.column(4)
        lo, hi = tokens.offsets[0].as_py(), tokens.offsets[-1].as_py()
        offsets = tokens.offsets.to_numpy() - lo
        n = hi - lo
        if not n:
            continue
        coded = tokens.values.slice(lo, n).dictionary_encode()
        words = coded.dictionary.to_pylist()
        kinds = np.array([_classify(w) for w in words], np.int64)
        code = coded.indices.to_numpy()
        cls, val = kinds[code, 0].copy(), kinds[code, 1]
        size = np.diff(offsets)
        row = np.repeat(np.arange(b.num_rows), size)
        first, end = np.repeat(offsets[:-1], size), np.repeat(offsets[1:], size)
        at = np.arange(n)
        number = {w: i for i, w in enumerate(words)}
        for c in (2, 3):  # the header's gender and race may be echoed
            echo = np.array([number.get(x, -1) for x in b.column(c).to_pylist()])
            cls[(code == echo[row]) & (cls == CONCEPT)] = SKIP

        def since(flag: np.ndarray) -> np.ndarray:
            """The last flagged position up to here in the row, or -1."""
            x = np.maximum.accumulate(np.where(flag, at, -1))
            return np.where(x >= first, x, -1)

        def running(x: np.ndarray) -> np.ndarray:
            total = np.cumsum(x)
            return total - np.concatenate([[0], total])[first]

        follow = np.append(cls[1:], -1)
        follow[end - 1 == at] = -1
        vs = cls == VS
        # A visit's type may be a skipped concept number as well: look at the token itself.
        follow_number = np.append(kinds[code[1:], 0], -1) == CONCEPT
        visit = vs & (follow != -1) & (follow_number & (follow != -1))
        dying = vs & (follow == DEATH)
        typed = np.concatenate([[False], visit[:-1]])
        kind = np.append(val[1:], 0)
        stay_type = visit & np.isin(kind, tk.INPATIENT_VISITS)
        ends = cls == VE
        opened = since(visit)
        closed = np.concatenate([[-1], since(ends)[:-1]])
        closed = np.where(closed >= first, closed, -1)
        inside = (opened >= 0) & (opened > closed)
        stay = inside & stay_type[np.maximum(opened, 0)]
        timed = (cls == TIME) | ((cls == STAY_DAYS) & stay)
        hourly = (cls == STAY_HOURS) & stay
        days = running(np.where(timed, val, 0))
        hours = running(np.where(hourly, val, 0))
        reset = since(timed)
        seconds = np.minimum((hours - np.where(reset >= 0, hours[np.maximum(reset, 0)], 0)) * 3600, 86_399)
        base = np.array([np.datetime64(f"{y:04d}-01-01", "us").astype(np.int64) for y in b.column(1).to_pylist()])
        time = base[row] + (days * 86_400 + seconds) * 1_000_000
        concept = (cls == CONCEPT) & ~typed
        leaving = concept & (val == DIED) & stay & np.isin(follow, (-1, VE))
        death_end = ends & stay & np.concatenate([[False], leaving[:-1]])
        final = end - 1 == at
        bad = (vs & ~final & ~visit & ~dying) | (dying & (at + 2 != end - 1)) | (ends & (opened < 0)) | ((cls == OTHER) & ~typed) | ((cls == STAY_DAYS) & ~stay) | ((cls == STAY_HOURS) & ~stay) | (concept & (val == DIED) & ~leaving)
        stopped = since(death_end)
        live = (stopped < 0) | (stopped == at)
        bad &= live
        until = np.full(n, np.iinfo(np.int64).min)
        closes = ends & inside & live
        until[opened[closes]] = np.where(stay[closes], time[closes], until[opened[closes]])
        no = running(visit.astype(np.int64))
        key = b.column(0).to_numpy()
        death = live & ((dying & (at + 2 == end - 1)) | death_end)
        out = [(visit & live, "visit"), (concept & live & (opened >= 0), "event"), (death, "death"), (bad, "bad")]
        for flag, name in out:
            i = np.flatnonzero(flag)
            if not len(i):
                continue
            given = (kind if name == "visit" else val)[i]
            if name == "death":
                given = np.where(death_end[i], DISCHARGE_DEATH, DEATH_TYPE)
            some = pa.array(i + lo)
            last = pa.array(until[i], pa.int64(), mask=until[i] == np.iinfo(np.int64).min).cast(pa.timestamp("us"))
            # typed as event
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[row[i]]), pa.array((at - first)[i].astype(np.int32)), pa.array([name] * len(i)), pa.array(no[i].astype(np.int32)), pa.array(given), pa.array(time[i]).cast(pa.timestamp("us")), last, b.column(5).values.take(some), b.column(6).values.take(some)],
                ["key", "pos", "kind", "visit", "concept", "time", "until", "number", "unit"],
            )


def valid_rows(df: DataFrame, as_of_year: int = 2026) -> DataFrame:
    """One valid row per person: ``key, t, values, units`` with parallel arrays, blanks and a leading start token removed.

    Of several rows of a person the longest, then the greatest in order, holds. Rows without person are left out.
    """
    z = F.filter(F.transform(F.arrays_zip("concept_ids", F.coalesce("values", F.array().cast("array<double>")).alias("values"), F.coalesce("units", F.array().cast("array<string>")).alias("units")), lambda x: F.struct(F.btrim(x["concept_ids"], F.lit(tk.BLANKS)).alias("c"), x["values"].alias("v"), x["units"].alias("u"))), lambda x: F.length(x["c"]) > 0)
    rows = df.where("person_id is not null and concept_ids is not null").select(F.col("person_id").cast("bigint").alias("key"), z.alias("z"))
    rows = rows.withColumn("z", F.when(F.lower(F.get("z.c", F.lit(0))).contains("start"), F.slice("z", 2, F.greatest(F.size("z") - 1, F.lit(0)))).otherwise(F.col("z")))
    one = rows.groupBy("key").agg(F.max(F.struct(F.size("z").alias("n"), F.col("z.c").alias("c"), F.col("z.v").alias("v"), F.col("z.u").alias("u"))).alias("m"))
    c = F.col("m.c")
    return one.where(valid_sequence(c) & plausible_birth_year(c, as_of_year)).select("key", c.alias("t"), F.col("m.v").alias("values"), F.col("m.u").alias("units"))


def facts(rows: DataFrame) -> DataFrame:
    """Visits, events, deaths and faults of each valid sequence. Row-local: nothing is shuffled."""
    n = F.size("t") - HEADER - F.when(F.get("t", F.size("t") - 1) == tk.END, 1).otherwise(0)
    cut = lambda c: F.slice(c, HEADER + 1, n)
    return rows.select("key", F.substring(F.col("t")[0], 6, 12).cast("int").alias("year"), F.col("t")[2].alias("g"), F.col("t")[3].alias("r"), cut("t").alias("t"), cut("values").alias("v"), cut("units").alias("u")).mapInArrow(_walk, FACTS)


def domains(concept: DataFrame) -> DataFrame:
    """``concept, domain``: one row per known concept; a null domain stays null."""
    return concept.where("concept_id is not null").groupBy(F.col("concept_id").cast("bigint").alias("concept")).agg(F.min("domain_id").alias("domain"))


class OmopTables:
    """The relational tables of a set of sequences, all from one written table of facts.

    A sequence with any fault before its end is rejected whole. Faults: a visit
    start without a visit type of domain Visit (or 0), a visit end before any visit, a death
    marker that is not last but one, a time token of a stay outside one,
    a token that is no number, a number that no vocabulary knows, death outside a stay or not at its end.

    Deviations from the usual converter, each a repair: a closing [END] is
    accepted; the visit type is no event of its own; ``Visit/9201`` is accepted;
    a stay ends with its visit; events before any visit are dropped.
    """

    def __init__(self, sequences: DataFrame, concept: DataFrame):
        self.valid = valid_rows(sequences)
        found = facts(self.valid)
        known = broadcast_if_small(domains(concept))
        other = F.create_map(*[F.lit(x) for k, v in OTHER_DOMAINS.items() for x in (k, v)])
        c = F.col("concept")
        joined = found.join(known.withColumn("known", F.lit(True)), "concept", "left")
        domain = F.coalesce("domain", F.get(F.array(other[c.cast("int")]), F.lit(0)))
        known = F.coalesce("known", F.lit(False)) | c.isin(*OTHER_DOMAINS)
        bad = (F.col("kind") == "bad") | ((F.col("kind") == "event") & ~known) | ((F.col("kind") == "visit") & (c != 0) & ~(F.coalesce("known", F.lit(False)) & (F.coalesce("domain", F.lit("")) == "Visit")))
        # Written once, a folder for each kind and domain, so that every table reads its own rows only.
        part = F.when(bad, "bad").when(F.col("kind") == "event", F.concat(F.lit("event-"), F.coalesce(domain, F.lit("")))).otherwise(F.col("kind"))
        self.all = persisted(joined.select("key", "pos", "kind", "visit", "concept", "time", "until", "number", "unit", domain.alias("domain"), part.alias("part")), "facts", by="part")
        self.rejected = self.all.where("part = 'bad'").groupBy("key").agg(F.min_by("kind", "pos").alias("kind"), F.min("pos").alias("pos"))
        self.good = self.all.join(self.rejected.select("key"), "key", "left_anti")

    def person(self) -> DataFrame:
        t = F.col("t")
        rows = self.valid.join(self.rejected, "key", "left_anti")
        born = F.substring(t[0], 6, 12).cast("int") - F.substring(t[1], 5, 12).cast("int")
        return rows.select(F.col("key").alias("person_id"), tk.prefixed_concept(t[2], "Gender/").alias("gender_concept_id"), born.alias("year_of_birth"), tk.prefixed_concept(t[3], "Race/").alias("race_concept_id"))

    def visits(self) -> DataFrame:
        """``person_id, visit, visit_concept_id, start, end, discharged_to_concept_id``; only stays have an end and discharge of their own."""
        v = self.good.where("part = 'visit'")
        is_discharge = (F.col("domain") == "Visit") | F.col("concept").isin(*DISCHARGES)
        d = self.good.where(F.col("part").startswith("event-") & is_discharge).groupBy("key", "visit").agg(F.max_by("concept", "pos").alias("d"))
        j = v.join(d, ["key", "visit"], "left")
        stay = F.col("until").isNotNull()
        return j.select(F.col("key").alias("person_id"), "visit", F.col("concept").alias("visit_concept_id"), F.col("time").alias("visit_start_datetime"), F.coalesce("until", "time").alias("visit_end_datetime"), F.when(stay, F.coalesce("d", F.lit(0))).otherwise(0).cast("bigint").alias("discharged_to_concept_id"), F.lit(VISIT_TYPE).alias("visit_type_concept_id"))

    def events(self, domain: str) -> DataFrame:
        e = self.good.where((F.col("part") == f"event-{domain}") & ~F.col("concept").isin(*DISCHARGES))
        return e.select(F.col("key").alias("person_id"), "visit", "pos", F.col("concept").alias("concept_id"), F.col("time").alias("datetime"), "number", "unit")

    def conditions(self) -> DataFrame:
        return self.events("Condition").withColumn("type_concept_id", F.lit(CONDITION_TYPE)).drop("number", "unit")

    def drugs(self) -> DataFrame:
        return self.events("Drug").withColumn("type_concept_id", F.lit(DRUG_TYPE)).drop("number", "unit")

    def procedures(self) -> DataFrame:
        return self.events("Procedure").withColumn("type_concept_id", F.lit(PROCEDURE_TYPE)).drop("number", "unit")

    def measurements(self) -> DataFrame:
        return self.events("Measurement").withColumnRenamed("number", "value_as_number").withColumnRenamed("unit", "unit_source_value").withColumn("operator_concept_id", F.when(F.col("value_as_number").isNotNull(), NUMERIC_OPERATOR))

    def deaths(self) -> DataFrame:
        """One per person, the last."""
        return self.good.where("part = 'death'").groupBy("key").agg(F.max(F.struct("pos", "time", "concept")).alias("d")).select(F.col("key").alias("person_id"), F.col("d.time").cast("date").alias("death_date"), F.col("d.concept").alias("death_type_concept_id"))

    def with_ids(self, df: DataFrame, name: str, order: list[str]) -> DataFrame:
        """Adds a dense key from 1 over all partitions."""
        return global_rank(df, [F.col(c) for c in order]).withColumn(name, F.col("rank") + 1).drop("rank")


def omop_tables(spark, sf_dir: str) -> OmopTables:
    return OmopTables(table(spark, sf_dir, "processed_dataset"), table(spark, sf_dir, "concept"))


R = Registry()
_FACTS = """
WITH z AS (SELECT person_id, [{'c': trim(concept_ids[i], ' ' || chr(9) || chr(10) || chr(13)), 'v': "values"[i], 'u': units[i]} FOR i IN range(1, len(concept_ids) + 1) IF trim(concept_ids[i], ' ' || chr(9) || chr(10) || chr(13)) <> ''] AS z FROM processed_dataset WHERE person_id IS NOT NULL AND concept_ids IS NOT NULL),
y AS (SELECT person_id, CASE WHEN contains(lower(z[1].c), 'start') THEN z[2:] ELSE z END AS z FROM z),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY len(z) DESC) AS k FROM y) WHERE k = 1),
p AS (SELECT person_id, z[1].c AS y0, z[2].c AS a0, z[3].c AS g0, z[4].c AS r0, CASE WHEN z[-1].c = '[END]' THEN z[5:len(z) - 1] ELSE z[5:] END AS z FROM o
 WHERE len(z) > 4 AND z[-1].c IN ('VE', '[VE]', '[END]') AND contains(lower(z[1].c), 'year') AND TRY_CAST(substr(z[1].c, 6) AS INT) - TRY_CAST(substr(z[2].c, 5) AS INT) BETWEEN 1900 AND 2026),
e AS (SELECT person_id, y0, a0, g0, r0, len(z) AS n, unnest(range(1, len(z) + 1)) AS i, unnest(z) AS w FROM p),
c AS (SELECT *, w.c AS x, lead(w.c) OVER q AS nx, lag(w.c) OVER q AS px, w.c IN ('VS', '[VS]') AS vs, w.c IN ('VE', '[VE]') AS ve,
  regexp_matches(w.c, '^(Visit/)?[0-9]{1,18}$') AS num, CASE WHEN w.c = 'LT' THEN 1095 WHEN regexp_matches(w.c, '^(D(0|[1-9][0-9]{0,2}|1[0-9]{3})|W[0-3]|M([0-9]|1[01]))$') THEN CAST(substr(w.c, 2) AS INT) * CASE w.c[1] WHEN 'D' THEN 1 WHEN 'W' THEN 7 ELSE 30 END END AS td,
  TRY_CAST(regexp_extract(w.c, '^(i-|VS-)D([0-9]+)(-VE)?$', 2) AS INT) AS sd, TRY_CAST(regexp_extract(w.c, '^i-H([0-9]+)$', 1) AS INT) AS sh
  FROM e WINDOW q AS (PARTITION BY person_id ORDER BY i)),
v AS (SELECT *, vs AND coalesce(regexp_matches(nx, '^(Visit/)?[0-9]{1,18}$'), false) AS visit, vs AND coalesce(nx = '[DEATH]', false) AS dying FROM c),
v2 AS (SELECT *, coalesce(lag(visit) OVER q, false) AS typed, count(*) FILTER (visit) OVER (q ROWS UNBOUNDED PRECEDING) AS no,
  max(CASE WHEN visit THEN i END) OVER (q ROWS UNBOUNDED PRECEDING) AS op, max(CASE WHEN ve THEN i END) OVER (q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cl,
  CASE WHEN visit THEN CAST(replace(nx, 'Visit/', '') AS BIGINT) END AS vt FROM v WINDOW q AS (PARTITION BY person_id ORDER BY i)),
v3 AS (SELECT *, op IS NOT NULL AND op > coalesce(cl, 0) AND last_value(vt IGNORE NULLS) OVER (PARTITION BY person_id ORDER BY i ROWS UNBOUNDED PRECEDING) IN (9201, 262, 8971, 8920) AS stay FROM v2),
v4 AS (SELECT *, td IS NOT NULL OR (sd IS NOT NULL AND stay) AS timed, sum(coalesce(td, CASE WHEN stay THEN sd END, 0)) OVER q AS days, sum(CASE WHEN stay THEN coalesce(sh, 0) ELSE 0 END) OVER q AS hh,
  num AND NOT typed AND x <> coalesce(g0, '') AND x <> coalesce(r0, '') AS ev FROM v3 WINDOW q AS (PARTITION BY person_id ORDER BY i ROWS UNBOUNDED PRECEDING)),
v5 AS (SELECT *, hh - coalesce(last_value(CASE WHEN timed THEN hh END IGNORE NULLS) OVER (PARTITION BY person_id ORDER BY i ROWS UNBOUNDED PRECEDING), 0) AS h, CASE WHEN num THEN CAST(replace(x, 'Visit/', '') AS BIGINT) END AS k FROM v4),
v6 AS (SELECT *, make_timestamp(CAST(substr(y0, 6) AS INT), 1, 1, 0, 0, 0) + to_days(CAST(days AS INT)) + to_seconds(CAST(least(h * 3600, 86399) AS INT)) AS tm FROM v5),
f AS (SELECT v6.*, d.domain, d.k IS NOT NULL AS known, dv.domain AS vdomain FROM v6 LEFT JOIN (SELECT concept_id AS k, min(domain_id) AS domain FROM concept GROUP BY 1) d ON ev AND v6.k = d.k
  LEFT JOIN (SELECT concept_id AS k, min(domain_id) AS domain FROM concept GROUP BY 1) dv ON vt = dv.k),
bad AS (SELECT DISTINCT person_id FROM f WHERE (vs AND i < n AND NOT visit AND NOT dying) OR (dying AND i + 1 <> n - 1) OR (ve AND op IS NULL)
  OR (NOT vs AND NOT ve AND NOT num AND td IS NULL AND sd IS NULL AND sh IS NULL AND x NOT IN ('[DEATH]', '[OOV]', 'START', '[END]')) OR ((sd IS NOT NULL OR sh IS NOT NULL) AND NOT stay)
  OR (ev AND op IS NOT NULL AND NOT coalesce(known, false) AND k NOT IN (1525734, 779414, 722117, 722118, 722119, 905420, 1525543)) OR (visit AND vt <> 0 AND coalesce(vdomain, '') <> 'Visit')),
g AS (SELECT * FROM f WHERE person_id NOT IN (FROM bad))
"""


@R.query("omop_person", _FACTS + "SELECT person_id, coalesce(TRY_CAST(replace(g0, 'Gender/', '') AS BIGINT), 0) AS gender_concept_id, CAST(substr(y0, 6) AS INT) - CAST(substr(a0, 5) AS INT) AS year_of_birth, coalesce(TRY_CAST(replace(r0, 'Race/', '') AS BIGINT), 0) AS race_concept_id FROM p WHERE person_id NOT IN (FROM bad)")
def omop_person(spark, sf_dir: str) -> DataFrame:
    return omop_tables(spark, sf_dir).person()


@R.query("sequence_to_visits", _FACTS + """, en AS (SELECT person_id, no, min(tm) AS until FROM g WHERE ve AND stay GROUP BY ALL),
dd AS (SELECT person_id, no, max_by(k, i) AS d FROM g WHERE ev AND (domain = 'Visit' OR k IN (4216643, 4021968, 4146681, 4161979)) GROUP BY ALL)
SELECT g.person_id, g.no AS visit, vt AS visit_concept_id, tm AS visit_start_datetime, coalesce(until, tm) AS visit_end_datetime, CASE WHEN until IS NOT NULL THEN coalesce(d, 0) ELSE 0 END AS discharged_to_concept_id, 44818702 AS visit_type_concept_id
FROM g LEFT JOIN en ON g.person_id = en.person_id AND g.no = en.no LEFT JOIN dd ON g.person_id = dd.person_id AND g.no = dd.no WHERE visit""")
def sequence_to_visits(spark, sf_dir: str) -> DataFrame:
    return omop_tables(spark, sf_dir).visits()


def _events_sql(domain: str, type_id: int) -> str:
    return _FACTS + f"SELECT person_id, no AS visit, i - 1 AS pos, k AS concept_id, tm AS datetime, {type_id} AS type_concept_id FROM g WHERE ev AND op IS NOT NULL AND coalesce(domain, CASE WHEN k IN (1525734, 779414, 722117, 722118, 722119, 905420, 1525543) THEN 'Drug' END) = '{domain}' AND k NOT IN (4216643, 4021968, 4146681, 4161979)"


@R.query("sequence_to_conditions", _events_sql("Condition", CONDITION_TYPE))
def sequence_to_conditions(spark, sf_dir: str) -> DataFrame:
    return omop_tables(spark, sf_dir).conditions()


@R.query("sequence_to_drugs", _events_sql("Drug", DRUG_TYPE))
def sequence_to_drugs(spark, sf_dir: str) -> DataFrame:
    return omop_tables(spark, sf_dir).drugs()


@R.query("sequence_to_procedures", _events_sql("Procedure", PROCEDURE_TYPE))
def sequence_to_procedures(spark, sf_dir: str) -> DataFrame:
    return omop_tables(spark, sf_dir).procedures()


@R.query("sequence_to_measurements", _FACTS + "SELECT person_id, no AS visit, i - 1 AS pos, k AS concept_id, tm AS datetime, w.v AS value_as_number, w.u AS unit_source_value, CASE WHEN w.v IS NOT NULL THEN 4172703 END AS operator_concept_id FROM g WHERE ev AND op IS NOT NULL AND domain = 'Measurement'")
def sequence_to_measurements(spark, sf_dir: str) -> DataFrame:
    return omop_tables(spark, sf_dir).measurements()


@R.query("sequence_to_deaths", _FACTS + "SELECT person_id, tm::DATE AS death_date, 32817 AS death_type_concept_id FROM g WHERE dying")
def sequence_to_deaths(spark, sf_dir: str) -> DataFrame:
    return omop_tables(spark, sf_dir).deaths()


@R.query("sequence_bad_persons", _FACTS + "SELECT person_id FROM bad")
def sequence_bad_persons(spark, sf_dir: str) -> DataFrame:
    return omop_tables(spark, sf_dir).rejected.select(F.col("key").alias("person_id"))


@R.query("rejected_sequences", _FACTS + "SELECT person_id, array_to_string(list_concat([y0, a0, g0, r0], [q.c FOR q IN z]), ' ') AS tokens FROM p WHERE person_id IN (FROM bad)")
def rejected_sequences(spark, sf_dir: str) -> DataFrame:
    """The sequences that the conversion rejects, without a closing [END]."""
    t = omop_tables(spark, sf_dir)
    tokens = F.when(F.get("t", F.size("t") - 1) == tk.END, F.slice("t", 1, F.size("t") - 1)).otherwise(F.col("t"))
    return t.valid.join(t.rejected.select("key"), "key").select(F.col("key").alias("person_id"), F.array_join(tokens, " ").alias("tokens"))


@R.query("conversion_totals", _FACTS + "SELECT (SELECT count(*) FROM p) AS n_sequences, (SELECT count(*) FROM bad) AS n_rejected, (SELECT count(*) FROM g WHERE visit) AS n_visits, (SELECT count(*) FROM g WHERE ev AND op IS NOT NULL) AS n_events")
def conversion_totals(spark, sf_dir: str) -> DataFrame:
    """Valid sequences, rejected ones, and visits and events of the others."""
    t = omop_tables(spark, sf_dir)
    n = t.valid.agg(F.count("*").alias("n_sequences"))
    bad = t.rejected.agg(F.count("*").alias("n_rejected"))
    made = t.good.agg(F.count_if(F.col("part") == "visit").alias("n_visits"), F.count_if(F.col("part").startswith("event-")).alias("n_events"))
    return n.join(F.broadcast(bad), F.lit(True)).join(F.broadcast(made), F.lit(True))


@R.query("visit_ids", _FACTS + "SELECT row_number() OVER (ORDER BY person_id, no) AS visit_occurrence_id, person_id, no AS visit FROM g WHERE visit")
def visit_ids(spark, sf_dir: str) -> DataFrame:
    """Dense visit keys by person and visit."""
    t = omop_tables(spark, sf_dir)
    return t.with_ids(t.visits().select("person_id", "visit"), "visit_occurrence_id", ["person_id", "visit"])


@R.query("domain_routing", _FACTS + "SELECT domain, count(*) AS n_events, count(DISTINCT person_id) AS n_persons FROM g WHERE ev AND op IS NOT NULL GROUP BY 1")
def domain_routing(spark, sf_dir: str) -> DataFrame:
    """Events and persons per domain (null: a concept without domain)."""
    return omop_tables(spark, sf_dir).good.where("part like 'event-%'").groupBy("domain").agg(F.count("*").alias("n_events"), F.count_distinct("key").alias("n_persons"))
