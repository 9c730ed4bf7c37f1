"""Core operators on small fixtures: pinned values, brute force, nulls, ties, repeated rows, empty tables, clashing names."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from patientflow.functions import tokens as tk
from patientflow.operators import derive, labstats, omop, pack, privacy, sequences, splits, tte
from patientflow.operators.intervals import merge_intervals, periods_and_gaps, visit_periods
from patientflow.operators.references import Parent, References, orphan_references
from patientflow.plans import skew
from patientflow.plans.skew import global_rank, hot_keys, skew_join


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


T = dt.datetime
S = "person_id bigint, visit_start_datetime timestamp_ntz, visit_end_datetime timestamp_ntz"


# --- tokens
@pytest.mark.parametrize("token,days", [("D7", 7), ("W1", 7), ("M1", 30), ("Y1", 365), ("LT", 1095), ("i-D5", 5), ("VS-D7-VE", 7), ("i-W2", 2), ("VS-LT-VE", 1095), ("abc", None), ("Dx", None), (None, None)])
def test_interval_days(spark, token, days):
    assert one(spark, tk.interval_days(F.lit(token).cast("string"))) == days


@pytest.mark.parametrize("token,yes", [("VS-D7", True), ("VS-D7-VE", True), ("i-D7", True), ("i-D7-VE", True), ("V-D7", False), ("D7-VE", False), ("i-W2", False)])
def test_inpatient_token(spark, token, yes):
    assert one(spark, tk.is_inpatient_att_token(F.lit(token))) is yes


def test_time_tuple(spark):
    assert one(spark, tk.time_tuple(F.lit(400), F.lit(True))) == ["year:1", "month:1", "i-day:5"]
    with pytest.raises(Exception, match="negative"):
        one(spark, tk.time_tuple(F.lit(-10), F.lit(False)))
    with pytest.raises(Exception, match="Invalid time token"):
        one(spark, tk.interval_days(F.lit("nope"), strict=True))


def test_age_in_years_leap_day(spark):
    birth = F.lit("2004-02-29 12:00:00").cast("timestamp_ntz")
    for at, age in (("2023-02-28 11:59:00", 18), ("2023-02-28 12:00:00", 19), ("2024-02-28 12:00:00", 19), ("2024-02-29 12:00:00", 20)):
        assert one(spark, tk.age_in_years(birth, F.lit(at).cast("timestamp_ntz"))) == age


def test_whole_days_is_not_datediff(spark):
    a, b = F.lit("2020-01-02 01:00:00").cast("timestamp_ntz"), F.lit("2020-01-01 23:00:00").cast("timestamp_ntz")
    assert one(spark, tk.whole_days(a, b)) == 0
    assert one(spark, tk.whole_days(b, a)) == -1


# --- skew helpers
def test_skew_join_and_rank(spark):
    left = spark.createDataFrame([(1, i) for i in range(400)] + [(k, 0) for k in range(2, 60)] + [(None, 5)], "k int, v int")
    right = spark.createDataFrame([(k, k * 10) for k in range(1, 40)], "k int, w int")
    assert hot_keys(left, "k") == [1]
    many = right.unionAll(right)
    for spread in (None, {1: 7, 2: 2}):
        assert sorted(map(str, skew.spread_join(left, many, "k", spread).collect())) == sorted(map(str, left.join(many, "k").collect()))
    for how in ("inner", "left", "left_semi", "left_anti"):
        a = sorted(map(str, skew_join(left, right, "k", how).collect()))
        assert a == sorted(map(str, left.join(right, "k", how).collect()))
    r = global_rank(left, [F.col("k"), F.col("v")]).orderBy("rank").collect()
    assert [x["rank"] for x in r] == list(range(len(r)))
    per = global_rank(left, [F.col("v")], per="k").groupBy("k").agg(F.max("rank").alias("m"), F.count("*").alias("n")).collect()
    assert all(x.m == x.n - 1 for x in per)
    assert global_rank(left.where("v < -1"), [F.col("v")]).count() == 0


# --- intervals
def brute_periods(rows):
    out = []
    for p in {r[0] for r in rows if r[0] is not None}:
        mine = sorted((s, max(s, e or s)) for q, s, e in rows if q == p and s is not None)
        cur, prev = None, None
        for s, e in mine:
            if cur and s <= cur[1]:
                cur = [cur[0], max(cur[1], e), cur[2] + 1, cur[3]]
            else:
                if cur:
                    out.append((p, *cur))
                    prev = cur[1]
                cur = [s, e, 1, prev]
        if cur:
            out.append((p, *cur))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_merge_intervals(spark, seed):
    rng = random.Random(seed)
    base = T(2020, 1, 1)
    rows = []
    for _ in range(300):
        p = 1 if rng.random() < 0.5 else rng.choice([2, 3, 4, 5, None])
        s = None if rng.random() < 0.03 else base + dt.timedelta(hours=rng.randrange(30_000))
        e = None if rng.random() < 0.1 or s is None else s + dt.timedelta(hours=rng.randrange(-20, 90))
        rows += [(p, s, e)] * (2 if rng.random() < 0.1 else 1)
    df = spark.createDataFrame(rows, S).withColumn("entity", F.lit("clash")).withColumn("start", F.lit(1)).withColumn("n", F.lit(2))
    got = sorted(map(tuple, merge_intervals(df, "person_id", "visit_start_datetime", "visit_end_datetime").select("entity", "start", "end", "n", "prev_end").collect()), key=str)
    assert got == sorted(brute_periods(rows), key=str)


def test_merge_intervals_one_long_period_over_all_partitions(spark):
    rows = [(7, T(2020, 1, 1), T(2030, 1, 1))] + [(7, T(2020, 1, 1) + dt.timedelta(days=i), T(2020, 1, 1) + dt.timedelta(days=i)) for i in range(2000)]
    got = merge_intervals(spark.createDataFrame(rows, S), "person_id", "visit_start_datetime", "visit_end_datetime").collect()
    assert [(r.start, r.end, r.n, r.prev_end) for r in got] == [(T(2020, 1, 1), T(2030, 1, 1), 2001, None)]


def test_merge_intervals_text_entity_and_empty(spark):
    df = spark.createDataFrame([("a", T(2020, 1, 1), None), ("a", T(2020, 1, 1), T(2020, 1, 2)), ("b", T(2020, 1, 1), None)], S.replace("bigint", "string"))
    got = sorted((r.entity, r.n) for r in merge_intervals(df, "person_id", "visit_start_datetime", "visit_end_datetime").collect())
    assert got == [("a", 2), ("b", 1)]
    assert merge_intervals(df.where("person_id = 'z'"), "person_id", "visit_start_datetime", "visit_end_datetime").count() == 0


def test_visit_periods_versions_and_gap_edge(spark):
    v = spark.createDataFrame(
        [(1, 1, T(2020, 1, 1), T(2020, 1, 2), T(2020, 2, 1), None), (1, 1, T(2020, 1, 1), T(2020, 1, 5), T(2020, 3, 1), None), (2, 1, T(2020, 1, 5), None, T(2020, 2, 1), None),
         (3, 1, T(2021, 1, 4), None, T(2020, 2, 1), None), (4, 1, T(2022, 1, 4, 0, 0, 1), None, T(2020, 2, 1), None), (5, 1, T(2020, 6, 1), None, T(2020, 2, 1), T(2020, 7, 1))],
        "visit_occurrence_id bigint, person_id bigint, visit_start_datetime timestamp_ntz, visit_end_datetime timestamp_ntz, loaded_at timestamp_ntz, deleted_at timestamp_ntz",
    )
    got = sorted(map(tuple, periods_and_gaps(visit_periods(v)).collect()))
    assert got == [("gap", 1, "2021-01-04 00:00:00", "2022-01-04 00:00:01"), ("period", 1, "2020-01-01 00:00:00", "2020-01-05 00:00:00")]


# --- references
def test_orphan_references(spark):
    d = lambda n: T(2020, 1, n)
    person = spark.createDataFrame([(1, d(5), None), (1, d(9), None), (2, d(1), d(3)), (3, d(20), None), (3, d(1), d(2)), (4, None, None), (-7, d(1), None)] + [(k, d(1), None) for k in range(5000, 14000)], "person_id bigint, loaded_at timestamp_ntz, deleted_at timestamp_ntz")
    rows = [(10, 1, d(6)), (11, 1, d(4)), (11, 1, d(8)), (12, 2, d(8)), (13, 3, d(10)), (14, 99, d(1)), (15, None, d(1)), (16, 4, d(1)), (17, 3, None), (18, -7, d(2)), (None, 98, d(1)), (19, 4999, d(2)), (20, 13999, d(2)), (21, 14000, d(2)), (22, 1, d(9)), (22, 77, d(9)), (12, 2, d(8))]
    rows += [(1000 + i, 5000, d(2)) for i in range(500)] + [(3000 + i, 0, d(2)) for i in range(500)]
    visit = spark.createDataFrame(rows, "vid bigint, person_id bigint, loaded_at timestamp_ntz").withColumn("kind", F.lit("clash")).withColumn("block", F.lit(0))
    bare = spark.createDataFrame([(1,), (2,), (55,), (None,), (55,)], "person_id bigint")
    got = orphan_references({"person": person, "visit": visit, "bare": bare}, [Parent("person", "person_id")], [References("visit", "vid", (("person_id", "person"),)), References("bare", "person_id", (("person_id", "person"),), None)])
    got = sorted(map(str, got.select("table_name", "row_id", "kind").collect()))
    want = [("visit", 11, "late"), ("visit", 12, "deleted"), ("visit", 13, "late"), ("visit", 14, "missing"), ("visit", None, "missing"), ("visit", 19, "missing"), ("visit", 21, "missing"), ("visit", 22, "missing"), ("bare", 2, "deleted"), ("bare", 55, "missing")]
    want += [("visit", 3000 + i, "missing") for i in range(500)]
    assert got == sorted(f"Row(table_name={t!r}, row_id={r!r}, kind={k!r})" for t, r, k in want)
    assert orphan_references({"person": person, "visit": visit.limit(0), "bare": bare.limit(0)}, [Parent("person", "person_id")], [References("visit", "vid", (("person_id", "person"),))]).count() == 0
    none = orphan_references({"person": person.limit(0), "bare": bare}, [Parent("person", "person_id")], [References("bare", "person_id", (("person_id", "person"),), None)])
    assert sorted((r.row_id, r.kind) for r in none.collect()) == [(1, "missing"), (2, "missing"), (55, "missing")]


def test_hot_row_ids_and_blocks_of_references(spark, monkeypatch):
    monkeypatch.setattr(skew, "ROWS_PER_TASK", 50)
    d = lambda n: T(2020, 1, n)
    person = spark.createDataFrame([(k, d(1 + k % 20), None) for k in range(0, 9000, 3)], "person_id bigint, loaded_at timestamp_ntz, deleted_at timestamp_ntz")
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, i % 4200, d(1 + i % 17)) for i in range(6000)]
    visit = spark.createDataFrame(rows, "vid bigint, person_id bigint, loaded_at timestamp_ntz")
    first = {}
    for v, _, t in rows:
        first[v] = min(first.get(v, t), t)
    want = {(v, "missing" if p % 3 else "late") for v, p, _ in rows if p % 3 or d(1 + p % 20) > first[v]}
    got = orphan_references({"person": person, "visit": visit}, [Parent("person", "person_id")], [References("visit", "vid", (("person_id", "person"),))]).collect()
    assert {(r.row_id, r.kind) for r in got} == want and len(got) == len(want)


# --- derived tables
def test_condition_era_edges(spark):
    D = dt.date
    c = spark.createDataFrame(
        [(1, 5, 1, D(2020, 1, 1), None), (1, 5, 1, D(2020, 2, 1), D(2020, 2, 2)), (1, 5, 1, D(2020, 3, 4), D(2020, 3, 5)), (2, 5, 1, D(2020, 1, 1), D(2020, 12, 1)), (2, 5, 2, D(2020, 3, 1), D(2020, 3, 2)), (None, 5, 1, D(2020, 1, 1), None), (2, 5, 1, D(2020, 1, 1), D(2020, 12, 1))],
        "person_id bigint, condition_concept_id bigint, condition_type_concept_id bigint, condition_start_date date, condition_end_date date",
    )
    got = sorted(map(tuple, derive.condition_era(c, by_type=True).collect()))
    assert got == [(1, 5, 1, D(2020, 1, 1), D(2020, 2, 2), 2), (1, 5, 1, D(2020, 3, 4), D(2020, 3, 5), 1), (2, 5, 1, D(2020, 1, 1), D(2020, 12, 1), 1), (2, 5, 2, D(2020, 3, 1), D(2020, 12, 1), 1)]


def test_observation_period_lift(spark):
    D = dt.date
    p = spark.createDataFrame([(1,), (2,), (3,), (4,)], "person_id bigint")
    v = spark.createDataFrame([(1, D(2020, 1, 1), D(2025, 7, 30)), (2, D(2020, 1, 1), D(2025, 5, 30)), (3, D(1984, 1, 1), D(2020, 1, 1)), (9, D(2020, 1, 1), D(2020, 1, 1))], "person_id bigint, visit_start_date date, visit_end_date date")
    got = sorted((r.person_id, r.observation_period_end_date) for r in derive.observation_period(p, {"visit_occurrence": v}, derive.DOMAINS, "2026-06-30").collect())
    assert got == [(1, D(2026, 6, 30)), (2, D(2025, 5, 30))]


# --- sequences
def brute_sequence(person, visits, events):
    """The steps of the build, one event at a time."""
    out = {}
    for pid, birth, gender, race in person:
        vs = sorted([v for v in visits if v[0] == pid and v[3] is not None], key=lambda v: (v[3], v[1]))
        if not vs:
            continue
        first = vs[0][3]
        age = first.year - birth.year - ((first.month, first.day, first.time()) < (birth.month, birth.day, birth.time()))
        t, clock = [f"year:{first.year}", f"age:{age}", gender, race], None
        for _, vid, kind, start, end, discharge in vs:
            ev = sorted([e for e in events if e[0] == vid and e[1] is not None], key=lambda e: (e[1], e[2], e[4] or "", e[5] or "N/A", -math.inf if e[3] is None else e[3]))
            if not ev:
                continue
            stay = kind in sequences.BuildOptions().inpatient_types
            if clock is not None:
                days = max((start - clock).days, 0)
                t.append("LT" if days >= 1095 else f"M{days // 30}" if days >= 30 else f"W{days // 7}" if days >= 7 else f"D{days}")
            clock = start
            t += ["[VS]", kind] + ([f"i-H{start.hour}"] if stay and start.hour else [])
            seen = set()
            for _, time, code, number, text, unit in ev:
                if stay:
                    gap = (time - clock).days
                    if gap > 0:
                        t.append(f"i-D{gap}")
                    hours = time.hour if gap > 0 else int((time - clock).total_seconds() // 3600)
                    if hours > 0:
                        t.append(f"i-H{hours}")
                key = (time if stay else time.date(), code, text, unit)
                if key in seen:
                    continue
                seen.add(key)
                t.append(code)
                if clock < time:
                    clock = min(time, end) if stay and end is not None else time
            if stay:
                clock = end if end is not None else clock
                t.append(discharge or "0")
            t.append("[VE]")
        if len(t) > 4:
            out[pid] = t
    return out


@pytest.mark.parametrize("seed", range(3))
def test_build_sequences(spark, seed):
    rng = random.Random(seed)
    person = [(p, T(1980 + p, 3, 5, 10), "8507", "8527") for p in range(1, 6)]
    visits, events = [], []
    for vid in range(1, 40):
        start = None if rng.random() < 0.05 else T(2020, 1, 1) + dt.timedelta(hours=vid * 200 + rng.randrange(100))
        end = None if start is None or rng.random() < 0.3 else start + dt.timedelta(hours=rng.randrange(1, 90))
        visits.append((rng.randrange(1, 6), vid, rng.choice(["9201", "9202", "262"]), start, end, rng.choice([None, "8536"])))
        for _ in range(rng.randrange(0, 7)):
            time = None if start is None or rng.random() < 0.05 else start + dt.timedelta(hours=rng.randrange(-5, 120))
            events.append((vid, time, rng.choice("abc"), rng.choice([None, 1.0, 2.0]), rng.choice([None, "x"]), rng.choice([None, "kg"])))
    p = spark.createDataFrame(person, "person_id bigint, birth timestamp_ntz, gender string, race string")
    v = spark.createDataFrame(visits, "person_id bigint, visit_id bigint, visit_type string, start timestamp_ntz, end timestamp_ntz, discharge string")
    e = spark.createDataFrame(events, "visit_id bigint, time timestamp_ntz, code string, number double, text string, unit string")
    rows = sequences.build_sequences(p, v, e).collect()
    # ties of equal time may stand in another order of text and unit: compare what is ordered by time and code
    assert {r.person_id: r.concept_ids for r in rows} == brute_sequence(person, visits, events)
    for r in rows:
        assert len(r.concept_ids) == len(r.units) == len(r.number_as_values) == r.num_of_concepts
    assert sequences.build_sequences(p, v, e.limit(0)).count() == 0


F1 = "year:2020 age:30 male race VS C C VE D7 VS C VE".split()


def test_slices_and_truncation(spark):
    df = spark.createDataFrame([(1, F1), (2, F1[:4] + ["invalid"] * 12), (3, F1[:8])], "id int, t array<string>")
    got = {r.id: (r["first"], r["last"]) for r in sequences.random_slice(df, "id", "t", 10).collect()}
    assert got[1] == (4, 7) and got[2] == (0, 0) and got[3] == (0, 0)
    assert one(spark, sequences.truncate_right(F.array(*map(F.lit, F1)), 10)) == F1[:7]
    assert one(spark, sequences.truncate_left(F.array(*map(F.lit, F1)), 6)) == F1[9:]
    cut = {r.id: r.t for r in sequences.truncate_recent(df, "id", "t", 10).collect()}
    assert cut[1] == ["year:2020", "age:30", "male", "race", "VS", "C", "VE"] and cut[3] == F1[:8] and cut[2] == ["invalid"] * 10


# --- sequences to tables
def converted(spark, *tokens):
    rows = [(i + 1, t.split() if t is not None else None, None, None) for i, t in enumerate(tokens)]
    s = spark.createDataFrame(rows, "person_id bigint, concept_ids array<string>, values array<double>, units array<string>")
    concept = spark.createDataFrame([(9201, "Visit"), (9202, "Visit"), (500, "Condition"), (600, "Drug"), (8536, "Visit"), (4216643, "Observation"), (500, "Condition"), (700, None)], "concept_id bigint, domain_id string")
    return omop.OmopTables(s, concept)


def test_conversion_cases(spark):
    H = "year:2020 age:30 8507 8527 "
    t = converted(
        spark,
        H + "[VS] 9202 500 [VE] D10 [VS] 9202 600 [VE]",  # 1 good
        H + "[VS] 9999 500 [VE]",  # 2 no visit type
        H + "[VS] 9202 500",  # 3 no end: not valid
        H + "[VS] 9202 500 [VE] [VS] [DEATH] [VE]",  # 4 dead
        H + "[VS] [DEATH] [VE] [VS] 9202 [VE]",  # 5 death is not last
        H + "[VS] 9201 i-H10 500 i-H10 500 i-H10 600 i-D2 600 8536 [VE]",  # 6 hours are clipped
        H + "[VS] 9202 500 [VE] D2000 [VS] 9202 [VE]",  # 7 unknown time token
        H + "[VS] 9202 500 12345 [VE]",  # 8 unknown concept
        "[START] " + H + "[VS] Visit/9202 500 700 [VE] [END]",  # 9 start and end tokens
        H + "[VS] 9201 4216643 [VE] D1 [VS] junk [VE]",  # 10 death at discharge stops
        H + "[VS] 9202 4216643 [VE]",  # 11 death outside a stay
        None,
    )
    assert sorted(r.person_id for r in t.person().collect()) == [1, 4, 6, 9, 10]
    assert sorted(r.key for r in t.rejected.collect()) == [2, 5, 7, 8, 11]
    c = sorted((r.person_id, r.visit, r.datetime) for r in t.conditions().collect())
    assert c == [(1, 1, T(2020, 1, 1)), (4, 1, T(2020, 1, 1)), (6, 1, T(2020, 1, 1, 10)), (6, 1, T(2020, 1, 1, 20)), (9, 1, T(2020, 1, 1))]
    d = sorted((r.person_id, r.visit, r.datetime) for r in t.drugs().collect())
    assert d == [(1, 2, T(2020, 1, 11)), (6, 1, T(2020, 1, 1, 23, 59, 59)), (6, 1, T(2020, 1, 3))]
    v = {(r.person_id, r.visit): (r.visit_concept_id, r.visit_end_datetime, r.discharged_to_concept_id) for r in t.visits().collect()}
    assert v[6, 1] == (9201, T(2020, 1, 3), 8536) and v[10, 1] == (9201, T(2020, 1, 1), 4216643) and v[1, 2] == (9202, T(2020, 1, 11), 0) and (10, 2) not in v
    assert sorted((r.person_id, r.death_type_concept_id) for r in t.deaths().collect()) == [(4, 32817), (10, 32823)]
    ids = sorted((r.visit_occurrence_id, r.person_id) for r in t.with_ids(t.visits(), "visit_occurrence_id", ["person_id", "visit"]).collect())
    assert [i for i, _ in ids] == list(range(1, len(ids) + 1))
    assert converted(spark, None).visits().count() == 0


# --- lab statistics
def test_bins_and_lookup(spark):
    v = spark.createDataFrame([("a", "u", float(x)) for x in range(100)] + [("b", "u", 1.0)] * 5, "concept_id string, unit string, value double").withColumn("total", F.lit(1))
    bins = {r.concept_id: r.bins for r in labstats.lab_bins(v).collect()}
    assert set(bins) == {"a"} and len(bins["a"]) == 10 and bins["a"][0].start_val == -math.inf and bins["a"][-1].end_val == math.inf and bins["a"][0].end_val == 10.0
    probe = spark.createDataFrame([("a", "u", 10.0), ("a", "u", 10.5), ("b", "u", 1.0), ("a", "u", None)], "concept_id string, unit string, value double")
    got = [(r.concept_id, r.value, r.bin) for r in labstats.assign_bins(probe, labstats.lab_bins(v)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [("a", 10.0, "BIN:0"), ("a", 10.5, "BIN:1"), ("b", 1.0, "BIN:unknown"), ("a", None, "BIN:unknown")]))
    s = labstats.sample_bins(labstats.lab_bins(v), 50).groupBy().agg(F.avg("value"), F.count("*")).first()
    assert s[1] == 500 and abs(s[0] - 49.5) < 2


def test_merge_stats(spark):
    f = "concept_id string, unit string, n bigint, mean double, std double"
    a = spark.createDataFrame([("x", "u", 100, 10.0, 2.0)], f)
    b = spark.createDataFrame([("x", "u", 100, 6.0, 1.0), ("y", "u", 3, 1.0, 0.0)], f)
    got = {r.concept_id: (r.n, r.mean, round(r["std"], 4)) for r in labstats.merge_stats(a, b).collect()}
    assert got == {"x": (200, 8.0, 2.5495), "y": (3, 1.0, 0.0)}
    d = {r.unit: r.p for r in labstats.unit_distribution(spark.createDataFrame([("c", "u1", 100, 0.0, 0.0), ("c", "u2", 200, 0.0, 0.0)], f)).collect()}
    assert d == {"u1": 100 / 300, "u2": 200 / 300}


# --- packing
def test_unpadded_and_blocks(spark):
    m = F.array(*map(F.lit, [1, 1, 1, 0, 1, 1, 0, 0]))
    u = one(spark, pack.unpadded(m))
    assert (u.indices, u.offsets, u.longest, u.packed) == ([0, 1, 2, 4, 5], [0, 3, 5], 3, True)
    df = spark.createDataFrame([(1, [1, 1, 0, 1, 1, 1, 1])], "id int, m array<int>")
    pairs = {(r.i, j) for r in pack.block_mask(df, "id", "m").collect() for j in range(r.first, r["last"] + 1)}
    assert pairs == {(i, j) for b in ([0, 1], [3, 4, 5, 6]) for i in b for j in b}


def test_next_fit(spark):
    rng = random.Random(1)
    sizes = {i: rng.choice([0, 5, 90, 500, 3000]) for i in range(500)}
    df = spark.createDataFrame([(i, n) for i, n in sizes.items()] + [(9999, None)], "id int, n int")
    rows = pack.next_fit(df, "id", "n", ranks=2, max_tokens=1000, context=2000).collect()
    assert sorted(r.id for r in rows) == sorted([*sizes, 9999])
    batches = {}
    for r in rows:
        batches.setdefault((r["rank"], r.run, r.batch), []).append(r.tokens + 2)
    assert all(sum(b) <= 1000 or len(b) == 1 for b in batches.values())


# --- splits, privacy, time to event
def test_splits(spark):
    rows = [(i % 19 + 1, dt.date(2021, 1, 1) + dt.timedelta(days=i)) for i in range(100)] + [(None, None)]
    df = spark.createDataFrame(rows, "person_id bigint, d date").withColumn("k", F.monotonically_increasing_id())
    c = splits.chronological_split(df, "d", "k").collect()
    assert max(r.d for r in c if r.split == "train" and r.d) < min(r.d for r in c if r.split != "train")
    p = splits.split_by_patient(df, "person_id").collect()
    by = {}
    for r in p:
        by.setdefault(r.person_id, set()).add(r.split)
    assert all(len(s) == 1 for s in by.values()) and by[None] == {None}
    r = splits.random_split(df, "k", [("a", 0.8), ("b", 0.1), ("c", 0.1)]).groupBy("split").count().collect()
    assert {x.split: x["count"] for x in r} == {"a": 80, "b": 10, "c": 11}
    w = splits.weighted_sample(spark.range(1000).withColumn("w", F.when(F.col("id") < 10, 1000.0).when(F.col("id") < 20, None).otherwise(0.1)), 10, "w", "id").collect()
    assert sum(x.id < 10 for x in w) >= 8 and not any(10 <= x.id < 20 for x in w)
    assert len(privacy.lattice()) == 255


def test_nearest_matches_dense_distance(spark):
    rng = random.Random(3)
    make = lambda n, o: [(o + i, rng.random(), rng.choice("mf"), rng.choice("ab"), sorted(rng.sample("uvwxyz", rng.randrange(0, 5)))) for i in range(n)]
    f = "id bigint, age double, gender string, race string, concepts array<string>"
    a, b = make(40, 0), make(30, 100)

    def dist(x, y):
        return round((x[1] - y[1]) ** 2 + 2 * (x[2] != y[2]) + 2 * (x[3] != y[3]) + len(set(x[4]) ^ set(y[4])), 9)

    got = {r.id: (r.dist, r.match_id) for r in privacy.nearest(spark.createDataFrame(a, f), spark.createDataFrame(b, f)).collect()}
    assert got == {x[0]: min((dist(x, y), y[0]) for y in b) for x in a}
    own = {r.id: r.dist for r in privacy.nearest(spark.createDataFrame(a, f), spark.createDataFrame(a, f), other=True).collect()}
    assert own == {x[0]: min(dist(x, y) for y in a if y[0] != x[0]) for x in a}
    assert privacy.nearest(spark.createDataFrame(a, f), spark.createDataFrame([], f)).count() == 0


def test_first_hit_edges(spark):
    task = tte.TaskConfig("t", ["X"], future_visit_start=1, future_visit_end=2, prediction_window_start=5, prediction_window_end=30)
    for text, want in (("VS X D5 X", ("X", 5)), ("D31 X", ("0", 31)), ("D30 VS X", ("X", 30)), ("X D6 X", None), ("VS D1 VS VS X", ("0", 1)), ("", None)):
        got = one(spark, tte.first_hit(F.array(*map(F.lit, text.split())) if text else F.array().cast("array<string>"), ["X"], task))
        assert (tuple(got) if got else None) == want, text
    got = one(spark, tte.first_hit(F.array(F.lit("D3")), ["X"], tte.TaskConfig("t", ["X"], prediction_window_end=-1)))
    assert tuple(got) == ("0", 3)


def test_config_files(tmp_path):
    y = tmp_path / "task.yaml"
    y.write_text("task_name: 'a b'\noutcome_events:\n  - 9201\n  - \"262\"\ninclude_descendants: true # yes\nprediction_window_end: -1\n")
    t = tte.TaskConfig.from_file(str(y))
    assert t.task_name == "a b" and t.outcome_events == [9201, "262"] and t.include_descendants and t.prediction_window_end == -1


    from patientflow.sources.config import read_config

    assert read_config(str(y))["task_name"] == "a b"


def test_shipped_tasks_and_descendants(spark):
    ancestor = spark.createDataFrame([(316139, 1), (316139, 316139), (9201, 5)], "ancestor_concept_id bigint, descendant_concept_id bigint")
    by = {t.task_name: t for t in tte.TASKS}
    assert tte.outcomes_of(by["t2dm_hf_prediction"], spark, ancestor) == ["1", "316139"]
    assert tte.outcomes_of(by["30_day_readmission_prediction"], spark, ancestor) == ["262", "8920", "8971", "9201"]  # none asked for


def test_database_table_round_trip(spark):
    from patientflow.sources import tables

    df = spark.createDataFrame([(1, "a", 0.5), (2, None, None)], "id bigint, s string, x double")
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    url = "jdbc:derby:memory:patients;create=true"
    for _ in range(2):  # the second time over the first
        tables.to_jdbc(df, url, "people", driver)
    got = spark.read.format("jdbc").options(url=url, dbtable="people", **driver).load()
    assert sorted(map(tuple, got.collect())) == [(1, "a", 0.5), (2, None, None)]


def test_no_shared_folder_is_an_error_on_a_cluster(spark):
    from types import SimpleNamespace

    from patientflow.plans import runtime

    none = SimpleNamespace(isEmpty=lambda: True, isDefined=lambda: False)
    context = SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none)))
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, d=None: d))
    with pytest.raises(RuntimeError):
        runtime.shared_dir(session)
    assert runtime.new_path(spark, "x").startswith("file:/")


def test_broadcast_by_bytes(spark):
    from patientflow.plans.skew import broadcast_if_small

    df = spark.range(1000).select("id", F.repeat(F.lit("x"), 100).alias("s"))
    hint = lambda d: "broadcast" in d._jdf.queryExecution().logical().toString().lower()
    assert hint(broadcast_if_small(df)) and not hint(broadcast_if_small(df, 50_000))


def test_reservoir_keeps_any_number_of_a_hot_group(spark):
    rows = spark.range(30_000, numPartitions=6).select((F.col("id") % 100 > 0).cast("int").alias("k"), "id", F.when(F.col("id") % 2 == 0, F.lit(None)).otherwise(F.lit("z")).alias("n"))
    got = splits.reservoir(rows, ["k", "n"], 2_000, "id").collect()
    by = {}
    for r in got:
        by.setdefault((r.k, r.n), set()).add(r.id)
    assert {k: len(v) for k, v in by.items()} == {(1, "z"): 2000, (1, None): 2000, (0, None): 300}
    want = rows.withColumn("h", splits.draw("id")).where("k = 1 and n = 'z'").orderBy("h").limit(2_000).collect()
    assert by[1, "z"] == {r.id for r in want}


def test_a_value_that_half_of_the_rows_share_is_ranked_over_partitions(spark):
    rows = [("1", "u", 7.0)] * 3000 + [("1", "u", float(i)) for i in range(3000)]
    r = labstats.ranked(spark.createDataFrame(rows, "concept_id string, unit string, value double").repartition(6)).collect()
    assert sorted(x.r for x in r) == list(range(6000)) and [x.value for x in sorted(r, key=lambda x: x.r)] == sorted(v for _, _, v in rows)


def test_streaming_matches_batch(spark, tmp_path):
    from patientflow.streaming import visits

    df = spark.createDataFrame([(i, T(2024, 1, 1) + dt.timedelta(minutes=7 * i + (100 if i > 50 else 0)), i % 3, "click", 1.0, "{}") for i in range(100)] + [(999, T(2024, 3, 1), 7, "view", 1.0, None)], visits.EVENTS)
    df.repartition(1).sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    got = visits.run_once(visits.sessions(visits.read_events(spark, str(tmp_path / "in"))), "sessions")
    want = visits.sessions(df).where("user_id <> 7")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_sources(spark, tmp_path):
    from patientflow.sources import tables

    df = spark.range(10)
    path = str(tmp_path / "t")
    assert tables.build(spark, path, df) and not tables.build(spark, path, df.limit(1), resume=True)
    tables.append(df, path)
    assert tables.row_count(spark, path) == 20 and tables.pooled(spark, str(tmp_path)).count() == 20
    with pytest.raises(FileNotFoundError):
        tables.load_artifacts(spark, str(tmp_path), ["absent"])
