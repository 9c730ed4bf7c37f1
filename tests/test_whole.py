"""Registered queries do the whole job: every row of the tables against brute force, no bound on length, subset or threshold."""

import inspect
import random
from collections import Counter, defaultdict
from itertools import product
from math import ceil
from pathlib import Path

import pyarrow.parquet as pq
import pytest

from patientflow.operators import privacy
from patientflow.queries import QUERIES

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def run(spark):
    if not DATA.exists():
        pytest.skip("no tables")
    return lambda name: QUERIES[name](spark, str(DATA)).collect()


def test_packs_hold_long_sequences(run):
    longest = {}
    for r in pq.read_table(DATA / "processed_dataset.parquet", columns=["person_id", "input_ids"]).to_pylist():
        if r["person_id"] is not None and r["input_ids"] is not None:
            longest[r["person_id"]] = max(longest.get(r["person_id"], []), r["input_ids"])
    packs = defaultdict(list)
    for person, ids in sorted(longest.items()):
        if ids:
            packs[person // 8].append(ids)
    assert any(len(ids) > 1024 for p in packs.values() for ids in p)

    def text(parts):
        return " ".join(str(x) for part in parts for x in part)

    got = {r.pack: (r.input_ids, r.attention_mask, r.position_ids) for r in run("pack_position_ids")}
    assert got == {k: (text([*x, 3, 0] for x in p), text([1] * (len(x) + 1) + [0] for x in p), text(range(len(x) + 2) for x in p)) for k, p in packs.items()}
    assert {r.pack: r.segments for r in run("segment_ids")} == {k: text([i] * (len(x) + 1) for i, x in enumerate(p)) for k, p in packs.items()}
    lengths = {k: [len(x) + 1 for x in p] for k, p in packs.items()}
    assert {r.pack: (r.n_kept, r.longest, r.packed) for r in run("unpad_offsets")} == {k: (sum(n), max(n), len(n) > 1) for k, n in lengths.items()}
    assert {r.pack: r.last_ids for r in run("segment_last_tokens")} == {k: text([[3] * len(n)]) for k, n in lengths.items()}
    assert {r.pack: r.n_pairs for r in run("block_mask_counts")} == {k: sum(x * x for x in n) for k, n in lengths.items()}


def test_all_common_attributes_make_the_class(spark, run):
    c = privacy._reid(spark, str(DATA))
    used = {x for part in ("population", "synthetic") for r in c[part].collect() for g in r.groups for x in g.split()}
    assert used == {r.concept_id for r in run("majority_attributes") if r.prevalence >= privacy.COMMON} and len(used) > 3
    assert not any(used & set(r.sensitive) for part in ("population", "synthetic") for r in c[part].collect())


def test_widespread_concepts_are_no_news(spark):
    f = "id bigint, age bigint, gender string, race string, groups array<string>, sensitive array<string>"
    real = spark.createDataFrame([(1, 3, "m", "a", [""] * 7, ["w", "x", "y", "z"]), (2, 4, "m", "a", [""] * 7, ["w", "x", "p"]), (3, 5, "m", "a", [""] * 7, ["q", "r", "s"]), (4, 6, "m", "a", [""] * 7, [])], f)
    # x and w are in half of the rows; without them only the first row's two others are left to be shared.
    made = spark.createDataFrame([(9, 3, "m", "a", [""] * 7, ["w", "x", "y", "z"]), (8, 4, "m", "a", [""] * 7, ["w", "x", "p"])], f)
    terms = lambda least: privacy.reid_risk(real, real, made, least=least, lam=1.0).where("node = '1001111111'").first()
    assert terms(1).b_term == 1 / 4 and terms(2).b_term == 0


LEVELS = [(b, keep) for b in (0, 1) for keep in product((0, 1), repeat=7) if b or any(keep)]


def at(level, r):
    b, keep = level
    return ceil(r[1] / (1 if b else 10)), r[2], r[3], tuple(g if k else None for g, k in zip(r[4], keep))


def name(level):
    return f"{level[0]}00" + "".join(map(str, level[1]))


def test_every_node_of_the_lattice_has_its_classes(spark, run):
    rows = [(r.id, r.age, r.gender, r.race, r.groups) for r in privacy._reid(spark, str(DATA))["all"].collect()]
    want = {}
    for level in LEVELS:
        n = Counter(at(level, r) for r in rows).values()
        want[name(level)] = (len(n), min(n), sum(x == 1 for x in n))
    assert len(want) == 255 and {r.node: (r.n_classes, r.smallest, r.n_unique) for r in run("lattice_counts")} == want


def test_every_node_of_the_lattice_has_its_risk(spark):
    rng = random.Random(5)
    make = lambda o, n: [(o + i, rng.randrange(38, 43), rng.choice("mf"), "a", [rng.choice(["", "", "c"]) if g < 3 else "" for g in range(7)], rng.sample("pqrstuvwxyz", rng.randrange(0, 6))) for i in range(n)]
    sample, made = make(0, 30), make(100, 40)
    population = sample + make(200, 30)
    assert max(Counter(c for r in sample for c in r[5]).values()) < 15
    want = {}
    for level in LEVELS:
        f, big = Counter(at(level, r) for r in sample), Counter(at(level, r) for r in population)
        new = [r for r in sample if any(at(level, r) == at(level, x) and len(set(r[5]) & set(x[5])) > 2 for x in made)]
        want[name(level)] = (round(sum(1 / f[at(level, r)] for r in new) / 60, 9), round(sum(1 / big[at(level, r)] for r in new) / 30, 9))
    f = "id bigint, age bigint, gender string, race string, groups array<string>, sensitive array<string>"
    got = privacy.reid_risk(*[spark.createDataFrame(x, f) for x in (sample, population, made)], least=2, lam=1.0).collect()
    assert {r.node: (round(r.a_term, 9), round(r.b_term, 9)) for r in got} == want and len(set(want.values())) > 5


def test_risk_has_the_threshold_of_the_operator(spark, run, monkeypatch):
    call = inspect.signature(privacy.reid_risk)
    seen = []
    monkeypatch.setattr(privacy, "reid_risk", lambda *a, **k: seen.append(call.bind(*a, **k)) or spark.range(0).selectExpr("0D a_term", "0D b_term"))
    run("reid_risk")
    seen[0].apply_defaults()
    assert seen[0].arguments["least"] == 17


def test_all_persons_have_a_class_and_a_neighbour(spark, run):
    v = privacy._cohorts(spark, str(DATA))["all"].collect()
    far = lambda x, y: round((x.age - y.age) ** 2 + 2 * (x.gender != y.gender) + 2 * (x.race != y.race) + len(set(x.concepts) ^ set(y.concepts)), 9)
    assert {r.id: r.dist for r in run("nn_self_distance")} == pytest.approx({x.id: min(far(x, y) for y in v if y.id != x.id) for x in v}, abs=1e-6)
    n = Counter((ceil(r.age / 10), r.gender, r.race, tuple(r.groups)) for r in privacy._reid(spark, str(DATA))["all"].collect())
    assert {r["size"]: r.n_classes for r in run("equivalence_class_size")} == Counter(n.values())
