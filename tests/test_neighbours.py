"""Nearest sets by bounds: the same as all pairs, from few of them and without copies of the target."""

import random

import numpy as np
import pytest

from patientflow.functions import neighbours
from patientflow.functions.neighbours import Nearest, Rows
from patientflow.operators import privacy

FIELDS = "id bigint, age double, gender string, race string, concepts array<string>"


def rows(n, rng, least=0, most=30, first=0):
    """Sets of numbers below 400, small ones far more often; every seventh row has the set of the one before."""
    sets = []
    for i in range(n):
        sets.append(sets[-1] if i % 7 == 6 else np.unique((400 * rng.random(rng.integers(least, most + 1)) ** 3).astype(int)))
    return Rows(np.arange(first, first + n), rng.integers(0, 5, n) / 10, np.concatenate([[0], np.cumsum([len(x) for x in sets])]), np.concatenate(sets).astype(int))


def plain(a, b, other):
    x, y = (np.zeros((len(t.id), 400), int) for t in (a, b))
    x[a.row, a.code], y[b.row, b.code] = 1, 1
    d = np.round((a.age[:, None] - b.age) ** 2 + a.size[:, None] + b.size - 2 * (x @ y.T), 9)
    if other:
        d[a.id[:, None] == b.id] = np.inf
    return d.min(1).tolist(), b.id[d.argmin(1)].tolist()


@pytest.mark.parametrize("a, b, other", [((0, 30), (0, 30), True), ((0, 4), (20, 60), False), ((20, 90), (0, 9), False), ((0, 2), (0, 2), True)])
def test_bounds_lose_no_nearest_row(a, b, other):
    rng = np.random.default_rng(4)
    source = rows(1500, rng, *a)
    target = source if other else rows(6000, rng, *b, first=9000)
    best = Nearest(source, other)
    best.add(target, 400)
    assert (best.dist.tolist(), best.match.tolist()) == plain(source, target, other)
    again = Nearest(source, other)  # in parts, with the bound of one part for the next
    for i in range(0, len(target.id), 700):
        again.add(target.cut(i, min(i + 700, len(target.id))), 400)
    assert (again.dist.tolist(), again.match.tolist()) == (best.dist.tolist(), best.match.tolist())


def test_few_pairs_are_compared(monkeypatch):
    rng = np.random.default_rng(5)
    n, compare, everything, seen = 6000, Nearest._compare, Nearest._all, []
    monkeypatch.setattr(Nearest, "_compare", lambda self, t, q, *a: (seen.append(len(q)), compare(self, t, q, *a)))
    monkeypatch.setattr(Nearest, "_all", lambda self, t, x, m: (seen.append(len(x) * len(t.id)), everything(self, t, x, m)))
    # Most items are rare, and each row has the three commonest ones.
    sets = [np.union1d([397, 398, 399], rng.integers(0, 397, rng.integers(0, 20))) for _ in range(n)]
    source = Rows(np.arange(n), rng.integers(0, 5, n) / 10, np.concatenate([[0], np.cumsum([len(x) for x in sets])]), np.concatenate(sets))
    Nearest(source, True).add(source, 400)
    assert 0 < sum(seen) < n * n / 8


def test_target_in_several_groups_and_odd_rows(spark, monkeypatch):
    rng = random.Random(6)
    make = lambda n, o: [(o + i, rng.choice([0.0, 0.5, 1.0]), rng.choice(["m", "f", "", None]), rng.choice("ab"), sorted(rng.sample("abmuvwxyz", rng.randrange(0, 6)))) for i in range(n)]
    a, b = make(300, 0), make(900, 1000)
    want = {x[0]: min((round((x[1] - y[1]) ** 2 + 2 * (x[2] != y[2]) + 2 * (x[3] != y[3]) + len(set(x[4]) ^ set(y[4])), 9), y[0]) for y in b) for x in a}
    monkeypatch.setattr(privacy, "LEAST_ROWS", 100)
    for most in (privacy.GROUP_BYTES, 2000):
        monkeypatch.setattr(privacy, "GROUP_BYTES", most)
        got = privacy.nearest(spark.createDataFrame(a, FIELDS), spark.createDataFrame(b, FIELDS)).collect()
        assert {r.id: (r.dist, r.match_id) for r in got} == want and len(got) == len(a)
    assert neighbours.SAMPLE < len(b)


def test_privacy_loss_packs_each_part_once_and_copies_no_target(spark, monkeypatch):
    rng = random.Random(7)
    parts = {k: spark.createDataFrame([(i, rng.random(), rng.choice("mf"), "a", rng.sample("uvwxyz", rng.randrange(1, 6))) for i in range(o, o + 30)], FIELDS) for k, o in (("train", 0), ("evaluation", 100), ("synthetic", 200))}
    monkeypatch.setattr(privacy, "_cohorts", lambda *a: parts)
    nearest, write, searched, packs = privacy.nearest, privacy.persisted, [], []
    monkeypatch.setattr(privacy, "nearest", lambda *a, **k: searched.append(nearest(*a, **k)) or searched[-1])
    monkeypatch.setattr(privacy, "persisted", lambda df, name: packs.append(name) or write(df, name))
    got = privacy.nnaa_privacy_loss(spark, "").first()
    assert len(searched) == 7 and packs.count("packed") == 3
    assert not any("Generate" in x._jdf.queryExecution().executedPlan().toString() for x in searched)

    def dist(x, y):
        return (x.age - y.age) ** 2 + 2 * (x.gender != y.gender) + len(set(x.concepts) ^ set(y.concepts))

    def far(a, b):
        a, b = (parts[k].collect() for k in (a, b))
        return sum(min(dist(x, y) for y in b) > min(dist(x, y) for y in a if y.id != x.id) for x in a) / len(a)

    train, test = ((far(k, "synthetic") + far("synthetic", k)) / 2 for k in ("train", "evaluation"))
    assert (got.aa_train, got.aa_test, got.privacy_loss) == pytest.approx((train, test, test - train))
