"""Operators for training data: brute force, proven bounds, round trips, planted cases; nulls, ties, repeats, empty tables, clashing names."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from patientflow.llm import abuse, contamination, grouped_splits, ngrams, overlaps, packing, quantiles, registry, tokenizer
from patientflow.plans import skew


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_matches_sql(name, compare):
    compare(registry.QUERIES[name], registry.SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(name, spark):
    assert registry.QUERIES[name](spark, "/root/testdata/sf0.001").count() >= 0


# --- 1 n-grams
@pytest.mark.parametrize("n", [1, 3])
def test_suffix_counts(spark, n):
    rng = random.Random(n)
    rows = [(rng.choice([1, 2, 3, 4, None]), [rng.choice(["a", "a", " a\t", "b", "c", None, "", " ", "a b"]) for _ in range(rng.randrange(0, 12))] if rng.random() < 0.9 else None) for _ in range(60)]
    rows += [(9, ["z"] * 40)] * 3
    occ, rec = Counter(), defaultdict(set)
    for r, t in rows:
        t = [x.strip(" \t\n\r") for x in t or [] if x is not None and x.strip(" \t\n\r")]
        if t:
            occ[()] += 1
            rec[()] |= {r} - {None}
        for i in range(len(t)):
            for k in range(1, n + 1):
                if i + k <= len(t):
                    occ[tuple(t[i : i + k])] += 1
                    rec[tuple(t[i : i + k])] |= {r} - {None}
    df = spark.createDataFrame(rows, "p bigint, concept_ids array<string>").withColumn("first", F.lit(1)).withColumn("record", F.lit("x"))
    got = {tuple(r.ngram): (r.occurrences, r.records) for r in ngrams.suffix_counts(df, "p", "concept_ids", n).collect()}
    assert got == {k: (occ[k], len(rec[k])) for k in occ}
    assert ngrams.marked_terms(ngrams.suffix_counts(df.limit(0), "p", "concept_ids")).count() == 0


def test_hot_terms_are_salted(spark, monkeypatch):
    monkeypatch.setattr(skew, "ROWS_PER_TASK", 10)
    rows = [(i % 700 if i % 11 else None, ["hot", "a" if i % 2 else "b", f"t{i % 97}", "hot"]) for i in range(2000)]
    occ, rec = Counter(), defaultdict(set)
    for r, t in rows:
        for k in (1, 2):
            for i in range(len(t) - k + 1):
                occ[tuple(t[i : i + k])] += 1
                rec[tuple(t[i : i + k])] |= {r} - {None}
    df = spark.createDataFrame(rows, "p bigint, t array<string>")
    got = {tuple(r.ngram): (r.occurrences, r.records) for r in ngrams.suffix_counts(df, "p", "t", 2).where("size(ngram) > 0").collect()}
    assert got == {k: (occ[k], len(rec[k])) for k in occ}


# --- 3 quantiles
def test_merged_summaries_keep_their_bound():
    rng = np.random.default_rng(0)
    data, s = [], (np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64))
    for k in range(12):
        x = rng.choice([rng.normal(size=700), np.round(rng.normal(size=700)), np.full(700, 3.0)])
        data.append(x)
        s = quantiles.compress(quantiles.merge(s, quantiles.compress(quantiles.exact(x), 100)), 100)
    all_ = np.sort(np.concatenate(data))
    v, lo, hi = s
    assert hi[-1] == len(all_) == lo[-1] and lo[0] == 1
    first, last = np.searchsorted(all_, v, "left") + 1, np.searchsorted(all_, v, "right")
    assert (lo <= last).all() and (hi >= first).all()  # the interval holds a true rank of the value
    bound = quantiles.error(s)
    for q in np.linspace(0, 1, 101):
        k = max(1, math.ceil(q * len(all_)))
        i = np.maximum(hi - k, k - lo).argmin()
        assert first[i] - 2 * bound - 1 <= k <= last[i] + 2 * bound + 1
    assert bound <= 0.08 * len(all_)


def test_summaries_are_small_and_within_the_error(spark):
    v = spark.range(400_000, numPartitions=24).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("g"), (F.xxhash64("id") % 10_000_000).cast("double").alias("v"))
    leaves = quantiles.summarise(v, "g", "v", 0.01)
    hot = [r.size for r in leaves.where("group = 'hot'").select(F.size("value").alias("size")).collect()]
    assert len(hot) == 24 and max(hot) <= 102
    got = {r.group: r for r in quantiles.quantiles(quantiles.combine(leaves, 0.01), [0.01, 0.5, 0.99]).collect()}
    true = defaultdict(list)
    for g, x in v.collect():
        true[g].append(x)
    assert set(got) == set(true)
    for g, x in true.items():
        x = np.sort(x)
        for q, value, e in zip([0.01, 0.5, 0.99], got[g].quantiles, got[g].rank_errors):
            k = math.ceil(q * len(x))
            assert np.searchsorted(x, value, "left") + 1 - e <= k <= np.searchsorted(x, value, "right") + e and e <= 0.01 * len(x) + 1, (g, e, len(x))


def test_a_task_lets_its_largest_groups_go(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(quantiles.TaskContext, "get", staticmethod(lambda: type("T", (), {"partitionId": lambda self: 3})()))
    rng = np.random.default_rng(1)
    batches = [pa.RecordBatch.from_arrays([pa.array([f"g{i}" for i in rng.integers(0, 40, 500)]), pa.array(rng.normal(size=500))], ["g", "v"]) for _ in range(30)]
    out = list(quantiles._leaves(iter(batches), 100, 2_000))
    n = Counter()
    for b in out:
        for g, k in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
            n[g] += k
    want = Counter(x for b in batches for x in b.column(0).to_pylist())
    assert n == want and len(out) > 5


def test_quantiles_of_loads(spark):
    rows = [("hot", float(i % 997)) for i in range(20_000)] + [("one", 5.0), ("bad", float("nan")), ("bad", float("inf")), ("bad", None), (None, 1.0)] + [("ties", 2.0)] * 50
    df = spark.createDataFrame(rows, "g string, v double").withColumn("value", F.lit("x")).withColumn("node", F.lit(1))
    parts = [quantiles.summarise(df.where(F.pmod(F.xxhash64("v"), F.lit(3)) == i), "g", "v", 0.01) for i in range(3)]
    got = {r.group: r for r in quantiles.quantiles(quantiles.combine(parts[0].unionAll(parts[1]).unionAll(parts[2]), 0.01), [0.01, 0.5, 0.99]).collect()}
    assert set(got) == {"hot", "one", "ties"} and got["one"].quantiles == [5.0] * 3 and got["ties"].quantiles == [2.0] * 3 and got["hot"].n == 20_000
    true = np.sort([v for g, v in rows if g == "hot"])
    for q, v, e in zip([0.01, 0.5, 0.99], got["hot"].quantiles, got["hot"].rank_errors):
        k = math.ceil(q * 20_000)
        assert np.searchsorted(true, v, "left") + 1 - e <= k <= np.searchsorted(true, v, "right") + e and e <= 200
    assert quantiles.combine(quantiles.summarise(df.limit(0), "g", "v", 0.01), 0.01).count() == 0


# --- 4 overlaps
def test_cross_split_overlaps(spark):
    rng = random.Random(5)
    words = [str(i) for i in range(60)]
    base = [[rng.choice(words) for _ in range(rng.randrange(20, 60))] for _ in range(12)]
    bodies, split = {}, {}
    for k in range(90):
        t = list(rng.choice(base))
        for _ in range(rng.randrange(0, 6)):
            t[rng.randrange(len(t))] = rng.choice(words)
        bodies[k] = t
        split[k] = [rng.choice(["train", "train", "test", "validation", None])]
    for k in range(90, 120):  # a large group of copies
        bodies[k], split[k] = base[0], ["train"]
    bodies[200], split[200] = base[1], ["train", "test"]
    bodies[201], split[201] = base[2], []
    bodies[202], split[202] = [], ["train"]
    bodies[203], split[203] = None, ["test"]
    header = ["year:2020", "age:3", "g", "r"]
    rows = [(k, (["[START]"] if k % 2 else []) + header + [f" {w}\t" for w in t] if t is not None else None) for k, t in bodies.items()] + [(None, header + base[0]), (90, header + base[0])]
    d = spark.createDataFrame(rows, "person_id bigint, concept_ids array<string>").withColumn("no", F.lit("x")).withColumn("body", F.lit(1))
    s = spark.createDataFrame([(k, x) for k, v in split.items() for x in v], "key bigint, split string")
    members, pairs = overlaps.cross_split_overlaps(overlaps.sequence_bodies(d, "person_id", "concept_ids"), s)
    got = {(r.key_1, r.key_2) for r in overlaps.person_pairs(members, pairs).collect()}
    grams = {k: {tuple(t[i : i + 4]) for i in range(len(t) - 3)} for k, t in bodies.items() if t}
    want = set()
    for a in grams:
        for b in grams:
            x, y = grams[a], grams[b]
            if "train" in split[a] and set(split[b]) & {"test", "validation"} and min(len(x), len(y)) >= 20 and len(x & y) * 2 >= len(x | y):
                want.add((min(a, b), max(a, b)))
    assert got == want and (200, 200) in got and len(want) > 20
    none = overlaps.cross_split_overlaps(overlaps.sequence_bodies(d.limit(0), "person_id", "concept_ids"), s)
    assert overlaps.person_pairs(*none).count() == 0


def test_bodies_that_join_to_the_same_text_are_not_copies(spark):
    words = [str(i) for i in range(30)]
    other = ["0\x1f1", *words[2:]]
    rows = [(1, ["a", "b", "c", "d", *words]), (2, ["a", "b", "c", "d", *other])]
    d = spark.createDataFrame(rows, "person_id bigint, concept_ids array<string>")
    s = spark.createDataFrame([(1, "train"), (2, "test")], "key bigint, split string")
    m, p = overlaps.cross_split_overlaps(overlaps.sequence_bodies(d, "person_id", "concept_ids"), s)
    assert m.select("no").distinct().count() == 2 and 0.5 < p.first().similarity < 1


def test_overlaps_over_many_shards(spark, monkeypatch):
    rng = random.Random(2)
    t = [[str(rng.randrange(40)) for _ in range(40)] for _ in range(31)]
    rows = [(i, ["a", "b", "c", "d"] + t[i % 31][: 30 + i // 31]) for i in range(120)]
    d = spark.createDataFrame(rows, "person_id bigint, concept_ids array<string>")
    s = spark.createDataFrame([(i, "train" if i % 2 else "test") for i in range(120)], "key bigint, split string")
    b = overlaps.sequence_bodies(d, "person_id", "concept_ids")
    run = lambda **k: {tuple(r) for r in overlaps.person_pairs(*overlaps.cross_split_overlaps(b, s, **k)).select("key_1", "key_2").collect()}
    one = run()
    monkeypatch.setattr(overlaps, "PASSAGES_PER_TASK", 50)
    monkeypatch.setattr(skew, "ROWS_PER_TASK", 10)
    assert run() == one and one
    assert run(symbols=7, counters=3, bits=1 << 15) == one  # most terms collide: more candidates, the same pairs
    per = {r.eval_key: r.n for r in overlaps.overlaps_per_key(*overlaps.cross_split_overlaps(b, s)).collect()}
    assert per == Counter(x if x % 2 == 0 else y for x, y in one)


def test_keys_of_several_bodies_count_once(spark):
    body = [[f"{i}" for i in range(40)], [f"{i}" for i in range(1, 41)]]
    rows = [(1, ["a", "b", "c", "d"] + body[0]), (1, ["a", "b", "c", "d"] + body[1]), (2, ["a", "b", "c", "d"] + body[0]), (3, ["a", "b", "c", "d"] + body[1])]
    d = spark.createDataFrame(rows, "person_id bigint, concept_ids array<string>")
    s = spark.createDataFrame([(1, "train"), (2, "test"), (3, "train"), (3, "test")], "key bigint, split string")
    found = overlaps.cross_split_overlaps(overlaps.sequence_bodies(d, "person_id", "concept_ids"), s)
    assert {(r.eval_key, r.n) for r in overlaps.overlaps_per_key(*found).collect()} == {(2, 2), (3, 2)}
    assert {(r.key_1, r.key_2) for r in overlaps.person_pairs(*found).collect()} == {(1, 2), (2, 3), (1, 3), (3, 3)}


# --- 5 grouped splits
def components(edges, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[find(a)] = find(b)
    by = defaultdict(set)
    for n in nodes:
        by[find(n)].add(n)
    return {frozenset(s) for s in by.values()}


@pytest.mark.parametrize("seed", range(3))
def test_spanning_forest(spark, seed):
    rng = random.Random(seed)
    members = [(f"k{rng.randrange(80)}", rng.randrange(150)) for _ in range(160)] + [("hub", i) for i in range(300, 420)] + [(f"c{i // 2}", 500 + i - i // 2) for i in range(60)] + [(None, 1), ("k", None), ("k1", 7), ("k1", 7)]
    df = spark.createDataFrame(members, "key string, node bigint")
    labels, forest = grouped_splits.spanning_forest(grouped_splits.group_edges(df))
    by = defaultdict(set)
    for k, n in members:
        if k is not None and n is not None:
            by[k].add(n)
    edges = [(min(s), n) for s in by.values() for n in s if n != min(s)]
    nodes = {n for e in edges for n in e}
    got = defaultdict(set)
    for r in labels.collect():
        got[r.root].add(r.node)
    assert {frozenset(s) for s in got.values()} == components(edges, nodes)
    f = [tuple(r) for r in forest.collect()]
    assert len(f) == len(set(f)) == len(nodes) - len(got) and components(f, nodes) == components(edges, nodes)


def test_deal_and_torn(spark):
    labels, forest = grouped_splits.spanning_forest(spark.createDataFrame([], "a bigint, b bigint"))
    nodes = spark.range(2000).select(F.col("id").alias("node"))
    got = grouped_splits.deal(nodes, labels).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in got} == {"train": 1600, "validation": 200, "test": 200} and forest.count() == 0
    labels = spark.createDataFrame([(i, i // 3 * 3) for i in range(30)], "node bigint, root bigint")
    d = grouped_splits.deal(nodes, labels).collect()
    by = defaultdict(set)
    for r in d:
        by[r.root].add(r.split)
    assert all(len(s) == 1 for s in by.values()) and len(d) == 2000
    current = spark.createDataFrame([(0, "train"), (1, "test"), (3, "train"), (4, "train"), (50, "train"), (50, "test"), (60, None), (None, "test")], "node bigint, split string")
    assert sorted(r.node for r in grouped_splits.torn(current, labels).collect()) == [0, 1, 50]


@pytest.mark.parametrize("text,number", [("MR-0012", "MR|12"), (" Mr_9 ", "MR|9"), ("TSB#9-9", "TSB|99"), ("KHN-0000", None), ("UNKNOWN", None), ("", None), (None, None), ("007", "|7")])
def test_record_number(spark, text, number):
    assert spark.createDataFrame([(text,)], "s string").select(grouped_splits.record_number("s")).first()[0] == number


# --- 7 packing
def test_harmonic_bins(spark):
    rng = random.Random(0)
    sizes = {i: rng.choice([0, 1, 3, 15, 16, 17, 300, 512, 513, 1024, 1025, 5000]) for i in range(3000)}
    rows = [(i, [1] * n) for i, n in sizes.items()] + [(0, None), (5000, None), (None, [1, 2])]
    df = spark.createDataFrame(rows, "p bigint, ids array<int>").withColumn("length", F.lit("x")).withColumn("bin", F.lit(0))
    items = packing.one_per_key(df, "p", F.when(F.col("ids").isNotNull(), F.size("ids")))
    b = packing.harmonic_bins(items).collect()
    load, whole = defaultdict(int), defaultdict(int)
    for r in b:
        load[r.bin] += r.length
        whole[r["item"]] += r.length
        assert r.length > 0 and (r.piece == 0 or sizes[r["item"]] > 1024)
    assert max(load.values()) <= 1024 and dict(whole) == {i: n for i, n in sizes.items() if n}
    for j in (1, 3, 60):  # all bins of a class but one per partition hold j pieces
        count = Counter(r.bin for r in b if r["class"] == j)
        assert sum(n != j for n in count.values()) <= 8
    packed = packing.assemble(packing.harmonic_bins(items), df, "p", "ids").collect()
    assert sum(len(r.tokens) for r in packed) == sum(sizes.values())
    assert packing.harmonic_bins(items.limit(0)).count() == 0


# --- 8 tokenizer
TEXTS = ["", None, "Hello world", "it's we'll they'LL <|endoftext|>", "   lead\n\n\n  and \t tail   ", "größe 漢字 é́ 🙂🙂 ​ x", "a" * 5000, " " * 5000, "x'" * 700, "word  word\n" * 900, "1234567890 " * 400 + "'ll" * 300]


def test_chunks_give_the_same_ids(spark):
    enc = tokenizer.encoding()
    rng = random.Random(0)
    texts = TEXTS + ["".join(rng.choice(["a", "b", " ", "  ", "\n", "'s", "'ll", "é", "9", "!", "漢"]) for _ in range(3000)) for _ in range(6)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("key", F.lit(1)).withColumn("ids", F.lit("x"))
    want = {i: enc.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    for chunk, overlap, span, edge in ((300, 60, 1200, 100), (64, 16, 6400, 700), (997, 200, 997, 300), (512, 128, 1 << 21, 4096)):
        got = {r.key: r.ids for r in tokenizer.encode(df, "doc_id", "text", chunk=chunk, overlap=overlap, span=span, edge=edge).collect()}
        assert got == want
    back = {r.key: r.text for r in tokenizer.decode(tokenizer.encode(df, "doc_id", "text"), "key", "ids").collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert tokenizer.encode(df.limit(0), "doc_id", "text").count() == 0


def test_repeated_and_null_keys_keep_their_rows(spark):
    long = [" ".join(f"w{i * k}" for i in range(400)) for k in (1, 7)]
    rows = [(1, long[0]), (1, long[0]), (1, long[1]), (None, long[1]), (None, "short"), (1, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((str(r.key), r.ids) for r in tokenizer.encode(df, "doc_id", "text", chunk=300, overlap=60, span=600, edge=100).collect())
    assert got == sorted((str(k), tokenizer.encoding().encode_ordinary(t) if t else []) for k, t in rows)


def test_stitching_joins_chunks_without_a_common_boundary():
    rng = random.Random(3)
    for text in ("漢" * 3000, "a" * 700 + " b" * 300, "".join(rng.choice("ab  \n'’.9漢") for _ in range(4000)), "x" * 64 + " y", "ab" * 31 + "c "):
        for chunk, overlap in ((64, 16), (100, 99), (512, 128)):
            cut = [text[k : k + chunk + overlap] for k in range(0, len(text), chunk)]
            assert tokenizer.stitched(cut, chunk) == tokenizer.pretokens(text)[0]


def test_ids_equal_the_other_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    for x in TEXTS:
        assert (tokenizer.encoding().encode_ordinary(x) if x else []) == t.encode(x or "", add_special_tokens=False).ids


# --- 9 contamination
def test_leaks(spark):
    item = "One two THREE four; five-six seven eight nine ten eleven twelve"
    docs = [
        (1, "zero " + item), (2, "one two three four five six seven eight nine"), (3, "ｏｎｅ two three​ four\nfive six seven éight nine ten"), (4, "x ｏｎｅ two thr­ee four five six seven eight nine TEN y"), (5, None), (6, ""),
        (7, item.replace(" ", "  ") + " ... " + item), (8, "two three four five six seven eight nine ten other eleven"), (9, "three four five six seven eight nine ten eleven twelve"), (1, "again nothing"),
    ]
    items = [(100, item), (100, item), (101, "short text"), (102, None), (103, item), (None, item)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("key", F.lit("x")).withColumn("item", F.lit(0))
    i = spark.createDataFrame(items, "item_id bigint, item_text string")
    found = contamination.leaks(d, "doc_id", "text", i, "item_id", "item_text").cache()
    assert {(r.key, r["item"]) for r in found.collect()} == {(k, n) for k in (1, 4, 7, 9) for n in (100, 103)}
    clean = {(r.key, r.text) for r in contamination.without_leaks(d, "doc_id", "text", found).collect()}
    assert (2, docs[1][1]) in clean and (7, " ... ") in {(k, t) for k, t in clean if k == 7} and (5, None) in clean and (4, "x  y") in clean
    assert {r.key for r in contamination.without_leaks(d, "doc_id", "text", found, whole=True).collect()} == {1, 2, 3, 5, 6, 8}
    assert contamination.leaks(d, "doc_id", "text", i.limit(0), "item_id", "item_text").count() == 0


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    rng = random.Random(1)
    words = "abcdefgh"
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, text(12)) for i in range(30)]
    docs = [(i, text(5) + " " + rng.choice(items)[1] + " " + text(5)) for i in range(40)]
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, item_text string")
    run = lambda: {(r.key, r["item"]) for r in contamination.leaks(d, "doc_id", "text", i, "item_id", "item_text").collect()}
    one = run()
    monkeypatch.setattr(contamination, "BLOCK_CHARS", 60)
    assert run() == one and len(one) >= 40


# --- 10 abuse
def test_spellings_share_a_key():
    for plain, *others in (("stupid", "s.t.u.p.i.d", "st​upid", "stuuuupid", "STUPID", "stúpid", "5tup1d", "s t u p i d", "ѕtupid", "sutpid"), ("imbecile", "1mb3c1l3", "ibmecile")):
        want = abuse.windows(f"you are {plain}")[0][2]
        for o in others:
            assert want in abuse.windows(f"you are {o}")[0], o


def test_held_out_accuracy():
    rng = random.Random(0)
    calm = ["the cause is almost always the router", "set it to nine and wait", "i was such a moron, i forgot the cable", "our filter flags comments such as 'you are a moron'", "kill the orphaned process first", "measure the dough and write it down"]
    rude = ["you {} moron, nobody asked you", "only a {} moron would write that", "shut up, {}", "what a {} piece of garbage you are"]
    texts, labels = [], []
    for _ in range(1500):
        parts = [rng.choice(calm) + "." for _ in range(rng.randrange(1, 6))]
        y = rng.random() < 0.2
        if y:
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(rude).format(rng.choice(["stupid", "lazy", "useless"])) + ".")
        texts.append(" ".join(parts))
        labels.append(float(y))
    y = np.array(labels)
    noisy = np.where(np.array([rng.random() < 0.05 for _ in y]), 1 - y, y)
    m = abuse.fit(texts[:1000], noisy[:1000])
    model = abuse._dense(*m[:2]), m[2]
    p = abuse.score(texts[1000:], *model) > abuse.THRESHOLD
    t = y[1000:] > 0
    assert (p & t).sum() >= 0.95 * t.sum() and (p & ~t).sum() <= 0.05 * max(1, p.sum())
    assert len(m[0]) < 50_000
    assert abuse.score([None, "", "  ", "​"], *model).tolist()[:3] == [0, 0, 0]
    assert np.array_equal(abuse.score(texts[:50], *model), [abuse.score([t], *model)[0] for t in texts[:50]])


def test_no_labels_flag_nothing(spark):
    d = spark.createDataFrame([(1, "you are stupid"), (2, None), (2, "x")], "doc_id bigint, text string").withColumn("key", F.lit(1)).withColumn("score", F.lit("x"))
    for rows in ([], [(1, None)], [(1, 0), (1, 1)], [(9, 1)]):
        m = abuse.train(d, "doc_id", "text", spark.createDataFrame(rows, "doc_id bigint, flagged int"), "flagged")
        got = abuse.scores(d, "doc_id", "text", m).collect()
        assert len(got) == 3 and all(r.score < abuse.THRESHOLD for r in got)
