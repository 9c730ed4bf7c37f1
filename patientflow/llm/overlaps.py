"""Same or near-same records across splits (problem 4)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..plans.runtime import partitions, persisted, table
from ..plans.skew import broadcast_if_small, hot_keys, salt_count, salts, skew_join, spread_join
from .grouped_splits import split_name
from .ngrams import clean_terms, distinct

RUN, LEAST_RUNS = 4, 20
#: At least half of the distinct runs of both stand in both.
SIMILARITY = 0.5
HEADER = 4
#: Passages that one automaton holds (about 120 MB); a shard with more is split, and its windows go to each piece.
PASSAGES_PER_TASK = 300_000
#: Counters of the sketch that tells how often evaluation records have a run: 2 MB for each task, whatever the data.
SKETCH = 1 << 20
#: Bits that tell which runs the training texts and the evaluation records have: 16 MB each for a task, whatever the data; a full one filters nothing.
BITMAP, BUCKET = 1 << 27, 1 << 15
#: Terms become one character each by a hash into the planes above the basic one. Terms that collide only make more candidates: lengths and checks use the terms themselves.
FIRST_SYMBOL, SYMBOLS = 0x10000, 0xF0000
#: Stands between the windows of a text that do not touch, and for terms that an evaluation record does not have.
GAP = "\x01"
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _symbol(word: str | None, symbols: int) -> int:
    import xxhash

    return FIRST_SYMBOL + xxhash.xxh64_intdigest((word or "").encode("utf-8", "surrogatepass")) % symbols


def _starts(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of texts of these sizes, laid end to end: where each run of RUN terms starts, and whose it is."""
    runs = np.maximum(size - RUN + 1, 0)
    text = np.repeat(np.arange(len(size)), runs)
    at = np.concatenate([[0], np.cumsum(size)[:-1]]) if len(size) else np.empty(0, np.int64)
    first = np.concatenate([[0], np.cumsum(runs)[:-1]]) if len(size) else np.empty(0, np.int64)
    return np.arange(len(text)) - first[text] + at[text], text


def _distinct_runs(codes: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Distinct runs of each of these texts of term numbers, exactly."""
    start, text = _starts(size)
    run = codes[start].astype(np.int64) if len(start) else np.empty(0, np.int64)
    for j in range(1, RUN):  # numbers the runs of j + 1 terms from those of j
        run = np.unique(run * (int(codes.max(initial=0)) + 1) + codes[start + j], return_inverse=True)[1].astype(np.int64)
    return np.bincount(distinct(text * (run.max(initial=0) + 1) + run) // (run.max(initial=0) + 1), minlength=len(size))


def _texts(batches: Iterator[pa.RecordBatch], symbols: int) -> Iterator[pa.RecordBatch]:
    """Adds the text of symbols of each body (the last column) and its number of distinct runs."""
    for b in batches:
        body = b.column(b.num_columns - 1)
        offsets = body.offsets.to_numpy()
        coded = body.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        symbol = np.array([_symbol(w, symbols) for w in coded.dictionary.to_pylist()], np.uint32)
        code = coded.indices.to_numpy().astype(np.int64)
        whole = symbol[code].astype("<u4").tobytes().decode("utf-32-le") if len(coded) else ""
        at = offsets - offsets[0]
        n = _distinct_runs(code, np.diff(at))
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([whole[i:j] for i, j in zip(at[:-1], at[1:])], pa.string()), pa.array(n, pa.int64())], [*b.schema.names, "text", "n"])


def _bodies(batches: Iterator[pa.RecordBatch], header: int) -> Iterator[pa.RecordBatch]:
    """(key, terms) to (key, h, body): clean terms after the header, and 128 bits over the terms and their places, so that ["a", "b"] and ["ab"] differ."""
    import xxhash

    for b in batches:
        if not b.num_rows:
            continue
        code, size, words = clean_terms(b.column(1))
        text = np.repeat(np.arange(b.num_rows), size)
        first = np.concatenate([[0], np.cumsum(size)])[:-1]
        place = np.arange(len(code)) - first[text]
        start = np.array([w == "[START]" for w in words] or [False])
        begins = np.zeros(b.num_rows, bool)
        begins[size > 0] = start[code[first[size > 0]]]
        body = place >= header + begins[text]
        text, code, place = text[body], code[body], (place - begins[text])[body].astype(np.uint64)
        size = np.bincount(text, minlength=b.num_rows)
        halves = []
        for seed, mix in ((0, _A), (1, _B)):
            h = np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), seed) for w in words] or [0], np.uint64)[code]
            h = (h ^ (place * mix)) * _A
            h = (h ^ (h >> np.uint64(29))) * _B
            total = np.zeros(b.num_rows, np.uint64)
            some = size > 0
            if some.any():
                total[some] = np.add.reduceat(h ^ (h >> np.uint64(32)), (np.cumsum(size) - size)[some])
            halves.append(total)
        name = [f"{x:016x}{y:016x}" for x, y in zip(halves[0].tolist(), halves[1].tolist())]
        out = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(words).take(pa.array(code)) if len(code) else pa.array([], pa.string()))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(name), out], ["key", "h", "body"])


def sequence_bodies(df: DataFrame, key: str, terms: str, header: int = HEADER) -> DataFrame:
    """``key, h, body``: the terms after an optional [START] and the header, and their hash; null keys are left out, null arrays give empty bodies."""
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(terms).alias("terms"))
    return rows.mapInArrow(lambda it: _bodies(it, header), f"key {rows.schema['key'].dataType.simpleString()}, h string, body array<string>")


def _hash_runs(flat: np.ndarray, start: np.ndarray) -> np.ndarray:
    """48-bit hashes of the runs of symbols that start there."""
    h = np.zeros(len(start), np.uint64)
    for j in range(RUN):
        h = (h + flat[start + j]) * _A
        h ^= h >> np.uint64(29)
    return (h * _B) >> np.uint64(16)


def _presence(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(train, eval, text) to the bitmaps of the runs of either side: (side, bucket, bits) of the buckets that are not empty."""
    maps = [np.zeros(size // 8, np.uint8) for _ in range(2)]
    for b in batches:
        texts = b.column(2).to_pylist()
        n = np.fromiter(map(len, texts), np.int64, len(texts))
        flat = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.uint64)
        start, text = _starts(n)
        h = _hash_runs(flat, start)
        for side in (0, 1):
            own = b.column(side).to_numpy(zero_copy_only=False).astype(bool)
            bit = distinct((h[own[text]] % np.uint64(size)).astype(np.int64))
            if len(bit):
                first = np.flatnonzero(np.diff(bit >> 3, prepend=-1))
                maps[side][bit[first] >> 3] |= np.bitwise_or.reduceat(np.left_shift(1, bit & 7).astype(np.uint8), first)
    for side, bits in enumerate(maps):
        buckets = bits.reshape(-1, BUCKET // 8)
        some = np.flatnonzero(buckets.any(1))
        for i in range(0, len(some), 1024):
            part = some[i : i + 1024]
            yield pa.RecordBatch.from_arrays([pa.array([side] * len(part), pa.int32()), pa.array(part, pa.int32()), pa.array([buckets[k].tobytes() for k in part], pa.binary())], ["side", "bucket", "bits"])


def _has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether a bitmap may have these runs."""
    at = (h % np.uint64(8 * len(bits))).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def _hashed(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, text and 48-bit hash of the first of each distinct run of each text (runs of equal hash are one)."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    flat = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.uint64)
    start, text = _starts(size)
    h = _hash_runs(flat, start)
    order = np.argsort((text.astype(np.uint64) << np.uint64(48)) | h) if len(texts) <= 1 << 16 else np.lexsort([h, text])
    fresh = np.ones(len(order), bool)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (text[order][1:] != text[order][:-1])
    keep = order[fresh]
    return start[keep], text[keep], h[keep]


def _sketch(batches: Iterator[pa.RecordBatch], counters: int) -> Iterator[pa.RecordBatch]:
    """(text) to (counter, n) of the sketch, summed per batch."""
    for b in batches:
        h = _hashed(b.column(0).to_pylist())[2]
        c, n = np.unique((h % np.uint64(counters)).astype(np.int64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(n, pa.int64())], ["counter", "n"])


class _Prefixes:
    """The rarest n - ceil(s n) + 1 runs of each text of n distinct runs, as far as the ``other`` side may have them: ``start, text, h``; ``taken`` of each text and its ``last`` key.

    All texts order their runs alike, by key (count, hash). Two texts whose similarity is at least s share at least
    ceil(s n) runs of either, so the first n - ceil(s n) + 1 of one and those of the other have a run in common.
    Runs that fall together by their hash make both sets only larger against what they need.
    """

    def __init__(self, texts: list[str], n: np.ndarray, sketch: np.ndarray, other: np.ndarray):
        start, text, h = _hashed(texts)
        count = np.minimum(sketch[(h % np.uint64(len(sketch))).astype(np.int64)], (1 << 15) - 1).astype(np.uint64)
        key = ((count << np.uint64(48)) | h).astype(np.int64)
        order = np.lexsort([key, text])
        place = np.searchsorted(text[order], np.arange(len(texts) + 1))
        most = n - np.ceil(SIMILARITY * n - 1e-9).astype(np.int64) + 1
        self.taken = np.minimum(most, np.diff(place))
        self.last = key[order][place[:-1] + self.taken - 1]
        keep = order[np.arange(len(order)) - place[text[order]] < self.taken[text[order]]]
        keep = keep[_has(other, h[keep])]  # runs that the other side does not have hit nothing
        self.start, self.text, self.h = start[keep], text[keep], h[keep]


def _sent(b: pa.RecordBatch, p: _Prefixes, own: np.ndarray, shard: np.ndarray, texts: list[str]) -> pa.RecordBatch:
    at = pa.array(own)
    return pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), b.column(0).take(at), b.column(1).take(at), pa.array(p.taken[own]), pa.array(p.last[own]), pa.array(texts, pa.string())], ["shard", "no", "n", "taken", "last", "text"])


def _passages(batches: Iterator[pa.RecordBatch], sketch, shards: int) -> Iterator[pa.RecordBatch]:
    """Evaluation records (no, n, text) to each shard's passages of them, one after the other (shard, no, n, taken, last, text)."""
    for b in batches:
        texts = b.column(2).to_pylist()
        if not texts:
            continue
        p, whole = _Prefixes(texts, b.column(1).to_numpy(), *sketch.value), "".join(texts)
        shard = (p.h % np.uint64(shards)).astype(np.int64)
        order = np.lexsort([shard, p.text])
        start, text, shard = p.start[order], p.text[order], shard[order]
        new = np.ones(len(start), bool)
        new[1:] = (text[1:] != text[:-1]) | (shard[1:] != shard[:-1])
        head = np.flatnonzero(new)
        pieces = [whole[i : i + RUN] for i in start.tolist()]
        rows = ["".join(pieces[i:j]) for i, j in zip(head.tolist(), [*head[1:].tolist(), len(pieces)])]
        yield _sent(b, p, text[head], shard[head], rows)


def _windows(batches: Iterator[pa.RecordBatch], sketch, shards: int) -> Iterator[pa.RecordBatch]:
    """Training texts (no, n, text) to what each shard has to scan of them (shard, no, n, taken, last, text): their windows that may be passages, with those that touch joined."""
    for b in batches:
        texts = b.column(2).to_pylist()
        if not texts:
            continue
        p = _Prefixes(texts, b.column(1).to_numpy(), *sketch.value)
        start, text, shard = p.start, p.text, (p.h % np.uint64(shards)).astype(np.int64)
        order = np.lexsort([start, shard, text])
        start, text, shard = start[order], text[order], shard[order]
        whole = "".join(texts)
        new = np.ones(len(start), bool)
        new[1:] = (text[1:] != text[:-1]) | (shard[1:] != shard[:-1])
        apart = new.copy()
        apart[1:] |= start[1:] >= start[:-1] + RUN
        at = np.flatnonzero(apart)
        end = start[np.append(at[1:], len(start)) - 1] + RUN if len(at) else at
        pieces = [whole[i:j] for i, j in zip(start[at].tolist(), end.tolist())]
        head = np.flatnonzero(new[at])
        rows = [GAP.join(pieces[i:j]) for i, j in zip(head.tolist(), [*head[1:].tolist(), len(pieces)])]
        yield _sent(b, p, text[at][head], shard[at][head], rows)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by (place, side): the passages of a place (side 0) become an automaton, which scans its texts (side 1): (train, eval, shared, need).

    shared: passages of the record in the text. Of two similar texts of n and m distinct runs at least a = ceil(s / (1 + s) (n + m)) are
    shared. The one whose prefix ends first in the common order can share at most n - taken beyond its prefix, so at least a - (n - taken) passages.
    """
    import ahocorasick

    place, automaton, built = None, None, False
    passages: dict[str, list[int]] = {}
    records: dict[int, tuple[int, int, int]] = {}
    for b in batches:
        train, evaluation, shared, needed = [], [], [], []
        for where, side, no, n, taken, last, text in zip(*(b.column(i).to_pylist() for i in range(7))):
            if where != place:
                place, built, passages, records = where, False, {}, {}
            if side == 0:
                for i in range(0, len(text), RUN):
                    passages.setdefault(text[i : i + RUN], []).append(no)
                records[no] = n, taken, last
                continue
            if not built:
                automaton, built = ahocorasick.Automaton(), True
                for k, holders in passages.items():
                    automaton.add_word(k, (k, holders))
                if passages:
                    automaton.make_automaton()
            if not passages:
                continue
            count: dict[int, int] = {}
            for holders in {k: h for _, (k, h) in automaton.iter(text)}.values():
                for e in holders:
                    count[e] = count.get(e, 0) + 1
            for e, c in count.items():
                m, own, end = records[e]
                if min(n, m) >= SIMILARITY * max(n, m) - 1e-9:
                    train.append(no)
                    evaluation.append(e)
                    shared.append(c)
                    needed.append(math.ceil(SIMILARITY / (1 + SIMILARITY) * (n + m) - 1e-9) - (m - own if end <= last else n - taken))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (train, evaluation, shared, needed)], ["train", "eval", "shared", "need"])


class Record:
    """An evaluation record's runs as an automaton over its own terms, numbered without collisions."""

    def __init__(self, body: list[str]):
        import ahocorasick

        self.symbol = {w: chr(FIRST_SYMBOL + i) for i, w in enumerate(dict.fromkeys(body))}
        text = self.text(body)
        self.runs = [text[i : i + RUN] for i in range(len(text) - RUN + 1)]
        self.size, self.n = len(body), len(set(self.runs))
        self.automaton = ahocorasick.Automaton()
        for g in self.runs:
            self.automaton.add_word(g, g)
        self.automaton.make_automaton()

    def text(self, body: list[str]) -> str:
        return "".join(self.symbol.get(w, GAP) for w in body)

    def match(self, body: list[str]) -> tuple[int, float]:
        """Distinct runs shared with another body, and the share of the record's terms that the merged matched intervals cover."""
        hit = {g for _, g in self.automaton.iter(self.text(body))}
        covered, end = 0, 0
        for i, g in enumerate(self.runs):  # intervals [i, i + RUN) come in order
            if g in hit:
                covered += i + RUN - max(i, end)
                end = i + RUN
        return len(hit), covered / self.size


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(train, eval, n of train, train's body, eval's body), best sorted by eval: the exact similarity and the coverage of those that reach it."""
    last, record = None, None
    for b in batches:
        out = []
        for t, e, n, bt, be in zip(*(c.to_pylist() for c in b.columns)):
            if e != last:
                last, record = e, Record(be)
            both, coverage = record.match(bt)
            if both >= SIMILARITY * (n + record.n - both):
                out.append((t, e, both / (n + record.n - both), coverage))
        cols = list(zip(*out)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.float64()))], ["train", "eval", "similarity", "coverage"])


def _scanned(classes: DataFrame, counters: int, bits: int) -> DataFrame:
    """Candidates (train, eval) of classes ``no, train, eval, text, n``."""
    spark = classes.sparkSession
    shards = partitions(spark)
    counts = classes.where("eval").select("text").mapInArrow(lambda it: _sketch(it, counters), "counter int, n bigint").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    sketch = np.zeros(counters, np.uint16)
    sketch[counts.column("counter").to_numpy()] = np.minimum(counts.column("n").to_numpy(), 65_535)
    found = classes.select("train", "eval", "text").mapInArrow(lambda it: _presence(it, bits), "side int, bucket int, bits binary").groupBy("side", "bucket").agg(F.bitmap_or_agg("bits").alias("bits")).toArrow()
    maps = np.zeros((2, bits // BUCKET, BUCKET // 8), np.uint8)
    for side, bucket, x in zip(*(found.column(c).to_pylist() for c in ("side", "bucket", "bits"))):
        maps[side, bucket] = np.frombuffer(x, np.uint8)
    send = lambda side: spark.sparkContext.broadcast((sketch, maps[side].ravel()))
    train, evaluation = send(0), send(1)
    fields = "shard int, no bigint, n bigint, taken bigint, last bigint, text string"
    passages = persisted(classes.where("eval").select("no", "n", "text").mapInArrow(lambda it: _passages(it, train, shards), fields), "passages")
    windows = persisted(classes.where("train").select("no", "n", "text").mapInArrow(lambda it: _windows(it, evaluation, shards), fields), "windows")
    # A shard is a grid of places: its passages in as many pieces as automata of bounded size need, its windows in proportion to their number.
    size = F.sum(F.floor(F.length("text") / RUN) + 1)
    pieces = {r[0]: -(-r[1] // PASSAGES_PER_TASK) for r in passages.groupBy("shard").agg(size).collect()}
    loads = {r[0]: r[1] for r in windows.groupBy("shard").agg(size).collect()}
    a = salt_count(F.col("shard"), {k: m for k, m in pieces.items() if m > 1})
    b = salt_count(F.col("shard"), salts(loads, sum(loads.values()), shards))
    own = lambda n: F.pmod(F.xxhash64("no"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    rest = ["no", "n", "taken", "last", "text"]
    left = passages.select("shard", own(a).alias("i"), every(b).alias("j"), F.lit(0).alias("side"), *rest)
    right = windows.select("shard", every(a).alias("i"), own(b).alias("j"), F.lit(1).alias("side"), *rest)
    place = F.concat_ws("-", "shard", "i", "j").alias("place")
    rows = left.unionAll(right).select(place, "side", *rest).repartition(shards, "place").sortWithinPartitions("place", "side")
    hits = rows.mapInArrow(_scan, "train bigint, eval bigint, shared bigint, need bigint")
    found = hits.groupBy("train", "eval").agg(F.sum("shared").alias("shared"), F.max("need").alias("need")).where("shared >= need")
    return persisted(found.select("train", "eval"), "candidates")


def cross_split_overlaps(bodies: DataFrame, splits: DataFrame, symbols: int = SYMBOLS, counters: int = SKETCH, bits: int = BITMAP) -> tuple[DataFrame, DataFrame]:
    """Near-same records between train and the evaluation splits.

    bodies: ``key, h, body``; splits: ``key, split`` (train, validation, test or
    null). Returns the members ``key, no, train, eval`` of classes of equal
    bodies and the similar classes ``train, eval, similarity, coverage`` (class
    numbers). Keys with several bodies or splits belong to each; keys without
    split or body take no part; copies are compared once, as their class.

    The rarest runs of each evaluation record are passages of Aho-Corasick
    automata, dealt to shards by their hash; each training text sends a shard
    only its windows that belong there and are among its own rarest. A record
    and a text that are similar have enough such runs in common, so no pair is lost,
    every passage stands in one automaton and the work grows with the texts and not with texts times
    shards. Candidates are checked exactly: an automaton of all runs of the
    record scans the text, and matched intervals are merged into coverage.
    """
    flags = splits.where("key is not null and split is not null").groupBy("key").agg(F.max(F.col("split") == "train").alias("train"), F.max(F.col("split") != "train").alias("eval"))
    rows = bodies.where(F.size("body") >= RUN + LEAST_RUNS - 1).join(broadcast_if_small(flags), "key")
    hashed = persisted(rows.select(F.monotonically_increasing_id().alias("row"), "key", "train", "eval", "h", "body"), "bodies")
    # One row stands for all of equal bodies, so that only its body goes on.
    first = hashed.groupBy("h").agg(F.min("row").alias("no"), F.max("train").alias("train"), F.max("eval").alias("eval"))
    first = broadcast_if_small(first)
    classes = hashed.select(F.col("row").alias("no"), "body").join(first.select("no", "train", "eval"), "no").select("no", "train", "eval", "body")
    fields = "no bigint, train boolean, eval boolean, body array<string>"
    classes = persisted(classes.mapInArrow(lambda it: _texts(it, symbols), f"{fields}, text string, n bigint").where(F.col("n") >= LEAST_RUNS), "classes")
    members = skew_join(hashed.select("key", "train", "eval", "h").distinct(), first.select("h", "no"), "h", hot=hot_keys(hashed, "h")).drop("h")
    found = _scanned(classes.select("no", "train", "eval", "text", "n"), counters, bits)
    left = skew_join(found, classes.select(F.col("no").alias("train"), "n", F.col("body").alias("bt")), "train")
    both = skew_join(persisted(left, "left"), classes.select(F.col("no").alias("eval"), F.col("body").alias("be")), "eval")
    pairs = both.select("train", "eval", "n", "bt", "be").sortWithinPartitions("eval").mapInArrow(_verify, "train bigint, eval bigint, similarity double, coverage double")
    return persisted(members, "members"), persisted(pairs, "pairs")


def person_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs of keys, smaller first: ``key_1, key_2, similarity, coverage, train_key, eval_key``; a key in both splits pairs with itself.

    All pairs of the members of two similar classes are the result here;
    members of large classes are spread over tasks in proportion to them.
    """
    t = members.where("train").select(F.col("key").alias("tk"), F.col("no").alias("train"))
    e = members.where("eval").select(F.col("key").alias("ek"), F.col("no").alias("eval"))
    first = spread_join(t, pairs, "train")
    load = pairs.join(t.groupBy("train").agg(F.count("*").alias("size")), "train").groupBy("eval").agg(F.sum("size").alias("load"))
    n = partitions(pairs.sparkSession)
    total = load.agg(F.sum("load")).first()[0] or 0
    large = {r[0]: r[1] for r in load.where(F.col("load") * n > total).limit(n).collect()}  # fewer than n can be
    both = spread_join(first, e, "eval", salts(large, total, n))
    return both.select(F.least("tk", "ek").alias("key_1"), F.greatest("tk", "ek").alias("key_2"), "similarity", "coverage", F.col("tk").alias("train_key"), F.col("ek").alias("eval_key"))


def overlaps_per_key(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """``eval_key, n, c``: for each evaluation key the number of similar training keys and its greatest coverage, without listing the pairs.

    Training keys of one body are counted per class; only those of several bodies, which might count twice, are listed.
    """
    t = members.where("train").select("key", "no")
    several = persisted(t.groupBy("key").agg(F.count("*").alias("k")).where("k > 1").select("key"), "several")
    sizes = skew_join(t, several, "key", "left_anti").groupBy(F.col("no").alias("train")).agg(F.count("*").alias("size"))
    per = spread_join(members.where("eval").select(F.col("key").alias("eval_key"), F.col("no").alias("eval")), pairs.select("train", "eval", "coverage"), "eval")
    per = per.groupBy("eval_key", "train").agg(F.max("coverage").alias("c"))
    per = persisted(per, "per")
    single = per.join(sizes, "train", "left").groupBy("eval_key").agg(F.sum(F.coalesce("size", F.lit(0))).alias("a"), F.max("c").alias("c"))
    listed = per.join(skew_join(t, several, "key", "left_semi").select("key", F.col("no").alias("train")), "train").groupBy("eval_key").agg(F.count_distinct("key").alias("b"))
    return single.join(listed, "eval_key", "left").select("eval_key", (F.col("a") + F.coalesce("b", F.lit(0))).alias("n"), "c")


def _overlaps(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    b = sequence_bodies(table(spark, sf_dir, "processed_dataset"), "person_id", "concept_ids")
    s = table(spark, sf_dir, "patient_splits").select(F.col("person_id").alias("key"), split_name().alias("split"))
    return cross_split_overlaps(b, s)


def p4_found(spark, sf_dir: str) -> DataFrame:
    return person_pairs(*_overlaps(spark, sf_dir)).select(F.col("key_1").alias("person_id_1"), F.col("key_2").alias("person_id_2")).distinct()


def p4_report(spark, sf_dir: str) -> DataFrame:
    """Pairs, evaluation persons and mean coverage per evaluation split and source (the evaluation person's least care site; null if none)."""
    per = overlaps_per_key(*_overlaps(spark, sf_dir))
    s = table(spark, sf_dir, "patient_splits").select(F.col("person_id").alias("eval_key"), split_name().alias("split")).where("split <> 'train'").distinct()
    site = table(spark, sf_dir, "person").groupBy(F.col("person_id").alias("eval_key")).agg(F.min("care_site_id").alias("care_site_id"))
    return per.join(s, "eval_key").join(site, "eval_key", "left").groupBy("split", "care_site_id").agg(F.sum("n").alias("n_pairs"), F.count("*").alias("n_persons"), F.round(F.avg("c"), 6).alias("coverage"))


_PAIRS = """
WITH s AS (SELECT DISTINCT person_id, CASE WHEN x IN ('val', 'valid') THEN 'validation' ELSE x END AS split FROM
  (SELECT person_id, lower(trim(split, ' ' || chr(9) || chr(10) || chr(13))) AS x FROM patient_splits) WHERE x IN ('train', 'validation', 'val', 'valid', 'test')),
c AS (SELECT DISTINCT person_id, [y FOR y IN [trim(x, ' ' || chr(9) || chr(10) || chr(13)) FOR x IN concept_ids] IF y <> ''] AS t FROM processed_dataset WHERE person_id IN (SELECT person_id FROM s)),
b AS (SELECT DISTINCT person_id, t[(CASE WHEN t[1] = '[START]' THEN 6 ELSE 5 END):] AS t FROM c),
i AS (SELECT person_id, hash(t) AS v, t, unnest(range(1, len(t) - 2)) AS i FROM b),
r AS (SELECT DISTINCT person_id, v, t[i : i + 3] AS g FROM i),
n AS (SELECT person_id, v, count(*) AS n FROM r GROUP BY ALL HAVING count(*) >= 20),
q AS (SELECT r.*, n FROM r JOIN n USING (person_id, v)),
d AS (SELECT DISTINCT person_id FROM s WHERE split = 'train'), w AS (SELECT DISTINCT person_id FROM s WHERE split <> 'train'),
o AS (SELECT a.person_id AS x, b.person_id AS y, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS o FROM q a JOIN q b USING (g)
  WHERE a.person_id IN (SELECT person_id FROM d) AND b.person_id IN (SELECT person_id FROM w) GROUP BY a.person_id, a.v, b.person_id, b.v)
"""
_NEAR = "o >= 0.5 * (na + nb - o)"
SQL = {
    "p4_found": _PAIRS + f"SELECT DISTINCT least(x, y) AS person_id_1, greatest(x, y) AS person_id_2 FROM o WHERE {_NEAR}",
    "p4_report": _PAIRS.replace("SELECT a.person_id AS x, b.person_id AS y,", "SELECT a.person_id AS x, a.v AS vx, b.person_id AS y, b.v AS vy,") + f""", k AS (SELECT * FROM o WHERE {_NEAR}),
gi AS (SELECT person_id, v, i, t[i : i + 3] AS g, len(t) AS size FROM i WHERE person_id IN (SELECT y FROM k)),
cv AS (SELECT x, vx, y, vy, any_value(size) AS size, unnest(range(gi.i, gi.i + 4)) AS place FROM k JOIN gi ON gi.person_id = y AND gi.v = vy JOIN r ON r.person_id = x AND r.v = vx AND r.g = gi.g GROUP BY x, vx, y, vy, gi.i),
co AS (SELECT x, y, count(DISTINCT place) / any_value(size) AS c FROM cv GROUP BY x, vx, y, vy),
pe AS (SELECT y AS person_id, count(DISTINCT x) AS n, max(c) AS c FROM co GROUP BY 1), si AS (SELECT person_id, min(care_site_id) AS care_site_id FROM person GROUP BY 1)
SELECT split, care_site_id, sum(n)::BIGINT AS n_pairs, count(*) AS n_persons, round(avg(c), 6) AS coverage FROM pe JOIN s USING (person_id) LEFT JOIN si USING (person_id) WHERE split <> 'train' GROUP BY 1, 2""",
}
QUERIES = {"p4_found": p4_found, "p4_report": p4_report}
