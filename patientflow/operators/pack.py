"""Batches of sequences: next-fit packing, masks, padding and features of segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.registry import Registry
from ..plans.runtime import persisted, table
from .splits import draw

MAX_TOKENS, CONTEXT, EXTRA = 16_384, 1_024, 2
#: Lengths that one fold takes: the packing order is cut into runs of so many sequences, so no array grows with the data.
RUN = 4_000
PAD_ID, END_ID, IGNORED = 0, 3, -100


def next_fit(lengths: DataFrame, key: str, length: str, ranks: int = 1, max_tokens: int = MAX_TOKENS, context: int = CONTEXT, seed: int = 0) -> DataFrame:
    """``key, rank, run, batch, tokens``: sequences in hash order fill batches of at most ``max_tokens``, each taking its length (cut at ``context``) and two more.

    A batch is closed when the next sequence does not fit; a longer one stands
    alone. Sequences are dealt to ``ranks`` and to runs of about ``RUN``, each
    packed by one fold over its ordered array; a run's last batch may stay part-filled.
    Null lengths count 0.
    """
    rows = lengths.select(key, F.least(F.coalesce(length, F.lit(0)), F.lit(context)).cast("int").alias("n"), draw(key, seed=seed).alias("h"))
    total = rows.count()
    runs = max(1, -(-total // (RUN * ranks)))
    slot = F.conv(F.substring("h", 1, 8), 16, 10).cast("bigint")
    rows = rows.withColumn("rank", (slot % ranks).cast("int")).withColumn("run", (F.floor(slot / ranks) % runs).cast("int"))
    each = rows.groupBy("rank", "run").agg(F.sort_array(F.collect_list(F.struct("h", key, "n"))).alias("x"))
    start = F.struct(F.lit(0).alias("b"), F.lit(0).alias("t"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        full = (s["t"] > 0) & (s["t"] + x["n"] + EXTRA > max_tokens)
        b = s["b"] + full.cast("int")
        return F.struct(b.alias("b"), (F.when(full, 0).otherwise(s["t"]) + x["n"] + EXTRA).alias("t"), F.concat(s["out"], F.array(b)).alias("out"))

    packed = each.withColumn("o", F.aggregate("x", start, step)["out"])
    flat = packed.select("rank", "run", F.explode(F.arrays_zip(F.col(f"x.{key}").alias("k"), F.col("x.n").alias("n"), F.col("o").alias("b"))).alias("z"))
    return flat.select(F.col("z.k").alias(key), "rank", "run", F.col("z.b").alias("batch"), F.col("z.n").alias("tokens"))


def assemble(seqs: DataFrame, batch: list[str], order: str, ids: str, add_end: bool = True) -> DataFrame:
    """``batch, input_ids, attention_mask, position_ids``: [ids][end?][pad] per sequence, mask 1 but for the pad, positions anew in each."""
    tail = F.array(*([F.lit(END_ID)] if add_end else []), F.lit(PAD_ID))
    piece = F.concat(F.col(ids).cast("array<int>"), tail)
    rows = seqs.select(*batch, F.col(order).alias("o"), piece.alias("p"))
    packed = rows.groupBy(*batch).agg(F.sort_array(F.collect_list(F.struct("o", "p"))).p.alias("p"))
    n = lambda x: F.sequence(F.lit(0), F.size(x) - 1)
    mask = lambda x: F.concat(F.array_repeat(F.lit(1), F.size(x) - 1), F.array(F.lit(0)))
    return packed.select(*batch, F.flatten("p").alias("input_ids"), F.flatten(F.transform("p", mask)).alias("attention_mask"), F.flatten(F.transform("p", n)).alias("position_ids"))


def _segments(mask: Column) -> Column:
    """The runs of ones between zeros, as texts; linear in the length."""
    return F.split(F.array_join(F.transform(mask, lambda m: F.when(m != 0, "1").otherwise("0")), ""), "0", -1)


def segment_ids(mask: Column) -> Column:
    """Per position the number of its segment (zeros before it), null where the mask is 0."""
    parts = F.transform(_segments(mask), lambda s, i: F.concat(F.array_repeat(i, F.length(s)), F.array(F.lit(None).cast("int"))))
    return F.slice(F.flatten(parts), 1, F.size(mask))


def unpadded(mask: Column) -> Column:
    """``struct(indices, offsets, longest, packed)``: kept positions, cumulative lengths of segments, the longest, and whether a zero stands between ones."""
    indices = F.filter(F.transform(mask, lambda m, i: F.when(m != 0, i)), lambda i: i.isNotNull())
    lengths = F.filter(F.transform(_segments(mask), F.length), lambda n: n > 0)
    # One element per segment.
    offsets = F.aggregate(lengths, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.get(a, F.size(a) - 1) + n)))
    return F.struct(indices.alias("indices"), offsets.alias("offsets"), F.array_max(lengths).alias("longest"), (F.size(lengths) > 1).alias("packed"))


def block_mask(packs: DataFrame, key: str, mask: str) -> DataFrame:
    """``key, i, first, last``: each kept position with the range of positions that it may see, those of its segment; linear in the length."""
    s = packs.select(key, F.posexplode(segment_ids(F.col(mask))).alias("i", "s")).where("s is not null")
    own = Window.partitionBy(key, "s")
    return s.select(key, "i", F.min("i").over(own).alias("first"), F.max("i").over(own).alias("last"))


def last_of_segments(values: Column, mask: Column) -> Column:
    """The value at the last position of each segment."""
    at = F.filter(F.transform(mask, lambda m, i: F.when((m != 0) & (F.coalesce(F.get(mask, i + 1), F.lit(0)) == 0), i)), lambda i: i.isNotNull())
    return F.transform(at, lambda i: F.get(values, i))


def segment_means(rows: DataFrame, key: str, states: str, mask: str, marked: str) -> DataFrame:
    """``key, segment, mean``: mean vector of the marked positions of each segment; zeros without any."""
    z = rows.select(key, F.posexplode(F.arrays_zip(F.col(states).alias("h"), segment_ids(F.col(mask)).alias("s"), F.col(marked).alias("m"))).alias("i", "z")).where("z.s is not null")
    long = z.select(key, F.col("z.s").alias("segment"), F.col("z.m").alias("m"), F.posexplode("z.h").alias("d", "v"))
    mean = long.groupBy(key, "segment", "d").agg(F.coalesce(F.avg(F.when(F.col("m") == 1, F.col("v"))), F.lit(0.0)).alias("v"))
    return mean.groupBy(key, "segment").agg(F.array_sort(F.collect_list(F.struct("d", "v"))).v.alias("mean"))


def padded(c: Column, n: int | Column, pad: Column, left: bool = False) -> Column:
    """An array filled up to n elements; longer ones stay."""
    more = F.array_repeat(pad, F.greatest(F.lit(n) - F.size(c) if isinstance(n, int) else n - F.size(c), F.lit(0)))
    return F.concat(more, c) if left else F.concat(c, more)


def labels(ids: Column, mask: Column) -> Column:
    """The ids where the mask is 1, else -100."""
    return F.zip_with(ids, mask, lambda i, m: F.when(m == 1, i).otherwise(IGNORED))


def estimated_batches(lengths: DataFrame, length: str, max_tokens: int = MAX_TOKENS, context: int = CONTEXT) -> DataFrame:
    """One row ``mean_length, n_batches``: from the mean of the cut lengths."""
    cut = F.least(F.coalesce(length, F.lit(0)), F.lit(context))
    a = lengths.agg(F.avg(cut).alias("mean_length"), F.count("*").alias("n"))
    return a.select("mean_length", F.greatest(F.ceil(F.col("n") * F.col("mean_length") / max_tokens), F.lit(1)).alias("n_batches"))


R = Registry()


def _ids(spark, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "processed_dataset").where("person_id is not null and input_ids is not null")
    return p.groupBy("person_id").agg(F.max("input_ids").alias("ids"))


@R.query("packing")
def packing(spark, sf_dir: str) -> DataFrame:
    return next_fit(_ids(spark, sf_dir).select("person_id", F.size("ids").alias("n")), "person_id", "n")


@R.query("packing_totals", f"WITH i AS (SELECT person_id, max(input_ids) AS ids FROM processed_dataset WHERE person_id IS NOT NULL AND input_ids IS NOT NULL GROUP BY 1) SELECT count(*) AS n_sequences, sum(least(len(ids), {CONTEXT})) AS n_tokens, true AS within FROM i")
def packing_totals(spark, sf_dir: str) -> DataFrame:
    """Sequences and tokens packed, and whether no batch of several exceeds the limit."""
    p = packing(spark, sf_dir)
    b = p.groupBy("rank", "run", "batch").agg(F.count("*").alias("n"), F.sum("tokens").alias("t"))
    return b.agg(F.sum("n").alias("n_sequences"), F.sum("t").alias("n_tokens"), F.min((F.col("t") + EXTRA * F.col("n") <= MAX_TOKENS) | (F.col("n") == 1)).alias("within"))


@R.query("pack_estimate", f"WITH i AS (SELECT person_id, max(input_ids) AS ids FROM processed_dataset WHERE person_id IS NOT NULL AND input_ids IS NOT NULL GROUP BY 1), a AS (SELECT avg(least(len(ids), {CONTEXT})) AS mean_length, count(*) AS n FROM i) SELECT mean_length, greatest(ceil(n * mean_length / {MAX_TOKENS}), 1)::BIGINT AS n_batches FROM a")
def pack_estimate(spark, sf_dir: str) -> DataFrame:
    return estimated_batches(_ids(spark, sf_dir).select(F.size("ids").alias("n")), "n")


def _packs(spark, sf_dir: str) -> DataFrame:
    """Packs of all sequences that have ids, at whatever length: eight neighbours by id to a pack."""
    i = _ids(spark, sf_dir).where(F.size("ids") >= 1)
    return assemble(i.withColumn("pack", F.floor(F.col("person_id") / 8)), ["pack"], "person_id", "ids")


_PACKS = """WITH i AS (SELECT person_id, max(input_ids) AS ids FROM processed_dataset WHERE person_id IS NOT NULL AND input_ids IS NOT NULL GROUP BY 1),
l AS (SELECT person_id, person_id // 8 AS pack, list_concat(ids, [3, 0]) AS p FROM i WHERE len(ids) >= 1),
e AS (SELECT person_id, pack, generate_subscripts(p, 1) - 1 AS pos, unnest(p) AS id, len(p) AS n FROM l),
f AS (SELECT *, row_number() OVER (PARTITION BY pack ORDER BY person_id, pos) - 1 AS i, (pos < n - 1)::INT AS m, dense_rank() OVER (PARTITION BY pack ORDER BY person_id) - 1 AS seg FROM e)"""


@R.query("pack_position_ids", _PACKS + " SELECT pack, string_agg(id::VARCHAR, ' ' ORDER BY i) AS input_ids, string_agg(m::VARCHAR, ' ' ORDER BY i) AS attention_mask, string_agg(pos::VARCHAR, ' ' ORDER BY i) AS position_ids FROM f GROUP BY 1")
def pack_position_ids(spark, sf_dir: str) -> DataFrame:
    return _packs(spark, sf_dir).select("pack", *[F.array_join(c, " ").alias(c) for c in ("input_ids", "attention_mask", "position_ids")])


@R.query("segment_ids", _PACKS + " SELECT pack, string_agg(seg::VARCHAR, ' ' ORDER BY i) FILTER (m = 1) AS segments FROM f GROUP BY 1")
def segment_ids_query(spark, sf_dir: str) -> DataFrame:
    return _packs(spark, sf_dir).select("pack", F.array_join(segment_ids(F.col("attention_mask")), " ").alias("segments"))


@R.query("unpad_offsets", _PACKS + ", g AS (SELECT pack, seg, count(*) AS n FROM f WHERE m = 1 GROUP BY ALL) SELECT pack, sum(n) AS n_kept, max(n) AS longest, count(*) > 1 AS packed FROM g GROUP BY 1")
def unpad_offsets(spark, sf_dir: str) -> DataFrame:
    p = _packs(spark, sf_dir).select("pack", unpadded(F.col("attention_mask")).alias("u"))
    return p.select("pack", F.get("u.offsets", F.size("u.offsets") - 1).alias("n_kept"), "u.longest", "u.packed")


@R.query("segment_last_tokens", _PACKS + " SELECT pack, string_agg(id::VARCHAR, ' ' ORDER BY i) AS last_ids FROM f WHERE pos = n - 2 GROUP BY 1")
def segment_last_tokens(spark, sf_dir: str) -> DataFrame:
    return _packs(spark, sf_dir).select("pack", F.array_join(last_of_segments(F.col("input_ids"), F.col("attention_mask")), " ").alias("last_ids"))


@R.query("block_mask_counts", _PACKS + ", g AS (SELECT pack, seg, count(*) AS n FROM f WHERE m = 1 GROUP BY ALL) SELECT pack, sum(n * n) AS n_pairs FROM g GROUP BY 1")
def block_mask_counts(spark, sf_dir: str) -> DataFrame:
    """Visible pairs of positions in each pack."""
    seen = block_mask(_packs(spark, sf_dir), "pack", "attention_mask")
    return seen.groupBy("pack").agg(F.sum(F.col("last") - F.col("first") + 1).cast("bigint").alias("n_pairs"))


@R.query("packed_batches", f"WITH i AS (SELECT person_id, max(input_ids) AS ids FROM processed_dataset WHERE person_id IS NOT NULL AND input_ids IS NOT NULL GROUP BY 1) SELECT person_id, least(len(ids), {CONTEXT}) + 1 AS n_tokens, array_to_string(list_concat(ids[:{CONTEXT}], [{END_ID}]), ' ') AS ids FROM i")
def packed_batches(spark, sf_dir: str) -> DataFrame:
    """What stands in the batches of next_fit after they were assembled: each sequence, cut at the context, as a segment of its batch."""
    i = _ids(spark, sf_dir).withColumn("ids", F.slice("ids", 1, CONTEXT))
    batch = ["rank", "run", "batch"]
    to = next_fit(i.select("person_id", F.size("ids").alias("n")), "person_id", "n").select("person_id", *batch)
    j = persisted(i.join(to, "person_id"), "batches")
    persons = j.groupBy(*batch).agg(F.sort_array(F.collect_list("person_id")).alias("persons"))
    packs = assemble(j, batch, "person_id", "ids").join(persons, batch)
    u = unpadded(F.col("attention_mask"))
    x = packs.select("persons", F.transform(u["indices"], lambda k: F.get("input_ids", k)).alias("kept"), u["offsets"].alias("at"))
    each = x.select("kept", "at", F.posexplode("persons").alias("k", "person_id"))
    first, last = F.get("at", F.col("k")), F.get("at", F.col("k") + 1)
    return each.select("person_id", (last - first).alias("n_tokens"), F.array_join(F.slice("kept", first + 1, last - first), " ").alias("ids"))


@R.query("segment_mean", "WITH e AS (SELECT vec_id // 8 AS pack, vec_id % 8 // 4 AS segment, label, generate_subscripts(embedding, 1) AS d, unnest(embedding) AS v FROM embeddings), m AS (SELECT pack, segment, d, coalesce(avg(v::DOUBLE) FILTER (label % 2 = 1), 0) AS v FROM e GROUP BY ALL) SELECT pack, row_number() OVER (PARTITION BY pack ORDER BY segment) - 1 AS segment, round(sum(v), 4) AS total FROM m GROUP BY pack, m.segment")
def segment_mean(spark, sf_dir: str) -> DataFrame:
    """Mean vectors of marked positions (odd labels) of packs made of the vectors, four to a segment; summed over dimensions."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 8).alias("pack"), F.floor(F.col("vec_id") % 8 / 4).alias("part"), F.col("embedding").cast("array<double>").alias("h"), (F.col("label") % 2).alias("m"))
    seg = e.groupBy("pack", "part").agg(F.array_sort(F.collect_list(F.struct("vec_id", "h", "m"))).alias("x"))
    gap = F.array(F.struct(F.lit(0).cast("bigint").alias("vec_id"), F.array_repeat(F.lit(0.0), 64).alias("h"), F.lit(0).alias("m")))
    piece = F.concat("x", F.transform(gap, lambda g: F.struct(g["vec_id"].alias("vec_id"), g["h"].alias("h"), g["m"].cast(e.schema["m"].dataType).alias("m"))))
    packs = seg.select("pack", "part", piece.alias("x"), F.concat(F.array_repeat(F.lit(1), F.size("x")), F.array(F.lit(0))).alias("k")).groupBy("pack").agg(F.array_sort(F.collect_list(F.struct("part", "x", "k"))).alias("y"))
    packs = packs.select("pack", F.flatten("y.x").alias("x"), F.flatten("y.k").alias("mask"))
    rows = packs.select("pack", F.col("x.h").alias("h"), "mask", F.col("x.m").alias("m"))
    return segment_means(rows, "pack", "h", "mask", "m").select("pack", "segment", F.round(F.aggregate("mean", F.lit(0.0), lambda a, v: a + v), 4).alias("total"))


@R.query("batch_padding", "WITH i AS (SELECT person_id, max(input_ids) AS ids FROM processed_dataset WHERE person_id IS NOT NULL AND input_ids IS NOT NULL GROUP BY 1) SELECT person_id, greatest(len(ids), 64) AS n, len([x FOR x IN ids IF x <> 0]) AS n_labels, greatest(64 - len(ids), 0) AS n_pad FROM i")
def batch_padding(spark, sf_dir: str) -> DataFrame:
    """Sequences filled up to 64 ids, with their labels."""
    i = _ids(spark, sf_dir).withColumn("p", padded(F.col("ids"), 64, F.lit(PAD_ID)))
    m = F.transform("p", lambda x, j: ((j < F.size("ids")) & (x != PAD_ID)).cast("int"))
    l = labels(F.col("p"), m)  # noqa: E741
    return i.select("person_id", F.size("p").alias("n"), F.size(F.filter(l, lambda x: x != IGNORED)).alias("n_labels"), F.greatest(F.lit(64) - F.size("ids"), F.lit(0)).alias("n_pad"))


@R.query("batch_padding_left", f"WITH i AS (SELECT person_id, max(input_ids) AS ids FROM processed_dataset WHERE person_id IS NOT NULL AND input_ids IS NOT NULL GROUP BY 1) SELECT person_id, array_to_string(list_concat([{PAD_ID} FOR x IN range(64 - len(ids))], ids), ' ') AS ids FROM i")
def batch_padding_left(spark, sf_dir: str) -> DataFrame:
    """Sequences filled up to 64 ids before their start, as for generation."""
    return _ids(spark, sf_dir).select("person_id", F.array_join(padded(F.col("ids"), 64, F.lit(PAD_ID), left=True), " ").alias("ids"))


@R.query("value_labels", f"WITH i AS (SELECT person_id, max({{'i': input_ids, 'm': value_indicators}}) AS x FROM processed_dataset WHERE person_id IS NOT NULL AND input_ids IS NOT NULL AND value_indicators IS NOT NULL GROUP BY 1) SELECT person_id, array_to_string([CASE WHEN x.m[k] = 1 THEN coalesce(x.i[k], {IGNORED}) ELSE {IGNORED} END FOR k IN range(1, len(x.i) + 1)], ' ') AS labels FROM i")
def value_labels(spark, sf_dir: str) -> DataFrame:
    """Ids of the positions with a value, all others ignored."""
    p = table(spark, sf_dir, "processed_dataset").where("person_id is not null and input_ids is not null and value_indicators is not null")
    x = p.groupBy("person_id").agg(F.max(F.struct(F.col("input_ids").alias("i"), F.col("value_indicators").alias("m"))).alias("x"))
    mask = F.slice("x.m", 1, F.size("x.i"))
    l = F.transform(labels(F.col("x.i"), mask), lambda v: F.coalesce(v, F.lit(IGNORED)))  # noqa: E741
    return x.select("person_id", F.array_join(l, " ").alias("labels"))
