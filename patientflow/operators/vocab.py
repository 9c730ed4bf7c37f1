"""Token vocabularies: training, expansion, encoding and decoding."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..functions import tokens as tk
from ..functions.tokens import SEQUENCES_SQL, sequences
from ..plans.registry import Registry
from ..plans.runtime import new_path, table
from ..plans.skew import global_rank
from ..sources.tables import load_artifacts, save_artifacts

SPECIALS = [tk.PAD, tk.OOV, tk.START, tk.END, tk.LINEAR]
VOCAB_SIZE, MIN_FREQUENCY = 50_000, 1
VALUE_BINS = 10


def token_counts(seqs: DataFrame, c: str) -> DataFrame:
    """``token, n``: words between blanks of all tokens, so a token of two words counts for both."""
    t = seqs.select(F.explode(c).alias("t"))
    words = t.select(F.explode(F.when(F.col("t").rlike(r"\s"), F.split("t", r"\s+")).otherwise(F.array("t"))).alias("token")).where("token <> ''")
    return words.groupBy("token").agg(F.count("*").alias("n"))


def train_vocabulary(counts: DataFrame, specials: list[str] = SPECIALS, size: int = VOCAB_SIZE, least: int = MIN_FREQUENCY) -> DataFrame:
    """``token, id, n``: the special tokens first, then tokens by falling count and rising text, at most ``size`` in all.

    Ids come from a rank over all partitions, so the number of distinct tokens is unbounded.
    """
    spark = counts.sparkSession
    known = [(t, i, None) for i, t in enumerate(specials)]
    ranked = global_rank(counts.where((F.col("n") >= least) & ~F.col("token").isin(specials)), [F.desc("n"), F.col("token")])
    rest = ranked.select("token", (F.col("rank") + len(specials)).alias("id"), "n").where(F.col("id") < size)
    return spark.createDataFrame(known, "token string, id bigint, n bigint").unionByName(rest)


def expand_vocabulary(old: DataFrame, counts: DataFrame, least: int = MIN_FREQUENCY) -> DataFrame:
    """The old vocabulary with the tokens it lacks appended under new ids, by falling count; old ids stay."""
    new = counts.where(F.col("n") >= least).join(old, "token", "left_anti")
    top = (old.agg(F.max("id")).first()[0] or 0) if old is not None else -1
    return old.unionByName(global_rank(new, [F.desc("n"), F.col("token")]).select("token", (F.col("rank") + top + 1).alias("id"), "n"))


def _lookup(batches: Iterator[pa.RecordBatch], words) -> Iterator[pa.RecordBatch]:
    """Last column array<string> to array<bigint> by position in the broadcast list; absent ones to OOV."""
    known, ids, oov = words.value
    for b in batches:
        c = b.column(b.num_columns - 1)
        flat = c.values.slice(c.offsets[0].as_py(), c.offsets[-1].as_py() - c.offsets[0].as_py())
        at = pc.fill_null(pc.take(ids, pc.index_in(flat, value_set=known)), oov)
        offsets = pc.subtract(c.offsets, c.offsets[0])
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.ListArray.from_arrays(offsets, at)], [*b.schema.names[:-1], "ids"])


def encode(seqs: DataFrame, key: str, c: str, vocabulary: DataFrame, size: int = VOCAB_SIZE) -> DataFrame:
    """``key, ids``: unknown and null tokens become [OOV]. The vocabulary is broadcast: it has at most ``size`` rows, which is checked."""
    rows = vocabulary.select("token", "id").limit(size + 1).collect()
    if len(rows) > size:
        raise ValueError(f"the vocabulary has more than {size} tokens")
    ids = {r[0]: r[1] for r in rows}
    sent = seqs.sparkSession.sparkContext.broadcast((pa.array(list(ids), pa.string()), pa.array(list(ids.values()), pa.int64()), ids.get(tk.OOV, 1)))
    kind = seqs.schema[key].dataType.simpleString()
    return seqs.select(F.col(key).alias("key"), F.coalesce(c, F.array().cast("array<string>")).alias("t")).mapInArrow(lambda it: _lookup(it, sent), f"key {kind}, ids array<bigint>")


def _names(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    names, skip = sent.value
    for b in batches:
        out = [[names.get(i, tk.OOV) for i in x if i not in skip] for x in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.string()))], ["key", "t"])


def decode(encoded: DataFrame, vocabulary: DataFrame, skip_specials: bool = False, size: int = VOCAB_SIZE) -> DataFrame:
    """``key, t``: ids back to tokens, unknown ids to [OOV]; special tokens are left out if asked."""
    rows = vocabulary.select("id", "token").limit(size + 1).collect()
    if len(rows) > size:
        raise ValueError(f"the vocabulary has more than {size} tokens")
    names = dict(map(tuple, rows))
    sent = encoded.sparkSession.sparkContext.broadcast((names, {i for i, t in names.items() if t in SPECIALS} if skip_specials else set()))
    kind = encoded.schema["key"].dataType.simpleString()
    return encoded.select("key", F.coalesce("ids", F.array().cast("array<bigint>")).alias("ids")).mapInArrow(lambda it: _names(it, sent), f"key {kind}, t array<string>")


def time_vocabulary(vocabulary: DataFrame) -> DataFrame:
    """``token, part_1, part_2, part_3`` of every time token of a vocabulary: its years, months and days."""
    t = F.col("token")
    days = tk.interval_days(t)
    parts = tk.time_tuple(days, tk.is_inpatient_att_token(t))
    return vocabulary.where(tk.is_att_token(t) & days.isNotNull()).select("token", *[parts[i].alias(f"part_{i + 1}") for i in range(3)])


def time_ids(vocabulary: DataFrame) -> DataFrame:
    """``token, id_1, id_2, id_3`` of every token of a vocabulary: the ids (from 1, in the order of the text) of the year, month and day of time tokens, 0 for all others."""
    times = time_vocabulary(vocabulary)
    parts = times.select(F.explode(F.array("part_1", "part_2", "part_3")).alias("part")).distinct()
    ids = global_rank(parts, [F.col("part")]).select("part", (F.col("rank") + 1).alias("id"))
    j = vocabulary.select("token").join(times, "token", "left")
    for i in (1, 2, 3):
        j = j.join(ids.select(F.col("part").alias(f"part_{i}"), F.col("id").alias(f"id_{i}")), f"part_{i}", "left")
    return j.select("token", *[F.coalesce(f"id_{i}", F.lit(0)).alias(f"id_{i}") for i in (1, 2, 3)])


def value_vocabulary(text_values: DataFrame, bins: int = VALUE_BINS, size: int = VOCAB_SIZE) -> DataFrame:
    """The vocabulary of values, ``token, id, n``: padding, unknown and the bins first, then text values by falling count."""
    fixed = [tk.PAD, tk.OOV, *[f"BIN:{i}" for i in range(bins)], "BIN:unknown", "BIN:NONE"]
    return train_vocabulary(text_values, fixed, size)


R = Registry()
_COUNTS = SEQUENCES_SQL + """, w AS (SELECT unnest(regexp_split_to_array(x, '\\s+')) AS token FROM (SELECT unnest(t) AS x FROM s)),
k AS (SELECT token, count(*) AS n FROM w WHERE token <> '' GROUP BY 1)"""
_SPECIAL_ROWS = "(VALUES " + ", ".join(f"('{t}', {i})" for i, t in enumerate(SPECIALS)) + ") x(token, id)"
_VOCAB = _COUNTS + f""", r AS (SELECT token, row_number() OVER (ORDER BY n DESC, token) + {len(SPECIALS) - 1} AS id, n FROM k WHERE token NOT IN (SELECT token FROM {_SPECIAL_ROWS})),
voc AS (SELECT token, id, NULL::BIGINT AS n FROM {_SPECIAL_ROWS} UNION ALL SELECT token, id, n FROM r WHERE id < {VOCAB_SIZE})"""


def vocabulary_of(spark, sf_dir: str, size: int = VOCAB_SIZE) -> DataFrame:
    return train_vocabulary(token_counts(sequences(spark, sf_dir), "t"), size=size)


@R.query("vocabulary", _VOCAB + " SELECT * FROM voc")
def vocabulary(spark, sf_dir: str) -> DataFrame:
    return vocabulary_of(spark, sf_dir)


@R.query("vocabulary_topk", _VOCAB + " SELECT * FROM voc WHERE id < 200")
def vocabulary_topk(spark, sf_dir: str) -> DataFrame:
    """A vocabulary capped at 200 tokens."""
    return vocabulary_of(spark, sf_dir, 200)


_SPLIT = "(SELECT DISTINCT person_id FROM patient_splits WHERE lower(trim(split)) = 'train')"


@R.query("vocabulary_expand", SEQUENCES_SQL + f""", w AS (SELECT person_id IN {_SPLIT} AS tr, unnest(regexp_split_to_array(x, '\\s+')) AS token FROM (SELECT person_id, unnest(t) AS x FROM s)),
a AS (SELECT token, count(*) AS n FROM w WHERE tr AND token <> '' GROUP BY 1), b AS (SELECT token, count(*) AS n FROM w WHERE NOT tr AND token <> '' GROUP BY 1),
o AS (SELECT token, id, NULL::BIGINT AS n FROM {_SPECIAL_ROWS} UNION ALL SELECT token, row_number() OVER (ORDER BY n DESC, token) + {len(SPECIALS) - 1}, n FROM a WHERE token NOT IN (SELECT token FROM {_SPECIAL_ROWS}))
SELECT * FROM o UNION ALL SELECT token, row_number() OVER (ORDER BY n DESC, token) + (SELECT max(id) FROM o), n FROM b WHERE token NOT IN (SELECT token FROM o)""")
def vocabulary_expand(spark, sf_dir: str) -> DataFrame:
    """The vocabulary of the train split, expanded by the tokens of all other persons."""
    train = table(spark, sf_dir, "patient_splits").where(F.lower(F.trim("split")) == "train").select("person_id").distinct()
    s = sequences(spark, sf_dir)
    old = train_vocabulary(token_counts(s.join(train, "person_id", "left_semi"), "t"))
    return expand_vocabulary(old, token_counts(s.join(train, "person_id", "left_anti"), "t"))


def _keyed(spark, sf_dir: str) -> DataFrame:
    return sequences(spark, sf_dir).select("person_id", "t")


@R.query("encode_tokens", _VOCAB.replace("voc AS", "voc AS MATERIALIZED") + """, i AS (SELECT row_number() OVER () AS rn, person_id, t FROM s), e AS (SELECT rn, person_id, generate_subscripts(t, 1) AS pos, unnest(t) AS token FROM i)
SELECT person_id, string_agg(coalesce(id, 1)::VARCHAR, ' ' ORDER BY pos) AS ids FROM e LEFT JOIN voc USING (token) GROUP BY rn, person_id""")
def encode_tokens(spark, sf_dir: str) -> DataFrame:
    e = encode(_keyed(spark, sf_dir).where("size(t) > 0"), "person_id", "t", vocabulary_of(spark, sf_dir))
    return e.select(F.col("key").alias("person_id"), F.array_join("ids", " ").alias("ids"))


@R.query("decode_tokens", _VOCAB + ", i AS (SELECT row_number() OVER () AS rn, person_id, t FROM s), e AS (SELECT rn, person_id, generate_subscripts(t, 1) AS pos, unnest(t) AS token FROM i) SELECT person_id, string_agg(CASE WHEN token IN (SELECT token FROM voc) THEN token ELSE '[OOV]' END, ' ' ORDER BY pos) AS t FROM e GROUP BY rn, person_id")
def decode_tokens(spark, sf_dir: str) -> DataFrame:
    """Encoded and decoded again."""
    v = vocabulary_of(spark, sf_dir)
    d = decode(encode(_keyed(spark, sf_dir).where("size(t) > 0"), "person_id", "t", v), v)
    return d.select(F.col("key").alias("person_id"), F.array_join("t", " ").alias("t"))


_TIMES = _VOCAB + """, d AS (SELECT token, CASE WHEN token = 'LT' THEN 1095 WHEN starts_with(token, 'i-') OR starts_with(token, 'VS-') THEN TRY_CAST(substr(split_part(token, '-', 2), 2) AS INT)
 ELSE TRY_CAST(substr(token, 2) AS BIGINT) * CASE token[1] WHEN 'D' THEN 1 WHEN 'W' THEN 7 WHEN 'M' THEN 30 WHEN 'Y' THEN 365 END END AS n FROM voc WHERE regexp_matches(token, '^[DWMY][0-9]') OR token = 'LT' OR starts_with(token, 'VS-') OR (starts_with(token, 'i-') AND NOT starts_with(token, 'i-H')))
SELECT token, 'year:' || (n // 365) AS part_1, 'month:' || (n % 365 // 30) AS part_2, CASE WHEN regexp_matches(token, '^(VS-|i-)D[0-9]') THEN 'i-day:' ELSE 'day:' END || (n % 365 % 30) AS part_3 FROM d WHERE n IS NOT NULL"""


@R.query("time_vocabulary", _TIMES)
def time_vocabulary_query(spark, sf_dir: str) -> DataFrame:
    return time_vocabulary(vocabulary_of(spark, sf_dir))


_PARTS = _TIMES[: _TIMES.rindex("SELECT token, 'year:'")].rstrip() + ", tv AS (" + _TIMES[_TIMES.rindex("SELECT token, 'year:'") :] + """),
pi AS (SELECT part, row_number() OVER (ORDER BY part) AS id FROM (SELECT part_1 AS part FROM tv UNION SELECT part_2 FROM tv UNION SELECT part_3 FROM tv))"""


@R.query("time_ids", _PARTS + " SELECT voc.token, coalesce(a.id, 0) AS id_1, coalesce(b.id, 0) AS id_2, coalesce(c.id, 0) AS id_3 FROM voc LEFT JOIN tv ON voc.token = tv.token LEFT JOIN pi a ON a.part = part_1 LEFT JOIN pi b ON b.part = part_2 LEFT JOIN pi c ON c.part = part_3")
def time_ids_query(spark, sf_dir: str) -> DataFrame:
    """Ids of the parts of every vocabulary token."""
    return time_ids(vocabulary_of(spark, sf_dir))


@R.query("word_vocabulary", "SELECT token, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '\\s+')) AS token FROM documents) WHERE token <> '' GROUP BY 1")
def word_vocabulary(spark, sf_dir: str) -> DataFrame:
    """Word counts of a text corpus, by the same operator."""
    return token_counts(table(spark, sf_dir, "documents").select(F.array("text").alias("t")), "t")


@R.query("concept_names", _VOCAB + ", c AS (SELECT DISTINCT concept_id, trim(concept_name) AS concept_name FROM concept WHERE concept_id IS NOT NULL) SELECT token, id, concept_name FROM voc JOIN c ON token = c.concept_id::VARCHAR")
def concept_names(spark, sf_dir: str) -> DataFrame:
    """Vocabulary tokens with their concept's name."""
    c = table(spark, sf_dir, "concept").where("concept_id is not null").select(F.col("concept_id").cast("string").alias("token"), F.trim("concept_name").alias("concept_name")).distinct()
    return vocabulary_of(spark, sf_dir).join(c, "token").select("token", "id", "concept_name")


_VALUE_SPECIALS = "(VALUES " + ", ".join(f"('{t}', {i})" for i, t in enumerate([tk.PAD, tk.OOV, *[f"BIN:{i}" for i in range(VALUE_BINS)], "BIN:unknown", "BIN:NONE"])) + ") x(token, id)"


@R.query("value_vocabulary", f"""WITH k AS (SELECT unnest(regexp_split_to_array(value_source_value, '\\s+')) AS token FROM measurement WHERE coalesce(value_source_value, '') <> ''), c AS (SELECT token, count(*) AS n FROM k WHERE token <> '' AND token NOT IN (SELECT token FROM {_VALUE_SPECIALS}) GROUP BY 1)
SELECT token, id, NULL::BIGINT AS n FROM {_VALUE_SPECIALS} UNION ALL SELECT token, row_number() OVER (ORDER BY n DESC, token) + {VALUE_BINS + 3}, n FROM c""")
def value_vocabulary_query(spark, sf_dir: str) -> DataFrame:
    """Bins and the words of all text values of measurements."""
    m = table(spark, sf_dir, "measurement").where("value_source_value <> ''")
    return value_vocabulary(token_counts(m.select(F.array("value_source_value").alias("t")), "t"))


@R.query("tokenizer_round_trip", _VOCAB + " SELECT * FROM voc")
def tokenizer_round_trip(spark, sf_dir: str) -> DataFrame:
    """A vocabulary saved with its time vocabulary as a tokenizer's parts and loaded again."""
    v = vocabulary_of(spark, sf_dir)
    path = new_path(spark, "tokenizer")
    save_artifacts(path, vocabulary=v, times=time_vocabulary(v))
    return load_artifacts(spark, path, ["vocabulary", "times"])["vocabulary"]
