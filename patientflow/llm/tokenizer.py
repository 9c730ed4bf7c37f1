"""Encoding of a corpus with a public byte-level tokenizer, in overlapping chunks (problem 8)."""

from __future__ import annotations

import base64
import functools
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..plans.runtime import partitions, persisted, table

#: Where the public vocabulary lies on the driver, which sends it to the tasks; a parameter of all operators here.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-token pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of a chunk and of its overlap with the next one.
CHUNK, OVERLAP = 512, 128
#: Characters of the part of a text that one task takes, and of its overlap with the next part.
SPAN, EDGE = 4096 * CHUNK, 4096
#: A boundary so near to a chunk's end may depend on what follows (the pattern looks at most three characters ahead, white space apart).
UNSURE = 8
#: Characters of a batch of parts.
BATCH_CHARS = 1 << 24
#: Pre-tokens whose ids a task remembers, and the longest of them.
REMEMBERED, LONGEST = 200_000, 64


@functools.lru_cache(maxsize=4)
def _encoding(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encoding(path: str = VOCABULARY):
    """The tokenizer of a vocabulary file."""
    return _encoding(_read(path))


@functools.lru_cache(maxsize=1)
def _pattern():
    import regex

    return regex.compile(PATTERN)


def pretokens(text: str) -> tuple[list[str], list[int]]:
    """The pre-tokens of a text, which cover it without holes, and where they start."""
    found = _pattern().findall(text)
    return found, list(accumulate(map(len, found), initial=0))[:-1]


def _lists(rows: list[list[int]]) -> pa.Array:
    size = np.fromiter(map(len, rows), np.int64, len(rows))
    flat = np.fromiter((x for r in rows for x in r), np.int32, int(size.sum()))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(flat))


def _parts(batches: Iterator[pa.RecordBatch], span: int, edge: int) -> Iterator[pa.RecordBatch]:
    """(key, row, text) to (key, row, part, parts, text): a part with the edge that it shares with the next one; also an empty text has a part."""
    for b in batches:
        at, ks, ns, texts, size = [], [], [], [], 0
        rows = b.column(2).to_pylist()
        for i, text in enumerate(rows):
            text = text or ""
            n = max(1, -(-len(text) // span))
            for k in range(n):
                part = text if n == 1 else text[k * span : (k + 1) * span + edge]
                at.append(i)
                ks.append(k)
                ns.append(n)
                texts.append(part)
                size += len(part)
                if size > BATCH_CHARS or (i + 1 == len(rows) and k + 1 == n):
                    own = pa.array(at)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(own), b.column(1).take(own), pa.array(ks, pa.int32()), pa.array(ns, pa.int32()), pa.array(texts)], ["key", "row", "part", "parts", "text"])
                    at, ks, ns, texts, size = [], [], [], [], 0


def _chunks(batches: Iterator[pa.RecordBatch], chunk: int, overlap: int) -> Iterator[pa.RecordBatch]:
    """(key, row, part, parts, text) to the same with ``k, chunks`` and the text of the k-th of the part's chunks."""
    for b in batches:
        at, ks, ns, texts = [], [], [], []
        for i, t in enumerate(b.column(4).to_pylist()):
            t = t or ""
            n = max(1, -(-len(t) // chunk))
            at += [i] * n
            ks += range(n)
            ns += [n] * n
            texts += [t[k * chunk : (k + 1) * chunk + overlap] for k in range(n)]
        own = pa.array(at, pa.int64())
        yield pa.RecordBatch.from_arrays([*[b.column(j).take(own) for j in range(4)], pa.array(ks, pa.int32()), pa.array(ns, pa.int32()), pa.array(texts, pa.string())], ["key", "row", "part", "parts", "k", "chunks", "text"])


def stitched(chunks: list[str], chunk: int) -> list[str]:
    """The pre-tokens of the text that overlapping chunks make, each chunk pre-tokenised alone.

    Neighbours are stitched at the first boundary that both have: from there on they agree. Chunks
    that share none (a pre-token longer than the overlap) are joined, one, two, four, ... at a time, and pre-tokenised together.
    """
    done = [pretokens(t) for t in chunks]
    out: list[str] = []
    k, first = 0, 0  # the chunk and the boundary in it up to which all is done
    text, (found, starts), body, more = chunks[0], done[0], chunk, 1  # body: where the next chunk begins
    while True:
        begin = bisect_left(starts, first)
        if k + 1 >= len(chunks):
            return out + found[begin:]
        sure = {i - body for i in starts[bisect_left(starts, body) :] if i < len(text) - UNSURE}
        last = k + 2 == len(chunks)
        meet = next((i for i in done[k + 1][1] if i in sure and (last or i < len(chunks[k + 1]) - UNSURE)), None)
        if meet is not None:
            out += found[begin : bisect_left(starts, body + meet)]
            k, first = k + 1, meet
            text, (found, starts), body, more = chunks[k], done[k], chunk, 1
            continue
        to = min(len(chunks) - 1, k + more)
        text = text[:body] + "".join(t[:chunk] for t in chunks[k + 1 : to]) + chunks[to]
        body, k, more = body + chunk * (to - k), to, 2 * more
        rest, at = pretokens(text[first:])
        found, starts = rest, [first + i for i in at]


def _encode(batches: Iterator[pa.RecordBatch], vocabulary, chunk: int, span: int, edge: int) -> Iterator[pa.RecordBatch]:
    """Chunks, those of a part one after the other, to (key, row, part, parts, ids, head, head_ids, tail, tail_ids).

    head and tail: boundaries in the edges shared with the neighbouring parts, counted from the edge's start, and how many ids stand before them.
    """
    enc = _encoding(vocabulary.value)
    known: dict[str, list[int]] = {}

    def ids_of(piece: str) -> list[int]:
        x = enc._encode_single_piece(piece.encode())
        if len(known) < REMEMBERED and len(piece) < LONGEST:
            known[piece] = x
        return x

    held: list[str] = []
    for b in batches:
        at, ids, edges = [], [], []
        for i, (part, parts, k, chunks, text) in enumerate(zip(*(b.column(j).to_pylist() for j in (2, 3, 4, 5, 6)))):
            held.append(text)
            if k < chunks - 1:
                continue
            pieces = stitched(held, chunk) if chunks > 1 else _pattern().findall(text)
            tokens = [known.get(p) or ids_of(p) for p in pieces]
            held = []
            at.append(i)
            ids.append([x for t in tokens for x in t])
            if parts == 1:
                edges.append(([], [], [], []))
                continue
            place = list(accumulate(map(len, pieces), initial=0))
            count = list(accumulate(map(len, tokens), initial=0))
            lo, hi = bisect_left(place, edge if part else 0), bisect_left(place, span if part < parts - 1 else place[-1] + 1)
            stop = bisect_left(place, place[-1] - UNSURE)
            edges.append((place[:lo], count[:lo], [x - span for x in place[hi:stop]], count[hi:stop]))
        own = pa.array(at, pa.int64())
        yield pa.RecordBatch.from_arrays([*[b.column(j).take(own) for j in range(4)], _lists(ids), *[_lists([e[j] for e in edges]) for j in range(4)]], ["key", "row", "part", "parts", "ids", "head", "head_ids", "tail", "tail_ids"])


def text_chunks(df: DataFrame, key: str, text: str, chunk: int = CHUNK, overlap: int = OVERLAP, span: int = SPAN, edge: int = EDGE, spread: bool = True) -> DataFrame:
    """``key, row, part, parts, k, chunks, text``: the overlapping chunks of every text, also of empty and null ones (one empty chunk).

    Texts longer than ``span`` are cut into parts first, which go to tasks of their own (``spread``).
    """
    rows = df.select(F.col(key).alias("key"), F.monotonically_increasing_id().alias("row"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    fields = f"key {kind}, row bigint, part int, parts int"
    chunks = f"{fields}, k int, chunks int, text string"
    if not spread:
        return rows.mapInArrow(lambda it: _chunks(_parts(it, span, edge), chunk, overlap), chunks)
    parts = rows.mapInArrow(lambda it: _parts(it, span, edge), f"{fields}, text string")
    return parts.repartition(partitions(df.sparkSession), "row", "part").mapInArrow(lambda it: _chunks(it, chunk, overlap), chunks)


def encode(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY, chunk: int = CHUNK, overlap: int = OVERLAP, span: int = SPAN, edge: int = EDGE) -> DataFrame:
    """Token ids of every text: ``key, ids``; an empty list for empty and null texts.

    Each row gives one row, also for null and repeated keys. Special tokens'
    names in a text are ordinary text. Every text, however short or long, is
    cut into overlapping chunks; each chunk is pre-tokenised alone; neighbours
    are stitched where their boundaries agree; then the pieces are encoded.
    Where the chunks are worked on depends on the length: those of a text up
    to ``span`` characters stay in the task that read it, so that a corpus of
    ordinary texts is not shuffled; longer texts go to many tasks part by
    part, and their parts are stitched in the same way at the boundaries of
    their shared edges. A text in which two parts share none (a pre-token
    longer than ``edge``) is one part.
    """
    sent = df.sparkSession.sparkContext.broadcast(_read(vocabulary))
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    fields = f"key {kind}, row bigint, part int, parts int, ids array<int>, head array<int>, head_ids array<int>, tail array<int>, tail_ids array<int>"

    def encoded(d: DataFrame, span: int, spread: bool) -> DataFrame:
        return text_chunks(d, "key", "text", chunk, overlap, span, edge, spread).mapInArrow(lambda it: _encode(it, sent, chunk, span, edge), fields)

    long = F.coalesce(F.length("text") > span, F.lit(False))
    short = encoded(rows.where(~long), span, False).select("key", "ids")
    if not rows.where(long).limit(1).count():
        return short
    by = Window.partitionBy("row").orderBy("part")
    meet = F.array_min(F.array_intersect("tail", F.lead("head").over(by)))
    # A number of its own tells long rows apart, also those of one key or of none.
    big = persisted(rows.where(long).select("key", F.monotonically_increasing_id().alias("no"), "text"), "long")
    own = big.select(F.struct("key", "no").alias("key"), "text")
    row = f"struct<key:{kind},no:bigint>"
    fields = fields.replace(f"key {kind}", f"key {row}", 1)
    parts = encoded(own, span, True).withColumn("to", meet).withColumn("from", F.lag("to").over(by))
    parts = parts.withColumn("failed", (F.col("part") < F.col("parts") - 1) & F.col("to").isNull())
    begin = F.when(F.col("part") > 0, F.element_at("head_ids", F.array_position("head", F.col("from")).cast("int"))).otherwise(0)
    stop = F.when(F.col("part") < F.col("parts") - 1, F.element_at("tail_ids", F.array_position("tail", F.col("to")).cast("int"))).otherwise(F.size("ids"))
    good = F.max("failed").over(Window.partitionBy("row")) == False  # noqa: E712
    cut = parts.withColumn("good", good).withColumn("ids", F.when(F.col("good"), F.slice("ids", begin + 1, stop - begin)))
    joined = cut.groupBy("key").agg(F.min("good").alias("good"), F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("part", "ids"))), lambda x: x["ids"])).alias("ids"))
    joined = persisted(joined, "joined")
    failed = own.join(joined.where("not good").select("key"), "key", "left_semi")
    whole = encoded(failed, 1 << 31, False)
    return short.unionByName(joined.where("good").select("key.key", "ids")).unionByName(whole.select("key.key", "ids"))


def _decode(batches: Iterator[pa.RecordBatch], vocabulary) -> Iterator[pa.RecordBatch]:
    enc = _encoding(vocabulary.value)
    for b in batches:
        texts = [None if x is None else b"".join(map(enc.decode_single_token_bytes, x)).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["key", "text"])


def decode(df: DataFrame, key: str, ids: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``key, text``: the tokens' raw bytes, concatenated; a null list gives null, an empty one an empty text."""
    kind = df.schema[key].dataType.simpleString()
    sent = df.sparkSession.sparkContext.broadcast(_read(vocabulary))
    return df.select(F.col(key).alias("key"), F.col(ids).cast("array<int>").alias("ids")).mapInArrow(lambda it: _decode(it, sent), f"key {kind}, text string")


def p8_ids(spark, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), "doc_id", "text").select(F.col("key").alias("doc_id"), "ids")


def p8_round_trip(spark, sf_dir: str) -> DataFrame:
    """Whether the decoded ids are the text again (null texts as empty ones)."""
    d = table(spark, sf_dir, "documents")
    back = decode(encode(d, "doc_id", "text"), "key", "ids").select(F.col("key").alias("doc_id"), F.col("text").alias("again"))
    return d.join(back, "doc_id").select("doc_id", (F.coalesce("text", F.lit("")) == F.col("again")).cast("int").alias("same"))


def p8_chunks(spark, sf_dir: str) -> DataFrame:
    """Chunks of each document."""
    c = text_chunks(table(spark, sf_dir, "documents"), "doc_id", "text", spread=False).where(F.col("k") < SPAN // CHUNK)
    return c.groupBy(F.col("key").alias("doc_id")).agg(F.count("*").alias("n_chunks"))


SQL = {
    "p8_round_trip": "SELECT doc_id, 1 AS same FROM documents",
    "p8_chunks": f"SELECT doc_id, greatest(1, (coalesce(length(text), 0) + {CHUNK - 1}) // {CHUNK}) AS n_chunks FROM documents",
}
QUERIES = {"p8_ids": p8_ids, "p8_round_trip": p8_round_trip, "p8_chunks": p8_chunks}
