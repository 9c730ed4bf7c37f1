"""Evaluation texts leaking into training text (problem 9)."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..plans.runtime import table
from ..plans.skew import broadcast_if_small

WORDS = 10
#: Characters of test items whose n-grams one broadcast set holds: about 20 bytes a gram in arrays (60 MB) and the block's distinct words. More items are taken in blocks.
BLOCK_CHARS = 16_000_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _regex():
    import regex

    return regex.compile(r"[\p{L}\p{Nd}]+"), regex.compile(r"\p{Cf}+")


def normalised(text: str, strip) -> str:
    """NFKC, without format characters, in lower case."""
    return text.lower() if text.isascii() else strip.sub("", unicodedata.normalize("NFKC", text)).lower()


class TestSet:
    """Hash set of the normalised n-grams of test items, as sorted arrays; ``items`` are (id, text)."""

    def __init__(self, items: list[tuple[int, str]], n: int = WORDS):
        words, strip = _regex()
        self.n, self.words = n, {}
        number = self.words.setdefault
        texts = [np.array([number(x, len(self.words)) for x in words.findall(normalised(text or "", strip))], np.int32) for _, text in items]
        self.flat = np.concatenate([*texts, np.empty(0, np.int32)])
        size = np.array([len(t) for t in texts], np.int64)
        first = np.concatenate([[0], np.cumsum(size)])[:-1] if len(size) else size
        grams = np.maximum(size - n + 1, 0)
        own = np.repeat(np.arange(len(size)), grams)
        place = np.arange(len(own)) - np.repeat(np.cumsum(grams) - grams, grams) + np.repeat(first, grams)
        h = self.hashes(self.flat)[place] if len(place) else np.empty(0, np.uint64)
        order = np.argsort(h, kind="stable")
        #: Of each gram: its hash, where it starts in ``flat``, and its item.
        self.keys, self.place, self.item = h[order], place[order], np.array([i for i, _ in items], np.int64)[own[order]] if len(items) else own

    def hashes(self, codes: np.ndarray) -> np.ndarray:
        """Hash of every window of n codes."""
        m = len(codes) - self.n + 1
        h = np.zeros(max(m, 0), np.uint64)
        for j in range(self.n):
            h = (h + codes[j : j + len(h)].astype(np.uint64) + np.uint64(1)) * _MULTIPLIER
            h ^= h >> np.uint64(29)
        return h

    def windows(self, documents: list[list[str]]) -> list[tuple[int, int, int]]:
        """(document, position, item) of every window whose words were compared with the item's."""
        if not len(self.keys):
            return []
        size = np.fromiter(map(len, documents), np.int64, len(documents))
        get = self.words.get
        codes = np.fromiter((c for d in documents for c in [*(get(w, -1) for w in d), -1]), np.int64, int(size.sum()) + len(documents))
        if len(codes) < self.n:
            return []
        bad = np.concatenate([[0], np.cumsum(codes < 0)])
        whole = np.flatnonzero(bad[self.n :] == bad[: -self.n])  # windows of known words within one document
        if not len(whole):
            return []
        h = self.hashes(codes)[whole]
        low, high = np.searchsorted(self.keys, h, "left"), np.searchsorted(self.keys, h, "right")
        count = high - low
        at = np.repeat(whole, count)
        gram = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
        same = np.ones(len(at), bool)
        for j in range(self.n):
            same &= codes[at + j] == self.flat[self.place[gram] + j]
        at, item = at[same], self.item[gram[same]]
        start = np.concatenate([[0], np.cumsum(size + 1)])
        d = np.searchsorted(start, at, "right") - 1
        return sorted(set(zip(d.tolist(), (at - start[d]).tolist(), item.tolist())))


def _hits(batches: Iterator[pa.RecordBatch], tests) -> Iterator[pa.RecordBatch]:
    """(key, text_hash, text) to (key, text_hash, item, windows, spans as word positions [from, to) merged)."""
    words, strip = _regex()
    for b in batches:
        texts = [words.findall(normalised(t, strip)) if t else [] for t in b.column(2).to_pylist()]
        by: dict[tuple[int, int], list[int]] = {}
        for d, i, item in tests.value.windows(texts):
            by.setdefault((d, item), []).append(i)
        rows, items, n, spans = [], [], [], []
        for (d, item), at in by.items():
            merged: list[list[int]] = []
            for i in sorted(at):
                if merged and i < merged[-1][1]:
                    merged[-1][1] = i + tests.value.n
                else:
                    merged.append([i, i + tests.value.n])
            rows.append(d), items.append(item), n.append(len(at)), spans.append(merged)
        at = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(items, pa.int64()), pa.array(n, pa.int32()), pa.array(spans, pa.list_(pa.list_(pa.int32())))], ["key", "text_hash", "item", "windows", "spans"])


def _blocks(items: DataFrame, item: str, text: str) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size, one at a time on the driver."""
    block, size = [], 0
    for r in items.where(F.col(item).isNotNull() & F.col(text).isNotNull()).select(item, text).toLocalIterator():
        if block and size + len(r[1]) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((r[0], r[1]))
        size += len(r[1])
    yield block


def _rows(documents: DataFrame, key: str, text: str) -> DataFrame:
    return documents.select(F.col(key).alias("key"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))


def leaks(documents: DataFrame, key: str, text: str, items: DataFrame, item: str, item_text: str, n: int = WORDS) -> DataFrame:
    """Every document with every item of which it holds n or more consecutive words: ``key, text_hash, item, windows, spans``.

    text_hash tells the texts of a repeated key apart.

    Words are runs of letters and digits after NFKC, removal of format
    characters and lower-casing. Null and short texts on either side give
    nothing; repeated items of one id count once; items of equal text each
    count. The items' n-grams are a broadcast hash set, bounded by
    ``BLOCK_CHARS`` of item text; more items take another scan of the corpus per block.
    Hits of the hash are verified on the words. Nothing of the corpus is shuffled.
    """
    sc = documents.sparkSession.sparkContext
    kind = documents.schema[key].dataType.simpleString()
    rows = _rows(documents, key, text)
    out = None
    for block in _blocks(items, item, item_text):
        tests = sc.broadcast(TestSet(block, n))
        one = rows.mapInArrow(lambda it, tests=tests: _hits(it, tests), f"key {kind}, text_hash bigint, item bigint, windows int, spans array<array<int>>")
        out = one if out is None else out.unionAll(one)
    return out


def word_places(text: str) -> list[tuple[int, int]] | None:
    """Where each normalised word stands in the text itself, or None if that cannot be told."""
    words, strip = _regex()
    if text.isascii():
        return [m.span() for m in words.finditer(text)]
    import regex

    parts, places = [], []
    for m in regex.finditer(r"\X", text):
        x = normalised(m.group(), strip)
        parts.append(x)
        places += [m.span()] * len(x)
    joined = "".join(parts)
    if joined != normalised(text, strip):
        return None
    return [(places[m.start()][0], places[m.end() - 1][1]) for m in words.finditer(joined)]


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            places = word_places(text) if spans else []
            if spans and places is None:
                out.append(None)
                continue
            kept, at = [], 0
            for i, j in sorted(spans or []):
                start, stop = places[i][0], places[j - 1][1]
                if stop > at:
                    kept.append(text[at : max(at, start)])
                    at = stop
            out.append(None if text is None else "".join(kept) + text[at:])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["key", "text"])


def without_leaks(documents: DataFrame, key: str, text: str, found: DataFrame, whole: bool = False) -> DataFrame:
    """``key, text`` of the corpus without the leaked spans, or (``whole``) without the documents that have any.

    The few leaked documents are looked up in place where their spans are small
    enough to be sent to all tasks. A text whose words cannot be located (its normal form crosses its
    characters) becomes null, as does a null text.
    """
    rows, by = _rows(documents, key, text), ["key", "text_hash"]
    if whole:
        return rows.join(broadcast_if_small(found.select(*by).distinct()), by, "left_anti").select("key", "text")
    spans = broadcast_if_small(found.groupBy(*by).agg(F.flatten(F.collect_list("spans")).alias("spans")))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.join(spans, by, "left").select("key", "text", "spans").mapInArrow(_remove, f"key {kind}, text string")


def _leaks(spark, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "item_text")


def p9_found(spark, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).select(F.col("key").alias("doc_id"), F.col("item").alias("item_id")).distinct()


def p9_items(spark, sf_dir: str) -> DataFrame:
    """Per test item with a leak: documents and windows of ten words."""
    return _leaks(spark, sf_dir).groupBy(F.col("item").alias("item_id")).agg(F.count_distinct("key").alias("n_documents"), F.sum("windows").alias("n_windows"))


def p9_clean(spark, sf_dir: str) -> DataFrame:
    """The corpus without the leaked spans."""
    return without_leaks(table(spark, sf_dir, "documents"), "doc_id", "text", _leaks(spark, sf_dir)).select(F.col("key").alias("doc_id"), "text")


QUERIES = {"p9_found": p9_found, "p9_items": p9_items, "p9_clean": p9_clean}
SQL: dict[str, str] = {}
