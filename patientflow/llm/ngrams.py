"""Frequency of every distinct term and n-gram by suffix-sorted counting (problem 1)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..plans.runtime import partitions, persisted, table
from ..plans.skew import salts

BLANKS = " \t\n\r"


def distinct(a: np.ndarray) -> np.ndarray:
    """Sorted distinct numbers; by sorting, which is much faster than hashing here."""
    a = np.sort(a)
    keep = np.ones(len(a), bool)
    keep[1:] = a[1:] != a[:-1]
    return a[keep]


def clean_terms(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Terms of a batch of lists as numbers, their count in each row, and the words: without outer blanks, tabs and line breaks; null and empty elements and null lists give none.

    Each distinct element is cleaned once.
    """
    size = np.diff(lists.offsets.to_numpy())
    size[~lists.is_valid().to_numpy(zero_copy_only=False)] = 0
    coded = lists.flatten().dictionary_encode()
    number: dict[str, int] = {}
    own = np.array([number.setdefault(x, len(number)) if (x := w.strip(BLANKS)) else -1 for w in coded.dictionary.to_pylist()] or [-1], np.int64)
    code = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    code = np.where(code >= 0, own[np.maximum(code, 0)], -1)
    row = np.repeat(np.arange(len(lists)), size)[code >= 0]
    return code[code >= 0], np.bincount(row, minlength=len(lists)), list(number)


def _suffixes(batches: Iterator[pa.RecordBatch], max_n: int) -> Iterator[pa.RecordBatch]:
    """Truncated suffixes of (record, terms) rows, pre-aggregated per batch: one row per suffix with its record set, and that set's size."""
    for b in batches:
        rec = b.column(0)
        if not b.num_rows:
            continue
        code, lengths, words = clean_terms(b.column(1))
        words = pa.array(words, pa.string())
        known = rec.is_valid().to_numpy(zero_copy_only=False)
        ids = rec.fill_null(0).to_numpy()
        row = np.repeat(np.arange(b.num_rows), lengths)
        left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(row))  # terms from here to the end of the row
        cols = [code.astype(np.int32)]
        for j in range(1, max_n):
            c = np.full(len(row), -1, np.int32)
            ok = left > j
            c[ok] = code[np.flatnonzero(ok) + j]
            cols.append(c)
        some = np.flatnonzero(lengths > 0)  # the empty suffix stands once for each row that has a term
        row = np.concatenate([row, some])
        cols = [np.concatenate([c, np.full(len(some), -1, np.int32)]) for c in cols]
        order = np.lexsort([ids[row], known[row], *cols[::-1]])
        row, cols = row[order], [c[order] for c in cols]
        r, k = ids[row], known[row]
        n = len(row)
        if not n:
            continue
        head = np.ones(n, bool)
        head[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
        fresh = head.copy()
        fresh[1:] |= (r[1:] != r[:-1]) | (k[1:] != k[:-1])
        at = np.flatnonzero(head)
        keep = fresh & k  # one per distinct known record of a group
        size = np.add.reduceat(keep.astype(np.int64), at)
        records = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(r[keep]))
        m = np.stack([c[at] for c in cols], 1)
        has = m >= 0
        suffix = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(has.sum(1))]).astype(np.int32)), words.take(pa.array(m[has])) if has.any() else pa.array([], pa.string()))
        first = words.take(pa.array(np.where(m[:, 0] >= 0, m[:, 0], 0))) if len(words) else pa.array([""] * len(at))
        first = pa.compute.if_else(pa.array(m[:, 0] >= 0), first, pa.array([""] * len(at)))
        yield pa.RecordBatch.from_arrays([first, suffix, pa.array(np.diff(np.append(at, n))), pa.array(size), records], ["first", "suffix", "occurrences", "load", "records"])


def _salted(batches: Iterator[pa.RecordBatch], spread: dict[str, int]) -> Iterator[pa.RecordBatch]:
    """(first, suffix, occurrences, records) to (first, salt, suffix, occurrences, records): record sets of the first terms in ``spread`` are split by a hash of the record; the occurrences stay with the first part."""
    for b in batches:
        if not b.num_rows:
            continue
        many = np.array([spread.get(x, 1) for x in b.column(0).to_pylist()])
        lists = b.column(3)
        at, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        flat, at = flat[at[0] : at[-1]], at - at[0]
        row = np.repeat(np.arange(b.num_rows), np.diff(at))
        mixed = (flat.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        salt = (mixed % many[row].astype(np.uint64)).astype(np.int64)
        # Each row has a part of salt 0, for its occurrences, and those that its records need.
        top = int(many.max())
        parts, where = np.unique(np.concatenate([np.arange(b.num_rows) * top, row * top + salt]), return_inverse=True)
        where = where[b.num_rows :]
        order = np.argsort(where, kind="stable")
        size = np.bincount(where, minlength=len(parts))
        own, part = pa.array(parts // top), parts % top
        records = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(flat[order]))
        occurrences = np.where(part == 0, b.column(2).to_numpy()[parts // top], 0)
        yield pa.RecordBatch.from_arrays([b.column(0).take(own), pa.array(part.astype(np.int32)), b.column(1).take(own), pa.array(occurrences), records], ["first", "salt", "suffix", "occurrences", "records"])


def _stack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of all prefixes of reverse-lexicographically sorted suffixes; rows come sorted by (first, salt, suffix desc)."""
    terms: list[str] = []
    counts: list[int] = [0]  # counts[i], sets[i]: of the prefix of i terms
    sets: list[list[np.ndarray]] = [[]]
    group, out = None, []

    def pop() -> None:
        n = counts.pop()
        found = sets.pop()
        one = found[0] if len(found) == 1 else distinct(np.concatenate(found)) if found else np.empty(0, np.int64)
        out.append((list(terms), n, len(one)))
        terms.pop()
        if terms:
            counts[-1] += n
            sets[-1].append(one)

    def flush() -> pa.RecordBatch:
        cols = list(zip(*out))
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.list_(pa.string())), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], ["ngram", "occurrences", "records"])

    def close() -> None:
        while terms:
            pop()
        if counts[0]:
            out.append(([], counts[0], len(distinct(np.concatenate(sets[0]))) if sets[0] else 0))
        counts[:], sets[:] = [0], [[]]

    for b in batches:
        firsts, salts, suffixes, occ = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()
        at, values = b.column(4).offsets.to_numpy(), b.column(4).values.to_numpy()
        for i, s in enumerate(suffixes):
            if (g := (firsts[i], salts[i])) != group:
                close()
                group = g
            lcp, top = 0, min(len(s), len(terms))
            while lcp < top and s[lcp] == terms[lcp]:
                lcp += 1
            while len(terms) > lcp:
                pop()
            for x in s[lcp:]:
                terms.append(x)
                counts.append(0)
                sets.append([])
            counts[-1] += occ[i]
            if at[i + 1] > at[i]:
                sets[-1].append(values[at[i] : at[i + 1]])
        if len(out) > 20_000:
            yield flush()
    close()
    if out:
        yield flush()


def suffix_counts(df: DataFrame, record: str, terms: str, max_n: int = 1) -> DataFrame:
    """Occurrences and distinct records of every n-gram of 1 to ``max_n`` terms: ``ngram, occurrences, records``.

    ``record`` is a bigint, ``terms`` an array of strings whose null and empty
    elements are left out first. The row with the empty n-gram holds the number
    of rows and of distinct records with at least one term. Rows without a
    record count as occurrences only; repeated rows count once per record and
    each as occurrences; null and empty arrays give nothing; other columns are ignored.

    Each batch emits its suffixes, cut to ``max_n`` terms, with their record
    sets (map-side combine). They are routed by first term; only a first term
    whose record sets are more than a task's share is salted, in proportion
    to them, by a hash of the record: a record's rows stay together, so the
    record counts of the salts add up. Sorted in reverse, a stack yields all
    prefix counts in one pass.
    """
    n = partitions(df.sparkSession)
    rows = df.select(F.col(record).cast("bigint").alias("record"), F.col(terms).alias("terms")).where("size(terms) > 0")
    sent = persisted(rows.mapInArrow(lambda it: _suffixes(it, max_n), "first string, suffix array<string>, occurrences bigint, load bigint, records array<bigint>"), "suffixes")
    load = sent.groupBy("first").agg(F.sum("load").alias("load"))
    total = load.agg(F.sum("load")).first()[0] or 0
    heavy = load.where(F.col("load") * n > total).limit(n)  # fewer than n can be
    spread = salts({r[0]: r[1] for r in heavy.collect()}, total, n)
    split = sent.select("first", "suffix", "occurrences", "records").mapInArrow(lambda it: _salted(it, spread), "first string, salt int, suffix array<string>, occurrences bigint, records array<bigint>")
    by = split.repartition(n, "first", "salt").sortWithinPartitions("first", "salt", F.desc("suffix"))
    part = by.mapInArrow(_stack, "ngram array<string>, occurrences bigint, records bigint")
    return part.groupBy("ngram").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


RARE_PERSONS, COMMON_SHARE = 5, 0.6


def marked(counts: DataFrame, rare: int = RARE_PERSONS, common: float = COMMON_SHARE) -> DataFrame:
    """Every n-gram with its counts and a mark: rare (fewer than ``rare`` records), common (more than ``common`` of all records with a term) or null."""
    total = counts.where("size(ngram) = 0").select("records").first()
    limit = common * (total[0] if total else 0)
    mark = F.when(F.col("records") < rare, "rare").when(F.col("records") > limit, "common")
    return counts.where("size(ngram) > 0").select("ngram", F.col("occurrences").alias("n_occurrences"), F.col("records").alias("n_persons"), mark.alias("mark"))


def marked_terms(counts: DataFrame, rare: int = RARE_PERSONS, common: float = COMMON_SHARE) -> DataFrame:
    """:func:`marked` of single terms."""
    return marked(counts, rare, common).where("size(ngram) = 1").select(F.col("ngram")[0].alias("concept_id"), "n_occurrences", "n_persons", "mark")


def _counts(spark, sf_dir: str, max_n: int = 1) -> DataFrame:
    return persisted(suffix_counts(table(spark, sf_dir, "processed_dataset"), "person_id", "concept_ids", max_n), "ngrams")


def p1_found(spark, sf_dir: str) -> DataFrame:
    return marked_terms(_counts(spark, sf_dir)).where("mark is not null").select("concept_id", "mark")


def p1_terms(spark, sf_dir: str) -> DataFrame:
    """Every term with its occurrences (in all rows), persons and mark."""
    return marked_terms(_counts(spark, sf_dir))


def p1_ngrams(spark, sf_dir: str) -> DataFrame:
    """Every run of one to three terms with its occurrences, persons and mark."""
    return marked(_counts(spark, sf_dir, 3)).select(F.array_join("ngram", " ").alias("ngram"), F.size("ngram").alias("n"), "n_occurrences", "n_persons", "mark")


TERMS = """
WITH c AS (SELECT row_number() OVER () AS rn, person_id, [y FOR y IN [trim(x, ' ' || chr(9) || chr(10) || chr(13)) FOR x IN concept_ids] IF y <> ''] AS terms FROM processed_dataset)"""
_MARKED = TERMS + """,
t AS (SELECT person_id, unnest(terms) AS concept_id FROM c),
n AS (SELECT count(DISTINCT person_id) AS total FROM c WHERE len(terms) > 0),
k AS (SELECT concept_id, count(*) AS n_occurrences, count(DISTINCT person_id) AS n_persons FROM t GROUP BY 1),
m AS (SELECT k.*, CASE WHEN n_persons < 5 THEN 'rare' WHEN n_persons > 0.6 * total THEN 'common' END AS mark FROM k, n)
"""
SQL = {
    "p1_found": _MARKED + "SELECT concept_id, mark FROM m WHERE mark IS NOT NULL",
    "p1_terms": _MARKED + "SELECT * FROM m",
    "p1_ngrams": TERMS + """,
i AS (SELECT person_id, terms, unnest(range(1, len(terms) + 1)) AS i FROM c),
g AS (SELECT person_id, terms, i, unnest([1, 2, 3]) AS n FROM i),
t AS (SELECT count(DISTINCT person_id) AS total FROM c WHERE len(terms) > 0),
k AS (SELECT terms[i : i + n - 1] AS gram, n, count(*) AS n_occurrences, count(DISTINCT person_id) AS n_persons FROM g WHERE i + n - 1 <= len(terms) GROUP BY 1, 2)
SELECT array_to_string(gram, ' ') AS ngram, n, n_occurrences, n_persons, CASE WHEN n_persons < 5 THEN 'rare' WHEN n_persons > 0.6 * total THEN 'common' END AS mark FROM k, t""",
}
QUERIES = {"p1_found": p1_found, "p1_terms": p1_terms, "p1_ngrams": p1_ngrams}
