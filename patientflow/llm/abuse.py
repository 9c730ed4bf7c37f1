"""Abusive, hateful or sexual content by FTRL-proximal logistic regression (problem 10)."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..plans.runtime import table
from ..plans.skew import broadcast_if_small
from .ngrams import distinct

#: Hashed features; the broadcast weights never exceed 8 bytes for each.
BITS = 20
#: Labelled documents that the classifier is fitted on at most, in the order of a hash of their key.
MOST_LABELLED = 60_000
#: Words of a window and from one window to the next: a text is as abusive as its worst window.
WINDOW, STRIDE = 10, 5
ROUNDS, EPOCHS, BATCH = 4, 3, 64
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.3, 0.5
THRESHOLD = 0.4
#: Log-odds of a window without any telling feature, at most: abuse is rare, however few the labels.
PRIOR = -1.5
#: A label that the other half's model gives less probability than this is not learnt from.
DOUBT = 0.1

# Letters of other scripts that look like Latin ones, and digits and signs written for letters.
ALIKE = dict(zip("аеіоросухѕјԁһкмтвнгпαβεικνορτυχ", "aeiopocyxsjdhkmtbnrnabeiknoptux"))
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}


@functools.lru_cache(maxsize=1)
def _patterns():
    import re

    import regex

    return (
        regex.compile(r"[\p{Cf}\p{Mn}]+"),
        re.compile(r"(?<!\w)[^\W_](?:[ .\-_·][^\W_]){3,}(?!\w)"),
        re.compile(r"(?<=\w)['’](?=\w)"),
        regex.compile(r"[\w@$*]+|[\"'“”„«»‘’`>]|(?<=[.!?…])\s+|[\r\n]+|\x00"),
        re.compile(r"^(?=.*[a-z])(?=.*[0-9@$])[a-z0-9@$]+$"),
    )


def _word(w: str) -> str:
    """The key of a word that survives doubled, swapped, hidden and replaced letters."""
    if not any(c.isalpha() for c in w):
        if any(c.isdigit() for c in w):
            return "0"
        return "<q>" if w in "\"'“”„«»‘’`" else "<gt>" if w == ">" else "*"
    if "_" in w:
        return "<id>"
    if any(ord(c) > 0x36F for c in w) and any("a" <= c <= "z" for c in w):
        w = "".join(ALIKE.get(c, c) for c in w)
    if _patterns()[4].match(w):
        w = "".join(LEET.get(c, c) for c in w)
    core = w.strip("*@$")
    if "*" in core:
        return f"{core[0]}*{core[-1]}"
    w = core or w
    return w if len(w) < 4 else w[0] + "".join(sorted(set(w)))


def _code(word: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))


#: Between two texts of a batch.
_BETWEEN = "\n\x00\n"


class _Words:
    """Numbers of the spellings met so far: 0 ends a sentence, 1 a text; ``codes`` are the words' keys."""

    def __init__(self):
        self.number: dict[str, int] = {"\x00": 1}
        self.codes: list[int] = [0, 0]

    def of(self, found: list[str]) -> np.ndarray:
        get = self.number.get
        out = list(map(get, found))
        if None in out:
            for i, x in enumerate(out):
                if x is None:
                    w = found[i]
                    if (k := get(w)) is None:
                        if w.isspace():
                            k = 0
                        else:
                            k = len(self.codes)
                            self.codes.append(_code(_word(w)))
                        self.number[w] = k
                    out[i] = k
        return np.array(out, np.int64)


_known = _Words()


def sentences(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all words, and each sentence's number of words and text; all texts are read in one go."""
    global _known
    drop, spaced, inner, words, _ = _patterns()
    whole = _BETWEEN.join((t or "").replace("\x00", "\x01") for t in texts)
    if not whole.isascii():
        whole = drop.sub("", unicodedata.normalize("NFKD", whole))
    whole = inner.sub("", whole.lower())
    whole = spaced.sub(lambda m: "".join(c for c in m.group() if c.isalnum()), whole)
    if len(_known.codes) > 400_000:
        _known = _Words()
    number = _known.of(words.findall(whole))
    text = np.cumsum(number == 1)
    sentence = np.cumsum(number < 2)
    own = number > 1
    _, first, size = np.unique(sentence[own], return_index=True, return_counts=True)
    return np.array(_known.codes, np.uint64)[number[own]], size, text[own][first]


def _per_sentence(size: np.ndarray) -> np.ndarray:
    """Windows of sentences of these sizes: of WINDOW words, one every STRIDE words."""
    return np.maximum(1, -(-(size - WINDOW + STRIDE) // STRIDE))


def windows(text: str | None) -> list[list[int]]:
    """Codes of the words of each window of a text."""
    codes, size, _ = sentences([text])
    out, at = [], 0
    for n, k in zip(size.tolist(), _per_sentence(size).tolist()):
        w = codes[at : at + n].tolist()
        out += [w[i * STRIDE : i * STRIDE + WINDOW] for i in range(k)]
        at += n
    return out


_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def grams(codes: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed uni-, bi- and trigrams and skip-bigrams (one or two words left out) of sentences: first word, words from it to the last, feature."""
    sentence = np.repeat(np.arange(len(size)), size)
    at, far, keys = [np.arange(len(codes))], [np.zeros(len(codes), np.int64)], [codes * _A]

    def add(gap: int, key) -> None:
        same = np.flatnonzero(sentence[gap:] == sentence[: len(sentence) - gap])
        at.append(same)
        far.append(np.full(len(same), gap))
        keys.append(key(same))

    pair = lambda gap, salt: lambda i: ((codes[i] * _A + np.uint64(salt)) ^ (codes[i + gap] >> np.uint64(7))) * _B
    for gap in (1, 2, 3):
        add(gap, pair(gap, gap))
    add(2, lambda i: (((codes[i] * _A + np.uint64(5)) ^ (codes[i + 1] >> np.uint64(7))) * _B + codes[i + 2]) * _A)
    return np.concatenate(at), np.concatenate(far), (np.concatenate(keys) >> np.uint64(64 - BITS)).astype(np.int64)


def in_windows(size: np.ndarray, at: np.ndarray, far: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, feature), distinct and sorted, of grams: every window that holds all words of the gram."""
    number = _per_sentence(size)
    sentence = np.repeat(np.arange(len(size)), size)[at]
    place = at - np.concatenate([[0], np.cumsum(size)])[sentence]
    low = np.maximum(0, -(-(place + far - WINDOW + 1) // STRIDE))
    high = np.minimum(place // STRIDE, number[sentence] - 1)
    n = np.maximum(0, high - low + 1)
    first = np.concatenate([[0], np.cumsum(number)])[sentence] + low
    window = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    both = distinct((window << BITS) | np.repeat(feature, n))
    return (both >> BITS).astype(np.int32), (both & ((1 << BITS) - 1)).astype(np.int32)


class Model:
    """FTRL-proximal: per-coordinate rates from summed squared gradients; L1 keeps most weights at zero."""

    def __init__(self):
        self.z, self.n, self.bias = np.zeros(1 << BITS), np.zeros(1 << BITS), [0.0, 0.0]

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def intercept(self) -> float:
        z, n = self.bias
        return -z / ((BETA + n**0.5) / ALPHA + L2)

    def fit(self, window: np.ndarray, feature: np.ndarray, y: np.ndarray, weight: np.ndarray, order: np.ndarray) -> None:
        """One pass over the windows in the given order, in small batches."""
        start = np.searchsorted(window, np.arange(len(y) + 1))
        for i in range(0, len(order), BATCH):
            w = order[i : i + BATCH]
            count = start[w + 1] - start[w]
            place = np.repeat(start[w] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            own = np.repeat(np.arange(len(w)), count)
            at, inv = np.unique(feature[place], return_inverse=True)
            wt = self.weights(at)
            p = probability(np.bincount(own, wt[inv], len(w)) + self.intercept())
            err = (p - y[w]) * weight[w]
            g = np.bincount(inv, err[own], len(at))
            sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
            self.z[at] += g - sigma * wt
            self.n[at] += g * g
            b = float(err.sum())
            s = ((self.bias[1] + b * b) ** 0.5 - self.bias[1] ** 0.5) / ALPHA
            self.bias[0] += b - s * self.intercept()
            self.bias[1] += b * b


def probability(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit(texts: list[str], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights (feature numbers, values, intercept) from labelled texts.

    The label belongs to the text, the abuse to one of its windows: the first
    round spreads a text's label over its windows, each later round takes
    the window that the round before found worst as the abusive one of a flagged
    text and gives the text's other windows no weight. Each half of the texts
    is judged by a model of the other half; labels that it clearly contradicts
    (wrong judgments) are given no weight, unless that were most of the flagged ones. Deterministic.
    """
    codes, size, text = sentences(texts)
    doc = np.repeat(text, _per_sentence(size))
    if not len(doc) or not labels.any() or labels.all():
        return np.empty(0, np.int64), np.empty(0), -35.0 if not labels.any() else PRIOR
    window, feature = in_windows(size, *grams(codes, size))
    n = len(texts)
    mine = labels[doc] > 0
    y = mine.astype(float)
    weight = np.where(mine, 1 / np.bincount(doc, minlength=n)[doc], 1.0)
    rng = np.random.default_rng(0)
    half = np.arange(n) % 2

    def passes(use: np.ndarray) -> Model:
        model = Model()
        for _ in range(EPOCHS):
            model.fit(window, feature, y, weight, rng.permutation(np.flatnonzero(use & (weight > 0))))
        return model

    for k in range(ROUNDS):
        p = np.zeros(len(doc))
        for h in (0, 1):  # each half is judged by the other half's model
            model = passes(half[doc] != h)
            own = probability(np.bincount(window, model.weights()[feature], len(doc)) + model.intercept())
            p[half[doc] == h] = own[half[doc] == h]
        order = np.lexsort([-p, doc])
        first = order[np.flatnonzero(np.diff(doc[order], prepend=-1))]
        top = np.zeros(n)
        top[doc[first]] = p[first]
        worst = np.zeros(len(doc), bool)
        worst[first] = True
        doubtful = np.where(labels > 0, top < DOUBT, top > 1 - DOUBT)
        if k < ROUNDS - 1 or doubtful[labels > 0].mean() > 0.5:  # not settled, or too few labels for the halves to judge each other
            doubtful[:] = False
        weight = np.where(doubtful[doc], 0.0, np.where(mine, worst.astype(float), 1.0))
    model = passes(np.ones(len(doc), bool))
    w = model.weights()
    at = np.flatnonzero(w)
    return at, w[at], min(model.intercept(), PRIOR)


def score(texts: list[str | None], weights: np.ndarray, intercept: float) -> np.ndarray:
    """Probability of each text's worst window; 0 for texts without words. Grams without a weight are left out before their windows are looked up."""
    codes, size, text = sentences(texts)
    out = np.zeros(len(texts))
    if len(size):
        at, far, feature = grams(codes, size)
        told = np.flatnonzero(weights[feature])
        window, feature = in_windows(size, at[told], far[told], feature[told])
        doc = np.repeat(text, _per_sentence(size))
        p = probability(np.bincount(window, weights[feature], len(doc)) + intercept)
        first = np.flatnonzero(np.diff(doc, prepend=-1))
        out[doc[first]] = np.maximum.reduceat(p, first)
    return out


def _dense(at: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << BITS)
    out[at] = values
    return out


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = sorted((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))), key=lambda r: (r[0], r[1] or ""))
    at, values, intercept = fit([r[1] for r in rows], np.array([r[2] for r in rows], float))
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(values, intercept))], ["feature", "weight"])


def train(documents: DataFrame, key: str, text: str, labels: DataFrame, flag: str, most: int = MOST_LABELLED) -> DataFrame:
    """The model as rows ``feature, weight`` (feature -1: the intercept), at most 2^BITS + 1 of them.

    A document's judgments are averaged; null judgments and documents judged
    half and half are left out, as are keys without text. Fitting takes at most ``most``
    labelled documents, in one task. Without any label nothing is flagged.
    """
    y = labels.where(f"{flag} is not null and {key} is not null").groupBy(key).agg(F.avg(flag).alias("y")).where("y <> 0.5")
    rows = documents.select(key, text).join(broadcast_if_small(y), key)
    sample = rows.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"), F.when(F.col("y") > 0.5, 1.0).otherwise(0.0).alias("y")).orderBy(F.xxhash64("key"), "key", "text").limit(most)
    return sample.coalesce(1).mapInArrow(_fit, "feature bigint, weight double")


def _score(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    """Adds the score of the text, the last column, which is left out."""
    at, values, intercept = model.value
    weights = _dense(at, values)
    for b in batches:
        last = b.num_columns - 1
        yield pa.RecordBatch.from_arrays([*b.columns[:last], pa.array(score(b.column(last).to_pylist(), weights, intercept))], [*b.schema.names[:last], "score"])


def scores(documents: DataFrame, key: str, text: str, model: DataFrame, also: dict[str, F.Column] | None = None) -> DataFrame:
    """``key, score`` of every document, by the whole text, and the columns of ``also``; null, empty and wordless texts score 0; repeated keys each stand."""
    spark = documents.sparkSession
    rows = {r[0]: r[1] for r in model.collect()}
    intercept = rows.pop(-1, -35.0)
    sent = spark.sparkContext.broadcast((np.array(list(rows), np.int64), np.array(list(rows.values())), intercept))
    d = documents.select(F.col(key).alias("key"), *[c.alias(n) for n, c in (also or {}).items()], F.col(text).alias("text"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in d.schema.fields[:-1])
    return d.mapInArrow(lambda it: _score(it, sent), f"{fields}, score double")


def source_name(c: str = "source") -> F.Column:
    """Sources in one spelling: lower case, without blanks and a leading www."""
    return F.regexp_replace(F.lower(F.btrim(c, F.lit(" \t\n\r"))), r"^www\.", "")


def _scored(spark, sf_dir: str, also: dict[str, F.Column] | None = None) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return scores(d, "doc_id", "text", train(d, "doc_id", "text", table(spark, sf_dir, "review_labels"), "flagged"), also)


def p10_found(spark, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).where(F.col("score") > THRESHOLD).select(F.col("key").alias("doc_id")).distinct()


def p10_scores(spark, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select(F.col("key").alias("doc_id"), "score")


def p10_rates(spark, sf_dir: str) -> DataFrame:
    """Documents, flagged ones and their rate per source (null: unknown)."""
    s = _scored(spark, sf_dir, {"source": source_name()})
    flagged = (F.col("score") > THRESHOLD).cast("int")
    return s.groupBy("source").agg(F.count("*").alias("n_documents"), F.sum(flagged).alias("n_flagged"), F.avg(flagged).alias("rate"))


QUERIES = {"p10_found": p10_found, "p10_scores": p10_scores, "p10_rates": p10_rates}
SQL: dict[str, str] = {}
