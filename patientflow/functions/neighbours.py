"""Exact nearest sets in blocks: an inverted list of each row's rarest items leaves few pairs to be compared."""

from __future__ import annotations

import numpy as np

#: Rows of the first step over a target, which all are compared; each step is STEP times as large as the one before, up to TOKENS items.
SAMPLE, STEP, TOKENS = 256, 16, 3_000_000
#: Words of bits that stand for a row, pairs that are filtered at once, pairs that are held before they are compared.
WORDS, CELLS, HELD = 5, 1 << 16, 400_000


class Rows:
    """Rows as sets of numbers: ``code`` holds them row by row, ascending in each, from ``off`` on."""

    def __init__(self, ids: np.ndarray, age: np.ndarray, off: np.ndarray, code: np.ndarray):
        self.id, self.age, self.off, self.code, self.size = ids, age, off, code, np.diff(off)
        self.row = np.repeat(np.arange(len(ids)), self.size)

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of these rows one after the other, and at which place of ``rows`` each of them belongs."""
        n = self.size[rows]
        at = np.arange(n.sum()) + np.repeat(self.off[rows] - np.cumsum(n) + n, n)
        return self.code[at], np.repeat(np.arange(len(rows)), n)

    def cut(self, i: int, j: int) -> Rows:
        a, b = self.off[i], self.off[j]
        return Rows(self.id[i:j], self.age[i:j], self.off[i : j + 1] - a, self.code[a:b])

    def bits(self, n: int) -> np.ndarray:
        """Words a row, for numbers below n: a bit that all rare ones share in the first, one for each of the 64 commonest in the second, then rare ones shared by more bits."""
        out, back = np.zeros((WORDS, len(self.id)), np.uint64), n - 1 - self.code
        rare = back >= 64
        bit = np.where(rare, 128 + back % (64 * (WORDS - 2)), 64 + back)
        np.bitwise_or.at(out, (bit // 64, self.row), np.uint64(1) << (bit % 64).astype(np.uint64))
        np.bitwise_or.at(out[0], self.row[rare], np.uint64(1) << (back[rare] % 64).astype(np.uint64))
        return out


def joined(parts: list[Rows]) -> Rows:
    off = np.concatenate([[0], np.cumsum(np.concatenate([p.size for p in parts]))])
    return Rows(*[np.concatenate([getattr(p, c) for p in parts]) for c in ("id", "age")], off, np.concatenate([p.code for p in parts]))


def _ranked(source: Rows, target: Rows, n: int) -> list[Rows]:
    """Both with their numbers below n replaced by ranks, rarest in the target first."""
    rank = np.empty(n, np.int64)
    rank[np.argsort(np.bincount(target.code, minlength=n), kind="stable")] = np.arange(n)
    return [Rows(x.id, x.age, x.off, np.sort(x.row * n + rank[x.code]) - x.row * n) for x in (source, target)]


class Nearest:
    """The nearest target row of each source row so far: ``dist`` is (a - b) ** 2 of the ages plus the items that only one of both has, ties to the least id.

    A target row b of a source row a with at most the distance d has gain = 2 |a & b| - |b| >= |a| - d, so
    at most (|b| - gain) / 2 of its items are not in a, and one of its rarest ones is: at place p of b, |b| - 2 p >= gain.
    """

    def __init__(self, source: Rows, other: bool):
        self.source, self.other = source, other
        self.dist, self.match = np.full(len(source.id), np.inf), np.zeros(len(source.id), np.int64)

    def add(self, target: Rows, n: int) -> None:
        """Compares with all rows of the target; numbers of both are below n."""
        plain = self.source
        self.source, target = _ranked(plain, target, n)
        at, size = 0, SAMPLE
        while at < len(target.id):
            most = int(np.searchsorted(target.off, target.off[at] + TOKENS))
            to = min(len(target.id), at + size, max(most, at + 1))
            part = target.cut(at, to)
            self._index(part, n) if at else self._all(part, np.arange(len(self.dist)), n)
            at, size = to, size * STEP
        self.source = plain

    def _offer(self, q: np.ndarray, d: np.ndarray, ids: np.ndarray) -> None:
        o = np.lexsort((ids, d, q))
        o = o[np.flatnonzero(np.diff(q[o], prepend=-1))]
        q, d, ids = q[o], d[o], ids[o]
        better = (d < self.dist[q]) | (d == self.dist[q]) & (ids < self.match[q])
        self.dist[q[better]], self.match[q[better]] = d[better], ids[better]

    def _all(self, t: Rows, rows: np.ndarray, n: int) -> None:
        """These source rows against all target rows, as products of dense matrices."""
        s, step = self.source, max(1, min(2048, (1 << 23) // max(n, 1)))
        for j in range(0, len(t.id), step):
            b = t.cut(j, min(j + step, len(t.id)))
            used, c = np.unique(b.code, return_inverse=True)
            y = np.zeros((len(used), len(b.id)), np.float32)
            y[c, b.row] = 1
            at = np.full(n, -1)
            at[used] = np.arange(len(used))
            for i in range(0, len(rows), step):
                q = rows[i : i + step]
                c, r = s.of(q)
                x, both = np.zeros((len(q), len(used)), np.float32), at[c] >= 0
                x[r[both], at[c[both]]] = 1
                d = np.round((s.age[q][:, None] - b.age) ** 2 + (s.size[q][:, None] + b.size - 2 * (x @ y).astype(np.int64)), 9)
                if self.other:
                    d[s.id[q][:, None] == b.id] = np.inf
                low = d.min(1)
                ids = np.where(d == low[:, None], b.id, np.iinfo(np.int64).max).min(1)
                ok = low < np.inf
                self._offer(q[ok], low[ok], ids[ok])

    def _index(self, t: Rows, n: int) -> None:
        s = self.source
        need = np.ceil(s.size - self.dist - 1e-8)
        free = ~(need > 0)  # even a row without a common item may be nearer
        if free.any():
            self._all(t, np.flatnonzero(free), n)
        need = np.where(free, 0, need).astype(np.int64)
        lacks, bits = ~s.bits(n), t.bits(n)
        top = int(t.size.max()) + 1
        # Lists by item, those first whose rows may have the largest gain.
        flat = t.code * (2 * top) + top - (t.size[t.row] - 2 * (np.arange(len(t.code)) - t.off[t.row]))
        o = np.argsort(flat, kind="stable")
        flat, row = flat[o], t.row[o].astype(np.int32)
        rare, common, size = bits[0][row], bits[1][row], t.size[row]
        start = np.searchsorted(flat, np.arange(n) * (2 * top))
        q, code, gain = s.row, s.code, need[s.row]
        # The pair's first common item has at least as many of a's items behind it as they share.
        m = (gain > 0) & (gain < top) & (s.size[q] - (np.arange(len(code)) - s.off[q]) >= gain)
        q, code, gain = q[m], code[m], gain[m]
        stop = np.searchsorted(flat, code * (2 * top) + top - gain, side="right")
        m = stop > start[code]
        q, code, gain, stop = q[m], code[m], gain[m], stop[m]
        o = np.lexsort((gain, code))
        q, code, gain, stop = q[o], code[o], gain[o], stop[o]
        cuts = np.append(np.flatnonzero((np.diff(code, prepend=-1) != 0) | (np.diff(gain, prepend=-1) != 0)), len(code)).tolist()
        held, n_held = [], 0
        for i, j in zip(cuts[:-1], cuts[1:]):
            a, b = int(start[code[i]]), int(stop[i])
            most = np.minimum((size[a:b] - int(gain[i])) >> 1, 255).astype(np.uint8)
            step = max(1, CELLS // (b - a))
            for k in range(i, j, step):
                x = q[k : min(k + step, j)]
                miss = np.bitwise_count(lacks[0][x][:, None] & rare[a:b])
                miss += np.bitwise_count(lacks[1][x][:, None] & common[a:b])
                x_at, y_at = np.nonzero(miss <= most)
                held.append((x[x_at], row[a:b][y_at]))
                n_held += len(x_at)
                if n_held > HELD:
                    self._compare(t, *map(np.concatenate, zip(*held)), lacks, bits, n)
                    held, n_held = [], 0
        if n_held:
            self._compare(t, *map(np.concatenate, zip(*held)), lacks, bits, n)

    def _compare(self, t: Rows, q: np.ndarray, r: np.ndarray, lacks: np.ndarray, bits: np.ndarray, n: int) -> None:
        """Pairs of source and target rows: first once more by bits and by the ages, against the best of now, then item by item."""
        s = self.source
        most = (t.size[r] - s.size[q] + self.dist[q] - (s.age[q] - t.age[r]) ** 2 + 1e-8) / 2
        miss = np.zeros(len(q))
        for w in range(1, WORDS):
            miss = miss + np.bitwise_count(lacks[w][q] & bits[w][r])
            ok = miss <= most
            q, r, miss, most = q[ok], r[ok], miss[ok], most[ok]
        pair = np.unique(q * len(t.id) + r)
        q, r = pair // len(t.id), pair % len(t.id)
        i, rows = 0, max(1, (1 << 25) // n)
        while i < len(q):
            j = min(int(np.searchsorted(q, q[i] + rows)), i + HELD)
            o = i + np.argsort(-t.size[r[i:j]], kind="stable")
            x, y, i = q[o], r[o], j
            own, at = np.unique(x, return_inverse=True)
            has = np.zeros(len(own) * n, bool)
            c, k = s.of(own)
            has[k * n + c] = True
            both, size = np.zeros(len(x), np.int64), t.size[y]
            for p, m in enumerate(np.searchsorted(-size, -np.arange(int(size[0]))).tolist()):  # rows of more than p items come first
                both[:m] += has[at[:m] * n + t.code[t.off[y[:m]] + p]]
            d = np.round((s.age[x] - t.age[y]) ** 2 + (s.size[x] + size - 2 * both), 9)
            ok = d <= self.dist[x]
            if self.other:
                ok &= s.id[x] != t.id[y]
            self._offer(x[ok], d[ok], t.id[y[ok]])
