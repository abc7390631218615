"""String similarity: the normalised insert-delete ratio, Jaro-Winkler, best-window and token ratios.

Spark has none of these built in. The plain functions work on Python strings; the Arrow functions remember the pairs
of their batches, so that a pair of names costs once however many invoices share it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits: one addition for each character of b."""
    at: dict[str, int] = {}
    for i, ch in enumerate(a):
        at[ch] = at.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & at.get(ch, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """Twice the common subsequence over both lengths; 1 for two empty strings."""
    return 2 * common_subsequence(a, b) / (len(a) + len(b)) if a or b else 1.0


def jaro(a: str, b: str) -> float:
    """Jaro similarity; 1 for two empty strings."""
    if not a or not b:
        return float(a == b)
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used = [False] * len(b)
    left = []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == ch:
                used[j] = True
                left.append(ch)
                break
    m = len(left)
    if not m:
        return 0.0
    moved = sum(x != y for x, y in zip(left, (ch for ch, u in zip(b, used, strict=True) if u), strict=True)) // 2
    return (m / len(a) + m / len(b) + (m - moved) / m) / 3


def jaro_winkler(a: str, b: str) -> float:
    """Jaro, raised for a shared beginning of up to 4 characters where it is above 0.7."""
    base = jaro(a, b)
    if base <= 0.7:
        return base
    shared = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        shared += 1
    return base + shared * 0.1 * (1 - base)


def partial_ratio(a: str, b: str, least: float = 0.0) -> float:
    """Best ratio of the shorter string with a stretch of the longer one of its length, or a shorter one at an end. What
    cannot reach `least` may be 0."""
    if not a or not b:
        return float(a == b)
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    m, n = len(short), len(long)
    if short in long:
        return 1.0
    if 2 * (m - 1) / (2 * m - 1) < least:  # a character is missing, or the stretch is shorter
        return 0.0
    stretches = [long[i : i + m] for i in range(n - m + 1)] + [long[:k] for k in range(1, m)] + [long[n - k :] for k in range(1, m)]
    best = max(ratio(short, s) for s in stretches)
    if m == n and best < 1:
        best = max(best, *(ratio(long, s) for k in range(1, m) for s in (short[:k], short[m - k :])), 0.0)
    return best


def token_ratio(a: str, b: str) -> float:
    """Best of: the ratio of the sorted words, and the ratios with the shared words in front."""
    left, right = a.split(), b.split()
    sort = ratio(" ".join(sorted(left)), " ".join(sorted(right)))
    both = sorted({*left} & {*right})
    only_left, only_right = sorted({*left} - {*right}), sorted({*right} - {*left})
    if both and not (only_left and only_right):
        return 1.0
    one, other = " ".join(both + only_left), " ".join(both + only_right)
    shared = " ".join(both)
    return max(sort, ratio(one, other), *((ratio(shared, one), ratio(shared, other)) if both else ()))


def partial_token_ratio(a: str, b: str) -> float:
    """As token_ratio, by partial ratios: 1 as soon as a word is shared."""
    left, right = a.split(), b.split()
    if {*left} & {*right}:
        return 1.0
    return max(partial_ratio(" ".join(sorted(left)), " ".join(sorted(right))), partial_ratio(" ".join(sorted({*left})), " ".join(sorted({*right}))))


def weighted_ratio(a: str, b: str, least: float = 0.0) -> float:
    """The best of several ratios, those of words and of parts scaled down; parts count where lengths differ much.
    Measures that cannot reach `least` may be left out."""
    if not a or not b:
        return 0.0
    apart = max(len(a), len(b)) / min(len(a), len(b))
    best = ratio(a, b)
    if apart < 1.5:
        return max(best, 0.95 * token_ratio(a, b)) if 0.95 >= max(best, least) else best
    scale = 0.9 if apart <= 8 else 0.6
    if {*a.split()} & {*b.split()}:
        best = max(best, 0.95 * scale)
    elif 0.95 * scale >= max(best, least):
        best = max(best, 0.95 * scale * partial_token_ratio(a, b))
    return max(best, scale * partial_ratio(a, b)) if scale >= max(best, least) else best


def _counts(names: list[str], letters: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(letters, how often each name has each); white space of any kind is one letter. letters: only these."""
    flat = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    kinds = np.unique(flat)
    flat[np.isin(flat, [k for k in kinds.tolist() if chr(k).isspace()])] = 32
    letters = np.unique(flat) if letters is None else letters
    if not len(letters):
        return letters, np.zeros((len(names), 0), np.int64)
    row = np.repeat(np.arange(len(names)), [len(n) for n in names])
    at = np.minimum(np.searchsorted(letters, flat), len(letters) - 1)
    known = letters[at] == flat
    return letters, np.bincount(row[known] * len(letters) + at[known], minlength=len(names) * len(letters)).reshape(len(names), len(letters))


class Choices:
    """Known names, ready to be searched by many names at once: shared characters, counted by one matrix product, and
    shared words bound every measure from above, so few names are compared."""

    #: Names of one product, and columns up to which counts are written out in ones.
    AT_ONCE, COLUMNS = 256, 4096

    def __init__(self, names: list[str]):
        self.names = names
        self.letters, self.counts = _counts(names)
        self.size = np.array([len(n) for n in names], np.float32)
        most = self.counts.max(0, initial=0)
        self.column = np.repeat(np.arange(len(self.letters)), most)
        self.level = np.arange(len(self.column)) - np.repeat(np.cumsum(most) - most, most) + 1
        self.wide = len(self.column) > self.COLUMNS
        self.ones = None if self.wide else self._ones(self.counts).T.copy()
        holders: dict[str, list[int]] = {}
        for i, n in enumerate(names):
            for w in {*n.split()}:
                holders.setdefault(w, []).append(i)
        self.holding = {w: np.array(at) for w, at in holders.items()}
        self.spread = self._spread(names)

    def _ones(self, counts: np.ndarray) -> np.ndarray:
        return (counts[:, self.column] >= self.level).astype(np.float32)

    @staticmethod
    def _spread(names: list[str]) -> np.ndarray:
        """The lengths of the names with each word once, plus 1."""
        return np.array([sum(len(w) + 1 for w in {*n.split()}) for n in names], np.float32)

    def _shared(self, names: list[str]) -> np.ndarray:
        """Characters that each of the names shares at most with each known one."""
        counts = _counts(names, self.letters)[1]
        if self.wide:
            return np.array([np.minimum(self.counts, c).sum(1) for c in counts], np.float32)
        return self._ones(counts) @ self.ones

    def _words(self, names: list[str]) -> np.ndarray:
        """The lengths of the words that each of the names shares with each known one, plus 1 for each."""
        out = np.zeros((len(names), len(self.names)), np.float32)
        for i, n in enumerate(names):
            for w in {*n.split()}:
                if w in self.holding:
                    out[i, self.holding[w]] += len(w) + 1
        return out

    def _best(self, bound: np.ndarray, least: float, score: Callable[[int, float], float]) -> tuple[float | None, int]:
        """(score, place) of the best at or above least, the first of equals: highest bounds first, until none is above."""
        best, at = least, -1
        places = np.flatnonzero(bound >= least - 1e-5)
        for i in places[np.argsort(-bound[places], kind="stable")].tolist():
            if bound[i] < best - 1e-5:
                break
            x = score(i, best)
            if x > best or (x == best and (at < 0 or i < at)):
                best, at = x, i
        return (best, at) if at >= 0 else (None, -1)

    def _bounds(self, names: list[str], kind: str, shortest: int = 0, least_sought: float = 0.0) -> np.ndarray:
        shared, own = self._shared(names), np.array([len(n) for n in names], np.float32)[:, None]
        both = own + self.size
        if kind == "ratio":
            return np.where(both > 0, 2 * shared / np.maximum(both, 1), 1)
        short = np.minimum(own, self.size)
        if kind == "part":
            return np.where(self.size >= shortest, 2 * shared / np.maximum(short + shared, 1), -1)
        long, words, mine = both - short, self._words(names), self._spread(names)[:, None]
        least = np.minimum(mine, self.spread)
        token = np.maximum(2 * shared / np.maximum(mine + self.spread - 2, 1), np.where(words > 0, 2 * (words - 1) / np.maximum(words + least - 2, 1), 0))
        token = np.where((words > 0) & (words >= least), 1, np.minimum(token, 1))
        near = np.maximum(2 * shared / np.maximum(both, 1), 0.95 * token)
        if least_sought > 0.9 + 1e-4:  # out of reach where lengths differ much
            return np.where((short > 0) & (long < 1.5 * short), near, -1)
        scale = np.where(long <= 8 * short, np.float32(0.9), np.float32(0.6))
        once = np.minimum(short, least - 1)  # words that come again count once
        far = scale * np.maximum(np.minimum(2 * (shared + 1) / np.maximum(once + shared + 1, 1), 1), np.where(words > 0, np.float32(0.95), 0))
        return np.where(short > 0, np.where(long < 1.5 * short, near, far), -1)

    def search(self, names: list[str], kind: str, least: list[float], shortest: int = 0) -> list[tuple[float | None, int]]:
        """For each name (score, place) of the best known name at or above its least, the first of equals. kind: "ratio",
        "part" (partial ratios, among known names of at least `shortest` characters) or "weight" (weighted ratios)."""
        out = []
        for at in range(0, len(names), self.AT_ONCE):
            part = names[at : at + self.AT_ONCE]
            for name, bound, low in zip(part, self._bounds(part, kind, shortest, min(least[at : at + self.AT_ONCE])), least[at:], strict=False):
                if kind == "weight":
                    out.append(self._best(bound, low, lambda i, best, n=name: weighted_ratio(n, self.names[i], best)))
                elif kind == "part":
                    out.append(self._best(bound, low, lambda i, best, n=name: partial_ratio(n, self.names[i], best)))
                else:
                    out.append(self._best(bound, low, lambda i, _, n=name: ratio(n, self.names[i])))
        return out

    def by_ratio(self, name: str, least: float) -> tuple[float | None, int]:
        return self.search([name], "ratio", [least])[0]

    def by_part(self, name: str, least: float, shortest: int) -> tuple[float | None, int]:
        return self.search([name], "part", [least], shortest)[0]

    def by_weight(self, name: str, least: float) -> tuple[float | None, int]:
        return self.search([name], "weight", [least])[0]


def by_batch(f: Callable[[str, str], float]):
    """f as an Arrow function of two string columns; a null on either side gives null."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known = lru_cache(200_000)(f)
        for a, b in batches:
            yield pd.Series([None if x is None or y is None else known(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True)], dtype="float64")

    return scored


def pair_similarity(id_a, id_b, name_a, name_b):
    """(id_ratio, name_ratio, name_jw) of a pair in one pass over Arrow batches; an empty name has 0 with any other."""

    @F.pandas_udf("id_ratio double, name_ratio double, name_jw double")
    def scored(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        numbers, names = lru_cache(100_000)(ratio), lru_cache(100_000)(lambda x, y: (ratio(x, y), jaro_winkler(x, y)))
        for a, b, n, m in batches:
            rows = [(numbers(w, x), *(names(y, z) if y and z else (0.0, 0.0))) for w, x, y, z in zip(a.tolist(), b.tolist(), n.tolist(), m.tolist(), strict=True)]
            yield pd.DataFrame(rows, columns=["id_ratio", "name_ratio", "name_jw"])

    return scored(id_a, id_b, name_a, name_b)
