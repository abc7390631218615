"""Quality rules from a suffix array over the words of each text.

Prefix doubling sorts the suffixes of many texts at once; only suffixes that still tie with another one of the same
text are sorted again. A stack over the longest common prefixes of neighbours gives their intervals: each is a repeated
substring with all its places, and a maximal one if the words before those places are not all the same. The spans of
maximal repeats are united; the rules limit how much of a text they cover and how long the longest is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, give_back, small_batches, with_column

#: Words that are sorted together; one longer text is sorted alone.
WORDS_AT_ONCE = 200_000
#: Common prefixes up to this length are compared for all pairs at once, longer ones in text order.
_STEPS = 8
#: Words of the windows whose repeats the base rule counts.
WINDOW = 3
_SYMBOLS = re.compile(r"[#*$%&|<>]")
OUT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, covered_chars long, longest_repeat long, covered_fraction double, base_failed boolean, kept boolean"


@dataclass(frozen=True)
class Limits:
    """The method's limits: repeats of min_repeat words or more count; a text fails if they cover more than
    max_covered of its word characters, or if the longest has more than max_longest words."""

    min_repeat: int = 8
    max_covered: float = 0.5
    max_longest: int = 64


def suffix_ranks(s: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The rank of each suffix, each ending with its text; texts stand in the order of doc. s: word numbers from 0."""
    n = len(s)
    order = np.argsort(doc * (int(s.max()) + 1) + s, kind="stable")
    rank = np.empty(n, np.int64)
    new = np.concatenate(([True], (doc[order][1:] != doc[order][:-1]) | (s[order][1:] != s[order][:-1])))
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    tied = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
    h = 1
    while len(tied):
        after = tied + h
        inside = after < n
        inside[inside] = doc[after[inside]] == doc[tied[inside]]
        second = np.where(inside, rank[np.minimum(after, n - 1)] + 1, 0)
        key = rank[tied] * (n + 1) + second
        o = np.argsort(key, kind="stable")
        tied, key = tied[o], key[o]
        old = rank[tied]
        start = np.concatenate(([True], old[1:] != old[:-1]))
        at = np.arange(len(tied))
        within = at - np.maximum.accumulate(np.where(start, at, 0))
        fresh = start | np.concatenate(([True], key[1:] != key[:-1]))
        group = np.maximum.accumulate(np.where(fresh, at, 0))
        rank[tied] = old + within - (at - group)
        size = np.diff(np.concatenate((np.flatnonzero(fresh), [len(tied)])))
        tied = tied[np.repeat(size, size) > 1]
        h *= 2
    return rank


def common_prefixes(s: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp): the suffixes in order, and the words that each shares with the one before it (of its text; else 0)."""
    n = len(s)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(suffix_ranks(s, doc))
    a, b = order[1:], order[:-1]
    end = np.searchsorted(doc, doc, side="right")
    lcp = np.zeros(n, np.int64)  # of suffix i with the one before it in the order
    live = np.flatnonzero(doc[a] == doc[b])
    for step in range(_STEPS):
        x, y = a[live] + step, b[live] + step
        live = live[(x < end[a[live]]) & (y < end[a[live]])]
        live = live[s[a[live] + step] == s[b[live] + step]]
        lcp[a[live]] = step + 1
    if len(live):  # in text order, a common prefix is at most one word shorter than the one a word earlier
        before = dict(zip(a[live].tolist(), b[live].tolist(), strict=True))
        words, last, k = s.tolist(), -2, 0
        for i in sorted(before):
            j, stop = before[i], int(end[i])
            k = max(_STEPS, k - 1) if i == last + 1 else _STEPS
            room = stop - max(i, j)
            while k < room and words[i + k] == words[j + k]:
                k += 1
            lcp[i] = k
            last = i
    return order, lcp[order]


def intervals(lcp: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(intervals, innermost). A row (length, first place, last place, parent) for each interval of equal longest common
    prefix of `least` or more, parent -1 for none; and the number of the innermost one that holds each place, or -1."""
    n = len(lcp)
    length: list[int] = []
    first: list[int] = []
    last: list[int] = []
    parent: list[int] = []
    top_at: dict[int, int] = {}
    stack: list[int] = []
    high = np.flatnonzero(lcp >= least)
    values = lcp[high].tolist()
    before = -2
    for r, value in zip([*high.tolist(), n + 1], [*values, 0], strict=True):
        if r != before + 1:  # the prefixes between are shorter than least: all intervals end
            while stack:
                k = stack.pop()
                last[k], parent[k] = before, stack[-1] if stack else -1
            if r > n:
                break
        left, popped = r - 1, -1
        while stack and length[stack[-1]] > value:
            popped = stack.pop()
            last[popped], left = r - 1, first[popped]
            parent[popped] = stack[-1] if stack else -1
        if not stack or length[stack[-1]] < value:
            length.append(value)
            first.append(left)
            last.append(-1)
            parent.append(-1)
            if popped >= 0:
                parent[popped] = len(length) - 1
            stack.append(len(length) - 1)
        top_at[r] = stack[-1]
        before = r
    inner = np.full(n + 1, -1, np.int64)
    if top_at:
        at, top = np.fromiter(top_at, np.int64), np.fromiter(top_at.values(), np.int64)
        size = np.zeros(n + 1, np.int64)
        inner[at], size[at] = top, lcp[at]
        after = at - 1  # the place before belongs to the interval of this prefix, if that is the longer one
        longer = size[after] < lcp[at]
        inner[after[longer]] = top[longer]
    return np.array([length, first, last, parent], np.int64).T.reshape(-1, 4), inner[:n]


def maximal_repeats(s: np.ndarray, doc: np.ndarray, order: np.ndarray, lcp: np.ndarray, least: int) -> np.ndarray:
    """For each word, the words of the longest maximal repeat of `least` or more that has a place there; else 0."""
    out = np.zeros(len(s), np.int64)
    found, inner = intervals(lcp, least)
    if not len(found):
        return out
    starts = np.concatenate(([True], doc[1:] != doc[:-1]))
    prior = np.where(starts, -1 - np.arange(len(s)), np.concatenate(([0], s[:-1])))[order]  # a text's start is like no other
    turns = np.cumsum(np.concatenate(([0], prior[1:] != prior[:-1])))
    maximal = turns[found[:, 2]] > turns[found[:, 1]]
    reach = np.where(maximal, found[:, 0], 0).tolist()
    up = found[:, 3].tolist()
    # A parent has the shorter prefix: from short to long, what isn't maximal takes over from what it lies in.
    for k in np.argsort(found[:, 0], kind="stable").tolist():
        if not reach[k] and up[k] >= 0:
            reach[k] = reach[up[k]]
    held = inner >= 0
    out[order[held]] = np.array(reach, np.int64)[inner[held]]
    return out


def _cover(length: np.ndarray) -> np.ndarray:
    """Which places lie in [i, i + length[i]) for some i."""
    if not len(length):
        return np.zeros(0, bool)
    reach = np.maximum.accumulate(np.arange(len(length)) + length)
    return reach > np.arange(len(length))


def _measure(texts: list[str], limits: Limits) -> list[tuple]:
    each = [t.encode("utf-8", "surrogatepass").split() for t in texts]
    numbers: dict[bytes, int] = {}
    put = numbers.setdefault
    s = np.fromiter((put(w, len(numbers)) for w in chain.from_iterable(each)), np.int64)
    n = np.array([len(w) for w in each], np.int64)
    doc = np.repeat(np.arange(len(each)), n)
    order, lcp = common_prefixes(s, doc)
    again = np.zeros(len(s), np.int64)  # what each suffix shares with either neighbour
    again[order] = np.maximum(lcp, np.concatenate((lcp[1:], [0]))) if len(s) else lcp
    best = maximal_repeats(s, doc, order, lcp, limits.min_repeat)
    size = np.fromiter((len(w.decode("utf-8", "surrogatepass")) for w in numbers), np.int64, len(numbers))[s] if len(s) else s
    windows, spans = _cover(np.where(again >= WINDOW, WINDOW, 0)), _cover(best)
    starts = np.concatenate(([0], np.cumsum(n)))
    total = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[starts])
    chars, repeats, covered = total(size), total(windows.astype(np.int64)), total(np.where(spans, size, 0))
    out = []
    for i, text in enumerate(texts):
        seen: set[str] = set()
        dup = 0
        if "\n" in text:
            for line in text.split("\n"):
                if line in seen:
                    dup += 1
                elif line.strip("\t\n\x0b\x0c\r "):
                    seen.add(line)
        longest = int(again[starts[i] : starts[i + 1]].max(initial=0))
        share = float(covered[i] / chars[i]) if chars[i] else 0.0
        failed = bool(n[i] < 50 or 100 * repeats[i] > 50 * n[i])
        kept = not failed and share <= limits.max_covered and longest <= limits.max_longest
        out.append((int(n[i]), int(chars[i]), len(_SYMBOLS.findall(text)), dup, int(repeats[i]), int(covered[i]), longest, share, failed, kept))
    return out


def measure(texts: list[str | None], limits: Limits = Limits()) -> list[tuple]:
    """The measures of each text, in the order of OUT. A null text is an empty one."""
    out, some, words = [], [], 0
    for t in texts:
        t = t or ""
        more = len(t) // 4
        if some and words + more > WORDS_AT_ONCE:
            out += _measure(some, limits)
            some, words = [], 0
        some.append(t)
        words += more
    return out + (_measure(some, limits) if some else [])


def quality_measures(docs: DataFrame, text: str = "text", limits: Limits = Limits(), out: str = "quality") -> DataFrame:
    """docs with a struct column of the measures of OUT; texts of any length are measured whole.

    A null or empty text has zero in every count and fails the base rule; repeated rows are measured alike; no other
    column is read, and where one is named as out is, out gets underscores behind it. Lines that hold no word are never
    duplicate lines. An empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    names = [f.split()[0] for f in OUT.split(", ")]

    @F.pandas_udf(OUT)
    def measured(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame(measure(s.tolist(), limits), columns=names)
        give_back()

    return with_column(docs, out, measured(F.col(text)))


def keep_good(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The rows of docs that the rules keep."""
    name = free_name(docs.columns, "_quality")
    return quality_measures(docs, limits=limits, out=name).where(F.col(f"{name}.kept")).drop(name)


def op2(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality_measures(docs).select("doc_id", "quality.*")


def quality_base(spark, sf_dir: str) -> DataFrame:
    """What SQL can say of the same measures: all but the method's own."""
    return op2(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


QUALITY_BASE_SQL = r"""
WITH word AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, coalesce(text, '') AS t FROM documents),
win AS (SELECT doc_id, i, list_aggregate(w[i : i + 2], 'string_agg', ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM word)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
held AS (SELECT doc_id, count(DISTINCT i) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS i FROM again) GROUP BY doc_id),
line AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM word) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  coalesce(line.n, 0)::BIGINT AS n_dup_lines, coalesce(held.n, 0)::BIGINT AS n_repeat_words, len(w) < 50 OR 100 * coalesce(held.n, 0) > 50 * len(w) AS base_failed
FROM word LEFT JOIN held USING (doc_id) LEFT JOIN line USING (doc_id)
"""
