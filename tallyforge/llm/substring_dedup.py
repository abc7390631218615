"""Substring dedup by sliding sentence spans.

Every run of several consecutive sentences is hashed; a shuffle on the hashes finds the runs that occur more than once
and the first place of each, and sentences under any other occurrence are removed. A sentence ends with . ! or ? before
white space, or with its line.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, give_back, small_batches, stash, unstash

#: Sentences of a run, and the words from which a shorter run counts too.
SPAN, LONG_WORDS = 3, 25
#: A run of marks is entered at its first one only and never given back, so that long runs of them take linear time.
_SENTENCE = re.compile(r"[^\n]*?(?<![.!?])[.!?]++(?=[\t\x0b\x0c\r ]|\n|\Z)[\t\x0b\x0c\r \n]*|[^\n]+\n*|\n+", re.S)
_SPAN_SCHEMA = "doc_id long, text_hash long, h1 long, h2 long, at int, len int"


def sentences(text: str | None) -> list[str]:
    """A text cut into sentences, each with the white space that follows it; joined, they are the text again."""
    return _SENTENCE.findall(text) if text else []


def runs(parts: list[str], span: int = SPAN, long_words: int = LONG_WORDS) -> list[tuple[int, int, str]]:
    """(first sentence, number of sentences, words with single spaces) of the runs that count.

    From each sentence: the run of span sentences, whatever its words, and beside it the shortest run below span
    sentences that has long_words words, so that a long passage of few sentences counts too. A text of fewer than span
    sentences is one run as a whole. Pieces of white space alone are no sentences.
    """
    words = [(i, w) for i, w in enumerate(p.split() for p in parts) if w]
    out = []
    n = len(words)
    if 0 < n < span:
        out.append((words[0][0], words[-1][0] - words[0][0] + 1, " ".join(x for _, w in words for x in w)))
    for i in range(n):
        here = words[i : i + span]
        size = 0
        for k, (j, w) in enumerate(here, 1):
            size += len(w)
            if k < span and size >= long_words and not (k == n and n < span):
                out.append((words[i][0], j - words[i][0] + 1, " ".join(x for _, v in here[:k] for x in v)))
                break
        if len(here) == span:
            out.append((words[i][0], here[-1][0] - words[i][0] + 1, " ".join(x for _, w in here for x in w)))
    return out


def sentence_runs(docs: DataFrame) -> DataFrame:
    """A row for each run of each row of docs (doc_id, text): 128 bits of hash, first sentence, number of sentences."""
    small_batches(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        names = ["doc_id", "text_hash", "h1", "h2", "at", "len"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        digest = xxhash.xxh3_128_intdigest
        low = (1 << 64) - 1

        def batch(cols):
            return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

        for b in batches:
            cols: list[list] = [[] for _ in names]
            for doc, own, text in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text_hash", "text")), strict=True):
                for at, size, words in runs(sentences(text)):
                    h = digest(words.encode("utf-8", "surrogatepass"))
                    for c, v in zip(cols, (doc, own, signed(h & low), signed(h >> 64), at, size), strict=True):
                        c.append(v)
                if len(cols[0]) > 100_000:
                    yield batch(cols)
                    cols = [[] for _ in names]
            yield batch(cols)
        give_back()

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(each, _SPAN_SCHEMA)


def repeated_sentences(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, spans): for each text that has any, the runs [start, sentences] that occurred before.

    The first occurrence is the one of the least doc_id, then the earliest in its text (and of the least text hash,
    where rows share a doc_id). Whole repeated rows are one text: their runs are not repeats of each other. Half of the
    hash finds the runs that may repeat, which are few; the whole hash decides among those. What the joins look up is
    a table, so that a run with very many places can be split between tasks.
    """
    spans = stash(sentence_runs(docs), "spans")
    halves = stash(spans.groupBy("h1").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h1"), "halves")
    some = stash(spans.join(halves, "h1", "left_semi"), "repeats")
    unstash(spans)
    here = F.struct("doc_id", "text_hash", "at")
    seen = stash(some.groupBy("h1", "h2").agg(F.min(here).alias("first")), "first")
    again = some.join(seen, ["h1", "h2"]).where(~here.eqNullSafe(F.col("first")))
    return again.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("at", "len")).alias("spans"))


def drop_repeats(docs: DataFrame, count: str = "n_sentences", removed: str = "n_removed") -> DataFrame:
    """docs with text stripped of repeated sentences, and two further columns: its sentences and those removed.

    A null text stays null (0 and 0), an empty one empty. Texts without a repeat are unchanged to the last byte; from
    others whole sentences go, with the white space behind them; a text may become empty, never null. Very long texts
    are cut in linear time. A row that is repeated whole (doc_id and text) stays as often as it came: its copies are one
    text. All other columns are carried along, whatever their names; where one has the name of count or removed,
    the new one gets underscores behind it. An empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    names = docs.columns
    plain = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(names)])
    doc_id, text = F.col(f"_c{names.index('doc_id')}"), F.col(f"_c{names.index('text')}")
    found = repeated_sentences(plain.select(doc_id.cast("long").alias("doc_id"), text.alias("text")))
    plain = plain.withColumn("_h", F.xxhash64(text))
    joined = plain.join(found, doc_id.eqNullSafe(found["doc_id"]) & (F.col("_h") == found["text_hash"]), "left")

    @F.pandas_udf("text string, n_sentences int, n_removed int")
    def stripped(texts, spans):
        import pandas as pd

        out = []
        for t, runs_here in zip(texts.tolist(), spans.tolist(), strict=True):
            parts = sentences(t)
            n = sum(1 for p in parts if p.strip())
            gone: set[int] = set()
            for r in runs_here if runs_here is not None else ():
                gone.update(range(r["at"], r["at"] + r["len"]))
            left = t if not gone else "".join(p for i, p in enumerate(parts) if i not in gone)
            out.append((left, n, sum(1 for i in gone if parts[i].strip())))
        return pd.DataFrame(out, columns=["text", "n_sentences", "n_removed"])

    done = joined.withColumn("_s", stripped.asNondeterministic()(text, F.col("spans")))  # so that a filter on it does not run it again
    i = names.index("text")
    return done.select(*[F.col("_s.text" if k == i else f"_c{k}").alias(c) for k, c in enumerate(names)], F.col("_s.n_sentences").alias(free_name(names, count)), F.col("_s.n_removed").alias(free_name(names, removed)))


def op1(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_repeats(docs)


#: The words of a sentence as str.split() sees them, and sentence ends; U+F0000 marks a cut.
_BLANKS = r"[\s\x0b\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
OP1_SQL = rf"""
WITH cut AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?]+[\t\x0b\x0c\r \n]+|\n+)', '\1' || chr(983040), 'g'), chr(983040)), lambda p: p <> '') AS parts FROM documents),
part AS MATERIALIZED (SELECT doc_id, i - 1 AS i, parts[i] AS p, trim(regexp_replace(parts[i], '{_BLANKS}', ' ', 'g')) AS w FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM cut)),
word AS (SELECT doc_id, i, w, len(string_split(w, ' ')) AS n FROM part WHERE w <> ''),
near AS (SELECT *, row_number() OVER o AS k, count(*) OVER (PARTITION BY doc_id) AS m, lead(i) OVER o AS i1, lead(n) OVER o AS n1, lead(w) OVER o AS w1, lead(i, 2) OVER o AS i2, lead(n, 2) OVER o AS n2, lead(w, 2) OVER o AS w2
  FROM word WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
run AS (
  SELECT doc_id, i AS a, i2 AS z, concat_ws(' ', w, w1, w2) AS t FROM near WHERE i2 IS NOT NULL
  UNION ALL SELECT doc_id, i, coalesce(i1, i), concat_ws(' ', w, w1) FROM near WHERE k = 1 AND m < {SPAN}
  UNION ALL SELECT doc_id, i, i, w FROM near WHERE n >= {LONG_WORDS} AND m > 1
  UNION ALL SELECT doc_id, i, i1, concat_ws(' ', w, w1) FROM near WHERE n < {LONG_WORDS} AND n + n1 >= {LONG_WORDS} AND m >= {SPAN}),
gone AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(range(a, z + 1)) AS i FROM (SELECT doc_id, a, z, row_number() OVER (PARTITION BY t ORDER BY doc_id, a) AS r FROM run) WHERE r > 1),
done AS (
  SELECT doc_id, string_agg(p, '' ORDER BY i) FILTER (g IS NULL) AS left_text, count(*) FILTER (w <> '') AS n, count(*) FILTER (w <> '' AND g IS NOT NULL) AS r
  FROM part LEFT JOIN (SELECT doc_id, i, 1 AS g FROM gone) USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CASE WHEN text IS NOT NULL THEN coalesce(left_text, '') END AS text, coalesce(n, 0)::INTEGER AS n_sentences, coalesce(r, 0)::INTEGER AS n_removed
FROM documents LEFT JOIN done USING (doc_id)
"""
