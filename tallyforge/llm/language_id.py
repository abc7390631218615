"""Language identification by Bayesian evidence fusion.

The posterior of a row's language combines four kinds of evidence: the likelihood of its text under trigram models, the
language its markup declares, the suffix of its address, and the languages of its host. Host priors are grouped counts,
smoothed towards their suffix's counts, which are smoothed towards the counts of all rows; a row's own declaration is
taken out of all three. A hypothesis for text in none of the languages has even trigram odds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, small_batches, stash

#: Hashed trigrams of a model: at most so many counts of each language reach the driver.
BUCKETS = 1 << 15
#: Priors are broadcast up to this many counts (hosts x languages); beyond it they are joined by a shuffle.
BROADCAST_COUNTS = 320_000
#: Declarations that name no language.
NO_LANGUAGE = ("mis", "mul", "und", "zxx")
#: The language that a country's address suffix suggests.
SUFFIX_LANGUAGE = {"at": "de", "de": "de", "es": "es", "fr": "fr", "ie": "en", "it": "it", "mx": "es", "nl": "nl", "pl": "pl", "pt": "pt", "ru": "ru", "uk": "en", "us": "en"}


@dataclass(frozen=True)
class Settings:
    """sample: documents of each language (expected number) that its text model is fitted on. effective: trigrams that
    a longer text counts as. trust, suffix_trust: the chance that a declaration or suffix is right. smoothing: rows that
    the wider group counts as. undetermined: prior chance of no language. least: posterior that a kept row needs."""

    sample: int = 4000
    effective: float = 60.0
    trust: float = 0.9
    suffix_trust: float = 0.6
    smoothing: float = 5.0
    undetermined: float = 0.001
    least: float = 0.5


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each byte trigram of the lower-cased texts, number of them by text). Runs of white space and digits
    count as one space; each text is padded by spaces; a null or blank text has none."""
    parts = []
    for t in texts:
        b = " ".join((t or "").lower().translate(_BLANK).split()).encode("utf-8", "surrogatepass")
        parts.append(b"  " + b + b" " if b else b"")
    size = np.array([max(0, len(p) - 2) for p in parts], np.int64)
    raw = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint32)
    if len(raw) < 3:
        return np.empty(0, np.int64), size
    h = (raw[:-2] << np.uint32(16)) | (raw[1:-1] << np.uint32(8)) | raw[2:]
    h = (h * np.uint32(2654435761)) >> np.uint32(17)
    ends = np.cumsum([len(p) for p in parts])[:-1]
    inner = np.ones(len(h), bool)  # without the two that reach over each boundary
    for back in (1, 2):
        at = ends - back
        inner[at[(at >= 0) & (at < len(h))]] = False
    return h[inner].astype(np.int64), size


_BLANK = {ord(c): " " for c in "0123456789"}


def host_of(address: Column) -> Column:
    """The lower-cased host of an address, without port; a bare name is its own host; null or empty: null."""
    a = F.lower(F.trim(address))
    host = F.regexp_extract(a, r"^(?:[a-z][a-z0-9+.\-]*://)?(?:[^/@?#]*@)?([^/:?#]+)", 1)
    return F.when(host != "", host)


def suffix_of(host: Column) -> Column:
    """What follows the last dot of a host, "" without a dot; null without a host."""
    return F.when(host.contains("."), F.element_at(F.split(host, r"\."), -1)).when(host.isNotNull(), "")


def declared_of(markup: Column) -> Column:
    """The primary language of the first lang attribute of an HTML text; null without one."""
    lang = F.lower(F.regexp_extract(markup, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1))
    return F.when(lang != "", lang)


def primary_of(tag: Column) -> Column:
    """The lower-cased primary subtag of a language tag (en-GB, pt_BR); null where it has none that names a language."""
    first = F.regexp_extract(F.lower(F.trim(tag)), r"^([a-z]{2,3}|[a-z]{5,8})(?:[-_].*)?$", 1)
    return F.when((first != "") & ~first.isin(*NO_LANGUAGE), first)


def languages(rows: DataFrame) -> dict[str, int]:
    """All languages that rows declare, with their counts, in order of name."""
    return dict(sorted((r[0], r[1]) for r in rows.where("declared is not null").groupBy("declared").count().collect()))


def in_sample(text: Column, rate: Column) -> Column:
    """Whether a text is one of those that its language's model is fitted on."""
    return F.pmod(F.xxhash64(text, F.lit("fit")), F.lit(1 << 20)) < rate * (1 << 20)


def text_model(rows: DataFrame, counts: dict[str, int], sample: int) -> np.ndarray:
    """Log odds of each bucket (BUCKETS x languages), from a hash sample of about `sample` rows a language, whole texts."""
    names = [*counts]
    rates = F.create_map(*[F.lit(x) for name in names for x in (name, min(1.0, sample / counts[name]))])
    rate = F.coalesce(F.try_element_at(rates, F.col("declared")), F.lit(0.0))
    chosen = rows.where(in_sample(F.col("text"), rate))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = {name: k for k, name in enumerate(names)}
        total: dict[int, np.ndarray] = {}
        for pdf in batches:
            for name, group in pdf.groupby("declared"):
                texts, k = group["text"].tolist(), number[name]
                for i in range(0, len(texts), 256):
                    total[k] = total.get(k, 0) + np.bincount(trigrams(texts[i : i + 256])[0], minlength=BUCKETS)
        for k, n in total.items():
            b = np.flatnonzero(n)
            yield pd.DataFrame({"k": np.full(len(b), k, np.int32), "b": b.astype(np.int32), "n": n[b]})

    found = chosen.select("declared", "text").mapInPandas(count, "k int, b int, n long").groupBy("k", "b").agg(F.sum("n").alias("n")).toPandas()
    table = np.full((BUCKETS, len(names)), 0.05)
    table[found["b"].to_numpy(), found["k"].to_numpy()] += found["n"].to_numpy()
    table /= table.sum(0)
    return np.log(table, out=table)


def host_counts(rows: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame, list[float]]:
    """(host, host_n), (suffix, suffix_n) and the counts of all rows, each by language, from rows that declare one.

    Rows are counted by (host, language) first, so a host with most rows is summed map-side. A suffix's counts hold all
    its hosts, and so reach hosts without a declaration too; hosts without a dot share the suffix "".
    """
    known = stash(rows.where("declared is not null").groupBy("host", "suffix", "declared").count(), "known")

    def by_name(group: str) -> DataFrame:
        found = known.where(F.col(group).isNotNull()).groupBy(group, "declared").agg(F.sum("count").alias("count"))
        found = found.groupBy(group).agg(F.map_from_entries(F.collect_list(F.struct("declared", "count"))).alias("_m"))
        listed = F.transform(F.array(*[F.lit(n) for n in names]), lambda n: F.coalesce(F.try_element_at("_m", n), F.lit(0)).cast("double"))
        return stash(found.select(F.col(group).alias(f"_{group}"), listed.alias(f"{group}_n")), group)

    overall = {r[0]: r[1] for r in known.groupBy("declared").agg(F.sum("count")).collect()}
    return by_name("host"), by_name("suffix"), [float(overall.get(n, 0)) for n in names]


def posterior(log_text: np.ndarray, n: np.ndarray, declared: np.ndarray, suffix: np.ndarray, host_n: np.ndarray, suffix_n: np.ndarray, all_n: np.ndarray, s: Settings) -> np.ndarray:
    """Rows x (languages + undetermined). declared, suffix: number of the language that they name, or -1."""
    rows, k = log_text.shape
    own = (np.arange(k) == declared[:, None]).astype(float)

    def smoothed(counts, wider):
        counts = np.maximum(counts - own, 0)
        return (counts + s.smoothing * wider) / (counts.sum(1, keepdims=True) + s.smoothing)

    prior = smoothed(host_n, smoothed(suffix_n, smoothed(np.broadcast_to(all_n, (rows, k)), np.full((rows, k), 1 / max(k, 1)))))
    out = np.empty((rows, k + 1))
    out[:, :k] = np.log(prior) + np.log(1 - s.undetermined)
    out[:, k] = np.log(s.undetermined)
    for said, trust in ((declared, s.trust), (suffix, s.suffix_trust)):
        if k > 1:
            right = np.arange(k) == said[:, None]
            out[:, :k] += np.where(said[:, None] < 0, 0.0, np.where(right, np.log(trust), np.log((1 - trust) / (k - 1))))
            out[:, k] += np.where(said < 0, 0.0, np.log(1 / k))
    scale = np.minimum(1.0, s.effective / np.maximum(n, 1))
    out[:, :k] += log_text * scale[:, None]
    out[:, k] += -np.log(BUCKETS) * n * scale
    out -= out.max(1, keepdims=True)
    out = np.exp(out)
    return out / out.sum(1, keepdims=True)


def identify(docs: DataFrame, text: Column, declared: Column, address: Column, settings: Settings = Settings(), out: str = "language") -> DataFrame:
    """docs with a struct column: lang (null: undetermined), confidence, n_trigrams, text_lang, kept.

    A null or blank text brings no text evidence and is not kept; a null declaration or address brings none of its kind.
    Rows that declare nothing known are scored by the models of the languages that others declare; if no row declares
    a language, nothing is determined. Ties go to the first language by name. Very long texts are read whole, in bounded
    blocks; repeated rows are judged alike and counted each. All columns of docs are carried along; where one is
    named as out is, out gets underscores behind it. An empty table gives an empty one.

    The text's likelihoods are found first, so that a join of priors (beyond what is broadcast) moves only the columns
    that the result needs.
    """
    spark = docs.sparkSession
    small_batches(spark)
    s = settings
    names_in = docs.columns
    host = host_of(address)
    rows = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(names_in)], text.alias("text"), primary_of(declared).alias("declared"), host.alias("host"), suffix_of(host).alias("suffix"))
    counts = languages(rows)
    names = [*counts]
    k = len(names)
    model = text_model(rows, counts, s.sample) if k else np.zeros((BUCKETS, 0))
    shared = spark.sparkContext.broadcast(model.astype(np.float32))
    number = {n: i for i, n in enumerate(names)}

    @F.pandas_udf("n long, log_text array<double>")
    def likelihoods(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        table = shared.value
        for texts in batches:
            log_text, n = np.zeros((len(texts), k)), np.zeros(len(texts), np.int64)
            listed, i = texts.tolist(), 0
            while i < len(listed):
                j, size = i, 0
                while j < len(listed) and (j == i or size + len(listed[j] or "") <= 1 << 20):
                    size += len(listed[j] or "")
                    j += 1
                grams, m = trigrams(listed[i:j])
                full = np.flatnonzero(m)
                n[i:j] = m
                if k and len(full):
                    starts = np.concatenate(([0], np.cumsum(m[full])[:-1]))
                    for c in range(k):
                        log_text[i + full, c] = np.add.reduceat(table[grams, c].astype(np.float64), starts)
                i = j
            yield pd.DataFrame({"n": n, "log_text": list(log_text)})

    rows = rows.withColumn("_t", likelihoods("text"))
    all_n = []
    if k:
        hosts, suffixes, all_n = host_counts(docs.select(primary_of(declared).alias("declared"), host.alias("host"), suffix_of(host).alias("suffix")), names)
        most = max(1, BROADCAST_COUNTS // k)
        for table, key in ((hosts, "host"), (suffixes, "suffix")):
            small = table.limit(most + 1).count() <= most
            rows = rows.join(F.broadcast(table) if small else table, F.col(key) == F.col(f"_{key}"), "left")
    else:
        rows = rows.withColumns({"host_n": F.array().cast("array<double>"), "suffix_n": F.array().cast("array<double>")})

    @F.pandas_udf("lang string, confidence double, n_trigrams long, text_lang string, kept boolean")
    def fused(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        def arrays(c):
            return np.array([np.zeros(k) if x is None else x for x in c.tolist()], float).reshape(len(c), k)

        for text_n, text_l, said, suffixes, by_host, by_suffix in batches:
            n, log_text = text_n.to_numpy(np.int64), arrays(text_l)
            d = np.array([number.get(x, -1) for x in said.tolist()], np.int64)
            f = np.array([number.get(SUFFIX_LANGUAGE.get(x), -1) for x in suffixes.tolist()], np.int64)
            p = posterior(log_text, n, d, f, arrays(by_host), arrays(by_suffix), np.array(all_n), s)
            best = p.argmax(1)
            sure = p[np.arange(len(p)), best]
            by_text = log_text.argmax(1) if k else best
            yield pd.DataFrame({
                "lang": [names[b] if b < k else None for b in best],
                "confidence": sure,
                "n_trigrams": n,
                "text_lang": [names[b] if k and x else None for b, x in zip(by_text, n, strict=True)],
                "kept": (best < k) & (sure >= s.least) & (n > 0),
            })

    done = rows.withColumn("_l", fused("_t.n", "_t.log_text", "declared", "suffix", "host_n", "suffix_n"))
    return done.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(names_in)], F.col("_l").alias(free_name(names_in, out)))


def keep_identified(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of docs (documents' columns) whose language is determined. lang counts as the declared markup language
    and source as the address."""
    name = free_name(docs.columns, "_language")
    return identify(docs, F.col("text"), F.col("lang"), F.col("source"), settings, name).where(F.col(f"{name}.kept")).drop(name)


def op7(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs.select("doc_id", "text", "lang", "source"), F.col("text"), F.col("lang"), F.col("source")).select("doc_id", "language.*")


def pages(spark, sf_dir: str) -> DataFrame:
    """The same over raw pages: text and declaration from the markup, host and suffix from the address."""
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet")
    bare = F.regexp_replace(F.regexp_replace(F.col("html"), r"(?is)<(script|style|nav)\b.*?</\1\s*>|<!--.*?-->", " "), r"<[^>]*>|&[a-zA-Z#0-9]+;", " ")
    return identify(rows, bare, declared_of(F.col("html")), F.col("url")).select("page_id", "language.*")
