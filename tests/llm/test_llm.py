"""The operators against brute force, with nulls, empty and long texts, ties, repeats, empty tables, extra columns."""

import collections
import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import bpe, hnsw, kd_sharding, language_id, packing, quality_classifier, quality_rules, simhash, substring_dedup, warc_fixity
from tallyforge.llm.common import WORD, ranked
from tallyforge.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta omega sigma kappa lambda theta zeta iota nu".split()


def prose(seed: int, sentences: int = 12) -> str:
    r = random.Random(seed)
    return " ".join(" ".join(f"{r.choice(WORDS)}{r.randrange(900)}" for _ in range(r.randint(4, 12))).capitalize() + "." for _ in range(sentences))


def table(spark, rows, schema=DOCS):
    return spark.createDataFrame([tuple(r) + (None,) * (len(schema.split(",")) - len(r)) for r in rows], schema)


def rough(spark):
    """Rows of every awkward kind."""
    long = prose(1, 3000)
    return table(spark, [(1, None), (2, ""), (3, "   \n\t "), (4, long), (5, long), (6, "word"), (7, prose(7)), (7, prose(7)), (None, prose(8)), (None, None), (9, "x" * 50_000), (10, "É ß 日本\u00a0Σς 😀", "de", "h", 3)])


@pytest.fixture(scope="module")
def odd(spark):
    return rough(spark).cache()


def empty(spark):
    return table(spark, [])


# substring dedup


def brute_dedup(docs: list[tuple]) -> dict:
    first, marks = {}, {}
    for key, text in sorted(docs, key=lambda d: d[0]):
        for at, size, words in substring_dedup.runs(substring_dedup.sentences(text)):
            if first.setdefault(words, (key, at)) != (key, at):
                marks.setdefault(key, set()).update(range(at, at + size))
    return {k: "".join(p for i, p in enumerate(substring_dedup.sentences(t)) if i not in marks.get(k, ())) for k, t in docs}


def test_sentences_rejoin():
    for t in ("", "a", "a. b! c?\n\nd\n", "\n\n a.b c... d.", "x" * 1000, "One.\tTwo. \r\nThree"):
        assert "".join(substring_dedup.sentences(t)) == t
    assert substring_dedup.sentences("A b. C d!\nE") == ["A b. ", "C d!\n", "E"]


def test_substring_dedup_against_brute_force(spark):
    shared = prose(100, 6)
    docs = [(i, prose(i) + ("\n" + shared + "\n" + prose(500 + i) if i % 3 == 0 else "")) for i in range(40)]
    docs += [(50, docs[1][1]), (51, "Only two sentences of a fair length stand in this text. They come twice in all of it."), (52, "Only two sentences of a fair length stand in this text. They come twice in all of it.")]
    got = {r.doc_id: r.text for r in substring_dedup.drop_repeats(table(spark, docs)).collect()}
    assert got == brute_dedup(docs)
    assert got[0] == docs[0][1] and got[50] == "" and got[52] == "" and shared not in got[3]


def test_long_passage_of_few_sentences(spark):
    passage = " ".join(f"w{i}" for i in range(60)) + "."
    got = {r.doc_id: r.text for r in substring_dedup.drop_repeats(table(spark, [(1, prose(1) + " " + passage), (2, prose(2) + " " + passage + " " + prose(3))])).collect()}
    assert passage in got[1] and passage not in got[2]


def test_short_runs_are_repeats_too(spark):
    docs = [(1, "Yes. No. So be it. " + prose(1)), (2, prose(2) + " Yes. No. So be it."), (3, "Quite so."), (4, "Quite so.")]
    got = {r.doc_id: r.text for r in substring_dedup.drop_repeats(table(spark, docs)).collect()}
    assert got == brute_dedup(docs) and got[1] == docs[0][1] and "So be it" not in got[2] and got[3] and got[4] == ""


def test_sentences_of_long_runs_of_marks():
    for t in ("." * 300_000 + "x", "a.?!" * 100_000, "..! b.. c.\n\n d?!\te"):
        assert "".join(substring_dedup.sentences(t)) == t
    assert substring_dedup.sentences("..! b.. c.d\n\n e?!\tf") == ["..! ", "b.. ", "c.d\n\n", " e?!\t", "f"]


def test_substring_dedup_awkward_rows(spark, odd):
    out = substring_dedup.drop_repeats(odd.withColumns({"spans": F.lit(1), "text_hash": F.lit(2), "N_removed": F.lit(3)}))
    assert out.columns == [*odd.columns, "spans", "text_hash", "N_removed", "n_sentences", "n_removed_"]
    out = out.withColumnRenamed("N_removed", "given").withColumnRenamed("n_removed_", "n_removed").collect()
    assert len(out) == odd.count() and all(r.given == 3 for r in out)
    by = {r.doc_id: r for r in out}
    assert by[1].text is None and by[2].text == "" and by[4].n_removed == 0 and by[5].text == "" and by[9].text == "x" * 50_000
    assert [r.n_removed for r in out if r.doc_id == 7] == [0, 0]
    assert substring_dedup.drop_repeats(empty(spark)).count() == 0


# quality rules


def brute_repeats(words):
    n, best = len(words), [0] * len(words)
    for i, j in itertools.permutations(range(n), 2):
        k = 0
        while max(i, j) + k < n and words[i + k] == words[j + k]:
            k += 1
        best[i] = max(best[i], k)
    return best


def test_quality_measures():
    clean, line = prose(5, 20), "Same line of words here."
    repeated = "\n".join([line] * 30)
    rows = quality_rules.measure([clean, repeated, None, "", "a#b *c\n\nx\nx\n \n"])
    names = [f.split()[0] for f in quality_rules.OUT.split(", ")]
    a, b, c, d, e = (dict(zip(names, r, strict=True)) for r in rows)
    assert a["kept"] and not a["base_failed"] and a["n_words"] == len(clean.split()) and a["word_chars"] == len(clean.replace(" ", ""))
    assert not b["kept"] and b["n_dup_lines"] == 29 and b["n_repeat_words"] == 150 and b["longest_repeat"] == 145 and b["covered_fraction"] == 1
    assert c == d and c["n_words"] == 0 and c["base_failed"] and not c["kept"]
    assert (e["n_symbols"], e["n_dup_lines"], e["n_words"], e["word_chars"]) == (2, 1, 4, 7)


def test_quality_limits_by_method():
    passage = " ".join(f"v{i}" for i in range(70))
    text = passage + " " + " ".join(f"u{i}" for i in range(400)) + " " + passage
    m = dict(zip([f.split()[0] for f in quality_rules.OUT.split(", ")], quality_rules.measure([text])[0], strict=True))
    assert not m["base_failed"] and m["longest_repeat"] == 70 and not m["kept"]
    assert quality_rules.measure([text], quality_rules.Limits(max_longest=70))[0][-1]


def test_quality_awkward_rows(spark, odd):
    out = quality_rules.keep_good(odd.withColumn("_quality", F.lit(1)))
    assert out.columns == [*odd.columns, "_quality"] and {r.doc_id for r in out.collect()} == {4, 5, 7, None}
    assert quality_rules.quality_measures(empty(spark)).count() == 0


# WARC fixity


def test_fixity_finds_damage(spark):
    rows = [(i, f"http://h/{i}", f"page {i} " * (i % 5)) for i in range(1, 3000)] + [(None, None, None), (None, "u", "v"), (7, "http://h/7", "second")]
    a = spark.createDataFrame(rows, "page_id long, url string, html string")
    changed = [(i, u, "!" if i == 1500 else h) for i, u, h in rows if i != 40] + [(9999, "new", "x"), (8, *rows[7][1:])]
    b = spark.createDataFrame(changed, a.schema)
    out = warc_fixity.fixity_audit(a, b, "page_id", warc_fixity.warc_record(F.col("url"), F.col("html"))).collect()
    bad = {(r.key, r.status) for r in out if r.status != "intact"}
    assert bad == {(1500, "corrupt"), (40, "missing"), (9999, "extra"), (8, "corrupt")}
    order = sorted((r for r in out if r.offset is not None), key=lambda r: (r.key is not None, r.key or 0, r.digest))
    ends = [0, *itertools.accumulate(r.length * r.copies for r in order)]
    assert [r.offset for r in order] == ends[:-1] and len(order) == len(rows)


def test_fixity_of_crowded_keys_and_empty_tables(spark):
    a = spark.range(5000).select(F.lit(1).cast("long").alias("page_id"), F.lit("u").alias("url"), F.col("id").cast("string").alias("html"))
    b = a.where("html <> '77'")
    audit = lambda x, y: warc_fixity.fixity_audit(x, y, "page_id", warc_fixity.warc_record(F.col("url"), F.col("html"))).groupBy("status").count().collect()
    assert {r[0]: r[1] for r in audit(a, b)} == {"intact": 4999, "missing": 1}
    assert audit(a.limit(0), a.limit(0)) == [] and {r[0]: r[1] for r in audit(a.limit(3), a.limit(0))} == {"missing": 3}


def test_fixity_of_altered_records_among_far_and_crowded_keys(spark):
    rows = [(i, "u", f"p{i}") for i in range(3000)] + [(10**12, "u", "far"), (-(2**63), "u", "least"), (2**63 - 1, "u", "most")] + [(5000, "u", f"q{i}") for i in range(2000)] + [(None, "u", "z")]
    a = spark.createDataFrame(rows, "page_id long, url string, html string")
    altered = {"p7", "p2999", "far", "q77", "z"}
    b = spark.createDataFrame([(k, u, h + "!" if h in altered else h) for k, u, h in rows], a.schema)
    out = warc_fixity.fixity_audit(a, b, "page_id", warc_fixity.warc_record(F.col("url"), F.col("html"))).collect()
    assert sorted((r.key or -1) for r in out if r.status == "corrupt") == [-1, 7, 2999, 5000, 10**12] and {r.status for r in out} == {"intact", "corrupt"}
    order = sorted(out, key=lambda r: (r.key is not None, r.key or 0, r.digest))
    assert [r.offset for r in order] == [0, *itertools.accumulate(r.length for r in order)][:-1] and len(order) == len(rows)
    assert max(collections.Counter(r.leaf for r in out).values()) <= 16 << warc_fixity.LEAF_BITS


# BPE


def test_bpe_against_the_library(spark, odd):
    tokenizers = pytest.importorskip("tokenizers")
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    theirs = tokenizers.Tokenizer.from_file(path)
    ours = bpe.WordBPE.load(open(path).read())
    r = random.Random(4)
    texts = ["Hello World's 1234 don't<|endoftext|>foo ΑΣ İ ǅ\xa0x", "", "  ", "a" * 3000, "<|startoftext|><|ENDOFTEXT|>"]
    texts += ["".join(r.choice("aabcdethe  inan'sl\n.,!<|>09½ßéÉÑΣς日本\x1f\x85\xa0\u0301İ€ǅ") for _ in range(r.randrange(200))) for _ in range(400)]
    for text, ids in zip(texts, ours.encode(texts), strict=True):
        e = theirs.encode(text, add_special_tokens=False)
        assert e.ids == ids.tolist() and theirs.decode(e.ids, skip_special_tokens=False) == ours.decode(ids.tolist())
    got = bpe.token_digests(odd, path).collect()
    assert len(got) == odd.count()
    for row in (x for x in got if x.doc_id in (2, 4, 9, 10)):
        text = odd.where(F.col("doc_id") == row.doc_id).first().text
        e = theirs.encode(text, add_special_tokens=False)
        assert row.n_tokens == len(e.ids) and row.ids_sha256 == hashlib.sha256(np.array(e.ids, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(theirs.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()
    back = bpe.with_decoded(bpe.with_tokens(odd.where("doc_id = 10"), path), path).first()
    assert back.decoded == theirs.decode(theirs.encode(back.text, add_special_tokens=False).ids, skip_special_tokens=False)


# SimHash


def brute_fingerprint(text):
    import xxhash

    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    runs = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hs = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprints_against_brute_force(spark):
    texts = [prose(i, i % 40 + 1) for i in range(60)] + [None, "", " \n", "one", "Two Words", "a b c " * 400]
    assert [int(x) % 2**64 for x in simhash.fingerprints(texts)] == [brute_fingerprint(t) for t in texts]
    spark_hash = spark.sql("SELECT xxhash64('one two three') AS h").first().h % 2**64
    assert spark_hash == int(simhash.shingle_hashes("One two THREE")[0])


def test_links_lose_no_pair(spark):
    r = random.Random(5)
    fps = {0}
    for _ in range(60):
        f = r.getrandbits(64)
        for _ in range(r.randint(1, 12)):
            fps.add(f)
            for _ in range(r.randint(1, 3)):
                f ^= 1 << r.randrange(64)
    signed = lambda x: x - 2**64 if x >> 63 else x
    links = simhash.fingerprint_links(spark.createDataFrame([(signed(f),) for f in fps], "fp long"))
    assert all(((x.a ^ x.b) % 2**64).bit_count() <= 2 for x in links.collect())
    got = {x.node: x.component for x in connected_components(links).collect()}
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(fps, 2):
        if (a ^ b).bit_count() <= 2:
            root[find(a)] = find(b)
    groups = {}
    for f in fps:
        groups.setdefault(find(f), []).append(signed(f))
    assert got == {f: min(g) for g in groups.values() if len(g) > 1 for f in g}


def test_components_of_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1400)] + [(5000, 5000), (6000, 6001), (6001, 6000)]
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(pairs, "x long, y long")).collect()}
    assert {got[i] for i in range(201)} == {0} and {got[i] for i in range(1000, 1400)} == {1000} and got[6001] == 6000 and 5000 not in got
    assert connected_components(spark.createDataFrame([], "x long, y long")).count() == 0


def test_near_dedup_awkward_rows(spark, odd):
    got = simhash.simhash_components(odd).collect()
    assert len(got) == odd.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add(r.component_id)
    assert by[1] == by[2] == by[3] == {1} and by[4] == by[5] == {4} and by[7] == {7} and 1 in by[None]
    kept = simhash.keep_first(odd.withColumn("_id", F.lit(0)))
    assert kept.columns == [*odd.columns, "_id"] and sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [1, 4, 6, 7, 7, 9, 10]
    assert simhash.simhash_components(empty(spark)).count() == 0


# packing


def test_packing_is_whole_and_fits():
    r = random.Random(6)
    lengths = packing.Lengths()
    for _ in range(30):
        sizes = sorted((r.randint(1, 4096) for _ in range(r.randint(0, 300))), reverse=True)
        bins = packing.pack(sizes, lengths)
        assert sorted(i for _, b in bins for i in b) == list(range(len(sizes)))
        for c, b in bins:
            used = sum(sizes[i] for i in b)
            assert used <= c and c == min(x for x in lengths.permitted if x >= used)
    assert [c for c, _ in packing.pack([500], lengths)] == [512]


def test_best_fit_against_brute_force():
    lengths = packing.Lengths(permitted=(8, 16), per_bin=1)
    r = random.Random(7)

    def slow(sizes, capacities):
        bins, left = [], sum(sizes)
        for i, s in enumerate(sizes):
            fit = [(room, k) for k, (room, _) in enumerate(bins) if room >= s]
            if fit:
                k = min(fit)[1]
            else:
                c = min((c for c in capacities if c >= s), key=lambda c: (lengths.cost(c) / min(c, left), c))
                bins.append((c, []))
                k = len(bins) - 1
            bins[k] = (bins[k][0] - s, bins[k][1] + [i])
            left -= s
        return [b for _, b in bins]

    for _ in range(200):
        sizes = sorted((r.randint(1, 16) for _ in range(r.randint(0, 25))), reverse=True)
        assert packing.best_fit(sizes, (8, 16), lengths) == slow(sizes, (8, 16))


def test_packing_rows(spark, odd):
    docs = odd.union(table(spark, [(20, "w " * 10_000)])).withColumn("bin_id", F.lit("x"))
    got = packing.best_fit_packing(docs, F.regexp_count("text", F.lit(WORD))).collect()
    assert sum(r.n_tokens for r in got) == sum(len((r.text or "").encode().split()) for r in docs.collect())
    assert [(r.piece, r.first_token, r.n_tokens) for r in sorted(got, key=lambda r: r.piece) if r.doc_id == 20] == [(0, 0, 4096), (1, 4096, 4096), (2, 8192, 1808)]
    assert {r.copy for r in got if r.doc_id == 7} == {0, 1} and not {1, 2, 3} & {r.doc_id for r in got}
    for _, rows in itertools.groupby(sorted(got, key=lambda r: (r.bin_id, r.bin_offset)), key=lambda r: r.bin_id):
        rows = list(rows)
        assert [r.bin_offset for r in rows] == [0, *itertools.accumulate(r.n_tokens for r in rows)][:-1] and sum(r.n_tokens for r in rows) == rows[0].bin_used <= rows[0].bin_capacity
    assert packing.best_fit_packing(empty(spark), F.length("text")).count() == 0


# language


def words_of(lang, seed, n=60):
    r = random.Random(seed)
    own = {"en": "the of and with shing tion", "de": "der und schön über keit ung", "fr": "les des élève eau aux être"}[lang].split()
    return " ".join(r.choice(own) for _ in range(n))


def test_language_fuses_evidence(spark):
    rows = [(i, words_of(lang, i), lang, f"{lang}host.example.com") for i in range(120) for lang in [("en", "de", "fr")[i % 3]]]
    rows += [(900, words_of("fr", 1), "en", "new.example.com"), (901, words_of("de", 2), None, None), (902, None, "en", "enhost.example.com"), (903, "", None, None), (904, "qzx jjq " * 40, None, None), (905, "und", None, "dehost.example.com")]
    docs = table(spark, rows)
    got = {r.doc_id: r.language for r in language_id.identify(docs, F.col("text"), F.col("lang"), F.col("source")).collect()}
    assert all(got[i].lang == ("en", "de", "fr")[i % 3] and got[i].kept for i in range(120))
    assert got[900].lang == "fr" and got[901].lang == "de" and got[905].lang == "de"
    assert not got[902].kept and not got[903].kept and not got[904].kept
    out = language_id.keep_identified(docs.withColumns({"_language": F.lit(0), "host": F.lit("z")}))
    assert out.columns == [*docs.columns, "_language", "host"] and 904 not in {r.doc_id for r in out.collect()}


def test_every_declared_language_has_a_model(spark):
    r = random.Random(13)
    tags = [f"{a}{b}" for a in "qrst" for b in "abcdef"]
    own = {t: ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(30)] for t in tags}
    text = lambda t: " ".join(r.choice(own[t]) for _ in range(60))
    rows = [(100 * k + i, text(t), (t, f" {t.upper()}-GB", f"{t}_x")[i % 3], "h") for k, t in enumerate(tags) for i in range(12 if k < 20 else 6)]
    rows += [(9000 + k, text(t), "und", "h") for k, t in enumerate(tags)]
    got = {x.doc_id: x.language for x in language_id.identify(table(spark, rows), F.col("text"), F.col("lang"), F.col("source")).collect()}
    assert all(got[100 * k].lang == got[100 * k + 1].lang == got[9000 + k].lang == t and got[9000 + k].kept for k, t in enumerate(tags))


def test_language_posterior_by_hand():
    s = language_id.Settings(effective=1e9, undetermined=0.0 + 1e-12, trust=0.8, smoothing=2.0)
    p = language_id.posterior(np.log([[0.2, 0.1]]), np.array([1]), np.array([0]), np.array([-1]), np.array([[3.0, 1.0]]), np.array([[5.0, 5.0]]), np.array([9.0, 11.0]), s)[0]
    top = (np.array([8.0, 11.0]) + 2 * 0.5) / 21
    wide = (np.array([4.0, 5.0]) + 2 * top) / 11
    prior = (np.array([2.0, 1.0]) + 2 * wide) / 5
    want = prior * [0.2, 0.1] * np.array([0.8, 0.2])
    assert np.allclose(p[:2] / p[:2].sum(), want / want.sum())


def test_language_addresses(spark):
    a = ["https://User@www.Shop.DE:80/x", "src8", "", None, "http://h.example.co.uk?x"]
    rows = spark.createDataFrame([(x,) for x in a], "u string").select(language_id.host_of(F.col("u")).alias("h")).select("h", language_id.suffix_of(F.col("h")).alias("s")).collect()
    assert [(r.h, r.s) for r in rows] == [("www.shop.de", "de"), ("src8", ""), (None, None), (None, None), ("h.example.co.uk", "uk")]
    tag = spark.createDataFrame([('<!DOCTYPE html><html class="x" lang="FR-ca">',), ("<p>",)], "m string").select(language_id.declared_of(F.col("m")).alias("d")).collect()
    assert [r.d for r in tag] == ["fr", None]


def test_language_without_declarations(spark, odd):
    got = language_id.identify(odd, F.col("text"), F.lit(None).cast("string"), F.col("source")).collect()
    assert len(got) == odd.count() and not any(r.language.kept for r in got)
    assert language_id.identify(empty(spark), F.col("text"), F.col("lang"), F.col("source")).count() == 0


# nearest neighbours


def test_neighbours_recall_and_scores(spark):
    r = np.random.default_rng(8)
    centres = r.normal(size=(20, 16))
    x = centres[r.integers(0, 20, 1500)] + 0.5 * r.normal(size=(1500, 16))
    x[100:160] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(5000, None), (5050, [0.0] * 16), (5100, [float("nan")] * 16), (5150, [None] + [1.0] * 15), (None, x[0].tolist()), (5200, []), (5250, [1.0, 2.0]), (5300, [1.0, 2.1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(0)).withColumn("rank", F.lit(0))
    got = {}
    for row in hnsw.nearest(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(row.query_id, []).append((row.vec_id, row.score))
    norm = np.linalg.norm(x, axis=1)
    hits = 0
    for q in range(0, 1500, 50):
        s = x @ x[q] / (norm * norm[q])
        order = [i for i in np.lexsort((np.arange(1500), -np.round(s, 12))) if i != q][:5]
        assert len(got[q]) == 5 and all(abs(s[i] - score) < 1e-12 for i, score in got[q])
        hits += len({i for i, _ in got[q]} & set(order))
    assert hits >= 0.9 * 5 * 30
    assert [i for i, _ in got[100]] == [101, 102, 103, 104, 105] and [i for i, _ in got[5250]] == [5300]
    assert not {5000, 5050, 5100, 5150, 5200} & got.keys()
    assert hnsw.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_graph_survives_its_flat_form():
    x = np.random.default_rng(9).normal(size=(700, 8)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = hnsw.Graph.build(x)
    again = hnsw.Graph.read(8, *g.flat())
    assert all((a == b).all() for a, b in zip(g.layers, again.layers, strict=True))
    nodes, scores = again.search(x[:50], 5, 64)
    assert (nodes[:, 0] == np.arange(50)).mean() > 0.98 and (np.diff(scores, axis=1) <= 0).all()


# sharding


def test_kd_shards_are_even_and_gapless(spark):
    r = random.Random(10)
    rows = [(i, "x" * r.choice([3, 3, 3, 50, 400]), r.choice(["en", "de", None]), r.choice(["a", "b"])) for i in range(4000)]
    out = kd_sharding.shard_documents(table(spark, rows)).collect()
    assert len(out) == 4000
    sums = [0] * 8
    for x in out:
        assert x.size == len(rows[x.doc_id][1]) + 1 and x.text_crc32 == zlib.crc32(rows[x.doc_id][1].encode())
        sums[x.shard] += x.size
    assert max(sums) - min(sums) <= 4 * 401
    for k in range(8):
        slots = sorted(x.slot for x in out if x.shard == k)
        assert slots == list(range(len(slots)))


def test_kd_shards_are_even_with_far_ids(spark):
    for ids in ([*range(1500), 10**15], [*range(1000), *(2**62 + 2**40 * i for i in range(600))]):
        rows = spark.createDataFrame([(i, 10) for i in ids], "id long, size int")
        sums = [r[1] for r in kd_sharding.kd_shards(rows, ["id"], "size", ["id"], 4).groupBy("shard").sum("size").collect()]
        assert len(sums) == 4 and max(sums) - min(sums) <= 30


def test_kd_awkward_rows(spark, odd):
    out = kd_sharding.shard_documents(odd).collect()
    assert len(out) == odd.count() and all(0 <= x.shard < 8 for x in out) and [x.size for x in out if x.doc_id == 1] == [1] and [x.text_crc32 for x in out if x.doc_id == 1] == [0]
    assert kd_sharding.shard_documents(empty(spark)).count() == 0
    three = kd_sharding.shard_documents(table(spark, [(i, "ab") for i in range(300)]), 3).groupBy("shard").count().collect()
    assert sorted(r["count"] for r in three) == [100, 100, 100]


def test_ranked_deals_repeats(spark):
    df = spark.createDataFrame([("a", i % 50) for i in range(500)] + [("b", 1)], "g string, x int")
    out = ranked(df, ["g"], ["x"], "r", rows_per_bucket=7).collect()
    assert sorted(r.r for r in out if r.g == "a") == list(range(500)) and [r.r for r in out if r.g == "b"] == [0]


# classifier


def test_features_by_hand():
    one, again, none = quality_classifier.features(["Red fish, red fish", "red Fish, Red fish", None])
    assert len(none[0]) == 0 and set(one[0]) & set(again[0]) and one[0].tolist() == sorted(one[0].tolist())
    (p, v), *_ = quality_classifier.features(["w"])
    assert len(p) == 2 and np.allclose(v, 1)
    texts = [prose(i) for i in range(30)] + ["", "x" * 3000]
    whole, parts = quality_classifier.features(texts), [quality_classifier.features([t])[0] for t in texts]
    assert all((a[0] == b[0]).all() and np.allclose(a[1], b[1]) for a, b in zip(whole, parts, strict=True))


def test_ftrl_against_plain_updates():
    how = quality_classifier.Ftrl(alpha=0.3, beta=1.0, l1=0.01, l2=0.1)
    m = quality_classifier.Model(how)
    z, n = {}, {}
    r = random.Random(11)
    for _ in range(60):
        x = {r.randrange(20): r.random() for _ in range(4)} | {1 << quality_classifier.BITS: 1.0}
        y = r.randrange(2)
        m.update(np.array([*x][:-1]), np.array([*x.values()][:-1]), y)
        w = {i: 0.0 if abs(z.get(i, 0)) <= how.l1 else -(z[i] - (how.l1 if z[i] > 0 else -how.l1)) / ((how.beta + n[i] ** 0.5) / how.alpha + how.l2) for i in x}
        p = 1 / (1 + np.exp(-sum(w[i] * v for i, v in x.items())))
        for i, v in x.items():
            g = (p - y) * v
            z[i] = z.get(i, 0) + g - ((n.get(i, 0) + g * g) ** 0.5 - n.get(i, 0) ** 0.5) / how.alpha * w[i]
            n[i] = n.get(i, 0) + g * g
    assert all(abs(m.z[i] - v) < 1e-9 for i, v in z.items())


def test_classifier_held_out_accuracy(spark):
    rows = [(i, prose(i, 4) if i % 4 else " ".join(f"{w}{'*$%'[k % 3] * 3}" for k, w in enumerate(prose(i, 4).split()))) for i in range(800)]
    docs = table(spark, [*rows, (9001, None), (9002, ""), (None, "x")])
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i, _ in rows] + [(3, None, 0), (5, 7, 0)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in quality_classifier.quality_scores(docs, labels).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(out[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _ in rows) and out[None].held_out
    assert np.mean([out[i].predicted == (i % 4 > 0) for i in held]) >= 0.95
    assert 0 <= out[9001].score <= 1 and out[9001].score == out[9002].score
    none = quality_classifier.quality_scores(docs, labels.limit(0)).select("score").distinct().collect()
    assert [r.score for r in none] == [0.5]


# further cases, each by brute force


def test_every_language_prior_by_brute_force(spark):
    """identify() end to end: grouped counts, hierarchy and fusion against plain Python."""
    import collections

    from tallyforge.llm.language_id import BUCKETS, Settings, SUFFIX_LANGUAGE

    s = Settings(sample=10**6, smoothing=3.0)
    r = random.Random(21)
    hosts = {"a.fr": "fr", "b.fr": "fr", "c.de": "de", "d.org": "en", "plain": "en"}
    rows = [(i, words_of(hosts[h], i, 8), hosts[h] if r.random() < 0.8 else None, f"http://{h}/x") for i in range(90) for h in [r.choice([*hosts])]]
    rows += [(500, words_of("en", 3, 2), None, "new.fr"), (501, "x", None, "new.fr"), (502, "x", None, None), (503, None, "fr", "a.fr")]
    got = {x.doc_id: x.language for x in language_id.identify(table(spark, rows), F.col("text"), F.col("lang"), F.col("source"), s).collect()}
    names = ["de", "en", "fr"]
    bare = lambda a: None if a is None else a.replace("http://", "").split("/")[0]
    suffix = lambda h: None if h is None else h.rsplit(".", 1)[-1] if "." in h else ""
    grams = {i: language_id.trigrams([t])[0] for i, t, *_ in rows}
    fit = np.full((BUCKETS, 3), 0.05)
    for i, _, said, _ in rows:
        if said:
            np.add.at(fit[:, names.index(said)], grams[i], 1)
    logs = np.log(fit / fit.sum(0)).astype(np.float32).astype(float)
    count = lambda keep: np.array([sum(x[2] == n and keep(bare(x[3])) for x in rows) for n in names], float)
    for i, t, said, source in rows:
        own = np.array([float(n == said) for n in names])
        host = bare(source)
        wide = np.full(3, 1 / 3)
        for level in (lambda h: True, lambda h: host is not None and suffix(h) == suffix(host), lambda h: host is not None and h == host):  # noqa: B023
            c = np.maximum(count(level) - own, 0)
            wide = (c + s.smoothing * wide) / (c.sum() + s.smoothing)
        p = np.append(np.log(wide) + np.log(1 - s.undetermined), np.log(s.undetermined))
        for name, trust in ((said, s.trust), (SUFFIX_LANGUAGE.get(suffix(host)), s.suffix_trust)):
            if name:
                p[:3] += [np.log(trust) if n == name else np.log((1 - trust) / 2) for n in names]
                p[3] += np.log(1 / 3)
        n = len(grams[i])
        scale = min(1.0, s.effective / max(n, 1))
        p[:3] += scale * (logs[grams[i]].sum(0) if n else 0)
        p[3] += -np.log(BUCKETS) * n * scale
        p = np.exp(p - p.max()) / np.exp(p - p.max()).sum()
        assert got[i].lang == [*names, None][p.argmax()] and abs(got[i].confidence - p.max()) < 1e-6, (i, p)
        assert got[i].kept == (n > 0 and p.argmax() < 3 and p.max() >= s.least)
    assert collections.Counter(x[2] for x in rows)["fr"] > 10 and got[501].lang == "fr"


def test_language_clashing_names_and_shuffled_priors(spark, monkeypatch):
    rows = [(i, words_of("fr", i), "fr", "a.fr") for i in range(10)] + [(20, "x", None, "b.fr"), (21, "x", None, None)]
    df = table(spark, rows).withColumns({"language": F.lit(1), "host_n": F.lit(2)})
    one = language_id.identify(df, F.col("text"), F.col("lang"), F.col("source"))
    assert one.columns == [*df.columns, "language_"]
    monkeypatch.setattr(language_id, "BROADCAST_COUNTS", 0)
    assert sorted(map(str, language_id.identify(df, F.col("text"), F.col("lang"), F.col("source")).collect())) == sorted(map(str, one.collect()))


def test_language_of_pages(spark, tmp_path):
    html = lambda lang, i: f"<html lang='{lang}'><script>var the = 1;</script><body><p>{words_of(lang, i)}</p></body></html>"
    rows = [(i, f"http://{lang}.example.org/{i}", html(lang, i)) for i in range(30) for lang in [("en", "de", "fr")[i % 3]]] + [(90, "http://de.example.org/z", f"<p>{words_of('de', 5)}</p>"), (91, None, None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: r for r in language_id.pages(spark, str(tmp_path)).collect()}
    assert all(got[i].lang == ("en", "de", "fr")[i % 3] for i in range(30)) and got[90].lang == "de" and not got[91].kept


def test_neighbours_of_repeats_and_huge_values(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.9, 0.1]), (50, [1.0, 0.01]), (50, [1.0, 0.01]), (100, [1e200, 1e200]), (3, [1e-200, 1e-200]), (150, [1.7e308, 0.0]), (4, [5e-324, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in hnsw.nearest(df, F.col("vec_id") % 50 == 0, k=4).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert [i for i, _ in got[50]] == [1, 1, 4, 150] and [i for i, _ in got[100]][:1] == [3] and abs(got[100][0][1] - 1) < 1e-12
    assert [i for i, _ in got[150]] == [1, 1, 4, 50] and got[150][0][1] == 1.0 and all(np.isfinite(s) for x in got.values() for _, s in x)


def test_recall_of_a_full_shard_of_hard_vectors():
    """Isotropic Gaussian vectors, queries that are not in the graph, a shard as large as the bound allows."""
    r = np.random.default_rng(22)
    x, q = (r.normal(size=(n, 64)).astype(np.float32) for n in (hnsw.SHARD_ROWS, 256))
    x, q = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, q))
    best = np.argsort(-(q @ x.T), axis=1)[:, :5]
    found = hnsw.Graph.build(x).search(q, 6, hnsw.ASK)[0][:, :5]
    assert np.mean([len({*a} & {*b}) for a, b in zip(found.tolist(), best.tolist(), strict=True)]) / 5 >= 0.9
    assert hnsw.shard_count(10**6, 64) == -(-(10**6) // hnsw.SHARD_ROWS) and hnsw.shard_count(10**6, 4096) == -(-(10**6) // 4096)


def _pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_fixity_trees_stand_alone_and_descents_are_short(spark):
    """A replica's tree by hand; equal roots end the audit; clustered damage compares few nodes."""
    rows = [(i, "u", f"page {i}") for i in range(6000)]
    record = warc_fixity.warc_record(F.col("url"), F.col("html"))
    made = lambda r, n: warc_fixity.merkle_tree(warc_fixity.replica_records(_pages(spark, r), "page_id", record), n)
    levels = warc_fixity.levels_for(len(rows))
    one = made(rows, levels)
    held = one.records.orderBy("place").collect()
    assert [r.key for r in held] == list(range(6000)) and [r.offset for r in held] == [0, *itertools.accumulate(r.length for r in held)][:-1]
    marks = {r.place: r.h for r in one.records.select("place", F.xxhash64("place").alias("h")).collect()}
    node, want = "", collections.defaultdict(list)
    for r in held:
        node = r.place if marks[r.place] % (1 << warc_fixity.LEAF_BITS) == 0 else node
        assert r.node == node
        want[node].append(f"{r.place} {r.copies}")
    hashes = {n: hashlib.sha256("\n".join(x).encode()).hexdigest() for n, x in want.items()}
    assert {r.node: r.hash for r in one.levels[0].collect()} == hashes
    above = hashlib.sha256("\n".join(f"{r.node} {r.hash}" for r in sorted(one.levels[-2].collect())).encode()).hexdigest()
    assert one.root() == above == made(rows[::-1], levels).root() and one.levels[-1].count() == 1
    same = warc_fixity.compared_nodes(one, made(rows, levels))
    assert len(same) == 1 and same[0].count() == 1
    damaged = [(k, u, h + "!" if 2000 <= k < 2010 else h) for k, u, h in rows if not 4000 <= k < 4005]
    steps = warc_fixity.compared_nodes(one, made(damaged, levels))
    assert len(steps) == levels + 1 and sum(s.count() for s in steps) < 0.7 * sum(x.count() for x in one.levels) and steps[0].where("differs").count() <= 8


def test_fixity_ignores_other_columns_and_pairs_a_crowd(spark):
    rows = [(1, "u", f"r{i}") for i in range(3000)]
    a = _pages(spark, rows).withColumns({"node": F.lit(1), "digest": F.lit(2), "Place": F.lit(3)})
    b = _pages(spark, [(k, u, h + "~") for k, u, h in rows[:2999]])
    out = warc_fixity.fixity_audit(a, b, "page_id", warc_fixity.warc_record(F.col("url"), F.col("html"))).groupBy("status").count().collect()
    assert {r[0]: r[1] for r in out} == {"corrupt": 2999, "missing": 1}


def brute_maximal(words, least):
    """For each place, the longest maximal repeat that begins there."""
    n, places = len(words), collections.defaultdict(list)
    for i in range(n):
        for k in range(least, n - i + 1):
            places[tuple(words[i : i + k])].append(i)
    out = [0] * n
    for w, at in places.items():
        right, left = {words[i + len(w)] if i + len(w) < n else None for i in at}, {words[i - 1] if i else None for i in at}
        if len(at) > 1 and len(left) > 1 and len(right) > 1:
            for i in at:
                out[i] = max(out[i], len(w))
    return out


def test_maximal_repeats_against_brute_force():
    r = random.Random(3)
    for turn in range(150):
        docs = [[r.choice("abc"[: r.randint(1, 3)]) for _ in range(r.randint(0, 40))] for _ in range(4)]
        docs[1] = docs[1] * 3 if turn % 3 == 0 else docs[1]
        least = r.choice([1, 2, 3, 8])
        s = np.array([ord(x) - 97 for d in docs for x in d], np.int64)
        doc = np.repeat(np.arange(4), [len(d) for d in docs])
        order, lcp = quality_rules.common_prefixes(s, doc)
        assert list(quality_rules.maximal_repeats(s, doc, order, lcp, least)) == [x for d in docs for x in brute_maximal(d, least)]
        again = np.zeros(len(s), np.int64)
        again[order] = np.maximum(lcp, np.concatenate((lcp[1:], [0]))) if len(s) else lcp
        assert list(again) == [x for d in docs for x in brute_repeats(d)]


def test_quality_measures_against_brute_force():
    r = random.Random(23)
    names = [f.split()[0] for f in quality_rules.OUT.split(", ")]
    for _ in range(60):
        words = [r.choice("the a of to in".split()) if r.random() < 0.5 else f"w{r.randrange(60)}#"[: r.randint(2, 4)] for _ in range(r.randint(0, 160))]
        words += words[10:50] * r.randint(0, 2)
        text = "".join(w + r.choice([" ", "\n", "\t", "  "]) for w in words)
        m = dict(zip(names, quality_rules.measure([text])[0], strict=True))
        best, n = brute_maximal(words, 8), len(words)
        windows, spans = [False] * n, [False] * n
        for i in range(n - 2):
            if sum(words[j : j + 3] == words[i : i + 3] for j in range(n - 2)) > 1:
                windows[i : i + 3] = [True] * 3
        for i, k in enumerate(best):
            spans[i : i + k] = [True] * k
        lines = [x for x in text.split("\n") if x.split()]
        assert m["n_words"] == n and m["word_chars"] == sum(map(len, words)) and m["n_symbols"] == text.count("#") and m["n_dup_lines"] == len(lines) - len(set(lines))
        assert m["n_repeat_words"] == sum(windows) and m["covered_chars"] == sum(len(w) for w, x in zip(words, spans, strict=True) if x)
        assert m["base_failed"] == (n < 50 or 100 * sum(windows) > 50 * n)


def test_bpe_of_long_words_and_empty_tables(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    theirs, ours, r = tokenizers.Tokenizer.from_file(path), bpe.WordBPE.load(open(path).read()), random.Random(24)
    for n in (1023, 1024, 1025, 1026, 1027, 2049, 30_000):
        for letters in ("etaoinshrdlu", "ab", "a"):
            text = "".join(r.choice(letters) for _ in range(n))
            assert ours.encode([text])[0].tolist() == theirs.encode(text, add_special_tokens=False).ids
    df = table(spark, [(1, "a b")]).withColumns({"ids": F.lit(7), "decoded": F.lit(8), "n_tokens": F.lit(9)})
    assert bpe.with_decoded(bpe.with_tokens(df, path), path, ids="ids_").columns == [*df.columns, "ids_", "decoded_"]
    assert bpe.with_token_count(df, path).first()["n_tokens_"] == 2
    assert bpe.token_digests(empty(spark), path).count() == 0 and bpe.with_tokens(empty(spark), path).count() == 0


def test_fingerprint_keeps_a_column_of_its_name(spark):
    out = simhash.with_fingerprint(table(spark, [(1, "a")]).withColumn("fp", F.lit(3)))
    assert out.columns[-2:] == ["fp", "fp_"] and out.first().fp == 3


def test_pack_against_brute_force():
    """The choice of the longest length and the downsizing of bins, by trying all."""
    lengths = packing.Lengths(permitted=(4, 8, 16), per_bin=2)
    r = random.Random(25)
    for _ in range(100):
        sizes = sorted((r.randint(1, 16) for _ in range(r.randint(0, 20))), reverse=True)
        tried = []
        for n in (1, 2, 3):
            if not sizes or (4, 8, 16)[n - 1] >= sizes[0]:
                bins = packing.best_fit(sizes, (4, 8, 16)[:n], lengths)
                tried.append(sum(min(c for c in (4, 8, 16) if c >= sum(sizes[i] for i in b)) + 2 for b in bins))
        got = packing.pack(sizes, lengths)
        assert sum(c + 2 for c, _ in got) == min(tried) and all(c == min(x for x in (4, 8, 16) if x >= sum(sizes[i] for i in b)) for c, b in got)


def test_packed_sequences_hold_the_tokens(spark, odd):
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    ours = bpe.WordBPE.load(open(path).read())
    docs = odd.withColumns({"n_tokens": F.lit(1), "ids": F.lit(2)})
    small = packing.Lengths(permitted=(64, 256, 1024))
    pieces = {(r.bin_id, r.bin_offset): r for r in packing.pack_texts(docs, path, small).collect()}
    ids = {(r.doc_id, len(i)): i.tolist() for r in docs.select("doc_id", "text").collect() for i in ours.encode([r.text or ""])}
    total = 0
    for b in packing.packed_sequences(docs, path, small).collect():
        assert len(b.tokens) <= b.capacity
        for x in b.starts:
            p = pieces[b.bin_id, x.offset]
            whole = next(i for (d, _), i in ids.items() if d == x.doc_id and i[p.first_token : p.first_token + p.n_tokens] == list(b.tokens[x.offset : x.offset + p.n_tokens]))
            total += p.n_tokens
            assert whole and p.doc_id == x.doc_id
    assert total == sum(len(ours.encode([r.text or ""])[0]) for r in docs.select("text").collect())


def test_kd_tree_by_hand(spark):
    """Every cut lies in its node's widest dimension and parts its bytes as near to their shares as rows allow."""
    r = random.Random(26)
    rows = [(i, r.choice([1, 2, 2, 2, 9]), r.gauss(0, 3), r.choice([5, 5, 60])) for i in range(700)]
    df = spark.createDataFrame([(i, float(x), y, s) for i, x, y, s in rows], "id long, x double, y double, size long").withColumns({"_node": F.lit(7), "_size": F.lit(8), "_tie": F.lit(9), "shard": F.lit(0)})
    out, made = kd_sharding.kd_tree(df, ["x", "y"], "size", ["id"], shards=6)
    assert out.columns == [*df.columns, "shard_"]
    ties = {t.id: t.t for t in df.select("id", F.pmod(F.xxhash64("id"), F.lit(kd_sharding._TIE)).alias("t")).collect()}
    everyone = [((x, y), s, ties[i], i) for i, x, y, s in rows]
    spread = [np.std([e[0][k] for e in everyone]) for k in (0, 1)]
    shards, todo = {}, [(1, 0, 6, everyone)]
    while todo:
        n, a, b, here = todo.pop()
        if b - a == 1:
            shards |= {e[3]: a for e in here}
            continue
        c, middle = made[n], a + -(-(b - a) // 2)
        wide = [np.std([e[0][k] for e in here]) / spread[k] for k in (0, 1)]
        assert abs(wide[c.dim] - max(wide)) < 1e-9
        left = [e for e in here if (e[0][c.dim], e[2]) < (c.value, c.tie)]
        right = [e for e in here if (e[0][c.dim], e[2]) >= (c.value, c.tie)]
        want = (middle - a) / (b - a) * sum(e[1] for e in here)
        assert abs(sum(e[1] for e in left) - want) <= 60
        todo += [(2 * n, a, middle, left), (2 * n + 1, middle, b, right)]
    assert {x.id: x.shard_ for x in out.collect()} == shards
    by_bytes = kd_sharding.kd_shards(df.drop("shard"), ["x", "y"], "size", ["id"], target_bytes=1000).groupBy("shard").agg(F.sum("size").alias("m")).collect()
    total = sum(e[1] for e in everyone)
    assert len(by_bytes) == -(-total // 1000) and max(x.m for x in by_bytes) <= 1000 + 4 * 60


def test_classifier_awkward_rows(spark, odd):
    rows = [(i, prose(i, 3) if i % 2 else prose(i, 3).upper()) for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    docs = table(spark, rows).union(odd.withColumn("doc_id", F.col("doc_id") + 1000)).withColumns({"score": F.lit(1), "y": F.lit(2), "_h": F.lit(3)})
    out = quality_classifier.quality_scores(docs, labels.withColumn("text", F.lit("x"))).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if r.doc_id in (1001, 1002, 1003)}) == 1 and len({r.score for r in out if r.doc_id in (1004, 1005)}) == 1
    assert quality_classifier.quality_scores(empty(spark), labels).count() == 0
    scored = quality_classifier.with_score(docs, np.zeros((1 << quality_classifier.BITS) + 1))
    assert scored.columns[-1] == "score_" and {r.score for r in scored.collect()} == {1}


def test_scopes_leave_nothing_behind(spark):
    """Intermediate tables are deleted and the session's settings are as they were, whichever query ran."""
    import os

    from tallyforge.llm import queries
    from tallyforge.llm.common import scope, shared_dir

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    at, before, setting = shared_dir(spark), None, spark.conf.get(name, None)
    before = set(os.listdir(at))
    for q in ("op1_substring_dedup", "op3_warc_merkle_fixity", "op5_simhash_near_dedup", "op9_kd_tree_sharding"):
        with scope(spark):
            assert queries.QUERIES[q](spark, "/root/testdata/sf0.001").count() > 0 and set(os.listdir(at)) > before
        assert set(os.listdir(at)) == before and spark.conf.get(name, None) == setting
