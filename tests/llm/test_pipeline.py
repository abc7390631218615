"""The pipeline's stages against brute force on a small table."""

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from tallyforge.llm.bpe import WordBPE  # noqa: E402
from tests.llm.test_llm import brute_dedup, brute_fingerprint, prose, table  # noqa: E402


def test_stages_on_planted_cases(spark, tmp_path):
    from tallyforge.llm import quality_rules

    shared = prose(999, 9)
    rows = [(i, prose(i, 14), "en", "src1", 1) for i in range(30)]
    rows += [(40, prose(3, 14), "en", "src1", 1), (41, "too short", "en", "src1", 1), (42, "\n".join(["the same line again"] * 40), "en", "src1", 1), (43, None, "en", None, None)]
    rows += [(50 + k, prose(70 + k, 10) + "\n" + shared, "en", "src2", 1) for k in range(3)]
    docs = table(spark, rows)
    out = []
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        path = str(tmp_path / name)
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        out.append((name, docs))
    good = [r for r in rows if quality_rules.measure([r[1]])[0][-1]]
    assert {r.doc_id for r in out[0][1].collect()} == {r[0] for r in good} == {r[0] for r in rows} - {41, 42, 43}
    assert out[1][1].count() == len(good)
    fps = {}
    for r in good:
        fps.setdefault(brute_fingerprint(r[1]), r[0])
    near = {min(j for g, j in fps.items() if (f ^ g).bit_count() <= 2) for f in fps}
    assert {r.doc_id for r in out[2][1].collect()} == near and 40 not in near
    texts = brute_dedup([(r[0], r[1]) for r in good if r[0] in near])
    assert {r.doc_id: r.text for r in out[3][1].collect()} == {k: t for k, t in texts.items() if t.split()}
    assert all(d.columns == ["doc_id", "text", "lang", "source", "n_chars"] for _, d in out[:4])
    packed = out[4][1].collect()
    tokens = WordBPE.load(open(pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")).read())
    assert {r.doc_id: r.n_tokens for r in packed} == {k: len(tokens.encode([t])[0]) for k, t in texts.items() if t.split()}


def test_run_on_an_empty_table(spark, tmp_path):
    table(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_copies_from_similarity_0_8(spark):
    """Copies of similarity 0.8 to 0.95 go, in pairs and in one large group; less similar ones stay."""
    import random

    from tallyforge.llm import near_copies

    r = random.Random(12)
    shingles = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    docs, gone, edits = [], set(), 0
    for i in range(80):
        words = [f"w{r.randrange(10**6)}" for _ in range(300)]
        copy = list(words)
        for at in r.sample(range(0, 300, 5), r.randint(2, 9)):
            copy[at] = f"x{edits}"
            edits += 1
        a, b = " ".join(words), " ".join(copy)
        docs += [(2 * i, a), (2 * i + 1, b)]
        if len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b)) >= 0.8:
            gone.add(2 * i + 1)
    crowd = [f"c{k}" for k in range(300)]
    for i in range(60):
        docs.append((1000 + i, " ".join([*crowd[: i * 4], f"y{i}", *crowd[i * 4 + 1 :]])))
    gone |= {1001 + i for i in range(59)}
    assert 30 < len(gone - set(range(1000, 2000))) < 80
    kept = {x.doc_id for x in pipeline.simhash_near_dedup(spark, table(spark, docs), "").collect()}
    assert {d for d, _ in docs} - kept == gone
    assert near_copies.similarity(near_copies.shingle_set(None), near_copies.shingle_set(" ")) == 1.0


def test_run_on_awkward_rows(spark, tmp_path):
    """Nulls, empty, repeated and very long texts, clashing names: nothing crashes, and what is good is packed."""
    import os

    from pyspark.sql import functions as F

    from tallyforge.llm.common import scope, shared_dir
    from tests.llm.test_llm import rough

    docs = rough(spark).withColumns({"lang": F.coalesce("lang", F.lit("en")), "_count": F.lit(1), "_removed": F.lit(2), "n_removed": F.lit(3), "kept": F.lit(True), "fp": F.lit(4), "h": F.lit(5), "language": F.lit("x")})
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    before = set(os.listdir(shared_dir(spark)))
    with scope(spark):
        got = pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == {4, 7, None} and set(os.listdir(shared_dir(spark))) == before
    assert sum(r.n_tokens for r in got if r.doc_id == 4) > 20_000 and {r.copy for r in got if r.doc_id == 7} == {0, 1}
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in pipeline.STAGES[:4]:
        docs = stage(spark, docs, str(tmp_path))
    assert docs.columns == spark.read.parquet(str(tmp_path / "documents.parquet")).columns


def test_crowded_bucket_loses_no_link(spark):
    """All texts in one bucket: chains whose ends no leader is like, pairs, and texts that are like no other."""
    import itertools
    import random

    from pyspark.sql import functions as F

    from tallyforge.llm import near_copies
    from tallyforge.llm.components import connected_components

    r = random.Random(5)
    texts = []
    for chain, length in enumerate([40, 25, 2, 2, 2, 1, 1, 1]):
        words = [f"k{chain}w{i}" for i in range(120)]
        for step in range(length):
            texts.append(" ".join(words))
            words = words[3:] + [f"k{chain}n{step}x{i}" for i in range(3)]
    near = [[f"t{i}" for i in range(100)] for _ in range(6)]
    for i, words in enumerate(near):  # similar to each other, but below 0.8
        for at in r.sample(range(100), 3):
            words[at] = f"u{i}at{at}"
    texts += [" ".join(w) for w in near]
    docs = table(spark, list(enumerate(texts)))
    rows = near_copies.with_bands(docs.select("doc_id", "text"))
    classes = rows.select("fp", F.struct("doc_id", "h").alias("who"), "size", F.array(F.lit(1).cast("long")).alias("bands"), "bits").cache()
    ids = {x.fp: x.who.doc_id for x in classes.collect()}
    sets = [near_copies.shingle_set(t) for t in texts]
    want = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if near_copies.similarity(sets[a], sets[b]) >= 0.8:
            old, new = want[b], want[a]
            want = [new if w == old else w for w in want]
    got = list(range(len(texts)))
    for x in connected_components(near_copies.similar_links(docs.select("doc_id", "text"), classes)).collect():
        got[ids[x.node]] = ids[x.component]
    group = lambda of: {frozenset(i for i, w in enumerate(of) if w == v) for v in of}
    assert group(got) == group(want) and 8 < len(group(want)) < 20


def test_near_dedup_goes_by_simhash_and_few_pairs(spark, monkeypatch):
    """The stage's bands are bits of a SimHash, which follows the angle of two sets; a group costs few pairs a member."""
    import numpy as np

    from tallyforge.llm import near_copies, simhash

    r = np.random.default_rng(3)
    a, b = (r.integers(0, 1 << 63, 400, dtype=np.uint64) for _ in range(2))
    long = lambda s: simhash.long_fingerprint(np.unique(s))
    for shared in (0, 200, 356, 400):  # cosine: shared / 400
        apart = np.mean(long(a) != long(np.concatenate([a[:shared], b[shared:]])))
        assert abs(apart - np.arccos(shared / 400) / np.pi) < 0.03
    calls = []
    real = near_copies.long_fingerprint
    monkeypatch.setattr(near_copies, "long_fingerprint", lambda s: calls.append(1) or real(s))
    near_copies.bands(a)
    assert calls
    monkeypatch.undo()
    words = [f"g{i}" for i in range(300)]
    docs = table(spark, [(i, " ".join([*words[:i], f"z{i}", *words[i + 1 :]])) for i in range(150)])
    tried = []
    check = near_copies.verified
    monkeypatch.setattr(near_copies, "verified", lambda d, c, pairs: tried.append(pairs.count()) or check(d, c, pairs))
    assert [x.doc_id for x in near_copies.keep_distinct(docs).collect()] == [0]
    assert 149 <= sum(tried) <= 600  # all pairs: 11,175


def test_bands_meet_near_copies_and_little_else():
    """Pairs of similarity 0.8 share a band; of unlike sets few do, so that chance meetings don't grow with the corpus."""
    import numpy as np

    from tallyforge.llm import near_copies

    r = np.random.default_rng(8)
    drawn = lambda n: r.integers(0, 1 << 63, n, dtype=np.uint64)
    missed = 0
    for i in range(400):
        own = (1, 5, 30)[i % 3]
        shared = drawn(8 * own)
        a, b = (np.unique(np.concatenate([shared, drawn(own)])) for _ in range(2))
        assert near_copies.similarity(a, b) == 0.8
        missed += not (near_copies.bands(a)[0] == near_copies.bands(b)[0]).any()
    assert missed <= 2
    held = np.array([near_copies.bands(drawn(60))[0] for _ in range(2500)])
    met = sum(len(v) - len(np.unique(v)) for v in held.T)
    assert met <= 15  # of 3.1 million pairs


def test_texts_just_below_the_similarity_are_rarely_compared(spark, monkeypatch):
    """A crowd of similarities about 0.68 shares buckets, and its bits tell its pairs apart before texts are fetched."""
    import random

    from tallyforge.llm import near_copies

    r = random.Random(4)
    texts = []
    for i in range(120):
        words = [f"b{k}" for k in range(300)]
        for at in r.sample(range(0, 300, 5), 6):
            words[at] = f"e{i}x{at}"
        texts.append(" ".join(words))
    sets = [near_copies.shingle_set(t) for t in texts]
    near = [(a, b) for a in range(120) for b in range(a) if near_copies.similarity(sets[a], sets[b]) >= 0.8]
    tried = []
    check = near_copies.verified
    monkeypatch.setattr(near_copies, "verified", lambda d, c, pairs: tried.append(pairs.count()) or check(d, c, pairs))
    kept = {x.doc_id for x in near_copies.keep_distinct(table(spark, list(enumerate(texts)))).collect()}
    assert kept == set(range(120)) - {a for a, _ in near}
    assert sum(tried) <= 840  # 7 a text; all pairs: 7,140


def test_near_dedup_leaves_texts_in_place(spark):
    """While few documents go, the stage's end moves no texts."""
    docs = table(spark, [(i, prose(i % 9, 14)) for i in range(12)])
    kept = pipeline.simhash_near_dedup(spark, docs, "")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    assert {x.doc_id for x in kept.collect()} == set(range(9))
