"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns, for every operator and pipeline stage; held-out accuracy."""

import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from mesospark.llm import ann, decontaminate, langid, licenses, linededup, mixing, neardup, pii, quality, toxicity
from mesospark.llm.queries import OPERATORS

DATA = "/root/testdata/sf0.01"
CLASHING = ["score", "predicted", "tokens", "p", "rate", "spans", "items", "n_words", "n_hit", "h", "key", "value", "other", "row", "node", "bands", "k1", "k2", "class_id", "id", "common", "_found", "_gone", "_cut", "_id", "site", "names", "entity", "n_entities", "license", "list", "part", "v", "rank", "n_lines", "n_removed", "_text"]
VOCABULARY = [f"{a}{b}" for a in ("ta", "me", "ro", "li", "su", "ka") for b in ("no", "vel", "rim", "dos", "pan", "qui")]


def words(rng, n):
    return " ".join(VOCABULARY[i] for i in rng.randint(0, len(VOCABULARY), n))


@pytest.fixture(scope="module")
def odd(spark):
    rng = np.random.RandomState(1)
    rows = [(i, words(rng, 40) + (" vile nasty rude vile" if i % 4 == 0 else ""), "en" if i % 2 else "xx", f"s{i % 7}", 0) for i in range(80)]
    long = "\n".join(words(rng, 20) for _ in range(12_000))  # over a megabyte
    rows += [(100, None, None, None, None), (101, "", "en", "s1", 0), (102, "...", None, "s2", 3), (103, long, "en", "s3", 0), (104, "x" * 300_000, "en", "s4", 0), (0, rows[0][1], "xx", "s0", 0), (0, rows[0][1], "xx", "s0", 0), (None, "no id at all", "en", "s1", 5), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    return docs.withColumns({c: F.lit("clash") for c in CLASHING})


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, int(i % 3 > 0), int(i % 4 == 0)) for i in range(80)] + [(None, 1, 1), (3, None, None), (5, 1, 0), (5, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int").withColumns({c: F.lit("clash") for c in ("value", "text", "lang", "score")})


@pytest.fixture(scope="module")
def benchmark(spark, odd):
    text = odd.filter("doc_id = 3").first().text
    rows = [(1, text), (1, text), (2, None), (None, "zz"), (3, ""), (4, "tano tano tano")]
    return spark.createDataFrame(rows, "item_id long, text string").withColumn("spans", F.lit("clash"))


@pytest.mark.parametrize("empty", [False, True])
def test_classifiers(odd, labels, empty):
    docs, known = (odd.limit(0), labels.limit(0)) if empty else (odd, labels)
    n = docs.count()
    for got in (quality.score_quality(docs, quality.fit_quality(docs, known)), toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, known)), toxicity.score_toxicity(odd.limit(0), toxicity.fit_toxicity(docs, known))):
        assert got.filter("score >= 0 AND score <= 1 AND predicted IN (0, 1)").count() in (n, 0) and got.count() in (n, 0)
    found = langid.predict_languages(docs, langid.fit_languages(docs, passes=2))
    assert found.count() == n and found.filter("lang_pred IS NULL OR score < 0 OR score > 1").count() == 0
    if not empty:
        assert {r.lang_pred for r in found.filter("doc_id IN (100, 101, 102)").collect()} == {"und"}
        with pytest.raises(ValueError, match="more than 1 languages"):
            langid.fit_languages(docs, max_languages=1)
        with pytest.raises(ValueError, match="rename"):
            toxicity.score_toxicity(docs, toxicity.ToxicityModel(None, 0.0), keep=["doc_id", "score"])


@pytest.mark.parametrize("empty", [False, True])
def test_mixing(odd, labels, empty):
    docs, known = (odd.limit(0), labels.limit(0)) if empty else (odd, labels)
    got = mixing.mix(docs, known, F.col("quality").cast("string"), keep=["doc_id", "text"]).collect()
    assert len(got) <= docs.count() and all(r.rate >= 0 and r.expected_tokens == r.rate * r.tokens for r in got)
    assert empty or sum(r.doc_id == 0 for r in got) == 3


def test_mixing_equals_projected_gradient_in_numpy(odd, labels):
    model = mixing.fit_domains(odd, labels, F.col("quality").cast("string"))
    soft = mixing.posteriors(odd.filter("doc_id < 90"), model).persist()
    targets = {"0": 0.9, "1": 0.1}
    solved = mixing.solve(soft, model, targets, passes=200, tolerance=1e-9)
    rows = soft.collect()
    p, t = np.array([r.p for r in rows]), np.array([r.tokens for r in rows], float)
    wanted = np.array([targets[d] for d in model.domains]) * t.sum()
    scale, r = 1 / (t @ p), np.ones(len(t))
    step = 1 / np.linalg.eigvalsh(np.sqrt(scale)[:, None] * (p.T @ (p * t[:, None])) * np.sqrt(scale)).max()
    for _ in solved.gradients:
        r = np.maximum(0, r - step * p @ (scale * ((t * r) @ p - wanted)))
    assert np.allclose(mixing._rates(p, solved.gradients), r, atol=1e-9) and solved.gap == pytest.approx(np.abs((t * r) @ p - wanted).max() / t.sum(), abs=1e-9)


@pytest.mark.parametrize("empty", [False, True])
def test_decontamination(odd, benchmark, empty):
    docs = odd.limit(0) if empty else odd
    got = decontaminate.judged(decontaminate.find_contamination(docs, benchmark)).collect()
    assert len(got) == docs.count()
    items = [("1", odd.filter("doc_id = 3").first().text), ("4", "tano tano tano")]
    for r in got:
        if r.doc_id != 103:
            assert (r.n_words, r.n_hit, r.items_sha256) == decontaminate.brute_force(r.text, items)
    if not empty:
        assert next(r for r in got if r.doc_id == 103).n_words == 240_000 and next(r for r in got if r.doc_id == 3).contaminated
        with pytest.raises(ValueError, match="rename"):
            decontaminate.find_contamination(docs, benchmark, keep=["doc_id", "spans"])
        common = decontaminate.find_contamination(docs.filter("doc_id = 103"), benchmark.sparkSession.createDataFrame([(1, "tano"), (2, "sudos")], "item_id long, text string"))
        row = decontaminate.judged(common).first()
        assert row.n_hit == sum(w in ("tano", "sudos") for w in row.text.split())


@pytest.mark.parametrize("limit", [1 << 18, 0])
def test_lines(odd, limit):
    got = linededup.remove_boilerplate(odd, min_sites=3, broadcast_limit=limit)
    assert got.count() == odd.count() and set(got.columns) == set(odd.columns)
    assert got.filter("doc_id = 103").first().n_lines == 12_000 and got.filter("n_removed > 0").count() == 0
    assert linededup.remove_boilerplate(odd.limit(0)).count() == 0
    shared = odd.filter("doc_id < 20").withColumn("text", F.concat(F.lit("common line\n"), "text"))
    cut = linededup.remove_boilerplate(shared, min_sites=3, broadcast_limit=limit)
    assert cut.filter("n_removed = 1 AND n_lines = 2 AND NOT contains(text, 'common')").count() == shared.count()


def test_near_duplicates_keep_one_row_of_repeated_ids(odd, spark):
    classes = neardup.near_duplicate_classes(odd)
    assert classes.count() == odd.filter("doc_id IS NOT NULL").count()
    kept = neardup.keep_one(odd)
    assert kept.filter("doc_id = 0").count() == 1 and kept.filter("doc_id IS NULL").count() == 2 and set(kept.columns) == set(odd.columns)
    assert kept.filter("doc_id IN (100, 101, 102, 103, 104)").count() == 5
    text = words(np.random.RandomState(7), 60)
    other = words(np.random.RandomState(8), 60)
    rows = [(1, text), (1, text), (1, text), (2, text), (3, other), (4, other + " x"), (5, text), (5, other)]
    one = neardup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r.doc_id for r in one] == [1]  # document 5 has both texts and ties the classes together


def test_near_duplicates_find_planted_pairs_of_unevenly_repeated_text(spark):
    rng, rows = np.random.RandomState(13), []
    for i in range(60):
        base = [f"w{rng.randint(10**6)}" for _ in range(104)]
        changed = base[:-7] + [f"v{rng.randint(10**6)}" for _ in range(7)]  # similarity 93 / 107
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join([*changed[:50] * 60, *changed[50:]]) if i % 2 else " ".join(changed))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    near = {2 * i for i in range(60) if len(sets[2 * i] & sets[2 * i + 1]) >= 0.8 * len(sets[2 * i] | sets[2 * i + 1])}
    got = {r.doc_id: r.class_id for r in neardup.near_duplicate_classes(docs).collect()}
    assert len(near) >= 55 and {i for i in got if i % 2 == 0 and got[i + 1] == i} == near


def test_search(spark):
    rng = np.random.RandomState(2)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(40)] + [(7, None), (50, []), (51, [0.0] * 6), (52, [float("inf")] * 6), (None, [1.0] * 6), (3, rng.normal(size=6).tolist())]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("clash") for c in ("id", "v", "list", "part", "score", "rank")})
    found = ann.usable(vectors)
    assert found.count() == 40
    got = ann.nearest(found, found.filter("id % 10 = 0")).collect()
    assert len(got) == 20 and ann.nearest(found.limit(3), found.limit(1)).count() <= 2
    assert ann.nearest(found.limit(0), found.limit(0)).count() == 0


def test_licenses_and_surrogates(odd):
    assert licenses.scan_licenses(odd).filter("size(licenses) = 0").count() == odd.count() and licenses.scan_licenses(odd.limit(0)).count() == 0
    new = pii.pseudonymise(odd, b"k", keep=("doc_id", "text", "names", "key"))
    assert new.count() == odd.count() and new.filter("n_entities > 0").count() == 0 and pii.pseudonymise(odd.limit(0), b"k").count() == 0
    long = odd.filter("doc_id = 103").withColumn("text", F.concat("text", F.lit(" Mrs Ada Byron 10.0.0.1 "), "text"))
    row = pii.pseudonymise(long, b"k").first()
    assert row.n_entities == 2 and "Ada" not in row.text and "10.0.0.1" not in row.text
    with pytest.raises(ValueError, match="rename"):
        pii.pseudonymise(odd, b"k", keep=("text", "n_entities"))


@pytest.mark.parametrize("k", range(5))
def test_pipeline_stages(spark, odd, labels, benchmark, tmp_path, k):
    odd.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    labels.select("doc_id", "quality", "toxic").write.parquet(f"{tmp_path}/labels.parquet")
    benchmark.select("item_id", "text").write.parquet(f"{tmp_path}/benchmark.parquet")
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, odd, str(tmp_path))
    assert set(corpus_pipeline.COLUMNS) <= set(out.columns) and (name == "mixing" or set(out.columns) == set(corpus_pipeline.COLUMNS))
    assert 0 < out.count() <= odd.count() and stage(spark, odd.limit(0), str(tmp_path)).count() == 0
    if name in ("line_dedup", "near_duplicates"):
        assert out.filter("doc_id IS NULL").count() == 2


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_held_out_accuracy(spark):
    known = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang").collect()}
    fold = lambda i, n: zlib.crc32(str(i).encode()) % n
    rows = OPERATORS["op1_quality"](spark, DATA).collect()
    assert all(r.held_out == (fold(r.doc_id, 5) == 0) for r in rows)
    own = [r for r in rows if r.held_out and r.doc_id in known and known[r.doc_id].quality is not None]
    assert np.mean([r.predicted == known[r.doc_id].quality for r in own]) >= 0.93
    rows = OPERATORS["op2_language"](spark, DATA).collect()
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in rows if r.held_out]) >= 0.97
    rows = {r.doc_id: r for r in OPERATORS["op3_toxicity"](spark, DATA).collect()}
    own = [rows[i] for i in known if known[i].toxic is not None]
    clean = [r.predicted for r in own if not known[r.doc_id].toxic]
    toxic = [r for r in own if known[r.doc_id].toxic]
    assert np.mean(clean) <= 0.02 and np.mean([r.predicted for r in toxic if r.held_out]) >= 0.7
    assert np.mean([r.predicted for r in toxic if lang[r.doc_id] != "en"]) >= 0.7
