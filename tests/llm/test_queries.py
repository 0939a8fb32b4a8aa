"""Queries of the subpackage against their SQL at a small size, and the pipeline against brute force."""

import os
import re

import duckdb
import pytest

from mesospark.llm import decontaminate, toxicity
from mesospark.llm.queries import OPERATORS, oracle_sql

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = OPERATORS[name](spark, DATA).toPandas()
    want = con.sql(oracle_sql()[name]).df()[list(got.columns)]
    by = list(got.columns)
    assert got.sort_values(by, ignore_index=True).astype(str).equals(want.sort_values(by, ignore_index=True).astype(str))


def _brute_force(docs: dict, benchmark: list) -> dict:
    """The texts that line dedup, near-duplicates and decontamination leave of ``doc_id -> (text, source)``."""
    sites: dict = {}
    for text, source in docs.values():
        for line in {x.strip(" ") for x in (text or "").split("\n")} - {""}:
            sites.setdefault(line, set()).add(source)
    texts = {}
    for i, (text, _) in docs.items():
        lines = (text or "").split("\n")
        worded = [x for x in lines if x.strip(" ")]
        common = [x for x in worded if len(sites[x.strip(" ")] - {None}) >= 5]
        texts[i] = "\n".join(x for x in lines if x not in common) if 0 < len(common) < len(worded) else text
    sets = {}
    for i, text in texts.items():
        w = re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    label, ids = {i: i for i in sets}, sorted(sets)
    near = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for _ in ids:
        before = dict(label)
        for a, b in near:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            break
    kept = {}
    for i in ids:
        n, hit, _ = decontaminate.brute_force(texts[i], benchmark)
        if label[i] == i and not (hit and 20 * hit >= n):
            kept[i] = texts[i]
    return kept


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_pipeline_equals_brute_force(spark):
    import corpus_pipeline

    documents, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    rejected = {r.doc_id for r in toxicity.score_toxicity(documents, toxicity.fit_toxicity(documents, labels)).filter("predicted = 1").collect()}
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect() if r.item_id is not None and r.text]
    want = _brute_force({r.doc_id: (r.text, r.source) for r in documents.collect() if r.doc_id not in rejected}, items)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, DATA).collect()}
    assert len(want) < documents.count() - len(rejected)
    # the last stage gives each document a rate, and one with rate 0 leaves
    assert set(got) <= set(want) and len(got) >= 0.9 * len(want)
    assert all(r.text == want[i] and (r.rate > 0 or not r.tokens) for i, r in got.items())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_pipeline_keeps_columns(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, DATA)
    ids = [r.doc_id for r in out.select("doc_id").collect()]
    assert 0 < len(ids) == len(set(ids)) and {"rate", "text", "domain"} <= set(out.columns)
