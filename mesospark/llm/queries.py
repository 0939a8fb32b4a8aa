"""Queries of the training-data operators over the given tables, and their SQL."""

from pyspark.sql import functions as F

from mesospark.llm import align, ann, decontaminate, fingerprints, interactions, langid, licenses, linededup, mixing, neardup, pii, quality, toxicity
from mesospark.llm.blocks import part
from mesospark.plans.lineage import cut

#: Stands in where the session names no ``mesospark.pii.key``, as in tests.
KEY = "mesospark surrogate key"
#: Folder of the public tokenizers where the session names no ``mesospark.tokenizers``.
TOKENIZERS = "/opt/tokenizers"


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _held(folds, held_out):
    return F.coalesce(part("doc_id", folds) == held_out, F.lit(False)).alias("held_out")


def op1_quality(spark, sf_dir):
    documents = _table(spark, sf_dir, "documents")
    model = quality.fit_quality(documents, _table(spark, sf_dir, "labels"))
    return quality.score_quality(documents, model).select("doc_id", _held(5, 0), "score", "predicted")


def op2_language(spark, sf_dir):
    documents = _table(spark, sf_dir, "documents")
    model = langid.fit_languages(documents)
    return langid.predict_languages(documents, model).select("doc_id", _held(3, 1), "lang_pred", "score")


def op3_toxicity(spark, sf_dir):
    documents = _table(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(documents, _table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(documents, model).select("doc_id", _held(3, 1), "score", "predicted")


def op4_decontaminate(spark, sf_dir):
    found = decontaminate.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return decontaminate.judged(found).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def labelled_domains(spark, sf_dir):
    """Rows of the labelled table with their language; a domain is a language and a quality class."""
    labels, documents = _table(spark, sf_dir, "labels"), _table(spark, sf_dir, "documents")
    return labels.join(documents.select("doc_id", "lang").filter("lang IS NOT NULL"), "doc_id")


def domain():
    return F.concat_ws(":", "lang", F.col("quality").cast("string"))


def op5_mix(spark, sf_dir):
    mixed = mixing.mix(_table(spark, sf_dir, "documents"), labelled_domains(spark, sf_dir), domain())
    return mixed.select("doc_id", "domain", "tokens", "rate", "expected_tokens")


def op6_nearest(spark, sf_dir):
    vectors = cut(ann.usable(_table(spark, sf_dir, "embeddings")))
    return ann.nearest(vectors, vectors.filter("id % 50 = 0")).select(F.col("query_id").cast("long").alias("query_id"), "rank", F.col("vec_id").cast("long").alias("vec_id"), "score")


def op7_lines(spark, sf_dir):
    clean = linededup.remove_boilerplate(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return clean.select("doc_id", "n_lines", "n_removed", F.md5("text").alias("text_md5"))


def op8_licenses(spark, sf_dir):
    found = licenses.scan_licenses(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.array_join("licenses", ",").alias("licenses"), "license", F.round("score", 6).alias("score"), "n_lines")


def op9_near_duplicates(spark, sf_dir):
    return neardup.near_duplicate_classes(_table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op10_pii(spark, sf_dir):
    key = spark.conf.get("mesospark.pii.key", KEY).encode()
    return pii.pseudonymise(_table(spark, sf_dir, "documents"), key).select("doc_id", "n_entities", "text")


def op11_align(spark, sf_dir):
    folder = spark.conf.get("mesospark.tokenizers", TOKENIZERS)
    return align.pair_statistics(_table(spark, sf_dir, "documents"), f"{folder}/byte_bpe_50k.json", f"{folder}/piece_bpe_32k.model")


def op12_interactions(spark, sf_dir):
    return interactions.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_fingerprints(spark, sf_dir):
    found = fingerprints.compare_versions(_table(spark, sf_dir, "documents"))
    written = [fingerprints.as_text(F.col(c)).alias(name) for c, name in (("cells", "fingerprint"), ("edited_cells", "edited_fingerprint"))]
    return found.select("doc_id", "n_chars", "edited_sha256", *written, "near_edited", "near_next")


OPERATORS = {f.__name__: f for f in (op1_quality, op2_language, op3_toxicity, op4_decontaminate, op5_mix, op6_nearest, op7_lines, op8_licenses, op9_near_duplicates, op10_pii, op11_align, op12_interactions, op13_fingerprints)}


def oracle_sql() -> dict[str, str]:
    return {"op4_decontaminate": OP4_SQL, "op12_interactions": interactions.ORACLE, "op7_lines": linededup.ORACLE.format(documents="documents") + " SELECT d.doc_id, coalesce(p.n_lines, 0) AS n_lines, CASE WHEN p.cut THEN p.g ELSE 0 END AS n_removed, md5(CASE WHEN p.cut THEN coalesce(p.kept, '') ELSE d.text END) AS text_md5 FROM documents d LEFT JOIN per p ON d.doc_id = p.doc_id"}


OP4_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
win AS (SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS k FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
pos AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS k FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)),
hit AS (SELECT p.doc_id, p.i, p.n, w.item FROM pos p JOIN win w ON p.n = w.n AND p.k = w.k),
cov AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items, sha256(coalesce(t.s, '')) AS items_sha256,
       coalesce(c.n_hit, 0) > 0 AND 20 * coalesce(c.n_hit, 0) >= len(d.w) AS contaminated
FROM dw d LEFT JOIN cov c ON d.doc_id = c.doc_id LEFT JOIN its t ON d.doc_id = t.doc_id
"""
