"""Line deduplication by distinct-site spread.

A HyperLogLog sketch of the sites of each line hash is merged by aggregation.
Lines whose estimate is near the threshold get an exact distinct count; lines
on at least ``min_sites`` sites are boilerplate and leave the documents. A
document all of whose lines are boilerplate is a copy of others rather than a
page with a template round it, and keeps its text; any line of its own, however
short, makes it a page.

Defined cases: lines are parted by newlines and compared without outer blanks;
blank lines are never boilerplate; a null source is no site; a null text has no
lines and stays null; a null id is left as it is; repeated rows are treated
alike; other columns pass through.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mesospark.plans.lineage import cut

LG_K = 9
NEAR = 4 * 1.04 / 2 ** (LG_K / 2)  # four standard errors of the estimate


def _hash(line):
    """128 bits of a line."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def _lines(text):
    return F.transform(F.split(text, "\n"), lambda x: F.trim(x))


def line_sites(documents: DataFrame) -> DataFrame:
    """``doc_id, site, h``: the distinct hashes of each document's lines that are not blank."""
    hashes = F.array_distinct(F.transform(F.filter(_lines(F.col("text")), lambda x: x != ""), _hash))
    return documents.filter("doc_id IS NOT NULL").select("doc_id", F.col("source").alias("site"), F.explode(hashes).alias("h"))


def _met(rows: DataFrame, lines: DataFrame, broadcast_limit: int, salts: int) -> DataFrame:
    """The rows whose ``h`` is among the lines (a cut table of distinct hashes).

    A line may be in a great many rows. So many hashes as the limit are small
    enough to send to every task; more are joined by hash, each of them once for
    each of a few salts, and a row's other columns say which one it meets.
    """
    if lines.count() <= broadcast_limit:
        return rows.join(F.broadcast(lines), "h")
    salted = lines.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salt = F.pmod(F.xxhash64(*[c for c in rows.columns if c != "h"]), F.lit(salts)).cast("int")
    return rows.withColumn("salt", salt).join(salted, ["h", "salt"]).drop("salt")


def boilerplate_lines(documents: DataFrame, min_sites: int, broadcast_limit: int, salts: int) -> DataFrame:
    """``h``: hashes of the lines on at least ``min_sites`` distinct sites."""
    rows = line_sites(documents).filter("site IS NOT NULL").select("h", F.col("site").cast("string").alias("site"))
    spread = rows.groupBy("h").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"))
    spread = cut(spread.select("h", F.hll_sketch_estimate("sketch").alias("sites")).filter(F.col("sites") >= min_sites * (1 - NEAR) - 1))
    sure = F.col("sites") > min_sites * (1 + NEAR) + 1
    exact = _met(rows, spread.filter(~sure).select("h"), broadcast_limit, salts).distinct().groupBy("h").agg(F.count("*").alias("n"))
    return cut(spread.filter(sure).select("h").union(exact.filter(F.col("n") >= min_sites).select("h")))


def remove_boilerplate(documents: DataFrame, *, min_sites: int = 5, broadcast_limit: int = 1 << 18, salts: int = 16) -> DataFrame:
    """documents with ``n_lines`` and ``n_removed`` (long) added and boilerplate lines taken from text.

    Nothing is removed from a document that has no line of its own. Columns that
    are named like the added ones are replaced; any other name may occur.
    """
    lines = boilerplate_lines(documents, min_sites, broadcast_limit, salts)
    met = _met(line_sites(documents).select(F.col("doc_id").alias("id"), "h"), lines, broadcast_limit, salts)
    found = met.groupBy("id").agg(F.collect_set("h").alias("common")).alias("f")
    parts = F.split(F.col("d.text"), "\n")
    is_common = lambda x: (F.trim(x) != "") & F.array_contains(F.col("f.common"), _hash(F.trim(x)))
    n_lines = F.size(F.filter(parts, lambda x: F.trim(x) != ""))
    n_common = F.coalesce(F.when(F.col("f.id").isNotNull(), F.size(F.filter(parts, is_common))), F.lit(0))
    n_removed = F.when(n_common < n_lines, n_common).otherwise(F.lit(0)).cast("long")
    passed = [F.col(f"d.`{c}`") for c in documents.columns if c not in ("text", "n_lines", "n_removed")]
    return documents.alias("d").join(found, F.col("d.doc_id") == F.col("f.id"), "left").select(
        *passed,
        F.when(n_removed > 0, F.array_join(F.filter(parts, lambda x: ~is_common(x)), "\n")).otherwise(F.col("d.text")).alias("text"),
        F.coalesce(F.when(F.col("d.text").isNotNull(), n_lines), F.lit(0)).cast("long").alias("n_lines"),
        n_removed.alias("n_removed"),
    )


ORACLE = """
WITH l AS (SELECT doc_id, source, trim(x) AS line FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS x FROM {documents} WHERE doc_id IS NOT NULL)),
common AS (SELECT line FROM l WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= 5),
numbered AS (SELECT doc_id, i, string_split(text, chr(10))[i] AS x FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM {documents})),
marked AS (SELECT n.doc_id, n.i, n.x, c.line IS NOT NULL AS gone FROM numbered n LEFT JOIN common c ON trim(n.x) = c.line),
per AS (SELECT doc_id, count(*) FILTER (trim(x) <> '') AS n_lines, count(*) FILTER (gone) AS g,
        count(*) FILTER (gone) > 0 AND count(*) FILTER (gone) < count(*) FILTER (trim(x) <> '') AS cut,
        string_agg(x, chr(10) ORDER BY i) FILTER (NOT gone) AS kept FROM marked GROUP BY doc_id)
"""
