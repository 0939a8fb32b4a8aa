"""Filter interaction audit: what each filter removes in every order of the filters.

A document's failures are a mask of five bits. A mask stands for one big integer
whose 64-bit fields hold its outcome at all 600 steps of the 120 orders (kept,
removed, failing but removed before, good or toxic and removed) and the filter
that alone fails it. The integers of a part's documents are added, each as often
as its mask occurs, and the sum is unpacked. No field can overflow, as each
document adds at most 1 to it.

Defined cases: a null text counts as empty; a null source is the part ``''``; a
null id has no smaller copy and no labels, and is nobody's smaller copy; labels
that come several times for an id count if any row has them; repeated rows are
counted as often as they occur, and are no smaller copies of each other; other
columns are ignored, whatever their names; an empty table has no parts.
"""

from functools import cache
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = len(ORDERS) * len(FILTERS)
OUTCOMES = ["kept", "removed", "redundant", "good_lost", "toxic_lost"]
GOOD, TOXIC = 1 << len(FILTERS), 2 << len(FILTERS)  # bits above the mask
_SPACE = "[\\x20\\x09-\\x0D]+"


def failures(documents: DataFrame, salts: int = 16) -> DataFrame:
    """``doc_id, part, mask``: the filters that each document fails, bit i for the i-th.

    Texts are held equal by SHA-256. A text may have any number of copies: only
    texts with copies are looked up, each of them once for every salt.
    """
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(text, _SPACE), lambda w: w != "")
    digest = F.unhex(F.sha2(text, 256)).alias("digest")
    rows = documents.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"), words.alias("words"), digest)
    n_words, capitals = F.size("words"), F.length("text") - F.length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    own = [n_words < 200, 100 * F.size(F.array_distinct("words")).cast("long") < 50 * n_words.cast("long"), 100 * capitals.cast("long") > 2 * F.length("text"), F.col("text").rlike("[#$%&*|]")]
    bits = sum((F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate(own)), F.lit(0))
    rows = rows.select("doc_id", "part", "digest", bits.alias("own"), F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("long").alias("salt"))
    copies = documents.select("doc_id", digest).groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    copies = copies.select("digest", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"))
    copied = F.when(F.col("doc_id") > F.col("first"), 1 << 4).otherwise(0)
    return rows.join(copies, ["digest", "salt"], "left").select("doc_id", "part", (F.col("own") + copied).alias("mask"))


@cache
def packed(code: int) -> int:
    """The integer of a mask with its label bits: field ``STEPS * outcome + step``, then one field a filter for the only failure."""
    mask, fields = code % GOOD, np.zeros(len(OUTCOMES) * STEPS + len(FILTERS), "<u8")
    by_outcome = fields[: len(OUTCOMES) * STEPS].reshape(len(OUTCOMES), STEPS)
    for o, order in enumerate(ORDERS):
        before = 0
        for s, name in enumerate(order):
            bit, at = 1 << FILTERS.index(name), len(FILTERS) * o + s
            fails, gone = bool(mask & bit), bool(mask & before)
            removed = fails and not gone
            by_outcome[:, at] = [not fails and not gone, removed, fails and gone, removed and bool(code & GOOD), removed and bool(code & TOXIC)]
            before |= bit
    fields[len(OUTCOMES) * STEPS :] = [mask == 1 << i for i in range(len(FILTERS))]
    return int.from_bytes(fields.tobytes(), "little")


def unpack(total: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The 600 counts of each outcome, and the documents that only one filter fails by filter."""
    n = len(OUTCOMES) * STEPS + len(FILTERS)
    fields = np.frombuffer(total.to_bytes(8 * n, "little"), "<u8").astype(np.int64)
    return dict(zip(OUTCOMES, fields[: len(OUTCOMES) * STEPS].reshape(-1, STEPS), strict=True)), fields[len(OUTCOMES) * STEPS :]


def _audit_part(counts: pd.DataFrame) -> pd.DataFrame:
    """All rows of one part, of which ``counts`` has at most one row for each mask and labels."""
    by_outcome, alone = unpack(sum(int(n) * packed(int(code)) for code, n in zip(counts["code"], counts["n"], strict=True)))
    letter = np.array([FILTERS.index(name) for order in ORDERS for name in order])
    shapley = np.array([by_outcome["removed"][letter == i].sum() for i in range(len(FILTERS))])
    return pd.DataFrame(
        {"part": counts["part"].iloc[0], "filter_order": np.repeat(ORDERS, len(FILTERS)), "step": np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(ORDERS))}
        | by_outcome
        | {"unique_fails": alone[letter], "shapley": shapley[letter]}
    )


SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, good_lost long, toxic_lost long, unique_fails long, shapley long"


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order and step; see the module for the counts.

    Masks are counted in the tasks that make them, so a part of any size reaches
    its group as at most 128 rows.
    """
    known = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(*[F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))).alias(c) for c in ("quality", "toxic")])
    marks = sum((F.coalesce(F.col(c), F.lit(0)) * bit for c, bit in (("quality", GOOD), ("toxic", TOXIC))), F.lit(0))
    coded = failures(documents).join(known, "doc_id", "left").select("part", (F.col("mask") + marks).cast("int").alias("code"))
    counts = coded.groupBy("part", "code").agg(F.count("*").alias("n"))
    return counts.groupBy("part").applyInPandas(_audit_part, SCHEMA)


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
m AS (SELECT doc_id, part,
        CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
        + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
        + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS q, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS x FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, coalesce(q, 0) AS q, coalesce(x, 0) AS x, count(*) AS n FROM m LEFT JOIN l ON m.doc_id = l.doc_id GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS k, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT f1.k || f2.k || f3.k || f4.k || f5.k AS filter_order, [f1.bit, f2.bit, f3.bit, f4.bit, f5.bit] AS bits FROM f f1, f f2, f f3, f f4, f f5 WHERE f1.bit | f2.bit | f3.bit | f4.bit | f5.bit = 31),
s AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1 : step - 1]), 0)::INT AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, step, bit, sum(CASE WHEN mask & (bit | before) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN mask & bit > 0 AND mask & before > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN mask & bit > 0 AND mask & before = 0 AND q = 1 THEN n ELSE 0 END) AS good_lost, sum(CASE WHEN mask & bit > 0 AND mask & before = 0 AND x = 1 THEN n ELSE 0 END) AS toxic_lost
      FROM c, s GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r
"""
