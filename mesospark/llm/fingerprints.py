"""Document fingerprints by invertible Bloom lookup sketches, in column functions alone.

A text is the set of its paragraphs: stretches up to an end of line or of
sentence, of at most ``LONGEST`` characters, without outer blanks. Each has a
64-bit digest. A sketch has three tables of cells; a digest goes to one cell of
each, which holds how many digests came, their exclusive or and that of
their check sums. Subtracting the sketches of two versions cancels what both
hold. A cell with a single digest then gives it away, which takes it out of
its two other cells, and so on: peeling. What is peeled is what only one of the
versions has.

The fingerprint of a text is a sketch of fixed size, which two versions with a
few different paragraphs need no more than. Where peeling gets stuck, larger
sketches are made of the digests: these are spread over as many buckets as keep
each small, and a bucket is tried with 12, 48, 192 and 768 cells, each time with other
cell choices. Should all fail for a bucket, its digests are compared themselves.

Defined cases: a null text counts as empty and has an empty set; two empty
sets are alike (1); a paragraph that a text repeats counts once; rows of one id
are ordered by a hash of their text, equal rows by chance, as it makes no
difference; null ids come last (all in one band, so they should be few); a table of one row
has itself as the next document; other columns are ignored, whatever their names.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LONGEST = 160
BASE = 8  # cells in each of the three tables of a fingerprint
LEVELS = (4, 16, 64, 256)  # cells in each of the three tables of a bucket
BUCKET = 6  # digests of both versions that a bucket has on average


_APART = "struct<left:array<bigint>,right:array<bigint>>"


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def _bind(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def paragraphs(text: Column) -> Column:
    """Distinct digests of the paragraphs of a text."""
    stretches = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"[^.!?;\\n]{{1,{LONGEST}}}[.!?;]*"), F.lit(0))
    return F.array_distinct(F.transform(F.filter(F.transform(stretches, lambda x: F.trim(x)), lambda x: x != ""), lambda x: F.xxhash64(x)))


def _check(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit("check"))


def _place(spread: Column, table: int, size: Column) -> Column:
    """Cell of one of the three tables; ``size`` is a power of two of at most 2^16, so each table has bits of its own."""
    return F.shiftright(spread, 16 * table).bitwiseAND(size - 1)


def sketch(digests: Column, size: Column) -> Column:
    """Array of ``3 * size`` cells ``n, d, c``; equal sets have equal sketches, in any order."""
    entries = F.transform(digests, lambda d: F.struct(d.alias("d"), _check(d).alias("c"), F.xxhash64(d, size).alias("s")))

    def cell(held: Column) -> Column:
        none = F.struct(_long(0).alias("n"), _long(0).alias("d"), _long(0).alias("c"))
        return F.aggregate(held, none, lambda a, e: F.struct((a.n + 1).alias("n"), a.d.bitwiseXOR(e.d).alias("d"), a.c.bitwiseXOR(e.c).alias("c")))

    def table(t: int, bound: Column) -> Column:
        return F.transform(F.sequence(_long(0), size - 1), lambda i: cell(F.filter(bound, lambda e: _place(e.s, t, size) == i)))

    return _bind(entries, lambda e: F.concat(*[table(t, e) for t in range(3)]))


def subtract(left: Column, right: Column) -> Column:
    """Cells of the digests that only one side has: ``n`` counts those of the left up and those of the right down."""
    return F.zip_with(left, right, lambda x, y: F.struct((x.n - y.n).alias("n"), x.d.bitwiseXOR(y.d).alias("d"), x.c.bitwiseXOR(y.c).alias("c")))


def peel(cells: Column, size: Column, most: Column) -> Column:
    """``left, right``: the digests that only one side has; null where peeling gets stuck.

    ``most`` bounds how many there can be.
    """
    none = F.array().cast("array<bigint>")
    start = F.struct(cells.alias("cells"), none.alias("left"), none.alias("right"), F.lit(False).alias("stuck"))

    def single(c: Column) -> Column:
        return ((c.n == 1) | (c.n == -1)) & (_check(c.d) == c.c)

    def take(state: Column, found: Column) -> Column:
        def without(p: Column) -> Column:
            def rest(c: Column, i: Column) -> Column:
                hit = (i == p.p0) | (i == p.p1) | (i == p.p2)
                return F.when(hit, F.struct((c.n - p.n).alias("n"), c.d.bitwiseXOR(p.d).alias("d"), c.c.bitwiseXOR(p.c).alias("c"))).otherwise(c)

            one = F.array(p.d)
            return F.struct(
                F.transform(state.cells, rest).alias("cells"),
                F.when(p.n > 0, F.concat(state.left, one)).otherwise(state.left).alias("left"),
                F.when(p.n < 0, F.concat(state.right, one)).otherwise(state.right).alias("right"),
                F.lit(False).alias("stuck"),
            )

        def placed(c: Column) -> Column:
            spread = F.xxhash64(c.d, size)
            places = [(_place(spread, t, size) + size * t).cast("int").alias(f"p{t}") for t in range(3)]
            return F.struct(c.n.alias("n"), c.d.alias("d"), c.c.alias("c"), *places)

        return _bind(placed(F.element_at(found, 1)), without)

    def step(state: Column, _: Column) -> Column:
        halted = F.struct(state.cells.alias("cells"), state.left.alias("left"), state.right.alias("right"), F.lit(True).alias("stuck"))
        return F.when(state.stuck, state).otherwise(_bind(F.filter(state.cells, single), lambda f: F.when(F.size(f) == 0, halted).otherwise(take(state, f))))

    def ended(state: Column) -> Column:
        left_over = F.exists(state.cells, lambda c: (c.n != 0) | (c.d != 0) | (c.c != 0))
        return F.when(~left_over, F.struct(state.left.alias("left"), state.right.alias("right")))

    steps = F.sequence(F.lit(0), F.least(most.cast("long"), size * 3).cast("int"))
    return F.aggregate(steps, start, step, ended)


def _buckets(x: Column, y: Column) -> Column:
    """Array of ``x, y``: both digest arrays by buckets, taken apart twice so that no step is quadratic."""
    n = F.ceil(F.sqrt((F.size(x) + F.size(y)) / F.lit(float(BUCKET)))).cast("long")

    def parted(both: Column, ways: Column, key) -> Column:
        pick = lambda side, i: F.filter(side, lambda d: F.pmod(key(d), ways) == i)
        return F.transform(F.sequence(_long(0), ways - 1), lambda i: F.struct(pick(both.x, i).alias("x"), pick(both.y, i).alias("y")))

    def twice(ways: Column) -> Column:
        outer = parted(F.struct(x.alias("x"), y.alias("y")), ways, lambda d: d)
        return F.flatten(F.transform(outer, lambda both: parted(both, ways, lambda d: F.shiftright(d, 32))))

    return _bind(F.greatest(n, _long(1)), twice)


def _bucket_difference(both: Column) -> Column:
    most = F.size(both.x) + F.size(both.y)
    tried = lambda found, size: F.coalesce(found, peel(subtract(sketch(both.x, size), sketch(both.y, size)), size, most))
    peeled = F.aggregate(F.array(*map(_long, LEVELS)), F.lit(None).cast(_APART), tried)
    return F.coalesce(peeled, F.struct(F.array_except(both.x, both.y).alias("left"), F.array_except(both.y, both.x).alias("right")))


def difference(versions: Column) -> Column:
    """``left, right``: the digests that only one of two versions has (``x, y``), from their fingerprints (``x_cells, y_cells``) and else from larger sketches.

    Two sets whose sizes differ by more than a fingerprint has cells are not tried with it.
    """
    x, y = versions.x, versions.y
    few = F.abs(F.size(x) - F.size(y)) <= 3 * BASE
    first = F.when(few, peel(subtract(versions.x_cells, versions.y_cells), _long(BASE), F.size(x) + F.size(y)))
    parts = F.transform(_buckets(x, y), _bucket_difference)
    larger = _bind(parts, lambda p: F.struct(F.flatten(F.transform(p, lambda b: b.left)).alias("left"), F.flatten(F.transform(p, lambda b: b.right)).alias("right")))
    return F.coalesce(first, larger)


def likeness(x: Column, y: Column, apart: Column) -> Column:
    """Shared digests over all digests of two versions, from the sizes and what they differ by; 1 for two empty ones."""
    total, differing = F.size(x) + F.size(y), F.size(apart.left) + F.size(apart.right)
    return F.when(total == 0, 1.0).otherwise((total - differing).cast("double") / (total + differing))


def as_text(cells: Column) -> Column:
    """Cells as lowercase hex numbers, parted by dots and commas."""
    return F.array_join(F.transform(cells, lambda c: F.lower(F.concat_ws(".", F.hex(c.n), F.hex(c.d), F.hex(c.c)))), ",")


def _band_of(marks: list[int]) -> Column:
    """How many of the sorted marks lie above the id, looked up in two steps; nulls come after all."""
    if not marks:
        return F.lit(0)
    width = int(len(marks) ** 0.5) + 1
    runs = [marks[i : i + width] for i in range(0, len(marks), width)]
    first = F.array(*[F.lit(run[0]).cast("long") for run in runs])
    each = F.array(*[F.array(*[F.lit(m).cast("long") for m in run]) for run in runs])
    above = lambda ms: F.size(F.filter(ms, lambda m: m > F.col("doc_id")))
    # the runs that begin above the id are above it as a whole; of the one before them a part may be
    run = F.size(F.filter(first, lambda m: m <= F.col("doc_id")))
    within = F.when(run > 0, above(F.element_at(each, F.greatest(run, F.lit(1))))).otherwise(0)
    after = F.greatest(F.lit(len(marks)) - run * width, F.lit(0))
    return F.when(F.col("doc_id").isNull(), len(marks)).otherwise(within + after).cast("int")


def in_turn(documents: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``doc_id`` and the columns of each row, and as ``next_*`` those of the next by descending id; the first follows the last.

    Rows are dealt to bands of ids, one for each shuffle partition. The rows of a
    band's highest id are sent to the band before as well, where they end it, so
    each row is shuffled about once and no order spans the table in one task. The
    driver sees one id for each band.
    """
    spark = documents.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    marks = documents.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], max(10_000, 20 * n)).alias("marks")).first().marks
    band = _band_of(sorted(set(marks or [])))
    heads = documents.groupBy(band.alias("band")).agg(F.max("doc_id").alias("head")).orderBy("band").collect()
    rows = documents.select("doc_id", *[c.alias(name) for name, c in columns.items()]).withColumn("_tie", F.xxhash64(*columns)).withColumn("_bands", F.array(band))
    if heads:
        ends = F.array(*[F.struct(F.lit(heads[i].head).cast("long").alias("_head"), F.lit(heads[i - 1].band).alias("_end")) for i in range(len(heads))])
        ends = spark.range(1).select(F.inline(ends))
        rows = rows.join(F.broadcast(ends), F.col("doc_id").eqNullSafe(F.col("_head")), "left")
        rows = rows.withColumn("_bands", F.array_compact(F.array(F.element_at("_bands", 1), "_end")))
    rows = rows.select("doc_id", *columns, "_tie", F.posexplode("_bands").alias("_copy", "_band"))
    order = Window.partitionBy("_band").orderBy("_copy", F.col("doc_id").desc_nulls_last(), "_tie")
    following = [F.lead(name).over(order).alias(f"next_{name}") for name in columns]
    return rows.repartitionById(n, "_band").select("doc_id", "_copy", *columns, *following).filter("_copy = 0").drop("_copy")


def fingerprints(documents: DataFrame) -> DataFrame:
    """``doc_id, digests, cells``: the paragraphs of each text and its fingerprint; ``as_text`` writes the latter."""
    digests = documents.select("doc_id", paragraphs(F.col("text")).alias("digests"))
    return digests.select("doc_id", "digests", sketch(F.col("digests"), _long(BASE)).alias("cells"))


def _edited() -> Column:
    """The last half of the text replaced by as much of the next text, or by all of it."""
    half = F.floor(F.length("text") / 2).cast("int")
    return F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next_text"), F.lit(1), half))


def compare_versions(documents: DataFrame) -> DataFrame:
    """Each text beside its edited text and the next document: fingerprints, what differs, and likeness.

    Returns ``doc_id, n_chars, edited_sha256, cells, edited_cells, edited_apart,
    next_apart, near_edited, near_next``; ``*_apart`` has the digests that only one
    side has (``left, right``).
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select("doc_id", text.alias("text"), paragraphs(F.col("text")).alias("digests"))
    rows = in_turn(rows, {"text": F.col("text"), "digests": F.col("digests"), "cells": sketch(F.col("digests"), _long(BASE))})
    rows = rows.withColumn("edited", _edited()).select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "digests", "cells", "next_digests", "next_cells", paragraphs(F.col("edited")).alias("edited_digests")
    )
    rows = rows.withColumn("edited_cells", sketch(F.col("edited_digests"), _long(BASE)))
    versions = [F.struct(F.col("digests").alias("x"), F.col(f"{v}_digests").alias("y"), F.col("cells").alias("x_cells"), F.col(f"{v}_cells").alias("y_cells")) for v in ("edited", "next")]

    def compared(pair: Column) -> Column:
        return _bind(difference(pair), lambda apart: F.struct(apart.alias("apart"), likeness(pair.x, pair.y, apart).alias("near")))

    rows = rows.withColumn("compared", F.transform(F.array(*versions), compared))
    found = [F.element_at("compared", i + 1)[part].alias(f"{v}_{part}" if part == "apart" else f"{part}_{v}") for part in ("apart", "near") for i, v in enumerate(("edited", "next"))]
    return rows.select("doc_id", "n_chars", "edited_sha256", "cells", "edited_cells", *found)
