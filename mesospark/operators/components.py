"""Connected components by alternating star contraction."""

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from mesospark.plans.lineage import cut


def _pairs(*pairs):
    """Rows for an explode: structs ``u, v``."""
    return F.array(*[F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in pairs])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.explode(_pairs(("u", "v"), ("v", "u"))).alias("e")).select("e.*")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = F.when(F.col("v") != F.col("m"), _pairs(("u", "m"), ("v", "m"))).otherwise(_pairs(("u", "m")))
    return edges.join(least, "u").select(F.explode(moved).alias("e")).select("e.*").distinct()


def connected_components(edges: DataFrame, left: str = "u", right: str = "v", max_passes: int = 60) -> DataFrame:
    """Label every endpoint with the smallest id that it is connected to.

    ``edges`` holds two id columns of one orderable type; it is read several
    times, so an expensive input should be cut first. Nulls, self links and
    repeated or reversed links add nothing (a node that only has a self link is
    absent from the result). Returns ``id, component`` for every linked node;
    an empty input gives an empty result. Each pass is two joins on node ids
    and is checkpointed, and a sum over its rows, taken as they are written,
    tells whether anything moved; the number of passes is logarithmic for long chains.
    """
    e = edges.filter(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right))).select(
        F.greatest(left, right).alias("u"), F.least(left, right).alias("v")
    )
    before = None
    for _ in range(max_passes):
        seen = Observation()
        e = cut(_small_star(_large_star(e)).observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")))
        now = seen.get
        if now == before or not now["n"]:
            break
        before = now
    else:
        raise RuntimeError(f"components still change after {max_passes} passes")
    return e.select(F.explode(_pairs(("u", "v"), ("v", "v"))).alias("e")).select(F.col("e.u").alias("id"), F.col("e.v").alias("component")).distinct()
