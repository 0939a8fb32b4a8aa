"""Gradients of bonded energies by parameter and frame, and what ensembles make of them.

A gradient table has ``key, frame_id, w, p, g`` and leaves out what is zero.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mesospark.functions.potentials import hat


def hats(terms: DataFrame, lo: float, step: float, n: int) -> DataFrame:
    """Terms with the two hat functions that each touches, as ``p`` and ``h``; only those rows are made."""
    at = F.floor((F.col("value") - lo) / step).cast("int")
    rows = terms.withColumn("p", F.explode(F.sequence(at, at + 1))).filter(F.col("p").between(0, n - 1))
    return rows.withColumn("h", hat(F.col("value"), F.col("p"), lo, step))


def hat_gradients(terms: DataFrame, lo: float, step: float, n: int) -> DataFrame:
    """Gradients of an energy that is a sum of n hats, by key and frame."""
    rows = hats(terms.select("key", "frame_id", "w", "value"), lo, step, n).filter("h > 0")
    return rows.groupBy("key", "frame_id", "w", "p").agg(F.sum("h").alias("g"))


def masked_pair(terms: DataFrame, mask: Column, lo: float, step: float, n: int) -> DataFrame:
    """``key, p, free, masked``: weighted gradients of all terms and of those in the mask, from one pass."""
    g = F.col("w") * F.col("h")
    made = hats(terms, lo, step, n).filter("h > 0")
    return made.groupBy("key", "p").agg(F.sum(g).alias("free"), F.coalesce(F.sum(F.when(mask, g)), F.lit(0.0)).alias("masked"))


def gauge_free(gradients: DataFrame, terms: DataFrame, shift: float) -> DataFrame:
    """``key, p, g``: weighted gradients less a reference shift that is the same for each term of a key."""
    off = terms.groupBy("key").agg((F.sum("w") * shift).alias("off"))
    total = gradients.groupBy("key", "p").agg(F.sum(F.col("w") * F.col("g")).alias("g"))
    return total.join(off, "key").select("key", "p", (F.col("g") - F.col("off")).alias("g"))


def outer_products(gradients: DataFrame) -> DataFrame:
    """``key, p, key2, q, h`` with (key, p) <= (key2, q): weighted sums over frames of the products of any two gradients, of one key or of two.

    A frame has at most one row for each parameter, so its products stay as few as the result has rows.
    """
    own = gradients.groupBy("frame_id", "w").agg(F.sort_array(F.collect_list(F.struct("key", "p", "g"))).alias("gs"))
    left = own.select("w", "gs", F.posexplode("gs").alias("i", "u"))
    both = left.select("w", "u", F.explode(F.slice("gs", F.col("i") + 1, F.size("gs"))).alias("v"))
    return both.groupBy(F.col("u.key").alias("key"), F.col("u.p").alias("p"), F.col("v.key").alias("key2"), F.col("v.p").alias("q")).agg(F.sum(F.col("w") * F.col("u.g") * F.col("v.g")).alias("h"))


def phase_means(gradients: DataFrame, frames: DataFrame, phases: dict[str, Column]) -> DataFrame:
    """``key, p`` and, for each named phase (a condition on frames), the weighted mean gradient over all its frames.

    Frames without a term of a key count with zero. The weight of each phase, one number, comes to the driver.
    """
    weight = frames.agg(*[F.sum(F.when(c, F.col("w"))).alias(n) for n, c in phases.items()]).first()
    mean = lambda n, c: (F.coalesce(F.sum(F.when(c, F.col("w") * F.col("g"))), F.lit(0.0)) / F.lit(weight[n])).alias(n)
    return gradients.groupBy("key", "p").agg(*[mean(n, c) for n, c in phases.items()])


def relative_entropy_gradient(gradients: DataFrame, frames: DataFrame, reference: Column, model: Column, beta: float = 1.0) -> DataFrame:
    """``key, p, gradient``: beta times the reference mean less the model mean."""
    means = phase_means(gradients, frames, {"reference": reference, "model": model})
    return means.select("key", "p", (beta * (F.col("reference") - F.col("model"))).alias("gradient"))


def latent_gradient(gradients: DataFrame, frames: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """``key, p, gradient``: the mean over conditions of the mean within each, less the mean over all frames."""
    means = phase_means(gradients, frames, conditions | {"joint": F.lit(True)})
    average = sum((F.col(n) for n in conditions), F.lit(0.0)) / len(conditions)
    return means.select("key", "p", (average - F.col("joint")).alias("gradient"))


def covariance(gradients: DataFrame, frames: DataFrame, chosen: Column) -> DataFrame:
    """``key, p, key2, q, c`` with (key, p) <= (key2, q): weighted covariance over the chosen frames of any two gradients.

    What a frame lacks counts 0, so two parameters that meet in no frame have minus
    the product of their means. There is a row for every two parameters that occur in a chosen frame.
    """
    weight = frames.filter(chosen).agg(F.sum("w")).first()[0]
    own = gradients.filter(chosen)
    means = own.groupBy("key", "p").agg((F.sum(F.col("w") * F.col("g")) / weight).alias("m"))
    # every parameter meets the sorted means in one array: the result has as many rows
    listed = means.agg(F.sort_array(F.collect_list(F.struct("key", "p", "m"))).alias("ms")).withColumn("one", F.lit(0))
    later = F.filter("ms", lambda v: F.struct(v.key, v.p) >= F.struct(F.col("key"), F.col("p")))
    every = means.withColumn("one", F.lit(0)).join(listed, "one").select("key", "p", "m", F.explode(later).alias("v"))
    less = every.select("key", "p", F.col("v.key").alias("key2"), F.col("v.p").alias("q"), (-F.col("m") * F.col("v.m")).alias("c"))
    met = outer_products(own).select("key", "p", "key2", "q", (F.col("h") / weight).alias("c"))
    return met.unionAll(less).groupBy("key", "p", "key2", "q").agg(F.sum("c").alias("c"))


def linear_hessian(gradients: DataFrame, frames: DataFrame, model: Column, beta: float) -> DataFrame:
    """``key, p, key2, q, h``: of a family linear in its parameters, beta squared times the covariance of two gradients in the model's frames."""
    return covariance(gradients, frames, model).select("key", "p", "key2", "q", (beta * beta * F.col("c")).alias("h"))


def energy_hessian(terms: DataFrame, potential, value: Column, **parameters) -> DataFrame:
    """``key, frame_id, w, p, q, h`` (p <= q, numbered as the family's parameters): sums over terms of second derivatives of the energy; linear families have none."""
    places = {name: i for i, name in enumerate(potential.names)}
    found = [(*sorted((places[a], places[b])), second) for (a, b), second in potential.hessian(value, **parameters).items()] if potential.hessian else []
    if not found:
        return terms.select("key", "frame_id", "w", F.lit(0).alias("p"), F.lit(0).alias("q"), F.lit(0.0).alias("h")).limit(0)
    sums = terms.groupBy("key", "frame_id", "w").agg(*[F.sum(second).alias(f"h{p}_{q}") for p, q, second in found])
    return sums.select("key", "frame_id", "w", F.inline(F.array(*[F.struct(F.lit(p).alias("p"), F.lit(q).alias("q"), F.col(f"h{p}_{q}").alias("h")) for p, q, _ in found])))


def relative_entropy_hessian(hessians: DataFrame, gradients: DataFrame, frames: DataFrame, reference: Column, model: Column, beta: float = 1.0) -> DataFrame:
    """``key, p, key2, q, h``: beta times the reference mean less the model mean of second derivatives, plus beta squared times the model's covariance of gradients.

    hessians: ``key, frame_id, w, p, q, h`` of one key each; what a frame lacks counts 0.
    """
    weight = frames.agg(*[F.sum(F.when(c, F.col("w"))).alias(n) for n, c in (("reference", reference), ("model", model))]).first()
    mean = lambda c, n: F.coalesce(F.sum(F.when(c, F.col("w") * F.col("h"))), F.lit(0.0)) / F.lit(weight[n])
    curved = hessians.groupBy("key", "p", "q").agg((beta * (mean(reference, "reference") - mean(model, "model"))).alias("h"))
    spread = linear_hessian(gradients, frames, model, beta)
    both = spread.unionByName(curved.select("key", "p", F.col("key").alias("key2"), "q", "h"))
    return both.groupBy("key", "p", "key2", "q").agg(F.sum("h").alias("h"))
