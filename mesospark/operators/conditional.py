"""Conditional force matching and matching of potentials of mean force.

A condition ``x`` is a set of frames that share an initial configuration; a
``row`` is one observed force. All tables are sparse: what is absent is zero.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def conditional_gradients(frames: DataFrame, jacobian: DataFrame, model: DataFrame, target: DataFrame, gradients: DataFrame, beta: float) -> tuple[DataFrame, DataFrame]:
    """``x, p, direct, reinforce`` and ``x, rows, sse``.

    frames: ``frame_id, x, w``; jacobian: ``frame_id, row, p, j``; model:
    ``frame_id, row, f``; target: ``x, row, y`` (dense); gradients: ``frame_id, p,
    g`` of the energy. Within a condition, direct is the mean Jacobian times the
    error of the mean force, reinforce is -beta times the covariance of the
    energy's gradient with the force along the error.
    """
    weight = frames.groupBy("x").agg(F.sum("w").alias("sw"))
    mean = lambda rows, by, value: rows.join(frames, "frame_id").groupBy("x", *by).agg(F.sum(F.col("w") * F.col(value)).alias("s")).join(weight, "x").select("x", *by, (F.col("s") / F.col("sw")).alias("m"))
    error = target.join(mean(model, ["row"], "f"), ["x", "row"], "left").select("x", "row", (F.coalesce("m", F.lit(0.0)) - F.col("y")).alias("e"))
    direct = mean(jacobian, ["row", "p"], "j").join(error, ["x", "row"]).groupBy("x", "p").agg(F.sum(F.col("m") * F.col("e")).alias("direct"))
    along = model.join(frames.select("frame_id", "x"), "frame_id").join(error, ["x", "row"]).groupBy("frame_id").agg(F.sum(F.col("f") * F.col("e")).alias("fe"))
    along_mean = mean(along, [], "fe").withColumnRenamed("m", "mean_fe")
    product = gradients.join(along, "frame_id").select("frame_id", "p", (F.col("g") * F.col("fe")).alias("gf"))
    both = mean(product, ["p"], "gf").withColumnRenamed("m", "mean_gf").join(mean(gradients, ["p"], "g"), ["x", "p"]).join(along_mean, "x")
    reinforce = both.select("x", "p", (-beta * (F.col("mean_gf") - F.col("m") * F.col("mean_fe"))).alias("reinforce"))
    out = direct.join(reinforce, ["x", "p"], "full_outer").fillna(0.0, ["direct", "reinforce"])
    return out, error.groupBy("x").agg(F.count("*").alias("rows"), F.sum(F.col("e") * F.col("e")).alias("sse"))


def conditional_step(by_condition: DataFrame, *, clip_ratio: float | None = None, latent: tuple[int, ...] = (), mode: str = "reinforce") -> DataFrame:
    """``p, direct, reinforce, gradient``: means over conditions, a parameter that a condition lacks counting 0.

    Conditions weigh alike, or by the column ``wx`` (one value a condition) if there is one.
    The reinforce part is shortened to ``clip_ratio`` times the norm of the direct
    part. Parameters that act on latent sites alone cannot be told in direct mode
    and are frozen there. The two norms are all that comes to the driver.
    """
    if mode not in ("direct", "reinforce"):
        raise ValueError("mode is direct or reinforce")
    weighed = by_condition if "wx" in by_condition.columns else by_condition.withColumn("wx", F.lit(1.0))
    total = weighed.groupBy("x").agg(F.first("wx").alias("wx")).agg(F.sum("wx")).first()[0]
    mean = weighed.groupBy("p").agg(*[(F.sum(F.col("wx") * F.col(c)) / F.lit(total)).alias(c) for c in ("direct", "reinforce")])
    norms = mean.agg(*[F.sqrt(F.sum(F.col(c) * F.col(c))) for c in ("direct", "reinforce")]).first()
    scale = 1.0
    if clip_ratio is not None and norms[0] and norms[1] > clip_ratio * norms[0]:
        scale = clip_ratio * norms[0] / norms[1]
    frozen = F.col("p").isin(*latent) if latent and mode == "direct" else F.lit(False)
    held = lambda c: F.when(frozen, 0.0).otherwise(c)
    part = F.col("reinforce") * scale if mode == "reinforce" else F.lit(0.0)
    return mean.select("p", held(F.col("direct")).alias("direct"), held(part).alias("reinforce"), held(F.col("direct") + part).alias("gradient"))


def mean_force_matching(model: DataFrame, reference: DataFrame, conditional: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``p, gradient`` and ``bin, delta``: least squares of two potentials of mean force up to a constant.

    model and reference: ``bin, f``; bins that only one of them has say nothing.
    conditional: ``bin, p, g``, the mean gradient of the energy in each bin. The
    loss is half the sum of the squared deltas, the gaps less their mean.
    """
    both = model.withColumnRenamed("f", "fm").join(reference.withColumnRenamed("f", "fr"), "bin")
    gap = both.agg(F.avg(F.col("fm") - F.col("fr"))).first()[0] or 0.0
    delta = both.select("bin", (F.col("fm") - F.col("fr") - gap).alias("delta"))
    gradient = conditional.join(delta, "bin").groupBy("p").agg(F.sum(F.col("delta") * F.col("g")).alias("gradient"))
    return gradient, delta
