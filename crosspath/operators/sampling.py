"""New parameter vectors from a fitted kernel density."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.random import normal, uniform_index
from ..schema import DRAWS_PER_CLASS, PARAMETERS, SEED
from .kde import few_classes, kernel_index

_STEP = 1000
SHARE = 1 << 16         # draws of one center that one group takes, about


def draw_numbers(model: DataFrame, n: int) -> DataFrame:
    """n rows per class with draw = 1..n, expanded in two steps and spread out in between, so
    neither an array nor a task grows with n. No rows for n = 0."""
    if n < 0:
        raise ValueError("the number of draws is negative")
    if n == 0:
        return model.selectExpr("*", "0L as draw").where("false")
    parts = int(model.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    steps = model.selectExpr("*", f"explode(sequence(0L, {(n - 1) // _STEP}L)) as step")
    return steps.repartition(parts, "class", "step").selectExpr("*", f"explode(sequence(step * {_STEP} + 1, least((step + 1) * {_STEP}, {n}L))) as draw").drop("step")


def _moved(df: DataFrame, seed: int, cols: list[str], scale: float) -> DataFrame:
    """Replace each parameter by kernel center + scale * h * N(0, 1) in standardized units."""
    new = {}
    for j, c in enumerate(cols, start=1):
        z = (F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_sd")
        z = z + F.lit(float(scale)) * F.col("h") * normal(seed, F.col("draw"), str(j))
        new[c] = z * F.col(f"{c}_sd") + F.col(f"{c}_mean")
    return df.withColumns({**{f"center_{c}": F.col(c) for c in cols}, **new})


def dependent_samples(params: DataFrame, model: DataFrame, n: int = DRAWS_PER_CLASS, seed: int = SEED,
                      cols: list[str] = PARAMETERS, scale: float = 1.0) -> DataFrame:
    """n draws per class: a uniformly chosen kernel center plus normal noise.

    Keeps every column of the center's row, adds draw, kernel, center_<col> and the
    model columns. The random stream depends on (seed, draw) only, so it restarts for
    each class.
    """
    draws = draw_numbers(model, n).withColumn("kernel", uniform_index(seed, F.col("draw"), F.col("n")))
    return _moved(_beside_centers(kernel_index(params), draws, model, n), seed, cols, scale)


def _beside_centers(centers: DataFrame, draws: DataFrame, model: DataFrame, n: int) -> DataFrame:
    """Draws joined to their centers.

    A center of a class of N gets about n / N draws. Where that is more than SHARE, the center is copied to so many
    parts, and its draws are dealt over them, so a class of two centers and 10^9 draws has no hot key.
    """
    key = ["class", "kernel"]
    if n <= SHARE:
        return centers.join(draws, key)
    parts = F.ceil(F.lit(n) / (F.col("n") * SHARE))
    dealt = draws.withColumn("part", F.pmod(F.col("draw"), parts))
    copies = centers.join(few_classes(model)(model.select("class", parts.alias("parts"))), "class").withColumn(
        "part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))).drop("parts")
    return copies.join(dealt, [*key, "part"]).drop("part")


def conditional_samples(params: DataFrame, model: DataFrame, kernel: int, n: int = DRAWS_PER_CLASS,
                        seed: int = SEED, cols: list[str] = PARAMETERS, scale: float = 1.0) -> DataFrame:
    """n draws per class around the one kernel center with the given number."""
    center = kernel_index(params).where(F.col("kernel") == kernel)
    return _moved(draw_numbers(center.join(model, "class"), n), seed, cols, scale)


def sample_table(params: DataFrame, model: DataFrame, n: int = DRAWS_PER_CLASS, seed: int = SEED) -> DataFrame:
    """Samples in the layout of the parameter table: sample_id first, end speed clipped at 0,
    centers and bandwidth appended."""
    draws = dependent_samples(params, model, n, seed)
    name = F.format_string("%s__seed%d__draw%06d", F.col("class"), F.lit(seed), F.col("draw"))
    kept = [F.greatest(F.lit(0.0), F.col(c)).alias(c) if c == "end_speed_kmh" else F.col(c) for c in params.columns]
    return draws.select(name.alias("sample_id"), *kept, *[f"center_{c}" for c in PARAMETERS],
                        F.col("h").alias("kde_bandwidth"))
