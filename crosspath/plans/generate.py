"""Step 3: parameters or samples to the tables a scenario renderer needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.blocks import attach
from ..operators.pairs import windowed_chunks
from ..operators.theta import theta_to_cps
from ..schema import CONTROL_POINT_WEIGHT, FPS, KEY, RUN_MARGIN_S

ROLES_IN_RUN = ["q_in", "q_c", "q_out"]
ORDINALS = 65536        # in a bucket that is ordered by itself


def variants(params: DataFrame, limit: int | None = None) -> DataFrame:
    """Rows with status ok, the first ``limit`` of them in input order (None or 0: all).

    Buckets of ordinals are counted first, and only those below the limit are put in order, each by itself.
    """
    ok = params.where("status = 'ok'")
    if not limit:
        return ok
    order = [c for c in ("input_ordinal", "recording_id", "scenario_id", "sample_id") if c in params.columns]
    rows = ok.withColumn("bucket", F.floor(F.col("input_ordinal") / ORDINALS))
    before = F.sum("count").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))     # one row per bucket
    counts = rows.groupBy("bucket").count().select(F.col("bucket").alias("its_bucket"), F.coalesce(before, F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("bucket").orderBy(*order))
    return (rows.join(counts.where(F.col("before") < limit), F.col("bucket").eqNullSafe(F.col("its_bucket")))
            .withColumn("place", F.col("before") + place).where(F.col("place") <= limit).drop("bucket", "its_bucket", "before", "place"))


def variant_name(params: DataFrame) -> Column:
    """sample_id, or the scenario_id where there is none."""
    if "sample_id" not in params.columns:
        return F.col("scenario_id")
    return F.coalesce(F.nullif(F.col("sample_id"), F.lit("")), F.col("scenario_id"))


def control_points(params: DataFrame) -> DataFrame:
    """Three weighted control points per variant, rebuilt from the angles.

    (recording_id, name, base_xosc, point, role, x, y, weight, end_speed_kmh); x and y are
    rounded to 4 decimals, the middle point takes the class's own weight if it has one.
    """
    if "base_xosc" not in params.columns:
        raise ValueError("no base_xosc column: every scenario has to name the file its variants start from")
    lack = F.concat(F.lit("no base_xosc for scenario "), F.coalesce("scenario_id", F.lit("null")))
    params = params.withColumn("base_xosc", F.coalesce("base_xosc", F.raise_error(lack).cast("string")))
    rows = theta_to_cps(variants(params).withColumn("name", variant_name(params)))
    weight = F.lit(CONTROL_POINT_WEIGHT)
    points = F.array(*[F.struct(
        F.lit(role).alias("role"), F.round(f"p{i}_x", 4).alias("x"), F.round(f"p{i}_y", 4).alias("y"),
        (F.coalesce("middle_cp_weight", weight) if role == "q_c" else weight).alias("weight"))
        for i, role in enumerate(ROLES_IN_RUN, start=1)])
    return (rows.select("recording_id", "name", "base_xosc", "end_speed_kmh", F.posexplode(points).alias("point", "p"))
            .select("recording_id", "name", "base_xosc", (F.col("point") + 1).cast("bigint").alias("point"), "p.role",
                    "p.x", "p.y", "p.weight", "end_speed_kmh"))


def ego_replay(scenarios: DataFrame, tracks: DataFrame, fps: float = FPS) -> DataFrame:
    """Vertices of the ego's recorded path with absolute timing:
    (KEY, frame, time_s, x, y, heading_rad), rounded as they are written out."""
    windows, chunks = windowed_chunks(tracks, scenarios, ["x", "y", "heading"], roles=("ego",))
    blocks = attach(windows, chunks).where(F.size("samples") > 0)
    start = blocks.groupBy(*KEY).agg(F.min(F.get("samples", F.lit(0))["frame"]).alias("start"))
    rows = blocks.join(start, KEY).select(*KEY, "start", F.inline("samples"))
    return rows.select(*KEY, "frame", F.round((F.col("frame") - F.col("start")) / F.lit(float(fps)), 6).alias("time_s"),
                       F.round("x", 4).alias("x"), F.round("y", 4).alias("y"),
                       F.round(F.radians("heading"), 5).alias("heading_rad"))


def run_end_time(scenarios: DataFrame, fps: float = FPS, margin_s: float = RUN_MARGIN_S) -> DataFrame:
    """Simulated seconds after which a replay stops: window length plus a margin."""
    seconds = (F.col("max_frame") - F.col("min_frame")) / F.lit(float(fps)) + F.lit(float(margin_s))
    return scenarios.select(*KEY, F.round(seconds, 3).alias("t_end_s"))
