"""Gaussian kernel density per class with a leave-one-out cross-validated bandwidth.

The leave-one-out likelihood sums a kernel over all pairs of a class. Pairs never
become rows: equal vectors are merged into weights first, the distinct vectors of a
class are ordered along a k-d curve and cut into tiles of up to TILE vectors, and RUN tiles
that follow one another travel as a group. A task evaluates one pair of groups with array arithmetic, for all
bandwidths of a search round at once; as the kernel is symmetric, each pair is evaluated once and serves
both sides. Pairs of groups and of tiles so far apart that every kernel is exactly 0.0 in double precision are
skipped, and so are, strip by strip and bandwidth by bandwidth, pairs that a sum provably cannot feel: every vector knows how far
its nearest neighbour in the tile is at most, which bounds its sum from below, and all that is left out of a sum is together less than
2^-60 of it, far below the last bit of a double. A vector without a near neighbour keeps everything. Sums return as one array per tile, and are added up tile by tile. A class of any size, or one that holds most of
the data, is spread over (groups x groups / 2) independent tasks. The work is quadratic in the distinct
vectors of a class, as the estimator is defined; nothing is sampled or cut off.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import PARAMETERS
from ..staging import BROADCAST_ROWS, stage

TILE = 1024
RUN = 4                 # tiles in a group
STRIP = 64              # vectors of a tile that are met with another tile at once, so that the kernels stay in the cache
MET = 16                # strips of the other tile that it meets at once
CHAINS = 4              # bandwidths of the search's first round in which the rate 1 / (2 h^2) doubles
SQUARINGS = 8           # a kernel is computed anew after so many, as each doubles its relative error
SAME = 1e-14            # rates that differ by less are equal
SLIGHT = 60 * np.log(2)  # terms that make up less than exp(-SLIGHT) of a sum together do not change it
ZERO = -745.2            # exp of anything below is 0.0
SPAN = 16.0              # the curve tells vectors apart within so many standard deviations; beyond, boxes are only larger

GRID = 60                # bandwidths of the plain grid
REFINE = 16              # bandwidths in each later round
ROUNDS = 3
SPREAD = 20.0            # the first round spans h0 / SPREAD .. h0 * SPREAD
FLAT_SD = 1e-12
MIN_DENSITY = 1e-300


def complete(params: DataFrame, cols: list[str] = PARAMETERS) -> DataFrame:
    """Rows with a number in every parameter; only these take part in a density."""
    return params.where(" and ".join(f"{c} is not null and not isnan({c})" for c in cols))


def class_moments(params: DataFrame, cols: list[str] = PARAMETERS) -> DataFrame:
    """(class, n, <col>_mean, <col>_sd, sigma): moments per class; a constant column has sd 1.

    ``sigma`` is the mean standard deviation of the standardized columns, i.e. the share
    of columns that vary.
    """
    aggs = [F.count("*").alias("n")]
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_raw")]
    varies = [F.when(F.col(f"{c}_raw") < FLAT_SD, 0.0).otherwise(1.0) for c in cols]
    sds = [F.when(F.col(f"{c}_raw") < FLAT_SD, 1.0).otherwise(F.col(f"{c}_raw")).alias(f"{c}_sd") for c in cols]
    return complete(params, cols).groupBy("class").agg(*aggs).select(
        "class", "n", *[f"{c}_mean" for c in cols], *sds, (sum(varies) / len(cols)).alias("sigma"))


def class_report(params: DataFrame, cols: list[str] = PARAMETERS) -> DataFrame:
    """(class, n, missing_values, usable, reason): classes that can be fitted and why others are skipped.

    n counts complete rows, missing_values the others.
    """
    m = class_moments(params, cols).select(F.col("class").alias("its_class"), "n", "sigma")
    rows = params.groupBy("class").agg(F.count("*").alias("rows")).join(m, F.col("class").eqNullSafe(F.col("its_class")), "left")
    n = F.coalesce("n", F.lit(0))
    reason = (F.when((n < 2) & (F.col("rows") >= 2), "missing_values").when(n < 2, "needs_two_rows").when(F.col("sigma") == 0, "zero_variance"))
    return rows.select("class", n.cast("bigint").alias("n"), (F.col("rows") - n).cast("bigint").alias("missing_values"), reason.isNull().alias("usable"),
                       reason.alias("reason"))


def usable_moments(params: DataFrame, cols: list[str] = PARAMETERS) -> DataFrame:
    return class_moments(params, cols).where("n >= 2 and sigma > 0")


def standardize(params: DataFrame, moments: DataFrame, cols: list[str] = PARAMETERS) -> DataFrame:
    """Add z1..zp, the parameters in units of their class's standard deviation."""
    z = [((F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_sd")).alias(f"z{j}") for j, c in enumerate(cols, start=1)]
    params = complete(params, cols)
    return params.join(few_classes(moments)(moments), "class").select(*[params[c] for c in params.columns], *z)


def few_classes(moments: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """How tables of one short row per class are joined: broadcast if the classes are counted to be few."""
    return F.broadcast if moments.select("class").limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else lambda df: df


def _curve(dims: int) -> str:
    """Place of a vector on a k-d curve: the bits of all coordinates, interleaved from the highest on."""
    bits = min(16, 60 // dims)
    cell = [f"cast(least(greatest(floor((z{j} + {SPAN / 2}D) * {(1 << bits) / SPAN}D), 0L), {(1 << bits) - 1}L) as bigint)" for j in range(1, dims + 1)]
    mixed = " | ".join(f"shiftleft(shiftright({c}, i) & 1L, i * {dims} + {j})" for j, c in enumerate(cell))
    return f"aggregate(sequence(0, {bits - 1}), 0L, (acc, i) -> acc | {mixed})"


_TILE = "class string, tile bigint, points array<double>, low array<double>, high array<double>, near array<double>"


def _nearest(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Per strip of a tile the largest squared distance of a vector to its nearest neighbour in the tile (a copy: 0, none: inf)."""
    largest = []
    for at in range(0, len(x), STRIP):
        d2 = sum((x[at:at + STRIP, None, c] - x[None, :, c]) ** 2 for c in range(x.shape[1]))
        d2[np.arange(len(d2)), at + np.arange(len(d2))] = np.where(w[at:at + STRIP] > 1, 0.0, np.inf)
        largest.append(d2.min(1).max())
    return np.array(largest)


def _cut_tiles(dims: int):
    """Ordered vectors (class, z.., w) to tiles; points holds the vectors and their weights one after another."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, rest = TaskContext.get().partitionId() << 32, None

        def made(part: pd.DataFrame) -> tuple:
            x = part.iloc[:, 1:].to_numpy(np.float64)
            return part["class"].iloc[0], x.ravel(), x[:, :dims].min(0), x[:, :dims].max(0), _nearest(x[:, :dims], x[:, dims])

        for frame in frames:
            frame, rows = frame if rest is None else pd.concat([rest, frame]), []
            cuts = np.flatnonzero((frame["class"].to_numpy()[1:] != frame["class"].to_numpy()[:-1])) + 1
            ends = [*cuts, len(frame)]
            start = 0
            for end in ends:
                while end - start > TILE or (end - start and end != len(frame)):
                    rows.append((*made(frame.iloc[start:min(end, start + TILE)]), number + len(rows)))
                    start = min(end, start + TILE)
            rest, number = frame.iloc[start:], number + len(rows)
            yield pd.DataFrame(rows, columns=["class", "points", "low", "high", "near", "tile"])[["class", "tile", "points", "low", "high", "near"]]
        if rest is not None and len(rest):
            yield pd.DataFrame([(*made(rest), number)], columns=["class", "points", "low", "high", "near", "tile"])[["class", "tile", "points", "low", "high", "near"]]

    return run


def _tiles(z: DataFrame, dims: int) -> DataFrame:
    """(class, tile, grp, points, low, high, near), stored: distinct vectors with their multiplicity, in tiles with their boxes."""
    zs = [f"z{j}" for j in range(1, dims + 1)]
    distinct = z.where("class is not null").groupBy("class", *zs).agg(F.count("*").cast("double").alias("w")).withColumn("place", F.expr(_curve(dims)))
    ordered = distinct.repartitionByRange("class", "place").sortWithinPartitions("class", "place", *zs).select("class", *zs, "w")
    tiles = stage(ordered.mapInPandas(_cut_tiles(dims), _TILE))
    order = F.row_number().over(Window.partitionBy("class").orderBy("tile"))
    numbers = tiles.select("class", "tile").withColumn("grp", F.floor((order - 1) / RUN))
    return stage(tiles.join(numbers, ["class", "tile"]))


_SUMS = "class string, tile bigint, n bigint, hs array<double>, points array<double>, sums array<double>"


def _gap2(low: np.ndarray, high: np.ndarray, other_low: np.ndarray, other_high: np.ndarray) -> np.ndarray:
    """Squared distances between all boxes of one side and all of the other."""
    gap = np.maximum(0.0, np.maximum(other_low[None] - high[:, None], low[:, None] - other_high[None]))
    return (gap * gap).sum(-1)


def _evenly(t: np.ndarray) -> bool:
    """Whether the rates t = 1 / (2 h^2) are evenly spaced, up to rounding."""
    return len(t) > 2 and bool((np.abs(np.diff(t) - (t[-1] - t[0]) / (len(t) - 1)) <= SAME * t[1:]).all())


def _from_before(t: np.ndarray) -> list[int]:
    """For every rate how often its kernel was squared since it was computed, if it is twice the rate CHAINS places before; else 0."""
    squared = [0] * len(t)
    for k in range(CHAINS, len(t)):
        if abs(t[k] - 2 * t[k - CHAINS]) <= SAME * t[k] and squared[k - CHAINS] < SQUARINGS:
            squared[k] = squared[k - CHAINS] + 1
    return squared


def _kernels(d2: np.ndarray, t: np.ndarray, upto: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(k, exp(-t[k] d2) of the first upto[k] rows) for ascending rates while upto, which falls, is not 0. Most rates take one product
    each: kernels at evenly spaced rates are a common factor apart, and that at twice a rate is a square. A kernel is valid until the next."""
    even, squared = _evenly(t), _from_before(t)
    held = np.empty((2 if even else CHAINS if any(squared) else 1, *d2.shape))
    for k, rows in enumerate(upto):
        if rows == 0:
            return
        kernel = held[0 if even else k % len(held), :rows]
        if even and k > 0:
            if k == 1:
                np.exp(np.multiply(d2[:rows], -(t[-1] - t[0]) / (len(t) - 1), out=held[1, :rows]), out=held[1, :rows])
            np.multiply(kernel, held[1, :rows], out=kernel)
        elif not even and squared[k]:
            np.multiply(kernel, kernel, out=kernel)
        else:
            np.exp(np.multiply(d2[:rows], -t[k], out=kernel), out=kernel)
        yield k, kernel


def _gap2(low: np.ndarray, high: np.ndarray, other_low: np.ndarray, other_high: np.ndarray) -> np.ndarray:
    """Squared distances between all boxes of one side and all of the other."""
    gap = np.maximum(0.0, np.maximum(other_low[None] - high[:, None], low[:, None] - other_high[None]))
    return (gap * gap).sum(-1)


def _pair_sums(dims: int):
    """Kernel sums of the vectors of a pair of groups (a, b) over each other, per bandwidth: an array per tile."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, n, given = pdf["a"].iloc[0], pdf["b"].iloc[0], pdf["n"].iloc[0], np.asarray(pdf["hs"].iloc[0])
        place = np.argsort(-given, kind="stable")       # the largest first: a pair that a bandwidth needs was needed by all before it
        hs = given[place]
        t, reach, zero = 0.5 / (hs * hs), 2 * hs * hs * (SLIGHT + np.log(n)), -2 * hs * hs * ZERO
        points = [np.asarray(p).reshape(-1, dims + 1) for p in pdf["points"]]
        sums = [np.zeros((len(hs), len(p))) for p in points]
        starts = [np.arange(0, len(p), STRIP) for p in points]
        low, high = ([f.reduceat(p[:, :dims], s) for p, s in zip(points, starts)] for f in (np.minimum, np.maximum))
        near = [np.asarray(v) for v in pdf["near"]]
        side = [np.flatnonzero(pdf["grp"].to_numpy() == g) for g in (a, b)]
        for i in side[0]:
            for j in side[1]:
                if a == b and j < i:
                    continue
                (x, w), (y, v) = ((p[:, :dims], p[:, dims]) for p in (points[i], points[j]))
                if i == j:
                    # A vector leaves itself out but keeps its copies, which are at distance 0.
                    sums[i] += w - 1.0
                gap2 = _gap2(low[i], high[i], low[j], high[j])[..., None]
                needed = (gap2 < np.minimum(np.maximum(near[i][:, None], near[j][None])[..., None] + reach, zero)).sum(-1)
                for at, times in zip(starts[i], needed):
                    strip = slice(at, at + STRIP)
                    met = [s for s in np.argsort(-times, kind="stable") if times[s]]
                    for some in (met[m:m + MET] for m in range(0, len(met), MET)):
                        picked = np.concatenate([np.arange(starts[j][s], min(starts[j][s] + STRIP, len(y))) for s in some])
                        upto = (np.repeat(times[some], [min(STRIP, len(y) - starts[j][s]) for s in some])[:, None] > np.arange(len(hs))).sum(0)
                        d2 = sum((y[picked, None, c] - x[None, strip, c]) ** 2 for c in range(dims))
                        if i == j:
                            d2[picked[:, None] == np.arange(len(x))[None, strip]] = np.inf
                        weights, back = v[picked], np.zeros((len(hs), len(picked)))
                        for k, kernel in _kernels(d2, t, upto):
                            sums[i][k, strip] += weights[:len(kernel)] @ kernel
                            if i != j:
                                back[k, :len(kernel)] = kernel @ w[strip]
                        if i != j:
                            sums[j][:, picked] += back
        back_in_place = np.argsort(place)
        return pd.DataFrame({"class": pdf["class"], "tile": pdf["tile"], "n": pdf["n"], "hs": pdf["hs"],
                             "points": pdf["points"] if a == b else None, "sums": [s[back_in_place].ravel() for s in sums]})

    return run


def _added_up(finish: Callable):
    """Adds the arrays of each tile as they stream by; ``finish(class, n, hs, points, sums)`` makes the rows of a tile."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held, points, total = None, None, None, None
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                at = (r[0], r.tile)
                if at != key:
                    if key is not None:
                        out.append(finish(key[0], held.n, held.hs, points, total))
                    key, held, points, total = at, r, None, np.zeros(len(r.sums))
                total = total + r.sums
                points = r.points if r.points is not None else points
            if out:
                yield pd.concat(out)
        if key is not None:
            yield finish(key[0], held.n, held.hs, points, total)

    return run


def _kernel_sums(tiles: DataFrame, grid: DataFrame, finish: Callable, schema: str, dims: int, per_class: Callable) -> DataFrame:
    """What ``finish`` makes of each tile's kernel sums over the rest of its class.

    grid: (class, n, hs). Groups are paired once, and only where their boxes are near enough for the largest bandwidth.
    """
    box = [F.expr(f"array({', '.join(f'{agg}({c}[{d}])' for d in range(dims))}) as {c}") for agg, c in (("min", "low"), ("max", "high"))]
    groups = tiles.groupBy("class", "grp").agg(*box, F.max(F.array_max("near")).alias("near"))
    other = groups.select("class", F.col("grp").alias("b"), F.col("low").alias("low_b"), F.col("high").alias("high_b"), F.col("near").alias("near_b"))
    gap = " + ".join(f"power(greatest(low_b[{d}] - high[{d}], low[{d}] - high_b[{d}], 0D), 2)" for d in range(dims))
    pairs = (groups.withColumnRenamed("grp", "a").join(other, "class").where("a <= b").join(per_class(grid), "class")
             .where(f"-0.5D * ({gap}) / power(array_max(hs), 2) > {ZERO}D")
             .where(f"a = b or {gap} < greatest(near, near_b) + 2 * power(array_max(hs), 2) * ({SLIGHT}D + ln(n))").select("class", "n", "hs", "a", "b"))
    sided = pairs.selectExpr("*", "explode(if(a = b, array(a), array(a, b))) as grp")
    # A number of partitions is given, as the work is not in the bytes, by which Spark would put all pairs into a few tasks.
    tasks = int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = (tiles.join(sided, ["class", "grp"]).repartition(tasks, "class", "a", "b")
             .groupBy("class", "a", "b").applyInPandas(_pair_sums(dims), _SUMS))
    return parts.repartition("class", "tile").sortWithinPartitions("class", "tile").mapInPandas(_added_up(finish), schema)


def _densities(n: int, hs: np.ndarray, sums: np.ndarray, dims: int) -> np.ndarray:
    """(bandwidths, vectors) leave-one-out densities."""
    hs = np.asarray(hs)
    return sums.reshape(len(hs), -1) / ((n - 1) * (2 * np.pi) ** (dims / 2) * hs[:, None] ** dims)


def loo_likelihood(tiles: DataFrame, grid: DataFrame, dims: int = len(PARAMETERS), per_class: Callable | None = None) -> DataFrame:
    """Leave-one-out log-likelihood: (class, k, h, ll) for every bandwidth of ``grid``."""
    def finish(name, n, hs, points, sums):
        w = np.asarray(points).reshape(-1, dims + 1)[:, dims]
        part = np.log(np.maximum(_densities(n, hs, sums, dims), MIN_DENSITY)) @ w
        return pd.DataFrame({"class": name, "k": np.arange(len(hs)), "h": hs, "part": part})

    parts = _kernel_sums(tiles, grid, finish, "class string, k bigint, h double, part double", dims, per_class or few_classes(grid))
    return parts.groupBy("class", "k", "h").agg(F.sum("part").alias("ll"))


def initial_grid(moments: DataFrame, dims: int = len(PARAMETERS), size: int = GRID) -> DataFrame:
    """(class, n, hs): geometric grid around the normal-reference bandwidth h0."""
    h0 = F.col("sigma") * F.pow(4.0 / ((dims + 2) * F.col("n")), F.lit(1.0 / (dims + 4)))
    return _log_grid(moments.select("class", "n", F.ln(h0 / SPREAD).alias("lo"), F.ln(h0 * SPREAD).alias("hi")), size)


def _log_grid(bracket: DataFrame, size: int) -> DataFrame:
    hs = F.transform(F.sequence(F.lit(0), F.lit(size - 1)),
                     lambda k: F.exp(F.col("lo") + (F.col("hi") - F.col("lo")) * k / (size - 1)))
    return bracket.select("class", "n", hs.alias("hs"))


def search_grid(moments: DataFrame, dims: int = len(PARAMETERS)) -> tuple[DataFrame, int]:
    """(class, n, hs) and the length of hs: a grid over the span of ``initial_grid`` and a little denser, of which a kernel is the square
    of the one CHAINS places further on."""
    size = math.ceil(2 * CHAINS * math.log2(SPREAD * SPREAD)) + 1
    h0 = F.col("sigma") * F.pow(4.0 / ((dims + 2) * F.col("n")), F.lit(1.0 / (dims + 4)))
    hs = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: h0 / SPREAD * F.pow(F.lit(2.0), k / (2.0 * CHAINS)))
    return moments.select("class", "n", hs.alias("hs")), size


def _even_grid(bracket: DataFrame, size: int) -> DataFrame:
    """Ascending bandwidths between exp(lo) and exp(hi) whose rates 1 / (2 h^2) are evenly spaced."""
    low, high = F.exp(-2 * F.col("hi")), F.exp(-2 * F.col("lo"))
    hs = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: 1 / F.sqrt(high + (low - high) * k / (size - 1)))
    return bracket.select("class", "n", hs.alias("hs"))


def _top(ll: DataFrame, size: int) -> DataFrame:
    """Best grid point of each class with its two neighbours (itself at the grid's ends)."""
    curve = F.array_sort(F.collect_list(F.struct("k", F.ln("h").alias("lh"), "ll")))
    at = F.expr("array_position(transform(curve, p -> p.ll), array_max(transform(curve, p -> p.ll)))")
    picked = ll.groupBy("class").agg(curve.alias("curve")).withColumn("at", at)
    return picked.select("class", *[
        F.expr(f"element_at(curve, cast(least(greatest(at + {d}, 1), {size}) as int))").alias(name)
        for d, name in ((-1, "a"), (0, "b"), (1, "c"))])


def _vertex() -> Column:
    """Top of the parabola (over the rates) through three neighbouring points of an even grid; the best point itself at an end."""
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    step = (F.exp(-2 * c["lh"]) - F.exp(-2 * a["lh"])) / 2
    curvature = a["ll"] - b["ll"] * 2 + c["ll"]
    inside = (a["k"] < b["k"]) & (b["k"] < c["k"]) & (curvature < 0)
    return F.when(inside, 1 / F.sqrt(F.exp(-2 * b["lh"]) + step * (a["ll"] - c["ll"]) / (curvature * 2))).otherwise(F.exp(b["lh"]))


def loo_bandwidth(z: DataFrame, moments: DataFrame, dims: int = len(PARAMETERS)) -> DataFrame:
    """(class, n, h): bandwidth with the largest leave-one-out likelihood.

    A grid over two and a half decades, then finer grids over the bracket around its best
    point, then the parabola through the last three points. All classes share each round,
    and a round's bracket stays a DataFrame: nothing is collected.
    """
    tiles, per_class = _tiles(z, dims), few_classes(moments)
    sizes = per_class(moments.select("class", "n"))
    grid, size = search_grid(moments, dims)
    for _ in range(ROUNDS + 1):
        top = stage(_top(loo_likelihood(tiles, grid, dims, per_class), size))
        bracket = top.select("class", F.col("a.lh").alias("lo"), F.col("c.lh").alias("hi")).join(sizes, "class")
        grid, size = _even_grid(bracket, REFINE), REFINE
    return top.join(sizes, "class").select("class", "n", _vertex().alias("h"))


def loo_density(z: DataFrame, bandwidth: DataFrame, dims: int = len(PARAMETERS)) -> DataFrame:
    """Leave-one-out density of every vector at its class bandwidth: z's columns plus density.

    bandwidth: (class, n, h).
    """
    zs = [f"z{j}" for j in range(1, dims + 1)]

    def finish(name, n, hs, points, sums):
        x = np.asarray(points).reshape(-1, dims + 1)
        return pd.DataFrame({"class": name, **{c: x[:, j] for j, c in enumerate(zs)}, "density": _densities(n, hs, sums, dims)[0]})

    schema = f"class string, {', '.join(f'{c} double' for c in zs)}, density double"
    dens = _kernel_sums(_tiles(z, dims), bandwidth.select("class", "n", F.array("h").alias("hs")), finish, schema, dims, few_classes(bandwidth))
    return z.join(dens, ["class", *zs])


def kernel_index(params: DataFrame, bucket: int = 65536, cols: list[str] = PARAMETERS) -> DataFrame:
    """Complete rows with ``kernel``, the row's number 0..N-1 in its class by input order.

    Rows are numbered inside buckets of the ordinal and shifted by the counts of the
    earlier buckets, so a class that holds most rows is never ordered in one task.
    """
    rows = complete(params, cols).withColumn("bucket", F.floor(F.col("input_ordinal") / bucket))
    before = Window.partitionBy("class").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    shift = (rows.groupBy("class", "bucket").count()
             .select("class", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("shift")))
    order = Window.partitionBy("class", "bucket").orderBy("input_ordinal", "recording_id", "scenario_id")
    return (rows.withColumn("rn", F.row_number().over(order)).join(shift, ["class", "bucket"])
            .withColumn("kernel", (F.col("shift") + F.col("rn") - 1).cast("bigint")).drop("bucket", "rn", "shift"))


def fit_kde(params: DataFrame, cols: list[str] = PARAMETERS) -> DataFrame:
    """Model relation (class, n, <col>_mean, <col>_sd, h), one row per class that can be fitted."""
    moments = stage(usable_moments(params, cols))
    h = loo_bandwidth(standardize(params, moments, cols), moments, len(cols))
    return moments.drop("sigma").join(h.select("class", "h"), "class")
