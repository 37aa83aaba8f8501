"""Quality rules: counted limits, then robust multivariate outliers per language and source.

Each document becomes a short vector of transformed statistics. For every (lang, source)
a minimum-covariance-determinant estimate of center and scatter is found by concentration
steps: compute all Mahalanobis distances, keep the closest share, take their mean and
covariance, repeat. Several starts take two steps each, the one of the smallest determinant goes on
until its determinant stops falling. One step is one aggregate over all documents: moments are summed per
group, start and distance bin, and the bins up to the wanted share make the next estimate, the
last one in part. Nothing is sampled and no group is gathered.

The bound is that of normal data, or wider where the bulk of a group's own distances is spread more widely.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored, with_python

MIN_WORDS, MAX_REPEATED = 20, 30        # words; percent of words in repeated windows
REPEAT_WINDOW = 8
MIN_GROUP = 50          # smaller groups share one estimate per language, then one in all
SHARE = 0.75            # of the rows of a group that an estimate is made of
TRIALS = 2              # steps of every start before the best one goes on
FALL = 1e-3             # the logarithm of the determinant has to fall by so much for another step
TAIL = 1e-3             # chi-square tail beyond which a document is an outlier
# Smallest standard deviations of the vector's parts. Those that are 0 in most documents have no scatter to estimate,
# so one symbol or line would be an outlier; the others only need a regular matrix, by their deviation in all rows.
FLOORS = {"word_length": 0.0, "symbols": 0.04, "dup_lines": 0.03, "repeats": 0.12, "capitals": 0.0}
RELATIVE, LEAST = 0.01, 1e-6
_BINS = 8               # distance bins per factor e
_SPACE = b" \t\n\v\f\r"
_SYMBOL = re.compile(rb"[#*$%&|<>]")
_CONTINUED = bytes(range(0x80, 0xC0))   # UTF-8 bytes that do not start a character
_NOT_UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals"]


def _repeated(words: list[bytes], width: int) -> int:
    """How many words lie in a window of ``width`` (a power of two) that occurs twice or more.

    Windows are numbered by doubling: equal numbers of two halves make an equal window.
    """
    n = len(words)
    if n <= width:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    if len(numbers) == n:
        return 0
    step = 1
    while step < width:
        ids = ids[:-step] * np.int64(n + 1) + ids[step:]
        step *= 2
        if step < width:
            ids = np.unique(ids, return_inverse=True)[1]
    order = np.argsort(ids, kind="stable")
    ordered = ids[order]
    again = ordered[1:] == ordered[:-1]
    if not again.any():
        return 0
    starts = order[np.r_[again, False] | np.r_[False, again]]
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + width, -1)
    return int((np.cumsum(edges[:n]) > 0).sum())


def text_counts(text: bytes | None) -> tuple[int, ...]:
    """The COUNTS of one text."""
    text = text or b""
    words = text.split()
    lines: set[bytes] = set()
    repeated_lines = 0
    for line in text.split(b"\n"):
        if line.strip(_SPACE):
            repeated_lines += line in lines
            lines.add(line)
    chars = sum(len(w) for w in words) - len(text) + len(text.translate(None, _CONTINUED))
    return (len(words), chars, len(_SYMBOL.findall(text)), repeated_lines, _repeated(words, REPEAT_WINDOW),
            len(text.translate(None, _NOT_UPPER)))


def with_statistics(rows: DataFrame) -> DataFrame:
    """``rows`` without ``text``, plus (*COUNTS, base_failed)."""
    counted = with_python(rows, "text", {c: T.LongType() for c in COUNTS},
                          lambda texts: list(zip(*map(text_counts, texts))) or [[] for _ in COUNTS], binary=True)
    return counted.withColumn("base_failed", F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEATED} * n_words"))


def vector() -> dict[str, Column]:
    """The transformed statistics; a text without words counts as one letter."""
    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return {"word_length": F.ln(chars / n), "symbols": F.sqrt(F.col("n_symbols") / chars),
            "dup_lines": F.sqrt(F.col("n_dup_lines") / n), "repeats": F.sqrt(F.col("n_repeat_words") / n),
            "capitals": F.sqrt(F.col("n_capitals") / chars)}


def chi_square(p: int, x: float) -> float:
    """Probability that a chi-square number with p degrees is below x."""
    half, s = x / 2, p / 2
    if half <= 0:
        return 0.0
    term = total = 1 / s
    k = 1
    while term > total * 1e-17:
        term *= half / (s + k)
        total += term
        k += 1
    return min(1.0, total * math.exp(s * math.log(half) - half - math.lgamma(s)))


def chi_square_quantile(p: int, share: float) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(p, middle) < share else (low, middle)
    return high


def _distance(names: list[str]) -> Column:
    """Squared Mahalanobis distance of the row's vector from its group's center."""
    p = len(names)
    terms = [f"({x} - center[{i}]) * ({names[j]} - center[{j}]) * inverse[{i * p + j}] * {1 if i == j else 2}"
             for i, x in enumerate(names) for j in range(i, p)]
    return F.expr(f"greatest({' + '.join(terms)}, 0D)")


def _estimates(p: int, share: float, floors: list[float]):
    """Per group: bins of moments -> center and inverse scatter of the closest ``share``.

    The scatter is corrected for the cut-off rest as for normal data.
    """
    correction = share / chi_square(p + 2, chi_square_quantile(p, share))

    def run(frames):
        for frame in frames:
            out = []
            for grp, start, bins in zip(frame["grp"], frame["start"], frame["bins"]):
                bins = sorted(bins, key=lambda b: b["bin"])
                sizes = np.array([b["n"] for b in bins], float)
                moments = np.array([b["moments"] for b in bins], float)
                wanted = share * sizes.sum()
                before = np.cumsum(sizes) - sizes
                part = np.clip((wanted - before) / sizes, 0, 1)
                total = part @ moments
                mean = total[:p] / wanted
                square = np.zeros((p, p))
                square[np.triu_indices(p)] = total[p:] / wanted
                square = square + np.triu(square, 1).T - np.outer(mean, mean)
                square *= correction
                spread = np.maximum(np.sqrt(np.clip(np.diag(square), 0, None)), floors)
                np.fill_diagonal(square, spread ** 2 * (1 + 1e-9))
                out.append((grp, start, mean.tolist(), np.linalg.inv(square).ravel().tolist(), np.linalg.slogdet(square)[1]))
            yield pd.DataFrame(out, columns=["grp", "start", "center", "inverse", "size"])

    return run


def _starts(rows: DataFrame, names: list[str], floors: list[float]) -> DataFrame:
    """(grp, start, center, inverse): medians with median deviations, lower quartiles with the same, means with deviations."""
    p = len(names)
    ranks = rows.groupBy("grp").agg(*[F.array(*[F.percentile_approx(c, q, 1000) for c in names]).alias(a) for a, q in (("center", 0.5), ("low", 0.25))],
                                    F.array(*[F.avg(c) for c in names]).alias("mean"), F.array(*[F.stddev_pop(c) for c in names]).alias("sd"))
    ranks = stored(ranks)
    mad = rows.join(ranks, "grp").groupBy("grp").agg(
        F.array(*[F.percentile_approx(F.abs(F.col(c) - F.col("center")[i]), 0.5, 1000) * 1.4826 for i, c in enumerate(names)]).alias("mad"))
    known = ranks.join(mad, "grp").select("grp", F.inline(F.array(*[
        F.struct(F.lit(k).alias("start"), F.col(at).alias("center"), F.col(spread).alias("spread"))
        for k, (at, spread) in enumerate((("center", "mad"), ("low", "mad"), ("mean", "sd")))])))
    diagonal = [F.pow(F.greatest(F.col("spread")[i], F.lit(floors[i])), -2) if i == j else F.lit(0.0) for i in range(p) for j in range(p)]
    return known.select("grp", "start", "center", F.array(*diagonal).alias("inverse"))


def robust_scatter(rows: DataFrame, names: list[str], floors: list[float], share: float = SHARE, steps: int | None = None) -> DataFrame:
    """(grp, center, inverse): minimum-covariance-determinant estimates of each group of ``rows`` (grp, *names).

    A part that does not vary gets its floor as standard deviation, so equal or repeated rows make no singular matrix.
    ``steps`` ends the search early; None goes on until no determinant falls.
    """
    p = len(names)
    run = _estimates(p, share, floors)
    summed = [*names, *(f"{names[i]} * {names[j]}" for i in range(p) for j in range(i, p))]
    moments = F.expr(f"array({', '.join(f'sum({x})' for x in summed)})")

    def step(current: DataFrame) -> DataFrame:
        distance = rows.join(current.select("grp", "start", "center", "inverse"), "grp").withColumn("bin", F.floor(F.ln(_distance(names) + 1e-6) * _BINS))
        sums = distance.groupBy("grp", "start", "bin").agg(F.count("*").alias("n"), moments.alias("moments"))
        bins = sums.groupBy("grp", "start").agg(F.collect_list(F.struct("bin", "n", "moments")).alias("bins"))
        return stored(bins.mapInPandas(run, "grp string, start int, center array<double>, inverse array<double>, size double"))

    current = stored(_starts(rows, names, floors))
    for _ in range(TRIALS):
        current = step(current)
    best = stored(current.groupBy("grp").agg(F.min(F.struct("size", "start", "center", "inverse")).alias("b")).select("grp", "b.*"))
    falling = best
    taken = TRIALS
    while (steps is None or taken < steps) and not falling.isEmpty():                # ends, as every step lowers a determinant that the floors bound
        after, taken = step(falling), taken + 1
        old = best.select("grp", F.col("size").alias("old"))
        falling = stored(after.join(old, "grp").where(F.col("size") < F.col("old") - FALL).drop("old"))
        best = stored(best.join(falling.select("grp"), "grp", "left_anti").unionByName(falling))
    return best.select("grp", "center", "inverse")


def fit(rows: DataFrame, share: float = SHARE, min_group: int = MIN_GROUP, tail: float = TAIL) -> DataFrame:
    """(its_lang, its_source, grp, center, inverse, bound) for every language and source of ``rows`` (with_statistics).

    Estimates are made of the documents that did not fail the counted limits. A group below
    ``min_group`` of them joins the rest of its language, a rest below it the rest of all; a
    rest of all below it has no estimate.
    """
    names = list(FLOORS)
    fine = rows.where("not base_failed").select("lang", "source", *[c.alias(n) for n, c in vector().items()])
    sizes = stored(fine.groupBy("lang", "source").count())
    by_lang = sizes.where(F.col("count") < min_group).groupBy("lang").agg(F.sum("count").alias("rest"))
    name = lambda *cols: F.to_json(F.array(*cols))
    level = (F.when(F.col("count") >= min_group, name(F.col("s.lang"), F.col("s.source")))
             .when(F.col("rest") >= min_group, name(F.col("s.lang"))).otherwise(F.lit("rest")))
    groups = stored(sizes.alias("s").join(by_lang.alias("b"), F.col("s.lang").eqNullSafe(F.col("b.lang")), "left")
                    .select(F.col("s.lang").alias("its_lang"), F.col("s.source").alias("its_source"), level.alias("grp"), "count"))
    enough = groups.groupBy("grp").agg(F.sum("count").alias("n")).where(F.col("n") >= min_group).select("grp")
    groups = stored(groups.join(enough, "grp").select("its_lang", "its_source", "grp"))
    known = stored(fine.join(groups, _its_group()).select("grp", *names))
    spreads = known.agg(*[F.stddev_pop(n) for n in names]).first()
    floors = [max(f, RELATIVE * (s or 0.0), LEAST) for f, s in zip(FLOORS.values(), spreads)]
    scatter = robust_scatter(known, names, floors, share)
    return stored(groups.join(scatter.join(bounds(known, scatter, names, tail), "grp"), "grp"))


def _scaled_bounds(p: int, tail: float):
    """Median and upper quartile of a group's squared distances -> its bound.

    The distances are taken as those of a scaled chi-square number whose scale and degrees of freedom give these two;
    parts that are 0 in most rows leave fewer degrees than there are parts. Never below the chi-square bound of all parts.
    """
    degrees = np.geomspace(p, 0.25, 40)
    at = np.array([[chi_square_quantile(d, q) for q in (0.5, 0.75, 1 - tail)] for d in degrees])
    ratio, least = at[:, 1] / at[:, 0], chi_square_quantile(p, 1 - tail)

    def run(frames):
        for frame in frames:
            q = np.maximum(np.stack(frame["q"]), 1e-9) if len(frame) else np.empty((0, 2))
            found = q[:, 0] * np.exp(np.interp(q[:, 1] / q[:, 0], ratio, np.log(at[:, 2] / at[:, 0])))
            yield pd.DataFrame({"grp": frame["grp"], "bound": np.maximum(found, least)})

    return run


def bounds(rows: DataFrame, scatter: DataFrame, names: list[str], tail: float) -> DataFrame:
    """(grp, bound): the squared distance beyond which a row is an outlier, from the bulk of the group's own distances."""
    ranks = rows.join(scatter, "grp").groupBy("grp").agg(F.percentile_approx(_distance(names), [0.5, 0.75], 1000).alias("q"))
    return ranks.mapInPandas(_scaled_bounds(len(names), tail), "grp string, bound double")


def _its_group() -> Column:
    return F.col("lang").eqNullSafe(F.col("its_lang")) & F.col("source").eqNullSafe(F.col("its_source"))


def _judged(rows: DataFrame, fitted: DataFrame) -> DataFrame:
    """``rows`` (with_statistics) with (grp, distance, kept)."""
    scored = rows.join(fitted, _its_group(), "left").withColumns(vector()).withColumn("distance", F.when(~F.col("base_failed"), F.round(_distance(list(FLOORS)), 6)))
    return scored.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= F.col("bound"), F.lit(True)))


def verdicts(docs: DataFrame, tail: float = TAIL, **options) -> DataFrame:
    """(doc_id, *COUNTS, base_failed, kept, grp, distance) per row of ``docs`` (doc_id, text, lang, source, ...).

    base_failed: too few words or too many repeated ones. kept: not base_failed and a squared
    distance within the group's bound (none, for want of an estimate: kept). Options are
    those of ``fit``.

    Null texts and texts without words are empty (base_failed). Null lang or source is a
    value of its own. Repeated rows get equal verdicts. An empty table gives an empty
    result. Other columns are not read. Texts are read whole.
    """
    rows = stored(with_statistics(docs.select("doc_id", "lang", "source", "text")))
    return _judged(rows, fit(rows, tail=tail, **options)).select("doc_id", *COUNTS, "base_failed", "kept", "grp", "distance")


def keep_good(docs: DataFrame, tail: float = TAIL, **options) -> DataFrame:
    """The rows of ``docs`` that ``verdicts`` keeps, with all their columns; nulls, empty texts and tables as there.

    The statistics are counted twice, once for the estimates and once beside each row, so
    that no text is shuffled or stored.
    """
    fitted = fit(stored(with_statistics(docs.select("lang", "source", "text"))), tail=tail, **options)
    return _judged(with_statistics(docs.select(F.struct("*").alias("row"), "lang", "source", "text")), fitted).where("kept").select("row.*")
