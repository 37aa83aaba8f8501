"""Hard negatives from exact integer scores, computed by Strassen multiplication of tiles.

Anchors and candidates meet in the cells of a grid: (group of anchors, part of the candidates).
A task holds a group's quantised vectors as int64 tiles and multiplies each with tile after
tile of the cell's candidates, by Strassen's seven products of half tiles down to small leaves. Sides are
padded with zeros to multiples of the leaf grid. Integer additions and products have no rounding, and sums beyond 64 bits
wrap, so every score is exact. Best rows are kept in heaps, one per anchor and then one per anchor and
score window, that merge from tile to tile and from cell to cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

POSITIVES = 5
NEGATIVES = 10
LOW, HIGH = 30, 90      # percent of the positive's score
EVERY = 100             # anchors: vec_id divisible by this
SCALE = 256
GROUP = 4096            # anchors in a cell
CELL = 4096             # candidates in a cell
ROWS, COLUMNS = 256, 1024
LEAF = 16               # shortest side that is split no further
NORM = 1 << 50          # squared length of a quantised vector must stay below, so that 100 * score fits into 64 bits


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """Product of int64 matrices, modulo 2^64. Odd or short sides are padded with zeros."""
    (m, k), n = a.shape, b.shape[1]
    levels, side = 0, min(m, k, n)
    while side >= 2 * leaf:
        levels, side = levels + 1, side // 2
    unit = 1 << levels

    def padded(x: np.ndarray) -> np.ndarray:
        extra = [(0, -s % unit) for s in x.shape]
        return np.pad(x, extra) if any(e for _, e in extra) else x

    return _product(padded(a), padded(b), levels)[:m, :n]


def _product(a: np.ndarray, b: np.ndarray, levels: int) -> np.ndarray:
    if not levels:
        return a @ b
    m, k, n = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:m, :k], a[:m, k:], a[m:, :k], a[m:, k:]
    b11, b12, b21, b22 = b[:k, :n], b[:k, n:], b[k:, :n], b[k:, n:]
    p1 = _product(a11 + a22, b11 + b22, levels - 1)
    p2 = _product(a21 + a22, b11, levels - 1)
    p3 = _product(a11, b12 - b22, levels - 1)
    p4 = _product(a22, b21 - b11, levels - 1)
    p5 = _product(a11 + a12, b22, levels - 1)
    p6 = _product(a21 - a11, b11 + b12, levels - 1)
    p7 = _product(a12 - a22, b21 + b22, levels - 1)
    out = np.empty((2 * m, 2 * n), np.int64)
    out[:m, :n] = p1 + p4 - p5 + p7
    out[:m, n:] = p3 + p5
    out[m:, :n] = p2 + p4
    out[m:, n:] = p1 - p2 + p3 + p6
    return out


class Heaps:
    """The best ``k`` rows (highest score, then smallest order) of each slot."""

    def __init__(self, slots: int, k: int) -> None:
        self.k = k
        self.slot = self.score = self.order = np.empty(0, np.int64)
        self.least = np.full(slots, np.iinfo(np.int64).min)     # a row below this cannot enter

    def push(self, slot: np.ndarray, score: np.ndarray, order: np.ndarray) -> None:
        slot, score, order = (np.concatenate(x) for x in ((self.slot, slot), (self.score, score), (self.order, order)))
        at = np.lexsort((order, -score, slot))
        slot, score, order = slot[at], score[at], order[at]
        first = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]][:len(slot)])
        place = np.arange(len(slot)) - np.repeat(first, np.diff(np.r_[first, len(slot)]))
        keep = place < self.k
        full = place == self.k - 1
        self.slot, self.score, self.order = slot[keep], score[keep], order[keep]
        self.least[slot[full]] = score[full]


def _matrix(vectors: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for row, v in zip(out, vectors):
        row[:len(v) // 4] = np.frombuffer(v, np.int32)
    return out


_FOUND = "anchor long, slot int, score long, rid long"


class _Cell:
    """Anchors of one cell, and the heaps its candidates fill."""

    def __init__(self, width: int, k: int) -> None:
        self.width, self.k = width, k
        self.rid, self.label, self.q, self.bounds, self.heaps = [], [], [], [], None

    def add(self, rid: int, label: int, q: bytes, bounds: list | None) -> None:
        self.rid.append(rid), self.label.append(label), self.q.append(q), self.bounds.append(bounds)

    def meet(self, rids: list, labels: list, vectors: list) -> None:
        if self.heaps is None:
            self.windows = self.bounds[0] is not None if self.bounds else False
            self.slots = POSITIVES if self.windows else 1
            self.ids, self.classes, self.tiles = np.array(self.rid, np.int64), np.array(self.label, np.int64), _matrix(self.q, self.width)
            self.heaps = [Heaps(ROWS * self.slots, self.k) for _ in range(0, len(self.rid), ROWS)]
            if self.windows:        # scores from low to high; slots without a positive are empty
                self.low = np.full((len(self.rid), self.slots), 1, np.int64)
                self.high = np.zeros((len(self.rid), self.slots), np.int64)
                for i, scores in enumerate(self.bounds):
                    for j, s in enumerate(scores):
                        self.low[i, j], self.high[i, j] = -(-LOW * s // 100), HIGH * s // 100
        rids, labels, right = np.array(rids, np.int64), np.array(labels, np.int64), _matrix(vectors, self.width).T
        for number, heap in enumerate(self.heaps):
            part = slice(number * ROWS, (number + 1) * ROWS)
            scores = strassen(self.tiles[part], right)
            same = self.classes[part, None] == labels
            for slot in range(self.slots):
                least = heap.least.reshape(ROWS, self.slots)[:len(scores), slot, None]
                if self.windows:
                    fit = ~same & (scores >= np.maximum(self.low[part, slot, None], least)) & (scores <= self.high[part, slot, None])
                else:
                    fit = same & (scores >= least) & (self.ids[part, None] != rids)
                x, y = np.nonzero(fit)
                if len(x):
                    heap.push(x * self.slots + slot, scores[x, y], rids[y])

    def rows(self) -> pa.RecordBatch | None:
        if not self.heaps:
            return None
        anchors = np.concatenate([self.ids[n * ROWS + h.slot // self.slots] for n, h in enumerate(self.heaps)])
        columns = [np.concatenate([getattr(h, c) for h in self.heaps]) for c in ("slot", "score", "order")]
        return pa.RecordBatch.from_arrays([pa.array(anchors), pa.array((columns[0] % self.slots).astype(np.int32)), pa.array(columns[1]), pa.array(columns[2])],
                                          names=["anchor", "slot", "score", "rid"])


def _meet(width: int, k: int):
    """Sorted cells, each its anchors (kind 0) and then its candidates (kind 1), to the heaps of each cell."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, cell, waiting = None, None, []

        def flush() -> None:
            if waiting and cell.rid:
                cell.meet(*zip(*waiting))
            waiting.clear()

        for batch in batches:
            for grp, part, kind, rid, label, q, bounds in zip(*[c.to_pylist() for c in batch.columns]):
                if (grp, part) != key:
                    if cell is not None:
                        flush()
                        if (done := cell.rows()) is not None:
                            yield done
                    key, cell = (grp, part), _Cell(width, k)
                if kind:
                    waiting.append((rid, label, q))
                    if len(waiting) >= COLUMNS:
                        flush()
                else:
                    cell.add(rid, label, q, bounds)
        if cell is not None:
            flush()
            if (done := cell.rows()) is not None:
                yield done

    return run


def _numbers(n: int) -> Column:
    return F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))


def _best(anchors: DataFrame, rows: DataFrame, groups: int, cells: int, width: int, k: int) -> DataFrame:
    """(anchor, slot, score, rid, place), stored: the best ``k`` rows of each anchor's slots over all cells.

    anchors: (rid, label, q, bounds, vec_id). Each candidate is sent to every group of anchors once.
    """
    spread = F.pmod(F.xxhash64("rid"), F.lit(cells))
    dealt = anchors.select(F.pmod(F.xxhash64("rid", F.lit(1)), F.lit(groups)).alias("grp"), F.explode(_numbers(cells)).alias("cell"),
                           F.lit(0).alias("kind"), "rid", "label", "q", "bounds")
    met = rows.select(F.explode(_numbers(groups)).alias("grp"), spread.alias("cell"), F.lit(1).alias("kind"),
                      "rid", "label", "q", F.lit(None).cast("array<bigint>").alias("bounds"))
    found = stored(dealt.union(met).repartition("grp", "cell").sortWithinPartitions("grp", "cell", "kind", "rid").mapInArrow(_meet(width, k), _FOUND))
    place = F.row_number().over(Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "rid"))
    return stored(found.withColumn("place", place).where(F.col("place") <= k))


def quantised(vectors: DataFrame) -> DataFrame:
    """(rid, vec_id, label, q), stored: the rows that take part, numbered in order of vec_id (null last), label and vector.

    q: the components as int32, packed. A vector too long for exact scores raises.
    """
    usable = "label is not null and embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < cast('Infinity' as double))"
    whole = vectors.where(usable).selectExpr(
        "cast(vec_id as bigint) as vec_id", "cast(if(vec_id % 7 = 0, (label + 1) % 10, label) as bigint) as label",
        f"transform(embedding, x -> floor({SCALE} * cast(x as double))) as q")
    whole = whole.selectExpr("vec_id", "label", "q", "aggregate(q, 0D, (s, x) -> s + cast(x as double) * x) as norm")
    checked = whole.selectExpr("vec_id", "label", f"if(norm < {NORM}, q, raise_error('a vector is too long for exact 64-bit scores')) as q")
    packed = checked.mapInArrow(_pack, "vec_id bigint, label bigint, q binary, width bigint")
    order = [F.col("vec_id").isNull(), "vec_id", "label", "q"]
    ranged = packed.repartitionByRange(order[0], "vec_id", "label").sortWithinPartitions(*order)
    return stored(ranged.select(F.monotonically_increasing_id().alias("rid"), "*"))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = [np.array(v, np.int32) for v in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([v.tobytes() for v in vectors], pa.binary()),
                                          pa.array([len(v) for v in vectors], pa.int64())], names=["vec_id", "label", "q", "width"])


def hard_negatives(vectors: DataFrame) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for ``vectors`` (vec_id, embedding, label, ...).

    Rows with a null label, a null vector or a null or non-finite component take no part. Where vec_id is
    divisible by 7, label becomes (label + 1) % 10. Components become floor(256 x); a score is the inner product, shorter vectors
    being padded with zeros. Anchors are the rows whose vec_id is divisible by EVERY, their positives the best POSITIVES other rows of
    their label, and the negatives of a positive the best NEGATIVES rows of other labels with LOW % to HIGH % of its score. Ties go to the
    smaller vec_id, a null one last, then to the smaller label and vector. Repeated rows are rows of their own: an anchor's twin
    is one of its positives, and two equal anchors have equal results. An empty table gives an empty result.
    """
    rows = quantised(vectors)
    total, width = rows.agg(F.count("*"), F.coalesce(F.max("width"), F.lit(1))).first()
    anchors = rows.where(f"vec_id % {EVERY} = 0")
    # The grid only deals the work: enough cells for all tasks, none too large for one.
    wide = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = max(1, -(-anchors.count() // GROUP))
    cells = max(1, -(-total // CELL), min(wide, total // 512))
    positives = _best(anchors.withColumn("bounds", F.lit(None).cast("array<bigint>")), rows, groups, cells, max(1, width), POSITIVES)
    scores = positives.groupBy("anchor").agg(F.expr("transform(sort_array(collect_list(struct(place, score))), p -> p.score) as bounds"))
    searched = stored(anchors.join(scores.withColumnRenamed("anchor", "rid"), "rid"))
    negatives = _best(searched, rows, groups, cells, max(1, width), NEGATIVES)
    pairs = negatives.select("anchor", (F.col("slot") + 1).alias("slot"), F.col("place").alias("rank"), F.col("score").alias("negative_score"), F.col("rid").alias("negative"))
    pairs = pairs.join(positives.select("anchor", F.col("place").alias("slot"), F.col("score").alias("positive_score"), F.col("rid").alias("positive")), ["anchor", "slot"])
    for role in ("anchor", "positive", "negative"):
        pairs = pairs.join(rows.select(F.col("rid").alias(role), F.col("vec_id").alias(f"{role}_id")), role)
    return pairs.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


SQL = f"""
with rows as (
    select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
           list_transform(embedding, lambda x: floor({SCALE} * x::double)) as q
    from embeddings
    where label is not null and embedding is not null
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scores as (
    select a.vec_id as anchor_id, c.vec_id as vec_id, a.label = c.label as same, list_inner_product(a.q, c.q)::bigint as score
    from rows a, rows c where a.vec_id % {EVERY} = 0 and a.vec_id <> c.vec_id),
positives as (
    select anchor_id, vec_id as positive_id, score as positive_score from scores where same
    qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= {POSITIVES})
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score
from (select p.*, s.vec_id as negative_id, s.score as negative_score,
             row_number() over (partition by anchor_id, positive_id order by s.score desc, s.vec_id) as rank
      from positives p join scores s using (anchor_id)
      where not s.same and {LOW} * positive_score <= 100 * s.score and 100 * s.score <= {HIGH} * positive_score)
where rank <= {NEGATIVES}
"""
