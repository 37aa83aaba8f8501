"""Frame blocks: the physical layout all interaction operators share.

A track is cut into blocks of ``BLOCK`` consecutive frame numbers, one row per
(recording, track, block) that holds the block's samples as an array.
Interactions are cut into the same blocks, so every interaction-to-track join is
an equi-join on (recording, track, block):

* a very long track is many small rows spread over the cluster, never one group;
* samples are shuffled once, already combined to blocks, however many interactions look at them;
* what travels per interaction is one row per block instead of one per sample;
* blocks that very many interactions look at are stored in several salted copies, and
  each interaction reads one of them, so no task serves all of them.

A catalogue says which blocks really exist, and which frames each one holds: one row (page) per
PAGE block numbers of a track with a bit mask of every block. Windows meet the catalogue before any sample is
moved, as bucketed intervals, so gaps of billions of frame numbers cost nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import KEY, SAMPLE_FIELDS
from ..staging import append_bucketed, bucket_count, stage_bucketed, store

BLOCK = 16
PAGE_BITS = 10                  # a page is 2^10 block numbers
FANOUT_BITS = 4                 # pages in a node of the next level
ROLES = ("ego", "target")
POSITION = "{0} is not null and {1} is not null and not isnan({0}) and not isnan({1})"

# Size of the bitmap that the scan of samples tests; more keys than bits only make it let more rows pass.
FILTER_BITS = 1 << 20
FILL = 16

# A block that more than HOT interactions look at is split into salted copies.
HOT = 10_000

TRACK = ["recording_id", "track_id"]
TRACK_BLOCK = [*TRACK, "block", "salt"]


def block_of(frame: str) -> str:
    return f"(({frame} - pmod({frame}, {BLOCK}L)) div {BLOCK})"


def page_of(block: str) -> str:
    return f"shiftright({block}, {PAGE_BITS})"


def referenced_tracks(scenarios: DataFrame, roles: tuple[str, ...] = ROLES) -> DataFrame:
    """Distinct (recording, track) that some interaction names in one of the roles."""
    return scenarios.selectExpr("recording_id", f"explode(array({', '.join(roles)})) as track_id").distinct()


def copies_of(block: str, hot: str) -> str:
    """In how many copies a block is stored."""
    return f"coalesce(get(filter({hot}, h -> {block} between h.from and h.to), 0).salts, 1L)"


def salt_of(block: str, cover: str) -> str:
    """Which copy of a block an interaction reads."""
    return f"if({cover}.hot is null, 0L, pmod(xxhash64({', '.join(KEY)}), {copies_of(block, f'{cover}.hot')}))"


# ---------------------------------------------------------------- what the scan lets pass

def _bit(columns: list[str]) -> str:
    return f"pmod(xxhash64({', '.join(columns)}), {FILTER_BITS})"


def bitmap(keys: DataFrame, columns: list[str], *more: str) -> tuple[str, list]:
    """A condition that holds for all rows whose ``columns`` are those of a row of ``keys`` (and for few
    others), to be tested inside a scan; and the smallest or largest value of each aggregate ``more``.

    At most FILTER_BITS / 64 rows go to the driver, however many keys there are.
    """
    marked = keys.selectExpr("*", f"{_bit(columns)} as bit").groupBy(F.expr("bit div 64").alias("word"))
    words = marked.agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int))) as bits"), *[F.expr(f"{m} as m{i}") for i, m in enumerate(more)]).collect()
    dense = [0] * (FILTER_BITS // 64)
    for r in words:
        dense[r.word] = r.bits
    # As small as it can be with at most one bit in FILL set: the bit of a key modulo half the size is in the halves' union.
    while len(dense) > 1 and FILL * sum(w.bit_count() if w >= 0 else (w & (1 << 64) - 1).bit_count() for w in dense) <= 32 * len(dense):
        half = len(dense) // 2
        dense = [a | b for a, b in zip(dense[:half], dense[half:])]
    bits = f"cast(split('{','.join(map(str, dense))}', ',') as array<bigint>)"
    bit = f"pmod(xxhash64({', '.join(columns)}), {64 * len(dense)})"
    found = f"get({bits}, cast({bit} div 64 as int)) & shiftleft(1L, cast({bit} % 64 as int))"
    best = [(min if m.startswith("min") else max)((r[f"m{i}"] for r in words if r[f"m{i}"] is not None), default=None) for i, m in enumerate(more)]
    return f"coalesce({found}, 0L) <> 0", best


def in_use(tracks: DataFrame, scenarios: DataFrame, roles: tuple[str, ...]) -> DataFrame:
    """Samples of tracks that interactions name, within the frames they name; filtered by the scan, without a join."""
    names = scenarios.selectExpr("recording_id", "cast(min_frame as bigint) as lo", "cast(max_frame as bigint) as hi",
                                 f"explode(array({', '.join(f'cast({r} as bigint)' for r in roles)})) as track_id")
    named, (lo, hi, first, last) = bitmap(names, TRACK, "min(lo)", "max(hi)", "min(track_id)", "max(track_id)")
    if first is None or lo is None or hi is None:
        return tracks.where("false")
    return tracks.where(f"frame >= {lo}L and frame <= {hi}L and track_id >= {first}L and track_id <= {last}L").where(named)


# ---------------------------------------------------------------- the catalogue

def catalogue(tracks: DataFrame) -> DataFrame:
    """(recording_id, track_id, page, blocks: array<struct<block, mask>>), stored: the blocks that hold samples with a
    position, in order, with bit k of ``mask`` set if the k-th frame is there. Rows are combined before each shuffle."""
    blocks = (tracks.where("frame is not null").where(POSITION.format("x", "y"))
              .groupBy(*TRACK, F.expr(f"{block_of('frame')} as block")).agg(F.expr(f"bit_or(shiftleft(1, cast(pmod(frame, {BLOCK}L) as int))) as mask")))
    return store(blocks.groupBy(*TRACK, F.expr(f"{page_of('block')} as page")).agg(F.expr("sort_array(collect_list(struct(block, mask))) as blocks")))


def _node_levels(low: str, high: str, levels: int) -> str:
    """Nodes (level, node) that make up the pages low..high, at most 2^(FANOUT_BITS + 1) a level; a node of level l
    stands for 2^(l FANOUT_BITS) pages."""
    def whole(level: int) -> tuple[str, str]:       # nodes inside the range: from, up to
        bits = level * FANOUT_BITS
        return f"shiftright({low} + {(1 << bits) - 1}L, {bits})", f"shiftright({high} + 1L, {bits})"

    parts = []
    for level in range(levels):
        a, b = whole(level)
        if level == levels - 1:
            spans = [(a, b)]
        else:
            up, down = (f"shiftleft({x}, {FANOUT_BITS})" for x in whole(level + 1))
            spans = [(a, f"if({up} < {down}, least({b}, {up}), {b})"), (f"if({up} < {down}, greatest({a}, {down}), {b})", b)]
        parts += [f"if({x} < {y}, transform(sequence({x}, {y} - 1L), n -> struct({level} as level, n as node)), "
                  f"cast(array() as array<struct<level: int, node: bigint>>))" for x, y in spans]
    return f"concat({', '.join(parts)})"


_LOWEST = "bit_count((e.mask & -e.mask) - 1)"
_HIGHEST = "length(bin(e.mask)) - 1"
_NO_RUNS = "cast(null as array<struct<from: bigint, to: bigint, salts: bigint>>)"


def seen_pages(windows: DataFrame, pages: DataFrame) -> DataFrame:
    """Window rows (KEY, track_id, lo, hi, ...) joined to the catalogue pages they touch, with page, n (frames inside the
    window), first and last of them, and runs: array<struct<from, to>> of neighbouring blocks."""
    low, high = pages.agg(F.min("page"), F.max("page")).first()
    if low is None:
        low = high = 0
    levels = 1
    while (high - low) >> (FANOUT_BITS * levels):
        levels += 1
    nodes = pages.selectExpr("*", f"explode(sequence(0, {levels - 1})) as level").selectExpr(
        "*", f"shiftright(page, level * {FANOUT_BITS}) as node") if levels > 1 else pages.selectExpr("*", "0 as level", "page as node")
    asked = (windows.where("lo <= hi").selectExpr("*", f"{block_of('lo')} as b0", f"{block_of('hi')} as b1")
             .selectExpr("*", f"greatest({page_of('b0')}, {low}L) as p0", f"least({page_of('b1')}, {high}L) as p1").where("p0 <= p1")
             .selectExpr("*", f"inline({_node_levels('p0', 'p1', levels)})"))
    edge = f"""e.mask & if(e.block = b0, shiftleft(-1, cast(pmod(lo, {BLOCK}L) as int)), -1)
        & if(e.block = b1, shiftleft(2, cast(pmod(hi, {BLOCK}L) as int)) - 1, -1)"""
    inside = f"filter(transform(filter(blocks, e -> e.block between b0 and b1), e -> struct(e.block as block, {edge} as mask)), e -> e.mask <> 0)"
    keep = [c for c in windows.columns if c not in ("lo", "hi")]
    rows = asked.join(nodes, [*TRACK, "level", "node"]).selectExpr(*keep, "page", f"{inside} as e_all").where("size(e_all) > 0")
    starts = "filter(transform(e_all, (e, i) -> if(i > 0 and get(e_all, i - 1).block = e.block - 1, null, e.block)), b -> b is not null)"
    ends = "filter(transform(e_all, (e, i) -> if(get(e_all, i + 1).block = e.block + 1, null, e.block)), b -> b is not null)"
    return (rows.selectExpr("*", f"{starts} as starts", f"{ends} as ends", "get(e_all, 0) as head", "get(e_all, size(e_all) - 1) as tail")
            .selectExpr(*keep, "page", "aggregate(e_all, 0L, (n, e) -> n + bit_count(e.mask)) as n",
                        f"head.block * {BLOCK} + {_LOWEST.replace('e.', 'head.')} as first", f"tail.block * {BLOCK} + {_HIGHEST.replace('e.', 'tail.')} as last",
                        "transform(starts, (b, i) -> struct(b as from, ends[i] as to)) as runs"))


def crowded_blocks(seen: DataFrame) -> DataFrame:
    """(recording_id, track_id, block, salts), stored: blocks that more than HOT windows touch, and in how many copies they are kept."""
    busy = seen.groupBy(*TRACK, "page").count().where(f"count > {HOT}").drop("count")
    touched = seen.join(busy, [*TRACK, "page"], "left_semi").selectExpr(
        *TRACK, "explode(flatten(transform(runs, r -> sequence(r.from, r.to)))) as block")
    return store(touched.groupBy(*TRACK, "block").count().where(f"count > {HOT}").selectExpr(
        *TRACK, "block", f"cast(ceil(count / {HOT}) as bigint) as salts"))


def hot_runs(crowded: DataFrame) -> DataFrame:
    """(recording_id, track_id, hot: array<struct<from, to, salts>>): runs of neighbouring blocks with equally many copies."""
    return crowded.groupBy(*TRACK).agg(F.expr("sort_array(collect_list(struct(block, salts))) as crowded")).selectExpr(*TRACK, f"{_RUNS} as hot")


# Crowded blocks in order -> runs of neighbours with equally many copies.
_RUNS = """aggregate(crowded, cast(array() as array<struct<from: bigint, to: bigint, salts: bigint>>), (runs, b) ->
    if(size(runs) > 0 and try_element_at(runs, -1).to = b.block - 1 and try_element_at(runs, -1).salts = b.salts,
       concat(slice(runs, 1, size(runs) - 1), array(named_struct('from', try_element_at(runs, -1).from, 'to', b.block, 'salts', b.salts))),
       concat(runs, array(named_struct('from', b.block, 'to', b.block, 'salts', b.salts)))))"""


# ---------------------------------------------------------------- the blocks themselves

def chunk_tracks(tracks: DataFrame, crowded: DataFrame | None = None, fields: list[str] = SAMPLE_FIELDS) -> DataFrame:
    """(recording_id, track_id, block, salt, samples, x0, x1, y0, y1, f0, f1, px, py), stored and bucketed.

    ``samples`` is in frame order; x0..y1 is the bounding box, f0, f1 the frame range, and px, py the first position.
    Samples without a position are left out (they have no distance to anything). Repeated
    rows of a frame are reduced to the smallest by ``fields`` order. Every frame of a block is an
    aggregate of its own, so samples are combined to blocks, and copies to one, before the only
    shuffle, and that shuffle is also the bucketing of the table. ``fields`` must be a prefix of SAMPLE_FIELDS to
    keep the tie order. ``crowded`` blocks are appended in further copies.
    """
    spark = tracks.sparkSession
    rows = (tracks.where("frame is not null").where(POSITION.format("x", "y"))
            .selectExpr(*TRACK, f"{block_of('frame')} as block", "pmod(frame, 1L) as salt", f"pmod(frame, {BLOCK}L) as slot",
                        f"struct(frame, {', '.join(fields)}) as sample"))
    slots = [F.expr(f"min(sample) filter (where slot = {k}) as s{k}") for k in range(BLOCK)]
    blocks = rows.groupBy(*TRACK_BLOCK).agg(*slots).selectExpr(*TRACK_BLOCK, f"filter(array({', '.join(f's{k}' for k in range(BLOCK))}), s -> s is not null) as samples")
    if bucket_count(spark) != int(spark.conf.get("spark.sql.shuffle.partitions")):
        blocks = blocks.repartition(bucket_count(spark), *TRACK_BLOCK)
    ends = [f"array_{agg}(samples.{c}) as {c}{i}" for c in "xy" for i, agg in enumerate(("min", "max"))]
    table = stage_bucketed(blocks.selectExpr("*", *ends, "get(samples, 0).frame as f0", "get(samples, size(samples) - 1).frame as f1",
                                               "get(samples, 0).x as px", "get(samples, 0).y as py"), TRACK_BLOCK)
    if crowded is not None:
        copies = table.drop("salt").join(crowded, [*TRACK, "block"]).selectExpr(*TRACK, "block", "explode(sequence(1L, salts - 1)) as salt",
                                                                             *[c for c in table.columns if c not in TRACK_BLOCK])
        table = append_bucketed(table, store(copies.repartition(bucket_count(spark), *TRACK_BLOCK)))
    return table


def rejected_samples(tracks: DataFrame) -> DataFrame:
    """(recording_id, track_id, samples, rejected): how many rows of each track lack a frame or a
    position, so that ``chunk_tracks`` leaves them out."""
    return tracks.groupBy("recording_id", "track_id").agg(
        F.count("*").alias("samples"), F.expr(f"count_if(not (frame is not null and {POSITION.format('x', 'y')}))").alias("rejected"))


# The samples of a block row with lo <= frame <= hi; only blocks at a window's edge are filtered.
IN_WINDOW = """case when f0 >= lo and f1 <= hi then samples
    else filter(samples, s -> s.frame >= lo and s.frame <= hi) end"""


def role_windows(scenarios: DataFrame, carry: list[str] = (), roles: tuple[str, ...] = ROLES) -> DataFrame:
    """(KEY, carry, role, track_id, lo, hi): the roles of each interaction with its frame window."""
    roles = ", ".join(f"struct('{r}' as role, cast({r} as bigint) as track_id)" for r in roles)
    return scenarios.selectExpr(*KEY, *carry, "cast(min_frame as bigint) as lo", "cast(max_frame as bigint) as hi", f"inline(array({roles}))")


def real_blocks(cover: str, low: str, high: str) -> str:
    """Array of the blocks from ``low`` to ``high`` that exist."""
    return f"""flatten(transform(filter({cover}.runs, r -> r.to >= {low} and r.from <= {high}),
        r -> sequence(greatest(r.from, {low}), least(r.to, {high}))))"""


def explode_blocks(windows: DataFrame) -> DataFrame:
    """One row per block (with salt) that exists in the frame range [lo, hi] of a row."""
    return (windows.where("lo <= hi").selectExpr("*", f"explode({real_blocks('cover', block_of('lo'), block_of('hi'))}) as block")
            .selectExpr("*", f"{salt_of('block', 'cover')} as salt"))


def in_blocks(windows: DataFrame, chunks: DataFrame) -> DataFrame:
    """Window rows (KEY, track_id, lo, hi, cover, ...) joined to each block they touch."""
    return explode_blocks(windows).join(chunks, TRACK_BLOCK)


def attach(windows: DataFrame, chunks: DataFrame) -> DataFrame:
    """``in_blocks`` with ``samples`` clipped to the window (possibly empty at its edge)."""
    keep = [c for c in windows.columns if c not in TRACK_BLOCK]
    return in_blocks(windows, chunks).selectExpr(*TRACK_BLOCK, *keep, f"{IN_WINDOW} as samples")


def boxes(chunks: DataFrame) -> DataFrame:
    """The blocks without their samples; a scan of a few short columns."""
    return chunks.drop("samples")


def opened(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rows that name a block (TRACK_BLOCK, lo, hi, f0, f1) with its ``samples``, clipped to the window."""
    return rows.join(chunks.select(*TRACK_BLOCK, "samples"), TRACK_BLOCK).selectExpr(*rows.columns, f"{IN_WINDOW} as samples")


def role_view(pairs: DataFrame, role: str, *extra: str) -> DataFrame:
    """Pairs as window rows of one role's track."""
    return pairs.selectExpr(*KEY, *extra, f"{role} as track_id", f"{role}_lo as lo", f"{role}_hi as hi", f"{role}_cover as cover")
