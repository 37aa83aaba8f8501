"""Simulator run logs: wide csv with a preamble to one row per entity and time step."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import batched, chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..staging import stage, store, store_all

# Column name patterns of the log, as the simulator writes them (fixed values).
HEADER_START = "Index"
TIME = "TimeStamp [s]"
ENTITY = r"^#(\d+) Entity_Name \[-\]$"
FIELDS = {"entity": "Entity_Name [-]", "x": "World_Position_X [m]", "y": "World_Position_Y [m]",
          "heading_rad": "World_Heading_Angle [rad]", "speed_mps": "Current_Speed [m/s]"}

CHUNK = 1 << 16         # lines of a split that learn of the lines before them together
BATCH = 1 << 13         # entries of folders that are listed and read together
LISTING = 4             # tasks per core that list folders
LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
KEEP_LISTINGS = "spark.sql.hive.manageFilesourcePartitions"     # in the driver's memory
IS_HEADER = f"startswith(trim(line), '{HEADER_START}')"
IS_FULL = "trim(line) <> ''"


def _entries(spark: SparkSession, paths: list[str]) -> Iterator[str]:
    """What the folders of ``paths`` (or of the matches of a pattern) hold, and the files among them, without hidden ones as Spark has it."""
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    for path in paths:
        pattern = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = pattern.getFileSystem(conf)
        found = files.globStatus(pattern)
        if not found:
            yield path          # Spark raises
        for status in found or []:
            if status.isFile():
                yield _literal(status)
                continue
            inside = files.listStatusIterator(status.getPath())
            while inside.hasNext():
                entry = inside.next()
                name = entry.getPath().getName()
                if not (name.startswith(".") or name.startswith("_") and "=" not in name):
                    yield _literal(entry)


def _literal(status) -> str:
    return re.sub(r"([{}\[\]*?\\])", r"\\\1", status.getPath().toString())


def _read_text(spark: SparkSession, paths: list[str]) -> DataFrame:
    ours = {LISTING_TASKS: min(int(spark.conf.get(LISTING_TASKS)), LISTING * spark.sparkContext.defaultParallelism), KEEP_LISTINGS: False}
    asked = {key: spark.conf.get(key) for key in ours}
    try:
        for key, value in ours.items():
            spark.conf.set(key, value)
        text = spark.read.option("recursiveFileLookup", True).text(paths)        # lists the files
    finally:
        for key, value in asked.items():
            spark.conf.set(key, value)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"),
                       F.struct(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row")).alias("ord"))


def read_run_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines of many logs: (file, line, ord), where ord is the order inside a file. Folders are read with all below them.

    Files are split like any text; split offset and row number inside the split give the
    order, so no file has to pass through one task as a whole. Folders (there may be one per run) are listed by a few tasks
    per core, where Spark by itself starts a task for each of up to 10,000. The driver never holds all files: beyond BATCH
    entries of the given folders, so many at a time are listed and their lines are stored.
    """
    paths = [path] if isinstance(path, str) else list(path)
    batches = map(list, batched(_entries(spark, paths), BATCH))
    first, second = next(batches, paths), next(batches, None)
    if second is None:
        return _read_text(spark, first)
    return store_all(spark, (_read_text(spark, batch) for batch in chain([first, second], batches)))


def _numbered(lines: DataFrame) -> DataFrame:
    """``lines`` with (split, row): the two parts of ``ord``, and part: stretches of CHUNK rows of one split."""
    split, row = ("ord.split", "ord.row") if isinstance(lines.schema["ord"].dataType, T.StructType) else ("0L", "ord")
    return lines.selectExpr("*", f"{split} as split", f"{row} as row", f"floor({row} / {CHUNK}) as part")


def carried(lines: DataFrame) -> DataFrame:
    """(file, split, part, header_ord, head, top): what each stretch of a log needs to know of the lines before it.

    lines: (file, line, split, row, part). head is the file's header line and top its first line with data after
    that. Both are found from one row per stretch and the lines of at most two stretches per file; the stretches that end
    before the header, and logs without one, are left out.
    """
    place = ["file", "split", "part"]
    parts = stage(lines.groupBy(*place).agg(F.min(F.when(F.expr(IS_HEADER), F.col("row"))).alias("header"), F.max(F.when(F.expr(IS_FULL), F.col("row"))).alias("last")))
    order = F.struct("split", "part")
    found = parts.where("header is not null").groupBy("file").agg(F.min(F.struct("split", "part", F.col("header").alias("row"))).alias("header_ord"))
    open_parts = stage(parts.join(found, "file").where(order >= F.struct("header_ord.split", "header_ord.part")))
    ahead = "(split, part) > (header_ord.split, header_ord.part)"
    first = open_parts.where(f"{ahead} and last is not null").groupBy("file").agg(F.min(order).alias("o")).selectExpr("file", "o.split", "o.part")
    opened = open_parts.where(f"not ({ahead})").select(*place).unionByName(first)
    at = F.struct("split", "part", "row")
    read = lines.join(opened, place).join(found, "file").where((at == F.col("header_ord")) | ((at > F.col("header_ord")) & F.expr(IS_FULL)))
    known = read.groupBy("file").agg(F.min(F.when(at == F.col("header_ord"), F.col("line"))).alias("head"),
                                     F.min(F.when(at > F.col("header_ord"), F.struct(at.alias("at"), "line"))).alias("top"))
    return open_parts.join(known.select("file", "head", "top.line"), "file").selectExpr(*place, "header_ord", "head", "line as top")


def tidy_run_log(lines: DataFrame, min_frame: Column | int, fps: float) -> DataFrame:
    """(file, entity, time_s, frame, x, y, heading_deg, speed_mps), one row per entity and step.

    lines: (file, line, ord, ...), where ord is a number or that of ``read_run_lines``. Everything up to the first line that starts with
    ``Index`` is skipped; that line is the header. An entity keeps the name of its first
    row. ``min_frame`` may be a column of ``lines``; frame = min_frame + time_s * fps.
    The lines are stored once, so header and data see the same order. Lines meet the header
    and the names by stretches of a file split, so one huge log is spread over all tasks.
    """
    base = F.lit(min_frame).cast("double") if isinstance(min_frame, int) else min_frame.cast("double")
    lines = store(_numbered(lines.select("file", "line", "ord", base.alias("min_frame"))).drop("ord"))
    place = ["file", "split", "part"]
    known = carried(lines).selectExpr(*place, "header_ord", "transform(split(head, ','), c -> trim(c)) as names", "transform(split(top, ','), c -> trim(c)) as firsts")
    number = f"regexp_extract(name, r'{ENTITY}', 1)"
    position = "cast(array_position(names, concat('#', {n}, ' {label}')) as int)"
    fields = ", ".join(f"""'{c}', {position.format(n=number, label=label)}""" for c, label in FIELDS.items())

    def value(of: str, at: str) -> str:
        return f"if({at} > 0, get({of}, {at} - 1), null)"

    known = known.selectExpr(*place, "header_ord", "firsts", f"cast(array_position(names, '{TIME}') as int) as time_at",
                             f"transform(filter(names, name -> name rlike r'{ENTITY}'), name -> named_struct({fields})) as entities")
    known = known.selectExpr(*place, "header_ord", "time_at", f"""transform(entities, e -> named_struct({", ".join(f"'{c}', e.{c}" for c in FIELDS if c != 'entity')},
                                 'name', {value('firsts', 'e.entity')})) as entities""")
    data = (lines.where(IS_FULL).join(known, place).where(F.struct("split", "part", "row") > F.col("header_ord"))
            .withColumn("values", F.transform(F.split("line", ","), lambda cell: F.trim(cell))))
    rows = data.select("file", "min_frame", "values", "time_at", F.explode("entities").alias("at"))
    return (rows.selectExpr("file", "at.name as entity", "min_frame", f"cast({value('values', 'time_at')} as double) as time_s",
                            *[f"cast(nullif({value('values', 'at.' + c)}, '') as double) as {c}" for c in FIELDS if c != "entity"])
            .select("file", "entity", "time_s", (F.col("min_frame") + F.col("time_s") * float(fps)).alias("frame"),
                    "x", "y", F.degrees("heading_rad").alias("heading_deg"), "speed_mps"))
