"""Chat formatting by multi-party perspective rotation.

For every participant the dialogue is rendered once with this speaker as assistant and all
others as named users; the mask marks what the speaker says. A rendering is cut into parts
of consecutive turns, so a conversation of any length is many small rows, with offsets that
run through. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored

TURNS = 64                  # turn numbers in a part
PARTS = 1024                # part numbers in a run
SYSTEM = ["system"]         # roles that are not participants and keep their role
UNNAMED = "unknown"         # name of a speaker whose role is null
START, END = "<|im_start|>", "<|im_end|>\n"


def perspectives(turns: DataFrame, width: int = TURNS, system: list[str] = SYSTEM) -> DataFrame:
    """(conv_id, participant, part, n_turns, text, char_start, char_end, masks) from turns (conv_id, turn, role, text, ...).

    Concatenating text over part (nulls last) gives the rendering. masks: ranges (start, end)
    of the participant's words in the whole rendering, in characters, end exclusive, with the
    end mark, without the header.

    Order is by turn (nulls last), role, text. A null role is a speaker named "unknown", a
    null text is empty, a null conv_id is one conversation. Repeated rows are repeated turns.
    A conversation of system turns alone has no participant and no rows. An empty table
    gives an empty result. Other columns are not read.
    """
    rows = turns.select("conv_id", "turn", F.floor(F.col("turn") / width).cast("bigint").alias("part"),
                        F.coalesce("role", F.lit(UNNAMED)).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = F.array_sort(F.collect_list(F.struct(F.col("turn").isNull().alias("last"), "turn", "role", "text")))
    parts = stored(rows.groupBy("conv_id", "part").agg(ordered.alias("said")))
    people = (parts.select("conv_id", F.explode(F.array_distinct(F.transform("said", lambda t: t["role"]))).alias("participant"))
              .where(~F.col("participant").isin(system)).distinct())
    people = stored(people.select(F.col("conv_id").alias("in_conv"), "participant"))
    listed = ", ".join(f"'{s}'" for s in system) or "''"
    shown = parts.join(people, F.col("conv_id").eqNullSafe(F.col("in_conv"))).select(
        "conv_id", "participant", "part", F.expr(f"""transform(said, t -> named_struct('own', t.role = participant,
            'head', concat('{START}', case when t.role = participant then 'assistant' when t.role in ({listed}) then t.role
                                           else concat('user name=', t.role) end, '\\n'), 'body', concat(t.text, '{END.replace(chr(10), chr(92) + "n")}')))""").alias("shown"))
    text = F.expr("array_join(transform(shown, s -> concat(s.head, s.body)), '')")
    ranges = F.expr("""filter(aggregate(shown, named_struct('at', 0L, 'masks', cast(array() as array<struct<start: bigint, end: bigint>>)),
        (a, s) -> named_struct('at', a.at + char_length(s.head) + char_length(s.body), 'masks', if(s.own, concat(a.masks,
            array(named_struct('start', a.at + char_length(s.head), 'end', a.at + char_length(s.head) + char_length(s.body)))), a.masks))).masks, m -> true)""")
    made = shown.select("conv_id", "participant", "part", F.size("shown").cast("bigint").alias("n_turns"), text.alias("text"), ranges.alias("ranges"))
    made = stored(made.withColumn("chars", F.char_length("text").cast("bigint")))
    places = stored(_starts(made)).select(*[F.col(c).alias(f"its_{c}") for c in ("conv_id", "participant", "part")], "char_start")
    same = [F.col(c).eqNullSafe(F.col(f"its_{c}")) for c in ("conv_id", "participant", "part")]
    return made.join(places, same[0] & same[1] & same[2]).select(
        "conv_id", "participant", "part", "n_turns", "text", "char_start", (F.col("char_start") + F.col("chars")).alias("char_end"),
        F.expr("transform(ranges, r -> named_struct('start', r.start + char_start, 'end', r.end + char_start))").alias("masks"))


def _starts(made: DataFrame) -> DataFrame:
    """(conv_id, participant, part, char_start): characters of the rendering before each part.

    Runs of PARTS parts are summed and added up first, then the parts inside each run, so the
    parts of a very long conversation are never ordered in one task.
    """
    rows = made.select("conv_id", "participant", "part", "chars", F.floor(F.col("part") / PARTS).alias("run"))

    def before(size: str, order: str, *keys: str) -> Column:
        window = W.partitionBy("conv_id", "participant", *keys).orderBy(F.col(order).asc_nulls_last())
        return F.coalesce(F.sum(size).over(window.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))

    runs = rows.groupBy("conv_id", "participant", "run").agg(F.sum("chars").alias("chars"))
    runs = runs.select(*[F.col(c).alias(f"of_{c}") for c in ("conv_id", "participant", "run")], before("chars", "run").alias("run_start"))
    inside = rows.select("conv_id", "participant", "part", "run", before("chars", "part", "run").alias("inside"))
    same = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in ("conv_id", "participant", "run")]
    return inside.join(runs, same[0] & same[1] & same[2]).select("conv_id", "participant", "part", (F.col("run_start") + F.col("inside")).alias("char_start"))


def sql(conversations: str = "conversations") -> str:
    """The same as DuckDB SQL, masks written as text."""
    return f"""with said as (select conv_id, turn, floor(turn / {TURNS})::bigint part, coalesce(role, '{UNNAMED}') speaker, coalesce(text, '') words from {conversations}),
        people as (select distinct conv_id, speaker participant from said where speaker not in ({", ".join(f"'{s}'" for s in SYSTEM)})),
        shown as (select s.*, participant, '{START}' || case when speaker = participant then 'assistant'
                when speaker in ({", ".join(f"'{s}'" for s in SYSTEM)}) then speaker else 'user name=' || speaker end || chr(10) head,
                words || '<|im_end|>' || chr(10) body from said s join people p on s.conv_id is not distinct from p.conv_id),
        placed as (select *, sum(length(head) + length(body)) over w - length(body) body_start, sum(length(head) + length(body)) over w body_end,
                row_number() over w n from shown
                window w as (partition by conv_id, participant order by turn nulls last, speaker, words rows between unbounded preceding and current row))
        select conv_id, participant, part, count(*)::bigint n_turns, string_agg(head || body, '' order by n) as text,
            min(body_start - length(head))::bigint char_start, max(body_end)::bigint char_end,
            coalesce(string_agg(body_start || '-' || body_end, ',' order by n) filter (where speaker = participant), '') masks
        from placed group by conv_id, participant, part"""
