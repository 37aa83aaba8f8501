"""Line dedup by overlapping three-line windows.

Every three consecutive lines with a word make a window. Windows are hashed and counted
over the whole corpus; of a repeated window the first occurrence stays, the lines of all
later ones go. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_key, stored

LINES = 3


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def windows(docs: DataFrame, width: int = LINES) -> DataFrame:
    """(doc_id, key, at, lines, window): every window of ``docs``, at = its place among the lines with
    a word, lines = the places of its lines in the text, window = 128-bit hash."""
    split = docs.select("doc_id", row_key("doc_id", "text").alias("key"), _lines(F.col("text")).alias("all"))
    full = split.select("doc_id", "key", F.expr(r"""filter(transform(all, (x, i) -> struct(i as at, if(x rlike '[^\\x20\\x09-\\x0D]', md5(cast(x as binary)), null) as hash)),
                                                    x -> x.hash is not null)""").alias("full"))
    made = F.expr(f"""transform(sequence(0, size(full) - {width}), i -> struct(i as at,
                      transform(slice(full, i + 1, {width}), x -> x.at) as lines,
                      md5(cast(array_join(transform(slice(full, i + 1, {width}), x -> x.hash), '') as binary)) as window))""")
    return full.where(F.size("full") >= width).select("doc_id", "key", F.inline(made))


def repeated_lines(docs: DataFrame, width: int = LINES) -> DataFrame:
    """(doc_id, key, lines): per document with any, the places of the lines that go, merged and in order."""
    found = stored(windows(docs, width).select("doc_id", "key", "at", "lines", F.unhex("window").alias("window")))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key", "at")
    first = found.distinct().groupBy("window").agg(F.min(F.struct(order.alias("o"), "lines")).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = stored(first.select("window", "first"))
    own = F.col("doc_id").eqNullSafe(F.col("first.o.doc_id")) & (F.col("key") == F.col("first.o.key"))
    later = (found.join(first, "window").where(~(own & (F.col("at") == F.col("first.o.at"))))
             .select("doc_id", "key", F.explode(F.when(own, F.array_except("lines", "first.lines")).otherwise(F.col("lines"))).alias("line")))
    return later.groupBy("doc_id", "key").agg(F.array_sort(F.collect_set("line")).alias("lines"))


def deduplicated(docs: DataFrame, width: int = LINES) -> DataFrame:
    """(row, n_lines, n_removed, clean_text) per row of ``docs`` (doc_id, text, ...).

    The first occurrence is that of the smallest doc_id (null last) and the earliest line. A
    line goes if a later occurrence of any window covers it, unless it belongs to the same
    window's first occurrence. Lines without a word are in no window and stay. Documents of
    fewer than ``width`` lines with a word stay whole.

    Null texts stay null (no lines). Rows equal in doc_id and text are one document: all are
    cut alike. An empty table gives an empty result. Texts are read whole.
    """
    gone = stored(repeated_lines(docs, width))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), row_key("doc_id", "text").alias("its_key"))
    joined = rows.join(gone.hint("merge"), F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("its_key") == F.col("key")), "left")     # gone grows with the corpus
    # The stretches between lines that go, each cut out once, so a text costs time in proportion to its length.
    text = F.when(F.col("lines").isNull(), F.col("row.text")).otherwise(F.expr(r"""array_join(flatten(get(transform(
        array(struct(split(row.text, '\n') as have, concat(array(-1), lines) as cut)),
        s -> transform(s.cut, (at, i) -> slice(s.have, at + 2, coalesce(get(s.cut, i + 1), size(s.have)) - at - 1))), 0)), '\n')"""))
    return joined.select("row", F.when(F.col("row.text").isNull(), 0).otherwise(F.size(_lines(F.col("row.text")))).cast("bigint").alias("n_lines"),
                         F.coalesce(F.size("lines"), F.lit(0)).cast("bigint").alias("n_removed"), text.alias("clean_text"))


def sql(documents: str = "documents") -> str:
    """The same as DuckDB SQL, for doc_ids without repeats and nulls."""
    return rf"""with split as (select doc_id, text, string_split(text, chr(10)) l from {documents}),
        numbered as (select doc_id, unnest(l) line, generate_subscripts(l, 1) - 1 n from split),
        full_lines as (select *, row_number() over (partition by doc_id order by n) - 1 pos from numbered where regexp_matches(line, '[^\x20\x09-\x0D]')),
        made as (select a.doc_id, a.pos, a.n n1, b.n n2, c.n n3, md5(a.line || chr(10) || b.line || chr(10) || c.line) w from full_lines a
            join full_lines b on a.doc_id = b.doc_id and b.pos = a.pos + 1 join full_lines c on a.doc_id = c.doc_id and c.pos = a.pos + 2),
        ranked as (select *, row_number() over (partition by w order by doc_id, pos) r, first_value(doc_id) over f fd, first_value(n1) over f f1,
            first_value(n2) over f f2, first_value(n3) over f f3 from made window f as (partition by w order by doc_id, pos)),
        gone as (select distinct doc_id, x n from (select *, unnest([n1, n2, n3]) x from ranked where r > 1) where fd <> doc_id or x not in (f1, f2, f3)),
        kept as (select s.doc_id, string_agg(s.line, chr(10) order by s.n) clean from numbered s anti join gone g on s.doc_id = g.doc_id and s.n = g.n group by 1)
        select d.doc_id, coalesce(len(d.l), 0)::bigint n_lines, coalesce(g.n, 0)::bigint n_removed,
            md5(case when d.text is null then null else coalesce(k.clean, '') end) clean_md5
        from split d left join kept k on k.doc_id = d.doc_id left join (select doc_id, count(*) n from gone group by 1) g on g.doc_id = d.doc_id"""
