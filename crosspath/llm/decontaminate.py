"""Benchmark decontamination: find benchmark word windows in training texts and remove them.

The windows of all benchmark items form a hash set. Every window of every document is
looked up in it by its hash, hits are verified word by word, and the covered words add up
to spans. The hash set is broadcast when its counted windows and bytes are within bounds, and joined by
hash otherwise. Built-in functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_key, stored

WINDOW = 10
BROADCAST_WINDOWS, BROADCAST_BYTES = 200_000, 64 << 20      # both counted before a hash set is broadcast
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of the text with A-Z lower-cased; an empty array for null."""
    return F.array_remove(F.split(F.coalesce(F.translate(text, _UPPER, _LOWER), F.lit("")), _NO_WORD), "")


def benchmark_windows(items: DataFrame, width: int = WINDOW) -> DataFrame:
    """(hash, size, gram, item_ids): the distinct windows of the items' words, and who has them.

    An item of fewer than ``width`` words is one window; one without words has none.
    """
    split = items.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    split = split.withColumn("size", F.least(F.size("w"), F.lit(width)))
    grams = split.select("item_id", "size", F.explode(F.expr("transform(sequence(0, size(w) - size), i -> slice(w, i + 1, size))")).alias("gram"))
    found = grams.groupBy("gram", "size").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    return found.select(F.xxhash64("gram").alias("hash"), "size", "gram", "item_ids")


def hits(docs: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """(doc_id, key, at, size, item_ids): every occurrence of a benchmark window, at = first word, from 0.

    Rows of ``docs`` that are equal in doc_id and text are one document here (same key).
    """
    windows = stored(benchmark_windows(items, width))
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())      # 1 to width
    octets = F.octet_length(F.array_join("gram", " ")) + F.octet_length(F.array_join("item_ids", ","))
    n_windows, n_bytes = windows.agg(F.count("*"), F.coalesce(F.sum(octets), F.lit(0))).first()
    side = F.broadcast(windows) if n_windows <= BROADCAST_WINDOWS and n_bytes <= BROADCAST_BYTES else windows
    split = docs.select("doc_id", row_key("doc_id", "text").alias("key"), words(F.col("text")).alias("w"))
    scans = []
    for size in sizes:
        places = split.select("doc_id", "key", "w", F.posexplode("w").alias("at", "word")).where(f"at + {size} <= size(w)")
        grams = places.select("doc_id", "key", "at", F.slice("w", F.col("at") + 1, size).alias("found"))
        scans.append(grams.withColumn("hash", F.xxhash64("found")).join(side.where(f"size = {size}"), "hash").where("found = gram")
                     .select("doc_id", "key", "at", "size", "item_ids"))
    if not scans:
        return split.select("doc_id", "key", F.lit(0).alias("at"), F.lit(0).alias("size"), F.array(F.lit("")).alias("item_ids")).limit(0)
    return reduce(DataFrame.union, scans)


def contamination(docs: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans) per row of ``docs``.

    n_hit: words inside any occurrence of a window. n_items: items with occurring windows;
    items_sha256: SHA-256 of their ids, sorted as strings, comma-joined (of the empty text
    if none). spans: the covered word ranges (first, last), merged, in order.

    Null and empty texts have no words. Items with a null id count under no id. Repeated
    rows get equal results. Empty tables give an empty result or no hits. Other columns are
    not read.
    """
    found = hits(docs, items, width)
    per_doc = found.groupBy("doc_id", "key").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("ids"),
        F.array_sort(F.collect_set(F.struct("at", (F.col("at") + F.col("size") - 1).alias("last")))).alias("ranges"))
    spans = F.expr("""aggregate(ranges, cast(array() as array<struct<at: int, last: int>>), (done, r) ->
        case when size(done) > 0 and r.at <= element_at(done, -1).last + 1
             then concat(slice(done, 1, size(done) - 1),
                         array(named_struct('at', element_at(done, -1).at, 'last', greatest(r.last, element_at(done, -1).last))))
             else concat(done, array(r)) end)""")
    per_doc = stored(per_doc.select("doc_id", "key", "ids", spans.alias("spans")))
    rows = docs.select("doc_id", row_key("doc_id", "text").alias("key"), F.size(words(F.col("text"))).cast("bigint").alias("n_words"))
    n_hit = F.expr("aggregate(spans, 0L, (n, s) -> n + s.last - s.at + 1)")
    return (rows.alias("d").join(per_doc.alias("h"), F.col("d.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("d.key") == F.col("h.key")), "left")
            .select("d.doc_id", "n_words", F.coalesce(n_hit, F.lit(0)).cast("bigint").alias("n_hit"),
                    F.coalesce(F.size("ids"), F.lit(0)).cast("bigint").alias("n_items"),
                    F.sha2(F.coalesce(F.array_join("ids", ","), F.lit("")).cast("binary"), 256).alias("items_sha256"),
                    F.col("spans").isNotNull().alias("contaminated"), "spans"))


def decontaminate(docs: DataFrame, items: DataFrame, width: int = WINDOW, remove: str = "documents") -> DataFrame:
    """``docs`` without contaminated documents, or (remove="spans") without the covered words.

    All columns are kept. Removing a span removes the characters from its first to its last
    word; what stands between and around other words stays. Null texts stay null.
    """
    found = hits(docs, items, width)
    marked = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), row_key("doc_id", "text").alias("its_key"))
    if remove == "documents":
        dirty = stored(found.select("doc_id", "key").distinct())
        return marked.join(dirty, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("its_key") == F.col("key")), "left_anti").select("row.*")
    if remove != "spans":
        raise ValueError("remove must be 'documents' or 'spans'")
    covered = F.array_distinct(F.flatten(F.collect_set(F.sequence(F.col("at"), F.col("at") + F.col("size") - 1))))
    dirty = stored(found.groupBy("doc_id", "key").agg(covered.alias("covered")))
    joined = marked.join(dirty, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("its_key") == F.col("key")), "left")
    # Alternate gaps and words of the original text; a covered word goes, with the gap after it if the next one is covered too.
    lower = F.translate("row.text", _UPPER, _LOWER)
    joined = joined.withColumns({"gaps": F.regexp_extract_all(lower, F.lit(rf"^(?:{_NO_WORD})?|{_NO_WORD}"), 0),
                                 "sizes": F.transform(words(F.col("row.text")), lambda w: F.char_length(w))})
    pieces = F.expr("""array_join(aggregate(sequence(1, size(sizes)),
        named_struct('at', char_length(gaps[0]), 'out', array(substring(row.text, 1, char_length(gaps[0])))),
        (s, i) -> named_struct(
            'at', s.at + sizes[i - 1] + coalesce(char_length(get(gaps, i)), 0),
            'out', concat(s.out, array(
                if(array_contains(covered, i - 1), '', substring(row.text, s.at + 1, sizes[i - 1])),
                if(array_contains(covered, i - 1) and array_contains(covered, i), '',
                   coalesce(substring(row.text, s.at + sizes[i - 1] + 1, char_length(get(gaps, i))), ''))))),
        s -> s.out), '')""")
    text = F.when(F.col("covered").isNull(), F.col("row.text")).otherwise(pieces)
    return joined.select(F.col("row").withField("text", text).alias("row")).select("row.*")
