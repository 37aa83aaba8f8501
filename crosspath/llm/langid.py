"""Language identification by Bayesian evidence fusion.

The evidence of a row is its text (byte trigrams, naive Bayes), the language its markup
declares, the suffix of its address, a language-like first part of the path, and what its
host holds otherwise. Text gives a first posterior. Grouped sums of posteriors then say how
each declared value and suffix goes with each language, and what each host holds, smoothed
by its domain, which is smoothed by the whole corpus. All log likelihoods and the host's
log prior are added up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored, with_python
from .pages import host

BUCKETS = 1 << 15       # of hashed trigrams
LANGUAGES = 256         # labels at most, so a model is 64 MB at most
EVIDENCE = 100          # a longer text counts like so many trigrams, as trigrams are not independent
HOST_PRIOR = 5.0        # rows that a domain's shares count for in a host's
DOMAIN_PRIOR = 20.0     # rows that the corpus' shares count for in a domain's
CUE_PRIOR = 5.0         # rows that a value's overall share counts for in a language's
CUES = ["declared", "suffix", "section"]
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_CHUNK = 1 << 20


def trigrams(text: bytes | None) -> Iterator[np.ndarray]:
    """Buckets of all byte trigrams of the lower-cased text, in pieces."""
    octets = np.frombuffer((text or b"").translate(_LOWER), np.uint8).astype(np.uint32)
    for start in range(0, max(len(octets) - 2, 0), _CHUNK):
        part = octets[start:start + _CHUNK + 2]
        yield ((part[:-2] * 7919) ^ (part[1:-1] * 263) ^ part[2:]) % BUCKETS


def train(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, log likelihood of each bucket under each) from all rows of (text, lang).

    Rows without a label or text are left out. More than LANGUAGES labels raise ValueError.
    """
    rows = labelled.select("lang", "text").where("lang is not null and text is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                total = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for ids in trigrams(text):
                    found, n = np.unique(ids, return_counts=True)
                    total[found] += n
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(total[at])], names=["lang", "bucket", "n"])

    counts = rows.mapInArrow(count, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = stored(counts)
    languages = [r[0] for r in counts.select("lang").distinct().orderBy("lang").limit(LANGUAGES + 1).collect()]
    if len(languages) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    table = counts.toArrow()                                # at most LANGUAGES x BUCKETS rows
    model = np.zeros((BUCKETS, len(languages)))
    place = {lang: i for i, lang in enumerate(languages)}
    columns = np.array([place[x] for x in table.column("lang").to_pylist()], np.int64)
    if languages:
        model[table.column("bucket").to_numpy(), columns] = table.column("n").to_numpy()
    return languages, np.log((model + 0.5) / (model.sum(0) + 0.5 * BUCKETS)).astype(np.float32)


def with_text_evidence(rows: DataFrame, model: np.ndarray) -> DataFrame:
    """``rows`` with ``text`` replaced by ``scores``: its log likelihood per language, tempered."""
    def compute(texts: list) -> list:
        out = []
        for text in texts:
            total, n = np.zeros(model.shape[1]), 0
            for ids in trigrams(text):
                total += model[ids].sum(0, dtype=np.float64)
                n += len(ids)
            out.append((total * min(1.0, EVIDENCE / max(n, 1))).tolist())
        return [out]

    return with_python(rows, "text", {"scores": T.ArrayType(T.DoubleType())}, compute, binary=True)


def short_tag(value: Column) -> Column:
    """A two- or three-letter tag, or "other"; so there are at most 18,280 values and null."""
    tag = F.lower(F.regexp_extract(value, r"^\s*([A-Za-z]+)", 1))
    return F.when(value.isNotNull(), F.when(F.length(tag).between(2, 3), tag).otherwise(F.lit("other")))


def from_pages(pages: DataFrame) -> DataFrame:
    """(text, declared, suffix, section, host) and ``page_id`` of web pages (page_id, url, html)."""
    html = F.coalesce("html", F.lit(""))
    visible = F.regexp_replace(html, r"(?is)<(script|style|nav|footer|aside|title|form)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    declared = F.nullif(F.regexp_extract(html, r"(?is)<html[^>]*?\slang\s*=\s*[\"']?([A-Za-z-]+)", 1), F.lit(""))
    name = host(F.col("url"))
    suffix = F.when(F.contains(name, F.lit(".")), F.substring_index(name, ".", -1))
    section = F.nullif(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([A-Za-z]{2,3})(?:[/?#-]|$)", 1), F.lit(""))
    return pages.select("page_id", visible.alias("text"), short_tag(declared).alias("declared"), short_tag(suffix).alias("suffix"),
                        short_tag(section).alias("section"), name.alias("host"))


def from_documents(docs: DataFrame) -> DataFrame:
    """(text, declared, suffix, section, host) and ``doc_id`` of documents (doc_id, text, source); the source stands for the host."""
    none = F.lit(None).cast("string")
    return docs.select("doc_id", "text", none.alias("declared"), none.alias("suffix"), none.alias("section"), F.col("source").alias("host"))


def _sums(n: int) -> Column:
    return F.expr(f"array({', '.join(f'sum(posterior[{i}])' for i in range(n))})")


def identify(rows: DataFrame, languages: list[str], model: np.ndarray) -> DataFrame:
    """``rows`` without text, plus (lang, probability, text_lang).

    rows: any columns besides text, declared, suffix, section, host. text_lang: by text
    alone. Evidence that is null says nothing; a null host has the corpus' prior. A row's own
    posterior is taken out of its host's sums. Null and empty texts say nothing either.
    Repeated rows count as often as they occur. Without languages lang is null. An empty
    table gives an empty result.
    """
    if not languages:
        nothing = F.lit(None).cast("string")
        return rows.drop("text", *CUES, "host").select("*", nothing.alias("lang"), F.lit(None).cast("double").alias("probability"), nothing.alias("text_lang"))
    n = len(languages)
    named = F.array(*map(F.lit, languages))
    softmax = "transform({0}, x -> exp(x - array_max({0})) / aggregate({0}, 0D, (s, y) -> s + exp(y - array_max({0}))))"
    seen = with_text_evidence(rows, model).withColumn("posterior", F.expr(softmax.format("scores")))
    seen = stored(seen.withColumn("domain", F.substring_index("host", ".", -2)))
    whole = seen.agg(F.count("*"), _sums(n)).first()
    if not whole[0]:
        return seen.drop("scores", "posterior", "domain", *CUES, "host").select("*", named[0].alias("lang"), F.lit(0.0).alias("probability"), named[0].alias("text_lang"))
    shares = [x / whole[0] for x in whole[1]]
    total = F.expr("array(" + ", ".join(f"{x!r}D" for x in shares) + ")")
    domains = seen.where("domain is not null").groupBy("domain").agg(F.count("*").alias("n"), _sums(n).alias("held"))
    domains = stored(domains.withColumn("total", total).selectExpr(
        "domain as its_domain", f"transform(held, (x, i) -> (x + {DOMAIN_PRIOR}D * total[i]) / (n + {DOMAIN_PRIOR}D)) as domain_shares"))
    hosts = seen.where("host is not null").groupBy("host", "domain").agg(F.count("*").alias("n"), _sums(n).alias("held"))
    hosts = stored(hosts.join(domains, hosts["domain"] == domains["its_domain"])
                   .select(F.col("host").alias("its_host"), F.col("n").alias("host_n"), F.col("held").alias("host_held"), "domain_shares"))
    joined = seen.join(hosts, seen["host"] == hosts["its_host"], "left").withColumn("total", total)
    for cue in CUES:
        sums = stored(seen.where(F.col(cue).isNotNull()).groupBy(cue).agg(F.count("*").alias("n"), _sums(n).alias("held")))
        in_all = sums.agg(F.sum("n"), *[F.sum(F.col("held")[i]) for i in range(n)]).first()
        per_language = ", ".join(f"{x or 0.0!r}D" for x in in_all[1:])
        chance = (f"transform(held, (x, i) -> ln((x + {CUE_PRIOR}D * n / {in_all[0] or 1}D) / (array({per_language})[i] + {CUE_PRIOR}D)))")
        likely = sums.selectExpr(f"{cue} as its_{cue}", f"{chance} as by_{cue}")
        joined = joined.join(F.broadcast(likely), F.col(cue) == F.col(f"its_{cue}"), "left")        # at most 18,280 rows
    prior = f"""if(host_n is null, transform(total, x -> ln(greatest(x, 1e-9D))), transform(host_held, (x, i) ->
        ln(greatest((greatest(x - posterior[i], 0D) + {HOST_PRIOR}D * domain_shares[i]) / (host_n - 1 + {HOST_PRIOR}D), 1e-9D))))"""
    added = " + ".join(["s", "prior[i]", *(f"coalesce(by_{c}[i], 0D)" for c in CUES)])
    fused = joined.withColumn("prior", F.expr(prior)).withColumn("fused", F.expr(f"transform(scores, (s, i) -> {added})"))
    best = fused.withColumns({"shares": F.expr(softmax.format("fused")), "named": named})
    return best.drop("scores", "domain", "fused", "prior", "total", *CUES, "host", *[f"its_{c}" for c in CUES], *[f"by_{c}" for c in CUES],
                     "its_host", "host_n", "host_held", "domain_shares").withColumns({
        "lang": F.expr("named[cast(array_position(shares, array_max(shares)) as int) - 1]"), "probability": F.round(F.array_max("shares"), 6),
        "text_lang": F.expr("named[cast(array_position(posterior, array_max(posterior)) as int) - 1]")}).drop("named", "shares", "posterior")
