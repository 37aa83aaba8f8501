"""Mix sources to target weights by iterative proportional fitting.

Documents are summed into cells (source, lang, topic) of tokens. The cells' weights are
raked to the three target marginals in turn until they fit. Weights per token are scaled to a
budget of kept tokens, and a document is kept with that probability, or whole where it passes
one. Built-in functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.random import uniform
from .common import WORD, stored

MARGINS = ["source", "lang", "topic"]
TEMPER = 0.9            # default targets: shares of tokens to this power
KEEP = 0.75             # share of all tokens that is kept
ROUNDS = 200            # of the SQL, which cannot tell when it is done
TOLERANCE = 1e-13       # of the factors in one round
STALL = 0.99            # raking ends where three rounds in turn leave more than this of the change before: targets that contradict
SEED = 2026


def topic(text: Column) -> Column:
    """What a text is about, by fixed cues in the whole of it: legal, table, contact or prose."""
    return (F.when(F.contains(text, F.lit("Licensed under")) | F.contains(text, F.lit("Copyright")), "legal")
            .when(F.contains(text, F.lit(" | ")), "table").when(F.contains(text, F.lit("@")), "contact").otherwise("prose"))


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def default_targets(cells: DataFrame, temper: float = TEMPER) -> dict[str, DataFrame]:
    """Per margin: (value, target), tokens by the tempered share of each value; they add up to all tokens."""
    targets = {}
    for m in MARGINS:
        sums = stored(cells.groupBy(F.col(m).alias("value")).agg(F.pow(F.sum("tokens"), F.lit(temper)).alias("t"), F.sum("tokens").alias("n")))
        total, n = sums.agg(F.sum("t"), F.sum("n")).first()
        targets[m] = sums.select("value", (F.col("t") / F.lit(total) * F.lit(n)).alias("target"))
    return targets


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """(*MARGINS, tokens, weight): the cells' tokens scaled until every margin adds up to its target.

    A weight is tokens x a factor of the source x factors of lang and topic. The source's
    factor follows from the other two, so a round only passes on a table of (lang, topic).
    Rounds go on until no factor changes by more than ``tolerance``, or changes no longer shrink, or after
    ``rounds``. Values without a target get weight 0. Targets that no weights can meet leave the margin raked
    last (topic) right and the others as near as raking brings them; ``margins_left`` tells how near.
    """
    cells = cells.select(*MARGINS, "tokens")
    for m in MARGINS:
        side = targets[m].select(F.col("value").alias(f"its_{m}"), F.col("target").alias(f"to_{m}"))
        cells = cells.join(side, F.col(m).eqNullSafe(F.col(f"its_{m}")), "left").drop(f"its_{m}")
    cells = stored(cells.fillna(0.0, [f"to_{m}" for m in MARGINS]))
    sized = "coalesce({0} / nullif({1}, 0D), 0D)"
    factors = stored(cells.select(F.col("lang").alias("l"), F.col("topic").alias("t"), "to_lang", "to_topic").distinct()
                     .selectExpr("*", "1D as factor", "1D as before", "1D as change"))

    def scaled(by: str) -> DataFrame:
        joined = cells.join(factors.select("l", "t", "before", "factor"), F.col("lang").eqNullSafe(F.col("l")) & F.col("topic").eqNullSafe(F.col("t")))
        of_source = F.sum(F.col("tokens") * F.col(by)).over(W.partitionBy("source"))       # the cells of one source
        return joined.withColumn("of_source", of_source).withColumn("weight", F.expr(f"tokens * factor * {sized.format('to_source', 'of_source')}"))

    before, stalled, done = float("inf"), 0, 0
    while rounds is None or done < rounds:
        done += 1
        held = scaled("factor").groupBy("lang", "topic", "to_lang", "to_topic", "factor").agg(F.sum("weight").alias("w"))
        held = held.withColumn("by_lang", F.expr(sized.format("to_lang", "sum(w) over (partition by lang)")))
        held = held.withColumn("by_topic", F.expr(sized.format("to_topic", "sum(w * by_lang) over (partition by topic)")))
        factors = stored(held.selectExpr("lang as l", "topic as t", "to_lang", "to_topic", "factor * by_lang * by_topic as factor",
                                         "factor as before", "greatest(abs(by_lang - 1), abs(by_topic - 1)) as change"))
        change = factors.agg(F.max("change")).first()[0] or 0.0
        stalled = stalled + 1 if change > STALL * before else 0
        if change <= tolerance or stalled == 3:
            break
        before = change
    return scaled("before").select(*MARGINS, "tokens", "weight")


def margins_left(raked: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """(margin, value, target, weight, left): every target beside the weight it got; left is what is missing of the target
    (or too much), as a share of it. Values that occur without a target have target 0 and left null."""
    parts = []
    for m in MARGINS:
        got = raked.groupBy(F.col(m).alias("got_value")).agg(F.sum("weight").alias("weight"))
        both = targets[m].join(got, F.col("value").eqNullSafe(F.col("got_value")), "full")
        target, weight = F.coalesce("target", F.lit(0.0)), F.coalesce("weight", F.lit(0.0))
        parts.append(both.select(F.lit(m).alias("margin"), F.when(F.col("target").isNull(), F.col("got_value")).otherwise(F.col("value")).alias("value"),
                                 target.alias("target"), weight.alias("weight"), (F.abs(weight - target) / F.nullif(target, F.lit(0.0))).alias("left")))
    return reduce(DataFrame.union, parts)


def scale(raked: DataFrame, keep: float = KEEP) -> float:
    """What weights per token are multiplied by, so that probabilities of at most 1 keep ``keep`` of all tokens.

    Cells that would pass 1 are kept whole and the rest of the budget goes to the others, until
    no further cell passes; the factor only grows, so a cell kept whole stays so. If the cells that have a weight are fewer tokens than
    the budget, all of them are kept. One small aggregate of the cells per turn.
    """
    per_token = F.col("weight") / F.col("tokens")
    factor, held = 0.0, -1
    while True:
        whole = F.coalesce(per_token * F.lit(factor) >= 1, F.lit(False))
        total, kept, n, left, least = raked.agg(F.sum("tokens"), F.sum(F.when(whole, F.col("tokens"))), F.count(F.when(whole, 1)),
                                                F.sum(F.when(~whole, F.col("weight"))), F.min(F.when(F.col("weight") > 0, per_token))).first()
        if n == held or least is None:
            return factor
        if not left:
            return 1 / least
        factor, held = max(factor, (keep * total - (kept or 0)) / left), n


def _described(docs: DataFrame, about: Column) -> DataFrame:
    return docs.select(F.struct("*").alias("row"), F.col("source").alias("source"), F.col("lang").alias("lang"), about.alias("topic"),
                       tokens(F.col("text")).alias("n_tokens"), F.concat_ws("-", "doc_id", F.md5(F.col("text").cast("binary"))).alias("draw"))


def mixed(docs: DataFrame, targets: dict[str, DataFrame] | None = None, temper: float = TEMPER, seed: int = SEED, at_most: float | None = None,
          keep: float = KEEP, about: Column | None = None) -> DataFrame:
    """(row, source, lang, topic, n_tokens, weight, epochs, probability, kept) per row of ``docs`` (doc_id, text, lang, source, ...).

    weight: the document's part of the raked weights, in tokens; they add up to all tokens. epochs: weight
    per token times ``scale``. probability: epochs, at most 1. The expected tokens of what is kept are ``keep`` of all tokens,
    however rare the rarest cell. Where no epochs pass 1 they meet the targets; cells that are too rare for their target are kept whole,
    and reading their documents ``epochs`` times meets it. kept: a number drawn from (seed, doc_id, text) is below the probability.

    ``at_most``: raise if a margin is left further from its target than this share of it.
    ``about``: the topic, an expression over ``docs``; by default that of ``topic``.

    Documents without tokens (null and empty texts too) have weight 0, epochs 1 and probability 1.
    Null source or lang is a value of its own. Repeated rows share one draw. An empty table
    gives an empty result.
    """
    if not 0 < keep <= 1:
        raise ValueError("keep is a share of the tokens: above 0, at most 1")
    described = _described(docs, topic(F.col("text")) if about is None else about)
    cells = stored(described.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0"))
    targets = targets or default_targets(cells, temper)
    raked = stored(rake(cells, targets))
    if at_most is not None:
        worst = margins_left(raked, targets).orderBy(F.desc("left")).first()
        if worst is not None and (worst["left"] or 0.0) > at_most:
            raise ValueError(f"targets contradict one another: {worst['margin']} {worst['value']!r} gets {worst['weight']:.6g} tokens of {worst['target']:.6g}")
    factor = scale(raked, keep)
    per_token = raked.select(*MARGINS, (F.col("weight") / F.col("tokens")).alias("per_token"))
    side = per_token.withColumnsRenamed({m: f"its_{m}" for m in MARGINS})
    condition = reduce(lambda x, y: x & y, [F.col(m).eqNullSafe(F.col(f"its_{m}")) for m in MARGINS])
    out = described.join(side, condition, "left")
    epochs = F.when(F.col("n_tokens") == 0, F.lit(1.0)).otherwise(F.col("per_token") * F.lit(factor))
    chance = F.least(epochs, F.lit(1.0))
    return out.select("row", *MARGINS, "n_tokens", F.coalesce(F.col("n_tokens") * F.col("per_token"), F.lit(0.0)).alias("weight"),
                      epochs.alias("epochs"), chance.alias("probability"), (uniform(seed, F.col("draw"), "mix") < chance).alias("kept"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that ``mixed`` keeps, with all their columns."""
    return mixed(docs, **options).where("kept").select("row.*")


def sql(documents: str = "documents") -> str:
    """The same as DuckDB SQL, with ROUNDS rounds by recursion. The scale is the largest level that any number of whole cells,
    those of the largest weight per token first, leaves to the others."""
    steps = [f"""described as materialized (select doc_id, source, lang,
        case when contains(text, 'Licensed under') or contains(text, 'Copyright') then 'legal' when contains(text, ' | ') then 'table'
             when contains(text, '@') then 'contact' else 'prose' end topic,
        coalesce(len(regexp_extract_all(text, '{WORD}')), 0) n_tokens, concat_ws('-', doc_id, md5(text)) draw from {documents})""",
             "cells as materialized (select source, lang, topic, sum(n_tokens)::double tokens from described group by all having sum(n_tokens) > 0)"]
    for m in MARGINS:
        steps.append(f"target_{m} as materialized (select {m}, pow(sum(tokens), {TEMPER}) / sum(pow(sum(tokens), {TEMPER})) over () * sum(sum(tokens)) over () target from cells group by {m})")
    last = "r"
    for m in MARGINS:
        last = f"""(select c.source, c.lang, c.topic, c.tokens, c.i, c.weight * t.target / sum(c.weight) over (partition by c.{m}) weight
            from {last} c join target_{m} t on c.{m} is not distinct from t.{m})"""
    steps.append(f"""r as (select *, tokens weight, 0 i from cells union all select source, lang, topic, tokens, weight, i + 1 i from {last} where i < {ROUNDS})""")
    return f"""with recursive {", ".join(steps)}, raked as (select *, weight / tokens per_token from r where i = {ROUNDS}),
        levels as (select ({KEEP} * sum(tokens) over () - coalesce(sum(tokens) over richer, 0))
            / (sum(weight) over () - coalesce(sum(weight) over richer, 0)) level from raked
            window richer as (order by per_token desc, source, lang, topic rows between unbounded preceding and 1 preceding)),
        chances as (select d.*, coalesce(n_tokens * per_token, 0) weight,
            case when n_tokens = 0 then 1 else per_token * (select max(level) from levels) end epochs
            from described d left join raked r on d.source is not distinct from r.source and d.lang is not distinct from r.lang and d.topic = r.topic)
        select doc_id, source, lang, topic, n_tokens::bigint n_tokens, round(weight, 3) weight, round(epochs, 6) epochs, round(least(epochs, 1), 7) probability,
            (('0x' || substr(md5(concat_ws(':', '{SEED}', draw, 'mix')), 1, 8))::bigint + 0.5) / 4294967296.0 < least(epochs, 1) kept from chances"""
