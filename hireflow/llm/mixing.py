"""Mixing sources to target weights by Sainte-Lague apportionment.

Sources get token targets from weights. Each source is cut into shards, each
shard's documents are laid end to end in a seeded order and cut into blocks of
equal token counts. The blocks a source must give are apportioned to its shards
by highest quotients (weight / (2k + 1)), so every shard has an integer quota;
inside a shard a seeded permutation of the blocks says which ones are taken. A
target above a source's size takes every block once first and apportions the
rest, so no token is taken more than ``max_epochs`` times.

Shards hold about 16 * sqrt(all tokens) tokens: the number of shards and the
number of documents in one both grow with the square root of the corpus, so
neither a shard nor the shard table of one hot source gets large.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, width

#: Primes above any block count of a shard; a multiple of one of them modulo the
#: block count visits every block once.
_STRIDES = (2147483647, 2147483629, 2147483587, 2147483579)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=(3, 1, 2), share: float = 1.5,
                   max_epochs: float = 2.0) -> DataFrame:
    """source, source_size, target for a table (source, source_size) of distinct sources.

    Weights repeat over the sources in code-point order, null last. Targets share
    ``share`` of all tokens by weight; what exceeds ``max_epochs`` times a source
    is shared again by weight among the others until no target exceeds its cap.

    Filling by weight with caps has a closed form: with the sources ordered by
    cap / weight, the first ones are capped, and the others get a common rate.
    The windows below run over one row per source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    every = Window.partitionBy()
    cap = F.lit(float(max_epochs)) * F.col("source_size")
    w = sizes.withColumn("weight", F.element_at(
        F.array(*[F.lit(float(x)) for x in weights]),
        ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    w = w.withColumn("cap", cap).withColumn("fill", F.col("cap") / F.col("weight"))
    upto = Window.orderBy("fill", F.col("source").isNull(), F.col("source").cast("binary"))
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumn("place", F.row_number().over(upto))
    w = w.withColumn("capped_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0))) \
         .withColumn("weight_left", F.sum("weight").over(every)
                     - F.coalesce(F.sum("weight").over(before), F.lit(0.0))) \
         .withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(every))
    # The rate if everything before this source is capped; the first source whose own
    # cap is not reached at it sets the rate for itself and all after it.
    w = w.withColumn("rate", (F.col("budget") - F.col("capped_before")) / F.col("weight_left"))
    w = w.withColumn("open_rate", F.min(F.when(F.col("rate") <= F.col("fill"), F.struct("place", "rate")))
                     .over(every)["rate"])
    target = F.when(F.col("open_rate").isNull(), F.col("cap")).otherwise(
        F.least(F.col("cap"), F.col("weight") * F.col("open_rate")))
    return w.select("source", "source_size", target.alias("target"))


def sainte_lague(df: DataFrame, group: list[str], weight: str, seats: str, tie: list[str],
                 most: str | None = None) -> DataFrame:
    """Adds ``quota``: the seats of each group (a column, equal within it) go to the
    highest quotients weight / (2k + 1); equal quotients go in the order of ``tie``.
    ``most`` names a column that no quota exceeds.

    Of the quotients only those near the last winning one are listed. With W all
    weight and n claimants, a quotient above W / 2(H - n) surely wins and one below
    W / 2(H + n) surely loses, which leaves about 3 n of them.
    """
    g = Window.partitionBy(*group)
    d = df.withColumn("_w", F.sum(weight).over(g)).withColumn("_n", F.count("*").over(g))
    sure = F.when(F.col(seats) > F.col("_n"), F.floor(
        F.col(weight) * (F.col(seats) - F.col("_n")) / F.col("_w") + 0.5)).otherwise(F.lit(0))
    last = F.ceil(F.col(weight) * (F.col(seats) + F.col("_n")) / F.col("_w") + 0.5) + 1
    if most:
        sure, last = F.least(sure, F.col(most)), F.least(last, F.col(most))
    d = d.withColumn("_sure", sure.cast("long")).withColumn("_last", F.greatest(last, sure).cast("long"))
    d = d.withColumn("_open", F.col(seats) - F.sum("_sure").over(g))
    some = (F.col("_w") > 0) & (F.col("_last") > F.col("_sure"))
    listed = d.withColumn("_k", F.explode(F.when(some, F.sequence(F.col("_sure"), F.col("_last") - 1))
                                          .otherwise(F.array(F.lit(-1).cast("long")))))
    high = g.orderBy((F.col("_k") < 0), (F.col(weight) / (2 * F.col("_k") + 1)).desc(), *tie, "_k")
    won = (F.col("_k") >= 0) & (F.row_number().over(high) <= F.col("_open"))
    return (listed.withColumn("_won", won.cast("long"))
            .groupBy(*df.columns, "_sure").agg(F.sum("_won").alias("_more"))
            .withColumn("quota", F.col("_sure") + F.col("_more")).drop("_sure", "_more"))


def mix(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, max_epochs: int = 2,
        block: int = 64, seed: int = 20, carry: tuple[str, ...] = (), id_col: str = "doc_id",
        text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken, passes, spans, row.

    size counts the words of the text (null: 0), target is the source's, taken the
    words that the mix takes, repeats counted. spans lists the word ranges taken
    beyond full passes as (first, last + 1); full passes are in ``passes``. row is a
    struct of the input columns named in ``carry``.

    A null source is a source of its own, last in order; a source without words has
    target 0. Identical rows are ordered by id and text hash, so which of them gives
    a block does not matter and reruns agree. An empty table gives an empty result.
    """
    doc = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                      word_count(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("_text"),
                      F.struct(*([F.col(c) for c in carry] or [F.lit(None).alias("none")])).alias("row"))
    doc = cut(doc)
    sources = doc.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = cut(source_targets(sources, weights, share, max_epochs))
    total = targets.agg(F.sum("source_size")).first()[0] or 0
    shard_tokens = max(16 * block, int(16 * math.sqrt(total)))
    plan = targets.select(
        "source", "source_size", "target",
        F.ceil(F.greatest(F.col("source_size"), F.lit(1)) / shard_tokens).cast("long").alias("n_shards"),
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
        .otherwise(0).cast("long").alias("passes"))
    plan = plan.withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    rows = doc.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source"))).select(
        "d.*", "source_size", "target", "passes", "rest",
        F.pmod(F.xxhash64(F.lit(seed), "doc_id", "_text"), F.col("n_shards")).alias("shard"))
    cell = Window.partitionBy("source", "shard")
    laid = cell.orderBy(F.xxhash64(F.lit(seed + 1), "doc_id", "_text"), "doc_id", "_text") \
               .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = cut(rows.repartition(width(docs.sparkSession), "source", "shard")
               .withColumn("stop", F.sum("size").over(laid)))
    cells = (rows.groupBy("source", "shard", "source_size", "rest")
             .agg(F.sum("size").alias("tokens")).filter("tokens > 0")
             .withColumn("blocks", F.greatest(F.lit(1), F.round(F.col("tokens") / block)).cast("long")))
    seats = F.round(F.col("rest") * F.sum("blocks").over(Window.partitionBy("source"))
                    / F.col("source_size")).cast("long")
    quotas = sainte_lague(cells.withColumn("seats", seats), ["source"], "tokens", "seats",
                          ["shard"], most="blocks").select("source", "shard", "tokens", "blocks", "quota")
    full = rows.alias("r").join(quotas.alias("q"), F.col("r.source").eqNullSafe(F.col("q.source"))
                                & (F.col("r.shard") == F.col("q.shard")), "left").select(
        "r.*", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("blocks", F.lit(0)).alias("blocks"),
        F.coalesce("quota", F.lit(0)).alias("quota")).withColumn("start", F.col("stop") - F.col("size"))
    # Block b of a shard holds the tokens [b * tokens / blocks, (b + 1) * tokens / blocks).
    # It is taken if its place in the shard's seeded permutation is below the quota.
    some = (F.col("size") > 0) & (F.col("quota") > 0)
    full = full.withColumn("_turn", F.xxhash64(F.lit(seed + 2), "source", "shard"))
    spans = F.expr(f"""
        filter(transform(
            sequence(start * blocks div tokens, (stop - 1) * blocks div tokens),
            b -> named_struct(
                'first', greatest(start, (b * tokens + blocks - 1) div blocks) - start,
                'stop', least(stop, ((b + 1) * tokens + blocks - 1) div blocks) - start,
                'place', pmod(b * element_at(array({', '.join(f'{p}L' for p in _STRIDES)}),
                                              cast(pmod(_turn, {len(_STRIDES)}) + 1 as int))
                              + pmod(shiftright(_turn, 8), blocks), blocks))),
            x -> x.place < quota and x.stop > x.first)""")
    full = full.withColumn("spans", F.when(some, spans))
    extra = F.coalesce(F.aggregate("spans", F.lit(0).cast("long"),
                                   lambda acc, x: acc + x["stop"] - x["first"]), F.lit(0))
    return full.select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"),
                       (F.col("passes") * F.col("size") + extra).cast("long").alias("taken"),
                       "passes", F.transform("spans", lambda x: F.struct(x["first"], x["stop"])).alias("spans"),
                       "row")
