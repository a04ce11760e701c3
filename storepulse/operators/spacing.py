"""Minimum spacing: rows of a key that are far enough from the last row kept, the first being kept.

Keeping depends on what was kept, so it is a walk. Most keys are walked in order by a fold that holds one time. A key with very many rows is cut into
blocks of time. In every block each row learns the last row that a walk from it would keep there; where a walk goes on from such a row is looked up in the
later blocks; pointer doubling over these links then finds, in as many rounds as the logarithm of the number of blocks, where the one walk
from the first row enters every block, and all blocks are walked at once."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable
from math import ceil, log2

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storepulse.operators.folds import fold_in_order
from storepulse.plans.lineage import cut, replaced

#: Rows of a key that one fold walks; blocks of a key with more, at most.
MOST, BLOCKS = 8192, 1024


def _walk(rows: DataFrame, keys: list[str], step: int) -> DataFrame:
    """_id of the rows (keys, _t, _from, _id) that a walk of each key keeps, which begins at the time _from (null: at the first row)."""

    def keep(state: list, row: tuple) -> Iterable[tuple]:
        t, start, own = row
        if (start is None or t >= start) and (state[0] is None or t - state[0] >= step):
            state[0] = t
            yield (own,)

    return fold_in_order(rows.select(*keys, "_t", "_from", "_id"), keys, ["_t"], lambda: [None], keep, "_id bigint")


def _lasts(placed: DataFrame, step: int) -> DataFrame:
    """kid, b, t, last: the last row of its block that a walk from the row at t keeps. Blocks are walked backwards, holding the rows of one step."""

    def back(later: deque, row: tuple) -> Iterable[tuple]:
        kid, b, t = row
        while len(later) > 1 and later[-2][0] >= t + step:
            later.pop()
        last = later[-1][1] if later and later[-1][0] >= t + step else t
        later.appendleft((t, last))
        yield kid, b, t, last

    rows = placed.select(F.col("kid").alias("_k"), F.col("b").alias("_b"), "kid", "b", F.col("_t").alias("t"))
    return fold_in_order(rows, ["_k", "_b"], [F.desc("t")], deque, back, "kid bigint, b bigint, t bigint, last bigint")


def _links(lasts: DataFrame, hot: DataFrame, step: int) -> DataFrame:
    """kid, x, y, b, then: from a last row x of a block the walk goes on at y in block b, whose last row is then. None where the key ends."""

    def onward(seen: list, row: tuple) -> Iterable[tuple]:
        kid, block, at, last, x = row
        if x is None:
            seen[0] = (at, block, last)
        else:
            yield (kid, x, *(seen[0] or (None, block, None)))

    of = lambda t: F.size(F.filter("bounds", lambda v: v <= t)).cast("long")
    asked = lasts.select("kid", F.col("last").alias("x")).distinct().join(hot.select("kid", "bounds"), "kid").withColumn("at", F.col("x") + step)
    none = F.lit(None).cast("long")
    both = lasts.select("kid", "b", F.col("t").alias("at"), "last", none.alias("x")).union(asked.select("kid", of(F.col("at")).alias("b"), "at", none, "x"))
    rows = both.select(F.col("kid").alias("_k"), F.col("b").alias("_b"), "kid", "b", "at", "last", "x")
    found = cut(fold_in_order(rows, ["_k", "_b"], [F.desc("at"), F.desc_nulls_last(F.col("x").isNull())], lambda: [None], onward, "kid bigint, x bigint, y bigint, b bigint, then bigint"), "links")
    first = lasts.groupBy("kid", "b").agg(F.min("t").alias("y"), F.min_by("last", "t").alias("then"))
    beyond = found.filter("y IS NULL").select("kid", "x", (F.col("b") + 1).alias("b")).join(first, ["kid", "b"]).select("kid", "x", "y", "b", "then")
    return found.filter("y IS NOT NULL").unionByName(beyond)


def _entries(lasts: DataFrame, links: DataFrame, blocks: int) -> DataFrame:
    """kid, b, y: where the walk from a key's first row enters each block that it enters."""
    links = cut(links, "links")
    start = cut(lasts.groupBy("kid").agg(F.min_by(F.struct("b", F.col("t").alias("y"), "last"), "t").alias("s")).select("kid", "s.*"), "start")
    reached, jump = cut(start.select("kid", F.col("last").alias("x")), "reached"), cut(links.select("kid", "x", "then"), "jump")
    for _ in range(ceil(log2(max(blocks, 2)))):
        more = reached.join(jump, ["kid", "x"]).select("kid", F.col("then").alias("x"))
        reached = replaced(reached.union(more).distinct(), reached, "reached")
        jump = replaced(jump.join(jump.select("kid", F.col("x").alias("then"), F.col("then").alias("next")), ["kid", "then"]).select("kid", "x", F.col("next").alias("then")), jump, "jump")
    return start.select("kid", "b", "y").union(reached.join(links, ["kid", "x"]).select("kid", "b", "y"))


def spaced(rows: DataFrame, keys: list[str], ts: str, seconds: float, most: int = MOST) -> DataFrame:
    """Rows at least `seconds` after the last row kept of their key, the first kept: a rule's cooldown, or sampling.

    Of rows of a key at one time the least by its other columns stands for all (seconds must be over 0). Rows without time go; null keys are keys."""
    step = round(seconds * 1e6)
    if step <= 0:
        raise ValueError("seconds must be over 0")
    named = cut(rows.withColumn("_id", F.monotonically_increasing_id()).withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp"))), "rows")
    rest = [c for c in rows.columns if c not in keys]
    one = cut(named.filter("_t IS NOT NULL").groupBy(F.struct(*keys).alias("_key"), "_t").agg(F.min_by("_id", F.struct(*rest, "_id")).alias("_id")), "times")
    cuts = F.percentile_approx("_t", F.array(*(F.lit(i / BLOCKS) for i in range(1, BLOCKS))), F.lit(10 * BLOCKS))
    many = one.groupBy("_key").agg(F.count("*").alias("n")).filter(F.col("n") > most)
    # a key's bounds: as many as leave `most` rows to a block; each is the time of a row
    stride = F.greatest(F.lit(1), F.floor(F.lit(BLOCKS) * most / F.col("n"))).cast("int")
    bounds = F.array_distinct(F.filter("all", lambda _, i: (i + 1) % F.col("stride") == 0))
    sized = one.join(many, "_key").groupBy("_key").agg(cuts.alias("all"), F.first(stride).alias("stride"), F.min("_t").alias("first"))
    hot = cut(sized.select("_key", F.filter(bounds, lambda v: v > F.col("first")).alias("bounds"), F.monotonically_increasing_id().alias("kid")), "hot")
    blocks = hot.agg(F.max(F.size("bounds"))).first()[0]
    none = F.lit(None).cast("long").alias("_from")
    if blocks is None:
        kept = _walk(one.select(F.col("_key.*"), "_t", none, "_id"), keys, step)
    else:
        few = one.join(hot.select("_key"), "_key", "left_anti").select(F.col("_key.*"), "_t", none, "_id")
        placed = cut(one.join(hot, "_key").select("kid", F.size(F.filter("bounds", lambda v: v <= F.col("_t"))).cast("long").alias("b"), "_t", "_id"), "placed")
        lasts = cut(_lasts(placed, step), "lasts")
        entries = _entries(lasts, _links(lasts, hot, step), blocks + 1)
        kept = _walk(few, keys, step).union(_walk(placed.join(entries.withColumnRenamed("y", "_from"), ["kid", "b"]), ["kid", "b"], step))
    return named.join(kept, "_id", "left_semi").select(*rows.columns)
