"""Order-preserving operators: prefix sums, shards, blocks, shifts, masks, padding and batches."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.numeric import IGNORED

#: Rows of one range of the ordinal, within which a running sum is one task's work.
RANGE = 100_000


#: Ranges at most; from ``RANGE`` times as many rows on, ranges hold more rows, sorted with spilling.
RANGES = 4096


def ranges_of(df: DataFrame, ordinal: str, width: int = RANGE) -> Column:
    """The number of a row's range: ranges of consecutive ordinals with about ``width`` rows each, however the values lie.

    Bounds are approximate quantiles, found in one pass; a row finds its own by bisection. Any bounds give right results.
    """
    n = df.count()
    parts = min(-(-n // width), RANGES)
    if parts < 2:
        return F.pmod(F.col(ordinal), F.lit(1)).cast("int")  # 0, yet no constant: with one Spark would gather what joins it, too
    shares = [k / parts for k in range(1, parts)]
    bounds = sorted(set(df.agg(F.percentile_approx(ordinal, shares, 10 * parts)).first()[0] or []))
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    listed = F.array(*map(F.lit, bounds))
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda found, step: F.when(F.get(listed, found + step - 1) <= F.col(ordinal), found + step).otherwise(found))


def running_sum(df: DataFrame, value: str, ordinal: str, out: str = "before", width: int = RANGE) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows with a smaller ``ordinal`` (a unique long).

    Two levels: totals of ranges of about ``width`` rows are summed first, a table smaller by that factor; then each
    range is summed on its own, so no task sees all rows. The ranges follow the quantiles of the ordinals. Only
    ordinals and values are summed; further columns meet the sums in one join.
    """
    slim = df.select(ordinal, value)
    ranged = slim.withColumn("_range", ranges_of(slim, ordinal, width))
    totals = ranged.groupBy("_range").agg(F.sum(value).alias("_total"))
    offsets = totals.withColumn("_offset", F.coalesce(F.sum("_total").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_total")
    local = F.coalesce(F.sum(value).over(Window.partitionBy("_range").orderBy(ordinal).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    summed = ranged.withColumn("_local", local).join(offsets, "_range").withColumn(out, (F.col("_offset") + F.col("_local")).cast("long"))
    if set(df.columns) <= {ordinal, value}:
        return summed.select(*df.columns, out)
    return df.join(summed.select(ordinal, out), ordinal)


def roll(sizes: Iterable[int], least: int, first: int = 0, held: int = 0) -> list[int]:
    """The shard of each batch: a shard ends after the batch that brings it to ``least`` tokens or more."""
    out, shard = [], first
    for size in sizes:
        out.append(shard)
        held += size
        if held >= least:
            shard, held = shard + 1, 0
    return out


def shard_steps(sizes: np.ndarray, least: int) -> list[tuple[int | None, int, int]]:
    """What a range of batches does to the tokens held before it, as rows (need, shards, held).

    The first row whose ``need`` is not above what is held tells how many shards end in the range and what is held
    after it; the row without a need adds what is held. Rows are as many as batches in one shard, at most.
    """
    upto = np.cumsum(sizes)
    n, before = len(sizes), np.concatenate([[0], upto])
    close = np.searchsorted(upto, before + least)  # where a shard that starts at a batch ends
    shards, held = np.zeros(n + 1, dtype=np.int64), before[-1] - before
    for k in range(n - 1, -1, -1):
        if close[k] < n:
            shards[k], held[k] = 1 + shards[close[k] + 1], held[close[k] + 1]
    rows: list[tuple[int | None, int, int]] = []
    for k in range(n):
        need = max(0, least - int(upto[k]))
        if not rows or need < rows[-1][0]:
            rows.append((need, 1 + int(shards[k + 1]), int(held[k + 1])))
        if need == 0:
            return rows
    return [*rows, (None, 0, int(before[-1]))]


def shard_batches(df: DataFrame, size: str, ordinal: str, batch_rows: int, least: int, first: int = 0, width: int = RANGE) -> DataFrame:
    """(batch, n_tokens, shard): consecutive rows in batches of ``batch_rows``, batches rolled into shards.

    The fold is sequential, but what ``width`` batches do to the tokens held before them is a small table, which each
    range makes on its own. The driver composes these tables in order, a lookup a range; then every range rolls its
    batches from its own start.
    """
    spark = df.sparkSession
    batches = df.groupBy(F.floor(F.col(ordinal) / batch_rows).alias("batch")).agg(F.sum(size).cast("long").alias("n_tokens")).withColumn("_range", F.floor(F.col("batch") / width))

    def steps(frame: pd.DataFrame) -> pd.DataFrame:
        rows = shard_steps(frame.sort_values("batch")["n_tokens"].to_numpy(dtype=np.int64), least)
        return pd.DataFrame({"_range": frame["_range"].iloc[0], "need": pd.array([r[0] for r in rows], "Int64"), "shards": [r[1] for r in rows], "held": [r[2] for r in rows]})

    tables = batches.groupBy("_range").applyInPandas(steps, "_range long, need long, shards long, held long")
    starts, now, shard, held = [], None, first, 0
    for number, need, shards, after in tables.orderBy("_range", F.desc_nulls_last("need")).toLocalIterator():
        if number != now:
            now, done, entered = number, False, held
            starts.append((number, shard, held))
        if not done and (need is None or entered >= need):
            shard, held, done = shard + shards, after + (entered if need is None else 0), True

    def rolled(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("batch")
        return frame[["batch", "n_tokens"]].assign(shard=roll(frame["n_tokens"].tolist(), least, int(frame["_shard"].iloc[0]), int(frame["_held"].iloc[0])))

    begin = spark.createDataFrame(starts, "_range long, _shard long, _held long")  # a row a range
    return batches.join(F.broadcast(begin), "_range").groupBy("_range").applyInPandas(rolled, "batch long, n_tokens long, shard int")


def blocks(df: DataFrame, ids: str, ordinal: str, length: int, size: Column | None = None) -> DataFrame:
    """(block, x, y): the token stream of all rows in order, cut every ``length`` tokens; y is x moved by one.

    The last block is left out where it is short of ``length`` + 1 tokens. Places come from the sizes alone, which
    ``size`` tells where it is cheaper than making the tokens. A row is cut into its blocks before anything else is
    shuffled, so a block gathers pieces, not tokens.
    """
    sizes = df.select(ordinal, (F.size(ids) if size is None else size).cast("long").alias("_n")).where("_n > 0")
    placed = running_sum(sizes, "_n", ordinal).join(df.select(ordinal, F.col(ids).alias("_ids")), ordinal)
    first, last = F.floor(F.greatest(F.col("before") - 1, F.lit(0)) / length), F.floor((F.col("before") + F.col("_n") - 1) / length)

    def piece(block: Column) -> Column:
        start = F.greatest(block * length - F.col("before"), F.lit(0))
        stop = F.least(block * length + length + 1 - F.col("before"), F.col("_n"))
        return F.struct(block.alias("block"), F.slice("_ids", (start + 1).cast("int"), F.greatest(stop - start, F.lit(0)).cast("int")).alias("ids"))

    pieces = placed.select("before", F.explode(F.transform(F.sequence(first, last), piece)).alias("p")).select("p.block", "before", "p.ids")
    whole = pieces.groupBy("block").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("before", "ids"))), lambda s: s["ids"])).alias("ids"))
    return whole.where(F.size("ids") == length + 1).select("block", F.slice("ids", 1, length).alias("x"), F.slice("ids", 2, length).alias("y"))


def next_tokens(ids: Column) -> Column:
    return F.slice(ids, 2, F.greatest(F.size(ids) - 1, F.lit(0)))


def last_tokens(ids: Column, n: int) -> Column:
    return F.slice(ids, F.greatest(F.size(ids) - n + 1, F.lit(1)), n)


def label_mask(prompt: Column, full: Column, prefix: int = 0) -> Column:
    """Labels: the full tokens with the prompt, and ``prefix`` places before it, left out."""
    return F.concat(F.array_repeat(F.lit(IGNORED), F.size(prompt) + prefix), F.slice(full, F.size(prompt) + 1, F.greatest(F.size(full) - F.size(prompt), F.lit(0))))


def pad(ids: Column, size: Column, value: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(value), F.greatest(size - F.size(ids), F.lit(0))))


def batch_of(place: Column, rows: int) -> Column:
    """The batch of the row at a 0-based place."""
    return F.floor(place / rows).cast("long")


def place_in_order(df: DataFrame, order: list[Column], salt: Column, out: str = "place") -> DataFrame:
    """0-based place of each row in a global order, by ranges of its first key, each ranked on its own.

    ``salt`` maps rows to small numbers monotonically in the order, such as the leading digits of a hash that is
    also the first sort key.
    """
    ranged = df.withColumn("_range", salt)
    totals = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_total"))
    offsets = totals.withColumn("_offset", F.coalesce(F.sum("_total").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_total")
    return ranged.withColumn("_local", F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1).join(offsets, "_range").withColumn(out, (F.col("_offset") + F.col("_local")).cast("long")).drop("_range", "_local", "_offset")


def hash_range(digits: Column, n: int, width: int = RANGE) -> Column:
    """A range of the leading digits of a hexadecimal hash, as many as leave about ``width`` of ``n`` rows to each."""
    return F.conv(F.substring(digits, 1, max(1, math.ceil(math.log(max(1, n / width), 16)))), 16, 10).cast("long")


def hashed_number(key: Column, seed: int, below: Column) -> Column:
    """A number in 0..below-1 that depends on key and seed alone, the same in any engine with md5."""
    digits = F.substring(F.md5(F.concat(key.cast("string"), F.lit(f":{seed}"))), 1, 12)
    return F.pmod(F.conv(digits, 16, 10).cast("long"), below.cast("long"))


def hashed_choice(key: Column, seed: int, options: Sequence[str]) -> Column:
    return F.get(F.array(*map(F.lit, options)), hashed_number(key, seed, F.lit(len(options))).cast("int"))


def drawn(rows: DataFrame, ordinal: str, draws: int, seed: int, run: int = 1) -> DataFrame:
    """(draw, slot, columns of ``rows``): each draw takes ``run`` rows in a row from a random start, past the end from the front.

    Draws are with replacement, so callers filter what may be drawn first; without any row it raises.
    """
    numbered = running_sum(rows.withColumn("_one", F.lit(1)), "_one", ordinal, "_place").drop("_one")
    n = rows.count()
    if n == 0:
        raise ValueError("no row to draw from")
    starts = rows.sparkSession.range(draws).select(F.col("id").alias("draw"), hashed_number(F.col("id"), seed, F.lit(n)).alias("_start"))
    slots = starts.select("draw", "_start", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(run - 1).cast("long"))).alias("slot"))
    return slots.withColumn("_place", F.pmod(F.col("_start") + F.col("slot"), F.lit(n))).join(numbered, "_place").drop("_place", "_start")


def epoch_batches(df: DataFrame, key: str, seed: int, rows: int) -> DataFrame:
    """``df`` with ``batch`` and ``slot``: one pass in seeded order; the last batch is filled up from the front."""
    n = df.count()
    hashed = df.withColumn("_seeded", F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))))
    placed = place_in_order(hashed, [F.col("_seeded"), F.col(key)], hash_range(F.col("_seeded"), n), "_place").drop("_seeded")
    ends = -(-n // rows) * rows
    spread = placed.withColumn("_at", F.explode(F.sequence(F.col("_place"), F.lit(ends - 1).cast("long"), F.lit(max(n, 1)).cast("long"))))
    return spread.withColumn("batch", batch_of(F.col("_at"), rows)).withColumn("slot", F.pmod("_at", F.lit(rows).cast("long"))).drop("_place", "_at")


def random_windows(shards: DataFrame, ids: str, ordinal: str, draws: int, length: int, seed: int, size: Column | None = None) -> DataFrame:
    """(draw, shard, start, x, y): each draw takes a shard, all alike likely, then a start; y is x moved by one.

    Shards without ``length`` + 1 tokens are never drawn. Shards are numbered by ordinal and size alone (``size``, where
    it is cheaper than making the tokens); the draws are then broadcast, so only drawn shards leave the scan.
    """
    n_ids = F.size(ids) if size is None else size
    long_enough = shards.where(n_ids > length).select(ordinal, F.lit(1).alias("_one"))
    numbered = running_sum(long_enough, "_one", ordinal, "_number").drop("_one")
    n = long_enough.count()
    if n == 0:
        raise ValueError("no shard is long enough")
    drawn = shards.sparkSession.range(draws).select(F.col("id").alias("draw"), hashed_number(F.col("id"), seed, F.lit(n)).alias("_number"))
    chosen = numbered.join(F.broadcast(drawn), "_number").drop("_number")  # a row a draw
    start = hashed_number(F.col("draw"), seed + 1, F.size("_ids") - length)
    placed = shards.select(ordinal, F.col(ids).alias("_ids")).join(F.broadcast(chosen), ordinal).withColumn("start", start)
    window = F.slice("_ids", (F.col("start") + 1).cast("int"), length + 1)
    return placed.select("draw", F.col(ordinal).alias("shard"), "start", F.slice(window, 1, length).alias("x"), F.slice(window, 2, length).alias("y"))
