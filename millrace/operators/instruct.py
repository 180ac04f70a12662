"""Instruction data: pairs, keep-first deduplication, topic merge, quotas, seeded splits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import rules
from millrace.functions.text import one_line, split_key

#: Pairs of the how/why topic that a merge takes at most.
REASON_LIMIT = 2500
#: Parts in which a hot group is ranked.
SALTS = 64


def turn_pairs(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, instruction, output): a user's turn and the assistant's that follows it."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    after = conversations.select("conv_id", "turn", "role", "text", F.lead(F.struct("role", "text")).over(order).alias("next"))
    return after.where((F.col("role") == "user") & (F.col("next.role") == "assistant")).select("conv_id", "turn", F.col("text").alias("instruction"), F.col("next.text").alias("output"))


def _clean(pairs: DataFrame) -> DataFrame:
    """Pairs with single spaces. ``inline`` keeps Spark from writing the expressions out in each of the many rules."""
    return pairs.select("ordinal", F.inline(F.array(F.struct(one_line(F.col("instruction")).alias("instruction"), one_line(F.col("output")).alias("output")))))


def generated(pairs: DataFrame, topic: str, brands: tuple[str, ...] = (), source: str = "generated") -> DataFrame:
    """Pairs (ordinal, instruction, output) that pass the common rules and the topic's, as keyed examples."""
    clean = _clean(pairs)
    i, o = F.col("instruction"), F.col("output")
    kept = clean.where(rules.common(i, o, brands) & rules.KINDS[topic](i, o))
    return kept.select("ordinal", "instruction", "output", F.lit("assistant_qa").alias("task"), F.lit(f"{source}_{topic}").alias("source"), F.lit(topic).alias("topic"), split_key(F.lit(topic), i).alias("split_key"))


def generated_all(pairs: DataFrame, brands: tuple[str, ...] = (), source: str = "generated") -> DataFrame:
    """As ``generated`` for every topic in one pass, with the topic's number as ``topic_order``."""
    clean = _clean(pairs)
    i, o = F.col("instruction"), F.col("output")
    passed = F.array_compact(F.array(*[F.when(rule(i, o), F.struct(F.lit(k).alias("topic_order"), F.lit(topic).alias("topic"))) for k, (topic, rule) in enumerate(rules.KINDS.items())]))
    kept = clean.where(rules.common(i, o, brands)).select("*", F.explode(passed).alias("_t")).select("ordinal", "instruction", "output", "_t.topic", "_t.topic_order")
    return kept.select("ordinal", "instruction", "output", F.lit("assistant_qa").alias("task"), F.concat(F.lit(source + "_"), "topic").alias("source"), "topic", split_key(F.col("topic"), i).alias("split_key"), "topic_order")


def keep_first(df: DataFrame, key: str, *order: str | Column) -> DataFrame:
    """The first row of each key. min_by over whole rows combines before the shuffle, so a hot key costs a row a task."""
    rank = F.struct(*[o if isinstance(o, Column) else F.col(o) for o in order])
    return df.groupBy(F.col(key).alias("_key")).agg(F.min_by(F.struct(*df.columns), rank).alias("_row")).select("_row.*")


def first_per_group(df: DataFrame, group: str, k: int, *order: str | Column) -> DataFrame:
    """The first ``k`` rows of each group.

    A task keeps ``k`` rows of each group before the shuffle, whatever k: Spark does so up to a threshold, which is raised for a
    larger k. Beyond 1,000 rows the tasks' rows of a group first meet in ``SALTS`` parts, so that no task sees more than some
    tasks' rows of a hot group and then ``SALTS`` * k.
    """
    if k > 1000:
        threshold = "spark.sql.optimizer.windowGroupLimitThreshold"
        conf = df.sparkSession.conf
        conf.set(threshold, str(max(k, int(conf.get(threshold)))))
        part = Window.partitionBy(group, "_salt").orderBy(*order)
        df = df.withColumn("_salt", F.spark_partition_id() % SALTS).withColumn("_rank", F.row_number().over(part)).where(F.col("_rank") <= k).drop("_salt", "_rank")
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)


def quota_mix(df: DataFrame, group: str, quotas: Mapping[str, int], *order: str | Column) -> DataFrame:
    """The first rows of each group up to its own quota; groups without one are left out."""
    quota = F.create_map(*[F.lit(x) for item in quotas.items() for x in item])
    some = df.where(F.col(group).isin(*quotas))
    most = max(quotas.values(), default=0)  # a literal bound lets Spark drop rows before the shuffle
    return first_per_group(some, group, most, *order).where(F.col("rank") <= F.try_element_at(quota, F.col(group)))


def ordered_union(*parts: DataFrame) -> DataFrame:
    """UNION ALL with the part's number as ``source_order``."""
    out = parts[0].withColumn("source_order", F.lit(0))
    for k, part in enumerate(parts[1:], 1):
        out = out.unionByName(part.withColumn("source_order", F.lit(k)))
    return out


def reason_order(df: DataFrame, limit: int = REASON_LIMIT) -> DataFrame:
    """How/why pairs that pass again, those whose answers begin with an order last, by key; the first ``limit``."""
    i, o = F.col("instruction"), F.col("output")
    tier = rules.starts_with_any(F.lower(o), rules.REASON_FALLBACK_STARTS).cast("int")
    return df.where(rules.reason_again(i, o)).withColumn("tier", tier).orderBy("tier", "split_key", "ordinal").limit(limit)


def merge_topics(parts: Mapping[str, DataFrame], limit: int = REASON_LIMIT) -> DataFrame:
    """Topics in order: rows known from earlier topics go, then the how/why order and limit, then keep-first."""
    tagged = [part.withColumn("topic_order", F.lit(k)) for k, part in enumerate(parts.values())]
    return merge_tagged(reduce(DataFrame.unionByName, tagged), list(parts).index("how_why_short") if "how_why_short" in parts else -1, limit)


def merge_tagged(rows: DataFrame, reason: int, limit: int = REASON_LIMIT) -> DataFrame:
    """``merge_topics`` of rows of all topics with their ``topic_order``; ``reason`` is that of the how/why topic.

    The rows are read three times, so callers whose rules are dear store them first. A key stays with its first topic. Only the how/why topic needs the earlier keys before its limit: one anti-join,
    then one keep-first over everything.
    """
    others = rows.where(F.col("topic_order") != reason).withColumn("tier", F.lit(0))
    earlier = others.where(F.col("topic_order") < reason).select("split_key").distinct()
    limited = reason_order(rows.where(F.col("topic_order") == reason).join(earlier, "split_key", "left_anti"), limit)
    return keep_first(others.unionByName(limited), "split_key", "topic_order", "tier", "ordinal")


def seeded_key(key: Column, seed: int) -> Column:
    """A hash that orders rows pseudo-randomly, the same on every run and in any engine with md5."""
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))


def seeded_split(df: DataFrame, key: str, seed: int, share: float, least: int = 1) -> DataFrame:
    """``df`` with ``split``: the max(least, floor(n * share)) rows first in seeded order are "val", the rest "train"."""
    from millrace.operators.sequence import hash_range, place_in_order

    n = df.count()
    hashed = df.withColumn("_seeded", seeded_key(F.col(key), seed))
    place = place_in_order(hashed, [F.col("_seeded"), F.col(key)], hash_range(F.col("_seeded"), n))
    return place.withColumn("split", F.when(F.col("place") < max(least, int(n * share)), "val").otherwise("train")).drop("_seeded")


def head_split(df: DataFrame, ordinal: str, share: float) -> DataFrame:
    """``df`` with ``split``: the first floor(n * share) rows in order are "val", the rest "train"; no shuffle of the order."""
    from millrace.operators.sequence import running_sum

    placed = running_sum(df.withColumn("_one", F.lit(1)), "_one", ordinal, "_place").drop("_one")
    return placed.withColumn("split", F.when(F.col("_place") < int(df.count() * share), "val").otherwise("train")).drop("_place")


def task_or_unknown(task: Column) -> Column:
    """The task's name, stripped; "unknown" where it is null or blank."""
    name = F.trim(task)
    return F.when(name != "", name).otherwise("unknown")


def of_tasks(df: DataFrame, task: str, valid: Sequence[str]) -> DataFrame:
    """The rows of known tasks; a blank task counts as "unknown"."""
    return df.withColumn(task, task_or_unknown(F.col(task))).where(F.col(task).isin(*valid))


def new_rows(candidates: DataFrame, known: DataFrame, key: str, *order: str | Column) -> DataFrame:
    """First candidates of the keys that ``known`` does not have: one round of an incremental deduplication."""
    return keep_first(candidates, key, *order).join(known.select(key).distinct(), key, "left_anti")


def until_target(df: DataFrame, key: str, turn: str, ordinal: str, target: int, least_gain: int, patience: int) -> DataFrame:
    """First rows by ``key`` of the rounds (``turn``) up to the one that brings them to ``target`` or ends ``patience``
    rounds in a row with fewer than ``least_gain`` new keys each; ``target`` rows at most, in order.

    Rounds do not depend on each other once the first row of every key is known: only their gains, one number a
    round, are read in order.
    """
    first = keep_first(df, key, turn, ordinal)
    gains = df.select(turn).distinct().join(first.groupBy(turn).agg(F.count(F.lit(1)).alias("_n")), turn, "left")
    held, low, last = 0, 0, None
    for number, n in gains.select(turn, F.coalesce("_n", F.lit(0))).orderBy(turn).toLocalIterator():
        held, low, last = held + n, low + 1 if n < least_gain else 0, number
        if held >= target or low >= patience:
            break
    return first.where(F.col(turn) <= F.lit(last)).orderBy(turn, ordinal).limit(target)


def distinct_on(df: DataFrame, key: str, ordinal: str, most: int) -> DataFrame:
    """The first row of each key, ``most`` rows at most, in order."""
    return keep_first(df, key, ordinal).orderBy(ordinal).limit(most)
