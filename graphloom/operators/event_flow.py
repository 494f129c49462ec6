"""Event flows through calls: a channel's subscribers, what they call, and the channels that is published to.

A round extends states, one a (channel, function), by one call, and keeps only states that are new: work grows with channels times the functions near them
and not with the number of walks. A state carries one shortest way to it, the smallest of several. Channels are then chained by what their subscribers publish.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.loops import settled, stored


def reached(subscribes: DataFrame, calls: DataFrame, most_hops: int = 6) -> DataFrame:
    """(channel, function, way): functions within ``most_hops`` calls of a channel's subscribers, each with the shortest way from a subscriber to it.

    subscribes(function, channel), calls(from_id, to_id). Of equally short ways the smallest counts, compared from the function backwards.
    """
    pairs = stored(calls.select("from_id", "to_id").where("from_id <> to_id").distinct())
    front = stored(subscribes.select("channel", "function").where("channel IS NOT NULL AND function IS NOT NULL").distinct().withColumn("way", F.array("function")))
    seen = front
    for _ in range(most_hops):
        on = front.join(pairs, front.function == pairs.from_id).select("channel", F.col("to_id").alias("function"), F.concat("way", F.array("to_id")).alias("way"))
        best = on.groupBy("channel", "function").agg(F.min(F.struct(F.reverse("way").alias("back"))).alias("w"))
        new = best.join(seen.select("channel", "function"), ["channel", "function"], "left_anti").select("channel", "function", F.reverse("w.back").alias("way"))
        front = stored(new)
        if front.isEmpty():
            break
        seen = stored(seen.union(front))
    return seen


def channel_hops(subscribes: DataFrame, publishes: DataFrame, calls: DataFrame, most_hops: int = 6) -> DataFrame:
    """(source, target, way, publishers): channels whose subscribers, or what they call, publish to others (or to themselves).

    way leads from the subscriber to the publisher: the shortest, then the smallest; publishers counts the functions that publish to the target.
    publishes(function, channel).
    """
    sent = publishes.select("function", F.col("channel").alias("target")).where("target IS NOT NULL").distinct()
    both = reached(subscribes, calls, most_hops).join(sent, "function")
    return both.groupBy(F.col("channel").alias("source"), "target").agg(F.min(F.struct(F.size("way").alias("n"), "way")).alias("w"), F.count(F.lit(1)).alias("publishers")).select("source", "target", F.col("w.way").alias("way"), "publishers")


def event_flows(subscribes: DataFrame, publishes: DataFrame, calls: DataFrame, most_depth: int = 5, least_steps: int = 2, most_hops: int = 6) -> DataFrame:
    """(entry, chain, steps, channels): flows from each channel that has subscribers, over at most ``most_depth`` further channels.

    A chain is channel, subscriber, the functions called, publisher, channel, and so on; it ends at the smallest subscriber of its last channel, at a channel that nobody
    subscribes to, or at a subscriber that publishes to channels of the chain only: no channel comes twice. Flows of fewer than ``least_steps`` steps go.
    Chains are the result, so their number is bounded by the channels' fan-out and the depth that the caller allows.
    """
    hops = stored(channel_hops(subscribes, publishes, calls, most_hops))
    first = settled(subscribes.where("channel IS NOT NULL").groupBy("channel").agg(F.min("function").alias("subscriber")))
    walks = stored(first.select(F.array("channel").alias("seen"), F.array("channel").alias("chain"), F.col("channel").alias("last")))
    done = None
    for depth in range(most_depth + 1):
        on = walks.join(hops, walks.last == hops.source).where(~F.array_contains("seen", F.col("target")))
        grown = on.select(F.concat("seen", F.array("target")).alias("seen"), F.concat("chain", "way", F.array("target")).alias("chain"), F.col("target").alias("last"), F.col("seen").alias("before"))
        grown = stored(grown) if depth < most_depth else grown.limit(0)
        ended = walks.join(grown.select(F.col("before").alias("seen")).distinct(), "seen", "left_anti").select("seen", "chain", "last")
        done = ended if done is None else done.union(ended)
        walks = grown.select("seen", "chain", "last")
    closed = done.join(first.withColumnRenamed("channel", "last"), "last", "left")
    chain = F.when(F.col("subscriber").isNull(), F.col("chain")).otherwise(F.concat("chain", F.array("subscriber")))
    return closed.select(F.element_at("chain", 1).alias("entry"), chain.alias("chain"), F.size(chain).alias("steps"), F.size("seen").alias("channels")).where(F.col("steps") >= least_steps)
