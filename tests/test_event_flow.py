"""Event flows composed with calls: fixtures, and brute force over walks."""

import random

import pytest

from graphloom.operators import event_flow


def frames(spark, subscribes, publishes, calls):
    return spark.createDataFrame(subscribes, "function string, channel string"), spark.createDataFrame(publishes, "function string, channel string"), spark.createDataFrame(calls, "from_id string, to_id string")


def flows(spark, subscribes, publishes, calls=(), **how):
    return sorted((r.entry, ",".join(r.chain), r.channels) for r in event_flow.event_flows(*frames(spark, list(subscribes), list(publishes), list(calls)), **how).collect())


def test_a_chain_goes_through_calls_to_the_next_channel(spark):
    got = flows(spark, [("subA", "A"), ("subB", "B")], [("pubB", "B")], [("subA", "helper"), ("helper", "pubB")])
    assert got == [("A", "A,subA,helper,pubB,B,subB", 2), ("B", "B,subB", 1)]


def test_a_cycle_stops_at_a_channel_seen_before(spark):
    assert flows(spark, [("h", "A")], [("h", "A")]) == [("A", "A,h", 1)]
    got = flows(spark, [("a", "A"), ("b", "B")], [("a", "B"), ("b", "A")], [("a", "b"), ("b", "a")])
    assert got == [("A", "A,a,B,b", 2), ("B", "B,b,A,a", 2)]


def test_depth_caps_the_channels(spark):
    n = 6
    got = flows(spark, [(f"s{i}", f"t{i}") for i in range(n)], [(f"s{i}", f"t{i + 1}") for i in range(n - 1)], most_depth=2)
    assert max(c for e, _, c in got if e == "t0") == 3 and len(got) == n


def test_short_flows_nobody_listens_and_hops(spark):
    assert flows(spark, [("a", "A")], [("a", "Z")], least_steps=4) == []
    assert flows(spark, [("a", "A")], [("a", "Z")]) == [("A", "A,a,Z", 2)]
    far = [("a", "f1"), ("f1", "f2"), ("f2", "p")]
    assert flows(spark, [("a", "A")], [("p", "Z")], far, most_hops=2) == [("A", "A,a", 1)]
    assert flows(spark, [("a", "A")], [("p", "Z")], far, most_hops=3) == [("A", "A,a,f1,f2,p,Z", 2)]
    assert flows(spark, [], []) == [] == flows(spark, [], [("a", "Z")])
    assert flows(spark, [("a", None), (None, "A"), ("b", "B")], [(None, "B"), ("b", None)]) == [("B", "B,b", 1)]


@pytest.mark.parametrize("seed", [1, 2])
def test_channel_hops_equal_a_search_from_each_channel(spark, seed):
    rng = random.Random(seed)
    f = lambda: f"f{rng.randrange(25)}"
    c = lambda: f"c{rng.randrange(5)}"
    subscribes, publishes, calls = [(f(), c()) for _ in range(9)], [(f(), c()) for _ in range(12)], [(f(), f()) for _ in range(40)]
    want = {}
    for channel in {x for _, x in subscribes}:
        depth = {x: 0 for x, y in subscribes if y == channel}
        for d in range(3):
            depth |= {b: d + 1 for a, b in calls if depth.get(a) == d and b not in depth}
        for x, target in set(publishes):
            if x in depth:
                n, count = want.get((channel, target), (99, 0))
                want[channel, target] = (min(n, depth[x] + 1), count + 1)
    got = event_flow.channel_hops(*frames(spark, subscribes, publishes, calls), most_hops=3).collect()
    assert {(r.source, r.target): (len(r.way), r.publishers) for r in got} == want
    steps = set(calls)
    assert all((r.way[0], r.source) in subscribes and (r.way[-1], r.target) in publishes and all(p in steps for p in zip(r.way, r.way[1:])) for r in got)
