"""Communities over levels and biconnected blocks, against brute force on small graphs."""

import itertools
import random

import pytest

from graphloom.operators import blocks, groups, louvain

EDGES = "from_id string, to_id string, weight int"


def modularity(label, pairs):
    m = sum(w for *_, w in pairs)
    k = {}
    for a, b, w in pairs:
        k[label[a]] = k.get(label[a], 0) + w
        k[label[b]] = k.get(label[b], 0) + w
    return sum(w for a, b, w in pairs if label[a] == label[b]) / m - sum(x * x for x in k.values()) / (4 * m * m)


def cliques(n, size, links):
    inner = [(f"q{c}m{i}", f"q{c}m{j}", 3) for c in range(n) for i in range(size) for j in range(i)]
    return inner + [(f"q{a}m{i}", f"q{b}m{i}", 1) for a, b, w in links for i in range(w)]


def found(spark, pairs, **how):
    e = spark.createDataFrame(pairs, EDGES)
    nodes = spark.createDataFrame([(x,) for x in sorted({x for a, b, _ in pairs for x in (a, b)})], "id string")
    return {r.id: r.community for r in louvain.communities(nodes, e, **how).collect()}


def partitions(n):
    def grow(labels):
        if len(labels) == n:
            yield labels
        else:
            for c in range(max(labels, default=-1) + 2):
                yield from grow([*labels, c])

    return grow([])


def test_cliques_in_two_chains_merge_as_the_optimum_does(spark):
    # two chains of three cliques with strong links, one weak link between the chains
    pairs = cliques(6, 4, [(0, 1, 4), (1, 2, 4), (3, 4, 4), (4, 5, 4), (2, 3, 1)])
    nodes = {x for a, b, _ in pairs for x in (a, b)}
    best = max(partitions(6), key=lambda p: round(modularity({x: p[int(x[1])] for x in nodes}, pairs), 12))
    got = found(spark, pairs)
    assert len(set(got.values())) == len(set(best))
    assert all((got[a] == got[b]) == (best[int(a[1])] == best[int(b[1])]) for a, b in itertools.combinations(sorted(nodes), 2))
    assert modularity(got, pairs) > modularity(found(spark, pairs, levels=1), pairs) - 1e-9


@pytest.mark.parametrize("seed", [1, 2])
def test_levels_never_lose_and_agree_in_one_task_and_in_joins(spark, seed):
    rng = random.Random(seed)
    pairs = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}", rng.randrange(1, 4)) for _ in range(110)]
    pairs = [p for p in pairs if p[0] != p[1]]
    one, all_, joins = found(spark, pairs, levels=1), found(spark, pairs), found(spark, pairs, local_edges=0)
    assert all_ == joins
    assert modularity(all_, pairs) > modularity(one, pairs) + 0.05
    assert all(min(x for x in all_ if all_[x] == c) == c for c in set(all_.values()))


def test_no_edges_loops_and_parallel_edges(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "id string")
    none = spark.createDataFrame([], EDGES)
    assert {r.id: r.community for r in louvain.communities(nodes, none).collect()} == {"a": "a", "b": "b", "c": "c"}
    assert {r.community for r in louvain.communities(nodes, none, least=2).collect()} == {"-1"}
    loops = spark.createDataFrame([("a", "a", 5), ("a", "b", 1), ("b", "a", 1)], EDGES)
    assert {r.id: r.community for r in louvain.communities(nodes, loops).collect()} == {"a": "a", "b": "a", "c": "c"}


def cut_points(pairs):
    """Ids without which their neighbours are no longer together."""
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    out = set()
    for v in near:
        first, *rest = near[v]
        seen, todo = {first}, [first]
        while todo:
            for y in near[todo.pop()] - {v} - seen:
                seen.add(y)
                todo.append(y)
        if not set(rest) <= seen:
            out.add(v)
    return sorted(out)


def points(spark, pairs, **how):
    nodes = spark.createDataFrame([(x,) for p in pairs for x in p] or [("z",)], "id string")
    return sorted(r.id for r in blocks.articulation_points(nodes, spark.createDataFrame(pairs, "from_id string, to_id string"), **how).collect())


@pytest.mark.parametrize("seed, local", [(1, 10**6), (2, 10**6), (3, 0)])
def test_articulation_points_of_random_graphs(spark, seed, local):
    rng = random.Random(seed)
    pairs = [(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(34)] + [(f"t{i}", f"t{rng.randrange(i)}") for i in range(1, 14)]
    want = cut_points(pairs)
    assert points(spark, pairs, local_edges=local) == want and len(want) > 10


def test_articulation_points_of_plain_shapes(spark):
    ring = [(f"r{i}", f"r{(i + 1) % 9}") for i in range(9)]
    star = [("hub", f"s{i}") for i in range(40)] + [("hub", "hub"), ("s1", "hub")]
    bow = [("m", "x"), ("x", "y"), ("y", "m"), ("m", "p"), ("p", "q"), ("q", "m")]
    chain = [(f"c{i}", f"c{i + 1}") for i in range(12)]
    assert points(spark, ring + star + bow + chain) == sorted(["hub", "m", *(f"c{i}" for i in range(1, 12))])
    assert points(spark, [("only", "only")]) == [] == points(spark, [])


def test_small_components_are_dealt_and_large_ones_are_not(spark, monkeypatch):
    rng = random.Random(4)
    small = [(f"{c}{i}", f"{c}{rng.randrange(i)}") for c in "abcdef" for i in range(1, 9)] + [(f"{c}{rng.randrange(9)}", f"{c}{rng.randrange(9)}") for c in "abcdef" for _ in range(3)]
    large = [(f"x{i}", f"x{rng.randrange(i)}") for i in range(1, 20)] + [("x0", "x19"), ("x3", "x17")]
    whole, seen = blocks.blocks, []
    monkeypatch.setattr(blocks, "blocks", lambda pairs, local: seen.append(pairs.count()) or whole(pairs, local))
    assert points(spark, small) == cut_points(small) and seen == []
    assert points(spark, small + large, local_edges=15) == cut_points(small + large) and 19 <= seen.pop() <= 21


def test_a_task_takes_lots_of_whole_components():
    import pyarrow as pa

    rows = [(c, 100 * c + i, 100 * c + i + 1) for c in range(6) for i in range(c + 1)] + [(9, 900 + i, 900 + (i + 1) % 5) for i in range(5)]
    batches = pa.table(dict(zip("cab", map(list, zip(*rows)), strict=True))).to_batches(max_chunksize=4)
    lots = list(blocks._lots(iter(batches), 4))
    assert [len(a) for a, _ in lots] == [6, 4, 5, 6, 5] and len(batches) > 5
    assert [v for lot in lots for v in blocks._cuts(*lot)] == [100 * c + i for c in range(6) for i in range(1, c + 1)]


def test_one_block_is_one_name(spark):
    pairs = spark.createDataFrame([(0, 1), (1, 2), (0, 2), (2, 3), (3, 4), (2, 4), (4, 5)], "a bigint, b bigint")
    tree, found = blocks.blocks(pairs)
    of = {r.v: r.block for r in found.collect()}
    parent = {r.v: r.parent for r in tree.collect()}
    edges = {}
    for v, block in of.items():
        edges.setdefault(block, set()).update({v, parent[v]})
    assert sorted(map(sorted, edges.values())) == [[0, 1, 2], [2, 3, 4], [4, 5]]


def test_modularity_is_that_of_the_definition(spark):
    pairs = cliques(3, 4, [(0, 1, 2), (1, 2, 1)])
    got = found(spark, pairs)
    labels = spark.createDataFrame(list(got.items()), "id string, community string")
    assert round(groups.modularity(labels, spark.createDataFrame(pairs, EDGES)).first()[0], 9) == round(modularity(got, pairs), 9)


def test_hashes_that_ids_share_are_not_used(spark):
    from pyspark.sql import functions as F

    pairs = cliques(4, 4, [(0, 1, 1), (2, 3, 1)])
    e = spark.createDataFrame(pairs, EDGES)
    nodes = spark.createDataFrame([(x,) for x in sorted({x for a, b, _ in pairs for x in (a, b)})], "id string")
    clash = lambda seed, id: F.xxhash64(F.substring(id, 1, 2)) if seed == 0 else louvain._code(seed, id)
    labels = groups.named(louvain.by_level(nodes, e, code=clash)[1], 1).collect()
    assert {(r.id, r.community) for r in labels} == {(r.id, f"{r.id[:3]}0") for r in labels} and len(labels) == 16


def test_a_round_sends_the_edges_twice_and_no_names(spark):
    plans = []

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df)

    keep, louvain.stored = louvain.stored, seen
    try:
        found(spark, cliques(3, 4, [(0, 1, 1), (1, 2, 1)]))
    finally:
        louvain.stored = keep
    rounds = [p for p in plans if "max_by" in p]
    assert rounds and all("string" not in p and p.count("Exchange hashpartitioning") <= 7 for p in rounds)


def test_parts_give_the_labels_of_joins(spark):
    rng = random.Random(3)
    pairs = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}", rng.randrange(1, 4)) for _ in range(110)] + [("n1", "n1", 2)]
    assert found(spark, pairs) == found(spark, pairs, part_edges=20) == found(spark, pairs, part_edges=10**6, local_edges=0)


def test_the_registered_rounds_are_not_joins_and_no_part_has_the_graph(spark, monkeypatch):
    from graphloom.plans import catalog

    kept, keep = [], louvain._dealt
    monkeypatch.setattr(louvain, "_moved", lambda *how: pytest.fail("a round of joins"))
    monkeypatch.setattr(louvain, "_dealt", lambda und, parts: kept.append((und.count(), [len(r.w) // 8 for r in keep(und, parts).collect()])) or keep(und, parts))
    assert catalog.queries()["communities"](spark, "/root/testdata/sf0.001").count() > 0
    edges, parts = kept[0]
    assert sum(parts) == edges and len(parts) == 4 and max(parts) < edges / 2


def test_quality_goes_over_parts_too(spark, monkeypatch):
    from graphloom.plans import catalog

    monkeypatch.setattr(louvain, "_moved", lambda *how: pytest.fail("a round of joins"))
    row = catalog.queries()["communities_quality"](spark, "/root/testdata/sf0.001").first()
    assert row.beats_modules and row.beats_one_level and row.no_small_ones and row.named_by_smallest
