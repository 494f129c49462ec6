"""Flows and lattices: process and event flows, effects, taint, decay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.loops import settled, stored
from graphloom.schema import bare_kind

#: The effect lattice, and confidence bases and decays by source.
EFFECTS = ("db_read", "db_write", "http_out", "fs_read", "fs_write", "mutation", "env_read")
BASES = {"direct_ast": 1.0, "regex": 0.7, "yaml_rule": 0.85, "calls_hop": 0.95, "import_hop": 0.9, "constant_prop": 0.85, "fallback": 0.4}
HOP, FLOOR = 0.95, 0.5


def base_confidence(source: Column) -> Column:
    out = F.lit(0.4)
    for k, v in BASES.items():
        out = F.when(source == k, v).otherwise(out)
    return out


def decayed(source: Column, hops: Column) -> Column:
    """seed * 0.95^n over calls, 0.9^n over imports, 0.85^n over constants."""
    rate = F.when(source == "import_hop", 0.9).when(source == "constant_prop", 0.85).otherwise(0.95)
    return base_confidence(source) * F.pow(rate, hops)


def chains(starts: DataFrame, edges: DataFrame, most_steps: int, least_steps: int) -> DataFrame:
    """(path, steps): cycle-free walks from starts(id) that can't go on or reach the bound; steps counts nodes.

    Walks are the result, so their number is bounded by the fan-out and the depth that the caller allows.
    """
    pairs = edges.select("from_id", "to_id").distinct()
    walks = settled(starts.select(F.array("id").alias("path"), F.col("id").alias("last")))
    done = walks.limit(0)
    for k in range(1, most_steps):
        on = walks.join(pairs, walks.last == pairs.from_id).where(~F.array_contains("path", F.col("to_id")))
        nxt = settled(on.select(F.concat("path", F.array("to_id")).alias("path"), F.col("to_id").alias("last")))
        ended = walks.join(nxt.select(F.slice("path", 1, k).alias("path")).distinct(), "path", "left_anti")
        done = done.union(ended)
        walks = nxt
    done = done.union(walks)
    return done.select("path", F.size("path").alias("steps")).where(F.col("steps") >= least_steps)


#: What an entry's kind says about how a process starts; others are functions.
ENTRY_KINDS = {"http_endpoint_definition": "http", "http_endpoint": "http", "messageconsumer": "kafka_consumer", "scheduledjob": "scheduled"}


def process_flows(entries: DataFrame, implements: DataFrame, calls: DataFrame, repos: DataFrame, most_steps: int = 5, least_steps: int = 3) -> DataFrame:
    """(path, steps, label, entry_kind, cross_stack) of walks from entries(id, name, kind), handlers included.

    implements(handler, endpoint) is walked backwards, so a flow roots at the endpoint, goes on at its handler and is named by the
    route; the handler starts no flow of its own. Short flows go unless an endpoint is their root. cross_stack: the steps lie in
    several of repos(id, repo). A call to what has no entity ends the walk there.
    """
    kind = F.lit("function")
    for name, value in ENTRY_KINDS.items():
        kind = F.when(bare_kind(F.col("kind")) == name, value).otherwise(kind)
    handlers = implements.select(F.col("handler").alias("id")).distinct()
    starts = entries.join(handlers, "id", "left_anti").select("id", "name", kind.alias("entry_kind"))
    bridge = implements.select(F.col("endpoint").alias("from_id"), F.col("handler").alias("to_id"))
    walks = chains(starts, calls.select("from_id", "to_id").union(bridge), most_steps, 2).withColumn("id", F.element_at("path", 1))
    kept = walks.join(starts, "id").where((F.col("steps") >= least_steps) | (F.col("entry_kind") == "http"))
    steps = kept.select("path", F.explode("path").alias("id")).join(repos.select("id", "repo"), "id").groupBy("path").agg(F.count_distinct("repo").alias("n"))
    return kept.join(steps, "path", "left").select("path", "steps", F.col("name").alias("label"), "entry_kind", (F.coalesce("n", F.lit(0)) > 1).alias("cross_stack"))


def effect_union(effects: DataFrame) -> DataFrame:
    """(id, confidence, effects): an entity's effects(id, effect, confidence), the headline their largest, listed as effect=confidence by name."""
    best = effects.groupBy("id", "effect").agg(F.max("confidence").alias("confidence"))
    one = F.concat("effect", F.lit("="), F.format_number("confidence", 2))
    return best.groupBy("id").agg(F.max("confidence").alias("confidence"), F.array_join(F.sort_array(F.collect_list(one)), ",").alias("effects"))


def propagate(seeds: DataFrame, calls: DataFrame, hop: float = HOP, floor: float = FLOOR) -> DataFrame:
    """(id, effect, confidence): direct effects and, up CALLS, the largest product of confidences above the floor."""
    up = settled(calls.select("from_id", "to_id").distinct())
    best = settled(seeds.groupBy("id", "effect").agg(F.max("confidence").alias("confidence")))
    front = best
    while True:
        new = up.join(front, up.to_id == front.id).select(F.col("from_id").alias("id"), "effect", (F.col("confidence") * hop).alias("confidence")).where(F.col("confidence") >= floor)
        new = new.groupBy("id", "effect").agg(F.max("confidence").alias("got"))
        front = settled(new.join(best, ["id", "effect"], "left").where("confidence is null or got > confidence").select("id", "effect", F.col("got").alias("confidence")))
        if front.isEmpty():
            return best
        best = settled(best.union(front).groupBy("id", "effect").agg(F.max("confidence").alias("confidence")))


def pure(functions: DataFrame, effects: DataFrame) -> DataFrame:
    """(id, pure, confidence): functions without any effect are pure with 0.3."""
    top = effects.groupBy("id").agg(F.max("confidence").alias("c"))
    return functions.select("id").join(top, "id", "left").select("id", F.col("c").isNull().alias("pure"), F.coalesce("c", F.lit(0.3)).alias("confidence"))


def taint(sources: DataFrame, sinks: DataFrame, sanitizers: DataFrame, calls: DataFrame, hops: int = 4, hop: float = 0.9, floor: float = FLOOR) -> DataFrame:
    """(source, sink, category, hops, confidence): sources(id, category) that reach sinks(id, category) of their category.

    Walks stop at sanitizers(id, category) of the category; one row per source and node is kept each round.
    """
    pairs = settled(calls.select("from_id", "to_id").distinct())
    front = sources.select(F.col("id").alias("source"), "id", "category", F.lit(0).alias("hops")).join(sanitizers, ["id", "category"], "left_anti").select("source", "id", "category", "hops")
    seen = settled(front)
    for k in range(1, hops + 1):
        step = seen.where(F.col("hops") == k - 1).withColumnRenamed("id", "at").join(pairs, F.col("at") == F.col("from_id"))
        new = step.select("source", F.col("to_id").alias("id"), "category").distinct().join(sanitizers, ["id", "category"], "left_anti").join(seen, ["source", "id", "category"], "left_anti")
        seen = settled(seen.union(new.select("source", "id", "category", F.lit(k).alias("hops"))))
    hit = seen.join(sinks, ["id", "category"], "left_semi").withColumn("confidence", F.round(F.pow(F.lit(hop), F.col("hops")), 6))
    return hit.where(F.col("confidence") >= floor).select("source", F.col("id").alias("sink"), "category", "hops", "confidence")


#: Kinds of relationships that reach a database, and what they do there.
DB_EDGES = {"JOINS_COLLECTION": "db_read", "READS_FROM": "db_read", "WRITES_TO": "db_write", "QUERIES": "db_read", "ACCESSES_TABLE": "db_read", "MODIFIES_TABLE": "db_write", "GRAPH_RELATES": "db_read"}


def db_sinks(edges: DataFrame) -> DataFrame:
    """(function, sink, sink_kind, relation): relationships(from_id, to_id, kind) of kinds that reach a database, as sinks of whatever their source holds."""
    kind = F.lit(None).cast("string")
    for name, value in DB_EDGES.items():
        kind = F.when(F.col("kind") == name, value).otherwise(kind)
    return edges.where(F.col("kind").isin(*DB_EDGES)).select(F.col("from_id").alias("function"), F.col("to_id").alias("sink"), kind.alias("sink_kind"), F.col("kind").alias("relation")).distinct()


def data_flows(sources: DataFrame, passes: DataFrame, sinks: DataFrame, edges: DataFrame, hops: int = 3, sink_kind: str | None = None) -> DataFrame:
    """(function, field, at, held, sink, sink_kind, relation, hops): which request fields reach which sinks, in at most ``hops`` calls.

    sources(function, field) hold a field; passes(from_id, to_id, field, renamed) hand a field to a callee under another name; sinks(function, field, sink,
    sink_kind) take that field. Relationships that reach a database are sinks of every field that their function holds. Only what holds the
    field goes on: a state is (source, its field, function, the field's name there), kept once with its fewest hops. ``sink_kind`` leaves those
    of that kind, or of its family (db: db_read and db_write).
    """
    links = stored(passes.select("from_id", "to_id", "field", "renamed").distinct())
    seen = front = stored(sources.select("function", "field", F.col("function").alias("at"), F.col("field").alias("held"), F.lit(0).alias("hops")).distinct())
    for k in range(1, hops + 1):
        step = front.join(links.select(F.col("from_id").alias("at"), "to_id", F.col("field").alias("held"), "renamed"), ["at", "held"])
        new = step.select("function", "field", F.col("to_id").alias("at"), F.col("renamed").alias("held")).distinct()
        front = stored(new.join(seen, ["function", "field", "at", "held"], "left_anti").withColumn("hops", F.lit(k)))
        seen = seen.union(front)
    told = sinks.select(F.col("function").alias("at"), F.col("field").alias("held"), "sink", "sink_kind", F.lit("sink").alias("relation")).distinct()
    out = seen.join(told, ["at", "held"]).unionByName(seen.join(db_sinks(edges).withColumnRenamed("function", "at"), "at"))
    if sink_kind is not None:
        out = out.where((F.col("sink_kind") == sink_kind) | F.col("sink_kind").startswith(f"{sink_kind}_"))
    return out.select("function", "field", "at", "held", "sink", "sink_kind", "relation", "hops")
