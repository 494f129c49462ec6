"""Links between repositories and sources: equi-joins on normalised keys, aggregated before they meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.operators.loops import few_edges, stored
from graphloom.schema import relationship_id


def by_key(consumers: DataFrame, producers: DataFrame) -> DataFrame:
    """(source, target): consumers(id, repo, key) to producers of the same key in another repo, the first producer per (repo, key)."""
    first = producers.groupBy("repo", "key").agg(F.min("id").alias("target")).withColumnRenamed("repo", "target_repo")
    own = consumers.groupBy("repo", "key").agg(F.min("id").alias("source"))
    return own.join(first, "key").where("repo <> target_repo").select("source", "target", "key", F.col("repo").alias("source_repo"), "target_repo")


def http_links(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """(source, target, strategy, confidence) of calls(id, repo, verb, path) and routes(id, repo, verb, path).

    exact: same verb and route shape (resolved); literal_param_fill: one literal segment of the call stands where the route has a
    parameter; dynamic_suffix_match: the route's shape ends the call's, the longest such (both inferred). The last two must lead to one
    target only: where several routes fit as well, the call stays unlinked. All are equi-joins on variants of the key.

    What a call links to follows from its repo, verb and path, so each combination of them is a class that is linked once; calls meet
    the links of their class at the end. Ids that occur more than once are linked one by one, over all their rows.
    """
    r = routes.groupBy("repo", "verb", "path").agg(F.min("id").alias("id")).withColumn("key", text.join_path(F.col("path")))
    r = stored(r.groupBy("repo", "verb", "key").agg(F.min("id").alias("target")).withColumnRenamed("repo", "target_repo"))
    found = [F.col("id").alias("source"), "target", "strategy", "confidence"]
    many = stored(calls.groupBy("id").count().where("count > 1").select("id"))
    again = not many.isEmpty()
    once = calls.join(many.hint("merge"), "id", "left_anti") if again else calls
    same = ["repo", "verb", "path"]
    classes = stored(once.select(*same).distinct().withColumn("class", F.monotonically_increasing_id()))
    linked = stored(classes.join(_linked(classes, r, "class").hint("merge"), "class").select(*same, "target", "strategy", "confidence"))
    out = once.join(F.broadcast(linked) if few_edges(linked, LOCAL_LINKS) else linked.hint("merge"), same).select(*found)  # counted
    return out.union(_linked(calls.join(many.hint("merge"), "id", "left_semi"), r, "id").select(*found)) if again else out


#: Links of classes that are broadcast to their calls; more are merged.
LOCAL_LINKS = 100_000


def _linked(calls: DataFrame, r: DataFrame, by: str) -> DataFrame:
    """(by, target, strategy, confidence) of calls(by, repo, verb, path) to the first targets r(target_repo, verb, key, target)."""
    c = stored(calls.withColumn("key", text.join_path(F.col("path"))))
    parts = F.split(F.col("key"), "/")

    def join(left: DataFrame) -> DataFrame:
        return left.join(r.hint("merge"), ["verb", "key"]).where("repo <> target_repo")

    def unique(found: DataFrame, strategy: str) -> DataFrame:
        longest = found.groupBy(by, F.length("key").alias("size")).agg(F.min("target").alias("target"), F.count_distinct("target").alias("n"))
        best = longest.groupBy(by).agg(F.max_by(F.struct("target", "n"), "size").alias("b")).where("b.n = 1")
        return best.select(by, "b.target", F.lit(strategy).alias("strategy"), F.lit("inferred").alias("confidence"))

    exact = stored(join(c).select(by, "target", F.lit("exact").alias("strategy"), F.lit("resolved").alias("confidence")))
    rest = c.join(exact.select(by).hint("merge"), by, "left_anti")
    filled = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.when(F.get(parts, i) != "{*}", F.array_join(F.transform(parts, lambda x, j: F.when(j == i, "{*}").otherwise(x)), "/")))
    literal = stored(unique(join(rest.where(F.size(parts) >= 2).withColumn("key", F.explode(F.array_compact(filled)))), "literal_param_fill"))
    rest = rest.join(literal.select(by).hint("merge"), by, "left_anti").where(F.size(parts) >= 3)
    tails = F.transform(F.sequence(F.lit(3), F.size(parts)), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, i, F.size(parts)), "/")))
    return exact.union(literal).union(unique(join(rest.withColumn("key", F.explode(tails))), "dynamic_suffix_match"))


def topic_links(publishers: DataFrame, subscribers: DataFrame) -> DataFrame:
    """(topic, source_repo, target_repo): one row per pair of repos and topic, whatever the number of operations."""
    p = publishers.select("topic", F.col("repo").alias("source_repo")).distinct()
    s = subscribers.select("topic", F.col("repo").alias("target_repo")).distinct()
    return p.join(s, "topic").where("source_repo <> target_repo")


# Labels that say nothing about an architecture.
STOP_LABELS = ("buf", "ctx", "err", "fd", "fs", "req", "res", "xhr", "ch", "ok", "map", "filter", "socket", "csv", "inactive", "pending", "footer", "body", "content", "data", "error")


def normal_label(c: Column) -> Column:
    """Lower case without a Service suffix; empty where too short, destructured, a line reference or a word of the stop-list."""
    low = F.lower(c)
    bare = F.regexp_replace(low, "service$", "")
    bad = low.rlike(r"^[\(\[\{]|:[0-9]+$") | (F.length(F.regexp_replace(low, "^[^a-z]+", "")) <= 3) | low.isin(*STOP_LABELS)
    return F.when(bad, "").otherwise(bare)


def label_score(raw: Column, threshold: float = 0.5, low: float = 0.6, high: float = 0.8) -> Column:
    """Raw idf times compatibility, scaled into the link band above the candidate threshold."""
    scaled = low + (raw - threshold) / (1 - threshold) * (high - low)
    return F.when(raw <= 0, 0.0).when(raw < threshold, raw).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), scaled)))


def same_as_score(overlap: Column, least: float, low: float = 0.7, high: float = 0.98) -> Column:
    scaled = low + (overlap - least) / (1 - least) * (high - low)
    return F.when(overlap >= 1, high).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), scaled)))


#: Pairs of models that one task of same_as writes, about.
TASK_PAIRS = 8_000_000


def same_as(models: DataFrame, least: float = 0.5, gate: str | None = None, most: int = 2_000) -> DataFrame:
    """(a, b, overlap, confidence): models(id, repo, name, fields) of one canonical name in different repos with enough equal fields.

    ``gate`` names a boolean column: only models for which it is true (those in a shared library) take part. Models of one name, repo and
    set of fields are a class: classes are compared, and pairs of similar ones written out over their members, in tasks for as many pairs as
    there are. A name of over ``most`` classes is paired in blocks, and a class of over ``most`` models is held as several blocks of members.
    """
    from graphloom.operators.loops import dropped, stored
    from graphloom.operators.similarity import self_pairs

    m = models.where(F.col(gate)) if gate else models
    same = ["key", "repo", "fields"]
    m = stored(m.select(text.canonical_key(F.col("name")).alias("key"), "id", "repo", F.array_sort(F.array_distinct(F.transform("fields", text.field_name))).alias("fields")))
    classes = stored(m.groupBy(*same).agg(F.count(F.lit(1)).alias("n")).withColumn("class", F.monotonically_increasing_id()))
    block = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / most))
    members = stored(m.join(classes, same).groupBy("class", block.alias("block")).agg(F.collect_list("id").alias("ids")))
    dropped(m)
    both = self_pairs(classes.select("class", "n", *same), "key", "class", most).where("a_repo <> b_repo")
    overlap = F.size(F.array_intersect("a_fields", "b_fields")) / F.size(F.array_union("a_fields", "b_fields"))
    found = both.withColumn("overlap", F.round(overlap, 6)).where(F.col("overlap") >= least)
    found = stored(found.select("a_class", "b_class", "overlap", F.round(same_as_score(F.col("overlap"), least), 6).alias("confidence"), (F.col("a_n") * F.col("b_n")).alias("pairs")))
    tasks = max(1, -(-int(found.agg(F.sum("pairs")).first()[0] or 0) // TASK_PAIRS))
    side = lambda s: members.select(F.col("class").alias(f"{s}_class"), F.col("block").alias(f"{s}_block"), F.col("ids").alias(f"{s}_ids")).hint("merge")
    blocks = found.join(side("a"), "a_class").join(side("b"), "b_class")
    pairs = blocks.repartition(tasks, "a_class", "a_block", "b_class", "b_block").withColumn("x", F.explode("a_ids")).withColumn("y", F.explode("b_ids")).where("x <> y")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "overlap", "confidence")


def phantom_edges(links: DataFrame) -> DataFrame:
    """CALLS edges in the source repo for links(source, target, relation, method); ids are repo::id."""
    use = links.where("relation = 'calls'").where(F.col("method").isin("http", "kafka_topic", "ws_channel")).dropDuplicates(["source", "target", "method"])
    use = use.where(F.split_part("source", F.lit("::"), F.lit(1)) != F.split_part("target", F.lit("::"), F.lit(1)))
    source = F.substring_index("source", "::", 1)
    local = F.expr("substring(source, instr(source, '::') + 2)")
    return use.select(source.alias("repo"), local.alias("from_id"), F.col("target").alias("to_id"), relationship_id(local, F.col("target"), F.concat(F.lit("CALLS:phantom:"), F.col("method"))).alias("id"))


def orphans(have: DataFrame, lack: DataFrame) -> DataFrame:
    """Channels of one side that the other side never uses."""
    return have.select("topic").distinct().join(lack.select("topic").distinct(), "topic", "left_anti")


def orphan_reason(url: Column) -> Column:
    """Why a call has no handler: its base is dynamic, its path a template, or nothing serves it."""
    return F.when(url.rlike(r"^(\$\{|[A-Z_]+\+|\{)"), "dynamic_baseurl").when(url.contains("${") | (F.instr(url, "{") > 2), "template_literal").otherwise("no_handler_found")


def orphan_callers(fetches: DataFrame, endpoints: DataFrame) -> DataFrame:
    """(caller, url, method, reason): fetches(caller, url, method, key) whose key no producer among endpoints(key, side) has; GET by default."""
    served = endpoints.where("side = 'producer'").select("key").distinct()
    gone = fetches.join(served, "key", "left_anti")
    return gone.select("caller", "url", F.coalesce("method", F.lit("GET")).alias("method"), orphan_reason(F.col("url")).alias("reason")).dropDuplicates(["caller", "url"])


#: Fixed value: what the key of an import from outside starts with.
EXTERNAL = "scope:component:import:external:"


def dependency_usage(declared: DataFrame, imported: DataFrame) -> DataFrame:
    """(name, status): declared(name) against imported(target): equal, under name/, or a key that ends in :name.

    Imports that nothing declares are phantoms only where their key says that they are external; one row a name.
    """
    parts = lambda c: F.transform(F.sequence(F.lit(1), F.size(F.split(c, "/"))), lambda i: F.array_join(F.slice(F.split(c, "/"), 1, i), "/"))
    tail = F.substring_index("target", ":", -1)
    used = imported.select("target", F.explode(F.array_distinct(F.concat(parts(F.col("target")), F.array(tail), F.when(F.col("target").startswith(EXTERNAL), parts(tail)).otherwise(F.array().cast("array<string>"))))).alias("name")).distinct()
    hit = declared.join(used.select("name").distinct().withColumn("hit", F.lit(1)), "name", "left")
    known = used.join(declared, "name", "left_semi").select("target").distinct()
    phantom = imported.select("target").distinct().where(F.col("target").startswith(EXTERNAL)).join(known, "target", "left_anti")
    return hit.select("name", F.when(F.col("hit") == 1, "used").otherwise("unused").alias("status")).union(phantom.select(tail.alias("name"), F.lit("phantom").alias("status")).distinct())


def tests_walkup(tests: DataFrame, calls: DataFrame, is_test: DataFrame, most_callers: int = 5) -> DataFrame:
    """(from_id, to_id, via): a test of a helper also tests its production callers, if those are few and not tested already."""
    fan = calls.groupBy("to_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= most_callers).select("to_id")
    callers = calls.join(fan, "to_id", "left_semi").join(is_test.select(F.col("id").alias("from_id")), "from_id", "left_anti").select(F.col("from_id").alias("caller"), F.col("to_id").alias("helper"))
    new = tests.select(F.col("from_id").alias("test"), F.col("to_id").alias("helper")).join(callers, "helper").where("test <> caller")
    known = tests.select(F.col("from_id").alias("test"), F.col("to_id").alias("caller"))
    return new.join(known, ["test", "caller"], "left_anti").groupBy(F.col("test").alias("from_id"), F.col("caller").alias("to_id")).agg(F.min("helper").alias("via"))


def span_coverage(spans: DataFrame, lines: DataFrame, bin_lines: int = 50) -> DataFrame:
    """(id, covered, instrumented, pct) of spans(id, path, first, last) over lines(path, line, hits); spans without lines give no row.

    A band join as an equi-join: spans visit the line bins they touch. Without a usable span an entity stands for its whole file.
    """
    usable = F.coalesce((F.col("first") > 0) & (F.col("last") >= F.col("first")), F.lit(False))
    s = spans.where(usable).withColumn("bin", F.explode(F.sequence(F.floor(F.col("first") / bin_lines), F.floor(F.col("last") / bin_lines))))
    hit = s.join(lines.withColumn("bin", F.floor(F.col("line") / bin_lines)), ["path", "bin"]).where("line between first and last")
    count = [F.sum(F.when(F.col("hits") > 0, 1).otherwise(0)).alias("covered"), F.count(F.lit(1)).alias("instrumented")]
    files = spans.where(~usable).select("id", "path").join(lines.groupBy("path").agg(*count), "path").select("id", "covered", "instrumented")
    return hit.groupBy("id").agg(*count).union(files).withColumn("pct", F.round(100.0 * F.col("covered") / F.col("instrumented"), 2))


def last_before(uses: DataFrame, defs: DataFrame, keys: list[str], at: str, value: str, order: str) -> DataFrame:
    """As-of join: each use with the last definition of its keys strictly before it; ties of definitions to the larger value.

    One sort per key over both sides, no pair of use and definition; equal times put uses first.
    """
    both = uses.select(*keys, F.col(at).alias("_at"), F.col(order).alias("_id"), F.lit(None).cast(defs.schema[value].dataType).alias("_v"), F.lit(0).alias("_d"), F.lit(None).cast(defs.schema[at].dataType).alias("_t"))
    both = both.union(defs.select(*keys, F.col(at), F.lit(None).cast(uses.schema[order].dataType), F.col(value), F.lit(1), F.col(at)))
    w = Window.partitionBy(*keys).orderBy("_at", "_d", "_v").rowsBetween(Window.unboundedPreceding, -1)
    out = both.withColumn("def_value", F.last("_v", ignorenulls=True).over(w)).withColumn("def_at", F.last("_t", ignorenulls=True).over(w)).where("_d = 0")
    return out.select(*keys, F.col("_id").alias(order), F.col("_at").alias(at), "def_value", "def_at")


def mentions(sections: DataFrame, names: DataFrame, skip: tuple[str, ...] = ("this", "that", "with", "from")) -> DataFrame:
    """(section, id): section texts(section, text) that hold an entity's name of four characters or more; ambiguous names link nothing."""
    known = names.withColumn("token", F.lower("name")).where(F.length("token") >= 4).groupBy("token").agg(F.count_distinct("id").alias("n"), F.min("id").alias("id")).where("n = 1").where(~F.col("token").isin(*skip))
    words = sections.select("section", F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z0-9_]+"))).alias("token")).where(F.length("token") >= 4)
    return words.join(known, "token").select("section", "token", "id")


def resolve_names(queries: DataFrame, entities: DataFrame) -> DataFrame:
    """(query, tier, matches, id): the first tier with a hit, and the id only where it is one; queries(query), entities(id, qualified_name, name[, repo]).

    Tiers: id; qualified name, name, dotted suffix of the qualified name, each in any case. ``repo::name`` looks in that repo only.
    """
    q = queries.select("query").distinct()
    pinned = F.instr("query", "::") > 0
    q = q.withColumn("pin", F.when(pinned, F.substring_index("query", "::", 1))).withColumn("k", F.lower(F.when(pinned, F.expr("substring(query, instr(query, '::') + 2)")).otherwise(F.col("query"))))
    e = entities if "repo" in entities.columns else entities.withColumn("repo", F.lit(None).cast("string"))
    parts = F.split(F.lower("qualified_name"), r"\.")
    suffixes = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")))
    keys = F.array(F.struct(F.lit(2).alias("tier"), F.lower("qualified_name").alias("k")), F.struct(F.lit(3).alias("tier"), F.lower("name").alias("k")))
    named = e.select("id", "repo", F.explode(F.concat(keys, F.coalesce(F.transform(suffixes, lambda x: F.struct(F.lit(4).alias("tier"), x.alias("k"))), F.array().cast("array<struct<tier:int,k:string>>")))).alias("x")).select("id", "repo", "x.tier", "x.k")
    by_id = q.where("pin is null").join(e.select(F.col("id").alias("query"), "id").hint("merge"), "query")  # a compressed table looks small enough to broadcast
    by_id = by_id.select("query", F.lit(1).alias("tier"), "id")
    every = by_id.union(q.join(named.hint("merge"), "k").where("pin is null or pin = repo").select("query", "tier", "id"))
    best = every.join(every.groupBy("query").agg(F.min("tier").alias("tier")).hint("merge"), ["query", "tier"]).groupBy("query", "tier").agg(F.count_distinct("id").alias("matches"), F.min("id").alias("id"))
    return best.select("query", "tier", "matches", F.when(F.col("matches") == 1, F.col("id")).alias("id"))


def find_callers(queries: DataFrame, entities: DataFrame, calls: DataFrame) -> DataFrame:
    """(query, status, id): callers of what each query names; where several entities fit, the query is ambiguous and has no caller.

    Callers without an entity count too: calls are joined, never looked up.
    """
    found = resolve_names(queries, entities)
    hit = found.where("matches = 1").select("query", F.col("id").alias("to_id"))
    callers = hit.join(calls.select("from_id", "to_id"), "to_id").select("query", F.lit("caller").alias("status"), F.col("from_id").alias("id")).distinct()
    return callers.union(found.where("matches > 1").select("query", F.lit("ambiguous"), F.lit(None).cast("string")))


def inherited(extends: DataFrame, members: DataFrame) -> DataFrame:
    """(class, member, definer, depth): where each class finds its members, nearest base first, then left to right; own ones win.

    Goes up until no class gains a member; a class already has its nearest definer, so a cycle of bases ends too.
    Rounds are merged: broadcast, the bases or a front would come to the driver each round.
    """
    from graphloom.operators.loops import settled

    own = settled(members.select("class", "member", F.col("class").alias("definer"), F.lit(0).alias("depth"), F.lit(0).alias("ordinal")).dropDuplicates(["class", "member"]))
    found, front = own, own
    while True:
        up = extends.join(front.withColumnRenamed("class", "base").drop("ordinal").hint("merge"), "base").select("class", "member", "definer", (F.col("depth") + 1).alias("depth"), F.col("ordinal"))
        best = up.groupBy("class", "member").agg(F.min(F.struct("depth", "ordinal", "definer")).alias("b")).select("class", "member", "b.definer", "b.depth", "b.ordinal")
        front = settled(best.join(found.select("class", "member").hint("merge"), ["class", "member"], "left_anti"))
        if front.isEmpty():
            return found.select("class", "member", "definer", "depth")
        found = settled(found.union(front))


def precedes(migrations: DataFrame) -> DataFrame:
    """(from_id, to_id): PRECEDES edges of migrations(revision, down_revision), from each one that exists to what builds on it."""
    known = migrations.select(F.col("revision").alias("from_id")).distinct()
    return migrations.where("down_revision is not null").select(F.col("down_revision").alias("from_id"), F.col("revision").alias("to_id")).join(known, "from_id", "left_semi").distinct()
