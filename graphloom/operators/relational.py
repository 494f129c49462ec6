"""Filters, predicates, ranking tiers and relational aggregates over entities and relationships."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions import text
from graphloom.operators.loops import settled
from graphloom.schema import bare_kind, effective_confidence

#: Kinds that have no source line by nature, and array or string built-ins.
LINELESS = ("http_endpoint", "http_endpoint_definition", "http_endpoint_call", "endpoint", "route", "externalapi", "datastore", "dataaccess", "queue", "event", "infraresource", "messagetopic", "service", "externalpackage", "external", "config")
BUILTINS = ("map", "filter", "reduce", "forEach", "some", "every", "find", "findIndex", "includes", "indexOf", "join", "split", "trim", "slice", "splice", "concat", "push", "pop", "shift", "unshift", "sort", "reverse", "flat", "flatMap", "keys", "values", "entries", "toLowerCase", "toUpperCase", "replace", "padStart", "padEnd")


def of_kind(df: DataFrame, kind: str) -> DataFrame:
    return df.where(bare_kind(F.col("kind")) == bare_kind(F.lit(kind)))


def of_edge_kinds(df: DataFrame, kinds: list[str] | None) -> DataFrame:
    return df if kinds is None else df.where(F.col("kind").isin(*kinds))


def confident(df: DataFrame, least: float) -> DataFrame:
    return df.where(effective_confidence(F.col("confidence")) >= least)


def noise(name: Column, kind: Column, subtype: Column, source_file: Column, start_line: Column, qualified_name: Column, local_scope: Column, entity_id: Column | None = None, provenance: Column | None = None) -> Column:
    """Noise bucket by ordered predicates; 'none' is a real result. An id with proc: in it marks a process, too, and an inferred hierarchy a shadow."""
    bare = bare_kind(kind)
    process = (bare == "process") | (F.coalesce(entity_id.contains("proc:"), F.lit(False)) if entity_id is not None else F.lit(False))
    inferred = F.coalesce(provenance == "INFERRED_FROM_CLASS_HIERARCHY", F.lit(False)) if provenance is not None else F.lit(False)
    callee = F.trim(F.regexp_extract(name, r"(?:→|->)(.*)$", 1))
    return (
        F.when(process & callee.isin(*BUILTINS), "process")
        .when(bare == "pattern", "pattern")
        .when((bare == "component") & subtype.isin("file", "module"), "container")
        .when((bare == "component") & (start_line == 0) & (source_file != "") & (name == source_file), "container")
        .when(inferred | (start_line == 0) & (F.coalesce(qualified_name, F.lit("")) == "") & ~bare.isin(*LINELESS), "shadow")
        .when((bare == "schema") & (subtype == "field"), "schema_field")
        .when(local_scope == "true", "local_scope")
        .otherwise("none")
    )


def rank_tier(noise_kind: Column, start_line: Column) -> Column:
    tier = F.when(start_line > 0, 0).otherwise(1)
    for kind, value in (("shadow", 4), ("container", 5), ("process", 6), ("schema_field", 7), ("pattern", 8)):
        tier = F.when(noise_kind == kind, value).otherwise(tier)
    return tier


def repo_match(repos: DataFrame, wanted: str) -> DataFrame:
    """(repo, tier) of repos(repo, path): exact key, exact path, key in any case, base name; only the best tier stays."""
    w = F.lit(wanted)
    tier = F.when(F.col("repo") == w, 1).when(F.col("path") == w, 2).when(F.lower("repo") == F.lower(w), 3).when(F.lower(text.base_name(F.col("path"))) == F.lower(w), 4)
    found = repos.select("repo", tier.alias("tier")).where("tier is not null")
    return found.join(found.agg(F.min("tier").alias("tier")), "tier").select("repo", "tier")


def closest(repos: DataFrame, wanted: str) -> DataFrame:
    """The repo nearest by edit distance, if that is at most a third of the longer name."""
    d = F.levenshtein(F.lower("repo"), F.lower(F.lit(wanted)))
    near = repos.where(3 * d <= F.greatest(F.length("repo"), F.lit(len(wanted))))
    return near.select("repo", d.alias("distance")).orderBy("distance", "repo").limit(1)


def budgeted(df: DataFrame, column: str, order: list[Column], tokens: int) -> DataFrame:
    """Rows in order while their running length / 4 fits the budget, per group column 'grp'."""
    w = Window.partitionBy("grp").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("used", F.sum(F.ceil(F.length(column) / 4)).over(w)).where(F.col("used") <= tokens)


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page of a ranked list, by a bounded top-k instead of a global row number."""
    first = df.orderBy(*order).limit(number * size)
    return first.orderBy(*order).offset((number - 1) * size)


def longest_prefix(records: DataFrame, modules: DataFrame) -> DataFrame:
    """records(path) with the longest module(module, root) whose root is a prefix at a / boundary.

    Each path meets its own prefixes by equality, so no pair of record and module is tested twice.
    """
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    hit = records.withColumn("root", F.explode(prefixes)).join(modules, "root")
    return records.join(hit.groupBy("path").agg(F.max_by("module", F.length("root")).alias("module")), "path", "left")


#: Files that mark a package's directory.
MARKERS = ("package.json", "index.ts", "index.js", "index.tsx", "index.jsx", "__init__.py", "go.mod", "Cargo.toml", "pom.xml", "build.gradle")


def derived_modules(files: DataFrame, default_depth: int = 2, most_depth: int = 3) -> DataFrame:
    """(path, module) of files(path): the deepest directory on the way that holds a marker file, at most most_depth down.

    Without one, or with one at the root only, the first default_depth directories; a file above them belongs to _root.
    Each path meets its own directories by equality.
    """
    rows = files.select("path").distinct().withColumn("parts", F.split("path", "/"))
    upto = lambda n: F.array_join(F.slice("parts", 1, n), "/")
    marks = rows.where(F.element_at("parts", -1).isin(*MARKERS) & F.size("parts").between(2, most_depth + 1)).select(upto(F.size("parts") - 1).alias("dir")).distinct()
    dirs = F.transform(F.sequence(F.lit(1), F.least(F.size("parts") - 1, F.lit(most_depth))), lambda i: F.array_join(F.slice("parts", 1, i), "/"))
    asked = rows.where(F.size("parts") > 1).select("path", F.explode(dirs).alias("dir"))
    best = asked.join(marks, "dir").groupBy("path").agg(F.max_by("dir", F.length("dir")).alias("marked"))
    return rows.join(best, "path", "left").select("path", F.coalesce("marked", text.module_root(F.col("path"), default_depth)).alias("module"))


def fields(df: DataFrame, wanted: list[str], envelope: tuple[str, ...] = ()) -> DataFrame:
    """df with the named fields only, at any depth: structs and arrays of structs are cut inside; envelope columns stay whole."""

    def cut(c: Column, kind) -> Column | None:
        if isinstance(kind, T.ArrayType):
            inner = cut(F.col("x"), kind.elementType)
            return c if inner is None else F.transform(c, lambda x: cut(x, kind.elementType))
        if not isinstance(kind, T.StructType):
            return None
        kept = [(f.name, f.dataType) for f in kind.fields if f.name in wanted]
        return F.struct(*[c[n].alias(n) if cut(c[n], k) is None else cut(c[n], k).alias(n) for n, k in kept])

    out = []
    for f in df.schema.fields:
        if f.name in envelope:
            out.append(F.col(f.name))
        elif f.name in wanted:
            inner = cut(F.col(f.name), f.dataType)
            out.append(F.col(f.name) if inner is None else inner.alias(f.name))
    return df.select(*out)


def degree(edges: DataFrame, tasks: int | None = None) -> DataFrame:
    """(id, in_degree, out_degree, degree) from one pass over both ends; ``tasks``: over how many tasks the ids are dealt.

    Without it ends are counted before they are shuffled and a shuffle's usual number of tasks holds all ids. With it each task holds its share of the
    ids; a hub's ends are one task's rows then, but one entry there.
    """
    ends = edges.select(F.explode(F.array(F.struct(F.col("from_id").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("to_id").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
    if tasks:
        ends = ends.repartition(tasks, "id")
    return ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.count(F.lit(1)).alias("degree"))


def endpoint_kinds(edges: DataFrame, entities: DataFrame, end: str, tasks: int | None = None) -> DataFrame:
    """(kind, entity_kind, n, weight) of edges by their kind and that of the entity at an end, null where there is none.

    An end's edges of a kind are added up before they meet the entity, so the join has a row per end and kind. ``tasks``: over how many tasks the ends
    are dealt, as in ``degree``; without it they are added up before they are shuffled, too.
    """
    ids = entities.select(F.col("id").alias(end), F.col("kind").alias("entity_kind"))
    if tasks:
        edges, ids = edges.select(end, "kind", "weight").repartition(tasks, end), ids.repartition(tasks, end)
    sums = edges.groupBy(end, "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"))
    return sums.join(ids.hint("merge"), end, "left").groupBy("kind", "entity_kind").agg(F.sum("n").alias("n"), F.sum("weight").alias("weight"))


def module_edges(edges: DataFrame, modules: DataFrame, prebaked: DataFrame | None = None) -> DataFrame:
    """(from_module, to_module, weight): edges between different modules(id, module); _external is left out.

    prebaked(from_module, to_module, weight): stored DEPENDS_ON edges, which are used with their weights if there are any.
    """
    apart = "from_module <> to_module and from_module <> '_external' and to_module <> '_external'"
    if prebaked is not None and not prebaked.isEmpty():
        return prebaked.where(apart).groupBy("from_module", "to_module").agg(F.sum("weight").cast("long").alias("weight"))
    a = modules.select(F.col("id").alias("from_id"), F.col("module").alias("from_module"))
    b = modules.select(F.col("id").alias("to_id"), F.col("module").alias("to_module"))
    both = edges.join(a, "from_id").join(b, "to_id").where(apart)
    return both.groupBy("from_module", "to_module").agg(F.count(F.lit(1)).alias("weight"))


def module_table(modules: DataFrame, pairs: DataFrame, components: DataFrame) -> DataFrame:
    """(module, in_degree, out_degree, cycle): module pairs' degrees with the module's cycle, -1 outside any; components(id, component)."""
    into = pairs.groupBy(F.col("to_module").alias("module")).agg(F.count(F.lit(1)).alias("in_degree"))
    out = pairs.groupBy(F.col("from_module").alias("module")).agg(F.count(F.lit(1)).alias("out_degree"))
    cycles = components.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    member = components.join(cycles, "component").select(F.col("id").alias("module"), F.col("component").alias("cycle"))
    rows = modules.select("module").distinct().join(into, "module", "left").join(out, "module", "left").join(member, "module", "left")
    return rows.select("module", F.coalesce("in_degree", F.lit(0)).alias("in_degree"), F.coalesce("out_degree", F.lit(0)).alias("out_degree"), F.coalesce("cycle", F.lit("-1")).alias("cycle"))


def coupling(pairs: DataFrame) -> DataFrame:
    """(module, ce, ca, instability) of distinct (from_module, to_module)."""
    p = pairs.select("from_module", "to_module").where("from_module <> to_module").distinct()
    ends = p.select(F.explode(F.array(F.struct(F.col("from_module").alias("module"), F.lit(1).alias("e"), F.lit(0).alias("a")), F.struct(F.col("to_module").alias("module"), F.lit(0).alias("e"), F.lit(1).alias("a")))).alias("x"))
    g = ends.groupBy("x.module").agg(F.sum("x.e").alias("ce"), F.sum("x.a").alias("ca"))
    return g.withColumn("instability", F.round(F.col("ce") / (F.col("ce") + F.col("ca")), 2))


def lib_boundary(target_repo: Column, source_repo: Column, declared: Column, internal: Column) -> Column:
    """First party, third party or unannotated, by ordered rules."""
    return F.when(target_repo == source_repo, "first_party").when(internal, "first_party").when(declared, "third_party").otherwise("unannotated")


def numbered(df: DataFrame, *order: Column, name: str = "number") -> DataFrame:
    """df with each row's place (from 0) in a total order, without one task that sorts all rows.

    Rows are dealt in ranges of the order and written once, so partitions stay as they are; a range's first place is the sum of the
    counts before it (one number per range), and a row's place in its range is its place in the partition.
    """
    ranges = settled(df.repartitionByRange(*order).sortWithinPartitions(*order))
    at = ranges.withColumn("_at", F.monotonically_increasing_id())  # the partition's number above 33 bits of places in it
    counts = sorted((r.p, r.n) for r in at.groupBy(F.shiftright("_at", 33).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())  # a row per range
    starts, total = [], 0
    for part, n in counts:
        starts.append((part, total))
        total += n
    offsets = df.sparkSession.createDataFrame(starts or [(0, 0)], "_p long, _start long")
    placed = at.withColumn("_p", F.shiftright("_at", 33)).join(F.broadcast(offsets), "_p")  # a row per range
    return placed.select(*df.columns, (F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).alias(name))


def chunk_stream(ranked: DataFrame, edges: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Nodes(id, score) in chunks of that many by score, and edges in the first chunk after both their ends."""
    nodes = numbered(ranked, F.desc("score"), F.col("id")).withColumn("chunk", F.floor(F.col("number") / size)).drop("number")
    a, b = nodes.select(F.col("id").alias("from_id"), F.col("chunk").alias("ca")), nodes.select(F.col("id").alias("to_id"), F.col("chunk").alias("cb"))
    return nodes, edges.join(a, "from_id").join(b, "to_id").select("from_id", "to_id", F.greatest("ca", "cb").alias("chunk"))
