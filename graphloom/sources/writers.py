"""Writers: graph tables, GraphML and Cypher lines, a grid layout for drawings, append logs."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.schema import relationship_id


def write_graph(entities: DataFrame, relationships: DataFrame, folder: str, form: str = "parquet") -> None:
    """Both tables, sorted inside their files so that statistics on ids can prune."""
    entities.sortWithinPartitions("id").write.mode("overwrite").format(form).save(f"{folder}/entities.{form}")
    relationships.sortWithinPartitions("from_id", "to_id", "kind").write.mode("overwrite").format(form).save(f"{folder}/relationships.{form}")


def graphml(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Lines (part, line) of a GraphML document: nodes, then edges, dangling ones too; parts 0 and 3 are its frame.

    Nodes carry name, kind, file and line; an edge without an id of its own gets the hash of its ends and kind.
    """
    spark = entities.sparkSession
    x = text.escape_xml
    data = lambda key, c: F.concat(F.lit(f'<data key="{key}">'), x(c), F.lit("</data>"))
    file = F.coalesce("source_file", F.lit("")) if "source_file" in entities.columns else F.lit("")
    line = F.coalesce("start_line", F.lit(0)) if "start_line" in entities.columns else F.lit(0)
    node = F.concat(F.lit('<node id="'), x(F.col("id")), F.lit('">'), data("name", F.col("name")), data("kind", F.col("kind")), data("file", file), data("line", line.cast("string")), F.lit("</node>"))
    own = relationship_id(F.col("from_id"), F.col("to_id"), F.col("kind"))
    edge_id = F.coalesce("id", own) if "id" in edges.columns else own
    edge = F.concat(F.lit('<edge id="'), x(edge_id), F.lit('" source="'), x(F.col("from_id")), F.lit('" target="'), x(F.col("to_id")), F.lit('">'), data("ekind", F.col("kind")), F.lit("</edge>"))
    keys = "".join(f'<key id="{k}" for="{of}" attr.name="{k}" attr.type="{kind}"/>' for k, of, kind in (("name", "node", "string"), ("kind", "node", "string"), ("file", "node", "string"), ("line", "node", "int"), ("ekind", "edge", "string")))
    frame = spark.createDataFrame([(0, f'<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns">{keys}<graph edgedefault="directed">'), (3, "</graph></graphml>")], "part int, line string")
    return frame.union(entities.select(F.lit(1), node)).union(edges.select(F.lit(2), edge))


def write_stats(entities: DataFrame, relationships: DataFrame, folder: str) -> None:
    """A sidecar of one JSON row beside a graph: its numbers of entities and relationships, and how many there are of each kind."""
    kinds = lambda df: df.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("kind", "n")))).alias("kinds"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))  # noqa: E731  a row per kind
    e, r = kinds(entities), kinds(relationships)
    one = e.select(F.col("n").alias("entities"), F.col("kinds").alias("entity_kinds")).crossJoin(r.select(F.col("n").alias("relationships"), F.col("kinds").alias("relationship_kinds")))  # one row each
    one.coalesce(1).write.mode("overwrite").json(f"{folder}/stats.json")


def save_finding(spark: SparkSession, log: str, finding: dict) -> None:
    """Append a finding to a log of JSON lines; its type is note where none is given."""
    row = {"type": "note"} | {k: v for k, v in finding.items() if v not in (None, "")}
    spark.createDataFrame([(json.dumps(row, sort_keys=True),)], "value string").write.mode("append").text(log)


def cypher_name(c):
    """Letters, digits and underscores only; a leading digit gets an underscore."""
    s = F.regexp_replace(F.regexp_replace(c, r"^SCOPE\.", ""), "[^A-Za-z0-9_]", "_")
    return F.when(s.rlike("^[0-9]"), F.concat(F.lit("_"), s)).when(s == "", "Entity").otherwise(s)


def cypher(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Statements (part, line): CREATE for nodes, then MATCH and CREATE for edges."""
    q = text.escape_cypher
    node = F.concat(F.lit("CREATE (:"), cypher_name(F.col("kind")), F.lit(" {id: '"), q(F.col("id")), F.lit("', name: '"), q(F.col("name")), F.lit("'});"))
    edge = F.concat(F.lit("MATCH (a {id: '"), q(F.col("from_id")), F.lit("'}), (b {id: '"), q(F.col("to_id")), F.lit("'}) CREATE (a)-[:"), F.upper(cypher_name(F.col("kind"))), F.lit("]->(b);"))
    return entities.select(F.lit(1).alias("part"), node.alias("line")).union(edges.select(F.lit(2), edge))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.orderBy("part", "line").select("line").write.mode("overwrite").text(path)


def grid(degrees: DataFrame, edges: DataFrame, top: int = 200, columns: int = 6, width: int = 160, height: int = 60) -> tuple[DataFrame, DataFrame]:
    """Positions of the top nodes by degree in a fixed grid, and the edges among them."""
    kept = degrees.orderBy(F.desc("degree"), "id").limit(top)
    i = F.row_number().over(Window.orderBy(F.desc("degree"), "id")) - 1  # over at most top rows
    nodes = kept.select("id", "degree", (i % columns * width).alias("x"), (F.floor(i / columns) * height).alias("y"))
    ids = nodes.select("id")
    return nodes, edges.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi").select("from_id", "to_id")


def svg(nodes: DataFrame, edges: DataFrame) -> str:
    """A drawing of a bounded layout, made on the driver."""
    import html

    at = {r.id: (r.x + 10, r.y + 20) for r in nodes.collect()}
    lines = "".join(f'<line x1="{at[e.from_id][0]}" y1="{at[e.from_id][1]}" x2="{at[e.to_id][0]}" y2="{at[e.to_id][1]}" stroke="#999"/>' for e in edges.collect())
    marks = "".join(f'<circle cx="{x}" cy="{y}" r="4"/><text x="{x + 6}" y="{y + 4}" font-size="9">{html.escape(i[:24])}</text>' for i, (x, y) in sorted(at.items()))
    return f'<svg xmlns="http://www.w3.org/2000/svg">{lines}{marks}</svg>'


def svg_page(nodes: DataFrame, edges: DataFrame, title: str) -> str:
    import html

    return f"<!DOCTYPE html><html><head><meta charset=\"utf-8\"><title>{html.escape(title)}</title></head><body>{svg(nodes, edges)}</body></html>"


def append(rows: DataFrame, path: str) -> None:
    """Append to a JSON Lines log."""
    rows.write.mode("append").json(path)
