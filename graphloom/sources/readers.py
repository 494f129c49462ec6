"""Readers: coverage reports, sections of Markdown and HTML, JSON Lines envelopes, rule packs, graph tables, append logs."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.sources.rules import first_matches
from graphloom.schema import ENTITY, RELATIONSHIP

LINES = "path string, line int, hits long, source string"


def lcov(text: str) -> list[tuple[str, int, int]]:
    """(path, line, hits) of an LCOV report; a repeated line keeps its largest hits; unknown records are skipped."""
    out: dict[tuple[str, int], int] = {}
    path = ""
    for row in text.splitlines():
        if row.startswith("SF:"):
            path = row[3:].strip()
        elif row.startswith("DA:") and path:
            parts = row[3:].split(",")
            if len(parts) >= 2 and parts[0].strip().isdigit() and parts[1].strip().lstrip("-").isdigit():
                key = (path, int(parts[0]))
                out[key] = max(out.get(key, 0), int(parts[1]))
        elif row.startswith("end_of_record"):
            path = ""
    return [(p, n, h) for (p, n), h in sorted(out.items())]


def lcov_totals(text: str) -> list[tuple[str, int, int]]:
    """(path, found, hit) of each file of an LCOV report: LF and LH where it states them, or else counted from its lines."""
    counted: dict[str, list[int]] = {}
    for path, _, hits in lcov(text):
        got = counted.setdefault(path, [0, 0])
        got[0] += 1
        got[1] += hits > 0
    path = ""
    for row in text.splitlines():
        if row.startswith("SF:"):
            path = row[3:].strip()
            counted.setdefault(path, [0, 0])
        elif row[:3] in ("LF:", "LH:") and path and row[3:].strip().isdigit():
            counted[path][row.startswith("LH:")] = int(row[3:])
        elif row.startswith("end_of_record"):
            path = ""
    return [(p, *n) for p, n in sorted(counted.items())]


def registry(spark: SparkSession, path: str) -> DataFrame:
    """(grp, repo, path) of a JSON file of groups, each with its repositories: what a caller may name."""
    rows = spark.read.option("multiLine", True).schema("groups array<struct<name: string, repos: array<struct<name: string, path: string>>>>").json(path)
    each = rows.select(F.explode("groups").alias("g")).select(F.col("g.name").alias("grp"), F.explode("g.repos").alias("r"))
    return each.select("grp", F.col("r.name").alias("repo"), "r.path")


def cobertura(text: str) -> list[tuple[str, int, int]]:
    out: dict[tuple[str, int], int] = {}
    for cls in _root(text).iter("class"):
        for line in cls.iter("line"):
            key = (cls.get("filename", ""), int(line.get("number", 0)))
            out[key] = max(out.get(key, 0), int(line.get("hits", 0)))
    return [(p, n, h) for (p, n), h in sorted(out.items()) if p and n]


def jacoco(text: str) -> list[tuple[str, int, int]]:
    out = []
    for package in _root(text).iter("package"):
        for file in package.iter("sourcefile"):
            out += [(f"{package.get('name')}/{file.get('name')}", int(x.get("nr", 0)), int(x.get("ci", 0))) for x in file.iter("line")]
    return sorted(out)


def _root(text: str) -> ET.Element:
    try:
        return ET.fromstring(text)
    except ET.ParseError:
        return ET.Element("none")


def report_format(text: str) -> str:
    head = text.lstrip()[:600]
    if head.startswith("<"):
        return "jacoco" if "<report" in head else "cobertura" if "<coverage" in head else ""
    return "lcov" if re.search(r"^(TN|SF|DA):", head, re.M) else ""


def parse_report(text: str, form: str = "") -> list[tuple[str, int, int, str]]:
    form = form or report_format(text)
    parser = {"lcov": lcov, "cobertura": cobertura, "jacoco": jacoco}.get(form)
    return [(*r, form) for r in parser(text)] if parser else []


def read_coverage(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, hits, source) of all reports under a path, one report a row of work."""
    files = spark.read.format("binaryFile").load(path).select(F.col("content").cast("string").alias("content"))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for text in pdf["content"]:
                yield pd.DataFrame(parse_report(text), columns=["path", "line", "hits", "source"])

    return files.mapInPandas(parse, LINES)


def sections(text: str) -> list[tuple[int, int, str, str, int, int]]:
    """(index, depth, title, body, first, last) of Markdown headings; a body ends at the next heading of any depth, a span at one as shallow."""
    rows = text.splitlines()
    heads, fenced = [], False
    for i, row in enumerate(rows):
        if row.lstrip().startswith("```"):
            fenced = not fenced
        m = re.match(r"(#{1,6})\s+(.*?)\s*#*$", row)
        if m and not fenced:
            heads.append((i, len(m[1]), m[2]))
    out = []
    for k, (i, depth, title) in enumerate(heads):
        body_end = heads[k + 1][0] if k + 1 < len(heads) else len(rows)
        span_end = next((j for j, d, _ in heads[k + 1 :] if d <= depth), len(rows))
        out.append((k, depth, title, "\n".join(rows[i + 1 : body_end]).strip(), i + 1, span_end))
    return out


SECTIONS = "path string, idx int, depth int, title string, body string, first int, last int"


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path).select("path", F.col("content").cast("string").alias("content"))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, text in zip(pdf["path"], pdf["content"], strict=True):
                yield pd.DataFrame([(p, *s) for s in sections(text)], columns=[c.split()[0] for c in SECTIONS.split(", ")])

    return files.mapInPandas(parse, SECTIONS)


def html_headings(pages: DataFrame) -> DataFrame:
    """(page_id, idx, depth, title): headings of pages(page_id, html), with native functions only."""
    heads = F.expr(r"regexp_extract_all(html, '(?is)<h([1-6])[^>]*>(.*?)</h', 0)")
    one = pages.select("page_id", F.posexplode(heads).alias("idx", "h"))
    title = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract("h", r"(?is)<h[1-6][^>]*>(.*)</h", 1), "<[^>]+>", ""), r"\s+", " "))
    return one.select("page_id", "idx", F.regexp_extract("h", r"(?i)<h([1-6])", 1).cast("int").alias("depth"), title.alias("title"))


def read_records(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Entities, relationships, stats and errors of JSON Lines envelopes {type, ...}."""
    raw = spark.read.text(path)
    kind = F.get_json_object("value", "$.type")
    entity = raw.where(kind == "entity").select(F.from_json("value", ENTITY).alias("e")).select("e.*")
    edge = raw.where(kind == "relationship").select(F.from_json("value", RELATIONSHIP).alias("e")).select("e.*")
    return {"entities": entity, "relationships": edge, "stats": raw.where(kind == "stats"), "errors": raw.where(kind == "error")}


def apply_rules(lines: DataFrame, rules: DataFrame) -> DataFrame:
    """(path, line, rule, kind, match) of text lines(path, line, text) under rules(rule, pattern, kind), in one pass over the lines.

    Rules are a reviewed table: their number doesn't grow with the data.
    """
    return first_matches(lines, [tuple(r) for r in rules.select("rule", "pattern", "kind").collect()])


def read_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(entities, relationships) of a graph folder: Parquet tables, else JSON Lines; an error where there are neither."""
    from pyspark.errors import AnalysisException

    for form in ("parquet", "json"):
        try:
            read = spark.read if form == "parquet" else spark.read.schema(ENTITY)
            entities = read.format(form).load(f"{folder}/entities.{form}")
            read = spark.read if form == "parquet" else spark.read.schema(RELATIONSHIP)
            return entities, read.format(form).load(f"{folder}/relationships.{form}")
        except AnalysisException:
            continue
    raise FileNotFoundError(f"no graph tables in {folder}")


def tail(log: DataFrame, n: int, order: str = "ts") -> DataFrame:
    """The newest n rows of an append log."""
    return log.orderBy(F.desc(order)).limit(n)
