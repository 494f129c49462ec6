"""Rule packs: file conventions, source patterns and relationship rules over texts, all rules in one pass.

A pack is a YAML file (or a dict) with ``file_conventions`` (glob, entity_type, name_from), ``source_patterns`` (pattern, entity_type, name_group,
scope) and ``relationship_rules`` (pattern, source_type, target_type, relationship, source_group, target_group). Whatever their number, texts are read once:
the literals that each pattern needs are found in a text by one automaton, and a pattern is only tried on the texts, or lines, that hold one of its literals.
Packs of other file extensions are left out before that. Patterns are Python's regular expressions.
"""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Literals shorter than this don't tell texts apart.
SHORT = 3


@dataclass(frozen=True)
class Pack:
    name: str
    extensions: tuple[str, ...] = ()  # with their dots; none: all files
    file_conventions: tuple[dict, ...] = ()
    source_patterns: tuple[dict, ...] = ()
    relationship_rules: tuple[dict, ...] = ()


@dataclass
class Rule:
    """A compiled pattern: its pack, what it makes, its literals (None: it is always tried)."""

    pack: Pack
    body: dict
    edge: bool
    regex: re.Pattern
    literals: frozenset[str] | None = field(default=None)


def literals(pattern: str) -> frozenset[str] | None:
    """Lower-case literals of which every match of the pattern holds one, ignoring case; None if there are no such of some length."""
    from re import _constants as code
    from re import _parser as parser

    def best(options: list[frozenset[str] | None]) -> frozenset[str] | None:
        known = [o for o in options if o]
        return max(known, key=lambda o: (min(map(len, o)), -len(o)), default=None)

    def of(parsed) -> frozenset[str] | None:
        options, run = [], ""

        def close():
            nonlocal run
            if len(run) >= SHORT:
                options.append(frozenset([run]))
            run = ""

        for op, value in parsed:
            low = chr(value).lower() if op is code.LITERAL else ""
            if len(low) == 1 and low.upper().lower() == low and low.isascii():
                run += low
                continue
            close()
            if op is code.SUBPATTERN:
                options.append(of(value[3]))
            elif op in (code.MAX_REPEAT, code.MIN_REPEAT, code.POSSESSIVE_REPEAT) and value[0] > 0:
                options.append(of(value[2]))
            elif op is code.ATOMIC_GROUP:
                options.append(of(value))
            elif op is code.BRANCH:
                each = [of(branch) for branch in value[1]]
                options.append(frozenset().union(*each) if all(each) else None)
        close()
        return best(options)

    return of(parser.parse(pattern))


def pack_of(name: str, body: dict, extensions: tuple[str, ...] = ()) -> Pack:
    part = lambda key: tuple(body.get(key) or ())
    return Pack(name, extensions, part("file_conventions"), part("source_patterns"), part("relationship_rules"))


def load_packs(spark: SparkSession, folder: str, extensions: dict[str, tuple[str, ...]]) -> tuple[list[Pack], list[str]]:
    """(packs, paths of files that can't be read) of <folder>/<language>/<sort>/<file>.yaml; extensions are those of each language.

    Packs are a reviewed set: their number doesn't grow with the texts.
    """
    import yaml

    packs, bad = [], []
    for path, content in spark.read.format("binaryFile").load(f"{folder.rstrip('/')}/*/*/*.y*ml").select("path", "content").orderBy("path").collect():
        language, sort, file = path.split("/")[-3:]
        try:
            pack = pack_of(f"{language}/{sort}/{file.rsplit('.', 1)[0]}", yaml.safe_load(bytes(content)) or {}, tuple(extensions.get(language, ())))
            compiled([pack])
            packs.append(pack)
        except (yaml.YAMLError, re.error, AttributeError, TypeError, KeyError):
            bad.append(path)
    return packs, bad


def compiled(packs: list[Pack]) -> list[Rule]:
    out = []
    for pack in packs:
        for bodies, edge in ((pack.source_patterns, False), (pack.relationship_rules, True)):
            out += [Rule(pack, b, edge, re.compile(b["pattern"], re.M), literals(b["pattern"])) for b in bodies]
    return out


class Matcher:
    """All rules over one text after another."""

    def __init__(self, rules: list[Rule]):
        import ahocorasick

        self.rules, self.always = rules, [i for i, r in enumerate(rules) if r.literals is None]
        self.words = ahocorasick.Automaton()
        needed: dict[str, list[int]] = {}
        for i, r in enumerate(rules):
            for word in r.literals or ():
                needed.setdefault(word, []).append(i)
        for word, which in needed.items():
            self.words.add_word(word, tuple(which))
        self.words.make_automaton()

    def tried(self, text: str) -> list[int]:
        """Rules that may match a text."""
        found = set(self.always)
        if len(self.words):
            for _, which in self.words.iter(lowered(text)):
                found.update(which)
        return sorted(found)


def lowered(text: str) -> str:
    """A-Z in lower case; other letters that ignoring case makes ASCII ones (K for the Kelvin sign, s for the long s) as those."""
    return text.translate(_LOWER)


_LOWER = {**{c: c + 32 for c in range(65, 91)}, 0x212A: "k", 0x17F: "s"}


def _name(match: re.Match, group: int | None) -> str:
    found = match.group(group or 0)
    return found if found is not None else ""


def _by_convention(path: str, convention: dict) -> str | None:
    """The name of the entity that a file is by its path, or None."""
    glob = convention.get("glob") or ""
    fits = fnmatch.fnmatchcase(path, glob) or glob.startswith("*/") and fnmatch.fnmatchcase(path, glob[2:]) or "/**/" in glob and fnmatch.fnmatchcase(path, glob.replace("/**/", "/"))
    if not glob or not fits or convention.get("name_from") == "class_name":
        return None
    parts = path.split("/")
    return (parts[-2] if len(parts) > 1 else "") if convention.get("name_from") == "parent_dir" else parts[-1].rsplit(".", 1)[0]


FOUND = "type string, path string, line int, pack string, kind string, name string, target_kind string, target string"


def extract(files: DataFrame, packs: list[Pack]) -> DataFrame:
    """(type, path, line, pack, kind, name, target_kind, target): entities and edges that the packs find in files(path, content).

    An entity has the kind and the name that its pattern or convention gives; an edge's kind is its relationship, its name and target are ``Kind:name`` of its
    ends. ``scope: file`` patterns see the whole text, others one line. Lines count from 1; a convention's entity is on line 0. A null text is empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(compiled(packs))
        by_extension = {p.name: p.extensions for p in packs}
        names = [c.split()[0] for c in FOUND.split(", ")]
        types = [pa.int32() if c.endswith(" int") else pa.string() for c in FOUND.split(", ")]
        for batch in batches:
            rows: list[tuple] = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                path, text = path or "", text or ""
                concerned = {name for name, ends in by_extension.items() if not ends or path.endswith(ends)}
                for pack in packs:
                    if pack.name in concerned:
                        for convention in pack.file_conventions:
                            name = _by_convention(path, convention)
                            if name is not None:
                                rows.append(("entity", path, 0, pack.name, convention.get("entity_type"), name, None, None))
                if not concerned:
                    continue
                for i in matcher.tried(text):
                    rule = matcher.rules[i]
                    if rule.pack.name not in concerned:
                        continue
                    for line, m in _matches(rule, text):
                        b = rule.body
                        if rule.edge:
                            rows.append(("edge", path, line, rule.pack.name, b.get("relationship"), f"{b.get('source_type')}:{_name(m, b.get('source_group'))}", b.get("target_type"), f"{b.get('target_type')}:{_name(m, b.get('target_group'))}"))
                        else:
                            rows.append(("entity", path, line, rule.pack.name, b.get("entity_type"), _name(m, b.get("name_group")), None, None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return files.select("path", "content").mapInArrow(run, FOUND)


def _matches(rule: Rule, text: str) -> Iterator[tuple[int, re.Match]]:
    """(line, match) of a rule's matches; in line scope only lines that hold one of its literals are tried."""
    if rule.body.get("scope", "file") == "file":
        line, at = 1, 0
        for m in rule.regex.finditer(text):
            line += text.count("\n", at, m.start())
            at = m.start()
            yield line, m
        return
    for i, line in enumerate(text.split("\n"), 1):
        if rule.literals is None or any(w in lowered(line) for w in rule.literals):
            for m in rule.regex.finditer(line):
                yield i, m


def first_matches(lines: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(path, line, rule, kind, match): the first match of each (rule, pattern, kind) in each text of lines(path, line, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = Pack("rules", source_patterns=tuple({"pattern": p} for _, p, _ in rules))
        matcher = Matcher(compiled([pack]))
        for batch in batches:
            at, which, found = [], [], []
            for row, text in enumerate(batch.column(2).to_pylist()):
                for i in matcher.tried(text) if text else ():
                    m = matcher.rules[i].regex.search(text)
                    if m:
                        at.append(row)
                        which.append(i)
                        found.append(m[0])
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array([rules[i][0] for i in which], pa.string()), pa.array([rules[i][2] for i in which], pa.string()), pa.array(found, pa.string())], names=["path", "line", "rule", "kind", "match"])

    line = lines.schema["line"].dataType.simpleString()
    return lines.select(F.col("path").cast("string"), "line", "text").mapInArrow(run, f"path string, line {line}, rule string, kind string, match string")
