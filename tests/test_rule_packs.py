"""Rule packs: one pass over the texts, equal to trying every pattern on every text."""

import random
import re

import pytest

from graphloom.sources import readers, rules

PATTERNS = [
    r"@(\w+)\.route\s*\(\s*[\"']([^\"']+)[\"']", r"class\s+(\w+)\(.*Model\)", r"(?i)create\s+table\s+(\w+)", r"(get|post|delete)Mapping", r"\d+", r"x?yz*abc+", r"(foo|b)ar", r"[A-Z]{2,}", r"(?:import|from)\s+(\w+)",
    r"(?i:KeyError)", r"a.b", r"(?=lookahead)look", r"(?!no)yes", r"(ab){2,3}", r"(ab)*", r"\bword\b", r"tail$", r"^head", r"s[tT]raße", r"(?i)straße",
]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_every_match_holds_one_of_the_literals(pattern):
    needed, regex = rules.literals(pattern), re.compile(pattern, re.M)
    rng = random.Random(1)
    pieces = ["@app.route('/x')", "class A(db.Model)", "CREATE  table t", "postMapping", "12", "yabcc", "xyzzabc", "foobar", "bar", "AB", "import os", "from x", "keyerror", "KEYERROR", "Keyerror", "axb", "look", "lookahead", "yes", "abab", "word", "tail", "head", "straße", "STRAßE", "ſtraße", "\n", " "]
    for _ in range(400):
        text = "".join(rng.choices(pieces, k=rng.randrange(6)))
        if regex.search(text):
            assert needed is None or any(w in rules.lowered(text) for w in needed), text


def test_literals_are_found_and_not_invented():
    assert rules.literals(r"@(\w+)\.route\s*\(") == {".route"}
    assert rules.literals(r"(get|post|delete)Mapping") == {"mapping"}
    assert rules.literals(r"(alpha|beta)\d") == {"alpha", "beta"}
    assert rules.literals(r"(alpha|\d)") is None and rules.literals(r"(abc)?d+") is None and rules.literals("ab") is None


def corpus(n=60):
    rng = random.Random(2)
    words = ["@app.route('/a')", "class User(Model)", "create table users", "getMapping", "import sys", "word", "\n", "x", "12", "KeyError", "foobar", "tail\n", "\nhead"]
    return [(f"src/m{i}.{rng.choice(['py', 'sql', 'txt'])}", " ".join(rng.choices(words, k=rng.randrange(40)))) for i in range(n)]


def brute(files, packs):
    out = []
    for path, text in files:
        for pack in packs:
            if pack.extensions and not path.endswith(pack.extensions):
                continue
            for bodies, edge in ((pack.source_patterns, False), (pack.relationship_rules, True)):
                for b in bodies:
                    parts = [(1, text)] if b.get("scope", "file") == "file" else list(enumerate(text.split("\n"), 1))
                    for first, part in parts:
                        for m in re.compile(b["pattern"], re.M).finditer(part):
                            line = first + part[: m.start()].count("\n")
                            name = lambda g: m.group(b.get(g) or 0) or ""
                            if edge:
                                out.append(("edge", path, line, pack.name, b["relationship"], f"{b['source_type']}:{name('source_group')}", b["target_type"], f"{b['target_type']}:{name('target_group')}"))
                            else:
                                out.append(("entity", path, line, pack.name, b["entity_type"], name("name_group"), None, None))
    return sorted(out, key=repr)


def test_extract_equals_every_pattern_on_every_text(spark):
    scope = ["file", "line"]
    packs = [rules.Pack(f"p{k}", [(".py",), (".sql", ".py"), ()][k], (), tuple({"pattern": p, "entity_type": f"T{i}", "scope": scope[(i + k) % 2]} for i, p in enumerate(PATTERNS)), ({"pattern": r"(import|class) (\w+)", "source_type": "S", "target_type": "T", "relationship": "USES", "source_group": 1, "target_group": 2},)) for k in range(3)]
    files = [*corpus(), ("none.py", None), ("empty.py", "")]
    got = rules.extract(spark.createDataFrame(files, "path string, content string"), packs)
    assert sorted(map(tuple, got.collect()), key=repr) == brute([(p, t or "") for p, t in files], packs)


def test_five_hundred_rules_are_one_scan(spark, tmp_path):
    spark.createDataFrame([(f"f{i}.py", i, f"call_{i % 700}(x)") for i in range(2000)], "path string, line int, text string").write.parquet(str(tmp_path / "lines"))
    lines = spark.read.parquet(str(tmp_path / "lines"))
    table = spark.createDataFrame([(f"r{i}", rf"call_{i}\(", "call") for i in range(500)], "rule string, pattern string, kind string")
    got = readers.apply_rules(lines, table)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "Union" not in plan
    assert sorted((r.path, r.rule) for r in got.collect()) == sorted((f"f{i}.py", f"r{i % 700}") for i in range(2000) if i % 700 < 500)


def test_packs_are_read_and_bad_ones_named(spark, tmp_path):
    yaml = pytest.importorskip("yaml")
    folder = tmp_path / "rules" / "python" / "frameworks"
    folder.mkdir(parents=True)
    body = {"file_conventions": [{"glob": "*/models/*.py", "entity_type": "Model", "name_from": "filename"}, {"glob": "app/*/views.py", "entity_type": "View", "name_from": "parent_dir"}, {"glob": "*.py", "entity_type": "Any", "name_from": "class_name"}], "source_patterns": [{"pattern": r"route\('([^']+)'\)", "entity_type": "Route", "name_group": 1, "scope": "line"}]}
    (folder / "web.yaml").write_text(yaml.safe_dump(body))
    (folder / "broken.yaml").write_text("a: [1")
    (folder / "wrong.yml").write_text(yaml.safe_dump({"source_patterns": [{"pattern": "("}]}))
    (tmp_path / "rules" / "python" / "language.yaml").write_text("x: 1")
    packs, bad = rules.load_packs(spark, str(tmp_path / "rules"), {"python": (".py",)})
    assert [p.name for p in packs] == ["python/frameworks/web"] and sorted(b.split("/")[-1] for b in bad) == ["broken.yaml", "wrong.yml"]
    files = spark.createDataFrame([("src/models/user.py", "x\nroute('/u')"), ("models/top.py", ""), ("app/shop/views.py", "route('/a') route('/b')"), ("app/shop/views.js", "route('/a')")], "path string, content string")
    got = sorted((r.path, r.line, r.kind, r.name) for r in rules.extract(files, packs).collect())
    assert got == [("app/shop/views.py", 0, "View", "shop"), ("app/shop/views.py", 1, "Route", "/a"), ("app/shop/views.py", 1, "Route", "/b"), ("models/top.py", 0, "Model", "top"), ("src/models/user.py", 0, "Model", "user"), ("src/models/user.py", 2, "Route", "/u")]
    assert rules.extract(files.limit(0), packs).count() == rules.extract(files, []).count() == 0
