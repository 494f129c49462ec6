"""The query surface: routers with closed sets of values, each of which names a registered query.

An unknown value is an error that suggests the nearest one. The result is a DataFrame; nothing runs until an action does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.plans import catalog

ROUTES: dict[str, dict[str, str]] = {
    "orient": {"overview": "orientation", "key_entities": "key_entities", "questions": "orientation_questions", "me": "repo_filter", "clusters": "communities_list", "topology": "topology_tiers", "modules": "module_aggregate", "stats": "graph_stats"},
    "find": {"bm25": "find", "entities": "find_entities", "substring": "search_entities"},
    "related": {"callers": "callers", "resolve": "find_callers", "callees": "callees", "neighbors": "neighbors", "uses": "callees", "used_by": "callers"},
    "subgraph": {"hops": "subgraph", "expand": "bfs"},
    "trace": {"path": "find_paths", "data": "data_flows", "control": "complexity", "def_use": "def_use", "effects": "effect_propagation", "flows": "event_flow", "process": "process_flows"},
    "endpoints": {"list": "http_link", "contract": "response_shape_diff", "posture": "auth_posture_diff"},
    "impact_radius": {"entity": "impact_radius", "changeset": "pr_impact"},
    "debt": {"dead_code": "dead_code", "find_dead_code": "find_dead_code", "cycles": "service_cycles", "import_cycles": "import_cycles", "stubs": "stub_detection", "impure": "pure_functions", "license": "license_compat"},
    "security": {"findings": "taint_findings", "secrets": "secrets", "auth_coverage": "auth_coverage"},
    "test": {"coverage": "test_coverage", "reachability": "test_reachability", "contract_effectiveness": "tautology", "coverage_effectiveness": "effectiveness"},
    "patterns": {"code": "code_patterns", "graph": "module_table", "template": "rule_pack"},
    "findings": {"list": "findings_list"},
    "diff": {"response_shape": "response_shape_diff", "payload": "payload_drift", "auth": "auth_posture_diff", "literals": "literal_parity", "refs": "diff_join"},
}


def distance(a: str, b: str) -> int:
    """Edit distance of two short strings."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        nxt = [i]
        for j, y in enumerate(b, 1):
            nxt.append(min(row[j] + 1, nxt[-1] + 1, row[j - 1] + (x != y)))
        row = nxt
    return row[-1]


def checked(value: str, allowed) -> str:
    """The value if it is allowed; else an error that names the nearest one."""
    if value in allowed:
        return value
    best = min(sorted(allowed), key=lambda a: distance(value.lower(), a))
    hint = f"; did you mean {best!r}?" if 3 * distance(value.lower(), best) <= max(len(value), len(best)) else ""
    raise ValueError(f"{value!r} is none of {', '.join(sorted(allowed))}{hint}")


def call(spark: SparkSession, sf_dir: str, router: str, value: str, fields: list[str] | None = None) -> DataFrame:
    """The query behind one value of a router, with only the fields asked for."""
    name = ROUTES[checked(router, ROUTES)][checked(value, ROUTES[router])]
    out = catalog.queries()[name](spark, sf_dir)
    return out.select(*[c for c in out.columns if c in fields]) if fields else out
