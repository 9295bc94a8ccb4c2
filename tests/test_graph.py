import random

import pytest
from pyspark.sql import functions as F

from arborlens import fixed_values as V
from arborlens.operators import graph


def docs(spark, files):
    rows = [(repo, path, text) for repo, tree in files.items() for path, text in tree.items()]
    return spark.createDataFrame(rows, "repo_id string, relative_path string, content string")


def edges(spark, tree, **options):
    return {(r["src"], r["dst"]) for r in graph.edges(docs(spark, {"r": tree}), **options).collect()}


PYTHON = [
    # (file, statement, other files, target)
    ("src/main.py", "import utils", ["src/utils.py"], "src/utils.py"),
    ("src/main.py", "import utils", ["src/utils/__init__.py"], "src/utils/__init__.py"),
    ("src/main.py", "import utils.helpers", ["src/utils/helpers.py"], "src/utils/helpers.py"),
    ("src/main.py", "from .helpers import x", ["src/helpers.py"], "src/helpers.py"),
    ("src/main.py", "from ..helpers import x", ["helpers.py"], "helpers.py"),
    ("main.py", "import os", [], None),
    ("main.py", "import nonexistent", ["other.py"], None),
    ("src/main.py", "import utils", ["src/utils.py", "src/utils/__init__.py"], "src/utils/__init__.py"),
    ("src/main.py", "import utils", ["lib/utils.py", "src/utils.py"], "src/utils.py"),
    ("src/main.py", "from src.utils import helper", ["src/utils.py"], "src/utils.py"),
    ("src/main.py", "import deep.mod", ["b/deep/mod.py", "a/deep/mod.py", "a/deep/mod/__init__.py"], "a/deep/mod/__init__.py"),
    ("src/main.py", "import deep.mod", ["b/deep/mod/__init__.py", "a/deep/mod.py"], "a/deep/mod.py"),
    ("src/main.py", "from . import helper", ["src/helper.py", "helper.py"], "src/helper.py"),
    ("a/b/c.py", "from ... import top", ["top.py"], "top.py"),
    ("a/b/c.py", "from .... import top", ["top.py"], "top.py"),
    ("src/main.py", "import _private", ["src/_private.py"], None),
    ("src/main.py", "from .x.y import z", ["src/x/y.py"], "src/x/y.py"),
    ("src/main.py", "import main", [], None),
]


@pytest.mark.parametrize("row", range(len(PYTHON)))
def test_python_resolution(spark, row):
    path, statement, others, target = PYTHON[row]
    tree = {path: statement + "\n"} | {o: "x = 1\n" for o in others}
    assert edges(spark, tree) == ({(path, target)} if target else set())


def test_script_resolution(spark):
    cases = {
        "./utils": (["src/utils.js"], "src/utils.js"), "./utils.js": (["src/utils.js"], "src/utils.js"),
        "./utils/": (["src/utils/index.js"], "src/utils/index.js"), "lodash": (["src/lodash.js"], None),
        "node_modules/lodash": (["node_modules/lodash.js"], None), "../config.js": (["config.js", "src/config.js"], "config.js"),
        "./a": (["src/a.ts", "src/a.js", "src/a/index.js"], "src/a.js"), "./a?raw#x": (["src/a.tsx"], "src/a.tsx"),
        "../../up": (["up.js"], None), ".": (["src/index.mjs"], "src/index.mjs"), "./data.json": (["src/data.json"], "src/data.json"),
        "./x/../y/./z": (["src/y/z.cjs"], "src/y/z.cjs"), "..": (["index.ts"], "index.ts"), "./a.js": (["src/a.js.ts", "src/a.js"], "src/a.js"),
    }
    files = {f"r{i}": {"src/main.js": f"import q from '{spec}'\n"} | {o: "1" for o in others}
             for i, (spec, (others, _)) in enumerate(cases.items())}
    found = {r["repo_id"]: r["dst"] for r in graph.edges(docs(spark, files)).collect() if r["src"] == "src/main.js"}
    assert found == {f"r{i}": t for i, (_, t) in enumerate(cases.values()) if t}


def test_package_roots_can_be_left_out(spark):
    tree = {"src/main.py": "import deep.mod\nimport near\n", "b/deep/mod.py": "1", "src/near.py": "1"}
    assert edges(spark, tree, package_roots=False) == {("src/main.py", "src/near.py")}


def test_repositories_do_not_mix(spark):
    found = graph.edges(docs(spark, {"a": {"m.py": "import n\n"}, "b": {"n.py": "1"}})).collect()
    assert found == []


def test_mixed_tree_and_nodes(spark):
    tree = {"main.py": "import os\n", "index.js": "import a from './data.json'\n", "README.md": "# x", "data.json": "{}", "empty.py": "", "t.PY": "x"}
    links = graph.links(docs(spark, {"r": tree}))
    found = {r["path"]: r["language"] for r in graph.nodes(links).collect()}
    assert found == {"main.py": "python", "index.js": "javascript", "data.json": None, "t.PY": "python"}


def links(spark, pairs, alone=()):
    rows = [("r", s, d) for s, d in pairs] + [("r", x, None) for x in {s for s, _ in pairs} | set(alone)]
    return spark.createDataFrame(rows, "repo_id string, src string, dst string")


def paths(rows):
    return sorted(r["path"] for r in rows.collect())


def test_questions(spark):
    degree = graph.degrees(links(spark, [("a", "b"), ("c", "b")], alone=["d"]))
    assert paths(graph.entry_points(degree)) == ["a", "c", "d"]
    assert paths(graph.leaves(degree)) == ["b"]
    assert paths(graph.isolated(degree)) == ["d"]
    stats = graph.statistics(degree, ["repo_id"]).first().asDict()
    assert stats == {"repo_id": "r", "total_files": 4, "total_dependencies": 2, "entry_points": 3, "isolated_files": 1,
                     "leaf_modules": 1, "avg_dependencies_per_file": 0.5, "max_incoming_count": 2}
    core = graph.core_modules(graph.degrees(links(spark, [("a", "c"), ("b", "c"), ("d", "c")])), 2).collect()
    assert [(r["path"], r["incoming"], r["rank"]) for r in core] == [("c", 3, 1)]


def test_empty_graph(spark):
    degree = graph.degrees(links(spark, []))
    assert graph.entry_points(degree).count() == 0 and graph.overview(degree).count() == 0
    assert list(graph.statistics(degree).first()) == [0, 0, 0, 0, 0, 0.0, 0]


def test_neighbours(spark):
    edge = graph.edges_of(links(spark, [("a", "b"), ("a", "c"), ("b", "b")]))
    assert sorted(r["dst"] for r in graph.dependencies(edge, "r", "a").collect()) == ["b", "c"]
    assert sorted(r["src"] for r in graph.dependents(edge, "r", "b").collect()) == ["a"]
    assert graph.neighbours(edge).where("kind = 'dependent'").count() == 2


def test_overview_text(spark):
    pairs = [(f"s/e{i:02}", "lib/core") for i in range(12)] + [("lib/core", "x/base")]
    text = graph.overview(graph.degrees(links(spark, pairs))).first()["overview"]
    entries = "".join(f"- `e{i:02}`\n" for i in range(10))
    assert text == (
        "## Dependency Overview\n### Core Modules\nFiles most depended on by other modules:\n- `core` (12 incoming dependencies)\n"
        "- `base` (1 incoming dependencies)\n\n### Entry Points\nFiles with no incoming dependencies:\n" + entries +
        "- ... and 2 more\n\n### Dependency Statistics\n- **Total files analyzed**: 14\n- **Total dependencies**: 13\n"
        "- **Entry points**: 12\n- **Isolated files**: 0\n- **Leaf modules**: 1\n- **Avg dependencies per file**: 0.9\n")


def test_append_section_once(spark):
    section = F.lit(V.OVERVIEW_HEADING + "\nbody\n")
    once = graph.append_section(F.lit("# Title\n\n \t"), section)
    row = spark.range(1).select(once.alias("a"), graph.append_section(once, section).alias("b"),
                                graph.append_section(F.lit("x "), F.lit("")).alias("c")).first()
    assert row["a"] == "# Title\n\n## Dependency Overview\nbody\n" and row["b"] == row["a"] and row["c"] == "x "


def test_one_content_scan_and_no_wide_joins(spark, tmp_path):
    """The text column is read by one scan, and no join runs without keys."""
    path = str(tmp_path / "docs")
    docs(spark, {"r": {"a.py": "import b\n", "b.py": "1"}}).write.parquet(path)
    plan = graph.degrees(graph.links(spark.read.parquet(path)))._jdf.queryExecution().executedPlan().toString()
    reads = [line.split("ReadSchema:")[1] for line in plan.split("\n") if "FileScan" in line]
    assert len([r for r in reads if "content" in r]) == 1 and len(reads) == 2
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_top_n_is_cut_before_the_shuffle(spark):
    degree = graph.degrees(links(spark, [("a", "b")]))
    for rows in (graph.core_modules(degree, 3), graph.overview(degree)):
        assert "Partial" in [line for line in rows._jdf.queryExecution().executedPlan().toString().split("\n")
                             if "WindowGroupLimit" in line][-1]


def test_against_a_plain_resolver(spark):
    """Random trees: the joined result equals trying every candidate in turn."""
    rng = random.Random(7)
    names = ["a", "b", "c"]
    for _ in range(3):
        tree = {}
        for _ in range(30):
            where = "/".join(rng.choice(names) for _ in range(rng.randint(0, 3)))
            name = rng.choice(["a.py", "b.py", "c.py", "__init__.py", "a.js", "b.ts", "index.js", "c.mjs"])
            full = f"{where}/{name}" if where else name
            if name.endswith(".py"):
                mod = ".".join(rng.choice(names) for _ in range(rng.randint(1, 2)))
                tree[full] = f"from {'.' * rng.randint(0, 4)}{mod} import z\n"
            else:
                spec = rng.choice(["./", "../", "../../"]) + "/".join(rng.choice(names) for _ in range(rng.randint(0, 2)))
                tree[full] = f"import z from '{spec}'\n"
        assert edges(spark, tree) == plain_edges(tree)


def plain_edges(tree):
    roots = sorted({"/".join(p.split("/")[:i]) for p in tree for i in range(len(p.split("/")))})
    under = lambda base, rest: f"{base}/{rest}" if base else rest
    found = set()
    for path, text in tree.items():
        home = path.rpartition("/")[0]
        if path.endswith(".py"):
            module = text.split()[1]
            tail = module.lstrip(".")
            dots = len(module) - len(tail)
            tail = tail.replace(".", "/")
            up = home.split("/")
            base = home if dots < 2 else "/".join(up[:max(len(up) - dots + 1, 0)])
            bases = [base] + (roots if dots == 0 else [])
            tries = [under(b, tail) + end for b in bases for end in ("/__init__.py", ".py")]
        else:
            parts, ok = [], True
            for part in (home + "/" + text.split("'")[1]).split("/"):
                if part == "..":
                    ok = ok and bool(parts)
                    parts = parts[:-1]
                elif part not in ("", "."):
                    parts.append(part)
            stem = "/".join(parts)
            tries = [stem + e for e in V.SCRIPT_ENDINGS] + [under(stem, i) for i in V.SCRIPT_INDEXES] if ok else []
        target = next((t for t in tries if t in tree), None)
        if target and target != path:
            found.add((path, target))
    return found
