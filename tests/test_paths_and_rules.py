import fnmatch
import os.path
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from arborlens import fixed_values as V
from arborlens.functions import content, globs, ignore, paths, rules
from arborlens.operators import select


def test_names_endings_and_ancestors(values):
    names = ["a.py", "X.PY", ".py", "foo.", "..a", ".a.b", "a.tar.gz", "noext", "...x.y", "_h.py"]
    assert values(paths.extension, "string", *names) == [os.path.splitext(n)[1].lower() for n in names]
    assert values(paths.ancestors, "string", "a/b/c.py", "top") == [["a", "a/b"], []]
    assert values(paths.parent, "string", "a/b/c.py", "a/b", "top") == ["a/b", "a", ""]
    assert values(paths.normalise, "string", " A\\B.py\t", "x") == ["a/b.py", "x"]


def test_repository_name_and_source_kind(values):
    urls = ["https://github.com/u/repo.git", "https://github.com/u/repo", "https://github.com/u/repo/",
            "https://github.com/u/repo.git/", "https://github.com/u/repo///"]
    assert values(paths.repository_name, "string", *urls) == ["repo"] * 5
    assert values(paths.source_kind, "string", urls[0], "/data/x", "http://github.com/x") == ["remote", "local", "local"]


def test_globs_agree_with_the_standard_library():
    names = ["a.py", "b/a.py", "a[1].x", "src/x", "é.md", "a]b", "a^b", "a-b", "axb", "a\\b", "a&&b", "a.b.c"]
    patterns = ["*.py", "src/*", "a[[]1].x", "a[!x]b", "a[]]b", "a[^x]b", "a[a-z]b", "?.md", "a[", "a[z-a]b", "*a*b*",
                "a[&&]*", "a[\\]b", "a[!]x]b", "a[-]b", "[!z-a].py"]
    for pattern in patterns:
        ours = re.compile(r"(?s)\A(?:" + globs.glob_regex(pattern) + r")\Z")
        for name in names:
            assert bool(ours.match(name)) == fnmatch.fnmatchcase(name, pattern), (pattern, name)


@settings(max_examples=300, deadline=None)
@given(st.text("ab[]!-*?.^", max_size=8), st.text("ab[]!-.^", max_size=6))
def test_globs_agree_on_random_patterns(pattern, name):
    ours = re.compile(r"(?s)\A(?:" + globs.glob_regex(pattern) + r")\Z")
    assert bool(ours.match(name)) == fnmatch.fnmatchcase(name, pattern)


def _reasons(spark, files, **options):
    rows = spark.createDataFrame(files, "relative_path string, length bigint")
    max_kb = options.pop("max_kb", V.DEFAULT_MAX_KB)
    reason = rules.file_reason(F.col("relative_path"), F.col("length"), max_kb=max_kb, **options)
    return {r["relative_path"]: r["r"] for r in rows.withColumn("r", reason).collect()}


def test_rule_order(spark):
    both = _reasons(spark, [("package.json", 1)], include=["*.json"], exclude=["package.json"])
    assert both == {"package.json": V.EXCLUDED}
    assert _reasons(spark, [("package-lock.json", 1)], include=["*.json"]) == {"package-lock.json": V.PROTECTED}
    assert _reasons(spark, [("package-lock.json", 1)], include=["package-lock.json"]) == {"package-lock.json": None}
    exact = ["frontend/package-lock.json"]
    assert _reasons(spark, [("frontend/package-lock.json", 1), ("b/package-lock.json", 1)], include=exact) == {
        "frontend/package-lock.json": None, "b/package-lock.json": V.PROTECTED}
    nested = _reasons(spark, [("src/app.py", 1), ("src/private/secret.py", 1)], include=["src/*"], exclude=["src/private/*"])
    assert nested == {"src/app.py": None, "src/private/secret.py": V.EXCLUDED}
    assert _reasons(spark, [("a.json", 1), ("x/.env", 1), ("pkg/a.py", 1), ("a.egg-info/b.py", 1), ("xpkg/a.py", 1)]) == {
        "a.json": V.DEFAULT_IGNORED, "x/.env": V.DEFAULT_IGNORED, "pkg/a.py": V.DEFAULT_IGNORED,
        "a.egg-info/b.py": V.DEFAULT_IGNORED, "xpkg/a.py": None}


def test_default_ignored_agrees_with_a_plain_reading(values):
    cases = ["a.py", ".json", "x/.json", "a.json/b", "build", "builds", "a/build/c", ".env", "b.env", "..log", ".a.log",
             "src/generated/prisma", "src/generated/prisma/x.ts", "xsrc/generated/prisma/x.ts", "q.egg-info", "A.bin", "bin",
             "vendor/bundle", "a.tar.gz", "a/.txt.md", "__init__.py", "x/__init__.py"]

    def plain(path):
        name = path.rsplit("/", 1)[-1]
        padded = f"/{path}/"
        return (name in V.IGNORED_FILES or os.path.splitext(name)[1] in V.IGNORED_EXTENSIONS
                or any(f"/{d}/" in padded for d in V.IGNORED_DIRS if "*" not in d)
                or any(p.endswith(".egg-info") for p in path.split("/")))

    lowered = [c.lower() for c in cases]
    assert values(rules.default_ignored, "string", *lowered) == [plain(c) for c in lowered]


def test_size_limit(spark):
    edge = _reasons(spark, [("a.py", 204_800), ("b.py", 204_801), ("c.py", None)])
    assert edge == {"a.py": None, "b.py": V.TOO_LARGE, "c.py": V.SIZE_UNKNOWN}
    assert _reasons(spark, [("empty.py", 0), ("small.py", 1)], max_kb=0) == {"empty.py": None, "small.py": V.TOO_LARGE}
    assert _reasons(spark, [("big.py", 10_000_000)], max_kb=None) == {"big.py": None}
    with pytest.raises(ValueError, match="non-negative"):
        _reasons(spark, [("a.py", 1)], max_kb=-1)
    detail = spark.range(1).select(rules.size_detail(F.lit(204_801), 200)).first()[0]
    assert detail == "204801 B > 204800 B limit"


def _judged(spark, names, **options):
    rows = spark.createDataFrame([("r", n, 10) for n in names], "repo_id string, relative_path string, length bigint")
    return select.judge(rows, **options)


def test_pruning_hides_everything_below_the_topmost_rejected_directory(spark):
    names = ["main.py", "node_modules/package.json", "node_modules/a/b/build/x.py", "src/build/x.py", "src/a.json/x.py",
             "docs/guide.md", "Docs2/x.md"]
    judged = _judged(spark, names, include=["node_modules/a/*"], exclude=["docs"])
    found = {r["relative_path"]: (r["pruned_dir"], r["reason_code"]) for r in judged.collect()}
    assert found == {
        "main.py": (None, None),
        "node_modules/package.json": ("node_modules", V.DEFAULT_IGNORED),
        "node_modules/a/b/build/x.py": ("node_modules", V.DEFAULT_IGNORED),
        "src/build/x.py": ("src/build", V.DEFAULT_IGNORED),
        "src/a.json/x.py": ("src/a.json", V.DEFAULT_IGNORED),
        "docs/guide.md": ("docs", V.EXCLUDED),
        "Docs2/x.md": (None, None),
    }
    pruned = {r["relative_path"] for r in select.pruned_directories(judged).collect()}
    assert pruned == {"node_modules/", "src/build/", "src/a.json/", "docs/"}


def test_include_of_a_directory_itself_brings_it_back(spark):
    judged = _judged(spark, ["build/x.py", "build/y.json"], include=["build", "build/*"])
    assert {r["relative_path"]: r["reason_code"] for r in judged.collect()} == {"build/x.py": None, "build/y.json": None}


def test_pruning_agrees_with_a_walk_of_every_directory(spark):
    import itertools
    parts = ["src", "build", "a.json", "x.egg-info", ".git", "docs", "B", "env ", "yarn.lock"]
    names = ["/".join(p) + "/f.py" for n in (1, 2, 3) for p in itertools.product(parts, repeat=n)]
    for include, exclude in (([], []), (["build"], ["do*", "*/b"]), (["*"], ["src/*/docs"]), (["src/build"], ["[.]git"])):
        judged = {r["relative_path"]: r["pruned_dir"] for r in _judged(spark, names, include=include, exclude=exclude).collect()}
        # Verdict of each directory on its own, then the first one from the top.
        dirs = sorted({"/".join(n.split("/")[:i]) for n in names for i in range(1, len(n.split("/")))})
        rows = spark.createDataFrame([(d,) for d in dirs], "d string")
        bad = {r["d"] for r in rows.where(
            rules.name_reason(paths.normalise(F.col("d")), include, exclude).isNotNull()).collect()}
        for name, pruned in judged.items():
            above = ["/".join(name.split("/")[:i]) for i in range(1, len(name.split("/")))]
            assert pruned == next((d for d in above if d in bad), None), (name, include, exclude)


IGNORE_CASES = [
    ("node_modules/\nbuild/", {"src/app.py": False, "node_modules/pkg/index.js": True, "build/out.bin": True, "a/build/x": True, "build": False}),
    ("*.log\n*.tmp", {"main.py": False, "debug.log": True, "a/b/temp.tmp": True, "src": False}),
    ("src/generated/prisma/", {"src/utils.py": False, "src/generated/prisma/schema.ts": True, "x/src/generated/prisma/a": False}),
    ("*.log\n!keep.log", {"keep.log": False, "a/keep.log": False, "b.log": True}),
    ("/top.txt\na/**/z\n**/deep", {"top.txt": True, "x/top.txt": False, "a/z": True, "a/b/c/z": True, "q/deep/x": True, "deep": True}),
    ("foo/**\n\\#x\n# note\n\n\\!y", {"foo": False, "foo/a/b": True, "#x": True, "!y": True, "# note": False}),
    ("a?c\n[a-c].md\n[!x].txt\nt\\ \nu  ", {"abc": True, "a/c": False, "b.md": True, "d.md": False, "x.txt": False, "y.txt": True, "t ": True, "t": False, "u": True}),
    ("doc/*.txt\n*/x.c", {"doc/a.txt": True, "doc/b/a.txt": False, "e/doc/a.txt": False, "q/x.c": True, "q/r/x.c": False}),
]


@pytest.mark.parametrize("text, expected", IGNORE_CASES)
def test_ignore_rules(values, text, expected):
    parsed = ignore.parse_rules(text.split("\n"))
    assert values(lambda p: ignore.ignored_by(p, parsed), "string", *expected) == list(expected.values())
    matcher = ignore.Matcher(text.split("\n"))
    assert [matcher.ignored(p) for p in expected] == list(expected.values())


def test_compiled_rules_agree_with_the_regular_expressions():
    import random
    import re

    draw = random.Random(5)
    parts = ["a", "b", "ab", "*", "a*", "?", "**", "[ab]", "[!a]", "\\*", "a.b", "*.b"]
    names = ["a", "b", "ab", "abc", "*", "a.b", "x.b", "c"]
    for _ in range(600):
        lines = [draw.choice(["", "", "!"]) + draw.choice(["", "", "/"]) + "/".join(draw.choices(parts, k=draw.randrange(1, 4))) + draw.choice(["", "", "/"])
                 for _ in range(draw.randrange(1, 5))]
        matcher, plain = ignore.Matcher(lines), [(re.compile(r.regex.replace(r"\z", r"\Z")), r.ignored) for r in ignore.parse_rules(lines)]

        def verdict(path):
            return next((ignored for regex, ignored in reversed(plain) if regex.match(path)), False)

        for _ in range(12):
            path = draw.choices(names, k=draw.randrange(1, 5))
            assert matcher.ignored("/".join(path)) == verdict("/".join(path)), (lines, path)
            above = ["/".join(path[:i]) for i in range(1, len(path) + 1)]
            assert matcher.directory("/".join(path)).ignored_dir == next((d for d in above if verdict(d) or verdict(d + "/")), None), (lines, path)


def test_lines_of_each_repository_judge_its_own_paths(spark):
    files = [(repo, f"d{i % 4}/{'gen/' if i % 3 else ''}f{i}.{'md' if i % 2 else 'py'}", i) for repo in ("a", "b", "none", None) for i in range(40)]
    lines = {"a": ["*.md", "!f7.md", "gen/"], "b": ["d1", "/d2/*"], "other": ["*"]}
    table = spark.createDataFrame([(r, i, x) for r, v in lines.items() for i, x in enumerate(v)], "repo_id string, ord int, pattern string")
    names = spark.createDataFrame(files, "repo_id string, relative_path string, length bigint")
    for rows in (3, 1000):
        found = select.with_ignore_verdicts(names, table, rows_per_task=rows).collect()
        assert len(found) == len(files)
        for r in found:
            matcher = ignore.Matcher(lines.get(r["repo_id"], []))
            assert (r["_ignored"], r["_ignored_dir"]) == (
                matcher.ignored(r["relative_path"]), matcher.directory(r["relative_path"].rpartition("/")[0]).ignored_dir)
    judged = select.judge(names, ["*"], ["d0/gen"], None, table)
    reasons = {(r["repo_id"], r["relative_path"]): (r["pruned_dir"], r["reason_code"]) for r in judged.collect()}
    assert reasons[("a", "d0/gen/f4.py")] == ("d0/gen", V.EXCLUDED) and reasons[("a", "d1/gen/f1.md")] == ("d1/gen", V.GITIGNORED)
    assert reasons[("b", "d1/gen/f1.md")] == ("d1", V.GITIGNORED) and reasons[("none", "d1/gen/f1.md")] == (None, None)
    assert select.with_ignore_verdicts(names.limit(0), table).count() == 0 and select.with_ignore_verdicts(names, table.limit(0)).count() == len(files)
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert "_lines" in plan and "RLIKE(relative_path" not in plan


def test_ignored_directories(spark, values):
    parsed = ignore.parse_rules(["build/", "*.log"])
    verdict = lambda p: ignore.directory_ignored(p, lambda q: ignore.ignored_by(q, parsed))
    assert values(verdict, "string", "build", "src", "a/build", "x.log") == [True, False, True, True]
    judged = _judged(spark, ["build2/a.py", "gen/x/a.py", "b.md"], ignore_rules=ignore.parse_rules(["gen/", "*.md"]))
    assert {r["relative_path"]: (r["pruned_dir"], r["reason_code"]) for r in judged.collect()} == {
        "build2/a.py": (None, None), "gen/x/a.py": ("gen", V.GITIGNORED), "b.md": (None, V.GITIGNORED)}


def test_binary_content(values):
    cases = {
        b"\x89PNG\r\n\x1a\nrest": True, b"\xff\xd8\xff\xe0": True, b"GIF89a..": True, b"%PDF-1.4": True,
        b"PK\x03\x04zip": True, b"text\x00more": True, bytes.fromhex("DEADBEEFCAFEBABE1337"): True, b"hello": False,
        "你好 мир".encode(): False, b"": False, b"BMW is a car": True, b"SQLite format 3": False,
        b"a" * 8191 + "é".encode(): False, b"a" * 8191 + b"\xc3": True, b"a" * 8192 + b"\x00": False,
        b"a" * 8191 + b"\xff" + b"b": True, b"a" * 100 + b"\xc3": True,
    }
    found = values(lambda c: content.is_binary(c), "binary", *map(bytearray, cases))
    assert found == list(cases.values())


def test_decode_and_sample(values):
    texts = values(content.decode, "binary", bytearray(b"a\r\nb\rc\n"), bytearray(b"\xbe\xef"), bytearray(b""))
    assert texts == ["a\nb\nc\n", None, ""]
    raw = ["é".encode() + b"\xff" + "�".encode() + b"x", b"a\x00", b"a" * 8191 + "é".encode(), b"ok", b"\xe2\x82x\xf0\x9f"]
    found = values(content.language_sample, "binary", *map(bytearray, raw))
    expected = [None if b"\x00" in r[:8192] else r[:8192].decode("utf-8", "ignore") for r in raw]
    assert found == expected


def test_sizes_tokens_hashes(values):
    import hashlib
    sizes = [0, 1023, 1024, 1280, 1331, 1048575, 1048576, 430592, 123456789]

    def plain(n):
        return f"{n} B" if n < 1024 else f"{n / 1024:.1f} KB" if n < 1048576 else f"{n / 1048576:.1f} MB"

    assert values(content.format_size, "bigint", *sizes) == [plain(n) for n in sizes]
    assert values(content.tokens, "string", "a" * 14, "b" * 27, "", "日本語日本語") == [4, 9, 1, 2]
    assert values(content.content_hash, "string", "é") == [hashlib.sha256("é".encode()).hexdigest()]
    tenths = [0.05, 0.15, 0.25, 0.35, 0.75, 1.45, 2.5, 1234.25, 7 / 20, 1 / 3]
    assert values(content.tenths, "double", *tenths) == [f"{x:.1f}" for x in tenths]
