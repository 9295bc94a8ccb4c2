import os

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from arborlens.operators import manifest, report, tree
from arborlens.plans.traverse import traverse, traverse_folders
from arborlens.sources import corpus, ignore_files, sinks

TREE = {
    "README.md": "# x\n", "src/main.py": "import os\r\n", "src/_h.py": "1", ".eslintrc.js": "x", ".github/x/ci.yml": "a: b",
    "docs/guide.md": "g", ".gitignore": "*.log\n", "src/debug.log": "l", "node_modules/a/b/c.js": "1", "_private/__init__.py": "",
    "deep/" + "/".join(f"level{i}" for i in range(10)) + "/leaf.py": "leaf", "ünïcode dir/ñ.py": "x", "empty.py": "",
}


@pytest.fixture
def root(tmp_path):
    for name, text in TREE.items():
        path = tmp_path / "repo" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, newline="")
    return str(tmp_path / "repo")


@pytest.mark.parametrize("units", [1, 5, 200])
def test_scan_lists_every_name(spark, root, units):
    rows = corpus.scan(spark, {"r": root}, units=units).collect()
    files = {r["relative_path"]: r["length"] for r in rows if not r["is_dir"]}
    assert files == {n: len(t.encode()) for n, t in TREE.items()} and len(rows) == len({r["relative_path"] for r in rows})
    dirs = {os.path.relpath(os.path.join(p, d), root) for p, ds, _ in os.walk(root) for d in ds}
    assert {r["relative_path"] for r in rows if r["is_dir"]} == dirs
    times = {r["relative_path"]: r["modification_time"] for r in rows}
    assert abs(times["empty.py"].timestamp() - os.path.getmtime(os.path.join(root, "empty.py"))) < 1


def test_closed_directories_are_listed_but_not_opened(spark, root):
    for units in (1, 50):
        rows = {r["relative_path"] for r in corpus.scan(spark, {"r": root}, units=units, closed=("node_modules", "level3")).collect()}
        assert "node_modules" in rows and not any(n.startswith("node_modules/") for n in rows)
        assert not any("level4" in n for n in rows)


@pytest.mark.parametrize("budget", [1, 7, 10_000])
def test_walk_in_rounds_lists_the_same(spark, root, budget):
    rows = corpus.scan(spark, {"r": root, "d": root + "/deep"}, budget=budget).collect()
    want = {(repo, os.path.relpath(os.path.join(p, n), top)) for repo, top in (("r", root), ("d", root + "/deep")) for p, ds, fs in os.walk(top) for n in ds + fs}
    assert {(r["repo_id"], r["relative_path"]) for r in rows} == want and len(rows) == len(want)


def test_a_tree_with_one_full_directory_is_spread(spark, tmp_path):
    for i in range(40):
        (tmp_path / "t" / "hot" / f"d{i}").mkdir(parents=True)
        for k in range(5):
            (tmp_path / "t" / "hot" / f"d{i}" / f"f{k}").write_text("")
    (tmp_path / "t" / "cold.py").write_text("")
    listing = corpus.scan(spark, {"t": str(tmp_path / "t")}, units=8, budget=10)
    assert listing.count() == 1 + 1 + 40 + 200
    per_task = listing.where("not is_dir").groupBy(F.spark_partition_id()).count().collect()
    assert len(per_task) >= 5 and max(r["count"] for r in per_task) <= 80


def test_rejected_directories_are_not_opened_with_include_patterns(spark, root, tmp_path):
    seen = []

    def judge(rows):
        seen.extend(r["relative_path"] for r in rows.select("relative_path").collect())
        from arborlens.operators import select
        return select.judge(rows, ["*.log"], ["deep"])

    names = {r["relative_path"] for r in corpus.scan(spark, {"r": root}, judge=judge, budget=1).collect()}
    assert "deep" in seen and "deep" in names and not any(n.startswith(("deep/", "node_modules/a")) for n in names)


def test_directories_that_cannot_be_opened(spark, tmp_path, monkeypatch):
    listed = corpus._listed(str(tmp_path / "none"), False)
    assert listed == []
    with pytest.raises(FileNotFoundError):
        corpus._listed(str(tmp_path / "none"), True)


def test_missing_root_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="Folder not found"):
        corpus.scan(spark, {"r": str(tmp_path / "none")}).collect()
    with pytest.raises(ValueError):
        corpus.local_path("s3a://bucket/x")
    assert corpus.local_path("file:///a/b") == "/a/b"


def test_content_and_read_errors(spark, root):
    listing = corpus.scan(spark, {"r": root}).where(~F.col("is_dir"))
    gone = listing.limit(1).withColumn("relative_path", F.lit("gone.py"))
    rows = {r["relative_path"]: r for r in corpus.read_content(listing.unionByName(gone), 3).collect()}
    assert {n: bytes(r["content"]) for n, r in rows.items() if n != "gone.py"} == {n: t.encode() for n, t in TREE.items()}
    assert rows["gone.py"]["content"] is None and "No such file" in rows["gone.py"]["read_error"]


def test_traverse_folders(spark, root):
    run = traverse_folders(spark, {"r": root})
    docs = {r["relative_path"]: r["content"] for r in run.documents.collect()}
    kept = {n: t.replace("\r\n", "\n") for n, t in TREE.items()
            if n not in (".gitignore", "_private/__init__.py", "src/debug.log") and not n.startswith("node_modules")}
    assert docs == kept
    skips = {r["relative_path"]: r["reason_code"] for r in run.skipped.collect()}
    assert skips == {".gitignore": "ignored by default rules", "_private/__init__.py": "ignored by default rules",
                     "src/debug.log": "ignored by default rules", "node_modules/": "ignored by default rules"}
    row = run.dry_run.first()
    assert (row["files_selected"], row["skipped"]) == (len(kept), 4)


def test_include_and_exclude_over_folders(spark, root):
    run = traverse_folders(spark, {"r": root}, include=["*.log"], exclude=["*.md", "deep"])
    docs = {r["relative_path"] for r in run.documents.collect()}
    assert "src/debug.log" in docs and "README.md" not in docs and not any(d.startswith("deep/") for d in docs)
    assert {"deep/", "node_modules/", "README.md"} <= {r["relative_path"] for r in run.skipped.collect()}


def test_ignore_files_are_respected_when_asked(spark, root):
    os.makedirs(os.path.join(root, ".git", "info"))
    with open(os.path.join(root, ".git", "info", "exclude"), "w") as handle:
        handle.write("docs/\nleaf.py\n!src/debug.log")
    roots = spark.createDataFrame([("r", root), ("s", root + "/src")], "repo_id string, root string")
    lines = ignore_files.rule_lines(roots).collect()
    assert [(r["repo_id"], r["ord"], r["pattern"]) for r in sorted(lines, key=lambda r: r["ord"])] == [
        ("r", 0, "*.log"), ("r", 1, "docs/"), ("r", 2, "leaf.py"), ("r", 3, "!src/debug.log")]
    run = traverse_folders(spark, {"r": root}, include=["*.log"], respect_ignore_files=True)
    docs = {r["relative_path"] for r in run.documents.collect()}
    assert "src/debug.log" in docs and "src/main.py" in docs and "docs/guide.md" not in docs
    skips = {r["relative_path"]: r["reason_code"] for r in run.skipped.collect()}
    assert skips["docs/"] == "ignored by gitignore" and any(n.endswith("leaf.py") for n in skips)


def test_two_roots_do_not_mix(spark, root, tmp_path):
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "README.md").write_text("other")
    run = traverse_folders(spark, {"r": root, "o": str(tmp_path / "other")})
    docs = {(r["repo_id"], r["relative_path"]): r["content"] for r in run.documents.collect()}
    assert docs[("o", "README.md")] == "other" and docs[("r", "README.md")] == "# x\n"


def test_links_are_listed_and_judged(spark, root, tmp_path):
    (tmp_path / "outside").mkdir()
    (tmp_path / "outside" / "f.py").write_text("1")
    links = {"a_link": root + "/src", "z_out": str(tmp_path / "outside"), "broken": root + "/none", "out.py": str(tmp_path / "outside" / "f.py"),
             "src/loop": root}
    for name, target in links.items():
        os.symlink(target, os.path.join(root, name))
    rows = corpus.scan(spark, {"r": root})
    assert not any(r["relative_path"].startswith(("a_link/", "src/loop/", "z_out/")) for r in rows.collect())
    tops = spark.createDataFrame([("r", os.path.realpath(root))], "repo_id string, top string")
    judged = manifest.judge_links(rows.withColumns({"pruned_dir": F.lit(None).cast("string"), "reason_code": F.lit(None).cast("string")}), tops)
    found = {r["relative_path"]: r["reason_code"] for r in judged.collect()}
    assert {n: found[n] for n in (*links, "src")} == {
        "a_link": "circular or duplicate symbolic link", "z_out": "symbolic link outside repository", "broken": "broken symbolic link",
        "out.py": "symbolic link outside repository", "src/loop": "circular or duplicate symbolic link", "src": None}


def test_traversal_reads_nothing_through_bad_links(spark, root, tmp_path):
    outside = tmp_path / "outside"
    outside.mkdir()
    (outside / "secret.py").write_text("secret")
    links = {"leak.py": outside / "secret.py", "src/leak_too.py": outside / "secret.py", "broken.py": root + "/none.py", "far": outside,
             "again": root + "/src", "same.py": root + "/src/main.py", "node_modules/leak.py": outside / "secret.py",
             "beside.py": root + "-2/x.py"}
    (tmp_path / "repo-2").mkdir()
    (tmp_path / "repo-2" / "x.py").write_text("secret")
    for name, target in links.items():
        os.symlink(target, os.path.join(root, name))
    os.symlink(root, tmp_path / "by_link")
    for top in (root, str(tmp_path / "by_link")):
        run = traverse_folders(spark, {"r": top})
        documents = {r["relative_path"]: r["content"] for r in run.documents.collect()}
        assert "secret" not in documents.values() and documents["same.py"] == documents["src/main.py"] == "import os\n"
        skipped = {r["relative_path"]: r["reason_code"] for r in run.skipped.collect()}
        assert {n: skipped.get(n) for n in ("leak.py", "src/leak_too.py", "beside.py", "broken.py", "far/", "again/", "node_modules/leak.py")} == {
            "leak.py": "symbolic link outside repository", "src/leak_too.py": "symbolic link outside repository",
            "beside.py": "symbolic link outside repository", "broken.py": "broken symbolic link", "far/": "symbolic link outside repository",
            "again/": "circular or duplicate symbolic link", "node_modules/leak.py": None}
        assert not {"far", "again"} & set(skipped)


def test_files_that_cannot_be_read_are_reported(spark, root):
    listing = corpus.scan(spark, {"r": root}).where(~F.col("is_dir"))
    gone = listing.limit(1).withColumn("relative_path", F.lit("gone.py"))
    run = traverse(corpus.read_content(gone))
    assert [(r["relative_path"], r["stage"], r["reason_code"]) for r in run.skipped.collect()] == [("gone.py", "load", "permission_error")]


def test_fast_reader_agrees_where_no_name_is_hidden(spark, root):
    fast = corpus.scan_binary_files(spark, {"r": root}, max_kb=1)
    names = {r["relative_path"]: bytes(r["content"]) for r in fast.select("relative_path", "content").collect()}
    shown = {n: t.encode() for n, t in TREE.items() if t and not any(p[0] in "._" for p in n.split("/"))}
    assert names == shown
    plan = fast._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,1024)" in plan


def test_documents_in_order(spark, root, tmp_path):
    run = traverse_folders(spark, {"r": root, "s": root + "/deep"}, partitions=4)
    sinks.write_documents(run.documents, str(tmp_path / "docs"))  # dealt by name before they were read
    sinks.write_documents(run.documents, str(tmp_path / "split"), names=run.judged, parts=3)
    with pytest.raises(AnalysisException):
        sinks.write_documents(run.documents, str(tmp_path / "docs"))
    for name in ("docs", "split"):
        files = sorted(p for p in (tmp_path / name).iterdir() if p.name.startswith("part-"))
        keys = [(r["repo_id"], r["relative_path"]) for f in files for r in spark.read.parquet(str(f)).collect()]
        assert keys == sorted(keys) and len(keys) == run.documents.count() and len(files) > 1


def test_split_points_part_like_a_sort(spark):
    names = [("r", f"{i:03}") for i in range(300)] + [("s", "x"), ("q", "y")]
    table = spark.createDataFrame(names, "repo_id string, relative_path string")
    points = sinks._split_points(table, 150)
    assert points == sorted(points) and len(points) > 100
    found = {(r["repo_id"], r["relative_path"]): r["n"] for r in table.withColumn("n", sinks._range_of(points)).collect()}
    assert found == {k: max(sum(p <= k for p in points) - 1, 0) for k in names}


def test_sinks(spark, root, tmp_path):
    run = traverse_folders(spark, {"r": root})
    reports = run.dry_run.select("repo_id", "skip_summary")
    target = str(tmp_path / "reports")
    sinks.write_reports(reports, target, "skip_summary")
    with pytest.raises(FileExistsError):
        sinks.write_reports(reports, target, "skip_summary")
    sinks.write_reports(reports.withColumn("repo_id", F.lit("other")), target, "skip_summary")  # another repository: no conflict
    sinks.write_reports(reports.withColumn("skip_summary", F.concat("skip_summary", F.lit("!"))), target, "skip_summary", force=True)
    assert {tuple(r) for r in sinks.read_reports(spark, target).collect()} == {("r", "ignored by default rules: 4!"), ("other", "ignored by default rules: 4")}
    sinks.export_report(spark, target, "r", str(tmp_path / "one"))
    assert spark.read.text(str(tmp_path / "one"), wholetext=True).first()["value"] == "ignored by default rules: 4!\n"
    lines = tree.lines(run.documents)
    sinks.write_tree(tree.tree_and_files(run.documents, per_piece=3), str(tmp_path / "tree"))
    pieces = spark.read.parquet(str(tmp_path / "tree")).orderBy("repo_id", "kind", "piece").collect()
    assert all(r["text"].count("\n") < 3 for r in pieces) and {r["repo_id"] for r in pieces} == {"r"}
    assert "\n".join(r["text"] for r in pieces if r["kind"] == "tree") == "\n".join(r["line"] for r in lines.orderBy("repo_id", "sort_key").collect())
    assert "\n".join(r["text"] for r in pieces if r["kind"] == "files").split("\n") == sorted(r["relative_path"] for r in run.documents.collect())
    assert tree.tree_and_files(run.documents.limit(0)).count() == 0


def test_failures_of_one_file_do_not_end_the_run(spark, root):
    listing = corpus.scan(spark, {"r": root}).where(~F.col("is_dir")).limit(1).withColumn("relative_path", F.lit("a\x00b.py"))
    run = traverse(corpus.read_content(listing))
    assert [(r["stage"], r["reason_code"]) for r in run.skipped.collect()] == [("load", "unexpected_error")]
    events = report.progress(run.outcomes).where("completed = 1").collect()
    assert events[0]["event_type"] == "file_failed" and events[0]["detail"].startswith("unexpected_error: ")
