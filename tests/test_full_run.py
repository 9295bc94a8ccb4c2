from arborlens.plans.full_run import full_run
from arborlens.sources import sinks
from arborlens.sources.cache_store import CacheStore


def test_from_trees_to_reports(spark, tmp_path):
    trees = {
        "one": {"src/main.py": "# Main\nimport util\n", "src/util.py": "# Util\n", "README.md": "# One", "a.log": "x"},
        "two": {f"pkg{i}/m{j}.js": f"// {i}.{j}\nimport x from '../lib/core'\n" for i in range(4) for j in range(5)}
        | {"lib/core.ts": "// core\n", "top.md": "top"},
    }
    # 'pkg' alone is an ignored directory, 'pkg0' is not.
    for repo, files in trees.items():
        for name, text in files.items():
            path = tmp_path / repo / name
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(text)
    roots = {repo: str(tmp_path / repo) for repo in trees}
    store = CacheStore(spark, str(tmp_path / "store"))

    def generate(row):
        return f"# {row['k']} v{row['iteration']}\n{row['documents']} files\n{row['contents']}\ntree {row['tree']}\n"

    def review(text):
        return (9.0 if " v2" in text else 5.0), "more"

    output = str(tmp_path / "out")
    run = full_run(spark, roots, store, "cfg", generate, review, output=output, concurrency=2)
    reports = {r["repo_id"]: r["report"] for r in run.reports.collect()}
    assert reports["one"].startswith("# one v2\n3 files\nREADME.md: # One\nsrc/main.py: # Main\nsrc/util.py: # Util\n")
    assert "- `util.py` (1 incoming dependencies)" in reports["one"]
    assert "22 files\nlib/core.ts: // core\npkg0: 5 files and 0 directories, 5 files in all\n" in reports["two"]
    assert "- `core.ts` (20 incoming dependencies)" in reports["two"] and "- ... and 10 more" in reports["two"]
    assert {(r["k"], r["iteration"]) for r in run.attempts.collect()} == {(k, i) for k in trees for i in (1, 2)}
    assert {r["relative_path"] for r in run.skipped.collect()} == {"a.log"}
    stored = store.read().collect()
    assert len(stored) == 25 and all(r["modification_time"] is not None for r in stored)
    assert {r["repo_id"]: r["report"] for r in sinks.read_reports(spark, f"{output}/reports").collect()} == reports
    pieces = spark.read.parquet(f"{output}/trees").where("repo_id = 'one'").orderBy("kind", "piece").collect()
    assert [(r["kind"], r["text"]) for r in pieces] == [
        ("files", "README.md\nsrc/main.py\nsrc/util.py"), ("tree", "one/\n    └── README.md\n    ├── src/\n        ├── main.py\n        └── util.py")]
    assert {r["dir"] for r in run.directories.collect()} == {f"pkg{i}" for i in range(4)}
    assert f"tree {output}/trees\n" in reports["one"]
