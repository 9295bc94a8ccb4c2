import json
import random

import pytest
from pyspark.sql import functions as F

from arborlens import fixed_values as V
from arborlens.operators import manifest, refine, report, rollup, select, tree, watch
from arborlens.plans.traverse import traverse

FILES = "repo_id string, relative_path string, length bigint, content binary"


def listing(spark, files, repo="r"):
    rows = [(repo, p, len(b), bytearray(b)) for p, b in files.items()]
    return spark.createDataFrame(rows, FILES)


TREE = {
    "main.py": b"import os\r\n", "README.md": b"# x", "large.py": b"x" * 2000, "node_modules/package.json": b"{}",
    "node_modules/a/b.js": b"1", "pic.dat": b"\x89PNG\r\n\x1a\n", "bad.c": b"a\xff\xfeb", "data.csv": b"1", ".github/x/ci.yml": b"a: b",
}


def test_outcomes_documents_and_skips(spark):
    run = traverse(listing(spark, TREE), exclude=["README.md"], max_kb=1)
    docs = {r["relative_path"]: (r["content"], r["file_type"]) for r in run.documents.collect()}
    assert docs == {"main.py": ("import os\n", ".py"), ".github/x/ci.yml": ("a: b", ".yml")}
    skips = {r["relative_path"]: (r["stage"], r["reason_code"], r["reason_detail"]) for r in run.skipped.collect()}
    assert skips == {
        "README.md": ("filter", "excluded by pattern", None), "large.py": ("filter", "exceeds maximum file size", "2000 B > 1024 B limit"),
        "node_modules/": ("directory", "ignored by default rules", None), "pic.dat": ("binary", "binary_file", None),
        "bad.c": ("binary", "binary_file", None), "data.csv": ("filter", "ignored by default rules", None)}
    row = run.dry_run.first().asDict()
    assert row == {"repo_id": "r", "files_selected": 2, "estimated_tokens": 4, "total_bytes": 14, "request_size": "14 B", "skipped": 6,
                   "skip_summary": "excluded by pattern: 1\nignored by default rules: 2\nexceeds maximum file size: 1\nbinary_file: 2"}


def test_undecodable_text_beyond_the_sample(spark):
    run = traverse(listing(spark, {"a.c": b"x" * 9000 + b"\xff"}))
    assert [(r["stage"], r["reason_code"]) for r in run.skipped.collect()] == [("load", "encoding_error")]
    assert select.errors(run.skipped).count() == 1


def test_cost(spark):
    docs = spark.createDataFrame([("a" * 14,), ("b" * 27,)], "content string")
    assert tuple(report.cost(docs).first()) == (13, 41, 2)
    assert tuple(report.cost(docs.limit(0)).first()) == (0, 0, 0)


@pytest.mark.parametrize("ranges", [1, 7])
def test_progress_counts_every_file_once_in_path_order(spark, ranges):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    files = {f"d{i % 3}/f{i:03}.{'py' if i % 4 else 'csv'}": b"x" if i % 5 else b"MZ" for i in range(60)} | {"build/x.py": b"1"}
    both = listing(spark, files).union(listing(spark, {"a.py": b"1", "b.txt": b"1", "c.py": b"1"}, "s"))
    run = traverse(both)
    try:
        events = report.progress(run.outcomes).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for repo, total in (("r", 60), ("s", 3)):
        mine = sorted((e for e in events if e["repo_id"] == repo), key=lambda e: e["completed"])
        assert [e["completed"] for e in mine] == list(range(total + 1))
        assert {e["total"] for e in mine} == {total} and mine[0]["event_type"] == "files_discovered"
        assert len({e["relative_path"] for e in mine[1:]}) == total
        early = [e["detail"] == "ignored by default rules" for e in mine[1:]]
        assert early == sorted(early, reverse=True)
        late = [e["relative_path"] for e in mine[1:] if e["detail"] != "ignored by default rules"]
        assert late == sorted(late)
    kinds = {e["relative_path"]: e["event_type"] for e in events if e["repo_id"] == "s"}
    assert kinds == {None: "files_discovered", "a.py": "file_completed", "b.txt": "file_skipped", "c.py": "file_completed"}


def test_tree_text(spark):
    names = ["main.py", "a!b/q.py", "a/x.py", "a/y.py", "a/b/z.py", "zz.md"]
    rows = tree.lines(spark.createDataFrame([("repo", n) for n in names], "repo_id string, relative_path string"))
    text = "\n".join(r["line"] for r in rows.orderBy("repo_id", "sort_key").collect())
    assert text == (
        "repo/\n    ├── main.py\n    └── zz.md\n    ├── a/\n        ├── x.py\n        └── y.py\n"
        "        ├── b/\n            └── z.py\n    ├── a!b/\n        └── q.py")


PATHS = ["a/b/c/x", "a/b/c/y", "a/b/d/z", "e/f/only", "g/1", "g/h/2", "top"]


def summaries(spark, names, repo="r"):
    return spark.createDataFrame([(repo, n, f"about {n}", json.dumps(f"S({n})")) for n in names],
                                 "repo_id string, file_path string, description string, summary string")


def test_directories_and_representatives(spark):
    rows = summaries(spark, PATHS + [""])
    facts = {r["dir"]: (r["n_files"], r["n_dirs"]) for r in rollup.tree_facts(rollup.usable(rows)).collect()}
    assert facts == {"a": (0, 1), "a/b": (0, 2), "a/b/c": (2, 0), "a/b/d": (1, 0), "e": (0, 1), "e/f": (1, 0), "g": (1, 1), "g/h": (1, 0)}
    stands = {r["dir"]: (r["representative"], r["summarised"]) for r in rollup.representatives(rollup.usable(rows)).collect()}
    assert {d for d, (_, own) in stands.items() if own} == {"a/b", "a/b/c", "g"}
    assert stands["a"] == ("a/b", False) and stands["e"] == ("e/f/only", False) and stands["g/h"] == ("g/h/2", False)


def test_roll_up(spark):
    rolled = rollup.roll_up(summaries(spark, PATHS), threshold=3).collect()
    assert {(r["file_path"], r["kind"]) for r in rolled} == {("a/b", "directory"), ("e/f/only", "file"), ("g", "directory"), ("top", "file")}
    assert {r["file_path"]: r["description"] for r in rolled}["a/b"] == "0 files and 2 directories, 3 files in all"
    small = rollup.roll_up(summaries(spark, PATHS)).collect()
    assert {r["file_path"] for r in small} == set(PATHS) and len(small) == len(PATHS)
    assert rollup.roll_up(summaries(spark, [""] * 20)).count() == 0


def plain_roll_up(names):
    """What the tree gives when walked from the bottom, directory by directory."""
    made = {}

    def visit(prefix):
        below = [n for n in names if n.startswith(prefix)]
        dirs = sorted({n[len(prefix):].split("/")[0] for n in below if "/" in n[len(prefix):]})
        items = {}
        for d in dirs:
            items.update([visit(prefix + d + "/")])
        items.update({n: f"S({n})" for n in below if "/" not in n[len(prefix):]})
        if len(items) == 1:
            return next(iter(items.items()))
        made[prefix[:-1]] = f"{prefix[:-1]}[{'|'.join(v for _, v in sorted(items.items()))}]"
        return prefix[:-1], made[prefix[:-1]]

    for top in sorted({n.split("/")[0] for n in names if "/" in n}):
        visit(top + "/")
    return made


def test_user_function_per_directory(spark):
    rng = random.Random(3)
    names = sorted({"/".join(rng.choice("abc") for _ in range(rng.randint(0, 3))) + f"/f{i}" for i in range(25)} | set(PATHS))
    names = [n.lstrip("/") for n in names]
    def call(where, contents):
        return json.dumps("|".join(json.loads(contents)))

    def merge(where, parts):
        return json.dumps(f"{where}[{'|'.join(map(json.loads, parts))}]")

    done = rollup.summarise_directories(summaries(spark, names), call, merge, threshold=3)
    assert {r["dir"]: json.loads(r["summary"]) for r in done.collect()} == plain_roll_up(names)
    assert rollup.summarise_directories(summaries(spark, names), call, merge, threshold=100).count() == 0


def test_user_function_on_a_huge_directory_and_failures(spark):
    names = [f"big/f{i:04}" for i in range(5000)] + ["bad/1", "bad/2", "fine/1", "fine/2", "fine/3", "fine/deep/4", "fine/deep/5"]

    def call(where, contents):
        items = json.loads(contents)
        assert len(items) <= 800
        if where == "bad":
            raise ValueError("no")
        return json.dumps([len(items), items[0] if where == "big" else None])

    def merge(where, parts):
        rows = [json.loads(p) for p in parts]
        return json.dumps([sum(r[0] for r in rows), rows[0][1]])

    done = rollup.summarise_directories(summaries(spark, names), call, merge, threshold=3, per_call=800)
    assert {r["dir"]: (r["summary"] and json.loads(r["summary"]), r["error"]) for r in done.collect()} == {
        "big": ([5000, "S(big/f0000)"], None), "fine": ([4, None], None), "fine/deep": ([2, None], None), "bad": (None, "ValueError: no")}


def test_a_directory_is_treated_alike_at_every_size(spark):
    names = [f"d/f{i:02}" for i in range(40)] + [f"d/e/g{i}" for i in range(9)] + ["x"]
    files = summaries(spark, names).withColumn("summary", F.to_json(F.struct("file_path")))
    said = []
    for per_call in (3, 1000):
        rows = rollup.summarise_directories(files, threshold=3, per_call=per_call).collect()
        said.append({r["dir"]: json.loads(r["summary"])["description"] for r in rows})
    assert said[0] == said[1] == {"d": "40 files and 1 directories, 49 files in all", "d/e": "9 files and 0 directories, 9 files in all"}
    rolled = rollup.roll_up(files, 3, rollup.summarise_directories(files, threshold=3)).collect()
    assert {(r["file_path"], r["description"]) for r in rolled} == {("d", said[0]["d"]), ("x", "about x")}


def test_lists_of_every_length_come_in_path_order(spark):
    rows = [("many", f"d/{i:05}", f"text {i}") for i in range(5000)] + [("few", "a", "one"), ("few", "b", "two")]
    items = spark.createDataFrame(rows, "repo_id string, file_path string, description string").repartition(5)
    for per_call in (7, 1000, 10_000):
        got = {r["repo_id"]: r["contents"] for r in rollup.condense(items, rollup.as_lines, per_call).collect()}
        assert got == {k: "\n".join(f"{p}: {t}" for r, p, t in rows if r == k) for k in ("many", "few")}


def attempts(spark, scores):
    rows = [(k, i + 1, s, f"{k}{i + 1}") for k, line in scores.items() for i, s in enumerate(line)]
    return spark.createDataFrame(rows, "k string, iteration int, score double, text string")


def test_best_attempts(spark):
    tried = attempts(spark, {"k1": [7.0, 9.0, 9.9], "k2": [5.0, 5.0, 4.0, 10.0], "k3": [0.0], "k4": [8.5, 9.0]})
    found = {r["k"]: (r["rounds"], r["best_iteration"], r["best_score"]) for r in refine.best_attempts(tried).collect()}
    assert found == {"k1": (2, 2, 9.0), "k2": (3, 1, 5.0), "k3": (1, None, None), "k4": (1, 1, 8.5)}
    texts = {r["k"]: r["text"] for r in refine.best_texts(tried).collect()}
    assert texts == {"k1": "k12", "k2": "k21", "k3": "", "k4": "k41"}


def test_refine_goes_on_only_with_what_is_not_done(spark):
    keys = spark.createDataFrame([(str(k),) for k in range(12)], "k string").repartition(3)

    def generate(row):
        return f"{row['latest']}|{row['k']}.{row['iteration']}.{len(row['feedback'])}"

    def review(text):
        k, i, _ = text.rsplit("|", 1)[1].split(".")
        return (9.0 if int(k) % 3 < int(i) - 1 else float(k)), f"f{i}"

    rows = sorted((int(r["k"]), r["iteration"], r["score"], r["feedback"], r["text"]) for r in refine.refine(keys, generate, review).collect())
    expected = []
    for k in range(12):
        text = ""
        for i in (1, 2, 3):
            text += f"|{k}.{i}.{i - 1}"
            score = 9.0 if k % 3 < i - 1 else float(k)
            expected.append((k, i, score, f"f{i}", text))
            if score >= 8.5:
                break
    assert rows == expected


def test_links(spark):
    kinds = ("repo_id string, relative_path string, length bigint, is_dir boolean, is_link boolean, resolved_path string, "
             "pruned_dir string, reason_code string")
    folder, file = (None, True), (5, False)
    rows = [("src", *folder, False, "/repo/src", None), ("a_link", *folder, True, "/repo/src", None), ("b_link", *folder, True, "/repo/src", None),
            ("gone", None, False, True, "/repo/none", None), ("out", *folder, True, "/outside", None), ("near", *folder, True, "/repository/x", None),
            ("file", *file, False, "/repo/file", None), ("same", *file, True, "/repo/file", None), ("top", *folder, True, "/repo", None),
            ("build", *folder, False, "/repo/build", "build"), ("to_build", *folder, True, "/repo/build", None),
            ("to_build_2", *folder, True, "/repo/build", None), ("below", *folder, True, "/repo/build/deep", None),
            ("build/l", *folder, True, "/repo/src", "build"), ("out_file", *file, True, "/x", None)]
    table = spark.createDataFrame([("r", *r, "ruled" if r[5] else None) for r in rows], kinds)
    for half in (1, 4):
        judged = manifest.judge_links(table.repartition(half), spark.createDataFrame([("r", "/repo")], "repo_id string, top string"))
        found = {r["relative_path"]: (r["reason_code"], r["pruned_dir"]) for r in judged.collect()}
        assert found == {
            "src": (None, None), "a_link": (V.LINK_DUPLICATE, "a_link"), "b_link": (V.LINK_DUPLICATE, "b_link"), "gone": (V.LINK_BROKEN, None),
            "out": (V.LINK_OUTSIDE, "out"), "near": (V.LINK_OUTSIDE, "near"), "file": (None, None), "same": (None, None),
            "top": (V.LINK_DUPLICATE, "top"), "build": ("ruled", "build"),
            # An alias stands for a directory that is reached by no other name.
            "to_build": (None, None), "to_build_2": (V.LINK_DUPLICATE, "to_build_2"), "below": (None, None),
            "build/l": ("ruled", "build"), "out_file": (V.LINK_OUTSIDE, None)}


def test_observer_gets_counts_and_cannot_break_the_run(spark):
    watched = watch.Watch(traverse(listing(spark, TREE), max_kb=1).outcomes)
    assert watched.rows.collect()

    def broken(counts):
        raise RuntimeError("observer")

    assert watched.tell(broken) == {"total": 7, "completed": 3, "skipped": 4}
    assert watched.errors == ["RuntimeError: observer"]


def test_observer_of_every_event_while_the_run_goes_on(spark, tmp_path):
    folder = str(tmp_path)
    outcomes = traverse(listing(spark, TREE), max_kb=1).outcomes.repartition(3)

    def make():
        import os

        def see(event):
            with open(os.path.join(folder, event["relative_path"].replace("/", "_")), "w") as handle:
                handle.write(event["event_type"])
            if event["relative_path"] == "main.py":
                raise RuntimeError("observer")
        return see

    rows = watch.tell_each(watch.with_events(outcomes), make).collect()
    assert {r["relative_path"]: r["observer_error"] for r in rows if r["observer_error"]} == {"main.py": "RuntimeError: observer"}
    assert {p.name: p.read_text() for p in tmp_path.iterdir()} == {r["relative_path"].replace("/", "_"): r["event_type"] for r in rows} and len(rows) == 7
    numbered = watch.tell_each(report.progress(outcomes), lambda: lambda event: 1 / (event["total"] - event["completed"]))
    assert [r["completed"] for r in numbered.where("observer_error is not null").collect()] == [7]
    broken = watch.tell_each(watch.with_events(outcomes), lambda: 1 / 0).select("observer_error").distinct().collect()
    assert [r[0] for r in broken] == ["ZeroDivisionError: division by zero"]
    assert watch.tell_each(watch.with_events(outcomes).limit(0), make).count() == 0


def test_runs_of_items_are_rows_and_not_groups_of_python(spark, monkeypatch):
    monkeypatch.setattr("pyspark.sql.GroupedData.applyInPandas", None)
    items = spark.createDataFrame([("r", f"f{i:03d}", f"d{i}") for i in range(50)], "repo_id string, file_path string, description string")

    def call(where, texts):
        if "f049: d49" in texts:
            raise ValueError("busy")
        return "|".join(texts)

    few = items.where("file_path < 'f049'")
    assert rollup.condense(few, call, 4).first()["contents"].replace("\n", "|") == "|".join(f"f{i:03d}: d{i}" for i in range(49))
    assert rollup.condense(items, call, 4).first()["contents"] == "ValueError: busy"
