import json
import re

import pytest
from pyspark.sql import functions as F

from arborlens.operators import enrich, summary_cache
from arborlens.plans import incremental
from arborlens.sources.cache_store import CacheStore, read_documents
from arborlens.streaming import incremental as stream

DOC = "repo_id string, file_path string, language string, content string"


def documents(spark, files, repo="r"):
    return spark.createDataFrame([(repo, p, lang, text) for p, (lang, text) in files.items()], DOC)


def cache(spark, *rows):
    """Rows of (path, text, language, summary, config, version)."""
    import hashlib
    data = [("r", p, hashlib.sha256(t.encode()).hexdigest(), lang, s, None, c, v) for p, t, lang, s, c, v in rows]
    return spark.createDataFrame(data, summary_cache.SCHEMA)


def test_lookup_needs_everything_to_agree(spark):
    docs = documents(spark, {"a.py": ("python", "x")})
    keys = summary_cache.keyed(docs)
    good = ("a.py", "x", "python", "s", "cfg", "1.0")
    assert summary_cache.lookup(keys, cache(spark, good), "cfg").first()["summary"] == "s"
    for at, other in ((0, "b.py"), (1, "y"), (2, "go"), (4, "cfg2"), (5, "0.9")):
        row = list(good)
        row[at] = other
        assert summary_cache.lookup(keys, cache(spark, tuple(row)), "cfg").first()["summary"] is None
        assert summary_cache.misses(keys, cache(spark, tuple(row)), "cfg").count() == 1
    assert summary_cache.misses(keys, cache(spark, good), "cfg").count() == 0


def test_last_write_wins_and_failures_are_not_stored(spark):
    old = cache(spark, ("a.py", "x", "python", "old", "c", "1.0"), ("b.py", "x", "python", "keep", "c", "1.0"))
    fresh = spark.createDataFrame(
        [("r", "a.py", "h", "python", "v1", "c", "1.0", None, 1), ("r", "a.py", "h", "python", "v2", "c", "1.0", None, 2),
         ("r", "b.py", "h", "python", None, "c", "1.0", "failed", 1)],
        "repo_id string, file_path string, content_hash string, language string, summary string, config_hash string, "
        "schema_version string, error string, n int").withColumn("modification_time", F.lit(None).cast("timestamp"))
    after = summary_cache.upsert(old, fresh, "n")
    assert sorted((r["file_path"], r["summary"]) for r in after.collect()) == [("a.py", "v2"), ("b.py", "keep")]


def test_stale_rows(spark):
    old = cache(spark, ("a.py", "x", "l", "s", "c", "1.0"), ("gone.py", "x", "l", "s", "c", "1.0"))
    docs = documents(spark, {"a.py": ("l", "x")})
    assert [r["file_path"] for r in summary_cache.stale(old, docs).collect()] == ["gone.py"]
    assert [r["file_path"] for r in summary_cache.remove_stale(old, docs).collect()] == ["a.py"]


ENTRY = {"file_path": "a.py", "content_hash": "h", "language": "python", "summary": {"description": "d"}, "mtime": 3.5}
DAMAGED = {
    "sound": ({"schema_version": "1.0", "config_hash": "c", "entries": [ENTRY]}, True),
    "empty": ({"schema_version": "1.0", "config_hash": "c", "entries": []}, True),
    "list root": ([ENTRY], False), "dict entries": ({"schema_version": "1.0", "config_hash": "c", "entries": {"a": ENTRY}}, False),
    "no version": ({"config_hash": "c", "entries": []}, False), "no config": ({"schema_version": "1.0", "entries": []}, False),
    "no entries": ({"schema_version": "1.0", "config_hash": "c"}, False),
    "entry not a dict": ({"schema_version": "1.0", "config_hash": "c", "entries": [ENTRY, 1]}, False),
    "null entry": ({"schema_version": "1.0", "config_hash": "c", "entries": [None]}, False),
    "null fields": ({"schema_version": None, "config_hash": "c", "entries": [dict(ENTRY, summary=None)]}, True),
} | {f"entry without {k}": ({"schema_version": "1.0", "config_hash": "c", "entries": [{x: y for x, y in ENTRY.items() if x != k}]}, False) for k in ENTRY}


def test_damaged_cache_texts(spark):
    rows = [(name, json.dumps(value)) for name, (value, _) in DAMAGED.items()] + [("not json", "{oops"), ("text", '"x"')]
    stored = spark.createDataFrame(rows, "repo_id string, raw string")
    found = {r["repo_id"]: r["ok"] for r in stored.select("repo_id", summary_cache.valid_document(F.col("raw")).alias("ok")).collect()}
    assert found == {n: ok for n, (_, ok) in DAMAGED.items()} | {"not json": False, "text": False}
    entries = summary_cache.entries(stored).where("repo_id = 'sound'").first()
    assert (entries["file_path"], json.loads(entries["summary"])) == ("a.py", {"description": "d"})
    assert entries["modification_time"].timestamp() % 60 == 3.5
    assert {r["repo_id"] for r in summary_cache.entries(stored).collect()} == {"sound", "null fields"}


def test_stored_texts_are_read_whole(spark, tmp_path):
    (tmp_path / "repo_id=x y").mkdir()
    (tmp_path / "repo_id=x y" / "summaries.json").write_text(json.dumps(DAMAGED["sound"][0], indent=2))
    rows = summary_cache.entries(read_documents(spark, str(tmp_path))).collect()
    assert [(r["repo_id"], r["file_path"]) for r in rows] == [("x y", "a.py")]


def test_store_keeps_the_last_committed_state(spark, tmp_path):
    store = CacheStore(spark, str(tmp_path / "store"), buckets=3)
    assert store.read().count() == 0
    store.write(cache(spark, ("a.py", "x", "l", "s1", "c", "1.0")))
    before = store.read()
    store.write(store.read().withColumn("summary", F.lit("s2")))
    assert store.read().first()["summary"] == "s2" and before.first()["summary"] == "s1"
    # A state that the pointer does not name, as a run leaves it that died, does not count.
    cache(spark, ("z.py", "x", "l", "s", "c", "1.0")).write.parquet(str(tmp_path / "store" / "state-dead"))
    assert store.read().first()["summary"] == "s2"
    for n in range(3):
        store.write(store.read().withColumn("summary", F.lit(f"n{n}")))
    assert CacheStore(spark, str(tmp_path / "store")).read().first()["summary"] == "n2"
    assert len([f for f in (tmp_path / "store").iterdir() if f.is_dir()]) == 3  # two states and the dead one


def test_an_unreadable_pointer_is_not_an_empty_cache(spark, tmp_path):
    store = CacheStore(spark, str(tmp_path / "store"))
    store.write(cache(spark, ("a.py", "x", "l", "s1", "c", "1.0")))
    (tmp_path / "store" / "current.json").write_text("{oops")
    (tmp_path / "store" / ".current.json.crc").unlink()
    with pytest.raises(ValueError):
        store.read()


def test_one_join_labels_every_file(spark):
    docs = documents(spark, {"same.py": ("python", "x"), "text.py": ("python", "new"), "lang.py": ("go", "x"), "first.py": ("python", "x"), "empty.py": ("python", "x")})
    old = cache(spark, ("same.py", "x", "python", "s", "c", "1.0"), ("text.py", "x", "python", "s", "c", "1.0"), ("lang.py", "x", "python", "s", "c", "1.0"),
                ("empty.py", "x", "python", None, "c", "1.0"), ("gone.py", "x", "python", "s", "c", "1.0"))
    keys = summary_cache.keyed(docs)
    odd = spark.createDataFrame([("r", None, "h", "l"), (None, "x", "h", None)], keys.schema)
    known = summary_cache.compare(keys.union(odd), old)
    assert {(r["repo_id"], r["file_path"]): r["state"] for r in known.collect()} == {
        ("r", "same.py"): "hit", ("r", "text.py"): "miss", ("r", "lang.py"): "miss", ("r", "first.py"): "miss", ("r", "empty.py"): "miss",
        ("r", "gone.py"): "stale", ("r", None): "miss", (None, "x"): "miss"}
    assert {r["file_path"] for r in known.where("state = 'hit'").collect()} == {r["file_path"] for r in keys.join(summary_cache.misses(keys, old, "c"), "file_path", "left_anti").collect()}
    assert summary_cache.compare(keys.limit(0), old.limit(0)).count() == 0


def plan_of(rows):
    import contextlib
    import io

    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        rows.explain("formatted")
    return out.getvalue()


def test_no_text_moves_in_a_run_over_a_document_table(spark, tmp_path):
    docs = documents(spark, {f"f{i}.py": ("python", f"text {i}") for i in range(50)})
    store = CacheStore(spark, str(tmp_path / "store"))
    store.write(cache(spark, *[(f"f{i}.py", f"text {i}", "python", '{"description": "d"}', "c", "1.0") for i in range(25)]))
    table = incremental.document_table(docs, str(tmp_path / "docs"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        labels = plan_of(summary_cache.compare(summary_cache.keyed(table), store.read()))
        assert "Exchange" not in labels  # both sides lie in the same buckets
        assert not re.search(r"ReadSchema: .*[<,]content:", labels)  # hashes are stored
        asked = []
        result = incremental.step(table, store.read(), "c", lambda todo: asked.append(todo) or enrich.default_enrich(todo))
        moved = re.findall(r"\) Exchange\nInput[^\n]*", plan_of(asked[0]) + plan_of(result.cache))
        assert moved and not [line for line in moved if "content#" in line]  # keys and summaries only
        assert "SortMergeJoin" not in plan_of(asked[0]) and asked[0].count() == 25 and result.cache.count() == 50
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def counting(spark, tmp_path):
    """An enrichment that notes each call in a file and fails for some texts."""
    log = tmp_path / "calls"
    log.mkdir()
    folder = str(log)

    def make():
        import os
        import uuid

        def call(row):
            with open(os.path.join(folder, uuid.uuid4().hex), "w") as handle:
                handle.write(row["file_path"])
            if "bad" in row["content"]:
                raise ValueError("cannot")
            return json.dumps({"file_path": row["file_path"], "description": row["content"].upper()})
        return call

    def calls():
        return sorted(f.read_text() for f in log.iterdir())

    return (lambda rows: enrich.enrich(rows, make)), calls, make


def test_incremental_runs_call_only_for_changes(spark, tmp_path):
    run, calls, _ = counting(spark, tmp_path)
    store = CacheStore(spark, str(tmp_path / "store"))
    first = {"a.py": ("python", "one"), "b.py": ("python", "two"), "c.py": ("python", "bad")}
    done = incremental.run_batch(documents(spark, first), store, "cfg", run).collect()
    assert {(r["file_path"], r["error"]) for r in done} == {("a.py", None), ("b.py", None), ("c.py", "ValueError: cannot")}
    assert calls() == ["a.py", "b.py", "c.py"]
    # b changed, a is gone, c failed before and is tried again.
    done = incremental.run_batch(documents(spark, {"b.py": ("python", "two!"), "c.py": ("python", "good"), "d.py": ("go", "new")}), store, "cfg", run)
    assert {r["file_path"] for r in done.collect()} == {"b.py", "c.py", "d.py"}
    assert calls() == ["a.py", "b.py", "b.py", "c.py", "c.py", "d.py"]
    assert sorted(r["file_path"] for r in store.read().collect()) == ["b.py", "c.py", "d.py"]
    # Nothing changed: no calls. Another configuration: all again.
    incremental.run_batch(documents(spark, {"b.py": ("python", "two!")}), store, "cfg", run)
    assert len(calls()) == 6
    incremental.run_batch(documents(spark, {"b.py": ("python", "two!")}), store, "cfg-2", run)
    assert len(calls()) == 7
    assert {r["config_hash"] for r in store.read().collect()} == {"cfg-2"}


def test_only_good_answers_are_stored(spark, tmp_path):
    said = {
        "plain.py": '{"file_path": "plain.py", "description": "use ```x```"}',
        "fenced.py": 'Here it is:\n```json\n{"file_path": "fenced.py", "description": "d"}\n```\n',
        "words.py": "Sorry, I cannot", "list.py": "[1]", "error.py": '{"file_path": "error.py", "error": "busy"}',
    }
    store = CacheStore(spark, str(tmp_path / "store"))
    run = lambda rows: enrich.enrich(rows, lambda: lambda row: said[row["file_path"]])
    done = incremental.run_batch(documents(spark, {n: ("python", n) for n in said}), store, "cfg", run)
    assert {r["file_path"]: r["error"] for r in done.collect()} == {
        "plain.py": None, "fenced.py": None, "words.py": "invalid JSON", "list.py": "invalid JSON", "error.py": "busy"}
    kept = {r["file_path"]: json.loads(r["summary"]) for r in store.read().collect()}
    assert kept == {"plain.py": json.loads(said["plain.py"]), "fenced.py": {"file_path": "fenced.py", "description": "d"}}


VERSIONS = [
    [("r", "a.py", "python", "one", 1, False), ("r", "b.py", "python", "two", 1, False), ("r", "a.py", "python", "one!", 2, False)],
    [("r", "b.py", "python", "two", 3, False), ("r", "c.py", "python", "three", 3, False)],
    [("r", "a.py", "python", "", 4, True), ("r", "c.py", "python", "three!", 4, False), ("r", "c.py", "python", "", 5, True),
     ("r", "d.py", "python", "four", 5, False)],
]


class Stream:
    """A table of versions and the stream over it; ``put`` appends rows and runs the stream until it has seen them."""

    def __init__(self, spark, folder, make, config="cfg"):
        self.spark, self.folder, self.make, self.config = spark, folder, make, config

    def put(self, *rows, columns=stream.VERSIONS):
        if rows:
            self.spark.createDataFrame(rows, columns).coalesce(1).write.mode("append").parquet(f"{self.folder}/versions")
        versions = self.spark.readStream.schema(stream.VERSIONS).parquet(f"{self.folder}/versions")
        query = stream.start(versions, f"{self.folder}/changes", self.config, f"{self.folder}/checkpoint", self.make)
        assert query.awaitTermination(60) and query.exception() is None
        return self.state()

    def told(self):
        return stream.told(self.spark, f"{self.folder}/changes")

    def state(self):
        return {r["file_path"]: json.loads(r["summary"])["description"] for r in stream.summaries(self.told()).collect()}


def version(path, text, number, gone=False, repo="r"):
    from datetime import datetime

    return (repo, path, "python", text, datetime.fromtimestamp(number or 0), number, gone)


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    run, calls, make = counting(spark, tmp_path)
    flow = Stream(spark, str(tmp_path), make)
    for rows in VERSIONS:
        flow.put(*[version(p, text, n, gone) for _, p, _, text, n, gone in rows])
    state = {(r["file_path"], json.loads(r["summary"])["description"], r["modification_time"].second) for r in stream.summaries(flow.told()).collect()}
    assert state == {("b.py", "TWO", 1), ("d.py", "FOUR", 5)}
    assert calls() == ["a.py", "b.py", "c.py", "d.py"]
    final = documents(spark, {"b.py": ("python", "two"), "d.py": ("python", "four")})
    other = CacheStore(spark, str(tmp_path / "other"))
    incremental.run_batch(final, other, "cfg", run)
    fields = ["file_path", "content_hash", "language", "summary"]
    assert sorted(map(tuple, other.read().select(fields).collect())) == sorted(map(tuple, stream.summaries(flow.told()).select(fields).collect()))


def test_late_versions_deletions_and_failures_of_a_stream(spark, tmp_path):
    _, calls, make = counting(spark, tmp_path)
    flow = Stream(spark, str(tmp_path), make)
    assert flow.put(version("a.py", "new", 5), version("b.py", "x", 3), version("c.py", "bad", 1)) == {"a.py": "NEW", "b.py": "X"}
    assert flow.put(version("a.py", "old", 2), version("b.py", "", 7, True)) == {"a.py": "NEW"}
    assert flow.put(version("b.py", "late", 6), version("a.py", "new", 9)) == {"a.py": "NEW"}
    assert flow.put(version("a.py", "between", 8), version("b.py", "back", 8)) == {"a.py": "NEW", "b.py": "BACK"}
    assert [p for p in calls() if p != "c.py"] == ["a.py", "b.py", "b.py"] and calls().count("c.py") > 1  # asked again on a timer
    assert flow.put(version("c.py", "good", 2)) == {"a.py": "NEW", "b.py": "BACK", "c.py": "GOOD"}
    asked = len(calls())
    assert flow.put(version("d.py", "", 1, True), version("a.py", "late", None)) == {"a.py": "NEW", "b.py": "BACK", "c.py": "GOOD"}
    assert len(calls()) == asked  # no more retries, none for a deletion of what was never there or a row without a version
    assert {(r["file_path"], r["error"]) for r in flow.told().where("error is not null").collect()} == {("c.py", "ValueError: cannot")}
    assert {r["file_path"] for r in flow.told().where("removed").collect()} == {"b.py"}


def test_replayed_versions_change_nothing(spark, tmp_path):
    _, calls, make = counting(spark, tmp_path)
    flow = Stream(spark, str(tmp_path), make)
    flow.put(version("a.py", "one", 1))
    flow.put()
    flow.put(version("a.py", "one", 1), version("a.py", "other", 1))
    assert calls() == ["a.py"] and flow.told().count() == 1


def test_two_streams_and_a_new_configuration(spark, tmp_path):
    _, calls, make = counting(spark, tmp_path)
    one, two = (Stream(spark, str(tmp_path / n), make) for n in ("one", "two"))
    one.put(version("a.py", "one", 1), version("b.py", "two", 4))
    two.put(version("a.py", "later", 2), version("b.py", "", 3, True))
    both = stream.summaries(stream.told(spark, f"{one.folder}/changes", f"{two.folder}/changes"))
    assert {r["file_path"]: json.loads(r["summary"])["description"] for r in both.collect()} == {"a.py": "LATER", "b.py": "TWO"}
    before = len(calls())
    one.config = "cfg-2"
    one.put(version("a.py", "one", 5))
    assert len(calls()) == before + 1
    assert {r["config_hash"] for r in summary_cache.current(stream.summaries(one.told()), "cfg-2").collect()} == {"cfg-2"}


@pytest.mark.parametrize("answer", ['{"a": 1}', '{"error": "x"}', '{"error": null}', '{"error": {"a": [1]}}', "[1]", "oops", "", None, "1", '"x"', "null",
                                    'so:\n```json\n{"a": "```"}\n```', "```\n[1]\n```", '```{"error": "e"}```', '{"error": ""}', '{"error": 5}'])
def test_faults_of_answers_are_the_same_for_streams(spark, answer):
    from arborlens.functions import structured

    column = spark.createDataFrame([(answer,)], "a string").select(structured.parse_summary(F.col("a"), F.lit("p"))["error"]).first()[0]
    assert structured.summary_fault(answer) == column


def test_default_summary(spark):
    docs = documents(spark, {"a.py": ("python", "# head \nimport os, sys\n"), "b.js": ("javascript", "import x from 'y'"), "c.md": ("markdown", "")})
    rows = {r["file_path"]: (r["description"], r["n_lines"], r["n_imports"]) for r in enrich.with_default_summary(docs).collect()}
    assert rows == {"a.py": ("# head", 2, 2), "b.js": ("import x from 'y'", 1, 1), "c.md": ("", 0, 0)}
    summary = enrich.default_enrich(docs).where("file_path = 'a.py'").first()
    assert json.loads(summary["summary"]) == {"file_path": "a.py", "description": "# head", "outline": ["# head "], "n_lines": 2, "n_imports": 2}


def test_outline_covers_the_whole_text(spark):
    text = "\n\n  \nfirst\n" + "x\n" * 5000 + "class A:\n    def b(self):\n# c\nfunctional\nexport const d = 1"
    row = enrich.with_default_summary(documents(spark, {"a.py": ("python", text)})).first()
    assert row["description"] == "first" and row["outline"] == ["class A:", "def b(self):", "# c", "export const d = 1"]


def test_user_functions_get_the_request(spark):
    docs = documents(spark, {"a.py": ("python", "x"), "b.md": (None, "{y}")})
    rows = enrich.enrich(docs, lambda: lambda row: row["request"], template="{file_path}|{language}|{content}")
    assert sorted(r["summary"] for r in rows.collect()) == ["a.py|python|x", "b.md||{y}"]
    from arborlens.functions import structured
    plain = docs.select(structured.request_text(F.col("file_path"), F.col("language"), F.col("content")).alias("t")).collect()
    assert {r["t"] for r in plain} == {r["summary"] for r in enrich.enrich(docs, lambda: lambda row: row["request"]).collect()}


@pytest.mark.parametrize("partitions", [1, 7])
def test_enrichment_does_not_depend_on_partitions(spark, tmp_path, partitions):
    run, calls, _ = counting(spark, tmp_path)
    docs = documents(spark, {f"f{i}": ("go", f"t{i}" if i % 3 else "bad") for i in range(20)}).repartition(partitions)
    rows = run(docs).collect()
    assert len(rows) == 20 and sum(r["error"] is not None for r in rows) == 7


def test_reports_of_other_repositories_stay(spark, tmp_path):
    from arborlens.sources.sinks import read_reports, write_reports

    both = spark.createDataFrame([("a", "one"), ("b", "two")], "repo_id string, report string")
    write_reports(both, str(tmp_path / "r"), "report")
    write_reports(spark.createDataFrame([("a", "new")], both.schema), str(tmp_path / "r"), "report", force=True)
    assert {tuple(r) for r in read_reports(spark, str(tmp_path / "r")).collect()} == {("a", "new"), ("b", "two")}


def test_long_lists_stay_whole():
    from arborlens.operators.rollup import as_lines

    items = [f"item {i} " + "x" * 100 for i in range(5000)]
    assert as_lines(".", items).split("\n") == items


def test_shared_folder_is_asked_for_on_a_cluster(spark):
    from types import SimpleNamespace

    from arborlens.session import shared_folder

    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(ValueError):
        shared_folder(SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=context))


def test_few_rows_of_a_batch_are_python_values_at_a_time():
    import pyarrow as pa

    class Rows:
        def mapInArrow(self, run, schema):
            return run

    asked = []
    run = enrich.enrich(Rows(), lambda: lambda row: asked.append(row) or row["request"], template="{content}")
    when = pa.array([1_000_000] * 1000, pa.timestamp("us", "UTC"))
    batch = pa.RecordBatch.from_arrays(
        [pa.array(["r"] * 1000), pa.array([f"f{i}" for i in range(1000)]), pa.array([None] + [f"t{i}" for i in range(1, 1000)]), when],
        names=["repo_id", "file_path", "content", "modification_time"])
    made = run(iter([batch]))
    first = next(made)
    assert len(asked) == first.num_rows == enrich.ROWS_AT_ONCE < 1000
    rows = [first, *made]
    assert [s for r in rows for s in r.column(2).to_pylist()] == ["", *(f"t{i}" for i in range(1, 1000))]
    assert asked[0]["modification_time"].tzinfo is None


def test_a_new_file_asks_the_state_store_twice():
    from types import SimpleNamespace

    asked = []

    class Value:
        def __init__(self, name):
            self.name, self.held = name, None

        def exists(self):
            asked.append((self.name, "exists"))
            return self.held is not None

        def get(self):
            asked.append((self.name, "get"))
            return self.held

        def update(self, value):
            asked.append((self.name, "update"))
            self.held = value

        def clear(self):
            asked.append((self.name, "clear"))
            self.held = None

    states = {}
    describe = stream.Describe(lambda: lambda row: json.dumps({"file_path": row["file_path"], "description": row["content"]}), "cfg")
    describe.init(SimpleNamespace(getValueState=lambda name, schema: states.setdefault(name, Value(name))))

    def put(text, number):
        del asked[:]
        row = {"language": "python", "content": text, "content_hash": text, "modification_time": None, "version": number, "deleted": False}
        return [r["version"] for r in describe.handleInputRows(("r", "a.py"), iter([row]), None)]

    assert put("one", 1) == [1] and asked == [("known", "get"), ("known", "update")]
    assert put("one", 1) == [] and asked == [("known", "get")]
    states["waiting"].held = ("python", "old", "old", None, 1)
    assert put("two", 2) == [2] and ("waiting", "clear") in asked and states["waiting"].held is None


def test_state_of_a_bucket_is_asked_for_once_for_all_its_files():
    from types import SimpleNamespace

    asked, timers = [], []

    class State(dict):
        def __init__(self, name):
            self.name, self.held = name, None

        def get(self):
            asked.append((self.name, "get"))
            return self.held

        def update(self, value):
            asked.append((self.name, "update"))
            self.held = value

        def getValue(self, key):
            return self[key]

        def updateValue(self, key, value):
            self[key] = value

        def removeKey(self, key):
            del self[key]

    def answer(row):
        if row["content"] == "bad":
            raise ValueError("cannot")
        return json.dumps({"file_path": row["file_path"], "description": row["content"]})

    texts = State("texts")
    files = State("files")
    describe = stream.DescribeBucket(lambda: answer, "cfg", 10)
    describe.init(SimpleNamespace(getValueState=lambda name, schema: files, getMapState=lambda name, key, value: texts, registerTimer=timers.append))
    now = SimpleNamespace(getCurrentProcessingTimeInMs=lambda: time)

    def put(*rows):
        del asked[:]
        rows = [{"repo_id": "r", "file_path": p, "language": "python", "content": t, "content_hash": t, "modification_time": None,
                 "version": n, "deleted": t is None} for p, t, n in rows]
        return {r["file_path"]: "removed" if r["removed"] else r["error"] or r["version"] for r in describe.handleInputRows((0,), iter(rows), now)}

    def expire(at):
        return [r["file_path"] for r in describe.handleExpiredTimer((0,), now, SimpleNamespace(getExpiryTimeInMs=lambda: at))]

    time = 100
    assert put(*((f"f{i}", "text", 1) for i in range(50)), ("f7", "later", 3), ("f7", "between", 2)) == {f"f{i}": 3 if i == 7 else 1 for i in range(50)}
    assert asked == [("files", "get"), ("files", "update")]
    assert put(("f7", "late", 2), ("f8", "text", 1)) == {} and asked == [("files", "get")]
    failed = "ValueError: cannot"
    assert put(("f1", "bad", 2), ("f2", "bad", 2), ("f3", None, 2)) == {"f1": failed, "f2": failed, "f3": "removed"} and timers == [110]
    time = 105
    assert put(("f4", "bad", 2), ("f2", "good", 3)) == {"f4": failed, "f2": 3} and timers == [110, 115] and len(texts) == 2
    time = 111
    assert expire(110) == ["f1"] and timers == [110, 115, 121]  # the other one is not due yet, the third has had a later version
    assert put(("f1", None, 5), ("f4", "good", 4)) == {"f1": "removed", "f4": 4} and not texts
    assert expire(115) == [] == expire(121)


def test_files_of_one_bucket_go_their_own_ways(spark, tmp_path):
    _, calls, make = counting(spark, tmp_path)

    def put(*rows):
        spark.createDataFrame(rows, stream.VERSIONS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/versions")
        versions = spark.readStream.schema(stream.VERSIONS).parquet(f"{tmp_path}/versions")
        query = stream.start(versions, f"{tmp_path}/changes", "cfg", f"{tmp_path}/checkpoint", make, buckets=1)
        assert query.awaitTermination(60) and query.exception() is None
        rows = stream.summaries(stream.told(spark, f"{tmp_path}/changes")).collect()
        return {(r["repo_id"], r["file_path"]): json.loads(r["summary"])["description"] for r in rows}

    first = put(version("a.py", "one", 1), version("b.py", "bad", 1), version("a.py", "two", 2, repo="s"), version("a.py", "three", 3, repo="s"))
    assert first == {("r", "a.py"): "ONE", ("s", "a.py"): "THREE"}
    assert put(version("b.py", "good", 2), version("a.py", "", 4, True), version("a.py", "three", 5, repo="s")) == {("r", "b.py"): "GOOD", ("s", "a.py"): "THREE"}
    assert [p for p in calls() if p != "b.py"] == ["a.py", "a.py"]
    assert {r["file_path"] for r in stream.told(spark, f"{tmp_path}/changes").where("error is not null").collect()} == {"b.py"}
