"""One query per operator over the given tables."""

import json
import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlens import fixed_values as V
from arborlens.functions import content, globs, imports, language, paths, structured
from arborlens.operators import enrich, graph, manifest, refine, report, rollup, select, summary_cache, tree, watch
from arborlens.plans import incremental
from arborlens.plans.traverse import Traversal, traverse
from arborlens.session import fresh_folder, shared_folder
from arborlens.sources import corpus, ignore_files, sinks
from arborlens.sources.cache_store import CacheStore
from arborlens.streaming import incremental as stream
from checks.views import table, view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

INCLUDE = ["*.json", "src/m8*", "node_modules/pkg/*"]
EXCLUDE = ["*/m9*", "m1?.mjs", "docs/m[3-5]3.*"]
GLOBS = ["src/*.js", "*.md", "m[1-3]?.*", "docs/m*[!5].txt"]
SMALL_KB = 4


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def c(name: str):
    return F.col(name)


def walk(spark: SparkSession, sf: str, max_kb: int | None = V.DEFAULT_MAX_KB) -> Traversal:
    return traverse(view(spark, sf, "vrepo", spread=True), INCLUDE, EXCLUDE, max_kb)


# ---- sources and sinks -------------------------------------------------------

def _write_files(files: DataFrame, top: str) -> None:
    """Write ``content`` to ``top/repo_id/relative_path`` from the tasks."""
    top = corpus.local_path(top)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for repo, relative, text in zip(batch["repo_id"], batch["relative_path"], batch["content"]):
                target = os.path.join(top, repo, relative)
                os.makedirs(os.path.dirname(target), exist_ok=True)
                with open(target, "w", encoding="utf-8", newline="") as handle:
                    handle.write(text)
            yield pd.DataFrame({"n": [len(batch)]})

    files.select("repo_id", "relative_path", "content").mapInPandas(write, "n bigint").agg(F.sum("n")).collect()


@query
def corpus_scan(spark, sf):
    top = fresh_folder(spark, "corpus")
    _write_files(view(spark, sf, "vfiles", spread=True), top)
    listing = corpus.scan(spark, {"all": top}).where(~c("is_dir"))
    return corpus.read_content(listing).select(
        "repo_id", "relative_path", "length", content.content_hash(c("content")).alias("hash"), "is_link")


@query
def multi_root_scan(spark, sf):
    top = fresh_folder(spark, "roots")
    files = view(spark, sf, "vfiles", spread=True)
    _write_files(files, top)
    # The roots are an argument of the scan; here they are the repositories written.
    roots = files.select("repo_id").distinct().select("repo_id", F.concat(F.lit(f"{top}/"), "repo_id").alias("root"))
    listing = corpus.scan(spark, roots)
    return listing.select("repo_id", "relative_path", "length", "is_dir")


@query
def decode_text(spark, sf):
    text = content.decode(c("content"))
    return view(spark, sf, "vlines", spread=True).select("doc_id", text.alias("text")).withColumn(
        "error", F.when(c("text").isNull(), V.ENCODING))


def _rule_lines(repos: DataFrame) -> DataFrame:
    """Ignore lines of each repository, three kinds of sets."""
    number = F.substr("repo_id", F.lit(2)).cast("bigint")
    lines = F.when(number % 3 == 0, F.array(*map(F.lit, ["# notes", "*.md", "!m3.md", "docs/"]))) \
        .when(number % 3 == 1, F.array(*map(F.lit, ["src/**/m1*", "/m4?.ts", "", "*.lock  "]))) \
        .otherwise(F.array(*map(F.lit, ["src/*", "!src/utils/", "**/pkg/m2[0-5].py", "\\!x"])))
    return repos.select("repo_id", F.posexplode(lines).alias("ord", "pattern"))


@query
def ignore_rules(spark, sf):
    top = fresh_folder(spark, "ignore")
    repos = view(spark, sf, "vrepo").select("repo_id").distinct()
    lines = _rule_lines(repos)
    name = F.when(c("ord") < 2, ".gitignore").otherwise(".git/info/exclude")
    files = lines.groupBy("repo_id", name.alias("relative_path")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "pattern"))), lambda x: x["pattern"]), "\n").alias("t")
    ).select("repo_id", "relative_path", F.concat("t", F.lit("\n")).alias("content"))
    _write_files(files, top)
    roots = repos.select("repo_id", F.concat(F.lit(top + "/"), "repo_id").alias("root"))
    return ignore_files.rule_lines(roots).select("repo_id", c("ord").cast("bigint").alias("ord"), "pattern")


@query
def cache_validate(spark, sf):
    stored = view(spark, sf, "vstored")
    sound = stored.select("repo_id", summary_cache.valid_document(c("raw")).alias("valid"))
    found = summary_cache.entries(stored).select("repo_id", "file_path", "language")
    return sound.join(found, "repo_id", "left")


@query
def cache_write(spark, sf):
    store = CacheStore(spark, fresh_folder(spark, "cache"))
    first = view(spark, sf, "vcache").withColumn("modification_time", F.lit(None).cast("timestamp"))
    store.write(first)
    changed = store.read().where(c("content_hash") == "old").withColumn("summary", F.lit("new"))
    store.write(summary_cache.upsert(store.read(), changed))
    return store.read().select("repo_id", "file_path", "content_hash", "language", "summary", "config_hash")


@query
def documents_table(spark, sf):
    path = fresh_folder(spark, "documents")
    run = walk(spark, sf)
    sinks.write_documents(run.documents, path, names=run.judged)
    return spark.read.parquet(path)


@query
def report_write(spark, sf):
    path = fresh_folder(spark, "reports")
    docs = view(spark, sf, "vcode", spread=True)
    shared_folder(spark)
    sinks.write_reports(graph.overview(_degrees(docs).checkpoint()), path, "overview")
    return sinks.read_reports(spark, path).select("repo_id", c("report").alias("text"))


# ---- projections -------------------------------------------------------------

@query
def path_parts(spark, sf):
    full = F.concat(F.lit("/Repo/"), "repo_id", F.lit("/"), "relative_path")
    files = view(spark, sf, "vrepo").select(
        "repo_id", paths.relative_to(full, F.concat(F.lit("/Repo/"), "repo_id")).alias("relative_path"))
    return select.with_path_parts(files)


@query
def file_metadata(spark, sf):
    files = view(spark, sf, "vrepo").withColumn("length", F.when(c("doc_id") % 2 == 0, c("length")))
    return select.with_metadata(files).select("repo_id", "relative_path", "file_name", "file_type", "file_size")


@query
def repo_name(spark, sf):
    return table(spark, sf, "pages").select("page_id", paths.repository_name(c("url")).alias("name"))


@query
def source_kind(spark, sf):
    url = F.when(c("page_id") % 2 == 0, F.concat(F.lit("https://github.com/x/"), c("page_id").cast("string"))).otherwise(c("url"))
    return table(spark, sf, "pages").select("page_id", paths.source_kind(url).alias("kind"))


@query
def format_size(spark, sf):
    sizes = F.array(c("length"), c("length") * 16, c("length") * 4096 + 1)
    return view(spark, sf, "vrepo").select("doc_id", F.explode(sizes).alias("size")).select(
        "doc_id", "size", content.format_size(c("size")).alias("text"))


@query
def token_estimate(spark, sf):
    return view(spark, sf, "vrepo").select("doc_id", content.tokens(c("content")).alias("tokens"))


@query
def content_hash(spark, sf):
    return view(spark, sf, "vrepo").select("doc_id", content.content_hash(c("content")).alias("hash"))


@query
def config_hash(spark, sf):
    settings = table(spark, sf, "documents").select("source", "lang").distinct()
    none = F.lit(None).cast("string")
    return settings.select("source", "lang", structured.config_hash_column(c("source"), c("lang"), none).alias("hash"))


@query
def request_text(spark, sf):
    return view(spark, sf, "vrepo").select(
        "doc_id", structured.request_text(c("relative_path"), c("file_type"), c("content")).alias("request"))


# ---- filters -----------------------------------------------------------------

@query
def glob_filter(spark, sf):
    path = paths.normalise(c("relative_path"))
    return view(spark, sf, "vrepo").select(
        "doc_id", globs.any_glob(path, paths.base_name(path), GLOBS).alias("matched"))


@query
def file_filter(spark, sf):
    from arborlens.functions.rules import file_reason

    files = view(spark, sf, "vrepo").withColumn(
        "relative_path",
        F.when(c("doc_id") % 25 == 7, "a/yarn.lock").when(c("doc_id") % 25 == 8, "package-lock.json")
        .otherwise(c("relative_path")))
    return files.select("doc_id", file_reason(
        c("relative_path"), c("length"), INCLUDE + ["package-lock.json"], EXCLUDE, SMALL_KB).alias("reason_code"))


@query
def size_filter(spark, sf):
    from arborlens.functions.rules import size_detail, size_reason

    length = F.when(c("doc_id") % 10 != 9, c("length"))
    return view(spark, sf, "vrepo").select(
        "doc_id", size_reason(length, SMALL_KB).alias("reason_code"), size_detail(length, SMALL_KB).alias("reason_detail"))


@query
def ignore_filter(spark, sf):
    files = view(spark, sf, "vrepo").select("repo_id", "relative_path")
    lines = _rule_lines(files.select("repo_id").distinct())
    return select.with_ignore_verdicts(files, lines).select("repo_id", "relative_path", c("_ignored").alias("ignored"))


@query
def ignore_prune(spark, sf):
    """Directories and files that the ignore lines of their repository reject."""
    files = view(spark, sf, "vrepo").select("repo_id", "relative_path", "length")
    lines = _rule_lines(files.select("repo_id").distinct())
    judged = select.judge(files, include=["*"], max_kb=None, ignore_rules=lines)
    own = judged.where(c("pruned_dir").isNull() & c("reason_code").isNotNull()).select("repo_id", "relative_path", "reason_code")
    return select.pruned_directories(judged).select("repo_id", "relative_path", "reason_code").unionByName(own)


@query
def dir_prune(spark, sf):
    judged = select.judge(view(spark, sf, "vrepo"), INCLUDE, EXCLUDE + ["docs"])
    files = judged.where(c("pruned_dir").isNull()).select("repo_id", "relative_path", "reason_code")
    return select.pruned_directories(judged).select("repo_id", "relative_path", "reason_code").unionByName(files)


@query
def binary_filter(spark, sf):
    return view(spark, sf, "vbytes", spread=True).select("doc_id", content.is_binary(c("content")).alias("is_binary"))


@query
def manifest_alias(spark, sf):
    rows = view(spark, sf, "vmanifest").withColumn("length", F.lit(None).cast("bigint")).withColumn("reason_code", F.lit(None).cast("string"))
    tops = rows.select("repo_id", F.concat(F.lit("/repo/"), "repo_id").alias("top")).distinct()
    judged = manifest.judge_links(rows, tops)
    return judged.where(~F.coalesce(c("pruned_dir") == "pruned", F.lit(False))).select("repo_id", "relative_path", "reason_code")


# ---- cache -------------------------------------------------------------------

def _cache_documents(spark, sf) -> DataFrame:
    return view(spark, sf, "vrepo").select(
        "doc_id", "repo_id", c("relative_path").alias("file_path"), c("file_type").alias("language"), "content")


@query
def cache_lookup(spark, sf):
    keys = summary_cache.keyed(_cache_documents(spark, sf))
    return summary_cache.lookup(keys, view(spark, sf, "vcache"), "cfg-a").select("repo_id", "file_path", "summary")


@query
def cache_miss(spark, sf):
    keys = summary_cache.keyed(_cache_documents(spark, sf))
    return summary_cache.misses(keys, view(spark, sf, "vcache"), "cfg-a")


def _moved(docs, of, rest, folder):
    """Documents of which some lie in another folder now, so that their old places are gone."""
    moved = F.concat(F.lit(folder), c("file_path"))
    return docs.withColumn("file_path", F.when(c("doc_id") % of == rest, moved).otherwise(c("file_path")))


@query
def cache_stale(spark, sf):
    docs = _moved(_cache_documents(spark, sf), 7, 0, "moved/")
    known = summary_cache.compare(summary_cache.keyed(docs), view(spark, sf, "vcache"))
    return known.where(c("cached").isNotNull()).select(
        "repo_id", "file_path", F.when(c("state") == summary_cache.STALE, "stale").otherwise("kept").alias("state"))


@query
def cache_invalidate(spark, sf):
    return summary_cache.current(view(spark, sf, "vcache"), "cfg-a").select("repo_id", "file_path", "summary")


@query
def cache_upsert(spark, sf):
    cache = view(spark, sf, "vcache")
    docs = _moved(_cache_documents(spark, sf), 4, 3, "new/")
    rows = summary_cache.keyed(docs.withColumn("n", c("doc_id"))).join(
        docs.select("repo_id", "file_path", "doc_id"), ["repo_id", "file_path"])
    writes = rows.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("ord")).select(
        "repo_id", "file_path", "content_hash", "language",
        F.concat(F.lit("n"), c("doc_id").cast("string"), F.lit("v"), c("ord").cast("string")).alias("summary"),
        F.lit("cfg-a").alias("config_hash"), F.lit("1.0").alias("schema_version"),
        F.when(c("doc_id") % 8 == 5, "failed").alias("error"), "ord")
    return summary_cache.upsert(cache, writes, "ord").select("repo_id", "file_path", "content_hash", "summary")


@query
def incremental_run(spark, sf):
    docs = _moved(_cache_documents(spark, sf), 7, 0, "moved/")
    store = CacheStore(spark, fresh_folder(spark, "cache"))
    store.write(view(spark, sf, "vcache").withColumn("modification_time", F.lit(None).cast("timestamp")))
    incremental.run_batch(docs, store, "cfg-a")
    said = F.coalesce(F.get_json_object("summary", "$.description"), c("summary"))
    return store.read().select("repo_id", "file_path", "content_hash", "language", said.alias("said"), "config_hash")


def _counted() -> Callable[[dict], str]:
    return lambda row: json.dumps({"file_path": row["file_path"], "description": f"{len(row['content'])} characters"})


@query
def stream_run(spark, sf):
    """Three tables of versions, one after the other: all files, new texts of some (some late), deletions of some."""
    folder = fresh_folder(spark, "stream")
    docs = _cache_documents(spark, sf)

    def put(rows, version, deleted=False):
        rows.select("repo_id", "file_path", "language", "content", F.lit(None).cast("timestamp").alias("modification_time"),
                    version.cast("bigint").alias("version"), F.lit(deleted).alias("deleted")).write.mode("append").parquet(f"{folder}/versions")
        versions = spark.readStream.schema(stream.VERSIONS).parquet(f"{folder}/versions")
        stream.start(versions, f"{folder}/changes", "cfg-a", f"{folder}/checkpoint", _counted).awaitTermination()

    put(docs, F.lit(2))
    put(docs.where(c("doc_id") % 5 < 2).withColumn("content", F.concat("content", F.lit("!"))), c("doc_id") % 5 * 2 + 1)
    put(docs.where(c("doc_id") % 7 == 0), F.lit(4), deleted=True)
    return stream.summaries(stream.told(spark, f"{folder}/changes")).select(
        "repo_id", "file_path", "content_hash", F.get_json_object("summary", "$.description").alias("said"))


# ---- language ----------------------------------------------------------------

@query
def lang_ext(spark, sf):
    return view(spark, sf, "vrepo").select("doc_id", language.by_extension(c("file_name")).alias("language"))


_NAMES = ["Makefile", "DOCKERFILE", "Gemfile.lock", "x/CMakeLists.txt", "other"]


@query
def lang_name(spark, sf):
    name = F.element_at(F.array(*map(F.lit, _NAMES)), (c("doc_id") % len(_NAMES) + 1).cast("int"))
    return table(spark, sf, "documents").select("doc_id", language.by_name(name).alias("language"))


_LINES = ["#!/usr/bin/env python3.12 -u", "  #! /bin/sh", "#!/usr/bin/env deno", "#!/bin/deno", "#!/usr/local/bin/python",
          "#!/usr/bin/tclsh", "#!/usr/bin/env tclsh", "#!/usr/bin/pythonic", "\t#!/bin/bash -e", "print(1)"]


@query
def lang_shebang(spark, sf):
    first = F.element_at(F.array(*map(F.lit, _LINES)), (c("doc_id") % len(_LINES) + 1).cast("int"))
    text = F.concat(first, F.lit("\n"), "text")
    return table(spark, sf, "documents").select("doc_id", language.by_shebang(text).alias("language"))


@query
def lang_content(spark, sf):
    return view(spark, sf, "vcode", spread=True).select("doc_id", language.sample(c("content")).alias("s")).select(
        "doc_id", language.by_content(c("s")).alias("language"))


@query
def lang_detect(spark, sf):
    return select.with_language(view(spark, sf, "vrepo", spread=True)).select("repo_id", "relative_path", "language")


@query
def lang_sample(spark, sf):
    return view(spark, sf, "vbytes", spread=True).select("doc_id", content.language_sample(c("content")).alias("sample"))


# ---- imports and graph -------------------------------------------------------

def _degrees(docs: DataFrame) -> DataFrame:
    return graph.degrees(graph.links(docs))


def _degree_view(spark, sf) -> DataFrame:
    return _degrees(view(spark, sf, "vcode", spread=True))


@query
def py_imports(spark, sf):
    return graph.import_list(view(spark, sf, "vcode", spread=True), "python").withColumn("pos", c("pos").cast("bigint"))


@query
def js_imports(spark, sf):
    return graph.import_list(view(spark, sf, "vcode", spread=True), "javascript").withColumn("pos", c("pos").cast("bigint"))


@query
def py_edges(spark, sf):
    docs = view(spark, sf, "vcode", spread=True)
    return graph.edges(docs).where(F.endswith(F.lower("src"), F.lit(".py")))


@query
def js_edges(spark, sf):
    docs = view(spark, sf, "vcode", spread=True)
    return graph.edges(docs).where(~F.endswith(F.lower("src"), F.lit(".py")))


@query
def graph_edges(spark, sf):
    return graph.edges(view(spark, sf, "vcode", spread=True))


@query
def graph_nodes(spark, sf):
    docs = view(spark, sf, "vcode", spread=True)
    return graph.nodes(graph.links(docs))


@query
def graph_degree(spark, sf):
    return _degree_view(spark, sf)


@query
def graph_stats(spark, sf):
    return graph.statistics(_degree_view(spark, sf), ["repo_id"])


@query
def graph_adjacency(spark, sf):
    return graph.neighbours(graph.edges(view(spark, sf, "vcode", spread=True)))


@query
def graph_entry(spark, sf):
    return graph.entry_points(_degree_view(spark, sf)).select("repo_id", "path")


@query
def graph_isolated(spark, sf):
    return graph.isolated(_degree_view(spark, sf)).select("repo_id", "path")


@query
def graph_leaf(spark, sf):
    return graph.leaves(_degree_view(spark, sf)).select("repo_id", "path")


@query
def graph_core(spark, sf):
    return graph.core_modules(_degree_view(spark, sf)).withColumn("rank", c("rank").cast("bigint"))


@query
def graph_report(spark, sf):
    shared_folder(spark)
    return graph.overview(_degree_view(spark, sf).checkpoint())


@query
def append_section(spark, sf):
    texts = table(spark, sf, "documents").select(
        "doc_id",
        F.concat("text", F.when(c("doc_id") % 3 == 0, V.OVERVIEW_HEADING).otherwise(" \n\t\n")).alias("t"),
        F.when(c("doc_id") % 5 == 0, "").otherwise(F.concat(F.lit(V.OVERVIEW_HEADING + "\n"), "source")).alias("s"))
    return texts.select("doc_id", graph.append_section(c("t"), c("s")).alias("text"))


# ---- reports, roll-up, loop --------------------------------------------------

@query
def cost_estimate(spark, sf):
    return report.cost(view(spark, sf, "vrepo"), ["repo_id"])


@query
def skip_summary(spark, sf):
    return report.skip_counts(walk(spark, sf, SMALL_KB).loaded)


@query
def dry_run(spark, sf):
    return walk(spark, sf).dry_run


@query
def progress_events(spark, sf):
    return report.progress(_with_failures(spark, sf).outcomes)


def _with_failures(spark, sf) -> Traversal:
    """Some files could not be read, for a known reason or another."""
    failure = F.when(c("doc_id") % 20 == 3, f"{V.UNEXPECTED}: the disk fell").when(c("doc_id") % 20 == 13, f"{V.PERMISSION_ERROR}: no")
    return traverse(view(spark, sf, "vrepo", spread=True).withColumn("read_error", failure), INCLUDE, EXCLUDE, SMALL_KB)


def _strict_observer() -> Callable[[dict], None]:
    def see(event):
        if event["event_type"] == "file_completed" and event["relative_path"].endswith(".js"):
            raise ValueError("no scripts")
    return see


@query
def observer_events(spark, sf):
    events = watch.with_events(_with_failures(spark, sf).outcomes).select(*watch.EVENT)
    return watch.tell_each(events, _strict_observer)


@query
def tree_and_files(spark, sf):
    kept = select.judge(view(spark, sf, "vrepo"), INCLUDE, EXCLUDE).where("reason_code is null")
    return tree.tree_and_files(kept, per_piece=25)


@query
def tree_lines(spark, sf):
    return tree.lines(select.judge(view(spark, sf, "vrepo"), INCLUDE, EXCLUDE).where("reason_code is null"))


@query
def dir_tree(spark, sf):
    return rollup.tree_facts(rollup.usable(view(spark, sf, "vsummary")))


@query
def dir_summaries(spark, sf):
    files = view(spark, sf, "vsummary").withColumn("summary", F.to_json(F.struct("file_path", "description")))
    return rollup.summarise_directories(files, per_call=4).select("repo_id", "dir", F.get_json_object("summary", "$.description").alias("said"), "error")


@query
def dir_rollup(spark, sf):
    return rollup.roll_up(view(spark, sf, "vsummary"))


@query
def enrich_rows(spark, sf):
    docs = view(spark, sf, "vcode", spread=True).withColumn("file_path", c("relative_path"))
    return enrich.with_default_summary(docs).select("repo_id", "file_path", "description", "n_lines", "n_imports", F.array_join("outline", "|").alias("outline"))


def _answers() -> Callable[[dict], str]:
    """Good, fenced, broken and failing answers, by the digits of the name; they tell how long the request was."""
    def answer(row):
        kind = sum(map(int, filter(str.isdigit, row["file_path"]))) % 5
        said = json.dumps({"file_path": row["file_path"], "description": f"{len(row['request'])} characters"})
        if kind == 3:
            raise RuntimeError("busy")
        return (said, f"Here:\n```json\n{said}\n```", "no JSON", "", '{"error": "too long"}')[kind]
    return answer


@query
def enrich_udf(spark, sf):
    docs = _cache_documents(spark, sf).repartition(spark.sparkContext.defaultParallelism, "repo_id", "file_path")
    rows = enrich.enrich(docs.drop("doc_id"), _answers, template="{file_path} in {language}: {content}")
    said = structured.parse_summary(c("summary"), c("file_path"))
    return rows.select("repo_id", "file_path", F.coalesce("error", said["error"]).alias("error"), F.when(c("error").isNull(), said["description"]).alias("said"))


@query
def parse_summary(spark, sf):
    parsed = structured.parse_summary(c("answer"), c("path"))
    return view(spark, sf, "vanswers").select("doc_id", parsed.alias("p")).select(
        "doc_id", "p.file_path", "p.description", "p.error")


@query
def parse_review(spark, sf):
    return view(spark, sf, "vreviews").select("event_id", structured.parse_review(c("answer")).alias("r")).select(
        "event_id", "r.score", "r.feedback", "r.error")


@query
def refine_best(spark, sf):
    return refine.best_attempts(view(spark, sf, "vattempts"))


def _draft(row: dict) -> str:
    """A text that grows with each round; deterministic."""
    return f"{row['latest']}{row['repo_id']}:{row['n']}:{row['iteration']};"


def _mark(text: str) -> tuple[float, str]:
    score = sum(text.encode()) % 100 / 10
    return score, f"scored {len(text)}"


@query
def refine_loop(spark, sf):
    shared_folder(spark)
    keys = table(spark, sf, "documents").select(
        c("doc_id").alias("k"), c("source").alias("repo_id"), F.length("text").cast("bigint").alias("n"))
    return refine.refine(keys, _draft, _mark).select(
        "k", c("iteration").cast("bigint").alias("iteration"), "score", "feedback", "text")
