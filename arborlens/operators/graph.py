"""Import graph: requests, resolution, nodes, edges, degrees and reports.

A request asks for a key (a path without its ending). Every file offers the
keys under which it can be found, and the best offer per key is worked out
once. Resolution is then one equi-join against a side that is unique on the
key; a hub that most files import is split by the adaptive skew join.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arborlens import fixed_values as V
from arborlens.functions import imports, language, paths
from arborlens.functions.content import tenths
from arborlens.functions.text import rstrip

FILE = ["repo_id", "path"]
# Where a key is looked for: script paths, beside the file, below package roots.
SCRIPT, NEAR, FAR = 0, 1, 2
OFFERS = "array<struct<scope: int, key: string, root: string, rank: int>>"


def sources(documents: DataFrame, text: str = "content") -> DataFrame:
    """Files whose imports are read: known ending, some text, a path."""
    body, path = F.col(text), F.col("relative_path")
    lang = language.graph_language(paths.extension(paths.base_name(path)))
    return documents.select(
        "repo_id", path.alias("path"), lang.alias("language"), body.alias("content")
    ).where(F.col("language").isNotNull() & (F.length("content") > 0) & (F.col("path") != ""))


def import_list(documents: DataFrame, language_name: str, wide: bool = False) -> DataFrame:
    """Modules named by each file, in statement order."""
    files = sources(documents)
    if language_name == "python":
        found = imports.python_imports(F.col("content"))
        files = files.where(F.col("language") == "python")
    else:
        found = imports.script_imports(F.col("content"), wide)
        files = files.where(F.col("language") != "python")
    return files.select(*FILE, F.posexplode(found).alias("pos", "module"))


# ---- requests ----------------------------------------------------------------

def _under(base: Column, rest: Column) -> Column:
    return F.when(base == "", rest).otherwise(F.concat(base, F.lit("/"), rest))


def resolve_dots(path: Column) -> Column:
    """Path without ``.`` and ``..`` parts; null if it leaves the repository."""
    parts = F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))
    walked = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda done, part: F.when(part != "..", F.concat(done, F.array(part)))
        .when(F.size(done) > 0, F.slice(done, F.lit(1), F.size(done) - 1)),
    )
    return F.array_join(walked, "/")


def _slot(scope: int, key: Column) -> Column:
    return F.struct(F.lit(scope).alias("scope"), key.alias("key"))


def _python_slots(module: Column, dots: Column, home: Column, package_roots: bool) -> Column:
    tail = F.replace(F.substr(module, dots + 1), F.lit("."), F.lit("/"))
    parts = F.split(home, "/")
    left = F.greatest(F.size(parts) - F.greatest(dots - 1, F.lit(0)), F.lit(0))
    base = F.array_join(F.slice(parts, F.lit(1), left), "/")
    near = _slot(NEAR, _under(base, tail))
    if not package_roots:
        return F.array(near)
    return F.when(dots == 0, F.array(near, _slot(FAR, tail))).otherwise(F.array(near))


def _script_slots(module: Column, home: Column) -> Column:
    clean = F.substring_index(F.substring_index(module, "?", 1), "#", 1)
    key = resolve_dots(F.concat(home, F.lit("/"), clean))
    return F.when(key.isNotNull(), F.array(_slot(SCRIPT, key)))


def requests(documents: DataFrame, wide: bool = False, package_roots: bool = True) -> DataFrame:
    """Keys asked for: ``(repo_id, path, module, scope, key)``.

    Texts are read in one pass for both kinds of files. Modules that can never
    name a file here are dropped at once. Every file also asks, as module '',
    for a key that nothing offers; that row keeps files without imports, and
    spreads as its key is the file's own path.
    """
    body, module = F.col("content"), F.col("module")
    python = F.col("language") == "python"
    named = F.when(
        python,
        F.filter(imports.python_requests(body), lambda m: (m != "") & ~F.startswith(m, F.lit("_"))),
    ).otherwise(F.filter(
        imports.script_requests(body, wide), lambda m: F.startswith(m, F.lit("."))
    ))
    asked = sources(documents).select(
        *FILE, "language", F.explode(F.array_append(named, F.lit(""))).alias("module")
    ).withColumns({
        "dots": F.length(F.regexp_extract(module, r"\A(\.*)", 1)),
        "home": paths.parent(F.col("path")),
    })
    dots, home = F.col("dots"), F.col("home")
    slots = (
        F.when(module == "", F.array(_slot(SCRIPT, F.concat(F.lit("\x01"), F.col("path")))))
        .when(python, _python_slots(module, dots, home, package_roots))
        .otherwise(_script_slots(module, home))
    )
    return asked.select(*FILE, "module", F.inline(slots))


# ---- offers ------------------------------------------------------------------

def _offer(scope: int, key: Column, rank: int | Column, root: Column | None = None) -> Column:
    rank = F.lit(rank) if isinstance(rank, int) else rank
    return F.struct(
        F.lit(scope).alias("scope"), key.alias("key"),
        (F.lit("") if root is None else root).alias("root"), rank.alias("rank"),
    )


def _seen_from_roots(offer: Column) -> Column:
    """An offer from every directory above it, as a package root."""
    key = offer["key"]

    def from_root(level: Column) -> Column:
        root = F.call_function("substring_index", key, F.lit("/"), level)
        tail = F.when(level == 0, key).otherwise(F.substr(key, F.length(root) + 2))
        return _offer(FAR, tail, offer["rank"], root)

    return F.transform(F.sequence(F.lit(0), paths.depth(key)), from_root)


def offers(documents: DataFrame, package_roots: bool = True) -> DataFrame:
    """The best file for each key: ``(repo_id, scope, key, target)``, unique on the key.

    A script answers to its path with and without ending, a folder by its index
    file. A package answers before a module of the same name, and the first
    package root by name before the others.
    """
    path = F.col("relative_path")
    name = paths.base_name(path)
    endings = [
        F.when(F.endswith(path, F.lit(e)),
               _offer(SCRIPT, F.substr(path, F.lit(1), F.length(path) - len(e)), i))
        for i, e in enumerate(V.SCRIPT_ENDINGS)
    ]
    indexes = [
        F.when(name == n, _offer(SCRIPT, paths.parent(path), len(V.SCRIPT_ENDINGS) + i))
        for i, n in enumerate(V.SCRIPT_INDEXES)
    ]
    python = F.when(F.endswith(path, F.lit(".py")), F.array_compact(F.array(
        F.when(name == "__init__.py", _offer(NEAR, paths.parent(path), 0)),
        _offer(NEAR, F.regexp_replace(path, r"\.py\z", ""), 1),
    ))).otherwise(F.array().cast(OFFERS))
    script = F.array_compact(F.array(*endings, *indexes))
    files = documents.select("repo_id", path.alias("path"), script.alias("s"), python.alias("p"))
    everything = F.concat("s", "p")
    if package_roots:
        everything = F.concat("s", "p", F.flatten(F.transform("p", _seen_from_roots)))
    return (
        files.select(*FILE, F.inline(everything))
        .groupBy("repo_id", "scope", "key")
        .agg(F.min(F.struct("root", "rank", "path"))["path"].alias("target"))
    )


# ---- links -------------------------------------------------------------------

def links(documents: DataFrame, wide: bool = False, package_roots: bool = True) -> DataFrame:
    """Distinct ``(repo_id, src, dst)`` of resolved imports; dst is null once per file.

    A module is taken from beside its file before any package root. After the
    join everything about a file is brought together once; choosing among
    places and dropping repeats need no further shuffle.
    """
    asked = requests(documents, wide, package_roots)
    found = asked.join(offers(documents, package_roots), ["repo_id", "scope", "key"], "left")
    known = found.where(F.col("target").isNotNull() | (F.col("module") == ""))
    chosen = known.repartition(*FILE).groupBy(*FILE, "module").agg(
        F.min(F.struct("scope", "target"))["target"].alias("target")
    )
    return chosen.select("repo_id", F.col("path").alias("src"), F.col("target").alias("dst")).distinct()


def _linked() -> Column:
    return F.coalesce(F.col("dst") != F.col("src"), F.lit(False))


def edges_of(link_rows: DataFrame) -> DataFrame:
    """Each edge once, without edges to oneself."""
    return link_rows.where(_linked())


def edges(documents: DataFrame, wide: bool = False, package_roots: bool = True) -> DataFrame:
    return edges_of(links(documents, wide, package_roots))


# ---- nodes, degrees and questions --------------------------------------------

def degrees(link_rows: DataFrame) -> DataFrame:
    """Nodes with outgoing and incoming counts: source files and edge ends.

    One grouping of both ends of all links gives the node set and both counts,
    without joins; a hub is counted on the map side first.
    """
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    linked = _linked()
    ends = F.array_compact(F.array(
        F.struct(F.col("src").alias("path"), F.when(linked, one).otherwise(zero).alias("o"), zero.alias("i")),
        F.when(linked, F.struct(F.col("dst").alias("path"), zero.alias("o"), one.alias("i"))),
    ))
    return link_rows.select("repo_id", F.inline(ends)).groupBy(*FILE).agg(
        F.sum("o").alias("outgoing"), F.sum("i").alias("incoming")
    )


def nodes(link_rows: DataFrame) -> DataFrame:
    """Source files and edge ends, each once, with their language."""
    ends = F.array_compact(F.array("src", "dst"))
    lang = language.graph_language(paths.extension(paths.base_name(F.col("path"))))
    return link_rows.select("repo_id", F.explode(ends).alias("path")).distinct().withColumn("language", lang)


def entry_points(degree: DataFrame) -> DataFrame:
    return degree.where(F.col("incoming") == 0)


def isolated(degree: DataFrame) -> DataFrame:
    return degree.where((F.col("incoming") == 0) & (F.col("outgoing") == 0))


def leaves(degree: DataFrame) -> DataFrame:
    return degree.where((F.col("incoming") > 0) & (F.col("outgoing") == 0))


def core_modules(degree: DataFrame, top_n: int = V.CORE_DEFAULT) -> DataFrame:
    """The most imported files of each repository, ties by path.

    Spark cuts every partition to ``top_n`` rows per repository before the
    shuffle (window group limit), so a huge repository costs no more than this.
    """
    order = Window.partitionBy("repo_id").orderBy(F.desc("incoming"), "path")
    return (
        degree.where(F.col("incoming") > 0)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= top_n)
        .select(*FILE, "incoming", "rank")
    )


def core_modules_overall(degree: DataFrame, top_n: int = V.CORE_DEFAULT) -> DataFrame:
    """The most imported files of all repositories together."""
    return degree.where(F.col("incoming") > 0).orderBy(
        F.desc("incoming"), "repo_id", "path"
    ).limit(top_n).select(*FILE, "incoming")


def statistics(degree: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts per repository or overall; zeros for an empty graph."""
    into, out = F.col("incoming"), F.col("outgoing")
    total = F.count(F.lit(1))
    links = F.coalesce(F.sum(out), F.lit(0))
    return degree.groupBy(*(by or [])).agg(
        total.cast("bigint").alias("total_files"),
        links.cast("bigint").alias("total_dependencies"),
        F.count_if(into == 0).cast("bigint").alias("entry_points"),
        F.count_if((into == 0) & (out == 0)).cast("bigint").alias("isolated_files"),
        F.count_if((into > 0) & (out == 0)).cast("bigint").alias("leaf_modules"),
        F.coalesce(F.try_divide(links.cast("double"), total.cast("double")), F.lit(0.0))
        .alias("avg_dependencies_per_file"),
        F.coalesce(F.max(into), F.lit(0)).cast("bigint").alias("max_incoming_count"),
    )


def neighbours(edge_rows: DataFrame) -> DataFrame:
    """Both directions of every edge as rows, one per neighbour."""
    return edge_rows.select("repo_id", F.inline(F.array(
        F.struct(F.col("src").alias("path"), F.lit("dependency").alias("kind"), F.col("dst").alias("neighbour")),
        F.struct(F.col("dst").alias("path"), F.lit("dependent").alias("kind"), F.col("src").alias("neighbour")),
    )))


def dependencies(edge_rows: DataFrame, repo_id: str, path: str) -> DataFrame:
    """Files that one file imports."""
    return edge_rows.where((F.col("repo_id") == repo_id) & (F.col("src") == path)).select("dst")


def dependents(edge_rows: DataFrame, repo_id: str, path: str) -> DataFrame:
    """Files that import one file."""
    return edge_rows.where((F.col("repo_id") == repo_id) & (F.col("dst") == path)).select("src")


# ---- report ------------------------------------------------------------------

def overview(degree: DataFrame) -> DataFrame:
    """Markdown overview ``(repo_id, overview)`` of each repository's graph.

    ``degree`` is used twice: pass a table that was written or checkpointed.
    Core modules and entry points are both first rows of one ranking.
    """
    is_core = F.col("incoming") > 0
    order = Window.partitionBy("repo_id", "core").orderBy(F.desc("incoming"), "path")
    most = max(V.REPORT_CORE, V.REPORT_ENTRIES)
    listed = (
        degree.select(*FILE, "incoming", is_core.alias("core"))
        .withColumn("n", F.row_number().over(order))
        .where(F.col("n") <= most)
        .where(F.when(F.col("core"), F.col("n") <= V.REPORT_CORE).otherwise(F.col("n") <= V.REPORT_ENTRIES))
        .groupBy("repo_id")
        .agg(F.array_sort(F.collect_list(F.struct("core", "n", "path", "incoming"))).alias("rows"))
    )
    stats = statistics(degree, ["repo_id"])

    def lines(core: bool, form) -> Column:
        picked = F.filter("rows", lambda r: r["core"] == core)
        return F.array_join(F.transform(picked, form), "")

    core_lines = lines(True, lambda r: F.concat(
        F.lit("- `"), paths.base_name(r["path"]), F.lit("` ("), r["incoming"].cast("string"),
        F.lit(" incoming dependencies)\n")))
    entry_lines = lines(False, lambda r: F.concat(F.lit("- `"), paths.base_name(r["path"]), F.lit("`\n")))
    rest = F.col("entry_points") - V.REPORT_ENTRIES
    core_part = F.when(core_lines != "", F.concat(
        F.lit(V.CORE_HEADING), core_lines, F.lit("\n")))
    entry_part = F.when(entry_lines != "", F.concat(
        F.lit(V.ENTRY_HEADING), entry_lines,
        F.when(rest > 0, F.concat(F.lit("- ... and "), rest.cast("string"), F.lit(" more\n"))).otherwise(""),
        F.lit("\n")))
    value = {name: F.col(name).cast("string") for name in V.STATISTICS_LABELS}
    value["avg_dependencies_per_file"] = tenths(F.col("avg_dependencies_per_file"))
    numbers = [x for name, label in V.STATISTICS_LABELS.items() for x in (F.lit(f"- **{label}**: "), value[name], F.lit("\n"))]
    text = F.concat(
        F.lit(V.OVERVIEW_HEADING + "\n"), F.coalesce(core_part, F.lit("")),
        F.coalesce(entry_part, F.lit("")), F.lit(V.STATISTICS_HEADING), *numbers,
    )
    return stats.join(listed, "repo_id").select("repo_id", text.alias("overview"))


def append_section(text: Column, section: Column) -> Column:
    """Text with the section at its end, unless it is there or the section is empty."""
    there = F.contains(text, F.lit(V.OVERVIEW_HEADING))
    return F.when(there | (F.coalesce(section, F.lit("")) == ""), text).otherwise(
        F.concat(rstrip(text), F.lit("\n\n"), section)
    )
