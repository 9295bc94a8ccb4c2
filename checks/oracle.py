"""SQL for DuckDB that gives the result of each query from the given tables."""

from arborlens import fixed_values as V
from arborlens.functions.structured import template_hash
from checks.views import duckdb_view

SPACE = r"[\t\n\v\f\r ]"
INLINE = r"[\t\v\f\r ]*"


def lit(text: str) -> str:
    """A string literal; line feeds are spelled out."""
    parts = ["'" + p.replace("'", "''") + "'" for p in text.split("\n")]
    return "concat(" + ", chr(10), ".join(parts) + ")" if len(parts) > 1 else parts[0]


def listed(words) -> str:
    return "(" + ", ".join(lit(w) for w in words) + ")"


def mapped(key: str, table: dict[str, str]) -> str:
    whens = " ".join(f"when {lit(k)} then {lit(v)}" for k, v in table.items())
    return f"case {key} {whens} end"


def using(*views: str, **ctes: str) -> str:
    parts = [f"{v} as ({duckdb_view(v)})" for v in views] + [f"{k} as ({t})" for k, t in ctes.items()]
    return "with recursive " + ",\n".join(parts) + "\n"


# ---- selection ---------------------------------------------------------------

NAME = r"regexp_extract({p}, '([^/]*)$', 1)"
EXT = r"lower(regexp_extract({n}, '^\.*[^.].*(\.[^.]*)$', 1))"


def name_of(path: str) -> str:
    return NAME.format(p=path)


def ext_of(name: str) -> str:
    return EXT.format(n=name)


def parent_of(path: str) -> str:
    return f"case when contains({path}, '/') then regexp_replace({path}, '/[^/]*$', '') else '' end"


def name_reason(p: str, excluded: str, included: str, protected_ok: str) -> str:
    """Rule chain over a path in lower case; the glob tests are written by hand."""
    n = name_of(p)
    dirs = [d for d in V.IGNORED_DIRS if "*" not in d]
    in_dir = " or ".join(f"contains(concat('/', {p}, '/'), {lit('/' + d + '/')})" for d in dirs)
    ignored = (f"({n} in {listed(V.IGNORED_FILES)} or {ext_of(n)} in {listed(V.IGNORED_EXTENSIONS)} or {in_dir} "
               f"or regexp_matches({p}, '(^|/)[^/]*\\.egg-info(/|$)'))")
    return (f"case when {excluded} then 'excluded by pattern' when {n} in {listed(V.PROTECTED_FILES)} and not ({protected_ok}) "
            f"then 'protected large file' when not ({included}) and {ignored} then 'ignored by default rules' end")


def either(p: str, regex: str) -> str:
    return f"(regexp_full_match({p}, {lit(regex)}) or regexp_full_match({name_of(p)}, {lit(regex)}))"


INCLUDED = r".*\.json|src/m8.*|node_modules/pkg/.*"
EXCLUDED = r".*/m9.*|m1.\.mjs|docs/m[3-5]3\..*"


def chain(p: str, exclude: str = EXCLUDED, include: str = INCLUDED, protected_ok: str = "false") -> str:
    return name_reason(p, either(p, exclude), either(p, include), protected_ok)


def sized(reason: str, kb: int) -> str:
    return f"coalesce({reason}, case when length > {kb} * 1024 then 'exceeds maximum file size' end)"


def judged(kb: int, exclude: str = EXCLUDED) -> dict[str, str]:
    """Files with their topmost rejected directory and their reason."""
    return {
        "parts": "select *, lower(relative_path) as p, string_split(relative_path, '/') as s from vrepo",
        "above": "select distinct repo_id, array_to_string(s[1:i], '/') as d from "
                 "(select repo_id, s, unnest(range(1, len(s))) as i from parts) x",
        "bad": f"select repo_id, d, {chain('lower(d)', exclude)} as r from above",
        "topmost": "select f.doc_id, min_by(b.d, length(b.d)) as d, min_by(b.r, length(b.d)) as r from parts f "
                   "join bad b on b.repo_id = f.repo_id and starts_with(f.relative_path, concat(b.d, '/')) "
                   "where b.r is not null group by f.doc_id",
        "judged": f"select f.*, t.d as pruned_dir, coalesce(t.r, {sized(chain('f.p', exclude), kb)}) as reason_code "
                  "from parts f left join topmost t on t.doc_id = f.doc_id",
    }


SIGNED = "(" + " or ".join(
    f"starts_with(content, {lit(s.decode())})" for s in V.BINARY_SIGNATURES
    if s.isascii() and b"\x00" not in s and len(s) <= V.SIGNATURE_PREFIX) + ")"


def walked(kb: int) -> dict[str, str]:
    """Judged files and the outcome of each file that is not below a pruned directory."""
    return judged(kb) | {
        "outcomes": f"select *, coalesce(reason_code, case when {SIGNED} then 'binary_file' end) as why, "
                    "reason_code is not null as early from judged where pruned_dir is null",
        "skips": "select distinct repo_id, concat(pruned_dir, '/') as relative_path, reason_code from judged "
                 "where pruned_dir is not null union all select repo_id, relative_path, why from outcomes where why is not null",
    }


def human(size: str) -> str:
    return (f"case when {size} < 1024 then concat(cast({size} as varchar), ' B') when {size} < 1048576 "
            f"then printf('%.1f KB', {size} / 1024.0::double) else printf('%.1f MB', {size} / 1048576.0::double) end")


TOKENS = "cast(greatest(1, length({0}) // 3) as bigint)"
PLACE = ("cast(case {0} when 'excluded by pattern' then 1 when 'ignored by default rules' then 2 "
         "when 'exceeds maximum file size' then 3 when 'protected large file' then 4 else 99 end as bigint)")

# ---- language ----------------------------------------------------------------


def by_extension(name: str) -> str:
    ext = f"case when {ext_of(name)} = '' and starts_with({name}, '.') then lower({name}) else {ext_of(name)} end"
    return mapped(ext, V.LANGUAGE_BY_EXTENSION)


def by_shebang(text: str) -> str:
    line = rf"regexp_replace(regexp_replace(split_part({text}, chr(10), 1), '^[\s\v]+', ''), '[\s\v]+$', '')"
    anywhere = r"(/usr/bin/env\s+|/usr/bin/|/bin/)"
    tests = [
        (anywhere + r"python(\d+(\.\d+)?)?", "python"), (anywhere + "bash", "bash"), (anywhere + "sh", "sh"),
        (anywhere + "node", "javascript"), (r"(/usr/bin/env\s+|/usr/bin/)(deno|bun)", "javascript"),
        (anywhere + "ruby", "ruby"), (anywhere + "perl", "perl"), (anywhere + "php", "php"),
        (r"/usr/bin/env\s+racket", "racket"), (r"/usr/bin/env\s+lua", "lua"), (r"/usr/bin/env\s+awk", "awk"),
        (r"/usr/bin/env\s+guile", "scheme"), (r"/usr/bin/env\s+tclsh", "tcl"),
    ]
    whens = " ".join(rf"when regexp_matches({line}, {lit(r'^#!\s*' + t + r'(\s|$)')}) then {lit(v)}" for t, v in tests)
    return f"case {whens} end"


def by_content(text: str) -> str:
    whens = []
    for lang, markers in V.CONTENT_MARKERS:
        score = " + ".join(f"cast(contains(s, {lit(m)}) as int)" for m in markers)
        whens.append(f"when {score} >= 2 then {lit(lang)}")
    return f"(select case {' '.join(whens)} end from (select left({text}, 8192) as s) q)"


# ---- imports -----------------------------------------------------------------

PY_IMPORT = rf"(?m)^{INLINE}import{SPACE}+([^\n#]+)"
PY_FROM = rf"(?m)^{INLINE}from{SPACE}+([^\t\n\v\f\r ]+){SPACE}+import{SPACE}+([^\n#]+)"
PY_DOTS = rf"(?m)^{INLINE}from{SPACE}+(\.+){SPACE}+import{SPACE}+([^\n#]+)"
JS_FROM = rf"""import{SPACE}+[^\n]*?from{SPACE}+["']([^"']+)["']"""
JS_CALL = rf"""import{SPACE}*\({SPACE}*["']([^"']+)["']{SPACE}*\)"""
JS_REQUIRE = rf"""require{SPACE}*\({SPACE}*["']([^"']+)["']{SPACE}*\)"""


def found(regex: str, group: int = 1) -> str:
    return f"regexp_extract_all(content, '{regex.replace(chr(39), chr(39) * 2)}', {group})"


def words(text: str, extra: str = "") -> str:
    return (rf"list_filter(list_transform(string_split({text}, ','), lambda p: regexp_extract(p, '([^\s\v{extra}]+)', 1)), "
            "lambda w: w <> '')")


PY_LIST = f"list_concat(flatten(list_transform({found(PY_IMPORT)}, lambda m: {words('m')})), {found(PY_FROM)})"
SOURCES = {
    "src": f"select repo_id, relative_path as path, content, {mapped(ext_of(name_of('relative_path')), V.GRAPH_LANGUAGES)} as lang from vcode",
    "py": "select * from src where lang = 'python' and content <> ''",
    "js": "select * from src where lang <> 'python' and content <> ''",
}
JS_LISTS = {
    "k": f"select repo_id, path, {found(JS_FROM)} as a, {found(JS_CALL)} as b, {found(JS_REQUIRE)} as c from js",
    # Position of the first mention decides which of the later mentions stay.
    "mentions": "select repo_id, path, 1 as kind, unnest(a) as module, unnest(range(len(a))) as i from k union all "
                "select repo_id, path, 2, unnest(b), unnest(range(len(b))) from k union all "
                "select repo_id, path, 3, unnest(c), unnest(range(len(c))) from k",
    "ranked": "select *, row_number() over (partition by repo_id, path, trim(module) order by kind, i) as nth from mentions",
    "jsmods": "select repo_id, path, trim(module) as module, cast(row_number() over (partition by repo_id, path order by kind, i) - 1 as bigint) as pos "
              "from ranked where kind = 1 or nth = 1",
}
PY_EDGES = {
    "pymods": f"select repo_id, path, unnest({PY_LIST}) as module from py",
    "pydots": f"select repo_id, path, unnest({found(PY_DOTS, 1)}) as dots, unnest({found(PY_DOTS, 2)}) as names from py",
    "asked": "select distinct * from (select repo_id, path, module from pymods where not regexp_full_match(module, '\\.+') union all "
             f"select repo_id, path, concat(dots, unnest({words('names', '()')})) from pydots) x where module <> '' and module[1] <> '_'",
    "asked2": f"select *, length(regexp_extract(module, '^(\\.*)', 1)) as n, {parent_of('path')} as home, "
              "replace(regexp_replace(module, '^\\.+', ''), '.', '/') as tail from asked",
    "based": "select *, case when n <= 1 then home else array_to_string(list_slice(string_split(home, '/'), 1, greatest(len(string_split(home, '/')) - (n - 1), 0)), '/') end as base from asked2",
    "roots": f"select distinct repo_id, array_to_string(s[1:i], '/') as root from (select repo_id, s, unnest(range(0, len(s))) as i from (select repo_id, string_split(relative_path, '/') as s from vcode) q) x",
    # Every candidate path with its turn, then the first that exists.
    "cands": "select repo_id, path, module, 0 as turn, '' as root, concat(case when base = '' then '' else concat(base, '/') end, tail) as stem from based union all "
             "select b.repo_id, path, module, 1, root, concat(case when root = '' then '' else concat(root, '/') end, tail) from based b join roots r on r.repo_id = b.repo_id where n = 0",
    "forms": "select *, 0 as pkg, concat(stem, '/__init__.py') as cand from cands union all select *, 1, concat(stem, '.py') from cands",
    "pyhits": "select f.repo_id, f.path, f.module, arg_min(cand, (turn, root, pkg)) as dst from forms f join vcode v on v.repo_id = f.repo_id and v.relative_path = f.cand group by all",
    "pyedges": "select distinct repo_id, path as src, dst from pyhits where path <> dst",
}
_STEP = "case when x = '..' then case when a in ('', '!') then '!' else regexp_replace(a, '/[^/]*$', '') end when x in ('', '.') or a = '!' then a else concat(a, '/', x) end"
JS_EDGES = {
    "rel": f"select distinct repo_id, path, split_part(split_part(module, '?', 1), '#', 1) as m, module, {parent_of('path')} as home from jsmods where starts_with(module, '.')",
    "stems": f"select repo_id, path, module, list_reduce(string_split(concat(home, '/', m), '/'), lambda a, x: {_STEP}, '') as stem from rel",
    "endings": "select * from (values " + ", ".join(f"({i}, {lit(e)})" for i, e in enumerate(V.SCRIPT_ENDINGS)) + ", " + ", ".join(
        f"({i + len(V.SCRIPT_ENDINGS)}, {lit('/' + e)})" for i, e in enumerate(V.SCRIPT_INDEXES)) + ") t(turn, ending)",
    "jscands": "select repo_id, path, module, turn, concat(stem, ending)[2:] as cand from stems, endings where stem <> '!'",
    "jshits": "select f.repo_id, f.path, f.module, arg_min(cand, turn) as dst from jscands f join vcode v on v.repo_id = f.repo_id and v.relative_path = f.cand group by all",
    "jsedges": "select distinct repo_id, path as src, dst from jshits where path <> dst",
}
EDGES = SOURCES | JS_LISTS | PY_EDGES | JS_EDGES | {"edges": "select * from pyedges union select * from jsedges"}
DEGREES = EDGES | {
    "nodes": "select repo_id, path from py union select repo_id, path from js union select repo_id, src from edges union select repo_id, dst from edges",
    "deg": "select n.repo_id, n.path, cast((select count(*) from edges e where e.repo_id = n.repo_id and e.src = n.path) as bigint) as outgoing, "
           "cast((select count(*) from edges e where e.repo_id = n.repo_id and e.dst = n.path) as bigint) as incoming from nodes n",
}
STATS = ("select repo_id, cast(count(*) as bigint) as total_files, cast(sum(outgoing) as bigint) as total_dependencies, "
         "cast(count(*) filter (where incoming = 0) as bigint) as entry_points, cast(count(*) filter (where incoming = 0 and outgoing = 0) as bigint) as isolated_files, "
         "cast(count(*) filter (where incoming > 0 and outgoing = 0) as bigint) as leaf_modules, "
         "cast(sum(outgoing) as double) / cast(count(*) as double) as avg_dependencies_per_file, cast(max(incoming) as bigint) as max_incoming_count from deg group by repo_id")
_SHOWN = f"concat('- `', {name_of('path')}, '`', case when kind = 1 then concat(' (', cast(incoming as varchar), ' incoming dependencies)') else '' end, chr(10))"
REPORT = DEGREES | {
    "stats": STATS,
    "tops": "select repo_id, path, incoming, 1 as kind, row_number() over (partition by repo_id order by incoming desc, path) as n from deg where incoming > 0 qualify n <= 5 "
            "union all select repo_id, path, incoming, 2, row_number() over (partition by repo_id order by path) as n from deg where incoming = 0 qualify n <= 10",
    "texts": f"select repo_id, coalesce(string_agg({_SHOWN}, '' order by n) filter (where kind = 1), '') as core, coalesce(string_agg({_SHOWN}, '' order by n) filter (where kind = 2), '') as entry from tops group by repo_id",
    "report": "select s.repo_id, concat('## Dependency Overview', chr(10), case when core <> '' then concat('### Core Modules', chr(10), 'Files most depended on by other modules:', chr(10), core, chr(10)) else '' end, "
              "case when entry <> '' then concat('### Entry Points', chr(10), 'Files with no incoming dependencies:', chr(10), entry, case when entry_points > 10 then concat('- ... and ', cast(entry_points - 10 as varchar), ' more', chr(10)) else '' end, chr(10)) else '' end, "
              "'### Dependency Statistics', chr(10), '- **Total files analyzed**: ', total_files, chr(10), '- **Total dependencies**: ', total_dependencies, chr(10), '- **Entry points**: ', entry_points, chr(10), "
              "'- **Isolated files**: ', isolated_files, chr(10), '- **Leaf modules**: ', leaf_modules, chr(10), '- **Avg dependencies per file**: ', printf('%.1f', avg_dependencies_per_file), chr(10)) as overview from stats s join texts t on t.repo_id = s.repo_id",
}

# ---- ignore rules ------------------------------------------------------------

IGNORE_LINES = {0: ["# notes", "*.md", "!m3.md", "docs/"], 1: ["src/**/m1*", "/m4?.ts", "", "*.lock  "],
                2: ["src/*", "!src/utils/", "**/pkg/m2[0-5].py", "\\!x"]}
# (kind of repository, place, regex, ignored), written by hand from the lines above.
IGNORE_TESTS = [
    (0, 1, r"(.*/)?[^/]*\.md(/.*)?", True), (0, 2, r"(.*/)?m3\.md(/.*)?", False), (0, 3, r"(.*/)?docs/.*", True),
    (1, 0, r"src/(.*/)?m1[^/]*(/.*)?", True), (1, 1, r"m4[^/]\.ts(/.*)?", True), (1, 3, r"(.*/)?[^/]*\.lock(/.*)?", True),
    (2, 0, r"src/[^/]+(/.*)?", True), (2, 1, r"src/utils/.*", False), (2, 2, r"(.*/)?pkg/m2[0-5]\.py(/.*)?", True),
    (2, 3, r"(.*/)?!x(/.*)?", True),
]

# ---- directories -------------------------------------------------------------

DIRS = {
    "fs": "select repo_id, file_path, description, string_split(file_path, '/') as s from vsummary where file_path <> ''",
    "dirs": "select distinct repo_id, array_to_string(s[1:i], '/') as dir from (select repo_id, s, unnest(range(1, len(s))) as i from fs) x",
    "nf": f"select repo_id, {parent_of('file_path')} as dir, count(*) as n from fs group by all",
    "nd": f"select repo_id, {parent_of('dir')} as pdir, count(*) as n from dirs group by all",
    "facts": "select d.repo_id, d.dir, cast(coalesce(nf.n, 0) as bigint) as n_files, cast(coalesce(nd.n, 0) as bigint) as n_dirs from dirs d "
             "left join nf on nf.repo_id = d.repo_id and nf.dir = d.dir left join nd on nd.repo_id = d.repo_id and nd.pdir = d.dir",
}
ROLLUP = DIRS | {
    # Follow a single item down until a directory branches or a file is reached.
    "down": "select repo_id, dir as top, dir as item from dirs where not contains(dir, '/') union all "
            "select w.repo_id, w.top, coalesce(d.dir, f.file_path) from down w join facts x on x.repo_id = w.repo_id and x.dir = w.item and x.n_files + x.n_dirs = 1 "
            f"left join dirs d on d.repo_id = w.repo_id and {parent_of('d.dir')} = w.item left join fs f on f.repo_id = w.repo_id and {parent_of('f.file_path')} = w.item",
    "ends": "select repo_id, top, arg_max(item, length(item)) as item from down group by all",
    "sizes": "select repo_id, count(*) as n from fs group by repo_id",
    "below": "select d.repo_id, d.dir, count(*) as n from dirs d join fs f on f.repo_id = d.repo_id and starts_with(f.file_path, concat(d.dir, '/')) group by all",
}

JSON_ENTRY = "(" + " and ".join(f"json_exists(e, '$.{f}')" for f in (
    "file_path", "content_hash", "language", "summary", "mtime")) + " and json_type(e) = 'OBJECT')"
VALID = (f"case when json_valid(raw) then coalesce(json_type(raw) = 'OBJECT' and json_exists(raw, '$.schema_version') and json_exists(raw, '$.config_hash') "
         f"and json_type(raw, '$.entries') = 'ARRAY' and coalesce(list_bool_and(list_transform(cast(json_extract(raw, '$.entries[*]') as json[]), lambda e: coalesce({JSON_ENTRY}, false))), true), false) else false end")

MATCH = "v.repo_id = c.repo_id and v.relative_path = c.file_path and sha256(v.content) = c.content_hash and v.file_type = c.language and c.config_hash = 'cfg-a' and c.schema_version = '1.0'"
FIRST_LINE = r"regexp_replace(split_part(regexp_replace(content, '^[\s\v]+', ''), chr(10), 1), '[\s\v]+$', '')"


def _pruned(kb: int) -> str:
    return using("vrepo", **walked(kb))


TREE_PARTS = f""", f as (select repo_id, relative_path as p, s, {parent_of('relative_path')} as home from judged where reason_code is null),
            d as (select distinct repo_id, array_to_string(s[1:i], '/') as dir, i from (select repo_id, s, unnest(range(1, len(s))) as i from f) x),
            m as (select *, row_number() over (partition by repo_id, home order by p desc) = 1 as last from f)"""
TREE_LINES = f"""select distinct repo_id, '' as sort_key, 0 as depth, concat(repo_id, '/') as line from f
            union all select repo_id, concat(replace(dir, '/', chr(2)), chr(2)), cast(i as int), concat(repeat('    ', i), '├── ', {name_of('dir')}, '/') from d
            union all select repo_id, concat(case when home = '' then '' else concat(replace(home, '/', chr(2)), chr(2)) end, chr(1), {name_of('p')}), cast(len(s) as int), concat(repeat('    ', len(s)), case when last then '└── ' else '├── ' end, {name_of('p')}) from m"""


def failing() -> dict[str, str]:
    """The events of files, some of which cannot be read."""
    return walked(SMALL) | {
        "told": "select repo_id, relative_path, early, case when why is not null or doc_id % 20 = 13 then 'file_skipped' when doc_id % 20 = 3 then 'file_failed' else 'file_completed' end as event_type, "
                "coalesce(why, case doc_id % 20 when 3 then 'unexpected_error: the disk fell' when 13 then 'permission_error' end) as detail from outcomes"}


SMALL = 4  # KB


def sql() -> dict[str, str]:
    v = using("vrepo")
    cache = using("vrepo", "vcache")
    edges, degrees = using("vcode", **EDGES), using("vcode", **DEGREES)
    ignore_values = ", ".join(f"({k}, {i}, {lit(line)})" for k, lines in IGNORE_LINES.items() for i, line in enumerate(lines))
    tests = ", ".join(f"({k}, {i}, {lit(rx)}, {str(ok).lower()})" for k, i, rx, ok in IGNORE_TESTS)
    kind = "cast(substr(repo_id, 2) as bigint) % 3"
    return {
        # sources and sinks
        "corpus_scan": using("vfiles") + "select 'all' as repo_id, concat(repo_id, '/', relative_path) as relative_path, cast(octet_length(encode(content)) as bigint) as length, sha256(content) as hash, false as is_link from vfiles",
        "multi_root_scan": using("vfiles", s="select repo_id, string_split(relative_path, '/') as s from vfiles")
        + "select repo_id, relative_path, cast(octet_length(encode(content)) as bigint) as length, false as is_dir from vfiles union all "
          "select distinct repo_id, array_to_string(s[1:i], '/'), null, true from (select repo_id, s, unnest(range(1, len(s))) as i from s) x",
        "decode_text": using("vlines") + r"select doc_id, regexp_replace(try(decode(content)), '\r\n?', chr(10), 'g') as text, case when try(decode(content)) is null then 'encoding_error' end as error from vlines",
        "ignore_rules": v + f"select r.repo_id, cast(t.ord as bigint) as ord, t.pattern from (select distinct repo_id from vrepo) r join (values {ignore_values}) t(kind, ord, pattern) on t.kind = {kind}",
        "cache_validate": using("vstored", checked=f"select repo_id, raw, {VALID} as valid from vstored")
        + "select c.repo_id, c.valid, json_extract_string(e, '$.file_path') as file_path, json_extract_string(e, '$.language') as language from checked c "
          "left join (select repo_id, unnest(cast(json_extract(raw, '$.entries[*]') as json[])) as e from checked where valid) x on x.repo_id = c.repo_id",
        "cache_write": cache + "select repo_id, file_path, content_hash, language, case when content_hash = 'old' then 'new' else summary end as summary, config_hash from vcache",
        "documents_table": _pruned(200) + f"select repo_id, relative_path as file_path, {name_of('relative_path')} as file_name, {ext_of(name_of('relative_path'))} as file_type, relative_path, content from outcomes where why is null",
        "report_write": using("vcode", **REPORT) + "select repo_id, overview as text from report",
        # projections
        "path_parts": v + f"select repo_id, relative_path, trim(lower(replace(relative_path, '\\', '/'))) as normal_path, {name_of('relative_path')} as file_name, {ext_of(name_of('relative_path'))} as file_type from vrepo",
        "file_metadata": v + "select repo_id, relative_path, file_name, file_type, length as file_size from vrepo",
        "repo_name": r"select page_id, regexp_replace(split_part(rtrim(url, '/'), '/', -1), '\.git$', '') as name from pages",
        "source_kind": "select page_id, case when page_id % 2 = 0 then 'remote' else 'local' end as kind from pages where not starts_with(url, 'https://github.com/') or page_id % 2 = 0 union all select page_id, 'remote' from pages where page_id % 2 = 1 and starts_with(url, 'https://github.com/')",
        "format_size": v + f"select doc_id, size, {human('size')} as text from (select doc_id, unnest([length, length * 16, length * 4096 + 1]) as size from vrepo) x",
        "token_estimate": v + f"select doc_id, {TOKENS.format('content')} as tokens from vrepo",
        "content_hash": v + "select doc_id, sha256(content) as hash from vrepo",
        "config_hash": f"""select distinct source, lang, sha256(concat('{{"base_url": null, "model": "', lang, '", "prompt_template_hash": "{template_hash()}", "provider": "', source, '"}}')) as hash from documents""",
        "request_text": v + "select doc_id, concat('Describe this file as one JSON object with file_path and description.', chr(10), 'Path: ', relative_path, chr(10), 'Language: ', file_type, chr(10), chr(10), content, chr(10)) as request from vrepo",
        # filters
        "glob_filter": v + "select doc_id, " + either("lower(relative_path)", r"src/.*\.js|.*\.md|m[1-3].?\..*|docs/m.*[^5]\.txt").replace("m[1-3].?", "m[1-3].") + " as matched from vrepo",
        "file_filter": using("vrepo", f="select doc_id, length, case when doc_id % 25 = 7 then 'a/yarn.lock' when doc_id % 25 = 8 then 'package-lock.json' else relative_path end as p from vrepo")
        + f"select doc_id, {sized(chain('lower(p)', include=INCLUDED + '|package-lock.json', protected_ok='''regexp_extract(lower(p), '([^/]*)$', 1) = 'package-lock.json' '''), 4)} as reason_code from f",
        "size_filter": v + "select doc_id, case when doc_id % 10 = 9 then 'cannot determine file size' when length > 4096 then 'exceeds maximum file size' end as reason_code, "
                           "case when doc_id % 10 <> 9 and length > 4096 then concat(cast(length as varchar), ' B > 4096 B limit') end as reason_detail from vrepo",
        "ignore_filter": v + f"select f.repo_id, f.relative_path, coalesce(arg_max(t.ignored, t.ord), false) as ignored from vrepo f left join (values {tests}) t(kind, ord, rx, ignored) "
                             f"on t.kind = {kind.replace('repo_id', 'f.repo_id')} and regexp_full_match(f.relative_path, t.rx) group by all",
        "ignore_prune": v + f", t(kind, ord, rx, ignored) as (values {tests}), "
                            "an as (select repo_id, relative_path, i, array_to_string(s[1:i], '/') as dir from (select repo_id, relative_path, string_split(relative_path, '/') as s, unnest(range(1, len(s))) as i from vrepo) x), "
                            "vd as (select a.repo_id, a.relative_path, a.i, a.dir, coalesce(arg_max(t.ignored, t.ord) filter (regexp_full_match(dir, t.rx)), false) "
                            f"or coalesce(arg_max(t.ignored, t.ord) filter (regexp_full_match(concat(dir, '/'), t.rx)), false) as bad from an a left join t on t.kind = {kind} group by all), "
                            "tops as (select repo_id, relative_path, arg_min(dir, i) filter (bad) as top from vd group by all), "
                            f"own as (select f.repo_id, f.relative_path, coalesce(arg_max(t.ignored, t.ord) filter (regexp_full_match(f.relative_path, t.rx)), false) as bad from vrepo f left join t on t.kind = {kind} group by all) "
                            "select distinct repo_id, concat(top, '/') as relative_path, 'ignored by gitignore' as reason_code from tops where top is not null union all "
                            "select o.repo_id, o.relative_path, 'ignored by gitignore' from own o left join tops on tops.repo_id = o.repo_id and tops.relative_path = o.relative_path where o.bad and top is null",
        "dir_prune": using("vrepo", **judged(200, EXCLUDED + "|docs")) + "select distinct repo_id, concat(pruned_dir, '/') as relative_path, reason_code from judged where pruned_dir is not null "
                     "union all select repo_id, relative_path, reason_code from judged where pruned_dir is null",
        "binary_filter": using("vbytes", h="select doc_id, content, octet_length(content) as n, left(hex(content), 16384) as x, hex(content) as w from vbytes")
        + "select doc_id, case when n = 0 then false when regexp_matches(x, '^([0-9A-F]{2})*?00') then true when "
        + " or ".join(f"starts_with(x, '{s.hex().upper()}')" for s in V.BINARY_SIGNATURES if len(s) <= V.SIGNATURE_PREFIX)
        + " then true when n <= 8192 then try(decode(content)) is null else coalesce(try(decode(unhex(x))), try(decode(unhex(left(w, 16386)))), try(decode(unhex(left(w, 16388)))), try(decode(unhex(left(w, 16390))))) is null end as is_binary from h",
        # A link to a directory is a duplicate of a real one that is not pruned, or of a link before it.
        "manifest_alias": using("vmanifest")
        + "select m.repo_id, m.relative_path, case when m.is_link then case when not m.is_dir then 'broken symbolic link' "
          "when not starts_with(m.resolved_path, concat('/repo/', m.repo_id, '/')) then 'symbolic link outside repository' "
          "when exists (select 1 from vmanifest r where r.repo_id = m.repo_id and r.resolved_path = m.resolved_path and not r.is_link and r.pruned_dir is null) "
          "or exists (select 1 from vmanifest l where l.repo_id = m.repo_id and l.resolved_path = m.resolved_path and l.is_link and l.pruned_dir is null and l.relative_path < m.relative_path) "
          "then 'circular or duplicate symbolic link' end end as reason_code from vmanifest m where m.pruned_dir is null",
        # cache
        "cache_lookup": cache + f"select v.repo_id, v.relative_path as file_path, c.summary from vrepo v left join vcache c on {MATCH}",
        "cache_miss": cache + f"select v.repo_id, v.relative_path as file_path, sha256(v.content) as content_hash, v.file_type as language from vrepo v where not exists (select 1 from vcache c where {MATCH})",
        "cache_stale": cache + "select c.repo_id, c.file_path, case when v.doc_id is null then 'stale' else 'kept' end as state from vcache c left join (select doc_id, repo_id, case when doc_id % 7 = 0 then concat('moved/', relative_path) else relative_path end as relative_path from vrepo) v on v.repo_id = c.repo_id and v.relative_path = c.file_path",
        "cache_invalidate": cache + "select repo_id, file_path, summary from vcache where config_hash = 'cfg-a' and schema_version = '1.0'",
        "cache_upsert": cache + ", n as (select repo_id, case when doc_id % 4 = 3 then concat('new/', relative_path) else relative_path end as file_path, sha256(content) as content_hash, concat('n', doc_id, 'v2') as summary from vrepo where doc_id % 8 <> 5) "
                        "select repo_id, file_path, content_hash, summary from n union all select c.repo_id, c.file_path, c.content_hash, c.summary from vcache c anti join n on n.repo_id = c.repo_id and n.file_path = c.file_path",
        "incremental_run": cache + f"select v.repo_id, v.relative_path as file_path, sha256(v.content) as content_hash, v.file_type as language, coalesce(c.summary, {FIRST_LINE.replace('content', 'v.content')}) as said, 'cfg-a' as config_hash "
                                   f"from (select doc_id, repo_id, content, file_type, case when doc_id % 7 = 0 then concat('moved/', relative_path) else relative_path end as relative_path from vrepo) v left join vcache c on {MATCH}",
        "stream_run": v + "select repo_id, relative_path as file_path, sha256(t) as content_hash, concat(length(t), ' characters') as said "
                          "from (select *, case when doc_id % 5 = 1 then concat(content, '!') else content end as t from vrepo) x where doc_id % 7 <> 0",
        # language
        "lang_ext": v + f"select doc_id, {by_extension('file_name')} as language from vrepo",
        "lang_name": f"select doc_id, {mapped('lower(n)', {k: V.LANGUAGE_BY_NAME[k] for k in ('makefile', 'dockerfile', 'gemfile.lock')} | {'x/cmakelists.txt': 'cmake'})} as language from "
                     "(select doc_id, ['Makefile', 'DOCKERFILE', 'Gemfile.lock', 'x/CMakeLists.txt', 'other'][doc_id % 5 + 1] as n from documents) x",
        "lang_shebang": f"select doc_id, {by_shebang('t')} as language from (select doc_id, concat(case doc_id % 10 when 0 then '#!/usr/bin/env python3.12 -u' when 1 then '  #! /bin/sh' when 2 then '#!/usr/bin/env deno' "
                        "when 3 then '#!/bin/deno' when 4 then '#!/usr/local/bin/python' when 5 then '#!/usr/bin/tclsh' when 6 then '#!/usr/bin/env tclsh' when 7 then '#!/usr/bin/pythonic' "
                        "when 8 then concat(chr(9), '#!/bin/bash -e') else 'print(1)' end, chr(10), text) as t from documents) x",
        "lang_content": using("vcode") + f"select doc_id, {by_content('content')} as language from vcode",
        "lang_detect": v + f"select repo_id, relative_path, coalesce({by_extension('file_name')}, {mapped('lower(file_name)', V.LANGUAGE_BY_NAME)}, {by_shebang('content')}, {by_content('content')}, 'unknown') as language from vrepo",
        "lang_sample": using("vbytes", h="select v.doc_id, v.content, left(hex(v.content), 16384) as x, d.text from vbytes v join documents d on d.doc_id = v.doc_id")
        + "select doc_id, case when regexp_matches(x, '^([0-9A-F]{2})*?00') then null else concat(case doc_id % 6 when 3 then chr(1965) when 1 then concat('PNG', chr(13), chr(10), chr(26), chr(10)) else '' end, "
          "coalesce(try(decode(unhex(y))), try(decode(unhex(left(y, length(y) - 2)))), try(decode(unhex(left(y, length(y) - 4)))), try(decode(unhex(left(y, length(y) - 6)))))) end as sample "
          "from (select *, case doc_id % 6 when 3 then substr(x, 9) when 1 then substr(x, 17) else x end as y from h) q",
        # imports and graph
        "py_imports": using("vcode", **SOURCES) + f"select repo_id, path, cast(unnest(range(len(l))) as bigint) as pos, unnest(l) as module from (select repo_id, path, {PY_LIST} as l from py) x",
        "js_imports": using("vcode", **SOURCES, **JS_LISTS) + "select repo_id, path, pos, module from jsmods",
        "py_edges": edges + "select * from pyedges",
        "js_edges": edges + "select * from jsedges",
        "graph_edges": edges + "select * from edges",
        "graph_nodes": degrees + f"select repo_id, path, {mapped(ext_of(name_of('path')), V.GRAPH_LANGUAGES)} as language from nodes",
        "graph_degree": degrees + "select * from deg",
        "graph_stats": degrees + STATS,
        "graph_adjacency": degrees + "select repo_id, src as path, 'dependency' as kind, dst as neighbour from edges union all select repo_id, dst, 'dependent', src from edges",
        "graph_entry": degrees + "select repo_id, path from nodes n where not exists (select 1 from edges e where e.repo_id = n.repo_id and e.dst = n.path)",
        "graph_isolated": degrees + "select repo_id, path from deg where incoming = 0 and outgoing = 0",
        "graph_leaf": degrees + "select repo_id, path from deg where incoming > 0 and outgoing = 0",
        "graph_core": degrees + "select repo_id, path, incoming, row_number() over (partition by repo_id order by incoming desc, path) as rank from deg where incoming > 0 qualify rank <= 10",
        "graph_report": using("vcode", **REPORT) + "select * from report",
        "append_section": r"select doc_id, case when doc_id % 5 = 0 or contains(t, '## Dependency Overview') then t else concat(regexp_replace(t, '[\s\v\x{1c}-\x{1f}\x{85}\x{a0}]+$', ''), chr(10), chr(10), '## Dependency Overview', chr(10), source) end as text from "
                          "(select doc_id, source, concat(text, case when doc_id % 3 = 0 then '## Dependency Overview' else concat(' ', chr(10), chr(9), chr(10)) end) as t from documents) x",
        # reports, roll-up, loop
        "cost_estimate": v + f"select repo_id, cast(sum({TOKENS.format('content')}) as bigint) as estimated_tokens, cast(sum(length) as bigint) as total_bytes, cast(count(*) as bigint) as documents from vrepo group by repo_id",
        "skip_summary": _pruned(4) + f"select repo_id, reason_code, cast(count(*) as bigint) as skipped, {PLACE.format('reason_code')} as place from skips group by repo_id, reason_code",
        "dry_run": _pruned(200) + f""", k as (select repo_id, cast(count(*) filter (where why is null) as bigint) as files_selected, cast(coalesce(sum({TOKENS.format('content')}) filter (where why is null), 0) as bigint) as estimated_tokens,
            cast(coalesce(sum(length) filter (where why is null), 0) as bigint) as total_bytes from outcomes group by repo_id),
            g as (select repo_id, reason_code, count(*) as n from skips group by all),
            t as (select repo_id, cast(sum(n) as bigint) as skipped, string_agg(concat(reason_code, ': ', n), chr(10) order by {PLACE.format('reason_code')}, reason_code) as skip_summary from g group by repo_id)
            select k.repo_id, files_selected, estimated_tokens, total_bytes, {human('total_bytes')} as request_size, coalesce(skipped, 0) as skipped, coalesce(skip_summary, '') as skip_summary from k left join t on t.repo_id = k.repo_id""",
        "progress_events": using("vrepo", **failing()) + "select repo_id, event_type, row_number() over (partition by repo_id order by early desc, relative_path) as completed, "
                           "count(*) over (partition by repo_id) as total, relative_path, detail from told union all select repo_id, 'files_discovered', 0, count(*), null, null from told group by repo_id",
        "observer_events": using("vrepo", **failing()) + "select repo_id, relative_path, event_type, detail, case when event_type = 'file_completed' and ends_with(relative_path, '.js') then 'ValueError: no scripts' end as observer_error from told",
        "tree_lines": using("vrepo", **judged(200)) + TREE_PARTS + TREE_LINES,
        "tree_and_files": using("vrepo", **judged(200)) + TREE_PARTS + f""", t as ({TREE_LINES}),
            a as (select repo_id, 'tree' as kind, sort_key as k, line from t union all select repo_id, 'files', p, p from f),
            n as (select *, row_number() over (partition by repo_id, kind order by k) - 1 as place from a)
            select repo_id, kind, cast(place // 25 as bigint) as piece, string_agg(line, chr(10) order by place) as text from n group by all""",
        "dir_tree": using("vsummary", **DIRS) + "select repo_id, dir, n_files, n_dirs from facts",
        # What stands for each directory, and what each summarised directory then holds.
        "dir_summaries": using("vsummary", **ROLLUP) + f""", follow as (select repo_id, dir, dir as item from dirs union all
              select w.repo_id, w.dir, coalesce(d.dir, f.file_path) from follow w join facts x on x.repo_id = w.repo_id and x.dir = w.item and x.n_files + x.n_dirs = 1
              left join dirs d on d.repo_id = w.repo_id and {parent_of('d.dir')} = w.item left join fs f on f.repo_id = w.repo_id and {parent_of('f.file_path')} = w.item),
            stands as (select repo_id, dir, arg_max(item, length(item)) as item from follow group by all),
            items as (select repo_id, {parent_of('file_path')} as dir, false as is_dir from fs union all
              select s.repo_id, {parent_of('s.dir')}, x.dir is not null from stands s left join facts x on x.repo_id = s.repo_id and x.dir = s.item),
            held as (select repo_id, dir, count(*) filter (not is_dir) as n_files, count(*) filter (is_dir) as n_dirs from items group by all)
            select h.repo_id, h.dir, concat(h.n_files, ' files and ', h.n_dirs, ' directories, ', b.n, ' files in all') as said, cast(null as varchar) as error
            from held h join stands s on s.repo_id = h.repo_id and s.dir = h.dir and s.item = h.dir join below b on b.repo_id = h.repo_id and b.dir = h.dir
            join sizes z on z.repo_id = h.repo_id and z.n > 15""",
        "dir_rollup": using("vsummary", **ROLLUP) + """select f.repo_id, f.file_path, 'file' as kind, f.description from fs f join sizes z on z.repo_id = f.repo_id
            where z.n <= 15 or not contains(f.file_path, '/') or exists (select 1 from ends e where e.repo_id = f.repo_id and e.item = f.file_path)
            union all select e.repo_id, e.item, 'directory', concat(x.n_files, ' files and ', x.n_dirs, ' directories, ', b.n, ' files in all') from ends e join sizes z on z.repo_id = e.repo_id and z.n > 15
            join facts x on x.repo_id = e.repo_id and x.dir = e.item join below b on b.repo_id = e.repo_id and b.dir = e.item""",
        "enrich_rows": using("vcode", **SOURCES, **JS_LISTS) + f"""select v.repo_id, v.relative_path as file_path, {FIRST_LINE.replace('content', 'v.content')} as description,
            cast(len(string_split(v.content, chr(10))) - case when v.content = '' or v.content[-1] = chr(10) then 1 else 0 end as bigint) as n_lines,
            cast(coalesce((select len({PY_LIST}) from py where py.repo_id = v.repo_id and py.path = v.relative_path), (select count(*) from jsmods j where j.repo_id = v.repo_id and j.path = v.relative_path), 0) as bigint) as n_imports,
            array_to_string(regexp_extract_all(v.content, '(?m)^[ \\t]*((?:#{{1,6}} |class |def |function |export |interface |struct |func |fn )[^\\n]*)', 1), '|') as outline from vcode v""",
        "enrich_udf": v + "select repo_id, relative_path as file_path, case kind when 2 then 'invalid JSON' when 3 then 'RuntimeError: busy' when 4 then 'too long' end as error, "
                          "case when kind < 2 then concat(length(concat(relative_path, ' in ', file_type, ': ', content)), ' characters') end as said from "
                          "(select *, list_sum(list_transform(regexp_extract_all(relative_path, '[0-9]'), lambda d: cast(d as int))) % 5 as kind from vrepo) x",
        "parse_summary": using("vanswers") + """select doc_id, case when ok then json_extract_string(answer, '$.file_path') else path end as file_path, case when ok then json_extract_string(answer, '$.description') end as description,
            case when ok then json_extract_string(answer, '$.error') else 'invalid JSON' end as error from (select *, case when json_valid(answer) then json_type(answer) = 'OBJECT' else false end as ok from vanswers) x""",
        "parse_review": using("vreviews", p=r"select event_id, coalesce(nullif(regexp_extract(answer, '(?s)```(?:json)?\s*(.*)```', 1), ''), answer) as a from vreviews",
                              q="select event_id, case json_type(a, '$.score') when 'VARCHAR' then try_cast(json_extract_string(a, '$.score') as double) when 'DOUBLE' then cast(json_extract(a, '$.score') as double) end as s, "
                                "case when json_type(a, '$.feedback') = 'VARCHAR' then json_extract_string(a, '$.feedback') end as f from p where json_valid(a)")
        + "select p.event_id, case when f is not null then s end as score, case when s is not null then f end as feedback, case when s is null or f is null then 'invalid review' end as error from p left join q using (event_id)",
        "refine_best": using("vattempts") + """, t as (select *, coalesce(max(case when score >= 8.5 then 1 else 0 end) over (partition by k order by iteration rows between unbounded preceding and 1 preceding), 0) as stopped from vattempts where iteration <= 3)
            select k, cast(count(*) as bigint) as rounds, cast(arg_max(iteration, (score, -iteration)) filter (where score > 0) as bigint) as best_iteration, max(score) filter (where score > 0) as best_score from t where stopped = 0 group by k""",
        "refine_loop": f"""with recursive r as (select cast(doc_id as varchar) as k, source, length(text) as n, cast(1 as bigint) as iteration, concat(source, ':', length(text), ':1;') as text from documents
            union all select k, source, n, iteration + 1, concat(text, source, ':', n, ':', iteration + 1, ';') from r where iteration < 3 and {_SCORE} < 8.5)
            select k, iteration, {_SCORE} as score, concat('scored ', length(text)) as feedback, text from r""",
    }


_SCORE = "(list_sum(list_transform(string_split(text, ''), lambda ch: ascii(ch))) % 100) / cast(10 as double)"
