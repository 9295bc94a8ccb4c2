"""Views over the given tables, as one SQL text for both engines.

``{BYTES}``, ``{SHA}``, ``{BLOB}`` and ``{HEX}`` stand for the few functions that
the engines name differently; ``{documents}`` and so on for the tables.
"""

from pyspark.sql import DataFrame, SparkSession

TABLES = ("documents", "events", "pages")

_PLACE = """concat(dir, case when dir='' then '' else '/' end, 'm', cast(doc_id%100 as varchar(20)), ext)"""
_DIR = """case cast(floor(doc_id/10) as bigint)%5 when 0 then 'src' when 1 then 'src/utils'
   when 2 then 'node_modules/pkg' when 3 then 'docs' else '' end"""
_EXT = """case doc_id%10 when 0 then '.py' when 1 then '.js' when 2 then '.ts' when 3 then '.md' when 4 then '.txt'
   when 5 then '.json' when 6 then '.PY' when 7 then '' when 8 then '.mjs' else '.lock' end"""
_REPO = "concat('r', cast(cast(floor(doc_id/100) as bigint) as varchar(20)))"
_TWIN = "cast((doc_id+50)%100 as varchar(20))"

# Virtual repositories of 100 files.
VREPO = f"""
select doc_id, repo_id, relative_path, file_name, file_type, cast({{BYTES:content}} as bigint) as length, content from (
 select doc_id, {_REPO} as repo_id, {_PLACE} as relative_path,
  concat('m', cast(doc_id%100 as varchar(20)), ext) as file_name, lower(ext) as file_type, concat(head, text) as content
 from (select doc_id, text, {_EXT} as ext, {_DIR} as dir,
  case when doc_id%10 in (0,6) then concat('import os', chr(10), 'from .m', {_TWIN}, ' import x', chr(10))
   when doc_id%10 in (1,2,8) then concat('import a from ''./m', {_TWIN}, '''', chr(10), 'const b = require(''lodash'')', chr(10))
   when doc_id%10 = 7 then concat('#!/usr/bin/env python', chr(10)) else '' end as head
 from {{documents}}) a) b
"""

# The same trees with packages, index files and more kinds of imports.
VCODE = f"""
select doc_id, repo_id, case doc_id%100 when 12 then 'src/utils/index.ts' when 16 then 'src/utils/__init__.py'
   else relative_path end as relative_path, concat(head, text) as content from (
 select doc_id, text, {_REPO} as repo_id, {_PLACE} as relative_path, head
 from (select doc_id, text, case doc_id%10 when 6 then '.py' else {_EXT} end as ext, {_DIR} as dir,
  case when doc_id%100 >= 40 then case when doc_id%10 in (0,6) then concat('import os', chr(10)) else '' end
   when doc_id%10 = 0 then concat('import os, sys as s', chr(10), 'from .m', {_TWIN}, ' import x', chr(10),
     'import utils, m0 # note', chr(10), '  from src.utils.m20 import y', chr(10))
   when doc_id%10 = 6 then concat('from . import m', {_TWIN}, ', m10 as t', chr(10), 'from ..m0 import y', chr(10), chr(10),
     'import src.utils.m10', chr(10), 'import utils.m60 as u', chr(10), 'from . import (m16,', chr(10), ' m20)', chr(10),
     'import _private', chr(10), 'from ... import m96', chr(10))
   when doc_id%10 in (1,2,8) then concat('import a from ''./m', {_TWIN}, '''', chr(10), 'const b = require(''lodash'')', chr(10),
     'const c = import( ''../m1'' )', chr(10), 'import {{d}} from "./utils/m11.js?x#y"; import e from ''./utils''', chr(10),
     'const f = require("./m', {_TWIN}, '"), g = require(''../../m41'')', chr(10), 'import h from ''./../src/./m2.ts''', chr(10))
   else '' end as head
 from {{documents}}) a) b
"""

# File contents as bytes, in six kinds.
VBYTES = """
select doc_id, case doc_id%6 when 0 then {BLOB:text} when 1 then {CAT:'89504E470D0A1A0A'} when 2 then {NUL:text}
  when 3 then {CAT:'DEADBEEF'} when 4 then {CAT:'504B0304'} else {HEX:''} end as content
from {documents}
"""

# Bytes with all kinds of line ends, and some that are not UTF-8.
VLINES = """
select doc_id, case doc_id%3 when 0 then {BLOB:replace(text, '. ', concat('.', chr(13), chr(10)))}
  when 1 then {BLOB:replace(text, '. ', concat('.', chr(13)))} else {CAT:'DEADBEEF'} end as content
from {documents}
"""

# Scored attempts per key.
VATTEMPTS = """
select user_id as k, cast(row_number() over (partition by user_id order by ts, event_id) as int) as iteration,
 (cast(round(value*100) as bigint)%1000)/cast(100 as double) as score from {events}
"""

# State left by an earlier run.
VCACHE = f"""
select repo_id, case doc_id%4 when 2 then concat('old/', relative_path) else relative_path end as file_path, case doc_id%4 when 1 then 'old' else {{SHA:content}} end as content_hash,
 case doc_id%4 when 3 then 'other' else file_type end as language, concat('s', cast(doc_id as varchar(20))) as summary,
 case when doc_id%40=4 then 'cfg-b' else 'cfg-a' end as config_hash, '1.0' as schema_version
from ({VREPO}) v
union all
select distinct {_REPO}, 'ghost.py', 'old', '.py', 'ghost', 'cfg-a', '1.0' from {{documents}}
"""

# Listing with resolved names.
VMANIFEST = f"""
select repo_id, concat('d', n) as relative_path, doc_id%5=0 as is_link, doc_id%15<>5 as is_dir,
 case when doc_id%14=6 then 'pruned' end as pruned_dir,
 case when doc_id%15=0 then '/outside/x' when doc_id%15=5 then concat('/repo/', repo_id, '/missing')
  when doc_id%5=0 then concat('/repo/', repo_id, '/d', m) else concat('/repo/', repo_id, '/d', n) end as resolved_path
from (select doc_id, {_REPO} as repo_id,
 cast(doc_id%100 as varchar(20)) as n, cast(cast(floor(doc_id%100/20) as bigint)*20+6 as varchar(20)) as m from {{documents}}) a
"""

# Stored cache texts, sound and damaged.
VSTORED = """
select doc_id, concat('r', cast(doc_id as varchar(20))) as repo_id, case doc_id%9
  when 0 then concat('{"schema_version": "1.0", "config_hash": "c", "entries": [{"file_path": "f', n, '", "content_hash": "h", "language": "', lang, '", "summary": {"description": "d', n, '"}, "mtime": 0}]}')
  when 1 then concat('[{"file_path": "f', n, '"}]')
  when 2 then concat('{"config_hash": "c', n, '", "entries": []}')
  when 3 then concat('{"schema_version": "1.0", "entries": [', n, ']}')
  when 4 then concat('{"schema_version": "1.0", "config_hash": "c', n, '", "entries": {"a": 1}}')
  when 5 then concat('{"schema_version": "1.0", "config_hash": "c", "entries": [{"file_path": "f', n, '", "content_hash": "h", "language": "l"}]}')
  when 6 then concat('{"schema_version": ', n)
  when 7 then concat('{"schema_version": "1.0", "config_hash": "c", "entries": [', n, ']}')
  else concat('{"schema_version": "1.0", "config_hash": "c', n, '", "entries": []}') end as raw
from (select doc_id, lang, cast(doc_id as varchar(20)) as n from {documents}) a
"""

# Answers of a model, usable and not.
VANSWERS = """
select doc_id, concat('p', cast(doc_id as varchar(20))) as path, case doc_id%4
  when 0 then concat('{"file_path": "f', n, '", "description": "about ', lang, '", "lines": [1, 2]}')
  when 1 then concat('["', lang, '", ', n, ']') when 2 then concat('Sorry, ', lang, ' ', n)
  else concat('{"file_path": "f', n, '", "error": "no ', source, '"}') end as answer
from (select doc_id, lang, source, cast(doc_id as varchar(20)) as n from {documents}) a
"""

VREVIEWS = """
select event_id, case event_id%7 when 0 then concat('{"score": ', n, ', "feedback": "', event_type, '"}')
  when 1 then concat('{"feedback": "', event_type, '"}') when 2 then event_type when 3 then concat('{"score": "', n, '", "feedback": "', event_type, '"}')
  when 4 then concat('{"score": ', n, ', "feedback": 7}') when 5 then concat('```json', chr(10), '{"score": ', n, ', "feedback": "', event_type, '"}', chr(10), '```')
  else concat('{"score": "', event_type, '", "feedback": "', event_type, '"}') end as answer
from (select event_id, event_type, cast(cast(user_id%100 as double)/10 as varchar(20)) as n from {events}) a
"""

# Files to be written to a disk; some names would be hidden to Spark's readers.
VFILES = f"""
select repo_id, concat(dir, case when dir='' then '' else '/' end, case doc_id%10 when 3 then '_' when 4 then '.' else '' end,
   'm', cast(doc_id%100 as varchar(20)), ext) as relative_path, text as content, doc_id
from (select doc_id, text, {_REPO} as repo_id, {_EXT} as ext, case cast(floor(doc_id/10) as bigint)%5 when 0 then 'src' when 1 then '.github/x'
   when 2 then 'a/b/_c' when 3 then 'docs' else '' end as dir from {{documents}}) a
"""

# Files of repositories of 100 and of 10 files, with summaries; some lack a path.
VSUMMARY = f"""
select case when cast(floor(doc_id/100) as bigint)%2=1 then concat('t', cast(cast(floor(doc_id/10) as bigint) as varchar(20))) else repo_id end as repo_id,
  case when doc_id%50=49 then '' when doc_id%100 < 3 then concat('deep/one/', relative_path) when doc_id%100 = 5 then concat('lone/way/', file_name)
   when doc_id%100 in (7, 8) then concat('pair/way/', file_name) else relative_path end as file_path,
  concat('about ', file_name) as description
from ({VREPO}) v
"""

VIEWS = {
    "vrepo": VREPO, "vcode": VCODE, "vbytes": VBYTES, "vlines": VLINES, "vattempts": VATTEMPTS,
    "vcache": VCACHE, "vmanifest": VMANIFEST, "vstored": VSTORED, "vanswers": VANSWERS,
    "vreviews": VREVIEWS, "vfiles": VFILES, "vsummary": VSUMMARY,
}

SPARK = {
    "BYTES": "octet_length({0})", "SHA": "sha2({0}, 256)", "BLOB": "cast({0} as binary)",
    "CAT": "(unhex({0}) || cast(text as binary))", "NUL": "(cast({0} as binary) || X'00')", "HEX": "unhex({0})",
}
DUCKDB = {
    "BYTES": "octet_length(encode({0}))", "SHA": "sha256({0})", "BLOB": "encode({0})",
    "CAT": "(from_hex({0}) || encode(text))", "NUL": "(encode({0}) || from_hex('00'))", "HEX": "from_hex({0})",
}


def _translate(text: str, words: dict[str, str]) -> str:
    """Put an engine's functions in the ``{NAME:argument}`` places."""
    for name, form in words.items():
        opening = "{" + name + ":"
        while opening in text:
            start = text.index(opening)
            end, open_braces = start + len(opening), 1
            while open_braces:
                open_braces += {"{": 1, "}": -1}.get(text[end], 0)
                end += 1
            text = text[:start] + form.format(text[start + len(opening):end - 1]) + text[end:]
    return text


def duckdb_view(name: str) -> str:
    text = _translate(VIEWS[name], DUCKDB)
    for table in TABLES:
        text = text.replace("{" + table + "}", table)
    return text


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """A given table.

    With ``spread``, rows are dealt out when there are fewer files than cores,
    so that heavy expressions use them all; a real corpus has many files.
    """
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if spread and len(rows.inputFiles()) < cores:
        rows = rows.repartition(cores)
    return rows


def view(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    text = _translate(VIEWS[name], SPARK)
    for each in TABLES:
        if "{" + each + "}" in text:
            rows = table(spark, sf_dir, each, spread)
            temp = f"_{each}_{abs(hash((sf_dir, spread)))}"
            rows.createOrReplaceTempView(temp)
            text = text.replace("{" + each + "}", temp)
    return spark.sql(text)
