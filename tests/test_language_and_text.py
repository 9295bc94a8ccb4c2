import json

from pyspark.sql import functions as F

from arborlens.functions import imports, language, structured


def test_by_extension_and_name(values):
    names = {"a.PY": "python", "main.tsx": "typescript", ".dockerignore": "dockerfile", ".gitignore": None, "README": None,
             ".py": "python", "x.unknown": None, "a.b.sql": "sql"}
    assert values(language.by_extension, "string", *names) == list(names.values())
    files = {"DOCKERFILE": "dockerfile", "Jenkinsfile": "groovy", "CMakeLists.txt": "cmake", "a/Gemfile.lock": "ruby", "zzz": None}
    assert values(language.by_name, "string", *files) == list(files.values())


def test_by_shebang(values):
    lines = {
        "#!/usr/bin/env python": "python", "#!/usr/bin/python3": "python", "#! /bin/python3.11 -u": "python", "#!/bin/bash": "bash",
        "#!/usr/bin/env bash": "bash", "#!/bin/sh": "sh", "#!/usr/bin/node": "javascript", "#!/usr/bin/env deno": "javascript",
        "#!/bin/bun": None, "#!/usr/bin/env ruby": "ruby", "#!/usr/bin/perl": "perl", "#!/usr/bin/env php": "php",
        "#!/usr/bin/env lua": "lua", "#!/usr/bin/lua": None, "  #!/usr/bin/env python": "python", "\t#!/bin/bash": "bash",
        "print('hello')\n#!/usr/bin/env python": None, "": None, "#!/usr/local/bin/python": None, "#!/usr/bin/pythonic": None,
        "#!/usr/bin/env   racket  -x": "racket", "#!/usr/bin/env guile": "scheme", "#!/usr/bin/env tclsh": "tcl", "#!/usr/bin/env awk": "awk",
    }
    assert values(language.by_shebang, "string", *lines) == list(lines.values())


TEXTS = {
    "\nimport os\nimport sys\nclass Test:\n    pass\n": "python",
    "\nfunction greet(name) { return name; }\nmodule.exports = greet;\n": "javascript",
    "\ninterface User {\n    name: string;\n    readonly id: number;\n}\n": "typescript",
    "\nname: test\nnested:\n  key: value\n": "yaml",
    "\n# My Project\n## Installation\n```bash\npip install x\n```\n": "markdown",
    "FROM python:3.12\nRUN pip install -r r.txt\nCOPY . /app\n": "dockerfile",
    "#!/bin/bash\necho \"Hello\"\nexport PATH=$PATH:/x\n": "bash",
    '{"name": "test"}': "json",
    "require 'json'\nputs 'hello'\nclass Foo\nend\n": "ruby",
    "hello world": None, "": None,
    "x" * 8192 + "\nimport os\nclass A": None,
}


def test_by_content(values):
    found = values(lambda t: language.by_content(language.sample(t)), "string", *TEXTS)
    assert found == list(TEXTS.values())


def test_order_of_detectors(spark):
    cases = [
        ("script.py", "#!/usr/bin/env node\nconst x = 1", "python"), ("Dockerfile", "#!/usr/bin/env python\n", "dockerfile"),
        ("script", "#! /usr/bin/env node\nimport os\nclass A: pass", "javascript"),
        ("unknown_file", "\nimport os\nclass A: pass", "python"), ("FILE", "nothing matches here", "unknown"),
        ("script", "hello\x00world", "unknown"), ("empty.txt", "", "unknown"),
    ]
    rows = spark.createDataFrame(cases, "n string, t string, want string")
    for row in rows.withColumn("got", language.detect(F.col("n"), F.col("t"))).collect():
        assert row["got"] == row["want"], row


def test_python_imports(values):
    texts = {
        "import os\nimport sys": ["os", "sys"], "import numpy as np": ["numpy"], "import os, sys, json": ["os", "sys", "json"],
        "from src.utils import helper, config": ["src.utils"], "from . import helper": ["."], "from .models import User": [".models"],
        "import os  # note": ["os"], "x = 1": [], "from src.utils import (\n  helper,\n)": ["src.utils"],
        "\n\n   import a\n\t from b import c\nnot import d\nimportant e": ["a", "b"], "import\n  late": ["late"],
        "import #x\nimport y,, z ,": ["y", "z"], "a = 1; import b\rimport c": [], "import a import b": ["a"],
    }
    assert values(imports.python_imports, "string", *texts) == list(texts.values())


def test_python_requests_name_siblings(values):
    text = "from . import a, b as c\nfrom .. import (d,\n e)\nfrom .x import y\nimport os, os\n"
    assert values(imports.python_requests, "string", text) == [["os", ".x", ".a", ".b", "..d"]]


def test_script_imports(values):
    texts = {
        "import { helper } from './utils.js';": ["./utils.js"], "import config from \"./config.js\"": ["./config.js"],
        "const u = require('./user.js');": ["./user.js"], "import _ from 'lodash'": ["lodash"], "import('./module.js')": ["./module.js"],
        "const x = 1": [], "import a from 'x'\nimport b from 'x'\nrequire('x')\nimport( 'y' )\nrequire(\"y\")": ["x", "x", "y"],
        "import {\n a\n} from './multi'": [], "import 'bare'": [],
    }
    assert values(imports.script_imports, "string", *texts) == list(texts.values())
    wide = values(lambda t: imports.script_imports(t, wide=True), "string", "import {\n a\n} from './m'\nimport 'b'\nexport * from './e'")
    assert sorted(wide[0]) == ["./e", "./m", "b"]


def test_configuration_hash(spark):
    rows = spark.createDataFrame([("p", None, 'u"x\\')], "a string, b string, c string")
    got = rows.select(structured.config_hash_column(F.col("a"), F.col("b"), F.col("c"))).first()[0]
    assert got == structured.config_hash("p", None, 'u"x\\')
    settings = ["é", "漢字 \U0001f600 x", "\x7f~", "a", "tab\t", None]
    rows = spark.createDataFrame([(s, i) for i, s in enumerate(settings)], "a string, i int")
    got = rows.orderBy("i").select(structured.config_hash_column(F.col("a"), F.lit("m"), F.lit(None).cast("string"))).collect()
    assert [r[0] for r in got] == [structured.config_hash(s, "m") for s in settings]
    assert len({structured.config_hash("p"), structured.config_hash("q"), structured.config_hash("p", template="t")}) == 3


def test_request_and_answers(spark, values):
    one = spark.range(1)
    text = structured.request_text(F.lit("a.py"), F.lit("python"), F.lit("x"), "{{{file_path}}} {language}: {content}")
    assert one.select(text).first()[0] == "{a.py} python: x"
    answers = ['{"file_path": "f", "description": "d", "n": 1}', "no json", "[1]", '"text"', '{"error": "e"}']
    parsed = values(lambda a: structured.parse_summary(a, F.lit("p")), "string", *answers)
    assert [(p["file_path"], p["description"], p["error"]) for p in parsed] == [
        ("f", "d", None), ("p", None, "invalid JSON"), ("p", None, "invalid JSON"), ("p", None, "invalid JSON"), (None, None, "e")]
    assert json.loads(parsed[0]["summary"].toJson()) == {"file_path": "f", "description": "d", "n": 1}
    reviews = {
        '{"score": 7.5, "feedback": "ok"}': (7.5, "ok", None), '```json\n{"score": "8", "feedback": "x"}\n```': (8.0, "x", None), '{"score": true, "feedback": ""}': (1.0, "", None),
        '{"score": " 1e1 ", "feedback": "x", "more": 1}': (10.0, "x", None),
    } | {bad: (None, None, "invalid review") for bad in (
        "bad", "", '{"score": 7}', '{"feedback": "x"}', '{"score": null, "feedback": "x"}', '{"score": "high", "feedback": "x"}', '{"score": "1d", "feedback": "x"}',
        '{"score": [1], "feedback": "x"}', '{"score": 1, "feedback": 2}', '{"score": 1, "feedback": null}', "[1]", "7")}
    assert [tuple(r) for r in values(structured.parse_review, "string", *reviews)] == list(reviews.values())
    assert tuple(values(structured.parse_review, "string", None)[0]) == (None, None, "invalid review")
