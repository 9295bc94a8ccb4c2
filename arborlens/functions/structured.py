"""JSON columns: summaries, reviews, request texts and configuration hashes."""

import hashlib
import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from arborlens.functions.text import fill

REQUEST_TEMPLATE = (
    "Describe this file as one JSON object with file_path and description.\n"
    "Path: {file_path}\nLanguage: {language}\n\n{content}\n"
)


def request_text(path: Column, language: Column, content: Column,
                 template: str = REQUEST_TEMPLATE) -> Column:
    """The user's template filled for one file."""
    return fill(template, file_path=path, language=language, content=content)


def request_of(row: dict, template: str = REQUEST_TEMPLATE) -> str:
    """The same for a row that is at hand as a dictionary; null values are empty."""
    named = {"file_path": row.get("file_path"), "language": row.get("language"), "content": row.get("content")}
    return template.format(**{k: "" if v is None else v for k, v in named.items()})


def template_hash(template: str = REQUEST_TEMPLATE) -> str:
    return hashlib.sha256(template.encode("utf-8")).hexdigest()


def config_hash(provider=None, model=None, base_url=None, template: str = REQUEST_TEMPLATE) -> str:
    """Hash of one effective configuration, computed once on the driver."""
    settings = {
        "provider": provider,
        "model": model,
        "base_url": base_url,
        "prompt_template_hash": template_hash(template),
    }
    return hashlib.sha256(json.dumps(settings, sort_keys=True).encode()).hexdigest()


def config_hash_column(provider: Column, model: Column, base_url: Column,
                       template: str = REQUEST_TEMPLATE) -> Column:
    """The same hash for configurations held as rows."""
    def escaped(sign: Column) -> Column:
        """A sign beyond ASCII as its UTF-16 numbers."""
        number = F.lower(F.hex(F.encode(sign, "UTF-16BE")))
        return F.when(F.ascii(sign) < 127, sign).otherwise(F.regexp_replace(number, "(.{4})", r"\\u$1"))

    def quoted(value: Column) -> Column:
        inner = F.to_json(F.array(value))
        inner = F.substr(inner, F.lit(2), F.length(inner) - 2)
        plain = (F.octet_length(inner) == F.length(inner)) & ~F.contains(inner, F.lit("\x7f"))
        return F.coalesce(
            F.when(value.isNotNull(), F.when(plain, inner).otherwise(F.array_join(F.transform(F.split(inner, ""), escaped), ""))),
            F.lit("null"),
        )

    return F.sha2(
        F.concat(
            F.lit('{"base_url": '), quoted(base_url),
            F.lit(', "model": '), quoted(model),
            F.lit(f', "prompt_template_hash": "{template_hash(template)}", "provider": '),
            quoted(provider), F.lit("}"),
        ),
        256,
    )


def json_part(answer: Column) -> Column:
    """The answer if it is JSON, else what stands in its fenced block, if it has one."""
    fenced = F.regexp_extract(answer, r"(?s)```(?:json)?\s*(.*)```", 1)
    return F.when(F.try_parse_json(answer).isNull() & (fenced != ""), F.rtrim(fenced)).otherwise(answer)


def summary_fault(answer: str | None) -> str | None:
    """The error that :func:`parse_summary` finds in an answer, for code that has it as a Python string."""
    fenced = re.search(r"```(?:json)?\s*(.*)```", answer or "", re.DOTALL)
    for text in [answer, fenced and fenced.group(1)]:
        try:
            found = json.loads(text or "")
        except ValueError:
            continue
        if not isinstance(found, dict):
            break
        error = found.get("error")
        return error if error is None or isinstance(error, str) else json.dumps(error, separators=(",", ":"), ensure_ascii=False)
    return "invalid JSON"


def parse_summary(answer: Column, path: Column) -> Column:
    """Struct of file_path, description, summary (VARIANT) and error.

    The answer may stand in a fenced block. One that is not a JSON object becomes
    an error for its path.
    """
    parsed = F.try_parse_json(json_part(answer))
    good = F.coalesce(F.startswith(F.schema_of_variant(parsed), F.lit("OBJECT")), F.lit(False))
    return F.struct(
        F.when(good, F.try_variant_get(parsed, "$.file_path", "string")).otherwise(path).alias("file_path"),
        F.when(good, F.try_variant_get(parsed, "$.description", "string")).alias("description"),
        F.when(good, parsed).alias("summary"),
        F.when(
            good, F.try_variant_get(parsed, "$.error", "string")
        ).otherwise(F.lit("invalid JSON")).alias("error"),
    )


_NUMBER = r"\A\s*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\s*\z"


def parse_review(answer: Column) -> Column:
    """Struct of score, feedback and error.

    The answer may stand in a fenced block. Both fields are required: a score
    that is a number, a truth value or a text of a number, and a feedback that is a
    text. Anything else is an error, and then both fields are null.
    """
    parsed = F.try_parse_json(json_part(answer))
    is_object = F.startswith(F.schema_of_variant(parsed), F.lit("OBJECT"))
    score, feedback = (F.try_variant_get(parsed, f"$.{name}", "variant") for name in ("score", "feedback"))
    kind, text = F.schema_of_variant(score), F.try_variant_get(score, "$", "string")
    number = F.when(kind == "STRING", F.when(text.rlike(_NUMBER), F.trim(text).try_cast("double"))).when(
        kind == "BOOLEAN", F.try_variant_get(score, "$", "boolean").cast("double")).when(
        kind != "VOID", F.try_variant_get(score, "$", "double"))
    said = F.when(F.schema_of_variant(feedback) == "STRING", F.try_variant_get(feedback, "$", "string"))
    good = F.coalesce(is_object & number.isNotNull() & said.isNotNull(), F.lit(False))
    return F.struct(
        F.when(good, number).alias("score"), F.when(good, said).alias("feedback"),
        F.when(~good, F.lit("invalid review")).alias("error"),
    )
