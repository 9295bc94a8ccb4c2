"""Row enrichment: the default extractive summary and user-supplied functions."""

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlens.functions import imports, language, paths, structured
from arborlens.functions.text import strip

ENRICHED = "repo_id string, file_path string, summary string, error string"
ROWS_AT_ONCE = 64  # rows of a batch that are Python values at a time


# Lines that tell what a file holds: headings, and what it defines.
OUTLINE = r"(?m)^[ \t]*((?:#{1,6} |class |def |function |export |interface |struct |func |fn )[^\n]*)"


def with_default_summary(documents: DataFrame, text: str = "content") -> DataFrame:
    """Add description, outline, line and import counts of the whole text: deterministic, in plain columns.

    The description is the first line that is not blank; the outline lists all
    lines that are headings or begin a definition.
    """
    body = F.col(text)
    kind = language.graph_language(paths.extension(paths.base_name(F.col("file_path"))))
    found = (
        F.when(kind == "python", imports.python_imports(body))
        .when(kind.isNotNull(), imports.script_imports(body))
    )
    line_feeds = F.length(body) - F.length(F.replace(body, F.lit("\n"), F.lit("")))
    ends_open = ~F.endswith(body, F.lit("\n")) & (body != "")
    return documents.withColumns({
        "n_lines": (line_feeds + ends_open.cast("int")).cast("bigint"),
        "n_imports": F.coalesce(F.size(found), F.lit(0)).cast("bigint"),
        "description": strip(F.substring_index(strip(body), "\n", 1)),
        "outline": F.regexp_extract_all(body, F.lit(OUTLINE), F.lit(1)),
    })


def default_enrich(documents: DataFrame, text: str = "content") -> DataFrame:
    """Enriched rows with a JSON summary made by :func:`with_default_summary`."""
    rows = with_default_summary(documents, text)
    summary = F.to_json(F.struct("file_path", "description", "outline", "n_lines", "n_imports"))
    return rows.select(
        "repo_id", "file_path", summary.alias("summary"), F.lit(None).cast("string").alias("error")
    )


def enrich(documents: DataFrame, make: Callable[[], Callable[[dict], str]],
           concurrency: int | None = None, template: str = structured.REQUEST_TEMPLATE) -> DataFrame:
    """Enriched rows from a user function, made once per partition.

    ``make()`` returns a function from one row (a dict) to a summary text. Besides
    the columns, the row has ``request``: the ``template`` filled with its path,
    language and whole text. An exception becomes the error of its row and the
    others go on. ``concurrency`` bounds the number of tasks that call the
    function at a time.
    """
    if concurrency:
        documents = documents.repartition(concurrency)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = make()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                out = []
                for row in _frame(batch.slice(at, ROWS_AT_ONCE)).to_dict("records"):
                    summary, error = None, None
                    try:
                        summary = call(row | {"request": structured.request_of(row, template)})
                    except Exception as problem:  # noqa: BLE001 - any failure is the row's own
                        error = f"{type(problem).__name__}: {problem}"
                    out.append((row["repo_id"], row["file_path"], summary, error))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(column, pa.string()) for column in zip(*out)], names=["repo_id", "file_path", "summary", "error"])

    return documents.mapInArrow(run, ENRICHED)


def _frame(rows: pa.RecordBatch) -> pd.DataFrame:
    """Rows as Spark gives them to pandas: times without their zone, which is the session's."""
    frame = rows.to_pandas()
    for name in frame.select_dtypes("datetimetz"):
        frame[name] = frame[name].dt.tz_localize(None)
    return frame
