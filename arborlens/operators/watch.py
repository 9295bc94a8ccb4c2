"""Observers of a run, which cannot break it: one called per event by the tasks, one with the counts at the end."""

from collections.abc import Callable, Iterator

import pyarrow as pa

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arborlens.operators import report
from arborlens.operators.select import COMPLETED

EVENT = ("repo_id", "relative_path", "event_type", "detail")


class Watch:
    """Counts of the outcomes that pass by, without a pass of their own.

    ``rows`` is the table to go on with. After an action on it, :meth:`tell`
    gives the counts to the observer; what the observer raises is kept in
    ``errors`` and goes no further.
    """

    def __init__(self, outcomes: DataFrame, name: str = "outcomes"):
        self._seen = Observation(name)
        completed = F.col("outcome") == COMPLETED
        self.rows = outcomes.observe(
            self._seen,
            F.count(F.lit(1)).alias("total"),
            F.count_if(completed).alias("completed"),
            F.count_if(~completed).alias("skipped"),
        )
        self.errors: list[str] = []

    def tell(self, observer: Callable[[dict], None]) -> dict:
        counts = dict(self._seen.get)
        try:
            observer(counts)
        except Exception as problem:  # noqa: BLE001 - an observer must not end the run
            self.errors.append(f"{type(problem).__name__}: {problem}")
        return counts


def with_events(outcomes: DataFrame) -> DataFrame:
    """Outcomes with the event of each file, ``event_type`` and ``detail``."""
    return outcomes.withColumns({"event_type": report.event_type(), "detail": report.event_detail()})


def tell_each(rows: DataFrame, make: Callable[[], Callable[[dict], None]]) -> DataFrame:
    """The rows, each handed to an observer as it passes by, with ``observer_error``.

    ``make()`` is called once per task and returns the observer, which gets the
    columns of ``EVENT``, and ``completed`` and ``total`` if the rows have them, as
    a dictionary. It is called while the run goes on, by the task that has dealt
    with the file; what it raises is kept with the row and goes no further. A
    task that is run again tells its events again.
    """
    columns = rows.columns
    told = [c for c in (*EVENT, "completed", "total") if c in columns]

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            observer, broken = make(), None
        except Exception as problem:  # noqa: BLE001 - an observer must not end the run
            observer, broken = None, f"{type(problem).__name__}: {problem}"
        for batch in batches:
            errors = []
            for values in zip(*(batch.column(c).to_pylist() for c in told)):
                error = broken
                if observer is not None:
                    try:
                        observer(dict(zip(told, values)))
                    except Exception as problem:  # noqa: BLE001 - an observer must not end the run
                        error = f"{type(problem).__name__}: {problem}"
                errors.append(error)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(errors, pa.string())], names=[*columns, "observer_error"])

    fields = [T.StructField(f.name, f.dataType, True) for f in rows.schema.fields]
    return rows.mapInArrow(tell, T.StructType([*fields, T.StructField("observer_error", T.StringType())]))
