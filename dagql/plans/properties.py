"""Jobs described by properties: a job's name, its input paths and its output path."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dagql.operators import relational
from dagql.sources import files, sinks

#: From a DataFrame of text lines (``value``) to the result's rows.
JOBS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "word_count": lambda lines: relational.word_count(lines, "value"),
    "identity": lambda lines: lines,
    "sort": lambda lines: relational.sort(lines, "value"),
    "distinct": lambda lines: lines.dropDuplicates(),
    "line_count": lambda lines: lines.agg(F.count(F.lit(1)).alias("n")),
}


def run(spark: SparkSession, text: str, jobs: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> None:
    """Runs the job that the properties name: ``job``, ``input.paths`` (comma-separated), ``output.path``, ``field.separator``."""
    p = files.read_properties(text)
    known = JOBS | (jobs or {})
    for key in ("job", "input.paths", "output.path"):
        if not p.get(key):
            raise ValueError(f"the job's properties lack {key}")
    if p["job"] not in known:
        raise ValueError(f"no job {p['job']}")
    lines = files.read_lines(spark, [x.strip() for x in p["input.paths"].split(",")])
    sinks.write_delimited(known[p["job"]](lines), p["output.path"], sep=p.get("field.separator", "\t"))
