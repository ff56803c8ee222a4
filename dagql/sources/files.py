"""Sources: file splits, delimited text, whole lines, Parquet and job properties. All are lazy Spark reads with declared schemas."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class FileSplit:
    """One file of one node. The node and device are kept for the record; Spark places the work."""

    node: str
    path: str
    device: int = 0

    @staticmethod
    def parse(text: str) -> list[FileSplit]:
        """``node:path`` pairs, comma-separated; a text without a node is a path (or URI) as it stands."""
        out = []
        for part in filter(None, (p.strip() for p in text.split(","))):
            node, colon, path = part.partition(":")
            out.append(FileSplit(node, path) if colon and not path.startswith("//") and "/" not in node else FileSplit("", part))
        if not out:
            raise ValueError("no file split")
        return out


class TupleParser:
    """How a line of text becomes fields: ``fields`` gives a text Column for each field of the schema, null where it is missing."""

    def fields(self, line: Column, schema: T.StructType) -> list[Column]:
        raise NotImplementedError


@dataclass(frozen=True)
class Delimited(TupleParser):
    """Fields between separators, without quotes or escapes; a separator at the line's end adds no field."""

    sep: str = "|"

    def fields(self, line: Column, schema: T.StructType) -> list[Column]:
        parts = F.split(line, f"\\Q{self.sep}\\E", -1)
        return [F.get(parts, F.lit(i)) for i in range(len(schema))]


@dataclass(frozen=True)
class FixedWidth(TupleParser):
    """Fields of a width each, padded with blanks."""

    widths: tuple[int, ...]

    def fields(self, line: Column, schema: T.StructType) -> list[Column]:
        starts = [sum(self.widths[:i]) for i in range(len(self.widths))]
        return [F.when(F.char_length(line) > a, F.rtrim(F.substring(line, a + 1, w))) for a, w in zip(starts, self.widths, strict=True)]


def read_parsed(spark: SparkSession, paths: list[str], schema: T.StructType, parser: TupleParser) -> DataFrame:
    """Lines of text through a parser. Text fields stay as they are, also empty ones; other fields that are empty or don't fit
    their type are null. Variants, maps, arrays and structs are read as JSON."""
    d = spark.read.text(list(paths))

    def value(c: Column, t: T.DataType) -> Column:
        if isinstance(t, T.VariantType):
            return F.try_parse_json(c)
        if isinstance(t, (T.MapType, T.ArrayType, T.StructType)):
            return F.from_json(c, t)
        return c if isinstance(t, T.StringType) else c.try_cast(t)

    return d.select(*[value(c, f.dataType).alias(f.name) for c, f in zip(parser.fields(F.col("value"), schema), schema, strict=True)])


def read_delimited(spark: SparkSession, paths: list[str], schema: T.StructType, sep: str = "|") -> DataFrame:
    """Delimited text without header, quotes or escapes; a delimiter at the line's end adds no field."""
    return read_parsed(spark, paths, schema, Delimited(sep))


def read_lines(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Whole text lines as ``value``."""
    return spark.read.text(paths)


def load(spark: SparkSession, splits: str, schema: T.StructType, sep: str = "|", parser: TupleParser | None = None) -> DataFrame:
    """Files of splits with a declared schema: Parquet by its extension (fields by name), else text by the parser, or delimited."""
    paths = [s.path for s in FileSplit.parse(splits)]
    if all(p.rstrip("/").endswith(".parquet") for p in paths):
        d = spark.read.parquet(*paths)
        return d.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema]) if schema.fields else d.select()
    return read_parsed(spark, paths, schema, parser or Delimited(sep))


def read_properties(text: str, delimiter: str = "=") -> dict[str, str]:
    """Job properties: ``key<delimiter>value`` lines, both trimmed; lines without the delimiter are skipped."""
    pairs = (line.partition(delimiter) for line in text.splitlines())
    return {k.strip(): v.strip() for k, d, v in pairs if d}


def single_row(spark: SparkSession) -> DataFrame:
    """One row without fields: the source of constant expressions."""
    return spark.range(1).select()
