"""Type names of scripts and their Spark types.

``tuple``, ``bag`` and ``map`` carry no element types, so their values are variants.
"""

from __future__ import annotations

from pyspark.sql import types as T

NAMES = {
    "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "chararray": T.StringType(),
    "tuple": T.VariantType(), "bag": T.ArrayType(T.VariantType()), "map": T.MapType(T.StringType(), T.VariantType()),
}


def spark_type(name: str) -> T.DataType:
    try:
        return NAMES[name.lower()]
    except KeyError:
        raise ValueError(f"no type {name!r}; there are {', '.join(NAMES)}") from None


def schema(fields: list[tuple[str, str]] | list[str]) -> T.StructType:
    """Of (name, type name) pairs, or of type names alone: then the fields are f0, f1, ..."""
    pairs = [(f"f{i}", f) if isinstance(f, str) else f for i, f in enumerate(fields)]
    return T.StructType([T.StructField(n, spark_type(t)) for n, t in pairs])
