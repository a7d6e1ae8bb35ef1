"""Projections over sample payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Declared column encodings and the Spark type each one stores.
ENCODINGS = {
    "jpeg": "binary",
    "png": "binary",
    "bytes": "binary",
    "str": "string",
    "int": "bigint",
    "float64": "double",
}

# Leading bytes, in hex, of the image kinds a decoder opens.
MAGIC_BYTES = {
    "jpeg": "FFD8FF",
    "png": "89504E470D0A1A0A",
    "gif": "47494638",
    "bmp": "424D",
    "tiff": "49492A00",
}

# Decimal and binary units of a size.
BYTE_UNITS = {
    "B": 1,
    "KB": 1000,
    "MB": 1000**2,
    "GB": 1000**3,
    "TB": 1000**4,
    "KIB": 1024,
    "MIB": 1024**2,
    "GIB": 1024**3,
    "TIB": 1024**4,
}


def has_field(schema: T.StructType, path: str) -> bool:
    current: T.DataType = schema
    for name in path.split("."):
        if not isinstance(current, T.StructType) or name not in current.names:
            return False
        current = current[name].dataType
    return True


def optional_text(df: DataFrame, path: str = "text.content") -> Column:
    """The text column, or a null of the same type where the table has none."""
    return F.col(path) if has_field(df.schema, path) else F.lit(None).cast("string")


def encode_text(text: Column | str) -> Column:
    return F.encode(text, "UTF-8")


def decode_text(df: DataFrame, column: str, strict: bool = True) -> Column:
    """Text as string whatever the stored type; malformed UTF-8 fails, or gets replacement characters."""
    if isinstance(df.schema[column].dataType, T.StringType):
        return F.col(column)
    if strict:
        return F.decode(F.col(column), "UTF-8")
    return F.make_valid_utf8(F.col(column).cast("string"))


def payload_size(*parts: Column | str) -> Column:
    """Payload bytes of a sample: what shard limits are compared to."""
    total = F.lit(0).cast("long")
    for part in parts:
        total = total + F.coalesce(F.octet_length(part), F.lit(0)).cast("long")
    return total


def byte_count(text: Column) -> Column:
    """``64MB`` or ``1 GiB`` to bytes; null for an unknown unit."""
    unit = F.upper(F.regexp_extract(text, r"^\s*[0-9.]+\s*([A-Za-z]*)\s*$", 1))
    number = F.regexp_extract(text, r"^\s*([0-9.]+)\s*[A-Za-z]*\s*$", 1).try_cast("double")
    factor = F.when(unit == "", F.lit(1))
    for name, value in BYTE_UNITS.items():
        factor = factor.when(unit == name, F.lit(value))
    return (number * factor).cast("long")


def sniff_kind(content: Column) -> Column:
    """Image kind by leading bytes; ``unknown`` otherwise."""
    head = F.hex(F.substring(content, 1, 8))
    kind = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, magic in MAGIC_BYTES.items():
        kind = kind.when(head.startswith(magic), F.lit(name))
    # RIFF....WEBP keeps a length between its two marks.
    kind = kind.when(
        (F.hex(F.substring(content, 1, 4)) == "52494646") & (F.hex(F.substring(content, 9, 4)) == "57454250"),
        F.lit("webp"),
    )
    return kind.otherwise(F.lit("unknown"))


def encode_columns(df: DataFrame, encodings: dict[str, str]) -> DataFrame:
    """Select the declared columns in their stored types; a mismatch fails before any task starts."""
    selected = []
    for name, encoding in encodings.items():
        if encoding not in ENCODINGS:
            raise ValueError(f"column {name!r}: unknown encoding {encoding!r}")
        if name not in df.columns:
            raise ValueError(f"column {name!r} is declared but missing")
        actual, wanted = df.schema[name].dataType, ENCODINGS[encoding]
        if encoding == "int" and isinstance(actual, (T.ByteType, T.ShortType, T.IntegerType)):
            selected.append(F.col(name).cast("long").alias(name))
        elif actual.simpleString() == wanted:
            selected.append(F.col(name))
        else:
            raise ValueError(f"column {name!r}: {actual.simpleString()} cannot be stored as {encoding!r}")
    return df.select(*selected)
