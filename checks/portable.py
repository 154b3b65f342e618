"""Plain column types for the comparison: text for times and nested values, bigint and double for numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def portable(df: DataFrame) -> DataFrame:
    columns = []
    for field in df.schema:
        kind, column = field.dataType.typeName(), F.col(f"`{field.name}`")
        if kind in ("timestamp", "timestamp_ntz"):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif kind == "date":
            column = column.cast("string")
        elif kind in ("byte", "short", "integer"):
            column = column.cast("bigint")
        elif kind in ("decimal", "float"):
            column = column.cast("double")
        elif kind in ("array", "map", "struct"):
            column = F.to_json(column)
        columns.append(column.alias(field.name))
    return df.select(*columns)
