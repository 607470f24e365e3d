"""Results as CSV, JSON and newline-delimited JSON."""

from __future__ import annotations

import datetime
import decimal
import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def plain(x: Any) -> Any:
    """A cell as JSON holds it: bytes as hex, times and decimals as text."""
    if isinstance(x, bytes | bytearray):
        return x.hex()
    if isinstance(x, datetime.date | decimal.Decimal):
        return str(x)
    if isinstance(x, dict):
        return {str(k): plain(v) for k, v in x.items()}
    if hasattr(x, "asDict"):
        return {k: plain(v) for k, v in x.asDict().items()}
    return [plain(y) for y in x] if isinstance(x, list | tuple) else x


def event(**members: Any) -> str:
    """One line of a result stream."""
    return json.dumps(members, ensure_ascii=False)


def text_of(df: DataFrame, name: str) -> Column:
    """A cell as text: null is empty, bytes are hex."""
    col = F.col(f"`{name}`")
    return F.coalesce(F.lower(F.hex(col)) if isinstance(df.schema[name].dataType, T.BinaryType) else col.cast("string"), F.lit(""))


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """CSV with a header, which is written even if there are no rows."""
    texts = df.select(*[text_of(df, c).alias(c) for c in df.columns])
    texts = texts.coalesce(1) if one_file else texts
    if texts.isEmpty():  # Spark writes no header for an empty result
        head = ",".join('"' + c.replace('"', '""') + '"' if set(c) & set(',"\n') else c for c in df.columns)
        df.sparkSession.createDataFrame([(head,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    else:
        texts.write.mode("overwrite").option("header", True).option("emptyValue", "").option("escape", '"').csv(path)


def json_array(columns: list[str]) -> Column:
    """The values of columns as the text of a JSON array."""
    cells = F.array(*[F.regexp_extract(F.to_json(F.struct(F.col(f"`{c}`").alias("v"))), r'(?s)^\{"v":(.*)\}$', 1) for c in columns])
    return F.concat(F.lit("["), F.array_join(F.transform(cells, lambda x: F.when(x == "", "null").otherwise(x)), ","), F.lit("]"))


def json_rows(df: DataFrame, as_arrays: bool = False) -> DataFrame:
    """One JSON text a row: an object, or with as_arrays its values only."""
    if as_arrays:
        return df.select(json_array(df.columns).alias("value"))
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("value"))


def write_json(df: DataFrame, path: str, as_arrays: bool = False) -> None:
    """Newline-delimited JSON, in as many files as there are partitions."""
    json_rows(df, as_arrays).write.mode("overwrite").text(path)


def json_document(df: DataFrame, as_arrays: bool = False, pretty: bool = False) -> str:
    """The whole result as one JSON array; for results that fit the driver."""
    rows = [json.loads(r.value) for r in json_rows(df, as_arrays).toLocalIterator()]
    return json.dumps(rows, indent=2 if pretty else None, ensure_ascii=False)


def ndjson(df: DataFrame, row_id: str, cells: list[str]) -> DataFrame:
    """The row events of a result as lines, made by the executors: {"row":[id,[cells]]}."""
    return df.select(F.concat(F.lit('{"row":['), F.col(row_id).cast("string"), F.lit(","), json_array(cells), F.lit("]}")).alias("value"))
