"""Export one result: CSV, or data with a methodology beside it."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from capfolio.sinks.snapshot import new_snapshot_id

_NESTED = (T.ArrayType, T.StructType, T.MapType)


def flat_text(frame: DataFrame) -> DataFrame:
    """Arrays, structs and maps as JSON text; other columns as they are."""
    nested = [f.name for f in frame.schema.fields if isinstance(f.dataType, _NESTED)]
    return frame.withColumns({c: F.to_json(c) for c in nested}) if nested else frame


def export_csv(frame: DataFrame, folder: str) -> str:
    """Write to a folder of its own, so an earlier export is never replaced."""
    path = f"{folder.rstrip('/')}/export_{new_snapshot_id()}"
    flat_text(frame).write.option("header", True).option("escape", '"').csv(path)
    return path


def export_with_methodology(frame: DataFrame, folder: str, methodology: dict) -> str:
    """Data as Parquet plus the key/value notes that say how it was made."""
    path = f"{folder.rstrip('/')}/export_{new_snapshot_id()}"
    frame.write.parquet(f"{path}/data")
    notes = pa.table(
        {"key": [str(k) for k in methodology], "value": [str(v) for v in methodology.values()]}
    )
    spark = frame.sparkSession
    spark.createDataFrame(notes).coalesce(1).write.option("header", True).csv(f"{path}/methodology")
    return path
