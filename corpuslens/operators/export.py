"""Writers for results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from corpuslens.functions.text import strip_tags


def flat(df: DataFrame, strip: bool = False) -> DataFrame:
    """Nested columns as JSON text, so that any result fits CSV; ``strip`` removes tags from texts."""
    columns = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        nested = isinstance(f.dataType, (ArrayType, MapType, StructType))
        columns.append((F.to_json(c) if nested else strip_tags(c) if strip and f.dataType.simpleString() == "string" else c).alias(f.name))
    return df.select(*columns)


def write(df: DataFrame, path: str, kind: str = "parquet", strip: bool = False) -> None:
    """A result as parquet, csv (with a header) or json lines."""
    if kind == "csv":
        flat(df, strip).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    elif kind in ("json", "parquet", "orc"):
        getattr(df.write.mode("overwrite"), kind)(path)
    else:
        raise ValueError(f"unknown format: {kind}")


def metadata_export(objects: DataFrame, docs: DataFrame, filename: str = "filename") -> DataFrame:
    """Objects of a level as JSON records with their document's file name."""
    rows = objects.join(docs.select("doc", filename), "doc") if filename not in objects.columns else objects
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("record"))
