"""Lookups of objects and orders of hits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.functions.text import sort_form
from corpuslens.schema import known_columns


def by_ids(objects: DataFrame, ids: list[tuple[int, ...]], key: tuple[str, ...]) -> DataFrame:
    """Objects with one of the given keys; a shorter key stands for all objects below it."""
    test = F.lit(False)
    for one in ids:
        match = F.lit(True)
        for k, v in zip(key, one):
            match = match & (F.col(k) == v)
        test = test | match
    return objects.where(test)


def sort_hits(hits: DataFrame, objects: DataFrame, fields: list[str], key: tuple[str, ...] = ("doc",), limit: int | None = None) -> DataFrame:
    """Hits in the order of their object's folded fields, missing last, then of the text."""
    known_columns(fields, objects.columns)
    named = hits.join(objects.select(*key, *fields), list(key), "left")
    out = named.orderBy(*(sort_form(F.col(f).cast("string")) for f in fields), "doc", F.col("starts")[0])
    return out.limit(limit) if limit else out


def first_page(points: DataFrame, pages: DataFrame, key: str = "doc", start: str = "start") -> DataFrame:
    """For each point the first page (key, n, end_byte) of its document that ends at or behind it."""
    both = points.select("*", F.lit(0).alias("_kind"), F.col(start).alias("_at"), F.lit(None).alias("page")).unionByName(pages.select(key, F.lit(1).alias("_kind"), F.col("end_byte").alias("_at"), F.col("n").alias("page")), allowMissingColumns=True)
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy("_at", "_kind").rowsBetween(0, Window.unboundedFollowing)
    return both.withColumn("page", F.first("page", ignorenulls=True).over(w)).where("_kind = 0").drop("_kind", "_at")


def page_images(pages: DataFrame) -> DataFrame:
    """One row for each image of a page with attrs: facs, else id, split at blanks."""
    name = F.coalesce(F.nullif(F.col("attrs")["facs"], F.lit("")), F.nullif(F.col("attrs")["id"], F.lit("")))
    return pages.select("doc", "page", F.explode(F.split(name, " ")).alias("image")).where("image <> ''")


def first_and_last(rows: DataFrame, value: str, order: str, by: str = "doc") -> DataFrame:
    """The first and last value of each document."""
    return rows.groupBy(by).agg(F.min_by(value, order).alias("first"), F.max_by(value, order).alias("last"), F.count("*").alias("n"))
