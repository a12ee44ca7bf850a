"""Object queries and the filters they put on hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions.text import sort_form
from corpuslens.plans.predicates import metadata_predicate
from corpuslens.schema import KEYS, known_columns


def select_objects(objects: DataFrame, query: dict[str, str], kinds: dict[str, str] | None = None) -> DataFrame:
    """Objects that every field's query fits."""
    known_columns(list(query), objects.columns)
    for field, q in query.items():
        objects = objects.where(metadata_predicate(field, q, (kinds or {}).get(field, "text")))
    return objects


def chained(levels: list[DataFrame]) -> DataFrame:
    """Objects of the last level that lie in selected objects of each level before it."""
    out = levels[0]
    for inner in levels[1:]:
        key = [k for k in KEYS["word"] if k in out.columns and k in inner.columns]
        out = inner.join(out.select(*key), key, "left_semi")
    return out


def ordered(objects: DataFrame, fields: list[str], tie: list[str]) -> list[Column]:
    return [*(sort_form(F.col(f).cast("string")) for f in known_columns(fields, objects.columns)), *(F.col(t) for t in tie)]


def page(objects: DataFrame, order: list[Column], start: int, end: int) -> DataFrame:
    """Rows start to end, from 1, of an order: a top-k sort, then an offset."""
    return objects.orderBy(*order).limit(end).offset(start - 1)


def bounds(start: int, end: int, per_page: int, total: int) -> tuple[int, int]:
    """A page's first and last row of ``total``."""
    start = max(1, start)
    end = end or start + per_page - 1
    return min(start, total) if total else 0, min(end, total)


def inherit(rows: DataFrame, divs: DataFrame, field: str) -> DataFrame:
    """The field of a row's deepest division that has one: div3, else div2, else div1."""
    out = rows
    for level in ("div1", "div2", "div3"):
        key = list(KEYS[level])
        side = divs.where(F.col("level") == level).select(*key, F.nullif(F.col(field), F.lit("")).alias(f"_{level}"))
        out = out.join(side, key, "left")
    return out.withColumn(field, F.coalesce("_div3", "_div2", "_div1")).drop("_div1", "_div2", "_div3")


def neighbours(objects: DataFrame, order: list[str], within: list[str], name: str) -> DataFrame:
    """The objects with the ``name`` of the one before and after, empty at either end."""
    w = Window.partitionBy(*within).orderBy(*order)
    value = F.col(name).cast("string")
    return objects.select("*", F.coalesce(F.lag(value).over(w), F.lit("")).alias("prev"), F.coalesce(F.lead(value).over(w), F.lit("")).alias("next"))


def word_counts(objects: DataFrame, field: str) -> DataFrame:
    """Words of the objects of each value of a field."""
    return objects.groupBy(field).agg(F.sum("word_count").alias("words"))


def frequencies(objects: DataFrame, fields: list[str]) -> DataFrame:
    """Rows (field, value, n) of all values but null, in one aggregation."""
    values = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in known_columns(fields, objects.columns))))
    return objects.select(values.alias("x")).select("x.*").where("value IS NOT NULL").groupBy("field", "value").agg(F.count("*").alias("n"))


def as_of(points: DataFrame, marks: DataFrame, key: str, point: str, mark: str, value: str) -> DataFrame:
    """Each point with the value of the last mark at or before it, in one sorted pass over both (no join of the pairs)."""
    both = points.select("*", F.lit(1).alias("_kind"), F.col(point).alias("_at"), F.lit(None).alias("_value")).unionByName(
        marks.select(key, F.lit(0).alias("_kind"), F.col(mark).alias("_at"), F.col(value).alias("_value")), allowMissingColumns=True
    )
    w = Window.partitionBy(key).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("_value", ignorenulls=True).over(w)).where("_kind = 1").drop("_kind", "_at", "_value")


def containing(points: DataFrame, ranges: DataFrame, key: str, point: str) -> DataFrame:
    """Points with the ranges (key, n, start_byte, end_byte) around them: start < point < end, joined by key."""
    return points.join(ranges, (points[key] == ranges[key]) & (F.col("start_byte") < F.col(point)) & (F.col("end_byte") > F.col(point))).drop(ranges[key])
