"""Facets, aggregations, time series, bibliographies, landing pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions.stats import per_ten_thousand
from corpuslens.functions.text import fold
from corpuslens.operators.metadata import inherit
from corpuslens.schema import KEYS


def with_metadata(hits: DataFrame, docs: DataFrame, *fields: str) -> DataFrame:
    return hits.join(docs.select("doc", *fields), "doc")


def facet(hits: DataFrame | None, docs: DataFrame, field: str, top: int = 100) -> DataFrame:
    """Hits of each value of a field (null is NULL), with the words there and hits in 10,000 words; the ``top`` most frequent.

    Without hits it is a facet of a bibliography: documents of each value.
    """
    value = F.coalesce(F.col(field).cast("string"), F.lit("NULL"))
    if hits is None:
        return docs.groupBy(value.alias("value")).agg(F.count("*").alias("count")).orderBy(F.col("count").desc(), "value").limit(top)
    # hits are summed by document before the metadata is met
    by_doc = hits.groupBy("doc").agg(F.count("*").alias("n")).join(docs, "doc", "right")
    return _relative(by_doc.groupBy(value.alias("value")).agg(F.sum(F.coalesce("n", F.lit(0))).alias("count"), F.sum("word_count").alias("total_word_count")), top)


def _relative(sums: DataFrame, top: int) -> DataFrame:
    return sums.where(F.col("count") > 0).select("value", "count", "total_word_count", per_ten_thousand(F.col("count"), F.col("total_word_count")).alias("relative")).orderBy(F.col("count").desc(), "value").limit(top)


def facet_of_divisions(hits: DataFrame, words: DataFrame, divs: DataFrame, field: str, top: int = 100) -> DataFrame:
    """Like facet(), by a field of divisions (rows: level, div keys, field): a hit has the value of its deepest division with one, else NULL.

    Hits and words are summed by their lowest division before the fields are met.
    """
    key = [k for k in KEYS["div3"]]
    sums = lambda rows, name: rows.groupBy(*key).agg(F.count("*").alias(name))
    both = sums(words, "w").join(sums(hits, "n"), key, "left")
    named = inherit(both, divs, field)
    value = F.coalesce(F.col(field).cast("string"), F.lit("NULL"))
    return _relative(named.groupBy(value.alias("value")).agg(F.sum(F.coalesce("n", F.lit(0))).alias("count"), F.sum("w").alias("total_word_count")), top)


def breakdown(hits: DataFrame, docs: DataFrame, field: str, inner: str) -> DataFrame:
    """Hits of each value of a field, and of each inner value in it, both by falling count."""
    by_doc = hits.groupBy("doc").agg(F.count("*").alias("n")).join(docs.select("doc", field, inner), "doc")
    pairs = by_doc.groupBy(field, inner).agg(F.sum("n").alias("n"))
    listed = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("k"), F.col(inner).cast("string").alias("v"))))
    text = F.array_join(F.transform(listed, lambda x: F.concat_ws(":", x["v"], (-x["k"]).cast("string"))), ",")
    return pairs.groupBy(field).agg(F.sum("n").alias("n"), text.alias("break_up"))


def breakdown_rows(hits: DataFrame, docs: DataFrame, field: str, inner: str) -> DataFrame:
    """breakdown() with a row for each inner value, as it is exported: (field, n, inner, inner_n)."""
    by_doc = hits.groupBy("doc").agg(F.count("*").alias("n")).join(docs.select("doc", F.col(field).cast("string").alias(field), F.col(inner).cast("string").alias(inner)), "doc")
    pairs = by_doc.groupBy(field, inner).agg(F.sum("n").alias("inner_n"))
    return pairs.join(pairs.groupBy(F.col(field).alias("_f")).agg(F.sum("inner_n").alias("n")), F.col(field).eqNullSafe(F.col("_f"))).select(field, "n", inner, "inner_n")


def runs_of_hits(hits: DataFrame) -> DataFrame:
    """Hits in text order by their runs within one paragraph: (doc, para, first_start, n), one row a run of neighbours."""
    w = Window.partitionBy("doc").orderBy("start")
    at = hits.select("doc", "para", F.col("starts")[0].alias("start"))
    turned = at.withColumn("new", F.coalesce((F.lag("para").over(w) != F.col("para")).cast("int"), F.lit(1)))
    run = turned.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy("doc", "run").agg(F.first("para").alias("para"), F.min("start").alias("first_start"), F.count("*").alias("n")).select("doc", "para", "first_start", "n")


def hitlist_stats(hits: DataFrame, docs: DataFrame, fields: list[str]) -> DataFrame:
    """One row: for each field, the distinct values among the hits' documents, null counting as one."""
    there = docs.join(hits.select("doc").distinct(), "doc", "left_semi")
    return there.agg(F.count("*").alias("docs"), *((F.countDistinct(f) + F.coalesce(F.max(F.col(f).isNull().cast("int")), F.lit(0))).alias(f) for f in fields))


def time_series(hits: DataFrame | None, docs: DataFrame, field: str, start: int, end: int, interval: int = 10) -> DataFrame:
    """Hits (documents without a query) in ranges of an integer field, with the words (documents) there and hits in 10,000.

    Every range has a row.  The last range is clipped at ``end``, and so are
    its totals.
    """
    spark = docs.sparkSession
    slot = F.floor((F.col(field) - start) / interval)
    chosen = docs.where(F.col(field).between(start, end))
    spine = spark.range(0, (end - start) // interval + 1).select((F.lit(start) + F.col("id") * interval).alias("first"), F.least(F.lit(end), F.lit(start) + (F.col("id") + 1) * interval - 1).cast("long").alias("last"), F.col("id").alias("slot"))
    if hits is None:
        sums = chosen.groupBy(slot.alias("slot")).agg(F.count("*").alias("n"), F.count("*").alias("total"))
    else:
        by_doc = hits.groupBy("doc").agg(F.count("*").alias("n")).join(chosen.select("doc", field, "word_count"), "doc", "right")
        sums = by_doc.groupBy(slot.alias("slot")).agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"), F.sum("word_count").alias("total"))
    out = spine.join(sums, "slot", "left")
    n, total = F.coalesce("n", F.lit(0)), F.coalesce("total", F.lit(0))
    return out.select("first", "last", n.alias("n"), total.alias("total"), per_ten_thousand(n, total).alias("relative"))


def results_bibliography(hits: DataFrame) -> DataFrame:
    """Documents with hits: the number of hits and the place of the first."""
    return hits.groupBy("doc").agg(F.count("*").alias("n"), F.min(F.col("starts")[0]).alias("first_start"))


def by_letters(objects: DataFrame, field: str, first: str, last: str) -> DataFrame:
    """Values whose folded initial lies in a range of letters, with their objects."""
    initial = F.upper(F.substring(fold(F.col(field)), 1, 1))
    return objects.where(initial.between(first.upper(), last.upper())).groupBy(F.col(field).alias("value"), initial.alias("letter")).agg(F.count("*").alias("n"))


def by_numbers(objects: DataFrame, field: str, low: int, high: int) -> DataFrame:
    return objects.where(F.col(field).between(low, high))


def cloud_weights(counts: DataFrame, n: str = "n") -> DataFrame:
    """Counts on a linear scale of 0 to 20."""
    bounds = counts.agg(F.min(n).alias("_low"), F.max(n).alias("_high"))
    step = (F.col("_high") - F.col("_low")) / 20
    return counts.crossJoin(F.broadcast(bounds)).withColumn("weight", F.when(step > 0, F.round((F.col(n) - F.col("_low")) / step)).otherwise(F.lit(0.0))).drop("_low", "_high")


def date_bounds(objects: DataFrame, field: str) -> DataFrame:
    number = F.regexp_extract(F.col(field).cast("string"), r"(\d+)", 1).try_cast("int")
    return objects.agg(F.min(number).alias("start_date"), F.max(number).alias("end_date"))


def merged(*parts: DataFrame) -> DataFrame:
    """Sums of counts by label over several results (label, n)."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("label").agg(F.sum("n").alias("n"))


def table_of_contents(heads: DataFrame, doc: str = "doc") -> DataFrame:
    """Divisions (doc, n, depth, head) in order, with the number of the division they lie in, 0 at the top."""
    w = Window.partitionBy(doc).orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    two = F.max(F.when(F.col("depth") == 2, F.col("n"))).over(w)
    one = F.max(F.when(F.col("depth") == 1, F.col("n"))).over(w)
    parent = F.when(F.col("depth") == 1, 0).when(F.col("depth") == 2, F.coalesce(one, F.lit(0))).otherwise(F.when(F.coalesce(two, F.lit(0)) > F.coalesce(one, F.lit(0)), two).otherwise(F.coalesce(one, F.lit(0))))
    return heads.select(doc, "n", "depth", "head", parent.alias("parent"))


def shown_contents(heads: DataFrame, doc: str = "doc") -> DataFrame:
    """table_of_contents() without empty headings and notes; a division without a heading of its own is shown by its type, its label, or its level and number."""
    label = F.coalesce(*(F.nullif(F.trim(F.col(c)), F.lit("")) for c in ("head", "type", "label") if c in heads.columns), F.concat(F.lit("div"), F.col("depth"), F.lit(" "), F.col("n")))
    kept = heads.where(~F.lower(F.coalesce(F.col("type"), F.lit(""))).isin("notes", "note")) if "type" in heads.columns else heads
    return table_of_contents(kept.withColumn("head", F.nullif(label, F.lit("[NA]"))).where("head IS NOT NULL"), doc)
