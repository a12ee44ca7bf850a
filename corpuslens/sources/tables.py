"""Bibliographies, headers, lemma files, corpus order."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslens.functions.text import MISSING, first_integer, fold, natural_sort_form

# Where TEI headers keep their fields; the first that isn't empty counts.
TEI_HEADER = {
    "author": ("//sourceDesc//author", "//titleStmt/author", "//author"),
    "title": ("//sourceDesc//title", "//titleStmt/title", "//title"),
    "author_dates": ("//sourceDesc//author/date", "//titleStmt/author/date"),
    "publisher": ("//sourceDesc//imprint/publisher", "//sourceDesc//publisher", "//publicationStmt/publisher"),
    "pub_place": ("//sourceDesc//imprint/pubPlace", "//sourceDesc//pubPlace"),
    "pub_date": ("//sourceDesc//imprint/date", "//sourceDesc//date", "//publicationStmt/date"),
    "create_date": ("//profileDesc/creation/date", "//creation/date", "//fileDesc//imprint/date"),
    "extent": ("//sourceDesc//extent",),
    "editor": ("//sourceDesc//editor",),
    "identifiers": ("//publicationStmt/idno",),
    "text_genre": ("//profileDesc/textClass/keywords[@scheme='genre']/term", "//SourceDesc/genre"),
    "keywords": ("//profileDesc/textClass/keywords/list/item", "//profileDesc/textClass/keywords/term"),
    "language": ("//profileDesc/language/language", "//langUsage/language"),
    "notes": ("//fileDesc/notesStmt/note",),
    "collection": ("//seriesStmt/title",),
    "period": ("//profileDesc/creation/period",),
}
HEADER = r"(?is)(<teiheader\b.*?</teiheader\s*>)"
DATE_FIELDS = ("date", "create_date", "pub_date", "period")


def bibliography(spark: SparkSession, path: str) -> DataFrame:
    """A CSV or, by its name, TSV file with a column filename; year as an integer, 0 where it is none."""
    rows = spark.read.csv(path, header=True, sep="\t" if path.endswith((".tsv", ".tab")) else ",", escape='"')
    if "filename" not in rows.columns:
        raise ValueError("a bibliography needs a column filename")
    if "year" not in rows.columns:
        return rows
    # the latest first, as the load order is without one of its own
    return rows.withColumn("year", F.coalesce(F.col("year").try_cast("int"), F.lit(0))).orderBy(F.col("year").desc(), "filename")


def header_fields(column: str, fields: dict[str, tuple[str, ...]] = TEI_HEADER) -> list[Column]:
    """tei_header() of whole texts: their header, if it is well-formed; texts without one have nulls."""
    return tei_header(column, fields, F.regexp_extract(F.col(column), HEADER, 1))


def _at_path(text: Column, path: str) -> Column:
    """The text at a path; a header that lacks one of the path's elements isn't parsed for it."""
    there = F.lit(True)
    for element in re.findall(r"/([A-Za-z]+)", path):
        there = there & text.contains(f"<{element}")
    return F.when(there, F.xpath_string(text, F.lit(path)))


def tei_header(column: str, fields: dict[str, tuple[str, ...]] = TEI_HEADER, header: Column | None = None) -> list[Column]:
    """Fields of the well-formed header in a column, or in ``header``; dates must contain a digit."""
    text = F.col(column) if header is None else F.nullif(header, F.lit(""))
    out = []
    for name, paths in fields.items():
        values = [F.nullif(F.trim(_at_path(text, p)), F.lit("")) for p in paths]
        if name in DATE_FIELDS:
            values = [F.when(v.rlike(r"\d"), v) for v in values]
        out.append(F.coalesce(*values).alias(name))
    return out


def dublin_core(html: Column) -> Column:
    """A map of Dublin Core names (lower case) to contents, from meta elements or, where those have none, from dc: elements; of a name's contents the first counts."""
    tags = F.regexp_extract_all(html, F.lit(r"(?i)<meta\s[^>]*name=[\"']DC[.][^>]*>"), F.lit(0))
    plain = F.regexp_extract_all(html, F.lit(r"(?is)<dc:[\w.]+[^>]*>[^<]*</dc:"), F.lit(0))
    of_meta = lambda t: F.struct(F.lower(F.regexp_extract(t, r"(?i)name=[\"']DC[.]([^\"']+)", 1)).alias("k"), F.regexp_extract(t, r"(?i)content=[\"']([^\"']*)", 1).alias("v"))
    of_element = lambda t: F.struct(F.lower(F.regexp_extract(t, r"(?i)^<dc:([\w.]+)", 1)).alias("k"), F.trim(F.regexp_extract(t, r"(?s)>([^<]*)</", 1)).alias("v"))
    found = F.concat(F.transform(tags, of_meta), F.transform(plain, of_element))
    names = F.array_distinct(F.transform(found, lambda e: e["k"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.filter(found, lambda e: e["k"] == n)[0]["v"]))


def derived_year(docs: DataFrame) -> Column:
    """create_date's year, else the least among the date fields that are there."""
    years = {f: first_integer(F.col(f).cast("string")) for f in DATE_FIELDS if f in docs.columns}
    least = F.array_min(F.array(*years.values()))
    return F.coalesce(years["create_date"], least) if "create_date" in years else least


def corpus_order(docs: DataFrame, fields: list[str]) -> DataFrame:
    """Documents numbered from 1 in the natural order of fields; missing values come last."""
    keys = [natural_sort_form(fold(F.coalesce(F.col(f).cast("string"), F.lit(MISSING)))) for f in fields]
    parts = docs.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id())
    local = parts.withColumn("_k", F.row_number().over(Window.partitionBy("_part").orderBy(*keys)))
    before = local.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row a partition
    return local.join(F.broadcast(before), "_part").withColumn("doc", F.col("_k") + F.col("_before")).drop("_part", "_k", "_n", "_before")


def lemma_file(spark: SparkSession, path: str) -> DataFrame:
    """Rows (word, lemma) of a tab-separated file."""
    return spark.read.schema("word string, lemma string").csv(path, sep="\t")
