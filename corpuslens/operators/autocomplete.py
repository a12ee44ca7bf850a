"""Completion of terms and metadata values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.functions.text import fold, folded
from corpuslens.plans.predicates import matches
from corpuslens.plans.syntax import METACHARACTERS, parse_query


def terms(lexicon: DataFrame, text: str, limit: int = 100) -> DataFrame:
    """Rows (completion, freq): forms that the last token of a query begins, most frequent first."""
    tokens = parse_query(text)
    if not tokens:
        return lexicon.where(F.lit(False)).select(F.col("token").alias("completion"), "freq")
    last = folded(tokens[-1][1].strip('"'))
    test = matches(F.col("norm"), last) if METACHARACTERS.search(last) else F.col("norm").startswith(last)
    return lexicon.where(test).groupBy("token").agg(F.sum("freq").alias("freq")).select(F.col("token").alias("completion"), "freq").orderBy(F.col("freq").desc(), "completion").limit(limit)


def metadata(index: DataFrame, field: str, text: str, limit: int = 100) -> DataFrame:
    """Distinct values of a field with a word that the text begins; values with the very word come first."""
    want = folded(text)
    found = index.where((F.col("field") == field) & F.col("word").startswith(want)).groupBy("value").agg(F.max((F.col("word") == want).cast("int")).alias("exact"))
    return found.orderBy(F.col("exact").desc(), "value").limit(limit)


def keys(words: DataFrame, text: str, limit: int = 100) -> DataFrame:
    """Rows (completion, freq): word:attribute:value and lemma:form[:attribute:value] keys that the last token of a query begins, most frequent first; of words, or of their counts (freq)."""
    tokens = parse_query(text)
    n = F.sum("freq") if "freq" in words.columns else F.count("*")
    if not tokens or tokens[-1][0] not in ("LEMMA", "LEMMA_ATTR", "ATTR"):
        return words.where(F.lit(False)).select(F.col("token").alias("completion"), F.lit(0).cast("bigint").alias("freq"))
    kind, want = tokens[-1]
    form = F.concat(F.lit("lemma:"), "lemma") if kind in ("LEMMA", "LEMMA_ATTR") else F.col("token")
    pairs = F.transform(F.map_entries("attrs"), lambda e: F.concat_ws(":", form, e["key"], e["value"])) if "attrs" in words.columns else F.array().cast("array<string>")
    every = words.select(*(["freq"] if "freq" in words.columns else []), F.explode(F.concat(F.array(form), pairs) if kind == "LEMMA" else pairs).alias("completion"))
    return every.where(matches(F.col("completion"), want) if METACHARACTERS.search(want) else F.col("completion").startswith(want)).groupBy("completion").agg(n.alias("freq")).orderBy(F.col("freq").desc(), "completion").limit(limit)


def highlighted(values: DataFrame, text: str, column: str = "value") -> DataFrame:
    """Values with ``shown``: the first place that the text, folded, has in them, marked as the web form does."""
    want = folded(text)
    at = F.instr(fold(F.col(column)), want)  # folding keeps every sign's place
    part = F.substr(F.col(column), at, F.lit(len(want)))
    shown = F.concat(F.substr(F.col(column), F.lit(1), at - 1), F.lit('<span class="highlight">'), part, F.lit("</span>"), F.substr(F.col(column), at + len(want)))
    return values.withColumn("shown", F.when(at > 0, shown).otherwise(F.col(column)))
