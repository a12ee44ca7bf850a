"""Plain-text segmentation in SQL expressions: lines, pieces, sentences, word positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions.text import PIECE, fold, indexed_form
from corpuslens.sources import segments

LONGEST_WORD = 200  # bytes


def paragraphs(texts: DataFrame, doc: str, text: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (doc, para, line_start, line): the lines with a letter, numbered from 1; line_start counts characters from 0."""
    lines = F.split(F.col(text), "\n")
    starts = F.aggregate(
        lines, F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("out")),
        lambda acc, x: F.struct((acc["at"] + F.length(x) + 1).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")), lambda acc: acc["out"],
    )
    both = F.filter(F.arrays_zip(lines.alias("line"), starts.alias("line_start")), lambda x: x["line"].rlike(r"\p{L}"))
    rows = texts.select(F.col(doc).alias("doc"), *keep, F.posexplode(both).alias("n", "x"))
    return rows.select("doc", *keep, (F.col("n") + 1).alias("para"), F.col("x.line_start").alias("line_start"), F.col("x.line").alias("line"))


def pieces(lines: DataFrame, breakers: tuple[str, ...] = ()) -> DataFrame:
    """Rows (doc, para, n, piece, start, is_word, sent): every word and separator with its sentence, both from 1.

    A separator with ``!`` or ``?`` ends a sentence; one with a full stop does
    unless the word before it has fewer than three signs and a digit or capital
    (in lower case: a digit), or a piece in lower case or of digits follows.
    """
    line = Window.partitionBy("doc", "para").orderBy("n")
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    cut = lines.select("doc", "para", "line_start", F.posexplode(F.regexp_extract_all("line", F.lit(PIECE), F.lit(0))).alias("n", "piece"))
    piece, has_letter = F.col("piece"), F.col("piece").rlike(r"\p{L}")
    seen = cut.select(
        "doc", "para", "n", "piece", (F.col("line_start") + F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0))).alias("start"), has_letter.alias("has_letter"),
        F.lead("piece").over(line).alias("next"), F.last(F.when(has_letter, F.lower(piece)), ignorenulls=True).over(before).alias("last"),
    )
    following: Column = F.col("next")
    runs_on = F.coalesce((following == F.lower(following)) & following.rlike(r"\p{L}") | following.rlike(r"^\p{N}+$"), F.lit(False))
    short = F.coalesce((F.length("last") < 3) & F.col("last").rlike("[A-Z0-9]"), F.col("last").isNull() & F.lit(False))
    ends = ~F.col("has_letter") & (piece.rlike("[!?]") | piece.contains(".") & ~runs_on & ~short | piece.isin(*breakers))
    counted = seen.withColumn("ends", ends.cast("int"))
    return counted.select("doc", "para", "n", "piece", "start", F.col("has_letter").alias("is_word"), (F.coalesce(F.sum("ends").over(before), F.lit(0)) + 1).cast("int").alias("sent"))


def sentences(texts: DataFrame, doc: str = "doc_id", text: str = "text", breakers: tuple[str, ...] = (), whitelist: DataFrame | None = None) -> DataFrame:
    """Rows (keys, tokens) of plain texts, one a sentence; tokens: (pos, start, token, norm), positions from 1.

    Pieces without a letter take no position, nor do words over 200 bytes or
    outside a given ``whitelist`` (rows (token)).  A narrow map; with a
    whitelist, one shuffle by paragraph.
    """
    if whitelist is None:
        return segments.sentences(texts, doc, text, breakers, LONGEST_WORD)
    found = pieces(paragraphs(texts, doc, text), breakers).where("is_word").where(F.octet_length("piece") <= LONGEST_WORD)
    found = found.select("doc", "para", "n", "sent", F.col("start").cast("bigint").alias("start"), indexed_form(F.col("piece")).alias("token")).where("token <> ''")
    found = found.join(whitelist, "token", "left_semi")
    listed = found.groupBy("doc", "para", "sent").agg(F.array_sort(F.collect_list(F.struct("n", "start", "token", fold(F.col("token")).alias("norm")))).alias("_l"))
    tokens = F.transform("_l", lambda x, i: F.struct((i + 1).cast("int").alias("pos"), x["start"].alias("start"), x["token"].alias("token"), x["norm"].alias("norm")))
    one = F.lit(1)
    return listed.select("doc", one.alias("div1"), one.alias("div2"), one.alias("div3"), "para", "sent", tokens.alias("tokens"))


def frequencies(texts: DataFrame, doc: str = "doc_id", text: str = "text", breakers: tuple[str, ...] = ()) -> DataFrame:
    """Rows (doc, token, n): how often words() has a word in each document.

    A narrow map, as a document is one text; a job over the ids looks whether
    one comes again, and only then the counts are summed by document.
    """
    rows = segments.frequencies(texts, doc, text, breakers, LONGEST_WORD)
    if texts.groupBy(doc).count().where("count > 1").isEmpty():
        return rows
    return rows.groupBy("doc", "token").agg(F.sum("n").alias("n"))


def words(texts: DataFrame, doc: str = "doc_id", text: str = "text", breakers: tuple[str, ...] = (), whitelist: DataFrame | None = None) -> DataFrame:
    """The words table of plain texts: sentences(), a row for each word."""
    if whitelist is None:
        return segments.words(texts, doc, text, breakers, LONGEST_WORD)
    rows = sentences(texts, doc, text, breakers, whitelist)
    return rows.select(*(c for c in rows.columns if c != "tokens"), F.explode("tokens").alias("_t")).select(*(c for c in rows.columns if c != "tokens"), "_t.*")


def punctuation(texts: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc, para, sent, start, sign): every sign of the separators but blanks."""
    rows = pieces(paragraphs(texts, doc, text)).where(~F.col("is_word"))
    signs = rows.select("doc", "para", "sent", F.col("start").alias("at"), F.posexplode(F.split("piece", "")).alias("k", "sign"))
    return signs.where(~F.col("sign").rlike(r"^[\s\p{C}\p{N}]*$")).select("doc", "para", "sent", (F.col("at") + F.col("k")).alias("start"), "sign")
