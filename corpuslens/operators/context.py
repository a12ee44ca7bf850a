"""Concordances, keyword in context, navigation, citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.schema import SENTENCE

CONTEXT = 300
SIDE = 10
#: Fills short contexts in sort keys: it sorts behind every word.
LAST = "\U0010ffff"


def concordance(hits: DataFrame, texts: DataFrame, size: int = CONTEXT) -> DataFrame:
    """Hits with ``size`` characters of text on either side of their words."""
    first, last = F.col("starts")[0], F.element_at("starts", -1)
    begin = F.greatest(first - size, F.lit(0))
    return hits.join(texts, "doc").withColumn("context", F.substring("text", (begin + 1).cast("int"), (last + size - begin).cast("int"))).drop("text")


def kwic(hits: DataFrame, texts: DataFrame, size: int = 60) -> DataFrame:
    """Hits with the text left of, in and right of them on one line; line ends become blanks."""
    first = F.col("starts")[0]
    last = F.element_at("starts", -1)
    word = F.regexp_extract(F.substring("text", (last + 1).cast("int"), F.lit(200)), r"^[\p{L}\p{M}\p{N}]+", 0)
    end = last + F.length(word)
    line = lambda c: F.regexp_replace(c, r"\s", " ")
    cut = lambda a, n: line(F.substring("text", (a + 1).cast("int"), n.cast("int")))
    begin = F.greatest(first - size, F.lit(0))
    return hits.join(texts, "doc").select(*hits.columns, cut(begin, first - begin).alias("left"), cut(first, end - first).alias("hit"), cut(end, F.lit(size)).alias("right"))


def with_tokens(hits: DataFrame, sentences: DataFrame) -> DataFrame:
    """Hits with their sentence's words (tokens); single words come with them from search.hits_in."""
    return hits.join(sentences.select(*SENTENCE, "tokens"), list(SENTENCE), "left")


def sides(hits: DataFrame, n: int = SIDE) -> DataFrame:
    """Hits (with tokens) with their own words as ``q``, and the n words before (nearest first) and after them, as arrays; words with a digit are passed over.

    Positions count from 1 without gaps, so each side is one slice.
    """
    first, last = F.col("positions")[0], F.element_at("positions", -1)
    begin = F.greatest(first - n, F.lit(1))
    names = lambda c: F.transform(F.filter(c, lambda x: ~x["token"].rlike(r"\d")), lambda x: x["token"])
    own = F.array_join(F.transform("positions", lambda p: F.element_at("tokens", p)["token"]), " ")
    before, after = F.slice("tokens", begin, first - begin), F.slice("tokens", last + 1, F.lit(n))
    return hits.select(*(c for c in hits.columns if c != "tokens"), own.alias("q"), F.reverse(names(before)).alias("left"), names(after).alias("right"))


def padded(c: Column, n: int = SIDE) -> Column:
    """A sort key of exactly n words, so that shorter contexts sort behind."""
    return F.concat(c, F.array_repeat(F.lit(LAST), F.lit(n) - F.size(c)))


def sorted_kwic(hits: DataFrame, by: tuple[str, ...], docs: DataFrame | None = None, limit: int = 100, start: int = 1) -> DataFrame:
    """Hits (with tokens) in the order of up to three keys: left, right, q (the hit's own words), or fields of the hit's document; then of the text."""
    rows = sides(hits)
    fields = [k for k in by if k not in ("left", "right", "q")]
    if fields:
        rows = rows.join(docs.select("doc", *fields), "doc")
    keys = [padded(F.col(k)) if k in ("left", "right") else F.regexp_replace(F.lower(F.trim(F.col(k).cast("string"))), r"\s+", ",").asc_nulls_last() for k in by]
    return rows.orderBy(*keys, "doc", F.col("starts")[0]).limit(start + limit - 1).offset(start - 1)


def citation(parts: list[Column | tuple[Column, dict]], separator: str = ", ") -> Column:
    """The given labels that aren't empty, joined; a label may come with what stands before and after it (prefix, suffix) and a separator of its own."""
    shown, last = [], len(parts) - 1
    for k, part in enumerate(parts):
        label, how = part if isinstance(part, tuple) else (part, {})
        text = F.nullif(F.trim(label.cast("string")), F.lit(""))
        after = how.get("separator", separator) if k < last else ""
        shown.append(F.coalesce(F.concat(F.lit(how.get("prefix", "")), text, F.lit(how.get("suffix", "")), F.lit(after)), F.lit("")))
    joined = F.concat(*shown)
    return F.regexp_replace(joined, r"[\s,;:]+$", "")


#: Divisions that a citation may name behind its work, from the highest.
DIV_LEVELS = ("div1", "div2", "div3")


def resolve_citation(cites: DataFrame, abbreviations: DataFrame, text: str = "cite", divs: DataFrame | None = None) -> DataFrame:
    """Each citation with the work whose abbreviation is its longest beginning: (abbreviation, work, rest).

    A citation's beginnings, of the lengths that abbreviations have, meet those
    by an equi-join and carry their row, so neither side need be small and no
    citations are joined with themselves.  With ``divs`` (work, div1, div2, div3, and n1 to n3,
    their labels), the rest, as ``2.1`` or ``Book 2, 1``, is read as labels of
    divisions, and the deepest one whose labels fit gives div1 to div3.
    """
    n = F.length(text)
    lengths = abbreviations.agg(F.collect_set(F.length("abbreviation")).alias("_n"))  # one row
    starts = F.transform(F.filter("_n", lambda k: k.between(F.least(F.lit(1), n), n)), lambda k: F.substr(F.col(text), F.lit(1), k))
    numbered = cites.select(F.struct(*cites.columns).alias("_row"), text).withColumn("_id", F.monotonically_increasing_id()).crossJoin(F.broadcast(lengths))
    pairs = numbered.select("_id", "_row", F.explode(starts).alias("abbreviation")).join(abbreviations, "abbreviation")
    best = pairs.groupBy("_id").agg(F.max_by(F.struct("_row", "abbreviation", "work"), F.length("abbreviation")).alias("b")).select("b.*")
    out = best.select("_row.*", "abbreviation", "work").withColumn("rest", F.trim(F.substr(F.col(text), F.length("abbreviation") + 1)))
    if divs is None:
        return out
    labels = F.filter(F.split(F.regexp_replace("rest", r"(?i)\b(?:book|chapter|act|scene|canto|part)\b", " "), r"[\s.,;:]+"), lambda x: x != "")
    out = out.withColumn("_id", F.monotonically_increasing_id()).withColumn("_l", labels)
    fits = F.lit(True)
    for k in (1, 2, 3):
        fits = fits & (F.coalesce(F.col(f"n{k}"), F.lit("")).isin("") | (F.get("_l", F.lit(k - 1)) == F.col(f"n{k}")))
    depth = sum((F.coalesce(F.col(f"n{k}"), F.lit("")) != "").cast("int") for k in (1, 2, 3))
    named = out.join(divs, "work").where(fits & (depth > 0)).groupBy("_id").agg(F.max_by(F.struct(*DIV_LEVELS), depth).alias("_d"))
    return out.join(named, "_id", "left").select(*[c for c in out.columns if c[0] != "_"], *(F.col("_d")[k].alias(k) for k in DIV_LEVELS))


def text_of(objects: DataFrame, texts: DataFrame) -> DataFrame:
    """Objects (doc, start, end) with their text; a whole document is refused by callers that page through it."""
    return objects.join(texts, "doc").withColumn("object_text", F.substring("text", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))).drop("text")
