"""Collocations and what is computed from their counts."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions.stats import log_odds_z
from corpuslens.operators.load import lemmatised
from corpuslens.operators.search import inside, postings, search
from corpuslens.plans.predicates import word_group
from corpuslens.plans.syntax import Group, group_terms, parse_query, split_phrases
from corpuslens.schema import SENTENCE
from corpuslens.store import kept


def around(hits: DataFrame, words: DataFrame, distance: int | None = None, attribute: tuple[str, str] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each hit and each other word of its sentence, within ``distance`` of it if given.

    Hits are of single words; ``keep`` carries columns of the hits along.
    """
    left = hits.select(*SENTENCE, F.col("positions")[0].alias("at"), *keep)
    gap = F.abs(F.col("pos") - F.col("at"))
    near = gap.between(1, distance) if distance else gap > 0
    right = words.where(F.col("attrs")[attribute[0]] == attribute[1]) if attribute else words
    named = F.concat_ws(":", F.lower("token"), F.lit(attribute[0]), F.lit(attribute[1])) if attribute else F.col("token")
    extra = ("lemma",) if "lemma" in words.columns else ()
    return left.join(right.select(*SENTENCE, "pos", named.alias("token"), "norm", *extra), list(SENTENCE)).where(near)


def single_group(query: str) -> Group:
    """The one group of a query of single words."""
    groups = split_phrases(group_terms(parse_query(query)))
    if len(groups) != 1:
        raise ValueError("collocates are of single words")
    return groups[0]


def near(sentences: DataFrame, query: str, distance: int | None = None, within: DataFrame | None = None, keep: tuple[str, ...] = (), by: str = "token", attribute: tuple[str, str] | None = None) -> DataFrame:
    """Rows (*keep, token, norm, m): the words (``by``: their lemmas) around a single word's hits, with how many hits each stands by.

    A narrow scan of the sentence layout.  Without a ``distance`` each word of
    a sentence counts once, weighed by the hits beside itself, so the work is
    linear in a sentence's length; with one, only the words that near are
    looked at.  ``within`` restricts to objects; ``keep``: columns of the
    sentences (doc, or what was joined to them).  With an ``attribute`` (name,
    value) only words that have it are given, named word:name:value.
    """
    held = (F.col(f"_t.{by}").alias("token"), "_t.norm", *(["_t.attrs"] if attribute else []))
    given = partial(with_attribute, attribute=attribute) if attribute else lambda rows: rows
    group = single_group(query)
    is_hit = lambda x: word_group(group, False, x.getField)
    rows = (inside(sentences, within) if within is not None else sentences).where(F.exists("tokens", is_hit))
    if distance is None:
        counted_once = rows.select(*keep, F.size(F.filter("tokens", is_hit)).alias("_h"), "tokens")  # before the words go apart
        words = counted_once.select(*keep, "_h", F.explode("tokens").alias("_t"))
        out = words.select(*keep, *held, (F.col("_h") - F.when(is_hit(F.col("_t")), 1).otherwise(0)).alias("m"))
        return given(out.where("m > 0"))
    at = F.filter(F.transform("tokens", lambda x: F.when(is_hit(x), x["pos"])), lambda p: p.isNotNull())
    hits = rows.select(*keep, "tokens", F.explode(at).alias("_p"))
    first = F.greatest(F.col("_p") - distance, F.lit(1))
    words = F.filter(F.slice("tokens", first, F.col("_p") + distance + 1 - first), lambda x: x["pos"] != F.col("_p"))
    return given(hits.select(*keep, F.explode(words).alias("_t")).select(*keep, *held, F.lit(1).alias("m")))


def with_attribute(rows: DataFrame, attribute: tuple[str, str]) -> DataFrame:
    """Rows of near() with attrs: those that have the attribute, the words named word:name:value."""
    name, value = attribute
    return rows.where(F.col("attrs")[name] == value).withColumn("token", F.concat_ws(":", F.lower("token"), F.lit(name), F.lit(value))).drop("attrs")


def filter_list(words: DataFrame, choice: str = "frequency", n: int = 100, stopwords: DataFrame | None = None, by: str = "token") -> DataFrame:
    """Rows (token): the n most frequent words (``by``: their lemmas), or a list of stopwords (rows of one column, a word and whatever follows it)."""
    if choice == "stopwords":
        if stopwords is None:
            raise ValueError("stopwords list not found")
        first = F.regexp_extract(F.col(stopwords.columns[0]), r"^\s*(\S+)", 1)
        return stopwords.select(first.alias("token")).where("token <> ''").distinct()
    return frequent(words.select(F.col(by).alias("token")), n)


def with_property(rows: DataFrame, name: str, value: str) -> DataFrame:
    """Rows of words with an attribute's value, or a lemma."""
    return rows.where(F.col("lemma") == value) if name == "lemma" else rows.where(F.col("attrs")[name] == value)


def counted(rows: DataFrame, by: tuple[str, ...] = (), without: DataFrame | None = None, own: tuple[str, ...] = ()) -> DataFrame:
    """Rows (*by, token, n) of near(), less a filter list (rows (token)) and the query's own forms."""
    if own:
        rows = rows.where(~F.col("norm").isin(*own))
    counts = rows.groupBy(*by, "token").agg(F.sum("m").alias("n"))
    return counts.join(without, "token", "left_anti") if without is not None else counts  # the list meets counts, not occurrences


def near_by_group(sentences: DataFrame, docs: DataFrame, query: str, field: str, distance: int | None = None, own: tuple[str, ...] = ()) -> DataFrame:
    """Rows (grp, token, n) of the collocates of each value of a document field; null is the empty value.

    Words are summed by document first, so the metadata meets sums.
    """
    by_doc = counted(near(sentences, query, distance, keep=("doc",)), ("doc",), own=own)
    return by_doc.join(docs.select("doc", F.coalesce(F.col(field).cast("string"), F.lit("")).alias("grp")), "doc").groupBy("grp", "token").agg(F.sum("n").alias("n"))


def frequent(words: DataFrame, n: int = 100) -> DataFrame:
    """The n most frequent words; ties by the word."""
    return most(words.groupBy("token").agg(F.count("*").alias("n")), n)


def most(counts: DataFrame, n: int) -> DataFrame:
    """Rows (token): the n largest of counts (token, n); ties by the word."""
    return counts.orderBy(F.col("n").desc(), "token").limit(n).select("token")


def by_lemma(counts: DataFrame, lemmas: DataFrame) -> DataFrame:
    """Counts (token, n) of words summed by their lemmas, rows (word, lemma); those meet counts, not occurrences."""
    return lemmatised(counts, lemmas).groupBy(F.col("lemma").alias("token")).agg(F.sum("n").alias("n"))


def collocates(hits: DataFrame, words: DataFrame, distance: int | None = None, without: DataFrame | None = None, own: tuple[str, ...] = (), by: str = "token") -> DataFrame:
    """Rows (token, n): how often words occur around the hits, less a filter list (rows (token)) and the query's own forms."""
    near = around(hits, words, distance)
    if own:
        near = near.where(~F.col("norm").isin(*own))
    counts = near.groupBy(F.col(by).alias("token")).agg(F.count("*").alias("n"))
    # the filter meets counts, not occurrences
    return counts.join(without, "token", "left_anti") if without is not None else counts


def by_group(hits: DataFrame, words: DataFrame, docs: DataFrame, field: str, distance: int | None = None, own: tuple[str, ...] = ()) -> DataFrame:
    """Rows (grp, token, n) of the collocates of each value of a document field; null is the empty value."""
    named = hits.join(docs.select("doc", F.coalesce(F.col(field).cast("string"), F.lit("")).alias("grp")), "doc")
    near = around(named, words, distance, keep=("grp",))
    if own:
        near = near.where(~F.col("norm").isin(*own))
    return near.groupBy("grp", "token").agg(F.count("*").alias("n"))


def compared(a: DataFrame, b: DataFrame, whole: bool = False) -> DataFrame:
    """Rows (token, z): over-use in a against b, two tables (token, n); with ``whole``, b holds a, which is taken off."""
    none = F.lit(0).cast("bigint")
    both = a.select("token", F.col("n").alias("a"), none.alias("b")).unionByName(b.select("token", none.alias("a"), F.col("n").alias("b")))
    return _scored(both.groupBy("token").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), whole)


def _scored(both: DataFrame, whole: bool) -> DataFrame:
    if whole:
        both = both.withColumn("b", F.greatest(F.col("b") - F.col("a"), F.lit(0)))
    both = kept(both, "both")
    totals = both.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    scored = both.where("a + b > 0").crossJoin(F.broadcast(totals))  # one row of totals
    return scored.select("token", log_odds_z(F.col("a"), F.col("b"), F.col("na"), F.col("nb")).alias("z"))


def compared_within(near_rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rows (token, z): over-use around the hits of chosen documents (rows (doc)) against the others'; one pass over near() with ``doc``."""
    by_doc = near_rows.groupBy("doc", "token").agg(F.sum("m").alias("n")).join(chosen.select("doc", F.lit(True).alias("_in")), "doc", "left")
    return _scored(by_doc.groupBy("token").agg(F.sum(F.when(F.col("_in"), F.col("n")).otherwise(0)).alias("a"), F.sum("n").alias("b")), True)


def both_ends(z: DataFrame, n: int = 100) -> DataFrame:
    """Rows (side, token, z): the n most over-used and the n most under-used words, the latter with their size."""
    top = z.where("z > 0").orderBy(F.col("z").desc(), "token").limit(n).select(F.lit("top").alias("side"), "token", "z")
    low = z.where("z <= 0").orderBy("z", "token").limit(n).select(F.lit("bottom").alias("side"), "token", F.abs("z").alias("z"))
    return top.unionByName(low)


def excess_over_typical(counts: DataFrame) -> DataFrame:
    """Rows (grp, token, x), stored: each group's excess of a word over the typical group, where there is one.

    x is max(0, ln(1 + n) - ln(1 + median)), the median being over all groups,
    those without the word included as 0: in ascending order the zeros come
    first, so the middle ranks follow from the number of groups with the word.
    """
    counts = kept(counts, "counts")
    groups = counts.select("grp").distinct().agg(F.count("*").alias("g"))
    w = Window.partitionBy("token").orderBy("n")
    ranked = counts.withColumn("k", F.row_number().over(w)).withColumn("df", F.count("*").over(Window.partitionBy("token"))).crossJoin(F.broadcast(groups))
    place = F.col("k") + F.col("g") - F.col("df")
    low, high = F.floor((F.col("g") + 1) / 2), F.floor(F.col("g") / 2) + 1
    middle = ranked.groupBy("token").agg(((F.coalesce(F.max(F.when(place == low, F.col("n"))), F.lit(0)) + F.coalesce(F.max(F.when(place == high, F.col("n"))), F.lit(0))) / 2).alias("median"))
    excess = counts.join(middle, "token").select("grp", "token", F.greatest(F.lit(0.0), F.log1p("n") - F.log1p("median")).alias("x")).where("x > 0")
    return kept(excess, "excess")


def similar_groups(counts: DataFrame, reference: str, top: int = 50, most: float = 0.99, words: int | None = None) -> DataFrame:
    """Rows (grp, similarity[, words]): cosine of each group's excess over the typical group with the reference's.

    ``words`` adds that many shared collocates, those whose smaller excess of
    the two is the largest.
    """
    excess = excess_over_typical(counts)
    ref = excess.where(F.col("grp") == reference).select("token", F.col("x").alias("y"))
    norm = ref.agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("ny"))
    both = excess.join(ref, "token", "left")
    parts = both.groupBy("grp").agg(F.sum(F.col("x") * F.coalesce("y", F.lit(0.0))).alias("dot"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("nx"))
    out = parts.crossJoin(F.broadcast(norm)).where(F.col("grp") != reference).select("grp", (F.col("dot") / (F.col("nx") * F.col("ny"))).alias("similarity"))
    out = out.where(F.col("similarity") < most).orderBy(F.col("similarity").desc(), "grp").limit(top)
    if not words:
        return out
    least = F.round(F.least("x", "y"), 9)
    ranked = both.where("y IS NOT NULL").join(out.select("grp"), "grp", "left_semi").withColumn("k", F.row_number().over(Window.partitionBy("grp").orderBy(least.desc(), "token"))).where(F.col("k") <= words)
    return out.join(_listed(ranked), "grp", "left")


def _listed(ranked: DataFrame) -> DataFrame:
    """Rows (grp, words): each group's tokens by rank k, in one array."""
    return ranked.groupBy("grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "token"))), lambda x: x["token"]).alias("words"))


def outlier_groups(counts: DataFrame, hits: DataFrame | None = None, min_hits: int = 10, top_k: int = 20, top_n: int = 50, words: bool = False) -> DataFrame:
    """Rows (grp, score[, words]): the sum of a group's top_k positive z-scores against all other groups, on its own words.

    hits: rows (grp, hits); groups below ``min_hits`` are left out.  ``words``
    adds the words of those scores, the highest first.
    """
    if hits is not None:
        counts = counts.join(hits.where(F.col("hits") >= min_hits).select("grp"), "grp", "left_semi")
    counts = kept(counts, "counts")
    per_token = counts.groupBy("token").agg(F.sum("n").alias("all_n"))
    per_group = counts.groupBy("grp").agg(F.sum("n").alias("na"))
    total = counts.agg(F.sum("n").alias("total"))
    full = counts.join(per_token, "token").join(per_group, "grp").crossJoin(F.broadcast(total))
    rest: Column = F.col("all_n") - F.col("n")
    z = full.select("grp", "token", log_odds_z(F.col("n"), rest, F.col("na"), F.col("total") - F.col("na")).alias("z")).where("z > 0")
    best = z.withColumn("k", F.row_number().over(Window.partitionBy("grp").orderBy(F.round("z", 9).desc(), "token"))).where(F.col("k") <= top_k)
    scores = best.groupBy("grp").agg(F.sum("z").alias("score"), *([F.transform(F.array_sort(F.collect_list(F.struct("k", "token"))), lambda x: x["token"]).alias("words")] if words else []))
    return scores.orderBy(F.col("score").desc(), "grp").limit(top_n)


def hits_by_group(hits: DataFrame, docs: DataFrame, field: str) -> DataFrame:
    """Rows (grp, hits) of each value of a document field; null is the empty value.  Hits are summed by document first."""
    by_doc = hits.groupBy("doc").agg(F.count("*").alias("n")).join(docs.select("doc", F.coalesce(F.col(field).cast("string"), F.lit("")).alias("grp")), "doc")
    return by_doc.groupBy("grp").agg(F.sum("n").alias("hits"))


def over_periods(counts: DataFrame, year: str, period: int, top: int = 100) -> DataFrame:
    """Rows (period, token, n, z) from (year, token, n): each period's ``top`` words, and their z against its neighbours.

    Neighbours are the periods before and after that exist; z is null where
    it isn't positive.
    """
    by_period = counts.groupBy((F.floor(F.col(year) / period) * period).alias("period"), "token").agg(F.sum("n").alias("n"))
    by_period = kept(by_period, "periods")
    totals = by_period.groupBy("period").agg(F.sum("n").alias("total"))
    w = Window.orderBy("period")  # one row a period
    order = totals.select("period", "total", F.lag("period").over(w).alias("before"), F.lead("period").over(w).alias("after"), F.coalesce(F.lag("total").over(w), F.lit(0)).alias("tb"), F.coalesce(F.lead("total").over(w), F.lit(0)).alias("ta"))
    best = by_period.withColumn("k", F.row_number().over(Window.partitionBy("period").orderBy(F.col("n").desc(), "token"))).where(F.col("k") <= top).drop("k").join(F.broadcast(order), "period")
    side = lambda name: by_period.select(F.col("period").alias(name), "token", F.col("n").alias(f"n_{name}"))
    full = best.join(side("before"), ["before", "token"], "left").join(side("after"), ["after", "token"], "left")
    other = F.coalesce("n_before", F.lit(0)) + F.coalesce("n_after", F.lit(0))
    z = F.when(F.col("tb") + F.col("ta") > 0, log_odds_z(F.col("n"), other, F.col("total"), F.col("tb") + F.col("ta")))
    return full.select("period", "token", "n", F.when(z > 0, F.round(z, 4)).alias("z"))


def property_counts(hits: DataFrame, words: DataFrame, name: str) -> DataFrame:
    """Hits of each value of a word attribute, or each lemma; without a value NULL."""
    own = words.select(*SENTENCE, F.col("pos").alias("at"), _property(name).alias("value"))
    found = hits.select(*SENTENCE, F.col("positions")[0].alias("at")).join(own, [*SENTENCE, "at"])
    return found.groupBy(F.coalesce("value", F.lit("NULL")).alias("value")).agg(F.count("*").alias("n"))


def _property(name: str) -> Column:
    return F.col("lemma") if name == "lemma" else F.col("attrs")[name]


def query_properties(words: DataFrame, query: str, name: str, within: DataFrame | None = None) -> DataFrame:
    """property_counts() of a query's hits.  A hit of a single word is that word's row, so nothing is joined for it."""
    groups = split_phrases(group_terms(parse_query(query)))
    if len(groups) != 1:
        return property_counts(search(words, query, within=within), words, name)
    found = postings(words if within is None else inside(words, within), groups[0])
    return found.groupBy(F.coalesce(_property(name), F.lit("NULL")).alias("value")).agg(F.count("*").alias("n"))
