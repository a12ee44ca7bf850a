"""Word, phrase, proximity and same-object search.

Every search of several words is a chain of equi-joins on the key of the text
object, with the positions' condition as a residual, so that no plan needs a
nested loop.  Groups are filtered, and restricted to a corpus, before they meet.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions.text import folded
from corpuslens.operators.load import forms_asked, lemma_forms, with_lemmas
from corpuslens.plans.predicates import asks_lemma, is_plain, word_group
from corpuslens.plans.syntax import METACHARACTERS, Group, group_terms, parse_query, resolve_method, split_phrases
from corpuslens.schema import KEYS, SENTENCE, keys_of
from corpuslens.store import kept


def postings(words: DataFrame, group: Group, anchored: bool = False) -> DataFrame:
    """The rows of the words that a group stands for."""
    return words.where(word_group(group, anchored))


def near_postings(lexicon: DataFrame, ratio: float) -> Callable[..., DataFrame]:
    """Like postings(), with all words that are similar to one of the group's; what a group excludes stays excluded."""

    def near(words: DataFrame, group: Group, anchored: bool = False) -> DataFrame:
        terms = [t for t in group.any_of if t[0] in ("TERM", "QUOTE")]
        others = [t for t in group.any_of if t not in terms]  # lemmas and attributes are as they are
        plain = sorted({folded(v.strip('"')) for _, v in terms if not METACHARACTERS.search(v)})
        parts = [fuzzy(lexicon, v, ratio).select("norm") for v in plain]
        if patterns := [t for t in terms if METACHARACTERS.search(t[1])]:
            parts.append(_fuzzy_to_any(lexicon, lexicon.where(word_group(Group(patterns, group.none_of), anchored)).select("norm").distinct(), ratio))
        rows = words
        if parts:
            forms = reduce(DataFrame.unionByName, parts).distinct()
            rows = words.join(forms.withColumn("_near", F.lit(True)), "norm", "left").where(F.col("_near") | word_group(Group(others))).drop("_near") if others else words.join(forms, "norm", "left_semi")
        elif others:
            rows = words.where(word_group(Group(others)))
        return rows.where(~word_group(Group(group.none_of), anchored)) if group.none_of else rows

    return near


def lemma_postings(lemmas: DataFrame) -> Callable[..., DataFrame]:
    """Like postings(), of words without a lemma, which has to come from lemma rows (word, lemma).

    Only forms that may have a lemma of the group's meet the words.  They are
    stored first, so that their size is known when the join is planned, and
    few forms go to the words instead of all words to the forms.
    """

    def of(words: DataFrame, group: Group, anchored: bool = False) -> DataFrame:
        asked = asks_lemma(group)
        rows = with_lemmas(words, kept(forms_asked(lemma_forms(lemmas), asked), "forms")) if asked else words
        return postings(rows, group, anchored)

    return of


def _hits(rows: DataFrame, key: tuple[str, ...], n: int) -> DataFrame:
    spots = F.array_sort(F.array(*(F.struct(F.col(f"p{i}").alias("pos"), F.col(f"s{i}").alias("start")) for i in range(n))))
    out = rows.select(*key, spots.alias("spots"))
    return out.select(*key, F.transform("spots", lambda x: x["pos"]).alias("positions"), F.transform("spots", lambda x: x["start"]).alias("starts"))


def _span(n: int, value: Column, method: str) -> Column:
    return value <= n if method in ("proxy", "phrase") else value == n if method == "exact_cooc" else F.lit(True)


def search(words: DataFrame, query: str, method: str | None = None, arg: int | None = None, ordered: bool = True, level: str = "sent", within: DataFrame | None = None, anchored: bool = False, limit: int | None = None, pick: Callable[..., DataFrame] = postings) -> DataFrame:
    """Hits of a query: key columns, positions and starts of its words in text order.

    ``within`` (key columns of objects of one level) keeps words of those
    objects only.  ``level`` para looks for words in one paragraph, by their
    places in the text.  ``limit`` gives the first hits in document order.
    ``pick`` finds a group's rows; other ones than postings() may overlap.
    """
    if within is not None:
        words = inside(words, within)
    groups = split_phrases(group_terms(parse_query(query)))
    if not groups:
        return _hits(words.where(F.lit(False)).select(*SENTENCE, F.col("pos").alias("p0"), F.col("start").alias("s0")), SENTENCE, 1)
    name, n = resolve_method(" ".join("w" for _ in groups), method, arg, ordered)
    if len(groups) == 1:
        out = _hits(pick(words, groups[0], anchored).select(*SENTENCE, F.col("pos").alias("p0"), F.col("start").alias("s0")), SENTENCE, 1)
    else:
        out = _together(words, groups, *name.rsplit("_", 1), n, level, anchored, pick)
    return out.orderBy("doc", F.col("starts")[0]).limit(limit) if limit else out


def _together(words: DataFrame, groups: list[Group], method: str, order: str, n: int, level: str, anchored: bool, pick: Callable[..., DataFrame]) -> DataFrame:
    key = keys_of(level)
    spot = "pos" if level == "sent" else "start"
    n = n or 1
    if n == 1:
        n = len(groups) - 1
    sides = [pick(words, g, anchored).select(*key, F.col(spot).alias(f"p{i}"), F.col("start").alias(f"s{i}")) for i, g in enumerate(groups)]
    if method == "phrase" and order == "ordered":
        rows = sides[0].withColumn("anchor", F.col("p0"))
        for i, side in enumerate(sides[1:], 1):
            rows = rows.join(side.withColumn("anchor", F.col(f"p{i}") - i), [*key, "anchor"])
        return _hits(rows, key, len(sides))
    rows = sides[0]
    for i, side in enumerate(sides[1:], 1):
        right = side.select(*(F.col(k).alias(f"r_{k}") for k in key), f"p{i}", f"s{i}")
        test = F.lit(True)
        for k in key:
            test = test & (F.col(k) == F.col(f"r_{k}"))
        here, before = F.col(f"p{i}"), [F.col(f"p{j}") for j in range(i)]
        last = i == len(sides) - 1
        if order == "ordered":
            test = test & (here > before[-1])
            span = here - before[0]
        else:
            for b in before:
                test = test & (here != b)
            span = F.greatest(here, *before) - F.least(here, *before)
        # the span only grows, so it bounds every step; an exact one is known at the last
        test = test & (_span(n, span, method) if last or method != "exact_cooc" else span <= n)
        rows = rows.join(right, test).drop(*(f"r_{k}" for k in key))
    out = _hits(rows, key, len(sides))
    forms = [v for g in groups for _, v in g.any_of]
    disjoint = pick is postings and all(map(is_plain, groups)) and len(set(forms)) == len(forms)
    return out if order == "ordered" or disjoint else out.distinct()


def hits_in(sentences: DataFrame, group: Group, anchored: bool = False) -> DataFrame:
    """Hits of one group in the sentence layout, with their sentence's words (tokens); a narrow scan."""
    spot = lambda x: F.when(word_group(group, anchored, x.getField), F.struct(x["pos"], x["start"]))
    spots = F.filter(F.transform("tokens", spot), lambda x: x.isNotNull())
    rows = sentences.where(F.exists("tokens", lambda x: word_group(group, anchored, x.getField))).select(*SENTENCE, "tokens", F.explode(spots).alias("_s"))
    return rows.select(*SENTENCE, F.array("_s.pos").alias("positions"), F.array("_s.start").alias("starts"), "tokens")


def inside(rows: DataFrame, objects: DataFrame) -> DataFrame:
    """Rows that lie in one of the objects, given by their key columns."""
    key = [k for k in KEYS["word"][:-1] if k in objects.columns]
    return rows.join(objects.select(*key), key, "left_semi")


def inside_any(rows: DataFrame, *objects: DataFrame) -> DataFrame:
    """Rows in an object of any of the tables, whose depths may differ; a row counts once."""
    found = None
    keys = rows.columns
    for o in objects:
        part = inside(rows, o)
        found = part if found is None else found.unionByName(part)
    return found.dropDuplicates([k for k in keys if k in (*KEYS["word"][:-1], "positions", "pos")])


def per_object_limit(hits: DataFrame, k: int, level: str = "sent") -> DataFrame:
    """At most k hits of each object, in text order."""
    w = Window.partitionBy(*keys_of(level)).orderBy(F.col("starts")[0], "positions")
    return hits.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k).drop("_k")


def expand(lexicon: DataFrame, query: str, anchored: bool = False) -> DataFrame:
    """Rows (place, token): the forms that each group of a query stands for."""
    out = None
    for k, g in enumerate(split_phrases(group_terms(parse_query(query)))):
        part = lexicon.where(word_group(g, anchored)).select(F.lit(k).alias("place"), "token").distinct()
        out = part if out is None else out.unionByName(part)
    return out


def fuzzy(lexicon: DataFrame, term: str, ratio: float) -> DataFrame:
    """Rows (norm, ratio): lexicon entries whose indel ratio to a term, 1 - d / (len + len), is at least ``ratio``.

    d counts insertions and deletions, so it is the lengths' sum less twice the
    longest common subsequence.  Lengths alone rule most entries out before
    the Python function sees any.
    """
    want = folded(term)
    n = len(want)

    @F.pandas_udf("double")
    def score(values: pd.Series) -> pd.Series:
        return values.map(lambda v: indel_ratio(v, want))

    total = F.length("norm") + n
    close = lexicon.select("norm").distinct().where(F.abs(F.length("norm") - n) <= (1 - ratio) * total + 1e-9)
    return close.select("norm", score("norm").alias("ratio")).where(F.col("ratio") >= ratio)


def _fuzzy_to_any(lexicon: DataFrame, seeds: DataFrame, ratio: float) -> DataFrame:
    """The lexicon's norms that are similar to one of the seeds' (column norm); they meet by the lengths that may be similar."""

    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([indel_ratio(x, y) for x, y in zip(a, b)], dtype=float)

    n, least = F.length("seed"), ratio / (2 - ratio)  # |a - b| <= (1 - ratio) (a + b)
    lengths = F.explode(F.sequence(F.ceil(n * least - 1e-9).cast("int"), F.floor(n / least + 1e-9).cast("int")))
    near = seeds.select(F.col("norm").alias("seed")).withColumn("length", lengths)
    own = lexicon.select("norm").distinct().withColumn("length", F.length("norm"))
    return own.join(near, "length").where(score("norm", "seed") >= ratio).select("norm").distinct()


def indel_ratio(a: str, b: str) -> float:
    if not a and not b:
        return 1.0
    # bit-parallel longest common subsequence
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for c in b:
        hit = row & places.get(c, 0)
        row = (row + hit | row - hit) & full
    return 2 * (len(a) - bin(row).count("1")) / (len(a) + len(b))
