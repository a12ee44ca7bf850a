"""Predicates on words and metadata from parsed groups.

Every predicate is a plain column expression, so filters reach the scan before
any join: equality and IN for terms, a prefix beside a regular expression.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuslens.functions.text import fold, folded, metadata_words
from corpuslens.plans.syntax import METACHARACTERS, Group, Token, group_terms, parse_date_query, parse_query


def literal_prefix(pattern: str) -> str:
    """What every match begins with: the signs before the first metacharacter, less one that a quantifier may drop."""
    m = METACHARACTERS.search(pattern)
    if not m or "|" in pattern:
        return "" if m else pattern
    return pattern[: m.start() - (m[0] in "*?{")] if m.start() else ""


def matches(c: Column, pattern: str, anchored: bool = False) -> Column:
    """Whether a value begins with (``anchored``: is) a match."""
    test = c.rlike(f"^(?:{pattern}){'$' if anchored else ''}")
    prefix = literal_prefix(pattern)
    return c.startswith(prefix) & test if prefix else test


def _either(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def is_form(c: Column, text: str) -> Column:
    """Whether a value is a form, or as a whole a match of a pattern."""
    return matches(c, text, True) if METACHARACTERS.search(text) else c == text


def word_token(token: Token, anchored: bool = False, get: Callable[[str], Column] = F.col) -> Column:
    """The test of a word by one token; ``get`` gives the word's columns, those of a row or of a struct."""
    kind, value = token
    if kind == "QUOTE":
        text = value.strip('"').lower()
        return matches(get("token"), text, anchored) if METACHARACTERS.search(text) else get("token") == text
    if kind in ("LEMMA", "LEMMA_ATTR", "ATTR"):
        parts = value.split(":")
        head = get("lemma") if parts[0] == "lemma" else get("token")
        rest = parts[1:] if parts[0] == "lemma" else parts
        test = is_form(head, rest[0])
        return test & (get("attrs")[rest[1]] == rest[2]) if len(rest) == 3 else test & (F.lit(True) if len(rest) == 1 else F.array_contains(F.map_values(get("attrs")), rest[1]))
    text = folded(value)
    return matches(get("norm"), text, anchored) if METACHARACTERS.search(text) else get("norm") == text


def word_group(group: Group, anchored: bool = False, get: Callable[[str], Column] = F.col) -> Column:
    """OR of the alternatives; terms without a pattern become one IN."""
    plain = sorted({folded(v) for k, v in group.any_of if k == "TERM" and not METACHARACTERS.search(v)})
    tests = [get("norm").isin(plain)] if plain else []
    tests += [word_token(t, anchored, get) for t in group.any_of if t[0] != "TERM" or METACHARACTERS.search(t[1])]
    test = _either(tests)
    return test & ~_either([word_token(t, anchored, get) for t in group.none_of]) if group.none_of else test


def asks_lemma(group: Group) -> Callable[[Column], Column] | None:
    """The test whether a value is one of the lemmas that a group names, to take or to leave out; None if it names none."""
    named = sorted({v.split(":")[1] for k, v in (*group.any_of, *group.none_of) if k in ("LEMMA", "LEMMA_ATTR")})
    return (lambda c: _either([is_form(c, x) for x in named])) if named else None


def is_plain(group: Group) -> bool:
    return not group.none_of and all(k == "TERM" and not METACHARACTERS.search(v) for k, v in group.any_of)


def _range(c: Column, value: str, separator: str) -> Column:
    low, _, high = value.partition(separator)
    kind = "date" if separator == "<=>" else "int"
    tests = [test for bound, test in ((low.strip(), c.__ge__), (high.strip(), c.__le__)) if bound for test in [test(F.lit(bound) if kind == "date" else F.lit(int(bound)))]]
    return tests[0] & tests[1] if len(tests) == 2 else tests[0] if tests else c.isNotNull()


def metadata_token(c: Column, token: Token, kind: str) -> Column:
    name, value = token
    if name == "NULL":
        return c.isNull()
    if name == "DATE_RANGE":
        return _range(c.cast("string"), value, "<=>")
    if name == "DATE":
        return c.cast("string") == value
    if name == "RANGE" and kind == "int":
        return _range(c, value, "-")
    if name == "QUOTE":
        return c.cast("string") == value.strip('"')
    if kind == "int":
        return c == F.lit(int(value)) if re.fullmatch(r"-?\d+", value) else F.lit(False)
    text = folded(value)
    if METACHARACTERS.search(text):
        return F.exists(metadata_words(c), lambda w: w.rlike(text))
    return F.array_contains(metadata_words(c), text) if re.fullmatch(r"\w+", text) else fold(c).contains(text)


def metadata_predicate(field: str, query: str, kind: str = "text") -> Column:
    """AND of the query's groups, OR within a group; NOT keeps to three-valued logic, so nulls drop out."""
    c = F.col(field)
    tokens = parse_date_query(query) if kind == "date" else parse_query(query)
    tests = []
    for g in group_terms(tokens):
        test = _either([metadata_token(c, t, kind) for t in g.any_of]) if g.any_of else None
        for t in g.none_of:
            negative = c.isNotNull() if t[0] == "NULL" else ~metadata_token(c, t, kind)
            test = negative if test is None else test & negative
        tests.append(test)
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out
