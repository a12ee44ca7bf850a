import pytest

from corpuslens.plans.predicates import literal_prefix
from corpuslens.plans.syntax import SearchRequest, group_terms, parse_date_query, parse_query, resolve_method, split_phrases


@pytest.mark.parametrize(
    "text, kinds",
    [
        ("hamlet", ["TERM"]), ("to be", ["TERM", "TERM"]), ('"to be or not"', ["QUOTE"]), ("hamlet | macbeth", ["TERM", "OR", "TERM"]), ("hamlet NOT ghost", ["TERM", "NOT", "TERM"]), ("1800-1850", ["RANGE"]),
        ("lemma:be", ["LEMMA"]), ("pos:NOUN", ["ATTR"]), ("lemma:be:pos", ["LEMMA_ATTR"]), ("NULL", ["NULL"]), ("", []), ("   ", []), ('"to be', ["QUOTE"]), ("café", ["TERM"]), ("NOTHING", ["TERM"]), ("NULLITY", ["TERM"]), ("1800-", ["RANGE"]), ("-1850", ["RANGE"]),
    ],
)
def test_tokens(text, kinds):
    assert [k for k, _ in parse_query(text)] == kinds


def test_groups():
    assert len(group_terms(parse_query("to be"))) == 2
    (g,) = group_terms(parse_query("a | b NOT c"))
    assert [v for _, v in g.any_of] == ["a", "b"] and [v for _, v in g.none_of] == ["c"]
    assert len(split_phrases(group_terms(parse_query('"to be or"')))) == 3
    assert len(split_phrases(group_terms(parse_query('"to be" | x')))) == 1


@pytest.mark.parametrize("text, value", [("1847", "1847-01-01<=>1847-12-31"), ("1847-06", "1847-06-01<=>1847-06-31"), ("1800<=>1850", "1800-01-01<=>1850-12-31"), ("1800-02-03<=>1850-05", "1800-02-03<=>1850-05-31")])
def test_dates(text, value):
    assert parse_date_query(text) == [("DATE_RANGE", value)]


def test_method():
    assert resolve_method("love", "proxy", 5) == ("single_term", 0)
    assert resolve_method("love die", None, None) == ("phrase_ordered", 0)
    assert resolve_method("love die", "proxy", 5, False) == ("proxy_unordered", 5)
    assert resolve_method("love die", "sentence", None)[0] == "sentence_ordered"
    with pytest.raises(ValueError):
        resolve_method("a b", "nonsense", 1)


def test_literal_prefix():
    assert [literal_prefix(p) for p in ("lov[ei]", "colou?r", "abc", ".*x", "a|b.*")] == ["lov", "colo", "abc", "", ""]


def test_request():
    r = SearchRequest.from_params({"q": "love death", "method": "proxy", "method_arg": "5", "cooc_order": "no", "author": "Dickens", "start": "26"})
    assert (r.arg, r.ordered, r.metadata, r.start) == (5, False, {"author": "Dickens"}, 26)
