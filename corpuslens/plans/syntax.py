"""Query syntax: words, phrases, lemmas, attributes, OR, NOT, ranges, dates.

A query is scanned left to right; at each place the first kind of token that
fits is taken, and a sign that fits none is passed over.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

# Token patterns in order of precedence.
WORD_PATTERNS = (
    ("LEMMA_ATTR", r'lemma:[^\-|\s"]+:[^\-|\s"]+'),
    ("LEMMA", r'lemma:[^\-|\s"]+'),
    ("ATTR", r'[^\-|\s"]+:[^\-|\s"]+'),
    ("QUOTE", r'".+?"'),
    ("QUOTE", r'".+'),
    ("NOT", r"NOT(?!\S)"),
    ("OR", r"\|"),
    ("RANGE", r"[^|\s]+?\-[^|\s]+"),
    ("RANGE", r"\d+\-\Z"),
    ("RANGE", r"\-\d+\Z"),
    ("NULL", r"NULL(?!\S)"),
    ("TERM", r'[^\-|\s"]+'),
)
METACHARACTERS = re.compile(r"[.*+?\[{(\\]")
METHODS = ("phrase", "proxy", "exact_cooc", "sentence")
DATE = re.compile(r"(\d+)(?:-(\d+)(?:-(\d+))?)?\Z")

Token = tuple[str, str]


def parse_query(text: str, patterns: tuple[tuple[str, str], ...] = WORD_PATTERNS) -> list[Token]:
    scanners = [(kind, re.compile(p)) for kind, p in patterns]
    at, tokens = 0, []
    while at < len(text):
        kind, hit = next(((k, m) for k, s in scanners if (m := s.match(text, at)) and m.end() > at), (None, None))
        if hit:
            tokens.append((kind, hit[0]))
        at = hit.end() if hit else at + 1
    return tokens


def whole_date(text: str, end: bool) -> str:
    """A year or month as its first or last day; months end on a day 31, which comparisons of ISO strings take as the end."""
    year, month, day = DATE.match(text).groups()
    return "-".join((year, month or ("12" if end else "01"), day or ("31" if end else "01")))


def parse_date_query(text: str) -> list[Token]:
    """Dates, years, months and ``a<=>b`` ranges, all as DATE or DATE_RANGE tokens, with NOT and OR."""
    out: list[Token] = []
    for part in re.split(r"(\||\bNOT\b)", text):
        part = part.strip()
        if part in ("|", "NOT"):
            out.append(("OR" if part == "|" else "NOT", part))
        elif "<=>" in part:
            a, b = (x.strip() for x in part.split("<=>", 1))
            out.append(("DATE_RANGE", f"{whole_date(a, False) if DATE.match(a) else a}<=>{whole_date(b, True) if DATE.match(b) else b}"))
        elif m := DATE.match(part):
            out.append(("DATE", part) if m[3] else ("DATE_RANGE", f"{whole_date(part, False)}<=>{whole_date(part, True)}"))
    return out


@dataclass
class Group:
    """Alternatives that stand for one place of a query, and what is taken from them."""

    any_of: list[Token] = field(default_factory=list)
    none_of: list[Token] = field(default_factory=list)


def group_terms(tokens: list[Token]) -> list[Group]:
    """Neighbours are groups of their own; OR joins the next token to the group before, NOT takes it from that."""
    groups: list[Group] = []
    link = None
    for kind, value in tokens:
        if kind in ("OR", "NOT"):
            link = kind
            continue
        if not groups or link is None or (link == "OR" and groups[-1].any_of and groups[-1].any_of[-1][0] == "RANGE" and kind != "RANGE"):
            groups.append(Group())
        (groups[-1].none_of if link == "NOT" else groups[-1].any_of).append((kind, value))
        link = None
    return groups


def split_phrases(groups: list[Group]) -> list[Group]:
    """A lone quotation of several words becomes a group for each; in word search a range is a term."""
    out = []
    for g in groups:
        if len(g.any_of) == 1 and not g.none_of and g.any_of[0][0] == "QUOTE" and len(words := g.any_of[0][1].strip('"').split()) > 1:
            out += [Group([("QUOTE", f'"{w}"')]) for w in words]
        else:
            term = lambda ts: [("TERM", v) if k == "RANGE" else (k, v) for k, v in ts]
            out.append(Group(term(g.any_of), term(g.none_of)))
    return out


def resolve_method(query: str, method: str | None, arg: int | None, ordered: bool = True) -> tuple[str, int]:
    """The operator that a request means: single_term, or a method with _ordered or _unordered, and its number."""
    if len(query.split()) <= 1:
        return "single_term", 0
    order = "ordered" if ordered else "unordered"
    method = method or "proxy"
    if method not in METHODS:
        raise ValueError(f"unknown method: {method}")
    if method in ("proxy", "exact_cooc") and not arg:
        return f"phrase_{order}", 0
    return f"{method}_{order}", 6 if method == "sentence" else int(arg or 0)


@dataclass
class SearchRequest:
    """A request's parts, as the web form would send them."""

    q: str = ""
    method: str | None = None
    arg: int | None = None
    ordered: bool = True
    metadata: dict[str, str] = field(default_factory=dict)
    start: int = 0
    end: int = 0
    per_page: int = 25
    sort_by: tuple[str, ...] = ()
    approximate_ratio: int = 100

    @classmethod
    def from_params(cls, params: dict[str, str], rewrites: tuple[tuple[str, str], ...] = ()) -> SearchRequest:
        """From query-string parameters; ``rewrites`` are regular expressions and replacements for the words."""
        q = params.get("q", "").strip()
        for pattern, new in rewrites:
            q = re.sub(pattern, new, q)
        known = {"q", "method", "method_arg", "cooc_order", "start", "end", "results_per_page", "sort_by", "approximate", "approximate_ratio", "report"}
        number = lambda name: int(params[name]) if params.get(name, "").isdigit() else 0
        return cls(
            q, params.get("method") or None, number("method_arg") or None, params.get("cooc_order", "yes") == "yes", {k: v for k, v in params.items() if k not in known and v},
            number("start"), number("end"), number("results_per_page") or 25, tuple(params.get("sort_by", "").split()), number("approximate_ratio") or 100 if params.get("approximate") == "yes" else 100,
        )
