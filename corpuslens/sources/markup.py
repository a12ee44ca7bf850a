"""TEI and HTML sources: a tolerant tag stream turned into words and objects.

Parsing is sequential within a document, so it is one Python function of a
text; documents are parsed in parallel.  Nothing needs to be well-formed: tags
are taken as they come, a missing end is implied by the next beginning.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from operator import itemgetter

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions.text import folded

TAG = re.compile(r"<(/?)([A-Za-z][\w:.-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<!--.*?-->|<[!?][^>]*>", re.S)
ATTRIBUTE = re.compile(r"([\w:.-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")
PIECE = regex.compile(r"[\p{L}\p{M}\p{N}]+(?:_+[\p{L}\p{M}\p{N}]+)*|[&\p{L};]+|[^\p{L}\p{M}\p{N}&;]+")
LETTER = regex.compile(r"\p{L}")
#: What words are indexed without.
DROPPED = regex.compile(r"[&;_\p{C}]")
LONGEST_WORD = 200  # bytes
#: Pieces of up to so many signs are looked at once.
LONGEST_HELD = 64
#: What a separator ends: nothing, a sentence unless its surroundings are of a kind, a sentence.
WEAK, STOP, STRONG = 0, 1, 2
# What tags are.
PARAGRAPHS = frozenset("p sp lg note epigraph argument list opener closer stage castlist add ab".split())
DIVISION = re.compile(r"div([0-7]?)\Z")
#: Tags that may stand within a word.
IN_WORDS = "hi emph orig sic abbr i sup".split()
#: Paragraphs that hold no other objects.
CLOSED = frozenset("sp argument opener closer add".split())
#: What isn't an object within those, or among notes.
OPEN_ONLY = frozenset("p stage lg".split())
HEADINGS = {"h1": 1, "h2": 2, "h3": 3}
SKIPPED = frozenset("teiheader head_html script style".split())
PAGE, LINE, REF, GRAPHIC = frozenset(["pb"]), frozenset(["l", "lb"]), frozenset(["ref"]), frozenset(["graphic", "figure"])
MAX_DEPTH = 3
#: Rows that go to Spark at once.
BATCH_ROWS = 8192
ROWS = "doc bigint, kind string, name string, div1 int, div2 int, div3 int, para int, sent int, pos int, page int, start bigint, end bigint, token string, norm string, head string, attrs map<string,string>"
WORDS = "doc bigint, div1 int, div2 int, div3 int, para int, sent int, pos int, page int, start bigint, token string, norm string"


@dataclass
class State:
    """Where the parser stands; a deeper counter starts again when a higher one moves."""

    divs: list[int] = field(default_factory=lambda: [0, 0, 0])
    depth: int = 0
    para: int = 0
    sent: int = 1
    pos: int = 0
    page: int = 0
    last: str = ""
    open_para: dict | None = None
    own_sentences: bool = False
    front: bool = False
    closed: bool = False
    in_lines: bool = False
    break_lines: bool = True
    has_divs: bool = True
    parallel: dict[str, int] = field(default_factory=dict)

    def key(self) -> dict:
        return {"div1": self.divs[0] or 1, "div2": self.divs[1] or 1, "div3": self.divs[2] or 1, "para": self.para}


_GAP = re.compile(r"(?<=\w)((?:-|&hyphen;|&shy;|\u00ad)\s*(?:</?(?:lb|pb)\b[^>]*>\s*)*(?:</?(?:lb|pb)\b[^>]*>|\n)\s*|(?:&shy;|\u00ad))(?=\w)", re.I)
_EXPANSION = re.compile(r"<abbr\b[^>]*\bexpan=\"([^\"]*)\"[^>]*>([^<]*)</abbr>", re.I)
_IN_WORD = re.compile(rf"(?<=\w)(?:</?(?:{'|'.join(IN_WORDS)})\b[^>]*>)+(?=\w)", re.I)


def tidied(text: str) -> str:
    """Markup before it is parsed: every sign keeps its place.

    Carriage returns and line ends are blanks; a word that is broken by a
    hyphen at a line's end, or by tags that stand within words, is filled up
    with ``_``, which words are indexed without.  An abbreviation whose
    expansion fits between its tags is replaced by that.
    """
    filler = lambda m: "_" * len(m[0])
    expanded = _EXPANSION.sub(lambda m: m[1].ljust(len(m[0])) if len(m[1]) <= len(m[0]) else m[0], text)
    return _IN_WORD.sub(filler, _GAP.sub(filler, expanded.replace("\r", " "))).replace("\n", " ")


def parse(text: str | None, is_html: bool = False, break_lines: bool = True) -> Iterator[dict]:
    """Rows of ROWS but doc: objects (kind div, para, page, line, ref, graphic), attributes that follow their object (kind attr), words and punctuation, in order.

    Words outside divisions or paragraphs lie in virtual ones (name
    ``__virtual``), so that no two objects have one key.  With ``break_lines``
    each <l> of a line group is a sentence.
    """
    text = tidied(text or "")
    s = State(break_lines=break_lines, has_divs=bool(re.search(r"<div|<h[1-3]" if is_html else "<div", text, re.I)))
    begin = 0
    if is_html and (m := re.search(r"</head\s*>", text, re.I)):
        begin = m.end()
    elif not is_html and (m := re.search(r"</teiheader\s*>", text, re.I)):
        begin = m.end()
    skip: str | None = None
    at = begin
    for m in TAG.finditer(text, begin):
        if skip is None and at < m.start():
            yield from _text(s, text[at : m.start()], at)
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        closing = bool(m[1])
        if skip:
            if closing and name == skip:
                skip = None
            continue
        if name in SKIPPED and not closing and not m[0].endswith("/>"):
            skip = name
            continue
        yield from _tag(s, name, closing, {k.lower(): html.unescape(a or b) for k, a, b in ATTRIBUTE.findall(m[3] or "")}, text, m)
    if skip is None and at < len(text):
        yield from _text(s, text[at:], at)


def _head(text: str, at: int, tag: str) -> str:
    """The text of the heading that follows, within the same division."""
    m = re.compile(rf"<{tag}\b[^>]*>(.*?)(?:</{tag}\s*>|<div)", re.S | re.I).search(text, at, at + 4000)
    stop = re.compile(r"<div", re.I).search(text, at)
    if not m or stop and stop.start() < m.start():
        return ""
    return re.sub(r"\s+", " ", re.sub(r"[_\"\[\]]", "", html.unescape(re.sub(r"<[^>]*>", " ", m[1])))).strip()


def _open_div(s: State, depth: int) -> None:
    for k in range(depth - 1):
        s.divs[k] = s.divs[k] or 1
    s.divs[depth - 1] += 1
    for k in range(depth, MAX_DEPTH):
        s.divs[k] = 0
    s.depth, s.para, s.sent, s.pos, s.open_para, s.in_lines, s.closed = depth, 0, 1, 0, None, False, False


def _new_para(s: State, at: int) -> Iterator[dict]:
    """Begins a paragraph, in virtual divisions where there are none."""
    if not s.divs[0]:
        s.divs[0] = 1
        yield _row(s, "div", "__virtual", at, at)
    s.divs = [d or 1 for d in s.divs]
    s.para, s.sent, s.pos, s.last = s.para + 1, 1, 0, ""


def _new_sentence(s: State) -> None:
    if s.pos:
        s.sent, s.pos = s.sent + 1, 0


def _row(s: State, kind: str, name: str, start: int, end: int, **more) -> dict:
    return {"kind": kind, "name": name, **s.key(), "sent": 0, "pos": 0, "page": s.page, "start": start, "end": end, "token": None, "norm": None, "head": None, "attrs": {}} | more


def _attr(s: State, name: str, value: str, m: re.Match, of_div: bool) -> dict:
    """A field of the open division or paragraph, found behind its tag."""
    row = _row(s, "attr", name, m.start(), m.end(), head=value)
    return row | ({"para": 0} if of_div else {})


def _tag(s: State, name: str, closing: bool, attrs: dict, text: str, m: re.Match) -> Iterator[dict]:
    division = DIVISION.match(name)
    if division or name in HEADINGS and not closing:
        if closing:
            s.depth, s.open_para, s.closed = max(0, s.depth - 1), None, False
            return
        level = HEADINGS.get(name) or int(division[1] or 0)
        depth = level if 1 <= level <= MAX_DEPTH and not s.front else min(MAX_DEPTH, s.depth + 1)
        _open_div(s, depth)
        heading = name if name in HEADINGS else "head"
        head = _head(text, m.start() if name in HEADINGS else m.end(), heading) or attrs.get("type", "") or "[NA]"
        s.closed = attrs.get("type") == "notes"
        yield _row(s, "div", f"div{depth}", m.start(), m.end(), head=head, attrs=attrs)
    elif name in ("front", "hyperdiv") or name == "body" and not closing and not s.has_divs:
        if name == "front" and closing:
            s.front, s.depth = False, 0
        if not closing:
            _open_div(s, 1)
            s.front = name == "front"
            head = {"front": attrs.get("type", "") or "[NA]", "hyperdiv": "[HyperDiv]"}.get(name) or _head(text, m.end(), "head") or "Document Body"
            yield _row(s, "div", name, m.start(), m.end(), head=head, attrs=attrs)
    elif name == "speaker":
        if not closing and s.open_para:
            end = text.find("<", m.end())
            yield _attr(s, "speaker", re.sub(r"\.$", "", text[m.end() : end if end >= 0 else len(text)].strip()).title(), m, False)
    elif name in ("index", "date") and not closing and s.depth:
        if name == "index" and "type" in attrs:
            attrs = {attrs["type"]: attrs["value"]} if "value" in attrs else {}
        for key, value in attrs.items():
            yield _attr(s, key if name == "index" else "div_date" if key in ("value", "when") else f"div_{key}", value, m, True)
    elif name in PARAGRAPHS:
        if s.closed and name in OPEN_ONLY:
            return
        s.open_para = None
        s.in_lines = name == "lg" and not closing and s.break_lines
        s.closed = name in CLOSED and not closing
        if not closing:
            yield from _new_para(s, m.start())
            s.open_para = {"name": name}
            yield _row(s, "para", name, m.start(), m.end(), attrs=attrs)
    elif name == "s":
        s.own_sentences = not closing
        _new_sentence(s)
    elif closing:
        if name == "l" and s.in_lines:
            _new_sentence(s)
    elif name in PAGE:
        s.page += 1
        yield _row(s, "page", re.sub("[ -]", "_", attrs.get("n", "")).lower() or "na", m.start(), m.end(), attrs=attrs)
    elif name in LINE | REF | GRAPHIC:
        if name == "l" and s.in_lines:
            _new_sentence(s)
        kind = "line" if name in LINE else "ref" if name in REF else "graphic"
        s.parallel[kind] = s.parallel.get(kind, 0) + 1
        yield _row(s, kind, attrs.get("n", ""), m.start(), m.end(), pos=s.parallel[kind], attrs=attrs)


@lru_cache(maxsize=1 << 16)
def _piece(raw: str) -> tuple[bool, str, str | int]:
    """Whether a piece is a word; a word's token, empty if it isn't indexed, and norm; a separator's signs and what it ends."""
    if LETTER.search(raw):
        token = DROPPED.sub("", html.unescape(raw).lower()) if len(raw.encode()) <= LONGEST_WORD else ""
        return True, token, folded(token)
    return False, raw.strip(), STRONG if "!" in raw or "?" in raw else STOP if "." in raw else WEAK


def _text(s: State, chunk: str, at: int) -> Iterator[dict]:
    if not LETTER.search(chunk) and not chunk.strip():
        return
    pieces = PIECE.findall(chunk)  # which leave no sign out
    key = s.key()
    for k, raw in enumerate(pieces):
        start, at = at, at + len(raw)
        is_word, token, more = _piece(raw) if len(raw) <= LONGEST_HELD else _piece.__wrapped__(raw)
        if is_word:
            s.last = raw
            if not token:
                continue
            if s.para == 0:
                yield from _new_para(s, start)
                yield _row(s, "para", "__virtual", start, start)
                key = s.key()
            s.pos += 1
            yield {"kind": "word", "name": token, **key, "sent": s.sent, "pos": s.pos, "page": s.page, "start": start, "end": at, "token": token, "norm": more, "head": None, "attrs": {}}
            continue
        follows = pieces[k + 1] if k + 1 < len(pieces) else ""
        ends = more == STRONG or more == STOP and not (len(s.last) < 3 and re.search("[A-Z0-9]", s.last)) and not (follows.islower() or follows.isdigit())
        if token:
            yield _row(s, "punct", token, start, at, sent=s.sent)
        if ends and not s.own_sentences and not s.in_lines:
            _new_sentence(s)


def parsed(df: DataFrame, doc: str, text: str, is_html: bool = False) -> DataFrame:
    """Rows of ROWS for all documents; a narrow map."""
    return _mapped(df, doc, text, is_html, ROWS)


def parsed_words(df: DataFrame, doc: str, text: str, is_html: bool = False) -> DataFrame:
    """words_of() what is parsed; no other rows or columns leave the parser."""
    return _mapped(df, doc, text, is_html, WORDS, "word")


def _mapped(df: DataFrame, doc: str, text: str, is_html: bool, ddl: str, kind: str | None = None) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(ddl))
    columns = itemgetter(*(f.name for f in schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for doc_id, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for row in parse(body, is_html):
                    if kind is None or row["kind"] == kind:
                        row["doc"] = doc_id
                        held.append(columns(row))
                        if len(held) >= BATCH_ROWS:
                            yield packed(held)
                            held = []
        if held:
            yield packed(held)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        listed = ([list(v.items()) for v in column] if f.name == "attrs" else column for f, column in zip(schema, zip(*rows)))
        return pa.RecordBatch.from_arrays([pa.array(column, f.type) for column, f in zip(listed, schema)], schema=schema)

    return df.select(F.col(doc).cast("bigint"), F.col(text).cast("string")).mapInArrow(run, ddl)


def words_of(rows: DataFrame) -> DataFrame:
    """The words table; their page with it."""
    return rows.where("kind = 'word'").select("doc", "div1", "div2", "div3", "para", "sent", "pos", "page", "start", "token", "norm")


def divisions(rows: DataFrame) -> DataFrame:
    """One row a division: level, its key (keys below its level are 0), head, start and attrs; what follows in index and date tags stands behind its own attributes."""
    depth = lambda k: F.col("depth") >= k
    found = rows.where("kind = 'div' OR kind = 'attr' AND para = 0")
    keys = ["doc", "div1", "div2", "div3"]
    late = found.where("kind = 'attr'").groupBy(*keys, "name").agg(F.min_by("head", "start").alias("value")).groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("late"))
    own = found.where("kind = 'div'").withColumn("depth", F.coalesce(F.regexp_extract("name", r"^div(\d)$", 1).try_cast("int"), F.lit(1)))
    whole = own.join(late, keys, "left")
    attrs = F.map_concat("attrs", F.coalesce(F.map_filter("late", lambda k, _: ~F.map_contains_key(F.col("attrs"), k)), F.create_map().cast("map<string,string>")))
    return whole.select("doc", F.concat(F.lit("div"), "depth").alias("level"), "div1", F.when(depth(2), F.col("div2")).otherwise(0).alias("div2"), F.when(depth(3), F.col("div3")).otherwise(0).alias("div3"), "name", "start", "head", attrs.alias("attrs"))


def paragraphs(rows: DataFrame) -> DataFrame:
    """One row a paragraph: key, name (its tag), start, who and speaker, and its attributes."""
    keys = ["doc", "div1", "div2", "div3", "para"]
    speaker = rows.where("kind = 'attr' AND name = 'speaker'").groupBy(*keys).agg(F.min_by("head", "start").alias("speaker"))
    return rows.where("kind = 'para'").select(*keys, "name", "start", F.col("attrs")["who"].alias("who"), "attrs").join(speaker, keys, "left")


# Views that need no parser: built-in expressions over the markup.


def headings(df: DataFrame, doc: str, markup: str) -> DataFrame:
    """Rows (doc, n, depth, head) of h1 to h3, in order from 1."""
    found = F.regexp_extract_all(F.col(markup), F.lit(r"(?s)<h[1-3][^>]*>.*?</h[1-3]>"), F.lit(0))
    rows = df.select(F.col(doc).alias("doc"), F.posexplode(found).alias("k", "x"))
    head = F.trim(F.regexp_replace(F.regexp_replace(F.col("x"), "<[^>]+>", " "), r"\s+", " "))
    return rows.select("doc", (F.col("k") + 1).alias("n"), F.substring("x", 3, 1).cast("int").alias("depth"), head.alias("head"))


def tag_census(df: DataFrame, markup: str) -> DataFrame:
    """Rows (tag, starts, ends, empties, malformed, flags) over all documents.

    flags: * other numbers of starts and ends, E both empty and closed ones, X malformed ones.
    """
    tags = F.regexp_extract_all(F.col(markup), F.lit(r"</?[A-Za-z][A-Za-z0-9]*[^<>]*>?"), F.lit(0))
    one = df.select(F.explode(tags).alias("t")).select(F.lower(F.regexp_extract("t", r"^</?([A-Za-z][A-Za-z0-9]*)", 1)).alias("tag"), F.col("t").startswith("</").alias("end"), F.col("t").endswith("/>").alias("empty"), (~F.col("t").endswith(">")).alias("bad"))
    count = lambda c: F.sum(c.cast("bigint"))
    out = one.groupBy("tag").agg(count(~F.col("end") & ~F.col("empty") & ~F.col("bad")).alias("starts"), count(F.col("end") & ~F.col("bad")).alias("ends"), count(F.col("empty")).alias("empties"), count(F.col("bad")).alias("malformed"))
    return out.withColumn("flags", census_flags())


def census_flags() -> Column:
    flag = lambda test, sign: F.when(test, sign).otherwise("")
    return F.concat(flag(F.col("starts") != F.col("ends"), "*"), flag((F.col("empties") > 0) & (F.col("ends") > 0), "E"), flag(F.col("malformed") > 0, "X"))


def census_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """A census less another; rows of zeros go."""
    names = ("starts", "ends", "empties", "malformed")
    less = b.select("tag", *((-F.col(n)).alias(n) for n in names))
    out = a.select("tag", *names).unionByName(less).groupBy("tag").agg(*(F.sum(n).alias(n) for n in names))
    return out.where(" OR ".join(f"{n} <> 0" for n in names)).withColumn("flags", census_flags())
