"""Plain-text segmentation of whole batches of texts at once: arrays of code points, no row per piece, no shuffle.

The rules are those of plain_text.pieces(), which states them as SQL.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from corpuslens.functions.text import folded

#: Bytes of text that are segmented at once; bounds a worker's memory. A longer text is taken alone.
SLICE_BYTES = 2 << 20
# What a code point is, and what a piece has one of.
LETTER, CHANGES, GROWS, DIGIT, NO_NUMBER, STRONG, STOP = 1, 2, 4, 8, 16, 32, 64
WORD, JOINED, BETWEEN, LINE_END = 1, 2, 3, 4
TOKEN = StructType([StructField("pos", IntegerType()), StructField("start", LongType()), StructField("token", StringType()), StructField("norm", StringType())])


@cache
def _signs() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each code point: its flags, the kind of piece it begins, and whether letters go on with the piece as it stands (0) or begin one of words."""
    flags, kinds = np.full(0x110000, NO_NUMBER, np.uint8), np.full(0x110000, BETWEEN, np.uint8)
    plain = np.zeros(0x110000, bool)
    for code in range(0x110000):
        sign = chr(code)
        major = unicodedata.category(sign)[0]
        if major not in "LMN":
            continue
        lower = sign.lower()
        kinds[code] = WORD
        plain[code] = major == "L"
        flags[code] = (LETTER if major == "L" else 0) | (0 if major == "N" else NO_NUMBER) | (CHANGES if lower != sign else 0) | (GROWS if len(lower) > 1 else 0)
    for signs, flag in (("0123456789", DIGIT), ("!?", STRONG), (".", STOP)):
        for sign in signs:
            flags[ord(sign)] |= flag
    for sign in "&;":
        kinds[ord(sign)] = JOINED
    kinds[ord("\n")] = LINE_END
    return flags, kinds, plain


def _rank(starts_new: np.ndarray) -> np.ndarray:
    """Places from 0 within runs; a run starts where the flag is set."""
    at = np.arange(len(starts_new))
    return at - np.maximum.accumulate(np.where(starts_new, at, 0))


def _firsts(*keys: np.ndarray) -> np.ndarray:
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def segmented(texts: list[str], breakers: tuple[str, ...], longest: int) -> dict:
    """Words of texts in order: which text (at), para, sent, pos, start as arrays, and words, forms: dictionary-encoded pieces with the token and norm of each."""
    flags, kinds, plain = _signs()
    joined = "\n".join(texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(codes)
    # pieces: a word piece of letters, marks and numbers; one of & and ; with letters; what lies between
    kind = kinds[codes]
    if "&" in joined or ";" in joined:
        inside = kind <= JOINED
        setter = inside & ~plain[codes]
        setter[:1] |= inside[:1]
        setter[1:] |= inside[1:] & ~inside[:-1]
        at = np.flatnonzero(setter)  # letters behind these go on with the piece
        runs = np.diff(at, append=n)
        if len(at):
            kind[at[0] :] = np.where(inside[at[0] :], np.repeat(kind[at], runs), kind[at[0] :])
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(kind[1:], kind[:-1], out=new[1:])
    new[1:] |= kind[1:] == LINE_END
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], n)
    piece_kind = kind[begin]
    has = np.bitwise_or.reduceat(flags[codes], begin)
    letters = (has & LETTER) > 0
    data = joined.encode("utf-8", "surrogatepass")
    if len(data) == n:
        edges = np.append(begin, n)
    else:  # places of the bytes that begin a code point
        edges = np.append(np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)[begin], len(data))
    n_bytes = np.diff(edges)
    # lines, and the paragraphs among them: those with a letter
    breaks = piece_kind == LINE_END
    line_of = np.cumsum(breaks) - breaks
    # texts: the first code point of each, the line it begins
    text_at = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)))[:-1]
    first_line = np.searchsorted(begin[breaks], text_at)
    lettered = np.zeros(int(breaks.sum()) + 1, np.int64)
    lettered[line_of[letters]] = 1
    before = np.concatenate(([0], np.cumsum(lettered)))
    owner = np.searchsorted(text_at, begin, side="right") - 1
    para = before[line_of] - before[first_line][owner] + 1
    # where sentences end
    following = np.append(np.arange(1, len(begin)), 0)
    there = np.append((line_of[1:] == line_of[:-1]) & ~breaks[1:], False)
    runs_on = there & (letters & ((has & CHANGES) == 0) | ((has & NO_NUMBER) == 0))[following]
    last = np.maximum.accumulate(np.where(letters, np.arange(len(begin)), -1))
    known = (last >= 0) & (line_of[last] == line_of)
    short = known & ((end - begin < 3) & ((has & (DIGIT | GROWS)) == DIGIT))[last]
    ends = ~letters & (((has & STRONG) > 0) | ((has & STOP) > 0) & ~runs_on & ~short)
    pieces = pa.StringArray.from_buffers(len(begin), pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(data))
    if breakers:
        ends |= ~letters & pc.is_in(pieces, value_set=pa.array(breakers, pa.string())).to_numpy(zero_copy_only=False)
    done = np.cumsum(ends) - ends
    of_line = _firsts(line_of)
    sent = done - done[np.maximum.accumulate(np.where(of_line, np.arange(len(begin)), 0))] + 1
    # words
    w = np.flatnonzero(letters & (n_bytes <= longest))
    spelled = pieces.take(pa.array(w)).dictionary_encode()
    tokens = [t.lower().replace("&", "").replace(";", "") for t in spelled.dictionary.to_pylist()]
    held = np.fromiter((t != "" for t in tokens), bool, len(tokens))[spelled.indices.to_numpy()] if len(w) else np.zeros(0, bool)
    w, index = w[held], spelled.indices.filter(pa.array(held))
    found = _firsts(line_of[w], sent[w])
    return {"at": owner[w], "para": para[w].astype(np.int32), "sent": sent[w].astype(np.int32), "pos": (_rank(found) + 1).astype(np.int32), "start": begin[w] - text_at[owner[w]], "new": found, "index": index, "tokens": pa.array(tokens, pa.string()), "norms": pa.array([t if t.isascii() else folded(t) for t in tokens], pa.string())}


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[str]]]:
    """Ids and texts, about SLICE_BYTES at once; texts that are null or empty have no words."""
    batch = batch.filter(pc.fill_null(pc.greater(pc.binary_length(batch.column(1)), 0), False))
    size = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(size) - size) // SLICE_BYTES
    edges = [*np.flatnonzero(_firsts(part)), batch.num_rows] if batch.num_rows else []
    for a, b in zip(edges, edges[1:]):
        yield batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a).to_pylist()


def _mapped(texts: DataFrame, doc: str, text: str, schema: StructType, make) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, bodies in _slices(batch):
                columns = make(ids, bodies)
                if len(columns[0]):
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return texts.select(F.col(doc).alias("doc"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def _key(texts: DataFrame, doc: str) -> list[StructField]:
    return [StructField("doc", texts.schema[doc].dataType), *(StructField(k, IntegerType()) for k in ("div1", "div2", "div3", "para", "sent"))]


def sentences(texts: DataFrame, doc: str, text: str, breakers: tuple[str, ...], longest: int) -> DataFrame:
    """Rows (keys, tokens), one a sentence; a narrow map."""

    def make(ids: pa.Array, bodies: list[str]) -> list[pa.Array]:
        x = segmented(bodies, breakers, longest)
        first = np.flatnonzero(x["new"])
        tokens = pa.StructArray.from_arrays([pa.array(x["pos"]), pa.array(x["start"]), x["tokens"].take(x["index"]), x["norms"].take(x["index"])], fields=list(pa.struct([("pos", pa.int32()), ("start", pa.int64()), ("token", pa.string()), ("norm", pa.string())])))
        one = pa.array(np.ones(len(first), np.int32))
        return [ids.take(pa.array(x["at"][first])), one, one, one, pa.array(x["para"][first]), pa.array(x["sent"][first]), pa.ListArray.from_arrays(pa.array(np.append(first, len(x["pos"])).astype(np.int32)), tokens)]

    return _mapped(texts, doc, text, StructType([*_key(texts, doc), StructField("tokens", ArrayType(TOKEN))]), make)


def frequencies(texts: DataFrame, doc: str, text: str, breakers: tuple[str, ...], longest: int) -> DataFrame:
    """Rows (doc, token, n), a text's distinct words; a narrow map."""

    def make(ids: pa.Array, bodies: list[str]) -> list[pa.Array]:
        x = segmented(bodies, breakers, longest)
        forms = x["tokens"].dictionary_encode()  # pieces that differ in case are one word
        size = max(len(forms.dictionary), 1)
        found, n = np.unique(x["at"] * size + forms.indices.to_numpy()[x["index"].to_numpy()], return_counts=True)
        return [ids.take(pa.array(found // size)), forms.dictionary.take(pa.array(found % size)), pa.array(n)]

    return _mapped(texts, doc, text, StructType([_key(texts, doc)[0], StructField("token", StringType()), StructField("n", LongType())]), make)


def words(texts: DataFrame, doc: str, text: str, breakers: tuple[str, ...], longest: int) -> DataFrame:
    """Rows (keys, pos, start, token, norm), one a word, in short runs that are sorted by norm: stored so, a term's scan skips the pages of the files that don't have it; a narrow map."""

    def make(ids: pa.Array, bodies: list[str]) -> list[pa.Array]:
        x = segmented(bodies, breakers, longest)
        index = x["index"].to_numpy()
        rank = np.empty(len(x["norms"]), np.int64)
        rank[pc.sort_indices(x["norms"]).to_numpy()] = np.arange(len(rank))
        alike = x["norms"].dictionary_encode()
        least = np.full(len(alike.dictionary), len(rank))
        np.minimum.at(least, alike.indices.to_numpy(), rank)
        order = np.argsort(least[alike.indices.to_numpy()][index], kind="stable")  # of one norm, in the order of the text
        named, one = pa.array(index[order]), pa.array(np.ones(len(order), np.int32))
        numbers = [pa.array(x[c][order]) for c in ("para", "sent", "pos", "start")]
        return [ids.take(pa.array(x["at"][order])), one, one, one, *numbers, x["tokens"].take(named), x["norms"].take(named)]

    return _mapped(texts, doc, text, StructType([*_key(texts, doc), *TOKEN.fields]), make)
