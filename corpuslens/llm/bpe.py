"""Byte-level BPE encoding and decoding.

Unique pre-tokens go into padded integer matrices, bucketed by length.  In
each round every row merges its leftmost pair of least rank: ranks come from a
hash table over id pairs, one cell of each row is removed, and finished rows
leave the matrix.  Rows of more than NARROW bytes leave the removed cell as a
hole, keep the least rank of each block of cells, and are compacted when a
quarter of the cells are gone, so that a round reads one cell a block, and one
block, instead of the row.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Sequence
from itertools import chain

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import map_slices

NONE = np.int32(2**31 - 1)
EMPTY = np.uint64(2**64 - 1)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
WIDTHS = (2, 3, 4, 5, 6, 7, 8, 10, 12, 14, 16, 20, 24, 32, 48, 64, 96, 128, 192, 256)
NARROW = WIDTHS[-1]
#: Cells of a block in wider rows.
BLOCK = 64
#: Cells of one matrix.
CELLS = 1 << 20
#: Pre-tokens whose ids a worker remembers.
CACHE = 250_000


class PairTable:
    """Open-addressing hash table from (left id, right id) to the merged id, which is also its rank."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        keys = self._key(left, right)
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys, self.values = np.full(1 << bits, EMPTY), np.full(1 << bits, NONE, np.int32)
        home, waiting, probe = self._home(keys), np.arange(len(keys)), 0
        while waiting.size:
            slot = (home[waiting] + probe) & self.mask
            free = np.flatnonzero(self.keys[slot] == EMPTY)
            taken, first = np.unique(slot[free], return_index=True)
            chosen = free[first]
            self.keys[taken], self.values[taken] = keys[waiting[chosen]], merged[waiting[chosen]]
            waiting, probe = np.delete(waiting, chosen), probe + 1

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys * GOLDEN >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids, NONE where there is no such merge; negative ids are padding."""
        out = np.full(left.shape, NONE, np.int32)
        at = np.flatnonzero((left >= 0) & (right >= 0))
        keys = self._key(left.ravel()[at], right.ravel()[at])
        slot, flat = self._home(keys), out.ravel()
        while at.size:
            there = self.keys[slot]
            hit = there == keys
            flat[at[hit]] = self.values[slot[hit]]
            on = ~hit & (there != EMPTY)
            at, keys, slot = at[on], keys[on], (slot[on] + 1) & self.mask
        return flat.reshape(left.shape)


class ByteBPE:
    """Codec of a rank file; ids are the ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.split = regex.compile(pattern).findall
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        triples = [(a, b, rank) for token, rank in ranks.items() for cut in range(1, len(token)) if (a := ranks.get(token[:cut])) is not None and (b := ranks.get(token[cut:])) is not None]
        self.pairs = PairTable(*np.array(triples, np.int64).T.astype(np.int32)) if triples else PairTable(*np.zeros((3, 0), np.int32))
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.lengths = np.fromiter(map(len, tokens), np.int64, size)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.cache: dict[str, bytes] = {}

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers; a null text is empty."""
        split = [self.split(t) if t else [] for t in texts]
        words = set(chain.from_iterable(split))
        new = [w for w in words if w not in self.cache]
        if len(self.cache) + len(new) > CACHE:
            self.cache.clear()
            new = list(words)
        self.cache.update(zip(new, self.merge([w.encode() for w in new])))
        ids = self.cache.__getitem__
        return [b"".join(map(ids, s)) for s in split]

    def merge(self, words: Sequence[bytes]) -> list[bytes]:
        out: list[bytes] = [b""] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        for i in np.flatnonzero(lengths == 1):
            out[i] = self.byte_ids[words[i][0]].astype("<u4").tobytes()
        least = 1
        for width in WIDTHS:
            chosen = np.flatnonzero((lengths > least) & (lengths <= width))
            least = width
            for at in range(0, len(chosen), CELLS // width):
                self._merge_matrix(words, lengths, chosen[at : at + CELLS // width], width, out)
        width = NARROW
        while width < lengths.max(initial=0):
            width *= 2
            chosen = np.flatnonzero((lengths > width // 2) & (lengths <= width))
            step = max(1, CELLS // width)
            for at in range(0, len(chosen), step):
                self._merge_wide(words, lengths, chosen[at : at + step], width, out)
        return out

    def _merge_matrix(self, words: Sequence[bytes], lengths: np.ndarray, chosen: np.ndarray, width: int, out: list[bytes]) -> None:
        ids = np.full((len(chosen), width), -1, np.int32)
        ids[np.arange(width) < lengths[chosen, None]] = self.byte_ids[np.frombuffer(b"".join([words[i] for i in chosen]), np.uint8)]
        ranks = np.full(ids.shape, NONE, np.int32)
        ranks[:, :-1] = self.pairs.find(ids[:, :-1], ids[:, 1:])
        while len(chosen):
            row, at = np.arange(len(chosen)), ranks.argmin(1)
            best = ranks[row, at]
            done = best == NONE
            if done.any():
                self._emit(ids[done], chosen[done], out)
                on = ~done
                ids, ranks, chosen, at, best = ids[on], ranks[on], chosen[on], at[on], best[on]
                row = np.arange(len(chosen))
                if not len(chosen):
                    break
            ids[row, at] = best
            stays = np.ones(ids.shape, bool)
            stays[row, at + 1] = False
            ids, ranks = ids[stays].reshape(len(row), -1), ranks[stays].reshape(len(row), -1)
            last = ids.shape[1] - 1
            after = np.where(at < last, ids[row, np.minimum(at + 1, last)], -1)
            ranks[row, at] = self.pairs.find(best, after)
            inner = np.flatnonzero(at > 0)
            ranks[inner, at[inner] - 1] = self.pairs.find(ids[inner, at[inner] - 1], best[inner])

    @staticmethod
    def _emit(ids: np.ndarray, chosen: np.ndarray, out: list[bytes]) -> None:
        kept = ids >= 0
        ends = (np.cumsum(kept.sum(1)) * 4).tolist()
        flat, start = ids[kept].astype("<u4").tobytes(), 0
        for i, end in zip(chosen.tolist(), ends):
            out[i] = flat[start:end]
            start = end

    def _merge_wide(self, words: Sequence[bytes], lengths: np.ndarray, chosen: np.ndarray, width: int, out: list[bytes]) -> None:
        ids = np.full((len(chosen), width), -1, np.int32)
        ids[np.arange(width) < lengths[chosen, None]] = self.byte_ids[np.frombuffer(b"".join([words[i] for i in chosen]), np.uint8)]
        while len(chosen):
            ids, chosen = self._merge_rounds(ids, chosen, out)

    def _merge_rounds(self, ids: np.ndarray, chosen: np.ndarray, out: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """A quarter of the width's rounds on rows without holes; returns the unfinished rows, compacted."""
        n, width = ids.shape
        ranks = np.full(ids.shape, NONE, np.int32)
        ranks[:, :-1] = self.pairs.find(ids[:, :-1], ids[:, 1:])
        blocks = ranks.reshape(n, -1, BLOCK)
        least = blocks.min(2)
        after, before = np.tile(np.arange(1, width + 1, dtype=np.int32), (n, 1)), np.tile(np.arange(-1, width - 1, dtype=np.int32), (n, 1))
        row = np.arange(n)
        for _ in range(width // 4):
            block = least[row].argmin(1)
            best = least[row, block]
            done = best == NONE
            if done.any():
                self._emit(ids[row[done]], chosen[row[done]], out)
                row, block, best = row[~done], block[~done], best[~done]
                if not len(row):
                    break
            at = block * BLOCK + blocks[row, block].argmin(1)
            gone = after[row, at]
            new = after[row, gone]
            ids[row, at], ids[row, gone], ranks[row, gone], after[row, at] = best, -1, NONE, new
            inner = np.flatnonzero(new < width)
            right = np.full(len(row), -1, np.int32)
            right[inner] = ids[row[inner], new[inner]]
            before[row[inner], new[inner]] = at[inner]
            ranks[row, at] = self.pairs.find(best, right)
            left = before[row, at]
            inner = np.flatnonzero(left >= 0)
            ranks[row[inner], left[inner]] = self.pairs.find(ids[row[inner], left[inner]], best[inner])
            for place in (at, gone, np.maximum(left, 0)):
                least[row, place // BLOCK] = blocks[row, place // BLOCK].min(1)
        ids, kept = ids[row], ids[row] >= 0
        counts = kept.sum(1)
        width = max(BLOCK, -(-int(counts.max(initial=0)) // BLOCK) * BLOCK)
        packed = np.full((len(row), width), -1, np.int32)
        packed[np.arange(width) < counts[:, None]] = ids[kept]
        return packed, chosen[row]

    def decode(self, ids: bytes) -> bytes:
        """The bytes that little-endian unsigned 32-bit ids stand for."""
        got = np.frombuffer(ids, "<u4").astype(np.int64)
        lengths = self.lengths[got]
        ends = np.cumsum(lengths)
        if not len(ends) or not ends[-1]:
            return b""
        shift = np.repeat(self.starts[got] - (ends - lengths), lengths)
        return self.bytes[shift + np.arange(ends[-1])].tobytes()


_LOADED: dict[tuple[str, str], ByteBPE] = {}


def load(path: str, pattern: str) -> ByteBPE:
    """The codec of a rank file; a worker process builds it once."""
    if (path, pattern) not in _LOADED:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _LOADED[path, pattern] = ByteBPE(ranks, pattern)
    return _LOADED[path, pattern]


def encode_documents(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
    """Rows (doc_id, n_tokens, ids), in the order and number of the input rows.

    ids: little-endian unsigned 32-bit integers.  With ``decode``, ``decoded``
    has the bytes that the ids decode to.  A null text counts as empty: no ids.
    Repeated rows and ids, null ids and other columns don't matter.  A narrow
    map: no shuffle, and nothing that grows with the corpus is kept.
    """

    def make():
        codec = load(path, pattern)

        def run(part: dict[str, list]) -> dict[str, list]:
            ids = codec.encode(part["text"])
            out = {"doc_id": part["doc_id"], "n_tokens": [len(x) // 4 for x in ids], "ids": ids}
            return out | ({"decoded": [codec.decode(x) for x in ids]} if decode else {})

        return run

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens bigint, ids binary" + ", decoded binary" * decode
    return map_slices(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), make, schema)


def decode_documents(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Rows (doc_id, decoded binary) of ids as encode_documents gives them; null ids decode to no bytes."""

    def make():
        codec = load(path, pattern)
        return lambda part: {"doc_id": part["doc_id"], "decoded": [codec.decode(x or b"") for x in part["ids"]]}

    kind = df.schema[id_col].dataType.simpleString()
    return map_slices(df.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")), make, f"doc_id {kind}, decoded binary", sized_by="ids")
