"""Token ids in compressed files with short-document access.

Each document's ids are serialized little-endian and compressed on their own
with a zstandard dictionary that all files share; the dictionary is trained on
serialized id arrays.  A file holds a header with the dictionary's hash, an
index with one entry for each document, and the compressed frames, so one
document is read by one index entry and one frame.

Files are rows of a Parquet data set that Spark commits: they reach any store
that Spark reaches, and a lost executor or a repeated task leaves no half file.
"""

from __future__ import annotations

import hashlib

import re
import struct

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm.common import map_slices, sampled, slices, stored, to_arrow

MAGIC = b"CLTK\x01"
HEADER = struct.Struct("<5sB32sIQ")  # magic, bytes of an id, dictionary hash, documents, first id's global position in the partition
ENTRY = np.dtype([("doc_id", "<i8"), ("null_id", "u1"), ("offset", "<u8"), ("size", "<u4"), ("n_tokens", "<u8")])
#: A file ends after so many bytes of frames or so many documents.
FILE_BYTES, FILE_DOCS = 4 << 20, 4096
#: Texts, bytes of dictionary and zstandard level for the shared dictionary; the sample is bounded, whatever the corpus.
SAMPLE_DOCS, DICT_BYTES, LEVEL = 1000, 64 << 10, 3
#: The sample's serialized ids are cut into pieces of so many bytes, of which so many train the dictionary.
PIECE_BYTES, PIECES = 8 << 10, 2000
#: Word forms whose ids a worker remembers.
CACHE = 800_000


class WordEncoder:
    """Encodes by a tokenizers file, each run between blanks or line ends once.

    Valid for tokenizers that drop white space before they merge and whose
    normal form doesn't reach across it; probes check that, and otherwise
    whole texts are encoded.  Commas and stops behind a Latin letter or a
    digit, before a blank, are runs of their own, unless the text has one behind
    another sign.
    New words of letters are encoded many at a time, one on a line, and told
    apart by the mark at a word's last id; where the marks don't match the
    lines, one at a time.  Words of Latin letters have nothing to normalise but
    case, so they go to the same model behind a plain split at line ends.
    """

    _STUCK = re.compile(r"[.,](?<=[^A-Za-z0-9À-ÖØ-öø-ÿ ].)(?: |$)")
    _LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False, use_regex=False)])
        self.words: dict[str, bytes] = {}
        self.used: set[str] = set()
        names = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(names.values()) + 1, bool)
        self.ends[[i for name, i in names.items() if name.endswith("</w>")]] = True
        probes = ["It's a  test.\nÀ l'été, 12,5 %", "ab cd\n\nef.", "ΟΔΟΣ σ́ x, y", "3. 4.\n5"]
        self.by_word = bool(self.ends.any()) and all(self._each([p])[0] == b"".join(self._each(self._cut(p))) for p in probes)
        latin = [chr(c) for c in range(192, 256) if chr(c).isalpha()] + ["Straße", "ÉTÉ", "naïve", "The", "thening", "ÿØ"]
        self.folds = self._of_letters([w.lower() for w in latin], self.plain) == self._each(latin)

    @classmethod
    def _cut(cls, text: str) -> list[str]:
        text = text.replace("\n", " ")
        if not cls._STUCK.search(text):
            text = text.replace(", ", " , ").replace(". ", " . ")
            if text[-1:] == ".":
                text = text[:-1] + " ."
        return text.split(" ")

    def _each(self, texts: list[str], tokenizer=None) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in (tokenizer or self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)]

    def _of_letters(self, words: list[str], tokenizer=None) -> list[bytes]:
        out: list[bytes] = []
        groups = [words[at : at + 500] for at in range(0, len(words), 500)]
        for some, flat in zip(groups, self._each(["\n".join(g) for g in groups], tokenizer)):
            ends = np.flatnonzero(self.ends[np.frombuffer(flat, "<u4")]) + 1
            if len(ends) == len(some) and 4 * ends[-1] == len(flat):
                cuts = (ends * 4).tolist()
                out += [flat[a:b] for a, b in zip([0, *cuts], cuts)]
            else:
                out += self._each(some)
        return out

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers; null is empty."""
        if not self.by_word:
            return self._each([t or "" for t in texts])
        cut = [self._cut(t or "") for t in texts]
        words = set().union(*cut)
        new = words.difference(self.words)
        if len(self.words) + len(new) > CACHE:  # what was used again since the last time stays
            self.words = {w: self.words[w] for w in self.used} if len(self.used) + len(words) <= CACHE else {}
            self.used.clear()
            new = words.difference(self.words)
        else:
            self.used |= words - new
        latin = list(filter(self._LATIN.fullmatch, new)) if self.folds else []
        self.words.update(zip(latin, self._of_letters([w.lower() for w in latin], self.plain)))
        new = new.difference(latin)
        letters = [w for w in new if w.isalpha()]
        self.words.update(zip(letters, self._of_letters(letters)))
        others = [w for w in new if not w.isalpha()]
        self.words.update(zip(others, self._each(others)))
        ids = self.words.__getitem__
        return [b"".join(map(ids, c)) for c in cut]


_LOADED: dict[str, WordEncoder] = {}


def load_encoder(path: str) -> WordEncoder:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
    if path not in _LOADED:
        _LOADED[path] = WordEncoder(path)
    return _LOADED[path]


def narrow(ids: bytes) -> tuple[bytes, int]:
    """The ids in two bytes each if all fit, else in four; and the bytes of an id."""
    got = np.frombuffer(ids, "<u4")
    return (got.astype("<u2").tobytes(), 2) if not len(got) or got.max() < 65536 else (ids, 4)


def train_dictionary(df: DataFrame, path: str, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text", docs: int = SAMPLE_DOCS, size: int = DICT_BYTES) -> bytes:
    """A zstandard dictionary from the serialized ids of at most ``docs`` texts, chosen by a hash of the id.

    Their ids are cut into pieces, of which at most PIECES reach the driver.
    Empty bytes where the sample is too small or too uniform to train on.
    """
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def make():
        def run(part: dict[str, list]) -> dict[str, list]:
            got = [(i or 0, at, ids[at : at + PIECE_BYTES]) for i, x in zip(part["doc_id"], part["ids"]) for ids in [narrow(x)[0]] for at in range(0, len(ids), PIECE_BYTES)]
            return {"piece": [f"{i}:{at}" for i, at, _ in got], "held": [x for _, _, x in got]}

        return run

    coded = encode(sampled(rows, "doc_id", docs, "dictionary"), path, end_id)
    pieces = stored(map_slices(coded, make, "piece string, held binary", sized_by="ids"), "pieces")
    samples = sorted(bytes(r.held) for r in sampled(pieces, "piece", PIECES, "dictionary").collect())
    try:
        return zstandard.train_dictionary(size, samples).as_bytes() if len(samples) >= 16 else b""
    except zstandard.ZstdError:
        return b""


def encode(df: DataFrame, path: str, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, ids): little-endian unsigned 32-bit ids with the end id; a null text has only that."""
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def make():
        encoder = load_encoder(path)
        return lambda part: {"doc_id": part["doc_id"], "ids": [x + end for x in encoder.encode(part["text"])]}

    return map_slices(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), make, "doc_id bigint, ids binary")


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_content_size=True, write_dict_id=False)


def write(df: DataFrame, out: str, path: str, dictionary: bytes, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes all texts and writes files in ascending id order under ``out``.

    Null ids come first; rows of the same id are ordered by text.  Texts are
    range-partitioned by id, sorted within their partitions, and encoded and
    compressed there, once.  Rows of
    ``out``: part and file (their order), first_start (ids before the file in
    its part), n_docs, n_tokens, blob (the file).
    """
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    digest = hashlib.sha256(dictionary).digest()
    schema = "part int, file int, first_start bigint, n_docs bigint, n_tokens bigint, blob binary"
    arrow = to_arrow(schema)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, press = load_encoder(path), compressor(dictionary).compress
        part, file, start = TaskContext.get().partitionId(), 0, 0
        held: list[tuple] = []
        size = 0

        def row() -> pa.RecordBatch:
            nonlocal file, start, held, size
            n = sum(h[1] for h in held)
            blob = build(held, digest, start)
            out = pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((part, file, start, len(held), n, blob), arrow)], schema=arrow)
            file, start, held, size = file + 1, start + n, [], 0
            return out

        for batch in batches:
            for piece in slices(batch, "text"):
                for doc_id, ids in zip(piece.column(0).to_pylist(), encoder.encode(piece.column(1).to_pylist())):
                    packed, width = narrow(ids + end)
                    frame = press(packed)
                    # a file has ids of one width
                    if held and (size + len(frame) > FILE_BYTES or len(held) >= FILE_DOCS or held[0][2] != width):
                        yield row()
                    held.append((doc_id, len(packed) // width, width, frame))
                    size += len(frame)
        if held:
            yield row()

    # texts are ordered before they are encoded: the sampling of the range partitioning then reads, but doesn't encode
    # by the text's beginning, too, so that many rows of one id, or without an id, are split
    ordered = texts.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.substring("text", 1, 64).asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    ordered.mapInArrow(pack, schema).write.option("compression", "none").parquet(out)


def build(docs: list[tuple], digest: bytes, start: int) -> bytes:
    """A file: header, index, frames.  docs: (doc_id, n_tokens, width, frame)."""
    index = np.zeros(len(docs), ENTRY)
    sizes = np.fromiter((len(d[3]) for d in docs), np.int64, len(docs))
    index["doc_id"], index["null_id"] = [d[0] or 0 for d in docs], [d[0] is None for d in docs]
    index["offset"], index["size"], index["n_tokens"] = np.cumsum(sizes) - sizes, sizes, [d[1] for d in docs]
    return HEADER.pack(MAGIC, docs[0][2], digest, len(docs), start) + index.tobytes() + b"".join(d[3] for d in docs)


class TokenFile:
    """Reads one file; ``ids(k)`` touches one index entry and one frame."""

    def __init__(self, blob: bytes, dictionary: bytes, press: zstandard.ZstdDecompressor | None = None):
        magic, self.width, digest, n, self.start = HEADER.unpack_from(blob)
        if magic != MAGIC:
            raise ValueError("not a token file")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError("the file was written with another dictionary")
        self.index = np.frombuffer(blob, ENTRY, n, HEADER.size)
        self.body, self.blob = HEADER.size + n * ENTRY.itemsize, memoryview(blob)
        self.press = press or decompressor(dictionary)

    def __len__(self) -> int:
        return len(self.index)

    def ids(self, k: int) -> np.ndarray:
        e = self.index[k]
        at = self.body + int(e["offset"])
        return np.frombuffer(self.press.decompress(self.blob[at : at + int(e["size"])]), f"<u{self.width}").astype("<u4")


def decompressor(dictionary: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def read(spark: SparkSession, out: str, dictionary: bytes) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids) of all documents in the files of ``out``.

    start: ids of all documents before it, over all files.  The ids of each
    part are summed first, one row for each part, whose number is that of the
    writer's partitions.
    """
    files = spark.read.schema("part int, file int, first_start bigint, n_docs bigint, n_tokens bigint, blob binary").parquet(out)
    totals = sorted((r.part, r.n) for r in files.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    before, at = {}, 0
    for part, n in totals:
        before[part] = at
        at += n
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids binary"
    arrow = to_arrow(schema)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = decompressor(dictionary)
        for batch in batches:
            for k in range(batch.num_rows):
                file = TokenFile(batch.column(1)[k].as_py(), dictionary, press)
                counts = file.index["n_tokens"].astype(np.int64)
                starts = before[batch.column(0)[k].as_py()] + file.start + np.cumsum(counts) - counts
                for at in range(0, len(file), 256):
                    these = range(at, min(at + 256, len(file)))
                    ids = [file.ids(i) for i in these]
                    doc_ids = pa.array(file.index["doc_id"][at : at + 256].astype(np.int64), pa.int64(), mask=file.index["null_id"][at : at + 256].astype(bool))
                    yield pa.RecordBatch.from_arrays([doc_ids, pa.array(starts[at : at + 256]), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())], schema=arrow)

    return files.select("part", "blob").mapInArrow(unpack, schema)
