"""Document fingerprints: Merkle trees over sections, paragraphs and pieces.

A text's lines are its paragraphs; a section ends behind an empty line or after
SECTION paragraphs.  A paragraph's leaves are stretches of characters that begin
at fixed places: a few short ones, then PIECE characters each, so a change does
not touch the leaves before it, in short texts too.  Each node hashes its children's hashes with a mark of its level, so
equal roots mean equal texts, and unequal children locate an edit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import blake2b, sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.llm.common import map_slices, slices, stored, to_arrow

#: Characters of a leaf, where a paragraph's first leaves begin, and the most paragraphs of a section.
PIECE, FIRST, SECTION = 32, (0, 2, 4, 8, 16, 24, 40), 16


def _node(level: bytes, children: list[bytes]) -> bytes:
    return blake2b(b"".join(children), digest_size=16, person=level).digest()


@dataclass
class Tree:
    """root: 16 bytes; sections and paragraphs: their nodes in order; leaves: the leaf hashes of each paragraph."""

    root: bytes
    sections: list[bytes] = field(default_factory=list)
    paragraphs: list[list[bytes]] = field(default_factory=list)  # of each section
    leaves: list[list[list[tuple[bytes, int]]]] = field(default_factory=list)

    def fingerprint(self) -> str:
        """The root and the first eight hex digits of each section, so that most edits are located from the string alone."""
        return self.root.hex() + ":" + ".".join(s.hex()[:8] for s in self.sections)

    def weights(self) -> dict[bytes, int]:
        """The distinct leaves with their characters."""
        return {x: n for section in self.leaves for paragraph in section for x, n in paragraph}


def tree_of(text: str | None) -> Tree:
    """The tree of a text; null is as the empty text, one empty paragraph."""
    sections: list[list[bytes]] = []
    leaves: list[list[list[tuple[bytes, int]]]] = []
    open_, open_leaves = [], []
    lines = (text or "").split("\n")
    known: dict[str, tuple[bytes, int]] = {}
    for line in lines:
        begins = [i for i in FIRST if i < len(line)] + list(range(FIRST[-1] + PIECE // 2, len(line), PIECE)) or [0]
        found = []
        for i, j in zip(begins, [*begins[1:], len(line)]):
            cut = line[i:j]
            if (leaf := known.get(cut)) is None:
                leaf = known[cut] = blake2b(cut.encode(), digest_size=8, person=b"leaf").digest(), j - i
            found.append(leaf)
        open_.append(_node(b"paragraph", [h for h, _ in found]))
        open_leaves.append(found)
        if not line or len(open_) >= SECTION:
            sections.append(open_)
            leaves.append(open_leaves)
            open_, open_leaves = [], []
    if open_:
        sections.append(open_)
        leaves.append(open_leaves)
    nodes = [_node(b"section", s) for s in sections]
    return Tree(_node(b"root", nodes), nodes, sections, leaves)


def likeness(a: Tree, b: Tree, of_a: dict[bytes, int] | None = None) -> float:
    """Twice the characters in distinct leaves that both have over those of each: 1 for equal roots, 0 without a common leaf."""
    if a.root == b.root:
        return 1.0
    x, y = of_a or a.weights(), b.weights()
    total = sum(x.values()) + sum(y.values())
    return 2 * sum(x[k] for k in x.keys() & y.keys()) / total if total else 0.0


def differences(a: Tree, b: Tree) -> list[tuple[int, int]]:
    """(section, paragraph) places where the trees' branches differ; equal branches are not entered."""
    if a.root == b.root:
        return []
    out = []
    for s in range(max(len(a.sections), len(b.sections))):
        if s < len(a.sections) and s < len(b.sections) and a.sections[s] == b.sections[s]:
            continue
        x = a.paragraphs[s] if s < len(a.paragraphs) else []
        y = b.paragraphs[s] if s < len(b.paragraphs) else []
        out += [(s, p) for p in range(max(len(x), len(y))) if p >= len(x) or p >= len(y) or x[p] != y[p]]
    return out


def edited(text: str, following: str) -> str:
    """The last half (rounded down) of the characters replaced by as many, or all, of the following text's first."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, fingerprint, sections array<string>, n_paragraphs, n_leaves) of each text; a null text is empty."""
    def make():
        def run(part: dict[str, list]) -> dict[str, list]:
            trees = [tree_of(t) for t in part["text"]]
            return {
                "doc_id": part["doc_id"], "fingerprint": [t.fingerprint() for t in trees], "sections": [[s.hex() for s in t.sections] for t in trees],
                "n_paragraphs": [sum(map(len, t.paragraphs)) for t in trees], "n_leaves": [sum(len(p) for s in t.leaves for p in s) for t in trees],
            }

        return run

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, fingerprint string, sections array<string>, n_paragraphs bigint, n_leaves bigint"
    return map_slices(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), make, schema)


RESULT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, first_change string"


def _compare(doc_id: int | None, text: str, tree: Tree, following: str, next_tree: Tree) -> tuple:
    new = edited(text, following)
    new_tree = tree_of(new)
    own = tree.weights()
    changed = differences(tree, new_tree)
    place = "" if not changed else "{}:{}".format(*changed[0])
    return (doc_id, len(text), sha256(new.encode()).hexdigest(), tree.fingerprint(), new_tree.fingerprint(), likeness(tree, new_tree, own), likeness(tree, next_tree, own), place)


def compare_with_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints each text, its edited form and the next document's text, in ascending id order.

    Columns: RESULT; first_change is section:paragraph of the first branch
    that differs, empty where none does.  Null texts are empty; null ids come
    first; rows of the same id are ordered by text.  A single document is its
    own next one; an empty table gives no rows.

    Texts are range-partitioned by id and beginning once, so that many rows of
    one id, or without an id, are split too, and compared while a partition
    streams by; each task holds two documents.  A partition's last document
    meets the first of the next one by a join of a stored side table, two rows
    for each partition, on the partitions' numbers.
    """
    schema = "part int, first boolean, text string, " + RESULT
    arrow, final = to_arrow(schema), to_arrow(RESULT)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.substring("text", 1, 64).asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        pack = lambda out: pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)
        held = None
        none = (None,) * 8
        for batch in batches:
            for piece in slices(batch, "text"):
                out = []
                for doc_id, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
                    text = text or ""
                    tree = tree_of(text)
                    if held is None:
                        out.append((part, True, text, doc_id, *none[1:]))
                    else:
                        out.append((None, None, None, *_compare(*held, text, tree)))
                    held = doc_id, text, tree
                if out:
                    yield pack(out)
        if held is not None:
            yield pack([(part, False, held[1], held[0], *none[1:])])

    result = stored(ordered.mapInArrow(run, schema), "fingerprints")
    ends = result.where(F.col("part").isNotNull())
    # numbers only, one row a partition: each one's follower, the first behind the last
    parts = ends.where("first").select("part", F.min("part").over(Window.partitionBy()).alias("least"), F.lead("part").over(Window.orderBy("part")).alias("after"))
    last = ends.where("NOT first").select("part", "doc_id", "text").join(parts, "part")
    seams = last.select("doc_id", "text", F.coalesce("after", "least").alias("next")).join(ends.where("first").select(F.col("part").alias("next"), F.col("text").alias("following")), "next")

    def close():
        def run(part: dict[str, list]) -> dict[str, list]:
            got = [_compare(i, t, tree_of(t), n, tree_of(n)) for i, t, n in zip(part["doc_id"], part["text"], part["following"])]
            return {f.name: [g[k] for g in got] for k, f in enumerate(final)}

        return run

    names = [f.name for f in final]
    return result.where(F.col("part").isNull()).select(*names).unionByName(map_slices(seams.select("doc_id", "text", "following"), close, RESULT))
