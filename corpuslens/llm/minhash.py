"""Near-duplicate documents by fast similarity sketches, banding and exact verification.

Sketch: a set's elements are hashed into COORDINATES bins, round by round, until
every bin is filled; a bin keeps the least hash of the first round that reached
it.  As many further rounds put all elements into one bin each, so every
coordinate fills, however small the set.  Coordinates of two sets agree with the
probability of their similarity, with the concentration of independent samples.

Documents with equal sets form a class.  Classes that agree in a band are
compared with the bucket's least class first; where that leaves a bucket in
several components, its other members are compared with each other in blocks.
Every link is confirmed on the full sets.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import map_slices, slices, stored, to_arrow
from corpuslens.llm.graph import components

#: A pair of similarity 0.8 misses all bands with a probability of (1 - 0.8**6)**40, 5e-6.
BANDS, ROWS = 40, 6
COORDINATES = BANDS * ROWS
#: Ids of candidate classes that are broadcast at most, 8 bytes each; beyond it they are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Members of a bucket's block, and bytes of their sets.
BLOCK, BLOCK_BYTES = 256, 32 << 20
NONE = np.uint64(2**64 - 1)
PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x94D049BB133111EB, 0xBF58476D1CE4E5B9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective hash of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


SEEDS = mixed(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64) * PLACES[0])


def shingles(text: str | None, width: int = 4) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles; A-Z count as a-z, and ASCII white space divides words.

    Fewer than ``width`` words are one shingle; no text or no word is the empty set.
    """
    words = text.encode().lower().split() if text else []
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    if n < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), n)], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    total = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        total += mixed(h[k : n - width + 1 + k] * PLACES[k])
    return np.unique(mixed(total))


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """A row of COORDINATES numbers for each set; an empty set's are all NONE."""
    out = np.full((len(sets), COORDINATES), NONE)
    flat = out.ravel()
    active = [i for i, s in enumerate(sets) if len(s)]
    values = base = starts = None
    for round_, seed in enumerate(SEEDS):
        if not active:
            break
        if values is None:
            sizes = np.array([len(sets[i]) for i in active])
            values, base = np.concatenate([sets[i] for i in active]), np.repeat(np.array(active) * COORDINATES, sizes)
            starts = np.cumsum(sizes) - sizes
        h = mixed(values ^ seed)
        key = np.uint64(round_ << 32) | h & np.uint64(0xFFFFFFFF)
        if round_ < COORDINATES:
            np.minimum.at(flat, base + ((h >> np.uint64(32)) * np.uint64(COORDINATES) >> np.uint64(32)).astype(np.int64), key)
        else:
            at = np.array(active) * COORDINATES + round_ - COORDINATES
            flat[at] = np.minimum(flat[at], np.minimum.reduceat(key, starts))
        left = [i for i in active if (out[i] == NONE).any()]
        if len(left) < len(active):
            active, values = left, None
    return out


def bands(sketch: np.ndarray) -> np.ndarray:
    """A row of BANDS signed hashes for each sketch."""
    rows = sketch.reshape(-1, BANDS, ROWS)
    h = np.broadcast_to(SEEDS[:BANDS], rows.shape[:2])
    for k in range(ROWS):
        h = mixed(h ^ rows[:, :, k])
    return h.view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 times the common elements is at least ``percent`` times all; both are sorted and distinct."""
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


def sketched(df: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """Rows (doc_id, n_shingles, digest, bands); the digest is null for empty sets."""

    def make():
        def run(part: dict[str, list]) -> dict[str, list]:
            sets = [shingles(t, width) for t in part["text"]]
            rows = bands(sketches(sets))
            full = [len(s) > 0 for s in sets]
            return {"doc_id": part["doc_id"], "n_shingles": list(map(len, sets)), "digest": [xxhash.xxh3_128_digest(s.tobytes()) if f else None for s, f in zip(sets, full)], "bands": [r if f else None for r, f in zip(rows, full)]}

        return run

    return map_slices(_texts(df, id_col, text_col), make, "doc_id bigint, n_shingles bigint, digest binary, bands array<bigint>")


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def _sets(df: DataFrame, id_col: str, text_col: str, wanted: DataFrame, width: int) -> DataFrame:
    """Stored rows (node, items) of the wanted nodes (rows (doc_id)): the full sets as bytes."""
    n = wanted.count()
    wanted = F.broadcast(wanted) if n <= BROADCAST_IDS else wanted
    chosen = _texts(df, id_col, text_col).join(wanted, "doc_id", "left_semi")

    def make():
        return lambda part: {"node": part["doc_id"], "items": [shingles(t, width).tobytes() for t in part["text"]]}

    return stored(map_slices(chosen, make, "node bigint, items binary"), "sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose sets are similar; a node with several sets counts by any of them."""
    arrow = to_arrow("u bigint, v bigint")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "right"):
                u, v, left, right = (part.column(part.schema.get_field_index(n)) for n in ("u", "v", "left", "right"))
                keep = [similar(np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64), percent) for a, b in zip(left, right)]
                yield pa.RecordBatch.from_arrays([pa.compute.filter(c, pa.array(keep)) for c in (u, v)], schema=arrow)

    side = lambda node, items: sets.select(F.col("node").alias(node), F.col("items").alias(items))
    return pairs.join(side("v", "right"), "v").join(side("u", "left"), "u").select("u", "v", "left", "right").mapInArrow(check, "u bigint, v bigint").distinct()


def _open_buckets(placed: DataFrame) -> DataFrame:
    """Buckets whose members, beside the least, lie in several components; of buckets with the same members, one.

    placed: (bucket, node, size, root).  Rows (bucket, main, chunks, blocks):
    the largest component, and into how many parts the members outside it, and
    all members, are cut, so that a part has about BLOCK members of about
    BLOCK_BYTES at most.
    """
    shares = placed.groupBy("bucket", "root").agg(F.count("*").alias("m"), F.sum("size").alias("s"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("x"))
    sums = shares.groupBy("bucket").agg(F.sum("m").alias("n"), F.sum("s").alias("bytes"), F.sum("x").alias("x"), F.max(F.struct("m", "root", "s")).alias("most"), F.min("root").alias("a"), F.max("root").alias("b")).where("a < b")
    parts = lambda n, size: F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_BYTES)).cast("int")
    one = sums.groupBy("n", "x", "most", "bytes").agg(F.min("bucket").alias("bucket"))
    return one.select("bucket", F.col("most.root").alias("main"), parts(F.col("n") - F.col("most.m"), F.col("bytes") - F.col("most.s")).alias("chunks"), parts(F.col("n"), F.col("bytes")).alias("blocks"))


def _blocks(placed: DataFrame, open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) among the members of each open bucket that lie in different components.

    Members outside the largest component, in chunks, are compared with blocks
    of all members; so a group has one chunk and one block.  A pair that several
    buckets hold is compared in the least of them.  It gives a forest of links,
    never more than its members.
    """
    place = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    seat = lambda i, j, left: F.struct(i.alias("i"), j.alias("j"), F.lit(left).alias("asks"))
    asks = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: seat(place(F.col("chunks")), j, True))
    answers = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda i: seat(i, place(F.col("blocks")), False))
    there = placed.join(open_, "bucket")
    own = there.groupBy("node").agg(F.sort_array(F.collect_set("bucket")).alias("buckets"))  # no more than BANDS
    dealt = there.select("bucket", "node", "root", F.explode(F.when(F.col("root") == F.col("main"), answers).otherwise(F.concat(answers, asks))).alias("x"))
    full = dealt.select("bucket", "node", "root", "x.i", "x.j", "x.asks").join(sets.join(own, "node"), "node")

    def link(group: pd.DataFrame) -> pd.DataFrame:
        over: dict[int, int] = {}
        bucket = int(group["bucket"].iloc[0])

        def top(r: int) -> int:
            while r in over:
                r = over[r]
            return r

        def side(rows: pd.DataFrame) -> list[tuple]:
            items = [np.frombuffer(x, np.uint64) for x in rows["items"]]
            others = [frozenset(b for b in x.tolist() if b < bucket) for x in rows["buckets"]]
            return sorted(zip(rows["node"].tolist(), rows["root"].tolist(), items, others), key=lambda r: (len(r[2]), r[0]))

        answer = side(group[~group["asks"]])
        sizes, found = [len(r[2]) for r in answer], []
        for u, ru, a, of_u in side(group[group["asks"]]):
            first, last = bisect.bisect_left(sizes, -(-percent * len(a) // 100)), bisect.bisect_right(sizes, 100 * len(a) // percent)
            for v, rv, b, of_v in answer[first:last]:
                p, q = top(ru), top(rv)
                if p != q and of_u.isdisjoint(of_v) and similar(a, b, percent):
                    found.append((u, v))
                    over[max(p, q)] = min(p, q)
        return pd.DataFrame(found, columns=["u", "v"]).astype("int64")

    return full.groupBy("bucket", "i", "j").applyInPandas(link, "u bigint, v bigint")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, percent: int = 80) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept), one for each input row.

    Documents are linked if their sets of distinct word shingles have a
    similarity of ``percent`` or more; component_id is the least id that a
    chain of links reaches, kept marks the document of that id.  Null or
    wordless texts have the empty set and are linked with nothing.  Rows of the
    same id are one document.  A row without an id is no document: it takes the
    component of an equal set, if there is one, else null, and isn't kept.
    Other columns are not looked at; an empty table gives no rows.

    Gathers nothing on the driver but counts.  Intermediate tables are stored
    in the shared folder.
    """
    all_ = stored(sketched(df, id_col, text_col, width), "sketches")
    light = all_.select("doc_id", "digest").where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    classes = light.groupBy("digest").agg(F.min("doc_id").alias("node"))
    classes = stored(classes, "classes")
    one = all_.where(F.col("digest").isNotNull()).join(classes, "digest")
    # ids of several texts tie their classes together
    ties = one.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("node").alias("v"), F.max("node").alias("u")).where("u > v").select("u", "v")
    heads = one.where("doc_id = node").select("node", (8 * F.col("n_shingles")).alias("size"), F.explode("bands").alias("bucket"))
    heads = stored(heads, "heads")
    shared = heads.groupBy("bucket").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most")
    members = stored(heads.join(shared.select("bucket", "least"), "bucket"), "members")
    pairs = stored(members.where("node <> least").select(F.col("node").alias("u"), F.col("least").alias("v")).distinct(), "pairs")
    wanted = stored(pairs.select(F.col("u").alias("doc_id")).union(pairs.select("v")).distinct(), "wanted")
    sets = _sets(df, id_col, text_col, wanted, width)
    links = stored(_confirmed(pairs, sets, percent).unionByName(ties), "links")
    roots = stored(components(links), "roots")
    # buckets whose members beside the least lie in several components
    placed = members.where("node <> least").join(roots, "node", "left").select("bucket", "node", "size", F.coalesce("root", "node").alias("root"))
    placed = stored(placed, "placed")
    open_ = stored(_open_buckets(placed), "open")
    if not open_.isEmpty():
        links = links.unionByName(stored(_blocks(placed, open_, sets, percent), "more"))
        roots = stored(components(links), "roots")
    named = classes.join(roots, "node", "left").select("digest", F.coalesce("root", "node").alias("component_id"))
    out = all_.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))
