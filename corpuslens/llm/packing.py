"""Conflict-constrained best-fit packing of documents into bins of fixed capacity.

Pieces are packed in order of decreasing size.  Open bins are ordered by what
they have left; each carries a bitmap of its sources and one of its duplicate
clusters.  For a piece the search begins at the least residual that holds it
and goes on to the successors until it finds a bin without a common bit, which
is the tightest compatible one; if there is none, a bin is opened.

Pieces are dealt to shards by a hash, so a hot source or cluster is spread
evenly; each shard is packed on its own, in one task, and has about
SHARD_PIECES pieces, whatever the corpus.
"""

from __future__ import annotations

import bisect
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import stored

#: Units (words and signs, by default) that a bin holds.
CAPACITY = 1024
SHARD_PIECES = 4096
#: A run of letters, marks or digits, or a single other sign.
UNIT = r"[\p{L}\p{M}]+|\p{N}+|[^\s\p{L}\p{M}\p{N}]"


class Shard:
    """Packs one shard's pieces."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.residuals: list[int] = []  # those that some open bin has, ascending
        self.at: dict[int, list[int]] = defaultdict(list)
        self.left: list[int] = []
        self.sources: list[int] = []
        self.clusters: list[int] = []

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, offset) of a piece; source and cluster are bitmaps."""
        k = bisect.bisect_left(self.residuals, size)
        while k < len(self.residuals):
            bins = self.at[self.residuals[k]]
            for i, b in enumerate(bins):
                if not (self.sources[b] & source or self.clusters[b] & cluster):
                    del bins[i]
                    if not bins:
                        del self.at[self.residuals[k]], self.residuals[k]
                    return self._fill(b, size, source, cluster)
            k += 1
        self.left.append(self.capacity)
        self.sources.append(0)
        self.clusters.append(0)
        return self._fill(len(self.left) - 1, size, source, cluster)

    def _fill(self, b: int, size: int, source: int, cluster: int) -> tuple[int, int]:
        offset = self.capacity - self.left[b]
        self.left[b] -= size
        self.sources[b] |= source
        self.clusters[b] |= cluster
        r = self.left[b]
        if r > 0:
            if not self.at[r]:
                bisect.insort(self.residuals, r)
            self.at[r].append(b)
        return b, offset


def pack_shard(pieces: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Bins and offsets of a shard's pieces: columns doc_id, piece, n_units, source, cluster, row, nth."""
    ordered = pieces.sort_values(["n_units", "row", "piece", "nth"], ascending=[False, True, True, True], kind="stable")
    bit = lambda values: [0 if pd.isna(v) else 1 << k for v, k in zip(values, pd.factorize(values)[0].tolist())]  # noqa: E731  a null conflicts with nothing
    shard = Shard(capacity)
    placed = [shard.place(n, s, c) for n, s, c in zip(ordered["n_units"].tolist(), bit(ordered["source"]), bit(ordered["cluster"]))]
    return ordered.assign(bin=[b for b, _ in placed], bin_offset=[o for _, o in placed])


def units(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(UNIT)), F.lit(0))


def cluster_of(text: Column) -> Column:
    """The cluster of texts that are equal but for case and white space; null for texts without a letter or sign."""
    bare = F.regexp_replace(F.lower(text), r"\s+", " ")
    return F.when(F.trim(bare) != "", F.sha2(F.trim(bare), 256))


def pack(df: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size: Column | None = None, cluster: Column | None = None, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Rows (doc_id, piece, n_pieces, start, n_units, shard, bin, bin_offset), one for each piece of each input row.

    A document of more units than ``capacity`` is cut into full pieces and a
    rest; start counts units before the piece.  No bin holds two pieces of one
    source or of one duplicate cluster, so none holds two of one document; null
    sources and clusters conflict with nothing.  Documents without units have
    one piece of none in a bin of their own choice.  ``size`` and ``cluster``
    replace the number of units and the cluster of equal texts.  A null id is
    kept as null; repeated rows are packed as documents of their own, which
    their cluster keeps apart.

    Texts are read once: sizes and clusters are stored, and pieces counted over
    the whole table, for the number of shards.  One shuffle moves ids, sizes
    and clusters, not texts.  Equal rows are dealt to different shards by a
    number of their own, so copies of one row fill none.
    """
    text = F.col(text_col).cast("string")
    rows = df.select(
        F.col(id_col).cast("long").alias("doc_id"), F.greatest(F.lit(0), size if size is not None else units(text)).cast("long").alias("total"), F.col(source_col).cast("string").alias("source"),
        (cluster if cluster is not None else cluster_of(text)).cast("string").alias("cluster"), F.xxhash64(F.col(id_col), text, F.col(source_col)).alias("row"), F.monotonically_increasing_id().alias("nth"),
    )
    rows = stored(rows, "sizes")
    n_pieces = F.greatest(F.lit(1), F.ceil(F.col("total") / capacity)).cast("int")
    n = rows.agg(F.coalesce(F.sum(n_pieces), F.lit(0))).first()[0]
    n_shards = max(1, round(n / shard_pieces))
    cut = rows.withColumn("n_pieces", n_pieces).withColumn("piece", F.explode(F.sequence(F.lit(0), n_pieces - 1)))
    start = F.col("piece").cast("long") * capacity
    shard = F.pmod(F.xxhash64("row", "piece", "nth"), F.lit(n_shards)).cast("int")
    cut = cut.select("doc_id", "piece", "n_pieces", start.alias("start"), F.least(F.lit(capacity), F.col("total") - start).alias("n_units"), "source", "cluster", "row", "nth", shard.alias("shard"))
    names = ["doc_id", "piece", "n_pieces", "start", "n_units", "shard", "bin", "bin_offset"]

    def run(pieces: pd.DataFrame) -> pd.DataFrame:
        out = pack_shard(pieces, capacity)[names]
        return out.assign(doc_id=out["doc_id"].astype("Int64"))

    return cut.groupBy("shard").applyInPandas(run, "doc_id bigint, piece int, n_pieces int, start bigint, n_units bigint, shard int, bin int, bin_offset bigint")
