"""Media columns: payloads kept as lossless WebP images, read back as pixel arrays with features."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm import webp
from corpuslens.llm.common import map_slices


def payload_of(text: str | None) -> bytes:
    """The text as UTF-8, filled with blanks up to a positive multiple of a row of samples."""
    data = (text or "").encode()
    return data + b" " * (-len(data) % webp.ROW_BYTES if data else webp.ROW_BYTES)


def features(samples: np.ndarray) -> str:
    """Of 8-bit samples (rows, width, 3): channel means, entropy in bits, and a 64-bit hash of a brightness grid."""
    flat = samples.reshape(-1)
    share = np.bincount(flat, minlength=256) / len(flat)
    share = share[share > 0]
    entropy = max(0.0, float(-(share * np.log2(share)).sum()))
    means = samples.reshape(-1, 3).mean(0)
    bright = samples.reshape(-1).astype(np.float64)
    edges = np.arange(65) * len(bright) // 64  # 64 stretches of at least three samples
    grid = np.add.reduceat(bright, edges[:-1]) / np.diff(edges)
    bits = np.packbits(grid > grid.mean()).tobytes().hex()
    return f"mean={means[0]:.3f}/{means[1]:.3f}/{means[2]:.3f};entropy={entropy:.4f};hash={bits}"


def store_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", read_back: bool = True) -> DataFrame:
    """Rows (doc_id, n_bytes, media[, payload, height, feature]), in the order and number of the input rows.

    media: the WebP files that hold the text's padded UTF-8 bytes as RGB
    samples.  With ``read_back``, payload is the decoded samples, and height
    and feature describe them.  A null text is empty: one row of blanks.  The
    values depend on the text alone, so repeated rows get equal ones.  A narrow
    map: no shuffle.
    """

    def make():
        def run(part: dict[str, list]) -> dict[str, list]:
            known: dict[str, tuple] = {}
            rows = []
            for text in part["text"]:
                key = text or ""
                if key not in known:
                    payload = payload_of(key)
                    media = webp.store(payload)
                    row = [len(key.encode()), media]
                    if read_back:
                        samples = webp.load(media)
                        row += [samples.tobytes(), len(samples), features(samples)]
                    known[key] = tuple(row)
                rows.append(known[key])
            names = ("n_bytes", "media", "payload", "height", "feature")
            return {"doc_id": part["doc_id"]} | {name: [r[i] for r in rows] for i, name in enumerate(names[: 5 if read_back else 2])}

        return run

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes bigint, media binary" + ", payload binary, height int, feature string" * read_back
    return map_slices(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), make, schema)


def load_media(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Rows (doc_id, width, height, pixels) of lossless WebP files: R, G, B, A samples, row by row.

    A null or empty file has null width, height and pixels; a file that isn't
    lossless WebP raises ValueError.
    """

    def make():
        def run(part: dict[str, list]) -> dict[str, list]:
            images = [webp.decode(m) if m else None for m in part["media"]]
            shape = lambda k: [None if x is None else x.shape[k] for x in images]
            return {"doc_id": part["doc_id"], "width": shape(1), "height": shape(0), "pixels": [None if x is None else x.tobytes() for x in images]}

        return run

    kind = df.schema[id_col].dataType.simpleString()
    return map_slices(df.select(F.col(id_col).alias("doc_id"), F.col(media_col).alias("media")), make, f"doc_id {kind}, width int, height int, pixels binary", sized_by="media")
