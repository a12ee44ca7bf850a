"""The corpus pipeline: documents in, packed bins out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages
rows are written as Parquet in the shared folder and read again.  All stages but
the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm import common, langid, minhash, packing, secret_scan, toxicity

#: A document goes if its toxicity is at least this.
TOXIC = 0.5


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier, trained on these documents and their labels, finds toxic.

    Null and empty texts aren't toxic; null ids are scored as others, and no
    label is theirs; repeated rows are judged alike; other columns stay.
    """
    common.bounded_batches(spark)
    return toxicity.keep_clean(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), TOXIC)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, null texts among them, and those whose language is hardly likelier than chance.

    Without a language to learn, all texts go.  Other columns stay.
    """
    common.bounded_batches(spark)
    return langid.keep_identified(docs, langid.train(docs))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row of the least id of each group of near copies (five words, 0.8).

    Rows without an id come last in their group, and equal ids are rows of
    their own.  Texts without a word are near nothing: all of their rows stay.
    """
    common.bounded_batches(spark)
    names = docs.columns
    at = {name: f"c{names.index(name)}" for name in ("doc_id", "text")}
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    rows = common.stored(plain.withColumn("row", F.monotonically_increasing_id()), "rows")  # stored, so that numbers stay
    groups = common.stored(minhash.near_duplicates(rows, id_col="row", text_col=at["text"], width=5, percent=80).select(F.col("doc_id").alias("row"), "component_id"), "groups")
    ids = rows.select("row", F.col(at["doc_id"]).cast("long").alias("id"))
    least = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "row"))
    kept = groups.join(ids, "row").groupBy("component_id").agg(least.alias("least")).select("least.row")
    copies = common.stored(groups.select("row").join(kept, "row", "left_anti"), "copies")
    n = copies.count()
    return rows.join(F.broadcast(copies) if n <= minhash.BROADCAST_IDS else copies, "row", "left_anti").drop("row").toDF(*names)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in the texts; n_chars, where there is one, follows.  Null texts stay null; other columns stay."""
    common.bounded_batches(spark)
    masked = secret_scan.mask_column(docs, secret_scan.train(docs))
    if "n_chars" not in docs.columns:
        return masked
    kind = docs.schema["n_chars"].dataType
    return masked.withColumn("n_chars", F.length("text").cast(kind)).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into bins, without two of a source or of equal texts; null texts take no room."""
    return packing.pack(docs)


STAGES = [("toxicity", toxicity_stage), ("language ID", language_stage), ("MinHash near-dedup", near_duplicate_stage), ("secret scans", secret_stage), ("best-fit packing", packing_stage)]
#: Trained models and sketches are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are stored before the next one begins."""
    docs = common.documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.stored(docs, f"stage{k}")
    return docs
