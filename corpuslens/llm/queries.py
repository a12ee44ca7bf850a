"""The queries that apply this subpackage's operators to whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm import common

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every text; digests of the ids and of the decoded bytes."""
    import public_tokenizers

    from corpuslens.llm.bpe import encode_documents

    common.bounded_batches(spark)
    coded = encode_documents(common.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decode=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judges every page's URL; built-in expressions only."""
    from corpuslens.llm.url_filter import judge

    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _op2_sql() -> str:
    from corpuslens.llm.url_filter import sql

    return sql()


ORACLE["op2_url_filter"] = _op2_sql()


@query
def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes every text's ids to token files in the shared folder and reads them back."""
    import public_tokenizers

    from corpuslens.llm import token_files

    common.bounded_batches(spark, 500)
    docs, path = common.documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json")
    out = common.shared_path(spark, "token-files")
    dictionary = token_files.train_dictionary(docs, path)
    token_files.write(docs, out, path, dictionary)
    return token_files.read(spark, out, dictionary).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op9_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores every text as lossless WebP, reads it back, and gives digests and features."""
    from corpuslens.llm.media import store_media

    common.bounded_batches(spark)
    kept = store_media(common.documents(spark, sf_dir))
    tail = F.expr("substring(payload, greatest(octet_length(payload) - 15, 1), 16)")
    return kept.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(tail).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )


@query
def op10_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints every text, its edited form and the next document's text."""
    from corpuslens.llm.merkle import compare_with_edits

    common.bounded_batches(spark, 500)
    return compare_with_edits(common.documents(spark, sf_dir))


@query
def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents on sets of four-word shingles."""
    from corpuslens.llm.minhash import near_duplicates

    common.bounded_batches(spark)
    return near_duplicates(common.documents(spark, sf_dir))


@query
def op3_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs all documents into bins without two of a source or of a duplicate cluster."""
    from corpuslens.llm.packing import pack

    return pack(common.documents(spark, sf_dir))


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trains on the labelled rows outside fold 0 and scores every document."""
    from corpuslens.llm import toxicity

    common.bounded_batches(spark)
    docs = common.documents(spark, sf_dir)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score_documents(docs, model)
    return scored.select("doc_id", (common.fold_of("doc_id") == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


@query
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trains on the rows outside fold 0 and predicts every document's language."""
    from corpuslens.llm import langid

    common.bounded_batches(spark)
    docs = common.documents(spark, sf_dir)
    found = langid.identify(docs, langid.train(docs))
    return found.select("doc_id", (common.fold_of("doc_id") == 0).alias("held_out"), "lang_pred", "score")


@query
def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finds secrets in every document: base rules, and what the network, trained outside fold 0, adds and says of each."""
    from corpuslens.llm import secret_scan

    common.bounded_batches(spark)
    docs = common.documents(spark, sf_dir)
    found = secret_scan.scan_documents(docs, secret_scan.train(docs))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.col("found").alias("spans"), "scores", "n_model", "n_confirmed", "n_read")
