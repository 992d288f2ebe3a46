"""From raw documents to packed training sequences, stage by stage."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capfolio.llm.common import documents, ranked, scratch_folder, stored
from capfolio.llm.language_id import fit_languages, identify
from capfolio.llm.line_dedup import drop_lines, keep_bitmaps
from capfolio.llm.mixing import mix_sources
from capfolio.llm.near_dedup import near_duplicates
from capfolio.llm.packing import pack_exact, token_pieces

LEAST_SCORE = 0.3
ENOUGH_GRAMS = 40
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def with_copy_number(frame: DataFrame, keys: list[str]) -> DataFrame:
    """``frame`` with ``copy``: 0, 1, ... for rows that agree in ``keys``, however many there are."""
    spread = frame.withColumn("_spread", F.monotonically_increasing_id())
    return ranked(spread, keys, ["_spread"], "copy").drop("_spread")


def recounted(docs: DataFrame) -> DataFrame:
    """The columns of documents, ``n_chars`` after the text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language. Rejected are texts without a letter, and texts with ``ENOUGH_GRAMS`` letter
    n-grams or more of which less than ``LEAST_SCORE`` belong to one language: no language at all, such as keys."""
    model = fit_languages(docs)
    judged = identify(docs, model, keep=())
    refused = judged.where((F.col("lang_pred") == "und") | ((F.col("score") < LEAST_SCORE) & (F.col("n_grams") >= ENOUGH_GRAMS))).select("text_hash").distinct()
    marked = docs.select(*COLUMNS, F.coalesce(F.xxhash64("text"), F.lit(0)).alias("_hash"))
    return marked.join(refused, F.col("_hash") == F.col("text_hash"), "left_anti").select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten documents or more have. A NULL text becomes an empty one; repeated rows, ids and other
    columns stay as they are, and a document that loses all its lines stays as an empty one."""
    return recounted(drop_lines(docs.select(*COLUMNS), keep_bitmaps(docs)))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the least id. Rows that share an id are one document, of which
    the row with the greatest text stays (then language, source and length). Rows without an id stay, as do blank texts."""
    stays = near_duplicates(docs).where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_id")).distinct()
    own = docs.select(*COLUMNS)
    kept = own.join(stays, F.col("doc_id") == F.col("_id"), "left_semi")
    kept = kept.groupBy("doc_id").agg(F.max(F.struct(*COLUMNS[1:])).alias("row")).select("doc_id", "row.*")
    return kept.union(own.where("doc_id IS NULL"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. Rows that agree in id, text and source are documents each; which of them is taken
    more often makes no difference. A NULL or blank text has no words and is not taken; a NULL source is one more source."""
    keys = ["k1", "k2", "k3"]
    mixed = mix_sources(docs).select(
        F.xxhash64("doc_id").alias("k1"), F.col("text_hash").alias("k2"), F.xxhash64("source").alias("k3"), "copies"
    )
    own = docs.select(*COLUMNS, F.xxhash64("doc_id").alias("k1"), F.xxhash64("text").alias("k2"), F.xxhash64("source").alias("k3"))
    mixed = stored(mixed)
    times = mixed.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.sum("copies").alias("copies"))
    single = own.join(times.where("rows = 1 AND copies > 0"), keys).select(*COLUMNS, "copies")
    several = times.where("rows > 1 AND copies > 0").select(*keys)
    repeated = with_copy_number(own.join(several, keys, "left_semi"), keys)
    taken = with_copy_number(mixed.join(several, keys, "left_semi"), keys).where("copies > 0")
    found = single.union(repeated.join(taken, [*keys, "copy"]).select(*COLUMNS, "copies"))
    return found.select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in the training sequences. A NULL or blank text is the end id alone; repeated rows are
    packed as often as they occur, rows without an id like any other."""
    pieces = token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), limit=4096, end_id=1)
    return pack_exact(pieces, limit=4096)


#: (name, function) in order; each function takes (spark, docs, folder of the input tables).
STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near),
    ("mixing", mix),
    ("packing", pack),
]

#: Language scores, signatures, random rounding and packing have no SQL form; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each result written as Parquet and read again."""
    folder = f"{scratch_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = documents(spark, sf_dir)
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
