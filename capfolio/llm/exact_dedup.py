"""Exact duplicates by progressive refinement: length, then a prefix hash, then the whole text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capfolio.llm.common import BLANK_RUN, bit_set, cut, in_bit_set

SURVIVOR_BITS = 1 << 20


def normalised(text: Column) -> Column:
    """``text`` with each run of ASCII white space as one space; NULL as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANK_RUN, " ")


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    prefix_chars: int = 64,
    digest_all: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if their normalised forms are. Three rounds narrow the search. Rows whose normalised
    length no other row has are settled first; the others are grouped by length and hash of their first
    ``prefix_chars`` characters; only rows that still share a group have the whole text hashed. Each round
    is one scan with a map-side combined count. What a round found goes to the next scan as a bit set of
    fixed size, so texts are never shuffled; a set that fills up lets more rows through and changes no result.

    Results for special input: a NULL text equals an empty one. The row with the smallest id stays; NULL ids
    come last (keep_id is NULL if a group has no other). Of rows that repeat the smallest id exactly one has
    ``kept``. ``text_sha256`` is NULL for rows settled early unless ``digest_all``. Other columns of ``docs``
    are ignored. An empty table gives an empty result.
    """
    body = normalised(F.col(text_col))
    base = docs.select(F.col(id_col).alias("doc_id"), body.alias("body")).withColumn("size", F.length("body").cast("long"))
    same_size = base.groupBy("size").count().where("count > 1").select(F.col("size").alias("cell"))
    by_size = in_bit_set(F.col("size"), bit_set(same_size, SURVIVOR_BITS), SURVIVOR_BITS)

    prefix = F.xxhash64("size", F.substring("body", 1, prefix_chars))
    hashed = base.where(by_size).select("size", prefix.alias("prefix"))
    same_prefix = hashed.groupBy("size", "prefix").count().where("count > 1").select(F.col("prefix").alias("cell"))
    by_prefix = in_bit_set(prefix, bit_set(same_prefix, SURVIVOR_BITS), SURVIVOR_BITS)

    settled = base.withColumn("open", by_size & by_prefix)
    digest = F.sha2(F.col("body"), 256)
    rows = cut(
        settled.select(
            "doc_id",
            "open",
            (digest if digest_all else F.when(F.col("open"), digest)).alias("text_sha256"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    groups = (
        rows.where("open").groupBy(F.col("text_sha256").alias("digest"))
        .agg(
            F.min("doc_id").alias("first_id"),
            F.coalesce(F.min_by("row", "doc_id"), F.min("row")).alias("first_row"),
            F.count(F.lit(1)).alias("rows"),
        )
        .where("rows > 1")
    )
    # Null-safe equality hashes another expression than the aggregate's, so both sides get a shuffle of their own, and adaptive
    # execution can split the partition of a text with very many copies.
    matched = rows.join(groups, F.col("open") & F.col("text_sha256").eqNullSafe(F.col("digest")), "left")
    alone = F.col("rows").isNull()
    return matched.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("first_id")).alias("keep_id"),
        F.coalesce("rows", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("first_row"))).alias("kept"),
        "text_sha256",
    )
