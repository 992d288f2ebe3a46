"""Line dedup: line hashes in range order, repeats streamed, one keep bitmap per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capfolio.llm.common import BLANKS, cut, lower_ascii

HOT_SHARE = 10_000


def lines_of(text: Column) -> Column:
    """The lines of ``text`` in order; NULL and the empty text have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(BLANKS)))


def keep_bitmaps(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 1,
    min_docs: int = 10,
    keep_first: bool = False,
) -> DataFrame:
    """Documents that lose lines: doc_id, text_hash, n_dropped, keep (array of long).

    Bit ``i % 64`` of ``keep[i // 64]`` tells whether line ``i`` stays; words after the last dropped line are
    left out and mean that all stay, and a document that loses nothing has no row. A line's key is the line
    stripped of ASCII white space with A-Z in lower case. Keys of ``min_chars`` code points or more lose all
    their lines if ``min_docs`` documents or more have them; with ``keep_first`` every key keeps its first line,
    by document and position, and loses the others instead.

    Lines become (128-bit key hash, document, position), read from the texts once and kept; they are range-partitioned by hash and sorted by document
    and position inside; one pass over the sorted rows counts documents and finds first occurrences. A key with
    over 1 / 10 000 of all lines is hot: there are at most 10 000, so their list is broadcast, and their rows
    are dealt into slices by document whose counts are summed.

    Results for special input: rows that share an id count as one document for ``min_docs``; rows without an
    id are documents apart, one per distinct text. Rows with equal id and text share a row of the result.
    Empty tables give an empty result; other columns of ``docs`` are ignored.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    key = line_key(F.col("line"))
    lines = cut(
        base.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
        .select("doc_id", "text_hash", "pos", key.alias("key"))
        .where(F.length("key") >= min_chars)
        .select("doc_id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    )
    share = F.ceil(lines.agg(F.count(F.lit(1))).scalar() / HOT_SHARE)
    hot = (
        lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("rows"))
        .where(F.col("rows") > F.greatest(share, F.lit(1000)))
        .select("h1", "h2", F.ceil(F.col("rows") / F.greatest(share, F.lit(1000))).alias("slices"))
    )
    document = F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("text_hash")))
    dealt = (
        lines.join(F.broadcast(hot), ["h1", "h2"], "left")
        .withColumn("slice", F.coalesce(F.pmod(document, F.col("slices")), F.lit(0)))
        .withColumn("document", document)
        .repartitionByRange("h1", "h2", "slice")
        .sortWithinPartitions("h1", "h2", "slice", "doc_id", "text_hash", "pos")
    )
    in_slice = Window.partitionBy("h1", "h2", "slice")
    in_order = in_slice.orderBy("doc_id", "text_hash", "pos")
    begins = F.lag("document").over(in_order).isNull() | (F.lag("document").over(in_order) != F.col("document"))
    streamed = dealt.withColumn("begins", begins.cast("int")).withColumn("line_no", F.row_number().over(in_order))
    if keep_first:
        again = streamed.where("line_no > 1").select("doc_id", "text_hash", "pos")
        between_slices = Window.partitionBy("h1", "h2").orderBy("doc_id", "text_hash", "pos")
        heads = streamed.where("line_no = 1").withColumn("line_no", F.row_number().over(between_slices))
        dropped = again.union(heads.where("line_no > 1").select("doc_id", "text_hash", "pos"))
    else:
        counted = streamed.withColumn("docs", F.sum("begins").over(in_slice))
        totals = (
            counted.where("slices > 1 AND line_no = 1").groupBy("h1", "h2").agg(F.sum("docs").alias("all_docs"))
        )
        dropped = (
            counted.join(F.broadcast(totals), ["h1", "h2"], "left")
            .where(F.coalesce("all_docs", "docs") >= min_docs)
            .select("doc_id", "text_hash", "pos")
        )
    bit = F.expr("shiftleft(1L, pmod(pos, 64))")
    words = (
        dropped.groupBy("doc_id", "text_hash", F.floor(F.col("pos") / 64).cast("int").alias("word"))
        .agg(F.bit_or(bit).alias("bits"))
    )
    gap = lambda acc, e: F.array_repeat(F.lit(-1).cast("long"), e["word"] - F.size(acc))
    dense = F.aggregate(
        "words",
        F.array().cast("array<long>"),
        lambda acc, e: F.concat(acc, gap(acc, e), F.array(F.bitwise_not(e["bits"]))),
    )
    return (
        words.groupBy("doc_id", "text_hash")
        .agg(
            F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("words"),
            F.sum(F.bit_count("bits")).alias("n_dropped"),
        )
        .select("doc_id", "text_hash", "n_dropped", dense.alias("keep"))
    )


def drop_lines(
    docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` with ``text`` reduced to the kept lines, and n_lines and n_dropped added in the struct ``line_dedup``.

    Texts without a dropped line stay as they are, a NULL text too.
    """
    marks = bitmaps.select(
        F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("n_dropped").alias("_dropped"),
        F.col("keep").alias("_keep"),
    )
    own = docs.withColumn("_own", F.xxhash64(text_col))
    joined = own.join(marks, own[id_col].eqNullSafe(marks["_id"]) & (own["_own"] == marks["_hash"]), "left")
    lines = lines_of(F.col(text_col))
    word = lambda i: F.get("_keep", F.floor(i / 64).cast("int"))
    stays = lambda _, i: F.coalesce(F.getbit(word(i), F.pmod(i, F.lit(64))), F.lit(1)) == 1
    kept = F.when(F.col("_keep").isNull(), F.col(text_col)).otherwise(F.array_join(F.filter(lines, stays), "\n"))
    report = F.struct(F.size(lines).cast("long").alias("n_lines"), F.coalesce("_dropped", F.lit(0)).cast("long").alias("n_dropped"))
    columns = [kept.alias(c) if c == text_col else F.col(c) for c in docs.columns]
    return joined.select(*columns, report.alias("line_dedup"))
