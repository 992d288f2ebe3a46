"""Helpers that several document operators share."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def fold_of(identifier: Column, folds: int = 5) -> Column:
    """crc32 of the identifier as text, modulo ``folds``; NULL for NULL."""
    return F.pmod(F.crc32(identifier.cast("string").cast("binary")), F.lit(folds))


def scratch_folder(spark: SparkSession) -> str:
    """A shared folder for tables between stages: the session's checkpoint folder.

    Where ``spark.checkpoint.dir`` is unset, a session whose tasks all run in this process gets a temporary one; any
    other is refused, since executors of other machines could not read a local folder.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="capfolio-"))
    return context.getCheckpointDir()


def cut(frame: DataFrame) -> DataFrame:
    """``frame`` checkpointed in the shared folder, so that lost executors cost no recomputation."""
    scratch_folder(frame.sparkSession)
    return frame.checkpoint()


def stored(frame: DataFrame, **options: str) -> DataFrame:
    """``frame`` written as Parquet to the shared folder and read again; columns that are not read later cost nothing."""
    path = f"{scratch_folder(frame.sparkSession)}/table-{uuid.uuid4().hex}"
    frame.write.parquet(path, **options)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def stored_alone(frame: DataFrame, **options: str) -> DataFrame:
    """``stored``, for a ``frame`` that is not run again: its shuffle files are dropped as soon as it is written, not when the
    driver happens to collect its garbage."""
    conf, name = frame.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    earlier = conf.get(name, None)
    conf.set(name, "true")
    try:
        return stored(frame, **options)
    finally:
        conf.unset(name) if earlier is None else conf.set(name, earlier)


def bit_set(hashes: DataFrame, bits: int) -> Column:
    """The single long column of ``hashes`` as a scalar array of ``bits / 64`` longs, for ``in_bit_set``.

    Its size is fixed by ``bits``, whatever the input; a full set answers "maybe" to everything.
    """
    (name,) = hashes.columns
    words = hashes.select(F.pmod(F.col(name), F.lit(bits)).alias("cell")).select(
        F.floor(F.col("cell") / 64).cast("int").alias("word"),
        F.expr("shiftleft(1L, cast(pmod(cell, 64) as int))").alias("bit"),
    )
    spark = hashes.sparkSession
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits"))
    dense = spark.range(0, bits // 64, 1, 4).select(F.col("id").cast("int").alias("word")).join(found, "word", "left")
    entry = F.struct("word", F.coalesce("bits", F.lit(0)).alias("bits"))
    return dense.agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["bits"]).alias("set")).scalar()


def in_bit_set(hashed: Column, bit_array: Column, bits: int) -> Column:
    """False only if ``hashed`` was certainly not put into the set."""
    cell = F.pmod(hashed, F.lit(bits))
    word = F.get(bit_array, F.floor(cell / 64).cast("int"))
    return F.getbit(word, F.pmod(cell, F.lit(64)).cast("int")) == 1


def ranked(frame: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "rank") -> DataFrame:
    """``frame`` with a gapless rank from 0 within ``keys``, in the order of ``order`` (NULLs first).

    Rows are range-partitioned by keys and order, numbered inside each partition, and shifted by the
    rows of the same key in earlier partitions. A hot key is spread over as many partitions as it fills;
    the shift is computed from one row per key and partition.
    """
    parted = cut(frame.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    local = Window.partitionBy("_part", *keys).orderBy(*order)
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        parted.groupBy("_part", *keys).agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_shift", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
        .select(F.col("_part").alias("_part_"), "_shift", *[F.col(k).alias(f"_key_{k}") for k in keys])
    )
    same = F.col("_part") == F.col("_part_")
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"_key_{key}"))
    numbered = parted.withColumn("_row", F.row_number().over(local))
    rank = (F.col("_shift") + F.col("_row") - 1).cast("long")
    return numbered.join(shifts, same).select(*frame.columns, rank.alias(name))


def unit_interval(*parts: Column | str) -> Column:
    """A repeatable pseudo-random number in [0, 1) from the values of ``parts``."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) * F.lit(math.ldexp(1.0, -53))
