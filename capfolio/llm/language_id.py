"""Language identification with bit-sliced Bloom filters of letter n-grams."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capfolio.llm.common import cut, unit_interval

GRAM = 3
PIECE = r"\p{L}{1,32}"
MASK_BITS = 63


@dataclass(frozen=True)
class LanguageModel:
    """Languages, and a row for each 63 of them: ``slice`` and ``cells``, an array of longs.

    Cell ``c`` of slice ``s`` has bit ``b`` set if the filter of language ``63 s + b`` has bit ``c`` set, so one
    look-up answers for 63 languages. ``rates`` are the filters' false positive rates.
    """

    languages: tuple[str, ...]
    filters: DataFrame
    rates: tuple[float, ...]
    cells: int
    hashes: int
    usual: str | None


def grams(text: Column) -> Column:
    """Rows-to-be: pieces of letters in lower case between underscores."""
    pieces = F.regexp_extract_all(F.lower(text), F.lit(f"({PIECE})"), 1)
    return F.transform(pieces, lambda p: F.concat(F.lit("_"), p, F.lit("_")))


def with_grams(frame: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """One row per letter n-gram of ``text`` plus one with a NULL ``gram`` per document."""
    pieces = frame.select(*keep, F.explode(F.concat(F.array(F.lit(None).cast("string")), F.coalesce(grams(F.col(text)), F.array()))).alias("piece"))
    last = F.greatest(F.length("piece") - (GRAM - 1), F.lit(1))
    starts = pieces.select(*keep, "piece", F.explode(F.sequence(F.lit(1), F.coalesce(last, F.lit(1)))).alias("start"))
    return starts.select(*keep, F.substring(F.col("piece"), F.col("start"), F.lit(GRAM)).alias("gram"))


def cell_of(gram: Column, which: int, cells: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(which), gram), F.lit(cells)).cast("int")


def sampled(labelled: DataFrame, sizes: dict[str, tuple[int, int]], sample_texts: int) -> DataFrame:
    """About ``sample_texts`` distinct texts of each language: those whose hash falls under the language's rate.

    Copies of a text are one, and are dropped by an aggregate that combines them before the shuffle.
    """
    rates = F.create_map(*[F.lit(x) for name, (_, texts) in sizes.items() for x in (name, min(1.0, sample_texts / texts))])
    hashed = labelled.withColumn("text_hash", F.xxhash64("text"))
    few = hashed.where(unit_interval("text_hash") < F.element_at(rates, F.col("lang"))) if sizes else hashed
    return few.dropDuplicates(["lang", "text_hash"]).select("lang", "text")


def fit_languages(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    sample_texts: int = 8000,
    min_share: float = 2e-5,
    likeness: float = 0.2,
    bits_per_gram: int = 8,
    hashes: int = 2,
) -> LanguageModel:
    """Filters of the n-grams that belong to each language.

    About ``sample_texts`` distinct labelled texts of each language are read, chosen by their hash.
    An n-gram belongs to a language if it makes up ``min_share`` or more of the language's n-grams and
    ``likeness`` or more of its share in the language where it is most usual; a filter therefore never holds
    more than ``1 / min_share`` n-grams. A filter has ``bits_per_gram`` cells or more for each n-gram of the language with
    the most, which keeps false positives near 5 % with two hashes. Rows without label or text teach nothing.
    """
    labelled = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")
    found = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(F.xxhash64("text")).alias("texts"))
    sizes = {r["lang"]: (r["n"], max(1, r["texts"])) for r in found.collect()}
    languages = tuple(sorted(sizes))
    spark = docs.sparkSession
    names = F.array(*map(F.lit, languages)) if languages else F.array().cast("array<string>")
    sample = sampled(labelled, sizes, sample_texts)
    counts = with_grams(sample, "text", ["lang"]).where("gram IS NOT NULL").groupBy("lang", "gram").count()
    totals = counts.groupBy("lang").agg(F.sum("count").alias("total"))
    shares = counts.join(F.broadcast(totals), "lang").withColumn("share", F.col("count") / F.col("total")).where(F.col("share") >= min_share)
    tops = shares.groupBy("gram").agg(F.max("share").alias("top"), F.collect_list(F.struct("lang", "share")).alias("each"))
    members = tops.select("gram", "top", F.explode("each").alias("e")).where(F.col("e.share") >= F.col("top") * likeness)
    index = (F.array_position(names, F.col("e.lang")) - 1).cast("int")
    members = cut(members.select("gram", index.alias("language")))
    most = members.groupBy("language").count().agg(F.max("count")).first()[0] or 1
    cells = max(1 << 10, 1 << (most * bits_per_gram - 1).bit_length())
    set_bits = members.select(
        F.explode(F.array(*[cell_of(F.col("gram"), k, cells) for k in range(hashes)])).alias("cell"),
        F.floor(F.col("language") / MASK_BITS).cast("int").alias("slice"),
        F.expr(f"shiftleft(1L, cast(pmod(language, {MASK_BITS}) as int))").alias("bit"),
    )
    slices = max(1, -(-len(languages) // MASK_BITS))
    masks = cut(set_bits.groupBy("cell", "slice").agg(F.bit_or("bit").alias("mask")))
    set_cells = masks.groupBy("slice").agg(*[F.sum(F.getbit("mask", F.lit(bit))).alias(f"n{bit}") for bit in range(MASK_BITS)])
    full = {r["slice"]: r for r in set_cells.collect()}
    fills = [full[n // MASK_BITS][f"n{n % MASK_BITS}"] if n // MASK_BITS in full else 0 for n in range(len(languages))]
    rates = tuple((f / cells) ** hashes for f in fills)
    grid = spark.range(0, cells * slices, 1, 4).select(
        F.floor(F.col("id") / cells).cast("int").alias("slice"), F.pmod("id", F.lit(cells)).cast("int").alias("cell")
    )
    dense = grid.join(masks, ["slice", "cell"], "left").withColumn("mask", F.coalesce("mask", F.lit(0)))
    flat = F.transform(F.array_sort(F.collect_list(F.struct("cell", "mask"))), lambda e: e["mask"])
    filters = cut(dense.groupBy("slice").agg(flat.alias("cells")))
    usual = max(languages, key=lambda name: (sizes[name][0], name)) if languages else None
    return LanguageModel(languages, filters, rates, cells, hashes, usual)


def with_masks(rows: DataFrame, model: LanguageModel) -> DataFrame:
    """``rows`` (with ``gram``) with the languages whose filters hold the n-gram: a mask ``_m0``, ``_m1``, ... for each 63.

    A slice is a scalar; a plan holds it once for each hash.
    """
    places = [cell_of(F.col("gram"), k, model.cells) for k in range(model.hashes)]
    masks = {}
    for s in range(max(1, -(-len(model.languages) // MASK_BITS))):
        cells = model.filters.where(F.col("slice") == s).select("cells").scalar()
        masks[f"_m{s}"] = reduce(Column.bitwiseAND, [F.get(cells, place) for place in places])
    return rows.withColumns(masks)


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, text_hash, lang_pred, score and n_grams: one row per row of ``docs``.

    Each n-gram's look-up returns the set of languages containing it; hits are counted per language, corrected
    for the filter's false positive rate ``f`` as ``(hits - f n) / (1 - f)``, and the largest count wins (of
    equals the first in order). ``score`` is that count divided by the number of n-grams.

    Results for special input: ``und`` with score 0 if the text is NULL or has no letter, or if the model knows
    no language; the most frequent training language with score 0 if no n-gram is known. Runs of letters
    longer than 32 are cut there. Rows that agree in ``keep`` and text get the same answer each.
    """
    names = [f"_k{i}" for i in range(len(keep))]
    base = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], F.col(text_col).alias("text"))
    base = base.withColumn("text_hash", F.xxhash64("text"))
    rows = with_grams(base, "text", [*names, "text_hash"])
    rows = with_masks(rows, model)
    hits = [
        F.sum(F.when(F.col("gram").isNotNull(), F.getbit(f"_m{n // MASK_BITS}", F.lit(n % MASK_BITS)))).alias(f"_h{n}")
        for n in range(len(model.languages))
    ]
    counted = rows.groupBy(*names, "text_hash").agg(
        F.count("gram").alias("_n"), F.count_if(F.col("gram").isNull()).alias("_rows"), *hits
    )
    found = F.array(*[F.coalesce(F.col(f"_h{n}"), F.lit(0)) for n in range(len(model.languages))]).cast("array<double>")
    corrected = F.zip_with(
        found, F.array(*map(F.lit, model.rates)).cast("array<double>"),
        lambda have, rate: F.greatest((have - rate * F.col("_n")) / F.greatest(1 - rate, F.lit(1e-9)), F.lit(0.0)),
    )
    judged = counted.withColumn("_hits", corrected).withColumn(
        "_best", F.coalesce(F.array_max("_hits"), F.lit(0.0))
    )
    names_of = F.array(*map(F.lit, model.languages)).cast("array<string>")
    first = F.get(names_of, F.array_position("_hits", F.col("_best")).cast("int") - 1)
    chosen = F.when(F.col("_best") > 0, first).otherwise(F.lit(model.usual))
    blank = (F.col("_n") == 0) | F.lit(not model.languages)
    return judged.select(
        *[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)],
        "text_hash",
        F.when(blank, F.lit("und")).otherwise(chosen).alias("lang_pred"),
        F.when(blank, F.lit(0.0)).otherwise(F.least(F.col("_best") / F.col("_n"), F.lit(1.0))).alias("score"),
        F.col("_n").alias("n_grams"),
        F.explode(F.sequence(F.lit(1), F.col("_rows").cast("int"))).alias("_copy"),
    ).drop("_copy")
