"""Mixing sources to target weights by pivotal rounding of copy numbers in a distributed tree."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capfolio.llm.common import WORD, ranked, stored, unit_interval

FAN_IN = 256
EPSILON = 1e-9
CLASS_BITS = 4


def word_count(text: Column) -> Column:
    """Number of runs of characters that are no ASCII white space; 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: Sequence[float], most_copies: int) -> DataFrame:
    """source, source_size, target of each source in ``sized`` (source, size).

    Sources in code point order, NULL last, have ``weights`` in rotation and share the total size by weight; a
    target stops at ``most_copies`` times its source's size and the rest is shared anew. All shares below their
    limit are ``level * weight`` for one level, which rises until the capped set no longer changes; each step is
    one aggregate over the sources.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("missing", F.col("source").isNull())
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("rank", F.lit(len(weights))).cast("int"))
    table = stored(
        ranked(sums, [], ["missing", "source"])
        .select("source", "source_size", weight.alias("weight"), (F.col("source_size") * float(most_copies)).alias("most"))
    )
    level, capped = 0.0, -1
    while True:
        full = F.col("most") < level * F.col("weight")
        found = table.agg(
            F.sum("source_size").alias("total"),
            F.count_if(full).alias("capped"),
            F.sum(F.when(full, F.col("most")).otherwise(0.0)).alias("used"),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open"),
        ).first()
        if not found["open"] or found["capped"] == capped:
            break
        capped, level = found["capped"], (found["total"] - found["used"]) / found["open"]
    return table.select("source", "source_size", F.least("most", F.lit(level) * F.col("weight")).alias("target"))


def fold_block(nodes: Column, source: Column, seed: int) -> Column:
    """Pivotal rounding along one block, largest first: struct(leaf, size, mass, decided).

    ``mass`` counts words, from 0 to the node's size. Where two nodes meet, words move from one to the other as far as
    both stay in these bounds, in either direction with chances inverse to the amounts, so the expected mass of
    both stays as it is. A node that reached 0 or its size is decided, and the other one is carried on.
    """
    start = F.struct(
        F.lit(None).cast("long").alias("leaf"), F.lit(None).cast("long").alias("size"), F.lit(0.0).alias("mass"),
        F.array().cast("array<struct<leaf:bigint,size:bigint,take:int>>").alias("decided"),
    )

    def meet(have: Column, new: Column) -> Column:
        room, new_room = have["size"] - have["mass"], new["size"] - new["mass"]
        up, down = F.least(room, new["mass"]), F.least(have["mass"], new_room)
        rises = unit_interval(F.lit(seed), source, have["leaf"], new["leaf"]) * (up + down) < down
        settles = F.when(rises, room <= new["mass"]).otherwise(have["mass"] <= new_room)  # the node held, not the new one
        # A settled node that rose has its size, one that fell has nothing; the new node moves the other way.
        entry = F.struct(
            F.when(settles, have["leaf"]).otherwise(new["leaf"]).alias("leaf"),
            F.when(settles, have["size"]).otherwise(new["size"]).alias("size"), (rises == settles).cast("int").alias("take"),
        )
        moved = F.when(rises, up).otherwise(-down)
        left = F.when(settles, new["mass"] - moved).otherwise(have["mass"] + moved)
        none = have["leaf"].isNull()
        stays = ~none & ~settles
        return F.struct(
            F.when(stays, have["leaf"]).otherwise(new["leaf"]).alias("leaf"),
            F.when(stays, have["size"]).otherwise(new["size"]).alias("size"),
            F.when(none, new["mass"]).otherwise(left).alias("mass"),
            F.when(none, have["decided"]).otherwise(F.concat(have["decided"], F.array(entry))).alias("decided"),
        )

    return F.aggregate(nodes, start, meet)


def size_class(size: Column) -> Column:
    """0 for sizes below 16, 1 below 256, and so on."""
    return F.floor((F.length(F.bin(size)) - 1) / CLASS_BITS).cast("int")


def round_class(nodes: DataFrame, largest: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Pivotal rounding of ``nodes`` (source, node, leaf, size, mass) in a tree.

    Gives (source, leaf, size, take) of all that were decided, and the one node of each source that is left.
    """
    decided, reach = None, 1
    while True:
        block = F.floor(F.col("node") / FAN_IN).alias("node")
        entries = F.array_sort(F.collect_list(F.struct("node", "leaf", "size", "mass")))
        gathered = nodes.groupBy("source", block).agg(entries.alias("entries"))
        level = stored(gathered.select("source", "node", fold_block(F.col("entries"), F.col("source"), seed).alias("s")))
        done = level.select("source", F.explode("s.decided").alias("d")).select("source", "d.leaf", "d.size", "d.take")
        decided = done if decided is None else decided.union(done)
        nodes = level.select("source", "node", "s.leaf", "s.size", "s.mass")
        reach *= FAN_IN
        if reach > largest:
            return decided, nodes


def same_source(frame: DataFrame, other: DataFrame, how: str = "inner") -> DataFrame:
    renamed = other.withColumnRenamed("source", "_source")
    return frame.join(renamed, F.col("source").eqNullSafe(F.col("_source")), how).drop("_source")


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (5, 2, 1),
    most_copies: int = 3,
    seed: int = 7,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, text_hash, size, source_size, target, copies, taken.

    Every document of a source should be copied ``target / source_size`` times. The whole part is taken as it is;
    the fraction is rounded by the pivotal method: two documents meet, and mass moves between them at random until
    one is taken once more or not at all, while the other carries the rest on. Mass is counted in words, and each
    document keeps its expected number of copies. Documents are ranked by falling size within their source; blocks of 256
    neighbours are folded at once and leave one carrier, which meets those of neighbouring blocks one level up. The
    tree's depth is the logarithm of the largest source, and each level is one shuffle keyed by source and block.

    A tree leaves one document whose mass is not whole. So that a long one does not decide a source's total, documents are
    rounded by classes of size (factor 16), the longest first: what a class took too much or too little, which is 0 on average, is
    shared by all smaller documents of the source, up to their limits of 0 and ``most_copies``. If the smaller ones could make
    good only one outcome of a class's last document, or neither, the outcome that leaves less is taken instead of a random
    one; a source thus ends within the size of one of its shortest documents of its target, wherever whole copies
    allow that. Random numbers are hashes of seed and ranks, so reruns agree.

    Results for special input: a NULL text has size 0 and is never taken; a NULL source is a source of its
    own, last in order; repeated rows are separate documents; NULL ids are allowed. An empty table gives an
    empty result. Other columns of ``docs`` are ignored.
    """
    text = F.col(text_col)
    sized = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.xxhash64(text).alias("text_hash"),
        word_count(text).alias("size"),
    ).withColumn("down", -F.col("size"))
    placed = stored(
        ranked(sized, ["source"], ["down", "doc_id", "text_hash"], "leaf").drop("down").withColumn("class", size_class(F.col("size")))
    )
    targets = source_targets(placed.select("source", "size"), weights, most_copies)
    classes = stored(placed.where("size > 0").groupBy("source", "class").agg(F.sum("size").alias("words"), F.max("leaf").alias("last")))
    present = classes.groupBy("class").agg(F.max("last").alias("last")).orderBy(F.desc("class")).collect()

    open_words = targets.select("source", F.col("target").alias("left"), F.col("source_size").alias("rest"))
    rates, takes = None, None
    for number, largest in present:
        words = classes.where(F.col("class") == number).select("source", "words")
        met = together(open_words, words).where("words IS NOT NULL OR rest IS NOT NULL").fillna(0, ["words"])
        rate = F.greatest(F.lit(0.0), F.least(F.lit(float(most_copies)), F.col("left") / F.nullif("rest", F.lit(0))))
        states = stored(met.select(
            "source", "left", "rest", "words", F.coalesce(rate, F.lit(0.0)).alias("rate"), F.lit(number).alias("class")
        ))
        rated = same_source(placed.where((F.col("class") == number) & (F.col("size") > 0)), states.select("source", "rate"))
        rated = rated.withColumn("whole", whole_copies(F.col("rate")))
        mass = F.greatest(F.col("rate") - F.col("whole"), F.lit(0.0)) * F.col("size")
        nodes = rated.select("source", F.col("leaf").alias("node"), "leaf", "size", mass.alias("mass"))
        decided, last = round_class(nodes.where(F.col("mass") > EPSILON * F.col("size")), largest, seed)
        sure = decided.groupBy("source").agg(F.sum(F.col("take") * F.col("size")).alias("extra"))
        final = together(states.drop("class"), sure, last.select("source", F.col("leaf").alias("open"), F.col("size").alias("open_size"), "mass"))
        without = F.col("left") - whole_copies(F.col("rate")) * F.col("words") - F.coalesce("extra", F.lit(0))
        smaller = (F.col("rest") - F.col("words")) * most_copies
        more, less = _miss(without - F.col("open_size"), smaller), _miss(without, smaller)
        drawn = unit_interval(F.lit(seed), F.lit("last"), "source", "open") * F.col("open_size") < F.col("mass")
        taken = F.col("open").isNotNull() & F.when(more < less, True).when(more > less, False).otherwise(drawn)
        final = stored(final.select(
            "source", "open", taken.cast("int").alias("take"),
            (without - F.when(taken, F.col("open_size")).otherwise(0)).alias("left"), (F.col("rest") - F.col("words")).alias("rest"),
        ))
        open_words = final.select("source", "left", "rest")
        found = decided.select("source", "leaf", "take").union(final.where("open IS NOT NULL").select("source", "open", "take"))
        takes = found if takes is None else takes.union(found)
        rates = states.select("source", "class", "rate") if rates is None else rates.union(states.select("source", "class", "rate"))

    if rates is None:
        rates = targets.select("source", F.lit(0).alias("class"), F.lit(0.0).alias("rate"))
        takes = placed.select("source", "leaf", F.lit(0).alias("take")).limit(0)
    named = rates.withColumnsRenamed({"source": "_rated", "class": "_class"})
    own = F.col("source").eqNullSafe(F.col("_rated")) & (F.col("class") == F.col("_class"))
    found = same_source(placed, targets).join(named, own, "left").drop("_rated", "_class")
    entries = takes.withColumnsRenamed({"source": "_source", "leaf": "_leaf"})
    found = found.join(entries, F.col("source").eqNullSafe(F.col("_source")) & (F.col("leaf") == F.col("_leaf")), "left")
    copies = whole_copies(F.coalesce("rate", F.lit(0.0))) + F.coalesce("take", F.lit(0))
    copies = F.when(F.col("size") > 0, copies).otherwise(0).cast("int")
    return found.select(
        "doc_id", "source", "text_hash", "size", "source_size", "target", copies.alias("copies"),
        (copies * F.col("size")).cast("long").alias("taken"),
    )


def whole_copies(rate: Column) -> Column:
    return F.floor(rate + EPSILON)


def together(*tables: DataFrame) -> DataFrame:
    """Tables of at most one row per source side by side, by one aggregate instead of joins."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    return rows.groupBy("source").agg(*[F.max(c).alias(c) for c in rows.columns if c != "source"])


def _miss(left: Column, most: Column) -> Column:
    """How many words stay open, whatever smaller documents take, if ``left`` are to come from them and they have ``most``."""
    return F.greatest(-left, left - most, F.lit(0.0))
