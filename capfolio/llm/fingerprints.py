"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capfolio.llm.common import cut, ranked

PIECE = r"[^\n]{1,256}"
HASHES = 3
LOAD = 8
ROUNDS = 24
LEVELS = 5
CELL = "struct<bucket:int,place:int,n:int,key:bigint,check:bigint>"


def paragraph_digests(text: Column) -> Column:
    """Distinct 64-bit digests of the paragraphs: lines that are not empty, long ones cut every 256 characters."""
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({PIECE})"), 1)
    return F.array_distinct(F.transform(pieces, lambda p: F.xxhash64(p)))


def bucket_count(pieces: Column) -> Column:
    """Power of two that puts 4 to 8 digests into a bucket on average, 1 at least."""
    doublings = F.ceil(F.log2(F.greatest(pieces, F.lit(LOAD)) / LOAD))
    return F.pow(F.lit(2), doublings).cast("int")


def check_of(digest: Column) -> Column:
    return F.xxhash64(F.lit(77), digest)


def place_of(digest: Column, which: int, level: Column | int) -> Column:
    """Cell of a digest in part ``which`` of its bucket; a part has ``8 * 2**level`` cells."""
    width = F.shiftleft(F.lit(LOAD), level) if isinstance(level, int) else F.expr(f"shiftleft({LOAD}, level)")
    seed = F.lit(which) + HASHES * (F.lit(level) if isinstance(level, int) else level)
    return which * width + F.pmod(F.xxhash64(seed, digest), width).cast("int")


def sketch(digests: Column, buckets: Column, level: int) -> Column:
    """Sketch of ``digests`` (array of struct(sign, digest)): an array of buckets, each an array of cells.

    A cell holds the signed number of digests and the exclusive or of digests and of their check values, so
    the sketch of two versions with opposite signs is the difference of their sketches. Cells are made by sorting
    the entries by place and summing runs.
    """
    def entries(e: Column) -> Column:
        bucket = F.pmod(e["digest"], buckets).cast("int")
        return F.array(*[
            F.struct(
                bucket.alias("bucket"), place_of(e["digest"], k, level).alias("place"), e["sign"].alias("n"),
                e["digest"].alias("key"), check_of(e["digest"]).alias("check"),
            )
            for k in range(HASHES)
        ])

    state = lambda ready, cells, cell: F.struct(ready.alias("ready"), cells.alias("cells"), cell.alias("cell"))
    no_cells = F.array().cast(f"array<{CELL}>")
    start = state(F.array().cast(f"array<array<{CELL}>>"), no_cells, F.lit(None).cast(CELL))

    def grow(acc: Column, e: Column) -> Column:
        cell = acc["cell"]
        new = F.struct(e["bucket"].alias("bucket"), e["place"].alias("place"), e["n"].alias("n"), e["key"].alias("key"), e["check"].alias("check"))
        both = F.struct(
            cell["bucket"].alias("bucket"), cell["place"].alias("place"), (cell["n"] + e["n"]).alias("n"),
            cell["key"].bitwiseXOR(e["key"]).alias("key"), cell["check"].bitwiseXOR(e["check"]).alias("check"),
        )
        closed = F.concat(acc["cells"], F.array(cell))
        return (
            F.when(cell.isNull(), state(acc["ready"], acc["cells"], new))
            .when(cell["bucket"] != e["bucket"], state(F.concat(acc["ready"], F.array(closed)), no_cells, new))
            .when(cell["place"] != e["place"], state(acc["ready"], closed, new))
            .otherwise(state(acc["ready"], acc["cells"], both))
        )

    def finish(acc: Column) -> Column:
        everything = F.concat(acc["ready"], F.array(F.concat(acc["cells"], F.array(acc["cell"]))))
        filled = F.transform(everything, lambda cells: F.filter(cells, holds))
        return F.when(acc["cell"].isNull(), acc["ready"]).otherwise(F.filter(filled, lambda cells: F.size(cells) > 0))

    return F.aggregate(F.array_sort(F.flatten(F.transform(digests, entries))), start, grow, finish)


def holds(cell: Column) -> Column:
    return (cell["n"] != 0) | (cell["key"] != 0) | (cell["check"] != 0)


def signed(digests: Column, sign: int) -> Column:
    return F.transform(digests, lambda d: F.struct(F.lit(sign).alias("sign"), d.alias("digest")))


def fingerprint(digests: Column) -> Column:
    """The sketch of a digest set as text: number of buckets, then bucket, place, count, key and check of each cell."""
    buckets = bucket_count(F.size(digests))
    cells = F.flatten(sketch(signed(digests, 1), buckets, 0))
    as_text = lambda c: F.concat_ws(".", c["bucket"], c["place"], c["n"], F.hex(c["key"]), F.hex(c["check"].bitwiseAND(F.lit(0xFFFFFFFF))))
    return F.concat(buckets.cast("string"), F.lit(":"), F.array_join(F.transform(cells, as_text), " "))


def peeled(cells: Column, level: int) -> Column:
    """struct(found, cells): digests recovered from a bucket's cells, and the cells that remain (none on success).

    Each round takes the cells that hold one digest, removes those digests from all their cells, and goes on.
    """
    def pure(all_cells: Column) -> Column:
        alone = F.filter(all_cells, lambda c: (F.abs(c["n"]) == 1) & (c["check"] == check_of(c["key"])))
        return F.array_distinct(F.transform(alone, lambda c: F.struct(c["n"].alias("n"), c["key"].alias("key"))))

    def removed(cell: Column, takes: Column) -> Column:
        def take(acc: Column, t: Column) -> Column:
            hit = F.lit(False)
            for k in range(HASHES):
                hit = hit | (place_of(t["key"], k, level) == acc["place"])
            less = F.struct(
                acc["bucket"].alias("bucket"), acc["place"].alias("place"), (acc["n"] - t["n"]).alias("n"),
                acc["key"].bitwiseXOR(t["key"]).alias("key"), acc["check"].bitwiseXOR(check_of(t["key"])).alias("check"),
            )
            return F.when(hit, less).otherwise(acc)

        return F.aggregate(takes, cell, take)

    def one_round(state: Column, _: Column) -> Column:
        return F.when(F.size(state["takes"]) == 0, state).otherwise(
            advance(
                F.filter(F.transform(state["cells"], lambda c: removed(c, state["takes"])), holds),
                F.concat(state["found"], state["takes"]),
            )
        )

    def advance(left: Column, found: Column) -> Column:
        with_left = F.transform(F.array(left), lambda c: F.struct(found.alias("found"), c.alias("cells"), pure(c).alias("takes")))
        return F.get(with_left, 0)

    start = advance(cells, F.array().cast("array<struct<n:int,key:bigint>>"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, one_round)


def differences(left: Column, right: Column, level: int) -> Column:
    """struct(extra, left_over): digests that one side alone has, and cells that could not be peeled."""
    buckets = bucket_count(F.greatest(F.size(left), F.size(right)))
    both = sketch(F.concat(signed(left, 1), signed(right, -1)), buckets, level)
    tried = F.transform(both, lambda cells: peeled(cells, level))
    return F.aggregate(
        tried,
        F.struct(F.lit(0).alias("extra"), F.lit(0).alias("left_over")),
        lambda acc, p: F.struct(
            (acc["extra"] + F.size(p["found"])).alias("extra"), (acc["left_over"] + F.size(p["cells"])).alias("left_over")
        ),
    )


def likeness(pairs: DataFrame) -> DataFrame:
    """pair, likeness: Jaccard similarity of the digest sets of ``left`` and ``right``, by sketch subtraction.

    The difference of the two sketches is peeled; pairs for which that fails are kept with their digests, and sketched
    anew with cells doubled and other hash functions, at most five times; the few left after that are compared digest by
    digest. Two empty sets are alike (1).
    """
    both = (F.size("left") + F.size("right")).alias("both")
    waiting, done = pairs, None
    for level in range(LEVELS):
        parts = waiting.select("pair", both, "left", "right", differences(F.col("left"), F.col("right"), level).alias("d"))
        failed = F.col("d.left_over") > 0
        tried = cut(parts.select(
            "pair", "both", "d.extra", failed.alias("failed"),
            F.when(failed, F.col("left")).alias("left"), F.when(failed, F.col("right")).alias("right"),
        ))
        good = tried.where("NOT failed").select("pair", "both", "extra")
        done = good if done is None else done.union(good)
        waiting = tried.where("failed").select("pair", "left", "right")
        if waiting.isEmpty():
            break
    else:
        apart = F.size(F.array_except("left", "right")) + F.size(F.array_except("right", "left"))
        done = done.union(waiting.select("pair", both, apart.alias("extra")))
    alike = F.when(F.col("both") == 0, F.lit(1.0)).otherwise((F.col("both") - F.col("extra")) / (F.col("both") + F.col("extra")))
    return done.select("pair", alike.alias("likeness"))


def edited_versions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document with an edited text, and the sketches' digests of both.

    The edit replaces the last half of the code points (rounded down) by the first as many, or all, of the next
    document by id; the last one's next is the first. Columns: doc_id, n_chars, edited_sha256, own and edited
    (digest arrays), k1, k2 (the document) and next_k1, next_k2 (the next one).

    The order comes from ranks of narrow rows. Texts move once to their key, and once more the half that goes into
    the previous document.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(
        F.xxhash64(id_col).alias("k1"), F.xxhash64(text).alias("k2"), F.col(id_col).alias("doc_id"), text.alias("text")
    )
    named = keyed.select("k1", "k2", "doc_id", F.length("text").alias("n_chars"), F.col("doc_id").isNull().alias("missing"))
    order = cut(ranked(named.distinct(), [], ["missing", "doc_id", "k2"]).select("k1", "k2", "doc_id", "n_chars", "rank"))
    total = order.count()
    following = order.select(
        F.pmod(F.col("rank") - 1, F.lit(total)).alias("rank"), F.col("k1").alias("next_k1"), F.col("k2").alias("next_k2")
    )
    before = order.select(
        F.pmod(F.col("rank") + 1, F.lit(total)).alias("rank"), F.col("k1").alias("to_k1"), F.col("k2").alias("to_k2"),
        F.floor(F.col("n_chars") / 2).cast("int").alias("lend"),
    )
    links = cut(order.join(following, "rank").join(before, "rank").drop("rank"))
    # Both uses of the texts below read the same three columns, so that their shuffle is done once and reused.
    placed = keyed.select("k1", "k2", "text").join(links, ["k1", "k2"])
    heads = placed.select("to_k1", "to_k2", F.substring(F.col("text"), F.lit(1), F.col("lend")).alias("head")).dropDuplicates(["to_k1", "to_k2"])
    heads = heads.select(F.col("to_k1").alias("k1"), F.col("to_k2").alias("k2"), "head")
    keep = F.col("n_chars") - F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), keep), F.col("head"))
    own = placed.select("k1", "k2", "doc_id", "n_chars", "text", "next_k1", "next_k2")
    return own.join(heads, ["k1", "k2"]).select(
        "k1", "k2", "doc_id", "n_chars", "next_k1", "next_k2", F.sha2(edited, 256).alias("edited_sha256"),
        paragraph_digests(F.col("text")).alias("own"), paragraph_digests(edited).alias("edited"),
    )


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next per row of ``docs``.

    Fingerprints are sketches of the sets of paragraph digests; likeness is the sets' Jaccard similarity, found by
    subtracting sketches and peeling. The work per row is linear in its text up to sorting.

    Results for special input: a NULL text is empty, has the fingerprint ``1:`` and is alike to another empty one.
    NULL ids come last. Rows that repeat id and text are one document in the order and get the same result each.
    A lone document is its own next one. An empty table gives an empty result; other columns are ignored.
    """
    versions = cut(
        edited_versions(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    )
    others = versions.dropDuplicates(["k1", "k2"]).select(
        F.col("k1").alias("next_k1"), F.col("k2").alias("next_k2"), F.col("own").alias("next_own")
    )
    met = versions.join(others, ["next_k1", "next_k2"])
    pairs = met.select(
        F.explode(F.array(
            F.struct((F.col("row") * 2).alias("pair"), F.col("own").alias("left"), F.col("edited").alias("right")),
            F.struct((F.col("row") * 2 + 1).alias("pair"), F.col("own").alias("left"), F.col("next_own").alias("right")),
        )).alias("p")
    ).select("p.pair", "p.left", "p.right")
    alike = likeness(pairs).groupBy(F.expr("pair div 2").alias("row")).agg(
        F.max(F.when(F.col("pair") % 2 == 0, F.col("likeness"))).alias("near_edited"),
        F.max(F.when(F.col("pair") % 2 == 1, F.col("likeness"))).alias("near_next"),
    )
    return versions.join(alike, "row").select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256",
        fingerprint(F.col("own")).alias("fingerprint"), fingerprint(F.col("edited")).alias("edited_fingerprint"),
        "near_edited", "near_next",
    )
