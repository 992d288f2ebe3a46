"""Near duplicates: MinHash bands, sequential Bayesian pruning of candidates, exact verification, components."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capfolio.llm.common import bit_set, in_bit_set, ranked, stored
from capfolio.llm.words import Words, chunks

HASHES = 128
ROWS = 4  # hashes in a band: a pair of similarity 0.75 misses all 32 bands with a chance of 5e-6
STEP = 16  # hashes compared before the next look at the posterior
NUMERATOR, DENOMINATOR = 3, 4  # the threshold as a fraction
NEEDED_BITS = 1 << 20
FOREST_EDGES = 1 << 20  # contracted at a time
BLOCK = 128  # members of a group that meet in a task: two blocks at most
COLUMNS = 8192
MULTIPLIER = np.uint64(0x9FB21C651E98DF25)


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * MULTIPLIER
    return values ^ (values >> np.uint64(29))


def shingle_sets(words: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of each text's distinct shingles, sorted within the text, and where texts begin."""
    each = mixed(words.hashes() + np.uint64(1))[words.codes] if len(words.codes) else np.empty(0, np.uint64)
    lengths = words.lengths()
    folded = np.zeros(max(len(each) - size + 1, 0), np.uint64)
    for offset in range(size):
        folded = folded * MULTIPLIER + each[offset : offset + len(folded)]
    folded = mixed(folded)
    found, edges = [], [0]
    for start, length in zip(words.starts[:-1].tolist(), lengths.tolist(), strict=True):
        if length >= size:
            shingles = np.sort(folded[start : start + length - size + 1])
            shingles = shingles[np.concatenate(([True], shingles[1:] != shingles[:-1]))]
        elif length:
            whole = reduce(lambda acc, h: acc * MULTIPLIER + h, each[start : start + length], np.uint64(length))
            shingles = mixed(np.array([whole], np.uint64))
        else:
            shingles = folded[:0]
        found.append(shingles)
        edges.append(edges[-1] + len(shingles))
    return (np.concatenate(found) if found else folded[:0]), np.array(edges)


def hash_family(seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(seed)
    return random.integers(0, 2**63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1), random.integers(0, 2**63, HASHES, np.uint64)


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, d1, d2 (a 128-bit digest of the shingle set), signature (128 unsigned 32-bit minima)."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors, offsets = hash_family()
        for batch in batches:
            for part in chunks(batch, most=2 << 20):
                with np.errstate(over="ignore"):
                    shingles, edges = shingle_sets(Words(part.column("text")))
                    counts = np.diff(edges)
                    filled = counts > 0
                    begins = edges[:-1][filled]
                    d1, d2 = np.zeros(len(counts), np.uint64), np.zeros(len(counts), np.uint64)
                    minima = np.full((len(counts), HASHES), 0xFFFFFFFF, np.uint32)
                    if len(begins):
                        d1[filled] = np.add.reduceat(mixed(shingles + np.uint64(11)), begins)
                        d2[filled] = np.add.reduceat(mixed(shingles ^ MULTIPLIER), begins)
                        for k in range(HASHES):
                            values = ((shingles * factors[k] + offsets[k]) >> np.uint64(32)).astype(np.uint32)
                            minima[filled, k] = np.minimum.reduceat(values, begins)
                raw = minima.astype("<u4").tobytes()
                width = 4 * HASHES
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), pa.array(counts.astype(np.int64)), pa.array(d1.view(np.int64)),
                        pa.array(d2.view(np.int64)), pa.array([raw[i : i + width] for i in range(0, len(raw), width)], pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "d1", "d2", "signature"],
                )

    return source.mapInArrow(sign, f"doc_id {kind}, n_shingles long, d1 long, d2 long, signature binary")


def least_matches(threshold: float, miss: float) -> list[int]:
    """For 16, 32, ... compared hashes: the least number of equal ones with P(similarity >= threshold) >= miss.

    The prior is uniform, so the posterior is Beta(m + 1, n - m + 1), whose upper tail is a binomial sum.
    """
    def tail(equal: int, seen: int) -> float:
        return sum(
            math.comb(seen + 1, j) * threshold**j * (1 - threshold) ** (seen + 1 - j) for j in range(equal + 1)
        )

    return [next(m for m in range(n + 1) if tail(m, n) >= miss) for n in range(STEP, HASHES + 1, STEP)]


def pruned(pairs: DataFrame, nodes: DataFrame, miss: float) -> DataFrame:
    """``pairs`` (a, b) whose signatures leave a chance of ``miss`` or more that they are similar enough."""
    least = least_matches(NUMERATOR / DENOMINATOR, miss)
    kind = pairs.schema["a"].dataType.simpleString()
    side = lambda name: nodes.select(F.col("doc_id").alias(f"{name}_id"), F.col("signature").alias(f"{name}_signature"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (
                np.frombuffer(b"".join(batch.column(f"{name}_signature").to_pylist()), "<u4").reshape(-1, HASHES)
                for name in "ab"
            )
            alive, equal = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for step, bound in enumerate(least):
                part = slice(step * STEP, (step + 1) * STEP)
                equal[alive] += (left[alive, part] == right[alive, part]).sum(axis=1)
                alive = alive[equal[alive] >= bound]
            yield batch.select(["a", "b"]).take(pa.array(alive))

    joined = pairs.join(side("a"), F.col("a").eqNullSafe(F.col("a_id"))).join(side("b"), F.col("b").eqNullSafe(F.col("b_id")))
    return joined.select("a", "b", "a_signature", "b_signature").mapInArrow(compare, f"a {kind}, b {kind}")


def confirmed(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``pairs`` (a, b) whose full shingle sets have ``4 * intersection >= 3 * union``.

    Only the texts of documents in a pair are shuffled; the others are dropped in the scan by a bit set of fixed size.
    """
    kind = pairs.schema["a"].dataType.simpleString()
    needed = pairs.select(F.xxhash64("a").alias("cell")).union(pairs.select(F.xxhash64("b").alias("cell")))
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    texts = named.where(in_bit_set(F.xxhash64("doc_id"), bit_set(needed, NEEDED_BITS), NEEDED_BITS))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "a_text", 1 << 20):
                with np.errstate(over="ignore"):
                    both = pa.concat_arrays([part.column("a_text"), part.column("b_text")])
                    shingles, edges = shingle_sets(Words(both))
                rows = part.num_rows
                good = []
                for row in range(rows):
                    left = shingles[edges[row] : edges[row + 1]]
                    right = shingles[edges[rows + row] : edges[rows + row + 1]]
                    common = len(np.intersect1d(left, right, assume_unique=True))
                    good.append(DENOMINATOR * common >= NUMERATOR * (len(left) + len(right) - common) and common > 0)
                yield part.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    side = lambda name: texts.select(F.col("doc_id").alias(f"{name}_id"), F.col("text").alias(f"{name}_text"))
    joined = pairs.join(side("a"), F.col("a").eqNullSafe(F.col("a_id"))).join(side("b"), F.col("b").eqNullSafe(F.col("b_id")))
    return joined.select("a", "b", "a_text", "b_text").mapInArrow(check, f"a {kind}, b {kind}").distinct()


def block_pairs(members: DataFrame) -> DataFrame:
    """``members`` (grp, doc_id, label) in pairs of blocks: grp, x, y, block, doc_id, label.

    Members of a group are ranked by label and dealt into blocks of ``BLOCK``. Two blocks meet unless both hold
    one and the same label, so a large component is not compared with itself, and it meets each foreign block once.
    """
    placed = ranked(members, ["grp"], ["label", "doc_id"]).withColumn("block", F.floor(F.col("rank") / BLOCK).cast("int"))
    blocks = placed.groupBy("grp", "block").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    side = lambda name: blocks.select("grp", F.col("block").alias(name), F.col("low").alias(f"{name}_low"), F.col("high").alias(f"{name}_high"))
    alike = (F.col("x_low") == F.col("x_high")) & (F.col("y_low") == F.col("y_high")) & (F.col("x_low") == F.col("y_low"))
    meet = side("x").join(side("y"), "grp").where((F.col("x") <= F.col("y")) & ~alike).select("grp", "x", "y")
    sides = meet.select("grp", F.explode(F.array_distinct(F.array("x", "y"))).alias("block"), "x", "y")
    return placed.join(sides, ["grp", "block"]).select("grp", "x", "y", "block", "doc_id", "label")


def meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each (grp, x, y) of a sorted partition: two blocks at most."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in ("grp", "x", "y")], axis=1)
        edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for start, end in zip(edges, edges[1:], strict=False):
            if start == end:
                continue
            key = tuple(keys[start])
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, end - start))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def forest(left: np.ndarray, right: np.ndarray, size: int) -> list[int]:
    """Positions of the pairs that connect what earlier ones did not."""
    root = list(range(size))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    kept = []
    for position, (i, j) in enumerate(zip(left.tolist(), right.tolist(), strict=True)):
        i, j = find(i), find(j)
        if i != j:
            root[i] = j
            kept.append(position)
    return kept


def least_nodes(left: np.ndarray, right: np.ndarray, size: int) -> np.ndarray:
    """The least node connected with each of ``size`` nodes."""
    root = list(range(size))
    for i, j in zip(left.tolist(), right.tolist(), strict=True):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        while root[j] != j:
            root[j] = root[root[j]]
            j = root[j]
        if i < j:
            root[j] = i
        else:
            root[i] = j
    found = np.array(root, np.int64)
    while (found != found[found]).any():
        found = found[found]
    return found


def open_pairs(table: pa.Table) -> np.ndarray:
    """Which rows may meet, as a matrix: of different labels, in different blocks if two meet, each pair once."""
    _, labels = np.unique(np.array(table.column("label").to_pylist()), return_inverse=True)
    block = table.column("block").to_numpy()
    x, y = table.column("x")[0].as_py(), table.column("y")[0].as_py()
    differ = labels[:, None] != labels[None, :]
    return differ & ((block[:, None] == x) & (block[None, :] == y) if x != y else np.triu(differ, 1))


def met(rows: DataFrame, columns: list[str], links) -> DataFrame:
    """(a, b) of a spanning forest of the ``links(table, may_meet)`` within each meeting of two blocks."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in meetings(batches):
            left, right = links(table, open_pairs(table))
            kept = forest(left, right, table.num_rows)
            ids = table.column("doc_id").combine_chunks()
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(left[kept])), ids.take(pa.array(right[kept]))], names=["a", "b"])

    keys = ["grp", "x", "y"]
    # The work of a meeting is not in its bytes, so the number of partitions is given and stays as it is.
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select(*keys, "block", "doc_id", "label", *columns).repartition(parts, *keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(compare, f"a {kind}, b {kind}").distinct()


def likely_links(miss: float):
    """Pairs whose signatures leave a chance of ``miss`` or more, batch by batch of hashes."""
    least = least_matches(NUMERATOR / DENOMINATOR, miss)

    def links(table: pa.Table, may_meet: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        signature = np.frombuffer(b"".join(table.column("signature").to_pylist()), "<u4").reshape(-1, HASHES)
        counts = table.column("n_shingles").to_numpy()
        smaller, larger = np.minimum(counts[:, None], counts[None, :]), np.maximum(counts[:, None], counts[None, :])
        left, right = np.nonzero(may_meet & (DENOMINATOR * smaller >= NUMERATOR * larger))
        equal = np.zeros(len(left), np.int64)
        for step, bound in enumerate(least):
            part = slice(step * STEP, (step + 1) * STEP)
            equal += (signature[left, part] == signature[right, part]).sum(axis=1)
            alive = equal >= bound
            left, right, equal = left[alive], right[alive], equal[alive]
        return left, right

    return links


def exact_links(table: pa.Table, may_meet: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs whose full shingle sets have ``4 * intersection >= 3 * union``, counted by products of 0-1 matrices."""
    with np.errstate(over="ignore"):
        shingles, edges = shingle_sets(Words(table.column("text").combine_chunks()))
    counts = np.diff(edges)
    owner = np.repeat(np.arange(len(counts)), counts)
    _, number, times = np.unique(shingles, return_inverse=True, return_counts=True)
    shared = times[number] > 1
    owner, number = owner[shared], number[shared]
    _, number = np.unique(number, return_inverse=True)
    order = np.argsort(number, kind="stable")
    owner, number = owner[order], number[order]
    common = np.zeros((len(counts), len(counts)), np.float32)
    width = int(number[-1]) + 1 if len(number) else 0
    for start in range(0, width, COLUMNS):
        begin, end = np.searchsorted(number, [start, start + COLUMNS])
        present = np.zeros((len(counts), min(COLUMNS, width - start)), np.float32)
        present[owner[begin:end], number[begin:end] - start] = 1
        common += present @ present.T
    union = counts[:, None] + counts[None, :] - common
    return np.nonzero(may_meet & (DENOMINATOR * common >= NUMERATOR * union) & (common > 0))


def contracted(edges: DataFrame) -> DataFrame:
    """(low, high), distinct: the ``edges`` (a, b) that a task sees as stars around the least node of each connected group.

    Edges of one node, its greater end, meet in one task, so a copy linked with many heads leaves one edge.
    """
    kind = edges.schema["a"].dataType.simpleString()

    def starred(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        both = pa.concat_arrays([c for name in "ab" for c in table.column(name).chunks]).dictionary_encode()
        ordered = pc.array_sort_indices(both.dictionary)
        place = np.empty(len(ordered), np.int64)
        place[ordered.to_numpy()] = np.arange(len(ordered))
        codes = place[both.indices.to_numpy(zero_copy_only=False)]
        least = least_nodes(codes[: table.num_rows], codes[table.num_rows :], len(place))
        leaves = np.flatnonzero(least != np.arange(len(least)))
        nodes = both.dictionary.take(ordered)
        return pa.RecordBatch.from_arrays([nodes.take(pa.array(least[leaves])), nodes.take(pa.array(leaves))], names=["low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= FOREST_EDGES:
                yield starred(held)
                held = []
        if sum(b.num_rows for b in held):
            yield starred(held)

    return edges.select("a", "b").repartition(F.greatest("a", "b")).mapInArrow(run, f"low {kind}, high {kind}").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (least node reachable) of the graph with ``edges`` (a, b), for nodes that have an edge.

    Edges are first contracted to stars inside tasks. A node that is then the greater end of one edge and has no other takes
    the component of its other end, so it is set aside; in a large group of copies that is nearly every node. Among the others
    large-star and small-star steps alternate until every node is the centre of a star or a leaf of one, around the
    least node. The result of each pair of steps is stored as a table (a checkpoint would carry
    the constraints of all earlier steps along, which multiply); edges in both directions, and the edges a step makes of one, come from an
    explode, so that a plan holds few joins.
    """
    def turned(frame: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
        made = F.array(*[F.struct(F.col(u).alias("u"), F.col(v).alias("v")) for u, v in pairs])
        return frame.select(F.explode(made).alias("e")).select("e.u", "e.v").where("u <> v").distinct()

    drawn = stored(contracted(edges))
    degrees = drawn.select(F.col("high").alias("node"), F.lit(1).alias("ends")).union(drawn.select("low", F.lit(2)))
    single = degrees.groupBy("node").agg(F.sum("ends").alias("ends")).where("ends = 1")
    marked = stored(drawn.join(single, F.col("high").eqNullSafe(F.col("node")), "left"))
    aside = marked.where("ends = 1").select("low", "high")
    stars = marked.where("ends IS NULL").select(F.col("low").alias("u"), F.col("high").alias("v"))
    while True:
        ends = stars.select(F.col("v").alias("node"), F.lit(1).alias("leaf")).union(stars.select("u", F.lit(0)))
        roles = ends.groupBy("node").agg(F.sum("leaf").alias("leaf"), F.min("leaf").alias("centre"))
        if roles.where("leaf > 1 OR (leaf = 1 AND centre = 0)").isEmpty():
            break
        both = turned(stars, ("u", "v"), ("v", "u"))
        centre = both.groupBy(F.col("u").alias("_u")).agg(F.least(F.min("v"), F.col("_u")).alias("m"))
        large = both.where("v > u").join(centre, F.col("u").eqNullSafe(F.col("_u"))).select(F.col("m").alias("u"), "v").where("u <> v").distinct()
        floor = large.groupBy(F.col("v").alias("_v")).agg(F.min("u").alias("m"))
        small = large.join(floor, F.col("v").eqNullSafe(F.col("_v"))).select("m", "u", "v")
        stars = stored(turned(small, ("m", "u"), ("m", "v")))
    centres = stars.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
    inner = stars.select(F.col("v").alias("node"), F.col("u").alias("component")).union(centres)
    held = aside.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct()
    inner = stored(inner.union(held).groupBy("node").agg(F.min("component").alias("component")))
    outer = aside.join(inner, F.col("low").eqNullSafe(F.col("node"))).select(F.col("high").alias("node"), "component")
    return inner.union(outer)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", miss: float = 1e-6
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Sets are the distinct five-word shingles of the text (A-Z in lower case); a text of fewer words is one shingle.
    Documents are linked if their sets' Jaccard similarity is 0.75 or more; a component is named after its least id,
    and that document is kept.

    Equal sets are found first by a digest and go on as one node. Nodes that agree in one of 32 bands share a
    bucket. First each is compared with its bucket's least node only. A bucket of copies costs one comparison per
    copy. In buckets whose nodes are still in several components, members of different components meet
    block by block inside tasks; what the signatures cannot rule out is joined to clusters, and within a cluster the
    active members meet once more, in blocks with their full sets. Tasks return spanning forests, so no step returns
    more rows than it has members, nothing is capped, and no pair of different components in a bucket goes untested.
    Signatures are compared 16 hashes at a time; a pair is given up as soon as the posterior chance of reaching the
    threshold is below ``miss``, and every link is confirmed on full sets.

    Results for special input: NULL and blank texts have no shingles and are linked with nothing. Rows without
    an id are linked with nothing, have component NULL and are kept. Rows that share an id are one document. An empty table
    gives an empty result; other columns are ignored.
    """
    rows = stored(signatures(docs, id_col, text_col))
    linked = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    firsts = linked.groupBy(F.col("d1").alias("_d1"), F.col("d2").alias("_d2")).agg(F.min("doc_id").alias("node"))
    same_set = F.col("d1").eqNullSafe(F.col("_d1")) & F.col("d2").eqNullSafe(F.col("_d2"))
    nodes = stored(
        linked.join(firsts, same_set & (F.col("doc_id") == F.col("node"))).dropDuplicates(["doc_id", "d1", "d2"])
        .select("doc_id", "n_shingles", "signature")
    )
    width = 4 * ROWS
    keys = [F.xxhash64(F.lit(band), F.substring("signature", band * width + 1, width)) for band in range(HASHES // ROWS)]
    banded = nodes.select("doc_id", "n_shingles", F.explode(F.array(*keys)).alias("bucket"))
    buckets = banded.groupBy("bucket").agg(F.min("doc_id").alias("hub"), F.count(F.lit(1)).alias("size")).where("size > 1")
    buckets = buckets.withColumnRenamed("bucket", "_bucket")
    members = stored(
        banded.join(buckets, F.col("bucket").eqNullSafe(F.col("_bucket"))).select("bucket", "doc_id", "n_shingles", "hub", "size")
    )

    tested = members.where("doc_id <> hub").select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct()
    labels = components(confirmed(stored(pruned(tested, nodes, miss)), docs, id_col, text_col))

    labelled = members.where("size > 2").join(labels, F.col("doc_id").eqNullSafe(F.col("node")), "left").select(
        "bucket", "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("label")
    )
    mixed_buckets = labelled.groupBy(F.col("bucket").alias("_bucket")).agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    open_ = labelled.join(mixed_buckets, F.col("bucket").eqNullSafe(F.col("_bucket"))).select(
        F.col("bucket").alias("grp"), "doc_id", "label"
    )
    signed = nodes.select(F.col("doc_id").alias("_id"), "n_shingles", "signature")
    in_blocks = block_pairs(open_)
    meeting = in_blocks.join(signed, F.col("doc_id").eqNullSafe(F.col("_id")))
    likely = stored(met(meeting, ["n_shingles", "signature"], likely_links(miss)))
    if not likely.isEmpty():
        suspects = components(likely.union(labels.select("node", "component"))).withColumnRenamed("component", "cluster")
        active = likely.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
        clustered = (
            active.join(suspects, F.col("doc_id").eqNullSafe(F.col("node"))).drop("node")
            .join(labels, F.col("doc_id").eqNullSafe(F.col("node")), "left")
            .select(F.xxhash64("cluster").alias("grp"), "doc_id", F.coalesce("component", "doc_id").alias("label"))
        )
        clustered = stored(clustered)
        named = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
        needed = bit_set(clustered.select(F.xxhash64("doc_id").alias("cell")), NEEDED_BITS)
        texts = named.where(in_bit_set(F.xxhash64("_id"), needed, NEEDED_BITS))
        meeting = block_pairs(clustered).join(texts, F.col("doc_id").eqNullSafe(F.col("_id")))
        more = stored(met(meeting, ["text"], exact_links))
        if not more.isEmpty():
            labels = components(more.union(labels.select("node", "component")))

    by_class = firsts.join(labels.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").select(
        "_d1", "_d2", F.coalesce("component", "node").alias("component")
    )
    placed = rows.join(by_class, same_set & (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), "left")
    component = F.coalesce("component", "doc_id")
    return placed.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )
