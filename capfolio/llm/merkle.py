"""A Merkle tree over a dataset, with the proof of every row, by time-forward processing.

Nodes are labelled in topological order: a node of level ``k`` and index ``i`` sends its digest forward to the parent
``(k + 1, i // 8)``, and a parent works when the queue's least label is its own, so all of its children's messages
have come. The queue is external: Spark's shuffle delivers messages by the label of the block of ``8 ** 4`` leaves
they go to, and within a block a heap orders them. A block's own top node is a message of the next round, so a corpus of
any size takes one round per four levels, each with 1/4096 of the rows of the one before. Then the sweep runs in
reverse: each node hands its proof suffix, with the sibling digests put in front, down to its children.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capfolio.llm.common import cut, ranked, stored

ARITY = 8
BLOCK_LEVELS = 4
BLOCK = ARITY**BLOCK_LEVELS
STEP = pa.struct([("left", pa.string()), ("right", pa.string())])
PROOF = "array<struct<left: string, right: string>>"


def field_text(value: Column) -> Column:
    """A value as its UTF-8 byte count, ``:`` and its text; ``-`` for NULL. No two values read alike."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*[field_text(v) for v in values]), 256)


def digest_of(children: Sequence[str]) -> str:
    return sha256("".join(children).encode()).hexdigest()


def height(leaves: int) -> int:
    """Levels above ``leaves`` leaves: the least number of foldings that leave one node."""
    levels = 0
    while leaves > 1:
        leaves, levels = -(-leaves // ARITY), levels + 1
    return levels


def sweep_up(digests: Sequence[str], levels: int) -> dict[tuple[int, int], list[str]]:
    """The children's digests of each inner node of one block, by label; the block's top node is ``(levels, 0)``."""
    queue = [((1, i // ARITY), i, d) for i, d in enumerate(digests)] if levels else []
    inner: dict[tuple[int, int], list[str]] = {}  # already a heap: labels ascend
    while queue:
        label = queue[0][0]
        received = []
        while queue and queue[0][0] == label:
            received.append(heapq.heappop(queue)[2])
        inner[label] = received
        level, index = label
        if level < levels:
            heapq.heappush(queue, ((level + 1, index // ARITY), index, digest_of(received)))
    return inner


def sweep_down(inner: dict[tuple[int, int], list[str]], levels: int, suffix: list[dict]) -> list[list[dict]]:
    """The proof of each leaf of one block, from the proof ``suffix`` of its top node."""
    proofs: list[list[dict]] = []
    queue = [(-levels, 0, suffix)]
    while queue:
        level, index, rest = heapq.heappop(queue)
        if level == 0:
            proofs.append(rest)
            continue
        children = inner[-level, index]
        for place in range(len(children)):
            siblings = {"left": "".join(children[:place]), "right": "".join(children[place + 1 :])}
            heapq.heappush(queue, (level + 1, index * ARITY + place, [siblings, *rest]))
    return proofs


def in_order(block: pa.Table) -> tuple[pa.Table, list[str], int]:
    """A block's rows by rank, their digests, and how many levels are folded in this round."""
    block = block.sort_by("rank")
    leaves = block.column("tree_leaves")[0].as_py()
    return block, block.column("digest").to_pylist(), min(BLOCK_LEVELS, height(leaves))


def fold_block(block: pa.Table) -> pa.Table:
    block, digests, levels = in_order(block)
    top = digest_of(sweep_up(digests, levels)[levels, 0]) if levels else digests[0]
    first = block.slice(0, 1)
    leaves = first.column("tree_leaves")[0].as_py()
    return pa.table({
        "tree": first.column("tree"),
        "rank": pa.array([first.column("rank")[0].as_py() // BLOCK], pa.int64()),
        "digest": pa.array([top], pa.string()),
        "tree_leaves": pa.array([-(-leaves // BLOCK)], pa.int64()),
    })


def prove_block(block: pa.Table, tops: pa.Table) -> pa.Table:
    proofs: list[list[dict]] = []
    if block.num_rows:
        block, digests, levels = in_order(block)
        proofs = sweep_down(sweep_up(digests, levels), levels, tops.column("proof")[0].as_py())
    for name in ("subroot", "root"):
        value = tops.column(name)[0].as_py() if block.num_rows else None
        block = block.append_column(name, pa.array([value] * block.num_rows, pa.string()))
    return block.append_column("proof", pa.array(proofs, pa.list_(STEP)))


def rounds_of(leaves: DataFrame) -> list[DataFrame]:
    """``leaves`` (tree, rank, digest, tree_leaves and more) and the block tops of each round; the last has the roots."""
    most = leaves.agg(F.max("tree_leaves")).first()[0] or 0
    found = [leaves]
    for _ in range(-(-height(most) // BLOCK_LEVELS)):
        messages = found[-1].select("tree", "rank", "digest", "tree_leaves")
        tops = messages.groupBy("tree", F.floor(F.col("rank") / BLOCK)).applyInArrow(
            fold_block, "tree string, rank long, digest string, tree_leaves long"
        )
        found.append(cut(tops))
    return found


def proofs_of(rounds: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The leaves of ``rounds`` with what ``tops`` (tree, subroot, root, proof) says of their trees' roots, proofs extended."""
    found = tops.withColumn("rank", F.lit(0).cast("long"))
    for nodes in reversed(rounds[:-1] or rounds):
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema)
        blocks = nodes.groupBy("tree", F.floor(F.col("rank") / BLOCK))
        delivered = found.select("tree", "rank", "subroot", "root", "proof").groupBy("tree", "rank")
        found = blocks.cogroup(delivered).applyInArrow(prove_block, f"{schema}, subroot string, root string, proof {PROOF}")
    return found


def with_leaves(frame: DataFrame) -> DataFrame:
    """``frame`` with ``tree_leaves``, the rows of its tree."""
    sizes = frame.groupBy(F.col("tree").alias("_tree")).agg(F.count(F.lit(1)).alias("tree_leaves"))
    return frame.join(sizes, F.col("tree").eqNullSafe(F.col("_tree"))).drop("_tree")


def merkle_manifest(leaves: DataFrame, tree: str, order: str) -> DataFrame:
    """Each row of ``leaves`` with ``subroot``, ``root`` and ``proof``.

    ``leaves`` has a column ``leaf`` (lower-case hex). The rows of each value of ``tree`` make a tree in the order of
    ``order``; the roots of these, in the order of ``tree``, make the whole tree. ``proof`` has a step per level, from the leaf
    up: the digests to the ``left`` and to the ``right`` within the run. Folding a leaf with it gives ``root``.

    NULL is a tree of its own and comes first, as does a NULL in ``order``; rows that tie there are ordered by leaf, and
    repeated rows are leaves each. A tree of one row is its leaf. An empty table gives no rows. Other columns are kept, but for those named as the new ones. Texts do not move: only
    digests are shuffled, and a hot tree is spread over blocks of 4 096 rows.
    """
    others = [c for c in leaves.columns if c not in ("leaf", tree, order, "subroot", "root", "proof")]
    carried = [F.col(c).alias(f"kept_{i}") for i, c in enumerate(others)]
    own = leaves.select(F.col(tree).cast("string").alias("tree"), F.col(tree).alias("tree_value"), F.col(order).alias("place"), F.col("leaf").alias("digest"), *carried)
    first = stored(with_leaves(ranked(own, ["tree"], ["place", "digest"])))
    rounds = rounds_of(first)
    subroots = rounds[-1].select(F.lit(None).cast("string").alias("tree"), F.col("tree").alias("name"), "digest")
    top_rounds = rounds_of(cut(with_leaves(ranked(subroots, ["tree"], ["name"]))))
    none = F.lit(None).cast("string")
    root = top_rounds[-1].select("tree", none.alias("subroot"), F.col("digest").alias("root"), F.array().cast(PROOF).alias("proof"))
    tops = proofs_of(top_rounds, root).select(F.col("name").alias("tree"), F.col("digest").alias("subroot"), "root", "proof")
    return proofs_of(rounds, cut(tops)).select(
        F.col("place").alias(order), F.col("tree_value").alias(tree), *[F.col(f"kept_{i}").alias(c) for i, c in enumerate(others)],
        F.col("digest").alias("leaf"), "subroot", "root", "proof",
    )


def proof_text(proof: Column) -> Column:
    """All sibling digests of a proof, level by level, left to right."""
    return F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), "")


def folded(leaf: Column, proof: Column) -> Column:
    """The root that ``leaf`` and the siblings of ``proof`` give."""
    return F.aggregate(proof, leaf, lambda have, s: F.sha2(F.concat(s["left"], have, s["right"]), 256))
