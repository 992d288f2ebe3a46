"""Probabilistic suffix tree over words: contexts kept by divergence tests, texts scored by longest suffix."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capfolio.llm.common import stored_alone as stored
from capfolio.llm.words import Words, chunks

END = 0x9E3779B97F4A7C15  # the end token; words have hashes of their own
STEP = np.uint64(0xD6E8FEB86659FD93)  # a gram's hash is its last token's plus STEP times that of the gram before it
SYMBOL_BITS = 20
FLUSH = 1 << 20
CHUNK = 1 << 20  # bytes of text that a task holds as arrays of tokens and grams at a time
BATCH = 1 << 16  # grams of a run that a task hands on at a time
BUCKET = 1 << 20  # tokens for each bucket, that is, range of hashes, that one task adds up at a time
LEAST_BITS = 5
CACHE = 1 << 20
MOST_BITS = 1 << 27
BLOCK_BITS = 1 << 18


@dataclass(frozen=True)
class SuffixTree:
    """The model as tables that grow with the corpus.

    ``counts`` (token, c): every training token by its hash. ``weights`` (key, c, gain, n): what one occurrence of a
    gram adds to a text's score above the base, for every gram that is a token, a retained context or an edge of one;
    c is set for tokens. ``frequent`` are tables of the tokens that reach ``min_count``, ``kept`` of the retained contexts and
    ``edges`` of their edges, by length of the context from 1.

    ``symbols``, ``symbol_counts``, ``state_keys``, ``edge_keys``, ``edge_values``, ``backoff`` and ``parent`` are the tree of
    up to two symbols collected as arrays, to look into small models; nothing else uses them.
    """

    counts: DataFrame
    total: int
    distinct: int
    weights: DataFrame
    frequent: DataFrame
    kept: list[DataFrame]
    edges: list[DataFrame]

    @property
    def depth(self) -> int:
        return len(self.kept)

    @cached_property
    def collected(self) -> dict[str, np.ndarray]:
        return collected_tree(self)

    def __getattr__(self, name: str):
        if name in ("symbols", "symbol_counts", "state_keys", "edge_keys", "edge_values", "backoff", "parent"):
            return self.collected[name]
        raise AttributeError(name)


@dataclass(frozen=True)
class Tokens:
    """Texts split into tokens once: a table with one row per about ``CHUNK`` bytes of text.

    ``ids`` and ``sizes`` are the ids and numbers of tokens of its documents, ``words`` the hashes of its distinct tokens and
    ``codes`` all tokens in text order, as places in ``words`` of two bytes, or four where there are more than 65536.
    """

    table: DataFrame

    @cached_property
    def total(self) -> int:
        return self.table.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, n: a + n))).first()[0] or 0

    def union(self, other: Tokens) -> Tokens:
        return Tokens(self.table.union(other.table))


def code_type(distinct: int) -> type:
    return np.uint16 if distinct <= 1 << 16 else np.uint32


def lists_of(parts: list[pa.Array]) -> pa.Array:
    """A list array of whole arrays."""
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, parts)]).astype(np.int32), pa.concat_arrays(parts))


def tokenized(docs: DataFrame, id_col: str | Column = "doc_id", text_col: str = "text") -> Tokens:
    """``docs`` split into tokens, for ``fit_suffix_tree`` and ``score_texts``; NULL is the empty text."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, most=CHUNK):
                words = Words(part.column("text"))
                hashes = np.append(words.hashes(), np.uint64(END))
                codes, edges = closed_texts(words, np.arange(len(hashes), dtype=code_type(len(hashes))), len(hashes) - 1)
                columns = [
                    lists_of([part.column("doc_id")]), lists_of([pa.array(np.diff(edges).astype(np.int32))]),
                    pa.array([hashes.tobytes()], pa.binary()), pa.array([codes.tobytes()], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["ids", "sizes", "words", "codes"])

    ids = F.col(id_col) if isinstance(id_col, str) else id_col
    source = docs.select(ids.alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    split_texts = source.mapInArrow(split, f"ids array<{kind}>, sizes array<int>, words binary, codes binary")
    return Tokens(stored(split_texts, compression="zstd"))


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """For each row of ``Tokens``: its batch, its place there, the hashes of its distinct tokens, their codes, where texts begin."""
    for batch in batches:
        sizes, words, codes = (batch.column(name) for name in ("sizes", "words", "codes"))
        for i in range(batch.num_rows):
            hashes = np.frombuffer(words[i].as_buffer(), np.uint64)
            edges = np.concatenate(([0], np.cumsum(sizes[i].values.to_numpy(zero_copy_only=False), dtype=np.int64)))
            yield batch, i, hashes, np.frombuffer(codes[i].as_buffer(), code_type(len(hashes))), edges


def bucket_bits(tokens: int) -> int:
    """Bits of the numbers of buckets, which grow with the corpus, so that what one task adds up does not."""
    return max(LEAST_BITS, math.ceil(math.log2(max(1, tokens) / BUCKET)))


def starts_of(sorted_keys: np.ndarray, bits: int) -> list[int]:
    """Where each bucket, given by the first ``bits`` bits, begins in ``sorted_keys``, and the end."""
    first = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return [0, *np.searchsorted(sorted_keys, first).tolist(), len(sorted_keys)]


def narrow(numbers: np.ndarray, wide: type) -> bytes:
    """The numbers in a byte each, or in ``wide`` ones where one is 256 or more."""
    return numbers.astype(np.uint8 if numbers.max() < 256 else wide).tobytes()


def widened(numbers: bytes, count: int, wide: type) -> np.ndarray:
    return np.frombuffer(numbers, np.uint8 if len(numbers) == count else wide).astype(wide)


def joined(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    """The numbers in all binary values of a column."""
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def closed_texts(words: Words, table: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Values of all tokens, each text followed by its end, and where texts begin."""
    edges = words.starts + np.arange(len(words.starts))
    found = np.full(edges[-1], end, table.dtype)
    inner = np.ones(edges[-1], bool)
    inner[edges[1:] - 1] = False
    found[inner] = table[words.codes]
    return found, edges


def grams(tokens: np.ndarray, edges: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, ...]]:
    """For each length from 1: places of the grams' last tokens, the grams, and the grams less their last and first token."""
    age = np.arange(len(tokens)) - np.repeat(edges[:-1], np.diff(edges))
    whole = tokens
    yield np.arange(len(tokens)), whole, None, None
    for length in range(2, longest + 1):
        places = np.flatnonzero(age >= length - 1)
        context, suffix = whole[places - 1], whole[places]
        whole = whole.copy()
        whole[places] = tokens[places] + STEP * context
        yield places, whole[places], context, suffix


def may_have(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """False only where a key was certainly not put into the set ``bits``."""
    cell = keys.view(np.uint64) & np.uint64(len(bits) * 64 - 1)
    return (bits[(cell >> np.uint64(6)).astype(np.int64)] >> (cell & np.uint64(63)) & np.uint64(1)).astype(bool)


def bits_of(keys: DataFrame) -> np.ndarray:
    """A bit set over the column ``key``. Its size has a bound; a full set answers "maybe", and exact joins decide.

    It comes to the driver in blocks of ``BLOCK_BITS``, each put together by a task from the distinct bits that fall there.
    """
    bits = min(MOST_BITS, max(1 << 12, 1 << (16 * keys.count()).bit_length()))
    block_bits = min(bits, BLOCK_BITS)

    def block(table: pa.Table) -> pa.Table:
        cells = table.column("cell").to_numpy()
        places = np.zeros(block_bits, np.uint8)
        places[cells % block_bits] = 1
        packed = np.packbits(places, bitorder="little").tobytes()
        return pa.table({"block": pa.array([int(cells[0]) // block_bits], pa.int64()), "bits": pa.array([packed], pa.binary())})

    cells = keys.select(F.pmod("key", F.lit(bits)).alias("cell")).distinct()
    blocks = cells.groupBy(F.floor(F.col("cell") / block_bits)).applyInArrow(block, "block long, bits binary")
    found = np.zeros(bits // 64, np.uint64)
    for row in blocks.toLocalIterator():
        words = np.frombuffer(row["bits"], np.uint64)
        found[row["block"] * len(words) : (row["block"] + 1) * len(words)] = words
    return found


def counted(texts: DataFrame | Tokens, length: int, shorter=None, bits: int = LEAST_BITS, least: int = 1) -> DataFrame:
    """(key, n) of the grams of ``length`` tokens that occur ``least`` times; from length 2 with ``context`` and ``suffix``,
    the grams without their last and first token, and only of grams that ``shorter`` (a broadcast bit set) may have.

    Tasks sum what they meet in runs of about a million keys. A run is handed on in blocks of binary columns, one per
    range of keys: a row per block instead of one per gram. A count takes a byte where a block's counts fit. Blocks are
    sorted by context, whose repeats the shuffle's compression takes out; a pair's suffix follows from key and context.
    """
    names = ["keys", "contexts", "suffixes"][:length]

    def handed_on(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        starts, rows, held = starts_of(columns[0], bits), [], 0
        for bucket, (start, end) in enumerate(zip(starts, starts[1:], strict=False)):
            if start < end:
                *part, times = [c[start:end] for c in columns]
                if length > 1:
                    order = np.argsort(part[1])
                    *part, times = [c[order] for c in (*part, times)]
                rows.append((bucket, *(c.tobytes() for c in part), narrow(times, np.int64)))
                held += end - start
            if rows and (held >= BATCH or bucket == len(starts) - 2):
                bucket_column, *others = zip(*rows, strict=True)
                arrays = [pa.array(bucket_column, pa.int32()), *(pa.array(c, pa.binary()) for c in others)]
                yield pa.RecordBatch.from_arrays(arrays, names=["bucket", *names, "times"])
                rows, held = [], 0

    def merged(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
        *columns, counts = [np.concatenate(c) for c in zip(*parts, strict=True)]
        order = np.argsort(columns[0])
        keys = columns[0][order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
        sums = np.add.reduceat(counts[order], first) if len(first) else counts
        return [*(c[order[first]] for c in columns), sums]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for _, _, hashes, codes, edges in rows_of(batches):
            if length == 1:
                parts.append([hashes, np.bincount(codes, minlength=len(hashes))])
            else:
                *_, (_, *columns) = grams(hashes[codes], edges, length)
                maybe = np.flatnonzero(may_have(shorter.value, columns[1]))
                maybe = maybe[may_have(shorter.value, columns[2][maybe])]
                parts.append([*(c[maybe] for c in columns[: len(names)]), np.ones(len(maybe), np.int64)])
            held += len(parts[-1][0])
            if held >= FLUSH:
                parts = [merged(parts)]
                held = len(parts[0][0])
                if held > FLUSH // 2:
                    yield from handed_on(parts[0])
                    parts, held = [], 0
        if parts:
            yield from handed_on(merged(parts))

    def total(table: pa.Table) -> pa.Table:
        columns = [joined(table.column(name), np.uint64) for name in names]
        sizes = pc.binary_length(table.column("keys")).to_pylist()
        times = [widened(t, n // 8, np.int64) for t, n in zip(table.column("times").to_pylist(), sizes, strict=True)]
        *columns, n = merged([[*columns, np.concatenate(times)]])
        *columns, n = [c[n >= least] for c in (*columns, n)]
        if length == 2:
            columns.append(columns[0] - STEP * columns[1])
        return pa.table([pa.array(c.view(np.int64)) for c in (*columns, n)], names=found)

    found = ["key", "context", "suffix", "n"] if length > 1 else ["key", "n"]
    tokens = texts if isinstance(texts, Tokens) else tokenized(texts, F.lit(None).cast("int"))
    runs = tokens.table.select("sizes", "words", "codes").mapInArrow(
        count, ", ".join(["bucket int", *(f"{name} binary" for name in (*names, "times"))])
    )
    return runs.groupBy("bucket").applyInArrow(total, ", ".join(f"{name} long" for name in found))


def before(numbers: np.ndarray, edges: np.ndarray, steps: int) -> np.ndarray:
    """The symbol ``steps`` tokens earlier in the same text, 0 where there is none."""
    moved = np.zeros_like(numbers)
    moved[steps:] = numbers[:-steps] if steps < len(numbers) else 0
    for step in range(steps):
        starts = edges[:-1] + step
        moved[starts[starts < len(moved)]] = 0
    return moved


def contains(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Position of each key in ``sorted_keys``, -1 where it is missing."""
    if not len(sorted_keys):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, at, -1)


def fit_suffix_tree(
    texts: DataFrame | Tokens, min_count: int = 4, divergence: float = 12.0, discount: float = 0.75, depth: int = 2
) -> SuffixTree:
    """The model of all of ``texts`` (a column ``text``; NULL is the empty text; or ``Tokens``, which saves splitting them).

    Tokens are lower-cased words and one end per text. A context of up to ``depth`` tokens is a candidate, and a token
    after it an edge, if they occur ``min_count`` times together, whatever the size of the corpus; all of them are rows
    of tables. A context is retained if the sum over its edges of ``n * ln(P(token | context) / P(token | suffix))``,
    its divergence from its suffix, is ``divergence`` or more; a retained context keeps its suffix.

    Smoothing: an edge has (n - discount) / N; what is left goes to all other tokens in proportion to the next
    shorter state, down to the base (c + 0.5) / (N + 0.5 (V + 1)), so each state's distribution sums to 1.

    Each length is counted in one scan of the tokens. A gram that reaches ``min_count`` has a context and a suffix that do,
    so a bit set of the shorter ones keeps most others out of the shuffle, and loses none.
    """
    tokens = texts if isinstance(texts, Tokens) else tokenized(texts, F.lit(None).cast("int"))
    total, bits = tokens.total, bucket_bits(tokens.total)
    counts = stored(counted(tokens, 1, bits=bits))
    distinct = counts.count()
    context = counts.sparkSession.sparkContext
    enough = F.col("n") >= min_count
    frequent = [counts.where(enough)]
    for length in range(2, depth + 2):
        shorter = context.broadcast(bits_of(frequent[-1]))
        frequent.append(stored(counted(tokens, length, shorter, bits, min_count)))
        shorter.unpersist()

    base = (F.col("n") + 0.5) / (total + 0.5 * (distinct + 1))
    rates = frequent[0].select("key", base.alias("likely"), base.alias("smooth"))
    states, steps = [], []
    for shorter, longer in zip(frequent, frequent[1:], strict=False):
        lower = rates.select(F.col("key").alias("suffix"), F.col("likely").alias("lower_likely"), F.col("smooth").alias("lower_smooth"))
        edges = longer.join(lower, "suffix").select("key", "context", "n", "lower_likely", "lower_smooth")
        spent = (F.col("seen") - discount * F.col("symbols")) / F.col("times")
        left = lambda share: F.greatest(1 - share, F.lit(1e-12))
        found = stored(
            edges.groupBy("context").agg(
                F.sum(F.col("n") * F.log(F.col("n") / F.col("lower_likely"))).alias("gain"), F.sum("n").alias("seen"),
                F.count(F.lit(1)).alias("symbols"), F.sum("lower_smooth").alias("covered"),
            )
            .join(shorter.withColumnsRenamed({"context": "_head", "suffix": "_suffix", "key": "context", "n": "times"}), "context")
            .select(
                "context", "times", *[c for c in ("_head", "_suffix") if "suffix" in shorter.columns],
                (F.col("gain") - F.col("seen") * F.log("times")).alias("divergence"),
                F.log10(left(spent) / left(F.col("covered"))).alias("backoff"),
            )
        )
        smooth = (F.col("n") - discount) / F.col("times")
        rates = stored(
            edges.join(found.select("context", "times", "backoff"), "context").select(
                "key", "context", "n", (F.col("n") / F.col("times")).alias("likely"), smooth.alias("smooth"),
                (F.log10(smooth / F.col("lower_smooth")) - F.col("backoff")).alias("step"),
            )
        )
        states.append(found)
        steps.append(rates)

    kept: list[DataFrame] = []
    for found in reversed(states):
        own = F.col("divergence") >= divergence
        if kept:
            marks = kept[0].select(F.col("_suffix").alias("context"), F.lit(True).alias("marked")).distinct()
            found = stored(found.join(marks, "context", "left").where(own | F.col("marked")).drop("marked"))
        else:
            found = found.where(own)
        kept.insert(0, found)
    steps = [table.join(held.select("context"), "context", "left_semi") for table, held in zip(steps, kept, strict=True)]

    # A gram occurs as a context just where it occurs, since no text ends with it: both its weights count there.
    none = F.lit(None).cast("long").alias("c")
    parts = counts.select("key", F.col("n").alias("c"), F.lit(0.0).alias("gain"), "n")
    for table, held in zip(steps, kept, strict=True):
        parts = parts.union(table.select("key", none, "step", "n"))
        parts = parts.union(held.select("context", none, "backoff", "times"))
    weights = stored(parts.groupBy("key").agg(F.max("c").alias("c"), F.sum("gain").alias("gain"), F.max("n").alias("n")))
    return SuffixTree(counts.select(F.col("key").alias("token"), F.col("n").alias("c")), total, distinct, weights, frequent[0], kept, steps)


def collected_tree(model: SuffixTree) -> dict[str, np.ndarray]:
    """The states of one and two symbols as arrays, numbered from 1 (0: the root), as ``gains`` takes them."""
    column = lambda frame, name: frame[name].to_numpy(np.int64).view(np.uint64)
    frequent = model.frequent.toPandas()
    order = np.argsort(column(frequent, "key"))
    symbols, counts = column(frequent, "key")[order], frequent["n"].to_numpy(np.int64)[order]
    number = lambda hashes: contains(symbols, hashes) + 1
    base = (counts + 0.5) / (model.total + 0.5 * (model.distinct + 1))
    one, *deeper = [k.toPandas() for k in model.kept[:2]]
    contexts, keys = [column(one, "context")], [number(column(one, "context"))]
    parent, backoff = [np.zeros(len(one) + 1, np.int64)], [np.zeros(1), one["backoff"].to_numpy(float)]
    for two in deeper:
        place = {int(k): i + 1 for i, k in enumerate(contexts[0])}
        contexts.append(column(two, "context"))
        keys.append(number(column(two, "_head")) << SYMBOL_BITS | number(column(two, "_suffix")))
        parent.append(np.array([place[int(k)] for k in column(two, "_suffix")], np.int64))
        backoff.append(two["backoff"].to_numpy(float))
    place = {int(k): i + 1 for i, k in enumerate(np.concatenate(contexts))}
    edge_keys, edge_values = [], []
    for frame in (e.toPandas() for e in model.edges[:2]):
        heads = column(frame, "context")
        last = number(column(frame, "key") - STEP * heads)
        edge_keys.append(np.array([place[int(k)] for k in heads], np.int64) << SYMBOL_BITS | last)
        edge_values.append(np.log10(frame["smooth"].to_numpy(float) / base[last - 1]))
    edge_keys, edge_values = np.concatenate(edge_keys), np.concatenate(edge_values)
    order = np.argsort(edge_keys)
    return {
        "symbols": symbols, "symbol_counts": counts, "state_keys": np.concatenate(keys), "edge_keys": edge_keys[order],
        "edge_values": edge_values[order], "backoff": np.concatenate(backoff), "parent": np.concatenate(parent),
    }


def gains(tree, numbers: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """log10 of the model's over the base probability of each token, by the longest retained suffix before it."""
    keys_one, keys_two, state_one, state_two, edge_keys, edge_values, backoff, parent = tree
    first, second = before(numbers, edges, 1), before(numbers, edges, 2)
    found = contains(keys_one, first)
    state = np.where((first > 0) & (found >= 0), state_one[found] if len(state_one) else 0, 0)
    found = contains(keys_two, second << SYMBOL_BITS | first)
    state = np.where((second > 0) & (first > 0) & (found >= 0), state_two[found] if len(state_two) else 0, state)
    result = np.zeros(len(numbers))
    open_ = state > 0
    while open_.any():
        rows = np.flatnonzero(open_)
        at = contains(edge_keys, state[rows] << SYMBOL_BITS | numbers[rows])
        hit = (at >= 0) & (numbers[rows] > 0)
        result[rows[hit]] += edge_values[at[hit]]
        missed = rows[~hit]
        result[missed] += backoff[state[missed]]
        state[rows[hit]] = 0
        state[missed] = parent[state[missed]]
        open_ = state > 0
    return result


def most_frequent(weights: DataFrame, most: int = CACHE) -> tuple[np.ndarray, ...]:
    """Sorted keys, counts (0: no token) and gains of the most frequent weights, ``most`` at most: a cache, whose size
    changes no result."""
    level = F.floor(F.log2("n") * 4).cast("int")
    rows = dict(weights.groupBy(level.alias("level")).count().collect())
    least, held = max(rows, default=0) + 1, 0
    while rows and least > min(rows) and held + rows.get(least - 1, 0) <= most:
        least -= 1
        held += rows.get(least, 0)
    found = weights.where(level >= least).select("key", F.coalesce("c", F.lit(0)).alias("c"), "gain").toArrow()
    key, c, gain = (found.column(name).to_numpy() for name in ("key", "c", "gain"))
    order = np.argsort(key)
    return key[order], c[order], gain[order]


def score_texts(docs: DataFrame | Tokens, model: SuffixTree, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score: one row per row of ``docs``.

    ``base_score`` uses the counts of all training tokens; ``score`` adds what the longest retained suffix before each
    token gives. That is a sum over the text's grams: a retained context adds its weight on other tokens, an edge the
    difference from that and from the next shorter state. The most frequent grams are looked up inside the task; other
    grams that a bit set does not rule out leave the task in blocks by range of hashes and meet that range of the table of
    weights, in which no gram is hot, since all hot ones are in the cache. Sums by document come back in blocks too.

    A NULL or blank text is the end alone. NULL ids and repeated rows are scored like any other; an empty table
    gives an empty result, and a model of no texts scores every token by the base formula with all counts 0.
    """
    tokens = docs if isinstance(docs, Tokens) else tokenized(docs, id_col, text_col)
    context = tokens.table.sparkSession.sparkContext
    known = context.broadcast((bits_of(model.weights.select("key")), *most_frequent(model.weights)))
    bits = bucket_bits(tokens.total // 4)
    kind = tokens.table.schema["ids"].dataType.simpleString()
    sums = f"chunk long, ids {kind}, sizes array<int>, " + ", ".join(f"{name} binary" for name in SUMS)
    asked = tokens.table.withColumn("chunk", F.monotonically_increasing_id()).mapInArrow(
        scorer(known, model.depth, bits), f"bucket int, {sums}, grams binary"
    )
    bucket = F.shiftrightunsigned("key", 64 - bits).cast("int")
    weights = model.weights.select(bucket.alias("bucket"), "key", F.coalesce("c", F.lit(0)).alias("c"), "gain")
    parts = asked.groupBy("bucket").cogroup(weights.groupBy("bucket")).applyInArrow(looked_up, sums)
    id_type = tokens.table.schema["ids"].dataType.elementType.simpleString()
    added = parts.groupBy("chunk").applyInArrow(
        added_up, f"doc_id {id_type}, n_tokens long, known long, logs double, gain double"
    )
    base = F.col("logs") - F.col("n_tokens") * math.log10(model.total + 0.5 * (model.distinct + 1))
    return added.select(
        "doc_id", "n_tokens", F.col("known").alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"),
        base.alias("base_score"), (base + F.col("gain")).alias("score"),
    )


SUMS = {"owners": np.uint32, "known": np.int64, "logs": np.float64, "gain": np.float64}


def scorer(known, depth: int, bits: int):
    """Per row of ``Tokens``: what the cached grams give to each text, and its other grams, in a row for each bucket, whose
    ``owners`` are steps from one gram's text to the next one's.

    All tokens outside the cache get the count 0 here; the look-up adds the difference for those that it finds.
    """
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits_set, keys, counts, gained = known.value
        for batch, i, hashes, codes, edges in rows_of(batches):
            begins, chunk = edges[:-1], batch.column("chunk")[i].as_py()
            owners = np.repeat(np.arange(len(begins), dtype=np.uint32), np.diff(edges))
            gain = np.zeros(len(codes))
            at = contains(keys, hashes.view(np.int64))
            token_counts = np.where(at >= 0, counts[at], 0) if len(keys) else np.zeros(len(hashes), np.int64)
            rare_owners, rare_keys = [], []
            for length, (places, found, _, _) in enumerate(grams(hashes[codes], edges, depth + 1), 1):
                if length == 1:
                    place, asked = at[codes], may_have(bits_set, hashes)[codes]
                else:
                    maybe = np.flatnonzero(may_have(bits_set, found))
                    places, found = places[maybe], found[maybe]
                    place, asked = contains(keys, found.view(np.int64)), True
                hit = place >= 0
                gain[places[hit]] += gained[place[hit]]
                miss = ~hit & asked
                rare_owners.append(owners[places[miss]])
                rare_keys.append(found[miss])
            total = lambda values: np.add.reduceat(values, begins)
            whole = [
                np.arange(len(begins), dtype=np.uint32), total((token_counts > 0)[codes].astype(np.int64)),
                total(np.log10(token_counts + 0.5)[codes]), total(gain),
            ]
            rare_owners, rare_keys = np.concatenate(rare_owners), np.concatenate(rare_keys)
            buckets = rare_keys >> np.uint64(64 - bits)
            order = np.argsort(buckets << np.uint64(32) | rare_owners)
            rare_owners, rare_keys, buckets = rare_owners[order], rare_keys[order], buckets[order]
            starts = np.flatnonzero(np.diff(buckets.astype(np.int64), prepend=-1))
            ends, n = np.append(starts[1:], len(order)), len(starts)
            binary = lambda first, rest: pa.array([first, *rest], pa.binary())
            spans = [slice(*span) for span in zip(starts.tolist(), ends.tolist(), strict=True)] if n else []
            steps = [narrow(np.diff(rare_owners[span], prepend=np.uint32(0)), np.uint32) for span in spans]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([chunk % (1 << bits), *buckets[starts].tolist()], pa.int32()), pa.array([chunk] * (n + 1), pa.int64()),
                    *(pa.concat_arrays([batch.column(c).slice(i, 1), pa.nulls(n, batch.column(c).type)]) for c in ("ids", "sizes")),
                    binary(whole[0].tobytes(), steps), *(binary(values.tobytes(), [None] * n) for values in whole[1:]),
                    binary(None, [rare_keys[span].tobytes() for span in spans]),
                ],
                names=["bucket", "chunk", "ids", "sizes", *SUMS, "grams"],
            )

    return score


def looked_up(asked: pa.Table, weights: pa.Table) -> pa.Table:
    """The sums by document of a bucket's grams for each row that asks for some; rows that hold whole texts as they are."""
    whole = asked.filter(pc.is_valid(asked.column("sizes"))).select(["chunk", "ids", "sizes", *SUMS])
    asked = asked.filter(pc.is_null(asked.column("sizes")))
    if not asked.num_rows or not weights.num_rows:
        return whole
    key, c, gained = (weights.column(name).to_numpy() for name in ("key", "c", "gain"))
    order = np.argsort(key)
    grams_of = asked.column("grams").to_pylist()
    rows = np.repeat(np.arange(len(grams_of)), [len(g) // 8 for g in grams_of])
    at = contains(key[order], np.frombuffer(b"".join(grams_of), np.int64))
    hit = np.flatnonzero(at >= 0)
    steps = zip(asked.column("owners").to_pylist(), grams_of, strict=True)
    owners = np.concatenate([np.cumsum(widened(o, len(g) // 8, np.uint32), dtype=np.uint32) for o, g in steps])
    owners, rows, at = owners[hit], rows[hit], order[at[hit]]
    if not len(hit):
        return whole
    first = np.flatnonzero(np.concatenate(([True], (owners[1:] != owners[:-1]) | (rows[1:] != rows[:-1]))))
    logs = np.where(c[at] > 0, np.log10(c[at] + 0.5) - math.log10(0.5), 0.0)
    sums = [owners[first], *(np.add.reduceat(v, first) for v in ((c[at] > 0).astype(np.int64), logs, gained[at]))]
    starts = np.searchsorted(rows[first], np.arange(len(grams_of) + 1)).tolist()
    part = lambda values: pa.array([values[s:e].tobytes() for s, e in zip(starts, starts[1:], strict=False)], pa.binary())
    found = pa.table(
        [asked.column("chunk"), *(pa.nulls(len(grams_of), whole.schema.field(c).type) for c in ("ids", "sizes")), *map(part, sums)],
        names=whole.column_names,
    )
    return pa.concat_tables([whole, found.cast(whole.schema)])


def added_up(parts: pa.Table) -> pa.Table:
    """The sums of all rows of one chunk, one row per text."""
    whole = parts.filter(pc.is_valid(parts.column("sizes")))
    ids, sizes = (whole.column(name).combine_chunks().flatten() for name in ("ids", "sizes"))
    found = {name: np.zeros(len(sizes), kind) for name, kind in SUMS.items() if name != "owners"}
    owners = joined(parts.column("owners"), np.uint32)
    for name, values in found.items():
        np.add.at(values, owners, joined(parts.column(name), SUMS[name]))
    return pa.table([ids, sizes.cast(pa.int64()), *map(pa.array, found.values())], names=["doc_id", "n_tokens", *found])
