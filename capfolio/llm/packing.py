"""Packing token sequences: exact complements over a length histogram, and best fit with a segment tree."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from capfolio.llm.common import cut, ranked
from capfolio.llm.tokens import word_tokenizer
from capfolio.llm.words import chunks

RANK_BITS = 40
SLICE_BYTES = 4 << 20


def token_batches(batches, tokenizer_path: str, end_id: int):
    """(ids column, token ids, edges) for slices of a task's Arrow batches (doc_id, text)."""
    tokenizer = word_tokenizer(tokenizer_path)
    for batch in batches:
        for part in chunks(batch, most=SLICE_BYTES):
            ids, starts = tokenizer.ids(part.column("text"))
            edges = starts + np.arange(len(starts))
            closed = np.full(edges[-1], end_id, np.uint32)
            inner = np.ones(edges[-1], bool)
            inner[edges[1:] - 1] = False
            closed[inner] = ids
            yield part.column("doc_id"), closed, edges
            pa.default_memory_pool().release_unused()  # workers outlive their task, and other stages run beside them


def named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def token_pieces(
    docs: DataFrame, tokenizer_path: str, limit: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and one end id, cut every ``limit`` ids.

    A NULL or blank text is the end id alone. Each task reads its rows once, in slices of a few MB.
    """
    source = named(docs, id_col, text_col)
    schema = T.StructType([
        T.StructField("doc_id", source.schema["doc_id"].dataType), T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
    ])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for owners, ids, edges in token_batches(batches, tokenizer_path, end_id):
            raw = memoryview(ids.astype("<u4").tobytes())
            rows, numbers, starts, lengths, sums = [], [], [], [], []
            for row, (begin, end) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
                for number, start in enumerate(range(begin, end, limit)):
                    stop = min(start + limit, end)
                    rows.append(row)
                    numbers.append(number)
                    starts.append(start - begin)
                    lengths.append(stop - start)
                    sums.append(zlib.crc32(raw[4 * start : 4 * stop]))
            yield pa.RecordBatch.from_arrays(
                [owners.take(pa.array(rows, pa.int64())), pa.array(numbers, pa.int32()), pa.array(starts, pa.int64()),
                 pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())],
                names=schema.names,
            )

    return source.mapInArrow(pieces, schema)


class ComplementIndex:
    """Which lengths, and which sums of two or three of them, are still available."""

    def __init__(self, counts: np.ndarray):
        self.left = counts.copy()
        self.refresh()

    def refresh(self) -> None:
        self.present = self.left > 0
        size = len(self.left)
        power = 1 << (2 * size - 1).bit_length()
        spectrum = np.fft.rfft(self.present.astype(float), power)
        self.pairs = np.fft.irfft(spectrum * spectrum, power)[:size] > 0.5

    def pair(self, gap: int) -> tuple[int, ...] | None:
        if gap < 2 or not self.pairs[gap]:
            return None
        both = self.present[: gap + 1] & self.present[gap::-1]
        if gap % 2 == 0 and self.left[gap // 2] < 2:
            both[gap // 2] = False
        found = np.flatnonzero(both)
        return (int(found[-1]), gap - int(found[-1])) if len(found) else None

    def exact(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three available lengths with sum ``gap``, the largest possible first."""
        if gap == 0:
            return ()
        if self.present[gap]:
            return (gap,)
        if found := self.pair(gap):
            return found
        for first in np.flatnonzero(self.present[: gap + 1] & self.pairs[gap::-1])[::-1].tolist():
            self.take((first,), 1)
            rest = self.pair(gap - first)
            self.take((first,), -1)
            if rest:
                return (first, *rest)
        return None

    def take(self, lengths: tuple[int, ...], times: int) -> bool:
        """Removes ``lengths`` so many times; true if one ran out."""
        for length, each in Counter(lengths).items():
            self.left[length] -= each * times
            self.present[length] = self.left[length] > 0
        return not all(self.present[length] for length in lengths)


def plan_sequences(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths with how often each is used, so that all ``counts[length]`` items are placed.

    The largest remaining length opens a sequence. If one, two or three available lengths fill the rest exactly,
    they are used; else the largest that fits goes in, and the new rest is tried. A pattern is repeated as often as
    its lengths last, so the number of patterns, and the work, depend on the capacity and not on the items.
    """
    index, plan = ComplementIndex(counts), []
    for largest in range(capacity, 0, -1):
        while index.left[largest] > 0:
            pattern: tuple[int, ...] = ()
            gap, add = capacity, (largest,)
            while add:
                index.take(add, 1)
                pattern, gap = pattern + add, gap - sum(add)
                add = index.exact(gap) if gap else ()
                if add is None:
                    fits = np.flatnonzero(index.present[: gap + 1])
                    add = (int(fits[-1]),) if len(fits) else ()
            uses = 1 + min(int(index.left[length]) // each for length, each in Counter(pattern).items())
            index.take(pattern, uses - 1)
            if not all(index.present[length] for length in pattern):
                index.refresh()
            plan.append((pattern, uses))
    return plan


def slots_of(plan: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """For each (pattern, length): the first rank among items of that length, and where these items go."""
    used: Counter[int] = Counter()
    rows, sequence = [], 0
    for pattern, uses in plan:
        offset = 0
        for length, each in Counter(sorted(pattern, reverse=True)).items():
            rows.append((length << RANK_BITS | used[length], used[length], sequence, offset, each))
            used[length] += each * uses
            offset += each * length
        sequence += uses
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("key", "rank", "sequence", "offset", "each"), table.T.copy(), strict=True))


def pack_exact(pieces: DataFrame, limit: int = 4096) -> DataFrame:
    """``pieces`` with sequence_id and offset: ``length`` of each sequence's pieces sums to ``limit`` at most.

    ``pieces`` are kept before they are ranked, since ranking reads them twice. Only the histogram of lengths,
    ``limit`` numbers, reaches the driver. The plan over it says for each length
    which ranks go where; pieces are ranked within their length in a distributed way and look their place up in
    the plan, which is sent to every task (its size depends on ``limit`` alone). Equal lengths are
    interchangeable, so the result is a valid packing whatever the order of ties. An empty table stays empty.
    """
    placed = cut(ranked(cut(pieces), ["length"], ["doc_id", "piece", "ids_crc32"]))
    counts = np.zeros(limit + 1, np.int64)
    for row in placed.groupBy("length").count().collect():
        counts[row["length"]] = row["count"]
    slots = pieces.sparkSession.sparkContext.broadcast(slots_of(plan_sequences(counts, limit)))
    schema = T.StructType([
        *pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())
    ])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = slots.value
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            slot = np.searchsorted(table["key"], length << RANK_BITS | rank, "right") - 1
            turn, place_in = np.divmod(rank - table["rank"][slot], table["each"][slot])
            sequence = table["sequence"][slot] + turn
            offset = table["offset"][slot] + place_in * length
            columns = [batch.column(name) for name in schema.names[:-2]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], names=schema.names)

    return placed.mapInArrow(place, schema)


class CapacityTree:
    """Open sequences by free space, with search for the smallest space that is large enough."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.counts = [0] * (2 * self.width)
        self.open: dict[int, list[int]] = {}

    def add(self, free: int, sequence: int) -> None:
        self.open.setdefault(free, []).append(sequence)
        self.change(free, 1)

    def change(self, free: int, by: int) -> None:
        node = free + self.width
        while node:
            self.counts[node] += by
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(free space, sequence) of the best fit, removed; None if nothing fits."""
        node = need + self.width
        while not self.counts[node]:
            while node & 1:  # up, until there is something to the right
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self.width:
            node = 2 * node if self.counts[2 * node] else 2 * node + 1
        free = node - self.width
        self.change(free, -1)
        return free, self.open[free].pop()


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Positions in ``lengths`` of each sequence's items, in order of placement."""
    tree, sequences = CapacityTree(capacity), []
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = tree.take(lengths[item])
        if found is None:
            found = capacity, len(sequences)
            sequences.append([])
        free, sequence = found
        sequences[sequence].append(item)
        tree.add(free - lengths[item], sequence)
    return sequences


def pack_matrices(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 2048,
    end_id: int = 1,
    pad_id: int = 0,
    window_tokens: int = 4 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Rows of a packed token matrix: sequence_id, doc_ids, pieces, cu_seqlens, n_tokens, input_ids, position_ids.

    ``input_ids`` has ``capacity`` little-endian unsigned 32-bit ids, filled up with ``pad_id``; segment ``i`` of
    it, ``cu_seqlens[i]:cu_seqlens[i + 1]``, is piece ``pieces[i]`` of ``doc_ids[i]``. ``position_ids`` (the same
    layout) restart at 0 with every segment, padding included. Each document ends with ``end_id``; one longer
    than the capacity is cut there, so pieces in order give back all its ids.

    Each task packs windows of ``window_tokens`` ids of its own input by best fit decreasing: no shuffle, memory
    bound by the window, and at most a few open sequences lost per window. Sequence ids are unique: the task's
    partition number, then a running number. A NULL or blank text is the end id alone; a table
    without rows gives no sequences; repeated rows are packed as often as they occur; NULL ids are kept.
    """
    source = named(docs, id_col, text_col)
    kind = source.schema["doc_id"].dataType
    schema = T.StructType([
        T.StructField("sequence_id", T.LongType()), T.StructField("doc_ids", T.ArrayType(kind)),
        T.StructField("pieces", T.ArrayType(T.IntegerType())), T.StructField("cu_seqlens", T.ArrayType(T.IntegerType())),
        T.StructField("n_tokens", T.IntegerType()), T.StructField("input_ids", T.BinaryType()),
        T.StructField("position_ids", T.BinaryType()),
    ])

    def packed(window: list[tuple], owner_type: pa.DataType, first: int) -> Iterator[pa.RecordBatch]:
        columns: list[list] = [[] for _ in schema.names]
        for number, members in enumerate(best_fit_decreasing([len(w[2]) for w in window], capacity)):
            row = np.full(capacity, pad_id, "<u4")
            positions = np.zeros(capacity, "<u4")
            edges = [0]
            for item in members:
                ids = window[item][2]
                row[edges[-1] : edges[-1] + len(ids)] = ids
                positions[edges[-1] : edges[-1] + len(ids)] = np.arange(len(ids))
                edges.append(edges[-1] + len(ids))
            positions[edges[-1] :] = np.arange(capacity - edges[-1])
            values = (
                first + number, [window[i][0] for i in members], [window[i][1] for i in members], edges, edges[-1],
                row.tobytes(), positions.tobytes(),
            )
            for column, value in zip(columns, values, strict=True):
                column.append(value)
        types = [pa.int64(), pa.list_(owner_type), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32(), pa.binary(), pa.binary()]
        for start in range(0, len(columns[0]), 256):
            arrays = [pa.array(c[start : start + 256], t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window, held, used = [], 0, TaskContext.get().partitionId() << 33
        owner_type = None
        for owners, ids, edges in token_batches(batches, tokenizer_path, end_id):
            owner_type = owners.type
            for owner, begin, end in zip(owners.to_pylist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                for number, start in enumerate(range(begin, end, capacity)):
                    window.append((owner, number, ids[start : min(start + capacity, end)]))
                held += end - begin
                if held >= window_tokens:
                    for batch in packed(window, owner_type, used):
                        used += batch.num_rows
                        yield batch
                    window, held = [], 0
        if window:
            yield from packed(window, owner_type, used)

    return source.mapInArrow(pack, schema)


def write_matrices(packed: DataFrame, path: str) -> None:
    """The packed rows as Parquet at ``path``, each row's ids and positions as fixed-size binary values."""
    packed.write.parquet(path)
