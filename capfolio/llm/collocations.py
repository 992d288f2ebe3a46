"""Phrases whose words keep company, from exact counts held in weighted acyclic automata."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capfolio.llm.common import UPPER, stored
from capfolio.llm.transducer import CountTransducer, sorted_words

LONGEST = 4
#: Upper case to lower case, tab to space, and whatever ends a piece to a line feed. All are single bytes in UTF-8.
ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
FOLDED = bytes.maketrans(UPPER.encode() + b"\t" + ENDS, UPPER.lower().encode() + b" " + b"\n" * len(ENDS))
SHARD_BYTES = 12 << 20
RANGE_BYTES = 12 << 20
MOST_RANGES = 65536
SAMPLE_BYTES = 8 << 20
SAMPLE_STEP = 61
LEAST_MERGE = 1 << 20
SALTS = 4
RANK_SALTS = 64
Cut = tuple[bytes, bytes, bytes]


def words_of(texts: Sequence[str]) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in order, and the number of the piece that each is in. No piece spans two texts."""
    data = np.frombuffer("\n".join(texts).encode().translate(FOLDED) + b"\n", np.uint8)
    between = (data == 32) | (data == 10)
    at = np.flatnonzero(between)
    lengths = np.diff(at, prepend=-1) - 1
    ends = data[at] == 10
    piece = np.cumsum(ends) - ends
    filled = lengths > 0
    offsets = np.concatenate(([0], np.cumsum(lengths[filled])))
    buffers = [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[~between].tobytes())]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, buffers), piece[filled]


def count_phrases(texts: Sequence[str], longest: int = LONGEST) -> CountTransducer:
    words, piece = words_of(texts)
    distinct, codes = sorted_words(words)
    return CountTransducer.of_sequence(codes, piece, distinct, longest)


def cut_shards(cuts: Sequence[Cut], longest: int, shard_bytes: int):
    """Counts texts shard by shard, a language at a time, and cuts each shard's transducer by prefix range."""

    def cut_one(lang: str, texts: list[str]) -> pa.RecordBatch:
        key = lang.encode()
        first = bisect_left(cuts, (key, b"", b""))
        last = bisect_right(cuts, (key + b"\0", b"", b""))
        own = [c[1:] for c in cuts[first:last] if c[0] == key]
        parts = [(first + i, p.to_bytes()) for i, p in enumerate(count_phrases(texts, longest).cut(own)) if len(p)]
        return pa.RecordBatch.from_pydict({
            "range": pa.array([r for r, _ in parts], pa.int32()),
            "lang": pa.array([lang] * len(parts), pa.string()),
            "counts": pa.array([c for _, c in parts], pa.binary()),
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[str]] = {}
        size = 0
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                held.setdefault(lang, []).append(text)
                size += len(text)
                if size >= shard_bytes:
                    yield from map(cut_one, held, held.values())
                    held, size = {}, 0
        yield from map(cut_one, held, held.values())

    return run


def sample_prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every ``SAMPLE_STEP``-th word with the one after it."""
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            words = words_of([text])[0]
            first = words.take(pa.array(np.arange(0, max(0, len(words) - 1), SAMPLE_STEP)))
            second = words.take(pa.array(np.arange(1, max(1, len(words)), SAMPLE_STEP)[: len(first)]))
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([lang.encode()] * len(first), pa.binary()),
                "first": first.cast(pa.binary()), "second": second.cast(pa.binary()),
            })


def range_cuts(texts: DataFrame, range_bytes: int) -> list[Cut]:
    """Prefixes (language, word, word) that cut all phrases into ranges of about ``range_bytes`` of text.

    They come from a random sample of about ``SAMPLE_BYTES`` of text, as the bounds of a range partitioning do; they decide
    where counts are added up, never what they are.
    """
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = min(MOST_RANGES, -(-total // range_bytes))
    if ranges < 2:
        return []
    some = texts.sample(min(1.0, SAMPLE_BYTES / total), seed=11)
    rows = some.mapInArrow(sample_prefixes, "lang binary, first binary, second binary").collect()
    prefixes = sorted((bytes(r["lang"]), bytes(r["first"]), bytes(r["second"])) for r in rows)
    return sorted({prefixes[i * len(prefixes) // ranges] for i in range(1, ranges)}) if prefixes else []


def add_up(least: int):
    """Unions the parts of each range and language as they come, and keeps what was counted ``least`` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total, pending, size = None, None, [], 0

        def merged() -> CountTransducer:
            return CountTransducer.union([total, *pending] if total else pending)

        def done() -> pa.RecordBatch:
            whole = merged()
            return pa.RecordBatch.from_pydict({
                "range": pa.array([key[0]], pa.int32()), "lang": pa.array([key[1]], pa.string()),
                "n_words": pa.array([int(whole.levels[0][2].sum())], pa.int64()),
                "counts": pa.array([whole.kept(least).to_bytes()], pa.binary()),
            })

        for batch in batches:
            columns = [batch.column(c) for c in ("range", "lang", "counts")]
            for i in range(batch.num_rows):
                at, lang, counts = (c[i].as_py() for c in columns)
                if (at, lang) != key:
                    if key is not None:
                        yield done()
                    key, total, pending, size = (at, lang), None, [], 0
                pending.append(CountTransducer.from_bytes(counts))
                size += len(pending[-1])
                if size >= max(LEAST_MERGE, len(total) if total else 0):
                    total, pending, size = merged(), [], 0
        if key is not None:
            yield done()

    return run


REQUEST = "lang string, phrase string, words int, a long, k int, first boolean, part string, range int"


def ask_parts(cuts: Sequence[Cut], least: int):
    """For each phrase of two words or more and each cut of it, a request for the count of either part."""

    def asked(lang: str, phrases: list[bytes], weights: list[int], n: int) -> Iterator[tuple]:
        key = lang.encode()
        for phrase, a in zip(phrases, weights, strict=True):
            words = phrase.split(b" ")
            for k in range(1, n):
                for first, part in ((True, words[:k]), (False, words[k:])):
                    at = bisect_right(cuts, (key, part[0], part[1] if len(part) > 1 else b""))
                    yield lang, phrase, n, a, k, first, b" ".join(part), at

    kinds = [pa.string(), pa.binary(), pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.int32()]
    names = [field.split()[0] for field in REQUEST.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, counts in zip(batch.column("lang").to_pylist(), batch.column("counts"), strict=True):
                found = CountTransducer.from_bytes(counts.as_py())
                for n, phrases in enumerate(found.phrases(), 1):
                    weight = found.levels[n - 1][2]
                    own = np.flatnonzero(weight >= least)
                    for start in range(0, len(own) if n > 1 else 0, 8192):
                        some = own[start : start + 8192].tolist()
                        rows = list(asked(lang, [phrases[i] for i in some], weight[some].tolist(), n))
                        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                        columns = [c.cast(pa.string()) if c.type == pa.binary() else c for c in columns]
                        yield pa.RecordBatch.from_arrays(columns, names)

    return run


def look_up(longest: int):
    """Composes the requests of each range with its transducer, which comes before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, found = None, None
        for batch in batches:
            keys = list(zip(*[batch.column(c).to_pylist() for c in ("range", "lang", "salt")], strict=True))
            is_table = batch.column("counts").is_valid().to_pylist()
            start = 0
            while start < len(keys):
                if is_table[start]:
                    key, found = keys[start], CountTransducer.from_bytes(batch.column("counts")[start].as_py())
                    start += 1
                    continue
                end = start
                while end < len(keys) and keys[end] == keys[start] and not is_table[end]:
                    end += 1
                run_of = batch.slice(start, end - start)
                parts = pc.split_pattern(run_of.column("part"), " ")
                lengths = pc.list_value_length(parts).to_numpy(zero_copy_only=False)
                flat = parts.flatten().cast(pa.large_binary())
                begins = np.concatenate(([0], np.cumsum(lengths)))[:-1]
                words = [
                    flat.take(pa.array(np.where(lengths > n, begins + n, 0), mask=lengths <= n)) for n in range(longest)
                ]
                counts = found.compose(words) if keys[start] == key else np.zeros(end - start, np.int64)
                answer = run_of.drop_columns(["range", "salt", "counts"])
                yield answer.append_column("count", pa.array(counts, pa.int64()))
                start = end

    return run


def whole(number: Column) -> Column:
    """A count as DECIMAL, so that products do not overflow."""
    return number.cast("decimal(19,0)")


def collocations(
    docs: DataFrame,
    least: int = 30,
    most: int = 2000,
    share: int = 80,
    longest: int = LONGEST,
    shard_bytes: int = SHARD_BYTES,
    range_bytes: int = RANGE_BYTES,
) -> DataFrame:
    """The ``most`` phrases of each language whose words keep company best: lang, rank, phrase, a, l, r, n, score.

    Texts in lower case (A-Z) are split into pieces at ``.,;:!?`` and line ends, pieces into words at spaces and tabs. Phrases of
    2 to ``longest`` words within a piece that occur ``least`` times (``a``) are candidates; the score is floor(2000000 a / (l + r))
    at the cut into two parts, counted ``l`` and ``r``, where that is least (ties: the earliest cut); ``n`` are all words of
    the language. A candidate is dropped if a longer one that holds it has ``share`` percent of its count. NULL languages
    are ``und``, NULL texts empty; order is by score, count and phrase (bytewise), so ties are settled. Repeated rows count as
    often as they occur. An empty table gives no rows.

    All occurrences are counted, once: a task counts the phrases of a shard of ``shard_bytes`` in a transducer, cuts it by ranges
    of the first two words, and ranges are added up by union; a word that begins very many phrases is thus spread by its second
    word. Parts are looked up by composing requests, sent to the range of the part, with its transducer.
    """
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    cuts = range_cuts(texts, range_bytes)
    parts = texts.mapInArrow(cut_shards(cuts, longest, shard_bytes), "range int, lang string, counts binary")
    by_range = parts.repartition(len(cuts) + 1, "range").sortWithinPartitions("range", "lang")
    counts = stored(by_range.mapInArrow(add_up(least), "range int, lang string, n_words long, counts binary"))

    requests = counts.select("lang", "counts").mapInArrow(ask_parts(cuts, least), REQUEST)
    requests = requests.withColumns({"salt": F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int"), "counts": F.lit(None).cast("binary")})
    copies = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    tables = counts.select("range", "lang", "counts").withColumn("salt", copies)
    place = ["range", "lang", "salt"]
    meeting = requests.unionByName(tables, allowMissingColumns=True).repartition(*place)
    meeting = meeting.sortWithinPartitions(*place, F.col("counts").isNull(), "part")
    answers = stored(meeting.mapInArrow(look_up(longest), REQUEST.removesuffix(", range int") + ", count long"))

    own = ["lang", "phrase", "words", "a"]
    both = answers.groupBy(*own, "k").agg(
        F.max(F.when(F.col("first"), F.col("count"))).alias("l"), F.max(F.when(~F.col("first"), F.col("count"))).alias("r")
    )
    score = F.expr("2000000BD * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    best = both.groupBy(*own).agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best"))
    # The parts that lack one word are all candidates; shorter ones lie in these, which are counted no less.
    inner = (F.size(F.split("part", " ")) == F.col("words") - 1) & (F.col("words") > 2)
    longer = answers.where(inner).groupBy("lang", F.col("part").alias("phrase")).agg(F.max("a").alias("longer"))
    within = whole(F.col("longer")) * 100 >= whole(F.col("a")) * share
    scored = best.join(longer, ["lang", "phrase"], "left").where(~F.coalesce(within, F.lit(False)))
    phrases = scored.select("lang", "phrase", "a", "best.l", "best.r", "best.score", F.pmod(F.xxhash64("phrase"), F.lit(RANK_SALTS)).alias("salt"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # The first of each slice hold the first of all, so a task ranks RANK_SALTS * most phrases of a language at most.
    sliced = phrases.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order)))
    ranked = sliced.where(F.col("rank") <= most).withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    )
    sizes = counts.groupBy("lang").agg(F.sum("n_words").alias("n"))
    return ranked.where(F.col("rank") <= most).join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
