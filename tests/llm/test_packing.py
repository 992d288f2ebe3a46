import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from compare import connect, difference
from conftest import SMALL
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from capfolio.llm import tokens
from capfolio.llm.packing import best_fit_decreasing, pack_exact, pack_matrices, plan_sequences, token_batches, token_pieces
from capfolio.llm.queries import ORACLE_SQL, QUERIES
from capfolio.llm.tokens import WordTokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def encoded(rows):
    tokenizer = Tokenizer.from_file(PATH)
    return Counter((r[0], tuple(tokenizer.encode(r[1] or "", add_special_tokens=False).ids) + (1,)) for r in rows)


def test_pieces_give_back_all_ids_and_fit(docs, encoded, nothing):
    limit = 100
    got = pack_exact(token_pieces(docs, PATH, limit=limit), limit=limit).collect()
    want = Counter()
    for (doc_id, ids), times in encoded.items():
        for number, start in enumerate(range(0, len(ids), limit)):
            part = np.array(ids[start : start + limit], "<u4")
            want[doc_id, number, start, len(part), zlib.crc32(part.tobytes())] += times
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= limit
    assert len(sequences) <= math.ceil(sum(r.length for r in got) / limit) + 1
    assert pack_exact(token_pieces(nothing, PATH), 4096).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_item_once(seed):
    random.seed(seed)
    capacity = random.choice([1, 2, 7, 50, 300])
    counts = np.array([0] + [random.choice([0, 0, 1, 3, 40]) for _ in range(capacity)])
    plan = plan_sequences(counts, capacity)
    placed = np.zeros_like(counts)
    for pattern, uses in plan:
        assert uses > 0 and sum(pattern) <= capacity
        for length in pattern:
            placed[length] += uses
    assert (placed == counts).all()


def test_exact_complements_are_found():
    counts = np.zeros(101, np.int64)
    counts[[60, 40, 55, 25, 20, 70, 15, 10, 5]] = 1000
    plan = plan_sequences(counts, 100)
    assert sum(uses for _, uses in plan) == 3000  # 300 000 ids in sequences of 100


def test_matrices_round_trip(docs, encoded, nothing):
    capacity = 64
    got = pack_matrices(docs, PATH, capacity=capacity, window_tokens=2000).collect()
    assert len({r.sequence_id for r in got}) == len(got)
    found = Counter()
    for r in got:
        ids, positions = np.frombuffer(r.input_ids, "<u4"), np.frombuffer(r.position_ids, "<u4")
        assert len(ids) == len(positions) == capacity and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens
        assert not ids[r.n_tokens :].any()
        for doc_id, piece, a, b in zip(r.doc_ids, r.pieces, r.cu_seqlens, r.cu_seqlens[1:]):
            assert positions[a:b].tolist() == list(range(b - a))
            found[doc_id, piece, tuple(ids[a:b].tolist())] += 1
    want = Counter()
    for (doc_id, ids), times in encoded.items():
        for number, start in enumerate(range(0, len(ids), capacity)):
            want[doc_id, number, ids[start : start + capacity]] += times
    assert found == want
    assert pack_matrices(nothing, PATH).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_capacity_tree_finds_the_best_fit(seed):
    random.seed(seed)
    capacity = random.choice([10, 64, 100])
    lengths = [random.randint(1, capacity) for _ in range(300)]
    free, count = [], 0
    for length in sorted(lengths, reverse=True):
        fits = [i for i, f in enumerate(free) if f >= length]
        if fits:
            free[min(fits, key=lambda i: free[i])] -= length
        else:
            free.append(capacity - length)
            count += 1
    sequences = best_fit_decreasing(lengths, capacity)
    assert sorted(i for s in sequences for i in s) == list(range(300))
    assert all(sum(lengths[i] for i in s) <= capacity for s in sequences)
    assert len(sequences) == count


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_match_duckdb(spark, name):
    assert difference(QUERIES[name](spark, SMALL), connect(SMALL), ORACLE_SQL[name]) is None


def test_stages_keep_columns_and_clean_documents(spark, docs, rows, nothing):
    for table in (docs, nothing):
        frame = table
        for name, stage in corpus_pipeline.STAGES:
            frame = stage(spark, frame, SMALL)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert frame.columns == list(corpus_pipeline.COLUMNS)
        assert (frame.count() > 0) == (table is docs)


def test_pipeline_stages_on_their_own(spark, docs, rows):
    stages = dict(corpus_pipeline.STAGES)
    spoken = stages["language_id"](spark, docs, SMALL).select("text").collect()
    letters = lambda t: any(c.isalpha() for c in t or "")
    assert Counter(r.text for r in spoken) == Counter(r[1] for r in rows if letters(r[1]))
    keys = spark.createDataFrame([(i, "qzx " * 40 if i == 9 else r[1], r[2], r[3], r[4]) for i, r in enumerate(rows)], docs.select(*corpus_pipeline.COLUMNS).schema)
    assert stages["language_id"](spark, keys.withColumn("lang", F.when(F.col("doc_id") != 9, F.col("lang"))), SMALL).where("doc_id = 9").isEmpty()
    alone = stages["near_dedup"](spark, docs, SMALL)
    assert alone.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").count() == 0
    mixed = stages["mixing"](spark, docs, SMALL)
    assert mixed.groupBy("doc_id", "text", "source").count().agg(F.max("count")).first()[0] <= 9


def test_pipeline_query(spark):
    got = corpus_pipeline.run(spark, SMALL)
    assert got.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0


def test_tokenizer_is_asked_in_portions_and_texts_come_in_small_slices(monkeypatch):
    """A worker's memory: the tokenizer's answers for a few thousand words, and a few MB of text, at a time."""
    loaded = WordTokenizer(PATH)
    plain, asked = loaded.tokenizer, []

    class Counting:
        def encode_batch_fast(self, strings, **options):
            asked.append(len(strings))
            return plain.encode_batch_fast(strings, **options)

    loaded.tokenizer = Counting()
    random.seed(5)
    words = ["".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(12_000)]
    odd = [f"слово{i}" for i in range(6_000)]  # these go to the tokenizer whole
    texts = [" ".join(words), " ".join(odd), None, ""]
    ids, starts = loaded.ids(pa.array(texts))
    assert max(asked) <= 4096 and sum(asked) >= 18_000
    for row, text in enumerate(texts):
        assert ids[starts[row] : starts[row + 1]].tolist() == plain.encode(text or "", add_special_tokens=False).ids

    long = ["so it goes " * 100_000] * 12  # 13 MB
    monkeypatch.setitem(tokens._LOADED, PATH, loaded)
    batch = pa.RecordBatch.from_arrays([pa.array(range(12), pa.int64()), pa.array(long)], names=["doc_id", "text"])
    sizes = [len(owners) for owners, _, _ in token_batches([batch], PATH, 1)]
    assert sum(sizes) == 12 and max(sizes) * len(long[0]) <= 5 << 20
