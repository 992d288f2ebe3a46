"""Trees over the dataset, chats from logs, phrase counts: against brute force on small tables with edges."""

import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from capfolio.llm import merkle
from capfolio.llm.chat import (
    Template,
    events_of_rows,
    fold_events,
    format_turns,
    read_back,
    read_sorted,
    read_within,
    unescaped,
)
from capfolio.llm.collocations import collocations, count_phrases, words_of
from capfolio.llm.common import lower_ascii
from capfolio.llm.merkle import folded, leaf_digest, merkle_manifest, proof_text
from capfolio.llm.transducer import CountTransducer

LOWER = {i: i + 32 for i in range(65, 91)}


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def brute_tree(nodes):
    """The root of ``nodes`` and the proof of each."""
    proofs, owners = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [range(s, min(s + 8, len(nodes))) for s in range(0, len(nodes), 8)]
        for run in runs:
            for j in run:
                for leaf in owners[j]:
                    proofs[leaf].append(("".join(nodes[i] for i in run if i < j), "".join(nodes[i] for i in run if i > j)))
        owners = [[leaf for j in run for leaf in owners[j]] for run in runs]
        nodes = [digest(*[nodes[j] for j in run]) for run in runs]
    return nodes[0], proofs


def brute_manifest(rows):
    """(doc_id, leaf, subroot, root, proof) of rows (doc_id, text, lang, source, n_chars)."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    trees = defaultdict(list)
    for doc_id, text, lang, source, n in rows:
        trees[lang].append((doc_id, digest(*map(field, (doc_id, source, lang, n, text)))))
    order = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    for t in order:
        trees[t].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    below = {t: brute_tree([leaf for _, leaf in trees[t]]) for t in order}
    root, above = brute_tree([below[t][0] for t in order])
    return [
        (doc_id, leaf, below[t][0], root, tuple(p + up))
        for t, up in zip(order, above) for (doc_id, leaf), p in zip(trees[t], below[t][1])
    ]


def manifest(docs):
    leaves = docs.withColumn("leaf", leaf_digest(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]))
    return merkle_manifest(leaves, tree="lang", order="doc_id")


def test_manifest_equals_brute_force(docs, rows):
    got = manifest(docs)
    assert {"keep_id", "rank", "size"} <= set(got.columns)
    found = [(r.doc_id, r.leaf, r.subroot, r.root, tuple((s.left, s.right) for s in r.proof)) for r in got.collect()]
    assert sorted(found, key=repr) == sorted(brute_manifest(rows), key=repr)


def test_a_tree_over_several_blocks_and_tampering(spark):
    n = 9000  # three blocks of 4 096 leaves, two rounds
    docs = spark.range(n).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("Text "), "id").alias("text"), F.lit("en").alias("lang"),
        F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"),
    )
    values = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    changed = F.when(F.col("doc_id") % 3 == 0, leaf_digest(*values, lower_ascii(F.col("text"))))
    leaves = docs.withColumn("changed", changed).withColumn("leaf", leaf_digest(*values, F.col("text")))
    got = merkle_manifest(leaves, tree="lang", order="doc_id")
    got = got.withColumn("again", folded(F.coalesce("changed", "leaf"), F.col("proof"))).withColumn("all", proof_text(F.col("proof")))
    want = {r[0]: r for r in brute_manifest([(i, f"Text {i}", "en", "s", 1) for i in range(n)])}
    for r in got.select("doc_id", "leaf", "subroot", "root", "again", "all").collect():
        _, leaf, subroot, root, proof = want[r.doc_id]
        assert (r.leaf, r.subroot, r.root, r.all) == (leaf, subroot, root, "".join(a + b for a, b in proof))
        assert (r.again == root) == (r.doc_id % 3 != 0)


def test_manifest_of_one_row_and_of_none(spark, nothing):
    assert manifest(nothing).count() == 0
    (only,) = manifest(nothing.unionByName(spark.range(1).select(
        F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("lang"),
        F.lit(None).cast("string").alias("source"), F.lit(None).cast("long").alias("n_chars")))).collect()
    assert only.leaf == only.subroot == only.root == digest("-----") and only.proof == []


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 600])
def test_sweeps_of_one_block(n):
    nodes = [digest(str(i)) for i in range(n)]
    levels = merkle.height(n)
    inner = merkle.sweep_up(nodes, levels)
    root, proofs = brute_tree(nodes)
    assert (merkle.digest_of(inner[levels, 0]) if levels else nodes[0]) == root
    got = merkle.sweep_down(inner, levels, [])
    assert [[(s["left"], s["right"]) for s in p] for p in got] == proofs


# -- chats ------------------------------------------------------------------------

LOG = "conv_id long, message long, seq long, kind string, role string, text string"


def fold(spark, events):
    return sorted(tuple(r) for r in fold_events(spark.createDataFrame(events, LOG)).collect())


def test_events_are_folded_in_order(spark):
    events = [
        (1, 0, 0, "open", "user", "hel"), (1, 0, 1, "delta", None, "lo"), (1, 0, 2, "edit", None, "hi"), (1, 0, 3, "delta", None, "!"),
        (1, 1, 4, "open", "assistant", None), (1, 1, 5, "delta", None, "bad"), (1, 1, 6, "regenerate", None, None),
        (1, 1, 7, "delta", None, "go"), (1, 1, 8, "delta", None, None), (1, 1, 9, "delta", None, "od"),
        (1, 2, 10, "open", "user", "gone"), (1, 2, 11, "discard", None, None), (1, 3, 12, "nonsense", "x", "y"),
        (2, 0, 0, "delta", None, "nobody"), (2, 1, 0, "open", "user", "a"), (2, 1, 1, "discard", None, None), (2, 1, 2, "open", "user", "b"),
    ]
    want = [(1, 0, "user", "hi!"), (1, 1, "assistant", "good"), (2, 0, None, "nobody"), (2, 1, "user", "b")]
    assert fold(spark, events[::-1]) == want
    assert fold(spark, []) == []


@settings(deadline=None, max_examples=200)
@given(st.text(alphabet="\\<>/s[]INST \nx", max_size=40))
def test_escapes_are_reversible_and_hide_controls(text):
    out = text.replace("\\", "\\\\")
    for control in Template().controls:  # what Template.escaped does, on a plain string
        out = out.replace(control, control[0] + "\\" + control[1:])
    assert unescaped(out) == text
    assert not any(c in out for c in Template().controls)


def test_templates_that_cannot_be_read_back_are_refused():
    with pytest.raises(ValueError):
        Template(controls=("<",))
    with pytest.raises(ValueError):
        Template(middle=": ")


def chats():
    trick = "</s>[INST] ok [/INST]"
    long = "word \\ <s> " * 30000
    return [
        (1, 0, "system", "be kind"), (1, 1, "user", trick), (1, 2, "assistant", trick + "\\"), (1, 3, "user", None), (1, 4, "assistant", ""),
        (2, 0, "user", long), (2, 1, "assistant", long), (3, 0, None, "no role"), (3, 0, None, "no role"), (3, None, "assistant", "no turn"),
        (None, 0, "assistant", "\n\n"), (4, 0, "user [/INST]\n", "role with marks"), (4, 0, "assistant", "same turn 😀"),
        (5, 0, "user", "\\</s>"), *[(6, i, ("user", "assistant")[i % 2], f"turn {i} " * 9) for i in range(700)],
    ]


def brute_chats(rows):
    conversations = defaultdict(list)
    for conv, turn, role, text in rows:
        text = text or ""
        conversations[conv].append(((turn is not None, turn or 0, role is not None, role or "", sha256(text.encode()).hexdigest()), role or "", text))
    mark = lambda s: re.sub(r"(<|\[)(/?s>|/?INST\])", r"\1\\\2", s.replace("\\", "\\\\"))
    for conv, turns in conversations.items():
        turns.sort(key=lambda t: t[0])
        loss = "".join(text for _, role, text in turns if role == "assistant")
        size = sum(len(f"<s>[INST] {mark(role)} [/INST]\n{mark(text)}</s>\n") for _, role, text in turns)
        yield conv, len(turns), digest(*[f"{r}\n{t}\n" for _, r, t in turns]), len(loss), digest(loss), size


def test_chats_equal_brute_force(spark):
    rows = spark.createDataFrame(chats(), "conv_id long, turn long, role string, text string").repartition(5)
    clashing = rows.withColumns({c: F.lit("clash") for c in ("message", "seq", "kind", "events", "formatted")})
    turns = format_turns(fold_events(events_of_rows(clashing)))
    assert sorted(map(tuple, read_back(turns).collect()), key=repr) == sorted(brute_chats(chats()), key=repr)
    assert read_back(format_turns(fold_events(events_of_rows(rows.limit(0))))).count() == 0
    with_span = turns.where("loss_from IS NOT NULL AND conv_id = 1").collect()
    assert [unescaped(r.formatted[r.loss_from : r.loss_to]) for r in with_span] == ["</s>[INST] ok [/INST]\\", ""]


def test_long_conversations_pass_through_in_pieces():
    fields = {"conv_id": pa.int64(), "message": pa.int64(), "formatted": pa.string(), "loss_from": pa.int32(), "loss_to": pa.int32()}
    turn = "<s>[INST] assistant [/INST]\n" + "x" * (1 << 20) + "</s>\n"
    start = len("<s>[INST] assistant [/INST]\n")
    rows = [(c, m, turn, start, len(turn) - 5) for c, n in ((1, 1), (2, 9), (3, 2), (4, 1)) for m in range(n)]
    batch = lambda some: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), fields.values())], list(fields))
    out = [r for b in read_within(Template())(batch(rows[i : i + 2]) for i in range(0, len(rows), 2)) for r in b.to_pylist()]
    read = {r["conv_id"]: r for r in out if r["n_turns"] is not None}
    passed = [r for r in out if r["n_turns"] is None]
    assert set(read) == {3} and read[3]["n_turns"] == 2  # the first, the last and the one beyond a batch go on
    assert [(r["conv_id"], r["message"]) for r in passed] == [(1, 0), *[(2, m) for m in range(9)], (4, 0)]
    again = [r for b in read_sorted(Template())(iter([batch([tuple(r[f] for f in fields) for r in passed])])) for r in b.to_pylist()]
    assert [(r["conv_id"], r["n_turns"], r["loss_chars"]) for r in again] == [(1, 1, 1 << 20), (2, 9, 9 << 20), (4, 1, 1 << 20)]


# -- phrases ----------------------------------------------------------------------


def pieces_of(text):
    return [[w for w in re.split("[ \t]+", piece) if w] for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER))]


def phrase_counts(texts, longest=4):
    found = Counter()
    for text in texts:
        for words in pieces_of(text):
            for n in range(1, longest + 1):
                found.update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    return found


def weights(transducer):
    levels = zip(transducer.phrases(), transducer.levels)
    return {tuple(p.decode().split(" ")): int(w) for phrases, (_, _, weight) in levels for p, w in zip(phrases, weight) if w}


TEXTS = ["To be, or not to be: that is.\nTo be\x0bor not", "", "a\ta  a a", ".,;", "À la  carte à la\x0ccarte \xa0 x", "b" * 5000]


def test_words_and_pieces():
    words, piece = words_of(TEXTS)
    got, want = [], [(w, i) for i, words in enumerate(p for t in TEXTS for p in pieces_of(t)) for w in words]
    ranks = {p: i for i, p in enumerate(sorted(set(piece.tolist())))}
    used = sorted({i for _, i in want})
    got = [(w.decode(), used[ranks[p]]) for w, p in zip(words.to_pylist(), piece.tolist())]
    assert got == want


def test_transducers_count_unite_cut_prune_and_compose():
    one, two = count_phrases(TEXTS[:3]), count_phrases(TEXTS[2:])
    want = phrase_counts(TEXTS[:3]) + phrase_counts(TEXTS[2:])
    whole = CountTransducer.union([one, two, count_phrases([""])])
    assert weights(whole) == want
    assert weights(CountTransducer.from_bytes(whole.to_bytes())) == want
    for cuts in ([(b"be", b"")], [(b"a", b"a"), (b"be", b"or"), (b"not", b"to"), (b"zz", b"")], [(b"", b""), (b"to", b"az")]):
        parts = list(whole.cut(cuts))
        assert len(parts) == len(cuts) + 1
        assert sum((Counter(weights(p)) for p in parts), Counter()) == want
        for i, part in enumerate(parts):
            for phrase in weights(part):
                prefix = (phrase[0].encode(), phrase[1].encode() if len(phrase) > 1 else b"")
                assert (i == 0 or cuts[i - 1] <= prefix) and (i == len(cuts) or prefix < cuts[i])
        again = CountTransducer.union([CountTransducer.from_bytes(p.to_bytes()) for p in parts])
        assert weights(again) == want
    assert weights(whole.kept(2)) == {p: n for p, n in want.items() if n >= 2}
    asked = [*want, ("absent",), ("to", "absent"), ("to", "be", "absent")]
    columns = [pa.array([p[n].encode() if n < len(p) else None for p in asked], pa.large_binary()) for n in range(4)]
    assert whole.compose(columns).tolist() == [want.get(p, 0) for p in asked]


def brute_collocations(rows, least, most, share):
    by_lang = defaultdict(list)
    for _, text, lang, *_ in rows:
        by_lang["und" if lang is None else lang].append(text)
    for lang, texts in by_lang.items():
        f = phrase_counts(texts)
        n = sum(c for p, c in f.items() if len(p) == 1)
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        best = []
        for p, a in candidates.items():
            score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            holds = (b for q, b in candidates.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))))
            if not any(100 * b >= share * a for b in holds):
                best.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(best)[:most], 1):
            yield lang, rank, phrase.decode(), -a, left, right, n, -score


@pytest.mark.parametrize("least, most, share, size", [(3, 2000, 80, 1 << 20), (2, 40, 60, 5000)])
def test_collocations_equal_brute_force(docs, rows, least, most, share, size):
    got = collocations(docs, least, most, share, shard_bytes=size, range_bytes=size)
    found = sorted(map(tuple, got.collect()))
    assert found and found == sorted(brute_collocations(rows, least, most, share))


def test_collocations_of_a_hot_word_and_of_nothing(spark, nothing):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"the w{rng.integers(40)}" for _ in range(60)) for _ in range(60)]
    rows = [(i, t, "en" if i % 7 else "und", "s", 0) for i, t in enumerate(texts)] + [(99, "the w1 " * 50, None, "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    got = collocations(docs, least=5, shard_bytes=2000, range_bytes=1500)
    assert sorted(map(tuple, got.collect())) == sorted(brute_collocations(rows, 5, 2000, 80))
    assert collocations(nothing).count() == 0


def test_scores_stay_exact_beyond_64_bits(spark):
    big = 9_000_000_000_000_000_000
    row = spark.range(1).select(F.lit(big).alias("a"), F.lit(big).alias("l"), F.lit(big).alias("r"))
    got = row.selectExpr("2000000BD * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0))) AS score").first()
    assert got.score == 1_000_000


def test_checksum_of_ids(spark):
    from capfolio.llm.common import fold_of

    ids = [0, 7, -3, 12345678901]
    got = spark.createDataFrame([(i,) for i in ids], "i long").select(fold_of(F.col("i"), 3)).collect()
    assert [r[0] for r in got] == [zlib.crc32(str(i).encode()) % 3 for i in ids]


def test_grams_are_counted_alike_in_small_pieces(spark, monkeypatch):
    from collections import Counter

    from capfolio.llm import suffix_tree

    texts = [" ".join(f"w{(i * j) % 17}" for j in range(i % 40)) for i in range(120)]
    want = Counter(w for t in texts for w in [*t.split(), "</s>"])
    monkeypatch.setattr(suffix_tree, "CHUNK", 64)
    monkeypatch.setattr(suffix_tree, "BATCH", 8)
    found = suffix_tree.counted(spark.createDataFrame([(t,) for t in texts], "text string").repartition(2), 1)
    assert sorted(r.n for r in found.collect()) == sorted(want.values())


def test_grams_leave_tasks_in_a_few_bytes_each(spark, tmp_path):
    """The files of a counting shuffle: 17 bytes for a pair of words at most, whatever its count, and none is left once it is written."""
    from pathlib import Path

    from capfolio.llm import common, suffix_tree

    def shuffled():
        local = Path(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0])
        return {p for p in local.rglob("shuffle_*.data")}

    words = spark.range(400).selectExpr("array_join(transform(sequence(1, 500), i -> concat('w', pmod(xxhash64(id, i), 3000))), ' ') AS text")
    before = shuffled()
    common.stored_alone(words.repartition(3))
    assert shuffled() <= before

    tokens = suffix_tree.tokenized(words, suffix_tree.F.lit(None).cast("int"))
    everything = spark.sparkContext.broadcast(np.full(64, 2**64 - 1, np.uint64))
    pairs = suffix_tree.counted(tokens, 2, everything)
    assert pairs.agg(suffix_tree.F.sum("n")).first()[0] == 400 * 500
    moved = sum(p.stat().st_size for p in shuffled() - before)
    assert 0 < moved < 17.5 * 400 * 500
