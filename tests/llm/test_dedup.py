import hashlib
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from capfolio.llm.exact_dedup import exact_duplicates
from capfolio.llm.line_dedup import drop_lines, keep_bitmaps
from capfolio.llm.near_dedup import (
    block_pairs, components, exact_links, least_matches, likely_links, met, near_duplicates, signatures,
)

BLANK = re.compile("[\x20\x09-\x0d]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def norm(text):
    return BLANK.sub(" ", text or "")


def test_exact_duplicates_equal_brute_force(docs, rows):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[norm(text)].append(doc_id)
    want = Counter()
    for text, ids in groups.items():
        first = min((i for i in ids if i is not None), default=None)
        for i in ids:
            want[(i, first, len(ids), hashlib.sha256(text.encode()).hexdigest())] += 1
    got = exact_duplicates(docs, digest_all=True).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert len(kept) == len(groups) and set(kept.values()) == {1}
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_a_text_with_very_many_copies_is_split(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        docs = spark.range(30000).repartition(8).select(
            F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same").otherwise(F.concat(F.lit("text "), (F.col("id") / 2).cast("int"))).alias("text")
        )
        found = exact_duplicates(docs)
        sizes = found.groupBy("group_size").count().collect()
        found.collect()
        assert {r.group_size: r["count"] for r in sizes}[10000] == 10000
        assert "skew=true" in found._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_settled_rows_are_not_hashed(docs):
    got = exact_duplicates(docs).collect()
    assert any(r.text_sha256 is None for r in got)
    assert all(r.text_sha256 is not None for r in got if r.group_size > 1)


def brute_lines(rows, min_docs=None):
    """Rows after line dedup, by (id, text)."""
    strip = " \t\n\x0b\x0c\r"
    keys = lambda text: [line.strip(strip).translate(LOWER) for line in (text or "").split("\n")]
    owners, seen, result = defaultdict(set), set(), {}
    for doc_id, text, *_ in rows:
        for key in keys(text):
            owners[key].add((doc_id, text) if doc_id is None else doc_id)
    for doc_id, text in sorted({(r[0], r[1]) for r in rows}, key=lambda r: (r[0] is not None, r[0] or 0)):
        keep = []
        for line, key in zip((text or "").split("\n"), keys(text)):
            drop = bool(key) and (len(owners[key]) >= min_docs if min_docs else key in seen)
            seen.add(key)
            if not drop:
                keep.append(line)
        result[doc_id, text] = "\n".join(keep)
    return result


def test_frequent_lines_go(docs, rows):
    want = brute_lines(rows, 4)
    got = drop_lines(docs, keep_bitmaps(docs, min_docs=4)).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "line_dedup").collect()
    texts = Counter((r.doc_id, r.text) for r in got)
    assert texts == Counter((r[0], want[r[0], r[1]]) for r in rows)
    assert any(r.line_dedup.n_dropped > 64 for r in got)


def test_first_lines_stay(spark):
    rows = [(i, t) for i, t in enumerate(["a\nb\na", "B \nc", "c\nd", None, "", "d\n\nd\ne"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = drop_lines(docs, keep_bitmaps(docs, keep_first=True)).collect()
    want = brute_lines(rows)
    assert {r.doc_id: r.text or "" for r in got} == {i: want[i, t] for i, t in rows}


def test_hot_line_is_dealt_into_slices(spark):
    rows = [(i, f"hot line\nown {i}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = drop_lines(docs, keep_bitmaps(docs))
    assert got.where("text = concat('own ', doc_id)").count() == 3000
    first = drop_lines(docs, keep_bitmaps(docs, keep_first=True))
    assert first.where("text LIKE 'hot%'").count() == 1


def brute_components(rows):
    sets = {}
    for doc_id, text, *_ in rows:
        words = [w for w in BLANK.split((text or "").translate(LOWER)) if w]
        found = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) > 4 else ({tuple(words)} if words else set())
        if doc_id is not None:
            sets.setdefault(doc_id, []).append(found)
    least = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if least[b] < least[a] and any(x and y and 4 * len(x & y) >= 3 * len(x | y) for x in sets[a] for y in sets[b]):
                    least[a], changed = least[b], True
    return least


def test_near_duplicates_equal_brute_force(docs, rows):
    want = brute_components(rows)
    got = near_duplicates(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == (None if r.doc_id is None else want[r.doc_id])
        assert r.kept == (r.doc_id == r.component_id or r.doc_id is None)


def test_chain_inside_a_bucket_is_found(spark):
    """Each text differs a little from the next, so the ends are linked only through the middle."""
    words = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(12):
        texts.append(" ".join(words))
        words = words[18:] + [f"n{len(texts)}x{i}" for i in range(18)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows)
    assert set(want.values()) == {0}
    assert {r.doc_id: r.component_id for r in near_duplicates(docs).collect()} == want


def test_members_meet_in_blocks(spark):
    """A group of copies around the threshold, larger than two blocks, some of which are known to belong together."""
    random = __import__("random").Random(2)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(300):
        words = list(base)
        for _ in range(random.randint(0, 7)):
            words[random.randrange(120)] = f"x{random.randrange(10**6)}"
        texts.append(" ".join(words))
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows)
    known = {i: want[i] if i % 3 == 0 else i for i in want}
    members = spark.createDataFrame([(5, i, known[i]) for i in want], "grp long, doc_id long, label long")
    placed = block_pairs(members)
    assert 1 < placed.select("x", "y").distinct().count() <= 6
    signed = signatures(docs, "doc_id", "text").withColumnRenamed("doc_id", "_id")
    meeting = placed.join(signed.join(docs.withColumnRenamed("doc_id", "_id"), "_id"), F.col("doc_id") == F.col("_id"))
    stars = members.where("doc_id <> label").select(F.col("doc_id").alias("a"), F.col("label").alias("b"))
    exact = met(meeting, ["text"], exact_links)
    found = {r.node: r.component for r in components(exact.union(stars)).collect()}
    assert {i: found.get(i, i) for i in want} == want
    assert exact.count() < 900
    likely = met(meeting, ["n_shingles", "signature"], likely_links(1e-6))
    coarse = {r.node: r.component for r in components(likely.union(stars)).collect()}
    assert all(coarse.get(i, i) == coarse.get(want[i], want[i]) for i in want)


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}


def test_copies_of_a_large_group_take_no_part_in_the_star_steps(spark, monkeypatch):
    from capfolio.llm import near_dedup

    rows, stored = [], near_dedup.stored

    def counted(frame):
        table = stored(frame)
        if table.columns == ["u", "v"]:
            rows.append(table.count())
        return table

    monkeypatch.setattr(near_dedup, "stored", counted)
    heads = [100 + i for i in range(12)]
    edges = [(heads[i % 12], 1000 + i) for i in range(3000)] + [(heads[(i + 1) % 12], 1000 + i) for i in range(3000)]
    edges += [(5, 5), (7, 9), (9, 8)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long").repartition(8)).collect()}
    assert got == {n: 100 for n in [*heads, *range(1000, 4000)]} | {7: 7, 8: 7, 9: 7}
    assert sum(rows) < 1000


def test_posterior_bounds_grow_with_the_evidence():
    bounds = least_matches(0.75, 1e-6)
    assert len(bounds) == 8 and bounds == sorted(bounds) and bounds[-1] < 96


def test_empty_tables(nothing):
    assert exact_duplicates(nothing).count() == 0
    assert drop_lines(nothing, keep_bitmaps(nothing)).count() == 0
    assert near_duplicates(nothing).count() == 0
