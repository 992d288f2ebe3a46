"""Registered queries of the document operators, and the DuckDB statements that must agree."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capfolio.llm.chat import events_of_rows, fold_events, format_turns, read_back
from capfolio.llm.collocations import collocations
from capfolio.llm.common import documents, fold_of, lower_ascii
from capfolio.llm.exact_dedup import exact_duplicates
from capfolio.llm.fingerprints import fingerprint_edits
from capfolio.llm.language_id import fit_languages, identify
from capfolio.llm.line_dedup import drop_lines, keep_bitmaps
from capfolio.llm.merkle import folded, leaf_digest, merkle_manifest, proof_text
from capfolio.llm.mixing import mix_sources
from capfolio.llm.near_dedup import near_duplicates
from capfolio.llm.packing import pack_exact, pack_matrices, token_pieces
from capfolio.llm.suffix_tree import fit_suffix_tree, score_texts, tokenized
from capfolio.llm.surrogates import replace_private

TOKENIZER = "word_bpe_49k.json"


def op1_suffix_tree(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text")
    held_out = F.coalesce(fold_of(F.col("doc_id")) == 1, F.lit(False))
    learned, others = tokenized(docs.where(~held_out)), tokenized(docs.where(held_out))
    return score_texts(learned.union(others), fit_suffix_tree(learned)).withColumn("held_out", held_out)


def op2_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_duplicates(documents(spark, folder), digest_all=True)


def op3_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = token_pieces(documents(spark, folder), public_tokenizers.path(TOKENIZER), limit=4096, end_id=1)
    return pack_exact(pieces, limit=4096)


def op4_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprint_edits(documents(spark, folder))


def op5_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    return replace_private(documents(spark, folder), key="capfolio-check").select("doc_id", "n_entities", "text")


def op6_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(documents(spark, folder))


def op7_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mix_sources(documents(spark, folder), weights=(5, 2, 1), most_copies=3)
    return mixed.select("doc_id", "size", "source_size", "target", "copies", "taken")


def op8_token_matrices(spark: SparkSession, folder: str) -> DataFrame:
    return pack_matrices(documents(spark, folder), public_tokenizers.path(TOKENIZER), capacity=2048, end_id=1)


def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text")
    reduced = drop_lines(docs, keep_bitmaps(docs))
    digest = F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    return reduced.select("doc_id", "line_dedup.n_lines", "line_dedup.n_dropped", digest)


def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text", "lang")
    model = fit_languages(docs.where(F.coalesce(fold_of(F.col("doc_id")) != 0, F.lit(True))))
    held_out = F.coalesce(fold_of(F.col("doc_id")) == 0, F.lit(False)).alias("held_out")
    return identify(docs, model).select("doc_id", held_out, "lang_pred", "score")


def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(documents(spark, folder), least=30, most=2000, share=80)


def op12_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    tricky = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return read_back(format_turns(fold_events(events_of_rows(rows.union(tricky)))))


def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    text = F.col("text")
    values = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = fold_of(F.col("doc_id"), 3) == 0
    leaves = documents(spark, folder).select(
        "doc_id", "lang", leaf_digest(*values, text).alias("leaf"),
        F.when(tampered, leaf_digest(*values, lower_ascii(text))).alias("tampered_leaf"),
    )
    proved = merkle_manifest(leaves, tree="lang", order="doc_id")
    again = proved.withColumn("folded_root", folded(F.coalesce("tampered_leaf", "leaf"), F.col("proof")))
    return again.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(proof_text(F.col("proof")), 256).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_tree": op1_suffix_tree,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_fingerprints": op4_fingerprints,
    "op5_surrogates": op5_surrogates,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_mix_sources": op7_mix_sources,
    "op8_token_matrices": op8_token_matrices,
    "op9_line_dedup": op9_line_dedup,
    "op10_language_id": op10_language_id,
    "op11_collocations": op11_collocations,
    "op12_chat_formatting": op12_chat_formatting,
    "op13_merkle_manifest": op13_merkle_manifest,
}

def tree_levels(name: str, depth: int) -> str:
    """CTEs ``{name}1`` to ``{name}{depth}`` from ``{name}0`` (tree, i, d): runs of 8 folded, and ``{name}_steps`` with what a node
    has beside it at each level. A tree of one node stays as it is, so ``depth`` only has to be large enough."""
    levels, steps = [], []
    for k in range(depth):
        window = f"FROM {name}{k} WINDOW t AS (PARTITION BY tree), run AS (PARTITION BY tree, i // 8 ORDER BY i)"
        steps.append(f"""
            SELECT {k} AS level, tree, i, count(*) OVER t > 1 AS folds,
                coalesce(string_agg(d, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lft,
                coalesce(string_agg(d, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rgt
            {window}""")
        levels.append(f"""{name}{k + 1} AS (
            SELECT tree, i // 8 AS i, CASE WHEN max(n) = 1 THEN min(d) ELSE sha256(string_agg(d, '' ORDER BY i)) END AS d
            FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {name}{k}) GROUP BY tree, i // 8)""")
    return ", ".join(levels) + f", {name}_steps AS ({' UNION ALL '.join(steps)})"


def folding(source: str, steps: str, tree: str, place: str, depth: int) -> str:
    """A query that folds ``h`` of each row of ``source`` up a tree, and appends the siblings to ``proof``."""
    for k in range(depth):
        source = f"""
            SELECT r.* REPLACE (CASE WHEN s.folds THEN sha256(s.lft || r.h || s.rgt) ELSE r.h END AS h, r.proof || s.lft || s.rgt AS proof)
            FROM ({source}) r JOIN {steps} s ON s.level = {k} AND s.tree = r.{tree} AND s.i = r.{place} // {8**k}"""
    return source


def field_sql(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || {value}, '-')"


def leaf_sql(text: str) -> str:
    return f"sha256({' || '.join(field_sql(v) for v in ('doc_id', 'source', 'lang', 'n_chars', text))})"


#: CRC-32 bit by bit, over the digits of doc_id; -1 stands for a shift.
CRC32_SQL = """
    xor(4294967295, list_reduce(
        [4294967295::BIGINT] || flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
            lambda c: [CAST(ord(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
        lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END))
"""

ORACLE_SQL: dict[str, str] = {
    "op2_exact_dedup": r"""
        WITH hashed AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
            FROM documents
        )
        SELECT doc_id,
               min(doc_id) OVER same AS keep_id,
               count(*) OVER same AS group_size,
               doc_id = min(doc_id) OVER same AS kept,
               text_sha256
        FROM hashed
        WINDOW same AS (PARTITION BY text_sha256)
    """,
    "op9_line_dedup": r"""
        WITH lines AS (
            SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos
            FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
        ), keyed AS (
            SELECT *, translate(
                trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line_key
            FROM lines
        ), frequent AS (
            SELECT line_key FROM keyed WHERE line_key <> '' GROUP BY line_key HAVING count(DISTINCT doc_id) >= 10
        )
        SELECT doc_id, count(*) AS n_lines, count(f.line_key) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (f.line_key IS NULL), '')) AS kept_sha256
        FROM keyed LEFT JOIN frequent f USING (line_key)
        GROUP BY doc_id
    """,
    "op11_collocations": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents
        ), spoken AS (
            SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces
        ), grams AS (
            SELECT lang, len(p) AS words, array_to_string(p, ' ') AS phrase
            FROM (SELECT lang, w[i:i + s - 1] AS p
                  FROM (SELECT lang, w, s, unnest(range(1, len(w) - s + 2)) AS i
                        FROM spoken, (SELECT unnest([1, 2, 3, 4]) AS s)))
        ), counts AS (
            SELECT lang, words, phrase, count(*) AS f FROM grams GROUP BY ALL
        ), sizes AS (
            SELECT lang, sum(f) AS n FROM counts WHERE words = 1 GROUP BY lang
        ), candidates AS (
            SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE words > 1 AND f >= 30
        ), cut AS (
            SELECT c.*, k, l.f AS l, r.f AS r, (2000000::HUGEINT * a) // (l.f::HUGEINT + r.f) AS score
            FROM (SELECT *, unnest(range(1, words)) AS k FROM candidates) c
            JOIN counts l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:k], ' ')
            JOIN counts r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k + 1:], ' ')
        ), least AS (
            SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
        ), inside AS (
            SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, max(a) AS longer
            FROM (SELECT *, unnest(range(1, words - s + 2)) AS i
                  FROM (SELECT *, unnest(range(2, words)) AS s FROM candidates))
            GROUP BY ALL
        )
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r,
               CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
        FROM least LEFT JOIN inside USING (lang, phrase) JOIN sizes USING (lang)
        WHERE longer IS NULL OR 100 * longer::HUGEINT < 80 * a::HUGEINT
        QUALIFY rank <= 2000
    """,
    "op12_chat_formatting": r"""
        WITH said AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
        ), sized AS (
            SELECT *, length(concat('<s>[INST]  [/INST]', chr(10), '</s>', chr(10)))
                + length(role) + length(role) - length(replace(role, '\', ''))
                + length(text) + length(text) - length(replace(text, '\', ''))
                + length(regexp_replace(concat(role, chr(10), text), '(</?s>|\[/?INST\])', '\1+', 'g'))
                - length(concat(role, chr(10), text)) AS formatted
            FROM said
        )
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(formatted) AS BIGINT) AS formatted_chars
        FROM sized
        GROUP BY conv_id
    """,
    # Six levels hold 262 144 documents a language, three 512 languages.
    "op13_merkle_manifest": f"""
        WITH leaves AS (
            SELECT doc_id, lang, {leaf_sql("text")} AS leaf,
                CASE WHEN {CRC32_SQL} % 3 = 0
                     THEN {leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS tampered
            FROM documents
        ), placed AS (
            SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree,
                row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i
            FROM leaves
        ), sub0 AS (SELECT tree, i, leaf AS d FROM placed),
        {tree_levels("sub", 6)},
        top0 AS (SELECT 0 AS tree, tree AS i, d FROM sub6),
        {tree_levels("top", 3)},
        folded AS (
            SELECT * FROM ({folding(
                folding("SELECT *, 0 AS whole, coalesce(tampered, leaf) AS h, '' AS proof FROM placed", "sub_steps", "tree", "i", 6),
                "top_steps", "whole", "tree", 3)})
        )
        SELECT f.doc_id, f.leaf, s.d AS subroot, t.d AS root, sha256(f.proof) AS proof_sha256, f.h AS folded_root, f.h = t.d AS verified
        FROM folded f JOIN sub6 s USING (tree) CROSS JOIN top3 t
    """,
}
