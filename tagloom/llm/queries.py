"""One query per operator over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tagloom.llm import bpe, conversations, exact, extraction, language_model, licences, manifest, packing, pii, quality, simhash, token_files, toxicity
from tagloom.llm.common import crc32_of, crc32_sql, table

#: A-Z and a-z, for the fold in SQL.
_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def rank_file() -> str:
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(table(spark, sf_dir, "documents"), rank_file(), public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.CUT).cast("int").alias("predicted")
    )


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the rank file holds the vocabulary of byte_bpe_50k.json but for its added tokens
    added = packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    cuts = packing.pieces(table(spark, sf_dir, "documents"), rank_file(), public_tokenizers.PATTERN, added=added)
    return packing.pack(cuts)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the documents of a source lie in folders by language
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return licences.scan(table(spark, sf_dir, "documents").select("doc_id", "text", path.alias("path")))


def op8_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(table(spark, sf_dir, "documents")).drop("class_scores")


def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.replace(docs, corpus_pipeline.SURROGATE_KEY, count_col="n_entities").select("doc_id", "n_entities", "text")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    # the address travels in the key, so that no join is needed to bring it back
    keyed = pages.select(F.struct("page_id", "url").alias("page"), "html")
    found = extraction.extract(keyed, extraction.fit(pages), id_col="page")
    return found.select("page.page_id", "page.url", "text", F.length("text").cast("long").alias("n_chars"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = token_files.build(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_files.read_documents(spark, folder, docs.schema["doc_id"].dataType.simpleString())


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damage(table(spark, sf_dir, "conversations")))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.coalesce(crc32_of(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))
    return manifest.manifest(table(spark, sf_dir, "documents"), tampered)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_quality_rules": op2_quality_rules,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_simhash": op6_simhash,
    "op7_license_scan": op7_license_scan,
    "op8_context_mixing": op8_context_mixing,
    "op9_pii_surrogates": op9_pii_surrogates,
    "op10_html_extraction": op10_html_extraction,
    "op11_token_files": op11_token_files,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_merkle_manifest": op13_merkle_manifest,
    "pipeline": pipeline,
}

def _field(column: str) -> str:
    return f"coalesce(strlen({column}::VARCHAR)::VARCHAR || ':' || {column}::VARCHAR, '-')"


def _tree(name: str, leaves: str) -> str:
    """Recursive SQL for all levels (lvl, tree, pos, hash, n) above ``leaves`` (tree, pos, hash, n)."""
    return f"""
        {name} AS (
            SELECT 0 AS lvl, tree, pos, hash, n FROM {leaves}
            UNION ALL
            SELECT lvl + 1, tree, pos // 8, sha256(string_agg(hash, '' ORDER BY pos)), (n + 7) // 8
            FROM {name} WHERE n > 1 GROUP BY lvl, tree, pos // 8, n)"""


def _steps(name: str, levels: str) -> str:
    """What stands left and right of every node of ``levels`` in its run."""
    return f"""
        {name} AS (
            SELECT lvl, tree, pos, coalesce(string_agg(hash, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
                   coalesce(string_agg(hash, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
            FROM {levels} WHERE n > 1 WINDOW w AS (PARTITION BY lvl, tree, pos // 8 ORDER BY pos))"""


_LEAF = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars"))
_MERKLE = f"""
    WITH RECURSIVE leaves AS (
        SELECT doc_id, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, sha256({_LEAF} || {_field("text")}) AS leaf,
               CASE WHEN {crc32_sql("doc_id::VARCHAR")} % 3 = 0 THEN sha256({_LEAF} || {_field("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")})
               ELSE sha256({_LEAF} || {_field("text")}) END AS seen
        FROM documents),
    placed AS (
        SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, leaf AS hash, count(*) OVER (PARTITION BY tree) AS n
        FROM leaves),
    {_tree("low", "placed")},
    subroots AS (SELECT 0 AS tree, tree AS pos, hash, count(*) OVER () AS n FROM low WHERE n = 1),
    {_tree("high", "subroots")},
    {_steps("low_steps", "low")},
    {_steps("high_steps", "high")},
    steps AS (
        SELECT p.doc_id, p.tree, p.pos, s.lvl, s.l, s.r FROM placed p JOIN low_steps s ON s.tree = p.tree AND s.pos = p.pos // (8 ** s.lvl)::BIGINT
        UNION ALL
        SELECT p.doc_id, p.tree, p.pos, 100 + s.lvl, s.l, s.r FROM placed p JOIN high_steps s ON s.pos = p.tree // (8 ** s.lvl)::BIGINT),
    proofs AS (SELECT tree, pos, list({{'l': l, 'r': r}} ORDER BY lvl) AS path FROM steps GROUP BY tree, pos),
    folding AS (
        SELECT p.tree, p.pos, 0 AS k, p.seen AS node, coalesce(f.path, []) AS path FROM placed p LEFT JOIN proofs f USING (tree, pos)
        UNION ALL
        SELECT tree, pos, k + 1, sha256(path[k + 1].l || node || path[k + 1].r), path FROM folding WHERE k < len(path))
    SELECT p.doc_id, p.leaf, s.hash AS subroot, t.hash AS root, sha256(list_aggregate(list_transform(f.path, lambda x: x.l || x.r), 'string_agg', '')) AS proof_sha256,
           f.node AS folded_root, f.node = t.hash AS verified
    FROM placed p JOIN folding f ON f.tree = p.tree AND f.pos = p.pos AND f.k = len(f.path)
    JOIN subroots s ON s.pos = p.tree JOIN high t ON t.n = 1
"""

def _edit(stack: str, letter: str, cost: str, turn: str = "''", when: str = "true") -> str:
    """A live stack {c: cost, a: audit, t: text} after an edit; null where it cannot be made."""
    return f"CASE WHEN {stack} IS NOT NULL AND {when} THEN {{'c': {stack}.c + {cost}, 'a': {stack}.a || '{letter}', 't': {stack}.t || {turn}}} END"


def _least(*stacks: str) -> str:
    return f"list_min(list_filter([{', '.join(stacks)}], lambda x: x IS NOT NULL))"


# the four states of the role grammar: nothing yet (z), after s, after u, after a
_TURN, _STAYS = "chr(10) || r.role || ':' || r.text", "NOT r.must_go"
_GIVEN = {name: f"chr(10) || '{name}:' || r.text" for name in ("user", "assistant")}
_INSERTED = {name: f"chr(10) || '{name}:'" for name in ("user", "assistant")}
_KEPT_U, _KEPT_A = f"{_STAYS} AND r.letter = 'u'", f"{_STAYS} AND r.letter = 'a'"
_STEP = {
    "z": _edit("p.z", "D", "3"),
    "s": _least(_edit("p.s", "D", "3"), _edit("p.z", "K", "r.more", _TURN, f"{_STAYS} AND r.letter = 's'")),
    "u": _least(
        _edit("p.u", "D", "3"), *[_edit(f"p.{x}", "K", "r.more", _TURN, _KEPT_U) for x in "zsa"],
        *[_edit(f"p.{x}", "R", "2 + r.more", _GIVEN["user"], _STAYS) for x in "zsa"],
    ),
    "a": _least(_edit("p.a", "D", "3"), _edit("p.u", "K", "r.more", _TURN, _KEPT_A), _edit("p.u", "R", "2 + r.more", _GIVEN["assistant"], _STAYS)),
}
_REPAIR = f"""
    WITH RECURSIVE raw AS (
        SELECT conv_id, turn::BIGINT AS turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               {crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS code
        FROM conversations),
    damaged AS (
        SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
               CASE WHEN code = 1 THEN '' WHEN code = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
               unnest(range(CASE WHEN code = 3 THEN 2 ELSE 1 END)) AS copy
        FROM raw WHERE code <> 0),
    placed AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS k,
               rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS trimmed
        FROM damaged),
    marked AS (
        SELECT *, left(role, 1) AS letter,
               CASE WHEN trimmed = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'duplicate'
                    WHEN right(trimmed, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
               lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) AS before
        FROM placed),
    ready AS (SELECT *, fault IN ('blank', 'duplicate') AS must_go, (fault = 'truncated')::BIGINT AS more FROM marked),
    stepped AS (
        SELECT conv_id, 0::BIGINT AS k, {{'c': 0::BIGINT, 'a': '', 't': ''}} AS z, NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR) AS s,
               {{'c': 2::BIGINT, 'a': 'I', 't': chr(10) || 'user:'}} AS u, {{'c': 4::BIGINT, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}} AS a
        FROM (SELECT DISTINCT conv_id FROM conversations)
        UNION ALL
        SELECT conv_id, k, z, s, u, {_least("a", _edit("u", "I", "2", _INSERTED["assistant"]))}
        FROM (
            SELECT conv_id, k, z, s, {_least("u", *[_edit(x, "I", "2", _INSERTED["user"]) for x in "zsa"])} AS u, a
            FROM (
                SELECT r.conv_id, r.k, {_STEP["z"]} AS z, {_STEP["s"]} AS s, {_STEP["u"]} AS u, {_STEP["a"]} AS a
                FROM stepped p JOIN ready r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.k = p.k + 1))),
    ended AS (
        SELECT conv_id, arg_max(coalesce({_least("z", "a")}, z), k) AS won FROM stepped GROUP BY conv_id),
    counted AS (
        SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
               count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
               count(*) FILTER (before IS NOT NULL AND before || letter NOT IN ('su', 'ua', 'au')) AS illegal
        FROM ready GROUP BY conv_id)
    SELECT e.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated,
           coalesce(c.illegal, 0) AS illegal, e.won.c AS cost, e.won.a AS audit, sha256(substr(e.won.t, 2)) AS repaired_sha256
    FROM ended e LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""

ORACLES: dict[str, str] = {
    "op3_exact_dedup": f"""
        WITH t AS (SELECT doc_id, sha256({_FOLD}) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, text_sha256
        FROM t WINDOW w AS (PARTITION BY text_sha256)
    """,
    "op12_conversation_repair": _REPAIR,
    "op13_merkle_manifest": _MERKLE,
}
