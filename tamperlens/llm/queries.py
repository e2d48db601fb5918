"""Registered queries of the corpus operators, one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tamperlens.llm.common import Scratch, table
from tamperlens.llm.conversation_repair import damaged, repair_conversations
from tamperlens.llm.hard_negatives import mine_hard_negatives
from tamperlens.llm.html_text import extract_text
from tamperlens.llm.itq_dedup import link_near_duplicates
from tamperlens.llm.jaccard_forest import jaccard_join
from tamperlens.llm.licenses import BASE, GAP, MORE, SEPARATORS, SHARE, scan_licenses
from tamperlens.llm.mixing import WORD, mix_sources
from tamperlens.llm.packing import pack_documents
from tamperlens.llm.pii import digest_columns, find_personal_data
from tamperlens.llm.token_counts import count_tokens
from tamperlens.llm.token_files import read_token_files, write_token_files
from tamperlens.llm.threshold_topk import exact_top_k
from tamperlens.llm.toxicity import score_toxicity


def op2_pii_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and added spans of personal data in every document."""
    return digest_columns(find_personal_data(table(spark, sf_dir, "documents")))


def op3_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and labels of every document."""
    return scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def op4_html_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = extract_text(table(spark, sf_dir, "pages"))
    return pages.selectExpr("page_id", "url", "text", "CAST(length(text) AS BIGINT) AS n_chars")


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Path of an installed public tokenizer file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five best others for every vector whose id is divisible by 50."""
    return exact_top_k(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0", k=5, scale=256)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document as written to, and read back from, the token files."""
    folder = Scratch(spark, "token-files").path("files")
    write_token_files(table(spark, sf_dir, "documents"), folder, vocabulary(), end_id=0)
    return read_token_files(spark, folder).selectExpr(
        "doc_id", "start", "n_tokens", "crc32(ids) AS ids_crc32"
    )


def op6_jaccard_forest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, links and group of every document."""
    return jaccard_join(table(spark, sf_dir, "documents")).drop("shingle_set")


def op7_toxicity_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    sized = table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "source", f"CAST(regexp_count(coalesce(text, ''), r'{WORD}') AS BIGINT) AS words"
    )
    sized = Scratch(spark, "sized").stage(sized, "documents")
    return mix_sources(sized, "words", "array(source)").selectExpr(
        "doc_id", "words AS size", "mix.source_size", "mix.target", "words * mix.times AS taken"
    )


def op9_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 ids."""
    pieces = pack_documents(table(spark, sf_dir, "documents"), vocabulary(), length=2048, end_id=1)
    return pieces.selectExpr(
        "doc_id", "start", "length", "crc32(ids) AS ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


def op10_itq_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector at cosine 0.98 within its label."""
    return link_near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op11_lr_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest repair and repaired digest of every damaged conversation."""
    return repair_conversations(damaged(table(spark, sf_dir, "conversations")), present="present")


def op12_digest_cache_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document, counted through a cache of this run."""
    docs = table(spark, sf_dir, "documents")
    cache = Scratch(spark, "count-cache").path("counts")
    counts = count_tokens(docs, cache, vocabulary("piece_bpe_32k.model"))
    return counts.selectExpr("doc_id", "n_bytes", "n_tokens", "n_tokens > 4096 AS over_limit")


def op13_slot_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor and positive; some labels are shifted first."""
    rows = table(spark, sf_dir, "embeddings").selectExpr(
        "vec_id", "embedding", "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label"
    )
    return mine_hard_negatives(rows, "vec_id % 100 = 0", positives=5, k=5, low=80, high=100, scale=256)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_threshold_topk": op1_threshold_topk,
    "op2_pii_weak_supervision": op2_pii_weak_supervision,
    "op3_license_diagonals": op3_license_diagonals,
    "op4_html_tree_scoring": op4_html_tree_scoring,
    "op5_token_files": op5_token_files,
    "op6_jaccard_forest_join": op6_jaccard_forest_join,
    "op7_toxicity_automata": op7_toxicity_automata,
    "op8_source_mixing": op8_source_mixing,
    "op9_curve_packing": op9_curve_packing,
    "op10_itq_near_duplicates": op10_itq_near_duplicates,
    "op11_lr_role_repair": op11_lr_role_repair,
    "op12_digest_cache_counts": op12_digest_cache_counts,
    "op13_slot_hard_negatives": op13_slot_hard_negatives,
}

_TEMPLATES = ", ".join(
    f"('{w}', '{words[at + 1]}', {number}, {at}, {len(words) - 1}, '{label}', {(phrase, label) in BASE})"
    for number, (phrase, label) in enumerate(BASE + MORE)
    for words in [phrase.split(" ")]
    for at, w in enumerate(words[:-1])
)

SQL: dict[str, str] = {
    "op3_license_diagonals": rf"""
        WITH t(w, nxt, tpl, tpl_pos, pairs, label, base) AS (VALUES {_TEMPLATES}),
        docs AS (
            SELECT row_number() OVER () AS r, doc_id,
                   list_filter(string_split_regex(lower(coalesce(text, '')), '{SEPARATORS}'), lambda x: x <> '') AS words
            FROM documents
        ),
        pairs AS (
            SELECT r, unnest(words) AS w, unnest(words[2:]) AS nxt, unnest(range(len(words))) AS pos FROM docs
        ),
        votes AS (
            SELECT r, tpl, t.pairs, label, base, pos - tpl_pos AS diagonal, list(DISTINCT tpl_pos) AS met
            FROM pairs JOIN t USING (w, nxt) GROUP BY ALL
        ),
        opened AS (
            SELECT *, CASE WHEN diagonal - lag(diagonal) OVER o <= {GAP} THEN 0 ELSE 1 END AS opens FROM votes
            WINDOW o AS (PARTITION BY r, tpl ORDER BY diagonal)
        ),
        chained AS (
            SELECT *, sum(opens) OVER (PARTITION BY r, tpl ORDER BY diagonal) AS chain FROM opened
        ),
        spans AS (
            SELECT r, tpl, label, base, chain, list(diagonal) FILTER (len(met) = pairs) AS exact,
                   len(list_distinct(flatten(list(met)))) / any_value(pairs) AS score
            FROM chained GROUP BY r, tpl, label, base, chain
        ),
        texts AS (
            SELECT r, flatten(list(exact) FILTER (base AND exact IS NOT NULL)) AS starts,
                   list(DISTINCT label) FILTER (base AND exact IS NOT NULL) AS base_set,
                   list(DISTINCT label) FILTER (NOT base OR exact IS NOT NULL) AS label_set,
                   max(score) AS score
            FROM spans WHERE score >= {SHARE} GROUP BY r
        )
        SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(starts), 0) AS BIGINT) AS n_base,
               CAST(list_min(starts) AS BIGINT) AS first_word, CAST(list_max(starts) AS BIGINT) AS last_word,
               coalesce(array_to_string(list_sort(base_set), ','), '') AS base_labels,
               coalesce(array_to_string(list_sort(label_set), ','), '') AS labels,
               coalesce(CAST(score AS DOUBLE), 0) AS score
        FROM docs LEFT JOIN texts USING (r)
    """,
    "op1_threshold_topk": """
        WITH clean AS (
            SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), parts AS (SELECT vec_id, unnest(v) AS x, unnest(range(len(v))) AS d FROM clean),
        scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
            FROM parts q JOIN parts c ON q.d = c.d AND q.vec_id <> c.vec_id
            WHERE q.vec_id % 50 = 0 GROUP BY ALL
        ), ranked AS (
            SELECT query_id, CAST(row_number() OVER (
                PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
            FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
    """,
    "op6_jaccard_forest_join": rf"""
        WITH RECURSIVE docs AS (
            SELECT doc_id, list_filter(string_split_regex(lower(text), '{SEPARATORS}'), lambda x: x <> '') AS w
            FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
        ), sets AS (
            SELECT doc_id, unnest(list_distinct(CASE
                WHEN len(w) >= 5 THEN [array_to_string(w[i + 1:i + 5], ' ') FOR i IN range(len(w) - 4)]
                WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s
            FROM docs
        ), sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
        shared AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sets a JOIN sets b USING (s)
            WHERE a.doc_id <> b.doc_id GROUP BY ALL
        ), links AS MATERIALIZED (
            SELECT a, b, c = p.n AND c = q.n AS same
            FROM shared JOIN sizes p ON a = p.doc_id JOIN sizes q ON b = q.doc_id
            WHERE c / (p.n + q.n - c) >= 0.8
        ), reach AS (
            SELECT a AS node, a AS seen FROM links
            UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.seen = l.a
        ), least AS (SELECT node, min(seen) AS g FROM reach GROUP BY node),
        degree AS (SELECT a AS node, count(*) AS n, min(b) FILTER (WHERE same) AS twin FROM links GROUP BY a)
        SELECT doc_id, least(doc_id, coalesce(twin, doc_id)) AS class_id,
               CASE WHEN doc_id IS NOT NULL THEN coalesce(n, 0) END AS n_links,
               coalesce(g, doc_id) AS group_id, coalesce(coalesce(g, doc_id) = doc_id, true) AS kept
        FROM documents LEFT JOIN least ON doc_id = least.node LEFT JOIN degree ON doc_id = degree.node
    """,
    "op10_itq_near_duplicates": """
        WITH RECURSIVE clean AS (
            SELECT vec_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM clean a JOIN clean b
            ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
            WHERE list_cosine_similarity(a.v, b.v) >= 0.98
        ), reach AS (
            SELECT a AS node, a AS seen FROM links
            UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.seen = l.a
        ), least AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node),
        degree AS (SELECT a AS node, count(*) AS n FROM links GROUP BY a)
        SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component_id, vec_id) AS component_id,
               coalesce(component_id, vec_id) = vec_id AS kept
        FROM embeddings LEFT JOIN least ON vec_id = least.node LEFT JOIN degree ON vec_id = degree.node
    """,
    "op13_slot_hard_negatives": """
        WITH clean AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), parts AS (SELECT vec_id, label, unnest(v) AS x, unnest(range(len(v))) AS d FROM clean),
        scored AS MATERIALIZED (
            SELECT a.vec_id AS anchor_id, b.vec_id AS other, any_value(a.label = b.label) AS same,
                   CAST(sum(a.x * b.x) AS BIGINT) AS score
            FROM parts a JOIN parts b ON a.d = b.d AND a.vec_id <> b.vec_id
            WHERE a.vec_id % 100 = 0 GROUP BY ALL
        ), positives AS (
            SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
        )
        SELECT anchor_id, positive_id, CAST(row_number() OVER (
                   PARTITION BY anchor_id, positive_id ORDER BY n.score DESC, n.other) AS INTEGER) AS rank,
               n.other AS negative_id, positive_score, n.score AS negative_score
        FROM positives JOIN scored n USING (anchor_id)
        WHERE NOT n.same AND 80 * positive_score <= 100 * n.score AND 100 * n.score <= 100 * positive_score
        QUALIFY rank <= 5
    """,
}
