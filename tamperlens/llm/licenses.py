"""License scans by diagonal voting, in DataFrame functions only.

Every rolling word pair of every text is joined by hash to the positions of the same pair
in the license templates. A hit votes for its diagonal, the text position less the
template position; an unbroken copy of a template puts all its votes on one diagonal.
Neighbouring diagonals of one template are merged, which bridges inserted or dropped words,
and a merged span counts if enough of the template's pairs are found in it.

A word is a maximal run of characters other than ASCII punctuation, blanks and controls,
with A-Z in lower case. Null texts are empty, null ids and repeated rows get rows like any
other, an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamperlens.functions.columns import quoted
from tamperlens.llm.common import Scratch

#: fixed values: phrases of the base search and their labels
BASE = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)
#: fixed values: further templates and their labels
MORE = (
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("redistribution and use in source and binary forms with or without modification", "bsd"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("mozilla public license", "mpl"),
    ("creative commons attribution", "cc-by"),
    ("licensed under cc by nc", "cc-by-nc"),
    ("dedicated to the public domain", "public-domain"),
)
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = 2
SHARE = 0.6


def templates(spark: SparkSession, phrases: tuple = BASE + MORE) -> DataFrame:
    """(gram, w, nxt, tpl, tpl_pos, pairs, label, base): one row per word pair of a template."""
    rows = []
    for number, (phrase, label) in enumerate(phrases):
        words = phrase.split(" ")
        # lower() folds the Kelvin sign and others to these letters; no template has them
        assert len(words) > 1 and not set(phrase) & set("kå")
        for at in range(len(words) - 1):
            rows.append((words[at], words[at + 1], number, at, len(words) - 1, label, (phrase, label) in BASE))
    schema = "t_w string, t_nxt string, tpl int, tpl_pos int, pairs int, label string, base boolean"
    return spark.createDataFrame(rows, schema).withColumn("t_gram", F.xxhash64("t_w", "t_nxt"))


def pair_hits(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_key, n_words, pos, tpl …): a row without pos for each text, and all hits.

    One pass: the pairs of a text are unnested next to a mark that stands for the text.
    """
    text = f"coalesce(CAST({quoted(text_col)} AS STRING), '')"
    words = (
        docs.selectExpr(f"CAST({quoted(id_col)} AS BIGINT) AS doc_id", f"{text} AS text")
        .withColumn("split", F.split(F.lower("text"), SEPARATORS, -1))
        .selectExpr(
            "doc_id", "struct(xxhash64(text) AS hash, length(text) AS size) AS text_key", "split",
            "if(split[0] = '', 1, 0) AS head",
            "if(size(split) > 1 AND element_at(split, -1) = '', 1, 0) AS tail",
        )
        .selectExpr("doc_id", "text_key", "slice(split, head + 1, size(split) - head - tail) AS w")
        .withColumn("nxt", F.expr("slice(w, 2, size(w))"))
    )
    pairs = words.selectExpr(
        "doc_id", "text_key", "CAST(size(w) AS BIGINT) AS n_words",
        "posexplode(concat(array(named_struct('w', CAST(NULL AS STRING), 'nxt', CAST(NULL AS STRING))), "
        "arrays_zip(w, nxt))) AS (place, pair)",
    ).selectExpr(
        "doc_id", "text_key", "n_words", "CAST(place - 1 AS BIGINT) AS pos", "pair.w AS w", "pair.nxt AS nxt",
        "if(pair.nxt IS NULL, NULL, xxhash64(pair.w, pair.nxt)) AS gram",
    )
    # the template table is a constant of this module: a few dozen rows
    return (
        pairs.join(
            F.broadcast(found),
            (F.col("gram") == F.col("t_gram")) & (F.col("w") == F.col("t_w")) & (F.col("nxt") == F.col("t_nxt")),
            "left",
        )
        .where("pos = -1 OR tpl IS NOT NULL")
        .select("doc_id", "text_key", "n_words", "pos", "tpl", "tpl_pos", "pairs", "label", "base")
    )


def merged_spans(hits: DataFrame, gap: int = GAP) -> DataFrame:
    """(doc_id, text_key, tpl, pairs, label, base, start, stop, exact_starts, score) per span.

    ``exact_starts`` lists the diagonals of the span with all pairs of the template.
    """
    votes = (
        hits.where("tpl IS NOT NULL")
        .select("doc_id", "text_key", "tpl", "pairs", "label", "base", "pos", "tpl_pos")
        .distinct()
        .withColumn("diagonal", F.expr("pos - tpl_pos"))
        .groupBy("doc_id", "text_key", "tpl", "pairs", "label", "base", "diagonal")
        .agg(F.collect_set("tpl_pos").alias("met"), F.min("pos").alias("low"), F.max("pos").alias("high"))
    )
    order = "(PARTITION BY doc_id, text_key, tpl ORDER BY diagonal)"
    return (
        votes.selectExpr("*", f"if(diagonal - lag(diagonal) OVER {order} <= {gap}, 0, 1) AS opens")
        .selectExpr("*", f"sum(opens) OVER {order} AS chain")
        .groupBy("doc_id", "text_key", "tpl", "pairs", "label", "base", "chain")
        .agg(
            F.min("low").alias("start"),
            F.expr("max(high) + 2 AS stop"),
            F.expr("collect_list(if(size(met) = pairs, diagonal, NULL)) AS exact_starts"),
            F.expr("size(array_distinct(flatten(collect_list(met)))) / first(pairs) AS score"),
        )
        .drop("chain")
    )


def scan_licenses(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE
) -> DataFrame:
    """One row per text: counts and labels of base phrases, all labels, best score, spans.

    ``spans`` holds (label, start, stop, score) of every verified span, in words.
    """
    scratch = Scratch(docs.sparkSession, "licenses")
    hits = scratch.stage(pair_hits(docs, templates(docs.sparkSession), id_col, text_col), "hits")
    verified = merged_spans(hits).where(F.col("score") >= share)
    keys = ["doc_id", "text_key"]
    per_text = verified.groupBy(*keys).agg(
        F.expr("array_sort(flatten(collect_list(if(base, exact_starts, NULL)))) AS starts"),
        F.expr("collect_set(if(base AND size(exact_starts) > 0, label, NULL)) AS base_set"),
        F.expr("collect_set(if(base AND size(exact_starts) = 0, NULL, label)) AS label_set"),
        F.max("score").alias("score"),
        F.expr("array_sort(collect_list(struct(start, stop, label, score))) AS spans"),
    )
    texts = hits.where("pos = -1").select(*keys, "n_words")
    same = texts["doc_id"].eqNullSafe(per_text["doc_id"]) & (texts["text_key"] == per_text["text_key"])
    return texts.join(per_text, same, "left").select(
        texts["doc_id"],
        "n_words",
        F.expr("CAST(coalesce(size(starts), 0) AS BIGINT) AS n_base"),
        F.expr("if(size(starts) > 0, starts[0], NULL) AS first_word"),
        F.expr("if(size(starts) > 0, element_at(starts, -1), NULL) AS last_word"),
        F.expr("coalesce(array_join(array_sort(base_set), ','), '') AS base_labels"),
        F.expr("coalesce(array_join(array_sort(label_set), ','), '') AS labels"),
        F.expr("coalesce(score, 0D) AS score"),
        F.expr("coalesce(spans, CAST(array() AS ARRAY<STRUCT<start: BIGINT, stop: BIGINT, label: STRING, score: DOUBLE>>)) AS spans"),
    )
