"""Token counts of whole texts through a digest cache.

The cache is a Parquet table of (version, digest, n_tokens): ``version`` digests the
tokenizer file, its library and the normalisation, ``digest`` (SHA-256) the normalised
content. Documents are joined to stored counts by digest. Only digests without a count
are encoded, each distinct content once wherever its copies lie, and their counts are
appended in one commit, so a later run over more documents or another corpus finds them.

The normalisation is a SQL expression that must not change a count; by default it only
makes null texts empty, as the tokenizers here keep blanks and case. Equal contents meet
in a partial aggregate first, so a hot copy is neither shuffled nor encoded twice. Null
and empty texts count like any text; null ids, repeated rows and other columns are
untouched: there is one row per row. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamperlens.functions.columns import quoted
from tamperlens.llm.common import Scratch, bounded_batches
from tamperlens.llm.textcells import batches
from tamperlens.plans.joins import attach_by_key
from tamperlens.plans.limits import Limits

COUNTS = "digest binary, n_tokens bigint"
#: digests shared by this many rows are broadcast instead of shuffled; at most 100,000 can be
HOT = Limits(hot_rows=1000)


def version_digest(tokenizer: str, normalise: str) -> str:
    """Digest of all that a count depends on besides the content."""
    found = hashlib.sha256()
    with open(tokenizer, "rb") as file:
        for piece in iter(lambda: file.read(1 << 20), b""):
            found.update(piece)
    found.update(f"|{os.path.splitext(tokenizer)[1]}|{normalise}".encode())
    return found.hexdigest()[:32]


def load_counter(path: str):
    """A function from texts to their numbers of tokens, kept from task to task.

    ``.model`` files go to sentencepiece, ``.json`` files to tokenizers; neither adds begin,
    end or other special tokens, cuts or pads. Special strings inside texts are handled as
    the library does by default.
    """
    held = sys.modules.setdefault("_tamperlens_counters", types.ModuleType("_tamperlens_counters"))
    counters = held.__dict__.setdefault("counters", {})
    if path not in counters:
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            counters[path] = lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            loaded = Tokenizer.from_file(path)
            loaded.no_truncation()
            loaded.no_padding()
            counters[path] = lambda texts: [len(e.ids) for e in loaded.encode_batch(texts, add_special_tokens=False)]
    return counters[path]


def stored_counts(spark: SparkSession, folder: str) -> DataFrame | None:
    """The counts of a version's folder, one row per digest; None where there are none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    # two runs may have counted a digest at the same time
    return spark.read.schema(COUNTS).parquet(folder).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(
    docs: DataFrame,
    cache: str,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: str = "coalesce({text}, '')",
) -> DataFrame:
    """Rows (id, n_bytes, n_tokens): UTF-8 bytes and tokens of every whole text.

    ``cache`` is a folder every executor reaches; it is created where it is missing and
    misses are appended to it. ``tokenizer`` is a file present on every machine.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "token-counts")
    text = f"CAST({quoted(text_col)} AS STRING)"
    content = normalise.format(text=text)
    folder = f"{cache.rstrip('/')}/version={version_digest(tokenizer, normalise)}"
    digest = f"unhex(sha2({content}, 256)) AS digest"
    keyed = scratch.stage(
        docs.selectExpr(
            f"{quoted(id_col)} AS id", f"CAST(octet_length(coalesce({text}, '')) AS BIGINT) AS n_bytes", digest
        ),
        "keyed",
    )
    distinct = scratch.stage(keyed.groupBy("digest").agg(F.count("*").alias("rows")), "digests")
    contents = docs.selectExpr(f"{content} AS content", digest).groupBy("digest").agg(F.min("content").alias("content"))
    stored = stored_counts(spark, folder)
    if stored is not None:
        misses = scratch.stage(distinct.join(stored, "digest", "left_anti").select("digest"), "misses")
        # few misses are broadcast and pushed below the aggregate, so known texts are not shuffled
        contents = contents.join(misses, "digest", "left_semi")

    def encode(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = load_counter(tokenizer)
        for frame in frames:
            texts = frame.column(1).to_pylist()
            sizes = [n for begin, end in batches(texts, 1 << 20) for n in count(texts[begin:end])]
            yield pa.RecordBatch.from_arrays(
                [frame.column(0), pa.array(np.array(sizes, np.int64))], names=["digest", "n_tokens"]
            )

    contents.mapInArrow(encode, COUNTS).write.mode("append").parquet(folder)
    found = scratch.stage(distinct.join(stored_counts(spark, folder), "digest"), "counts")
    return attach_by_key(keyed, found, ["digest"], "rows", HOT).selectExpr(
        f"id AS {quoted(id_col)}", "n_bytes", "n_tokens"
    )
