"""Token counts through a cache of content digests.

The cache is a Parquet table (digest, tokenizer, n_tokens) that calls append to.  A count is found
by the SHA-256 of the normalised content (null becomes the empty text; nothing else may change,
since a tokenizer's count depends on every byte) and the tokenizer's digest (its file's bytes and
the library's version).  Only one text of each digest that the cache lacks is tokenised.

Digests travel, texts only once: a representative row of each missing digest is found from ids and
digests, and the texts are met with these rows by (digest, id), so that a digest shared by a third
of all rows makes no large task.  The counts go back by a sort-merge join of thin rows, which
Spark splits where one digest is frequent.

Edge cases: null and empty texts have 0 tokens; copies and repeated rows each keep their row; null ids
are ids like others; rows of an append that was repeated count once.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import folder
from . import bpe
from .shared import add_columns, keeps_columns, written
from .textbytes import flat

CACHE = "digest binary, tokenizer string, n_tokens long"


def tokenizer_digest(path: str) -> str:
    """A digest of the tokenizer file and its library's version."""
    import sentencepiece
    import tokenizers

    version = sentencepiece.__version__ if path.endswith(".model") else tokenizers.__version__
    with open(path, "rb") as f:
        return hashlib.sha256(f"{version}\n".encode() + f.read()).hexdigest()


@lru_cache(2)
def counter(path: str) -> Callable[[pa.Array], np.ndarray]:
    """What gives the number of tokens of each text of a column, as the library does by default."""
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda column: np.array([len(x) for x in pieces.encode(column.to_pylist(), num_threads=1)], np.int64)
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()

    def lengths(texts: list[str]) -> np.ndarray:
        return np.array([len(x) for x in library.encode_batch_fast(texts, add_special_tokens=False)], np.int64)

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec["pre_tokenizer"] or {}
    if spec["normalizer"] or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space"):
        return lambda column: lengths(column.to_pylist())
    # words are tokenised each by itself, so the library has to see each of them once
    special = tuple(t["content"].encode() for t in spec["added_tokens"])

    def learn(new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return lengths([w.decode() for w in new]), np.ones(len(new), np.int64)

    table = bpe.WordTable(learn)

    def count(column: pa.Array) -> np.ndarray:
        data, offsets = flat(column)
        starts, ends, first, marks = bpe.words(data, offsets, special)
        index = table.look_up(data, starts, ends)
        each = table.values[table.start[index]].astype(np.int64)
        each[list(marks)] = 1
        sums = np.append(0, np.cumsum(each))
        return sums[first[1:]] - sums[first[:-1]]

    return count


def _cached(spark: SparkSession, path: str, tokenizer: str) -> DataFrame:
    try:
        rows = spark.read.schema(CACHE).parquet(path)
    except AnalysisException:
        rows = spark.createDataFrame([], CACHE)
    return rows.where(F.col("tokenizer") == tokenizer).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


@keeps_columns("doc_id", "text", new=("n_tokens",))
def add_token_counts(documents: DataFrame, path: str, cache: str | None = None) -> DataFrame:
    """``documents`` (doc_id, text) with n_tokens; ``cache`` is the cache's folder, a new one where it is None."""
    spark = documents.sparkSession
    cache = cache or folder(spark, "token-cache")
    version = tokenizer_digest(path)
    content = F.coalesce("text", F.lit(""))
    keyed = documents.withColumn("__digest", F.unhex(F.sha2(content, 256)))
    lead = keyed.groupBy(F.col("__digest").alias("digest")).agg(F.min("doc_id").alias("lead"))
    missing = lead.join(_cached(spark, cache, version), "digest", "left_anti")
    texts = keyed.select(content.alias("text"), "doc_id", "__digest").join(missing, F.expr("__digest = digest and doc_id <=> lead"), "left_semi")

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array(counter(path)(batch.column("text")))]

    counted = add_columns(texts.select("text", F.col("__digest").alias("digest")), "n_tokens long", make)
    counted.select("digest", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)
    counts = written(_cached(spark, cache, version), "token-counts").withColumnRenamed("digest", "__digest")
    return keyed.join(counts, "__digest").drop("__digest")
