"""Text to sparse vectors: TF-IDF over hashed words, fitted on Spark, in place of a neural encoder.

Words are runs of letters, marks, digits and underscores in lower case. A word's bucket comes from its CRC-32, which any
other system computes alike, times a constant, since checksums of like words differ alike. A vector has unit length and lists its buckets in ascending
order with weights in parts of 1 / ``UNIT``, so products of vectors are exact integers and ties are real ties.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import SPARSE

BUCKETS = 1 << 18
UNIT = 1 << 20
MIX = 1640531527  # odd, and small enough for products with 32 bits
_WORD = r"[\p{L}\p{M}\p{N}_]+"


@dataclass(frozen=True)
class TextModel:
    """The inverse document frequency of every bucket, and which words count."""

    idf: np.ndarray  # 8 bytes a bucket, whatever the number of documents
    min_letters: int = 1


def word_buckets(text: Column, buckets: int, min_letters: int = 1) -> Column:
    """The bucket of every word of a text, in text order."""
    words = F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0))
    if min_letters > 1:
        words = F.filter(words, lambda w: F.length(w) >= min_letters)

    def bucket(word: Column) -> Column:
        mixed = (F.crc32(word.cast("binary")) * MIX).bitwiseAND(F.lit(0xFFFFFFFF))
        return F.shiftright(mixed * buckets, 32).cast("int")

    return F.transform(words, bucket)


def fit_vectors(chunks: DataFrame, text: str = "content", buckets: int = BUCKETS, min_letters: int = 1) -> TextModel:
    """Document frequencies are one distributed aggregate; at most one number per bucket comes back.

    ``buckets`` is how many buckets the words share. Words of fewer than ``min_letters`` are left out.
    """
    used = F.array_distinct(word_buckets(F.col(text), buckets, min_letters))
    # every text also counts under -1, so that one pass tells their number, too
    held = chunks.filter(F.col(text).isNotNull()).select(F.explode(F.array_append(used, F.lit(-1))).alias("bucket"))
    counts = held.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).toArrow()
    found, n = (counts.column(c).to_numpy() for c in ("bucket", "n"))
    texts = int(n[found < 0].sum())
    frequency = np.zeros(buckets, np.int64)
    frequency[found[found >= 0]] = n[found >= 0]
    return TextModel(np.log((texts + 1) / (frequency + 1)), min_letters)


def _weigher(idf: np.ndarray):
    size = len(idf)

    def weigh(words: pa.Array) -> pa.Array:
        rows = len(words)
        lengths = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
        flat = words.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        key, times = np.unique(np.repeat(np.arange(rows), lengths) * size + flat, return_counts=True)
        row, bucket = key // size, key % size
        weight = times * idf[bucket]
        length = np.sqrt(np.bincount(row, np.square(weight), rows))
        whole = np.floor(np.divide(weight, length[row], out=np.zeros_like(weight), where=length[row] > 0) * UNIT + 0.5)
        seen = whole > 0
        row, bucket, whole = row[seen], bucket[seen], whole[seen]
        ends = pa.array(np.searchsorted(row, np.arange(rows + 1)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.array(v.astype(np.int32))) for v in (bucket, whole)]
        empty = pa.array(np.bincount(row, minlength=rows) == 0)
        return pa.StructArray.from_arrays(lists, names=["buckets", "weights"], mask=empty)

    return weigh


def vectorise(model: TextModel, df: DataFrame, text: str = "content", out: str = "embedding") -> DataFrame:
    """Adds the sparse vector of a text; null for texts without words that tell them apart, which match nothing."""
    words = word_buckets(F.coalesce(F.col(text), F.lit("")), len(model.idf), model.min_letters)
    kept = [c for c in df.columns if c != out]
    return df.select(*kept, F.arrow_udf(_weigher(model.idf), SPARSE)(words).alias(out))
