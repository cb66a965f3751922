"""Text retrieval: question texts to vectors to nearest chunks to prompt context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from ..functions.text import fill_template, issue_label
from ..schemas import TEXT_VECTORS
from .knn import sparse_knn
from .vectors import BUCKETS, TextModel, fit_vectors, vectorise

ASKED_BY = ["issue_type", "threat_level"]


def questions(actions: DataFrame, as_words: bool = True) -> DataFrame:
    """One question per distinct issue and threat level: complaints that ask the same share one search.

    Issue codes are asked as words, since no chunk holds a code; ``as_words=False`` asks them as they are.
    """
    asked = actions.select(*ASKED_BY).distinct()
    worded = asked.withColumn("_issue", F.col("issue_type"))
    if as_words:
        worded = worded.withColumn("issue_type", issue_label("issue_type"))
    worded = worded.withColumn("query_text", fill_template(fixed.RETRIEVAL_QUERY))
    asked = worded.select(F.col("_issue").alias("issue_type"), "threat_level", "query_text")
    return asked.withColumn("query_id", F.md5("query_text"))


def embed_chunks(chunks: DataFrame, buckets: int = BUCKETS, min_letters: int = 1) -> tuple[TextModel, DataFrame]:
    """The fitted model and the vector table (chunk_id, content, source, embedding)."""
    model = fit_vectors(chunks, buckets=buckets, min_letters=min_letters)
    return model, vectorise(model, chunks).select(*TEXT_VECTORS.fieldNames())


def search(model: TextModel, vectors: DataFrame, texts: DataFrame, k: int = 3) -> DataFrame:
    """Nearest chunks for a table of questions: query_id (short and unique) and query_text.

    ``vectors`` is a stored table: the search reads it once to size its tiles and once to scan it."""
    asked = texts.select("query_id", "query_text").dropDuplicates(["query_id"])
    return sparse_knn(vectorise(model, asked, "query_text"), vectors, k)


def retrieve(actions: DataFrame, model: TextModel, vectors: DataFrame, k: int = 3) -> DataFrame:
    """Hits for every distinct (issue_type, threat_level): the question, then chunk, score and rank."""
    asked = questions(actions)
    hits = search(model, vectors, asked, k)
    named = asked.join(hits, "query_id")
    return named.select(*ASKED_BY, "query_id", "query_text", "chunk_id", "content", "source", "score", "rank")
