"""From raw documents to token ids: language, near copies, source mix, pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm.common import stage, table
from wayfold.llm.language import known_language
from wayfold.llm.mixing import mixed
from wayfold.llm.ngram_join import without_copies
from wayfold.llm.sentencepieces import encode, vocabulary_path

#: Score below which a document's language counts as unknown.
LEAST_SCORE = 0.05


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; ``lang`` is the one predicted. Null and letterless texts go; equal rows go or stay together."""
    return known_language(docs, LEAST_SCORE)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, that of the least doc_id, nulls last. Documents without words all stay."""
    return without_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: not at all, once or twice.

    A null source is one of its own; a null text has size 0; of documents alike in id and text as many are taken as are due.
    """
    return mixed(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_chars, n_tokens, ids): the piece ids of every text; none for a null or empty one.

    Repeated documents give repeated rows."""
    out = encode(docs, vocabulary_path(), ["doc_id", "lang", "source", "n_chars"])
    return out.select("doc_id", "lang", "source", "n_chars", F.size("ids").alias("n_tokens"), "ids")


STAGES = [("language ID", language), ("n-gram Jaccard join", near_copies), ("mixing to weights", mix), ("SentencePiece", pieces)]
#: No SQL gives the model, the hashes or the pieces; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name.split()[0]}")
    return docs
