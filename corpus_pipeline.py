"""The corpus pipeline: language ID, exact dedup, near dedup, mixing, and encoding with a round trip.

Each stage is (name, function of (spark, docs, sf_dir)); its result is written as Parquet and read again as the next one's
documents. A stage sees all that its predecessor kept, and all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonelake.llm import exact_dedup, language_id, mixing, ngram_join, pieces
from tonelake.llm.common import stored, table
from tonelake.llm.queries import MIX_WEIGHTS, tokenizer_path

MIX_SEED = "pipeline-1"
NEAR_WORDS, NEAR_PERCENT = 5, 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told, with that language in ``lang``. A row's label, where there is one, only serves to learn from.

    Defined results: null and empty texts go, so do texts without letters and those whose best score is below ``language_id.NOISE`` (a few odd
    letters); repeated rows go or stay together; very long texts are judged whole. Without any labelled row to learn from, rows with a letter stay as
    they are. An empty table stays empty."""
    prototypes = language_id.fit(docs, ~language_id.held_out(F.col("doc_id")))
    if not prototypes:
        return docs.filter(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return language_id.recognised(docs, prototypes)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the largest id stays, the rule of the exact-dedup query.

    Defined results: null and empty texts are equal; a row without an id goes if a copy has one; of repeated rows one stays; texts of any length are compared
    whole. An empty table stays empty."""
    return exact_dedup.deduplicate(docs, keep="largest")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by shingles of five words at a similarity of 0.8 or more the one with the smallest id stays.

    Defined results: texts without words, null or empty, link with nothing and all stay; rows without an id link like others and go if the group has one with
    an id; rows that repeat an id and its text stay together; texts of any length are compared whole. An empty table stays empty."""
    return ngram_join.near_deduplicate(docs, width=NEAR_WORDS, percent=NEAR_PERCENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources repeated or thinned to their target shares, and everything shuffled.

    Defined results: a null source is a source of its own; rows with one id in one source are repeated equally often, rows without an id as the empty one;
    texts are not looked at. An empty table stays empty."""
    return mixing.mixed_documents(docs, MIX_WEIGHTS, seed=MIX_SEED)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document (each of its copies) and the digest of what they decode to.

    Defined results: null and empty texts have begin and end ids alone; repeated rows are encoded each; a row without an id keeps none; texts of any length are
    encoded whole. An empty table gives an empty result."""
    return pieces.encode_decode(docs, tokenizer_path("piece_bpe_32k.model"), keep_ids=True).select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources", mix_sources),
    ("SentencePiece coding", encode),
]

#: Language profiles, links of similar sets and piece merges are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; all but the last stage's result are kept in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
