"""The corpus pipeline: language, near duplicates, personal data, mixture, tokens.

Each stage takes all that the one before it kept, and all but the last return
the columns of ``documents``. The stages fit models and count over a corpus, so
SQL cannot express their chain; tests hold it against brute force. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallspark.llm import byte_bpe, language_id, mixing, near_dedup, pii
from recallspark.llm.common import documents, free_name, small_batches, stored
from recallspark.llm.queries import vocabulary

#: A language is accepted from this posterior probability on.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters or with no clear language.

    Null, empty and letterless texts go; repeated rows and rows without an id
    are judged like others. Columns of any name pass unchanged."""
    small_batches(spark)
    model = public_tokenizers.path("piece_bpe_32k.model")
    lang, score = (free_name(docs.columns, x) for x in ("lang_pred", "score"))
    found = language_id.identify(docs, model, keep=tuple(docs.columns), names=(lang, score))
    return found.where((F.col(lang) != language_id.UNDETERMINED) & (F.col(score) >= LEAST_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, by five words: the
    one of the least id. Texts without words, null or empty, all stay; of
    repeated rows one stays."""
    small_batches(spark)
    return near_dedup.one_of_each(docs, width=5)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces protected values and the terms that disclose them. No row goes;
    null texts stay null, and n_chars follows the text."""
    return pii.sanitised(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents of small sources, up to the limit; drops none. A null
    source is one of its own."""
    names = tuple(free_name(docs.columns, x) for x in ("tokens", "pass", "block"))
    return mixing.mixed(docs, repeats=mixing.MAX_REPEATS, names=names).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the round trip; a null text
    has no ids."""
    small_batches(spark)
    return byte_bpe.round_trip_digests(docs, vocabulary(), keep=("doc_id", "lang", "source"), with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixture", mixture),
    ("tokens", tokens),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written and read again."""
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
