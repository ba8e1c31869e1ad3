"""A corpus pipeline over ``documents``: toxicity, near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it
kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chaseline.llm import near_dups, packing, registry, secret_scans, toxicity
from chaseline.llm.shared import cut, table
from chaseline.session import ship_package


def _restored(rows: DataFrame, docs: DataFrame, **other: Column) -> DataFrame:
    """The columns of ``docs`` from an operator's ``kept_*`` ones, those in ``other`` replaced."""
    return rows.select(*(other.get(c, F.col("doc_id") if c == "doc_id" else F.col(f"`kept_{c}`")).alias(c) for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that operator 10 doesn't reject, with all their columns, whatever the names.

    Null ids and texts, empty texts and repeated rows are judged as any other; an empty
    table gives an empty table.
    """
    ship_package(spark)
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, keep=tuple(c for c in docs.columns if c != "doc_id"))
    return _restored(scored.filter("predicted = 0"), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (operator 2; five words, similarity 0.8), that of the smallest id.

    Documents without words stay. Rows of one id and one text become one, and of a repeated
    id with several texts all kept ones stay; a null id is kept only where no other is linked
    with it. An empty table gives an empty table; all columns stay, whatever their names.
    """
    ship_package(spark)
    return near_dups.without_near_duplicates(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, the secrets that operator 6 finds replaced by a mark and ``n_chars``, where there is one, counted anew.

    A null text stays null, with null ``n_chars``; null ids and repeated rows stay; an empty
    table gives an empty table; all other columns stay as they are, whatever their names.
    """
    ship_package(spark)
    keep = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    scanned = secret_scans.scan(docs, registry.vocabulary("byte_bpe_50k.tiktoken"), registry.pattern(), keep=keep)
    return _restored(scanned, docs, text=F.col("redacted"), n_chars=F.char_length("redacted").cast("long"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces in sequences of at most 1024 tokens (operator 8).

    A null or empty text is one piece, its end mark; repeated rows and null ids are packed
    as rows of their own; an empty table gives an empty table; other columns are not read.
    """
    ship_package(spark)
    return packing.pack(docs, registry.vocabulary("byte_bpe_50k.tiktoken"), registry.pattern(), registry.SPECIAL)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dups", drop_near_duplicates),
    ("secret_scans", redact_secrets),
    ("best_fit_packing", pack_sequences),
]

#: SQL can express neither the compression distance nor the token ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each cut off from the one before by a checkpoint."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
