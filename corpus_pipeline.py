"""Documents to packed training sequences: the stages of the corpus pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tersa.llm import decontaminate, packing, quality, simhash, suffix_dedup
from tersa.llm.common import Scratch
from tersa.workload.views import table

#: No SQL: a trained classifier, XXH64 fingerprints and a tokenizer take part. Tests hold it against brute force.
ORACLE_SQL = None

_finished: list[Scratch] = []


def _scratch(spark: SparkSession, docs: DataFrame, name: str) -> Scratch:
    """A scratch folder for a stage. Those of earlier stages go, as their results are written by now (``docs`` reads none of them)."""
    read = docs.inputFiles() if _finished else []
    for old in list(_finished):
        if old.spark is not spark:
            _finished.remove(old)
        elif not any(old.root.split(":")[-1] in path for path in read):
            old.drop("")
            _finished.remove(old)
    _finished.append(Scratch(spark, name))
    return _finished[-1]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier accepts, as they are.

    Null text counts as empty and is judged; repeated rows are judged alike; an empty table stays empty. Other columns
    stay, whatever their names. A very long text is read in one task.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), _scratch(spark, docs, "quality"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints link (four-word shingles, at most 4 bits): the smallest doc_id, nulls last.

    Texts without a word, null ones too, are one group; rows that repeat whole stay once; an empty table stays empty. Other
    columns stay, whatever their names. A very long text is read in one task.
    """
    return simhash.one_of_each(docs, _scratch(spark, docs, "near"))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the 50-byte strings that a smaller doc_id has too, cut at whole characters; n_chars follows.

    Null text becomes empty; rows of one doc_id are one side and cut nothing from each other; an empty table stays empty. Other columns
    stay, whatever their names. A very long text is cut into segments that tasks share.
    """
    return suffix_dedup.without_repeats(docs, _scratch(spark, docs, "suffixes"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of whose words less than a twentieth lies in benchmark windows, as they are.

    Null or empty text has no words and stays; repeated rows are judged alike; an empty table stays empty. Other columns stay, whatever
    their names. A very long text is read in one task.
    """
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"), _scratch(spark, docs, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document and their places in sequences of at most 1024 tokens.

    Null text is empty (a lone end token); repeated rows are pieces of their own; an empty table gives no rows. Other columns are not
    read. A very long text is tokenised in one task.
    """
    return packing.pack(packing.token_pieces(docs), _scratch(spark, docs, "packing"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("near_dedup", drop_near_duplicates),
    ("suffix_dedup", cut_repeated_passages),
    ("decontaminate", drop_contaminated),
    ("pack", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's rows are written and read again before the next one, then deleted; returns the packed pieces."""
    docs, written, before = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline"), None
    for name, stage in STAGES:
        docs = written.keep(stage(spark, docs, sf_dir), name)
        if before:
            written.drop(before)
        before = name
    return docs
