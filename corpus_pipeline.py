"""From raw documents to packed training sequences, by five operators of ``sparkgauge.llm``.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet
and read again as the next one's documents.  All but the last return the columns of ``documents``.

In every stage a null or empty text is a document like any other, a long one is read whole, an empty table gives an empty
table, and columns other than those of ``documents`` are not looked at.  What a stage does with them, with ties and with repeated rows stands with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkgauge.llm import line_dedup, mixing, packing, simhash, toxicity
from sparkgauge.llm.common import DOCUMENT_COLUMNS, materialise, read_table
from sparkgauge.llm.entries import vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network scores 0.5 or more go.

    Texts without words stay; equal texts have equal scores, so repeated rows stay or go together; ``doc_id`` may be null.
    Without labels of both kinds all documents are on the side of the one there is (clean without any).
    """
    return toxicity.keep_clean(docs.select(*DOCUMENT_COLUMNS), read_table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of lines that earlier documents hold go; documents stay.

    Earlier is by ``doc_id`` (null last), then by the text's digest; all rows that agree in both are one document and stay alike.
    Null texts stay null; a text all of whose lines go is left empty or blank.
    """
    return line_dedup.dedup_lines(docs).select(*DOCUMENT_COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays.

    Near copies share most shingles of five words: at most 7 of 64 fingerprint bits differ, and at most 18 of 64 further ones.  Texts
    without words are one group.  Of repeated rows one stays; a row without ``doc_id`` only where its group has no other.
    """
    return simhash.keep_one(docs).select(*DOCUMENT_COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: 0 to 3 times.

    A null source is one of its own; texts without words are taken once; rows equal in id, source and size equally often.
    """
    return mixing.apply_mix(docs).select(*DOCUMENT_COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens.

    Every row is a document of its own, with its end token at least; ids that are null or repeat are carried as they are.
    """
    return packing.harmonic_pack(docs, vocabulary("word_bpe_49k.json"), end_id=2)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("simhash near-dedup", drop_near_duplicates),
    ("source mixing", mix_sources),
    ("packing", pack_sequences),
]

#: A trained network, hashes of another kind and a tokenizer stand in it, none of which SQL has.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written to the shared folder before the next reads it."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
