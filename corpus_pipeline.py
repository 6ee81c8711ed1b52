"""Corpus pipeline: language ID, near-duplicate removal, pseudonyms, source mix, token counts.

``STAGES`` are ``(name, function)``; each function takes ``(spark, docs, sf_dir)`` and returns a
DataFrame that is written as Parquet and read again as the next one's ``docs``.  All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bizlens.llm import bpe, langid, mixing, pii, simhash
from bizlens.llm.common import held_out, scratch_path, table
from bizlens.llm.queries import tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language is found (no text, or no letter in it) go; the others, texts of
    several languages among them, keep all columns.  The model learns from the labelled rows of
    ``documents``."""
    labelled = table(spark, sf_dir, "documents")
    model = langid.train(labelled.where(~held_out(F.col("doc_id"))))
    names = ("_found_lang", "_found_share", "_found_spans")
    judged = langid.identify(docs, model, names=names)
    return judged.where(F.col(names[0]) != langid.UNKNOWN).drop(*names)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near-duplicates the document with the smallest doc_id stays (one row, also
    where rows repeat)."""
    return simhash.keep_one(docs, width=4, radius=4)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in ``text`` becomes pseudonyms; ``n_chars`` follows where the text changed."""
    done = pii.pseudonymise(docs)
    changed = F.size("_pii_kinds") > 0
    columns = {"text": F.col("_pii_text"),
               "n_chars": F.when(changed, F.length("_pii_text").cast("bigint")).otherwise(F.col("n_chars"))}
    return done.select(*[columns[c].alias(c) if c in columns else F.col(c) for c in docs.columns])


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text, one row a document taken."""
    return bpe.tokenize(docs.select("doc_id", "text"), tokenizer_path())


STAGES = [("language_id", language_id), ("simhash_dedup", simhash_dedup), ("pseudonyms", pseudonyms),
          ("source_mix", source_mix), ("bpe", encode)]

#: A Viterbi model, fingerprint trees, Feistel rounds and merges have no SQL; tests hold run() against
#: plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written under the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
