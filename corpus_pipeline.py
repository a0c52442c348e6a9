"""From raw documents to packed sequences: STAGES in order, each over all that its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from factloom.llm import ball_simhash, language_id, pareto_mix, quality_eb, residual_packing
from factloom.llm.common import aside, cut, read
from factloom.llm.queries import TOKENIZER, site

#: A document whose language is predicted with less than this goes, as does one without any letter.
SURE = 0.25


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs that the quality classifier keeps. Null and empty texts are judged as empty ones, rows of null sources as of one site; repeated rows
    are judged each; without labels all stay; no rows give none. Other columns, whatever their names, go along."""
    inner, own = aside(docs)
    found = quality_eb.classify(inner, read(spark, sf_dir, "labels"), *site(inner), columns=inner.columns)
    return own(found.where("keep"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs whose language is predicted. Null texts and ones without letters go; repeated rows are judged each; without any language to
    learn all go; no rows give none. Other columns, whatever their names, go along."""
    docs, own = aside(docs)
    found = language_id.identify(docs, language_id.fit(docs))
    return own(found.where((found.lang_pred != language_id.UNKNOWN) & (found.score >= SURE)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: the smallest id (null last), then text hash. Null and empty texts are one group; of repeated
    rows one stays; no rows give none. Other columns, whatever their names, go along."""
    return ball_simhash.keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it (0 to 2 times). Null and empty texts are taken as the shortest texts are; a null source is one of its
    own; repeated rows are documents of their own; no rows give none. Other columns, whatever their names, go along."""
    return pareto_mix.repeated(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows in sequences. A null or empty text is one piece, its end; repeated rows are packed each; no rows give none. Other columns
    are left out."""
    return residual_packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("quality", quality), ("language", language), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]

#: Classifiers, fingerprints and tokenizers have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
