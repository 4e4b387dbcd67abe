"""The corpus pipeline: raw documents to packed training sequences, in stages that are written and read again.

1. toxicity: documents predicted to be toxic go.
2. exact_dedup: of texts equal but for the case of A-Z, the row with the largest id stays.
3. simhash_near_dedup: of documents linked by five-word shingles with a Jaccard similarity of 0.8 or more, the one with the
   smallest id stays. Candidates come from SimHash fingerprints of these shingles; an exact search adds what they miss.
4. source_mixing: sources are brought to their target weights; a document may come once per pass, and the one at which
   a source's budget ends is cut there.
5. best_fit_packing: what is left is tokenised and packed.

All stages but the last return the columns they were given. Null texts count as empty; empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scorewright.llm import exact_dedup, mixing, packing, shingle_dedup, toxicity
from scorewright.llm.queries import MIX_WEIGHTS, TOKENIZER
from scorewright.llm.registry import table
from scorewright.session import pin


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shingle_dedup.drop_near_copies(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(docs, MIX_WEIGHTS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, **TOKENIZER)


STAGES = [("toxicity", toxicity_stage), ("exact_dedup", exact_stage), ("simhash_near_dedup", near_stage),
          ("source_mixing", mixing_stage), ("best_fit_packing", packing_stage)]

#: The stages train a model and draw by hash, which SQL can't express; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = pin(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
