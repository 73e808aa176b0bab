"""A training-data pipeline over the documents table: quality, toxicity, near-duplicates, mixing, packing.

Every stage takes (spark, docs, sf_dir) and gets all that the stage before it kept; all but the last return the columns
of documents. Extra columns pass through; nulls, empty tables and repeated rows have the results that the operators
state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from courtlight.llm import mixing, packing, queries, rules, simhash, toxicity
from courtlight.llm.common import materialise, table


def _row(docs: DataFrame) -> Column:
    """All columns as one struct, so that columns added by a stage clash with none of them."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the current policy.

    Null, empty and short texts are rejected; equal rows are judged alike; columns of any name pass through.
    """
    judged = rules.ledger(docs.select(_row(docs), "text"))
    return judged.filter(rules.passes(rules.BASE) & rules.passes(rules.POLICY)).select("row.*")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below one half, by a model of the labelled ones among them.

    Null and empty texts stay, and all do where no document is labelled; equal texts are judged alike.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(_row(docs), "text"), model).filter("toxicity < 0.5").select("row.*")


#: Near-duplicates of the pipeline: shingles of five words, Jaccard similarity of 0.8.
ALIKE = simhash.similar(5, 0.8)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near-duplicates.

    Null, empty and wordless texts are one group. Rows without an id come last in a group; equal rows count as one.
    """
    return simhash.one_of_each(docs, kind=ALIKE)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the target weights take, each once at most.

    Null domains, languages and sources are leaves of their own; rows of one id are taken or left together.
    """
    tagged = docs.select(_row(docs), "doc_id", "text", "lang", "source").withColumn("domain", queries.domain())
    mixed = mixing.mix(tagged, queries.PATH, queries.WEIGHTS, queries.n_words(), total_share=0.8, epochs=1.0, seed=9)
    return mixing.repeated(mixed).select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 1024 tokens; a null or empty text is its end id alone."""
    # the workers have served the stages before: a smaller memory of pieces, which changes only the speed
    return packing.pack_documents(docs, queries.BYTE_BPE, remembered=300_000)


STAGES = [
    ("quality rules", quality),
    ("toxicity", toxic),
    ("simhash near-duplicates", near_duplicates),
    ("mixing", mixture),
    ("packing", packed),
]

#: Compression distances, fingerprints and token ids have no SQL; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; what each keeps is a written table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
