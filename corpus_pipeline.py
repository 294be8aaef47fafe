"""The corpus pipeline: five operators of quern.llm in turn over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept. All but the last return the columns of documents, extra ones included,
whatever their names: what a stage computes has no name beside theirs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.bpe import both_ways
from quern.llm.common import boxed, cut, remove_tables, tables
from quern.llm.mixing import mixed_documents
from quern.llm.quality import fit_quality, quality_of
from quern.llm.simhash import near_dedup
from quern.llm.suffix_dedup import without_repeats
from quern.session import share_code, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score below 0.3) go."""
    share_code(spark)
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return boxed(docs, score=quality_of(spark, model, F.col("text"))).where("score >= 0.3").select("row.*")


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash class stays: the least doc_id."""
    share_code(spark)
    return near_dedup(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more stay where they occur first."""
    share_code(spark)
    return without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are left out or repeated until each source's words come near its target."""
    return mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and whether they decode to its bytes."""
    import public_tokenizers as tokenizers

    share_code(spark)
    vocabulary = tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN
    out = boxed(docs, made=both_ways(docs, *vocabulary, F.col("text")))
    same = F.col("made.decoded") == F.encode(F.coalesce("row.text", F.lit("")), "UTF-8")
    return out.select("row.doc_id", "row.lang", "row.source", F.size("made.ids").cast("long").alias("n_tokens"), "made.ids", same.alias("round_trip"))


STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", keep_one_of_near_copies),
    ("suffix-array dedup", cut_repeated_passages),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode),
]

#: SQL can't express the trained classifier, the fingerprints or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written and read again, and what was cut to make it is removed."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        mark = tables()
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs)
            remove_tables(spark, mark, tables() - 1)
    return docs
