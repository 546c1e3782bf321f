"""From raw documents to token ids in five stages, each an operator of ``cellspan.llm``.

Every stage takes (spark, docs, sf_dir), works on all rows that the one before kept,
and acts on its own verdict.  All but the last return the columns they were given.
Texts may be null (they have no words), keys may be null or repeated: rows are handled
one by one, and only the join stage lets one row of a group stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellspan.llm.common import durable, read_table, settle, ship_package
from cellspan.llm.jaccard_join import jaccard_components
from cellspan.llm.queries import tokenizer_path
from cellspan.llm.risk_rules import apply_rules
from cellspan.llm.rule_ensemble import score_quality
from cellspan.llm.sentencepiece_codec import encode_documents
from cellspan.llm.wu_manber import contamination_verdict, find_contamination


def _whole(docs: DataFrame) -> DataFrame:
    """The row as one struct beside what an operator needs: other columns can't clash."""
    return docs.select(F.struct(*docs.columns).alias("doc"), "doc_id", "text", "lang")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, fitted on the labels, scores under 0.5 go."""
    settle(spark)
    scored = score_quality(_whole(docs), read_table(spark, sf_dir, "labels"), F.lit(True), keep=("doc",))
    return scored.where("score >= 0.5").select("doc.*")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or a certified cutoff rejects go."""
    settle(spark)
    return apply_rules(_whole(docs), read_table(spark, sf_dir, "labels"), keep=("doc",)).where("kept").select("doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by a similarity of 0.8 on five-word shingles the one with
    the smallest key stays (of repeated rows one of them); those without words stay."""
    ship_package(spark)
    settle(spark)
    # no key and no row number is needed: a row is known by its key and a hash of all it holds
    name = F.struct(F.col("doc_id").isNull().alias("n"), F.coalesce(F.col("doc_id"), F.lit(0)).alias("id"), F.xxhash64(*docs.columns).alias("h"))
    rows = docs.select(F.struct(*docs.columns).alias("doc"), name.alias("key"))
    found = jaccard_components(docs.select(name.alias("key"), "text"), key="key", k=5, num=80, den=100)
    stay = durable(found.where("key = component").groupBy("key").agg(F.count("*").alias("rows")), "kept-documents")
    once = rows.join(stay.where("rows = 1"), "key", "left_semi")
    many = stay.where("rows > 1").select("key")
    if many.take(1):
        once = once.unionByName(rows.join(many, "key", "left_semi").dropDuplicates(["key"]))
    return once.select("doc.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with 13 words in a row of one item, a whole item, or windows of two items go; items under 8 words don't count."""
    settle(spark)
    found = find_contamination(_whole(docs), read_table(spark, sf_dir, "benchmark"), key="doc")
    return contamination_verdict(found).where("not leaked").select("doc.*")


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text."""
    ship_package(spark)
    settle(spark)
    out = encode_documents(docs, tokenizer_path())
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding and decoding", sentencepiece),
]
#: The classifier, the search and the encoder are beyond SQL; their operators are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each one's rows written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = durable(docs, f"stage-{i}")
    return docs
