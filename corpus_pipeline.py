"""Five cleaning stages over the documents table, in order.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlode.llm import minhash, packing, quality, suffix, toxicity
from emberlode.llm.textops import Rounds


#: Percent of word shingles that near duplicates share; the 85 of op8 holds for that query alone.
SIMILAR = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the toxicity classifier rejects.

    Null and empty texts have the model's prior and stay; repeated rows fare alike;
    an empty table stays empty; other columns, whatever their names, are carried along.
    """
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects.

    Null and empty texts have the model's prior; repeated rows fare alike; an empty
    table stays empty; other columns, whatever their names, are carried along.
    """
    return quality.drop_poor(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the least id.

    Rows go by id and text: of rows that share an id each fares as its own text does,
    and rows that repeat both stay or go together. Rows without an id, and texts
    without words, stay. An empty table stays empty; other columns are carried along.
    """
    gone = minhash.near_duplicates(docs, similar=SIMILAR, with_hash=True).where("not kept").select("doc_id", "text_hash").distinct()
    rows = docs.select(F.struct("*").alias("row"))
    return rows.join(gone, (F.col("row.doc_id") == gone["doc_id"]) & (F.xxhash64(F.col("row.text").cast("string")) == gone["text_hash"]), "left_anti").select("row.*")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that stand in a document with a smaller id.

    Of a character that a cut splits, the rest goes too; n_chars follows the text. Rows
    go by id and text, so rows that share an id keep what is left of their own texts.
    Rows without an id and null texts stay as they are, a text that is cut away whole is
    empty. An empty table stays empty; other columns are carried along.
    """
    kept = suffix.repeated(docs, with_text=True).where("n_removed > 0").select("doc_id", "text_md5", "kept_text").dropDuplicates(["doc_id", "text_md5"])
    rows = docs.select(F.struct("*").alias("row"))
    out = rows.join(kept, (F.col("row.doc_id") == kept["doc_id"]) & (F.unhex(F.md5(F.col("row.text").cast("string").cast("binary"))) == kept["text_md5"]), "left")
    cut = kept["kept_text"]
    changed = {"text": F.coalesce(cut, F.col("row.text"))} | ({"n_chars": F.when(cut.isNull(), F.col("row.n_chars")).otherwise(F.length(cut).cast("long"))} if "n_chars" in docs.columns else {})
    return out.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of op1_packing; a null text is the end id alone."""
    return packing.pack(docs, with_ids=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_strings", cut_repeats),
    ("packing", packed),
]
#: Tokens, classifiers and shingle groups are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents table; what each filter keeps is written, so that the next reads it and nothing is made twice."""
    docs, rounds = spark.read.parquet(f"{sf_dir}/documents.parquet"), Rounds(spark)
    for _, stage in STAGES[:-1]:
        docs, before = rounds.put(stage(spark, docs, sf_dir)), docs
        rounds.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
