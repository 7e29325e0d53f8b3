"""Problem 7: queries."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.encoding import decode_documents, encode_documents
from tessera.sources import read_table


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(read_table(spark, sf_dir, "documents"))


def p7_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose ids decode to their text (a NULL text to the empty one), all of them by the SQL."""
    docs = read_table(spark, sf_dir, "documents")
    back = decode_documents(encode_documents(docs)).select("doc_id", F.col("text").alias("decoded"))
    same = docs.select("doc_id", "text").join(back, "doc_id").filter(F.col("decoded") == F.coalesce("text", F.lit("")))
    return same.agg(F.count("*").alias("n_documents"), F.sum(F.length("decoded")).cast("bigint").alias("n_chars"))


QUERIES = {"p7_ids": p7_ids, "p7_roundtrip": p7_roundtrip}
SQL = {"p7_roundtrip": "SELECT count(*) AS n_documents, CAST(sum(coalesce(length(text), 0)) AS BIGINT) AS n_chars FROM documents"}
