"""Problem 8: queries."""

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.encoding import count_tokens
from tessera.llm.mixing import mix
from tessera.plans.lineage import cut
from tessera.sources import read_table


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sizes = cut(count_tokens(read_table(spark, sf_dir, "documents"), "doc_id", "source"))
    return mix(sizes, read_table(spark, sf_dir, "mix_targets"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[1]


QUERIES = {"p8_mix": p8_mix, "p8_shares": p8_shares}
SQL: dict[str, str] = {}
