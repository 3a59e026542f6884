"""Problems 8 and 9: containers of fixed capacity, and mixtures of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from phloem.llm.mixing import mix
from phloem.llm.packing import fill_report, pack
from phloem.llm.tokens import with_tokens
from phloem.storage import Stage, table


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of all documents, written once as several passes read them."""
    sized = with_tokens(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "source", "tokens")
    return Stage(spark, "sizes").write(sized, "sizes")


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_sizes(spark, sf_dir), table(spark, sf_dir, "pack_specs"), "doc_id")


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_report(p8_packed(spark, sf_dir), table(spark, sf_dir, "pack_specs"))


def p9_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inclusion probabilities within a source are in proportion to the records' sizes."""
    return mix(_sizes(spark, sf_dir), table(spark, sf_dir, "mix_targets"), "doc_id", weight="tokens")[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_sizes(spark, sf_dir), table(spark, sf_dir, "mix_targets"), "doc_id", weight="tokens")[1]


QUERIES = {"p8_packed": p8_packed, "p8_fill": p8_fill, "p9_mixed": p9_mixed, "p9_shares": p9_shares}
SQL: dict = {}
