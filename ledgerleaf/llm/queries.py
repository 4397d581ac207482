"""The registered queries of this subpackage and their SQL statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerleaf.llm import line_crf, log_bilinear, lsh_forest, merkle, mixing, packing, periodic_runs, phrase_automata, prefix_doubling, prefix_forest, quality_rules, sharding, warc
from ledgerleaf.llm.common import documents


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": lambda s, d: quality_rules.digest(documents(s, d), _labels(s, d)),
        "op2_log_bilinear": lambda s, d: log_bilinear.score(documents(s, d)),
        "op3_mixing": lambda s, d: mixing.digest(documents(s, d)),
        "op4_phrase_automata": lambda s, d: phrase_automata.digest(documents(s, d)),
        "op5_prefix_doubling": lambda s, d: prefix_doubling.digest(documents(s, d)),
        "op6_lsh_forest": lambda s, d: lsh_forest.near_duplicates(documents(s, d)),
        "op7_packing": lambda s, d: packing.pack(documents(s, d)),
        "op8_line_crf": lambda s, d: line_crf.digest(documents(s, d), _labels(s, d)),
        "op9_prefix_forest": lambda s, d: prefix_forest.search(s.read.parquet(f"{d}/embeddings.parquet")),
        "op10_sharding": lambda s, d: sharding.digest(documents(s, d)),
        "op11_merkle": lambda s, d: merkle.digest(documents(s, d)),
        "op12_periodic_runs": lambda s, d: periodic_runs.digest(documents(s, d)),
        "op13_warc": lambda s, d: warc.digest(s.read.parquet(f"{d}/pages.parquet")),
    }


def llm_statements() -> dict[str, str]:
    return {"op1_quality_rules": quality_rules.SQL, "op3_mixing": mixing.SQL, "op10_sharding": sharding.SQL, "op11_merkle": merkle.SQL, "op12_periodic_runs": periodic_runs.SQL, "op13_warc": warc.SQL}
