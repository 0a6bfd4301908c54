"""Queries of the corpus operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from asmlens.llm import licenses, ranked, sharding, trie
from asmlens.llm._spark import swept
from asmlens.llm.bpe import op13_bpe_merge_queue
from asmlens.llm.chat import op8_chat_formatting
from asmlens.llm.licenses import op9_license_digests
from asmlens.llm.mixing import op7_mixing_tree
from asmlens.llm.pieces import op5_sentencepiece_offsets
from asmlens.llm.quality import op1_quality_rules
from asmlens.llm.ranked import op12_length_strata
from asmlens.llm.sharding import op10_extendible_sharding
from asmlens.llm.simhash import op2_simhash_pivots
from asmlens.llm.suffix import op4_suffix_lpf
from asmlens.llm.toxicity import op3_toxicity_ordinal
from asmlens.llm.trie import op11_prefix_trie
from asmlens.llm.vectors import op6_subspace_pigeonhole


def _tidied(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A query that first deletes what earlier ones left and nothing reads."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        swept(spark)
        return query(spark, sf_dir)

    return run


_ALL = {
    "op1_quality_rules": op1_quality_rules,
    "op2_simhash_pivots": op2_simhash_pivots,
    "op3_toxicity_ordinal": op3_toxicity_ordinal,
    "op4_suffix_lpf": op4_suffix_lpf,
    "op5_sentencepiece_offsets": op5_sentencepiece_offsets,
    "op6_subspace_pigeonhole": op6_subspace_pigeonhole,
    "op7_mixing_tree": op7_mixing_tree,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_license_digests": op9_license_digests,
    "op10_extendible_sharding": op10_extendible_sharding,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_length_strata": op12_length_strata,
    "op13_bpe_merge_queue": op13_bpe_merge_queue,
}
QUERIES = {name: _tidied(query) for name, query in _ALL.items()}

ORACLE_SQL: dict[str, str] = {
    "op9_license_digests": licenses.ORACLE,
    "op10_extendible_sharding": sharding.ORACLE,
    "op11_prefix_trie": trie.ORACLE,
    "op12_length_strata": ranked.ORACLE,
}
