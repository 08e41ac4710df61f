"""The queries of this subpackage by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chunks import op5_content_chunks
from .extraction import op4_block_rules
from .neardup import op6_simhash
from .packing import op3_best_fit_packing
from .quality import op7_random_indexing
from .sentencepieces import op10_sentencepiece
from .sharding import op1_sharding
from .toxicity import op8_gated_windows
from .vectors import OP9_SQL, op2_permutation_index, op9_maxscore


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sharding": op1_sharding,
        "op2_permutation_index": op2_permutation_index,
        "op3_best_fit_packing": op3_best_fit_packing,
        "op4_block_rules": op4_block_rules,
        "op5_content_chunks": op5_content_chunks,
        "op6_simhash": op6_simhash,
        "op7_random_indexing": op7_random_indexing,
        "op8_gated_windows": op8_gated_windows,
        "op9_maxscore": op9_maxscore,
        "op10_sentencepiece": op10_sentencepiece,
    }


def oracle_sql() -> dict[str, str]:
    return {"op9_maxscore": OP9_SQL}
