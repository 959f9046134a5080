"""The queries of the operators and of the pipeline, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import ORACLE as DECONTAMINATION_SQL
from .decontaminate import op7_decontamination
from .html_text import op5_html_text
from .language import op3_language
from .merkle import ORACLE as MERKLE_SQL
from .merkle import op12_merkle_manifest
from .mixing import ORACLE as MIXING_SQL
from .mixing import op10_mixing
from .near_dup import ORACLE as NEAR_DUP_SQL
from .near_dup import op2_near_dup
from .neighbours import op4_neighbours
from .packing import op13_packing
from .pii import op9_personal_data
from .prefix_trie import ORACLE as TRIE_SQL
from .prefix_trie import op11_prefix_trie
from .quality import op6_quality
from .sharding import ORACLE as SHARDING_SQL
from .sharding import op1_sharding
from .tokens import op8_token_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_near_dup": op2_near_dup,
    "op3_language": op3_language,
    "op4_neighbours": op4_neighbours,
    "op5_html_text": op5_html_text,
    "op6_quality": op6_quality,
    "op7_decontamination": op7_decontamination,
    "op8_token_files": op8_token_files,
    "op9_personal_data": op9_personal_data,
    "op10_mixing": op10_mixing,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_packing": op13_packing,
}
ORACLES: dict[str, str] = {"op1_sharding": SHARDING_SQL, "op2_near_dup": NEAR_DUP_SQL, "op7_decontamination": DECONTAMINATION_SQL, "op10_mixing": MIXING_SQL, "op11_prefix_trie": TRIE_SQL, "op12_merkle_manifest": MERKLE_SQL}
