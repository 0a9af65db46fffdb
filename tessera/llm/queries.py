"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from tessera.llm.decontam import op2_decontamination
from tessera.llm.langid import op9_language_id
from tessera.llm.media import op8_media_columns
from tessera.llm.mixing import op4_mixing, op4_sql
from tessera.llm.quality import op3_quality
from tessera.llm.sharding import op7_sharding, op7_sql
from tessera.llm.simhash import op1_simhash_dedup
from tessera.llm.suffix import op5_sql, op5_suffix_dedup
from tessera.llm.tokens import op10_token_output
from tessera.llm.urls import op6_sql, op6_url_filters

QUERIES = {
    "op1_simhash_dedup": op1_simhash_dedup,
    "op2_decontamination": op2_decontamination,
    "op3_quality": op3_quality,
    "op4_mixing": op4_mixing,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_url_filters": op6_url_filters,
    "op7_sharding": op7_sharding,
    "op8_media_columns": op8_media_columns,
    "op9_language_id": op9_language_id,
    "op10_token_output": op10_token_output,
}
ORACLES: dict[str, str] = {
    "op4_mixing": op4_sql(),
    "op5_suffix_dedup": op5_sql(),
    "op6_url_filters": op6_sql(),
    "op7_sharding": op7_sql(),
}
