"""The registered queries of this subpackage and, where SQL can say it, their SQL."""

from __future__ import annotations

from quillon.llm.alignment import op13_tokenizer_alignment
from quillon.llm.chat import OP4_SQL, op4_chat_format
from quillon.llm.clustering import OP11_SQL, op11_centroid_clustering
from quillon.llm.decontaminate import op7_decontaminate
from quillon.llm.licenses import OP12_SQL, op12_license_scan
from quillon.llm.line_dedup import OP2_SQL, op2_line_dedup, op2_line_dedup_words
from quillon.llm.media import op5_media_columns, page_sequences
from quillon.llm.minhash import op10_minhash_near_dedup
from quillon.llm.mixing import OP8_SQL, op8_mixing
from quillon.llm.sharding import op6_sharding
from quillon.llm.substring_dedup import op1_substring_dedup
from quillon.llm.suffix_dedup import op9_suffix_dedup
from quillon.llm.toxicity import op3_toxicity

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_line_dedup": op2_line_dedup,
    "op2_line_dedup_words": op2_line_dedup_words,
    "op3_toxicity": op3_toxicity,
    "op4_chat_format": op4_chat_format,
    "op5_media_columns": op5_media_columns,
    "page_sequences": page_sequences,
    "op6_sharding": op6_sharding,
    "op7_decontaminate": op7_decontaminate,
    "op8_mixing": op8_mixing,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_license_scan": op12_license_scan,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
}

ORACLE_SQL = {"op2_line_dedup": OP2_SQL, "op4_chat_format": OP4_SQL, "op8_mixing": OP8_SQL, "op11_centroid_clustering": OP11_SQL, "op12_license_scan": OP12_SQL}
