"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from .chat import OP6_SQL, op6_chat_formatting
from .clusters import OP12_SQL, op12_centroid_clustering
from .decontam import op1_decontamination
from .embed import OP2_SQL, op2_embedding_near_dedup
from .langid import op4_language_id
from .minhash import OP7_SQL, op7_minhash_near_dedup
from .lexicon import op13_bpe
from .mixing import OP8_SQL, op8_mix_sources
from .phrases import OP11_SQL, op11_collocations
from .quality import op9_quality_classifier
from .substring import OP10_SQL, op10_substring_dedup
from .tokens import op3_token_counts, op5_token_files

QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_embedding_near_dedup": op2_embedding_near_dedup,
    "op3_token_counts": op3_token_counts,
    "op4_language_id": op4_language_id,
    "op5_token_files": op5_token_files,
    "op6_chat_formatting": op6_chat_formatting,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_mix_sources": op8_mix_sources,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_collocations": op11_collocations,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_bpe": op13_bpe,
}

ORACLE_SQL = {
    "op2_embedding_near_dedup": OP2_SQL,
    "op6_chat_formatting": OP6_SQL,
    "op7_minhash_near_dedup": OP7_SQL,
    "op8_mix_sources": OP8_SQL,
    "op10_substring_dedup": OP10_SQL,
    "op11_collocations": OP11_SQL,
    "op12_centroid_clustering": OP12_SQL,
}
