"""The queries of this subpackage, by name, and DuckDB SQL for those that SQL can express."""

from captionlake.llm.bpe import op6_bpe
from captionlake.llm.classifier import op7_quality_classifier
from captionlake.llm.fingerprints import op3_document_fingerprints
from captionlake.llm.infilling import op12_fill_in_middle
from captionlake.llm.jaccard import op10_jaccard_join
from captionlake.llm.lines import op4_line_dedup
from captionlake.llm.minhash import op11_minhash_dedup
from captionlake.llm.packing import op2_packing
from captionlake.llm.quality_rules import op8_quality_rules
from captionlake.llm.secrets import op9_secret_scans
from captionlake.llm.sharding import op5_sharding
from captionlake.llm.sql import ORACLES as ORACLES
from captionlake.llm.substrings import op1_substring_dedup
from captionlake.llm.vector_codes import op13_vector_codes

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_packing": op2_packing,
    "op3_document_fingerprints": op3_document_fingerprints,
    "op4_line_dedup": op4_line_dedup,
    "op5_sharding": op5_sharding,
    "op6_bpe": op6_bpe,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_quality_rules": op8_quality_rules,
    "op9_secret_scans": op9_secret_scans,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_minhash_dedup": op11_minhash_dedup,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_vector_codes": op13_vector_codes,
}

