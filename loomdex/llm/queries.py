"""The registered queries of this subpackage and the SQL that DuckDB checks them with."""

from __future__ import annotations

from .decontaminate import op1_decontaminate
from .exact_dedup import OP7_SQL, op7_exact_dedup
from .fill_middle import OP12_SQL, op12_fill_middle
from .html_text import op9_main_text
from .language_id import op10_language_id
from .licenses import op6_license_scan
from .lm_score import op2_lm_score
from .merkle import OP11_SQL, op11_merkle_manifest
from .minhash_prints import op13_fingerprints
from .mixing import op5_entropy_mix
from .quality import op4_quality
from .sharding import op8_kd_shards
from .simhash import op3_simhash_components

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op9_main_text": op9_main_text,
    "op6_license_scan": op6_license_scan,
    "op2_lm_score": op2_lm_score,
    "op10_language_id": op10_language_id,
    "op4_quality": op4_quality,
    "op3_simhash_components": op3_simhash_components,
    "op5_entropy_mix": op5_entropy_mix,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_kd_shards": op8_kd_shards,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_fill_middle": op12_fill_middle,
    "op13_fingerprints": op13_fingerprints,
}
ORACLES = {"op7_exact_dedup": OP7_SQL, "op11_merkle_manifest": OP11_SQL, "op12_fill_middle": OP12_SQL}
