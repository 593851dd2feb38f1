"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import oracles
from .binary import op11_power_of_two
from .exponion import op12_exponion_codes
from .forest import op9_lsh_forest
from .importance import op8_importance_resampling
from .langid import op5_string_kernel
from .merkle import op13_merkle_manifest
from .packing import op10_best_fit_packing
from .pieces import op2_merge_dropout
from .pii import op3_feistel_pseudonyms
from .quality import op4_line_frequency
from .secrets import op6_secret_ledger
from .shards import op7_rendezvous_shards
from .vectors import op1_rotated_codes

QUERIES = {
    f.__name__: f
    for f in (
        op1_rotated_codes,
        op2_merge_dropout,
        op3_feistel_pseudonyms,
        op4_line_frequency,
        op5_string_kernel,
        op6_secret_ledger,
        op7_rendezvous_shards,
        op8_importance_resampling,
        op9_lsh_forest,
        op10_best_fit_packing,
        op11_power_of_two,
        op12_exponion_codes,
        op13_merkle_manifest,
    )
}
ORACLES: dict[str, str] = {
    "op4_line_frequency": oracles.quality(),
    "op6_secret_ledger": oracles.secrets(),
    "op7_rendezvous_shards": oracles.shards(),
    "op9_lsh_forest": oracles.near_duplicates(),
    "op12_exponion_codes": oracles.vector_codes(),
    "op13_merkle_manifest": oracles.merkle(),
}
