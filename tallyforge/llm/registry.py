"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import jaccard, linededup, media, mixing, packing, quality, reputation, secrets, sharding, toxicity

QUERIES = {
    "op1_tokeniser_fertility": quality.op1_tokeniser_fertility,
    "op2_bound_certified_packing": packing.op2_bound_certified_packing,
    "op3_ftrl_toxicity": toxicity.op3_ftrl_toxicity,
    "op4_progressive_jpeg": media.op4_progressive_jpeg,
    "op5_prefix_tree_join": jaccard.op5_prefix_tree_join,
    "op6_host_reputation": reputation.op6_host_reputation,
    "op7_extendible_sharding": sharding.op7_extendible_sharding,
    "op8_mix_sources": mixing.op8_mix_sources,
    "op9_line_runs": linededup.op9_line_runs,
    "op10_trigram_secrets": secrets.op10_trigram_secrets,
}
SQL = {
    "op6_host_reputation": reputation.OP6_SQL,
    "op7_extendible_sharding": sharding.OP7_SQL,
    "op8_mix_sources": mixing.OP8_SQL,
    "op9_line_runs": linededup.OP9_SQL,
    "op10_trigram_secrets": secrets.OP10_SQL,
}
