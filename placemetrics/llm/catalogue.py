"""Registered queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

from placemetrics.llm import bitmap_manifest, host_reputation, kernel_langid, line_index, lsh_forest, pfair_mixing, quality_gam, rule_ledger, spot_signatures, suffix_dedup, surrogates, swap_packing, weighted_whitening

QUERIES = {
    "op1_quality_gam": quality_gam.op1_quality_gam,
    "op2_spot_signatures": spot_signatures.op2_spot_signatures,
    "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
    "op4_lsh_forest": lsh_forest.op4_lsh_forest,
    "op5_swap_packing": swap_packing.op5_swap_packing,
    "op6_line_index": line_index.op6_line_index,
    "op7_kernel_langid": kernel_langid.op7_kernel_langid,
    "op8_pfair_mixing": pfair_mixing.op8_pfair_mixing,
    "op9_surrogates": surrogates.op9_surrogates,
    "op10_rule_ledger": rule_ledger.op10_rule_ledger,
    "rule_ablations": rule_ledger.rule_ablations,
    "op11_bitmap_manifest": bitmap_manifest.op11_bitmap_manifest,
    "op12_host_reputation": host_reputation.op12_host_reputation,
    "op13_weighted_whitening": weighted_whitening.op13_weighted_whitening,
}

SQL = {
    "op6_line_index": line_index.OP6_SQL,
    "op10_rule_ledger": rule_ledger.OP10_SQL,
    "rule_ablations": rule_ledger.ABLATIONS_SQL,
    "op11_bitmap_manifest": bitmap_manifest.OP11_SQL,
    "op12_host_reputation": host_reputation.OP12_SQL,
}
