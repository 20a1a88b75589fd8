"""The corpus operators' queries and their SQL."""

from __future__ import annotations

from importlib import import_module

#: (module, query function) in the order of the operators.
_QUERIES = (
    ("line_dedup", "op1_line_chunks"),
    ("language_id", "op2_nearest_centroid"),
    ("substring_dedup", "op3_difference_cover"),
    ("suffix_dedup", "op4_prefix_free_parsing"),
    ("mixing", "op5_low_discrepancy_mix"),
    ("fingerprint", "op6_scaled_sketch"),
    ("token_counts", "op7_finite_state_counts"),
    ("decontaminate", "op8_prefix_filtered_join"),
    ("sharding", "op9_virtual_slots"),
    ("jaccard_join", "op10_chosen_path"),
    ("fill_in_middle", "op11_skip_list"),
    ("periodic_runs", "op12_harmonic_grid"),
    ("minhash_dedup", "op13_hamming_join"),
)


def queries() -> dict:
    return {name: getattr(import_module(f"tidepanel.llm.{module}"), name) for module, name in _QUERIES}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"tidepanel.llm.{module}"), "ORACLE_SQL", None) for module, name in _QUERIES}
    return {name: sql for name, sql in found.items() if sql}
