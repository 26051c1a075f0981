"""Queries of this subpackage and their SQL, for the registry of the library."""

from __future__ import annotations

from islets.llm import best_positions, dart_minhash, exact_dedup, line_edit_join, mixing, packing, page_differencing, quadratic_discriminant, quality_rules, reduced_alphabet, substring_dedup, token_groups, toxic_neighbours


def queries():
    return {
        "op1_substring_dedup": substring_dedup.query,
        "op2_exact_dedup": exact_dedup.query,
        "op3_mixing": mixing.query,
        "op7_dart_minhash": dart_minhash.query,
        "op4_packing": packing.query,
        "op5_page_differencing": page_differencing.query,
        "op8_quadratic_discriminant": quadratic_discriminant.query,
        "op10_toxic_neighbours": toxic_neighbours.query,
        "op9_line_edit_join": line_edit_join.query,
        "op9_near_line_edit_join": line_edit_join.near_query,
        "op6_quality_rules": quality_rules.query,
        "op11_best_positions": best_positions.query,
        "op12_reduced_alphabet": reduced_alphabet.query,
        "op13_token_groups": token_groups.query,
    }


def oracle_sql():
    return {
        "op1_substring_dedup": substring_dedup.SQL,
        "op2_exact_dedup": exact_dedup.SQL,
        "op6_quality_rules": quality_rules.SQL,
        "op9_line_edit_join": line_edit_join.SQL,
        "op9_near_line_edit_join": line_edit_join.NEAR_SQL,
        "op11_best_positions": best_positions.SQL,
        "op12_reduced_alphabet": reduced_alphabet.SQL,
        "op13_token_groups": token_groups.SQL,
    }
