"""Registered queries of the engine's own operators against their SQL; the sweep over trigram extents is left to the driver's larger run."""

import pytest

from docwarp.plans import catalog

SLOW = {"R7_snippet_chunk", "R10_lexical_chunk", "X7_rrf", "X8_hybrid_depth", "X9_lexical_gate", "X10_gated_rrf", "X11_single_rankings", "X14_field_aware", "X15_components", "X16_folded_containment", "X17_body_boosts", "X18_selective_boosts", "X19_two_lists", "X12_exact_title", "X13_title_trigram"}


@pytest.mark.parametrize("name", sorted(set(catalog.oracle_sql()) - SLOW))
def test_against_sql(name, same):
    same(catalog.queries()[name], catalog.oracle_sql()[name])
