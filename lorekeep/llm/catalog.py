"""Queries of the training-data operators and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from . import history, leaks, lookalike, mixing, near, oracles, pieces, private, vectors


def queries():
    return {
        "p6_found": leaks.p6_found,
        "p6_leaked_items": leaks.p6_leaked_items,
        "p8_found": lookalike.p8_found,
        "p8_classes": lookalike.p8_classes,
        "p8_texts": lookalike.p8_texts,
        "p1_found": pieces.p1_found,
        "p1_pieces": pieces.p1_pieces,
        "p1_sizes": pieces.p1_sizes,
        "p2_found": private.p2_found,
        "p2_texts": private.p2_texts,
        "p2_surrogates": private.p2_surrogates,
        "p3_found": history.p3_found,
        "p3_decisions": history.p3_decisions,
        "p3_batches": history.p3_batches,
        "p4_found": vectors.p4_found,
        "p4_neighbours": vectors.p4_neighbours,
        "p7_mix": mixing.p7_mix,
        "p7_shares": mixing.p7_shares,
        "p5_found": near.p5_found,
        "p5_groups": near.p5_groups,
    }


def oracle_sql():
    return dict(oracles.SQL)
