"""Every query of the engine by name, with the SQL that states the same result."""

from __future__ import annotations

from ostinato.plans import (
    beats,
    catalog,
    evaluation,
    fold_queries,
    hand_queries,
    harmony,
    layout_queries,
    notation_queries,
    projections,
    score_queries,
    segment_queries,
    stream_queries,
    track_queries,
    vision_queries,
    written_queries,
)


def queries() -> dict:
    return dict(catalog.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(catalog.ORACLE)


MODULES = (
    beats, evaluation, fold_queries, hand_queries, harmony, layout_queries, notation_queries, projections, score_queries, segment_queries, stream_queries, track_queries, vision_queries, written_queries,
)
