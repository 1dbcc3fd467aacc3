"""Which segments to merge next; pure decisions over their metadata."""

from __future__ import annotations

from dataclasses import dataclass

from ..sources.files import SegmentInfo

TOP_LEVEL = 8


@dataclass(frozen=True)
class CompactionPlan:
    inputs: tuple[int, ...]
    output_level: int
    reason: str


def choose(segments: list[SegmentInfo], max_level_zero: int, max_inputs: int, stale_ratio: float, max_bytes: int) -> CompactionPlan | None:
    """A full level first, from the lowest: its oldest segments, as many as the bounds
    allow, move one level up.  Else the first segment with too many deleted documents is
    rewritten, from level 0 to 1 and otherwise in its level."""
    for level in range(TOP_LEVEL + 1):
        own = sorted((s for s in segments if s.level == level), key=lambda s: (s.created, s.segment_id))
        if len(own) < max_level_zero:
            continue
        group, size = [], 0
        for s in own[:max_inputs]:
            if size + s.bytes > max_bytes:
                break
            group.append(s.segment_id)
            size += s.bytes
        if len(group) >= 2:
            return CompactionPlan(tuple(group), min(level + 1, TOP_LEVEL), "level is full")
    for s in sorted(segments, key=lambda s: (s.level, s.created, s.segment_id)):
        if s.documents and len(s.deleted) / s.documents >= stale_ratio and s.bytes <= max_bytes:
            return CompactionPlan((s.segment_id,), max(1, s.level), "many deleted documents")
    return None
