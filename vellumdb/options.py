"""Options with defaults and bounds."""

from __future__ import annotations

from dataclasses import dataclass, fields

from .errors import ValidationError


def _check(options: object, bounds: dict[str, tuple[float, float]]) -> None:
    bad = []
    for name, (low, high) in bounds.items():
        v = getattr(options, name)
        if type(v) not in (int, float) or not low <= v <= high:
            bad.append(f"{name} must be between {low} and {high}, not {v!r}")
    for f in fields(options):
        if f.type == "bool" and type(getattr(options, f.name)) is not bool:
            bad.append(f"{f.name} must be true or false")
    if bad:
        raise ValidationError("; ".join(bad[:3]))


@dataclass(frozen=True)
class DatabaseOptions:
    create_if_missing: bool = False
    mem_segment_max_documents: int = 1000
    durability: str = "strict"
    posting_cache: bool = True
    posting_cache_max_entries: int = 128
    automatic_compaction: bool = False
    max_level_zero_segments: int = 4
    max_input_segments: int = 4
    stale_ratio_threshold: float = 0.3
    check_interval_ms: int = 5000
    max_input_bytes: int = 268_435_456

    def __post_init__(self) -> None:
        _check(self, {"mem_segment_max_documents": (1, 2**53), "posting_cache_max_entries": (0, 2**53), "max_level_zero_segments": (2, 64), "max_input_segments": (2, 32), "stale_ratio_threshold": (1e-9, 1), "check_interval_ms": (10, 86_400_000), "max_input_bytes": (1024, 17_179_869_184)})
        if self.durability not in ("strict", "relaxed"):
            raise ValidationError("durability must be strict or relaxed")


@dataclass(frozen=True)
class EngineOptions:
    mutable_segment_max_documents: int = 100_000
    bloom_false_positive_rate: float = 0.01
    bloom_expected_entries: int = 10_000

    def __post_init__(self) -> None:
        _check(self, {"mutable_segment_max_documents": (1, 2**53), "bloom_false_positive_rate": (1e-9, 1 - 1e-9), "bloom_expected_entries": (1, 2**53)})
