"""The tunables of a stitching run."""

from __future__ import annotations

from dataclasses import dataclass, fields

OVERFLOW_POLICIES = ("preserve_extra", "warn_drop", "fail", "merge_tail")


@dataclass(frozen=True)
class StitchConfig:
    max_page_gap: int = 1
    require_same_width: bool = False
    max_width_difference: int = 4
    width_overflow_policy: str = "preserve_extra"
    headerless_width_tolerance: int = 2
    header_sim_strict: float = 0.6
    header_sim_loose: float = 0.3
    row_sim_threshold: float = 0.3
    use_layout_hint: bool = True
    bottom_band_min: float = 0.60
    top_band_max: float = 0.40
    max_orphan_rows: int = 2
    max_data_orphan_rows: int = 5
    spillover_require_content_check: bool = False
    block_on_intervening_content: bool = True
    stitch_separator: str = "\n"

    def problems(self) -> list[str]:
        """Everything that is wrong, not only the first."""
        out = []
        if not 1 <= self.max_page_gap <= 10:
            out.append(f"max_page_gap must lie in 1..10, is {self.max_page_gap}")
        for name in ("max_width_difference", "max_orphan_rows", "max_data_orphan_rows"):
            if getattr(self, name) < 0:
                out.append(f"{name} must not be negative, is {getattr(self, name)}")
        for name in ("header_sim_strict", "header_sim_loose", "row_sim_threshold", "bottom_band_min", "top_band_max"):
            if not 0.0 <= getattr(self, name) <= 1.0:
                out.append(f"{name} must lie in 0..1, is {getattr(self, name)}")
        return out + self.policy_problems()

    def policy_problems(self) -> list[str]:
        if self.width_overflow_policy in OVERFLOW_POLICIES:
            return []
        return [f"width_overflow_policy must be one of {sorted(OVERFLOW_POLICIES)}, is {self.width_overflow_policy!r}"]

    def validate(self) -> StitchConfig:
        if found := self.problems():
            raise ValueError("; ".join(found))
        return self

    @classmethod
    def of(cls, values: dict | None) -> StitchConfig:
        known = {f.name for f in fields(cls)}
        if unknown := sorted(set(values or {}) - known):
            raise ValueError(f"unknown settings: {unknown}")
        return cls(**(values or {}))
