"""Matching parameters."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Rules:
    tolerance_bps: int = 10
    tolerance_abs_minor: int = 2
    value_date_window_days: int = 2
    t3_max_candidates: int = 24
    t3_max_subset: int = 6
    t3_require_batch_hint: bool = True

    def __post_init__(self) -> None:
        limits = {
            "tolerance_bps": (0, 10_000), "tolerance_abs_minor": (0, 2**62), "value_date_window_days": (0, 365),
            "t3_max_candidates": (2, 64), "t3_max_subset": (2, 12),
        }
        wrong = [f"{k}={getattr(self, k)} lies outside of {a}..{b}" for k, (a, b) in limits.items() if not a <= getattr(self, k) <= b]
        if wrong:
            raise ValueError("; ".join(wrong))

    def tolerance(self, amount: int) -> int:
        """Allowed deviation from a reference amount, halves rounded up."""
        return max((abs(amount) * self.tolerance_bps + 5_000) // 10_000, self.tolerance_abs_minor)

    def confidence(self, residual: int, tolerance: int) -> float:
        if tolerance <= 0:
            return 0.95
        share = min(1.0, abs(residual) / tolerance)
        return int((0.95 - 0.15 * share) * 1000 + 0.5) / 1000

    @staticmethod
    def from_env(env: dict[str, str] | None = None) -> Rules:
        """Rules from TALLYLOOM_* variables; all wrong ones are reported together."""
        env = dict(os.environ) if env is None else env
        found, wrong = {}, []
        for name, kind in Rules.__annotations__.items():
            raw = env.get(f"TALLYLOOM_{name.upper()}")
            if raw is None:
                continue
            if kind == "bool" and raw.lower() in ("true", "false", "1", "0"):
                found[name] = raw.lower() in ("true", "1")
            elif kind == "int" and re.fullmatch(r"-?\d+", raw):
                found[name] = int(raw)
            else:
                wrong.append(f"{name}: {raw!r}")
        if wrong:
            raise ValueError("not valid: " + "; ".join(wrong))
        return Rules(**found)


_UNITS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}


def duration_seconds(text: str) -> float:
    """Seconds of a duration such as 1h30m or 250ms."""
    body = text.strip().lstrip("+-")
    if body == "0":
        return 0.0
    parts = re.findall(r"(\d+\.?\d*|\.\d+)(ns|us|µs|ms|s|m|h)", body)
    if not parts or "".join(a + b for a, b in parts) != body:
        raise ValueError(f"not a duration: {text!r}")
    total = sum(float(a) * _UNITS[b] for a, b in parts)
    return -total if text.strip().startswith("-") else total
