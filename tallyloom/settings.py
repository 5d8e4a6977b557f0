"""Settings of a reconciliation stream, from the environment."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from tallyloom.operators.classify import FeeBand
from tallyloom.rules import Rules, duration_seconds

PREFIX = "TALLYLOOM_"


def _names(text: str) -> tuple[str, ...]:
    return tuple(n for n in (part.strip() for part in text.split(",")) if n)


@dataclass(frozen=True)
class Settings:
    """ttl_s: how long a leg may stay open; sweep_s: time between two micro-batches; servers
    and topics: of the record source; path: of the state; sink_url: database that follows the
    state, none if empty."""

    rules: Rules = field(default_factory=Rules)
    band: FeeBand = field(default_factory=FeeBand)
    ttl_s: float = 48 * 3600.0
    sweep_s: float = 30.0
    servers: tuple[str, ...] = ("localhost:9092",)
    topics: tuple[str, ...] = ("ledger.legs", "rail.legs")
    path: str = ""
    sink_url: str = ""

    @staticmethod
    def from_env(env: dict[str, str] | None = None) -> Settings:
        """From TALLYLOOM_* variables (TTL, SWEEP, SERVERS, TOPICS, PATH, SINK_URL, FEE_MIN_BPS,
        FEE_MAX_BPS and those of Rules); an empty or missing one leaves the default. All
        that is wrong is reported together."""
        env = dict(os.environ) if env is None else env
        wrong: list[str] = []

        def read(name: str, default: Any, parse: Callable[[str], Any], fits: Callable[[Any], bool], need: str) -> Any:
            raw = env.get(PREFIX + name, "")
            if not raw:
                return default
            try:
                value = parse(raw)
            except ValueError:
                wrong.append(f"{name}: {raw!r}")
                return default
            if not fits(value):
                wrong.append(f"{name} must be {need}")
                return default
            return value

        base = Settings()
        above, some, text = (lambda v: v > 0), bool, (lambda v: True)
        band = FeeBand(
            read("FEE_MIN_BPS", base.band.min_bps, float, lambda v: v >= 0, "0 or more"), read("FEE_MAX_BPS", base.band.max_bps, float, lambda v: v >= 0, "0 or more")
        )
        if band.min_bps > band.max_bps:
            wrong.append("FEE_MIN_BPS must not exceed FEE_MAX_BPS")
        made = {
            "ttl_s": read("TTL", base.ttl_s, duration_seconds, above, "above 0"), "sweep_s": read("SWEEP", base.sweep_s, duration_seconds, above, "above 0"),
            "servers": read("SERVERS", base.servers, _names, some, "a list of names"), "topics": read("TOPICS", base.topics, _names, some, "a list of names"),
            "path": read("PATH", base.path, str, text, ""), "sink_url": read("SINK_URL", base.sink_url, str, lambda v: v.startswith("jdbc:"), "a JDBC address"),
        }
        rules = base.rules
        try:
            rules = Rules.from_env({k: v for k, v in env.items() if v != ""})
        except ValueError as e:
            wrong.append(str(e))
        if wrong:
            raise ValueError("settings: " + "; ".join(wrong))
        return Settings(rules, band, **made)
