"""Running totals of a stream: a hook that adds up what each version was told to hold.

    totals = Totals()
    start(legs, store, checkpoint, rules, ttl_s, clock, hook=totals)
    print(totals.text())

What is told was counted while the version was written; nothing is read again. A version that
is told twice counts once.
"""

from __future__ import annotations

from collections import Counter

from tallyloom import schema as S
from tallyloom.operators.views import RESIDUAL_BOUNDS
from tallyloom.streaming.stream import CATEGORIES, EVENTS, TIERS, TRIGGERS, Told

RULES = (S.T1_EXACT, S.T2_REF, S.T2_AMOUNT_DATE, S.T2_LATE, S.T3_SUBSET)


class Totals:
    detailed = True

    def __init__(self) -> None:
        self.version = -1
        self.counts: dict[str, Counter[str]] = {}

    def __call__(self, version: int, told: Told) -> None:
        if version <= self.version:
            return
        self.version = version
        for table, counts in told.items():
            self.counts.setdefault(table, Counter()).update(counts)

    def get(self, table: str, name: str) -> int:
        return self.counts.get(table, Counter())[name]

    def histogram(self, tier: int) -> dict[str, int]:
        """Matches of a tier with an absolute residual up to each bound, and all of them."""
        return {str(b): self.get("matches", f"T{tier}<={b}") for b in RESIDUAL_BOUNDS} | {"+Inf": self.get("matches", f"T{tier}")}

    def text(self) -> str:
        """The totals in the text format that metric collectors read."""
        out = ["# TYPE tally_events_total counter"]
        out += [f'tally_events_total{{type="{t}"}} {self.get("events", t)}' for t in EVENTS]
        out.append("# TYPE tally_matches_total counter")
        out += [f'tally_matches_total{{rule="{r}"}} {self.get("matches", r)}' for r in RULES]
        out.append("# TYPE tally_breaks_opened_total counter")
        out += [f'tally_breaks_opened_total{{category="{c}",trigger="{t}"}} {self.get("breaks", f"{c}/{t}")}' for c in CATEGORIES for t in TRIGGERS]
        out.append("# TYPE tally_match_residual_minor histogram")
        for t in TIERS:
            out += [f'tally_match_residual_minor_bucket{{tier="T{t}",le="{b}"}} {n}' for b, n in self.histogram(t).items()]
            out.append(f'tally_match_residual_minor_sum{{tier="T{t}"}} {self.get("matches", f"T{t} sum")}')
            out.append(f'tally_match_residual_minor_count{{tier="T{t}"}} {self.get("matches", f"T{t}")}')
        return "\n".join(out) + "\n"
