"""The order-dependent remainder: legs whose outcome depends on what came before them.

One call handles some connected components of legs (they share a reference, a disputed
amount in a window, or a batch), in order of arrival. It settles who goes with whom and
leaves everything else, such as classifying and events, to Spark. Open legs are indexed by
amount, batch and reference, so a step looks only at legs that it may pair.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd

from tallyloom import schema as S
from tallyloom.rules import Rules

NODES = 200_000
RESULT = "kind string, ingest_seq bigint, payload string"


def bounded_subset(amounts: list[int], target: int, tol: int, least: int, most: int) -> list[int] | None:
    """Positions of the first subset of least..most amounts that sums to target within tol,
    searching larger amounts first and including before skipping; None if there is none or
    NODES partial sums didn't reach one."""
    order = sorted(range(len(amounts)), key=lambda i: -amounts[i])
    if most <= 0 or not order:
        return None
    if sum(amounts[i] for i in order[:most]) < target - tol:
        return None  # not even the largest reach it
    chosen: list[int] = []
    resume = [0]
    left, visited, fresh = target, 0, True
    while resume:
        if fresh:
            visited += 1
            if visited > NODES:
                return None
            if len(chosen) >= least and abs(left) <= tol:
                return [order[k] for k in chosen]
        fresh = False
        k = resume[-1] if len(chosen) < most else len(order)
        while k < len(order) and amounts[order[k]] > left + tol:
            k += 1
        if k == len(order):
            resume.pop()
            if chosen:
                left += amounts[order[chosen.pop()]]
            continue
        resume[-1] = k + 1
        chosen.append(k)
        left -= amounts[order[k]]
        resume.append(k + 1)
        fresh = True
    return None


def _id(prefix: str, ids: list[str]) -> str:
    return f"{prefix}_{hashlib.sha256(chr(0).join(sorted(ids)).encode()).hexdigest()[:20]}"


def _canonical(legs) -> list[dict]:
    return sorted(legs, key=lambda x: (x["value_date"], x["txn_ref"], x["id"]))


class Component:
    def __init__(self, rules: Rules) -> None:
        self.rules = rules
        self.known: list[dict] = []  # in order of arrival
        self.breaks: dict[str, dict] = {}  # id -> {"open": bool, "n": legs}
        self.by_ref: dict[str, list[dict]] = defaultdict(list)
        self.refs: set[tuple[str, str]] = set()
        # Open legs only: by amount, source and date; by batch; by reference; by window.
        self.by_amount: dict[tuple, dict[str, dict]] = defaultdict(lambda: defaultdict(lambda: defaultdict(dict)))
        self.by_batch: dict[tuple, dict[str, dict]] = defaultdict(dict)
        self.by_key: dict[tuple, dict[str, dict]] = defaultdict(dict)

    def learn(self, l: dict) -> None:
        self.known.append(l)
        self.by_ref[l["txn_ref"]].append(l)
        self.refs.add((l["txn_ref"], l["source"]))

    def _places(self, l: dict) -> Iterator[dict]:
        window = (l["currency"], l["counterparty"])
        yield self.by_amount[(*window, l["amount_minor"])][l["source"]][l["value_date"]]
        if not self.rules.t3_require_batch_hint:
            yield self.by_key[window]
            return
        yield self.by_key[(*window, l["txn_ref"])]
        if batch := l["attrs"].get("batch_ref"):
            yield self.by_batch[(*window, batch)]

    def opened(self, l: dict) -> None:
        for place in self._places(l):
            place[l["id"]] = l

    def closed(self, l: dict) -> None:
        for place in self._places(l):
            place.pop(l["id"], None)

    def near(self, a: dict, b: dict) -> bool:
        return abs((a["value_date"] - b["value_date"]).days) <= self.rules.value_date_window_days

    def has(self, ref: str, source: str) -> bool:
        return (ref, source) in self.refs

    def equals(self, l: dict, own: bool) -> Iterator[dict[str, dict]]:
        """Open legs of l's window and amount near its date, of its own or of other sources."""
        span = self.rules.value_date_window_days
        for source, days in self.by_amount[(l["currency"], l["counterparty"], l["amount_minor"])].items():
            if (source == l["source"]) == own:
                for k in range(-span, span + 1):
                    if found := days.get(l["value_date"] + dt.timedelta(days=k)):
                        yield found

    def candidates(self, l: dict) -> Iterator[tuple[str, int, dict, list[dict], float]]:
        """(rule, tier, anchor, the legs joined to it, confidence), best rule first. l itself
        isn't among the open legs yet."""
        r = self.rules
        tol = r.tolerance(l["amount_minor"])
        window = (l["currency"], l["counterparty"])
        same_ref = _canonical(
            c for c in self.by_ref[l["txn_ref"]]
            if c["status"] == "open" and c is not l and c["source"] != l["source"] and (c["currency"], c["counterparty"]) == window and self.near(c, l)
        )
        gap = lambda c: abs(c["amount_minor"] - l["amount_minor"])
        for c in same_ref:
            if gap(c) == 0:
                yield S.T1_EXACT, 1, l, [c], 1.0
        if close := [c for c in same_ref if gap(c) <= tol]:
            c = min(close, key=gap)
            yield S.T2_REF, 2, l, [c], r.confidence(gap(c), tol)
        equal = list(self.equals(l, own=False))
        if sum(map(len, equal)) == 1:
            c = next(iter(equal[0].values()))
            # Rivals are legs of l's source that are near c.
            rival = any(self.equals(c | {"source": l["source"]}, own=True))
            if not rival and not self.has(c["txn_ref"], l["source"]) and not self.has(l["txn_ref"], c["source"]):
                yield S.T2_AMOUNT_DATE, 2, l, [c], 0.75
        yield from self.batches(l, window)

    def batches(self, l: dict, window: tuple[str, str]) -> Iterator[tuple[str, int, dict, list[dict], float]]:
        r, hint, own = self.rules, self.rules.t3_require_batch_hint, l["attrs"].get("batch_ref") or ""

        def many(anchor: dict, legs: list[dict]) -> tuple[str, int, dict, list[dict], float]:
            residual = sum(x["amount_minor"] for x in legs) - anchor["amount_minor"]
            return S.T3_SUBSET, 3, anchor, legs, r.confidence(residual, r.tolerance(anchor["amount_minor"])) - 0.10

        # l settles legs of another source
        held = self.by_batch.get((*window, own or l["txn_ref"]), {}) if hint else self.by_key.get(window, {})
        pool = _canonical(c for c in held.values() if c["source"] != l["source"] and self.near(c, l))
        for source in sorted({c["source"] for c in pool}):
            part = [c for c in pool if c["source"] == source][: r.t3_max_candidates]
            found = bounded_subset([c["amount_minor"] for c in part], l["amount_minor"], r.tolerance(l["amount_minor"]), 2, r.t3_max_subset)
            if found:
                yield many(l, [part[i] for i in found])
        # l is one of those that a leg of another source settles
        if hint and not own:
            return
        joined = self.by_batch.get((*window, own), {}) | {i: x for i, x in self.by_key.get((*window, own), {}).items() if x["source"] != l["source"]} if hint else held
        joined = _canonical(joined.values())
        for s in joined:
            if s["source"] == l["source"] or s["amount_minor"] <= l["amount_minor"] or not self.near(s, l):
                continue
            part = [x for x in joined if x["source"] == l["source"] and self.near(x, s) and x["amount_minor"] < s["amount_minor"]][: r.t3_max_candidates]
            rest = s["amount_minor"] - l["amount_minor"]
            found = bounded_subset([x["amount_minor"] for x in part], rest, r.tolerance(s["amount_minor"]), 1, r.t3_max_subset - 1)
            if found:
                yield many(s, [l, *(part[i] for i in found)])

    def step(self, l: dict) -> Iterator[tuple[str, dict]]:
        """Settle one incoming leg: (kind, fields) of what comes of it."""
        related = list(self.by_ref[l["txn_ref"]])
        outcome = {"leg_id": l["id"], "outcome": "open", "rule_id": None, "match_id": None, "break_id": None}
        self.learn(l)
        l.update(status="open", match_id=None, break_id=None)
        across = [x for x in related if x["source"] != l["source"]]
        # The classifier asks for the first leg of the source and of another one.
        firsts = [next((x for x in related if (x["source"] == l["source"]) == own), None) for own in (True, False)]
        before = sorted((dict(x) for x in firsts if x is not None), key=lambda x: x["ingest_seq"])

        def matched(rule: str, tier: int, anchor: dict, legs: list[dict], confidence: float) -> dict:
            ids = sorted(x["id"] for x in [anchor, *legs])
            m = {"id": _id("m", ids), "leg_ids": ids, "tier": tier, "rule_id": rule, "confidence": confidence,
                 "residual_minor": sum(x["amount_minor"] for x in legs) - anchor["amount_minor"], "currency": anchor["currency"]}
            for x in [anchor, *legs]:
                self.closed(x)
                x.update(status="matched", match_id=m["id"], break_id=None)
            outcome.update(outcome="matched", rule_id=rule, match_id=m["id"])
            return m

        def broken(trigger: str, legs: list[dict]) -> dict:
            b = _id("brk", [x["id"] for x in legs])
            snapshot = [dict(x) for x in legs]
            for x in legs:
                self.closed(x)
                x.update(status="break", break_id=b)
            self.breaks[b] = {"open": True, "n": len(legs)}
            outcome.update(outcome="break", break_id=b)
            return {"id": b, "trigger": trigger, "legs": snapshot, "related": before}

        if len(across) < len(related):
            yield "break", broken(S.DUPLICATE, [l])
        elif found := next(self.candidates(l), None):
            yield "match", matched(*found)
        elif partners := _canonical(x for x in across if x["status"] == "open"):
            yield "break", broken(S.REF_CONFLICT, [l, *partners])
        elif late := next((x for x in across if self.heals(l, x)), None):
            b, tol = late["break_id"], self.rules.tolerance(l["amount_minor"])
            self.breaks[b]["open"] = False
            conf = self.rules.confidence(late["amount_minor"] - l["amount_minor"], tol) - 0.05
            yield "match", matched(S.T2_LATE, 2, l, [late], conf)
            outcome.update(outcome="resolved_break", break_id=b)
            yield "heal", {"id": b, "match_id": outcome["match_id"]}
        elif across:
            yield "break", broken(S.REF_CONFLICT, [l])
        else:
            self.opened(l)
        yield "outcome", outcome

    def heals(self, l: dict, x: dict) -> bool:
        b = self.breaks.get(x["break_id"] or "")
        fits = abs(l["amount_minor"] - x["amount_minor"]) <= self.rules.tolerance(l["amount_minor"])
        return x["status"] == "break" and fits and x["currency"] == l["currency"] and b is not None and b["open"] and b["n"] == 1


def _plain(leg: dict) -> dict:
    out = dict(leg)
    out["value_date"] = out["value_date"].isoformat()
    for c in ("is_new", "break_open", "break_n", "component", "bucket"):
        out.pop(c, None)
    out["ingested_at"] = None if out["ingested_at"] is None or pd.isna(out["ingested_at"]) else pd.Timestamp(out["ingested_at"]).isoformat()
    return out


def fold(rows: pd.DataFrame, rules: Rules) -> pd.DataFrame:
    """rows: the legs of whole components, those of the state (is_new false, with break_open and
    break_n of their breaks) and the new ones."""
    part, out, held = Component(rules), [], {}
    for leg in rows.sort_values(["is_new", "ingest_seq"]).to_dict("records"):
        leg["attrs"] = dict(leg["attrs"] if leg["attrs"] is not None else {})
        leg = {k: (None if k in ("status", "match_id", "break_id") and not isinstance(v, str) else v) for k, v in leg.items()}
        leg["ingest_seq"] = int(leg["ingest_seq"])
        leg["amount_minor"] = int(leg["amount_minor"])
        if not leg["is_new"]:
            part.learn(leg)
            held[leg["id"]] = (leg["status"], leg["match_id"], leg["break_id"])
            if leg["status"] == "open":
                part.opened(leg)
            if leg["break_id"]:
                part.breaks[leg["break_id"]] = {"open": bool(leg["break_open"]), "n": int(leg["break_n"])}
            continue
        for kind, fields in part.step(leg):
            if kind == "break":
                fields = fields | {"legs": [_plain(x) for x in fields["legs"]], "related": [_plain(x) for x in fields["related"]]}
            out.append((kind, leg["ingest_seq"], json.dumps(fields)))
    changed = (x for x in part.known if held.get(x["id"]) != (x["status"], x["match_id"], x["break_id"]))
    out += [("leg", x["ingest_seq"], json.dumps(_plain(x))) for x in changed]
    return pd.DataFrame(out, columns=["kind", "ingest_seq", "payload"])
