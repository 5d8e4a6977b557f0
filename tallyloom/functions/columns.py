"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.rules import Rules

BLANK = r"^\s*$"


def nul() -> Column:
    return F.char(F.lit(0))


def _printed(c: Column) -> Column:
    """Whether a text begins with printed ASCII: no white space there, so no pattern is needed."""
    return F.ascii(c).between(33, 126)


def blank(c: Column) -> Column:
    return c.isNull() | (~_printed(c) & c.rlike(BLANK))


def stripped(c: Column) -> Column:
    return F.when(_printed(c) & _printed(F.substring(c, -1, 1)), c).otherwise(F.regexp_replace(c, r"^\s+|\s+$", ""))


def tolerance(amount: Column, rules: Rules) -> Column:
    """Halves round up; in integers, so exact at any size."""
    relative = F.floor((F.abs(amount) * F.lit(rules.tolerance_bps) + F.lit(5_000)) / F.lit(10_000)) if rules.tolerance_bps else F.lit(0)
    return F.greatest(relative.cast("long"), F.lit(rules.tolerance_abs_minor).cast("long"))


def within_tolerance(reference: Column, other: Column, rules: Rules) -> Column:
    return F.abs(reference - other) <= tolerance(reference, rules)


def within_days(a: Column, b: Column, rules: Rules) -> Column:
    return F.abs(F.datediff(a, b)) <= rules.value_date_window_days


def tolerant_confidence(residual: Column, tol: Column) -> Column:
    share = F.least(F.lit(1.0), F.abs(residual).cast("double") / tol)
    return F.when(tol <= 0, F.lit(0.95)).otherwise(F.round((F.lit(0.95) - F.lit(0.15) * share) * 1000) / 1000)


def content_hash(c: dict[str, Column]) -> Column:
    """SHA-256 over every business field and the sorted attributes, each followed by NUL."""
    end = nul()
    fields = [c["source"], c["txn_ref"], c["amount_minor"].cast("string"), c["currency"], c["value_date"].cast("string"), c["direction"], c["counterparty"]]
    head = F.concat(*[x for f in fields for x in (f, end)])
    entries = F.array_sort(F.map_entries(F.coalesce(c["attrs"], F.create_map().cast("map<string,string>"))))
    # Most legs have no attributes: nothing to sort or to join.
    tail = F.when(F.coalesce(F.size(c["attrs"]), F.lit(0)) <= 0, "").otherwise(F.array_join(F.transform(entries, lambda e: F.concat(e["key"], nul(), e["value"], nul())), ""))
    return F.sha2(F.concat(head, tail), 256)


def leg_id(c: dict[str, Column]) -> Column:
    return F.concat_ws(":", c["source"], c["txn_ref"], F.substring(content_hash(c), 1, 12))


def derived_id(prefix: str, ids: Column) -> Column:
    """Id of a match or break from its legs', whatever their order."""
    joined = F.array_join(F.array_sort(ids), "\0")
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(joined, 256), 1, 20))


def age_seconds(opened: Column, resolved: Column, now: Column) -> Column:
    micros = F.unix_micros(F.coalesce(resolved, now)) - F.unix_micros(opened)
    return F.floor(micros / F.lit(1_000_000)).cast("long")


def first_attr(attrs: list[Column], keys: tuple[str, ...]) -> Column:
    """The first of keys that is not blank, looked for in each map in turn; else null."""
    tests = [F.when(~blank(F.try_element_at(a, F.lit(k))), F.lit(k)) for a in attrs for k in keys]
    return F.coalesce(*tests)
