"""Evidence grades as ordered conditions over one row per graded object."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Grade order.
ORDER = ["Insufficient", "Weak", "Moderate", "Strong"]


def rank(grade: Column) -> Column:
    value = F.lit(-1)
    for i, g in enumerate(ORDER):
        value = F.when(grade == g, F.lit(i)).otherwise(value)
    return value


def at_least(grade: Column, floor: str) -> Column:
    return rank(grade) >= ORDER.index(floor)


def historical(psr: Column, dsr: Column, selection_risk: Column) -> Column:
    blind = F.when(psr >= 0.95, "Weak").otherwise("Insufficient")
    strong = F.when(selection_risk == "High", "Moderate").otherwise("Strong")
    graded = (
        F.when((dsr >= 0.95) & (psr >= 0.99), strong).when((dsr >= 0.90) | (psr >= 0.95), "Moderate").when(dsr >= 0.80, "Weak").otherwise("Insufficient")
    )
    return F.when(dsr.isNull(), blind).otherwise(graded)


def robustness(assets: Column, positive: Column, folds: Column) -> Column:
    share = positive / assets
    return (
        F.when(assets == 0, "Insufficient").when((share >= 0.9) & (folds >= 4), "Strong").when(share >= 0.65, "Moderate").when(share >= 0.5, "Weak").otherwise("Insufficient")
    )


def selection(pool: Column, ledger: Column, ledger_dsr: Column) -> Column:
    n = F.coalesce(ledger, F.lit(0))
    return (
        F.when((pool <= 1) & (n == 0), "Low").when(F.coalesce(ledger_dsr >= 0.95, F.lit(False)), "Moderate").when((n >= 25) | (pool >= 50), "High").otherwise("Moderate")
    )


def costs(events: Column, error_bp: Column, sufficient: Column) -> Column:
    err = F.abs(error_bp)
    return (
        F.when((events == 0) | ~sufficient | error_bp.isNull(), "Insufficient").when(err <= 5, "Strong").when(err <= 15, "Moderate").otherwise("Weak")
    )


def forward(days: Column, outages: Column, intact: Column, code_ok: Column, changes: Column, current: Column) -> Column:
    base = F.when(days < 30, "Insufficient").when(days < 90, "Weak").when(days < 180, "Moderate").otherwise("Strong")
    shaky = (days > 0) & (F.try_divide(outages, days) > 0.2) & (days >= 90)
    return F.when(~intact | ~code_ok | (changes != 0), "COMPROMISED").when(~current, "Insufficient").when(shaky, "Weak").otherwise(base)


def registration(n_valid: Column, any_read: Column, state: Column) -> Column:
    return (
        F.when(F.coalesce(n_valid, F.lit(0)) <= 0, "Weak").when(~any_read, "Moderate").when(state == "CONFIRMED", "Strong").when(state == "NOT_CONFIRMED", "Weak").otherwise("Moderate")
    )


def overall(hist: Column, robust: Column, select: Column, cost: Column, fwd: Column, reg: Column) -> Column:
    compromised = (hist == "COMPROMISED") | (robust == "COMPROMISED") | (select == "COMPROMISED") | (cost == "COMPROMISED") | (fwd == "COMPROMISED")
    solid = at_least(hist, "Moderate") & at_least(robust, "Moderate")
    core = solid & at_least(cost, "Moderate")
    return (
        F.when(compromised, "INVALIDATED")
        .when(~at_least(fwd, "Weak"), F.when(solid, "promising, not validated").otherwise("not established"))
        .when(~at_least(reg, "Moderate"), "promising, not validated")
        .when(core & at_least(fwd, "Strong") & (select != "High"), "validated (provisional)")
        .otherwise("partially supported")
    )


MEANINGFUL_DAYS = 30


def state(has_record: Column, has_freeze: Column, intact: Column, current: Column, days: Column) -> Column:
    return (
        F.when(has_freeze & ~intact, "INVALIDATED").when(has_freeze & ~current, "SUPERSEDED").when(~has_record, "RESEARCH_ONLY").when(~has_freeze, "CANONICAL_READY")
        .when(days >= MEANINGFUL_DAYS, "FORWARD_MEANINGFUL").otherwise("FORWARD_PRELIMINARY")
    )


def plan_read(registered: Column, seal_ok: Column, read_before: Column, evidence: Column, minimum: Column, value: Column, direction: Column, threshold: Column, rejected: Column) -> Column:
    """Read-out of a pre-registered plan; `rejected` is the family-wise decision of the primary arm (NULL without p-values)."""
    clears = F.when(direction == "gt", value > threshold).when(direction == "lt", value < threshold).when(direction == "ge", value >= threshold).otherwise(value <= threshold)
    return (
        F.when(~registered, "UNREGISTERED").when(~seal_ok, "DRIFTED").when(read_before, "ALREADY_READ")
        .when(value.isNull() | (evidence < minimum), "INCONCLUSIVE").when(F.coalesce(~rejected, F.lit(False)), "NOT_CONFIRMED").when(clears, "CONFIRMED").otherwise("NOT_CONFIRMED")
    )
