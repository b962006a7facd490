"""How far a discount is trusted, and the ranks built on it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .amounts import rounded

# The weight of what a discount is measured against, and of how an offer is known.
BASIS_WEIGHT = {"market": 1.0, "store_regular": 0.9, "editor_compare": 0.8, "claimed_savings": 0.6, "history": 0.6,
                "list": 0.5, "none": 0.0}
EVIDENCE_WEIGHT = {"confirmed": 1.0, "listed2": 0.9, "listed": 0.75, "reported": 0.7, "yours": 0.5}
PROMO_TRUST = 0.7


def _weights(table: dict[str, float], key: Column) -> Column:
    lookup = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(lookup, F.coalesce(key, F.lit("none"))), F.lit(0.0))


def fn_basis_weight(basis: Column) -> Column:
    return _weights(BASIS_WEIGHT, basis)


def evidence_weight(status: Column) -> Column:
    return _weights(EVIDENCE_WEIGHT, status)


def halved(weight: Column, hedge: Column) -> Column:
    return F.when(F.coalesce(hedge, F.lit("")) != "", weight * 0.5).otherwise(weight)


def sc_local(pct: Column, basis: Column, hedge: Column, conditions: Column) -> Column:
    """Percent times trust, a tenth off for each condition, half at most."""
    n = F.size(F.filter(conditions, lambda c: c != "in store only"))
    return rounded(F.coalesce(pct, F.lit(0.0)) * halved(fn_basis_weight(basis), hedge)
                   * F.greatest(1 - 0.1 * n, F.lit(0.5)), 2)


def sc_online(discount: Column, basis: Column, conditions: Column) -> Column:
    """Discount times trust times confidence; a changed store price or an empty shelf leaves little of it."""
    n = F.size(F.filter(conditions, lambda c: c != "Prime members"))
    conf = 1 - 0.08 * n - F.when(F.exists(conditions, lambda c: c.contains("price varies")), 0.2).otherwise(0.0)
    gone = F.exists(conditions, lambda c: c.startswith("store price now") | c.startswith("out of stock"))
    return rounded(F.coalesce(discount, F.lit(0.0)) * fn_basis_weight(basis)
                   * F.greatest(F.when(gone, F.lit(0.15)).otherwise(conf), F.lit(0.15)), 2)


def sc_sale_rank(pct: Column, upto: Column, extra: Column, extra_upto: Column, off: Column, off_upto: Column,
                 min_spend: Column, bogo_pct: Column) -> Column:
    """What a shopper can count on: a firm percent in full with an extra one on top, ceilings at half their distance,
    dollars off a stated order size at half their share."""
    zero = F.lit(0.0)
    base = F.greatest(F.coalesce(pct, zero), F.coalesce(bogo_pct, zero))
    firm = F.when(extra.isNotNull(), 100 * (1 - (1 - base / 100) * (1 - extra / 100))).otherwise(base)
    top = F.coalesce(extra_upto, extra)
    # a zero ceiling counts as none, as an absent one does
    ceiling = F.when(top.isNull(), F.coalesce(F.nullif(upto, zero), firm)).otherwise(
        100 * (1 - (1 - F.coalesce(F.nullif(upto, zero), pct, zero) / 100) * (1 - top / 100)))
    best = F.when(upto.isNotNull() | extra_upto.isNotNull(), firm + 0.5 * F.greatest(zero, ceiling - firm)).otherwise(firm)
    share = F.when(off.isNotNull() & (min_spend > 0) & ~F.coalesce(off_upto, F.lit(False)), 50 * off / min_spend)
    best = F.greatest(best, F.coalesce(share, zero))
    return F.when(best > 0, rounded(best, 1))


def sc_regular(pct: Column, basis: Column, hedge: Column, status: Column) -> Column:
    return rounded(F.coalesce(pct, F.lit(0.0)) * halved(fn_basis_weight(basis), hedge) * evidence_weight(status), 2)


TAKES_PURCHASE = (r"(?i)\b(?:(?:with|when (?:you|they))\b|w/)[^.]{0,40}\b(?:purchase|buy|order)|"
                  r"\b(?:with|per) (?:an? |each |every |any )?(?:adult|regular|full-priced)\b")


def badge_size(discount: Column, pct: Column, summary: Column, title: Column, conditions: Column) -> Column:
    """The percent on a badge: something free is 100, or 50 when it takes a purchase; else null."""
    free = F.coalesce(summary, F.lit("")).rlike(r"(?i)\bfree\b")
    purchase = (F.exists(conditions, lambda c: c.rlike(r"(?i)^with\b")) | summary.rlike(r"(?i)kids eat free")
                | F.coalesce(title, F.lit("")).rlike(TAKES_PURCHASE))
    return F.coalesce(discount, F.nullif(pct, F.lit(0.0)), F.when(free & purchase, 50.0).when(free, 100.0))


def sc_top_rank(kind: Column, size: Column, basis: Column, hedge: Column, status: Column, score: Column) -> Column:
    """A deal's rank among the four kinds: standing offers and promotions by size and trust, the others by score. A
    free item has no basis of its own and counts as measured against its own price."""
    b = F.coalesce(basis, F.lit("none"))
    trust = halved(fn_basis_weight(F.when(b == "none", F.lit("store_regular")).otherwise(b)), hedge)
    return rounded(F.when(kind == "regular", size * trust * evidence_weight(status))
                   .when(kind == "promotion", size * trust * PROMO_TRUST).otherwise(score), 2)
