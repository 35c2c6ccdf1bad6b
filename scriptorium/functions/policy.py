"""Trust, quality, quarantine and visibility as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed
from .text import _c, clamp, loose_date


def injection_hits(text: Column | str) -> Column:
    """The first match of each pattern of instruction-like language."""
    return F.filter(F.array(*(F.regexp_extract(_c(text), p, 0) for p in fixed.INJECTION)), lambda m: m != "")


def trust_score(text: Column | str, title: Column | str) -> Column:
    t = _c(title)
    shouting = (t == F.upper(t)) & (t != F.lower(t)) & (F.length(t) > fixed.UPPER_TITLE_OVER)
    return clamp(1.0 - fixed.TRUST_PER_HIT * F.size(injection_hits(text)) - F.when(shouting, F.lit(fixed.TRUST_UPPER_TITLE)).otherwise(F.lit(0.0)))


def quality_score(text: Column | str, title: Column | str, ocr: Column | None = None) -> Column:
    x = _c(text)
    weird = (F.length(x) - F.length(F.translate(x, fixed.WEIRD, ""))) / F.greatest(F.lit(1), F.length(x))
    minus = lambda when, value: F.when(when, F.lit(value)).otherwise(F.lit(0.0))
    score = 1.0 - minus(F.btrim(_c(title)) == "", fixed.QUALITY_NO_TITLE) - minus(F.length(F.btrim(x, F.lit(" \n\t\r\x0b\x0c"))) < fixed.SHORT_UNDER, fixed.QUALITY_SHORT)
    score = score - F.least(F.lit(fixed.QUALITY_WEIRD_MOST), weird * fixed.WEIRD_FACTOR)
    if ocr is not None:
        score = score - F.coalesce(minus(ocr < fixed.OCR_UNDER, fixed.QUALITY_OCR), F.lit(0.0))
    return clamp(score)


def quarantine_reason(text: Column | str, title: Column | str, ocr: Column | None = None) -> Column:
    """Why a document stays out of the index, reasons joined by '; '; null if it does not."""
    hits = injection_hits(text)
    low_ocr = F.lit(False) if ocr is None else F.coalesce(ocr < fixed.OCR_UNDER, F.lit(False))
    reasons = F.array_compact(F.array(F.when(F.size(hits) > 0, F.concat(F.lit("suspicious:"), F.array_join(hits, "; "))), F.when(low_ocr, F.lit("low_ocr_confidence"))))
    bad = (quality_score(text, title, ocr) < fixed.LEAST_QUALITY) | (trust_score(text, title) < fixed.LEAST_TRUST) | (F.size(hits) > 0) | low_ocr
    return F.when(bad, F.array_join(reasons, "; "))


def disclosures_of(role: Column | str) -> Column:
    """What a role may see; an unknown role sees what is public."""
    table = F.create_map(*(x for r, d in fixed.ROLE_DISCLOSURES.items() for x in (F.lit(r), F.array(*map(F.lit, d)))))
    return F.coalesce(F.try_element_at(table, _c(role)), F.array(F.lit("public")))


def can_view(disclosure: Column | str, allowed: Column | str) -> Column:
    return F.array_contains(_c(allowed), _c(disclosure))


def action_allowed(action: Column, approved: Column, requested: Column, role: Column) -> Column:
    blocked = action.startswith("side_effect:") & ~F.coalesce(approved, F.lit(False))
    return ~(blocked | ((requested == "internal") & (role == "external")))


def retention_tag(kind: Column | str) -> Column:
    return F.when(_c(kind).isin("agent", "answer"), "short_lived").otherwise("standard")


def eligible(c: dict[str, Column], q: dict[str, Column], strict_roles: bool = False) -> Column:
    """Whether a chunk (c) is visible to a query (q): disclosure, trust, product, region, date. Blank products and dates pass.

    With strict_roles the chunk's allowed_roles must hold the user's role as well."""
    blank = lambda x: F.coalesce(x, F.lit("")) == ""
    out = can_view(c["disclosure"], q["allowed"]) & (c["trust_score"] >= fixed.LEAST_TRUST)
    out = out & (blank(q["product"]) | blank(c["product"]) | (c["product"] == q["product"]))
    out = out & (blank(q["region"]) | (c["region"] == q["region"]) | (c["region"] == "global"))
    wanted = F.coalesce(q["disclosure"], F.lit(""))
    out = out & F.when(wanted == "partner_shareable", c["disclosure"].isin("public", "partner_shareable")).when(wanted == "internal", c["disclosure"] != "public").otherwise(True)
    out = out & (blank(q["after_date"]) | blank(c["effective_date"]) | (loose_date(c["effective_date"]) >= loose_date(q["after_date"])))
    return out & F.array_contains(c["allowed_roles"], q["role"]) if strict_roles else out
