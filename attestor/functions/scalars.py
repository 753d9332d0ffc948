"""Scalar expressions: identifiers, three-valued tests, scales and text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_false(c: Column) -> Column:
    """True only for an explicit false; unknown stays out."""
    return c.eqNullSafe(F.lit(False))


def is_true(c: Column) -> Column:
    return c.eqNullSafe(F.lit(True))


def overlaps(a: Column, b: Column) -> Column:
    """Set overlap that is never null: null elements and null arrays don't match."""
    strip = lambda x: F.filter(x, lambda e: e.isNotNull())
    return F.coalesce(F.arrays_overlap(strip(a), strip(b)), F.lit(False))


def normalize_cik(c: Column) -> Column:
    """Ten digits, zero-padded; null for anything that isn't 1 to 10 significant digits, or is zero."""
    digits = F.ltrim(F.trim(c.cast("string")), F.lit("0"))
    return F.when(F.trim(c.cast("string")).rlike("^[0-9]{1,10}$") & (F.length(digits) > 0), F.lpad(digits, 10, "0"))


def normalize_accession(c: Column) -> Column:
    """18 digits written 10-2-6; null otherwise."""
    d = F.regexp_replace(c, "[^0-9]", "")
    return F.when(F.length(d) == 18, F.concat_ws("-", F.substring(d, 1, 10), F.substring(d, 11, 2), F.substring(d, 13, 6)))


def company_id(cik: Column) -> Column:
    return F.concat(F.lit("CIK"), cik)


def cohort(date: Column, cutoff: Column) -> Column:
    """After the cutoff: entrant; on or before it, or undated: baseline."""
    return F.when(date > cutoff, "post_baseline_entrant").otherwise("baseline")


def missing_sections(present: Column, expected: list[str]) -> Column:
    return F.array_sort(F.array_except(F.array(*map(F.lit, expected)), present))


def scale_rank(label: Column, labels: list[str]) -> Column:
    """Place on an ordinal scale from 0; unknown labels are null, never 0."""
    return reduce(lambda e, x: F.when(label == x[1], x[0]).otherwise(e), enumerate(labels), F.lit(None).cast("int"))


def html_text(html: Column) -> Column:
    """Main text: scripts, styles and navigation dropped, then tags, then white space folded."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|nav)[^>]*>.*?</(script|style|nav)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"<[^>]*>", " "), r"[ \t\n\r]+", " "))


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, without www., query, fragment or last slash."""
    plain = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"/$", "")
    return F.regexp_replace(F.lower(plain), r"^(https?://)www\.", "$1")


def render_prompt(template: str, values: dict[str, Column]) -> Column:
    """Replace each {{name}}; a template that lacks a placeholder is an error."""
    if missing := [k for k in values if f"{{{{{k}}}}}" not in template]:
        raise ValueError(f"template lacks {missing}")
    return reduce(lambda c, kv: F.replace(c, F.lit(f"{{{{{kv[0]}}}}}"), kv[1]), values.items(), F.lit(template))


def stratum(sic: Column, size: Column, archetypes: Column, reason: Column, confidence: Column) -> Column:
    s = F.coalesce(sic.cast("string"), F.lit(""))
    blank = lambda c, d: F.when(F.coalesce(c, F.lit("")) == "", d).otherwise(c)
    return F.concat_ws(
        "|", F.when(F.length(s) >= 2, F.substring(s, 1, 2)).otherwise("unknown"), blank(size, "unknown"),
        F.coalesce(F.get(archetypes, F.lit(0)), F.lit("none")), blank(reason, "screen_likely_ineligible"), blank(confidence, "unknown"),
    )
