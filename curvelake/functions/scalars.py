"""Scalar column expressions: ids, times, labels, numbers.  All stay inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bootstrap_method(name: object) -> str:
    """pairs or residual; anything else means pairs."""
    text = str(name).strip().lower()
    return text if text in ("pairs", "residual") else "pairs"


def number(text: Column) -> Column:
    """A double from text, decimal comma allowed; NULL for anything else, NaN and infinities."""
    value = F.replace(F.trim(text.cast("string")), F.lit(","), F.lit(".")).try_cast("double")
    return finite(value)


def finite(value: Column) -> Column:
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def conc_from_id(curve_id: Column) -> Column:
    """The number in ``[Conc=0.3]`` or ``[0.3]``."""
    return F.regexp_extract(curve_id, r"(?i)\[(?:\s*conc\s*=\s*)?([0-9]+(?:\.[0-9]+)?)\s*\]", 1).try_cast("double")


def has_conc_tag(curve_id: Column) -> Column:
    return conc_from_id(curve_id).isNotNull()


def fmt_g(value: Column) -> Column:
    """``%g``: six significant digits without trailing zeros, exponents outside 1e-4 to 1e6."""
    mantissa = F.format_string("%.5e", value)
    exponent = F.regexp_extract(mantissa, r"e([+-]\d+)$", 1).cast("int")
    strip = lambda x: F.when(F.instr(x, ".") > 0, F.regexp_replace(x, r"\.?0+$", "")).otherwise(x)
    sci = F.concat(strip(F.regexp_extract(mantissa, r"^([^e]+)e", 1)), F.lit("e"), F.regexp_extract(mantissa, r"e([+-]\d+)$", 1))
    fixed = F.lit(None).cast("string")
    for e in range(-4, 6):
        fixed = F.when(exponent == e, strip(F.format_string(f"%.{5 - e}f", value))).otherwise(fixed)
    return F.when(value.isNull(), None).when(value == 0, "0").when((exponent < -4) | (exponent >= 6), sci).otherwise(fixed)


def curve_key(curve_id: Column, conc: Column) -> Column:
    """The id, with its concentration unless that is unknown or already part of it."""
    return F.when(conc.isNull() | has_conc_tag(curve_id), curve_id).otherwise(F.concat(curve_id, F.lit("||"), fmt_g(conc)))


def duration_hours(text: Column) -> Column:
    """``1h 30m 5s``, ``t0``, ``to``, a plain number or nothing, in hours."""
    x = F.lower(F.trim(text))
    timed = x.rlike(r"^(?:[0-9]+(?:[.,][0-9]+)?\s*h[a-z]*)?\s*(?:[0-9]+(?:[.,][0-9]+)?\s*m[a-z]*)?\s*(?:[0-9]+(?:[.,][0-9]+)?\s*s[a-z]*)?$")
    dotted = F.replace(x, F.lit(","), F.lit("."))
    y = dotted
    part = lambda unit: F.coalesce(F.regexp_extract(y, rf"([0-9]+(?:\.[0-9]+)?)\s*{unit}", 1).try_cast("double"), F.lit(0.0))
    return F.when(x.isNull(), None).when(x.isin("t0", "to"), 0.0).when(number(x).isNotNull(), number(x)).when(timed, part("h") + part("m") / 60 + part("s") / 3600)


def time_scale(hint: Column, median_step: Column, largest: Column) -> Column:
    """Hours per unit: a hint in a header wins, else steps over 100 are seconds and maxima of 50 to 5000 minutes."""
    h = F.lower(F.coalesce(hint, F.lit("")))
    return (
        F.when(h.rlike(r"sec|\[s"), 1 / 3600.0).when(h.rlike(r"min|\[m"), 1 / 60.0).when(h.rlike(r"hour|hr|\[h|\(h\)"), 1.0)
        .when(median_step > 100, 1 / 3600.0).when((largest > 50) & (largest <= 5000), 1 / 60.0).otherwise(1.0)
    )


def well_of(column: Column) -> Column:
    """A01 of ``condition (A01)``; NULL without one."""
    found = F.regexp_extract(column, r"\(([A-Z]\d{2})\)\s*$", 1)
    return F.when(found != "", found)


def condition_of(column: Column) -> Column:
    return F.trim(F.regexp_replace(column, r"\s*\([A-Z]\d{2}\)\s*$", ""))


#: Spellings of truth and of labels.
TRUE_WORDS = ["true", "t", "yes", "y", "1", "1.0", "valid"]
FALSE_WORDS = ["false", "f", "no", "n", "0", "0.0", "invalid"]
UNSURE_WORDS = ["unsure", "uncertain", "unknown", "low confidence"]


def lenient_bool(text: Column) -> Column:
    x = F.lower(F.trim(text.cast("string")))
    return F.when(x.isin(TRUE_WORDS), True).when(x.isin(FALSE_WORDS), False)


def label_of(text: Column) -> Column:
    """Valid, Invalid, Unsure or NULL."""
    x = F.lower(F.trim(text.cast("string")))
    return F.when(x.isin(TRUE_WORDS), "Valid").when(x.isin(FALSE_WORDS), "Invalid").when(x.isin(UNSURE_WORDS), "Unsure")


def first_label(*columns: Column) -> Column:
    """The first column that is neither NULL nor blank, as a label."""
    return label_of(F.coalesce(*(F.nullif(F.trim(c.cast("string")), F.lit("")) for c in columns)))


def stable_seed(key: Column, base: int = 42, modulus: int = 10_000) -> Column:
    """base + the first 32 bits of SHA-256 modulo ``modulus``."""
    return F.lit(base) + F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("long") % modulus


def sanitize_token(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(text), r"[^A-Za-z0-9]+", "_"), r"^_+|_+$", "")


def conc_token(conc: Column) -> Column:
    return F.replace(F.replace(fmt_g(conc), F.lit("."), F.lit("p")), F.lit("-"), F.lit("m"))


def slug(text: Column) -> Column:
    return F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "_")


def spar_to_lam(spar: Column) -> Column:
    return F.pow(F.lit(10.0), F.lit(-6.0) + 8.0 * spar)


def lam_to_spar(lam: Column) -> Column:
    return (F.log10(lam) + 6.0) / 8.0
