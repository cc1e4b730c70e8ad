"""Historical years in statements: readings of explicit ranges and years as columns. BCE years are negative, there is no year 0."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The forms in which statements give ranges and years. An era is BC or AD in any usual spelling.
_BC, _AD = r"(?:BCE|BC|B\.\s*C\.)", r"(?:CE|AD|A\.\s*D\.)"
_N, _DASH = r"([0-9]{1,4})", r"\s*(?:–|—|--|-)\s*"
#: (pattern with two years, whether BCE)
RANGES = tuple(
    (form.replace("ERA", era), bce)
    for era, bce in ((_BC, True), (_AD, False))
    for form in (
        rf"\b{_N}{_DASH}{_N}\s*ERA(?![A-Za-z])",
        rf"\b{_N}\s*ERA\s+to\s+{_N}\s*ERA(?![A-Za-z])",
        rf"\bERA\s*{_N}{_DASH}{_N}\b",
        rf"\bERA\s*{_N}\s+to\s+{_N}\b",
        rf"\bbetween\s+{_N}\s+and\s+{_N}\s*ERA(?![A-Za-z])",
        rf"\bbetween\s+ERA\s+{_N}\s+and\s+{_N}\b",
        rf"\bfrom\s+{_N}\s+through\s+{_N}\s*ERA(?![A-Za-z])",
        rf"\bfrom\s+ERA\s*{_N}\s+through\s+{_N}\b",
    )
) + ((rf"\b{_N}\s+to\s+{_N}\s*{_AD}(?![A-Za-z])", False), (rf"公元前\s*{_N}\s*年?\s*(?:至|到|[-–—])\s*公元前?\s*{_N}\s*年", True))
#: What looks like a range but is none of the above: years inside it are not read.
RANGE_LIKE = rf"\b(?:(?:{_BC}|{_AD})\s*)?[0-9]{{1,4}}\s*(?:–|—|--|-|\bto\b|\buntil\b|\bthrough\b|\bthru\b|\bup to\b|/)\s*[0-9]{{1,4}}(?:\s*(?:{_BC}|{_AD}))?|\bbetween\s+[0-9]{{1,4}}\s+and\s+[0-9]{{1,4}}"
YEARS = (
    (rf"\b{_BC}\s*{_N}\b", True),
    (rf"\b{_N}\s*{_BC}(?![A-Za-z])", True),
    (rf"公元前\s*{_N}\s*年", True),
    (rf"\b{_AD}\s*{_N}\b", False),
    (rf"\b{_N}\s*{_AD}(?![A-Za-z])", False),
    (rf"公元\s*{_N}\s*年", False),
)
APPROXIMATE = r"(?:\b(?:about|circa|c\.)\s+|约\s*)"
CENTURY = rf"\b(?:[0-9]+(?:st|nd|rd|th)|first|second|third|fourth|fifth)\s+century\s+(?:BCE|BC|CE|AD)\b|公元前?\s*[0-9]+\s*世纪"
#: Masks what has been read; no pattern matches it.
READ = " § "

_READING = "array<struct<start:int,end:int,precision:string>>"


def _reading(bce: bool, precision: str):
    """A reading of two numbers in an era."""
    sign = -1 if bce else 1

    def of(a: Column, b: Column) -> Column:
        x, y = a.cast("int") * sign, b.cast("int") * sign
        return F.struct(F.least(x, y).alias("start"), F.greatest(x, y).alias("end"), F.lit(precision).alias("precision"))

    return of


def readings(text: Column) -> Column:
    """Distinct (start, end, precision) of the explicit ranges, then of the years outside them."""
    either = lambda patterns: "|".join(f"(?:{p})" for p in patterns)
    take = lambda source, pattern, group=1: F.regexp_extract_all(source, F.lit(f"(?i){pattern}"), group)
    found = [F.zip_with(take(text, pattern), take(text, pattern, 2), _reading(bce, "YEAR_RANGE")) for pattern, bce in RANGES]
    outside = F.regexp_replace(text, f"(?i){either([p for p, _ in RANGES])}|{RANGE_LIKE}", READ)
    exact = F.regexp_replace(outside, f"(?i){APPROXIMATE}(?:{either([p for p, _ in YEARS])})", READ)
    for pattern, bce in YEARS:
        for source, form, precision in ((outside, APPROXIMATE + pattern, "APPROXIMATE"), (exact, pattern, "YEAR")):
            years = take(source, form)
            found.append(F.zip_with(years, years, _reading(bce, precision)))
    every = F.filter(F.array_distinct(F.concat(*[x.cast(_READING) for x in found])), lambda r: (r["start"] != 0) & (r["end"] != 0))
    return F.when(text.isNotNull(), every).otherwise(F.array().cast(_READING))


def verdict(found: Column, text: Column) -> Column:
    """(status, start, end, precision): RESOLVED with the best precision if all readings agree, else
    CONFLICT; CENTURY_UNRESOLVED or UNRESOLVED without any."""
    spans = F.array_distinct(F.transform(found, lambda r: F.struct(r["start"], r["end"])))
    rank = lambda r: F.when(r["precision"] == "YEAR", 0).when(r["precision"] == "YEAR_RANGE", 1).otherwise(2)
    best = F.array_min(F.transform(found, lambda r: F.struct(rank(r).alias("rank"), r["start"].alias("start"), r["end"].alias("end"), r["precision"].alias("precision"))))
    one = F.size(spans) == 1
    status = F.when(one, "RESOLVED").when(F.size(spans) > 1, "CONFLICT").when(F.coalesce(text.rlike(f"(?i){CENTURY}"), F.lit(False)), "CENTURY_UNRESOLVED").otherwise("UNRESOLVED")
    return F.struct(status.alias("status"), F.when(one, best["start"]).alias("start"), F.when(one, best["end"]).alias("end"), F.when(one, best["precision"]).otherwise("UNKNOWN").alias("precision"))


#: The years of a named period, and of others that are given by name alone.
REPUBLIC = (-509, -27)
NAMED_PERIODS = {"modern": (1500, 2100), "archaic": (-640, 640), "classical": (-640, 640), "hellenistic-republican": (-640, 640), "roman": (-640, 640), "late-antique": (-640, 640)}


def window(period: Column) -> Column:
    """(start, end) of the years in an event's period; the republic's by its name, null without years."""
    number, era = (F.regexp_extract_all(period, F.lit(r"(?i)(-?[0-9]{1,4})\s*(BCE|BC|CE|AD)?"), g) for g in (1, 2))
    years = F.zip_with(number, era, lambda n, e: F.when(F.upper(e).isin("BCE", "BC"), -F.abs(n.cast("int"))).when(F.upper(e).isin("CE", "AD"), F.abs(n.cast("int"))).otherwise(n.cast("int")))
    named = F.when(F.contains(F.lower(period), F.lit("roman republic")), F.struct(F.lit(REPUBLIC[0]).alias("start"), F.lit(REPUBLIC[1]).alias("end")))
    return F.when(F.size(years) > 0, F.struct(F.array_min(years).alias("start"), F.array_max(years).alias("end"))).otherwise(named)


def attested(period: Column) -> Column:
    """(start, end) of an attestation's named period, null for others."""
    pick = lambda k, v: (F.lower(period) == k, F.struct(F.lit(v[0]).alias("start"), F.lit(v[1]).alias("end")))
    return reduce(lambda c, kv: c.when(*pick(*kv)), list(NAMED_PERIODS.items())[1:], F.when(*pick("modern", NAMED_PERIODS["modern"])))


def meets(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    """Whether closed intervals of years share a year."""
    return (end >= other_start) & (other_end >= start)
