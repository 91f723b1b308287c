"""Column expressions of scores, verdicts, geometry, luma and text; all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lower bounds of the verdict bands.
VERDICTS = ((70.0, "likely manipulated"), (45.0, "suspicious"), (20.0, "minor anomalies"))
LEAST_VERDICT = "likely authentic"
# Names of the labels.
AUTHENTIC = ("authentic", "au", "real", "original", "pristine", "0")
TAMPERED = ("tampered", "tp", "forged", "fake", "manipulated", "1")


def clamp_score(c: Column) -> Column:
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), c))


def verdict(c: Column) -> Column:
    """The band of an unrounded score; a bound belongs to the band above it."""
    out = F.lit(LEAST_VERDICT)
    for bound, name in reversed(VERDICTS):
        out = F.when(c >= bound, name).otherwise(out)
    return out


def severity_class(c: Column) -> Column:
    return F.when(c >= 70, "high").when(c >= 45, "elevated").when(c >= 20, "low").otherwise("minimal")


def label_of(c: Column) -> Column:
    low = F.lower(F.trim(c))
    return F.when(low.isin(*AUTHENTIC), "authentic").when(low.isin(*TAMPERED), "tampered")


def luma(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def rounded_luma(r: Column, g: Column, b: Column) -> Column:
    """Half away from zero, as an 8-bit number."""
    return F.least(F.lit(255), F.greatest(F.lit(0), F.round(luma(r, g, b)))).cast("int")


def region(x: Column, y: Column, width: Column, height: Column) -> Column:
    return F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), width.cast("int").alias("width"), height.cast("int").alias("height"))


def intersection(a: Column, b: Column) -> Column:
    """The common part of two regions; null if they have none."""
    x0, y0 = F.greatest(a.x, b.x), F.greatest(a.y, b.y)
    x1, y1 = F.least(a.x + a.width, b.x + b.width), F.least(a.y + a.height, b.y + b.height)
    return F.when((x1 > x0) & (y1 > y0), region(x0, y0, x1 - x0, y1 - y0))


def html_escape(c: Column) -> Column:
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(mark), F.lit(entity))
    return c


def csv_field(c: Column) -> Column:
    """Quoted only where the value holds a comma, a quote or a line break."""
    quoted = F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(c.rlike('[,"\\n\\r]'), quoted).otherwise(c)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


#: The parts of a date, and the seconds from 1970 at which the years 1 to 9999 begin and end.
_DATE = r"^(-?\d{1,5}):(-?\d{1,5}):(-?\d{1,5}) (-?\d{1,5}):(-?\d{1,5}):(-?\d{1,5})$"
_YEARS = -62_135_596_800, 253_402_300_799


def exif_date(c: Column) -> Column:
    """``Y:M:D H:M:S`` as a timestamp without a zone; parts beyond their range roll over, as in a lenient calendar.

    Null for anything else, and for what leads out of the years 1 to 9999.
    """
    y, mo, d, h, mi, s = (F.regexp_extract(c, _DATE, k).try_cast("long") for k in range(1, 7))
    months = y * 12 + mo - 1
    year = F.floor(months / 12)
    first = F.when(year.between(1, 9999), F.make_date(year.cast("int"), (F.pmod(months, F.lit(12)) + 1).cast("int"), F.lit(1)))
    seconds = F.unix_date(first).cast("long") * 86_400 + (((d - 1) * 24 + h) * 60 + mi) * 60 + s
    whole = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))
    return F.when(seconds.between(*_YEARS), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + whole)


def unit(c: Column) -> Column:
    """Into 0 to 1; zero for what is no number."""
    return F.when(F.isnan(c) | c.isNull(), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)))


def synthesis_likelihood(spectral: Column, absence: Column, weight: Column) -> Column:
    """The weaker of two signals, moved by ``weight`` towards the stronger."""
    s, a = unit(spectral), unit(absence)
    return F.least(s, a) + unit(weight) * (F.greatest(s, a) - F.least(s, a))


def peak_threshold(sensitivity: Column) -> Column:
    return F.pow(F.lit(10.0), 2 - F.when(F.isnan(sensitivity), 0.5).otherwise(unit(sensitivity)))


def artifact_score(ratio: Column, threshold: Column) -> Column:
    return F.when(ratio < threshold, 0.0).otherwise(F.least(F.lit(1.0), 0.5 + 0.5 * F.log10(ratio / threshold) / F.log10(F.lit(30.0))))


def area_severity_score(flagged: Column, reliable: Column, severity: Column, area: float = 70.0, strength: float = 30.0) -> Column:
    """Flagged share of reliable blocks, full at a twentieth, plus the mean severity of the flagged."""
    return F.when(flagged > 0, F.least(F.lit(area), flagged / reliable / 0.05 * area) + strength * severity).otherwise(0.0)


def quality_levels(low: Column, high: Column, step: Column) -> Column:
    """Clamped, in order, in steps of one at least, and ending at the higher bound."""
    inside = lambda c: F.least(F.lit(100), F.greatest(F.lit(1), c)).cast("int")
    a, b = inside(F.least(low, high)), inside(F.greatest(low, high))
    return F.array_distinct(F.concat(F.sequence(a, b, F.greatest(F.lit(1), step).cast("int")), F.array(b)))


def spectral_crop(width: Column, height: Column) -> Column:
    """The side of the centred square of a spectrum: the largest power of two from 64 to 512 that fits; null if none."""
    fit = F.least(width, height)
    return F.when(fit >= 512, 512).when(fit >= 256, 256).when(fit >= 128, 128).when(fit >= 64, 64)


def working_scale(width: Column, height: Column, cap: int) -> Column:
    """By how much an image is reduced so that its longer side is at most ``cap`` (64 at least)."""
    return F.greatest(F.lit(1), F.ceil(F.greatest(width, height) / max(64, cap))).cast("int")


def tiled(width: Column, height: Column, threshold: int, enabled: bool = True, tile: int = 1024) -> Column:
    """Whether an image is analyzed in tiles: longer than the threshold, and more than one tile."""
    return F.lit(enabled) & (F.greatest(width, height) > threshold) & (F.ceil(width / tile) * F.ceil(height / tile) > 1)


def effective_block(size: Column, multiple: int, least: int = 16) -> Column:
    """A block size raised to the least one and to a multiple."""
    raised = F.greatest(F.lit(least), size)
    return (F.ceil(raised / multiple) * multiple).cast("int")


def jpeg_checks_apply(fmt: Column) -> Column:
    """Whether checks of JPEG history make sense for a format."""
    return ~fmt.isin("heif", "webp")
