"""Formats from the first bytes, as one expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Brands of HEVC-coded, AV1-coded and generic still images.
HEVC_BRANDS = ("heic", "heix", "hevc", "hevx", "heim", "heis", "hevm", "hevs")
AV1_BRANDS = ("avif", "avis")
GENERIC_BRANDS = ("mif1", "mif2", "msf1")


def brands(content: Column) -> Column:
    """The major and the compatible brands of a file-type box; null without one of 16 bytes at least."""
    size = F.conv(F.hex(F.substring(content, 1, 4)), 16, 10).cast("long")
    end = F.least(size, F.octet_length(content).cast("long"))
    at = F.concat(F.array(F.lit(9).cast("long")), F.when(end >= 20, F.sequence(F.lit(17).cast("long"), end - 3, F.lit(4).cast("long"))).otherwise(F.array().cast("array<bigint>")))
    ascii_ = lambda k: F.decode(F.substring(content, k.cast("int"), F.lit(4)), "ISO-8859-1")
    return F.when((F.octet_length(content) >= 16) & (F.substring(content, 5, 4) == F.lit(b"ftyp")) & (size >= 16), F.transform(at, ascii_))


def format_of(content: Column) -> Column:
    """bmp, jpeg, ppm, pgm, heif or webp; null for anything else."""
    starts = lambda b: F.substring(content, 1, len(b)) == F.lit(b)
    found = brands(content)
    any_of = lambda names: F.arrays_overlap(found, F.array(*map(F.lit, names)))
    heif = F.when(any_of(HEVC_BRANDS), True).when(any_of(AV1_BRANDS), False).otherwise(any_of(GENERIC_BRANDS))
    return (
        F.when(starts(b"BM"), "bmp")
        .when(starts(b"\xff\xd8"), "jpeg")
        .when(starts(b"P6"), "ppm")
        .when(starts(b"P5"), "pgm")
        .when(F.coalesce(heif, F.lit(False)), "heif")
        .when(starts(b"RIFF") & (F.substring(content, 9, 4) == F.lit(b"WEBP")), "webp")
    )


def is_animated(content: Column) -> Column:
    """Whether an extended WebP header sets the animation flag."""
    flags = F.conv(F.hex(F.substring(content, 21, 1)), 16, 10).cast("int")
    return (F.substring(content, 13, 4) == F.lit(b"VP8X")) & (flags.bitwiseAND(F.lit(2)) != 0)
