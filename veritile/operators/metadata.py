"""Rules over metadata fields; a rule with a missing field does not fire."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of editors.
SOFTWARE = ("photoshop", "gimp", "lightroom", "affinity photo", "pixelmator", "snapseed", "paint.net", "picsart")
DAY = 86_400
MAX_DRIFT, MAX_GPS_DRIFT, MAX_DIGITIZED_DRIFT = 30 * DAY, 300, 300


def editor_in(software: Column, keywords: tuple[str, ...] = SOFTWARE) -> Column:
    """The first keyword that the text holds, without regard to case; null if none."""
    return F.get(F.filter(F.array(*map(F.lit, keywords)), lambda k: F.contains(F.lower(software), F.lower(k))), 0)


def seconds_between(a: Column, b: Column) -> Column:
    """From ``b`` to ``a``."""
    return F.unix_micros(a.cast("timestamp")).cast("double") / 1e6 - F.unix_micros(b.cast("timestamp")).cast("double") / 1e6


FIELDS = ("software", "make", "model", "modified", "original", "digitized", "gps", "has_gps", "altitude", "altitude_ref")


def rules(f: dict[str, Column], max_drift: int = MAX_DRIFT, max_gps: int = MAX_GPS_DRIFT, max_digitized: int = MAX_DIGITIZED_DRIFT, keywords: tuple[str, ...] = SOFTWARE) -> Column:
    """An array of (rule, weight), one for each rule that fires; ``f`` has a column for each of ``FIELDS``."""
    drift = seconds_between(f["modified"], f["original"])
    camera = f["make"].isNotNull() | f["model"].isNotNull()
    editor = editor_in(f["software"], keywords).isNotNull()
    rule = lambda when, name, weight: F.when(when, F.struct(F.lit(name).alias("rule"), F.lit(float(weight)).alias("weight")))
    fired = F.array(
        rule(editor, "editing_software", 35),
        rule(~camera, "no_camera", 10),
        rule(drift < 0, "modified_before_original", 50),
        rule(drift > max_drift, "modified_long_after", 30),
        rule(f["original"].isNull() & (f["modified"].isNotNull() | f["digitized"].isNotNull()), "no_original_date", 8),
        rule(F.abs(seconds_between(f["gps"], f["original"])) > max_gps, "gps_clock", 25),
        rule(F.abs(seconds_between(f["digitized"], f["original"])) > max_digitized, "digitized_apart", 20),
        rule(f["has_gps"] & ~camera, "gps_without_camera", 25),
        rule(~f["has_gps"] & camera, "camera_without_gps", 10),
        rule((f["altitude"] < 0) & (f["altitude_ref"] != 1), "altitude_sign", 30),
        rule(editor & f["make"].isNotNull() & f["model"].isNotNull() & (f["modified"] == f["original"]), "edited_yet_unmodified", 25),
    )
    return F.filter(fired, lambda x: x.isNotNull())


def rule_score(fired: Column) -> Column:
    return F.least(F.lit(100.0), F.aggregate(fired, F.lit(0.0), lambda a, f: a + f.weight))


def score_records(records: DataFrame, **options) -> DataFrame:
    """``records`` (with a column for each of ``FIELDS``) with ``indicators`` and ``score``."""
    fired = records.withColumn("indicators", rules({k: F.col(k) for k in FIELDS}, **options))
    return fired.withColumn("score", rule_score(F.col("indicators")))
