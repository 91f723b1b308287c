"""Settings of the analyzers: defaults, and a reader of ``section:`` / ``key: value`` files."""

from __future__ import annotations

import copy
import os

from veritile.operators.metadata import SOFTWARE

# The defaults.
DEFAULTS: dict[str, dict] = {
    "ela": {"enabled": True, "elaQualityLevels": [70, 80, 90], "errorThreshold": 28.0, "flaggedRegionFraction": 0.015},
    "metadata": {
        "enabled": True,
        "flagMissingExif": False,
        "suspiciousSoftwareKeywords": list(SOFTWARE),
        "maxTimestampDriftSeconds": 2_592_000,
        "maxGPSTimestampDriftSeconds": 300,
        "maxDigitizedDriftSeconds": 300,
    },
    "cloneDetection": {
        "enabled": True,
        "blockSize": 16,
        "blockStride": 8,
        "minimumBlockVariance": 20.0,
        "similarityThreshold": 6.0,
        "minimumBlockDistance": 24,
        "featureMatchingEnabled": True,
        "minimumMatchedKeypoints": 12,
        "ransacReprojectionThreshold": 3.0,
        "maximumKeypoints": 2000,
    },
    "doubleCompression": {"enabled": True, "acCoefficientRow": 1, "acCoefficientColumn": 1, "periodicityThreshold": 0.24},
    "tiling": {"enabled": True, "tilingThreshold": 4096, "tileSize": 1024, "tileOverlap": 64},
    "prnu": {"enabled": True, "blockSize": 64, "correlationThreshold": 0.5, "maximumWorkingDimension": 2048, "referenceFolder": None},
    "cfa": {"enabled": True, "blockSize": 64, "consistencyThreshold": 0.3},
    "jpegGhost": {"enabled": True, "minimumQuality": 50, "maximumQuality": 100, "qualityStep": 5, "blockSize": 32, "disagreementThreshold": 10},
    "thumbnail": {"enabled": True, "similarityThreshold": 0.7},
    "aiGenerated": {"enabled": True, "spectralSensitivity": 0.5, "prnuAbsenceThreshold": 0.5, "singleSignalWeight": 0.0},
    "noiseLevel": {"enabled": True, "blockSize": 64, "smoothThreshold": 0.5, "noisyThreshold": 2.0},
}
#: Another name of a key, which takes one number.
LEGACY = {("ela", "qualityLevel"): "elaQualityLevels"}
_BLANK = " \t\r"


class ConfigError(ValueError):
    pass


def default() -> dict[str, dict]:
    return copy.deepcopy(DEFAULTS)


def _items(value: str) -> list[str]:
    if not (value.startswith("[") and value.endswith("]")):
        raise ValueError
    inner = value[1:-1].strip(_BLANK)
    return [x.strip(_BLANK) for x in inner.split(",") if x] if inner else []


def _unquoted(x: str) -> str:
    return x[1:-1] if len(x) >= 2 and x[0] == x[-1] == '"' else x


def _typed(old: object, value: str) -> object:
    """``value`` as the kind of ``old``."""
    if isinstance(old, bool):
        return {"true": True, "yes": True, "false": False, "no": False}[value.lower()]
    if isinstance(old, int):
        return int(value)
    if isinstance(old, float):
        return float(value)
    if isinstance(old, list):
        numbers = bool(old) and isinstance(old[0], int)
        if numbers and not value.startswith("["):
            return [int(value)]
        return [int(x) if numbers else _unquoted(x) for x in _items(value)]
    path = _unquoted(value)
    return None if path in ("", "null", "~") else path


def parse(text: str) -> dict[str, dict]:
    out, section = default(), None
    for number, raw in enumerate(text.split("\n"), 1):
        line = raw.split("#", 1)[0]
        bare = line.strip(_BLANK)
        if not bare:
            continue
        if not line.startswith(" "):
            if not bare.endswith(":"):
                raise ConfigError(f'line {number} is no section: "{raw}"')
            section = bare[:-1]
            continue
        key, colon, value = (x.strip(_BLANK) for x in bare.partition(":"))
        if section is None or not colon or not key:
            raise ConfigError(f'line {number} can not be read: "{raw}"')
        name = LEGACY.get((section, key), key)
        if section not in out or name not in out[section]:
            raise ConfigError(f'unknown key "{key}" in section "{section}"')
        try:
            out[section][name] = [int(value)] if name != key else _typed(DEFAULTS[section][name], value)
        except (ValueError, KeyError):
            raise ConfigError(f'invalid value for "{key}": "{value}"') from None
    return out


def load(path: str) -> dict[str, dict]:
    """Of a file; the defaults where there is none."""
    if not os.path.exists(path):
        return default()
    with open(path, encoding="utf-8") as f:
        return parse(f.read())
