"""Pixel arithmetic: reflectance, clear-sky mask, normalised differences, change."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from basinlens import constants as C


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def reflectance(dn) -> Column:
    return _col(dn) * F.lit(C.REFLECTANCE_SCALE) + F.lit(C.REFLECTANCE_OFFSET)


def is_clear(qa) -> Column:
    """Neither the cloud nor the cloud-shadow bit is set."""
    mask = (1 << C.QA_CLOUD_BIT) | (1 << C.QA_SHADOW_BIT)
    return _col(qa).cast("int").bitwiseAND(F.lit(mask)) == 0


def normalised_difference(a, b) -> Column:
    a, b = _col(a), _col(b)
    return F.try_divide(a - b, a + b)


def spectral_indices(green="b3", red="b4", nir="b5", swir="b6") -> dict[str, Column]:
    """NDVI, MNDWI and NDMI from raw digital numbers."""
    g, r, n, s = (reflectance(c) for c in (green, red, nir, swir))
    return {
        "ndvi": normalised_difference(n, r),
        "mndwi": normalised_difference(g, s),
        "ndmi": normalised_difference(n, s),
    }


def pct_change(baseline, latest) -> Column:
    """Percentage change; null when the baseline is zero or missing."""
    baseline, latest = _col(baseline), _col(latest)
    return F.try_divide(latest - baseline, baseline) * F.lit(100.0)
