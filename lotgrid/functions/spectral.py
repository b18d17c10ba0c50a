"""Spectral indices over bands scaled to [0, 1]; normalised indices are mapped to [0, 1]."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-8

# Feature order of every training and scoring table.
FEATURES = ["R", "G", "B", "NIR", "NDVI", "SAVI", "Brightness", "BareSoilProxy", "EVI", "GNDVI"]

# Published ImageNet channel statistics.
IMAGENET_MEAN = (0.485, 0.456, 0.406)
IMAGENET_STD = (0.229, 0.224, 0.225)


def scale(band: Column) -> Column:
    return band / F.lit(255.0)


def scale_bands(df: DataFrame, bands) -> DataFrame:
    """Scale the named bands, leave every other column as it is."""
    return df.withColumns({b: scale(F.col(b)) for b in bands})


def to_unit(index: Column) -> Column:
    return (index + 1.0) / 2.0


def clamp(value: Column, low: float = -1.0, high: float = 1.0) -> Column:
    # Not greatest/least: those skip nulls and would turn a missing value into a bound.
    return F.when(value > high, F.lit(high)).when(value < low, F.lit(low)).otherwise(value)


def _difference_ratio(a: Column, b: Column) -> Column:
    return (a - b) / (a + b + EPS)


def ndvi(r: Column, n: Column) -> Column:
    return to_unit(_difference_ratio(n, r))


def gndvi(g: Column, n: Column) -> Column:
    return to_unit(_difference_ratio(n, g))


def savi(r: Column, n: Column, soil: float = 0.5) -> Column:
    return to_unit(clamp((1.0 + soil) * (n - r) / (n + r + soil)))


def evi(r: Column, b: Column, n: Column) -> Column:
    return to_unit(clamp(2.5 * (n - r) / (n + 6.0 * r - 7.5 * b + 1.0 + EPS)))


def brightness(r: Column, g: Column, b: Column, normalize: float | None = None) -> Column:
    mean = (r + g + b) / 3.0
    return mean / F.lit(float(normalize)) if normalize else mean


def bare_soil(r: Column, g: Column, b: Column, n: Column) -> Column:
    return (1.0 - ndvi(r, n)) * brightness(r, g, b)


def feature_columns(r: str = "r", g: str = "g", b: str = "b", n: str = "n") -> list[Column]:
    """The ten features, from raw 0-255 bands, in ``FEATURES`` order."""
    red, green, blue, nir = (scale(F.col(c)) for c in (r, g, b, n))
    values = [
        red,
        green,
        blue,
        nir,
        ndvi(red, nir),
        savi(red, nir),
        brightness(red, green, blue),
        bare_soil(red, green, blue, nir),
        evi(red, blue, nir),
        gndvi(green, nir),
    ]
    return [v.alias(name) for name, v in zip(FEATURES, values)]


def feature_stack(pixels: DataFrame, keep=()) -> DataFrame:
    """One projection with the kept columns and the ten features."""
    return pixels.select(*keep, *feature_columns())


def imagenet_normalise(r: Column, g: Column, b: Column) -> list[Column]:
    """(x - mean) / std per colour channel, inputs in [0, 1]."""
    return [(x - m) / s for x, m, s in zip((r, g, b), IMAGENET_MEAN, IMAGENET_STD)]
