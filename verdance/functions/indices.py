"""Vegetation indices, scaling and nodata rules as column expressions.

Comparisons with NaN are false in the definitions that these follow but true in Spark, so every mask excludes NaN itself.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Reflectance of one in digital numbers; blue below these limits marks a dark scene (fixed values).
DN_SCALE = 10_000.0
DARK_BLUE = {"S2": 100.0, "S3": 0.01}


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def clean(x: Column) -> Column:
    """NaN and infinities to null."""
    return F.when(finite(x), x)


def positive(x: Column) -> Column:
    return F.coalesce(finite(x) & (x > 0), F.lit(False))


def ndvi(red: Column, nir: Column) -> Column:
    """(nir - red) / (nir + red) where both are positive, else null."""
    return F.when(positive(red) & positive(nir), (nir - red) / (nir + red))


def gcc(blue: Column, green: Column, red: Column) -> Column:
    """green / (blue + green + red) where all are finite and not negative and the total is positive, else null."""
    valid = finite(blue) & finite(green) & finite(red) & (F.least(blue, green, red) >= 0) & (blue + green + red > 0)
    return F.when(F.coalesce(valid, F.lit(False)), green / (blue + green + red))


def gcc_raster(blue: Column, green: Column, red: Column) -> Column:
    """As a raster holds it: 0 where the total isn't positive."""
    total = blue + green + red
    return F.when(positive(total), green / total).otherwise(0.0)


def gcc_rgr(green: Column, red: Column) -> Column:
    """The variant of the index-first mode, whose total is twice red plus green; kept for parity beside the canonical index."""
    total = red + green + red
    return F.when(positive(total), green / total).otherwise(0.0)


def gcc_strict(blue: Column, green: Column, red: Column) -> Column:
    """For spatial scores: null unless every band is finite and the total positive; single bands may be negative."""
    total = blue + green + red
    return F.when(finite(blue) & finite(green) & finite(red) & (total > 0), green / total)


def gcc_of_text(blue: Column, green: Column, red: Column) -> Column:
    """From stored site means that may not be numbers."""
    b, g, r = (x.try_cast("double") for x in (blue, green, red))
    return F.when(positive(b + g + r), g / (b + g + r))


def reflectance(dn: Column) -> Column:
    return dn / DN_SCALE


def nodata_to_null(x: Column, nodata: float = 0.0) -> Column:
    return F.when(finite(x) & (x != nodata), x)


def null_to_nodata(x: Column, nodata: float = 0.0) -> Column:
    return F.coalesce(clean(x), F.lit(nodata))


def stretch(x: Column, low: Column, high: Column) -> Column:
    """Linear to 0..255, clamped; null where the range is empty."""
    return F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.try_divide(x - low, high - low) * 255.0))


def alpha(red: Column, green: Column, blue: Column) -> Column:
    """0 where all of a pixel's colours are 0, else 255."""
    return F.when((red == 0) & (green == 0) & (blue == 0), 0).otherwise(255)


def truth_value(primary: Column, fallback: Column, outlier: Column) -> Column:
    """A ground-camera value from summary text: null when flagged, blank, not a number, or at or below -9998."""
    chosen = F.when(F.length(F.trim(F.coalesce(primary, F.lit("")))) > 0, primary).otherwise(fallback)
    value = F.trim(chosen).try_cast("double")
    flagged = F.coalesce(F.trim(outlier).try_cast("double") == 1.0, F.lit(False))
    return F.when(~flagged & finite(value) & (value > -9998), value)


def enough_bands(bands: Column, least: int = 4) -> Column:
    """Whether an array of bands holds `least` known ones; a null array does not."""
    return F.coalesce(F.size(F.filter(bands, lambda b: b.isNotNull())) >= least, F.lit(False))


def gcc_of_bands(bands: Column) -> Column:
    """Greenness of a raster pixel's bands: by the index of blue, green and red where there are four, the first band where there are fewer."""
    b, g, r = (F.get(bands, F.lit(k)) for k in range(3))
    return F.when(F.size(bands) >= 4, gcc_strict(b, g, r)).otherwise(clean(F.get(bands, F.lit(0))))


def escaped(text: Column) -> Column:
    """Text for HTML: the five characters of markup as references."""
    for plain, reference in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(plain), F.lit(reference))
    return text
