"""Colour to damage: HSV columns and the white-yellow-red ramp."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: colour thresholds and ramp weights
FRESH_SAT = 0.22      # below this the arc is white
FRESH_ESTIMATE = 0.12
WARM_SAT, WARM_VAL, WARM_TO, WARM_FROM = 0.40, 0.45, 70.0, 335.0
SAT_WEIGHT, SAT_FULL, HUE_WEIGHT, HUE_ZERO = 0.35, 0.85, 0.65, 60.0


def hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue in degrees, saturation and value of 0..255 channels."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    span = (top - low).cast("double")
    hue = (F.when(span == 0, F.lit(0.0))
           .when(r == top, (g - b) / F.nullif(span, F.lit(0.0)))
           .when(g == top, (b - r) / F.nullif(span, F.lit(0.0)) + 2.0)
           .otherwise((r - g) / F.nullif(span, F.lit(0.0)) + 4.0)) * 60.0
    return (F.when(hue < 0, hue + 360.0).otherwise(hue),
            F.when(top == 0, F.lit(0.0)).otherwise(span / F.nullif(top.cast("double"), F.lit(0.0))), top / 255.0)


def is_warm(hue: Column, sat: Column, val: Column) -> Column:
    return (sat > WARM_SAT) & (val > WARM_VAL) & ((hue <= WARM_TO) | (hue >= WARM_FROM))


def signed_hue(hue: Column) -> Column:
    return F.when(hue > 180.0, hue - 360.0).otherwise(hue)


def unit(x: Column) -> Column:
    """Clipped to 0..1; NULL stays NULL (greatest and least alone would skip it)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def ramp(hue: Column, sat: Column) -> Column:
    """Damage 0..1 from signed hue and saturation; white or unknown hue is zero."""
    warm = unit(SAT_WEIGHT * F.least(F.lit(1.0), sat / SAT_FULL) + HUE_WEIGHT * unit((HUE_ZERO - hue) / HUE_ZERO))
    return F.when(hue.isNull() | (sat < FRESH_SAT), F.lit(0.0)).otherwise(warm)
