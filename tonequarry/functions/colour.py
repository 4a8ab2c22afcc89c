"""Contrast of text on a backdrop, as column expressions: relative luminance, contrast ratios, blends of grey levels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The public sRGB transfer function and contrast ratio, and the steps of the search for a scrim.
WEIGHTS = 0.2126, 0.7152, 0.0722
READABLE = 4.5
SCRIM_STEP, SCRIM_MOST = 0.02, 0.88


def _of(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of c, which is worked out once however often f has it."""
    return F.transform(F.array(c), f)[0]


def _bounded(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c.cast("double")))


def to_luminance(grey: Column) -> Column:
    """The relative luminance of an sRGB grey level, both from 0 to 1."""
    return _of(_bounded(grey), lambda v: F.when(v <= 0.03928, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4))))


def to_grey(luminance: Column) -> Column:
    """The sRGB grey level that has a relative luminance."""
    return _of(_bounded(luminance), lambda v: F.when(v <= 0.0031308, v * 12.92).otherwise(1.055 * F.pow(v, F.lit(1 / 2.4)) - 0.055))


def luminance(rgb: Column) -> Column:
    """The relative luminance of a colour 0xRRGGBB."""
    parts = [to_luminance(F.shiftright(rgb, bits).bitwiseAND(F.lit(255)) / 255.0) for bits in (16, 8, 0)]
    return parts[0] * WEIGHTS[0] + parts[1] * WEIGHTS[1] + parts[2] * WEIGHTS[2]


def contrast(a: Column, b: Column) -> Column:
    """The ratio of two luminances, from 1 to 21."""
    return (F.greatest(a, b) + 0.05) / (F.least(a, b) + 0.05)


def blended(under: Column, over: Column, alpha: Column) -> Column:
    """A grey level laid over another."""
    return under * (1 - alpha) + over * alpha


def backdrop(theme: Column, image: Column, alpha: Column, scrim: Column) -> Column:
    """The luminance of an image laid over a theme's background, with the theme laid back over it by the scrim. theme and image are luminances."""
    return _of(to_grey(theme), lambda grey: to_luminance(blended(blended(grey, to_grey(image), alpha), grey, scrim)))


def best_contrast(darkest: Column, brightest: Column) -> Column:
    """What the better of black and white text reaches against all that lies between two luminances."""
    against = lambda c: F.least(contrast(F.lit(c), darkest), contrast(F.lit(c), brightest))
    return F.greatest(against(0.0), against(1.0))


def scrim(theme: Column, darkest: Column, brightest: Column, alpha: Column) -> Column:
    """The least scrim, by steps, at which some text reads on the backdrop; the most where none does; 0 without an image."""
    steps = F.array(*[F.lit(round(k * SCRIM_STEP, 2)) for k in range(round(SCRIM_MOST / SCRIM_STEP))])
    reads = F.filter(steps, lambda s: _of(F.struct(backdrop(theme, darkest, alpha, s).alias("a"), backdrop(theme, brightest, alpha, s).alias("b")), lambda x: best_contrast(x["a"], x["b"])) >= READABLE)
    return F.when(darkest.isNull() | brightest.isNull() | (alpha <= 0), F.lit(0.0)).otherwise(F.coalesce(F.get(reads, F.lit(0)), F.lit(SCRIM_MOST)))
