"""Colour mathematics as Column builders: sRGB, OKLab, CIELAB, colour difference, grading.

Colours are three columns; channels are 0-255 numbers and OKLab/Lab coordinates are doubles.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The sRGB transfer curve, the OKLab matrices and the D65 matrix and white point.
LINEAR_KNEE, ENCODED_KNEE = 0.04045, 0.0031308
TO_LMS = ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))
TO_OKLAB = ((0.2104542553, 0.793617785, -0.0040720468), (1.9779984951, -2.428592205, 0.4505937099), (0.0259040371, 0.7827717662, -0.808675766))
FROM_OKLAB = ((1.0, 0.3963377774, 0.2158037573), (1.0, -0.1055613458, -0.0638541728), (1.0, -0.0894841775, -1.291485548))
FROM_LMS = ((4.0767416621, -3.3077115913, 0.2309699292), (-1.2684380046, 2.6097574011, -0.3413193965), (-0.0041960863, -0.7034186147, 1.707614701))
TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.072175), (0.0193339, 0.119192, 0.9503041))
WHITE = (0.95047, 1.0, 1.08883)
LAB_EPSILON, LAB_KAPPA = 216 / 24389, 24389 / 27

#: Names of the OKLab columns of tables.  (Spark's names ignore case, and a and b are alpha and blue.)
LAB = ("ok_l", "ok_a", "ok_b")

Triple = tuple[Column, Column, Column]


def lit(x: float) -> Column:
    return F.lit(float(x))


def js_round(c: Column) -> Column:
    """Round half up, also below zero."""
    return F.floor(c + lit(0.5))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(lit(low), F.least(lit(high), c))


def _times(m: tuple[tuple[float, ...], ...], v: Triple) -> Triple:
    return tuple(lit(r[0]) * v[0] + lit(r[1]) * v[1] + lit(r[2]) * v[2] for r in m)


def srgb_to_linear(c: Column) -> Column:
    v = c.cast("double") / lit(255)
    return F.when(v <= LINEAR_KNEE, v / lit(12.92)).otherwise(F.pow((v + lit(0.055)) / lit(1.055), lit(2.4)))


def linear_to_srgb(c: Column) -> Column:
    v = F.when(c <= ENCODED_KNEE, c * lit(12.92)).otherwise(lit(1.055) * F.pow(F.greatest(c, lit(0)), lit(1 / 2.4)) - lit(0.055))
    return clamp(js_round(v * lit(255)).cast("double"), 0, 255).cast("int")


def linear_to_oklab(v: Triple) -> Triple:
    return _times(TO_OKLAB, tuple(F.cbrt(x) for x in _times(TO_LMS, v)))


def rgb_to_oklab(r: Column, g: Column, b: Column) -> Triple:
    return linear_to_oklab((srgb_to_linear(r), srgb_to_linear(g), srgb_to_linear(b)))


def oklab_to_linear(v: Triple) -> Triple:
    return _times(FROM_LMS, tuple(x * x * x for x in _times(FROM_OKLAB, v)))


def oklab_to_rgb(v: Triple) -> Triple:
    return tuple(linear_to_srgb(x) for x in oklab_to_linear(v))


def rgb_to_lab(r: Column, g: Column, b: Column) -> Triple:
    xyz = _times(TO_XYZ, (srgb_to_linear(r), srgb_to_linear(g), srgb_to_linear(b)))
    fx, fy, fz = (F.when(x / lit(w) > LAB_EPSILON, F.cbrt(x / lit(w))).otherwise((lit(LAB_KAPPA) * (x / lit(w)) + lit(16)) / lit(116)) for x, w in zip(xyz, WHITE, strict=True))
    return lit(116) * fy - lit(16), lit(500) * (fx - fy), lit(200) * (fy - fz)


def lab_from_centroid(v: Triple) -> Triple:
    """CIELAB of a mean colour in OKLab as it would be shown: through whole sRGB channels."""
    return rgb_to_lab(*oklab_to_rgb(v))


def rgb_to_hex(r: Column, g: Column, b: Column) -> Column:
    return F.concat(F.lit("#"), *[F.lpad(F.hex(c.cast("bigint")), 2, "0") for c in (r, g, b)])


def hex_to_rgb(h: Column) -> Triple:
    bare = F.regexp_replace(h, "^#", "")
    return tuple(F.conv(F.substring(bare, at, 2), 16, 10).cast("int") for at in (1, 3, 5))


def distance_sq(a: Triple, b: Triple, lightness: float = 1.0) -> Column:
    return lit(lightness) * (a[0] - b[0]) * (a[0] - b[0]) + (a[1] - b[1]) * (a[1] - b[1]) + (a[2] - b[2]) * (a[2] - b[2])


def distance(a: Triple, b: Triple, lightness: float = 1.0) -> Column:
    return F.sqrt(distance_sq(a, b, lightness * lightness))


def chroma(a: Column, b: Column) -> Column:
    return F.sqrt(a * a + b * b)


def hue_degrees(a: Column, b: Column) -> Column:
    h = F.degrees(F.atan2(b, a))
    return F.when(h < 0, h + lit(360)).otherwise(h)


def chroma_scale(saturation: float) -> float:
    """Factor for a saturation in -1..1: 0 is grey at -1, 2.5 at 1."""
    s = max(-1.0, min(1.0, saturation))
    return 1 + s if s < 0 else 1 + 1.5 * s


def lightness_shift(lightness: float) -> float:
    s = max(-1.0, min(1.0, lightness))
    return math.copysign(abs(s) ** 1.4 * 0.3, s) if s else 0.0


def adjust(r: Column, g: Column, b: Column, hue: float = 0.0, saturation: float = 0.0, lightness: float = 0.0) -> Triple:
    """Rotate hue, scale chroma, shift lightness and clamp to the gamut; nothing to do returns the input."""
    if hue == saturation == lightness == 0:
        return r, g, b
    light, a, bb = rgb_to_oklab(r, g, b)
    cos, sin, scale = math.cos(math.radians(hue)), math.sin(math.radians(hue)), chroma_scale(saturation)
    turned = clamp(light + lit(lightness_shift(lightness)), 0, 1), (a * lit(cos) - bb * lit(sin)) * lit(scale), (a * lit(sin) + bb * lit(cos)) * lit(scale)
    return tuple(linear_to_srgb(clamp(x, 0, 1)) for x in oklab_to_linear(turned))


def tint(c: Column, share: float = 0.16) -> Column:
    """A channel mixed with white."""
    return js_round(lit(255) + (c - lit(255)) * lit(share)).cast("int")


def _hue(a: Column, b: Column, c: Column) -> Column:
    h = F.degrees(F.atan2(b, a))
    return F.when(c == 0, lit(0)).when(h < 0, h + lit(360)).otherwise(h)


def delta_e_2000(one: Triple, two: Triple) -> Column:
    """CIEDE2000 with unit weights (Sharma, Wu and Dalal)."""
    (l1, a1, b1), (l2, a2, b2) = one, two

    def seventh(c: Column) -> Column:
        return F.sqrt(F.pow(c, lit(7)) / (F.pow(c, lit(7)) + lit(25.0**7)))

    g = lit(0.5) * (lit(1) - seventh((chroma(a1, b1) + chroma(a2, b2)) / lit(2)))
    a1, a2 = (lit(1) + g) * a1, (lit(1) + g) * a2
    c1, c2 = chroma(a1, b1), chroma(a2, b2)
    h1, h2 = _hue(a1, b1, c1), _hue(a2, b2, c2)
    grey, turn = c1 * c2 == 0, h2 - h1
    dh = F.when(grey, lit(0)).when(F.abs(turn) <= 180, turn).when(turn > 180, turn - lit(360)).otherwise(turn + lit(360))
    both = h1 + h2
    h = F.when(grey, both).when(F.abs(turn) <= 180, both / lit(2)).when(both < 360, (both + lit(360)) / lit(2)).otherwise((both - lit(360)) / lit(2))
    big_h = lit(2) * F.sqrt(c1 * c2) * F.sin(F.radians(dh / lit(2)))
    light, c = (l1 + l2) / lit(2), (c1 + c2) / lit(2)

    def cosine(weight: float, times: float, shift: float) -> Column:
        return lit(weight) * F.cos(F.radians(lit(times) * h + lit(shift)))

    t = lit(1) - cosine(0.17, 1, -30) + cosine(0.24, 2, 0) + cosine(0.32, 3, 6) - cosine(0.2, 4, -63)
    theta = lit(30) * F.exp(-F.pow((h - lit(275)) / lit(25), lit(2)))
    off = F.pow(light - lit(50), lit(2))
    d_l = (l2 - l1) / (lit(1) + lit(0.015) * off / F.sqrt(lit(20) + off))
    d_c = (c2 - c1) / (lit(1) + lit(0.045) * c)
    d_h = big_h / (lit(1) + lit(0.015) * c * t)
    turn_term = -F.sin(F.radians(lit(2) * theta)) * lit(2) * seventh(c)
    return F.sqrt(F.greatest(lit(0), d_l * d_l + d_c * d_c + d_h * d_h + turn_term * d_c * d_h))
