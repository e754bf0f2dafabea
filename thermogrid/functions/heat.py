"""Surface temperature, heat classes and heat indices."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from thermogrid import constants as K
from thermogrid.functions.numeric import _c, classify_breaks, label_below, round_half_up

__all__ = [
    "qa_masked", "dn_to_lst", "heat_class_fixed", "heat_label", "heat_index_noaa", "heat_index_short",
    "radiation_to_watts", "wind_kmh", "is_daylight",
]


def qa_masked(qa) -> Column:
    """True for fill, cloud, cirrus or shadow pixels (bits 0-4)."""
    return _c(qa).bitwiseAND(F.lit(K.QA_CLOUD_MASK)) != 0


def dn_to_lst(dn, mul=None, add=None) -> Column:
    """Digital number to degrees Celsius; 0 is no data. Factors may come from scene metadata."""
    d = _c(dn)
    m = F.coalesce(_c(mul), F.lit(K.LST_SCALE_MUL)) if mul is not None else F.lit(K.LST_SCALE_MUL)
    a = F.coalesce(_c(add), F.lit(K.LST_SCALE_ADD)) if add is not None else F.lit(K.LST_SCALE_ADD)
    return F.when(d != 0, d * m + a - F.lit(K.KELVIN_OFFSET))


def heat_class_fixed(celsius) -> Column:
    return classify_breaks(celsius, K.HEAT_FIXED_BREAKS_C)


def heat_label(celsius) -> Column:
    pairs = list(zip(K.HEAT_LABELS[:-1], K.HEAT_FIXED_BREAKS_C))
    return label_below(celsius, pairs, K.HEAT_LABELS[-1])


def heat_index_noaa(celsius, humidity) -> Column:
    """Full NOAA index in Celsius: regression, two adjustments, simple form when mild or dry."""
    t = _c(celsius) * F.lit(9.0) / F.lit(5.0) + F.lit(32.0)
    h = F.when(_c(humidity) < 0, F.lit(0.0)).otherwise(_c(humidity))
    # Regression coefficients by (power of t, power of h) (fixed values)
    terms = [
        (-42.379, 0, 0), (2.04901523, 1, 0), (10.14333127, 0, 1), (-0.22475541, 1, 1),
        (-0.00683783, 2, 0), (-0.05481717, 0, 2), (0.00122874, 2, 1), (0.00085282, 1, 2), (-0.00000199, 2, 2),
    ]
    full = _polynomial(t, h, terms)
    dry = (h < 13) & t.between(80, 112)
    wet = (h > 85) & t.between(80, 87)
    adjusted = (
        F.when(dry, full - (F.lit(13.0) - h) / F.lit(4.0) * F.sqrt((F.lit(17.0) - F.abs(t - F.lit(95.0))) / F.lit(17.0)))
        .when(wet, full + (h - F.lit(85.0)) / F.lit(10.0) * ((F.lit(87.0) - t) / F.lit(5.0)))
        .otherwise(full)
    )
    simple = F.lit(0.5) * (t + F.lit(61.0) + (t - F.lit(68.0)) * F.lit(1.2) + h * F.lit(0.094))
    fahrenheit = F.when((t < 80) | (h < 40), simple).otherwise(adjusted)
    return (fahrenheit - F.lit(32.0)) * F.lit(5.0) / F.lit(9.0)


def heat_index_short(celsius, humidity) -> Column:
    """Short index in Celsius, one decimal; the temperature itself below 27 C or 40 %."""
    t, h = _c(celsius), _c(humidity)
    # Regression coefficients by (power of t, power of h) (fixed values)
    terms = [
        (-8.78469475556, 0, 0), (1.61139411, 1, 0), (2.33854883889, 0, 1), (-0.14611605, 1, 1),
        (-0.012308094, 2, 0), (-0.0164248277778, 0, 2), (0.002211732, 2, 1), (0.00072546, 1, 2), (-0.000003582, 2, 2),
    ]
    return F.when((t < 27) | (h < 40), t).when(h.isNotNull(), round_half_up(_polynomial(t, h, terms), 1))


def _polynomial(t: Column, h: Column, terms) -> Column:
    total = F.lit(terms[0][0])
    for weight, pt, ph in terms[1:]:
        term = F.lit(weight)
        for _ in range(pt):
            term = term * t
        for _ in range(ph):
            term = term * h
        total = total + term
    return total


def radiation_to_watts(megajoules_per_day) -> Column:
    return F.rint(_c(megajoules_per_day) * F.lit(1e6) / F.lit(86400.0) * F.lit(100.0)) / F.lit(100.0)


def wind_kmh(metres_per_second) -> Column:
    return _c(metres_per_second) * F.lit(3.6)


def is_daylight(at, sunrise, sunset) -> Column:
    return (_c(at) >= _c(sunrise)) & (_c(at) < _c(sunset))
