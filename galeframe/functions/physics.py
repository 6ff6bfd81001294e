"""Physical quantities as column expressions. Units are stated per function."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Gas constants in J/(kg K) and J/(mol K), molar mass of dry air in
# kg/mol, standard lapse rate in K/m, gravity in m/s2, vapour to dry air mass ratio.
R_DRY = 287.05
R_VAPOUR = 461.5
R_MOLAR = 8.31451
MOLAR_MASS_AIR = 0.028949
LAPSE_RATE = 0.00649
GRAVITY = 9.81
CELSIUS_ZERO = 273.15
EPSILON = 0.622


def _c(value: Column | str | float) -> Column:
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value)


def at_least(value: Column | str, low: float) -> Column:
    """``value``, raised to ``low``; a missing value stays missing (``greatest`` would skip it)."""
    value = _c(value)
    return F.when(value < low, F.lit(float(low))).otherwise(value)


def wind_speed(u: Column | str, v: Column | str) -> Column:
    u, v = _c(u), _c(v)
    return F.sqrt(u * u + v * v)


def wind_components(speed: Column | str, direction: Column | str) -> tuple[Column, Column]:
    """(u, v) of a wind blowing FROM ``direction`` degrees."""
    speed, angle = _c(speed), F.radians(_c(direction))
    return -speed * F.sin(angle), -speed * F.cos(angle)


def direction_encoding(u: Column | str, v: Column | str) -> tuple[Column, Column]:
    """(sin, cos) of the FROM-direction of a (u, v) wind; calm air is floored at 1e-6."""
    speed = at_least(wind_speed(u, v), 1e-6)
    return -_c(u) / speed, -_c(v) / speed


def angle_encoding(degrees: Column | str) -> tuple[Column, Column]:
    angle = F.radians(_c(degrees))
    return F.sin(angle), F.cos(angle)


def cyclical(value: Column | str, period: float) -> tuple[Column, Column]:
    turn = _c(value) * (2.0 * 3.141592653589793 / period)
    return F.sin(turn), F.cos(turn)


def degrees_from_sin_cos(sin: Column | str, cos: Column | str) -> Column:
    return F.pmod(F.degrees(F.atan2(_c(sin), _c(cos))), F.lit(360.0))


def vapour_pressure_huang(celsius: Column | str) -> Column:
    t = _c(celsius)
    water = F.exp(34.494 - 4924.99 / (t + 237.1)) / F.pow(t + 105.0, F.lit(1.57))
    ice = F.exp(43.494 - 6545.8 / (t + 278.0)) / F.pow(t + 868.0, F.lit(2.0))
    return F.when(t > 0, water).otherwise(ice)


def vapour_pressure_magnus(celsius: Column | str) -> Column:
    t = _c(celsius)
    water = 610.94 * F.exp(17.625 * t / (t + 243.04))
    ice = 611.21 * F.exp(22.587 * t / (t + 273.86))
    return F.when(t > 0, water).otherwise(ice)


VAPOUR_PRESSURE: dict[str, Callable[[Column | str], Column]] = {
    "huang": vapour_pressure_huang,
    "improved_magnus": vapour_pressure_magnus,
}


def saturation_vapour_pressure(celsius: Column | str, model: str = "improved_magnus") -> Column:
    """Saturation vapour pressure in Pa; ``model`` picks from the registry."""
    if model not in VAPOUR_PRESSURE:
        raise ValueError(f"unknown vapour pressure model {model!r}")
    return VAPOUR_PRESSURE[model](celsius)


def relative_humidity(
    specific_humidity: Column | str,
    pressure_pa: Column | str,
    kelvin: Column | str,
    model: str = "improved_magnus",
) -> Column:
    """Relative humidity in [0, 1]: mixing ratio over saturation mixing ratio."""
    q, p = _c(specific_humidity), _c(pressure_pa)
    es = saturation_vapour_pressure(_c(kelvin) - CELSIUS_ZERO, model)
    return (q / (1.0 - q)) / (EPSILON * es / (p - es))


def air_density(
    kelvin: Column | str, pressure_pa: Column | str, humidity: Column | str, vapour_pa: Column | str
) -> Column:
    """Density of moist air in kg/m3 from K, Pa, relative humidity in [0, 1] and Pa."""
    t, partial = _c(kelvin), _c(humidity) * _c(vapour_pa)
    return (_c(pressure_pa) - partial) / (R_DRY * t) + partial / (R_VAPOUR * t)


def density_at_height(density: Column | str, celsius: Column | str, height: Column | str | float) -> Column:
    """Density at ``height`` metres from density and temperature measured at 2 m."""
    ratio = 1.0 - LAPSE_RATE * (_c(height) - 2.0) / (_c(celsius) + CELSIUS_ZERO)
    exponent = MOLAR_MASS_AIR * GRAVITY / (LAPSE_RATE * R_MOLAR) - 1.0
    return _c(density) * F.pow(ratio, F.lit(exponent))


def cap_area(radius: Column | str, y: Column | str) -> Column:
    """Area of the part of a circle of ``radius`` around 0 that lies above height ``y``."""
    r, y = _c(radius), _c(y)
    inside = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), y / r))
    segment = r * r * F.acos(inside) - y * F.sqrt(F.greatest(r * r - y * y, F.lit(0.0)))
    return F.when(y <= -r, F.pi() * r * r).when(y >= r, F.lit(0.0)).otherwise(segment)


def power_law_speed(
    speed: Column | str,
    reference_speed: Column | str,
    source_height: float,
    hub_height: Column | str | float,
    reference_height: float = 127.0,
) -> Column:
    """Wind speed at hub height; the shear exponent comes from a second height."""
    if source_height == reference_height:
        return _c(speed)
    low, high = at_least(speed, 0.01), at_least(reference_speed, 0.01)
    shear = F.ln(high / low) / F.ln(F.lit(reference_height / source_height))
    return _c(speed) * F.pow(_c(hub_height) / source_height, clip(shear, 0.0, 1.0))


def level_height(top: Column | str, bottom: Column | str, rule: str = "half_even") -> Column:
    """Middle of a model level in whole metres (``half_even`` or ``half_up``)."""
    middle = (_c(top) + _c(bottom)) / 2.0
    return (F.bround(middle) if rule == "half_even" else F.round(middle)).cast("int")


def valid_time(start: Column | str, lead_hours: Column | str) -> Column:
    """Run start plus a lead in (possibly fractional) hours."""
    seconds = F.round(_c(lead_hours) * 3600.0).cast("long")
    return F.timestamp_seconds(F.unix_timestamp(_c(start)) + seconds)


def global_irradiance(direct: Column | str | None, diffuse: Column | str | None) -> Column:
    """``max(direct + diffuse, 0)``; a part without a column (None) counts as 0, a missing value stays missing."""
    parts = [F.lit(0.0) if part is None else _c(part) for part in (direct, diffuse)]
    return at_least(parts[0] + parts[1], 0.0)


def non_negative(value: Column | str) -> Column:
    return at_least(value, 0.0)


def clip(value: Column | str, low: float, high: float) -> Column:
    """``value`` within the bounds; a missing value stays missing."""
    value = at_least(value, low)
    return F.when(value > high, F.lit(float(high))).otherwise(value)


def age_years(commissioned: Column | str, reference: Column | str, whole: bool = True) -> Column:
    """Age at an explicit reference date; a missing date counts as age 0."""
    days = F.datediff(_c(reference), _c(commissioned))
    years = F.floor(days / 365.0).cast("double") if whole else days / 365.25
    return F.coalesce(years, F.lit(0.0))


def scaled_power(power: Column | str, capacity: Column | str) -> Column:
    return clip(F.try_divide(_c(power), _c(capacity)), 0.0, 1.0)
