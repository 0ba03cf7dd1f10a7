"""Numbers out of messy text, coordinates and rounding."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def extract_int(c: Column) -> Column:
    """Whole number in a text value, NULL where the digits do not form one."""
    return F.regexp_replace(c, "[^0-9.]", "").try_cast("int")


def postal_code(c: Column) -> Column:
    """Six-digit code not starting with 0, found after dropping other characters."""
    digits = F.regexp_replace(F.trim(c), "[^0-9]", "")
    return F.when(digits.rlike("^[1-9][0-9]{5}$"), digits)


def suppressed_number(c: Column) -> Column:
    """Survey value as ``struct<value: double, suppressed: boolean>``.

    ``*`` marks a suppressed value; a number in parentheses is a low-sample
    value and stays a number.
    """
    t = F.trim(c)
    star = F.coalesce(t == "*", F.lit(False))
    number = F.regexp_replace(t, "[()]", "").try_cast("double")
    return F.struct(
        F.when(~star, number).alias("value"),
        star.alias("suppressed"),
    )


@dataclass(frozen=True)
class Box:
    """Latitude/longitude bounds a valid point lies in."""

    lat: tuple[float, float] = (6, 38)
    lon: tuple[float, float] = (68, 98)

    def holds(self, lat: Column, lon: Column) -> Column:
        return lat.between(*self.lat) & lon.between(*self.lon)


def coord_repair(lat: Column, lon: Column, box: Box = Box()) -> Column:
    """``struct<lat, lon, valid>``: points in the box stay, swapped pairs are
    swapped back, all else becomes NULL and not valid."""
    straight = F.coalesce(box.holds(lat, lon), F.lit(False))
    swapped = F.coalesce(box.holds(lon, lat), F.lit(False))
    return F.struct(
        F.when(straight, lat).when(swapped, lon).alias("lat"),
        F.when(straight, lon).when(swapped, lat).alias("lon"),
        (straight | swapped).alias("valid"),
    )


def stable_round(c: Column, digits: int) -> Column:
    """Half-up rounding that does not depend on the order floats were added in:
    noise in the last bits goes first, so ties stay ties."""
    return F.round(F.round(c.cast("double"), 8), digits)


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole as a double, NULL for an empty whole."""
    return F.try_divide(part.cast("double") * 100.0, whole.cast("double"))
