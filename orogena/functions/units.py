"""Map units, grid cells and the readings of tag values, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the data model: bits of a grid cell, metres in a foot and in a degree of latitude.
CELL_BITS, METRES_A_FOOT, METRES_A_DEGREE = 11, 0.3048, 111_320.0


def map_units(degrees: Column) -> Column:
    """Degrees in units of 360 / 2^24, halves up, held to half a turn; NaN is the east edge."""
    units = F.floor(degrees * 16777216 / 360 + 0.5)
    edge = 1 << 23
    return F.when(degrees.isNull(), None).when(F.isnan(degrees), edge).when(degrees > 180, edge).when(degrees < -180, -edge).otherwise(units).cast("int")


def degrees(units: Column) -> Column:
    return units * 360.0 / 16777216


def cell(units: Column) -> Column:
    """The grid cell of 2048 units that a coordinate lies in."""
    return F.shiftright(units, CELL_BITS)


def on_lattice(units: Column, shift: int) -> Column:
    """A coordinate at the nearest multiple of 2^shift, halves up."""
    return F.shiftleft(F.shiftright(units + (1 << shift >> 1), shift), shift)


def leading_number(value: Column) -> Column:
    """The first run of digits, points and signs of a value as a number; null if it isn't one."""
    return F.regexp_extract(value, r"-?[0-9.]+", 0).try_cast("double")


def metres(value: Column) -> Column:
    """A height: the first token, with a decimal comma or point."""
    return F.replace(F.element_at(F.split(F.trim(value), " "), 1), F.lit(","), F.lit(".")).try_cast("double")


#: How feet and metres are written behind a height, and the heights that there are.
FEET, METRES, HEIGHTS = ("feet", "ft", "'", "\u2032"), ("metres", "meters", "m"), (-500, 9000)


def _bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, wherever it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def elevation(value: Column, in_feet: bool = False) -> Column:
    """Metres above sea of an ``ele`` value, or of an ``ele:ft`` value, which is in feet whatever it says.

    Blanks are left out and units read from the end.  Commas part thousands where there is a point too, or where each has three
    digits behind it; else a comma is the decimal point.  A number that is too high for metres and not for feet is in feet; what
    lies outside HEIGHTS is null.
    """
    feet_at_end, metres_at_end = (f"({'|'.join(words)})$" for words in (FEET, METRES))

    def of_text(text: Column) -> Column:
        says_feet = text.rlike(feet_at_end)
        number = F.when(says_feet, F.regexp_replace(text, feet_at_end, "")).otherwise(F.regexp_replace(text, metres_at_end, ""))
        return _bound(number, lambda n: _bound(of_number(n), lambda x: of_height(x, F.lit(in_feet) | says_feet)))

    def of_number(number: Column) -> Column:
        grouped = number.contains(".") | number.rlike(r"^(\d{1,3}|-.{0,2})(,\d{3})+$")
        plain = F.replace(number, F.lit(","), F.when(grouped, F.lit("")).otherwise(F.lit(".")))
        return F.when(number.rlike(r"^[+-]?[\d,]*\.?\d*(e[+-]?\d+)?$"), plain.try_cast("double"))

    def of_height(x: Column, told: Column) -> Column:
        feet = told | ((x > HEIGHTS[1]) & (x * METRES_A_FOOT <= HEIGHTS[1]))
        return _bound(F.when(feet, x * METRES_A_FOOT).otherwise(x), lambda m: F.when(m.between(*HEIGHTS), m))

    return _bound(F.lower(F.regexp_replace(value, "[\\s ]", "")), of_text)


def drawn_level(layer: Column, bridge: Column, tunnel: Column) -> Column:
    """Layer in fours, a bridge two above, a tunnel one above its layer; a passage through a building is no tunnel."""
    n = F.greatest(F.lit(-1000), F.least(F.lit(1000), F.coalesce(layer.try_cast("int"), F.lit(0))))
    under = tunnel.isNotNull() & ~tunnel.isin("no", "building_passage")
    return n * 4 + F.when(bridge.isNotNull() & (bridge != "no"), 2).otherwise(0) + F.when(under, 1).otherwise(0)


def tile_name(lat: Column, lon: Column) -> Column:
    """N44E033 of the corner (44, 33)."""
    return F.concat(F.when(lat < 0, "S").otherwise("N"), F.lpad(F.abs(lat).cast("string"), 2, "0"), F.when(lon < 0, "W").otherwise("E"), F.lpad(F.abs(lon).cast("string"), 3, "0"))


def tile_corner(name: Column) -> Column:
    """The corner (lat, lon) of a tile name; null for any other text."""
    upper = F.upper(name)
    ok = upper.rlike(r"^[NS]\d{2}[EW]\d{3}$")
    part = lambda at, n: F.substring(upper, at, n).cast("int")
    sign = lambda at, minus: F.when(F.substring(upper, at, 1) == minus, -1).otherwise(1)
    return F.when(ok, F.struct((sign(1, "S") * part(2, 2)).alias("lat"), (sign(4, "W") * part(5, 3)).alias("lon")))


def humanised(key: Column) -> Column:
    """picnic_site as Picnic site."""
    text = F.replace(key, F.lit("_"), F.lit(" "))
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1_000_000))


def plain_name(html: Column) -> Column:
    """A text without tags, with the common entities decoded and blanks collapsed."""
    out = F.regexp_replace(html, "<[^>]*>", "")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def type_code(code: Column) -> Column:
    """A drawing code in hex, of two digits below 256 and else of four at least."""
    digits = F.lower(F.hex(code))
    return F.concat(F.lit("0x"), F.when(code < 256, F.lpad(digits, 2, "0")).otherwise(F.lpad(digits, 4, "0")))
