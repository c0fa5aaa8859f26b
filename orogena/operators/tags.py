"""Predicates and readings of tags, and rules of tag terms as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from orogena.functions.units import elevation, leading_number

# Fixed values of the data model: tag values in the order that the classes are tried.
FENCES = ["fence", "wall", "city_wall", "retaining_wall", "hedge", "guard_rail"]
RAVINES = ["valley", "gully", "ravine"]
ROADS = [
    "motorway", "trunk", "primary", "secondary", "tertiary", "unclassified", "residential", "service", "track", "path", "footway", "cycleway",
    "bridleway", "living_street", "road", "steps", "motorway_link", "trunk_link", "primary_link", "secondary_link", "tertiary_link", "pedestrian", "construction",
]
POINT_KEYS = ["natural", "amenity", "tourism", "historic", "shop", "leisure", "man_made", "waterway", "mountain_pass", "information", "office", "craft", "aerialway", "place"]
DESCRIPTION_KEYS = ["description:ru", "description", "description:en"]


def closed(refs: Column) -> Column:
    """Whether a way is a ring: four references at least, the first one also the last."""
    return (F.size(refs) >= 4) & (F.get(refs, F.lit(0)) == F.element_at(refs, -1))


def water(tags: Column) -> Column:
    t = lambda k, *v: F.coalesce(tags[k].isin(*v), F.lit(False))
    return t("natural", "water") | t("landuse", "reservoir", "basin") | t("waterway", "riverbank", "dock")


def obstacle(tags: Column) -> Column:
    """The kind of obstacle that a way's tags make it, the first class that holds; null if none does."""
    barrier, natural, building, waterway = tags["barrier"], tags["natural"], tags["building"], tags["waterway"]
    return (
        F.when(barrier.isin(FENCES), "fence")
        .when(barrier.isNotNull(), "barrier")
        .when(natural == "cliff", "cliff")
        .when(building.isNotNull() & (building != "no"), "building")
        .when(natural.isin(RAVINES), "ravine")
        .when(waterway.isNotNull() | water(tags), "water")
        .when((tags["embankment"] == "yes") | (tags["man_made"] == "embankment"), "embankment")
    )


def routable(tags: Column) -> Column:
    """Whether a way is a road; false without tags."""
    return F.coalesce(tags["highway"].isin(ROADS), F.lit(False))


def contour(tags: Column) -> Column:
    return F.coalesce(tags["contour"] == "elevation", F.lit(False))


def summit_height(tags: Column) -> Column:
    """The height of a peak or volcano, from ele or, where that can't be read, from ele:ft in feet; null for others."""
    feet = elevation(tags["ele:ft"], in_feet=True)
    return F.when(tags["natural"].isin("peak", "volcano"), F.coalesce(elevation(tags["ele"]), feet))


def described_point(tags: Column) -> Column:
    """Whether tags have a key of points worth carrying and a key of descriptions, whatever their values."""
    has = lambda keys: F.arrays_overlap(F.map_keys(tags), F.array(*map(F.lit, keys)))
    return F.coalesce(has(POINT_KEYS) & has(DESCRIPTION_KEYS), F.lit(False))


def meaning(tags: Column, keys: list[str]) -> Column:
    """key=value of the first key, in the order given, that has a value; null if none has."""
    return F.coalesce(*[F.when(tags[k] != "", F.concat(F.lit(k + "="), tags[k])) for k in keys])


def excluded(tags: Column, exclusions: list[str]) -> Column:
    """Whether any k=v, or any value for k=*, of the list holds."""
    out = F.lit(False)
    for k, _, v in (x.partition("=") for x in exclusions):
        out = out | (tags[k].isNotNull() if v == "*" else F.coalesce(tags[k] == v, F.lit(False)))
    return out


def worth_carrying(description: Column, name: Column) -> Column:
    """Whether a description says more than the name: no single short word, and not the name give or take six characters."""
    d, n = F.lower(F.trim(description)), F.lower(F.trim(F.coalesce(name, F.lit(""))))
    short = ~d.contains(" ") & (F.length(d) < 12)
    like = (n != "") & ((d == n) | ((F.contains(d, n) | F.contains(n, d)) & (F.abs(F.length(d) - F.length(n)) <= 6)))
    return F.coalesce((d != "") & ~short & ~like, F.lit(False))


def repeats_name(description: Column, name: Column) -> Column:
    """Whether a name's words stand one after another in a description."""
    words = lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    d, n = words(description), words(name)
    glue = lambda a: F.concat(F.lit(" "), F.array_join(a, " "), F.lit(" "))
    return F.coalesce((F.size(n) > 0) & F.contains(glue(d), glue(n)), F.lit(False))


@dataclass(frozen=True)
class Term:
    """key, one of = != < <= > >= or "has" / "lacks", value."""

    key: str
    op: str
    value: str = ""

    def holds(self, tags: Column) -> Column:
        """True, false, or null where the term can't be told: an unknown operator, or a number compared with no number."""
        has = tags[self.key].isNotNull()
        if self.op in ("has", "lacks"):
            return has if self.op == "has" else ~has
        if self.op in ("=", "!="):
            same = F.coalesce(tags[self.key] == self.value, F.lit(False))
            return same if self.op == "=" else ~same
        if self.op in ("<", "<=", ">", ">="):
            x, y = leading_number(tags[self.key]), float(self.value)
            order = {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[self.op]
            return F.when(~has, False).otherwise(order)
        return F.lit(None).cast("boolean")


def all_hold(terms: list[Term], tags: Column) -> Column:
    """Terms in order: the first false one decides, and so does the first that can't be told. Not SQL's AND."""
    out = F.lit(True)
    for term in reversed(terms):
        told = term.holds(tags)
        out = F.when(told.isNull(), F.lit(None).cast("boolean")).when(~told, False).otherwise(out)
    return out


@dataclass(frozen=True)
class Rule:
    """Terms and what an element that meets them becomes; ``onward`` lets later rules add to it."""

    terms: tuple[Term, ...]
    code: int
    resolution: int = 24
    onward: bool = False


def first_match(rules: list[Rule], tags: Column) -> Column:
    """The codes that an element gets, in order: those of onward rules up to the first rule that ends the search."""
    hit = [F.coalesce(all_hold([*r.terms], tags), F.lit(False)) for r in rules]
    ends = [h for h, r in zip(hit, rules) if not r.onward]
    stop = F.coalesce(*[F.when(h, i) for i, (h, r) in enumerate(zip(hit, rules)) if not r.onward], F.lit(len(rules))) if ends else F.lit(len(rules))
    got = F.array(*[F.when(h & (F.lit(i) <= stop), r.code) for i, (h, r) in enumerate(zip(hit, rules))])
    return F.filter(got, lambda x: x.isNotNull())
