"""Composed building texts, search terms, tap scores, public places and projected coordinates as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmill.functions import text as T

# Everyday words for styles and types of buildings (style words, type words, gloss).
GLOSSES = [
    (["italianate", "neo-grec", "greek revival", "renaissance revival", "queen anne", "second empire", "romanesque"], ["row house", "town house", "tenement", "flats", "two-family"], "brownstone prewar rowhouse walk-up classic New York townhouse"),
    (["art deco", "deco"], [], "deco jazz-age streamline"),
    (["modern", "international", "brutalist", "minimalist"], [], "modernist contemporary"),
    ([], ["store and loft", "loft", "warehouse", "factory", "manufacturing"], "loft warehouse industrial cast-iron"),
    ([], ["church", "synagogue", "chapel", "cathedral", "temple", "mosque"], "place of worship religious sacred"),
    ([], ["apartment", "flats", "tenement", "model tenement"], "apartment residential"),
    ([], ["school", "library", "courthouse", "fire station", "post office", "hospital", "police"], "civic institutional public"),
]
# Substrings that mark public places.
PUBLIC = (
    "park pier green plaza square promenade waterfront beach bridge tunnel highway river island pool playground garden fence gate wall pavilion "
    "reservoir tract lot vacant undeveloped"
).split()


def clean(text: Column) -> Column:
    return F.coalesce(T.known(F.trim(text), "buildings"), F.lit(""))


def filled(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def gloss(style: Column, kind: Column) -> Column:
    told = []
    for styles, kinds, said in GLOSSES:
        hit = F.lit(False)
        for column, parts in ((style, styles), (kind, kinds)):
            for part in parts:
                hit = hit | F.contains(F.lower(column), F.lit(part))
        told.append(F.when(hit, said))
    return F.concat_ws(" ", *told)


def building_text(c: dict[str, Column]) -> Column:
    """The prose that a building's vector is made from: what and where it is, then who, when, of what, then its story."""
    name = F.when(clean(c["building_name"]) != "", clean(c["building_name"])).otherwise(clean(c["wiki_name"]))
    style, kind = clean(c["style"]), F.when(clean(c["building_type"]) != "", clean(c["building_type"])).otherwise(clean(c["use_original"]))
    borough, district = clean(c["borough_name"]), clean(c["historic_district"])
    what = F.concat_ws(" ", filled(style), filled(kind))
    place = F.when(borough != "", F.concat(F.lit(" in "), borough, F.when(district != "", F.concat(F.lit("'s "), district)).otherwise(""))).when(district != "", F.concat(F.lit(" in the "), district)).otherwise("")
    lead = F.concat_ws(", ", filled(name), F.when(what != "", F.concat(F.when(F.lower(what).rlike("^[aeiou]"), "an ").otherwise("a "), what, place)))
    year = T.number(c["year_built"], "int")
    said = lambda before, key, after="": F.when(clean(c[key]) != "", F.concat(F.lit(before), clean(c[key]), F.lit(after)))
    when = F.when(year != 0, F.concat(F.lit("built "), year.cast("string"))).otherwise(said("from the ", "era", " era"))
    parts = [filled(lead), said("with ", "style_secondary", " elements"), said("designed by ", "architect"), when, said("built of ", "mat_primary"), said("also known as ", "colloquial"), filled(gloss(style, kind)), said("", "primary_aesthetic", " character"), said("", "secondary_aesthetic", " character"), filled(clean(c["storytelling"]))]
    return F.concat_ws(". ", *parts)


def search_terms(address: Column, name: Column) -> Column:
    """What to look a building up by: address, number and street, name, name without its last type word."""
    short = F.regexp_replace(name, r"(?i)\s+(Building|House|Mansion|Church|Hotel|Company|No\.\s*\d+)$", "")
    split = F.concat_ws(" ", F.regexp_extract(address, r"^(\d+[A-Z]?)\s+(.+)", 1), F.regexp_extract(address, r"^(\d+[A-Z]?)\s+(.+)", 2))
    return F.filter(F.array(filled(address), F.when(address.rlike(r"^\d+[A-Z]?\s+."), split), filled(name), F.when((short != name) & (F.trim(short) != ""), short)), lambda t: t.isNotNull())


def tap_score(area_m2: Column, dist_m: Column) -> Column:
    """How likely a tap without a mask meant a building: 0.6 for its size, 0.4 for its distance."""
    size = F.least(F.lit(1.0), F.log10(F.greatest(F.coalesce(area_m2, F.lit(0.0)), F.lit(50.0))) / math.log10(3000.0))
    d = F.coalesce(dist_m, F.lit(0.0))
    far = F.when(d.between(40, 150), 1.0).when(d < 40, F.greatest(F.lit(0.0), d / 40)).otherwise(F.greatest(F.lit(0.0), 1 - (d - 150) / 100))
    return 0.6 * size + 0.4 * far


def public_place(name: Column, address: Column) -> Column:
    said = F.lower(F.concat_ws(" ", name, address))
    return F.exists(F.array(*map(F.lit, PUBLIC)), lambda k: F.contains(said, k))


def section(text: Column, heading: str, after: str, most: int = 5000, skip: int = 500) -> Column:
    """The text between two headings, at most ``most`` characters; without the first, the text after ``skip``."""
    found = F.regexp_extract(text, rf"(?is){heading}(.*?)(?:{after}|$)", 1)
    return F.substring(F.trim(F.when(F.trim(found) != "", found).otherwise(F.substring(text, skip + 1, most))), 1, most)


# The New York Long Island zone of the state plane, in US survey feet, on the GRS 80 ellipsoid.
SEMI_MAJOR_M, ECCENTRICITY2, FOOT_M = 6378137.0, 0.0066943800229, 1200 / 3937
FALSE_EASTING_M, ORIGIN_LAT, ORIGIN_LNG, PARALLELS = 300000.0, 40 + 10 / 60, -74.0, (40 + 40 / 60, 41 + 2 / 60)


def state_plane(x_ft: Column, y_ft: Column) -> Column:
    """(lng, lat) of state plane feet, by the inverse of the conformal conic projection with two parallels."""
    e = math.sqrt(ECCENTRICITY2)
    t = lambda p: math.tan(math.pi / 4 - p / 2) / ((1 - e * math.sin(p)) / (1 + e * math.sin(p))) ** (e / 2)
    m = lambda p: math.cos(p) / math.sqrt(1 - ECCENTRICITY2 * math.sin(p) ** 2)
    p1, p2, p0 = (math.radians(v) for v in (*PARALLELS, ORIGIN_LAT))
    n = math.log(m(p1) / m(p2)) / math.log(t(p1) / t(p2))
    f = m(p1) / (n * t(p1) ** n)
    r0 = SEMI_MAJOR_M * f * t(p0) ** n
    x, y = x_ft * FOOT_M - FALSE_EASTING_M, F.lit(r0) - y_ft * FOOT_M
    at = F.pow(F.sqrt(x * x + y * y) / (SEMI_MAJOR_M * f), F.lit(1 / n))
    lat = F.lit(math.pi / 2) - 2 * F.atan(at)
    for _ in range(5):
        lat = F.lit(math.pi / 2) - 2 * F.atan(at * F.pow((1 - e * F.sin(lat)) / (1 + e * F.sin(lat)), F.lit(e / 2)))
    return F.struct((F.degrees(F.atan2(x, y)) / n + ORIGIN_LNG).alias("lng"), F.degrees(lat).alias("lat"))


def relevant(results: DataFrame, tokens: Column, junk: list[str]) -> DataFrame:
    """Results (request, host, title) that name the subject and are not from known junk hosts; if a request has none, all of its."""
    said = F.lower(F.concat_ws(" ", "title", "host"))
    good = ~F.exists(F.array(*map(F.lit, junk)), lambda j: F.contains(F.col("host"), j)) & F.exists(tokens, lambda t: F.contains(said, t))
    told = results.withColumn("_good", good).withColumn("_any", F.max("_good").over(Window.partitionBy("request")))
    return told.where("_good OR NOT _any").drop("_good", "_any")


# Materials by style, by architect, and by era and class of building; the first that fits holds.
STYLE_MATERIALS = [
    (["cast iron"], "Cast Iron"),
    (["art deco", "art moderne", "simplified colonial revival or art deco"], "Brick and Terra Cotta"),
    (["romanesque revival", "neo-grec", "italianate"], "Brownstone"),
    (["beaux-arts", "french renaissance", "baroque"], "Limestone and Terra Cotta"),
    (["gothic revival", "collegiate gothic", "gothic"], "Limestone"),
    (["renaissance revival", "roman brick", "neo-renaissance"], "Brick"),
    (["classical revival", "greek revival", "federal", "georgian", "colonial revival", "neoclassical", "neo-classical"], "Limestone"),
    (["tudor revival", "tudor", "jacobethan"], "Brick and Stone"),
    (["anglo-american garden home", "storybook", "english cottage", "dutch colonial revival"], "Brick"),
    (["international style", "modernist", "brutalist", "brutalism", "expressionist"], "Concrete"),
    (["high-tech", "corporate modernism", "postmodern", "post-modern", "neo-futurist", "deconstructivist"], "Glass and Steel"),
    (["industrial", "neo-industrial", "daylight factory"], "Brick"),
]
ARCHITECT_MATERIALS = [
    ("hardenbergh", "Limestone"), ("mckim, mead", "Limestone"), ("carrere & hastings", "Limestone"), ("john russell pope", "Limestone"), ("cass gilbert", "Limestone"), ("richard morris hunt", "Limestone"), ("warren & wetmore", "Limestone"),
    ("george f. pelham", "Brick"), ("emery roth", "Brick"), ("neville & bagge", "Brick"), ("cleverdon & putzel", "Brick"), ("benjamin driesler", "Brick"), ("slee & bryson", "Brick"), ("frank s. lowe", "Brick"), ("w. c. dickerson", "Brick"),
    ("william j. bedell", "Brick"), ("clarence stein", "Brick"), ("henry j. hardenbergh", "Limestone"), ("skidmore, owings", "Glass and Steel"), ("som", "Glass and Steel"), ("mies van der rohe", "Glass and Steel"), ("eero saarinen", "Concrete"),
    ("i.m. pei", "Concrete"), ("philip johnson", "Glass and Steel"), ("kevin roche", "Concrete"), ("paul rudolph", "Concrete"), ("marcel breuer", "Concrete"), ("le corbusier", "Concrete"), ("james bogardus", "Cast Iron"), ("daniel badger", "Cast Iron"),
]
#: (first year, year after the last, classes, material); no classes stand for all others.
ERA_MATERIALS = [
    (1, 1840, "ABC", "Wood Frame"), (1, 1840, "", "Brick"), (1840, 1880, "ABC", "Brownstone"), (1840, 1880, "KLEF", "Cast Iron"), (1840, 1880, "", "Brick"),
    (1880, 1940, "ABCDSR", "Brick"), (1880, 1940, "OHK", "Brick and Limestone"), (1880, 1940, "EFL", "Brick"), (1880, 1940, "MWY", "Limestone"),
    (1940, 1970, "DC", "Brick"), (1940, 1970, "OH", "Concrete"), (1940, 1970, "EF", "Concrete"), (1970, 9999, "OH", "Glass and Steel"), (1970, 9999, "DCR", "Concrete"), (1970, 9999, "EF", "Concrete"),
]
UNSAID = ("not determined", "nd", "unknown", "")


def first_named(text: Column, table: list[tuple[str, str]]) -> Column:
    """What a table of (part of a text, value) says, by its first entry that the text has."""
    said = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    rows = F.array(*[F.struct(F.lit(part).alias("part"), F.lit(value).alias("value")) for part, value in table])
    return F.when(~said.isin(*UNSAID), F.try_element_at(F.filter(rows, lambda r: F.contains(said, r["part"])), F.lit(1))["value"])


def material(style: Column, architect: Column, year: Column, kind: Column) -> Column:
    """The material that style, else architect, else era and class tell, or null. A year that is no number tells nothing."""
    built, letter = F.coalesce(year.try_cast("double").cast("int"), F.lit(0)), F.upper(F.substring(F.coalesce(kind, F.lit("")), 1, 1))
    era = F.when(F.lit(False), F.lit(None).cast("string"))
    for low, high, classes, value in ERA_MATERIALS:
        era = era.when((built >= low) & (built < high) & (letter.isin(*classes) if classes else F.lit(True)), value)
    return F.coalesce(first_named(style, [(part, value) for parts, value in STYLE_MATERIALS for part in parts]), first_named(architect, ARCHITECT_MATERIALS), era)


def lore(sources: dict[str, Column], block: Column, neighbours: Column, basis: Column, told_from: Column) -> Column:
    """(tier, text, comparison, renew): the first source with text; its block is compared from two neighbours on, and
    the text is written anew only if more is known than it was told from."""
    filled_in = {name: F.when(F.trim(text) != "", text) for name, text in sources.items()}
    tier = F.coalesce(*[F.when(text.isNotNull(), name) for name, text in filled_in.items()], F.lit("fields"))
    return F.struct(tier.alias("tier"), F.coalesce(*filled_in.values()).alias("text"), F.when(neighbours >= 2, block).alias("comparison"), (told_from.isNull() | (basis > told_from)).alias("renew"))
