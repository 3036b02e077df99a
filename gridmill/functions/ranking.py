"""Search scoring: intents, leg scores, fusion terms and re-ranking as column expressions.

Rules over a query's words are column expressions too, so whole tables of queries can be classified
and scored at once. The weights and vocabularies are fixed values of the product.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridmill.functions import text as T

# Vocabularies of the intent cascade.
POI_NOUNS = (
    "bar bars cafe cafes coffee restaurant restaurants club clubs theater theatre theaters theatres diner diners speakeasy speakeasies bakery "
    "bakeries pizzeria pizzerias brewery breweries bookstore bookstores gallery galleries museum museums shop shops market markets pub pubs "
    "lounge lounges hotel hotels deli delis venue venues"
).split()
ARCHITECT_MARKERS = "architect architects designed designer firm atelier".split()
STYLES = (
    "deco beaux-arts beaux arts gothic romanesque modernist modernism brutalist brutalism victorian federal georgian italianate neoclassical "
    "postmodern postmodernism moderne streamline cast-iron greek revival mid-century midcentury international queen renaissance colonial tudor art"
).split()
LORE = "demolished demolition lost former formerly ghost torn razed vanished gone unbuilt never abandoned ruins ruin history historic used once".split()
EVENTS = "fire blackout riot riots strike collapse explosion disaster protest protests attack bombing crash".split()
IRREGULAR_SINGULARS = {"theatre": "theater", "theatres": "theater", "speakeasies": "speakeasy", "bakeries": "bakery", "breweries": "brewery", "galleries": "gallery"}
ARCHITECT_NOISE = "building buildings designed design architect architects by the of who was firm structures work works".split()

# Words of a category that belong to the noun of a query.
FAMILIES = {
    "bar": ["bar", "pub", "lounge", "speakeasy", "cocktail", "gastropub", "tavern"],
    "pub": ["bar", "pub", "lounge", "speakeasy", "cocktail", "gastropub", "tavern"],
    "lounge": ["bar", "pub", "lounge", "speakeasy", "cocktail", "gastropub"],
    "speakeasy": ["bar", "pub", "lounge", "speakeasy", "cocktail"],
    "cafe": ["cafe", "coffee", "espresso"],
    "coffee": ["cafe", "coffee", "espresso"],
    "restaurant": ["restaurant", "diner", "steakhouse", "bistro", "grill", "eatery"],
    "diner": ["diner", "restaurant"],
    "club": ["club", "nightclub", "lounge"],
    "theater": ["theater", "theatre", "cinema", "playhouse"],
    "bakery": ["bakery", "patisserie"],
    "pizzeria": ["pizza"],
    "brewery": ["brewery", "beer"],
    "bookstore": ["bookstore", "book"],
    "gallery": ["art gallery", "gallery"],
    "museum": ["museum"],
    "market": ["market", "grocery"],
    "hotel": ["hotel", "inn"],
    "deli": ["deli", "sandwich"],
}
UNRELATED = ["art gallery", "antique store", "gallery", "sushi restaurant", "furniture and home store"]
# Years in which a style was built.
ERAS = {
    "deco": (1920, 1941), "moderne": (1925, 1945), "streamline": (1930, 1945), "victorian": (1860, 1901), "italianate": (1845, 1885),
    "beaux-arts": (1885, 1925), "beaux": (1885, 1925), "gothic": (1830, 1930), "romanesque": (1870, 1900), "federal": (1785, 1830),
    "georgian": (1700, 1780), "greek": (1820, 1860), "brutalist": (1955, 1980), "brutalism": (1955, 1980), "midcentury": (1945, 1970),
    "mid-century": (1945, 1970), "international": (1930, 1975), "postmodern": (1975, 1995), "cast-iron": (1850, 1885),
}
# Weight of each corpus by intent, in the order buildings, venues, layers.
CORPORA = ("buildings", "venues", "layers")
WEIGHTS = {
    "name": (1.0, 0.6, 0.6), "address": (1.0, 0.5, 0.4), "poi": (0.4, 1.0, 0.3), "architect": (1.0, 0.3, 0.4),
    "style": (1.0, 0.5, 0.4), "lore": (0.5, 0.3, 1.0), "event": (0.3, 0.2, 1.0), "prose": (0.8, 0.8, 0.8),
}
HARD_RADIUS = ("poi", "name", "address", "event")
FAME_INTENTS = ("style", "prose", "name", "architect")
COVERAGE_INTENTS = ("lore", "event", "poi", "style", "prose")
K, SCALE = 60, 60.0
FLOOR, MIN_KEEP, DEDUPE_M = 0.40, 3, 150.0

ADDRESS = r"(?i)^\s*\d+[-\d]*\s+[A-Za-z0-9][A-Za-z0-9.\s]*(?<![A-Za-z])(street|st|avenue|ave|boulevard|blvd|road|rd|place|pl|drive|dr|lane|ln|way|court|ct|square|sq|broadway|parkway|pkwy)\b"
LOOSE_ADDRESS = r"^\s*\d+[-\d]*\s+[A-Za-z][A-Za-z.'-]*(\s+[A-Za-z][A-Za-z.'-]*){0,2}\s*$"


def words(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def poi_noun(query: Column) -> Column:
    """The first place noun of the query in the singular, or null."""
    noun = F.try_element_at(F.filter(T.tokens(query), lambda t: t.isin(POI_NOUNS)), F.lit(1))
    plural = noun.isin([n for n in POI_NOUNS if n.endswith("s") and n[:-1] in POI_NOUNS])
    return F.coalesce(T.literal_map(IRREGULAR_SINGULARS)[noun], F.when(plural, F.regexp_replace(noun, "s$", "")).otherwise(noun))


def intent(query: Column) -> Column:
    """One of name, address, poi, architect, style, lore, event, prose; the more specific rule first."""
    q = F.trim(F.coalesce(query, F.lit("")))
    toks, parts = T.tokens(q), F.filter(F.split(q, r"\s+"), lambda w: w != "")
    has = lambda vocabulary: F.arrays_overlap(toks, words(vocabulary))
    n = F.size(parts)
    capitals = F.size(F.filter(parts, lambda w: w.rlike(r"^\p{Lu}")))
    return (
        F.when(q == "", "prose")
        .when(q.rlike(ADDRESS), "address")
        .when(has(EVENTS), "event")
        .when(has(LORE), "lore")
        .when(has(ARCHITECT_MARKERS), "architect")
        .when(has(POI_NOUNS), "poi")
        .when(has(STYLES), "style")
        .when(q.rlike(LOOSE_ADDRESS), "address")
        .when((n <= 5) & (capitals >= F.greatest(F.lit(1), n - 1)), "name")
        .when(n <= 6, "name")
        .otherwise("prose")
    )


def corpus_weight(intent_: Column, corpus: Column) -> Column:
    table = T.literal_map({f"{i}:{c}": w for i, ws in WEIGHTS.items() for c, w in zip(CORPORA, ws)})
    return F.coalesce(table[F.concat_ws(":", intent_, corpus)], F.lit(0.8))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 for a zero vector."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def profile_similarity(a: Column, b: Column) -> Column:
    """The dot product of two profiles, null if one is missing, empty or of another length."""
    return F.when((F.size(a) > 0) & (F.size(a) == F.size(b)), dot(a, b))


def category_hit(category: Column, family: list[str]) -> Column:
    """Whether a keyword stands in a category: single words as whole words, phrases anywhere."""
    low = F.lower(F.coalesce(category, F.lit("")))
    single = F.arrays_overlap(F.split(low, r"(?U)[^\w]+"), words([k for k in family if " " not in k] or ["\0"]))
    for phrase in (k for k in family if " " in k):
        single = single | low.contains(phrase)
    return single


def poi_category(category: Column, noun: Column, labels: Column) -> Column:
    """+0.15 for a category of the noun's family unless a label is of a disjoint one, -0.12 for another family's, -0.06 for none."""
    out = F.lit(0.0)
    for name, family in FAMILIES.items():
        others = [f for f in FAMILIES.values() if f != family]
        apart = [f for f in others if not set(f) & set(family)]
        conflict = F.exists(F.coalesce(labels, F.array().cast("array<string>")), lambda x: any_of([category_hit(x, f) for f in apart]))
        adjusted = (
            F.when(category_hit(category, family), F.when(conflict, 0.0).otherwise(0.15))
            .when(F.lower(F.trim(category)).isin(UNRELATED) | any_of([category_hit(category, f) for f in others]), -0.12)
            .otherwise(-0.06)
        )
        out = F.when((noun == name) & (F.coalesce(category, F.lit("")) != ""), adjusted).otherwise(out)
    return out


def any_of(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def nudged(score: Column, profile_dot: Column, dist_m: Column, novel: Column) -> Column:
    near = F.when(dist_m >= 0, 0.01 * F.greatest(F.lit(0.0), 1 - dist_m / 1500.0)).otherwise(0.0)
    return score + F.coalesce(0.02 * profile_dot, F.lit(0.0)) + near + F.when(novel, 0.02).otherwise(0.0)


def soft_radius(intent_: Column, dist_m: Column) -> Column:
    return F.when(~intent_.isin(*HARD_RADIUS) & (dist_m >= 0), 0.02 * F.exp(-dist_m / 3000.0)).otherwise(0.0)


def fame_boost(intent_: Column, fame: Column) -> Column:
    return F.when(intent_.isin(*FAME_INTENTS) & fame.isNotNull(), 0.12 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), fame))).otherwise(0.0)


def exact_name(query: Column, name: Column) -> Column:
    q, n = T.normal_name(query), T.normal_name(name)
    qt, nt = T.content_tokens(q), T.content_tokens(n)
    return F.when((q == "") | (n == ""), 0.0).when(q == n, 0.30).when((F.size(qt) > 0) & (F.size(F.array_except(qt, nt)) == 0), 0.20).otherwise(0.0)


def house_number(query: Column, name: Column, snippet: Column) -> Column:
    """0.30 if the number lies in the range and all street words match, 0.02 if only the number does; the name decides first."""
    number, street = T.house_number(query), T.street_tokens(query)

    def tier(field: Column) -> Column:
        r = T.house_range(field)
        full = (F.size(street) == 0) | (F.size(F.array_except(street, T.street_tokens(field))) == 0)
        return F.when(number.between(r["low"], r["high"]), F.when(full, 0.30).otherwise(0.02))

    return F.coalesce(tier(name), tier(snippet), F.lit(0.0))


def style_tokens(query: Column, noun: Column) -> Column:
    return F.array_distinct(F.filter(T.tokens(query), lambda t: t.isin(STYLES) & ~t.eqNullSafe(noun)))


def style_parts(style: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(style, F.lit("")), r"(?i)\s+or\s+|\s*/\s*|\s*;\s*|\s*,\s*"), lambda x: F.trim(x)), lambda p: p != "")


def hedged_style(styles: Column, style: Column) -> Column:
    """-0.10 where only an alternative of a hedged style answers the query."""
    parts = style_parts(style)
    primary, rest = T.tokens(F.coalesce(F.try_element_at(parts, F.lit(1)), F.lit(""))), T.tokens(F.array_join(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), " "))
    return F.when((F.size(parts) > 1) & ~F.arrays_overlap(styles, primary) & F.arrays_overlap(styles, rest), -0.10).otherwise(0.0)


def architect_match(query: Column, architect: Column) -> Column:
    q = F.filter(T.content_tokens(query), lambda t: ~t.isin(ARCHITECT_NOISE))
    return F.when((F.size(q) > 0) & (F.size(F.array_except(q, T.tokens(architect))) == 0), 0.30).otherwise(0.0)


def venue_style(styles: Column, building_style: Column, year: Column) -> Column:
    first, last = T.literal_map({k: v[0] for k, v in ERAS.items()}), T.literal_map({k: v[1] for k, v in ERAS.items()})
    era = F.exists(styles, lambda t: F.coalesce(year.between(first[t], last[t]), F.lit(False)))
    return F.when(F.arrays_overlap(styles, T.tokens(building_style)), 0.12).when(era, 0.06).otherwise(0.0)


def style_decoy(query: Column, name: Column, category: Column, noun: Column) -> Column:
    """-0.10 for a name that shares nothing but style words with the query, unless the category fits."""
    shared = F.array_intersect(T.content_tokens(query), T.tokens(name))
    fits = F.lit(False)
    for n, family in FAMILIES.items():
        fits = fits | ((noun == n) & category_hit(category, family))
    return F.when(noun.isNotNull() & ~F.coalesce(fits, F.lit(False)) & (F.size(shared) > 0) & (F.size(F.array_except(shared, words(STYLES))) == 0), -0.10).otherwise(0.0)


def token_coverage(query: Column, *fields: Column) -> Column:
    """The share of the query's content words found in the fields, plurals and -re/-er endings folded."""
    q = T.content_tokens(query)
    found = T.tokens(F.concat_ws(" ", *fields))
    swapped = F.transform(found, lambda t: F.when(t.endswith("re"), F.regexp_replace(t, "re$", "er")).when(t.endswith("er"), F.regexp_replace(t, "er$", "re")).otherwise(t))
    both = F.array_union(found, swapped)
    folded = F.array_union(F.array_union(both, F.transform(both, lambda t: F.concat(t, F.lit("s")))), F.transform(both, lambda t: F.regexp_replace(t, "s$", "")))
    hits = F.size(F.filter(q, lambda t: F.array_contains(folded, t) | F.array_contains(folded, F.regexp_replace(t, "s+$", ""))))
    return F.when(F.size(q) > 0, hits / F.size(q)).otherwise(F.lit(1.0))


def coverage(intent_: Column, query: Column, *fields: Column) -> Column:
    share = token_coverage(query, *fields)
    counts = intent_.isin(*COVERAGE_INTENTS) & (F.size(T.content_tokens(query)) >= 2)
    return F.when(~counts, 0.0).when(share >= 1.0, 0.10).otherwise(-F.least(F.lit(0.25), 0.25 * (1 - share) * 2))


def matched_field(query: Column, name: Column, style: Column, architect: Column, category: Column, default: str = "semantic") -> Column:
    """The field with most of the query's words; ties go to name, then architect, style, category."""
    q = T.content_tokens(query)
    told = [(k, F.size(F.array_intersect(q, T.content_tokens(f)))) for k, f in (("name", name), ("architect", architect), ("style", style), ("category", category))]
    best = F.greatest(*[n for _, n in told])
    out = F.when(best == 0, default)
    for k, n in told:
        out = out.when(n == best, k)
    return out


def why(matched: Column, year: Column, style: Column, category: Column, snippet: Column) -> Column:
    y = year.cast("string")
    other = F.when(~category.eqNullSafe(style) & ~category.eqNullSafe(y), F.nullif(category, F.lit("")))
    parts = F.concat_ws(", ", F.nullif(style, F.lit("")), F.when(year != 0, y), other)
    head = F.when(parts != "", parts).otherwise(F.substring(F.trim(F.coalesce(snippet, F.lit(""))), 1, 60))
    tail = F.when(matched != "", F.concat(F.lit("matched: "), matched))
    said = F.concat_ws(" · ", F.nullif(head, F.lit("")), tail)
    return F.when(said != "", said).otherwise("match")


def recommendation(user: Column, building: Column, final_score: Column) -> Column:
    """0.6 of the profiles' cosine and 0.4 of the score, a missing one as 0."""
    return 0.6 * cosine(user, building) + 0.4 * F.coalesce(final_score, F.lit(0.0)) / 100.0
