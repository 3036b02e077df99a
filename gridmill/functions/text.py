"""Text functions as column expressions: tokens, names, ordinals, addresses, keys, trigrams, HTML."""

from __future__ import annotations

import json
import re
from html.entities import html5
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ordinal words in order, street types, words without meaning for lexical search.
ORDINALS = (
    "first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth thirteenth fourteenth fifteenth sixteenth "
    "seventeenth eighteenth nineteenth twentieth twenty-first twenty-second twenty-third twenty-fourth twenty-fifth twenty-sixth "
    "twenty-seventh twenty-eighth twenty-ninth thirtieth thirty-first"
).split()
STREET_TYPES = "street st avenue ave av boulevard blvd road rd drive dr lane ln place pl court ct square sq parkway pkwy terrace ter way walk plaza circle".split()
STOPWORDS = (
    "a an the of in on at to for with and or that this these those is are was were be been it its as by from into like look looks looking "
    "feel feels feeling kind sort type very really some any all me show find buildings building place places something somewhere near around"
).split()
#: The sentinels for "unknown" differ by pipeline: buildings, layers, attributions.
UNKNOWN = {
    "buildings": ["not determined", "undetermined", "unknown", "n/a", "na", "none", "not applicable", "not available", "tbd", "unspecified", "-", "0", "nd", "n.d.", "null", "nan", "none determined", "no data"],
    "layers": ["", "none", "null", "n/a", "na", "unknown", "-", "0"],
    "attribution": ["not determined", "0", "", "none", "undetermined", "n/a", "unknown"],
}
BOROUGHS = {"MN": 1, "BX": 2, "BK": 3, "QN": 4, "SI": 5}


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())])


def ordinal_numeral(n: int) -> str:
    return f"{n}th" if 10 <= n % 100 <= 20 else f"{n}" + {1: "st", 2: "nd", 3: "rd"}.get(n % 10, "th")


NUMERAL_OF = {w: ordinal_numeral(i + 1) for i, w in enumerate(ORDINALS)}


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[^\w'-]+"), lambda t: t != "")


def content_tokens(text: Column, least: int = 3) -> Column:
    return F.array_distinct(F.filter(tokens(text), lambda t: F.length(t) >= least))


def normal_name(text: Column) -> Column:
    plain = F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), r"(?U)[^\w\s]", "")
    return F.regexp_replace(plain, r"(?U)\s+", " ")


def fold_ordinals(text: Column) -> Column:
    numerals = literal_map(NUMERAL_OF)
    return F.array_join(F.transform(tokens(text), lambda t: F.coalesce(numerals[t], t)), " ")


def lexical_query(query: Column) -> Column:
    """The query without stopwords, or all of it if nothing remains, with ordinals as numerals."""
    words = F.filter(F.split(F.trim(query), r"\s+"), lambda w: ~F.regexp_replace(F.lower(w), r"""^[.,!?;:'"]+|[.,!?;:'"]+$""", "").isin(STOPWORDS))
    kept = F.when(F.size(words) > 0, F.array_join(words, " ")).otherwise(query)
    folded = fold_ordinals(kept)
    return F.when(folded != "", folded).otherwise(kept)


def house_number(text: Column) -> Column:
    return F.regexp_extract(F.coalesce(text, F.lit("")), r"^\s*(\d+)", 1).try_cast("int")


def house_range(text: Column) -> Column:
    """(low, high) of a leading number or number range; null without one."""
    low = house_number(text)
    other = F.coalesce(F.regexp_extract(F.coalesce(text, F.lit("")), r"^\s*\d+\s*-\s*(\d+)", 1).try_cast("int"), low)
    return F.when(low.isNotNull(), F.struct(F.least(low, other).alias("low"), F.greatest(low, other).alias("high")))


def street_tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(tokens(fold_ordinals(text)), lambda t: ~t.rlike(r"^\d+$") & ~t.isin(STREET_TYPES)))


def expand_house_range(low: Column, high: Column, most: int = 60) -> Column:
    """House numbers of a range: one side of the street by twos; over ``most`` apart the low one, mixed parity both ends."""
    return (
        F.when(high.isNull() | (high <= low) | (high - low > most), F.array(low))
        .when((high - low) % 2 != 0, F.array(low, high))
        .otherwise(F.sequence(low, high, F.lit(2)))
    )


def canonical_key(key: Column) -> Column:
    """Removes the suffix .0 that float columns leave on ids; null, blank and nan become N/A."""
    plain = F.regexp_replace(F.trim(key), r"\.0+$", "")
    return F.when(plain.isNull() | F.lower(plain).isin("", "nan"), F.lit("N/A")).otherwise(plain)


def lot_key(borough: Column, block: Column, lot: Column) -> Column:
    """Borough digit, five digits of block, four of lot; null unless that makes ten digits."""
    key = F.concat(borough.cast("string"), F.lpad(block.cast("string"), 5, "0"), F.lpad(lot.cast("string"), 4, "0"))
    return F.when(key.rlike(r"^\d{10}$"), key)


def number(text: Column, kind: str = "double") -> Column:
    """A number that may have thousands separators or a decimal tail, else null."""
    return F.regexp_replace(text, ",", "").try_cast("double").try_cast(kind)


def any_date(text: Column) -> Column:
    """The first of five spellings of a date that fits."""
    return F.coalesce(*[F.try_to_date(text, f) for f in ("yyyy-MM-dd", "M/d/yyyy", "M-d-yyyy", "yyyy/M/d", "MMMM d, yyyy")])


def first_filled(*columns: Column) -> Column:
    """The first column that is neither null nor blank."""
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in columns])


def known(text: Column, pipeline: str) -> Column:
    return F.when(~F.lower(F.trim(text)).isin(UNKNOWN[pipeline]), text)


def trigrams(text: Column) -> Column:
    """The ordered trigrams of the words, each word with two blanks before it and one after."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3)))))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared over all distinct trigrams, from 0 to 1."""
    x, y = F.array_distinct(trigrams(a)), F.array_distinct(trigrams(b))
    union = F.size(F.array_union(x, y))
    return F.when(union > 0, F.size(F.array_intersect(x, y)) / union).otherwise(F.lit(0.0))


def word_similarity(query: Column, text: Column) -> Column:
    """The best share of the query's trigrams with any run of the text's trigrams.

    A best run starts and ends at a trigram of the query, so only these places are tried.
    """
    q, t = F.array_distinct(trigrams(query)), trigrams(text)
    places = F.filter(F.transform(t, lambda g, i: F.when(F.array_contains(q, g), i)), lambda i: i.isNotNull())

    def score(a: Column, b: Column) -> Column:
        run = F.array_distinct(F.slice(t, a + 1, b - a + 1))
        return F.size(F.array_intersect(q, run)) / F.size(F.array_union(q, run))

    runs = F.flatten(F.transform(places, lambda a: F.transform(F.filter(places, lambda b: b >= a), lambda b: score(a, b))))
    return F.when(F.size(places) > 0, F.array_max(runs)).otherwise(F.lit(0.0))


def word_guard(text: Column, query: str, least: int = 3) -> Column | None:
    """Whether a whole word of the query stands in the text; None, no condition, if all its words are short."""
    words = [re.escape(w.lower()) for w in query.split() if len(w) >= least]
    return F.lower(text).rlike(r"(?U)\b(" + "|".join(words) + r")\b") if words else None


#: Named entities as the standard has them, with their semicolon, and the old ones that do without it, longest first.
ENTITIES = {name: char for name, char in html5.items() if name.endswith(";")}
OLD_ENTITIES = dict(sorted(((n, c) for n, c in html5.items() if not n.endswith(";")), key=lambda e: (-len(e[0]), e[0])))
ENTITY = r"^&(#[0-9]+|#[xX][0-9a-fA-F]+|[^\t\n\f <&#;]{1,32});?"


def numbered_character(digits: Column, base: int) -> Column:
    """The character of a numeric entity: those of an old code page for 128 to 159, none for control characters, a mark for what is no character."""
    n = F.when(F.length(F.ltrim(digits, F.lit("0"))) > 8, F.lit(1 << 40)).otherwise(F.conv(digits, base, 10).cast("long"))
    old = literal_map({i: bytes([i]).decode("cp1252", "ignore") or chr(i) for i in range(0x80, 0xA0)} | {0: "\ufffd", 13: "\r"})
    control = n.between(1, 8) | n.between(14, 31) | n.isin(11, 127) | n.between(0xFDD0, 0xFDEF) | (n.bitwiseAND(0xFFFE) == 0xFFFE)
    plain = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    return F.when(n.isin(0, 13) | n.between(0x80, 0x9F), old[n.cast("int")]).when(n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), "\ufffd").when(control, "").otherwise(plain)


def unescape(text: Column) -> Column:
    """The text with all its entities resolved, each once: what stands after an ampersand is looked up, the rest of it stays."""
    names = F.from_json(F.lit(json.dumps(ENTITIES)), "map<string,string>")
    old = F.from_json(F.lit(json.dumps(OLD_ENTITIES)), "map<string,string>")
    first_of = r"^&(" + "|".join(OLD_ENTITIES) + ")"

    def resolved(piece: Column) -> Column:
        whole, said = F.regexp_extract(piece, ENTITY, 0), F.regexp_extract(piece, ENTITY, 1)
        begun = F.regexp_extract(piece, first_of, 1)
        rest = F.substring(piece, F.length(whole) + 1, F.length(piece))
        number = F.when(said.rlike("^#[xX]"), numbered_character(F.substring(said, F.lit(3), F.length(said)), 16)).otherwise(numbered_character(F.substring(said, F.lit(2), F.length(said)), 10))
        named = F.when(whole.endswith(";"), names[F.substring(whole, F.lit(2), F.length(whole))])
        known = F.coalesce(F.concat(named, rest), F.when(begun != "", F.concat(old[begun], F.substring(piece, F.length(begun) + 2, F.length(piece)))), piece)
        return F.when(~piece.startswith("&") | (said == ""), piece).when(said.startswith("#"), F.concat(number, rest)).otherwise(known)

    return F.when(text.contains("&"), F.array_join(F.transform(F.split(text, "(?=&)"), resolved), "")).otherwise(text)


def flatten_html(html: Column) -> Column:
    """Text of a page: script-like blocks dropped, block ends as line ends, tags dropped, entities resolved, blanks joined."""
    text = F.regexp_replace(html, r"(?is)<(script|style|noscript|svg|nav|header|footer|form|aside)[^>]*>.*?</\1>", " ")
    text = F.regexp_replace(text, r"(?i)</(p|div|li|h[1-6]|tr|section|article)>", "\n")
    text = F.regexp_replace(text, r"(?i)<br\s*/?>", "\n")
    text = F.regexp_replace(text, r"<[^>]+>", " ")
    text = unescape(text)
    text = F.regexp_replace(text, r"[ \t\r\f\x0B]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\n\s*\n\s*\n+", "\n\n"), r"^\s+|\s+$", ""))


def clean_report(text: Column) -> Column:
    """Text of a scanned report with line ends of one kind, single blanks, and at most one empty line in a row."""
    plain = F.regexp_replace(F.replace(text, F.lit("\r"), F.lit("\n")), r"[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(plain, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def url_key(url: Column) -> Column:
    """The identity of a page: host without www, and the last path segment if it has four characters or more, else the path."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.trim(url)), r"/+$", ""), r"[#?].*$", "")
    rest = F.regexp_replace(plain, r"^.*?://", "")
    host = F.regexp_replace(F.regexp_extract(rest, r"^([^/]*)", 1), r"^www\.", "")
    path = F.regexp_replace(rest, r"^[^/]*/?", "")
    last = F.coalesce(F.try_element_at(F.filter(F.split(path, "/"), lambda x: x != ""), F.lit(-1)), F.lit(""))
    return F.when(~plain.contains("://"), plain).otherwise(F.concat(host, F.lit("/"), F.when(F.length(last) >= 4, last).otherwise(path)))


def trim_to_sentence(text: Column, limit: int) -> Column:
    """At most ``limit`` characters, cut after the last break in their last third: paragraph, sentence, then blank."""
    window, floor = F.substring(text, 1, limit), int(limit * 0.66)

    def last(sep: str) -> Column:
        reversed_at = F.locate(sep[::-1], F.reverse(window))
        return F.when(reversed_at > 0, F.length(window) - reversed_at - len(sep) + 1).otherwise(-1)

    cut = F.coalesce(*[F.when(last(s) > floor, last(s) + len(s)) for s in ("\n\n", ". ", ".\n", "! ", "? ")], F.when(last(" ") > floor, last(" ")), F.length(window))
    return F.when(F.length(text) <= limit, text).otherwise(F.regexp_replace(F.substring(window, F.lit(1), cut), r"^\s+|\s+$", ""))


def complete_prose(text: Column, least: int = 120) -> Column:
    plain = F.trim(F.coalesce(text, F.lit("")))
    return (F.length(plain) >= least) & plain.rlike("[.!?\"”’]$")


def title_label(value: Column) -> Column:
    return F.initcap(F.replace(value, F.lit("_"), F.lit(" ")))
