"""Entries about buildings from the positioned text of reports, in three layouts.

Reports come as fragments (report, page, x, y, text), y growing upwards. A page's fragments become lines,
lines become paragraphs, and what a reader carries along, the street, the open entry, the section, are
windows over a report. Nothing but a page's own lines is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmill.functions import reports as P
from gridmill.functions import text as T
from gridmill.operators.keyed import best_per_key
from gridmill.sources.tables import stored

# The shapes by which reports are read, and distances on a page.
LINE_TOLERANCE, MARGIN, INDENT, GAP, LEAD, LONGEST_BLOCK = 3, 25, 12, 1.6, 70, 1500
WAYS = "STREET|AVENUE|PLACE|SQUARE|ROAD|LANE|MEWS|COURT|TERRACE|PARK|ALLEY|WAY"
MORE_WAYS = WAYS + "|BOULEVARD|DRIVE|PARKWAY|PROMENADE|WALK|OVAL|CIRCLE|SLIP|ROW"
TITLE_WAYS = "Street|Avenue|Place|Square|Road|Lane|Mews|Court|Terrace|Park|Alley|Way|Boulevard|Drive|Parkway|Promenade|Walk|Oval|Circle|Slip|Row"
MARKER = r"^\(?#\s*(\d+)\s*(?:[-~_–—]\s*(\d+))?\s*\)?$"
AREA, PAGE_NUMBER = r"(?i)\bAREA\s+[0-9lI]+\b", r"^[-~_\s]*\d{1,4}[-~_\s]*$"
STREET_LINE = rf"^[A-Z][A-Z0-9 .,'&\-]{{4,60}}?\b({WAYS})\b(\s+(NORTH|SOUTH|EAST|WEST))?(\s+(North|South|East|West)\s+Side\b|\s*\(|\s*$)"
BLOCK_STREET = rf"^[A-Z][A-Za-z0-9 .,'&\-]{{3,60}}?\b({MORE_WAYS})\b(\s+(NORTH|SOUTH|EAST|WEST))?(?=\s*$|\s*\(|\s+[Bb]etw|\s+BETW|\s+(North|South|East|West)\s+Side\b|\s+(NORTH|SOUTH|EAST|WEST)\s+SIDE\b|\s*,)"
TITLE_STREET = rf"^(?:[A-Z][A-Za-z'’.\-]*|\d{{1,3}}(?:st|nd|rd|th))(?:\s+(?:[A-Z][A-Za-z'’.\-]*|\d{{1,3}}(?:st|nd|rd|th)|of|and|the))*\s+({TITLE_WAYS})\b(?=\s*$|\s*\(|\s+between\b|\s+betw\.|\s+(?:North|South|East|West)\s+Side\b)"
STREET_TAIL = r"(?i)\s*,.*$|\s+betw(?:een)?\.?\b.*$|\s*\(.*$|\s+(?:north|south|east|west)\s+side\b.*$"
SIDE_LINE = r"^\(?(NORTH|SOUTH|EAST|WEST|SOUI'H)\s+SIDE\b|^\(?(North|South|East|West)\s+Side\b"
RUNNING_HEAD = r"^[A-Z0-9]{1,6}[-–][A-Z0-9]{1,6}\.?$"
OTHER_SECTION = r"^(GLOSSARY|FOOTNOTES|BIBLIOGRAPHY|ACKNOWLEDGMENTS?|INDEX|TABLE OF CONTENTS|FINDINGS AND DESIGNATIONS?|TESTIMONY|REFERENCES)\b"
OPENER = r"^\(?(?:Nos?|N0s?|Nns?|NOS?)\s*[\.\,:;]?\s*(?=\d)"
RUN = r"\d{1,4}(?:\s*(?:,|&|and|through|to|[-–—~])\s*\d{1,4})*"
OTHER_STREET = r"(?!\s*(?:[A-Z][A-Za-z']*\.?\s+){1,3}(?:Street|Avenue|Place|Road|Square|Terrace|Court|Lane|Boulevard|Parkway|West|East|North|South)\b)"
NAMED = rf"\b(?:Nos?|N0s?)\s*[\.\,:]?\s*((?>{RUN})){OTHER_STREET}"
SENTENCE_END = r"(?<=[.!?])\s+(?=[A-Z\"'(])"
LOT = r"(?i)Borough of\s+(Manhattan|Bronx|Brooklyn|Queens|Staten Island)\s+Tax Map Block\s+([\d]+)\s*,?\s*Lot\s+([\d]+)"
LOT_TABLE, LOT_LINE = r"(?i)Tax\s*Map\b[^\d\n]{0,24}?(\d{2,5})\s*[/|jl]\s*(\d{1,5})", r"(?im)^\(?Block\s*/\s*lot\s*:?\s*(\d{2,5})\s*[/|jl]\s*(\d{1,5})"
TIERS = {"head": 3, "lead": 2, "inline": 1}
KEPT_TIERS, LEAST_TEXT = ("head", "lead"), 200


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def middle(values: Column, none: int) -> Column:
    """The upper median of an array."""
    return F.coalesce(F.try_element_at(F.array_sort(values), F.floor(F.size(values) / 2).cast("int") + 1), F.lit(none))


def page_lines(fragments: DataFrame) -> DataFrame:
    """(report, page, nth, x, y, frags, text, left, gap): the lines of each page from the top.

    Fragments within LINE_TOLERANCE of a line's first one belong to it. ``left`` is the edge where most
    lines begin, ``gap`` the usual distance of lines.
    """
    frag = F.struct((-F.round("y")).cast("int").alias("down"), F.round("x").cast("int").alias("x"), F.trim("text").alias("text"))
    pages = fragments.where("trim(text) <> ''").groupBy("report", "page").agg(F.array_sort(F.collect_list(frag)).alias("frags"))
    none = F.array().cast("array<struct<down:int,frags:array<struct<x:int,text:string>>>>")

    def add(lines: Column, f: Column) -> Column:
        own, last = F.struct(f["x"].alias("x"), f["text"].alias("text")), F.try_element_at(lines, F.lit(-1))
        longer = F.struct(last["down"].alias("down"), F.array_append(last["frags"], own).alias("frags"))
        fresh = F.array_append(lines, F.struct(f["down"].alias("down"), F.array(own).alias("frags")))
        return F.when(f["down"] - last["down"] <= LINE_TOLERANCE, F.array_append(F.slice(lines, 1, F.size(lines) - 1), longer)).otherwise(fresh)

    lines = pages.select("report", "page", F.aggregate("frags", none, add).alias("lines"))
    starts = F.transform("lines", lambda l: F.array_min(F.transform(l["frags"], lambda f: f["x"])))
    gaps = F.transform(F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0))), lambda l, i: l["down"] - F.element_at(F.col("lines"), i + 1)["down"])
    told = lines.select("report", "page", middle(starts, 0).alias("left"), middle(gaps, 12).alias("gap"), F.posexplode("lines").alias("nth", "line"))
    frags = F.array_sort(F.col("line.frags"))
    return told.select("report", "page", "nth", frags[0]["x"].alias("x"), (-F.col("line.down")).alias("y"), frags.alias("frags"), F.array_join(F.transform(frags, lambda f: f["text"]), " ").alias("text"), "left", "gap")


def layouts(fragments: DataFrame) -> DataFrame:
    """(report, layout): ``modern`` by lots on two pages of an even sample, else ``prose`` or ``legacy`` by their openers and markers."""
    lines = stored(page_lines(fragments), "lines")
    pages = lines.groupBy("report", "page").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "text"))), lambda l: l["text"]), "\n").alias("text"),
        F.sum(F.col("text").rlike(OPENER).cast("int")).alias("openers"),
        F.sum(F.size(F.filter("frags", lambda f: (f["x"] <= F.col("left") - MARGIN) & F.replace(f["text"], F.lit(" "), F.lit("")).rlike(MARKER)))).alias("markers"),
    )
    own = Window.partitionBy("report")
    placed = pages.withColumn("at", F.row_number().over(own.orderBy("page")) - 1).withColumn("n", F.count(F.lit(1)).over(own))
    sampled = lambda most: F.col("at") % F.greatest(F.floor(F.col("n") / most), F.lit(1)) == 0
    lots = F.col("text").rlike(LOT) | F.col("text").rlike(LOT_TABLE) | F.col("text").rlike(LOT_LINE)
    told = placed.groupBy("report").agg(F.count_if(sampled(40) & lots).alias("lots"), F.sum(F.when(sampled(60), F.col("openers"))).alias("openers"), F.sum(F.when(sampled(60), F.col("markers"))).alias("markers"))
    return told.select("report", F.when(F.col("lots") >= 2, "modern").when(F.col("openers") > F.greatest("markers", F.lit(3)), "prose").otherwise("legacy").alias("layout"))


def joined(parts: Column) -> Column:
    return squeezed(F.array_join(parts, " "))


def with_streets(rows: DataFrame) -> DataFrame:
    """``rows`` with the street that their ``said`` line names; each different line is read once."""
    return rows.join(rows.select("said").where("said IS NOT NULL").distinct().withColumn("street", P.street(F.col("said"))), "said", "left")


def marginal_entries(fragments: DataFrame) -> DataFrame:
    """(report, street, numbers, area, pages, text): entries of reports with house numbers in the left margin.

    A line belongs to the lowest marker that is not below it, but none above a street line on its page; a
    line without one goes on with the open entry, which a street line closes. A street holds until the
    next one, over pages.
    """
    lines = page_lines(fragments)
    page = Window.partitionBy("report", "page")
    first = lambda hit: F.min(F.when((F.col("nth") < 4) & hit, F.col("nth"))).over(page)
    text_at = lambda at: F.max(F.when(F.col("nth") == F.col(at), F.col("text"))).over(page)
    lines = lines.withColumn("area_at", first(F.col("text").rlike(AREA)))
    lines = lines.withColumn("street_at", first(F.col("text").rlike(STREET_LINE) & ~F.col("nth").eqNullSafe(F.col("area_at"))))
    lines = lines.withColumns({"area": text_at("area_at"), "page_street": text_at("street_at")})
    lines = lines.where(~F.coalesce(F.col("text") == F.col("area"), F.lit(False)) & ~F.coalesce(F.col("text") == F.col("page_street"), F.lit(False)) & ~(F.col("text").rlike(AREA) & (F.length("text") < 40)))
    margin = F.col("left") - MARGIN
    told = stored(lines.select("report", "page", "nth", "y", "area", "page_street", F.filter("frags", lambda f: f["x"] <= margin).alias("marks"), F.array_join(F.transform(F.filter("frags", lambda f: f["x"] > margin), lambda f: f["text"]), " ").alias("body")), "lines")
    mark = F.when(F.length("m") - F.length(F.replace("m", F.lit(" "), F.lit(""))) < 2, F.replace("m", F.lit(" "), F.lit(""))).otherwise(F.col("m"))
    marks = told.select("report", "page", F.col("y").alias("my"), "nth", F.posexplode(F.transform("marks", lambda f: f["text"])).alias("i", "m")).withColumn("m", mark).where(F.col("m").rlike(MARKER))
    number = lambda i: F.regexp_extract("m", MARKER, i).try_cast("int")
    marks = marks.select("report", "page", F.struct("my", (-F.col("nth")).alias("nth"), (-F.col("i")).alias("i"), T.expand_house_range(number(1), number(2)).alias("numbers")).alias("mark"))
    marks = marks.groupBy("report", "page").agg(F.array_sort(F.collect_list("mark")).alias("of_page"))  # from the lowest up

    rows = told.where("body <> ''").join(marks, ["report", "page"], "left")
    along, top = Window.partitionBy("report").orderBy("page", "nth"), Window.partitionBy("report", "page").orderBy("nth")
    rows = rows.withColumn("turn", F.col("body").rlike(STREET_LINE)).withColumn("top", F.row_number().over(top) == 1)
    said = F.when(F.col("turn"), F.col("body")).when(F.col("top"), F.col("page_street"))
    rows = with_streets(rows.withColumn("said", F.last(said, ignorenulls=True).over(along)))
    rows = rows.withColumn("limit", F.coalesce(F.last(F.when(F.col("turn"), F.col("y")), ignorenulls=True).over(top), F.lit(1 << 30))).withColumn("part", F.sum(F.col("turn").cast("int")).over(along))
    lowest = F.try_element_at(F.filter("of_page", lambda m: (m["my"] >= F.col("y") - 2) & (m["my"] <= F.col("limit"))), F.lit(1))["numbers"]
    plain = ~F.col("turn") & ~F.col("body").rlike(PAGE_NUMBER) & F.col("street").isNotNull()
    rows = rows.withColumn("plain", plain).withColumn("opens", F.when(plain & lowest.isNotNull(), F.struct("street", lowest.alias("numbers"))))
    rows = rows.withColumn("entry", F.last("opens", ignorenulls=True).over(Window.partitionBy("report", "part").orderBy("page", "nth"))).where(F.col("plain") & F.col("entry").isNotNull())
    parts = F.transform(F.array_sort(F.collect_list(F.struct("page", "nth", "body"))), lambda r: r["body"])
    return rows.groupBy("report", "entry").agg(F.min_by(F.coalesce("area", F.lit("")), F.struct("page", "nth")).alias("area"), F.array_sort(F.collect_set("page")).alias("pages"), joined(parts).alias("text")).select("report", "entry.*", "area", "pages", "text")


def paragraphs(fragments: DataFrame) -> DataFrame:
    """(report, page, para, lines): a paragraph begins at a wide gap, an indented line or a number that opens one."""
    top = Window.partitionBy("report", "page").orderBy("nth")
    begins = F.lag("y").over(top).isNull() | (F.lag("y").over(top) - F.col("y") > F.col("gap") * GAP) | (F.col("x") >= F.col("left") + INDENT) | F.col("text").rlike(OPENER)
    numbered = page_lines(fragments).withColumn("begins", begins).withColumn("para", F.sum(F.col("begins").cast("int")).over(top))
    return numbered.groupBy("report", "page", "para").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "text"))), lambda l: l["text"]).alias("lines"))


def street_line(text: Column) -> Column:
    """A street over a block: in capitals for the most part, or in title case with a clear end."""
    span = F.regexp_extract(text, BLOCK_STREET, 0)
    letters = F.regexp_replace(span, r"[^\p{L}]", "")
    mostly = F.length(F.regexp_replace(letters, r"[^\p{Lu}]", "")) >= 0.7 * F.length(letters)
    return F.when(text.rlike(BLOCK_STREET), (letters != "") & mostly).otherwise(text.rlike(TITLE_STREET))


def named_in(sentence: Column) -> Column:
    """House numbers that a sentence names, but for those on another street."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.regexp_extract_all(sentence, F.lit(NAMED), F.lit(1)), P.number_run))))


def prose_entries(fragments: DataFrame) -> DataFrame:
    """(report, street, numbers, kind, tier, area, pages, own_text, text, block, first) of reports in running prose.

    A paragraph is about the numbers that open it (``head``) or stand early in its first sentence
    (``lead``), or goes on with the open entry, which a street, a side or another section closes; with
    none open it tells of the street's block. Sentences that name other houses are kept with these, as
    ``inline``. A paragraph or sentence that an entry has word for word counts once. Damaged streets fold
    onto their frequent twins. Rows of kind ``block`` hold what is said of a street alone.
    """
    rows = paragraphs(fragments).withColumn("head", F.trim(F.col("lines")[0])).where(~F.col("head").rlike(RUNNING_HEAD) & ~F.col("head").rlike(PAGE_NUMBER))
    rows = rows.withColumn("section", F.col("head").rlike(OTHER_SECTION)).withColumn("is_area", ~F.col("section") & F.col("head").rlike(AREA) & (F.length("head") < 40))
    rows = rows.withColumn("is_street", ~F.col("section") & ~F.col("is_area") & street_line(F.col("head")))
    rest = lambda on: F.when(F.col(on), F.slice("lines", 2, F.size("lines"))).otherwise(F.col("lines"))
    rows = rows.withColumn("lines", rest("is_street"))
    rows = rows.withColumn("side", ~F.col("section") & ~F.col("is_area") & F.coalesce(F.trim(F.try_element_at("lines", F.lit(1))).rlike(SIDE_LINE), F.lit(False))).withColumn("lines", rest("side"))
    along = Window.partitionBy("report").orderBy("page", "para")
    last = lambda event: F.last(event, ignorenulls=True).over(along)
    rows = rows.withColumns(
        {
            "said": last(F.when(F.col("is_street"), F.regexp_replace("head", STREET_TAIL, ""))),
            "area": F.coalesce(last(F.when(F.col("is_area"), F.col("head"))), F.lit("")),
            "skipped": F.coalesce(last(F.when(F.col("section"), True).when(F.col("is_street"), False)), F.lit(False)),
            "part": F.sum((F.col("section") | F.col("is_street") | F.col("side")).cast("int")).over(along),
            "body": joined(F.col("lines")),
        }
    )
    rows = with_streets(rows).where(~F.col("section") & ~F.col("is_area") & (F.size("lines") > 0) & ~F.col("skipped") & (F.coalesce("street", F.lit("")) != "")).where((F.length("body") >= 40) | F.col("body").rlike(OPENER))
    rows = rows.withColumn("sentences", F.transform(F.split("body", SENTENCE_END), lambda s: F.trim(s)))
    headed = F.when(F.col("body").rlike(OPENER), P.number_run(F.regexp_replace("body", OPENER, ""))).otherwise(F.array().cast("array<int>"))
    early = F.regexp_extract(F.col("sentences")[0], rf"(?s)^.{{0,{LEAD}}}?{NAMED}", 1)
    rows = rows.withColumn("headed", headed).withColumn("numbers", F.when(F.size("headed") > 0, F.col("headed")).otherwise(P.number_run(early)))
    rows = rows.withColumn("tier", F.when(F.size("headed") > 0, TIERS["head"]).when(F.size("numbers") > 0, TIERS["lead"]).otherwise(TIERS["inline"]))
    current = F.last(F.when(F.size("numbers") > 0, F.col("numbers")), ignorenulls=True).over(Window.partitionBy("report", "part").orderBy("page", "para"))
    rows = stored(rows.withColumn("entry", current).select("report", "page", "para", "street", "area", "body", "sentences", "numbers", "tier", "entry"), "paragraphs")

    others = rows.select("report", "page", "para", "street", "area", "numbers", F.posexplode("sentences").alias("i", "said")).where("length(said) >= 30")
    others = others.withColumn("n", F.explode(F.array_except(named_in(F.col("said")), "numbers")))
    own = rows.where("entry IS NOT NULL").select("report", "street", "area", F.col("entry").alias("numbers"), "tier", F.lit(0).alias("kind"), F.struct("page", "para", F.lit(-1).alias("i")).alias("at"), F.col("body").alias("said"))
    inline = others.select("report", "street", "area", F.array("n").alias("numbers"), F.lit(TIERS["inline"]).alias("tier"), F.lit(1).alias("kind"), F.struct("page", "para", "i").alias("at"), "said")
    pieces = stored(own.unionByName(inline), "pieces")
    folds = P.canonical_streets(pieces.select("report", "street", "numbers").distinct())
    fold = lambda df: df.join(folds, ["report", "street"], "left").withColumn("street", F.coalesce("canonical", "street")).drop("canonical")
    # What an entry has word for word already is left out by groups: an array of structs would be compared pair by pair.
    once = fold(pieces).groupBy("report", "street", "numbers", "kind", "said").agg(F.max("tier").alias("tier"), F.min(F.struct("at", "area")).alias("first"), F.collect_set("at.page").alias("pages"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("kind", F.col("first.at").alias("at"), "said"))), lambda p: F.struct(p["kind"].alias("kind"), p["said"].alias("said")))
    entries = once.groupBy("report", "street", "numbers").agg(F.max("tier").alias("tier"), F.min_by("first.area", "first.at").alias("area"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("pages")))).alias("pages"), parts.alias("parts"), F.min("first.at").alias("first"))
    said = lambda keep: joined(F.transform(F.filter("parts", keep), lambda p: p["said"]))
    tier = F.when(F.col("tier") == 3, "head").when(F.col("tier") == 2, "lead").otherwise("inline")
    entries = entries.select("report", "street", "numbers", F.lit("building").alias("kind"), tier.alias("tier"), "area", "pages", said(lambda p: p["kind"] == 0).alias("own_text"), said(lambda p: F.lit(True)).alias("text"), "first")

    alone = fold(rows.where("entry IS NULL").select("report", "street", "area", F.struct("page", "para", F.lit(-1).alias("i")).alias("at"), "body"))
    blocks = alone.groupBy("report", "street").agg(F.substring(joined(F.transform(F.array_sort(F.collect_list(F.struct("at", "body"))), lambda b: b["body"])), 1, LONGEST_BLOCK).alias("block"), F.min_by("area", "at").alias("area"), F.min("at").alias("first"))
    streets = blocks.where(f"length(block) >= {LEAST_TEXT}").select("report", "street", F.array().cast("array<int>").alias("numbers"), F.lit("block").alias("kind"), F.lit("block").alias("tier"), "area", F.array("first.page").alias("pages"), F.col("block").alias("own_text"), F.col("block").alias("text"), F.lit("").alias("block"), "first")
    return entries.join(blocks.select("report", "street", "block"), ["report", "street"], "left").withColumn("block", F.coalesce("block", F.lit(""))).unionByName(streets)


def entry_index(entries: DataFrame) -> DataFrame:
    """(report, street, number, text): for each house the first entry that is surely about it and long enough."""
    sure = entries.where((F.col("kind") == "building") & F.col("tier").isin(*KEPT_TIERS) & (F.length("own_text") >= LEAST_TEXT))
    houses = sure.select("report", "street", F.explode("numbers").alias("number"), F.col("own_text").alias("text"), "first")
    return best_per_key(houses, ["report", "street", "number"], F.asc("first")).drop("first")


def attach(index: DataFrame, buildings: DataFrame) -> DataFrame:
    """(key, report, text): entries of the buildings (key, report, address) whose number and street they name.

    A street that no entry has stands for the likest one of any report with the same digits.
    """
    a = P.address(F.col("address"))
    known = buildings.select("key", "report", a["number"].alias("number"), a["street"].alias("name")).where("number IS NOT NULL")
    resolved = P.resolve_streets(known.select("name").distinct(), index.select("street").distinct())
    return known.join(resolved, "name").join(index, ["report", "street", "number"]).select("key", "report", "text")
