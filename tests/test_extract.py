"""Reports of a few lines, with what a reader would take from them."""

import textwrap

from gridmill.operators import extract

PARAGRAPHS = {
    0: [
        "GARDEN PLACE Between First & Second Streets",
        "This block was laid out in 1840 for the sons of a merchant, and it has kept its even line of roofs, its low stoops and its trees to this day. " + "It is quiet. " * 14,
        "WEST SIDE (Nos. 1-99)",
        "No. 12. Built in 1851 for a captain, it has a door like that of No. 16 on the same side, and one like No. 649 Eleventh Street has.",
        "Its garden was famous in its time, and so was the captain's wife there.",
        "The row of three brick houses at Nos. 20-24 was built by a mason in 1852.",
        "-31-",
        "GLOSSARY",
        "No. 99. This is not about a house but about a word that houses have.",
    ],
    1: ["Elm Road between Oak and Ash West Side", "No. 5", "Erected 1902 by a builder of the place for the widow of a miller here, and sold."],
}


def fragments():
    """Lines of some fifty letters, twelve apart, and a wider gap after each paragraph."""
    rows = []
    for page, texts in PARAGRAPHS.items():
        y = 2000
        for text in texts:
            for line in textwrap.wrap(text, 54 if page == 0 else 20):
                rows.append(("r", page, 75, y, line))
                y -= 12
            y -= 28
    return rows


def test_prose_layout(spark):
    rows = fragments()
    got = {(r.street, tuple(r.numbers)): r for r in extract.prose_entries(spark.createDataFrame(rows, "report string, page int, x int, y int, text string")).collect()}
    assert set(got) == {("GARDEN PLACE", ()), ("GARDEN PLACE", (12,)), ("GARDEN PLACE", (16,)), ("GARDEN PLACE", (20, 22, 24)), ("ELM ROAD", (5,))}
    captain = got["GARDEN PLACE", (12,)]
    assert captain.tier == "head" and captain.text.startswith("No. 12. Built") and captain.text.endswith("wife there.") and captain.block.startswith("This block")
    assert got["GARDEN PLACE", (16,)].tier == "inline" and "No. 16 on" in got["GARDEN PLACE", (16,)].text
    assert got["GARDEN PLACE", (20, 22, 24)].tier == "lead" and got["ELM ROAD", (5,)].text == "No. 5 Erected 1902 by a builder of the place for the widow of a miller here, and sold."
    assert got["GARDEN PLACE", ()].kind == "block" and not extract.prose_entries(spark.createDataFrame(rows, "report string, page int, x int, y int, text string").where("false")).collect()


def test_marginal_layout(spark):
    rows = [
        ("r", 0, 300, 990, "AREA 5"), ("r", 0, 100, 960, "MAPLE STREET North Side"), ("r", 0, 100, 930, "Words before any number stand alone."), ("r", 0, 40, 901, "#13"), ("r", 0, 100, 900, "A house of brick"),
        ("r", 0, 100, 888, "with a stoop."), ("r", 0, 40, 860, "(#20- 24)"), ("r", 0, 100, 861, "A row of three."), ("r", 0, 100, 830, "WALNUT AVENUE"), ("r", 0, 100, 800, "Lost words."), ("r", 0, 40, 770, "#2"), ("r", 0, 100, 770, "A shop"), ("r", 0, 100, 740, "- 7 -"),
        ("r", 1, 100, 900, "on a corner."),
    ]
    got = {(r.street, tuple(r.numbers)): (r.text, r.pages, r.area) for r in extract.marginal_entries(spark.createDataFrame(rows, "report string, page int, x int, y int, text string")).collect()}
    assert got == {("MAPLE STREET", (13,)): ("A house of brick with a stoop.", [0], "AREA 5"), ("MAPLE STREET", (20, 22, 24)): ("A row of three.", [0], "AREA 5"), ("WALNUT AVENUE", (2,)): ("A shop on a corner.", [0, 1], "AREA 5")}
