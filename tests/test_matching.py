"""Matching and folding of names against plain Python over all pairs."""

import difflib
import random
import re

from pyspark.sql import functions as F

from gridmill.functions import reports
from gridmill.operators import matching

LETTERS = "abcdest "


def texts(rng, n, low=3, high=24):
    return ["".join(rng.choice(LETTERS) for _ in range(rng.randint(low, high))).strip() or "x" for _ in range(n)]


def damaged(rng, text):
    text = list(text)
    for _ in range(rng.choice([0, 1, 1, 2])):
        at = rng.randrange(len(text) + 1)
        text[at : at + rng.randint(0, 1)] = rng.choice([[], [rng.choice(LETTERS)]])
    return "".join(text) or "x"


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


def test_pairs_on_rare_runs_are_all_pairs_of_that_likeness(spark):
    rng = random.Random(4)
    known = list(dict.fromkeys(texts(rng, 120) + [f"{t} {i % 4}" for i, t in enumerate(texts(rng, 60))]))
    asked = list(dict.fromkeys(damaged(rng, rng.choice(known)) for _ in range(150)))
    left, right = spark.createDataFrame([(a,) for a in asked], "name string"), spark.createDataFrame([(k,) for k in known], "street string")
    digits = lambda s: re.sub(r"\D", "", s)
    for least in (0.8, 0.82, 0.86, 0.9):
        got = {(r.name, r.street) for r in reports.like_pairs(left, right, least).collect()}
        assert got == {(a, k) for a in asked for k in known if a != k and digits(a) == digits(k) and difflib.SequenceMatcher(None, k, a).ratio() >= least} and got
    got = {(r.name, r.street): r.like for r in reports.like_pairs(left, right, 0.9, reports.edit_ratio, ".").collect()}
    want = {(a, k): 2 * lcs(a, k) / (len(a) + len(k)) for a in asked for k in known if a != k}
    assert got == {p: s for p, s in want.items() if s >= 0.9} and got


def test_streets_resolve_to_the_likest(spark):
    names = ["EAST 68 STREET", "EAST 78 STRET", "MAPEL STREET", "NOWHERE", None, "MAPEL STREET"]
    got = sorted(str((r.name, r.street)) for r in reports.resolve_streets(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([("EAST 68 STREET",), ("EAST 78 STREET",), ("MAPLE STREET",)], "street string")).collect())
    assert got == sorted(map(str, [("EAST 68 STREET", "EAST 68 STREET"), ("EAST 78 STRET", "EAST 78 STREET"), ("MAPEL STREET", "MAPLE STREET"), ("NOWHERE", "NOWHERE"), (None, None), ("MAPEL STREET", "MAPLE STREET")]))


def test_long_chains_of_folds_end_at_their_head(spark):
    """Each street folds onto the next, more frequent one, of which only the neighbours are alike."""
    streets = ["A" * (60 - i) + "B" * i for i in range(0, 60, 3)]
    rows = [("r", s, list(range(1, 2 + 2 * i))) for i, s in enumerate(streets)]
    got = {r.street: r.canonical for r in reports.canonical_streets(spark.createDataFrame(rows, "report string, street string, numbers array<int>"), 0.95).collect()}
    assert len(streets) == 20 and set(got.values()) == {streets[-1]}


def test_tiers_of_titles(spark):
    known = [(1, "Chrysler Building", "405 Lexington Avenue, New York"), (2, "Gage House", "18 Michigan Ave"), (3, "Chrysler Building", ""), (4, None, "51 Market Street, New York")]
    asked = [(1, "CHRYSLER BUILDING"), (2, "Chrysler Bilding"), (3, "51 Market Street House"), (4, "Nothing like it"), (5, "")]
    got = {r.key: (r.id, r.tier) for r in matching.match_titles(spark.createDataFrame(asked, "key int, title string"), spark.createDataFrame(known, "id int, name string, address string")).collect()}
    assert got == {1: (1, "exact_name"), 2: (1, "fuzzy_name"), 3: (4, "address")}


def test_house_number_runs(spark):
    runs = ["172-178 Elm", "172, 174 and 176", "128~146", "1~5-163", "262-2", "85-02 Road", "10 to 13", "2-200", "none", "", None, "7 & 9", "0, 5"]
    got = [r.n for r in spark.createDataFrame(list(enumerate(runs)), "i int, t string").select("i", reports.number_run(F.col("t")).alias("n")).orderBy("i").collect()]
    assert got == [[172, 174, 176, 178], [172, 174, 176], list(range(128, 147, 2)), [], [262], [85], [10, 13], [2], [], [], [], [7, 9], [5]]


def test_the_likest_name_is_that_of_all_names_that_share_a_word(spark, monkeypatch):
    rng = random.Random(5)
    parts = ["building", "house", "old", "mill", "gate", "grand", "northern", "é", "of", "tower", "bilding", "howse"]
    names = [(i, " ".join(rng.choice(parts) for _ in range(rng.randint(1, 5)))) for i in range(150)] + [(900, "z" * 300 + " mill"), (901, "z" * 290 + " mill")]
    asked = [(i, " ".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))) for i in range(120)] + [(900, "z" * 280 + " mill")]
    got = {r.key: (round(r.score, 9), r.id) for r in matching.likest_sharing(spark.createDataFrame(asked, "key int, said string"), spark.createDataFrame(names, "id int, name string")).collect()}
    want = {}
    for key, said in asked:
        own = {w for w in said.split(" ") if len(w) >= 3}
        found = [(-round(difflib.SequenceMatcher(None, said, name).ratio(), 9), i) for i, name in names if own & {w for w in name.split(" ") if len(w) >= 3}]
        if found and -min(found)[0] >= matching.LEAST_NAME:
            want[key] = (-min(found)[0], min(found)[1])
    assert got == want and len(got) > 50


def test_letters_bound_the_likeness():
    rng = random.Random(6)
    some = ["".join(rng.choice("abc é-") for _ in range(rng.randint(0, 30))) for _ in range(60)]
    rows = matching.bags(some)
    for i, a in enumerate(some):
        for j, b in enumerate(some):
            common = sum(m.size for m in difflib.SequenceMatcher(None, a, b).get_matching_blocks())
            assert common <= lcs(a, b) == matching.common_in_order(a, b) <= int(sum(map(min, rows[i].tolist(), rows[j].tolist())))


def test_streets_fold_as_over_all_pairs_of_a_report(spark):
    rng = random.Random(7)
    rows = []
    for r in "ab":
        heads = texts(rng, 12, 4, 14)
        rows += [(r, s, list(range(rng.randint(1, 9)))) for s in dict.fromkeys(heads + [damaged(rng, rng.choice(heads)) for _ in range(40)] + [f"EAST {n} STREET" for n in (68, 78, 68)])]
    got = {(r.report, r.street): r.canonical for r in reports.canonical_streets(spark.createDataFrame(rows, "report string, street string, numbers array<int>")).collect()}
    want = {}
    count = {(r, s): len(n) for r, s, n in rows}
    numbers = lambda s: sorted(set(re.findall(r"\b\d+\b", s)))
    for r, s in count:
        found = [(difflib.SequenceMatcher(None, t, s).ratio(), t) for q, t in count if q == r and count[q, t] > count[r, s] and numbers(t) == numbers(s)]
        best = max((f for f in found if f[0] >= 0.82), default=None)
        want[r, s] = best[1] if best else s
    for key in want:
        while want[key[0], want[key]] != want[key]:
            want[key] = want[key[0], want[key]]
    assert got == want and sum(k[1] != v for k, v in want.items()) > 10


def test_common_letters_of_a_batch():
    rng = random.Random(9)
    a, b = (["".join(rng.choice("abcé -") for _ in range(rng.randint(1, reports.WORD))) for _ in range(300)] for _ in "ab")
    a, b = [*a, "a" * reports.WORD, "x"], [*b, "a" * reports.WORD, "y"]
    assert reports.common_letters(a, b).tolist() == [lcs(x, y) for x, y in zip(a, b)]


def test_the_likest_are_those_of_all_pairs(spark, monkeypatch):
    rng = random.Random(10)
    known = list(dict.fromkeys(f"customer {rng.randint(0, 999):04} {rng.choice(['mill', 'gate'])} street" for _ in range(120)))
    asked = [(i, f"custmer {rng.randint(0, 999):04} mill  street") for i in range(40)] + [(99, "nothing"), (98, None)]
    asked.append((97, known[0].upper()))
    met, pairs = [], matching.P.like_pairs
    monkeypatch.setattr(matching.P, "like_pairs", lambda names, streets, *rest: met.append((names.count(), rest[0])) or pairs(names, streets, *rest))
    got = {(r.key, r.nth): (r.text, round(r.score, 9)) for r in matching.likest(spark.createDataFrame(asked, "key int, text string"), spark.createDataFrame([(k,) for k in known], "text string"), 0.85, 3).collect()}
    want = {}
    for key, text in asked:
        own = (text or "").strip().lower()
        scored = sorted((-2 * lcs(own, k) / (len(own) + len(k)), k) for k in known if text)
        want |= {(key, n + 1): (k, round(-s, 9)) for n, (s, k) in enumerate([x for x in scored if -x[0] >= 0.85][:3])}
    assert got == want and len(got) > 60
    assert len(met) == 2 and met[0][1] > met[1][1] == 0.85 and met[1][0] < met[0][0]


def likest_of_all(asked, names):
    told = {}
    for key, said in asked:
        own = {w for w in said.split(" ") if len(w) >= 3}
        found = [(-round(difflib.SequenceMatcher(None, said, name).ratio(), 9), i) for i, name in names if own & {w for w in name.split(" ") if len(w) >= 3}]
        if found and -min(found)[0] >= matching.LEAST_NAME:
            told[key] = (-min(found)[0], min(found)[1])
    return told


def test_texts_that_differ_in_letters_no_name_has_are_measured_once(spark, monkeypatch):
    rng = random.Random(11)
    parts = ["house", "hall", "market", "street", "gate", "é", "of", "🏠🏡 inn", "9th"]
    names = [(i, " ".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))) for i in range(60)] + [(70, "￿￿￿ lodge"), (71, "m" * 210 + " house")]
    asked = [(i, f"{100 + i} market street house") for i in range(600)] + [(700 + i, " ".join(rng.choice([*parts, "xyz", "hxll", "🏢🏠 inn", "￿￿￿", "777", "lodge"]) for _ in range(rng.randint(1, 4)))) for i in range(150)]
    asked += [(900, ""), (901, "￿￿￿ house"), (902, "777 house"), (903, "777 lodge"), (904, "house  777"), (905, "m" * 205 + " 5 house")]
    met, measured = [], matching.measured
    monkeypatch.setattr(matching, "measured", lambda pairs: met.append(pairs.count()) or measured(pairs))
    got = {r.key: (round(r.score, 9), r.id) for r in matching.likest_sharing(spark.createDataFrame(asked, "key int, said string"), spark.createDataFrame(names, "id int, name string")).collect()}
    assert got == likest_of_all(asked, names) and len(got) > 600
    assert sum(met) < 5_000, sum(met)


def test_frequent_words_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(matching, "SIDE", 7)
    rng = random.Random(12)
    some = lambda n: [(i, f"{''.join(rng.choice('abcde') for _ in range(rng.randint(2, 8)))} house{rng.choice(['', ' mill', ' gate'])}") for i in range(n)]
    asked, names = some(90), some(60)
    met, measured = [], matching.measured
    monkeypatch.setattr(matching, "measured", lambda pairs: met.append(pairs) or measured(pairs))
    got = {r.key: (round(r.score, 9), r.id) for r in matching.likest_sharing(spark.createDataFrame(asked, "key int, said string"), spark.createDataFrame(names, "id int, name string")).collect()}
    assert got == likest_of_all(asked, names) and len(got) > 50
    assert met[1].groupBy("key", "name").count().where("count > 1").isEmpty()


def test_places_of_one_name_are_met_once(spark, monkeypatch):
    given, likest = [], matching.likest_sharing
    monkeypatch.setattr(matching, "likest_sharing", lambda asked, names: given.append(names.count()) or likest(asked, names))
    known = [(i, "Chrysler Building", f"{i} Lexington Avenue, New York") for i in range(5, 500)]
    asked = [(i, "CHRYSLER BUILDING") for i in range(400)] + [(i, "Chrysler Bilding") for i in range(400, 700)]
    told = matching.match_titles(spark.createDataFrame(asked, "key int, title string"), spark.createDataFrame(known, "id int, name string, address string"))
    assert {(r.key, r.id, r.tier) for r in told.collect()} == {(i, 5, "exact_name" if i < 400 else "fuzzy_name") for i in range(700)}
    assert given == [1]


def test_addresses_of_one_first_word_are_those_of_all_pairs(spark):
    rng = random.Random(13)
    words = ["1", "12", "elm", "st", "é", "street"]
    text = lambda: " ".join([rng.choice(["1", "12", "elm"]), *(rng.choice(words) for _ in range(rng.randint(0, 3)))])
    known = [(i, None, rng.choice(["", ", "]).join([text(), rng.choice(["", "new york", "st", ",x"])])) for i in range(300)] + [(900, None, None), (901, None, ""), (902, None, ", 12 elm"), (903, None, ",")]
    asked = [(i, text()[: rng.randint(1, 12)]) for i in range(200)] + [(900, None), (901, "12 elm st é street street 1 1"), (902, "house")]
    told = matching.match_titles(spark.createDataFrame(asked, "key int, title string"), spark.createDataFrame(known, "id int, name string, address string"))
    plain = lambda s: re.sub(r"\s+", " ", re.sub(r"[',.\-()]", " ", s.lower())).strip()
    want = {}
    for key, title in asked:
        place = plain(re.sub(rf"(?i)\b({matching.KINDS})\b", "", title or "").strip())
        pairs = [(i, plain(a), plain(a.split(",")[0])) for i, _, a in known if a]
        found = [i for i, full, short in pairs if re.search(r"\d", place) and full.split(" ")[0] == place.split(" ")[0] and (full.startswith(place) or (short and place.startswith(short)))]
        if found:
            want[key] = min(found)
    assert {r.key: r.id for r in told.collect() if r.tier == "address"} == want and len(want) > 50
