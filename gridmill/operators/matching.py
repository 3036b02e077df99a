"""Titles and addresses matched to known places: by name, by likeness, by address."""

from __future__ import annotations

import difflib
import functools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmill.functions import reports as P
from gridmill.operators.keyed import best_per_key
from gridmill.sources.tables import stored

# Words that a title has besides an address, the least likeness of names, the score of an address.
KINDS = "house|building|hall|club|church|school|library|hotel|theater|theatre|apartments|museum|center|centre|station|tower|plaza|complex|chapel|synagogue|temple|convent|rectory|stable|garage|factory|warehouse|loft"
LEAST_NAME, ADDRESS_SCORE = 0.55, 0.9


def plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(F.lower(text), "',.-()", " " * 6), r"\s+", " "))


def long_words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, " "), lambda w: F.length(w) >= 3))


#: Letters that a bag counts one by one; all others share one more place. A count stops at 255, which only raises a bound.
LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789 "


def bags(texts: list[str]) -> np.ndarray:
    """How often each letter stands in each text."""
    out = np.zeros((len(texts), len(LETTERS) + 1), np.uint8)
    for row, text in zip(out, texts):
        counts = [text.count(c) for c in LETTERS]
        row[:] = np.minimum(255, [*counts, len(text) - sum(counts)])
    return out


def with_bag(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``bag_<text>``, the letter counts of a column as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = bags(batch.column(batch.schema.names.index(text)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r.tobytes() for r in rows], pa.binary())], names=[*batch.schema.names, f"bag_{text}"])

    return df.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", bag_{text} binary")


@functools.lru_cache(4096)
def places_of(text: str) -> dict[str, int]:
    """The places of each letter as bits."""
    out: dict[str, int] = {}
    for i, c in enumerate(text):
        out[c] = out.get(c, 0) | 1 << i
    return out


def common_in_order(a: str, b: str) -> int:
    """The length of the longest common subsequence, a machine word of ``a`` at a time."""
    places, full = places_of(a), (1 << len(a)) - 1
    rest = full
    for c in b:
        met = rest & places.get(c, 0)
        rest = (rest + met | rest - met) & full
    return len(a) - rest.bit_count()


def measured(pairs: DataFrame) -> DataFrame:
    """(key, id, score) of the pairs (key, said, id, name, floor, bag_said, bag_name) that may be the likest of their key.

    Matching blocks are a common subsequence, and that is no longer than the letters that both texts
    have. So letter counts bound the likeness for a whole batch at once, subsequences bound what is
    left, and only pairs that may reach their floor, and the best of their key so far, are measured.
    """
    kinds = [pairs.schema[c].dataType.simpleString() for c in ("key", "id")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict = {}
        for batch in batches:
            own, other = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("bag_said", "bag_name"))
            total = sum(pc.utf8_length(batch.column(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("said", "name"))
            bound = np.minimum(own, other).sum(axis=1, dtype=np.int64)
            # A letter counted 255 times may stand there more often.
            bound = np.where((own == 255).any(axis=1) & (other == 255).any(axis=1), total // 2, bound)
            share = 2 * bound / np.maximum(total, 1)
            order = np.argsort(-share, kind="stable")
            order = order[share[order] >= batch.column("floor").to_numpy()[order] - 1e-9]
            kept, out = batch.take(pa.array(order)), ([], [], [])
            for key, said, id_, name, floor, most in zip(*(kept.column(c).to_pylist() for c in ("key", "said", "id", "name", "floor")), share[order].tolist()):
                floor = max(floor, best.get(key, 0.0))
                if most < floor - 1e-9 or 2 * common_in_order(said, name) < (floor - 1e-9) * (len(said) + len(name)):
                    continue
                score = difflib.SequenceMatcher(None, said, name).ratio()
                if score >= floor:
                    best[key] = score
                    for column, value in zip(out, (key, id_, score)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], batch.column("key").type), pa.array(out[1], batch.column("id").type), pa.array(out[2], pa.float64())], names=["key", "id", "score"])

    return pairs.select("key", "said", "id", "name", "floor", "bag_said", "bag_name").mapInArrow(run, f"key {kinds[0]}, id {kinds[1]}, score double")


#: Stands for each letter of a text that no name it is compared with has.
HIDDEN = "\uffff"
#: Texts, and names, of one word that meet in one block.
SIDE = 128


def hidden(text: Column, letters: Column) -> Column:
    """``text`` with HIDDEN for what is not among ``letters``; as it is if HIDDEN is one of them."""
    shown = F.transform(F.split(text, ""), lambda c: F.when(F.array_contains(letters, c), c).otherwise(HIDDEN))
    return F.when(F.array_contains(letters, HIDDEN), text).otherwise(F.array_join(shown, ""))


def folded(asked: DataFrame, counts: DataFrame) -> DataFrame:
    """(said, own, alike, group) of the distinct texts that share a word with a name.

    ``own`` are the shared words. Likeness only asks where two texts have equal letters, so those that
    no name with a shared word has may all be one: ``alike`` is the text with them hidden, and texts
    that differ in nothing else, for one in their numbers, are of one ``group``.
    """
    dealt = asked.select("said").repartition(4 * asked.sparkSession.sparkContext.defaultParallelism, "said")
    words = dealt.distinct().withColumn("word", F.explode(long_words(F.col("said")))).join(counts.select("word", "letters"), "word")
    shared = words.groupBy("said").agg(F.array_sort(F.collect_set("word")).alias("own"), F.array_distinct(F.flatten(F.collect_set("letters"))).alias("letters"))
    told = shared.select("said", "own", hidden(F.col("said"), F.col("letters")).alias("alike"))
    return told.withColumn("group", F.concat(F.array_join("own", " "), F.lit("  "), "alike"))  # no word is empty or has a space


def blocks(texts: DataFrame, names: DataFrame, counts: DataFrame) -> DataFrame:
    """All pairs of ``texts`` and ``names`` over each word of ``own`` and ``words``, in blocks of about SIDE by SIDE, so that no frequent word is one task."""
    tasks = 4 * texts.sparkSession.sparkContext.defaultParallelism
    left, right = texts.withColumn("word", F.explode("own")), names.withColumn("word", F.explode("words"))
    shares = left.groupBy("word").agg(F.ceil(F.count(F.lit(1)) / SIDE).alias("rows")).join(counts.select("word", F.ceil(F.col("often") / SIDE).alias("columns")), "word")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = left.join(shares, "word").select(*left.columns, F.pmod(F.xxhash64("key"), "rows").alias("row"), each("columns").alias("column"))
    right = right.join(shares, "word").select(*right.columns, F.pmod(F.xxhash64("name"), "columns").alias("column"), each("rows").alias("row"))
    place = ["word", "row", "column"]
    return left.repartition(tasks, *place).join(right.repartition(tasks, *place), place)


def likest_sharing(asked: DataFrame, names: DataFrame, least: float = LEAST_NAME) -> DataFrame:
    """(key, id, score): of the names (id, name) that share a word of three letters with a text (key, said) the likest, of ``least`` or more.

    Texts that are alike to all names they meet are measured once. Each is first measured with up to four
    names of its rarest shared word; the best of these is its floor. All other names that share a word are
    met then, but only those whose length and letters may reach the floor are measured. Ties go to the
    lowest id.
    """
    names = stored(with_bag(names.groupBy("name").agg(F.min("id").alias("id")).withColumn("words", long_words(F.col("name"))), "name"), "names")  # a name is compared once
    listed = names.select("name", F.explode("words").alias("word"))
    order = F.xxhash64("name")
    some = F.array_distinct(F.array(F.min("name"), F.max("name"), F.min_by("name", order), F.max_by("name", order)))
    letters = listed.select("word", F.explode(F.array_distinct(F.split("name", ""))).alias("letter")).distinct().groupBy("word").agg(F.collect_set("letter").alias("letters"))
    counts = stored(listed.groupBy("word").agg(F.count(F.lit(1)).alias("often"), some.alias("some")).join(letters, "word"), "counts")
    told = stored(folded(asked, counts), "folded")
    texts = stored(with_bag(told.select(F.col("group").alias("key"), "own", F.col("alike").alias("said")).distinct(), "said"), "texts")
    rarest = texts.select("key", F.explode("own").alias("word")).join(counts, "word").groupBy("key").agg(F.min_by("some", F.struct("often", "word")).alias("some"))
    tried = rarest.select("key", F.explode("some").alias("name")).join(names, "name").join(texts, "key").withColumn("floor", F.lit(least))
    tasks = 4 * asked.sparkSession.sparkContext.defaultParallelism  # pairs are few bytes, their likeness is slow
    first = stored(measured(tried.repartition(tasks, "key")).groupBy("key").agg(F.max("score").alias("floor")), "floors")
    n, m = F.length("said"), F.length("name")
    floors = texts.join(first, "key", "left").withColumn("floor", F.coalesce("floor", F.lit(least)))
    met = blocks(floors, names, counts).where(2 * F.least(n, m) >= (F.col("floor") - 1e-9) * (n + m))
    # A pair is met once, over the first word that both have.
    once = met.where(F.col("word") == F.element_at(F.array_intersect("own", "words"), 1))
    # Stored, so its size is known: where it is small it goes to all texts, of which one group may have most.
    best = stored(best_per_key(measured(once), ["key"], F.desc("score"), F.asc("id")).withColumnRenamed("key", "group"), "best")
    return asked.select("key", "said").join(told.select("said", "group").join(best, "group"), "said").select("key", "id", "score")


def addressed(places: DataFrame, addresses: DataFrame) -> DataFrame:
    """(word, place, id): for each place (word, place) the lowest id of the addresses (id, word, full, short) of its first word that begin with it, or whose short form it begins with.

    Beginnings are cut to the lengths that the other side has for the word, and meet as equal texts.
    """
    places = places.select("word", "place").distinct()
    cut = lambda text: F.col(text).substr(F.lit(1), F.col("size"))
    asked = addresses.join(places.select("word", F.length("place").alias("size")).distinct(), "word").where(F.col("size") <= F.length("full"))
    longer = places.join(asked.groupBy("word", cut("full").alias("place")).agg(F.min("id").alias("id")), ["word", "place"])
    shorts = addresses.where("short <> ''").groupBy("word", "short").agg(F.min("id").alias("id"))
    own = places.join(shorts.select("word", F.length("short").alias("size")).distinct(), "word").where(F.col("size") <= F.length("place"))
    shorter = own.select("word", "place", cut("place").alias("short")).join(shorts, ["word", "short"]).select("word", "place", "id")
    return longer.unionByName(shorter).groupBy("word", "place").agg(F.min("id").alias("id"))


def match_titles(asked: DataFrame, known: DataFrame) -> DataFrame:
    """(key, id, tier, score) of the titles (key, title) that match a known place (id, name, address), by the first tier that does.

    ``exact_name``: the same name; ``fuzzy_name``: the likest name of LEAST_NAME or more among those that
    share a word of three letters; ``address``: an address that begins with what the title says, or that
    the title begins with, where both begin with the same word and the title has a number. Ties go to the
    lowest id. Only texts whose lengths allow the likeness are compared.
    """
    # Patterns cost more than all joins: a text is cleaned once, not again in each branch and filter.
    titles = stored(asked.select("key", plain(F.col("title")).alias("said"), plain(F.trim(F.regexp_replace("title", rf"(?i)\b({KINDS})\b", ""))).alias("place")), "titles")
    address = F.when(F.col("address") != "", F.col("address"))
    places = stored(known.select("id", plain(F.col("name")).alias("name"), plain(address).alias("full"), plain(F.substring_index(address, ",", 1)).alias("short")), "places")
    names = places.where("name <> ''").groupBy("name").agg(F.min("id").alias("id"))  # many places may have one name
    same = titles.join(names, F.col("said") == F.col("name")).groupBy("key").agg(F.min("id").alias("id"))
    exact = stored(same.select("key", "id", F.lit("exact_name").alias("tier"), F.lit(1.0).alias("score")), "exact")

    left = stored(titles.join(exact, "key", "left_anti"), "titles-left")
    fuzzy = stored(likest_sharing(left.select("key", "said"), names).select("key", "id", F.lit("fuzzy_name").alias("tier"), "score"), "fuzzy")

    first_word = lambda c: F.substring_index(c, " ", 1).alias("word")
    left = left.join(fuzzy, "key", "left_anti").where(F.col("place").rlike(r"\d")).select("key", "place", first_word("place"))
    addresses = places.where("full IS NOT NULL").select("id", "full", "short", first_word("full"))
    found = left.join(addressed(left, addresses), ["word", "place"])
    address = found.groupBy("key").agg(F.min("id").alias("id")).select("key", "id", F.lit("address").alias("tier"), F.lit(ADDRESS_SCORE).alias("score"))
    return reduce(DataFrame.unionByName, (exact, fuzzy, address))


#: Shares of the unlikeness allowed that are tried one after another.
STEPS = (0.6, 1.0)


def likest(asked: DataFrame, known: DataFrame, least: float = 0.9, most: int = 10) -> DataFrame:
    """(key, text, nth, score): for each asked text (key, text) the ``most`` likest known ones (text) of ``least`` or more.

    Likeness counts what insertions and deletions leave alike, blind to case; pairs meet on shared runs
    of letters, so no text is compared with all others. The nearest are sought first: a text that has
    ``most`` of a higher likeness needs no others, and only the rest meet under the next lower one.
    """
    cleaned = lambda df: df.withColumn("text", F.lower(F.trim("text")))
    own, other = cleaned(asked), cleaned(known).select("text").distinct()
    names, streets = stored(own.select(F.col("text").alias("name")).distinct(), "asked"), stored(other.select(F.col("text").alias("street")), "known")
    found, left = [], names
    for share in STEPS:
        pairs = stored(P.like_pairs(left, streets, 1 - (1 - least) * share, P.edit_ratio, "."), "alike")
        if share == STEPS[-1]:
            found.append(pairs)
            break
        done = pairs.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= most).select("name")
        found.append(pairs.join(done, "name", "left_semi"))
        left = stored(left.join(done, "name", "left_anti"), "asked-on")
    near = reduce(DataFrame.unionByName, found)
    same = own.join(other, "text").select("key", "text", F.lit(1.0).alias("score"))
    pairs = own.select("key", F.col("text").alias("name")).join(near, "name").select("key", F.col("street").alias("text"), F.col("like").alias("score")).unionByName(same)
    ranked = pairs.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "text")))
    return ranked.where(F.col("nth") <= most).select("key", "text", "nth", "score")
