"""Hybrid search: legs over one corpus each, fusion of legs, re-ranking, and the page around the hits.

A leg is one plan: pools of the nearest vectors, the best lexical and typo matches and the most famous
rows, each a top-k that Spark keeps small from the scan on; the union of their keys; a join back; and
the fused score. Only keys pass through the pools, so vectors are not dragged through the distinct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmill.functions import geo
from gridmill.functions import ranking as R
from gridmill.functions import text as T
from gridmill.operators import fusion
from gridmill.operators.keyed import best_per_key
from gridmill.sources.tables import stored

LEX_FLOOR, FUZZY_FLOOR, VECTOR_WEIGHT, LEG_FAME = 0.3, 0.2, 0.7, 0.15
FAMOUS, FAMOUS_KEPT = 1000, 40


def leg(corpus: DataFrame, query: Column, vector: DataFrame, limit: int, floor: float = LEX_FLOOR, guard: str | None = None, fame: Column | float = LEG_FAME) -> DataFrame:
    """(id, cos, lex, fame, score) of the best ``limit`` rows of a corpus (id, name, embedding, fame).

    ``vector`` is a table of one row with the column ``q``; ``guard`` asks for a whole word of it in
    lexical matches; ``fame`` is the weight of the rows' fame. Equal scores are ordered by id.
    """
    pool = fusion.pool_size(limit)
    names = corpus.select("name").distinct()  # similar names repeat, so each is compared once
    said = names.select("name", T.word_similarity(query, F.col("name")).alias("word"), T.trigram_similarity(query, F.col("name")).alias("tri"))
    scored = corpus.crossJoin(F.broadcast(vector)).select("id", "name", F.round(R.cosine(F.col("embedding"), F.col("q")), 9).alias("cos"), "fame").join(said, "name")
    rows = stored(scored, "leg")  # a few narrow columns that five branches read; vectors stay behind
    lexical = rows.where(F.col("word") > floor)
    if guard and (condition := T.word_guard(F.col("name"), guard)) is not None:
        lexical = lexical.where(condition)
    pools = [
        fusion.top(rows, pool, F.col("cos"), "id"),
        fusion.top(lexical, pool, F.col("word"), "id"),
        fusion.top(rows.where(F.col("tri") > FUZZY_FLOOR), pool, F.col("tri"), "id"),
        fusion.top(fusion.top(rows, FAMOUS, F.col("fame"), "id"), FAMOUS_KEPT, F.col("cos"), "id"),
    ]
    lex = F.greatest("word", "tri")
    found = rows.join(fusion.union_pools(pools, "id"), "id")
    scored = found.select("id", "cos", lex.alias("lex"), "fame", (VECTOR_WEIGHT * F.col("cos") + (1 - VECTOR_WEIGHT) * lex + F.lit(fame) * F.coalesce("fame", F.lit(0.0))).alias("score"))
    return fusion.top(scored, limit, F.round("score", 9), "id")


def unified(legs: dict[str, DataFrame], intent: str, limit: int) -> DataFrame:
    """(corpus, key, score) of one page over several legs of (id, score, fame, dist_m, dot, novel).

    Ranks are fused by the intent's weights, nudges are added, scores are rounded to five places; the
    page is ordered by score, corpus and rank, and cut at the relevance floor and the limit.
    """
    wanted = F.lit(intent)
    order = F.create_map(*[F.lit(x) for i, c in enumerate(R.CORPORA) for x in (c, i)])
    ranked = [fusion.ranked(df, corpus, "id", "score") for corpus, df in legs.items()]
    fused = fusion.fuse(ranked, R.corpus_weight(wanted, F.col("corpus")))
    extras = None
    for corpus, df in legs.items():
        one = df.select(F.lit(corpus).alias("corpus"), F.col("id").cast("string").alias("key"), "fame", "dist_m", "dot", "novel")
        extras = one if extras is None else extras.unionByName(one)
    hits = fused.join(extras, ["corpus", "key"])
    base = F.col("fused") * R.SCALE
    score = R.nudged(base, F.col("dot"), F.col("dist_m"), F.col("novel")) + R.soft_radius(wanted, F.col("dist_m")) + R.fame_boost(wanted, F.col("fame"))
    scored = hits.select("corpus", "key", "rank", F.round(score, 5).alias("score"), order[F.col("corpus")].alias("nth"), F.lit(1).alias("page"))
    floored = fusion.relevance_floor(scored, [F.desc("score"), F.asc("nth"), F.asc("rank")], "page")
    return floored.orderBy(F.desc("score"), "nth", "rank").limit(limit).select("corpus", "key", "score")


def header(hits: DataFrame) -> DataFrame:
    """One line about a page of hits (type, style, year): count, majority style, most common type, years."""
    total = hits.agg(F.count(F.lit(1)).alias("n"), F.min("year").alias("low"), F.max("year").alias("high"))
    style = hits.where("style IS NOT NULL").groupBy("style").agg(F.count(F.lit(1)).alias("c")).agg(F.max(F.struct("c", "style")).alias("s"))
    kind = hits.where("type IS NOT NULL").groupBy("type").agg(F.count(F.lit(1)).alias("c")).agg(F.max(F.struct("c", "type")).alias("t"))
    one = total.crossJoin(style).crossJoin(kind)  # three rows of aggregates
    noun = F.when(F.col("t.type") == "lore", "lore entries").when(F.col("t.type").endswith("s"), F.col("t.type")).when(F.col("t.type").isNull(), "results").otherwise(F.concat(F.col("t.type"), F.lit("s")))
    lead = F.concat_ws(" ", F.col("n").cast("string"), F.when(2 * F.col("s.c") > F.col("n"), F.col("s.style")), noun)
    era = F.when(F.col("low").isNull(), "").when(F.col("low") == F.col("high"), F.concat(F.lit(", "), F.col("low").cast("string"))).otherwise(F.concat(F.lit(", "), F.col("low").cast("string"), F.lit("–"), F.col("high").cast("string")))
    return one.select(F.when(F.col("n") == 0, "No results").otherwise(F.concat(lead, era)).alias("header"))


def facets(corpus: DataFrame, kinds: list[str]) -> DataFrame:
    """(kind, label, value) of the distinct values of some columns, in one pass over the corpus."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("value")) for k in kinds]))
    told = corpus.select(pairs.alias("p")).select("p.*").where("value IS NOT NULL AND value <> ''").distinct()
    return told.select("kind", T.title_label(F.col("value")).alias("label"), "value")


def chunks_by_key(chunks: DataFrame, keys: DataFrame, most: int) -> DataFrame:
    """Up to ``most`` chunks of each key (bin, name): those of its bin, else those whose name fits.

    Only chunks of the best specificity that a key has are mixed, building before district.
    """
    by_bin = keys.join(chunks, "bin").select(keys["bin"], "chunk", "specificity", "nth", F.lit(0).alias("tier"))
    missing = keys.join(chunks.select("bin").distinct(), "bin", "left_anti")
    by_name = missing.join(chunks.drop("bin"), F.lower("name") == F.lower("building_name")).select("bin", "chunk", "specificity", "nth", F.lit(1).alias("tier"))
    both = by_bin.unionByName(by_name)
    best = best_per_key(both.select("bin", "specificity").distinct(), ["bin"], F.when(F.col("specificity") == "building", 0).otherwise(1), F.asc("specificity"))
    ranked = both.join(best, ["bin", "specificity"]).withColumn("at", F.row_number().over(Window.partitionBy("bin").orderBy("nth", "chunk")))
    return ranked.where(F.col("at") <= most).select("bin", "at", "chunk", "tier")


def distance_from(lat: float, lng: float) -> Column:
    return geo.haversine(F.lit(lat), F.lit(lng), F.col("lat"), F.col("lng"))
