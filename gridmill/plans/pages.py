"""Pages of unified search for a whole table of queries, in one run.

Each corpus is read once for all queries: vectors in one pass that measures a block of queries against
every batch with one product of matrices and keeps the best of each task, names through their stored
trigram postings. What follows are windows by query over some hundred rows each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmill.functions import geo
from gridmill.functions import ranking as R
from gridmill.functions import text as T
from gridmill.operators import fusion, postings, spatial, vector_blocks
from gridmill.plans.search import FAMOUS, FAMOUS_KEPT, FUZZY_FLOOR, LEG_FAME, LEX_FLOOR, VECTOR_WEIGHT
from gridmill.sources.tables import stored

#: Queries that one pass over the vectors answers.
TOGETHER = 512


def understood(queries: DataFrame) -> DataFrame:
    """``queries`` (query_id unique, query, q, lat, lng, metres) with intent, noun and styles; metres cut for hard intents alone."""
    told = queries.withColumn("intent", R.intent(F.col("query"))).withColumn("noun", F.when(F.col("intent") == "poi", R.poi_noun(F.col("query"))))
    told = told.withColumn("styles", R.style_tokens(F.col("query"), F.col("noun")))
    return told.withColumn("cut", F.when(F.col("intent").isin(*R.HARD_RADIUS), F.col("metres")))


def arcs(lat1: np.ndarray, lng1: np.ndarray, lat2: np.ndarray, lng2: np.ndarray) -> np.ndarray:
    """Metres between every first and every second place."""
    p, q = np.radians(lat1)[:, None], np.radians(lat2)[None, :]
    x = np.sin((q - p) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin(np.radians(lng2[None, :] - lng1[:, None]) / 2) ** 2
    return 2 * geo.EARTH_M * np.arcsin(np.sqrt(np.minimum(x, 1)))


def measured(rows: DataFrame, asked: DataFrame, pool: int) -> DataFrame:
    """(query_id, id, cos, fame, near): of each query the candidates for the ``pool`` nearest rows (near) and for the FAMOUS most famous.

    ``rows`` has id, embedding, fame, lat and lng. A null vector is as like as 0. Each batch gives its best.
    """
    table = asked.select("query_id", "q", "lat", "lng", "cut").orderBy("query_id").toArrow()  # the stated queries
    ids = table.column("query_id").to_pylist()
    width = max((len(v) for v in table.column("q").to_pylist() if v), default=0)
    numbers = {c: table.column(c).to_numpy().astype(float) for c in ("lat", "lng", "cut")}
    units = np.nan_to_num(vector_blocks.matrix(table.column("q").combine_chunks(), width)) if ids else np.zeros((0, width))
    kinds = {c: asked.schema[c].dataType.simpleString() if c == "query_id" else rows.schema[c].dataType.simpleString() for c in ("query_id", "id")}
    out = None
    for a in range(0, max(1, len(ids)), TOGETHER):
        part = slice(a, a + TOGETHER)
        sent = rows.sparkSession.sparkContext.broadcast((ids[part], units[part], *(numbers[c][part] for c in ("lat", "lng", "cut"))))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, units, lat, lng, cut = sent.value
            for batch in batches:
                own = np.array(batch.column("id").to_pylist())
                fame = np.array([-np.inf if f is None else f for f in batch.column("fame").to_pylist()])
                cos = np.round(units @ np.nan_to_num(vector_blocks.matrix(batch.column("embedding"), units.shape[1])).T, vector_blocks.PLACES)
                place = [np.array(batch.column(c).to_numpy(zero_copy_only=False), float) for c in ("lat", "lng")]
                far = arcs(lat, lng, *place) > cut[:, None]
                far |= ~np.isnan(cut)[:, None] & np.isnan(place[0] + place[1])[None, :]
                told: tuple[list, ...] = ([], [], [], [], [])
                for k, query in enumerate(ids):
                    fits = np.flatnonzero(~far[k])
                    near = fits[np.lexsort((own[fits], -cos[k, fits]))[:pool]]
                    famous = fits[np.lexsort((own[fits], -fame[fits]))[:FAMOUS]]
                    for chosen, is_near in ((near, True), (famous, False)):
                        for column, values in zip(told, ([query] * len(chosen), own[chosen].tolist(), cos[k, chosen].tolist(), [None if f == -np.inf else f for f in fame[chosen].tolist()], [is_near] * len(chosen))):
                            column.extend(values)
                yield pa.RecordBatch.from_arrays([pa.array(told[0], table.schema.field("query_id").type), pa.array(told[1], batch.column("id").type), pa.array(told[2], pa.float64()), pa.array(told[3], pa.float64()), pa.array(told[4], pa.bool_())], names=["query_id", "id", "cos", "fame", "near"])

        found = rows.select("id", "embedding", "fame", "lat", "lng").mapInArrow(run, f"query_id {kinds['query_id']}, id {kinds['id']}, cos double, fame double, near boolean")
        out = found if out is None else out.unionByName(found)
    return out


def first_rows(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows of each query; Spark keeps n of a query in each task."""
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("_nth") <= n).drop("_nth")


def likenesses(names: postings.Postings, asked: DataFrame) -> DataFrame:
    """What ``legs`` takes as ``like``, of an index that may hold the names of several corpora."""
    return stored(postings.search(names, asked, LEX_FLOOR, FUZZY_FLOOR), "likenesses")


def legs(rows: DataFrame, like: DataFrame, asked: DataFrame, limit: int, famed: bool) -> DataFrame:
    """The best ``limit`` rows of one corpus for each query: all its columns but the vector, with query_id, dist_m and score.

    As ``search.leg`` finds them for one query. ``famed`` corpora add the rows' fame for intents that ask for it.
    """
    pool = fusion.pool_size(limit)
    found = stored(measured(rows, asked, pool), "measured")
    near = first_rows(found.where("near"), pool, F.desc("cos"), F.asc("id"))
    famous = first_rows(first_rows(found.where("NOT near"), FAMOUS, F.desc_nulls_last("fame"), F.asc("id")), FAMOUS_KEPT, F.desc("cos"), F.asc("id"))
    dist = geo.haversine(F.col("at_lat"), F.col("at_lng"), F.col("lat"), F.col("lng"))
    at = asked.select("query_id", "query", "intent", "q", "cut", F.col("lat").alias("at_lat"), F.col("lng").alias("at_lng"))
    told = rows.select("id", "name", "lat", "lng").join(like, "name").join(at.drop("query", "q"), "query_id").where(F.col("cut").isNull() | (dist <= F.col("cut")))
    told = stored(told.select("query_id", "id", "word", "tri"), "like")
    pools = [near, famous, first_rows(told.where(F.col("word") > LEX_FLOOR), pool, F.desc("word"), F.asc("id")), first_rows(told.where(F.col("tri") > FUZZY_FLOOR), pool, F.desc("tri"), F.asc("id"))]
    ids = reduce(DataFrame.unionByName, [p.select("query_id", "id") for p in pools]).distinct()
    hits = rows.join(ids, "id").join(at, "query_id")
    cos = F.round(R.cosine(F.col("embedding"), F.col("q")), vector_blocks.PLACES)
    hits = hits.withColumn("lex", F.greatest(T.word_similarity(F.col("query"), F.col("name")), T.trigram_similarity(F.col("query"), F.col("name"))))
    fame = F.when(F.col("intent").isin(*R.FAME_INTENTS) & F.lit(famed), LEG_FAME).otherwise(0.0) * F.coalesce("fame", F.lit(0.0))
    scored = hits.withColumn("score", VECTOR_WEIGHT * cos + (1 - VECTOR_WEIGHT) * F.col("lex") + fame).withColumn("dist_m", dist)
    return first_rows(scored, limit, F.desc(F.round("score", 9)), F.asc("id")).drop("embedding", "q", "lex", "cut", "at_lat", "at_lng", "query", "intent")


def pages(found: dict[str, DataFrame], asked: DataFrame, limit: int) -> DataFrame:
    """(query_id, corpus, key, name, score, why) of the page of each query, from the legs of each corpus.

    A leg has id, name, score, style, category, labels, architect, snippet, year, lat, lng, dist_m, fame,
    dot and novel. For a place noun, what category, style and name say of a venue counts twice: in the
    venue's own score, which its rank follows, and again in the fused one. All terms are added, scores
    are rounded to five places, near-identical hits of one name fall together, and the relevance floor
    and the limit cut. Equal scores are ordered by corpus, then rank.
    """
    query, intent, noun, styles = (F.col(c) for c in ("query", "intent", "noun", "styles"))
    rows = reduce(DataFrame.unionByName, [df.withColumns({"corpus": F.lit(c), "nth": F.lit(i), "key": F.col("id").cast("string")}).drop("id") for i, (c, df) in enumerate(found.items())])
    rows = stored(rows, "legs").join(F.broadcast(asked.select("query_id", "query", "intent", "noun", "styles")), "query_id")
    fits = R.poi_category(F.col("category"), noun, F.col("labels")) + R.venue_style(styles, F.col("style"), F.col("year")) + R.style_decoy(query, F.col("name"), F.col("category"), noun)
    poi = F.when((F.col("corpus") == "venues") & noun.isNotNull(), F.round(fits, 9)).otherwise(0.0)
    told = rows.withColumn("poi", poi).withColumn("score", F.round(F.col("score") + F.col("poi"), 9))
    rank = F.row_number().over(Window.partitionBy("query_id", "corpus").orderBy(F.desc("score"), F.asc_nulls_last("key")))
    told = stored(told.withColumn("rank", rank).where("key IS NOT NULL"), "ranked")  # cuts the plan of the rules in two
    score = R.nudged(R.corpus_weight(intent, F.col("corpus")) / (R.K + F.col("rank")) * R.SCALE, F.col("dot"), F.col("dist_m"), F.col("novel"))
    score += F.coalesce(R.soft_radius(intent, F.col("dist_m")), F.lit(0.0)) + R.fame_boost(intent, F.col("fame"))
    score += F.when(intent == "name", R.exact_name(query, F.col("name"))).otherwise(0.0)
    score += F.when(intent == "architect", R.architect_match(query, F.col("architect"))).otherwise(0.0)
    score += F.when(intent.isin("name", "address") & (F.col("corpus") == "buildings"), R.house_number(query, F.col("name"), F.col("snippet"))).otherwise(0.0)
    score += F.col("poi") + R.coverage(intent, query, F.col("name"), F.col("snippet"), F.col("category"), F.col("style")) + R.hedged_style(styles, F.col("style"))
    field = R.matched_field(query, F.col("name"), F.col("style"), F.col("architect"), F.col("category"))
    why = R.why(field, F.col("year"), F.col("style"), F.col("category"), F.col("snippet"))
    scored = told.select("query_id", "corpus", "key", "name", "lat", "lng", "rank", "nth", F.round(score, 5).alias("score"), why.alias("why"), T.normal_name(F.col("name")).alias("norm_name"))
    best = (F.desc("score"), F.asc("nth"), F.asc("rank"))
    placed = stored(scored.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy(*best))), "scored")
    floored = fusion.relevance_floor(spatial.collapse_near(placed, page="query_id"), list(best), "query_id")
    return first_rows(floored, limit, *best).select("query_id", "corpus", "key", "name", "score", "why")
