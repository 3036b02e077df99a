"""Text pipelines: pages, keys of pages, chunks, names, addresses, dates and rules, on pages and documents."""

from __future__ import annotations


from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridmill.functions import profiles
from gridmill.functions import text as T
from gridmill.operators import chunking, keyed
from gridmill.queries.base import load



def page_text(spark: SparkSession, d: str) -> DataFrame:
    """STR16, SRC9: text of the pages that pass the gates, with its length and hash."""
    pages = load(spark, d, "pages").where(~F.col("url").rlike(r"(?i)\.pdf$|instagram\.com|youtube\.com") & (F.octet_length("html") <= 2_000_000))
    text = T.flatten_html(F.col("html"))
    return pages.select("page_id", text.alias("text")).where("length(text) >= 400").select("page_id", F.length("text").alias("chars"), F.md5("text").alias("hash"))


def page_identity(spark: SparkSession, d: str) -> DataFrame:
    """STR27, W7, X11: the first page of each identity, in page order."""
    rows = load(spark, d, "pages").select("page_id", T.url_key(F.col("url")).alias("key"))
    return keyed.best_per_key(rows, ["key"], F.asc("page_id"))


def char_chunks(spark: SparkSession, d: str) -> DataFrame:
    """STR19: overlapping chunks of 1,500 characters of cleaned texts that end at a break in their second half."""
    docs = load(spark, d, "documents").select("doc_id", T.clean_report(F.col("text")).alias("text"))
    return chunking.chunks(docs, "doc_id", "text", chunking.by_characters).select("doc_id", "nth", F.length("chunk").alias("chars"), F.md5("chunk").alias("hash"))


def page_chunks(spark: SparkSession, d: str) -> DataFrame:
    """STR20: chunks of 2,000 characters with an overlap of 200, ends at sentences, over 100 characters."""
    docs = load(spark, d, "documents").select("doc_id", "text")
    return chunking.chunks(docs, "doc_id", "text", chunking.by_pages).select("doc_id", "nth", F.length("chunk").alias("chars"), F.md5("chunk").alias("hash"))


def word_chunks(spark: SparkSession, d: str) -> DataFrame:
    """STR21: chunks of whole words of at most 1,500 characters."""
    docs = load(spark, d, "documents").select("doc_id", "text")
    return chunking.chunks(docs, "doc_id", "text", chunking.by_words).select("doc_id", "nth", F.length("chunk").alias("chars"), F.md5("chunk").alias("hash"))


def source_budget(spark: SparkSession, d: str) -> DataFrame:
    """STR18: texts of each source in order while 7,000 characters last; a rest under 200 is not used."""
    rows = load(spark, d, "documents").select("source", "doc_id", F.length("text").alias("chars"), F.floor(F.col("doc_id") / 1024).alias("run"))
    # Runs of ids are summed first, so only the few runs in which a source's budget ends are put in order.
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("source", "run").agg(F.sum("chars").alias("all"))
    ahead = totals.select("source", "run", F.coalesce(F.sum("all").over(before.partitionBy("source").orderBy("run")), F.lit(0)).alias("ahead")).where("ahead <= 7000")
    left = 7000 - F.col("ahead") - F.coalesce(F.sum("chars").over(before.partitionBy("source", "run").orderBy("doc_id")), F.lit(0))
    return rows.join(ahead, ["source", "run"]).withColumn("left", left).where((F.col("left") >= F.col("chars")) | (F.col("left") >= 200)).select("source", "doc_id", F.least("chars", "left").alias("used"))


def sentences_trimmed(spark: SparkSession, d: str) -> DataFrame:
    """STR17, STR30: texts cut at a sentence before 1,000 characters, and whether they are complete prose."""
    cut = T.trim_to_sentence(F.col("text"), 1000)
    return load(spark, d, "documents").select("doc_id", cut.alias("cut")).select("doc_id", F.length("cut").alias("chars"), F.md5("cut").alias("hash"), T.complete_prose(F.col("cut")).alias("complete"))


def sections(spark: SparkSession, d: str) -> DataFrame:
    """STR22: of each text, given headings by halves, the part between them; every third has none and starts later."""
    k, half = F.col("doc_id"), F.floor(F.length("text") / 2).cast("int")
    said = F.when(k % 3 == 0, F.col("text")).otherwise(F.concat(F.substring(F.col("text"), F.lit(1), half), F.lit(" HISTORY "), F.substring(F.col("text"), half + 1, F.length("text")), F.lit(" SOURCES x")))
    told = profiles.section(F.col("said"), "history ", "sources ")
    return load(spark, d, "documents").select("doc_id", said.alias("said")).select("doc_id", told.alias("part")).select("doc_id", F.length("part").alias("chars"), F.md5("part").alias("hash"))


def quality_filter(spark: SparkSession, d: str) -> DataFrame:
    """F13, STR23: prose before a sources marker, of 100 to 800 characters and without boilerplate."""
    at = F.least(*[F.when(F.locate(m, F.lower("text")) > 0, F.locate(m, F.lower("text"))).otherwise(F.length("text") + 1) for m in ("sources:", "facts:")])
    prose = load(spark, d, "documents").select("doc_id", F.substring(F.col("text"), F.lit(1), at - 1).alias("prose"))
    return prose.where(F.length("prose").between(100, 800) & ~F.col("prose").rlike("(?i)copyright|licen[cs]e")).select("doc_id", F.length("prose").alias("chars"))


NAMED = [("part", "p_partkey", "p_name", "p_brand", "p_type"), ("supplier", "s_suppkey", "s_name"), ("customer", "c_custkey", "c_name", "c_mktsegment")]


def names(spark: SparkSession, d: str) -> DataFrame:
    """STR1, STR2: tokens and normal names of every part, supplier and customer."""
    said = [load(spark, d, t).select(F.lit(t).alias("kind"), F.col(k).alias("key"), F.concat_ws("  ", *own).alias("said")) for t, k, *own in NAMED]
    return reduce(DataFrame.unionByName, said).select("kind", "key", F.array_join(T.tokens(F.col("said")), " ").alias("tokens"), T.normal_name(F.col("said")).alias("name"))


def names_whole(spark: SparkSession, d: str) -> DataFrame:
    """STR1, STR2: number and hash of the tokens, and hash of the normal name, of whole texts."""
    told = load(spark, d, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"), T.normal_name(F.col("text")).alias("name"))
    return told.select("doc_id", F.size("t").alias("n"), F.md5(F.array_join("t", " ")).alias("tokens"), F.md5("name").alias("name"))


CASES = [
    ("1 South First Street", "1 south 1st street", 1, "1st,south", "1"),
    ("469-475 Broome St", "469-475 broome st", 469, "469-475,broome", "469,471,473,475"),
    ("twenty-third of May Ave", "23rd of may ave", -1, "23rd,may,of", None),
    ("10-13 Elm Rd", "10-13 elm rd", 10, "10-13,elm", "10,13"),
    ("2-200 Long Way", "2-200 long way", 2, "2-200,long", "2"),
    ("", "", -1, "", None),
]


def addresses(spark: SparkSession, d: str) -> DataFrame:
    """STR3, STR4, STR5, STR6, STR11: folded ordinals, house numbers, street words and expanded ranges."""
    rows = spark.createDataFrame([(c[0],) for c in CASES], "address string")
    r = T.house_range(F.col("address"))
    numbers = F.array_join(F.when(r.isNotNull(), T.expand_house_range(r["low"], r["high"])).cast("array<string>"), ",")
    return rows.select("address", T.fold_ordinals(F.col("address")).alias("folded"), F.coalesce(T.house_number(F.col("address")), F.lit(-1)).alias("number"), F.array_join(F.sort_array(T.street_tokens(F.col("address"))), ",").alias("street"), numbers.alias("numbers"))


DATES = [("1931-05-01", "1931-05-01", "12", "12"), ("5/1/1931", "1931-05-01", "1,234.0", "1234"), ("5-1-1931", "1931-05-01", "x", None), ("1931/5/1", "1931-05-01", "7.9", "7"), ("May 1, 1931", "1931-05-01", "", None), ("spring", None, None, None)]


def dates_and_numbers(spark: SparkSession, d: str) -> DataFrame:
    """STR31, STR32: free-form dates and numbers."""
    rows = spark.createDataFrame([(c[0], c[2]) for c in DATES], "said string, n string")
    return rows.select("said", T.any_date(F.col("said")).cast("string").alias("day"), "n", T.number(F.col("n"), "int").cast("string").alias("number"))


def materials(spark: SparkSession, d: str) -> DataFrame:
    """The first rule that fits names a material; the score has defaults."""
    style, year = F.lower("p_name"), 1850 + F.col("p_partkey") % 150
    rule = F.when(style.contains("red"), "brick").when(style.contains("steel") | style.contains("blue"), "steel").when((year < 1900) & (F.col("p_type") == "ECONOMY"), "wood").when(year < 1940, "limestone").otherwise("concrete")
    score = F.coalesce(F.when(F.col("p_partkey") % 3 == 0, F.col("p_size") * 1.0), F.when(F.col("p_type") == "PROMO", 5.0).otherwise(1.0))
    return load(spark, d, "part").select("p_partkey", rule.alias("material"), score.alias("final_score"))


def embedding_checks(spark: SparkSession, d: str) -> DataFrame:
    """F19, STR34: valid vectors, a profile in a fixed order from a JSON object, decoded masks."""
    order = ["a", "b", "c"]
    keyed_ = F.concat(F.lit('{"a":'), F.col("vec_id").cast("string"), F.lit(',"c":2'), F.when(F.col("vec_id") % 2 == 0, ',"b":1}').otherwise("}"))
    parsed = F.from_json(keyed_, "map<string,double>")
    profile = F.transform(F.array(*map(F.lit, order)), lambda k: parsed[k])
    whole = F.when(~F.exists(profile, lambda x: x.isNull()), F.array_join(F.transform(profile, lambda x: x.cast("int").cast("string")), ","))
    return load(spark, d, "embeddings").select("vec_id", (F.size("embedding") == 64).alias("valid"), whole.alias("profile"), F.decode(F.unbase64(F.base64(F.col("vec_id").cast("string").cast("binary"))), "UTF-8").alias("mask"))


QUERIES = {f.__name__: f for f in (page_text, page_identity, char_chunks, page_chunks, word_chunks, source_budget, sentences_trimmed, sections, quality_filter, names, names_whole, addresses, dates_and_numbers, materials, embedding_checks)}


def quoted(value) -> str:
    return "NULL" if value is None else str(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"


def values(rows: list[tuple], columns: str) -> str:
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows) + f") AS t({columns})"


def sql_map(table: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in table.items()) + "}"


def unescaped(text: str) -> str:
    """Entities resolved piece by piece behind each ampersand; numeric ones by their code."""
    names, old = sql_map({k: v for k, v in T.ENTITIES.items() if len(k) <= 9}), sql_map(T.OLD_ENTITIES)
    said = r"regexp_extract(x, '^([^\t\n\f <#;]{1,32};)', 1)".replace("\\", "\\")
    begun = f"regexp_extract(x, '^({'|'.join(T.OLD_ENTITIES)})', 1)"
    number = "regexp_extract(x, '^#([0-9]+);?', 1)"
    piece = f"""CASE WHEN {number} <> '' THEN chr({number}::INT) || regexp_replace(x, '^#[0-9]+;?', '') WHEN {names}[{said}] IS NOT NULL THEN {names}[{said}] || substr(x, length({said}) + 1)
        WHEN {begun} <> '' THEN {old}[{begun}] || substr(x, length({begun}) + 1) ELSE '&' || x END"""
    return f"(string_split({text}, '&')[1] || array_to_string(list_transform(string_split({text}, '&')[2:], lambda x: {piece}), ''))"


STRIPPED = "html"
for tag in ("script", "style", "noscript", "svg", "nav", "header", "footer", "form", "aside"):
    STRIPPED = rf"regexp_replace({STRIPPED}, '<{tag}[^>]*>.*?</{tag}>', ' ', 'gis')"
FLAT = unescaped(rf"regexp_replace(regexp_replace(regexp_replace({STRIPPED}, '</(p|div|li|h[1-6]|tr|section|article)>', chr(10), 'gi'), '<br\s*/?>', chr(10), 'gi'), '<[^>]+>', ' ', 'g')")
FLAT = rf"regexp_replace(regexp_replace(regexp_replace({FLAT}, '[ \t\r\f\x0B]+', ' ', 'g'), '\n\s*\n\s*\n+', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"

def rfind(text: str, mark: str) -> str:
    """Where a mark stands last, from 0, or -1."""
    return f"CASE WHEN contains({text}, {mark}) THEN length({text}) - instr(reverse({text}), reverse({mark})) - length({mark}) + 1 ELSE -1 END"


def chunks_sql(text: str, size: int, overlap: int, marks: list[tuple[str, int, int]], to_the_end: bool, keep: str) -> str:
    """Chunks by recursion from each start to the next; marks are (mark, its length, characters kept)."""
    breaks = " ".join(f"WHEN p{i} > {size} / 2 THEN a + p{i} + {kept}" for i, (_, _, kept) in enumerate(marks))
    found = ", ".join(f"{rfind(f'substr(t, a + 1, {size})', mark)} AS p{i}" for i, (mark, _, _) in enumerate(marks))
    stop = lambda source: f"SELECT *, CASE WHEN a + {size} >= n THEN a + {size} {breaks} ELSE a + {size} END AS b FROM (SELECT *, {found} FROM ({source}))"
    names = "doc_id, t, n, a"
    on = "c.b < c.n" if to_the_end else f"greatest(c.b - {overlap}, c.a + 1) < c.n"
    return rf"""WITH RECURSIVE d AS (SELECT doc_id, {text} AS t, length({text})::BIGINT AS n FROM documents WHERE length({text}) > 0),
        c AS (SELECT {names}, b FROM ({stop('SELECT doc_id, t, n, 0::BIGINT AS a FROM d')}) UNION ALL SELECT {names}, b FROM ({stop(f'SELECT c.doc_id, c.t, c.n, greatest(c.b - {overlap}, c.a + 1) AS a FROM c WHERE {on}')})),
        k AS (SELECT doc_id, a, regexp_replace(substr(t, a + 1, b - a), '^\s+|\s+$', '', 'g') AS chunk FROM c)
        SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1)::INT AS nth, length(chunk)::INT AS chars, md5(chunk) AS hash FROM k WHERE {keep}"""


ORACLE = {
    "page_text": rf"SELECT page_id, length(t)::INT AS chars, md5(t) AS hash FROM (SELECT page_id, {FLAT} AS t FROM pages WHERE NOT regexp_matches(url, '(?i)\.pdf$|instagram\.com|youtube\.com') AND strlen(html) <= 2000000) WHERE length(t) >= 400",
    "page_identity": r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(lower(trim(url)), '/+$', ''), '[#?].*$', '') AS p FROM pages), b AS (SELECT page_id, regexp_replace(p, '^.*?://', '') AS r FROM a),
        c AS (SELECT page_id, regexp_replace(regexp_extract(r, '^([^/]*)', 1), '^www\.', '') AS host, regexp_replace(r, '^[^/]*/?', '') AS path FROM b), e AS (SELECT *, coalesce(list_filter(string_split(path, '/'), lambda x: x <> '')[-1], '') AS l FROM c)
        SELECT min(page_id) AS page_id, key FROM (SELECT page_id, host || '/' || CASE WHEN length(l) >= 4 THEN l ELSE path END AS key FROM e) GROUP BY key""",
    "source_budget": "WITH s AS (SELECT source, doc_id, length(text) AS chars, 7000 - coalesce(sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM documents) SELECT source, doc_id, least(chars, rest)::BIGINT AS used FROM s WHERE rest >= chars OR rest >= 200",
    "quality_filter": "WITH p AS (SELECT doc_id, left(text, (least(CASE WHEN instr(lower(text), 'sources:') > 0 THEN instr(lower(text), 'sources:') ELSE length(text) + 1 END, CASE WHEN instr(lower(text), 'facts:') > 0 THEN instr(lower(text), 'facts:') ELSE length(text) + 1 END) - 1)::BIGINT) AS t FROM documents) SELECT doc_id, length(t)::INT AS chars FROM p WHERE length(t) BETWEEN 100 AND 800 AND NOT regexp_matches(t, '(?i)copyright|licen[cs]e')",
    "names": " UNION ALL ".join(rf"SELECT '{t}' AS kind, key, array_to_string(list_filter(regexp_split_to_array(lower(said), '[^\p{{L}}\p{{M}}\p{{N}}_''-]+'), lambda x: x <> ''), ' ') AS tokens, regexp_replace(regexp_replace(lower(trim(said)), '[^\p{{L}}\p{{M}}\p{{N}}_\s]', '', 'g'), '\s+', ' ', 'g') AS name FROM (SELECT {k} AS key, {" || '  ' || ".join(own)} AS said FROM {t})" for t, k, *own in NAMED),
    "char_chunks": chunks_sql(r"regexp_replace(regexp_replace(regexp_replace(replace(text, chr(13), chr(10)), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')", 1500, 150, [("chr(10) || chr(10)", 2, 2), ("chr(10)", 1, 1), ("'. '", 2, 2)], True, "length(chunk) >= 80"),
    "page_chunks": chunks_sql("text", 2000, 200, [("'. '", 2, 1)], False, "length(chunk) > 100"),
    "word_chunks": r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents),
        n AS (SELECT doc_id, list(total ORDER BY i) AS cum FROM (SELECT doc_id, i, sum(length(w[i]) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS total FROM w, unnest(range(1, len(w) + 1)) AS u(i)) GROUP BY doc_id),
        c AS (SELECT doc_id, 0 AS nth, 0::BIGINT AS a, greatest(1, len(list_filter(cum, lambda x: x <= 1500)))::BIGINT AS b FROM n
          UNION ALL SELECT c.doc_id, nth + 1, c.b, greatest(c.b + 1, len(list_filter(cum, lambda x: x <= cum[c.b] + 1500)))::BIGINT FROM c JOIN n USING (doc_id) WHERE c.b < len(cum)),
        t AS (SELECT doc_id, nth, array_to_string(w[a + 1 : b], ' ') AS chunk FROM c JOIN w USING (doc_id))
        SELECT doc_id, nth::INT AS nth, length(chunk)::INT AS chars, md5(chunk) AS hash FROM t""",
    "sections": r"""WITH s AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text ELSE left(text, length(text) // 2) || ' HISTORY ' || substr(text, length(text) // 2 + 1) || ' SOURCES x' END AS said FROM documents),
        f AS (SELECT doc_id, regexp_extract(said, '(?is)history (.*?)(sources |$)', 1) AS found, said FROM s),
        p AS (SELECT doc_id, left(trim(CASE WHEN trim(found) <> '' THEN found ELSE substr(said, 501, 5000) END), 5000) AS part FROM f) SELECT doc_id, length(part)::INT AS chars, md5(part) AS hash FROM p""",
    "sentences_trimmed": rf"""WITH w AS (SELECT doc_id, text, left(text, 1000) AS w FROM documents),
        p AS (SELECT doc_id, text, w, {", ".join(f"{rfind('w', m)} AS p{i}" for i, m in enumerate(("chr(10) || chr(10)", "'. '", "'.' || chr(10)", "'! '", "'? '", "' '")))} FROM w),
        c AS (SELECT doc_id, CASE WHEN length(text) <= 1000 THEN text ELSE regexp_replace(left(w, (CASE {" ".join(f"WHEN p{i} > 660 THEN p{i} + 2" for i in range(5))} WHEN p5 > 660 THEN p5 ELSE 1000 END)::BIGINT), '^\s+|\s+$', '', 'g') END AS cut FROM p)
        SELECT doc_id, length(cut)::INT AS chars, md5(cut) AS hash, length(trim(cut)) >= 120 AND regexp_matches(trim(cut), '[.!?"”’]$') AS complete FROM c""",
    "names_whole": r"SELECT doc_id, len(t) AS n, md5(array_to_string(t, ' ')) AS tokens, md5(regexp_replace(regexp_replace(lower(trim(coalesce(text, ''))), '[^\p{L}\p{M}\p{N}_\s]', '', 'g'), '\s+', ' ', 'g')) AS name FROM (SELECT doc_id, text, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}_''-]+'), lambda x: x <> '') AS t FROM documents)",
    "addresses": values([(a, b, c, e, f) for a, b, c, e, f in CASES], "address, folded, number, street, numbers"),
    "dates_and_numbers": values(DATES, "said, day, n, number"),
    "materials": "SELECT p_partkey, CASE WHEN lower(p_name) LIKE '%red%' THEN 'brick' WHEN lower(p_name) LIKE '%steel%' OR lower(p_name) LIKE '%blue%' THEN 'steel' WHEN 1850 + p_partkey % 150 < 1900 AND p_type = 'ECONOMY' THEN 'wood' WHEN 1850 + p_partkey % 150 < 1940 THEN 'limestone' ELSE 'concrete' END AS material, CASE WHEN p_partkey % 3 = 0 THEN p_size::DOUBLE WHEN p_type = 'PROMO' THEN 5.0 ELSE 1.0 END AS final_score FROM part",
    "embedding_checks": "SELECT vec_id, len(embedding) = 64 AS valid, CASE WHEN vec_id % 2 = 0 THEN vec_id || ',1,2' END AS profile, vec_id::VARCHAR AS mask FROM embeddings",
}
