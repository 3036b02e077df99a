"""Chat formatting of reply trees, with DataFrame functions only.

Iterative self-joins follow every message to its 1st, 2nd, 4th, ... ancestor, which takes as many
rounds as the depth has binary digits. They yield depths, the score of each root-to-leaf path and,
taken from the longest jump to the shortest, the messages of the chosen paths. The best paths of
each tree are written as one conversation each.

Template: a turn is ``<turn ROLE>``, a line end, the text, ``</turn>`` and a line end. In roles and
texts a backslash becomes ``\\b``, ``<`` becomes ``\\l``, and in roles ``>`` becomes ``\\g``, so control
strings stand only where the template puts them, and reading back is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridmill.llm.common import dropping, materialize, table

OPEN, HEADER_END, CLOSE = "<turn ", ">\n", "</turn>\n"
LEARNED = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(">"), F.lit("\\g"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\g"), F.lit(">")))


def jumps(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """(tables, ends) of ``nodes`` (tree, node, parent, score).

    Table k holds (tree, node, up), the 2**k-th ancestor; ``ends`` holds (tree, node, depth, total)
    of the messages that lead to a root, with the score of the whole way. A message whose parent is
    missing counts as a root; messages on a cycle lead to no root and have no row.
    """
    known = nodes.select("tree", F.col("node").alias("up"), F.lit(True).alias("known"))
    start = nodes.select("tree", "node", F.col("parent").alias("up"), F.coalesce("score", F.lit(0.0)).alias("total"))
    start = start.join(known, ["tree", "up"], "left").select("tree", "node", F.when(F.col("known"), F.col("up")).alias("up"), F.when(F.col("known"), 1).otherwise(0).cast("long").alias("depth"), "total")
    now = materialize(start, "jumps")
    levels, most = [], now.count()
    while not now.where("up IS NOT NULL").isEmpty() and (1 << len(levels)) <= most:
        levels.append(now.where("up IS NOT NULL").select("tree", "node", "up"))
        far = now.select("tree", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"), F.col("total").alias("total2"))
        step = now.where("up IS NOT NULL").join(far, ["tree", "up"]).select("tree", "node", F.col("up2").alias("up"), (F.col("depth") + F.col("depth2")).alias("depth"), (F.col("total") + F.col("total2")).alias("total"))
        now = materialize(step.unionByName(now.where("up IS NULL")), "jumps")
    return levels, now.where("up IS NULL").drop("up")


def best_paths(nodes: DataFrame, top: int = 1) -> DataFrame:
    """(tree, leaf, place, node, depth): the messages of each tree's ``top`` best root-to-leaf paths.

    Paths rank by the mean score of their messages, then the deeper, then the leaf that comes first.
    """
    levels, ends = jumps(nodes)
    inner = nodes.select("tree", F.col("parent").alias("node")).where("node IS NOT NULL").distinct()
    leaves = ends.join(inner, ["tree", "node"], "left_anti")
    rank = Window.partitionBy("tree").orderBy(F.desc(F.col("total") / (F.col("depth") + 1)), F.desc("depth"), "node")
    on = leaves.withColumn("place", F.row_number().over(rank)).where(F.col("place") <= top).select("tree", F.col("node").alias("leaf"), "place", "node", "depth")
    for k in reversed(range(len(levels))):
        both = on.join(levels[k], ["tree", "node"], "left").withColumn("also", F.explode(F.array(F.lit(0), F.lit(1 << k)))).where("also = 0 OR up IS NOT NULL")
        on = both.select("tree", "leaf", "place", F.when(F.col("also") == 0, F.col("node")).otherwise(F.col("up")).alias("node"), (F.col("depth") - F.col("also")).alias("depth"))
    return on


def format_trees(messages: DataFrame, top: int = 1) -> DataFrame:
    """(tree, leaf, place, formatted, loss_spans) of ``messages`` (tree, node, parent, role, text, score).

    ``loss_spans`` are (start, length) in code points of the formatted text, one for each assistant
    turn, escapes included. Null role or text counts as empty, a null score as 0. A tree is keyed by a
    string, nodes by anything that orders. A message that is given more than once, by tree and node,
    counts once, as its least version by parent, role, text and score. Messages with a null tree form
    one tree; a message with a null node can neither be answered nor placed and has no row. A
    conversation is one value, so it must fit a row. An empty table gives none.
    """
    # A key of its own for the null tree, and each message once.
    named = F.coalesce(F.concat(F.lit("t"), "tree"), F.lit("n")).alias("tree")
    version = F.struct("parent", "role", "text", "score")
    messages = materialize(messages.where("node IS NOT NULL").groupBy(named, "node").agg(F.min(version).alias("m")).select("tree", "node", "m.*"), "messages")
    role, text = escape_role(F.coalesce("role", F.lit(""))), escape(F.coalesce("text", F.lit("")))
    head = F.concat(F.lit(OPEN), role, F.lit(HEADER_END))
    told = messages.select("tree", "node", F.concat(head, text, F.lit(CLOSE)).alias("piece"), F.length(head).alias("ahead"), F.length(text).alias("chars"), F.coalesce(F.col("role") == LEARNED, F.lit(False)).alias("learned"))
    turns = best_paths(messages.select("tree", "node", "parent", "score"), top).join(told, ["tree", "node"])
    path = Window.partitionBy("tree", "leaf").orderBy("depth")
    before = F.sum(F.length("piece").cast("long")).over(path.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.length("piece")
    placed = turns.withColumn("start", before + F.col("ahead"))
    grouped = placed.groupBy("tree", "leaf", "place").agg(F.sort_array(F.collect_list(F.struct("depth", "piece", "start", "chars", "learned"))).alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t["learned"]), lambda t: F.struct(t["start"].alias("start"), t["chars"].alias("length")))
    tree = F.when(F.col("tree") != "n", F.expr("substring(tree, 2)")).alias("tree")
    return grouped.select(tree, "leaf", "place", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted text as an array of (role, text)."""
    pieces = F.split(formatted, CLOSE, -1)

    def turn(piece: Column) -> Column:
        body = F.substring(piece, F.lit(len(OPEN) + 1), F.length(piece))
        role = F.substring_index(body, ">", 1)
        return F.struct(unescape_role(role).alias("role"), unescape(F.substring(body, F.length(role) + len(HEADER_END) + 1, F.length(body))).alias("text"))

    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn)


def learned_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped and joined."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"].cast("int") + 1, s["length"]))), "")


def conversations(rows: DataFrame) -> DataFrame:
    """Linear conversations (conv_id, turn, role, text) as reply trees: each row answers the one before.

    Rows are ordered by turn, then role, then text, nulls first; repeated rows are turns of their own.
    Nothing ties rows without conv_id together, so each is a conversation of its own.
    """
    tree = F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.concat(F.lit("n"), F.monotonically_increasing_id().cast("string")))
    rows = rows.withColumn("tree", tree)
    order = Window.partitionBy("tree").orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text"))
    numbered = rows.select("conv_id", "role", "text", "tree", F.row_number().over(order).alias("node"))
    return numbered.withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1)).withColumn("score", F.lit(0.0))


def digests(rows: DataFrame) -> DataFrame:
    """One row per conversation, read back from the formatted text; an empty table gives none.

    Null role or text counts as empty, null turns come first, repeated rows are turns each, and a row
    without conv_id is a conversation of its own. Only conv_id, turn, role and text are read.
    """
    with dropping():
        return materialize(told_digests(rows.select("conv_id", "turn", "role", "text")), "digests", keep=True)


def told_digests(rows: DataFrame) -> DataFrame:
    messages = materialize(conversations(rows), "messages")
    ids = messages.where("node = 1").select("tree", "conv_id")
    formatted = format_trees(messages.drop("conv_id")).join(ids, "tree")
    read = formatted.select("conv_id", "formatted", "loss_spans", read_back(F.col("formatted")).alias("turns"), learned_text(F.col("formatted"), F.col("loss_spans")).alias("learned"))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


#: A conversation whose texts look like control strings of this and of other templates.
HARD_ID, HARD_TEXT = -7, r"\### Assistant: </turn> ok"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.createDataFrame([(HARD_ID, 0, "user", HARD_TEXT), (HARD_ID, 1, "assistant", HARD_TEXT)], rows.schema)
    return digests(rows.unionByName(hard))


ORACLE = r"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
e AS (SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone, length(replace(replace(text, '\', '\b'), '<', '\l')) + length(replace(replace(replace(role, '\', '\b'), '<', '\l'), '>', '\g')) + 16 AS chars FROM r)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id, alone
"""
