"""Conversation structure repair by error-correcting Earley parsing.

Spark orders the rows of a conversation, marks their faults and makes of each conversation a string of
one character a row. That string alone is parsed; the edits then meet the rows again in a join on
(conversation, place), so no task holds the texts of a conversation together.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from gridmill.llm import earley
from gridmill.llm.common import dropping, map_arrow, materialize, sealed, table

BLANKS = r"\x20\x09-\x0D"
ROLES = {"u": "user", "a": "assistant"}
NO_FAULT = "no"


def fault_of(text: Column, seen: Column) -> Column:
    """blank, duplicate, truncated or no: the first fault of a row."""
    return (
        F.when(~text.rlike(f"[^{BLANKS}]"), "blank")
        .when(seen > 1, "duplicate")
        .when(~text.rlike(rf"[.!?][{BLANKS}]*\z"), "truncated")
        .otherwise(NO_FAULT)
    )


def marked(rows: DataFrame) -> DataFrame:
    """The rows (conv_id, turn, role, text without nulls) with place from 1, fault, mark, and flags that sums are made of."""
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    same = Window.partitionBy("conv_id", "role", "text").orderBy("place")
    initial = F.substring("role", 1, 1)
    pair = F.concat(F.lag(initial).over(order), initial)
    kind = F.when(initial.isin(list(earley.KINDS[:-1])), initial).otherwise(earley.KINDS[-1])
    return (
        rows.withColumns({"place": F.row_number().over(order), "new_turn": F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.lag("turn").over(order)), "illegal": F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False))})
        .withColumn("fault", fault_of(F.col("text"), F.row_number().over(same)))
        .withColumn("mark", F.when(F.col("fault").isin("blank", "duplicate"), earley.GONE).when(F.col("fault") == "truncated", F.upper(kind)).otherwise(kind))
    )


def count(flag: Column) -> Column:
    return F.count(F.when(flag, 1))


def shapes(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``marked`` rows: its counts and its marks in order."""
    marks = F.array_sort(F.collect_list(F.struct("place", "mark")))
    faults = {name: count(F.col("fault") == name) for name in ("blank", "duplicate", "truncated")}
    return rows.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - count(F.col("new_turn")), F.lit(0)).cast("long").alias("gaps"),
        *(c.alias(name) for name, c in faults.items()),
        count(F.col("illegal")).alias("illegal"),
        F.array_join(F.transform(marks, lambda m: m["mark"]), "").alias("shape"),
    )


def parsed(found: DataFrame) -> DataFrame:
    """``shapes`` with the cost, the audit and the targets of their cheapest repair in place of the shape."""
    names = [n for n in found.columns if n != "shape"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [earley.repair_of(s) for s in batch.column("shape").to_pylist()]
            cost, audit, targets = zip(*values) if values else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.select(names).columns, pa.array(cost, pa.int64()), pa.array(audit, pa.string()), pa.array(targets, pa.string())], names=[*names, "cost", "audit", "targets"])

    schema = ", ".join(f"{n} {found.schema[n].dataType.simpleString()}" for n in names)
    return map_arrow(found, run, f"{schema}, cost long, audit string, targets string")


#: Edits in one batch that goes back to Spark.
STEPS = 1 << 16


def steps(plans: DataFrame) -> DataFrame:
    """(conv_id, step, edit, target, place): the edits one by one; an inserted row has no place."""
    kind = plans.schema["conv_id"].dataType

    def batch_of(conv: list, step: list, edit: list, target: list, place: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(conv, type_), pa.array(step, pa.int64()), pa.array(edit, pa.string()), pa.array(target, pa.string()), pa.array(place, pa.int32())], names=["conv_id", "step", "edit", "target", "place"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, ...] = ([], [], [], [], [])
        for batch in batches:
            for conv, audit, targets in zip(*(batch.column(k).to_pylist() for k in range(3))):
                place = 0
                for step, (edit, target) in enumerate(zip(audit, targets), 1):
                    place += edit != "I"
                    for column, value in zip(held, (conv, step, edit, target, None if edit == "I" else place)):
                        column.append(value)
                    if len(held[0]) >= STEPS:
                        yield batch_of(*held)
                        held = ([], [], [], [], [])
        yield batch_of(*held)

    type_ = to_arrow_type(kind)
    return map_arrow(plans.select("conv_id", "audit", "targets"), run, f"conv_id {kind.simpleString()}, step long, edit string, target string, place int")


def edited(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """(conv_id, step, edit, role, text, old_role) of every edit, deletions too; ``step`` is its number in the audit."""
    own = rows.select(F.col("conv_id").alias("of"), F.col("place").alias("at"), F.col("role").alias("old_role"), F.col("text").alias("old_text"))
    given = F.when(F.col("target") == "u", ROLES["u"]).when(F.col("target") == "a", ROLES["a"])
    return steps(plans).join(own, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("place") == F.col("at")), "left").select(
        "conv_id", "step", "edit", F.coalesce(given, "old_role").alias("role"), F.coalesce("old_text", F.lit("")).alias("text"), "old_role"
    )


def plain(rows: DataFrame) -> DataFrame:
    return rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))


def repaired(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(plans, edits) of conversations (conv_id, turn, role, text).

    ``plans`` has one row per conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit, targets.
    ``edits`` has its edits in order, with role and text after the repair.

    Rows go by turn, null turns first, then by role and text. Null role or text is one space, so a row
    with null text is blank and has to go; a role that starts with none of s, u and a can only be
    reroled or deleted. Rows without conv_id form one conversation. Repeated rows are duplicates. An
    empty table gives no rows; further columns are not read. Texts of any length count whole; a
    conversation of any length is parsed whole, at one character a row in the task that parses it.
    """
    laid = materialize(marked(plain(rows)), "marked")
    plans = materialize(parsed(shapes(laid)), "repairs")
    return plans, edited(laid, plans)


def damaged(rows: DataFrame) -> DataFrame:
    """The rows as the contract of the query damages them, by crc32 of ``conv_id:turn`` modulo 20."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    case = F.crc32(key.cast("binary")) % 20
    text = F.when(case == 1, "").when(case == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(case == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return plain(rows).where(case != 0).select("conv_id", "turn", F.when(case == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def digests(rows: DataFrame, original: DataFrame) -> DataFrame:
    """One row per conv_id of ``original`` with what ``repaired`` makes of its ``rows``; one without rows has zeros."""
    with dropping():
        plans, edits = repaired(rows)
        lines = edits.where("edit != 'D'").select("conv_id", "step", F.concat("role", F.lit(":"), "text").alias("line"))
        hashes = sealed(lines, "conv_id", "step", "line", "\n", "repaired_sha256")
        ids = original.select(F.col("conv_id").alias("id")).distinct()
        told = plans.drop("targets").join(hashes.withColumnRenamed("conv_id", "of"), F.col("conv_id").eqNullSafe(F.col("of")), "left").drop("of")
        told = ids.join(told, F.col("id").eqNullSafe(F.col("conv_id")), "left")
        counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
        return materialize(
            told.select(F.col("id").alias("conv_id"), *(F.coalesce(n, F.lit(0)).alias(n) for n in counts), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(EMPTY)).alias("repaired_sha256")),
            "repaired", keep=True,
        )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return digests(damaged(rows), rows)


def least(*options: str) -> str:
    return f"least({', '.join(options)})"


def step(of: str, cost: str, edit: str) -> str:
    """A state as text, its cost in 12 digits and its audit, after one more edit."""
    return f"(lpad((left({of}, 12)::BIGINT + {cost})::VARCHAR, 12, '0') || substr({of}, 13) || '{edit}')"


def oracle() -> str:
    """DuckDB SQL: a row at a time, the cheapest way to each of the states junk, opening, asked and turns."""
    crc = "(4294967295 - list_reduce([unicode(c)::BIGINT for c in string_split(key, '')], lambda acc, b: list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END), xor(acc, b)), 4294967295::BIGINT))"
    gone = {s: f"CASE WHEN {s} IS NOT NULL THEN {step(s, '4', 'D')} END" for s in "jost"}

    def read(of: str, role: str) -> str:
        change = f"CASE WHEN initial = '{role}' THEN {step(of, 'more', 'K')} ELSE {step(of, '3 + more', 'R')} END"
        return f"CASE WHEN NOT must AND {of} IS NOT NULL THEN {change} END"

    system = f"CASE WHEN NOT must AND initial = 's' AND j IS NOT NULL THEN {step('j', 'more', 'K')} END"
    inserted = {s: f"CASE WHEN {s} IS NOT NULL THEN {step(s, '3', 'I')} END" for s in "jot"}
    return f"""WITH RECURSIVE r AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
    c AS (SELECT *, {crc} % 20 AS f FROM r),
    d AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE WHEN f = 1 THEN '' WHEN f = 2 THEN translate(text, '.!?', '') ELSE text END AS text
          FROM c, unnest(CASE WHEN f = 0 THEN [] WHEN f = 3 THEN [1, 2] ELSE [1] END) u(n)),
    p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place, left(role, 1) AS initial FROM d),
    q AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 'duplicate'
                         WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' ELSE 'no' END AS fault,
                 lag(initial) OVER (PARTITION BY conv_id ORDER BY place) || initial AS pair FROM p),
    m AS (SELECT *, fault IN ('blank', 'duplicate') AS must, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS more FROM q),
    s AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                 count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(place) AS n FROM q GROUP BY conv_id),
    walk(conv_id, place, j, o, s, t) AS (
      SELECT conv_id, 0::BIGINT, '000000000000', NULL::VARCHAR, '000000000003I', '000000000006II' FROM s
      UNION ALL SELECT conv_id, place, j, o, s, least(t, CASE WHEN s IS NOT NULL THEN {step('s', '3', 'I')} END) FROM (
        SELECT conv_id, place, j, o, least(s, {inserted['j']}, {inserted['o']}, {inserted['t']}) AS s, t FROM (
          SELECT w.conv_id, m.place, {gone['j']} AS j, {least(gone['o'], system)} AS o, {least(gone['s'], read('j', 'u'), read('o', 'u'), read('t', 'u'))} AS s, {least(gone['t'], read('s', 'a'))} AS t
          FROM walk w JOIN m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.place = w.place + 1))),
    best AS (SELECT w.conv_id, least(j, t) AS b FROM walk w JOIN s ON w.conv_id IS NOT DISTINCT FROM s.conv_id AND w.place = s.n),
    edits AS (SELECT conv_id, b, i, substr(b, 12 + i, 1) AS edit, i - (length(substr(b, 13, i)) - length(replace(substr(b, 13, i), 'I', ''))) AS place FROM best, unnest(range(1, length(b) - 11)) u(i)),
    kept AS (SELECT e.*, m.role, m.text, (row_number() OVER (PARTITION BY e.conv_id ORDER BY i) + CASE WHEN first_value(CASE WHEN edit = 'K' THEN m.initial END) OVER (PARTITION BY e.conv_id ORDER BY i) = 's' THEN 1 ELSE 0 END) % 2 AS odd
             FROM edits e LEFT JOIN m ON m.conv_id IS NOT DISTINCT FROM e.conv_id AND m.place = e.place WHERE edit != 'D'),
    told AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN odd = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY i) AS whole FROM kept GROUP BY conv_id)
    SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
           coalesce(left(b, 12)::BIGINT, 0) AS cost, coalesce(substr(b, 13), '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) ids LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM ids.conv_id
    LEFT JOIN told ON told.conv_id IS NOT DISTINCT FROM ids.conv_id"""
