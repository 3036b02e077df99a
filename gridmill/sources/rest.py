"""A REST table as a data source: filters and columns travel to the server, pages end where the server's do."""

from __future__ import annotations

import json
import time
from collections.abc import Iterable, Iterator
from urllib.error import HTTPError, URLError
from urllib.parse import quote, urlencode
from urllib.request import Request, urlopen

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not, StringContains, StringStartsWith

#: Comparisons that the server's query language writes the same way.
SIGNS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
#: Answers that are worth another try.
AGAIN = (408, 429, 500, 502, 503, 504)


def literal(value: object) -> str | None:
    """A value in the server's query language; None for kinds that it has not got."""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return repr(value)
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else None


def condition(f: Filter) -> str | None:
    """A filter in the server's query language, or None where it can't be said exactly."""
    if isinstance(f, Not):
        inner = condition(f.child)
        return f"NOT ({inner})" if inner else None
    name = ".".join(f.attribute)
    if not name.replace("_", "").isalnum():
        return None
    if isinstance(f, (IsNull, IsNotNull)):
        return f"{name} IS {'NOT ' if isinstance(f, IsNotNull) else ''}NULL"
    if isinstance(f, In):
        values = [literal(v) for v in f.value]
        return f"{name} in ({', '.join(values)})" if values and None not in values else None
    value = literal(f.value)
    if value is None:
        return None
    if type(f) in SIGNS:
        return f"{name} {SIGNS[type(f)]} {value}"
    if isinstance(f, StringStartsWith):
        return f"starts_with({name}, {value})"
    if isinstance(f, StringContains):
        return f"contains({name}, {value})"
    return None


class Pages(InputPartition):
    """The pages ``first``, ``first + step``, ..."""

    def __init__(self, first: int, step: int) -> None:
        self.first, self.step = first, step


class RestReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict) -> None:
        self.names, self.options = [f.name for f in schema.fields], dict(options)
        self.conditions = [c for c in [self.options.get("where")] if c]

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes what the server can say; text comparisons are the server's own, so Spark looks again at those."""
        for f in filters:
            said = condition(f)
            if said is None:
                yield f
            else:
                self.conditions.append(said)

    def partitions(self) -> list[Pages]:
        n = int(self.options.get("tasks", 1))
        return [Pages(k, n) for k in range(n)]

    def page(self, number: int) -> list[dict]:
        """One page, asked for again after a pause where the server or the line fails."""
        size = int(self.options.get("limit", 1000))
        asked = {"$select": ",".join(self.names), "$limit": size, "$offset": number * size, "$order": self.options.get("order", ":id")}
        if self.conditions:
            asked["$where"] = " AND ".join(f"({c})" for c in self.conditions)
        request = Request(f"{self.options['url']}?{urlencode(asked, quote_via=quote)}", headers={"User-Agent": self.options.get("agent", "gridmill")})
        tries = int(self.options.get("retries", 4))
        for attempt in range(tries + 1):
            try:
                with urlopen(request, timeout=float(self.options.get("timeout", 60))) as answer:
                    return json.load(answer)
            except (URLError, TimeoutError, json.JSONDecodeError) as error:
                if attempt == tries or (isinstance(error, HTTPError) and error.code not in AGAIN):
                    raise
                time.sleep(float(self.options.get("pause", 1)) * 2**attempt)
        raise AssertionError

    def read(self, partition: Pages) -> Iterator[tuple]:
        """A task ends with its first page that is not full: the server has no rows behind it."""
        number, size = partition.first, int(self.options.get("limit", 1000))
        while True:
            rows = self.page(number)
            for row in rows:
                yield tuple(None if row.get(n) is None else row[n] if isinstance(row[n], str) else json.dumps(row[n]) for n in self.names)
            if len(rows) < size:
                return
            number += partition.step


class RestTable(DataSource):
    """``spark.read.format("rest_table")``; its schema, all strings, is what is selected.

    Options: ``url``; ``where``, a condition of its own; ``order``, a total order, as pages are asked for
    one by one; ``limit``, rows of a page; ``tasks`` that take pages in turn; ``retries``, ``pause``,
    ``timeout`` in seconds. No total is needed.
    """

    @classmethod
    def name(cls) -> str:
        return "rest_table"

    def schema(self) -> str:
        raise ValueError("name the columns with .schema(): they are what is selected")

    def reader(self, schema: T.StructType) -> RestReader:
        return RestReader(schema, self.options)


def read_rest(spark: SparkSession, url: str, columns: list[str], condition: Column | str | None = None, **options: object) -> DataFrame:
    """Some columns of the rows of a REST table that hold a condition; columns and what the server can say of the condition are asked of it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RestTable)
    schema = ", ".join(f"`{c}` string" for c in columns)
    rows = spark.read.format("rest_table").schema(schema).options(url=url, **{k: str(v) for k, v in options.items()}).load()
    return rows if condition is None else rows.where(condition)
