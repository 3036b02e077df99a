"""A REST table against a server that counts what it is asked."""

import json
import re
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from gridmill.sources import rest, tables

ROWS = [{"bin": str(i), "kind": ["District", "O'Site"][i % 2], "name": f"place {i}" if i % 5 else None, "junk": "x" * 50, "n": str(i % 10)} for i in range(137)]


def holds(row, where):
    """The part of the query language that the tests use."""
    for part in re.findall(r"\((?:[^()']|'(?:[^']|'')*'|\([^()]*\))*\)", where):
        part = part[1:-1]
        if m := re.fullmatch(r"(\w+) IS (NOT )?NULL", part):
            ok = (row[m[1]] is None) != bool(m[2])
        elif m := re.fullmatch(r"(\w+) (=|>|<=) '((?:[^']|'')*)'", part):
            value, told = m[3].replace("''", "'"), row[m[1]]
            ok = told is not None and {"=": told == value, ">": told > value, "<=": told <= value}[m[2]]
        elif m := re.fullmatch(r"starts_with\((\w+), '([^']*)'\)", part):
            ok = (row[m[1]] or "").startswith(m[2])
        elif m := re.fullmatch(r"(\w+) in \(([^)]*)\)", part):
            ok = row[m[1]] in re.findall(r"'([^']*)'", m[2])
        else:
            raise AssertionError(part)
        if not ok:
            return False
    return True


@pytest.fixture
def server():
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            asked = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
            self.server.asked.append(asked)
            if self.server.broken:
                self.send_response(self.server.broken.pop())
                self.end_headers()
                return
            rows = [r for r in ROWS if holds(r, asked.get("$where", ""))]
            a, n = int(asked["$offset"]), int(asked["$limit"])
            body = json.dumps([{c: r[c] for c in asked["$select"].split(",") if r[c] is not None} for r in rows[a : a + n]]).encode()
            self.server.sent += len(rows[a : a + n])
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    out = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    out.asked, out.broken, out.sent = [], [], 0
    threading.Thread(target=out.serve_forever, daemon=True).start()
    yield out
    out.shutdown()


def url(server):
    return f"http://127.0.0.1:{server.server_port}/data.json"


@pytest.mark.parametrize("tasks,limit", [(1, 10), (4, 10), (3, 1000), (2, 137)])
def test_all_pages_without_a_total(spark, server, tasks, limit):
    got = rest.read_rest(spark, url(server), ["bin", "name"], tasks=tasks, limit=limit).collect()
    assert sorted(map(tuple, got)) == sorted((r["bin"], r["name"]) for r in ROWS) or {tuple(r) for r in got} == {(r["bin"], r["name"]) for r in ROWS}
    assert {a["$select"] for a in server.asked} == {"bin,name"} and server.sent == len(ROWS)


def test_filters_reach_the_server(spark, server):
    want = (F.col("kind") == "O'Site") & F.col("name").isNotNull() & F.col("n").isin("1", "3", "7") & F.col("name").startswith("place")
    got = rest.read_rest(spark, url(server), ["bin", "name", "kind", "n"], want, limit=50, where="bin > '2'").collect()
    told = {r["bin"] for r in ROWS if r["kind"] == "O'Site" and r["name"] and r["n"] in "137" and r["bin"] > "2"}
    assert {r.bin for r in got} == told and told
    assert server.sent == len(told)  # the server sent no row that Spark would drop
    assert "kind = 'O''Site'" in server.asked[0]["$where"] and "junk" not in server.asked[0]["$select"]


def test_what_the_server_cannot_say_stays_with_spark(spark, server):
    got = rest.read_rest(spark, url(server), ["bin", "n"], (F.length("bin") == 2) & (F.col("n") == "4")).collect()
    assert {r.bin for r in got} == {r["bin"] for r in ROWS if len(r["bin"]) == 2 and r["n"] == "4"}
    assert "length" not in server.asked[0]["$where"] and "n = '4'" in server.asked[0]["$where"]


def test_a_page_is_asked_for_again(spark, server):
    server.broken = [503, 429]
    assert rest.read_rest(spark, url(server), ["bin"], limit=100, pause=0.01).count() == len(ROWS)
    server.broken = [404]
    with pytest.raises(Exception, match="404"):
        rest.read_rest(spark, url(server), ["bin"], pause=0.01).count()
    server.broken = [500] * 40
    with pytest.raises(Exception, match="500"):
        rest.read_rest(spark, url(server), ["bin"], pause=0.001, retries=2).count()


def test_parquet_shards_are_pruned_and_filtered_by_the_scan(spark, tmp_path):
    for k in range(2):
        spark.range(k * 100, k * 100 + 100).selectExpr("id", "id % 7 AS kind", "repeat('x', 50) AS junk").write.parquet(f"{tmp_path}/{k}")
    got = tables.read_shards(spark, [f"{tmp_path}/0", f"{tmp_path}/1"], ["id"], F.col("kind") == 3)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(kind,3)" in plan and "junk" not in plan.split("ReadSchema")[1] and got.count() == 29
