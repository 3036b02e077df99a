"""Secret scans with a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams is derived: what every match must
contain. A block of documents is an index segment: the postings of the trigrams that some query asks
for, sorted by document. Queries intersect and unite postings, and only the candidates are verified
with the regular expression. A rule without mandatory trigrams scans the segment fully. The index is
partitioned by document, so neither texts nor postings are shuffled.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from re import _constants as op
from re import _parser as parser  # what Python's own compiler reads; tests/llm/test_secret_scan.py tells if a release changes it

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gridmill.llm.common import LOWER, binary, buffers, map_arrow, pieces, table

#: Strings that a run of literals may stand for, and characters of a class, before they count as unknown.
MOST_STRINGS, MOST_CHARACTERS = 64, 6
SEGMENT_BYTES = 4 << 20

#: A query is True (no condition), a trigram of lower-cased bytes, or ("and" | "or", queries).
Query = bool | bytes | tuple


def both(kind: str, queries: list[Query]) -> Query:
    parts: list[Query] = []
    for q in queries:
        if q is True:
            if kind == "or":
                return True
        elif q not in parts:
            parts.append(q)
    return True if not parts else parts[0] if len(parts) == 1 else (kind, parts)


def of_strings(strings: set[bytes]) -> Query:
    """What a text that contains one of ``strings`` must contain."""
    return both("or", [both("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def folded(code: int) -> bytes:
    """A character as the index has it: A-Z in lower case, all others as they are."""
    return chr(code).encode().translate(LOWER)


def derive(tree: parser.SubPattern) -> tuple[set[bytes] | None, Query]:
    """(strings, query) of a parsed expression: all strings it stands for, if few, else what it demands."""
    found: list[Query] = []
    run: set[bytes] = {b""}
    exact = True

    def flush() -> None:
        nonlocal run, exact
        found.append(of_strings(run))
        run, exact = {b""}, False

    for kind, value in tree:
        strings: set[bytes] | None = None
        query: Query = True
        again = False  # more copies of the same may follow
        if kind is op.LITERAL:
            strings = {folded(value)}
        elif kind is op.IN:
            strings = members(value)
        elif kind in (op.AT, op.ASSERT, op.ASSERT_NOT):
            strings = {b""}
        elif kind is op.SUBPATTERN:
            strings, query = derive(value[3])
        elif kind is op.BRANCH:
            parts = [derive(p) for p in value[1]]
            if all(s is not None for s, _ in parts):
                strings = set().union(*(s for s, _ in parts))
            else:
                query = both("or", [q if s is None else of_strings(s) for s, q in parts])
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
            least, most, part = value
            strings, query = derive(part)
            if least == 0:
                strings, query = ({b""} | strings, True) if strings is not None and most == 1 else (None, True)
            again = most != 1 and least > 0
        if strings is None or len(run) * len(strings) > MOST_STRINGS:
            flush()
            found.append(query if strings is None else of_strings(strings))
        else:
            run = {a + b for a in run for b in strings}
            if again:
                flush()
    if exact:
        return run, of_strings(run)
    flush()
    return None, both("and", found)


def members(items: list) -> set[bytes] | None:
    found: set[bytes] = set()
    for kind, value in items:
        if kind is op.LITERAL:
            found.add(folded(value))
        elif kind is op.RANGE and value[1] - value[0] < MOST_CHARACTERS:
            found |= {folded(c) for c in range(value[0], value[1] + 1)}
        else:
            return None
        if len(found) > MOST_CHARACTERS:
            return None
    return found


@dataclass
class Rule:
    """A kind of secret: the expression, the least length of ``group``, and the derived query."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    fold: bool = False
    query: Query = field(init=False)

    def __post_init__(self) -> None:
        self.query = derive(parser.parse(self.pattern))[1]

    def spans(self, text: str) -> list[tuple[int, int]]:
        flags = re.ASCII | (re.IGNORECASE if self.fold else 0)
        return [m.span() for m in re.finditer(self.pattern, text, flags) if len(m[self.group]) >= self.least]


#: The base rules, and known key formats. Only maximal runs of hex digits match ``hex``.
RULES = [
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]{32,}", 32),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_bot", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----"),
]
BASE = 3


def trigrams(query: Query) -> set[bytes]:
    return set() if query is True else {query} if isinstance(query, bytes) else set().union(*map(trigrams, query[1]))


class Segment:
    """Postings of the asked trigrams over one block of documents."""

    def __init__(self, asked: np.ndarray, data: np.ndarray, offsets: np.ndarray, names: list[bytes]) -> None:
        self.size = len(offsets) - 1
        low = np.frombuffer(LOWER, np.uint8)[data].astype(np.int32)
        codes = (low[:-2] << 16) | (low[1:-1] << 8) | low[2:] if len(low) > 2 else low[:0]
        which = asked[codes]
        at = np.flatnonzero(which)
        pairs = np.unique(which[at].astype(np.int64) * self.size + (np.searchsorted(offsets, at, "right") - 1))
        cuts = np.searchsorted(pairs, np.arange(1, len(names) + 2) * self.size)
        self.postings = {g: pairs[cuts[k] : cuts[k + 1]] - (k + 1) * self.size for k, g in enumerate(names)}

    def candidates(self, query: Query) -> np.ndarray:
        if query is True:
            return np.arange(self.size)
        if isinstance(query, bytes):
            return self.postings[query]
        parts = [self.candidates(q) for q in query[1]]
        if query[0] == "or":
            return np.unique(np.concatenate(parts))
        found = parts[0]
        for p in sorted(parts[1:], key=len):
            found = np.intersect1d(found, p, assume_unique=True)
        return found


def scan(docs: DataFrame, rules: list[Rule] = RULES, base: int = BASE) -> DataFrame:
    """One row per input row: doc_id, n_<kind> of the base rules, base_sha256, spans.

    Spans are kind:start:end in code points by start, and spans that start at one place in the order of
    the rules. Null text counts as empty and has no spans. A text of any length is scanned whole, as a
    segment of its own if it is longer than one. Repeated rows and null doc_ids are scanned like
    others, further columns are not read, an empty table gives an empty result.
    """
    names = sorted(set().union(*(trigrams(r.query) for r in rules)))
    kinds = [r.kind for r in rules]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = np.zeros(1 << 24, np.min_scalar_type(len(names)))
        for k, g in enumerate(names):
            asked[int.from_bytes(g, "big")] = k + 1
        for batch in batches:
            texts = binary(batch.column(1))
            spans: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
            for i, j in pieces(texts, SEGMENT_BYTES):
                block = texts.slice(i, j - i)
                segment = Segment(asked, *buffers(block), names)
                decoded: dict[int, str] = {}
                for k, rule in enumerate(rules):
                    for d in segment.candidates(rule.query).tolist():
                        if d not in decoded:
                            decoded[d] = block[d].as_py().decode()
                        spans[i + d] += [(start, k, end) for start, end in rule.spans(decoded[d])]
            told = [[(k, f"{kinds[k]}:{start}:{end}") for start, k, end in sorted(s)] for s in spans]
            counts = {f"n_{kinds[b]}": pa.array([sum(k == b for k, _ in t) for t in told], pa.int64()) for b in range(base)}
            digest = [hashlib.sha256(",".join(x for k, x in t if k < base).encode()).hexdigest() for t in told]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), **counts, "base_sha256": pa.array(digest, pa.string()), "spans": pa.array([",".join(x for _, x in t) for t in told], pa.string())})

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + "".join(f"n_{k} long, " for k in kinds[:base]) + "base_sha256 string, spans string"
    return map_arrow(docs.select("doc_id", "text"), run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def oracle() -> str:
    """DuckDB SQL of the query: matches of each rule in order, each found again from where the last one ended."""

    def either(pattern: str) -> str:
        keys, rest = pattern[: pattern.index(")")], pattern[pattern.index(")") :]
        return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in keys) + rest

    parts = []
    for k, rule in enumerate(RULES):
        pattern = (either(rule.pattern) if rule.fold else rule.pattern).replace("'", "''")
        parts.append(
            f"""SELECT doc_id, {k} AS k, '{rule.kind}' AS kind, unnest(list_reduce(list_transform(list_zip(regexp_extract_all(t, '{pattern}'), regexp_extract_all(t, '{pattern}', {rule.group})), lambda p: {{'m': p[1], 'n': length(p[2]), 'at': 0::BIGINT, 'all': []::STRUCT(s BIGINT, e BIGINT, n BIGINT)[]}}),
            lambda a, x: {{'m': x.m, 'n': x.n, 'at': a.at + instr(substr(t, a.at + 1), x.m) - 1 + length(x.m), 'all': list_append(a.all, {{'s': a.at + instr(substr(t, a.at + 1), x.m) - 1, 'e': a.at + instr(substr(t, a.at + 1), x.m) - 1 + length(x.m), 'n': x.n}})}},
            {{'m': '', 'n': 0::BIGINT, 'at': 0::BIGINT, 'all': []::STRUCT(s BIGINT, e BIGINT, n BIGINT)[]}}).all) AS f, {rule.least} AS least FROM d"""
        )
    told = " UNION ALL ".join(parts)
    counts = ", ".join(f"count(*) FILTER (k = {b}) AS n_{RULES[b].kind}" for b in range(BASE))
    joined = "string_agg(kind || ':' || f.s || ':' || f.e, ',' ORDER BY f.s, k)"
    zeros = ", ".join(f"coalesce(n_{RULES[b].kind}, 0) AS n_{RULES[b].kind}" for b in range(BASE))
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), found AS ({told}),
    told AS (SELECT doc_id, {counts}, {joined} FILTER (k < {BASE}) AS base, {joined} AS spans FROM found WHERE f.n >= least GROUP BY doc_id)
    SELECT d.doc_id, {zeros}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN told ON told.doc_id = d.doc_id"""
