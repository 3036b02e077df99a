"""Error-correcting Earley parsing with weighted productions.

A production has a cost and an edit; those with a cost above 0 are the error productions: they delete a
token, read it as another, or insert one by deriving nothing. An item of the chart is a production, a
dot and the column where it began, and keeps the least (cost, edits) of its ways there.
"""

from __future__ import annotations

import functools
import heapq
from typing import NamedTuple

#: (cost, edits, targets): a letter of each edit, and beside it what the edit makes of the token.
Value = tuple[int, str, str]
Item = tuple[int, int, int]


class Rule(NamedTuple):
    """``left`` derives ``right``: names of other productions, or tokens of one character."""

    left: str
    right: tuple[str, ...] = ()
    cost: int = 0
    edit: str = ""
    target: str = ""


class Column(NamedTuple):
    best: dict[Item, Value]
    #: Items by the symbol behind their dot.
    waiting: dict[str, dict[Item, Value]]


def joined(a: Value, b: Value) -> Value:
    return a[0] + b[0], a[1] + b[1], a[2] + b[2]


class Grammar:
    """Productions from the symbol ``start``; a left-recursive grammar keeps a bounded number of items a column.

    Edits of equal cost that end at one column are never one a prefix of the other if every insertion
    costs something, so the least edits of a whole are made of the least edits of its parts.
    """

    def __init__(self, start: str, rules: list[Rule]) -> None:
        self.start, self.rules = start, rules
        self.of: dict[str, list[int]] = {}
        for k, rule in enumerate(rules):
            self.of.setdefault(rule.left, []).append(k)

    def close(self, here: int, seeds: list[tuple[Value, Item]], chart: dict[int, Column], token: str | None) -> Column:
        """The column ``here``: what prediction and completion make of ``seeds``, cheapest first; ``token`` comes next."""
        best: dict[Item, Value] = {}
        waiting: dict[str, dict[Item, Value]] = {}
        empty: dict[str, Value] = {}
        heap = list(seeds)
        heapq.heapify(heap)
        while heap:
            value, item = heapq.heappop(heap)
            if item in best and best[item] <= value:
                continue
            best[item] = value
            k, dot, origin = item
            rule = self.rules[k]
            if dot < len(rule.right):
                symbol = rule.right[dot]
                waiting.setdefault(symbol, {})[item] = value
                if symbol in empty:
                    heapq.heappush(heap, (joined(value, empty[symbol]), (k, dot + 1, origin)))
                for p in self.of.get(symbol, ()):
                    right = self.rules[p].right
                    if (p, 0, here) not in best and (not right or right[0] in self.of or right[0] == token):
                        heapq.heappush(heap, ((self.rules[p].cost, self.rules[p].edit, self.rules[p].target), (p, 0, here)))
                continue
            if origin == here:
                empty[rule.left] = min(value, empty.get(rule.left, value))
            asked = (waiting if origin == here else chart[origin].waiting).get(rule.left, {})
            for (p, at, begun), before in asked.items():
                heapq.heappush(heap, (joined(before, value), (p, at + 1, begun)))
        return Column(best, waiting)

    def parse(self, tokens: str) -> Value | None:
        """The least (cost, edits, targets) that derives ``tokens``, or None where nothing does."""
        seeds: list[tuple[Value, Item]] = [((self.rules[p].cost, self.rules[p].edit, self.rules[p].target), (p, 0, 0)) for p in self.of[self.start]]
        chart: dict[int, Column] = {}
        for here in range(len(tokens) + 1):
            token = tokens[here] if here < len(tokens) else None
            column = self.close(here, seeds, chart, token)
            # Columns in which no item began that still lives are never asked again.
            begun = {origin for _, _, origin in column.best}
            chart = {k: c for k, c in chart.items() if k in begun} | {here: column}
            seeds = [(value, (k, dot + 1, origin)) for (k, dot, origin), value in column.waiting.get(token, {}).items()] if token else []
        whole = [v for (k, dot, origin), v in column.best.items() if origin == 0 and self.rules[k].left == self.start and dot == len(self.rules[k].right)]
        return min(whole, default=None)


#: Tokens of a row: initial of its role (x: another), a capital where its text is truncated; - has to go.
KEEP, REROLE, INSERT, DELETE, TRUNCATED = 0, 3, 3, 4, 3
KINDS, GONE = "suax", "-"


def role_grammar() -> Grammar:
    """Role initials ``(s?(ua)+)?`` with productions that delete, rerole and insert rows."""
    rules = [
        Rule("talk", ("junk",)), Rule("talk", ("turns",)),
        Rule("junk"), Rule("junk", ("junk", "gone")),
        Rule("opening", ("junk", "system")), Rule("opening", ("opening", "gone")),
        Rule("asked", ("junk", "user")), Rule("asked", ("opening", "user")), Rule("asked", ("turns", "user")), Rule("asked", ("asked", "gone")),
        Rule("turns", ("asked", "assistant")), Rule("turns", ("turns", "gone")),
        Rule("user", (), INSERT, "I", "u"), Rule("assistant", (), INSERT, "I", "a"), Rule("gone", (GONE,), DELETE, "D", "-"),
    ]
    for kind in KINDS:
        for token, more in ((kind, 0), (kind.upper(), TRUNCATED)):
            rules.append(Rule("gone", (token,), DELETE, "D", "-"))
            for name in ("system", "user", "assistant"):
                if name[0] == kind:
                    rules.append(Rule(name, (token,), KEEP + more, "K", "-"))
                elif name != "system":
                    rules.append(Rule(name, (token,), REROLE + more, "R", name[0]))
    return Grammar("talk", rules)


@functools.cache
def roles() -> Grammar:
    return role_grammar()


@functools.lru_cache(1 << 14)
def repair_of(tokens: str) -> Value:
    found = roles().parse(tokens)
    assert found is not None  # every row may be deleted
    return found
