"""Entities against the standard library's own reading."""

import html
import random

from pyspark.sql import functions as F

from gridmill.functions import text as T

CASES = [
    "a &amp; b", "&amp;lt;", "&ampx", "&am", "&", "&&amp;&", "&notit;", "&notin;", "&NotEqualTilde;", "&middot;&copy &reg;", "&#39;&#x27;&#X2019;", "&#160;", "&#0;&#13;&#128;&#129;&#159;", "&#xD800;&#x110000;&#1;&#11;&#xFDD0;&#x1FFFF;",
    "&#99999999999999999999;", "&#x1F600;", "&#;", "&#x;", "&unknown;", "&AMP;&AMP", "&eacute;t&eacute", "no entity", "", None, "a&b;c", "&lt;p&gt;", "&#00000000065;", "x &  y", "&frac12;&frac12",
]


def test_entities_as_the_standard_library_reads_them(spark):
    rng = random.Random(3)
    some = ["".join(rng.choice(["&", "amp", "lt", ";", "#", "x", "39", "not", "in", "e", " ", "copy"]) for _ in range(rng.randint(1, 12))) for _ in range(400)]
    rows = [(i, t) for i, t in enumerate(CASES + some)]
    got = {r.i: r.t for r in spark.createDataFrame(rows, "i int, t string").select("i", T.unescape(F.col("t")).alias("t")).collect()}
    assert {i: got[i] for i, t in rows if t is not None and got[i] != html.unescape(t)} == {} and got[CASES.index(None)] is None
