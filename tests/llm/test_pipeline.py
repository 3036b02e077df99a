import hashlib
import re
import string

import public_tokenizers
import tiktoken

import corpus_pipeline
from gridmill.llm import bpe, decontaminate, language_id

FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
D = "/root/testdata/sf0.001"


def brute(spark):
    """The same decisions in plain Python; which language a text has is asked of the operator."""
    docs = spark.read.parquet(f"{D}/documents.parquet")
    langs = {r.doc_id: r for r in language_id.identify(docs, language_id.train(docs)).collect()}
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = {d: t for d, t in rows.items() if langs[d].lang_pred != "und" and langs[d].score >= language_id.ACCEPT}
    last = {}
    for d, t in sorted(rows.items()):
        last[t.translate(FOLD)] = d
    rows = {d: rows[d] for d in sorted(last.values())}

    sets, parent = {}, {}
    for d, t in rows.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(FOLD))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        parent[d] = d

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in rows:
        for b in rows:
            if b < a and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    rows = {d: t for d, t in rows.items() if find(d) == d}

    items = [re.findall(decontaminate.WORD, (r.text or "").translate(FOLD)) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + 10]) for w in items if w for i in range(max(1, len(w) - 9))}
    sizes = {len(w) for w in windows}

    def hit(t):
        w = re.findall(decontaminate.WORD, t.translate(FOLD))
        return any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))

    return {d: t for d, t in rows.items() if not hit(t)}


def test_pipeline_matches_plain_python(spark):
    ranks = bpe.load_ranks(public_tokenizers.path(bpe.VOCABULARY))
    real = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {d: hashlib.sha256(",".join(map(str, real.encode_ordinary(t))).encode()).hexdigest() for d, t in brute(spark).items()}
    got = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, D).collect()}
    assert got == want and 100 < len(got) < 200


def test_stages_take_odd_rows_and_empty_tables(spark, edge, empty):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty, D).count() == 0, name
        assert stage(spark, edge, D).columns == edge.columns, name
    assert corpus_pipeline.STAGES[-1][1](spark, edge, D).count() == edge.count()
