import hashlib
import random

import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from gridmill.llm import bpe

RANKS = bpe.load_ranks(public_tokenizers.path(bpe.VOCABULARY))
REAL = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def coded(texts):
    coder = bpe.Encoder(RANKS)
    return [([int(i) for i in ids.split(b",")] if ids else [], coder.decode(ids)) for ids in coder.encode(texts)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=6))
def test_any_text_encodes_as_tiktoken_does(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    for text, (ids, back) in zip(texts, coded(texts)):
        assert ids == REAL.encode_ordinary(text)
        assert back == text.encode()


def test_replay_order_within_long_and_repetitive_words():
    rng = random.Random(1)
    words = ["".join(rng.choice("aabetinrsh") for _ in range(rng.randint(1, 400))) for _ in range(300)] + ["a" * 5000, "ab" * 4000]
    for word, (ids, _) in zip(words, coded(words)):
        assert ids == REAL.encode_ordinary(word)


def test_rows_and_edge_cases(spark, edge, empty):
    rows = bpe.encode(edge, with_ids=True).collect()
    texts = {r.doc_id: r.text or "" for r in edge.collect()}
    assert len(rows) == edge.count()
    for r in rows:
        ids = REAL.encode_ordinary(texts[r.doc_id])
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(edge, with_ids=True)).collect()}
    assert back == texts
    assert bpe.encode(empty).count() == 0
