from collections import Counter

import numpy as np
import pyarrow as pa

from gridmill.llm import language_id as L

SAY = {"en": "the cat and the dog are in this house with us ", "de": "der hund und die katze sind nicht in diesem haus ", "fr": "le chat et le chien sont dans cette maison avec nous "}


def rows(spark, n=60):
    made = [(i, (t := list(SAY)[i % 3]) and SAY[t][i % 7 :] + SAY[t] * (i % 4 + 1), t) for i in range(n)]
    return spark.createDataFrame(made, "doc_id long, text string, lang string")


def test_held_out_texts_get_their_language(spark):
    docs = rows(spark)
    model = L.train(docs.where(~L.held_out(docs.doc_id)))
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = {r.doc_id for r in docs.where(L.held_out(docs.doc_id)).collect()}
    assert held == {d for d in truth if L.crc_fold(d) == 0} and held
    got = L.identify(docs, model).collect()
    assert all(r.lang_pred == truth[r.doc_id] and 0 < r.score <= 1 for r in got)


def test_accuracy_on_the_smallest_tables(spark):
    d = "/root/testdata/sf0.001"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    held = [r for r in L.query(spark, d).collect() if r.held_out]
    assert len(held) > 20 and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)


def test_edge_rows(spark, edge, empty):
    model = L.train(rows(spark))
    got = {(r.doc_id, r.lang_pred) for r in L.identify(edge, model).collect()}
    assert {(2, "und"), (3, "und"), (6, "und")} <= got and {p for _, p in got} <= {*SAY, "und"}
    assert L.identify(empty, model).count() == 0
    nothing = L.train(edge.where("lang = 'xx'"))
    assert {r.lang_pred for r in L.identify(edge, nothing).collect()} == {"und"}
    kept = L.stage(spark, edge, "")
    assert kept.columns == edge.columns and not {2, 3, 6} & {r.doc_id for r in kept.collect()}


def built(spark, grams):
    """The filter of given n-grams, put together as training does."""
    rows = [(l, g) for l, found in grams.items() for g in found]
    languages = sorted(grams)
    masks = L.slot_masks(spark.createDataFrame(rows, "lang string, gram long"), languages)
    return L.filter_of(languages, [len(grams[l]) for l in languages], masks)


def test_filter_finds_all_that_was_put_in_and_texts_do_not_mix(spark):
    rng = np.random.default_rng(1)
    grams = {f"l{k}": [int(g) for g in rng.integers(0, 1 << 32, 3000)] for k in range(12)}
    model = built(spark, grams)
    for k, name in enumerate(model.languages):
        (found,) = model.masks_of(np.array(grams[name], np.uint32))
        assert (found >> np.uint64(k) & np.uint64(1)).all()
    assert model.false_rate.max() < 1e-3
    texts = pa.array([b"", b"ab", b"abcd efgh", b"abcd"], pa.large_binary())
    data, offsets = L.letters(texts)
    assert bytes(data) == b"  " + b" ab " + b" abcd efgh " + b" abcd " and list(offsets) == [0, 2, 6, 17, 23]


def test_more_languages_than_one_mask_holds(spark):
    grams = {f"l{k:03}": [k * 100 + i for i in range(50)] for k in range(150)}
    model = built(spark, grams)
    assert len(model.masks) == 3
    for k, name in enumerate(model.languages):
        found = model.masks_of(np.array(grams[name], np.uint32))[k // L.BITS]
        assert (found >> np.uint64(k % L.BITS) & np.uint64(1)).all()


def test_prediction_as_with_exact_sets_of_n_grams(spark):
    """Against plain Python with one exact set for each language: without false positives nothing else decides."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: (r.text or "", r.lang) for r in docs.collect()}

    def grams(text):
        plain = b" " + text.encode().translate(L.LETTERS) + b" "
        return [plain[i : i + L.GRAM] for i in range(len(plain) - L.GRAM + 1)]

    counts = {}
    for text, lang in texts.values():
        if lang is not None:
            for g in grams(text):
                counts.setdefault(lang, Counter())[g] += 1
    share = {l: {g: n / c.total() for g, n in c.items()} for l, c in counts.items()}
    best = Counter()
    for s in share.values():
        for g, x in s.items():
            best[g] = max(best[g], x)
    sets = {l: {g for g, x in s.items() if x >= max(L.RARE, L.SHARE * best[g])} for l, s in share.items()}
    for r in L.identify(docs, L.train(docs)).collect():
        own = grams(texts[r.doc_id][0])
        want = {l: sum(g in s for g in own) / max(1, len(own)) for l, s in sets.items()}
        if r.lang_pred == "und":
            assert not any(c.isalpha() for c in texts[r.doc_id][0])
        else:
            assert abs(r.score - want[r.lang_pred]) < 0.02 and want[r.lang_pred] > max(want.values()) - 0.02
