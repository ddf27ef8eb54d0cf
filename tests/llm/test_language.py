import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from quillmesh.llm import language as g
from quillmesh.llm.common import fold

SYLLABLES = {"aa": ["ka", "lo", "mi", "tru"], "bb": ["ven", "po", "sha", "é"], "cc": ["ri", "do", "en", "ß"]}


def corpus(n=600):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(SYLLABLES))
        text = " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(3, 40)))
        rows.append((i, text.upper() if i % 9 == 0 else text, lang))
    return rows


def test_subwords_by_definition():
    """Against a plain loop, over a chunk's edge too."""
    text = "Été 12 the Ab" + " word" * 700
    data = g.letters(text)
    want = {}
    for size in g.SIZES:
        for i in range(len(data) - size + 1):
            gram = data[i : i + size]
            if 32 in gram[1:-1]:
                continue
            key = 0
            for b in gram:
                key = (key * 257 + b) % 2**32
            key = ((key ^ size) * 2654435761 % 2**32) >> 17
            want[key] = want.get(key, 0) + 1
    at, share = g.bag(text)
    assert {int(a): round(s * sum(want.values())) for a, s in zip(at, share)} == want
    old, g.CHUNK = g.CHUNK, 100
    try:
        again = g.bag(text)
    finally:
        g.CHUNK = old
    assert (again[0] == at).all() and np.allclose(again[1], share)


def test_scoring_equals_average_then_layer():
    model = g.fit([(t, y) for _, t, y in corpus(200)])
    at, share = g.bag("kalo mitru ven")
    assert np.allclose(model.logits("kalo mitru ven"), share @ model.table[at] + model.bias, atol=1e-4)


def test_held_out_accuracy_and_edges(spark):
    rows = [*corpus(), (9001, None, "aa"), (9002, "", "bb"), (9003, "12 !?", None), (9003, "12 !?", None), (None, "ka lo mi", None), (9004, "ven po sha " * 90_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash")).withColumn("rejected", F.lit(1))
    model = g.learn(docs, fold("doc_id", 4) != 2)
    assert model.langs == ["aa", "bb", "cc"]
    got = g.predict(docs, model).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    held = [by[i].lang_pred == y for i, _, y in corpus() if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean(held) > 0.98
    assert all(0 <= r.score <= 1 for r in got)
    assert {by[i].lang_pred for i in (9001, 9002, 9003)} == {g.UNKNOWN} and by[None].lang_pred == "aa" and by[9004].lang_pred == "bb"
    assert g.predict(docs.where("false"), model).count() == 0
    empty = g.learn(docs.where("false"), fold("doc_id", 4) != 2)
    assert {r.lang_pred for r in g.predict(docs, empty).collect()} == {g.UNKNOWN}


def jobs_of(spark, name, work):
    spark.sparkContext.setJobGroup(name, name)
    try:
        out = work()
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_every_language_is_learned_in_two_passes(spark):
    """More languages than any bound, one of them of long texts only; jobs do not grow with the languages."""
    rng = random.Random(9)
    few = spark.createDataFrame([(i, f"{SYLLABLES[y][i % 3] * 3} word", y) for i, y in enumerate(["aa", "bb"] * 20)], "doc_id long, text string, lang string")
    rows = [(1000 * k + i, " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" * 2 for _ in range(rng.randint(2, 6))), f"l{k:03}") for k in range(430) for i in range(2)]
    rows += [(900_000 + i, "zyzzy " * 5000, "long") for i in range(3)]
    many = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    _, a = jobs_of(spark, "few", lambda: g.learn(few, F.lit(True)))
    model, b = jobs_of(spark, "many", lambda: g.learn(many, F.lit(True), in_all=400))
    assert a == b and len(model.langs) == 431 and "long" in model.langs
    assert model.table.shape == (g.BUCKETS, g.DIM) and model.layer.shape == (g.DIM, 431)


def test_sample_is_bounded(spark, monkeypatch):
    """No more bags than the bounds allow, the short texts first, and the same ones in any layout."""
    seen = []
    monkeypatch.setattr(g, "fit_bags", lambda rows, seed=1: seen.append([(y, at.tolist()) for (at, _), y in rows]) or g.Model())
    docs = spark.createDataFrame([(i, f"ka lo mi {'tru' * (i % 7)}" + " ven" * (5000 * (i % 4 == 0)), ("aa", "bb")[i % 2]) for i in range(400)], "doc_id long, text string, lang string")
    for n in (1, 5):
        g.learn(docs.repartition(n), F.lit(True), per_lang=30, in_all=50, longest=100)
    assert len(seen[0]) == 50 and seen[0] == seen[1]
    ven = {int(b) for b in g.bag("ven ven")[0]}
    assert not any(ven <= set(at) for _, at in seen[0])


def test_query(spark):
    from quillmesh.llm import queries

    rows = queries.op4_language(spark, "/root/testdata/sf0.001").collect()
    docs = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 for r in rows)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    right = [r.lang_pred == docs[r.doc_id].lang for r in rows if r.held_out and docs[r.doc_id].lang and r.lang_pred != g.UNKNOWN]
    assert np.mean(right) > 0.95
