import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from quillmesh.llm import quality as q
from quillmesh.llm.common import fold


def corpus(n=700):
    rng = random.Random(6)
    syllables = ["ka", "lo", "mi", "tru", "ven", "po", "sha", "ri", "do", "en"]
    rows = []
    for i in range(n):
        words, good = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(10, 80))], rng.random() < 0.7
        if not good:
            words = rng.choice([[w.upper() + "!!" for w in words], [w + "%%%" for w in words], [w for w in words[:6] for _ in range(12)]])
        rows.append((i, " ".join(words), int(good)))
    return rows


def test_word_hashes_by_definition():
    words = [b"one", b"two", b"x" * 70, "éß".encode(), b"two"]
    want = [sum(b * pow(q.ODD, i, 1 << 64) for i, b in enumerate(w)) * 0xD6E8FEB86659FD93 % (1 << 64) for w in words]
    assert q.word_hashes(b"  " + b" \n".join(words)).tolist() == want
    text = "one two, three " * 200
    whole = q.features(text)
    old, q.CHUNK = q.CHUNK, 64
    try:
        parts = q.features(text)
    finally:
        q.CHUNK = old
    assert all(np.allclose(a, b) for a, b in zip(whole, parts))


def test_linear_time_score_equals_all_pairs():
    model = q.train([r[1:] for r in corpus(200)], {0: 60, 1: 140})
    text = corpus(201)[-1][1]
    at, x = model.row(text, 9)
    z = model.base + model.w[at] @ x + sum(model.v[at[i]] @ model.v[at[j]] * x[i] * x[j] for i in range(len(at)) for j in range(i))
    assert abs(model.score(text, 9) - 1 / (1 + np.exp(-z))) < 1e-9


def test_held_out_accuracy_and_edges(spark):
    rows = corpus()
    more = [(9001, None, None), (9002, "", 0), (9002, "", 0), (None, "ka lo", 5), (9003, "x" * 3_000_000 + " ka lo", 7)]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t, _ in rows] + more, "doc_id long, text string, n_chars long").withColumn("score", F.lit("clash")).withColumn("label", F.lit(0))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(1, None), (None, 0)], "doc_id long, quality int")
    model = q.learn(docs, labels, fold("doc_id", 3) != 1)
    got = q.score(docs, model).collect()
    assert len(got) == len(rows) + len(more) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.score for r in got}
    held = [(by[i] >= 0.5) == bool(y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean(held) > 0.96
    assert q.score(docs.where("false"), model).count() == 0
    blind = q.learn(docs, labels.where("false"), fold("doc_id", 3) != 1)
    assert len({r.score for r in q.score(docs, blind).collect()}) == 1


def test_lengths_come_from_the_same_column(spark):
    """A length column that is not the text's length, and nulls in it, mean the same in training and scoring."""
    rows = [(i, "ka lo mi " * (1 + i % 5), None if i % 2 else 1000 + i % 7) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(400)], "doc_id long, quality int")
    model = q.learn(docs, labels, F.lit(True))
    got = {r.doc_id: r.score for r in q.score(docs, model).collect()}
    assert all((got[i] >= 0.5) == (i % 2 == 0) for i in range(400))
    assert not model.v[(model.v == 0).all(1)].any() and (model.v == 0).all(1).any()


def test_query(spark):
    from quillmesh.llm import queries

    rows = queries.op7_quality(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1
