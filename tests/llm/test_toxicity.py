import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from quillmesh.llm import toxicity
from quillmesh.llm.common import fold


def distance(a, b):
    """Edits with swaps of neighbours (each substring edited once)."""
    d = {(i, -1): i + 1 for i in range(-1, len(a))} | {(-1, j): j + 1 for j in range(-1, len(b))}
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (x != y))
            if i and j and x == b[j - 1] and a[i - 1] == y:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a) - 1, len(b) - 1]


def test_automaton_equals_distances():
    rng = random.Random(5)
    words, stems = ["idiot", "moron", "disgusting", "abc", "bananas", "banana"], ["achli", "dis"]
    automaton = toxicity.Automaton(words, stems)
    for _ in range(4000):
        w = list(rng.choice(words + stems))
        for _ in range(rng.randrange(4)):
            at, kind = rng.randrange(len(w) + 1), rng.randrange(4)
            if kind == 0:
                w.insert(at, rng.choice("abdiostz"))
            elif w and kind == 1:
                w[at % len(w)] = rng.choice("abdiostz")
            elif len(w) > 1 and kind == 2:
                del w[at % len(w)]
            elif len(w) > 1:
                i = at % (len(w) - 1)
                w[i], w[i + 1] = w[i + 1], w[i]
        w = "".join(w)
        want = min([(0, -1) for s in stems if w.startswith(s)] + [(distance(t, w), i) for i, t in enumerate(words) if distance(t, w) <= toxicity.allowed_errors(t)], default=None)
        got = automaton.find(w)
        assert (got is None) == (want is None), w
        assert got is None or got[1] == want[0], w


def test_context_and_nulls():
    model = toxicity.train([], {})
    abuse, quote, clean, wrong = model.score(["you idiot, you stupid moron", 'they said "idiot" and wrote "stupid moron"', "a fine day", "you idoit, you stupidd morron"])
    assert abuse > 0.5 > quote and clean < 0.1 and quote < wrong and abuse > wrong > 0.5
    assert (model.score([None, ""]) == model.score([""])[0]).all()
    assert model.score(["word " * 300_000 + "idiot"])[0] < abuse


def test_apostrophes_and_unpaired_marks_are_no_quotation():
    model = toxicity.train([], {})
    abuse = [
        "i'm telling you: you're an idiot, y'all know it's true",
        "don't be stupid, you idiot, it's the dogs' dinner",
        'a 6" pipe, you idiot moron, and one of 7" length',
        'see "one" you idiot moron and "two" there',
        "he’s an idiot and she’s a moron, it’s so",
        "«yes» idiot moron «no»",
    ]
    quotes = ['he "is an idiot moron" ok', "so “an idiot, a moron” it was", "the 'idiot moron' bit", "das „idiot moron“ da", "les « idiot moron » ici", "it's 'an idiot moron' it's", "»idiot moron« also"]
    assert all(s > 0.5 for s in model.score(abuse)) and all(s < 0.5 for s in model.score(quotes))


def plain_features(model, text):
    """Word by word, with nothing shared: hits by distance, marks paired by a plain scan of the window."""
    spans, at = [], 0
    while at < len(text):
        end = at
        while end < len(text) and text[end].isalnum():
            end += 1
        if end > at:
            spans.append((at, end))
        at = max(end, at + 1)
    words = [text[a:b] for a, b in spans]
    counts, terms = [0, 0, 0], set()
    for i, w in enumerate(words):
        hit = min([(distance(t, w), n) for n, (t, kind) in enumerate(model.automaton.terms) if kind == toxicity.WHOLE and distance(t, w) <= toxicity.allowed_errors(t)], default=None)
        if hit is None or hit[0] and w in model.ordinary:
            continue
        terms.add(hit[1])
        lo, hi = (spans[i - 7][1] if i > 6 else 0), (spans[i + 7][0] if i + 7 < len(spans) else len(text))
        opened = []
        quoted = any(words[j] in toxicity.REPORTING for j in range(max(0, i - 6), i))
        for k in range(lo, hi):
            c = text[k]
            if c not in toxicity.CLOSERS:
                continue
            left, right = text[k - 1] if k else " ", text[k + 1] if k + 1 < len(text) else " "
            opens, closes = not left.isalnum() and (c in "“„«‘" or not right.isspace()), not right.isalnum() and (c in "”»" or not left.isspace())
            if k >= spans[i][1]:
                quoted |= closes and any(c in toxicity.CLOSERS[o] for o in opened)
            elif k < spans[i][0]:
                fits = [n for n, o in enumerate(opened) if c in toxicity.CLOSERS[o]]
                if closes and fits:
                    opened = opened[: fits[-1]]
                elif opens:
                    opened.append(c)
        counts[0 if quoted else 1 if hit[0] else 2] += 1
    quoted, wrong, plain = counts
    sure, n = plain + 0.7 * wrong + 0.1 * quoted, math.log(1 + len(words))
    return [math.log(1 + sure), math.log(1 + len(terms)), math.log(1 + sure) * n / 6, n, min(1.0, sure)]


def test_window_and_features_against_brute_force():
    rng = random.Random(8)
    model = toxicity.Model(["idiot", "moron", "scum"], [], frozenset({"idiom"}))
    bits = ["idiot", "moron", "idoit", "idiom", "morom", "scum", "said", "ok", "it's", "a", "'", '"', "“", "”", "„", "«", "»", "’", "`", " ", " ", " ", ", ", "!"]
    for _ in range(1500):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 45)))
        assert np.allclose(model.features(text), plain_features(model, text)), text


def corpus(n=900):
    rng = random.Random(2)
    syllables = ["ka", "lo", "mi", "tru", "ven", "po", "sha", "ri", "do", "en"]

    def words(k):
        return ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(k)]

    rows = []
    for i in range(n):
        text, bad = words(rng.randint(10, 80)), rng.random() < 0.25
        for _ in range(rng.randint(3, 6) if bad else 0):
            text.insert(rng.randrange(len(text)), rng.choice(["idiot", "gronk", "zusho" + rng.choice(syllables), "scum"]))
        rows.append((i, " ".join(text), int(bad)))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("label", F.lit(3))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(1, None), (None, 1), (5000, 1)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels, fold("doc_id", 5) != 0)
    assert "gronk" in model.words and any("zusho".startswith(s) or s.startswith("zusho") for s in model.stems)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [(got[i] >= 0.5, bool(y)) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([a == b for a, b in held]) > 0.97
    kept = toxicity.reject(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(s < 0.5 for s in got.values())


def test_nulls_repeats_and_empty(spark):
    docs = spark.createDataFrame([(1, None), (1, None), (None, ""), (2, "idiot stupid scum")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.learn(docs, none, fold("doc_id", 5) != 0)
    assert sorted(r.score > 0.5 for r in toxicity.score(docs, model).collect()) == [False, False, False, True]
    assert toxicity.score(docs.where("false"), model).count() == 0


def test_clashing_columns_stay(spark):
    docs = spark.createDataFrame([(1, "a fine day", "own", 2), (2, "you idiot moron scum", "mine", 3), (None, None, None, None)], "doc_id long, text string, _score string, __SCORE int")
    kept = toxicity.reject(docs, toxicity.train([], {}))
    assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == sorted(map(str, docs.where("doc_id = 1 OR doc_id IS NULL").collect()))


def test_sample_takes_the_same_text_of_a_repeated_id(spark):
    from quillmesh.llm.common import labelled_sample

    docs = spark.createDataFrame([(1, t) for t in "bca"] + [(2, "x"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (3, 1), (3, 0)], "doc_id long, toxic int")
    for n in (1, 3):
        sample, counts = labelled_sample(docs.repartition(n), labels, "toxic", F.lit(True), 10, 10)
        assert sorted(sample) == [("a", 1), ("x", 0)] and counts == {0: 1, 1: 1}


def test_query(spark):
    from quillmesh.llm import queries

    rows = queries.op3_toxicity(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1
