import random

from pyspark.sql import functions as F

from quillmesh.llm import decontamination as d


def prose(rng, n):
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "é"]
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 5))) for _ in range(n))


def edited(rng, text, k):
    out = list(text)
    for _ in range(k):
        at = rng.randrange(len(out))
        out[at : at + 1] = rng.choice([[], [out[at], "x"], ["q"]])
    return "".join(out)


def cases():
    rng = random.Random(7)
    items = [(i, prose(rng, rng.randint(15, 50))) for i in range(12)]
    texts = []
    for n in range(80):
        text = prose(rng, rng.randint(5, 150))
        if n % 2:
            item = rng.choice(items)[1]
            part = item if n % 4 == 1 else item[: int(len(item) * rng.choice([0.3, 0.6, 0.8]))]
            cut = rng.randrange(len(text))
            text = text[:cut] + ". " + edited(rng, part, rng.choice([0, 1, 3, len(part) // 12, len(part) // 6])).upper() + " " + text[cut:]
        texts.append(text)
    return items, texts


def test_search_equals_brute_force():
    """The filter and the bands lose nothing that alignment over all diagonals finds."""
    items, texts = cases()
    index = d.Index([(i, d.normal(t)) for i, t in items])
    own = [d.normal(t) for t in texts]
    got = {(t, i) for t, i, *_ in index.search(own)}
    want = set()
    for t, text in enumerate(own):
        for i, item in enumerate(index.texts):
            ((_, *best),) = d.align([(item, text, -len(item), len(text))])
            if best[3] - best[2] >= index.region[i] and best[4] <= d.ERRORS * (best[3] - best[2]):
                want.add((t, i))
    assert len(want) > 20 and got == want


def test_spans_and_edges(spark):
    rng = random.Random(1)
    item = prose(rng, 40)
    clean = prose(random.Random(2), 300)
    rows = [(1, None), (2, ""), (3, clean), (4, f"Before -- É. {item.upper().replace(' ', ',  ')}! after"), (4, f"Before -- É. {item.upper().replace(' ', ',  ')}! after"), (None, item), (5, clean + " " + clean * 400 + item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("clash")).withColumn("edits", F.lit(1))
    benchmark = spark.createDataFrame([(9, item), (10, None), (11, ""), (12, "short"), (13, "?!")], "item_id long, text string")
    got = d.leaks(docs, benchmark).collect()
    assert sorted((r.doc_id or 0, r.item_id, r.edits) for r in got) == [(0, 9, 0), (4, 9, 0), (4, 9, 0), (5, 9, 0)]
    text = rows[3][1]
    span = next(r for r in got if r.doc_id == 4)
    assert text[span.start : span.end] == item.upper().replace(" ", ",  ")
    kept = d.decontaminate(docs, benchmark)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3]
    assert d.leaks(docs.where("false"), benchmark).count() == 0 and d.leaks(docs, benchmark.where("false")).count() == 0
    assert d.decontaminate(docs, benchmark.where("false")).count() == len(rows)


def test_blocks_find_the_same(spark):
    items, texts = cases()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    whole = {(r.doc_id, r.item_id) for r in d.leaks(docs, benchmark).collect()}
    parts = {(t, i) for index in d.blocks(benchmark, "item_id", "text", most=800) for t, k, *_ in index.search([d.normal(x) for x in texts]) for i in [index.ids[k]]}
    assert whole == parts and whole


def stands(item, text, region):
    """The rule itself: some region of the item of enough letters, with at most a tenth of edits, anywhere in the text."""
    for c in range(len(item) - region + 1):
        row = [0] * (len(text) + 1)
        for d in range(c, len(item)):
            new = [row[0] + 1]
            for k, x in enumerate(text):
                new.append(min(row[k] + (item[d] != x), row[k + 1] + 1, new[k] + 1))
            row = new
            if d + 1 - c >= region and 10 * min(row) <= d + 1 - c:
                return True
    return False


def clustered(rng, item, edits):
    """A copy with its edits at one place or spread, of any kind."""
    copy, middle, near = bytearray(item), rng.randrange(len(item)), rng.random() < 0.6
    for _ in range(edits):
        at = min(len(copy) - 1, max(0, middle + rng.randint(-3, 3))) if near else rng.randrange(len(copy))
        copy[at : at + 1] = rng.choice([b"", b"q" + copy[at : at + 1], b"w", b"j"])
    return bytes(copy)


def test_short_items_by_the_rule_itself():
    """Every length from 1 to 80, with as many edits as the rule allows and one more, at one place or spread."""
    rng = random.Random(21)
    letters = "abcdefghiklmnoprstu"
    found = missed = 0
    for n in [*range(1, 81)] * 4:
        item = "".join(rng.choice(letters) if rng.random() > 0.16 else " " for _ in range(n)).encode()
        item = b" ".join(item.split()) or b"x"
        most = len(item) // 10
        copy = clustered(rng, item, rng.choice([0, most, most, most, most + 1])) if len(item) >= 10 else rng.choice([item, item + b"s", b"s" + item])
        noise = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(12)]
        text = d.normal(" ".join(noise[:6]) + " " + copy.decode() + " " + " ".join(noise[6:]))
        index = d.Index([("id", item), ("none", b"")])
        got = index.search([b"", text])
        want = stands(item, text, int(index.region[0])) if len(item) >= 10 else b" " + item + b" " in b" " + text + b" "
        assert bool(got) == want, (item, text)
        assert all(t == 1 for t, *_ in got)
        found, missed = found + want, missed + (not want)
    assert found > 150 and missed > 40


def test_bounded_steps_find_the_same(monkeypatch):
    """Small steps, split runs, and pairs with more equal grams than a step: the same texts and items are found."""
    items, texts = cases()
    items += [(100, "la " * 40), (101, "la" * 9)]
    texts += ["la " * 700, "x " * 50 + "la " * 45, "lalalalalalalalala"]
    index = d.Index([(i, d.normal(t)) for i, t in items])
    own = [d.normal(t) for t in texts]
    whole = {x[:2] for x in index.search(own)}
    monkeypatch.setattr(d, "STEP", 500)
    monkeypatch.setattr(d, "PAIRS", 40)
    monkeypatch.setattr(d, "CELLS", 5000)
    assert {x[:2] for x in index.search(own)} == whole and len(whole) > 25


def test_ids_of_any_type_and_equal_names(spark):
    rng = random.Random(4)
    item = prose(rng, 30)
    docs = spark.createDataFrame([("d1", f"so {item} it is"), (None, item), ("d3", "clean")], "id string, text string")
    benchmark = spark.createDataFrame([("a", item), (None, item), ("b", None)], "id string, text string")
    got = d.leaks(docs, benchmark, id_col="id", item_col="id")
    assert got.columns[:2] == ["id", "_id"]
    assert sorted(str(tuple(r)[:2]) for r in got.collect()) == sorted(map(str, [("d1", "a"), ("d1", None), (None, "a"), (None, None)]))
    assert [r.id for r in d.decontaminate(docs, benchmark, item_col="id").collect()] == ["d3"]


def test_passes_over_many_blocks(spark):
    items, texts = cases()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    one = sorted(r.doc_id for r in d.decontaminate(docs, benchmark).collect())
    many = sorted(r.doc_id for r in d.decontaminate(docs, benchmark, most=300).collect())
    assert one == many and 0 < len(one) < len(texts)


def test_query(spark):
    from quillmesh.llm import queries

    sf = "/root/testdata/sf0.001"
    rows = queries.op2_decontamination(spark, sf).collect()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r.item_id: d.normal(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    exact = {(i, k) for i, t in docs.items() for own in [d.normal(t)] for k, item in items.items() if item in own}
    assert exact <= {(r.doc_id, r.item_id) for r in rows} and rows
    for r in rows:
        assert 0 <= r.start < r.end <= len(docs[r.doc_id]) and 10 * r.edits <= r.item_end - r.item_start


def test_regions_by_the_rule_itself():
    """One word of a short item replaced, edits unevenly spread, and near misses: leaks as the rule says."""
    rng = random.Random(11)
    pairs = []
    for n in range(60):
        item = d.normal(prose(rng, 40))[: rng.randint(81, 90) if n < 40 else 150].strip()
        copy = bytearray(item)
        if n < 40:
            at, k = rng.randrange(len(item) - 6), rng.choice([4, 5, 6, 7, 8, 9])
            copy[at : at + k] = b"q" * k
        else:
            for _ in range(rng.randint(8, 22)):
                at = int(rng.random() ** rng.choice([1, 3]) * len(copy))
                copy[at : at + 1] = rng.choice([b"", b"qq", b"w"])
        pairs.append((item, d.normal(prose(rng, 5)) + b" " + bytes(copy) + b" " + d.normal(prose(rng, 5))))
    leaked = spanned = 0
    for item, text in pairs:
        index = d.Index([(0, item)])
        region = int(index.region[0])
        got = index.search([text])
        want = stands(item, text, region)
        assert bool(got) == want, (item, text)
        leaked += want
        for _, _, a, b, c, e, edits in got:
            assert e - c >= region and 10 * edits <= e - c and 0 <= a < b <= len(text)
            row = list(range(b - a + 1))
            for x in item[c:e]:
                new = [row[0] + 1]
                for k, y in enumerate(text[a:b]):
                    new.append(min(row[k] + (x != y), row[k + 1] + 1, new[k] + 1))
                row = new
            assert row[-1] <= edits
        ((_, *best),) = d.align([(item, text, -len(item), len(text))])
        spanned += bool(best[3] - best[2] >= region and best[4] <= d.ERRORS * (best[3] - best[2]))
    assert spanned < leaked < len(pairs)
