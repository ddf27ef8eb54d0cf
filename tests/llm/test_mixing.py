import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from quillmesh.llm import mixing


def brute(rows, rate, temper):
    """rows: (id, source, lang, topic, tokens) to {id: (weight, prob)}."""
    cells = defaultdict(float)
    for _, *key, n in rows:
        cells[tuple(key)] += n
    total = sum(cells.values())
    raked = {k: n / total for k, n in cells.items()}
    most = {k: n / (total * rate) for k, n in cells.items()}
    goals = []
    for m in range(3):
        by = defaultdict(float)
        for k, n in cells.items():
            by[k[m]] += n
        power = {v: n**temper for v, n in by.items() if n}
        bound = {v: by[v] / (total * rate) for v in power}
        scale = 1 / sum(power.values())
        for _ in range(mixing.LOWERED):
            fixed = sum(bound[v] for v in power if power[v] * scale >= bound[v])
            free = sum(p for v, p in power.items() if p * scale < bound[v])
            if not free or fixed >= 1:
                break
            scale = (1 - fixed) / free
        goals.append({v: min(bound[v], p * scale) for v, p in power.items()})
        raked = {k: x * (mixing.WHOLE if power.get(k[m], 0) * scale >= bound.get(k[m], 1) else 1) for k, x in raked.items()}
    for _ in range(mixing.SWEEPS):
        for m in range(3):
            by = defaultdict(float)
            for k, x in raked.items():
                by[k[m]] += min(x, most[k])
            raked = {k: x * goals[m].get(k[m], 0) / by[k[m]] if by[k[m]] else 0.0 for k, x in raked.items()}
    weight = {k: min(raked[k], most[k]) * total / n if n else 1.0 for k, n in cells.items()}
    return {i: (weight[tuple(k)], min(1.0, weight[tuple(k)] * rate)) for i, *k, _ in rows}


def test_against_brute_force(spark):
    rows = [(i, ("a", "a", "b", "c", None)[i % 5], ("en", "de")[i % 7 == 0], " ".join(["w"] * (i % 13 + 1)) + (" !!!!" if i % 4 == 0 else "")) for i in range(200)]
    rows += [(None, "a", None, None), (200, "z", "en", ""), (200, "z", "en", ""), (201, "b", "en", "long " * 60_000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string").withColumns({"prob": F.lit("x"), "tokens": F.lit(1), "topic": F.lit("t")})
    got = mixing.weigh(docs).collect()
    assert len(got) == len(rows)
    want = brute([(r.doc_id, r.source, r.lang, r.topic, r.tokens) for r in got], mixing.RATE, mixing.TEMPER)
    for r in got:
        assert abs(r.weight - want[r.doc_id][0]) < 1e-9 and abs(r.prob - want[r.doc_id][1]) < 1e-9
        u = int(hashlib.md5(f"mix:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()[:8], 16) / 2**32
        assert r.kept == (u < want[r.doc_id][1])
    kept = sorted(r.doc_id for r in got if r.kept and r.doc_id is not None)
    sampled = mixing.sample(docs)
    assert sampled.columns == docs.columns
    assert sorted(r.doc_id for r in sampled.collect() if r.doc_id is not None) == kept
    assert {r.tokens for r in got if r.doc_id == 201} == {60_000} and {r.tokens for r in got if r.doc_id in (None, 200)} == {0}


def test_targets_are_met(spark):
    rows = [(i, "a" if i % 10 else "b", "en", "one two three") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string")
    even = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "source string, goal double")
    got = mixing.weigh(docs, targets={"source": even}, rate=0.2).groupBy("source").agg(F.sum(F.col("prob") * F.col("tokens")).alias("t")).collect()
    assert all(abs(r.t - 300) < 1e-6 for r in got)


def test_margins_hold_where_cells_are_kept_whole(spark):
    """Goals that take some cells whole: the margins of what is kept are the goals, and no probability passes 1."""
    rows = [(i, "ab"[i % 7 == 0], ("en", "de", "fr")[i % 3], "w " * (1 + i % 5) + ("!!" if i % 11 == 0 else "")) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string")
    goals = {"source": {"a": 0.78, "b": 0.22}, "lang": {"en": 0.5, "de": 0.3, "fr": 0.2}, "topic": {"prose": 0.88, "shouted": 0.12}}
    targets = {m: spark.createDataFrame(list(g.items()), f"{m} string, goal double") for m, g in goals.items()}
    found = mixing.weigh(docs, targets=targets, rate=0.6)
    whole = found.where("prob >= 0.999999").count()
    assert 0 < whole < 900 and found.agg(F.max("prob")).first()[0] <= 1
    for r in mixing.margins(found).collect():
        assert abs(r.expected - goals[r.margin][r.value]) < 1e-4, r
    kept, total = found.agg(F.sum(F.col("prob") * F.col("tokens")), F.sum("tokens")).first()
    assert abs(kept / total - 0.6) < 1e-4


def test_goals_that_cannot_be_reached_are_lowered(spark):
    """A value that is asked for more than it has is kept whole; the others take up the rest in proportion."""
    rows = [(i, "abc"[(i % 10 > 0) + (i % 10 > 6)], "en", "one two") for i in range(1000)]  # a: 0.1, b: 0.6, c: 0.3
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string")
    goal = spark.createDataFrame([("a", 0.5), ("b", 0.3), ("c", 0.2), ("d", 0.1)], "source string, goal double")
    got = {r.value: r.expected for r in mixing.margins(mixing.weigh(docs, targets={"source": goal}, rate=0.5)).where("margin = 'source'").collect()}
    assert abs(got["a"] - 0.2) < 1e-9 and abs(got["b"] - 0.48) < 1e-9 and abs(got["c"] - 0.32) < 1e-9


def test_clashing_columns_stay(spark):
    rows = [(i, "ab"[i % 2], "en", "one two three", f"p{i}", f"s{i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string, _prob string, _source string").withColumn("__SOURCE", F.lit(1)).withColumn("_topic", F.lit("t")).withColumn("tokens", F.lit(2))
    kept = mixing.sample(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    assert 0 < len(got) < 60 and all((r._prob, r._source, r._topic, r.tokens) == (f"p{r.doc_id}", f"s{r.doc_id}", "t", 2) for r in got)


def test_query_equals_its_sql(spark):
    import duckdb

    from quillmesh.llm import queries

    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    found = queries.op1_mixing(spark, "/root/testdata/sf0.001")
    want = con.sql(queries.ORACLES["op1_mixing"])
    order = sorted(found.columns)
    assert order == sorted(want.columns)
    at = [want.columns.index(c) for c in order]
    assert sorted(str([r[c] for c in order]) for r in found.collect()) == sorted(str([r[k] for k in at]) for r in want.fetchall())


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, lang string, text string")
    assert mixing.weigh(docs).count() == 0 and mixing.sample(docs).count() == 0


def test_topics(spark):
    """Texts with a twentieth of digits or more are figures, after the other marks; fewer leave prose."""
    texts = {"In 1998 it was 20,417 of 33,900": "figures", "word " * 19 + "12345": "figures", "word " * 19 + "1234x": "prose", "12 | 13": "table", "5% of 7%": "symbols", "99 bottles!!": "shouted", "\u0665" * 20: "prose", "": "empty"}
    docs = spark.createDataFrame([(i, "a", "en", t) for i, t in enumerate(texts)], "doc_id long, source string, lang string, text string")
    assert [r.topic for r in mixing.weigh(docs).orderBy("doc_id").collect()] == list(texts.values())


def test_few_cells_are_raked_without_exchanges(spark, monkeypatch):
    """The sweeps are a handful of stages, not some for each margin of each sweep; dealt out, they give the same."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sc = spark.sparkContext

    def run(group):
        sc.setJobGroup(group, group)
        try:
            got = {r.doc_id: (r.weight, r.prob, r.kept) for r in mixing.weigh(docs).collect()}
        finally:
            sc.setLocalProperty("spark.jobGroup.id", None)
        found = sc.statusTracker()
        return got, sum(len(found.getJobInfo(job).stageIds) for job in found.getJobIdsForGroup(group))

    got, stages = run("few cells")
    assert 0 < stages < 100
    monkeypatch.setattr(mixing, "FEW", 0)
    dealt, stages = run("many cells")
    assert stages > 100 and dealt.keys() == got.keys()
    assert all(abs(a - b) < 1e-9 for i in got for a, b in zip(got[i][:2], dealt[i][:2])) and all(got[i][2] == dealt[i][2] for i in got)
