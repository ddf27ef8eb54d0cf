import os

from pyspark.sql import functions as F

import corpus_pipeline as p
from quillmesh.llm import common, decontamination, mixing, simhash, toxicity
from quillmesh.llm.common import fold, table

SF = "/root/testdata/sf0.001"


def test_stages_against_their_parts(spark, tmp_path):
    """Each stage on what the last one wrote; decisions recomputed text by text on the driver."""
    docs = table(spark, SF, "documents")
    columns, at = docs.columns, docs
    texts = {r.doc_id: r.text for r in docs.collect()}
    model = toxicity.learn(docs, table(spark, SF, "labels"), fold("doc_id", 5) != 0)
    for name, stage in p.STAGES:
        before = sorted(r.doc_id for r in at.select("doc_id").collect())
        path = str(tmp_path / name)
        stage(spark, at, SF).write.parquet(path)
        after = spark.read.parquet(path)
        got = sorted(r.doc_id for r in after.select("doc_id").collect())
        if name == "toxicity":
            want = [i for i in before if model.score([texts[i]])[0] < 0.5]
        elif name == "near_dedup":
            prints = {i: simhash.fingerprint(texts[i]) for i in before}
            label = {i: i for i in before}
            for _ in before:
                changed = False
                for i in before:
                    for j in before:
                        if label[j] > label[i] and (prints[i] ^ prints[j]).bit_count() <= simhash.DISTANCE:
                            label[j], changed = label[i], True
                if not changed:
                    break
            want = [i for i in before if label[i] == i]
        elif name == "decontamination":
            index = decontamination.Index([(r.item_id, decontamination.normal(r.text)) for r in table(spark, SF, "benchmark").collect()])
            want = [i for i in before if not index.search([decontamination.normal(texts[i])])]
        elif name == "mixing":
            want = sorted(r.doc_id for r in mixing.weigh(at).where("kept").collect())
        else:
            counts = sorted(r["count"] for r in after.groupBy("shard").count().collect())
            assert counts[-1] - counts[0] <= 1
            want = before
        assert got == want, name
        assert name == "sharding" or after.columns == columns
        at = after
    assert p.run(spark, SF).count() == at.count()
    top = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    assert not [x for folder in os.listdir(top) if folder.startswith("pipeline-") for x in os.listdir(f"{top}/{folder}")]


def test_stages_with_nulls_repeats_and_clashing_names(spark):
    """Every stage on odd rows and on none: nothing fails, nothing but its decision drops a row."""
    prose = {i: " ".join(f"w{i}x{k}" for k in range(60)) for i in range(6)}
    odd = [(1, prose[1], "en", "a", 1), (1, prose[1], "en", "a", 1), (None, prose[2], None, None, None), (2, None, "en", "a", 0), (3, "", None, "b", 0), (4, "  ", "en", None, 2), (5, prose[3] + " long" * 50_000, "en", "a", 9)]
    docs = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(7) for c in ("_score", "_prob", "_SIGN", "_source", "shard", "_gone")})
    want = {"toxicity": 7, "near_dedup": 4, "decontamination": 7}
    for name, stage in p.STAGES:
        got = stage(spark, docs, SF)
        rows = got.collect()
        if name == "sharding":
            assert len(rows) == 7
        else:
            assert got.columns == docs.columns and len(rows) == want.get(name, len(rows))
        assert stage(spark, docs.where("false"), SF).count() == 0, name


def test_sharding_brings_related_documents_together(spark):
    """What near_dedup leaves has no equal texts; those that share a long line go to one shard, with room for them."""
    def line(*key):
        return " ".join(f"w{'x'.join(map(str, key))}x{k}" for k in range(30))

    rows = [(i, "\n".join([line("own", i, 0), line("group", i // 5), line("own", i, 1)])) for i in range(100)]
    rows += [(1000 + i, line("free", i)) for i in range(700)] + [(5000, rows[0][1]), (5001, rows[7][1])]
    docs = p.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF)
    top = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    there = set(os.listdir(top))
    got = p.to_shards(spark, docs, SF).collect()
    shard = {r.doc_id: r.shard for r in got}
    assert sorted(shard) == sorted(i for i, _ in rows if i < 5000) and len(got) == len(shard)
    assert [{shard[i] for i in range(g * 5, g * 5 + 5)} for g in range(20)] == [{shard[g * 5]} for g in range(20)]
    assert not any(r.cut for r in got)
    assert not [x for folder in set(os.listdir(top)) - there if folder.startswith("lines-") for x in os.listdir(f"{top}/{folder}")]


def test_stages_of_many_jobs_give_freed_memory_back(spark, monkeypatch):
    """The driver's JVM keeps what a stage has freed outside its heap, unless it is asked; that fails softly."""
    assert not common.trim(spark, "noSuchCommand")
    calls, trim = [], common.trim
    monkeypatch.setattr(common, "trim", lambda spark: calls.append(trim(spark)))
    docs = table(spark, SF, "documents").limit(40)
    for name, stage in p.STAGES:
        before = len(calls)
        stage(spark, docs, SF)
        assert len(calls) > before or name == "decontamination", name  # which is one job
