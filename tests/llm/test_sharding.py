import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quillmesh.llm import sharding


def check(rows, got, n_shards):
    assert len(got) == len(rows)
    counts = Counter(r.shard for r in got)
    all_counts = [counts.get(s, 0) for s in range(n_shards)]
    assert sum(all_counts) == len(rows) and max(all_counts) - min(all_counts) <= 1
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    want = sorted(((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows), key=str)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=str) == want
    assert {r.law for r in got} == {"rows"}


def text_of(rows, got):
    return {i: t for i, t in rows}, {r.doc_id: r.shard for r in got}


@pytest.mark.parametrize("n,copies", [(400, 7), (90, 3), (45, 2), (3, 1)])
def test_law_and_groups(spark, n, copies):
    rows = [(i, f"text {i if i % 5 else i % (5 * max(1, n // 25))}") for i in range(n)] + [(n + i, "hot") for i in range(copies)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS shard", "0 AS size", "1 AS slot")
    got = sharding.shard(docs, 40).collect()
    check(rows, got, 40)
    if n == 400:  # every group fits: none is cut
        text, shard = text_of(rows, got)
        groups = defaultdict(set)
        for i, t in text.items():
            groups[t].add(shard[i])
        assert all(len(x) == 1 for x in groups.values()) and not any(r.cut for r in got)


def test_a_group_with_a_third_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET", 50)
    rows = [(i, "hot" if i % 3 == 0 else f"t{i % 350}") for i in range(900)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 10).collect()
    check(rows, got, 10)
    text, shard = text_of(rows, got)
    assert len({s for i, s in shard.items() if text[i] == "hot"}) <= 5  # 300 rows over shards of 90


def test_nulls_repeats_and_empty(spark):
    rows = [(None, None), (None, None), (1, ""), (1, ""), (2, "é" * 300_000), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(rows, sharding.shard(docs, 4).collect(), 4)
    assert sharding.shard(docs.where("false"), 4).count() == 0


def test_the_layout_does_not_matter(spark):
    rows = [(i, f"text {i % 60 if i % 3 else i}") for i in range(300)] + [(7, "text 7")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one, two = (sorted(map(tuple, sharding.shard(docs.repartition(n), 8).collect())) for n in (2, 5))
    assert one == two


def brute_votes(labels, hubs):
    """labels: node to Counter of shards; hubs: hub to set of nodes; node to {shard: neighbours' documents}."""
    near = {n: Counter() for n in labels}
    for members in hubs.values():
        for n in members:
            for other in members - {n}:
                near[n].update(labels[other])
    return near


def test_votes_against_brute_force(spark):
    rng = random.Random(5)
    labels = {n: Counter(rng.randrange(4) for _ in range(rng.randint(1, 5))) for n in range(40)}
    hubs = {h: set(rng.sample(range(40), rng.randint(2, 6))) for h in range(60)}
    many = Counter(n for members in hubs.values() for n in members)
    table = spark.createDataFrame([(n, s, c, sum(x.values()), False) for n, x in labels.items() for s, c in x.items()], "node long, shard int, have long, n long, placed boolean")
    member = spark.createDataFrame([(n, h, many[n]) for h, x in hubs.items() for n in x], "node long, hub long, hubs long")
    near = brute_votes(labels, hubs)
    for r in sharding.votes(table, member).collect():
        assert r.n == sum(labels[r.node].values()) and not r.placed
        assert {v.shard: v.have for v in r["at"] if v.have} == dict(labels[r.node])
        assert {v.shard: v.near for v in r["at"] if v.near} == dict(near[r.node])
    for r in sharding.votes(table, None).collect():
        assert {v.shard: (v.have, v.near) for v in r["at"]} == {s: (c, 0) for s, c in labels[r.node].items()}


def test_memberships_against_brute_force(spark):
    members = spark.createDataFrame([(1, 10), (2, 10), (3, 11), (4, 12), (4, 12), (5, 13), (None, 14), (6, 10)], "id long, node long")
    links = spark.createDataFrame([(1, 4), (4, 1), (3, 9), (3, None), (2, 5), (1, 6)], "a long, b long").where("a <> b")
    got = sharding.memberships(members, links).collect()
    hubs = defaultdict(set)
    for r in got:
        hubs[r.hub].add(r.node)
    assert sorted(map(sorted, hubs.values())) == [[10, 12], [10, 13]]
    assert {r.node: r.hubs for r in got} == {10: 2, 12: 1, 13: 1}


def cut_of(edges, shard):
    return sum(shard[a] != shard[b] for a, b in edges)


def test_linked_communities_come_together(spark):
    """Chains and random links within eight communities: few are cut, far fewer than by hash; and no placed document
    could move to a shard with room where it has more neighbours."""
    rng = random.Random(2)
    edges = [(c * 20 + i, c * 20 + j) for c in range(8) for i in range(20) for j in {(i + 1) % 20, *rng.sample(range(20), 3)} if i != j]
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(600)], "doc_id long, text string")
    links = spark.createDataFrame([*edges, (1, 1), (None, 2), (3, None), (99999, 4)], "one long, two long")
    got = sharding.shard(docs, 8, links=links).collect()
    check([(i, f"text {i}") for i in range(600)], got, 8)
    shard = {r.doc_id: r.shard for r in got}
    by_hash = {i: zlib.crc32(str(i).encode()) % 8 for i in range(600)}
    assert cut_of(edges, shard) < 0.25 * cut_of(edges, by_hash)
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    assert {r.doc_id for r in got if r.cut} == {i for i in near if any(shard[j] != shard[i] for j in near[i])}


def test_links_and_equal_texts_together(spark):
    """Groups of equal texts, two of which a link ties; with room for both they end in one shard."""
    rows = [(i, f"group {i // 5}") for i in range(20)] + [(100 + i, f"free {i}") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.shard(docs, 4, links=spark.createDataFrame([(0, 5), (10, 100)], "a long, b long")).collect()
    check(rows, got, 4)
    shard = {r.doc_id: r.shard for r in got}
    assert all(len({shard[i] for i in range(g * 5, g * 5 + 5)}) == 1 for g in range(4))
    assert not any(r.cut for r in got) and shard[0] == shard[5] and shard[10] == shard[100]


def test_shared_lines_against_brute_force(spark, tmp_path, monkeypatch):
    """The documents of every line are connected, by as many links as a tree has and no crowded document."""
    from quillmesh.llm.common import Scratch

    monkeypatch.setattr(sharding, "BUCKET", 40)
    rng = random.Random(8)
    lines = [f"line {k} " + "x" * rng.choice([1, 4, 5, 40]) for k in range(30)]
    rows = [(i, "\n".join(f" {x}\t\r" for x in ["hot" * 9, *rng.sample(lines, rng.randint(0, 2))][i % 3 == 0 :] + ["", "short"])) for i in range(200)]
    rows += [(None, "hot" * 9), (900, None), (901, ""), (5, lines[3]), (5, lines[3] + "\n" + lines[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS line", "2 AS id", "3 AS n")
    want = defaultdict(set)
    for i, text in rows:
        for x in (text or "").split("\n"):
            if len(x.strip()) >= 12 and i is not None:
                want[x.strip()].add(i)
    want = [x for x in want.values() if len(x) > 1]
    got = [tuple(r) for r in sharding.shared_lines(docs, Scratch(spark, "test"), least=12, fan=4).collect()]
    assert len(got) == len(set(got)) <= sum(len(x) - 1 for x in want) and all(a != b for a, b in got)
    pairs = {frozenset(x) for x in got}
    assert all(any(p <= x for x in want) for p in pairs)
    for ids in want:  # connected by links within the line
        reached, queue = set(), [min(ids)]
        while queue:
            at = queue.pop()
            reached.add(at)
            queue += [j for j in ids - reached if frozenset((at, j)) in pairs]
        assert reached == ids
    below = Counter(b for _, b in got)
    assert max(below.values()) <= 4 * max(Counter(i for x in want for i in x).values())
    again = sharding.shared_lines(docs.repartition(7), Scratch(spark, "test"), least=12, fan=4).collect()
    assert sorted(got) == sorted(map(tuple, again))
    assert sharding.shared_lines(docs.where("false"), Scratch(spark, "test")).count() == 0


def test_link_by_another_column(spark):
    docs = spark.createDataFrame([(i, f"t{i}", None if i % 2 else i // 8) for i in range(120)], "doc_id long, text string, work long")
    got = sharding.shard(docs, 3, link=F.col("work")).collect()
    shard = {r.doc_id: r.shard for r in got}
    assert all(len({shard[i] for i in range(w * 8, w * 8 + 8, 2)}) == 1 for w in range(15))


def test_query(spark):
    from quillmesh.llm import queries

    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = queries.op10_sharding(spark, "/root/testdata/sf0.001").collect()
    check(rows, got, 40)
    text, shard = text_of(rows, got)
    groups = defaultdict(list)
    for i, t in text.items():
        groups[t].append(shard[i])
    cut = {t for t, x in groups.items() if len(set(x)) > 1}
    assert {text[r.doc_id] for r in got if r.cut} == cut and all(len(groups[t]) > len(rows) // 40 for t in cut)
    assert {r.grown_shard for r in got} == {None}
