import numpy as np
import xxhash
from pyspark.sql import functions as F

from quillmesh.llm import simhash

SCHEMA = "doc_id long, text string, fp string, component_id string"


def brute_fp(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({i: 32 for i in range(9, 14)}).split(" ") if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, distance=4):
    """(id, fp) pairs to {index: smallest id reachable}."""
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= distance:
                label[root(i)] = root(j)
    ids = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            ids[root(i)] = min(doc_id, ids.get(root(i), doc_id))
    return [ids.get(root(i)) for i in range(len(rows))]


def test_fingerprint_equals_its_definition():
    for text in (None, "", " \t\n", "One", "a b c", "A b\x0bc  d", "é É ÀB c d e", "a b c d " * 500, "x" * 50_000 + " y z w v"):
        assert simhash.fingerprint(text, 4) == brute_fp(text)


def test_embedding_bounds_the_distance():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 1 << 63, (2, 2000), dtype=np.uint64)
    b[::2] = a[::2] ^ (np.uint64(1) << rng.integers(0, 63, 1000, dtype=np.uint64))
    low, exact = np.bitwise_count(simhash.unary(a) ^ simhash.unary(b)), np.bitwise_count(a ^ b)
    assert (low <= exact).all()
    pairs = [np.abs(np.bitwise_count(a >> np.uint64(s) & np.uint64(3)).astype(int) - np.bitwise_count(b >> np.uint64(s) & np.uint64(3))) for s in range(0, 64, 2)]
    assert (low == sum(pairs)).all()


def near_prints(n, seed):
    """Fingerprints in chains and clusters about a few centres, and some strangers."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        fp = int(rng.integers(0, 1 << 63)) if not out or rng.random() < 0.3 else out[int(rng.integers(len(out)))]
        for _ in range(int(rng.integers(0, 7))):
            fp ^= 1 << int(rng.integers(64))
        out.append(fp)
    return out


def test_links_lose_no_component(spark):
    fps = sorted(set(near_prints(500, 3)))
    want = brute_components([(f, f) for f in fps])
    table = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long")
    from quillmesh.llm.common import Scratch
    from quillmesh.llm.components import components

    for groups, block in ((6, 20_000), (6, 3), (7, 20_000)):
        got = {r.node: r.label for r in components(simhash.links(table, 4, groups, block), Scratch(spark, "t")).collect()}
        label = [got.get(simhash.signed(f), simhash.signed(f)) for f in fps]
        assert len(set(zip(label, want))) == len(set(label)) == len(set(want)), (groups, block)


def test_whole_operator_against_brute_force(spark):
    words = "alpha beta gamma delta eps zeta eta theta iota kappa".split()
    base = " ".join(words[(i * i + 3 * i) % 10] + str(i % 17) for i in range(300))
    rows = [(5, base), (4, base), (9, base.replace("beta3", "BETA3", 1)), (7, base + " tail"), (None, base), (None, "only null ids here at all"), (1, None), (2, ""), (3, "  \n"), (8, "One Two"), (8, "One Two"), (11, "one  two")]
    rows += [(100 + i, " ".join(words[(i * k + k * k) % 10] for k in range(20))) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("component_id", F.lit(1))
    got = sorted((tuple(r) for r in simhash.near_duplicates(docs, shingle=4, distance=4, groups=6).collect()), key=str)
    prints = [(i, brute_fp(t)) for i, t in rows]
    want = sorted(((i, simhash.signed(f), c) for (i, f), c in zip(prints, brute_components(prints))), key=str)
    assert got == want


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_distinct_keeps_one_of_each_group(spark):
    base = " ".join(f"w{i}" for i in range(200))
    rows = [(3, base, "a"), (2, base, "b"), (2, base, "c"), (5, "other text of its own kind here", "d"), (None, base, "e"), (7, None, "f"), (8, "", "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _rows string")
    kept = simhash.distinct(docs)
    assert kept.columns == docs.columns
    got = [(r.doc_id, r._rows) for r in kept.collect()]
    assert sorted(x for x in got if x[0] != 2 and x[0]) == [(5, "d"), (7, "f")] and (None, "e") in got and len([x for x in got if x[0] == 2]) == 1


def test_defaults_lose_no_component(spark):
    """The wider distance over nine axes, with cells of every size."""
    from quillmesh.llm.common import Scratch
    from quillmesh.llm.components import components

    fps = sorted(set(near_prints(700, 8)))
    want = brute_components([(f, f) for f in fps], simhash.DISTANCE)
    table = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long")
    got = {r.node: r.label for r in components(simhash.links(table), Scratch(spark, "t")).collect()}
    label = [got.get(simhash.signed(f), simhash.signed(f)) for f in fps]
    assert len(set(zip(label, want))) == len(set(label)) == len(set(want))


def test_cells_of_every_size():
    """Cells compared together and cells searched one by one give the same components."""
    keys = np.sort(np.concatenate([np.full(n, n) for n in (1, 2, 3, 31, 32, 33, 90)]))
    fps = np.array(near_prints(len(keys), 6), np.uint64)

    def parts(small):
        label = {}
        links = list(zip(*(x.tolist() for x in simhash.cell_links(keys, fps, 6, small))))
        for key in set(keys.tolist()):
            own = {f: f for f in fps[keys == key].tolist()}
            for _ in own:
                for a, b in links:
                    if a in own and b in own:
                        own[a] = own[b] = min(own[a], own[b])
            label[key] = own
        return label

    assert parts(1) == parts(32) == parts(1000)


def test_distinct_by_rows_and_clashing_names(spark):
    """Several texts under one id: each goes or stays by its own group."""
    base, other = " ".join(f"w{i}" for i in range(200)), " ".join(f"v{i}" for i in range(200))
    rows = [(1, base, "a", "s"), (5, other, "b", "t"), (5, base, "c", "u"), (7, base, "d", "v"), (5, other, "b", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _gone string, _SIGN string")
    kept = simhash.distinct(docs)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == [rows[0], rows[1]]
    assert simhash.distinct(docs.where("false")).count() == 0


def test_query(spark):
    from quillmesh.llm import queries

    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    prints = [(i, brute_fp(t)) for i, t in rows]
    want = sorted((i, f"{f:016x}", c) for (i, f), c in zip(prints, brute_components(prints)))
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in queries.op6_simhash(spark, "/root/testdata/sf0.001").collect()) == want
