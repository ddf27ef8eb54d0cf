"""Sharding by balanced label propagation: linked documents move together under capacity quotas.

Documents with the same link key (by default the same text) are neighbours, and so are the two ends of every row
of a link table. The documents of a key form a node, or several of a shard's size where they are more, which no shard
could hold together; any other document that the link table names is a node of its own. Links between nodes are
joined as (node, link), and never as pairs of a key.

Every document begins with a label by hash: that of its own row or, where the link table names it, of the smallest id
among it and those that it is linked to, so that few rounds are needed. In each round the labels in force are
counted anew, and every node has the votes of its neighbours and of its own documents. A node that has no place yet
asks for the shard with most votes that has room for all of it, or else for any that has; a placed node asks to move
where its neighbours have more votes than where it is. A shard accepts the largest first up to its quota. Placing ends when no node fits
anywhere; moves end when none is gained by, or after ``moves`` rounds. What no shard can take whole is cut;
documents without neighbours fill what is left of the quotas.

Everything is DataFrame operations. Ranks are taken in two levels (counts per bucket, then rows within a
bucket), so neither a shard, nor a key that holds a third of all rows, meets whole in one task. To the driver
come the number of rows and figures per shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, offsets, tidy

LAW = "rows"
#: Rows per task of a two-level rank, about.
BUCKET = 50_000
#: Rounds of moves after all that fits is placed.
MOVES = 8
#: Characters of a line that links its documents, at least, and documents below each in the tree that links them.
LINE, FAN = 64, 64


def ranked(rows: DataFrame, key: str, n: int, out: str = "rank") -> DataFrame:
    """A gapless rank from 0 within each ``key`` by (bucket of the row hash, row). ``n``: rows in all. Rows that
    are equal in all columns may change places."""
    buckets = max(1, -(-n // BUCKET))
    rows = rows.withColumn("_b", F.pmod(F.xxhash64("rid"), F.lit(buckets)).cast("int"))
    before = offsets(rows.groupBy(key, "_b").agg(F.count("*").alias("_n")), key, "_b", "_n", "_before")
    w = Window.partitionBy(key, "_b").orderBy("rid", "id", "crc", "size")
    return rows.join(before, [key, "_b"]).withColumn(out, F.col("_before") + F.row_number().over(w) - 1).drop("_b", "_before")


def span(value: Column, cuts: list[int]) -> Column:
    """The number of ``cuts`` (ascending) that are at or below the value."""
    return F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in cuts]), lambda c: c <= value))


def shared_lines(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", least: int = LINE, fan: int = FAN) -> DataFrame:
    """A link table ``a``, ``b`` for :func:`shard`: documents that have a line of ``least`` characters or more in common.

    Lines end at a newline and count without white space at their ends, wherever they stand and however often. The
    documents of a line are linked by a tree in which each has at most ``fan`` below it, so that all of them are
    connected and a line that any share of the documents has makes neither pairs nor a hub. Null ids and texts have no
    links; rows with equal ids are one document. Other columns are not looked at; an empty table gives an empty one."""
    buckets = max(1, -(-docs.count() // BUCKET))
    each = docs.select(F.col(id_col).alias("id"), F.explode(F.split(F.col(text_col).cast("string"), "\n")).alias("line"))
    each = each.select("id", F.btrim("line", F.lit(" \t\r\f\v")).alias("line")).where((F.length("line") >= least) & F.col("id").isNotNull())
    rows = scratch.table(each.select(F.xxhash64("line").alias("line"), "id", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int").alias("sub")).distinct())
    w = Window.partitionBy("line")
    counted = rows.groupBy("line", "sub").agg(F.count("*").alias("n")).withColumn("of", F.sum("n").over(w)).where("of > 1")
    place = F.row_number().over(Window.partitionBy("line", "sub").orderBy("id")) - 1
    tree = rows.join(offsets(counted, "line", "sub", "n", "before"), ["line", "sub"])
    tree = scratch.table(tree.select("line", "id", (F.col("before") + place).alias("rank")))
    above = tree.select("line", F.col("rank").alias("up"), F.col("id").alias("b"))
    below = tree.where("rank > 0").select("line", F.floor((F.col("rank") - 1) / fan).alias("up"), F.col("id").alias("a"))
    return below.join(above, ["line", "up"]).select("a", "b").distinct()


def memberships(members: DataFrame, links: DataFrame) -> DataFrame:
    """``node``, ``hub`` and ``hubs`` (the node's number of them) for the links between two nodes. ``members``: id
    and node of every linked document; ``links``: ``a``, ``b``."""
    hub = F.xxhash64(F.least("a", "b"), F.greatest("a", "b"))
    ends = links.select(hub.alias("hub"), F.explode(F.array("a", "b")).alias("id")).distinct()
    rows = ends.join(members.select("id", "node").distinct(), "id").select("node", "hub").distinct()
    several = rows.groupBy("hub").agg(F.count("*").alias("_n")).where("_n > 1").select("hub")
    rows = rows.join(several, "hub", "left_semi")
    return rows.join(rows.groupBy("node").agg(F.count("*").alias("hubs")), "node")


def votes(labels: DataFrame, member: DataFrame | None) -> DataFrame:
    """Per node ``n``, ``placed`` and ``at``: an array of (shard, ``have``: its own documents there, ``near``: the
    neighbours' documents there, one for each hub that is shared), of at most as many entries as there are shards.

    ``labels``: node, shard, have, n, placed; ``member``: as of :func:`memberships`, None for no neighbours."""
    own = labels.select("node", "shard", "have", "n", "placed")
    if member is None:
        return own.groupBy("node").agg(F.max("n").alias("n"), F.max("placed").alias("placed"), F.collect_list(F.struct("shard", "have", F.lit(0).cast("long").alias("near"))).alias("at"))
    counts = member.join(labels.select("node", "shard", "have"), "node").groupBy("hub", "shard").agg(F.sum("have").alias("c"))
    none = F.lit(None)
    near = member.join(counts, "hub").select("node", "shard", F.lit(0).cast("long").alias("have"), none.cast("long").alias("n"), none.cast("boolean").alias("placed"), "c", "hubs")
    both = own.withColumns({"c": F.lit(0).cast("long"), "hubs": F.lit(0).cast("long")}).unionByName(near)
    each = both.groupBy("node", "shard").agg(F.sum("have").alias("have"), F.max("n").alias("n"), F.max("placed").alias("placed"), (F.sum("c") - F.sum("have") * F.max("hubs")).alias("near"))
    return each.groupBy("node").agg(F.max("n").alias("n"), F.max("placed").alias("placed"), F.collect_list(F.struct("shard", "have", "near")).alias("at"))


def proposals(found: DataFrame, room: list[int], turn: int, moves: bool) -> DataFrame:
    """One row per node that asks for a shard: node, n, shard and whether it was ``placed``. ``found``: as of
    :func:`votes`. A placed node asks every other turn only, so that neighbours do not change places for ever."""
    rooms = F.array(*[F.lit(r).cast("long") for r in room])

    def fits(shard: Column) -> Column:
        return F.col("n") <= F.element_at(rooms, shard + 1)

    asked = F.array_max(F.transform("at", lambda v: F.when(fits(v["shard"]), F.struct(v["near"].alias("near"), v["have"].alias("have"), F.xxhash64("node", v["shard"]).alias("tie"), v["shard"].alias("shard")))))
    tries = F.transform(F.sequence(F.lit(0), F.lit(len(room) - 1)), lambda s: F.when(fits(s), F.struct(F.xxhash64("node", s).alias("tie"), s.alias("shard"))))
    first = found.where("NOT placed").select("node", "n", F.coalesce(asked["shard"], F.array_max(tries)["shard"]).alias("shard"), "placed").where("shard IS NOT NULL")
    if not moves:
        return first
    here = F.array_max(F.transform(F.filter("at", lambda v: v["have"] > 0), lambda v: F.struct(v["near"].alias("near"), v["shard"].alias("shard"))))
    again = found.where(F.col("placed") & (F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(2)) == 0)).withColumns({"_to": asked, "_at": here})
    return first.unionByName(again.where("_to.shard <> _at.shard AND _to.near > _at.near").select("node", "n", F.col("_to.shard").alias("shard"), "placed"))


def accepted(asked: DataFrame, room: list[int], nodes: int) -> DataFrame:
    """The proposals that the shards have room for, larger nodes first."""
    buckets = max(1, -(-nodes // BUCKET))
    asked = asked.withColumn("sub", -F.floor(F.log2("n")).cast("long") * buckets + F.pmod(F.xxhash64("node"), F.lit(buckets)))
    before = offsets(asked.groupBy("shard", "sub").agg(F.sum("n").alias("s")), "shard", "sub", "s", "before")
    w = Window.partitionBy("shard", "sub").orderBy(F.desc("n"), "node").rowsBetween(Window.unboundedPreceding, 0)
    placed = asked.join(before, ["shard", "sub"]).withColumn("upto", F.col("before") + F.sum("n").over(w))
    return placed.where(F.col("upto") <= F.element_at(F.array(*[F.lit(r).cast("long") for r in room]), F.col("shard") + 1)).select("node", "n", "shard", "placed")


def propagate(labels: DataFrame, member: DataFrame | None, quota: list[int], scratch: Scratch, moves: int = MOVES) -> tuple[DataFrame, list[int]]:
    """The labels when no more is gained, and the room that is left. ``labels``: node, shard, have, n, placed; a
    placed node has one row, and stands in one shard."""
    labels, path = scratch.keep(labels)
    nodes = labels.select("node").distinct().count()
    room, turn, moved, idle = list(quota), 0, 0, 0
    # a placed node asks every other turn, so that two turns without a taker are the end
    while nodes and moved < moves and idle < (1 if member is None else 2):
        asked, asked_at = scratch.keep(proposals(votes(labels, member), room, turn, member is not None))
        took, took_at = scratch.keep(accepted(asked, room, nodes))
        scratch.drop(asked_at)
        new = took.agg(F.count("*"), F.count_if(~F.col("placed"))).first()
        turn += 1
        if not new[0]:
            idle += 1
            scratch.drop(took_at)
            continue
        idle = 0
        moved += new[1] == 0
        rest = labels.join(took.select("node"), "node", "left_anti").unionByName(took.select("node", "shard", F.col("n").alias("have"), "n", F.lit(True).alias("placed")))
        next_labels, next_path = scratch.keep(rest)
        scratch.drop(path, took_at)
        labels, path = next_labels, next_path
        tidy(scratch.spark)
        filled = {(r.placed, r.shard): r.s for r in labels.groupBy("placed", "shard").agg(F.sum("have").alias("s")).collect()}
        room = [q - filled.get((True, s), 0) for s, q in enumerate(quota)]
        if member is None and all(placed for placed, _ in filled):
            break  # all are placed, and without other nodes about nothing is gained by a move
    return labels, room


def shard(docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text", link: Column | None = None, links: DataFrame | None = None, moves: int = MOVES) -> DataFrame:
    """``id_col``, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot`` and ``cut`` for every row.

    ``size`` is the text's UTF-8 bytes (null: none) plus 16, ``text_crc32`` that of its UTF-8 bytes (null: of
    none). Rows with the same ``link`` are neighbours; by default equal texts are, null texts being equal to
    each other; a null link has no such neighbours. ``links``: a table whose first two columns are ids of rows that are
    neighbours; nulls, loops, repeats and ids of no row in it do no harm. Law ``rows``: the shards' counts differ by
    one at most, for every input. ``slot`` counts from 0 without gaps within a shard. ``cut`` marks the
    documents of nodes that have neighbours in another shard.
    The result depends on the rows alone, not on their layout. Null ids, repeated rows and ids, and other columns do
    no harm: every row gets its own slot. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "sharding")
    text = F.col(text_col).cast("string")
    key = F.coalesce(F.concat(F.lit("t"), text), F.lit("n")) if link is None else link.cast("string")
    slim = docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("crc"),
        F.unhex(F.sha2(key, 256)).alias("key"),
    )
    slim = scratch.table(slim.select(F.xxhash64("id", "crc", "size").alias("rid"), "*"))
    total = slim.count()
    quota = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    cap = max(1, total // n_shards)
    groups = scratch.table(slim.where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("of")).where("of > 1"))
    largest = groups.agg(F.coalesce(F.max("of"), F.lit(0))).first()[0]
    keyed, bare = (slim, None) if link is None else (slim.where("key IS NOT NULL"), slim.where("key IS NULL"))
    members = keyed.join(groups, "key", "left")
    if bare is not None:  # rows without a key do not meet under the null key
        members = members.unionByName(bare.withColumn("of", F.lit(None).cast("long")))
    members = members.withColumn("piece", F.lit(0).cast("long"))
    if largest > cap:  # such groups are cut into pieces of a shard's size
        big = ranked(members.where(F.col("of") > cap), "key", total).withColumn("piece", F.floor(F.col("rank") / cap)).drop("rank")
        members = members.where(F.col("of").isNull() | (F.col("of") <= cap)).unionByName(big)
    node = F.when(F.col("of").isNotNull(), F.xxhash64("key", "piece"))
    first = F.col("rid")
    if links is not None:
        links = links.toDF(*("a", "b", *links.columns[2:])).select("a", "b").where("a <> b")
        both = F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("other")), F.struct(F.col("b").alias("id"), F.col("a").alias("other")))
        members = members.join(links.select(F.inline(both)).groupBy("id").agg(F.min("other").alias("other")), "id", "left")
        node = F.coalesce(node, F.when(F.col("other").isNotNull(), F.xxhash64(F.lit("id"), "id", "key")))
        first = F.when(F.col("other").isNotNull(), F.xxhash64(F.least("id", "other"))).otherwise(first)
    large = F.coalesce(F.col("of") > cap, F.lit(False))
    members = scratch.table(members.select("rid", "id", "size", "crc", node.alias("node"), large.alias("large"), F.pmod(F.xxhash64(first), F.lit(n_shards)).cast("int").alias("first")))
    tied = members.where("node IS NOT NULL")

    # every document's first label; then propagation
    start = tied.groupBy("node", F.col("first").alias("shard")).agg(F.count("*").alias("have"))
    sums = tied.groupBy("node").agg(F.count("*").alias("n"))
    member = None if links is None else scratch.table(memberships(tied, links))
    labels, room = propagate(start.join(sums, "node").withColumn("placed", F.lit(False)), member, quota, scratch, moves)

    if member is None:
        settled = labels.where("placed").select("node", "shard", F.lit(False).alias("cut"))
    else:  # a node without a place stands in no shard
        last = labels.groupBy("node", F.when(F.col("placed"), F.col("shard")).otherwise(-1).alias("shard")).agg(F.sum("have").alias("have"), F.max("n").alias("n"), F.max("placed").alias("placed"))
        own = F.array_max(F.transform(F.filter("at", lambda v: v["have"] > 0), lambda v: v["shard"]))
        away = votes(last, member).where("placed").withColumn("shard", own)
        settled = away.select("node", "shard", F.exists("at", lambda v: (v["shard"] != F.col("shard")) & (v["near"] > 0)).alias("cut"))
    columns = ["rid", "id", "size", "crc", "shard", "cut"]
    placed = tied.join(settled, "node", "left").withColumn("cut", F.coalesce("cut", F.lit(True)) | F.col("large")).select(columns)
    free = members.where("node IS NULL").withColumns({"shard": F.lit(None).cast("int"), "cut": F.lit(False)}).select(columns)
    labelled = scratch.table(placed.unionByName(free))
    scratch.release(labelled)

    # the others fill what is left of the quotas, in the order of a rank over all of them
    cuts = [sum(room[: s + 1]) for s in range(n_shards - 1)]
    rest = ranked(labelled.where("shard IS NULL").drop("shard").withColumn("all", F.lit(0)), "all", total)
    rest = rest.withColumn("shard", span(F.col("rank"), cuts)).drop("rank", "all")
    placed = ranked(labelled.where("shard IS NOT NULL").unionByName(rest), "shard", total, "slot")
    return placed.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit(LAW).alias("law"), "shard", "slot", "cut")
