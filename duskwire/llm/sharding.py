"""Shards by balanced label propagation.

Linked documents want to be where most of their neighbours are. Every label starts from the smallest document
next to it, and these groups are dealt to shards whole as far as room allows. Then, in rounds, joins tell every
linked document its neighbours' favourite shard with room, and it moves there unless a neighbour moves, until
no move is left. Documents without links fill what is left, so that the numbers of documents differ by one at most.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import cut_lineage
from ..operators.ordering import number_rows, running_sums

#: Groups over this part of a shard are placed one by one, which are fewer than so many times the shards.
_LARGE = 8


def quotas(total: int, shards: int) -> list[int]:
    """Rows of each shard, one apart at most."""
    return [total // shards + (j < total % shards) for j in range(shards)]


def _home(n: int, room: list[int]) -> list[tuple[int, int]]:
    """(rows, shard) for a group of ``n`` rows, taken from ``room``: the tightest shard that holds it, else the
    emptiest shards until one holds the rest."""
    parts = []
    while n:
        fits = [j for j, x in enumerate(room) if x >= n]
        j = min(fits, key=lambda j: room[j]) if fits else max(range(len(room)), key=lambda j: room[j])
        some = min(n, room[j])
        room[j] -= some
        n -= some
        parts.append((some, j))
    return parts


def _numbers(xs: list[int], kind: str = "long") -> Column:
    return F.array(*[F.lit(x).cast(kind) for x in xs])


def _looked_up(key: str, values: dict[int, Column]) -> Column:
    return F.try_element_at(F.create_map(*[x for k, v in values.items() for x in (F.lit(k).cast("long"), v)]), F.col(key))


def started(linked: DataFrame, quota: list[int]) -> DataFrame:
    """(id, shard) per row of ``linked`` (id, group), no more than ``quota`` a shard.

    A group is whole where a shard has room for it; a larger one takes as few shards as it can.
    """
    room = list(quota)
    sizes = cut_lineage(linked.groupBy("group").agg(F.count(F.lit(1)).alias("n")), "groups")
    large = F.col("n") * (_LARGE * len(quota)) > sum(quota)
    # fewer than _LARGE rows per shard
    homes = {r["group"]: _home(r["n"], room) for r in sizes.filter(large).orderBy(F.desc("n"), "group").collect()}
    # the other groups lie in a row, which the shards' room cuts
    ends = [sum(room[: j + 1]) for j in range(len(room))]
    begin = F.col("end") - F.col("n")
    line = running_sums(sizes.filter(~large), [], ["group"], {"end": F.col("n")}).withColumn(
        "shard", F.size(F.filter(_numbers(ends), lambda x: x <= begin))
    )
    line = cut_lineage(line.withColumn("whole", F.col("end") <= F.element_at(_numbers(ends), F.col("shard") + 1)), "line")
    # one row per shard, and at most one group per end of a shard
    for r in line.filter("whole").groupBy("shard").agg(F.sum("n").alias("n")).collect():
        room[r["shard"]] -= r["n"]
    homes |= {r["group"]: _home(r["n"], room) for r in line.filter("not whole").orderBy(F.desc("n"), "group").collect()}
    out = linked.join(line.filter("whole").select("group", "shard"), "group").select("id", "shard")
    one = {g: F.lit(h[0][1]) for g, h in homes.items() if len(h) == 1}
    if one:
        out = out.unionByName(linked.filter(F.col("group").isin(list(one))).select("id", _looked_up("group", one).alias("shard")))
    several = {g: h for g, h in homes.items() if len(h) > 1}
    if several:
        ranked = number_rows(linked.filter(F.col("group").isin(list(several))), ["id"], "rank", ["group"])
        ends_of = _looked_up("group", {g: _numbers([sum(n for n, _ in h[: k + 1]) for k in range(len(h))]) for g, h in several.items()})
        shards_of = _looked_up("group", {g: _numbers([j for _, j in h], "int") for g, h in several.items()})
        out = out.unionByName(ranked.select("id", F.element_at(shards_of, F.size(F.filter(ends_of, lambda x: x < F.col("rank"))) + 1).alias("shard")))
    return out


def propagated(nodes: DataFrame, links: DataFrame, shards: int) -> DataFrame:
    """(id, shard, linked) after label propagation. ``nodes``: distinct id; ``links``: src, dst, any direction.

    The linked documents of no shard exceed its quota. In a round no two neighbours move, so every move takes away
    the links it counted on, and the rounds end: with no document left that has more neighbours in a shard with room.
    """
    both = cut_lineage(links.select("src", "dst").union(links.select(F.col("dst"), F.col("src"))).filter("src <> dst").distinct(), "links")
    quota = quotas(nodes.count(), shards)  # one number
    linked = both.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("group")).withColumn("group", F.least("id", "group"))
    state = cut_lineage(started(cut_lineage(linked, "linked"), quota), "labels")
    k = 0
    while True:
        # one row per shard
        load = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
        room = [quota[j] - load.get(j, 0) for j in range(shards)]
        near = both.join(state.withColumnRenamed("id", "dst"), "dst").groupBy("src", "shard").agg(F.count(F.lit(1)).alias("n"))
        near = near.join(state.select(F.col("id").alias("src"), F.col("shard").alias("own")), "src")
        has_room = F.col("shard").isin([j for j in range(shards) if room[j]])
        # most neighbours first; among equals the round decides
        best = near.groupBy(F.col("src").alias("id")).agg(
            F.max(F.when(has_room, F.struct("n", F.xxhash64("shard", F.lit(k)).alias("tie"), "shard"))).alias("best"),
            F.coalesce(F.max(F.when(F.col("shard") == F.col("own"), F.col("n"))), F.lit(0)).alias("mine"),
        ).filter(F.col("best.n") > F.col("mine"))
        wishes = cut_lineage(best.select("id", F.col("best.shard").alias("wish"), F.xxhash64("id", F.lit(k)).alias("turn")), "wishes")
        if wishes.isEmpty():
            break
        rivals = both.join(wishes.select(F.col("id").alias("dst"), "turn"), "dst").groupBy(F.col("src").alias("id")).agg(
            F.max(F.struct("turn", "dst")).alias("rival"))
        first = wishes.join(rivals, "id", "left").filter(F.col("rival").isNull() | (F.struct("turn", F.col("id").alias("dst")) > F.col("rival")))
        asked = number_rows(first.select("id", "wish", "turn"), ["turn", "id"], "rank", ["wish"])
        granted = asked.filter(F.col("rank") <= F.element_at(_numbers(room), F.col("wish") + 1)).select("id", "wish")
        state = cut_lineage(state.join(granted, "id", "left").select("id", F.coalesce("wish", "shard").alias("shard")), "labels")
        k += 1
    return nodes.select("id").join(state.withColumn("linked", F.lit(True)), "id", "left").select(
        "id", F.coalesce("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")).alias("shard"),
        F.coalesce("linked", F.lit(False)).alias("linked"),
    )


def evened(placed: DataFrame, shards: int) -> DataFrame:
    """(id, shard, slot): ``placed`` (id, shard, linked) with counts at most one apart.

    Rows beyond a shard's quota, those without links first, go to the shards below theirs.
    """
    ranked = cut_lineage(
        number_rows(placed.withColumn("late", ~F.col("linked")).select("id", "shard", "late"), ["late", "id"], "rank", ["shard"]), "ranked"
    )
    # one number per shard
    load = {r["shard"]: r["n"] for r in ranked.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(load.values())
    quota = quotas(total, shards)
    kept = [min(quota[j], load.get(j, 0)) for j in range(shards)]
    before = [sum(quota[k] - kept[k] for k in range(j)) for j in range(shards)]
    at = lambda xs, j: F.element_at(_numbers(xs), (j + 1).cast("int"))
    stay = ranked.filter(F.col("rank") <= at(quota, F.col("shard"))).select("id", "shard", (F.col("rank") - 1).alias("slot"))
    pool = number_rows(ranked.filter(F.col("rank") > at(quota, F.col("shard"))).select("id"), ["id"], "n").withColumn("n", F.col("n") - 1)
    # the last shard whose room begins at or before the row's number and which has room
    open_ = [j for j in range(shards) if quota[j] > kept[j]]
    if not open_:
        return stay
    fits = F.size(F.filter(_numbers([before[j] for j in open_]), lambda x: x <= F.col("n")))
    moved = pool.withColumn("shard", F.element_at(F.array(*[F.lit(j) for j in open_]), fits)).select(
        "id", "shard", (F.col("n") - at(before, F.col("shard")) + at(kept, F.col("shard"))).alias("slot"))
    return stay.unionByName(moved)


def sharded(docs: DataFrame, shards: int = 40) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) per row of ``docs`` (doc_id, text).

    Rows of equal text are linked in a star around one of them. Null text counts as empty, for the size
    as for the checksum; rows of null text are linked with nothing. Null ids and repeated rows each give a row.
    The law is ``rows``: counts at most one apart. Other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = cut_lineage(
        docs.select(
            "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
            F.when(F.col("text").isNotNull(), F.md5(F.col("text").cast("binary"))).alias("same"),
        ).withColumn("id", F.monotonically_increasing_id()), "shard-rows",
    )
    groups = rows.filter("same is not null").groupBy("same").agg(F.min("id").alias("dst"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    links = rows.join(groups, "same").filter("id <> dst").select(F.col("id").alias("src"), "dst")
    placed = propagated(rows.select("id"), links, shards)
    return rows.join(evened(placed, shards), "id").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
