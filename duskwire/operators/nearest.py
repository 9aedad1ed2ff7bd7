"""The k most similar vectors of every vector: an exact nearest-neighbour join over pivot cells.

Unit vectors x, y have |x - y|^2 = 2 - 2 cos, so the nearest are the most similar. Every vector belongs to the cell
of its nearest pivot, and a cell knows its radius. First each vector is compared with its own cell, which bounds how
far its k-th neighbour can be. Then it visits just those other cells that may hold something nearer: whose sphere
around the pivot, and whose side of the plane between both pivots, come within that reach.

Equal vectors are one class, compared once, so copies cost nothing. Cells are cut into parts of a bounded size, and a
tile compares two parts in both directions. A part is sent to each of its tiles, so cells are few and large: what is
shuffled grows with their number, while a tile works through slices of bounded memory.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import norm
from ..lineage import cut_lineage

#: Pivots are shared with all tasks; so many at most.
MOST_PIVOTS = 1024
#: Cells of tables that give them LEAST_ROWS; larger tables get larger cells, up to MOST_ROWS.
CELLS = 8
LEAST_ROWS = 1024
MOST_ROWS = 65_536
#: Rows that look for cells to visit at once, and similarities that a tile works out at once.
VISIT_ROWS = 256
SIMILARITIES = 8_000_000
#: Similarities that agree to so many digits are ties.
DIGITS = 9
FOUND = "query long, class long, similarity double"


def _stack(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def best(query: np.ndarray, asked: np.ndarray, bar: np.ndarray, class_: np.ndarray, given: np.ndarray, k: int) -> list[pa.Table]:
    """The k most similar of ``given`` for each of ``asked``, and what ties with the last; never itself.

    ``bar``: similarities that are of interest only from there on; NaN where nothing is known.
    """
    out = []
    rows = max(1, SIMILARITIES // max(1, len(given)))
    for at in range(0, len(asked), rows):
        here = slice(at, at + rows)
        sims = asked[here] @ given.T
        sims[query[here, None] == class_[None, :]] = -np.inf
        last = bar[here]
        if np.isnan(last).any():
            last = np.partition(sims, -k, axis=1)[:, -k] if sims.shape[1] > k else np.full(len(sims), -2.0)
        i, j = np.nonzero(sims >= np.maximum(last - 10.0**-DIGITS, -2.0)[:, None])
        near = np.round(sims[i, j], DIGITS)
        kept = near >= np.round(last, DIGITS)[i]
        out.append(pa.table({"query": query[here][i[kept]], "class": class_[j[kept]], "similarity": near[kept]}))
    return out


def _compared(sent: DataFrame, k: int, width: int) -> DataFrame:
    """Found neighbours within tiles (lo, hi) of rows (id, v, bar, first, asks); ``first``: of the part lo."""

    def compare(table: pa.Table) -> pa.Table:
        first = table.column("first").to_numpy(zero_copy_only=False)
        sides = []
        for mask in (first, ~first):
            side = table.filter(pa.array(mask))
            sides.append((
                side.column("id").to_numpy(), _stack(side.column("v"), width), side.column("bar").to_numpy().astype(np.float64),
                side.column("asks").to_numpy(zero_copy_only=False).astype(bool),
            ))
        out = [pa.table({"query": pa.array([], pa.int64()), "class": pa.array([], pa.int64()), "similarity": pa.array([], pa.float64())})]
        one, other = sides
        for (ids, v, bar, asks), (with_ids, with_v, _, _) in ((one, other), (other, one)) if len(other[0]) else ((one, one),):
            out += best(ids[asks], v[asks], bar[asks], with_ids, with_v, k)
        return pa.concat_tables(out)

    return sent.groupBy("lo", "hi").applyInArrow(compare, FOUND)


def _kept(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("similarity"), "class")
    return found.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k).drop("_n")


def nearest(vectors: DataFrame, k: int = 5, cell_rows: int | None = None) -> DataFrame:
    """(id, rank, neighbour, similarity): for every vector the ``k`` others of the highest cosine, ties to the smaller id.

    ``vectors``: id long (distinct), v array<double>, all of one width. Vectors that are null, hold a null or have no
    length take no part. Fewer than k others give fewer rows.
    """
    spark = vectors.sparkSession
    usable = vectors.filter("id is not null and v is not null and forall(v, x -> x is not null)").select("id", "v", norm(F.col("v")).alias("_len"))
    units = usable.filter("_len > 0").select("id", F.transform("v", lambda x: x / F.col("_len")).alias("v"))
    units = cut_lineage(units, "nearest-units")
    classes = cut_lineage(units.groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")), "nearest-classes")
    total = classes.count()  # one number
    if not total:
        return spark.createDataFrame([], "id long, rank int, neighbour long, similarity double")
    cell_rows = cell_rows or min(max(-(-total // CELLS), LEAST_ROWS), MOST_ROWS)
    n_pivots = min(MOST_PIVOTS, -(-total // cell_rows))
    chosen = classes.orderBy(F.xxhash64("id", F.lit("pivot")), "id").limit(n_pivots).select("v").toArrow()
    width = len(chosen.column("v")[0])
    pivots = _stack(chosen.column("v"), width)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            far = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (_stack(b.column(1), width) @ pivots.T)))
            cell = far.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(cell, pa.int32()), pa.array(far[np.arange(len(cell)), cell])], ["id", "v", "cell", "far"]
            )

    dealt = cut_lineage(classes.select("id", "v").mapInArrow(deal, "id long, v array<double>, cell int, far double"), "nearest-cells")
    # a row for each pivot
    facts = {r["cell"]: r for r in dealt.groupBy("cell").agg(F.max("far").alias("radius"), F.count(F.lit(1)).alias("n")).collect()}
    radius = np.array([facts[c]["radius"] if c in facts else -1.0 for c in range(n_pivots)])
    sizes = [-(-facts[c]["n"] // cell_rows) if c in facts else 0 for c in range(n_pivots)]
    # parts are numbered through: those of a cell begin at its first one
    n_parts, begin = F.array(*map(F.lit, sizes)), F.array(*map(F.lit, np.cumsum([0, *sizes])[:-1].tolist()))
    cell_of = F.array(*[F.lit(c) for c, n in enumerate(sizes) for _ in range(n)])
    parts_of = lambda cell: F.sequence(F.get(begin, cell), F.get(begin, cell) + F.get(n_parts, cell) - 1)
    number = F.get(begin, F.col("cell")) + F.pmod(F.xxhash64("id", F.lit("chunk")), F.get(n_parts, F.col("cell")))
    rows = dealt.withColumn("part", number.cast("int"))
    tile = [F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), (F.col("part") <= F.col("other")).alias("first")]

    # own cell: every part meets every part
    wide = rows.select("*", F.explode(parts_of(F.col("cell"))).alias("other"))
    mates = wide.select("id", "v", F.lit(None).cast("double").alias("bar"), *tile, F.lit(True).alias("asks"))
    own = cut_lineage(_kept(_compared(mates, k, width), k), "nearest-own")
    if n_pivots == 1:
        return _expanded(units, classes, own, k)
    kth = own.groupBy("query").agg(F.when(F.count(F.lit(1)) >= k, F.min("similarity")).alias("kth"))
    reached = rows.join(kth.withColumnRenamed("query", "id"), "id", "left")
    between = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (pivots @ pivots.T)))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a row may visit every cell, so few rows at once: what is worked out and returned stays bounded
        for b in (whole.slice(at, VISIT_ROWS) for whole in batches for at in range(0, whole.num_rows, VISIT_ROWS)):
            cell = b.column("cell").to_numpy()
            kth = b.column("kth").to_numpy(zero_copy_only=False).astype(np.float64)
            reach = np.where(np.isnan(kth), np.inf, np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (kth - 10.0**-DIGITS)))) + 1e-6
            far = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (_stack(b.column("v"), width) @ pivots.T)))
            mine = far[np.arange(len(cell)), cell][:, None]
            apart = between[cell]
            plane = (far * far - mine * mine) / np.where(apart > 1e-9, 2.0 * apart, np.inf)
            low = np.maximum(far - radius, plane)
            i, j = np.nonzero((low <= reach[:, None]) & (radius >= 0) & (np.arange(len(radius)) != cell[:, None]))
            ends = np.searchsorted(i, np.arange(len(cell) + 1)).astype(np.int32)
            visits = pa.ListArray.from_arrays(pa.array(ends), pa.array(j, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), b.column("part"), b.column("kth"), visits], ["id", "v", "part", "bar", "visits"])

    visitors = cut_lineage(reached.select("id", "v", "cell", "part", "kth").mapInArrow(
        visit, "id long, v array<double>, part int, bar double, visits array<int>"), "nearest-visitors")
    # both parts of a tile in which any row asks
    asked = visitors.select("part", F.explode("visits").alias("cell")).distinct().select("part", F.explode(parts_of(F.col("cell"))).alias("other"))
    met = asked.unionByName(asked.select(F.col("other").alias("part"), F.col("part").alias("other"))).distinct()
    guests = visitors.join(cut_lineage(met, "nearest-tiles"), "part").select(
        "id", "v", "bar", *tile, F.array_contains("visits", F.get(cell_of, F.col("other"))).alias("asks"))
    found = cut_lineage(_kept(own.unionByName(_compared(guests, k, width)), k), "nearest-found")
    return _expanded(units, classes, found, k)


def _expanded(units: DataFrame, classes: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """From classes to ids: of a class no more than its k + 1 smallest ids can be a neighbour of anything."""
    members = units.join(classes.select("v", F.col("id").alias("class"), "n"), "v").select("id", "class", "n")
    first = Window.partitionBy("class").orderBy("id")
    few = (
        members.filter("n > 1").withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= k + 1)
        .groupBy("class").agg(F.collect_list("id").alias("ids"))
    )
    itself = members.filter("n > 1").select(F.col("class").alias("query"), "class", F.lit(1.0).alias("similarity")).distinct()
    listed = (
        found.unionByName(itself).join(few, "class", "left")
        .select("query", "similarity", F.explode(F.coalesce("ids", F.array("class"))).alias("neighbour"))
    )
    # k + 1 of a class are enough for each of its members, who is not its own neighbour
    best_of = Window.partitionBy("query").orderBy(F.desc("similarity"), "neighbour")
    short = (
        listed.withColumn("_n", F.row_number().over(best_of)).filter(F.col("_n") <= k + 1)
        .groupBy("query").agg(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("s"), "neighbour"))).alias("all"))
    )
    mine = members.join(short, members["class"] == short["query"]).select("id", F.slice(F.filter("all", lambda x: x["neighbour"] != F.col("id")), 1, k).alias("all"))
    return mine.select("id", F.posexplode("all").alias("_at", "x")).select(
        "id", (F.col("_at") + 1).cast("int").alias("rank"), F.col("x.neighbour").alias("neighbour"), (-F.col("x.s")).alias("similarity")
    )
