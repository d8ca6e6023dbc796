"""Exact search that skips blocks.

Items lie in blocks of like direction. A block's cone (its centre, the largest angle of an item to it, the longest and the
shortest vector) bounds what a query can score in it. Every query visits blocks in the order of their bounds, in waves of 1, 2, 4, ... blocks; a
block whose bound is below the query's k-th best score so far is skipped, and so are all after it. Where bounds say little, waves grow until
their lists would have more than `WAVE_SHARE` times the rows of the whole answer; whoever is left then is searched for exactly. The rows are those of the exact search.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recspark.functions.numbers import SCORE_DIGITS
from recspark.functions.vectors import as_doubles, dot, norm, unit
from recspark.operators.cells import MAX_CENTROID_BYTES, assign_cells
from recspark.operators.ranking import best_first, top_per_group
from recspark.operators.search import MAX_CELLS, cell_candidates, exact_topk, merge_lists
from recspark.session import checkpointed

BLOCK_ROWS = 4096
WAVE_SHARE = 2
WAVE_ROWS = 2_000_000
SLACK = 1e-9  # what a bound may lack by the rounding of floats


@dataclass
class Cones:
    items: DataFrame  # asin, embedding, cell (the number of the block)
    cones: DataFrame  # cell, centre, cosine (of the largest angle), longest, shortest


def build_cones(items: DataFrame, centroids: DataFrame, block_rows: int = BLOCK_ROWS) -> Cones:
    """Blocks of at most about `block_rows` items around centroids; a cell with more is cut by a hash of the ids."""
    placed = checkpointed(assign_cells(items.select("asin", "embedding"), centroids).withColumnRenamed("cell", "_cell"))
    sizes = placed.groupBy("_cell").agg(F.count("*").alias("n")).orderBy("_cell").limit(MAX_CELLS + 1).collect()
    plan, first = [], 0
    for row in sizes:
        parts = -(-row["n"] // block_rows)
        plan.append((row["_cell"], first, parts))
        first += parts
    if first > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} blocks; use larger ones")
    # One row per cell, at most MAX_CELLS: safe to broadcast.
    parts = F.broadcast(items.sparkSession.createDataFrame(plan, "_cell int, first int, parts int"))
    number = (F.col("first") + F.pmod(F.xxhash64("asin"), F.col("parts"))).cast("int").alias("cell")
    blocks = checkpointed(placed.join(parts, "_cell").select("asin", "embedding", number))
    directions = blocks.select("cell", unit(F.col("embedding")).alias("direction"), norm(F.col("embedding")).alias("length"))
    mean = vector_to_array(Summarizer.mean(array_to_vector("direction")))
    centres = directions.groupBy("cell").agg(mean.alias("mean")).select("cell", unit(F.col("mean")).alias("centre"))
    centres = checkpointed(centres)
    cones = directions.join(F.broadcast(centres), "cell").groupBy("cell").agg(
        F.first("centre").alias("centre"), F.min(dot(F.col("direction"), F.col("centre"))).alias("cosine"),
        F.max("length").alias("longest"), F.min("length").alias("shortest"),
    )
    return Cones(blocks, checkpointed(cones))


def _next_blocks(index: Cones, slack: float):
    """A function of (vector, visited, take, worst) to the next blocks to visit: `take` more, in the order of their bounds, none below `worst`."""
    import numpy as np

    rows = index.cones.orderBy("cell").limit(MAX_CELLS + 1).collect()
    if sum(len(r["centre"]) for r in rows) * 8 > MAX_CENTROID_BYTES:
        raise ValueError("too many blocks; use larger ones")
    numbers = np.array([r["cell"] for r in rows], dtype=np.int32)
    centres = np.array([r["centre"] for r in rows])
    widest = np.arccos(np.clip([r["cosine"] for r in rows], -1, 1))
    longest, shortest = np.array([r["longest"] for r in rows]), np.array([r["shortest"] for r in rows])

    @F.arrow_udf("array<int>")
    def choose(vectors, visited, take, worst):
        import numpy as np
        import pyarrow as pa

        points = np.asarray(vectors.flatten(), dtype=np.float64).reshape(len(vectors), -1)
        visited, take = np.asarray(visited), np.asarray(take)
        worst = np.asarray(worst.fill_null(-np.inf))
        out, step = [], max(1, 4_000_000 // len(numbers))
        for start in range(0, len(points), step):
            part = points[start : start + step]
            length = np.linalg.norm(part, axis=1)
            cosine = np.clip(part @ centres.T / np.where(length > 0, length, 1)[:, None], -1, 1)
            nearest = np.cos(np.maximum(np.arccos(cosine) - widest, 0))
            bound = length[:, None] * nearest * np.where(nearest >= 0, longest, shortest) + slack
            order = np.argsort(-bound, axis=1, kind="stable")
            for i, row in enumerate(order):
                chosen = row[visited[start + i] : visited[start + i] + take[start + i]]
                out.append(numbers[chosen[bound[i, chosen] >= worst[start + i]]].tolist())
        return pa.array(out, pa.list_(pa.int32()))

    return choose


def skipping_topk(queries: DataFrame, index: Cones, k: int = 100, *, first: int = 1, digits: int = SCORE_DIGITS) -> tuple[DataFrame, DataFrame]:
    """The k items of highest inner product for every query, as `exact_topk`, and `(query_id, visited)`: how many blocks it took.

    Scores are rounded before they are ranked, so a bound may lie half a unit of the last digit below a score that still counts.
    """
    choose = _next_blocks(index, SLACK + 0.5 * 10.0**-digits)
    state = checkpointed(queries.select("query_id", "embedding", F.lit(0).alias("visited"), F.lit(None).cast("double").alias("worst")))
    n_items, n_blocks = index.items.count(), index.cones.count()
    per_block, answer = min(k, -(-n_items // max(1, n_blocks))), state.count() * min(k, n_items)
    found, open_rows, take, wave = None, state, first, 0
    done = []
    while True:
        chosen = choose(F.col("embedding"), F.col("visited"), F.lit(take), F.col("worst"))
        asked = checkpointed(open_rows.withColumn("blocks", chosen))
        # Whoever has no block left to visit is done.
        done.append(asked.filter(F.size("blocks") == 0).select("query_id", "visited"))
        going = asked.filter(F.size("blocks") > 0)
        n_pairs = going.agg(F.sum(F.size("blocks"))).first()[0] or 0
        if not n_pairs:
            break
        if n_pairs * per_block > max(WAVE_ROWS, WAVE_SHARE * answer):
            fresh = exact_topk(going.select("query_id", "embedding"), index.items.select("asin", "embedding"), k, n_items=n_items, digits=digits)
            fresh = fresh.select("query_id", "asin", "score")
            ids = going.select(F.col("query_id").alias("_id")).distinct()
            found = fresh if found is None else found.join(ids, found["query_id"].eqNullSafe(ids["_id"]), "left_anti").unionByName(fresh)
            done.append(going.select("query_id", F.lit(n_blocks).alias("visited")))
            break
        pairs = going.select("query_id", "embedding", F.explode("blocks").alias("cell"))
        lists, most, n_cells = cell_candidates(pairs, index.items, k, digits=digits)
        fresh = merge_lists(lists, k, most * min(take, n_cells)).drop("rank")
        both = fresh if found is None else found.unionByName(fresh)
        found = checkpointed(top_per_group(both, ["query_id"], best_first(), k).drop("rank"))
        worst = found.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least"))
        worst = worst.select("query_id", F.when(F.col("n") >= k, F.col("least")).alias("worst"))
        visited = (F.col("visited") + F.size("blocks")).alias("visited")
        open_rows = going.select("query_id", "embedding", visited).join(worst, "query_id", "left")
        take *= 2
    if found is None:
        query_id, item_id = queries.schema["query_id"], index.items.schema["asin"]
        kinds = f"query_id {query_id.dataType.simpleString()}, asin {item_id.dataType.simpleString()}, score double"
        found = queries.sparkSession.createDataFrame([], kinds)
    visits = done[0]
    for more in done[1:]:
        visits = visits.unionByName(more)
    return top_per_group(found, ["query_id"], best_first(), k), visits
