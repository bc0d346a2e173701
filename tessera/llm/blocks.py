"""A stated query set against all rows, in blocks: what both vector searches share.

Rows are dealt evenly to blocks by their place, never by content, so equal vectors do not
meet in one task. Every query is sent to every block; a block's rows arrive first and are
indexed once, then its queries stream past in small batches, so a task holds one block and
one batch. Each block answers with its k best per query and a window keeps the k best of
all. Shuffled rows: the table once, and (blocks x queries) for the queries; blocks are as large
as memory allows once every core has some, so that queries are sent out as seldom as can be.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import slices

BLOCK_ROWS, LARGE_BLOCK_ROWS = 4096, 65_536  # rows of a block while there are fewer than BLOCKS_A_CORE blocks a core, and at most
BLOCKS_A_CORE = 3
QUERY_BATCH = 256

#: (ids, vectors) of a block -> (query ids, query vectors) -> (query index, row index, score), best k of each.
Prepare = Callable[[np.ndarray, np.ndarray], Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]]


def usable(vectors: DataFrame, id_col: str, vec_col: str, zero: bool) -> DataFrame:
    """__id and __vec array<double> of rows that take part: neither null, no null or non-finite component."""
    finite = F.forall(vec_col, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(math.inf)), F.lit(False)))
    keep = F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & (F.size(vec_col) > 0) & finite
    if not zero:
        keep &= F.exists(vec_col, lambda x: x != 0)
    return vectors.where(keep).select(F.col(id_col).alias("__id"), F.col(vec_col).alias("__vec"))


def search(rows: DataFrame, queries: DataFrame, prepare: Prepare, k: int, score_type: str, best_first: Column, block_rows: int | None = None) -> DataFrame:
    """query_id, rank, id and score of the k best rows of each query. rows and queries: usable().

    Rows with a query's own id are left out by `prepare`'s answers; a query id or a row that is
    repeated counts once. Only vectors of a query's length are compared with it."""
    total, cores = rows.count(), rows.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, math.ceil(total / (block_rows or LARGE_BLOCK_ROWS)))
    if not block_rows:
        blocks = max(blocks, min(math.ceil(total / BLOCK_ROWS), BLOCKS_A_CORE * cores))
    block = lambda place: F.struct(F.size("__vec").alias("dim"), place.cast("int").alias("at"))
    dealt = rows.select(block(F.monotonically_increasing_id() % blocks).alias("__block"), F.lit(0).alias("__kind"), "__id", "__vec")
    asked = queries.groupBy("__id").agg(F.min("__vec").alias("__vec"))
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("__at"), "__id", "__vec").select(block(F.col("__at")).alias("__block"), F.lit(1).alias("__kind"), "__id", "__vec")
    both = dealt.unionByName(asked).repartitionById(blocks, F.col("__block.at")).sortWithinPartitions("__block", "__kind", "__id")
    both = both.select("__block.dim", "__block.at", "__kind", "__id", "__vec")
    kind = pa.int64() if score_type == "long" else pa.float64()
    id_type = rows.schema["__id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, answer = None, [], None
        for batch in slices(batches, QUERY_BATCH):
            dims, places, kinds = (np.asarray(batch.column(i)) for i in range(3))
            cuts = np.flatnonzero((np.diff(dims) != 0) | (np.diff(places) != 0) | (np.diff(kinds) != 0)) + 1
            for start, end in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                key = (dims[start], places[start])
                if key != now:
                    now, held, answer = key, [], None
                ids = np.asarray(batch.column(3).slice(start, end - start))
                vectors = np.asarray(batch.column(4).slice(start, end - start).flatten()).reshape(end - start, -1)
                if kinds[start] == 0:
                    held.append((ids, vectors))
                    continue
                if not held:
                    continue
                if answer is None:
                    block_ids, block_vectors = (np.concatenate(x) for x in zip(*held, strict=True))
                    answer = prepare(block_ids, block_vectors)
                q, r, score = answer(ids, vectors)
                yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(block_ids[r]), pa.array(score, kind)], names=["query_id", "id", "score"])

    found = both.mapInArrow(run, f"query_id {id_type}, id {id_type}, score {score_type}")
    found = found.groupBy("query_id", "id").agg((F.max if score_type == "long" else F.min)("score").alias("score"))  # a repeated row counts once
    order = W.partitionBy("query_id").orderBy(best_first, "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score")


def best_distinct(ids: np.ndarray, order: np.ndarray, own: int, k: int) -> list[int]:
    """The first k of `order` with different ids, the query's own left out."""
    out, seen = [], {own}
    for i in order:
        if ids[i] not in seen:
            seen.add(ids[i])
            out.append(int(i))
            if len(out) == k:
                break
    return out
