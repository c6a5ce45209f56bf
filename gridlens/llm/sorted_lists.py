"""Exact top-k by inner product from sorted lists, without random access.

The entries are dealt into pieces. Each piece keeps one list per dimension, its entries sorted by that component. A query
reads all lists in step, block by block, from the end at which its own component gives the largest products. What it has read of an
entry gives bounds of the entry's score:
* upper: the sum read so far, and for each list in which the entry has not come up the product at the list's cursor, or, if that is less, what the
  norms of the unread parts of entry and query allow (Cauchy-Schwarz; every entry carries its norm);
* lower: the sum read so far less what these norms allow.
An entry that has not come up at all is bounded by the cursors alone. Entries whose upper bound is below the k-th largest lower bound, or
below the floor that the first piece gave the query, are out. Once outsiders cannot qualify and few entries are left, or the
lists are read, the exact scores of those are worked out. Many queries read a piece together, so sums are products of matrices.

Equal vectors become one entry that carries their k + 1 smallest ids: no more of them can be among the first k of any row.
Every query meets every piece: pieces of entries and blocks of queries have limited size, so a task holds one piece
and its queries stream past. Each piece gives its k + 1 best entries for a query, which are merged by the query.

Vectors that are null, hold null or non-finite components, or have another length than most, take no part; neither do rows
without id. Rows of equal id and vector count once. Ties go to the smaller id. Scores are exact up to 38 digits; in the result one beyond a
long is given as the nearest long. An empty table gives an empty table.
"""

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlens.llm.whole_vectors import LEAST, MOST, SCALE, unpacked, whole_vectors
from gridlens.session import stage

K = 5
#: Components in a piece of entries, and queries in a block.
PIECE_COMPONENTS, BLOCK = 1 << 17, 20_000
#: Blocks of each list; a round reads lists up to a whole number of them.
LIST_BLOCKS = 8
ROUNDS = (1, 2, 3, 4, 5, 6, 7, 8)
#: Once outsiders cannot qualify and at most this share of the entries is left, exact scores of those cost less than another round.
RESOLVED = 1 / 8
#: Queries that read the lists of a piece together.
TOGETHER = 128
#: Bounds are worked out in single precision on vectors of length one at most; this covers their errors.
SLACK = 1e-5
#: Found rows of a task that are handed on at once.
HANDED_ON = 50_000
DIGITS = Decimal(10**38 - 1)
SCORE = pa.decimal128(38, 0)


def exact_scores(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products as longs, or as Python integers where a long might not hold them."""
    if not rows.size:
        return np.zeros(len(rows), np.int64)
    bound = max(abs(int(rows.min())), abs(int(rows.max()))) * max(abs(int(query.min())), abs(int(query.max()))) * rows.shape[1]
    return rows @ query if bound <= MOST else rows.astype(object) @ query.astype(object)


class Piece:
    """The sorted lists of some entries, in blocks. Whatever has been read of an entry is summed for many queries at once."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray):
        self.rows, self.ids = rows, ids
        n = len(rows)
        floats = rows.astype(np.float64)
        self.largest = float(np.sqrt((floats**2).sum(axis=1).max())) if rows.size else 0.0
        self.units = (floats / (self.largest or 1)).astype(np.float32)
        self.squares = (self.units**2).sum(axis=1)
        order = np.argsort(-floats, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.units, order, axis=0)
        #: The block of each list in which an entry stands.
        self.block = np.empty(rows.shape, np.int8)
        np.put_along_axis(self.block, order, (np.arange(n) * LIST_BLOCKS // max(n, 1)).astype(np.int8)[:, None], axis=0)
        self.parts: dict[int, tuple[np.ndarray, ...]] = {}
        #: Entries of lists that queries have read.
        self.read = 0

    def _seen(self, depth: int) -> tuple[np.ndarray, ...]:
        """What the first `depth` blocks of the lists, from the front and from the rear, show: components, squares, and marks."""
        if depth not in self.parts:
            marks = np.concatenate([self.block < depth, self.block >= LIST_BLOCKS - depth], axis=1).astype(np.float32)
            twice = np.concatenate([self.units, self.units], axis=1)
            self.parts[depth] = twice * marks, twice * twice * marks, marks
        return self.parts[depth]

    def _cursors(self, depth: int) -> np.ndarray:
        """The component at which each list stands after `depth` blocks, read from the front, then read from the rear."""
        n = len(self.rows)
        read = -(-depth * n // LIST_BLOCKS)
        front, rear = self.sorted[max(read, 1) - 1], self.sorted[min(n - 1, n * (LIST_BLOCKS - depth) // LIST_BLOCKS)]
        return np.concatenate([front, rear])

    def candidates(self, queries: np.ndarray, floors: np.ndarray, k: int) -> list[np.ndarray]:
        """For each query the entries that may be among its k best and reach its floor (a score; minus infinity for none)."""
        n, wide = len(self.rows), queries.astype(np.float64)
        lengths = np.sqrt((wide**2).sum(axis=1))
        found: list[np.ndarray] = [np.arange(n)] * len(queries)
        if n <= k or not self.largest:
            return found
        units = wide / np.where(lengths, lengths, 1)[:, None]
        # a list is read from the front where the query is positive, from the rear where it is negative
        sides = np.concatenate([np.maximum(units, 0), np.minimum(units, 0)], axis=1).astype(np.float32)
        least = (floors / (np.where(lengths, lengths, 1) * self.largest)).astype(np.float32) - SLACK
        open_ = np.flatnonzero(lengths > 0)
        for depth in ROUNDS:
            if not len(open_):
                break
            self.read += int((sides[open_] != 0).sum()) * n // LIST_BLOCKS
            cursors = sides[open_] * self._cursors(depth)
            outsider = cursors.sum(axis=1)
            # while something unread may still score more than the floor, and without one more than any score, bounds settle nothing
            ready = outsider < np.where(np.isfinite(least[open_]), least[open_], 1)
            if depth == LIST_BLOCKS:
                ready[:] = True
            at = open_[ready]
            if not len(at):
                continue
            components, squares, marks = self._seen(depth)
            read = components @ sides[at].T
            listed = outsider[ready] - marks @ cursors[ready].T
            squared = sides[at] ** 2
            rest = (squared.sum(axis=1) - marks @ squared.T + SLACK) * (self.squares[:, None] - squares @ (sides[at] != 0).astype(np.float32).T + SLACK)
            rest = np.sqrt(np.maximum(rest, 0))
            upper = read + np.minimum(listed, rest)
            kth = np.partition(read - rest, n - k, axis=0)[n - k] - SLACK
            kth = np.maximum(kth, least[at])
            alive = upper >= kth
            few = (outsider[ready] < kth) & (alive.sum(axis=0) <= n * RESOLVED)
            if depth == LIST_BLOCKS:
                few[:] = True
            for i in np.flatnonzero(few).tolist():
                found[at[i]] = np.flatnonzero(alive[:, i])
            open_ = np.setdiff1d(open_, at[few])
        return found

    def best(self, queries: np.ndarray, floors: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query ids and exact scores of its k best entries, best first, ties to the smaller id; entries below its floor may be missing."""
        for query, alive in zip(queries, self.candidates(queries, floors, k), strict=True):
            scores = exact_scores(self.rows[alive], query)
            if len(alive) > k and scores.dtype != object:
                near = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
                alive, scores = alive[near], scores[near]
            ids = self.ids[alive]
            order = sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k]
            yield ids[order], scores[order]


def _as_scores(parts: list[np.ndarray]) -> pa.Array:
    if all(p.dtype != object for p in parts):
        return pa.array(np.concatenate(parts)).cast(SCORE)
    return pa.array([max(-DIGITS, min(DIGITS, Decimal(int(s)))) for p in parts for s in p], SCORE)


def _best_of_pieces(meetings: DataFrame, k: int) -> DataFrame:
    """(query, rep, score): in each piece and block first the entries, then the queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, piece = None, None
        rows: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        count = 0

        def handed_on() -> pa.RecordBatch:
            queries, reps, scores = zip(*found, strict=True)
            return pa.record_batch([np.concatenate(queries), np.concatenate(reps), _as_scores(list(scores))], names=["query", "rep", "score"])

        for batch in batches:
            if not batch.num_rows:
                continue
            place, block, is_query, rep = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            vectors, floors = unpacked(batch.column(4)), batch.column(5).fill_null(-np.inf).to_numpy(zero_copy_only=False)
            change = (place[1:] != place[:-1]) | (block[1:] != block[:-1]) | (is_query[1:] != is_query[:-1])
            bounds = [0, *(np.flatnonzero(change) + 1).tolist(), len(place)]
            for lo, hi in zip(bounds, bounds[1:], strict=False):
                if at != (here := (place[lo], block[lo])):
                    at, piece, rows, ids = here, None, [], []
                if not is_query[lo]:
                    rows.append(vectors[lo:hi])
                    ids.append(rep[lo:hi])
                    continue
                if rows:
                    piece, rows, ids = Piece(np.concatenate(rows), np.concatenate(ids)), [], []
                if piece is None:
                    continue
                for i in range(lo, hi, TOGETHER):
                    asked = slice(i, min(hi, i + TOGETHER))
                    for query, (reps, scores) in zip(rep[asked], piece.best(vectors[asked], floors[asked], k), strict=True):
                        found.append((np.full(len(reps), query), reps, scores))
                        count += len(reps)
                    if count >= HANDED_ON:
                        yield handed_on()
                        found, count = [], 0
        if found:
            yield handed_on()

    return meetings.mapInArrow(run, "query long, rep long, score decimal(38,0)")


def search(
    df: DataFrame, is_query: Column, k: int = K, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE,
    piece_components: int = PIECE_COMPONENTS, block: int = BLOCK,
) -> DataFrame:
    """query_id, rank, vec_id and score (decimal) of the k best rows for each query row; is_query is a condition on the column id."""
    rows = stage(whole_vectors(df, key, vector, scale).where(F.col("id").isNotNull()).distinct(), "vectors")
    by_id = Window.partitionBy("x").orderBy("id")
    listed = rows.withColumn("nth", F.row_number().over(by_id)).where(F.col("nth") <= k + 1)
    entries = stage(listed.groupBy("x").agg(F.min("id").alias("rep"), F.collect_list("id").alias("ids")), "entries")
    asking = rows.where(is_query).select(F.col("id").alias("query_id"), F.col("x").alias("own"))
    queries = stage(asking.join(entries.select("x", "rep"), F.col("own") == F.col("x")).select("query_id", "rep"), "queries")
    asked = entries.join(queries.select("rep").distinct(), "rep", "left_semi").select("rep", "x")

    n_entries, n_queries, width = entries.count(), queries.select("rep").distinct().count(), 1
    if n_entries:
        width = len(unpacked(pa.array([entries.first()["x"]]))[0]) or 1
    pieces, blocks = (max(1, -(-n // size)) for n, size in ((n_entries, max(k + 1, piece_components // width)), (n_queries, block)))
    place = lambda n: F.pmod(F.xxhash64("rep"), F.lit(n)).cast("int")
    blocks_of = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    stored = entries.select(place(pieces).alias("piece"), blocks_of, F.lit(False).alias("is_query"), "rep", "x", F.lit(None).cast("double").alias("floor"))

    def searched(queries: DataFrame, first: int, last: int) -> DataFrame:
        """The queries (rep, x, floor) in the pieces first to last."""
        pieces_of = F.explode(F.sequence(F.lit(first), F.lit(last))).alias("piece")
        visits = queries.select(pieces_of, place(blocks).alias("block"), F.lit(True).alias("is_query"), "rep", "x", "floor")
        meetings = stored.where(F.col("piece").between(first, last)).unionByName(visits)
        # a number of partitions that follows the work, which the size of the rows does not show
        meetings = meetings.repartition(min(2 * (last - first + 1) * blocks, 100_000), "piece", "block")
        return _best_of_pieces(meetings.sortWithinPartitions("piece", "block", "is_query", "rep"), k + 1)

    # the k + 1 best of one piece are a floor below which no entry of another piece counts
    found = stage(searched(asked.withColumn("floor", F.lit(None).cast("double")), 0, 0), "first-piece")
    if pieces > 1:
        floors = found.groupBy("query").agg(F.min("score").cast("double").alias("floor"), F.count(F.lit(1)).alias("n")).where(F.col("n") > k)
        floors = asked.join(floors.select(F.col("query").alias("rep"), "floor"), "rep", "left")
        found = found.unionByName(searched(stage(floors, "floors"), 1, pieces - 1))

    nearest = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
    found = found.withColumn("nth", F.row_number().over(nearest)).where(F.col("nth") <= k + 1).drop("nth")
    # k + 1 entries of k + 1 ids at most for each query
    ids = found.join(entries.select("rep", "ids"), "rep").select("query", "score", F.explode("ids").alias("vec_id"))
    by_score = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ids = ids.withColumn("nth", F.row_number().over(by_score)).where(F.col("nth") <= k + 1)
    answers = stage(ids.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("nth", "vec_id", "score"))).alias("hits")), "answers")
    own = queries.join(answers, F.col("rep") == F.col("query"))
    others = F.filter("hits", lambda hit: hit["vec_id"] != F.col("query_id"))
    ranked = own.select("query_id", F.posexplode(F.slice(others, 1, k)).alias("at", "hit"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))


def op13_sorted_lists(vectors: DataFrame) -> DataFrame:
    nearest_long = F.greatest(F.least("score", F.lit(Decimal(int(MOST)))), F.lit(Decimal(int(LEAST)))).cast("long")
    return search(vectors, F.col("id") % 50 == 0).withColumn("score", nearest_long)
