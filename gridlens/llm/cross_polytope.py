"""Nearest neighbours by inner product, with cross-polytope hashing and several probes.

A pseudo-rotation, three rounds of random signs and a fast Hadamard transform, moves the axes of a table; a vector's bucket is
the signed axis nearest to its direction. A query looks into the `probes` buckets whose axes are nearest to it, in each of `tables`
tables, and whatever it finds there is ranked by the exact inner product of the original vectors in double precision.

Directions say little about inner products where norms differ, so entries are dealt into bands of norms, BAND apart from the next, with
tables of their own; within a band the order by angle is nearly that by inner product. The `head` entries with the largest norms
are ranked for every query exactly. Their k + 1 best are a floor: a band whose largest norm times the query's is below it is not
visited, the others all are, and what scores less is not handed on. So no query finds fewer rows than there are in the head.

Every row is indexed. Equal vectors become one entry that carries their k + 1 smallest ids: no more of them can be among the first k
of any row, so results stay whole however often a vector occurs. Buckets above MAX_BUCKET entries are cut
by a hash of the entry, and the queries visit every piece. A task holds one piece at a time, while queries stream past.

Vectors that are null, zero, hold null or non-finite components, or have another length than most, take no part; neither do rows
without id. Ties go to the smaller id. Rows of equal id and vector count once. An empty table gives an empty table.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlens.session import prepare, stage

TABLES = 10
PROBES = 12
MAX_BUCKET = 20_000
#: Factor between the norms of neighbouring bands, number of bands (the last one holds all smaller norms), entries ranked for every query.
BAND, BANDS, HEAD = 1.5, 40, 2048
#: Query rows in one block, and found rows of a task that are kept before they are merged.
BLOCK, KEPT = 2_000, 400_000


def usable_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """key as long and vector as array of doubles, for the rows that take part."""
    values = F.col(vector).cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(key).cast("long").alias("id"), values.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    rows = rows.where(finite & F.exists("v", lambda x: x != 0))
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("v") == (lengths["n"] if lengths else 0))


def _hadamard(rows: np.ndarray) -> np.ndarray:
    n, width = rows.shape
    step = 1
    while step < width:
        pairs = rows.reshape(n, width // (2 * step), 2, step)
        rows = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, width)
        step *= 2
    return rows / np.sqrt(width)


def rotated(rows: np.ndarray, table: int, seed: int = 6) -> np.ndarray:
    rng = np.random.default_rng([seed, table])
    for _ in range(3):
        rows = _hadamard(rows * rng.choice([-1.0, 1.0], rows.shape[1]))
    return rows


def axes(rows: np.ndarray, count: int) -> np.ndarray:
    """The `count` nearest signed axes of each row, nearest first: 2 * axis, plus 1 for the negative side."""
    sides = np.stack([rows, -rows], axis=2).reshape(len(rows), -1)
    if count == 1:
        return sides.argmax(axis=1)[:, None]
    count = min(count, sides.shape[1])
    top = np.argpartition(-sides, count - 1, axis=1)[:, :count]
    order = np.argsort(-np.take_along_axis(sides, top, axis=1), axis=1, kind="stable")
    return np.take_along_axis(top, order, axis=1)


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Directions, as wide as the next power of two."""
    out = np.zeros((len(vectors), 1 << (vectors.shape[1] - 1).bit_length()))
    out[:, : vectors.shape[1]] = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    return out


def _as_matrix(column: pa.Array) -> np.ndarray:
    """Packed vectors of one width as doubles."""
    values = column.to_pylist()
    out = np.empty((len(values), (len(values[0]) - 1) // values[0][0]))
    sizes = np.array([v[0] for v in values])
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        out[at] = np.frombuffer(b"".join(values[i][1:] for i in at.tolist()), f"<f{size}").reshape(len(at), -1)
    return out


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The item size and the items, singles where they hold the values, else doubles, so that equal vectors are equal bytes; -0.0 becomes 0."""

    def pack(values: list[float]) -> bytes:
        row = np.array(values) + 0.0
        with np.errstate(over="ignore"):
            single = row.astype("<f4")
        return b"\x04" + single.tobytes() if (single == row).all() else b"\x08" + row.astype("<f8").tobytes()

    for batch in batches:
        yield pa.record_batch([batch.column(0), pa.array(map(pack, batch.column(1).to_pylist()), pa.binary())], names=["id", "v"])


def _norms(rows: DataFrame) -> DataFrame:
    """rep, v and norm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.record_batch([b.column(0), b.column(1), pa.array(np.linalg.norm(_as_matrix(b.column(1)), axis=1))], names=["rep", "v", "norm"])

    return rows.select("rep", "v").mapInArrow(run, "rep long, v binary, norm double")


def _hashed(rows: DataFrame, tables: int, probes: int) -> DataFrame:
    """A row (place, rep, v, floor) for each band, table and probe of rows (rep, v, floor, bands); place is band * 2 ** 40 + table * 2 ** 32 + axis."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rep, packed, floor, bands = batch.columns
            units = unit_rows(_as_matrix(packed))
            for table in range(tables):
                own = axes(rotated(units, table), probes)
                place = pa.array((own + (table << 32)).ravel().astype(np.int64))
                take = pa.array(np.repeat(np.arange(len(units)), own.shape[1]))
                yield pa.record_batch([place, *(c.take(take) for c in (rep, packed, floor, bands))], names=["at", "rep", "v", "floor", "bands"])

    found = rows.select("rep", "v", "floor", "bands").mapInArrow(run, "at long, rep long, v binary, floor double, bands array<long>")
    spread = found.select("at", "rep", "v", "floor", F.explode("bands").alias("band"))
    return spread.select((F.col("at") + F.shiftleft("band", 40)).alias("place"), "rep", "v", "floor")


def _nearest(scores: np.ndarray, entries: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each query row the k best entries and all that tie with the last: query, entry and exact score."""
    if scores.shape[1] > k:
        last = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
        row, column = np.nonzero(scores >= (last - 1e-9 * np.maximum(1, np.abs(last)))[:, None])
    else:
        row, column = np.nonzero(np.ones(scores.shape, bool))
    # a sum in fixed order: the same two vectors have the same score wherever they meet
    exact = np.concatenate([(entries[column[i : i + 65536]] * queries[row[i : i + 65536]]).sum(axis=1) for i in range(0, len(row), 65536)])
    return row, column, exact


def _best(query: np.ndarray, rep: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best different entries of each query."""
    order = np.lexsort((rep, -score, query))
    query, rep, score = query[order], rep[order], score[order]
    new = np.ones(len(query), bool)
    new[1:] = (query[1:] != query[:-1]) | (rep[1:] != rep[:-1])
    query, rep, score = query[new], rep[new], score[new]
    starts = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.zeros(0, int)
    rank = np.arange(len(query)) - np.repeat(starts, np.diff(np.r_[starts, len(query)]))
    return query[rank < k], rep[rank < k], score[rank < k]


def _reranked(meetings: DataFrame, k: int) -> DataFrame:
    """(query, rep, score): within each piece of a bucket its entries, then the queries that visit it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, entries, reps = None, None, None
        held: list[tuple[np.ndarray, ...]] = []
        names = ["query", "rep", "score"]

        def merged() -> pa.RecordBatch:
            nonlocal held
            best = _best(*(np.concatenate(c) for c in zip(*held, strict=True)), k)
            held = []
            return pa.record_batch(list(map(pa.array, best)), names=names)

        waiting: list[np.ndarray] = []
        waiting_reps: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            place, piece, is_query, rep = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            vectors, floors = _as_matrix(batch.column(4)), batch.column(5).fill_null(-np.inf).to_numpy(zero_copy_only=False)
            change = (place[1:] != place[:-1]) | (piece[1:] != piece[:-1]) | (is_query[1:] != is_query[:-1])
            bounds = [0, *(np.flatnonzero(change) + 1).tolist(), len(place)]
            for lo, hi in zip(bounds, bounds[1:], strict=False):
                if at != (here := (place[lo], piece[lo])):
                    at, entries, waiting, waiting_reps = here, None, [], []
                if not is_query[lo]:
                    waiting.append(vectors[lo:hi])
                    waiting_reps.append(rep[lo:hi])
                    continue
                if waiting:
                    entries, reps, waiting, waiting_reps = np.concatenate(waiting), np.concatenate(waiting_reps), [], []
                if entries is None:
                    continue
                block = max(1, min(BLOCK, 8_000_000 // len(entries)))
                for i in range(lo, hi, block):
                    queries, query_reps = vectors[i : min(hi, i + block)], rep[i : min(hi, i + block)]
                    row, column, exact = _nearest(queries @ entries.T, entries, queries, k)
                    high = exact >= floors[i + row]
                    held.append(_best(query_reps[row[high]], reps[column[high]], exact[high], k))
                    if sum(len(h[0]) for h in held) > KEPT:
                        yield merged()
        if held:
            yield merged()

    return meetings.mapInArrow(run, "query long, rep long, score double")


def search(
    df: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding",
    tables: int = TABLES, probes: int = PROBES, max_bucket: int = MAX_BUCKET, head: int = HEAD,
) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest rows found for each query row; is_query is a condition on the id (column id)."""
    spark = prepare(df.sparkSession)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5000")
    usable = usable_vectors(df, key, vector)
    packed = stage(usable.mapInArrow(_packed, "id long, v binary").distinct(), "vectors")
    first_ids = Window.partitionBy("v").orderBy("id")
    listed = packed.withColumn("place", F.row_number().over(first_ids)).where(F.col("place") <= k + 1)
    entries = listed.groupBy("v").agg(F.min("id").alias("rep"), F.collect_list("id").alias("ids"))
    entries = stage(entries, "entries")
    asking = packed.where(is_query)
    queries = asking.select(F.col("id").alias("query_id"), F.col("v").alias("own")).join(
        entries.select("v", "rep"), F.col("own") == F.col("v")
    )
    queries = stage(queries.select("query_id", "rep"), "queries")
    entries = entries.join(_norms(entries).select("rep", "norm"), "rep")
    entries = stage(entries, "entries-with-norms")
    query_vectors = entries.join(queries.select("rep").distinct(), "rep", "left_semi").select("rep", "v", "norm")
    largest = entries.agg(F.max("norm")).first()[0] or 1.0
    band = F.least(F.lit(BANDS - 1), F.floor(F.log(F.lit(largest) / F.col("norm")) / math.log(BAND))).cast("long")
    entries = entries.withColumn("band", F.greatest(F.lit(0).cast("long"), band))
    # one row for each band, of which there are BANDS at most
    tops = {r["band"]: r["top"] for r in entries.groupBy("band").agg(F.max("norm").alias("top")).collect()}

    # the head meets every query, in blocks of queries
    best = entries.orderBy(F.desc("norm"), "rep").limit(head).select("rep", "v")
    blocks = max(1, -(-query_vectors.count() // BLOCK))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("piece")
    own_block = F.pmod(F.xxhash64("rep"), F.lit(blocks)).cast("int").alias("piece")
    none = F.lit(None).cast("double").alias("floor")
    front = lambda piece, is_query: (F.lit(-1).cast("long").alias("place"), piece, F.lit(is_query).alias("is_query"), "rep", "v", none)
    met = best.select(*front(every, False)).unionByName(query_vectors.select(*front(own_block, True)))
    met = met.repartition(min(2 * blocks, 10_000), "piece").sortWithinPartitions("place", "piece", "is_query", "rep")
    first = stage(_reranked(met, k + 1), "head-scores")
    floors = first.groupBy("query").agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("n")).where(F.col("n") > k)
    asking = query_vectors.join(floors.select(F.col("query").alias("rep"), "floor"), "rep", "left")
    reach = lambda top: F.col("floor").isNull() | (F.lit(top * (1 + 1e-9)) * F.col("norm") >= F.col("floor"))
    visited = F.array_compact(F.array(*[F.when(reach(top), F.lit(number).cast("long")) for number, top in sorted(tops.items())]))
    asking = asking.withColumn("bands", visited.cast("array<long>"))

    indexed = stage(_hashed(entries.withColumns({"bands": F.array("band"), "floor": F.lit(None).cast("double")}), tables, 1), "index")
    asked = _hashed(asking, tables, probes)
    # one row for each bucket: bands * tables * axes, whatever the input
    sizes = indexed.groupBy("place").agg(F.ceil(F.count(F.lit(1)) / max_bucket).alias("pieces"))
    sizes = F.broadcast(sizes.withColumnRenamed("place", "of"))
    cut = lambda rows: rows.join(sizes, F.col("place") == F.col("of"))
    stored = cut(indexed).select("place", F.pmod(F.xxhash64("rep"), "pieces").cast("int").alias("piece"), F.lit(False).alias("is_query"), "rep", "v", none)
    visits = cut(asked).select(
        "place", F.explode(F.sequence(F.lit(0), F.col("pieces").cast("int") - 1)).alias("piece"), F.lit(True).alias("is_query"), "rep", "v", "floor"
    )
    meetings = stored.unionByName(visits).repartition("place", "piece").sortWithinPartitions("place", "piece", "is_query", "rep")
    found = _reranked(meetings, k + 1).unionByName(first).distinct()
    nearest = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
    found = found.withColumn("nth", F.row_number().over(nearest)).where(F.col("nth") <= k + 1).drop("nth")
    # k + 1 entries of k + 1 ids at most
    ids = found.join(entries.select("rep", "ids"), "rep").select("query", "score", F.explode("ids").alias("vec_id"))
    by_score = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ids = ids.withColumn("nth", F.row_number().over(by_score)).where(F.col("nth") <= k + 1)
    answers = ids.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("nth", "vec_id", "score"))).alias("list"))
    own = queries.join(answers, F.col("rep") == F.col("query"))
    others = F.filter("list", lambda a: a["vec_id"] != F.col("query_id"))
    ranked = own.select("query_id", F.posexplode(F.slice(others, 1, k)).alias("at", "hit"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))


def op6_cross_polytope(vectors: DataFrame) -> DataFrame:
    return search(vectors, F.col("id") % 20 == 0)
