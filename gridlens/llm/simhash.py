"""Near duplicates by SimHash: 64-bit fingerprints, linked at a few differing bits, and their connected components.

Fingerprint: ASCII letters are lower-cased, words joined by one space into shingles, and each bit is 1 where it is set in more than
half of the shingles' XXH64 values. A text without words (null too) has fingerprint 0 and is linked like any other.

Search, exact for every pair of different fingerprints:
* Equal fingerprints become one row first, so copies cost one row.
* Vantage points need a radius that is small beside the spread of distances, and 64 bits at radius r alone prune badly. So
  the bits are cut into r + 1 blocks: two fingerprints within r agree in one block at least, that is, are at distance 0 there.
  A shard holds the fingerprints of one value of one block. A shard above MAX_SHARD is dealt again by
  the blocks of its other bits, which keeps the search exact, until the bits are used up; then by rings of distance to vantage points that overlap by
  the radius.
* Within a shard a vantage-point tree splits at the median distance; by the triangle inequality only rows near the border
  on either side can be linked across it, and all rows within r / 2 of a vantage point are linked with each other.
* A shard returns a spanning forest, at most one row for each member, never all pairs of a group.

Components: alternating large-star and small-star steps on written tables. A component is named by its smallest
key; rows without key take the name their copies or links give them, or null. Equal rows stay. An empty table
gives an empty table.
"""

from collections.abc import Callable, Iterable, Iterator
from functools import partial
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from gridlens.llm.common import small_batches, to_batches
from gridlens.session import stage

MAX_SHARD = 20_000
LEAF = 32
#: Distances in a ring around a vantage point, and how often rings are cut by a further one.
RING, CUTS = 8, 6
SIDE = 512

# Odd factors that make further words of a hash
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)

_hash = partial(xxhash.xxh64_intdigest, seed=42)


def shingle_hashes(text: str | None, shingle: int) -> Iterator[int]:
    """XXH64 of every shingle, one for a text of fewer words, none for a text without words."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return iter(())
    if len(tokens) <= shingle:
        return map(_hash, [b" ".join(tokens)])
    return map(_hash, map(b" ".join, zip(*(tokens[i:] for i in range(shingle)), strict=False)))


def _portions(hashes: Iterable[int], size: int = 1 << 14) -> Iterator[np.ndarray]:
    if isinstance(hashes, np.ndarray):
        yield from (hashes[i : i + size] for i in range(0, len(hashes), size))
        return
    hashes = iter(hashes)
    while (part := np.fromiter(islice(hashes, size), np.uint64)).size:
        yield part


def majorities(hashes: Iterable[int], words: int = 1) -> np.ndarray:
    """For each of 64 * words bits, twice the number of hashes in which it is set less their number."""
    counts = np.zeros(64 * words, np.int64)
    total = 0
    for part in _portions(hashes):
        total += part.size
        for word in range(words):
            mixed = part
            if word:
                mixed = (part ^ (part >> np.uint64(31))) * FACTORS[word - 1]
                mixed ^= mixed >> np.uint64(29)
            bits = np.unpackbits(mixed.view(np.uint8), bitorder="little").reshape(-1, 64)
            counts[64 * word : 64 * word + 64] += bits.sum(axis=0, dtype=np.uint32)
    return 2 * counts - total


def fingerprint(text: str | None, shingle: int = 4) -> int:
    return int(np.packbits(majorities(shingle_hashes(text, shingle)) > 0, bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4) -> DataFrame:
    """key and fingerprint as a long of the same 64 bits."""
    small_batches(df.sparkSession)
    narrow = df.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t, shingle) for t in batch.column(1).to_pylist()]
            column = pa.array(np.array(prints, np.uint64).view(np.int64))
            yield pa.record_batch([batch.column(0), column], names=["key", "fingerprint"])

    return narrow.mapInArrow(run, StructType([narrow.schema["key"], StructField("fingerprint", LongType())]))


class Forest:
    """Links among the members of one shard, as the smallest member each one reaches."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        #: Pairs of members that were compared.
        self.compared = 0

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            ra, rb = self.root[a], self.root[b]
            apart = ra != rb
            if not apart.any():
                return
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.root, np.maximum(ra, rb), np.minimum(ra, rb))
            while (self.root != (up := self.root[self.root])).any():
                self.root = up


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits between rows of words."""
    return sum(np.bitwise_count(a[:, None, w] ^ b[None, :, w]).astype(np.uint16) for w in range(a.shape[1]))


def _across(points: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int, forest: Forest) -> None:
    """All links between two sets of members, a square of SIDE rows at a time."""
    for i in range(0, len(a), SIDE):
        for j in range(0, len(b), SIDE):
            x, y = a[i : i + SIDE], b[j : j + SIDE]
            apart = forest.root[x][:, None] != forest.root[y][None, :]
            if not apart.any():
                continue
            forest.compared += len(x) * len(y)
            near = (distances(points[x], points[y]) <= radius) & apart
            if near.any():
                r, c = np.nonzero(near)
                forest.link(x[r], y[c])


def linked_within(points: np.ndarray, radius: int) -> Forest:
    """The forest of all links at distance radius or less, by a vantage-point tree; points are rows of words."""
    forest = Forest(len(points))
    todo = [(np.arange(len(points)), None)]
    while todo:
        members, others = todo.pop()
        if others is not None or len(members) <= LEAF:
            _across(points, members, members if others is None else others, radius, forest)
            continue
        far = distances(points[members], points[members[len(members) // 2]][None, :])[:, 0].astype(int)
        close = members[far <= radius // 2]
        forest.link(close[1:], close[:-1])
        middle = int(np.median(far))
        inner = far <= middle
        if inner.all():
            inner = far < middle
        if not inner.any():  # all equally far from the vantage point
            _across(points, members, members, radius, forest)
            continue
        last = int(far[inner].max())
        todo += [(members[inner], None), (members[~inner], None)]
        todo.append((members[inner & (far > last - radius)], members[~inner & (far <= last + radius)]))
    return forest


def bit_blocks(bits: list[int], count: int) -> list[int]:
    """count masks that share out the given bits evenly."""
    cuts = [len(bits) * i // count for i in range(count + 1)]
    return [sum(1 << b for b in bits[lo:hi]) for lo, hi in zip(cuts, cuts[1:], strict=False)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _dealt(prints: DataFrame, masks: list[int]) -> DataFrame:
    """A row (mask, value, fingerprint) for each mask."""
    row = prints.select("fingerprint", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask"))
    return row.withColumn("value", F.col("fingerprint").bitwiseAND(F.col("mask")))


def in_shards(shards: DataFrame, by: list[str], columns: list[str], work: Callable, fields: list[str]) -> DataFrame:
    """What work makes of the rows of each shard, with the columns by if fields names them; a task sorts its shards and holds one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(f, pa.int64()) for f in fields])
        label = lambda at: at if fields[: len(by)] == by else ()

        def found(at: tuple, parts: list[np.ndarray]) -> Iterable[tuple]:
            rows = np.concatenate(parts)
            if len(rows) > 1:
                for pair in work(rows):
                    yield *label(at), *pair

        def rows():
            held: list[np.ndarray] = []
            at = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                table = np.stack([c.to_numpy() for c in batch.columns], axis=1)
                shard, points = table[:, : len(by)], np.ascontiguousarray(table[:, len(by) :])
                cuts = np.flatnonzero((shard[1:] != shard[:-1]).any(axis=1)) + 1
                bounds = [0, *cuts.tolist(), len(shard)]
                for lo, hi in zip(bounds, bounds[1:], strict=False):
                    if at != (here := tuple(shard[lo].tolist())):
                        if held:
                            yield from found(at, held)
                        held, at = [], here
                    held.append(points[lo:hi])
            if held:
                yield from found(at, held)

        yield from to_batches(rows(), schema)

    dealt = shards.select(*by, *columns).repartition(*by)
    return dealt.sortWithinPartitions(*by, columns[0]).mapInArrow(run, ", ".join(f"{f} long" for f in fields))


def _shard_links(shards: DataFrame, by: list[str], node: str, words: list[str], radius: int) -> DataFrame:
    """Forest rows (low, high) of nodes in each shard."""

    def links(rows: np.ndarray) -> Iterable[tuple]:
        root = linked_within(rows[:, 1:].view(np.uint64), radius).root
        for member in np.flatnonzero(root != np.arange(len(root))).tolist():
            yield int(rows[root[member], 0]), int(rows[member, 0])

    return in_shards(shards.withColumn("node", F.col(node)), by, ["node", *words], links, ["low", "high"])


def links(prints: DataFrame, radius: int = 4, max_shard: int = MAX_SHARD) -> DataFrame:
    """Pairs (low, high) of different fingerprints that connect all fingerprints within radius of each other.

    prints: one row for each fingerprint. Shards above max_shard, of which there are at most rows * blocks / max_shard,
    are dealt again by blocks of the bits that their mask leaves, down to the last bits.
    """
    masks = bit_blocks(list(range(64)), radius + 1)
    shards = _dealt(prints, masks)
    found_in = lambda part: _shard_links(part, ["mask", "value"], "fingerprint", ["fingerprint"], radius)
    found = None
    while True:
        sizes = shards.groupBy("mask", "value").count().where(F.col("count") > max_shard).drop("count")
        large = stage(sizes, "large-shards")
        n_large = large.count()
        can_split = [m for m in masks if 64 - m.bit_count() > 8 * (radius + 1)]
        if n_large and can_split:
            split = large.where(F.col("mask").isin([_signed(m) for m in can_split]))
            own = found_in(shards.join(split, ["mask", "value"], "left_anti"))
            found = own if found is None else found.unionByName(own)
            finer = {m: [m | b for b in bit_blocks([i for i in range(64) if not m >> i & 1], radius + 1)] for m in can_split}
            choice = F.lit(None)
            for m, parts in finer.items():
                choice = F.when(F.col("mask") == _signed(m), F.array(*[F.lit(_signed(p)) for p in parts])).otherwise(choice)
            again = shards.join(split, ["mask", "value"], "left_semi").select("fingerprint", F.explode(choice).alias("mask"))
            shards = again.withColumn("value", F.col("fingerprint").bitwiseAND(F.col("mask")))
            masks = [p for parts in finer.values() for p in parts]
            continue
        if n_large:
            split = shards.join(large, ["mask", "value"], "left_semi")
            own = found_in(shards.join(large, ["mask", "value"], "left_anti")).unionByName(_ring_links(split, radius, max_shard))
        else:
            own = found_in(shards)
        return own if found is None else found.unionByName(own)


def _ring_links(shards: DataFrame, radius: int, max_shard: int) -> DataFrame:
    """Forest rows of shards whose bits are used up, dealt by distance to a vantage point each.

    A ring takes RING distances and those less than radius beyond it. By the triangle inequality two linked members differ by
    radius at most in distance, so they share the ring of the nearer one. Rings that are still too large are cut by another vantage point.
    """
    rows = shards.withColumn("ring", F.lit("").cast("string"))
    key = ["mask", "value", "ring"]
    found = None
    for cut in range(CUTS + 1):
        rows = stage(rows, "rings")
        sizes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min_by("fingerprint", F.xxhash64("fingerprint", F.lit(cut))).alias("point"))
        large = stage(sizes.where((F.col("n") > max_shard) & F.lit(cut < CUTS)), "large-rings")
        settled = rows.join(large, key, "left_anti").withColumn("shard", F.xxhash64(*key))
        own = _shard_links(settled, ["mask", "shard"], "fingerprint", ["fingerprint"], radius)
        found = own if found is None else found.unionByName(own)
        if large.isEmpty():
            break
        far = F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("point")))
        ring = F.floor(far / RING).cast("int")
        rings = F.when((far - ring * RING < radius) & (ring > 0), F.array(ring, ring - 1)).otherwise(F.array(ring))
        cut_rows = rows.join(large, key).select("mask", "value", "ring", "fingerprint", F.explode(rings).alias("more"))
        rows = cut_rows.select("mask", "value", F.concat_ws(" ", "ring", "more").alias("ring"), "fingerprint")
    return found


def components(edges: DataFrame, low: str = "low", high: str = "high") -> DataFrame:
    """node and root (the smallest node it is connected with) for every node of the edges that is not its own root."""

    def neighbours_of(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("node"), F.col("b").alias("near")).unionByName(
            pairs.select(F.col("b").alias("node"), F.col("a").alias("near"))
        )

    def star(nodes: DataFrame, keep) -> DataFrame:
        least = nodes.groupBy("node").agg(F.min("near").alias("least"))
        # a written table, so that the join can split the rows of a node with very many neighbours
        least = stage(least.select(F.col("node").alias("of"), F.least("node", "least").alias("least")), "least")
        return nodes.join(least, F.col("node") == F.col("of")).where(keep)

    def facts(pairs: DataFrame):
        own = F.xxhash64("a", "b")
        return tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.shiftright(own, 20)), F.bit_xor(own)).first())

    pairs = edges.select(F.least(low, high).alias("a"), F.greatest(low, high).alias("b")).where("a != b").distinct()
    pairs = stage(pairs, "links")
    before = facts(pairs)
    while before[0]:
        both = star(neighbours_of(pairs), F.col("near") > F.col("node"))
        large = both.select(F.col("least").alias("a"), F.col("near").alias("b")).where("a != b").distinct()
        down = large.select(F.col("b").alias("node"), F.col("a").alias("near"))
        small = star(down, F.lit(True))
        joined = small.select(F.col("least").alias("a"), F.col("near").alias("b")).unionByName(
            small.select(F.col("least").alias("a"), F.col("node").alias("b"))
        )
        pairs = stage(joined.where("a != b").distinct(), "links")
        after = facts(pairs)
        if after == before:
            break
        before = after
    return pairs.select(F.col("b").alias("node"), F.col("a").alias("root"))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """key, fingerprint (long) and component_id for every row."""
    prints = stage(fingerprints(df, key, text, shingle), "fingerprints")
    distinct = stage(prints.groupBy("fingerprint").agg(F.min("key").alias("least_key")), "distinct-fingerprints")
    roots = components(links(distinct.select("fingerprint"), radius))
    named = distinct.join(roots, F.col("fingerprint") == F.col("node"), "left")
    named = named.select("fingerprint", "least_key", F.coalesce("root", "fingerprint").alias("root"))
    names = stage(named.groupBy("root").agg(F.min("least_key").alias("component_id")), "component-names")
    names = named.join(names, "root").select("fingerprint", "component_id")
    return prints.join(names, "fingerprint").select(F.col("key").alias(key), "fingerprint", "component_id")


def op3_simhash(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")
