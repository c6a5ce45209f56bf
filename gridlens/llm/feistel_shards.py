"""Sharding by a Feistel permutation of global row numbers, with cycle walking.

Rows are numbered 0 .. n-1 in the order of given columns. A keyed permutation moves row number x to position p;
shard and slot are p mod shards and p div shards, so shard sizes differ by one at most. Each of the three
numbers follows from each other one by arithmetic alone: nothing has to be looked up.

Nulls in the ordering columns come first. Equal rows get different numbers and are interchangeable. An empty
table gives an empty table. Only integer expressions run on the rows; no Python.
"""

import hashlib
from math import isqrt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridlens.session import stage

ROUNDS = 8
PRIME = (1 << 31) - 1


class Permutation:
    """A permutation of 0 .. n-1 that a seed fixes.

    Numbers are written as left + a * right with left < a and right < b, where a * b is n or little more. In turn one
    half is moved by a function of the other, modulo its own range, which is undone by subtraction. What lands
    at n or above is permuted again until it is below. The few numbers above n (at most the root of n) tell how often that
    is needed at most, so the expression has exactly that many steps.
    """

    def __init__(self, n: int, seed: int = 0, rounds: int = ROUNDS):
        self.n = max(n, 1)
        self.a = isqrt(self.n - 1) + 1
        self.b = -(-self.n // self.a)
        digest = hashlib.blake2b(f"{seed}".encode(), digest_size=8 * rounds).digest()
        words = [int.from_bytes(digest[i : i + 4], "little") % (PRIME - 1) + 1 for i in range(0, 8 * rounds, 4)]
        self.keys = list(zip(words[::2], words[1::2], strict=True))
        self.steps = 1 + self._extra_steps()

    def _extra_steps(self) -> int:
        outside, steps = range(self.n, self.a * self.b), 0
        while outside:
            outside = [y for y in map(self._once, outside) if y >= self.n]
            steps += 1
        return steps

    def _mix(self, value, key: tuple[int, int]):
        shifted = (value + key[0]) % PRIME
        return shifted * shifted % PRIME * key[1] % PRIME

    def _once(self, x: int) -> int:
        left, right = x % self.a, x // self.a
        for i, key in enumerate(self.keys):
            if i % 2:
                right = (right + self._mix(left, key)) % self.b
            else:
                left = (left + self._mix(right, key)) % self.a
        return left + self.a * right

    def __call__(self, x: int) -> int:
        x = self._once(x)
        while x >= self.n:
            x = self._once(x)
        return x

    def apply(self, df: DataFrame, number: str, back: bool = False) -> DataFrame:
        """Replace a column of numbers below n by their positions, or with back=True positions by numbers."""
        left, right = "feistel left", "feistel right"
        for step in range(self.steps):
            inside = F.lit(step > 0) & (F.col(number) < self.n)
            df = df.withColumns({left: F.col(number) % F.lit(self.a), right: F.expr(f"`{number}` div {self.a}L")})
            for i, key in reversed(list(enumerate(self.keys))) if back else enumerate(self.keys):
                moved, other, side = (right, left, self.b) if i % 2 else (left, right, self.a)
                shift = self._mix(F.col(other), key) % F.lit(side)
                df = df.withColumn(moved, (F.col(moved) + (F.lit(side) - shift if back else shift)) % F.lit(side))
            moved_to = F.col(left) + F.lit(self.a) * F.col(right)
            df = df.withColumn(number, F.when(inside, F.col(number)).otherwise(moved_to)).drop(left, right)
        return df


def numbered(rows: DataFrame, order: list[str], number: str) -> tuple[DataFrame, int]:
    """Rows with their global number in the given order, and the number of rows.

    One range shuffle sorts the rows; they are written with their place inside their partition, and the
    partitions' sizes (one row each) give the number of the first row of each. The written table
    fixes the numbers, whatever is lost later.
    """
    place = "place in partition"
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stage(sorted_rows.withColumn(place, F.monotonically_increasing_id()), "numbered")
    partition = F.shiftright(place, 33)
    sizes = placed.groupBy(partition.alias("partition")).agg(F.count(F.lit(1)).alias("size"))
    before = F.sum("size").over(Window.orderBy("partition").rowsBetween(Window.unboundedPreceding, -1))
    firsts = sizes.select(F.col("partition").alias("feistel partition"), F.coalesce(before, F.lit(0)).alias("feistel first"))
    # one row for each partition of the shuffle, so its size is bounded by a setting
    joined = placed.join(F.broadcast(firsts), partition == F.col("feistel partition"))
    inside = F.col(place).bitwiseAND(F.lit((1 << 33) - 1))
    return joined.withColumn(number, F.col("feistel first") + inside).drop(place, "feistel partition", "feistel first"), placed.count()


def shuffled_shards(rows: DataFrame, shards: int, order: list[str], seed: int = 0) -> DataFrame:
    """Rows with row_number, shard and slot. Pass narrow rows: all columns travel through one shuffle.

    Columns of these three names in the input are replaced.
    """
    own = [c for c in rows.columns if c.lower() not in ("row_number", "shard", "slot")]
    with_number, n = numbered(rows.select(*own), order, "row_number")
    position = Permutation(n, seed).apply(with_number.withColumn("feistel position", F.col("row_number")), "feistel position")
    return position.select(
        *own,
        "row_number",
        (F.col("feistel position") % shards).cast("int").alias("shard"),
        F.expr(f"`feistel position` div {shards}L").alias("slot"),
    )


def row_numbers_of(places: DataFrame, n: int, shards: int, seed: int = 0) -> DataFrame:
    """The row number at each (shard, slot) of a table of n rows."""
    position = F.col("slot") * shards + F.col("shard")
    return Permutation(n, seed).apply(places.withColumn("row_number", position.cast("long")), "row_number", back=True)


def document_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 8; null text: 8) and CRC-32 of the text (null: of no bytes)."""
    return docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8).alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )


def op8_feistel_shards(docs: DataFrame, shards: int = 24, seed: int = 8) -> DataFrame:
    rows = shuffled_shards(document_sizes(docs), shards, ["doc_id", "text_crc32", "size"], seed)
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "row_number",
    )
