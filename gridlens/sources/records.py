"""CSV records with line breaks inside quoted fields, cut in parallel out of lines that arrive by split.

A line alone does not tell whether it starts inside quotes, but what it does to either case is known: each line is a function from the
state before it to the state after it. Functions of lines combine to one of a split, those of a file's splits, a row each, tell where
every split starts, and then every line knows its own state. Lines that start outside quotes start a record. Quotes mean what
they mean to the usual CSV readers: one opens a field only at its start, two inside a quoted field are one quote.

A record must fit in a task, as any row. A file that ends inside quotes ends its last record. Carriage returns before a line break are dropped by the scan.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlens import schema as S
from gridlens.operators.joins import small_side
from gridlens.session import stage

# what lies inside quotes; possessive, so that a line of any length is read once and without recursion
_QUOTED = '"[^"]*+(?:""[^"]*+)*+'
# fields that end with a comma, then one that stays open; a quote opens a field only at its start
_OPEN = rf'^(?:(?:[^",][^,]*+|{_QUOTED}"(?:[^",][^,]*+)?+)?+,)*+{_QUOTED}\z'


def _ends_inside(line: Column, inside: bool) -> Column:
    """Whether a line that starts outside (or inside) quotes ends inside them; to start inside is to have read a quote."""
    return F.when(F.contains(line, F.lit('"')), F.concat(F.lit('"'), line).rlike(_OPEN) if inside else line.rlike(_OPEN)).otherwise(inside)


def opens_record(line: Column) -> Column:
    """Whether a line that starts a record leaves it open. A file without such a line has a record on every line."""
    return _ends_inside(line, False)


def _state_before(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """Combines functions along an order: adds fixed_before, the state before a row where an earlier row fixed it, and turns_before.

    Rows are functions of a state: fixed is the state they end in whatever it was before, or null where they keep it or, with turns = 1, turn it.
    """
    along = Window.partitionBy(*by).orderBy(order)
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    counted = df.withColumn("_turns", F.sum("turns").over(along))
    last = F.last(F.when(F.col("fixed").isNotNull(), F.struct("fixed", "_turns")), ignorenulls=True).over(earlier)
    seen = counted.withColumn("_last", last).withColumn("turns_before", F.col("_turns") - F.col("turns"))
    fixed = (F.col("_last.fixed") + F.col("turns_before") - F.col("_last._turns")) % 2
    return seen.withColumn("fixed_before", fixed).drop("_last", "_turns")


def whole_records(lines: DataFrame) -> DataFrame:
    """Lines (file, block, position, line) as records of the same columns: the block in which a record starts, and its place among those that start there.

    Lines are read once: each tells how many records have started in its split so far, for a split that starts outside quotes and for one
    that starts inside. The splits, a row each, then tell which holds and to what record the lines before the first start belong.
    """
    outside, inside = _ends_inside(F.col("line"), False).cast("int"), _ends_inside(F.col("line"), True).cast("int")
    # positions are numbers of the scan, so they are fixed before anything is shuffled
    functions = lines.select("file", "block", "position", "line", outside.alias("_outside"), inside.alias("_inside")).select(
        "file", "block", "position", "line",
        F.when(F.col("_outside") == F.col("_inside"), F.col("_outside")).alias("fixed"),
        F.when(F.col("_outside") > F.col("_inside"), 1).otherwise(0).alias("turns"),
    )
    in_split = _state_before(functions, ["file", "block"], "position")
    so_far = Window.partitionBy("file", "block").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    started = [
        F.count_if(F.coalesce("fixed_before", F.lit(start) + F.col("turns_before")) % 2 == 0).over(so_far).alias(f"started_{start}") for start in (0, 1)
    ]
    after = F.when(F.col("fixed").isNotNull(), F.col("fixed")).otherwise((F.col("fixed_before") + F.col("turns")) % 2)
    turned = F.col("turns_before") + F.col("turns")
    in_split = stage(in_split.select("file", "block", "position", "line", after.alias("fixed"), turned.alias("turns"), *started), "lines-in-split")
    splits = in_split.groupBy("file", "block").agg(
        F.max_by("fixed", "position").alias("fixed"),
        F.max("turns").alias("turns"),
        *[F.max(f"started_{start}").alias(f"started_{start}") for start in (0, 1)],
    )
    # turns count only where no line of the split fixes the state
    splits = splits.withColumn("turns", F.when(F.col("fixed").isNotNull(), 0).otherwise(F.col("turns") % 2))
    starts = _state_before(splits, ["file"], "block").withColumn("start", F.coalesce("fixed_before", F.col("turns_before")) % 2)
    starts = starts.withColumn("started", F.when(F.col("start") == 0, F.col("started_0")).otherwise(F.col("started_1")))
    # a line before the first start of its split belongs to the last record of the splits before
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("started") > 0, F.struct(F.col("block").alias("first_block"), F.col("started").alias("nth"))), ignorenulls=True)
    starts = stage(starts.select("file", "block", "start", last.over(before).alias("carried")), "split-starts")
    nth = F.when(F.col("start") == 0, F.col("started_0")).otherwise(F.col("started_1"))
    own = F.when(nth > 0, F.struct(F.col("block").alias("first_block"), nth.alias("nth")))
    owned = in_split.join(small_side(starts), ["file", "block"]).withColumn("record", F.coalesce(own, "carried"))
    ordered = F.sort_array(F.collect_list(F.struct("block", "position", "line")))
    grouped = owned.groupBy("file", "record.first_block", "record.nth").agg(ordered.alias("lines"))
    text = F.array_join(F.transform("lines", lambda part: part["line"]), "\n")
    return grouped.select("file", F.col("first_block").alias("block"), (F.col("nth") - 1).cast("long").alias("position"), text.alias("line"))


def raw_rows(records: DataFrame, fields: Column) -> DataFrame:
    """Raw activity rows and their source_file from records; the header is the first record of a file. A value that does not fit is NULL."""
    is_header = (F.col("block") == 0) & F.col("header_like")
    names = F.transform(F.col("fields"), lambda field: F.trim(field))
    marked = records.withColumn("fields", fields).withColumn("header_like", names == F.array(*[F.lit(n) for n in S.RAW_COLUMNS]))
    texts = [F.try_element_at("fields", F.lit(i + 1)) for i in range(len(S.RAW_SCHEMA))]
    # a blank number is not cast, which costs an exception each
    texts = [F.nullif(text, F.lit("")) if f.name in S.RAW_MEASURES else text for text, f in zip(texts, S.RAW_SCHEMA, strict=True)]
    values = [text.try_cast(f.dataType).alias(f.name) for text, f in zip(texts, S.RAW_SCHEMA, strict=True)]
    return marked.where(~is_header).select(*values, F.col("file").alias("source_file"))
