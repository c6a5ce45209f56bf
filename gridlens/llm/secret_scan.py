"""Secrets: three known shapes, and strings that look random by a battery of tests, found with SQL functions only.

Known shapes: `assign` (a name such as password, a sign, a value), `access` (access key ids) and `hex` (long hexadecimal strings).

`random`: candidates are maximal runs of the base-64 alphabets, MIN_LENGTH characters or more. The characters in a
candidate tell its encoding (the first of ENCODINGS that has them all), and with it an alphabet of k characters.
Two questions are asked of each:
* Is it consistent with uniform independent characters? Chi-squared of the counts, runs above and below the middle of the
  alphabet, and the correlation of neighbours, each at level LEVEL / 3; failing one drops the candidate.
* How far is it from ordinary words? Words repeat their frequent letters, so chi-squared would exceed its mean by length * (k *
  repeat rate - 1); and they seldom change between capitals, small letters, digits and signs. Both distances, in
  standard deviations that depend on the length, add up to one score. Short strings score low however odd they are.
The candidates of a length band are one family: Benjamini and Hochberg's procedure keeps the expected share of ordinary
words among what is reported below FALSE_SHARE. Scores are counted in bins of 1/100, so the family's ranks need one
small table: bands times bins rows, whatever the input.

Positions are code points, ends exclusive. Only lengths and candidates leave the scan of the texts; positions are running
sums over the lengths between matches. Null and empty texts have no spans. Equal rows are kept apart. An empty table gives an empty table.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlens.session import prepare, stage

# Shapes of known secrets, with the least length of the value or the match
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 6
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
KINDS = ["assign", "access", "hex", "random"]

MIN_LENGTH = 20
CANDIDATE = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{MIN_LENGTH},}}"
DIGITS, SMALL, CAPITALS = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Alphabet of each encoding, and the chance that two letters of words in that alphabet are equal
ENCODINGS = [
    ("decimal", DIGITS, 0.15),
    ("hex", DIGITS + "abcdef", 0.12),
    ("HEX", DIGITS + "ABCDEF", 0.12),
    ("small", SMALL, 0.065),
    ("capitals", CAPITALS, 0.065),
    ("base32", CAPITALS + "234567", 0.065),
    ("base36", DIGITS + SMALL, 0.065),
    ("BASE36", DIGITS + CAPITALS, 0.065),
    ("base62", CAPITALS + SMALL + DIGITS, 0.065),
    ("base64", CAPITALS + SMALL + DIGITS + "+/", 0.065),
    ("base64url", CAPITALS + SMALL + DIGITS + "-_", 0.065),
    ("mixed", CAPITALS + SMALL + DIGITS + "+/-_", 0.065),
]
#: How often neighbours in ordinary strings are of different kinds of characters.
CHANGE_RATE = 0.2
#: Least lengths of the bands.
BANDS = [20, 28, 40, 64, 128]
LEVEL = 0.003
FALSE_SHARE = 0.01
BIN = 100


def upper_tail(z: Column) -> Column:
    """P(Z > z) of the normal distribution, a rational approximation for z >= 0 and its mirror image below."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    series = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-z * z / 2) / 2.5066282746310002 * series
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _matches(text: Column, pattern: str, value_group: int | None = None, keep_text: bool = False) -> Column:
    """For each match: code points since the last one, its length, the length of a group, and the match itself if wanted."""
    between = F.transform(F.split(text, pattern, -1), F.length)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group or 0))
    zipped = F.arrays_zip(
        between.alias("gap"),
        F.transform(found, F.length).alias("length"),
        F.transform(value, F.length).alias("value"),
        (found if keep_text else F.transform(found, lambda _: F.lit(None).cast("string"))).alias("match"),
    )
    # what follows the last match has a gap only
    return F.when(text.rlike(pattern), F.filter(zipped, lambda m: m["length"].isNotNull()))


def _statistics(candidates: DataFrame) -> DataFrame:
    """encoding, k, score and is_random of column match."""
    body = F.regexp_replace("match", "=+$", "")
    encoding = F.lit(None)
    for name, alphabet, equal in reversed(ENCODINGS):
        pattern = "^[" + alphabet.replace("-", r"\-").replace("/", r"\/").replace("+", r"\+") + "]*$"
        value = F.struct(F.lit(name).alias("name"), F.lit(alphabet).alias("alphabet"), F.lit(equal).alias("equal"))
        encoding = value if name == "mixed" else F.when(F.col("body").rlike(pattern), value).otherwise(encoding)
    df = candidates.withColumn("body", body).withColumn("encoding", encoding)
    df = df.withColumn("n", F.length("body").cast("double")).withColumn("k", F.length("encoding.alphabet").cast("double"))
    df = df.withColumn("chars", F.filter(F.split("body", ""), lambda c: c != ""))
    df = df.withColumn("code", F.transform("chars", lambda c: F.instr(F.col("encoding.alphabet"), c).cast("double")))
    kind = lambda c: F.when(c.between("0", "9"), 0).when(c.between("A", "Z"), 1).when(c.between("a", "z"), 2).otherwise(3)
    df = df.withColumn("kind_of", F.transform("chars", kind))

    def pairs(column: str, value) -> Column:
        here, there = F.col(column), F.slice(F.col(column), F.lit(2), F.size(column))
        return F.zip_with(F.slice(here, F.lit(1), F.size(column) - 1), there, value)

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)

    counts = F.transform(F.array_distinct("chars"), lambda c: (F.col("n") - F.length(F.replace(F.col("body"), c, F.lit("")))).cast("double"))
    df = df.withColumn("chi", F.col("k") / F.col("n") * total(F.transform(counts, lambda c: c * c)) - F.col("n"))
    df = df.withColumn("above", F.transform("code", lambda c: (c > F.col("k") / 2).cast("double")))
    df = df.withColumn("runs", 1 + total(pairs("above", lambda a, b: F.abs(a - b))))
    df = df.withColumn("changes", total(pairs("kind_of", lambda a, b: (a != b).cast("double"))))
    df = df.withColumn("spread", (F.col("k") * F.col("k") - 1) / 12)
    centre = (F.col("k") + 1) / 2
    df = df.withColumn("beside", total(pairs("code", lambda a, b: (a - centre) * (b - centre))))
    n, k, free = F.col("n"), F.col("k"), F.col("k") - 1
    # under uniform independent characters
    odd_counts = (F.cbrt(F.col("chi") / free) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
    odd_runs = F.abs(F.col("runs") - (1 + (n - 1) / 2)) / F.sqrt((n - 1) / 4)
    odd_neighbours = F.abs(F.col("beside")) / F.col("spread") / F.sqrt(n - 1)
    least = F.least(upper_tail(odd_counts), 2 * upper_tail(odd_runs), 2 * upper_tail(odd_neighbours))
    # under ordinary words
    excess = n * (k * F.col("encoding.equal") - 1)
    far_counts = (free + excess - F.col("chi")) / F.sqrt(2 * (free + 2 * excess))
    far_changes = (F.col("changes") - (n - 1) * CHANGE_RATE) / F.sqrt((n - 1) * CHANGE_RATE * (1 - CHANGE_RATE))
    usable = n >= MIN_LENGTH
    return df.withColumn("score", F.when(usable, (far_counts + far_changes) / F.sqrt(F.lit(2.0)))).withColumn(
        "is_random", F.when(usable, least >= LEVEL / 3).otherwise(False)
    )


def _band(length: Column) -> Column:
    band = F.lit(0)
    for least in BANDS:
        band = F.when(length >= least, least).otherwise(band)
    return band


def limits(scored: DataFrame) -> DataFrame:
    """The lowest bin of scores that is reported, for each band that has one."""
    counts = scored.groupBy("band", "bin").agg(F.count(F.lit(1)).alias("n"))
    from_top = Window.partitionBy("band").orderBy(F.desc("bin"))
    ranked = counts.withColumn("rank", F.sum("n").over(from_top)).withColumn("family", F.sum("n").over(Window.partitionBy("band")))
    passed = upper_tail(F.col("bin") / BIN) <= FALSE_SHARE * F.col("rank") / F.col("family")
    return ranked.where(passed).groupBy(F.col("band").alias("limit_band")).agg(F.min("bin").alias("limit_bin"))


def scan(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For every row: key, and spans, an array of (kind, start, end) by start, then kind in the order of KINDS."""
    prepare(df.sparkSession)
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(key).alias("key"), whole.alias("text")).withColumn("row", F.monotonically_increasing_id())
    lengths = rows.select(
        "row",
        "key",
        _matches(F.col("text"), ASSIGN, 2).alias("assign"),
        _matches(F.col("text"), ACCESS).alias("access"),
        _matches(F.col("text"), HEX).alias("hex"),
        _matches(F.col("text"), CANDIDATE, keep_text=True).alias("random"),
    )
    # the only scan of the texts; row numbers stay as written
    lengths = stage(lengths, "secret-lengths")
    found = None
    for number, kind in enumerate(KINDS):
        own = lengths.where(F.col(kind).isNotNull()).select("row", F.lit(number).alias("kind"), F.posexplode(kind).alias("place", "m"))
        found = own if found is None else found.unionByName(own)
    so_far = Window.partitionBy("row", "kind").orderBy("place")
    end = F.sum(F.col("m.gap") + F.col("m.length")).over(so_far)
    spans = found.withColumn("end", end).select(
        "row", "kind", (F.col("end") - F.col("m.length")).alias("start"), "end", F.col("m.value").alias("value"), F.col("m.match").alias("match")
    )
    base = spans.where((F.col("kind") < 3) & ((F.col("kind") > 0) | (F.col("value") >= ASSIGN_VALUE)))
    scored = _statistics(spans.where("kind = 3")).withColumn("band", _band(F.col("end") - F.col("start")))
    # beyond 30 deviations all are equally sure
    scored = scored.withColumn("bin", F.floor(F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("score"))) * BIN))
    scored = stage(scored.select("row", "kind", "start", "end", "band", "bin", "is_random"), "secret-candidates")
    lowest = limits(scored.where(F.col("bin").isNotNull()))
    # one row for each band
    passed = scored.join(F.broadcast(lowest), F.col("band") == F.col("limit_band"))
    random = passed.where(F.col("is_random") & (F.col("bin") >= F.col("limit_bin")))
    spans = base.select("row", "start", "kind", "end").unionByName(random.select("row", "start", "kind", "end"))
    gathered = spans.groupBy(F.col("row").alias("of")).agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))
    joined = lengths.select("row", "key").join(gathered, F.col("row") == F.col("of"), "left")
    name = F.array(*map(F.lit, KINDS))
    named = F.transform("spans", lambda s: F.struct(name[s["kind"]].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return joined.select(F.col("key").alias(key), F.coalesce(named, F.expr("cast(array() as array<struct<kind: string, start: bigint, end: bigint>>)")).alias("spans"))


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op10_secret_scan(docs: DataFrame) -> DataFrame:
    found = scan(docs)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(span_text(base).cast("binary"), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
    )
