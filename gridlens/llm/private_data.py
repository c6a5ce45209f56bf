"""Personal data in texts, replaced by keyed surrogates of the same type, gender, script and format.

Found: email addresses, phone numbers (marked by +, brackets or a leading 0, in groups that begin with three digits, or after a word such as "tel"), IPv4
addresses, payment cards (Luhn), IBANs (mod 97), social security numbers, and names: after a title or a known given name, in any white space and in
capitals too, and the family name of such a name wherever it comes up again in the text. Where finds overlap, the kind that is listed first in KINDS counts.
Untitled names with other given names, and names in scripts without a list of given names, are not found.

The same value, however it is written, has the same surrogate in all documents, and different values have different ones: the
surrogate is a keyed permutation of all values of the format (surrogates.py). What a permutation cannot know is whether a surrogate
is some other document's real value. So all different values are gathered in a table and checked: a value whose surrogate is real, or
was already given to another, gets a surrogate by the next permutation, and in the end of a larger format, until none is left. These few exceptions go with the documents that need
them, by a join on the hash of the text, whatever their number.

Null texts stay null, empty ones empty. Whole texts are searched. Equal rows are rewritten alike. An empty table gives an empty table.
"""

import re
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import takewhile

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from gridlens.llm import surrogates
from gridlens.llm.common import small_batches, to_batches, unused_name
from gridlens.operators.joins import small_side
from gridlens.session import stage

KINDS = ["email", "iban", "card", "ip", "ssn", "phone", "name"]
FOUND = ArrayType(
    StructType(
        [
            StructField("kind", StringType()),
            StructField("start", IntegerType()),
            StructField("end", IntegerType()),
            StructField("surrogate", StringType()),
        ]
    )
)

# the local part of an address is looked for backwards from its @, so a long run of such characters is passed once
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
CARD = re.compile(r"(?<![\w.+-])[0-9](?:[ -]?[0-9]){12,18}(?![\w-])")
IP = re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?!\w|\.[0-9])")
SSN = re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")
PHONE = re.compile(
    r"(?<![\w.])(?:(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}|\+[0-9]{8,15})(?![\w-])"
)
#: Digits that a phone number has at least and at most.
PHONE_DIGITS = range(7, 16)
# Words before phone numbers, and between two of them
CUES = "Call Cell Fax Handy Mobile Mobil Móvil Phone Ph Tel Telefon Telephone Teléfono Tél Téléphone call cell fax handy mobile mobil móvil phone tel telefon telephone teléfono tél téléphone".split()
NUMBER = r"\+?\(?[0-9](?:[ ().-]{0,2}[0-9]){4,16}(?![\w-])"
CUED = re.compile(rf"(?<!\w)(?:{'|'.join(CUES)})\b[.:]?[^\S\n]{{0,3}}({NUMBER})(?:[^\S\n]{{1,3}}(?:or|and|oder|und|ou|et|o|y|/)[^\S\n]{{1,3}}({NUMBER}))?")
HAS_CUE = re.compile(rf"(?:{'|'.join(CUES)})\b")
# Titles before names
TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Señor Señora Monsieur Madame Mme господин госпожа г-н г-жа κύριος κυρία".split()
GAP = r"[^\S\n]{1,3}"
WORD = r"[^\W\d_][^\W\d_]+"
TITLED = re.compile(rf"(?<!\w)(?:{'|'.join(TITLES)})\.?{GAP}({WORD}(?:{GAP}{WORD})?)")
GIVEN_NAMES = sorted({form for names in surrogates.GIVEN.values() for n in names for form in (n, n.upper())})
PAIR = re.compile(rf"(?<!\w)(?:{'|'.join(GIVEN_NAMES)}){GAP}{WORD}")
HAS_NAME = re.compile(rf"(?:{'|'.join(GIVEN_NAMES)})\s")
HAS_TITLE = re.compile("|".join(rf"{t}\b" for t in TITLES))
DIGITS = re.compile("[0-9][0-9 .()-]{5,}[0-9]")
#: Letters that a family name has at least to be looked for alone.
FAMILY_LETTERS = 3


def emails(text: str) -> list[tuple[int, int]]:
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        before = text[free:at]
        start = at - len(before) + len(before.rstrip(LOCAL))
        start = at - len(text[start:at].lstrip("._%+-"))
        domain = DOMAIN.match(text, at + 1) if start < at and text[at - 1] not in ".%+-" else None
        if domain:
            found.append((start, domain.end()))
        free = domain.end() if domain else at + 1
        at = text.find("@", free)
    return found


def is_phone(number: str) -> bool:
    """Whether a number in groups is no mere list of numbers: marked as one, or with a first group of three digits."""
    digits = sum(c.isdigit() for c in number)
    marked = number[0] in "+(0" or "(" in number
    return digits in PHONE_DIGITS and (marked or len(re.match("[0-9]*", number)[0]) == 3)


def _as_names(matches: Iterator[re.Match], group: int) -> Iterator[tuple[int, int, str]]:
    """The words of each match from the first on that can be parts of names: capitals, or of a script without them."""
    for m in matches:
        words = list(re.finditer(r"\S+", m[group]))
        named = list(takewhile(lambda w: not w[0][0].islower(), words))
        if named and (group or len(named) > 1):
            yield m.start(group), m.start(group) + named[-1].end(), "name"


def finds(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), in order and without overlaps. Each pattern runs behind a gate that it implies."""
    found = [(start, end, "email") for start, end in emails(text)]
    if DIGITS.search(text):
        for m in IBAN.finditer(text):
            if surrogates.iban_rest(surrogates.plain_form("iban", m[0])) == 1:
                found.append((m.start(), m.end(), "iban"))
        for m in CARD.finditer(text):
            if surrogates.luhn(surrogates.plain_form("card", m[0])):
                found.append((m.start(), m.end(), "card"))
        found += [(m.start(), m.end(), kind) for kind, pattern in (("ip", IP), ("ssn", SSN)) for m in pattern.finditer(text)]
    if "+" in text or DIGITS.search(text):
        found += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if is_phone(m[0])]
    if HAS_CUE.search(text):
        for m in CUED.finditer(text):
            found += [(m.start(g), m.end(g), "phone") for g in (1, 2) if m[g] and sum(c.isdigit() for c in m[g]) in PHONE_DIGITS]
    names = []
    if HAS_TITLE.search(text):
        names += _as_names(TITLED.finditer(text), 1)
    if HAS_NAME.search(text):
        names += _as_names(PAIR.finditer(text), 0)
    # a family name stands for the person wherever it comes up again
    families = {text[start:end].split()[-1] for start, end, _ in names if len(text[start:end].split()) > 1}
    families = sorted(f for f in families if len(f) >= FAMILY_LETTERS)
    if families:
        again = re.compile(rf"(?<!\w)(?:{'|'.join(map(re.escape, families))})(?!\w)")
        names += [(m.start(), m.end(), "name") for m in again.finditer(text)]
    kept: list[tuple[int, int, str]] = []
    taken: set[int] = set()
    for start, end, kind in sorted(found + names, key=lambda f: (KINDS.index(f[2]), -(f[1] - f[0]) if f[2] == "name" else 0, f[0], -f[1])):
        if taken.isdisjoint(range(start, end)):
            taken.update(range(start, end))
            kept.append((start, end, kind))
    return sorted(kept)


@lru_cache(maxsize=4)
def replacer(key: bytes) -> surrogates.Replacer:
    return surrogates.Replacer(key)


def mentions(df: DataFrame, secret: bytes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, kind, value, surrogate) once for each value of a document, by the first permutation."""
    small_batches(df.sparkSession)
    narrow = df.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = replacer(secret)
        for batch in batches:
            schema = pa.schema([batch.schema.field(0), *((n, pa.string()) for n in ("kind", "value", "surrogate"))])

            def rows(batch=batch):
                for name, whole in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if whole:
                        values = {(kind, surrogates.plain_form(kind, whole[a:b])) for a, b, kind in finds(whole)}
                        yield from ((name, kind, value, own.replace(kind, value)) for kind, value in sorted(values))

            yield from to_batches(rows(), schema)

    return narrow.mapInArrow(run, f"key {narrow.schema['key'].dataType.simpleString()}, kind string, value string, surrogate string")


def exceptions(values: DataFrame, secret: bytes) -> DataFrame:
    """(kind, value, surrogate) where the first surrogate is a real value or another's surrogate.

    values: (kind, value, surrogate), one row for each value. The first look at all surrogates leaves the few that clash; later rounds carry only
    these and ask which of their new surrogates are real or taken. Formats grow with the attempt, so the rounds end.
    """
    columns = ["kind", "value", "attempt", "surrogate"]

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = replacer(secret)
        for batch in batches:
            kinds, plain, attempts, _ = (c.to_pylist() for c in batch.columns)
            made = [own.replace(k, v, a + 1) for k, v, a in zip(kinds, plain, attempts, strict=True)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([a + 1 for a in attempts], pa.int32()), pa.array(made, pa.string())], names=columns)

    def judged(rows: DataFrame, taken: DataFrame) -> DataFrame:
        """rows with clashes: the surrogate is that of an earlier row, or among taken (of, used)."""
        nth = F.row_number().over(Window.partitionBy("kind", "surrogate").orderBy("attempt", "value"))
        marked = rows.select(*columns, nth.alias("nth"))
        marked = marked.join(taken.distinct(), (F.col("kind") == F.col("of")) & (F.col("surrogate") == F.col("used")), "left")
        return stage(marked.select(*columns, ((F.col("nth") > 1) | F.col("used").isNotNull()).alias("clashes")), "surrogates")

    real = values.select(F.col("kind").alias("of"), F.col("value").alias("used"))
    first = judged(values.select("kind", "value", F.lit(0).alias("attempt"), "surrogate"), real)
    settled, current = [first.where("NOT clashes").select(*columns)], first.where("clashes").select(*columns)
    while not current.isEmpty():
        changed = stage(current.mapInArrow(again, "kind string, value string, attempt int, surrogate string"), "changed-surrogates")
        # only surrogates that the changed rows ask for are looked up
        taken = reduce(DataFrame.unionByName, [real, *(s.select(F.col("kind").alias("of"), F.col("surrogate").alias("used")) for s in settled)])
        asked = changed.select(F.col("kind").alias("of"), F.col("surrogate").alias("used")).distinct()
        marked = judged(changed, taken.join(small_side(asked), ["of", "used"], "left_semi"))
        settled.append(marked.where("NOT clashes").select(*columns))
        current = marked.where("clashes").select(*columns)
    return reduce(DataFrame.unionByName, settled).where("attempt > 0").select("kind", "value", "surrogate")


def replace_private(df: DataFrame, secret: bytes, text: str = "text", entities: str | None = None) -> DataFrame:
    """df with its text rewritten, and if wanted a column of (kind, start, end, surrogate), positions in the old text."""
    small_batches(df.sparkSession)
    # a text stands for its rows: values and what becomes of them depend on nothing else
    digest = F.xxhash64(F.col(f"`{text}`"))
    seen = stage(mentions(df.select(digest.alias("key"), F.col(f"`{text}`").alias("text")), secret, "key", "text").distinct(), "mentions")
    values = stage(seen.select("kind", "value", "surrogate").distinct(), "private-values")
    odd = exceptions(values, secret).select(F.col("kind").alias("k"), F.col("value").alias("v"), F.col("surrogate").alias("s"))
    own = seen.join(odd, (F.col("kind") == F.col("k")) & (F.col("value") == F.col("v")))
    by_document = own.groupBy("key").agg(F.collect_set(F.struct("kind", "value", "s")).alias("changed"))
    by_document = stage(by_document, "surrogate-exceptions")
    named = {n: unused_name(df, n) for n in ("exception key", "changed", "rewritten", "found")}
    by_document = by_document.select(F.col("key").alias(named["exception key"]), F.col("changed").alias(named["changed"]))
    joined = df.join(small_side(by_document), digest == F.col(named["exception key"]), "left").drop(named["exception key"])
    others = [c for c in df.columns if c != text]
    # the other columns travel in one value, so their names and types do not matter
    arranged = joined.select(F.struct(*(F.col(f"`{c}`") for c in others)).alias("others"), F.col(text).alias("text"), F.col(named["changed"]).alias("changed"))
    entity = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("surrogate", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replacing = replacer(secret)
        for batch in batches:
            texts, lists = [], []
            for whole, changed in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                special = {(c["kind"], c["value"]): c["s"] for c in changed or ()}
                parts, at, listed = [], 0, []
                for start, end, kind in finds(whole) if whole else ():
                    value = surrogates.plain_form(kind, whole[start:end])
                    made = special.get((kind, value)) or replacing.replace(kind, value)
                    made = surrogates.written_like(kind, whole[start:end], made)
                    parts += [whole[at:start], made]
                    at = end
                    listed.append({"kind": kind, "start": start, "end": end, "surrogate": made})
                texts.append("".join([*parts, whole[at:]]) if whole else whole)
                lists.append(listed)
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string()), pa.array(lists, pa.list_(entity))], names=["others", "text", "found"])

    schema = StructType([arranged.schema["others"], StructField("text", StringType()), StructField("found", FOUND)])
    made = arranged.mapInArrow(run, schema)
    columns = [F.col("text").alias(text) if c == text else F.col("others")[c].alias(c) for c in df.columns]
    return made.select(*columns, *([F.col("found").alias(entities)] if entities else []))


def op5_surrogates(docs: DataFrame, secret: bytes = b"surrogates of the documents") -> DataFrame:
    made = replace_private(docs.select("doc_id", "text"), secret, entities="entities")
    return made.select("doc_id", "text", F.size("entities").cast("long").alias("n_entities"), "entities")
