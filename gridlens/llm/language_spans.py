"""Language of a text and of its parts: scripts, scores of words, and the best path with a penalty for each switch.

A word is a run of letters, lower-cased. The script of its first letter leaves the languages in which that script was
seen in training; their scores are sums of log-probabilities of character n-grams with word ends marked, looked up in a table by
a hash. Viterbi's
algorithm labels every word, paying `penalty` wherever the language changes, which gives spans of one language each.
A text's language is the one whose spans hold most letters, ties to the lower code point; its score is their share of all letters.
Letters of a script that no learned language uses belong to their neighbours' span but count for none.

A null text, or one without letters, is `und` with score 0. With nothing to learn from every text is `und`. Whole texts
are read. Training reads a sample, `per_language` documents of each language in expectation, chosen by a hash
of doc_id, and counts n-grams in BUCKETS buckets, so the model that is sent to the tasks has a fixed bound.
Documents without doc_id are neither learned from nor held out. Equal rows get equal results; an empty table gives an empty table.
"""

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from gridlens.llm.common import small_batches, to_batches

UNKNOWN = "und"
KEPT_WORDS = 200_000
#: Words that are labelled together, and words of a text from which on it is labelled alone.
GROUP_WORDS = 400_000
LONG = 2000
IMPOSSIBLE = -1e6

SPAN = StructType([StructField("lang", StringType()), StructField("first_word", IntegerType()), StructField("words", IntegerType())])
OUTPUTS = [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("spans", ArrayType(SPAN))]

LETTERS = re.compile(r"[^\W\d_]+")

# First and last code points of the letters of scripts
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2FA1F)],
}


# first code point of each range and the number of its script, with gaps between ranges as script 0
_RANGES = sorted((lo, hi, n) for n, ranges in enumerate(SCRIPTS.values(), 1) for lo, hi in ranges)
_EDGES = np.array([e for lo, hi, _ in _RANGES for e in (lo, hi + 1)])
_SCRIPT_AT = np.array([0, *(n for _, _, number in _RANGES for n in (number, 0))])
BUCKETS = 1 << 16
START, END = "\x02", "\x03"


def words_of(text: str | None) -> list[str]:
    return LETTERS.findall(text.lower()) if text else []


def has_letter(word: str) -> bool:
    """Number signs are matched as well, but are no letters."""
    return word.isalpha() or any(c.isalpha() for c in word)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For words one after the other with their ends marked: the buckets of the 1-, 2- and 3-grams that start at each character
    (BUCKETS where there is none), the first character of each word, and the script of each word."""
    joined = START + (END + START).join(words) + END
    codes = np.frombuffer(joined.encode("utf-32-le"), "<u4").astype(np.uint64)
    ends = codes == ord(END)
    starts = np.flatnonzero(codes == ord(START))
    buckets = np.full((len(codes), 3), BUCKETS, np.int32)
    mixed, inside = np.zeros(len(codes), np.uint64), np.ones(len(codes), bool)
    for n in range(3):
        last = len(codes) - n
        mixed = (mixed[:last] + codes[n:] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        buckets[:last, n] = np.where(inside[:last], (mixed ^ (mixed >> np.uint64(32))) & np.uint64(BUCKETS - 1), BUCKETS)
        inside[:last] &= ~ends[n:]
    scripts = _SCRIPT_AT[np.searchsorted(_EDGES, codes[starts + 1].astype(np.int64), side="right")]
    return buckets, starts, scripts


@dataclass
class Model:
    """What training leaves: log-probabilities of each bucket and, for each script (0: none that is listed), its languages."""

    languages: list[str]
    log_probabilities: np.ndarray  # the last row is zero
    by_script: np.ndarray
    penalty: float = 8.0


class Labeller:
    """Scores words by the model, keeping the scores of words met, and labels texts."""

    def __init__(self, model: Model):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.rows: dict[str, int] = {}
        n = len(self.model.languages)
        self.scores, self.letters = np.zeros((0, n), np.float32), np.zeros(0, np.int64)

    def _learn(self, words: list[str]) -> None:
        """Scores of new words; words without letters, and of scripts that no language has, score nothing and weigh nothing."""
        buckets, starts, scripts = features(words)
        each = sum(self.model.log_probabilities[buckets[:, n]] for n in range(3))
        scores = np.add.reduceat(each, starts, axis=0) / 2
        allowed = self.model.by_script[scripts]
        usable = allowed.any(axis=1) & np.fromiter(map(has_letter, words), bool, len(words))
        scores = np.where(usable[:, None], np.where(allowed, scores, IMPOSSIBLE), 0)
        letters = np.where(usable, np.fromiter(map(len, words), np.int64, len(words)), 0)
        self.rows.update(zip(words, range(len(self.rows), len(self.rows) + len(words)), strict=True))
        self.scores = np.concatenate([self.scores, scores.astype(np.float32)])
        self.letters = np.concatenate([self.letters, letters])

    def label(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The language number of each word of each text."""
        if len(self.rows) > KEPT_WORDS:
            self._forget()
        new = dict.fromkeys(w for words in texts for w in words)
        new = [w for w in new if w not in self.rows]
        if new:
            self._learn(new)
        self.found = [np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words)) for words in texts]
        labels: list[np.ndarray] = [np.zeros(0, np.int8)] * len(texts)
        short = [i for i, rows in enumerate(self.found) if 0 < len(rows) <= LONG]
        for i, path in zip(short, self._together([self.found[i] for i in short]), strict=True):
            labels[i] = path
        for i, rows in enumerate(self.found):
            if len(rows) > LONG:
                own = self.scores[rows]
                labels[i] = self._one_language(own)
                if labels[i] is None:
                    labels[i] = self._alone(own.tolist())
        return labels

    def _one_language(self, scores: np.ndarray) -> np.ndarray | None:
        """The path of one language throughout if no other path can be better: no stretch gains as much by other languages as
        one switch costs."""
        best = int(scores.sum(axis=0).argmax())
        if scores.shape[1] > 1:
            gain = np.cumsum(np.delete(scores, best, axis=1).max(axis=1) - scores[:, best], dtype=np.float64)
            before = np.minimum.accumulate(np.concatenate([[0.0], gain[:-1]]))
            if (gain - before).max() > self.model.penalty:
                return None
        return np.full(len(scores), best, np.int8)

    def _alone(self, scores: list[list[float]]) -> np.ndarray:
        penalty, best, back = self.model.penalty, scores[0], []
        for own in scores[1:]:
            top = max(best)
            switched = top - penalty
            back.append((best.index(top), [b >= switched for b in best]))
            best = [(b if b >= switched else switched) + s for b, s in zip(best, own, strict=True)]
        state = best.index(max(best))
        path = [state]
        for top, stays in reversed(back):
            if not stays[state]:
                state = top
            path.append(state)
        return np.array(path[::-1], np.int8)

    def _together(self, texts: list[np.ndarray]) -> list[np.ndarray]:
        """All texts in step, the longest first, so those that still have words are always the first ones."""
        if not texts:
            return []
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        lengths = np.array([len(texts[i]) for i in order])
        steps = int(lengths[0])
        active = np.searchsorted(-lengths, -np.arange(steps), side="left")
        firsts = np.concatenate([[0], np.cumsum(active)])
        place = np.empty(int(firsts[-1]), np.int64)
        for rank, i in enumerate(order):
            place[firsts[: len(texts[i])] + rank] = texts[i]
        emitted = self.scores[place]
        n = emitted.shape[1]
        back = np.empty(emitted.shape, np.int8)
        best, own = emitted[: active[0]].copy(), np.arange(n, dtype=np.int8)
        for t in range(1, steps):
            a, at = active[t], firsts[t]
            before = best[:a]
            switched = before.max(axis=1) - np.float32(self.model.penalty)
            stays = before >= switched[:, None]
            back[at : at + a] = np.where(stays, own, before.argmax(axis=1)[:, None])
            best[:a] = np.where(stays, before, switched[:, None]) + emitted[at : at + a]
        state = best.argmax(axis=1)
        labels = np.empty(len(place), np.int8)
        for t in range(steps - 1, -1, -1):
            a, at = active[t], firsts[t]
            labels[at : at + a] = state[:a]
            if t:
                state[:a] = back[at : at + a][np.arange(a), state[:a]]
        paths: list[np.ndarray] = [labels] * len(texts)
        for rank, i in enumerate(order):
            paths[i] = labels[firsts[: len(texts[i])] + rank]
        return paths

    def results(self, texts: list[str | None]) -> list[tuple]:
        """(language, score, spans) of each text; a span is its language, its first word and its number of words."""
        return [r[:3] for r in self.results_and_shares(texts)]

    def results_and_shares(self, texts: list[str | None]) -> list[tuple]:
        """(language, score, spans, share of all letters that count for any learned language) of each text."""
        words = [words_of(t) for t in texts]
        if not self.model.languages:
            return [(UNKNOWN, 0.0, [], 0.0) for _ in texts]
        out, names = [], self.model.languages
        for own, path, rows in zip(words, self.label(words), self.found, strict=True):
            if not any(map(has_letter, own)):
                out.append((UNKNOWN, 0.0, [], 0.0))
                continue
            letters = np.bincount(path, weights=self.letters[rows], minlength=len(names))
            best, total = int(letters.argmax()), sum(map(len, own))
            starts = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)]
            spans = [{"lang": names[path[a]], "first_word": a, "words": b - a} for a, b in zip(starts, starts[1:], strict=False)]
            out.append((names[best], float(letters[best] / total), spans, float(letters.sum() / total)))
        return out


def held_out(key: str = "doc_id") -> Column:
    """Whether a document is kept from training: CRC-32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, per_language: int = 1500, penalty: float = 8.0) -> Model:
    """Learns from text and lang of documents that are not held out."""
    small_batches(docs.sparkSession)
    usable = docs.where(F.col("doc_id").isNotNull() & ~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    # one row for each language
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    number = {name: i for i, name in enumerate(languages)}
    table = np.full((BUCKETS + 1, len(languages)), 0.5)
    words_by_script = np.zeros((len(SCRIPTS) + 1, len(languages)))
    if languages:
        draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("language")), F.lit(1 << 30))
        limit = F.lit(0)
        for language, n in sizes.items():
            limit = F.when(F.col("lang") == language, int((1 << 30) * min(1.0, per_language / n))).otherwise(limit)
        # at most a row for each language and bucket or script
        for row in _counts(usable.where(draw < limit).select("lang", "text")).collect():
            of = words_by_script if row["is_script"] else table
            of[row["place"], number[row["lang"]]] += row["n"]
    log_probabilities = np.log(table / table[:BUCKETS].sum(axis=0)).astype(np.float32)
    log_probabilities[BUCKETS] = 0
    # a script is a language's own from one word in a hundred on
    own = words_by_script >= np.maximum(0.01 * words_by_script.sum(axis=0), 1)
    return Model(languages, log_probabilities, own, penalty)


def _counts(sample: DataFrame) -> DataFrame:
    """(lang, is_script, place, n): occurrences of each bucket, and words of each script."""
    schema = pa.schema([("lang", pa.string()), ("is_script", pa.bool_()), ("place", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = [w for w in words_of(text) if has_letter(w)]
                if words:
                    seen, scripts = held.setdefault(lang, (np.zeros(BUCKETS + 1, np.int64), np.zeros(len(SCRIPTS) + 1, np.int64)))
                    buckets, _, own = features(words)
                    seen += np.bincount(buckets.ravel(), minlength=BUCKETS + 1)
                    scripts += np.bincount(own, minlength=len(SCRIPTS) + 1)

        def rows():
            for lang, both in held.items():
                for is_script, counts in enumerate(both):
                    for place in np.flatnonzero(counts[: BUCKETS if not is_script else None]).tolist():
                        yield lang, bool(is_script), place, int(counts[place])

        yield from to_batches(rows(), schema)

    counts = sample.mapInArrow(count, "lang string, is_script boolean, place int, n long")
    return counts.groupBy("lang", "is_script", "place").agg(F.sum("n").alias("n"))


def predict(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, share: str | None = None) -> DataFrame:
    """The kept columns (all by default) with lang_pred, score and spans of every row, from the text alone.

    Kept columns of these three names make way for the new ones. share names a column for the share of letters in all learned languages.
    """
    spark = small_batches(df.sparkSession)
    sent = spark.sparkContext.broadcast(model)
    own = [c for c in (df.columns if keep is None else keep) if c.lower() not in ("lang_pred", "score", "spans")]
    narrow = df.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("kept"), F.col(f"`{text}`").alias("text"))
    span = pa.struct([("lang", pa.string()), ("first_word", pa.int32()), ("words", pa.int32())])
    types = [pa.string(), pa.float64(), pa.list_(span), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(sent.value)
        waiting: list[pa.RecordBatch] = []

        def labelled() -> Iterator[pa.RecordBatch]:
            texts = [t for batch in waiting for t in batch.column(1).to_pylist()]
            results, at = labeller.results_and_shares(texts), 0
            for batch in waiting:
                part = list(zip(*results[at : at + batch.num_rows], strict=True))
                at += batch.num_rows
                made = [pa.array(c, t) for c, t in zip(part, types, strict=True)]
                yield pa.record_batch([batch.column(0), *made], names=["kept", "lang_pred", "score", "spans", "share"])

        for batch in batches:
            if batch.num_rows:
                waiting.append(batch)
            if sum(b.column(1).nbytes for b in waiting) // 6 >= GROUP_WORDS:
                yield from labelled()
                waiting = []
        yield from labelled()

    schema = StructType([narrow.schema["kept"], *OUTPUTS, StructField("share", DoubleType())])
    made = narrow.mapInArrow(run, schema)
    return made.select(*(F.col("kept")[c].alias(c) for c in own), "lang_pred", "score", "spans", *([F.col("share").alias(share)] if share else []))


def op9_language_spans(docs: DataFrame) -> DataFrame:
    found = predict(docs, train(docs), keep=["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))
