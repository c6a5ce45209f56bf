"""Quality rules, lines first: lines that fail a rule are removed, then texts that lost too much are rejected.

Rules for a line with at least one word, the first that applies counts:
* punctuation: no letter; more than SYMBOL_SHARE symbols, or exclamation and question marks, for each word; or LONG_LINE words and
  no mark that ends or divides a sentence.
* navigation: MIN_SEPARATORS single separators or more between words, SEPARATOR_SHARE of the words at least; or a
  line that is no more than a menu entry.
* boilerplate: phrases of site footers, cookie notices and licences, in English, German, French or Spanish, that hold
  PHRASE_SHARE of its words or more. So an article in one line does not go for a phrase in it.

A text fails at first when it has fewer than MIN_WORDS words, or more than MAX_REPEATED of its words stand in 8-word windows that occur
twice or more in it. Otherwise it is kept unless its removed lines hold more than MAX_LOST of its word characters.
Null texts have no words. Whole texts are measured. Equal rows are kept apart; an empty table gives an empty table.
"""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens.llm.common import WHITE, small_batches, to_batches

WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED = 30  # percent
MAX_LOST = 0.5
SYMBOLS = "#*$%&|<>"
SYMBOL_SHARE = 0.5
LONG_LINE = 12
MIN_SEPARATORS, SEPARATOR_SHARE = 2, 0.2
PHRASE_SHARE = 0.1

# Marks, separators, menu entries and phrases
MARKS = re.compile("[.!?;:,…。！？、，؟।]")
SEPARATORS = {b"|", b">", b"<", b"/", b"-", "»".encode(), "·".encode(), "•".encode(), "–".encode()}
MENU = {
    "about", "about us", "back to top", "contact", "contact us", "home", "log in", "login", "menu", "next", "previous", "read more",
    "register", "search", "share", "sign in", "sign up", "site map", "sitemap", "skip to content", "subscribe", "top",
    "anmelden", "impressum", "kontakt", "mehr lesen", "nach oben", "startseite", "suche", "teilen", "weiterlesen", "über uns",
    "accueil", "connexion", "haut de page", "lire la suite", "partager", "plan du site", "précédent", "rechercher", "suivant", "à propos",
    "acerca de", "anterior", "buscar", "compartir", "contacto", "iniciar sesión", "inicio", "leer más", "siguiente", "volver arriba",
}
PHRASES = re.compile(
    "all rights reserved|accept cookies|we use cookies|cookie policy|privacy policy|terms of use|terms of service|terms and conditions"
    "|enable javascript|lorem ipsum|click here to|subscribe to our|sign up for our|follow us on|powered by|copyright ©|©"
    "|licensed under|released under the|spdx-license-identifier|permission is hereby granted"
    "|alle rechte vorbehalten|datenschutzerklärung|nutzungsbedingungen|wir verwenden cookies|cookies akzeptieren|javascript aktivieren"
    "|folgen sie uns auf|lizenziert unter"
    "|tous droits réservés|politique de confidentialité|mentions légales|conditions d'utilisation|nous utilisons des cookies"
    "|accepter les cookies|suivez-nous sur|sous licence"
    "|todos los derechos reservados|política de privacidad|aviso legal|condiciones de uso|términos de uso|utilizamos cookies"
    "|aceptar cookies|síguenos en|bajo licencia"
)
LETTER = regex.compile(r"\p{L}")


def failed_rule(line: str, words: list[bytes]) -> str | None:
    """The rule that a line of these words fails."""
    n = len(words)
    symbols = sum(map(line.count, SYMBOLS))
    if symbols > SYMBOL_SHARE * n or line.count("!") + line.count("?") > max(1.0, SYMBOL_SHARE * n) or not LETTER.search(line):
        separators = sum(w in SEPARATORS for w in words)
        return "navigation" if separators >= MIN_SEPARATORS and separators >= SEPARATOR_SHARE * n else "punctuation"
    if n >= LONG_LINE and not MARKS.search(line):
        return "punctuation"
    separators = sum(map(SEPARATORS.__contains__, words))
    if separators >= MIN_SEPARATORS and separators >= SEPARATOR_SHARE * n:
        return "navigation"
    lowered = line.strip(WHITE).lower()
    if n <= 3 and lowered in MENU:
        return "navigation"
    # most lines have no phrase
    if PHRASES.search(lowered) and sum(len(phrase.split()) for phrase in PHRASES.findall(lowered)) >= PHRASE_SHARE * n:
        return "boilerplate"
    return None


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows that occur twice or more; windows double in width, each width numbered from the last."""
    n = len(words)
    if n <= window:
        return 0
    seen: dict[bytes, int] = {}
    codes = np.array([seen.setdefault(w, len(seen)) for w in words], np.uint64)
    width, distinct = 1, len(seen)
    if window == 8 and distinct < 1 << 16:
        base = np.uint64(distinct)
        codes = ((codes[:-3] * base + codes[1:-2]) * base + codes[2:-1]) * base + codes[3:]
        width = 4
        numbers, codes = np.unique(codes, return_inverse=True)
        if len(numbers) == len(codes):
            return 0
        codes, distinct = codes.astype(np.uint64), len(numbers)
    while width < window:
        step = min(width, window - width)
        codes = codes[:-step] * np.uint64(distinct) + codes[step:]
        numbers, codes = np.unique(codes, return_inverse=True)
        codes, distinct = codes.astype(np.uint64), len(numbers)
        width += step
    again = np.bincount(codes.astype(np.int64))[codes.astype(np.int64)] > 1
    if not again.any():
        return 0
    edges = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(again)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def measured(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lines removed by each rule, cleaned text."""
    text = text or ""
    words = text.encode().split()
    n_words = len(words)
    word_chars = len(text) - sum(map(text.count, WHITE))
    repeated = repeated_words(words)
    lines, seen, duplicates, lost = [], set(), 0, 0
    removed = {"punctuation": 0, "navigation": 0, "boilerplate": 0}
    for line in text.split("\n"):
        own = line.encode().split()
        if own:
            if line in seen:
                duplicates += 1
            seen.add(line)
            if rule := failed_rule(line, own):
                removed[rule] += 1
                lost += len(line) - sum(map(line.count, WHITE))
                continue
        lines.append(line)
    failed = n_words < MIN_WORDS or 100 * repeated > MAX_REPEATED * n_words
    kept = not failed and lost <= MAX_LOST * word_chars
    counts = (n_words, word_chars, sum(map(text.count, SYMBOLS)), duplicates, repeated)
    return *counts, failed, kept, *removed.values(), "\n".join(lines)


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
REMOVED = ["punctuation_lines", "navigation_lines", "boilerplate_lines"]


def clean_lines(df: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = True) -> DataFrame:
    """key, the measures, the verdict, lines removed by each rule and, if wanted, the cleaned text."""
    small_batches(df.sparkSession)
    narrow = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    names = COLUMNS + REMOVED + ["cleaned"] * with_text
    types = ["long"] * 5 + ["boolean"] * 2 + ["long"] * 3 + ["string"] * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
        for batch in batches:
            schema = pa.schema([batch.schema.field(0), *((n, arrow[t]) for n, t in zip(names, types, strict=True))])
            pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            yield from to_batches(((k, *measured(t)[: len(names)]) for k, t in pairs), schema)

    kind = narrow.schema["key"].dataType.simpleString()
    schema = ", ".join([f"key {kind}", *(f"{n} {t}" for n, t in zip(names, types, strict=True))])
    return narrow.mapInArrow(run, schema).withColumnRenamed("key", key)


def op2_line_rules(docs: DataFrame) -> DataFrame:
    return clean_lines(docs, with_text=False).select("doc_id", *COLUMNS, *REMOVED)
