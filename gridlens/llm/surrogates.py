"""Keyed replacements of the same type and format, one to one on the values of each format.

A value is written as characters of fixed classes (digits, small vowels, Cyrillic consonants and so on). All values
with the same classes are the numbers below a product of class sizes, and a keyed Feistel permutation P of these numbers, cut in two
halves, makes the replacement P(P^-1(x) + step). Each value has exactly one replacement, no two share one, and none
is its own. Nothing has to be remembered, so every task gives a value the same replacement.

A value may be replaced again by a further attempt, which uses another permutation. From attempt LARGER on formats grow by a character,
a given name or a wider network with each attempt, so values that cannot change within their format, or fill it, get a replacement too.
"""

import hashlib
import re
import unicodedata
from functools import lru_cache

ROUNDS = 8
_WHITE = re.compile(r"\s+")
#: The first attempt that leaves the format of a value for a larger one.
LARGER = 5

# Classes of letters; a letter changes to another of its class
LETTERS = [
    "aeiou", "bcdfghjklmnpqrstvwxyz", "àâäáãåèéêëìîïíòôöóõøùûüúÿæœ", "çñßšžčřđðþłńśźżćğş",
    "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρστφχψ",
]
# Blocks of letters without capitals, first and last
BLOCKS = [(0x5D0, 0x5EA), (0x621, 0x64A), (0x905, 0x939), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3)]
# Given names by script and gender
GIVEN = {
    ("latin", "f"): (
        "Alice Amélie Anna Barbara Camille Carla Carmen Clara Elena Elizabeth Emily Emma Eva Hannah Isabel Jennifer Jessica Julia Karen Laura Lena Linda "
        "Lucía Margaret Maria María Marie Mary Monika Nina Patricia Sabine Sara Sarah Sofia Sophie Susan Ursula"
    ).split(),
    ("latin", "m"): (
        "Adam Andreas Antonio Carlos Charles Christopher Daniel David Felix François George Hans Hugo James Jan Javier Jean John Jorge José Joseph Juan "
        "Jürgen Klaus Lucas Luis Martin Matthew Max Michael Miguel Paul Peter Pierre Richard Robert Simon Thomas William"
    ).split(),
    ("hebrew", "f"): "אסתר לאה מרים רבקה רחל שרה".split(),
    ("hebrew", "m"): "אברהם דוד יוסף יעקב משה שמואל".split(),
    ("cyrillic", "f"): "Анна Вера Елена Ирина Мария Нина Ольга Татьяна".split(),
    ("cyrillic", "m"): "Алексей Борис Виктор Дмитрий Иван Михаил Николай Сергей".split(),
    ("greek", "f"): "Άννα Ελένη Κατερίνα Μαρία Σοφία".split(),
    ("greek", "m"): "Γιώργος Δημήτρης Κώστας Νίκος Πέτρος".split(),
}


@lru_cache(maxsize=None)
def alphabet_of(character: str) -> str:
    """The class of a character, or the character alone."""
    if character.isascii() and character.isdigit():
        return "0123456789"
    small = character.lower()
    for letters in LETTERS:
        if small in letters:
            return letters if character == small else letters.replace("ß", "ẞ").upper()  # ß alone has a capital of two letters
    for first, last in BLOCKS:
        if first <= ord(character) <= last:
            return "".join(map(chr, range(first, last + 1)))
    return other_letters(character)


def _group(character: str) -> tuple:
    return ord(character) // 128, unicodedata.category(character), unicodedata.name(character, "").split(" ")[0]


def other_letters(character: str) -> str:
    """Letters of the same script, case and 128 code points that no class above holds, or the character alone."""
    if not character.isalpha() or unicodedata.normalize("NFC", character) != character:
        return character
    first = ord(character) // 128 * 128
    listed = "".join(LETTERS)
    own = [c for c in map(chr, range(first, first + 128)) if c.isalpha() and c.lower() not in listed and _group(c) == _group(character)]
    own = [c for c in own if unicodedata.normalize("NFC", c) == c and not any(a <= ord(c) <= b for a, b in BLOCKS)]
    return "".join(own) if character in own else character


def longer(value: str, attempt: int) -> str:
    """The value with a character of a class more for each attempt from LARGER on."""
    more = max(0, attempt - LARGER + 1)
    alphabet = alphabet_of(value[-1])
    return value + (alphabet if len(alphabet) > 1 else LETTERS[1])[0] * more


class Replacer:
    def __init__(self, key: bytes):
        self.key = key
        self.given = {name: group for group, names in GIVEN.items() for name in names}

    def _draw(self, label: str, below: int, *parts) -> int:
        text = "\x1f".join([label, *map(str, parts)]).encode()
        size = max(16, below.bit_length() // 8 + 9)
        if size <= 64:
            return int.from_bytes(hashlib.blake2b(text, key=self.key, digest_size=size).digest(), "big") % below
        return int.from_bytes(hashlib.shake_256(self.key + text).digest(size), "big") % below

    def _permuted(self, number: int, a: int, b: int, label: str, back: bool) -> int:
        left, right = divmod(number, b)
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if i % 2:
                move = self._draw(label, b, i, left)
                right = (right - move if back else right + move) % b
            else:
                move = self._draw(label, a, i, right)
                left = (left - move if back else left + move) % a
        return left * b + right

    def number(self, number: int, a: int, b: int, label: str) -> int:
        """Another number below a * b, one to one."""
        if a * b == 1:
            return 0
        step = 1 + self._draw(label, a * b - 1, "step")
        moved = (self._permuted(number, a, b, label, True) + step) % (a * b)
        return self._permuted(moved, a, b, label, False)

    def characters(self, value: str, label: str, alphabets: list[str] | None = None) -> str:
        """Another string of the same classes."""
        alphabets = alphabets or [alphabet_of(c) for c in value]
        half, number, sizes = len(value) // 2, 0, [1, 1]
        for i, (character, alphabet) in enumerate(zip(value, alphabets, strict=True)):
            number = number * len(alphabet) + alphabet.index(character)
            sizes[i >= half] *= len(alphabet)
        number = self.number(number, sizes[0], sizes[1], "\x1e".join([label, *(a if len(a) < 40 else a[0] + a[-1] for a in alphabets)]))
        out = []
        for alphabet in reversed(alphabets):
            number, place = divmod(number, len(alphabet))
            out.append(alphabet[place])
        return "".join(reversed(out))

    def digits(self, value: str, label: str) -> str:
        """Another number of as many digits; a leading 0 stays, any other first digit stays above 0."""
        alphabets = ["0123456789"] * len(value)
        alphabets[0] = "0" if value[0] == "0" else "123456789"
        return self.characters(value, label, alphabets)

    def email(self, value: str, attempt: int) -> str:
        """Small letters only; the top-level domain stays."""
        local, _, domain = value.rpartition("@")
        host, _, top = domain.rpartition(".")
        # both parts in one step, so a short one does not limit the choice
        moved = self.characters(longer(local, attempt) + "@" + host, f"email {attempt}")
        return f"{moved}.{top}"

    def phone(self, value: str, attempt: int) -> str:
        """A country code after + stays: two digits of it, as its length is not known."""
        kept = value[:3] if value.startswith("+") else ""
        made = self.digits(value[len(kept) :] + "0" * max(0, attempt - LARGER + 1), f"phone {attempt} {kept}")
        # eleven digits from 1 on would be read as ten behind a country code
        return made + "0" if not kept and attempt >= LARGER and len(made) == 11 and made[0] == "1" else kept + made

    def ip(self, value: str, attempt: int) -> str:
        """Private and loopback addresses stay in their network, or go to 10.0.0.0/8 where it is full; all others never become one."""
        parts = [int(p) for p in value.split(".")]
        kept = next((n for n in ((10,), (127,), (192, 168), *((172, i) for i in range(16, 32))) if tuple(parts[: len(n)]) == n), ())
        if attempt >= LARGER and kept:
            kept = (10,) if attempt < 2 * LARGER else ()
        number, sizes = 0, [1, 1]
        for i, part in enumerate(parts[len(kept) :]):
            number = number * 256 + part
            sizes[i % 2] *= 256
        while True:
            number = self.number(number, sizes[0], sizes[1], f"ip {attempt} {kept}")
            made = [*kept, *(number >> 8 * i & 255 for i in range(3 - len(kept), -1, -1))]
            private = made[0] in (10, 127) or made[:2] == [192, 168] or made[0] == 172 and 16 <= made[1] < 32
            if kept or not private:
                return ".".join(map(str, made))

    def card(self, value: str, attempt: int) -> str:
        """The first digit stays, the check digit is made anew."""
        body = value[0] + self.characters(longer(value[1:-1], attempt), f"card {attempt} {value[0]}")
        return body + next(d for d in "0123456789" if luhn(body + d))

    def ssn(self, value: str, attempt: int) -> str:
        return self.digits(longer(value, attempt), f"ssn {attempt}")

    def iban(self, value: str, attempt: int) -> str:
        old = value[4:] + "0" * max(0, attempt - LARGER + 1)
        country, body = value[:2], self.characters(old, f"iban {attempt} {value[:2]}", [
            "0123456789" if c.isdigit() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in old
        ])
        return f"{country}{98 - iban_rest(country + '00' + body):02d}{body}"

    def name(self, value: str, attempt: int) -> str:
        """Known given names become others of their script and gender; all else changes letter by letter, but for a given name's ending."""
        words = value.split(" ")
        out = []
        for i, word in enumerate(words):
            group = self.given.get(word)
            if group:
                # a name that stands alone gets further given names, one for each attempt from LARGER on
                names, more = GIVEN[group], max(0, attempt - LARGER + 1) if len(words) == 1 else 0
                others = len(names) ** more
                number = self.number(names.index(word) * others, len(names), others, f"given {attempt} {group}")
                out += [names[number // len(names) ** k % len(names)] for k in range(more, -1, -1)]
            elif i + 1 < len(words) and len(word) > 3:
                out.append(self.characters(word[:-1], f"given {attempt}") + word[-1])
            else:
                out.append(self.characters(longer(word, attempt), f"family {attempt}"))
        return " ".join(out)

    def replace(self, kind: str, value: str, attempt: int = 0) -> str:
        """The replacement of a value in its plain form; a further attempt uses another permutation."""
        return getattr(self, kind)(value, attempt)


def luhn(digits: str) -> bool:
    doubled = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def iban_rest(value: str) -> int:
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97


def plain_form(kind: str, found: str) -> str:
    """What is the same for all ways of writing a value."""
    if kind == "email":
        return found.lower()
    if kind in ("card", "ssn"):
        return "".join(c for c in found if c.isdigit())
    if kind == "iban":
        return "".join(found.split()).upper()
    if kind == "phone":
        digits = "".join(c for c in found if c.isdigit())
        if len(digits) == 11 and digits[0] == "1":
            return digits[1:]  # with or without the country code
        return "+" + digits if found.startswith("+") else digits
    if kind == "ip":
        return ".".join(str(int(p)) for p in found.split("."))
    name = unicodedata.normalize("NFC", " ".join(found.split()))
    return " ".join(map(_first_capital, name.split())) if name.isupper() else name


def _first_capital(word: str) -> str:
    return word[:1] + word[1:].lower()


def written_like(kind: str, found: str, plain: str) -> str:
    """A replacement in the way in which the found value is written: its separators, white space and capitals."""
    if kind == "email":
        return "".join(c.upper() if f.isupper() else c for c, f in zip(plain, found, strict=True)) if len(plain) == len(found) else plain
    if kind == "ip":
        return plain
    if kind == "name":
        gaps, words = [g for g in _WHITE.findall(found) if g], plain.split(" ")
        made = "".join(w + g for w, g in zip(words, gaps + [" "] * len(words), strict=False))
        made = made[: len(made) - len((gaps + [" "] * len(words))[len(words) - 1])]
        return made.upper() if found.isupper() else made
    characters = plain.lstrip("+")
    if kind == "phone" and sum(c.isdigit() for c in found) == len(characters) + 1:
        characters = "1" + characters
    rest = iter(characters)
    # a replacement of a larger format goes on behind the last character
    return "".join(next(rest) if c.isalnum() else c for c in found) + "".join(rest)
