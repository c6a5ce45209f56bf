"""Finds, one-to-one surrogates of the same format, coreference, and values that clash."""

import itertools
import re
import time

import pytest

from gridlens.llm import private_data as pd_
from gridlens.llm import surrogates as sg

KEY = b"test"
OWN = sg.Replacer(KEY)


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("mail thinhe.19@mail5.example.com now", [("email", "thinhe.19@mail5.example.com")]),
        ("call +1 (743) 555-3824.", [("phone", "+1 (743) 555-3824")]),
        ("from 233.233.171.252, and 1.2.3.4.5", [("ip", "233.233.171.252")]),
        ("card 4111 1111 1111 1111 and 4111111111111112", [("card", "4111 1111 1111 1111")]),
        ("iban GB82 WEST 1234 5698 7654 32!", [("iban", "GB82 WEST 1234 5698 7654 32")]),
        ("ssn 123-45-6789", [("ssn", "123-45-6789")]),
        ("Frau Müller und Herr Karl Schmidt", [("name", "Müller"), ("name", "Karl Schmidt")]),
        ("saw Anna Kowalska and г-н Иванов", [("name", "Anna Kowalska"), ("name", "Иванов")]),
        ("in 2024, 1500 people at 10.5 percent; version 1.2.3", []),
        ("", []),
    ],
)
def test_finds(text, found):
    assert [(k, text[a:b]) for a, b, k in pd_.finds(text)] == found


def test_one_to_one_on_a_small_format():
    values = ["".join(p) for p in itertools.product("ab", "0123456789", "é")]
    made = [OWN.characters(v, "x") for v in values]
    assert len(set(made)) == len(values) and all(a != b for a, b in zip(values, made, strict=True))
    everything = ["".join(p) for p in itertools.product("0123456789", repeat=3)]
    assert sorted(OWN.characters(v, "y") for v in everything) == everything


@pytest.mark.parametrize(
    ("kind", "value", "shape"),
    [
        ("email", "jane.doe7@mail5.example.com", r"[a-z]{4}\.[a-z]{3}\d@[a-z]{4}\d\.[a-z]{7}\.com"),
        ("phone", "7435553824", r"[1-9]\d{9}"),
        ("phone", "+493012345678", r"\+49[1-9]\d{9}"),
        ("ssn", "123456789", r"[1-9]\d{8}"),
        ("name", "Müllerová", r"[A-Z]\w{8}"),
        ("name", "Иванов", "[А-Я][а-я]{5}"),
        ("name", "漢字", "[一-鿿]{2}"),
    ],
)
def test_formats(kind, value, shape):
    made = OWN.replace(kind, value)
    assert made != value and re.fullmatch(shape, made)
    assert made == OWN.replace(kind, value) != sg.Replacer(b"other").replace(kind, value)


def test_checks_and_networks_hold():
    assert sg.luhn(OWN.replace("card", "4111111111111111")) and OWN.replace("card", "4111111111111111")[0] == "4"
    iban = OWN.replace("iban", "GB82WEST12345698765432")
    assert iban[:2] == "GB" and sg.iban_rest(iban) == 1 and iban[4:8].isalpha()
    assert OWN.replace("ip", "192.168.1.7").startswith("192.168.")
    assert all(not OWN.replace("ip", f"8.8.{i}.{i}").startswith(("10.", "127.", "192.168.")) for i in range(200))


def test_gender_and_script():
    for (script, gender), names in sg.GIVEN.items():
        for name in names:
            assert OWN.replace("name", f"{name} Xuy").split(" ")[0] in sg.GIVEN[script, gender]
            assert OWN.replace("name", f"{name} Xuy").split(" ")[0] != name


SCHEMA = "doc_id long, text string, changed string, FOUND int, lang string"


def test_documents(spark):
    rows = [
        (1, "Write to Jane.Doe@Example.org or call +1 (743) 555-3824.", "a", 1, "en"),
        (2, "jane.doe@example.org, 743-555-3824, (743) 555-3824", None, 2, None),
        (3, None, "x", 3, "en"),
        (4, "", "x", 4, "en"),
        (None, "jane.doe@example.org", "x", 5, "en"),
        (2, "nothing here", "x", 6, "en"),
        (2, "nothing here", "x", 6, "en"),
        (7, "x " * 50_000 + "10.1.2.3", "x", 6, "en"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = pd_.replace_private(df, KEY, entities="entities").collect()
    assert got[0].__fields__ == [*df.columns, "entities"]
    by = {(r["doc_id"], r["FOUND"]): r for r in got}
    assert len(got) == len(rows)
    mail = by[2, 2]["text"].split(",")[0]
    assert by[None, 5]["text"] == mail and mail in by[1, 1]["text"].lower() and "jane" not in mail
    written = by[1, 1]["text"]
    assert written[9].isupper() and written[14].isupper()
    digits = ["".join(filter(str.isdigit, p)) for p in (written.split("call ")[1], *by[2, 2]["text"].split(", ")[1:])]
    assert digits[0] == "1" + digits[1] and digits[1] == digits[2] != "7435553824"
    assert by[3, 3]["text"] is None and by[4, 4]["text"] == "" and by[2, 6]["text"] == "nothing here"
    assert by[7, 6]["text"].startswith("x x") and "10.1.2.3" not in by[7, 6]["text"]
    for r in got:
        for e in r["entities"]:
            assert e["surrogate"] in r["text"]
    for r in rows:
        assert by[r[0], r[3]]["lang"] == r[4] and by[r[0], r[3]]["changed"] == r[2]


def test_surrogates_that_are_real_values(spark):
    real = "7435553824"
    clash = OWN.replace("phone", real)
    second = OWN.replace("phone", clash)
    third = "2025550000"
    values = [real, clash, second, third]
    rows = [(i, f"call {v[:3]}-{v[3:6]}-{v[6:]} now") for i, v in enumerate(values)]
    got = {r["doc_id"]: r["text"] for r in pd_.replace_private(spark.createDataFrame(rows, "doc_id long, text string"), KEY).collect()}
    made = {i: re.sub(r"\D", "", t) for i, t in got.items()}
    assert len(set(made.values())) == 4 and not set(made.values()) & set(values)
    assert made[3] == OWN.replace("phone", third)


@pytest.mark.parametrize(
    "names",
    [
        [n for group, own in sg.GIVEN.items() if group[0] == "greek" for n in own] + sg.GIVEN["latin", "m"],
        ["Արամ", "ნინო", "Ά", "ก", "த", "ক", "Ñ", "Й"],
        [a + b for a in "BCDFGHJKLMNPQRSTVWXYZ" for b in "aeiou"],
    ],
)
def test_full_and_unchangeable_formats(spark, names):
    values = [("name", n, OWN.replace("name", n)) for n in names]
    df = spark.createDataFrame(values, "kind string, value string, surrogate string")
    made = {n: s for _, n, s in values} | {r["value"]: r["surrogate"] for r in pd_.exceptions(df, KEY).collect()}
    assert len(set(made.values())) == len(names) and not set(made.values()) & set(names)


def test_full_formats_of_numbers(spark):
    rows = [("phone", f"+12{i}") for i in range(100, 1000)] + [("ip", f"192.168.{i}.{j}") for i in range(256) for j in range(256)]
    df = spark.createDataFrame([(k, v, OWN.replace(k, v)) for k, v in rows], "kind string, value string, surrogate string")
    made = dict.fromkeys(rows) | {(r["kind"], r["value"]): r["surrogate"] for r in pd_.exceptions(df, KEY).collect()}
    assert len(set(made.values())) == len(rows) and not set(made.values()) & {v for _, v in rows}
    assert all(s.startswith("10.") for (k, _), s in made.items() if k == "ip")


def test_larger_formats_are_written_whole():
    for kind, found in (("phone", "(743) 555-3824"), ("card", "4111 1111 1111 1111"), ("ssn", "123-45-6789"), ("iban", "GB82 WEST 1234 5698 7654 32")):
        made = OWN.replace(kind, sg.plain_form(kind, found), sg.LARGER)
        assert sg.plain_form(kind, sg.written_like(kind, found, made)) == made and len(made) > len(sg.plain_form(kind, found))


def test_documents_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: r for r in pd_.op5_surrogates(docs).collect()}
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    surrogate_of, n = {}, 0
    for i, text in before.items():
        found = pd_.finds(text) if text else []
        assert len(found) == got[i]["n_entities"]
        if not found:
            assert got[i]["text"] == text
        for (a, b, kind), e in zip(found, got[i]["entities"], strict=True):
            n += 1
            value = kind, sg.plain_form(kind, text[a:b])
            assert surrogate_of.setdefault(value, sg.plain_form(kind, e["surrogate"])) == sg.plain_form(kind, e["surrogate"])
            assert text[a:b] not in got[i]["text"] or len(text[a:b]) < 9
    assert n > 50 and len(set(surrogate_of.values())) == len(surrogate_of)


def test_empty_table(spark):
    assert pd_.op5_surrogates(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("Robert Smith wrote.", ["Robert Smith"]),
        ("ALICE SMITH and Alice\u00a0\u00a0Smith", ["ALICE SMITH", "Alice\u00a0\u00a0Smith"]),
        ("José García vive aquí. Luego García salió.", ["José García", "García"]),
        ("זה דוד כהן מכאן", ["דוד כהן"]),
        ("Call 5551234567 or 555-1234", ["5551234567", "555-1234"]),
        ("tel 0151 23456789, fax: +49 30 123456", ["0151 23456789", "+49 30 123456"]),
        ("1000 2000 3000 and 2019 2020 2021", []),
        ("version 10.200.3000", []),
        ("+12233 only", []),
        ("+12233 only, on 2024-01-02 03:04", []),
        ("Maria ładna", []),
        ("Dr Smith said that Paul said nothing", ["Smith"]),
        ("a@b@c.org x..@y.org -a.b@d.example.com, me@x", ["b@c.org", "a.b@d.example.com"]),
    ],
)
def test_finds_in_context(text, found):
    assert [text[a:b] for a, b, _ in pd_.finds(text)] == found


def test_a_person_is_one_however_written():
    made = {w: sg.written_like("name", w, OWN.replace("name", sg.plain_form("name", w))) for w in ("Alice Smith", "ALICE SMITH", "Alice\u00a0\u00a0Smith")}
    assert made["ALICE SMITH"] == made["Alice Smith"].upper()
    assert made["Alice\u00a0\u00a0Smith"].split("\u00a0\u00a0") == made["Alice Smith"].split(" ")


@pytest.mark.parametrize("run", ["a", "a.", "a-", "1", "1 ", "A1 ", "Paul ", "tel ", "@", "a@"])
def test_long_runs_take_little_time(run):
    text = "mail x@y.org " + run * (5_000_000 // len(run))
    started = time.perf_counter()
    found = pd_.finds(text)
    assert time.perf_counter() - started < (3 if run in "aa.a-" else 30)
    assert found[0] == (5, 12, "email") and (run == "Paul " or len(found) < 5)


def test_rows_without_id_have_no_common_key(spark):
    names = sg.GIVEN["latin", "m"][:12]
    rows = [(None, f"Mr {n} is here") for n in names] * 3
    got = [r["text"] for r in pd_.replace_private(spark.createDataFrame(rows, "doc_id long, text string"), KEY).collect()]
    assert len(set(got)) == len(names) and not {t.split()[1] for t in got} & set(names)
