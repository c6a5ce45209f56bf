"""Measures against plain counting, rules line by line, verdicts against labels."""

import random
import re
from collections import Counter

import pytest

from gridlens.llm import line_rules as lr

SCHEMA = "doc_id long, text string, n_words string, Key int, kept string"


def plain(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    counts = Counter(windows)
    inside = {j for i, w in enumerate(windows) if counts[w] > 1 for j in range(i, i + 8)}
    lines = [line for line in text.split("\n") if re.search("[^\x20\x09-\x0d]", line)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside),
            len(words) < 20 or 100 * len(inside) > 30 * len(words))


def test_measures(spark):
    rng = random.Random(1)
    texts = [None, "", " \t\n", "\x1c \x85 \xa0", "a b c d e f g h " * 2, "a b c d e f g h a b c d e f g", "x " * 50_000]
    for _ in range(300):
        vocabulary = rng.choices(["é", "the", "#", "a|b", "<x>", "end.", "\xa0", "w1", "w2", "w3"], k=rng.randint(1, 10))
        texts.append("".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "\n", "\t ", "\n\n"]) for _ in range(rng.randint(1, 120))))
    rows = [(i, t, "", 1, "") for i, t in enumerate(texts)] + [(None, "x", "", 1, ""), (3, "x", "", 1, "")]
    got = [tuple(r) for r in lr.op2_line_rules(spark.createDataFrame(rows, SCHEMA)).select("doc_id", *lr.COLUMNS[:6]).collect()]
    assert sorted(got, key=repr) == sorted(((i, *plain(t)) for i, t, *_ in rows), key=repr)


@pytest.mark.parametrize("distinct", [3, 400, 70_000])
def test_repeated_words_of_long_texts(distinct):
    rng = random.Random(distinct)
    words = [str(rng.randrange(distinct)).encode() for _ in range(3000)] + [str(i).encode() for i in range(distinct)]
    words += words[100:120] + words[500:507]
    assert lr.repeated_words(words) == plain(b" ".join(words).decode())[4]


@pytest.mark.parametrize(
    ("line", "rule"),
    [
        ("A sentence that ends well, as most do.", None),
        ("A heading", None),
        ("Home | News | Sports | Contact", "navigation"),
        ("Sign in", "navigation"),
        ("All Rights Reserved 2020.", "boilerplate"),
        ("Licensed under the Apache License, Version 2.0.", "boilerplate"),
        ("word### other$$$ and*** more&&&", "punctuation"),
        ("WOW!! THIS!! IS!! LOUD!!", "punctuation"),
        ("12345 67", "punctuation"),
        ("one two three four five six seven eight nine ten eleven twelve", "punctuation"),
        ("Really?", None),
    ],
)
def test_rules(line, rule):
    assert lr.failed_rule(line, line.encode().split()) == rule


def test_cleaned_text_and_verdict(spark):
    good = "This is a sentence of some length, with words. " * 1 + " ".join(f"Word{i}," for i in range(30)) + " end."
    rows = [(1, f"Home | News | Sports\n{good}\n\nAll rights reserved."), (2, "a | b | c | d\n" * 30 + good[:60])]
    got = {r["doc_id"]: r for r in lr.clean_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["kept"] and got[1]["cleaned"] == f"{good}\n"
    assert (got[1]["navigation_lines"], got[1]["boilerplate_lines"]) == (1, 1)
    assert not got[2]["kept"]


def test_labelled_documents(spark):
    sf = "/root/testdata/sf0.01"
    found = lr.op2_line_rules(spark.read.parquet(f"{sf}/documents.parquet"))
    both = found.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    good = [r["kept"] for r in both if r["quality"] == 1]
    bad = [r["kept"] for r in both if r["quality"] == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.2 * len(bad)


def test_empty_table(spark):
    assert lr.op2_line_rules(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_matches_sql(spark, sf):
    from gridlens.llm import queries
    from tests.compare import connect, duck_rows, spark_rows

    sf_dir = f"/root/testdata/{sf}"
    found = spark_rows(queries.queries()["op2_line_rules"](spark, sf_dir))
    assert found == duck_rows(connect(sf_dir), queries.oracle_sql()["op2_line_rules"])


def test_matches_sql_on_odd_texts(spark, tmp_path):
    import duckdb

    from gridlens.llm.oracle import op2_line_rules
    from tests.compare import duck_rows, spark_rows

    rng = random.Random(4)
    parts = ["|", "-", "/", "Home", "é", "the", "#x", "&&", "!", "?!", "end.", "Privacy Policy", "sign in", "½", "12", "漢字。", "it's"]
    texts = [None, "", "\n\n", "Sign In", " login \t"]
    texts += ["".join(rng.choice(parts) + rng.choice([" ", " ", " ", "\n", "\x0b"]) for _ in range(rng.randint(1, 80))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    df.coalesce(1).write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    assert spark_rows(lr.op2_line_rules(df)) == duck_rows(con, op2_line_rules())


def test_phrases_count_by_their_share():
    words = " ".join(f"word{i}." for i in range(600))
    article = words + " It is powered by wind. See our privacy policy."
    assert lr.failed_rule(article, article.encode().split()) is None
    for line in ("Alle Rechte vorbehalten", "© 2024 Acme. Tous droits réservés.", "Todos los derechos reservados.", "Impressum", "Licensed under CC BY-NC 4.0.",
                 "This work is licensed under the GNU General Public License, version 3."):
        assert lr.failed_rule(line, line.encode().split()) in ("boilerplate", "navigation"), line
