"""Known shapes against Python's own regular expressions, and random strings among ordinary words."""

import base64
import hashlib
import random
import re

import pytest

from gridlens.llm import secret_scan as ss

SCHEMA = "doc_id long, text string, spans string, Row int, kind string"
PLAIN = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
]


def plain_spans(text):
    found = []
    for number, (kind, pattern, group, least) in enumerate(PLAIN):
        found += [(m.start(), number, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text or "", re.A) if len(m[group]) >= least]
    return [s for *_, s in sorted(found)]


def expected(doc_id, text):
    spans = plain_spans(text)
    counts = [sum(s.startswith(k) for s in spans) for k in ("assign", "access", "hex")]
    return (doc_id, *counts, hashlib.sha256(",".join(spans).encode()).hexdigest())


def test_known_shapes(spark):
    rng = random.Random(1)
    parts = ["password", "Token", "api_key", "APIKEY", "secret", " ", "  ", "=", ":", "'", '"', "é", "😀", "abc", "deadbeef0123456789abcdef01",
             "AKIA", "ABCDEFGH12345678", "K", "\n", "token=a secret=abcdef", "token = token: abcdefgh", "x.y", "0" * 30]
    texts = [None, "", *("".join(rng.choices(parts, k=rng.randint(1, 25))) for _ in range(500)), "token=abcdefg " * 3000]
    rows = [(None if i == 5 else i, t, "", 1, "") for i, t in enumerate(texts)]
    rows += rows[7:9]
    got = ss.op10_secret_scan(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted((expected(i, t) for i, t, *_ in rows), key=repr)
    for r in got:
        kept = ",".join(s for s in r["spans"].split(",") if s and not s.startswith("random"))
        assert hashlib.sha256(kept.encode()).hexdigest() == r["base_sha256"]


def test_random_strings(spark):
    rng = random.Random(3)
    words = ["configuration", "international", "responsibility", "characteristics", "environment", "Version", "2024"]
    rows, wanted = [], {}
    for i in range(400):
        text = " ".join("_".join(rng.choices(words, k=rng.randint(2, 6))) for _ in range(5)) + " 12345678901234567890 " + "ab" * 20
        if i % 20 == 0:
            key = base64.b64encode(rng.randbytes(36)).decode()
            text = text + " é " + key
            wanted[i] = f"random:{len(text) - len(key)}:{len(text)}"
        rows.append((i, text))
    found = {r["doc_id"]: [s for s in r["spans"].split(",") if s.startswith("random")] for r in ss.op10_secret_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    right = sum(found[i] == [s] for i, s in wanted.items())
    assert right >= 0.9 * len(wanted)
    assert sum(len(s) for i, s in found.items() if i not in wanted) <= 1


def test_statistics_by_hand(spark):
    text = "deadbeef0123456789abcdef01ff00aa"
    row = ss._statistics(spark.createDataFrame([(text,)], "match string")).first()
    assert row["encoding"]["name"] == "hex" and (row["n"], row["k"]) == (32, 16)
    counts = {c: text.count(c) for c in text}
    assert row["chi"] == pytest.approx(16 / 32 * sum(v * v for v in counts.values()) - 32)
    codes = [ss.ENCODINGS[1][1].index(c) + 1 for c in text]
    assert row["runs"] == 1 + sum((a > 8) != (b > 8) for a, b in zip(codes, codes[1:], strict=False))
    assert row["changes"] == sum(a.isdigit() != b.isdigit() for a, b in zip(text, text[1:], strict=False))
    assert row["beside"] == pytest.approx(sum((a - 8.5) * (b - 8.5) for a, b in zip(codes, codes[1:], strict=False)))


def test_normal_tail(spark):
    got = [r[0] for r in spark.createDataFrame([(z,) for z in (-2.0, 0.0, 1.0, 3.0, 6.0)], "z double").select(ss.upper_tail(ss.F.col("z"))).collect()]
    assert got == pytest.approx([0.977250, 0.5, 0.158655, 0.00134990, 9.866e-10], rel=1e-2)


def test_empty_table(spark):
    got = ss.op10_secret_scan(spark.createDataFrame([], SCHEMA))
    assert got.collect() == [] and got.columns == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]


def test_no_python_in_the_plan(spark):
    plan = ss.op10_secret_scan(spark.createDataFrame([(1, "x", "", 1, "")], SCHEMA))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
