"""Segments as an exact round trip, damage, and documents against the tokenizers library."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gridlens.llm import rans, token_files

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
SCHEMA = "doc_id long, text string, ids string, Shard int, start int"


@pytest.mark.parametrize("n", [0, 1, 2, 1023, 1024, 1025, 5000, (1 << 18) + 7])
@pytest.mark.parametrize("kind", ["one", "flat", "steep"])
def test_round_trip(n, kind):
    rng = np.random.default_rng(n)
    ids = {"one": np.full(n, 7), "flat": rng.integers(0, 50_257, n), "steep": np.minimum(rng.zipf(1.3, n), 60_000)}[kind].astype(np.uint32)
    coded = rans.encode_segment(ids)
    assert np.array_equal(rans.decode_segment(coded), ids)
    if n == 5000 and kind == "flat":
        assert len(coded) < 6 * n + 10_000


def test_size_is_near_the_entropy():
    ids = np.minimum(np.random.default_rng(1).zipf(1.3, 1 << 20), 60_000).astype(np.uint32)
    p = np.bincount(ids) / len(ids)
    entropy = -(p[p > 0] * np.log2(p[p > 0])).sum() * len(ids) / 8
    assert len(rans.encode_segment(ids)) < 1.08 * entropy + 60_000


def test_blocks_alone_and_damage():
    ids = np.random.default_rng(1).integers(0, 300, (1 << 18) * 2 + 50).astype(np.uint32)
    coded = rans.encode_segment(ids)
    assert np.array_equal(rans.decode_segment(coded, range(1, 2)), ids[1 << 18 : 1 << 19])
    broken = bytearray(coded)
    broken[-30_000] ^= 1
    with pytest.raises(ValueError, match="checksum|end"):
        rans.decode_segment(bytes(broken))
    assert len(rans.decode_segment(bytes(broken), range(0, 1))) == 1 << 18
    with pytest.raises(ValueError, match="not a segment"):
        rans.decode_segment(b"x" * 100)


def plain(rows):
    library = Tokenizer.from_file(PATH)
    start, out = 0, []
    for doc_id, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc_id, start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        start += len(ids)
    return out


def test_documents(spark):
    rng = random.Random(1)
    parts = ["a", "é", "the", " ", " ", "  ", "\n", " \n ", "\t", "'s", "漢字", "😀", "12", "!", "\xa0", "\x1c", "\u0085", "<|endoftext|>"]
    texts = [None, "", " ", "x" * 3000, *("".join(rng.choices(parts, k=rng.randint(1, 50))) for _ in range(300))]
    rows = [(i * 37 % 1009, t, "", 1, 1) for i, t in enumerate(texts)]
    rows += [(None, "no key", "", 1, 1), (None, None, "", 1, 1), (37, "second", "", 1, 1), rows[9], rows[9]]
    got = [tuple(r) for r in token_files.op7_token_files(spark.createDataFrame(rows, SCHEMA), PATH, PATTERN).collect()]
    assert sorted(got, key=repr) == sorted(plain(rows), key=repr)


def test_small_segments(spark, tmp_path):
    rows = [(i, "some words of a text") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    token_files.write(docs, PATH, str(tmp_path / "files"), segment_ids=50)
    made = spark.read.parquet(str(tmp_path / "files")).collect()
    assert len(made) >= 10 and all(50 <= r["n_ids"] < 60 for r in made if r["segment"] < max(s["segment"] for s in made if s["shard"] == r["shard"]))
    assert [k for r in sorted(made, key=lambda r: (r["shard"], r["segment"])) for k in r["keys"]] == list(range(100))
    found = {r["key"]: (r["start"], len(r["ids"]) // 4) for r in token_files.read(spark, str(tmp_path / "files")).collect()}
    assert found == {i: (start, n) for i, start, n, _ in plain(rows)}


def test_other_tokenizers_take_whole_texts():
    own = token_files.Tokens(public_tokenizers.path("word_bpe_49k.json"), PATTERN)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    text = "Some Words, and 'more' of them"
    assert np.frombuffer(own.ids([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_words_are_the_librarys(monkeypatch):
    monkeypatch.setattr(token_files, "KEPT_WORDS", 40)
    rng = random.Random(8)
    letters = [chr(c) for c in [*range(33, 127), *range(0xA1, 0x250), *range(0x250, 0x500), 0x4E00, 0x1F600, 0x300, 0x2160, 0xB2, 10, 9]]
    texts = [" ".join("".join(rng.choices(letters, k=rng.randint(1, 9))) for _ in range(40)) for _ in range(100)]
    texts += ["it's we're don't I'll. (so) \"quoted\", 3.14 x2 2x", "plain words only"]
    library = Tokenizer.from_file(PATH)
    own = token_files.Tokens(PATH, PATTERN)
    for i in range(0, len(texts), 10):
        got = [np.frombuffer(ids, "<u4").tolist() for ids in own.ids(texts[i : i + 10])]
        assert got == [library.encode(t, add_special_tokens=False).ids for t in texts[i : i + 10]]


def test_empty_table(spark):
    got = token_files.op7_token_files(spark.createDataFrame([], SCHEMA), PATH)
    assert got.collect() == [] and got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
