"""Each stage against a plain version on its own input, and the whole run."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from gridlens.llm import bpe, cube_mixture, language_spans, private_data, similar_texts, stages, surrogates
from gridlens.session import stage

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def parts(spark):
    """The documents and what each stage made of them."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    made = {"documents": docs}
    for name, function in corpus_pipeline.STAGES:
        docs = made[name] = stage(function(spark, docs, "/root/testdata/sf0.01"), name)
    return made


def rows(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_columns(parts):
    for name, df in parts.items():
        assert df.columns == (COLUMNS if name != "token_ids" else ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def test_language(spark, parts):
    labeller = language_spans.Labeller(language_spans.train(parts["documents"]))
    before, after = rows(parts["documents"]), rows(parts["language"])
    for (i, row), (lang, score, _) in zip(before.items(), labeller.results([r["text"] for r in before.values()]), strict=True):
        assert (i in after) == (lang != "und" and score >= stages.LEAST_LANGUAGE_SCORE)
    assert all(after[i] == before[i] for i in after) and len(after) > 0.95 * len(before)


def test_mixed_documents_stay(spark, parts):
    by_language = {}
    for r in parts["documents"].collect():
        if r["text"] and r["lang"] and len(r["text"].split()) >= 80:
            by_language.setdefault(r["lang"], []).append(r["text"].split())
    mixed = [" ".join(w for lang, n in zip(sorted(by_language), (40, 35, 25), strict=False) for w in by_language[lang][i][:n]) for i in range(5)]
    english = " ".join(by_language["en"][0][:60])
    mixed.append(english + " " + " ".join(["漢字文章"] * (sum(map(str.isalpha, english)) * 55 // 45 // 4)))
    model = language_spans.train(parts["documents"])
    scores = [score for _, score, _ in language_spans.Labeller(model).results(mixed)]
    extra = spark.createDataFrame([(10**9 + i, t, None, "x", len(t)) for i, t in enumerate(mixed)], parts["documents"].schema)
    after = rows(stages.language(spark, parts["documents"].unionByName(extra), ""))
    assert min(scores) < 0.5 and all(10**9 + i in after for i in range(len(mixed)))


def test_near_duplicates(parts):
    before, after = rows(parts["language"]), rows(parts["near_duplicates"])
    sets = {i: shingles(r["text"]) for i, r in before.items()}
    by_shingle = {}
    for i, own in sets.items():
        for s in own:
            by_shingle.setdefault(s, []).append(i)
    shared = Counter()
    for ids in by_shingle.values():
        if 1 < len(ids) < 50:
            shared.update((a, b) for k, a in enumerate(ids) for b in ids[:k])
    near = {p: n / (len(sets[p[0]]) + len(sets[p[1]]) - n) for p, n in shared.items()}
    both_left = [p for p, j in near.items() if j >= 0.8 and p[0] in after and p[1] in after]
    assert len(both_left) <= 0.05 * sum(j >= 0.8 for j in near.values())
    texts = [r["text"] for r in after.values()]
    assert len(set(texts)) == len(texts)


def test_deleted_documents_have_links(parts):
    before, after = rows(parts["language"]), rows(parts["near_duplicates"])
    sets = {i: shingles(r["text"]) for i, r in before.items()}
    by_shingle = {}
    for i, own in sets.items():
        for s in own:
            by_shingle.setdefault(s, []).append(i)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, own in sets.items():
        shared = Counter(j for s in own for j in by_shingle[s] if j < i)
        for j, n in shared.items():
            if n / (len(own) + len(sets[j]) - n) >= stages.SIMILARITY:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert all(find(i) != i for i in before if i not in after)


@pytest.fixture
def scattered(spark, tmp_path):
    """100 texts with a near copy each, in eight files, and a function after which a scan deals them out as on a cluster that lost its cores."""
    rng = random.Random(1)
    made = []
    for group in range(100):
        words = [f"w{rng.randrange(10**6)}" for _ in range(60 + group)]
        made += [(2 * group, " ".join(words)), (2 * group + 1, " ".join([*words[:-1], "x"]))]
    rows = [(i, text, "en", f"src{i % 3}", len(text)) for i, text in made]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(8, "doc_id").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    yield docs, lambda: spark.conf.set("spark.sql.leafNodeDefaultParallelism", "1")
    spark.conf.unset("spark.sql.leafNodeDefaultParallelism")


@pytest.mark.parametrize("step", ["components", "_levels"])
def test_near_duplicates_when_files_are_dealt_anew(spark, scattered, monkeypatch, step):
    docs, lose_cores = scattered
    plain = getattr(similar_texts, step)
    monkeypatch.setattr(similar_texts, step, lambda *given: lose_cores() or plain(*given))
    before = docs.rdd.getNumPartitions()
    after = stages.near_duplicates(spark, docs, "").collect()
    assert docs.select("*").rdd.getNumPartitions() < before
    assert sorted(r["doc_id"] for r in after) == list(range(0, 200, 2))


def test_mixture_when_files_are_dealt_anew(spark, scattered, monkeypatch):
    docs, lose_cores = scattered
    steady = sorted(r["doc_id"] for r in stages.mixture(spark, docs, "").collect())
    plain = cube_mixture.cube_draw
    monkeypatch.setattr(cube_mixture, "cube_draw", lambda *given: lose_cores() or plain(*given))
    assert sorted(r["doc_id"] for r in stages.mixture(spark, docs, "").collect()) == steady


def test_private_data(parts):
    before, after = rows(parts["near_duplicates"]), rows(parts["private_data"])
    assert before.keys() == after.keys()
    for i, row in before.items():
        found = [surrogates.plain_form(k, row["text"][a:b]) for a, b, k in private_data.finds(row["text"])]
        now = {surrogates.plain_form(k, after[i]["text"][a:b]) for a, b, k in private_data.finds(after[i]["text"])}
        assert not now & set(found)
        assert found or row == after[i]


def test_mixture(parts):
    before, after = rows(parts["private_data"]), parts["mixture"].collect()
    copies = Counter(r["doc_id"] for r in after)
    taken = {r["doc_id"]: r["taken"] // r["size"] for r in cube_mixture.mixture(parts["private_data"], key="doc_id").collect() if r["size"]}
    assert set(copies.values()) <= {1, 2} and all(r.asDict() == before[r["doc_id"]] for r in after)
    size = Counter()
    for r in after:
        size[r["source"]] += len(r["text"].encode().split())
    goal = {r["source"]: r["target"] for r in cube_mixture.mixture(parts["private_data"]).collect()}
    largest = max(len(r["text"].encode().split()) for r in before.values())
    assert all(abs(size[s] - t) <= largest for s, t in goal.items()) and len(taken) == len(before)


def test_token_ids(parts):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    wanted = Counter()
    for r in parts["mixture"].collect():
        ids = library.encode_ordinary(r["text"])
        digest = hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        wanted[r["doc_id"], len(ids), digest, hashlib.sha256(r["text"].encode()).hexdigest()] += 1
    assert Counter(map(tuple, parts["token_ids"].collect())) == wanted


def test_run_and_odd_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, row int, Kept string"
    base = spark.read.parquet(f"{SF}/documents.parquet").collect()
    made = [(*(r[c] for c in COLUMNS), 1, "x") for r in base[:120]]
    made += [(None, None, None, None, None, None, None), (None, "", None, "a", 0, 1, "x"), made[3], made[3], (None, made[5][1], "en", None, 1, 1, "x")]
    made += [(10**12, "word " * 60_000, "en", "src1", 5, 1, "x")]
    spark.createDataFrame(made, schema).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert got and {r["doc_id"] for r in got} <= {m[0] for m in made}
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert stages.language(spark, docs, "").columns == docs.columns
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "none/documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).collect() == []
