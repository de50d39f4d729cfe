"""The pipeline against a brute-force version of all its stages."""

import random

import tiktoken

import corpus_pipeline
from tidemill.llm import bpe, pii

from .test_operators import DOCS, prose

BAD = ["vilescum", "rotgut", "dimwitted", "foulish"]


def test_pipeline_equals_brute_force(spark, tmp_path):
    rng = random.Random(8)
    item = prose(rng, 40, stop=False)

    def toxic():
        w = prose(rng, 60).split()
        for p in rng.sample(range(20, 40), 6):
            w[p] = rng.choice(BAD)
        return " ".join(w)

    texts = [toxic() if i % 5 == 0 else prose(rng, 60 + i % 7) for i in range(200)]
    texts += [texts[1], texts[1], texts[2], prose(rng, 30) + " " + item + " " + prose(rng, 30), prose(rng, 40) + " card 4111111111111111 and 38.101.105.188", "", None]
    rows = [(i, t, "en") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(150)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    enc = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.load(), special_tokens={})
    of, seen, want = pii.rewriter(pii.DEMO_KEY), set(), {}
    for i, t, _ in rows:
        if t and (any(b in t for b in BAD) or t in seen or item in t):
            continue
        if t:
            seen.add(t)
        want[i] = None if t is None else enc.encode_ordinary(of(t)[0])
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == want
    assert enc.decode(got[204]).count("4111111111111111") == 0


def tables(spark, path, rows, kind=DOCS, labels=(), items=()):
    spark.createDataFrame(rows, kind).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return spark.read.parquet(str(path / "documents.parquet"))


def test_stages_but_the_last_return_the_columns_of_documents(spark, tmp_path):
    rng = random.Random(18)
    # names that the stages use themselves, twice in other case, and with dots
    kind = "doc_id long, text string, n_chars long, id int, fp int, class_id int, _drop_id int, `key.x` string, toxic int"
    long = prose(rng, 40_000) + " 4111111111111111"
    texts = [prose(rng, 50) for _ in range(30)] + [None, "", long, long + " x"]
    rows = [(i, t, len(t or ""), i, 1, 2, 3, "k", 0) for i, t in enumerate(texts)]
    rows += [(3, texts[3], 1, 0, 0, 0, 0, "again", 0), (4, texts[5], 1, 0, 0, 0, 0, "other", 0), (None, texts[0], 1, 0, 0, 0, 0, "null", 0), (None, None, 1, 0, 0, 0, 0, "null", 0)]
    docs = tables(spark, tmp_path, rows, kind)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [c.split()[0].strip("`") for c in kind.split(", ")]
    kept = docs.collect()
    ids = sorted(r.doc_id for r in kept if r.doc_id is not None)
    # document 4 and 5 are one group, by the second row of 4; 33 is a near copy of 32
    assert ids == [i for i in range(33) if i != 5] and sum(r.doc_id is None for r in kept) == 2
    one = next(r for r in kept if r.doc_id == 32)
    assert "4111111111111111" not in one.text and len(one.text) == len(long) == one.n_chars and next(r for r in kept if r.doc_id == 30).text is None
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "ids", "n_tokens", "round_trip"] and got.count() == len(kept) and got.where("not round_trip").count() == 0


def test_empty_tables(spark, tmp_path):
    tables(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near-duplicates", "decontamination", "pii", "bpe"]
    assert corpus_pipeline.ORACLE_SQL is None
