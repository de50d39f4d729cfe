"""Token ids by slices, packing and the queries on them: equal to plain versions, without moving each token or making rows twice."""

import functools
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemill.operators import text
from tidemill.plans import ORACLE_SQL, QUERIES, loading, texts

SF = "/root/testdata/sf0.001"


def moved(spark, run):
    """Rows that run writes to shuffles."""
    sc = spark.sparkContext

    def total():
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return sum(found.apply(i).shuffleWriteRecords() for i in range(found.size()))

    before = total()
    run()
    return total() - before


def counted(spark, df):
    """df, and a count of the rows made of it."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    return df.mapInArrow(count, df.schema), made


def corpus(rows, words, length, seed=0):
    rng = random.Random(seed)
    return [(k, [f"w{rng.randrange(words)}" for _ in range(rng.randrange(length))]) for k in range(rows)]


@pytest.mark.parametrize("most", [1, 37, 10**6])
def test_ids_of_slices_equal_the_plain_rule(spark, monkeypatch, most):
    docs = [*corpus(150, 90, 25), (1000, []), (1001, None), (1002, ["é", "w1", "Z" * 300]), (1003, [f"x{i}" for i in range(200)])]
    number = {w: i for i, w in enumerate(sorted({w for _, ws in docs for w in ws or []}, key=lambda w: w.encode()), 2)}
    monkeypatch.setattr(text, "SLICE_TOKENS", most)
    df = spark.createDataFrame(docs, "k long, tokens array<string>").repartition(3)
    got = text.token_ids(df, "k", broadcast_rows=0)
    assert got.columns == ["k", "ids"]
    assert {r.k: r.ids for r in got.collect()} == {k: [number[w] for w in ws or []] for k, ws in docs}
    assert text.token_ids(df.limit(0), "k", broadcast_rows=0).collect() == []


@pytest.fixture
def unshared(spark, monkeypatch):
    """Vocabularies of any size are taken for large ones, and joins aren't broadcast."""
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    monkeypatch.setattr(text, "token_ids", functools.partial(text.token_ids, broadcast_rows=0))
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_a_large_vocabulary_moves_words_not_occurrences(spark, unshared):
    docs = spark.createDataFrame(corpus(400, 60, 200), "k long, tokens array<string>").coalesce(2)
    occurrences = docs.agg(F.sum(F.size("tokens"))).first()[0]
    assert moved(spark, lambda: text.token_ids(docs, "k").collect()) < occurrences / 10


@pytest.mark.parametrize("name", ["loss_mask_full", "causal_labels", "pretrain_pipeline", "token_scan"])
def test_queries_with_a_large_vocabulary_equal_their_sql_and_move_words(spark, unshared, tmp_path, name):
    rows = [(k, "en", " ".join(words)) for k, words in corpus(600, 60, 200)]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    got = []
    rows_moved = moved(spark, lambda: got.extend(QUERIES[name](spark, str(tmp_path)).collect()))
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    cur = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(tuple(r[c] for c in names) for r in got) == sorted(cur.fetchall())
    assert rows_moved < sum(len(t.split()) for _, _, t in rows) / 5


def test_contract_probe_reads_rows_already_made(spark, monkeypatch):
    read, probe = [], loading.N.Contract.probe

    def probed(self, df, n=8):
        read.extend(df.inputFiles())
        probe(self, df, n)

    monkeypatch.setattr(loading.N.Contract, "probe", probed)
    QUERIES["contract_probe"](spark, SF)
    assert read and not any("documents.parquet" in f for f in read)


def test_schema_violations_makes_ids_once(spark, monkeypatch):
    df, made = counted(spark, texts.ids(spark, SF))
    monkeypatch.setattr(texts, "ids", lambda spark, d: df)
    assert QUERIES["schema_violations"](spark, SF).collect()
    assert made.value == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_chunks_inside_a_document_are_not_moved(spark):
    docs = spark.createDataFrame([(p, list(range(2, 6402))) for p in range(20)], "pos long, ids array<int>")
    assert moved(spark, lambda: text.pack(docs, 16).collect()) < 20 * 6401 / 16 / 10


@pytest.mark.parametrize("name", ["flagship", "pack_chunks", "pack_flush", "pretrain_pipeline"])
def test_ids_are_written_once(spark, monkeypatch, name):
    tables, write = [], texts.written

    def written(df, *options):
        tables.append(df.columns)
        return write(df, *options)

    for module in (texts, loading, text):
        monkeypatch.setattr(module, "written", written)
    QUERIES[name](spark, SF)
    assert sum("ids" in columns for columns in tables) == 1
