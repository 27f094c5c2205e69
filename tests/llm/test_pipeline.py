"""The pipeline against a brute-force version, and the contract of its stages."""

import hashlib
import os

import pytest

import corpus_pipeline
from veriseam.llm import decontaminate, minhash
from veriseam.llm.queries import QUERIES, SQL, piece_model

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for name in os.listdir(DATA):
        c.sql(f"create view {name[:-8]} as select * from '{DATA}/{name}'")
    return c


def test_stages_give_what_brute_force_gives(spark, duck, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    left = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(k)))
        made = spark.read.parquet(str(tmp_path / str(k)))
        if name == "toxicity":
            toxic = dict(duck.sql("select doc_id, toxic from labels").fetchall())
            scored = {r["doc_id"]: r["score"] for r in QUERIES["op8_toxicity"](spark, DATA).collect()}
            right = [(scored[d] >= 0.5) == bool(y) for d, y in toxic.items() if d in scored]
            assert sum(right) >= 0.95 * len(right)  # some of these few labels are noise
            left = {d: t for d, t in left.items() if scored[d] < 0.5}
        elif name == "simhash_near_dedup":
            sets = {d: set(minhash.shingles(t).tolist()) for d, t in left.items()}
            root = {d: d for d in left}

            def find(x):
                while root[x] != x:
                    x = root[x]
                return x

            for a in left:
                for b in left:
                    if a < b:
                        x, y = sets[a], sets[b]
                        if len(x & y) >= 0.8 * len(x | y):
                            ra, rb = sorted((find(a), find(b)))
                            root[rb] = ra
            left = {d: t for d, t in left.items() if find(d) == d}
        elif name == "benchmark_decontamination":
            words = lambda t: b" " + b" ".join(decontaminate.words_of(t)) + b" "
            items = [words(t) for (t,) in duck.sql("select text from benchmark").fetchall()]
            left = {d: t for d, t in left.items() if not any(i in words(t) for i in items)}
        elif name == "secret_scan":
            left = {r["doc_id"]: r["text"] for r in made.collect()}
            assert not any("AKIA" in t and "[SECRET]" not in t for t in left.values())
        if k + 1 < len(corpus_pipeline.STAGES):
            assert made.columns == columns
            assert {r["doc_id"] for r in made.select("doc_id").collect()} == set(left)
        else:
            import sentencepiece

            library = sentencepiece.SentencePieceProcessor(model_file=piece_model())
            want = {d: hashlib.sha256(",".join(map(str, library.encode(t))).encode()).hexdigest() for d, t in left.items()}
            assert {r["doc_id"]: r["ids_sha256"] for r in made.collect()} == want
        docs = made


def test_queries_cover_the_thirteen():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)]
    assert corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DATA), duck.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(tuple(r[c] for c in want.columns) for r in got.collect()) == sorted(want.fetchall())
