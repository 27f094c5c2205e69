"""Benchmark items without an id are looked for like all others."""

import random

from veriseam.llm import decontaminate

from .test_documents import words


def test_items_without_id(spark):
    rnd = random.Random(31)
    items = [" ".join(words(20, rnd)) for _ in range(3)]
    table = spark.createDataFrame([(None, items[0]), (None, items[1]), (7, items[1]), (8, items[2]), (None, None), (None, "")], "item_id long, text string")
    around = lambda t: " ".join([*words(50, rnd), t, *words(50, rnd)])
    docs = spark.createDataFrame([(0, around(items[0])), (1, around(items[1])), (2, around(items[2])), (3, around("")), (4, None)], "doc_id long, text string")
    got = [(r["doc_id"], r["item_id"]) for r in decontaminate.find(docs, table).collect()]
    assert sorted(got, key=str) == sorted([(0, None), (1, None), (1, 7), (2, 8)], key=str)
    assert {r["doc_id"] for r in decontaminate.remove(docs, table).collect()} == {3, 4}
