"""Queries over documents longer than any prefix, and packing of shards longer than any number of rows."""

import random
from collections import Counter

import pytest

from tessera.operators import row_packing as P
from tessera.plans import catalog, packing


@pytest.fixture(scope="module")
def long_documents(spark, tmp_path_factory):
    r = random.Random(5)
    at = str(tmp_path_factory.mktemp("long"))
    texts = ["".join(r.choice("abc é☕\n") for _ in range(r.choice([0, 3, 100, 599, 601, 900, 2500]))) for _ in range(400)]
    docs = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    return at, [list(t.encode()) for t in texts]


def test_each_byte_is_supervised_once(spark, long_documents):
    at, docs = long_documents
    seen = Counter()
    for x in catalog.REGISTRY.queries["packed_batches"](spark, at).collect():
        seen.update(int(t) for t, m in zip(x.targets.split(","), x.mask.split(",")) if m == "true" and int(t) != packing.BOS)
    assert seen == Counter(b for ids in docs for b in ids)


def test_full_documents_are_counted_whole(spark, long_documents):
    at, docs = long_documents
    got = {x.shard_index: x.supervised for x in catalog.REGISTRY.queries["full_document_rows"](spark, at).collect()}
    for shard in range(8):
        own = docs[shard::8]
        assert sum(map(len, own)) <= got[shard] <= sum(len(ids) + 1 for ids in own)


def test_buffered_rows_take_each_document_of_a_shard(spark, long_documents):
    at, docs = long_documents
    got = sorted((x.shard_index, x.row, x.n_documents, x.ids) for x in catalog.REGISTRY.queries["buffered_pack"](spark, at).collect())
    want = []
    for shard in range(8):
        own = list(enumerate(docs[shard::8]))
        rows = list(P.buffered(iter([own]), None, packing.LENGTH, packing.BOS, 1000))
        assert sorted(i for _, kept in rows for i, _ in kept) == list(range(len(own)))
        want += [(shard, k, len(kept), ",".join(map(str, ids))) for k, (ids, kept) in enumerate(rows)]
    assert got == want and len(got) > 8 * 8


def test_buffered_runs_empty_where_its_source_ends():
    rows = list(P.buffered(iter([[(0, [1, 2]), (1, [3])], [(2, [4, 5, 6, 7, 8])]]), None, 4, 99, 2))
    assert rows == [([99, 1, 2, 99, 3], [(0, 2), (1, 1)]), ([99, 4, 5, 6, 7], [(2, 4)])]
    assert list(P.buffered(iter([[(0, [1])]]), None, 4, 99, 2)) == [([99, 1, 99, 99, 99], [(0, 1)])]


def test_fence_class_sees_the_whole_text(spark, tmp_path):
    late = {1: "x" * 3000, 5: "x" * 3000 + "```", 6: "x" * 50 + "\n```\ny", 7: "x" * 45 + "\ny"}
    spark.createDataFrame(list(late.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x.fence for x in catalog.REGISTRY.queries["code_fence_class"](spark, str(tmp_path)).collect()}
    assert got == {1: "balanced_python_fence", 5: "malformed_fence", 6: "malformed_fence", 7: "balanced_untyped_fence"}
