import zlib
from collections import Counter, defaultdict

import numpy as np

from moodgauge.llm import sharding


def test_shards(spark, docs, corpus, tmp_path):
    rows = sharding.write_shards(docs, str(tmp_path / "a"), shards=7, bucket_bytes=20_000).collect()
    key = lambda i, t: (i is None, i or 0, t is None, t or "")
    assert sorted((r.record.doc_id, r.record.text) for r in rows if r.record.doc_id is not None and r.record.text is not None) \
        == sorted((i, t) for i, t in corpus if i is not None and t is not None)
    assert sorted(key(r.record.doc_id, r.record.text) for r in rows) == sorted(key(i, t) for i, t in corpus)
    assert all(r["size"] == len((r.record.text or "").encode()) + 16 for r in rows)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    counts = [len(v) for v in slots.values()]
    assert len(slots) == 7 and max(counts) - min(counts) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert rows[0].record.asDict().keys() == set(docs.columns)


def test_result_depends_on_rows_and_seed_only(docs):
    def order(df, **o):
        return sorted((r.shard, r.slot, r.record.doc_id or -1) for r in
                      sharding.shuffle_into_shards(df, shards=5, bucket_bytes=30_000, **o).collect())
    assert order(docs) == order(docs.repartition(3)) != order(docs, seed=5)


def test_fewer_rows_than_shards_and_none(spark, no_docs):
    three = spark.createDataFrame([(1, "a"), (2, None), (3, "")], "doc_id long, text string")
    got = sharding.shuffle_into_shards(three, shards=40).collect()
    assert Counter(r.slot for r in got) == {0: 3} and len({r.shard for r in got}) == 3
    assert sharding.shuffle_into_shards(no_docs).count() == 0


def test_fisher_yates_is_uniform():
    seen = Counter(tuple(sharding.fisher_yates(4, [1, s]).tolist()) for s in range(6000))
    assert len(seen) == 24 and max(seen.values()) < 1.4 * min(seen.values())
    assert sorted(sharding.fisher_yates(1000, [3]).tolist()) == list(range(1000))
    # neighbours are torn apart
    assert np.corrcoef(sharding.fisher_yates(5000, [9]), np.arange(5000))[0, 1] < 0.05


def test_hot_ids_and_equal_rows_are_spread(spark):
    rows = [(i, f"text {i} " * 3) for i in range(300)]
    rows += [(7, f"other {i} " * 3) for i in range(400)]        # one id, many texts
    rows += [(8, "the same " * 3)] * 300 + [(None, "the same " * 3)] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    placed, n = sharding.placed(df, 1, "doc_id", "text", 2_000)
    sizes = [r.bytes for r in sharding._tallied(placed, n).collect()]
    assert sum(sizes) == sum(len(t) + 16 for _, t in rows) and max(sizes) < 8_000
    got = sharding.shuffle_into_shards(df, shards=7, bucket_bytes=2_000).collect()
    assert Counter((r.record.doc_id, r.record.text) for r in got) == Counter(rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and len(slots) == 7


def test_crc_of_texts(spark):
    from moodgauge.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op4_sharding"](spark, sf).collect():
        assert r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode())
