"""Registered queries: parity with their SQL twins, digests against brute
force on small tables, and the pipeline's stages one by one."""

import hashlib
import os
import random
import sys

import pytest

import __spark_entry__ as E
from texts import edit, prose

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))
from harness import compare, duck  # noqa: E402

SF = os.environ.get("LLM_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A small folder of tables with planted cases."""
    rng = random.Random(17)
    d = str(tmp_path_factory.mktemp("tables"))
    clean = [prose(rng, rng.randrange(60, 200)) for _ in range(40)]
    shared = prose(rng, 60)
    items = [prose(rng, 30) for _ in range(6)]
    rows = [(i, t) for i, t in enumerate(clean)]
    rows += [(100, clean[3]), (101, edit(rng, clean[4], 0.01)), (102, "short text"), (103, "# $ % " * 30),
             (104, f"{prose(rng, 40)} {shared}"), (105, f"{shared} {prose(rng, 40)}"),
             (106, f"{prose(rng, 50)} {items[2]} {prose(rng, 50)}"), (107, None), (108, "")]
    spark.createDataFrame([(i, t, "en" if i % 3 else "fr", f"src{i % 4}", len(t or "")) for i, t in rows],
                          "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(i, f"http://h{i % 3}.example.org/en/{i}", t) for i, t in rows],
                          "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(i, [rng.random() for _ in range(64)], i % 3) for i in range(90)],
                          "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    return d, dict(rows), shared


def test_one_query_for_each_operator():
    names = [n for n in E.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in E.queries()


@pytest.mark.parametrize("name", ["op8_quality_rules", "op12_vector_codes"])
def test_parity(spark, name):
    a, b = compare(spark, duck(SF), name, E.queries()[name], E.oracle_sql()[name], SF)
    assert a == b


COLUMNS = {
    "op1_url_filter": ["page_id", "host", "path", "rule", "verdict"],
    "op4_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op5_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op6_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op7_sentencepiece_codec": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op8_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op10_minhash_near_dedup": ["doc_id", "n_shingles", "component_id", "kept"],
    "op11_quality_ranking": ["doc_id", "held_out", "score", "predicted"],
    "op13_token_alignment": ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, tables, name):
    d, texts, _ = tables
    df = E.queries()[name](spark, d)
    assert set(COLUMNS[name]) <= set(df.columns)
    assert df.count() == len(texts)


def test_planted_cases(spark, tables):
    d, texts, shared = tables
    q = E.queries()
    assert {(r.doc_id, r.item_id) for r in q["op2_benchmark_decontamination"](spark, d).collect()} == {(106, 2)}
    near = {r.doc_id: r.component_id for r in q["op10_minhash_near_dedup"](spark, d).collect()}
    assert near[100] == 3 and near[101] == 4 and sum(k != v for k, v in near.items()) == 2
    rep = {r.doc_id for r in q["op9_suffix_array_dedup"](spark, d).collect()}
    assert {3, 100, 104, 105} <= rep <= {3, 4, 100, 101, 103, 104, 105}


def test_language_learns_from_its_part_only(spark, tables, tmp_path):
    d, texts, _ = tables
    a = {r.doc_id: (r.lang_pred, r.score, r.held_out) for r in E.queries()["op6_language_id"](spark, d).collect()}
    docs = spark.read.parquet(f"{d}/documents.parquet")
    # languages of the held-out part are no input
    from pyspark.sql import functions as F
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    docs.withColumn("lang", F.when(held, F.lit("zz")).otherwise(F.col("lang"))).write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: (r.lang_pred, r.score, r.held_out) for r in E.queries()["op6_language_id"](spark, str(tmp_path)).collect()} == a
    import zlib
    assert all(v[2] == (zlib.crc32(str(k).encode()) % 4 == 2) for k, v in a.items())
    assert a[107][0] == a[108][0] == "und"


def test_pipeline_stages(spark, tables, tmp_path):
    import corpus_pipeline as cp
    d, texts, shared = tables
    docs = spark.read.parquet(f"{d}/documents.parquet")
    gone = [{102, 103, 107, 108}, {100, 101}, set(), {106}]
    want = set(texts)
    for (name, stage), out in zip(cp.STAGES, gone):
        got = stage(spark, docs, d)
        assert got.columns == docs.columns, name
        path = str(tmp_path / name)
        got.write.parquet(path)
        docs = spark.read.parquet(path)
        want -= out
        assert {r.doc_id for r in docs.select("doc_id").collect()} == want, name
    kept = {r.doc_id: r for r in docs.collect()}
    assert shared in kept[104].text and shared not in kept[105].text
    assert kept[105].n_chars == len(kept[105].text)
    assert all(kept[i].text == texts[i] for i in want - {105})
    last = {r.doc_id: r for r in cp.STAGES[-1][1](spark, docs, d).collect()}
    assert last.keys() == want
    for i, r in last.items():
        raw = kept[i].text.encode()
        assert b"".join(raw[a:z] for a, z in zip(r.offsets, r.offsets[1:])) == raw
        assert len(r.offsets) == len(r.ids) - 1
        assert r.ids_sha256 == hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in r.ids)).hexdigest()
    assert {r.doc_id: r.ids for r in cp.run(spark, d).collect()} == {i: r.ids for i, r in last.items()}


def test_empty_tables(spark, tables, tmp_path):
    d, _, _ = tables
    for t in ("documents", "benchmark", "pages", "labels", "embeddings"):
        spark.read.parquet(f"{d}/{t}.parquet").where("false").write.parquet(f"{tmp_path}/{t}.parquet")
    for name, fn in E.queries().items():
        if name.startswith("op") or name == "pipeline":
            assert fn(spark, str(tmp_path)).count() == 0, name
