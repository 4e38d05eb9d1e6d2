from __future__ import annotations

import corpus_pipeline as cp


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [name for name, _ in cp.STAGES] == ["quality_rules", "near_dedup", "decontamination", "personal_data", "source_mixture"]
    before = docs
    for name, stage in cp.STAGES:
        after = cp.stored(stage(spark, before, sf))
        assert after.columns[: len(docs.columns)] == docs.columns
        ids = {r.doc_id for r in after.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in before.select("doc_id").collect()} and len(ids) > 0.5 * before.count()
        before = after
    ran = cp.run(spark, sf)
    assert sorted(map(str, ran.collect())) == sorted(map(str, before.collect()))
    for _, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_stages_take_nulls_and_repeats(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "x y", None, None, None)], docs.schema)
    for name, stage in cp.STAGES:
        out = stage(spark, docs.unionByName(odd), sf).collect()
        assert out, name
    kept = cp.near_dedup(spark, odd.unionByName(odd), sf)
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()).count((2, "x y")) == 1


def test_near_dedup_keeps_the_other_text_of_an_id(spark):
    copy, own = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    docs = spark.createDataFrame([(1, copy), (2, copy), (2, own), (2, ""), (3, copy), (4, "a b c d e f")], "doc_id long, text string")
    assert sorted(map(tuple, cp.near_dedup(spark, docs, "").collect())) == [(1, copy), (2, ""), (2, own), (4, "a b c d e f")]


def test_near_dedup_decides_by_row_where_ids_repeat(spark):
    a, b, c = ("one two three four five six seven", "eight nine ten eleven twelve thirteen", "red green blue black white brown")
    rows = [(1, a, 0), (5, a, 1), (5, b, 2), (5, c, 3), (7, c + " x", 4), (7, c + " x", 3), (None, a, 5), (8, None, 6)]
    df = spark.createDataFrame([(i, t, k, k, k) for i, t, k in rows], "doc_id long, text string, id int, node int, kept int")
    got = cp.near_dedup(spark, df, "")
    assert got.columns == df.columns
    assert sorted(((r.doc_id, r.text, r.id) for r in got.collect()), key=repr) == sorted([(1, a, 0), (5, b, 2), (5, c, 3), (7, c + " x", 3), (None, a, 5), (8, None, 6)], key=repr)
