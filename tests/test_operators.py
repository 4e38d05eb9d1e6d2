"""The reference's operators on small fixtures."""

from __future__ import annotations

import itertools

import pytest
from pyspark.sql import functions as F

from lodeflow.__main__ import main
from lodeflow.functions import exprs, files, shared
from lodeflow.functions.shared import shared_dir
from lodeflow.operators import aggregates, bloom, enumeration, graph, joins, matrix, ordering, similarity
from lodeflow.sources import readers, sinks, synthetic
from lodeflow.streaming import counts


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_java_hash(spark):
    df = spark.createDataFrame([("these",), ("polygenelubricants",), ("",), ("😀",), (None,)], "w string")
    assert [r.h for r in df.select(exprs.java_hash(F.col("w")).alias("h")).collect()] == [110327427, -2147483648, 0, 1772899, None]
    assert spark.range(1).select(exprs.fm_estimate(F.lit(0b1011).cast("long"))).first()[0] == 5


def test_palindrome_pairs(spark):
    df = spark.createDataFrame([("Anna sinkt asdf fdsa",), ("Anna singt aSdf Fdsa",), ("Anna! singt asdf!! !f!dsa",), ("Anna24 singt asdf fds2a fdsa we ew",), (None,)], "t string")
    assert rows(aggregates.palindrome_pairs(df, "t")) == [("anna", 3, 0), ("asdf", 4, 4)]


def test_matrix(spark):
    entry = "row int, col int, value double"
    left = spark.createDataFrame([(0, 0, 1.0), (1, 1, 3.0), (2, 2, 4.0), (2, 4, 2.0), (0, 3, 0.0)], entry)
    right = spark.createDataFrame([(0, 2, 1.0), (1, 1, 3.0), (2, 2, 4.0), (4, 1, 2.0), (4, 0, 1.0)], entry)
    assert rows(matrix.multiply(left, right)) == [(0, 2, 1.0), (1, 1, 9.0), (2, 0, 2.0), (2, 1, 4.0), (2, 2, 16.0)]
    a = spark.createDataFrame([(i, j, float(3 * i + j + 1)) for i in range(3) for j in range(3)], entry)
    b = spark.createDataFrame([(i, j, 10.0 * (j + 1)) for i in range(3) for j in range(4)], entry)
    assert rows(matrix.multiply(a, b)) == sorted((i, j, float(6 * (j + 1) * 10 + 90 * i * (j + 1))) for i in range(3) for j in range(4))
    assert rows(matrix.duplicate_keys(left.unionByName(left.limit(1)), ["row", "col"])) == [(0, 0, 2)]


def test_bounded_distances(spark):
    edges = readers.edges(spark.createDataFrame([("10000 5",), ("22 10000",), ("5 22",), ("5 10",), ("% c",), ("",)], "value string"))
    assert rows(graph.bounded_distances(edges, 10000)) == [(10, 2), (22, 1), (5, 1)]
    assert rows(graph.bounded_distances(edges, 10000, directed=True)) == [(22, 1)]
    path = spark.createDataFrame([(i, i + 1) for i in range(9)], "id1 long, id2 long")
    assert rows(graph.bounded_distances(path, 0)) == [(1, 1), (2, 2), (3, 3), (4, 4)]


def test_neighbours(spark):
    df = spark.createDataFrame([("wordA wordB wordC wordD wordF",), ("wordA wordB wordE wordF",), ("wordB wordC wordD",)], "t string")
    names = {n: spark.range(1).select(exprs.java_hash(F.lit(f"word{n}"))).first()[0] for n in "abcdef"}
    got: dict[str, set] = {}
    for w, n, _ in rows(aggregates.neighbours(df, "t", least=2)):
        got.setdefault(w[-1], set()).add(next(k for k, v in names.items() if v == n))
    assert got == {"a": {"b"}, "b": {"a", "c", "d", "f"}, "c": {"b", "d"}, "d": {"b", "c"}, "f": {"b"}}
    four = aggregates.neighbours(spark.createDataFrame([("These are1 some words",)], "t string"), "t", least=1)
    assert four.count() == 12 and four.agg(F.max("n")).first()[0] == 1


def test_similarity(spark):
    sets = spark.createDataFrame([(1, [1, 2, 3, 4]), (2, [2, 3, 5]), (3, [12]), (4, [12]), (5, [])], "id long, items array<int>")
    assert rows(similarity.similar_pairs(sets, least=0.2)) == [(1, 2, 0.4)]
    assert set(rows(similarity.lsh_pairs(sets, n_hashes=60, n_bands=60, least=0.2))) <= {(1, 2, 0.4)}
    average, pairs = similarity.average_jaccard(sets).first()
    assert pairs == 10 and abs(average - 1.4 / 10) < 1e-12 and similarity.average_jaccard(sets.limit(0)).first() == (None, 0)
    assert similarity.signature_size(0.1) == 99 and similarity.expected_error(100) == 0.1 and similarity.lsh_size(4) == 12
    with pytest.raises(ValueError):
        similarity.signature_size(1.5)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    words = similarity.word_sets(docs, "doc_id", "text")
    reps = {r.id: set(r.items) for r in similarity.classes(words).collect()}
    want = {(a, b) for a, b in itertools.combinations(sorted(reps), 2) if len(reps[a] & reps[b]) >= 0.5 * len(reps[a] | reps[b])}
    assert {(r.a, r.b) for r in similarity.similar_pairs(words, least=0.5).collect()} == want
    assert {(r.a, r.b) for r in similarity.lsh_pairs(words).collect()} <= want
    assert {(r.bands, r.rows) for r in similarity.s_curve_grid(spark).collect()} == {(b, r) for b in range(30, 51) for r in range(3, 8) if 1 - (1 - 0.5**r) ** b >= 0.8 and 1 - (1 - 0.4**r) ** b < 0.6}


def test_lsh_pairs_misses_none(spark):
    sets = spark.createDataFrame([(2 * i + j, sorted([f"x{i}", f"y{i}", f"{j}z{i}"])) for i in range(200) for j in (0, 1)], "id long, items array<string>")
    assert set(rows(similarity.lsh_pairs(sets))) == {(2 * i, 2 * i + 1, 0.5) for i in range(200)}


def test_enumeration(spark):
    assert rows(enumeration.permutations(spark, 3)) == [("AB", "C"), ("AC", "B"), ("BA", "C"), ("BC", "A"), ("CA", "B"), ("CB", "A")]
    h = lambda s: spark.range(1).select(F.sha2(F.lit(s), 256)).first()[0]
    puzzles = spark.createDataFrame([(1, "password1", [h("ABC"), h("ABD")]), (2, "password2", [h("BCD"), h("ACD")])], "id long, main string, hints array<string>")
    assert rows(enumeration.looked_up(spark, puzzles, 4)) == sorted([(1, "password1"), (2, "password2"), (1, "D"), (1, "C"), (2, "A"), (2, "B")], key=repr)
    hint = {c: h("".join(x for x in "ABCDE" if x != c)) for c in "ABCDE"}
    two = spark.createDataFrame([(1, h("ABBBA"), [hint["D"], hint["C"]]), (2, h("AACCC"), [hint["B"], hint["D"]]), (3, h("ABBBA"), [hint["A"]]), (4, h("CCCCC"), [])], "id long, main string, hints array<string>")
    assert rows(enumeration.solved(spark, two, 5, 5)) == [(1, "ABBBA"), (2, "AACCC"), (4, "CCCCC")]
    with pytest.raises(ValueError):
        enumeration.strings(spark, 26, 9)


def test_joins_orders_and_sampling(spark):
    prices = spark.createDataFrame([("a", 15.0), ("a", 12.0), ("a", 31.0), ("b", 5.0)], "id string, price double")
    stations = spark.createDataFrame([("a", 1.0, 2.0), ("c", 3.0, 4.0)], "id string, lat double, lng double")
    assert rows(joins.histogram_join(prices, stations, "id")) == [("a", 1.0, 2.0, "1:2\t3:1"), ("b", 0.0, 0.0, "0:1")]
    one, two = spark.createDataFrame([(1, 5), (2, 6)], "k int, value long"), spark.createDataFrame([(2, 7), (3, 8)], "k int, value long")
    assert rows(joins.cogrouped(one, two, "k")) == [(1, 5, None, "5"), (2, 6, 7, "6 7"), (3, None, 8, "8")]
    hot = spark.range(5000).select(F.when(F.col("id") < 4000, 1).otherwise(F.col("id") % 7).alias("k"), F.col("id").alias("v"))
    got = ordering.positions(hot, "k", ["v"], size="n").collect()
    by: dict[int, list] = {}
    for r in sorted(got, key=lambda r: r.v):
        by.setdefault(r.k, []).append(r)
    assert all([r.position for r in rs] == list(range(1, len(rs) + 1)) and {r.n for r in rs} == {len(rs)} for rs in by.values()) and len(got) == 5000
    assert {k: n for k, n in rows(ordering.per_key_sample(hot, "k", "v").groupBy("k").count())} == {k: max(1, int(0.1 * len(rs) + 0.5)) for k, rs in by.items()}
    assert rows(ordering.with_markers(spark.createDataFrame([("a", 1), ("a", 2)], "k string, v int"), "k", F.col("v"))) == [("a", -1, True), ("a", 1, False), ("a", 2, False)]


def test_bloom(spark):
    assert bloom.sizing(2, 0.1) == (9, 3)
    members = spark.range(0, 1000, 10).select(F.col("id").cast("string").alias("k"))
    words = bloom.build(members, F.col("k"), n=100, p=0.01)
    asked = spark.range(1000).select(F.col("id").cast("string").alias("k"))
    found = {r.k for r in asked.where(bloom.maybe_member(spark, words, F.col("k"), n=100, p=0.01)).collect()}
    assert {r.k for r in members.collect()} <= found and len(found) < 150
    assert bloom.semi_join(asked, members, "k", n=100).count() == 100


def test_readers(spark):
    base = shared_dir(spark)
    line = lambda temp, q: "0029" + "029070" + "99999" + "19010101" + "0600" + "4" + "+64333" + "+02345" + "0FM-12" + "+0005" + "9" * 36 + temp + q
    w = readers.weather(spark.createDataFrame([(line("-0078", "1"),), (line("+9999", "1"),), ("short",)], "value string"))
    assert rows(w.select("station", "year", "lat", "airtemp", "quality")) == [(29070, 1901, 64333, -78, "1"), (29070, 1901, 64333, 9999, "1")]
    assert w.where(exprs.good_reading(F.col("airtemp"), F.col("quality"))).count() == 1
    text = spark.createDataFrame([("\t".join(["s1", *"12345678", "50.5", "8.25"]),), ("\t".join(["s2", *"123456789", "51", "9", "", ""]),)], "value string")
    assert rows(readers.stations(text)) == [("s1", 50.5, 8.25), ("s2", 51.0, 9.0)]
    assert rows(readers.access_log(spark.createDataFrame([("x y ff 10",)], "value string"))) == [(255, 16)]
    spark.createDataFrame([("ab",), ("cde",)], "value string").coalesce(1).write.option("compression", "gzip").text(f"{base}/zip")
    spark.createDataFrame([("ab",), ("cde",)], "value string").coalesce(1).write.text(f"{base}/plain")
    assert rows(readers.lines(spark, f"{base}/zip/*.gz")) == [("ab",), ("cde",)] and rows(readers.lines_with_offsets(spark, f"{base}/plain")) == [(0, "ab"), (3, "cde")]
    assert readers.named(spark.read.text(f"{base}/plain").select("value", "_metadata")).first().file_name.endswith(".txt")
    assert rows(readers.delimited(spark.createDataFrame([("a\t1",), ("b\tx",), ("c",)], "value string"), {"k": (0, "string"), "n": (1, "int")})) == [("a", 1), ("b", None), ("c", None)]
    assert readers.several([(text, [F.lit(1).alias("a")]), (text, [F.lit(2).alias("a")])]).count() == 4
    assert files.cat(spark, f"{base}/plain").count() == 2 and files.listed(spark, [f"{base}/plain", f"{base}/zip"]).count() >= 2
    assert files.removed(spark, f"{base}/zip") and files.settings(spark).count() > 5 and files.nothing(text).count() == 0


def test_sinks_and_synthetic_words(spark):
    base = shared_dir(spark)
    df = spark.createDataFrame([(1, "a"), (12, "b"), (22, "")], "k long, v string")
    sinks.several(df, base, key="k", value="v")
    assert rows(spark.read.text(f"{base}/text")) == [("12\tb",), ("1\ta",), ("22\t",)] and rows(sinks.read_sequence(spark, f"{base}/seq", "k long, v string")) == rows(df)
    assert rows(spark.read.parquet(f"{base}/sec").select("k", "bucket")) == [(1, 1), (12, 2), (22, 2)]
    synthetic.register(spark)
    read = [rows(spark.read.format("words").option("records", 10).option("splits", k).load()) for k in (1, 2, 3)]
    assert read[0] == read[1] == read[2] and len(set(read[0])) == 10 and all(len(w) == 5 and w.isupper() for _, w in read[0])


def test_counters_density_and_streams(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 1, 2), ("a", 2, 1), ("b", 1, 1)], "k string, u int, d int")
    kept, seen = aggregates.counted(df, F.col("k") == "a")
    kept.write.format("noop").mode("overwrite").save()
    assert seen.get == {"calls": 4, "writes": 3}
    assert rows(aggregates.density(df, [F.col("k")], F.col("u"), F.col("d"))) == [("a", 0.75), ("b", 1.0)]
    assert rows(aggregates.frequency_of_frequencies(df, F.col("u"))) == [(1, 1), (3, 1)]
    path = f"{shared_dir(spark)}/t.parquet"
    df.repartition(3).write.parquet(path)
    assert rows(counts.final_state(spark, path, df.schema, lambda x: x.groupBy("k").count(), files=1)) == [("a", 3), ("b", 1)]


def test_weather_cells_and_page_counts(spark):
    start = "0029029070999991901010106004+64333+023450FM-12+000599999V0202701N015919999999N0000001N9"
    lines = [start + "-00781", start.replace("19010101", "19010115") + "+00721", start + "-99991", start.replace("+64333", "-64333") + "+00781"]
    cells = readers.weather_cells(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert rows(cells) == sorted([("64", "023", "1901", "01", "02907099999", "01"), ("64", "023", "1901", "01", "02907099999", "15"), ("-64", "023", "1901", "01", "02907099999", "01")], key=repr)
    pairs = spark.createDataFrame([("k", "a", "1")] * 2 + [("k", "a", "2")] * 4 + [("k", "b", "2")] * 4, "k string, s string, d string")
    assert rows(aggregates.density(pairs, [F.col("k")], F.col("s"), F.col("d"))) == [("k", 2.5)]
    named = spark.createDataFrame([("fr.b p 1 624", "pagecounts-20130109-120000.gz"), ("fr.b q 1 739", "pagecounts-20130109-120000.gz"), ("odd", "x")], "value string, file_name string")
    assert rows(readers.page_counts(named).select("page", "bytes", "hour")) == sorted([("p", 624, "120000"), ("q", 739, "120000"), (None, None, None)], key=repr)


def test_boolean_vectors(spark):
    df = spark.createDataFrame([([True, False, True, True], [True, True, None, True], [True])], "a array<boolean>, b array<boolean>, c array<boolean>")
    got = df.select(similarity.true_places(F.col("a")), similarity.jaccard_bits(F.col("a"), F.col("b")), similarity.buckets_of_bits(F.col("a"), 2, 10)).first()
    p = similarity.BUCKET_PRIME
    assert list(got) == [[0, 2, 3], 0.5, [p % similarity.PRIME % 10, (3 * p % similarity.PRIME + 4 * p) % similarity.PRIME % 10]]
    for f in (similarity.jaccard_bits, similarity.similarity):
        with pytest.raises(Exception, match="different sizes"):
            df.select(f(F.col("a"), F.col("c"))).collect()
    assert df.select(similarity.similarity(F.col("a"), F.col("a"))).first()[0] == 1.0


def test_bloom_saved_top_k_and_sharding(spark):
    path, members = shared_dir(spark), spark.createDataFrame([("hello",), ("world",)], "k string")
    bloom.saved(bloom.build(members, F.col("k"), n=2, p=0.1), path, n=2, p=0.1)
    words, n, p = bloom.loaded(spark, path)
    assert (n, p) == (2, 0.1) and members.where(bloom.maybe_member(spark, words, F.col("k"), n=n, p=p)).count() == 2
    df = spark.createDataFrame([(1, 5), (2, 9), (3, 5)], "y int, n int")
    assert [tuple(r) for r in aggregates.top_k(df, "n", "y", 2).collect()] == [(2, 9), (1, 5)]
    assert [tuple(r) for r in aggregates.top_k(df, "n", "y", 5, ascending=True, padded=True).collect()] == [(0, 0), (0, 0), (3, 5), (1, 5), (2, 9)]
    synthetic.register(spark)
    read = [[rows(spark.read.format("words").option("records", 10).option("splits", k).option("sharding", "hash").load())] for k in (1, 2, 3)]
    assert read[0] == read[1] == read[2] and len(read[0][0]) == 10
    with pytest.raises(Exception, match="at least one split"):
        spark.read.format("words").option("splits", 0).load().collect()


def test_banded_pairs(spark):
    words = similarity.word_sets(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id", "text")
    every, banded = set(rows(similarity.lsh_pairs(words))), set(rows(similarity.lsh_pairs(words, n_hashes=180, n_bands=60)))
    assert banded == every != set()
    few = set(rows(similarity.lsh_pairs(words, n_hashes=60, n_bands=20)))
    assert few <= every and len(few) >= 0.9 * len(every)


def test_signatures(spark):
    sets = spark.createDataFrame([(1, ["x", "y"]), (2, ["z"]), (3, [])], "id long, items array<string>")
    got = dict(rows(similarity.signatures(sets, 12)))
    assert got == {r.id: r.sig for r in sets.where("id < 3").select("id", similarity.signed(F.col("items"), 12).alias("sig")).collect()}


def test_collision_curve(spark):
    sets = similarity.random_sets(spark, 30, 40)
    at = {r.id: (set(r["items"]), r.sig) for r in sets.select("id", "items", similarity.signed(F.col("items"), similarity.lsh_size(3)).alias("sig")).collect()}
    want = {}

    def placed(sig, n):
        size = similarity.lsh_size(n) // n
        out = []
        for k in range(n):
            h = 0
            for v in sig[k * size : (k + 1) * size]:
                h = (h + v * similarity.BUCKET_PRIME) % 10
            out.append(h)
        return out

    for a in at:
        for b in range(a):
            j = len(at[a][0] & at[b][0]) / len(at[a][0] | at[b][0])
            for n in (1, 3):
                c = want.setdefault((n, int(j * 10 + 1e-9)), [0, 0])
                c[0] += 1
                c[1] += any(x == y for x, y in zip(placed(at[a][1], n), placed(at[b][1], n), strict=True))
    assert {(s, d): [p, c] for s, d, p, c in rows(similarity.collision_curve(sets, stages=(1, 3)))} == want


def test_workspace_removes_what_it_stored(spark):
    with shared.workspace(spark) as at:
        path = shared.shared_dir(spark)
        spark.range(3).write.parquet(path)
        assert path.startswith(at) and spark.read.parquet(path).count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
    df = spark.createDataFrame([(1, 2, 3, 4)], "k int, part int, own int, position int")
    assert rows(ordering.positions(df, "k", ["part"])) == [(1, 2, 3, 1)] and shared.free_name(["A", "_a"], "a") == "__a"


def test_command_line(spark, tmp_path, capsys):
    assert main(["--list"]) == 0 and "word_count" in capsys.readouterr().out
    assert main(["nothing", "a", "b"]) == 2
    assert main(["status_count", "/root/testdata/sf0.001", f"{tmp_path}/out", "--conf", "spark.sql.ansi.enabled=true"]) == 0
    assert spark.read.parquet(f"{tmp_path}/out").count() > 0
