import pytest
from pyspark.sql import functions as F

from simjoin.operators import profile
from simjoin.sources import features, results

# Sample records of the file format.
F1, F2, F3 = "1_1;0;0;0:0.2;1:0.8;9:0", "12_69924;1;0.5;6:0.25;199:0.125", "2_2;1;676.0;0:0.0;1:1.0;5:5.0"


def lines(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "value string")


def test_parse_and_densify(spark):
    r = features.parse(lines(spark, F1)).first()
    assert tuple(r.key) == (1, 1, 0) and (r.classification, r.other) == (0, 0.0) and r.bin_keys == [0, 1, 9]
    dense = features.dense(features.parse(lines(spark, F1))).first().vector
    assert len(dense) == 10 and dense[0] == pytest.approx(0.2) and dense[2:] == [0.0] * 8
    assert features.dense(features.parse(lines(spark, F3)), 7).first().vector == [0, 1, 676, 676, 676, 5, 676]
    assert features.dimension(features.parse(lines(spark, F1, F2))) == 200


def test_text_round_trip_prefix_and_blank(spark, tmp_path):
    rows = features.parse(lines(spark, "host," + F3, "", F2))
    assert sorted(r.value for r in features.to_lines(rows).collect()) == sorted(["2_2;1;676.0;0:0.0;1:1.0;5:5.0", F2])
    features.write(rows, str(tmp_path / "f"))
    features.write(rows, str(tmp_path / "f"))  # replaces
    assert features.read(spark, str(tmp_path / "f")).count() == 2


def test_malformed_record_fails(spark):
    with pytest.raises(Exception, match="malformed"):
        features.parse(lines(spark, "1_1;0;x")).collect()


def test_keys(spark):
    got = lines(spark, "5", "1_2", "1_2_3", "1_2_4").select(features.format_key(features.parse_key(F.col("value"))).alias("k")).collect()
    assert [r.k for r in got] == ["0_5", "1_2", "1_2_3", "1_2_4"]
    r = lines(spark, "1_2:7").select(features.parse_classified_key(F.col("value")).alias("c")).first().c
    assert tuple(r.key) == (1, 2, 0) and r.classification == 7


def test_result_lines(spark, tmp_path):
    text = "2_1,0\t1_10|0.1|0\t2_7|0.15|0\t1_18|0.5|1"
    long = results.parse(lines(spark, text))
    assert [(r.rank, tuple(r.db_key), r.db_class) for r in long.orderBy("rank").collect()] == [(1, (1, 10, 0), 0), (2, (2, 7, 0), 0), (3, (1, 18, 0), 1)]
    assert results.to_lines(long).first().value == text
    assert results.to_lines(long, layout="doc").first().value == "2_1,0\t1_10|0|0.1\t2_7|0|0.15\t1_18|1|0.5"
    results.write(long, str(tmp_path / "r"))
    assert results.read(spark, str(tmp_path / "r")).count() == 3


def test_query_without_neighbours_has_an_empty_list(spark):
    long = results.parse(lines(spark, "2_1,0\t1_10|0.1|0"))
    queries = features.parse(lines(spark, "2_1;0;0;0:1", "9_9;3;0;0:1"))
    assert sorted((r.query_class, len(r.neighbours)) for r in results.nested(long, queries).collect()) == [(0, 1), (3, 0)]


def test_vector_lines(spark):
    r = features.parse_vector_lines(lines(spark, "7;1,5;2")).first()
    assert (r.id, r.coords, r.vector) == (7, None, [1.5, 2.0])
    r = features.parse_vector_lines(lines(spark, "7|3|4;1.5;2"), with_coordinates=True).first()
    assert (r.id, r.coords, r.vector) == (7, "|3|4", [1.5, 2.0])


def test_sub_dimensions_and_ranges(spark):
    rows = features.parse(lines(spark, F1, F3))
    got = {tuple(r.key): (r.bin_keys, r.bin_values) for r in profile.sub_dimensions(rows, 4).collect()}
    assert got[(1, 1, 0)][0] == [0, 1, 3] and got[(2, 2, 0)] == ([0, 1, 3], [0.0, 1.0, 676.0])
    r = profile.min_max(rows).first()
    assert (r.min_value, r.max_value) == (0.0, 676.0)


def test_duplicates_by_text(spark):
    text = lines(spark, "1_1;0;0;0:1", "1_2;0;0;0:1", "1_3;0;0;0:2").select(profile.vector_text().alias("vector"))
    assert [tuple(r) for r in profile.duplicate_vectors(text.limit(3), text).collect()] == [(2, 2, "0;0:1"), (1, 1, "0;0:2")]


def test_bad_lines_are_set_aside(spark):
    good = ["1_1;0;0;0:0.2;1:0.8;9:0", "x,2;1;0.5", " 3_4_5;-1;1e-3;7:.5; "]
    bad = ["1_1;0;0;a:1", "4;x;0", "5;0;zero;1:1", "6;0;0;1:1:1", "99999999999;0;0", "7;0;0;3:two", "8;0"]
    rows, others = features.checked(spark.createDataFrame([(x,) for x in [*good, *bad, "", "  "]], "value string"))
    assert sorted(r.line for r in others.collect()) == sorted(bad)
    want = features.parse(spark.createDataFrame([(x,) for x in good], "value string"))
    assert sorted(map(str, rows.collect())) == sorted(map(str, want.collect())) and rows.count() == 3


def test_one_dimension(spark):
    rows = features.parse(spark.createDataFrame([("1;0;0;0:3",), ("2;0;0;0:4",)], "value string"))
    assert features.dimension(rows) == 1 and sorted(r.vector for r in features.dense(rows).collect()) == [[3.0], [4.0]]
