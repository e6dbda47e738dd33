import pytest
from pyspark.sql import functions as F

from lexspan.operators import cells as C
from lexspan.sources import lexicon as X, stores as T, tables as R
from tests.conftest import rows

DATA = """  1 licence | text
00001740 03 n 02 café_au_lait 0 entity 1 003 ~ 000 | a drink; with milk; "one cup; please"; dropped; 'another'
00001741 03 v zz word 0 000 | bad count
00001742 03 v 0a a 0 b 0 c 0 d 0 e 0 f 0 g 0 h 0 i 0 j 0 000 | ten words
no bar here
"""


def test_lexicon_files(spark, tmp_path):
    for pos in X.PARTS_OF_SPEECH:
        (tmp_path / f"data.{pos}").write_bytes(DATA.encode("latin-1") if pos == "noun" else b"")
        (tmp_path / f"index.{pos}").write_bytes("  1 licence\ncafé_au_lait n 1\nlone\n\n".encode("latin-1") if pos == "noun" else b"")
    index, synsets = X.read_lexicon(spark, str(tmp_path))
    assert rows(index, "pos", "lemma") == [("noun", "café au lait")]
    got = {r["offset"]: r for r in synsets.collect()}
    assert set(got) == {"00001740", "00001742"}
    first = got["00001740"]
    assert (first["words"], first["gloss"], first["examples"]) == (["café au lait", "entity"], "a drink; with milk", ["one cup", "another"])
    assert len(got["00001742"]["words"]) == 10


def test_draft_reader(spark, tmp_path):
    (tmp_path / "d.tsv").write_text('"# note"\n# other\n\ntarget\tquery\tstyle\nhat\t what you wear \r\n\tno target\tx\n')
    got = R.parse_draft(R.read_numbered_lines(spark, str(tmp_path / "d.tsv")))
    assert rows(got, "target", "query", "style") == [("", "no target", "x"), ("hat", "what you wear", "")]
    (tmp_path / "bad.tsv").write_text("# a\nword\tquery\n")
    with pytest.raises(ValueError, match="target"):
        R.parse_draft(R.read_numbered_lines(spark, str(tmp_path / "bad.tsv")))


def test_counts_and_zipf_files(spark, tmp_path):
    lines = spark.createDataFrame([("the 10",), ("bad",), ("x many",), ("of  5",)], "line string")
    assert rows(R.parse_counts(lines)) == [("of", 5.0), ("the", 10.0)]
    R.write_zipf(spark.createDataFrame([("a b", 1.23456), ("c", None)], "word string, zipf double"), str(tmp_path / "z"))
    assert rows(R.parse_zipf(spark.read.text(str(tmp_path / "z")).withColumnRenamed("value", "line"))) == [("a b", 1.235)]


def test_cell_store_checks_lengths_and_counts(spark, tmp_path):
    cell = spark.createDataFrame([("c", 0, "a", [1.0, 0.0]), ("c", 1, "b", [0.0, 1.0])], "cell string, row long, word string, vec array<float>")
    meta = lambda n, dim: spark.createDataFrame([("c", n, dim)], "cell string, rows long, dim int")
    path = str(tmp_path / "cells")
    T.write_cell(cell, meta(2, 2), path)
    vectors, _ = T.read_cell(spark, path, "c")
    assert rows(vectors, "row", "word") == [(0, "a"), (1, "b")]
    with pytest.raises(C.RefusedError):
        T.write_cell(cell, meta(2, 3), path)
    T.write_cell(cell, meta(5, 2), path)
    with pytest.raises(C.RefusedError):
        T.read_cell(spark, path, "c")


def test_writing_a_run_again_replaces_only_that_run(spark, tmp_path):
    path = str(tmp_path / "runs")
    res = lambda tag, n: spark.createDataFrame([(tag, str(i)) for i in range(n)], "tag string, id string")
    run = lambda tag, at: spark.createDataFrame([(tag, at)], "tag string, ran_at string")
    T.write_run(res("a", 3), run("a", "2"), path)
    T.write_run(res("b", 2), run("b", None), path)
    T.write_run(res("a", 1), run("a", "3"), path)
    runs, results = T.read_runs(spark, path)
    assert rows(runs, "tag", "ran_at") == [("a", "3")] and rows(results, "tag", "id") == [("a", "0")]


def test_lines_of_several_files_and_splits_are_numbered_in_file_order(spark, tmp_path):
    lines = []
    for i, n in enumerate((700, 0, 1, 400)):
        mine = [f"file {i} line {j} " + "x" * (j % 50) if j % 7 else "" for j in range(n)]
        (tmp_path / f"part-{i}.txt").write_text("".join(x + "\n" for x in mine))
        lines += mine
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
        spark.conf.set("spark.sql.files.openCostInBytes", "10")
        got = R.read_numbered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert sorted((r["position"], r["line"]) for r in got) == list(enumerate(lines))


def test_the_first_line_of_the_first_file_is_the_header(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("# note\n\ntarget\tquery\n" + "".join(f"t{i}\tq{i}\n" for i in range(50)))
    (tmp_path / "b.tsv").write_text("u\tlast\n")
    got = R.parse_draft(R.read_numbered_lines(spark, str(tmp_path / "a.tsv"), str(tmp_path / "b.tsv")))
    assert rows(got, "position", "target") == [(3 + i, f"t{i}") for i in range(50)] + [(53, "u")]


def test_the_digest_of_a_written_set_follows_every_field(spark, tmp_path):
    def digest(name, **change):
        row = dict(id="a", query="q", target="t", source="s", sense_hint=None, zipf=1.5, token_count="one", style=None, lexical_overlap="none",
                   reachable=True, acceptable=["x"], leakage=None) | change
        schema = "id string, query string, target string, source string, sense_hint string, zipf double, token_count string, style string, lexical_overlap string, reachable boolean, acceptable array<string>, leakage string"
        R.write_set(spark.createDataFrame([tuple(row.values())], schema), str(tmp_path / name))
        return R.set_digest(spark, str(tmp_path / name)).first()["sha256"]

    base = digest("base")
    assert digest("same") == base
    assert len({base, *(digest(f"d{i}", **c) for i, c in enumerate(({"zipf": 2.0}, {"acceptable": ["y"]}, {"reachable": False}, {"leakage": "p"})))}) == 5


def test_a_database_table_is_read_in_key_ranges(spark, tmp_path):
    """Over the embedded database that comes with Spark."""
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    df = spark.range(1000).selectExpr("id", "concat('w', id) AS word", "CAST(id % 7 AS double) AS score")
    df.write.jdbc(url, "WORDS", properties={"createTableColumnTypes": "word VARCHAR(20)"})
    got = T.read_jdbc(spark, url, "WORDS", "id", 0, 1000, 4)
    assert got.rdd.getNumPartitions() == 4
    assert rows(got) == rows(df)
    ranged = got.filter("id >= 990").select("word")
    assert "PushedFilters" in ranged._jdf.queryExecution().executedPlan().toString() and ranged.count() == 10
