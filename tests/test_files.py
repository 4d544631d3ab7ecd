"""Files that are written and read whole: records across splits, single files, counts of the writing job."""

import csv
import io
import json
import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lattica.plans import service
from lattica.sources import records, sinks, tables


def plain_state(text, sep=","):
    """Whether a quoted field is open at the end, character by character."""
    begin, within, i = True, False, 0
    while i < len(text):
        c = text[i]
        if within:
            if c == '"':
                if text[i + 1 : i + 2] == '"':
                    i += 1
                else:
                    within = False
        elif c == '"' and begin:
            within = True
        begin = not within and c in (sep, "\n")
        i += 1
    return within


def test_states_against_a_plain_automaton():
    rng = random.Random(4)
    for _ in range(3_000):
        lines = ["".join(rng.choices('ab",', [2, 1, 3, 2], k=rng.randrange(0, 9))) for _ in range(rng.randrange(1, 5))]
        state = False
        for line in lines:
            state = records.within_after(line, state)
        assert state == plain_state("\n".join(lines)), lines


def messy(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices(["a", "bc", ",", '"', "\n", "\n\n", " ", "한"], [5, 5, 1, 1, 1, 0.3, 2, 1], k=rng.choice([1, 3, 9, 60])))
    return [(str(i), "x" + word() + "y", rng.choice(['5" disk', "plain", ""])) for i in range(n)]


@pytest.mark.parametrize("encoding", ["utf-8-sig", "cp949"])
@pytest.mark.parametrize("split", [64, 700, 1 << 27])
def test_records_across_splits(spark, tmp_path, split, encoding):
    rows = messy(split, 300) + [("long", "z" + "line\n" * 800 + "z", "")]
    rows += [("m" + i, a, b) for i, a, b in messy(split + 1, 50)]
    text = io.StringIO()
    out = csv.writer(text, lineterminator="\n")
    out.writerows([("id", "note", "bare"), *rows])
    raw = text.getvalue().replace('"5"" disk"', '5" disk')  # a bare quote within a field
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_bytes(raw.encode(encoding))
    (tmp_path / "in" / "b.csv").write_bytes("id,note,bare\nlast,\"one\ntwo\",\n".encode(encoding))
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        df = tables.read_csv(spark, str(tmp_path / "in"))
        found = {r["id"]: (r["note"], r["bare"] or "") for r in df.collect()}
        tasks = records.lines_of(spark, str(tmp_path / "in")).rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert df.columns == ["id", "note", "bare"] and found == {i: (a, b) for i, a, b in [*rows, ("last", "one\ntwo", "")]}
    assert tasks > 3 or split > 1000


def test_bare_quotes_need_no_records(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,size\n1,5"\n2,7" wide\n')
    assert tables.survey(spark, str(tmp_path / "a.csv")) == ("utf-8-sig", False) or tables.survey(spark, str(tmp_path / "a.csv"))[1] is False
    assert [r["size"] for r in tables.read_csv(spark, str(tmp_path / "a.csv")).collect()] == ['5"', '7" wide']


def test_tolerant_csv_takes_long_fields_and_line_breaks(spark, tmp_path):
    long = "w" * 300_000
    (tmp_path / "t.csv").write_text(f'id,payload,z\n1,{{x,y}},2\n2,"q\nr",3\n3,{long},4\n4,too,many,fields\n')
    good, bad = tables.read_tolerant_csv(spark, str(tmp_path / "t.csv"))
    assert sorted(map(tuple, good.collect())) == [("1", "{x,y}", "2"), ("2", "q\nr", "3"), ("3", long, "4")]
    assert [r["line"] for r in bad.collect()] == ["4,too,many,fields"]


def some(spark, n):
    return spark.range(n).select("id", F.when(F.col("id") % 3 > 0, F.concat(F.lit('a "b", 한\n'), F.col("id").cast("string"))).alias("text"), F.when(F.col("id") % 2 == 0, F.col("id") * 2).alias("even"), (F.col("id") / 4).alias("part"))


@pytest.mark.parametrize("n", [0, 1, 7, 1_000])
def test_single_files_are_those_of_pandas_and_json(spark, tmp_path, n):
    df = some(spark, n)
    rows = [tuple(r) for r in df.orderBy("id").collect()]
    frame = pd.DataFrame(rows, columns=df.columns).astype({"even": "Int64"})
    sinks.write_single_csv(df.repartition(5), str(tmp_path / "a.csv"), "id")
    assert (tmp_path / "a.csv").read_bytes() == frame.to_csv(index=False).encode("utf-8-sig")
    sinks.write_json_array(df.repartition(5), str(tmp_path / "a.json"), "id")
    assert (tmp_path / "a.json").read_text("utf-8") == json.dumps([dict(zip(df.columns, r)) for r in rows], indent=2, ensure_ascii=False)
    assert {p for p in os.listdir(tmp_path) if not p.endswith(".crc")} == {"a.csv", "a.json"}


@pytest.mark.parametrize("n", [0, 1, 1_000])
def test_json_arrays_are_read_in_splits(spark, tmp_path, n):
    deep = F.array(F.struct(F.lit("},\n  {\n").alias("a"), F.array(F.lit("x")).alias("b")))
    df = some(spark, n).select("id", F.concat("text", F.lit("\u2028\x85 ]")).alias("text"), deep.alias("deep"))
    sinks.write_json_array(df, str(tmp_path / "a.json"), "id")
    rows = [r.asDict(recursive=True) for r in df.orderBy("id").collect()]
    assert (tmp_path / "a.json").read_text("utf-8") == json.dumps(rows, indent=2, ensure_ascii=False)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "999")
    try:
        found = tables.read_json_array(spark, str(tmp_path / "a.json"), df.schema)
        assert sorted((r.asDict(recursive=True) for r in found.collect()), key=lambda r: r["id"]) == rows
        assert n < 1_000 or found.rdd.getNumPartitions() > 50  # no task holds the whole array
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_an_array_of_another_layout_is_refused(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": 1}, {"id": 2}], indent=4))
    with pytest.raises(Exception, match="(?i)malformed"):
        tables.read_json_array(spark, str(tmp_path / "a.json"), "id long").collect()


def test_more_rows_than_a_payload_may_have(spark, tmp_path):
    sinks.write_json_array(spark.range(150_000), str(tmp_path / "big.json"), "id")
    found = json.loads((tmp_path / "big.json").read_text())
    assert len(found) == 150_000 and found[-1] == {"id": 149_999}


def test_a_failed_task_leaves_the_target_as_it_was(spark, tmp_path):
    path = str(tmp_path / "a.csv")
    sinks.write_single_csv(some(spark, 3), path, "id")
    before = (tmp_path / "a.csv").read_bytes()
    broken = spark.range(1_000).select(F.when(F.col("id") == 777, F.raise_error(F.lit("no"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="no"):
        sinks.write_single_csv(broken, path)
    assert (tmp_path / "a.csv").read_bytes() == before and {p for p in os.listdir(tmp_path) if not p.endswith(".crc")} == {"a.csv"}


def test_statistics_come_from_the_writing_jobs(spark, tmp_path):
    payload = {"contents": [{"content_id": i, "domain": "AV", "master_title": f"t{i}"} for i in range(5)], "av_contents": [{"content_id": 1, "av_type": "TV", "genres.tmdb_genres.0.name": "Drama"}]}
    stats = service.build_graph(spark, payload, str(tmp_path / "out"))
    names = {"content_nodes_count": "graph_nodes", "raw_genres_count": "content_raw_genres", "meta_nodes_count": "meta_nodes", "edges_count": "graph_edges_bipartite"}
    assert stats == {k: spark.read.parquet(str(tmp_path / "out" / v)).count() for k, v in names.items()} and stats["content_nodes_count"] == 5
    spark.sparkContext.setJobGroup("counted", "")
    try:
        service._save_counted({"t": spark.range(10).coalesce(1)}, str(tmp_path / "t"))
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted")) == 1
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
