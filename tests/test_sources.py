import json

import pytest

from lattica.plans import service
from lattica.sources import exports, sinks, tables
from lattica.streaming import preferences


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


@pytest.mark.parametrize("encoding", ["utf-8-sig", "utf-8", "cp949"])
def test_csv_encodings(spark, tmp_path, encoding):
    df = tables.read_csv(spark, write(tmp_path / "a.csv", 'content_id, genre \n1,"드라마, 범죄"\n2,\n', encoding))
    assert df.columns == ["content_id", "genre"] and [tuple(r) for r in df.collect()] == [("1", "드라마, 범죄"), ("2", None)]


def test_encoding_of_a_late_line(spark, tmp_path):
    """The only characters beyond ASCII stand behind more than a mebibyte, in the second file of a folder too."""
    path = write(tmp_path / "late.csv", "content_id,title\n" + "".join(f"{i},{'x' * 60}\n" for i in range(25_000)) + "7,한글\n", "cp949")
    assert tables.detect_encoding(spark, path) == "cp949"
    assert [r[0] for r in tables.read_csv(spark, path).filter("content_id = '7'").select("title").collect()] == ["x" * 60, "한글"]
    (tmp_path / "two").mkdir()
    write(tmp_path / "two" / "a.csv", "content_id,title\n1,plain\n")
    write(tmp_path / "two" / "b.csv", "content_id,title\n2,한글\n", "cp949")
    assert tables.detect_encoding(spark, str(tmp_path / "two")) == "cp949"
    with pytest.raises(ValueError):
        tables.detect_encoding(spark, str(tmp_path / "two"), ("utf-8",))


def test_quoted_line_breaks(spark, tmp_path):
    df = tables.read_csv(spark, write(tmp_path / "q.csv", 'content_id,synopsis\n1,"one\ntwo, ""three"""\n2,plain\n'))
    assert {tuple(r) for r in df.collect()} == {("1", 'one\ntwo, "three"'), ("2", "plain")}


def test_tolerant_csv_keeps_rows_like_the_header(spark, tmp_path):
    for encoding in ("utf-8-sig", "cp949"):
        good, bad = tables.read_tolerant_csv(spark, write(tmp_path / f"{encoding}.csv", "id,z\n\n1,한\nid,z\n2,{a,b],c\n3,{a,b}\n", encoding))
        assert {tuple(r) for r in good.collect()} == {("1", "한"), ("id", "z"), ("3", "{a,b}")} and [r[0] for r in bad.collect()] == ["2,{a,b],c"]


def test_optional_and_fallback(spark, tmp_path):
    assert tables.read_optional(spark, str(tmp_path / "none.csv")) is None
    assert tables.read_optional(spark, write(tmp_path / "head.csv", "a,b\n")) is None
    good = write(tmp_path / "good.csv", "content_id,emb_0\n1,2\n")
    assert tables.read_embeddings(spark, str(tmp_path / "none.csv"), good).count() == 1
    with pytest.raises(ValueError):
        tables.read_embeddings(spark, str(tmp_path / "none.csv"))
    assert [p.rsplit("/", 1)[1] for p in tables.list_csv(spark, str(tmp_path))] == ["good.csv", "head.csv"]


def test_records(spark):
    df = tables.from_records(spark, [{"a": 1, "b": "x"}, {"b": None, "c": [1]}])
    assert [tuple(r) for r in df.collect()] == [("1", "x", None), (None, None, "[1]")]
    assert tables.from_records(spark, []) is None and tables.from_records(spark, {"a": "1"}).count() == 1


def test_bracketed_commas(spark, tmp_path):
    assert tables.protect_commas("1,{a,[b,c]},d") == "1,{a⟐[b⟐c]},d" and tables.protect_commas("a,(b,c") == "a,(b⟐c"
    good, bad = tables.read_tolerant_csv(spark, write(tmp_path / "t.csv", 'id,payload,z\n1,{x,y},2\n2,"q,r",3\n3,too,many,fields\n'))
    assert [tuple(r) for r in good.orderBy("id").collect()] == [("1", "{x,y}", "2"), ("2", "q,r", "3")]
    assert [r[0] for r in bad.collect()] == ["3,too,many,fields"]


def quoted(obj):
    return '"' + json.dumps(obj, ensure_ascii=False).replace('"', '""') + '"'


def test_export_lines(spark, tmp_path):
    lines = ['"row_to_json"', "", quoted({"content_id": 1, "genres": ["액션", "X", "SF", "드라마", "모험"], "av_type": "movie"}), "not json", '{"content_id": 2}']
    rows, bad = exports.read_export(spark, write(tmp_path / "av.txt", "\n".join(lines), "cp949"), "cp949")
    av = {r["content_id"]: r for r in exports.av_contents(rows).collect()}
    assert av["1"]["av_type"] == "MOVIE" and av["1"]["genres.tmdb_genres.0.id"] == "28" and av["1"]["genres.tmdb_genres.1.id"] == "" and av["1"]["genres.tmdb_genres.1.name"] == "X"
    assert av["1"]["genres.tmdb_genres.3.name"] == "드라마" and av["2"]["genres.tmdb_genres.0.name"] == "" and [r[0] for r in bad.collect()] == ["not json"]


def test_backslash_repair(spark):
    df = spark.createDataFrame([('{"a": "\\ 5,500"}',)], "value string")
    assert exports.json_lines(df)[0].count() == 0
    rows, bad = exports.json_lines(df, repair_backslash=True)
    assert bad.count() == 0 and json.loads(rows.first()[0])["a"] == "\\ 5,500"


def test_catalogue_exports(spark):
    def one(fn, obj):
        return fn(exports.json_lines(spark.createDataFrame([(json.dumps(obj),)], "value string"))[0]).first().asDict()

    c = one(exports.contents, {"content_id": 1, "release_date": "2020-02-03", "created_at": "2023-01-01T10:00", "synopsis": None})
    assert (c["release_year"], c["created_at"], c["synopsis"], c["updated_at"]) == ("2020", "2023-01-01", "", "")
    g = one(exports.game_contents, {"content_id": 2, "platforms": {"mac": True}, "genres": ["A", "B"]})
    assert (g["platform_mac"], g["platform_linux"], g["genres_str"]) == (True, False, "A|B")
    p = one(exports.platform_data, {"platform_name": "TMDB_MOVIE", "attributes": {"cast": ["a", "b"], "watch_providers": ["x", "y"]}})
    assert (p["platform_name"], p["cast_count"], p["crew_count"], p["watch_providers_keys"], p["season_count"]) == ("TMDB", 2, 0, "x|y", 0.0)
    for payload, want in (({"release_date": {"date": "d"}}, "d"), ({"release_date": "s"}, "s"), ({"release_date": None, "first_air_date": "f"}, ""), ({"first_air_date": "f"}, "f"), ({}, "")):
        assert one(exports.raw_item, {"raw_id": 1, "source_payload": payload})["release_date"] == want
    r = one(exports.raw_item, {"raw_id": 1, "source_payload": {"name": "", "original_name": "o", "av_type": "tv", "is_free": True}})
    assert (r["name"], r["content_type"], r["is_free"]) == ("o", "tv", "true")
    assert one(exports.webnovel_contents, {"content_id": 3, "genres": ["판타지", "로맨스"]})["genres_str"] == "판타지|로맨스"


def test_lines_are_parsed_once(spark):
    """Thirteen fields of one line, one parse of it; numbers, lists and objects as text."""
    df = spark.createDataFrame([('{"raw_id": 7, "source_payload": {"name": 2.50, "genres": ["a", 1, null], "is_free": true, "type": {"k": [1]}}}',), ("[1]",), ("{bad",), (None,)], "value string")
    rows, bad = exports.json_lines(df)
    found = exports.raw_item(rows)
    plan = found._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("parse_json") + plan.count("parsejson") == 1 or plan.count("variantexpressionevalutils") == 1, plan
    (r,) = found.collect()
    assert (r["raw_id"], r["name"], r["is_free"], r["genres_str"], r["content_type"]) == ("7", "2.5", "true", "a|1", '{"k":[1]}')
    assert sorted(x[0] for x in bad.collect()) == ["[1]", "{bad"]


def test_clean_cells(spark):
    df = spark.createDataFrame([("2021-01-02 03:04:05", '"{""a"":1}"', 3)], "created_at string, j string, n int")
    assert tuple(exports.clean_cells(df).first()) == ("2021-01-02", '{"a":1}', 3)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "가"), (2, None)], "id long, t string")
    for encoding in ("UTF-8", "x-windows-949"):
        sinks.write_csv(df, str(tmp_path / encoding), encoding)
        assert tables.read_csv(spark, str(tmp_path / encoding / "part-*.csv")).count() == 2
    sinks.write_parquet(df, str(tmp_path / "p"))
    sinks.write_json(df, str(tmp_path / "j"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == spark.read.json(str(tmp_path / "j")).count() == 2
    assert json.loads(sinks.json_array(df))[0] == {"id": 1, "t": "가"} and "id=1 | t=가" in sinks.profile(df)
    with pytest.raises(ValueError):
        sinks.records(df, 1)


PAYLOAD = {
    "contents": [{"content_id": 1, "domain": "AV", "master_title": "A"}, {"content_id": 2, "domain": "GAME", "master_title": "B"}, {"content_id": 3, "domain": "WEBNOVEL", "master_title": "C"}, {"content_id": 4, "domain": "AV", "master_title": "D"}],
    "av": [{"content_id": 1, "genres.tmdb_genres.0.name": "Action", "genres.tmdb_genres.1.name": "Crime"}, {"content_id": 4, "genres.tmdb_genres.0.name": "Action", "genres.tmdb_genres.1.name": ""}],
    "game": [{"content_id": 2, "genres_str": "Action;Adventure;Indie"}],
    "webnovel": [{"content_id": 3, "genres": "판타지|로맨스|액션"}],
    "raw_item": [{"raw_id": 1, "genres_str": "Action|Adventure|Indie"}],
}


def test_service(spark, tmp_path):
    assert service.health()["status"] == "healthy"
    found = service.build_graph_get_result(spark, PAYLOAD)
    assert service.build_graph(spark, PAYLOAD, str(tmp_path)) == found["stats"] and found["stats"]["content_nodes_count"] == 4
    assert spark.read.parquet(str(tmp_path / "meta_nodes")).count() == found["stats"]["meta_nodes_count"]
    graph = service.build_item_graph_get_result(spark, {"nodes": found["nodes"], "raw_genres": found["raw_genres"]})
    assert [(e["src_content_id"], e["dst_content_id"]) for e in graph["edges"]] == [(1, 4)] and service.build_item_graph(spark, {"nodes": found["nodes"]})["edges_count"] == 1
    emb = [{"content_id": i, "emb_0": i, "emb_1": 1.0} for i in (1, 2, 3, 4)]
    users = service.build_user_embeddings_get_result(spark, {"item_embeddings": emb, "raw_genres": found["raw_genres"], "user_preferred_genres": [{"user_id": 7, "genre": "action", "username": "u"}]})
    assert users["stats"]["user_count"] == 1 and users["user_embeddings"][0]["username"] == "u" and {"emb_0", "emb_1"} <= set(users["user_embeddings"][0])
    for bad in (None, {}, {"contents": []}):
        with pytest.raises(ValueError):
            service.build_graph(spark, bad)


def test_chain(spark):
    t = {k: tables.from_records(spark, v) for k, v in PAYLOAD.items()}
    prefs = spark.createDataFrame([(7, "action")], "user_id long, genre string")
    found = service.run_chain(t["contents"], t["av"], t["game"], t["webnovel"], t["raw_item"], prefs, 4, 2, {"walk_length": 4, "walks_per_node": 2, "epochs": 1})
    assert {r["content_id"] for r in found["item_embeddings"].collect()} == {1, 4}
    assert found["topk"].count() == 2 and found["per_domain"].count() == 2


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "user_id", "props")
    events.write.parquet(str(tmp_path / "in"))
    stream = preferences.preference_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    preferences.start(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).selectExpr("window.start", "user_id", "genre", "n").collect()}
    want = {tuple(r) for r in preferences.preference_counts(events).selectExpr("window.start", "user_id", "genre", "n").collect()}
    assert got <= want and len(got) > 0.8 * len(want)  # the last windows are still open


def test_http(spark, tmp_path):
    import threading

    from lattica.plans import http

    own = http.server(spark, port=0, out=str(tmp_path))
    threading.Thread(target=own.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{own.server_port}"
    try:
        assert http.call(base, "/health") == (200, service.health())
        code, body = http.call_build_graph(base, **PAYLOAD)
        assert code == 200 and body["stats"]["content_nodes_count"] == 4 and (tmp_path / "graph_nodes").is_dir()
        assert http.call(base, "/build-graph", {})[0] == 400 and http.call(base, "/build-item-graph", {"nodes": []})[0] == 400
        assert http.call(base, "/nowhere")[0] == 404
        assert http.call(base, "/build-item-graph", {"nodes": [{"content_id": 1}]})[0] == 400
        edges = [{"src_content_id": 1, "dst_content_id": 2, "weight": 1.0}]
        code, body = http.call(base, "/build-item-embeddings-get-result", {"edges": edges, "dim": 4, "walk_length": 3, "walks_per_node": 1, "epochs": 1})
        assert code == 200 and [r["content_id"] for r in body["item_embeddings"]] == [1, 2] and "emb_3" in body["item_embeddings"][0]
    finally:
        own.shutdown()
        own.server_close()
