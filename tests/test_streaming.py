import json

from prismdex.streaming.serve import serve_search, serve_suggestions


def requests(spark, path, schema, *batches):
    for i, batch in enumerate(batches):
        (path / f"{i}.json").write_text("\n".join(json.dumps(r) for r in batch))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(path))


def test_suggestions(spark, index, tmp_path):
    (tmp_path / "in").mkdir()
    stream = requests(spark, tmp_path / "in", "input_id long, text string",
                      [{"input_id": 1, "text": "new st"}], [{"input_id": 2, "text": "zzz"}, {"input_id": 3, "text": "b"}])
    serve_suggestions(stream, index.suggestions, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    answers = {r.input_id: r.response for r in spark.read.json(str(tmp_path / "out")).collect()}
    assert answers == {1: '["standard","style craft","stylecraft"]', 2: "[]", 3: '["bahama","batten","board"]'}


def test_search(spark, index, tmp_path):
    (tmp_path / "in").mkdir()
    stream = requests(spark, tmp_path / "in", "query_id long, phrase string", [{"query_id": 1, "phrase": "custom wood"}, {"query_id": 2, "phrase": "no such thing"}])
    serve_search(stream, index, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    answers = {r.query_id: json.loads(r.response) for r in spark.read.json(str(tmp_path / "out")).collect()}
    assert answers[2]["Results"] == [] and [g["Facets"] for g in answers[2]["FacetGroups"]] == [[]] * 4
    answer = answers[1]
    assert len(answer["Results"]) == 6 and answer["FacetGroups"][1] == {
        "Name": "Material", "Facets": [{"Name": "Wood", "Count": 6}]}
