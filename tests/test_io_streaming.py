import io
import json
import zipfile
from xml.etree import ElementTree

import pytest

from noteflow.sources import io as sources
from noteflow.streaming import ingest


def test_jsonl_with_a_broken_line(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"id": "q1", "question": "?", "paragraphs": [{"idx": 3, "title": "t", "paragraph_text": "x"}, {"title": "u"}]}\n{broken\n{"id": null}\n')
    items = sources.read_document(spark, str(path), sources.ITEM_SCHEMA)
    assert [r["_corrupt"] for r in items.collect() if r["_corrupt"]] == ["{broken"]
    assert [tuple(r)[:3] for r in sources.passage_rows(items).collect()] == [("q1", 3, "t"), ("q1", 1, "u")]


def test_json_array_and_unknown_ending(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"a": 1}, {"a": 2}]')
    assert sources.read_document(spark, str(tmp_path / "a.json")).count() == 2
    with pytest.raises(ValueError):
        sources.read_document(spark, "x.pdf")


def test_docx(spark, tmp_path):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>One</w:t></w:r></w:p><w:p><w:r><w:t>Two</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "a.docx").write_bytes(data.getvalue())
    (tmp_path / "b.docx").write_bytes(b"no zip")
    assert sorted((r.text or "") for r in sources.read_docx(spark, str(tmp_path)).collect()) == ["", "One\nTwo"]


def test_listing(spark, tmp_path):
    for n in ("b.json", "a.jsonl", "c.txt"):
        (tmp_path / n).write_text("{}")
    got = [r.path.rsplit("/", 1)[1] for r in sources.list_files(spark, str(tmp_path), [".json", ".jsonl"]).collect()]
    assert got == ["a.jsonl", "b.json"]


def test_graphml_is_xml_with_everything(spark):
    nodes = spark.createDataFrame([("a<", 0.5, True, ["x", "y"]), ("b", None, False, None)], "id string, centrality double, core boolean, tags array<string>")
    edges = spark.createDataFrame([("a<", "b", "it \"is\" & was")], "src string, dst string, relation string")
    text = "\n".join(r.line for r in sources.graphml_lines(nodes, edges, {"made": "test"}).orderBy("n").collect())
    root = ElementTree.fromstring(text.encode())
    ns = "{http://graphml.graphdrawing.org/xmlns}"
    assert [n.get("id") for n in root.iter(f"{ns}node")] == ["a<", "b"]
    assert [d.text for d in root.find(f"{ns}graph/{ns}edge")] == ['it "is" & was']
    assert {d.get("key"): d.text for d in root.find(f"{ns}graph/{ns}node")} == {"centrality": "0.5", "core": "true", "tags": '["x","y"]'}


def test_node_link_and_index(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"nodes": [{"id": "a"}, {"id": "b"}], "links": [{"source": "a", "target": "b", "weight": 0.5}]}))
    nodes, links = sources.read_node_link(spark, str(tmp_path / "g.json"))
    assert nodes.count() == 2 and links.first().weight == 0.5
    sources.write_index(spark.createDataFrame([(1, 0), (2, 1)], "id int, cell int"), str(tmp_path / "index"), "cell", {"dimension": "8"})
    index, meta = sources.read_index(spark, str(tmp_path / "index"))
    assert index.count() == 2 and meta == {"dimension": "8"}


def note(i, text, time, source="s"):
    return json.dumps({"note_id": i, "content": text, "source": source, "ingested_at": time})


def test_ingestion_in_two_runs(spark, tmp_path):
    inbox, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text("\n".join([note("a", "One. Two.", "2024-01-01T00:00:00Z"), note("b", "x", "2024-01-01T00:10:00Z"), note("a", "old", "2023-12-31T23:00:00Z")]))
    ingest.run_once(ingest.note_stream(spark, inbox), ingest.upsert_batches(out), mark)
    (tmp_path / "in/2.json").write_text("\n".join([note("a", "newer", "2024-01-01T02:00:00Z"), note("c", "y", "2024-01-01T03:00:00Z")]))
    ingest.run_once(ingest.note_stream(spark, inbox), ingest.upsert_batches(out), mark)
    ingest.run_once(ingest.note_stream(spark, inbox), ingest.upsert_batches(out), mark)
    assert {(r.note_id, r.content) for r in ingest.current_state(spark, out).collect()} == {("a", "newer"), ("b", "x"), ("c", "y")}


def test_windows_close_behind_the_watermark(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text("\n".join([note("a", "One. Two.", "2024-01-01T00:00:00Z"), note("a", "One. Two.", "2024-01-01T00:05:00Z"), note("b", "x", "2024-01-01T00:30:00Z"), note("c", "y", "2024-01-02T00:00:00Z")]))
    stream = ingest.windowed_counts(ingest.note_stream(spark, str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", str(tmp_path / "m")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert [(r.source, r.notes, r.sentences) for r in spark.table("closed").collect()] == [("s", 3, 5)]


def test_repeats_are_dropped(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text("\n".join([note("a", "x", "2024-01-01T00:00:00Z"), note("a", "x", "2024-01-01T00:01:00Z"), note("b", "x", "2024-01-01T00:02:00Z")]))
    stream = ingest.without_repeats(ingest.note_stream(spark, str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("once").outputMode("append").option("checkpointLocation", str(tmp_path / "m")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.note_id for r in spark.table("once").collect()) == ["a", "b"]
