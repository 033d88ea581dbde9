"""Files in and out."""

import json
import os
import re

import pytest
from pyspark.sql import functions as F

from touchline.functions import text as T
from touchline.operators.report import report_text, stage_breakdown
from touchline.plans import q_report
from touchline.sources import json_files, sinks
from touchline.streaming import windows


def put(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value), encoding="utf-8")


def test_discover_both_shapes_and_layouts(spark, tmp_path):
    listed = {"segments": {"0": [5.0, 6.0, "b"], "1": [1.0, 2.0, "a"], "2": [1.0], "3": "x"}}
    objects = {"segments": {"0": {"start": 0.5, "end": 1.5, "text": "c", "avg_logprob": -0.2, "words": [{"word": "c", "start": 0.5, "end": 1.5, "prob": 0.9}]}, "1": {}}}
    put(tmp_path / "lg/2020/Home - Away/commentary_data/1_asr.json", listed)
    put(tmp_path / "lg/2020/Home - Away/commentary_data/2_asr.json", objects)
    put(tmp_path / "lg/2020/Flat One/1_asr.json", listed)
    put(tmp_path / "lg/2020/Flat One/1_asr_kb.json", {"segments": {"0": [0, 1, "kb"]}})
    put(tmp_path / "lg/2020/Broken/1_asr.json", "{not json")
    df = json_files.discover(spark, str(tmp_path))
    rows = [(r.match_name, r.half, r.segment_id, r.ord, r.start_time, r.text) for r in df.orderBy("match_name", "ord").collect()]
    assert rows == [("Flat One", 1, "1", 0, 1.0, "a"), ("Flat One", 1, "0", 1, 5.0, "b"), ("Home - Away", 1, "1", 0, 1.0, "a"), ("Home - Away", 1, "0", 1, 5.0, "b"), ("Home - Away", 2, "1", 2, 0.0, ""), ("Home - Away", 2, "0", 3, 0.5, "c")]
    assert df.where("text = 'c'").first().words[0].prob == 0.9
    kb = json_files.discover(spark, str(tmp_path), "_kb")
    assert {(r.match_name, r.text) for r in kb.collect()} == {("Flat One", "kb"), ("Home - Away", "a"), ("Home - Away", "b"), ("Home - Away", "c"), ("Home - Away", "")}
    assert json_files.match_filter(df, "FLAT").count() == 2


def test_labels_accept_both_forms(spark, tmp_path):
    put(tmp_path / "lg/2020/A/Labels-caption.json", {"gameHomeTeam": "Reds", "home": {"name": "Reds FC", "names": ["The Reds"]}, "away": "Blues", "referee": "Ann Ref", "venue": ["Park (Town)"], "lineup": {"home": {"players": [{"long_name": "Kevin De Bruyne", "short_name": "KDB"}], "coach": [{"long_name": "Jo Coach"}]}}})
    put(tmp_path / "lg/2020/B/Labels-caption.json", "oops")
    got = {(r.entity_type, r.name) for r in json_files.labels(spark, str(tmp_path)).collect()}
    assert got == {("team", "Reds"), ("team", "Reds FC"), ("team", "Blues"), ("referee", "Ann Ref"), ("venue", "Park (Town)"), ("player", "Kevin De Bruyne"), ("coach", "Jo Coach")}


def test_ground_truth_and_dictionaries(spark, tmp_path):
    put(tmp_path / "gt.json", [{"offset": 2.0, "duration": 3.0, "commentary": "x"}, {"offset": 0.0, "duration": 1.0}])
    assert [(r.start, r.end, r.text) for r in json_files.ground_truth(spark, str(tmp_path / "gt.json")).collect()] == [(0.0, 1.0, ""), (2.0, 5.0, "x")]
    put(tmp_path / "learned.json", {"sako": {"correct": "Sakho", "confidence": 0.9, "seen_count": 11}})
    assert json_files.learned(spark, str(tmp_path / "learned.json")).first().correct == "Sakho"
    put(tmp_path / "bad.json", "")
    assert json_files.learned(spark, str(tmp_path / "bad.json")).count() == 0
    assert json_files.validated_cache(spark, str(tmp_path / "none.json")).count() == 0


def test_lineup_mapping_and_model_source(spark):
    df = spark.createDataFrame([(json.dumps({"homeTeam": {"name": "Reds", "lineup": [{"name": "A B"}], "coach": {"name": "C D"}}, "awayTeam": {"name": "Blues"}, "referees": [{"name": "R"}]}),)], "v string")
    assert {(r.entity_type, r.name) for r in json_files.lineup_from_api(df, "v").collect()} == {("team", "Reds"), ("team", "Blues"), ("player", "A B"), ("coach", "C D"), ("referee", "R")}
    audio = spark.createDataFrame([("a.wav",)], "path string")
    got = json_files.transcribed(audio, "path", lambda p: [(0, 1, " hi "), (1, 2, " "), (2, 3, "ho")]).collect()
    assert [(r.segment_id, r.text) for r in got] == [("0", "hi"), ("1", "ho")]


def test_cleaned_documents_split_by_half(spark, tmp_path):
    seg = spark.createDataFrame([("lg", "2020", "A B/C", h, "0", 0, 1.25, 2.0, f"t{h}") for h in (1, 2)], "league string, season string, match_name string, half int, segment_id string, ord long, start_time double, end_time double, text string")
    cor = spark.createDataFrame([("lg", "2020", "A B/C", 1, "0", "x", "y", 90.0, "m", "3")], "league string, season string, match_name string, half int, segment_id string, original string, corrected string, score double, method string, stage string")
    docs = sinks.cleaned_documents(seg, cor)
    by = {r.half: json.loads(r.value) for r in docs.collect()}
    assert by[1]["segments"]["0"]["global_id"] == "lg_2020_A_B_C__h1__s0" and len(by[1]["cleaning_metadata"]["corrections"]) == 1
    assert not by[2]["cleaning_metadata"].get("corrections")
    sinks.write_documents(docs.withColumn("match_name", F.lit("A")), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 2
    value = sinks.export_blocks(seg.withColumn("match_id", F.lit("m"))).first().value
    assert value.startswith('Part 1\n\n{"segments": {"0": [1.25, 2.0, "t1"]}}\n\nPart 2')


def test_documents_and_exports_of_every_feed(spark, tmp_path):
    rows = [("m", f, None, "2020", "A", 1, "0", 0, 1.25, e, f"t{f}") for f, e in (("stock", 2.0), ("kb", None))] + [("m", "kb", None, "2020", "A", 1, "1", 1, 3.0, 4.0, None)]
    seg = spark.createDataFrame(rows, "match_id string, feed string, league string, season string, match_name string, half int, segment_id string, ord long, start_time double, end_time double, text string")
    cor = spark.createDataFrame([("m", "kb", 1, "0", "x", "y", 90.0, "m", "entity")], "match_id string, feed string, half int, segment_id string, original string, corrected string, score double, method string, stage string")
    gone = seg.where("text is null").select("match_id", "feed", "half", "segment_id", "start_time", "text", F.lit("empty_segment").alias("reason"), F.lit(None).cast("string").alias("duplicate_of"), F.lit(None).cast("double").alias("similarity"))
    docs = sinks.cleaned_documents(seg.where("text is not null"), cor, gone, seg)
    by = {r.feed: json.loads(r.value) for r in docs.collect()}
    meta = {f: v["cleaning_metadata"] for f, v in by.items()}
    assert {f: v["segments"]["0"]["text"] for f, v in by.items()} == {"stock": "tstock", "kb": "tkb"}
    assert by["kb"]["segments"]["0"]["global_id"] == "m__h1__s0" and meta["kb"]["match_id"] == "m"
    assert [c["original"] for c in meta["kb"]["corrections"]] == ["x"] and [c["segment_id"] for c in meta["kb"]["removed"]] == ["1"]
    assert (meta["kb"]["original_segment_count"], meta["kb"]["cleaned_segment_count"]) == (2, 1)
    assert not meta["stock"].get("corrections") and not meta["stock"].get("removed")
    sinks.write_documents(docs, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 2
    exported = {r.feed: r.value for r in sinks.export_blocks(seg).collect()}
    assert exported == {"stock": 'Part 1\n\n{"segments": {"0": [1.25, 2.0, "tstock"]}}', "kb": 'Part 1\n\n{"segments": {"0": [1.25, null, "tkb"], "1": [3.0, 4.0, null]}}'}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_sink_queries_leave_no_feed_out(spark):
    folder = "/root/testdata/sf0.001"
    seg = spark.read.parquet(f"{folder}/segments.parquet")
    docs = q_report.k1(spark, folder).collect()
    kept = q_report.cleaned(spark, folder)[1]
    halves = lambda rows: {(r.match_id, r.feed, r.half) for r in rows}
    assert halves(docs) == halves(kept.select("match_id", "feed", "half").distinct().collect())
    metas = [json.loads(r.value)["cleaning_metadata"] for r in docs]
    assert any(m.get("corrections") for m in metas) and any(m.get("removed") for m in metas)
    blocks = {(r.match_id, r.feed): r.value for r in q_report.k4(spark, folder).collect()}
    assert set(blocks) == {(r.match_id, r.feed) for r in seg.select("match_id", "feed").distinct().collect()}
    parts = [json.loads(p.split("\n\n")[1]) for v in blocks.values() for p in v.split("\n\nPart ")]
    assert sum(len(p["segments"]) for p in parts) == seg.select("match_id", "feed", "half", "segment_id").distinct().count()


def test_audit_rows_of_hesitations_and_compounds(spark):
    def brute(text, language):
        pause = re.compile(r"\b(?:" + "|".join(T.DISFLUENCIES) + r")\b", re.I)
        rows = [(m.group(), "", m.start()) for m in pause.finditer(text)]
        text = pause.sub("", text)
        for wrong, right in T.COMPOUNDS.get(language, {}).items():
            found = re.compile(rf"\b{re.escape(wrong)}\b", re.I)
            rows += [(m.group(), right, m.start()) for m in found.finditer(text)]
            text = found.sub(right, text)
        return rows

    texts = [("um, the Off side flag, eh, and off side again after a throw in", "en"), ("åh uh uh mål vakt och Mål Vakt, fri spark", "sv"), ("mål vakt um", "en"), ("", "sv"), ("um", "xx"), ("mid fielder over time mid field", "en")]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(texts)], "id int, t string, l string")
    got = df.select("id", F.inline(T.normalisation_audit(F.col("t"), F.col("l")))).collect()
    by = {i: [(r.original, r.corrected, r.position) for r in got if r.id == i] for i in range(len(texts))}
    assert by == {i: brute(*x) for i, x in enumerate(texts)} and len(by[0]) == 5 and len(by[1]) == 5
    assert {(r.method, r.stage, r.confidence) for r in got} == {("normalization", "2A", 1.0)}


def test_upsert_snapshot_and_tables(spark, tmp_path):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "id string, v int")
    merged = sinks.upsert(old, new, "id")
    assert {(r.id, r.v) for r in merged.collect()} == {("a", 1), ("b", 3), ("c", 4)}
    assert spark.read.parquet(sinks.write_snapshot(merged, str(tmp_path), 1)).count() == 3
    assert json.loads(sinks.dictionary_document(merged, "id").first().value)["b"] == {"v": 3}
    assert "| a | 1 |" in sinks.markdown_table(old)


def test_report(spark):
    totals = spark.createDataFrame([("m", 10, 8, 1, 1)], "m string, original long, kept long, hallucinations long, duplicates long")
    cor = spark.createDataFrame([("entity", 90.0, "Sako", "Sakho", "mcq_judge")], "stage string, score double, original string, corrected string, method string")
    removed = spark.createDataFrame([("empty_segment", "")], "reason string, text string")
    text = report_text(totals, stage_breakdown(cor), cor, removed)
    assert "retention 80.0 %" in text and "[high] 90.0 Sako -> Sakho" in text


def test_streams(spark, tmp_path):
    rows = [("m", i, f"2024-01-01 00:00:{i * 5:02d}", "Hansson." if i < 4 else "12 34", float(i)) for i in range(8)]
    df = spark.createDataFrame(rows, "m string, id int, at string, text string, end_time double").withColumn("at", F.to_timestamp("at"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))

    def run(out, name, mode):
        q = out.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(60)
        return spark.table(name)

    assert run(windows.chunk_counts(stream, ["m"], "at"), "chunks", "complete").agg(F.sum("n")).first()[0] >= 8
    assert run(windows.kept_segments(stream), "kept", "append").count() == 4
    assert run(windows.name_bursts(stream, ["m"], "at"), "bursts", "complete").first().n == 4
