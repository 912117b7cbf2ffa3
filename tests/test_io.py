import json
import time
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from timeloom.operators import jobs, quality
from timeloom.operators.spans import span_report
from timeloom.plans.queries import QUERIES
from timeloom.sources import media, recognition, reports, sinks, subtitles
from timeloom.streaming import watch


def test_srt_round_trip(spark, tmp_path):
    body = "1\n00:00:01,000 --> 00:00:02,500\nHello , world !\n\n2\n00:00:03,000 --> 00:00:04,000\nA\nB\n\n3\nno time\n\n4\n00:00:05,000 --> 00:00:06,000\n\n"
    (tmp_path / "x.ja.srt").write_text(body)
    texts = subtitles.read_texts(spark, str(tmp_path))
    cues = subtitles.parse_srt(texts)
    assert [(r.media_id, r.seq, r.start_s, r.end_s, r.text) for r in cues.orderBy("seq").collect()] == [("x.ja", 1, 1.0, 2.5, "Hello, world!"), ("x.ja", 2, 3.0, 4.0, "A\nB")]
    assert texts.select(subtitles.count_srt_blocks(F.col("body")).alias("n")).first().n == 3
    entries = subtitles.parse_srt_entries(texts).orderBy("seq").collect()
    assert [(r.timecode, r.text) for r in entries] == [("00:00:01,000 --> 00:00:02,500", "Hello , world !"), ("00:00:03,000 --> 00:00:04,000", "A B")]
    assert subtitles.render_srt(cues).first().body == "1\n00:00:01,000 --> 00:00:02,500\nHello, world!\n\n2\n00:00:03,000 --> 00:00:04,000\nA\nB\n"
    assert json.loads(subtitles.render_json(cues).first().body)[0] == {"start": 1.0, "end": 2.5, "text": "Hello, world!"}
    assert subtitles.render_txt(cues).first().body == "Hello, world!\nA\nB\n"
    out = tmp_path / "out"
    subtitles.write_srt(cues, str(out))
    assert [p.name for p in out.iterdir()] == ["x.ja.srt"] and (out / "x.ja.srt").read_text() == subtitles.render_srt(cues).first().body
    assert [(r.start_s, r.text) for r in subtitles.parse_srt(subtitles.read_texts(spark, str(out))).orderBy("seq").collect()] == [(1.0, "Hello, world!"), (3.0, "A\nB")]


def names(folder):
    return sorted(p.name for p in folder.rglob("*"))


def test_named_files_commit_or_nothing(spark, tmp_path):
    schema = "media_id string, body string, expected long"
    good = [(f"m{n}", f"1\nx\na{n}\n\n2\nx\nb\n", 2) for n in range(40)]
    out = tmp_path / "out"
    sinks.write_texts(spark.createDataFrame(good, schema), str(out), ".ko.srt")
    assert names(out) == sorted(f"m{n}.ko.srt" for n in range(40)) and (out / "m7.ko.srt").read_text() == good[7][1]
    for bad in ([("k", "1\nx\na\n", 2)], [("k", "", None), ("k", "", None)], [("a/b", "", None)], [("", "", None)]):
        empty = tmp_path / "bad"
        with pytest.raises(Exception, match="blocks|twice|name"):
            sinks.write_texts(spark.createDataFrame([(f"g{n}", "1\nx\na\n", 1) for n in range(20)] + bad, schema), str(empty))
        assert not empty.exists() or names(empty) == []  # nothing of the good ones either
    with pytest.raises(Exception, match="m3"):
        sinks.write_texts(spark.createDataFrame([("m3", "new", None), ("n", "new", None)], schema), str(out), ".ko.srt")
    assert "n.ko.srt" not in names(out) and (out / "m3.ko.srt").read_text() == good[3][1]
    sinks.write_texts(spark.createDataFrame([("m3", "new", None), ("n", None, None)], schema), f"file://{out}", ".ko.srt", mode="overwrite")
    assert (out / "m3.ko.srt").read_text() == "new" and (out / "n.ko.srt").read_text() == "" and len(names(out)) == 41


def test_translated_files_have_a_block_for_each_entry(spark, tmp_path):
    entries = [("m", 1, "00:00:01,000 --> 00:00:02,000", "[1] eins"), ("m", 2, "00:00:03,000 --> 00:00:04,000", "zwei")]
    schema = "media_id string, seq long, timecode string, translation string"
    subtitles.write_translated_srt(spark.createDataFrame(entries, schema), str(tmp_path / "out"))
    assert (tmp_path / "out" / "m.ko.srt").read_text() == "1\n00:00:01,000 --> 00:00:02,000\neins\n\n2\n00:00:03,000 --> 00:00:04,000\nzwei\n"
    with pytest.raises(Exception, match="blocks"):
        subtitles.write_translated_srt(spark.createDataFrame([*entries, ("n", 1, "x", "a\n\nb")], schema), str(tmp_path / "no"))
    assert not (tmp_path / "no").exists() or names(tmp_path / "no") == []


def test_wav(spark, tmp_path):
    with wave.open(str(tmp_path / "a.wav"), "wb") as file:
        file.setnchannels(2)
        file.setsampwidth(2)
        file.setframerate(1000)
        file.writeframes(np.array([[n, -1] for n in range(2500)], "<i2").tobytes())
    (tmp_path / "b.wav").write_bytes(b"not audio")
    (tmp_path / "c.txt").write_text("x")
    got = media.scan_wav(spark, str(tmp_path), 1000).orderBy("media_id", "block_no").collect()
    assert [(r.media_id, r.block_no, len(r.samples or [])) for r in got] == [("a", 0, 1000), ("a", 1, 1000), ("a", 2, 500), ("b", 0, 0)]
    assert got[1].samples[0] == 1000 and got[3].error
    assert {r.media_id for r in media.scan_media(spark, str(tmp_path)).collect()} == {"a", "b"}


def write_wav(path, samples, channels=1, rate=1000, width=2):
    with wave.open(str(path), "wb") as file:
        file.setnchannels(channels)
        file.setsampwidth(width)
        file.setframerate(rate)
        file.writeframes(samples.tobytes())


@pytest.mark.parametrize("range_bytes", [1 << 20, 5000, 777])
def test_wav_ranges(spark, tmp_path, range_bytes):
    chance = np.random.default_rng(2)
    long = chance.integers(-9999, 9999, (20_000, 2)).astype("<i2")
    write_wav(tmp_path / "long.wav", long, 2)
    write_wav(tmp_path / "Short.WAV", long[:70, 0], 1, 8000)
    write_wav(tmp_path / "none.wav", long[:0])
    write_wav(tmp_path / "bytes.wav", long[:10].astype("u1"), 1, 1000, 1)
    whole = (tmp_path / "long.wav").read_bytes()
    (tmp_path / "cut.wav").write_bytes(whole[:9001])
    (tmp_path / "head.wav").write_bytes(whole[:20])
    (tmp_path / "empty.wav").write_bytes(b"")
    piped = bytearray(whole)
    piped[40:44] = b"\xff\xff\xff\xff"
    (tmp_path / "piped.wav").write_bytes(piped)
    (tmp_path / "listed.wav").write_bytes(whole[:12] + b"LIST\x03\0\0\0abc\0" + whole[12:])
    (tmp_path / "sub").mkdir()
    write_wav(tmp_path / "sub" / "deep.wav", long[:5, 0])
    found = media.scan_wav(spark, str(tmp_path), 300, range_bytes=range_bytes)
    rows = {}
    for r in found.collect():
        rows.setdefault(r.media_id, []).append(r)
    heard = {m: np.concatenate([np.array(r.samples) for r in sorted(own, key=lambda r: r.block_no) if r.error is None] or [[]]) for m, own in rows.items()}
    for name in ("long", "piped", "listed"):
        assert (heard[name] == long[:, 0]).all() and [r.first_sample for r in sorted(rows[name], key=lambda r: r.block_no)] == list(range(0, 20_000, 300))
    assert (heard["Short"] == long[:70, 0]).all() and rows["Short"][0].sample_rate == 8000 and "none" not in rows and "deep" not in rows
    errors = {m: [r.error for r in own if r.error] for m, own in rows.items()}
    assert all(len(errors[m]) == 1 and len(rows[m]) == 1 for m in ("bytes", "head", "empty"))
    assert len(errors["cut"]) == 1 and "missing" in errors["cut"][0] and (heard["cut"] == long[: (9001 - 44) // 4, 0]).all()
    assert len(media.scan_wav(spark, str(tmp_path), recurse=True).where("media_id = 'deep'").first().samples) == 5
    if range_bytes == 5000:  # a file of 80,044 bytes spreads over tasks of a range each
        assert found.where("media_id = 'long'").select(F.spark_partition_id().alias("p")).distinct().count() >= 16


def raw(spark, *values):
    return spark.createDataFrame([("m", n, json.dumps(v)) for n, v in enumerate(values)], "media_id string, segment_no int, raw string")


def test_raw_chunks(spark):
    first = {"chunks": [{"timestamp": [1, None], "text": "a"}, {"timestamps": {"start": None, "end": 2.5}, "text": "b"}, {"text": "c"}, {"timestamp": [], "timestamps": [3, 4], "text": "d"}, {"timestamp": "x", "text": "e"}]}
    second = {"text": "t", "chunks/SPEAKER_00": [{"timestamp": [0, 1], "text": "f"}, 7], "chunks/SPEAKER_01": [{"timestamp": [1, 2], "text": "g"}]}
    got = [(r.segment_no, r.start_s, r.end_s, r.text, r.valid) for r in recognition.explode_raw_chunks(raw(spark, first, second)).orderBy("segment_no", "seq").collect()]
    assert got == [(0, 1.0, 1.0, "a", True), (0, 0.0, 2.5, "b", True), (0, 3.0, 4.0, "d", True), (0, None, None, "e", False), (1, 0.0, 1.0, "f", True), (1, 1.0, 2.0, "g", True)]


def test_adapters(spark):
    items = [{"text": "a", "start_time": 0, "end_time": 1}, {"word": "b", "start": "1", "end": "1"}, ["c", 2, 3], {"unit": "d", "timestamp": [3, 4]}, {"text": "bad", "start": "x", "end": 1}]
    words = spark.createDataFrame([("m", json.dumps(items), "all", 9.0), ("n", "[]", "whole", 9.0), ("o", None, "", None)], "media_id string, items string, text string, duration_s double")
    got = [(r.media_id, r.start_s, r.end_s, r.text) for r in recognition.adapt_word_timestamps(words).orderBy("media_id", "seq").collect()]
    assert got == [("m", 0.0, 1.0, "a"), ("m", 1.0, 1.01, "b"), ("m", 2.0, 3.0, "c"), ("m", 3.0, 4.0, "d"), ("n", 0.0, 9.0, "whole")]
    segments = [("m", json.dumps([{"text": " a ", "start": 0, "end": 2}, {"text": " "}]), None, "x", 5.0), ("n", None, json.dumps([{"text": "b", "timestamp": [1, 2]}]), "x", 5.0), ("o", "[]", None, " y ", None)]
    table = spark.createDataFrame(segments, "media_id string, segments string, chunks string, text string, duration_s double")
    got = [(r.media_id, r.start_s, r.end_s, r.text) for r in recognition.adapt_segments(table).orderBy("media_id").collect()]
    assert got == [("m", 0.0, 2.0, "a"), ("n", 1.0, 2.0, "b"), ("o", 0.0, 0.01, "y")]
    got = [(r.media_id, r.start_s, r.end_s, r.text) for r in recognition.adapt_plain_segments(table.where("media_id <> 'n'")).orderBy("media_id").collect()]
    assert got == [("m", 0.0, 2.0, "a"), ("o", 0.0, 0.01, "y")]


def test_reports(spark, tmp_path):
    (tmp_path / "a.process.json").write_text(json.dumps({"status": "success", "media_duration_seconds": 1000, "processing_seconds": "125"}, indent=1))
    (tmp_path / "b.process.json").write_text("broken")
    (tmp_path / "a.translation.json").write_text(json.dumps({"status": "success", "subtitle_count": 200, "processing_seconds": 50, "batch_translate": True}))
    from timeloom.operators import history

    runs = history.transcription_samples(reports.scan_process_history(spark, str(tmp_path))).collect()
    assert [r.realtime_factor for r in runs] == [0.125]
    assert history.translation_samples(reports.scan_translation_history(spark, str(tmp_path))).first().seconds_per_subtitle == 0.25


def test_job_options(spark):
    given = ['{"silence_threshold_db": "-35dB", "min_silence_duration_s": 0.5, "delete_source_on_success": true}', '{"silence_threshold_db": "loud"}', '{"min_silence_duration_s": 0}', "[1]", "{}"]
    table = spark.createDataFrame([(str(n), x) for n, x in enumerate(given)], "media_id string, options string")
    got = {r.media_id: r for r in reports.parse_job_options(table).collect()}
    assert got["0"].min_silence_duration_s == 0.5 and got["0"].delete_source_on_success is True and got["0"].reason is None
    assert all(got[n].reason for n in "123") and got["4"].reason is None


def test_span_report(spark):
    table = spark.createDataFrame([("m", 1, 0.12345, 1.0)], "media_id string, seq long, start_s double, end_s double")
    assert span_report(table).first().spans[0].asDict() == {"start": 0.123, "end": 1.0, "duration": 0.877}
    assert reports.vad_report(table, table, {"engine": "x"}).first().parameters == {"engine": "x"}


def test_reports_tell_spans_apart_that_round_alike(spark, tmp_path):
    found = [(1, "2024-01-01 00:10:00", 7, "error", 1.0), (2, "2024-01-01 00:10:01", 7, "view", 1.0), (3, "2024-01-01 01:00:00", 7, "view", 2.0)]
    table = spark.createDataFrame(found, "event_id long, at string, user_id long, event_type string, value double")
    table.withColumn("ts", F.col("at").cast("timestamp_ntz")).drop("at").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.seq: (r.start_ds, r.end_ds, r.transcribed) for r in QUERIES["vad_reports"](spark, str(tmp_path)).collect()}
    assert got == {1: (6, 7, True), 2: (6, 7, False), 3: (36, 38, False)}


def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    seen = [{"path": "a.mp4", "size": 5, "mtime": "2024-01-01 00:00:00", "observed_at": f"2024-01-01 00:01:0{n}"} for n in range(4)]
    seen += [{"path": "b.mp4", "size": n, "mtime": "2024-01-01 00:00:00", "observed_at": f"2024-01-01 00:01:0{n}"} for n in range(4)]
    (source / "1.json").write_text("\n".join(map(json.dumps, seen)))
    schema = "path string, size long, mtime timestamp, observed_at timestamp"
    stream = spark.readStream.schema(schema).json(str(source))
    query = watch.stable_file_stream(stream, checks=3).writeStream.format("memory").queryName("stable").outputMode("append").trigger(once=True).start()
    assert query.awaitTermination(60)
    assert [r.path for r in spark.table("stable").collect()] == ["a.mp4"]
    assert [r.path for r in watch.stable_files(spark.read.schema(schema).json(str(source)), 3).collect()] == ["a.mp4"]
    counted = watch.attempt_counts(stream.select(F.col("path").alias("name"))).writeStream.format("memory").queryName("tries").outputMode("complete").trigger(once=True).start()
    assert counted.awaitTermination(60)
    assert {(r.name, r.attempts, r.failed) for r in spark.table("tries").collect()} == {("a.mp4", 4, True), ("b.mp4", 4, True)}


def test_arriving_files(spark, tmp_path):
    """A file that grows is held back; once it rests for the polls asked for, it is reported, once."""
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "rest.mp4").write_bytes(b"x" * 10)
    (folder / "empty.mp4").write_bytes(b"")
    (folder / "note.txt").write_bytes(b"x")
    (folder / ".hidden.mp4").write_bytes(b"x")
    (folder / "copy.mp4.part").write_bytes(b"x")
    grows = folder / "grows.mp4"
    found = watch.new_media(spark, [str(folder)], poll_s=0.1, checks=3, min_age_s=0.0)
    query = found.writeStream.format("memory").queryName("arrived").outputMode("append").trigger(processingTime="300 milliseconds").start()
    told = lambda: [r.path.rsplit("/", 1)[1] for r in spark.table("arrived").collect()]
    try:
        for n in range(200):
            if n < 200 and "rest.mp4" not in told():
                grows.write_bytes(b"x" * (n + 1))
            else:
                break
            time.sleep(0.2)
        assert told() == ["rest.mp4"]
        for _ in range(200):
            if "grows.mp4" in told():
                break
            time.sleep(0.2)
        assert sorted(told()) == ["grows.mp4", "rest.mp4"]
        seen = query.lastProgress.batchId
        while query.lastProgress.batchId < seen + 3:
            time.sleep(0.2)
        assert len(told()) == 2
    finally:
        query.stop()


def test_cue_stream(spark, tmp_path):
    """Segments of a media that come in two batches give what they give together; one that lacks some is given up."""
    source = tmp_path / "raw"
    source.mkdir()
    chunk = lambda at, text: {"timestamp": [at, at + 0.3], "text": text}
    results = {("m", 0): [chunk(0, "Hello"), chunk(0.35, "world.")], ("m", 1): [chunk(9, "Again"), chunk(9.3, "and")], ("n", 0): [chunk(1, "one.")], ("n", 1): [chunk(2, "two.")], ("o", 0): [chunk(1, "alone")]}
    lines = {k: json.dumps({"media_id": k[0], "segment_no": k[1], "segments": 1 + (k[0] != "x"), "raw": json.dumps({"chunks": v})}) for k, v in results.items()}
    schema = "media_id string, segment_no int, segments int, raw string"
    cues, left = [], []

    def sink(found, issues, given_up):
        cues.append(sorted((r.media_id, r.seq, r.start_s, r.end_s, r.text) for r in found.collect()))
        left.extend((r.media_id, r.segment_no) for r in given_up.collect())
        assert issues.columns[:2] == ["media_id", "idx"]

    def batch(number, *keys, patience_s=3600.0):
        (source / f"{number}.json").write_text("\n".join(lines[k] for k in keys))
        stream = spark.readStream.schema(schema).json(str(source))
        assert watch.cue_stream(stream, sink, str(tmp_path / "ck"), patience_s, {"once": True}).awaitTermination(180)

    batch(1, ("m", 1), ("n", 0), ("o", 0), patience_s=1.0)
    assert not any(cues)
    batch(2, ("m", 0), ("n", 0))
    batch(3, ("n", 1), ("m", 1))
    raw_table = spark.createDataFrame([(*k, json.dumps({"chunks": v})) for k, v in results.items() if k[0] != "o"], "media_id string, segment_no int, raw string")
    want = watch.C.group_cues(watch.C.repair_chunks(watch.C.concat_segments(recognition.explode_raw_chunks(raw_table))))
    want = sorted((r.media_id, r.seq, r.start_s, r.end_s, r.text) for r in want.collect())
    assert sorted(row for own in cues for row in own) == want and {r[0] for r in want} == {"m", "n"}
    assert left == [("o", 0)]


def test_health_and_progress(spark):
    beats = spark.createDataFrame([("w", "2024-01-01 00:00:00", "ready", True, True, True), ("v", "2024-01-01 00:05:00", "ready", True, False, True)], "worker string, updated_at string, status string, model_loaded boolean, gpu_available boolean, watcher_running boolean")
    got = {r.worker: r.reason for r in watch.worker_health(beats, "2024-01-01 00:05:30").collect()}
    assert got == {"w": "stale", "v": "bad gpu_available"}


def test_media_below_a_folder(spark, tmp_path):
    for path in ("a.mp4", "b.WAV", "c.txt", "x/d.mkv", "x/y/e.mp3", "x/.f.mp4.part"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(b"12345")
    found = lambda recurse: sorted((r.media_id, r.ext, r.size) for r in media.scan_media(spark, str(tmp_path), recurse).collect())
    assert found(False) == [("a", "mp4", 5), ("b", "wav", 5)]
    assert found(True) == [("a", "mp4", 5), ("b", "wav", 5), ("d", "mkv", 5), ("e", "mp3", 5)]


def test_quality_report(spark):
    cue = "media_id string, seq long, start_s double, end_s double, text string"
    rows = spark.createDataFrame([("m", 1, 0.0, 20.0, "a long text that stands for twenty seconds. and more"), ("m", 2, 20.0, 20.1, "..."), ("n", 1, 0.0, 2.0, "fine")], cue)
    issues = quality.quality_issues(rows)
    _, dropped = quality.split_hallucinations(rows)
    none = issues.limit(0)
    report = {r.media_id: r for r in quality.quality_report(rows, issues, dropped, none, none).collect()}
    assert (report["m"].cue_count, report["m"].issues_count, report["m"].dropped_count, report["m"].split_count) == (2, 2, 1, 0)
    assert [x.idx for x in report["m"].issues] == [1, 2] and report["m"].dropped[0].text == "..."
    assert (report["n"].cue_count, report["n"].issues_count) == (1, 0) and report["n"].issues is None


def test_quarantine(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", None), ("c", -1)], "media_id string, n int")
    reason = F.when(F.col("n").isNull(), "no number").when(F.col("n") < 0, "below zero")
    good, bad = jobs.split_failures(rows, reason)
    assert [r.media_id for r in good.collect()] == ["a"] and good.columns == rows.columns
    reports.write_quarantine(bad, str(tmp_path / "q"))
    reports.write_quarantine(bad.where("n < 0"), str(tmp_path / "q"))
    kept = spark.read.json(str(tmp_path / "q")).collect()
    assert sorted((r.reason, r.media_id) for r in kept) == [("below zero", "c"), ("below zero", "c"), ("no number", "b")]


def test_paths_in_flight_once(spark, tmp_path):
    source = tmp_path / "seen"
    source.mkdir()
    line = lambda path, at: json.dumps({"path": path, "seen_at": f"2024-01-01 00:{at:02d}:00"})
    schema = "path string, seen_at timestamp"

    def told(number, *lines):
        (source / f"{number}.json").write_text("\n".join(lines))
        once = watch.in_flight_once(spark.readStream.schema(schema).json(str(source)), "10 minutes")
        out = []
        query = once.writeStream.foreachBatch(lambda batch, _: out.extend(r.path for r in batch.collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        return sorted(out)

    assert told(1, line("a", 0), line("a", 1), line("b", 1)) == ["a", "b"]
    assert told(2, line("a", 5), line("c", 5)) == ["c"]
    assert told(3, line("d", 40)) == ["d"]
    assert told(4, line("a", 41)) == ["a"]  # forgotten by then


def test_strict_subtitles(spark):
    texts = spark.createDataFrame([("a", "1\n00:00:01,000 --> 00:00:02,000\nx\n"), ("b", "1\nno time\nx\n"), ("c", ""), ("d", None)], "media_id string, body string")
    entries, errors = subtitles.strict_entries(texts)
    assert [(r.media_id, r.text) for r in entries.collect()] == [("a", "x")]
    assert sorted((r.media_id, r.reason) for r in errors.collect()) == [(m, "no subtitle entries") for m in "bcd"]
