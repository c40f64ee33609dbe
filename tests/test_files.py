import io
import json
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.functions import audio
from marlstone.sources import files, sinks


def test_metadata_csv(spark, tmp_path):
    (tmp_path / "m.csv").write_text(',set,set,track,track,track,artist\n,split,subset,genre_top,title,duration,name\ntrack_id,,,,,,\n2,train,medium,Rock,"A, b",30,X\n10,train,small,Jazz,C,bad,Y\n')
    found = sorted(map(tuple, files.metadata_csv(spark, str(tmp_path / "m.csv")).collect()))
    assert found == [("10", "small", "Jazz", "C", None, "Y"), ("2", "medium", "Rock", "A, b", 30.0, "X")]
    (tmp_path / "n.csv").write_text("a,b\nc,d\n1,2\n")
    with pytest.raises(ValueError, match="missing"):
        files.metadata_csv(spark, str(tmp_path / "n.csv"))


def test_track_file(spark, tmp_path):
    track = {"track_id": "1", "title": "t", "artist": "a", "genre": "g", "duration": 1.5, "path": "p"}
    path = tmp_path / "t.json"
    path.write_text(json.dumps({"schema_version": 2, "record_type": "x", "provenance": {"a": "b"}, "tracks": [track, track | {"track_id": "2"}]}, indent=1))
    found = files.selected_tracks(spark, str(path))
    assert found.count() == 2
    titles = files.title_index(found.withColumn("position", F.col("track_id").cast("int")))
    assert [tuple(r) for r in titles.collect()] == [("t", "2")]
    for bad, what in (({"schema_version": 1, "tracks": [track]}, "schema_version"), ({"schema_version": 2, "tracks": [track, track]}, "repeated")):
        path.write_text(json.dumps(bad))
        with pytest.raises(Exception, match=what):
            files.selected_tracks(spark, str(path)).collect()


def test_ranking_rows_and_maps(spark, tmp_path):
    row = {"method": "m", "seed": 1, "user_id": "u", "query_track_id": "q", "recommendations": ["a", "b"], "relevance_ids": ["b"], "metrics": {"precision": {"5": 0.2}}}
    path = tmp_path / "r.jsonl"
    path.write_text(json.dumps(row) + "\n" + json.dumps(row | {"user_id": "v"}) + "\n")
    r = files.ranking_rows(spark, str(path))
    assert {tuple(x) for x in files.precision_by_user(r).collect()} == {("u", 0.2, "q"), ("v", 0.2, "q")}
    assert files.ranking_long(r).count() == 4
    path.write_text((json.dumps(row) + "\n") * 2)
    with pytest.raises(Exception, match="repeated user"):
        files.ranking_rows(spark, str(path)).collect()
    (tmp_path / "g.json").write_text('{"x": ["a", "b"],\n "y": []}')
    assert {r["key"]: r["value"] for r in files.json_map(spark, str(tmp_path / "g.json"), "array<string>").collect()} == {"x": ["a", "b"], "y": []}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", 0.1, True), ("a", None, False)], "x string, v double, ok boolean")
    at = str(tmp_path)
    sinks.write_new(df, at + "/p")
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        sinks.write_new(df, at + "/p")
    sinks.write_if_absent(df.limit(0), at + "/p")
    assert files.parquet(spark, at + "/p").count() == 2
    sinks.write_json_lines(df, at + "/j")
    assert sorted(r["value"] for r in spark.read.text(at + "/j").collect()) == ['{"x":"a","v":null,"ok":false}', '{"x":"b","v":0.1,"ok":true}']
    sinks.write_csv(df, at + "/c", ["ok", "v"])
    assert {tuple(r) for r in spark.read.csv(at + "/c", header=True).collect()} == {("true", "0.1"), ("false", None)}
    sinks.write_parts({"one": df, "two": df}, at + "/run")
    assert spark.read.parquet(at + "/run/two").count() == 2
    with pytest.raises(FileExistsError):
        sinks.write_parts({"one": df}, at + "/run")
    blocks = spark.createDataFrame([("a", "b", 0.5)], "a string, b string, score double")
    blocks.write.parquet(at + "/s/0"), blocks.write.parquet(at + "/s/1")
    assert files.similarity_blocks(spark, at + "/s").count() == 2
    good, failed = sinks.split_failures(spark.createDataFrame([("x", None), ("y", "bad")], "track_id string, reason_code string"), "track_id")
    assert good.count() == 1 and [tuple(r) for r in failed.collect()] == [("y", "bad")]
    assert sinks.canonical_json({"b": 1, "a": "é"}) == '{"a":"é","b":1}' and len(sinks.digest([1])) == 64
    with pytest.raises(ValueError):
        sinks.canonical_json(float("nan"))


def tone(hz, seconds=1.0, rate=audio.RATE, channels=1, level=0.5):
    x = (level * 32767 * np.sin(2 * np.pi * hz * np.arange(int(seconds * rate)) / rate)).astype("<i2")
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels), w.setsampwidth(2), w.setframerate(rate)
        w.writeframes(np.repeat(x, channels).tobytes())
    return out.getvalue()


def test_audio_features():
    f = audio.features(tone(440))
    middle = slice(5, -5)
    assert np.abs(f["pitch"][middle] - 440).max() < 3
    assert np.abs(f["rms"][middle] - 0.5 / np.sqrt(2)).max() < 0.01
    assert np.abs(f["centroid"][middle] - 440).max() < 60
    assert np.abs(f["zcr"][middle] - 2 * 440 / audio.RATE).max() < 0.002
    assert (np.argmax(np.array(f["chroma"])[:, middle], axis=0) == 9).all()
    assert np.array(f["mfcc"]).shape == (20, f["frames"])
    assert len(audio.decode_wav(tone(440, rate=44_100, channels=2))) == audio.RATE
    for data, reason in ((b"", "empty_file"), (b"nonsense", "decode_failed"), (tone(440, level=0.0), "silent_audio")):
        with pytest.raises(ValueError, match=reason):
            audio.features(data)


def test_audio_scan(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(tone(220, 0.3))
    (tmp_path / "b.wav").write_bytes(b"junk")
    found = audio.extract(spark.read.format("binaryFile").load(str(tmp_path)))
    rows = {r["path"][-5:]: r for r in found.collect()}
    assert rows["b.wav"]["reason_code"] == "decode_failed" and rows["a.wav"]["reason_code"] is None and rows["a.wav"]["frames"] > 10
    v = audio.traditional_vector(found).head()["vector"]
    assert len(v) == 72 and v[0] == pytest.approx(np.mean(rows["a.wav"]["mfcc"][0]))
