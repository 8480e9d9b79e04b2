"""Masks against expected outputs, windows of streams against tables, and what a mark refuses."""

import hashlib
import json
import time

import pytest
from pyspark.sql import functions as F

from axonlake.functions import basic
from axonlake.operators import scan, windows
from axonlake.streaming.align import Aligner


def kept(data: bytes) -> str:
    return f"[len={len(data)} sha256={hashlib.sha256(data).hexdigest()[:8]}]"


MASKS = [
    ("key sk-abcdefgh12345678 end", "key sk-[redacted] end"),
    ("Authorization: Bearer abc!def.ghi next", "Authorization: Bearer [redacted] next"),
    ("GET /x?token=abc123&y=1", "GET /x?token=[redacted]&y=1"),
    ("API_KEY=Q1w2E3 ApiKey=é, ok", "API_KEY=[redacted] ApiKey=[redacted] ok"),
    ('{"api_key": "abc", "n": 1}', '{"api_key": "[redacted]", "n": 1}'),
    ('{"password": "ab\\"cd-rest"}', '{"password": "[redacted]"}'),
    ('{"secret":"a\\\\", "x": "b"}', '{"secret":"[redacted]", "x": "b"}'),
    ("xsk-abcdefghij", "xsk-[redacted]"),
    ("sk-short", "sk-short"),
    ('{"raw_text": "hello", "k": 2}', '{"raw_text": "' + kept(b"hello") + '", "k": 2}'),
    ('{"audio":""} {"token" : "x"}', '{"audio":"' + kept(b"") + '"} {"token" : "[redacted]"}'),
    ('{"image": "a\\n\\t\\"\\\\\\u00e9\\U0001F600\\x41\\101"}', '{"image": "' + kept('a\n\t"\\é😀AA'.encode()) + '"}'),
    ('{"raw_text": "bad \\q escape"}', '{"raw_text": "' + kept(rb"bad \q escape") + '"}'),
    ('{"raw_text": "half \\ud83d\\ude00"}', '{"raw_text": "' + kept(rb"half \ud83d\ude00") + '"}'),
    ('{"raw_text": "a\nb\\n"}', '{"raw_text": "' + kept(b"a\nb\\n") + '"}'),
    ('{"raw_text": null}', '{"raw_text": null}'),
    ('{"token_reference": "sk-abc", "other": true}', '{"token_reference": "sk-abc", "other": true}'),
    ('{"raw_text": "' + "long é " * 5000 + '"}', '{"raw_text": "' + kept(("long é " * 5000).encode()) + '"}'),
    ('{"raw_text": "' + '\\"\\n' * 5000 + '"}', '{"raw_text": "' + kept(b'"\n' * 5000) + '"}'),
    ("long and clean " * 1000, "long and clean " * 1000),
    ("", ""),
    (None, None),
]


def test_masks(spark):
    df = spark.createDataFrame([(i, m[0]) for i, m in enumerate(MASKS)], "i int, t string")
    got = {r["i"]: r["m"] for r in df.select("i", basic.redact(F.col("t")).alias("m")).collect()}
    for i, (line, want) in enumerate(MASKS):
        assert got[i] == want, line


def test_no_mask_leaves_a_json_line_broken(spark):
    line = json.dumps({"raw_text": 'x "y" \\ \n é', "token": 'a"b', "n": [1, 2]})
    out = spark.createDataFrame([(line,)], "t string").select(basic.redact(F.col("t"))).first()[0]
    assert json.loads(out) == {"raw_text": kept('x "y" \\ \n é'.encode()), "token": "[redacted]", "n": [1, 2]}


EVENTS = [("a", "2024-01-01 00:00:00", 1.0), ("a", "2024-01-01 00:09:59", 2.0), ("a", "2024-01-01 00:20:00", 4.0), ("a", "2024-01-01 00:30:00", 8.0), ("a", "2024-01-01 00:40:01", 9.0), ("b", "2024-01-01 00:05:00", 16.0), ("b", "2024-01-01 00:05:00", 32.0), (None, "2024-01-01 00:00:00", 64.0)]
LATER = [("a", "2024-01-01 03:00:00", 0.5), ("b", "2024-01-01 03:00:00", 0.5)]


def table(spark, rows):
    return spark.createDataFrame(rows, "user string, at string, value double").select("user", F.to_timestamp("at").alias("ts"), "value")


def told(df):
    return sorted((tuple(map(str, r)) for r in df.collect()))


@pytest.mark.parametrize("most", [1_000_000, 2])
def test_sessions_of_a_table(spark, monkeypatch, most):
    monkeypatch.setattr(scan, "SERIES", most)
    got = told(windows.sessions(table(spark, EVENTS), ["user"], "10 minutes"))
    assert got == sorted([("a", "2024-01-01 00:00:00", "2024-01-01 00:19:59", "2", "3.0"), ("a", "2024-01-01 00:20:00", "2024-01-01 00:40:00", "2", "12.0"), ("a", "2024-01-01 00:40:01", "2024-01-01 00:50:01", "1", "9.0"), ("b", "2024-01-01 00:05:00", "2024-01-01 00:15:00", "2", "48.0"), ("None", "2024-01-01 00:00:00", "2024-01-01 00:10:00", "1", "64.0")])
    assert windows.sessions(table(spark, EVENTS).limit(0), ["user"], "10 minutes").count() == 0


def test_windows_of_a_stream_equal_those_of_the_table(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k, rows in enumerate([EVENTS[:3], EVENTS[3:], LATER]):
        table(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.01)
    stream = spark.readStream.schema(table(spark, []).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    forms = {"sliding": (windows.sliding(stream, ["user"], "30 minutes", "10 minutes", watermark="1 hour"), windows.sliding(table(spark, EVENTS), ["user"], "30 minutes", "10 minutes")), "sessions": (windows.session_stream(stream, ["user"], "10 minutes", "1 hour"), windows.sessions(table(spark, EVENTS), ["user"], "10 minutes"))}
    for name, (live, whole) in forms.items():
        q = live.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        assert told(spark.table(name)) == told(whole)


def test_a_mark_refuses_what_lies_beyond_it():
    with pytest.raises(ValueError, match="beyond the mark"):
        Aligner("hold", 2, strict=True).push([("sample", 95, 1, 0, 1.0), ("mark", 10, None, 0, None)])
    for strict, tick in ((True, 10), (False, 95)):
        assert Aligner("hold", 2, strict=strict).push([("sample", tick, 1, 0, 1.0), ("mark", 10, None, 0, None)]) == []
    with pytest.raises(ValueError, match="more than"):
        Aligner("hold", 2, 0, 100, output=50)
    with pytest.raises(ValueError, match="more than"):
        Aligner("hold", 2, output=50).push([("sample", 0, 1, 0, 1.0), ("mark", 400, None, 0, None)])
