"""Artifacts by decoder and mapping: charsets, broken objects, merged headers, mappings that are none."""

import pytest
from pyspark.sql import functions as F

from turnwise.plans import artifacts

OBJECT = "call_id string, ord int, uri string, rule string, decoder string, encoding string, content binary"
MAPPINGS = {
    "head": {"call": {"source": "$.a.source", "voice": "$.voice"}},
    "text": {"call": {"note": "$.text"}},
    "rows": {"spans": {"each": "$", "fields": {"span_id": "$.id", "t_start": "$.t", "stage": "$.s"}}},
    "talk": {"turns": {"each": "$.turns", "fields": {"speaker": "$.who", "text": "$.said", "sequence": "$.n"}}},
}
ROWS = [
    ("c1", 2, "u2", "head", "json", None, b'{"a": {"source": "late"}, "voice": "v"}'),
    ("c1", 1, "u1", "head", "json", None, b'{"a": {"source": "early"}, "voice": null}'),
    ("c1", 3, "u3", "rows", "records", None, b'{"id": 1, "t": "0.5"}\n\n {"id": "b", "t": "x", "s": "llm"}\r\n{"t": 3}'),
    ("c1", 4, "u4", "talk", "json", None, b'{"turns": [{"who": "agent", "said": "hi", "n": 7}, {"who": "robot", "said": "x"}]}'),
    ("c1", 0, "u0", "talk", "json", None, b'{"turns": [{"who": "caller", "said": "hello"}]}'),
    ("c2", 1, "u1", "text", "text", "iso-8859-1", "grüße".encode("latin-1")),
    ("c2", 2, "u2", "text", "text", None, b"\xff later"),
    ("c3", 1, "bad", "head", "json", None, b'{"a": '),
    ("c3", 2, "bad2", "rows", "records", None, b'{"id": 1}\nnope'),
    ("c3", 3, "bad3", "head", "json", None, b'{"b": 1}'),
    ("c3", 4, "bad4", "other", "json", None, b"{}"),
    ("c3", 5, "bad5", "head", "audio", None, b"RIFF"),
    ("c3", 6, "bad6", "head", "json", None, None),
    ("c4", 1, "utf", "text", "text", "utf-8", b"\xff!"),
]


def test_assembly(spark):
    rows = [tuple(bytearray(x) if isinstance(x, bytes) else x for x in r) for r in ROWS]
    found = artifacts.mapped(spark.createDataFrame(rows, OBJECT).repartition(3), MAPPINGS)
    heads = {r.call_id: r.header for r in artifacts.headers(found).collect()}
    assert heads == {
        "c1": {"source": "early", "voice": "v", "environment": "prod"}, "c2": {"note": "grüße", "source": "files", "environment": "prod"},
        "c3": {"source": "files", "environment": "prod"}, "c4": {"note": "�!", "source": "files", "environment": "prod"},
    }
    spans = {(r.call_id, r.span_id): (r.name, r.stage, r.t_start, r.turn_id, r.kind, r.text) for r in artifacts.spans(found).collect()}
    assert spans == {
        ("c1", "1"): ("1", "unknown", 0.5, None, None, None),
        ("c1", "b"): ("b", "llm", None, None, None, None),
        ("c1", "c1-tr-0"): ("transcript.line", "stt", None, "c1:t0", "transcript", "hello"),
        ("c1", "c1-tr-1"): ("transcript.line", "tts", None, "c1:t7", "llm_spoken", "hi"),
        ("c1", "c1-tr-2"): ("transcript.line", "unknown", None, "c1:t2", "text", "x"),
    }
    told = {r.call_id: r.reasons for r in artifacts.problems(found).collect()}
    assert told == {"c3": ["bad2: not decoded", "bad3: nothing mapped", "bad4: no mapping", "bad5: no decoder", "bad6: not decoded", "bad: not decoded"]}
    assert artifacts.headers(found.where(F.lit(False))).count() == 0


@pytest.mark.parametrize(
    "bad",
    [{"calls": {}}, {"call": {"x": "meta"}}, {"call": {"x": "$.a[*]"}}, {"call": {"x": "$.a'b"}}, {"call": {"x": "$" + ".a" * 300}}, {"spans": {"fields": {}}}, {"turns": {"each": "$", "fields": {"nope": "$.a"}}}, {"call": {"x": None}}],
)
def test_mappings_are_checked_first(bad):
    with pytest.raises(ValueError):
        artifacts.checked(bad)
