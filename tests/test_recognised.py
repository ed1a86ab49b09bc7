"""Segments and words of a recording to turns."""

from turnwise.plans import recognised as r


def test_words_to_turns(spark):
    segments = spark.createDataFrame([("c", 0.0, 1.0, "A"), ("c", 1.2, 2.0, "B"), ("c", 2.5, 3.0, "A"), ("c", 3.0, 3.0, "B")], "call_id string, start double, end double, speaker string")
    speaking = r.roles(segments)
    assert {x.speaker: x.role for x in speaking.collect()} == {"A": "agent", "B": "caller"}
    flipped = r.roles(segments, spark.createDataFrame([("c", "B")], "call_id string, speaker string"))
    assert {x.speaker: x.role for x in flipped.collect()} == {"A": "caller", "B": "agent"}
    utterances = r.diarized(segments, speaking)
    assert utterances.count() == 3
    words = spark.createDataFrame([("c", 0.1, 0.3, "hello"), ("c", 1.3, 1.5, "hi"), ("c", 1.6, 1.8, "there"), ("c", 2.6, 2.8, "bye"), ("c", 9.0, 9.2, "lost")], "call_id string, start double, end double, text string")
    named = r.attributed(words, segments, speaking)
    assert [x.channel for x in named.orderBy("start").collect()] == ["agent", "caller", "caller", "agent", "caller"]
    got = r.turns(r.spoken(utterances, named)).orderBy("turn_index").collect()
    assert [(x.transcript, x.llm_spoken, x.response_ms) for x in got] == [(None, "hello", None), ("hi there", "bye", 500.0)]
