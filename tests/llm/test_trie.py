"""The conversation prefix trie against a dictionary of prefixes, with odd rows."""

import hashlib
import zlib
from collections import defaultdict

import pytest

from turnwise.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, node long, depth long"


def brute_force(rows):
    own = defaultdict(list)
    for conv_id, turn, role, text, *_ in rows:
        if conv_id is not None:
            own[conv_id].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        five = c - (abs(c) % 5) * (1 if c > 0 else -1)
        whole[c] = own.get(five, [])[:h] + v[h:]
    members, children = defaultdict(list), defaultdict(set)
    for c, v in whole.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
            if d:
                children[tuple(v[: d - 1])].add(tuple(v[:d]))
    leaves, saved, out = {}, {}, set()
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in children[k]) or 1
        saved[k] = (len(members[k]) - 1) * (len(k[-1][1].encode()) if k else 0) + sum(saved[x] for x in children[k])
        ended = ",".join(str(c) for c in sorted(members[k]) if len(whole[c]) == len(k))
        up = min(members[k[:-1]]) if k else None
        out.add((min(members[k]), len(k), up, len(members[k]), len(children[k]), leaves[k], saved[k], hashlib.sha256(ended.encode()).hexdigest()))
    return out


def got(spark, rows):
    df = trie.op12(spark, spark.createDataFrame(rows, SCHEMA).repartition(3))
    found = [tuple(r) for r in df.collect()]
    assert len(set(found)) == len(found)
    return set(found)


ROWS = [
    *[(c, t, "user" if t % 2 else "assistant", f"text {t if t < 5 else t * (c % 3)} ä", 1, 1) for c in range(40) for t in range(9 + c % 4)],
    *[(c, t, "user", "the same", 1, 1) for c in range(100, 160) for t in range(5)],
    (200, None, None, None, 0, 0), (200, 1, "user", "x" * 70_000, 0, 0), (200, 1, "user", "x" * 70_000, 0, 0), (200, 1, "system", "tie", 0, 0),
    (-3, 0, "user", "below zero", 0, 0), (-5, 0, "user", "below zero", 0, 0), (None, 0, "user", "nobody's", 0, 0), (None, 0, "user", "nobody's", 0, 0),
    *[(c, t, "user", f"long {t // 3}", 0, 0) for c in (300, 301) for t in range(40 + c % 2)],
    (9_223_372_036_854_775_807, 0, "user", "last", 0, 0), (-9_223_372_036_854_775_808, 0, "user", "first", 0, 0),
]


def test_trie_of_odd_rows(spark):
    assert got(spark, ROWS) == brute_force(ROWS)


def test_lists_longer_than_a_part(spark, monkeypatch):
    monkeypatch.setattr(trie, "LIST", 7)
    rows = [(c, t, "user", "one and the same", 0, 0) for c in range(500) for t in range(3)]
    assert got(spark, rows) == brute_force(rows)


@pytest.mark.parametrize("rows", [[], [(5, 0, "user", "alone", 0, 0)], [(None, 0, "user", "nobody's", 0, 0)]])
def test_trie_of_few_rows(spark, rows):
    assert got(spark, rows) == brute_force(rows)


def test_trie_of_turnless_conversations(spark):
    """An absent first of five gives nothing, so short conversations of others lose all their turns."""
    rows = [(c, 0, "user", "gone", 0, 0) for c in range(1001, 1400) if c % 5]
    want = brute_force(rows)
    assert got(spark, rows) == want and any(r[1] == 0 and r[3] > 300 for r in want)
