"""The filter audit against applying every order document by document."""

import re
from collections import defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from turnwise.llm import audit

DOCS = "doc_id long, text string, lang string, part string, good boolean, removed long"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
FINE = " ".join(f"word{i}" for i in range(250))
ROWS = [
    (1, None, "en"), (2, "", None), (3, "", ""), (4, LONG, "en"), (5, LONG, "de"), (5, LONG, "de"), (6, FINE, "de"), (7, FINE + " #", "de"), (8, FINE.upper(), "de"),
    (9, "a b c " * 80, "fr"), (10, "A B C " * 80, "fr"), (11, "A | " * 150, "fr"), (None, FINE, "fr"), (None, FINE, None), (12, FINE, "en"), (13, "Ä Ö Ü " * 100, "en"),
    (14, " \n\t ", "en"), (15, "one", "en"),
]
LABELS = [(1, 1, 0), (4, 1, 1), (5, 0, 1), (5, 1, 0), (7, 1, None), (9, None, 1), (11, 1, 1), (None, 1, 1), (99, 1, 1)]


def brute_force(rows, labels, names="ABCDE"):
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    ids = defaultdict(list)
    for i, t, _ in rows:
        if i is not None:
            ids[t or ""].append(i)
    docs = defaultdict(list)
    for i, t, lang in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and min(ids[t]) < i)
        docs[lang or ""].append((dict(zip("ABCDE", fails)), i in good, i in toxic))
    out = {}
    for part, all_of in docs.items():
        shapley = dict.fromkeys(names, 0)
        for order in permutations(names):
            left, gone = list(all_of), []
            for step, f in enumerate(order):
                here = [d for d in left if d[0][f]]
                redundant = sum(d[0][f] for d in gone)
                left = [d for d in left if not d[0][f]]
                gone += here
                only = sum(d[0][f] and sum(d[0][n] for n in names) == 1 for d in all_of)
                out[part, "".join(order), step + 1] = [len(left), len(here), redundant, only, sum(d[1] for d in here), sum(d[2] for d in here), f]
                shapley[f] += len(here)
        for k, v in out.items():
            if k[0] == part:
                v[-1] = shapley[v[-1]]
    return {(*k, *v) for k, v in out.items()}


def test_audit_of_odd_rows(spark):
    docs = spark.createDataFrame([(*r, "x", True, 0) for r in ROWS], DOCS).repartition(3)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = [tuple(r) for r in audit.audit(audit.flags(docs, labels), "ABCDE").collect()]
    assert len(got) == 5 * 600 - 600 and set(got) == brute_force(ROWS, LABELS)


def test_audit_of_nothing(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(audit.flags(docs, labels), "ABCDE").count() == 0


def test_each_state_is_visited_once(spark):
    rows = spark.range(50).select(F.lit("p").alias("part"), F.lit(False).alias("good"), F.lit(True).alias("toxic"), *[(F.col("id") % k == 0).alias(n) for n, k in zip("XYZ", (2, 3, 5))])
    seen = []
    audit.states(rows, "XYZ", seen.append)
    assert sorted(seen) == list(range(8)) and seen[:4] == [0, 1, 3, 7]
    with pytest.raises(ValueError, match="1 to 6 filters"):
        audit.audit(rows, "")
