"""Personal data: the rules against Python's re, the bootstrap against dictionaries, and planted contexts."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
import regex
from pyspark.sql import functions as F

from turnwise.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(number):
    each = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(number))]
    return sum(x - 9 * (x > 9) for x in each) % 10 == 0


def fine(kind, said):
    number = re.sub("[^0-9]", "", said)
    return {
        "email": lambda: True,
        "ip": lambda: all(int(p) <= 255 for p in said.split(".")),
        "card": lambda: 12 <= len(number) <= 19 and luhn(number),
        "phone": lambda: 9 <= len(number) <= 15,
    }[kind]()


def base(text):
    return sorted((m.start(), k, m.end()) for k, kind in enumerate(PLAIN) for m in re.finditer(PLAIN[kind], text or "") if fine(kind, m.group()))


def brute_force(texts, rounds=pii.ROUNDS):
    """Spans of each text, by the docstring's formulas over dictionaries."""
    loose = regex.compile(pii.LOOSE, regex.ASCII)
    split = re.compile(r"[^\x20\x09-\x0D]+")
    found, edges, other = [], defaultdict(Counter), Counter()
    seeds, shapes = {}, {}

    def keys(w, i):
        return [(w[i - 1], "_"), (w[i - 2], w[i - 1], "_"), (w[i - 1], "_", w[i + 1])]

    for t, text in enumerate(texts):
        text = (text or "").replace(pii.SLOT, " ")
        marked = loose.sub(f" {pii.SLOT} ", text).lower().translate(str.maketrans("123456789", "0" * 9))
        w = ["^", "^", *[x[: pii.LONGEST_WORD] for x in split.findall(marked)], "$"]
        at = [i for i, x in enumerate(w) if x == pii.SLOT]
        for m, i in zip(loose.finditer(text), at, strict=True):
            said = m.group()
            value = re.sub(r"[\s()+/-]+", "", said).lower()
            for k, kind in reversed(list(enumerate(PLAIN))):
                if re.fullmatch(PLAIN[kind], said) and fine(kind, said):
                    seeds[value] = min(k, seeds.get(value, k))
            mine = {k for k, kind in enumerate(pii.SHAPES) if regex.fullmatch(pii.SHAPES[kind], said, regex.ASCII)}
            shapes[value] = shapes.get(value, set()) | mine
            found.append((t, m.start(), m.end(), mine, keys(w, i)))
            for p in keys(w, i):
                edges[p][value] += 1
        for i in range(2, len(w) - 1):
            if w[i] != pii.SLOT:
                other.update(keys(w, i))
    edges = {p: vs for p, vs in edges.items() if len(vs) >= pii.LEAST_SEEDS}
    held = {v: {k: 1.0} for v, k in seeds.items()}
    for _ in range(rounds):
        scores = {}
        for p, vs in edges.items():
            best = {v: max(held.get(v, {0: 0}).values()) for v in vs}
            whole = sum(n * (best[v] + pii.UNSURE * (1 - best[v])) for v, n in vs.items()) + other[p] + pii.PRIOR
            for k in range(4):
                r = {v: held.get(v, {}).get(k, 0) for v in vs}
                n = sum(x >= pii.SURE for x in r.values())
                if n >= pii.LEAST_SEEDS:
                    scores[p, k] = sum(vs[v] * r[v] for v in vs) / whole
        held = {v: {k: 1.0} for v, k in seeds.items()}
        for (p, k), s in scores.items():
            for v in edges[p]:
                if v not in seeds and k in shapes[v]:
                    mine = held.setdefault(v, {})
                    mine[k] = max(mine.get(k, 0), s)
    out = [base(text) for text in texts]
    spans = [list(x) for x in out]
    for t, start, end, mine, ps in found:
        good = [(s, -k) for p in ps for k in mine if (s := scores.get((p, k), 0)) >= pii.SURE]
        if good and not any(a < end and start < b for a, _, b in out[t]):
            spans[t].append((start, -max(good)[1], end))
    return out, [sorted(x) for x in spans]


def told(spans):
    return ",".join(f"{list(PLAIN)[k]}:{a}:{b}" for a, k, b in spans)


def check(spark, texts):
    rows = [(i, t, 0, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key long, base string").repartition(3)
    got = {r.doc_id: r for r in pii.op11(spark, df).collect()}
    assert len(got) == len(texts)
    bases, spans = brute_force(texts)
    for i, r in got.items():
        assert [r[f"n_{kind}"] for kind in PLAIN] == [sum(k == j for _, j, _ in bases[i]) for k in range(4)], texts[i]
        assert r.base_sha256 == hashlib.sha256(told(bases[i]).encode()).hexdigest(), texts[i]
        assert r.spans == told(spans[i]), texts[i]
    return {i: r.spans for i, r in got.items()}


ODD = [
    None, "", " \n", "a@b.c_foo@x.y.z@q.w", "a@b@c.d", "@x.y", "1.2.3.4.5.6.7.8", "256.1.1.1 0000255.1.1.01 1.2.3", "+1 (017) 555-7713 +49-30-901820.", "+1234567 8 ",
    "4111 1111 1111 1111 4111111111111111", "4111111111111111x4111-1111-1111-1112", "0 0 0 0 0 0 0 0 0 0 0 0", "+4111111111111111", "ä ö 😀 me@host.example.com 😀 10.0.0.1",
    "x" * 900, "1" * 900, "1-" * 500 + "1", "a." * 500 + "@b.c", "b@" + "c." * 500 + "d", "+" * 500 + "1" * 9, "1." * 500 + "1",
    " ".join(f"10.0.{i % 256}.{i // 256}" for i in range(900)), f"a {pii.SLOT} 12345678 b{pii.SLOT}c@d.e", "name (at) host.com", "same", "same", "0::1 fe80::1:2:3",
]


def test_rules_on_odd_texts(spark):
    check(spark, ODD)


def test_long_runs_take_linear_time_and_no_stack(spark):
    texts = ["x" * 300_000, "1" * 300_000, "1-" * 150_000 + "1", "a." * 150_000 + "@b.c", "b@" + "c." * 150_000 + "d", "+" * 150_000 + "1" * 9, "1." * 150_001 + "1", "x@" * 150_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone) for r in pii.op11(spark, rows).collect()}
    assert got == {0: (0, 0, 0, 0), 1: (0, 0, 0, 0), 2: (0, 0, 0, 0), 3: (1, 0, 0, 0), 4: (1, 0, 0, 0), 5: (0, 0, 0, 1), 6: (0, 37_500, 0, 0), 7: (0, 0, 0, 0)}


def planted():
    texts = [f"Well, {a} reach our desk under +1 (555) 010-{4000 + i} by noon, {a}." for i, a in enumerate(("please", "do", "always", "kindly", "just"))]
    texts += ["You may reach our desk under (555) 010-7777 by night.", "Reach our desk under 555-010-8888 or not."]
    # the second pattern has only what the first one finds
    texts += [f"dial straight {v} {w}" for v in ("(555) 010-7777", "555-010-8888") for w in ("now", "later")]
    texts += ["They reach our desk under 555-010-9999 again.", "dial straight 555-010-9999 never", "So dial straight 555-010-6666 then"]
    # ordinary words and numbers in common contexts
    texts += [f"the order number 55501{i}44 of the {w} came at 555-010-{1000 + i}" for i, w in enumerate(("house", "tree", "hill", "lake") * 5)]
    texts += [f"came at {w} with the order number and number of things" for w in ("dawn", "dusk", "night", "last")] * 6
    texts += [f"came at +1 (555) 011-{1000 + i} twice" for i in range(4)]
    return texts


def test_contexts_discover(spark):
    texts = planted()
    spans = check(spark, texts)
    by_text = {texts[i]: s for i, s in spans.items()}
    assert by_text["You may reach our desk under (555) 010-7777 by night."] == "phone:29:43"
    assert by_text["So dial straight 555-010-6666 then"] == "phone:17:29"
    assert not any(s for t, s in by_text.items() if t.startswith("the order number"))


def test_on_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    check(spark, texts + [t.replace("+", "").replace("@", " @ ") for t in texts if t and "@" in t])


def test_repeated_rows_and_nothing(spark):
    rows = [(1, "to me@host.org or +1 555 010 1234"), (1, "to me@host.org or +1 555 010 1234"), (None, "10.0.0.1"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter((r.doc_id, r.spans) for r in pii.op11(spark, df).collect()) == Counter([(1, "email:3:14,phone:18:33")] * 2 + [(None, "ip:0:8"), (None, "")])
    assert pii.op11(spark, df.where("false")).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 99, 100, 101])
def test_running_sums(spark, n):
    row = spark.range(1).select(F.expr(f"transform(sequence(0, {n}), x -> x)").alias("_x")).select(F.expr(f"slice(_x, 1, {n})").alias("x"))
    assert row.select(F.expr(pii.running("x")).alias("s")).first().s == [k * (k + 1) // 2 for k in range(n)]
