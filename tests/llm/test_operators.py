"""The numbered operators against brute force, round trips and planted cases, with odd rows."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnwise.llm import chat, components, jaccard, language, lines, mixing, packing, quality, sharding, substrings, topk
from turnwise.session import shared_dir

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(20_000))
ODD = [
    (1, None, "en", "a", 0),
    (2, "", None, None, 0),
    (3, " \n\t ", "en", "a", 4),
    (4, "one", "en", "a", 3),
    (5, LONG, "en", "b", len(LONG)),
    (6, LONG, "en", "b", len(LONG)),
    (7, "a b c a b c a b c a b c a b c a b c a b c a b c a b c", "en", "b", 1),
    (8, "the same line\nthe same line\nThe SAME line!", "de", "b", 1),
    (8, "the same line\nthe same line\nThe SAME line!", "de", "b", 1),
    (9, "naïve café   déjà vu <|endoftext|> straße", "fr", None, 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").distinct().collect()]


# 1


def test_packing_is_whole_and_tight(spark, odd):
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(packing.VOCABULARY)
    rows = packing.op1(spark, odd).collect()
    want = Counter()
    for doc_id, text, *_ in ODD:
        ids = np.array(slow.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        for k, (at, p) in enumerate(packing.cut(ids, 1024)):
            want[doc_id, k, at, len(p), zlib.crc32(p.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(held) <= -(-sum(r.length for r in rows) // 1024) + 1


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    counts = Counter(rng.integers(1, 65, 500).tolist())
    patterns = packing.plan(dict(counts), 64)
    used = Counter()
    for pattern, n in patterns:
        assert sum(pattern) <= 64
        for p in pattern:
            used[p] += n
    assert used == counts
    plain = packing.best_fit(dict(counts), 64)
    assert sum(n for _, n in patterns) <= sum(n for _, n in plain) + 1


def test_exact_complements_come_first():
    assert dict(packing.plan({60: 5, 40: 5}, 100)) == {(60, 40): 5}
    assert dict(packing.plan({50: 2, 25: 2, 20: 1, 30: 1}, 100)) == {(50, 50): 1, (30, 25, 25, 20): 1} or sum(n for _, n in packing.plan({50: 2, 25: 2, 20: 1, 30: 1}, 100)) == 2


# 2


@pytest.mark.parametrize(("width", "percent", "short"), [(3, 90, 32), (5, 80, 1)])
def test_jaccard_components(spark, docs, odd, width, percent, short, monkeypatch):
    monkeypatch.setattr(jaccard, "SHORT_LIST", short)
    both = docs.select("doc_id", "text").where("doc_id < 90").union(odd.select(F.col("doc_id") + 10_000, "text").distinct())
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join_documents(both, width, percent).collect()}
    assert got == jaccard.brute_force(texts(both), width, percent)


def test_one_of_each_component(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows = [(5, a), (5, b), (3, a + " more"), (None, c), (None, d), (None, d + " end"), (None, b + " last"), (9, c.upper()), (7, d), (7, d)]
    rows += [(None, ""), (None, None), (8, " "), (8, " "), (8, None)]
    kept = Counter((r.doc_id, r.text) for r in jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert kept == Counter([(3, a + " more"), (5, b), (9, c.upper()), (7, d), (None, ""), (None, None), (8, " "), (8, None)])
    apart = [(None, " ".join(f"{i}w{j}" for j in range(9))) for i in range(50)]
    assert jaccard.one_of_each(spark.createDataFrame(apart, "doc_id long, text string")).count() == 50


def test_jaccard_members_of_a_long_list_join_by_few_pairs(spark, monkeypatch):
    """Sets outside a long list's largest component that link with a tenth of it do not meet all of these."""
    rng = np.random.default_rng(5)
    base, texts = [f"w{i}" for i in range(130)], set()
    for changes in [1] * 260 + [2] * 240:
        words = list(base)
        for at in rng.choice(20, changes, replace=False):
            words[6 * at + 3] = f"v{at}x{rng.integers(15)}"
        texts.add(" ".join(words))
    rows, met, counted = list(enumerate(sorted(texts))), [], jaccard.counted

    def spy(pairs):
        met.append(pairs.count())
        return counted(pairs)

    monkeypatch.setattr(jaccard, "counted", spy)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.op2(spark, df).collect()}
    assert got == jaccard.brute_force(rows)
    assert met[-1] < 5 * len(rows)


# 3


def test_language_model_sums_to_one():
    import pandas as pd

    alphabet = np.array(sorted(map(ord, "abc")), np.uint32)
    codes = language.encode(language.code_points("abba cab abc bca"), alphabet)
    keys, n = np.unique(language.grams(codes, 3), return_counts=True)
    model = language.kneser_ney([pd.Series(n, index=keys)], alphabet, ["x"], 3)
    context = (codes[2] << np.uint64(12)) | codes[3]
    every = np.array([(context << np.uint64(12)) | np.uint64(c) for c in range(1, 6)], np.uint64)
    assert np.exp(model.log_probs(every, 3)).sum() == pytest.approx(1, abs=1e-3)


def test_language_held_out_accuracy(spark, docs):
    rows = language.op3(spark, docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 20 and np.mean([r.lang == r.lang_pred for r in rows]) >= 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_odd_rows(spark, odd, empty):
    by = {r.doc_id: r for r in language.op3(spark, odd).collect()}
    assert by[1].lang_pred == by[2].lang_pred == by[3].lang_pred == "und" and by[5].lang_pred in ("en", "de", "fr")
    assert language.op3(spark, empty).count() == 0


def test_language_letters_of_every_plane(spark):
    rows = [(i, f"this is plain english text number {i}", "en") for i in range(40)] + [(100 + i, f"dies ist ein deutscher satz {i} und noch einer", "de") for i in range(40)]
    rows += [(500, chr(0x20000) * 50, None), (501, chr(0x1F600) * 5 + " 12 !", None), (502, "this " * 50_000, None)]
    by = {r.doc_id: r for r in language.op3(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert by[500].lang_pred in ("en", "de") and by[501].lang_pred == "und" and by[502].lang_pred == "en"


# 4


def base_counts(text):
    words = (text or "").encode().split()
    w = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(w)
    hit = {j for i, x in enumerate(w) if seen[x] > 1 for j in range(i, i + 5)}
    said = [x for x in (text or "").split("\n") if x.encode().split()]
    return len(words), sum(len(x.decode()) for x in words), sum(c in "#*$%&|<>" for c in text or ""), len(said) - len(set(said)), len(hit)


def test_quality_base(spark, odd, docs):
    for df in (odd, docs):
        want = {r.doc_id: base_counts(r.text) for r in df.collect()}
        for r in quality.op4(spark, df).collect():
            n = want[r.doc_id]
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
            assert r.base_failed == (n[0] < 10 or 100 * n[4] > 20 * n[0])
            assert not (r.base_failed and r.kept)


def test_quality_verdict(spark, sf, docs):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.op4(spark, docs).join(labels, "doc_id").collect()
    good = [r.kept for r in rows if r.quality == 1 and not r.base_failed]
    bad = [r.kept for r in rows if r.quality == 0]
    assert np.mean(good) >= 0.98 and np.mean(bad) <= 0.3


def test_quality_sketch_is_near_and_merges(spark):
    values = [float(i) for i in range(1, 1001)]
    df = spark.createDataFrame([("x", "s", v, v, v, v) for v in values], "lang string, source string, " + ", ".join(f"{m} double" for m in quality.METRICS))
    whole = quality.sketches(df)
    parts = quality.sketches(df.where("word_length <= 300")).unionByName(quality.sketches(df.where("word_length > 300")))
    for sketch in (whole, quality.merged(parts, "lang", "source")):
        r = quality.quartiles(sketch, "lang", "source").where("metric = 'word_length'").first()
        assert r.q2 == pytest.approx(500, rel=0.025) and r.q3 == pytest.approx(750, rel=0.025)


def test_quality_fences_follow_their_group(spark):
    """Two sources of one language against exact quartiles; the smaller one leans on its language."""
    rng = np.random.default_rng(4)
    rows = [("en", "short", 0.0, 0.0, 0.0, float(x), 120.0, 9.0) for x in rng.normal(4, 0.2, 4000)] + [("en", "long", float(y), 0.0, 0.0, float(x), 300.0, 30.0) for x, y in zip(rng.normal(8, 0.5, 3000), rng.uniform(0.1, 0.3, 3000), strict=True)]
    df = spark.createDataFrame(rows, "lang string, source string, " + ", ".join(f"{m} double" for m in quality.SKETCHED))
    got = {r.source: r for r in quality.fences(quality.sketches(df)).collect()}
    every = np.array([r[5] for r in rows])
    for name, n in (("short", 4000), ("long", 3000)):
        own = np.array([r[5] for r in rows if r[1] == name])
        q1, q2, q3 = (n * np.quantile(own, q) / (n + 100) + 100 * np.quantile(every, q) / (n + 100) for q in (0.25, 0.5, 0.75))
        assert got[name].hi_word_length == pytest.approx(q2 + 6 * min(q3 - q2, 2 * (q2 - q1)), rel=0.15)
        assert got[name].lo_word_length == pytest.approx(q2 - 6 * min(q2 - q1, 2 * (q3 - q2)), rel=0.15)
    assert got["short"].hi_word_length < 6.5 < got["long"].lo_word_length + 3 and got["long"].hi_word_length > 9
    assert got["short"].hi_symbol_ratio < 0.1 < 0.4 < got["long"].hi_symbol_ratio


def test_filter_quality_odd_rows(spark, odd, empty):
    extra = odd.withColumns({"_row": F.lit("r"), "_key": F.lit(1), "kept": F.lit(2), "n_words": F.lit(3)})
    out = quality.filter_quality(extra)
    assert out.columns == extra.columns and {r.doc_id for r in out.collect()} <= {5, 6, 7, 8, 9}
    assert quality.filter_quality(empty).count() == 0


# 5


def test_mixing_meets_targets(spark, docs, odd, empty):
    target = {"source": {"src0": 0.5, "src1": 0.25, "src2": 0.25}}
    rows = mixing.sampled(docs.where("source in ('src0', 'src1', 'src2')"), targets=target, budget=0.3).collect()
    expected, by = Counter(), Counter()
    for r in rows:
        expected["all"] += r.tokens * r.p
        by[r.source] += r.tokens * r.p
        assert 0 <= r.p <= 1
    assert expected["all"] == pytest.approx(0.3 * sum(r.tokens for r in rows), rel=1e-3)
    for source, share in target["source"].items():  # near, as cells that are taken whole shift the rest
        assert by[source] / expected["all"] == pytest.approx(share, rel=0.1)
    assert mixing.op5(spark, odd).count() == len(ODD) and mixing.op5(spark, empty).count() == 0
    kept = mixing.mixed(odd.withColumn("p", F.lit(1)))
    assert kept.columns == [*odd.columns, "p"] and kept.where("trim(coalesce(text, '')) = ''").count() == 0


def test_raking_meets_every_marginal(spark):
    rng = np.random.default_rng(5)
    cells = [(s, g, t, int(rng.integers(1, 900))) for s in "abc" for g in ("x", "y", None) for t in "pq"]
    df = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")
    targets = {"source": {"a": 0.5, "b": 0.3, "c": 0.2}, "topic": {"p": 0.6, "q": 0.4}}
    fit = {(r.source, r.lang, r.topic): r for r in mixing.fit(df, targets, budget=0.05).collect()}
    w = {c[:3]: float(c[3]) for c in cells}
    total = sum(w.values())
    lang = {g: sum(v for k, v in w.items() if k[1] == g) ** mixing.POWERS["lang"] for g in ("x", "y", None)}
    goal = [targets["source"], {g: v / sum(lang.values()) for g, v in lang.items()}, targets["topic"]]
    for _ in range(300):
        for d in range(3):
            held = defaultdict(float)
            for k, v in w.items():
                held[k[d]] += v
            w = {k: v * goal[d][k[d]] * total / held[k[d]] for k, v in w.items()}
    assert all(fit[k].w == pytest.approx(v, rel=1e-4) for k, v in w.items())
    assert all(fit[k].p == pytest.approx(0.05 * v / c[3], rel=1e-4) for c in cells for k, v in [(c[:3], w[c[:3]])])
    for d in range(3):  # no cell is taken whole here, so the expected tokens meet the marginals
        for value, share in goal[d].items():
            assert sum(r.tokens * r.p for k, r in fit.items() if k[d] == value) == pytest.approx(0.05 * total * share, rel=1e-4)


def test_raking_says_when_targets_contradict(spark):
    df = spark.createDataFrame([("a", "x", "p", 10), ("b", "y", "p", 10)], "source string, lang string, topic string, tokens long")
    with pytest.warns(UserWarning, match="cannot be met"):
        mixing.fit(df, {"source": {"a": 0.9, "b": 0.1}, "lang": {"x": 0.1, "y": 0.9}})


# 6


def test_chat_round_trip(spark, sf):
    rows = [(1, 0, "user", "a\\<|turn|>b</s>"), (1, 1, "assistant", None), (1, 2, "user", "x"), (1, 3, "assistant", "y\n<|done|>\\"), (1, 4, "user", "tail"), (2, 0, "system", "only"), (None, 0, None, "z"), (3, 0, "assistant", "q"), (3, 0, "assistant", "q")]
    odd = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for df in (odd, spark.read.parquet(f"{sf}/conversations.parquet")):
        want = defaultdict(list)
        for r in chat.with_probe(spark, df).collect():
            want[r.conv_id].append((r.turn, r.role or "", r.text or ""))
        got = {r.conv_id: r for r in chat.op6(spark, df).collect()}
        assert set(got) == set(want)
        for key, turns in want.items():
            turns.sort()
            said = "".join(t for _, r, t in turns if r == "assistant")
            whole = "".join(f"{r}\n{t}\n" for _, r, t in turns)
            g = got[key]
            assert (g.n_turns, g.turns_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest())
            assert (g.loss_chars, g.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    each = chat.examples(odd.where("conv_id = 1")).orderBy("example").collect()
    assert len(each) == 3 and each[2].loss_start is None and "</s>" not in each[0].formatted
    assert chat.examples(odd.limit(0)).count() == 0


# 7


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def normalised(text):
    table = lines._TABLE.tobytes()
    return [b" ".join(x.encode().translate(table).split()).decode() for x in (text or "").split("\n")]


def left_by_edit(rows, is_candidate):
    """The texts that are left when candidates of an edit similarity of 0.8 or more are one."""
    place = {}
    for d, t in rows:
        for i, n in enumerate(normalised(t)):
            if n:
                place.setdefault(n, []).append((d, i))
    names = list(place)
    root = {n: n for n in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(names):
        for b in names[:i]:
            if abs(len(a) - len(b)) <= 0.2 * max(len(a), len(b)) and is_candidate(a, b) and edit(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9):
                root[find(a)] = find(b)
    first, gone = {}, defaultdict(set)
    for n in names:
        first[find(n)] = min(first.get(find(n), (10**9, 0)), min(place[n]))
    for n in names:
        for p in place[n]:
            if p != first[find(n)]:
                gone[p[0]].add(p[1])
    return {d: t and "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) for d, t in rows}


def sketched(names):
    """Keys and SimHash of each normalised line."""
    import pyarrow as pa

    words = lines.split_words(pa.array(names))
    n = np.diff(words.first)
    h, line = lines.distinct(words.hashes(lines._SEED), np.repeat(np.arange(len(n)), n))
    n = np.bincount(line, minlength=len(names))
    keys = defaultdict(set)
    for i, key in zip(*(x.tolist() for x in lines.keys_of(h, n)), strict=True):
        keys[names[i]].add(key)
    return keys, dict(zip(names, lines.simhash(h, np.cumsum(n) - n).tolist(), strict=True))


def changed(rng, line, kind, vocabulary):
    words = line.split()
    i = int(rng.integers(len(words)))
    if kind == "letter":
        word, j = list(words[i]), int(rng.integers(len(words[i])))
        word[j] = "q" if word[j] != "q" else "z"
        words[i] = "".join(word)
    elif kind == "word":
        words[i] = vocabulary[int(rng.integers(len(vocabulary)))]
    else:
        del words[i]
    return " ".join(words)


@pytest.mark.parametrize("rounds", [3, 0])
def test_lines(spark, docs, rounds, monkeypatch):
    """All rounds of picks, and none, give what the definition gives."""
    monkeypatch.setattr(components, "PICKS", rounds)
    base = "the quick brown fox jumps over the lazy dog and then it runs far away from all of us in the evening light again"
    near = [base, base + "!", base.upper(), base.replace("light", "lights"), base.replace("lazy", "hazy"), "alone here is a line of more words than five"]
    rows = [(i, "\n".join(near[(i + j) % 6] for j in range(2)) + f"\n\nown line number {i} x{i}y of this document only {i * 7919}") for i in range(12)] + [(50, None), (51, "\n\n"), (52, "one"), (53, "one two"), (54, "one twos")]
    rng = np.random.default_rng(0)
    for i, r in enumerate(docs.where("length(text) between 40 and 600").orderBy("doc_id").limit(40).collect()):
        some = r.text.split("\n")
        rows.append((100 + i, r.text))
        rows.append((200 + i, "\n".join(changed(rng, x, "letter", ["w"]) if x.split() else x for x in some)))
    keys, sim = sketched(sorted({n for _, t in rows for n in normalised(t) if n}))
    want = left_by_edit(rows, lambda a, b: keys[a] & keys[b] and (sim[a] ^ sim[b]).bit_count() <= lines.HAMMING)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.text for r in lines.op7(spark, df).collect()} == want


def test_lines_recall_by_edit_similarity_alone(docs):
    """Of real lines with one letter, one word or one word less, nine in ten are candidates where edit similarity says that they are one."""
    rng = np.random.default_rng(1)
    every = sorted({n for r in docs.select("text").collect() for n in normalised(r.text) if n})
    vocabulary = sorted({w for x in every for w in x.split()})
    for least, most in ((3, 7), (8, 15), (16, 31), (32, 80)):
        pool = [x for x in every if least <= len(x.split()) <= most]
        for kind in ("letter", "word", "less"):
            pairs = [(x, changed(rng, x, kind, vocabulary)) for x in (pool[int(i)] for i in rng.integers(len(pool), size=60))]
            pairs = [(a, b) for a, b in pairs if a != b and b and edit(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9)]
            keys, sim = sketched(sorted({x for p in pairs for x in p}))
            found = [bool(keys[a] & keys[b]) and (sim[a] ^ sim[b]).bit_count() <= lines.HAMMING for a, b in pairs]
            assert len(found) < 10 or np.mean(found) >= 0.85, (least, kind, np.mean(found))


def test_distance_bounds_hold():
    rng = np.random.default_rng(2)
    words = ["a", "bb", "ccc", "the", "of", "line", "straße", "x1"]
    for _ in range(200):
        x = [words[i] for i in rng.integers(len(words), size=int(rng.integers(1, 30)))]
        y = list(x)
        for _ in range(int(rng.integers(5))):
            y[int(rng.integers(len(y)))] = words[int(rng.integers(len(words)))]
        y = y[int(rng.integers(2)) :] or y
        x, y = " ".join(x), " ".join(y)
        least, most = lines.distance_bounds(x, y)
        d = edit(x, y)
        assert least <= d <= most
        assert [lines.within(x, y, d + i) for i in (-1, 0, 1)] == [False, True, True]
    # more different characters than are kept, texts over many machine words, an empty one
    many = "".join(map(chr, range(0x4E00, 0x4E00 + 3000)))
    assert lines.within(many, many[1500:] + many[:1500], 3000) and not lines.within(many, many[1500:] + many[:1500], 2999)
    assert lines.within(many, many[:700] + "x" + many[702:] + "yz", 4) and not lines.within(many, many[:700] + "x" + many[702:] + "yz", 3)
    assert lines.within("", "abc", 3) and not lines.within("abc", "", 2)


def test_lines_carry_their_texts_and_characters(spark):
    rows = [(1, "Grüße  an\talle, 12 mal\n\n  größer als zuvor "), (2, "zuvor"), (3, None), (4, "x\n日本 語\nx"), (5, "")]
    got = {(r.said, r.size) for r in lines.lines(lines.keyed(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))).where("said is not null").collect()}
    assert got == {(n, len(n)) for _, t in rows for n in normalised(t) if n}


def test_lines_meet_only_where_their_lengths_allow_a_link(spark, monkeypatch):
    """Lines that share blocks, half of them 1.5 times as long: none of one half is offered with one of the other."""
    base = " ".join(f"w{'abcdefghijklmnopqrstuvwxyz'[i]}{'abcdefghijklmnopqrstuvwxyz'[i]}rd" for i in range(24))
    letters = ["".join(chr(97 + int(c)) for c in str(i)) for i in range(40)]
    rows = [(i, f"{base} {x}") for i, x in enumerate(letters)] + [(100 + i, f"{base} {'y' * (len(base) // 2)}{x}") for i, x in enumerate(letters)]
    offered, verified = [], lines.verified

    def spy(pairs, *more):
        offered.extend((r.a, r.b) for r in pairs.select("a", "b").collect())
        return verified(pairs, *more)

    monkeypatch.setattr(lines, "verified", spy)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert [r.doc_id for r in lines.op7(spark, df).where("text <> ''").orderBy("doc_id").collect()] == [0, 100]
    short = {r.line: r.doc_id < 100 for r in lines.lines(lines.keyed(df)).collect()}
    assert offered and all(short[a] == short[b] for a, b in offered)


@pytest.mark.parametrize("batch", [1, 2, 3, 1000])
def test_lines_blocks_are_read_across_batches(spark, batch):
    blocks = [[1], [2, 3], [4, 5, 6], [], [7], [8, 9, 10, 11, 12, 13, 14, 15], [1, 2], [4, 8, 9]]
    keys = defaultdict(list)
    for key, members in enumerate(blocks):
        for line in members:
            keys[line].append(key)
    kinds = spark.createDataFrame([(line, line * 10, line * 100, held) for line, held in keys.items()], "line long, sim long, size int, keys array<long>")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = lines.blocks_met(kinds).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted((r.key, r.line) for r in got) == [(k, x) for k, members in enumerate(blocks) if len(members) > 1 for x in members]
    for r in got:
        assert (r.sim, r.size, r.sim2, r.size2, r.wide) == (r.line * 10, r.line * 100, r.line2 * 10, r.line2 * 100, len(blocks[r.key]) > 2)
    assert all(len({r.line2 for r in got if r.key == k} & set(members)) == (len(members) > 1) for k, members in enumerate(blocks))


@pytest.mark.parametrize("alphabet", ["ab ", "abcdefghé 𝄞", "".join(map(chr, range(0x4E00, 0x4EC0)))])
def test_distances_side_by_side(alphabet):
    rng = np.random.default_rng(5)
    draw = lambda n: "".join(alphabet[int(i)] for i in rng.integers(len(alphabet), size=n))
    xs = [draw(int(n)) for n in rng.choice([1, 2, 63, 64, 65, 128, 200], size=60)]
    ys = []
    for x in xs:
        cut = int(rng.integers(len(x) + 1))
        ys.append(draw(int(rng.integers(1, 80))) if rng.random() < 0.2 else x[:cut] + draw(int(rng.integers(1, 9))) + x[cut + int(rng.integers(6)) :])
    distance = [edit(x, y) for x, y in zip(xs, ys, strict=True)]
    for off in (-1, 0, 1):
        assert lines.within_each(xs, ys, [d + off for d in distance]).tolist() == [off >= 0] * len(xs)


def test_lines_pairs_are_not_looked_up_again_for_new_labels(spark, monkeypatch):
    """Later rounds look up two components, not each pair between them; blocks of lines that do not link keep their result."""
    apart, moved, sizes = components.still_apart, components.moved_on, []

    def first_only(pairs, labels):
        assert labels is None
        return apart(pairs, labels)

    def spy(pairs, labels):
        out = moved(pairs, labels)
        sizes.append((pairs.count(), pairs.select("ra", "rb").distinct().count()))
        assert {(r.a, r.b) for r in out.collect()} == {(r.a, r.b) for r in apart(pairs.select("a", "b", "far"), labels).collect()}
        return out

    monkeypatch.setattr(components, "still_apart", first_only)
    monkeypatch.setattr(components, "moved_on", spy)
    base = " ".join(f"{x}{x}{y}ord" for x in "abcdef" for y in "ghij")
    rows = [(100 * g + i, f"{base} {'kmnpqrs'[g] * 26} {'tuvwxyz'[g] * 24} {chr(97 + i) * 2}") for g in range(7) for i in range(12)]
    keys, sim = sketched(sorted({n for _, t in rows for n in normalised(t)}))
    want = left_by_edit(rows, lambda a, b: keys[a] & keys[b] and (sim[a] ^ sim[b]).bit_count() <= lines.HAMMING)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.text for r in lines.op7(spark, df).collect()} == want
    assert sum(want[d] != "" for d, _ in rows) == 7 and any(n > two for n, two in sizes)


def test_documents_prefixes_are_written_once(spark, docs, monkeypatch):
    """By the time pairs are made, the rows' prefixes and sketches are gone; those of the classes are left."""
    postings, held = jaccard.postings, []

    def spy(classes, percent):
        held.extend(p for p in Path(shared_dir(spark).removeprefix("file://")).glob("signatures-*"))
        return postings(classes, percent)

    monkeypatch.setattr(jaccard, "postings", spy)
    before = set(Path(shared_dir(spark).removeprefix("file://")).glob("signatures-*"))
    assert jaccard.join_documents(docs.limit(50)).count() == 50
    assert set(held) <= before


@pytest.mark.parametrize("held", [4, 1 << 20])
def test_lines_blocks_hold_one_line_of_a_hot_key(spark, held, monkeypatch):
    """One row per pair of key and line and one centre per key, however few numbers a task holds at once."""
    monkeypatch.setattr(lines, "DEALT_KEYS", held)
    keys = {line: [7 << 55, (line % 5) << 40, -1 - line] for line in range(60)}
    df = spark.createDataFrame([(line, line * 3, line + 20, k) for line, k in keys.items()], "line long, sim long, size int, keys array<long>").repartition(4)
    assert lines.dealt_keys(df).schema["key"].dataType.simpleString() == "array<bigint>"
    got = lines.blocks_met(df).collect()
    assert sorted((r.key, r.line) for r in got) == sorted((k, line) for line, ks in keys.items() for k in ks[:2])
    assert all(r.wide and (r.sim, r.size, r.sim2, r.size2) == (r.line * 3, r.line + 20, r.line2 * 3, r.line2 + 20) for r in got)
    assert len({(r.key, r.line2) for r in got}) == 6


def test_lines_keep_columns(spark, odd, empty):
    extra = odd.withColumns({"left": F.lit("l"), "k": F.lit(1), "gone": F.lit(2)})
    out = lines.cleaned(extra)
    assert out.columns == extra.columns and out.count() >= 7
    assert lines.cleaned(empty).count() == 0 and lines.cleaned(empty).columns == empty.columns


# 8


@pytest.mark.parametrize("n", [0, 1, 13, 200])
def test_sharding_counts_differ_by_one(spark, n):
    df = spark.range(n).select((F.col("id") % 150).alias("doc_id"), F.lit("é").alias("text"))
    rows = sharding.op8(spark, df).collect()
    held = defaultdict(list)
    for r in rows:
        held[r.shard].append(r.slot)
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (3, zlib.crc32("é".encode()), "rows", None)
    assert len(rows) == n and all(sorted(s) == list(range(len(s))) for s in held.values())
    sizes = [len(held[s]) for s in range(8)]
    assert max(sizes) - min(sizes) <= 1


def test_sharding_moves_little(spark):
    df = spark.range(2000).withColumnRenamed("id", "doc_id")
    before = {r.doc_id: r.shard for r in sharding.shard_rows(df, "doc_id", 8).collect()}
    after = {r.doc_id: r.shard for r in sharding.shard_rows(df, "doc_id", 9).collect()}
    assert sum(before[k] != after[k] for k in before) < 0.35 * 2000  # dealing anew would move 8 of 9


# 9


def test_top_k(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, (rng.normal(size=8) * 0.3).tolist()) for i in range(600)] + [(1000 + i, [0.25] * 8) for i in range(300)]
    vectors += [(5001, None), (5002, [None] * 8), (5003, [float("nan")] * 8), (5100, [float("inf")] * 8), (5004, []), (5200, [0.1, 0.2])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in topk.top_k(df, shard_rows=100, block=4).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    ids = np.array([i for i, v in vectors[:900]])
    x = np.floor(np.array([v for _, v in vectors[:900]]) * 1024)
    want = {}
    for i, q in zip(ids, x, strict=True):
        if i % 100 == 0:
            s = x @ q
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:10]
            want[i] = [(n + 1, ids[j], s[j]) for n, j in enumerate(order)]
    assert {k: sorted(v) for k, v in got.items()} == want
    assert topk.top_k(df.limit(0)).count() == 0


def test_top_k_of_large_and_repeated_vectors(spark):
    vectors = [(100, [1.0, 2.0]), (100, [-3.0, 1.0]), (100, [1.0, 2.0]), (1, [2.0**60, 2.0**60]), (2, [0.5, 0.5]), (3, [-(2.0**62), 1.0]), (4, [1e300, -1e300])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df, k=4, shard_rows=2, block=1).collect())

    def product(a, b):
        return sum((int(x) * 1024 if abs(x) >= 2**53 else math.floor(x * 1024)) * (int(y) * 1024 if abs(y) >= 2**53 else math.floor(y * 1024)) for x, y in zip(a, b, strict=True))

    want = []
    for q in ([1.0, 2.0], [-3.0, 1.0]):
        order = sorted((-max(min(product(q, v), 2**63 - 1), -(2**63)), i) for i, v in vectors if i != 100)
        want += [(100, n + 1, i, -s) for n, (s, i) in enumerate(order)]
    assert got == sorted(want)


# 10


def test_substrings(spark, docs, odd):
    periodic = [(20_000 + i, " ".join(["p", "q", "r", "s", "t"][: i + 1] * 9)) for i in range(5)]
    both = docs.select("doc_id", "text").where("doc_id < 120").union(odd.select(F.col("doc_id") + 10_000, "text").distinct()).union(spark.createDataFrame(periodic, "doc_id long, text string"))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.op10(spark, both).collect()}
    assert got == substrings.brute_force(texts(both))


# components, shared by 2 and 7


def test_jaccard_wide_sketches_tell_large_sets(spark):
    """Sets of more tokens than a plain sketch has bits are told apart before their texts are read; none that links is lost."""
    rng = np.random.default_rng(8)
    rows = []
    for i, n in enumerate((600, 1030, 2080, 5000)):
        base = [f"w{x}" for x in rng.integers(0, 1 << 40, n)]
        for j, changed in enumerate((0, n // 70, n // 25, n // 8)):
            words = list(base)
            for at in rng.choice(n, changed, replace=False):
                words[at] = f"v{rng.integers(0, 1 << 40)}"
            rows.append((4 * i + j, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    base = jaccard.signatures(df, np.zeros(0, np.int64)).select("doc_id", F.col("c1").alias("c"), F.col("n_shingles").cast("int").alias("n"), "sketch", "wide").cache()
    ids = base.select(F.col("c").alias("a"), F.col("doc_id").alias("x")).crossJoin(base.select(F.col("c").alias("b"), F.col("doc_id").alias("y"))).where("x < y").cache()
    got = {(r.x, r.y) for r in jaccard.likely(ids.select("a", "b"), base, jaccard.PERCENT).join(ids, ["a", "b"]).collect()}
    assert got >= {(4 * i, 4 * i + 1) for i in range(4)} and not any(y % 4 == 3 for _, y in got)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.op2(spark, df).collect()} == jaccard.brute_force(rows)


def test_jaccard_hands_python_small_batches(spark, docs, monkeypatch):
    key, seen, write = "spark.sql.execution.arrow.maxRecordsPerBatch", [], jaccard.materialize
    before = spark.conf.get(key)

    def spy(df, name):
        seen.append(int(spark.conf.get(key)))
        return write(df, name)

    monkeypatch.setattr(jaccard, "materialize", spy)
    assert jaccard.op2(spark, docs.limit(50)).count() == 50
    assert max(seen) <= 512 and spark.conf.get(key) == before


def test_jaccard_bands_hold_all_sizes_that_fit(spark):
    rows = spark.range(1, 5000).select(F.col("id").cast("int").alias("n"))
    for percent in (80, 90):
        first, own, last = jaccard.bands(percent)
        got = {r.n: (r.f, r.o, r.l) for r in rows.select("n", first.alias("f"), own.alias("o"), last.alias("l")).collect()}
        for n, (f, o, l) in got.items():
            least, most = -(-n * percent // 100), min(4999, n * 100 // percent)
            assert f <= got[least][1] <= o <= got[most][1] <= l
        assert sum(l - f + 1 for f, _, l in got.values()) < 1.8 * len(got)


def test_components(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000 + i, 2000 - i) for i in range(50)] + [(5000, 5001 + i) for i in range(200)] + [(7, 7)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    got = {r.node: r.root for r in components.components(df).collect()}
    assert all(got[i] == 0 for i in range(301)) and all(got[5001 + i] == 5000 for i in range(200)) and got[2000] == 1000
    assert components.components(df.limit(0)).count() == 0


def test_empty_tables(spark, empty):
    for f in (packing.op1, jaccard.op2, quality.op4, lines.op7, sharding.op8, substrings.op10):
        assert f(spark, empty).count() == 0


@pytest.mark.parametrize("batch", [components.BATCH_EDGES, 7])
def test_components_of_one_batch_need_no_rounds(spark, batch, monkeypatch):
    """Edges that fit in one batch are contracted whole; those of many go by rounds, with the same result."""
    monkeypatch.setattr(components, "BATCH_EDGES", batch)
    starred, star = [], components.star
    monkeypatch.setattr(components, "star", lambda *x: starred.append(1) or star(*x))
    edges = [(i, i + 3) for i in range(0, 60)] + [(100, 7), (200, 201)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(4)
    got = {r.node: r.root for r in components.components(df).collect()}
    assert got == {i: i % 3 for i in range(63)} | {100: 1, 200: 200, 201: 200} and bool(starred) == (batch == 7)
