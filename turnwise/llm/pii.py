r"""Personal data by rules, and by the contexts that the rules' finds stand in.

Rules find emails, addresses, card and phone numbers (``RULES``). They seed a
bootstrap: every text is searched for looser identifier shapes (``LOOSE``), and
an identifier's context, the two words before and the word after it, gives three
lexical patterns: the word before, the two words before, and the words around.
Patterns and the values that stand in them form a graph, whose edges carry how
often a value stands in a pattern. Spark scores it in rounds:

    pattern p, kind k:  s(p, k) = sum c r(v, k) / (sum c R(v) + UNSURE * sum c (1 - R(v)) + other(p) + PRIOR)
    value v, kind k:    r(v, k) = 1 if a rule finds v, else the greatest s(p, k) of its patterns

R(v) is the greatest r of v over kinds, other(p) how often the pattern stands in
the corpus with an ordinary word in its place, counted over all texts. A pattern
with ``LEAST_SEEDS`` different values that are held for k (r >= ``SURE``) and
s >= ``SURE`` is trusted: identifiers of that shape in its place are personal
data. Values found so speak for further patterns in the next round.

DataFrame operations only. What is broadcast is a bitmap of half a megabyte;
patterns, values and edges are shuffled, and aggregated before that.

Defined cases: null text is empty and has no spans; copies of a text get the
same spans, each row its own; rows with null or repeated doc_id are rows of their
own; a span that touches a rule's span is not added; very long texts are searched
whole, patterns have no repeated groups that recurse and offsets are summed in
blocks; other columns are not read; an empty table gives no rows. Offsets are
code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize
from .tables import sift

KINDS = ("email", "ip", "card", "phone")
#: the rules, with possessive repeats where no match needs to give back, so that long runs take linear time and no stack
RULES = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: what a text has at least where a rule finds something
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]"}
_PART = r"[^\s<>()\[\]{}\"',;:@]"
SHAPES = {
    "email": rf"{_PART}{{1,64}}+(?:@|\s?[(\[]\s?at\s?[)\]]\s?){_PART}{{0,254}}[\p{{L}}\p{{N}}]",
    "ip": r"[0-9A-Fa-f]{1,4}(?::{1,2}[0-9A-Fa-f]{1,4}){2,7}|[0-9]{1,4}(?:\.[0-9]{1,4}){3}",
    "card": r"[0-9]{12,19}|[0-9]{4}(?:[\x20./-][0-9]{3,6}){2,4}",
    "phone": r"\+?\(?[0-9]{1,4}\)?(?:[\x20./-]{1,2}\(?[0-9]{2,4}\)?){1,5}|\+?[0-9]{7,11}",
}
LOOSE = rf"{SHAPES['email']}|(?<![\p{{L}}\p{{N}}])(?:{SHAPES['ip']}|{SHAPES['card']}|{SHAPES['phone']})(?![\p{{L}}\p{{N}}])"
SPLIT = "[\\x20\\x09-\\x0D]+"
SLOT = "\u0001"
LONGEST_WORD = 40  # characters of a word that tell contexts apart

ROUNDS = 3
SURE = 0.5
LEAST_SEEDS = 3
PRIOR = 1.0
UNSURE = 0.25


def running(lengths: str) -> str:
    """SQL for the running sums of an array column: in blocks of the root of its size, as an array that grows is copied each time."""
    b = f"cast(ceil(sqrt(size({lengths}))) as int)"
    blocks = f"transform(sequence(0, (size({lengths}) - 1) div {b}), k -> slice({lengths}, cast(k * {b} + 1 as int), {b}))"
    inner = f"""transform({blocks}, x -> aggregate(x, struct(0L as at, cast(array() as array<bigint>) as so),
        (a, v) -> struct(a.at + v as at, concat(a.so, array(a.at + v)) as so), a -> a.so))"""
    outer = f"""flatten(aggregate({inner}, struct(0L as at, cast(array() as array<array<bigint>>) as so),
        (a, x) -> struct(a.at + element_at(x, -1) as at, concat(a.so, array(transform(x, y -> y + a.at))) as so), a -> a.so))"""
    return f"if(size({lengths}) > 0, {outer}, cast(array() as array<bigint>))"


def matched(df: DataFrame, rules: dict[str, tuple[str, Column]], keep: list[str]) -> DataFrame:
    """df's columns ``keep`` with, per name, an array of start, end and said for all matches in ``_text``; a rule runs where its Column holds."""
    none = F.array().cast("array<string>")
    found = df.select(
        *keep,
        "_text",
        *[F.when(hint, F.regexp_extract_all("_text", F.lit(rule), 0)).otherwise(none).alias(f"_m_{n}") for n, (rule, hint) in rules.items()],
    )
    # most texts have no match: only the others are split at them
    between = found.select("*", *[F.when(F.size(f"_m_{n}") > 0, F.split("_text", rule, -1)).otherwise(none).alias(f"_p_{n}") for n, (rule, _) in rules.items()])
    sizes = between.select("*", *[F.expr(f"zip_with(_m_{n}, slice(_p_{n}, 1, size(_m_{n})), (m, p) -> cast(length(m) + length(p) as bigint))").alias(f"_l_{n}") for n in rules])
    ends = sizes.select(*keep, "_text", *[f"_m_{n}" for n in rules], *[F.expr(running(f"_l_{n}")).alias(f"_e_{n}") for n in rules])
    spans = [F.expr(f"zip_with(_m_{n}, _e_{n}, (m, e) -> struct(e - length(m) as start, e as end, m as said))").alias(n) for n in rules]
    return ends.select(*keep, "_text", *spans)


def digits(said: Column) -> Column:
    return F.regexp_replace(said, "[^0-9]+", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits has a right check digit."""
    each = F.transform(F.split(F.reverse(number), ""), lambda c, i: F.coalesce(c.try_cast("int"), F.lit(0)) * (1 + i % 2))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def valid(kind: str, said: Column) -> Column:
    """Whether a rule's match counts."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = "0*+(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])?"
        return said.rlike(rf"^{part}(?:\.{part}){{3}}$")
    number = digits(said)
    if kind == "card":
        return F.length(number).between(12, 19) & luhn(number)
    return F.length(number).between(9, 15)


def seed_kind(said: Column) -> Column:
    """The place in KINDS of the rule that a loose match obeys as a whole."""
    out = F.lit(None).cast("int")
    for k in reversed(range(len(KINDS))):
        rule = RULES[KINDS[k]].removeprefix(r"(?:(?<![A-Za-z0-9._%+-])|\G)").removeprefix("(?<![0-9])")
        out = F.when(said.rlike(f"^(?:{rule})$") & valid(KINDS[k], said), k).otherwise(out)
    return out


def shapes(said: Column) -> Column:
    """Bits of the kinds that a loose match may be."""
    out = F.lit(0)
    for k, kind in enumerate(KINDS):
        out = out + F.when(said.rlike(f"^(?:{SHAPES[kind]})$"), 1 << k).otherwise(0)
    return out


def context_words(text: Column) -> Column:
    """A text's words as contexts see them: identifiers are one mark each, letters small, figures zero; two marks before and one after."""
    marked = F.regexp_replace(F.translate(text, SLOT, " "), LOOSE, f" {SLOT} ")
    words = F.filter(F.split(F.translate(F.lower(marked), "123456789", "000000000"), SPLIT), lambda w: w != "")
    return F.concat(F.array(F.lit("^"), F.lit("^")), F.transform(words, lambda w: F.substring(w, 1, LONGEST_WORD)), F.array(F.lit("$")))


def keys_at(i: str, hashes: str = "_h") -> str:
    """SQL for the three patterns of the place ``i`` of an array of word hashes."""
    return f"array(xxhash64(1, {hashes}[{i} - 1]), xxhash64(2, {hashes}[{i} - 2], {hashes}[{i} - 1]), xxhash64(3, {hashes}[{i} - 1], {hashes}[{i} + 1]))"


def counted(k: int) -> Column:
    """The matches of rule k that count, as spans."""
    good = F.filter(F.col(KINDS[k]), lambda m: valid(KINDS[k], m.said))
    return F.transform(good, lambda m: F.struct(m.start.alias("start"), F.lit(k).alias("kind"), m.end.alias("end")))


def of_kind(k: int) -> Column:
    return F.filter("base", lambda s: s.kind == k)


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, key (of the text), base (spans of the rules) and found (loose matches with their patterns) of every row."""
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    text = F.col("_text")
    by_rule = matched(texts, {kind: (RULES[kind], text.rlike(HINTS[kind])) for kind in KINDS}, ["doc_id"])
    based_on = F.sort_array(F.concat(*[counted(k) for k in range(len(KINDS))]))
    based = by_rule.select("doc_id", based_on.alias("base"), F.unhex(F.sha2(text, 256)).alias("_key"), F.translate(text, SLOT, " ").alias("_text"))
    loose = matched(based, {"_loose": (LOOSE, text.rlike(r"[0-9@]|[(\[]\s?at"))}, ["doc_id", "base", "_key"])
    some = F.size("_loose") > 0
    words = loose.withColumn("_w", F.when(some, context_words(text))).withColumn("key", F.when(some, F.col("_key"))).drop("_text", "_key")
    placed = words.withColumn("_at", F.expr(f"filter(transform(_w, (w, i) -> if(w = '{SLOT}', i, -1)), i -> i >= 0)"))
    hashed = placed.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
    with_patterns = F.expr(
        f"""zip_with(_loose, _at, (m, i) -> struct(m.start as start, m.end as end, m.said as said, {keys_at("i")} as patterns,
            array(concat(_w[i - 1], ' _'), concat(_w[i - 2], ' ', _w[i - 1], ' _'), concat(_w[i - 1], ' _ ', _w[i + 1])) as told))"""
    )
    return hashed.select("doc_id", "key", "base", with_patterns.alias("found"))


def occurrences(rows: DataFrame) -> DataFrame:
    """key, start, end, value, seed, shapes, patterns, told of every loose match."""
    each = rows.where("size(found) > 0").select("key", F.inline("found"))
    value = F.lower(F.regexp_replace("said", r"[\s()+/-]+", ""))
    return each.select("key", "start", "end", value.alias("value"), seed_kind(F.col("said")).alias("seed"), shapes(F.col("said")).alias("shapes"), "patterns", "told")


def others(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """p, other: how often each pattern stands in the corpus around an ordinary word."""
    hashed = docs.select(context_words(F.coalesce(F.col("text"), F.lit(""))).alias("_w")).select("_w", F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"))
    places = f"filter(sequence(2, size(_w) - 2), i -> size(_w) > 3 and _w[i] <> '{SLOT}')"
    every = hashed.select(F.explode(F.expr(f"flatten(transform({places}, i -> {keys_at('i')}))")).alias("p"))
    return sift(every, "p", patterns.select("p")).groupBy("p").agg(F.count("*").alias("other")).join(patterns.select("p"), "p", "left_semi")


def graph(found: DataFrame) -> DataFrame:
    """p, told, value, n: edges of the patterns that LEAST_SEEDS different values or more stand in."""
    each = found.select("value", F.explode(F.arrays_zip("patterns", "told")).alias("_e")).select("value", F.col("_e.patterns").alias("p"), F.col("_e.told").alias("told"))
    edges = materialize(each.groupBy("p", "value").agg(F.count("*").alias("n"), F.min("told").alias("told")), "edges")
    often = edges.groupBy("p").agg(F.count("*").alias("_values")).where(F.col("_values") >= LEAST_SEEDS)
    return materialize(edges.join(often.select("p"), "p", "left_semi"), "graph")


def pattern_scores(edges: DataFrame, held: DataFrame, other: DataFrame) -> DataFrame:
    """p, kind, s, seeds from the values' scores (value, kind, r, best: one row of the greatest r each)."""
    told = edges.select("p", "value", "n").join(held, "value", "left")
    r, best = F.coalesce("r", F.lit(0.0)), F.coalesce("best", F.lit(0.0))
    by_kind = told.where("kind is not null").groupBy("p", "kind").agg(F.sum(F.col("n") * r).alias("_pos"), F.count_if(r >= SURE).alias("seeds"))
    # a value with scores for several kinds has several rows: its share of n is split evenly
    share = F.col("n") / F.coalesce("kinds", F.lit(1))
    by_pattern = told.groupBy("p").agg(F.sum(share * (best + UNSURE * (1 - best))).alias("_all"))
    both = by_kind.join(by_pattern, "p").join(other, "p", "left")
    return both.select("p", "kind", "seeds", (F.col("_pos") / (F.col("_all") + F.coalesce("other", F.lit(0)) + PRIOR)).alias("s"))


def value_scores(edges: DataFrame, scores: DataFrame, values: DataFrame) -> DataFrame:
    """value, kind, r, best, kinds: seeds are certain, other values have what their best pattern gives for kinds of their shape."""
    open_values = values.where("seed is null").select("value", "shapes")
    given = edges.select("p", "value").join(scores.where(F.col("seeds") >= LEAST_SEEDS).select("p", "kind", "s"), "p")
    fit = given.groupBy("value", "kind").agg(F.max("s").alias("r")).join(open_values, "value").where("shiftright(shapes, kind) % 2 = 1")
    best = fit.groupBy("value").agg(F.max("r").alias("best"), F.count("*").alias("kinds"))
    return seeds_of(values).unionByName(fit.join(best, "value").select("value", "kind", "r", "best", "kinds"))


def seeds_of(values: DataFrame) -> DataFrame:
    one = F.lit(1.0)
    return values.where("seed is not null").select("value", F.col("seed").alias("kind"), one.alias("r"), one.alias("best"), F.lit(1).cast("long").alias("kinds"))


def trusted(docs: DataFrame, found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """p, kind, s, seeds, told of the patterns that discover identifiers."""
    edges = graph(found)
    names = edges.groupBy("p").agg(F.min("told").alias("told"))
    other = materialize(others(docs, names), "others")
    values = materialize(found.groupBy("value").agg(F.min("seed").alias("seed"), F.bit_or("shapes").alias("shapes")), "values")
    held = seeds_of(values)
    for n in range(rounds):
        scores = materialize(pattern_scores(edges, held, other), f"patterns-{n}")
        if n + 1 < rounds:
            held = materialize(value_scores(edges, scores, values), f"held-{n}")
    return scores.where((F.col("s") >= SURE) & (F.col("seeds") >= LEAST_SEEDS)).join(names, "p")


def discovered(rows: DataFrame, found: DataFrame, patterns: DataFrame) -> DataFrame:
    """key, start, kind, end of identifiers in trusted patterns that touch no span of the rules."""
    each = found.select("key", "start", "end", "shapes", F.explode("patterns").alias("p"))
    hits = sift(each, "p", patterns.select("p")).join(patterns.select("p", "kind", "s"), "p").where("shiftright(shapes, kind) % 2 = 1")
    best = hits.groupBy("key", "start", "end").agg(F.max(F.struct("s", (-F.col("kind")).alias("_k"))).alias("_b"))
    new = best.select("key", "start", "end", (-F.col("_b._k")).alias("kind"))
    by_rule = rows.where("size(base) > 0 and key is not null").select("key", F.inline("base")).join(new.select("key").distinct(), "key", "left_semi")
    both = new.withColumn("new", F.lit(True)).unionByName(by_rule.distinct().withColumn("new", F.lit(False)))
    order = W.partitionBy("key").orderBy("start", "new")
    ruled = ~F.col("new")
    before = F.max(F.when(ruled, F.col("end"))).over(order.rowsBetween(W.unboundedPreceding, -1))
    after = F.min(F.when(ruled, F.col("start"))).over(order.rowsBetween(1, W.unboundedFollowing))
    free = both.withColumns({"_before": before, "_after": after}).where("new and coalesce(_before <= start, true) and coalesce(_after >= end, true)")
    return free.select("key", "start", "kind", "end")


def extracted(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, base and spans (arrays of start, kind, end) of every row; spans are base and what the patterns discover."""
    rows = materialize(scanned(docs), "scanned")
    found = materialize(occurrences(rows), "found")
    new = discovered(rows, found, trusted(docs, found, rounds))
    added = new.groupBy("key").agg(F.collect_list(F.struct("start", "kind", "end")).alias("added"))
    some = rows.where("key is not null").join(added, "key", "left")
    whole = some.select("doc_id", "base", F.sort_array(F.concat("base", F.coalesce("added", F.array().cast(added.schema["added"].dataType)))).alias("spans"))
    return whole.unionByName(rows.where("key is null").select("doc_id", "base", F.col("base").alias("spans")))


def listed(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.col(spans), lambda s: F.concat_ws(":", names[s.kind], s.start.cast("string"), s.end.cast("string"))), ",")


def op11(spark: SparkSession, docs: DataFrame) -> DataFrame:
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return extracted(docs).select("doc_id", *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))
