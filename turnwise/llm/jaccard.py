"""N-gram Jaccard self-join with adaptive multi-match prefixes.

A document is the set of its word n-grams. Two link when 100 * intersection >=
threshold * union. All sets are ordered alike (tokens known to be frequent last,
by estimated frequency; the others by hash), and of a set of n tokens of which
at least o = ceil(t n) must be shared, the first n - o + l tokens form its
l-prefix: two linked sets share l tokens of their l-prefixes at least. Each
document picks its own l: a longer prefix means more postings, but a pair must
then share more of them before it is verified, so l grows where the postings'
lengths foretell many chance meetings. A pair is held to the smaller l of the
two, and its prefixes are cut to what its own two sizes leave.

Equal sets are one class from the start and are represented once. Short posting
lists yield their pairs. A long list (a large group of near copies, or a passage
that many share) yields a star, its least class with all others. All of these
are counted against l and held to parity sketches (a bit per token, flipped by
each), which tell most pairs that differ in more places than a link allows; sets
of more tokens than these have bits carry a wide one, a bit per token at least,
which is asked once per pair and not once per posting. Then every component verifies its likeliest pair, components are made anew, and so on
until no pair stands between two. Then the members of a long list outside its
largest component meet about ``CENTRES`` of the list, drawn by their digests:
one that links with many of the list joins them by one of these. Last come the
pairs of long lists that still stand between two components, matched within
bands of set size, counted and held alike, so no link between components is lost
while the pairs inside one are neither enumerated nor verified. Components are
what this join reports.

Token frequencies are estimated from counts of tokens that stand often within a
slice of text; they only set the order, so any error costs time and no result.
Sets are held by 64-bit hashes of their n-grams and compared exactly on these; a
class is known by a 64-bit digest of its set.

Defined cases: null text, or one without words, has the empty set, links with
nothing and is its own component; fewer words than n are one n-gram; repeated
rows are equal sets; documents of a null doc_id take part, and a component of
such rows alone has a null id; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import arrow_rows, drop_materialized, materialize
from .components import connected
from .tables import sift
from .words import as_long, chunks, mix, split_words, windows

WIDTH = 3
PERCENT = 90
MATCHES = 3  # greatest l
SHORT_LIST = 32  # longer posting lists go by stars
CENTRES = 128  # members of a long list that those outside its largest component meet before all others, on average
LOCAL_OFTEN = 3  # occurrences in a slice of text that make a token worth counting
FREQUENT = 1 << 17  # so many tokens have their place in the order by frequency: 1 MB, whatever the input
SKETCH_WORDS = 8  # 64-bit words of a set's parity sketch; larger sets have a wide one beside it
BAND = 4  # sizes of one band: so many times as far apart, by their logarithms, as those of a link
VERIFY_COST = 24.0  # of verifying a pair, in postings
TEXT_ROWS = 512  # of a batch that Spark hands to Python
MEET_PAIRS = 64  # pairs of one set that a copy of it serves
_SEED, _BASE = 0xA4093822299F31D0, 0x9E3779B97F4A7C15
_EMPTY = np.zeros(0, np.uint64)


def token_sets(part: pa.RecordBatch, width: int, text: str = "text") -> list[np.ndarray]:
    """The sorted set of n-gram hashes of each row."""
    words = split_words(part.column(part.schema.get_field_index(text)), lower=True)
    h, out = words.hashes(_SEED), []
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(windows(h[a:b], width, _BASE)))
        elif b > a:
            out.append(windows(h[a:b], b - a, _BASE + 2 * int(b - a)))
        else:
            out.append(_EMPTY)
    return out


def least_shared(n: int, percent: int) -> int:
    """Tokens that a set of n shares with any set it links with, at least."""
    return -(-n * percent // 100)


def prefix_length(n: int, percent: int, matches: int) -> int:
    return min(n, n - least_shared(n, percent) + matches)


def digest(tokens: np.ndarray) -> int:
    """A 64-bit sum over a set that equal sets share."""
    return int(as_long(mix(np.array([mix(tokens + np.uint64(0x51ED)).sum(dtype=np.uint64)])))[0]) if len(tokens) else 0


def parity(tokens: np.ndarray, words: int = SKETCH_WORDS) -> np.ndarray:
    """Bit i says whether an odd number of tokens fall to i: bits that differ between two sets are at most the tokens that do."""
    odd = np.bincount((tokens % np.uint64(64 * words)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def wide_words(n: int) -> int:
    """Words of the wide sketch of n tokens, a power of two, 0 where the plain one has a bit per token."""
    return 0 if n <= 64 * SKETCH_WORDS else 1 << (-(-n // 64) - 1).bit_length()


def frequent_tokens(docs: DataFrame, width: int = WIDTH, most: int = FREQUENT) -> np.ndarray:
    """The ``most`` most frequent tokens, the least frequent of them first."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                sets = token_sets(part, width)
                token, n = np.unique(np.concatenate([*sets, _EMPTY]), return_counts=True)
                often = n >= LOCAL_OFTEN
                yield pa.RecordBatch.from_arrays([pa.array(as_long(token[often])), pa.array(n[often].astype(np.int64))], names=["token", "n"])

    counts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "token").limit(most).select("token", "n").toPandas()
    return top.sort_values(["n", "token"])["token"].to_numpy(np.int64)


def row_key() -> Column:
    """A hash of doc_id and text: rows of a null or shared doc_id are told apart by it."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("k")


def least_row() -> Column:
    """The row of the least doc_id of a group, null ids last, then of the least key."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k"))


def signatures(docs: DataFrame, frequent: np.ndarray, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, k (hash of doc_id and text), n_shingles, c1 (the set's digest), its parity sketches and its longest prefix, in order.

    Of equal sets in a slice of text only the first carries the prefix and the wide sketch.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequent)
    schema = pa.schema([("doc_id", pa.int64()), ("k", pa.int64()), ("n_shingles", pa.int64()), ("c1", pa.int64()), ("sketch", pa.list_(pa.int64())), ("wide", pa.list_(pa.int64())), ("prefix", pa.list_(pa.int64()))])

    def run(batches):
        by_token = np.argsort(shared.value, kind="stable")
        known = shared.value[by_token]
        for batch in batches:
            for part in chunks(batch):
                n, c1, sketch, wide, prefix, seen = [], [], [], [], [], set()
                for tokens in token_sets(part, width):
                    long = as_long(tokens)
                    rank = np.full(len(long), -1)
                    if len(known):
                        at = np.minimum(np.searchsorted(known, long), len(known) - 1)
                        rank = np.where(known[at] == long, by_token[at], -1)
                    k = prefix_length(len(tokens), percent, MATCHES)
                    order = np.lexsort((mix(tokens), rank))[:k]
                    c = digest(tokens)
                    words = wide_words(len(tokens))
                    if c in seen:  # an equal set of this slice stands for it
                        order, words = order[:0], 0
                    seen.add(c)
                    n.append(len(tokens))
                    c1.append(c)
                    sketch.append(parity(tokens))
                    wide.append(parity(tokens, words) if words else None)
                    prefix.append(long[order])
                ids, keys = (part.column(part.schema.get_field_index(x)) for x in ("doc_id", "k"))
                arrays = [ids, keys, pa.array(n, pa.int64()), pa.array(c1, pa.int64()), pa.array(sketch, pa.list_(pa.int64())), pa.array(wide, pa.list_(pa.int64())), pa.array(prefix, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), row_key())
    return rows.mapInArrow(run, "doc_id long, k long, n_shingles long, c1 long, sketch array<long>, wide array<long>, prefix array<long>")


def postings(classes: DataFrame, percent: int) -> DataFrame:
    """(token, c, n, l, f): where each class's l-prefix meets others; f is the length of the token's list.

    Lists are counted by partial sums, and the join back splits a hot token's rows.
    """
    each = classes.select("c", "n", F.posexplode("prefix").alias("pos", "token"))
    often = each.groupBy("token").agg(F.count("*").alias("f")).where("f > 1")
    met = each.join(often, "token")
    need = F.ceil(F.col("n") * percent / 100).cast("int")
    base_length = F.col("n") - need
    own = W.partitionBy("c")  # at most a document's prefix
    cost, sums = [], {}
    for m in range(1, MATCHES + 1):
        sums[f"_s{m}"] = F.sum(F.when(F.col("pos") < base_length + m, F.col("f") - 1).otherwise(0)).over(own)
        # chance meetings that pass the count fall off with every further match asked for
        cost.append(F.col(f"_s{m}") * (1 + VERIFY_COST / float(4 ** (m - 1))))
    choice = F.lit(1)
    for m in range(2, MATCHES + 1):
        choice = F.when((need >= m) & (F.least(*cost) == cost[m - 1]) & (cost[m - 1] < cost[0]), m).otherwise(choice)
    chosen = met.withColumns(sums).withColumn("l", choice.cast("int"))
    return chosen.where(F.col("pos") < base_length + F.col("l")).select("token", "c", "n", "l", "f", "pos")


MEMBER = ("c", "n", "l", "pos")


def second(met: DataFrame, *more: str) -> DataFrame:
    return met.select("token", *[F.col(x).alias(f"{x}2") for x in (*MEMBER, *more)])


def needed(percent: int) -> Column:
    """Tokens that sets of n and n2 have to share."""
    return F.ceil((F.col("n") + F.col("n2")) * percent / (100 + percent))


def early(percent: int) -> Column:
    """Whether a shared token counts: both sizes fit, and it stands in both l-prefixes cut for this very pair."""
    l, need = F.least("l", "l2"), needed(percent)
    return (F.least("n", "n2") * 100 >= F.greatest("n", "n2") * percent) & (F.col("pos") < F.col("n") - need + l) & (F.col("pos2") < F.col("n2") - need + l)


def apart() -> Column:
    """Places in which the parity sketches of two sets differ."""
    return sum((F.bit_count(F.get("sketch", F.lit(i)).bitwiseXOR(F.get("sketch2", F.lit(i)))) for i in range(SKETCH_WORDS)), F.lit(0))


def wide_apart() -> Column:
    """Places in which two wide sketches differ, the longer one folded; null where a set has none."""
    words = F.least(F.size("wide"), F.size("wide2"))

    def folded(sketch: Column) -> Column:
        turns = F.sequence(F.lit(0), (F.size(sketch) / words).cast("int") - 1)
        at = F.sequence(F.lit(0), words - 1)
        return F.transform(at, lambda i: F.aggregate(turns, F.lit(0).cast("long"), lambda a, j: a.bitwiseXOR(F.get(sketch, i + j * words))))

    both = F.zip_with(folded(F.col("wide")), folded(F.col("wide2")), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.when(F.col("wide").isNotNull() & F.col("wide2").isNotNull(), F.aggregate(both, F.lit(0), lambda a, x: a + x))


def allowance(percent: int) -> Column:
    """Tokens that two linked sets of n and n2 have apart, at most."""
    return F.col("n") + F.col("n2") - 2 * needed(percent)


def alike(percent: int) -> Column:
    """Whether the parity sketches leave room for a link: it never says no to one."""
    return apart() <= allowance(percent)


def counted(rows: DataFrame) -> DataFrame:
    """(a, b, k, l): the shared tokens of each pair and how many it has to have."""
    return rows.groupBy("a", "b").agg(F.count("*").alias("k"), F.min(F.least("l", "l2")).alias("l"))


def pairs_of_short_lists(met: DataFrame, percent: int) -> DataFrame:
    """Every pair (a < b) of short lists, counted; a list, of ``SHORT_LIST`` rows at most, stands beside each of its rows, so rows are shuffled once."""
    short = met.where(F.col("f") <= SHORT_LIST).select("token", F.struct(*MEMBER).alias("m"))
    listed = short.withColumn("_all", F.collect_list("m").over(W.partitionBy("token")))  # rows are shuffled as they are, the list is made after
    two = listed.select("m", F.explode(F.filter("_all", lambda x: x.c > F.col("m.c"))).alias("o"))
    both = two.select(*[F.col(f"m.{x}") for x in MEMBER], *[F.col(f"o.{x}").alias(f"{x}2") for x in MEMBER]).where(early(percent))
    return counted(both.withColumns({"a": F.col("c"), "b": F.col("c2")}))


def stars_of_long_lists(met: DataFrame, percent: int) -> DataFrame:
    """The least class of each long list with all others, counted."""
    long = met.where(F.col("f") > SHORT_LIST)
    least = long.groupBy("token").agg(F.min(F.struct(*MEMBER)).alias("m")).select("token", *[F.col(f"m.{x}").alias(f"{x}2") for x in MEMBER])
    both = long.join(least, "token").where((F.col("c") > F.col("c2")) & early(percent))
    return counted(both.withColumns({"a": F.col("c2"), "b": F.col("c")}))


def bands(percent: int) -> list[Column]:
    """The band of sizes of a set of n, between the first and the last that sizes which fit n stand in: mostly one or two."""
    reach = math.log(1.0001 * 100 / percent)
    return [F.floor((F.log(F.col("n").cast("double")) + by * reach) / (BAND * reach)).cast("int") for by in (-1, 0, 1)]


def pairs_between_components(met: DataFrame, labels: DataFrame | None, places: DataFrame, percent: int, centres: int | None = None) -> DataFrame:
    """Pairs of long lists that stand in two components and may link, counted: the list's members outside its largest one, against all.

    With ``centres``, against about so many of the list alone; which ones is a matter of their digests.
    """
    long = met.where(F.col("f") > SHORT_LIST)
    named = long.withColumn("root", F.col("c")) if labels is None else long.join(labels.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    held = named.groupBy("token", "root").agg(F.count("*").alias("m"))
    largest = held.groupBy("token").agg(F.max(F.struct("m", "root")).alias("most"), F.count("*").alias("roots")).where("roots > 1")
    open_ = named.join(largest.select("token", F.col("most.root").alias("largest")), "token").join(places.select("c", "sketch"), "c")
    first, own, last = bands(percent)
    open_ = materialize(open_.withColumns({"band": own, "bands": F.sequence(first, last)}), "open")
    minor = second(open_.where("root <> largest"), "root", "sketch", "bands").withColumn("band", F.explode("bands2"))
    once = (F.col("root") == F.col("largest")) | (F.col("c") < F.col("c2"))
    if centres is None:
        against = open_
    else:
        # a digest below this share of its range: one list's centres are another's too, so a pair meets in all that they share
        drawn = F.pmod(F.xxhash64("c"), F.lit(1 << 30)) * F.col("f") < centres * (1 << 30)
        against, once = open_.where(drawn), F.lit(True)
    both = against.join(minor, ["token", "band"]).where((F.col("root") != F.col("root2")) & once & early(percent) & alike(percent))
    return counted(both.withColumns({"a": F.least("c", "c2"), "b": F.greatest("c", "c2")}))


def enough(*found: DataFrame) -> DataFrame:
    """The pairs that share as many tokens, over all kinds of lists, as their smaller l asks for."""
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.groupBy("a", "b").agg(F.sum("k").alias("k"), F.min("l").alias("l")).where("k >= l").select("a", "b")


def likely(pairs: DataFrame, places: DataFrame, percent: int) -> DataFrame:
    """(a, b, far) of the pairs that the parity sketches allow to link; far is the share of the allowance that they use."""
    pairs = materialize(pairs.select("a", "b"), "pairs")
    places = sift(places, "c", pairs.select(F.col("a").alias("c")).union(pairs.select("b")))
    left, right = (places.select(F.col("c").alias(x), F.col("n").alias(f"n{y}"), F.col("sketch").alias(f"sketch{y}")) for x, y in (("a", ""), ("b", "2")))
    both = pairs.join(left, "a").join(right, "b").where(alike(percent)).select("a", "b", apart().alias("apart"), allowance(percent).alias("room"))
    wide = places.where("wide is not null")
    left, right = (wide.select(F.col("c").alias(x), F.col("wide").alias(f"wide{y}")) for x, y in (("a", ""), ("b", "2")))
    both = both.join(left, "a", "left").join(right, "b", "left").withColumn("apart", F.greatest("apart", F.coalesce(wide_apart(), F.lit(0))))
    return both.where("apart <= room").select("a", "b", (F.col("apart") / F.greatest("room", F.lit(1))).alias("far"))


def text_rows(docs: DataFrame) -> DataFrame:
    return docs.select(row_key().alias("_id"), F.col("text").cast("string").alias("text"))


def texts_for(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(meet, c, text): a text of class c for each wanted (meet, c, _id)."""
    return sift(rows, "_id", wanted.select("_id")).join(wanted, "_id").select("meet", "c", "text")


def linked(pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of (a, b, x, y) whose texts x and y link."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        last, own = None, _EMPTY  # pairs of one set follow each other
        for batch in batches:
            for part in chunks(batch, "y"):
                names = part.schema.get_field_index
                a, b = (part.column(names(c)).to_numpy() for c in "ab")
                x = part.column(names("x"))
                hit = np.zeros(len(a), bool)
                for i, other in enumerate(token_sets(part, width, "y")):
                    if a[i] != last:
                        one = pa.RecordBatch.from_arrays([x.slice(i, 1)], ["text"])
                        last, own = a[i], token_sets(one, width)[0]
                    shared = len(np.intersect1d(own, other, assume_unique=True))
                    # a text whose key met another's by chance is not of the class
                    hit[i] = shared * 100 >= (len(own) + len(other) - shared) * percent and digest(own) == a[i] and digest(other) == b[i]
                yield pa.RecordBatch.from_arrays([pa.array(a[hit]), pa.array(b[hit])], schema=schema)

    return pairs.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, places: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link. Texts, smaller than their sets, meet at a, of which there is a copy for every ``MEET_PAIRS`` of its pairs."""
    copies = materialize(pairs.groupBy("a").agg(F.ceil(F.count("*") / MEET_PAIRS).cast("int").alias("copies")), "copies")
    leaders = copies.join(places.select(F.col("c").alias("a"), "_id"), "a").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    dealt = pairs.join(copies, "a").withColumn("copy", F.pmod(F.xxhash64("b"), "copies").cast("int"))
    meet = F.xxhash64("a", "copy").alias("meet")
    members = dealt.join(places.select(F.col("c").alias("b"), "_id"), "b").select(meet, F.col("b").alias("c"), "_id")
    rows = text_rows(docs)
    leaders, members = materialize(leaders.select(meet, F.col("a").alias("c"), "_id"), "leaders"), materialize(members, "members")
    left = texts_for(rows, leaders).select("meet", F.col("c").alias("a"), F.col("text").alias("x"))
    right = texts_for(rows, members).select("meet", F.col("c").alias("b"), F.col("text").alias("y"))
    out = materialize(linked(right.join(left, "meet"), width, percent).distinct(), "links")
    for done in (copies, leaders, members):
        drop_materialized(done)
    return out


def join_documents(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``joined``, with batches of ``TEXT_ROWS`` rows: all that runs in Python is written before it returns."""
    with arrow_rows(docs.sparkSession, TEXT_ROWS):
        return joined(docs, width, percent)


def joined(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id, n_links, k, root for every row.

    ``class_id`` is the least doc_id of the rows with an equal set; ``n_links``
    counts the set's links among those verified, enough to connect its component;
    ``root`` is one class digest per component, null for the empty set.
    """
    base = materialize(signatures(docs, frequent_tokens(docs, width), width, percent), "signatures")
    places = base.where("n_shingles > 0").groupBy(F.col("c1").alias("c")).agg(
        least_row().alias("least"), F.first("n_shingles").cast("int").alias("n"), F.first("sketch").alias("sketch"), F.first("wide", ignorenulls=True).alias("wide"), F.max("prefix").alias("prefix")
    )
    places = materialize(places.select("c", F.col("least.doc_id").alias("class_id"), "n", "sketch", "wide", F.col("least.k").alias("_id"), "prefix"), "classes")
    named = materialize(base.select("doc_id", "k", "n_shingles", "c1"), "rows")
    drop_materialized(base)  # the classes have its prefixes and sketches
    met = materialize(postings(places, percent), "postings")
    short = materialize(pairs_of_short_lists(met, percent), "short")

    def verify(pairs: DataFrame) -> DataFrame:
        return verified(pairs, places, docs, width, percent)

    links, labels = connected(likely(enough(short, stars_of_long_lists(met, percent)), places, percent), verify)
    some = pairs_between_components(met, labels, places, percent, CENTRES).select("a", "b")
    links, labels = connected(likely(some, places, percent), verify, links, labels)
    between = materialize(pairs_between_components(met, labels, places, percent), "between")
    links, labels = connected(likely(enough(between, short.join(between, ["a", "b"], "left_semi")), places, percent), verify, links, labels)
    if links is None:
        links = short.select("a", "b").where("false")
        labels = short.select(F.col("a").alias("node"), F.col("b").alias("root")).where("false")

    ends = links.select(F.col("a").alias("c")).unionAll(links.select("b")).groupBy("c").agg(F.count("*").alias("n_links"))
    known = places.select("c", "class_id").join(labels.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    least = known.groupBy("root").agg(F.min("class_id").alias("component_id"))
    by_class = known.join(least, "root").join(ends, "c", "left").select(F.col("c").alias("c1"), "component_id", "class_id", "n_links", "root")
    empty = F.col("n_shingles") == 0
    out = named.select("doc_id", "k", "n_shingles", F.when(~empty, F.col("c1")).alias("c1")).join(by_class, "c1", "left")
    return out.select(
        "doc_id",
        "n_shingles",
        F.when(empty, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(empty, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        "k",
        "root",
    )


def op2(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return join_documents(docs).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs without near duplicates: one row of each component, that of the least doc_id.

    A component is known by its root, so rows of a null doc_id, or of one that
    unlike texts share, stand for themselves. Rows without a word link with
    nothing and stay, those of equal doc_id and text once; a null id equals none.
    """
    rooted = materialize(join_documents(docs, width, percent).select("doc_id", "k", "root"), "joined")
    keep = rooted.where("root is not null").groupBy("root").agg(least_row().alias("least")).select(F.col("least.k").alias("_k"))
    wordless = rooted.where("root is null").select(F.col("k").alias("_k")).distinct()
    whole = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_id"), row_key().alias("_k"))
    kept = whole.join(keep, "_k", "left_semi").dropDuplicates(["_k"])
    empty = whole.join(wordless, "_k", "left_semi")
    named = empty.where("_id is not null").dropDuplicates(["_k"])
    return kept.unionByName(named).unionByName(empty.where("_id is null")).select("_row.*")


def brute_force(rows: list[tuple[int, str | None]], width: int = WIDTH, percent: int = PERCENT) -> dict[int, tuple[int, int]]:
    """The definition on a small list with unique ids, for tests: n_shingles and component_id."""
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    sets = {}
    for doc_id, text in rows:
        w = (text or "").encode().translate(lower).split()
        sets[doc_id] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * 100 >= max(len(x), len(y)) * percent:
                k = len(x & y)
                if 100 * k >= percent * (len(x) + len(y) - k):
                    p, q = find(a), find(b)
                    root[max(p, q)] = min(p, q)
    return {d: (len(sets[d]), find(d)) for d in ids}
