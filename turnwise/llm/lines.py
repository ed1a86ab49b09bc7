"""Fuzzy line dedup: SimHash, pigeonhole blocks, edit similarity, connected groups.

A line is normalised (ASCII letters lowered, digits to 0, other ASCII signs to
blanks, blanks collapsed). Lines whose normalised texts are equal are one from
the start. Two different ones link if they are candidates and their edit
similarity (1 - distance / longer length) is ``SIMILAR`` or more. Of each
connected group the first line stays, by doc_id and place; the others go.

Candidates agree on a pigeonhole block, and their SimHashes differ in ``HAMMING``
of 64 bits at most. Each different word of a line votes once. The bits of a
SimHash scatter: one word of ten replaced flips nine of 64, so blocks of bits find
few of these lines. Blocks are therefore cut by features: a word votes in one block alone,
chosen by its hash, so the words that change leave all other blocks as they are.
``BANDS`` says by length how many blocks there are, how many have to be equal,
and how many words they have to hold, so that a few common words make no
candidates. Under eight words, every word is a block and all but one have to be
equal. Lines little longer than the start of their band
are in the band below as well. README has the recall against edit similarity
alone. All of this depends on the two lines only, never on how many there are.

Rows (key, line), numbers alone, travel as arrays, one for each part of the keys' range, and
meet part by part; of a hot block one line alone is held. Lengths are counted in characters, so no
two lines meet whose lengths alone rule a link out. Texts of lines that stand in
shared blocks are set aside once. Each block
yields a star, one of its lines with all others; every component verifies its
nearest pair, round by round; then pairs of blocks that still stand between two
components follow, the members outside a block's largest component against all.

Defined cases: lines without a word stay; a line of one word links with equal
ones alone; null text stays null; rows with equal doc_id and text stand for one
document, each with the same result; rows of a null doc_id come first; a row
whose every line went keeps its place with an empty text; very long lines are
taken whole, and one line has to fit in memory; extra columns, whatever their
names, are carried by ``cleaned``; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import arrow_rows, drop_materialized, materialize
from .components import connected
from .tables import sift
from .words import Words, as_long, chunks, mix, split_words

HAMMING = 20
SIMILAR = 0.8
#: (words from which on, blocks, blocks that have to be equal, words that these hold at least); beyond the last, twice the words have twice the blocks
BANDS = ((8, 5, 2, 4), (16, 4, 1, 4), (24, 6, 1, 4), (32, 8, 1, 4))
OVERLAP = 1.25  # a line up to so much longer than a band of lengths is in the band below too
SHORT_CHARS = 64  # texts up to this length are compared by the JVM
BOUNDS_CHARS = 256  # beyond this length bounds cost less than the distance
SIDE_CHARS, SIDE_PAIRS, SIDE_CELLS, SIDE_SIGNS = 640, 512, 1 << 18, 128  # texts up to this length are compared side by side, so many pairs, or characters, at once, of so many different ones
PART_BITS = 12  # the range of the keys is dealt in so many bits' parts
DEALT_KEYS = 1 << 20  # keys that a task deals, or holds, at once
DEALT_ROWS = 2048  # of a batch that Spark hands to Python there
_BINS = 8192
_SEED = 0x082EFA98EC4E6C89
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).reshape(-1)
_TABLE = np.arange(256, dtype=np.uint8)
_TABLE[:128] = [ord(c.lower()) if c.isalpha() else 48 if c.isdigit() else 10 if c == "\n" else 32 for c in map(chr, range(128))]


def simhash(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Bitwise majority of the hashes h[first[i]:first[i + 1]]; no run is empty."""
    n = np.diff(np.append(first, len(h)))
    octets = h.view(np.uint8).reshape(-1, 8)
    # a byte counts one bit, so runs of up to 255 are summed as eight numbers each
    ones = np.stack([np.add.reduceat(_SPREAD[octets[:, j]], first) for j in range(8)], 1).view(np.uint8).astype(np.int32)
    for i in np.nonzero(n > 255)[0]:
        ones[i] = np.unpackbits(octets[first[i] : first[i] + n[i]], axis=1).sum(0)
    return np.packbits(2 * ones > n[:, None], axis=1).reshape(-1).view(np.uint64)


def distinct(h: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different words' hashes of each line, line by line, and their lines, of which a slice has less than 2^22."""
    order = np.argsort((line.astype(np.uint64) << np.uint64(42)) | (h >> np.uint64(22)))
    h, line = h[order], line[order]
    new = np.ones(len(h), bool)
    new[1:] = (line[1:] != line[:-1]) | (h[1:] != h[:-1])
    return h[new], line[new]


def block_hashes(h: np.ndarray, line: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(line, block, SimHash of the block's words, their number) of every block that has words; ``blocks`` is the number of each word's line."""
    at = (mix(h ^ _GOLD) >> np.uint64(32)).astype(np.int64) * blocks >> 32
    key = line * (int(blocks.max()) + 1) + at
    order = np.argsort(key)
    key = key[order]
    first = np.nonzero(np.append(True, key[1:] != key[:-1]))[0]
    return line[order][first], at[order][first], simhash(h[order], first), np.diff(np.append(first, len(h)))


def bands(n: np.ndarray) -> list[np.ndarray]:
    """The band (-1: none) of each line of n words, and the one below if it is little longer than its own band's start."""
    starts = np.array([band[0] for band in BANDS])
    last = len(starts) - 1
    doubled = np.floor(np.log2(np.maximum(n, 1) / starts[last])).astype(np.int64)
    own = np.where(doubled > 0, last + doubled, np.searchsorted(starts, n, "right") - 1)
    start = np.where(own > last, starts[last] << np.maximum(own - last, 0), starts[np.clip(own, 0, last)])
    return [own, np.where(n < OVERLAP * start, own - 1, -1)]


def keys_of(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(line, key): the pigeonhole keys of lines of n different words each, whose hashes follow one another in h."""
    line, at = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
    found = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
    # every word of the shortest lines is a block of its own: all of them, and all but one
    for size in range(2, BANDS[0][0] + 2):
        which = np.nonzero(n == size)[0]
        each = mix(h[at[which][:, None] + np.arange(size)] ^ _GOLD)
        total = each.sum(1, dtype=np.uint64)
        if size < BANDS[0][0]:
            found.append((which, mix(total + mix(np.full(len(which), size, np.uint64)))))
        left = total[:, None] - each + mix(np.full(1, size - 1, np.uint64))
        found.append((np.repeat(which, size), mix(left.reshape(-1))))
    last = len(BANDS) - 1
    for band in bands(n):
        for i, (_, count, agree, least) in enumerate(BANDS):
            fits = (band == i) | ((i == last) & (band > last))
            take = fits[line]
            if not take.any():
                continue
            blocks = count << np.maximum(band - i, 0)
            of, block, sim, words = block_hashes(h[take], line[take], blocks[line[take]])
            value = mix(sim ^ mix((block + (blocks[of] << 32)).astype(np.uint64) + _GOLD))
            if agree == 1:
                found.append((of[words >= least], value[words >= least]))
                continue
            which = np.nonzero(fits)[0]
            row = np.zeros(len(n), np.int64)
            row[which] = np.arange(len(which))
            table, held = np.zeros((len(which), count), np.uint64), np.zeros((len(which), count), np.int64)
            table[row[of], block], held[row[of], block] = value, words
            for chosen in combinations(range(count), agree):
                there = held[:, list(chosen)].sum(1) >= least
                key = np.full(len(which), sum(1 << c for c in chosen) + (count << 32), np.uint64)
                for c in chosen:
                    key = mix(key * np.uint64(0xC2B2AE3D27D4EB4F) + table[:, c])
                found.append((which[there], key[there]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("k"))


def texts_at(words: Words, line: np.ndarray, wanted: np.ndarray, size: np.ndarray) -> pa.Array:
    """The words of each wanted line, a blank between two, null for other lines; ``line`` is that of each word, ``size`` the bytes of each text."""
    chosen = wanted[line]
    inner = chosen & np.append(False, line[1:] == line[:-1])
    edge = np.zeros(len(words.data) + 1, np.int8)
    edge[words.start[chosen]] = 1
    edge[words.end[chosen]] -= 1
    held = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    held[words.start[inner] - 1] = True  # the blank before a word
    data = words.data[held]
    data[np.cumsum(held)[words.start[inner] - 1] - 1] = 32
    offsets = np.append(0, np.cumsum(np.where(wanted, size, 0)))
    return pa.Array.from_buffers(pa.large_string(), len(wanted), [pa.py_buffer(np.packbits(wanted, bitorder="little")), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])


def lines(rows: DataFrame) -> DataFrame:
    """(line, sim, size, keys, said, doc_id, k, at) of every line with a word; line is the hash of its normalised text, size its characters.

    Of equal lines in a slice of text only the first carries its keys and ``said``, its normalised text.
    """
    fields = [("line", pa.int64()), ("sim", pa.int64()), ("size", pa.int32()), ("keys", pa.list_(pa.int64())), ("said", pa.string()), ("doc_id", pa.int64()), ("k", pa.int64()), ("at", pa.int32())]
    schema = pa.schema(fields)

    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                words = split_words(part.column(part.schema.get_field_index("text")), table=_TABLE)
                if not len(words.start):
                    continue
                breaks = np.nonzero(words.data == 10)[0]
                row = np.searchsorted(words.first, np.arange(len(words.start)), "right") - 1
                place = np.searchsorted(breaks, words.start) - np.searchsorted(breaks, words.offset[:-1])[row]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1])
                first = np.nonzero(new)[0]
                h = words.hashes(_SEED)
                n = np.diff(np.append(first, len(h)))
                within = np.arange(len(h)) - np.repeat(first, n)
                whole = mix(np.add.reduceat(mix(h + within.astype(np.uint64) * _GOLD), first))
                many = np.add.reduceat(words.end - words.start, first) + n - 1
                later = np.append(0, np.cumsum((words.data & 0xC0) == 0x80))  # bytes of a character after its first
                size = many - np.add.reduceat(later[words.end] - later[words.start], first)
                of_word = np.repeat(np.arange(len(n)), n)
                # a word counts once, or the commonest ones would outvote all others
                h, of_line = distinct(h, of_word)
                n = np.bincount(of_line, minlength=len(n))
                sim = simhash(h, np.cumsum(n) - n)
                _, leads = np.unique(whole, return_index=True)
                leading = np.zeros(len(n), bool)
                leading[leads] = True
                leads = np.nonzero(leading)[0]
                of, key = keys_of(h[np.repeat(leading, n)], n[leads])
                order = np.argsort(of, kind="stable")
                count = np.zeros(len(n), np.int64)
                count[leads] = np.bincount(of, minlength=len(leads))
                keys = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)).astype(np.int32)), pa.array(as_long(key[order])))
                said = texts_at(words, of_word, leading, many).cast(pa.string())
                ids, names = part.column(part.schema.get_field_index("doc_id")), part.column(part.schema.get_field_index("k"))
                at = pa.array(row[first])
                arrays = [pa.array(as_long(whole)), pa.array(as_long(sim)), pa.array(size.astype(np.int32)), keys, said, ids.take(at), names.take(at), pa.array(place[first].astype(np.int32))]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return rows.mapInArrow(run, "line long, sim long, size int, keys array<long>, said string, doc_id long, k long, at int")


def may_link() -> Column:
    """Whether the lengths leave room for the edit similarity and the SimHashes are near."""
    apart, longer = F.abs(F.col("size") - F.col("size2")), F.greatest("size", "size2")
    return (apart <= F.floor((1 - SIMILAR) * longer + 1e-9)) & (F.bit_count(F.col("sim").bitwiseXOR(F.col("sim2"))) <= HAMMING)


MET = ("key", "line", "sim", "size")


def dealt_keys(kinds: DataFrame) -> DataFrame:
    """(part, key, line, sim, size) of kinds' keys, as arrays: a task's numbers of a part of the keys' range are a row, or a few."""
    types = [pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32())]
    schema = pa.schema(list(zip(("part", *MET), types, strict=True)))

    def rows_of(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        columns = [np.concatenate(x) for x in zip(*held, strict=True)]
        part = (columns[0].view(np.uint64) >> np.uint64(64 - PART_BITS)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        part = part[order]
        first = np.nonzero(np.append(True, part[1:] != part[:-1]))[0]
        offsets = pa.array(np.append(first, len(part)).astype(np.int32))
        arrays = [pa.ListArray.from_arrays(offsets, pa.array(c[order])) for c in columns]
        return pa.RecordBatch.from_arrays([pa.array(part[first]), *arrays], schema=schema)

    def run(batches):
        held, n = [], 0
        for batch in batches:
            keys = batch.column(0)
            count = np.diff(keys.offsets.to_numpy())
            held.append([keys.flatten().to_numpy(), *[np.repeat(c.to_numpy(), count) for c in batch.columns[1:]]])
            n += int(count.sum())
            if n >= DEALT_KEYS:
                yield rows_of(held)
                held, n = [], 0
        if n:
            yield rows_of(held)

    found = kinds.where(F.size("keys") > 0).select("keys", "line", "sim", "size")
    return found.mapInArrow(run, "part int, key array<long>, line array<long>, sim array<long>, size array<int>")


def blocks_met(kinds: DataFrame) -> DataFrame:
    """(key, line, sim, size, line2, sim2, size2, wide) of the blocks that two lines or more share, line2 being one line for all of a block; wide: three or more do.

    A part's rows follow each other. Of a block of three lines or more only line2 is held once ``DEALT_KEYS`` numbers have come.
    """
    dealt = dealt_keys(kinds).repartition("part").sortWithinPartitions("part")
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32()]
    schema = pa.schema([*zip(MET, types, strict=True), *zip((f"{c}2" for c in MET[1:]), types[1:], strict=True), ("wide", pa.bool_())])

    def settled(rows: list[np.ndarray], over: bool) -> tuple[pa.RecordBatch, list[np.ndarray]]:
        """The rows whose block has its line2, and what has to be held until the part is over; the last column says which rows were given before, as a line2."""
        order = np.lexsort((~rows[-1], rows[0]))
        rows = [c[order] for c in rows]
        new = np.append(True, rows[0][1:] != rows[0][:-1])
        first = np.nonzero(new)[0]
        n = np.diff(np.append(first, len(new)))
        n, first = np.repeat(n, n), np.repeat(first, n)
        given, before = rows[-1], rows[-1][first]
        wide = before | (n > 2)
        ready = (n > 1) if over else wide
        out = ready & ~given
        columns = [*[c[out] for c in rows[:-1]], *[c[first[out]] for c in rows[1:-1]], wide[out]]
        held = np.zeros(len(new), bool) if over else ~ready | new
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)
        return batch, [*[c[held] for c in rows[:-1]], ready[held]]

    def run(batches):
        now, held, n, most = None, [], 0, DEALT_KEYS
        for batch in batches:
            part = batch.column(0).to_numpy()
            first = np.nonzero(np.append(True, part[1:] != part[:-1]))[0]
            for at, to in zip(first, np.append(first[1:], len(part)), strict=True):
                if held and part[at] != now:
                    yield settled([np.concatenate(x) for x in zip(*held, strict=True)], True)[0]
                    held, n, most = [], 0, DEALT_KEYS
                now = part[at]
                rows = [c.slice(at, to - at).flatten().to_numpy() for c in batch.columns[1:]]
                held.append([*rows, np.zeros(len(rows[0]), bool)])
                n += len(rows[0])
                if n >= most:
                    found, left = settled([np.concatenate(x) for x in zip(*held, strict=True)], False)
                    yield found
                    held, n = [left], len(left[0])
                    most = max(DEALT_KEYS, 2 * n)
        if held:
            yield settled([np.concatenate(x) for x in zip(*held, strict=True)], True)[0]

    return dealt.mapInArrow(run, "key long, line long, sim long, size int, line2 long, sim2 long, size2 int, wide boolean")


def named_pairs(both: DataFrame, *more: Column) -> DataFrame:
    far = F.bit_count(F.col("sim").bitwiseXOR(F.col("sim2"))).alias("far")
    return both.select(F.least("line", "line2").alias("a"), F.greatest("line", "line2").alias("b"), far, *more).distinct()


def stars(met: DataFrame) -> DataFrame:
    """(a, b, far): in each block one line, another one in another block, with all the others."""
    return named_pairs(met.where((F.col("line") != F.col("line2")) & may_link()))


def pairs_between_components(met: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(a, b, far): in each block of three lines or more, those outside its largest component against all."""
    wide = met.where("wide").select(*MET)
    named = wide.withColumn("root", F.col("line")) if labels is None else wide.join(labels.withColumnRenamed("node", "line"), "line", "left").withColumn("root", F.coalesce("root", "line"))
    held = named.groupBy("key", "root").agg(F.count("*").alias("m"))
    largest = held.groupBy("key").agg(F.max(F.struct("m", "root")).alias("most"), F.count("*").alias("roots")).where("roots > 1")
    open_ = materialize(named.join(largest.select("key", F.col("most.root").alias("largest")), "key"), "open")
    minor = open_.where("root <> largest").select("key", *[F.col(c).alias(f"{c}2") for c in ("line", "sim", "size", "root")])
    once = (F.col("root") == F.col("largest")) | (F.col("line") < F.col("line2"))
    both = open_.join(minor, "key").where((F.col("root") != F.col("root2")) & once & may_link())
    first = F.col("line") < F.col("line2")
    roots = [F.when(first, F.col(x)).otherwise(F.col(y)).alias(z) for x, y, z in (("root", "root2", "ra"), ("root2", "root", "rb"))]
    return named_pairs(both, *roots)


def texts_of(every: DataFrame, wanted: DataFrame) -> DataFrame:
    """(line, said) of the wanted lines."""
    carried = sift(every.where("said is not null").select("line", "said"), "line", wanted.select("line"))
    # Spark would take a semi join before the sifting
    return carried.join(wanted.select("line").distinct(), "line").groupBy("line").agg(F.first("said").alias("said"))


def distance_bounds(x: str, y: str) -> tuple[int, int]:
    """(least, most): what the edit distance is at least, by characters and runs of three in common, and at most, by an alignment of words."""
    a, b = (np.frombuffer(s.encode("utf-32-le"), "<u4").astype(np.int64) for s in (x, y))
    longer = max(len(a), len(b))

    def shared(p: np.ndarray, q: np.ndarray) -> int:  # or more, where bins hold several values
        return int(np.minimum(np.bincount(p % _BINS, minlength=_BINS), np.bincount(q % _BINS, minlength=_BINS)).sum())

    # an edit takes one character and three runs of three away from the longer text, at most
    a3, b3 = ((s[:-2] * 961 + s[1:-1] * 31 + s[2:]) if len(s) > 2 else s[:0] for s in (a, b))
    least = max(longer - shared(a, b), -(-(longer - 2 - shared(a3, b3)) // 3))
    # words that stand once in each text, in a rising order in both, stay; what is between two of them is replaced
    u, v = x.split(" "), y.split(" ")
    once_u, once_v = ({w: i for i, w in enumerate(t) if c[w] == 1} for t, c in ((t, Counter(t)) for t in (u, v)))
    tops, back, ends = [], {}, []
    for i, w in enumerate(u):
        j = once_v.get(w) if w in once_u else None
        if j is None:
            continue
        place = int(np.searchsorted(tops, j)) if tops and tops[-1] > j else len(tops)
        back[i, j] = ends[place - 1] if place else None
        if place == len(tops):
            tops.append(j)
            ends.append((i, j))
        else:
            tops[place], ends[place] = j, (i, j)
    chain, at = [], ends[-1] if ends else None
    while at is not None:
        chain.append(at)
        at = back[at]
    most, i0, j0 = 0, 0, 0
    for i, j in [*reversed(chain), (len(u), len(v))]:
        while i0 < i and j0 < j and u[i0] == v[j0]:
            i0, j0 = i0 + 1, j0 + 1
        p, q = i, j
        while p > i0 and q > j0 and u[p - 1] == v[q - 1]:
            p, q = p - 1, q - 1
        if p - i0 == q - j0:  # word by word
            most += sum(max(len(s), len(t)) for s, t in zip(u[i0:p], v[j0:q], strict=True) if s != t)
        else:
            most += max(sum(map(len, u[i0:p])) + p - i0, sum(map(len, v[j0:q])) + q - j0)
        i0, j0 = i + 1, j + 1
    return least, most


def same_start(x: str, y: str) -> int:
    """How many characters x and y have in common from the start."""
    lo, hi = 0, min(len(x), len(y))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if x[lo:mid] == y[lo:mid] else (lo, mid - 1)
    return lo


def within(x: str, y: str, most: int) -> bool:
    """Whether the edit distance of x and y is ``most`` at most: a column of the table is two numbers of len(x) bits, so a step costs a 64th of its cells."""
    if not x or not y:
        return max(len(x), len(y)) <= most
    at: dict[str, list[int]] = {}
    for i, c in enumerate(x):
        at.setdefault(c, []).append(i)

    def places(c: str) -> int:
        bits = bytearray(len(x) // 8 + 1)
        for i in at.get(c, ()):
            bits[i >> 3] |= 1 << (i & 7)
        return int.from_bytes(bits, "little")

    # of 1,024 characters at most the places are kept, others' are made when met
    held = {c: places(c) for c, where in at.items() if len(where) * 1024 >= len(x)}
    full, top = (1 << len(x)) - 1, len(x) - 1
    up, down, now, left = full, 0, len(x), len(y)
    for c in y:
        same = held[c] if c in held else places(c)
        level = same | down
        kept = (((same & up) + up) ^ up) | same
        more, less = down | (full & ~(kept | up)), up & kept
        now += (more >> top & 1) - (less >> top & 1)
        left -= 1
        if now - left > most:  # a column changes the last row by one at most
            return False
        more = more << 1 & full | 1
        up, down = less << 1 & full | full & ~(level | more), more & level
    return now <= most


def within_each(xs: list[str], ys: list[str], most: list[int]) -> np.ndarray:
    """``within`` of each pair of texts that are not empty, side by side: a step is one column of every pair's table, 64 rows of it a number."""
    n, m = (np.array([len(s) for s in t]) for t in (xs, ys))
    room, rows = np.array(most), len(xs)
    every = np.frombuffer("".join([*xs, *ys]).encode("utf-32-le"), "<u4")
    codes = np.unique(every, return_inverse=True)[1] + 1
    words, signs = -(-int(n.max()) // 64), int(codes.max()) + 1
    if signs > SIDE_SIGNS:
        return np.array([within(*pair) for pair in zip(xs, ys, most, strict=True)])

    def table(size: np.ndarray, width: int, flat: np.ndarray) -> np.ndarray:
        out = np.zeros((rows, width), np.uint8)
        out[np.arange(width) < size[:, None]] = flat
        return out

    x, y = table(n, 64 * words, codes[: n.sum()]), np.ascontiguousarray(table(m, int(m.max()), codes[n.sum() :]).T)
    one = np.uint64(1)
    # bit i of places[w, c, r]: whether character 64 w + i of text r is c; no character is 0
    places = np.stack([np.packbits(x == c, axis=1, bitorder="little").view(np.uint64).T if c else np.zeros((words, rows), np.uint64) for c in range(signs)], 1)
    up, down = np.full((words, rows), ~np.uint64(0)), np.zeros((words, rows), np.uint64)
    last, bit = (n - 1) // 64, ((n - 1) % 64).astype(np.uint64)
    now, yes, told, live = n.copy(), np.zeros(rows, bool), np.zeros(rows, bool), np.arange(rows)
    for j in range(int(m.max())):
        each, rise, fall = np.arange(len(live)), np.empty_like(up), np.empty_like(up)
        into, out = np.ones(len(live), np.uint64), np.zeros(len(live), np.uint64)  # the difference above a word: more, less
        for w in range(words):
            eq = places[w][y[j], each]
            level = eq | down[w]
            eq = eq | out
            kept = (((eq & up[w]) + up[w]) ^ up[w]) | eq
            more, less = down[w] | ~(kept | up[w]), up[w] & kept
            rise[w], fall[w] = more, less
            more, less, into, out = more << one | into, less << one | out, more >> np.uint64(63), less >> np.uint64(63)
            up[w], down[w] = less | ~(level | more), more & level
        now += ((rise[last, each] >> bit) & one).astype(np.int64) - ((fall[last, each] >> bit) & one).astype(np.int64)
        # a column changes the last row by one at most
        done = ~told & ((m == j + 1) | (now - (m - j - 1) > room))
        if done.any():
            yes[live[done]] = now[done] <= room[done]
            told |= done
            left = ~told
            if not left.any():
                break
            if 4 * left.sum() > 3 * len(live):
                continue
            told, live, places, y, up, down = told[left], live[left], places[:, :, left], y[:, left], up[:, left], down[:, left]
            last, bit, now, m, room = last[left], bit[left], now[left], m[left], room[left]
    return yes


def alike(pairs: DataFrame) -> DataFrame:
    """(a, b) of the pairs of texts (a, b, x, y) that are similar: by bounds where these tell, else by their distance."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def settled(x: str, y: str) -> bool | tuple[str, str, int]:
        """Whether x and y are similar, or what is left to compare: two texts and the distance that they may have."""
        room = int((1 - SIMILAR) * max(len(x), len(y)) + 1e-9)
        # what they begin and end with in common has no part in the distance
        same = same_start(x, y)
        x, y = x[same:], y[same:]
        same = same_start(x[::-1], y[::-1])
        x, y = x[: len(x) - same], y[: len(y) - same]
        if max(len(x), len(y)) <= room:
            return True
        if min(len(x), len(y)) > BOUNDS_CHARS:
            least, most = distance_bounds(x, y)
            if most <= room or least > room:
                return most <= room
        if not x or not y:
            return False
        return (x, y, room) if max(len(x), len(y)) <= SIDE_CHARS else within(x, y, room)

    def run(batches):
        for batch in batches:
            found = [settled(x.as_py(), y.as_py()) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yes = np.array([f is True for f in found], bool)
            # pairs of about the same length go side by side
            rest = sorted((i for i, f in enumerate(found) if isinstance(f, tuple)), key=lambda i: (-(-len(found[i][0]) // 64), len(found[i][1])))
            while rest:
                take = max(1, SIDE_CELLS // max(len(found[i][0]) for i in rest[:SIDE_PAIRS]))
                some, rest = rest[: min(take, SIDE_PAIRS)], rest[min(take, SIDE_PAIRS) :]
                yes[some] = within_each(*map(list, zip(*(found[i] for i in some), strict=True)))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(yes)) for c in batch.columns[:2]], schema=schema)

    return pairs.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def similar(narrow: int) -> Column:
    """Edit similarity of x and y, the distance followed only as far as it allows, and in a ``narrow`` band first, where most pairs are near."""
    most = f"cast(floor((1 - {SIMILAR}D) * greatest(length(x), length(y)) + 1e-9D) as int)"
    whole = f"levenshtein(x, y, least({narrow}, {most})) >= 0 or ({most} > {narrow} and levenshtein(x, y, {most}) >= 0)"
    return F.expr(f"abs(length(x) - length(y)) <= {most} and ({whole})")


def verified(pairs: DataFrame, said: DataFrame) -> DataFrame:
    left, right = (sift(said.select(F.col("line").alias(x), F.col("said").alias(y)), x, pairs.select(x)) for x, y in (("a", "x"), ("b", "y")))
    both = materialize(pairs.select("a", "b").join(left, "a").join(right, "b"), "both")
    long = F.greatest(F.length("x"), F.length("y")) > SHORT_CHARS
    out = materialize(both.where(~long).where(similar(4)).select("a", "b").unionByName(alike(both.where(long))), "links")
    drop_materialized(both)
    return out


def surplus(rows: DataFrame) -> DataFrame:
    """(k, gone): the places of the lines that go, per document."""
    every = materialize(lines(rows), "lines", "zstd")  # texts, for the most part
    place = F.struct("doc_id", "k", "at")
    kinds = every.groupBy("line").agg(F.min("sim").alias("sim"), F.min("size").alias("size"), F.min(place).alias("first"), F.max("keys").alias("keys"))
    kinds = materialize(kinds, "kinds")
    with arrow_rows(rows.sparkSession, DEALT_ROWS):
        met = materialize(blocks_met(kinds), "blocks")
    said = materialize(texts_of(every, met), "said")

    def verify(pairs: DataFrame) -> DataFrame:
        return verified(pairs, said)

    links, labels = connected(stars(met), verify)
    links, labels = connected(pairs_between_components(met, labels), verify, links, labels)

    known = kinds.select("line", "first")
    if labels is not None:
        known = known.join(labels.withColumnRenamed("node", "line"), "line", "left").withColumn("root", F.coalesce("root", "line"))
        least = known.groupBy("root").agg(F.min("first").alias("kept"))
        known = known.join(least, "root")
    else:
        known = known.withColumn("kept", F.col("first"))
    gone = every.join(known.select("line", "kept"), "line").where(place != F.col("kept")).select("k", "at")
    out = materialize(gone.groupBy("k").agg(F.collect_set("at").alias("gone")), "gone")
    for done in (every, kinds, met, said):
        drop_materialized(done)
    return out


def marked(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """rows with gone; those that keep every line need no shuffle."""
    met = sift(rows, "k", gone.select("k")).join(gone, "k", "left")
    return met.unionByName(sift(rows, "k", gone.select("k"), inside=False).withColumn("gone", F.lit(None).cast("array<int>")))


def without(found: DataFrame, *keep: str) -> DataFrame:
    """``keep`` with n_lines, n_removed and the text that is left, from text and gone."""
    types = dict(found.dtypes)

    def run(batches):
        for batch in batches:
            n, cut, left = [], [], []
            for text, gone in zip(batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1), strict=True):
                parts = text.as_py().split("\n") if text.is_valid else []
                out = set(gone.as_py()) if gone.is_valid else ()
                n.append(len(parts))
                cut.append(len(out))
                left.append("\n".join(p for i, p in enumerate(parts) if i not in out) if text.is_valid else None)
            arrays = [*batch.columns[:-2], pa.array(n, pa.int64()), pa.array(cut, pa.int64()), pa.array(left, pa.large_string())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, "n_lines", "n_removed", "left"])

    schema = "".join(f"`{c}` {types[c]}, " for c in keep)
    return found.select(*keep, "text", "gone").mapInArrow(run, schema + "n_lines long, n_removed long, left string")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, text of every row."""
    rows = keyed(docs)
    return without(marked(rows, surplus(rows)), "doc_id").withColumnRenamed("left", "text")


def op7(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return dedup_lines(docs)


def cleaned(docs: DataFrame) -> DataFrame:
    """docs with the lines gone from their text (and n_chars, if there, counted anew); rows that lost every line are dropped."""
    whole = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("k"))
    found = marked(whole, surplus(keyed(docs))).withColumn("row", F.col("row").dropFields("text") if len(docs.columns) > 1 else F.col("row"))
    out = without(found, "row").where((F.col("n_removed") == 0) | F.col("left").rlike(r"[^\x20\x09-\x0D]"))
    now = {"text": F.col("left")} | ({"n_chars": F.length("left").cast(dict(docs.dtypes)["n_chars"])} if "n_chars" in docs.columns else {})
    return out.select(*[(now[c] if c in now else F.col("row")[c]).alias(c) for c in docs.columns])
