"""Best-fit packing of token pieces with exact-complement hashing.

Documents are tokenized in tasks and cut into pieces of at most ``limit`` ids.
Only the number of pieces per length, ``limit`` numbers whatever the input, goes
to the driver. There the plan is made on counts: an index from length sums to
the singles, pairs and triples that make them up tells, for the gap above the
longest piece left, which combination fills it exactly; as many sequences of
that pattern are taken as the availability counts allow. What no combination
completes goes, longest first, to the fullest open sequence that has room.

Pieces are then ranked within their length, over salted buckets, and each range
of ranks maps to a pattern, so placing is a join with the plan's few thousand
rows and no task gathers a length.

Defined cases: null or empty text is one piece that holds the end id alone; a
very long text is cut into as many pieces as it takes; pieces of equal length
are told apart by doc_id and piece, and it does not matter which goes where;
repeated rows are packed as often as they stand; other columns than doc_id and
text are not read; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from .tables import buckets_for, rank_within, small_table

LIMIT = 1024
END_ID = 2
SALTS = 64
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: the same vocabulary as ranks, and the string that only the json file gives an id
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SPECIAL = "<|endoftext|>"
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


class Encoder:
    """Ids of a text as ``tokenizers`` gives them for the json file.

    Both files hold one vocabulary and one splitting rule. Ordinary text goes
    through the ranks, which are several times faster; texts with the special
    string, and any that the fast path refuses, go through the json file.
    """

    def __init__(self, vocabulary: str = VOCABULARY, ranks: str | None = RANKS):
        self.vocabulary, self.slow, self.fast = vocabulary, None, None
        if ranks:
            import tiktoken

            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if self.fast is not None and SPECIAL not in text:
            try:
                return self.fast.encode_ordinary(text)
            except ValueError:  # its splitter gives up on runs of a million blanks
                pass
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.vocabulary)
        return self.slow.encode(text, add_special_tokens=False).ids


def cut(ids: np.ndarray, limit: int) -> Iterator[tuple[int, np.ndarray]]:
    """(start, ids) of a document's pieces; if it is longer than ``limit``, the first may be shorter."""
    first = len(ids) if len(ids) <= limit else len(ids) % limit or limit
    yield 0, ids[:first]
    for at in range(first, len(ids), limit):
        yield at, ids[at : at + limit]


def pieces(docs: DataFrame, limit: int = LIMIT, end_id: int = END_ID, vocabulary: str = VOCABULARY, ranks: str | None = RANKS) -> DataFrame:
    def run(batches):
        encode = Encoder(vocabulary, ranks)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encode(text.as_py() or ""), end_id], "<u4")
                out += [(doc_id, k, at, len(p), zlib.crc32(p.tobytes())) for k, (at, p) in enumerate(cut(ids, limit))]
            columns = zip(*out, strict=True) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PIECES, strict=True)], schema=_PIECES)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Complements:
    """An index from length sums to the available singles, pairs and triples that make them up."""

    def __init__(self, counts: list[int]):
        self.left = counts
        self.lengths = [n for n, c in enumerate(counts) if c]
        self.pairs: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for i, a in enumerate(self.lengths):
            for b in self.lengths[i:]:
                if a + b >= len(counts):
                    break
                self.pairs[a + b].append((a, b))
        for found in self.pairs.values():
            found.reverse()  # the most uneven pair is tried first: large pieces are the hard ones

    def has(self, *parts: int) -> bool:
        return all(self.left[p] >= parts.count(p) for p in parts)

    def pair(self, total: int, rest: tuple[int, ...]) -> tuple[int, int] | None:
        found = self.pairs.get(total, [])
        while found and not self.has(*found[-1]):
            found.pop()  # counts only fall, so it never comes back
        for parts in reversed(found):
            if self.has(*parts, *rest):
                return parts
        return None

    def filling(self, gap: int, rest: tuple[int, ...], most: int) -> tuple[int, ...] | None:
        """Up to ``most`` (three) available lengths that sum to ``gap`` beside ``rest``."""
        if gap < len(self.left) and self.has(gap, *rest):
            return (gap,)
        if most > 1 and (parts := self.pair(gap, rest)):
            return parts
        for a in reversed(self.lengths) if most > 2 else ():
            if a < gap - 1 and self.has(a, *rest) and (parts := self.pair(gap - a, (a, *rest))):
                return (a, *parts)
        return None


def plan(counts: dict[int, int], limit: int = LIMIT) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence's pieces, number of such sequences).

    Combinations of three use up small pieces that best fit might need more, so
    plans with combinations of up to one, two and three are made; the one with
    the fewest sequences counts.
    """
    plans = [complemented(counts, limit, most) for most in (3, 2, 1)]
    return min(plans, key=lambda p: sum(n for _, n in p))


def complemented(counts: dict[int, int], limit: int, most: int) -> list[tuple[tuple[int, ...], int]]:
    """Exact fills from the longest piece down, best fit for what is left."""
    left = [counts.get(n, 0) for n in range(limit + 1)]
    out = [((limit,), left[limit])] if left[limit] else []
    left[limit] = 0
    index, stuck = Complements(left), defaultdict(int)
    for longest in range(limit - 1, 0, -1):
        while left[longest]:
            parts = index.filling(limit - longest, (longest,), most)
            if parts is None:
                stuck[longest], left[longest] = left[longest], 0
                break
            pattern = (longest, *parts)
            times = min(left[p] // pattern.count(p) for p in pattern)
            for p in pattern:
                left[p] -= times
            out.append((pattern, times))
    return out + best_fit(stuck, limit)


def best_fit(counts: dict[int, int], limit: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, on groups of equal sequences."""
    open_: dict[tuple[int, tuple[int, ...]], int] = defaultdict(int)  # (room, pattern) -> sequences
    order: list[tuple[int, tuple[int, ...]]] = []

    def put(room: int, pattern: tuple[int, ...], n: int) -> None:
        if n and not open_[room, pattern]:
            insort(order, (room, pattern))
        open_[room, pattern] += n

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            at = bisect_left(order, (length, ()))
            room, pattern, there = (*order[at], open_[order[at]]) if at < len(order) else (limit, (), n)
            fit = min(room // length, n)
            used = min(there, n // fit)
            if pattern:
                open_[room, pattern] -= used
                if not open_[room, pattern]:
                    order.remove((room, pattern))
            put(room - fit * length, pattern + (length,) * fit, used)
            n -= used * fit
    return [(pattern, n) for (_, pattern), n in open_.items() if n]


def plan_rows(patterns: list[tuple[tuple[int, ...], int]]) -> list[dict]:
    """Ranges of ranks of each length, and where in which sequences they go."""
    out, taken, sequence = [], defaultdict(int), 0
    for pattern, times in patterns:
        at = 0
        for length in dict.fromkeys(pattern):
            k = pattern.count(length)
            lo = taken[length]
            taken[length] += k * times
            out.append({"length": length, "lo": lo, "hi": lo + k * times, "per": k, "sequence0": sequence, "offset0": at})
            at += k * length
        sequence += times
    return out


def pack(found: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Materialized pieces (with length) with sequence_id and offset."""
    counts = {r.length: r.n for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows = small_table(found.sparkSession, plan_rows(plan(counts, limit)), "length bigint, lo bigint, hi bigint, per int, sequence0 bigint, offset0 bigint")
    ranked = rank_within(found, "length", [F.col("doc_id"), F.col("piece")], buckets_for(max(counts.values(), default=0), SALTS), ["doc_id", "piece", "ids_crc32"])
    return (
        ranked.join(F.broadcast(rows), "length")
        .where("rank >= lo and rank < hi")
        .withColumn("_at", F.col("rank") - F.col("lo"))
        .withColumn("sequence_id", F.col("sequence0") + F.floor(F.col("_at") / F.col("per")))
        .withColumn("offset", F.col("offset0") + F.col("length") * (F.col("_at") % F.col("per")))
        .drop("rank", "lo", "hi", "per", "sequence0", "offset0", "_at")
    )


def op1(spark: SparkSession, docs: DataFrame) -> DataFrame:
    out = pack(materialize(pieces(docs), "pieces"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("sequence_id").cast("long"), F.col("offset").cast("long"))
