"""Language identification by interpolated Kneser-Ney character models.

A text is lower-cased, everything but letters becomes one blank, and characters
get 12-bit codes, so an n-gram of ``ORDER`` characters is one exact 64-bit
number; letters beyond the 4,092 most frequent of the training rows share a code. For every order the n-grams of all languages stand in one sorted array
beside their log-probabilities under each language; a text is scored by binary
search for all its characters at once, falling back to lower orders where an
n-gram is new. The language with the least cross-entropy per character wins.

The score is the winner's share after a softmax over negative cross-entropies,
with a temperature fitted on labelled rows that the models were not built from;
``rejected`` says that the winner's cross-entropy, or its lead over the runner-up,
is worse than in all but half of ``REJECT_SHARE`` of those rows each.

Models are fitted on at most about ``ROWS_PER_LANG`` labelled rows per language
(chosen by a hash of the row's content), which bounds training, the model and
what the driver holds (their counts and entropies); every text, however long, is
scored whole.

Defined cases: null text, or one without letters (of any plane), is ``und`` with
score 0; a text of letters that no training row had gets the likeliest language
all the same; repeated rows are scored alike; ties go to the first language by
name; other columns than text, lang and doc_id are not read; without a labelled row every text is ``und``;
an empty table gives no rows.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ORDER = 4
BITS = 12
MASK = np.uint64((1 << BITS) - 1)
ROWS_PER_LANG = 1500
CALIBRATION_SHARE = 5  # one labelled sample row in so many is kept from training
REJECT_SHARE = 0.005
DISCOUNT_DEFAULT = 0.75
UNKNOWN, BLANK = 1, 2
CHUNK_CHARS = 1 << 20
NONE = "und"


@cache
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def code_points(text: str) -> np.ndarray:
    """Lower-cased letters, with single blanks between runs and at both ends; empty without letters."""
    raw = np.frombuffer(unicodedata.normalize("NFC", text).lower().encode("utf-32-le", "replace"), "<u4")
    table = letters()
    letter = table[np.minimum(raw, len(table) - 1)]
    if not letter.any():
        return np.zeros(0, np.uint32)
    out = np.where(letter, raw, 32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    return np.concatenate([[32], out[keep], [32]] if letter[-1] else [[32], out[keep]]).astype(np.uint32)


def encode(points: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
    """Codes from 3 in alphabet order; unknown letters share one."""
    at = np.minimum(np.searchsorted(alphabet, points), max(len(alphabet) - 1, 0))
    known = alphabet[at] == points if len(alphabet) else np.zeros(len(points), bool)
    return np.where(points == 32, BLANK, np.where(known, at + 3, UNKNOWN)).astype(np.uint64)


def grams(codes: np.ndarray, order: int) -> np.ndarray:
    """The n-gram that ends at each character from the second on, shorter contexts padded with 0."""
    out = codes[1:].copy()
    for j in range(1, order):
        lag = np.zeros(len(out), np.uint64)
        lag[max(j - 1, 0) :] = codes[: len(codes) - j] if j <= len(codes) - 1 else 0
        out |= lag << np.uint64(BITS * j)
    return out


def lookup(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    return at, (keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool))


@dataclass
class Level:
    """n-grams of one order: log-probabilities of the last character, and back-off weights of contexts."""

    keys: np.ndarray
    logp: np.ndarray
    contexts: np.ndarray
    backoff: np.ndarray


@dataclass
class Model:
    langs: list[str]
    alphabet: np.ndarray
    levels: list[Level] = field(default_factory=list)  # from order 1 up
    temperature: float = 1.0
    most_entropy: float = np.inf
    least_lead: float = 0.0

    def log_probs(self, wanted: np.ndarray, order: int) -> np.ndarray:
        """One row per n-gram, one column per language."""
        level = self.levels[order - 1]
        at, found = lookup(level.keys, wanted)
        out = level.logp[at]
        if order > 1 and not found.all():
            miss = np.nonzero(~found)[0]
            lower = self.log_probs(wanted[miss] & np.uint64((1 << (BITS * (order - 1))) - 1), order - 1)
            c, known = lookup(level.contexts, wanted[miss] >> np.uint64(BITS))
            out[miss] = lower + np.where(known[:, None], level.backoff[c], 0)
        return out

    def entropies(self, text: str) -> np.ndarray | None:
        """Cross-entropy per character under each language; None without letters."""
        points = code_points(text)
        if not len(points):
            return None
        codes = encode(points, self.alphabet)
        total = np.zeros(len(self.langs))
        for at in range(0, len(codes) - 1, CHUNK_CHARS):
            part = codes[max(0, at - len(self.levels) + 1) : at + CHUNK_CHARS + 1]
            found = grams(part, len(self.levels))[-min(CHUNK_CHARS, len(codes) - 1 - at) :]
            total += self.log_probs(found, len(self.levels)).sum(0, dtype=np.float64)
        return -total / (len(codes) - 1)

    def judge(self, entropy: np.ndarray) -> tuple[str, float, bool]:
        """(language, score, rejected)."""
        best = int(entropy.argmin())
        share = np.exp((entropy[best] - entropy) / self.temperature)
        rest = np.delete(entropy, best)
        lead = float(rest.min() - entropy[best]) if len(rest) else np.inf
        return self.langs[best], float(1 / share.sum()), bool(entropy[best] > self.most_entropy or lead < self.least_lead)


def kneser_ney(counts: list[pd.Series], alphabet: np.ndarray, langs: list[str], order: int = ORDER) -> Model:
    """Models from each language's counts of n-grams of the highest order."""
    model = Model(langs, alphabet)
    size = len(alphabet) + 2
    levels = []
    for series in counts:
        own = [(series.index.to_numpy(np.uint64), series.to_numpy(np.float64))]
        for n in range(order - 1, 0, -1):  # continuation counts: how many different n-grams end so
            suffix, kinds = np.unique(own[-1][0] & np.uint64((1 << (BITS * n)) - 1), return_counts=True)
            own.append((suffix, kinds.astype(np.float64)))
        levels.append(own[::-1])
    for n in range(order):
        keys = np.unique(np.concatenate([x[n][0] for x in levels])) if levels else np.zeros(0, np.uint64)
        contexts = np.unique(keys >> np.uint64(BITS))
        logp, backoff = np.zeros((len(keys), len(langs)), np.float32), np.zeros((len(contexts), len(langs)), np.float32)
        for j, own in enumerate(levels):
            gram, count = own[n]
            ones, twos = (count == 1).sum(), (count == 2).sum()
            discount = ones / (ones + 2 * twos) if ones and twos else DISCOUNT_DEFAULT
            place = lookup(contexts, gram >> np.uint64(BITS))[0]
            total = np.bincount(place, count, len(contexts))
            kinds = np.bincount(place, minlength=len(contexts))
            weight = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
            mass = np.zeros(len(keys))
            at = lookup(keys, gram)[0]
            mass[at] = np.maximum(count - discount, 0) / total[place]
            context = lookup(contexts, keys >> np.uint64(BITS))[0]
            if n:
                lower = np.exp(model.log_probs(keys & np.uint64((1 << (BITS * n)) - 1), n)[:, j].astype(np.float64))
            else:
                lower = np.full(len(keys), 1 / size)
            logp[:, j] = np.log(mass + weight[context] * lower)
            backoff[:, j] = np.log(weight)
        if n == 0 and len(keys):  # characters that were never seen
            loose = np.log(np.exp(backoff[0]) / size)
            keys, logp = np.concatenate([keys, [MASK]]), np.concatenate([logp, loose[None]])
            missing = np.setdiff1d(np.arange(1, size + 3, dtype=np.uint64), keys)
            keys, logp = np.concatenate([keys, missing]), np.concatenate([logp, np.repeat(loose[None], len(missing), 0)])
            sort = np.argsort(keys, kind="stable")
            keys, logp = keys[sort], logp[sort].astype(np.float32)
        model.levels.append(Level(keys, logp, contexts, backoff))
    return model


def calibrate(model: Model, rows: list[tuple[list[float], str]]) -> None:
    """Fit temperature and rejection limits on (entropies, lang) of texts that training did not see."""
    pairs = [(e, model.langs.index(lang)) for e, lang in rows if lang in model.langs]
    if not pairs or len(model.langs) < 2:
        return
    e, right = np.array([x for x, _ in pairs]), np.array([y for _, y in pairs])
    choices = np.geomspace(0.05, 2, 40)
    loss = [(e[np.arange(len(e)), right] / t + np.log(np.exp(-(e - e.min(1, keepdims=True)) / t).sum(1)) - e.min(1) / t).mean() for t in choices]
    model.temperature = float(choices[int(np.argmin(loss))])
    hit = e.argmin(1) == right
    if hit.any():
        low = np.sort(e[hit], 1)
        model.most_entropy = float(np.quantile(low[:, 0], 1 - REJECT_SHARE / 2))
        model.least_lead = float(np.quantile(low[:, 1] - low[:, 0], REJECT_SHARE / 2))


def entropies_of(rows: DataFrame, model: Model) -> list[tuple[list[float], str]]:
    """(entropies, lang) of the sample's calibration rows: whole texts are scored in tasks, a number per language comes back."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            found = [(lang.as_py(), e.tolist()) for lang, text in zip(batch.column(0), batch.column(1), strict=True) if (e := shared.value.entropies(text.as_py())) is not None]
            lang, e = zip(*found, strict=True) if found else ([], [])
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(e, pa.list_(pa.float64()))], ["lang", "e"])

    scored = rows.select("lang", "text").mapInArrow(run, "lang string, e array<double>")
    return sorted((list(r.e), r.lang) for r in scored.collect())


def held_out(doc_id: Column | str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(labelled: DataFrame, limit: int = ROWS_PER_LANG) -> DataFrame:
    """About ``limit`` rows per language by a hash of their text, with lang, text and calibration flag."""
    n = F.broadcast(labelled.groupBy("lang").agg(F.count("*").alias("n")))  # one row per language
    draw = F.pmod(F.xxhash64(F.lit(3), "text"), F.lit(1 << 30))
    drawn = labelled.join(n, "lang").where(draw / float(1 << 30) < F.lit(float(limit)) / F.col("n"))
    return drawn.select("lang", "text", (F.pmod(F.xxhash64(F.lit(4), "text"), F.lit(CALIBRATION_SHARE)) == 0).alias("calibration"))


def fit(labelled: DataFrame, order: int = ORDER, limit: int = ROWS_PER_LANG) -> Model | None:
    """Models from (lang, text): n-grams are counted in tasks, the bounded sample's counts go to the driver."""
    spark = labelled.sparkSession
    rows = training_rows(labelled.where("lang is not null and text is not null").select("lang", "text"), limit)
    train, test = rows.where("not calibration"), rows.where("calibration")

    def points(batches):
        for batch in batches:
            count: dict[int, int] = {}
            for text in batch.column(0):
                values, n = np.unique(code_points(text.as_py()), return_counts=True)
                for v, k in zip(values.tolist(), n.tolist(), strict=True):
                    count[v] = count.get(v, 0) + k
            yield pa.RecordBatch.from_pydict({"c": pa.array(list(count), pa.int64()), "n": pa.array(list(count.values()), pa.int64())})

    seen = train.select("text").mapInArrow(points, "c long, n long").groupBy("c").agg(F.sum("n").alias("n")).where("c <> 32")
    common = seen.orderBy(F.desc("n"), "c").limit((1 << BITS) - 4).select("c").collect()
    alphabet = np.sort(np.array([r.c for r in common], np.uint32))

    def count(batches):
        for batch in batches:
            for lang in batch.column(0).unique().to_pylist():
                texts = batch.filter(pc.equal(batch.column(0), lang)).column(1)
                found = [grams(encode(p, alphabet), order) for t in texts if len(p := code_points(t.as_py()))]
                if not found:
                    continue
                keys, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    total = train.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    if total.empty:
        return None
    langs = sorted(total["lang"].unique())
    series = [total[total["lang"] == lang].set_index("gram")["n"].sort_index() for lang in langs]
    model = kneser_ney(series, alphabet, langs, order)
    calibrate(model, entropies_of(test, model))
    return model


def predict(docs: DataFrame, model: Model | None, *keep: str) -> DataFrame:
    """``keep`` with lang_pred, score, rejected and entropy of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample
    kept = docs.select(*keep, F.col("text").cast("string").alias("text"))

    def run(batches):
        found = shared.value
        for batch in batches:
            out = []
            for text in batch.column(batch.num_columns - 1):
                e = found.entropies(text.as_py()) if found is not None and text.is_valid else None
                out.append((NONE, 0.0, True, None) if e is None else (*found.judge(e), float(e.min())))
            lang, score, rejected, entropy = zip(*out, strict=True) if out else ([], [], [], [])
            arrays = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_()), pa.array(entropy, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], names=[*keep, "lang_pred", "score", "rejected", "entropy"])

    types = dict(kept.dtypes)
    return kept.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in keep) + ", lang_pred string, score double, rejected boolean, entropy double")


def op3(spark: SparkSession, docs: DataFrame) -> DataFrame:
    model = fit(docs.where(~held_out()).select("lang", "text"))
    flagged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return predict(flagged, model, "doc_id", "held_out").select("doc_id", "held_out", "lang_pred", "score", "rejected")
