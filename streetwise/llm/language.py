"""Operator 7: hierarchical language identification.

The family of a text is predicted first; one-versus-one linear support vector
machines then separate the languages of that family. Features are hashed byte
trigrams of the whole text, as shares of all its trigrams, so a text is scored
by one gather and one sum for each machine, whatever its length.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, in_small_batches, table
from .textarrays import chunks, trimmed, utf8

#: Families of languages by ISO 639 code. A code that is not here
#: is a family of its own.
FAMILIES = {
    "germanic": "en de nl af sv da no nb nn is fy lb",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg mk sr hr sl",
    "uralic": "fi et hu",
    "indic": "hi ur bn mr gu pa ne",
    "semitic": "ar he",
}
#: At most so many different labelled texts of a language are used to fit; prediction
#: has no such bound.
FIT_TEXTS = 300
FEATURES = 1 << 13
_SCALE = 30.0
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
UNKNOWN = "und"


def family(lang: str) -> str:
    return next((f for f, codes in FAMILIES.items() if lang in codes.split()), lang)


def trigrams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature and text number of each trigram around a letter byte."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    padded = np.full(int(size.sum()) + n + 2, 32, dtype=np.uint8)
    padded[np.arange(int(size.sum())) + np.repeat(np.arange(n), size) + 1] = _FOLD[raw[offsets[0] : offsets[-1]]]
    middle = np.flatnonzero(padded != 32)
    wide = padded.astype(np.uint32)
    code = wide[middle - 1] * np.uint32(0x9E3779B1) + wide[middle] * np.uint32(0x85EBCA77) + wide[middle + 1] * np.uint32(0xC2B2AE3D)
    code ^= code >> np.uint32(15)
    code *= np.uint32(0x2C1B3C6D)
    ends = offsets[1:] - offsets[0] + np.arange(1, n + 1) + 1
    return (code >> np.uint32(19)).astype(np.int32), np.searchsorted(ends, middle, "right")


def fit_svm(x: np.ndarray, y: np.ndarray, rounds: int = 80, penalty: float = 1e-3) -> tuple[np.ndarray, float]:
    """Squared-hinge linear machine by accelerated gradient steps; y is 1 or -1."""
    n = len(y)
    step = 1.0 / (2 * (float((x * x).sum(axis=1).max()) + 1) + penalty)
    w = v = np.zeros(x.shape[1] + 1, dtype=np.float32)
    y = y.astype(np.float32)
    weight = np.where(y > 0, n / (2 * max((y > 0).sum(), 1)), n / (2 * max((y < 0).sum(), 1))) / n
    weight = weight.astype(np.float32)
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ v[:-1] + v[-1])) * weight * y
        grad = np.append(-2 * (slack @ x) + np.float32(penalty) * v[:-1], -2 * slack.sum())
        new = v - np.float32(step) * grad
        v, w = new + np.float32(k / (k + 3)) * (new - w), new
    return w[:-1].astype(np.float32), float(w[-1])


@dataclass
class Model:
    langs: list[str]
    families: list[str]
    machines: list[tuple[str, str, np.ndarray, float]]  # (a, b, weights, bias): above 0 is a

    def _winners(self, names: list[str], margin: dict, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The name with most wins in each row (then the largest sum of margins) and its least margin."""
        if len(names) == 1:
            return np.zeros(len(rows), int), np.full(len(rows), np.inf)
        won, total, worst = np.zeros((3, len(names), len(rows)))
        worst += np.inf
        for (i, a), (j, b) in combinations(enumerate(names), 2):
            m = margin[a, b][rows]
            won[i] += m > 0
            won[j] += m <= 0
            total[i] += m
            total[j] -= m
            worst[i] = np.minimum(worst[i], m)
            worst[j] = np.minimum(worst[j], -m)
        best = np.argmax(won + 1e-3 * np.tanh(total), axis=0)
        return best, worst[best, np.arange(len(rows))]

    def predict(self, text: pa.Array) -> tuple[list[str], np.ndarray]:
        raw, offsets = utf8(text)
        n = len(offsets) - 1
        lang, score = np.full(n, UNKNOWN, dtype=object), np.zeros(n)
        for first, last in chunks(offsets):
            at = offsets[first : last + 1]
            code, of = trigrams(raw, at)
            count = np.bincount(of, minlength=last - first)
            margin = {(a, b): np.bincount(of, weights=w[code], minlength=last - first) / np.maximum(count, 1) * _SCALE + bias for a, b, w, bias in self.machines}
            data = raw[at[0] : at[-1]]
            ascii_letter = np.concatenate(([0], np.cumsum(((data | 32) >= 97) & ((data | 32) <= 122) & (data < 128))))
            has = ascii_letter[at[1:] - at[0]] > ascii_letter[at[:-1] - at[0]]
            for i in np.flatnonzero(~has & (count > 0)):
                has[i] = any(c.isalpha() for c in bytes(raw[at[i] : at[i + 1]]).decode("utf-8", "replace"))
            if not self.langs:
                continue
            rows = np.flatnonzero(has)
            fam, sure = self._winners(self.families, margin, rows)
            for k, f in enumerate(self.families):
                mine = rows[fam == k]
                names = [x for x in self.langs if family(x) == f]
                best, worst = self._winners(names, margin, mine)
                lang[first + mine] = np.array(names, dtype=object)[best]
                score[first + mine] = 1 / (1 + np.exp(-2 * np.clip(np.minimum(sure[fam == k], worst), -30, 30)))
        return lang.tolist(), score


def _counts(text: pa.Array) -> pa.Array:
    """Each text's trigrams as pairs of feature and count, 32 bits each."""
    raw, offsets = utf8(text)
    out: list[bytes] = []
    for a, b in chunks(offsets):
        code, of = trigrams(raw, offsets[a : b + 1])
        key, count = np.unique(of.astype(np.int64) * FEATURES + code, return_counts=True)
        ends = np.searchsorted(key, np.arange(b - a + 1) * FEATURES)
        out += [np.stack([key[i:j] % FEATURES, count[i:j]]).astype("<i4").tobytes() for i, j in zip(ends, ends[1:], strict=False)]
    return pa.array(out, pa.binary())


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fits on at most FIT_TEXTS different texts of a language, whole and of any length:
    those of the lowest hashes, so the sample spreads over the whole table, copies count
    once, and ties (equal texts) don't matter. Rows with a null text or language, and
    empty texts, teach nothing; no rows at all give a model without languages. The
    driver gets trigram counts, at most FEATURES a text."""
    in_small_batches(labelled.sparkSession)
    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text <> ''").withColumn("h", F.xxhash64("text"))
    distinct = cut(rows.select("lang", "h").distinct())
    many = {r["lang"]: r["n"] for r in distinct.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    # A bound for hashes that about twice the texts needed are below, so few rows are sorted.
    low = F.lit(False)
    for lang, n in many.items():
        low = low | ((F.col("lang") == lang) & (F.col("h") <= min(2**63 - 1, -(2**63) + 2**64 * (2 * FIT_TEXTS + 64) // n)))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    chosen = cut(distinct.where(low).withColumn("r", first).where(f"r <= {FIT_TEXTS}").select("lang", "h"))
    one = rows.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))  # FIT_TEXTS rows a language
    sample = sorted((r["lang"], bytes(r["c"])) for r in one.select("lang", F.arrow_udf(_counts, "binary")("text").alias("c")).collect())
    if not sample:
        return Model([], [], [])
    x = np.zeros((len(sample), FEATURES), dtype=np.float32)
    for i, (_, c) in enumerate(sample):
        code, count = np.frombuffer(c, "<i4").reshape(2, -1)
        x[i, code] = count
    x *= _SCALE / np.maximum(x.sum(axis=1, keepdims=True), 1)
    lang_of = np.array([lang for lang, _ in sample])
    langs = sorted(set(lang_of.tolist()))
    families = sorted({family(lang) for lang in langs})
    family_of = np.array([family(lang) for lang in lang_of])
    machines = []
    for names, of in [(families, family_of), *(([x for x in langs if family(x) == f], lang_of) for f in families)]:
        for a, b in combinations(names, 2):
            mine = (of == a) | (of == b)
            machines.append((a, b, *fit_svm(x[mine], np.where(of[mine] == a, 1.0, -1.0))))
    return Model(langs, families, machines)


def predicted(model: Model, text_col: str = "text") -> Column:
    """Struct lang_pred, score (0 to 1) of a whole text. Null texts and texts without a
    letter get ``und`` and 0, as do all texts if nothing was learned."""

    def predict(text: pa.Array) -> pa.Array:
        lang, score = model.predict(text)
        trimmed()
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["lang_pred", "score"])

    return F.arrow_udf(predict, "struct<lang_pred:string,score:double>")(text_col)


def learnable(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows that may be learned from: crc32 of the id's text, modulo 3, is not 1."""
    return docs.where(F.crc32(F.col(id_col).cast("string")) % 3 != 1)


def op7_hierarchical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row; a null doc_id is not held out
    and not learned from."""
    docs = table(spark, sf_dir, "documents")
    out = docs.select("doc_id", predicted(fit(learnable(docs))).alias("found"))
    return out.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out"), "found.lang_pred", "found.score")
