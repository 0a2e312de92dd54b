"""Operator 6: mixing documents to target weights by soft membership.

A classifier fitted on a labelled table gives each document a posterior over
domains. Rates r >= 0 then minimise

    1/2 sum_d (A r - t)_d^2 / s_d  +  REG/2 sum_i (w_i / T) (r_i - 1)^2

where A r are the expected token shares of the domains, t the targets, s the
shares as they are, w_i a document's tokens and T all tokens. Projected gradient
steps run over all documents at once: a step needs one aggregate of one number
a domain, and the rates stay a column. A document that more likely than not is of
domains whose target is 0 has the rate 0: the ridge REG, which draws rates to 1,
doesn't hold for it.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, in_small_batches, small, table
from .language import _FOLD
from .textarrays import chunks, trimmed, utf8, word_hashes

#: At most so many labelled documents of a domain are used to fit; prediction has no
#: such bound.
FIT_TEXTS = 1500
BUCKETS, CHOSEN = 1 << 18, 2048
REG, STEPS, CLOSE = 0.05, 120, 1e-4
log = logging.getLogger(__name__)
_U = np.uint64
_BLANK = _FOLD == 32

#: Domains of the label table and their target tokens, as shares of all tokens now.
DOMAINS = ["clean", "low", "toxic"]
TARGETS = {"clean": 1.0, "low": 0.15, "toxic": 0.0}


def domain_of_labels() -> Column:
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "clean").when(F.col("quality") == 0, "low")


def _style(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Shares of capitals, symbols, digits and bars, length of lines and words, by text."""
    data = raw[at[0] : at[-1]]
    n = np.maximum(np.diff(at), 1)

    def share(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask)))
        return (total[at[1:] - at[0]] - total[at[:-1] - at[0]]) / n

    upper = share((data >= 65) & (data <= 90))
    symbol = share((data < 128) & (data > 32) & _BLANK[data] & ~np.isin(data, np.frombuffer(b".,0123456789", np.uint8)))
    digit = share((data >= 48) & (data <= 57))
    return np.stack([np.minimum(upper, 0.5) * 4, np.minimum(symbol, 0.3) * 8, np.minimum(digit, 0.2) * 8, np.minimum(share(data == 124) * 20, 2), share(data == 10) * 20, share(data == 32) * 4, np.log1p(n) / 10], axis=1)


def features(column: pa.Array):
    """For runs of texts: style matrix, bucket and text number of each different word
    (letters only, A-Z lower-cased), count of words by text."""
    raw, offsets = utf8(column)
    for first, last in chunks(offsets):
        at = offsets[first : last + 1]
        hashes, bounds = word_hashes(raw, at, _FOLD, _BLANK)
        n = np.diff(bounds)
        pair = np.unique((np.repeat(np.arange(last - first), n).astype(np.int64) << 18) | (hashes & _U(BUCKETS - 1)).astype(np.int64))
        yield _style(raw, at), pair & (BUCKETS - 1), pair >> 18, n


@dataclass
class Classifier:
    domains: list[str]
    column: np.ndarray  # bucket to column of the chosen, else CHOSEN
    weights: np.ndarray  # (style + CHOSEN + 1 unused, domains)
    bias: np.ndarray

    def posteriors(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        out, tokens = [np.zeros((0, len(self.domains)))], [np.zeros(0, np.int64)]
        for style, bucket, of, n in features(text):
            score = style @ self.weights[: style.shape[1]] + self.bias
            rows = self.weights[style.shape[1] + self.column[bucket]]
            for d in range(len(self.domains)):
                score[:, d] += np.bincount(of, weights=rows[:, d], minlength=len(style))
            score = np.exp(score - score.max(axis=1, keepdims=True))
            out.append(score / score.sum(axis=1, keepdims=True))
            tokens.append(n)
        return np.concatenate(out), np.concatenate(tokens)


_FEATURES = "struct<style:binary,buckets:binary>"


def _sparse(text: pa.Array) -> pa.Array:
    """Style and different word buckets of each text, as bytes."""
    styles, buckets = [], []
    for style, bucket, of, _ in features(text):
        ends = np.searchsorted(of, np.arange(len(style) + 1))
        styles += [x.astype("<f8").tobytes() for x in style]
        buckets += [bucket[i:j].astype("<i4").tobytes() for i, j in zip(ends, ends[1:], strict=False)]
    return pa.StructArray.from_arrays([pa.array(styles, pa.binary()), pa.array(buckets, pa.binary())], names=["style", "buckets"])


def fit(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Classifier:
    """``labelled`` has columns id and domain; rows with a null in either, or whose
    document has no text, teach nothing. An id with several labels has the first domain
    by name; one with several texts the text of the lowest hash. Fits a multinomial
    logistic regression on at most FIT_TEXTS documents a domain, whole and of any length:
    those of the lowest hashes of the id. The domains' shares among the labels are the
    prior. With fewer than two domains there is no evidence and every posterior is the
    prior. The driver gets features, not texts."""
    in_small_batches(docs.sparkSession)
    labelled = cut(labelled.where("id is not null and domain is not null").groupBy("id").agg(F.min("domain").alias("domain")))
    many = {r["domain"]: r["n"] for r in labelled.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    domains = [d for d in DOMAINS if d in many] + sorted(set(many) - set(DOMAINS)) or DOMAINS[:1]
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text <> ''")
    there = texts.select("id").join(small(labelled), "id").distinct()
    first = F.row_number().over(Window.partitionBy("domain").orderBy(F.xxhash64("id"), "id"))
    chosen = cut(there.withColumn("r", first).where(f"r <= {FIT_TEXTS}").select("id", "domain"))
    one = texts.join(F.broadcast(chosen), "id").groupBy("id", "domain").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    sample = one.select("id", "domain", F.arrow_udf(_sparse, _FEATURES)("text").alias("x"))
    rows = sorted(((r["id"], r["domain"], r["x"]) for r in sample.collect()), key=lambda r: r[:2])
    y = np.array([domains.index(r[1]) for r in rows], dtype=int)
    styles = [np.frombuffer(r[2]["style"], "<f8") for r in rows]
    buckets = [np.frombuffer(r[2]["buckets"], "<i4") for r in rows]
    ofs = [np.full(len(x), i) for i, x in enumerate(buckets)]
    prior = np.log(np.array([many.get(d, 1) for d in domains]) / max(sum(many.values()), 1))
    width = len(styles[0]) if styles else 7
    column, weights = np.full(BUCKETS, CHOSEN, dtype=np.int32), np.zeros((width + CHOSEN + 1, len(domains)))
    if len(set(y)) < 2:
        return Classifier(domains, column, weights, prior)
    bucket, of, size = np.concatenate(buckets), np.concatenate(ofs), np.bincount(y, minlength=len(domains))
    seen = np.stack([np.bincount(bucket[y[of] == d], minlength=BUCKETS) for d in range(len(domains))], axis=1)
    p, all_p = (seen + 0.5) / (size + 1), (seen.sum(axis=1, keepdims=True) + 0.5) / (len(y) + 1)
    z = np.abs(p - all_p) / np.sqrt(all_p * (1 - all_p) / np.maximum(size, 1))
    z = np.where(seen.sum(axis=1) >= 5, z.max(axis=1), 0)
    chosen = np.argsort(-z, kind="stable")[:CHOSEN]
    column[chosen] = np.arange(CHOSEN)
    x = np.zeros((len(y), width + CHOSEN + 1), dtype=np.float32)
    x[:, :width] = np.stack(styles)
    x[of, width + column[bucket]] = 1
    x[:, -1] = 0
    target = np.eye(len(domains), dtype=np.float32)[y]
    balance = (1 / (len(domains) * np.maximum(size, 1)))[y][:, None].astype(np.float32)
    v, b, dv, db = weights.astype(np.float32), np.zeros(len(domains), np.float32), 0, 0
    step = np.float32(4.0 / float((balance * (x * x).sum(axis=1, keepdims=True)).sum()))
    for _ in range(400):
        score = x @ v + b
        q = np.exp(score - score.max(axis=1, keepdims=True))
        miss = (q / q.sum(axis=1, keepdims=True) - target) * balance
        dv = np.float32(0.95) * dv - step * (x.T @ miss + np.float32(1e-4) * v)
        db = np.float32(0.95) * db - step * miss.sum(axis=0)
        v, b = v + dv, b + db
    v[-1] = 0
    return Classifier(domains, column, v.astype(np.float64), b + prior - prior.mean())


def predicted(model: Classifier, text_col: str = "text") -> Column:
    """Struct p (one posterior a domain), tokens (words of letters). A null text is empty."""

    def predict(text: pa.Array) -> pa.Array:
        p, n = model.posteriors(text)
        trimmed()
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * p.shape[1], pa.int32()), pa.array(p.ravel(), pa.float64()))
        return pa.StructArray.from_arrays([flat, pa.array(n, pa.int64())], names=["p", "tokens"])

    return F.arrow_udf(predict, "struct<p:array<double>,tokens:bigint>")(text_col)


class Steps(list):
    """The steps' gradients, one number a domain each; ``zero`` are the places of domains
    whose target is 0, ``converged`` says whether the last step was too small to matter."""

    zero: list[int] = []
    converged = True


def barred(p: Column, zero: list[int]) -> Column:
    """Whether a document is of a zero-target domain more likely than not."""
    return sum((F.get(p, F.lit(d)) for d in zero), F.lit(0.0)) > 0.5


def stepped(rate: Column, p: Column, push: list[float]) -> Column:
    """A rate after one projected gradient step. ``rate`` stands once in it."""
    step = 1 / (1 + REG)
    pull = sum((F.get(p, F.lit(d)) * e for d, e in enumerate(push)), F.lit(0.0))
    return F.greatest(F.lit(0.0), rate * (1 - step * REG) + step * REG - step * pull)


def solve_rates(rows: DataFrame, domains: list[str], targets: dict[str, float]) -> tuple[DataFrame, Steps]:
    """Adds rate to rows with p and tokens; returns the steps as well. No tokens at all,
    or no rows, leave every rate at 1 (0 for barred documents)."""
    pushes = Steps()
    pushes.zero = [d for d, name in enumerate(domains) if targets.get(name, 0.0) == 0 and len(domains) > 1]
    free = (~barred(F.col("p"), pushes.zero)).cast("double")
    rows = rows.withColumn("rate", free)
    p = [F.get("p", F.lit(d)) for d in range(len(domains))]
    total = rows.agg(F.sum("tokens").alias("n"), *[F.sum(F.col("tokens") * x).alias(f"s{d}") for d, x in enumerate(p)]).first()
    if not total["n"]:
        return rows, pushes
    share = np.array([max(total[f"s{d}"] / total["n"], 1e-6) for d in range(len(domains))])
    goal = np.array([targets.get(d, 0.0) for d in domains])
    pushes.converged = False
    for k in range(STEPS):
        got = rows.agg(*[F.sum(F.col("tokens") * F.col("rate") * x).alias(f"g{d}") for d, x in enumerate(p)]).first()
        push = (np.array(list(got)) / total["n"] - goal) / share
        if pushes and np.abs(push - pushes[-1]).max() < CLOSE:
            pushes.converged = True
            break
        pushes.append(push.tolist())
        rows = rows.withColumn("rate", stepped(F.col("rate"), F.col("p"), pushes[-1]) * free)
        if k % 12 == 11:
            rows = cut(rows)
    if not pushes.converged:
        log.warning("rates still move after %d steps", STEPS)
    return rows, pushes


def copies(rate: Column, doc: Column, text_hash: Column) -> Column:
    """The rate rounded up or down by a hash of the document, with the rate as expectation."""
    return F.floor(rate + F.pmod(F.xxhash64(doc, text_hash, F.lit("copies")), F.lit(1 << 32)) / F.lit(float(1 << 32)))


def mix_rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] = TARGETS, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Classifier, Steps]:
    """Returns doc_id, text_hash, tokens, p, rate of each row of ``docs``, with the
    classifier and the steps, from which replayed() gets a rate without a join.

    A null or empty text has no tokens and the posterior of an empty text; a null id
    is a document like any other; repeated rows stay repeated, with equal rates. An
    empty table gives no rows and no steps. Other columns are ignored."""
    model = fit(docs, labelled, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), predicted(model, text_col).alias("m"))
    rows = cut(rows.select("doc_id", "text_hash", "m.tokens", "m.p"))
    rows, pushes = solve_rates(rows, model.domains, targets)
    return rows, model, pushes


def replayed(p: Column, pushes: Steps) -> Column:
    rate = F.lit(1.0)
    for push in pushes:
        rate = stepped(rate, p, push)
    return F.when(barred(p, pushes.zero), 0.0).otherwise(rate)


def labels_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), domain_of_labels().alias("domain"))


def op6_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, model, _ = mix_rates(table(spark, sf_dir, "documents"), labels_of(spark, sf_dir))
    each = [(F.get("p", F.lit(model.domains.index(d))) if d in model.domains else F.lit(0.0)).alias(f"p_{d}") for d in DOMAINS]
    return rows.select("doc_id", "tokens", *each, "rate", copies(F.col("rate"), F.col("doc_id"), F.col("text_hash")).alias("copies"))
