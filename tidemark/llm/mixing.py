"""Mixing documents to target domain weights by soft membership and nonnegative least squares."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_ids, content, fields, fresh_path

SAMPLE = 5_000  # labelled documents the classifier learns from
BUCKETS = 1 << 16  # hashed word features
RIDGE = 1e-3  # pull of the rates towards 1
STEPS = 60
TOLERANCE = 1e-4  # of the corpus: two steps that move no domain total further end the descent
_CAPS = re.compile(r"[A-Z]")
_SIGNS = re.compile(r"[^\w\s]")
_STYLE = 6


class _Buckets(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 250_000:  # forgets, never grows without bound
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word) % BUCKETS
        return out


_BUCKETS = _Buckets()


def sparse(text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
    """(buckets, values, tokens) of a text: log counts of its lower-cased words scaled to length 1, and style shares.

    Tokens are words of anything but ASCII white space.  An empty text has the bias feature only.
    """
    text = text or ""
    words = text.encode("utf-8", "replace").lower().split()
    n = len(words)
    if not n:
        return np.array([BUCKETS], np.int64), np.ones(1), 0
    counts = Counter(words)
    at = np.fromiter(map(_BUCKETS.__getitem__, counts), np.int64, len(counts))
    value = np.log1p(np.fromiter(counts.values(), np.float64, len(counts)))
    value /= np.sqrt((value * value).sum())
    chars = max(1, len(text))
    style = [
        1.0,
        len(counts) / n,
        len(_CAPS.findall(text)) / chars * 4,
        len(_SIGNS.findall(text)) / chars * 4,
        max(counts.values()) / n,
        min(n, 1000) / 1000,
    ]
    return np.append(at, np.arange(BUCKETS, BUCKETS + _STYLE)), np.append(value, style), n


@dataclass
class Classifier:
    """Multinomial logistic regression on hashed words."""

    domains: list[str]
    weights: np.ndarray  # (BUCKETS + _STYLE) x domains
    prior: np.ndarray

    def posterior(self, text: str | None) -> tuple[np.ndarray, int]:
        at, value, n = sparse(text)
        z = value @ self.weights[at] + self.prior
        z = np.exp(z - z.max())
        return z / z.sum(), n


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], domains: list[str], epochs: int = 120, rate: float = 0.2, ridge: float = 1e-4) -> Classifier:
    """Full-batch Adam on ``(buckets, values, class)``.  Without rows all domains are equally likely."""
    k = len(domains)
    w = np.zeros((BUCKETS + _STYLE, k), np.float32)
    if not rows:
        return Classifier(domains, w, np.zeros(k))
    y = np.array([c for _, _, c in rows])
    prior = np.log((np.bincount(y, minlength=k) + 1e-9) / (len(y) + k * 1e-9))
    ends = np.cumsum([len(a) for a, _, _ in rows])
    starts = np.append(0, ends[:-1])
    at, value = np.concatenate([a for a, _, _ in rows]), np.concatenate([v for _, v, _ in rows])
    owner = np.repeat(np.arange(len(rows)), ends - starts)
    used, local = np.unique(at, return_inverse=True)
    order = np.argsort(local, kind="stable")
    bounds = np.searchsorted(local[order], np.arange(len(used)))
    u = np.zeros((len(used), k), np.float32)
    first, second = np.zeros_like(u), np.zeros_like(u)
    gold = np.eye(k, dtype=np.float32)[y]
    for step in range(1, epochs + 1):
        z = np.add.reduceat(value[:, None] * u[local], starts) + prior.astype(np.float32)
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        error = (p - gold) / len(rows)
        g = np.add.reduceat((value[:, None] * error[owner])[order], bounds) + ridge * u
        first += 0.1 * (g - first)
        second += 0.01 * (g * g - second)
        u -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
    w[used] = u
    return Classifier(domains, w, prior)


def classifier(docs: DataFrame, labelled: DataFrame, domains: list[str], sample: int = SAMPLE) -> Classifier:
    """Learn from ``labelled(doc_id, domain)``: at most ``sample`` documents, the smallest by hash of doc_id.

    Rows of other or null domains are no labels.  A document with several labels counts for each.
    """
    named = labelled.where(F.col("domain").isin(domains)).select(F.col("doc_id").cast("long").alias("doc_id"), "domain").distinct()
    few = named.join(F.broadcast(bounded_ids(named, "doc_id", sample)), "doc_id", "left_semi")
    bare = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [sparse(t) for t in batch["text"]]
            at = [a.astype("<i4").tobytes() for a, _, _ in rows]
            yield pd.DataFrame({"domain": batch["domain"], "at": at, "value": [v.astype("<f4").tobytes() for _, v, _ in rows]}, dtype=object)

    # At most ``sample`` ids and as many labels each as there are domains: a bounded table.
    found = bare.join(F.broadcast(few), "doc_id").mapInPandas(run, fields(domain="string", at="binary", value="binary"))
    rows = sorted((bytes(r["at"]), bytes(r["value"]), domains.index(r["domain"])) for r in found.collect())
    return train([(np.frombuffer(a, "<i4"), np.frombuffer(v, "<f4"), k) for a, v, k in rows], domains)


def memberships(docs: DataFrame, model: Classifier) -> DataFrame:
    """``(doc_id, content, tokens, p)`` of each row: its words and the posterior of each domain."""
    weights = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: BUCKETS x domains floats

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [weights.value.posterior(t) for t in batch["text"]]
            yield batch[["doc_id", "content"]].assign(tokens=[n for _, n in rows], p=[p for p, _ in rows])

    text = docs["text"].cast("string").alias("text")
    bare = docs.select(docs["doc_id"].cast("long").alias("doc_id"), content(docs).alias("content"), text)
    return bare.mapInPandas(run, fields(doc_id="bigint", content="bigint", tokens="bigint", p="array<double>"))


@dataclass
class Rates:
    """The rate of a document as a function of its posterior: the recorded descent, replayed.

    A step of the descent changes every rate by the same few numbers (the weighted residuals of the
    domains), so those are all there is to keep; no rate is ever stored or gathered.
    """

    step: float
    ridge: float
    weight: np.ndarray
    residuals: list[np.ndarray] = field(default_factory=list)

    def __call__(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rates, extrapolated rates) of rows of posteriors after the recorded steps."""
        r = np.ones(len(p))
        y, t = r, 1.0
        for g in self.residuals:
            after = np.maximum(0.0, y - self.step * (p @ (self.weight * g) + self.ridge * (y - 1)))
            t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
            y = after + (t - 1) / t_next * (after - r)
            r, t = after, t_next
        return r, y


def _sums(members: DataFrame, of, width: int) -> np.ndarray:
    """Sums over all rows of ``of(tokens, p)``: a vector per batch, added up by Spark."""
    names = [f"s{i}" for i in range(width)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                p = np.stack(batch["p"].to_numpy())
                yield pd.DataFrame([of(batch["tokens"].to_numpy(np.float64), p)], columns=names)

    row = members.select("tokens", "p").mapInPandas(run, fields(**dict.fromkeys(names, "double"))).agg(*[F.sum(n).alias(n) for n in names]).first()
    return np.array([v or 0.0 for v in row])


def fit(members: DataFrame, shares: list[float], ridge: float = RIDGE, steps: int = STEPS) -> Rates:
    """Rates r >= 0 that bring the expected tokens of each domain to its share of the corpus.

    Minimises sum_k (sum_d n_d p_dk r_d / N - share_k)^2 / m_k + ridge * sum_d n_d (r_d - 1)^2 / N, where m_k is
    the mean square posterior of the domain (so that all domains are equally well conditioned), by accelerated
    projected gradient steps in the token-weighted metric, in which the gradient of a document depends on its
    posterior only.  Each step is one pass over ``members`` that adds up one number a domain.  An empty corpus
    keeps all rates at 1.
    """
    k = len(shares)
    target = np.array(shares) / sum(shares)
    moments = _sums(members, lambda n, p: np.append((p.T * n) @ p, n.sum()), k * k + 1)
    total = moments[-1]
    if not total:
        return Rates(1.0, ridge, np.ones(k))
    square = moments[:-1].reshape(k, k) / total
    weight = 1 / np.maximum(np.diag(square), 1e-3)
    root = np.sqrt(weight)
    steepest = np.linalg.eigvalsh(root[:, None] * square * root)[-1]
    rates = Rates(1 / (steepest + ridge), ridge, weight)
    moved = 1.0
    for _ in range(steps):
        now = Rates(rates.step, ridge, weight, list(rates.residuals))
        g = _sums(members, lambda n, p, now=now: (n * now(p)[1]) @ p, k) / total - target
        before, moved = moved, np.abs(g - rates.residuals[-1]).max() if rates.residuals else 1.0
        rates.residuals.append(g)
        if max(before, moved) < TOLERANCE:
            break
    return rates


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], ridge: float = RIDGE) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: tokens, a posterior ``p_<domain>`` each, rate and copies.

    ``targets`` maps a domain to its wanted share of the tokens; ``labelled(doc_id, domain)`` names the
    domain of some documents.  A document is to be taken ``rate`` times; ``copies`` rounds that up or down
    by a hash of the row, right on average.  Null and empty texts have no tokens and the rate of their
    posterior; repeated rows are treated alike; a null doc_id is kept; other columns are ignored.
    """
    domains = list(targets)
    members, rates = _fitted(docs, classifier(docs, labelled, domains), targets, ridge)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            p = np.stack(batch["p"].to_numpy()) if len(batch) else np.zeros((0, len(domains)))
            out = batch[["doc_id", "content", "tokens"]].copy()
            for i, _ in enumerate(domains):
                out[f"p{i}"] = p[:, i]
            yield out.assign(rate=rates(p)[0])

    kinds = {"doc_id": "bigint", "content": "bigint", "tokens": "bigint"} | {f"p{i}": "double" for i in range(len(domains))}
    done = members.mapInPandas(run, fields(**kinds, rate="double"))
    named = [F.col(f"p{i}").alias(f"p_{d}") for i, d in enumerate(domains)]
    return done.select("doc_id", "tokens", *named, "rate", _copies("doc_id", "content", "rate").alias("copies"))


def _copies(doc_id: str, text: str, rate: str):
    """The rate rounded by a number in [0, 1) that the row determines."""
    chance = F.shiftrightunsigned(F.xxhash64(doc_id, text), 11) * (2.0**-53)
    return (F.floor(rate) + (chance < F.col(rate) - F.floor(rate)).cast("long")).cast("long")


def _fitted(docs: DataFrame, model: Classifier, targets: dict[str, float], ridge: float) -> tuple[DataFrame, Rates]:
    path = fresh_path(docs.sparkSession, "memberships")
    memberships(docs, model).write.parquet(path)
    members = docs.sparkSession.read.parquet(path)
    return members, fit(members, list(targets.values()), ridge)


def apply(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], ridge: float = RIDGE) -> DataFrame:
    """The rows of ``docs``, each as often as its ``copies`` say, with their columns."""
    model = classifier(docs, labelled, list(targets))
    _, rates = _fitted(docs, model, targets, ridge)
    known = docs.sparkSession.sparkContext.broadcast((model, rates))  # fixed size, as above

    @F.pandas_udf("double")
    def rate(texts: pd.Series) -> pd.Series:
        model, of = known.value
        p = np.stack([model.posterior(t)[0] for t in texts]) if len(texts) else np.zeros((0, len(model.domains)))
        return pd.Series(of(p)[0])

    rows = docs.select(
        F.struct("*").alias("row"),
        docs["doc_id"].cast("long").alias("doc_id"),
        content(docs).alias("content"),
        rate.asNondeterministic()(docs["text"].cast("string")).alias("rate"),  # so that it is called once a row
    )
    times = rows.withColumn("copies", _copies("doc_id", "content", "rate")).where("copies > 0")
    return times.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")
