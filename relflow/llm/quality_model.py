"""Quality classifier by co-training a text view and a metadata view.

Text view: shares of character classes and of their adjacent pairs, word and line statistics,
hashed words.  Metadata view: hashed source and language and the length the page declares.
Both are logistic models trained here on at most ``MAX_LABELLED`` labelled documents (those of
smallest id hash), 60 % to fit, 20 % to calibrate and 20 % that only figures are taken from.  Over ``ROUNDS`` rounds each view labels
its most confident documents of all unlabelled ones for the other: their features are written
once, every round scores them in a distributed pass per view (a histogram of confidence gives the
place of the cut) and fits by Newton steps whose gradients and Hessians are summed per task.
What a document was labelled in earlier rounds is recomputed from those rounds' rules.  All
pseudo-labels together weigh at most half of the labels, however many they are.
Each view is then calibrated (Platt) and the calibrated log-odds are stacked on the held-out part.
All documents are scored in one pass; the weights sent along have a fixed size.

``kept`` uses the score at which at most ``LOSE`` of the calibrating good documents fall away.

Defined results: null text and metadata count as empty, null n_chars as zero; labels with a null
id or quality are ignored, repeated ones take the largest; no labelled document, in the sample or
not, gets a pseudo-label, and documents with a null id count as unlabelled; without labels of both classes every
document gets the good share as its score (0.5 without any) and is kept; an empty table gives
none; repeated rows are scored alike; other columns never enter.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop, table

MAX_LABELLED = 8_000
ROUNDS = 4
PER_ROUND = 0.05
SURE = 0.95
LOSE = 0.01
#: Newton steps of a round's fit, each a pass over the unlabelled documents; they start at the last round's weights.
STEPS = 3
#: Tasks of such a pass at most: each sends its sums (about 0.45 MB) to the driver.
PARTS = 128
_BINS = 4_096
_WORD_BUCKETS = 256
_META_BUCKETS = 64


def _classes() -> np.ndarray:
    kinds = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\x0b\x0c", "\n", ".", ",", "!", "?", "#*$%&", "|<>", "\"'()[]{}", "-_/\\:;=+@~^`"]
    out = np.full(256, len(kinds), np.uint8)  # bytes outside ASCII
    for k, chars in enumerate(kinds):
        out[[ord(c) for c in chars]] = k
    return out


_CLASS = _classes()
_N = int(_CLASS.max()) + 1
_DENSE = 9
TEXT_WIDTH = _N + _N * _N + _DENSE + _WORD_BUCKETS
META_WIDTH = 2 * _META_BUCKETS + 3


def text_features(text: str) -> np.ndarray:
    """The text view of one whole text."""
    x = np.zeros(TEXT_WIDTH, np.float32)
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    if not raw.size:
        return x
    c = _CLASS[raw]
    x[:_N] = np.bincount(c, minlength=_N) / raw.size
    pairs = np.bincount(c[:-1].astype(np.int16) * _N + c[1:], minlength=_N * _N)
    x[_N : _N + _N * _N] = pairs / max(1, raw.size - 1) * 4
    words = text.split()
    n = len(words)
    if not n:
        return x
    counts = Counter(words)
    lines = [s for s in text.split("\n") if s and not s.isspace()]
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    x[_N + _N * _N : _N + _N * _N + _DENSE] = (
        np.log1p(n) / 8,
        min(n, 50) / 50,
        len(counts) / n,
        len(counts) / n**0.8,
        max(counts.values()) / n,
        same / n,
        (len(text) / n) / 10,
        1 - len(set(lines)) / max(1, len(lines)),
        min(len(lines) / n * 5, 2),
    )
    tail = x[-_WORD_BUCKETS:]
    for w, k in counts.items():
        tail[zlib.crc32(w.encode("utf-8", "replace")) % _WORD_BUCKETS] += k
    tail /= n
    np.sqrt(tail, out=tail)
    return x


def meta_features(source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    x = np.zeros(META_WIDTH, np.float32)
    x[zlib.crc32((source or "").encode()) % _META_BUCKETS] = 1
    x[_META_BUCKETS + zlib.crc32((lang or "").encode()) % _META_BUCKETS] = 1
    size = np.log1p(max(n_chars or 0, 0)) / 10
    x[-3:] = size, size * size, float((n_chars or 0) < 300)
    return x


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0, steps: int = 12) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last weight is the intercept."""
    a = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    w = np.zeros(a.shape[1])
    penalty = np.full(a.shape[1], ridge)
    penalty[-1] = 1e-6
    weight = np.ones(len(y)) if weight is None else weight
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (weight * (p - y)) + penalty * w
        hess = (a * (weight * np.maximum(p * (1 - p), 1e-5))[:, None]).T @ a + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-5:
            break
    return w


def logits(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1] + w[-1], -30, 30)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


def _bins(z: np.ndarray, sure: float) -> np.ndarray:
    """The bin of each confidence (log-odds for the class in question); below zero where it is not sure."""
    low = np.log(sure / (1 - sure))
    return np.minimum(np.floor((z - low) / (30 - low) * _BINS), _BINS - 1).astype(np.int64)


def _draw(h: np.ndarray, n: int) -> np.ndarray:
    """A number in [0, 1) of each hash, another one for every rule ``n``."""
    z = h.astype(np.int64).view(np.uint64) + np.uint64((n + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z ^ (z >> np.uint64(31))) / 2.0**64


def pseudo(x: list[np.ndarray], h: np.ndarray, rules: list[tuple], sure: float = SURE) -> tuple[np.ndarray, np.ndarray]:
    """Per document its pseudo-label (-1 for none) and the view that gave it, by all rules in turn."""
    label, giver = np.full(len(h), -1), np.zeros(len(h), int)
    for n, (v, w, cuts) in enumerate(rules):
        z, draw = logits(x[v], w), _draw(h, n)
        free = label < 0
        for y, (edge, share) in enumerate(cuts):
            at = _bins(z if y else -z, sure)
            take = free & (at >= 0) & ((at > edge) | (at == edge) & (draw < share))
            label[take], giver[take] = y, v
    return label, giver


def cut_at(counts: np.ndarray, most: int) -> tuple[int, float]:
    """(edge, share): all above the bin ``edge`` and ``share`` of it are the ``most`` most confident."""
    above = 0
    for b in np.flatnonzero(counts)[::-1].tolist():
        if above + counts[b] > most:
            return b, float((most - above) / counts[b])
        above += int(counts[b])
    return -1, 0.0


def _views(batch) -> tuple[list[np.ndarray], np.ndarray]:
    x = [np.frombuffer(b"".join(batch.column(i).to_pylist()), np.float32).reshape(batch.num_rows, -1) for i in (0, 1)]
    return x, batch.column(2).to_numpy()


def _confident(pool: DataFrame, rules: list[tuple], v: int, w: np.ndarray, sure: float) -> np.ndarray:
    """Counts of the still unlabelled documents by class and bin of view ``v``'s confidence."""

    def run(batches):
        from relflow.llm.quality_model import _BINS, _bins, _views, logits, pseudo

        counts = np.zeros((2, _BINS), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, h = _views(batch)
            free = pseudo(x, h, rules, sure)[0] < 0
            z = logits(x[v], w)[free]
            for y in (0, 1):
                at = _bins(z if y else -z, sure)
                counts[y] += np.bincount(at[at >= 0], minlength=_BINS)
        y, b = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(y.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(counts[y, b])], names=["y", "b", "n"])

    out = np.zeros((2, _BINS), np.int64)
    for y, b, n in pool.mapInArrow(run, "y int, b int, n long").groupBy("y", "b").agg(F.sum("n")).collect():
        out[y, b] = n
    return out


def sums(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian of the log-loss of these rows at ``w``, without the ridge."""
    a = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
    return a.T.astype(np.float64) @ (p - y), (a * np.maximum(p * (1 - p), 1e-5).astype(a.dtype)[:, None]).T @ a


def _sums(pool: DataFrame, rules: list[tuple], models: list[np.ndarray], sure: float) -> list[tuple]:
    """Per view the number, gradient and Hessian of all documents that the other view labelled."""

    def run(batches):
        from relflow.llm.quality_model import _views, pseudo, sums

        n, g, s = [0, 0], [np.zeros(len(w)) for w in models], [np.zeros((len(w), len(w))) for w in models]
        for batch in batches:
            if not batch.num_rows:
                continue
            x, h = _views(batch)
            label, giver = pseudo(x, h, rules, sure)
            for o in (0, 1):
                on = (label >= 0) & (giver == 1 - o)
                if on.any():
                    dg, ds = sums(x[o][on], label[on], models[o])
                    n[o], g[o], s[o] = n[o] + int(on.sum()), g[o] + dg, s[o] + ds
        for o in (0, 1):
            if n[o]:
                half = s[o][np.triu_indices(len(s[o]))].astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([o], pa.int32()), pa.array([n[o]], pa.int64()), pa.array([g[o].tobytes()], pa.binary()), pa.array([half.tobytes()], pa.binary())], names=["o", "n", "g", "s"])

    out = [[0, np.zeros(len(w)), np.zeros((len(w), len(w)))] for w in models]
    for o, n, g, s in pool.coalesce(PARTS).mapInArrow(run, "o int, n long, g binary, s binary").toLocalIterator():
        out[o][0] += n
        out[o][1] += np.frombuffer(g)
        half = np.zeros_like(out[o][2])
        half[np.triu_indices(len(half))] = np.frombuffer(s, np.float32)
        out[o][2] += half + np.triu(half, 1).T
    return out


def cotrain(views: list[np.ndarray], y: np.ndarray, pool: DataFrame, rounds: int = ROUNDS, per_round: float = PER_ROUND, sure: float = SURE) -> tuple[list[np.ndarray], dict]:
    """Weights of both views after exchanging confident pseudo-labels over the whole ``pool`` (t, m, h), and its counts."""
    ridge = [0.3, 3.0]
    models = [fit(views[v], y.astype(float), ridge=ridge[v]) for v in (0, 1)]
    size = pool.count()
    told = {"unlabelled": size, "pseudo": [0, 0], "weights": [0.0, 0.0]}
    most, base = max(1, int(per_round * size)), float(y.mean())
    rules: list[tuple] = []
    for _ in range(rounds if size else 0):
        given = False
        for v in (0, 1):
            counts = _confident(pool, rules, v, models[v], sure)
            if not counts.any():
                continue
            given = True
            # in the proportion of the labels, so that neither class is drowned
            rules.append((v, models[v], [cut_at(counts[0], max(1, int(most * (1 - base)))), cut_at(counts[1], max(1, int(most * base)))]))
        if not given:
            break
        for _ in range(STEPS):
            moved = 0.0
            for o, (n, g, s) in enumerate(_sums(pool, rules, models, sure)):
                w = models[o]
                penalty = np.full(len(w), ridge[o])
                penalty[-1] = 1e-6
                grad, hess = sums(views[o].astype(np.float64), y, w)
                weight = min(0.5, 0.5 * len(y) / max(n, 1))
                told["pseudo"][o], told["weights"][o] = n, weight
                step = np.linalg.solve(hess + weight * s + np.diag(penalty), grad + weight * g + penalty * w)
                models = [*models[:o], w - step, *models[o + 1 :]]
                moved = max(moved, np.abs(step).max())
            if moved < 1e-3:
                break
    return models, told


def _featured(rows: DataFrame, rest: str) -> DataFrame:
    """t, m (float32 features of both views) and the columns ``rest`` of text, source, lang, n_chars and ``rest``."""

    names = [f.split()[0] for f in rest.split(", ")]

    def run(batches):
        from relflow.llm.quality_model import meta_features, text_features

        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                cols = [c.to_pylist() for c in part.columns[:4]]
                text = [text_features(t or "").tobytes() for t in cols[0]]
                meta = [meta_features(*m).tobytes() for m in zip(*cols[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(text, pa.binary()), pa.array(meta, pa.binary()), *part.columns[4:]], names=["t", "m", *names])

    return rows.select("text", "source", "lang", "n_chars", *names).mapInArrow(run, f"t binary, m binary, {rest}")


def _known(labels: DataFrame) -> DataFrame:
    return labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("y"))


def _sample(docs: DataFrame, labels: DataFrame, max_labelled: int):
    """Features of the bounded labelled sample: (text, meta, label, hash)."""
    h = F.xxhash64("doc_id")
    labelled = _known(labels).orderBy(h, "doc_id").limit(max_labelled)
    return _featured(docs.join(F.broadcast(labelled), "doc_id").withColumn("h", h), "y int, h long").toArrow()


def unlabelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Features (t, m) and a hash of every document without a label; features rather than texts meet the labels."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = _featured(docs.withColumn("h", F.xxhash64(F.lit(7), "doc_id", "text")), f"doc_id {kind}, h long")
    return rows.join(_known(labels).select("doc_id"), "doc_id", "left_anti").select("t", "m", "h")


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> dict:
    """Weights of both views, their calibrations, the stack and the threshold."""
    got = _sample(docs, labels, max_labelled)
    y, h = got["y"].to_numpy(), got["h"].to_numpy()
    order = np.argsort(h, kind="stable")
    y, h = y[order], h[order]
    stack = lambda name: np.vstack([np.frombuffer(b, np.float32) for b in got[name].to_pylist()])[order]
    if len(y) < 20 or y.min() == y.max():
        return {"prior": float(y.mean()) if len(y) else 0.5}
    text, meta = stack("t"), stack("m")
    held, fresh = h % 5 == 3, h % 5 == 4
    fitted = ~held & ~fresh
    if len(set(y[fitted])) < 2 or len(set(y[held])) < 2:
        held = fitted = np.ones(len(y), bool)
    pool = cut(unlabelled(docs, labels), "unlabelled")
    models, told = cotrain([text[fitted], meta[fitted]], y[fitted], pool)
    drop(pool)
    views = [logits(v, m) for v, m in zip((text, meta), models, strict=True)]
    platt, top = calibrate([z[held] for z in views], y[held])
    score = combine(views, platt, top)
    threshold = float(min(0.5, np.quantile(score[held & (y == 1)], LOSE)))
    return {"models": models, "platt": platt, "top": top, "threshold": threshold, "held_out": (score[fresh], y[fresh]), "told": told}


def calibrate(views: list[np.ndarray], y: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Platt's fit of each view's log-odds to held-out labels, and the stack of the calibrated ones."""
    platt = [fit(z[:, None].astype(np.float32), y.astype(float), ridge=0.01) for z in views]
    return platt, fit(np.stack([logits(z[:, None], p) for z, p in zip(views, platt, strict=True)], 1), y.astype(float), ridge=0.1)


def combine(views: list[np.ndarray], platt: list[np.ndarray], top: np.ndarray) -> np.ndarray:
    return _sigmoid(logits(np.stack([logits(z[:, None], p) for z, p in zip(views, platt, strict=True)], 1), top))


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, p_text, p_meta, score, kept of every document."""
    if "prior" in model:
        p = F.lit(model["prior"])
        return docs.select("doc_id", p.alias("p_text"), p.alias("p_meta"), p.alias("score"), F.lit(True).alias("kept"))
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(n, T.DoubleType()) for n in ("p_text", "p_meta", "score")), T.StructField("kept", T.BooleanType())])
    models, platt, top, threshold = model["models"], model["platt"], model["top"], model["threshold"]

    def run(batches):
        from relflow.llm.quality_model import _sigmoid, logits, meta_features, text_features

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                cols = [c.to_pylist() for c in part.columns[1:]]
                x = [np.stack([text_features(t or "") for t in cols[0]]), np.stack([meta_features(*m) for m in zip(*cols[1:4], strict=True)])]
                z = np.stack([logits(logits(a, m)[:, None], p) for a, m, p in zip(x, models, platt, strict=True)], 1)
                s = _sigmoid(logits(z, top))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(_sigmoid(z[:, 0])), pa.array(_sigmoid(z[:, 1])), pa.array(s), pa.array(s >= threshold)], names=schema.names)

    return docs.select("doc_id", "text", "source", "lang", "n_chars").mapInArrow(run, schema)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang", "n_chars")
    return score(docs, train(docs, table(spark, sf_dir, "labels").select("doc_id", "quality")))
