"""Toxicity by maximum-scoring segments.

Each token has a score: its log-odds of standing in toxic rather than clean documents, with a Dirichlet prior
drawn from all training documents, lowered by its uncertainty. A linear-time scan over a text's scores finds
every maximal passage (no part of it scores higher, no extension does). Under the scores of clean text the best
passage of n tokens follows an extreme-value law, so a passage counts as lambda * score - ln(K * n), and
documents of all lengths share one scale. The passages above 0 on it are significant; the r best of them together have
a sum whose chance the same law gives, and a document's evidence is the least likely of these sums. A logistic
curve over the evidence, fitted on the training documents, gives a number between 0 and 1.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.llm.common import Shared, as_bytes, column, map_batches, remainder, session, small_batches, texts

#: The most labelled documents that the scores are learned from: those of smallest hashed id.
TRAINING_ROWS = 20_000
#: Weight of the prior, in documents.
PRIOR = 20.0
#: Standard errors by which a token's log-odds are lowered towards zero.
CAUTION = 2.33
#: What a token without a score of its own costs; keeps passages short.
DRIFT = 0.35

#: A-Z to a-z, other ASCII but letters, digits and the apostrophe to a space; UTF-8 bytes above stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() or b == 39 else 32 for b in range(256))


#: Bytes of the stems that stand for words too rare to be known themselves.
STEMS = (4, 5, 6, 7, 8)


def tokens(data: bytes) -> list[bytes]:
    """Lower-case words without ASCII punctuation."""
    return data.translate(_FOLD).split()


def features(word: bytes) -> list[bytes]:
    """A word and its stems, which a zero byte marks."""
    return [word, *(b"\0" + word[:k] for k in STEMS if len(word) > k)]


@dataclass
class Model:
    """Scores by token, and the laws that turn a passage's score into a probability."""

    scores: dict[bytes, float]
    lam: float
    log_k: float
    bias: float
    slope: float

    def __post_init__(self) -> None:
        self.seen: dict[bytes, float] = {}

    def series(self, words: list[bytes]) -> np.ndarray:
        """Each word's score: the highest among its own and its stems', else what a neutral word costs."""
        seen, get = self.seen, self.scores.get
        if len(seen) > 300_000:
            seen.clear()
        for w in [w for w in set(words) if w not in seen]:
            seen[w] = max(get(f, -DRIFT) for f in features(w))
        return np.fromiter(map(seen.__getitem__, words), np.float64, len(words))

    def evidence(self, passages: list[float], n: int) -> float:
        """Minus the logarithm of the chance of the passages' scores in clean text of n tokens: of the best one, or of the
        sum of the r best (Karlin and Altschul), each further one at the price of a factor of two."""
        base = self.log_k + math.log(max(n, 1))
        own = sorted((self.lam * r - base for r in passages), reverse=True) or [-base]
        best = total = own[0]
        for r, x in enumerate(own[1:], 2):
            if x <= 0:
                break
            total += x
            best = max(best, total - (r - 1) * math.log(total) + math.lgamma(r + 1) + math.lgamma(r) - r * math.log(2))
        return best

    def probability(self, passages: list[float], n: int) -> float:
        x = self.bias + self.slope * self.evidence(passages, n)
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, x))))

    def read(self, data: bytes) -> tuple[int, list[tuple[int, int, float]], float]:
        """A text's tokens, its passages and its probability."""
        words = tokens(data)
        found = segments(self.series(words), 0.0)
        return len(words), found, self.probability([r for _, _, r in found], len(words))


def segments(s: np.ndarray, least: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of at least `least`, in order: Ruzzo and Tompa's scan."""
    at, base = [], []  # stack of candidates: start, end; prefix sums left of and at their ends
    prefix = np.concatenate(([0.0], np.cumsum(s)))
    for i in np.flatnonzero(s > 0).tolist():
        start, left, right = i, prefix[i], prefix[i + 1]
        while True:
            j = len(at) - 1
            while j >= 0 and base[j][0] >= left:
                j -= 1
            if j < 0 or base[j][1] >= right:
                break
            start, left = at[j][0], base[j][0]
            del at[j:], base[j:]
        at.append((start, i + 1))
        base.append((left, right))
    return [(a, b, float(r - x)) for (a, b), (x, r) in zip(at, base, strict=True) if r - x >= least]


def learn(docs: DataFrame, labels: DataFrame, training_rows: int = TRAINING_ROWS, folds: int = 5) -> Model:
    """Fit on labelled documents whose crc32(doc_id) modulo `folds` is not 0.

    At most `training_rows` documents are used, those of smallest xxhash64(doc_id); so the labels broadcast,
    the counts and the scores that return to the driver have a bound that doesn't depend on the corpus. A
    document labelled more than once is toxic if any label says so; null labels and ids teach nothing. With no
    training document of one of the two classes every text scores alike.
    """
    spark = session(docs)
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    rows = rows.where("doc_id is not null and toxic is not null").where(remainder(folds) != 0)
    rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(training_rows)
    bounded = spark.createDataFrame(rows.toPandas().astype("int64"), "doc_id long, toxic long")  # training_rows rows at most
    # copies of one text would make its words look like evidence, so each family of texts teaches once
    kept = texts(docs).join(F.broadcast(bounded), "doc_id").mapInArrow(_families, "doc_id long, toxic long, one long, two long")
    kept = kept.groupBy("toxic", "one").agg(F.min(F.struct("doc_id", "two")).alias("r")).groupBy("toxic", "r.two").agg(F.min("r.doc_id").alias("doc_id"))
    labelled = kept.select("doc_id", "toxic").toPandas().astype("int64")
    bounded = spark.createDataFrame(labelled, "doc_id long, toxic long")
    known = texts(docs).join(F.broadcast(bounded), "doc_id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for data, label in zip(as_bytes(batch), column(batch, "toxic"), strict=True):
                seen[label > 0].update({f for w in set(tokens(data)) for f in features(w)})
        both = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_pydict(
            {"token": both, "clean": [seen[0][w] for w in both], "toxic": [seen[1][w] for w in both]}, schema=pa.schema([("token", pa.binary()), ("clean", pa.int64()), ("toxic", pa.int64())])
        )

    toxic = int((labelled["toxic"] > 0).sum())
    clean = len(labelled) - toxic
    if not clean or not toxic:
        return Model({}, 1.0, 0.0, -1.0, 0.0)
    counts = known.mapInArrow(count, "token binary, clean long, toxic long").groupBy("token").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    telling = counts.where((F.col("toxic") >= 3) & (F.col("toxic") * clean > 2 * F.col("clean") * toxic))
    table = {bytes(r["token"]): (r["clean"], r["toxic"]) for r in telling.collect()}  # words of the bounded sample
    scores = {}
    for word, (c, t) in table.items():
        prior = PRIOR * (c + t) / (clean + toxic)
        p, q = (t + prior) / (toxic + PRIOR), (c + prior) / (clean + PRIOR)
        p, q = min(p, 1 - 1e-9), min(q, 1 - 1e-9)
        odds = math.log(p / (1 - p)) - math.log(q / (1 - q))
        spread = CAUTION * math.sqrt(1 / (t + prior) + 1 / (c + prior))
        if odds - spread > DRIFT:
            scores[word] = odds - spread
    model = Model(scores, 1.0, 0.0, 0.0, 1.0)
    found = known.mapInArrow(_passages(model, lambda own, n: max(own, default=0.0)), "toxic long, n long, x double").toPandas()  # three numbers for each training document
    _law(model, found["n"].to_numpy()[found["toxic"] <= 0], found["x"].to_numpy()[found["toxic"] <= 0])
    found = known.mapInArrow(_passages(model, model.evidence), "toxic long, n long, x double").toPandas()
    return _calibrate(model, found["toxic"].to_numpy() > 0, found["x"].to_numpy())


def _families(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two min-hashes of each text's runs of four tokens: copies share one or the other."""
    kind = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int64()), ("one", pa.int64()), ("two", pa.int64())])
    for batch in batches:
        least = []
        for data in as_bytes(batch):
            w = tokens(data)
            h = {zlib.crc32(b" ".join(w[i : i + 4])) for i in range(max(1, len(w) - 3))}
            least.append((min(h), min(x * 0x9E3779B1 & 0xFFFFFFFF for x in h)))
        yield pa.RecordBatch.from_pydict({"doc_id": column(batch, "doc_id"), "toxic": column(batch, "toxic"), "one": [a for a, _ in least], "two": [b for _, b in least]}, schema=kind)


def _passages(model: Model, of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [model.read(x) for x in as_bytes(batch)]
            yield pa.RecordBatch.from_pydict({"toxic": column(batch, "toxic"), "n": [n for n, _, _ in rows], "x": [of([r for _, _, r in found], n) for n, found, _ in rows]}, schema=pa.schema([("toxic", pa.int64()), ("n", pa.int64()), ("x", pa.float64())]))

    return run


def _law(model: Model, n: np.ndarray, best: np.ndarray) -> None:
    """The extreme-value law of clean documents' best passages, by moments."""
    spread = max(float(best.std()), 0.25)
    model.lam = math.pi / (spread * math.sqrt(6))  # a Gumbel law's standard deviation is pi / (lambda sqrt 6)
    model.log_k = float(np.mean(model.lam * best - np.log(np.maximum(n, 1)))) - 0.5772156649


def _calibrate(model: Model, toxic: np.ndarray, x: np.ndarray) -> Model:
    """A logistic curve over the evidence, by Newton steps."""
    scale, shift = max(float(x.std()), 1e-9), float(x.mean())
    design = np.stack([np.ones(len(x)), (x - shift) / scale], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (p - toxic) + 1e-2 * w
        hess = (design * (p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        w -= np.clip(np.linalg.solve(hess, grad), -5, 5)
    model.slope = max(0.0, float(w[1] / scale))
    model.bias = float(w[0] - w[1] * shift / scale)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row for each row of docs: doc_id, n_tokens, best, score (0 to 1), passages (array of "start-end").

    passages: token ranges of the significant passages of texts at 0.5 or more. Null and empty
    texts have no token and score as a text without any passage. Repeated rows are scored each.
    """
    held = Shared(session(docs), model)  # bounded by the training sample

    def make(batch: pa.RecordBatch) -> dict:
        model = held.value
        out: dict = {"doc_id": column(batch, "doc_id"), "n_tokens": [], "best": [], "score": [], "passages": []}
        for data in as_bytes(batch):
            n, found, p = model.read(data)
            out["n_tokens"].append(n)
            out["best"].append(max((r for _, _, r in found), default=0.0))
            out["score"].append(p)
            out["passages"].append(",".join(f"{a}-{b}" for a, b, r in found if model.evidence([r], n) > 0) if p >= 0.5 else "")
        return out

    return map_batches(texts(docs), make, "doc_id long, n_tokens long, best double, score double, passages string")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns unchanged, whose score is under the threshold."""
    small_batches(session(docs))
    held = Shared(session(docs), model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            keep = [model.read(data)[2] < threshold for data in as_bytes(batch)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
