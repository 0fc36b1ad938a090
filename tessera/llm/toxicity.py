"""Toxic passages as maximum-scoring segments of token log-odds, with extreme-value calibration.

Learning. The rows of at most TRAIN_ROWS labelled ids (those of least hash; documented bound) are read, one row of a
repeated id. Copies are counted once: rows of one label whose whole shingle sets are equal are one. A token's features
are the whole word and its byte prefixes of PREFIXES lengths, so inflected words share evidence. A feature's log-odds
ratio between the classes has an informative Dirichlet prior (PRIOR of the smaller class's tokens, dealt by overall
frequency); features are kept where the z score of the ratio of document frequencies, with a prior of DOC_PRIOR,
reaches SIGNIFICANT. Three numbers a training row reach the driver, and the features of at least LEAST_DOCS toxic rows.

Scoring. A token scores the log-odds of its most specific kept feature; any other token scores a negative drift, so
that clean text scores below zero on average. All maximal scoring segments are found in linear time, by one scan
with a stack over the scored tokens. In clean text the best segment of n tokens follows P(S >= x) = 1 - exp(-K n
exp(-lambda x)); lambda and K are fitted by maximum likelihood to the clean training rows. Segments count by
lambda S - ln(K n), the significant ones summed, and a logistic curve over the logarithm of that, fitted on the
training rows, gives 0 to 1.

Null, empty and wordless texts have no segment and get the score of no evidence. Ids may be null or repeated; every
row is scored by its text alone. Without training rows of both classes the model is empty and scores the base rate. An
empty table gives no rows. Further columns are ignored, or passed on by `accepted`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import words as W
from tessera.llm.store import stored

TRAIN_ROWS = 40_000
PREFIXES = (3, 4, 5, 6, 7, 8, 9, 10)
PRIOR = 0.05
#: For document frequencies: as many as the smaller class has, so that a few dozen toxic rows can show a word.
DOC_PRIOR = 1.0
SIGNIFICANT = 3.0
LEAST_DOCS = 4
THRESHOLD = 0.7
U = np.uint64


def token_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features, starts, ends, bounds): a column for each prefix length and a last one for the word; 0 where it is shorter."""
    starts, ends, bounds = W.spans(data, offsets, W.PUNCTUATION)
    out = np.zeros((len(starts), len(PREFIXES) + 1), dtype=U)
    if len(starts):
        sums, inverse = W.prefix_sums(data)
        for k, length in enumerate(PREFIXES):
            long = np.flatnonzero(ends - starts >= length)
            s = starts[long]
            out[long, k] = W.mix((sums[s + length] - sums[s]) * inverse[s] + U(length))
        out[:, -1] = W.mix((sums[ends] - sums[starts]) * inverse[starts] + U(1 << 32))
    return out, starts, ends, bounds


@dataclass
class Model:
    """features are sorted; rate is the share of toxic training rows."""

    features: np.ndarray = field(default_factory=lambda: np.empty(0, U))
    weights: np.ndarray = field(default_factory=lambda: np.empty(0))
    drift: float = 0.1
    rate: float = 0.0
    decay: float = 1.0
    spread: float = 1.0
    slope: float = 0.0
    level: float = 0.0

    def token_scores(self, features: np.ndarray) -> np.ndarray:
        """The log-odds of each token's most specific kept feature, else 0."""
        out = np.zeros(len(features))
        if len(self.features):
            for column in features.T:  # from short prefixes to the word: the later ones win
                seat = np.minimum(np.searchsorted(self.features, column), len(self.features) - 1)
                hit = self.features[seat] == column
                out[hit] = self.weights[seat[hit]]
        return out

    def evidence(self, segments: list[tuple[int, int, float]], n: int) -> float:
        """Sum of the significant segments' normalised scores, else the best one's."""
        if not segments or not n:
            return min(0.0, -np.log(self.spread * max(n, 1)))
        scores = [self.decay * s - np.log(self.spread * n) for _, _, s in segments]
        high = sum(x for x in scores if x > 0)
        return float(high or max(scores))

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * squeezed(evidence) + self.level, -30, 30)))


def squeezed(evidence: np.ndarray) -> np.ndarray:
    """Signed log(1 + |x|): texts with hundreds of toxic words don't flatten the curve where it decides."""
    return np.sign(evidence) * np.log1p(np.abs(evidence))


def maximal_segments(places: np.ndarray, scores: np.ndarray, drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring runs (first token, end token, score), where unlisted tokens score -drift. Linear time."""
    stack: list[tuple[int, int, float, float, int]] = []  # first, end, total before, total after, stack depth of the nearest lesser total
    total, last = 0.0, 0
    for at, score in zip(places.tolist(), scores.tolist(), strict=True):
        total -= drift * (at - last)
        last = at + 1
        if score <= 0:
            total += score
            continue
        first, before, after = at, total, total + score
        total = after
        depth = len(stack) - 1
        while True:
            while depth >= 0 and stack[depth][2] >= before:
                depth = stack[depth][4]
            if depth < 0 or stack[depth][3] >= after:
                break
            first, before = stack[depth][0], stack[depth][2]
            del stack[depth:]
            depth -= 1
        stack.append((first, at + 1, before, after, depth))
    return [(first, end, after - before) for first, end, before, after, _ in stack]


def row_segments(model: Model, array: pa.Array) -> Iterator[tuple[int, list[tuple[int, int, float]], np.ndarray, np.ndarray]]:
    """(tokens, segments, starts, ends) of each row; starts and ends are the tokens' byte places in the row."""
    for lo, hi, data, offsets in W.slices(array):
        features, starts, ends, bounds = token_features(data, offsets)
        scores = model.token_scores(features)
        hits = np.flatnonzero(scores)
        edges = np.searchsorted(hits, bounds)
        for i in range(hi - lo):
            a, b = bounds[i], bounds[i + 1]
            own = hits[edges[i] : edges[i + 1]]
            found = maximal_segments(own - a, scores[own], model.drift) if len(own) else []
            yield int(b - a), found, starts[a:b] - offsets[i], ends[a:b] - offsets[i]


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [W.digests(found, edges)[1] for _, _, found, edges in W.shingles(batch.column("text"))]
        keys = np.concatenate([*keys, np.empty((0, 2), np.int64)])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys[:, 0]), pa.array(keys[:, 1])], names=["id", "text", "y", "h1", "h2"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per slice and class: tokens and documents with each feature; feature 0 holds the totals."""
    for batch in batches:
        toxic = batch.column("y").to_numpy() == 1
        for label in (0, 1):
            for lo, hi, data, offsets in W.slices(batch.column("text").filter(pa.array(toxic == bool(label)))):
                features, _, _, bounds = token_features(data, offsets)
                rows = np.repeat(np.arange(hi - lo), np.diff(bounds))
                parts = [(np.zeros(1, U), np.array([len(features)]), np.array([hi - lo]))]
                for column in features.T:
                    order = np.lexsort((rows, column))
                    order = order[np.searchsorted(column[order], 1) :]
                    if not len(order):
                        continue
                    value, row = column[order], rows[order]
                    fresh = np.append(True, value[1:] != value[:-1])
                    firsts = np.flatnonzero(fresh)
                    new_doc = fresh | np.append(True, row[1:] != row[:-1])
                    parts.append((value[firsts], np.diff(np.append(firsts, len(value))), np.add.reduceat(new_doc.astype(np.int64), firsts)))
                names, tokens, docs = (np.concatenate(x) for x in zip(*parts, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(np.full(len(names), label)), pa.array(tokens.astype(np.int64)), pa.array(docs.astype(np.int64))], names=["feature", "y", "tokens", "docs"])


def _log_odds(one, zero, n_one, n_zero, strength=PRIOR):
    """Log-odds ratio under the informative prior, and its z score; arguments may be arrays."""
    prior = strength * min(n_one, n_zero)
    share = prior * (one + zero) / (n_one + n_zero)
    ratio = np.log((one + share) / np.maximum(n_one + prior - one - share, 1)) - np.log((zero + share) / np.maximum(n_zero + prior - zero - share, 1))
    return ratio, ratio / np.sqrt(1 / (one + share) + 1 / (zero + share))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(id, text, y): at most `rows` labelled ids with a text each, copies once."""
    chosen = labels.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").cast("int").alias("y")).where("id is not null and y in (0, 1)").orderBy(F.xxhash64("id"), "id").limit(rows)
    narrow = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    keyed = stored(narrow.join(F.broadcast(chosen), "id").select("id", "text", "y").mapInArrow(W.tidy(_digested), "id long, text string, y int, h1 long, h2 long"), "toxicity-rows")
    one_text = keyed.groupBy("id").agg(F.min(F.struct("h1", "h2", "y")).alias("d"))
    once = one_text.groupBy("d").agg(F.min("id").alias("id")).select("id", "d.*")  # at most `rows`
    return keyed.join(F.broadcast(once), ["id", "h1", "h2", "y"], "left_semi").groupBy("id", "y").agg(F.min("text").alias("text")).select("id", "text", "y")


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """docs (doc_id, text), labels (doc_id, toxic): the caller leaves out what must not be learnt from."""
    train = stored(training_rows(docs, labels, rows), "toxicity-train")
    counts = stored(
        train.mapInArrow(W.tidy(_counted), "feature long, y long, tokens long, docs long")
        .groupBy("feature")
        .agg(*[F.sum(F.when(F.col("y") == y, F.col(c)).otherwise(0)).alias(f"{c}{y}") for c in ("tokens", "docs") for y in (0, 1)])
        .where(f"docs1 >= {LEAST_DOCS} or feature = 0"),
        "toxicity-counts",
    )
    total = counts.where("feature = 0").first()
    if not total or not total.docs0 or not total.docs1:
        share = 0.0 if not total or not total.docs1 else 1.0
        return Model(rate=share, level=30.0 if share else -30.0)
    kept = counts.where("feature <> 0").where(F.col("docs1") * total.docs0 > 2 * F.col("docs0") * total.docs1).toPandas()
    _, z = _log_odds(kept["docs1"].to_numpy(), kept["docs0"].to_numpy(), total.docs1, total.docs0, DOC_PRIOR)
    weight, _ = _log_odds(kept["tokens1"].to_numpy(), kept["tokens0"].to_numpy(), total.tokens1, total.tokens0)
    good = (z >= SIGNIFICANT) & (weight > 0)
    names = kept["feature"].to_numpy()[good].astype(np.int64).view(U)
    order = np.argsort(names)
    model = Model(names[order], weight[good][order], rate=total.docs1 / (total.docs0 + total.docs1))

    sent = model

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(n, sum(s for _, _, s in segments)) for n, segments, _, _ in row_segments(Model(sent.features, sent.weights, 0.0), batch.column("text"))]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.float64()), batch.column("y")], names=["n", "s", "y"])

    clean = train.mapInArrow(W.tidy(sums), "n long, s double, y int").where("y = 0").agg(F.sum("s"), F.sum("n")).first()
    model.drift = max(0.02, 4 * (clean[0] or 0.0) / max(clean[1] or 1, 1))

    def measured(of) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(tokens, of(segments, tokens), label) of every training row."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [(n, of(segments, n)) for n, segments, _, _ in row_segments(sent, batch.column("text"))]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.float64()), batch.column("y")], names=["n", "x", "y"])

        rows_ = train.mapInArrow(W.tidy(run), "n long, x double, y int").toPandas()  # three numbers a training row
        return np.maximum(rows_["n"].to_numpy(), 1), rows_["x"].to_numpy(), rows_["y"].to_numpy()

    n, top, y = measured(lambda segments, _: max((s for _, _, s in segments), default=0.0))
    model.decay, model.spread = extreme_value(top[y == 0], n[y == 0])
    _, evidence, y = measured(lambda segments, n: sent.evidence(segments, max(n, 1)))
    model.slope, model.level = logistic(squeezed(evidence), y)
    return model


def extreme_value(top: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Maximum-likelihood (lambda, K) of P(S >= x) = 1 - exp(-K n exp(-lambda x)), by bisection."""
    lo, hi = 1e-3, 20.0
    for _ in range(60):
        mid = (lo + hi) / 2
        weight = n * np.exp(-mid * top)
        lo, hi = (mid, hi) if 1 / mid - top.mean() + (weight * top).sum() / weight.sum() > 0 else (lo, mid)
    return lo, len(top) / float((n * np.exp(-lo * top)).sum())


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope (not negative) and level of a logistic curve, by damped Newton steps."""
    level, spread = x.mean(), x.std() or 1.0
    design, beta = np.stack([(x - level) / spread, np.ones(len(x))], axis=1), np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(2), design.T @ (y - p) - ridge * beta)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    slope = max(0.0, beta[0] / spread)
    return float(slope), float(beta[1] - slope * level)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, score, passages (byte places in the text, significant ones only)."""
    kind = docs.schema[id_col].dataType.simpleString()
    passage = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.runs(batches):
            evidence, passages = [], []
            for n, segments, starts, ends in row_segments(model, batch.column(1)):
                evidence.append(model.evidence(segments, n))
                limit = np.log(model.spread * n) / model.decay if n else 0.0
                passages.append([{"start": int(starts[a]), "end": int(ends[b - 1]), "score": s} for a, b, s in segments if s > limit])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.probability(np.array(evidence, dtype=float))), pa.array(passages, pa.list_(passage))], names=["id", "score", "passages"])

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(W.tidy(run), f"id {kind}, score double, passages array<struct<start: long, end: long, score: double>>").withColumnRenamed("id", id_col)


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """docs without the rows whose text scores `threshold` or more: decided where the row is read, with nothing shuffled."""
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.runs(batches):
            evidence = [model.evidence(segments, n) for n, segments, _, _ in row_segments(model, batch.column(place))]
            yield batch.filter(pa.array(model.probability(np.array(evidence, dtype=float)) < threshold))

    return docs.mapInArrow(W.tidy(run), docs.schema)


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from learning."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(3)) == 1, F.lit(False))
