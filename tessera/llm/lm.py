"""Language-model scores: a log-bilinear neural model trained with noise-contrastive estimation in numpy.

Tokens are words (A-Z lower-cased) and one end per document. Counts of every word in the training rows are gathered
over the whole corpus: each chunk of text sends one row per distinct word, and rows are summed by word. The totals of
the COMMON most frequent words go out with the tasks; of the others a chunk gets back those that aren't its own counts.

Model. The `top` most frequent training tokens (TOP unless given) are classes of their own; every other word belongs
to one of SHAPES classes by its last two bytes, so unseen words have a class too. P(word | context) = P(class |
context) * P(word | class); within a shape class, P(word) = (c + 1) / (N_s + V_s + 1), the 1 being for unseen words.
P(class | context) is log-bilinear: the prediction q = sum over the CONTEXT tokens before of C_i * R[class_i]
(diagonal C), the score q . S[class] + b[class]. The softmax over all classes is exact, by matrix products over the
distinct contexts, each of which a task normalises once.

Training. Noise-contrastive estimation: each token against NOISE draws from the class frequencies, shared by a
batch, with the normaliser taken as 1 and adaptive steps. Every training token is seen in each of ROUNDS passes; tasks
train on their own chunks from the same start. Their parameters, weighted by tokens, are one binary row a task, summed
in at most FAN tasks; only those sums, whose size is fixed, reach the driver.

Memory. A chunk's tokens stay 32-bit places in its vocabulary; they are opened RUN tokens at a time, across document
ends, so neither long documents nor large chunks make a task's arrays grow.

Null and empty texts are one end token. Repeated rows are scored and counted each. A null id is a training row.
Without training rows every class is equally likely and base_score is that of an empty vocabulary. An empty table
gives no rows. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import words as W
from tessera.llm.store import stored

TOP, SHAPES, CONTEXT, WIDTH = 1000, 88, 2, 16
NOISE, BATCH, ROUNDS, STEP = 32, 4096, 2, 0.1
CHUNK_BYTES = 8 << 20
RUN = 1 << 17
#: Contexts whose normalisers a task remembers, where so many are possible; else each run's are found anew.
REMEMBERED = 1 << 22
FAN = 64
#: Most words whose totals go out with the tasks (4 MB) instead of by a join.
COMMON = 1 << 18
END = W.mix(np.array([0xE0D], dtype=np.uint64))[0]
_CHUNK = "chunk long, ids array<long>, held array<boolean>, bounds binary, codes binary, vocabulary binary, shapes binary, counts binary"


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(7)) == 2, F.lit(False))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a chunk's documents: tokens as places in the chunk's own vocabulary, which is sorted by hash."""
    number, squeeze = TaskContext.get().partitionId() << 24, zstandard.ZstdCompressor(level=1).compress
    held: list[tuple] = []
    size = 0

    def made() -> pa.RecordBatch:
        nonlocal held, size, number
        ids, flags = [x for h in held for x in h[0]], np.concatenate([h[1] for h in held])
        tokens, shapes = np.concatenate([h[2] for h in held]), np.concatenate([h[3] for h in held])
        lengths = np.concatenate([h[4] for h in held])
        vocabulary, sample, codes = np.unique(tokens, return_index=True, return_inverse=True)
        train = np.bincount(codes, weights=np.repeat(~flags, lengths), minlength=len(vocabulary)).astype("<u4")
        row = {"chunk": number, "ids": ids, "held": flags.tolist(), "bounds": np.concatenate(([0], np.cumsum(lengths))).astype("<i8").tobytes(), "codes": squeeze(codes.astype("<u4").tobytes()), "vocabulary": vocabulary.tobytes(), "shapes": shapes[sample].tobytes(), "counts": train.tobytes()}
        held, size, number = [], 0, number + 1
        return pa.RecordBatch.from_pylist([row], schema=_SCHEMA)

    for batch in batches:
        ids, flags = batch.column("id").to_pylist(), batch.column("held").to_numpy(zero_copy_only=False).astype(bool)
        for lo, hi, data, offsets in W.slices(batch.column("text")):
            starts, ends, bounds = W.spans(data, offsets)
            counts = np.diff(bounds)
            tokens, shapes = np.full(len(starts) + hi - lo, END), np.zeros(len(starts) + hi - lo, np.uint8)
            seats = np.arange(len(starts)) + np.repeat(np.arange(hi - lo), counts)  # an end after each row
            tokens[seats] = W.hashes(data, starts, ends)
            tail, before = W.LOWER[data[ends - 1]], np.where(ends - starts > 1, W.LOWER[data[np.maximum(ends, 2) - 2]], 0)
            last = tail.astype(np.uint64) | before.astype(np.uint64) << np.uint64(8)
            shapes[seats] = W.mix(last) % np.uint64(SHAPES)
            held.append((ids[lo:hi], flags[lo:hi], tokens, shapes, counts + 1))
            size += len(data)
            if size >= CHUNK_BYTES:
                yield made()
    if held:
        yield made()


_SCHEMA = pa.schema(
    [("chunk", pa.int64()), ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), *((n, pa.binary()) for n in ("bounds", "codes", "vocabulary", "shapes", "counts"))]
)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """One chunk at a time, however many a batch holds."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _listed(common: np.ndarray | None = None):
    """(word, place = chunk and number in it, n, shape) of every distinct word of a chunk, but for those in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            words, counts, shapes = np.frombuffer(row["vocabulary"], "<u8"), np.frombuffer(row["counts"], "<u4"), np.frombuffer(row["shapes"], np.uint8)
            places = np.arange(len(words), dtype=np.int32)
            if common is not None:
                places = places[~_among(common, words)[0]]
            for lo in range(0, len(places), 65_536):
                at = places[lo : lo + 65_536]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), row["chunk"])), pa.array(at), pa.array(words[at].view(np.int64)), pa.array(counts[at].astype(np.int64)), pa.array(shapes[at].astype(np.int32))],
                    names=["chunk", "place", "word", "n", "shape"],
                )

    return run


def _among(known: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which words are in known (sorted), and where."""
    if not len(known):
        return np.zeros(len(words), dtype=bool), np.zeros(len(words), dtype=np.int64)
    seat = np.minimum(np.searchsorted(known, words), len(known) - 1)
    return known[seat] == words, seat


@dataclass
class Counts:
    """Corpus-wide counts: all tokens and distinct ones of the training rows; the top words, sorted by hash; the shape
    classes' counts. size: all classes, of which the first `size - SHAPES` are for top words. common: at most COMMON of
    the most frequent words, sorted by hash, whose counts go out with every task."""

    tokens: int
    distinct: int
    top: np.ndarray
    top_counts: np.ndarray
    shape_tokens: np.ndarray
    shape_distinct: np.ndarray
    size: int = TOP + SHAPES
    common: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    common_counts: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))

    def classes(self, vocabulary: np.ndarray, shapes: np.ndarray) -> np.ndarray:
        """Each word's class, in 16 bits where that is enough."""
        out = (self.size - SHAPES + shapes.astype(np.int64)).astype(np.uint16 if self.size < 1 << 16 else np.int32)
        own, seat = _among(self.top, vocabulary)
        out[own] = seat[own]
        return out

    def class_counts(self) -> np.ndarray:
        out = np.zeros(self.size)
        out[: len(self.top_counts)] = self.top_counts
        out[self.size - SHAPES :] = self.shape_tokens
        return out


@dataclass
class Model:
    targets: np.ndarray  # S, one row a class
    inputs: np.ndarray  # R, one row a class and a last one for what is before a document
    mixing: np.ndarray  # C, one row a context place
    bias: np.ndarray

    @classmethod
    def start(cls, counts: Counts) -> Model:
        draw = np.random.default_rng(8)
        frequency = counts.class_counts() + 0.5
        return cls(draw.normal(0, 0.1, (counts.size, WIDTH)), draw.normal(0, 0.1, (counts.size + 1, WIDTH)), np.ones((CONTEXT, WIDTH)), np.log(frequency / frequency.sum()))

    def parts(self) -> list[np.ndarray]:
        return [self.targets, self.inputs, self.mixing, self.bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    def refilled(self, flat: np.ndarray) -> Model:
        out, at = [], 0
        for p in self.parts():
            out.append(flat[at : at + p.size].reshape(p.shape).copy())
            at += p.size
        return Model(*out)

    def prediction(self, before: np.ndarray) -> np.ndarray:
        return sum(self.inputs[before[:, i]] * self.mixing[i] for i in range(CONTEXT))

    def log_normaliser(self, before: np.ndarray) -> np.ndarray:
        """Of each context, over all classes."""
        targets, bias = self.targets.T.astype(np.float32), self.bias.astype(np.float32)
        out = np.empty(len(before))
        for lo in range(0, len(before), 1024):
            scores = self.prediction(before[lo : lo + 1024]).astype(np.float32) @ targets + bias
            top = scores.max(axis=1, keepdims=True)
            out[lo : lo + 1024] = top[:, 0] + np.log(np.exp(scores - top).sum(axis=1, dtype=np.float64))
        return out


class Scorer:
    """Natural logs of each class given the classes before it; a context's normaliser is found once."""

    def __init__(self, model: Model):
        self.model, self.base = model, len(model.inputs)
        possible = self.base**CONTEXT
        self.known = np.full(possible, np.nan) if possible <= REMEMBERED else None

    def _normalisers(self, before: np.ndarray) -> np.ndarray:
        key = before[:, 0].astype(np.int64)
        for i in range(1, CONTEXT):
            key = key * self.base + before[:, i]
        if self.known is None:
            _, sample, seat = np.unique(key, return_index=True, return_inverse=True)
            return self.model.log_normaliser(before[sample])[seat]
        new = np.unique(key[np.isnan(self.known[key])])
        if len(new):
            places = [new // self.base**i % self.base for i in reversed(range(CONTEXT))]
            self.known[new] = self.model.log_normaliser(np.stack(places, axis=1))
        return self.known[key]

    def log_probability(self, before: np.ndarray, target: np.ndarray) -> np.ndarray:
        m = self.model
        return (m.prediction(before) * m.targets[target]).sum(axis=1) + m.bias[target] - self._normalisers(before)


class Trainer:
    """Noise-contrastive estimation with adaptive steps."""

    def __init__(self, model: Model, noise: np.ndarray, seed: int):
        self.model, self.draw = model, np.random.default_rng(seed)
        self.log_noise, self.cumulative = np.log(noise), np.cumsum(noise)
        self.squares = [np.full(p.shape, 1e-2) for p in model.parts()]

    def _move(self, part: int, gradient: np.ndarray) -> None:
        self.squares[part] += gradient * gradient
        values = self.model.parts()[part]
        values += STEP * gradient / np.sqrt(self.squares[part])

    @staticmethod
    def _gather(seats: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
        """Sums of rows by seat."""
        order = np.argsort(seats, kind="stable")
        ordered = seats[order]
        firsts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        out = np.zeros((n, rows.shape[1]))
        out[ordered[firsts]] = np.add.reduceat(rows[order], firsts, axis=0)
        return out

    def learn(self, before: np.ndarray, target: np.ndarray) -> None:
        m, n, size = self.model, len(target), len(self.log_noise)
        noise = np.minimum(np.searchsorted(self.cumulative, self.draw.random(NOISE) * self.cumulative[-1]), size - 1)
        near, own = [m.inputs[before[:, i]] for i in range(CONTEXT)], m.targets[target]
        q = sum(x * m.mixing[i] for i, x in enumerate(near))
        log_k = np.log(NOISE)
        real = np.einsum("ij,ij->i", q, own) + m.bias[target] - self.log_noise[target] - log_k
        fake = q @ m.targets[noise].T + (m.bias[noise] - self.log_noise[noise] - log_k)
        up = 1 / (1 + np.exp(np.clip(real, -30, 30))) / n
        down = -1 / (1 + np.exp(-np.clip(fake, -30, 30))) / n
        q_step = up[:, None] * own + down @ m.targets[noise]
        targets = self._gather(target, up[:, None] * q, size)
        np.add.at(targets, noise, down.T @ q)
        bias = np.bincount(target, weights=up, minlength=size)
        np.add.at(bias, noise, down.sum(axis=0))
        inputs = sum(self._gather(before[:, i], q_step * m.mixing[i], size + 1) for i in range(CONTEXT))
        mixing = np.stack([np.einsum("ij,ij->j", q_step, x) for x in near])
        for part, gradient in enumerate((targets, inputs, mixing, bias)):
            self._move(part, gradient)


class Opened:
    """A chunk's tokens: places in its vocabulary, each entry's class, and the documents' bounds."""

    def __init__(self, row: dict, counts: Counts):
        self.outside = counts.size
        self.codes = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["codes"]), "<u4")
        self.classes = counts.classes(np.frombuffer(row["vocabulary"], "<u8"), np.frombuffer(row["shapes"], np.uint8))
        self.bounds = np.frombuffer(row["bounds"], "<i8")
        self.held = np.array(row["held"], dtype=bool)

    def runs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(document, codes, classes, CONTEXT classes before, the nearest first) of RUN tokens at a time; `outside`
        stands for what is before a document."""
        for lo in range(0, len(self.codes), RUN):
            hi = min(lo + RUN, len(self.codes))
            first, end = np.searchsorted(self.bounds, (lo, hi - 1), side="right") - 1
            cuts = np.clip(self.bounds[first : end + 2], lo, hi)
            doc = np.repeat(np.arange(first, end + 1), np.diff(cuts))
            place = np.arange(lo, hi) - self.bounds[doc]
            reach = max(0, lo - CONTEXT)
            tokens = self.classes[self.codes[reach:hi]]
            before = np.full((hi - lo, CONTEXT), self.outside, dtype=tokens.dtype)
            for i in range(CONTEXT):
                far = np.flatnonzero(place > i)
                before[far, i] = tokens[far + (lo - reach) - i - 1]
            yield doc, self.codes[lo:hi], tokens[lo - reach :], before


def _most_frequent(once: DataFrame) -> np.ndarray:
    """(word, count, shape) of at most COMMON words: all of those above a count, which a small histogram gives."""
    level = F.when(F.col("c") < 4096, F.col("c")).otherwise((4096 + F.floor(F.log2("c") * 64)).cast("long"))
    least, room = None, COMMON
    for _, n, lowest in once.groupBy(level.alias("level")).agg(F.count("*"), F.min("c")).orderBy(F.desc("level")).collect():  # 8,192 at most
        if n > room:
            break
        least, room = lowest, room - n
    found = once.where(F.lit(False) if least is None else F.col("c") >= least).select("word", "c", F.col("shape").cast("long")).toArrow()
    rows = np.stack([c.to_numpy() for c in found.columns], axis=1).astype(np.int64).reshape(-1, 3)
    return rows[np.lexsort((rows[:, 0], -rows[:, 1]))]


def corpus_counts(chunks: DataFrame, top: int = TOP) -> tuple[Counts, DataFrame]:
    """The counts, and a table (chunk, place, c) of the words whose corpus-wide training count is neither among those of
    the common words nor the chunk's own."""
    totals = stored(_words_of(chunks).groupBy("word").agg(F.sum("n").alias("c"), F.min("shape").alias("shape"), F.count("*").alias("chunks")), "word-counts")
    once = totals.where("c > 0")
    rows = _most_frequent(once)
    tokens, distinct = once.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    shape_tokens, shape_distinct = np.zeros(SHAPES), np.zeros(SHAPES)
    for shape, c, n in once.groupBy("shape").agg(F.sum("c"), F.count("*")).collect():
        shape_tokens[shape], shape_distinct[shape] = c, n
    most = rows[:top]
    np.subtract.at(shape_tokens, most[:, 2], most[:, 1])
    np.subtract.at(shape_distinct, most[:, 2], 1)
    most, common = most[np.argsort(most[:, 0].copy().view(np.uint64))], rows[np.argsort(rows[:, 0].copy().view(np.uint64))]
    names, common_names = most[:, 0].copy().view(np.uint64), common[:, 0].copy().view(np.uint64)
    counts = Counts(int(tokens), int(distinct), names, most[:, 1].copy(), shape_tokens, shape_distinct, top + SHAPES, common_names, common[:, 1].copy())
    back = _words_of(chunks, common_names).select("chunk", "place", "word", "n").join(totals.where("chunks > 1").select("word", "c"), "word").where("c <> n").select("chunk", "place", "c")
    return counts, back


def _summed(trained: DataFrame, tasks: int) -> np.ndarray | None:
    """The mean of the tasks' parameters, weighted by tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, weight = None, 0.0
        for row in _rows(batches):
            flat = np.frombuffer(row["x"], "<f8")
            total, weight = flat * row["w"] if total is None else total + flat * row["w"], weight + row["w"]
        if weight:
            yield pa.RecordBatch.from_arrays([pa.array([(total / weight).tobytes()], pa.binary()), pa.array([weight])], names=["x", "w"])

    if tasks > FAN:
        trained = trained.repartition(FAN).mapInArrow(W.tidy(run), "x binary, w double")
    found = sorted((r.w, bytes(r.x)) for r in trained.collect())  # FAN at most
    weight = sum(w for w, _ in found)
    return sum(np.frombuffer(x, "<f8") * (w / weight) for w, x in found) if found else None


def train(chunks: DataFrame, counts: Counts, rounds: int = ROUNDS) -> Model:
    model = Model.start(counts)
    noise = counts.class_counts() + 0.5
    noise /= noise.sum()
    tasks = chunks.count()  # no more tasks than chunks have any
    for turn in range(rounds):
        sent = model

        def run(batches: Iterator[pa.RecordBatch], sent: Model = sent, turn: int = turn) -> Iterator[pa.RecordBatch]:
            trainer, seen = None, 0
            for row in _rows(batches):
                chunk = Opened(row, counts)
                trainer = trainer or Trainer(sent.refilled(sent.flat()), noise, 2 * row["chunk"] + turn)
                for doc, _, tokens, before in chunk.runs():
                    use = np.flatnonzero(~chunk.held[doc])
                    use = use[trainer.draw.permutation(len(use))]
                    for lo in range(0, len(use), BATCH):
                        some = use[lo : lo + BATCH]
                        trainer.learn(before[some], tokens[some])
                    seen += len(use)
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([trainer.model.flat().astype("<f8").tobytes()], pa.binary()), pa.array([float(seen)])], names=["x", "w"])

        flat = _summed(chunks.select("chunk", "held", "bounds", "codes", "vocabulary", "shapes").mapInArrow(W.tidy(run), "x binary, w double"), tasks)
        if flat is not None:
            model = model.refilled(flat)
    return model


_SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), *((n, pa.int64()) for n in ("n_tokens", "n_known", "train_tokens")), *((n, pa.float64()) for n in ("base_score", "score"))])


def _scored(model: Model, counts: Counts):
    scorers: list[Scorer] = []

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not scorers:
            scorers.append(Scorer(model))
        out = []
        for row in _rows(left.to_batches()):
            chunk = Opened(row, counts)
            n, docs = len(chunk.classes), len(chunk.bounds) - 1
            c = np.frombuffer(row["counts"], "<u4").astype(np.int64)
            c[right["place"].to_numpy()] = right["c"].to_numpy()
            often, seat = _among(counts.common, np.frombuffer(row["vocabulary"], "<u8"))
            c[often] = counts.common_counts[seat[often]]
            base = np.log10((c + 1) / (counts.tokens + counts.distinct + 1))
            shape = np.maximum(chunk.classes.astype(np.int64) - (counts.size - SHAPES), 0)
            within = np.where(chunk.classes < counts.size - SHAPES, 0.0, np.log10((c + 1) / (counts.shape_tokens[shape] + counts.shape_distinct[shape] + 1)))
            known, sums, plain = np.zeros(docs), np.zeros(docs), np.zeros(docs)
            for doc, codes, tokens, before in chunk.runs():
                first, own = doc[0], doc - doc[0]
                some = slice(first, first + own[-1] + 1)
                known[some] += np.bincount(own, weights=c[codes] > 0)
                plain[some] += np.bincount(own, weights=base[codes])
                sums[some] += np.bincount(own, weights=scorers[0].log_probability(before, tokens) / np.log(10) + within[codes])
            out.append(pa.table([pa.array(row["ids"], pa.int64()), pa.array(chunk.held), pa.array(np.diff(chunk.bounds)), pa.array(known.astype(np.int64)), pa.array(np.full(docs, counts.tokens)), pa.array(plain), pa.array(sums)], schema=_SCORES))
        return pa.concat_tables(out) if out else _SCORES.empty_table()

    return run


def chunked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The chunks of tokens, as a table of the shared folder."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), held_out(id_col).alias("held"))
    return stored(rows.mapInArrow(W.tidy(_chunks), _CHUNK), "chunks")


def _words_of(chunks: DataFrame, common: np.ndarray | None = None) -> DataFrame:
    return chunks.select("chunk", "vocabulary", "counts", "shapes").mapInArrow(W.tidy(_listed(common)), "chunk long, place int, word long, n long, shape int")


def scored(chunks: DataFrame, back: DataFrame, model: Model, counts: Counts) -> DataFrame:
    both = chunks.groupBy("chunk").cogroup(back.groupBy("chunk"))
    return both.applyInArrow(_scored(model, counts), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", top: int = TOP) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    chunks = chunked(docs, id_col, text_col)
    counts, back = corpus_counts(chunks, top)
    return scored(chunks, back, train(chunks, counts), counts)
