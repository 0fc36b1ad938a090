"""MinHash near-duplicates with sequential Bayesian verification.

1. One Arrow pass turns each text into its shingle set's size, a 128-bit digest of the set and a MinHash signature.
2. Equal sets form a class, which has a number; one text of its least id represents it. Only representatives go on.
3. Bands of the signature form buckets. A bucket's leader is the member whose own buckets are the fullest, so the
   hub of a group leads it. Each member is paired with its leaders only: rows grow with documents, not with pairs.
4. A pair's signatures are compared batch by batch. With m of n values equal and a flat prior on similarity J,
   P(J >= t | m, n) = P(Bin(n + 1, t) <= m); a pair is dropped as soon as that is below the miss probability.
5. Survivors are confirmed on the full shingle sets of both texts, and linked.
6. In buckets whose other members then lie in more than one component, those outside the bucket's largest component
   (the minority) are compared with all, in blocks of BLOCK members, and only across components. Blocks hold
   signatures alone; the shingle sets lie in files of the shared folder, and a survivor's are read from their place
   and confirmed at once, which joins its components. A pair is looked at in the first bucket it shares alone. Rows
   are copied as often as there are blocks in the minority, and links stay fewer than members.

A link that shares a bucket is thus either confirmed or lies within one component already, so components are those
of all links but for the chance of sharing no bucket (below 10 * MISS) or of being pruned (below MISS a look).

Nulls and texts without words: empty set, linked with nothing. Fewer words than a shingle: the whole sequence is
one. Equal rows are linked; the classes of all texts of an id are linked, a null id is returned unlinked with a null
component. An empty table gives an empty table. Other columns of the input are ignored.

A threshold for which MOST_BANDS bands can't keep the miss bound (below about 0.66) is an error, and so are
components that don't settle; nothing is dropped instead.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import words as W
from tessera.llm.components import components
from tessera.llm.store import fresh_path, is_small, stored

MISS = 1e-6
MOST_BANDS = 32
BATCH = 32
BLOCK = 1024
#: Bytes of shingle sets that a block keeps at hand.
SETS_BYTES = 48 << 20

_SETS = "id long, hash long, n_shingles long, h1 long, h2 long, signature binary"


@cache
def banding(percent: int) -> tuple[int, int]:
    """(bands, rows): the most rows with which a pair at the threshold shares no band with probability below 10 * MISS."""
    t = percent / 100
    for rows in range(8, 0, -1):
        for bands in range(1, MOST_BANDS + 1):
            if (1 - t**rows) ** bands < 10 * MISS:
                return bands, rows
    raise ValueError(f"a threshold of {percent} % needs more than {MOST_BANDS} bands")


@cache
def least_matches(percent: int, n: int) -> int:
    """The fewest of n equal values with which P(J >= t) is still at least MISS."""
    t, below = percent / 100, 0.0
    for m in range(n + 1):
        below += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if below >= MISS:
            return m
    return n


def survivors(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Of the row pairs of two signature matrices, those that no batch prunes."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), dtype=np.int32)
    for lo in range(0, a.shape[1], BATCH):
        hi = min(lo + BATCH, a.shape[1])
        matches = matches + (a[alive, lo:hi] == b[alive, lo:hi]).sum(axis=1, dtype=np.int32)
        keep = matches >= least_matches(percent, hi)
        alive, matches = alive[keep], matches[keep]
    return alive


def _sets_of(percent: int, width: int):
    bands, rows = banding(percent)
    n = bands * rows
    seeds = W.mix(np.arange(7, 7 + 2 * n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    add, times = seeds[:n], seeds[n:] | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, found, edges in W.shingles(batch.column(1), width):
                sizes = np.diff(edges)
                full = np.flatnonzero(sizes)
                signature = np.zeros((hi - lo, n), dtype=np.uint16)
                n_distinct, digests = W.digests(found, edges)
                if len(full):
                    at = edges[:-1][full]
                    for k in range(n):
                        signature[full, k] = np.minimum.reduceat((found ^ add[k]) * times[k] >> np.uint64(40), at) & np.uint64(0xFFFF)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo).cast(pa.int64()), batch.column(2).slice(lo, hi - lo), pa.array(n_distinct), pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array([row.tobytes() if k else None for row, k in zip(signature, sizes, strict=True)], pa.binary())],
                    names=["id", "hash", "n_shingles", "h1", "h2", "signature"],
                )

    return run


def shingle_signatures(texts: DataFrame, percent: int, width: int = 5) -> DataFrame:
    """texts (id, text, hash) to (id, hash, n_shingles, h1, h2, signature)."""
    return texts.mapInArrow(W.tidy(_sets_of(percent, width)), _SETS)


def _bands_of(percent: int):
    bands, rows = banding(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy()
            values = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint16).reshape(len(ids), bands, rows).astype(np.uint64)
            keys = np.zeros((len(ids), bands), dtype=np.uint64) + W.mix(np.arange(1, bands + 1, dtype=np.uint64))
            for k in range(rows):
                keys = W.mix(keys ^ (values[:, :, k] + np.uint64(k << 16)))
            keys = (keys & ~np.uint64(31)) + np.arange(bands, dtype=np.uint64)  # the band is in the low bits
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, bands)), pa.array(keys.ravel().view(np.int64))], names=["rep", "bucket"])

    return run


def _pruned(percent: int):
    n = banding(percent)[0] * banding(percent)[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint16).reshape(-1, n) for c in ("sa", "sb"))
                yield batch.select(["a", "b"]).take(pa.array(survivors(a, b, percent)))

    return run


def _exact(percent: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = W.shingle_sets(batch.column("ta"), width), W.shingle_sets(batch.column("tb"), width)
            keep = []
            for x, y in zip(left, right, strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both) and len(x) > 0)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _placed(folder: str, width: int):
    """Writes each task's shingle sets into one file: (rep, file, at, n), in 64-bit numbers. A file is whole when its
    task's rows are kept; one of a lost attempt is never named."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, stream, at = uuid.uuid4().hex, None, 0
        for batch in batches:
            if batch.num_rows and stream is None:
                files, base = pafs.FileSystem.from_uri(folder)
                files.create_dir(base, recursive=True)
                stream = files.open_output_stream(f"{base}/{name}")
            sizes = []
            for own in W.shingle_sets(batch.column("text"), width):
                stream.write(own.astype("<u8", copy=False).tobytes())
                sizes.append(len(own))
            ends = at + np.cumsum(sizes, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array([name] * len(sizes), pa.string()), pa.array(ends - sizes, pa.int64()), pa.array(sizes, pa.int64())], names=["rep", "file", "at", "n"])
            at = int(ends[-1]) if len(ends) else at
        if stream is not None:
            stream.close()

    return run


class Sets:
    """Shingle sets by their places in files; a bounded number of bytes stays at hand."""

    def __init__(self, folder: str):
        self.files, self.base = pafs.FileSystem.from_uri(folder)
        self.held: dict[tuple[str, int], np.ndarray] = {}
        self.size = 0

    def get(self, file: str, at: int, n: int) -> np.ndarray:
        if (file, at) not in self.held:
            if self.size > SETS_BYTES:
                self.held, self.size = {}, 0
            with self.files.open_input_file(f"{self.base}/{file}") as stream:
                self.held[file, at] = np.frombuffer(stream.read_at(8 * n, 8 * at), "<u8")
            self.size += 8 * n
        return self.held[file, at]


def _across(percent: int, folder: str):
    """Links over different components within one block, or between two; enough of them to join what they join."""
    bands, rows = banding(percent)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rep").reset_index(drop=True)
        sig = np.frombuffer(b"".join(group["signature"]), dtype=np.uint16).reshape(len(group), bands, rows)
        flat = sig.reshape(len(group), -1)
        rep, minor, block, file, at, n = (group[c].to_numpy() for c in ("rep", "minor", "block", "file", "at", "n"))
        _, comp = np.unique(group["comp"].to_numpy(), return_inverse=True)
        band = int(group["bucket"].iloc[0]) & 31
        sets = Sets(folder)
        if group["kind"].iloc[0]:
            left, right = np.flatnonzero(minor), np.flatnonzero(~minor)
        elif (block == block[0]).all():
            left = right = np.arange(len(group))
        else:
            left, right = np.flatnonzero(block == block[0]), np.flatnonzero(block != block[0])
        found = []
        for i in left.tolist():
            others = right[(comp[right] != comp[i]) & ((rep[right] > rep[i]) | (left is not right))]
            if not len(others):
                continue
            others = others[survivors(np.broadcast_to(flat[i], (len(others), bands * rows)), flat[others], percent)]
            others = others[(sig[others] == sig[i]).all(axis=2).argmax(axis=1) == band]
            for j in others[np.argsort(-(flat[others] == flat[i]).sum(axis=1), kind="stable")].tolist():
                if comp[i] != comp[j]:
                    a, b = (sets.get(file[k], int(at[k]), int(n[k])) for k in (i, j))
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    if 100 * both >= percent * (len(a) + len(b) - both):
                        found.append((rep[i], rep[j]))
                        comp[comp == comp[j]] = comp[i]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return run


def texts_of(reps: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """(rep, text) of the classes in reps (distinct, one column rep). An id may have several texts; the hash tells which."""
    keys = stored(reps.join(classes, "rep").select("rep", "first.id", "first.hash"), "needed")
    return texts.join(F.broadcast(keys) if is_small(keys) else keys, ["id", "hash"]).groupBy("rep").agg(F.max("text").alias("text"))


def confirmed(pairs: DataFrame, classes: DataFrame, texts: DataFrame, percent: int, width: int = 5) -> DataFrame:
    """Of pairs (a, b) of classes, those whose full shingle sets are similar."""
    own = stored(texts_of(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), classes, texts), "texts")
    joined = pairs.join(own.select(F.col("rep").alias("a"), F.col("text").alias("ta")), "a").join(own.select(F.col("rep").alias("b"), F.col("text").alias("tb")), "b")
    return joined.select("a", "b", "ta", "tb").mapInArrow(W.tidy(_exact(percent, width)), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, width: int = 5) -> DataFrame:
    """One row per row of docs: id_col, n_shingles, component_id, kept. Links: 100 * |intersection| >= percent * |union|."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("hash", F.xxhash64("text"))
    sets = stored(shingle_signatures(texts, percent, width), "signatures")
    full = sets.where("n_shingles > 0 and id is not null")
    classes = stored(full.groupBy("h1", "h2").agg(F.min(F.struct("id", "hash")).alias("first")).withColumn("rep", F.monotonically_increasing_id()), "classes")
    reps = stored(full.join(classes, ["h1", "h2"]).where("id = first.id").groupBy("rep").agg(F.max("signature").alias("signature")), "reps")

    banded = reps.mapInArrow(W.tidy(_bands_of(percent)), "rep long, bucket long")
    shared = banded.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = stored(banded.join(shared, "bucket"), "members")
    weights = members.groupBy("rep").agg(F.sum("n").alias("weight"))
    leaders = members.join(weights, "rep").groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("rep")).alias("minus"))).alias("top")).select("bucket", (-F.col("top.minus")).alias("leader"))
    leaders = stored(leaders, "leaders")
    pairs = members.join(leaders, "bucket").where("rep <> leader").select(F.least("rep", "leader").alias("a"), F.greatest("rep", "leader").alias("b")).distinct()
    signed = pairs.join(reps.select(F.col("rep").alias("a"), F.col("signature").alias("sa")), "a").join(reps.select(F.col("rep").alias("b"), F.col("signature").alias("sb")), "b")
    tried = stored(signed.select("a", "b", "sa", "sb").mapInArrow(W.tidy(_pruned(percent)), "a long, b long"), "survivors")
    # rows that share an id may stand in different classes; the least of them is linked with each other one
    places = full.join(classes, ["h1", "h2"]).select("id", "rep")
    spread = places.groupBy("id").agg(F.min("rep").alias("b"), F.max("rep").alias("a")).where("a <> b").select("id", "b")
    doubled = places.join(stored(spread, "spread"), "id").where("rep <> b").select(F.col("rep").alias("a"), "b").distinct()
    links = stored(confirmed(tried, classes, texts, percent, width).unionByName(doubled), "links")

    rooted = components(links)
    rest = members.where("n > 2").join(leaders, "bucket").where("rep <> leader").join(rooted.withColumnRenamed("node", "rep"), "rep", "left")
    rest = stored(rest.select("bucket", "rep", F.coalesce("root", "rep").alias("comp")), "rest")
    per_comp = rest.groupBy("bucket", "comp").agg(F.count("*").alias("n"))
    mixed = per_comp.groupBy("bucket").agg(F.max(F.struct("n", "comp")).alias("major"), F.sum("n").alias("n")).where("major.n < n")
    share = mixed.select("bucket", F.col("major.comp").alias("major"), F.ceil(F.col("major.n") / BLOCK).cast("int").alias("majors"), F.ceil((F.col("n") - F.col("major.n")) / BLOCK).cast("int").alias("minors"))
    share = stored(share, "mixed")  # not kept in the buckets' partitioning, so that a common bucket's rows can be split
    minor, block, zero = F.col("comp") != F.col("major"), F.col("block"), F.lit(0)
    to_majors = F.transform(F.sequence(zero, F.col("majors") - 1), lambda j: F.struct(F.lit(1).alias("kind"), block.alias("i"), j.alias("j")))
    to_minors = F.transform(F.sequence(zero, F.col("minors") - 1), lambda j: F.struct(F.lit(0).alias("kind"), F.least(block, j).alias("i"), F.greatest(block, j).alias("j")))
    from_major = F.transform(F.sequence(zero, F.col("minors") - 1), lambda i: F.struct(F.lit(1).alias("kind"), i.alias("i"), block.alias("j")))
    dealt = (
        rest.join(share, "bucket")
        .withColumn("minor", minor)
        .withColumn("block", F.pmod(F.xxhash64("rep", "bucket"), F.when(F.col("minor"), F.col("minors")).otherwise(F.col("majors"))).cast("int"))
        .withColumn("to", F.explode(F.when(F.col("minor"), F.concat(to_majors, to_minors)).otherwise(from_major)))
        .select("bucket", "to.kind", "to.i", "to.j", "rep", "comp", "minor", "block")
    )
    dealt = stored(dealt, "dealt")
    folder = fresh_path(docs.sparkSession, "sets")
    places = texts_of(dealt.select("rep").distinct(), classes, texts).mapInArrow(W.tidy(_placed(folder, width)), "rep long, file string, at long, n long")
    own = stored(places.join(reps, "rep"), "compared")
    across = dealt.join(own, "rep").groupBy("bucket", "kind", "i", "j").applyInPandas(_across(percent, folder), "a long, b long")
    links = stored(links.unionByName(across), "links")
    rooted = components(links)

    least = rooted.withColumnRenamed("node", "rep").join(classes.select("rep", "first.id"), "rep")
    least = least.join(least.groupBy("root").agg(F.min("id").alias("least")), "root").select("rep", "least")
    # rows without a class stay aside: as keys of a join they would all be one
    linked = full.join(classes, ["h1", "h2"]).select("id", "n_shingles", "rep", F.col("first.id").alias("own")).join(least, "rep", "left")
    placed = linked.select("id", "n_shingles", F.coalesce("least", "own").alias("component_id"))
    alone = sets.where("n_shingles = 0 or id is null").select("id", "n_shingles", F.col("id").alias("component_id"))
    return placed.unionByName(alone).select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("component_id") == F.col("id"), F.lit(True)).alias("kept"))
