"""Exact and near duplicates by sets of character pairs, the earlier row kept.

Near means a Jaccard similarity of at least ``threshold``. The join is exact. Rows of one size class can differ in so many
pairs at most; all pairs are dealt to one part more than that by their hash, so near rows have at least one part that is
equal, and meet by its hash. Sketches of parity, whose distance never exceeds that of the sets, leave few candidates, and
every candidate is verified on its sets. Which rows stay is decided greedily in order of ids: a row goes if an earlier row
that stays is near it. That is no connected component: of a chain A-B-C, A and C stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirgate.functions.text import norm_text
from weirgate.sources.tables import durable

#: Fixed value: the similarity from which rows are near duplicates.
THRESHOLD = 0.92
_SLACK = 1e-9
#: Rows up to which a side of a join is sent to all executors; growth of size classes; words of a sketch, of
#: a fine one; characters and records handled at once; least number of buckets in which records meet.
FEW, RATIO, WORDS, FINE, CHARS, RECORDS, BUCKETS = 300_000, 1.25, 3, 64, 400_000, 400_000, 256
RECORD = np.dtype([("part", "<u4"), ("n", "<u4"), ("id", "<i8"), ("sketch", "<u8", (WORDS,))])
_LONE = np.uint64(1 << 63)


def _hash(text: Column) -> Column:
    return F.unhex(F.sha1(text.cast("binary")))


def _normed(rows: DataFrame) -> DataFrame:
    return rows.select("id", norm_text(F.coalesce("text", F.lit(""))).alias("norm"))


def exact_duplicates(rows: DataFrame) -> DataFrame:
    """id, hash, first_id: the first row with the same normalised text. ``rows``: id, text. A null text reads as empty.

    Texts are not shuffled, only their hashes.
    """
    hashed = _normed(rows).select("id", _hash(F.col("norm")).alias("hash"))
    first = hashed.groupBy("hash").agg(F.min("id").alias("first_id"))  # combined before the shuffle, also for a hot text
    return hashed.join(first, "hash").select("id", "hash", "first_id")


def _sent(rows: DataFrame) -> DataFrame:
    """Rows that have been counted, marked to be sent to all executors where they are few."""
    return F.broadcast(rows) if rows.count() <= FEW else rows


def first_rows(rows: DataFrame, exact: DataFrame) -> DataFrame:
    """id, norm of the first row of each text. ``exact``: what ``exact_duplicates`` gives for ``rows``."""
    later = durable(exact.where("id <> first_id").select("id", "hash").distinct())
    return _normed(rows).where("id is not null").withColumn("hash", _hash(F.col("norm"))).join(_sent(later), ["id", "hash"], "left_anti").select("id", "norm")


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: one to one on 64 bits."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of each text as sorted distinct numbers, text after text, and how many each has. As ``bigrams``."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    pairs = _mixed(codes[:-1] << np.uint64(32) | codes[1:])
    out, at = [], 0
    for length in map(len, texts):
        if length < 2:
            one = _mixed(codes[at : at + 1] | _LONE) if length else _mixed(np.array([~np.uint64(0)]))
        else:
            one = np.sort(pairs[at : at + length - 1])
            one = one[np.concatenate(([True], one[1:] != one[:-1]))]
        out.append(one)
        at += length
    return np.concatenate(out), np.array([len(s) for s in out], np.int64)


def _classes(threshold: float) -> Iterator[tuple[int, int, int]]:
    """Size classes: least size, least size beyond, parts. Near rows of which the smaller is in the class, or has its
    sizes, differ in fewer pairs than there are parts."""
    share = (1 - threshold) / threshold
    low, high = 1, 1 << 40 if share <= 0 else max(2, int(np.ceil(1 / share)))
    while low < 1 << 40:
        yield low, high, int((high - 1) * share + 1e-6) + 1
        low, high = high, max(high + 1, int(high * RATIO))


def _parts(tokens: np.ndarray, sizes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every part of every row, in the classes in which the row may meet a near one."""
    hashes, rows, values = [], [], _mixed(tokens)
    for k, (low, high, parts) in enumerate(_classes(threshold)):
        if low > sizes.max():
            break
        here = (sizes >= low) & (sizes * threshold - _SLACK <= high - 1)
        if not here.any():
            continue
        own, number = np.repeat(here, sizes), int(here.sum())
        part = (tokens[own] >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
        slots = np.repeat(np.arange(number) * parts, sizes[here]) + part.astype(np.int64)
        ends = np.concatenate(([0], np.cumsum(np.bincount(slots, minlength=number * parts))))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values[own])))
        place = np.tile(np.arange(parts, dtype=np.uint64), number) | np.uint64(k + 1 << 40)
        hashes.append(_mixed(total[ends[1:]] - total[ends[:-1]] ^ _mixed(place)))
        rows.append(np.repeat(np.flatnonzero(here), parts))
    return np.concatenate(hashes), np.concatenate(rows)


def _sketches(tokens: np.ndarray, sizes: np.ndarray, words: int) -> np.ndarray:
    """For each row bits that tell how many of its pairs fall on them, odd or even."""
    h = _mixed(tokens ^ np.uint64(0x5851F42D4C957F2D))
    out = np.zeros((len(sizes), words), np.uint64)
    row, word = np.repeat(np.arange(len(sizes)), sizes), ((h >> np.uint64(32)) % np.uint64(words)).astype(np.int64)
    np.bitwise_xor.at(out, (row, word), np.uint64(1) << (h & np.uint64(63)))
    return out


def _slices(texts: list[str]) -> Iterator[slice]:
    start = size = 0
    for k, t in enumerate(texts):
        if size + len(t) > CHARS and k > start:
            yield slice(start, k)
            start, size = k, 0
        size += len(t)
    if texts:
        yield slice(start, len(texts))


def _records(threshold: float, buckets: int):
    """Rows (id, norm) as records of their parts, packed by bucket."""

    def packed(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        bucket, record = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(bucket, kind="stable")
        bucket, record = bucket[order], record[order]
        starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        blobs = [record[a:b].tobytes() for a, b in zip(starts, [*starts[1:], len(record)])]
        return pa.record_batch([pa.array(bucket[starts].astype(np.int32)), pa.array(blobs, pa.binary())], names=["bucket", "records"])

    def run(batches):
        held, count = [], 0
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            for s in _slices(texts):
                tokens, sizes = _sets(texts[s])
                hashes, rows = _parts(tokens, sizes, threshold)
                record = np.empty(len(hashes), RECORD)
                record["part"], record["n"], record["id"] = hashes & np.uint64(0xFFFFFFFF), sizes[rows], ids[s][rows]
                record["sketch"] = _sketches(tokens, sizes, WORDS)[rows]
                held.append(((hashes >> np.uint64(32)) % np.uint64(buckets), record))
                count += len(record)
                if count >= RECORDS:
                    yield packed(held)
                    held, count = [], 0
        if held:
            yield packed(held)

    return run


def _meeting(threshold: float):
    """Pairs of the records of a bucket with an equal part whose sizes and sketches allow them to be near."""

    def run(table: pa.Table) -> pa.Table:
        record = np.concatenate([np.frombuffer(b, RECORD) for b in table.column("records").to_pylist()])
        record = record[np.lexsort((record["n"], record["part"]))]
        part, n, ids, sketch = record["part"], record["n"].astype(np.int64), record["id"], record["sketch"]
        found, held, at, away = [np.empty((0, 2), np.int64)], 0, np.arange(len(record)), 0
        while len(at):
            away += 1
            at = at[at + away < len(record)]
            # sizes rise within a part: a record whose next one is too large meets no later one
            at = at[(part[at] == part[at + away]) & (n[at] >= threshold * n[at + away] - _SLACK)]
            least = np.bitwise_count(sketch[at] ^ sketch[at + away]).sum(axis=1)
            near = at[(least <= (n[at] + n[at + away]) * ((1 - threshold) / (1 + threshold)) + 1e-6) & (ids[at] != ids[at + away])]
            if len(near):
                found.append(np.sort(np.stack((ids[near], ids[near + away]), axis=1), axis=1))
                held += len(near)
            if held > 1 << 20:
                found = [np.unique(np.concatenate(found), axis=0)]
                held = 0
        pairs = np.unique(np.concatenate(found), axis=0)
        return pa.table({"id_a": pairs[:, 0], "id_b": pairs[:, 1]})

    return run


def _kept_sets(batches):
    """Rows (id, norm) as id, size, a sketch of FINE words, and the pairs as sorted numbers."""
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        for s in _slices(texts):
            tokens, sizes = _sets(texts[s])
            ends = np.cumsum(sizes)
            fine = [x.tobytes() for x in _sketches(tokens, sizes, FINE)]
            packed = [tokens[e - n : e].tobytes() for e, n in zip(ends, sizes)]
            yield pa.record_batch([ids[s.start : s.stop], pa.array(sizes), pa.array(fine, pa.binary()), pa.array(packed, pa.binary())], names=["id", "n", "fine", "tokens"])


def _allowed(threshold: float):
    """Pairs whose fine sketches allow them to be near."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(f"fine_{s}").to_pylist()), np.uint64).reshape(-1, FINE) for s in "ab")
                total = sum(batch.column(f"n_{s}").to_numpy(zero_copy_only=False) for s in "ab")
                near = np.bitwise_count(a ^ b).sum(axis=1) <= total * ((1 - threshold) / (1 + threshold)) + 1e-6
                yield batch.select(["id_a", "id_b"]).filter(pa.array(near))

    return run


def _verified(batches):
    """Pairs with their similarity, from the sets themselves."""
    for batch in batches:
        out = []
        for x, y in zip(batch.column("tokens_a").to_pylist(), batch.column("tokens_b").to_pylist()):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            shared = len(x) + len(y) - len(np.union1d(x, y))
            out.append(shared / (len(x) + len(y) - shared))
        yield pa.record_batch([batch.column("id_a"), batch.column("id_b"), pa.array(out, pa.float64())], names=["id_a", "id_b", "similarity"])


def near_pairs(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """id_a, id_b (id_a < id_b), similarity of near rows. ``rows``: id (a whole number), norm, all texts different."""
    spark = rows.sparkSession
    rows = rows.select(F.col("id").cast("long"), "norm")
    buckets = max(BUCKETS, 8 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    records = rows.mapInArrow(_records(threshold, buckets), "bucket int, records binary")
    pairs = durable(records.groupBy("bucket").applyInArrow(_meeting(threshold), "id_a long, id_b long").distinct())
    ids = durable(pairs.select(F.explode(F.array("id_a", "id_b")).alias("id")).distinct())
    sets = durable(rows.join(_sent(ids), "id", "left_semi").mapInArrow(_kept_sets, "id long, n long, fine binary, tokens binary").dropDuplicates(["id"]))

    def joined(pairs: DataFrame, *cols: str) -> DataFrame:
        for s in "ab":
            pairs = pairs.join(sets.select(F.col("id").alias(f"id_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in cols]), f"id_{s}")
        return pairs

    close = joined(pairs, "n", "fine").mapInArrow(_allowed(threshold), "id_a long, id_b long")
    both = joined(close, "tokens").mapInArrow(_verified, "id_a long, id_b long, similarity double")
    return both.where(F.col("similarity") >= F.lit(threshold))


def greedy_drops(pairs: DataFrame) -> DataFrame:
    """id of every row that is near an earlier row that stays. Each round decides all rows whose earlier ones are decided."""
    undecided = durable(pairs.select("id_a", "id_b"))
    drops = None
    while not undecided.isEmpty():
        later = undecided.select(F.col("id_b").alias("id")).distinct()
        stays = undecided.select(F.col("id_a").alias("id")).distinct().join(later, "id", "left_anti")
        gone = durable(undecided.join(stays.withColumnRenamed("id", "id_a"), "id_a", "left_semi").select(F.col("id_b").alias("id")).distinct())
        drops = gone if drops is None else drops.unionByName(gone)
        left = undecided.join(stays.withColumnRenamed("id", "id_a"), "id_a", "left_anti")
        left = left.join(gone.withColumnRenamed("id", "id_b"), "id_b", "left_anti").join(gone.withColumnRenamed("id", "id_a"), "id_a", "left_anti")
        undecided = durable(left.select("id_a", "id_b"))
    return drops if drops is not None else pairs.select(F.col("id_b").alias("id")).limit(0)


def dedupe(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """id, verdict of all rows: ``kept``, ``exact_dup`` or ``near_dup``. ``rows``: id, text."""
    exact = durable(exact_duplicates(rows))
    drops = greedy_drops(near_pairs(first_rows(rows, exact), threshold)).distinct().withColumn("near", F.lit(True))
    return exact.join(drops, "id", "left").select("id", F.when(F.col("id") != F.col("first_id"), "exact_dup").when(F.col("near"), "near_dup").otherwise("kept").alias("verdict"))


def streaming_distinct(stream: DataFrame, time: str, late: str) -> DataFrame:
    """Exact duplicates dropped from a stream while its watermark holds their first row."""
    hashed = stream.withColumn("norm_hash", F.sha1(norm_text(F.coalesce("text", F.lit(""))).cast("binary")))
    return hashed.withWatermark(time, late).dropDuplicatesWithinWatermark(["norm_hash"])
