"""Filling fixed-capacity containers with documents along a space-filling curve.

Word counts of a document are hashed into a vector and projected to three dimensions; the quantised
point's Hilbert key gives a place on the curve. Documents are range-sorted by key, and each range is packed by
itself: a run of neighbours is placed largest first, each document into the fullest open container that
takes it. Containers that stay too empty at a range's end are dissolved, and their documents are packed
once more over wider ranges. A document is split only if it alone is larger than a container.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperweave.llm.tokens import VOCABULARY, token_lengths
from paperweave.plans.runtime import cut_lineage

DIMENSIONS, BITS, BUCKETS = 3, 10, 4096
WORD = re.compile(r"\w+")
ITEM = "key bigint, n_tokens bigint, place bigint"
PART = "container string, key bigint, part int, start_token bigint, n_tokens bigint, place bigint"


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of points with integer coordinates in [0, 2**bits), one row each.

    The transposed form of a key is made by undoing, from the highest bit down, the reflections and
    axis exchanges of the sub-cubes, followed by a Gray code over the axes.
    """
    x = points.astype(np.int64).T.copy()
    n = len(x)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        low = q - 1
        for i in range(n):
            upper = (x[i] & q) > 0
            swap = np.where(upper, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(upper, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        flip = np.where((x[n - 1] & q) > 0, flip ^ (q - 1), flip)
    x ^= flip
    keys = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            keys = (keys << 1) | ((x[i] >> b) & 1)
    return keys


class _Buckets(dict):
    """Word to bucket, hashed on first use."""

    def __missing__(self, word: str) -> int:
        self[word] = bucket = zlib.crc32(word.lower().encode()) % BUCKETS
        return bucket


def _points(texts: list[str], buckets: _Buckets, project: np.ndarray) -> np.ndarray:
    """Projected word vectors of the texts, of unit length before the projection; a text without words lies in the origin."""
    words: list[int] = []
    length = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        found = WORD.findall(text)
        words.extend(map(buckets.__getitem__, found))
        length[i] = len(found)
    points = np.zeros((len(texts), DIMENSIONS))
    if words:
        cells, counts = np.unique(np.repeat(np.arange(len(texts)) * BUCKETS, length) + np.asarray(words), return_counts=True)
        weights = np.log1p(counts)
        owner = cells // BUCKETS
        start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        moved = np.add.reduceat(weights[:, None] * project[cells % BUCKETS], start, axis=0)
        points[owner[start]] = moved / np.sqrt(np.add.reduceat(weights**2, start))[:, None]
    return points


def _measure(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        project = np.random.default_rng(20090706).choice([-1.0, 1.0], size=(BUCKETS, DIMENSIONS))
        buckets = _Buckets()
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            points = _points(texts, buckets, project)
            if len(buckets) > 500_000:
                buckets.clear()
            # coordinates are close to standard normal: the logistic curve spreads them evenly over the grid
            grid = np.minimum((1 / (1 + np.exp(-1.7 * points)) * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)
            yield pa.record_batch(
                {"key": batch.column(0), "n_tokens": pa.array(token_lengths(texts, vocabulary), pa.int64()), "place": pa.array(hilbert_keys(grid), pa.int64())}
            )

    return run


class _Shelf:
    """Open containers ordered by free room; at most ``most`` at a time."""

    def __init__(self, capacity: int, most: int, label: str) -> None:
        self.capacity, self.most, self.label, self.made = capacity, most, label, 0
        self.open: list[tuple[int, str]] = []
        self.held: dict[str, list[tuple]] = {}

    def new(self) -> str:
        self.made += 1
        return f"{self.label}-{self.made:07d}"

    def put(self, item: tuple) -> list[tuple]:
        """Place an item of a size up to the capacity; returns the rows of the container that this closes, if any."""
        size = item[3]
        at = bisect_left(self.open, (size, ""))
        if at < len(self.open):
            free, name = self.open.pop(at)
        else:
            free, name = self.capacity, self.new()
            self.held[name] = []
        self.held[name].append((name, *item))
        if free - size <= self.capacity // 200:
            return self.held.pop(name)
        insort(self.open, (free - size, name))
        return self.held.pop(self.open.pop(0)[1]) if len(self.open) > self.most else []


def _pack(capacity: int, label: str, run_length: int, most_open: int, keep_share: float):
    """keep_share: containers filled less than that at the end are handed on, with a null name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shelf = _Shelf(capacity, most_open, f"{label}-{TaskContext.get().partitionId():06d}")
        waiting: list[tuple] = []
        done: list[tuple] = []

        def place_run() -> None:
            for item in sorted(waiting, key=lambda x: (-x[3], x[0], x[1])):
                done.extend(shelf.put(item))
            waiting.clear()

        def rows() -> pa.RecordBatch:
            names, types = zip(*(p.split(" ") for p in PART.split(", ")))
            kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}
            made = pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*done), types)], names=list(names))
            done.clear()
            return made

        for batch in batches:
            for key, part, start, size, place in zip(*(c.to_pylist() for c in batch.columns)):
                while size > capacity:
                    done.append((shelf.new(), key, part, start, capacity, place))
                    part, start, size = part + 1, start + capacity, size - capacity
                waiting.append((key, part, start, size, place))
                if len(waiting) >= run_length:
                    place_run()
            if len(done) > 20_000:
                yield rows()
        place_run()
        for free, name in shelf.open:
            full = capacity - free >= keep_share * capacity
            done.extend(shelf.held[name] if full else [(None, *x[1:]) for x in shelf.held[name]])
        if done:
            yield rows()

    return run


def measure(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, n_tokens, place) of every document; kept in the checkpoint folder, as the texts are read once
    while the range sort reads the sizes twice."""
    return cut_lineage(documents.select(F.col(key).cast("bigint").alias("key"), text).mapInArrow(_measure(vocabulary), ITEM))


def pack(measured: DataFrame, capacity: int, label: str = "c", run_length: int = 512, most_open: int = 48, merge: int = 16) -> DataFrame:
    """One row (container, key, part, start_token, n_tokens) per document or, if it is larger than
    ``capacity``, per part of it.

    Documents of no tokens, null texts among them, are placed like the others; repeated rows are items of
    their own. Ties in place and size are broken by key. ``merge`` ranges are joined for the documents left over at a range's end: no more
    than ``most_open`` containers hold any, so these are few at any size. An empty table gives no rows.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    items = measured.select("key", F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("start_token"), "n_tokens", "place")
    sorted_by_place = items.repartitionByRange("place", "key").sortWithinPartitions("place", "key")
    first = cut_lineage(sorted_by_place.mapInArrow(_pack(capacity, f"{label}-a", run_length, most_open, 0.97), PART))
    left = first.where("container is null").drop("container")
    wider = max(1, first.rdd.getNumPartitions() // merge)
    again = left.repartitionByRange(wider, "place", "key").sortWithinPartitions("place", "key").mapInArrow(_pack(capacity, f"{label}-b", run_length, most_open, 0.0), PART)
    return first.where("container is not null").unionByName(again).drop("place")
