"""Subject areas of documents by one-versus-rest linear classifiers on hashed word n-grams.

The classifiers are fitted on all documents with weak labels (one or two subjects a reader gave, some of them wrong, seldom all): these are dealt
by hash to shards of some SHARD documents, each is fitted in a task, and the weights are averaged; n-grams are counted over all shards. A first fit on whole documents assigns each of their sentences to one of the subjects
that its document is labelled with or clearly shows; the second fit is on those sentences. A document's
composition is the mixture of subjects under which its sentences are most probable, and it is about the subjects whose share
reaches a threshold. That is calibrated on the labels: readers name a second subject now and then, but a passing mention hardly ever, so the rate of
named ones among the lesser subjects of labelled documents, by their share, has a step. Among its likely places the threshold is the one at which the shares of all documents are rarest.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperweave.plans.runtime import cut_lineage

BITS = 18
WORD = re.compile(r"[^\W\d_]{2,}")
SENTENCE = re.compile(r"(?<=[.!?:;])\s+|\n+")
SHORTEST = 4
#: Labelled documents that a task fits, and characters of their texts.
SHARD, SHARD_CHARS = 20_000, 40_000_000
OUT = "doc_id bigint, subject string, share double, foremost boolean"


def sentence_features(texts: list[str | None], ids: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed words and word pairs of all sentences one after the other, the place where each sentence begins, and the text it is of.

    ``ids`` keeps the hashes of words from call to call. Sentences of fewer than SHORTEST n-grams say nothing and are left out.
    """
    words: list[int] = []
    lengths: list[int] = []
    owners: list[int] = []
    for i, text in enumerate(texts):
        for sentence in SENTENCE.split(text.lower()) if text else ():
            found = WORD.findall(sentence)
            if 2 * len(found) - 1 >= SHORTEST:
                for w in found:
                    if w not in ids:
                        ids[w] = zlib.crc32(w.encode())
                words.extend([ids[w] for w in found])
                lengths.append(len(found))
                owners.append(i)
    if len(ids) > 500_000:
        ids.clear()
    n = np.asarray(lengths, np.int64)
    ends = np.cumsum(n)
    single = np.asarray(words, np.int64)
    pairs = single[:-1] * 1_000_003 + single[1:] if len(single) else single
    inner = np.ones(max(len(single) - 1, 0), bool)
    inner[ends[:-1] - 1] = False
    # words and pairs of a sentence side by side: 2n - 1 features for n words
    place_single = np.arange(len(single)) * 2 - np.repeat(np.arange(len(n)), n)
    features = np.empty(2 * len(single) - len(n), np.int64)
    features[place_single] = single
    features[place_single[:-1][inner] + 1] = pairs[inner]
    begins = np.concatenate([[0], np.cumsum(2 * n - 1)[:-1]]) if len(n) else np.zeros(0, np.int64)
    return features & ((1 << BITS) - 1), begins, np.asarray(owners, np.int64)


def scores(weights: np.ndarray, features: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Log-odds of every subject for every sentence."""
    if not len(begins):
        return np.zeros((0, weights.shape[1]), np.float32)
    n = np.diff(np.append(begins, len(features)))
    return np.add.reduceat(weights[features], begins, axis=0) / np.sqrt(n)[:, None].astype(np.float32)


def mixtures(z: np.ndarray, owners: np.ndarray, n_texts: int, rounds: int = 15) -> np.ndarray:
    """Shares of the subjects in each text, by expectation maximisation over its sentences; zero for a text without sentences."""
    k = z.shape[1]
    p = np.exp(z - z.max(axis=1, keepdims=True)) if len(z) else z
    p /= p.sum(axis=1, keepdims=True)
    count = np.bincount(owners, minlength=n_texts)
    shares = np.full((n_texts, k), 1 / k)
    held = np.flatnonzero(count)
    starts = np.concatenate([[0], np.cumsum(count[held])[:-1]]) if len(held) else held
    for _ in range(rounds if len(held) else 0):
        r = shares[owners] * p
        r /= r.sum(axis=1, keepdims=True)
        shares[held] = np.add.reduceat(r, starts, axis=0) / count[held, None]
    shares[count == 0] = 0
    return shares


def _held(features: list[np.ndarray]) -> np.ndarray:
    """In how many rows each n-gram is."""
    return np.bincount(np.concatenate([np.zeros(0, np.int64), *(np.unique(f) for f in features)]), minlength=1 << BITS)


def _fit(features: list[np.ndarray], targets: np.ndarray, epochs: int, common: np.ndarray, seed: int = 7, rate: float = 0.5) -> np.ndarray:
    """One-versus-rest logistic regression by adaptive stochastic gradient steps; a fixed seed fixes the order.
    N-grams that are not marked as ``common`` get no weight."""
    k = targets.shape[1]
    weights, squares = np.zeros((1 << BITS, k)), np.full(1 << BITS, 1e-2)
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(features)):
            f = features[i]
            s = 1 / np.sqrt(len(f))
            z = weights[f].sum(axis=0) * s - 1.0
            gradient = 1 / (1 + np.exp(-z)) - targets[i]
            squares[f] += (gradient @ gradient) * s * s
            weights[f] -= (common[f] * rate * s / np.sqrt(squares[f]))[:, None] * gradient
    return weights


@dataclass
class Model:
    subjects: list[str]
    weights: np.ndarray


def likely_steps(seen: np.ndarray, named: np.ndarray, within: float = 10.0) -> np.ndarray:
    """Marks the bins of a histogram at whose lower end the rate of ``named`` among ``seen`` may step from a lower to a higher one: those whose log-likelihood is
    ``within`` of the greatest; all, where the labels show no step."""
    below, hits = np.cumsum(seen) - seen, np.cumsum(named) - named
    above, rest = seen.sum() - below, named.sum() - hits

    def likelihood(n: np.ndarray, k: np.ndarray) -> np.ndarray:
        rate = (k + 0.5) / (n + 1)
        return k * np.log(rate) + (n - k) * np.log(1 - rate)

    fits = np.where((rest + 0.5) / (above + 1) > (hits + 0.5) / (below + 1), likelihood(below, hits) + likelihood(above, rest), -np.inf)
    return fits >= fits.max() - within if np.isfinite(fits).any() else np.ones(len(seen), bool)


def gap(counts: np.ndarray, among: np.ndarray) -> float:
    """The emptiest place, of the bins ``among``, in a histogram of the shares from 0 to 0.5 that are not the foremost of their
    document: the middle of the first run of bins that are as empty as the emptiest, but for chance."""
    smooth = np.convolve(counts, np.ones(5) / 5, mode="same")
    least = smooth[among].min()
    empty = np.flatnonzero(among & (smooth <= least + 2 * np.sqrt(least)))
    run = empty[: int(np.argmax(np.append(np.diff(empty), 2) > 1)) + 1]
    return float((run.mean() + 0.5) / len(counts) / 2)


class _Shard:
    """Documents with their labels, in the order of their ids, for both fits. ``budget`` bounds the gradient steps of the first one, and three times it those of the second, but every row is taken
    twice in the first, and once in the second, at least."""

    def __init__(self, texts: list[str | None], labels: list[list[str]], subjects: list[str], budget: int = 60_000) -> None:
        place = {s: i for i, s in enumerate(subjects)}
        self.budget = budget
        self.features, self.begins, self.owners = sentence_features(texts, {})
        self.ends = np.append(self.begins[1:], len(self.features))
        self.given = np.zeros((len(texts), len(subjects)))
        for i, own in enumerate(labels):
            for s in own:
                if s in place:
                    self.given[i, place[s]] = 1

    def whole(self) -> tuple[list[np.ndarray], np.ndarray]:
        """Rows of the first fit: documents."""
        usable = [i for i in np.unique(self.owners) if self.given[i].any()]
        first, last = np.searchsorted(self.owners, usable, "left"), np.searchsorted(self.owners, usable, "right")
        given = self.given[usable]
        return [np.unique(self.features[self.begins[a] : self.ends[b - 1]]) for a, b in zip(first, last)], given / given.sum(axis=1, keepdims=True) if usable else given

    def parts(self, rough: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Rows of the second fit: sentences that the weights of the first assign to a subject."""
        owners, given = self.owners, self.given
        k = given.shape[1]
        z = scores(rough, self.features, self.begins)
        if not len(z):
            return [], np.zeros((0, k))
        top = np.partition(z, -2, axis=1) if k > 1 else np.c_[np.full(len(z), -np.inf), z]
        clear = (top[:, -1] - top[:, -2]) > 1.5
        shown = np.zeros(given.shape)
        np.add.at(shown, (owners[clear], z.argmax(axis=1)[clear]), 1)
        allowed = (given > 0) | (shown >= 3)
        inside = np.where(allowed[owners], z, -99.0)
        best = np.partition(inside, -2, axis=1) if k > 1 else np.c_[np.full(len(z), -np.inf), inside]
        taken = np.flatnonzero(allowed[owners].any(axis=1) & given[owners].any(axis=1) & ((allowed[owners].sum(axis=1) == 1) | (best[:, -1] - best[:, -2] > 0.5)))
        return [self.features[self.begins[i] : self.ends[i]] for i in taken], np.eye(k)[inside.argmax(axis=1)[taken]]

    def first_fit(self, held: np.ndarray | None = None, seen: int = 2) -> np.ndarray:
        """Weights of the first fit. ``held`` tells in how many rows of all shards each n-gram is, if there are others; those in fewer than ``seen`` get no weight."""
        rows, targets = self.whole()
        return _fit(rows, targets, max(2, min(15, self.budget // max(1, len(rows)))), (_held(rows) if held is None else held) >= seen)

    def second_fit(self, rough: np.ndarray, held: np.ndarray | None = None, seen: int = 2) -> np.ndarray:
        rows, targets = self.parts(rough)
        return _fit(rows, targets, max(1, min(6, 3 * self.budget // max(1, len(rows)))), (_held(rows) if held is None else held) >= seen)


def _on_shards(subjects: list[str], step):
    """Rows (feature, x0, x1, ...) of what ``step`` makes of each shard, a row of numbers for every n-gram; rows of zeros are left out.
    Rows (shard, doc_id, text, own) come sorted, and a shard in one task."""

    def made(rows: list[tuple]) -> pa.RecordBatch:
        found = step(_Shard([r[2] for r in rows], [r[3] for r in rows], subjects)).reshape(1 << BITS, -1).astype(float)
        held = np.flatnonzero(found.any(axis=1))
        return pa.record_batch({"feature": pa.array(held.astype(np.int32)), **{f"x{i}": pa.array(column) for i, column in enumerate(found[held].T)}})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if rest and rest[0][0] != row[0]:
                    yield made(rest)
                    rest = []
                rest.append(row)
        if rest:
            yield made(rest)

    return run


def _over_shards(shards: DataFrame, subjects: list[str], width: int, step, mean: bool) -> np.ndarray:
    """The sums over all shards of what ``step`` makes of each, or the means over the shards that hold the n-gram."""
    names = [f"x{i}" for i in range(width)]
    made = shards.mapInArrow(_on_shards(subjects, step), "feature int, " + ", ".join(f"{x} double" for x in names))
    total = made.groupBy("feature").agg(*((F.avg(x) if mean else F.sum(x)).alias(x) for x in names)).toArrow()
    found = np.zeros((1 << BITS, width))
    # rounded, so that the order of the shards makes no difference
    found[total.column("feature").to_numpy()] = np.stack([total.column(x).to_numpy() for x in names], axis=1).round(9)
    return found


def _compose(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: dict[str, int] = {}
        for batch in batches:
            texts = batch.column(1).to_pylist()
            features, begins, owners = sentence_features(texts, ids)
            shares = mixtures(scores(model.weights, features, begins), owners, len(texts))
            foremost = (shares == shares.max(axis=1, keepdims=True)) & (shares > 0)
            rows, columns = np.nonzero(shares > 0.01)
            yield pa.record_batch(
                {
                    "doc_id": batch.column(0).take(pa.array(rows)),
                    "subject": pa.array([model.subjects[c] for c in columns], pa.string()),
                    "share": pa.array(shares[rows, columns], pa.float64()),
                    "foremost": pa.array(foremost[rows, columns], pa.bool_()),
                }
            )

    return run


def sampled(labels: DataFrame) -> DataFrame:
    """(doc_id, own): the labels of every labelled document; rows with a null id or label are ignored."""
    return labels.where("doc_id is not null and subject is not null").groupBy("doc_id").agg(F.sort_array(F.collect_set("subject")).alias("own"))


def train(documents: DataFrame, sample: DataFrame, subjects: DataFrame, shard: int = SHARD) -> Model:
    """Fitted on all documents of ``sample``, in shards of some ``shard`` documents."""
    names = [r.subject for r in subjects.where("subject is not null").select("subject").distinct().orderBy("subject").collect()]
    if not names:
        return Model(names, np.zeros((1 << BITS, 0), np.float32))
    rows = cut_lineage(documents.select("doc_id", "text").join(sample, "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "text", "own"))
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    n = max(1, -(-size.n // shard), -(-size.chars // SHARD_CHARS))
    shards = rows.select(F.pmod(F.xxhash64("doc_id"), F.lit(n)).alias("shard"), "doc_id", "text", "own").repartition(n, "shard").sortWithinPartitions("shard", "doc_id")
    k = len(names)
    if n == 1:
        return Model(names, _over_shards(shards, names, k, lambda own: own.second_fit(own.first_fit()), True).astype(np.float32))
    held = _over_shards(shards, names, 1, lambda own: _held(own.whole()[0]), False)[:, 0]
    rough = _over_shards(shards, names, k, lambda own: own.first_fit(held), True)
    held_by_parts = _over_shards(shards, names, 1, lambda own: _held(own.parts(rough)[0]), False)[:, 0]
    return Model(names, _over_shards(shards, names, k, lambda own: own.second_fit(rough, held_by_parts), True).astype(np.float32))


def compositions(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, subject, share, foremost): every subject of a share above 0.01 in every document; kept in the checkpoint folder."""
    return cut_lineage(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_compose(model), OUT))


def threshold(composed: DataFrame, sample: DataFrame, bins: int = 50) -> float:
    """The least share that counts, for all subjects and at every size by the same rule: calibrated on the lesser shares of all labelled documents, those of ``sample``, and of all documents."""
    lesser = composed.where("not foremost and share < 0.5").withColumn("bin", F.floor(F.col("share") * 2 * bins).cast("int"))
    named = F.coalesce(F.array_contains("own", F.col("subject")), F.lit(False))
    counted = lesser.join(sample, "doc_id", "left").groupBy("bin").agg(F.count("*").alias("n"), F.count_if(F.col("own").isNotNull()).alias("seen"), F.count_if(named).alias("named"))
    table = np.zeros((3, bins))
    for r in counted.collect():
        table[:, min(r.bin, bins - 1)] += (r.n, r.seen, r.named)
    return gap(table[0], likely_steps(table[1], table[2]))


def classify(documents: DataFrame, model: Model, sample: DataFrame) -> DataFrame:
    """(doc_id, subject, share): one row per document row and subject it is about, at least the foremost one. A text without
    words, null among them, has none. Whole texts are read; one pass without shuffle."""
    composed = compositions(documents, model)
    least = threshold(composed, sample)
    return composed.where(F.col("foremost") | (F.col("share") >= least)).select("doc_id", "subject", "share")
