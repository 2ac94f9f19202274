"""Grouping abstracts into clusters of mutually similar records by power-iteration spectral clustering.

Affinities. Texts are brought to a form in which wrong decodings, misread characters, line breaks and numbers make no
difference; equal forms are copies and count as one node. Word shingles that texts share bring pairs together; a pair is
kept for the number of its shared sentences, that is of sentences of which it shares a shingle, and for the share of shingles in common, so
that one common phrase or notice is not enough. All pairs of a shingle count, in blocks over all tasks if it is of many texts; of a shingle that a
large part of all texts share, those are taken that can still be similar by such shingles alone, and the pairs that share another shingle.

Clusters. The row-normalised affinity matrix is applied to several random vectors; entries become equal within a well-connected cluster
long before they do across a bottleneck. Components of the graph whose embedding still has a spread are divided by
k-means steps on the embedding, over and over until none spreads or the parts hang together. Components that fit one task are
divided there, many in one pass; only larger ones take a round of joins for each step. Members are ranked by the sum of their affinities inside their cluster.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperweave.llm.scanned import MERGED, SINGLE
from paperweave.operators.components import connected_components
from paperweave.plans.runtime import cut_lineage

BROKEN = re.compile(r"[-\xad¬‐]\s*\n\s*")
BEYOND = re.compile(r"[^\x00-\x7f]+")
NUMBER = re.compile(r"\b[\d,.]*\d%?")
SENTENCE = re.compile(r"[.?:]\s+")
WORD = re.compile(r"[a-z_]+")
MIX = np.uint64(0x9E3779B97F4A7C15)
VECTORS = 6


def plain(text: str) -> str:
    """The text in a form that survives wrong decoding, scanning and changed numbers."""
    text = NUMBER.sub(" ", BEYOND.sub("_", BROKEN.sub("", text).lower()))
    for a, b in MERGED:
        text = text.replace(a, b)
    return text.translate(SINGLE)


def _shingles_of(texts: list[str], size: int, ids: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all shingles inside sentences, with the number of the text and of the sentence in it.

    A text without a sentence of ``size`` words gives one shingle, of all its words."""
    words: list[int] = []
    owner: list[int] = []
    sentence: list[int] = []
    length: list[int] = []
    for i, text in enumerate(texts):
        cut = [WORD.findall(s) for s in SENTENCE.split(plain(text))]
        own = [w for w in cut if len(w) >= size] or [[w for s in cut for w in s]]
        for k, found in enumerate(own):
            for w in found:
                if w not in ids:
                    ids[w] = zlib.crc32(w.encode())
            words.extend([ids[w] for w in found])
            owner.append(i)
            sentence.append(k)
            length.append(len(found))
    if len(ids) > 500_000:
        ids.clear()
    h = np.asarray(words, np.uint64)
    n = np.asarray(length, np.int64)
    windows = np.maximum(n - size + 1, (n > 0).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else n
    which = np.repeat(np.arange(len(n)), windows)
    at = np.arange(len(which)) - np.repeat(np.cumsum(windows) - windows, windows) + begin[which]
    value = np.zeros(len(which), np.uint64)
    for k in range(size):
        inside = k < n[which]
        value = value * MIX + np.where(inside, h[np.minimum(at + k, max(len(h) - 1, 0))] if len(h) else 0, np.uint64(k + 1))
    value ^= value >> np.uint64(29)
    value *= np.uint64(0xBF58476D1CE4E5B9)
    value ^= value >> np.uint64(32)
    return value.view(np.int64), np.asarray(owner, np.int64)[which], np.asarray(sentence, np.int64)[which]


def winnow(value: np.ndarray, sentence: np.ndarray, window: int) -> np.ndarray:
    """Marks the smallest hash of every ``window`` neighbouring shingles of a sentence: of a run of so many shingles
    that two texts share, at least one is marked in both. ``sentence`` numbers the sentences of all texts."""
    n, place = len(value), np.arange(len(value))
    best = place.copy()
    for k in range(1, window):
        ahead = np.minimum(place + k, n - 1)
        better = (place + k < n) & (sentence[ahead] == sentence) & (value[ahead] <= value[best])
        best = np.where(better, ahead, best)
    end = np.minimum(place + window - 1, n - 1)
    whole = (place + window - 1 < n) & (sentence[end] == sentence)
    begins = np.ones(n, bool)
    begins[1:] = sentence[1:] != sentence[:-1]
    marked = np.zeros(n, bool)
    marked[best[whole | begins]] = True
    return marked


TEXT = "node bigint, held int, shingles array<bigint>, sentences array<tinyint>"
COMMON = "node bigint, held int, shingles array<bigint>"
SHINGLE = "shingle bigint, node bigint, sentence tinyint, held int, hidden int"
PAIR = "a bigint, b bigint, sentence tinyint, least int, hidden int"


def _shingle(size: int, window: int):
    """Rows of TEXT, each shingle once a text. ``held`` is the text's number of shingles, negative if it has one sentence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: dict[str, int] = {}
        for batch in batches:
            value, owner, sentence = _shingles_of(batch.column(1).to_pylist(), size, ids)
            kept = winnow(value.view(np.uint64), owner * (int(sentence.max(initial=0)) + 1) + sentence, window)
            several = np.zeros(batch.num_rows, bool)
            several[owner[sentence > 0]] = True
            # the sentences of a text that has very many of them are marked in turn
            value, owner, sentence = value[kept], owner[kept], sentence[kept] % 63
            order = np.lexsort((sentence, value, owner))
            value, sentence, owner = value[order], sentence[order], owner[order]
            first = np.ones(len(value), bool)
            first[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
            value, sentence, owner = value[first], sentence[first], owner[first]
            held = np.bincount(owner, minlength=batch.num_rows)
            ends = pa.array(np.r_[0, np.cumsum(held)].astype(np.int32))
            signed = np.where(several, held, -held).astype(np.int32)
            made = (pa.ListArray.from_arrays(ends, pa.array(x)) for x in (value, sentence.astype(np.int8)))
            yield pa.record_batch({"node": batch.column(0), "held": pa.array(signed), **dict(zip(("shingles", "sentences"), made))})

    return run


def _columns(batch: pa.RecordBatch, often: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of a batch of TEXT, for every shingle: its text's row, itself, its sentence, and whether it is one of ``often``, which is sorted."""
    shingles, sentences = batch.column(2), batch.column(3)
    value = shingles.flatten().to_numpy()
    row = np.repeat(np.arange(batch.num_rows), np.diff(shingles.offsets.to_numpy()))
    at = np.searchsorted(often, value)
    return row, value, sentences.flatten().to_numpy(), (often[np.minimum(at, len(often) - 1)] == value) if len(often) else np.zeros(len(value), bool)


def _usual(often: np.ndarray):
    """Rows of SHINGLE of TEXT: the shingles that are none of ``often``; ``hidden`` is how many of the text's are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, value, sentence, common = _columns(batch, often)
            hidden = np.bincount(row[common], minlength=batch.num_rows).astype(np.int32)
            row, value, sentence = row[~common], value[~common], sentence[~common]
            yield pa.record_batch({"shingle": pa.array(value), "node": batch.column(0).take(pa.array(row)), "sentence": pa.array(sentence), "held": batch.column(1).take(pa.array(row)), "hidden": pa.array(hidden[row])})

    return run


def _commons(often: np.ndarray, texts: np.ndarray):
    """Rows of COMMON of TEXT: of each text only the shingles that are of ``often``, the rarest first; ``texts`` tells of how many texts each is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, value, _, common = _columns(batch, often)
            row, value = row[common], value[common]
            if not len(row):
                continue
            order = np.lexsort((value, texts[np.searchsorted(often, value)], row))
            row, value = row[order], value[order]
            begin = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            ends, which = pa.array(np.append(begin, len(row)).astype(np.int32)), pa.array(row[begin])
            yield pa.record_batch({"node": batch.column(0).take(which), "held": batch.column(1).take(which), "shingles": pa.ListArray.from_arrays(ends, pa.array(value))})

    return run


def _least(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smaller number of shingles, negative if one of the texts has one sentence."""
    return np.where((a < 0) | (b < 0), -np.minimum(abs(a), abs(b)), np.minimum(a, b))


#: Texts of a shingle that one block of pairs holds on either side.
BLOCK = 500


def _pairs_of_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of PAIR: every pair of texts of a group, which is all rows equal in shingle and ``block``. Rows come sorted by group, and a group in one task.
    ``side`` is 0 where all pairs of a block count, else only those of a text of side 1 and one of side 2 do."""

    def pair(node: np.ndarray, sentence: np.ndarray, held: np.ndarray, hidden: np.ndarray, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
        a, b, s, t = node[x], node[y], sentence[x], sentence[y]
        ordered = a < b
        return pa.record_batch({"a": pa.array(np.where(ordered, a, b)), "b": pa.array(np.where(ordered, b, a)), "sentence": pa.array(np.where(ordered, s, t)), "least": pa.array(_least(held[x], held[y])), "hidden": pa.array(np.minimum(hidden[x], hidden[y]))})

    def pairs(shingle: np.ndarray, block: np.ndarray, side: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        start = np.flatnonzero(np.r_[True, (shingle[1:] != shingle[:-1]) | (block[1:] != block[:-1])])
        size = np.diff(np.append(start, len(shingle)))
        whole = side[start] == 0
        for n in np.unique(size[whole & (size > 1)]):
            own = start[whole & (size == n)]
            i, j = np.triu_indices(n, 1)
            step = max(1, 300_000 // len(i))
            for at in range(0, len(own), step):
                rows = own[at : at + step, None] + np.arange(n)
                yield pair(*columns, rows[:, i].ravel(), rows[:, j].ravel())
        for at, n in zip(start[~whole], size[~whole]):
            ones = int((side[at : at + n] == 1).sum())
            if 0 < ones < n:
                yield pair(*columns, np.repeat(np.arange(at, at + ones), n - ones), np.tile(np.arange(at + ones, at + n), ones))

    names = ("shingle", "block", "side", "node", "sentence", "held", "hidden")
    rest: list[tuple] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rest.append(tuple(batch.column(c).to_numpy() for c in names))
        if sum(len(r[0]) for r in rest) < 100_000:
            continue
        whole = tuple(np.concatenate(c) for c in zip(*rest))
        differs = np.flatnonzero((whole[0] != whole[0][-1]) | (whole[1] != whole[1][-1]))
        cut = int(differs[-1]) + 1 if len(differs) else 0
        if cut:
            yield from pairs(*(c[:cut] for c in whole))
        rest = [tuple(c[cut:] for c in whole)]
    if rest:
        yield from pairs(*(np.concatenate(c) for c in zip(*rest)))


def _all_pairs(rows: DataFrame, sizes: DataFrame | None) -> DataFrame:
    """PAIR rows of every two texts of a shingle. ``rows``: SHINGLE; ``sizes``: (shingle, n) of those of more than BLOCK texts, if there can be any. Their texts are dealt by
    hash to parts of some BLOCK texts, and every part meets every other in a block of its own, so that no task gets all pairs of a shingle."""
    columns = ("node", "sentence", "held", "hidden")
    placed = (rows if sizes is None else rows.join(sizes, "shingle", "left_anti")).select("shingle", F.lit(0).cast("bigint").alias("block"), F.lit(0).cast("tinyint").alias("side"), *columns)
    if sizes is not None:
        dealt = rows.join(sizes.select("shingle", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts")), "shingle").withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        block = F.least("part", "other").cast("bigint") * F.col("parts") + F.greatest("part", "other")
        side = F.when(F.col("part") == F.col("other"), 0).when(F.col("part") < F.col("other"), 1).otherwise(2).cast("tinyint")
        placed = placed.union(dealt.select("shingle", block.alias("block"), side.alias("side"), *columns))
    return placed.repartition("shingle", "block").sortWithinPartitions("shingle", "block", "side", "node").mapInArrow(_pairs_of_groups, PAIR)


def _only_common(commons: DataFrame, large: float) -> DataFrame:
    """PAIR rows, without sentence, of every two texts that can share so many common shingles that they are the share ``large`` of the lesser text's. ``commons``: as ``_commons`` gives them.

    Of the shingles that two such texts share take the rarest: from there on, in order of rarity, both still hold as many as the lesser text needs."""
    need = F.ceil(F.lit(large) * F.abs("held") - 1e-9).cast("int")
    placed = commons.select("node", "held", need.alias("need"), F.size("shingles").alias("n"), F.posexplode("shingles").alias("place", "shingle")).withColumn("left", F.col("n") - F.col("place"))
    lesser = cut_lineage(placed.where("left >= need").select("shingle", F.col("node").alias("x"), F.col("held").alias("held_x"), "need", F.col("n").alias("n_x")))
    y = placed.join(lesser.groupBy("shingle").agg(F.min("need").alias("least_need")), "shingle").where("left >= least_need").select("shingle", F.col("node").alias("y"), F.col("held").alias("held_y"), "left", F.col("n").alias("n_y"))
    met = lesser.join(y, "shingle").where("x <> y and left >= need and abs(held_x) <= abs(held_y)")
    least = F.abs("held_x") * F.when((F.col("held_x") < 0) | (F.col("held_y") < 0), -1).otherwise(1)
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.lit(None).cast("tinyint").alias("sentence"), least.cast("int").alias("least"), F.least("n_x", "n_y").alias("hidden"))


def affinities(texts: DataFrame, size: int = 6, window: int = 3, few: int = 32, common: float = 0.001, large: float = 0.6) -> DataFrame:
    """(a, b, affinity), a < b, of all similar texts; ``texts``: (node bigint, text), distinct nodes and forms.

    Shingles are of ``size`` words; of each ``window`` neighbouring ones the smallest hash is used, so that every common run of size + window - 1 words counts.
    A shingle of more than the share ``common`` of all texts (and of more than ``few``) is a common one, which by itself does not show that two texts share a sentence.
    There can be no more of these than shingles in a thousand texts, so they are sent to all tasks. Pairs that share another shingle are all listed, and their common ones
    counted in full. Two texts that share too little else are similar if all they share is the share ``large`` of the lesser text's shingles; all such pairs are found, too.
    """
    shingles = cut_lineage(texts.mapInArrow(_shingle(size, window), TEXT))
    limit = max(few, common * shingles.where("held <> 0").count())
    counts = cut_lineage(shingles.select(F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n")).where(F.col("n") > min(BLOCK, limit)))
    often = counts.where(F.col("n") > limit).toArrow().sort_by("shingle")
    often, of_texts = (often.column(c).to_numpy() for c in ("shingle", "n"))
    commons = cut_lineage(shingles.mapInArrow(_commons(often, of_texts), COMMON))
    usual = _all_pairs(shingles.mapInArrow(_usual(often), SHINGLE), counts.where(F.col("n") <= limit) if limit > BLOCK else None)
    sentences = F.coalesce(F.bit_or(F.expr("shiftleft(1L, cast(sentence as int))")), F.lit(0).cast("bigint"))
    counted = usual.union(_only_common(commons, large)).groupBy("a", "b").agg(sentences.alias("sentences"), F.count("sentence").alias("n"), F.min("least").alias("least"), F.min("hidden").alias("hidden"))
    share, share_of_all = (F.least(F.lit(1.0), F.col(c) / F.abs("least")) for c in ("n", "n_all"))
    in_common = F.bit_count("sentences")
    enough = (
        ((in_common >= 4) & (share >= 0.08))
        | ((in_common == 3) & (share >= 0.13))
        | ((in_common == 2) & (share >= 0.21))
        | ((in_common == 1) & (F.col("least") < 0) & (share >= 0.5))
    )
    # common shingles are looked up only where they can matter
    likely = counted.where("a <> b").withColumn("enough", enough).where(F.col("enough") | (F.col("n") + F.col("hidden") >= large * F.abs("least")))
    own = lambda at: commons.select(F.col("node").alias(at), F.col("shingles").alias(f"shingles_{at}"))
    both = F.when(F.col("shingles_a").isNull() | F.col("shingles_b").isNull(), 0).otherwise(F.size(F.array_intersect("shingles_a", "shingles_b")))
    judged = likely.join(own("a"), "a", "left").join(own("b"), "b", "left").withColumn("n_all", F.col("n") + both)
    return judged.where(F.col("enough") | (share_of_all >= large)).select("a", "b", share_of_all.alias("affinity"))


def embed(edges: DataFrame, rounds: int = 12, rest: float = 0.3, every: int = 3) -> DataFrame:
    """(node, v0, v1, ...): the random-walk matrix of the affinities, with a share ``rest`` of staying, applied ``rounds`` times to random vectors."""
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("near"), "affinity").union(edges.select("b", "a", "affinity"))
    walk = cut_lineage(both.withColumn("p", F.col("affinity") / F.sum("affinity").over(Window.partitionBy("node"))).select("node", "near", "p"))
    names = [f"v{i}" for i in range(VECTORS)]
    current = walk.select("node").distinct().select("node", *((F.pmod(F.xxhash64("node", F.lit(i)), F.lit(1_000_003)) / 1_000_003.0).alias(f"v{i}") for i in range(VECTORS)))
    for i in range(rounds):
        moved = walk.join(current.withColumnRenamed("node", "near"), "near").groupBy("node").agg(*(F.sum(F.col("p") * F.col(v)).alias(f"m_{v}") for v in names))
        current = current.join(moved, "node").select("node", *((rest * F.col(v) + (1 - rest) * F.col(f"m_{v}")).alias(v) for v in names))
        if (i + 1) % every == 0:
            current = cut_lineage(current)
    return current


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC2B2AE3D27D4EB4F)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x165667B19E3779F9)
    return h ^ (h >> np.uint64(32))


def _start(node: np.ndarray) -> np.ndarray:
    """The random vectors that ``embed`` begins with: xxhash64(node, i) as Spark computes it."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turned = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))
    seed = _mixed(turned((np.uint64(42 + 8) + p5) ^ (turned(node.view(np.uint64) * p2, 31) * p1), 27) * p1 + p4)
    hashes = [_mixed(turned((seed + p5 + np.uint64(4)) ^ (np.full(1, i, np.uint64) * p1), 23) * p2 + p3) for i in range(VECTORS)]
    return np.stack([h.view(np.int64) % 1_000_003 / 1_000_003.0 for h in hashes])


def _divided(a: np.ndarray, b: np.ndarray, affinity: np.ndarray, component: np.ndarray, spread: float, loose: float, most: int, steps: int, rounds: int = 12, rest: float = 0.3) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and clusters of whole components: ``embed`` and the steps of ``divide`` over columns in memory."""
    node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    to, near = np.concatenate([a, b]), np.concatenate([b, a])
    sums = lambda index, weights, n: np.bincount(index, weights=weights, minlength=n)
    p = np.concatenate([affinity, affinity])
    p = p / sums(to, p, len(node))[to]
    v = _start(node)
    for _ in range(rounds):
        v = np.stack([rest * x + (1 - rest) * sums(to, p * x[near], len(node)) for x in v])
    cluster = np.empty(len(node), np.int64)
    cluster[a], cluster[b] = component, component
    open_ = np.ones(len(node), bool)
    for _ in range(most):
        own = np.flatnonzero(open_)
        if not len(own):
            break
        own = own[np.argsort(cluster[own], kind="stable")]
        begin = np.flatnonzero(np.r_[True, cluster[own][1:] != cluster[own][:-1]])
        size = np.diff(np.append(begin, len(own)))
        width = np.stack([np.maximum.reduceat(x[own], begin) - np.minimum.reduceat(x[own], begin) for x in v])
        axis = VECTORS - 1 - width[::-1].argmax(axis=0)
        wide = (size > 3) & (width.max(axis=0) > spread)
        open_[own[np.repeat(~wide, size)]] = False
        own, axis, size = own[np.repeat(wide, size)], axis[wide], size[wide]
        if not len(own):
            break
        n = len(size)
        group = np.repeat(np.arange(n), size)
        # nodes are numbered in their order, so that ties go as by node
        ranked = own[np.lexsort((own, v[axis[group], own], group))]
        last = np.cumsum(size) - 1
        ends = np.stack([v[:, ranked[last]], v[:, ranked[last - size + 1]]])
        for step in range(steps):
            to_a, to_b = (((v[:, own] - e[:, group]) ** 2).sum(axis=0) for e in ends)
            side = to_a <= to_b
            if step + 1 < steps:
                held = np.stack([sums(group, s.astype(float), n) for s in (side, ~side)])
                means = np.stack([[sums(group, np.where(s, x[own], 0.0), n) for x in v] for s in (side, ~side)]) / np.maximum(held, 1)[:, None]
                ends = np.where((held > 0)[:, None], means, means[::-1])
        of, sided = np.full(len(node), -1), np.zeros(len(node), bool)
        of[own], sided[own] = group, side
        within = (of[a] >= 0) & (cluster[a] == cluster[b])
        x, y, w = a[within], b[within], affinity[within]
        across = sums(of[x], w * (sided[x] != sided[y]), n)
        lesser = np.minimum(*(sums(of[x], w * ((sided[x] == s).astype(int) + (sided[y] == s)), n) for s in (True, False)))
        stands = across < loose * lesser
        open_[own[~stands[group]]] = False
        own, group, side = own[stands[group]], group[stands[group]], side[stands[group]]
        least = np.full((n, 2), len(node))
        np.minimum.at(least, (group, side.astype(int)), own)
        cluster[own] = node[least[group, side.astype(int)]]
    return node, cluster


def _divide_inside(spread: float, loose: float, most: int, steps: int, enough: int = 200_000):
    """Rows (component, a, b, affinity) come sorted by component, and a component in one task."""

    def divided(columns: list[tuple]) -> pa.RecordBatch:
        component, a, b, affinity = (np.concatenate(c) for c in zip(*columns))
        node, cluster = _divided(a, b, affinity, component, spread, loose, most, steps)
        return pa.record_batch({"node": pa.array(node), "cluster": pa.array(cluster)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[tuple] = []
        for batch in batches:
            rest.append(tuple(batch.column(c).to_numpy() for c in ("component", "a", "b", "affinity")))
            last = rest[-1][0][-1] if batch.num_rows else None
            if sum(len(r[0]) for r in rest) < enough or rest[0][0][0] == last:
                continue
            whole = tuple(np.concatenate(c) for c in zip(*rest))
            cut = int(np.flatnonzero(whole[0] != whole[0][-1])[-1]) + 1
            yield divided([tuple(c[:cut] for c in whole)])
            rest = [tuple(c[cut:] for c in whole)]
        if sum(len(r[0]) for r in rest):
            yield divided(rest)

    return run


def divide(edges: DataFrame, spread: float = 0.1, loose: float = 0.2, most: int = 20, steps: int = 2, inside: int = 1_000_000) -> DataFrame:
    """(node, cluster): components of the graph, divided as ``divide_spread`` says. Components of at most ``inside`` edges are divided each in one task, in one
    pass over all of them, so that the number of plans does not grow with them; larger ones by joins over all tasks."""
    components = cut_lineage(connected_components(edges))
    placed = cut_lineage(edges.join(components.select(F.col("node").alias("a"), "component"), "a").select("component", "a", "b", "affinity"))
    large = cut_lineage(placed.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > inside).select("component"))
    small = placed.join(large, "component", "left_anti").repartition("component").sortWithinPartitions("component", "a", "b")
    divided = small.mapInArrow(_divide_inside(spread, loose, most, steps), "node bigint, cluster bigint")
    if large.isEmpty():
        return divided
    return divided.union(divide_spread(placed.join(large, "component", "left_semi").select("a", "b", "affinity"), components.join(large, "component", "left_semi"), spread, loose, most, steps))


def divide_spread(edges: DataFrame, components: DataFrame, spread: float, loose: float, most: int, steps: int) -> DataFrame:
    """(node, cluster): ``components`` of the graph, divided where the embedding has not become equal.

    A cluster with a coordinate that spreads by more than ``spread`` gets two centres, its outermost nodes in that coordinate, and ``steps``
    rounds of k-means on the embedding. The division stands if the parts hang together loosely: the affinities across are less than the share ``loose`` of all affinities of the
    lesser part, as across a bottleneck; a family of near copies has none, however large it is. Parts are divided again, until no division stands (``most`` times at most,
    which makes as many parts as two to that). Only sums per cluster are shuffled.
    """
    names = [f"v{i}" for i in range(VECTORS)]
    state = cut_lineage(components.select("node", F.col("component").alias("cluster")).join(embed(edges), "node"))
    settled: list[DataFrame] = []
    for _ in range(most):
        ranges = state.groupBy("cluster").agg(F.count("*").alias("size"), *(F.max(v).alias(f"hi_{v}") for v in names), *(F.min(v).alias(f"lo_{v}") for v in names))
        widest = F.sort_array(F.array(*(F.struct((F.col(f"hi_{v}") - F.col(f"lo_{v}")).alias("width"), F.lit(i).alias("axis")) for i, v in enumerate(names))), asc=False)[0]
        # of three nodes or fewer, no part has anything inside that the affinities across could be less than
        wide = ranges.withColumn("w", widest).where((F.col("size") > 3) & (F.col("w.width") > spread)).select("cluster", F.col("w.axis").alias("axis"))
        split = cut_lineage(state.join(wide, "cluster"))
        if split.isEmpty():
            break
        axis = F.array(*names)[F.col("axis")]
        ends = split.groupBy("cluster").agg(*(F.max_by(v, F.struct(axis, "node")).alias(f"a_{v}") for v in names), *(F.min_by(v, F.struct(axis, "node")).alias(f"b_{v}") for v in names))
        for step in range(steps):
            to_a, to_b = (sum((F.col(v) - F.col(f"{c}_{v}")) ** 2 for v in names) for c in "ab")
            sided = split.join(ends, "cluster").select("node", "cluster", (to_a <= to_b).alias("side"), *names)
            if step + 1 < steps:
                means = sided.groupBy("cluster").agg(*(F.avg(F.when(F.col("side"), F.col(v))).alias(f"a_{v}") for v in names), *(F.avg(F.when(~F.col("side"), F.col(v))).alias(f"b_{v}") for v in names))
                ends = means.select("cluster", *(F.coalesce(f"{c}_{v}", f"{o}_{v}").alias(f"{c}_{v}") for c, o in ("ab", "ba") for v in names))
        sided = cut_lineage(sided)
        end = lambda at: sided.select(F.col("node").alias(at), F.col("cluster").alias(f"cluster_{at}"), F.col("side").alias(f"side_{at}"))
        inside = edges.join(end("a"), "a").join(end("b"), "b").where("cluster_a = cluster_b")
        across = F.sum(F.when(F.col("side_a") != F.col("side_b"), F.col("affinity")).otherwise(0.0))
        held = lambda side: F.sum(F.col("affinity") * ((F.col("side_a") == side).cast("int") + (F.col("side_b") == side).cast("int")))
        cuts = inside.groupBy(F.col("cluster_a").alias("cluster")).agg(across.alias("across"), F.least(held(True), held(False)).alias("lesser"))
        stands = cut_lineage(cuts.where(F.col("across") < loose * F.col("lesser")).select("cluster"))
        settled.append(state.join(stands, "cluster", "left_anti").select("node", "cluster"))
        divided = sided.join(stands, "cluster")
        parts = divided.groupBy("cluster", "side").agg(F.min("node").alias("part"))
        state = cut_lineage(divided.join(parts, ["cluster", "side"]).select("node", F.col("part").alias("cluster"), *names))
    return reduce(DataFrame.union, [*settled, state.select("node", "cluster")])


class Clustering:
    """``records``: rows with an equal key count once; null keys, and null or empty texts or such without letters, belong to no cluster; extra
    columns are ignored. Equal scores are broken by key. An empty table gives no clusters."""

    def __init__(self, records: DataFrame, key: str, text: str, size: int = 6, window: int = 3, few: int = 32) -> None:
        letters = F.regexp_replace(F.lower(text), "[^\\p{L}]+", " ")
        rows = records.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), F.xxhash64(letters).alias("node"), F.col(text).alias("text"), F.trim(letters).alias("letters")).where("letters <> ''")
        self.members = rows.select("key", "node").distinct()
        texts = rows.select("node", "text").dropDuplicates(["node"])
        self.edges = cut_lineage(affinities(texts, size, window, few))
        self.nodes = cut_lineage(divide(self.edges))

    def clusters(self) -> DataFrame:
        """(key, cluster) of every record that shares its cluster with another."""
        placed = self.members.join(self.nodes, "node", "left").select("key", F.coalesce("cluster", "node").alias("cluster"))
        held = placed.groupBy("cluster").agg(F.count("*").alias("size")).where("size > 1").select("cluster")
        return placed.join(held, "cluster").select("key", "cluster")

    def described(self, typical: int = 3) -> DataFrame:
        """(cluster, size, typical): keys of the members with the greatest sums of affinities inside the cluster."""
        inside = (
            self.edges.join(self.nodes.select(F.col("node").alias("a"), F.col("cluster").alias("ca")), "a").join(self.nodes.select(F.col("node").alias("b"), F.col("cluster").alias("cb")), "b").where("ca = cb")
        )
        sums = inside.select(F.col("a").alias("node"), "affinity").union(inside.select("b", "affinity")).groupBy("node").agg(F.sum("affinity").alias("weight"))
        placed = self.members.join(self.nodes, "node", "left").join(sums, "node", "left").select("key", F.coalesce("cluster", "node").alias("cluster"), F.coalesce("weight", F.lit(0.0)).alias("weight"))
        sized = placed.groupBy("cluster").agg(F.count("*").alias("size")).where("size > 1")
        rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("weight"), "key"))
        best = placed.withColumn("rank", rank).where(F.col("rank") <= typical).groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "key"))), lambda x: x["key"]).alias("typical"))
        return sized.join(best, "cluster").select("cluster", "size", "typical")


def pairs(clusters: DataFrame) -> DataFrame:
    """(key_a, key_b) of every two records of one cluster, the smaller by bytes first."""
    a, b = clusters.select("cluster", F.col("key").alias("key_a")), clusters.select("cluster", F.col("key").alias("key_b"))
    return a.join(b, "cluster").where("key_a < key_b").select("key_a", "key_b")
