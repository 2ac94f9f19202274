"""Linking references to the papers that they cite, without a shared key, by a label model.

Candidates. Titles and printed references are reduced to consonant skeletons, which wrong decodings, missing accents and many slips leave
as they are. A reference and a paper of its peer are a candidate if the reference holds the surname of any author and at least HELD of the title's words, or
at least RUNS of the title's runs of three words, wherever they stand. All such pairs are found, by prefixes: of n title words of which m must be there, two of
the n - m + 2 rarest must be (one of the n - m + 1 rarest, if m is one), so a paper is indexed under these only, and no key needs a cap.

Confidence. Several heuristic functions vote for, against or not at all on each candidate. A generative model with the
hidden class, fitted by expectation maximisation on the counts of vote patterns, learns how often each function is right and how the
functions of a group (title, authors) depend on each other, and gives the probability that the candidate is a match. Nothing overrules it.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from sys import intern

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperweave.llm.names import common_ratio, fold, forms_of
from paperweave.plans.runtime import cut_lineage

TOKEN = re.compile(r"[a-z0-9]+")
HYPHEN = re.compile(r"(?<=\w)\s*[-\xad¬‐]+\s*(?=\w)")
NOT_CONSONANT = re.compile(r"[^bcdfghj-np-tvwxz0-9]")
NUMERAL = re.compile(r"(?:\d+|[ivx]+)$")
YEAR = re.compile(r"\b(1[89]\d\d|20\d\d)\b")
#: Where the title stands in the printed styles: in quotation marks, after a year in or without brackets, after the authors and a full stop.
TITLES = [re.compile(x) for x in (r"[“\"«]([^”\"»]{4,}?)[,.]?[”\"»]", r"\((?:\d{4}|n\.d\.)\w?\)\.\s+(.{4,}?[.?])\s", r"(?:\d{4}|n\.d\.)\.?\s+(.{4,}?[.?])\s+In\s", r"^(?:\[?\d+\]?\.?\s+)?.*?\w{3,}(?: et al)?\.\s+(.{4,}?[.?])\s")]
#: Functions by group; within a group their dependence is learned.
GROUPS = (("title_in_raw", "title_run", "title_same"), ("first_author", "authors"), ("year",), ("known",))
FUNCTIONS = [f for g in GROUPS for f in g]
#: Shares of a title's words (beside an author) and of its runs of three words that make a candidate.
HELD, RUNS = 0.4, 0.6
#: How many indexed keys of a kind a candidate shares, if so many are needed at all.
SHARED = 2
#: Filter bits per indexed key, and the most there are of them (128 MB): a fuller filter only lets more keys through to the join.
BITS_A_KEY, MOST_BITS = 12, 30

def plain(text: str | None) -> str:
    """Folded, with hyphenated and broken words joined and what is still beyond ASCII dropped."""
    return fold(HYPHEN.sub("", text or "")).encode("ascii", "ignore").decode()


@lru_cache(maxsize=200_000)
def skeleton(token: str) -> str:
    return NOT_CONSONANT.sub("", token) or token[:1]


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall(plain(text))


def _hash(text: str) -> int:
    return zlib.crc32(text.encode())


def _mix(peer: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    h = (first + peer * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9) + second
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x94D049BB133111EB)
    return (h ^ (h >> np.uint64(29))).view(np.int64)


def _cached(token: str, cache: dict[str, int]) -> int:
    if token not in cache:
        if len(cache) > 400_000:
            cache.clear()
        cache[token] = _hash(skeleton(token))
    return cache[token]


def telling(line: list[str]) -> list[str]:
    """Skeletons of a title's words by which it is looked for: the longer ones; of a title without such, all."""
    return [x for x in line if len(x) > 2] or line


def runs(line: list[str]) -> list[tuple[str, ...]]:
    """Runs of three neighbouring skeletons; of a shorter title, the whole of it."""
    return list(zip(line, line[1:], line[2:])) if len(line) > 2 else [tuple(line)] if line else []


def least(n: int, share: float) -> int:
    """How many of ``n`` make up the share."""
    return max(1, math.ceil(share * n - 1e-9))


def _run_hashes(peer: np.ndarray, *line: np.ndarray) -> np.ndarray:
    """Keys of runs of one to three words."""
    key = _mix(peer, line[0], np.full(len(peer), len(line), np.uint64))
    for h in line[1:]:
        key = _mix(h, key.view(np.uint64), np.full(len(peer), 13, np.uint64))
    return key


def _paper_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per distinct word (``kind`` 0) and run (its number of words) of a title, of which ``needed`` must be in a reference."""
    cache: dict[str, int] = {}
    for batch in batches:
        urns = batch.column("urn")
        # by kind: paper, peer, how many are needed, the hashes of one to three words
        rows: dict[int, list[tuple]] = {0: [], 1: [], 2: [], 3: []}
        for i, (peer, title) in enumerate(zip(batch.column("peer").to_pylist(), batch.column("title").to_pylist())):
            words = tokens(title)
            line = [skeleton(w) for w in words]
            h = dict(zip(line, (_cached(w, cache) for w in words)))
            own = _hash(peer)
            alone, following = set(telling(line)), set(runs(line))
            rows[0] += [(i, own, least(len(alone), HELD), h[x]) for x in sorted(alone)]
            for run in sorted(following):
                rows[len(run)].append((i, own, least(len(following), RUNS), *(h[x] for x in run)))
        for kind, found in rows.items():
            if found:
                i, peer, needed, *line = (np.array(c, np.uint64) for c in zip(*found))
                key = _run_hashes(peer, *line) if kind else _word_key(peer, line[0])
                yield pa.record_batch({"urn": urns.take(pa.array(i.astype(np.int64))), "kind": pa.array(np.full(len(i), kind, np.int32)), "index_key": pa.array(key), "needed": pa.array(needed.astype(np.int32))})


def _word_key(peer: np.ndarray, word: np.ndarray) -> np.ndarray:
    return _mix(peer, word, np.full(len(peer), 5, np.uint64))


def _author_key(peer: np.ndarray, author: np.ndarray) -> np.ndarray:
    return _mix(peer, author, np.full(len(peer), 7, np.uint64))


def _with_author(key: np.ndarray, author: np.ndarray) -> np.ndarray:
    """A word's key and an author in one key."""
    return _mix(author, key.view(np.uint64), np.full(len(key), 11, np.uint64))


def _author_hashes(surnames: list[str] | None, cache: dict[str, int]) -> list[int]:
    """Surnames printed in pieces count by their last piece."""
    return sorted({_cached(words[-1], cache) for s in surnames or () if (words := tokens(s))})


def _authors_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per paper and author, with the key that tells an author's name in a reference of the peer."""
    cache: dict[str, int] = {}
    for batch in batches:
        rows = [(u, _hash(p), a) for p, u, surnames in zip(*(batch.column(c).to_pylist() for c in ("peer", "urn", "surnames"))) for a in _author_hashes(surnames, cache)]
        peer, author = (np.array([r[i] for r in rows], np.uint64) for i in (1, 2))
        yield pa.record_batch({"urn": pa.array([r[0] for r in rows], pa.string()), "author": pa.array(author.view(np.int64)), "author_key": pa.array(_author_key(peer, author))})


def _joint_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key = _with_author(batch.column("index_key").to_numpy(), batch.column("author").to_numpy().view(np.uint64))
        yield pa.record_batch({"urn": batch.column("urn"), "index_key": pa.array(key), "kind": pa.array(np.zeros(len(key), np.int32)), "shared": batch.column("shared")})


class KeyFilter:
    """Bits of the keys that are indexed, two a key; a few keys that are not pass too."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits, self.wide = bits, int(len(bits) * 8).bit_length() - 1

    @staticmethod
    def places(wide: int) -> tuple[int, int]:
        """How far a key is shifted for each of its two bits."""
        return 64 - wide, 31 - wide // 2

    def __call__(self, key: np.ndarray) -> np.ndarray:
        """The places of the keys that pass."""
        passed = np.arange(len(key))
        for shift in self.places(self.wide):
            at = (key[passed].view(np.uint64) >> np.uint64(shift)) & np.uint64((1 << self.wide) - 1)
            passed = passed[(self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0]
        return passed


def _reference_keys(known: KeyFilter):
    """Keys of a reference that may be indexed: of every word that may be of a title together with every word that may be an author's name, and of all runs of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}
        for batch in batches:
            peers, refs, raws, titles = (batch.column(c).to_pylist() for c in ("peer", "ref", "raw", "title"))
            words: list[int] = []
            length: list[int] = []
            for raw, title in zip(raws, titles):
                found = tokens(raw if raw else title)
                words.extend([_cached(t, cache) for t in found])
                length.append(len(found))
            h = np.asarray(words, np.uint64)
            owner = np.repeat(np.arange(len(refs)), length)
            of_peer = np.asarray([_hash(p) for p in peers], np.uint64)
            keys, owners = [], []
            for n in (1, 2, 3):
                at = np.flatnonzero(owner[n - 1 :] == owner[: len(owner) - n + 1]) if len(owner) >= n else np.zeros(0, np.int64)
                keys.append(_run_hashes(of_peer[owner[at]], *(h[at + i] for i in range(n))))
                owners.append(owner[at])
            # every word once a reference
            order = np.lexsort((h, owner))
            fresh = np.ones(len(order), bool)
            fresh[1:] = (h[order][1:] != h[order][:-1]) | (owner[order][1:] != owner[order][:-1])
            h, owner = h[order][fresh], owner[order][fresh]
            word = _word_key(of_peer[owner], h)
            title_at, author_at = known(word), known(_author_key(of_peer[owner], h))
            held = np.bincount(owner[title_at], minlength=len(refs))
            begin = np.concatenate([[0], np.cumsum(held)[:-1]]) if len(held) else held
            times = held[owner[author_at]]
            author = np.repeat(author_at, times)
            inner = np.arange(len(author)) - np.repeat(np.cumsum(times) - times, times)
            title = title_at[begin[owner[author]] + inner]
            keys.append(_with_author(word[title], h[author]))
            owners.append(owner[author])
            key, own = np.concatenate(keys), np.concatenate(owners)
            passed = known(key)
            key, own = key[passed], own[passed]
            order = np.lexsort((key, own))
            key, own = key[order], own[order]
            once = np.ones(len(key), bool)
            once[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1])
            yield pa.record_batch({"ref": pa.array(np.asarray(refs, np.int64)[own[once]]), "index_key": pa.array(key[once])})

    return run


def key_filter(keys: DataFrame, n_keys: int) -> KeyFilter:
    """BITS_A_KEY bits a key, at most 2 ** MOST_BITS; packed words of bits reach the driver as Arrow columns."""
    wide = min(MOST_BITS, max(16, (BITS_A_KEY * max(1, n_keys) - 1).bit_length()))
    places = F.array(*(F.shiftrightunsigned("index_key", shift).bitwiseAND(F.lit((1 << wide) - 1)) for shift in KeyFilter.places(wide)))
    one = keys.select(F.explode(places).alias("place"))
    words = one.select(F.shiftright("place", 6).alias("at"), F.expr("shiftleft(1L, cast(place % 64 as int))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (wide - 6), np.int64)
    out[words.column("at").to_numpy()] = words.column("bits").to_numpy()
    return KeyFilter(out.view(np.uint8))


class _Text:
    """A text read once: plain, its words and their skeletons in order and as sets; what few candidates need is made when it is asked for."""

    __slots__ = ("plain", "words", "line", "among", "skeletons", "_letters", "_telling", "_runs")

    def __init__(self, text: str | None) -> None:
        self.plain = plain(text)
        self.words = list(map(intern, TOKEN.findall(self.plain)))
        self.line = list(map(skeleton, self.words))
        self.among, self.skeletons = set(self.words), set(self.line)
        self._letters: dict[str, list[str]] | None = None
        self._telling: set[str] | None = None
        self._runs: dict[int, set] = {}

    @property
    def letters(self) -> dict[str, list[str]]:
        """Words by first letter."""
        if self._letters is None:
            self._letters = {}
            for w in self.among:
                self._letters.setdefault(w[0], []).append(w)
        return self._letters

    @property
    def telling(self) -> set[str]:
        if self._telling is None:
            self._telling = set(telling(self.line))
        return self._telling

    def runs(self, n: int) -> set:
        if n not in self._runs:
            self._runs[n] = set(zip(*(self.line[i:] for i in range(n))))
        return self._runs[n]

    def holds(self, token: str) -> float:
        """How well a word is found in the text."""
        if token in self.among:
            return 1.0
        if len(token) > 3:
            if skeleton(token) in self.skeletons:
                return 0.95
            for other in self.letters.get(token[0], ()):
                if len(other) > 2 and token.startswith(other) and len(other) >= len(token) / 3:
                    return 0.8
                if abs(len(other) - len(token)) < 3 and len(other) > 3 and common_ratio(token, other) >= 0.8:
                    return 0.9
        return 0.0


# references come in order, papers in none
_reference = lru_cache(maxsize=64)(_Text)
_paper = lru_cache(maxsize=40_000)(_Text)


def _weight(token: str) -> float:
    return 1.0 if len(token) > 3 else 0.4


def printed_title(raw: str | None) -> str | None:
    """The title in a printed reference, where one of the known styles shows it."""
    return next((m.group(1) for pattern in TITLES if (m := pattern.search(raw or ""))), None)


@lru_cache(maxsize=4)
def _printed(raw: str | None, title: str | None) -> list[list[str]]:
    """Readings of a reference's title, as words: the labelled field, and what the printed style shows."""
    return [words for t in (title, printed_title(raw)) if len(words := tokens(t)) > 1]


def held(text: str | None, title: str | None, surnames: list[str]) -> bool:
    """The definition of a candidate: enough of a title's words beside an author, or enough of its runs, by skeletons."""
    printed, own = _reference(text), _paper(title)
    alone = own.telling
    if len(alone & printed.skeletons) >= least(len(alone), HELD) and any(words and skeleton(words[-1]) in printed.skeletons for words in map(_surname, surnames)):
        return True
    n = min(3, len(own.line))
    return n > 0 and len(own.runs(n) & printed.runs(n)) >= least(len(own.runs(n)), RUNS)


@lru_cache(maxsize=100_000)
def _surname(surname: str) -> list[str]:
    return tokens(surname)


def votes(raw: str | None, title: str | None, known_urn: str | None, pub_date: str | None, urn: str, paper_title: str | None, surnames: list[str], url: str | None) -> list[int]:
    """One vote in (-1, 0, 1) per function, in the order of FUNCTIONS."""
    read, paper = _reference(raw if raw else title), _paper(paper_title)
    own = paper.words
    found = [1.0 if t in read.among else read.holds(t) for t in own]
    whole = sum(map(_weight, own)) or 1.0
    contained = sum(f * _weight(t) for f, t in zip(found, own)) / whole
    v = {"title_in_raw": 1 if own and contained >= 0.86 else -1 if contained < 0.6 else 0}

    # the longest run of title words that follow each other in the reference
    places: dict[str, list[int]] = {}
    for i, b in enumerate(read.line):
        if b in paper.skeletons:
            places.setdefault(b, []).append(i)
    best, before = 0.0, {}
    for t, b in zip(own, paper.line):
        now = {i: before.get(i - 1, 0.0) + _weight(t) for i in places.get(b, ())}
        best = max(best, *now.values()) if now else best
        before = now
    v["title_run"] = 1 if best >= 0.55 * whole else -1 if best < 0.3 * whole else 0

    # words that only one of the two titles has, in the reading of the reference that leaves fewest: a slip leaves one on either side
    missing = [t for t, f in zip(own, found) if not f]
    extra = [[t for t in reading if t not in paper.among and not paper.holds(t)] for reading in _printed(raw, title)]
    over = min(extra, key=len) if extra else []
    if not extra or not own:
        v["title_same"] = 0
    elif len(over) != len(missing) or any(NUMERAL.match(t) for t in over + missing):
        v["title_same"] = -1
    else:
        v["title_same"] = 0 if over else 1

    if surnames:
        present = [s for s in surnames if s and all(read.holds(t) > 0.85 for t in _surname(s))]
        v["first_author"] = 1 if surnames[0] in present else -1
        expected = 1 if "et" in read.among and "al" in read.among else len(surnames)
        v["authors"] = 1 if len(present) >= max(1, 0.6 * expected) else -1 if not present else 0
    else:
        v["first_author"] = v["authors"] = 0

    year = YEAR.search(url or "")
    printed = set(YEAR.findall(f"{pub_date or ''} {read.plain}"))
    v["year"] = 0 if not year or not printed else 1 if year.group(1) in printed else -1
    v["known"] = 1 if known_urn is not None and known_urn == urn else 0
    return [v[f] for f in FUNCTIONS]


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("raw", "title", "cited_urn", "pub_date", "urn", "paper_title", "surnames", "resource_url")
    for batch in batches:
        kept, codes = [], []
        for i, row in enumerate(zip(*(batch.column(n).to_pylist() for n in names))):
            raw, title, *_, paper_title, surnames, url = row
            if not held(raw if raw else title, paper_title, surnames or []):
                continue
            code = 0
            for x in votes(*row[:6], surnames or [], url):
                code = code * 3 + x + 1
            kept.append(i)
            codes.append(code)
        taken = pa.array(kept, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("ref").take(taken), batch.column("urn").take(taken), pa.array(codes, pa.int32())], names=["ref", "urn", "pattern"])


#: What the votes of a function weigh at the start of the fit.
START = {"title_same": 3.0}


def fit_label_model(patterns: dict[int, int], rounds: int = 50, smooth: float = 1.0) -> dict[int, float]:
    """Posterior of a match for each vote pattern, from the patterns' counts.

    P(pattern | class) is a product over the groups of functions, with a free distribution over the joint votes of a group. The start is a sigmoid of the weighted sum of votes.
    """
    if not patterns:
        return {}
    codes = np.array(sorted(patterns))
    n = np.array([patterns[c] for c in codes.tolist()], float)
    digits = np.stack([codes // 3 ** (len(FUNCTIONS) - 1 - i) % 3 for i in range(len(FUNCTIONS))], axis=1)
    blocks, at = [], 0
    for g in GROUPS:
        blocks.append(sum(digits[:, at + i] * 3**i for i in range(len(g))))
        at += len(g)
    q = 1 / (1 + np.exp(-1.5 * (digits - 1) @ np.array([START.get(f, 1.0) for f in FUNCTIONS]) + 2.0))
    for _ in range(rounds):
        share = (n * q).sum() / n.sum()
        share = min(max(share, 1e-4), 1 - 1e-4)
        log_odds = np.full(len(codes), np.log(share / (1 - share)))
        for g, b in zip(GROUPS, blocks):
            k = 3 ** len(g)
            yes, no = np.bincount(b, n * q, k) + smooth, np.bincount(b, n * (1 - q), k) + smooth
            log_odds += np.log(yes / yes.sum())[b] - np.log(no / no.sum())[b]
        q = 1 / (1 + np.exp(-np.clip(log_odds, -50, 50)))
    return dict(zip(codes.tolist(), q.tolist()))


def index_papers(papers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(urn, index_key, kind, shared) and the keys that references are read by. Of the ``n`` words or runs of a title of which ``needed`` must be in a reference, the
    n - needed + shared that fewest papers of the peer share are indexed, words with each author; ``shared`` of these must be in the reference."""
    keys = papers.select("peer", "urn", "title").mapInArrow(_paper_keys, "urn string, kind int, index_key bigint, needed int")
    sizes = keys.groupBy("index_key").agg(F.count("*").alias("size"))
    own = Window.partitionBy("urn", F.col("kind") > 0)
    placed = keys.join(sizes, "index_key").withColumns({"rank": F.row_number().over(own.orderBy("size", "index_key")), "n": F.count("*").over(own), "shared": F.least("needed", F.lit(SHARED))})
    first = placed.where(F.col("rank") <= F.col("n") - F.col("needed") + F.col("shared"))
    prefix = cut_lineage(first.select("urn", (F.col("kind") > 0).cast("int").alias("kind"), "index_key", "shared"))
    authors = cut_lineage(papers.select("peer", "urn", "surnames").mapInArrow(_authors_of, "urn string, author bigint, author_key bigint"))
    words = prefix.where("kind = 0")
    joint = words.join(authors, "urn").select("urn", "index_key", "author", "shared").mapInArrow(_joint_keys, "urn string, index_key bigint, kind int, shared int")
    index = cut_lineage(joint.union(prefix.where("kind = 1").select("urn", "index_key", "kind", "shared")))
    read_by = index.select("index_key").union(words.select("index_key")).union(authors.select("author_key")).distinct()
    return index, read_by


def candidates(references: DataFrame, index: DataFrame, read_by: DataFrame) -> DataFrame:
    """(ref, urn) of references and papers of a peer that share enough indexed keys of a kind; every pair that ``held`` is true of is among them."""
    read_by = cut_lineage(read_by)
    known = key_filter(read_by, read_by.count())
    probes = references.select("peer", "ref", "raw", "title").mapInArrow(_reference_keys(known), "ref bigint, index_key bigint")
    of = lambda kind: F.count_if(F.col("kind") == kind) >= F.max(F.when(F.col("kind") == kind, F.col("shared")))
    enough = F.coalesce(of(0), F.lit(False)) | F.coalesce(of(1), F.lit(False))
    return probes.join(index, "index_key").groupBy("ref", "urn").agg(enough.alias("enough")).where("enough").select("ref", "urn")


def link(references: DataFrame, papers: DataFrame, authors: DataFrame) -> DataFrame:
    """(citing_urn, ref_pos, cited_urn, confidence) of every candidate, each once.

    ``references``: peer, citing_urn, ref_pos, raw, title, pub_date, cited_urn; ``papers``: peer, urn, title, resource_url; ``authors``: urn, author_pos,
    author_name. Repeated rows count once; rows with a null key or peer are ignored; all other columns may be null, a reference
    with neither raw text nor title has no candidates. Extra columns are ignored; an empty table gives no rows.
    """
    once = authors.where("urn is not null and author_name is not null").select("urn", "author_pos", F.col("author_name").alias("name")).dropDuplicates(["urn", "author_pos"])
    surnames = forms_of(once.groupBy("name").agg(F.count("*").alias("n"))).where("surname <> ''").select("name", "surname")
    names = once.join(surnames, "name")
    lists = names.groupBy("urn").agg(F.transform(F.sort_array(F.collect_list(F.struct("author_pos", "surname"))), lambda x: x["surname"]).alias("surnames"))
    known = papers.where("urn is not null and peer is not null").select("peer", "urn", "title", "resource_url").dropDuplicates(["urn"])
    described = cut_lineage(known.join(lists, "urn", "left"))
    index, read_by = index_papers(described)
    numbered = references.where("citing_urn is not null and ref_pos is not null and peer is not null").withColumn("ref", F.xxhash64("citing_urn", "ref_pos"))
    found = cut_lineage(candidates(numbered, index, read_by))
    payload = described.select("urn", F.col("title").alias("paper_title"), "surnames", "resource_url")
    printed = numbered.select("ref", "citing_urn", "ref_pos", "raw", "title", "pub_date", "cited_urn").join(found.select("ref").distinct(), "ref", "left_semi").dropDuplicates(["ref"])
    compared = found.join(payload, "urn").join(printed, "ref")
    voted = cut_lineage(compared.select("ref", "raw", "title", "cited_urn", "pub_date", "urn", "paper_title", "surnames", "resource_url").mapInArrow(_vote, "ref bigint, urn string, pattern int"))
    counts = {r.pattern: r.n for r in voted.groupBy("pattern").agg(F.count("*").alias("n")).collect()}
    posterior = fit_label_model(counts)
    spark = references.sparkSession
    table = spark.createDataFrame(sorted(posterior.items()), "pattern int, confidence double")
    # no more patterns than three to the number of functions
    scored = voted.join(F.broadcast(table), "pattern")
    return scored.join(printed.select("ref", "citing_urn", "ref_pos"), "ref").select("citing_urn", "ref_pos", F.col("urn").alias("cited_urn"), "confidence")
