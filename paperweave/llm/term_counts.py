"""Frequency of every term and word n-gram over a collection, in the suffix-sorting manner.

Each record emits, for every term position, the suffix that starts there, cut after ``max_terms``
terms. Suffixes are routed by their first term, sorted in descending (reverse lexicographic) order, and
one pass with a stack adds up the counts of all prefixes, so that n-grams of every length up to
``max_terms`` come from one shuffle of suffixes.

Record sets are kept as first-occurrence marks instead of lists of ids: mark k of a suffix counts the
records in which this very position is the first to hold the suffix's first k terms. A record then
contributes exactly one mark to each n-gram that it contains, so marks are additive, can be combined before the
shuffle, and their sum is the size of the record set, whatever share of the records holds a term.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperweave.llm.words import terms_of
from paperweave.plans.runtime import distinct_by

#: Terms and distinct terms that a task takes together before it passes their suffixes on.
FLUSH_AT, MOST_TERMS = 1_500_000, 1_000_000


class _Numbers(dict):
    """Term to number, in the order of first use; 0 stands for no term."""

    def __missing__(self, term: str) -> int:
        self[term] = number = len(self) + 1
        return number


def _suffixes(max_terms: int, spread: int):
    def made(numbers: _Numbers, flat: list[int], lengths: list[int], owners: list[int]) -> pa.RecordBatch:
        """Distinct suffixes of a chunk of texts, with their counts and marks; ``route`` is made of the first term and, in part, the second."""
        term = np.asarray(flat, np.int64)
        left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(term))
        record = np.repeat(np.asarray(owners, np.int64), lengths)
        # the suffix at every position, column by column, and its number among the suffixes of k terms
        columns = [np.where(left > k, np.append(term[k:], np.zeros(min(k, len(term)), np.int64)), 0) for k in range(max_terms)]
        place, marked = np.zeros(len(term), np.int64), []
        for k in range(max_terms):
            place = np.unique(place * (len(numbers) + 1) + columns[k], return_inverse=True)[1]
            # the earliest position of a record counts, and an earlier field comes first
            first = np.unique(record * (place.max() + 1) + place, return_index=True)[1]
            marked.append(first[left[first] > k])
        occurrences = np.bincount(place)
        at = np.empty(len(occurrences), np.int64)
        at[place] = np.arange(len(place))
        marks = np.stack([np.bincount(place[m], minlength=len(occurrences)) for m in marked], axis=1)
        words = pa.array(["", *numbers], pa.string())
        parts = [words.take(pa.array(c[at])) for c in columns]
        suffix = pc.utf8_rtrim_whitespace(pc.binary_join_element_wise(*parts, " "))
        hashes = np.array([zlib.crc32(w.encode()) for w in ("", *numbers)], np.int64)
        route = hashes[columns[0][at]] * spread + (hashes[columns[1][at]] % spread if max_terms > 1 else 0)
        return pa.record_batch({"route": pa.array(route), "suffix": suffix, "occurrences": pa.array(occurrences), **{f"mark{k}": pa.array(marks[:, k].astype(np.int32)) for k in range(max_terms)}})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, flat, lengths, owners = _Numbers(), [], [], []
        record = 0
        for batch in batches:
            for fields in zip(*(c.to_pylist() for c in batch.columns)):
                record += 1
                for field in fields:
                    if own := terms_of(field):
                        flat.extend(map(numbers.__getitem__, own))
                        lengths.append(len(own))
                        owners.append(record)
                if len(flat) > FLUSH_AT or len(numbers) > MOST_TERMS:
                    yield made(numbers, flat, lengths, owners)
                    numbers, flat, lengths, owners, record = _Numbers(), [], [], [], 0
        if flat:
            yield made(numbers, flat, lengths, owners)

    return run


def _add_prefixes(max_terms: int):
    """One pass over suffixes in descending order. An n-gram stays open on the stack as long as the suffixes begin with it; a level of the
    stack is a run of rows, and the counts of a run are added up as it closes. What is open at a batch's end is closed there and goes on in the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            split = pc.split_pattern(batch.column("suffix"), " ")
            begin = split.offsets.to_numpy()
            length = np.diff(begin)
            words = split.values.dictionary_encode()
            code, vocabulary = words.indices.to_numpy(), words.dictionary
            seen = batch.column("occurrences").to_numpy()
            closed = np.ones(batch.num_rows, bool)
            closed[1:] = False
            parts: list[pa.Array] = []
            for k in range(max_terms):
                has = length > k
                own = np.where(has, code[np.minimum(begin[:-1] + k, len(code) - 1)], -1)
                closed[1:] |= own[1:] != own[:-1]
                start = np.flatnonzero(closed)
                kept = has[start]
                parts = [vocabulary.take(pa.array(c[start[kept]])) for c in ([*columns, own] if k else [own])]
                columns = [*columns, own] if k else [own]
                ngram = pc.binary_join_element_wise(*parts, " ") if k else parts[0]
                yield pa.record_batch(
                    {
                        "ngram": ngram,
                        "n_terms": pa.array(np.full(int(kept.sum()), k + 1, np.int32)),
                        "occurrences": pa.array(np.add.reduceat(np.where(has, seen, 0), start)[kept]),
                        "records": pa.array(np.add.reduceat(np.where(has, batch.column(f"mark{k}").to_numpy(), 0).astype(np.int64), start)[kept]),
                    }
                )

    return run


def count_ngrams(records: DataFrame, key: str, texts: list[str], max_terms: int = 3, spread: int = 16) -> DataFrame:
    """Occurrences and record count of every word n-gram of up to ``max_terms`` terms.

    ``records``: one row per record once rows with an equal ``key`` are dropped; further columns are
    ignored. Null texts count as empty, n-grams never run from one text into the next, rows with a null key are
    dropped. A frequent first term is spread over ``spread`` routes by its second term; its one-term prefix
    is then added up over the routes. Returns (ngram, n_terms, occurrences, records); an empty table gives none.
    """
    if max_terms < 1:
        raise ValueError("max_terms must be 1 or more")
    once = distinct_by(records.select(key, *texts), key).select(*texts)
    marks = "".join(f", mark{k} int" for k in range(max_terms))
    suffixes = once.mapInArrow(_suffixes(max_terms, spread), f"route bigint, suffix string, occurrences bigint{marks}")
    routed = suffixes.repartition("route").sortWithinPartitions(F.col("suffix").desc())
    open_ngrams = routed.mapInArrow(_add_prefixes(max_terms), "ngram string, n_terms int, occurrences bigint, records bigint")
    return open_ngrams.groupBy("ngram", "n_terms").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def mark_terms(records: DataFrame, key: str, texts: list[str], max_terms: int = 3, rare_below: int = 3, common_above: float = 1 / 3) -> DataFrame:
    """``count_ngrams`` with a ``mark``: ``rare`` when fewer than ``rare_below`` records hold the n-gram,
    ``common`` when more than the share ``common_above`` of all records do, else null."""
    n_records = records.where(F.col(key).isNotNull()).agg(F.count_distinct(key)).scalar()
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") > n_records * F.lit(common_above), "common")
    return count_ngrams(records, key, texts, max_terms).withColumn("mark", mark)
