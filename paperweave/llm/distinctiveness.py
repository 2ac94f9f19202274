"""How distinctive a term is for a record: degree in the record's graph of words times rarity.

The terms of a field form a graph: two different terms are neighbours if they stand within ``window``
positions of each other. A term's weight in a record is its number of distinct neighbours, which grows with the
variety of its contexts rather than with repetition, times ln(N / records that hold the term).
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperweave.llm.words import terms_of
from paperweave.plans.runtime import distinct_by


def _graph_of_words(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            keys, *texts = (c.to_pylist() for c in batch.columns)
            for key, *fields in zip(keys, *texts):
                seen: Counter = Counter()
                near: dict[str, set] = defaultdict(set)
                for field in fields:
                    own = terms_of(field)
                    seen.update(own)
                    for ahead in range(1, window):
                        for a, b in zip(own, own[ahead:]):
                            near[a].add(b)
                            near[b].add(a)
                out[0].extend([key] * len(seen))
                out[1].extend(seen)
                out[2].extend(seen.values())
                out[3].extend(len(near[t] - {t}) if t in near else 0 for t in seen)
            yield pa.record_batch({"key": pa.array(out[0], pa.string()), "term": pa.array(out[1], pa.string()), "tf": pa.array(out[2], pa.int32()), "degree": pa.array(out[3], pa.int32())})

    return run


def _record_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms of the records of a task with the number of those records, for the count before the shuffle."""
    held: Counter = Counter()
    for batch in batches:
        for fields in zip(*(c.to_pylist() for c in batch.columns)):
            held.update({t for field in fields for t in terms_of(field)})
        if len(held) > 400_000:
            yield pa.record_batch({"term": pa.array(list(held), pa.string()), "records": pa.array(list(held.values()), pa.int64())})
            held.clear()
    yield pa.record_batch({"term": pa.array(list(held), pa.string()), "records": pa.array(list(held.values()), pa.int64())})


def score_terms(records: DataFrame, key: str, texts: list[str], window: int = 4, tf_at_least: int = 1) -> DataFrame:
    """(key, term, tf, degree, records, score) for every term of every record.

    Rows with an equal ``key`` count once and rows with a null key not at all; null texts count as empty;
    fields are never run together, and neither are their graphs. ``tf_at_least`` keeps a record's terms of at least
    that frequency; record counts are over all terms all the same. A frequent term is spread by adaptive
    skew handling in the join on the term. An empty table gives no rows.
    """
    once = distinct_by(records.select(F.col(key).cast("string").alias("__key"), *texts), "__key")
    scored = once.mapInArrow(_graph_of_words(window), "key string, term string, tf int, degree int").where(F.col("tf") >= tf_at_least)
    held = once.select(*texts).mapInArrow(_record_terms, "term string, records bigint").groupBy("term").agg(F.sum("records").alias("records"))
    n_records = records.where(F.col(key).isNotNull()).agg(F.count_distinct(key)).scalar()
    score = F.col("degree") * F.log(n_records / F.col("records"))
    return scored.join(held, "term").select(F.col("key").alias(key), "term", "tf", "degree", "records", score.alias("score"))
