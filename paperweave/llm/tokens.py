"""Token counts with a public byte-level vocabulary."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

#: Default vocabulary file; every executor must see the path that is given.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the splitting pattern that belongs to this family of vocabularies.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoder(vocabulary: str = VOCABULARY):
    """Once per Python worker."""
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


def token_lengths(texts: list[str | None], vocabulary: str = VOCABULARY) -> list[int]:
    """Tokens of each whole text; null counts as empty."""
    encode = encoder(vocabulary).encode_ordinary
    return [len(encode(t)) if t else 0 for t in texts]


def count_tokens(documents: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``documents`` with the text replaced by its ``n_tokens``; other columns stay."""
    rest = [c for c in documents.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = token_lengths(batch.column(len(rest)).to_pylist(), vocabulary)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(n, pa.int64())], names=[*rest, "n_tokens"])

    schema = documents.select(*rest).schema.add("n_tokens", "long")
    return documents.select(*rest, text).mapInArrow(run, schema)
