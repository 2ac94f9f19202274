"""Finding and restoring text that was decoded with the wrong character encoding.

Every distinct word with a character beyond ASCII is counted over all records. The clean ones among them
are written out in the garbled forms that each chain of a wrong decoding would give, and the words of the
records are hash-joined with that table. A form is accepted only if it is verified: the word must be oddly shaped as it
stands, or no longer text at all, or clearly rarer than the original that it would stand for. Words that never occur
clean, as most invented names do, are checked against the same forms of single clean characters: if one chain's
forms make up everything beyond ASCII in a word, the originals are put in.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Chains of (written as, read as). The code pages in which such texts were commonly written or read.
CHAINS: dict[str, list[tuple[str, str]]] = {
    **{f"utf-8>{page}": [("utf-8", page)] for page in ("cp1252", "latin-1", "cp1250", "iso8859-2", "cp1251", "cp437", "cp850", "mac_roman", "cp1254", "iso8859-15", "cp1253", "koi8-r", "cp866")},
    **{f"utf-8>{page}>utf-8>{again}": [("utf-8", page), ("utf-8", again)] for page in ("cp1252", "latin-1") for again in ("cp1252", "latin-1")},
    **{f"{page}>{other}": [(page, other)] for page, other in (("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "mac_roman"), ("cp1252", "cp1250"), ("cp1252", "cp1251"), ("mac_roman", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("iso8859-2", "cp1252"), ("cp1250", "cp1252"), ("cp1251", "cp1252"), ("iso8859-2", "cp437"), ("cp1250", "mac_roman"), ("cp1250", "cp437"), ("cp1250", "cp850"))},
    "cp1252>lost": [("cp1252", "lost")],
    "utf-8>lost": [("utf-8", "lost")],
}
LOST = "�"
#: Typography beyond ASCII that clean text holds. Fixed values.
#: The not sign and the soft hyphen among them end a line of scanned text.
MARKS = "¬\xad«»“”„‘’‚‹›–—…°±µμ×÷≤≥≠≈€£§©®¿¡·•²³½¼¾¹ºª†‡™→∞√∂∑ﬁﬂﬀﬃﬄ"
#: Signs that stand at the edge of a word without belonging to it.
EDGE = " \t.,;:!?()[]{}\"'*/|<>=+#&%~^`_-"
SPACED = re.compile(r"[^ \t\r\n\x0b\x0c]+")
BEYOND = re.compile(r"[^\x00-\x7f]")
CONTROL = re.compile(r"[\x80-\x9f\xad]")


@lru_cache(maxsize=None)
def _page(name: str) -> tuple[dict[int, str], dict[str, int]]:
    """Byte to character and back; bytes without a character stand for the control character of that number."""
    read = {b: bytes([b]).decode(name, errors="ignore") or chr(b) for b in range(256)}
    return read, {c: b for b, c in reversed(read.items())}


def garble(text: str, chain: str) -> str | None:
    """What ``text`` looks like after the chain; None if it can't be written in the chain's first encoding."""
    for wrote, read in CHAINS[chain]:
        if wrote == "utf-8":
            try:
                raw = text.encode()
            except UnicodeEncodeError:
                return None
        else:
            back = _page(wrote)[1]
            if any(c not in back for c in text):
                return None
            raw = bytes(back[c] for c in text)
        text = "".join(chr(b) if b < 128 else LOST for b in raw) if read == "lost" else "".join(_page(read)[0][b] for b in raw)
    return text


def _kind(c: str) -> str:
    """L Latin, G Greek, C Cyrillic letter, M mark, X anything that clean text would not hold."""
    if c in MARKS or c < "\x80":
        return "M"
    name = unicodedata.name(c, "")
    return next((k for k, script in (("L", "LATIN"), ("G", "GREEK"), ("C", "CYRILLIC")) if name.startswith(script)), "X") if c.isalpha() else "X"


def odd(word: str) -> bool:
    """Shapes that clean words do not have: scripts mixed with letters of ASCII, an accented capital after a
    small letter, signs of tables or mathematics at a letter."""
    kinds = {_kind(c) for c in word if c >= "\x80"}
    letters = any(c.isascii() and c.isalpha() for c in word)
    if "X" in kinds or len(kinds & {"L", "G", "C"}) > 1:
        return True
    for a, b in zip(word, word[1:]):
        if b >= "\x80" and _kind(b) == "L" and b.isupper() and a.islower():
            return True
        if letters and (_kind(b) in "GC" and a.isascii() and a.isalpha() or _kind(a) in "GC" and b.isascii() and b.isalpha()):
            return True
        if (b in "≤≥≠≈√∂∑∞†‡‰÷™£€¿¡©®§±°" and a.isalpha()) or (a in "≤≥≠≈√∂∑∞†‡‰÷™£©®§" and b.isalpha() and b.isascii()):
            return True
    return False


def _words(text: str | None) -> set[str]:
    if not text or text.isascii():
        return set()
    return {w for w in (x.strip(EDGE) for x in SPACED.findall(text)) if not w.rstrip("¬\xad").isascii()}


def _words_of(fields: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, *texts = (c.to_pylist() for c in batch.columns)
            rows = [(k, f, w) for f, column in zip(fields, texts) for k, text in zip(keys, column) for w in sorted(_words(text))]
            yield pa.record_batch({n: pa.array([r[i] for r in rows], pa.string()) for i, n in enumerate(("key", "field", "word"))})

    return run


def _cases(word: str) -> set[str]:
    return {word, word.lower(), word.upper(), word[:1].upper() + word[1:]}


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Garbled forms of clean words, in the cases in which they are written."""
    for batch in batches:
        rows = []
        for word, n in zip(*(c.to_pylist() for c in batch.columns)):
            if odd(word) or LOST in word or _by_characters(word):
                continue
            for own in _cases(word):
                for chain in CHAINS:
                    form = garble(own, chain)
                    if not form or form == own or form.isascii():
                        continue
                    # control characters are often dropped and soft hyphens made plain on the way
                    for seen in {form, CONTROL.sub("", form), form.replace("\xad", "-")}:
                        if (seen := seen.strip(EDGE + "\xa0")) != word and not seen.isascii():
                            rows.append((seen, own, chain, n))
        yield pa.record_batch(
            {"form": pa.array([r[0] for r in rows], pa.string()), "original": pa.array([r[1] for r in rows], pa.string()), "chain": pa.array([r[2] for r in rows], pa.string()), "clean_n": pa.array([r[3] for r in rows], pa.int64())}
        )


@lru_cache(maxsize=1)
def _units() -> dict[str, dict[str, str]]:
    """By chain, garbled form of each clean character beyond ASCII: Latin, Greek and Cyrillic letters and marks."""
    clean = [chr(c) for c in [*range(0xA1, 0x180), 0x218, 0x219, 0x21A, 0x21B, *range(0x391, 0x3CF), *range(0x410, 0x450)] if _kind(chr(c)) in "LGCM"] + list(MARKS)
    out: dict[str, dict[str, str]] = {}
    for chain in CHAINS:
        if not chain.endswith("lost"):
            own = out[chain] = {}
            for c in clean:
                if (form := garble(c, chain)) and form != c:
                    own.setdefault(form, c)
    return out


@lru_cache(maxsize=1)
def _unit_patterns() -> dict[str, re.Pattern]:
    return {chain: re.compile("|".join(re.escape(f) for f in sorted(own, key=lambda f: (-len(f), f)))) for chain, own in _units().items()}


@lru_cache(maxsize=100_000)
def _by_characters(word: str) -> tuple[str, str] | None:
    """(original, chain) if one chain's forms of clean characters make up all that the word holds beyond ASCII.

    Chains from UTF-8 give several characters for one and are telling by themselves; single-byte chains count
    only for a word of an odd shape which the change makes regular.
    """
    strange = odd(word)
    for chain, pattern in _unit_patterns().items():
        if not chain.startswith("utf-8") and not strange:
            continue
        own = _units()[chain]
        bare = pattern.sub("", word)
        if not bare.isascii() and not (chain.startswith("utf-8") and set(BEYOND.findall(bare)) <= set("ÃÂ\xa0")):
            continue
        original = pattern.sub(lambda m: own[m.group(0)], word)
        if original != word and not odd(original) and (chain.startswith("utf-8") or sum(map(str.isupper, original[1:])) < 2):
            return original, chain
    return None


@lru_cache(maxsize=1)
def _sure() -> re.Pattern:
    """Forms of letters read from UTF-8 as Western European, of two and more characters."""
    forms = {f for page in ("cp1252", "latin-1") for f, c in _units()[f"utf-8>{page}"].items() if len(f) > 1 and c.isalpha()}
    return re.compile("|".join(map(re.escape, sorted(forms))))


def _partly(word: str) -> bool:
    """Garbled beyond repair: some characters of the word are forms, others were lost on the way."""
    return _sure().search(word) is not None


def _odd_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for word, n in zip(*(c.to_pylist() for c in batch.columns)):
            by_characters = _by_characters(word)
            rows.append((word, n, odd(word) or by_characters is not None, LOST in word or _partly(word), *(by_characters or (None, None))))
        names = ("word", "n", "strange", "lost", "by_characters", "by_chain")
        types = (pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.string(), pa.string())
        yield pa.record_batch({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(zip(names, types))})


def garbled_words(words: DataFrame, rarer_by: float = 3.0) -> DataFrame:
    """(word, original, chain) for every garbled word of ``words`` (key, field, word); original is null where
    characters were lost and no clean word tells which."""
    # distinct words are few bytes but long work: spread by number, as adaptive execution would put them into one task by their size,
    # and by a hash, as the planner drops a repartition by what the aggregate is partitioned by already
    tasks = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = words.groupBy("word").agg(F.count("*").alias("n")).repartition(tasks, F.xxhash64("word"))
    judged = counts.mapInArrow(_odd_words, "word string, n bigint, strange boolean, lost boolean, by_characters string, by_chain string")
    forms = counts.mapInArrow(_forms, "form string, original string, chain string, clean_n bigint")
    best = forms.groupBy("form").agg(F.max_by(F.struct("original", "chain", "clean_n"), F.struct("clean_n", "chain", "original")).alias("best"))
    joined = judged.join(best, judged["word"] == best["form"], "left")
    verified = F.col("best").isNotNull() & (F.col("strange") | F.col("lost") | (F.col("best.clean_n") >= rarer_by * F.col("n")))
    known = F.when(verified, F.struct(F.col("best.original").alias("original"), F.col("best.chain").alias("chain"))).when(
        F.col("by_characters").isNotNull(), F.struct(F.col("by_characters").alias("original"), F.col("by_chain").alias("chain"))
    )
    return joined.withColumn("known", known).where(F.col("known").isNotNull() | F.col("lost")).select("word", "known.original", "known.chain")


def find_garbled(records: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, fixes) for every field that holds garbled words, with ``fixes`` an array of (word, original, chain).

    Repeated rows count once; null keys are dropped; null and empty texts hold nothing; whole texts are read. Extra columns are
    ignored. An empty table gives no rows.
    """
    keyed = records.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), *fields)
    words = keyed.mapInArrow(_words_of(fields), "key string, field string, word string").distinct()
    found = words.join(garbled_words(words), "word")
    return found.groupBy("key", "field").agg(F.sort_array(F.collect_list(F.struct("word", "original", "chain"))).alias("fixes")).withColumnRenamed("key", key)


def _restore(text: str | None, fixes: list[dict] | None) -> str | None:
    if not text or not fixes:
        return text
    known = {f["word"]: f["original"] for f in fixes if f["original"]}

    def put(found: re.Match) -> str:
        core = found.group(0).strip(EDGE)
        return found.group(0).replace(core, known[core], 1) if core in known else found.group(0)

    return SPACED.sub(put, text)


def restore(records: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, found, restored) of every garbled field: the text as it stands and with the originals put in."""
    long = records.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias(key), F.explode(F.create_map(*(x for f in fields for x in (F.lit(f), F.col(f))))).alias("field", "found")).dropDuplicates([key, "field"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, fixes = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(list(map(_restore, texts, fixes)), pa.string())], names=[key, "field", "found", "restored"])

    return long.join(find_garbled(records, key, fields), [key, "field"]).select(key, "field", "found", "fixes").mapInArrow(run, f"`{key}` string, field string, found string, restored string")
