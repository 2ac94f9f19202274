"""Finding and repairing damage in text from scanned pages.

A frequency lexicon of all words is taken from the texts themselves. Each word that is many times rarer than another is a
possible misreading of it: both are reduced to a form in which characters that scanners confuse fall together, and a
symmetric-delete index (all forms with one character left out, on both sides) brings the candidates
together. A weighted edit distance, cheap for the known confusions, keeps the plausible ones, and where a word has several, the
counts of the word pairs around it decide. Words broken at line ends and running headers are found by their shape
and the lexicon.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperweave.plans.runtime import cut_lineage

#: What a scanner may print (left) for what stands there (right). Fixed values.
CONFUSIONS = [
    ("rn", "m"), ("m", "rn"), ("vv", "w"), ("cl", "d"), ("d", "cl"), ("ii", "u"), ("u", "ii"), ("li", "h"), ("h", "li"), ("in", "m"), ("m", "in"), ("ni", "m"), ("m", "ni"), ("nn", "m"), ("ri", "n"),
    ("0", "o"), ("1", "l"), ("1", "i"), ("!", "i"), ("!", "l"), ("|", "l"), ("|", "i"), ("5", "s"), ("9", "g"), ("6", "b"), ("8", "b"), ("2", "z"), ("q", "g"), ("9", "q"), ("3", "e"), ("4", "a"), ("7", "t"),
    ("c", "e"), ("e", "c"), ("o", "a"), ("a", "o"), ("o", "e"), ("e", "o"), ("c", "o"), ("o", "c"), ("f", "t"), ("t", "f"), ("l", "i"), ("i", "l"), ("i", "j"), ("j", "i"), ("b", "h"), ("h", "b"), ("n", "u"), ("u", "n"), ("l", "t"), ("v", "y"),
]
#: Forms shared by characters that are confused; several characters first. Fixed values that follow from CONFUSIONS.
MERGED = [("rn", "m"), ("vv", "w"), ("cl", "d"), ("ii", "n"), ("li", "b"), ("in", "m"), ("ni", "m"), ("nn", "m")]
SINGLE = str.maketrans({**dict.fromkeys("0oaec34", "o"), **dict.fromkeys("1li!|jtf7", "l"), **dict.fromkeys("5s", "s"), **dict.fromkeys("9gq", "g"), **dict.fromkeys("68bh", "b"), **dict.fromkeys("2z", "z"), **dict.fromkeys("nu", "n"), **dict.fromkeys("vy", "v")})
#: Letters that digits and signs are read for, put in before characters are merged. Fixed values that follow from CONFUSIONS.
LETTER = str.maketrans("01!|59682347", "olllsgbbzeat")
CHEAP = 0.3

WORD = re.compile(r"[^\W_]+(?:[!|][^\W_]+)*")
BREAK = re.compile(r"(?<![^\W\d_])([^\W\d_]++)(?:(-|‐)[ \t]*\n[ \t]*|([¬\xad])[ \t]*\n?[ \t]*|(-) )([^\W\d_]+)")
#: Running headers and page numbers, on a line or between form feeds or in the middle of a line.
HEADER = re.compile(
    r"""\x0c[^\x0c\n]*\x0c?
    | ^[ \t]*(?:Page|Seite|p\.|Página|S\.)?[ \t]*[-–—\[(]?[ \t]*\d{1,4}[ \t]*[-–—\])]?[ \t]*$
    | [ \t]*\bPage[ ]\d{1,4}\b[ \t]*
    | (?<=[a-zà-ÿ,])[ ](?:-[ ]\d{1,4}[ ]-|\[\d{1,4}\])(?=[ ]+[a-zà-ÿ])
    | [ \t]*(?:\b[A-Z][\w.]*[ ]){1,5}[A-Z]?\w*(?:,[ ][A-Z][a-z]{1,3}\.[ ]\d+)+[ \t]*
    | [ \t]*\b[^\W\d_][\w’'-]*[ ]et[ ]al\.[ ]/[ ][^\n/]{3,60}?[ ]\d+[ ]\(\d{4}\)[ ]\d+[-–]\d+[ \t]*
    | [ \t]*\b[A-Z][\w.]*(?:,?[ ][\w.]+){0,7}[ ]{3,}\d{1,4}\b[ \t]*
    | [ \t]*\b\d{1,4}[ ]{3,}(?:[A-Z]{2,}\b[ ]?){1,6}[ \t]*
    """,
    re.VERBOSE | re.MULTILINE,
)
#: Quick signs that the two patterns above may match; each holds wherever its pattern does.
MAY_BREAK = re.compile(r"[-‐][ \t]*\n|[¬\xad]|- ")
ISSUE = re.compile(r", [A-Z][a-z]{1,3}\. \d")
NUMBER_LINE = re.compile(r"\n[ \t]*(?:Page|Seite|p\.|Página|S\.)?[ \t]*[-–—\[(]?[ \t]*\d{1,4}[ \t]*[-–—\])]?[ \t]*(?:\n|$)")
HEADER_SIGNS = ("\x0c", "Page ", " al. / ", "   ", " - ", "[")
HEADING = re.compile(r"^(?:\d+(?:\.\d+)*\.?\s+\S.{0,60}|(?:Table|Figure|Fig\.|Tabelle|Abbildung|Tableau|Tabla|Figura)\s+\d+\..*)$")
FOUND = "kind string, key string, field string, pos int, word string, before string, after string, n bigint"


@lru_cache(maxsize=100_000)
def reduced(word: str) -> str:
    """The form in which confused characters fall together."""
    word = word.translate(LETTER)
    for a, b in MERGED:
        word = word.replace(a, b)
    return word.translate(SINGLE)


def deletions(word: str) -> set[str]:
    """Keys of a word in the symmetric-delete index: its reduced form, whole and, of words of usual length, with one character left out."""
    form = reduced(word)
    return {form} | ({form[:i] + form[i + 1 :] for i in range(len(form))} if 4 < len(form) <= 40 else set())


_TO = {}
for _seen, _meant in CONFUSIONS:
    _TO.setdefault((len(_seen), len(_meant)), set()).add((_seen, _meant))
_SIZES = sorted(_TO)


def reading_distance(seen: str, meant: str) -> float:
    """Edit distance from what was meant to what is seen; a known confusion costs CHEAP, any other edit 1."""
    rows = [[0.0] * (len(meant) + 1) for _ in range(len(seen) + 1)]
    for i in range(len(seen) + 1):
        for j in range(len(meant) + 1):
            if not i or not j:
                rows[i][j] = float(i + j)
                continue
            best = rows[i - 1][j - 1] if seen[i - 1] == meant[j - 1] else min(rows[i - 1][j - 1], rows[i - 1][j], rows[i][j - 1]) + 1
            for a, b in _SIZES:
                if i >= a and j >= b and rows[i - a][j - b] + CHEAP < best and (seen[i - a : i], meant[j - b : j]) in _TO[a, b]:
                    best = rows[i - a][j - b] + CHEAP
            rows[i][j] = best
    return rows[-1][-1]


def _may_have_header(text: str) -> bool:
    return any(sign in text for sign in HEADER_SIGNS) or ISSUE.search(text) is not None or NUMBER_LINE.search("\n" + text) is not None


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()

    def out() -> pa.RecordBatch:
        made = pa.record_batch({"word": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})
        seen.clear()
        return made

    for batch in batches:
        for column in batch.columns:
            for text in column.to_pylist():
                if text:
                    seen.update(WORD.findall(text.lower()))
        if len(seen) > 400_000:
            yield out()
    yield out()


def lexicon(texts: DataFrame) -> DataFrame:
    """(word, n) over all texts, lower-cased."""
    return texts.mapInArrow(_count_words, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: tuple[list, list, list] = ([], [], [])
        for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            keys = deletions(word)
            out[0].extend(keys)
            out[1].extend([word] * len(keys))
            out[2].extend([n] * len(keys))
        yield pa.record_batch({"index_key": pa.array(out[0], pa.string()), "word": pa.array(out[1], pa.string()), "n": pa.array(out[2], pa.int64())})


def _distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        costs = [reading_distance(a, b) for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(costs, pa.float64())], names=["word", "meant", "n", "meant_n", "cost"])


def corrections(words: DataFrame, ratio: int = 20, most_cost: float = 0.95) -> DataFrame:
    """(word, meant, n, meant_n, cost): candidates for every word that is ``ratio`` times rarer than the candidate.

    One confusion makes a given word out of another once in a hundred times at most, two confusions once in a
    thousand; what is more frequent (three above that) and holds no digit or sign is a word of its own.
    """
    index = "index_key string, word string, n bigint"
    entries = words.where((F.length("word") >= 4) & (F.col("n") >= ratio) & ~F.col("word").rlike(r"[0-9!|]")).mapInArrow(_keys, index)
    top = words.agg(F.max("n")).scalar()
    suspects = words.where((F.length("word") >= 4) & (F.col("n") * ratio <= top) & F.col("word").rlike(r"[^0-9]")).mapInArrow(_keys, index)
    e, s = entries.alias("e"), suspects.alias("s")
    near = (F.col("e.word") != F.col("s.word")) & (F.col("e.n") >= F.col("s.n") * ratio) & (F.abs(F.length("e.word") - F.length("s.word")) <= 2)
    pairs = s.join(e, (F.col("s.index_key") == F.col("e.index_key")) & near)
    distinct = pairs.select(F.col("s.word").alias("word"), F.col("e.word").alias("meant"), F.col("s.n").alias("n"), F.col("e.n").alias("meant_n")).distinct()
    by_chance = F.col("word").rlike(r"[0-9!|]") | (F.col("n") <= 3 + F.col("meant_n") / F.when(F.col("cost") <= 1.5 * CHEAP, 100).otherwise(1000))
    return distinct.mapInArrow(_distances, "word string, meant string, n bigint, meant_n bigint, cost double").where((F.col("cost") <= most_cost) & by_chance)


SUSPECT, CONTESTED = 1, 2


class _Flags(dict):
    """Word to what the scan does with it, worked out on first use: nothing with words of ``known``; of the others those count whose bit is set."""

    def __init__(self, known: frozenset, suspect: np.ndarray, contested: np.ndarray) -> None:
        self.known, self.bits = known, ((SUSPECT, suspect), (CONTESTED, contested))

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        code = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        flag = 0 if word in self.known else sum(f for f, bits in self.bits if bits[(at := code % (len(bits) * 8)) >> 3] >> (at & 7) & 1)
        self[word] = flag
        return flag


def word_bits(words: DataFrame, a_word: int = 32, most: int = 1 << 30) -> np.ndarray:
    """A bit for each of the words (word), ``a_word`` times as many bits as there are words and ``most`` at most: a fuller filter lets more words through, which a join drops.
    Packed words of bits reach the driver."""
    n = 1 << (min(most, max(1024, a_word * words.count())) - 1).bit_length()
    at = F.crc32(F.encode("word", "utf-8")) % n
    packed = words.select((at / 64).cast("bigint").alias("at"), F.expr("shiftleft(1L, cast(crc32(encode(word, 'utf-8')) % 64 as int))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(n // 64, np.int64)
    out[packed.column("at").to_numpy()] = packed.column("bits").to_numpy()
    return out.view(np.uint8)


def _scan(fields: list[str], known: frozenset, suspect: np.ndarray, contested: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: Counter = Counter()
        flags = _Flags(known, suspect, contested)

        def made(rows: list[tuple]) -> pa.RecordBatch:
            names, kinds = zip(*(c.split(" ") for c in FOUND.split(", ")))
            types = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}
            columns = list(zip(*rows)) or [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(c, types[k]) for c, k in zip(columns, kinds)], names=list(names))

        def join(rows: list[tuple], key: str, field: str, m: re.Match) -> str:
            a, b = m.group(1).lower(), m.group(5).lower()
            # a sign that only breaks words, or a second part to be looked up
            rows.append(("broken" if m.group(3) is not None else "joint", key, field, m.start(), a + b, a, b if len(b) > 1 and m.group(5)[0].islower() else None, 1))
            return m.group(1) + m.group(5)

        def take_pairs() -> list[tuple]:
            rows = [("pair", None, None, None, None, a, b, n) for (a, b), n in pairs.items()]
            pairs.clear()
            return rows

        for batch in batches:
            keys, *texts = (c.to_pylist() for c in batch.columns)
            rows: list[tuple] = []
            for field, column in zip(fields, texts):
                for key, text in zip(keys, column):
                    if not text:
                        continue
                    if _may_have_header(text):
                        heads: list[int] = []
                        cut = HEADER.sub(lambda m: heads.append(m.start()) or " ", text)
                        if heads:
                            rows.append(("header", key, field, heads[0], None, None, None, 1))
                            text = cut
                    if MAY_BREAK.search(text):
                        text = BREAK.sub(partial(join, rows, key, field), text)
                    words = WORD.findall(text.lower())
                    marks = list(map(flags.__getitem__, words))
                    if not any(marks):
                        continue
                    for i in [i for i, mark in enumerate(marks) if mark]:
                        w, before, after = words[i], words[i - 1] if i else "", words[i + 1] if i + 1 < len(words) else ""
                        if marks[i] & SUSPECT and len(w) > 3:
                            rows.append(("word", key, field, i, w, before, after, 1))
                        if marks[i] & CONTESTED:
                            if i and not marks[i - 1] & CONTESTED:
                                pairs[before, w] += 1
                            if i + 1 < len(words):
                                pairs[w, after] += 1
            if len(pairs) > 400_000:
                rows += take_pairs()
            if rows:
                yield made(rows)
        yield made(take_pairs())

    return run


class Scan:
    """Everything that is found in one collection; its parts are kept in the checkpoint folder.

    ``records``: one row per record; repeated rows count once, null keys are dropped, null and empty texts hold nothing, extra
    columns are ignored. ``known_words`` bounds the list of frequent words that every task gets, which only saves rows: no result depends on it.
    """

    def __init__(self, records: DataFrame, key: str, fields: list[str], known_words: int = 30_000, ratio: int = 20) -> None:
        self.key, self.fields, self.ratio = key, fields, ratio
        self.texts = records.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), *fields)
        self.words = cut_lineage(lexicon(self.texts.select(*fields)))
        self.candidates = cut_lineage(corrections(self.words, ratio))
        several = self.candidates.withColumn("rivals", F.count("*").over(Window.partitionBy("word"))).where("rivals > 1")
        suspects, contested = self.candidates.select("word").distinct(), cut_lineage(several.select(F.col("meant").alias("word")).distinct())
        plain = self.words.where(F.col("n") >= ratio).join(suspects.union(contested), "word", "left_anti").orderBy(F.desc("n"), "word").limit(known_words).select("word")
        known = frozenset(r.word for r in plain.collect())
        self.found = cut_lineage(self.texts.mapInArrow(_scan(fields, known, word_bits(suspects), word_bits(contested)), FOUND))

    def misread(self) -> DataFrame:
        """(key, field, pos, word, meant): misread words with the best candidate; rivals are told apart by cost, then by the word pairs around them."""
        pairs = self.found.where("kind = 'pair'").groupBy("before", "after").agg(F.sum("n").alias("n"))
        occurrences = self.found.where("kind = 'word'").select("key", "field", "pos", "word", "before", "after").dropDuplicates(["key", "field", "pos", "word"])
        rivals = self.candidates.groupBy("word").agg(F.sort_array(F.collect_list(F.struct("cost", "meant", "meant_n"))).alias("rivals"))
        joined = occurrences.join(rivals, "word")
        single = joined.where(F.size("rivals") == 1).select("key", "field", "pos", "word", F.col("rivals")[0]["meant"].alias("meant"))
        many = joined.where(F.size("rivals") > 1).select("key", "field", "pos", "word", "before", "after", F.explode("rivals").alias("r")).select("key", "field", "pos", "word", "before", "after", "r.*")
        left = pairs.select(F.col("before").alias("l0"), F.col("after").alias("l1"), F.col("n").alias("left_n"))
        right = pairs.select(F.col("before").alias("r0"), F.col("after").alias("r1"), F.col("n").alias("right_n"))
        in_context = many.join(left, (F.col("before") == F.col("l0")) & (F.col("meant") == F.col("l1")), "left").join(right, (F.col("after") == F.col("r1")) & (F.col("meant") == F.col("r0")), "left")
        score = F.log1p(F.coalesce("left_n", F.lit(0))) + F.log1p(F.coalesce("right_n", F.lit(0))) + 0.1 * F.log1p("meant_n") - 6 * F.col("cost")
        chosen = in_context.groupBy("key", "field", "pos", "word").agg(F.max_by("meant", F.struct(score, "meant")).alias("meant"))
        return single.unionByName(chosen)

    def broken(self) -> DataFrame:
        """(key, field, pos, word): words broken by a hyphen that is not their own: the whole is a word of the lexicon, or the second part, in small letters, is none that is at all usual."""
        sure = self.found.where("kind = 'broken'").select("key", "field", "pos", "word")
        joint = self.found.where("kind = 'joint'").select("key", "field", "pos", "word", F.col("after").alias("part"))
        whole = self.words.select("word", F.lit(True).alias("is_word"))
        usual = self.words.where(F.col("n") >= self.ratio).select(F.col("word").alias("part"), F.lit(True).alias("is_usual"))
        judged = joint.join(whole, "word", "left").join(usual, "part", "left").where(F.col("is_word").isNotNull() | (F.col("part").isNotNull() & F.col("is_usual").isNull()))
        return sure.unionByName(judged.select("key", "field", "pos", "word"))

    def damage(self) -> DataFrame:
        """(key, field, headers, broken, misread) of every damaged field. Misread words count as damage if there are two different ones, or one that holds
        a digit or sign: one alone may be a typing slip."""
        weight = F.when(F.col("word").rlike(r"[0-9!|]"), 2).otherwise(1)
        parts = (
            self.found.where("kind = 'header'").groupBy("key", "field").agg(F.count_distinct("pos").alias("headers")).withColumns({"broken": F.lit(0), "misread": F.lit(0), "weight": F.lit(0)}),
            self.broken().groupBy("key", "field").agg(F.count_distinct("pos").alias("broken")).withColumns({"headers": F.lit(0), "misread": F.lit(0), "weight": F.lit(0)}),
            self.misread().select("key", "field", "word").distinct().withColumn("weight", weight).groupBy("key", "field").agg(F.count("*").alias("misread"), F.sum("weight").alias("weight")).withColumns({"headers": F.lit(0), "broken": F.lit(0)}),
        )
        columns = ["key", "field", "headers", "broken", "misread", "weight"]
        total = parts[0].select(columns).union(parts[1].select(columns)).union(parts[2].select(columns)).groupBy("key", "field").agg(*(F.sum(c).alias(c) for c in columns[2:]))
        return total.where("headers > 0 or broken > 0 or weight > 1").drop("weight")

    def repaired(self) -> DataFrame:
        """(key, field, found, repaired) of every damaged field."""
        long = self.texts.select("key", F.explode(F.create_map(*(x for f in self.fields for x in (F.lit(f), F.col(f))))).alias("field", "found")).dropDuplicates(["key", "field"])
        fixes = self.misread().groupBy("key", "field").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct(F.concat_ws("#", "pos", "word"), "meant")))).alias("fixes"))
        joints = self.broken().groupBy("key", "field").agg(F.collect_set("word").alias("joints"))
        damaged = self.damage().select("key", "field")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found, by_place, broken = (batch.column(i).to_pylist() for i in (2, 3, 4))
                texts = [repair(t, dict(f or ()), set(b or ())) for t, f, b in zip(found, by_place, broken)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(texts, pa.string())], names=["key", "field", "found", "repaired"])

        joined = damaged.join(long, ["key", "field"]).join(fixes, ["key", "field"], "left").join(joints, ["key", "field"], "left")
        return joined.select("key", "field", "found", "fixes", "joints").mapInArrow(run, "key string, field string, found string, repaired string")


def repair(text: str | None, fixes: dict[str, str], joints: set[str]) -> str | None:
    """Continuous paragraphs: headers dropped, broken words joined, misread words replaced, lines joined.

    ``fixes``: what was meant, by place and word as numbered by the scan; ``joints``: broken words, joined.
    """
    if not text:
        return text
    text = HEADER.sub(" ", text)
    number = iter(range(len(text) + 1))

    def put(m: re.Match) -> str:
        meant = fixes.get(f"{next(number)}#{m.group(0).lower()}")
        if meant is None:
            return m.group(0)
        return meant.upper() if m.group(0).isupper() else meant[:1].upper() + meant[1:] if m.group(0)[0].isupper() else meant

    # the scan numbers words in the text with all breaks joined; the breaks that are no damage come back afterwards
    joined = BREAK.sub(lambda m: m.group(1) + m.group(5) if (m.group(1) + m.group(5)).lower() in joints else f"{m.group(1)}{chr(2) if m.group(4) else chr(1)}{m.group(5)}", text)
    kept = []
    words = re.compile(WORD.pattern.replace(r"[^\W_]+", "[^\\W_](?:[^\\W_]|[\x01\x02](?=[^\\W_]))*", 1))

    def put_whole(m: re.Match) -> str:
        if "\x01" in m.group(0) or "\x02" in m.group(0):
            next(number)
            return m.group(0)
        return put(m)

    for line in words.sub(put_whole, joined).replace("\x01", "-").replace("\x02", "- ").split("\n"):
        line = re.sub(r"[ \t]+", " ", line).strip()
        if kept and kept[-1] and line and not HEADING.match(line) and not HEADING.match(kept[-1]) and (not re.search(r"[.!?:]$", kept[-1]) or line[0].islower()):
            kept[-1] += " " + line
        elif line:
            kept.append(line)
    return "\n".join(kept)
