"""Linking spellings of names that mean the same person or group.

Names are brought to a form of surname, given name and middle initials. Suffixes of the surname, and suffixes of the
given name together with the surname's beginning, index the forms; a suffix that too many forms share is not discarded before
it has been refined by the given name's initial. Pairs are compared by the ratio of their longest common subsequence.
Short forms of given names are learned from the collection itself: two given names that stand beside the same surnames far more often than chance would have it belong together, and
the rarer one is the short form.
Full names that agree are joined first; initials, cut-off and ambiguous short names join a person only if they
fit one, or one far better than all others.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperweave.operators.components import connected_components
from paperweave.plans.runtime import cut_lineage

#: Words that make a name that of a group. Fixed values.
GROUPS = ("study group", "working group", "research group", "collaboration", "consortium", "group", "team", "project", "network", "initiative")
TITLE = re.compile(r"^(?:(?:dr|prof|professor|mr|mrs|ms|sir|dipl|ing|by|and|von der redaktion)\.?\s+)+", re.IGNORECASE)
TAIL = re.compile(r"(?:\s*\((?:eds?|hrsg)\.?\)|[\s,]+(?:jr|sr|phd|ph\.d|md|ii|iii)\b\.?|[*†‡§,;\d\s])+$", re.IGNORECASE)
#: Ratio of the longest common subsequence from which two given names of one surname are slips of one.
ALIKE = 0.79
FORM = "name string, n bigint, kind string, surname string, given string, middle string"


class _Folded(dict):
    """Character to its lower-case form without accents, worked out on first use."""

    #: Letters that do not decompose, and their plain neighbours.
    PLAIN = dict(zip("łŁøØđĐßæÆœŒı", "lLoOdDsaAoOi"))

    def __missing__(self, code: int) -> str:
        c = chr(code)
        out = "".join(x for x in unicodedata.normalize("NFKD", self.PLAIN.get(c, c).lower()) if not unicodedata.combining(x))
        self[code] = out
        return out


FOLDED = _Folded()


def fold(text: str) -> str:
    """Lower case without accents."""
    return text.lower() if text.isascii() else text.translate(FOLDED)


def parts(name: str | None) -> tuple[str, list[str], list[str]]:
    """(kind, first part, second part): for ``comma`` surname and given tokens, for ``plain`` all tokens and none, for
    ``group`` the group's own words and its sort, for ``none`` nothing."""
    text = TAIL.sub("", TITLE.sub("", re.sub(r"\s+", " ", (name or "").replace("\xa0", " ")).strip()))
    low = fold(text)
    for group in GROUPS:
        spread = group.replace(" ", r"[\s-]+")
        if re.search(rf"(?:^|[\s-]){spread}(?:$|[\s-])", low):
            own = re.sub(rf"(?:^|[\s-]){spread}(?=$|[\s-])", " ", low)
            return "group", [w for w in re.split(r"[\s,-]+", own) if w and w not in ("the", "for", "of")], [group]
    text = re.sub(r"(?<=\w)- (?=\w)", "", low)
    cut = lambda t: [w for w in re.split(r"[\s.]+", re.sub(r"[’'`-]", "", t)) if w]
    if "," in text:
        surname, _, rest = text.partition(",")
        if cut(surname) and cut(rest.replace(".", ". ")):
            return "comma", cut(surname), cut(rest)
        text = text.replace(",", " ")
    return ("plain", cut(text), []) if cut(text) else ("none", [], [])


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Outer long tokens of plain names, each with the other's first letter."""
    for batch in batches:
        rows = []
        for name in batch.column(0).to_pylist():
            kind, tokens, given = parts(name)
            if kind == "comma":
                tokens = given + tokens
            if kind in ("plain", "comma") and len(long := [t for t in tokens if len(t) > 1]) > 1:
                rows += [(long[0], long[-1][0]), (long[-1], long[0][0])]
        yield pa.record_batch({"token": pa.array([r[0] for r in rows], pa.string()), "letter": pa.array([r[1] for r in rows], pa.string())})


def _outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        first, last = [], []
        for name in batch.column(0).to_pylist():
            kind, tokens, _ = parts(name)
            long = [t for t in tokens if len(t) > 1] if kind == "plain" else []
            first.append(long[0] if len(long) > 1 else None)
            last.append(long[-1] if len(long) > 1 else None)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first, pa.string()), pa.array(last, pa.string())], names=["name", "n", "first", "last"])


def _form(name: str, turned: bool) -> tuple[str, str, str, str]:
    """(kind, surname, given, middle)"""
    kind, a, b = parts(name)
    if kind == "group":
        return "group", "".join(a), b[0], ""
    if kind == "none":
        return "none", "", "", ""
    if kind == "comma":
        surname, rest = "".join(a), b
    else:
        long = [i for i, t in enumerate(a) if len(t) > 1]
        if len(a) == 1 or not long:
            return "person", "".join(a), "", ""
        if turned:
            at = long[-1]
            surname, rest = "".join(t for t in a[:at] if len(t) > 1), [a[at], *(t for i, t in enumerate(a) if len(t) == 1 and i != at)]
        else:
            # initials and one given name come first, whatever is left is the surname, be it in pieces
            start = next((i for i in range(1, len(a)) if len(a[i]) > 1), len(a) - 1)
            surname, rest = "".join(a[start:]), a[:start]
    given = rest[0] if rest else ""
    return "person", surname, given, "".join(t[0] for t in rest[1:])


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names, n, turned = (batch.column(i).to_pylist() for i in range(3))
        forms = [_form(x, bool(t)) for x, t in zip(names, turned)]
        yield pa.record_batch({"name": pa.array(names, pa.string()), "n": pa.array(n, pa.int64()), **{c: pa.array([f[i] for f in forms], pa.string()) for i, c in enumerate(("kind", "surname", "given", "middle"))}})


def forms_of(spellings: DataFrame) -> DataFrame:
    """(name, n, kind, surname, given, middle) of each distinct spelling. A plain name is read surname first if its last token goes with
    surnames of many initials, as given names do, and its first with few."""
    letters = spellings.select("name").mapInArrow(_ends, "token string, letter string").distinct().groupBy("token").agg(F.count("*").alias("letters"))
    outer = spellings.select("name", "n").mapInArrow(_outer, "name string, n bigint, first string, last string")
    joined = outer.join(letters.select(F.col("token").alias("first"), F.col("letters").alias("first_letters")), "first", "left").join(
        letters.select(F.col("token").alias("last"), F.col("letters").alias("last_letters")), "last", "left"
    )
    turned = (F.col("last_letters") >= 6) & (F.col("last_letters") >= 2 * F.col("first_letters"))
    return joined.select("name", "n", F.coalesce(turned, F.lit(False)).alias("turned")).mapInArrow(_forms, FORM)


def common_ratio(a: str, b: str) -> float:
    """Twice the longest common subsequence by the two lengths."""
    if a == b:
        return 1.0
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            keep = row[j]
            row[j] = diagonal + 1 if x == y else max(row[j], row[j - 1])
            diagonal = keep
    return 2 * row[-1] / (len(a) + len(b)) if a or b else 1.0


def relation(a: dict, b: dict) -> int:
    """2: the same full name; 1: it may be the same, as one is short; 0: different. ``full``: the full names that a given name is a short form of."""
    if a["kind"] != b["kind"]:
        return 0
    same = a["surname"] == b["surname"]
    n = max(len(a["surname"]), len(b["surname"]))
    if not same and (n < 6 or abs(len(a["surname"]) - len(b["surname"])) > 2 or common_ratio(a["surname"], b["surname"]) < (0.82 if n < 9 else 0.85)):
        return 0
    g, h = a["given"], b["given"]
    if a["kind"] == "group":
        return 2 if g == h else 0
    if a["middle"] and b["middle"] and a["middle"][0] != b["middle"][0]:
        return 0
    if not g or not h:
        return 0
    of_g, of_h = set(a["full"] or ()), set(b["full"] or ())
    if g == h:
        return 2 if len(g) > 1 and len(of_g) < 2 else 1 if same else 0
    if not same:
        return 0
    if len(g) > len(h):
        g, h, of_g, of_h = h, g, of_h, of_g
    if h in of_g or g in of_h:
        return 1 if len(of_g if h in of_g else of_h) > 1 else 2
    if h.startswith(g) and len(g) < max(2, len(h) - 1):
        return 1
    if of_g & of_h:
        return 1
    if len(g) > 3 and common_ratio(g, h) >= ALIKE:
        return 2
    return 1 if any(full.startswith(g) for full in of_h) else 0


def _unlike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that are no slips of each other."""
    for batch in batches:
        yield batch.filter(pa.array([common_ratio(a, b) < ALIKE for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())], pa.bool_()))


def short_forms(forms: DataFrame, least: int = 3, lift: float = 10.0) -> DataFrame:
    """(given, full): the full names of each short given name, learned from ``forms`` (kind, surname, given).

    A pair of given names counts if it shares at least ``least`` surnames, and ``lift`` times as many as it would by chance. Names that fewer surnames have are
    left out before any pair is made, which loses none.
    """
    held = forms.where("kind = 'person' and surname <> '' and length(given) > 1").select("surname", "given").distinct()
    counts = held.groupBy("given").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    usual = cut_lineage(held.join(counts, "given"))
    surnames = held.agg(F.count_distinct("surname")).scalar()
    short, full = usual.select("surname", "given", F.col("n").alias("short_n")), usual.select("surname", F.col("given").alias("full"), F.col("n").alias("full_n"))
    rarer = (F.col("short_n") < F.col("full_n")) | ((F.col("short_n") == F.col("full_n")) & (F.col("given") < F.col("full")))
    together = short.join(full, "surname").where(rarer).groupBy("given", "full", "short_n", "full_n").agg(F.count("*").alias("n"))
    kept = together.where((F.col("n") >= least) & (F.col("n") * surnames >= lift * F.col("short_n") * F.col("full_n")))
    return kept.select("given", "full").mapInArrow(_unlike, "given string, full string")


def _keys(shortest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for form, surname, given, full in zip(*(batch.column(c).to_pylist() for c in ("form", "surname", "given", "full"))):
                initials = sorted({given[:1], *(f[0] for f in full or ())})
                own = {f"s{surname[i:]}" for i in range(max(1, len(surname) - shortest + 1))}
                if len(given) > 3:
                    own |= {f"g{given[i:]}|{surname[:3]}" for i in range(len(given) - 3)} | {f"g{given[0]}|{surname[:5]}"}
                for key in own:
                    out[0].append(key)
                    out[1].append(form)
                    out[2].append(initials)
                    out[3].append(key == f"s{surname}")
                    out[4].append(given)
            yield pa.record_batch({"index_key": pa.array(out[0], pa.string()), "form": pa.array(out[1], pa.string()), "initials": pa.array(out[2], pa.list_(pa.string())), "whole": pa.array(out[3], pa.bool_()), "given": pa.array(out[4], pa.string())})

    return run


def _related(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [relation(a, b) for a, b in zip(batch.column("fa").to_pylist(), batch.column("fb").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(found, pa.int32())], names=["a", "b", "related"])


def candidate_pairs(forms: DataFrame, shortest: int = 5, common: int = 60) -> DataFrame:
    """(a, b) pairs of forms that share an index key. A suffix of more than ``common`` forms is refined by the initials of the given name and of what it is short for; of those, keys that are
    still too common and no whole surname are refined by the whole given name, which loses no pair: forms of different surnames are related only if
    their given names agree, and forms of one surname meet under it."""
    keys = cut_lineage(forms.mapInArrow(_keys(shortest), "index_key string, form string, initials array<string>, whole boolean, given string"))
    sizes = keys.groupBy("index_key").agg(F.count("*").alias("size"), F.max("whole").alias("kept"))
    rare = keys.join(sizes.where(F.col("size").between(2, common)).select("index_key"), "index_key").select("index_key", "form")
    frequent = keys.join(sizes.where(F.col("size") > common).select("index_key", "kept"), "index_key").select("index_key", "form", "kept", "given", F.explode("initials").alias("initial")).select(F.concat_ws("|", "index_key", "initial").alias("index_key"), "form", "kept", "given")
    refined_sizes = frequent.groupBy("index_key").agg(F.count("*").alias("size"))
    sized = frequent.join(refined_sizes, "index_key").where(F.col("size") > 1)
    refined = sized.select(F.when((F.col("size") <= common) | F.col("kept"), F.col("index_key")).otherwise(F.concat_ws("|", "index_key", F.coalesce("given", F.lit("")))).alias("index_key"), "form")
    index = rare.union(refined)
    left, right = index.select("index_key", F.col("form").alias("a")), index.select("index_key", F.col("form").alias("b"))
    return left.join(right, "index_key").where("a < b").select("a", "b").distinct()


def link_names(records: DataFrame, name: str = "author_name", clearly: float = 3.0, shortest: int = 5, common: int = 60) -> DataFrame:
    """(name, entity) for every distinct spelling; spellings of one entity share the entity, which is one of the forms.

    Names are compared as stored; null names are ignored; empty ones and those without letters stay alone. Repeated rows only count. ``clearly``: a short name
    that fits several people joins one that has so many times more rows than any other. An empty table gives no rows.
    """
    spellings = records.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("name")).agg(F.count("*").alias("n"))
    spelt = cut_lineage(forms_of(spellings).withColumn("form", F.when(F.col("kind") == "none", F.concat(F.lit("none|"), "name")).otherwise(F.concat_ws("|", "kind", "surname", "given", "middle"))))
    named = spelt.where("kind <> 'none'").groupBy("form", "kind", "surname", "given", "middle").agg(F.sum("n").alias("n"))
    full = short_forms(named).groupBy("given").agg(F.sort_array(F.collect_set("full")).alias("full"))
    forms = cut_lineage(named.join(full, "given", "left").withColumn("full", F.coalesce("full", F.array().cast("array<string>"))))
    pairs = candidate_pairs(forms, shortest, common)
    one = forms.select("form", F.struct("kind", "surname", "given", "middle", "full").alias("f"))
    compared = pairs.join(one.select(F.col("form").alias("a"), F.col("f").alias("fa")), "a").join(one.select(F.col("form").alias("b"), F.col("f").alias("fb")), "b")
    related = cut_lineage(compared.select("a", "b", "fa", "fb").mapInArrow(_related, "a string, b string, related int").where("related > 0"))
    # a full name's group: joined by relation 2 among forms; a form all of whose links are of relation 1 is a short one
    strong = connected_components(related.where("related = 2"))
    grouped = forms.join(strong.withColumnRenamed("node", "form"), "form", "left").select("form", "middle", "given", "full", "n", F.coalesce("component", "form").alias("person"))
    # initials, and short forms of more than one name: they may fit several people
    looks_short = grouped.withColumn("is_short", (F.length("given") <= 1) | (F.size("full") > 1))
    people = looks_short.groupBy("person").agg(F.min("is_short").alias("only_short"), F.sum("n").alias("weight"), F.count("*").alias("held"))
    member = cut_lineage(looks_short.join(people, "person"))
    both = related.where("related = 1").select("a", "b").union(related.where("related = 1").select("b", "a"))
    left = member.select(F.col("form").alias("a"), F.col("person").alias("pa"), F.col("middle").alias("ma"), F.col("given").alias("ga"), F.col("only_short").alias("sa"), F.col("weight").alias("wa"))
    right = member.select(F.col("form").alias("b"), F.col("person").alias("pb"), F.col("middle").alias("mb"), F.col("given").alias("gb"), F.col("only_short").alias("sb"), F.col("weight").alias("wb"))
    links = both.join(left, "a").join(right, "b").where("pa <> pb")
    # the shorter side of a link joins the longer one: initials join names, cut-off names join whole ones
    links = cut_lineage(links)
    joins = links.where("(sa and not sb) or (sa = sb and length(ga) < length(gb))").where("not (sb and not sa)")
    fits = joins.groupBy("pa", "pb").agg(F.max((F.col("ma") != "") & (F.col("ma") == F.col("mb"))).cast("int").alias("middle"), F.max("wb").alias("weight"))
    order = Window.partitionBy("pa").orderBy(F.desc("middle"), F.desc("weight"), "pb")
    ranked = fits.withColumn("rank", F.row_number().over(order)).withColumn("next_middle", F.lead("middle").over(order)).withColumn("next_weight", F.lead("weight").over(order))
    chosen = ranked.where("rank = 1").where(F.col("next_weight").isNull() | (F.col("middle") > F.col("next_middle")) | (F.col("weight") >= clearly * F.col("next_weight"))).select("pa", "pb")
    alike = links.where("sa and sb and ga = gb").select("pa", "pb").join(fits.select("pa").distinct(), "pa", "left_anti")
    final = connected_components(chosen.union(alike), "pa", "pb").withColumnRenamed("node", "person")
    entity = member.join(final, "person", "left").select("form", F.coalesce("component", "person").alias("entity"))
    return spelt.join(entity, "form", "left").select("name", F.coalesce("entity", "form").alias("entity"))


def spelling_pairs(linked: DataFrame) -> DataFrame:
    """(name_a, name_b) of every two spellings of one entity, the smaller by bytes first."""
    a, b = linked.select("entity", F.col("name").alias("name_a")), linked.select("entity", F.col("name").alias("name_b"))
    return a.join(b, "entity").where("name_a < name_b").select("name_a", "name_b")
