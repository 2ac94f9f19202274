"""Metadata from converted papers: is it a paper, its parts by page layout, its authors, its reference strings."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from paperweave.functions.text import SPACE, expand_ligatures, single_spaced

PARSED = "doc_id string, title string, authors array<string>, abstract string, body string, reference_text string"
#: Parts of words, with their case, that show that a line is no list of authors, and the length from which a piece of it is no name.
NO_AUTHORS = (
    "Berkeley", "College", "Computer", "Department", "Engineering", "IEEE", "Institute", "Laboratory", "Member",
    "Microsoft", "Netherlands", "Project", "Report", "Research", "School", "Science", "Technology", "Universit",
)
NAME_BELOW = 35
#: What stands between two names.
BETWEEN_NAMES = r"\s*,|\n+|\s+and\s+|^\s*and\s+|\s+AND\s+"


def paper_score(text: Column) -> Column:
    """How much a text looks like a paper: the parts that papers have, and whether the abstract comes early."""
    low = F.lower(text)
    head = F.substring(low, 1, 3000)
    has = lambda where, *words: _any(where.contains(w) for w in words)
    abstract = F.when(has(head, "abstract", "summary"), 2.0).when(has(low, "abstract", "summary"), 1.0).otherwise(0.0)
    introduction = F.when(has(low, "introduction"), 1.0).when(has(low, "ntroduction"), 0.5).otherwise(0.0)
    conclusion = F.when(has(low, "conclusion"), 1.0).when(has(low, "onclusion"), 0.5).otherwise(0.0)
    references = F.when(has(low, "references"), 1.0).when(has(low, "eferences"), 1.5).when(has(low, "bibliography"), 1.0).otherwise(0.0)
    return abstract + introduction + conclusion + references


def _any(conditions) -> Column:
    first, *rest = conditions
    for c in rest:
        first = first | c
    return first


def is_paper(text: Column) -> Column:
    return paper_score(text) > 1.99


def split_references(raw: str | None, longest: int = 350) -> list[str]:
    """Reference strings of a bibliography whose entries are marked [1] or 1.; the commoner marker is used, and none if both are equally common or
    if there are fewer than two. The list ends before an entry that is too long."""
    if not raw:
        return []
    styles = [[m.start() for m in re.finditer(p, raw)] for p in (r"\s*\[\d{1,2}\]", r" +\s*\d{1,2}\.\s+[A-Z]")]
    if len(styles[0]) == len(styles[1]):
        return []
    starts = max(styles, key=len)
    if len(starts) < 2:
        return []
    out = []
    for begin, end in zip(starts, [*starts[1:], len(raw) + 1]):
        piece = raw[begin : end - 1] if end <= len(raw) else raw[begin:]
        if len(piece) > longest:
            break
        out.append(re.sub(r"\s+", " ", piece).strip())
    return out


def author_names(line: str | None) -> list[str]:
    """Names in a line of authors; none if the line holds what names do not, or if a piece of it is not two or three words, the first and the last
    of which begin with a capital. Pieces that are too long are left out."""
    if not line or re.search("[0-9@&]", line) or any(w in line for w in NO_AUTHORS):
        return []
    pieces = [p for p in re.split(BETWEEN_NAMES, re.sub(r",\s*$", "", line, flags=re.ASCII), flags=re.ASCII) if 0 < len(p) < NAME_BELOW]
    words = [[w for w in re.split(SPACE, p) if w] for p in pieces]
    looks_right = all(2 <= len(w) <= 3 and "A" <= w[0][0] <= "Z" and "A" <= w[-1][0] <= "Z" for w in words)
    return [" ".join(w) for w in words] if looks_right else []


@F.pandas_udf(ArrayType(StringType()))
def split_references_udf(raw: pd.Series) -> pd.Series:
    return raw.map(split_references)


@F.pandas_udf(ArrayType(StringType()))
def author_names_udf(line: pd.Series) -> pd.Series:
    return line.map(author_names)


def with_final_stop(raw: Column) -> Column:
    return F.when(raw.endswith("."), raw).otherwise(F.concat(raw, F.lit(".")))


def label_reference(raw: Column) -> Column:
    """Title, authors, venue, pages and date of a printed reference, by the printed styles: quoted titles, dates in brackets, plain sentences.

    A rule-based stand-in for a trained labeller; what no style shows is null.
    """
    text = F.regexp_replace(raw, r"^\s*(?:\[\d{1,3}\]|\d{1,3}\.)\s*", "")
    part = lambda p, i=1: F.nullif(F.trim(F.regexp_extract(text, p, i)), F.lit(""))
    quoted, dated = part("[“\"]([^”\"]+?),?[”\"]"), part(r"\((?:\d{4}|n\.d\.)\)\.\s+(.+?[.?])\s+\p{Lu}")
    sentence = part(r"^.+?\p{L}{3,}\.\s+(.+?[.?])\s+\p{Lu}")
    title = F.regexp_replace(F.coalesce(quoted, dated, sentence), r"\.$", "")
    authors = F.coalesce(part("^(.+?),\\s*[“\"]"), part(r"^(.+?)\s*\((?:\d{4}|n\.d\.)\)"), part(r"^(.+?\p{L}{3,})\.\s"))
    venue = F.coalesce(part("[”\"],?\\s+in\\s+(.+?),"), part(r"((?:Proc|Journal|Trans|Annals|Quarterly|J\.|Q\.|Ann\.)[^,]*)"))
    return F.struct(title.alias("title"), F.split(authors, r",?\s+(?:and|&)\s+|(?<=\.),\s+|;\s*").alias("authors"), venue.alias("booktitle"), part(r"(\d+\s*(?:--|-|–)\s*\d+)").alias("pages"), part(r"\b((?:1[89]|20)\d\d)\b").alias("date"))


class _Layout(HTMLParser):
    """Reads absolutely positioned lines with their font sizes and sorts them into the parts of a paper, by states."""

    def __init__(self) -> None:
        super().__init__()
        self.sizes: dict[str, int] = {}
        self.page = self.top = self.left = 0
        self.font: str | None = None
        self.state = "idle"
        self.average = 0.0
        self.title = self.abstract = self.body = self.references = ""
        self.title_top, self.title_size = 0, 0
        self.names: list[str] = []
        self.last_size = 0

    def handle_comment(self, data: str) -> None:
        for number, size in re.findall(r"\.(ft\d+)\{font-size:(\d+)px", data):
            self.sizes[number] = int(size)
        if m := re.search(r"Page (\d+)", data):
            self.page = int(m.group(1))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        held = dict(attrs)
        if tag == "div" and (m := re.search(r"top:(\d+)", held.get("style") or "")):
            self.top = int(m.group(1))
        elif tag == "span":
            self.font = held.get("class") or self.font
        elif tag == "br":
            self.handle_data("\n")

    @property
    def size(self) -> int:
        return self.sizes.get(self.font or "", 0)

    def _title_line(self, text: str) -> bool:
        largest = sorted(set(self.sizes.values()), reverse=True)[:3]
        return self.top < 225 and bool(largest) and ((self.size in largest and re.search("[A-Za-z]", text) is not None) or abs(self.size - largest[0]) <= 2)

    def _author_area(self, text: str) -> bool:
        near = self.top - self.title_top < 180 or self.top < 200
        return near and (self.size < self.title_size - 1 or (self.size < self.title_size and bool(author_names(text))))

    def _starts(self, text: str, *words: str) -> bool:
        return any(re.match(rf"\s*{w[0]}?{w[1:]}\b", text, re.IGNORECASE) for w in words)

    def _next(self, text: str) -> str:
        abstract = self.page < 4 and not self.abstract and self._starts(text, "Abstract", "Summary")
        if self.state == "idle":
            if abstract:
                return "abstract"
            if not self.references and re.match(r"\s*(?:\d+\.?\s*)?(?:R?eferences|B?ibliography)\b", text, re.IGNORECASE):
                return "references"
            return "title" if not self.title and self._title_line(text) else "idle"
        if self.state in ("title", "authors") and self.page >= 3 or self.state == "waiting" and self.page >= 4:
            return "idle"
        if self.state in ("title", "authors", "waiting") and abstract:
            return "abstract"
        if self.state == "title":
            return "authors" if self._author_area(text) or (self.size != self.title_size and text == "\n") else "title"
        if self.state == "authors":
            return "authors" if self._author_area(text) or text == "\n" else "waiting"
        if self.state == "abstract":
            grown = self.size - self.last_size
            done = len(self.abstract) > 3000 or (grown > 1 and self.abstract.rstrip().endswith(".")) or grown > 2 or re.match(r"\s*(?:\d\.?\s*)?(?:Keywords|Introduction|Index terms)", text, re.IGNORECASE)
            return "idle" if done else "abstract"
        if self.state == "references":
            return "idle" if self.size > self.average + 2 and self.references and text.strip() else "references"
        return self.state

    def handle_data(self, data: str) -> None:
        if not self.sizes or not self.page or not self.font:
            return
        weight = len(data) // 10
        if weight and self.size:
            keep = 0.80**weight
            self.average = self.size if not self.average else keep * self.average + (1 - keep) * self.size
        self.state = self._next(data)
        if self.state == "title":
            if self._title_line(data) or data == "\n":
                self.title += data
            if data.strip() and not self.title_size:
                self.title_size, self.title_top = self.size, self.top
        elif self.state == "authors":
            self.names += [n for n in author_names(data) if n not in self.names]
        elif self.state == "abstract":
            self.abstract = join_line(self.abstract, data)
        elif self.state == "references":
            self.references = join_line(self.references, data)
        else:
            self.body = join_line(self.body, data)
        if data.strip():
            self.last_size = self.size


def join_line(text: str, line: str) -> str:
    """Lines joined by a blank; a word broken by a hyphen is put together."""
    if line == "\n":
        return text if not text or text.endswith((" ", "-")) else text + " "
    if text.rstrip().endswith("-") and line[:1].islower():
        return text.rstrip()[:-1] + line.lstrip()
    return text + line


def parse_layout(html: str | None) -> dict:
    """Title, authors, abstract, body and reference text of a converted paper."""
    layout = _Layout()
    layout.feed(html or "")
    layout.close()
    title = re.sub(r"\s+", " ", layout.title).strip().rstrip("*").replace(" :", ":").replace(" ,", ",")
    if title and title == title.upper() and title != title.lower():
        title = title.title()
    abstract = re.sub(r"^\s*(?:A?bstract|S?ummary)\W*", "", re.sub(r"\s+", " ", layout.abstract), flags=re.IGNORECASE).strip()
    return {"title": title or None, "authors": layout.names, "abstract": abstract or None, "body": layout.body.strip() or None, "reference_text": layout.references.strip() or None}


def parse_documents(html: DataFrame) -> DataFrame:
    """(doc_id, title, authors, abstract, body, reference_text) of the documents (doc_id, html) that are papers; one row in, at most one out."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [{"doc_id": i, **parse_layout(h)} for i, h in zip(frame["doc_id"], frame["html"])]
            yield pd.DataFrame(rows, columns=["doc_id", "title", "authors", "abstract", "body", "reference_text"])

    cleaned = html.select(F.col("doc_id").cast("string").alias("doc_id"), expand_ligatures(F.col("html")).alias("html"))
    return cleaned.where(is_paper(F.regexp_replace("html", "<[^>]*>", " "))).mapInPandas(run, PARSED)


def references_of(parsed: DataFrame) -> DataFrame:
    """(doc_id, ref_pos, raw, title, authors, booktitle, pages, date) of parsed documents."""
    pieces = parsed.select("doc_id", F.posexplode(split_references_udf("reference_text")).alias("pos", "raw"))
    raw = with_final_stop(single_spaced(F.col("raw")))
    return pieces.select("doc_id", (F.col("pos") + 1).alias("ref_pos"), raw.alias("raw")).withColumn("f", label_reference(F.col("raw"))).select("doc_id", "ref_pos", "raw", "f.*")
