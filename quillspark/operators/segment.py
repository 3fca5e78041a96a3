"""Segmentation of legal text: articles, numerals, letters, and chunks of them.

Texts are cut by look-ahead patterns that leave the marker at the start of its piece, so pieces tile the text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..functions.spread import spread
from ..functions.text import strip


@dataclass(frozen=True)
class Pattern:
    """What begins an article, a numeral, a letter and the transitory part. The first group of each is its number."""

    article: str
    numeral: str | None = None
    letter: str | None = None
    transitory: str | None = None


LAW = Pattern(
    article=r"(?:ART[IÍ]CULO|Art[ií]culo) +([0-9]+[°º]?(?: ?[A-Za-z](?![A-Za-z]))?)[ ]*\.?-",
    numeral=r"\n *([0-9]+) ?[°º]",
    letter=r"\n *([a-zñ])\) ",
    transitory=r"\n *(?:DISPOSICIONES|ART[IÍ]CULOS) TRANSITORI[AO]S",
)


def pieces(text: Column, marker: str) -> Column:
    """The pieces that begin with the marker, in order; what stands before the first is left out."""
    return F.filter(F.split(text, f"(?={_plain(marker)})"), lambda p: p.rlike(f"^(?:{marker})"))


def _plain(marker: str) -> str:
    return marker.replace("([", "(?:[")


def merge_close(parts: Column, least: int = 10) -> Column:
    """A start closer than ``least`` to the last start that was kept is no start: its piece joins the one before."""
    empty = F.array().cast("array<string>")

    def add(kept: Column, p: Column) -> Column:
        last = F.element_at(kept, -1)
        joined = F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(F.concat(last, p)))
        return F.when(F.size(kept) == 0, F.array(p)).when(F.length(last) < least, joined).otherwise(F.array_append(kept, p))

    return F.aggregate(parts, empty, add)


def spans(text: Column, marker: str) -> Column:
    """(ident, begin, end) of the pieces, as offsets in the text; a span ends where the next begins, the last with the text."""
    lead = F.length(F.element_at(F.split(text, f"(?={_plain(marker)})"), 1))
    found = pieces(text, marker)
    lead = F.when(F.element_at(F.split(text, f"(?={_plain(marker)})"), 1).rlike(f"^(?:{marker})"), 0).otherwise(lead)
    start = F.struct(F.array().cast("array<struct<ident:string,begin:int,end:int>>").alias("out"), lead.alias("at"))

    def add(s: Column, p: Column) -> Column:
        one = F.struct(F.regexp_extract(p, f"^(?:{marker})", 1).alias("ident"), s["at"].alias("begin"), (s["at"] + F.length(p)).alias("end"))
        return F.struct(F.array_append(s["out"], one).alias("out"), (s["at"] + F.length(p)).alias("at"))

    return F.aggregate(found, start, add, lambda s: s["out"])


def split_transitory(text: Column, marker: str | None) -> tuple[Column, Column]:
    """The main body and the part from the first transitory marker on (empty if there is none)."""
    if not marker:
        return text, F.lit("")
    at = F.regexp_instr(text, F.lit(marker))
    return F.when(at > 0, F.left(text, at - 1)).otherwise(text), F.when(at > 0, F.substr(text, at)).otherwise("")


def children(text: Column, pattern: Pattern) -> Column:
    """(kind, path, text): numerals if two or more begin in the text, in each its letters if two or more; else letters if
    two or more; else the text itself with an empty path."""
    def cut(t: Column, marker: str | None) -> Column:
        return pieces(t, marker) if marker else F.array().cast("array<string>")

    def leaf(kind: str, path: Column, t: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), path.alias("path"), strip(t).alias("text"))

    letters = cut(text, pattern.letter)
    as_letters = lambda parts, lead, kind: F.transform(parts, lambda p: leaf(kind, F.concat(lead, F.regexp_extract(p, f"^(?:{pattern.letter})", 1)), p))

    def numeral(p: Column) -> Column:
        ident = F.concat(F.lit("n"), F.regexp_extract(p, f"^(?:{pattern.numeral})", 1))
        below = cut(p, pattern.letter)
        return F.when(F.size(below) >= 2, as_letters(below, F.concat(ident, F.lit("_")), "letra")).otherwise(F.array(leaf("numeral", ident, p)))

    numerals = cut(text, pattern.numeral)
    whole = F.array(leaf("articulo", F.lit(""), text))
    out = F.when(F.size(letters) >= 2, as_letters(letters, F.lit(""), "letra")).otherwise(whole) if pattern.letter else whole
    if pattern.numeral:
        out = F.when(F.size(numerals) >= 2, F.flatten(F.transform(numerals, numeral))).otherwise(out)
    return F.filter(out, lambda x: x["text"] != "")


class Cutter:
    """Articles, numerals, letters and chunks of a text, each in one scan for its marks; spans are offsets in the text."""

    def __init__(self, pattern: Pattern, limit: int = 3500, least: int = 10) -> None:
        mark = lambda p: p and re.compile(p, re.ASCII)
        self.article, self.numeral, self.letter, self.transitory = (mark(p) for p in (pattern.article, pattern.numeral, pattern.letter, pattern.transitory))
        self.limit, self.least = limit, least

    @staticmethod
    def _tiles(found: list[re.Match], end: int) -> list[tuple[re.Match, int]]:
        """Each mark with where the next begins."""
        return list(zip(found, [*(m.start() for m in found[1:]), end]))

    def articles(self, text: str) -> list[tuple[str, int, int]]:
        """(ident, begin, end), the main body's, then the transitory ones."""
        late = self.transitory.search(text) if self.transitory else None
        split, out = late.start() if late else len(text), []
        for begin, end, prefix in ((0, split, ""), (split, len(text), "trans_")):
            kept: list[re.Match] = []
            for m in self.article.finditer(text, begin, end):
                if not kept or m.start() - kept[-1].start() >= self.least:
                    kept.append(m)
            out += [(prefix + re.sub("[°º]", "", m[1]), m.start(), stop) for m, stop in self._tiles(kept, end)]
        return out

    def leaves(self, text: str) -> list[tuple[str, str]]:
        """(path, text) as ``children`` has them."""
        numerals = list(self.numeral.finditer(text)) if self.numeral else []
        parts: list[tuple[str, str]] = []
        if len(numerals) >= 2:
            for m, end in self._tiles(numerals, len(text)):
                parts += self._letters(text, m.start(), end, f"n{m[1]}_") or [(f"n{m[1]}", text[m.start() : end])]
        else:
            parts = self._letters(text, 0, len(text), "") or [("", text)]
        stripped = ((path, part.strip(_BLANK)) for path, part in parts)
        return [(path, part) for path, part in stripped if part]

    def _letters(self, text: str, begin: int, end: int, lead: str) -> list[tuple[str, str]]:
        found = list(self.letter.finditer(text, begin, end)) if self.letter else []
        return [(lead + m[1], text[m.start() : stop]) for m, stop in self._tiles(found, end)] if len(found) >= 2 else []

    def chunks(self, text: str) -> list[str]:
        """Sentences packed up to the limit, as ``chunk_sentences`` has them."""
        if len(text) <= self.limit:
            return [text]
        done, open_ = [], ""
        for sentence in _SENTENCE.split(text):
            if open_ and len(open_) + len(sentence) + 1 > self.limit:
                done.append(open_)
                open_ = sentence
            else:
                open_ = f"{open_} {sentence}" if open_ else sentence
        return [*done, open_] if open_ else done


_BLANK = " \t\n\r\f\x0b"
_SENTENCE = re.compile(r"(?<=[.!?])[ \t\n\r]+(?=[A-ZÁÉÍÓÚÜÑ])")


def _cut(docs: DataFrame, text: str, columns: list[tuple[str, str]], rows_of: Callable[[str], list[tuple]]) -> DataFrame:
    """A row for each row that ``rows_of`` makes of a text, with the document's other columns."""
    other = [c for c in docs.columns if c != text]
    schema = StructType([*(docs.schema[c] for c in other), *(StructField(name, _KINDS[kind]) for name, kind in columns)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):  # so that what a batch of long texts gives stays small
                part = batch.slice(a, 256)
                at, out = [], []
                for i, value in enumerate(part.column(len(other)).to_pylist()):
                    made = rows_of(value) if value is not None else []
                    at += [i] * len(made)
                    out += made
                kept = [part.column(j).take(pa.array(at, pa.int64())) for j in range(len(other))]
                values = zip(*out) if out else [[]] * len(columns)
                yield pa.record_batch([*kept, *(pa.array(c, arrow.field(len(other) + j).type) for j, c in enumerate(values))], schema=arrow)

    return spread(docs.select(*other, text)).mapInArrow(run, schema)


_KINDS = {"int": IntegerType(), "string": StringType()}


def articles(docs: DataFrame, pattern: Pattern = LAW, text: str = "text") -> DataFrame:
    """One row per article (place, ident, article): the main body's, then the transitory ones, named trans_."""
    cutter = Cutter(pattern)

    def rows_of(value: str) -> list[tuple]:
        found = ((i, ident, value[a:b].strip(_BLANK)) for i, (ident, a, b) in enumerate(cutter.articles(value)))
        return [x for x in found if x[2]]

    return _cut(docs, text, [("place", "int"), ("ident", "string"), ("article", "string")], rows_of)


def one_article(docs: DataFrame, number: str, pattern: Pattern = LAW, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The first article of that number per document."""
    found = articles(docs, pattern, text).filter(F.col("ident") == number)
    return found.groupBy(key).agg(F.min_by("article", "place").alias("article"))


def law_chunks(docs: DataFrame, pattern: Pattern = LAW, text: str = "text", law: str = "law_tag", limit: int = 3500) -> DataFrame:
    """Chunks of laws: leaves of the hierarchy, packed; uids ley_{law}_art_{n}[_n{m}][_{letter}][_{i}], repeated ones
    marked _dup2 ... in order. A law without articles is one chunk ley_{law}_full of 10000 characters, hashed in full."""
    cutter = Cutter(pattern, limit)

    def rows_of(value: str) -> list[tuple]:
        if not cutter.article.search(value):
            return [(0, 0, None, "", 0, 1, value)]
        out = []
        for place, (ident, a, b) in enumerate(cutter.articles(value)):
            article = value[a:b].strip(_BLANK)
            for leaf, (path, part) in enumerate(cutter.leaves(article) if article else []):
                parts = cutter.chunks(part)
                out += [(place, leaf, ident, path, i, len(parts), chunk) for i, chunk in enumerate(parts)]
        return out

    other = [c for c in docs.columns if c != text]
    parts = _cut(docs, text, [("place", "int"), ("leaf_no", "int"), ("ident", "string"), ("path", "string"), ("chunk_index", "int"), ("total_chunks", "int"), ("content", "string")], rows_of)
    # The chain of levels: the article, then the numeral and the letter of the path.
    number, letter = F.regexp_extract("path", "^n([^_]+)", 1), F.regexp_extract("path", "^(?:n[^_]+_)?([^n_][^_]*)$", 1)
    levels = [("articulo", F.col("ident")), ("numeral", F.when(number != "", number)), ("letra", F.when(letter != "", letter))]
    hierarchy = F.concat_ws("/", *(F.concat(F.lit(f"{kind}_"), name) for kind, name in levels))
    section = F.concat_ws(" ", *(F.concat(F.lit(f"{kind.upper()} "), name) for kind, name in levels), F.upper(law))
    whole = F.col("ident").isNull()  # a law without articles
    base = F.concat_ws("_", F.lit("ley"), law, F.lit("art"), F.lower("ident"), F.when(F.col("path") != "", F.col("path")))
    uid = F.when(whole, F.concat_ws("_", F.lit("ley"), law, F.lit("full"))).when(F.col("chunk_index") > 0, F.concat_ws("_", base, F.col("chunk_index"))).otherwise(base)
    content = F.when(whole, F.left("content", F.lit(10_000))).otherwise(F.col("content"))
    chunks = parts.select(*other, "place", "leaf_no", uid.alias("chunk_uid"), F.when(whole, "").otherwise(hierarchy).alias("hierarchy_path"), F.when(whole, F.upper(law)).otherwise(section).alias("section_level_name"), "chunk_index", "total_chunks", content.alias("content"), F.left(F.sha2("content", 256), F.lit(32)).alias("content_hash"))
    n = F.row_number().over(Window.partitionBy("chunk_uid").orderBy(*other, "place", "leaf_no", "chunk_index"))
    return chunks.withColumn("chunk_uid", F.when(n > 1, F.concat_ws("_dup", "chunk_uid", n)).otherwise(F.col("chunk_uid")))


def lettered_sections(text: Column, stop: str = r"\n *(?:BIS|TER|QU[AÁ]TER|ART[IÍ]CULO)") -> Column:
    """(letter, text) of the sections A-E of an article; each ends at the next letter or at a stop."""
    marker = r"\n *([A-E])[).] ?-?"
    cut = F.transform(pieces(F.concat(F.lit("\n"), text), marker), lambda p: F.struct(F.regexp_extract(p, f"^(?:{marker})", 1).alias("letter"), strip(F.element_at(F.split(p, stop), 1)).alias("text")))
    return F.filter(cut, lambda s: s["text"] != "")


def sections_by_line(docs: DataFrame, key: str, text: str, titles: Sequence[str]) -> DataFrame:
    """(key, section, letter, text): an introduction (section 0), then what follows each line ``A) ...`` with a title word."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("n", "line"))
    starts = F.col("line").rlike(r"^[A-E]\)") & F.exists(F.array(*map(F.lit, titles)), lambda t: F.contains(F.lower("line"), t))
    lines = lines.withColumn("section", F.sum(starts.cast("int")).over(Window.partitionBy(key).orderBy("n")))
    grouped = lines.groupBy(key, "section").agg(F.sort_array(F.collect_list(F.struct("n", "line"))).alias("_l"))
    body = F.array_join(F.transform("_l", lambda x: x["line"]), "\n")
    return grouped.select(key, "section", F.when(F.col("section") > 0, F.left(F.col("_l")[0]["line"], F.lit(1))).alias("letter"), strip(body).alias("text"))


#: Texts that a task holds as Python strings at once.
PASSAGE_ROWS = 256


def anchored(anchor: str, start: str, end: str, least: int = 1000, notes: tuple[str, str] = ("NOTA", "Ley"), back: int = 200):  # noqa: ANN201
    """A function for the passage around an anchor: from the last start phrase before it to the first end marker at least
    ``least`` characters on that no footnote (both note words in the ``back`` characters before) holds.

    Texts are Python strings PASSAGE_ROWS at a time and go out as such; the batch stays packed."""
    @F.arrow_udf("string")
    def passage(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        def find(text: str | None) -> str | None:
            at = text.find(anchor) if text else -1
            if at < 0:
                return None
            begin = max(text.rfind(start, 0, at), 0) if start in text[:at] else at
            stop = text.find(end, begin + least)
            while stop >= 0 and all(n in text[max(0, stop - back) : stop] for n in notes):
                stop = text.find(end, stop + 1)
            return text[begin : stop if stop >= 0 else len(text)].strip()

        for texts in parts:
            for a in range(0, len(texts), PASSAGE_ROWS):
                yield pa.array([find(t) for t in texts.slice(a, PASSAGE_ROWS).to_pylist()], pa.string())

    return passage


def citations(text: Column, laws: Sequence[tuple[str, str]], reach: int = 100) -> Column:
    """(num, law_tag) of the articles a text cites; the law is the first of ``laws`` named in the ``reach`` characters after,
    null for the text's own. The first citation of a number counts."""
    after = rf"(?i)\b(?:art[íi]culo|art\.) +([0-9]+)((?:(?!art[íi]culo|art\.)[^\x00]){{0,{reach}}})"
    nums, tails = F.regexp_extract_all(text, F.lit(after), 1), F.regexp_extract_all(text, F.lit(after), 2)

    def law(tail: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, tag in reversed(laws):
            out = F.when(F.contains(F.lower(tail), F.lit(name)), tag).otherwise(out)
        return out

    found = F.zip_with(nums, tails, lambda n, t: F.struct(n.cast("long").alias("num"), law(t).alias("law_tag")))
    seen = F.array().cast("array<struct<num:bigint,law_tag:string>>")
    return F.aggregate(found, seen, lambda s, x: F.when(F.exists(s, lambda y: y["num"] == x["num"]), s).otherwise(F.array_append(s, x)))
