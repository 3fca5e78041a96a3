"""Scalar text functions, as expressions over whole columns."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Accented letters and their base letters; fixed values.
ACCENTED, BASE = "áéíóúüñàèìòùâêîôûäëïöç", "aeiouunaeiouaeiouaeioc"
BLANK = r"[ \t\n\r\f\x0B]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{BLANK}+|{BLANK}+$", "")


def normalise(c: Column) -> Column:
    """Lower case without accents."""
    return F.translate(F.lower(c), ACCENTED, BASE)


def clean_lines(c: Column, markers: Sequence[str], footnotes: Sequence[str], short_marks: Sequence[str], short: int = 40) -> Column:
    """Drop header, footer and footnote lines, then collapse blank lines and runs of blanks."""
    def noise(line: Column) -> Column:
        low, text = F.lower(line), strip(line)
        bad = F.lit(False)
        for m in markers:
            bad |= F.contains(low, F.lit(m.lower()))
        for pattern in footnotes:
            bad |= text.rlike(pattern)
        for m in short_marks:
            bad |= (F.length(text) < short) & F.contains(text, F.lit(m))
        return bad

    kept = F.array_join(F.filter(F.split(c, "\n"), lambda line: ~noise(line)), "\n")
    return strip(F.regexp_replace(F.regexp_replace(kept, r"\n{3,}", "\n\n"), r"[ \t]+", " "))


def sentences(c: Column) -> Column:
    """Cut after . ! ? and white space before a capital."""
    return F.split(c, r"(?<=[.!?])[ \t\n\r]+(?=[A-ZÁÉÍÓÚÜÑ])")


def pack(parts: Column, limit: int, joint: str = " ") -> Column:
    """Join parts greedily while they stay within ``limit`` characters; a longer part stays whole."""
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(s: Column, p: Column) -> Column:
        full = (F.length(s["open"]) + F.length(p) + len(joint) > limit) & (s["open"] != "")
        return F.when(full, F.struct(F.array_append(s["done"], s["open"]).alias("done"), p.alias("open"))).otherwise(F.struct(s["done"].alias("done"), F.when(s["open"] == "", p).otherwise(F.concat(s["open"], F.lit(joint), p)).alias("open")))

    return F.aggregate(parts, empty, add, lambda s: F.when(s["open"] != "", F.array_append(s["done"], s["open"])).otherwise(s["done"]))


def chunk_sentences(c: Column, limit: int = 3500) -> Column:
    return F.when(F.length(c) <= limit, F.array(c)).otherwise(pack(sentences(c), limit))


def sliding(window: int = 8000, overlap: int = 500) -> Column:
    """A function that splits texts in overlapping windows, cut after the last newline beyond 70 %."""
    @F.pandas_udf("array<string>")
    def split(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def cut(text: str | None) -> list[str]:
            if text is None or len(text) <= window:
                return [] if text is None else [text]
            out, at = [], 0
            while at + window < len(text):
                newline = text.rfind("\n", at, at + window)
                end = newline + 1 if newline - at > 0.7 * window else at + window
                out.append(text[at:end])
                at = end - overlap
            return [*out, text[at:]]

        for texts in parts:
            yield texts.map(cut)

    return split


def halve(c: Column, limit: int = 4000, joint: str = "\n\n", back: int = 200) -> Column:
    """Long texts in two, at the first joint from ``back`` before the middle, else at the middle."""
    middle = F.floor(F.length(c) / 2).cast("int")
    found = F.call_function("locate", F.lit(joint), c, middle - back + 1) - 1
    at = F.when(found >= 0, found).otherwise(middle)
    return F.when(F.length(c) <= limit, F.array(c)).otherwise(F.array(strip(F.left(c, at)), strip(F.substr(c, at + 1))))


def truncate(c: Column, limit: int = 10_000, separators: Sequence[str] = ("\n\n", ". ", ".\n", "; ", ": ", "\n", " "), share: float = 0.7) -> Column:
    """At most ``limit`` characters, ending after the last of the first separator that stands beyond the share."""
    head = F.left(c, F.lit(limit))
    out = strip(head)
    for sep in reversed(separators):
        last = limit - F.instr(F.reverse(head), sep[::-1]) - len(sep) + 1  # offset of its last place
        out = F.when((F.instr(head, sep) > 0) & (last > limit * share), strip(F.left(head, last + len(sep)))).otherwise(out)
    return F.when(F.length(c) <= limit, c).otherwise(out)


def metadata_map(c: Column) -> Column:
    """The ``- key: value`` lines under ``## Metadata`` as a map."""
    block = F.regexp_extract(c, r"(?s)## Metadata\n(.*?)(?:\n## |$)", 1)
    lines = F.filter(F.split(block, "\n"), lambda s: F.contains(s, F.lit(":")))
    clean = F.transform(lines, lambda s: F.regexp_replace(strip(s), r"^- ", ""))
    pairs = F.transform(clean, lambda s: F.struct(strip(F.substring_index(s, ":", 1)).alias("k"), strip(F.substr(s, F.instr(s, ":") + 1)).alias("v")))
    return F.map_from_entries(pairs)


def section(c: Column, name: str) -> Column:
    """The body of one section; null if it is empty or a full stop."""
    body = strip(F.regexp_extract(c, rf"(?s)## {name}\n(.*?)(?:\n## |$)", 1))
    return F.when((body != "") & (body != "."), body)


def record_text(c: Column, names: Sequence[str] = ("Resumen", "Contenido")) -> Column:
    """The filled sections as ``name:`` and body; null if there is none."""
    joined = F.concat_ws("\n\n", *(F.concat(F.lit(f"{n}:\n"), section(c, n)) for n in names))
    return F.when(joined != "", joined)


def first_match(c: Column, groups: Sequence[tuple[str, Sequence[str]]], default: str | None = None, words: bool = False) -> Column:
    """The name of the first group with a keyword in the lower-cased text, as a substring or, by option, a whole word."""
    low, out = F.lower(c), F.lit(default).cast("string")
    for name, keys in reversed(groups):
        hit = F.lit(False)
        for k in keys:
            hit |= low.rlike(rf"(^|[^0-9a-záéíóúüñ]){k}($|[^0-9a-záéíóúüñ])") if words else F.contains(low, F.lit(k))
        out = F.when(hit, name).otherwise(out)
    return out


def numbers(c: Column) -> Column:
    """Distinct numbers that stand alone after white space, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"[ \n]([0-9]{1,9})\b"), 1), lambda x: x.cast("long"))))


def cited_articles(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(r"(?i)(?U)art[íi]culo\s+(\d+[°\w]*)"), 1), lambda x: F.regexp_replace(F.lower(x), "[°º]", ""))


def article_label(uid: Column) -> Column:
    key = F.regexp_extract(uid, r"_art_(.+)$", 1)
    return F.when(key != "", F.concat(F.lit("Art. "), F.translate(key, "_-", "  ")))


def article_key(uid: Column) -> Column:
    return F.regexp_extract(uid, r"_art_(.+)$", 1)


def article_number(uid: Column) -> Column:
    return F.regexp_extract(uid, r"_art_([0-9]+)", 1).try_cast("long")


def natural_key(c: Column) -> Column:
    """Number, letter, sub-number of an article key, for sorting."""
    parts = F.split(c, "_")
    return F.struct(F.get(parts, F.lit(0)).try_cast("long").alias("num"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("letter"), F.coalesce(F.get(parts, F.lit(2)).try_cast("long"), F.lit(0)).alias("sub"))


def normalise_article(c: Column) -> Column:
    return F.lower(F.regexp_replace(strip(c), r"[°º.\-]+$", ""))


def strip_refs(c: Column) -> Column:
    """Without [1] and [1, 2], double blanks and blanks before marks."""
    plain = F.regexp_replace(c, r"\[[0-9]+(, ?[0-9]+)*\]", "")
    return strip(F.regexp_replace(F.regexp_replace(plain, r"[ ]{2,}", " "), r" ([.,;:])", "$1"))


@F.pandas_udf(StringType())
def decomposed(names: pd.Series) -> pd.Series:
    """Compatibility forms taken apart, combining marks dropped; for names, not for texts."""
    return names.map(lambda s: "".join(ch for ch in unicodedata.normalize("NFKD", s) if not unicodedata.combining(ch)), na_action="ignore")


def slug(c: Column, default: str = "documento") -> Column:
    """A file name: letters A-Z, digits, ``-`` and ``_`` stay as they are, all else becomes one ``_``."""
    plain = F.regexp_replace(F.regexp_replace(decomposed(c), "[^a-zA-Z0-9_-]+", "_"), "^_+|_+$", "")
    return F.when(F.coalesce(plain, F.lit("")) == "", default).otherwise(plain)


def content_type(c: Column, greetings: Sequence[str], groups: Sequence[tuple[str, Sequence[str]]], starters: Sequence[str], talk: str = "conversacion", other: str = "articulo") -> Column:
    """Short texts and greetings are talk; then the keyword groups in order; then short questions are talk."""
    text = F.regexp_replace(strip(F.lower(c)), "^[¿¡]+", "")
    greets = text.rlike("^(" + "|".join(greetings) + ")")
    asks = text.rlike("^(" + "|".join(starters) + ")") & (F.length(text) < 120)
    out = F.when(asks, talk).otherwise(other)
    for name, keys in reversed(groups):
        out = F.when(F.exists(F.array(*map(F.lit, keys)), lambda k: F.contains(text, k)), name).otherwise(out)
    return F.when((F.length(text) < 40) | greets, talk).otherwise(out)


def paragraphs(c: Column, limit: int = 4000) -> Column:
    """Paragraphs packed up to ``limit``; those that are longer are packed line by line."""
    parts = F.flatten(F.transform(F.split(c, "\n\n"), lambda p: F.when(F.length(p) > limit, pack(F.split(p, "\n"), limit, "\n")).otherwise(F.array(p))))
    return F.when(F.length(c) <= limit, F.array(c)).otherwise(F.transform(pack(parts, limit, "\n\n"), strip))


def live_lines(results: Column, limit: int = 500) -> Column:
    """Titles, urls and beginnings of results (title, url, content) under a header."""
    return F.concat(F.lit("Resultados en vivo:\n"), F.array_join(F.transform(results, lambda r: F.concat(F.lit("- "), r["title"], F.lit(" ("), r["url"], F.lit("): "), F.substring(r["content"], 1, limit))), "\n"))


def unfenced(c: Column) -> Column:
    """JSON out of a fenced block, else from the first brace to the last; typographic quotes made plain."""
    block = F.regexp_extract(c, r"(?s)```(?:json)?[ \t\n]*(.*?)```", 1)
    brace = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    return F.translate(F.when(block != "", strip(block)).otherwise(brace), "“”‘’", "\"\"''")


def relations(c: Column, kind: str = "relacionado_con", confidence: float = 0.8) -> Column:
    """Relations of an extraction's JSON answer; items without an end are dropped, what is missing gets defaults."""
    parsed = F.from_json(unfenced(c), "relations array<struct<source:string,target:string,type:string,confidence:double>>")
    good = F.filter(parsed["relations"], lambda r: (F.coalesce(r["source"], F.lit("")) != "") & (F.coalesce(r["target"], F.lit("")) != ""))
    return F.transform(F.coalesce(good, F.array()), lambda r: F.struct(r["source"].alias("source"), r["target"].alias("target"), F.coalesce(r["type"], F.lit(kind)).alias("type"), F.coalesce(r["confidence"], F.lit(confidence)).alias("confidence"), F.lit("llm").alias("extracted_by")))


def facts(c: Column) -> Column:
    """A facts object as a map; anything else gives an empty one."""
    plain = F.regexp_replace(strip(c), r"^```(json)?[ \t\n]*|```$|^json[ \t\n]+", "")
    return F.coalesce(F.from_json(strip(plain), "map<string,string>"), F.from_json(F.lit("{}"), "map<string,string>"))
