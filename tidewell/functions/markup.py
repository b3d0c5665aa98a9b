"""Text and tables out of wiki HTML, as column expressions."""

from __future__ import annotations

import json
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.functions.text import strip

# Labels that mark a table of figures, and headings that are no prose.
STAT_LABELS = ("category", "class", "sub", "special", "range", "damage", "fire rate", "charge speed", "mobility", "level")
SKIPPED = ("contents", "gallery", "demonstration", "references", "external links", "notes", "data", "version history", "quotes", "badges", "super smash bros. ultimate", "weapon freshness rewards", "competitive", "translation notes")
# What lines begin with that are captions of pictures.
CAPTIONS = (
    r"^promotional image$",
    r"^2d icon$",
    r"^3d art(work)?",
    r"^splatnet icon$",
    r"^concept art",
    r"^titlecard",
    r"^weapon icon",
    r"^model of",
    r"^holding (the )?",
    r"^throwing ",
    r"^artwork of ",
    r"^another ",
    r"^three ",
    r"^the .* holding",
    r"^the .* used by",
    r"^held by ",
    r"^inkling (boy|girl) ",
    r"^a (team|rabbit|line) ",
    r"^two inklings",
    r"^sunken scroll",
    r"^the (same )?3d art",
    r"^the splattershot (on|being|as)",
    r"^the tableturf battle card",
    r"^a splattershot mem cake",
    r"^the (closest|center|second|third)",
    r"^the info page",
    r"^the \S+ on the",
    r"^\( link to file \)$",
    r"^link to file$",
)
#: A character reference: decimal, hexadecimal or named, its semicolon optional.
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


def numbered(digits: Column, base: int) -> Column:
    """The character of a numeric reference, as HTML has it: old Windows codes are translated, what is no character goes or becomes a mark."""
    short = F.regexp_replace(digits, "^0+", "")
    n = F.when(F.length(short) > 8, F.lit(1 << 40)).otherwise(F.conv(F.when(short == "", "0").otherwise(short), base, 10).cast("long"))
    windows = F.array(*[F.lit(bytes([b]).decode("cp1252", "ignore") or chr(b)) for b in range(0x80, 0xA0)])
    gone = n.between(1, 8) | n.between(14, 31) | (n == 11) | (n == 127) | n.between(0xFDD0, 0xFDEF) | (n.bitwiseAND(0xFFFE) == 0xFFFE)
    mark = (n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF)
    own = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    return F.when(mark, "�").when(n.between(0x80, 0x9F), F.get(windows, (n - 0x80).cast("int"))).when(gone, "").otherwise(own)


def decoded(text: Column) -> Column:
    """All character references decoded in one pass: what they give is not read again. Names are those of HTML; one without its semicolon may be the start of a longer word."""
    names = F.from_json(F.lit(json.dumps(html5)), "map<string,string>")  # folded once

    def one(reference: Column) -> Column:
        own = F.substring(reference, 2, 40)
        hexadecimal, decimal = F.regexp_extract(own, "^#[xX]([0-9a-fA-F]+)", 1), F.regexp_extract(own, "^#([0-9]+)", 1)
        at = lambda x: F.try_element_at(names, F.left(own, x))
        known = F.filter(F.sequence(F.length(own), F.least(F.length(own), F.lit(2)), F.lit(-1)), lambda x: at(x).isNotNull())
        first = F.get(known, 0)
        named = F.when(first.isNotNull(), F.concat(at(first), F.substring(own, first + 1, F.lit(40)))).otherwise(reference)
        return F.when(hexadecimal != "", numbered(hexadecimal, 16)).when(decimal != "", numbered(decimal, 10)).otherwise(named)

    references = F.transform(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0)), one)
    pieces = F.zip_with(F.split(text, REFERENCE), references, lambda p, r: F.concat(p, F.coalesce(r, F.lit(""))))
    return F.when(F.contains(text, F.lit("&")), F.array_join(pieces, "")).otherwise(text)


#: The references that SQL can decode, one after the other; the ampersand last, so that what it gives is not read again.
LISTED = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&#91;", "["), ("&#93;", "]"), ("&amp;", "&"))


def listed(text: Column) -> Column:
    """The listed references decoded, each with its semicolon; all others stay, `&amp` without one too."""
    for reference, character in LISTED:
        text = F.replace(text, F.lit(reference), F.lit(character))
    return text


def spaced(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"[\s\p{Z}]+", " "))


def plain(html: Column) -> Column:
    """Line breaks kept, other tags removed."""
    return strip(F.regexp_replace(F.regexp_replace(html, r"<br\s*/?>", "\n"), r"<[^>]+>", ""))


def stripped(html: Column, decode: Callable[[Column], Column] = decoded) -> Column:
    """One line of text: comments, footnote marks and tags go, entities are decoded, edit links go, white space collapses."""
    text = F.regexp_replace(F.regexp_replace(html, r"(?s)<!--.*?-->", ""), r"<sup[^>]*>[^\n]*?</sup>", "")
    text = F.regexp_replace(decode(F.regexp_replace(text, r"<[^>]+>", " ")), r"\[\s*edit\s*\]", "")
    return spaced(F.regexp_replace(text, r"-->\s*Continue Dismiss\s*<!--", ""))


def uncited(text: Column) -> Column:
    return spaced(F.regexp_replace(F.regexp_replace(text, r"\[\d+\]", ""), r"\[[a-z]\]", ""))


def inner(html: Column, tag: str, attributes: bool = False) -> Column:
    """The contents of all elements of a tag, in order."""
    return F.regexp_extract_all(html, F.lit(rf"(?s)<{tag}{'[^>]*' if attributes else ''}>(.*?)</{tag}>"), F.lit(1))


def description(html: Column, decode: Callable[[Column], Column] = decoded) -> Column:
    """The last paragraph of more than 30 characters before the table of contents that is no pointer to other pages; empty if none."""
    at = F.instr(html, F.lit('<div id="toc"'))
    head = F.when(at > 0, F.left(html, at - 1)).otherwise(html)
    texts = F.filter(F.transform(inner(head, "p"), lambda p: stripped(p, decode)), lambda t: (F.length(t) > 30) & ~F.startswith(t, F.lit("For other")))
    return F.coalesce(F.try_element_at(texts, F.lit(-1)), F.lit(""))


def items(html: Column, decode: Callable[[Column], Column] = decoded) -> Column:
    """Texts of all paragraphs, then of all list items; empty ones go."""
    return F.filter(F.transform(F.concat(inner(html, "p"), inner(html, "li")), lambda x: uncited(stripped(x, decode))), lambda t: t != "")


def sections(html: Column, games: tuple[str, ...] = (), captions: str = "(?i)" + "|".join(CAPTIONS)) -> Column:
    """Array of structs (heading, content) of the prose sections. games: headings that are parsed as tables; captions: a pattern of lines to drop."""
    parts = F.filter(F.split(html, r"(?=<h2[^>]*>)"), lambda p: F.startswith(p, F.lit("<h2")) & F.contains(p, F.lit("</h2>")))
    cut = F.transform(parts, lambda p: F.struct(stripped(F.regexp_extract(p, r"(?s)^<h2[^>]*>\s*(.*?)\s*</h2>", 1)).alias("heading"), items(F.regexp_replace(p, r"(?s)^<h2[^>]*>.*?</h2>", "")).alias("lines")))
    kept = F.transform(cut, lambda s: F.struct(s["heading"], F.filter(s["lines"], lambda t: ~F.regexp_like(t, F.lit(captions))).alias("lines") if captions else s["lines"].alias("lines")))
    kept = F.filter(kept, lambda s: ~F.lower(s["heading"]).isin(*SKIPPED) & ~s["heading"].isin(*games, "\0") & (F.size(s["lines"]) > 0))
    return F.transform(kept, lambda s: F.struct(s["heading"], F.array_join(s["lines"], "\n\n").alias("content")))


def infobox(html: Column, game: str) -> Column:
    """Map label: value of the first table of figures at the page's head or in the game's section. A later row of the same label wins."""
    parts = F.split(html, r"(?=<h2[^>]*>)")
    heading = lambda p: strip(F.regexp_replace(F.regexp_replace(F.regexp_extract(p, r"(?s)^<h2[^>]*>(.*?)</h2>", 1), r"<[^>]+>", ""), r"\[\s*edit\s*\]", ""))
    own = F.try_element_at(F.filter(parts, lambda p: F.startswith(p, F.lit("<h2")) & (heading(p) == game)), F.lit(1))
    head = F.when(F.startswith(F.get(parts, F.lit(0)), F.lit("<h2")), F.lit("")).otherwise(F.get(parts, F.lit(0)))
    row = r"(?s)<td[^>]*>\s*(.*?)\s*</td>\s*<td[^>]*>(.*?)</td>"
    tables = F.transform(inner(F.concat(head, own), "table", True), lambda t: F.arrays_zip(F.regexp_extract_all(t, F.lit(row), F.lit(1)).alias("label"), F.regexp_extract_all(t, F.lit(row), F.lit(2)).alias("value")))
    clean = F.transform(tables, lambda t: F.transform(t, lambda r: F.struct(stripped(r["label"]).alias("label"), stripped(r["value"]).alias("value"))))
    best = F.try_element_at(F.filter(clean, lambda t: F.exists(t, lambda r: F.lower(r["label"]).isin(*STAT_LABELS))), F.lit(1))
    share = lambda v: F.regexp_extract(v, r"(\d+)\s*/\s*100", 1)
    valued = F.transform(best, lambda r: F.struct(r["label"], F.when(share(r["value"]) != "", F.concat(share(r["value"]), F.lit("/100"))).otherwise(r["value"]).alias("value")))
    kept = F.filter(valued, lambda r: (r["label"] != "") & (F.lower(r["label"]) != "basic information") & (r["value"] != "") & (r["label"] != r["value"]))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return F.coalesce(F.aggregate(kept, none, lambda m, r: F.map_concat(F.map_filter(m, lambda k, _: k != r["label"]), F.create_map(r["label"], r["value"]))), none)


def language_names(html: Column, reach: int = 12_000) -> Column:
    """Array of structs (language, name) of the table of names; a row without a language has the one above."""
    after = F.regexp_extract(html, r'(?s)<span[^>]*id="Names_in_other_languages"[^>]*>.*?(</h[23]>.*)\z', 1)
    table = F.regexp_extract(F.left(after, F.lit(reach)), r"(?s)<table[^>]*>(.*?)</table>", 1)
    cells = F.filter(F.transform(inner(table, "tr", True), lambda r: inner(r, "td", True)), lambda c: F.size(c) >= 2)
    rows = F.transform(cells, lambda c: F.struct(F.regexp_replace(stripped(F.get(c, F.lit(0))), ":+$", "").alias("language"), uncited(stripped(F.get(c, F.lit(1)))).alias("name")))
    rows = F.filter(rows, lambda r: (r["name"] != "") & ~F.lower(r["language"]).isin("language", "meaning", "notes"))
    start = F.struct(F.lit("").alias("last"), F.array().cast("array<struct<language:string,name:string>>").alias("out"))

    def carry(s: Column, r: Column) -> Column:
        language = F.when(r["language"] == "", s["last"]).otherwise(r["language"])
        return F.struct(language.alias("last"), F.concat(s["out"], F.array(F.struct(language.alias("language"), r["name"].alias("name")))).alias("out"))

    return F.aggregate(rows, start, carry, lambda s: s["out"])


def markdown(title: Column, about: Column, infoboxes: Column, sections_: Column, names: Column) -> Column:
    """A document of a title, a description, per game a list of label and value, prose sections and names."""
    bullets = lambda pairs: F.array_join(F.transform(pairs, lambda p: F.concat(F.lit("- **"), p[0], F.lit("**: "), p[1])), "\n")
    games = F.transform(infoboxes, lambda g: F.concat(F.lit("## "), g["game"], F.lit("\n\n"), bullets(F.transform(F.map_entries(g["fields"]), lambda e: F.array(e["key"], e["value"])))))
    prose = F.transform(sections_, lambda s: F.concat(F.lit("## "), s["heading"], F.lit("\n\n"), s["content"]))
    named = F.when(F.size(names) > 0, F.array(F.concat(F.lit("## Names in Other Languages\n\n"), bullets(F.transform(names, lambda n: F.array(n["language"], n["name"])))))).otherwise(F.array().cast("array<string>"))
    lead = F.filter(F.array(F.concat(F.lit("# "), title), about), lambda x: F.coalesce(x, F.lit("")) != "")
    return F.concat(F.array_join(F.concat(lead, games, prose, named), "\n\n"), F.lit("\n"))


def wiki_page(title: Column, html: Column, games: tuple[str, ...]) -> Column:
    """The Markdown document of a wiki page: description, the figures of each game that has any (without the category), prose, names."""

    def figures(game: str) -> Column:
        own = F.map_filter(infobox(html, game), lambda k, _: F.lower(k) != "category")
        return F.struct(F.lit(game).alias("game"), own.alias("fields"))

    shown = F.filter(F.array(*[figures(g) for g in games]), lambda g: F.size(g["fields"]) > 0)
    return markdown(title, description(html), shown, sections(html, games), language_names(html))
