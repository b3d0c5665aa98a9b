"""Catalogue records (nested JSON, in which a field may be an object, a list or a plain value) flattened into Markdown pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.functions.markup import plain
from tidewell.functions.text import strip

# The record's sections, its fields with the labels that pages give them, and the order of its categories.
INTRODUCTION, FACTS, BASE, FIGURES = 1, 2, 3, 4
FIELDS = ("简中名", "繁中名", "日文名", "英文名", "俗称", "次要武器", "特殊武器", "特殊武器需要的点数", "解锁等级", "武器重量", "同源武器", "版本")
LABELS = {"特殊武器需要的点数": "特殊武器点数"}
SIBLINGS, VERSIONS, COMMON = "同源武器", "版本", "共通"
CATEGORIES = ("射程", "精度", "伤害", "射击速率", "机动性能", "墨汁效率", "其它")
PREFIX = "^主武器详情[:：]"
VERSION = "Ver.9.3.0"
RECORD = "struct<status:boolean,data:struct<name:string,contents:array<struct<id:int,content:string>>>>"  # content: its JSON, of another kind in each section
ENTRIES = "array<struct<key_zh:string,value:string>>"


def parsed(json: Column) -> Column:
    """A record; null if it is no JSON or says that it failed."""
    own = F.from_json(json, RECORD)
    return F.when(own["status"] & own["data"].isNotNull(), own["data"])


def section(record: Column, number: int) -> Column:
    """The JSON of a section: of several with one number the last."""
    found = F.filter(record["contents"], lambda c: c["id"] == number)
    return F.try_element_at(found, F.lit(-1))["content"]


def name(record: Column) -> Column:
    return strip(F.regexp_replace(record["name"], PREFIX, ""))


def value(title: Column, content: Column, own_id: Column) -> Column:
    """What a field says: an object's name; a list's names (of siblings all but the record itself, of versions the ids), or its plain values; or itself."""
    is_object = lambda c: F.startswith(F.ltrim(c), F.lit("{"))
    read = lambda c: F.from_json(c, "struct<id:string,name:string>")
    elements = F.from_json(content, "array<string>")
    siblings = F.filter(elements, lambda c: is_object(c) & (F.coalesce(read(c)["name"], F.lit("")) != "") & ~F.coalesce(read(c)["id"] == own_id, F.lit(False)))
    each = F.when(title == SIBLINGS, F.transform(siblings, lambda c: read(c)["name"])).otherwise(F.transform(elements, lambda c: F.when(is_object(c), F.coalesce(F.when(title == VERSIONS, read(c)["id"]).otherwise(read(c)["name"]), F.lit(""))).otherwise(c)))
    listed = F.array_join(each, ", ")
    return F.when(content.isNull(), "").when(is_object(content), F.coalesce(read(content)["name"], F.lit(""))).when(F.startswith(F.ltrim(content), F.lit("[")), F.coalesce(listed, F.lit(""))).otherwise(content)


def facts(record: Column, own_id: Column) -> Column:
    """Array of structs (title, value) of the fields that pages show, in their order; the last of one title holds."""
    items = F.from_json(section(record, FACTS), "array<struct<title:string,content:string>>")
    of = lambda title: F.try_element_at(F.filter(items, lambda i: i["title"] == title), F.lit(-1))["content"]
    return F.array(*[F.struct(F.lit(LABELS.get(t, t)).alias("title"), value(F.lit(t), of(t), own_id).alias("value")) for t in FIELDS])


def lines(entries: Column, key: str, of: str) -> Column:
    """`+ key：value` lines."""
    return F.coalesce(F.transform(entries, lambda e: F.concat(F.lit("+ "), F.coalesce(e[key], F.lit("")), F.lit("："), F.coalesce(e[of], F.lit("")))), F.array().cast("array<string>"))


def figures(record: Column) -> Column:
    """Lines of the section of figures: categories under headings of their own for what all modes share; under its own heading for each other mode."""
    modes = F.filter(F.map_entries(F.from_json(section(record, FIGURES), "map<string,string>")), lambda m: F.startswith(F.ltrim(m["value"]), F.lit("{")))
    none = F.array().cast("array<string>")

    def mode(m: Column) -> Column:
        categories = F.from_json(m["value"], f"map<string,{ENTRIES}>")
        own = [(c, F.try_element_at(categories, F.lit(c))) for c in CATEGORIES]
        shared = F.concat(*[F.when(x.isNotNull(), F.concat(F.array(F.lit(f"### {c}")), lines(x, "key_zh", "value"), F.array(F.lit("")))).otherwise(none) for c, x in own])
        alone = F.concat(F.array(F.concat(F.lit("### "), m["key"])), *[lines(x, "key_zh", "value") for _, x in own], F.array(F.lit("")))
        return F.when(m["key"] == COMMON, shared).otherwise(alone)

    return F.coalesce(F.flatten(F.transform(modes, mode)), none)


def page(record: Column, own_id: Column, url: Column) -> Column:
    """The Markdown page of a record; null if it is none."""
    one = lambda *texts: F.array(*[F.lit(t) if isinstance(t, str) else t for t in texts])
    link = F.concat(F.lit("来源：["), url, F.lit("]("), url, F.lit(")"))
    introduction = F.regexp_replace(plain(F.coalesce(section(record, INTRODUCTION), F.lit(""))), r"[\r\n]", "")
    base = F.from_json(section(record, BASE), "array<struct<name:string,ratio:string>>")
    parts = [
        one(F.concat(F.lit("# "), name(record), F.lit(f" - 武器详情（{VERSION}）")), link, "", "", "## 简介", introduction, "## 主武器基础信息"),
        lines(facts(record, own_id), "title", "value"),
        one("", "---", "", "## 主武器基础数据"),
        lines(base, "name", "ratio"),
        one("", "---", "", f"## 主武器性能数据（{VERSION}）"),
        figures(record),
    ]
    return F.when(record.isNotNull(), F.array_join(F.concat(*parts), "\n"))


def in_order(rows: Column, categories: tuple[str, ...]) -> Column:
    """Array of structs (category, mode, line) as Markdown: categories in the given order; a subsection for each mode if there are several."""
    place = F.create_map(*[F.lit(x) for i, c in enumerate(categories) for x in (c, i)])
    ordered = F.array_sort(F.filter(F.transform(rows, lambda r: F.struct(place[r["category"]].alias("at"), r["mode"], r["line"])), lambda r: r["at"].isNotNull()))
    modes = F.array_distinct(F.transform(ordered, lambda r: r["mode"]))
    lines = lambda of: F.array_join(F.transform(of, lambda r: r["line"]), "\n")
    several = F.array_join(F.transform(modes, lambda m: F.concat(F.lit("### "), m, F.lit("\n\n"), lines(F.filter(ordered, lambda r: r["mode"] == m)))), "\n\n")
    return F.when(F.size(modes) > 1, several).otherwise(lines(ordered))
