"""Names and aliases in questions, families of names, and merging of alias tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.operators import lexicon
from tidewell.session import settled

# What a variant's name may add to its base name.
SUFFIXES = ("ANGL", "ASH", "OWL", "GECK", "BRNZ", "FRZN", "SNEK", "PYTN", "FRST", "MG", "RG", "D", "SNAK", "COBR", "WNTR", "CREM", "RUST")


def matched(questions: DataFrame, names: DataFrame) -> DataFrame:
    """qid, name, term, title, nick: names whose title or an alias is in the question (any case). names: name, ord, term (ord 0: the title).

    title is the title if that is there, nick the first alias in order that is; term is either, the title before the alias. The question is read once by
    an automaton of all terms (`lexicon.held`), and names join its hits by equality.
    """
    own = names.where("term != ''").select("name", "ord", "term", F.lower("term").alias("_low"))
    asked = questions.select("qid", F.lower("question").alias("text"))
    hits = lexicon.held(asked, own.select(F.col("_low").alias("term"))).withColumnRenamed("term", "_low")
    first = F.min(F.when(F.col("ord") > 0, F.struct("ord", "term")))["term"]
    each = hits.join(own, "_low").groupBy("qid", "name").agg(F.min(F.when(F.col("ord") == 0, F.col("term"))).alias("title"), first.alias("nick"))
    return each.select("qid", "name", F.coalesce("title", "nick").alias("term"), "title", "nick")


def meanings(found: DataFrame, names: DataFrame) -> DataFrame:
    """qid, nick, canonical: aliases that `matched` found which are not their name's title; of one alias of several names the last name's."""
    titles = names.where("ord = 0 AND term != ''").select("name", F.col("term").alias("canonical"))
    each = found.where("nick IS NOT NULL").select("qid", "name", "nick").join(titles, "name").where("nick != canonical")
    return each.groupBy("qid", "nick").agg(F.max_by("canonical", "name").alias("canonical"))


def cross_language(found: DataFrame, names: DataFrame) -> DataFrame:
    """found with the names that have a found name's title as an alias, in exact spelling."""
    titles = names.where("ord = 0").select("name", F.col("term").alias("title"))
    other = names.where("ord > 0").select(F.col("name").alias("other"), F.col("term").alias("title")).distinct()
    more = found.select("qid", "name").join(titles, "name").join(other, "title").select("qid", F.col("other").alias("name"), F.col("title").alias("term"))
    more = more.dropDuplicates(["qid", "name"]).join(found.select("qid", "name"), ["qid", "name"], "left_anti")
    return found.unionByName(more, allowMissingColumns=True)


def note(aliases: DataFrame) -> DataFrame:
    """qid, note: which alias stands for which name. aliases: qid, nick, canonical."""
    pairs = F.array_sort(F.collect_set(F.concat(F.lit("'"), F.col("nick"), F.lit("' = "), F.col("canonical"))))
    return aliases.where("nick != canonical").groupBy("qid").agg(F.array_join(pairs, "; ").alias("note"))


def noted(question: Column, note_: Column) -> Column:
    """The question as a model is shown it: what its aliases mean comes first."""
    lead = F.concat(F.lit("[Names in this question: "), note_, F.lit(". Each means that entry only, not others whose names contain it.]\n\n"))
    return F.when(F.coalesce(note_, F.lit("")) == "", question).otherwise(F.concat(lead, question))


def resolved(questions: DataFrame, names: DataFrame, reference: str | None = None) -> tuple[DataFrame, DataFrame]:
    """What each question is about. questions: qid, question (as asked), query (rewritten for search). names: as `matched`.

    First: qid, question, query (aliases replaced by titles), note. Second: qid, name, the entries that a question is restricted to: those that its query
    names, or else those that it names itself, with the counterparts in other languages, and the reference entry where there are any. A
    question without rows there is not restricted. Notes are of the question as asked, which replacement would hide.
    """
    names = settled(names.select("name", "ord", "term"))
    asked = settled(questions.select("qid", "question", "query"))
    original = settled(matched(asked, names))
    titles = names.where("ord = 0 AND term != ''").select("name", F.col("term").alias("canonical"))
    nicks = names.where("ord > 0").join(titles, "name").select(F.col("name").alias("ord"), F.col("ord").alias("at"), "canonical", F.col("term").alias("nick"))
    queries = settled(lexicon.renamed(asked.select("qid", F.col("query").alias("text")), nicks))
    rewritten = cross_language(matched(queries.withColumnRenamed("text", "question"), names), names).select("qid", "name")
    rewritten = settled(rewritten)
    own = cross_language(original, names).select("qid", "name").join(rewritten.select("qid").distinct(), "qid", "left_anti")
    chosen = rewritten.unionByName(own)
    if reference is not None:
        there = names.where(F.col("name") == reference).select("name").distinct()  # one row, or none
        chosen = chosen.unionByName(chosen.select("qid").distinct().crossJoin(F.broadcast(there))).distinct()
    notes = note(meanings(original, names))
    out = asked.select("qid", "question").join(queries.withColumnRenamed("text", "query"), "qid").join(notes, "qid", "left")
    return settled(out.select("qid", "question", "query", F.coalesce("note", F.lit("")).alias("note"))), settled(chosen.distinct())


def families(names: DataFrame, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """name, family: a name joins the shortest earlier name that it continues with a space, a bracket or a known suffix, and that leads a family.

    In sorted order the names that begin another stand before it, so one pass with a stack of them settles all. Names are dealt out in ranges; a range starts
    with the names that begin its first one, which are looked up among all (no more than that name has characters).
    """
    spark, allowed = names.sparkSession, frozenset(suffixes)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = settled(names.select("name").where("name IS NOT NULL").distinct().repartitionByRange(n, "name").withColumn("part", F.spark_partition_id()))
    firsts = own.groupBy("part").agg(F.min("name").alias("first")).where("first != ''")
    begins = firsts.select("part", F.explode(F.transform(F.sequence(F.lit(0), F.length("first") - 1), lambda k: F.left(F.col("first"), k))).alias("name"))
    before: dict[int, list[str]] = {}
    for r in begins.join(own.select("name"), "name").collect():
        before.setdefault(r["part"], []).append(r["name"])
    shared = spark.sparkContext.broadcast({part: sorted(own, key=len) for part, own in before.items()})

    def settle(batches):
        stack: list[tuple[str, bool]] = []  # names that begin the last one, and whether each leads a family

        def family(name):
            while stack and not name.startswith(stack[-1][0]):
                stack.pop()
            for base, leads in stack:
                rest = name[len(base) :]
                if leads and (rest[0] in " （" or rest in allowed):
                    stack.append((name, False))
                    return base
            stack.append((name, True))
            return name

        part = None
        for batch in batches:
            found = []
            for at, name in zip(batch.column("part").to_pylist(), batch.column("name").to_pylist(), strict=True):
                if at != part:
                    part = at
                    stack.clear()
                    for base in shared.value.get(at, []):
                        family(base)
                found.append(family(name))
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(found, pa.string())], ["name", "family"])

    return own.repartition(n, "part").sortWithinPartitions("part", "name").mapInArrow(settle, "name string, family string")


def titled(titles: DataFrame) -> DataFrame:
    """name, official: of several names with one title the last."""
    return titles.groupBy(F.col("title").alias("official")).agg(F.max("name").alias("name"))


def merged_aliases(own: DataFrame, table: DataFrame, titles: DataFrame) -> DataFrame:
    """own (name, ord, nick) with the table's aliases (official, ord, nick) of names that have that title, new ones behind. Adds status: kept, merged."""
    named = table.join(titled(titles), "official").select("name", "ord", "nick")
    new = named.join(own.select("name", "nick"), ["name", "nick"], "left_anti").groupBy("name", "nick").agg(F.min("ord").alias("ord"))
    last = own.groupBy("name").agg(F.max("ord").alias("last"))
    new = new.join(last, "name", "left").select("name", (F.col("ord") + 1 + F.coalesce("last", F.lit(0))).alias("ord"), "nick", F.lit("merged").alias("status"))
    return own.select("name", "ord", "nick", F.lit("kept").alias("status")).unionByName(new)


def merge_report(own: DataFrame, table: DataFrame, titles: DataFrame) -> DataFrame:
    """official, name (empty: none has that title), status (merged, skipped) and n_new, how many of its aliases are new to the name."""
    each = table.select("official", "nick").distinct().join(titled(titles), "official", "left")
    each = each.join(own.select("name", "nick", F.lit(True).alias("known")).distinct(), ["name", "nick"], "left")
    new = F.col("name").isNotNull() & F.col("known").isNull()
    counted = each.groupBy("official", "name").agg(F.count_if(new).alias("n_new"))
    return counted.select("official", F.coalesce("name", F.lit("")).alias("name"), F.when(F.col("name").isNull(), "skipped").otherwise("merged").alias("status"), "n_new")
