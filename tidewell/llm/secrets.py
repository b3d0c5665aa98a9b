"""Find secrets in texts with rules, asking a trigram index first which rules can match where.

Each rule is a regular expression (with a least length for one of its groups). From the expression follow the
sets of trigrams of which one set must be in a text for the rule to match (`trigram_query`). The index holds a posting
(trigram, key) for every trigram that some rule asks for and every text, in lower case, that has it; a rule's
candidates are the texts that are in the postings of all trigrams of one of its sets. Candidates are then verified with
the expression. A rule without mandatory trigrams scans all texts. Everything is built from DataFrame functions.

Null text counts as empty. Rows that repeat a key each keep their own spans. Positions count code points, ends are exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from re import _parser as grammar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import materialize, maybe_broadcast, unused


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


# The kinds, expressions and least lengths that the results are defined by.
BASE_RULES = [
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]+", 0, 24, True),
]
# Publicly documented forms of keys, beyond the base ones.
MORE_RULES = [
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
]
RULES = BASE_RULES + MORE_RULES
#: Strings that a part of an expression may stand for are listed up to so many; beyond it that part asks for nothing.
LISTED = 64
#: Matches that a running total is carried over at a time.
RUN = 256


def _strings(parsed) -> tuple[list[set[str]], bool]:
    """The alternatives of a parsed expression: for each the literal strings that must occur, and whether each alternative is one exact string."""
    done: list[set[str]] = [set()]
    open_: list[str] | None = [""]

    def close() -> None:
        nonlocal done, open_
        if open_ is not None and any(open_):
            done = [a | {b} for a in done for b in open_]
        open_ = None

    for op, value in parsed:
        name = str(op)
        exact: list[str] | None = None
        inner: list[set[str]] | None = None
        if name == "LITERAL":
            exact = [chr(value).lower()]
        elif name == "IN" and all(str(k) == "LITERAL" for k, _ in value):
            exact = sorted({chr(v).lower() for _, v in value})
        elif name == "SUBPATTERN":
            inner, is_exact = _strings(value[3])
            exact = [x for a in inner for x in a] if is_exact else None
        elif name == "BRANCH":
            both = [_strings(x) for x in value[1]]
            inner = [a for x, _ in both for a in x]
            exact = [x for a in inner for x in a] if all(e for _, e in both) else None
        elif name == "MAX_REPEAT" and value[:2] == (0, 1):
            optional, is_exact = _strings(value[2])
            exact = ["", *(x for a in optional for x in a)] if is_exact else None
        elif name == "MAX_REPEAT" and value[0] > 0:
            inner, _ = _strings(value[2])
        if exact is not None and open_ is not None and len(open_) * len(exact) <= LISTED:
            open_ = [a + b for a in open_ for b in exact]
            continue
        close()
        if exact is not None:
            open_ = exact
        else:
            if inner is not None:
                done = [a | b for a in done for b in inner]
            open_ = None
        if open_ is None:
            open_ = [""] if exact is None else open_
    whole = done == [set()] and open_ is not None
    if whole:
        return [{x} for x in open_], True
    close()
    return done, False


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Sets of trigrams, in lower case: a text that matches has all of one set. Empty: nothing can be asked."""
    alternatives, _ = _strings(grammar.parse(pattern))
    sets = {frozenset(s[i : i + 3] for s in a for i in range(len(s) - 2)) for a in alternatives}
    if any(not s for s in sets):
        return []
    return sorted((s for s in sets if not any(o < s for o in sets)), key=sorted)


def postings(docs: DataFrame, rules: list[Rule] = RULES, key: str = "doc_id") -> DataFrame:
    """The inverted index, for the trigrams that the rules ask for: trigram, key, each once."""
    asked = sorted({t for r in rules for s in trigram_query(r.pattern) for t in s})
    low = F.lower("text")
    found = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in asked]))
    return docs.select(key, F.explode(found).alias("trigram")).distinct()


def candidates(index: DataFrame, rules: list[Rule] = RULES, key: str = "doc_id") -> DataFrame:
    """kinds: for each key in the index, the rules whose query its postings answer; keys without any are left out."""
    asked = sorted({t for r in rules for s in trigram_query(r.pattern) for t in s})
    has = {t: F.max((F.col("trigram") == t).cast("int")) for t in asked}  # the intersection of postings, key by key
    flags = index.groupBy(key).agg(*[v.alias(f"t{i}") for i, v in enumerate(has.values())])
    name = {t: f"t{i}" for i, t in enumerate(asked)}
    both = lambda terms: reduce(lambda a, b: a & b, [F.col(name[t]) == 1 for t in sorted(terms)])
    kinds = [F.when(reduce(lambda a, b: a | b, [both(s) for s in q]), F.lit(r.kind)) for r in rules if (q := trigram_query(r.pattern))]
    return flags.select(key, F.array_compact(F.array(*kinds)).alias("kinds")).where(F.size("kinds") > 0)


def running(values: Column, step, zero: Column) -> Column:
    """For each value the fold of those before it. Runs of values are folded first, so that no array grows by single values for long."""

    def before(own: Column, first: Column, value) -> Column:
        state = F.struct(first.alias("now"), F.array().cast("array<int>").alias("all"))
        add = lambda s, x: F.struct(step(s["now"], value(x)).alias("now"), F.concat(s["all"], F.array(s["now"])).alias("all"))
        return F.aggregate(own, state, add)["all"]

    cut = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(values), F.lit(1)) - 1) / RUN).cast("int")), lambda i: F.slice(values, i * RUN + 1, F.lit(RUN)))
    firsts = before(cut, zero, lambda own: F.aggregate(own, zero, step))
    return F.flatten(F.zip_with(cut, firsts, lambda own, first: before(own, first, lambda x: x)))


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    """start, rank, end of a rule's leftmost non-overlapping matches whose group is long enough."""
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    long = F.transform(whole, F.length)
    sized = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length) if rule.group else long
    gaps = F.slice(F.transform(F.split(text, rule.pattern, -1), F.length), F.lit(1), F.size(whole))
    before = running(F.zip_with(gaps, long, lambda g, n: g + n), lambda s, x: s + x, F.lit(0))
    steps = F.arrays_zip(F.zip_with(before, gaps, lambda s, g: s + g).alias("start"), long.alias("long"), sized.alias("sized"))
    return F.transform(F.filter(steps, lambda s: s["sized"] >= rule.least), lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), (s["start"] + s["long"]).alias("end")))


def scan(docs: DataFrame, rules: list[Rule] = RULES, key: str = "doc_id", into: str = "found") -> DataFrame:
    """docs with a column of spans: array of (start, rank, end) in order of start, then rank (the rule's place in rules). A column of that name is replaced."""
    hits = materialize(candidates(postings(docs, rules, key), rules, key), "candidates")
    k, kinds = unused(docs, "candidate_key"), unused(docs, "candidate_kinds")
    joined = docs.join(maybe_broadcast(hits.select(F.col(key).alias(k), F.col("kinds").alias(kinds))), F.col(key).eqNullSafe(F.col(k)), "left")
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    each = []
    for rank, rule in enumerate(rules):
        could = F.array_contains(kinds, F.lit(rule.kind)) if trigram_query(rule.pattern) else F.lit(True)
        if rule.pattern == r"[0-9a-f]+":  # a run is taken whole, so only runs that are long enough need be looked at
            rule = Rule(rule.kind, r"[0-9a-f]{%d,}" % rule.least, 0, rule.least, rule.base)
        could = F.coalesce(could, F.lit(False)) & F.regexp_like(text, F.lit(rule.pattern))
        each.append(F.when(could, _spans(text, rule, rank)).otherwise(none))
    return joined.withColumn(into, F.array_sort(F.concat(*each))).drop(k, kinds)


def rendered(found: Column, rules: list[Rule] = RULES, base: bool = False) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    kept = F.filter(found, lambda x: x["rank"] < sum(r.base for r in rules)) if base else found
    return F.concat_ws(",", F.transform(kept, lambda x: F.concat_ws(":", F.get(kinds, x["rank"]), x["start"], x["end"])))


def redacted(text: Column, found: Column, mark: str = "[SECRET]") -> Column:
    """text with every found span, overlapping ones as one, replaced by the mark."""
    done = running(F.transform(found, lambda x: x["end"]), lambda s, x: F.greatest(s, x), F.lit(0))
    own = F.filter(F.zip_with(found, done, lambda x, d: F.struct(x["start"].alias("start"), d.alias("done"))), lambda x: x["start"] >= x["done"])
    kept = F.transform(own, lambda x: F.substring(text, x["done"] + 1, x["start"] - x["done"]))
    end = F.array_max(F.transform(found, lambda x: x["end"]))
    return F.when(F.size(found) == 0, text).otherwise(F.array_join(F.concat(kept, F.array(F.substring(text, end + 1, F.length(text)))), mark))
