"""Score documents for toxicity with a weighted finite-state pattern grammar.

Five transducers read a clause's words in cascade, each passing on the word's class and the mark that the ones before it gave: the insult
transducer marks an insult *plain*, the threat transducer marks a threat word behind an intent, the target transducer makes a plain mark
near a target *targeted*, reported speech makes any mark *reported*, negation makes it *negated*. `compose` builds their product, one
automaton over word classes with every reachable state. Each matched clause gives its strongest mark, the rule, with the weight of
the term; a document's score is the logistic function of its rules' summed weights.

A clause ends at a full stop and the like; a colon, a comma and a quotation mark do not end it, and what is quoted after a
report is reported to the closing mark, over several clauses.

`fit` learns the terms (words, and stems that several words share) and their weights from labelled documents as
log-odds, and then the rules' weights. It reads at most ``SAMPLE`` labelled rows (the lowest by hash of their id), which also bounds the
terms, all of which are kept; scoring reads every document whole. Labels of ids whose crc32 modulo 3 is 1 are never used.

Null or empty text has no clause and gets the score of such. Null ids are scored but never used as labels; repeated label rows
count once (toxic if any says so). With no usable labels the built-in terms and rule weights hold.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm.common import materialize, slices, tidied, utf8

#: Labelled rows that terms and weights are learnt from.
SAMPLE = 20_000
THRESHOLD = 0.7
#: A term is learnt if so many toxic documents have it and it is so many times likelier in them.
SUPPORT, LIFT = 4, 20.0
STEM_SUPPORT, STEM_WORDS, STEM_LENGTHS = 8, 3, (4, 5, 6)

# The built-in words of each class, in four languages.
INSULTS = "idiot moron loser scum trash pathetic worthless stupid disgusting clown imbecile scumbag dumbass vermin idiote abruti connard ordure imbécile dummkopf trottel arschloch abschaum idiota imbécil estúpido basura escoria".split()
THREATS = "kill hurt destroy murder strangle stab beat shoot tuer frapper détruire töten schlagen umbringen matar golpear destruir".split()
TARGETS = "you your you're u he she they him her them these those this that du dich dir ihr euch tu toi te vous elle ils tú te usted ustedes ellos eres".split()
NEGATIONS = "not never no isn't aren't wasn't don't nobody nicht nie kein keine niemals pas jamais aucun nunca jamás ningún".split()
REPORTS = "said says called calls wrote quoted quotes according claimed reported sagte schrieb nannte dit écrit appelé dijo escribió llamó".split()
INTENTS = "will i'll we'll gonna shall going werde werden vais allons voy vamos".split()
RULES = ("plain", "targeted", "negated", "reported", "threat")
PRIOR = np.array([-3.0, 1.2, 1.5, 0.6, 0.6, 1.5])  # the intercept, then the rules
BUILT_IN = 4.0  # the weight of a built-in term that labels say nothing about
REACH = 3  # words over which a negation, target or intent is carried
SLICE_BYTES = 1 << 20  # of texts that a worker scores at a time
REMEMBERED = 200_000  # words that a worker knows the class of: bounds its memory

WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
CLAUSE = re.compile(r"[.!?;\n]+")
OPENING, CLOSING = "“„«‹", "”»›"
QUOTES = OPENING + CLOSING + '"'
TOKEN = re.compile(rf"{WORD.pattern}|[{QUOTES}]")


class Transducer:
    """Reads (word class, mark) and passes the mark on, changed or not. Its state: for how many more words it remembers its class."""

    remembers: str | None = None
    reach = 0

    def mark(self, state: int, symbol: str, mark: str | None) -> str | None:
        raise NotImplementedError

    def step(self, state: int, symbol: str, mark: str | None) -> tuple[int, str | None]:
        after = self.reach if symbol == self.remembers else max(0, state - 1)
        return after, self.mark(state, symbol, mark)


class Insult(Transducer):
    def mark(self, state, symbol, mark):
        return "plain" if symbol == "insult" else mark


class Threat(Transducer):
    remembers, reach = "intent", REACH

    def mark(self, state, symbol, mark):
        return "threat" if symbol == "threat" and state else mark


class Target(Transducer):
    remembers, reach = "target", REACH

    def mark(self, state, symbol, mark):
        return "targeted" if mark == "plain" and state else mark


class Reported(Transducer):
    """Speech stays reported to the end of what was begun."""

    remembers, reach = "report", 1

    def step(self, state, symbol, mark):
        return int(state or symbol == "report"), self.mark(state, symbol, mark)

    def mark(self, state, symbol, mark):
        return "reported" if mark and state else mark


class Negation(Transducer):
    remembers, reach = "negation", REACH

    def mark(self, state, symbol, mark):
        return "negated" if mark and state else mark


SYMBOLS = ("insult", "threat", "target", "negation", "report", "intent", "other")
CASCADE = (Insult(), Threat(), Target(), Reported(), Negation())


class Composed:
    """The product of transducers in cascade over SYMBOLS: next[state][symbol] and rule[state][symbol] (a place in RULES, -1: no match)."""

    def __init__(self, parts: tuple[Transducer, ...]):
        number, todo = {(0,) * len(parts): 0}, [(0,) * len(parts)]
        self.next: list[list[int]] = []
        self.rule: list[list[int]] = []
        self.states = todo  # each state's tuple, by its number
        for state in todo:  # grows as states are reached
            after, rules = [], []
            for symbol in SYMBOLS:
                own, mark = [], None
                for part, s in zip(parts, state, strict=True):
                    s, mark = part.step(s, symbol, mark)
                    own.append(s)
                if tuple(own) not in number:
                    number[tuple(own)] = len(number)
                    todo.append(tuple(own))
                after.append(number[tuple(own)])
                rules.append(RULES.index(mark) if mark else -1)
            self.next.append(after)
            self.rule.append(rules)
        at = next((i for i, p in enumerate(parts) if isinstance(p, Reported)), None)
        #: Where a clause begins: afresh, or in speech that is still reported.
        self.start = {False: 0, True: number.get(tuple(int(i == at) for i in range(len(parts))), 0)}

    def reported(self, state: int) -> bool:
        return any(isinstance(p, Reported) and s for p, s in zip(CASCADE, self.states[state], strict=True))


@lru_cache(maxsize=1)
def compose() -> Composed:
    return Composed(CASCADE)


@dataclass
class Grammar:
    terms: dict[str, tuple[str, float]]  # word: class, weight
    stems: dict[str, float]
    weights: list[float]

    def __post_init__(self):
        self.automaton = compose()

    def of(self, word: str) -> tuple[str, float]:
        """A word's class and weight."""
        found = self.terms.get(word)
        if found is None:
            found = max((("insult", self.stems[word[:n]]) for n in STEM_LENGTHS if word[:n] in self.stems), key=lambda x: x[1], default=("other", 0.0))
        return found

    def matches(self, word: str) -> bool:
        return any(self.of(w)[0] in ("insult", "threat") for w in WORD.findall(word.lower()))

    def clauses(self, text: str) -> list[tuple[int, float]]:
        """Rule and weight of each clause that matches: the strongest match of the clause."""
        out, quoted, held, a = [], False, False, self.automaton  # held: in a quotation that a report began
        for clause in CLAUSE.split(text.lower()):
            state, best = a.start[held], None
            for m in TOKEN.finditer(clause):
                word = m[0]
                if word in QUOTES:
                    if quoted and word not in OPENING:
                        state = a.start[False] if held else state
                        quoted = held = False
                    elif not quoted and word not in CLOSING:
                        quoted, held = True, a.reported(state)
                    continue
                symbol, weight = self.of(word)
                i = SYMBOLS.index(symbol)
                rule, state = a.rule[state][i], a.next[state][i]
                if rule >= 0 and (best is None or weight > best[1]):
                    best = rule, weight
            if best:
                out.append(best)
        return out

    def features(self, text: str) -> np.ndarray:
        x = np.zeros(len(RULES))
        for rule, weight in self.clauses(text):
            x[rule] += (min(weight, 8.0) / 4) ** 2
        return np.log1p(x)

    def score(self, text: str) -> float:
        z = self.weights[0] + float(self.features(text) @ np.array(self.weights[1:]))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def built_in() -> Grammar:
    classes = {"intent": INTENTS, "report": REPORTS, "negation": NEGATIONS, "target": TARGETS, "threat": THREATS, "insult": INSULTS}
    return Grammar({w: (c, BUILT_IN if c in ("insult", "threat") else 0.0) for c, words in classes.items() for w in words}, {}, PRIOR.tolist())


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", rows: int = SAMPLE) -> DataFrame:
    """Labelled documents to learn from: key, text, toxic. At most so many labels, so they may be broadcast."""
    one = labels.where(F.col(key).isNotNull() & F.col("toxic").isNotNull() & ~held_out(key)).groupBy(key).agg(F.max("toxic").alias("toxic"))
    one = one.orderBy(F.xxhash64(key), key).limit(rows)
    return docs.select(key, "text").join(F.broadcast(one), key)


def learn_terms(train: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Words and stems with their log-odds."""
    totals = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = sum(n for t, n in totals.items() if t == 1), sum(n for t, n in totals.items() if t != 1)
    words = train.select("toxic", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+(?:'\p{L}+)?"), F.lit(0)))).alias("word"))
    words = words.groupBy("word").agg(F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("bad"), F.sum(F.when(F.col("toxic") == 1, 0).otherwise(1)).alias("good"))
    stem = F.array(F.struct(F.lit(0).alias("n"), F.col("word").alias("term")), *[F.struct(F.lit(n).alias("n"), F.substring("word", 1, n).alias("term")) for n in STEM_LENGTHS])
    each = words.select(F.explode(stem).alias("t"), "bad", "good").select("t.n", "t.term", "bad", "good").where("n = 0 OR length(term) = n")
    each = each.groupBy("n", "term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.count(F.lit(1)).alias("words"))
    lift = (F.col("bad") + 0.5) / (bad + 1) * (good + 1) / (F.col("good") + 0.5)
    kept = each.withColumn("lift", lift).where((F.col("lift") >= LIFT) & (F.col("bad") >= F.when(F.col("n") == 0, SUPPORT).otherwise(STEM_SUPPORT)) & ((F.col("n") == 0) | (F.col("words") >= STEM_WORDS)))
    top = kept.orderBy("n", "term").collect()  # no more than the sample's words
    return {r["term"]: math.log(r["lift"]) for r in top if r["n"] == 0}, {r["term"]: math.log(r["lift"]) for r in top if r["n"]}


def weigh(x: np.ndarray, y: np.ndarray, strength: float = 0.05) -> list[float]:
    """Logistic regression by Newton's method, drawn towards the built-in weights."""
    x, w = np.hstack([np.ones((len(x), 1)), x]), PRIOR.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + strength * np.eye(len(w)), x.T @ (p - y) + strength * (w - PRIOR))
        w -= np.clip(step, -2, 2)
    return w.tolist()


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", rows: int = SAMPLE) -> Grammar:
    train = materialize(sample(docs, labels, key, rows), "labelled")
    words, stems = learn_terms(train)
    grammar = built_in()
    grammar.terms |= {w: ("threat" if grammar.terms.get(w, "")[:1] == ("threat",) else "insult", v) for w, v in words.items()}
    grammar.stems |= stems

    def features(batches):
        for batch in batches:
            x = np.array([grammar.features(t.as_py() or "") for t in batch.column("text")]).reshape(-1, len(RULES))
            yield pa.RecordBatch.from_pydict({"toxic": batch.column("toxic").cast(pa.int64())} | {r: pa.array(x[:, i]) for i, r in enumerate(RULES)})

    # no more rows than the sample; those without a match are one row
    found = train.select("text", "toxic").mapInArrow(tidied(features), "toxic long, " + ", ".join(f"{r} double" for r in RULES))
    counted = sorted(tuple(r) for r in found.groupBy("toxic", *RULES).count().collect())
    if counted:
        n = np.array([r[-1] for r in counted])
        x, y = np.array([r[1:-1] for r in counted], float), np.array([float(r[0] == 1) for r in counted])
        grammar.weights = weigh(np.repeat(x, n, axis=0), np.repeat(y, n))
    return grammar


def score(docs: DataFrame, grammar: Grammar, key: str = "doc_id") -> DataFrame:
    """key and score of each row."""
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("score", T.DoubleType())])

    def rows(batches):
        scores = Scores(grammar)
        for batch in batches:
            for lo, own in scores.of(batch.column(1)):
                yield pa.RecordBatch.from_pydict({key: batch.column(0).slice(lo, len(own)), "score": pa.array(own)})

    return docs.select(key, "text").mapInArrow(tidied(rows), schema)


class Scores:
    """Scores of text columns. A text without a word that can match has the score of the empty text, so only others are read by the grammar."""

    def __init__(self, grammar: Grammar):
        self.grammar, self.none, self.known = grammar, grammar.score(""), {}

    def of(self, column):
        """Yields (first row, scores) for row ranges."""
        data, off = utf8(column)
        for lo, hi in slices(off, SLICE_BYTES):
            texts = pa.LargeStringArray.from_buffers(hi - lo, pa.py_buffer(off[lo : hi + 1] - off[lo]), pa.py_buffer(data[off[lo] : off[hi]]))
            split = pc.utf8_split_whitespace(texts)
            at = np.asarray(split.offsets)
            words = split.values.slice(0, int(at[-1])).dictionary_encode()
            hit = np.zeros(len(words.dictionary), bool)
            for i, w in enumerate(words.dictionary.to_numpy(zero_copy_only=False)):
                own = self.known.get(w)
                if own is None:
                    if len(self.known) >= REMEMBERED:
                        self.known.clear()
                    own = self.known[w] = self.grammar.matches(w)
                hit[i] = own
            total = np.concatenate(([0], np.cumsum(hit[words.indices.to_numpy()])))
            out = np.full(len(texts), self.none)
            for i in np.flatnonzero(total[at[1:]] > total[at[:-1]]).tolist():
                out[i] = self.grammar.score(texts[i].as_py())
            yield lo, out


def rejects(docs: DataFrame, grammar: Grammar, key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows whose text scores at least the threshold; all columns stay."""
    column = docs.columns.index("text")

    def rows(batches):
        scores = Scores(grammar)
        for batch in batches:
            for lo, own in scores.of(batch.column(column)):
                yield batch.slice(lo, len(own)).filter(pa.array(own < threshold))

    return docs.mapInArrow(tidied(rows), docs.schema)
