"""Word level tokens by the longest match in a lexicon, as an Arrow function that index and search share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.automata import Terms
from tidewell.session import settled

SPAN = "[一-鿿㐀-䶿豈-﫿]+"
#: Characters that the words of a lexicon may have together: it is one automaton in every worker.
CHARACTERS = 4 << 20
#: Different spans whose words a worker keeps: the first that it meets, which are mostly the frequent ones.
KEPT = 1 << 16
#: Spans that a worker cuts at once.
SPANS = 1 << 18


def segment(text: str, terms: Terms) -> list[str]:
    """Words of a span: the longest entries from the left; characters outside any stand alone."""
    out, at = [], 0
    for start, end in terms.leftmost(text):
        out += [*text[at:start], text[start:end]]
        at = end
    return [*out, *text[at:]]


def known(spark: SparkSession, lexicon: list[str] | DataFrame) -> Terms:
    """The names of two or more characters as one automaton."""
    if isinstance(lexicon, DataFrame):
        own = settled(lexicon.where(F.length("name") > 1).select("name").distinct())
        size = own.agg(F.sum(F.length("name"))).first()[0] or 0
        if size > CHARACTERS:
            raise ValueError(f"the lexicon has {size} characters; one automaton takes {CHARACTERS}")
        lexicon = [r["name"] for r in own.collect()]
    names = sorted({x for x in lexicon if x and len(x) > 1})
    if sum(map(len, names)) > CHARACTERS:
        raise ValueError(f"the lexicon has more than {CHARACTERS} characters")
    return Terms(spark, names)


def slices(spans: pa.ListArray) -> Iterator[pa.ListArray]:
    """Lists of no more than about SPANS spans together."""
    ends, lo = np.cumsum(spans.value_lengths().fill_null(0).to_numpy()), 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SPANS, "right")))
        yield spans.slice(lo, hi - lo)
        lo = hi


def cut(spans: pa.ListArray, terms: Terms, kept: dict[str, list[str]], least: int = 1) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Different words of lists of spans, the place there of each word in order, and how many words each list has. A span that repeats is cut once. Words of fewer than least characters go."""
    own = spans.flatten().dictionary_encode()
    each = []
    for span in own.dictionary.to_pylist():
        words = kept.get(span)
        if words is None:
            words = [w for w in segment(span, terms) if len(w) >= least]
            if len(kept) < KEPT:
                kept[span] = words
        each.append(words)
    words = pa.array([w for x in each for w in x], pa.string()).dictionary_encode()
    place, sizes = words.indices.to_numpy(), np.array([len(x) for x in each], np.int64)
    begin, span = np.cumsum(sizes) - sizes, own.indices.to_numpy()
    n = sizes[span]
    at = np.repeat(begin[span] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
    ends = np.concatenate(([0], np.cumsum(n)))[np.concatenate(([0], np.cumsum(spans.value_lengths().fill_null(0).to_numpy())))]
    return words.dictionary, place[at], np.diff(ends)


class Segmenter:
    """From a text column to an array of words. What counts words in its own task takes the spans, which are fewer, and cuts them there."""

    def __init__(self, terms: Terms, span: str):
        self.terms, self.span = terms, span

    def spans(self, text: Column) -> Column:
        return F.regexp_extract_all(text, F.lit(self.span), F.lit(0))

    def __call__(self, text: Column) -> Column:
        terms, kept = self.terms, {}

        def one(some):
            different, place, sizes = cut(some, terms, kept)
            return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), different.take(pa.array(place)))

        @F.arrow_udf("array<string>")
        def words(spans: pa.Array) -> pa.Array:
            return pa.concat_arrays([pa.array([], pa.list_(pa.string())), *map(one, slices(spans))])

        return words(self.spans(text))


def segmenter(spark: SparkSession, lexicon: list[str] | DataFrame, span: str = SPAN) -> Segmenter:
    """Cuts the spans of a text into words. lexicon: names of two or more characters (of a table: its column name); shorter ones are passed over."""
    return Segmenter(known(spark, lexicon), span)


def counter(spark: SparkSession, lexicon: list[str] | DataFrame, span: str = SPAN, least: int = 1) -> Callable[[Column], Column]:
    """As `segmenter`, but gives an array of (word, n): each different word of a text that has least characters, and how often it is there."""
    terms, kept = known(spark, lexicon), {}
    kind = pa.struct([("word", pa.string()), ("n", pa.int64())])

    @F.arrow_udf("array<struct<word:string,n:bigint>>")
    def words(spans: pa.Array) -> pa.Array:
        def one(some):
            different, place, sizes = cut(some, terms, kept, least)
            many = max(1, len(different))
            key, n = np.unique(np.repeat(np.arange(len(sizes)), sizes) * many + place, return_counts=True)
            row, place = np.divmod(key, many)
            ends = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(sizes)))))
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([different.take(pa.array(place)), pa.array(n, pa.int64())], fields=list(kind)))

        return pa.concat_arrays([pa.array([], pa.list_(kind)), *map(one, slices(spans))])

    return lambda text: words(F.regexp_extract_all(text, F.lit(span), F.lit(0)))


def registered(names: DataFrame) -> DataFrame:
    """name: the titles and file stems of a collection that are words of their own. names: stem, title."""
    return names.select(F.explode(F.array("stem", "title")).alias("name")).where(F.length("name") > 1).distinct()
