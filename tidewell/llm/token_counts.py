"""Token counts of documents under a unigram model, with dynamic programming shared through a trie.

A text is cut into pre-tokens at white space. The best segmentation of a pre-token has the largest sum of its pieces'
log-probabilities (of equal sums, the fewest tokens); its forward scores depend on the prefix alone. So the distinct
pre-tokens of a batch are inserted in a trie, each node's forward score and token count is computed once for all
pre-tokens that share the prefix, and the counts at terminal nodes are stored. Sorted order visits the trie depth first,
so only one path of it is ever in memory. A document's count is the sum over its pre-tokens.

A vocabulary without probabilities (merge ranks) gets those of Zipf's law over its ids. A character that no
piece covers costs a token for each of its UTF-8 bytes. Null or empty text has no tokens.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidewell.llm.common import slices, tidied, utf8
from tidewell.llm.tokens import tokenizer_path

VOCABULARY = "piece_bpe_32k.model"
#: What stands for the white space before a word in the vocabulary.
MARK = "▁"
#: Distinct pre-tokens that a task remembers before it starts afresh, and bytes of text that it splits at a time.
REMEMBERED, SLICE_BYTES = 1_000_000, 4 << 20
#: Log-probability of a byte that stands for a part of an unknown character, below any piece's.
BYTE_LOG_P = -25.0


@lru_cache(maxsize=2)
def pieces(path: str) -> tuple[dict[str, float], int]:
    """Log-probability of each piece, and the length of the longest."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    total = math.log(sum(1 / (rank + 1) for rank in range(len(ids))))
    found = {model.id_to_piece(i): -math.log(rank + 1) - total for rank, i in enumerate(ids)}
    return found, max(map(len, found))


def counts(words: list[str], log_p: dict[str, float], longest: int) -> list[int]:
    """Token counts of distinct words in ascending order."""
    out = []
    best, tokens, last = [0.0], [0], ""
    get = log_p.get
    for word in words:
        shared, most = 0, min(len(word), len(last))
        while shared < most and word[shared] == last[shared]:
            shared += 1
        del best[shared + 1 :], tokens[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            width = len(word[end - 1].encode())
            score, n = best[end - 1] + width * BYTE_LOG_P, tokens[end - 1] + width
            for begin in range(end - 1, max(-1, end - 1 - longest), -1):
                p = get(word[begin:end])
                if p is not None:
                    p += best[begin]
                    if p > score or (p == score and tokens[begin] + 1 < n):
                        score, n = p, tokens[begin] + 1
            best.append(score)
            tokens.append(n)
        last = word
        out.append(tokens[-1])
    return out


class Counter:
    """Counts of pre-tokens, remembered between batches."""

    def __init__(self, path: str):
        self.log_p, self.longest = pieces(path)
        self.known: dict[str, int] = {}

    def of(self, words: np.ndarray) -> np.ndarray:
        found = list(map(self.known.get, words))
        missing = [i for i, n in enumerate(found) if n is None]
        if missing:
            if len(self.known) + len(missing) > REMEMBERED:
                self.known.clear()
            new = sorted((words[i], i) for i in missing)
            for (word, i), n in zip(new, counts([MARK + w for w, _ in new], self.log_p, self.longest), strict=True):
                found[i] = self.known[word] = n
        return np.array(found, np.int64)


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One for each worker process."""
    return Counter(path)


def token_counts(docs: DataFrame, path: str | None = None, key: str = "doc_id") -> DataFrame:
    """key, n_words (pre-tokens) and n_tokens of each row."""
    path = path or tokenizer_path(VOCABULARY)
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def rows(batches):
        own = counter(path)
        for batch in batches:
            data, off = utf8(batch.column(1))
            for lo, hi in slices(off, SLICE_BYTES):
                part = data[off[lo] : off[hi]]
                texts = pa.LargeStringArray.from_buffers(hi - lo, pa.py_buffer(off[lo : hi + 1] - off[lo]), pa.py_buffer(part))
                split = pc.utf8_split_whitespace(texts)
                at = np.asarray(split.offsets)
                words = split.values.slice(0, int(at[-1])).dictionary_encode()
                distinct = words.dictionary.to_numpy(zero_copy_only=False)
                each = own.of(distinct) if len(distinct) else np.zeros(0, np.int64)
                filled = np.array([x != "" for x in distinct], bool)
                which = words.indices.to_numpy()
                total = lambda x: np.concatenate(([0], np.cumsum(x[which])))
                n, w = total(np.where(filled, each, 0)), total(filled.astype(np.int64))
                yield pa.RecordBatch.from_pydict({key: batch.column(0).slice(lo, hi - lo), "n_words": pa.array(w[at[1:]] - w[at[:-1]]), "n_tokens": pa.array(n[at[1:]] - n[at[:-1]])})

    return docs.select(key, "text").mapInArrow(tidied(rows), schema)
