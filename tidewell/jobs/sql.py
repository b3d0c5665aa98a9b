"""The SQL of the registered queries, and the parts that they share."""

CHUNKS = r"""
d AS (SELECT doc_id, source, regexp_replace(text, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS t FROM documents),
w AS (SELECT doc_id, source, t, unnest(range(0, length(t), 400)) AS pos FROM d WHERE length(t) > 500 UNION ALL SELECT doc_id, source, t, 0 AS pos FROM d WHERE length(t) <= 500),
chunks AS (SELECT doc_id, source, CAST(pos / 400 AS INTEGER) AS chunk_order, substr(t, pos + 1, 500) AS text FROM w WHERE length(substr(t, pos + 1, 500)) > 20)
"""
TERMS = (
    CHUNKS
    + r""",
tok AS (SELECT doc_id, chunk_order, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM chunks),
total AS (SELECT doc_id, chunk_order, count(*) AS total FROM tok GROUP BY 1, 2),
tf AS (SELECT doc_id, chunk_order, term, n, n::DOUBLE / total AS tf FROM (SELECT doc_id, chunk_order, term, count(*) AS n FROM tok GROUP BY 1, 2, 3) JOIN total USING (doc_id, chunk_order)),
idf AS (SELECT term, df, ln(((SELECT count(*) FROM chunks) - df + 0.5) / (df + 0.5) + 1) AS idf FROM (SELECT term, count(*) AS df FROM tf GROUP BY 1))
"""
)


def scored(questions: str) -> str:
    """questions: SQL of (qid, question)."""
    return (
        TERMS
        + rf""",
q AS ({questions}),
qt AS (SELECT qid, unnest(regexp_extract_all(lower(question), '[\p{{L}}\p{{N}}_]+')) AS term FROM q),
qv AS (SELECT qid, term, count(*) * idf / max(total) AS weight, idf FROM qt JOIN (SELECT qid, count(*) AS total FROM qt GROUP BY 1) USING (qid) JOIN idf USING (term) GROUP BY qid, term, idf),
scored AS (SELECT qid, doc_id, chunk_order, round(sum(tf * idf * weight), 6) AS score FROM tf JOIN qv USING (term) GROUP BY 1, 2, 3)
"""
    )


def top(source: str, k: int, extra: str = "") -> str:
    return f"SELECT * FROM (SELECT qid, doc_id, chunk_order, score{extra}, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id, chunk_order) AS rank FROM {source}) WHERE rank <= {k}"


PERSONAL = [
    ("[EMAIL]", r"[A-Za-z0-9_./+-]+@[A-Za-z0-9_.-]+\.[a-z]{2,}", False),
    ("[PHONE]", r"1[3-9]\d{9}", True),
    ("[ID]", r"[1-6]\d{5}(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[\dXx]", True),
    ("[IP]", r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}", True),
    ("[CARD]", r"(?:\d[ -]*?){13,19}", True),
]


def redaction(column: str) -> str:
    """Redacted text without lookaround: the neighbours are kept, and a second pass takes hits that share one."""
    for mark, pattern, fenced in PERSONAL:
        if fenced:
            for _ in range(2):
                column = f"regexp_replace({column}, '(^|[^0-9])(?:{pattern})([^0-9]|$)', '\\1{mark}\\2', 'g')"
        else:
            column = f"regexp_replace({column}, '{pattern}', '{mark}', 'g')"
    return column


def stripped(column: str) -> str:
    column = f"regexp_replace(regexp_replace({column}, '<!--.*?-->', '', 'gs'), '<sup[^>]*>.*?</sup>', '', 'g')"
    column = f"regexp_replace({column}, '<[^>]+>', ' ', 'g')"
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&#91;", "["), ("&#93;", "]"), ("&amp;", "&")):
        column = f"replace({column}, '{entity}', '{char}')"
    column = f"regexp_replace({column}, '\\[\\s*edit\\s*\\]', '', 'g')"
    return spaced(f"regexp_replace({column}, '-->\\s*Continue Dismiss\\s*<!--', '', 'g')")


def spaced(column: str) -> str:
    return f"regexp_replace(regexp_replace({column}, '[\\s\\p{{Z}}]+', ' ', 'g'), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"


def uncited(column: str) -> str:
    return spaced(f"regexp_replace(regexp_replace({column}, '\\[\\d+\\]', '', 'g'), '\\[[a-z]\\]', '', 'g')")


def dot(x: str, y: str) -> str:
    return f"list_dot_product({x}::DOUBLE[], {y}::DOUBLE[])"
