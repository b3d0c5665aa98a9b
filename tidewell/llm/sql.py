"""SQL of the registered queries that SQL can express: plain definitions over whole tables, without any of the operators' filters."""

from __future__ import annotations

from tidewell.llm.secrets import RULES

JACCARD = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words
), tokens AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS token FROM sets
), shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS common
  FROM tokens x JOIN tokens y ON x.token = y.token AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id
), links AS (
  SELECT a, b FROM shared WHERE 100 * common >= 80 * (na + nb - common)
), ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION
  SELECT reach.doc_id, ways.b FROM reach JOIN ways ON ways.a = reach.other
), named AS (
  SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT doc_id, len(s) AS n_shingles, component_id FROM sets JOIN named USING (doc_id)
"""

EMBEDDINGS = """
WITH RECURSIVE good AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM good x JOIN good y ON x.vec_id < y.vec_id
  WHERE CASE WHEN len(x.v) = len(y.v) THEN list_cosine_similarity(x.v, y.v) >= 0.9 END
), ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT vec_id, vec_id AS other FROM embeddings
  UNION
  SELECT reach.vec_id, ways.b FROM reach JOIN ways ON ways.a = reach.other
), named AS (
  SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id
), counted AS (
  SELECT a AS vec_id, count(*) AS n FROM ways GROUP BY a
)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM named LEFT JOIN counted USING (vec_id)
"""


NEGATIVES = """
WITH own AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM own a JOIN own b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
), positives AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS nth FROM scored WHERE same) WHERE nth <= 5
), negatives AS (
  SELECT p.anchor_id, p.other_id AS positive_id, n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY n.score DESC, n.other_id)::INTEGER AS rank
  FROM positives p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 10
"""


def secrets() -> str:
    text, quoted = "coalesce(text, '')", lambda s: "'" + s.replace("'", "''") + "'"
    rules = []
    for rank, rule in enumerate(RULES):
        # of runs of hex digits only those that are long enough
        pattern = quoted(r"[0-9a-f]{24,}" if rule.kind == "hex" else rule.pattern)
        rules.append(
            f"SELECT doc_id, {rank} AS rank, '{rule.kind}' AS kind, {rule.least} AS least, regexp_extract_all({text}, {pattern}) AS m, "
            f"regexp_extract_all({text}, {pattern}, {rule.group}) AS sized, string_split_regex({text}, {pattern}) AS gaps FROM documents"
        )
    each = "kind || ':' || start || ':' || stop, ',' ORDER BY start, rank"
    return f"""
WITH found AS ({" UNION ALL ".join(rules)}), numbered AS (
  SELECT *, unnest(range(1, len(m) + 1)) AS i FROM found
), placed AS (
  SELECT *, (list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS start FROM numbered
), spans AS (
  SELECT doc_id, rank, kind, start, start + length(m[i]) AS stop FROM placed WHERE length(sized[i]) >= least
)
SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg({each}) FILTER (rank < {sum(r.base for r in RULES)}), '')) AS base_sha256, coalesce(string_agg({each}), '') AS spans
FROM documents LEFT JOIN spans USING (doc_id) GROUP BY doc_id
"""


SQL = {"op5_jaccard_join": JACCARD, "op8_secret_scans": secrets(), "op10_embedding_dedup": EMBEDDINGS, "op12_hard_negatives": NEGATIVES}
