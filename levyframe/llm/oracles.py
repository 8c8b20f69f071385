"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from levyframe.llm.centroids import CENTROIDS, ROUNDS, SCALE, SEED, SIZE

# Words of 'documents' that are covered by a window of 13 words that also starts in a document of a smaller id.
OP11 = r"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
),
windows AS MATERIALIZED (
  SELECT rid, doc_id, k, array_to_string(words[k : k + 12], ' ') AS span
  FROM (SELECT rid, doc_id, words, unnest(range(1, len(words) - 11)) AS k FROM docs)
),
least AS (SELECT span, min(doc_id) AS least FROM windows GROUP BY span),
hit AS MATERIALIZED (SELECT rid, k FROM windows JOIN least USING (span) WHERE least < doc_id),
gone AS (SELECT DISTINCT rid, unnest(range(k, k + 13)) AS k FROM hit),
-- places and words of every document, in order
placed AS (SELECT rid, unnest(range(1, len(words) + 1)) AS k, unnest(words) AS word FROM docs),
kept AS (
  SELECT rid, count(*) AS n_words, count(gone.k) AS n_removed,
    coalesce(string_agg(word, ' ' ORDER BY placed.k) FILTER (WHERE gone.k IS NULL), '') AS text
  FROM placed LEFT JOIN gone USING (rid, k) GROUP BY rid
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (rid)
"""

OP12 = r"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
),
groups AS MATERIALIZED (SELECT DISTINCT lang, source FROM docs),
found AS MATERIALIZED (
  SELECT rid, lang, source, term, count(*) AS n FROM (
    SELECT rid, lang, source, unnest(regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM docs
  ) GROUP BY ALL
),
kept AS MATERIALIZED (SELECT lang, term, sum(n) AS lang_n FROM found GROUP BY lang, term HAVING count(*) >= 30),
counts AS MATERIALIZED (SELECT lang, source, term, sum(n) AS n FROM found JOIN kept USING (lang, term) GROUP BY ALL),
langs AS (SELECT lang, count(term) AS v, coalesce(sum(lang_n), 0) AS lang_total FROM (SELECT DISTINCT lang FROM groups) LEFT JOIN kept USING (lang) GROUP BY lang),
totals AS MATERIALIZED (
  SELECT g.lang, g.source, l.v, l.lang_total, coalesce(sum(c.n), 0) AS total
  FROM groups g JOIN langs l USING (lang) LEFT JOIN counts c USING (lang, source) GROUP BY ALL
),
shares AS MATERIALIZED (
  SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (t.total + 5 * t.v) AS p,
    1 + (1000000000::HUGEINT * (k.lang_n + 5)) // (t.lang_total + 5 * t.v) AS q
  FROM totals t JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term
),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
),
every_pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (
    FROM every_pair UNION ALL SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q
  )
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""


def _round(number: int) -> str:
    """The centroids after one more round, and the vectors assigned to them."""
    before, after = f"c{number - 1}", f"c{number}"
    return f"""
s{number} AS (SELECT cluster, k, sum(v[k]) AS s, count(*) AS n FROM a{number - 1}, range(1, {SIZE + 1}) AS r(k) GROUP BY ALL),
m{number} AS (
  SELECT cluster, list(((s - (((s % n) + n) % n)) // n)::BIGINT ORDER BY k) AS v FROM s{number} GROUP BY cluster
),
{after} AS MATERIALIZED (SELECT cluster, coalesce(m.v, c.v) AS v FROM {before} c LEFT JOIN m{number} m USING (cluster)),
{_assigned(number)}"""


def _assigned(number: int) -> str:
    # distance and number of the centroid in one integer, whose least is the nearest and then the smallest number
    distance = "list_sum(list_transform(list_zip(x.v, c.v), lambda p: ((p[1] - p[2]) * (p[1] - p[2]))::HUGEINT))"
    return f"""a{number} AS MATERIALIZED (
  SELECT rid, vec_id, x.v, min({distance} * {CENTROIDS} + c.cluster) AS best, best % {CENTROIDS} AS cluster, best // {CENTROIDS} AS distance
  FROM kept x, c{number} c GROUP BY ALL
)"""


OP13 = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda x: isfinite(x::DOUBLE))) = {SIZE}
),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), v) - 1 AS cluster, v FROM kept ORDER BY cluster LIMIT {CENTROIDS}
),
{_assigned(0)},
{",".join(_round(k) for k in range(1, ROUNDS + 1))}
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance,
  CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} c USING (cluster)
"""

LLM_ORACLES: dict[str, str] = {"op11_window_dedup": OP11, "op12_source_divergence": OP12, "op13_centroids": OP13}
