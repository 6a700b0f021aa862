"""DuckDB counterparts of the queries that SQL can express."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

ORACLE["op7_chat_snapshots"] = """
WITH prefixes AS (
    SELECT conv_id, turn,
        row_number() OVER w AS place,
        string_agg('<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '') OVER w AS chat,
        lead(conv_id) OVER (PARTITION BY conv_id ORDER BY turn) IS NOT NULL AS more
    FROM conversations
    WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)
SELECT min(conv_id) AS conv_id, CAST(place AS BIGINT) AS n_turns, count(*) AS n_copies, chat
FROM prefixes
WHERE NOT more AND chat NOT IN (SELECT chat FROM prefixes WHERE more)
GROUP BY place, chat
"""

# Runs of two non-blank lines; a line goes if it lies in a run that stood earlier.
ORACLE["op9_line_dedup"] = r"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
        generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
    FROM documents
), stripped AS (
    SELECT doc_id, line, place, trim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) AS bare FROM lines
), counted AS (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS k FROM stripped WHERE bare <> ''
), runs AS (
    SELECT doc_id, k, bare AS one, lead(bare) OVER (PARTITION BY doc_id ORDER BY k) AS two FROM counted
), later AS (
    SELECT doc_id, k FROM (
        SELECT doc_id, k, row_number() OVER (PARTITION BY one, two ORDER BY doc_id, k) AS copy
        FROM runs WHERE two IS NOT NULL
    ) WHERE copy > 1
), single AS (
    SELECT doc_id, k FROM (
        SELECT doc_id, k, row_number() OVER (PARTITION BY bare ORDER BY doc_id, k) AS copy
        FROM counted WHERE len(regexp_extract_all(bare, '[^\x20\x09-\x0D]+')) >= 50
    ) WHERE copy > 1
), gone AS (
    SELECT doc_id, k FROM later UNION SELECT doc_id, k + 1 FROM later UNION SELECT doc_id, k FROM single
), totals AS (
    SELECT c.doc_id, count(*) AS n_lines, count(g.k) AS n_removed
    FROM counted c LEFT JOIN gone g ON g.doc_id = c.doc_id AND g.k = c.k GROUP BY c.doc_id
), left_over AS (
    SELECT s.doc_id, string_agg(s.line, chr(10) ORDER BY s.place) AS text
    FROM stripped s LEFT JOIN counted c ON c.doc_id = s.doc_id AND c.place = s.place
        LEFT JOIN gone g ON g.doc_id = c.doc_id AND g.k = c.k
    WHERE g.k IS NULL GROUP BY s.doc_id
)
SELECT d.doc_id,
    CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(l.text, '') END AS text,
    coalesce(t.n_lines, 0) AS n_lines, coalesce(t.n_removed, 0) AS n_removed
FROM documents d LEFT JOIN totals t ON t.doc_id = d.doc_id LEFT JOIN left_over l ON l.doc_id = d.doc_id
"""

# Shares by weight, cut at three times a source's words; then documents by exponential keys.
ORACLE["op12_mix_sources"] = r"""
WITH weights AS (
    SELECT doc_id, max(CASE WHEN quality > 0 THEN 2.0::DOUBLE WHEN quality = 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END) AS weight
    FROM labels GROUP BY doc_id
), slim AS (
    SELECT d.doc_id, source, coalesce(weight, 1.0::DOUBLE) AS weight, row_number() OVER () AS place,
        CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
        md5('12:' || coalesce(CAST(d.doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS drawn
    FROM documents d LEFT JOIN weights w ON w.doc_id = d.doc_id
), keyed AS (
    SELECT *, -ln((CAST('0x' || left(drawn, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) / weight AS score FROM slim
), sizes AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS words FROM slim GROUP BY source
), shares AS (
    SELECT *, 3 * words AS cap, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM sizes
), levels AS (
    SELECT *, (SELECT sum(words) FROM sizes) - coalesce(sum(cap) OVER o, 0) AS unspent,
        (SELECT sum(w) FROM shares) - coalesce(sum(w) OVER o, 0) AS rest, row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS k
    FROM shares
    WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
    SELECT k, unspent, rest FROM levels WHERE unspent * w <= cap * rest ORDER BY k LIMIT 1
), targets AS (
    SELECT s.source, s.words, CASE WHEN s.k < l.k THEN CAST(s.cap AS DOUBLE)
        ELSE least(CAST(l.unspent * s.w AS DOUBLE) / CAST(l.rest AS DOUBLE), CAST(s.cap AS DOUBLE)) END AS target
    FROM levels s, level l
), placed AS (
    SELECT doc_id, size, words, target, CAST(floor(target + 0.5) AS BIGINT) AS budget,
        CAST(coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY score, doc_id, size, place
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
    FROM keyed k JOIN targets t ON t.source IS NOT DISTINCT FROM k.source
)
SELECT doc_id, size, words AS source_size, target,
    CASE WHEN words = 0 THEN 0 ELSE budget // words * size + least(greatest(budget % words - before, 0), size) END AS taken
FROM placed
"""


def _clusters(rounds: int) -> str:
    """Lloyd's rounds in integers, one after the other."""
    parts = ["""rows AS (
    SELECT row_number() OVER () AS id, vec_id, embedding FROM embeddings WHERE len(embedding) = 64
), x AS (
    SELECT id, i, CAST(floor(1024 * c) AS BIGINT) AS v FROM (
        SELECT id, i, CAST(embedding[i] AS DOUBLE) AS c, count(embedding[i]) FILTER (WHERE isfinite(embedding[i])) OVER (PARTITION BY id) AS good
        FROM rows, range(1, 65) r(i)
    ) WHERE good = 64
), vectors AS (
    SELECT id, vec_id FROM rows WHERE id IN (SELECT id FROM x)
), c0 AS (
    SELECT cluster, i, v FROM (
        SELECT id, row_number() OVER (ORDER BY vec_id IS NULL, sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), 'null'))) - 1 AS cluster FROM vectors
    ) JOIN x USING (id) WHERE cluster < 8
)"""]
    for n in range(rounds + 1):
        parts.append(f"""d{n} AS (
    SELECT id, cluster, sum((x.v - c.v) * (x.v - c.v)) AS distance FROM x JOIN c{n} c USING (i) GROUP BY id, cluster
), a{n} AS (
    SELECT id, cluster, distance FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, cluster) AS k FROM d{n}) WHERE k = 1
)""")
        if n < rounds:
            parts.append(f"""c{n + 1} AS (
    SELECT c.cluster, c.i, coalesce(m.v, c.v) AS v FROM c{n} c LEFT JOIN (
        SELECT cluster, i, CAST(floor(CAST(sum(v) AS DOUBLE) / count(*)) AS BIGINT) AS v FROM a{n} JOIN x USING (id) GROUP BY cluster, i
    ) m ON m.cluster = c.cluster AND m.i = c.i
)""")
    last = f"""SELECT vec_id, CAST(a.cluster AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance,
    CAST(sum(distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
    h.digest AS centroid_sha256
FROM a{rounds} a JOIN vectors USING (id)
JOIN (SELECT cluster, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY i)) AS digest FROM c{rounds} GROUP BY cluster) h ON h.cluster = a.cluster"""
    return "WITH " + ", ".join(parts) + "\n" + last


ORACLE["op13_centroids"] = _clusters(10)
