"""DuckDB SQL of the operators that plain SQL can express on whole tables."""

ORACLE: dict[str, str] = {}

ORACLE["op1_substring_dedup"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
word AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
win AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
gone AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS f FROM win) WHERE f < doc_id),
hit AS (SELECT DISTINCT doc_id, i + j AS p FROM gone, range(50) AS t(j)),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN hit USING (doc_id, p) GROUP BY doc_id),
lost AS (SELECT doc_id, count(*) AS n FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN lost USING (doc_id)
"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE["op7_decontaminate"] = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
phrase AS (
  SELECT DISTINCT item, n, md5(array_to_string(list_slice(w, i, i + n - 1), ' ')) AS k
  FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT item, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0))),
win AS (
  SELECT doc_id, n, i, md5(array_to_string(list_slice(w, i, i + n - 1), ' ')) AS k
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM phrase))),
found AS (SELECT doc_id, i, n, item FROM win JOIN phrase USING (n, k)),
hit AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM found, range(10) AS t(j) WHERE j < found.n GROUP BY doc_id),
items AS (SELECT doc_id, count(item) AS n, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

ORACLE["op9_suffix_dedup"] = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
win AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 100)) AS k FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 49)) AS i FROM d)),
gone AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS f FROM win) WHERE f < doc_id),
edge AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM gone),
run AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM edge),
span AS (SELECT doc_id, r, min(i) AS a, max(i) + 50 AS b FROM run GROUP BY doc_id, r),
lost AS (SELECT doc_id, count(*) AS spans, sum(b - a) AS n FROM span GROUP BY doc_id),
cut AS (SELECT doc_id, b AS a, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS b FROM (SELECT doc_id, a, b FROM span UNION ALL SELECT doc_id, -1, 0 FROM d)),
kept AS (SELECT doc_id, string_agg(substr(x, 2 * cut.a + 1, 2 * (coalesce(cut.b, length(x) // 2) - cut.a)), '' ORDER BY cut.a) AS x
         FROM cut JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, length(d.x) // 2 AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(kept.x)) AS kept_sha256
FROM d LEFT JOIN lost USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

# Words q apart are compared at every distance q at which a word recurs; a
# stretch that a shorter period already covers is not of its smallest period.
ORACLE["op11_periodic_runs"] = r"""
WITH z AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
      lambda x, c: list_reduce(list_prepend(xor(x, c), range(8)), lambda y, i: xor(y >> 1, CASE WHEN y & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END))) AS c
  FROM documents),
e AS (SELECT doc_id, w, len(w) AS n, xor(c, 4294967295::BIGINT) AS h, xor(c, 4294967295::BIGINT) // 10 AS g FROM z),
t AS (SELECT doc_id, w, n, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n ELSE n END AS a, 1 + CASE WHEN n > 0 THEN (n - g % n) // (3 + g % 8) ELSE 0 END AS p FROM e),
word AS (SELECT doc_id, i, w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END] AS x FROM (SELECT doc_id, w, a, p, unnest(range(n)) AS i FROM t)),
often AS (SELECT doc_id, i, x, n FROM word JOIN (SELECT doc_id, x, count(*) AS k FROM word GROUP BY ALL HAVING count(*) >= 4) USING (doc_id, x) JOIN (SELECT doc_id, n FROM t) USING (doc_id)),
pair AS (SELECT l.doc_id, r.i - l.i AS q, l.i FROM often AS l JOIN often AS r ON l.doc_id = r.doc_id AND l.x = r.x AND r.i > l.i AND 4 * (r.i - l.i) <= l.n),
island AS (
  SELECT doc_id, q, min(i) AS s, count(*) + q AS len FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS o FROM pair)
  GROUP BY doc_id, q, o HAVING count(*) + q >= greatest(6, 4 * q)),
run AS (SELECT * FROM island AS l WHERE NOT EXISTS (
  SELECT 1 FROM island AS r WHERE r.doc_id = l.doc_id AND r.q < l.q AND r.s <= l.s AND r.s + r.len >= l.s + l.len)),
best AS (SELECT doc_id, count(*) AS n, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS lines,
  max({'l': len, 's': -s, 'p': -q}) AS m FROM run GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM word WHERE NOT EXISTS (
  SELECT 1 FROM run WHERE run.doc_id = word.doc_id AND i >= s + q AND i < s + len) GROUP BY doc_id)
SELECT t.doc_id, coalesce(best.n, 0) AS n_runs, CAST(-m.s AS BIGINT) AS start, CAST(m.l AS BIGINT) AS length, CAST(-m.p AS BIGINT) AS period,
  CAST(1000 * m.l // -m.p AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM t LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

_INTS = """SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""

ORACLE["op12_exact_topk"] = f"""
WITH e AS ({_INTS}),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
      FROM e AS q JOIN e AS c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def _lloyd(rounds: int, parts: int = 16, entries: int = 64) -> str:
    """Assignments ``a{i}`` to the codebooks ``b{i}``, made in turn."""
    steps = [f"""part AS (SELECT row, p, j, CAST(v[1 + p * (len(v) // {parts}) + j] AS BIGINT) AS x
  FROM (SELECT row, v, p, unnest(range(len(v) // {parts})) AS j FROM (SELECT row, v, unnest(range({parts})) AS p FROM e))),
b0 AS (SELECT p, row AS k, j, x FROM part WHERE row < {entries})"""]
    for i in range(rounds + 1):
        steps.append(f"""far{i} AS (SELECT row, part.p, k, sum((part.x - b.x) * (part.x - b.x)) AS d FROM part JOIN b{i} AS b ON part.p = b.p AND part.j = b.j GROUP BY row, part.p, k),
a{i} AS MATERIALIZED (SELECT row, p, k, d FROM far{i} QUALIFY row_number() OVER (PARTITION BY row, p ORDER BY d, k) = 1)""")
        if i < rounds:
            steps.append(f"""m{i} AS (SELECT p, k, j, sum(x) AS s, count(*) AS n FROM part JOIN a{i} USING (row, p) GROUP BY p, k, j),
b{i + 1} AS MATERIALIZED (SELECT p, k, j, CAST(coalesce((s - ((s % n) + n) % n) // n, x) AS BIGINT) AS x FROM b{i} LEFT JOIN m{i} USING (p, k, j))""")
    return ",\n".join(steps)


ORACLE["op13_vector_codes"] = f"""
WITH e AS (SELECT row_number() OVER (ORDER BY vec_id, v) - 1 AS row, vec_id, label, v FROM ({_INTS})),
{_lloyd(2)},
c AS (SELECT row, string_agg(printf('%02x', k), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY row)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, k, j)) FROM b2) AS codebooks_sha256
FROM c JOIN e USING (row)
"""
