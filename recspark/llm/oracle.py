"""DuckDB SQL of the queries that SQL can express."""

from statistics import NormalDist

from recspark.llm import secretscan

ORACLES: dict[str, str] = {}

ORACLES["op2_warc"] = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages
), f AS (SELECT d, min(page_id) AS first_id FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
  CASE WHEN first_id IS NULL OR first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d
"""

ORACLES["op5_decontaminate"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[p:p + 9], ' ') AS s
  FROM i, unnest(range(1, greatest(len(w) - 10, 0) + 2)) t(p) WHERE len(w) > 0
), dw AS (
  SELECT doc_id, p, k, array_to_string(w[p:p + k - 1], ' ') AS s
  FROM d, (SELECT DISTINCT k FROM iw) ks, unnest(range(1, len(w) - k + 2)) t(p) WHERE len(w) >= k
), m AS (SELECT doc_id, p, k, item_id FROM dw JOIN iw USING (s, k)),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM m, unnest(range(p, p + k)) u(q) GROUP BY doc_id),
it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM m) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)
"""

ORACLES["op6_chat"] = """
WITH t AS (
  SELECT conv_id, coalesce(turn, -1) AS turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS said FROM conversations
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, said) AS nth FROM t
), s AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system'
), r AS (
  SELECT n.conv_id, speaker, CAST((nth - 1) // 1024 AS INTEGER) AS part, nth, role = speaker AS mine,
    CASE WHEN role = speaker THEN '<|assistant|>' || chr(10) WHEN role = 'system' THEN '<|system|>' || chr(10)
      ELSE '<|user:' || role || '|>' || chr(10) END AS head, said || '<|end|>' || chr(10) AS body
  FROM n JOIN s ON n.conv_id IS NOT DISTINCT FROM s.conv_id
), p AS (
  SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, speaker, part ORDER BY nth) AS stop FROM r
)
SELECT conv_id, speaker, part,
  CAST(count(*) AS INTEGER) AS n_turns, string_agg(head || body, '' ORDER BY nth) AS text,
  string_agg(CASE WHEN mine THEN (stop - length(body)) || '-' || stop END, ',' ORDER BY nth) AS spans,
  CAST(sum(CASE WHEN mine THEN length(body) ELSE 0 END) AS INTEGER) AS masked
FROM p GROUP BY conv_id, speaker, part
"""

ORACLES["op12_negatives"] = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
)
SELECT p.anchor_id, p.other AS positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, p.other ORDER BY s.score DESC, s.other) AS INTEGER) AS rank,
  s.other AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
QUALIFY rank <= 3
"""


def _tree(name: str, leaves: str, levels: int = 6) -> str:
    """Nodes {name}0 ... by level (g, i, d, c: how many the level has), runs {name}r0 ..., and the roots {name}root (g, d)."""
    ctes = [f"{name}0 AS (SELECT g, i, d, count(*) OVER (PARTITION BY g) AS c FROM ({leaves}))"]
    for k in range(levels):
        ctes.append(f"{name}r{k} AS (SELECT g, i // 16 AS r, list(d ORDER BY i) AS run FROM {name}{k} WHERE c > 1 GROUP BY g, i // 16)")
        ctes.append(
            f"{name}{k + 1} AS (SELECT g, r AS i, sha256(array_to_string(run, '')) AS d, count(*) OVER (PARTITION BY g) AS c FROM {name}r{k})"
        )
    ends = " UNION ALL ".join(f"SELECT g, d FROM {name}{k} WHERE c = 1" for k in range(levels + 1))
    return ", ".join([*ctes, f"{name}root AS ({ends})"])


def _climb(name: str, tree: str, start: str, levels: int = 6) -> str:
    """From `start` (id, g, i, cur, sib) to {name}{levels}: the folded digest and the siblings passed."""
    ctes = [f"{name}0 AS ({start})"]
    for k in range(levels):
        ctes.append(f"""{name}{k + 1} AS (
  SELECT id, p.g, i // 16 AS i, CASE WHEN run IS NULL THEN cur
      ELSE sha256(array_to_string(run[:i % 16], '') || cur || array_to_string(run[i % 16 + 2:], '')) END AS cur,
    CASE WHEN run IS NULL THEN sib ELSE sib || array_to_string(run[:i % 16], '') || array_to_string(run[i % 16 + 2:], '') END AS sib
  FROM {name}{k} p LEFT JOIN {tree}r{k} t ON p.g = t.g AND p.i // 16 = t.r
)""")
    return ", ".join(ctes)


def _leaf(text: str) -> str:
    fields = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
    return "sha256(" + " || ".join(f"coalesce(CAST(strlen({f}) AS VARCHAR) || ':' || {f}, '-')" for f in fields) + ")"


# crc32 bit by bit; six levels of runs, so up to 16^6 documents per source.
ORACLES["op13_merkle"] = f"""
WITH d AS (
  SELECT row_number() OVER () AS id, doc_id, coalesce('1' || source, '0') AS g, {_leaf("text")} AS leaf,
    {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS altered,
    text IS NOT NULL AND xor(list_reduce(
      list_concat([4294967295], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: [ascii(ch), 0, 0, 0, 0, 0, 0, 0]))),
      lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1))), 4294967295) % 5 = 0 AS hit
  FROM documents
), l AS (
  SELECT id, doc_id, g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, id) - 1 AS i, leaf AS d,
    CASE WHEN hit THEN altered ELSE leaf END AS cur FROM d
), {_tree("s", "SELECT g, i, d FROM l")},
{_tree("t", "SELECT 0 AS g, row_number() OVER (ORDER BY g) - 1 AS i, d FROM sroot")},
{_climb("p", "s", "SELECT id, g, i, cur, '' AS sib FROM l")},
{_climb("q", "t", "SELECT id, 0 AS g, t.i, cur, sib FROM p6 p JOIN (SELECT g AS n, row_number() OVER (ORDER BY g) - 1 AS i FROM sroot) t ON p.g = t.n")}
SELECT l.doc_id, l.d AS leaf, sroot.d AS subroot, troot.d AS root, sha256(sib) AS proof_sha256, q6.cur AS folded_root,
  q6.cur = troot.d AS verified
FROM q6 JOIN l USING (id) JOIN sroot ON l.g = sroot.g CROSS JOIN troot
"""

_ASSIGN = (
    "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    """["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
)
_SHAPES = [_ASSIGN, "AKIA[A-Z0-9]{12,}", "[0-9a-f]{32,}", f"[A-Za-z0-9+/_-]{{{secretscan.SHORTEST},}}"]
_FOUND = " UNION ALL ".join(
    f"SELECT id, {i} AS kind, string_split_regex(t, '{p}') AS gaps, regexp_extract_all(t, '{p}') AS found FROM d" for i, p in enumerate(_SHAPES)
)
_ENCODED = " ".join(f"WHEN regexp_full_match(tok, '[{a.replace('-', chr(92) + '-')}]*') THEN {i}" for i, a in enumerate(secretscan.ALPHABETS.values()))
_NORMAL = NormalDist()
_CHANCES = [_NORMAL.cdf(-i / secretscan.GRID) for i in range(-secretscan.FURTHEST * secretscan.GRID, secretscan.FURTHEST * secretscan.GRID + 1)]
_BANDS = " + ".join(f"CAST(n >= {b} AS INTEGER)" for b in secretscan.BANDS)
_RANDOM = len(_SHAPES) - 1
_ONE_CASE = ", ".join(str(i) for i, name in enumerate(secretscan.ALPHABETS) if name in secretscan.ONE_CASE)

ORACLES["op11_secrets"] = f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t FROM documents),
k AS ({_FOUND}),
m AS (SELECT id, kind, unnest(range(1, len(found) + 1)) AS i, gaps, found FROM k WHERE len(found) > 0),
pl AS (
  SELECT id, kind, CAST(sum(length(gaps[i]) + length(found[i])) OVER (PARTITION BY id, kind ORDER BY i) AS BIGINT) AS e,
    length(found[i]) AS n, found[i] AS tok FROM m
), placed AS (
  SELECT id, kind, e - n AS s, e, n, tok FROM pl WHERE kind <> 0 OR length(regexp_extract(tok, '{_ASSIGN}', 2)) >= {secretscan.ASSIGNED}
), alphabet AS (SELECT unnest(range({len(secretscan.ALPHABETS)})) AS enc, unnest({list(secretscan.ALPHABETS.values())}) AS letters),
cand AS (SELECT *, CASE {_ENCODED} END AS enc FROM placed WHERE kind = {_RANDOM}),
sized AS (SELECT c.*, letters, length(letters) AS m FROM cand c JOIN alphabet USING (enc)),
signs AS (
  SELECT id, s, n, m, i, CAST(strpos(letters, tok[i]) - 1 AS BIGINT) AS x FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM sized)
), steps AS (SELECT *, lag(x) OVER (PARTITION BY id, s ORDER BY i) AS y FROM signs),
squares AS (SELECT id, s, CAST(sum(c * c) AS BIGINT) AS squares FROM (SELECT id, s, x, count(*) AS c FROM signs GROUP BY ALL) GROUP BY ALL),
sums AS (
  SELECT id, s, CAST(any_value(n) AS DOUBLE) AS n, any_value(m) AS m, CAST(sum(x) AS BIGINT) AS total, CAST(sum(x * x) AS BIGINT) AS power,
    CAST(coalesce(sum(x * y), 0) AS BIGINT) AS lagged, sum(CASE WHEN (2 * x < m) <> (2 * y < m) THEN 1 ELSE 0 END) AS changes,
    arg_min(x, i) + arg_max(x, i) AS ends
  FROM steps GROUP BY id, s
), meas AS (
  SELECT id, s, n, m, squares, m / n * squares - n AS chi, (changes - (n - 1) / 2) / (sqrt(n - 1) / 2) AS runs,
    CASE WHEN power - n * (total / n) * (total / n) > 1e-9 THEN
      ((lagged - total / n * (2 * total - ends) + (n - 1) * (total / n) * (total / n)) / (power - n * (total / n) * (total / n)) + 1 / n) * sqrt(n)
      ELSE {secretscan.FURTHEST} END AS serial
  FROM sums JOIN squares USING (id, s)
), words AS (
  SELECT w FROM (SELECT unnest(regexp_extract_all(t, '[A-Za-z0-9+/_-]+')) AS w FROM d) WHERE length(w) < {secretscan.SHORTEST}
), used AS (SELECT sign, count(*) AS c FROM (SELECT unnest(string_split(w, '')) AS sign FROM words) GROUP BY sign),
members AS (SELECT enc, unnest(string_split(letters, '')) AS sign FROM alphabet),
folded AS (SELECT lower(sign) AS sign, sum(c) AS c FROM used GROUP BY 1),
counted AS (
  SELECT enc, c FROM members LEFT JOIN used USING (sign) WHERE enc NOT IN ({_ONE_CASE})
  UNION ALL SELECT enc, c FROM members m LEFT JOIN folded f ON lower(m.sign) = f.sign WHERE enc IN ({_ONE_CASE})
), shares AS (SELECT enc, (coalesce(c, 0) + 1.0) / sum(coalesce(c, 0) + 1.0) OVER (PARTITION BY enc) AS p FROM counted),
ordinary AS (SELECT enc, sum(pow(p, 2)) AS s2, sum(pow(p, 3)) AS s3 FROM shares GROUP BY enc),
below AS (
  SELECT meas.id, meas.s, meas.n, meas.m, chi, runs, serial, (meas.n + meas.n * (meas.n - 1) * s2 - squares)
    / sqrt(greatest(2 * meas.n * (meas.n - 1) * (s2 - s2 * s2 + 2 * (meas.n - 2) * (s3 - s2 * s2)), 1e-9)) AS z
  FROM meas JOIN cand ON meas.id = cand.id AND meas.s = cand.s JOIN ordinary USING (enc)
), tested AS (
  SELECT id, s, {_BANDS} AS band, CAST(floor(least(greatest(z, -{secretscan.FURTHEST}), {secretscan.FURTHEST}) * {secretscan.GRID}) AS INTEGER) AS step,
    (pow(greatest(chi, 0) / (m - 1), 1.0 / 3) - (1 - 2.0 / (9 * (m - 1)))) / sqrt(2.0 / (9 * (m - 1))) <= {_NORMAL.inv_cdf(1 - secretscan.ALPHA / 3)}
    AND abs(runs) <= {_NORMAL.inv_cdf(1 - secretscan.ALPHA / 6)} AND abs(serial) <= {_NORMAL.inv_cdf(1 - secretscan.ALPHA / 6)} AS random
  FROM below
), chance AS (SELECT unnest(range({-secretscan.FURTHEST * secretscan.GRID}, {secretscan.FURTHEST * secretscan.GRID + 1})) AS step, unnest({_CHANCES}) AS chance),
ranked AS (
  SELECT band, step, sum(count(*)) OVER (PARTITION BY band ORDER BY step DESC) AS beyond, sum(count(*)) OVER (PARTITION BY band) AS every
  FROM tested GROUP BY band, step
), bars AS (SELECT band, min(step) AS bar FROM ranked JOIN chance USING (step) WHERE chance * every <= {secretscan.RATE} * beyond GROUP BY band),
spans AS (
  SELECT id, kind, s, e FROM placed p WHERE kind < {_RANDOM}
  UNION ALL
  SELECT id, kind, s, e FROM placed p WHERE kind = {_RANDOM}
    AND EXISTS (SELECT 1 FROM tested t JOIN bars b USING (band) WHERE t.id = p.id AND t.s = p.s AND random AND step >= bar)
    AND NOT EXISTS (SELECT 1 FROM placed q WHERE q.id = p.id AND q.kind < {_RANDOM} AND q.s < p.e AND q.e > p.s)
), named AS (SELECT id, kind, s, {secretscan.KINDS}[kind + 1] || ':' || s || ':' || e AS span FROM spans),
joined AS (
  SELECT id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    string_agg(span, ',' ORDER BY s, kind) FILTER (kind < {_RANDOM}) AS base, string_agg(span, ',' ORDER BY s, kind) AS spans
  FROM named GROUP BY id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN joined USING (id)
"""
