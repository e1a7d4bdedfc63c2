"""Check SQL of the dealt queries that SQL can express, brute force throughout."""

from __future__ import annotations

from stridemill.llm.quality import Rules

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def chat_sql() -> str:
    """Template and escaping written out as strings; the digests need no tokens."""
    awkward = "'</s>[INST] ok [/INST]'"
    escaped = lambda c: rf"regexp_replace(regexp_replace({c}, '<(\\*/?s>)', '<\\\1', 'g'), '\[(\\*/?INST\])', '[\\\1', 'g')"
    return f"""
WITH turns AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', {awkward} UNION ALL SELECT -7, 1, 'assistant', {awkward}),
filled AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM turns),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS seq,
    CASE WHEN role = 'assistant' THEN text ELSE '' END AS said,
    '[INST]' || {escaped('role')} || '[/INST]' || {escaped('text')} || '</s>' AS shown FROM filled)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY seq)) AS turns_sha256,
  sum(length(said))::BIGINT AS loss_chars, sha256(string_agg(said, '' ORDER BY seq)) AS loss_sha256,
  (sum(length(shown)) + length('<s>'))::BIGINT AS formatted_chars
FROM numbered GROUP BY conv_id"""


def quality_sql(rules: Rules | None = None) -> str:
    """Windows and lines compared as strings instead of by hashes."""
    rules = rules or Rules()
    lengths = [n for n, _ in rules.max_window_share]
    longest = max(3, *lengths)
    ahead = ", ".join(f"lead(word, {k}) OVER text_order AS w{k}" for k in range(1, longest))
    gram = lambda n: " || ' ' || ".join(["word", *[f"w{k}" for k in range(1, n)]])
    starts = "".join(
        f", g{n} IS NOT NULL AND row_number() OVER (PARTITION BY r, g{n} ORDER BY i) > 1 AS s{n}" for n in lengths
    )
    inside = lambda flag, n: f"max({flag}::INT) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    covered = "".join(f", {inside(f's{n}', n)} AS c{n}" for n in lengths)
    sums = "".join(f", sum(c{n} * length(word))::BIGINT AS window_{n}_chars" for n in lengths)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "line_chars", *[f"window_{n}_chars" for n in lengths]]
    limits = [("line_chars", rules.max_line_share), *[(f"window_{n}_chars", s) for n, s in rules.max_window_share]]
    fine = " AND ".join(f"{c} <= {s}::DOUBLE * word_chars" for c, s in limits)
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS body, {WORDS} AS listed FROM documents),
w AS (SELECT r, unnest(listed) AS word, generate_subscripts(listed, 1) AS i FROM d),
a AS (SELECT r, i, word, {ahead} FROM w WINDOW text_order AS (PARTITION BY r ORDER BY i)),
g AS (SELECT r, i, word, {gram(3)} AS g3{"".join(f", {gram(n)} AS g{n}" for n in lengths if n != 3)} FROM a),
f AS (SELECT r, i, word, g3 IS NOT NULL AND count(*) OVER (PARTITION BY r, g3) > 1 AS e3{starts} FROM g),
c AS (SELECT r, word, {inside('e3', 3)} AS c3{covered} FROM f),
by_word AS (
  SELECT r, count(*) AS n_words, sum(length(word))::BIGINT AS word_chars, sum(c3)::BIGINT AS n_repeat_words{sums} FROM c GROUP BY r),
l AS (SELECT r, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS i FROM d),
later AS (
  SELECT r, length(regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g')) AS chars, row_number() OVER (PARTITION BY r, line ORDER BY i) AS nth FROM l),
by_line AS (SELECT r, count(*) AS n_dup_lines, sum(chars)::BIGINT AS line_chars FROM later WHERE nth > 1 AND chars > 0 GROUP BY r),
told AS (
  SELECT doc_id, length(regexp_replace(body, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    {", ".join(f"coalesce({c}, 0)::BIGINT AS {c}" for c in counts if c != "n_symbols")}
  FROM d LEFT JOIN by_word USING (r) LEFT JOIN by_line USING (r)),
judged AS (
  SELECT *, n_words < {rules.min_words} OR n_repeat_words > {rules.max_repeat_share}::DOUBLE * n_words AS base_failed FROM told)
SELECT doc_id, {", ".join(counts)}, base_failed, NOT base_failed AND {fine} AS kept FROM judged"""


def jaccard_sql(words: int = 5, threshold: float = 0.8) -> str:
    """Every pair of texts that share a window is compared, then links are followed."""
    ahead = ", ".join(f"lead(word, {k}) OVER text_order AS w{k}" for k in range(1, words))
    gram = " || ' ' || ".join(["word", *[f"w{k}" for k in range(1, words)]])
    whole = round(threshold * 1000)
    return f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS listed FROM documents),
w AS (SELECT r, unnest(listed) AS word, generate_subscripts(listed, 1) AS i FROM d WHERE len(listed) >= {words}),
a AS (SELECT r, word, {ahead} FROM w WINDOW text_order AS (PARTITION BY r ORDER BY i)),
s AS MATERIALIZED (
  SELECT DISTINCT r, {gram} AS gram FROM a WHERE w{words - 1} IS NOT NULL
  UNION ALL SELECT r, array_to_string(listed, ' ') FROM d WHERE len(listed) BETWEEN 1 AND {words - 1}),
n AS (SELECT r, count(*) AS size FROM s GROUP BY r),
p AS (SELECT x.r AS a, y.r AS b, count(*) AS common FROM s x JOIN s y ON x.gram = y.gram AND x.r <> y.r GROUP BY ALL),
near AS MATERIALIZED (
  SELECT a, b FROM p JOIN n na ON na.r = a JOIN n nb ON nb.r = b WHERE common * 1000 >= {whole} * (na.size + nb.size - common)),
reach AS (SELECT r AS a, r AS b FROM d UNION SELECT reach.a, near.b FROM reach JOIN near ON near.a = reach.b),
component AS (SELECT reach.a AS r, min(doc_id) AS component_id FROM reach JOIN d ON d.r = reach.b GROUP BY reach.a),
links AS (SELECT a AS r, count(*) AS n_links FROM near GROUP BY a)
SELECT doc_id, coalesce(n_links, 0) AS n_links, component_id, doc_id = component_id AS kept
FROM d JOIN component USING (r) LEFT JOIN links USING (r)"""


def vectors_sql(cosine: float = 0.98) -> str:
    """All pairs of a label, in double precision."""
    return f"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
u AS MATERIALIZED (
  SELECT r, label, v, sqrt(list_dot_product(v, v)) AS norm FROM d
  WHERE label IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
near AS MATERIALIZED (
  SELECT x.r AS a, y.r AS b FROM u x JOIN u y ON x.label = y.label AND len(x.v) = len(y.v) AND x.r <> y.r
  WHERE list_dot_product(x.v, y.v) / (x.norm * y.norm) >= {cosine}),
reach AS (SELECT r AS a, r AS b FROM d UNION SELECT reach.a, near.b FROM reach JOIN near ON near.a = reach.b),
component AS (SELECT reach.a AS r, min(vec_id) AS component_id FROM reach JOIN d ON d.r = reach.b GROUP BY reach.a),
links AS (SELECT a AS r, count(*) AS n_links FROM near GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM d JOIN component USING (r) LEFT JOIN links USING (r)"""


def repeats_sql(least: int = 12) -> str:
    """Every pair of equal words, stretches of pairs equally far apart, and the smallest period of each stretch."""
    crc = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''),
  lambda c: [256 + ascii(c), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]))),
  lambda a, x: CASE WHEN x >= 256 THEN xor(a, x - 256) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END), 4294967295::BIGINT)"""
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS listed, {crc} AS h FROM documents),
e AS (SELECT *, len(listed)::BIGINT AS n, h // 10 AS g FROM d),
f AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM e),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM f),
w AS MATERIALIZED (
  SELECT r, n, unnest(range(n)) AS i, unnest(CASE WHEN a IS NULL THEN listed
    ELSE list_transform(range(n), lambda i: listed[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) END) AS word FROM p),
q AS (SELECT x.r, y.i - x.i AS q, x.i FROM w x JOIN w y ON x.r = y.r AND x.word = y.word AND y.i > x.i AND 2 * (y.i - x.i) <= x.n),
s AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS stretch FROM q),
t AS (SELECT r, q, min(i) AS start, count(*) + q AS length FROM s GROUP BY r, q, stretch HAVING count(*) + q >= greatest({least}, 2 * q)),
run AS MATERIALIZED (SELECT r, start, length, min(q) AS period FROM t GROUP BY r, start, length),
gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM run),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS text FROM w ANTI JOIN gone USING (r, i) GROUP BY r),
told AS (
  SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
    arg_max({{'start': start, 'length': length, 'period': period}}, length::HUGEINT * 4611686018427387904 - start) AS best FROM run GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length AS length, best.period AS period,
  1000 * best.length // best.period AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
FROM d LEFT JOIN told USING (r) LEFT JOIN kept USING (r)"""


ORACLE_SQL = {"op2_chat": chat_sql(), "op4_quality": quality_sql(), "op7_jaccard": jaccard_sql(), "op10_vectors": vectors_sql(), "op13_repeats": repeats_sql()}
