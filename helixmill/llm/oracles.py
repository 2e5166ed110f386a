"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from helixmill.llm import quality

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP8 = rf"""
WITH d AS (
  SELECT doc_id, source, text, len({WORDS})::BIGINT AS size FROM documents),
k AS (
  SELECT *, greatest(0.1, 1 - coalesce(CASE WHEN size > 0 THEN (length(text) - length(translate(text, '#*$%&|<>!', ''))) / size::DOUBLE END, 0)) AS weight,
    (('0x' || substr(md5('17|' || doc_id), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS u FROM d),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS i FROM d GROUP BY source),
w AS (
  SELECT *, [5, 2, 1][((i - 1) % 3 + 1)::INT] AS w, 2.0::DOUBLE * source_size AS cap FROM s),
r AS (
  SELECT *, cap / w AS ratio, 1.5::DOUBLE * sum(source_size) OVER () AS budget,
    coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS given,
    sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM w),
l AS (SELECT *, max(CASE WHEN ratio >= (budget - given) / open THEN (budget - given) / open END) OVER () AS level FROM r),
t AS (
  SELECT source, source_size, CASE WHEN level IS NULL OR ratio <= level THEN cap ELSE w * level END AS target FROM l),
e AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
x AS (
  SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
    sum(k.size) OVER (PARTITION BY k.source ORDER BY -ln(u) / weight, k.doc_id ROWS UNBOUNDED PRECEDING) AS upto
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
  (size * (epochs + CASE WHEN upto - size / 2.0 <= rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM x
"""

OP9 = r"""
WITH l AS (
  SELECT doc_id, generate_subscripts(a, 1) AS pos, unnest(a) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)),
k AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT k.*, c.key IS NOT NULL AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

OP3 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, {WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS a FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(a) = 0 THEN [] WHEN len(a) = 1 THEN a ELSE list_transform(range(1, len(a)), lambda i: a[i] || ' ' || a[i + 1]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS v, doc_id AS m FROM documents UNION SELECT l.b, r.m FROM r JOIN l ON l.a = r.v)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.m AS component_id, d.doc_id = m.m AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT v, min(m) AS m FROM r GROUP BY v) m ON m.v = d.doc_id
"""

CONTROLS = r"\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|<s>|</s>|<\|role\|>|<\|text\|>|<\|end\|>"

OP4 = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
f AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '{CONTROLS}')) +
    CASE role WHEN 'user' THEN 13 WHEN 'system' THEN 15 WHEN 'assistant' THEN 7
      ELSE 23 + length(role) + len(regexp_extract_all(role, '{CONTROLS}')) END AS chars FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""

LN_GAMMA = repr(quality._LN_GAMMA)
LOWEST = quality._LOWEST
#: rule: (value, least spread, whether too low is also bad)
RULES = {
    "spw": ("n_symbols / n_words::DOUBLE", 0.05, False),
    "dup": ("n_dup_lines / n_lines::DOUBLE", 0.1, False),
    "rep": ("n_repeat_words / n_words::DOUBLE", 0.05, False),
    "mean": ("word_chars / n_words::DOUBLE", 0.5, True),
}


def _fences(name: str, *keys: str) -> str:
    """CTE with the quartiles of the sketches merged by `keys` and rule."""
    k = ", ".join([*keys, "rule"])
    value = f"CASE WHEN b <= {LOWEST} THEN 0.0 ELSE 2 * exp(b * {LN_GAMMA}) / (exp({LN_GAMMA}) + 1) END"
    quartile = lambda q: f"min(CASE WHEN upto >= {q} * total THEN b END)"
    return f"""{name} AS (SELECT {k}, total, {value.replace('b ', 'b1 ')} AS q1, {value.replace('b ', 'b3 ')} AS q3 FROM (SELECT {k}, max(total) AS total, {quartile(0.25)} AS b1, {quartile(0.75)} AS b3 FROM
  (SELECT *, sum(n) OVER (PARTITION BY {k} ORDER BY b) AS upto, sum(n) OVER (PARTITION BY {k}) AS total FROM (SELECT {k}, b, sum(n) AS n FROM sk GROUP BY {k}, b) z) y GROUP BY {k}) x)"""


def _inside() -> str:
    out = []
    for k, (x, _, both) in RULES.items():
        out.append(f"coalesce(({x}) <= {k}_high, TRUE)" + (f" AND coalesce(({x}) >= {k}_low, TRUE)" if both else ""))
    return " AND ".join(out)


OP1 = rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, {WORDS} AS a FROM documents),
g AS (SELECT doc_id, i, list_slice(a, i, i + 4) AS k FROM (SELECT doc_id, a, unnest(range(1, len(a) - 3)) AS i FROM d WHERE len(a) > 4) z),
r AS (SELECT DISTINCT doc_id, i + o AS i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS c FROM g) z CROSS JOIN (SELECT unnest(range(0, 5)) AS o) q WHERE c > 1),
rn AS (SELECT doc_id, count(*) AS n FROM r GROUP BY doc_id),
li AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) z WHERE regexp_matches(line, '[^ 	-
]') GROUP BY doc_id),
m AS (SELECT d.doc_id, lang, source, len(a)::BIGINT AS n_words, coalesce(list_sum(list_transform(a, lambda w: length(w))), 0)::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  coalesce(li.dup, 0)::BIGINT AS n_dup_lines, nullif(coalesce(li.n, 0), 0) AS n_lines, coalesce(rn.n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN li ON li.doc_id = d.doc_id LEFT JOIN rn ON rn.doc_id = d.doc_id),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
x AS ({' UNION ALL '.join(f"SELECT lang, source, '{k}' AS rule, {e} AS x FROM f WHERE NOT base_failed" for k, (e, _, _) in RULES.items())}),
sk AS (SELECT lang, source, rule, CASE WHEN x <= 1e-6 THEN {LOWEST} ELSE ceil(ln(x) / {LN_GAMMA})::INT END AS b, count(*) AS n FROM x WHERE x IS NOT NULL GROUP BY ALL),
{_fences("own", "lang", "source")},
{_fences("bylang", "lang")},
{_fences("byall")},
p AS (SELECT o.lang, o.source, o.rule, {', '.join(f"(o.total * o.{q} + 100.0::DOUBLE * ((l.total * l.{q} + 100.0::DOUBLE * e.{q}) / (l.total + 100.0::DOUBLE))) / (o.total + 100.0::DOUBLE) AS {q}" for q in ("q1", "q3"))}
  FROM own o JOIN bylang l ON o.lang IS NOT DISTINCT FROM l.lang AND o.rule = l.rule JOIN byall e ON e.rule = o.rule),
s AS (SELECT *, 4 * greatest(q3 - q1, CASE rule {' '.join(f"WHEN '{k}' THEN {s}" for k, (_, s, _) in RULES.items())} END) AS spread FROM p),
v AS (SELECT lang, source, {', '.join(f"max(q3 + spread) FILTER (WHERE rule = '{k}') AS {k}_high, max(q1 - spread) FILTER (WHERE rule = '{k}') AS {k}_low" for k in RULES)} FROM s GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {_inside()} AS kept
FROM f LEFT JOIN v ON f.lang IS NOT DISTINCT FROM v.lang AND f.source IS NOT DISTINCT FROM v.source
"""

OP11 = rf"""
WITH d AS (SELECT doc_id, {WORDS} AS a FROM documents),
g AS (SELECT doc_id, i, list_aggregate(list_slice(a, i, i + 49), 'string_agg', ' ') AS k FROM (SELECT doc_id, a, unnest(range(1, len(a) - 48)) AS i FROM d WHERE len(a) >= 50) z),
r AS (SELECT DISTINCT doc_id, i + o AS i FROM (SELECT *, min(doc_id) OVER (PARTITION BY k) AS owner FROM g) z CROSS JOIN (SELECT unnest(range(0, 50)) AS o) q WHERE owner < doc_id),
w AS (SELECT doc_id, generate_subscripts(a, 1) AS i, unnest(a) AS word FROM d),
m AS (SELECT w.*, r.i IS NOT NULL AS gone FROM w LEFT JOIN r ON w.doc_id = r.doc_id AND w.i = r.i),
k AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM m GROUP BY doc_id)
SELECT d.doc_id, len(a)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""



def _spent(state: str, cost: str, edits: str) -> str:
    """A state (cost in eight digits, then the audit) after further edits; the lesser string is cheaper, or least of equals."""
    return f"lpad((substr({state}, 1, 8)::BIGINT + {cost})::VARCHAR, 8, '0') || substr({state}, 9) || '{edits}'"


def _retained(edit: str, more: int, *before: str) -> str:
    return "least(" + ", ".join(_spent(b, f"{more} + late", edit) for b in (*before, before[0])) + ")"


ROLE_NEXT = "CASE WHEN r = 'u' THEN 'assistant' ELSE 'user' END"

OP12 = rf"""
WITH RECURSIVE z AS (
  SELECT list(v ORDER BY b) AS crc FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) t(b)) q),
k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT) AS bytes FROM conversations),
f AS (
  SELECT k.*, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS fate FROM k, z),
d AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM f WHERE fate <> 0
  UNION ALL SELECT conv_id, turn, role, text FROM f WHERE fate = 3),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, left(role, 1) AS init,
    regexp_extract(text, '([^ 	-
])[ 	-
]*$', 1) AS ending FROM d),
t AS (
  SELECT *, CASE WHEN ending = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN ending NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lead(init) OVER (PARTITION BY conv_id ORDER BY i) AS following FROM o),
c AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, {', '.join(f"count(*) FILTER (WHERE fault = '{x}')::BIGINT AS {x}" for x in ('blank', 'duplicate', 'truncated'))},
    (count(*) FILTER (WHERE following IS NOT NULL AND init || following NOT IN ('su', 'ua', 'au')))::BIGINT AS illegal FROM t GROUP BY conv_id),
p AS (
  SELECT conv_id, 0::BIGINT AS i, '00000000' AS q, NULL::VARCHAR AS s, NULL::VARCHAR AS u, NULL::VARCHAR AS a FROM c
  UNION ALL
  SELECT conv_id, i, {_spent('q', '4', 'D')},
    least({_spent('s', '4', 'D')}, CASE WHEN stays AND init = 's' THEN {_retained('K', 0, 'q')} END),
    least({_spent('u', '4', 'D')}, CASE WHEN stays AND init = 'u' THEN {_retained('K', 0, 'q', 's', 'a')} END, CASE WHEN stays THEN {_retained('R', 3, 'q', 's', 'a')} END),
    least({_spent('a', '4', 'D')}, CASE WHEN stays AND init = 'a' THEN {_retained('K', 0, 'u')} END, CASE WHEN stays THEN {_retained('R', 3, 'u')} END)
  FROM (SELECT conv_id, i, init, stays, late, q, s, u, least(a, {_spent('u', '3', 'I')}) AS a FROM (
    SELECT t.conv_id, t.i, t.init, fault NOT IN ('blank', 'duplicate') AS stays, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS late, q, s, a,
      least(u, {_spent('q', '3', 'I')}, {_spent('s', '3', 'I')}, {_spent('a', '3', 'I')}) AS u FROM p JOIN t ON t.conv_id IS NOT DISTINCT FROM p.conv_id AND t.i = p.i + 1) v) w),
e AS (
  SELECT c.*, least(q, a, {_spent('u', '3', 'I')}, {_spent('s', '6', 'II')}) AS best FROM c JOIN p ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND c.n = p.i),
b AS (SELECT conv_id, gaps, blank, duplicate, truncated, illegal, substr(best, 1, 8)::BIGINT AS cost, substr(best, 9) AS audit FROM e),
r AS (
  SELECT conv_id, audit, 0::BIGINT AS i, 0::BIGINT AS pos, '' AS r, NULL::VARCHAR AS said FROM b
  UNION ALL
  SELECT conv_id, audit, i + CASE edit WHEN 'I' THEN 0 ELSE 1 END, pos + 1, CASE edit WHEN 'D' THEN r WHEN 'K' THEN left(role, 1) ELSE left({ROLE_NEXT}, 1) END,
    CASE edit WHEN 'D' THEN said ELSE concat_ws(chr(10), said, CASE edit WHEN 'K' THEN role || ':' || text WHEN 'R' THEN {ROLE_NEXT} || ':' || text ELSE {ROLE_NEXT} || ':' END) END
  FROM (SELECT r.*, substr(audit, pos::INT + 1, 1) AS edit, t.role, t.text FROM r LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM r.conv_id AND t.i = r.i + 1 WHERE pos < length(audit)) v),
h AS (SELECT conv_id, sha256(coalesce(said, '')) AS repaired_sha256 FROM r WHERE pos = length(audit))
SELECT x.conv_id, {', '.join(f'coalesce({n}, 0)::BIGINT AS {n}' for n in ('gaps', 'blank', 'duplicate', 'truncated', 'illegal', 'cost'))}, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) x LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM x.conv_id LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM x.conv_id
"""

OP13 = r"""
WITH p AS (
  SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS a FROM p),
g AS (SELECT lang, m, list_aggregate(list_slice(a, i, i + m - 1), 'string_agg', ' ') AS phrase FROM (SELECT lang, a, m, unnest(range(1, len(a) - m + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS m) q WHERE len(a) >= m) z),
f AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY lang, m, phrase),
n AS (SELECT lang, sum(f) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT f.lang, phrase, m, f AS a, n, string_split(phrase, ' ') AS ws FROM f JOIN n ON n.lang = f.lang WHERE m > 1 AND f >= 100),
k AS (SELECT *, list_aggregate(ws[1:k], 'string_agg', ' ') AS head, list_aggregate(ws[k + 1:], 'string_agg', ' ') AS tail FROM (SELECT *, unnest(range(1, m)) AS k FROM c) z),
s AS (
  SELECT k.*, h.f AS l, t.f AS r, (1000 * a::HUGEINT * n::HUGEINT) // (h.f::HUGEINT * t.f::HUGEINT) AS score
  FROM k JOIN f h ON h.lang = k.lang AND h.phrase = k.head AND h.m = k.k JOIN f t ON t.lang = k.lang AND t.phrase = k.tail AND t.m = k.m - k.k),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
x AS (SELECT DISTINCT lang, list_aggregate(ws[i:i + j - 1], 'string_agg', ' ') AS phrase, a FROM (SELECT *, unnest(range(1, m - j + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS j FROM c WHERE m > 2) z) y),
o AS (
  SELECT lang, phrase, a, l, r, n, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM b WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.lang = b.lang AND x.phrase = b.phrase AND 100 * x.a >= 100 * b.a))
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM o WHERE rank <= 2000
"""

ORACLES = {"op1_quality_rules": OP1, "op11_substring_dedup": OP11, "op12_conversation_repair": OP12, "op13_phrase_collocations": OP13, "op4_chat_formatting": OP4, "op3_minhash_near_dedup": OP3, "op8_source_mixing": OP8, "op9_line_dedup": OP9}
