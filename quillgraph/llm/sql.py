"""DuckDB SQL for the rows of those queries that SQL can express.

Each is a plain statement of what is asked for, not of the method: all pairs that
share a shingle, all windows, all n-grams.
"""

from __future__ import annotations

from . import chat_format, source_mix
from .quality_rules import Limits

_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"

JACCARD_JOIN = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, {_WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) END) AS shingle FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT shingle FROM s GROUP BY shingle HAVING count(*) > 1),
t AS (SELECT s.* FROM s JOIN shared USING (shingle)),
links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM t a JOIN t b USING (shingle) JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, l.v FROM reach r JOIN links l ON l.u = r.other)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT min(other) FROM reach r WHERE r.doc_id = d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id)
"""

SUBSTRING_DEDUP = f"""
WITH d AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS k, w FROM d WHERE len(w) >= 50),
keyed AS (SELECT doc_id, k, array_to_string(w[k:k + 49], ' ') AS content FROM win),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 50)) AS k FROM (SELECT doc_id, k, min(doc_id) OVER (PARTITION BY content) AS first FROM keyed) WHERE first < doc_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS text FROM words ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(lost.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN lost USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def quality_rules(limits: Limits = Limits()) -> str:
    """Base counts, and for each n the share of word characters in n-grams that were there before."""
    grams = []
    for n in (3, *limits.ngrams):
        grams.append(f"""
g{n} AS (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, gram) AS times, row_number() OVER (PARTITION BY doc_id, gram ORDER BY k) AS nth
  FROM (SELECT doc_id, k, array_to_string(w[k:k + {n - 1}], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - {n - 2})) AS k FROM d WHERE len(w) >= {n}))),
c{n} AS (SELECT doc_id, count(*) AS words, sum(length(w[k])) AS chars FROM (SELECT DISTINCT doc_id, unnest(range(k, k + {n})) AS k FROM g{n} WHERE {'times > 1' if n == 3 else 'nth > 1'}) JOIN d USING (doc_id) GROUP BY doc_id)""")
    share = {n: f"coalesce(c{n}.chars, 0)::DOUBLE / greatest(b.word_chars, 1)" for n in limits.ngrams}
    limit = lambda short, most: f"CASE WHEN b.n_words < {limits.short} THEN {short}::DOUBLE ELSE {most}::DOUBLE END"
    good = " AND ".join([f"coalesce(l.chars, 0) <= {limit(limits.short_lines, limits.lines)} * b.word_chars", *(f"{share[n]} <= {limit(limits.short_ngrams[n], most)}" for n, most in limits.ngrams.items())])
    joins = " ".join(f"LEFT JOIN c{n} USING (doc_id)" for n in (3, *limits.ngrams))
    failed = f"(b.n_words < {limits.min_words} OR 100 * coalesce(c3.words, 0) > {limits.max_repeat_words} * b.n_words)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
b AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols FROM d),
lines AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line) AS nth FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
l AS (SELECT doc_id, count(*) AS n, sum(length(regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g'))) AS chars FROM lines WHERE nth > 1 GROUP BY doc_id),
{",".join(grams).strip()}
SELECT b.doc_id, b.n_words, b.word_chars, b.n_symbols::BIGINT AS n_symbols, coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(c3.words, 0)::BIGINT AS n_repeat_words,
  {failed} AS base_failed, {good} AND NOT {failed} AS kept, greatest({", ".join(share.values())}) AS repeat_share, coalesce(l.chars, 0)::DOUBLE / greatest(b.word_chars, 1) AS line_repeat_share
FROM b LEFT JOIN l USING (doc_id) {joins}
"""


def chat_digests() -> str:
    """Digests of turns, and the length of what the template writes: marks, and a character more for each escape."""
    def quoted(s: str) -> str:
        return "".join("\\" + c if c in "[]\\/<>" and c not in "/<>" else c for c in s)

    control = "|".join([r"\\", *map(quoted, chat_format.CONTROL)])
    escapes = lambda x: f"length(regexp_replace({x}, '({control})', '\\1+', 'g'))"
    marks = "CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 WHEN 'system' THEN 15 ELSE 21 + " + escapes("role") + " END"
    return f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({marks} + {escapes("text")})::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""


def mixing() -> str:
    """Rounds of resharing what is over, until no target is above its stop; then copies by rate and draw."""
    weights = f"[{', '.join(map(str, source_mix.WEIGHTS))}]"
    n, most = len(source_mix.WEIGHTS), source_mix.MOST
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, source, text, len({_WORDS.format(text="coalesce(text, '')")})::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, {weights}[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {n})::INT + 1]::BIGINT AS w FROM d GROUP BY source),
r(round, source, source_size, w, stopped) AS (
  SELECT 0, source, source_size, w, false FROM s
  UNION ALL
  SELECT round + 1, source, source_size, w, stopped OR fresh FROM (
    SELECT *, bool_or(fresh) OVER () AS more FROM (
      SELECT *, NOT stopped AND w::HUGEINT * left_ > {most} * source_size::HUGEINT * open_ AS fresh FROM (
        SELECT *, sum(source_size) OVER () - coalesce(sum({most} * source_size) FILTER (stopped) OVER (), 0) AS left_, sum(w) FILTER (NOT stopped) OVER () AS open_ FROM r))) WHERE more),
last AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum({most} * source_size) FILTER (stopped) OVER (), 0) AS left_, sum(w) FILTER (NOT stopped) OVER () AS open_
  FROM r WHERE round = (SELECT max(round) FROM r)),
t AS (SELECT source, source_size, CASE WHEN stopped THEN ({most} * source_size)::DOUBLE ELSE (w * left_)::DOUBLE / open_::DOUBLE END AS target FROM last),
c AS (
  SELECT d.*, t.source_size, t.target, coalesce(t.target / nullif(t.source_size::DOUBLE, 0), 0) AS rate,
    ('0x' || substr(md5('{source_mix.SEED} ' || coalesce(doc_id::VARCHAR, 'text ' || md5(coalesce(text, '')))), 1, 13))::BIGINT / {float(1 << 52)!r} AS draw
  FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, size, source_size, target, size * copies AS taken, source, rate, copies
FROM (SELECT *, (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies FROM c)
"""


CONVERSATION_TRIE = """
WITH RECURSIVE crc_step(i, c, k) AS (
  SELECT i, i::BIGINT, 0 FROM range(256) AS x(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc_step WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM crc_step WHERE k = 8),
own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base,
    xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda c, b: xor(c >> 8, t[((xor(c, b)) & 255) + 1])), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM own), crc_table),
rebuilt AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth, sha256(length(role) || ':' || role || text) AS digest, strlen(text) AS bytes
  FROM (SELECT c.conv_id, 0 AS part, pos, role, text FROM convs c JOIN own o ON o.conv_id = c.base AND o.pos < c.h
    UNION ALL SELECT c.conv_id, 1, pos, role, text FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.pos >= c.h)),
reached AS (
  SELECT conv_id, depth, string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY depth) AS key, bytes FROM rebuilt
  UNION ALL SELECT conv_id, 0, '', 0 FROM convs),
last AS (SELECT conv_id, max(depth) AS n FROM reached GROUP BY conv_id),
nodes AS (
  SELECT depth, key, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = n), '')) AS ends_sha256
  FROM reached JOIN last USING (conv_id) GROUP BY depth, key),
children AS (SELECT left(key, 64 * (depth - 1)) AS key, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
subtrees AS (
  SELECT left(key, 64 * k) AS key, count(*) FILTER (n_children IS NULL) AS n_leaves, sum((n_convs - 1) * bytes)::BIGINT AS saved_tokens
  FROM (SELECT *, unnest(range(depth + 1)) AS k FROM nodes LEFT JOIN children USING (key)) GROUP BY ALL)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM nodes n JOIN subtrees s USING (key) LEFT JOIN children c USING (key) LEFT JOIN nodes p ON n.depth > 0 AND p.key = left(n.key, 64 * (n.depth - 1))
"""


FILTER_AUDIT = f"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, {_WORDS.format(text="text")} AS w, min(doc_id) OVER (PARTITION BY text) AS first FROM t),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(w) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN first < doc_id THEN 'E' ELSE '' END AS failed
  FROM w LEFT JOIN l USING (doc_id)),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o(filter_order) AS (SELECT '' UNION ALL SELECT filter_order || f FROM o, f WHERE NOT contains(filter_order, f)),
s AS (SELECT filter_order, step, filter_order[step] AS f, left(filter_order, step - 1) AS before FROM o, range(1, 6) AS x(step) WHERE length(filter_order) = 5),
c AS (SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM d GROUP BY part, failed),
r AS (
  SELECT part, filter_order, step, f, n, good, toxic, failed = f AS alone, contains(failed, f) AS fails,
    length(translate(failed, before, '')) < length(failed) AS earlier
  FROM c, s),
steps AS (
  SELECT part, filter_order, step::INT AS step, f, coalesce(sum(n) FILTER (NOT fails AND NOT earlier), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (fails AND NOT earlier), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (fails AND earlier), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (alone), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (fails AND NOT earlier), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (fails AND NOT earlier), 0)::BIGINT AS toxic_lost
  FROM r GROUP BY ALL)
SELECT * EXCLUDE (f), (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM steps
"""


ORACLE_SQL = {
    "op3_jaccard_join": JACCARD_JOIN,
    "op6_substring_dedup": SUBSTRING_DEDUP,
    "op9_quality_rules": quality_rules(),
    "op10_chat_format": chat_digests(),
    "op11_source_mix": mixing(),
    "op12_filter_audit": FILTER_AUDIT,
    "op13_conversation_trie": CONVERSATION_TRIE,
}
