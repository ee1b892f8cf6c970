"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from lograft.llm.queries import SHARDS, SLOTS

_NUMBER = "CAST('0x' || substr(md5({0}), 1, 15) AS BIGINT)"

# Shards take turns; each step claims one slot in a list of owners.
OP2 = f"""
WITH RECURSIVE shard AS (
  SELECT i, printf('shard-%02d', i) AS name FROM range({len(SHARDS)}) t(i)
), preference AS (
  SELECT i, name,
         list_transform(range({SLOTS}), lambda j: (p + j * s) % {SLOTS}) AS slots
  FROM (SELECT i, name,
               {_NUMBER.format("'offset|' || name")} % {SLOTS} AS p,
               {_NUMBER.format("'skip|' || name")} % ({SLOTS} - 1) + 1 AS s
        FROM shard)
), fill(turn, owners) AS (
  SELECT 0::BIGINT, list_transform(range({SLOTS}), lambda j: -1::BIGINT)
  UNION ALL
  SELECT turn + 1, owners[:slot] || [i] || owners[slot + 2:]
  FROM (SELECT turn, owners, i,
               list_filter(slots, lambda q: owners[q + 1] = -1)[1] AS slot
        FROM fill JOIN preference ON i = turn % {len(SHARDS)} WHERE turn < {SLOTS})
), full_table AS (SELECT owners FROM fill ORDER BY turn DESC LIMIT 1),
lookup AS (
  SELECT unnest(range({SLOTS})) AS slot, unnest(owners) AS i FROM full_table
), keyed AS (
  SELECT doc_id, source,
         {_NUMBER.format("coalesce(CAST(doc_id AS VARCHAR), '')")} % {SLOTS} AS slot
  FROM documents
)
SELECT doc_id, source, slot, name AS shard FROM keyed JOIN lookup USING (slot) JOIN shard USING (i)
"""

_SPACE = r"[ \t\n\v\f\r]"
_NO_SPACE = r"[^ \t\n\v\f\r]"

# Targets by repeated resharing: those over their stop are fixed at it, until none is.
OP6 = rf"""
WITH RECURSIVE doc AS (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '{_NO_SPACE}+')), 0) AS BIGINT) AS size,
         1.0::DOUBLE / (1.0::DOUBLE + 20.0::DOUBLE
           * (length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>!]+', '', 'g')))
           / (length(coalesce(text, '')) + 1)) AS quality,
         (CAST('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), md5(text), '')), 1, 13) AS BIGINT)::DOUBLE + 0.5)
           / 4503599627370496.0::DOUBLE AS u
  FROM documents
), src AS (
  SELECT source, source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w,
         3 * source_size AS stop
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM doc GROUP BY source)
), share(round, source, source_size, w, stop, fixed, grew) AS (
  SELECT 0, source, source_size, w, stop, false, true FROM src
  UNION ALL
  SELECT round + 1, source, source_size, w, stop, now_fixed, bool_or(now_fixed <> fixed) OVER ()
  FROM (SELECT *, fixed OR stop * left_w <= w * left_size AS now_fixed
        FROM (SELECT *,
                     sum(source_size) OVER () - sum(CASE WHEN fixed THEN stop ELSE 0 END) OVER () AS left_size,
                     sum(CASE WHEN fixed THEN 0 ELSE w END) OVER () AS left_w
              FROM share WHERE grew))
), last AS (SELECT * FROM share WHERE round = (SELECT max(round) FROM share)),
target AS (
  SELECT source, source_size,
         CASE WHEN fixed THEN CAST(stop AS DOUBLE)
              ELSE CAST(w * (sum(source_size) OVER () - sum(CASE WHEN fixed THEN stop ELSE 0 END) OVER ()) AS DOUBLE)
                   / CAST(sum(CASE WHEN fixed THEN 0 ELSE w END) OVER () AS DOUBLE) END AS target
  FROM last
), planned AS (
  SELECT source, source_size, target,
         CASE WHEN source_size > 0 THEN least(CAST(floor(target / source_size) AS BIGINT), 3) ELSE 0 END AS epochs
  FROM target
), ordered AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.epochs,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY -ln(d.u) / d.quality, d.doc_id, d.size
                           ROWS UNBOUNDED PRECEDING) - d.size / 2 AS middle
  FROM doc d JOIN planned p ON d.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target,
       CAST(size * CASE WHEN source_size > 0
            THEN least(epochs + CASE WHEN middle <= target - epochs * source_size THEN 1 ELSE 0 END, 3)
            ELSE 0 END AS BIGINT) AS taken
FROM ordered
"""

OP9 = rf"""
WITH doc AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), word AS (
  SELECT doc_id, t, regexp_extract_all(t, '{_NO_SPACE}+') AS words,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_NO_SPACE}')) AS lines
  FROM doc
), gram AS (
  SELECT doc_id, unnest(range(len(words) - 2)) AS pos,
         unnest(list_transform(range(len(words) - 2),
                lambda i: words[i + 1] || ' ' || words[i + 2] || ' ' || words[i + 3])) AS gram
  FROM word WHERE len(words) >= 3
), often AS (
  SELECT doc_id, pos FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM gram) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT place) AS n_repeat_words
  FROM (SELECT doc_id, unnest([pos, pos + 1, pos + 2]) AS place FROM often) GROUP BY doc_id
), base AS (
  SELECT doc_id, t,
         CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '{_SPACE}+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM word LEFT JOIN covered USING (doc_id)
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed
            OR 10 * n_symbols > n_words
            OR word_chars < 2 * n_words OR word_chars > 15 * n_words
            OR 10 * n_dup_lines > 3 * len(string_split(t, chr(10)))
            OR 2 * (length(t) - length(regexp_replace(t, '[A-Z]+', '', 'g'))) > word_chars
            OR 5 * (length(t) - length(regexp_replace(t, '!+', '', 'g'))) > n_words) AS kept
FROM judged
"""

# CRC-32 of the strings in a table asked(word), byte by byte with the usual table of 256 remainders.
_CRC = """remainder AS (
  SELECT list(c ORDER BY b) AS steps
  FROM (SELECT b, list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) AS c
        FROM range(256) t(b))
), coded AS (
  SELECT word,
         xor(list_reduce(list_transform(range(length(digits) // 2),
                                        lambda i: CAST('0x' || substr(digits, 2 * i + 1, 2) AS BIGINT)),
                         lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS crc
  FROM (SELECT DISTINCT word, hex(encode(word)) AS digits FROM asked), remainder
)"""

OP11 = f"""
WITH doc AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), following AS (
  SELECT doc_id, t, length(t) AS n,
         coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS next_t
  FROM doc
), pair AS (
  SELECT doc_id, t, n, next_t, substr(t, 1, n - n // 4) || substr(next_t, 1, n // 4) AS edited FROM following
), body AS (
  SELECT row_number() OVER () AS id, t, length(t) AS n
  FROM (SELECT DISTINCT t FROM (SELECT t FROM pair UNION ALL SELECT edited FROM pair))
), part AS (
  SELECT id, i AS pos, c[i] || c[i + 1] || c[i + 2] || c[i + 3] || c[i + 4] AS word
  FROM (SELECT id, c, unnest(range(1, n - 3)) AS i FROM (SELECT id, n, string_split(t, '') AS c FROM body WHERE n >= 20))
), asked AS (
  SELECT DISTINCT word FROM part UNION SELECT t FROM body WHERE n BETWEEN 1 AND 19
), {_CRC}, hashed AS (
  SELECT id, pos, crc,
         lead(crc, 15) OVER w AS last_crc,
         min(crc) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING) AS least_crc,
         (crc + 31 * lead(crc, 5) OVER w + 961 * lead(crc, 10) OVER w + 29791 * lead(crc, 15) OVER w) % 1048573 AS hash
  FROM part JOIN coded USING (word)
  WINDOW w AS (PARTITION BY id ORDER BY pos)
), anchor AS (
  SELECT id, pos, hash * 16 + least(coalesce(lead(pos) OVER (PARTITION BY id ORDER BY pos) - pos, 0), 15) AS token
  FROM hashed WHERE last_crc IS NOT NULL AND (crc = least_crc OR last_crc = least_crc)
), token AS (
  SELECT id, pos, token FROM anchor
  UNION ALL SELECT id, 1, crc % 1048573 * 16 FROM body JOIN coded ON t = word WHERE n BETWEEN 1 AND 19
), print AS (
  SELECT id, to_base64(unhex(string_agg(printf('%06X', token), '' ORDER BY pos))) AS print, list(DISTINCT token) AS tokens
  FROM token GROUP BY id
), printed AS (
  SELECT t, coalesce(print, '') AS print, coalesce(tokens, []) AS tokens FROM body LEFT JOIN print USING (id)
)
SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256,
       own.print AS fingerprint, changed.print AS edited_fingerprint,
       CASE WHEN len(own.tokens) + len(changed.tokens) = 0 THEN 1.0::DOUBLE
            ELSE 2.0::DOUBLE * len(list_intersect(own.tokens, changed.tokens))
                 / (len(own.tokens) + len(changed.tokens)) END AS near_edited,
       CASE WHEN len(own.tokens) + len(after.tokens) = 0 THEN 1.0::DOUBLE
            ELSE 2.0::DOUBLE * len(list_intersect(own.tokens, after.tokens))
                 / (len(own.tokens) + len(after.tokens)) END AS near_next
FROM pair JOIN printed own ON own.t = pair.t
     JOIN printed changed ON changed.t = pair.edited
     JOIN printed after ON after.t = pair.next_t
"""

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# Replaced letters: equal when one place is blanked; inserted and deleted ones: equal when one letter is left out.
OP12 = rf"""
WITH RECURSIVE run AS (
  SELECT doc_id, run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all({_LOWER.format("text")}, '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents)
  GROUP BY ALL
), keyed AS (
  SELECT run, n, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS word FROM run
), asked AS (SELECT DISTINCT word FROM keyed), {_CRC}, changed AS (
  SELECT n, CASE WHEN crc % 199 = 0
                 THEN substr(run, 1, crc % length(run)) || substr(run, crc % length(run) + 2) ELSE run END AS word
  FROM keyed JOIN coded USING (word)
), known AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM changed WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), short AS (
  SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest
  FROM (SELECT word, unnest(range(length(word))) AS i FROM known)
), near AS (
  SELECT a.word, b.word AS other FROM short a JOIN short b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.rest FROM short a JOIN known b ON a.rest = b.word
  UNION SELECT a.rest, a.word FROM short a JOIN known b ON a.rest = b.word
), best AS (
  SELECT near.word, count(*) AS n_near, arg_min(other, (-o.n, other)) AS other, max(o.n) AS other_n
  FROM near JOIN known o ON o.word = near.other GROUP BY near.word
), formed AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near,
         CASE WHEN other_n >= 5 * n THEN other END AS form, CASE WHEN other_n >= 5 * n THEN other_n END AS form_n
  FROM known LEFT JOIN best USING (word)
), chain(word, root) AS (
  SELECT word, word FROM formed
  UNION ALL
  SELECT chain.word, form FROM chain JOIN formed ON formed.word = chain.root WHERE form IS NOT NULL
)
SELECT word, form, chain.root, n, n_near, form_n
FROM formed JOIN chain USING (word)
WHERE chain.root NOT IN (SELECT word FROM formed WHERE form IS NOT NULL)
"""

_FEATURES = rf"""unnest(regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'))"""

OP13 = f"""
WITH feature AS (
  SELECT doc_id, {_FEATURES} AS word FROM documents
), wanted AS (
  SELECT {_FEATURES} AS word FROM benchmark
), asked AS (SELECT word FROM feature UNION SELECT word FROM wanted), {_CRC}, bucketed AS (
  SELECT word, crc % 10000 AS bucket FROM coded
), corpus AS (
  SELECT bucket, count(*) AS s FROM feature JOIN bucketed USING (word) GROUP BY bucket
), target AS (
  SELECT bucket, count(*) AS t FROM wanted JOIN bucketed USING (word) GROUP BY bucket
), gain AS (
  SELECT bucket,
         CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM corpus) + 10000)::DOUBLE
                              / ((s + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM target) + 10000)::DOUBLE))) AS BIGINT) AS gain
  FROM corpus LEFT JOIN target USING (bucket)
), weighed AS (
  SELECT doc_id, count(*) AS n_features, CAST(floor(sum(gain)::DOUBLE / count(*)) AS BIGINT) AS weight
  FROM feature JOIN bucketed USING (word) JOIN gain USING (bucket) GROUP BY doc_id
), scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(
           (CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE)
           / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM documents LEFT JOIN weighed USING (doc_id)
), ordered AS (
  SELECT *, n_features >= 20 AS eligible,
         row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
         count(*) OVER (PARTITION BY n_features >= 20) AS eligible_n
  FROM scored
)
SELECT doc_id, n_features, weight, score,
       CASE WHEN eligible AND place <= 10 * eligible_n // 100 THEN place END AS rank
FROM ordered
"""

ORACLES = {
    "op2_sharding": OP2,
    "op6_mix_sources": OP6,
    "op9_quality_rules": OP9,
    "op11_fingerprints": OP11,
    "op12_spelling_variants": OP12,
    "op13_target_resampling": OP13,
}
