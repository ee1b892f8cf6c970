"""The expected results as SQL over the given tables, written apart from the operators."""

from __future__ import annotations

from lograft.constants import HINT_HEAD, HINT_TAIL, NO_SPACE_HEAD, NO_SPACE_TAIL, NUMBERED_LINE
from lograft.functions.text import JS_WHITESPACE
from lograft.plans.bindings import CHUNK_SIZE, GIST_LIMIT, HOT_DOC, PACKAGE

NL = "chr(10)"
WHITE = "||".join(f"chr({ord(c)})" for c in JS_WHITESPACE)


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def trim(x: str) -> str:
    return f"trim({x}, {WHITE})"


def path_of(d: str) -> str:
    return f"""(CASE {d} % 8
        WHEN 0 THEN '/var/log/app' || ({d} % 5) || '/' || {d} || '.log'
        WHEN 1 THEN './logs/' || {d} || '.log'
        WHEN 2 THEN 'C:\\logs\\' || {d} || '.log'
        WHEN 3 THEN '///srv//' || {d} || '.log.txt'
        WHEN 4 THEN 'var/log/' || {d} || '.txt'
        WHEN 5 THEN '/var/tmp/' || {d}
        WHEN 6 THEN '/a/b/' || ({d} // 8) || '.log'
        ELSE '/a-b/' || ({d} // 8) || '.log' END)"""


def normalized(p: str) -> str:
    return f"replace(replace(ltrim({p}, '/\\'), '/', '-'), '\\', '-')"


def uploaded(p: str) -> str:
    n = normalized(p)
    return f"""(CASE WHEN ends_with({n}, '.log.txt') THEN {n}
        WHEN ends_with({n}, '.log') THEN {n} || '.txt' ELSE {n} || '.log.txt' END)"""


def folder(p: str) -> str:
    n = normalized(p)
    return f"('log-' || CASE WHEN ends_with({n}, '.log') THEN left({n}, length({n}) - 4) ELSE {n} END)"


def readable(s: str) -> str:
    steps = [("KB", 1), ("MB", 2), ("GB", 3), ("TB", 4)]
    out = f"CASE WHEN {s} < 1024 THEN {s} || ' B'"
    for unit, power in steps:
        step = 1024**power
        h = f"(({s} * 100 + {step // 2}) // {step})"
        top = f"WHEN {s} < {step * 1024} THEN" if power < 4 else "ELSE"
        out += f" {top} ({h} // 100) || '.' || lpad(({h} % 100)::VARCHAR, 2, '0') || ' {unit}'"
    return f"({out} END)"


def dirs(present: str, name: str) -> str:
    """Folders of the archive: of those that are present, what their listings hold."""
    return f"""SELECT doc_id, CASE WHEN doc_id % 20 = 0 THEN 'private-logs' ELSE 'public-logs' END AS repository_name,
        {name} AS folder, CASE WHEN doc_id % 50 = 0 THEN 'trunk' ELSE 'main' END AS branch,
        {present} AS present, {present} AND doc_id % 110 = 30 AS broken,
        CASE WHEN doc_id % 110 = 30 OR doc_id % 40 = 0 THEN 0 WHEN doc_id % 30 = 0 THEN 2 ELSE 1 END AS n,
        'https://raw.example.org/' || {name} || CASE WHEN doc_id % 20 = 0 THEN '?token=abc' ELSE '' END AS download_url
        FROM documents"""


# Each entry may use those before it.
TABLES = {
    "files": f"SELECT doc_id, {path_of('doc_id')} AS path, strlen(text)::BIGINT AS size_bytes, text FROM documents",
    "asked": f"""SELECT event_id AS n, ts AS requested_at,
        CASE WHEN event_id % 3 < 2 THEN 'nation_0' ELSE 'nation_' || (user_id % 30) END AS owner,
        CASE WHEN event_id % 97 = 96 THEN '/missing/' || event_id || '.log'
             WHEN event_id % 101 = 100 THEN CASE WHEN event_id % 2 = 0 THEN '' END
             ELSE {path_of('target')} END AS path
        FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN {HOT_DOC}
              ELSE event_id % (SELECT count(*) FROM documents) END AS target FROM events)""",
    "opts": """SELECT n AS request_id, requested_at, owner, path,
        coalesce(CASE n % 5 WHEN 0 THEN true WHEN 1 THEN false END, CASE WHEN n % 17 = 3 THEN true END) AS pub,
        coalesce(CASE n % 7 WHEN 0 THEN true WHEN 1 THEN false END, CASE WHEN n % 19 = 7 THEN false END) AS priv,
        CASE n % 11 WHEN 0 THEN true WHEN 1 THEN false END AS only_gist,
        CASE WHEN n % 6 = 0 THEN true END AS only_repository,
        n % 13 <> 0 AS auto0, n % 9 = 0 AS "verbose",
        n % 8 = 3 OR n % 23 = 5 AS dry_mode,
        CASE WHEN n % 4 = 1 THEN false ELSE true END AS shared_repository,
        CASE WHEN n % 10 = 4 THEN 'note ' || n WHEN n % 10 = 5 THEN 'from file' ELSE '' END AS description,
        n % 53 = 52 AS unknown, n % 61 = 60 AS self_test
        FROM asked""",
    "resolved": """SELECT *, coalesce(pub, false) OR coalesce(NOT priv, false) AS is_public,
        auto0 AND NOT coalesce(only_gist, false) AND NOT coalesce(only_repository, false) AS auto
        FROM opts""",
    "checked": """SELECT r.*, f.size_bytes,
        pub IS NOT NULL AND priv IS NOT NULL AS bad_visibility,
        only_gist IS NOT NULL AND only_repository IS NOT NULL AS bad_only,
        NOT self_test AND NOT auto0 AND NOT coalesce(only_gist, false)
            AND NOT coalesce(only_repository, false) AS bad_auto,
        NOT self_test AND coalesce(r.path, '') = '' AS no_path,
        NOT self_test AND coalesce(r.path, '') <> '' AND f.path IS NULL AS no_file
        FROM resolved r LEFT JOIN files f ON f.path = r.path""",
    "plan0": f"""SELECT *, {folder('path')} AS folder, {uploaded('path')} AS uploaded,
        CASE WHEN coalesce(only_gist, false) THEN 'gist' WHEN coalesce(only_repository, false) THEN 'repo'
             WHEN size_bytes <= {GIST_LIMIT} THEN 'gist' ELSE 'repo' END AS type,
        CASE WHEN size_bytes > {GIST_LIMIT} THEN (size_bytes + {CHUNK_SIZE - 1}) // {CHUNK_SIZE} END AS num_chunks,
        size_bytes > {CHUNK_SIZE} AS needs_split
        FROM checked
        WHERE NOT (bad_visibility OR bad_only OR bad_auto OR no_path OR no_file OR unknown OR self_test)""",
    "plan": """SELECT *,
        CASE WHEN type = 'repo' THEN CASE WHEN NOT shared_repository THEN folder
             WHEN is_public THEN 'public-logs' ELSE 'private-logs' END END AS repository_name,
        CASE WHEN type = 'repo' AND shared_repository THEN folder END AS repository_path
        FROM plan0""",
    "dirs": dirs("(doc_id % 10 = 0 AND doc_id % 70 <> 10)", folder(path_of("doc_id"))),
    "all_dirs": dirs("(doc_id % 7 <> 3)", f"({folder(path_of('doc_id'))} || '-' || doc_id)"),
    "repos": """SELECT lower(n_name) AS owner,
        CASE WHEN n_nationkey % 2 = 0 THEN 'private-logs' ELSE 'public-logs' END AS name,
        CASE n_nationkey % 4 WHEN 1 THEN '' WHEN 2 THEN NULL ELSE 'trunk' END AS default_branch,
        CASE n_nationkey % 3 WHEN 0 THEN 'private' WHEN 1 THEN 'public' ELSE 'internal' END AS visibility
        FROM nation""",
    "targets": """SELECT DISTINCT p.owner, p.repository_name, is_public, r.visibility, r.default_branch,
        CASE WHEN r.visibility IS NULL THEN 'create'
             WHEN (r.visibility = 'public') = is_public AND r.visibility IN ('public', 'private') THEN 'reuse'
             ELSE 'error' END AS action
        FROM plan p LEFT JOIN repos r ON r.owner = p.owner AND r.name = p.repository_name
        WHERE type = 'repo' AND shared_repository AND NOT dry_mode""",
    "turns": """SELECT request_id, owner, repository_name, repository_path, path, size_bytes, needs_split, num_chunks,
        row_number() OVER w AS turn, first_value(CASE WHEN needs_split THEN coalesce(num_chunks, 1) ELSE 1 END) OVER w AS staged
        FROM plan WHERE type = 'repo' AND shared_repository AND NOT dry_mode
        WINDOW w AS (PARTITION BY owner, repository_name, repository_path ORDER BY requested_at, request_id)""",
    "dedup": """SELECT p.*, t.turn, t.staged, d.n AS listed, d.branch AS listed_branch, d.download_url AS listed_url,
        t.turn IS NOT NULL AND d.n IS NOT NULL AND NOT d.broken AS in_archive,
        t.turn IS NOT NULL AND coalesce(d.broken, false) AS broken,
        t.turn > 1 AND d.n IS NULL AS repeated
        FROM plan p LEFT JOIN turns t USING (request_id)
        LEFT JOIN dirs d ON d.present AND t.turn IS NOT NULL AND p.owner = 'nation_0'
            AND d.repository_name = p.repository_name AND d.folder = p.repository_path""",
    "taken": f"""SELECT 'nation_0' AS owner, {folder('path')} AS name FROM files WHERE doc_id % 6 = 0
        UNION ALL SELECT owner, {folder('path')} || '-' || (epoch_us(requested_at) // 1000) FROM asked
        WHERE n % 33 = 0 AND path IS NOT NULL""",
    "attempts": """SELECT event_id AS request_id, event_id * 2 + s AS attempt_id,
        CASE s WHEN 0 THEN 'gist' ELSE 'repo' END AS stage, (event_id + s * 4) % 9 AS v, event_id AS n, text AS body,
        coalesce(text || chr(10), '') AS head, coalesce(chr(10) || text, '') AS tail
        FROM events CROSS JOIN (VALUES (0), (1)) t(s) LEFT JOIN documents ON doc_id * 10 = event_id AND doc_id % 2 = s""",
    "printed": """SELECT *, CASE v WHEN 1 THEN 'ENOSPC: no space left on device, write'
            WHEN 2 THEN 'Error: No space left on device' END AS message,
        CASE v WHEN 0 THEN CASE stage WHEN 'gist' THEN body END WHEN 1 THEN body WHEN 2 THEN body WHEN 8 THEN ''
            ELSE head || CASE v WHEN 3 THEN 'fatal: No Space Left on device'
                WHEN 4 THEN 'GraphQL: Name already exists on this account (createRepository)'
                WHEN 5 THEN 'gh: Not Found (HTTP 404)' WHEN 6 THEN '  secondary rate limit' || chr(10)
                WHEN 7 THEN 'fatal: couldn''t find remote ref main' END || tail END AS stderr,
        CASE v WHEN 0 THEN CASE stage
                WHEN 'gist' THEN 'https://gist.github.com/user' || (n % 40) || '/' || (n % 500) || chr(10)
                ELSE head || 'created' || chr(13) || chr(10) || '  https://github.com/nation_0/repo-' || (n % 500) || ' '
                    || chr(13) || chr(10) || 'https://github.com/x/y/z' || chr(10) || tail END
            WHEN 7 THEN 'https://gist.github.com/' WHEN 8 THEN head || ' build failed ' || chr(9) || tail END AS stdout,
        CASE v WHEN 2 THEN 1 WHEN 3 THEN 128 WHEN 4 THEN 1 WHEN 5 THEN 1 WHEN 6 THEN 1 WHEN 8 THEN 3
            WHEN 7 THEN CASE stage WHEN 'repo' THEN 128 ELSE 0 END ELSE 0 END AS exit
        FROM attempts""",
    "scanned": f"""SELECT *, lower(coalesce(stderr, '')) AS loud, {trim('stdout')} AS out,
        lower(coalesce(nullif(stderr, ''), stdout, '')) AS output, string_split(replace(stdout, chr(13) || chr(10), chr(10)), chr(10)) AS lines
        FROM printed""",
    "tries": f"""SELECT *,
        v IN (1, 2) OR contains(coalesce(stderr, ''), 'ENOSPC') OR contains(loud, 'no space left on device') AS no_space,
        contains(loud, 'already exists') AS name_conflict,
        contains(output, 'not found') OR contains(output, 'http 404') AS not_found,
        contains(output, 'couldn''t find remote ref') OR contains(output, 'could not find remote branch') AS missing_ref,
        CASE WHEN exit <> 0 THEN coalesce(nullif({trim('stderr')}, ''), nullif(out, ''), 'Command exited with code ' || exit) END AS detail,
        list_filter(list_transform(lines, lambda l: {trim('l')}),
            lambda l: regexp_full_match(l, 'https://github\\.com/[^/\\s]+/[^/\\s]+'))[1] AS repository_url,
        CASE WHEN starts_with(out, 'https://gist.github.com/') AND out <> 'https://gist.github.com/' THEN out END AS gist_url
        FROM scanned""",
    "records": f"""SELECT doc_id, source AS batch, 'cs-' || doc_id || '.md' AS file,
        1700000000 + (doc_id * 7919) % 997 AS mtime, doc_id % 13 AS v,
        CASE doc_id % 3 WHEN 0 THEN 'patch' WHEN 1 THEN 'minor' ELSE 'major' END AS kind,
        text AS line FROM documents""",
    "raw_text": f"""SELECT *, CASE v WHEN 0 THEN NULL WHEN 3 THEN ''
        WHEN 4 THEN {trim(f"line || {NL} || '---' || {NL} || 'more'")}
        ELSE {trim('line')} END AS body FROM records""",
    # A first line with a marker of its own would count as one more section.
    "parsed": f"""SELECT batch, file, mtime, v, kind, CASE WHEN v = 0 THEN NULL ELSE kind END AS bump,
        CASE WHEN v = 0 THEN NULL
             WHEN v = 2 THEN CASE WHEN position('---' IN line) > 0
                THEN {trim("substr(line, position('---' IN line) + 3)")} ELSE '' END
             ELSE body END AS description FROM raw_text""",
    "notes": """SELECT doc_id AS release_id, doc_id % 11 AS v, text, text AS line,
        left(md5(doc_id::VARCHAR), 7) AS sha, CASE WHEN doc_id % 5 <> 4 THEN left(md5((doc_id + 1)::VARCHAR), 7) END AS passed,
        '1.' || doc_id || '.0' AS version FROM documents""",
    "found": f"""SELECT *, CASE WHEN v IN (1, 2, 10) THEN NULL WHEN v = 3 THEN 'add' ELSE sha END AS commit,
        CASE v WHEN 1 THEN NULL
            WHEN 4 THEN 'first' || {NL} || 'second ' || repeat({NL}, 4) || line
            WHEN 5 THEN ltrim(rtrim(line || '''"', '''"'), '''"')
            WHEN 7 THEN line || {NL} || '---' || {NL} || 'tail'
            WHEN 8 THEN '  ' || line || '  ' || {NL} || {NL} || ' ' || {NL} || {NL} || '  end' || chr(9) || {NL}
            WHEN 9 THEN text
            WHEN 10 THEN line || {NL} || {NL} || '### Minor Changes' || {NL} || {NL} || '- other'
            ELSE line END AS raw FROM notes""",
    "cut": f"""SELECT *, split_part(split_part(ltrim(rtrim(replace(raw, '\\n', {NL}), '''"'), '''"'), '📦', 1), '---', 1) AS kept
        FROM found""",
    "links": f"""SELECT release_id, coalesce(commit, passed) AS commit_sha, pr.number AS pr_number FROM found
        LEFT JOIN (SELECT sha, arg_min(number, position) AS number FROM (
            SELECT left(md5((CASE WHEN o_orderkey % 4 = 0 THEN {HOT_DOC} ELSE o_orderkey % 5000 END)::VARCHAR), 7) AS sha,
                o_orderkey AS number, (o_orderkey * 7) % 1009 * 1000000 + o_orderkey AS position
            FROM orders WHERE o_orderkey % 3 <> 0) GROUP BY sha) pr ON pr.sha = coalesce(commit, passed)""",
    "logs": f"""SELECT doc_id, text AS one, text AS two,
        CASE doc_id % 8 WHEN 5 THEN 'title' WHEN 6 THEN 'bare' ELSE 'full' END AS shape,
        '## 1.' || doc_id || '.10' || {NL} || {NL} || '### Minor Changes' || {NL} || {NL} || '- ' || text
        || {NL} || {NL} || '## Unnumbered' || {NL} || {NL} || '## 1.' || doc_id || '.1' || {NL} || {NL}
        || '### Patch Changes' || {NL} || {NL} || '- ' || text || {NL} AS entry FROM documents""",
    "sections": f"""SELECT doc_id, 0 AS position, '1.' || doc_id || '.10' AS version,
        '### Minor Changes' || {NL} || {NL} || '- ' || one || {NL} || {NL} || '## Unnumbered' AS section
        FROM logs WHERE shape = 'full'
        UNION ALL SELECT doc_id, 1, '1.' || doc_id || '.1',
        {trim(f"'### Patch Changes' || {NL} || {NL} || '- ' || two")} FROM logs WHERE shape = 'full'""",
}


def with_tables(query: str) -> str:
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in TABLES.items()) + "\n" + query


def no_space(operation: str) -> str:
    return quoted(NO_SPACE_HEAD + operation + NO_SPACE_TAIL)


TREE = "'https://github.com/' || owner || '/' || repository_name || '/tree/' || {} || '/' || repository_path"
TEMPLATE = NUMBERED_LINE.rstrip("\n")
CORPUS = f"""SELECT source, unnest(range(1, n::BIGINT + 1)) AS line_no FROM (
    SELECT source, (sum(strlen(text)) + {len(NUMBERED_LINE) - 1}) // {len(NUMBERED_LINE)} AS n FROM documents GROUP BY source)"""
CORPUS_LINE = f"replace({quoted(TEMPLATE)}, '%LINE%', line_no::VARCHAR)"
CHUNKS = f"""SELECT path, size_bytes, text, size_bytes > {CHUNK_SIZE} AS split,
    unnest(range(0, CASE WHEN size_bytes > {CHUNK_SIZE} THEN (size_bytes + {CHUNK_SIZE - 1}) // {CHUNK_SIZE} ELSE 1 END)) AS no
    FROM {{}}"""
CHUNK_NAME = f"""CASE WHEN split THEN replace({uploaded('path')} || '<', '.log.txt<', '') || '.part-'
    || lpad(no::VARCHAR, 2, '0') || '.log.txt' ELSE {uploaded('path')} END"""
CHUNK_OFFSET = f"no * {CHUNK_SIZE}"
CHUNK_LENGTH = f"CASE WHEN split THEN least({CHUNK_SIZE}, size_bytes - no * {CHUNK_SIZE}) ELSE size_bytes END"
CHUNK_BODY = f"""CASE WHEN split THEN encode(text)[no * {CHUNK_SIZE} + 1 : least((no + 1) * {CHUNK_SIZE}, size_bytes)]
    ELSE encode(text) END"""


def archived(first_rows: str) -> str:
    return f"""SELECT owner, repository_name AS repository, repository_path, {CHUNK_NAME} AS chunk_name,
        ({CHUNK_LENGTH})::BIGINT AS size_bytes, sha256({CHUNK_BODY}) AS sha
        FROM (SELECT u.*, c.split, c.no, c.text FROM ({first_rows}) u
              JOIN ({CHUNKS.format('files')}) c ON c.path = u.path)"""


MERGED = """SELECT batch, count(*) AS n_files, count(bump) AS n_parsed,
    count(*) FILTER (WHERE description <> '') AS n_descriptions,
    coalesce(sum(strlen(description)), 0)::BIGINT AS body_bytes,
    CASE WHEN count(*) < 2 THEN 'none' WHEN count(bump) = 0 THEN 'error' ELSE 'merged' END AS action,
    CASE WHEN bool_or(bump = 'major') THEN 'major' WHEN bool_or(bump = 'minor') THEN 'minor' ELSE 'patch' END AS bump
    FROM parsed GROUP BY batch"""


def named(taken: str) -> str:
    """Dedicated repositories and the names they end up with."""
    return f"""SELECT *, collided AND (retry_taken OR rn > 1) AS failed FROM (
        SELECT *, CASE WHEN collided THEN retry ELSE folder END AS final,
            EXISTS (SELECT 1 FROM {taken} t WHERE t.owner = c.owner AND t.name = c.retry) AS retry_taken,
            row_number() OVER (PARTITION BY owner, retry, collided ORDER BY requested_at, request_id) AS rn
        FROM (SELECT *, folder || '-' || (epoch_us(requested_at) // 1000) AS retry,
            EXISTS (SELECT 1 FROM {taken} t WHERE t.owner = p.owner AND t.name = p.folder)
            OR row_number() OVER (PARTITION BY owner, folder ORDER BY requested_at, request_id) > 1 AS collided
            FROM plan p WHERE type = 'repo' AND NOT shared_repository AND NOT dry_mode) c)"""


def dedicated(taken: str) -> str:
    return f"""SELECT owner, final, NULL, path, size_bytes FROM ({named(taken)}) WHERE NOT failed"""


STATE = f"""SELECT d.*, t.default_branch, t.visibility, t.action, m.final,
    CASE WHEN coalesce(t.default_branch, '') = '' THEN 'main' ELSE t.default_branch END AS checked_branch,
    d.broken OR (turn IS NOT NULL AND t.action = 'error') AS refused, g.gist_url, r.repository_url, g.no_space AS g_full, r.no_space AS r_full,
    g.gist_url IS NOT NULL AS g_ok, r.v = 0 AS r_ok,
    (in_archive OR coalesce(repeated, false)) AND coalesce(t.action, '') <> 'error' AS dup,
    coalesce(g.message, 'Failed to create gist: ' || coalesce({trim("nullif(g.stderr, '')")}, 'Unknown error')) AS g_error,
    coalesce(r.message, r.detail) AS r_error
    FROM dedup d JOIN tries g ON g.request_id = d.request_id AND g.stage = 'gist'
    JOIN tries r ON r.request_id = d.request_id AND r.stage = 'repo'
    LEFT JOIN targets t ON turn IS NOT NULL AND t.owner = d.owner AND t.repository_name = d.repository_name
    LEFT JOIN ({named('taken')}) m ON m.request_id = d.request_id"""
OUTCOME = f"""SELECT *, CASE WHEN dry_mode THEN 'dry' WHEN dup THEN 'dup' WHEN refused THEN 'refused'
    WHEN type = 'gist' AND g_ok THEN 'gist' WHEN type = 'gist' AND g_full THEN 'gist full'
    WHEN type = 'gist' AND coalesce(only_gist, false) THEN 'gist failed'
    WHEN r_ok THEN CASE type WHEN 'gist' THEN 'fallback' ELSE 'repo' END
    WHEN r_full THEN CASE WHEN type = 'gist' THEN 'fallback full'
        WHEN size_bytes <= {GIST_LIMIT} THEN 'repo full small' ELSE 'repo full' END
    ELSE 'repo failed' END AS what FROM ({STATE})"""

# CRC-32 of the strings in a table asked(body), byte by byte with the usual table of 256 remainders.
CRC = """remainder AS (
    SELECT list(c ORDER BY b) AS steps FROM (SELECT b, list_reduce(range(8),
        lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) AS c FROM range(256) t(b))
), crcs AS (
    SELECT body, xor(list_reduce(list_transform(range(length(digits) // 2),
        lambda i: CAST('0x' || substr(digits, 2 * i + 1, 2) AS BIGINT)),
        lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS crc
    FROM (SELECT DISTINCT body, hex(encode(body)) AS digits FROM asked), remainder
)"""

CAPTURED = """(SELECT doc_id, doc_id // 100 AS part, doc_id % 8 AS v, CASE doc_id % 8
    WHEN 0 THEN 'fatal: No Space Left on device ' || doc_id
    WHEN 2 THEN 'GraphQL: Name already exists on this account ' || doc_id
    WHEN 3 THEN 'gh: Not Found (HTTP 404) ' || doc_id
    WHEN 5 THEN 'fatal: couldn''t find remote ref b' || doc_id END AS failure,
    CASE doc_id % 8 WHEN 1 THEN 'https://github.com/nation_0/repo-' || (doc_id % 500)
        WHEN 6 THEN 'https://gist.github.com/user/' || (doc_id % 50) END AS url FROM documents)"""

_QUERIES = {
    "o01_scan_log_files": """SELECT doc_id // 100 AS part, sum(coalesce(strlen(text), 0) + 1)::BIGINT AS size_bytes
        FROM documents GROUP BY part""",
    "o01_missing_inputs": """SELECT n AS request_id, path, 'File does not exist: ' || path AS error
        FROM asked WHERE path <> '' AND path NOT IN (SELECT path FROM files)""",
    "o02_folder_listing": """SELECT repository_name, folder AS repository_path, present, broken AS malformed,
        CASE WHEN present AND n > 0 THEN folder || '.log.txt' END AS name,
        CASE WHEN present AND n > 0 THEN download_url END AS download_url FROM all_dirs
        UNION ALL SELECT repository_name, folder, present, false, '.keep', NULL FROM all_dirs WHERE present AND n = 2""",
    "o02_gist_listing": """SELECT doc_id AS gist_id, doc_id % 9 <> 1 AS present, doc_id % 9 = 2 AS malformed,
        CASE WHEN doc_id % 9 NOT IN (1, 2, 4) THEN 'f' || doc_id || '.log.txt' END AS filename,
        CASE WHEN doc_id % 9 NOT IN (1, 2, 4) THEN 'https://gist.example.org/' || doc_id || '/raw' END AS raw_url
        FROM documents
        UNION ALL SELECT doc_id, true, false, 'second.txt', 'x' FROM documents WHERE doc_id % 9 = 3""",
    "o02_repository_metadata": """SELECT c_custkey AS repository_id, c_custkey % 6 <> 0 AS present, false AS malformed,
        CASE WHEN c_custkey % 6 > 1 THEN 'b' || (c_custkey % 4) END AS default_branch,
        CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'private' ELSE 'public' END AS visibility FROM customer""",
    "o02_folder_answers": f"""SELECT * FROM (WITH shaped AS (SELECT doc_id, d.text, {folder('path')} AS folder, doc_id % 10 AS v,
            CASE WHEN doc_id % 10 IN (0, 1) THEN 'absent' WHEN doc_id % 10 IN (3, 4, 6, 8) THEN 'folder'
                WHEN doc_id % 10 = 7 THEN 'file' WHEN doc_id % 10 <> 2 OR d.text IS NULL THEN 'malformed'
                WHEN contains(lower(d.text), 'not found') OR contains(lower(d.text), 'http 404') THEN 'absent'
                ELSE 'failed' END AS shape
            FROM documents d JOIN files USING (doc_id)),
        listed AS (SELECT *, unnest(CASE v WHEN 6 THEN [0, 1] WHEN 7 THEN [0] WHEN 8 THEN [0, 1, 2] ELSE [NULL] END) AS no FROM shaped),
        entries AS (SELECT *, (v = 6 AND no = 1) OR (v = 8 AND no = 0) AS bad, v = 8 AND no = 2 AS hidden FROM listed)
        SELECT doc_id, shape, CASE WHEN shape = 'failed' THEN text END AS error, no::BIGINT AS entry_no,
            CASE WHEN no IS NOT NULL THEN bad END AS bad_entry,
            CASE WHEN no IS NULL OR bad THEN NULL WHEN hidden THEN '.keep' ELSE folder END AS name,
            CASE WHEN no IS NULL OR bad OR hidden THEN NULL ELSE text END AS download_url FROM entries)""",
    "o03_classify_strategy": f"""SELECT path, size_bytes, type, needs_split, num_chunks, chunk_size, readable_size,
        CASE WHEN type = 'gist' THEN 'File fits within GitHub Gist API limit (25MB)'
             WHEN needs_split THEN 'File exceeds Gist limit, will be split into ' || num_chunks || ' chunks'
             ELSE 'File exceeds Gist limit, will upload as repository' END AS reason
        FROM (SELECT path, size_bytes, CASE WHEN size_bytes <= {GIST_LIMIT} THEN 'gist' ELSE 'repo' END AS type,
            size_bytes > {CHUNK_SIZE} AS needs_split,
            CASE WHEN size_bytes > {GIST_LIMIT} THEN (size_bytes + {CHUNK_SIZE - 1}) // {CHUNK_SIZE} END AS num_chunks,
            CASE WHEN size_bytes > {GIST_LIMIT} THEN {CHUNK_SIZE}::BIGINT END AS chunk_size,
            {readable('size_bytes')} AS readable_size FROM files)""",
    "o04_assign_archive_names": f"""SELECT path, {normalized('path')} AS normalized, {uploaded('path')} AS uploaded_name,
        {uploaded('path')} AS gist_name, {folder('path')} AS repo_name,
        'Log file: ' || string_split(path, '/')[-1] AS default_description FROM files""",
    "o04_name_clashes": f"""SELECT {folder('path')} AS repo_name, count(DISTINCT path) AS n_paths,
        min(path) AS first_path, max(path) AS last_path FROM files GROUP BY 1 HAVING count(DISTINCT path) > 1""",
    "o04_clash_members": f"""SELECT repo_name, path, n_paths FROM (
        SELECT repo_name, path, count(*) OVER (PARTITION BY repo_name) AS n_paths
        FROM (SELECT DISTINCT {folder('path')} AS repo_name, path FROM files)) WHERE n_paths > 1""",
    "o05_resolve_requests": """SELECT request_id, path, is_public, auto, only_gist, only_repository, shared_repository,
        dry_mode, "verbose", self_test, description FROM resolved""",
    "o05_typed_options": """SELECT event_id AS request_id,
        CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE CASE WHEN event_id % 4 = 1 THEN true END END AS public,
        NULL::BOOLEAN AS private, CASE WHEN event_id % 6 < 2 THEN true END AS dry_mode,
        CASE WHEN event_id % 7 = 3 AND event_type IS NOT NULL THEN event_type WHEN event_id % 2 = 0 THEN 'note ' || event_id END AS description,
        concat_ws(',', CASE WHEN event_id % 13 = 12 THEN 'Public' END, CASE WHEN event_id % 11 = 10 THEN 'colour' END) AS unknown
        FROM events""",
    "o06_validate_requests": """SELECT request_id, 'public_private_conflict' AS rule FROM checked WHERE bad_visibility
        UNION ALL SELECT request_id, 'only_conflict' FROM checked WHERE bad_only
        UNION ALL SELECT request_id, 'no_auto_needs_target' FROM checked WHERE bad_auto
        UNION ALL SELECT request_id, 'path_required' FROM checked WHERE no_path
        UNION ALL SELECT request_id, 'file_missing' FROM checked WHERE no_file
        UNION ALL SELECT request_id, 'unknown_option' FROM checked WHERE unknown""",
    "o07_plan_uploads": """SELECT request_id, type,
        CASE WHEN type = 'gist' THEN '[DRY MODE] Would create gist'
             WHEN shared_repository THEN '[DRY MODE] Would upload to ' || repository_name || '/' || repository_path
             ELSE '[DRY MODE] Would create repository' END AS url,
        NULL::VARCHAR AS raw_url, CASE WHEN type = 'gist' THEN uploaded END AS file_name,
        repository_name, repository_path, 1::BIGINT AS file_count, is_public, dry_mode, false AS deduplicated FROM plan""",
    "o08_dedup_uploads": f"""SELECT request_id, owner, repository_name, repository_path,
        in_archive OR coalesce(repeated, false) AS deduplicated,
        CASE WHEN in_archive THEN 'archive' WHEN repeated THEN 'batch' END AS duplicate_of,
        (CASE WHEN in_archive THEN listed WHEN turn IS NOT NULL AND NOT broken THEN staged ELSE 1 END)::BIGINT AS file_count,
        CASE WHEN in_archive AND listed = 1 THEN listed_url END AS raw_url,
        CASE WHEN broken THEN 'error' END AS action,
        CASE WHEN broken THEN 'The listing of this folder cannot be parsed' END AS error,
        CASE WHEN broken THEN NULL WHEN turn IS NOT NULL THEN {TREE.format("coalesce(listed_branch, 'main')")}
             WHEN type = 'gist' THEN '[DRY MODE] Would create gist'
             WHEN shared_repository THEN '[DRY MODE] Would upload to ' || repository_name || '/' || repository_path
             ELSE '[DRY MODE] Would create repository' END AS url FROM dedup""",
    "o09_check_shared_repositories": """SELECT owner, repository_name, action,
        CASE WHEN action <> 'error' THEN CASE WHEN coalesce(default_branch, '') = '' THEN 'main' ELSE default_branch END END AS branch,
        CASE WHEN action = 'error' THEN 'Shared repository ' || repository_name || ' exists with visibility ' || visibility
            || ', expected ' || CASE WHEN is_public THEN 'public' ELSE 'private' END END AS error FROM targets""",
    "o10_bytechunks": f"""SELECT part, chunk_no, chunk_no * 65536 AS "offset", least(65536, size - chunk_no * 65536) AS length,
        sha256(substr(digits, chunk_no * 131072 + 1, 131072)) AS sha
        FROM (SELECT *, unnest(range((size + 65535) // 65536)) AS chunk_no
            FROM (SELECT part, hex(encode(body)) AS digits, strlen(body) AS size
                FROM (SELECT doc_id // 100 AS part, string_agg(coalesce(text, '') || {NL}, '' ORDER BY doc_id) AS body
                    FROM documents GROUP BY part)))""",
    "o27_stream_files": f"""SELECT part, chunk_no, least(65536, size - chunk_no * 65536) AS length,
        sha256(substr(digits, chunk_no * 131072 + 1, 131072)) AS sha
        FROM (SELECT *, unnest(range((size + 65535) // 65536)) AS chunk_no
            FROM (SELECT part, hex(encode(body)) AS digits, strlen(body) AS size
                FROM (SELECT doc_id // 100 AS part, string_agg(coalesce(text, '') || {NL}, '' ORDER BY doc_id) AS body
                    FROM documents GROUP BY part)))""",
    "o11_chunk_manifest": f"""SELECT path, size_bytes, no AS chunk_no,
        {CHUNK_OFFSET} AS "offset", {CHUNK_LENGTH} AS length, {CHUNK_NAME} AS chunk_name FROM ({CHUNKS.format('files')})""",
    "o11_chunk_overflow": f"""SELECT path, size_bytes, parts AS n_parts, size_bytes AS total_bytes,
        stem || repeat('0', digits) || '.log.txt' AS first_name,
        stem || (parts - 1) || '.log.txt' AS last_name
        FROM (SELECT *, greatest(2, length((parts - 1)::VARCHAR)) AS digits,
            replace({uploaded('path')} || '<', '.log.txt<', '') || '.part-' AS stem
            FROM (SELECT path, size_bytes, (size_bytes + 15) // 16 AS parts FROM files WHERE size_bytes > 1600))""",
    "o11_split_content": f"""SELECT path, {CHUNK_NAME} AS chunk_name, {CHUNK_OFFSET} AS "offset",
        {CHUNK_LENGTH} AS length, sha256({CHUNK_BODY}) AS sha FROM ({CHUNKS.format('files')})""",
    "o11_check_coverage": f"""SELECT path, CASE WHEN size_bytes > {CHUNK_SIZE} THEN (size_bytes + {CHUNK_SIZE - 1}) // {CHUNK_SIZE}
        ELSE 1 END AS n, size_bytes AS bytes, true AS whole, true AS same FROM files""",
    "o11_file_digests": f"""SELECT path, greatest(1, (size_bytes + 99) // 100) AS n, size_bytes AS bytes, true AS whole, crc
        FROM (WITH asked AS (SELECT text AS body FROM documents), {CRC} SELECT doc_id, crc FROM documents JOIN crcs ON text = body)
        JOIN files USING (doc_id)""",
    "o11_wrong_parts": f"""SELECT path, no AS chunk_no, CASE (no + size_bytes) % 5 WHEN 0 THEN 'lost' ELSE 'changed' END AS state
        FROM ({CHUNKS.format('files')}) WHERE (no + size_bytes) % 5 < 2""",
    "o12_write_archive": archived(
        f"""SELECT p.owner, p.repository_name, p.repository_path, p.path, p.size_bytes FROM dedup p
            JOIN targets USING (owner, repository_name)
            WHERE turn = 1 AND NOT in_archive AND NOT broken AND action <> 'error'
            UNION ALL {dedicated('taken')}"""
    ),
    "o13_generate_log_corpus": f"SELECT source, line_no, {CORPUS_LINE} AS line FROM ({CORPUS})",
    "o13_corpus_summary": f"""SELECT source, count(*) AS n_lines, sum(strlen({CORPUS_LINE}) + 1)::BIGINT AS bytes
        FROM ({CORPUS}) GROUP BY source""",
    "o13_corpus_files": f"""SELECT * FROM (WITH lines AS (SELECT source, line_no, {CORPUS_LINE} || chr(10) AS line FROM ({CORPUS})),
        parts AS (SELECT source, (line_no - 1) // 1000 AS part, min(line_no) AS first_line, max(line_no) AS last_line,
            sum(strlen(line))::BIGINT AS length, sha256(string_agg(line, '' ORDER BY line_no)) AS sha FROM lines GROUP BY ALL)
        SELECT source, part::BIGINT AS part, first_line, last_line, length, length AS size_bytes, sha,
            (sum(length) OVER (PARTITION BY source ORDER BY part) - length)::BIGINT AS "offset" FROM parts)""",
    "o14_resolve_name_collisions": f"""SELECT request_id, folder AS base_name, final AS final_name, collided, failed
        FROM ({named('taken')})""",
    "o15_link_commits_to_prs": "SELECT release_id, commit_sha, pr_number FROM links",
    "o16_strategy_summary": f"""SELECT type, is_public, level, n_files, total_bytes, n_split, n_chunks,
        {readable('total_bytes')} AS readable_total FROM (
        SELECT type, is_public, grouping(type, is_public)::BIGINT AS level, count(*) AS n_files,
            sum(size_bytes)::BIGINT AS total_bytes, count(*) FILTER (WHERE needs_split) AS n_split,
            coalesce(sum(num_chunks), 0)::BIGINT AS n_chunks FROM plan GROUP BY ROLLUP (type, is_public))""",
    "o17_folder_rollup": """SELECT 'nation_0' AS owner, repository_name, branch, folder AS repository_path,
        CASE repository_name WHEN 'public-logs' THEN 'public' ELSE 'private' END AS visibility,
        broken AS malformed, CASE WHEN NOT broken THEN n::BIGINT END AS file_count,
        CASE WHEN n = 1 THEN download_url END AS raw_url,
        'https://github.com/nation_0/' || repository_name || '/tree/' || branch || '/' || folder AS url,
        n = 1 AND NOT broken AND repository_name = 'private-logs' AS token_expires FROM all_dirs WHERE present""",
    "o17_folder_rollup_local": """SELECT repository_name, folder AS repository_path,
        CASE WHEN NOT broken THEN least(n, 1)::BIGINT END AS file_count,
        CASE WHEN n > 0 THEN download_url END AS raw_url FROM all_dirs WHERE present""",
    "o17_gist_rollup": """SELECT doc_id AS gist_id,
        (CASE doc_id % 9 WHEN 3 THEN 2 WHEN 4 THEN 0 ELSE 1 END)::BIGINT AS file_count,
        CASE WHEN doc_id % 9 NOT IN (1, 2, 3, 4) THEN 'https://gist.example.org/' || doc_id || '/raw' END AS raw_url
        FROM documents""",
    "o18_line_limit_report": f"""SELECT * FROM (SELECT doc_id // 100 AS part,
        sum(coalesce(strlen(text), 0) + 1)::BIGINT AS size_bytes,
        (sum(len(string_split(coalesce(text, ''), {NL}))) + 1)::BIGINT AS lines
        FROM documents GROUP BY part) WHERE lines > 900""",
    "o18_body_line_report": f"""SELECT doc_id, len(string_split(text, {NL}))::BIGINT AS lines FROM documents
        WHERE len(string_split(text, {NL})) > 40""",
    "o19_parse_changesets": "SELECT file, bump, description FROM parsed",
    "o19_merge_changesets": MERGED,
    "o19_merged_entries": f"""SELECT batch, 0::INTEGER AS piece, NULL::VARCHAR AS file,
            '---' || {NL} || '''{PACKAGE}'': ' || bump || {NL} || '---' || {NL} || {NL} AS text
        FROM ({MERGED}) WHERE action = 'merged'
        UNION ALL SELECT batch, 2, NULL, {NL} FROM ({MERGED}) WHERE action = 'merged'
        UNION ALL SELECT batch, 1, file,
            CASE WHEN row_number() OVER (PARTITION BY batch ORDER BY mtime, file) > 1 THEN {NL} || {NL} ELSE '' END || description
        FROM parsed JOIN (SELECT batch FROM ({MERGED}) WHERE action = 'merged') USING (batch) WHERE description <> ''""",
    "o19_manual_changeset": """SELECT doc_id, '---' || chr(10) || '''sample-pkg'': ' || bump || chr(10) || '---' || chr(10) || chr(10)
        || CASE WHEN coalesce(text, '') = '' OR doc_id % 5 = 0 THEN 'Manual ' || bump || ' release' ELSE text END || chr(10) AS content
        FROM (SELECT *, CASE doc_id % 3 WHEN 0 THEN 'patch' WHEN 1 THEN 'minor' ELSE 'major' END AS bump FROM documents)""",
    "o20_listed_changesets": """SELECT doc_id, CASE doc_id % 5 WHEN 1 THEN 'MY-README.md' ELSE 'cs-' || doc_id || '.md' END AS file
        FROM documents WHERE doc_id % 5 NOT IN (0, 2)""",
    "o20_changeset_gate": """SELECT p.doc_id AS pr_id, coalesce(n, 0)::BIGINT AS n_added,
        CASE WHEN coalesce(n, 0) = 0 THEN 'none' WHEN n > 1 THEN 'multiple' ELSE verdict END AS verdict,
        CASE WHEN n = 1 AND verdict = 'valid' THEN bump END AS bump
        FROM documents p LEFT JOIN (
            SELECT doc_id // 2 AS pr_id, count(*) AS n, min(doc_id) AS one FROM documents
            WHERE doc_id % 7 IN (0, 6) GROUP BY 1) a ON a.pr_id = p.doc_id
        LEFT JOIN (SELECT r.doc_id, p.bump, CASE WHEN r.v IN (0, 1) THEN 'missing_type'
            WHEN r.v = 2 AND position('---' IN line) = 0 THEN 'missing_description'
            WHEN description = '' THEN 'empty_description' ELSE 'valid' END AS verdict
            FROM records r JOIN parsed p ON p.file = r.file) j ON j.doc_id = a.one""",
    "o21_outcome_summary": """SELECT suite, coalesce(sum(ok), 0)::BIGINT AS passed, coalesce(sum(1 - ok), 0)::BIGINT AS failed,
        count(ok) AS total, coalesce(bool_and(ok = 1), true) AS all_passed FROM (
        SELECT CASE event_type WHEN 'error' THEN 'steady' ELSE event_type END AS suite,
            CASE WHEN event_type = 'error' OR (event_id % 41 <> 7 AND event_id % 7 <> 0) THEN 1 ELSE 0 END AS ok FROM events
        UNION ALL SELECT DISTINCT o_orderpriority, NULL FROM orders) GROUP BY suite""",
    "o22_classify_failures": """SELECT attempt_id, no_space, name_conflict, not_found, missing_ref,
        exit::BIGINT AS exit, detail FROM tries""",
    "o22_failure_counts": """SELECT stage, count(*) AS n_attempts, count(*) FILTER (WHERE exit <> 0 OR v = 1) AS n_failed,
        count(*) FILTER (WHERE no_space) AS n_no_space, count(*) FILTER (WHERE name_conflict) AS n_name_conflict,
        count(*) FILTER (WHERE not_found) AS n_not_found, count(*) FILTER (WHERE missing_ref) AS n_missing_ref
        FROM tries GROUP BY stage""",
    "o22_scan_failures": f"""SELECT part, bool_or(v = 0) AS no_space, bool_or(v = 2) AS name_conflict,
        bool_or(v = 3) AS not_found, bool_or(v = 5) AS missing_ref, count(failure) AS n_failures,
        arg_min(failure, doc_id) FILTER (WHERE failure IS NOT NULL) AS first_failure,
        arg_min(url, doc_id) FILTER (WHERE v = 1) AS repository_url FROM {CAPTURED} GROUP BY part""",
    "o23_resolve_outcomes": f"""SELECT request_id,
        CASE WHEN what IN ('dry', 'dup') THEN type WHEN what = 'gist' THEN 'gist'
             WHEN what IN ('repo', 'fallback') THEN 'repo' END AS type,
        CASE what WHEN 'dry' THEN 'would be created' WHEN 'dup' THEN 'already exists' WHEN 'gist' THEN 'created'
             WHEN 'repo' THEN 'created' WHEN 'fallback' THEN 'created' ELSE 'error' END AS status,
        what = 'fallback' AS fell_back,
        CASE WHEN what = 'gist' THEN gist_url
             WHEN what = 'dup' OR (what = 'repo' AND shared_repository) THEN {TREE.format('checked_branch')}
             WHEN what = 'dry' AND type = 'gist' THEN '[DRY MODE] Would create gist'
             WHEN what = 'dry' AND shared_repository THEN '[DRY MODE] Would upload to ' || repository_name || '/' || repository_path
             WHEN what = 'dry' THEN '[DRY MODE] Would create repository'
             WHEN what = 'fallback' AND shared_repository THEN 'https://github.com/' || owner || '/'
                || CASE WHEN is_public THEN 'public-logs' ELSE 'private-logs' END || '/tree/main/' || folder
             WHEN what IN ('repo', 'fallback') THEN repository_url END AS url,
        CASE WHEN what = 'dup' AND in_archive AND listed = 1 THEN listed_url END AS raw_url,
        CASE WHEN what = 'gist' OR (what = 'dry' AND type = 'gist') THEN uploaded END AS file_name,
        (CASE WHEN what = 'dup' AND in_archive THEN listed WHEN what = 'dup' THEN staged WHEN what IN ('gist', 'dry') THEN 1
             WHEN what IN ('repo', 'fallback')
             THEN CASE WHEN size_bytes > {CHUNK_SIZE} THEN (size_bytes + {CHUNK_SIZE - 1}) // {CHUNK_SIZE} ELSE 1 END
             END)::BIGINT AS file_count,
        is_public,
        CASE WHEN what IN ('dup', 'dry') THEN repository_name
             WHEN what IN ('repo', 'fallback') AND shared_repository
             THEN CASE WHEN is_public THEN 'public-logs' ELSE 'private-logs' END
             WHEN what IN ('repo', 'fallback') THEN coalesce(final, folder) END AS repository_name,
        CASE WHEN what IN ('dup', 'dry') THEN repository_path
             WHEN what IN ('repo', 'fallback') AND shared_repository THEN folder END AS repository_path,
        dup AS deduplicated,
        CASE what WHEN 'gist full' THEN 'gist upload' WHEN 'fallback full' THEN 'repository upload (requires temp disk space)'
             WHEN 'repo full' THEN 'repository upload' WHEN 'repo full small' THEN 'repository upload' END AS error_operation,
        CASE what WHEN 'gist full' THEN {no_space('gist upload')} WHEN 'gist failed' THEN g_error
             WHEN 'fallback full' THEN {no_space('repository upload (requires temp disk space)')}
             WHEN 'repo full' THEN {no_space('repository upload')}
             WHEN 'repo full small' THEN {no_space('repository upload')} || {quoted(HINT_HEAD)} || {readable('size_bytes')}
                || {quoted(HINT_TAIL)}
             WHEN 'refused' THEN CASE WHEN visibility IS NOT NULL AND action = 'error'
                THEN 'Shared repository ' || repository_name || ' exists with visibility ' || visibility
                    || ', expected ' || CASE WHEN is_public THEN 'public' ELSE 'private' END
                ELSE 'The listing of this folder cannot be parsed' END
             WHEN 'repo failed' THEN r_error END AS error FROM ({OUTCOME})""",
    "o24_extract_urls": """SELECT attempt_id, repository_url, gist_url, string_split(gist_url, '/')[-1] AS gist_id FROM tries""",
    "o24_url_targets": """SELECT kind, url, count(*) AS uses FROM (
        SELECT 'repo' AS kind, repository_url AS url FROM tries UNION ALL SELECT 'gist', gist_url FROM tries)
        WHERE url IS NOT NULL GROUP BY ALL""",
    "o24_scan_url_targets": f"""SELECT CASE v WHEN 1 THEN 'repo' ELSE 'gist' END AS kind, url, count(*) AS uses
        FROM {CAPTURED} WHERE url IS NOT NULL GROUP BY ALL""",
    "o25_explode_changelog": "SELECT doc_id, position::BIGINT AS position, version, section FROM sections",
    "o25_release_notes": """SELECT l.doc_id, w.version, coalesce(nullif(section, ''), 'Release ' || w.version) AS notes
        FROM logs l JOIN (SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN '9.' || doc_id ELSE '1.' || doc_id || '.1' END AS version
            FROM documents) w USING (doc_id) LEFT JOIN sections s ON s.doc_id = w.doc_id AND s.version = w.version""",
    "o25_release_notes_legacy": f"""SELECT l.doc_id, version, CASE WHEN shape = 'full' AND l.doc_id % 4 <> 3
        THEN {trim("regexp_replace('0' || " + NL + " || " + NL + " || '### Minor Changes' || " + NL + " || " + NL
                   + " || '- ' || one || " + NL + " || " + NL + " || '## Unnumbered', '(?s)## [0-9].*', '')")}
        ELSE 'Release ' || version END AS notes
        FROM logs l JOIN (SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN '9.' || doc_id ELSE '1.' || doc_id || '.1' END AS version
            FROM documents) w USING (doc_id)""",
    "o25_prepend_entries": f"""SELECT doc_id, CASE shape
        WHEN 'full' THEN '# log' || {NL} || {NL} || fresh || entry
        WHEN 'title' THEN '# log' || {NL} || {NL} || fresh || {NL} || {NL} || one
        ELSE fresh || {NL} || one END AS body FROM (SELECT *, '## 2.' || doc_id || {NL} || {NL} || '### '
            || CASE WHEN doc_id % 2 = 0 THEN 'Minor' ELSE 'Patch' END || ' Changes' || {NL} || {NL} || '- '
            || CASE WHEN doc_id % 3 <> 0 THEN 'by hand' WHEN doc_id % 2 = 0 THEN 'Manual minor release'
                ELSE 'Manual patch release' END || {NL} || {NL} AS fresh FROM logs)""",
    "o26_clean_release_notes": f"""SELECT release_id,
        CASE v WHEN 0 THEN 'already_formatted' WHEN 1 THEN 'no_changes' ELSE 'formatted' END AS status,
        CASE v WHEN 0 THEN '### Patch Changes' || {NL} || {NL} || '- ' || sha || ': ' || line || {NL}
                || '![x](https://img.shields.io/y)'
            WHEN 1 THEN 'Notes' || {NL} || {NL} || '- ' || line
            ELSE regexp_replace(array_to_string([{trim('l')} FOR l IN string_split({trim('kept')}, {NL})], {NL}),
                    chr(10) || '{{3,}}', {NL} || {NL}, 'g')
                || CASE WHEN pr_number <> 0 THEN {NL} || {NL} || '**Related Pull Request:** #' || pr_number ELSE '' END
                || {NL} || {NL} || '---' || {NL} || {NL} || '[![npm version](https://img.shields.io/badge/npm-' || version
                || '-blue.svg)](https://www.npmjs.com/package/{PACKAGE}/v/' || version || ')' END AS body
        FROM cut LEFT JOIN links USING (release_id)""",
    "o27_stream_archive": archived(
        f"""SELECT p.owner, p.repository_name, p.repository_path, p.path, p.size_bytes FROM turns p
            JOIN targets USING (owner, repository_name) WHERE turn = 1 AND action <> 'error'
            UNION ALL {dedicated('(SELECT * FROM taken WHERE false)')}"""
    ),
}

ORACLES = {name: with_tables(query) for name, query in _QUERIES.items()}
