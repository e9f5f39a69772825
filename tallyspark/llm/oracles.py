"""DuckDB SQL of those training-data queries that SQL can express, on the whole tables."""

from __future__ import annotations

from tallyspark.llm.secrets import RULES as SECRET_RULES
from tallyspark.llm.url_filter import RULES as URL_RULES

_SPACE = r"\x20\x09-\x0D"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

QUALITY = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
  w AS (SELECT doc_id, text, regexp_extract_all(text, '[^{_SPACE}]+') AS words, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^{_SPACE}]')) AS lines FROM d),
  c AS (SELECT doc_id, text, words, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    length(regexp_replace(text, '[^!]', '', 'g')) AS bangs, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS capitals, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS letters FROM w),
  windows AS (SELECT doc_id, i, array_to_string(words[i : i + 4], ' ') AS s FROM (SELECT doc_id, words, unnest(range(1, n_words - 3)) AS i FROM c WHERE n_words >= 5)),
  twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM windows) WHERE n > 1),
  repeated AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM twice, range(5) r(k) GROUP BY doc_id),
  tops AS (SELECT doc_id, max(n) AS top FROM (SELECT doc_id, s, count(*) AS n FROM (SELECT doc_id, unnest(words) AS s FROM c) GROUP BY doc_id, s) GROUP BY doc_id),
  judged AS (SELECT c.*, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(top, 0) AS top FROM c LEFT JOIN repeated USING (doc_id) LEFT JOIN tops USING (doc_id))
  SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
    n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR n_symbols > 0.08::DOUBLE * word_chars OR 10 * n_dup_lines > 4 * n_lines OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 2 * bangs > n_words
      OR 10 * capitals > 7 * greatest(letters, 1) OR (n_words >= 20 AND top::DOUBLE / n_words > 0.4::DOUBLE)) AS kept FROM judged"""


def _secrets() -> str:
    """Matches by kind with their places: what lies between the matches, and the matches before, add up."""
    parts = []
    for number, rule in enumerate(SECRET_RULES):
        pattern = rule.pattern.replace("'", "''")
        parts.append(
            f"""SELECT doc_id, {number} AS number, '{rule.kind}' AS kind, {rule.least} AS least, regexp_extract_all(text, '{pattern}') AS found, regexp_extract_all(text, '{pattern}', {rule.group}) AS inner_, string_split_regex(text, '{pattern}') AS pieces FROM d"""
        )
    base = "kind IN ('assign', 'access', 'hex')"
    return (
        "WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), each_ AS ("
        + " UNION ALL ".join(parts)
        + f"""), rows_ AS (SELECT doc_id, number, kind, least, unnest(range(1, len(found) + 1)) AS k, found, inner_, pieces FROM each_ WHERE len(found) > 0),
  placed AS (SELECT doc_id, number, kind, k, length(found[k]) AS n, length(inner_[k]) AS held, least, sum(length(pieces[k])) OVER w + coalesce(sum(length(found[k])) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
    FROM rows_ WINDOW w AS (PARTITION BY doc_id, number ORDER BY k)),
  spans AS (SELECT doc_id, number, kind, CAST(start AS BIGINT) AS start, kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + n AS BIGINT) AS span FROM placed WHERE held >= least),
  sums AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, string_agg(span, ',' ORDER BY start, number) FILTER ({base}) AS base, string_agg(span, ',' ORDER BY start, number) AS spans FROM spans GROUP BY doc_id)
  SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN sums USING (doc_id)"""
    )


JACCARD = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^{_SPACE}]+') AS words FROM documents),
  s AS (SELECT DISTINCT doc_id, array_to_string(words[i : i + 2], ' ') AS gram FROM (SELECT doc_id, words, unnest(range(1, greatest(2, len(words) - 1))) AS i FROM w WHERE len(words) > 0)),
  n AS (SELECT doc_id, count(*) AS n_shingles FROM s GROUP BY doc_id),
  both_ AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2),
  links AS (SELECT x, y FROM both_ JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n_shingles + b.n_shingles - c)),
  reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
  components AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x),
  degrees AS (SELECT x AS doc_id, count(*) AS n_links FROM links GROUP BY x)
  SELECT d.doc_id, coalesce(n_shingles, 0) AS n_shingles, component_id, coalesce(n_links, 0) AS n_links FROM documents d LEFT JOIN n USING (doc_id) JOIN components USING (doc_id) LEFT JOIN degrees USING (doc_id)"""


def _urls() -> str:
    """The rules, and 64 rounds of both ranks over the host links."""
    fits = "CASE " + " ".join(
        f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}') THEN '{verdict} {host}{path}'" for verdict, host, path in sorted(URL_RULES, key=lambda r: -len(r[1] + r[2]))
    ) + " END"

    def ranks(name: str, verdict: str, source: str, target: str) -> str:
        return f"""{name}_seeds AS (SELECT host, share_{verdict} AS rank FROM shares WHERE share_{verdict} > 0),
  {name}_links AS (SELECT {source} AS a, {target} AS b, count(*) OVER (PARTITION BY src) AS degree FROM edges),
  {name} AS (SELECT 0 AS i, host, rank FROM {name}_seeds UNION ALL SELECT any_value(i) + 1, host, sum(rank) FROM (SELECT t.i, l.b AS host, 0.85::DOUBLE * t.rank / l.degree AS rank FROM {name} t JOIN {name}_links l ON l.a = t.host WHERE t.i < 64
    UNION ALL SELECT i, s.host, s.rank FROM {name}_seeds s, (SELECT max(i) AS i FROM {name} WHERE i < 64) WHERE i IS NOT NULL) GROUP BY host)"""

    return (
        rf"""WITH RECURSIVE p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path, coalesce(html, '') AS html FROM pages),
  m AS (SELECT *, {fits} AS fit FROM p), shares AS (SELECT host, avg(CAST(coalesce(starts_with(fit, 'allow '), FALSE) AS INTEGER)) AS share_allow, avg(CAST(coalesce(starts_with(fit, 'block '), FALSE) AS INTEGER)) AS share_block FROM m WHERE host <> '' GROUP BY host),
  edges AS (SELECT DISTINCT src, dst FROM (SELECT host AS src, translate(unnest(regexp_extract_all(html, '(?i)href\s*=\s*["'']?(?:https?:)?//([^/?#"''\s>]+)', 1)), '{_UPPER}', '{_LOWER}') AS dst FROM p WHERE host <> '') WHERE src <> dst),
  """
        + ranks("trust", "allow", "src", "dst")
        + ", "
        + ranks("distrust", "block", "dst", "src")
        + """, t AS (SELECT host, arg_max(rank, i) AS trust FROM trust GROUP BY host), b AS (SELECT host, arg_max(rank, i) AS distrust FROM distrust GROUP BY host)
  SELECT page_id, host, path, substr(fit, 7) AS rule, CASE WHEN fit IS NOT NULL THEN substr(fit, 1, 5) WHEN coalesce(distrust, 0) > 0.5 AND coalesce(distrust, 0) > coalesce(trust, 0) THEN 'block' ELSE 'allow' END AS verdict FROM m LEFT JOIN t USING (host) LEFT JOIN b USING (host)"""
    )


ORACLES = {"op3_quality_rules": QUALITY, "op4_secrets": _secrets(), "op9_jaccard_join": JACCARD, "op10_url_filter": _urls()}


#: CRC-32 (unsigned) of an ASCII text, byte by byte through the table of its polynomial.
_CRC_TABLE = "list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"


def crc32_sql(text: str) -> str:
    """DuckDB SQL over a relation with `crc_table`."""
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT)), lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1])), 4294967295)"


def _encoded(value: str) -> str:
    return f"coalesce(octet_length(encode({value}::VARCHAR)) || ':' || {value}, '-')"


def _tree(name: str, leaves: str) -> str:
    """Nodes (tree, level, pos, digest, n) of `leaves` (tree, pos, digest, n): two nodes of a level make one of the next."""
    return f"""{name} AS (SELECT tree, 0 AS level, pos, digest, n FROM {leaves} UNION ALL
      SELECT tree, level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (n + 1) // 2 FROM {name} WHERE n > 1 GROUP BY tree, level, pos // 2, n)"""


def _path(leaves: str, tree: str) -> str:
    """(tree, pos, path) of `leaves`: L or R and the sibling on each level, an empty text where a node is alone."""
    return f"""(SELECT l.tree, l.pos, coalesce(list(coalesce(CASE WHEN (l.pos >> k.level) & 1 = 1 THEN 'L' ELSE 'R' END || s.digest, '') ORDER BY k.level) FILTER (k.level IS NOT NULL), []) AS path FROM {leaves} l
      LEFT JOIN (SELECT DISTINCT tree, level FROM {tree} WHERE n > 1) k ON k.tree IS NOT DISTINCT FROM l.tree
      LEFT JOIN {tree} s ON s.tree IS NOT DISTINCT FROM l.tree AND s.level = k.level AND s.pos = xor(l.pos >> k.level, 1) GROUP BY l.tree, l.pos)"""


ORACLES["op13_merkle_manifest"] = f"""WITH RECURSIVE crc AS (SELECT {_CRC_TABLE} AS crc_table),
  rows_ AS (SELECT doc_id, lang AS tree, sha256({_encoded('doc_id')} || {_encoded('source')} || {_encoded('lang')} || {_encoded('n_chars')} || {_encoded('text')}) AS digest,
    CASE WHEN {crc32_sql('doc_id::VARCHAR')} % 7 = 0 THEN sha256({_encoded('doc_id')} || {_encoded('source')} || {_encoded('lang')} || {_encoded('(n_chars + 1)')} || {_encoded('text')}) END AS tampered FROM documents, crc),
  leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM rows_),
  {_tree('nodes', 'leaves')},
  tops AS (SELECT '' AS tree, tree AS lang, digest, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
  {_tree('top_nodes', 'tops')},
  proved AS (SELECT l.doc_id, l.digest AS leaf, coalesce(l.tampered, l.digest) AS start, t.digest AS subroot, r.digest AS root, list_concat(p.path, q.path) AS path FROM leaves l
    JOIN {_path('leaves', 'nodes')} p ON p.tree IS NOT DISTINCT FROM l.tree AND p.pos = l.pos
    JOIN tops t ON t.lang IS NOT DISTINCT FROM l.tree JOIN {_path('tops', 'top_nodes')} q ON q.pos = t.pos CROSS JOIN (SELECT digest FROM top_nodes WHERE n = 1) r),
  folded AS (SELECT *, list_reduce(list_prepend(start, path), lambda d, s: CASE WHEN s = '' THEN sha256(d) WHEN s[1] = 'L' THEN sha256(s[2:] || d) ELSE sha256(d || s[2:]) END) AS folded_root FROM proved)
  SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda s: s[2:]), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded"""

#: Inserts are left out: whatever has one is cheaper with its neighbour deleted (2 and, for an opening left alone, 2 more, against 5).
ORACLES["op11_conversation_repair"] = f"""WITH RECURSIVE crc AS (SELECT {_CRC_TABLE} AS crc_table),
  given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS harm FROM conversations, crc),
  damaged AS (SELECT conv_id, turn, CASE harm WHEN 4 THEN 'user' ELSE role END AS role, CASE harm WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM given, range(2) c(copy) WHERE harm <> 0 AND (harm = 3 OR copy = 0)),
  placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS seen FROM damaged),
  judged AS (SELECT *, seen = '' AS blank, seen <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, right(seen, 1) NOT IN ('.', '!', '?') AS short,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS two FROM placed),
  faults AS (SELECT *, short AND NOT blank AND NOT again AS cut_short FROM judged),
  counted AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again) AS duplicate, count(*) FILTER (cut_short) AS truncated, count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM faults GROUP BY conv_id),
  walked AS (SELECT conv_id, 0::BIGINT AS i, '' AS state, '000000000' AS best, '' AS said FROM counted UNION ALL
    SELECT conv_id, i, state, min(best), arg_min(said, best) FROM (SELECT w.conv_id, w.i + 1 AS i,
        CASE letter WHEN 'D' THEN w.state WHEN 'K' THEN left(r.role, 1) WHEN 'R' THEN CASE w.state WHEN 'u' THEN 'a' ELSE 'u' END END AS state,
        lpad((w.best[:9]::INTEGER + CASE letter WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END + CASE WHEN letter <> 'D' AND r.cut_short THEN 5 ELSE 0 END)::VARCHAR, 9, '0') || w.best[10:] || letter AS best,
        CASE letter WHEN 'D' THEN w.said ELSE w.said || CASE w.state WHEN '' THEN '' ELSE chr(10) END || CASE WHEN letter = 'K' THEN r.role WHEN w.state = 'u' THEN 'assistant' ELSE 'user' END || ':' || r.text END AS said
      FROM walked w JOIN faults r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1, (VALUES ('D'), ('K'), ('R')) e(letter)
      WHERE letter = 'D' OR (NOT r.blank AND NOT r.again AND (letter = 'R' OR left(r.role, 1) = CASE w.state WHEN 'u' THEN 'a' ELSE 'u' END OR (left(r.role, 1) = 's' AND w.state = '')))) GROUP BY conv_id, i, state),
  ends AS (SELECT w.conv_id, min(best) AS best, arg_min(said, best) AS said FROM walked w JOIN counted c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND w.i = c.n WHERE state IN ('', 'a') GROUP BY w.conv_id),
  every AS (SELECT DISTINCT conv_id FROM conversations)
  SELECT v.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(e.best[:9]::BIGINT, 0) AS cost, coalesce(e.best[10:], '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
  FROM every v LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM v.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM v.conv_id"""
