"""DuckDB SQL of the operators whose results SQL can express."""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS payload_digest, html FROM p),
k AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS keep FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> keep THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> keep THEN keep END AS refers_to
FROM k
"""

EXACT_DEDUP = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT doc_id, norm, count(*) OVER (PARTITION BY norm) AS group_size,
             first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""

LINE_DEDUP = r"""
WITH t AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS said,
                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line FROM documents),
s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS seq FROM t
      WHERE regexp_matches(said, '[^\x20\x09-\x0D]')),
w AS (SELECT doc_id, seq, said, lead(said) OVER (PARTITION BY doc_id ORDER BY seq) AS following FROM s),
k AS (SELECT doc_id, seq, row_number() OVER (PARTITION BY said, following ORDER BY doc_id, seq) AS nth
      FROM w WHERE following IS NOT NULL),
c AS (SELECT DISTINCT doc_id, seq + i AS seq FROM k, (VALUES (0), (1)) AS o(i) WHERE nth > 1),
m AS (SELECT t.doc_id, t.line, t.said, s.seq, c.seq AS gone,
             c.seq IS NOT NULL AND p.seq IS NULL AS starts
      FROM t LEFT JOIN s USING (doc_id, line) LEFT JOIN c ON c.doc_id = s.doc_id AND c.seq = s.seq
      LEFT JOIN c AS p ON p.doc_id = s.doc_id AND p.seq = s.seq - 1)
SELECT doc_id, count(seq) AS n_lines, count(gone) AS n_removed,
       CAST(count(*) FILTER (WHERE starts) AS BIGINT) AS n_runs,
       sha256(coalesce(string_agg(said, chr(10) ORDER BY line) FILTER (WHERE gone IS NULL), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


def _crc32(text: str) -> str:
    """The unsigned CRC-32 of a non-empty ASCII ``text`` expression, a bit at a time."""
    return f"""xor(4294967295, list_reduce(
        list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)),
        lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda v, z: xor(v >> 1, (v % 2) * 3988292384))))"""


PREFIX_TRIE = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS said FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({{'role': role, 'said': said}} ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || said)) AS turns
        FROM t GROUP BY conv_id),
h AS (SELECT conv_id, turns, conv_id - conv_id % 5 AS head, {_crc32("CAST(conv_id AS VARCHAR)")} % 9 AS h FROM own),
full_turns AS (SELECT c.conv_id, list_concat(coalesce(b.turns[:c.h], []), c.turns[c.h + 1:]) AS turns
               FROM h AS c LEFT JOIN own AS b ON b.conv_id = c.head),
steps AS (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS depth FROM full_turns),
members AS (SELECT conv_id, depth, turns[:depth] AS prefix, len(turns) = depth AS ends FROM steps),
nodes AS (SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
                 coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '') AS ended
          FROM members GROUP BY prefix, depth),
kin AS (SELECT n.*, p.conv_id AS parent_conv_id,
               CASE WHEN n.depth = 0 THEN 0 ELSE (n.n_convs - 1) * octet_length(encode(n.prefix[-1].said)) END AS saved
        FROM nodes AS n LEFT JOIN nodes AS p ON p.depth = n.depth - 1 AND p.prefix = n.prefix[:n.depth - 1]),
children AS (SELECT depth - 1 AS depth, parent_conv_id AS conv_id, count(*) AS n FROM kin WHERE depth > 0 GROUP BY 1, 2),
counted AS (SELECT k.*, coalesce(c.n, 0) AS n_children FROM kin AS k LEFT JOIN children AS c USING (conv_id, depth)),
below AS (SELECT a.conv_id, a.depth, count(*) FILTER (WHERE b.n_children = 0) AS n_leaves, sum(b.saved) AS saved_tokens
          FROM counted AS b JOIN counted AS a ON a.depth <= b.depth AND a.prefix = b.prefix[:a.depth] GROUP BY 1, 2)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens,
       sha256(ended) AS ends_sha256
FROM counted JOIN below USING (conv_id, depth)
"""

#: The cheapest edits row by row: of all edit strings that reach a place in the
#: pattern (0 nothing, 1 system, 2 user, 3 assistant) the least (cost, audit) is kept.
CONVERSATION_REPAIR = f"""
WITH RECURSIVE
c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS said,
             {_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind FROM conversations),
ids AS (SELECT conv_id, row_number() OVER () AS conv FROM (SELECT DISTINCT conv_id FROM c)),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                   CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(said, '.!?', '') ELSE said END AS said,
                   unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
            FROM c WHERE kind <> 0),
placed AS (SELECT conv, turn, role, said,
                  row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || said), copy) AS pos
           FROM damaged JOIN ids ON damaged.conv_id IS NOT DISTINCT FROM ids.conv_id),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv, role, said ORDER BY pos) AS nth, left(role, 1) AS initial,
                lag(left(role, 1)) OVER (PARTITION BY conv ORDER BY pos) AS last_initial,
                right(rtrim(said, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS end_char
         FROM placed),
marked AS (SELECT *, CASE WHEN end_char = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate'
                          WHEN end_char NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM seen),
facts AS (SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                 count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
                 count(*) FILTER (WHERE fault = 'truncated') AS truncated,
                 count(*) FILTER (WHERE last_initial || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
          FROM marked GROUP BY conv),
put_in(place, letters, reached, paid) AS (VALUES (0, '', 0, 0), (0, 'I', 2, 5), (0, 'II', 3, 10), (1, '', 1, 0), (1, 'I', 2, 5), (1, 'II', 3, 10),
    (2, '', 2, 0), (2, 'I', 3, 5), (2, 'II', 2, 10), (3, '', 3, 0), (3, 'I', 2, 5), (3, 'II', 3, 10)),
edit(place, letter, initial, reached, paid) AS (VALUES (0, 'D', '', 0, 2), (1, 'D', '', 1, 2), (2, 'D', '', 2, 2), (3, 'D', '', 3, 2),
    (0, 'K', 's', 1, 0), (0, 'K', 'u', 2, 0), (1, 'K', 'u', 2, 0), (3, 'K', 'u', 2, 0), (2, 'K', 'a', 3, 0),
    (0, 'R', '', 2, 1), (1, 'R', '', 2, 1), (3, 'R', '', 2, 1), (2, 'R', '', 3, 1)),
moves AS (SELECT p.place, p.letters || e.letter AS letters, e.letter, e.initial, e.reached, p.paid + e.paid AS paid
          FROM put_in AS p JOIN edit AS e ON e.place = p.reached),
best(conv, pos, place, cost, audit) AS (
    SELECT conv, CAST(0 AS BIGINT), 0, 0, '' FROM facts
  UNION ALL
    SELECT conv, pos, place, cost, audit FROM (
        SELECT b.conv, b.pos + 1 AS pos, m.reached AS place,
               b.cost + m.paid + CASE WHEN r.fault = 'truncated' AND m.letter <> 'D' THEN 5 ELSE 0 END AS cost, b.audit || m.letters AS audit,
               row_number() OVER (PARTITION BY b.conv, m.reached
                   ORDER BY b.cost + m.paid + CASE WHEN r.fault = 'truncated' AND m.letter <> 'D' THEN 5 ELSE 0 END, b.audit || m.letters) AS nth
        FROM best AS b JOIN marked AS r ON r.conv = b.conv AND r.pos = b.pos + 1
        JOIN moves AS m ON m.place = b.place AND (m.letter = 'D' OR r.fault NOT IN ('blank', 'duplicate'))
                       AND (m.letter <> 'K' OR m.initial = r.initial)) WHERE nth = 1),
ended AS (SELECT b.conv, b.cost + p.paid AS cost, b.audit || p.letters AS audit,
                 row_number() OVER (PARTITION BY b.conv ORDER BY b.cost + p.paid, b.audit || p.letters) AS nth
          FROM best AS b JOIN facts AS f ON f.conv = b.conv AND f.n = b.pos
          JOIN put_in AS p ON p.place = b.place AND p.reached IN (0, 3)),
letters AS (SELECT conv, unnest(string_split(audit, '')) AS letter, generate_subscripts(string_split(audit, ''), 1) AS nth
            FROM ended WHERE nth = 1),
stepped AS (SELECT *, count(*) FILTER (WHERE letter <> 'I') OVER (PARTITION BY conv ORDER BY nth) AS pos FROM letters),
lines AS (SELECT s.conv, s.nth, s.letter, m.role, m.said, m.initial, row_number() OVER (PARTITION BY s.conv ORDER BY s.nth) AS line
          FROM stepped AS s LEFT JOIN marked AS m ON m.conv = s.conv AND m.pos = s.pos AND s.letter <> 'I' WHERE s.letter <> 'D'),
system AS (SELECT conv, count(*) AS n FROM lines WHERE line = 1 AND letter = 'K' AND initial = 's' GROUP BY conv),
written AS (SELECT l.conv, string_agg(CASE WHEN letter = 'K' THEN role WHEN (line - coalesce(y.n, 0)) % 2 = 1 THEN 'user' ELSE 'assistant' END
                                      || ':' || coalesce(said, ''), chr(10) ORDER BY line) AS whole
            FROM lines AS l LEFT JOIN system AS y ON y.conv = l.conv GROUP BY l.conv)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM ids LEFT JOIN facts USING (conv) LEFT JOIN (SELECT * FROM ended WHERE nth = 1) USING (conv) LEFT JOIN written USING (conv)
"""
