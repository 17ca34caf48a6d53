"""DuckDB statements of the operators that SQL can express."""

from __future__ import annotations


def crc32(codes: str) -> str:
    """Unsigned CRC-32 (reversed polynomial 0xEDB88320) of a list of byte values."""
    bit = "lambda c, b: xor(c >> 1, 3988292384 * (c & 1))"
    byte = f"lambda c, v: list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], {bit}, xor(c, v))"
    return f"xor(4294967295::BIGINT, list_reduce(({codes})::BIGINT[], {byte}, 4294967295::BIGINT))"


def ascii_codes(text: str) -> str:
    return f"list_transform(string_split({text}, ''), lambda ch: ascii(ch))"


def _field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen({value}::VARCHAR) || ':' || {value}::VARCHAR END"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


def _tree(name: str, leaves: str) -> str:
    """All nodes (part, level, idx, hash, n) over leaves of that shape; n is the
    number of nodes of the level."""
    return f"""
{name} AS (
  SELECT part, 0 AS level, idx, hash, n FROM {leaves}
  UNION ALL
  SELECT part, level + 1, idx // 2, sha256(string_agg(hash, '' ORDER BY idx)), (any_value(n) + 1) // 2
  FROM {name} WHERE n > 1 GROUP BY part, level, idx // 2
)"""


def _path(leaves: str, tree: str) -> str:
    """Per leaf the list of (left, right) from the bottom up; both empty where a
    node is alone in its run."""
    return f"""
  SELECT l.part, l.idx, list({{'a': CASE WHEN s.idx < o.idx THEN s.hash ELSE '' END,
                             'b': CASE WHEN s.idx > o.idx THEN s.hash ELSE '' END}} ORDER BY o.level) AS path
  FROM {leaves} l
  JOIN {tree} o ON o.part IS NOT DISTINCT FROM l.part AND o.idx = (l.idx >> o.level) AND o.n > 1
  LEFT JOIN {tree} s ON s.part IS NOT DISTINCT FROM o.part AND s.level = o.level AND s.idx = xor(o.idx, 1)
  GROUP BY l.part, l.idx"""


MERKLE = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang AS part, {_leaf("n_chars")} AS hash,
         CASE WHEN n_chars IS NOT NULL AND doc_id IS NOT NULL AND {crc32(ascii_codes("doc_id::VARCHAR"))} % 7 = 0
              THEN {_leaf("(n_chars + 1)")} END AS tampered
  FROM documents
),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY part ORDER BY doc_id NULLS FIRST, hash) - 1 AS idx, count(*) OVER (PARTITION BY part) AS n FROM d
),{_tree("lower_tree", "leaves")},
subroots AS (
  SELECT 0 AS part, part AS lang, hash, row_number() OVER (ORDER BY part NULLS FIRST) - 1 AS idx, count(*) OVER () AS n
  FROM lower_tree WHERE n = 1
),{_tree("upper_tree", "subroots")},
lower_path AS ({_path("leaves", "lower_tree")}),
upper_path AS ({_path("subroots", "upper_tree")}),
told AS (
  SELECT l.doc_id, l.hash AS leaf, l.tampered, s.hash AS subroot, r.hash AS root,
         list_concat(coalesce(p.path, []), coalesce(u.path, [])) AS path
  FROM leaves l
  JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.part
  JOIN upper_tree r ON r.n = 1
  LEFT JOIN lower_path p ON p.part IS NOT DISTINCT FROM l.part AND p.idx = l.idx
  LEFT JOIN upper_path u ON u.idx = s.idx
),
folded AS (
  SELECT *, list_reduce(path, lambda acc, s: {{'a': '', 'b': sha256(s.a || acc.b || s.b)}}, {{'a': '', 'b': coalesce(tampered, leaf)}}).b AS folded_root
  FROM told
)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda s: s.a || s.b), '')) AS proof_sha256,
       folded_root, folded_root = root AS verified
FROM folded
"""


_CONTROL = r"<\\*(?:\||/?s>|/?SYS>>)|\[\\*/?INST\]"
_PIECE = "[A-Za-zÀ-ÿ]{1,6}|[0-9]{1,3}|[^\t-\r A-Za-zÀ-ÿ0-9]"

#: formatted_chars follows the windows: 1024 tokens, 192 of them for history, 256 at
#: least for new turns; 5 tokens and 24 characters (and the role) are a turn's marks.
CHAT = f"""
WITH every AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -7, * FROM (VALUES (0, 'user', '</s>[INST] ok [/INST]'), (1, 'assistant', '</s>[INST] ok [/INST]'))
),
counted AS (
  SELECT *, len(regexp_extract_all(text, '{_PIECE}')) + 5 AS n,
         24 + length(role) + length(text) + len(regexp_extract_all(text, '{_CONTROL}')) AS chars,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role) - 1 AS pos
  FROM every
),
summed AS (
  SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY pos) AS upto,
         coalesce(max(CASE WHEN pos = 0 AND role = 'system' THEN n END) OVER (PARTITION BY conv_id), 0) AS ahead,
         coalesce(max(CASE WHEN pos = 0 AND role = 'system' THEN chars END) OVER (PARTITION BY conv_id), 0) AS ahead_chars
  FROM counted
),
line AS (
  SELECT *, greatest(upto - n - ahead, 0) AS start, greatest(upto - ahead, 0) AS stop, greatest(1024 - 192 - ahead, 256) AS room FROM summed
),
stretched AS (
  SELECT *, start // room AS stretch, min(start) OVER (PARTITION BY conv_id, start // room) AS lowest FROM line
),
placed AS (
  SELECT *, stop - lowest > room AND start > lowest AS solo FROM stretched
),
windows AS (
  SELECT conv_id, stretch, solo, min(pos) AS first, min(start) AS origin, any_value(ahead_chars) AS ahead_chars
  FROM placed GROUP BY conv_id, stretch, solo
),
history AS (
  SELECT w.conv_id, sum(t.chars) AS chars
  FROM windows w JOIN placed t ON t.conv_id = w.conv_id AND t.pos < w.first AND t.start + 192 >= w.origin AND NOT (t.pos = 0 AND t.role = 'system')
  GROUP BY w.conv_id
),
repeated AS (
  SELECT conv_id, sum(CASE WHEN first > 0 THEN ahead_chars ELSE 0 END) AS chars FROM windows GROUP BY conv_id
),
told AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
         coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
         sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(chars) AS chars
  FROM placed GROUP BY conv_id
)
SELECT conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
       (told.chars + repeated.chars + coalesce(history.chars, 0))::BIGINT AS formatted_chars
FROM told JOIN repeated USING (conv_id) LEFT JOIN history USING (conv_id)
"""

# bytes of the UTF-8 form of letters up to U+00FF
_LETTER_BYTES = "flatten(list_transform(string_split({0}, ''), lambda ch: CASE WHEN unicode(ch) < 128 THEN [unicode(ch)] ELSE [192 + unicode(ch) // 64, 128 + unicode(ch) % 64] END))"

SPELLING = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run
  FROM documents
),
counted AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY doc_id, run),
hashed AS (SELECT run, n, {crc32(_LETTER_BYTES.format("doc_id::VARCHAR || ':' || run"))} AS h FROM counted),
slipped AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n
  FROM hashed
),
words AS (SELECT word, sum(n)::BIGINT AS n FROM slipped WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
places AS (SELECT word, unnest(generate_series(1, length(word))) AS i FROM words),
cuts AS (SELECT word, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM places),
near AS (
  SELECT x.word, y.word AS near FROM cuts x JOIN cuts y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT cuts.word, words.word FROM cuts JOIN words ON words.word = cuts.a || cuts.b
  UNION SELECT words.word, cuts.word FROM cuts JOIN words ON words.word = cuts.a || cuts.b
),
ranked AS (
  SELECT near.word, near.near, w.n AS near_n, count(*) OVER (PARTITION BY near.word) AS n_near,
         row_number() OVER (PARTITION BY near.word ORDER BY w.n DESC, near.near) AS rank
  FROM near JOIN words w ON w.word = near.near
),
formed AS (
  SELECT words.word, words.n, coalesce(r.n_near, 0) AS n_near,
         CASE WHEN r.near_n >= 2 * words.n THEN r.near END AS form, CASE WHEN r.near_n >= 2 * words.n THEN r.near_n END AS form_n
  FROM words LEFT JOIN ranked r ON r.word = words.word AND r.rank = 1
),
up AS (
  SELECT word, word AS at FROM formed
  UNION ALL
  SELECT up.word, formed.form FROM up JOIN formed ON formed.word = up.at WHERE formed.form IS NOT NULL
)
SELECT formed.word, formed.form, up.at AS root, formed.n, formed.n_near, formed.form_n
FROM formed JOIN up ON up.word = formed.word JOIN formed last ON last.word = up.at AND last.form IS NULL
"""
