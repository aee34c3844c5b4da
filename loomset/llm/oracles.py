"""SQL for the rows of those queries whose results plain SQL can express."""

WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: (a, b) in links, both ways; every node and what can be reached from it.
REACH = "reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a), least_of AS (SELECT a, min(b) AS b FROM reach GROUP BY a)"

OP1 = f"""WITH w AS (SELECT doc_id, {WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
  places AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w),
  windows AS (SELECT doc_id, i, w[i] AS word, CASE WHEN i + 34 <= len(w) THEN sha256(array_to_string(w[i : i + 34], ' ')) END AS g FROM places),
  twice AS (SELECT g FROM windows WHERE g IS NOT NULL GROUP BY g HAVING count(*) > 1),
  marked AS (SELECT x.doc_id, x.i, x.word, max(CASE WHEN t.g IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY x.doc_id ORDER BY x.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM windows x LEFT JOIN twice t ON x.g = t.g),
  kept AS (SELECT doc_id, CAST(sum(gone) AS BIGINT) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM marked GROUP BY doc_id)
  SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id"""

OP2 = f"""WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR isnan(x) OR isinf(x)]) = 0 AND len([x for x in embedding if x <> 0]) > 0),
  n AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS size FROM v),
  links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM n x JOIN n y ON x.label = y.label AND x.vec_id <> y.vec_id WHERE list_dot_product(x.e, y.e) / (x.size * y.size) >= 0.98), {REACH},
  counted AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
  SELECT m.vec_id, coalesce(c.n_links, 0) AS n_links, coalesce(least(l.b, m.vec_id), m.vec_id) AS component_id, m.vec_id = coalesce(least(l.b, m.vec_id), m.vec_id) AS kept
  FROM embeddings m LEFT JOIN counted c ON c.a = m.vec_id LEFT JOIN least_of l ON l.a = m.vec_id"""

OP6 = f"""WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(text=LOWER)} AS w FROM documents),
  places AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0),
  shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM places), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
  shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM shingles x JOIN shingles y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
  links AS (SELECT s.a, s.b FROM shared s JOIN sizes x ON x.doc_id = s.a JOIN sizes y ON y.doc_id = s.b WHERE 100 * s.n >= 75 * (x.n + y.n - s.n)), {REACH}
  SELECT w.doc_id, coalesce(z.n, 0) AS n_shingles, coalesce(least(l.b, w.doc_id), w.doc_id) AS component_id, w.doc_id = coalesce(least(l.b, w.doc_id), w.doc_id) AS kept
  FROM w LEFT JOIN sizes z ON z.doc_id = w.doc_id LEFT JOIN least_of l ON l.a = w.doc_id"""


def _grown(x: str, cost: str | int, letter: str) -> str:
    """x is twelve digits of cost and the edits so far."""
    return f"lpad(CAST(CAST(substr({x}, 1, 12) AS BIGINT) + {cost} AS VARCHAR), 12, '0') || substr({x}, 13) || {letter}"


_USER = f"least(f.u, {_grown('f.s', 5, repr('I'))}, {_grown('f.y', 5, repr('I'))}, {_grown('f.a', 5, repr('I'))})"
_KEEP, _CUT = "CASE WHEN r.c = '{}' THEN {} ELSE {} END", "CASE WHEN r.fault = 'truncated' THEN 5 ELSE 0 END"


def _turned(came: str, initial: str) -> str:
    letter = _KEEP.format(initial, "'K'", "'R'")
    return _grown(f"({came})", f"{_KEEP.format(initial, 0, 1)} + {_CUT}", letter)


#: Twelve digits of cost and the edits are one string for each of the four places (start, system, user, assistant), so least() settles both.
OP11 = f"""WITH RECURSIVE d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ord(x) AS BIGINT)),
    lambda c, b: list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda z, i: CASE WHEN z % 2 = 1 THEN xor(z // 2, 3988292384) ELSE z // 2 END, xor(c, b)), 4294967295::BIGINT), 4294967295::BIGINT) % 20 AS k FROM conversations),
  damaged AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM (SELECT *, unnest(range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) FROM d)),
  numbered AS (SELECT *, substr(role, 1, 1) AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, nth) AS i FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS nth FROM damaged)),
  r AS (SELECT *, lag(c) OVER (PARTITION BY conv_id ORDER BY i) AS c0, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\\z') THEN 'truncated' ELSE '' END AS fault FROM numbered),
  counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (c0 IS NOT NULL AND c0 || c NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM r GROUP BY conv_id),
  f(conv_id, i, n, s, y, u, a) AS (SELECT o.conv_id, 0::BIGINT, coalesce(n, 0), '000000000000', '000999999999', '000999999999', '000999999999' FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts ON o.conv_id IS NOT DISTINCT FROM counts.conv_id
    UNION ALL SELECT f.conv_id, r.i, f.n, {_grown("f.s", 2, "'D'")},
      least({_grown("f.y", 2, "'D'")}, CASE WHEN r.c = 's' AND NOT r.fault IN ('blank', 'duplicate') THEN {_grown("f.s", _CUT, "'K'")} ELSE '999999999999' END),
      least({_grown("f.u", 2, "'D'")}, CASE WHEN NOT r.fault IN ('blank', 'duplicate') THEN {_turned("least(f.s, f.y, f.a)", "u")} ELSE '999999999999' END),
      least({_grown("f.a", 2, "'D'")}, CASE WHEN NOT r.fault IN ('blank', 'duplicate') THEN {_turned("f.u", "a")} ELSE '999999999999' END)
    FROM (SELECT conv_id, i, n, s, y, u, least(a, {_grown("u", 5, "'I'")}) AS a FROM (SELECT conv_id, i, n, s, y, {_USER} AS u, a FROM f)) f JOIN r ON r.conv_id IS NOT DISTINCT FROM f.conv_id AND r.i = f.i + 1),
  best AS (SELECT conv_id, least(s, a, {_grown("(" + _USER + ")", 5, "'I'")}) AS best FROM f WHERE i = n),
  letters AS (SELECT conv_id, j, best[12 + j] AS letter FROM (SELECT conv_id, best, unnest(range(1, length(best) - 11)) AS j FROM best)),
  placed AS (SELECT l.conv_id, j, letter, count(*) FILTER (letter <> 'I') OVER w AS i, count(*) FILTER (letter <> 'D') OVER w AS k FROM letters l WINDOW w AS (PARTITION BY conv_id ORDER BY j)),
  stayed AS (SELECT p.*, r.role, r.text, max(CASE WHEN k = 1 AND letter = 'K' AND c = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY p.conv_id) AS system FROM placed p LEFT JOIN r ON letter IN ('K', 'R') AND p.conv_id IS NOT DISTINCT FROM r.conv_id AND p.i = r.i WHERE letter <> 'D'),
  lines AS (SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (k - system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY j) AS said FROM stayed GROUP BY conv_id)
  SELECT b.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(substr(best, 1, 12) AS BIGINT) AS cost, substr(best, 13) AS audit, sha256(coalesce(said, '')) AS repaired_sha256
  FROM best b LEFT JOIN counts c ON b.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN lines l ON b.conv_id IS NOT DISTINCT FROM l.conv_id"""

OP13 = r"""WITH h AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
  t AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS w, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM h),
  c AS (SELECT *, len(w) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b FROM t),
  f AS (SELECT doc_id, text, n, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
    coalesce(array_to_string(w[1 : a], ''), '') AS prefix, coalesce(array_to_string(w[a + 1 : b], ''), '') AS middle, coalesce(array_to_string(w[b + 1 : n], ''), '') AS suffix FROM c)
  SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM f"""
