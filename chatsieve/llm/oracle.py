"""SQL twins of those queries of this subpackage that SQL can express."""

from __future__ import annotations

#: Levels that the twin of the manifest writes out: enough for 3 ** 14 rows of one source and 3 ** 6 sources.
TREE_LEVELS, TOP_LEVELS = 14, 6

SUBSTRINGS = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
runs AS (
  SELECT doc_id, i, array_to_string(w[i + 1 : i + 20], ' ') AS run
  FROM (SELECT doc_id, w, unnest(range(len(w) - 19)) AS i FROM words WHERE len(w) >= 20)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY run ORDER BY doc_id, i) AS nr FROM runs) WHERE nr > 1),
each AS (SELECT doc_id, unnest(range(len(w))) AS i, unnest(w) AS word FROM words),
marked AS (
  SELECT e.doc_id, e.i, e.word, coalesce(max(l.i) OVER (PARTITION BY e.doc_id ORDER BY e.i), -20) >= e.i - 19 AS gone
  FROM each e LEFT JOIN late l ON l.doc_id = e.doc_id AND l.i = e.i),
kept AS (
  SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS text
  FROM marked GROUP BY doc_id)
SELECT w.doc_id, len(w.w) AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM words w LEFT JOIN kept k ON k.doc_id = w.doc_id
"""


def crc32(text: str) -> str:
    """Unsigned CRC-32 of ASCII text, bit by bit."""
    return (f"xor(4294967295, list_reduce(list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT), "
            "lambda c, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], "
            "lambda d, z: CASE WHEN d % 2 = 1 THEN xor(d // 2, 3988292384::BIGINT) ELSE d // 2 END, xor(c, b)), 4294967295::BIGINT))")


def _manifest() -> str:
    def field(x: str) -> str:
        return f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen({x}::VARCHAR)::VARCHAR || ':' || {x}::VARCHAR END"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(field(x) for x in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    def levels(name: str, depth: int) -> list[str]:
        """From `name`0 (tree, i, d: digest, c: nodes of the tree) and `name`_leaves (leaf, tree, i, fold): one CTE of nodes and one of proofs a level."""
        out = []
        for k in range(1, depth + 1):
            out.append(f"""{name}{k} AS MATERIALIZED (
  SELECT tree, i // 3 AS i, CASE WHEN any_value(c) = 1 THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY i)) END AS d, (any_value(c) + 2) // 3 AS c
  FROM {name}{k - 1} GROUP BY tree, i // 3)""")
        for k in range(1, depth + 1):
            last = f"{name}_proofs{k - 1}"
            out.append(f"""{name}_proofs{k} AS MATERIALIZED (
  SELECT p.leaf, any_value(p.tree) AS tree, any_value(p.i) // 3 AS i,
    any_value(p.proof) || coalesce(string_agg(n.d, '' ORDER BY n.i) FILTER (WHERE n.i <> p.i), '') AS proof,
    CASE WHEN any_value(n.c) = 1 THEN any_value(p.fold) ELSE sha256(string_agg(CASE WHEN n.i = p.i THEN p.fold ELSE n.d END, '' ORDER BY n.i)) END AS fold
  FROM {last} p JOIN {name}{k - 1} n ON n.tree IS NOT DISTINCT FROM p.tree AND n.i // 3 = p.i // 3 GROUP BY p.leaf)""")
        return out

    ctes = [
        f"""rows AS MATERIALIZED (
  SELECT row_number() OVER () AS leaf, doc_id, source AS tree, {leaf('text')} AS d,
    {leaf("other")} AS claimed
  FROM (SELECT *, CASE WHEN {crc32("coalesce(doc_id::VARCHAR, '')")} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS other FROM documents))""",
        """numbered AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, d) - 1 AS i, count(*) OVER (PARTITION BY tree) AS c FROM rows)""",
        "a0 AS MATERIALIZED (SELECT tree, i, d, c FROM numbered)",
        "a_proofs0 AS MATERIALIZED (SELECT leaf, tree, i, '' AS proof, claimed AS fold FROM numbered)",
        *levels("a", TREE_LEVELS),
        f"""subroots AS MATERIALIZED (
  SELECT tree, d, row_number() OVER (ORDER BY encode(tree) NULLS FIRST) - 1 AS i, count(*) OVER () AS c FROM a{TREE_LEVELS})""",
        "b0 AS MATERIALIZED (SELECT 0 AS tree, i, d, c FROM subroots)",
        f"""b_proofs0 AS MATERIALIZED (
  SELECT p.leaf, 0 AS tree, s.i, p.proof, p.fold FROM a_proofs{TREE_LEVELS} p JOIN subroots s ON s.tree IS NOT DISTINCT FROM p.tree)""",
        *levels("b", TOP_LEVELS),
    ]
    return "WITH " + ",\n".join(ctes) + f"""
SELECT n.doc_id, n.d AS leaf, s.d AS subroot, r.d AS root, sha256(p.proof) AS proof_sha256, p.fold AS folded_root, p.fold = r.d AS verified
FROM numbered n JOIN subroots s ON s.tree IS NOT DISTINCT FROM n.tree JOIN b_proofs{TOP_LEVELS} p ON p.leaf = n.leaf JOIN b{TOP_LEVELS} r ON r.i = 0
"""


def _repair() -> str:
    def plus(x: str, cost: str, audit: str) -> str:
        """An entry is nine digits of cost and the audit, so that the least text is the best way."""
        return f"(lpad((left({x}, 9)::INTEGER + {cost})::VARCHAR, 9, '0') || substr({x}, 10) || '{audit}')"

    inserts = f"""[v[1], v[2], least(v[3], {plus('v[1]', '5', 'I')}, {plus('v[2]', '5', 'I')}, {plus('v[4]', '5', 'I')}),
      least(v[4], {plus('v[3]', '5', 'I')}, {plus('v[1]', '10', 'II')}, {plus('v[2]', '10', 'II')})]"""
    more = "x[2]::INTEGER"  # what an undeleted row costs besides; -1: it must go

    def stay(i: int, role: str) -> str:
        keep = f"CASE WHEN x[1] = '{role}' AND {more} >= 0 THEN {plus(f'v[{i}]', more, 'K')} END"
        return keep if role == "s" else f"{keep}, CASE WHEN {more} >= 0 THEN {plus(f'v[{i}]', f'1 + {more}', 'R')} END"

    row = f"""[{plus('v[1]', '2', 'D')}, least({plus('v[2]', '2', 'D')}, {stay(1, 's')}),
      least({plus('v[3]', '2', 'D')}, {stay(1, 'u')}, {stay(2, 'u')}, {stay(4, 'u')}), least({plus('v[4]', '2', 'D')}, {stay(3, 'a')})]"""
    draw = crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")
    return rf"""
WITH drawn AS (SELECT *, {draw} % 20 AS draw FROM conversations),
live AS (
  SELECT conv_id, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN draw = 1 THEN '' WHEN draw = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE WHEN draw = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM drawn WHERE draw <> 0),
numbered AS (
  SELECT *, coalesce(left(role, 1), '') AS initial,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, md5(coalesce(text, '')), copy) AS rn,
    row_number() OVER (PARTITION BY conv_id, role, coalesce(text, '') ORDER BY turn NULLS FIRST, copy) AS nr
  FROM live),
judged AS (
  SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY rn) AS last,
    CASE WHEN NOT regexp_matches(coalesce(text, ''), '[^\x20\x09-\x0D]') THEN 'blank' WHEN nr > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault
  FROM numbered),
folded AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
    count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
    count(*) FILTER (WHERE rn > 1 AND last || initial NOT IN ('su', 'ua', 'au')) AS illegal,
    list([initial, CASE WHEN fault IN ('blank', 'duplicate') THEN '-1' WHEN fault = 'truncated' THEN '5' ELSE '0' END] ORDER BY rn) AS kinds
  FROM judged GROUP BY conv_id),
solved AS (
  SELECT * EXCLUDE (kinds), list_reduce(list_append(flatten(list_transform(kinds, lambda k: [['+', '0'], k])), ['+', '0']), lambda v, x:
    CASE WHEN x[1] = '+' THEN {inserts}
    ELSE {row} END, ['000000000', NULL, NULL, NULL]) AS v
  FROM folded),
audits AS (SELECT * EXCLUDE (v), left(least(v[1], v[4]), 9)::BIGINT AS cost, substr(least(v[1], v[4]), 10) AS audit FROM solved),
edits AS (
  SELECT conv_id, i, edit, sum((edit <> 'I')::INTEGER) OVER (PARTITION BY conv_id ORDER BY i) AS rn
  FROM (SELECT conv_id, unnest(range(length(audit))) AS i, unnest(string_split(audit, '')) AS edit FROM audits WHERE audit <> '')),
stays AS (
  SELECT e.conv_id, e.i, e.edit, j.role, j.text,
    sum((NOT (e.edit = 'K' AND j.initial = 's'))::INTEGER) OVER (PARTITION BY e.conv_id ORDER BY e.i) % 2 AS odd
  FROM edits e LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM e.conv_id AND j.rn = e.rn AND e.edit <> 'I' WHERE e.edit <> 'D'),
repaired AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN odd = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END,
    chr(10) ORDER BY i) AS text
  FROM stays GROUP BY conv_id),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, coalesce(a.gaps, 0) AS gaps, coalesce(a.blank, 0) AS blank, coalesce(a.duplicate, 0) AS duplicate, coalesce(a.truncated, 0) AS truncated,
  coalesce(a.illegal, 0) AS illegal, coalesce(a.cost, 0) AS cost, coalesce(a.audit, '') AS audit, sha256(coalesce(r.text, '')) AS repaired_sha256
FROM ids LEFT JOIN audits a ON a.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM ids.conv_id
"""


ORACLE_SQL: dict[str, str] = {
    "op11_substring_dedup": SUBSTRINGS,
    "op12_merkle_manifest": _manifest(),
    "op13_conversation_repair": _repair(),
}
