"""The registered queries once more, as plain SQL for an independent engine."""

from __future__ import annotations

from chatsieve.checks.registry import DIALECT, latin_lexicon
from chatsieve.config import (
    EMAIL_PATTERN, HTML_TAG_PATTERN, LATIN, PHONE_PATTERN, TERM_BOUNDARY, URL_PATTERN, WS, TriageConfig,
)
from chatsieve.plans.adapters import NOW

CFG = TriageConfig()


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def stamp(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f')"


def rex_count(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, {q(pattern)}))"


def share(text: str, cls: str) -> str:
    return f"(length(regexp_replace({text}, {q(f'[^{cls}]')}, '', 'g'))::DOUBLE / greatest(length({text}), 1))"


EMAIL = EMAIL_PATTERN.replace("(?U)", "")
EMOJI = CFG.emoji_class + "+"
REPEAT = ("len(list_filter(range(1, length({t}) - 3), lambda i: c[i] = c[i+1] AND c[i] = c[i+2] AND c[i] = c[i+3] "
          "AND c[i] = c[i+4] AND c[i] <> chr(10) AND c[i] <> chr(13))) > 0")

VIEWS: dict[str, str] = {
    "msg_text": """SELECT doc_id AS message_id, CAST(regexp_extract(source, '[0-9]+') AS BIGINT) AS chat_id,
        doc_id % 97 AS sender_id, 'acct_' || (doc_id % 5) AS account_name,
        TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS ts, text, lang FROM documents""",
    "msg_norm": f"""SELECT *, lower(trim(regexp_replace(text, '[{WS}]+', ' ', 'g'))) AS norm FROM msg_text""",
    "msg_chat": """SELECT turn AS message_id, conv_id AS chat_id, conv_id % 97 AS sender_id, role, text,
        TIMESTAMP '2024-01-01' + to_hours(conv_id) + to_minutes(turn) AS ts FROM conversations""",
    "activity": """SELECT *, decision IN ('accept', 'review') AS is_valid FROM (
        SELECT 'h' || event_id AS message_hash, event_id AS message_id,
        CAST(props->>'$.k' AS BIGINT) % 20 AS chat_id, user_id AS sender_id, 'acct_' || (user_id % 5) AS account_name,
        ts, event_type || ' ' || props AS message_text,
        CASE WHEN event_type <> 'view' THEN event_type END AS keyword,
        CASE event_type WHEN 'purchase' THEN 'accept' WHEN 'signup' THEN 'review' ELSE 'ignore' END AS decision,
        CASE WHEN event_type = 'view' THEN 0.0 ELSE least(value / 200, 1.0) END AS confidence, event_type
        FROM events)""",
    "alerts_v": "SELECT *, 'alert: ' || message_text AS alert_text FROM activity WHERE keyword IS NOT NULL",
    "contacts_v": """SELECT c_custkey AS sender_id, c_name AS username, c_mktsegment AS first_name,
        CAST(NULL AS VARCHAR) AS last_name, 'https://t.me/c/' || c_custkey AS last_message_link FROM customer""",
    "blocked_senders_v": """SELECT sender_id, 'manual' AS reason, min(ts) AS blocked_at FROM activity
        WHERE sender_id % 17 = 0 GROUP BY sender_id""",
    "blocked_chats_v": """SELECT chat_id, 'manual' AS reason, min(ts) AS blocked_at FROM activity
        WHERE chat_id % 13 = 0 GROUP BY chat_id""",
    "block_events_v": """SELECT sender_id, CASE event_type WHEN 'error' THEN 'block' ELSE 'unblock' END AS action,
        'r' || chat_id AS reason, ts, message_id AS event_id FROM activity WHERE event_type IN ('error', 'signup')""",
    "samples_v": "SELECT event_type AS key, ts, event_id AS id, value FROM events",
    "backlog_v": """SELECT event_id AS id, CASE WHEN event_type <> 'view' THEN 7 ELSE 3 END AS priority,
        ts AS created_at FROM events""",
    "failures_v": """SELECT event_id AS id, CAST(props->>'$.k' AS BIGINT) AS chat_id, user_id % 7 AS message_id,
        event_id % 7 AS retry_count, 'Error: ' || repeat(props, 40) AS error_text, ts
        FROM events WHERE event_type = 'error'""",
    "dead_letters_v": """SELECT event_id AS id, user_id % 20 AS chat_id, event_id AS message_id,
        'acct_' || (user_id % 5) AS account_name, 'Error: failed' AS error_text, event_id % 7 AS retry_count,
        event_id % 3 = 0 AS resolved, ts AS created_at FROM events WHERE event_type = 'error'""",
    "feedback_v": """SELECT CASE WHEN doc_id % 2 = 0 THEN 'intent' ELSE 'academic' END AS kind,
        'term' || (doc_id % 5) AS term, quality = 1 AS was_correct, doc_id AS seq FROM labels""",
    "weights_v": """SELECT 'intent' AS kind, p_brand AS term, avg(p_size) / 100 + CAST(0.3 AS DOUBLE) AS weight
        FROM part GROUP BY p_brand UNION ALL
        SELECT 'intent', 'term' || (p_partkey % 3), min(p_size)::DOUBLE / 100 + CAST(0.5 AS DOUBLE)
        FROM part GROUP BY 2""",
    "health_v": """SELECT date_trunc('hour', ts) AS check_time, event_type AS component,
        arg_max(value, event_id) < 60 AS ok FROM events GROUP BY 1, 2""",
    "lexicon_v": """SELECT lower(p_type) || '.brand' || regexp_extract(p_brand, '[0-9]+') AS path,
        lower(p_type) AS category, 'brand' || regexp_extract(p_brand, '[0-9]+') AS grp,
        p_name || ' ' || p_partkey AS term, p_partkey AS pos,
        CAST(regexp_extract(p_brand, '[0-9]+') AS INT) AS ord FROM part""",
    "edits_v": """SELECT CASE WHEN p_partkey % 11 = 0 THEN 'missing.list' ELSE lower(p_type) || '.brand' || regexp_extract(p_brand, '[0-9]+') END AS path,
        CASE WHEN p_partkey % 7 < 3 THEN 'add' WHEN p_partkey % 7 < 5 THEN 'rename' ELSE 'delete' END AS action,
        CASE p_partkey % 7 WHEN 3 THEN p_name || ' ' || p_partkey WHEN 5 THEN p_name || ' ' || p_partkey WHEN 4 THEN 'new ' || p_name WHEN 6 THEN 'absent' END AS old,
        CASE p_partkey % 7 WHEN 0 THEN '  ' WHEN 1 THEN p_name || ' ' || p_partkey WHEN 2 THEN ' new ' || p_name
          WHEN 3 THEN 'renamed ' || p_partkey WHEN 4 THEN p_name || ' ' || p_partkey END AS new, p_partkey AS seq FROM part""",
    "raw_events": """SELECT *, CASE WHEN message_id % 3 > 0 THEN text END AS body_text FROM msg_chat""",
    "reputation_v": """SELECT sender_id, list_reduce(
        list_prepend(CAST(50 AS DOUBLE), list(CASE WHEN is_valid THEN 2.0 ELSE -1.0 END::DOUBLE ORDER BY ts, message_id)),
        lambda x, s: CASE WHEN s > 0 THEN least(100.0::DOUBLE, x + s) ELSE greatest(0.0::DOUBLE, x + s) END
        ) AS reputation_score FROM activity GROUP BY sender_id""",
    "sender_stats_v": """SELECT a.*, coalesce(b.alerts_sent, 0) AS alerts_sent, b.last_alert_time FROM (
        SELECT sender_id, count(*) AS total_messages, count(*) FILTER (is_valid) AS valid_requests,
        count(*) FILTER (NOT is_valid) AS invalid_requests, min(ts) AS first_seen FROM activity GROUP BY sender_id) a
        LEFT JOIN (SELECT sender_id, count(*) AS alerts_sent, max(ts) AS last_alert_time FROM alerts_v
        GROUP BY sender_id) b USING (sender_id)""",
    "weights_after": """SELECT coalesce(w.kind, f.kind) AS kind, coalesce(w.term, f.term) AS term,
        list_reduce(list_prepend(coalesce(w.weight, CAST(0.7 AS DOUBLE)), coalesce(f.moves, [])),
          lambda x, m: greatest(CAST(0.1 AS DOUBLE), least(CAST(1.0 AS DOUBLE), x + CAST(0.05 AS DOUBLE) * (m - x)))) AS weight,
        coalesce(f.n, 0) AS n_feedback
        FROM weights_v w FULL JOIN (SELECT kind, term, count(*) AS n,
          list(CASE WHEN was_correct THEN 1.0 ELSE 0.1 END::DOUBLE ORDER BY seq) AS moves
          FROM feedback_v GROUP BY kind, term) f ON w.kind = f.kind AND w.term = f.term""",
}
_DEPENDS = {
    "msg_norm": ("msg_text",), "alerts_v": ("activity",), "blocked_senders_v": ("activity",),
    "blocked_chats_v": ("activity",), "block_events_v": ("activity",), "raw_events": ("msg_chat",),
    "reputation_v": ("activity",), "sender_stats_v": ("activity", "alerts_v"),
    "weights_after": ("weights_v", "feedback_v"),
}


_STATUS = """CASE WHEN e[1][1] <> 'delete' AND e[1][3] = '' THEN 'empty' WHEN s[1] IS NULL THEN 'bad_path'
    WHEN e[1][1] = 'add' AND list_contains(s[1], e[1][3]) THEN 'already_exists' WHEN e[1][1] <> 'add' AND NOT list_contains(s[1], e[1][2]) THEN 'not_found'
    WHEN e[1][1] = 'rename' AND e[1][3] <> e[1][2] AND list_contains(s[1], e[1][3]) THEN 'already_exists' ELSE 'ok' END"""
# Each list and its edits, folded one after another: v = [terms, statuses].
EDITED = f"""SELECT path, list_reduce(coalesce(edits, []::VARCHAR[][][]), lambda s, e: [
      CASE WHEN {_STATUS} <> 'ok' THEN s[1] WHEN e[1][1] = 'add' THEN list_append(s[1], e[1][3])
        ELSE s[1][:list_position(s[1], e[1][2]) - 1] || CASE WHEN e[1][1] = 'rename' THEN [e[1][3]] ELSE []::VARCHAR[] END
          || s[1][list_position(s[1], e[1][2]) + 1:] END,
      list_append(s[2], e[1][4] || ' ' || {_STATUS})], [items, []::VARCHAR[]]) AS v
    FROM (SELECT path, list(term ORDER BY pos) AS items FROM lexicon_v GROUP BY path) FULL JOIN
      (SELECT path, list([[action, coalesce(old, ''), trim(coalesce(new, '')), seq::VARCHAR]] ORDER BY seq) AS edits FROM edits_v GROUP BY path) USING (path)"""


def with_views(sql: str, *names: str, extra: dict[str, str] | None = None) -> str:
    needed: list[str] = []

    def need(name: str) -> None:
        for dep in _DEPENDS.get(name, ()):
            need(dep)
        if name not in needed:
            needed.append(name)

    for name in names:
        need(name)
    parts = [f"{n} AS ({VIEWS[n]})" for n in needed] + [f"{n} AS ({v})" for n, v in (extra or {}).items()]
    return f"WITH {', '.join(parts)} {sql}"


# --- pieces of the text side ---------------------------------------------------
def values(terms: list[str]) -> str:
    return "(VALUES " + ", ".join(f"({i}, {q(t)})" for i, t in enumerate(terms)) + ") AS terms(ord, term)"


def any_contains(text: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(t)})" for t in terms) + ")" if terms else "FALSE"


def first_hit(text: str, terms: list[str]) -> str:
    """Leftmost start, then shortest term, as struct(term, start), by brute force."""
    found = "[" + ", ".join(
        f"{{'p': strpos({text}, {q(t)}) - 1, 'n': {len(t)}, 'term': {q(t)}}}" for t in dict.fromkeys(terms)) + "]"
    return f"list_extract(list_sort(list_filter({found}, lambda h: h.p >= 0)), 1)"


def occurrence_ctes(source: str, terms: list[str]) -> dict[str, str]:
    """occ(message_id, term, start): every start compared with every term."""
    longest = max(map(len, terms))
    window = " || ".join(["ch", *(f"coalesce(lead(ch, {k}) OVER w, '')" for k in range(1, longest))])
    return {
        "ch": f"""SELECT message_id, unnest(c) AS ch, unnest(range(0, len(c))) AS i
            FROM (SELECT message_id, string_split(norm, '') AS c FROM {source})""",
        "win": f"SELECT message_id, i, {window} AS w FROM ch WINDOW w AS (PARTITION BY message_id ORDER BY i)",
        "occ": f"SELECT message_id, term, i AS start FROM win JOIN {values(terms)} ON starts_with(w, term)",
    }


def kept(text: str, terms: list[str]) -> str:
    """The terms contained, in list order."""
    if not terms:
        return "CAST([] AS VARCHAR[])"
    return f"list_filter([{', '.join(map(q, terms))}], lambda t: contains({text}, t))"


def bands(value: str, rows, otherwise: str) -> str:
    whens = " ".join(
        f"WHEN {value} >= {b.low}" + (f" AND {value} <= {b.high}" if b.high is not None else "")
        + f" THEN {b.value}::DOUBLE" for b in rows)
    return f"CASE {whens} ELSE {otherwise} END" if whens else otherwise


def proximity_sql(rows) -> str:
    gap = "abs(intent_start - object_start)"
    default = (f"(CASE WHEN length(norm) > 100 THEN CASE WHEN {gap} <= 10 THEN 0.9 WHEN {gap} <= 20 THEN 0.7 ELSE 0.4 END "
               f"ELSE CASE WHEN {gap} <= 5 THEN 1.0 WHEN {gap} <= 10 THEN 0.8 ELSE 0.5 END END)::DOUBLE")
    return (f"(CASE WHEN intent_start IS NOT NULL AND object_start IS NOT NULL THEN {bands(gap, rows, default)} "
            f"WHEN intent IS NOT NULL THEN 0.5 ELSE 0.0 END)::DOUBLE")


def negation_sql(lex) -> dict[str, str]:
    exc = any_contains("norm", lex.terms("negation_exception"))
    post = f"list_extract({kept('norm', lex.terms('post_negator'))}, 1)"
    cases = []
    for pv in lex.terms("pre_negator"):
        before = any_contains(f"substr(norm, 1, strpos(norm, {q(pv)}) - 1)", lex.terms("clause_boundary"))
        at = f"(strpos(norm, {q(pv)}) - 1)"
        between = f"substr(norm, least({at}, intent_start) + 1, abs({at} - intent_start))"
        spaces = f"(length({between}) - length(replace({between}, ' ', '')))"
        cases.append(
            f"CASE WHEN NOT contains(norm, {q(pv)}) THEN NULL WHEN {exc} OR {before} THEN '' "
            f"WHEN intent_start IS NOT NULL AND {spaces} > 6 THEN NULL ELSE {q(pv)} END")
    pre = f"coalesce({', '.join(cases)})"
    return {
        "neg0": f"SELECT *, ({first_hit('norm', lex.terms('resolution'))}).term AS res, {post} AS post, {exc} AS exc, "
                f"{pre} AS pre FROM starts",
        "neg": """SELECT *, CASE WHEN res IS NOT NULL THEN 1.0 WHEN post IS NOT NULL THEN CASE WHEN exc THEN 0.0 ELSE 0.8 END
            WHEN pre <> '' THEN 0.6 ELSE 0.0 END::DOUBLE AS negation_score,
            CASE WHEN res IS NOT NULL THEN 'resolution_phrase: ' || res
            WHEN post IS NOT NULL THEN CASE WHEN NOT exc THEN 'post_clause_negator: ' || post END
            WHEN pre <> '' THEN 'pre_verb_negator: ' || pre END AS negation_reason FROM neg0""",
    }


def ad_sql(lex, source: str) -> dict[str, str]:
    kinds = {"hard": "hard_signal", "med": "medium_signal", "strong": "strong_provider", "indiv": "individual_provider",
             "weak": "weak_provider", "cta": "cta_signal", "pay": "payment", "inst": "institution",
             "url": "ad_blocker", "emo": "ad_emoji"}
    cols = ", ".join(f"{kept('norm', lex.terms(n))} AS {k}" for k, n in kinds.items())
    own = "(len(strong) > 0 OR len(indiv) > 0)"

    def each(kind: str, label: str, step: str) -> str:
        return f"list_transform({kind}, lambda t: {{'s': {step}::DOUBLE, 'r': {q(label + ': ')} || t}})"

    none = "CAST([] AS STRUCT(s DOUBLE, r VARCHAR)[])"
    steps = " || ".join([
        each("hard", "hard_ad_signal", "0.4"), each("med", "medium_ad_signal", "0.2"),
        f"CASE WHEN {own} THEN [{{'s': 0.3::DOUBLE, 'r': 'provider_detected'}}] WHEN len(weak) >= 2 THEN "
        f"[{{'s': 0.25::DOUBLE, 'r': 'weak_provider_multiple'}}] ELSE {none} END",
        each("cta", "cta_signal", "0.1"), f"CASE WHEN {own} THEN {each('pay', 'payment_signal', '0.1')} ELSE {none} END",
        each("inst", "institution_term", "0.15"), each("url", "url_signal", "0.2"),
        f"CASE WHEN len(emo) >= 3 THEN [{{'s': 0.2::DOUBLE, 'r': 'ad_emoji_count: ' || len(emo)}}] ELSE {none} END"])
    return {
        "ad0": f"SELECT *, {cols} FROM {source}",
        "ad1": f"SELECT *, {steps} AS steps FROM ad0",
        "ad": """SELECT *, least(list_reduce(list_prepend(0.0::DOUBLE, list_transform(steps, lambda x: x.s)),
            lambda a, b: a + b), 1.0::DOUBLE) AS advert_score, list_transform(steps, lambda x: x.r) AS advert_reasons
            FROM ad1""",
    }


def block_sql(lex) -> str:
    return (f"CASE WHEN {any_contains('norm', lex.terms('advertisement'))} THEN 'advertisement' "
            f"WHEN {any_contains('norm', lex.terms('education'))} THEN 'education_provider' "
            f"WHEN {any_contains('norm', lex.terms('ad_emoji'))} THEN 'advertisement_emoji' END")


def starts_sql(lex, source: str) -> str:
    return f"""SELECT *, ih.term AS intent, ih.p AS intent_start, oh.term AS object, oh.p AS object_start FROM (
        SELECT *, {first_hit('norm', lex.terms('request'))} AS ih, {first_hit('norm', lex.terms('context'))} AS oh
        FROM {source})"""


def ascii(text: str) -> str:
    """The engine's edit distance counts bytes: give accented letters one byte each."""
    return f"translate({text}, 'àâäáãçéèêëíîïñóôöúùûüßœ', 'ABCDEFGHIJKLMNOPQRSTUVW')"


def fuzzy_sql(lex, source: str) -> dict[str, str]:
    """Best near match by comparing every word window with every term."""
    terms = list(lex.intent_weights)
    lengths = sorted({t.count(" ") + 1 for t in terms})
    cuts = " UNION ALL ".join(
        f"SELECT message_id, {n} AS n, unnest(list_transform(range(1, len(w) - {n - 2}), "
        f"lambda i: array_to_string(w[i:i+{n - 1}], ' '))) AS win FROM fz_words WHERE len(w) >= {n}" for n in lengths)
    rows = ", ".join(f"({i}, {q(t)}, {t.count(' ') + 1}, {lex.intent_weights[t]}::DOUBLE)" for i, t in enumerate(terms))
    return {
        "fz_words": f"SELECT message_id, string_split(norm, ' ') AS w FROM {source}",
        "fz_cuts": f"SELECT DISTINCT message_id, n, win FROM ({cuts})",
        "fz": f"""SELECT message_id, arg_max(term, (sim, -ord)) AS term, max(sim) AS sim, arg_max(weight, (sim, -ord)) AS weight
            FROM (SELECT message_id, ord, term, weight,
              100.0::DOUBLE * (1 - levenshtein({ascii("win")}, {ascii("term")})::DOUBLE / greatest(length(win), length(term))) AS sim
              FROM fz_cuts JOIN (VALUES {rows}) AS terms(ord, term, n, weight) USING (n)
              WHERE abs(length(win) - length(term)) <= 4) WHERE sim >= 85 GROUP BY message_id""",
    }


def weight_sql(term: str, table: dict[str, float]) -> str:
    whens = " ".join(f"WHEN {q(t)} THEN {w}" for t, w in table.items())
    return f"(CASE {term} {whens} ELSE 0.7 END)::DOUBLE"


def triage_ctes(longest: int = 5000) -> dict[str, str]:
    """The whole cascade, one step per table, every score computed for every message."""
    lex = latin_lexicon()
    keys = sorted(lex.dialect, key=len, reverse=True)
    # A dialect key may span two words; such keys are tried first, as bounded token runs.
    ctes = {
        "base": f"SELECT *, regexp_replace(text, '^[{WS}]+|[{WS}]+$', '', 'g') AS trimmed FROM msg_text",
        "valid0": f"""SELECT *, CASE WHEN length(text) > {longest} THEN 'too_long'
            WHEN length(trimmed) < 10 OR length(trimmed) > {longest} THEN 'invalid_input' END AS invalid FROM base""",
        "plain": f"SELECT *, lower(trim(regexp_replace(trimmed, '[{WS}]+', ' ', 'g'))) AS n0 FROM valid0 WHERE invalid IS NULL",
        "tok": f"SELECT *, regexp_extract_all(n0, '[^{TERM_BOUNDARY}]+|[{TERM_BOUNDARY}]') AS tk FROM plain",
        # 'th the' -> one step that swallows three tokens; the others replace one token
        "dial": """SELECT * EXCLUDE (tk), array_to_string(list_reduce(
              list_prepend({'out': CAST([] AS VARCHAR[]), 'skip': 0, 'i': 0}, list_transform(tk, lambda t, i:
                {'out': [t, coalesce(tk[i+1], ''), coalesce(tk[i+2], '')], 'skip': 0, 'i': CAST(i AS INT)})),
              lambda a, t: CASE WHEN a.skip > 0 THEN {'out': a.out, 'skip': a.skip - 1, 'i': a.i}
                WHEN t.out[1] = 'th' AND t.out[2] = ' ' AND t.out[3] = 'the' THEN
                  {'out': list_append(a.out, 'the'), 'skip': 2, 'i': a.i}
                ELSE {'out': list_append(a.out, CASE t.out[1] WHEN 'th' THEN 'the' WHEN 'nd' THEN 'and'
                  WHEN 'ha' THEN 'has' WHEN 'er' THEN 'her' ELSE t.out[1] END), 'skip': 0, 'i': a.i} END).out, '') AS norm
            FROM tok""",
        "pre": f"""SELECT *, {rex_count('norm', '[^ ]+')} AS words, {rex_count('norm', EMOJI)} AS emo_runs,
            {share('norm', LATIN.block)} AS ratio, string_split(norm, '') AS c FROM dial""",
        "early0": """SELECT *, CASE WHEN length(norm) < 2 THEN 'empty_or_too_short'
            WHEN words < 2 THEN 'too_few_words_' || words WHEN emo_runs > 5 THEN 'too_many_emojis_' || emo_runs
            WHEN ratio < 0.1 THEN 'low_arabic_ratio' END AS early FROM pre""",
        "ranked": """SELECT *, CASE WHEN early IS NULL AND row_number() OVER (
            PARTITION BY (early IS NULL), norm ORDER BY ts, message_id) > 1 THEN 'duplicate' END AS dup FROM early0""",
        "gated": f"""SELECT *, coalesce(early, dup, CASE
            WHEN NOT (CASE WHEN ratio > 0.35 THEN TRUE WHEN ratio < 0.12 THEN FALSE ELSE ratio > 0.25 END) THEN 'non_arabic'
            WHEN least(CASE WHEN regexp_matches(norm, {q(PHONE_PATTERN)}) THEN 0.3 ELSE 0.0 END::DOUBLE
              + least(0.4::DOUBLE, {rex_count('norm', URL_PATTERN)} * 0.2::DOUBLE)
              + least(0.2::DOUBLE, emo_runs * 0.04::DOUBLE)
              + CASE WHEN {REPEAT.format(t='norm')} THEN 0.15 ELSE 0.0 END::DOUBLE, 1.0) > 0.7 THEN 'spam_detected'
            WHEN {any_contains('norm', lex.terms('spam'))} THEN 'spam_pattern'
            WHEN {any_contains('norm', lex.terms('ignore'))} THEN 'ignore_pattern'
            WHEN {any_contains('norm', lex.terms('ad_blocker'))} THEN 'ad_blocker' END) AS gate FROM ranked""",
        "open": "SELECT * FROM gated WHERE gate IS NULL",
        **occurrence_ctes("open", lex.terms("context")),
        "hits": f"""SELECT *, {first_hit('norm', lex.terms('request'))} AS eh, {first_hit('norm', lex.terms('context'))} AS oh,
            ({first_hit('norm', lex.terms('indirect'))}).term AS indirect_term,
            ({first_hit('norm', lex.terms('urgency'))}).term AS urgency_term,
            ({first_hit('norm', lex.terms('implicit'))}).term AS implicit_term,
            ({first_hit('norm', lex.terms('boost'))}).term AS boost_term,
            coalesce(n.n, 0) AS n_context,
            {any_contains('norm', lex.terms('subject') + lex.terms('action'))} AS grammar FROM open
            LEFT JOIN (SELECT message_id, count(*) AS n FROM occ GROUP BY message_id) n USING (message_id)""",
        "unmatched": "SELECT * FROM hits WHERE eh IS NULL",
        **fuzzy_sql(lex, "unmatched"),
        "starts": """SELECT h.*, f.term AS fuzzy_term, coalesce(eh.term, f.term) AS intent,
            coalesce(eh.p, CASE WHEN f.term IS NOT NULL THEN 0 END) AS intent_start,
            oh.term AS object, oh.p AS object_start FROM hits h LEFT JOIN fz f USING (message_id)""",
        **negation_sql(lex),
        **ad_sql(lex, "neg"),
        "parts": f"""SELECT *, {block_sql(lex)} AS block_reason, coalesce(intent, indirect_term) AS kw,
            CASE WHEN eh IS NOT NULL THEN {weight_sql('eh.term', lex.intent_weights)}
              WHEN fuzzy_term IS NOT NULL THEN {weight_sql('fuzzy_term', lex.intent_weights)} * 0.85::DOUBLE
              ELSE 0.0 END AS wi,
            CASE WHEN object IS NULL THEN 0.0 ELSE {weight_sql('object', lex.object_weights)} END AS wo,
            {proximity_sql(lex.distance_bands)} AS dist,
            {bands('words', lex.length_bands, '0.9')}::DOUBLE AS lm,
            least(n_context * 5, 20) AS cboost FROM ad""",
        "legacy0": """SELECT *, CASE WHEN intent IS NOT NULL THEN 60 ELSE 0 END + cboost
            + CASE WHEN urgency_term IS NOT NULL THEN 15 ELSE 0 END
            + CASE WHEN indirect_term IS NOT NULL AND intent IS NULL THEN 25 ELSE 0 END AS legacy FROM parts""",
        "weighted0": """SELECT *, greatest(0.0, least(1.0, (wi * 0.30::DOUBLE + wo * 0.25::DOUBLE
            + CASE WHEN grammar THEN 0.15 ELSE 0 END::DOUBLE + dist * 0.15::DOUBLE
            + CASE WHEN urgency_term IS NOT NULL THEN 0.05 ELSE 0 END::DOUBLE
            + least(n_context / 3.0::DOUBLE, 1.0) * 0.10::DOUBLE) / (0.30::DOUBLE + 0.25::DOUBLE + 0.15::DOUBLE
            + 0.15::DOUBLE + 0.05::DOUBLE + 0.10::DOUBLE))) AS wt FROM legacy0""",
        "conf0": """SELECT *, greatest(0.0, least(1.0, (legacy / 100.0::DOUBLE + wt) / 2.0 * lm
            * CASE WHEN negation_score > 0 THEN 1 - negation_score * 0.7::DOUBLE ELSE 1.0 END
            * (1 - advert_score * 0.9::DOUBLE)
            + CASE WHEN boost_term IS NOT NULL THEN 0.25 ELSE 0 END::DOUBLE)) AS cf,
            CASE WHEN negation_score > 0.7 THEN 'n' WHEN advert_score > 0.6 THEN 'a'
              WHEN block_reason IS NOT NULL THEN 'b' WHEN kw IS NULL THEN 'k' END AS stop FROM weighted0""",
        "scored": """SELECT message_id, stop, CASE stop WHEN 'n' THEN negation_reason WHEN 'a' THEN advert_reasons[1]
              WHEN 'b' THEN block_reason WHEN 'k' THEN 'no_keyword'
              ELSE CASE WHEN intent IS NOT NULL THEN 'keyword_found' ELSE 'indirect_request' END END AS reason,
            CASE stop WHEN 'n' THEN 1.0::DOUBLE - negation_score WHEN 'a' THEN 1.0::DOUBLE - advert_score
              WHEN 'b' THEN 0.0 WHEN 'k' THEN 0.0 ELSE cf END AS confidence,
            CASE WHEN stop IS NOT NULL THEN 'ignore' WHEN cf >= 0.65 THEN 'accept' WHEN cf >= 0.40 THEN 'review'
              ELSE 'ignore' END AS decision,
            CASE stop WHEN 'n' THEN [negation_reason] WHEN 'a' THEN advert_reasons WHEN 'b' THEN [] WHEN 'k' THEN []
              ELSE list_filter([
                'intent_verb: ' || intent, 'academic_object: ' || object, 'urgency: ' || urgency_term,
                CASE WHEN implicit_term IS NOT NULL THEN 'implicit_request' END,
                CASE WHEN negation_score > 0 THEN negation_reason END], lambda x: x IS NOT NULL)
                || CASE WHEN advert_score > 0.3 THEN advert_reasons ELSE [] END
                || list_filter(['template_boost: ' || boost_term], lambda x: x IS NOT NULL) END AS reasons,
            list_filter([intent, object, boost_term], lambda x: x IS NOT NULL) AS phrases,
            legacy, cboost, n_context, indirect_term, urgency_term, intent, object, negation_score, advert_score,
            fuzzy_term, wt, wi, wo, grammar, dist, lm, kw FROM conf0""",
        "final": """SELECT m.message_id, m.lang, m.text, s.*EXCLUDE (message_id, reason, confidence, decision),
            coalesce(v.invalid, g.gate, s.reason) AS reason, coalesce(s.confidence, 0.0) AS confidence,
            coalesce(s.decision, 'ignore') AS decision, s.message_id IS NOT NULL AND s.stop IS NULL AS ok
            FROM msg_text m LEFT JOIN valid0 v USING (message_id) LEFT JOIN gated g USING (message_id)
            LEFT JOIN scored s USING (message_id)""",
    }
    assert keys == ["th the", *keys[1:]] and set(keys) == {"th the", "th", "nd", "ha", "er"}
    return ctes


def triage_sql(select: str, longest: int = 5000) -> str:
    return with_views(select, "msg_text", extra=triage_ctes(longest))


def oracle_sql() -> dict[str, str]:
    lex = latin_lexicon()
    starts = {"starts": starts_sql(lex, "msg_norm")}
    contacts = "LEFT JOIN contacts_v c USING (sender_id)"
    trimmed = f"regexp_replace(coalesce(nullif(body_text, ''), '  ' || text || chr(10)), '^[{WS}]+|[{WS}]+$', '', 'g')"
    out: dict[str, str] = {}

    # sources and text
    out["read_events"] = with_views(f"""SELECT chat_id, message_id, {trimmed} AS text, CAST({trimmed} <> '' AS INT) AS has_text,
        CAST(message_id % 4 = 0 AS INT) AS has_media, {stamp('ts')} AS ts FROM raw_events""", "raw_events")
    out["admit_events"] = with_views(f"""SELECT chat_id, message_id, CASE WHEN {trimmed} <> '' THEN 7 ELSE 3 END AS priority,
        {stamp('ts')} AS ts FROM raw_events WHERE role <> 'system' AND chat_id <> 3
        AND ts >= TIMESTAMP '2024-01-01 01:59:59'""", "raw_events")
    out["read_lexicon"] = """SELECT * FROM (
        SELECT p_partkey, 'intent_verbs.tier.terms' AS path, 'intent_verbs' AS category, 'tier.terms' AS grp,
          w[i] AS term, round(p_size::DOUBLE / 100, 6) AS weight, i - 1 AS pos
          FROM (SELECT p_partkey, p_size, string_split(p_name, ' ') AS w, unnest(range(1, len(string_split(p_name, ' ')) + 1)) AS i FROM part)
        UNION ALL SELECT p_partkey, 'request_phrases.general', 'request_phrases', 'general', p_brand, 0.7, 0 FROM part
        UNION ALL SELECT p_partkey, 'request_phrases.general', 'request_phrases', 'general', p_name, 0.7, 1 FROM part
        UNION ALL SELECT p_partkey, 'ad_blockers', 'ad_blockers', '', p_type, 0.7, 0 FROM part)"""
    out["log_entries"] = r"""SELECT 'f' || (user_id % 40) AS file, row_number() OVER (PARTITION BY user_id % 40 ORDER BY event_id) AS entry,
        strftime(ts::TIMESTAMP, '%Y-%m-%d %H:%M:%S') AS time,
        CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARNING' ELSE 'INFO' END AS level, event_type AS source,
        props || CASE WHEN event_id % 5 = 0 THEN chr(10) || '  at step ' || event_id || chr(10) || ' | end' ELSE '' END AS message
        FROM events"""
    out["validate_messages"] = with_views(f"""SELECT message_id, CASE WHEN length(text) > 5000 THEN 'too_long'
        WHEN length(regexp_replace(text, '^[{WS}]+|[{WS}]+$', '', 'g')) NOT BETWEEN 10 AND 5000 THEN 'invalid_input' END
        AS invalid_reason FROM msg_text""", "msg_text")
    out["normalize_messages"] = with_views("SELECT message_id, norm AS norm_text FROM msg_norm", "msg_norm")
    swap = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in DIALECT.items())
    out["canonicalize_terms"] = with_views(f"""SELECT message_id, array_to_string(list_transform(
        regexp_extract_all(norm, '[^{TERM_BOUNDARY}]+|[{TERM_BOUNDARY}]'), lambda t: CASE t {swap} ELSE t END), '') AS norm_text
        FROM msg_norm""", "msg_norm")
    signals = f"""{rex_count('text', f'[^{WS}]+')} AS word_count, {rex_count('text', EMOJI)} AS emoji_runs,
        {rex_count('text', URL_PATTERN)} AS url_count, CAST(regexp_matches(text, {q(PHONE_PATTERN)}) AS INT) AS has_phone,
        CAST(regexp_matches(text, {q(EMAIL)}) AS INT) AS has_email, CAST({REPEAT.format(t='text')} AS INT) AS has_repeat,
        round({share('text', LATIN.block)}, 6) AS block_ratio"""
    out["text_signals"] = f"""SELECT origin, id, {signals} FROM (SELECT *, string_split(text, '') AS c FROM (
        SELECT 'document' AS origin, doc_id AS id, text FROM documents UNION ALL
        SELECT 'page', page_id, html FROM pages))"""
    out["prefilter"] = with_views(f"""SELECT message_id, CASE WHEN length(norm) < 2 THEN 'empty_or_too_short'
        WHEN {rex_count('norm', '[^ ]+')} < 40 THEN 'too_few_words_' || {rex_count('norm', '[^ ]+')}
        WHEN {rex_count('norm', EMOJI)} > 0 THEN 'too_many_emojis_' || {rex_count('norm', EMOJI)}
        WHEN {share('norm', LATIN.block)} < 0.8 THEN 'low_arabic_ratio' END AS prefilter_reason FROM msg_norm""", "msg_norm")
    ratio = share("norm", LATIN.letters)
    out["detect_script"] = with_views(f"""SELECT message_id, round({ratio}, 6) AS script_ratio, CAST(CASE WHEN {ratio} > 0.35 THEN TRUE
        WHEN {ratio} < 0.12 THEN FALSE ELSE {ratio} > 0.25 END AS INT) AS is_script FROM msg_norm""", "msg_norm")
    out["spam_score"] = with_views(f"""SELECT message_id, round(s, 6) AS spam_score, CAST(s > 0.2 AS INT) AS is_spam FROM (
        SELECT message_id, least(CASE WHEN regexp_matches(norm, {q(PHONE_PATTERN)}) THEN 0.3 ELSE 0.0 END::DOUBLE
          + least(0.4::DOUBLE, {rex_count('norm', URL_PATTERN)} * 0.2::DOUBLE)
          + least(0.2::DOUBLE, {rex_count('norm', EMOJI)} * 0.04::DOUBLE)
          + CASE WHEN {REPEAT.format(t='norm')} THEN 0.15 ELSE 0.0 END::DOUBLE, 1.0) AS s
        FROM (SELECT *, string_split(norm, '') AS c FROM msg_norm))""", "msg_norm")
    out["message_identity"] = with_views(f"""SELECT message_id, sha256(chat_id || '_' || message_id || '_' ||
        regexp_replace(lower(text), '^[{WS}]+|[{WS}]+$', '', 'g')) AS message_hash, sha256(norm) AS content_hash
        FROM msg_norm""", "msg_norm")
    esc = "replace(replace(replace(replace({t}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
    cut = "CASE WHEN length(text) <= 400 THEN text ELSE substr(text, 1, 399) || '...' END"
    out["alert_card"] = with_views(f"""SELECT message_id,
        CASE WHEN message_id % 3 = 0 THEN 'https://t.me/src' || chat_id
          WHEN message_id % 3 = 1 THEN 'https://t.me/c/' || chat_id || '77' ELSE '#' END AS group_link,
        CASE WHEN message_id % 3 = 0 THEN 'https://t.me/src' || chat_id || '/' || message_id
          WHEN message_id % 3 = 1 THEN 'https://t.me/c/' || chat_id || '77/' || message_id ELSE '#' END AS message_link,
        CASE WHEN message_id % 4 = 0 THEN 'https://t.me/u' || (message_id % 97) WHEN message_id % 9 = 0 THEN NULL
          WHEN message_id % 6 = 0 AND message_id <> 0 THEN 'tg://openmessage?user_id=' || (message_id % 9)
          ELSE 'tg://user?id=' || (message_id % 9) END AS profile_link,
        coalesce(nullif(trim(concat(CASE WHEN message_id % 5 > 0 THEN lang END, ' ',
          CASE WHEN message_id % 7 = 0 THEN account_name END)), ''), 'user (' || (message_id % 9) || ')') AS display_name,
        {esc.format(t=f'({cut})')} AS safe_text,
        '[' || repeat('█', f) || repeat('░', 10 - f) || '] ' || (message_id % 131) AS score_bar
        FROM (SELECT *, least(10, CAST(round_even((message_id % 131)::DOUBLE / 100 * 10, 0) AS INT)) AS f FROM msg_text)""",
        "msg_text")
    out["flag_dangerous_html"] = f"""SELECT page_id, CAST(regexp_matches(html, {q(HTML_TAG_PATTERN)}) AS INT) AS dangerous_html
        FROM pages"""

    # matching and scoring
    out["match_all"] = with_views("SELECT message_id, term, start FROM occ", "msg_norm",
                                  extra=occurrence_ctes("msg_norm", lex.terms("context")))
    out["match_all_joined"] = out["match_all"]
    out["match_first"] = with_views(f"""SELECT message_id, arg_min(term, (p, length(term))) AS term, min(p) AS start FROM (
        SELECT message_id, term, strpos(norm, term) - 1 AS p FROM msg_norm JOIN {values(lex.terms('request'))}
        ON contains(norm, term)) GROUP BY message_id""", "msg_norm")
    out["match_first_joined"] = out["match_first"]
    both = list(dict.fromkeys(lex.terms("request") + lex.terms("context")))
    out["match_contains"] = with_views(
        f"SELECT message_id, term FROM msg_norm JOIN {values(both)} ON contains(norm, term)", "msg_norm")
    out["fuzzy_match"] = with_views(
        """SELECT message_id, term, round(sim, 6) AS similarity, round(weight * 0.85::DOUBLE, 6) AS weight, 0 AS start FROM fz""",
        "msg_norm", extra={"open": f"SELECT * FROM msg_norm WHERE NOT {any_contains('norm', lex.terms('request'))}",
                           **fuzzy_sql(lex, "open")})
    out["fuzzy_match_joined"] = out["fuzzy_match"]
    out["match_table_terms"] = with_views(r"""SELECT message_id, term, count(*) AS times, min(p) AS first_start FROM (
          SELECT message_id, n, unnest(range(length(norm) - n + 1)) AS p, norm FROM msg_norm, (SELECT DISTINCT length(term) AS n FROM terms) WHERE length(norm) >= n)
        JOIN terms ON term = substring(norm, p + 1, n) GROUP BY message_id, term""", "msg_norm", extra={"terms": r"""
          SELECT DISTINCT term FROM (SELECT unnest(string_split_regex(lower(text), '[^\p{L}]+')) AS term FROM benchmark) WHERE length(term) >= 6"""})
    out["expand_templates"] = """WITH slots AS (SELECT DISTINCT
          ['need', 'person', 'action', 'expert', 'availability'][p_partkey % 5 + 1] AS tag, p_name AS term FROM part),
        n AS (SELECT term FROM slots WHERE tag = 'need'), p AS (SELECT term FROM slots WHERE tag = 'person'),
        a AS (SELECT term FROM slots WHERE tag = 'action'), e AS (SELECT term FROM slots WHERE tag = 'expert'),
        v AS (SELECT term FROM slots WHERE tag = 'availability')
        SELECT n.term || ' ' || p.term AS phrase FROM n, p UNION SELECT v.term || ' ' || e.term FROM v, e
        UNION SELECT n.term || ' ' || p.term || ' ' || a.term FROM n, p, a"""
    out["negation_scope"] = with_views("""SELECT message_id, CAST(negation_score > 0 AS INT) AS negated, negation_score, negation_reason
        FROM neg""", "msg_norm", extra={**starts, **negation_sql(lex)})
    out["ad_score"] = with_views("""SELECT message_id, round(advert_score, 6) AS advert_score,
        array_to_string(advert_reasons, '|') AS advert_reasons FROM ad""", "msg_norm", extra=ad_sql(lex, "msg_norm"))
    out["ad_block"] = with_views(f"SELECT message_id, {block_sql(lex)} AS block_reason FROM msg_norm", "msg_norm")
    out["proximity_score"] = with_views(
        f"SELECT message_id, {proximity_sql(lex.distance_bands)} AS distance_score FROM starts", "msg_norm", extra=starts)
    out["proximity_score_default"] = with_views(
        f"SELECT message_id, {proximity_sql(())} AS distance_score FROM starts", "msg_norm", extra=starts)
    out["length_modifier"] = with_views(
        f"""SELECT message_id, {bands(rex_count('norm', '[^ ]+'), lex.length_bands, '0.9')}::DOUBLE AS length_modifier
        FROM msg_norm""", "msg_norm")
    det = lambda c, n: f"CASE WHEN ok THEN round({c}, 4) ELSE 0.0 END AS {n}"
    out["triage_messages"] = triage_sql(f"""SELECT message_id, CAST(ok AND legacy >= 50 AND decision <> 'ignore' AS INT) AS valid, reason,
        CASE WHEN ok THEN kw END AS keyword, CASE WHEN ok THEN legacy ELSE CAST(trunc(confidence * 100) AS INT) END AS score,
        decision, round(confidence, 9) AS confidence,
        array_to_string(coalesce(reasons, [reason]), '|') AS reasons,
        CASE WHEN ok THEN array_to_string(phrases, '|') ELSE '' END AS key_phrases,
        CASE WHEN NOT ok THEN 'general' WHEN n_context > 0 THEN 'academic_request' WHEN urgency_term IS NOT NULL
          THEN 'urgent_request' ELSE 'direct_request' END AS context_type,
        CASE WHEN ok THEN cboost ELSE 0 END AS context_boost,
        CASE WHEN stop IN ('b', 'k') THEN 0.5 WHEN NOT ok THEN round(confidence, 6) WHEN n_context > 0 THEN 0.9
          WHEN urgency_term IS NOT NULL THEN 0.85 ELSE 0.75 END::DOUBLE AS context_confidence,
        CAST(ok AND indirect_term IS NOT NULL AND intent IS NULL AS INT) AS indirect,
        CAST(ok AND urgency_term IS NOT NULL AS INT) AS urgent,
        CASE WHEN ok THEN intent END AS intent_verb, CASE WHEN ok THEN object END AS academic_object,
        CASE WHEN ok THEN urgency_term END AS urgency_marker,
        CAST(ok AND negation_score > 0 AS INT) AS negation_detected,
        CASE WHEN ok THEN round(advert_score, 6) ELSE 0.0 END AS advert_score,
        CAST(ok AND fuzzy_term IS NOT NULL AS INT) AS fuzzy_matched,
        {det('legacy / 100.0::DOUBLE', 'legacy_score')}, {det('wt', 'weighted_score')}, {det('wi', 'intent_weight')},
        {det('wo', 'academic_weight')}, {det('CASE WHEN grammar THEN 1.0 ELSE 0.0 END::DOUBLE', 'grammar_score')},
        {det('dist', 'distance_score')}, {det('lm', 'length_modifier')} FROM final""")
    out["triage_long_texts"] = triage_sql("""SELECT message_id, CAST(ok AND legacy >= 50 AND decision <> 'ignore' AS INT) AS valid, reason, decision,
        round(confidence, 9) AS confidence, CASE WHEN ok THEN kw END AS keyword, CASE WHEN ok THEN object END AS academic_object,
        CASE WHEN ok THEN cboost ELSE 0 END AS context_boost FROM final""", 1_000_000_000)
    out["triage_decisions_by_language"] = triage_sql(
        "SELECT lang, decision, count(*) AS messages, round(avg(confidence), 6) AS avg_confidence FROM final GROUP BY 1, 2")
    prefiltered = ("(reason IN ('empty_or_too_short', 'low_arabic_ratio') OR starts_with(reason, 'too_few_words_') "
                   "OR starts_with(reason, 'too_many_emojis_'))")
    out["triage_totals"] = triage_sql(f"""SELECT *, round(CASE WHEN processed > 0 THEN valid * 100.0::DOUBLE / processed ELSE 0 END, 6) AS hit_rate FROM (
        SELECT count(*) AS messages,
        count(*) FILTER (NOT {prefiltered} AND reason NOT IN ('too_long', 'invalid_input', 'duplicate')) AS processed,
        count(*) FILTER (ok AND legacy >= 50 AND decision <> 'ignore') AS valid,
        count(*) FILTER (ok AND NOT (legacy >= 50 AND decision <> 'ignore')) AS rejected,
        count(*) FILTER (reason IN ('spam_detected', 'spam_pattern')) AS spam,
        count(*) FILTER ({prefiltered}) AS prefilter_rejected, count(*) FILTER (reason = 'duplicate') AS duplicates,
        count(*) FILTER (ok AND fuzzy_term IS NOT NULL) AS fuzzy, count(*) FILTER (decision = 'accept') AS accepted,
        count(*) FILTER (decision = 'review') AS reviewed, count(*) FILTER (decision = 'ignore') AS ignored FROM final)""")
    out["update_weights"] = with_views(
        "SELECT kind, term, round(weight, 6) AS weight, n_feedback FROM weights_after", "weights_after")
    out["reseed_weights"] = with_views("""SELECT f.kind, f.term, round(coalesce(w.weight, 0.9::DOUBLE), 6) AS weight FROM (
        SELECT DISTINCT 'intent' AS kind, p_brand AS term FROM part WHERE p_size > 10
        UNION SELECT 'intent', 'term' || (p_partkey % 8) FROM part) f LEFT JOIN weights_after w USING (kind, term)""", "weights_after")

    # dedup, profiles
    out["dedup_messages"] = with_views(f"""SELECT chat_id, message_id, 0 AS copy, sha256(chat_id || '_' || message_id || '_' ||
        regexp_replace(lower(coalesce(text, '')), '^[{WS}]+|[{WS}]+$', '', 'g')) AS message_hash, {stamp('min(ts)')} AS ts
        FROM msg_chat GROUP BY chat_id, message_id, text""", "msg_chat")
    out["dedup_content"] = with_views("""SELECT message_id, sha256(norm) AS content_hash, CAST(row_number() OVER (
        PARTITION BY norm ORDER BY ts, message_id) > 1 AS INT) AS is_duplicate FROM msg_norm""", "msg_norm")
    out["drop_blocked"] = with_views("""SELECT message_hash, sender_id, chat_id FROM activity WHERE sender_id NOT IN
        (SELECT sender_id FROM blocked_senders_v) AND chat_id NOT IN (SELECT chat_id FROM blocked_chats_v)""",
        "blocked_senders_v", "blocked_chats_v")
    # replay: streaks of block events, an unblock closes them
    streaks = """SELECT *, sum(CASE action WHEN 'unblock' THEN 1 ELSE 0 END) OVER (PARTITION BY sender_id
        ORDER BY ts, event_id) AS streak, sum(CASE action WHEN 'unblock' THEN 1 ELSE 0 END) OVER (PARTITION BY sender_id) AS n_un
        FROM block_events_v"""
    current = """SELECT sender_id, arg_min(reason, (ts, event_id)) AS reason, min(ts) AS blocked_at, max(n_un) AS n_un
        FROM streaks WHERE action = 'block' AND streak = n_un GROUP BY sender_id"""
    out["apply_block_events"] = with_views(f"""SELECT sender_id, reason, {stamp('blocked_at')} AS blocked_at FROM (
        SELECT sender_id, reason, blocked_at FROM blocked_senders_v WHERE sender_id NOT IN
          (SELECT sender_id FROM block_events_v WHERE action = 'unblock')
        UNION ALL SELECT sender_id, reason, blocked_at FROM cur WHERE NOT (n_un = 0 AND sender_id IN
          (SELECT sender_id FROM blocked_senders_v)))""", "block_events_v", "blocked_senders_v",
        extra={"streaks": streaks, "cur": current})
    out["newest_blocks"] = with_views(f"""SELECT sender_id, reason, {stamp('blocked_at')} AS blocked_at FROM (
        SELECT * FROM cur ORDER BY blocked_at DESC, sender_id DESC LIMIT 100)""", "block_events_v",
        extra={"streaks": streaks, "cur": current})
    out["with_profile"] = with_views(f"""SELECT message_hash, sender_id, username, first_name, last_name FROM alerts_v {contacts}""",
        "alerts_v", "contacts_v")
    out["latest_profile"] = with_views(f"""SELECT sender_id, 'u' || sender_id || '_' || event_type AS username, chat_id AS last_chat_id,
        message_id AS last_message_id, {stamp('ts')} AS ts FROM activity
        QUALIFY row_number() OVER (PARTITION BY sender_id ORDER BY ts DESC, message_id DESC) = 1""", "activity")
    out["lookup_by_hash"] = with_views("""SELECT w.message_hash, coalesce(al.alert_text, m.message_text) AS text FROM (
        SELECT 'h' || (event_id * 3) AS message_hash FROM events) w LEFT JOIN alerts_v al USING (message_hash)
        LEFT JOIN activity m USING (message_hash)""", "alerts_v", "activity")

    # senders
    out["sender_stats"] = with_views(f"""SELECT sender_id, total_messages, valid_requests, invalid_requests, alerts_sent,
        {stamp('first_seen')} AS first_seen, {stamp('last_alert_time')} AS last_alert_time FROM sender_stats_v""", "sender_stats_v")
    out["reputation"] = with_views("SELECT sender_id, reputation_score FROM reputation_v", "reputation_v")
    walk = """SELECT sender_id, message_id, ts, is_valid, list_reduce(list_prepend(CAST(50 AS DOUBLE), list(
        CASE WHEN is_valid THEN 2.0 ELSE -1.0 END::DOUBLE) OVER (PARTITION BY sender_id ORDER BY ts, message_id)),
        lambda x, s: CASE WHEN s > 0 THEN least(100.0::DOUBLE, x + s) ELSE greatest(0.0::DOUBLE, x + s) END) AS reputation
        FROM activity"""
    out["running_reputation"] = with_views(
        "SELECT sender_id, message_id, reputation FROM walk", "activity", extra={"walk": walk})
    out["cooldown_gate"] = with_views("""SELECT sender_id, message_id, CAST(allowed AS INT) AS allowed FROM (
        SELECT sender_id, unnest(list_reduce(list_prepend(
            {'last': CAST(NULL AS DOUBLE), 'm': CAST(0 AS BIGINT), 'cool': CAST(0 AS DOUBLE), 'out': CAST([] AS STRUCT(message_id BIGINT, allowed BOOLEAN)[])},
            list({'last': epoch_us(ts) / 1e6::DOUBLE, 'm': message_id,
                  'cool': greatest(30.0::DOUBLE, 129600.0::DOUBLE * (1.0 - reputation / 200.0)),
                  'out': CAST([] AS STRUCT(message_id BIGINT, allowed BOOLEAN)[])} ORDER BY ts, message_id)),
            lambda a, x: CASE WHEN a.last IS NULL OR x.last - a.last >= x.cool
              THEN {'last': x.last, 'm': x.m, 'cool': x.cool, 'out': list_append(a.out, {'message_id': x.m, 'allowed': TRUE})}
              ELSE {'last': a.last, 'm': x.m, 'cool': x.cool, 'out': list_append(a.out, {'message_id': x.m, 'allowed': FALSE})} END
            ).out, recursive := TRUE) FROM walk WHERE is_valid GROUP BY sender_id)""", "activity", extra={"walk": walk})
    out["account_stats"] = with_views("""SELECT account_name, count(*) AS messages_processed,
        count(*) FILTER (event_type = 'purchase') AS alerts_sent, count(*) FILTER (event_type = 'error' OR failed) AS errors,
        count(*) FILTER (failed) AS send_errors, count(*) FILTER (message_id % 3 = 0) AS media_processed,
        count(*) FILTER (message_id % 7 = 0) AS queue_processed, count(*) FILTER (event_type <> 'view') AS decisions_count,
        strftime(max(ts) FILTER (event_type = 'purchase'), '%Y-%m-%d %H:%M:%S.%f') AS last_alert_time,
        count(*) FILTER (event_type = 'view') AS duplicates, count(*) FILTER (event_type = 'click') AS rate_limited,
        count(*) FILTER (event_type <> 'view' AND decision = 'accept') AS accepted,
        count(*) FILTER (event_type <> 'view' AND decision = 'review') AS reviewed,
        count(*) FILTER (event_type <> 'view' AND decision = 'ignore') AS ignored,
        round(avg(confidence) FILTER (event_type <> 'view'), 2) AS avg_confidence FROM (SELECT *,
        event_type NOT IN ('purchase', 'error', 'view', 'click') AND chat_id < 5 AS failed FROM activity) GROUP BY account_name""", "activity")

    # backlog
    ranked = "SELECT *, row_number() OVER (ORDER BY priority DESC, created_at DESC, id DESC) AS rn FROM backlog_v"
    row = f"SELECT id, priority, {stamp('created_at')} AS created_at FROM"
    out["cap_backlog"] = with_views(f"{row} ({ranked}) WHERE rn <= 1000", "backlog_v")
    out["evicted_backlog"] = with_views(f"{row} ({ranked}) WHERE rn > 1000", "backlog_v")
    out["drain_order"] = with_views(
        f"{row} (SELECT * FROM backlog_v ORDER BY priority DESC, created_at, id LIMIT 500)", "backlog_v")
    out["schedule_retries"] = with_views("""SELECT 'retry' AS kind, id, chat_id, message_id, retry_count + 1 AS attempt,
          CAST(least(pow(2, retry_count), 60) AS INT) AS delay_seconds, length(error_text) AS error_chars FROM failures_v
          WHERE retry_count < 5 QUALIFY row_number() OVER (PARTITION BY chat_id, message_id ORDER BY ts, id) = 1
        UNION ALL SELECT 'dead', id, chat_id, message_id, retry_count, 0, length(error_text) FROM failures_v
          WHERE retry_count >= 5""", "failures_v")
    out["dead_letter_view"] = with_views(f"""SELECT id, error_text, retry_count, 0 AS resolved, {stamp('created_at')} AS created_at,
        CAST(chat_id AS VARCHAR) AS chat_id, CAST(message_id AS VARCHAR) AS message_id, account_name FROM (
        SELECT * FROM dead_letters_v WHERE NOT resolved ORDER BY created_at, id LIMIT 100)""", "dead_letters_v")
    out["requeue_dead_letters"] = with_views("""SELECT 'queued' AS kind, id, 1 AS priority FROM dead_letters_v
          WHERE retry_count <> 2 AND NOT resolved AND retry_count + 1 <= 5
        UNION ALL SELECT CASE WHEN resolved OR (retry_count <> 2 AND retry_count + 1 > 5) THEN 'closed' ELSE 'open' END, id,
          CASE WHEN retry_count <> 2 AND NOT resolved AND retry_count + 1 <= 5 THEN retry_count + 1 ELSE retry_count END
          FROM dead_letters_v""", "dead_letters_v")
    out["prune_dead_letters"] = with_views(f"""SELECT id, {stamp('created_at')} AS created_at FROM (SELECT * FROM dead_letters_v
        WHERE NOT resolved AND created_at >= TIMESTAMP '{NOW}' - INTERVAL 20 DAY)""",
        "dead_letters_v")
    out["retain"] = with_views(f"""SELECT message_hash, {stamp('ts')} AS ts FROM activity
        WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY""", "activity")

    # query surface
    def listed(source: str, *columns: str) -> str:
        return (f"SELECT message_hash, sender_id, {stamp('ts')} AS ts, username, first_name, {', '.join(columns)} "
                f"FROM ({source}) {contacts}")
    newest = "ORDER BY ts DESC, message_hash DESC"
    out["search_messages"] = with_views(listed(f"""SELECT * FROM activity WHERE contains(lower(message_text), 'error') AND
        ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-28 12:00:00' {newest} LIMIT 50 OFFSET 25""", "message_text"),
        "activity", "contacts_v")
    out["search_alerts"] = with_views(listed(f"""SELECT * FROM alerts_v WHERE contains(lower(keyword), 'purch') AND
        account_name = 'acct_2' AND decision = 'accept' AND confidence >= 0.3 {newest} LIMIT 40 OFFSET 10""", "keyword", "decision"),
        "alerts_v", "contacts_v")
    out["alerts_in_category"] = with_views("""SELECT message_hash, keyword FROM alerts_v WHERE
        (SELECT count(*) FROM kinds WHERE n % 2 = 0) = 0 OR keyword IN (SELECT event_type FROM kinds WHERE n % 2 = 0)""",
        "alerts_v", extra={"kinds": "SELECT event_type, count(*) AS n FROM events GROUP BY 1"})
    out["search_category"] = with_views(listed(f"""SELECT * FROM alerts_v WHERE account_name = 'acct_3' AND sender_id = 8 AND confidence >= 0.1
        AND ((SELECT count(*) FROM kinds WHERE n % 2 = 1) = 0 OR keyword IN (SELECT event_type FROM kinds WHERE n % 2 = 1))
        {newest} LIMIT 30 OFFSET 5""", "keyword", "decision"),
        "alerts_v", "contacts_v", extra={"kinds": "SELECT event_type, count(*) AS n FROM events GROUP BY 1"})
    out["hourly_stats"] = with_views(f"""SELECT {stamp("date_trunc('hour', ts)::TIMESTAMP")} AS hour, count(*) AS messages_count,
        count(keyword) AS alerts_count, count(*) FILTER (decision = 'accept') AS accepted_count,
        round(avg(CASE WHEN confidence > 0 THEN confidence END), 9) AS avg_confidence FROM activity
        WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY 1""", "activity")
    out["top_keywords"] = with_views("""SELECT keyword, count(*) AS n FROM alerts_v GROUP BY keyword
        ORDER BY n DESC, keyword LIMIT 3""", "alerts_v")
    out["top_senders"] = with_views("""SELECT sender_id, total_messages, alerts_count, username, first_name, reputation_score FROM (
        SELECT sender_id, count(*) AS total_messages, count(keyword) AS alerts_count FROM activity GROUP BY sender_id
        ORDER BY total_messages DESC, sender_id LIMIT 20) LEFT JOIN contacts_v USING (sender_id)
        LEFT JOIN reputation_v USING (sender_id)""", "activity", "contacts_v", "reputation_v")
    avg_conf = "avg(CASE WHEN confidence > 0 THEN confidence END)"
    out["dashboard_summary"] = with_views(f"""SELECT (SELECT count(*) FROM activity) AS total_messages,
        (SELECT count(DISTINCT sender_id) FROM activity) AS unique_senders,
        (SELECT count(DISTINCT chat_id) FROM activity) AS unique_chats, (SELECT count(*) FROM alerts_v) AS total_alerts,
        (SELECT count(*) FROM alerts_v WHERE decision = 'accept') AS accepted_count,
        (SELECT count(*) FROM alerts_v WHERE decision = 'review') AS reviewed_count,
        (SELECT count(*) FROM alerts_v WHERE decision = 'ignore') AS ignored_count,
        (SELECT round({avg_conf}, 6) FROM alerts_v) AS avg_confidence,
        (SELECT round(avg(reputation_score), 6) FROM reputation_v) AS avg_reputation,
        (SELECT count(*) FROM blocked_senders_v) AS blocked_senders""",
        "activity", "alerts_v", "reputation_v", "blocked_senders_v")
    since = "TIMESTAMP '2024-01-30 11:00:00'"
    out["activity_stats"] = with_views(f"""SELECT (SELECT count(DISTINCT sender_id) FROM activity) AS unique_senders,
        (SELECT count(DISTINCT chat_id) FROM activity) AS unique_chats,
        (SELECT count(*) FROM activity WHERE ts > {since}) AS messages_last_hour,
        (SELECT count(*) FROM alerts_v WHERE ts > {since}) AS alerts_last_hour,
        (SELECT count(*) FROM alerts_v WHERE decision = 'accept') AS decision_accept,
        (SELECT count(*) FROM alerts_v WHERE decision = 'review') AS decision_review,
        (SELECT count(*) FROM alerts_v WHERE decision NOT IN ('accept', 'review')) AS decision_other,
        (SELECT round({avg_conf}, 2) FROM alerts_v) AS avg_confidence,
        (SELECT round(avg(reputation_score), 2) FROM reputation_v) AS avg_reputation,
        (SELECT count(*) FROM blocked_senders_v) AS blocked_senders""", "activity", "alerts_v", "reputation_v", "blocked_senders_v")
    out["recent_alerts"] = with_views(listed(f"SELECT * FROM alerts_v {newest} LIMIT 10", "keyword"), "alerts_v", "contacts_v")
    out["recent_messages"] = with_views(listed(f"SELECT * FROM activity {newest} LIMIT 10", "message_text"),
                                        "activity", "contacts_v")
    out["new_by_key"] = with_views(f"""SELECT message_hash, 0 AS copy, {stamp('ts')} AS ts FROM activity
        WHERE keyword IS NULL""", "activity")
    out["alert_export"] = with_views(f"""SELECT message_hash AS id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS time, sender_id,
        first_name AS sender_name, username, chat_id, account_name AS account, keyword, decision,
        round(confidence, 6) AS confidence, substr(alert_text, 1, 200) AS text, last_message_link AS message_link
        FROM alerts_v {contacts}""", "alerts_v", "contacts_v")

    # monitoring
    out["latency_percentiles"] = with_views("""SELECT key, round(quantile_disc(value, 0.5), 3) AS p50,
        round(quantile_disc(value, 0.95), 3) AS p95, round(quantile_disc(value, 0.99), 3) AS p99,
        round(avg(value), 3) AS mean, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY key
        ORDER BY ts DESC, id DESC) AS rn FROM samples_v) WHERE rn <= 2000 GROUP BY key""", "samples_v")
    out["zscore_anomalies"] = with_views("""SELECT key, id, round(CASE WHEN n >= 30 THEN m * n ELSE value END, 4) AS prior_sum,
        round(sd, 6) AS std, round(z, 6) AS z_score, n AS sample_size, CAST(abs(z) >= 3.5 AS INT) AS is_anomaly FROM (
        SELECT *, CASE WHEN sd > 0 THEN (value - m) / sd ELSE 0.0 END AS z FROM (
        SELECT *, CASE WHEN n >= 30 THEN coalesce(sd0, 0.0) ELSE 0.0 END AS sd FROM (SELECT *, count(*) OVER w AS n, avg(value) OVER w AS m,
        stddev_pop(value) OVER w AS sd0 FROM samples_v
        WINDOW w AS (PARTITION BY key ORDER BY ts, id ROWS BETWEEN 2000 PRECEDING AND 1 PRECEDING))))""", "samples_v")
    out["rolling_mean"] = with_views("""SELECT key, id, round(avg(value) OVER (PARTITION BY key ORDER BY ts, id
        ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 9) AS rolling_mean FROM samples_v""", "samples_v")
    out["sustained_growth"] = with_views("""SELECT key, id, baseline, peak, CAST(up AS INT) AS elevated,
        CAST(count(*) OVER w3 = 3 AND bool_and(up) OVER w3 AND bool_and(held) OVER w2 AS INT) AS growing FROM (
        SELECT *, value > baseline * 1.2::DOUBLE AS up, coalesce(value >= prev * 0.5::DOUBLE, FALSE) AS held FROM (
        SELECT *, first_value(value) OVER w AS baseline, max(value) OVER w AS peak, lag(value) OVER w AS prev FROM samples_v
        WINDOW w AS (PARTITION BY key ORDER BY ts, id)))
        WINDOW w3 AS (PARTITION BY key ORDER BY ts, id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW),
        w2 AS (PARTITION BY key ORDER BY ts, id ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)""", "samples_v")
    out["health_rollup"] = with_views(f"""SELECT {stamp('check_time')} AS check_time, up AS monitors_up, total AS monitors_total,
        CAST(healthy AS INT) AS healthy, CASE WHEN healthy THEN 0 ELSE rn - coalesce(max(CASE WHEN healthy THEN rn END)
        OVER (ORDER BY rn), 0) END AS consecutive_unhealthy, CASE WHEN hour(check_time) > 5 THEN n END AS queue_size,
        CAST(hour(check_time) <= 5 OR n < 14 AS INT) AS queue_ok FROM (
        SELECT *, db AND mc AND up >= greatest(1.0, total * 0.5) AS healthy, row_number() OVER (ORDER BY check_time) AS rn FROM (
        SELECT count(*) AS n, check_time::TIMESTAMP AS check_time, coalesce(bool_or(ok) FILTER (component = 'purchase'), FALSE) AS db,
        coalesce(bool_or(ok) FILTER (component = 'signup'), FALSE) AS mc,
        count(*) FILTER (ok AND component NOT IN ('purchase', 'signup')) AS up,
        count(*) FILTER (component NOT IN ('purchase', 'signup')) AS total FROM health_v GROUP BY check_time))""", "health_v")

    # lexicon maintenance
    out["lexicon_index"] = with_views("""SELECT category, sum(count(*)) OVER (PARTITION BY category) AS total, path, grp AS label,
        count(*) AS n, string_agg(term, '|' ORDER BY pos) AS items FROM lexicon_v GROUP BY category, path, grp""", "lexicon_v")
    out["lexicon_search"] = with_views("""SELECT path, term FROM lexicon_v WHERE contains(lower(term), 'red w')
        ORDER BY ord, path, pos""", "lexicon_v")
    out["apply_lexicon_edits"] = with_views("""SELECT path, unnest(range(len(v[1]))) AS pos, unnest(v[1]) AS term FROM edited WHERE v[1] IS NOT NULL""",
                                            "lexicon_v", "edits_v", extra={"edited": EDITED})
    out["lexicon_edit_statuses"] = with_views("""SELECT path, split_part(x, ' ', 1)::BIGINT AS seq, split_part(x, ' ', 2) AS status
        FROM (SELECT path, unnest(v[2]) AS x FROM edited)""", "lexicon_v", "edits_v", extra={"edited": EDITED})
    out["export_lexicon"] = with_views("""SELECT category, line_no, CASE WHEN term IS NULL THEN ']}}'
          WHEN line_no = 0 THEN '{"' || category || '": {"' || grp || '": ["' || term || '"'
          WHEN grp = last THEN ', "' || term || '"' ELSE '], "' || grp || '": ["' || term || '"' END AS line
        FROM (SELECT *, row_number() OVER w - 1 AS line_no, lag(grp) OVER w AS last
          FROM (SELECT category, grp, ord, pos, term FROM lexicon_v UNION ALL SELECT DISTINCT category, NULL, NULL, NULL, NULL FROM lexicon_v)
          WINDOW w AS (PARTITION BY category ORDER BY ord NULLS LAST, pos))""", "lexicon_v")
    return out
