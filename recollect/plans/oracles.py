"""The same results in SQL, for the engine that checks them."""

from __future__ import annotations

from recollect import config


def _quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


ACKS = _quoted(config.ACK_WORDS)
PREFIXES = "|".join(config.QUESTION_PREFIXES)
HINTS = "|".join(config.SELF_FACT_HINTS)


def raw_conversations() -> str:
    return r"""
raw AS (
  SELECT 'conv_' || conv_id AS chat_name,
    TIMESTAMP '2024-01-01' + to_days(conv_id::INT) + to_minutes((turn*15*(1+conv_id%4) + CASE WHEN conv_id%3=0 THEN 0 ELSE 50*(turn//3) END)::BIGINT) AS "timestamp",
    turn AS seq, role AS sender,
    CASE WHEN (conv_id+turn)%11=0 THEN 'ok' ELSE trim(regexp_replace(text, '\s+', ' ', 'g')) || CASE WHEN turn%4=0 THEN '?' ELSE '' END || CASE WHEN conv_id%5=0 AND turn%3=1 THEN ' https://ex.test/a' ELSE '' END END AS text
  FROM conversations)"""


def raw_events() -> str:
    return """
raw AS (SELECT 'user_' || user_id AS chat_name, ts AS "timestamp", event_id AS seq, event_type AS sender, event_type || ' ' || props AS text FROM events)"""


def labelled(owner: str) -> str:
    return rf"""
flags AS (
  SELECT chat_name, "timestamp", seq, sender, lower(sender) AS sender_key, sender = '{owner}' AS is_me, text AS text_raw, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM raw),
marked AS (
  SELECT *, regexp_matches(text, '(?i)(https?://|www\.)') AS has_url,
    contains(text, '?') OR regexp_matches(lower(text), '^({PREFIXES}) ') AS is_question,
    lower(text) IN ({ACKS}) OR length(text) <= 2 OR NOT regexp_matches(lower(text), '[\p{{L}}\p{{N}}]') AS is_low_signal,
    len(string_split(text, ' '))::INT AS token_len,
    is_me AND regexp_matches(lower(text), '{HINTS}') AS self_fact
  FROM flags WHERE length(text) > 0),
scored AS (
  SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, least(1.0::DOUBLE, token_len/12.0::DOUBLE) + CASE WHEN length(text) >= 80 THEN 0.10::DOUBLE ELSE 0 END + CASE WHEN is_question THEN 0.05::DOUBLE ELSE 0 END - CASE WHEN has_url THEN 0.10::DOUBLE ELSE 0 END)) AS signal_score FROM marked),
m AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY chat_name, "timestamp", sender, text ORDER BY seq) AS rn FROM scored) WHERE rn = 1)"""


def messages() -> str:
    return raw_conversations() + "," + labelled("assistant")


def events() -> str:
    return raw_events() + "," + labelled("purchase")


def style(column: str) -> str:
    b = f"trim(regexp_replace({column}, '\\s+', ' ', 'g'))"
    n = f"len(string_split({b}, ' '))"
    return f"""CASE WHEN length({b}) = 0 THEN 'empty' ELSE CASE WHEN {n} <= 2 THEN 'tiny' WHEN {n} <= 6 THEN 'short' WHEN {n} <= 14 THEN 'mid' ELSE 'long' END
    || '|q' || CASE WHEN ends_with({b}, '?') THEN '1' ELSE '0' END || '|e' || CASE WHEN ends_with({b}, '!') THEN '1' ELSE '0' END
    || CASE WHEN length(regexp_replace({b}, '[^\\p{{Lu}}]', '', 'g')) / greatest(1, length(regexp_replace({b}, '[^\\p{{L}}]', '', 'g')))::DOUBLE > 0.35 THEN '|caps' ELSE '|normal' END END"""


def template(text: str, *columns: str) -> str:
    parts = text.split("%s")
    quoted = ["'" + p.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for p in parts]
    out = quoted[0]
    for c, q in zip(columns, quoted[1:], strict=True):
        out += f" || coalesce({c}, '') || {q}"
    return out


_SAID = "string_agg(sender || ': ' || text, chr(10))"
_CHAT = 'PARTITION BY chat_name ORDER BY "timestamp", seq'


def qa(context: int = 4, gap: int = 30, question: bool = False) -> str:
    return f"""
qw AS (
  SELECT *, row_number() OVER ({_CHAT}) - 1 AS pos, {_SAID} OVER ctx AS context,
    last_value(CASE WHEN NOT is_me THEN text END IGNORE NULLS) OVER ctx AS other_text,
    last_value(CASE WHEN NOT is_me THEN sender END IGNORE NULLS) OVER ctx AS other_sender,
    last_value(CASE WHEN NOT is_me THEN "timestamp" END IGNORE NULLS) OVER ctx AS other_ts,
    coalesce(max((is_question AND NOT is_me)::INT) OVER ctx, 0) AS asked
  FROM m WINDOW ctx AS ({_CHAT} ROWS BETWEEN {context} PRECEDING AND 1 PRECEDING)),
qa AS (
  SELECT 'qa_turn' AS unit_type, chat_name, "timestamp", context, other_text AS partner_text, other_sender AS partner_sender,
    (epoch_us("timestamp") - epoch_us(other_ts)) / 60000000.0::DOUBLE AS reply_gap_min, text AS response, text AS style_text, {style("text")} AS style_signature,
    signal_score, self_fact, {template(config.QA_TEXT, "other_text", "context", "text")} AS embed_text, 'qa::' || chat_name || '::' || pos AS source_id
  FROM qw WHERE is_me AND NOT is_low_signal AND pos > 0 AND other_ts IS NOT NULL AND "timestamp" - other_ts <= INTERVAL {gap} MINUTE{" AND asked = 1" if question else ""})"""


def own(window: int = 2) -> str:
    return f"""
ow AS (
  SELECT *, row_number() OVER ({_CHAT}) - 1 AS pos, {_SAID} OVER around AS context,
    last_value(CASE WHEN NOT is_me THEN text END IGNORE NULLS) OVER before AS other_text,
    last_value(CASE WHEN NOT is_me THEN sender END IGNORE NULLS) OVER before AS other_sender
  FROM m WINDOW around AS ({_CHAT} ROWS BETWEEN {window} PRECEDING AND {window} FOLLOWING), before AS ({_CHAT} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
own AS (
  SELECT 'my_message' AS unit_type, chat_name, "timestamp", context, coalesce(other_text, '') AS partner_text, coalesce(other_sender, '') AS partner_sender,
    NULL::DOUBLE AS reply_gap_min, text AS response, text AS style_text, {style("text")} AS style_signature, signal_score, self_fact,
    {template(config.MESSAGE_TEXT, "other_text", "text", "context")} AS embed_text, 'msg::' || chat_name || '::' || pos AS source_id
  FROM ow WHERE is_me AND NOT is_low_signal)"""


def topics(gap: int = 45) -> str:
    return f"""
tp AS (
  SELECT *, sum(CASE WHEN prev IS NULL OR "timestamp" - prev > INTERVAL {gap} MINUTE THEN 1 ELSE 0 END) OVER ({_CHAT}) - 1 AS topic
  FROM (SELECT *, lag("timestamp") OVER ({_CHAT}) AS prev FROM m))"""


def blocks(per_topic: int = 120, total: int = 250_000) -> str:
    one = lambda size: f"""SELECT chat_name, topic, start, n, {size} AS size, avg(signal_score) OVER w AS signal, {_SAID} OVER w AS lines, max(self_fact::INT) OVER w = 1 AS fact, last_value("timestamp") OVER w AS ended
  FROM tb WINDOW w AS (PARTITION BY chat_name, topic ORDER BY "timestamp", seq ROWS BETWEEN CURRENT ROW AND {size - 1} FOLLOWING)"""  # noqa: E731
    return f"""
tb AS (SELECT *, row_number() OVER (PARTITION BY chat_name, topic ORDER BY "timestamp", seq) - 1 AS start, count(*) OVER (PARTITION BY chat_name, topic) AS n FROM tp),
bs AS ({" UNION ALL ".join(one(x) for x in (3, 5, 8))}),
bf AS (
  SELECT *, row_number() OVER (PARTITION BY chat_name, topic ORDER BY start, size) AS in_topic FROM bs
  WHERE start % (CASE WHEN n < 200 THEN 2 WHEN n < 2000 THEN 6 ELSE 12 END) = 0 AND start + size <= n AND signal >= 0.15),
bk AS (
  SELECT *, row_number() OVER (ORDER BY chat_name, topic, start, size) AS in_all FROM bf WHERE in_topic <= {per_topic}),
blk AS (
  SELECT 'topic_block' AS unit_type, chat_name, ended AS "timestamp", lines AS context, '' AS partner_text, '' AS partner_sender, NULL::DOUBLE AS reply_gap_min, '' AS response, '' AS style_text,
    'block' AS style_signature, signal AS signal_score, fact AS self_fact, {template(config.BLOCK_TEXT, "lines")} AS embed_text, 'blk::' || chat_name || '::' || topic || '::' || start || '::' || (start + size) AS source_id
  FROM bk WHERE in_all <= {total})"""


UNIT = 'unit_type, chat_name, "timestamp", context, partner_text, partner_sender, round(reply_gap_min, 6) AS reply_gap_min, response, style_text, style_signature, round(signal_score, 6) AS signal_score, self_fact, embed_text, source_id'


def units() -> str:
    return messages() + "," + qa() + "," + own() + "," + topics() + "," + blocks() + ",\nun AS (SELECT * FROM qa UNION ALL SELECT * FROM own UNION ALL SELECT * FROM blk)"


def vectors() -> str:
    return """
vu AS (
  SELECT vec_id, embedding::DOUBLE[] AS v, 'u' || (vec_id%400) AS source_id, ts AS "timestamp", 'user_' || user_id AS chat_name, CASE WHEN vec_id%10=0 THEN 0.0::DOUBLE ELSE (vec_id%100)/100.0::DOUBLE END AS signal_score,
    CASE WHEN vec_id%7=0 THEN NULL ELSE value END AS reply_gap_min, label AS style_cluster, 'cluster ' || label || ' text ' || (vec_id%37) AS style_text
  FROM embeddings JOIN events ON vec_id = event_id),
sims AS (
  SELECT q.vec_id AS qid, u.*, list_inner_product(q.embedding::DOUBLE[], u.v) AS score FROM vu u, embeddings q WHERE q.vec_id % 50 = 0),
newest AS (SELECT max("timestamp") AS newest FROM vu)"""


def near(k: int) -> str:
    return f"top_{k} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, vec_id) AS rank FROM sims) WHERE rank <= {k})"


def reranked(role: str, k: int, least: float) -> str:
    signal, alpha, extra = ("0.08", "0.05", 'CASE WHEN reply_gap_min IS NULL THEN 0 ELSE greatest(0.0::DOUBLE, 0.03::DOUBLE - least(reply_gap_min, 120.0::DOUBLE) * 0.00025::DOUBLE) END') if role == "response" else ("0.07", "0.04", "least(0.04::DOUBLE, len(string_split(style_text, ' ')) / 400.0::DOUBLE)")
    return f"""{role}_ranked AS (
  SELECT *, score + {signal}::DOUBLE * (CASE WHEN signal_score = 0 THEN 0.4::DOUBLE ELSE signal_score END)
    + greatest(0.0::DOUBLE, {alpha}::DOUBLE - greatest(date_sub('day', "timestamp", newest), 0) * 0.001::DOUBLE) + {extra} AS rank_score, '{role}' AS retrieval_role
  FROM top_{k}, newest WHERE round(score, 9) >= {least})"""


_ORDER = "round(rank_score, 9) DESC, round(score, 9) DESC"


def per_source(k: int) -> str:
    return f"""response_hits AS (
  SELECT * EXCLUDE (own) FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY {_ORDER}, source_id, vec_id) AS rn FROM (
    SELECT *, row_number() OVER (PARTITION BY qid, source_id ORDER BY {_ORDER}, vec_id) AS own FROM response_ranked) WHERE own = 1) WHERE rn <= {k})"""


def robin(k: int) -> str:
    """Right where no text is in two clusters."""
    return f"""style_hits AS (
  SELECT * EXCLUDE (round_no, lead, first_in_text, o) FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round_no, lead) AS rn FROM (
    SELECT *, row_number() OVER (PARTITION BY qid, style_cluster ORDER BY o) AS round_no, min(o) OVER (PARTITION BY qid, style_cluster) AS lead FROM (
      SELECT *, row_number() OVER (PARTITION BY qid, style_text ORDER BY o) AS first_in_text FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY {_ORDER}, vec_id) AS o FROM style_ranked)) WHERE first_in_text = 1)) WHERE rn <= {k})"""
