"""Registered queries and, next to each, the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.config import Settings
from recollect.functions import text as fn
from recollect.operators import embed, messages, safety, search, units
from recollect.plans import adapters as a
from recollect.plans import oracles as o
from recollect.sources import chats, state
from recollect.streaming import topics as streaming

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def registered(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _units(df: DataFrame) -> DataFrame:
    return _rounded(df, "reply_gap_min", "signal_score")


# -- messages ---------------------------------------------------------------------------------------------


@registered("WITH " + o.messages() + ' SELECT chat_name, "timestamp", seq, sender, text FROM m')
def q_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.clean_conversations(spark, sf_dir).select("chat_name", "timestamp", "seq", "sender", "text")


@registered("WITH " + o.messages() + f" SELECT chat_name, seq, sender_key, is_me, has_url, is_question, is_low_signal, token_len, self_fact, round(signal_score, 6) AS signal_score, {o.style('text')} AS style_signature FROM m")
def q_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = a.clean_conversations(spark, sf_dir)
    return m.select("chat_name", "seq", "sender_key", "is_me", "has_url", "is_question", "is_low_signal", "token_len", "self_fact", F.round("signal_score", 6).alias("signal_score"), fn.style_signature(F.col("text")).alias("style_signature"))


@registered(
    "WITH raw AS (SELECT doc_id::VARCHAR AS chat_name, TIMESTAMP '2024-01-01' AS \"timestamp\", doc_id AS seq, 'a' AS sender, text FROM documents), "
    + o.labelled("a")
    + " SELECT seq AS doc_id, has_url, is_question, is_low_signal, token_len, self_fact, round(signal_score, 6) AS signal_score FROM m"
)
def q_document_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = a.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), "text", F.lit(True).alias("is_me"))
    return messages.with_labels(raw).select(F.col("seq").alias("doc_id"), "has_url", "is_question", "is_low_signal", "token_len", "self_fact", F.round("signal_score", 6).alias("signal_score"))


@registered("WITH " + o.messages() + f", s AS (SELECT {o.style('text')} AS style_signature FROM m WHERE is_me), c AS (SELECT style_signature, count(*) AS n FROM s GROUP BY 1) SELECT style_signature, n FROM c ORDER BY n DESC, style_signature LIMIT 10")
def q_style_signature_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = a.clean_conversations(spark, sf_dir).where("is_me").select(fn.style_signature(F.col("text")).alias("style_signature"))
    return own.groupBy("style_signature").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "style_signature").limit(10)


@registered("WITH " + o.raw_conversations() + ", two AS (SELECT * FROM raw UNION ALL SELECT * REPLACE (seq + 1000 AS seq) FROM raw) SELECT chat_name, \"timestamp\", sender, text, min(seq) AS seq FROM two GROUP BY ALL")
def q_dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = a.conversation_messages(spark, sf_dir)
    two = m.unionByName(m.withColumn("seq", F.col("seq") + 1000))
    return messages.first_of_duplicates(two).select("chat_name", "timestamp", "sender", "text", "seq")


@registered(
    "WITH "
    + o.raw_conversations()
    + """, cov AS (SELECT lower(sender) AS k, count(DISTINCT chat_name) AS chats FROM raw GROUP BY 1), top AS (SELECT k, chats FROM cov ORDER BY chats DESC, k LIMIT 1),
n AS (SELECT count(DISTINCT chat_name) AS total FROM raw), best AS (SELECT sender, count(*) AS c FROM raw, top WHERE lower(sender) = k GROUP BY 1 ORDER BY c DESC, sender LIMIT 1),
often AS (SELECT sender, count(*) AS c FROM raw GROUP BY 1 ORDER BY c DESC, sender LIMIT 1)
SELECT CASE WHEN total >= 2 AND chats >= greatest(2, total // 2) THEN best.sender ELSE often.sender END AS owner, CASE WHEN total >= 2 AND chats >= greatest(2, total // 2) THEN 'inferred_chat_coverage' ELSE 'inferred_top_count' END AS how FROM top, n, best, often"""
)
def q_owner_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    owner, how = messages.resolve_owner(messages.with_sender(a.conversation_messages(spark, sf_dir)), "Tu Nombre")
    return spark.createDataFrame([(owner, how)], "owner string, how string")


@registered("SELECT lower(event_type) AS sender_key, count(DISTINCT user_id) AS chats, count(*) AS messages FROM events GROUP BY 1")
def q_sender_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.sender_coverage(messages.with_sender(a.event_messages(spark, sf_dir)))


@registered("WITH " + o.messages() + ' SELECT count(*) AS n, min("timestamp") AS ts_min, max("timestamp") AS ts_max FROM m')
def q_corpus_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.fingerprint(a.clean_conversations(spark, sf_dir)).select("n", "ts_min", "ts_max")


@registered("WITH " + o.messages() + " SELECT count(*) AS n, count(*) FILTER (is_me) AS own FROM m")
def q_owner_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.owner_counts(a.clean_conversations(spark, sf_dir))


# -- units ------------------------------------------------------------------------------------------------


@registered("WITH " + o.messages() + "," + o.qa() + f" SELECT {o.UNIT} FROM qa")
def q_qa_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _units(units.qa_turns(a.clean_conversations(spark, sf_dir)))


@registered("WITH " + o.messages() + "," + o.qa(question=True) + f" SELECT {o.UNIT} FROM qa")
def q_qa_turns_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _units(units.qa_turns(a.clean_conversations(spark, sf_dir), Settings(require_question=True)))


@registered("WITH " + o.messages() + "," + o.own() + f" SELECT {o.UNIT} FROM own")
def q_my_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _units(units.own_messages(a.clean_conversations(spark, sf_dir)))


@registered("WITH " + o.messages() + "," + o.topics() + " SELECT chat_name, seq, topic::INT AS topic FROM tp")
def q_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.with_topics(a.clean_conversations(spark, sf_dir), 45).select("chat_name", "seq", "topic")


@registered("WITH " + o.events() + "," + o.topics(720) + " SELECT chat_name, seq, topic::INT AS topic FROM tp")
def q_event_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.with_topics(messages.first_of_duplicates(a.clean_events(spark, sf_dir)), 720).select("chat_name", "seq", "topic")


@registered("WITH " + o.raw_events() + ", m AS (SELECT * FROM raw)," + o.topics(720) + ' SELECT chat_name, min("timestamp") AS begun, max("timestamp") AS ended, count(*) AS n FROM tp GROUP BY chat_name, topic')
def q_topic_session_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = streaming.streamed_topics(a.event_messages(spark, sf_dir), 720)
    return t.select("chat_name", F.col("begun").cast("timestamp_ntz").alias("begun"), F.col("ended").cast("timestamp_ntz").alias("ended"), "n")


@registered("WITH " + o.messages() + "," + o.topics() + "," + o.blocks() + f" SELECT {o.UNIT} FROM blk")
def q_topic_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _units(units.topic_blocks(a.clean_conversations(spark, sf_dir)))


@registered("WITH " + o.events() + "," + o.topics(720) + "," + o.blocks(4, 500) + f" SELECT {o.UNIT} FROM blk")
def q_block_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages.first_of_duplicates(a.clean_events(spark, sf_dir))
    return _units(units.topic_blocks(m, Settings(topic_gap_minutes=720, blocks_per_topic=4, blocks_total=500)))


@registered("WITH " + o.units() + f" SELECT {o.UNIT} FROM un")
def q_memory_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _units(units.memory_units(a.clean_conversations(spark, sf_dir)))


_RESPONSE = f"{o.template(o.config.RESPONSE_TEXT, 'partner_text', 'context', 'response')}"
_STYLE = f"{o.template(o.config.STYLE_TEXT, 'style_text', 'context')}"


@registered("WITH " + o.units() + f" SELECT {o.UNIT}, {_RESPONSE} AS response_embed_text, 'response' AS retrieval_role FROM un WHERE unit_type = 'qa_turn' AND length(partner_text) >= 1 AND length(response) >= 2")
def q_response_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _units(units.response_units(units.memory_units(a.clean_conversations(spark, sf_dir))))


@registered("WITH " + o.units() + f" SELECT {o.UNIT}, {_STYLE} AS style_embed_text, 'style' AS retrieval_role FROM un WHERE unit_type IN ('qa_turn', 'my_message') AND length(style_text) >= 2 AND len(string_split(style_text, ' ')) <= 60")
def q_style_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _units(units.style_units(units.memory_units(a.clean_conversations(spark, sf_dir))))


@registered("WITH " + o.messages() + "," + o.qa() + " SELECT source_id, sha256('1||' || source_id || '||' || chat_name || '||' || strftime(\"timestamp\", '%Y-%m-%d %H:%M:%S') || '||' || embed_text) AS unit_hash FROM qa")
def q_unit_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.with_unit_hash(units.qa_turns(a.clean_conversations(spark, sf_dir)), "embed_text", "1").select("source_id", "unit_hash")


@registered("WITH " + o.units() + " SELECT unit_type, count(*) AS n FROM un GROUP BY 1")
def q_unit_type_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.memory_units(a.clean_conversations(spark, sf_dir)).groupBy("unit_type").agg(F.count("*").alias("n"))


# -- search -----------------------------------------------------------------------------------------------


@registered("WITH " + o.vectors() + "," + o.near(60) + " SELECT qid, vec_id, round(score, 6) AS score, rank::INT AS rank FROM top_60")
def q_knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(search.top_k(a.vector_units(spark, sf_dir), a.query_batch(spark, sf_dir), 60, "vec_id"), "score")


def _ranked(spark: SparkSession, sf_dir: str, role: str, k: int, least: float) -> DataFrame:
    u = a.vector_units(spark, sf_dir)
    near = search.top_k(u, a.query_batch(spark, sf_dir), k, "vec_id").join(u.drop("embedding"), "vec_id")
    return search.rerank(near, role, search.newest(u), least)


_RANKED = "qid, vec_id, source_id, round(score, 6) AS score, round(rank_score, 6) AS rank_score"


def _shown(df: DataFrame, *more: str) -> DataFrame:
    return _rounded(df.select("qid", "vec_id", "source_id", "score", "rank_score", *more), "score", "rank_score")


@registered("WITH " + o.vectors() + "," + o.near(60) + "," + o.reranked("response", 60, 0.22) + f" SELECT {_RANKED} FROM response_ranked")
def q_rerank_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_ranked(spark, sf_dir, "response", 60, 0.22))


@registered("WITH " + o.vectors() + "," + o.near(80) + "," + o.reranked("style", 80, 0.2) + f" SELECT {_RANKED} FROM style_ranked")
def q_rerank_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_ranked(spark, sf_dir, "style", 80, 0.2))


@registered("WITH " + o.vectors() + "," + o.near(60) + "," + o.reranked("response", 60, 0.22) + "," + o.per_source(6) + f" SELECT {_RANKED}, rn::INT AS rn FROM response_hits")
def q_dedup_source_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(search.first_per_source(_ranked(spark, sf_dir, "response", 60, 0.22), 6, "vec_id"), "rn")


@registered("WITH " + o.vectors() + "," + o.near(80) + "," + o.reranked("style", 80, 0.2) + "," + o.robin(8) + f" SELECT {_RANKED}, style_cluster, rn FROM style_hits")
def q_diversify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(search.round_robin(_ranked(spark, sf_dir, "style", 80, 0.2), 8, "vec_id"), "style_cluster", "rn")


_MERGE = f"""both_ AS (SELECT qid, vec_id, source_id, score, rank_score, retrieval_role FROM response_hits UNION ALL SELECT qid, vec_id, source_id, score, rank_score, retrieval_role FROM style_hits),
merged AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY {o._ORDER}, retrieval_role, vec_id) AS rn FROM both_) WHERE rn <= 10)"""


@registered("WITH " + o.vectors() + "," + o.near(60) + "," + o.reranked("response", 60, 0.22) + "," + o.per_source(5) + "," + o.near(80) + "," + o.reranked("style", 80, 0.198) + "," + o.robin(10) + "," + _MERGE + f" SELECT {_RANKED}, retrieval_role, rn::INT AS rn FROM merged")
def q_retrieve_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    response = search.first_per_source(_ranked(spark, sf_dir, "response", 60, 0.22), 5, "vec_id")
    style = search.round_robin(_ranked(spark, sf_dir, "style", 80, 0.198), 10, "vec_id")
    return _shown(search.merged(response, style, 10, "vec_id"), "retrieval_role", "rn")


@registered(
    """WITH chats AS (SELECT 'conv_' || conv_id AS chat_name, min(conv_id) AS pos FROM conversations GROUP BY 1), q AS (SELECT conv_id*10+turn AS qid, 'dime algo de CONV_' || conv_id || ' por favor' AS query FROM conversations),
h AS (SELECT qid, chat_name, row_number() OVER (PARTITION BY qid ORDER BY pos, chat_name) AS rn FROM q, chats WHERE contains(lower(query), lower(chat_name))) SELECT qid, chat_name AS contact FROM h WHERE rn = 1"""
)
def q_contact_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = a.table(spark, sf_dir, "conversations")
    names = c.groupBy(F.concat(F.lit("conv_"), "conv_id").alias("chat_name")).agg(F.min("conv_id").alias("pos")).withColumn("source", F.lit(0))
    queries = c.select((F.col("conv_id") * 10 + F.col("turn")).alias("qid"), F.concat(F.lit("dime algo de CONV_"), "conv_id", F.lit(" por favor")).alias("query"))
    return search.contact_hints(queries, names)


@registered("SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 'reuse' ELSE 'encode' END AS state FROM embeddings")
def q_embedding_cache_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = a.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    missing, reused = embed.cache_delta(e, e.where("vec_id % 3 = 0"), "vec_id")
    return missing.select("vec_id", F.lit("encode").alias("state")).unionByName(reused.select("vec_id", F.lit("reuse").alias("state")))


@registered("SELECT label AS style_cluster, count(*) AS n FROM embeddings GROUP BY 1 ORDER BY n DESC, style_cluster LIMIT 10")
def q_style_cluster_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    clusters = a.table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("style_cluster"))
    return clusters.agg(F.count("*").alias("n")).orderBy(F.desc("n"), "style_cluster").limit(10)


@registered(
    """WITH h AS (SELECT sha256(label::VARCHAR || '|' || vec_id % 1000) AS h FROM embeddings), c AS (SELECT h, count(*) AS n FROM h GROUP BY 1),
p AS (SELECT substr(h, 1, 3) AS p, sha256(string_agg(h || ':' || n, chr(10) ORDER BY h || ':' || n)) AS x FROM c GROUP BY 1) SELECT sha256('v1' || chr(10) || string_agg(p || ':' || x, chr(10) ORDER BY p || ':' || x)) AS key FROM p"""
)
def q_cluster_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = a.table(spark, sf_dir, "embeddings").select(F.sha2(F.concat_ws("|", "label", F.expr("vec_id % 1000")), 256).alias("h"))
    return embed.hash_of_hashes(hashed, "h", "v1")


@registered()
def q_kmeans_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.kmeans_labels(a.table(spark, sf_dir, "embeddings")).select("vec_id", "style_cluster")


@registered()
def q_embed_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.embed(a.table(spark, sf_dir, "documents").select("doc_id", "text"), "text", embed.HashingEncoder()).select("doc_id", "embedding")


# -- sources, state, safety -------------------------------------------------------------------------------


@registered(
    """WITH f AS (SELECT doc_id, 'f' || doc_id AS path, n_chars AS size, TIMESTAMP '2024-01-01' AS mtime FROM documents), old AS (SELECT path, size + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS size FROM f WHERE doc_id % 4 <> 0), cur AS (SELECT path, size FROM f WHERE doc_id % 7 <> 0)
SELECT coalesce(cur.path, old.path) AS path, CASE WHEN cur.path IS NULL THEN 'gone' WHEN old.path IS NULL THEN 'new' WHEN cur.size = old.size THEN 'same' ELSE 'changed' END AS state FROM cur FULL JOIN old ON cur.path = old.path"""
)
def q_manifest_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = a.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("f"), "doc_id").alias("path"), F.col("n_chars").alias("size"), F.expr("timestamp_ntz'2024-01-01 00:00:00'").alias("mtime"))
    old = f.where("doc_id % 4 <> 0").select("path", F.expr("size + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END").alias("size"), "mtime", F.lit("v1").alias("parse_tag"))
    return state.manifest_delta(f.where("doc_id % 7 <> 0").drop("doc_id"), old, "v1")


_INJECTED = "text || CASE WHEN doc_id % 7 = 0 THEN chr(10) || 'AKIA' || upper(substr(md5(doc_id::VARCHAR), 1, 16)) ELSE '' END || CASE WHEN doc_id % 11 = 0 THEN chr(10) || 'ghp_' || md5(doc_id::VARCHAR) || chr(10) || 'x' ELSE '' END"
_SECRETS = {"llm vendor key": "sk-(?:proj|live|test)-[A-Za-z0-9_-]{20,}", "code host token": "gh[pousr]_[A-Za-z0-9]{20,}", "cloud access key": "AKIA[0-9A-Z]{16}"}


def _injected(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat(F.lit("\nAKIA"), F.upper(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 16)))
    token = F.concat(F.lit("\nghp_"), F.md5(F.col("doc_id").cast("string")), F.lit("\nx"))
    return a.table(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.when(F.expr("doc_id % 7 = 0"), key).otherwise(""), F.when(F.expr("doc_id % 11 = 0"), token).otherwise("")).alias("text"))


@registered("WITH t AS (SELECT doc_id, " + _INJECTED + " AS text FROM documents) " + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS label, unnest(regexp_extract_all(text, '{p}')) AS match FROM t" for k, p in _SECRETS.items()))
def q_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return safety.scan_text(_injected(spark, sf_dir), "doc_id", "text").select("doc_id", "label", "match")


@registered("WITH t AS (SELECT doc_id, " + _INJECTED + " AS text FROM documents), l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM t) " + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS label, line::INT AS line FROM (SELECT doc_id, line, unnest(regexp_extract_all(s, '{p}')) AS x FROM l)" for k, p in _SECRETS.items()))
def q_secret_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return safety.scan_text(_injected(spark, sf_dir), "doc_id", "text").select("doc_id", "label", "line")


_ENDINGS = "CASE page_id % 12 WHEN 0 THEN '/.env' WHEN 1 THEN '/.ENV.local' WHEN 2 THEN '/.env.example' WHEN 3 THEN '/x.PEM' WHEN 4 THEN '/a.key' WHEN 5 THEN '/AGENTS.md' WHEN 6 THEN '/agents.md' WHEN 7 THEN '/Agents.md' WHEN 8 THEN '/.ENV.EXAMPLE' WHEN 9 THEN '/.env.key' WHEN 10 THEN '/.crt' ELSE '/main.py' END"


@registered(
    f"""WITH p AS (SELECT page_id, url || {_ENDINGS} AS path FROM pages), n AS (SELECT page_id, list_last(string_split(path, '/')) AS name FROM p)
SELECT page_id, 'blocked name' AS reason FROM n WHERE name IN ('AGENTS.md', 'agents.md')
UNION ALL SELECT page_id, 'environment file' FROM n WHERE starts_with(lower(name), '.env') AND name <> '.env.example'
UNION ALL SELECT page_id, 'blocked suffix' FROM n WHERE regexp_matches(name, '.[.](pem|key|p12|crt)$', 'i')"""
)
def q_path_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.table(spark, sf_dir, "pages").select("page_id", F.explode(safety.blocked_path(F.concat("url", F.expr(_ENDINGS)))).alias("reason"))


@registered(
    "WITH "
    + o.raw_conversations()
    + r""", c AS (SELECT 'conv_' || conv_id AS chat_name, turn AS seq, text AS original FROM conversations)
SELECT raw.chat_name, "timestamp", sender, regexp_replace(trim(regexp_replace(original, '[ \t]*\n[ \t]*', ' ', 'g')), '^\s+|\s+$', '', 'g') AS text FROM raw JOIN c USING (chat_name, seq)"""
)
def q_chat_lines_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = a.conversation_messages(spark, sf_dir).withColumnRenamed("text", "decorated")
    c = a.table(spark, sf_dir, "conversations").select(F.concat(F.lit("conv_"), "conv_id").alias("chat_name"), F.col("turn").alias("seq"), "text")
    logs = m.join(c, ["chat_name", "seq"]).select("chat_name", "seq", F.concat(F.date_format("timestamp", "d/M/yyyy, H:mm"), F.lit(" - "), "sender", F.lit(": "), F.trim("text")).alias("entry"))
    texts = logs.groupBy(F.concat("chat_name", F.lit(".txt")).alias("path")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "entry"))), lambda x: x["entry"]), "\n").alias("text"))
    return chats.parse_lines(chats.lines(texts)).select("chat_name", "timestamp", "sender", "text")


@registered(
    """WITH r AS (SELECT q.conv_id, trim(q.text) AS question, trim(w.text) AS answer FROM conversations q LEFT JOIN conversations w ON w.conv_id = q.conv_id AND w.turn = q.turn + 1 AND w.role = 'assistant' WHERE q.role = 'user')
SELECT 'Chat CSV con c' || conv_id AS chat_name, 'c' || conv_id AS sender, question AS text, TIMESTAMP '2024-03-04 10:05:00' AS "timestamp" FROM r WHERE question <> '' UNION ALL SELECT 'Chat CSV con c' || conv_id, 'me', answer, TIMESTAMP '2024-03-04 10:07:00' FROM r WHERE coalesce(answer, '') <> ''"""
)
def q_csv_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = a.table(spark, sf_dir, "conversations")
    q = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    w = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("owner_answer"))
    rows = q.join(w, ["conv_id", "turn"], "left").select(F.concat(F.lit("c"), "conv_id").alias("contact"), "question", "owner_answer", F.lit("4/3/2024 10:05").alias("question_dt"), F.lit("4/3/2024 10:07").alias("answer_dt"))
    return chats.csv_messages(rows, "me").select("chat_name", "sender", "text", "timestamp")
