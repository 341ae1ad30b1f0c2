"""Hand-written boundary rows of the engine's operators."""

import datetime as dt
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect import schemas
from recollect.config import Settings
from recollect.functions import scores
from recollect.functions import text as fn
from recollect.operators import answer, embed, messages, safety, search, units
from recollect.sources import chats, state
from recollect.streaming import topics

T0 = dt.datetime(2024, 3, 4, 10, 0)


def rows_of(spark, given):
    """(minute, sender, text) as clean messages of one chat; 'me' is the owner."""
    raw = spark.createDataFrame([(T0 + dt.timedelta(minutes=m), s, t, "c", i) for i, (m, s, t) in enumerate(given)], "timestamp timestamp_ntz, sender string, text string, chat_name string, seq long")
    return messages.with_labels(messages.with_owner(messages.with_sender(raw), "me"))


def parsed(spark, text, **more):
    return chats.parse_lines(chats.lines(spark.createDataFrame([("a/chat.txt", text)], "path string, text string")), **more).orderBy("seq").collect()


def test_line_patterns(spark):
    r = parsed(spark, "before\n3/4/24, 10:05 - Ana: hola: x\n[3/4/24, 10:05 p.m.] Luis: que tal\n[3/4/24, 10:05:11] Luis: no")
    assert [(x["sender"], x["text"], x["timestamp"]) for x in r] == [("Ana", "hola: x", dt.datetime(2024, 4, 3, 10, 5)), ("Luis", "que tal [3/4/24, 10:05:11] Luis: no", dt.datetime(2024, 4, 3, 22, 5))]
    assert r[0]["chat_name"] == "chat"


def test_merged_lines_and_system_notices(spark):
    r = parsed(spark, "3/4/24, 10:05 - Ana: uno\n\n  dos  \n3/4/24, 10:06 - Ana: tres\nLos mensajes tienen cifrado de extremo a extremo\n31/2/2024, 10:00 - Ana: nunca")
    assert [x["text"] for x in r] == ["uno  dos"]
    kept = parsed(spark, "3/4/24, 10:06 - Ana: tres\nLos mensajes tienen cifrado de extremo a extremo", split_system_lines=True)
    assert [x["text"] for x in kept] == ["tres"]


def test_zip_and_csv_files(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "Ana.zip", "w") as z:
        z.writestr("chat.TXT", "3/4/24, 10:05 - Ana: señal".encode("latin-1"))
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    (tmp_path / "q.csv").write_text("contact,question,owner_answer,question_dt,answer_dt\nEva,hola,,4/3/2024 10:05,\nEva,y,si,2024-03-04 10:06:00,4/3/2024 10:07\n")
    out = sorted((r["sender"], r["text"]) for r in chats.messages(spark, str(tmp_path), "me").collect())
    assert out == [("Ana", "señal"), ("Eva", "hola"), ("Eva", "y"), ("me", "si")]
    errors = {r["path"].rsplit("/", 1)[1]: r["error"] for r in chats.unzipped(chats.export_files(spark, str(tmp_path))).collect()}
    assert errors["Ana.zip"] is None and errors["bad.zip"]
    without = spark.createDataFrame([("x",)], "question string")
    assert chats.csv_messages(without, "me").count() == 0


def test_labels(spark):
    given = ["ok", "??", "ñá", "ñá!", "abc", "que", "que hora es", "qué hora es", "por qué no"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "i int, t string").select("t", fn.is_low_signal(F.col("t")).alias("low"), fn.is_question(F.col("t")).alias("q"))
    r = {x["t"]: (x["low"], x["q"]) for x in df.collect()}
    assert [r[t][0] for t in given[:5]] == [True, True, True, False, False]
    assert [r[t][1] for t in given[5:]] == [False, True, False, True]


def test_signal_score(spark):
    r = rows_of(spark, [(0, "a", " ".join(["x"] * 12)), (1, "a", "www.x.y"), (2, "a", "a b c d e f?")]).orderBy("seq").collect()
    assert [round(x["signal_score"], 9) for x in r] == [1.0, 0.0, 0.55]


@pytest.mark.parametrize(("text", "want"), [("HOLA!", "tiny|q0|e1|caps"), ("hola?", "tiny|q1|e0|normal"), ("a b c", "short|q0|e0|normal"), ("a b c d e f g", "mid|q0|e0|normal"), (" ".join(["a"] * 15), "long|q0|e0|normal"), ("", "empty")])
def test_style(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(fn.style_signature(F.col("t"))).first()[0] == want


def test_unicode_forms(spark):
    df = spark.createDataFrame([("Ｈｏ​la   x",), (None,)], "t string").select(fn.normalized(F.col("t")).alias("n"), fn.fuzzy_key(F.lit("¡Árbol, sí!")).alias("f"), fn.folded(F.lit("Straße")).alias("c"))
    r = df.collect()
    assert r[0]["n"] == "Hola x" and r[1]["n"] == "" and r[0]["f"] == "arbol si" and r[0]["c"] == "strasse"


def test_duplicates_keep_the_first(spark):
    m = spark.createDataFrame([(T0, "a", "t", "c", 5), (T0, "a", "t", "c", 2)], "timestamp timestamp_ntz, sender string, text string, chat_name string, seq long")
    assert [r["seq"] for r in messages.first_of_duplicates(m).collect()] == [2]


def test_owner(spark):
    def resolve(pairs, name):
        df = spark.createDataFrame(pairs or [("x", "x")], "sender string, chat_name string")
        return messages.resolve_owner(messages.with_sender(df if pairs else df.limit(0)), name)

    four = [("X", "1"), ("X", "2"), ("b", "1"), ("c", "2"), ("d", "3"), ("e", "4")]
    assert resolve(four, "nobody") == ("X", "inferred_chat_coverage")
    assert resolve(four, "x") == ("X", "config_match")
    assert resolve([("a", "1")], "nobody") == ("nobody", "config_no_match")
    assert resolve([("a", "1"), ("b", "1"), ("b", "1")], "Tu Nombre") == ("b", "inferred_top_count")
    assert resolve([], "") == ("Tu Nombre", "fallback_default")


def test_reply_turns(spark):
    m = rows_of(spark, [(0, "ana", "hola que pasa"), (30, "me", "todo bien aqui"), (61, "ana", "otra cosa"), (92, "me", "llego tarde hoy")])
    assert [(r["source_id"], r["reply_gap_min"]) for r in units.qa_turns(m).collect()] == [("qa::c::1", 30.0)]
    far = rows_of(spark, [(0, "ana", "hola que pasa"), *((i, "me", f"cosa numero {i}") for i in range(1, 6))])
    turns = {r["source_id"] for r in units.qa_turns(far).collect()}
    assert "qa::c::4" in turns and "qa::c::5" not in turns
    own = {r["source_id"]: r for r in units.own_messages(far).collect()}
    assert own["msg::c::5"]["partner_sender"] == "ana"
    first = rows_of(spark, [(0, "me", "empiezo yo hoy"), (1, "ana", "ok")])
    assert units.qa_turns(first).count() == 0 and units.own_messages(first).first()["partner_text"] == ""
    low = rows_of(spark, [(0, "ana", "ok"), (1, "me", "vale lo hago")])
    assert units.qa_turns(low).first()["context"] == "ana: ok"


def test_topics_and_blocks(spark):
    m = rows_of(spark, [(0, "a", "x y z"), (45, "a", "x y z"), (91, "a", "x y z"), (92, "a", "x y z"), (93, "a", "x y z")])
    assert [r["topic"] for r in units.with_topics(m, 45).orderBy("seq").collect()] == [0, 0, 1, 1, 1]
    assert [r["source_id"] for r in units.topic_blocks(m).collect()] == ["blk::c::1::0::3"]
    eight = rows_of(spark, [(i, "a", " ".join(["w"] * 12)) for i in range(8)])
    want = [(0, 3), (0, 5), (0, 8), (2, 5), (2, 7), (4, 7)]
    key = lambda r: tuple(map(int, r["source_id"].split("::")[3:]))
    assert sorted(map(key, units.topic_blocks(eight).collect())) == want
    assert sorted(map(key, units.topic_blocks(eight, Settings(blocks_per_topic=4)).collect())) == want[:4]


def test_style_limits(spark):
    m = rows_of(spark, [(0, "a", "hola que tal"), (1, "me", " ".join(["w"] * 60)), (2, "me", " ".join(["w"] * 61)), (3, "me", "abc")])
    u = units.own_messages(m)
    assert sorted(len(r["style_text"].split()) for r in units.style_units(u).collect()) == [1, 60]


def test_rerank_parts(spark):
    df = spark.createDataFrame([(None,), (0.0,), (120.0,), (500.0,)], "g double").select(scores.gap_bonus(F.col("g")).alias("b"))
    assert [round(r["b"], 9) for r in df.collect()] == [0.0, 0.03, 0.0, 0.0]
    newest = F.lit(T0).cast("timestamp_ntz")
    ages = spark.createDataFrame([(T0,), (T0 - dt.timedelta(hours=23),), (T0 - dt.timedelta(days=10),), (T0 - dt.timedelta(days=60),), (None,)], "t timestamp_ntz").select(scores.recency(F.col("t"), newest, 0.05).alias("r"))
    assert [round(r["r"], 9) for r in ages.collect()] == [0.05, 0.05, 0.04, 0.0, 0.0]
    assert spark.range(1).select(scores.signal_or_default(F.lit(0.0), 0.4)).first()[0] == 0.4


def test_round_robin(spark):
    rows = [(1, 1, "A", "t1", 0.9), (1, 2, "B", "t1", 0.8), (1, 3, "A", "t2", 0.7), (1, 4, "B", "t3", 0.6)]
    df = spark.createDataFrame([(*r, r[4]) for r in rows], "qid int, id int, style_cluster string, style_text string, rank_score double, score double")
    out = search.round_robin(df, 3, "id").orderBy("rn").collect()
    assert [(r["style_text"], r["style_cluster"]) for r in out] == [("t1", "A"), ("t3", "B"), ("t2", "A")]


def test_search_in_several_blocks(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 4)
    rows = sorted((r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect())
    units_ = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    queries = units_.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))
    x = np.array([v for _, v in rows], np.float64)
    want = []
    for i, v in rows:
        if i % 50 == 0:
            s = np.round(x @ np.array(v, np.float64), search.DIGITS)
            want += [(i, rows[j][0], n) for n, j in enumerate(np.lexsort((np.arange(len(x)), -s))[:7], 1)]
    assert len(want) > 7 * search.BLOCK
    assert sorted((r["qid"], r["vec_id"], r["rank"]) for r in search.top_k(units_, queries, 7, "vec_id").collect()) == sorted(want)


def test_end_to_end_retrieval(spark):
    m = rows_of(spark, [(i, ("ana", "me")[i % 2], f"mensaje numero {i} sobre tema {i % 5}") for i in range(40)])
    u = units.memory_units(m)
    enc = embed.HashingEncoder(32)
    empty = spark.createDataFrame([], "unit_hash string, embedding array<float>")

    def ready(df, col):
        return embed.embed_incrementally(embed.with_unit_hash(df, col, "1"), empty, col, enc).cache()

    response = ready(units.response_units(u), "response_embed_text")
    style = embed.kmeans_labels(ready(units.style_units(u), "style_embed_text"))
    queries = embed.embed(spark.createDataFrame([(7, "tema 3 en c")], "qid int, query string"), "query", enc, "qv")
    hits = search.retrieve(queries, response, style, 3, min_score=0.0).orderBy("rn").collect()
    assert 0 < len(hits) <= 3 and [h["rank_score"] for h in hits] == sorted((h["rank_score"] for h in hits), reverse=True)
    text = answer.answer("tema 3", [h for h in hits if h["retrieval_role"] == "response"], [h for h in hits if h["retrieval_role"] == "style"], answer.Echo())
    assert text
    assert answer.answer("x", [], [], answer.Echo()) == answer.REFUSAL


def test_answer_guards():
    hit = {"score": 0.5, "chat_name": "c", "timestamp": "t", "partner_text": "p", "response": "r", "context": "x", "style_cluster": 1, "style_text": "s"}
    assert answer.answer("q", [hit], [hit], lambda *a: "") == answer.REFUSAL
    said = iter(["¡Q!", "otra"])
    assert answer.answer("q", [hit], [], lambda *a: next(said)) == "otra"
    calls = []

    def picky(system, user, temperature):
        calls.append(temperature)
        if temperature is not None:
            raise ValueError("no temperature")
        return "ok"

    assert answer.retrying(picky)("s", "u", 0.5) == "ok" and calls == [0.5, None]


def test_cache_delta(spark):
    u = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y")], "unit_hash string, t string")
    cache = spark.createDataFrame([("a", [1.0]), ("z", [2.0])], "unit_hash string, embedding array<float>")
    missing, reused = embed.cache_delta(u, cache)
    assert [r[0] for r in missing.collect()] == ["b"] and [r[0] for r in reused.collect()] == ["a"]
    assert embed.embed_incrementally(u, cache, "t", embed.HashingEncoder(1)).count() == 3


def test_secrets(spark):
    key = "AKIA" + "A1" * 8
    df = spark.createDataFrame([(1, f"x\n{key}\n\n{key} end"), (2, "clean"), (3, None)], "id int, t string")
    assert sorted((r["line"], r["match"]) for r in safety.scan_text(df, "id", "t").collect()) == [(2, key), (4, key)]
    across = spark.createDataFrame([(1, "a\naws_secret_access_key =\n" + "b" * 30 + "\nghp_" + "c" * 20)], "id int, t string")
    assert sorted((r["label"], r["line"]) for r in safety.scan_text(across, "id", "t").collect()) == [("cloud secret assignment", 2), ("code host token", 4)]


def test_files_and_notebooks(spark):
    key = "ghp_" + "a" * 20
    nb = {"cells": [{"cell_type": "code", "source": ["x\n", key], "outputs": [{"a": 1}]}, {"cell_type": "markdown", "source": key, "outputs": [{}]}]}
    files = [("a.bin", b"\0" + key.encode()), ("b.txt", b"\xff\n" + key.encode()), ("n.ipynb", json.dumps(nb).encode()), ("bad.ipynb", b"{"), (".env", b""), (".ENV.local", b""), (".env.example", b""), ("x.PEM", b"")]
    found = {(r["path"], r["cell"], r["line"], r["kind"]) for r in safety.scan_files(spark.createDataFrame(files, "path string, content binary")).collect()}
    assert found == {("b.txt", None, 2, "secret"), ("n.ipynb", 1, None, "outputs"), ("n.ipynb", 1, 2, "secret"), ("n.ipynb", 2, 1, "secret"), ("bad.ipynb", None, None, "parse"), (".env", None, None, "path"), (".ENV.local", None, None, "path"), ("x.PEM", None, None, "path")}


def test_state(spark, tmp_path):
    p = str(tmp_path / "s.json")
    assert state.read_json(spark, p, {"d": 1}) == {"d": 1}
    built = []
    assert state.rebuilt(spark, p, "k", lambda: built.append(1)) and not state.rebuilt(spark, p, "k", lambda: built.append(1))
    (tmp_path / "broken.json").write_text("{")
    assert state.read_json(spark, str(tmp_path / "broken.json"), 0) == 0
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("c.txt", "3/4/24, 10:05 - Ana: x")
    files = chats.export_files(spark, str(tmp_path))
    manifest = state.read_table(spark, str(tmp_path / "none"), schemas.MANIFEST)
    new = state.to_parse(files, manifest, "v1")
    assert new.count() == 1
    seen = state.entries(new, "v1")
    state.write_table(seen, str(tmp_path / "manifest"))
    seen = spark.read.parquet(str(tmp_path / "manifest"))
    assert state.to_parse(files, seen, "v1").count() == 0 and state.to_parse(files, seen, "v2").count() == 1
    assert {r["state"] for r in state.manifest_delta(state.signature(files.limit(0)), seen, "v1").collect()} == {"gone"}


def test_streamed_topics(spark, tmp_path):
    schema = "chat_name string, timestamp timestamp"
    spark.createDataFrame([("c", T0 + dt.timedelta(minutes=m)) for m in (0, 45, 91, 400)], schema).write.parquet(str(tmp_path / "in"))
    stream = topics.streamed_topics(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("streamed_topics").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["n"] for r in spark.table("streamed_topics").collect()) == [1, 2]


def test_reasons_against_a_path(spark):
    names = {"AGENTS.md": ["blocked name"], "agents.md": ["blocked name"], "Agents.md": [], ".env": ["environment file"], ".ENV.EXAMPLE": ["environment file"], ".env.example": [], ".env.key": ["blocked suffix", "environment file"], ".pem": [], "x.PEM": ["blocked suffix"], "pem": [], "": []}
    rows = spark.createDataFrame([(f"a/{n}", b"") for n in names] + [(None, b"")], "path string, content binary")
    found = [(r["path"], r["label"]) for r in safety.scan_files(rows).collect()]
    assert sorted(found) == sorted((f"a/{n}", why) for n, reasons in names.items() for why in reasons)
