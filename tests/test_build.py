"""The incremental build from exports to answers, and what it does the second time."""

import os
import zipfile

import pytest

from recollect.config import Environment, Settings
from recollect.operators import answer, embed, safety, search
from recollect.plans import build, catalog
from recollect.sources import repository


def export(path, lines):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("chat.txt", "\n".join(lines))


def chat(n, of="Ana"):
    return [f"3/4/24, 10:{i % 60:02d} - {(of, 'Yo')[i % 2]}: mensaje numero {i} sobre tema {i % 5}" for i in range(n)]


def test_incremental_build(spark, tmp_path):
    inbox, home = tmp_path / "in", str(tmp_path / "home")
    inbox.mkdir()
    export(inbox / "Ana [x].zip", chat(40))
    export(inbox / "Eva.zip", chat(6, "Eva"))
    (inbox / "bad.zip").write_bytes(b"no archive")
    (inbox / "q.csv").write_text('contact,question,owner_answer,question_dt,answer_dt\nLuz,"hola,\nque tal",bien,4/3/2024 10:05,4/3/2024 10:07\n')
    (inbox / "other.csv").write_text("answer_dt,owner_answer,question\n4/3/2024 11:07,vale pues,\n")
    (inbox / "without.csv").write_text("a,b\n1,2\n")
    enc, s = embed.HashingEncoder(16), Settings(owner="Yo")

    response, style, first = build.run(spark, str(inbox), home, enc, s)
    assert {k: first.counts[k] for k in ("fast", "hash", "parsed", "failed", "gone")} == {"fast": 0, "hash": 0, "parsed": 4, "failed": 2, "gone": 0}
    assert first.counts["owner_found"] == "config_match" and not any(first.reused.values())
    raw = build.state.current(spark, home, "messages")
    assert raw.count() == 40 + 6 + 2 + 1
    assert {r["text"] for r in raw.where("chat_name = 'Chat CSV con Luz'").collect()} == {"hola,\nque tal", "bien"}
    hits = search.ask(["tema 3", "tema 1"], response, style, enc, 4, min_score=0.0).collect()
    assert {h["qid"] for h in hits} == {0, 1}
    old = style.count()

    # one file is touched, but its bytes are the same: nothing is parsed or built again, but the unreadable are tried again
    os.utime(inbox / "Eva.zip", (1, 1))
    _, _, again = build.run(spark, str(inbox), home, enc, s)
    assert {k: again.counts[k] for k in ("fast", "hash", "parsed", "failed")} == {"fast": 3, "hash": 1, "parsed": 0, "failed": 2} and all(again.reused.values())

    # one file more, one gone, one mended: the result is that of a build from nothing
    export(inbox / "Sol.zip", chat(8, "Sol"))
    export(inbox / "bad.zip", chat(4, "Bea"))
    (inbox / "Eva.zip").unlink()
    _, style, more = build.run(spark, str(inbox), home, enc, s)
    assert (more.counts["parsed"], more.counts["gone"], more.counts["failed"]) == (2, 1, 1) and not more.reused["memory_units"]
    _, fresh, _ = build.run(spark, str(inbox), str(tmp_path / "fresh"), enc, s)
    # centres of clusters depend on how rows lie in partitions
    columns = [c for c in style.columns if c not in ("embedding", "style_cluster")]
    got = sorted(map(str, style.select(columns).collect()))
    assert got == sorted(map(str, fresh.select(columns).collect()))
    assert len(got) != old

    # other settings: units are built anew from the messages that are there
    _, _, other = build.run(spark, str(inbox), home, enc, Settings(owner="Yo", max_style_words=3))
    assert other.reused["messages"] and not other.reused["style_units"] and other.counts["parsed"] == 0


def test_empty_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    response, style, report = build.run(spark, str(tmp_path / "in"), str(tmp_path / "home"), embed.HashingEncoder(4))
    assert response.count() == style.count() == 0 and report.counts["parsed"] == 0


def test_chats_by_first_appearance(spark):
    t = "2024-03-0"
    units = spark.createDataFrame([("zoe", t + "1 10:00:00"), ("ana", t + "2 10:00:00"), ("zoe", t + "3 10:00:00")], "chat_name string, ts string").selectExpr("chat_name", "cast(ts AS timestamp_ntz) AS timestamp")
    queries = spark.createDataFrame([(1, "Ana y Zoe"), (2, "ana y luz")], "qid int, query string")
    later = spark.createDataFrame([("luz", "2024-03-01 09:00:00")], "chat_name string, ts string").selectExpr("chat_name", "cast(ts AS timestamp_ntz) AS timestamp")
    assert {r["qid"]: r["contact"] for r in search.contact_hints(queries, search.first_seen(units, later)).collect()} == {1: "zoe", 2: "ana"}


def test_environment(tmp_path):
    (tmp_path / ".env").write_text("# note\nMY_NAME='Ana B'\nexport GEN_MODEL=m # which\nOPENAI_API_KEY=\"s\"\n\nbroken\n")
    e = Environment.read(tmp_path / ".env", {"MY_NAME": "Eva"})
    assert (e.owner, e.chat_model, e.api_key, e.embed_model) == ("Eva", "m", "s", Environment.embed_model) and "'s'" not in repr(e)
    assert Environment.read(tmp_path / ".env", {"MY_NAME": "Eva"}, override=True).owner == "Ana B"
    assert Environment.read(tmp_path / "none", {}) == Environment()


def test_other_errors_are_not_retried():
    class Refused(Exception):
        pass

    calls = []

    def client(system, user, temperature):
        calls.append(temperature)
        if temperature is not None:
            raise Refused("Unsupported value: 'temperature' takes only the default")
        return "ok"

    assert answer.retrying(client)("s", "u", 0.2) == "ok" and calls == [0.2, None]
    calls.clear()

    def broken(system, user, temperature):
        calls.append(temperature)
        raise ValueError("no such model")

    with pytest.raises(ValueError):
        answer.retrying(broken)("s", "u", 0.2)
    assert calls == [0.2]


def test_unreadable_notebooks_and_files(spark, tmp_path):
    files = [("nul.ipynb", b'{"cells": []}\0'), ("bytes.ipynb", b'{"cells": ["\xff"]}'), ("good.ipynb", b'{"cells": []}')]
    found = [(r["path"], r["kind"]) for r in safety.scan_files(spark.createDataFrame(files, "path string, content binary")).collect()]
    assert sorted(found) == [("bytes.ipynb", "parse"), ("nul.ipynb", "parse")]
    good, bad = repository.readable([tmp_path / "none"])
    assert (good, bad) == ([], [tmp_path / "none"])


def test_unicode_forms_are_evaluated_once(spark, sf_dir):
    plan = catalog.QUERIES["q_document_labels"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
