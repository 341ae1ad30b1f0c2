"""Unicode forms: Python's, without texts going to Python."""

import random
import unicodedata

from pyspark.sql import functions as F

from recollect.functions import text as fn
from recollect.operators import messages
from recollect.plans import catalog

MARKS = [chr(c) for c in range(0x300, 0x370)] + list("़゙゚्ֿ֑ᅡᆨཱི\U0001d165")


def assigned(c: int) -> bool:
    return not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Cn"


def test_forms_are_pythons(spark):
    pick = random.Random(7)
    letters = [chr(c) for c in range(1, 0x30000) if assigned(c)]
    mixed = ["".join(pick.choice(letters) + "".join(pick.choices(MARKS, k=pick.randint(0, 4))) for _ in range(6)) for _ in range(20_000)]
    newer = ["a\U0001ccd6Ｂ", "\U0001138é", "\U000105d2̇ ﬁ"]  # some of Unicode 16, unassigned in older tables
    df = spark.createDataFrame([(x,) for x in [*letters, *mixed, *newer, "", "plain", None]], "t string")
    rows = df.select("t", fn.nfkc(F.col("t")).alias("c"), fn._form(F.col("t"), "compose").alias("n"), fn._form(F.col("t"), "decompose").alias("d")).collect()
    form = lambda name, t: None if t is None else unicodedata.normalize(name, t)
    assert len(rows) == len(letters) + 20_006
    assert [r for r in rows if r["c"] != form("NFKC", r["t"])] == []
    assert [r for r in rows if r["t"] not in newer and (r["n"], r["d"]) != (form("NFKC", r["t"]), form("NFKD", r["t"]))] == []


def test_texts_stay_out_of_python(spark, sf_dir):
    plan = catalog.QUERIES["q_qa_turns"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1  # for one worker a task; names need none

    seen = spark.sparkContext.accumulator(0)

    def counted(s):
        seen.add(int(s.notna().sum()))
        return s

    udf = F.pandas_udf(counted, "string").asNondeterministic()
    df = spark.createDataFrame([("ｈｏｌａ 你好 Árbol",), ("plain",), ("\U0003fffd",)], "t string").coalesce(1)
    got = [r["f"] for r in df.select(fn._form(F.col("t"), "compose", udf).alias("f")).collect()]
    assert (got, seen.value) == (["hola 你好 Árbol", "plain", "\U0003fffd"], 1)


def test_names_have_forms(spark):
    df = spark.createDataFrame([("　Ａｎａ ",), (None,)], "sender string")
    assert [tuple(r) for r in messages.with_sender(df).collect()] == [("Ana", "ana"), ("", "")]
