from pressloom.llm import licenses
from tests.llm.helpers import SCHEMA, awkward, empty


def test_entire_texts_and_notices(spark):
    texts = {
        30: "MIT LICENCE!\n\nCopyright (c) 2020 Some One\n\n" + licenses.MIT_BODY.lower().replace(",", " ,").replace("sublicense", "sub-license"),
        31: "Some prose.\nReleased  under the MIT licence!\nMore prose.\nlicensed under CC BY-NC 4.0",
        32: "Released under the MIT License. And then more on the same line.",
        33: licenses.ISC_BODY + "\nextra clause",
        34: licenses.ISC_BODY,
    }
    docs = spark.createDataFrame([(i, t, "en", "a", 1, 1.0, "x") for i, t in texts.items()], SCHEMA)
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    assert [got[i]["whole_licence"] for i in texts] == ["MIT", None, None, None, "ISC"]
    assert (got[31]["n_notices"], got[31]["notices"]) == (2, "CC-BY-NC-4.0,MIT")
    assert got[32]["n_notices"] == 0


def test_awkward_and_empty(spark):
    rows = licenses.scan(awkward(spark)).collect()
    assert len(rows) == 8 and all(r["whole_licence"] is None and r["n_notices"] == 0 and r["notices"] == "" for r in rows)
    assert len({r["text_digest"] for r in rows if r["doc_id"] in (2, 3, 4)}) == 1
    assert licenses.scan(empty(spark)).count() == 0


def test_plan_has_no_python(spark):
    plan = licenses.scan(awkward(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastHashJoin" in plan


def test_notices_in_banners_and_without_the_word(spark):
    lines = ["/*" + "*" * 400 + " Released under the MIT License. " + "*" * 400 + "*/", " " * 500 + "# Licensed under CC BY 4.0.", "Dedicated to the public domain!"]
    docs = spark.createDataFrame([(1, "\n".join(lines), "en", "a", 1, 1.0, "x")], SCHEMA)
    row = licenses.scan(docs, more=[("PD", "Dedicated to the public domain.")]).first()
    assert (row["n_notices"], row["notices"]) == (3, "CC-BY-4.0,MIT,PD")


def test_lines_and_entire_texts_of_any_form_are_looked_up(spark):
    mit = "Released under the MIT License."
    rows = [(1, "intro\n" + "-" * 400 + " " + mit + " " + "=" * 400 + "\nend"), (2, "cc0 1.0 UNIVERSAL"), (3, "A dedication of my own\nA dedication of my own"), (4, licenses.BSD_TERMS + licenses.BSD_NAMES + licenses.BSD_END), (4, licenses.MPL_NOTICE)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    # a text that is known already, and one that two names share
    more = [("Own", "a dedication of my own!"), ("Again", mit), ("Other", "A dedication, of my own"), ("None", "...")]
    got = sorted((r["doc_id"], r["whole_licence"] or "", r["n_notices"], r["notices"]) for r in licenses.scan(df, more).collect())
    assert got == [(1, "", 1, "Again"), (2, "CC0-1.0", 1, "CC0-1.0"), (3, "", 2, "Other"), (4, "BSD-3-Clause", 0, ""), (4, "MPL-2.0", 1, "MPL-2.0")]
