import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.operators import encode as E


def values(spark, rows, *cols):
    df = spark.createDataFrame([(r,) for r in rows], "s string")
    return [tuple(r) for r in df.select(*cols).collect()]


def model_split(name):
    out, cur = [], ""
    for i, ch in enumerate(name):
        p, n = (name[i - 1] if i else ""), (name[i + 1] if i + 1 < len(name) else "")
        cut = p and (ch == "_" or (p.islower() and ch.isupper()) or (p.isupper() and ch.isupper() and n.islower()) or (p.isdigit() and not ch.isdigit()) or (ch.isdigit() and not p.isdigit() and p != "_"))
        if cut and cur:
            out.append(cur)
            cur = ""
        if ch != "_":
            cur += ch
    return [x.lower() for x in out + ([cur] if cur else [])] + ([name.lower()] if name else [])


def test_split_identifier(spark):
    names = ["HTTPServer", "getURL2Name", "snake_case_x", "X", "", "a1b2", "__init__", "parseJSON", "v2", "ABC", "x9Y"]
    got = values(spark, names, T.split_identifier(F.col("s")))
    assert [g[0] for g in got] == [model_split(n) for n in names]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.from_regex(r"\A[A-Za-z_][A-Za-z0-9_]{0,12}\Z"), min_size=20, max_size=40))
def test_split_identifier_random(spark, names):
    assert [g[0] for g in values(spark, names, T.split_identifier(F.col("s")))] == [model_split(n) for n in names]


def test_tokens(spark):
    got = values(spark, ["The Cache of é is a-b 42!", None, ""], T.prose_tokens("s"), T.ascii_tokens("s"))
    assert got[0] == (["cache", "é", "42"], ["cache", "42"]) and got[1] == ([], []) and got[2] == ([], [])
    assert values(spark, ["find httpHandler of the Cache"], T.query_tokens("s"))[0][0] == ["find", "http", "handler", "httphandler", "of", "the", "cache"]


def test_markdown(spark):
    page = "---\ntags: [a]\nstatus: draft\n---\n# Title \n\ntext\n```\n# code\n[[x]]\n```\n`inl [[y]]` end"
    cols = [T.strip_front_matter("s"), T.first_heading("s"), T.front_matter_field("s", "status"), T.blank_inline_code(T.blank_fences("s"))]
    plain, title, status, blank = values(spark, [page], *cols)[0]
    assert plain.startswith("# Title") and title == "Title" and status == "draft"
    assert blank.count("\n") == page.count("\n") and "[[" not in blank and blank.endswith(" end")
    assert values(spark, ["---\nopen"], T.strip_front_matter("s"))[0][0] == "---\nopen"
    assert [r[0] for r in values(spark, ["A_b  C!", "--", "é"], T.slugify("s"))] == ["a-b-c", "untitled", "untitled"]
    assert values(spark, ["x" * 300 + " Needle " + "y" * 300, "short"], T.snippet("s", F.array(F.lit("needle"))))[1][0] == "short"


def test_caveman(spark):
    cases = {
        "The cache is very full": "cache full", "in order to win, do not stop": "to win, not stop", "the-x survives": "the-x survives", "We cannot  go .": "We cant go.",
        "Please  keep\nit": "keep it", "": "", "theory of being": "theory of", "kind-hearted kind": "kind-hearted", "IT IS NOT so that": "IT not so",
    }
    got = values(spark, list(cases), E.caveman(F.col("s")))
    assert [g[0] for g in got] == list(cases.values())


def test_pipelines(spark):
    df = spark.createDataFrame([(i, "identifier_one and identifier_one again, plus otherIdent " * 5) for i in range(3)] + [(9, "")], "k int, t string")
    enc = {r.k: r.encoded for r in E.run_pipeline(df, "k", "t", "glossary,caveman").collect()}
    assert enc[0].startswith("g0 and g0 again, plus") and enc[9] == ""
    assert E.parse_pipeline("raw") == [] and E.parse_pipeline("caveman+glossary") == ["caveman", "glossary"]
    tup = {r.k: r.encoded for r in E.dense_tuple(spark.createDataFrame([(1, "def load(self, a: int, b=2) -> str:\n    return cache(a)"), (2, "prose")], "k int, t string"), "k", "t").collect()}
    assert tup[1] == "load name load. load param a. load param b. load returns str. load uses cache. load uses int. load uses str." and tup[2] == "_ name _. _ uses prose."
    card = E.card(spark.createDataFrame([(1, 'x = 1\ndef f(a):\n    """Does it. More."""\n    return a')], "k int, t string"), "k", "t").first().encoded
    assert card.startswith("def f(a): Does it a ") and re.search(r"\bMore\b", card)
    best = E.best_under_cap(E.grid(df, "k", "t", candidates=("raw", "caveman", "glossary")), []).first()
    assert best.pipeline == "glossary" and 1 < best.ratio <= 4.5
