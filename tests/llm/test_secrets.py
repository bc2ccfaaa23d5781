import hashlib
import re

from pyspark.sql import types as T

from chronoframe.llm import secrets

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("row", T.StringType())])
KEY = "AKIA" + "Q1W2E3R4T5Y6U7I8"
LONE = "zX9kQ2mP7vL4tR8nB3cD6fG1hJ5"
WIDE = "aB3dE6gH9jK2mN5pQ8sT1vW4yZ7"
TEXTS = [
    "password = 'hunter22' and api_key:abc token=short secret = x",
    'é𝄞 TOKEN = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" end',
    f"{KEY} AKIA123 x{KEY}Y token=token:abcdefgh passwd=pass=wordlong",
    f"copied {WIDE} here", f"copied {WIDE} there", f"also {WIDE}", f"mine {LONE}.",
    "", None, "0123456789abcdef01234567", "plain words only", "secret:secret:secret = abcdef", "token = abcdef, token = ghijkl\nAPIKEY=\"q.w-e_r\"",
]


def slow_spans(text):
    out = []
    for k, (name, pattern, group, least) in enumerate([("assign", r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24)]):
        for m in re.finditer(pattern, text or "", re.I | re.A if k == 0 else 0):
            if len(m[group]) >= least:
                out.append((m.start(), k, f"{name}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(out)]


def run(spark, texts):
    rows = [(i, t, f"s{i}", "en", "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def test_base_spans_as_slow_and_owned_by_frequency(spark):
    got = {r["doc_id"]: r for r in secrets.digests(secrets.find_secrets(run(spark, TEXTS))).collect()}
    assert len(got) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        slow = slow_spans(text)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(slow).encode()).hexdigest(), (text, got[i])
        assert [s for s in got[i]["spans"].split(",") if s and not s.startswith("owned")] == slow
        assert [got[i]["n_assign"], got[i]["n_access"], got[i]["n_hex"]] == [sum(s.startswith(k) for s in slow) for k in ("assign", "access", "hex")]
    assert got[6]["spans"] == f"owned:5:{5 + len(LONE)}" and got[3]["spans"] == got[4]["spans"] == ""


def test_one_owner_many_times_stays_live_and_is_redacted(spark):
    rows = [(1, f"a {LONE} b token = {LONE} c", "s", "en", "", ""), (None, f"{LONE}{LONE}", None, None, "k", None), (3, None, "s", "en", "", ""), (3, "clean", "s", "en", "", "")]
    rows += [(10 + i, f"see {KEY}", f"s{i}", "en", "", "") for i in range(5)]
    docs = spark.createDataFrame(rows, DOCS)
    got = {(r["doc_id"], r["text"]) for r in secrets.redacted(docs).collect()}
    assert (1, "a [SECRET] b [SECRET] c") in got and (None, "[SECRET]") in got and (3, None) in got and (3, "clean") in got
    assert (10, f"see {KEY}") in got and len(got) == 9
    assert secrets.redacted(docs).columns == docs.columns


def test_no_rows(spark):
    assert secrets.find_secrets(spark.createDataFrame([], DOCS)).collect() == []


def test_clashing_column_names_survive_redaction(spark):
    columns = "doc_id long, text string, source string, lang string, _id string, _spans string, _masked string, _key string"
    docs = spark.createDataFrame([(1, f"x {LONE}", "s", "en", "a", "b", "c", "d"), (2, "clean", "s", "en", "e", "f", "g", "h")], columns)
    assert sorted(tuple(r) for r in secrets.redacted(docs).collect()) == [(1, "x [SECRET]", "s", "en", "a", "b", "c", "d"), (2, "clean", "s", "en", "e", "f", "g", "h")]
