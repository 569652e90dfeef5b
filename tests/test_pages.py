import json
import random
import re

from pyspark.sql import functions as F

from roamlog.operators import pages as P

HEX = "0123456789abcdef"


def test_ids_near_matches_a_search_per_anchor(spark):
    rng = random.Random(1)
    pages = []
    for p in range(80):
        parts = []
        for _ in range(12):
            parts.append("".join(rng.choice("xyz <>\n") for _ in range(rng.choice([3, 40, 270, 300]))))
            parts.append(rng.choice(["".join(rng.choice(HEX) for _ in range(24)), "/user/7", "/user/8", "ab12"]))
        pages.append((p, "".join(parts)))
    want = set()
    for p, html in pages:
        for m in re.finditer("/user/7", html):
            want |= {(p, i) for i in re.findall("[0-9a-f]{24}", html[max(0, m.start() - 300):m.start()])}
    got = P.ids_near(spark.createDataFrame(pages, "page_id long, html string"), "/user/7")
    assert {tuple(r) for r in got.collect()} == want and len(want) > 20


def test_objects_at_any_depth(spark):
    tip = {"id": "t1", "text": "x", "createdAt": 1, "user": {"id": "7"}}
    deep = tip | {"id": "deep"}
    for _ in range(200):
        deep = {"a": deep}
    docs = [
        (1, json.dumps({"x": [tip, tip | {"id": "t2", "user": {"id": 7}}], "y": tip | {"id": "", "kids": [tip | {"id": "t3"}]}})),
        (2, json.dumps([tip | {"user": {"id": "8"}}, tip | {"text": ""}, tip | {"createdAt": 0}, tip | {"user": None}])), (3, json.dumps(deep)), (4, None),
    ]
    got = P.objects_where(spark.createDataFrame(docs, "page_id long, doc string"), "7")
    assert {tuple(r) for r in got.collect()} == {(1, "t1"), (1, "t2"), (1, "t3"), (3, "deep")}
    assert "Python" not in got._jdf.queryExecution().toString() and "Pandas" not in got._jdf.queryExecution().toString()


def test_objects_with_odd_fields(spark):
    tip = {"id": "t", "text": "x", "createdAt": 1, "user": {"id": "7"}}
    odd = [tip | {"id": 5}, tip | {"id": "ok", "createdAt": "2020"}, tip | {"id": "e1", "createdAt": ""}, tip | {"id": "e2", "text": []}, tip | {"id": "e3", "text": None},
           tip | {"id": "e4", "user": "7"}, tip | {"id": "e5", "user": {"id": None}}, tip | {"id": "e6", "createdAt": False}, {"id": "e7"}, 3, "x", None, [], {}]
    docs = [(1, json.dumps(odd)), (2, "{broken"), (3, "7"), (4, "[]"), (5, "")]
    got = P.objects_where(spark.createDataFrame(docs, "page_id long, doc string"), "7")
    assert {tuple(r) for r in got.collect()} == {(1, "5"), (1, "ok")}
    assert P.objects_where(spark.createDataFrame([], "page_id long, doc string"), "7").count() == 0


def test_embedded_json(spark):
    html = [("a", '<script nonce="n" id="__NEXT_DATA__" type="x">{"a":\n1}</script><script>{</script>'), ("b", '<script id="__NEXT_DATA__">{bad</script>'),
            ("c", "<p>none</p>"), ("d", '<script id="other">{}</script>')]
    df = spark.createDataFrame(html, "k string, html string").select("k", P.embedded_json(F.col("html")).alias("j"))
    assert {r.k: r.j for r in df.collect()} == {"a": '{"a":\n1}', "b": None, "c": None, "d": None}
