"""Strings within JSON texts, beside Python's own reading of them."""

import json

from pyspark.sql import functions as F

from tidemark.functions import leaves


def test_strings_change_and_all_else_stays(spark):
    deep = "x"
    for i in range(60):
        deep = [deep, {"a": i, "b": None}] if i % 2 else {"x": deep, "n": 1.5}
    values = [
        "plain", {"a": "b", "c": [1, None, True, "d\"e\\", {"f:": "g: h", "i": ""}]}, [], {}, None, 12, ["é\n\t", "a:b", "שלום", "/x/", "\\\"", "😀"], deep, {"k": {"k": {"k": [["v"]]}}},
    ]
    texts = [json.dumps(v, ensure_ascii=i % 2 == 0, indent=2 if i % 3 == 0 else None) for i, v in enumerate(values)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None, ""])], "i int, j string")
    got = {r["i"]: r for r in df.select("i", leaves.map_strings(F.col("j"), lambda s: F.concat(F.lit("<"), s, F.lit(">"))).alias("m"), leaves.strings(F.col("j")).alias("s")).collect()}

    def change(v, seen):
        if isinstance(v, str):
            seen.append(v)
            return f"<{v}>"
        if isinstance(v, list):
            return [change(x, seen) for x in v]
        return {k: change(x, seen) for k, x in v.items()} if isinstance(v, dict) else v

    for i, v in enumerate(values):
        seen = []
        assert json.loads(got[i]["m"]) == change(v, seen) and got[i]["s"] == seen, i
    assert got[len(texts)]["m"] is None and got[len(texts) + 1]["m"] == ""


def test_numbers_and_space_stay_as_written(spark):
    text = '{ "a" : 1.50e0,"b":[ -0, "x" ]  }'
    df = spark.createDataFrame([(text,)], "j string")
    assert df.select(leaves.map_strings(F.col("j"), F.upper)).first()[0] == text.replace('"x"', '"X"')
    assert df.select(leaves.map_strings(F.col("j"), lambda s: F.when(s != "x", s))).first()[0] == text.replace('"x"', "null")
