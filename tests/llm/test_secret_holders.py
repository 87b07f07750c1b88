"""The verdict on a value looks at its repositories as well as its owners."""

from brute import secrets as brute_secrets

from tidemark.llm import secrets
from tidemark.llm.common import shared_dir


def test_many_repositories_of_one_owner(spark):
    value = "aB3" * 14
    rows = [(i, f"x {value} y", f"repo{i}", "one") for i in range(5)] + [(10 + i, f"x {value[::-1]} y", f"repo{i}", "one") for i in range(3)]
    found = {r["doc_id"]: r for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(found[i]["spans"] == "" and (found[i]["most_owners"], found[i]["most_repos"]) == (1, 5) for i in range(5))
    assert all(found[10 + i]["spans"].startswith("mixed:") and found[10 + i]["most_repos"] == 3 for i in range(3))


def test_many_matches_in_one_text_and_no_value_on_disk(spark):
    value = "Zq7" * 13
    long = " ".join(f"token={i:07d} {'0123456789abcdef' * 2}{i % 3}" for i in range(30_000))
    rows = [(1, long, "x", "a"), (2, f"password=hunter2hunter2 {value}", "x", "b"), (3, f"{value}{value}", None, None)]
    before = {str(p) for p in _files(spark)}
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    columns = ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_live", "n_shared")
    told = brute_secrets([dict(zip(("doc_id", "text", "lang", "source"), r, strict=True)) for r in rows])
    assert sorted(tuple(r) for r in secrets.find_secrets(df).select(*columns).collect()) == sorted(told)
    new = [p for p in _files(spark) if str(p) not in before]
    assert new and not any("hunter2" in str(spark.read.parquet(str(p)).collect()) or value in str(spark.read.parquet(str(p)).collect()) for p in new)


def _files(spark):
    from pathlib import Path
    from urllib.parse import urlparse

    return [p for p in Path(urlparse(shared_dir(spark)).path).rglob("*.parquet") if p.is_file()]
