"""Paged sources that go on where they stopped."""

import json

import pytest

from litmetrics import cli
from litmetrics.sources import files, rest


def put(folder, name, page, titles, after):
    (folder / f"{name}-{page}.json").write_text(json.dumps({"results": [{"id": f"https://x.org/{t}", "title": t} for t in titles], "meta": {"next_cursor": after}}))


def fetched(spark, folder, kept, names, **options):
    some = spark.createDataFrame([(n,) for n in names], "name string")
    rows = rest.resumed(some, str(kept), "file://fixtures", {"filter": "f"}, transport=lambda: rest.folder_transport(str(folder)), tasks=2, **options).collect()
    return sorted((r.entity, json.loads(r.record)["title"]) for r in rows)


@pytest.mark.parametrize("per_round", [1, 2, 20])
def test_a_failure_at_page_three_is_resumed(spark, tmp_path, per_round):
    folder, kept = tmp_path / "fx", tmp_path / "kept"
    folder.mkdir()
    put(folder, "A", "first", ["a1", "a2"], "c2")
    put(folder, "A", "c2", ["a3"], "c3")
    put(folder, "B", "first", ["b1"], None)
    with pytest.raises(RuntimeError, match="A, page 2: RuntimeError: HTTP 404"):
        fetched(spark, folder, kept, ["A", "B"], per_round=per_round)
    for known in ("A-first", "A-c2", "B-first"):  # asking for these again would fail
        (folder / f"{known}.json").unlink()
    put(folder, "A", "c3", ["a4"], "c4")
    put(folder, "A", "c4", [], "c5")
    want = [("A", f"a{i}") for i in range(1, 5)] + [("B", "b1")]
    assert fetched(spark, folder, kept, ["A", "B"], per_round=per_round) == want
    for f in folder.iterdir():
        f.unlink()
    assert fetched(spark, folder, kept, ["A", "B", "A"]) == want  # all is there
    assert fetched(spark, folder, kept, ["B"]) == [("B", "b1")]
    with pytest.raises(RuntimeError, match="C, page 0"):
        fetched(spark, folder, kept, ["B", "C"])
    assert fetched(spark, folder, kept, []) == []


def test_used_up_budgets_are_told_apart(spark, tmp_path):
    some = spark.createDataFrame([("A",)], "name string")
    with pytest.raises(rest.BudgetExceeded):
        rest.resumed(some, str(tmp_path), "u", {}, transport=lambda: lambda url, body=None: (429, "daily budget used up"))


def test_offsets_and_the_command(spark, tmp_path):
    folder = tmp_path / "fx"
    folder.mkdir()
    page = lambda ids, after: json.dumps({"data": [{"paperId": i, "title": f"Статья {i}", "citationCount": 3, "publicationTypes": None} for i in ids], "next": after})
    (folder / "7-0.json").write_text(page(["p1", "p2"], 2))
    (folder / "7-2.json").write_text(page(["p3"], None))
    command = ["extract", "--source", "scholar", "--fixtures", str(folder), "--author", "7", "--cache", str(tmp_path / "kept"), "--output", str(tmp_path / "out")]
    assert cli.main(command) == 0
    for f in folder.iterdir():
        f.unlink()
    assert cli.main(command) == 0
    assert sorted(r.id for r in files.read_csv(spark, str(tmp_path / "out")).collect()) == ["p1", "p2", "p3"]
