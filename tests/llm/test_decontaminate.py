"""Edit matching against plain dynamic programming."""

from __future__ import annotations

import random

import numpy as np
import pytest

from twinpath.llm import decontaminate, queries


def least_edits(pattern, text):
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (p != c)))
        row = new
        best = min(best, row[-1])
    return best


@pytest.mark.parametrize("seed", range(60))
def test_every_stretch_within_the_budget_is_found(seed):
    rng = random.Random(seed)
    letters = lambda n: "".join(rng.choice("abcde ") for _ in range(n))
    item = decontaminate.normalised(letters(rng.randint(10, 150))) or "x"
    copy = list(item)
    for _ in range(rng.randint(0, 14)):
        i = rng.randrange(len(copy))
        copy[i : i + 1] = rng.choice([[], ["z"], [copy[i], "y"]]) if len(copy) > 4 else ["z"]
    text = decontaminate.normalised(letters(80) + "".join(copy) + letters(80))
    finder = decontaminate.Finder([(7, item)], 0.08)
    edits = least_edits(item, text)
    found = finder.matches(text)
    assert [f[1] for f in found] == ([edits] if edits <= finder.items[0].budget else [])


def test_budgets():
    assert [decontaminate.budget(n, 0.08) for n in (0, 7, 15, 100, 400)] == [0, 0, 0, 8, 32]


def test_rows(spark):
    item = "the quick brown fox jumps over the lazy dog and runs into the deep dark forest"
    docs = spark.createDataFrame([(1, f"Some words. {item.upper()}\n more"), (2, item.replace("brown", "brwn")), (3, "nothing here"), (4, None), (5, ""), (5, ""), (None, item)], "doc_id long, text string")
    bench = spark.createDataFrame([(10, item), (11, None), (12, ""), (13, item)], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"], r["distance"]) for r in decontaminate.matches(docs, bench).collect()}
    assert found == {(d, i, e) for i in (10, 13) for d, e in ((1, 0), (2, 1), (None, 0))}
    assert sorted(r["doc_id"] for r in decontaminate.clean(docs, bench).collect()) == [3, 4, 5, 5]
    small = {(r["doc_id"], r["item_id"], r["distance"]) for r in decontaminate.matches(docs, bench, block_chars=1).collect()}
    assert small == found
    assert sorted(r["doc_id"] for r in decontaminate.clean(docs, bench, block_chars=1).collect()) == [3, 4, 5, 5]
    assert decontaminate.matches(docs.limit(0), bench).count() == 0 and decontaminate.matches(docs, bench.limit(0)).count() == 0


@pytest.mark.parametrize(("item", "text", "found"), [("yes", "eyes", False), ("yes", "oh yes!", True), ("yes", "eyes, yes", True), ("a cat", "a catalogue", False), ("a cat", "a cat", True), ("(b)", "a(b)c", True), ("short item", "a short item2", False)])
def test_short_items_are_whole_words(item, text, found):
    assert bool(decontaminate.Finder([(1, item)], 0.08).matches(text)) == found


def by_programming(docs, items):
    """(document, item, least edits against any stretch) within the budgets: a column of all items' cells at a time."""
    sizes = np.array([len(x) for _, x in items])
    firsts = np.cumsum(sizes) - sizes
    letters = np.array([ord(c) for _, x in items for c in x], dtype=np.int32)
    place = np.concatenate([np.arange(1, n + 1) for n in sizes]).astype(np.int32)
    # the cells of a later item are far below those of an earlier one, so that a running minimum starts anew with each
    shift = place + np.repeat(np.arange(len(items), dtype=np.int32) * 10_000, sizes)
    differs, found = {}, set()
    for doc_id, text in docs:
        cells = place.copy()
        best = sizes.astype(np.int32)
        for c in decontaminate.normalised(text or ""):
            wrong = differs.setdefault(c, (letters != ord(c)).astype(np.int32))
            above = np.empty_like(cells)
            above[1:] = cells[:-1]
            above[firsts] = 0
            np.minimum(above + wrong, cells + 1, out=cells)
            cells = np.minimum.accumulate(cells - shift) + shift
            best = np.minimum(best, cells[firsts + sizes - 1])
        found |= {(doc_id, i, int(e)) for (i, x), e in zip(items, best, strict=True) if e <= decontaminate.budget(len(x), decontaminate.ERROR_RATE)}
    return found


def tables_of(spark, folder):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    return docs, [(r["item_id"], decontaminate.normalised(r["text"])) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]


def test_query_against_dynamic_programming(spark, tables):
    rows = [(r["doc_id"], r["item_id"], r["distance"]) for r in queries.op2_decontaminate(spark, tables).collect()]
    expected = by_programming(*tables_of(spark, tables))
    assert set(rows) == expected and len(rows) == len(expected)


def test_query_on_edited_items(spark, tables, tmp_path):
    """Copies with about as many edits as the budget allows, some fewer and some more."""
    rng, (docs, items) = random.Random(11), tables_of(spark, tables)
    made = []
    for number in range(60):
        copy = list(rng.choice(items)[1])
        for _ in range(round(len(copy) * rng.uniform(0, 0.14))):
            i = rng.randrange(len(copy))
            copy[i : i + 1] = rng.choice([[], ["z"], [copy[i], "y"]])
        made.append((number, (rng.choice(docs)[1] or "")[:400] + " " + "".join(copy).upper() + "\n\n" + (rng.choice(docs)[1] or "")[:400]))
    spark.createDataFrame(made, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{tables}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(r["doc_id"], r["item_id"], r["distance"]) for r in queries.op2_decontaminate(spark, str(tmp_path)).collect()]
    assert set(rows) == by_programming(made, items) and len(rows) == len(set(rows)) and 20 < len(rows) < 60 and sum(e > 0 for _, _, e in rows) > 15
