"""The pipeline on planted documents, stage by stage against brute force."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_operators import SPACES, benchmark_brute, near_components, plain_base_spans, prose, water

import corpus_pipeline
from menuloom.llm import toxicity

BAD = ["blarg", "snorkfool", "dweebish", "grubber"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, rows, labels = random.Random(11), [], []
    items = [(n, prose(rng, 30, 5000)) for n in range(5)]
    for i in range(400):
        w = prose(rng, rng.randrange(30, 120), 900).split()
        bad = i % 5 == 0
        for _ in range(3 if bad else 0):
            w.insert(rng.randrange(len(w)), rng.choice(BAD))
        labels.append((i, 1, int(bad)))
        if i % 17 == 1:
            w += ["reach", f"me{i}@mail.example", "or", "+1 (377) 555-0271"]
        rows.append((i, " ".join(w)))
    clean = [t for i, t in rows if i % 5]
    rows += [(1000 + i, clean[i]) for i in range(20)] + [(1100 + i, clean[i] + " tail") for i in range(20)]
    rows += [(1200 + i, items[i][1] + " and more " + prose(rng, 20, 900)) for i in range(5)]
    rows += [(1300, prose(rng, 900, 5000) + " " + items[0][1][:]), (1400, ""), (1401, None)]
    rows = [(i, t, ("en", None)[i % 2], ("a", "b", "b", "c", None)[i % 5], None if t is None else len(t)) for i, t in rows]
    at = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, after = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, after[-1], folder)
        if name != "mixing":
            assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        after.append(spark.read.parquet(str(tmp_path / name)))
    start, calm, single, free, clean, mixed = after
    before, kept = texts(start), texts(calm)
    # Toxic documents go, all others stay as they are.
    assert {i for i in before if before[i] and any(w in before[i].split() for w in BAD)} == set(before) - set(kept)
    assert all(before[i] == t for i, t in kept.items())
    # One document of each group of near copies stays: the first.
    parts = [eval(x) for x in near_components(list(kept.items()))]  # noqa: S307
    assert set(texts(single)) == {i for i, _, _, stays in parts if stays} and len(texts(single)) < len(kept) - 30
    # Contaminated documents go; a passage in a long document is cut out.
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    judged = [eval(x) for x in benchmark_brute(list(texts(single).items()), items, 13)]  # noqa: S307
    bad = {i for i, n, hit, _ in judged if hit and 20 * hit >= n}
    assert set(texts(free)) == set(texts(single)) - bad and bad >= {1200 + i for i in range(5)}
    assert 1300 in texts(free) and len(SPACES.findall(texts(free)[1300])) == 900
    # No base span is left, and texts without one are untouched.
    for i, t in texts(clean).items():
        found = plain_base_spans(texts(free)[i] or "")
        assert not plain_base_spans(t or "") and (found or t == texts(free)[i])
    assert all(r["text"] is None or r["n_chars"] == len(r["text"]) for r in clean.collect())
    # The mix takes each source's target.
    sizes = Counter()
    for r in clean.collect():
        sizes[r["source"]] += len(SPACES.findall(r["text"] or ""))
    want, got = water(sizes), Counter()
    assert mixed.count() == clean.count() and set(columns) <= set(mixed.columns)
    for r in mixed.collect():
        got[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"] and r["target"] == pytest.approx(want[r["source"]])
    assert all(want[s] - 2 <= got[s] <= want[s] + 1e-6 for s in want)


def test_run_gives_what_the_stages_give(spark, folder):
    once, again = (corpus_pipeline.run(spark, folder) for _ in range(2))
    key = lambda df: sorted(map(str, df.collect()))
    assert once.count() > 200 and key(once) == key(again)
    assert once.where(F.col("text").contains("@mail")).count() == 0


def test_scores_of_the_stage_are_those_of_the_query(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    low = {r["doc_id"] for r in toxicity.toxicity(docs, labels).where("predicted = 0").collect()}
    assert low == set(texts(corpus_pipeline.drop_toxic(spark, docs, folder)))
