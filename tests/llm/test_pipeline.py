"""The pipeline's stages, each on what the one before kept."""

from __future__ import annotations

from collections import Counter, defaultdict

import corpus_pipeline
import duckdb
import pytest
import test_corpus as brute
from pyspark.sql import functions as F

from footfall.llm import common, queries


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    folder, docs, found = tmp_path_factory.mktemp("stages"), common.documents(spark, sf_dir), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(str(folder / name))
        before, docs = docs, spark.read.parquet(str(folder / name))
        found[name] = (before, docs)
    return found


def test_stages_keep_columns_and_lose_no_clean_document(stages):
    for name, (before, after) in stages.items():
        if name != "mixing":
            assert after.columns == before.columns
    counts = {k: (a.count(), b.count()) for k, (a, b) in stages.items()}
    assert counts["line_dedup"][0] == counts["line_dedup"][1] and counts["mixing"][0] == counts["mixing"][1]
    rejected = stages["language_id"][0].join(stages["language_id"][1], "doc_id", "left_anti").collect()
    assert all(not any(c.isalpha() for c in r.text or "") or len(r.text.split()) < 5 for r in rejected)


def test_run_gives_the_last_stage(spark, sf_dir, stages):
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(corpus_pipeline.run(spark, sf_dir)) == rows(stages["mixing"][1])


def test_languages_are_brute_force(stages):
    before, after = (df.collect() for df in stages["language_id"])
    learned = [(r.lang, r.text) for r in before if brute.zlib.crc32(str(r.doc_id).encode()) % 5 and r.lang and r.text is not None]
    judge = brute.brute_language(learned, Counter(k for k, _ in learned))
    want = {r.doc_id for r in before if judge(r.text)[0] != "und" and judge(r.text)[1] >= 0.5}
    assert {r.doc_id for r in after} == want


def test_lines_are_those_of_the_sql(stages):
    before, after = stages["line_dedup"]
    documents = before.toPandas()  # noqa: F841  read by the SQL
    want = {r[0]: r[1] for r in duckdb.sql(queries.SQL["op6_line_windows"]).fetchall()}
    length = {r.doc_id: r.n_chars for r in before.collect()}
    for r in after.collect():
        assert r.text == want[r.doc_id]
        assert r.n_chars == (length[r.doc_id] if r.text == next(t for t in documents[documents.doc_id == r.doc_id].text) else len(r.text))


def test_near_copies_are_brute_force(stages):
    before, after = (df.select("doc_id", "text").collect() for df in stages["near_dedup"])
    groups = brute.brute_copies([tuple(r) for r in before])
    assert {r.doc_id for r in after} == {min(i for i, _ in g) for g in groups} and len(groups) < len(before)


def test_passages_are_brute_force(spark, sf_dir, stages):
    before, after = (df.collect() for df in stages["decontamination"])
    bench = {r.item_id: r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    bad = {d for d, _ in brute.brute_overlaps({r.doc_id: r.text for r in before}, bench)}
    assert bad and {r.doc_id for r in after} == {r.doc_id for r in before} - bad


def test_the_mix_is_near_its_targets_and_has_the_texts(stages):
    before, after = (df.collect() for df in stages["mixing"])
    text = {r.doc_id: (r.text, r.source) for r in before}
    size, taken, target = Counter(), Counter(), {}
    for r in after:
        assert text[r.doc_id] == (r.text, r.source) and r["size"] == len(brute.WORD.findall(r.text or "")) and r.taken in (0, r["size"], 2 * r["size"])
        size[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
    want = brute.brute_targets(size)
    for s in size:
        assert abs(target[s] - want[s]) < 1e-6 * want[s]
        sums = {0}
        for r in after:
            sums |= {x + r["size"] for x in sums} if r.source == s else set()
        assert abs(taken[s] - want[s]) <= min(abs(k * size[s] + x - want[s]) for k in (0, 1) for x in sums) + 1


def test_stages_on_odd_rows(spark, sf_dir, tmp_path):
    """Nulls in every column, empty, blank and very long texts, repeated rows and ids, further columns, and an empty table."""
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first().text
    long = " ".join(f"the{i % 701} and{i % 13}" for i in range(30_000))
    clean = "the cat and the dog went to the house and the garden with the other cats and dogs of the town"
    made = [(None, None, None, None, None), (1, None, "en", "web", None), (2, "", None, "web", 0), (3, " \n\t", "en", None, 3), (4, long, "en", "web", 1), (None, clean, None, None, None), (5, f"{clean} {item}", "en", "web", 7), (5, clean + " indeed so", "en", "books", 7), (None, item, None, "web", 0)]
    made += [(6, "la casa y el perro de la calle", "es", "web", 30)] * 2 + [(7, "a\nb\nc\nd\n" + clean, "en", "web", 1), (8, "a\nb\nc\nd\nla casa y el perro", "es", "web", 1)]
    docs = spark.createDataFrame(made, brute.DOC)
    names = ["row key", "node", "part", "size", "row_no", "key", "score", "lang_pred", "lines removed"]
    wide = docs.withColumns({c: F.lit(c) for c in names})
    for frame in (docs, wide):
        now = frame
        for name, stage in corpus_pipeline.STAGES:
            path = str(tmp_path / f"{len(frame.columns)}_{name}")
            stage(spark, now, sf_dir).write.parquet(path)
            now = spark.read.parquet(path)
            if name != "mixing":
                assert sorted(now.columns) == sorted(frame.columns) and (frame is docs or all(r[c] == c for r in now.collect() for c in names))
            assert stage(spark, frame.limit(0), sf_dir).count() == 0
        left = defaultdict(int)
        for r in now.collect():
            left[r.text] += 1
        assert long in left and left[clean] + left[clean + " indeed so"] == 1 and not any(item in (t or "") for t in left)
