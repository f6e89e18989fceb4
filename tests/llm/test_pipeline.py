"""The pipeline on a small corpus with planted cases."""

import random

import corpus_pipeline
import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = {"en": ["the", "ing", "er", "on", "ly", "st", "ou"], "fr": ["que", "eau", "oi", "ment", "les", "ai", "tion"]}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 5))) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(21)
    folder = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, "\n".join(prose(rng, lang, 60) for _ in range(3)), lang) for i in range(60) for lang in [rng.choice(["en", "fr"])]]
    leak = " ".join(rows[0][1].split()[100:130])
    rows.append((100, rows[5][1], rows[5][2]))  # an exact copy
    edited = rows[6][1].split(" ")
    edited[::29] = ["changed"] * len(edited[::29])
    rows.append((101, " ".join(edited), rows[6][2]))  # a near copy
    rows.append((102, prose(rng, "en", 50) + "\n" + rows[7][1].split("\n")[1] + "\n" + prose(rng, "en", 50), "en"))  # a passage
    item = prose(rng, "en", 40)
    rows.append((103, prose(rng, "en", 60) + " " + item + " " + prose(rng, "en", 60), "en"))  # a benchmark item
    rows.append((104, "12 34 !!", None))
    rows.append((105, None, None))
    spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, dict((i, t) for i, t, _ in rows), leak


def test_stages_decide_and_keep_clean_documents(spark, corpus):
    folder, texts, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        assert docs.columns == corpus_pipeline.COLUMNS
        seen.append({r.doc_id: r.text for r in docs.collect()})
    language, lines, near, bench = seen
    assert set(texts) - set(language) == {104, 105}
    assert set(language) - set(lines) == {100} and lines[102] != texts[102] and all(lines[i] == texts[i] for i in range(60))
    assert set(range(60)) <= set(near) and set(bench) == set(near) - {103}
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == set(bench)


def test_run_gives_the_same_rows(spark, corpus):
    folder, _, _ = corpus
    got = corpus_pipeline.run(spark, folder)
    ids = {r.doc_id for r in got.select("doc_id").distinct().collect()}
    assert set(range(60)) <= ids and not ids & {100, 103, 104, 105}
    assert got.agg({"length": "sum"}).first()[0] > 0


def staged(spark, folder, docs):
    """The documents after each stage but the last, and the pieces of the last."""
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == corpus_pipeline.COLUMNS
    return docs, corpus_pipeline.STAGES[-1][1](spark, docs, folder)


def test_stages_of_an_empty_table(spark, corpus):
    folder, *_ = corpus
    docs, pieces = staged(spark, folder, spark.createDataFrame([], DOCS))
    assert docs.count() == 0 and pieces.count() == 0


def test_run_of_an_empty_table_and_benchmark(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


def test_stages_with_extra_columns_nulls_and_repeated_rows(spark, corpus):
    folder, texts, _ = corpus
    rng = random.Random(4)
    clean = [(i, "\n".join(prose(rng, lang, 60) for _ in range(3)), lang) for i in range(200, 216) for lang in [rng.choice(["en", "fr"])]]
    rows = [(i, t, lang, "s", len(t)) for i, t, lang in clean] + [(i, texts[i], None, None, None) for i in range(30)]
    rows += [rows[0]] * 3 + [(None, clean[1][1], "en", "s", 1), (300, "", "en", "s", 0), (301, None, "fr", None, None), (302, "1 2 3", None, "s", 5), (303, clean[2][1], "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    for c in ("sig", "key", "th", "words", "h", "component_id", "start", "__text", "slot", "n"):
        docs = docs.withColumn(c, docs.doc_id * 0)
    left, pieces = staged(spark, folder, docs.repartition(3))
    found = {(r.doc_id, r.text) for r in left.collect()}
    ids = {i for i, _ in found}
    # Clean documents stay as they are; empty, letterless and null texts go, as do copies under a later id and rows without an id.
    assert {(i, t) for i, t, _ in clean} <= found and not ids & {300, 301, 302, 303, None}
    assert {i for i in range(30)} <= ids
    placed = {r.doc_id for r in pieces.select("doc_id").distinct().collect()}
    assert placed == ids
