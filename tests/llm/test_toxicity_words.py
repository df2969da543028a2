"""Toxicity reads words to their end and parts them at all that is no letter."""

import pyarrow as pa

from lumengrid.llm import toxicity


def learned(spark):
    rows, labels = [], []
    for i in range(60):
        toxic = i % 2
        rows.append((i, f"plain words {'wonderfulnasty' if toxic else 'wonderfulday'} number 東西南北上下{'悪悪' if toxic else '良良'}中"))
        labels.append((i, toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))


def test_ends_of_long_words_count(spark):
    model = learned(spark)
    texts = ["wonderfulnasty", "wonderfulday", "nice/wonderfulnasty", "a wonderfulnasty", "東西南北上下悪悪中", "東西南北上下良良中"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    nasty, good, joined, spaced, bad, fine = [r.toxic_score for r in toxicity.annotate(df, model).orderBy("i").collect()]
    assert nasty > good and bad > fine
    assert joined > good and spaced > good


def test_words_are_parted_at_non_letters():
    words, own, _, _, _ = toxicity.spelled(pa.array(["nice/toxic one two x-y a1b"]))
    assert [words[i] for i in own] == ["nice", "toxic", "one", "two", "x", "y", "a", "b"]


def test_rare_words_are_learned_in_any_crowd(spark, monkeypatch):
    """An expression of one toxic row counts beside six million other words, and a table that goes by in parts gives the same."""
    rows = [(0, "plain zzyzxqj"), *[(i, "plain " * 200_000) for i in range(1, 31)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, int(i == 0)) for i in range(31)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert model.table.where("gram = '^z' and both > 0").count() == 1
    few = spark.createDataFrame([("zzyzxqj plain", 1), ("plain", 2), (None, 3)], "text string, n int")
    whole = sorted(map(tuple, toxicity.likelihoods(few, model.table, ["both"]).select("n", "toxic_words", "toxic_both").collect()))
    monkeypatch.setattr(toxicity, "PART", 2)
    assert sorted(map(tuple, toxicity.likelihoods(few, model.table, ["both"]).select("n", "toxic_words", "toxic_both").collect())) == whole
    assert whole[0][1:] > (2, 0.0) and whole[1][1] == 1 and whole[2][1:] == (0, 0.0)
