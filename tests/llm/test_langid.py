"""Language identification: held-out accuracy, backoff and awkward rows."""

import random
from collections import Counter

from pyspark.sql import functions as F

from risewatch.llm import langid
from risewatch.llm.queries import op3_language_id
from tests.llm.helpers import docs


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    given = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    out = op3_language_id(spark, sf_dir)
    assert out.count() == given.count()
    right = out.join(given, "doc_id").where("held_out").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0]
    assert right > 0.97
    assert out.where("score < 0 OR score > 1").count() == 0


def small_model(spark):
    english, german = docs(spark, ["the thing is the other thing"] * 3), docs(spark, ["das ding ist das andere ding"] * 3, "de")
    german = german.withColumn("doc_id", F.col("doc_id") + 10)
    return langid.fit(english.unionByName(german))


def test_words_come_before_grams_and_unseen_words_back_off(spark):
    model = small_model(spark)
    assert model.langs == ["de", "en"]
    assert model.rows("the") == [model.words["the"]]
    assert "thinging" not in model.words and len(model.rows("thinging")) > 1
    unseen, german, foreign, the = model.scores(["thinging", "dingas", "жж", "the"])
    assert unseen[1] > unseen[0] and german[0] > german[1] and the[1] > the[0]
    # Nothing but a word's end is known: hardly any language is favoured.
    assert abs(foreign[0] - foreign[1]) < 0.1


def test_runs_without_spaces_teach_their_grams(spark):
    r = random.Random(5)
    texts = ["".join(r.choices("あいうえおかきくけこ", k=k)) for k in (41, 61, 62, 63, 64, 65, 126, 127, 128, 3000)]
    spaceless = docs(spark, texts, "ja").withColumn("doc_id", F.col("doc_id") + 100)
    model = langid.fit(docs(spark, ["the thing is the other thing"] * 3).unionByName(spaceless), longest=3)
    want = Counter(p[i : i + n] for p in (f"\x02{t}\x02" for t in texts) for n in (1, 2, 3) for i in range(len(p) - n + 1))
    assert {g for g in want if g != "\x02"} <= model.grams.keys() and not any(len(w) > 40 for w in model.words)
    counts = spark.createDataFrame([("ja", t, 1) for t in texts], "lang string, word string, n long")
    assert {r.gram: r.n for r in langid._grams(counts, 3).collect()} == want
    assert [r.lang_pred for r in langid.predict(docs(spark, ["かきくけこ" * 20, "the thing"]), model).collect()] == ["ja", "en"]


def test_odd_rows(spark):
    model = small_model(spark)
    given = docs(spark, [None, "", "12 ½ ²³ ...", "the thing", "The THING " * 20_000, "das ding", "das ding"], None)
    given = given.withColumn("score", F.lit("clash"))
    found = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(given, model).collect()}
    assert [found[i][0] for i in range(7)] == ["und", "und", "und", "en", "en", "de", "de"]
    assert found[0][1] == 0 and found[5] == found[6] and found[4][1] > 0.9
    kept = langid.keep_recognised(given, model, 0.5)
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6] and kept.columns == given.columns
    assert langid.predict(given.limit(0), model).count() == 0
    nothing = langid.fit(given)  # no labelled row
    assert {r.lang_pred for r in langid.predict(given, nothing).collect()} == {"und"}
