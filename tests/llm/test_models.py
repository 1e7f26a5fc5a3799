"""Held-out accuracy of the trained operators, the SQL twin of mixing, and the pipeline."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestack.llm import langid, mixing, quality, queries, secrets, simhash
from lodestack.llm.workspace import Workspace

DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


def test_quality_on_held_out_rows(spark, docs):
    work = Workspace(spark)
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    scored = quality.score(docs, quality.fit(docs, labels, work))
    right = scored.join(labels, "doc_id").where("held_out").select(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0]
    assert scored.count() == docs.count() and right > 0.95
    odd = spark.createDataFrame([(None, None), (1, "")], "doc_id long, text string")
    assert quality.score(odd, quality.fit(docs, labels.limit(0), work)).where("score = 0.5").count() == 2


def test_language_on_held_out_rows(spark, docs):
    model = langid.fit(docs)
    found = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id")
    assert found.where("held_out").select(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0] > 0.97
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 ?!")], "doc_id long, text string")
    assert {r["lang_pred"] for r in langid.identify(odd, model).collect()} == {"und"}
    mixed = "the and is of thtion the and in " * 4 + "les eaux de la mentre elle que des " * 4
    assert [x for _, _, x in model.spans(mixed)] == ["en", "fr"]
    assert langid.identify(docs.limit(3), langid.fit(docs.limit(0))).where("lang_pred = 'und'").count() == 3


def test_mixing_equals_its_sql(spark):
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{DIR}/documents.parquet'")
    found = queries.op1_mix_sources(spark, DIR)
    columns = sorted(found.columns)
    assert sorted(map(tuple, found.select(*columns).collect())) == sorted(duck.execute(f"select {', '.join(columns)} from ({mixing.sql(queries.RECIPE, queries.DOMAIN_SQL)})").fetchall())


def test_shortage_goes_to_siblings_first(spark):
    rows = [("a", "en", "s1", 10), ("a", "en", "s2", 1000), ("b", "en", "s3", 1000)]
    leaves = mixing.leaf_budgets(spark.createDataFrame(rows, "domain string, lang string, source string, tokens long"), mixing.Recipe(max_epochs=1, budget_num=600, budget_den=2010))
    assert {r["source"]: r["budget"] for r in leaves.collect()} == {"s1": 10, "s2": 290, "s3": 300}


def test_mixing_edges(spark):
    rows = [(1, None, "en", "s1"), (None, "a b", "en", "s1"), (2, "a b c", None, None), (2, "a b c", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = mixing.mix(docs, mixing.Recipe(budget_num=3, budget_den=2), F.col("source")).collect()
    assert sum(r["tokens_taken"] for r in found) == 9 and {r["doc_id"] for r in found} == {2}


def test_near_copies_of_the_stage(spark):
    words = [f"w{i}" for i in range(300)]
    texts = [words, words[:150] + ["x"] + words[151:], [f"v{i}" for i in range(300)], words[:150] + [f"u{i}" for i in range(150)]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates_checked(docs).collect()} == {0: 0, 1: 0, 2: 2, 3: 3}


def test_pairs_near_the_threshold(spark):
    """Pairs of two texts, which no third one joins: all of 0.8 to 0.85 are found, and none below 0.8."""
    rng = random.Random(5)
    texts = []
    for n in range(600):
        words = [f"w{n}x{i}" for i in range(rng.choice([60, 150, 300]))]
        changed = set(rng.sample(range(2, len(words) - 2), max(1, round(len(words) * rng.uniform(0.017, 0.03)))))
        texts += [words, [f"c{n}x{i}" if i in changed else w for i, w in enumerate(words)]]
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    like = [len(a & b) / len(a | b) for a, b in zip(sets[::2], sets[1::2], strict=True)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates_checked(docs).collect()}
    band = [n for n, x in enumerate(like) if 0.8 <= x < 0.85]
    assert len(band) > 100 and [n for n in band if found[2 * n + 1] != 2 * n] == []
    assert [n for n, x in enumerate(like) if x < 0.8 and found[2 * n + 1] == 2 * n] == []


def test_one_fingerprint_is_not_one_text(spark):
    """A line that is repeated outvotes all else in a fingerprint of repeats; the distinct shingles tell these texts apart and know the copy."""
    line = " ".join(f"line{i}" for i in range(11))
    own = [" ".join(f"{x}{i}" for i in range(300)) for x in "ab"]
    texts = [f"{own[0]} " + f"{line} " * 400, f"{own[1]} " + f"{line} " * 400, f"{own[0]} " + f"{line} " * 2]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert len({simhash.fingerprint(simhash.shingle_hashes(t.encode(), 5)) for t in texts[:2]}) == 1
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates_checked(docs).collect()} == {0: 0, 1: 1, 2: 0}


def test_near_copies_against_brute_force(spark):
    rng = random.Random(8)
    texts = []
    for _ in range(60):
        words = [f"w{rng.randrange(900)}" for _ in range(rng.choice([60, 200, 500]))]
        texts.append(words)
        for _ in range(3):
            changed = {rng.randrange(len(words)) for _ in range(rng.randrange(1, 1 + len(words) // 45))}
            texts.append([f"c{rng.randrange(900)}" if i in changed else w for i, w in enumerate(words)])
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    likeness = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in range(len(texts)) for j in range(i)}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)] + [(None, "a b"), (7, " ".join(texts[7]))], "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates_checked(docs).collect() if r["doc_id"] is not None}
    root = list(range(len(texts)))
    for _ in range(4):
        for (i, j), like in likeness.items():
            if like >= 0.8:
                root[i] = root[j] = min(root[i], root[j])
    near = [(i, j) for (i, j), like in likeness.items() if like >= 0.8]
    assert all(root[i] == root[c] for i, c in found.items()) and len(near) > 60
    assert sum(found[i] == found[j] for i, j in near) >= 0.93 * len(near)


def test_stages_on_odd_rows(spark):
    """Nulls in any column, blank and repeated rows, extra columns of clashing names, and no rows at all."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, fp long, first_id long, score double, key string"
    good = "the people of the valley kept a long account of every winter that came over the hills. " * 3
    rows = [(None, good, None, None, None), (1, None, "en", "s1", 0), (2, "", "en", None, None), (3, good + "a key", None, "s1", 9), (3, good + "a key", None, "s1", 9), (4, good * 900, "en", "s1", 5)]
    for made in ([(*r, 1, 2, 0.5, "k") for r in rows], []):
        work, now = Workspace(spark), spark.createDataFrame(made, schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = work.save(stage(spark, now, DIR))
            assert now.columns == [x.split()[0] for x in schema.split(", ")] and bool(made) >= bool(now.count()), name
        assert corpus_pipeline.packed(spark, now, DIR).count() >= now.count()


def test_rows_of_one_id_are_judged_by_their_texts(spark):
    """Unlike texts of an id both stay, like ones leave one row, in mixing each row keeps its own part."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a, 0), (5, a, 1), (5, b, 2), (5, b, 3), (5, b + " more", 4), (6, c, 5), (None, a, 6), (None, a, 7)]
    made = spark.createDataFrame([(*r, "en", "s1", r[2], r[2], r[2]) for r in rows], "doc_id long, text string, n_chars long, lang string, source string, _key long, _taken long, epoch long")
    for _ in range(2):
        kept = corpus_pipeline.one_of_each(spark, made.repartition(3), DIR)
        assert kept.columns == made.columns
        found = [(r["doc_id"], r["text"], r["n_chars"]) for r in kept.collect()]
        assert sorted((x for x in found if x[0] is not None), key=str) in ([(1, a, 0), (5, b, 2), (6, c, 5)], [(1, a, 0), (5, b + " more", 4), (6, c, 5)])
        assert sum(x[0] is None for x in found) == 2
    unlike = made.where("n_chars in (0, 1, 2, 5)")
    mixed = corpus_pipeline.mixed(spark, unlike, DIR)
    assert mixed.columns == made.columns and {(r["doc_id"], r["text"][0]) for r in mixed.collect()} == {(1, "a"), (5, "a"), (5, "b"), (6, "c")}
    assert mixed.count() == 4


def test_pipeline_stages(spark, docs):
    work, now = Workspace(spark), docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = work.save(stage(spark, now, DIR))
        assert now.columns == docs.columns and now.dtypes == docs.dtypes and now.count(), name
    assert now.where(F.col("text").rlike('token = "[0-9a-f]{40}"')).count() == 0
    packed = corpus_pipeline.packed(spark, now, DIR)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 1024


def test_a_field_that_learnt_nothing_adds_nothing(spark):
    docs = spark.createDataFrame([(None, "plain words 12345 and token=abcdefgh12345678 here", 1)], "doc_id long, text string, n_chars long")
    field = secrets.fit(docs)
    assert secrets.scan(docs, field).first()["spans"] == "assign:22:44"
    assert secrets.redact(docs, field).first()["text"] == "plain words 12345 and [secret] here"


def test_too_many_languages_are_refused(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 3)
    docs = spark.range(40).selectExpr("id as doc_id", "concat('l', id % 4) as lang", "'some words' as text")
    with pytest.raises(ValueError, match="more than 3 languages"):
        langid.fit(docs)
    assert len(langid.fit(docs.where("lang <> 'l0'")).languages) == 3
