from __future__ import annotations

import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from runscope.llm import language_crf as l
from runscope.llm import quality_fm as q
from runscope.llm.common import held_out
from runscope.llm.queries import QUERIES, language_model

from .helpers import DOCS, awkward, table, words

SF = "/root/testdata/sf0.01"


def test_held_out(spark):
    rows = spark.range(200).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 3 == 1) for r in rows)


# ---- language


def test_forward_backward_against_all_paths():
    r = np.random.default_rng(0)
    k, lengths = 3, np.array([1, 4, 2, 5])
    scores, start, moves = r.normal(size=(lengths.sum(), k)) * 2, r.normal(size=k), r.normal(size=(k, k))
    got, expected = l.forward_backward(scores, lengths, start, moves, pairs=True)
    at, pairs = 0, np.zeros((k, k))
    for n in lengths:
        total, marginal, moved = 0.0, np.zeros((n, k)), np.zeros((k, k))
        for path in itertools.product(range(k), repeat=n):
            e = np.exp(start[path[0]] + sum(scores[at + i, y] for i, y in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:])))
            total += e
            for i, y in enumerate(path):
                marginal[i, y] += e
            for a, b in zip(path, path[1:]):
                moved[a, b] += e
        assert np.allclose(got[at : at + n], marginal / total)
        pairs += moved / total
        at += n
    assert np.allclose(expected, pairs)


def test_language_query_on_held_out_documents(spark):
    given = {r[0]: r[1] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = QUERIES["op1_language_crf"](spark, SF).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(given) and all(0 <= r["score"] <= 1 for r in rows)
    assert np.mean([r["lang_pred"] == given[r["doc_id"]] for r in held]) > 0.97


def test_language_is_not_an_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    model = language_model(docs)
    other = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("y")).withColumn("doc_id", -F.col("doc_id"))
    a = l.identify(docs, model).orderBy("doc_id").collect()
    b = l.identify(other, model).orderBy(F.desc("doc_id")).collect()
    assert [x[1:] for x in a] == [x[1:] for x in b]


def test_learning_from_texts_of_one_long_line(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("text", F.repeat(F.translate("text", "\n", " "), 3))
    model = language_model(docs)
    rows = l.identify(docs.where("n_chars > 300"), model, keep=["doc_id", "lang"]).collect()
    assert len(model.labels) == 4 and np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.95


def test_copies_take_one_place_of_the_sample(spark):
    texts = [f"text {' '.join(words(8, i))}" for i in range(300)]
    other = [f"texte {' '.join(words(8, i))}" for i in range(50)]
    distinct = table(spark, texts).union(table(spark, other, first=1000, lang="fr"))
    copies = table(spark, [t for t in texts for _ in range(500 if t in texts[:5] else 1)])
    copies = copies.union(table(spark, other * 20, first=5000, lang="fr")).repartition(7)
    got = l.sample(copies, "text", "lang")
    assert got == l.sample(distinct, "text", "lang")
    assert len(set(zip(*got))) == len(got[0]) == 250 and got[1].count("en") == 200


def test_code_switched_words(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_model(docs)
    lines = {}
    for r in docs.where("lang IN ('en', 'fr')").orderBy("doc_id").collect():
        found = [x for x in r["text"].split("\n") if 15 < len(x.split()) < 60]
        if found and r["lang"] not in lines:
            lines[r["lang"]] = found[0]
    mixed = f"{lines['en']} {lines['fr']}"
    row = l.identify(table(spark, [mixed]), model, spans=True).first()
    n = len(l.chains_of(lines["en"])[0])
    got = [s["language"] for s in row["spans"] for _ in range(s["words"])]
    assert len(got) == row["n_letter_words"]
    truth = ["en"] * n + ["fr"] * (len(got) - n)
    assert np.mean([a == b for a, b in zip(got, truth)]) > 0.9


def test_language_of_awkward_rows(spark):
    df = awkward(spark, clash=["score"])
    model = l.train(["the cat and the dog", "le chat et le chien"], ["en", "fr"], l.Fit(rounds=10))
    rows = l.identify(df, model, keep=["doc_id", "score"]).collect()
    assert len(rows) == 9
    by = {r["doc_id"]: r for r in rows}
    assert [by[i]["lang_pred"] for i in (2, 3, 4)] == ["und"] * 3 and by[2]["score"] == 0
    assert by[5]["lang_pred"] in ("en", "fr") and by[6]["n_letter_words"] == 1
    assert l.identify(table(spark, []), model).collect() == []
    none = language_model(df.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in l.identify(df, none).collect()} == {"und"}


def test_long_texts_are_read_in_parts(spark):
    model = l.train(["the cat and the dog", "le chat et le chien"], ["en", "fr"], l.Fit(rounds=10))
    long = "the cat and the dog sat\n" * 150_000
    assert "".join(l.parts_of(long)) == long and len(l.parts_of(long)) > 2
    row = l.identify(table(spark, [long, "\u00b2 \u2167 1 _"]), model).orderBy("doc_id").collect()
    assert row[0]["lang_pred"] == "en" and row[0]["n_letter_words"] == 900_000
    assert row[1]["lang_pred"] == "und"


def test_long_lines_are_cut_into_chains():
    text = " ".join(["word"] * (2 * l.CHAIN + 3)) + "\n\n1 2 3\nlast"
    assert l.chains_of(text)[1] == [l.CHAIN, l.CHAIN, 3, 1]


# ---- quality


def test_words_without_letters_are_judged_as_a_whole():
    words = "the (1st and 20th of 1999 -- x".split()
    assert q.statistics(" ".join(words), words, np.arange(len(words)))[-1] == 2 / len(words)


def test_interactions_against_all_pairs():
    r = np.random.default_rng(2)
    owner = np.array([0, 0, 0, 2, 2, 2, 2])
    values, factors = r.normal(size=7), r.normal(size=(7, 4))
    got, _ = q.interactions(owner, values, factors, 3)
    for n in range(3):
        at = np.flatnonzero(owner == n)
        pairs = sum(factors[i] @ factors[j] * values[i] * values[j] for i, j in itertools.combinations(at, 2))
        assert np.isclose(got[n], pairs)


def test_interactions_are_learned():
    """Neither feature tells anything by itself, the two together do."""
    vectors, labels = [], []
    for i in range(400):
        a, b = i & 1, i >> 1 & 1
        vectors.append((np.array([a, 2 + b]), np.array([1.0, 1.0]), np.zeros(len(q.STATISTICS))))
        labels.append(int(a == b))
    model = q.train(vectors, labels, q.Fit(buckets=4, passes=60, rate=0.2))
    for (bucket, value, numbers), y in list(zip(vectors, labels))[:4]:
        raw = q.raw_scores(model, np.zeros(2, int), bucket, value, numbers[None, :])
        assert (raw[0] > 0) == bool(y)


def test_quality_query_on_held_out_documents(spark):
    labels = {r[0]: r[1] for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality").collect()}
    rows = QUERIES["op9_quality_fm"](spark, SF).collect()
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in held]) > 0.95
    assert all(r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in rows)


def test_quality_of_awkward_rows(spark):
    df = awkward(spark, clash=["predicted"])
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 0), (None, 1), (4, None), (99, 1), (5, 1)], "doc_id bigint, quality int")
    model = q.train(*q.sample(df, labels, F.lit(True), "text", "doc_id", "quality"))
    rows = q.score(df, model, keep=["doc_id", "predicted"]).collect()
    assert len(rows) == 9 and all(0 <= r["score"] <= 1 for r in rows)
    by = {r["doc_id"]: r for r in rows}
    assert by[2]["score"] == by[3]["score"]
    assert q.score(table(spark, []), model).collect() == []
    nothing = q.train(*q.sample(df, labels.limit(0), F.lit(True), "text", "doc_id", "quality"))
    assert len(q.score(df, nothing).collect()) == 9


def test_quality_from_metadata_alone(spark):
    """Texts are all alike; a category and a number tell the label only together. Nulls and unseen values are scored too."""
    rows = [(i, "the same text", "ab"[i % 2], [3.0, 5000.0][i // 2 % 2], int(i % 2 == i // 2 % 2)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, site string, size double, quality int")
    about, fit = ["site", "size"], q.Fit(passes=40, rate=0.2)
    sampled = q.sample(df.drop("quality"), df.select("doc_id", "quality"), F.lit(True), "text", "doc_id", "quality", fit, about)
    model = q.train(*sampled, fit)
    found = {r.doc_id: r.predicted for r in q.score(df, model, metadata=about).collect()}
    assert found == {r[0]: r[4] for r in rows}
    odd = spark.createDataFrame([(1, None, None, None), (2, "a\0b", "new", float("nan")), (3, "", "a", float("inf"))], df.drop("quality").schema)
    assert all(0 <= r.score <= 1 for r in q.score(odd, model, metadata=about).collect())
    with pytest.raises(ValueError):
        q.score(df, model)


def test_a_repeated_id_gives_the_same_sample(spark):
    rows = [(i % 50, f"text {i} of several") for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id bigint, quality int")
    samples = []
    for parts in (1, 7):
        df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(parts)
        vectors, marks = q.sample(df, labels, F.lit(True), "text", "doc_id", "quality")
        samples.append(([b.tolist() for b, _, _ in vectors], marks))
    assert samples[0] == samples[1] and len(samples[0][1]) == 50


# ---- pipeline


def stages(spark, docs):
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, ""), corpus_pipeline.shared_folder(spark))
        out[name] = docs
    return out


def test_pipeline(spark, tmp_path):
    clean = [" ".join(words(120, i)) + "." for i in range(4)]
    near = clean[0].replace(clean[0].split()[50], "other", 1)
    mail = " ".join(words(60, 9)) + " write to someone [at] place [dot] org or a.b@c.org now " + " ".join(words(60, 10))
    menu = f"{clean[3]}\nHome | News | Shop | Help | About"
    texts = [clean[0], clean[0], near, clean[1], "too short", None, mail, menu, "$$$ *** " * 30]
    docs = table(spark, texts, first=10)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = stages(spark, docs)
    ids = {k: sorted(r["doc_id"] for r in v.select("doc_id").distinct().collect()) for k, v in got.items()}
    assert ids["quality_rules"] == ids["language"] == [10, 11, 12, 13, 16, 17]
    assert ids["near_duplicates"] == ids["personal_data"] == ids["packing"] == [10, 13, 16, 17]
    for name in list(got)[:-1]:
        assert got[name].columns == docs.columns
        assert all(r["n_chars"] == len(r["text"]) for r in got[name].collect())
    texts = {r["doc_id"]: r["text"] for r in got["personal_data"].collect()}
    assert texts[17] == clean[3] and texts[16].count("[EMAIL]") == 2 and "a.b@c.org" not in texts[16]
    ran = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, ran)) == sorted(map(tuple, got["packing"].collect()))




def test_pipeline_on_awkward_rows(spark):
    docs = awkward(spark, clash=["row", "kept", "score", "root", "_text", "cleaned_text"])
    got = stages(spark, docs)
    for name in list(got)[:-1]:
        assert got[name].columns == docs.columns
    kept = got["personal_data"].collect()
    assert sorted(r["doc_id"] or 0 for r in kept) == [0, 1] and all(r["kept"] == "clash" for r in kept)
    empty = stages(spark, spark.createDataFrame([], DOCS))
    assert all(df.count() == 0 for df in empty.values())
