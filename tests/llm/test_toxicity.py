"""Toxicity: held-out accuracy, folding, exceptions, odd rows."""

import math
import random
import zlib
from collections import Counter

from pyspark.sql import functions as F

from platen.llm import toxicity
from platen.llm.queries import op9_toxicity


def corpus(n=600, seed=1):
    rnd = random.Random(seed)
    words = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "ne", "pu") for b in ("ra", "si", "to", "ve") for c in ("n", "d", "x", "")]
    insults = ["grubbel", "snorkfen", "vlitzan"]
    rows, labels = [], []
    for i in range(n):
        text = [rnd.choice(words) for _ in range(rnd.randrange(5, 120))]
        toxic = int(rnd.random() < 0.3)
        if toxic:
            for _ in range(1 + len(text) // 40):
                w = rnd.choice(insults)
                text.insert(rnd.randrange(len(text)), rnd.choice([w, w.upper() + "!!", w.replace("e", "3"), w.replace("a", "а"), f"**{w}**"]))
        elif rnd.random() < 0.06:
            text.insert(rnd.randrange(len(text)), "honest grubbel pie")
        rows.append((i, " ".join(text)))
        labels.append((i, 1, toxic))
    return rows, labels


def test_fold():
    assert toxicity.fold("ID10T! ｓｔｕｐｉｄ  мoron") == " idiot stupid мoron " or toxicity.fold("ID10T! ｓｔｕｐｉｄ") == " idiot stupid "
    assert toxicity.fold("sсum tr@sh cl0wn") == " scum trash clown "
    assert toxicity.fold("in 2020 and 13") == " in and " and toxicity.fold(None) == toxicity.fold("...") == "  "


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, marks)
    assert any("honest grubbel" in e or "grubbel pie" in e for e in model.exceptions)
    got = {r.doc_id: r.score for r in toxicity.scores(docs, model).collect()}
    held = [(got[i], t) for i, _, t in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    q = toxicity.quality(held)
    assert q["accuracy"] >= 0.97 and q["precision"] >= 0.95 and q["recall"] >= 0.95 and q["auc"] >= 0.97
    again = toxicity.train(docs.repartition(3), marks)
    assert again.weights == model.weights and again.coefficients == model.coefficients


def test_query_on_the_table(spark):
    got = op9_toxicity(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = got.join(labels, "doc_id").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    # Other languages have a handful of labels here.
    assert toxicity.quality([(r.score, r.toxic) for r in rows if r.held_out and r.lang == "en"])["accuracy"] >= 0.97


def brute_score(model, text):
    """The score by plain searches for every term and phrase at every place."""
    folded = toxicity.fold(text)
    places = lambda term: [i for i in range(len(folded)) if folded.startswith(term, i)]
    strongest, back = {}, 0.0
    for term, weight in model.weights.items():
        if term not in model.exceptions and term in folded:
            for i in places(term):
                strongest[i] = max(strongest.get(i, 0.0), weight)
    for phrase, weight in model.exceptions.items():
        if phrase in folded:
            back += weight * len(places(phrase))
    total = max(math.fsum(strongest.values()) - back, 0.0)
    z = sum(c * f for c, f in zip(model.coefficients, (1.0, float(total > 0), math.log1p(total), total / math.sqrt(len(folded.split()) + 20)), strict=True))
    return 1 / (1 + math.exp(-max(-30, min(30, z))))


def test_scores_and_lexicon_match_brute_force(spark):
    rows, labels = corpus(250, seed=4)
    rows += [(9000, None), (9001, ""), (9002, "grubbel snorkfen " * 50), (9003, "honest grubbel pie " * 3)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, marks)
    got = {r.doc_id: r.score for r in toxicity.scores(docs, model).collect()}
    assert model.weights and got.keys() == {i for i, _ in rows}
    assert all(abs(got[i] - brute_score(model, t)) < 1e-9 for i, t in rows)

    texts = dict(rows)
    taught = [(toxicity.fold(texts[i]), t) for i, _, t in labels if zlib.crc32(str(i).encode()) % 5]
    taught = {(toxicity.print_of(f), t): f for f, t in sorted(taught, reverse=True)}  # near copies once, the least of them
    seen = {0: Counter(), 1: Counter()}
    for (_, t), folded in taught.items():
        words = set(folded.split())
        seen[t].update({f" {w} " for w in words} | {f" {w[:k]}" for w in words for k in toxicity.PREFIXES if len(w) > k})
    kinds = Counter(t for _, t in taught)
    counts = [(term, seen[1][term], seen[0][term]) for term in seen[1] | seen[0]]
    assert toxicity.lexicon(counts, kinds[1], kinds[0]) == model.weights


def test_held_out_rows_teach_nothing(spark):
    rows, labels = corpus(300)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    a, b = (toxicity.train(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (labels, flipped))
    assert a.weights == b.weights and a.coefficients == b.coefficients


def test_odd_rows(spark):
    rows, labels = corpus(200)
    docs = spark.createDataFrame([(*r, 0.1) for r in rows] + [(None, None, 0.2), (5000, "", 0.3), (5000, "", 0.3), (5001, "grubbel " * 20_000, 0.4)], "doc_id long, text string, score double")
    marks = spark.createDataFrame([*labels, (None, 1, 1), (5000, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, marks)
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns and kept.filter("doc_id = 5001").count() == 0
    assert kept.filter("doc_id = 5000").count() == 2 and kept.filter("doc_id is null").count() == 1
    assert toxicity.train(docs, marks.filter(F.lit(False))).coefficients == () and toxicity.train(docs.filter(F.lit(False)), marks).coefficients == ()
    assert toxicity.scores(docs, toxicity.Model()).agg(F.max("score")).first()[0] == 0
    assert toxicity.without_toxic(docs.filter(F.lit(False)), model).count() == 0
