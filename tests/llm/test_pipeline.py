"""The pipeline against its stages by brute force."""

import corpus_pipeline
from platen.llm import pii, toxicity
from platen.llm.queries import tokenizer_path
from tests.llm.test_neardup import brute
from tests.llm.test_tokens import check_pieces

SF = "/root/testdata/sf0.001"


def test_pipeline_matches_brute_force(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    automaton = model.automaton()
    clean = [(r.doc_id, r.text) for r in docs.collect() if model.score(model.features(toxicity.fold(r.text), automaton)) < 0.5]
    groups = brute(clean, size=5)
    left = {i: pii.redact(t, pii.find(t)) for i, t in clean if groups[i][1] == i}
    library = Tokenizer.from_file(tokenizer_path())
    expected = {i: [*library.encode(t, add_special_tokens=False).ids, 0] for i, t in left.items()}
    rows = corpus_pipeline.run(spark, SF).collect()
    check_pieces(rows, expected)
    assert 0 < len(expected) < docs.count()


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert docs.filter("n_chars <> length(text)").count() == 0


def test_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_odd_documents(spark, tmp_path):
    """Nulls, empty texts, repeated rows and ids, a column with an operator's name; then no rows at all."""
    from tokenizers import Tokenizer

    base = " ".join(f"w{i}" for i in range(40))
    rows = [(1, base, "en", None, 9, "x"), (1, base, "en", None, 9, "x"), (1, "another text of the first", None, "s", 1, "x"), (2, base + " more", "en", "s", 2, "x"), (3, None, "en", "s", 3, None), (4, "", None, None, None, "x"), (None, base, "en", "s", 5, "x")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, node string"
    for name, some in (("odd", rows), ("none", [])):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame(some, schema).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        got = corpus_pipeline.run(spark, folder).collect()
        library = Tokenizer.from_file(tokenizer_path())
        size = lambda t: len(library.encode(t, add_special_tokens=False).ids) + 1
        kept = [(1, base), (1, "another text of the first"), (3, ""), (4, ""), (None, base)] if some else []
        assert sum(r.length for r in got) == sum(size(t) for _, t in kept)
        assert sorted({(str(r.doc_id), r.doc_tokens) for r in got}) == sorted((str(i), size(t)) for i, t in kept)
