"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding lower-cases, maps look-alike letters and full-width forms to plain
letters, digits and signs inside words to the letters that they stand for, and
every other sign to a space. The lexicon holds whole words and word beginnings
(which stand for families of inflected or compounded words); weights are
smoothed log-odds of document frequencies in labelled training rows. Exception
phrases are pairs of a lexicon word and a neighbour that training shows to be
harmless; they take the weight of the word back. The summed weight, its share
of the text's words and whether there is any enter a logistic regression, which gives the score.

Training uses at most about `bound` labelled rows, chosen by a hash of doc_id
(a documented bound on the fit only); scoring reads every whole text.

Defined cases: null and empty texts get the score of a text without matches;
labels that are null are not learned from, a doc_id labelled both ways counts as
toxic; with no labelled rows of both kinds every score is 0; rows with a null
doc_id are scored, and held_out is false; repeated rows give repeated rows; other columns
are not read (filtering keeps them).
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platen.llm.bpe import few_rows, text_column
from platen.llm.held import claim
from platen.llm.tables import dropped, stored

TRAIN_ROWS = 20_000
MIN_TOXIC = 5  # toxic documents that a term needs at least, and
MIN_PART = 0.01  # the part of all toxic documents
FAMILY = 0.6  # a beginning stands for a family if no word makes up more of its documents
MIN_ODDS = 2.0
MIN_SHARE = 0.8  # of a term's documents that are toxic
PREFIXES = (3, 4, 5, 6, 7)
MAX_TERMS = 5_000
MIN_HARMLESS = 3

# Letters that look like Latin ones, and signs that stand for letters.
LOOK_ALIKES = str.maketrans("аеорсухіјѕһԁԛԝοαερτυνκιηωɑɡıʟ", "aeopcyxijshdqwoaeptuvkinwagil")
STANDS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l", "€": "e"}

_SIGN = re.compile(r"(?<=[^\W\d_])[013457@$!|€](?=[^\W\d_])|(?<=[^\W\d_])[01345](?=\b)|\b[013457](?=[^\W\d_]{2})|(?<=[^\W\d_])[013457@$!|€](?=[013457@$!|€][^\W\d_])|(?<=[^\W\d_][013457])[013457@$!|€](?=[^\W\d_])")
_GAP = re.compile(r"[\W\d_]+")
_FULL_WIDTH = re.compile(r"[！-～]")
_MARKS = re.compile(r"[​-‏⁠﻿­̀-ͯ]")
_ODD = re.compile(r"[^\x00-\xff]")


def fold(text: str | None) -> str:
    """Words of plain letters, each between single spaces, with a space at both ends."""
    text = text or ""
    if _ODD.search(text):
        text = _MARKS.sub("", text)
        text = _FULL_WIDTH.sub(lambda m: chr(ord(m[0]) - 0xFEE0), text).lower().translate(LOOK_ALIKES)
    text = _SIGN.sub(lambda m: STANDS_FOR[m[0]], text.lower())
    return f" {_GAP.sub(' ', text).strip()} "


def terms_of(folded: str) -> set[str]:
    """' word ' for whole words and ' begin' for beginnings of longer words."""
    words = set(folded.split())
    out = {f" {w} " for w in words}
    for k in PREFIXES:
        out.update(f" {w[:k]}" for w in words if len(w) > k)
    return out


@dataclass
class Model:
    """What training gives: terms and exception phrases with weights, and coefficients."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: dict[str, float] = field(default_factory=dict)
    coefficients: tuple[float, ...] = ()

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for term, w in (*self.weights.items(), *self.exceptions.items()):
            a.add_word(term, (len(term), w, term in self.exceptions))
        if len(a):
            a.make_automaton()
        return a

    def features(self, folded: str, automaton) -> tuple[float, float, float]:
        best: dict[int, float] = {}
        back = 0.0
        if len(automaton):
            for end, (size, weight, exception) in automaton.iter(folded):
                at = end - size + 1
                if exception:
                    back += weight
                elif weight > best.get(at, 0.0):  # of the terms that start a word together, the strongest counts
                    best[at] = weight
        total = max(sum(best.values()) - back, 0.0)
        words = folded.count(" ") - 1 if folded.strip() else 0
        return float(total > 0), math.log1p(total), total / math.sqrt(words + 20)

    def score(self, features: tuple[float, float, float]) -> float:
        if not self.coefficients:
            return 0.0
        z = self.coefficients[0] + sum(c * f for c, f in zip(self.coefficients[1:], features, strict=True))
        return 1 / (1 + math.exp(-max(min(z, 30), -30)))


def lexicon(counts: list[tuple[str, int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Weights of terms from (term, toxic documents, clean documents).

    A beginning is kept where several words share it and no shorter one explains
    it; a word that has a family's beginning is not kept beside it.
    """
    found = {}
    least = max(MIN_TOXIC, MIN_PART * toxic)
    for term, a, b in counts:
        odds = math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (clean + 1))
        # The share is taken as if both kinds were equally frequent.
        share = (a / max(toxic, 1)) / (a / max(toxic, 1) + b / max(clean, 1))
        if a >= MIN_TOXIC and odds >= MIN_ODDS and share >= MIN_SHARE:
            found[term] = (odds, a)
    most: dict[str, int] = {}  # of each beginning: the documents of its most frequent word
    for term, (_, a) in found.items():
        if term[-1] == " ":
            for k in PREFIXES:
                most[term[: k + 1]] = max(most.get(term[: k + 1], 0), a)
    kept: dict[str, float] = {}
    for term in sorted(found, key=lambda t: (t[-1] == " ", len(t), t)):
        odds, a = found[term]
        shorter = [kept[term[: k + 1]] for k in PREFIXES if k + 1 < len(term) and term[: k + 1] in kept]
        whole = term[-1] == " "
        if a >= least and (whole or most.get(term, 0) <= FAMILY * a) and not any(w >= odds - 1.0 for w in shorter):
            kept[term] = odds
    strongest = sorted(kept, key=lambda t: (-kept[t] * math.sqrt(found[t][1]), t))[:MAX_TERMS]
    return {t: kept[t] for t in strongest}


def print_of(folded: str) -> int:
    """A MinHash coordinate over the word triples: near copies mostly share it."""
    words = folded.split()
    return min((zlib.crc32(" ".join(words[i : i + 3]).encode()) for i in range(max(1, len(words) - 2))), default=0)


def fit(features: np.ndarray, labels: np.ndarray) -> tuple[float, ...]:
    """Ridge logistic regression by Newton steps."""
    x = np.hstack([np.ones((len(features), 1)), features])
    beta = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], 0.05)
    ridge[0] = 1e-6
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge) + 1e-9 * np.eye(len(beta)), x.T @ (labels - p) - ridge * beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(b) for b in beta)


def held_out(column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def exceptions_of(pairs: list[tuple[str, str, int, int]], weights: dict[str, float]) -> dict[str, float]:
    """Phrases around a term that mostly stand in clean documents take back the term's weight."""
    return {phrase: weights[term] for phrase, term, a, b in pairs if b >= MIN_HARMLESS and b > 4 * a}


def phrases_of(folded: str, automaton) -> set[tuple[str, str]]:
    """(phrase, term) of each matched term with the word before or after it."""
    out = set()
    for end, (size, _, _) in automaton.iter(folded):
        at = end - size + 1
        stop = folded.find(" ", at + 1)
        word = folded[at : stop + 1]
        before = folded.rfind(" ", 0, at)
        after = folded.find(" ", stop + 1)
        if before >= 0:
            out.add((folded[before:at] + word, folded[at : end + 1]))
        if after >= 0:
            out.add((word + folded[stop + 1 : after + 1], folded[at : end + 1]))
    return out


def train(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS) -> Model:
    """Learn from labelled rows that are not held out."""
    marks = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")).filter(~held_out())
    n = marks.count()
    if n > bound:
        marks = marks.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(bound / n * (1 << 30)))
    # At most about `bound` pairs of numbers: the documented bound of the fit.
    texts = text_column(docs.select("doc_id", "text")).join(F.broadcast(marks), "doc_id").select("text", "toxic")

    def fold_texts(batches):
        claim("toxicity")
        for batch in few_rows(batches):
            folded = [fold(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(folded, pa.string()), batch.column(1), pa.array([print_of(f) for f in folded], pa.int64())], ["text", "toxic", "print"])

    # Copies of one text must not make its words look frequent. Bounded as above.
    texts, path = stored(texts.mapInArrow(fold_texts, "text string, toxic int, print long").groupBy("print", "toxic").agg(F.min("text").alias("text")).select("text", "toxic"), "toxic-training")

    def count_terms(batches):
        counts: dict[str, list[int]] = {}
        seen = [0, 0]
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                y = int(y > 0)
                seen[y] += 1
                for t in terms_of(text):
                    counts.setdefault(t, [0, 0])[y] += 1
        rows = [("", seen[1], seen[0]), *((t, c[1], c[0]) for t, c in counts.items())]
        for k in range(0, len(rows), 100_000):
            t, a, b = zip(*rows[k : k + 100_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(t, pa.string()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["term", "toxic", "clean"])

    counted = texts.mapInArrow(count_terms, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    # The rest can't reach MIN_ODDS: what comes to the driver is bounded by the training rows.
    found = [(r.term, r.toxic, r.clean) for r in counted.filter(f"term = '' or (toxic >= {MIN_TOXIC} and toxic * 3 > clean)").collect()]
    toxic, clean = next(((a, b) for t, a, b in found if not t), (0, 0))
    if not toxic or not clean:
        return Model()
    model = Model(lexicon([f for f in found if f[0]], toxic, clean))
    if not model.weights:
        return Model()

    def count_phrases(batches):
        automaton, counts = model.automaton(), {}
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for p in phrases_of(text, automaton):
                    counts.setdefault(p, [0, 0])[int(y > 0)] += 1
        rows = [(*p, c[1], c[0]) for p, c in counts.items()]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["phrase", "term", "toxic", "clean"])

    phrases = texts.mapInArrow(count_phrases, "phrase string, term string, toxic long, clean long").groupBy("phrase", "term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    model.exceptions = exceptions_of([tuple(r) for r in phrases.filter(f"clean >= {MIN_HARMLESS} and clean > 4 * toxic").collect()], model.weights)

    def measure(batches):
        automaton = model.automaton()
        for batch in batches:
            rows = [model.features(t, automaton) for t in batch.column(0).to_pylist()]
            columns = [pa.array([r[k] for r in rows], pa.float64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*columns, batch.column(1)], ["a", "b", "c", "toxic"])

    rows = texts.mapInArrow(measure, "a double, b double, c double, toxic int").collect()
    data = np.array([tuple(r) for r in rows], float)
    dropped(docs.sparkSession, path)
    data = data[np.lexsort(data.T)]  # the order of tasks must not show in the last digits
    model.coefficients = fit(data[:, :3], (data[:, 3] > 0).astype(float))
    return model


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row of docs (doc_id, text)."""

    def run(batches):
        automaton = model.automaton()
        for batch in few_rows(batches):
            got = [model.score(model.features(fold(t), automaton)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.float64())], ["doc_id", "score"])

    return text_column(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, "doc_id long, score double")


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score below the threshold, with all their columns."""
    place = docs.columns.index("text")

    def run(batches):
        claim("toxicity")
        automaton = model.automaton()
        for batch in few_rows(batches):
            keep = [model.score(model.features(fold(t), automaton)) < threshold for t in batch.column(place).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def quality(scored: list[tuple[float, int]]) -> dict[str, float]:
    """Accuracy, precision, recall and area under the curve of (score, label) pairs."""
    y = np.array([label for _, label in scored])
    s = np.array([score for score, _ in scored])
    hit = s >= 0.5
    ranks = np.empty(len(s))
    values, back, count = np.unique(s, return_inverse=True, return_counts=True)
    ranks = (np.cumsum(count) - (count - 1) / 2)[back]
    ones, zeros = int(y.sum()), int(len(y) - y.sum())
    return {
        "accuracy": float((hit == y).mean()),
        "precision": float(y[hit].mean()) if hit.any() else 1.0,
        "recall": float(hit[y == 1].mean()) if ones else 1.0,
        "auc": float((ranks[y == 1].sum() - ones * (ones + 1) / 2) / (ones * zeros)) if ones and zeros else 1.0,
    }
