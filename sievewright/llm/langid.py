"""Language identification by word-first backoff.

Training (on about ``sample`` different labelled documents, a documented bound, dealt evenly over the languages: of each,
those of smallest xxhash64(doc_id, text)) counts, per language, words and character n-grams of 1 to ``longest`` characters inside padded words. A word seen ``seen`` times or
more scores by its smoothed log frequency in each language. Any other word is covered by character n-grams, longest
known ones first, falling back to shorter ones where a longer one was not seen. A document's score of a language is the
sum over all words of its whole text; the prediction is the best language (ties: first in code point order), the
reported score its posterior with evidence tempered to the mean of 20 words.

Defined results: ``und`` with score 0 where the text is null, empty or has no letter, or where nothing was learned.
Rows keep their other columns; repeated rows are judged alike.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import apart, back, held, in_arrow

SAMPLE, LONGEST, SEEN, TEMPER = 4_000, 4, 2, 20
RUNS = regex.compile(r"\p{L}+")


def _table(rows: dict[str, np.ndarray], n: int) -> tuple[dict[str, int], np.ndarray]:
    """Numbers of the names, and their rows in one array, which takes half the memory of many small ones."""
    return {name: i for i, name in enumerate(rows)}, np.array(list(rows.values())).reshape(len(rows), n)


class Model:
    """Log frequencies by language of words and character n-grams."""

    def __init__(self, rows: Iterator[tuple[str, str]], longest: int = LONGEST, seen: int = SEEN):
        self.words: dict[str, Counter] = {}
        for lang, text in rows:
            self.words.setdefault(lang, Counter()).update(RUNS.findall(text.lower()))
        self.langs, self.longest = sorted(self.words), longest
        n = len(self.langs)
        grams: list[dict[str, np.ndarray]] = [{} for _ in range(longest + 1)]
        words: dict[str, np.ndarray] = {}
        for k, lang in enumerate(self.langs):
            for word, c in self.words[lang].items():
                words.setdefault(word, np.zeros(n))[k] += c
                padded = f" {word} "
                for g in range(1, longest + 1):
                    for i in range(len(padded) - g + 1):
                        grams[g].setdefault(padded[i : i + g], np.zeros(n))[k] += c
        size = np.array([max(1, sum(self.words[x].values())) for x in self.langs], float)
        self.words = _table({w: np.log((c + 0.5) / (size + 0.5 * len(words))) for w, c in words.items() if c.sum() >= seen}, n)
        self.grams = []
        for own in grams:
            size = np.maximum(1, sum(own.values(), np.zeros(n)))
            self.grams.append(_table({g: np.log((c + 0.5) / (size + 0.5 * len(own))) / longest for g, c in own.items()}, n))

    def word(self, word: str) -> np.ndarray:
        """Scores of one lower-cased word."""
        at, scores = self.words
        if word in at:
            return scores[at[word]]
        total, padded, i = np.zeros(len(self.langs)), f" {word} ", 0
        while i < len(padded):
            for g in range(min(self.longest, len(padded) - i), 0, -1):
                at, scores = self.grams[g]
                if padded[i : i + g] in at:
                    total = total + scores[at[padded[i : i + g]]]
                    break
            i += max(1, g - 1)
        return total


class Cache(dict):
    """Index of each run of letters seen by this worker; its scores are a row of ``rows``."""

    def __init__(self, model: Model, most: int = 400_000):
        self.model, self.most, self.rows, self.n = model, most, np.zeros((1024, len(model.langs))), 0

    def __missing__(self, word: str) -> int:
        if self.n == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[self.n] = self.model.word(word)
        self[word] = self.n
        self.n += 1
        return self.n - 1

    def trim(self) -> None:
        if self.n > self.most:
            self.clear()
            self.n = 0


def sampled(docs: DataFrame, chosen: Column, sample: int) -> DataFrame:
    """About ``sample`` different labelled documents (lang, text), as many of each language as it has and its part of the
    sample allows: those whose hash lies below the share of its rows that keeps so many."""
    labelled = docs.where(chosen & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.xxhash64(F.col("doc_id").cast("string"), "text").alias("hash"))
    n = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    share = n.select("lang", (sample / max(1, n.count()) / F.col("n")).alias("share"))
    below = (F.col("hash").cast("double") + 2.0**63) / 2.0**64 < F.col("share")
    # a row a language, for each of which the model itself holds tables
    return labelled.join(F.broadcast(share), "lang").where(below).select("lang", "text").distinct()


def train(docs: DataFrame, chosen: Column, sample: int = SAMPLE) -> Model:
    return Model((lang, text) for lang, text in sampled(docs, chosen, sample).toLocalIterator())


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    token = f"langid-{uuid.uuid4().hex}"  # workers outlive a model, so its cache goes by a name no other has
    docs = docs.drop("lang_pred", "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        cache, langs = held(token, lambda: Cache(own)), own.langs
        for b in batches:
            names, scores = [], []
            for value in b.column(b.schema.get_field_index(text)):
                found = RUNS.findall((value.as_py() or "").lower())
                if not found or not langs:
                    names.append("und")
                    scores.append(0.0)
                    continue
                at = list(map(cache.__getitem__, found))
                total = cache.rows[at].sum(axis=0)
                best = int(total.argmax())
                spread = np.exp((total - total[best]) * min(1.0, TEMPER / len(found)))
                names.append(langs[best])
                scores.append(float(1 / spread.sum()) if math.isfinite(spread.sum()) else 0.0)
                cache.trim()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*b.schema.names, "lang_pred", "score"])

    schema = docs.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    return in_arrow(docs, run, schema, token)


def fold(doc_id: str | Column, parts: int) -> Column:
    """Which of so many folds a document is in, by crc32 of its id as text (null id: of the empty string)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % parts


def digest(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    held = fold("doc_id", 5) == 0
    model = train(docs, ~held, sample)
    return predict(docs.select("doc_id", held.alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def accepted(docs: DataFrame, sample: int = SAMPLE, least: float = 0.5) -> DataFrame:
    """The documents, with their own columns, of which a language could be told."""
    model = train(docs, fold("doc_id", 5) != 0, sample)
    kept = predict(apart(docs), model).where((F.col("lang_pred") != "und") & (F.col("score") >= least))
    return back(kept, docs.columns)


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
