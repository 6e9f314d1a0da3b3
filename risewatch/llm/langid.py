"""Language identification by word-first backoff.

A known word scores its log frequency in every language.  An unseen word is scored by the longest
character n-grams of it that are known, four characters down to one, each step back costing a constant.
The model is a bounded table, fitted by Spark aggregations on a bounded sample of labelled documents.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from risewatch.llm.common import give_back, slices

UNKNOWN = "und"
_WORDS = re.compile(r"[^\W\d_]+")
_EDGE = "\x02"  # before and after a word's letters, so that beginnings and ends count
_WORD = 40  # letters of the longest run that is taken for a word of its own
_PIECE = 64  # characters that begin the n-grams of one piece of a run


@dataclass(frozen=True)
class Model:
    """Rows of `table` hold log scores per language, in the order of `langs`.  `words` and `grams` give the
    rows; a gram's row includes what stepping back to its length costs."""

    langs: list[str]
    words: dict[str, int]
    grams: dict[str, int]
    table: np.ndarray
    longest: int

    def rows(self, word: str) -> list[int]:
        """The rows whose mean is the score of a lower-case word: its own, or every character's in its
        longest known left context."""
        known = self.words.get(word)
        if known is not None:
            return [known]
        padded, found = _EDGE + word + _EDGE, []
        for end in range(2, len(padded) + 1):
            for n in range(min(self.longest, end), 0, -1):
                row = self.grams.get(padded[end - n : end])
                if row is not None:
                    found.append(row)
                    break
        return found

    def scores(self, words: list[str]) -> np.ndarray:
        """Log scores of words, one row each; zeros where not even a character is known."""
        found = [self.rows(w) for w in words]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((r for rows in found for r in rows), np.int64, int(sizes.sum()))
        sums = np.zeros((len(words), len(self.langs)))
        some = np.flatnonzero(sizes)
        if len(some):
            sums[some] = np.add.reduceat(self.table[flat], (np.cumsum(sizes) - sizes)[some], axis=0)
        return sums / np.maximum(sizes, 1)[:, None]


def fit(
    labelled: DataFrame, per_lang: int = 2000, most_words: int = 20_000, most_grams: int = 10_000,
    longest: int = 4, backoff: float = 0.4,
) -> Model:
    """Fit on (doc_id, text, lang): `per_lang` documents of each language, those whose hashed doc_id is
    smallest, with their whole texts.  The model keeps the `most_words` most frequent words of each
    language that occur twice or more and the `most_grams` most frequent n-grams of each length.  Runs of
    more than 40 letters, as in languages written without spaces, are no words; their n-grams count like others.

    Rows without text, language or doc_id teach nothing.  Without any labelled row the model is empty and
    every prediction `und`.
    """
    rows = labelled.where("text IS NOT NULL AND lang IS NOT NULL AND doc_id IS NOT NULL").select(
        "lang", "text", F.xxhash64("doc_id").alias("_h"), "doc_id"
    )
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Model([], {}, {}, np.empty((0, 0)), longest)
    # A hash below a language's quantile, with a margin, bounds the sample without ordering whole languages.
    low, span = -(1 << 63), 1 << 64
    limit = F.create_map(*[
        x for lang, n in sizes.items()
        for x in (F.lit(lang), F.lit(min((1 << 63) - 1, low + int(span * min(1.0, per_lang / n)))))
    ])
    sample = rows.where(F.col("_h") <= limit[F.col("lang")])
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), 1)
    counts = sample.select("lang", F.explode(words).alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    counts.persist()
    grams = _grams(counts, longest)
    langs = sorted(sizes)
    word_rows = _most(counts.where((F.col("n") >= 2) & (F.length("word") <= _WORD)), ["lang"], "word", most_words)
    gram_rows = _most(grams.withColumn("size", F.length("gram")), ["lang", "size"], "gram", most_grams)
    counts.unpersist()
    words, word_logs = _logs(langs, word_rows, "word")
    grams, gram_logs = _logs(langs, gram_rows, "gram")
    grams.pop(_EDGE, None)  # an edge alone says nothing
    for gram, row in grams.items():
        gram_logs[row] -= backoff * (longest - len(gram))
    grams = {gram: row + len(word_logs) for gram, row in grams.items()}
    return Model(langs, words, grams, np.concatenate([word_logs, gram_logs]), longest)


def _grams(counts: DataFrame, longest: int) -> DataFrame:
    """(lang, gram, n): the n-grams of (lang, word, n), edges included.  Long runs go through pieces that
    reach over their ends by what an n-gram needs, so that the work grows with a run's length and not its square."""
    reach = _PIECE + longest - 1
    padded = F.concat(F.lit(_EDGE), "word", F.lit(_EDGE))
    pieces = F.regexp_extract_all(padded, F.lit(f"(?s)(?=(.{{1,{reach}}})).{{1,{_PIECE}}}"), 1)
    cut = counts.select("lang", "n", F.explode(pieces).alias("piece"))
    grams = None
    for n in range(1, longest + 1):  # n must not be a default of the lambda: transform would give it the index
        starts = F.sequence(F.lit(1), F.least(F.lit(_PIECE), F.length("piece") - (n - 1)))
        of_length = cut.where(F.length("piece") >= n).select(
            "lang", "n", F.explode(F.transform(starts, lambda i: F.substr("piece", i, F.lit(n)))).alias("gram")  # noqa: B023
        )
        grams = of_length if grams is None else grams.unionByName(of_length)
    return grams.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _most(rows: DataFrame, keys: Sequence[str], what: str, most: int) -> list:
    """The most frequent entries per key: at most `most` rows for each."""
    from pyspark.sql import Window

    order = Window.partitionBy(*keys).orderBy(F.desc("n"), what)
    return rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).select("lang", what, "n").collect()


def _logs(langs: list[str], rows: list, what: str) -> tuple[dict[str, int], np.ndarray]:
    """Row numbers of the entries, and their log frequencies; n-grams are counted by length."""
    place = {lang: i for i, lang in enumerate(langs)}
    of: dict[str, int] = {}
    for row in rows:
        of.setdefault(row[what], len(of))
    table = np.zeros((len(of), len(langs)))
    for row in rows:
        table[of[row[what]], place[row["lang"]]] = row["n"]
    sizes = np.fromiter((len(k) if what == "gram" else 0 for k in of), np.int64, len(of))
    totals = np.zeros((int(sizes.max(initial=0)) + 1, len(langs)))
    np.add.at(totals, sizes, table)
    return of, np.log((table + 0.5) / (totals[sizes] + 0.5 * max(1, len(of))))


class _Scores:
    """Scores of words already met, as rows of one growing table; emptied when it is full."""

    def __init__(self, model: Model, most: int = 200_000):
        self.model, self.most = model, most
        self._clear()

    def _clear(self) -> None:
        self.places: dict[str, int] = {}
        self.table = np.empty((1 << 14, len(self.model.langs)))

    def add(self, words: set[str]) -> None:
        if len(self.places) > self.most:
            self._clear()
        new = list(words - self.places.keys())
        start, end = len(self.places), len(self.places) + len(new)
        while end > len(self.table):
            self.table = np.concatenate([self.table, np.empty_like(self.table)])
        # A letter run in the sense of the pattern may hold other numerals; they say nothing.
        self.table[start:end] = self.model.scores([w if w.isalpha() else "".join(filter(str.isalpha, w)) for w in new])
        self.places.update(zip(new, range(start, end)))

    def predict(self, texts: list[str | None]) -> Iterator[tuple[str, float]]:
        """(language, score) of each text."""
        found = [_WORDS.findall(x.lower()) if x else [] for x in texts]
        self.add(set().union(*found))
        for words in found:
            yield self._predict(words)

    def _predict(self, words: list[str]) -> tuple[str, float]:
        if not self.model.langs or not any(c.isalpha() for w in words for c in w):
            return UNKNOWN, 0.0
        rows = np.fromiter(map(self.places.__getitem__, words), np.int64, len(words))
        total = self.table[rows].sum(axis=0)
        odds = np.exp((total - total.max()) / math.sqrt(len(words)))
        best = int(odds.argmax())
        return self.model.langs[best], float(odds[best] / odds.sum())


def keep_recognised(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows of `docs` whose text has a language with a score of `least` or more; columns stay.

    Rows are judged one by one: repeated rows share their fate and a null doc_id does no harm.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _Scores(sent.value)
        for batch in slices(batches, "text"):
            found = scores.predict(batch.column("text").to_pylist())
            yield batch.filter(pa.array([lang != UNKNOWN and score >= least for lang, score in found], pa.bool_()))
        give_back()

    return docs.mapInArrow(run, docs.schema)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of (doc_id, text): doc_id, lang_pred, score; other columns are left out.

    lang_pred is `und` (score 0) where the text is null or has no letter, or the model is empty.  score is
    the probability of the predicted language among the learned ones, its log odds spread over the square
    root of the number of words, since words of one text are not independent.  Whole texts are read; equal
    scores go to the language first in order.  Repeated rows and a null doc_id stay.  No shuffle; the
    model, of bounded size, is sent to the tasks.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _Scores(sent.value)
        for batch in slices(batches, "text"):
            langs, values = zip(*scores.predict(batch.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(langs, pa.string()), pa.array(values, pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, lang_pred string, score double")
