"""Operator 8: language identification, words first, then shorter and shorter character n-grams.

The model has log frequencies per language of all words of a bounded labelled sample (as many
rows of every language), and of the character n-grams of those words. A word of a text that the
model knows scores by its own frequencies; an unseen word falls back to its n-grams of
the longest length of which any is known. A text's evidence is the sum over all its words, and its
score the probability of the best language at a temperature fitted on sample rows that the
frequencies were not taken from.

Cases: a null text or one without a letter is `und` with score 0; a text of unknown script only
gets the first language in alphabetical order with the score of a guess; ties go to
the first language; repeated rows stay; an empty table gives an empty table; other columns
pass through, but input columns named like an output column are replaced; without any
labelled row every text is `und`; more than MOST_LANGUAGES labels raise, as they name no languages.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm.bpe import appended
from weftgraph.llm.common import bounded_batches, fresh, steps, with_fields
from weftgraph.llm.pretokenize import LETTER, code_points, classes
from weftgraph.llm.slices import distinct_slices
from weftgraph.llm.tables import ListCache, gather

UNKNOWN = "und"
#: Labelled rows of each language that a model is fitted on, about; labels beyond which it raises; n-gram lengths.
SAMPLE_ROWS, MOST_LANGUAGES, GRAMS = 600, 1_000, (5, 4, 3, 2, 1)
#: One of so many sample rows is kept for the temperature.
TEMPER_FOLDS = 5
#: Words of one of a worker's two cache generations (results do not depend on it).
CACHE_WORDS = 150_000
#: Pseudo-count of an unseen word or n-gram, and the weight of an n-gram score against a word's.
SMOOTH, GRAM_WEIGHT = 0.5, 0.7


@dataclass
class LanguageModel:
    """Scores by language: row numbers of known words and n-grams, and the rows."""

    languages: list[str]
    words: dict[str, int]
    grams: dict[str, int]
    rows: np.ndarray
    temperature: float = 1.0
    cache: ListCache | None = field(default=None, compare=False)

    def parts(self, w: str) -> list[int]:
        """Rows whose mean scores a word: its own, or its longest n-grams of which any is known."""
        w = w.lower()
        known = self.words.get(w)
        if known is not None:
            return [known]
        marked, get = f"^{w}$", self.grams.get
        for n in GRAMS:
            found = [g for i in range(len(marked) - n + 1) if (g := get(marked[i : i + n])) is not None]
            if found:
                return found
        return []

    def _made(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [self.parts(w) for w in words]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int32, int(lengths.sum())), lengths

    def word_scores(self, joined: str, cps: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """A row of scores for each word (a slice of the text `joined`); rows of words are kept in a bounded cache."""
        if self.cache is None:
            self.cache = ListCache(self._made, CACHE_WORDS)
        values, start, count = self.cache.take(joined, cps, starts, ends, hashes)
        flat = gather(values, start, count)
        ends = np.cumsum(count)
        sums = np.concatenate([np.zeros((1, len(self.languages))), np.cumsum(self.rows[flat], axis=0, dtype=np.float64)])
        mean = (sums[ends] - sums[ends - count]) / np.maximum(count, 1)[:, None]
        own = np.zeros(len(count), bool)
        own[count > 0] = flat[(ends - count)[count > 0]] < len(self.words)
        return mean * np.where(own, 1.0, GRAM_WEIGHT)[:, None]

    def evidence(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(summed scores by language, number of words) of each text."""
        joined, cps, stops = code_points(texts)
        inside = classes()[cps] == LETTER
        edge = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if not len(starts) or not self.languages:
            return np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        which, first, hashes = distinct_slices(cps, starts, ends)
        scores = self.word_scores(joined, cps, starts[first], ends[first], hashes)
        sums = np.concatenate([np.zeros((1, len(self.languages))), np.cumsum(scores[which], axis=0, dtype=np.float64)])
        upto = np.searchsorted(starts, stops)
        fro = np.concatenate([[0], upto[:-1]])
        return sums[upto] - sums[fro], upto - fro

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """(language, score) of each text."""
        total, words = self.evidence(texts)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        odds = _odds(total, words, self.temperature)
        best = odds.argmax(axis=1)
        none = words == 0
        return [UNKNOWN if e else self.languages[i] for i, e in zip(best.tolist(), none.tolist())], np.where(none, 0.0, odds[np.arange(len(best)), best])


def _odds(total: np.ndarray, words: np.ndarray, temperature: float) -> np.ndarray:
    """Probabilities by language: words of a text are not independent, so evidence grows with the root of their number."""
    scaled = total / (temperature * np.sqrt(np.maximum(words, 1)))[:, None]
    odds = np.exp(scaled - scaled.max(axis=1, keepdims=True))
    return odds / odds.sum(axis=1, keepdims=True)


def fit_temperature(total: np.ndarray, words: np.ndarray, truth: np.ndarray) -> float:
    """The temperature of least log loss against the truth, which counts as 1 - 1/(n + 2) sure."""
    n = len(truth)
    if not n or total.shape[1] < 2:
        return 1.0
    want = np.full(total.shape, 1 / (n + 2) / (total.shape[1] - 1))
    want[np.arange(n), truth] = 1 - 1 / (n + 2)
    grid = 2.0 ** np.arange(-6, 7, 0.25)
    return float(min(grid, key=lambda t: -(want * np.log(np.maximum(_odds(total, words, t), 1e-300))).sum()))


def _log_frequencies(table: np.ndarray) -> np.ndarray:
    """Per item, the log of its smoothed share in each language, less the mean over the languages."""
    if not table.size:
        return np.zeros(table.shape, np.float32)
    table = table + SMOOTH
    rows = np.log(table / table.sum(axis=0, keepdims=True))
    return (rows - rows.mean(axis=1, keepdims=True)).astype(np.float32)


def fit_languages(labelled: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Fits on about `rows` labelled rows of each language, chosen by a hash of their ids; all their words count.

    The driver gets the distinct words of those rows with their counts.
    """
    known = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(id).alias("id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} labels are no languages")
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], {}, {}, np.zeros((0, 0), np.float32))
    parts = 1 << 30
    most = F.create_map(*(x for k in languages for x in (F.lit(k), F.lit(math.ceil(min(1.0, rows / sizes[k]) * parts)))))
    picked = known.where(F.pmod(F.xxhash64(F.lit(8), "id"), F.lit(parts)) < most[F.col("lang")])
    kept_out = F.pmod(F.xxhash64(F.lit(9), "id"), F.lit(TEMPER_FOLDS)) == 0
    seen = picked.where(~kept_out).select("lang", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")).where("word <> ''")
    # as Arrow, so that the driver holds no row objects
    found = seen.groupBy("word", "lang").agg(F.count(F.lit(1)).alias("n")).orderBy("word", "lang").toArrow()
    coded = found["word"].combine_chunks().dictionary_encode()
    number = {x: i for i, x in enumerate(languages)}
    counts = np.zeros((len(coded.dictionary), len(languages)))
    counts[np.asarray(coded.indices), np.fromiter((number[x.as_py()] for x in found["lang"]), np.int64, len(found))] = np.asarray(found["n"])
    words = {w: i for i, w in enumerate(coded.dictionary.to_pylist())}
    del found, coded
    tables, grams = [_log_frequencies(counts)], {}
    sizes_of = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    for k in GRAMS:
        begin = len(words) + len(grams)
        own: dict[str, int] = {}
        per = np.maximum(sizes_of - k + 1, 0)
        at = np.fromiter((own.setdefault(m[i : i + k], len(own)) for m in map("^{}$".format, words) for i in range(len(m) - k + 1)), np.int64, int(per.sum()))
        of = np.repeat(np.arange(len(words)), per)
        tables.append(_log_frequencies(np.stack([np.bincount(at, counts[of, j], minlength=len(own)) for j in range(len(languages))], axis=1)))
        grams |= {g: begin + i for g, i in own.items()}
        del own, at, of
    model = LanguageModel(languages, words, grams, np.concatenate(tables))
    model.temperature = fit_temperature(*_sample_evidence(picked.where(kept_out), model))
    return model


def _sample_evidence(sample: DataFrame, model: LanguageModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(evidence, words, true language) of the sample's rows with words."""
    shared = sample.sparkSession.sparkContext.broadcast(model)
    bounded_batches(sample.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, words = shared.value.evidence(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(total.tolist(), pa.list_(pa.float64())), pa.array(words, pa.int64())], ["lang", "total", "words"])

    rows = sample.select("lang", "text").mapInArrow(run, "lang string, total array<double>, words long").where("words > 0").collect()
    shared.unpersist()
    number = {x: i for i, x in enumerate(model.languages)}
    rows.sort(key=lambda r: (r["lang"], r["words"], r["total"]))
    return np.array([r["total"] for r in rows]).reshape(len(rows), -1), np.array([r["words"] for r in rows], np.int64), np.array([number[r["lang"]] for r in rows], np.int64)


def identify(df: DataFrame, model: LanguageModel, text: str = "text", lang_pred: str = "lang_pred", score: str = "lang_score", keep: list[str] | None = None) -> DataFrame:
    """Adds `lang_pred` and `score` (0 to 1). The broadcast model is bounded by the sample that it was fitted on."""
    kept = df.columns if keep is None else keep
    schema = with_fields(df.select(*kept).schema, T.StructField(lang_pred, T.StringType()), T.StructField(score, T.DoubleType()))
    names = schema.names
    source = fresh(df, "text")
    shared = df.sparkSession.sparkContext.broadcast(model)
    bounded_batches(df.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            texts = [x or "" for x in batch.column(source).to_pylist()]
            for a, b in steps([len(x) for x in texts]):
                got, sure = own.predict(texts[a:b])
                yield appended(batch.slice(a, b - a), names, **{lang_pred: pa.array(got, pa.string()), score: pa.array(sure, pa.float64())})

    return df.select(*[c for c in kept if c in names and c not in (lang_pred, score)], df[text].cast("string").alias(source)).mapInArrow(run, schema)


def fold(id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo `folds`."""
    return F.pmod(F.crc32(id.cast("string").cast("binary")), F.lit(folds))
