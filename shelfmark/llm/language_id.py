"""Language ID: multinomial naive Bayes over hashed character n-grams, scored in numpy against a broadcast matrix."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, lean, slices, text_buffer

UNKNOWN = "und"
SIZES = (2, 3)
BUCKETS = 1 << 16
#: The model is fitted on about so many labelled rows of each language, chosen by a hash: the one bounded sample here.
ROWS_PER_LANGUAGE = 4000
#: A model is languages x BUCKETS numbers, which are broadcast: 64 MB at most.
MOST_LANGUAGES = 256
SMOOTHING = 0.5
#: Bytes of text that numpy works on at a time: its scratch arrays take about sixty times as much.
SLICE = 1 << 20

_letters: list[np.ndarray] = []


def _lower_letters() -> np.ndarray:
    """Code point -> lower-case code point for letters, 0 for all else."""
    if not _letters:
        _letters.append(np.array([ord(chr(c).lower()[0]) if chr(c).isalpha() else 0 for c in range(0x110000)], np.uint32))
    return _letters[0]


def grams(values: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n: the rows and the buckets of all n-grams of all texts, in row order.

    A text is its lower-cased letters, with each run of other characters and both its ends as one space. n-grams of spaces
    alone don't count, so a text without a letter has none.
    """
    offsets, data = text_buffer(values)
    begins = (data & 0xC0) != 0x80
    codes = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    counts = np.concatenate([[0], np.cumsum(begins)])[offsets]
    row = np.repeat(np.arange(len(values)), np.diff(counts))
    padded = np.zeros(len(codes) + 2 * len(values), np.uint32)
    padded[np.arange(len(codes)) + 2 * row + 1] = _lower_letters()[codes]
    rows = np.repeat(np.arange(len(values), dtype=np.int32), np.diff(counts) + 2)
    same = np.concatenate([[False], rows[1:] == rows[:-1]])
    before = np.concatenate([[0], padded[:-1]])
    keep = (padded != 0) | ~same | (before != 0)
    padded, rows = padded[keep].astype(np.uint64), rows[keep]
    for n in SIZES:
        if len(padded) < n:
            continue
        end = len(padded) - n + 1
        mixed, some = np.full(end, n, np.uint64), np.zeros(end, bool)
        for k in range(n):
            part = padded[k : end + k]
            mixed = (mixed ^ part) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            some |= part != 0
        some &= rows[:end] == rows[n - 1 :]
        yield rows[:end][some], (mixed[some] >> np.uint64(20)).astype(np.int64) & (BUCKETS - 1)


@dataclass
class Model:
    languages: list[str]
    log_prior: np.ndarray  # by language
    log_prob: np.ndarray  # language x bucket


def fit(labelled: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> Model:
    """Learn from ``labelled`` (doc_id, text, lang): counts of languages over all rows, n-grams of the bounded sample.

    Rows with a null text, lang or doc_id teach nothing. The driver gets a number for each language and used bucket: at most
    65,536 for each language, whatever the input. More than MOST_LANGUAGES languages: an error.
    """
    known = labelled.select("doc_id", "text", "lang").dropna()
    totals = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(totals)
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"lang holds {len(languages)} values; a model has {MOST_LANGUAGES} at most, which bounds what is broadcast")
    if not languages:
        return Model([], np.zeros(0), np.zeros((0, BUCKETS), np.float32))
    share = F.create_map(*(x for lang in languages for x in (F.lit(lang), F.lit(min(1.0, rows_per_language / totals[lang])))))
    drawn = known.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(17)), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((len(languages), BUCKETS), np.int64)
        index = {lang: k for k, lang in enumerate(languages)}
        for batch in slices(batches, "text", SLICE):
            of = np.array([index[x] for x in batch.column(1).to_pylist()])
            for rows, buckets in grams(batch.column(0)):
                held += np.bincount(of[rows] * BUCKETS + buckets, minlength=held.size).reshape(held.shape)
        lang, bucket = np.nonzero(held)
        for a in range(0, len(lang), 10_000):
            b = slice(a, a + 10_000)
            yield pa.RecordBatch.from_arrays([pa.array(lang[b].astype(np.int32)), pa.array(bucket[b].astype(np.int32)), pa.array(held[lang[b], bucket[b]])], ["lang", "bucket", "n"])

    sums = drawn.select("text", "lang").mapInArrow(lean(count), "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.full((len(languages), BUCKETS), SMOOTHING)
    counts[sums["lang"].to_numpy(), sums["bucket"].to_numpy()] += sums["n"].to_numpy()
    prior = np.array([totals[x] for x in languages], float)
    return Model(languages, np.log(prior / prior.sum()), np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32))


def scores(values: pa.Array, model: Model) -> tuple[list[str], np.ndarray]:
    """Predicted language and its posterior probability for each text of an Arrow array; ties go to the first by name."""
    total = np.tile(model.log_prior, (len(values), 1))
    found = np.zeros(len(values), bool)
    for rows, buckets in grams(values):
        found |= np.bincount(rows, minlength=len(values)) > 0
        for k in range(len(model.languages)):
            total[:, k] += np.bincount(rows, model.log_prob[k][buckets], len(values))
    if not model.languages:
        return [UNKNOWN] * len(values), np.zeros(len(values))
    best = total.argmax(1)
    shifted = np.exp(total - total.max(1, keepdims=True))
    score = np.where(found, 1 / shifted.sum(1), 0.0)
    return [model.languages[b] if f else UNKNOWN for b, f in zip(best, found, strict=True)], score


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (0 to 1); both columns are replaced if the input has them.

    Only the text is read. Null texts and texts without a letter: ``und`` and 0. A model without languages predicts ``und``.
    The whole text counts, however long. Empty table: no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "score")
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, SLICE):
            langs, score = scores(batch.column(at), sent.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(score)], [*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(lean(run), schema)


def held_out(doc_id: str = "doc_id"):
    """Whether a row's fold is the held-out one; null ids are in no fold."""
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs.where(~held_out()))
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")
