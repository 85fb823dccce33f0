"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text is the average of the embeddings of its subwords (byte 2-, 3- and 4-grams of its words with their borders,
letters only, hashed to buckets); a linear softmax gives probabilities of the languages and of a background class.
Embeddings and softmax are trained by stochastic gradient descent in numpy on a bounded sample of labelled rows.  The
background is trained on what is no text of a learnt language: for each sampled row one made-up text, in turn its own
letters shuffled, random letters, program code, and letters of other scripts.  A temperature and a rejection threshold
are fitted on rows that training did not see, some of each kind.

Prediction uses the product of embeddings and softmax weights, one row of scores for each bucket, and reads each text
whole, many texts at a time.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vectext import LOWER, U64, Chunk, chunks, keys, mix

BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
DIMENSIONS = 16
#: The model is fitted on at most so many labelled rows, those with the smallest hashes of their ids.
SAMPLE_ROWS = 1500
CALIBRATION_SHARE = 5  # every fifth sampled row calibrates
EPOCHS = 12
RATE = 2.0
BATCH = 16
#: Share of right predictions on the calibration rows that may fall under the rejection threshold.
REJECTED_RIGHT = 0.002
#: Share of the background among them that should fall under it.
REJECTED_NOISE = 0.995
#: The label of the background in training; it is never predicted.
BACKGROUND = ""
_SIZES = (2, 3, 4)
_SEEDS = keys(5, 21)

# ASCII letters in lower case and all bytes of longer characters count; anything else is a border between words.
_CLEAN = LOWER.copy()
_CLEAN[:0x80][~np.isin(np.arange(0x80), [*range(0x41, 0x5B), *range(0x61, 0x7B)])] = 0x20


def subwords(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every subword."""
    # A border stands before, between and after the rows.
    n = len(chunk.data)
    data = np.full(n + chunk.rows + 1, 0x20, np.uint8)
    row = np.repeat(np.arange(chunk.rows), np.diff(chunk.offsets))
    data[np.arange(n) + row + 1] = _CLEAN[chunk.data]
    row_of = np.zeros(len(data), np.int32)
    row_of[np.arange(n) + row + 1] = row
    solid = data != 0x20
    wide = data.astype(U64)
    rows, buckets = [], []
    for size in _SIZES:
        m = len(data) - size + 1
        if m <= 0:
            continue
        value, inner = wide[:m].copy(), np.ones(m, bool)
        for k in range(1, size):
            value |= wide[k : k + m] << U64(8 * k)
            if k < size - 1:
                inner &= solid[k : k + m]
        if size == 2:
            inner &= solid[:m] | solid[1 : m + 1]
        at = np.flatnonzero(inner)
        # The second byte is never a border in the larger sizes; in bigrams one of the two is not.
        owner = row_of[at + 1]
        if size == 2:
            owner = np.where(solid[at + 1], row_of[at + 1], row_of[at])
        rows.append(owner)
        buckets.append((mix(value[at] + _SEEDS[size]) >> U64(64 - BUCKET_BITS)).astype(np.int32))
    return np.concatenate(rows or [np.empty(0, np.int32)]), np.concatenate(buckets or [np.empty(0, np.int32)])


_WORD_LENGTHS = (2, 11)
_KEYWORDS = "if else for while return def class import from int void const let var function null true false new this print struct static public self".split()


def _noise(text: str, rng: np.random.Generator) -> str:
    """A text in no language: shuffled letters of this one, random letters, program code or another script."""
    words = int(rng.integers(2, 120))
    lengths = rng.integers(*_WORD_LENGTHS, words)
    kind = rng.integers(4)
    if kind == 0:
        letters = list("".join(text[:20_000].split()))
        rng.shuffle(letters)
        ends = np.cumsum(lengths)
        return " ".join("".join(letters[b - n : b]) for n, b in zip(lengths, ends) if b <= len(letters)) or "".join(letters)
    if kind == 1:
        return " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, n)) for n in lengths)
    if kind == 2:
        name = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(1, 6))) + ("_" + str(rng.choice(_KEYWORDS)) if rng.random() < 0.3 else "")
        return "\n".join(f"{rng.choice(_KEYWORDS)} {name()} = {name()}({name()}, {rng.integers(1000)}); {rng.choice(_KEYWORDS)} ({name()}.{name()}) {{ {name()}[{name()}] }}" for _ in range(words // 8 + 1))
    # Letters of one row of a script behind Latin: two, three or four bytes each.
    row = int(rng.integers(0x37, 0xD7)) << 4 if rng.random() < 0.5 else int(rng.integers(0x40, 0x9F)) << 8
    return " ".join("".join(chr(row + c) for c in rng.integers(0, 64, n)) for n in lengths)


def _sampled(batches):
    """The subword counts of each text, of some words of it, and of a text in no language."""
    for batch in batches:
        names, texts = [], []
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            rng = np.random.default_rng(zlib.crc32(text.encode()))
            words = text[:20_000].split()
            at, n = int(rng.integers(0, max(1, len(words) - 3))), int(rng.integers(2, 9))
            names += [label, label, BACKGROUND]
            texts += [text, " ".join(words[at : at + n]), _noise(text, rng)]
        lists = []
        for chunk in chunks(pa.array(texts, pa.string())):
            row, bucket = subwords(chunk)
            pair, count = np.unique(row.astype(np.int64) * BUCKETS + bucket, return_counts=True)
            ends = np.searchsorted(pair, (np.arange(chunk.rows) + 1) * BUCKETS)
            packed_ = (pair % BUCKETS) << 32 | count
            lists += np.split(packed_, ends[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([x.tobytes() for x in lists], pa.binary())], names=["label_", "grams_"])


@dataclass
class LanguageModel:
    labels: list[str]
    scores: np.ndarray  #: (buckets, labels and the background, if there is one): embeddings times softmax weights
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def probabilities(self, mean_scores: np.ndarray) -> np.ndarray:
        """Of each language, and last of the background."""
        z = (mean_scores + self.bias) / self.temperature
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def fit(rows: list[tuple[str, bytes]], seed: int = 5) -> LanguageModel:
    """Train on rows of a label and int64 numbers ``bucket << 32 | count``."""
    labels = sorted({label for label, _ in rows} - {BACKGROUND})
    rng = np.random.default_rng(seed)
    classes = [*labels, BACKGROUND] if any(label == BACKGROUND for label, _ in rows) else labels
    n_labels = len(classes)
    if n_labels < 2:
        return LanguageModel(labels, np.zeros((BUCKETS, max(1, n_labels)), np.float32), np.zeros(max(1, n_labels)))
    y = np.array([classes.index(label) for label, _ in rows])
    docs = []
    for _, grams in rows:
        g = np.frombuffer(grams, np.int64)
        count = (g & 0xFFFFFFFF).astype(np.float32)
        docs.append(((g >> 32).astype(np.int64), count / np.float32(max(1.0, count.sum()))))
    check = np.arange(len(rows)) % CALIBRATION_SHARE == 0 if len(rows) >= 4 * CALIBRATION_SHARE else np.zeros(len(rows), bool)
    train = np.flatnonzero(~check)
    embed = rng.normal(0, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    out = np.zeros((DIMENSIONS, n_labels), np.float32)
    bias = np.zeros(n_labels, np.float32)
    share = np.bincount(y[train], minlength=n_labels)
    weight = (len(train) / (n_labels * np.maximum(share, 1)))[y].astype(np.float32)  # languages count alike
    steps, done = EPOCHS * -(-len(train) // BATCH), 0
    for _ in range(EPOCHS):
        order = rng.permutation(train)
        for a in range(0, len(order), BATCH):
            rate = np.float32(RATE * (1 - done / steps))
            done += 1
            part = order[a : a + BATCH]
            hidden = np.stack([docs[i][1] @ embed[docs[i][0]] for i in part])
            z = hidden @ out + bias
            e = np.exp(z - z.max(axis=1, keepdims=True))
            error = e / e.sum(axis=1, keepdims=True)
            error[np.arange(len(part)), y[part]] -= 1
            error *= weight[part][:, None] / len(part)
            back = error @ out.T
            out -= rate * hidden.T @ error
            bias -= rate * error.sum(axis=0)
            for i, b in zip(part, back):
                # Buckets are distinct within a document.
                embed[docs[i][0]] -= docs[i][1][:, None] * (rate * np.float32(DIMENSIONS) * b)[None, :]
    model = LanguageModel(labels, (embed @ out).astype(np.float32), bias)
    if check.any():
        _calibrate(model, np.stack([docs[i][1] @ model.scores[docs[i][0]] for i in np.flatnonzero(check)]), y[check])
    return model


def _calibrate(model: LanguageModel, mean_scores: np.ndarray, y: np.ndarray) -> None:
    """The temperature of least log loss, and the threshold under which ``REJECTED_NOISE`` of the background falls,
    but not more than ``REJECTED_RIGHT`` of the rightly predicted texts."""
    best = (np.inf, 1.0)
    # Smoothed labels: rows without an error don't make the model certain.
    n, wrong = mean_scores.shape[1], 1 / (len(y) + 2)
    goal = np.full((len(y), n), wrong / (n - 1))
    goal[np.arange(len(y)), y] = 1 - wrong
    for t in np.geomspace(0.05, 5, 60):
        model.temperature = float(t)
        p = model.probabilities(mean_scores)
        best = min(best, (float(-(goal * np.log(np.maximum(p, 1e-12))).sum(axis=1).mean()), float(t)))
    model.temperature = best[1]
    p = model.probabilities(mean_scores)
    known = len(model.labels)
    score, guess = p[:, :known].max(axis=1), p[:, :known].argmax(axis=1)
    right, noise = score[guess == y], score[y >= known]
    most = float(np.quantile(right, REJECTED_RIGHT)) if len(right) else 1 / n
    model.threshold = min(most, float(np.quantile(noise, REJECTED_NOISE))) if len(noise) else most / 2


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Fit on the texts of the ``sample_rows`` labelled ids with the smallest hashes; their number bounds what the
    driver receives (subword counts in ``BUCKETS`` buckets, of three texts for each).

    An id that is repeated counts with the text of the smallest hash and the smallest of its labels, once.
    """
    rows = labelled.where(F.col(label_col).isNotNull() & (F.col(label_col).cast("string") != BACKGROUND) & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id_"), F.col(label_col).cast("string").alias("label_"), F.col(text_col).alias("text_"))
    # Which rows are taken is settled on ids and hashes alone, before texts move.
    rows = rows.withColumn("t_", F.xxhash64("text_"))
    ids = rows.groupBy("id_").agg(F.min("t_").alias("t_")).select("id_", "t_", F.xxhash64(F.col("id_").cast("string")).alias("h")).orderBy("h", "id_").limit(sample_rows)
    wanted = F.broadcast(ids.select(F.col("id_").alias("i_"), F.col("t_").alias("u_")))
    near = rows.join(wanted, rows["id_"].eqNullSafe(F.col("i_")) & (rows["t_"] == F.col("u_")))
    once = near.groupBy("id_", "t_").agg(F.min("label_").alias("label_"), F.min("text_").alias("text_"))
    grams = once.select("label_", "text_").repartition(16).mapInArrow(_sampled, "label_ string, grams_ binary")
    return fit(sorted((r["label_"], bytes(r["grams_"])) for r in grams.collect() if r["grams_"]))


_PREDICTED = "id_ long, lang_ string, lang_pred string, score double, accepted boolean"
UNKNOWN = "und"


def _scores(column: pa.Array, model: LanguageModel) -> tuple[np.ndarray, np.ndarray]:
    """For each row the mean scores, and the number of subwords."""
    means, counts = [], []
    for chunk in chunks(column):
        row, bucket = subwords(chunk)
        n = np.bincount(row, minlength=chunk.rows)
        s = np.stack([np.bincount(row, model.scores[bucket, k], chunk.rows) for k in range(model.scores.shape[1])], axis=1)
        means.append(s / np.maximum(n, 1)[:, None])
        counts.append(n)
    return np.concatenate(means) if means else np.zeros((0, model.scores.shape[1])), np.concatenate(counts) if counts else np.zeros(0)


def predict(column: pa.Array, has_letter: pa.Array, model: LanguageModel) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, calibrated probability and acceptance of each row."""
    means, _ = _scores(column, model)
    known = np.asarray(pc.fill_null(has_letter, False)) & bool(model.labels)
    if not len(means) or not model.labels:
        return [UNKNOWN] * len(column), np.zeros(len(column)), np.zeros(len(column), bool)
    p = model.probabilities(means)[:, : len(model.labels)]
    best = p.argmax(axis=1)
    score = np.where(known, p.max(axis=1), 0.0)
    return [model.labels[b] if k else UNKNOWN for b, k in zip(best, known)], score, known & (score >= model.threshold)


def _predict(batches, model: LanguageModel):
    for batch in batches:
        names, score, accepted = predict(batch.column(2), batch.column(3), model)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(score), pa.array(accepted)], names=["id_", "lang_", "lang_pred", "score", "accepted"])


def held_out(key: Column) -> Column:
    """The third of the ids that is never learnt from (null: not held out)."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _letters(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score, accepted`` for every row.

    A null text or one without a letter is ``und`` with score 0 and not accepted.  With no learnt language all are
    ``und``; with one learnt language it is predicted for all others, with the probability that it is no background.
    Ids and labels are not inputs of a prediction.
    """
    rows = docs.select(docs[id_col].cast("long").alias("id_"), docs[label_col].cast("string").alias("lang_"), docs[text_col].alias("text_"), _letters(docs[text_col]).alias("letters_"))
    found = rows.mapInArrow(partial(_predict, model=model), _PREDICTED)
    return found.select(F.col("id_").alias(id_col), held_out(F.col("id_")).alias("held_out"), "lang_pred", "score", "accepted")


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> LanguageModel:
    """A model from the rows that are not held out."""
    return train(docs.where(~held_out(docs[id_col])), id_col, text_col, label_col)


def keep_accepted(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose language is rejected; all columns as they were.

    Only texts go to Python and only verdicts come back; the rows wait for them in Spark, which spills them.
    """

    @F.arrow_udf("boolean")
    def accepted(texts: pa.Array, letters: pa.Array) -> pa.Array:
        return pa.array(predict(texts, letters, model)[2])

    return docs.where(accepted(docs[text_col], _letters(docs[text_col])))
