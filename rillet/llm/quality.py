"""Quality classifier by Bradley-Terry pairwise ranking.

Each text gets a vector of features, by numpy over the UTF-8 bytes of many texts at once (an Arrow UDF): shares of kinds of
characters, of words met again and of distinct words, lengths, and hashed counts of words and of three bytes in a row, WORDS
and RUNS of them, as shares. Preference pairs are drawn between labelled rows of label 1 and label 0; the probability that
one is preferred is the logistic function of the difference of their linear scores, and the weights minimise the logistic
loss on feature differences (Newton's method, with a ridge). The threshold is a quantile of the training rows' scores: the
share of label 0. Scores are then mapped to 0..1 so that the threshold falls on CUT.

Fitting reads at most MAX_LABELLED labelled rows, those with the smallest hashes, and draws PAIRS pairs: both are
parameters, and bound what the driver holds (a vector of some 270 numbers for each of these rows). All documents are scored.

Defined results: null or empty text has the features of an empty text and a score like any other; rows are kept as they
are, repeated or with a null identifier; labels that are null, contradictory for one key (the lower counts) or without
a document are passed over; if only one label occurs, every score is CUT for label 1 and 0 for label 0; an empty
table gives an empty result; other columns of documents pass through `keep`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W

MAX_LABELLED = 20_000
PAIRS = 40_000
CUT = 0.7
RIDGE = 1e-3
WORDS, RUNS = 128, 128
#: Bytes of text that are looked at together, or one text.
TOGETHER = 1 << 17
#: Kinds of bytes: small letter, capital, digit, symbol, sign that ends a sentence, exclamation mark, other sign, space, new line, part of a longer character.
SMALL, CAPITAL, DIGIT, SYMBOL, END, BANG, SIGN, SPACE, LINE, WIDE = range(10)
NAMES = ("small", "capital", "digit", "symbol", "end", "bang", "sign", "line", "wide", "word length", "words", "again", "distinct")


def _kinds() -> np.ndarray:
    out = np.full(256, SIGN, np.uint8)
    out[np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)] = SMALL
    out[np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", np.uint8)] = CAPITAL
    out[np.frombuffer(b"0123456789", np.uint8)] = DIGIT
    out[np.frombuffer(b"#$%&*+<=>@^_~{}[]\\|/", np.uint8)] = SYMBOL
    out[np.frombuffer(b".?", np.uint8)] = END
    out[ord("!")] = BANG
    out[W.SEPARATOR] = SPACE
    out[ord("\n")] = LINE
    out[128:] = WIDE
    return out


KINDS = _kinds()


def vectors(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of features for each text: those of NAMES, then the hashed words, then the hashed runs of bytes."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    text = np.repeat(np.arange(n, dtype=np.int32), size)
    counts = np.bincount(text * np.int32(10) + KINDS[data], minlength=10 * n).reshape(n, 10).astype(float)
    hashes, first = W.word_hashes(data, offsets)
    of = np.repeat(np.arange(n), np.diff(first))
    words = np.maximum(np.diff(first), 1).astype(float)
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    kinds = np.unique((of.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)))
    distinct = np.bincount((kinds >> np.uint64(40)).astype(np.int64), minlength=n)
    chars = np.maximum(size, 1).astype(float)
    plain = [np.sqrt(counts[:, k] / chars) for k in (SMALL, CAPITAL, DIGIT, SYMBOL, END, BANG, SIGN, LINE, WIDE)]
    plain += [chars / words / 10, np.log(words), np.sqrt(np.bincount(of[again], minlength=n) / words), distinct / words * np.log(words + 1)]
    out = np.zeros((n, len(NAMES) + WORDS + RUNS), np.float32)
    out[:, : len(NAMES)] = np.stack(plain, 1)
    bucket = (hashes >> np.uint64(32)).astype(np.int64) % WORDS
    out[:, len(NAMES) : len(NAMES) + WORDS] = np.bincount(of * WORDS + bucket, minlength=n * WORDS).reshape(n, WORDS) / words[:, None]
    if len(data) > 2:
        whole = np.flatnonzero(text[:-2] == text[2:])
        three = data[:-2].astype(np.uint32) | data[1:-1].astype(np.uint32) << np.uint32(8) | data[2:].astype(np.uint32) << np.uint32(16)
        run = (three * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(np.int32) % np.int32(RUNS)
        out[:, len(NAMES) + WORDS :] = np.bincount(text[whole] * np.int32(RUNS) + run[whole], minlength=n * RUNS).reshape(n, RUNS) / chars[:, None]
    return out


def _each(column: pa.Array):
    """Features of the texts of an Arrow column, some at a time."""
    data, offsets = W.text_buffers(column)
    for a, b in W.slices(offsets, TOGETHER):
        yield vectors(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.concatenate([np.zeros((0, len(NAMES) + WORDS + RUNS), np.float32), *_each(column)])


def features(text: Column) -> Column:
    """The features of a text as an array of floats."""

    @F.arrow_udf("array<float>")
    def run(column: pa.Array) -> pa.Array:
        x = _matrix(column)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))

    return run(text)


def held_out(key: Column, folds: int = 4, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == fold, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", most: int = MAX_LABELLED, pairs: int = PAIRS, seed: int = 7) -> dict:
    """Weights, centre and threshold, from rows of labels that are not held out."""
    known = labels.select(F.col(key).alias("__k"), F.col(label).alias("__y")).where(F.col("__k").isNotNull() & F.col("__y").isin(0, 1) & ~held_out(F.col("__k")))
    known = known.groupBy("__k").agg(F.min("__y").alias("__y")).orderBy(F.xxhash64("__k"), "__k").limit(most)  # at most `most` rows: bounded to broadcast and to collect
    read = docs.select(F.col(key).alias("__k"), F.col(text).alias("__t")).join(F.broadcast(known), "__k").select("__k", "__y", features(F.col("__t")).alias("__f"))
    rows = read.groupBy("__k", "__y").agg(F.min("__f").alias("__f")).orderBy("__k").toArrow()
    y = rows["__y"].to_numpy().astype(int)
    if len(set(y.tolist())) < 2:
        return {"only": int(y[0]) if len(y) else 1}
    x = rows["__f"].combine_chunks().flatten().to_numpy().reshape(len(y), -1)
    mean, sd = x.mean(0, dtype=float), np.maximum(x.std(0, dtype=float), 1e-4)
    z = (x - mean) / sd
    rng = np.random.default_rng(seed)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    better, worse = rng.choice(good, pairs), rng.choice(bad, pairs)
    w = np.zeros(z.shape[1])
    for _ in range(30):
        grad, hess = -RIDGE * w, RIDGE * np.eye(len(w))
        for at in range(0, pairs, 4096):  # the pairs' differences are never held all at once
            d = z[better[at : at + 4096]] - z[worse[at : at + 4096]]
            p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
            grad += d.T @ (1 - p) / pairs
            hess += (d * (p * (1 - p))[:, None]).T @ d / pairs
        step = np.linalg.solve(hess, grad)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    s = z @ w
    cut = float(np.quantile(s, (y == 0).mean()))
    scale = 2.0 / max(float(np.std(s)), 1e-9)
    return {"weights": (w / sd).tolist(), "shift": float(-(mean / sd) @ w - cut), "scale": scale}


def score(text: Column, model: dict) -> Column:
    if "only" in model:
        return F.when(text.isNull(), F.lit(CUT * model["only"])).otherwise(F.lit(CUT * model["only"])).cast("double")
    weights, shift = np.array(model["weights"]), model["shift"]

    @F.arrow_udf("double")
    def raw(column: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([np.zeros(0), *((x * weights).sum(1) + shift for x in _each(column))]))  # summed row by row, so equal texts get equal scores

    return 1 / (1 + F.exp(-(raw(text) * model["scale"] + float(np.log(CUT / (1 - CUT))))))


def classify(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, held_out, score and predicted for each row of docs."""
    model = fit(docs, labels, text, key)
    return docs.select(F.col(key), held_out(F.col(key)).alias("held_out"), score(F.col(text), model).alias("score")).withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def keep(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows that the classifier accepts, with all their columns."""
    return docs.where(score(F.col(text), fit(docs, labels, text, key)) >= CUT)
