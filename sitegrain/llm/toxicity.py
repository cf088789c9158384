"""Toxicity: a logistic model of words and word beginnings whose scores may not hang on identity terms.

Features are a text's distinct lower-cased words and their beginnings of 4 to 7 letters, hashed. The model is fitted on a
bounded sample of labelled documents (the SAMPLE smallest id hashes; all of them where there are fewer), and is the same
for all data. Training is counterfactual: in each labelled text identity terms are swapped for others of their list, and
the squared change of the score is a penalty beside the loss; neutral mentions of groups are thereby learned to be neutral. Scoring
reads whole texts; a task works a word's weight out once.

Labels, language, source and doc_id are no inputs. Defined cases: a null or empty text gets the score of no features. Rows
with a null or repeated doc_id give a row each. Without labels of both classes every score is the share of toxic
labels (0 without any). Empty tables give an empty result. Columns other than doc_id and text, and doc_id and toxic of the
labels, play no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegrain.llm.common import held, texts

#: Labelled documents that the model is fitted on; of each, whole, its distinct buckets leave the task.
SAMPLE = 6_000
BUCKETS = 1 << 18
EPOCHS, RATE, RIDGE, COUNTERFACTUAL = 200, 0.2, 1e-5, 1.0
#: Standard deviations by which a feature's share of toxic texts must differ from the share of all, to be used at all.
DEVIATIONS = 4.0
WORDS_KEPT = 400_000
#: Terms that name groups of people; a term may be swapped for any other of its list.
IDENTITY = [
    "women men girls boys wife husband mother father female male".split(),
    "christian muslim jewish hindu buddhist atheist catholic protestant".split(),
    "black white asian african european american latino arab".split(),
    "gay straight lesbian bisexual transgender".split(),
    "young old elderly disabled blind deaf".split(),
    "frauen männer muslime christen juden ausländer deutsche".split(),
    "femmes hommes musulmans chrétiens juifs étrangers français".split(),
    "mujeres hombres musulmanes cristianos judíos extranjeros españoles".split(),
]
_SWAP = {word: own[(i + 1) % len(own)] for own in IDENTITY for i, word in enumerate(own)}
_WORD = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[int]:
    """Buckets of a lower-cased word: the word itself and its beginnings."""
    forms = [f"={word}", *(f"^{word[:n]}" for n in range(4, 8) if len(word) >= n)]
    return [xxhash.xxh3_64_intdigest(x.encode()) % BUCKETS for x in forms]


def buckets(words: set[str], cache: dict) -> np.ndarray:
    """The distinct buckets of a text's words."""
    own: set[int] = set()
    for w in words:
        if w not in cache:
            cache[w] = features(w)
        own.update(cache[w])
    return np.fromiter(own, np.int32, len(own))


def fit(found: list[np.ndarray], other: list[np.ndarray | None], label: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and intercept. found: each text's buckets; other: those of the text with its identity terms swapped, if it has any."""
    share = float(label.mean()) if len(label) else 0.0
    if share in (0.0, 1.0):
        return np.zeros(BUCKETS), (-50.0 if share == 0 else 50.0)
    swapped = [i for i, x in enumerate(other) if x is not None]
    row, col = _flat(found)
    other_row, other_col = _flat([other[i] for i in swapped])
    keep = _telling(row, col, label, share)
    (row, col), (other_row, other_col) = ((r[keep[c]], c[keep[c]]) for r, c in ((row, col), (other_row, other_col)))
    n, twins = len(found), np.array(swapped, np.int64)
    weight, bias, past = np.zeros(BUCKETS), float(np.log(share / (1 - share))), np.full(BUCKETS, 1e-8)
    # the rare class counts half-way as much as the frequent one
    importance = np.where(label == 1, np.sqrt((1 - share) / share), 1.0)
    for _ in range(EPOCHS):
        z = bias + np.bincount(row, weight[col], n)
        slope = importance * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - label) / n
        gradient = np.bincount(col, slope[row], BUCKETS) + RIDGE * weight
        if len(twins):
            change = z[twins] - (bias + np.bincount(other_row, weight[other_col], len(twins)))
            pull = np.zeros(n)
            pull[twins] = 2 * COUNTERFACTUAL * change / n
            gradient += np.bincount(col, pull[row], BUCKETS) - np.bincount(other_col, pull[twins][other_row], BUCKETS)
        # steps are scaled by each feature's own past gradients
        past += gradient**2
        weight -= RATE * gradient / np.sqrt(past)
        bias -= RATE * float(slope.sum())
    return weight, bias


def _flat(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of every feature."""
    row = np.repeat(np.arange(len(found), dtype=np.int32), [len(x) for x in found])
    return row, np.concatenate([np.empty(0, np.int32), *found])


def _telling(row: np.ndarray, col: np.ndarray, label: np.ndarray, share: float) -> np.ndarray:
    """Whether a bucket's texts differ in their share of toxic labels by more than chance."""
    texts_of, toxic = np.bincount(col, minlength=BUCKETS), np.bincount(col, label[row], BUCKETS)
    z = (toxic - texts_of * share) / np.sqrt(np.maximum(texts_of * share * (1 - share), 1e-9))
    return (texts_of >= 3) & (np.abs(z) >= DEVIATIONS)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Weights and intercept, from labelled documents (doc_id, toxic), a bounded number of them."""
    own = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    own = held(own.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            own, other = [], []
            for text in batch.column(1):
                words = set(_WORD.findall(text.as_py().lower()))
                own.append(buckets(words, cache).tobytes())
                other.append(None if _SWAP.keys().isdisjoint(words) else buckets({_SWAP.get(w, w) for w in words}, cache).tobytes())
            if len(cache) > WORDS_KEPT:
                cache.clear()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(own, pa.binary()), pa.array(other, pa.binary())], ["doc_id", "toxic", "own", "other"])

    rows = texts(docs).join(F.broadcast(own), "doc_id").select("doc_id", "text", "toxic")
    rows = rows.mapInArrow(run, "doc_id long, toxic int, own binary, other binary").toArrow().sort_by("doc_id")
    found, other = ([None if x.as_py() is None else np.frombuffer(x.as_buffer(), np.int32) for x in rows[name]] for name in ("own", "other"))
    return fit(found, other, rows["toxic"].to_numpy().astype(np.float64))


def scored(docs: DataFrame, weights: tuple[np.ndarray, float]) -> DataFrame:
    """doc_id and score (0 to 1) of every whole text."""
    weight, bias = weights
    used = np.flatnonzero(weight).astype(np.int32)
    values = weight[used].astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = dict(zip(used.tolist(), values.tolist(), strict=True))
        known: dict[str, tuple] = {}
        for batch in batches:
            out = []
            for text in batch.column(1):
                own: set[int] = set()
                for word in set(_WORD.findall(text.as_py().lower())):
                    found = known.get(word)
                    if found is None:
                        known[word] = found = tuple(x for x in features(word) if x in table)
                    if found:
                        own.update(found)
                out.append(bias + sum(table[x] for x in sorted(own)))
            if len(known) > WORDS_KEPT:
                known.clear()
            score = 1 / (1 + np.exp(-np.clip(np.array(out, np.float64), -50, 50)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["doc_id", "score"])

    return texts(docs).mapInArrow(run, "doc_id long, score double")


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from training: crc32 of its id as text, modulo 5, is 0."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0
