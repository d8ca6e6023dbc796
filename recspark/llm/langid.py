"""Language identification by nearest centroids.

A text becomes a vector of its byte n-grams (n = 1 to 3, hashed to `SIZE` places) weighted by 1 + log(count) times the
inverse document frequency and scaled to unit length. Each language has several centroids, found by spherical k-means. A
text takes the language of the centroid with the largest cosine; it is marked as rejected if it is farther from it than
nearly all of that centroid's own members.

The document frequencies come from all labelled training rows. The centroids are fitted on a bounded sample of them:
`fit_rows` per language at most, in expectation, picked by a hash of the id.

Defined results: a null text or one without a letter is `und` with score 0 and is rejected; rows with a null language are
never learned from; without any training row every text is `und`; repeated rows get equal answers; columns besides
`doc_id`, `text` and `lang` are not looked at, and the prediction reads the text alone, whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE = 4096
MAX_LANGUAGES = 1000
UNKNOWN = "und"
# ASCII that is no letter becomes a space, so that layout and digits say nothing.
LETTERS = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))
ROWS = 256


def counts(texts: list[str | None]) -> np.ndarray:
    """One row of n-gram counts per text."""
    out = np.zeros((len(texts), SIZE), dtype=np.float32)
    for row, text in enumerate(texts):
        data = b" " + b" ".join((text or "").lower().encode().translate(LETTERS).split()) + b" "
        if len(data) < 3:
            continue
        b = np.frombuffer(data, dtype=np.uint8).astype(np.uint32)
        two = (b[:-1] << 8 | b[1:]) + np.uint32(1 << 24)
        three = two[:-1] << 8 | b[2:]
        grams = np.concatenate([b, two, three]) * np.uint32(2654435761)
        out[row] = np.bincount(grams >> np.uint32(20), minlength=SIZE)
    return out


def weighted(found: np.ndarray, idf: np.ndarray) -> np.ndarray:
    rows = np.log1p(found) * idf
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norm > 0, norm, 1)


def blocks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list]]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            yield part, part.column(column).to_pylist()


@dataclass
class Model:
    """Bounded by MAX_LANGUAGES times `clusters` rows of SIZE numbers."""

    idf: np.ndarray
    languages: list[str]
    centroids: np.ndarray
    least: np.ndarray  # cosine below which a text is rejected


def _clusters(rows: np.ndarray, clusters: int, rounds: int, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means that starts from rows far apart; centroids and the cosine that all but `share` members reach."""
    chosen = [0]
    nearest = rows @ rows[0]
    while len(chosen) < min(clusters, len(rows)):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, rows @ rows[chosen[-1]])
    centre = rows[chosen].copy()
    for _ in range(rounds):
        own = (rows @ centre.T).argmax(axis=1)
        sums = np.zeros_like(centre)
        np.add.at(sums, own, rows)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centre = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centre)
    cosine = rows @ centre.T
    own = cosine.argmax(axis=1)
    least = [np.quantile(cosine[own == c, c], share) if (own == c).any() else 1.0 for c in range(len(centre))]
    return centre, np.array(least)


def fit(
    training: DataFrame, clusters: int = 4, fit_rows: int = 1500, rounds: int = 8, reject_share: float = 0.01
) -> Model | None:
    """Learn from rows with doc_id, text and lang."""
    rows = training.filter("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    known = rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(known) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not known:
        return None

    def document_frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(SIZE, dtype=np.int64), 0
        for _, texts in blocks(batches, 0):
            total += (counts(texts) > 0).sum(axis=0)
            n += len(texts)
        grams = np.append(np.arange(SIZE), -1)
        yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(np.append(total, n))], ["gram", "n"])

    frequency = rows.select("text").mapInArrow(document_frequency, "gram long, n long").groupBy("gram").agg(F.sum("n"))
    found = dict(frequency.collect())  # SIZE + 1 rows
    idf = np.log((1 + found[-1]) / (1 + np.array([found[g] for g in range(SIZE)]))).astype(np.float32) + np.float32(0.1)

    limit = spark_rates(training, {r["lang"]: fit_rows / r["n"] for r in known})
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.join(F.broadcast(limit), "lang").filter(spread < F.col("rate")).select("lang", "doc_id", "text")

    def centroids(pdf: pd.DataFrame) -> pd.DataFrame:
        texts = pdf.sort_values("doc_id")["text"].tolist()
        vectors = np.concatenate([weighted(counts(texts[i : i + ROWS]), idf) for i in range(0, len(texts), ROWS)])
        centre, least = _clusters(vectors, clusters, rounds, reject_share)
        return pd.DataFrame(
            {"lang": pdf["lang"].iloc[0], "cluster": range(len(centre)), "centroid": list(centre), "least": least}
        )

    fitted = (
        sample.groupBy("lang")
        .applyInPandas(centroids, "lang string, cluster int, centroid array<float>, least double")
        .collect()  # at most MAX_LANGUAGES * clusters rows
    )
    if not fitted:
        return None
    fitted.sort(key=lambda r: (r["lang"], r["cluster"]))
    return Model(
        idf, [r["lang"] for r in fitted], np.array([r["centroid"] for r in fitted], dtype=np.float32),
        np.array([r["least"] for r in fitted]),
    )


def spark_rates(frame: DataFrame, rates: dict[str, float]) -> DataFrame:
    return frame.sparkSession.createDataFrame(list(rates.items()), "lang string, rate double")


def predict(documents: DataFrame, model: Model | None, keys: list[Column]) -> DataFrame:
    """The key columns, lang_pred, score (cosine with the nearest centroid), rejected."""
    rows = documents.select(*keys, F.col("text").alias("__text"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("__has"))
    names = [f for f in rows.schema.names if not f.startswith("__")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(names)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in blocks(batches, len(names)):
            has = part.column(len(names) + 1).to_numpy(zero_copy_only=False).astype(bool)
            if model is None:
                lang, score, far = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
            else:
                cosine = weighted(counts(texts), model.idf) @ model.centroids.T
                best = cosine.argmax(axis=1)
                top = cosine[np.arange(len(best)), best].astype(np.float64)
                lang = [model.languages[b] if h else UNKNOWN for b, h in zip(best, has)]
                score = np.where(has, np.clip(top, 0.0, 1.0), 0.0)
                far = ~has | (top < model.least[best])
            yield pa.RecordBatch.from_arrays(
                [*part.columns[: len(names)], pa.array(lang), pa.array(score), pa.array(far)],
                [*names, "lang_pred", "score", "rejected"],
            )

    return rows.mapInArrow(scan, f"{schema}, lang_pred string, score double, rejected boolean")
