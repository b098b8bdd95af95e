"""Hierarchical language identification: the family first, then one-versus-one linear SVMs within it."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.hashing import chunks, mix, slices
from docloom.session import table

#: Languages of one family. Fixed values; a language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
    "uralic": ("fi", "et", "hu"),
    "indo-iranian": ("hi", "bn", "ur", "fa", "mr", "pa"),
}

WIDTH = 2048
#: Rows that the models learn from: so many a language, and so many together, at most. That is 32 MB at the driver.
#: Values of `lang` beyond the LANGUAGES most frequent are not learnt: each pair of a family has its own machine.
PER_LANGUAGE, TOGETHER, LANGUAGES = 400, 4_000, 200

#: One-versus-one machines over some classes: their names, and a row of weights for each pair, the last being the bias.
#: Plain lists and arrays, which workers can read without this module.
Choice = tuple[list[str], np.ndarray]

#: A-Z to a-z; other ASCII that is no letter to a space.
FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], dtype=np.uint8)


def family_of(lang: str) -> str:
    return next((f for f, members in FAMILIES.items() if lang in members), lang)


def features(texts: list[bytes]) -> np.ndarray:
    """A row for each text: square roots of the counts of hashed runs of one to three bytes, at unit length."""
    out = np.zeros((len(texts), WIDTH), dtype=np.float32)
    for a, b in chunks(texts):
        buf = FOLD[np.frombuffer(b" " + b" ".join(texts[a:b]) + b" ", dtype=np.uint8)].astype(np.uint64)
        buf[(buf == 32) & (np.roll(buf, 1) == 32)] = 0
        owner = np.repeat(np.arange(b - a), [len(t) + 1 for t in texts[a:b]])
        cells = np.zeros((b - a) * WIDTH)
        gram = buf.copy()
        for n in range(3):
            if n:
                gram = gram[:-1] << np.uint64(8) | buf[n:]
            code = (mix(gram + np.uint64(n << 40)) % np.uint64(WIDTH)).astype(np.int64)[: len(owner)]
            cells += np.bincount(owner[: len(code)] * WIDTH + code, minlength=len(cells))
        rows = np.sqrt(cells.reshape(b - a, WIDTH))
        out[a:b] = rows / np.maximum(np.sqrt((rows**2).sum(axis=1)), 1e-9)[:, None]
    return out


def linear_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 20) -> np.ndarray:
    """Weights, the last being the bias, of a linear support vector machine for y in {-1, 1}: dual coordinate descent."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)]).astype(np.float64)
    w, alpha, norm = np.zeros(x.shape[1]), np.zeros(len(x)), (x**2).sum(axis=1)
    rng = np.random.default_rng(0)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(x)):
            new = min(max(alpha[i] - (y[i] * (x[i] @ w) - 1) / norm[i], 0.0), c)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


def learn_choice(x: np.ndarray, y: np.ndarray) -> Choice:
    names = sorted(set(y))
    rows = [np.zeros(x.shape[1] + 1)]
    for a, b in itertools.combinations(names, 2):
        own = (y == a) | (y == b)
        rows.append(linear_svm(x[own], np.where(y[own] == a, 1.0, -1.0)))
    return names, np.array(rows[1:] or rows)


def choose(choice: Choice, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class that wins most duels, and how sure its weakest duel is, in 0 to 1."""
    names, weights = choice
    if len(names) == 1:
        return np.zeros(len(x), dtype=np.int64), np.ones(len(x))
    margin = x @ weights[:, :-1].T + weights[:, -1]
    won, weakest = np.zeros((len(x), len(names))), np.full((len(x), len(names)), np.inf)
    for k, (a, b) in enumerate(itertools.combinations(range(len(names)), 2)):
        won[:, a] += margin[:, k] > 0
        won[:, b] += margin[:, k] <= 0
        weakest[:, a] = np.minimum(weakest[:, a], margin[:, k])
        weakest[:, b] = np.minimum(weakest[:, b], -margin[:, k])
    best = np.argmax(won + np.clip(weakest, -4, 4) / 10, axis=1)
    return best, 1 / (1 + np.exp(-2 * np.clip(weakest[np.arange(len(x)), best], -30, 30)))


def learn(x: np.ndarray, langs: np.ndarray) -> tuple[Choice, dict[str, Choice]]:
    """The choice among families, and for each family the choice among its languages."""
    families = np.array([family_of(x) for x in langs], dtype=object)
    return learn_choice(x, families), {f: learn_choice(x[families == f], langs[families == f]) for f in sorted(set(families))}


def predict(model: tuple[Choice, dict[str, Choice]], texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """The language of each text, and the product of how sure the family and the language are."""
    family, language = model
    x = features([t.encode("utf-8", "surrogatepass") if t is not None else b"" for t in texts])
    chosen, score = choose(family, x)
    out = np.empty(len(texts), dtype=object)
    for k, name in enumerate(family[0]):
        own = np.flatnonzero(chosen == k)
        if len(own):
            at, sure = choose(language[name], x[own])
            out[own] = np.array(language[name][0], dtype=object)[at]
            score[own] *= sure
    silent = [i for i, t in enumerate(texts) if t is None or not any(c.isalpha() for c in t)]
    out[silent], score[silent] = "und", 0.0
    return out.tolist(), score


def training_rows(docs: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[np.ndarray, np.ndarray]:
    """Features and languages of a sample of the labelled rows, the same for the same rows.

    docs: lang, text. Of each of the LANGUAGES most frequent languages the `per_language` different texts with the least
    hashes, or fewer of each if there would be more than TOGETHER in all. A count by language tells which hashes to
    look at, so that only little more text than the sample's is moved, of each language alike.
    """
    counts = docs.where("lang is not null").groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    if not counts:
        return np.empty((0, WIDTH), dtype=np.float32), np.empty(0, dtype=object)
    each = max(1, min(per_language, TOGETHER // len(counts)))
    share = F.lit(0.0)
    for r in counts:
        share = F.when(F.col("lang") == r["lang"], F.lit(min(1.0, (1.5 * each + 20) / r["count"]))).otherwise(share)
    chosen = docs.select("lang", "text", F.xxhash64("text").alias("h")).where((F.col("h") / 2.0**64 + 0.5) <= share)
    chosen = chosen.where(F.col("lang").isin([r["lang"] for r in counts]))
    chosen = chosen.groupBy("lang", "h").agg(F.min("text").alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    chosen = chosen.withColumn("rank", rank).where(F.col("rank") <= each)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raw = [t.encode("utf-8", "surrogatepass") if t is not None else b"" for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("h"), pa.array([r.tobytes() for r in features(raw)], pa.binary())], names=["lang", "h", "x"])

    rows = chosen.select("lang", "h", "text").mapInArrow(vectors, "lang string, h long, x binary").toPandas().sort_values(["lang", "h"])
    x = np.frombuffer(b"".join(rows.x), dtype=np.float32).reshape(len(rows), WIDTH)
    return x, rows.lang.to_numpy(dtype=object)


def identify_languages(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of docs (doc_id, text, lang).

    Rows whose crc32(doc_id as text) mod 3 is 1 are held out; of the others a bounded sample of those with a language
    is learnt from (see training_rows). The score is the product of how sure the weakest duel of the family and of
    the language is. A text that is null or has no letter is `und` with score 0; so is all if nothing can be
    learnt. A null doc_id is not held out, nor learnt from. Repeated rows are predicted alike. An empty table gives no
    rows; whole texts count, however long. Other columns are ignored.
    """
    source = docs.select("doc_id", "lang", F.col("text").cast("string").alias("text"))
    source = source.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)))
    x, langs = training_rows(source.where("not held_out and doc_id is not null").select("lang", "text"))
    model = docs.sparkSession.sparkContext.broadcast(learn(x, langs) if len(x) else None)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            langs, score = predict(model.value, texts) if model.value else (["und"] * len(texts), np.zeros(len(texts)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    out = source.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "text")
    return out.mapInArrow(told, "doc_id long, held_out boolean, lang_pred string, score double")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    return identify_languages(table(spark, sf_dir, "documents"))
