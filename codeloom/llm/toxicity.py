"""Operator 4: toxicity by cumulative-link ordinal regression on sparse text features.

P(grade <= k) = logistic(cut_k - w.x): one weight vector for all ordered
cuts. x holds 1 for each hashed word a text contains. The labels say toxic or
not; toxic texts are graded 1 to 3 by how often words that tell toxic texts
apart occur in them, so the grades above 1 say how much of what the labels
call toxic a text holds, not how bad a person would find it. The result is the
expected grade.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import common

#: The sample the model is fitted on: so many labelled texts of each label at most, by a seeded hash of doc_id.
SAMPLE = 4000
#: Hashed features.
FEATURES = 1 << 20
#: Texts of the sample that must hold a feature for it to get a weight.
LEAST_TEXTS = 4
#: ... and this share of its toxic texts; and its log odds of being in a toxic text rather than a clean one.
LEAST_SHARE = 0.01
LEAST_LOG_ODDS = 2.5
GRADES = 3
#: Expected grades from here on are toxic.
TOXIC_FROM = 0.5


#: Besides whole words, their first so many characters are features: stems show whatever ending follows.
STEMS = (4, 5, 6)


def word_columns(distinct: pa.Array) -> np.ndarray:
    """The features of each distinct word, a column for the word and for each stem; -1 where the word is no longer than it."""
    kinds = [common.hash_strings(distinct)]
    length = pc.utf8_length(distinct).to_numpy(zero_copy_only=False)
    for n in STEMS:
        stem = common.mix64(common.hash_strings(pc.utf8_slice_codeunits(distinct, 0, n)) + np.uint64(n))
        kinds.append(np.where(length >= n, (stem % np.uint64(FEATURES)).astype(np.int64), -1))
    kinds[0] = (kinds[0] % np.uint64(FEATURES)).astype(np.int64)
    return np.stack(kinds, axis=1)


def token_columns(texts: pa.Array, keep=None) -> tuple[np.ndarray, np.ndarray, int]:
    """(row, feature) of every token's features, repeats included; keep: maps features to those wanted, or -1."""
    words, ends = common.lower_words(texts)
    coded = words.dictionary_encode()
    columns = word_columns(coded.dictionary)
    if keep is not None:
        columns = keep(columns)
    index = coded.indices.to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    some = (columns >= 0).any(axis=1)[index]
    rows, columns = np.repeat(rows[some], columns.shape[1]), columns[index[some]].ravel()
    return rows[columns >= 0], columns[columns >= 0], len(ends) - 1


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted (row, feature) pairs of the texts without repeats, and how often each occurs."""
    rows, columns, _ = token_columns(texts)
    keys, n = np.unique(rows * FEATURES + columns, return_counts=True)
    return keys // FEATURES, keys % FEATURES, n


def logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Model:
    """Weights of a few features, and the ordered cuts."""

    def __init__(self, columns: np.ndarray, weights: np.ndarray, cuts: np.ndarray):
        self.columns, self.weights, self.cuts = columns, weights, cuts

    def scores(self, texts: pa.Array) -> np.ndarray:
        """w.x of each text."""
        def known(columns: np.ndarray) -> np.ndarray:
            if not len(self.columns):
                return np.full(columns.shape, -1)
            spot = np.minimum(np.searchsorted(self.columns, columns), len(self.columns) - 1)
            return np.where(self.columns[spot] == columns, spot, -1)

        rows, spots, n = token_columns(texts, known)
        width = max(1, len(self.columns))
        keys = np.unique(rows * width + spots)
        return np.bincount(keys // width, weights=self.weights[keys % width], minlength=n)

    def at_least(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each cut k, a column each."""
        return logistic(score[:, None] - self.cuts[None, :])

    def expected(self, score: np.ndarray) -> np.ndarray:
        return self.at_least(score).sum(axis=1) if len(self.cuts) else np.zeros(len(score))


def telling(bad, good, toxic: int, clean: int):
    """Whether features in so many toxic and clean texts of the sample are in enough toxic ones, and much more often than in clean ones."""
    share = np.log((bad + 0.5) / (toxic + 1)) - np.log((good + 0.5) / (clean + 1))
    return (bad >= max(LEAST_TEXTS, LEAST_SHARE * toxic)) & (share > LEAST_LOG_ODDS)


def grades(toxic: np.ndarray, row: np.ndarray, n: np.ndarray) -> np.ndarray:
    """0 for clean texts; for toxic ones 1 to GRADES by terciles of how often telling features occur."""
    hits = np.bincount(row, weights=n, minlength=len(toxic))
    out = np.zeros(len(toxic), np.int64)
    if (toxic == 1).any():
        levels = np.quantile(hits[toxic == 1], np.arange(1, GRADES) / GRADES)
        out[toxic == 1] = 1 + (hits[toxic == 1, None] > levels[None, :]).sum(axis=1)
    return out


def fit(row: np.ndarray, column: np.ndarray, grade: np.ndarray, steps: int = 600, shrink: float = 1e-4) -> Model:
    """Maximum likelihood with an L2 penalty and weights of 0 or more, by accelerated projected gradient steps.

    Grades missing from the sample get no cut of their own; with one grade
    only, the model has no cuts and expects 0.
    """
    n = len(grade)
    present = [k for k in range(1, int(grade.max(initial=0)) + 1) if (grade >= k).any() and (grade < k).any()]
    if not present:
        return Model(np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
    top = len(present)
    columns, local = np.unique(column, return_inverse=True)
    level = np.searchsorted(present, grade, "right")
    low, high = np.maximum(level - 1, 0), np.minimum(level, top - 1)
    base = np.array([(level >= k + 1).mean() for k in range(top)])
    cuts = -np.log(base / (1 - base))
    w = np.zeros(len(columns))

    def score(v):
        return np.bincount(row, weights=v[local], minlength=n)

    # the logistic's curvature is 1/4 at most; the largest eigenvalue by power iteration, with the cuts' own
    probe = np.ones(len(columns))
    for _ in range(20):
        probe = np.bincount(local, weights=score(probe)[row], minlength=len(columns))
        norm = np.linalg.norm(probe) or 1.0
        probe /= norm
    step = n / (0.5 * (norm + n))

    def slopes(v, c):
        s = score(v)
        upper = np.where(level < top, logistic(c[high] - s), 1.0)
        lower = np.where(level > 0, logistic(c[low] - s), 0.0)
        p = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper), lower * (1 - lower)
        ds = (du - dl) / p / n
        dc = np.bincount(low, weights=dl / p / n, minlength=top) - np.bincount(high, weights=du / p / n * (level < top), minlength=top)
        return np.bincount(local, weights=ds[row], minlength=len(columns)) + shrink * v, dc, -np.log(p).mean() + shrink / 2 * (v @ v)

    (v, c), t, best = (w, cuts), 1.0, np.inf
    for _ in range(steps):
        dv, dc, loss = slopes(v, c)
        if loss > best:  # the momentum overshot: start it again
            t, (v, c) = 1.0, (w, cuts)
            dv, dc, loss = slopes(v, c)
        best = loss
        new, moved = np.maximum(v - step * dv, 0), np.maximum.accumulate(c - step * dc)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        m = (before - 1) / t
        v, c = np.maximum(new + m * (new - w), 0), np.maximum.accumulate(moved + m * (moved - cuts))
        w, cuts = new, moved
    used = w > 1e-6
    return Model(columns[used], w[used], cuts)


def sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, seed: int = 4) -> DataFrame:
    """text, toxic of at most `most` labelled texts of each label: copies are one, and so are rows of one doc_id (the text of the least hash)."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("_toxic"))
    draw = F.xxhash64(F.lit(seed), F.col("doc_id"))
    chosen = [known.where(F.col("_toxic") > 0 if bad else F.col("_toxic") <= 0).withColumn("_draw", draw).orderBy("_draw", "doc_id").limit(most) for bad in (True, False)]
    ids = chosen[0].unionByName(chosen[1]).select(F.col("doc_id").alias("_id"), (F.col("_toxic") > 0).cast("int").alias("_toxic"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), F.col("doc_id") == F.col("_id"))
    one = rows.groupBy("_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("_toxic").alias("_toxic"))
    return one.groupBy("text").agg(F.max("_toxic").alias("toxic"))


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    """The model of a bounded sample of labelled rows.

    Features are made and counted where the texts are; the driver gets the
    telling ones alone, each in a hundredth of the toxic texts or more.
    """
    rows = common.stored(sample(docs, labels, most), "toxicity-sample")
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch):
                row, column, _ = features(part.column(0))
                bad = part.column(1).to_numpy()[row]
                found, place = np.unique(column, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.bincount(place, bad, len(found)).astype(np.int64)), pa.array(np.bincount(place, 1 - bad, len(found)).astype(np.int64))], names=["column", "bad", "good"])

    counted = rows.mapInArrow(count, "column bigint, bad bigint, good bigint").groupBy("column").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    counted = counted.where(F.col("bad") >= max(LEAST_TEXTS, LEAST_SHARE * toxic)).toArrow()
    tells = np.sort(counted.column("column").to_numpy()[telling(counted.column("bad").to_numpy(), counted.column("good").to_numpy(), toxic, clean)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch):
                row, column, n = features(part.column(0))
                keep = np.isin(column, tells)
                row, column, n = row[keep], column[keep], n[keep]
                ends = np.searchsorted(row, np.arange(part.num_rows + 1))
                spans = list(zip(ends[:-1], ends[1:], strict=True))
                columns = [part.column(1), *[pa.array([x[a:b].astype(np.int32).tobytes() for a, b in spans], pa.binary()) for x in (column, n)]]
                yield pa.RecordBatch.from_arrays(columns, names=["toxic", "columns", "n"])

    kept = rows.mapInArrow(run, "toxic int, columns binary, n binary").toArrow().sort_by([("toxic", "ascending"), ("columns", "ascending"), ("n", "ascending")])
    common.forget(rows)
    lists = [[np.frombuffer(x, np.int32) for x in kept.column(c).to_pylist()] for c in ("columns", "n")]
    row = np.repeat(np.arange(len(kept)), [len(x) for x in lists[0]])
    column, n = (np.concatenate([np.zeros(0, np.int32), *x]).astype(np.int64) for x in lists)
    bad = kept.column("toxic").to_numpy().astype(np.int64)
    return fit(row, column, grades(bad, row, n))


def _marked(docs: DataFrame, model: Model) -> DataFrame:
    """row (all columns of docs, whatever their names) and marks (severity, p_toxic)."""
    common.small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("severity double, p_toxic double")
    def severity(texts: pd.Series) -> pd.DataFrame:
        model, out = sent.value, []
        for part in common.slices(pa.record_batch([pa.array(texts, pa.large_string())], names=["text"])):
            out.append(model.scores(part.column(0)))
        s = np.concatenate([np.zeros(0), *out])
        over = model.at_least(s)
        return pd.DataFrame({"severity": model.expected(s), "p_toxic": over[:, 0] if over.shape[1] else np.zeros(len(s))})

    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), severity(F.col("text").cast("string")).alias("marks"))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with _severity (expected grade, 0 to 3) and _p_toxic (of grade 1 or more).

    Whole texts are scored; null and empty ones hold no features and get the
    score of none. Rows are independent of each other, repeated ones too, and
    an empty table stays empty. All columns of docs stay, but for those that
    have the names of the two results.
    """
    rest = [F.col(f"row.`{c}`") for c in docs.columns if c not in ("_severity", "_p_toxic")]
    return _marked(docs, model).select(*rest, F.col("marks.severity").alias("_severity"), F.col("marks.p_toxic").alias("_p_toxic"))


def keep_clean(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """docs without those whose expected grade is toxic; columns as they were, whatever their names."""
    return _marked(docs, train(docs, labels, most)).where(F.col("marks.severity") < TOXIC_FROM).select("row.*")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    out = score(docs.select("doc_id", "text"), train(docs, labels))
    return out.select("doc_id", F.col("_severity").alias("severity"), F.col("_p_toxic").alias("p_toxic"), (F.col("_severity") >= TOXIC_FROM).alias("toxic"))
