"""Topics of a long-form weight table by non-negative factorisation, X ~ W H."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Estimator, Model
from pyspark.sql import DataFrame, functions as F

from corpuslab.plans.storage import written

SWEEPS = 50


def _row_factors(x_topics: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """Columns w >= 0 with least |x - H'w|, one per document: coordinate descent, all documents of a batch at once."""
    w = np.maximum(x_topics, 0.0) / np.maximum(gram.diagonal(), 1e-12)[:, None]
    for _ in range(SWEEPS):
        before = w.copy()
        for t in range(gram.shape[0]):
            if gram[t, t] > 0:
                w[t] = np.maximum(0.0, w[t] + (x_topics[t] - gram[t] @ w) / gram[t, t])
        if np.abs(w - before).max(initial=0.0) < 1e-9:
            break
    return w


def _solve_batch(entries: tuple[np.ndarray, np.ndarray, np.ndarray], n: int, factor: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """Factors (topic, document) of the ``n`` documents of a batch."""
    doc, at, weight = entries
    return _row_factors(np.stack([np.bincount(doc, row[at] * weight, n) for row in factor]), gram)


def _entries(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document number, term position and weight of all entries of a batch, as Arrow holds them."""
    at, weight = batch.column("at"), batch.column("weight")
    sizes = pc.list_value_length(at).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(batch.num_rows), sizes), at.flatten().to_numpy(), weight.flatten().to_numpy()


class Nmf(Estimator):
    """Fit ``k`` topics on (id, term, weight) with a bounded vocabulary.

    Documents stay distributed; the k x vocabulary factor is small (k times the
    vocabulary limit) and is sent to the tasks. Each round solves the rows of W
    anew from H, so no state per document is kept between rounds. Tasks return
    only W'X and W'W, summed by Spark; H is then updated from those two.
    """

    def __init__(self, vocabulary: DataFrame, k: int = 10, max_iter: int = 50, tol: float = 1e-4, seed: int = 42):
        super().__init__()
        self.vocabulary, self.k, self.max_iter, self.tol, self.seed = vocabulary, k, max_iter, tol, seed

    def _fit(self, df: DataFrame) -> Model:
        return self._learn(df)[0]

    def fit_transform(self, df: DataFrame) -> tuple[Model, DataFrame]:
        """The fitted step and its result on the same documents, which are put together once."""
        model, docs = self._learn(df)
        return model, model.solved(docs)

    def _learn(self, df: DataFrame) -> tuple[NmfModel, DataFrame]:
        terms = [r["term"] for r in self.vocabulary.select("term").orderBy("term").collect()]
        model = NmfModel(terms, np.zeros((self.k, len(terms))), [])
        docs = written(model.rows(df), "topic-rows")
        total, n = docs.agg(F.sum("square"), F.count(F.lit(1))).first()
        rng = np.random.default_rng(self.seed)
        scale = np.sqrt((total or 0.0) / max(1, n * len(terms)) / self.k)
        model.factor = scale * np.abs(rng.standard_normal((self.k, len(terms)))) + 1e-3
        for _ in range(self.max_iter):
            loss = self._round(docs, model, total or 0.0)
            model.losses.append(loss)
            if len(model.losses) > 1 and model.losses[-2] - loss <= self.tol * max(model.losses[0], 1e-12):
                break
        return model, docs

    def _round(self, docs: DataFrame, model: NmfModel, total: float) -> float:
        k, factor = self.k, model.factor
        gram = factor @ factor.T
        width = factor.shape[1]

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            wx, ww = np.zeros((k, width)), np.zeros((k, k))
            for batch in batches:
                entries = doc, at, weight = _entries(batch)
                w = _solve_batch(entries, batch.num_rows, factor, gram)
                ww += w @ w.T
                for t in range(k):
                    wx[t] += np.bincount(at, w[t][doc] * weight, width)
            both = np.hstack([wx, ww])
            topic, pos = np.nonzero(both)
            yield pa.RecordBatch.from_pydict({"topic": topic.astype("int32"), "pos": pos.astype("int32"), "x": both[topic, pos]})

        # k * (vocabulary + k) sums, whatever the number of documents
        rows = docs.select("at", "weight").mapInArrow(sums, "topic int, pos int, x double").groupBy("topic", "pos").agg(
            F.sum("x").alias("x")).toPandas()
        both = np.zeros((k, width + k))
        both[rows["topic"], rows["pos"]] = rows["x"]
        wx, ww = both[:, :width], both[:, width:]
        loss = total - 2 * float((wx * factor).sum()) + float((ww * gram).sum())
        new = factor.copy()
        for _ in range(SWEEPS):
            for t in range(k):
                if ww[t, t] > 0:
                    new[t] = np.maximum(0.0, new[t] + (wx[t] - ww[t] @ new) / ww[t, t])
        model.factor = new
        return loss


class NmfModel(Model):
    """``factor``: k x vocabulary; ``losses``: squared error before each update."""

    def __init__(self, terms: list[str], factor: np.ndarray, losses: list[float]):
        super().__init__()
        self.terms, self.factor, self.losses = terms, factor, losses

    def rows(self, df: DataFrame) -> DataFrame:
        """(id, at, weight, square): one row per document, terms as positions."""
        places = df.sparkSession.createDataFrame(list(enumerate(self.terms)), "pos int, term string")
        spark = df.sparkSession
        # tasks solve small systems in numpy: keep at least one partition per core
        parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        return (
            df.join(F.broadcast(places), "term")
            .repartition(parts, "id")
            .groupBy("id")
            # a document has at most one entry per vocabulary term
            .agg(F.sort_array(F.collect_list(F.struct("pos", "weight"))).alias("e"))
            .select("id", F.col("e.pos").alias("at"), F.col("e.weight").alias("weight"),
                    F.aggregate("e.weight", F.lit(0.0), lambda a, x: a + x * x).alias("square"))
        )

    def _transform(self, df: DataFrame) -> DataFrame:
        """(id, topics): topic weights per document with at least one known term."""
        return self.solved(self.rows(df))

    def solved(self, docs: DataFrame) -> DataFrame:
        """(id, topics) of documents in the form of :meth:`rows`."""
        factor = self.factor
        gram = factor @ factor.T

        def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                w = _solve_batch(_entries(batch), batch.num_rows, factor, gram)
                ends = np.arange(0, w.size + 1, len(w), dtype=np.int32)
                topics = pa.ListArray.from_arrays(ends, np.ascontiguousarray(w.T).ravel())
                yield pa.RecordBatch.from_arrays([batch.column("id"), topics], ["id", "topics"])

        return docs.select("id", "at", "weight").mapInArrow(solve, "id bigint, topics array<double>")

    def topic_terms(self, spark, top: int = 10) -> DataFrame:
        """(topic, term, weight): heaviest terms of each topic."""
        rows = [
            (t, self.terms[j], float(self.factor[t, j]))
            for t in range(len(self.factor)) for j in np.argsort(-self.factor[t])[:top]
        ]
        return spark.createDataFrame(rows, "topic int, term string, weight double")
