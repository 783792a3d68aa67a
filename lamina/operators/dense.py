"""Vector search for a set of questions, exact or through an inverted file, and the vector store's rules."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamina.functions.scores import vector_problem
from lamina.session import cut_lineage

BLOCK = 256
QUERY_BYTES = 64 << 20
SAMPLE_ROWS, LISTS, PROBES, ROUNDS = 20_000, 64, 24, 12


def _unit(rows: list) -> np.ndarray:
    x = np.array(rows, dtype="float64")
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _nearest(distance: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k smallest distances of one row, ties by id."""
    if len(ids) > k:
        kth = np.partition(distance, k - 1)[k - 1]
        near = np.flatnonzero(distance <= kth)
    else:
        near = np.arange(len(ids))
    return near[np.lexsort((ids[near], distance[near]))[:k]]


def _slices(asked: DataFrame, columns: list[str]) -> Iterator[pd.DataFrame]:
    """The questions in as many parts as QUERY_BYTES asks for; mostly one.  Only one part is held at a time."""
    size = asked.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("vector")), F.lit(0)).alias("numbers")).first()
    parts = max(1, -(-8 * int(size["numbers"]) // QUERY_BYTES))
    for part in range(parts):
        rows = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part).select(*columns) if parts > 1 else asked.select(*columns)
        yield rows.toPandas()


def dense_top_k(corpus: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, id, distance, rank): the k nearest rows by cosine distance, ties by id.

    The corpus is scanned once, id and vector only.  The questions go to every executor as one matrix when they take up to QUERY_BYTES;
    each Arrow batch of the corpus meets them in blocks of BLOCK, one matrix product a block, and passes on k
    rows per question.  More questions are worked through in parts of that size, a scan each, and each part's k rows per question are
    stored before the next begins.  Rows whose vector is null or all zero take no part.  If corpus and queries have a column `lists`
    (a number, and an array of numbers), a row meets the questions that ask for its list only."""
    through = "lists" in corpus.columns and "lists" in queries.columns
    kinds = dict(corpus.dtypes)
    more = ["lists"] if through else []
    fair = corpus.filter(F.exists(vector, lambda e: e != 0)).select(F.col(key).alias("id"), F.col(vector).alias("v"), *more)
    asked = queries.filter(F.exists("vector", lambda e: e != 0)).select("query_id", "vector", *more)
    schema = f"query_id {dict(queries.dtypes)['query_id']}, id {kinds[key]}, distance double"
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    out, context = None, corpus.sparkSession.sparkContext

    for frame in _slices(asked, ["query_id", "vector", *more]):
        names = frame["query_id"].tolist()
        matrix = _unit(frame["vector"].tolist()) if names else np.zeros((0, 1))
        wanted = [frozenset(x) for x in frame["lists"]] if through and names else None
        shared = context.broadcast((names, matrix, wanted))

        def search(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            names, matrix, wanted = shared.value
            for rows in batches:
                if rows.empty or not names:
                    continue
                groups = [(None, rows)] if wanted is None else list(rows.groupby("lists"))
                for number, group in groups:
                    x, ids = _unit(group["v"].tolist()), group["id"].to_numpy()
                    asking = np.arange(len(names)) if number is None else np.array([i for i, lists in enumerate(wanted) if number in lists], dtype=int)
                    for at in range(0, len(asking), BLOCK):
                        some = asking[at : at + BLOCK]
                        distance = np.round(1 - matrix[some] @ x.T, 6)
                        best = [_nearest(d, ids, k) for d in distance]
                        if best:
                            yield pd.DataFrame({
                                "query_id": np.repeat(np.array([names[i] for i in some]), [len(b) for b in best]),
                                "id": ids[np.concatenate(best)], "distance": np.concatenate([d[b] for d, b in zip(distance, best, strict=True)]),
                            })

        met = fair.mapInPandas(search, schema).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
        if out is not None:
            met = cut_lineage(met)
        out = met if out is None else out.unionByName(met)
    return out


def fit_lists(corpus: DataFrame, lists: int = LISTS, sample: int = SAMPLE_ROWS, key: str = "vec_id", vector: str = "embedding", seed: int = 11) -> np.ndarray:
    """Centres of an inverted file by spherical k-means over at most `sample` rows, those of the least hash of their key.

    The sample fits the centres only; every row is indexed."""
    rows = corpus.filter(F.exists(vector, lambda e: e != 0)).select(F.col(vector).alias("v"), F.xxhash64(key).alias("h")).orderBy("h").limit(sample).select("v").toPandas()
    if rows.empty:
        raise ValueError("no vector to fit on")
    x = _unit(rows["v"].tolist())
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(ROUNDS):
        of = np.argmax(x @ centres.T, axis=1)
        for j in range(len(centres)):
            if (of == j).any():
                m = x[of == j].mean(axis=0)
                centres[j] = m / max(np.linalg.norm(m), 1e-12)
    return centres


def with_lists(df: DataFrame, centres: np.ndarray, vector: str, probes: int | None = None) -> DataFrame:
    """Adds `lists`: the nearest centre of each row, or for questions the array of the `probes` nearest; null for a null or zero vector."""

    def of(vectors: pd.Series) -> pd.Series:
        out: list = [None] * len(vectors)
        fair = [i for i, v in enumerate(vectors) if v is not None and np.any(v)]
        if fair:
            near = _unit([vectors.iloc[i] for i in fair]) @ centres.T
            for i, row in zip(fair, np.argsort(-near, axis=1, kind="stable"), strict=True):
                out[i] = int(row[0]) if probes is None else [int(j) for j in row[:probes]]
        return pd.Series(out, dtype=object)

    return df.withColumn("lists", F.pandas_udf(of, "int" if probes is None else "array<int>")(vector))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: questions, and the share of the exact rows that were found."""
    hit = found.select("query_id", "id", F.lit(1).alias("hit"))
    return exact.join(hit, ["query_id", "id"], "left").agg(F.count_distinct("query_id").alias("n_questions"), F.coalesce(F.avg(F.coalesce("hit", F.lit(0))), F.lit(1.0)).alias("recall"))


def upsert_vectors(stored: DataFrame, incoming: DataFrame, size: int, key: str = "id", vector: str = "embedding", order: str = "arrived") -> DataFrame:
    """Stored rows with incoming ones put in, the last writer of an id winning.

    A bad vector among the incoming ones raises before anything is written."""
    checked = incoming.withColumn("__bad", vector_problem(vector, size))
    checked = checked.withColumn(vector, F.when(F.col("__bad").isNull(), F.col(vector)).otherwise(F.raise_error(F.concat(F.lit("bad vector: "), F.col("__bad"))))).drop("__bad")
    both = stored.withColumn("__new", F.lit(0)).unionByName(checked.withColumn("__new", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.desc("__new"), F.desc(order))
    return both.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r", "__new")


def missing_ids(wanted: DataFrame, stored: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose id isn't stored yet: what an incremental index still has to embed."""
    return wanted.join(stored.select(key).distinct(), key, "left_anti")


def collection_name(strategy: str, size: int, model: str) -> str:
    """Identity of a collection: prefix, strategy, dimension and the model's digest, in lower case."""
    return f"nhnn-{strategy}-{size}-{hashlib.md5(model.encode()).hexdigest()[:8]}".lower()


MANIFEST = ("strategy", "embedding_model", "embedding_dim", "distance_metric", "schema_version")


def check_manifest(stored: dict, wanted: dict) -> None:
    """The five properties of a collection must agree."""
    for name in MANIFEST:
        if str(stored.get(name)) != str(wanted.get(name)):
            raise ValueError(f"the collection's {name} is {stored.get(name)!r}, not {wanted.get(name)!r}")


class Collection:
    """A vector store in a folder: the vectors, and a manifest written after them."""

    def __init__(self, spark: SparkSession, path: str, manifest: dict) -> None:
        self.spark, self.path, self.manifest = spark, path, manifest

    @classmethod
    def open(cls, spark: SparkSession, folder: str, strategy: str, model: str, size: int, reset: bool = False) -> Collection:
        """The collection of this identity, created empty where there is none or where `reset` asks for it.

        One whose manifest differs raises."""
        wanted = {"strategy": strategy, "embedding_model": model, "embedding_dim": size, "distance_metric": "cosine", "schema_version": "1.0"}
        found = cls(spark, f"{folder.rstrip('/')}/{collection_name(strategy, size, model)}", wanted)
        stored = None if reset else found._stored()
        if stored is None:
            found._write(spark.createDataFrame([], "id string, embedding array<float>, arrived timestamp"))
        else:
            check_manifest(stored, wanted)
        return found

    def _place(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _exists(self, name: str) -> bool:
        place = self._place(name)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place)

    def _stored(self) -> dict | None:
        if not self._exists("manifest/_SUCCESS"):
            return None
        return {r["name"]: r["value"] for r in self.spark.read.parquet(f"{self.path}/manifest").collect()}  # a row for each property

    def _write(self, vectors: DataFrame) -> None:
        """The other of two folders is written and the manifest then names it, so a failure leaves the old state."""
        stored = self._stored() or {}
        part = "b" if stored.get("part") == "a" else "a"
        vectors.write.mode("overwrite").parquet(f"{self.path}/{part}")
        rows = [(name, str(value)) for name, value in {**self.manifest, "part": part}.items()]
        self.spark.createDataFrame(rows, "name string, value string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest")

    def read(self) -> DataFrame:
        """id, embedding, arrived."""
        return self.spark.read.parquet(f"{self.path}/{self._stored()['part']}")

    def upsert(self, incoming: DataFrame) -> None:
        """`incoming` has id, embedding, arrived; bad vectors raise and nothing is written."""
        rows = incoming.select(F.col("id").cast("string").alias("id"), F.col("embedding").cast("array<float>").alias("embedding"), F.col("arrived").cast("timestamp").alias("arrived"))
        self._write(upsert_vectors(self.read(), rows, self.manifest["embedding_dim"]))

    def count(self) -> int:
        return self.read().count()
