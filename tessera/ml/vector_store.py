"""Vector tables: create, fill, commit, truncate, search; and question answering over chunks."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.prompts import split_text
from ..operators.retrieval import cosine_topk
from ..streaming.versioned import VersionedTable

SCHEMA = "id long, content string, vector array<double>"
BATCH = 1000


class VectorStore:
    """Tables of a cluster's databases under one folder; rows count once committed."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _table(self, database: str, table: str) -> VersionedTable:
        return VersionedTable(self.spark, f"{self.root}/{database}/{table}")

    def create(self, database: str, table: str) -> None:
        own = self._table(database, table)
        if own.exists():
            raise FileExistsError(f"{database}.{table}")
        own.write(self.spark.createDataFrame([], SCHEMA), "overwrite", "create")

    def add(self, database: str, table: str, rows: DataFrame) -> int:
        """Rows (id, content, vector); a write is a commit."""
        return self._table(database, table).write(rows.select(F.col("id").cast("long"), F.col("content").cast("string"), F.col("vector").cast("array<double>")), "append", "data")

    def truncate(self, database: str, table: str) -> None:
        self._table(database, table).truncate()

    def drop(self, database: str, table: str) -> None:
        self._table(database, table).remove()

    def read(self, database: str, table: str) -> DataFrame:
        return self._table(database, table).read()

    def search(self, database: str, table: str, queries: DataFrame, k: int = 10) -> DataFrame:
        """(query_id, vec_id, similarity, content) for queries(id, vector)."""
        rows = self.read(database, table)
        best = cosine_topk(queries.withColumn("id", -F.col("id") - 1), rows.select("id", "vector"), k, "id", "vector")
        return best.join(rows.select(F.col("id").alias("vec_id"), "content"), "vec_id").select((-F.col("query_id") - 1).alias("query_id"), "vec_id", "similarity", "content")


def build_qa(spark: SparkSession, docs: DataFrame, store: VectorStore, database: str, table: str, backend, limit: int = 800, separators: tuple[str, ...] = ("\n", ". ")) -> None:
    """Chunk, embed and store texts (doc_id, text); Arrow batches through the backend."""
    import hashlib

    import pyarrow as pa

    def chunks(batches):
        for batch in batches:
            ids, texts, vectors = [], [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                for k, part in enumerate(split_text(text or "", separators, limit)):
                    # Of any document and number of chunks; never negative, as search keeps those for queries.
                    ids.append(int.from_bytes(hashlib.blake2b(f"{doc}:{k}".encode(), digest_size=8).digest(), "big") >> 1)
                    texts.append(part)
                    vectors.append(backend.embed(part))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(vectors, pa.list_(pa.float64()))], ["id", "content", "vector"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null").mapInArrow(chunks, SCHEMA)
    if not store._table(database, table).exists():
        store.create(database, table)
    store.add(database, table, rows)


def answers(store: VectorStore, database: str, table: str, backend, questions: DataFrame, k: int = 4) -> DataFrame:
    """(id, answer): JSON answers to questions(id, question) from the chunks nearest to each.

    Questions are embedded and answered by Arrow batches on the executors; the
    search deals with them in blocks. Null questions are asked as empty ones,
    and a question like no chunk is answered without any.
    """
    import pyarrow as pa

    def embed(batches):
        for batch in batches:
            vectors = [backend.embed(q or "") for q in batch.column("question").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("question"), pa.array(vectors, pa.list_(pa.float64()))], ["id", "question", "vector"])

    def say(batches):
        for batch in batches:
            out = []
            for question, found in zip(batch.column("question").to_pylist(), batch.column("found").to_pylist()):
                context = "\n".join(r["content"] for r in found or [])
                said = backend.generate(f"{context}\n\n{question or ''}", {})
                out.append(json.dumps({"output": said, "sources": [r["vec_id"] for r in found or []]}, ensure_ascii=False))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.string())], ["id", "answer"])

    asked = questions.select(F.col("id").cast("long").alias("id"), F.col("question").cast("string").alias("question")).where("id is not null")
    embedded = asked.mapInArrow(embed, "id long, question string, vector array<double>")
    best = store.search(database, table, embedded.select("id", "vector"), k)
    item = F.struct((-F.col("similarity")).alias("far"), "vec_id", "content")
    found = best.groupBy(F.col("query_id").alias("id")).agg(F.array_sort(F.collect_list(item)).alias("found"))
    return asked.join(found, "id", "left").mapInArrow(say, "id long, answer string")


def answer(spark: SparkSession, store: VectorStore, database: str, table: str, backend, question: str, k: int = 4) -> str:
    """A JSON answer to one question."""
    return answers(store, database, table, backend, spark.createDataFrame([(0, question)], "id long, question string"), k).first()["answer"]


#: Bytes of texts and vectors that a deployed function may hold in every worker.
DEPLOYED_BYTES = 64 << 20


def deploy(spark: SparkSession, store: VectorStore, database: str, table: str, make, options: dict, name: str, k: int = 4) -> None:
    """A SQL function from a question to a JSON answer over a vector table.

    The table goes to all workers, so its size is checked first; a larger one
    is asked by ``answers``, which joins.
    """
    import numpy as np

    rows = store.read(database, table)
    size = rows.agg(F.sum(F.octet_length("content") + 8 * F.size("vector") + 8)).first()[0] or 0
    if size > DEPLOYED_BYTES:
        raise ValueError(f"{database}.{table} has {size} bytes, more than the {DEPLOYED_BYTES} that a function holds; ask it by run ... as LLMQADeploy")
    kept = sorted((r["id"], r["content"], r["vector"]) for r in rows.where("vector is not null").collect())
    shared = spark.sparkContext.broadcast(kept)

    @F.pandas_udf("string")
    def ask(questions: pd.Series) -> pd.Series:
        backend, own = make(options), shared.value
        matrix = np.array([v for _, _, v in own], dtype=float).reshape(len(own), -1)
        length = np.linalg.norm(matrix, axis=1)
        out = []
        for question in questions:
            question = question or ""
            vector = np.array(backend.embed(question), dtype=float)
            best = []
            if len(own) and np.linalg.norm(vector):
                value = matrix @ vector / np.where(length > 0, length, np.inf) / np.linalg.norm(vector)
                # By likeness, then by id, which is the order of the rows; rows without length are like nothing.
                best = [i for i in np.argsort(-value, kind="stable") if length[i] > 0][:k]
            context = "\n".join(own[i][1] for i in best)
            said = backend.generate(f"{context}\n\n{question}", {})
            out.append(json.dumps({"output": said, "sources": [own[i][0] for i in best]}, ensure_ascii=False))
        return pd.Series(out)

    spark.udf.register(name, ask)
