"""Line dedup by a sharded minimal perfect hash over distinct line hashes.

A line's key is the line without white space at its ends and with A-Z in lower
case. Keys of at least ``min_chars`` code points that at least ``min_docs``
documents hold lose their lines everywhere but in the document of the largest
doc_id that holds them.

How it runs
-----------
1. Each long line of a document becomes a 128-bit hash with its place.
2. Hashes are counted with partial sums: documents that hold the line, largest
   doc_id, occurrences.
3. The distinct hashes are dealt to shards by hash. A shard is one row: the
   levels of a minimal perfect hash (bit vectors of about 3 bits a key in all),
   and arrays in its order: 32-bit fingerprints, counts and largest doc_ids.
4. Documents' hashes go to the shards and probe the arrays, streaming. A shard
   that more probes ask for than four times the mean is copied, and its probes
   are dealt among the copies. By their definition such shards are fewer than
   a quarter of all, and this list alone is broadcast.
5. Places to drop return to their documents.

Defined results: a null or empty text is one empty line, which stays. Each row
counts as a document; rows of the same doc_id that hold a line in the largest
doc_id all keep it (ties). A null doc_id counts as smaller than any other. A
document that loses all lines has the empty text. Very long texts are split
whole, and a line of any length is one hash. An empty table gives no row. Other
columns keep their names and values: columns of this module have names that no
column of the table has, but for the result ``__lines``, which a caller may name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from .stash import Stash, free_name
from .textvec import mix

MIN_CHARS, MIN_DOCS = 40, 5
#: Distinct lines aimed at in one shard.
SHARD = 100_000
#: Bits for each key still to be placed, by level.
SPARE = 1.5

_U = np.uint64
_STRIP = b" \t\n\x0b\x0c\r"
_NO_ID = -(1 << 63)


def line_key(line: bytes) -> bytes:
    """What makes two lines the same, in UTF-8."""
    return line.strip(_STRIP).lower()


def _hash_lines(min_chars: int):
    def run(batches):
        for batch in batches:
            h1, h2, doc, row, place, first = [], [], [], [], [], []
            for doc_id, key, text in zip(batch.column("doc_id").to_pylist(), batch.column("row").to_pylist(), batch.column("text")):
                seen = set()
                for at, line in enumerate(text.as_buffer().to_pybytes().split(b"\n")):
                    if len(line) < min_chars:
                        continue
                    line = line_key(line)
                    if len(line) < min_chars or len(line) < 4 * min_chars and len(line.decode()) < min_chars:
                        continue
                    digest = xxhash.xxh3_128_intdigest(line)
                    first.append(digest not in seen)
                    seen.add(digest)
                    h1.append(digest >> 64)
                    h2.append(digest & 0xFFFFFFFFFFFFFFFF)
                    doc.append(doc_id)
                    row.append(key)
                    place.append(at)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(h1, np.uint64).view(np.int64)), pa.array(np.array(h2, np.uint64).view(np.int64)), pa.array(doc, pa.int64()), pa.array(row, pa.int64()), pa.array(place, pa.int32()), pa.array(first, pa.bool_())],
                ["h1", "h2", "doc_id", "row", "place", "first"],
            )

    return run


class PerfectHash:
    """Minimal perfect hash of 128-bit keys: bit vectors by level, ranks give the order."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.rank = np.cumsum(bits, dtype=np.int64) - 1

    @staticmethod
    def _slot(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(h1 ^ mix(h2 + _U(level))) % _U(size)).astype(np.int64)

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray) -> PerfectHash:
        """Of distinct keys. A key that shares its bit with another one goes to the next level."""
        sizes, parts = [], []
        while len(h1):
            size = int(SPARE * len(h1)) + 1
            slot = cls._slot(h1, h2, len(sizes), size)
            alone = np.bincount(slot, minlength=size) == 1
            sizes.append(size)
            parts.append(alone)
            left = ~alone[slot]
            h1, h2 = h1[left], h2[left]
        return cls(sizes, np.concatenate(parts) if parts else np.zeros(0, bool))

    def __call__(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Place of each key; for others any place, or -1."""
        out = np.full(len(h1), -1, np.int64)
        left, start = np.arange(len(h1)), 0
        for level, size in enumerate(self.sizes):
            slot = start + self._slot(h1[left], h2[left], level, size)
            hit = self.bits[slot]
            out[left[hit]] = self.rank[slot[hit]]
            left, start = left[~hit], start + size
        return out

    def to_bytes(self) -> bytes:
        return np.array([len(self.sizes), *self.sizes], np.int64).tobytes() + np.packbits(self.bits).tobytes()

    @classmethod
    def from_bytes(cls, blob: bytes) -> PerfectHash:
        n = int(np.frombuffer(blob, np.int64, 1)[0])
        sizes = np.frombuffer(blob, np.int64, n, 8).tolist()
        return cls(sizes, np.unpackbits(np.frombuffer(blob, np.uint8, offset=8 + 8 * n), count=sum(sizes)).astype(bool))


def _fingerprint(h2: np.ndarray) -> np.ndarray:
    return (h2 >> _U(32)).astype(np.uint32)


def _build_shard(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    h1, h2 = (table.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
    perfect = PerfectHash.build(h1, h2)
    at = perfect(h1, h2)
    arrays = []
    for kind, values in ((np.uint32, _fingerprint(h2)), (np.uint32, np.minimum(table.column("docs").to_numpy(), 0xFFFFFFFF)), (np.int64, table.column("last").to_numpy())):
        own = np.zeros(len(at), kind)
        own[at] = values
        arrays.append(own.tobytes())
    probes = int(table.column("lines").to_numpy().sum())
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "keys": [len(at)], "probes": [probes], "hash": pa.array([perfect.to_bytes()], pa.binary()), "arrays": pa.array([b"".join(arrays)], pa.binary())})


def _probe(min_docs: int):
    """Places to drop, from rows sorted by shard copy with the shard's arrays first."""

    def run(batches):
        state = None
        for batch in batches:
            blob = batch.column("hash")
            heads = np.flatnonzero(blob.is_valid().to_numpy(zero_copy_only=False)).tolist()
            h1, h2, doc = (pc.fill_null(batch.column(c), 0).to_numpy() for c in ("h1", "h2", "doc_id"))
            h1, h2 = h1.view(np.uint64), h2.view(np.uint64)
            drop = np.zeros(len(batch), bool)
            for lo, hi in zip([0, *heads], [*heads, len(batch)]):
                if lo in heads[:1] or (heads and lo in heads):
                    n = batch.column("keys")[lo].as_py()
                    data = batch.column("arrays")[lo].as_py()
                    state = (PerfectHash.from_bytes(blob[lo].as_py()), np.frombuffer(data, np.uint32, n), np.frombuffer(data, np.uint32, n, 4 * n), np.frombuffer(data, np.int64, n, 8 * n))
                    lo += 1
                if lo < hi:
                    perfect, fingers, docs, last = state
                    at = perfect(h1[lo:hi], h2[lo:hi])
                    known = (at >= 0) & (fingers[at] == _fingerprint(h2[lo:hi]))
                    drop[lo:hi] = known & (docs[at] >= min_docs) & (last[at] != doc[lo:hi])
            yield batch.select(["doc_id", "row", "place"]).filter(pa.array(drop))

    return run


def drop_places(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, row, place) of each line to drop; docs has (doc_id, row, text) without nulls."""
    spark = docs.sparkSession
    stash = Stash(spark, "lines")
    lines = stash.keep(
        docs.mapInArrow(_hash_lines(min_chars), "h1 long, h2 long, doc_id long, row long, place int, first boolean"), "lines"
    )
    shards = max(1, lines.count() // SHARD)
    shard = F.pmod(F.col("h1"), F.lit(shards)).alias("shard")
    counted = lines.groupBy("h1", "h2").agg(F.sum(F.col("first").cast("long")).alias("docs"), F.max("doc_id").alias("last"), F.count("*").alias("lines"))
    index = stash.keep(
        counted.select(shard, "h1", "h2", "docs", "last", "lines").groupBy("shard")
        .applyInArrow(_build_shard, "shard long, keys long, probes long, hash binary, arrays binary"),
        "index",
    )
    mean = index.agg(F.avg("probes")).first()[0] or 1.0
    hot = F.broadcast(index.where(F.col("probes") > 4 * mean).select("shard", F.ceil(F.col("probes") / mean).cast("int").alias("copies")))
    copies = F.coalesce("copies", F.lit(1))
    asked = lines.select(shard, "h1", "h2", "doc_id", "row", "place").join(hot, "shard", "left").withColumn("copy", F.pmod(F.xxhash64("row"), copies).cast("int")).drop("copies")
    held = index.join(hot, "shard", "left").select("shard", "keys", "hash", "arrays", F.explode(F.sequence(F.lit(0), copies - 1)).alias("copy"))
    both = held.unionByName(asked, allowMissingColumns=True)
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    return (
        both.repartition(width, "shard", "copy").sortWithinPartitions("shard", "copy", F.col("hash").isNull())
        .mapInArrow(_probe(min_docs), "doc_id long, row long, place int")
    )


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, counts: str = "__lines") -> DataFrame:
    """All columns of ``docs`` with the kept text, and a struct ``counts`` of (n_lines, n_dropped)."""
    own = F.coalesce(F.col(text).cast("string"), F.lit(""))
    number = F.coalesce(F.col(doc_id).cast("long"), F.lit(_NO_ID))
    doc, row, drop, every = (free_name(docs, x) for x in ("doc", "row", "drop", "all"))
    plain = docs.select(number.alias("doc_id"), F.xxhash64(number, own).alias("row"), own.alias("text"))
    places = (
        drop_places(plain, min_chars, min_docs).groupBy("doc_id", "row").agg(F.collect_set("place").alias(drop))
        .select(F.col("doc_id").alias(doc), F.col("row").alias(row), drop)
    )
    rows = docs.withColumns({doc: number, row: F.xxhash64(number, own)})
    lines = F.split(own, "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), drop)
    kept = F.when(F.col(drop).isNull(), own).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col(every), i)), "\n"))
    joined = rows.join(places, [doc, row], "left").withColumn(every, F.when(F.col(drop).isNotNull(), lines))
    counted = F.struct(F.size(lines).cast("long").alias("n_lines"), F.when(F.col(drop).isNull(), 0).otherwise(F.size(drop)).cast("long").alias("n_dropped"))
    return joined.withColumns({counts: counted, text: kept}).drop(doc, row, drop, every)
