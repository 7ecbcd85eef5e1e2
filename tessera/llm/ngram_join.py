"""N-gram Jaccard join through a token-group matrix.

A document's set holds its distinct five-word shingles. Two documents link when
the Jaccard similarity of their sets is at least 0.8; the result gives each
document the class of documents it reaches by links.

How it runs
-----------
1. Every text becomes a set and a signature of the set; equal sets are one
   *representative* from here on, so copies cost one row each. Should two
   unlike sets share a 64-bit signature, which sizes and a second sum of 64
   bits tell, they get others.
2. Shingles are ordered by how often they repeat (counted on all documents),
   then by hash. Two linked sets share a shingle among the first
   ``n - ceil(0.8 n) + 1`` of each, so only these become postings.
   Documents that share such a shingle form a *cell*. Postings of a shingle
   that very many documents hold are dealt among buckets.
   Each set also has a parity sketch of 1/32 of its size at most: the bits in
   which two sketches differ bound the shingles in which the sets differ, so
   most pairs that cannot link go before any set is read.
3. Each set joins the group of one of its cells, the one of least hash, which
   near copies mostly share. Members of small groups whose sketches leave no
   partner in the group leave it; the sets of the others are made and written.
   The *token-group matrix* has one row a group: its first ``HUB`` members,
   compared among themselves, and the union of their shingles. Every further
   member is a query of its group: ``|query & union| >= 0.8 |query|`` is needed
   for any link, and only then the row is opened and its members compared. A
   second turn with other cells follows; the verified links give groups that
   hold near copies together, however many they are.
4. Those groups, in parts of bounded size, become matrix rows again. A document
   that shares a cell with another group is a query of it, bounded by the union
   of each part and compared with the members of the parts that pass. Cells of
   very many documents are compared in row and column blocks.
5. Links of 3 and 4 give the components.

No pair is lost: linked sets share a cell; either they are in one group
already or one of them is a query of the other's group. No pairs within a
group are listed.

Defined results: a null or empty text, or one without words, has no shingle and
its own doc_id as component. Repeated rows each give a row, in one component;
rows of one doc_id with unlike texts each have their own set, and a component
is named by the smallest id in it, so that they may be in different ones. A
null doc_id counts as no id: a component takes the smallest id it has. Very
long texts are taken whole, in blocks of their own. Ties of order are decided
by hash and change no result. Other columns are not read, so their names can't
clash. An empty table gives no row. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from . import textvec as tv
from .components import components
from .stash import Stash

SHINGLE = 5
#: Similarity needed, in percent.
PERCENT = 80
#: Shingles whose order is told apart by frequency: one of ``COMMON_EACH`` in all, between
#: these bounds; the rest count as rare. They are broadcast, 17 bytes each. No effect on results.
COMMON_EACH, COMMON_LEAST, COMMON_MOST = 4096, 1 << 18, 1 << 23
#: Documents from which a shingle's postings are dealt among buckets, all of them kept.
HOT = 2_000
#: Postings aimed at in one bucket, members of a hub, and members in one part of a group.
BUCKET, HUB, PART = 500_000, 32, 128
#: Members of a cell that are compared in one block.
CELL = 256
#: Shingles in which repeats are counted at once; it bounds memory and shapes the order alone.
RUN = 1_500_000
#: Documents at least in a task that counts, where partitions are smaller.
TASK = 3_000
#: Cells by which a set joins a group before groups of links are known; all else is decided with those.
TURNS = 2
#: Queries aimed at in one task for one part of a group; a part with more is copied and they are dealt.
QUERIES = 500
#: Parts with copies up to which their list is broadcast.
BROADCAST_PARTS = 100_000
#: Documents up to which the list of those to read again is broadcast, 8 bytes each.
BROADCAST_DOCS = 1_000_000

_U = np.uint64


def least_overlap(n: np.ndarray) -> np.ndarray:
    """ceil(0.8 n): shingles that a set of n must share with any linked set."""
    return -(-n * PERCENT // 100)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets link."""
    small, large = min(len(a), len(b)), max(len(a), len(b))
    if small == 0 or 100 * small < PERCENT * large:
        return False
    both = shared(a, b)
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def _sets(texts, alike: frozenset[int] = frozenset()) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, shingles, offsets, signature by row, second sum by row)."""
    for first, data, offsets in tv.blocks(texts):
        words = tv.Words(data, offsets, fold=tv.FOLD)
        h, at = tv.shingle_sets(words, SHINGLE)
        s1 = tv.mix(tv.row_sums(tv.mix(h ^ _U(0x5851F42D4C957F2D)), at))
        s2 = tv.mix(tv.row_sums(tv.mix(h + _U(0x14057B7EF767814F)), at) + np.diff(at).astype(np.uint64))
        if alike:
            again = np.isin(s1.view(np.int64), np.array(sorted(alike), np.int64))
            s1 = np.where(again, tv.mix(s1 ^ s2), s1)
        yield first, h, at, s1, s2


def sketches(h: np.ndarray, at: np.ndarray) -> list[bytes]:
    """Parity sketch of each row's set: 2**k bits, at least 64 and no fewer than the set has shingles."""
    n = np.diff(at)
    bits = np.left_shift(1, np.ceil(np.log2(np.maximum(n, 64))).astype(np.int64))
    base = np.cumsum(bits) - bits
    slot = np.repeat(base, n) + (tv.mix(h + _U(5)) & np.repeat(bits - 1, n).astype(np.uint64)).astype(np.int64)
    packed = np.packbits(np.bincount(slot, minlength=int(bits.sum())).astype(np.uint8) & 1, bitorder="little").tobytes()
    return [packed[lo // 8 : (lo + k) // 8] for lo, k in zip(base.tolist(), bits.tolist())]


def sketches_allow(n1: int, a: bytes, n2: int, b: bytes) -> bool:
    """Whether two sets of these sizes and sketches could link; true for all that do."""
    if len(a) < len(b):
        a, b = b, a
    size, x = len(a) * 8, int.from_bytes(a, "little")
    while size > len(b) * 8:
        size //= 2
        x = (x >> size) ^ (x & ((1 << size) - 1))
    differ = (x ^ int.from_bytes(b, "little")).bit_count()
    # At most (n1 + n2 - differ) / 2 shingles are shared; 80 / 180 of n1 + n2 are needed.
    return (100 + PERCENT) * (n1 + n2 - differ) >= 2 * PERCENT * (n1 + n2)


def _profile(batches):
    """Rows (doc_id, n, s1, s2, sketch) of documents, and (n, s1) as count and shingle of what repeats in a run of them."""
    names = ["doc_id", "key", "n", "s1", "s2", "sketch", "common"]
    pending: list[np.ndarray] = []
    held = 0

    def repeated():
        h, n = np.unique(np.concatenate(pending), return_counts=True)
        h, n = h[n > 1], n[n > 1]
        return pa.RecordBatch.from_arrays(
            [pa.nulls(len(h), pa.int64()), pa.nulls(len(h), pa.int64()), pa.array(n.astype(np.int64)), pa.array(h.view(np.int64)), pa.nulls(len(h), pa.int64()), pa.nulls(len(h), pa.binary()), pa.array(np.ones(len(h), bool))], names
        )

    for batch in batches:
        for first, h, at, s1, s2 in _sets(batch.column("text")):
            n = np.diff(at)
            pending.append(h)
            held += len(h)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).slice(first, len(n)) for c in ("doc_id", "key")), pa.array(n), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.array(sketches(h, at), pa.binary()), pa.array(np.zeros(len(n), bool))], names
            )
        if held > RUN:
            yield repeated()
            pending, held = [], 0
    if pending:
        yield repeated()


def _mixed(batches):
    """Rows of sets that share a signature with unlike sets, with another one."""
    for batch in batches:
        s1, s2 = (batch.column(c).to_numpy().view(np.uint64) for c in ("s1", "s2"))
        own = pa.array(tv.mix(s1 ^ s2).view(np.int64))
        yield batch.set_column(batch.schema.get_field_index("s1"), "s1", own).select(["doc_id", "key", "n", "s1", "s2", "sketch"])


def _postings(common, buckets: int):
    """Postings of the sets that are new in this task, one packed row for a bucket and block."""

    def run(batches):
        tokens, ranks, hot, alike = common.value
        seen: set[int] = set()
        for batch in batches:
            for _, h, at, s1, _ in _sets(batch.column("text"), alike):
                n = np.diff(at)
                fresh = np.zeros(len(n), bool)
                for r in np.flatnonzero(n):
                    if (key := int(s1[r])) not in seen:
                        seen.add(key)
                        fresh[r] = True
                rows = np.repeat(np.arange(len(n)), n)
                order, dealt = h >> _U(1), np.zeros(len(h), bool)
                if len(tokens):
                    near = np.searchsorted(tokens, h)
                    near[near == len(tokens)] = 0
                    hit = tokens[near] == h
                    order[hit] = (_U(1) << _U(63)) + ranks[near[hit]]
                    dealt[hit] = hot[near[hit]]
                use = fresh[rows]
                rows, h, order, dealt = rows[use], h[use], order[use], dealt[use]
                by = np.lexsort((order, rows))
                rows, h, dealt = rows[by], h[by], dealt[by]
                place = np.arange(len(rows)) - np.searchsorted(rows, rows)
                use = place <= (n - least_overlap(n))[rows]
                rows, h, place, dealt = rows[use], h[use], place[use], dealt[use]
                bucket = (tv.mix(np.where(dealt, h ^ tv.mix(s1[rows]), h)) % _U(buckets)).astype(np.int64)
                place = np.where(dealt, -1, place)
                by = np.argsort(bucket, kind="stable")
                rows, h, place, bucket = rows[by], h[by], place[by], bucket[by]
                cut = np.flatnonzero(np.diff(bucket, prepend=-1))
                blobs = []
                for lo, hi in zip(cut, [*cut[1:], len(bucket)]):
                    own, local = np.unique(rows[lo:hi], return_inverse=True)
                    blobs.append(b"".join(x.tobytes() for x in (
                        np.array([len(own), hi - lo], np.int64), s1[own], n[own], h[lo:hi], local.astype(np.uint32), place[lo:hi].astype(np.int32))))
                yield pa.RecordBatch.from_arrays([pa.array(bucket[cut].astype(np.int64)), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    return run


def _unpack(blob: bytes) -> list[np.ndarray]:
    """Shingle, signature, set size and place in the set's order (-1 where dealt) of each posting in one packed row."""
    own, k = np.frombuffer(blob, np.int64, 2).tolist()
    at, out = 16, []
    for kind, size in ((np.uint64, own), (np.int64, own), (np.uint64, k), (np.uint32, k), (np.int32, k)):
        out.append(np.frombuffer(blob, kind, size, at))
        at += size * np.dtype(kind).itemsize
    sig, n, h, local, place = out
    return [h, sig[local], n[local], place.astype(np.int64)]


def _could_link(n1, rest1, n2, rest2):
    """Whether sizes, and what follows the shared shingle in the order, leave room for a link."""
    return (100 * np.minimum(n1, n2) >= PERCENT * np.maximum(n1, n2)) & ((100 + PERCENT) * np.minimum(rest1, rest2) >= PERCENT * (n1 + n2))


def _partnered(first: np.ndarray, size: np.ndarray, n: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Members that could link with some other member of their cell, by sizes and places.

    Only the first shingle that two sets share is met with the true number of
    shingles before it; at a later one the bound is looser than it says, but
    then the first one keeps both members.
    """
    use = np.zeros(len(n), bool)
    two = first[size == 2]
    use[two] = use[two + 1] = _could_link(n[two], rest[two], n[two + 1], rest[two + 1])
    for lo, k in zip(first[size > 2], size[size > 2]):
        hi = lo + k
        for at in range(lo, hi, 512):  # rows of the comparison held at once
            end = min(at + 512, hi)
            fits = _could_link(n[at:end, None], rest[at:end, None], n[None, lo:hi], rest[None, lo:hi])
            fits[np.arange(end - at), np.arange(at - lo, end - lo)] = False
            use[at:end] = fits.any(1)
    return use


def _cells(table: pa.Table) -> pa.Table:
    """(cell, sig): members of the cells of one bucket that could link with another one."""
    h, s, n, place = (np.concatenate(x) for x in zip(*map(_unpack, table.column("blob").to_pylist())))
    order = np.lexsort((s, h))
    h, s, n, rest, dealt = h[order], s[order], n[order], (n - place)[order], place[order] < 0
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (s[1:] != s[:-1])
    h, s, n, rest, dealt = h[new], s[new], n[new], rest[new], dealt[new]
    _, first, size = np.unique(h, return_index=True, return_counts=True)
    # Of a dealt shingle only some members are here: all of them stay.
    whole = ~dealt[first]
    use = _partnered(first[whole], size[whole], n, rest) | dealt
    return pa.table({"cell": h[use].view(np.int64), "sig": s[use].view(np.int64)})


def _pack_sets(alike: frozenset[int]):
    """(sig, tokens): the sets of documents, as bytes, each once in a task."""

    def run(batches):
        for batch in batches:
            for _, h, at, s1, _ in _sets(batch.column("text"), alike):
                blobs = [h[lo:hi].tobytes() for lo, hi in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(s1.view(np.int64)), pa.array(blobs, pa.binary())], ["sig", "tokens"])

    return run


def _hub_links(sets: list[np.ndarray]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Component of each of a few sets, and the links that make them; a pair already connected isn't compared."""
    label, links = np.arange(len(sets)), []
    for k in range(1, len(sets)):
        for j in range(k):
            if label[j] != label[k] and linked(sets[k], sets[j]):
                links.append((k, j))
                label[label == label[k]] = label[j]
    return label, links


def _matrix_row(compare: bool):
    """(g, union, sizes, labels, sigs, tokens, a, b) of a group's members: a row of the matrix.

    ``a`` and ``b`` are the links found among the members, which are compared
    only if they are not of one component already.
    """

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        own = dict(zip(table.column("sig").to_pylist(), table.column("tokens").to_pylist()))
        sigs = sorted(own)
        sets = [np.frombuffer(own[s], np.uint64) for s in sigs]
        label, links = _hub_links(sets) if compare else (np.zeros(len(sets), np.int64), [])
        alone = compare and table.column("queries")[0].as_py() == 0  # no query will ask
        union = [] if alone else np.unique(np.concatenate(sets))
        pack = lambda x, kind: pa.array([np.asarray(x, kind).tobytes()], pa.binary())
        return pa.table({
            "g": pa.array([key[0].as_py()], pa.int64()), "union": pack(union, np.uint64), "sizes": pack([] if alone else [len(t) for t in sets], np.int64), "labels": pack(label, np.int64),
            "sigs": pack(sigs, np.int64), "tokens": pa.array([b"" if alone else b"".join(own[s] for s in sigs)], pa.binary()),
            "a": pa.array([[sigs[k] for k, _ in links]], pa.list_(pa.int64())), "b": pa.array([[sigs[j] for _, j in links]], pa.list_(pa.int64())),
        })

    return run


_ROW = "g long, union binary, sizes binary, labels binary, sigs binary, tokens binary, a array<long>, b array<long>"


def _open_rows(batches):
    """Links (a, b) of queries with members of the matrix rows that the bound leaves.

    Rows come sorted by group, the matrix row first. Held at once: one matrix
    row. A query needs one link with each component of the members.
    """
    union, members = np.zeros(0, np.uint64), []
    for batch in batches:
        a, b = [], []
        for asks, sig, blob, own in zip(batch.column("query").to_pylist(), batch.column("sig").to_pylist(), batch.column("tokens"), batch.column("row")):
            tokens = np.frombuffer(blob.as_buffer(), np.uint64)
            if not asks:
                row = own.as_py()
                union = np.frombuffer(row["union"], np.uint64)
                ends = np.cumsum(np.frombuffer(row["sizes"], np.int64))
                label, sigs = np.frombuffer(row["labels"], np.int64), np.frombuffer(row["sigs"], np.int64)
                members = [(int(label[k]), int(sigs[k]), tokens[(ends[k - 1] if k else 0) : ends[k]]) for k in range(len(ends))]
                continue
            if 100 * shared(tokens, union) < PERCENT * len(tokens):
                continue
            done: set[int] = set()
            for label_of, other, own_tokens in members:
                if label_of not in done and other != sig and linked(tokens, own_tokens):
                    a.append(sig)
                    b.append(other)
                    done.add(label_of)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _cell_queries(batches):
    """(sig, g): members of a cell as queries of the other groups that are in it.

    Of two groups the smaller one asks. A query goes on if some member of the
    other group, in this block of the cell, leaves room for a link by sketches;
    pairs that do not are never rows. Rows come sorted by block.
    """
    held: list[tuple] = []

    def asked():
        ordered = sorted(held, key=lambda r: (r[3], r[2], r[1]))
        out = set()
        for k, (_, sig, g, _, n, mark) in enumerate(ordered):
            for _, _, other, _, m, own in reversed(ordered[k + 1 :]):
                if other == g:
                    break
                if (sig, other) not in out and 100 * min(n, m) >= PERCENT * max(n, m) and sketches_allow(n, mark, m, own):
                    out.add((sig, other))
        return out

    def rows(found):
        return pa.RecordBatch.from_arrays([pa.array([q for q, _ in found], pa.int64()), pa.array([g for _, g in found], pa.int64())], ["sig", "g"])

    for batch in batches:
        found = []
        for row in zip(*(batch.column(c).to_pylist() for c in ("block", "sig", "g", "members", "n", "sketch"))):
            if held and held[0][0] != row[0]:
                found += asked()
                held = []
            held.append(row)
        yield rows(found)
    if held:
        yield rows(list(asked()))


def _checked(frame: DataFrame, bound: int) -> DataFrame:
    """The frame, to be broadcast if it has no more rows than the bound."""
    return F.broadcast(frame) if frame.limit(bound + 1).count() <= bound else frame


def _blocks(seen: DataFrame) -> DataFrame:
    """seen(cell, sig, ...) with ``block``: a cell of more than ``CELL`` members in row and column blocks."""
    large = seen.groupBy("cell").agg(F.ceil(F.count("*") / CELL).cast("int").alias("sides")).where("sides > 1")
    sides = F.coalesce("sides", F.lit(1))
    own = F.pmod(F.xxhash64("sig"), sides).cast("int")
    dealt = seen.join(_checked(large, BROADCAST_PARTS), "cell", "left").withColumn("own", own).withColumn("side", F.explode(F.sequence(F.lit(0), sides - 1)))
    return dealt.withColumn("block", F.xxhash64("cell", F.least("own", "side"), F.greatest("own", "side"))).drop("own", "side", "sides")


def _ask(matrix: DataFrame, queries: DataFrame, sets: DataFrame, parts: int) -> DataFrame:
    """Verified links of queries(g, sig) with the members of matrix rows.

    A row that very many queries ask for has a copy for each ``QUERIES`` of them.
    """
    copies = queries.groupBy("g").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("copies")).where("copies > 1")
    copies = _checked(copies, BROADCAST_PARTS)
    n = F.coalesce("copies", F.lit(1))
    one = sets.join(_checked(queries, BROADCAST_DOCS), "sig").join(copies, "g", "left").select(
        F.xxhash64("g", F.pmod(F.xxhash64("sig"), n).cast("int")).alias("g"), "sig", F.lit(True).alias("query"), "tokens")
    row = F.struct("union", "sizes", "labels", "sigs").alias("row")
    every = matrix.join(copies, "g", "left").withColumn("copy", F.explode(F.sequence(F.lit(0), n - 1))).select(
        F.xxhash64("g", "copy").alias("g"), F.lit(False).alias("query"), "tokens", row)
    return every.unionByName(one, allowMissingColumns=True).repartition(parts, "g").sortWithinPartitions("g", "query").mapInArrow(_open_rows, "a long, b long")


def _possible(batches):
    """(g, sig, all): members of small groups with a partner by sketches. Rows come sorted by group."""
    held: list[tuple] = []

    def kept():
        use = set()
        for k, (_, _, _, n, mark) in enumerate(held):
            for j in range(k):
                m, own = held[j][3:]
                if (k not in use or j not in use) and 100 * min(n, m) >= PERCENT * max(n, m) and sketches_allow(n, mark, m, own):
                    use |= {k, j}
        return [held[k][:3] for k in sorted(use)]

    def rows(found):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], pa.int64()) for k in range(3)], ["g", "sig", "all"])

    for batch in batches:
        found = []
        for row in zip(*(batch.column(c).to_pylist() for c in ("g", "sig", "all", "n", "sketch"))):
            if held and held[0][0] != row[0]:
                found += kept()
                held = []
            held.append(row)
        yield rows(found)
    if held:
        yield rows(kept())


def _turn(cells: DataFrame, groups: DataFrame | None, marks: DataFrame, made, stash: Stash, turn: int, parts: int) -> DataFrame:
    """Links that the groups of one cell of each set give; see 3 of the module."""
    if groups is None:
        live = cells
    else:  # cells of sets that links do not connect yet
        now = cells.join(groups.withColumnRenamed("node", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
        live = now.join(now.groupBy("cell").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("cell"), "cell").select("cell", "sig")
    chosen = stash.keep(live.groupBy("sig").agg(F.min_by("cell", F.xxhash64("cell", F.lit(turn))).alias("g")), f"chosen-{turn}")
    sized = chosen.join(chosen.groupBy("g").agg(F.count("*").alias("all")).where("all > 1"), "g").select("g", "sig", "all")
    small = sized.where(F.col("all") <= HUB).join(marks.select("sig", "n", "sketch"), "sig").select("g", "sig", "all", "n", "sketch")
    small = small.repartition(parts, "g").sortWithinPartitions("g").mapInArrow(_possible, "g long, sig long, all long")
    alive = stash.keep(small.unionByName(sized.where(F.col("all") > HUB)), f"alive-{turn}")
    sets = made(alive.select("sig").distinct(), f"sets-{turn}")
    place = F.row_number().over(W.partitionBy("g").orderBy(F.xxhash64("sig", F.lit(turn)), "sig"))
    hubs = alive.withColumn("place", place).where(F.col("place") <= HUB).withColumn("queries", F.greatest(F.col("all") - HUB, F.lit(0)))
    hubs = stash.keep(hubs.select("g", "sig", "queries"), f"hubs-{turn}")
    matrix = stash.keep(sets.join(_checked(hubs, BROADCAST_DOCS), "sig").groupBy("g").applyInArrow(_matrix_row(True), _ROW), f"matrix-{turn}")
    within = matrix.select(F.explode(F.arrays_zip("a", "b")).alias("l")).select("l.a", "l.b")
    queries = alive.where(F.col("all") > HUB).select("g", "sig").join(hubs.select("g", "sig"), ["g", "sig"], "left_anti")
    return stash.keep(within.unionByName(_ask(matrix.where(F.length("tokens") > 0), queries, sets, parts)), f"links-{turn}")


def shingle_classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keyed: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``; see the module.

    ``keyed`` adds ``key``, a hash of the row's text, and ``root``, the same for
    the rows of one component and no others (null without shingles).
    """
    spark = docs.sparkSession
    stash = Stash(spark, "ngram")
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("key", F.xxhash64("text"))

    # Shingles that repeat are found among the documents of a task, so no task has only a few.
    tasks = max(1, plain.count() // TASK)
    profile = stash.keep(plain.coalesce(tasks).mapInArrow(_profile, "doc_id long, key long, n long, s1 long, s2 long, sketch binary, common boolean"), "profile")
    found = profile.where("not common").select("doc_id", "key", "n", "s1", "s2", "sketch")
    # Unlike sets of one signature, if there are any, have another one from here on.
    same = found.where("n > 0").groupBy("s1").agg(F.min("n").alias("n1"), F.max("n").alias("n2"), F.min("s2").alias("m1"), F.max("s2").alias("m2"))
    alike = frozenset(r["s1"] for r in same.where("n1 <> n2 or m1 <> m2").select("s1").collect())
    if alike:
        again = spark.createDataFrame([(x,) for x in sorted(alike)], "s1 long")
        mixed = found.join(F.broadcast(again), "s1").mapInArrow(_mixed, "doc_id long, key long, n long, s1 long, s2 long, sketch binary")
        found = stash.keep(found.join(F.broadcast(again), "s1", "left_anti").select("doc_id", "key", "n", "s1", "s2", "sketch").unionByName(mixed), "found")
    rows = found.select("doc_id", "key", "n", "s1")
    shingles, total = rows.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("n") / 5 + 1), F.lit(0.0))).first()
    common = (
        profile.where("common").groupBy("s1").agg(F.sum("n").alias("n")).where("n > 2")
        .orderBy(F.desc("n"), "s1").limit(min(max(COMMON_LEAST, shingles // COMMON_EACH), COMMON_MOST)).toPandas()
    )
    tokens = common["s1"].to_numpy(np.int64).view(np.uint64)
    by = np.argsort(tokens)
    ranks = (len(tokens) - np.arange(len(tokens), dtype=np.uint64))[by]
    shipped = spark.sparkContext.broadcast((tokens[by], ranks, (common["n"].to_numpy() >= HOT)[by], alike))

    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(width, math.ceil(total / BUCKET))
    cells = stash.keep(
        plain.select("text").mapInArrow(_postings(shipped, buckets), "bucket long, blob binary")
        .groupBy("bucket").applyInArrow(_cells, "cell long, sig long"),
        "cells",
    )

    # One document stands for each set that meets others.
    met = cells.select("sig").distinct()
    by_sig = found.where("n > 0").groupBy(F.col("s1").alias("sig"))
    marks = stash.keep(by_sig.agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sketch").alias("sketch")).join(met, "sig"), "marks")

    def made(sigs: DataFrame, name: str) -> DataFrame:
        """(sig, tokens): sets by signature, each made from a document that has it; repeated rows may repeat a set."""
        sigs = _checked(sigs.join(marks.select("sig", "doc_id"), "sig"), BROADCAST_DOCS)
        again = plain.join(sigs.select("doc_id").where("doc_id is not null").distinct(), "doc_id", "left_semi").unionByName(plain.where("doc_id is null").select(plain.columns))
        packed = again.select("text").mapInArrow(_pack_sets(alike), "sig long, tokens binary")
        return stash.keep(packed.join(sigs, "sig", "left_semi"), name)

    links, groups = None, None
    for turn in range(TURNS):
        found_links = _turn(cells, groups, marks, made, stash, turn, width)
        links = found_links if links is None else links.unionByName(found_links)
        groups = stash.keep(components(links, stash, f"group-{turn}"), f"groups-{turn}")

    in_group = groups.withColumnRenamed("node", "sig")
    of_group = stash.keep(marks.join(in_group, "sig", "left").select("sig", "n", "sketch", F.coalesce("root", "sig").alias("g")), "of_group")
    sizes = of_group.groupBy("g").agg(F.count("*").alias("members"))
    grouped = cells.join(of_group.select("sig", "g"), "sig")
    mixed_cells = grouped.groupBy("cell").agg(F.min("g").alias("low"), F.max("g").alias("high")).where("low <> high").select("cell")
    seen = grouped.join(mixed_cells, "cell").join(sizes, "g").join(of_group.select("sig", "n", "sketch"), "sig").select("cell", "sig", "g", "members", "n", "sketch")
    meets = _blocks(seen).repartition(width, "block").sortWithinPartitions("block").mapInArrow(_cell_queries, "sig long, g long").distinct()
    left = stash.keep(meets.join(sizes, "g"), "left")
    parts = F.ceil(F.col("members") / PART).cast("int")
    part = F.xxhash64("g", "part").alias("g")
    queries = left.select("sig", "g", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part")).select(part, "sig")
    members = of_group.join(left.select("g", "members").distinct(), "g").select("sig", "g", F.pmod(F.xxhash64("sig"), parts).cast("int").alias("part")).select(part, "sig")
    sets = made(members.select("sig").unionByName(left.select("sig")).distinct(), "sets")
    matrix = stash.keep(sets.join(_checked(members, BROADCAST_DOCS), "sig").groupBy("g").applyInArrow(_matrix_row(False), _ROW), "matrix")
    second = stash.keep(_ask(matrix, queries, sets, width), "second")
    known = groups.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(second)
    final = stash.keep(components(known, stash, "class"), "final")
    stash.drop("cells", "marks", "sets", "of_group", "left", "matrix", *(f"{name}-{k}" for name in ("chosen", "alive", "sets", "hubs", "matrix", "groups", "links") for k in range(TURNS)))

    by_set = rows.where("n > 0").groupBy(F.col("s1").alias("node")).agg(F.min("doc_id").alias("least"))
    reached = final.join(by_set, "node")
    of_class = reached.groupBy("root").agg(F.min("least").alias("component_id"))
    of_set = by_set.join(final, "node", "left").join(of_class, "root", "left").select(
        F.col("node").alias("s1"), F.coalesce("component_id", "least").alias("component_id"), F.coalesce("root", "node").alias("root"))
    named = rows.withColumn("s1", F.when(F.col("n") > 0, F.col("s1"))).join(of_set, "s1", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    return named.select("doc_id", F.col("n").alias("n_shingles"), component, *(["key", "root"] if keyed else []))
