"""N-gram Jaccard join: MinHash compared incrementally under a Bayesian bound, survivors verified exactly."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.llm.common import blocks, components, deal, fresh, groups, scatter_width, settle, spanning
from panelmill.llm.shingles import minhash, permutations, shingle_set


@dataclass(frozen=True)
class Settings:
    words: int = 5
    threshold: float = 0.8
    #: MinHash values, compared `step` at a time.
    hashes: int = 128
    step: int = 16
    #: A pair goes once the posterior probability of reaching the threshold is below this.
    tolerance: float = 1e-5
    #: Candidates share all values of one band; 0.8 is missed with probability (1 - 0.8**4)**20 = 3e-5.
    bands: int = 20
    rows: int = 4
    #: Rows of one side of a block of comparisons.
    block: int = 512


def least_matches(s: Settings) -> list[tuple[int, int]]:
    """(values compared, matches needed). With a uniform prior the posterior of the similarity after m matches in k
    is Beta(m + 1, k - m + 1); its tail above t is the chance of at most m successes in k + 1 tries of chance t."""
    out = []
    for k in range(s.step, s.hashes + 1, s.step):
        total, m = 0.0, -1
        while total < s.tolerance and m < k:
            m += 1
            total += comb(k + 1, m) * s.threshold**m * (1 - s.threshold) ** (k + 1 - m)
        out.append((k, m))
    return out


def survivors(left: np.ndarray, right: np.ndarray, same: bool, s: Settings, needed: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i in left, j in right; i < j if both are the same rows) that the Bayesian bound doesn't drop.

    The last values come first: those of the bands chose the candidates and say less.
    """
    got = np.zeros((len(left), len(right)), np.uint8)
    order = np.arange(s.hashes)[::-1]
    for h in order[: s.step]:
        got += left[:, h][:, None] == right[:, h][None, :]
    ok = got >= needed[0][1]
    if same:
        ok = np.triu(ok, 1)
    i, j = np.nonzero(ok)
    m = got[i, j].astype(np.int32)
    for (lo, _), (hi, least) in zip(needed, needed[1:]):
        if not len(i):
            break
        for h in order[lo:hi]:
            m += left[i, h] == right[j, h]
        keep = m >= least
        i, j, m = i[keep], j[keep], m[keep]
    return i, j


def overlaps(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets i and j, exact."""
    if len(i) <= 4 * len(sets):
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j)], np.int64)
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, number, many = np.unique(values, return_inverse=True, return_counts=True)
    shared = many[number] > 1
    number, owner = np.unique(number[shared], return_inverse=True)[1], owner[shared]
    order = np.argsort(number, kind="stable")
    number, owner = number[order], owner[order]
    total = np.zeros((len(sets), len(sets)), np.float32)
    width = 4096
    for lo in range(0, int(number[-1]) + 1 if len(number) else 0, width):
        a, b = np.searchsorted(number, [lo, lo + width])
        grid = np.zeros((len(sets), width), np.float32)
        grid[owner[a:b], number[a:b] - lo] = 1
        total += grid @ grid.T
    return total[i, j].astype(np.int64)


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, width)


def fingerprints(docs: DataFrame, s: Settings, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_hash, node (64 bits that stand for the shingle set; null if it is empty), signature."""
    a, b = permutations(s.hashes)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, signatures = [], []
            for text in batch.column(2):
                found = shingle_set(text.as_py(), s.words)
                nodes.append(int.from_bytes(hashlib.blake2b(found.tobytes(), digest_size=8).digest(), "little", signed=True) if len(found) else None)
                signatures.append(minhash(found, a, b).astype("<u4").tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(signatures, pa.binary())],
                                             names=["doc_id", "text_hash", "node", "signature"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(work, f"doc_id {kind}, text_hash long, node long, signature binary")


def candidate_edges(nodes: DataFrame, s: Settings) -> DataFrame:
    """Edges (a, b) that connect all pairs which share a band and pass the Bayesian bound; not the pairs themselves.

    Bands with one node go before signatures are shuffled.
    """
    size = 4 * s.rows
    keys = F.array(*[F.xxhash64(F.lit(i), F.expr(f"substring(signature, {i * size + 1}, {size})")) for i in range(s.bands)])
    banded = nodes.select("node", F.explode(keys).alias("band"))
    many = banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    # a node of which all bands are its own has no partner: the rest get their signature back
    rows = blocks(banded.join(many, "band"), "band", "n", s.block).join(nodes.select("node", "signature"), "node")
    dealt = deal(rows.select("band", "i", "j", "part", "node", "signature"), ["band", "i", "j"], ["part", "node"], scatter_width(nodes.sparkSession))
    needed = least_matches(s)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for group in groups(batches, 3):
            if group.num_rows > 1:
                i, j = _pairs(group, s, needed)
                node = group.column("node").to_numpy()
                out += [(int(node[a]), int(node[b])) for a, b in spanning(len(node), i, j)]
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["a", "b"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["a", "b"])

    return dealt.mapInArrow(work, "a long, b long")


def _pairs(group: pa.Table, s: Settings, needed: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Surviving pairs of rows of a block: within a part if i = j, else between its two parts."""
    signs = _matrix(group.column("signature"), s.hashes)
    part = group.column("part").to_numpy()
    i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
    if i == j:
        return survivors(signs, signs, True, s, needed)
    left, right = np.flatnonzero(part == i), np.flatnonzero(part == j)
    a, b = survivors(signs[left], signs[right], False, s, needed)
    return left[a], right[b]


def verify(docs: DataFrame, members: DataFrame, s: Settings, id_col: str, text_col: str) -> DataFrame:
    """Exact links among the nodes of each candidate component.

    members: node, root, n (nodes of the root), rep (a doc_id with the node's text), text_hash, many (rows of the node), signature.
    Returns rows (a, b, links): edges that span what is linked (links null), and for a node a the number of
    other rows linked to it in one block (b null).
    """
    texts = docs.select(F.col(id_col).alias("rep"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    texts = members.withColumnsRenamed({"rep": "m_rep", "text_hash": "m_hash"}).join(
        texts, F.col("m_rep").eqNullSafe(F.col("rep")) & F.col("m_hash").eqNullSafe(F.col("text_hash"))).select(
        "root", "n", "node", "many", "signature", "text")

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t.as_py(), s.words).tobytes() for t in b.column(5)]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sets, pa.binary())], names=["root", "n", "node", "many", "signature", "shingles"])

    sets = texts.mapInArrow(shingle, "root long, n long, node long, many long, signature binary, shingles binary")
    rows = blocks(sets, "root", "n", s.block // 2).select("root", "i", "j", "part", "node", "many", "signature", "shingles")
    dealt = deal(rows, ["root", "i", "j"], ["part", "node"], scatter_width(docs.sparkSession))
    needed = least_matches(s)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, 3):
            # equal rows of documents bring a node more than once
            node, first = np.unique(group.column("node").to_numpy(), return_index=True)
            if len(node) < 2:
                continue
            group = group.take(pa.array(np.sort(first)))
            node = group.column("node").to_numpy()
            i, j = _pairs(group, s, needed)
            if not len(i):
                continue
            found = [np.frombuffer(x, np.uint64) for x in group.column("shingles").to_pylist()]
            size = np.array([len(x) for x in found], np.int64)
            both = overlaps(found, i, j)
            good = both >= s.threshold * (size[i] + size[j] - both) - 1e-9
            i, j = i[good], j[good]
            if not len(i):
                continue
            many = group.column("many").to_numpy()
            links = np.zeros(len(node), np.int64)
            np.add.at(links, i, many[j])
            np.add.at(links, j, many[i])
            span = spanning(len(node), i, j)
            has = np.flatnonzero(links)
            a = [int(node[x]) for x, _ in span] + node[has].tolist()
            b = [int(node[y]) for _, y in span] + [None] * len(has)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([None] * len(span) + links[has].tolist(), pa.int64())],
                                             names=["a", "b", "links"])

    return dealt.mapInArrow(work, "a long, b long, links long")


def classes(docs: DataFrame, s: Settings, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The rows' fingerprints, and the nodes: node, rep and text_hash (its least row), many, root (of its class), links."""
    prints = settle(fingerprints(docs, s, id_col, text_col))
    nodes = prints.where("node is not null").groupBy("node").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("least"), F.count("*").alias("many"), F.any_value("signature").alias("signature"))
    nodes = settle(nodes.select("node", F.col("least.doc_id").alias("rep"), F.col("least.text_hash").alias("text_hash"), "many", "signature"))
    near = settle(components(candidate_edges(nodes, s)))
    sizes = near.groupBy("root").agg(F.count("*").alias("n"))
    members = near.join(sizes, "root").join(nodes, "node")
    found = settle(verify(docs, members, s, id_col, text_col))
    links = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    roots = components(found.where("b is not null").select("a", "b"))
    named = nodes.select("node", "rep", "text_hash", "many").join(roots, "node", "left").join(links, "node", "left")
    return prints, named.withColumn("root", F.coalesce("root", "node"))


def jaccard_join(docs: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, text_hash, class_id, n_links, kept.

    Two documents link if the Jaccard similarity of their sets of 5-word shingles (lower-cased words of
    letters, digits and underscores; whole texts) is at least 0.8. class_id is the least doc_id
    reachable by links; n_links counts the rows linked directly, equal texts included; kept marks
    the rows with doc_id = class_id.

    Documents of equal shingle sets are one node from the start, so copies are never paired. Nodes that
    share a band of MinHash values are compared in blocks under the Bayesian bound; blocks emit
    spanning edges, not pairs. Inside the components of these, all pairs are compared again, in blocks, and
    what the bound keeps is verified on the exact sets.

    A text of fewer than five words is one shingle; null texts, empty texts and texts without words link with nothing.
    Repeated rows link with each other; rows that share a doc_id are told apart by text. Other columns don't
    matter. An empty table gives an empty result.
    """
    prints, named = classes(docs, s, id_col, text_col)
    least = named.groupBy("root").agg(F.min("rep").alias("class_id"))
    named = named.join(least, "root").select("node", "class_id", (F.col("many") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    rows = prints.select("doc_id", "text_hash", "node").join(named, "node", "left")
    own = F.col("node").isNull()
    return rows.select("doc_id", "text_hash", F.when(own, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
                       F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def keep_one(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The rows of docs without near copies: of each class one row, that of the least doc_id (null last), then text_hash.

    A class is what links connect, not a class_id: rows without a doc_id, or with the doc_id of another text, stay if they
    link with nothing. So do all rows with null, empty or wordless texts, repeated or not; of repeated rows with words one stays.
    Columns as in docs, of any names and types. An empty table gives an empty result.
    """
    prints, named = classes(docs, s, "doc_id", "text")
    least = named.groupBy("root").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "text_hash")).alias("least"))
    own, kept_id, kept_hash, once, number = fresh(docs.columns, "own_hash", "kept_id", "kept_hash", "once", "number")
    firsts = least.select(F.col("least.rep").alias(kept_id), F.col("least.text_hash").alias(kept_hash), F.lit(True).alias(once))
    alone = prints.where("node is null").select("doc_id", "text_hash", F.lit(False)).distinct()
    stay = firsts.union(alone)
    rows = docs.withColumn(own, F.xxhash64("text"))
    rows = rows.join(stay, rows["doc_id"].eqNullSafe(stay[kept_id]) & (rows[own] == stay[kept_hash]))
    rows = rows.withColumn(number, F.when(F.col(once), F.lit(-1)).otherwise(F.monotonically_increasing_id()))
    return rows.dropDuplicates(["doc_id", own, number]).select(*docs.columns)
