"""Embedding near-dedup by NN-descent: a neighbour graph refined through neighbours of neighbours."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import acos, ceil, log, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.llm.common import blocks, components, deal, groups, scatter_width, settle, spanning


@dataclass(frozen=True)
class Settings:
    threshold: float = 0.98
    #: Neighbours kept; where links fill a list, its vector and all that its links reach are searched for in the whole cell.
    neighbours: int = 10
    #: Random orders by signs of projections, cut into leaves, that the graph starts from.
    starts: int = 8
    leaf: int = 32
    sample: int = 8
    rounds: int = 12
    #: Vectors with links whose neighbours an exact search finds too; the graph is refined again below this recall,
    #: and in the end all its vectors are searched exactly.
    audited: int = 128
    recall: float = 0.999
    #: Vectors of a cell; labels with more are split by signs of projections, several times over.
    cell: int = 16384
    #: Chance that no split keeps a pair at the threshold together.
    missed: float = 1e-3
    seed: int = 3


def splits(n: int, s: Settings) -> tuple[int, int]:
    """(bits, times): signs that cut n vectors into cells, and how many independent cuts keep a linked pair together."""
    bits = max(0, ceil(log(n / s.cell, 2))) if n else 0
    together = (1 - acos(s.threshold) / pi) ** bits
    return bits, 1 if not bits else ceil(log(s.missed) / log(1 - together))


def _best(ids: np.ndarray, near: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest distinct ids of each row; -1 and -inf where there are fewer."""
    order = np.argsort(ids, axis=1, kind="stable")
    ids, near = np.take_along_axis(ids, order, 1), np.take_along_axis(near, order, 1)
    near[:, 1:][ids[:, 1:] == ids[:, :-1]] = -np.inf
    near[ids < 0] = -np.inf
    if ids.shape[1] > k:
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        ids, near = np.take_along_axis(ids, top, 1), np.take_along_axis(near, top, 1)
    order = np.argsort(-near, axis=1)
    ids, near = np.take_along_axis(ids, order, 1), np.take_along_axis(near, order, 1)
    return np.where(np.isneginf(near), -1, ids), near


class Graph:
    """The neighbour lists of a cell's unit vectors."""

    def __init__(self, vectors: np.ndarray, s: Settings):
        self.s, self.exact = s, vectors
        self.v = vectors.astype(np.float32)
        self.n = len(vectors)
        self.rng = np.random.default_rng(s.seed)
        self.k = min(s.neighbours, self.n - 1)
        self.ids = np.full((self.n, self.k), -1, np.int64)
        self.near = np.full((self.n, self.k), -np.inf, np.float32)

    def similar(self, rows: np.ndarray, others: np.ndarray) -> np.ndarray:
        """Similarities of rows to the ids in others (a row of ids each); -inf for themselves and for -1."""
        out = np.empty(others.shape, np.float32)
        step = max(1, (1 << 22) // max(1, others.shape[1] * self.v.shape[1]))
        for lo in range(0, len(rows), step):
            part = others[lo : lo + step]
            out[lo : lo + step] = np.matmul(self.v[part], self.v[rows[lo : lo + step]][:, :, None])[:, :, 0]
        out[(others < 0) | (others == rows[:, None])] = -np.inf
        return out

    def merge(self, rows: np.ndarray, ids: np.ndarray, near: np.ndarray, lists: tuple[np.ndarray, np.ndarray]) -> int:
        """Puts candidates into the rows' lists; the number of new neighbours."""
        old_ids, old_near = lists[0][rows], lists[1][rows]
        new_ids, new_near = _best(np.concatenate([old_ids, np.where(np.isneginf(near), -1, ids)], 1), np.concatenate([old_near, near], 1), old_ids.shape[1])
        lists[0][rows], lists[1][rows] = new_ids, new_near
        return int(np.count_nonzero(np.nan_to_num(new_near, neginf=-2).sum(1) > np.nan_to_num(old_near, neginf=-2).sum(1) + 1e-6))

    def start(self) -> None:
        """Leaves of random sign orders: the nearest in one's leaf."""
        leaf = self.s.leaf
        for _ in range(self.s.starts):
            planes = self.rng.normal(size=(self.v.shape[1], 16)).astype(np.float32)
            code = ((self.v @ planes) > 0) @ (1 << np.arange(15, -1, -1))
            order = np.lexsort((self.rng.random(self.n), code))
            order = np.concatenate([order, order[: -self.n % leaf]]) if self.n >= leaf else order
            part = order.reshape(-1, min(leaf, len(order)))
            near = np.matmul(self.v[part], self.v[part].transpose(0, 2, 1))
            others = np.repeat(part, part.shape[1], axis=0)
            rows = part.reshape(-1)
            near = near.reshape(len(rows), -1)
            near[others == rows[:, None]] = -np.inf
            rows, first = np.unique(rows, return_index=True)
            self.merge(rows, others[first], near[first], (self.ids, self.near))

    def around(self) -> np.ndarray:
        """Each vector's sampled neighbours, forward and backward, -1 where there are none."""
        m = self.s.sample
        pick = self.rng.integers(0, self.k, (self.n, m))
        forward = np.take_along_axis(self.ids, pick, 1)
        row, to = np.repeat(np.arange(self.n), m), forward.reshape(-1)
        row, to = row[to >= 0], to[to >= 0]
        shuffled = self.rng.permutation(len(to))
        order = shuffled[np.argsort(to[shuffled], kind="stable")]
        row, to = row[order], to[order]
        rank = np.arange(len(to)) - np.searchsorted(to, to)
        backward = np.full((self.n, m), -1, np.int64)
        some = rank < m
        backward[to[some], rank[some]] = row[some]
        return np.concatenate([forward, backward], 1)

    def descend(self) -> None:
        """Neighbours of neighbours become candidates until few lists change."""
        rows = np.arange(self.n)
        for _ in range(self.s.rounds):
            near_by = self.around()
            changed = 0
            step = max(1, (1 << 20) // near_by.shape[1] ** 2)
            for lo in range(0, self.n, step):
                part = near_by[lo : lo + step]
                ids = np.where(part[:, :, None] >= 0, near_by[part], -1).reshape(len(part), -1)
                changed += self.merge(rows[lo : lo + step], ids, self.similar(rows[lo : lo + step], ids), (self.ids, self.near))
            if changed < 0.002 * self.n:
                return

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Linked pairs i < j of the lists, each similarity taken again in double precision."""
        row = np.repeat(np.arange(self.n), self.k)
        to, near = self.ids.reshape(-1), self.near.reshape(-1)
        some = (to >= 0) & (near >= self.s.threshold - 1e-4)
        row, to = row[some], to[some]
        pair = np.unique(np.minimum(row, to) * self.n + np.maximum(row, to))
        i, j = pair // self.n, pair % self.n
        good = np.zeros(len(i), bool)
        for lo in range(0, len(i), 1 << 16):
            a, b = i[lo : lo + (1 << 16)], j[lo : lo + (1 << 16)]
            good[lo : lo + (1 << 16)] = np.einsum("ij,ij->i", self.exact[a], self.exact[b]) >= self.s.threshold
        return i[good], j[good]

    def enlarge(self) -> Links:
        """The links of the lists; vectors whose lists links fill, and all that these reach, form groups.

        The lists of a group may lack links, to its own vectors or to others: they are found exactly.
        """
        i, j = self.links()
        full = self.near[:, -1] >= self.s.threshold - 1e-4
        parent = np.arange(self.n)
        while True:
            low = parent.copy()
            np.minimum.at(low, i, parent[j])
            np.minimum.at(low, j, parent[i])
            low = low[low]
            if (low == parent).all():
                break
            parent = low
        saturated = np.isin(parent, parent[full])
        members = np.flatnonzero(saturated)
        members = members[np.argsort(parent[members], kind="stable")]
        groups = np.split(members, np.flatnonzero(np.diff(parent[members])) + 1) if len(members) else []
        alone = ~(saturated[i] | saturated[j])
        return Links(self, i[alone], j[alone], groups)

    def audit(self, links: Links) -> float:
        """The mean part of a vector's true links that was found, over vectors outside groups.

        Vectors are taken at random until enough of them have links, or all are.
        """
        rest = np.ones(self.n, bool)
        for group in links.groups:
            rest[group] = False
        found = np.bincount(links.i, minlength=self.n) + np.bincount(links.j, minlength=self.n)
        rows = self.rng.permutation(np.flatnonzero(rest))
        parts: list[float] = []
        step = max(1, (1 << 20) // self.n)
        for lo in range(0, len(rows), step):
            own = rows[lo : lo + step]
            near = (self.exact[own] @ self.exact.T >= self.s.threshold + 1e-12) & rest
            near[np.arange(len(own)), own] = False
            true = near.sum(axis=1)
            parts += np.minimum(1.0, found[own] / np.maximum(true, 1))[true > 0].tolist()
            if len(parts) >= self.s.audited:
                break
        return float(np.mean(parts)) if parts else 1.0


def exact_links(v: np.ndarray, rows: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All linked pairs i < j of unit vectors of which one at least is in rows, a few rows at a time."""
    among = np.zeros(len(v), bool)
    among[rows] = True
    step = max(1, (1 << 20) // len(v))
    for lo in range(0, len(rows), step):
        at, to = np.nonzero(v[rows[lo : lo + step]] @ v.T >= threshold)
        at = rows[at + lo]
        once = (to > at) | ~among[to]
        yield np.minimum(at, to)[once], np.maximum(at, to)[once]


@dataclass
class Links:
    """Linked pairs i < j: those of the lists, and those with a vector of a group, which are taken a few rows at a time."""

    graph: Graph
    i: np.ndarray
    j: np.ndarray
    groups: list[np.ndarray]

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        yield self.i, self.j
        if self.groups:
            yield from exact_links(self.graph.exact, np.concatenate(self.groups), self.graph.s.threshold)


def linked(vectors: np.ndarray, s: Settings = Settings(), tries: int = 4) -> tuple[Links, float]:
    """The links of unit vectors (two at least), and their recall by the audit.

    A poor graph is started and refined again; if the last one is poor, all its vectors are one group, searched exactly.
    """
    graph = Graph(vectors, s)
    for _ in range(tries):
        graph.start()
        graph.descend()
        found = graph.enlarge()
        recall = graph.audit(found)
        if recall >= s.recall:
            return found, recall
    none = np.zeros(0, np.int64)
    return Links(graph, none, none, [np.arange(graph.n)]), 1.0


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]


def near_duplicates(df: DataFrame, s: Settings = Settings(), id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors of one label (not null) and one length link at a cosine of `threshold` or more. Equal vectors are one node from
    the start and link with each other. The nodes of a label are cut into cells by signs of random projections, so
    often that a linked pair shares a cell but with a small chance; a cell over its size is cut into parts, and each pair of
    parts is a block. In a block NN-descent finds the links; the pairs of its lists are handed on from every block and count
    once. Vectors of groups are searched for exactly in all their blocks: each pair counts where it meets first, and
    counts and spanning edges are handed on, not pairs.

    Null vectors, zero vectors and those with null or non-finite components, or with a null label, link with nothing and are their own
    component. Repeated rows are rows that link. Other columns don't matter. An empty table gives an empty result.
    """
    x = F.col("v")
    number = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf"))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"), F.col(label_col).alias("label"))
    fine = F.coalesce(F.col("label").isNotNull() & F.forall(x, number) & F.exists(x, lambda e: e != 0), F.lit(False))
    rows = rows.withColumn("node", F.when(fine, F.xxhash64("label", "v")))
    nodes = settle(rows.where("node is not null").groupBy("node", "label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("many")))
    sizes = nodes.groupBy("label", F.size("v").alias("width")).agg(F.count("*").alias("n"))
    placed = nodes.select("node", "label", "v", F.size("v").alias("width")).join(sizes, ["label", "width"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            alike: dict[tuple[int, int], list[int]] = {}
            for k, of in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
                alike.setdefault(of, []).append(k)
            keys: list[list[int]] = [[]] * b.num_rows
            for (width, n), rows in alike.items():
                bits, times = splits(n, s)
                part = b.column(4).take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), width)
                codes = [((part @ np.random.default_rng([s.seed, width, t]).normal(size=(width, bits))) > 0) @ (1 << np.arange(bits)) for t in range(times)]
                for k, own in zip(rows, np.stack(codes, 1).tolist()):
                    keys[k] = own
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(keys, pa.list_(pa.int64()))], names=["node", "label", "width", "keys"])

    kind = df.schema[label_col].dataType.simpleString()
    keyed = settle(placed.select("node", "label", "width", "n", "v").mapInArrow(place, f"node long, label {kind}, width int, keys array<long>"))
    cells = keyed.select("node", "keys", "label", "width", F.posexplode("keys").alias("turn", "key")).select(
        "node", "keys", "turn", F.xxhash64("label", "width", "turn", "key").alias("cell"))
    many = cells.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    split = blocks(cells.join(many, "cell"), "cell", "n", max(1, s.cell // 2))
    split = split.join(nodes.select("node", "v", F.col("many").alias("weight")), "node").select("cell", "i", "j", "part", "turn", "node", "weight", "keys", "v")
    dealt = deal(split, ["cell", "i", "j"], ["part", "node"], scatter_width(df.sparkSession))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, 3):
            n = group.num_rows
            if n < 2:
                continue
            node, weight = [group.column(c).to_numpy() for c in ("node", "weight")]
            found, _ = linked(matrix(group, "v"), s)
            hot = node[np.concatenate(found.groups)] if found.groups else node[:0]
            swap = node[found.i] > node[found.j]
            i, j = np.where(swap, found.j, found.i), np.where(swap, found.i, found.j)
            none = [None] * len(hot)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (
                node[i].tolist() + hot.tolist(), node[j].tolist() + none, weight[i].tolist() + none, weight[j].tolist() + none)], names=["a", "b", "of_a", "of_b"])

    def matrix(group: pa.Table, column: str) -> np.ndarray:
        flat = group.column(column).combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return unit(flat.reshape(group.num_rows, -1))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, 3):
            n = group.num_rows
            part, node, weight = [group.column(c).to_numpy() for c in ("part", "node", "weight")]
            hot = np.flatnonzero(group.column("hot").to_numpy(zero_copy_only=False))
            keys = group.column("keys").combine_chunks().flatten().to_numpy().reshape(n, -1)
            turn = group.column("turn")[0].as_py()
            across = group.column("i")[0].as_py() != group.column("j")[0].as_py()
            links = np.zeros(n, np.int64)
            span: list[tuple[int, int]] = []
            for i, j in exact_links(matrix(group, "v"), hot, s.threshold):
                new = ~(keys[i, :turn] == keys[j, :turn]).any(axis=1)
                if across:
                    new &= part[i] != part[j]
                i, j = i[new], j[new]
                np.add.at(links, i, weight[j])
                np.add.at(links, j, weight[i])
                if len(i):
                    more = np.array(span, np.int64).reshape(-1, 2)
                    span = spanning(n, np.concatenate([more[:, 0], i]), np.concatenate([more[:, 1], j]))
            has = np.flatnonzero(links)
            a = [int(node[x]) for x, _ in span] + node[has].tolist()
            b = [int(node[y]) for _, y in span] + [None] * len(has)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([None] * len(span) + links[has].tolist(), pa.int64())],
                                             names=["a", "b", "links"])

    found = settle(dealt.mapInArrow(work, "a long, b long, of_a long, of_b long"))
    hot = settle(found.where("b is null").select(F.col("a").alias("node")).distinct())
    pairs = found.where("b is not null").distinct()
    for end in ("a", "b"):
        pairs = pairs.join(hot.withColumnRenamed("node", end), end, "left_anti")
    pairs = settle(pairs)
    edges = pairs.select("a", "b")
    links = pairs.select(F.col("a").alias("node"), F.col("of_b").alias("links")).union(pairs.select("b", "of_a"))
    if not hot.isEmpty():
        flagged = split.join(hot.withColumn("hot", F.lit(True)), "node", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
        near = flagged.join(flagged.where("hot").select("cell", "i", "j").distinct(), ["cell", "i", "j"])
        near = near.select("cell", "i", "j", "part", "turn", "node", "weight", "keys", "v", "hot")
        near = deal(near, ["cell", "i", "j"], ["part", "node"], scatter_width(df.sparkSession))
        exact = settle(near.mapInArrow(search, "a long, b long, links long"))
        edges = edges.union(exact.where("b is not null").select("a", "b"))
        links = links.union(exact.where("b is null").select("a", "links"))
    links = links.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(edges)
    named = nodes.select("node", "rep", "many").join(roots, "node", "left").join(links, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = named.join(named.groupBy("root").agg(F.min("rep").alias("component_id")), "root")
    named = named.select("node", "component_id", (F.col("many") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = rows.select("vec_id", "node").join(named, "node", "left")
    own = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id")).withColumn(
        "kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
