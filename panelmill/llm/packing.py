"""Best-fit decreasing packing of token sequences, with a segment tree over remaining capacities."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelmill.llm.common import settle


class Encoder:
    """The ids that the `tokenizers` library gives for a byte-level BPE file, made by `tiktoken` from the same file.

    Both merge by the same ranks; tiktoken takes a quarter of the time. A text that holds a
    special token's string, which tokenizers reads as that token, is left to tokenizers.
    """

    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(plain))}
        ranks = {bytes(shown[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.slow = Tokenizer.from_file(path)

    def ids(self, text: str) -> list[int]:
        if any(s in text for s in self.special):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: full ones but perhaps the first."""
    first = n % capacity or capacity
    if n <= capacity:
        return [(0, n)]
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


class SpaceTree:
    """A segment tree over remaining capacities 0..capacity that counts open bins by what is left in them."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.counts = [0] * (2 * self.width)

    def add(self, left: int, n: int) -> None:
        i = left + self.width
        while i:
            self.counts[i] += n
            i >>= 1

    def tightest(self, need: int) -> int:
        """The least remaining capacity >= need that has an open bin, or -1; logarithmic in the capacity."""
        i = need + self.width
        if self.counts[i]:
            return need
        while i > 1:
            if not i & 1 and self.counts[i + 1]:
                i += 1
                while i < self.width:
                    i = 2 * i if self.counts[2 * i] else 2 * i + 1
                return i - self.width
            i >>= 1
        return -1


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts of lengths: rows (length, first rank, last rank + 1, first bin, pieces per bin, offset).

    Pieces of one length are alike, and so are bins with equal space left: a run of pieces goes to a run of
    bins at once. The tightest bin that fits a piece stays the tightest that fits its like until it doesn't
    fit, so it takes as many as it can, as it would if pieces came singly. Steps depend on the
    number of lengths and not on the number of pieces.
    """
    tree = SpaceTree(capacity)
    open_bins: dict[int, list[tuple[int, int]]] = {}
    rows = []
    bins = 0

    def leave(left: int, lo: int, hi: int) -> None:
        if left and hi > lo:
            tree.add(left, hi - lo)
            open_bins.setdefault(left, []).append((lo, hi))

    for length in sorted(histogram, reverse=True):
        todo, rank = histogram[length], 0
        while todo:
            space = tree.tightest(length)
            if space < 0:
                per = capacity // length
                n = -(-todo // per)
                lo, hi, space = bins, bins + n, capacity
                bins += n
            else:
                lo, hi = open_bins[space].pop()
                tree.add(space, lo - hi)
                per = space // length
                if (hi - lo) * per > todo:  # the rest of these bins stays as it is
                    cut_at = lo + -(-todo // per)
                    leave(space, cut_at, hi)
                    hi = cut_at
            n = min(todo, (hi - lo) * per)
            rows.append((length, rank, rank + n, lo, per, capacity - space))
            whole = n // per
            leave(space - per * length, lo, lo + whole)
            if n % per:
                leave(space - (n % per) * length, lo + whole, lo + whole + 1)
            todo -= n
            rank += n
    return rows


def pieces(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 2,
           with_ids: bool = False) -> DataFrame:
    """Tokenize whole texts and cut those over capacity: doc_id, piece, start, length, ids_crc32 (and ids)."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        for b in batches:
            rows: list[list] = [[], [], [], [], [], []]
            for k, text in enumerate(b.column(1)):  # one text's tokens at a time
                ids = np.array([*encoder.ids(text.as_py() or ""), end_id], "<u4")
                for p, (start, length) in enumerate(cut(len(ids), capacity)):
                    part = ids[start : start + length]
                    for to, x in zip(rows, (k, p, start, length, zlib.crc32(part.tobytes()), part.astype(np.int32) if with_ids else None)):
                        to.append(x)
            which = pa.array(rows[0], pa.int64())
            cols = [b.column(0).take(which), pa.array(rows[1], pa.int32()), *[pa.array(r, pa.int64()) for r in rows[2:5]]]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cols.append(pa.array(rows[5], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(work, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def pack(cut_up: DataFrame, capacity: int = 1024, bucket_rows: int = 1024) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32, ...).

    Only the histogram of lengths, at most capacity rows, comes to the driver; the plan that goes back
    has a few rows per length. A piece finds its place by its rank among pieces of its length: ranks
    are a bucket's offset plus the rank in the bucket, so a length that a third of all pieces share
    is dealt to many tasks. Buckets are dealt by the number that a row gets when the pieces are written, so equal ids, null
    ids and repeated rows spread like others. Repeated rows are packed each on its own; an empty input gives an empty result.
    """
    spark = cut_up.sparkSession
    held = settle(cut_up.withColumn("number", F.monotonically_increasing_id()))
    histogram = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if any(not 0 < n <= capacity for n in histogram):
        raise ValueError("a piece is empty or longer than the capacity")
    wide = max(1, -(-max(histogram.values(), default=0) // bucket_rows))
    rows = held.withColumn("bucket", F.pmod(F.xxhash64("number"), F.lit(wide)))
    sums = rows.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("length", "bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("length", "bucket").orderBy("number")
    rows = rows.withColumn("inside", F.row_number().over(inside) - 1).join(sums, ["length", "bucket"]).withColumn("rank", F.col("ahead") + F.col("inside"))
    fields = "p_length long, p_lo long, p_hi long, p_bin long, p_per long, p_offset long"
    steps = F.broadcast(spark.createDataFrame(plan(histogram, capacity), fields))
    fits = (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("p_lo")) & (F.col("rank") < F.col("p_hi"))
    nth = F.col("rank") - F.col("p_lo")
    return rows.join(steps, fits).select(
        *cut_up.columns, (F.col("p_bin") + F.expr("(rank - p_lo) div p_per")).cast("long").alias("sequence_id"),
        (F.col("p_offset") + (nth % F.col("p_per")) * F.col("length")).cast("long").alias("offset"))


def pack_documents(df: DataFrame, tokenizer: str, capacity: int = 1024, **kw) -> DataFrame:
    """Tokenize, cut and pack whole texts: one row per piece, with its place.

    Null and empty texts are the end id alone. Null and repeated ids and repeated rows are documents of their own. Other columns
    don't matter, whatever their names. An empty table gives an empty result.
    """
    return pack(pieces(df, tokenizer, capacity=capacity, **kw), capacity)
