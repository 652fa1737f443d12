"""Suffix-array dedup: bytes of long strings that also start in a document with a smaller id are removed."""

from __future__ import annotations

import hashlib
import pickle
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.llm.bwt import NONE, least_owner
from panelmill.llm.common import scatter_width, settle

MIX_A = np.uint64(0x9E3779B97F4A7C15)
MIX_B = np.uint64(0xBF58476D1CE4E5B9)
#: Every window of `length` bytes is filed under the least hash of its grams of so many bytes.
GRAM = 16
#: Windows handled at once, and at most in one run of windows.
BLOCK, LONGEST_RUN = 1 << 19, 256
#: Entries announced together; bytes of texts whose runs travel together; bytes in one transform.
ANNOUNCE, FLUSH, TRANSFORM = 1 << 19, 1 << 21, 1 << 16


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each 16-byte gram."""
    x = data.astype(np.uint64)
    for shift in (1, 2, 4):
        x = x[:-shift] | (x[shift:] << np.uint64(8 * shift))
    h = (x[:-8] * MIX_A) ^ x[8:]
    h = (h ^ (h >> np.uint64(29))) * MIX_B
    h = (h ^ (h >> np.uint64(32))) * MIX_A
    return h ^ (h >> np.uint64(31))


def _least_of(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive values."""
    n = len(h) - width + 1
    step = 1
    while 2 * step <= width:
        h = np.minimum(h[:-step], h[step:])
        step *= 2
    return np.minimum(h[:n], h[width - step : width - step + n])


def window_runs(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive windows filed alike: (first window, windows, file). Equal windows are filed alike everywhere."""
    total = len(data) - length + 1
    raw = np.frombuffer(data, np.uint8)
    starts, files = [], []
    for lo in range(0, max(total, 0), BLOCK):
        hi = min(lo + BLOCK, total)
        least = _least_of(gram_hashes(raw[lo : hi + length - 1]), length - GRAM + 1)
        cut = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        size = np.diff(np.concatenate([cut, [hi - lo]]))
        if size.max() > LONGEST_RUN:
            parts = -(-size // LONGEST_RUN)
            inner = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
            cut = np.repeat(cut, parts) + inner * LONGEST_RUN
        starts.append(cut + lo)
        files.append(least[cut] >> np.uint64(16))
    if not starts:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64)
    start = np.concatenate(starts)
    return start, np.diff(np.concatenate([start, [total]])), np.concatenate(files)


def _six(files: np.ndarray) -> bytes:
    """48-bit values in six bytes each."""
    return np.ascontiguousarray(files.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unsix(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8")


def _packed(what: object) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(what))


def _unpacked(data: bytes) -> object:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(data))


def home_of(owners: np.ndarray, homes: int) -> np.ndarray:
    """The home of each owner: where its list of shared files is put together."""
    return (owners.astype(np.uint64) * MIX_A >> np.uint64(33)).astype(np.int64) % homes


def _by_home(owner: np.ndarray, files: np.ndarray, homes: int) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """(home, owners, counts, files), one packed row for all owners of a home."""
    home = home_of(owner, homes)
    order = np.lexsort((files, owner, home))
    owner, files, home = owner[order], files[order], home[order]
    cuts = np.searchsorted(home, np.arange(homes + 1))
    for k in np.flatnonzero(np.diff(cuts)).tolist():
        lo, hi = cuts[k], cuts[k + 1]
        names, counts = np.unique(owner[lo:hi], return_counts=True)
        yield k, names.astype("<i8").tobytes(), counts.astype("<u4").tobytes(), _six(files[lo:hi])


class _Announcer:
    """Collects the files of texts and says, bucket by bucket, which file came from which text."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.clear()

    def clear(self) -> None:
        self.seen: dict[int, int] = {}
        self.files: list[np.ndarray] = []
        self.n = 0

    def add(self, text_hash: int, data: bytes, length: int) -> None:
        if text_hash not in self.seen:
            found = np.unique(window_runs(data, length)[2])
            if len(found):
                self.seen[text_hash] = len(self.files)
                self.files.append(found)
                self.n += len(found)

    def rows(self) -> Iterator[tuple]:
        """(bucket, kind, files, owners, counts): kind 0 announces, kind 1 goes to a home: its owners' shared files."""
        if not self.n:
            return
        hashes = np.array(list(self.seen), np.int64)
        files = np.concatenate(self.files)
        owner = np.repeat(np.arange(len(hashes)), [len(x) for x in self.files])
        _, number, many = np.unique(files, return_inverse=True, return_counts=True)
        several = many[number] > 1
        # shared already: the texts learn it here, the others hear of it once
        for home, names, counts, part in _by_home(hashes[owner[several]], files[several], self.buckets):
            yield home, 1, part, names, counts
        known = np.unique(files[several])
        files, owner = files[~several], owner[~several]
        bucket, known_bucket = files % np.uint64(self.buckets), known % np.uint64(self.buckets)
        order = np.argsort(bucket, kind="stable")
        files, owner, bucket = files[order], owner[order], bucket[order]
        cuts = np.searchsorted(bucket, np.arange(self.buckets + 1, dtype=np.uint64))
        for k in range(self.buckets):
            part, who = files[cuts[k] : cuts[k + 1]], owner[cuts[k] : cuts[k + 1]]
            if len(part):
                names, counts = np.unique(who, return_counts=True)  # owners come in order, so runs and counts agree
                yield k, 0, _six(part), hashes[names].tobytes(), counts.astype("<u4").tobytes()
            told = known[known_bucket == k]
            if len(told):
                yield k, 0, _six(told), None, None


_SAID = [("bucket", pa.int32()), ("kind", pa.int32()), ("files", pa.binary()), ("owners", pa.binary()), ("counts", pa.binary())]
_SAID_SQL = "bucket int, kind int, files binary, owners binary, counts binary"


def _batch(rows: list[tuple], fields: list) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, fields)], names=[n for n, _ in fields])


def shared_files(texts: DataFrame, length: int) -> DataFrame:
    """(owner, files): for each text hash, packed files that another text has too. texts: text_hash, data.

    Files meet in buckets; what a bucket finds shared goes to the owners' homes in one packed row a home, so the rows
    between the two are the pairs of a bucket and a home and don't grow with the owners.
    """
    buckets = scatter_width(texts.sparkSession, texts)

    def announce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Announcer(buckets)
        for b in batches:
            for h, data in zip(b.column(0).to_pylist(), b.column(1)):
                held.add(h, data.as_py(), length)
                if held.n >= ANNOUNCE:
                    yield _batch(list(held.rows()), _SAID)
                    held.clear()
        yield _batch(list(held.rows()), _SAID)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, files, owners = [], [], []
        for b in batches:
            forward = b.filter(pa.compute.equal(b.column(1), 1))
            if forward.num_rows:
                yield pa.RecordBatch.from_arrays([forward.column(k) for k in (0, 2, 3, 4)], names=["home", "files", "owners", "counts"])
            for kind, packed, names, counts in zip(*[c.to_pylist() for c in b.columns[1:]]):
                if kind == 1:
                    continue
                if names is None:
                    known.append(_unsix(packed))
                else:
                    files.append(_unsix(packed))
                    owners.append(np.repeat(np.frombuffer(names, np.int64), np.frombuffer(counts, "<u4")))
        if files:
            files, owners = np.concatenate(files), np.concatenate(owners)
            order = np.argsort(files)
            files, owners = files[order], owners[order]
            head = np.concatenate([[True], files[1:] != files[:-1]])
            at = np.flatnonzero(head)
            # copies of one text in different batches don't make its files shared
            shared = (np.minimum.reduceat(owners, at) != np.maximum.reduceat(owners, at))[np.cumsum(head) - 1]
            if known:
                shared |= np.isin(files, np.concatenate(known))
            rows = [(home, packed, names, counts) for home, names, counts, packed in _by_home(owners[shared], files[shared], buckets)]
            yield _batch(rows, [("home", pa.int32()), ("files", pa.binary()), ("owners", pa.binary()), ("counts", pa.binary())])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, owners = [], []
        for b in batches:
            for packed, names, counts in zip(*[c.to_pylist() for c in b.columns[1:]]):
                files.append(_unsix(packed))
                owners.append(np.repeat(np.frombuffer(names, "<i8"), np.frombuffer(counts, "<u4")))
        if not files:
            return
        files, owners = np.concatenate(files), np.concatenate(owners)
        order = np.lexsort((files, owners))
        files, owners = files[order], owners[order]
        fresh = np.concatenate([[True], (owners[1:] != owners[:-1]) | (files[1:] != files[:-1])])
        files, owners = files[fresh], owners[fresh]
        cuts = [*np.flatnonzero(np.concatenate([[True], owners[1:] != owners[:-1]])).tolist(), len(owners)]
        for k in range(0, len(cuts) - 1, 4096):
            part = list(zip(cuts[k : k + 4096], cuts[k + 1 : k + 4097]))
            yield _batch([(int(owners[lo]), _six(files[lo:hi])) for lo, hi in part], [("owner", pa.int64()), ("files", pa.binary())])

    said = texts.mapInArrow(announce, _SAID_SQL).repartitionById(buckets, F.col("bucket"))
    met = said.mapInArrow(meet, "home int, files binary, owners binary, counts binary").repartitionById(buckets, F.col("home"))
    return met.mapInArrow(gather, "owner long, files binary")


@dataclass
class _Flush:
    """Texts that travel together with the runs of windows whose files are shared."""

    docs: list[tuple] = field(default_factory=list)
    contents: dict[bytes, int] = field(default_factory=dict)
    files: list[int] = field(default_factory=list)
    least: list[int] = field(default_factory=list)
    most: list[int] = field(default_factory=list)
    occurs: list[tuple[int, int, int]] = field(default_factory=list)
    size: int = 0

    def add(self, key: tuple[int, int], own: int, data: bytes, files: np.ndarray, length: int) -> None:
        start, windows, file = window_runs(data, length)
        n = len(self.docs)
        self.docs.append((key, own, data))
        self.size += len(data)
        for k in np.flatnonzero(np.isin(file, files)).tolist():
            s = int(start[k])
            content = data[s : s + int(windows[k]) + length - 1]
            c = self.contents.setdefault(content, len(self.contents))
            if c == len(self.files):
                self.files.append(int(file[k]))
                self.least.append(own)
                self.most.append(own)
            else:
                self.least[c] = min(self.least[c], own)
                self.most[c] = max(self.most[c], own)
            self.occurs.append((c, n, s))

    def rows(self, buckets: int, flush: int) -> Iterator[tuple]:
        """(bucket, flush, kind, payload): kind 1 the texts, kind 0 their contents by bucket of their file."""
        if not self.docs:
            return
        yield flush % buckets, flush, 1, _packed((self.docs, np.array(self.occurs, np.int32).reshape(-1, 3)))
        files, least, most = (np.array(x, np.int64) for x in (self.files, self.least, self.most))
        groups = defaultdict(list)
        for content, c in self.contents.items():
            groups[self.files[c] % buckets].append((content, c))
        for bucket, group in groups.items():
            number = np.array([c for _, c in group], np.int64)
            low = least[number]
            # differences of what is mostly alike, and the contents in one piece: these pack well
            yield bucket, flush, 0, _packed((np.diff(number, prepend=0).astype(np.int32), files[number], low, most[number] - low,
                                             np.array([len(x) for x, _ in group], np.int32), b"".join([x for x, _ in group])))


_SENT = [("bucket", pa.int32()), ("flush", pa.int64()), ("kind", pa.int32()), ("payload", pa.binary())]
_SENT_SQL = "bucket int, flush long, kind int, payload binary"


def _contents(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    number, files, least, spread, sizes, joined = _unpacked(payload)
    ends = np.cumsum(sizes).tolist()
    return np.cumsum(number), files, least, least + spread, [joined[b - n : b] for b, n in zip(ends, sizes.tolist())]


def _resolve(groups: list[tuple[int, tuple]], length: int) -> Iterator[tuple]:
    """For the contents of a bucket (flush, (numbers, files, least, most, contents)): rows of kind 2 that tell each flush
    in which of its contents' windows a smaller owner than the content's greatest is found."""
    distinct: dict[bytes, int] = {}
    files, least, which = [], [], []
    for _, (_, file, low, _, contents) in groups:
        mine = np.empty(len(contents), np.int64)
        for k, (content, f, o) in enumerate(zip(contents, file.tolist(), low.tolist())):
            c = distinct.setdefault(content, len(distinct))
            if c == len(files):
                files.append(f)
                least.append(o)
            elif o < least[c]:
                least[c] = o
            mine[k] = c
        which.append(mine)
    texts = list(distinct)
    file, owner = np.array(files, np.int64), np.array(least, np.int64)
    order = np.argsort(file, kind="stable")
    heads = np.flatnonzero(np.concatenate([[True], file[order][1:] != file[order][:-1]])).tolist() + [len(order)]
    segments = []  # content, first window, last window + 1, least owner
    part: list[int] = []
    size = 0
    for lo, hi in zip(heads, heads[1:]):  # windows of different files never match, so a transform holds whole files
        part += order[lo:hi].tolist()
        size += sum(len(texts[c]) for c in order[lo:hi].tolist())
        if size >= TRANSFORM or hi == len(order):
            at = np.array(part, np.int64)
            local, low = least_owner([texts[c] for c in part], owner[at], length)
            head = np.concatenate([[True], (local[1:] != local[:-1]) | (low[1:] != low[:-1])])
            cut = np.flatnonzero(head)
            first = np.flatnonzero(np.concatenate([[True], local[1:] != local[:-1]]))
            begin = np.repeat(first, np.diff(np.concatenate([first, [len(local)]])))
            end = np.concatenate([cut[1:], [len(local)]])
            segments.append(np.stack([at[local[cut]], cut - begin[cut], end - begin[cut], low[cut]]))
            part, size = [], 0
    seg = np.concatenate(segments, axis=1)
    seg = seg[:, np.argsort(seg[0], kind="stable")]
    from_, to = np.searchsorted(seg[0], np.arange(len(texts))), np.searchsorted(seg[0], np.arange(len(texts)), "right")
    for (flush, (number, _, _, most, _)), mine in zip(groups, which):
        n = to[mine] - from_[mine]
        row = np.repeat(np.arange(len(mine)), n)
        at = np.arange(int(n.sum())) + np.repeat(from_[mine] - (np.cumsum(n) - n), n)
        useful = seg[3][at] < most[row]
        if useful.any():
            at, row = at[useful], row[useful]
            yield None, flush, 2, _packed(np.stack([number[row], seg[1][at], seg[2][at], seg[3][at]]))


def _finish(docs: list[tuple], occurs: np.ndarray, told: list[np.ndarray], length: int, with_text: bool) -> Iterator[tuple]:
    """(text_hash, text_sum, n_removed, n_spans, kept_sha256, left) for the texts of a flush that lose something."""
    edge = [np.zeros(len(data) + 1, np.int32) for _, _, data in docs]
    if told and len(occurs):
        seg = np.concatenate(told, axis=1)
        seg = seg[:, np.argsort(seg[0], kind="stable")]
        lo, hi = np.searchsorted(seg[0], occurs[:, 0]), np.searchsorted(seg[0], occurs[:, 0], "right")
        n = hi - lo
        row = np.repeat(np.arange(len(occurs)), n)
        at = np.arange(int(n.sum())) + np.repeat(lo - (np.cumsum(n) - n), n)
        ids = np.array([own for _, own, _ in docs], np.int64)
        hit = seg[3][at] < ids[occurs[row, 1]]
        row, at = row[hit], at[hit]
        for (doc, start), (first, last) in zip(occurs[row, 1:].tolist(), seg[1:3, at].T.tolist()):
            edge[doc][start + first] += 1
            edge[doc][start + last + length - 1] -= 1
    for (key, _, data), e in zip(docs, edge):
        gone = np.cumsum(e[:-1]) > 0
        if gone.any():
            kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
            spans = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
            yield *key, len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if with_text else None


def remove_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False,
                   carry: list[str] | None = None) -> DataFrame:
    """One row per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with_text also text (what is left; bytes
    that are no longer a whole character go) and row, a struct of the columns named in carry as they are.

    A byte of a text's UTF-8 goes if a window of `length` bytes over it also starts in a row with a smaller
    doc_id. Windows are filed under the least hash of their 16-byte grams, as equal windows are equally. Texts first announce
    their files; files of one text only are left out. Runs of windows of the other files meet bucket by bucket; there a
    Burrows-Wheeler transform of the distinct runs groups equal windows by interval expansion up to `length`
    and each group's least doc_id goes back to the texts. What one batch of texts has in common travels once, so a passage
    in a third of all texts is a few rows, and a file common to many texts is announced once a batch. Equal texts are one
    from the scan on, told apart by 128 bits of hash; the rows find their text's result by text and doc_id, so copies are spread.

    Of equal texts all but those with the least doc_id go whole, if they have `length` bytes. doc_id is an integer; a null one
    is greater than all others. Null text is empty, and stays null in text. Equal rows, and different texts of one doc_id, remove
    nothing from each other. An empty table gives an empty result.
    """
    if length <= GRAM:
        raise ValueError(f"length must be over {GRAM}")
    keep = carry or [id_col]
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    hashes = [F.xxhash64(text).alias("text_hash"), F.xxhash64(F.lit(length), text).alias("text_sum")]
    own = F.coalesce(F.col(id_col).cast("long"), F.lit(NONE)).alias("own")
    known, key = docs.select(*hashes, own), ["text_hash", "text_sum"]
    firsts = settle(known.groupBy(*key).agg(F.min("own").alias("first_id")))
    lists = shared_files(docs.select(hashes[0], text.cast("binary").alias("data")), length).withColumnRenamed("owner", "text_hash")
    lists = settle(firsts.join(lists, "text_hash"))
    # one row per text from the scan on: copies don't travel
    texts = docs.select(*hashes, text.cast("binary").alias("data")).groupBy(*key).agg(F.any_value("data").alias("data"))
    joined = texts.join(lists, key).select(*key, "first_id", "data", "files").sortWithinPartitions(*key)
    buckets = scatter_width(spark, docs)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # numbered by task and order: the rows come sorted, so a task that runs again makes the same batches
        held, flush = _Flush(), TaskContext.get().partitionId() << 32
        for b in batches:
            for one, two, first, data, files in zip(*[c.to_pylist() for c in b.columns[:3]], b.column(3), b.column(4)):
                held.add((one, two), first, data.as_py(), _unsix(files.as_py()), length)
                if held.size >= FLUSH:
                    yield _batch(list(held.rows(buckets, flush)), _SENT)
                    held, flush = _Flush(), flush + 1
        yield _batch(list(held.rows(buckets, flush)), _SENT)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = [(flush, _contents(payload)) for b in batches for flush, payload in zip(b.column(1).to_pylist(), b.column(3).to_pylist())]
        if groups:
            yield _batch(list(_resolve(groups, length)), _SENT)

    fields = [("text_hash", pa.int64()), ("text_sum", pa.int64()), ("gone", pa.int64()), ("runs", pa.int64()), ("kept", pa.string()), ("left", pa.string())]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, texts, told = None, None, []

        def out() -> pa.RecordBatch:
            return _batch(list(_finish(*texts, told, length, with_text)), fields)

        for b in batches:
            for flush, kind, payload in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3)):
                what = _unpacked(payload.as_py())
                if flush != last and texts is not None:
                    yield out()
                    texts, told = None, []
                last = flush
                if kind == 1:
                    texts = what
                else:
                    told.append(what)
        if texts is not None:
            yield out()

    # each step is written, so that its shuffles go before the next, and replaces the step before
    sent = settle(joined.mapInArrow(send, _SENT_SQL), lists)
    told = sent.where("kind = 0").repartitionById(buckets, F.col("bucket")).mapInArrow(meet, _SENT_SQL)
    flushes = told.unionByName(sent.where("kind = 1")).select("bucket", "flush", "kind", "payload").repartition(buckets, "flush").sortWithinPartitions("flush", "kind")
    changed = settle(flushes.mapInArrow(finish, "text_hash long, text_sum long, gone long, runs long, kept string, left string"), sent)
    first = firsts.select(*key, F.col("first_id").alias("own")).join(changed, key, "left").withColumn("first", F.lit(True))
    rows = docs.select(*hashes, own, F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("sha"),
                       *([F.col(text_col).alias("text"), F.struct(*keep).alias("row")] if with_text else []))
    rows = rows.join(first, [*key, "own"], "left")
    whole = F.col("first").isNull() & (F.col("n_bytes") >= length)  # a copy of a text with a smaller id
    out = [F.col("doc_id"), F.col("n_bytes"), F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("gone", F.lit(0))).alias("n_removed"),
           F.when(whole, F.lit(1)).otherwise(F.coalesce("runs", F.lit(0))).cast("long").alias("n_spans"),
           F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256")]
    if with_text:
        out += [F.when(whole, F.lit("")).otherwise(F.coalesce("left", "text")).alias("text"), "row"]
    return rows.select(*out)
