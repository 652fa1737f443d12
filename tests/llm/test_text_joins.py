"""N-gram Jaccard join and suffix-array dedup against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelmill.llm import bwt, ngram_join, shingles, suffix_dedup


def shingle_sets(rows):
    words = [re.findall(r"\w+", (r[1] or "").lower()) for r in rows]
    return [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()) for w in words]


def classes(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


def brute_join(rows):
    sets = shingle_sets(rows)
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    root = classes(len(rows), pairs)
    links = Counter(x for p in pairs for x in p)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root[i]] = min(least.get(root[i], r[0]), r[0])
    return sorted((str(r[0]), str(least.get(root[i])), links[i]) for i, r in enumerate(rows))


@pytest.mark.parametrize("block", [512, 4])
def test_join_equals_brute_force(docs, rows, block):
    got = ngram_join.jaccard_join(docs, ngram_join.Settings(block=block)).collect()
    assert sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in got) == brute_join(rows)


def test_join_of_nothing(empty):
    assert ngram_join.jaccard_join(empty).count() == 0
    assert ngram_join.keep_one(empty).count() == 0


def test_join_with_other_columns(docs):
    odd = docs.withColumn("node", F.lit(1)).withColumn("signature", F.lit("x")).withColumn("root", F.lit(2)).withColumn("kept", F.lit(3)).withColumn("a", F.lit(4))
    assert ngram_join.jaccard_join(odd).count() == docs.count()
    assert ngram_join.keep_one(odd).columns == odd.columns


def test_one_document_of_each_group_stays(docs, rows):
    kept = ngram_join.keep_one(docs).collect()
    sets = shingle_sets([tuple(r) for r in kept])
    assert not any(sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) for a in range(len(kept)) for b in range(a))
    assert len({c for _, c, _ in brute_join(rows)}) <= len(kept)


def test_one_row_of_each_component_stays(spark):
    words = " ".join(f"w{i}" for i in range(40))
    rows = [(1, words, "a"), (2, words, "b"), (1, words, "c"), (3, "one text of an id", None), (3, "quite another text of it", None), (3, "", None), (4, "", None),
            (4, None, None), (None, "first without an id", "x"), (None, "second without an id", "y"), (None, words + " more", "z"), (None, "", None), (None, "", None)]
    kept = ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    sets = shingle_sets(rows)
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    root = classes(len(rows), pairs)
    assert len(kept) == len(set(root))
    assert Counter((r.doc_id, r.text) for r in kept) == Counter(rows[i][:2] for i in set(root))


def test_as_many_rows_as_components_stay(docs, rows):
    sets = shingle_sets(rows)
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert ngram_join.keep_one(docs).count() == len(set(classes(len(rows), pairs)))


def test_bound_keeps_similar_pairs():
    s = ngram_join.Settings()
    needed = ngram_join.least_matches(s)
    assert [k for k, _ in needed] == list(range(16, 129, 16)) and needed[-1][1] > 70
    a, b = shingles.permutations(128)
    rng = np.random.default_rng(1)
    for _ in range(50):
        base = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
        other = base.copy()
        other[:50] = rng.integers(0, 1 << 63, 50, dtype=np.uint64)  # similarity 450 / 550
        x, y = shingles.minhash(base, a, b), shingles.minhash(other, a, b)
        i, _ = ngram_join.survivors(x[None], y[None], False, s, needed)
        assert len(i) == 1
        far = shingles.minhash(rng.integers(0, 1 << 63, 500, dtype=np.uint64), a, b)
        assert len(ngram_join.survivors(x[None], far[None], False, s, needed)[0]) == 0


@given(st.lists(st.text(alphabet="ab é", max_size=30), min_size=2, max_size=6))
@settings(max_examples=50, deadline=None)
def test_shingle_sets_are_equal_as_words_are(texts):
    sets = [shingles.shingle_set(t).tolist() for t in texts]
    plain = shingle_sets([(0, t) for t in texts])
    for a in range(len(texts)):
        for b in range(a):
            assert len(set(sets[a]) & set(sets[b])) == len(plain[a] & plain[b])


def test_long_word_and_long_text():
    assert len(shingles.shingle_set("x" * 1_000_000)) == 1
    assert len(shingles.shingle_set("w " * 300_000)) == 1


@given(st.integers(2, 20), st.lists(st.tuples(st.binary(max_size=60), st.integers(0, 5)), min_size=1, max_size=8))
@settings(max_examples=100, deadline=None)
def test_interval_expansion_equals_brute_force(length, items):
    contents = [c for c, _ in items] + [items[0][0][1:] + b"z"]
    owners = np.array([o for _, o in items] + [3], np.int64)
    least = {}
    for c, o in zip(contents, owners.tolist()):
        for i in range(len(c) - length + 1):
            least[c[i : i + length]] = min(o, least.get(c[i : i + length], o))
    want = [least[c[i : i + length]] for c in contents for i in range(len(c) - length + 1)]
    assert bwt.least_owner(contents, owners, length)[1].tolist() == want


@given(st.binary(min_size=0, max_size=400))
@settings(max_examples=50, deadline=None)
def test_runs_cover_all_windows(data):
    start, size, file = suffix_dedup.window_runs(data, 50)
    assert int(size.sum()) == max(0, len(data) - 49) and len(file) == len(start)
    again = suffix_dedup.window_runs(b"xyz" + data + b"q", 50)
    of = {data[i : i + 50]: f for s, n, f in zip(start.tolist(), size.tolist(), file.tolist()) for i in range(s, s + n)}
    for s, n, f in zip(*[x.tolist() for x in again]):
        for i in range(s, s + n):
            assert of.get((b"xyz" + data + b"q")[i : i + 50], f) == f


def brute_removal(rows, length=50):
    starts = defaultdict(set)
    ids = [float("inf") if r[0] is None else r[0] for r in rows]
    data = [(r[1] or "").encode() for r in rows]
    for i, b in zip(ids, data):
        for p in range(len(b) - length + 1):
            starts[b[p : p + length]].add(i)
    least = {w: min(s) for w, s in starts.items()}
    out = []
    for i, b in zip(ids, data):
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if least[b[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out.append((str(i), len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_removal_equals_brute_force(docs, rows, small, monkeypatch):
    if small:  # many batches and transforms
        for name, value in (("ANNOUNCE", 500), ("FLUSH", 3000), ("TRANSFORM", 700), ("BLOCK", 64), ("LONGEST_RUN", 16)):
            monkeypatch.setattr(suffix_dedup, name, value)
    got = suffix_dedup.remove_repeats(docs).collect()
    mine = sorted((str(float("inf") if r.doc_id is None else r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got)
    assert mine == brute_removal(rows)


def test_removal_with_text_and_columns(docs, rows, empty):
    out = suffix_dedup.remove_repeats(docs.withColumn("files", F.lit("x")), with_text=True, carry=["lang", "source", "files"]).collect()
    assert len(out) == len(rows) and all(r.row.files == "x" for r in out)
    assert {(r.doc_id, r.row.source) for r in out} == {(r[0], r[3]) for r in rows}
    assert sum(r.text is None for r in out) == sum(r[1] is None for r in rows)
    assert all(hashlib.sha256((r.text or "").encode()).hexdigest() == r.kept_sha256 for r in out if r.n_removed == 0)
    assert suffix_dedup.remove_repeats(empty, with_text=True, carry=["lang"]).count() == 0
