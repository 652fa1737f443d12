"""Operators over whole tables: packing, mixing, embeddings, components, and the pipeline."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from panelmill.llm import common, mixing, neighbours, packing
from panelmill.llm.tokens import tokenizer_path

# ---------------------------------------------------------------- packing


def brute_best_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(bins) if r >= n]
        if fits:
            bins[min(fits)[1]] -= n
        else:
            bins.append(capacity - n)
    return sorted(bins)


@given(st.integers(1, 40).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=80))))
@settings(max_examples=150, deadline=None)
def test_plan_is_best_fit_decreasing(case):
    capacity, lengths = case
    placed = defaultdict(list)
    for n, lo, hi, first, per, offset in packing.plan(Counter(lengths), capacity):
        for r in range(hi - lo):
            placed[first + r // per].append((offset + r % per * n, n))
    left = []
    for parts in placed.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        left.append(capacity - at)
    assert sorted(left) == brute_best_fit(lengths, capacity)


def test_encoder_gives_the_tokenizers_ids():
    encoder = packing.Encoder(tokenizer_path())
    for text in ["", "a" * 5000, " " * 300, "it's 12 o'clock\n\n\tnow", "héllo <|endoftext|> wörld", "日本語 😀 text", "x\r\ny z"]:
        assert encoder.ids(text) == encoder.slow.encode(text, add_special_tokens=False).ids


def test_cut():
    assert packing.cut(5, 10) == [(0, 5)] and packing.cut(10, 10) == [(0, 10)]
    assert packing.cut(25, 10) == [(0, 5), (5, 10), (15, 10)] and packing.cut(20, 10) == [(0, 10), (10, 10)]


def test_packed_documents(docs, rows, empty):
    got = packing.pack_documents(docs.withColumn("length", F.lit("x")), tokenizer_path(), capacity=64).collect()
    encoder = packing.Encoder(tokenizer_path())
    want = Counter()
    for r in rows:
        ids = np.array([*encoder.slow.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4")
        for k, (s, n) in enumerate(packing.cut(len(ids), 64)):
            want[(r[0], k, s, n, zlib.crc32(ids[s : s + n].tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 64
    assert len(bins) == len(brute_best_fit([r.length for r in got], 64))
    assert packing.pack_documents(empty, tokenizer_path()).count() == 0


# ---------------------------------------------------------------- mixing


def brute_targets(sizes, most=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, full = {}, set()
    while True:
        rest = sum(sizes.values()) - sum(most * sizes[s] for s in full)
        total = sum(weight[s] for s in order if s not in full)
        target = {s: most * sizes[s] if s in full else weight[s] * rest / total for s in order}
        over = {s for s in order if s not in full and target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over


def word_count(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@pytest.mark.parametrize("bucket_rows", [4096, 2])
def test_mixture(docs, rows, bucket_rows):
    got = mixing.mix_to_targets(docs, bucket_rows=bucket_rows).collect()
    again = mixing.mix_to_targets(docs.repartition(2)).collect()
    assert Counter(got) == Counter(again)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += word_count(r[1])
    target = brute_targets(dict(sizes))
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r[0], word_count(r[1])) for r in rows)
    taken = defaultdict(int)
    by_size = {n: s for s, n in sizes.items()}
    assert len(by_size) == len(sizes)
    for r in got:
        source = by_size[r.source_size]
        assert abs(r.target - target[source]) < 1e-6 and 0 <= r.taken <= 3 * r.size
        taken[source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in sizes)


@given(st.dictionaries(st.text("abc", max_size=3) | st.none(), st.integers(0, 1000), min_size=1, max_size=9))
@settings(max_examples=15, deadline=None)
def test_targets_equal_resharing(spark, sizes):
    df = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size long, n_rows long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    if sum(sizes.values()):
        want = brute_targets(sizes)
        assert all(abs(got[s] - want[s]) <= 1e-6 * max(1, want[s]) for s in sizes)


def test_taken_rows(docs, empty):
    taken = {}
    for r in mixing.mix_to_targets(docs).collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.taken
    out = mixing.take_mixture(docs)
    assert out.columns == docs.columns
    words = defaultdict(int)
    for r in out.collect():
        words[r.doc_id] += word_count(r.text)
        assert r.doc_id is None or r.n_chars == len(r.text)
    assert dict(words) == {k: v for k, v in taken.items() if v}
    assert mixing.mix_to_targets(empty).count() == 0 and mixing.take_mixture(empty).count() == 0


def test_cut_words():
    assert mixing.cut_words(" a  b\tc ", 2) == " a  b" and mixing.cut_words("a", 5) == "a" and mixing.cut_words(None, 1) is None


# ---------------------------------------------------------------- embeddings and components


def vectors(seed=0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(300, 16))
    near = base[:40] + rng.normal(size=(40, 16)) * 0.02
    cluster = base[50] + rng.normal(size=(60, 16)) * 0.05
    rows = [(i, v.astype(np.float32).tolist(), i % 3) for i, v in enumerate(base)]
    rows += [(1000 + i, v.astype(np.float32).tolist(), i % 3) for i, v in enumerate(near)]
    rows += [(2000 + i, v.astype(np.float32).tolist(), 2) for i, v in enumerate(cluster)]
    rows += [(3000 + i, rows[5][1], rows[5][2]) for i in range(7)] + [rows[4], (3100, rows[5][1], None), (3101, [0.0] * 16, 1), (3102, None, 1),
             (3103, [float("nan")] * 16, 1), (3104, [float("inf")] + [1.0] * 15, 1), (3105, [None] + [1.0] * 15, 1), (3106, [], 1),
             (3107, [1.0, 0.0], 1), (3108, [2.0, 0.0], 1), (3109, rows[8][1], 0)]
    return rows


def brute_links(rows, threshold=0.98):
    ok = [r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    unit = [np.array(r[1]) / np.linalg.norm(r[1]) if o else None for r, o in zip(rows, ok)]
    parent, links = list(range(len(rows))), Counter()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold:
                links[a] += 1
                links[b] += 1
                parent[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted((r[0], links[i], least[find(i)], r[0] == least[find(i)]) for i, r in enumerate(rows))


@pytest.mark.parametrize("cell", [2048, 60])
def test_links_equal_brute_force(spark, cell):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit(1)).withColumn("links", F.lit(1)).repartition(3)
    got = neighbours.near_duplicates(df, neighbours.Settings(cell=cell, missed=1e-6)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == brute_links(rows)
    assert neighbours.near_duplicates(df.where("false")).count() == 0


def test_descent_recall():
    rng = np.random.default_rng(2)
    base = neighbours.unit(rng.normal(size=(1500, 32)))
    twins = neighbours.unit(base[:300] + rng.normal(size=(300, 32)) * 0.015)
    group = neighbours.unit(base[400] + rng.normal(size=(200, 32)) * 0.02)
    v = np.concatenate([base, twins, group])
    links, audit = neighbours.linked(v)
    pairs = {p for i, j in links.pairs() for p in zip(i.tolist(), j.tolist())}
    true = set(zip(*[x.tolist() for x in np.nonzero(np.triu(v @ v.T >= 0.98, 1))]))
    assert pairs <= true and len(pairs) >= 0.999 * len(true) and audit >= 0.999 and len(links.groups) == 1


def linked_pairs(v, *args):
    return {p for i, j in neighbours.linked(v, *args)[0].pairs() for p in zip(i.tolist(), j.tolist())}


def true_pairs(v):
    return set(zip(*[x.tolist() for x in np.nonzero(np.triu(v @ v.T >= 0.98, 1))]))


def test_links_between_tight_groups():
    rng = np.random.default_rng(6)
    a = neighbours.unit(rng.normal(size=(1, 32)))
    side = rng.normal(size=(1, 32))
    side = neighbours.unit(side - (side @ a.T) * a)
    centres = np.concatenate([a, 0.984 * a + (1 - 0.984**2) ** 0.5 * side])
    v = neighbours.unit(np.repeat(centres, 20, axis=0) + rng.normal(size=(40, 32)) * 0.001)
    v = np.concatenate([v, neighbours.unit(rng.normal(size=(100, 32)))])
    assert len(true_pairs(v)) == 40 * 39 // 2 and linked_pairs(v) == true_pairs(v)


def test_a_poor_graph_with_few_links_is_searched_exactly():
    rng = np.random.default_rng(7)
    base = neighbours.unit(rng.normal(size=(3000, 32)))
    v = np.concatenate([base, neighbours.unit(base[:6] + rng.normal(size=(6, 32)) * 0.03)])
    assert true_pairs(v) and linked_pairs(v, neighbours.Settings(starts=1, leaf=2, rounds=0)) == true_pairs(v)


def test_a_link_missed_in_one_cell_counts_in_another(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(400, 16))
    v = np.concatenate([base, base[:150] + rng.normal(size=(150, 16)) * 0.02])
    rows = [(i, x.tolist(), 1) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    s = neighbours.Settings(cell=300, missed=1e-9, starts=2, leaf=8, rounds=0, recall=0.0)
    got = neighbours.near_duplicates(df, s).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == brute_links(rows)


def test_a_label_of_several_cells_at_production_settings(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(17000, 32))
    v = np.concatenate([base, base[:600] + rng.normal(size=(600, 32)) * 0.12, base[5000] + rng.normal(size=(150, 32)) * 0.09]).astype(np.float32)
    label = np.where(np.arange(len(v)) % 1700 == 3, 2, 1)  # some twins lie across labels
    df = spark.createDataFrame([(i, x, int(k)) for i, (x, k) in enumerate(zip(v.tolist(), label))], "vec_id long, embedding array<float>, label int").repartition(4)
    got = np.zeros(len(v), int)
    for r in neighbours.near_duplicates(df).collect():
        got[r.vec_id] = r.n_links
    u, want = neighbours.unit(v), np.zeros(len(v), int)
    for lo in range(0, len(u), 1000):
        want[lo : lo + 1000] = ((u[lo : lo + 1000] @ u.T >= 0.98) & (label[lo : lo + 1000, None] == label)).sum(1) - 1
    assert (got <= want).all() and got.sum() >= 0.99 * want.sum() > 20000


@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=25))
@settings(max_examples=5, deadline=None)
def test_components(spark, edges):
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges or [(0, 0)], "a long, b long")).collect()}
    near = defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    for node in near:
        seen, todo = {node}, [node]
        while todo:
            todo += [x for x in near[todo.pop()] if x not in seen and not seen.add(x)]
        assert got[node] == min(seen)
    assert set(got) == set(near)


def test_components_of_a_path(spark):
    edges = spark.range(200).selectExpr("id a", "id + 1 b")
    got = common.components(edges).collect()
    assert len(got) == 201 and {r.root for r in got} == {0}


# ---------------------------------------------------------------- the pipeline


def test_pipeline(spark):
    sf_dir = "/root/testdata/sf0.001"
    first = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs, kept = first, []
    for name, stage in corpus_pipeline.STAGES:
        docs = common.settle(stage(spark, docs, sf_dir))
        kept.append(docs)
        if name != "best_fit_packing":
            assert docs.columns == first.columns and docs.dtypes == first.dtypes
    good, single, cut, mixed, packed = kept
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    assert first.join(labels, "doc_id", "left_semi").join(good, "doc_id", "left_anti").count() <= 0.05 * labels.count()
    from test_text_joins import brute_removal, shingle_sets

    rows = [tuple(r) for r in single.collect()]
    sets = shingle_sets(rows)
    assert not any(sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) for a in range(len(rows)) for b in range(a))
    want = {int(i): n - gone for i, n, gone, _, _ in brute_removal(rows)}
    assert all(want[r.doc_id] - 3 * 40 <= len(r.text.encode()) <= want[r.doc_id] for r in cut.collect())
    words = {r.doc_id: word_count(r.text) for r in cut.collect()}
    counts = Counter()
    for r in mixed.collect():
        counts[r.doc_id] += word_count(r.text)
    assert all(n <= 3 * words[i] for i, n in counts.items()) and abs(sum(counts.values()) - sum(words.values())) <= len({r.source for r in cut.collect()})
    encoder = packing.Encoder(tokenizer_path())
    assert sum(r.length for r in packed.collect()) == sum(len(encoder.ids(r.text)) + 1 for r in mixed.collect())


def test_stages_on_odd_rows(spark, rows, tmp_path):
    """Nulls, repeated ids and rows, unlike texts of one id, no rows at all, and columns named as the stages name theirs."""
    spark.createDataFrame([(i, 1) for i in range(8)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    names = ["score", "predicted", "own_hash", "kept_hash", "kept_id", "once", "number", "n_removed", "row", "left", "mix_hash", "mix_id", "taken", "whole", "cut", "part",
             "size", "piece", "start", "length", "sequence_id", "offset", "text_hash", "node", "files"]
    base = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    odd = base.select("*", *[F.concat(F.lit(f"{n}:"), F.col("doc_id").cast("string")).alias(n) for n in names], F.current_timestamp().alias("at"),
                      F.create_map(F.lit("k"), F.col("doc_id")).alias("m"))
    odd = common.settle(odd)
    for given, many in ((odd, True), (odd.where("false"), False)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, given, str(tmp_path))
            if name == "best_fit_packing":
                assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
                assert out.count() >= given.count()
                continue
            assert out.columns == given.columns and out.dtypes == given.dtypes
            got = out.collect()
            assert bool(got) == many
            for r in got:
                assert all(getattr(r, n) == (None if r.doc_id is None else f"{n}:{r.doc_id}") for n in names) and r.m == {"k": r.doc_id}
            if name == "suffix_array_dedup":
                assert len(got) == given.count() and sum(r.text is None for r in got) == given.where("text is null").count()
                assert {r.at for r in got} <= {r.at for r in given.select("at").distinct().collect()}
            if name == "ngram_jaccard_join" and many:
                from test_text_joins import shingle_sets

                sets = shingle_sets(rows)
                root = list(range(len(rows)))
                for a in range(len(rows)):
                    for b in range(a):
                        if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                            x, y = root[a], root[b]
                            root = [y if r == x else r for r in root]
                assert len(got) == len(set(root))


def test_equal_ids_and_rows_spread(spark):
    """Half of the rows have no id and a third are one row; decisions stay whole."""
    data = [(None, f"some words {i % 50} " * (1 + i % 7), "s") for i in range(300)] + [(4, "the very same row", "s")] * 200 + [(i, "a b c", "t") for i in range(10, 60)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = mixing.mix_to_targets(df, bucket_rows=16).collect()
    assert len(got) == len(data) and all(r.taken <= 3 * r.size for r in got)
    by = {}
    for r in got:
        by.setdefault(r.source_size, [r.target, 0])[1] += r.taken
    assert all(abs(target - taken) <= 0.5 for target, taken in by.values())
    assert sum(word_count(r.text) for r in mixing.take_mixture(df, bucket_rows=16).collect()) == sum(taken for _, taken in by.values())
    packed = packing.pack_documents(df, tokenizer_path()).collect()
    assert len(packed) == len(data) and len({(r.sequence_id, r.offset) for r in packed}) == len(data)


@pytest.mark.parametrize("shape", ["hub at the top", "hub at the bottom", "two hubs"])
def test_components_of_hubs(spark, shape):
    edges = {"hub at the top": [(1000, i) for i in range(600)], "hub at the bottom": [(0, i) for i in range(1, 600)],
             "two hubs": [(0, i) for i in range(2, 400)] + [(1, i) for i in range(399, 800)]}[shape]
    got = common.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.root for r in got} == {0} and len(got) == len({x for e in edges for x in e})
