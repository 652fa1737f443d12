"""The registered queries against plain versions, on a small copy of the tables."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest

import corpus_pipeline
from panelmill.llm import chat, licenses, media, packing, quality, queries, webp_many
from panelmill.llm.tokens import tokenizer_path
from test_tables import brute_best_fit, brute_links, brute_targets, vectors, word_count
from test_text_joins import brute_join, brute_removal, classes, shingle_sets

NOTICES = ["Apache-2.0-header", "MIT-text", "ISC-text", "Zlib-text", "GPL-3.0"]


@pytest.fixture(scope="module")
def documents(rows):
    rng = random.Random(9)
    plain = lambda n: " ".join(rng.choice(["water", "stone", "river", "cloud", "field", "amber"]) for _ in range(n))
    more = [(500 + k, f"{plain(30)} {licenses.TEMPLATES[name]} {plain(20)}", "en", "s9", 1) for k, name in enumerate(NOTICES)]
    junk = [(600 + k, "click here BUY now $$$ " * rng.randint(2, 9) + str(k), None, "spam", 9) for k in range(40)]
    return rows + more + junk


@pytest.fixture(scope="module")
def sf_dir(spark, documents, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(documents, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(i, y, 0) for i, y in LABELS.items()], "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    spark.createDataFrame(vectors(), "vec_id long, embedding array<float>, label int").write.parquet(str(path / "embeddings.parquet"))
    talks = [(c, t, role, text) for c in range(5) for t, (role, text) in enumerate([("system", None), ("user", f"q {c} <|end|>"), ("assistant", "a \\ <|>"), ("assistant", "é" * c)])]
    spark.createDataFrame(talks[::-1], "conv_id long, turn long, role string, text string").write.parquet(str(path / "conversations.parquet"))
    return str(path)


LABELS = {i: 1 for i in range(30)} | {600 + k: 0 for k in range(25)}


def plain_model(documents):
    s, labels = quality.Settings(), LABELS
    texts = {}
    for i, text, *_ in documents:
        if i in labels and zlib.crc32(str(i).encode()) % 3 != 1:
            texts[i] = min((t for t in (texts.get(i), text) if t is not None), default=None) if i in texts else text
    found = []
    for i in sorted(texts):
        ids, n = quality.featurize(texts[i], s)
        found.append((ids.astype(np.int32), (n / max(1, n.sum())).astype(np.float32)))
    model = quality.fit(found, [labels[i] for i in sorted(texts)], s)
    return quality.Model(model.weight.astype(np.float32), model.bias, s)


def test_op1(spark, sf_dir, documents):
    model = plain_model(documents)
    want = Counter((i, i is not None and zlib.crc32(str(i).encode()) % 3 == 1, round(model.score(t), 9), int(model.score(t) >= 0.5)) for i, t, *_ in documents)
    assert Counter((r.doc_id, r.held_out, round(r.score, 9), r.predicted) for r in queries.op1_quality_classifier(spark, sf_dir).collect()) == want


def plain_feature(payload):
    rows = [payload[k : k + 192] for k in range(0, len(payload), 192)]
    out = [f"48x{len(rows)}"]
    channel = [[row[c::4] for row in rows] for c in range(4)]
    mean = [sum(map(sum, c)) / (48 * len(rows)) for c in channel]
    sd = [max(0.0, sum(x * x for row in c for x in row) / (48 * len(rows)) - m * m) ** 0.5 for c, m in zip(channel, mean)]
    step = [sum(abs(a - b) for row in c for a, b in zip(row, row[1:])) / (47 * len(rows)) for c in channel]
    return ";".join(out + [f"{n}=" + ",".join(f"{x:.3f}" for x in v) for n, v in (("mean", mean), ("sd", sd), ("step", step))])


def test_op2(spark, sf_dir, documents):
    want = Counter()
    for i, text, *_ in documents:
        raw = (text or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        stored = media.store_many([payload])[0]
        assert b"".join(x.tobytes() for x in webp_many.decode_many([stored])) == payload
        want[i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), plain_feature(payload)] += 1
    got = queries.op2_media_columns(spark, sf_dir).collect()
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256, r.feature) for r in got) == want


def plain_pieces(texts):
    encoder = packing.Encoder(tokenizer_path())
    out = Counter()
    for i, text in texts:
        ids = np.array([*encoder.slow.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) if len(ids) <= 1024 else len(ids) % 1024 or 1024
        for k, (a, b) in enumerate(zip([0, *range(first, len(ids), 1024)], [*range(first, len(ids), 1024), len(ids)])):
            out[i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    return out


def check_packed(got, want):
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 1024
    assert len(bins) == len(brute_best_fit([r.length for r in got], 1024))


def test_op3(spark, sf_dir, documents):
    check_packed(queries.op3_best_fit_packing(spark, sf_dir).collect(), plain_pieces([(r[0], r[1]) for r in documents]))


def test_op4(spark, sf_dir, documents):
    """The whole text's alignment with every template, without windows."""
    seen = []
    for r in queries.op4_license_scans(spark, sf_dir).collect():
        texts = [t for i, t, *_ in documents if i == r.doc_id]
        want = [{name for name, t in licenses.TEMPLATES.items() if len(licenses.align(licenses.words_of(text), licenses.words_of(t))) >= 0.8 * len(licenses.words_of(t))} for text in texts]
        assert {f.license for f in r.licenses} in want and (r.license is None) == (r.n_licenses == 0)
        seen += [f.license for f in r.licenses]
    assert set(NOTICES) <= set(seen)


def test_op5(spark, sf_dir):
    got = queries.op5_embedding_near_dedup(spark, sf_dir).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == brute_links(vectors())


def test_op6(spark, sf_dir, documents):
    got = queries.op6_ngram_jaccard_join(spark, sf_dir).collect()
    assert sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in got) == brute_join(documents)


def test_op9(spark, sf_dir, documents):
    got = queries.op9_suffix_array_dedup(spark, sf_dir).collect()
    assert sorted((str(float("inf") if r.doc_id is None else r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_removal(documents)


def test_op10(spark, sf_dir):
    talks = defaultdict(list)
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").orderBy("conv_id", "turn").collect():
        talks[r.conv_id].append((r.role, r.text or ""))
    talks[-7] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    want = {}
    for c, turns in talks.items():
        said = "".join(t for role, t in turns if role == "assistant")
        want[c] = (len(turns), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest(), len(chat.render(turns)))
    got = queries.op10_chat_formatting(spark, sf_dir).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in got} == want and all(r.error is None for r in got)


def plain_mixture(rows):
    """(doc_id, text) as the mix takes them; rows: id, text, source."""
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += word_count(text)
    out = []
    for source, target in brute_targets(dict(sizes)).items():
        budget = min(int(Decimal(target).quantize(Decimal(1), ROUND_HALF_UP)), 3 * sizes[source])
        epochs, left = divmod(budget, sizes[source]) if sizes[source] else (0, 0)
        key = lambda r: hashlib.md5(f"mix:{'' if r[0] is None else r[0]}:{hashlib.md5((r[1] or '').encode()).hexdigest()}".encode()).hexdigest()
        for i, text, _ in sorted((r for r in rows if r[2] == source), key=key):
            size = word_count(text)
            if not size:
                continue
            out += [(i, text)] * epochs
            now = min(size, left)
            left -= now
            if now:
                out.append((i, text if now == size else corpus_pipeline.mixing.cut_words(text, now)))
    return out


def test_pipeline_equals_plain_stages(spark, sf_dir, documents):
    model = plain_model(documents)
    good = [r for r in documents if model.score(r[1]) >= 0.5]
    sets = shingle_sets(good)
    root = classes(len(good), [(a, b) for a in range(len(good)) for b in range(a) if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])
    best = {}
    for k, r in enumerate(good):
        best[root[k]] = min(best.get(root[k], (True, 0, k)), (r[0] is None, r[0] or 0, k))
    single = [good[k] for _, _, k in best.values()]
    kept = {}
    for i, n, gone, _, sha in brute_removal(single):
        kept[i, sha] = gone
    rest = []
    for r in single:
        left = plain_removal(single, r)
        assert (str(float("inf") if r[0] is None else r[0]), hashlib.sha256(left).hexdigest()) in kept
        rest.append((r[0], left.decode("utf-8", "ignore"), r[3]))
    got = corpus_pipeline.run(spark, sf_dir).collect()
    check_packed(got, plain_pieces(plain_mixture(rest)))
    assert 0 < len(single) < len(good) < len(documents) and any(kept.values())


def plain_removal(rows, row, length=50):
    own = float("inf") if row[0] is None else row[0]
    before = {b[p : p + length] for i, t, *_ in rows if (float("inf") if i is None else i) < own for b in [(t or "").encode()] for p in range(len(b) - length + 1)}
    data = (row[1] or "").encode()
    gone = bytearray(len(data))
    for p in range(len(data) - length + 1):
        if data[p : p + length] in before:
            gone[p : p + length] = b"\1" * length
    return bytes(x for x, g in zip(data, gone) if not g)
