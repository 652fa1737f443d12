"""Operators that decide row by row: quality, licenses, media, sharding, chat."""

import base64
import hashlib
import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelmill.llm import chat, licenses, media, quality, sharding, webp, webp_many
from panelmill.llm.queries import SHARDS


# ---------------------------------------------------------------- quality


@pytest.fixture(scope="module")
def tables(spark):
    return [spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels")]


def test_held_out_accuracy(tables):
    docs, labels = tables
    scored = quality.classify(docs, labels).join(labels, "doc_id").where(quality.held_out("doc_id")).collect()
    assert len(scored) > 80 and np.mean([r.predicted == r.quality for r in scored]) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in scored)


def test_held_out_labels_teach_nothing(tables):
    docs, labels = tables
    other = labels.withColumn("quality", F.when(quality.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    s = quality.Settings(epochs=1, sample_rows=60)
    plain = lambda pairs: [(ids.tolist(), share.tolist(), y) for (ids, share), y in pairs]
    assert plain(quality.training_rows(docs, labels, s)) == plain(quality.training_rows(docs, other, s)) != []
    ids = {i for i in range(1000) if zlib.crc32(str(i).encode()) % 3 == 1}
    assert {r.doc_id for r in docs.where(quality.held_out("doc_id")).collect()} == {r.doc_id for r in docs.collect()} & ids


def test_quality_of_odd_rows(spark, docs, rows, empty):
    labels = spark.createDataFrame([(0, 1), (0, 0), (1, 1), (2, None), (3, 0), (None, 1), (4, 7), (5, 1), (99999, 0), (7, 1), (7, 1)], "doc_id long, quality int")
    s = quality.Settings(epochs=2)
    found = [tuple(ids.tolist()) for (ids, _), _ in quality.training_rows(docs, labels, s)]
    assert found and set(found) <= {tuple(quality.featurize(r[1], s)[0].tolist()) for r in rows if r[0] in (1, 3, 5, 7)}
    assert docs.where(quality.held_out("doc_id").isNull()).count() == 0
    odd = docs.withColumn("score", F.lit("mine")).withColumn("weight", F.lit(1))
    out = quality.classify(odd, labels, s)
    assert out.count() == len(rows) and out.columns == ["doc_id", "text", "lang", "source", "n_chars", "weight", "score", "predicted"]
    assert len({r.score for r in out.where("text is null or text = ''").collect()}) == 1
    assert quality.classify(empty, labels, s).count() == 0
    nothing = quality.classify(docs, labels.where("false"), s)
    assert {r.score for r in nothing.collect()} == {0.5}


def test_blocks_see_all_features(monkeypatch):
    text = " ".join(random.Random(3).choice(["alpha", "beta", "gamma"]) for _ in range(400))
    s = quality.Settings()
    whole = quality.featurize(text, s)
    monkeypatch.setattr(quality, "BLOCK", 50)
    parts = quality.featurize(text, s)
    assert parts[1].sum() >= 0.95 * whole[1].sum() and set(parts[0]) <= set(whole[0])


# ---------------------------------------------------------------- licenses


@given(st.lists(st.integers(0, 9), max_size=9))
def test_longest_increasing(values):
    got = [values[i] for i in licenses.longest_increasing(values)]
    best = max(len(c) for k in range(len(values) + 1) for c in itertools.combinations(values, k) if all(a < b for a, b in zip(c, c[1:])))
    assert len(got) == best and all(a < b for a, b in zip(got, got[1:]))


@given(st.lists(st.sampled_from("abcdef"), max_size=25), st.lists(st.sampled_from("abcdef"), max_size=25))
def test_alignment_is_a_common_subsequence(a, b):
    pairs = licenses.align(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
    assert licenses.align(a, a) == [(i, i) for i in range(len(a))]


def test_scan(spark, empty):
    filler = " ".join(f"word{i}" for i in range(500))
    mit = licenses.TEMPLATES["MIT-terms"]
    broken = " ".join(w for i, w in enumerate(mit.split()) if i % 9)
    texts = [None, "", "license", licenses.TEMPLATES["MIT"], f"{filler}\n{licenses.TEMPLATES['GPL-3.0']}\n{filler}", f"{filler} {mit.upper()} {filler}",
             broken, " ".join(reversed(mit.split())), (licenses.TEMPLATES["Apache-2.0"] + "\n") * 40, "under the License the General Public version of this work"]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(3, texts[3], "x")]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, license string")).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [by[i].license for i in range(10)] == [None, None, None, "MIT", "GPL-3.0", "MIT-terms", "MIT-terms", None, "Apache-2.0", None]
    assert by[5].coverage == 1.0 and by[5].licenses[0].first_word == 500 and 0.8 <= by[6].coverage < 1
    assert licenses.scan_licenses(empty).count() == 0


@pytest.mark.parametrize("kept, spread", [(0.85, 1.4), (0.85, 1.6), (0.9, 1.6), (1.0, 1.9)])
def test_a_match_within_twice_the_length_is_found_at_every_offset(kept, spread):
    template = [f"t{i}" for i in range(40)]
    scanner = licenses.Scanner({"x": " ".join([*template, "the"])})
    words = [w for i, w in enumerate(template) if i % 20 < round(20 * kept)]
    places = np.linspace(0, spread * len(template) - 1, len(words)).astype(int).tolist()
    text = ["other"] * (places[-1] + 1)
    for i, w in zip(places, words):
        text[i] = w
    for offset in range(90):
        assert scanner.scan(["the", *["other"] * offset, *text, "other", "the"]), offset


def test_common_headers_and_texts_are_known():
    scanner = licenses.Scanner()
    for name, text in licenses.TEMPLATES.items():
        assert scanner.scan(licenses.words_of(f"some code {text} more code"))[0]["license"] == name
    for name in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "BSD-3-Clause", "BSD-2-Clause", "MIT", "ISC", "Zlib"):
        assert any(k.startswith(name) and k.endswith(("-header", "-text")) for k in licenses.TEMPLATES), name
    header = """ * This program is free software: you can redistribute it and/or modify
     * it under the terms of the GNU General Public License as published by
     * the Free Software Foundation, either version 3 of the License, or
     * (at your option) any later version.
     * This program is distributed in the hope that it will be useful,
     * but WITHOUT ANY WARRANTY; without even the implied warranty of
     * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
     * GNU General Public License for more details."""
    assert scanner.scan(licenses.words_of(header))[0]["license"] == "GPL-3.0-or-later-header"


def test_all_places_of_a_license_are_found():
    template = [f"t{i}" for i in range(30)]
    other = [f"o{i}" for i in range(500)]
    found = licenses.Scanner({"x": " ".join(template)}).scan(other[:50] + template + other[50:400] + template[:27] + other[400:])
    assert [(f["first_word"], f["last_word"], f["matched"]) for f in found] == [(50, 79, 30), (430, 456, 27)]


def test_a_match_of_two_distant_halves_is_found():
    template = [f"t{i}" for i in range(40)]
    assert licenses.Scanner({"x": " ".join(template)}).scan(template[:17] + ["other"] * 42 + template[-17:])


# ---------------------------------------------------------------- media


def picture(kind, h, w, seed=0):
    rng = np.random.default_rng(seed)
    if kind == "noise":
        return rng.integers(0, 256, (h, w, 4)).astype(np.uint8)
    if kind == "repeats":
        return np.tile(rng.integers(0, 256, (1, 5, 4)).astype(np.uint8), (h, w // 5 + 1, 1))[:, :w]
    if kind == "smooth":
        y, x = np.mgrid[:h, :w]
        return np.stack([(x * 3 + y) % 256, (x + y * 2) % 256, (x * y) % 256, 255 - (x + y) % 5], -1).astype(np.uint8)
    colours = rng.integers(0, 256, (int(kind), 4)).astype(np.uint8)
    return colours[rng.integers(0, len(colours), (h, w))]


OPTIONS = [webp.Options(), webp.Options(cache_bits=4), webp.Options(references=True), webp.Options(references=True, cache_bits=7, cells=2),
           webp.Options(predictor=3, cross=2, subtract_green=True), webp.Options(subtract_green=True, references=True, predictor=4, modes=(11, 12, 13)),
           *[webp.Options(predictor=2, modes=(m,)) for m in range(14)]]


@pytest.mark.parametrize("kind", ["noise", "repeats", "smooth", "1", "2", "4", "13", "200"])
@pytest.mark.parametrize("shape", [(1, 1), (1, 19), (11, 1), (23, 30)])
def test_webp_round_trip(kind, shape):
    image = picture(kind, *shape)
    palette = [webp.Options(palette=True), webp.Options(palette=True, predictor=2, references=True, cache_bits=1)]
    for o in OPTIONS + (palette if kind not in ("noise", "smooth") else []):
        assert np.array_equal(webp.decode(webp.encode(image, o)), image), o


#: A lossless file that another encoder made (the one-pixel file of the format's public FAQ).
FOREIGN = "UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA=="


def test_a_file_of_another_encoder(monkeypatch):
    monkeypatch.setattr(webp_many, "FEW", 1)
    data = base64.b64decode(FOREIGN)
    image = webp.decode(data)
    assert image.shape == (1, 1, 4) and image[0, 0, 3] == 0
    assert np.array_equal(webp_many.decode_many([data])[0], image)


def test_webp_refuses_broken_files():
    good = webp.encode(picture("noise", 9, 9), webp.Options(predictor=2))
    for cut in (0, 11, 26, len(good) // 2):
        with pytest.raises(webp.BadImage):
            webp.decode(good[:cut])
    with pytest.raises(webp.BadImage):
        webp.decode(good[:20] + b"\0" + good[21:])


@given(st.binary(max_size=700))
@settings(max_examples=40, deadline=None)
def test_payload_round_trip(data):
    payload = media.pad(data)
    assert len(payload) % 192 == 0 and payload.startswith(data) and set(payload[len(data) :]) <= {32}
    assert b"".join(i.tobytes() for i in media.load_many(media.store_many([payload]))[0]) == payload


def sample_texts():
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(80)]
    prose = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(20, 400))) for _ in range(60)]
    ramp = ["".join(chr(33 + (k * step + j) % 90) for k in range(300) for j in (0, 1, 2, 3)) for step in (1, 2, 3)]
    return prose + ["ab" * 900, "a" * 3000, "x y " * 700, *ramp, "", "one", "ünï çödé 日本語 😀 " * 40]


def test_stored_payloads_have_the_features_of_the_format(monkeypatch):
    seen = Counter()
    forms, codes = webp_many.choose_forms, webp_many.write_codes

    def choose(*a):
        out = forms(*a)
        seen.update(webp_many.FORMS[k][0] for k in out.tolist())
        return out

    monkeypatch.setattr(webp_many, "choose_forms", choose)

    def write(out, lengths, alphabet, ids):
        seen["unequal"] += int(sum(len(set(r[r > 0])) > 1 for r in lengths))
        if lengths.shape[1] > 256:
            seen["references"] += int((lengths[:, 256:280] > 0).any(axis=1).sum())
            seen["cached"] += int((lengths[:, 280:] > 0).any(axis=1).sum())
        codes(out, lengths, alphabet, ids)

    monkeypatch.setattr(webp_many, "write_codes", write)
    payloads = [media.pad(t.encode()) for t in sample_texts()]
    stored = media.store_many(payloads)
    assert [b"".join(i.tobytes() for i in images) for images in media.load_many(stored)] == payloads
    assert sum(map(len, stored)) < 0.6 * sum(map(len, payloads))
    assert min(seen[k] for k in ("plain", "palette", "predictor", "unequal", "references", "cached")) > 0, seen
    assert [media.store_many([p])[0] for p in payloads] == stored  # a file depends on its payload only


@pytest.mark.parametrize("few", [1, 1000])
def test_many_images_round_trip(few, monkeypatch):
    monkeypatch.setattr(webp_many, "FEW", few)
    images = [picture(kind, *shape) for kind in ("noise", "repeats", "smooth", "1", "2", "4", "13", "200") for shape in ((1, 1), (1, 3), (7, 48), (23, 30), (300, 48))]
    files = webp_many.encode_many(images)
    assert all(np.array_equal(a, b) for a, b in zip(webp_many.decode_many(files), images))
    assert all(np.array_equal(webp.decode(f), image) for f, image in zip(files, images))
    assert webp_many.encode_many([]) == [] == webp_many.decode_many([])


def test_lanes_read_what_one_image_at_a_time_writes(monkeypatch):
    monkeypatch.setattr(webp_many, "FEW", 1)
    images = [picture(kind, 12, 20, seed) for seed, kind in enumerate(["noise", "repeats", "smooth", "4", "200"])]
    files = [webp.encode(image, o) for image in images for o in OPTIONS]
    want = [image for image in images for _ in OPTIONS]
    assert all(np.array_equal(a, b) for a, b in zip(webp_many.decode_many(files), want))
    good = webp.encode(picture("noise", 9, 9), webp.Options(cache_bits=3))
    for cut in (11, 26, len(good) // 2):
        with pytest.raises(webp.BadImage):
            webp_many.decode_many([good[:cut]])


@given(st.lists(st.lists(st.integers(0, 50), min_size=40, max_size=40), min_size=1, max_size=8))
@settings(max_examples=60, deadline=None)
def test_codes_of_many_rows(rows):
    counts = np.array(rows)
    lengths = webp_many.lengths_many(counts, 7)
    assert (lengths == np.stack([webp.code_lengths(c, 7) for c in counts])).all()
    for own in lengths:
        used = own[own > 0]
        assert len(used) < 2 or sum(2.0 ** -n for n in used.tolist()) == 1


def test_payload_of_many_images(monkeypatch):
    monkeypatch.setattr(media, "ROWS", 3)
    payload = media.pad(b"long text " * 300)
    images = media.load_many(media.store_many([payload, payload]))
    assert [len(x) for x in images] == [6, 6] and b"".join(i.tobytes() for i in images[0]) == payload


def test_media_of_documents(spark, docs, rows, empty):
    out = media.store_texts(docs.withColumn("media", F.lit(1)), with_media=True)
    got = out.collect()
    assert len(got) == len(rows)
    want = {}
    for r in rows:
        raw = (r[1] or "").encode()
        want.setdefault(r[0], set()).add((len(raw), hashlib.sha256(media.pad(raw)).hexdigest(), zlib.crc32(media.pad(raw)[-16:])))
    assert all((r.n_bytes, r.payload_sha256, r.tail_crc32) in want[r.doc_id] for r in got)
    assert all(len(r.media) == r.media_bytes and hashlib.sha256(r.media).hexdigest() == r.media_sha256 for r in got)
    by_text = {}
    for r in got:
        assert by_text.setdefault(r.payload_sha256, (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)
    pixels = media.decode_media(out, "doc_id", "media").where("frame = 0").collect()
    assert len(pixels) == len(rows) and all(len(p.pixels) == 4 * p.width * p.height for p in pixels)
    bad = spark.createDataFrame([(1, bytearray(b"junk")), (2, None)], "id long, m binary")
    assert [(r.doc_id, r.frame) for r in media.decode_media(bad, "id", "m").collect()] == [(1, -1)]
    assert media.store_texts(empty).count() == 0


# ---------------------------------------------------------------- sharding


def test_table_is_filled_by_turns():
    table = sharding.fill_table(SHARDS, 4099)
    counts = np.bincount(table)
    assert len(counts) == len(SHARDS) and counts.max() - counts.min() <= 1
    fewer = sharding.fill_table(SHARDS[:-1], 4099)
    moved = sum(a != b for a, b in zip(table, fewer) if a != len(SHARDS) - 1)
    assert moved < 0.1 * 4099
    assert sharding.fill_table(["a"], 5) == [0] * 5
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.fill_table(bad, 7)
    with pytest.raises(ValueError):
        sharding.fill_table(["a"], 8)


def test_shards_of_rows(spark, docs, rows, empty):
    odd = docs.withColumn("slot", F.lit("mine"))
    got = sharding.assign_shards(odd, SHARDS).collect()
    table = sharding.fill_table(SHARDS)
    assert len(got) == len(rows)
    for r in got:
        key = hashlib.md5(("null" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()
        assert r.slot == int(key[:15], 16) % sharding.SLOTS and r.shard == table[r.slot]
    assert sharding.assign_shards(empty, SHARDS).count() == 0
    plan = sharding.assign_shards(docs, SHARDS)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Python" not in plan and "SortMergeJoin" not in plan


# ---------------------------------------------------------------- chat

pieces = st.text(alphabet="a\\<|>s/[]INST \n", max_size=25) | st.sampled_from([*chat.CONTROL, "<|end|>\n", "\\<|", "<\\|"])


@given(st.lists(st.tuples(pieces, pieces), max_size=6))
@settings(max_examples=150, deadline=None)
def test_chat_round_trip(turns):
    text, spans = chat.locate(chat.render, turns)
    assert text == chat.render(turns) and chat.read_back(text) == turns
    assert [chat.unescape(text[s.text_start : s.text_end]) for s in spans] == [t for _, t in turns]
    assert [(s.start, s.end) for s in spans] == list(zip([0, *[s.end for s in spans]], [s.end for s in spans]))


@given(st.lists(pieces, max_size=6).map("".join))
@settings(max_examples=300, deadline=None)
def test_no_control_string_is_left_in_escaped_text(text):
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text and not any(c in escaped for c in chat.CONTROL)


def test_a_template_that_rewrites_history_spoils_its_conversation_only(spark):
    df = spark.createDataFrame([(c, t, "user" if t % 2 else "assistant", f"text {t}") for c in (1, 2) for t in range(c * 2)], "conv_id long, turn long, role string, text string")

    def template(turns):
        return chat.render(turns if len(turns) < 3 else turns[1:])

    got = {r.conv_id: r for r in chat.format_chats(df, with_output=True, template=template).collect()}
    assert got[1].error is None and got[1].n_turns == 2 and got[2].error and got[2].n_turns is None and got[2].formatted is None


def test_black_boxes():
    turns = [("user", "hello"), ("assistant", "hi"), ("user", "so")]
    with_tail = lambda ts: "BEGIN" + "".join(f"[{r}]{t};" for r, t in ts) + "END"
    text, spans = chat.locate(with_tail, turns)
    assert [text[s.text_start : s.text_end] for s in spans] == ["hello", "hi", "so"]
    rewriting = lambda ts: "".join(f"[{r}]{t if i + 1 == len(ts) else t[:1]};" for i, (r, t) in enumerate(ts))
    with pytest.raises(chat.RewritesHistory):
        chat.locate(rewriting, turns)
    counting = lambda ts: f"{len(ts)} turns" + "".join(t for _, t in ts)
    with pytest.raises(chat.RewritesHistory):
        chat.locate(counting, turns)


def test_conversations(spark):
    rows = [*chat.PLANTED, (1, 0, "system", None), (1, 1, "user", "q"), (1, 2, "assistant", "é\\<|end|>"), (1, None, "assistant", "last"), (1, 2, "assistant", "é\\<|end|>"),
            (2, 0, None, ""), (None, 1, "user", "x"), (9007199254740993, 0, "assistant", "big")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1)).repartition(3)
    got = {r.conv_id: r for r in chat.format_chats(df, with_output=True).collect()}
    order = lambda c: sorted([r for r in rows if r[0] == c], key=lambda r: (r[1] is None, r[1] or 0, r[2] or "", r[3] or ""))
    assert set(got) == {-7, 1, 2, None, 9007199254740993}
    for c, r in got.items():
        turns = [(x[2] or "", x[3] or "") for x in order(c)]
        said = "".join(t for role, t in turns if role == "assistant")
        assert r.n_turns == len(turns) and r.formatted == chat.render(turns) and r.formatted_chars == len(r.formatted)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
        assert "".join(chat.unescape(r.formatted[s.start : s.end]) for s in r.loss_spans) == said
    assert chat.format_chats(df.where("false")).count() == 0
