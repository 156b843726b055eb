"""Edge cases, brute force and round trips for the operators; see test_token_counts.py for the third."""

import hashlib
import math
import os
import pickle
import re
import tracemalloc
import zlib
from collections import Counter
from itertools import chain

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fathom.llm import chat, common, components, fingerprints, language, language_model, media, mixing, neardup, packing, registry, toxicity
from tests.llm.conftest import ODD, frame

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = st.lists(st.text(alphabet="ab é\n🎉日.<>[]/|␛s_INST", max_size=40), min_size=1, max_size=5)


def rounded(rows):
    return sorted(([round(v, 6) if isinstance(v, float) else v for v in r] for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    found = registry.queries()[name](spark, SF)
    told = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in told.description]
    assert sorted(names) == sorted(found.columns)
    assert rounded(found.select(*names).collect()) == rounded(told.fetchall())


# 1 chat


@given(TEXTS)
@settings(max_examples=80, deadline=None)
def test_escapes_are_undone(texts):
    turns = [("user\n" if i % 2 else "assistant", t) for i, t in enumerate(texts)]
    assert chat.read_turns("".join(chat.turn(r, t) for r, t in turns)) == turns
    for t in texts:
        assert not any(c in chat.escape(t) for c in chat.CONTROL) and chat.unescape(chat.escape(t)) == t


def test_chat_edges(spark):
    rows = [(1, 0, "user", "hi", 1), (1, 1, "assistant", None, 1), (1, 1, "assistant", "b </s>", 1), (None, None, None, None, 0), (2, 5, "user", "x" * 300_000, 2), (3, None, "assistant", "ok", 2), (3, None, "assistant", "ok", 2)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, loss_start int")
    made = chat.examples(df)
    for r in made.where("example is not null").collect():
        assert chat.read_turns(r.text)[-1] == ("assistant", chat.unescape(r.text[r.loss_start : r.loss_end]))
    got = {r.conv_id: r for r in chat.digests(made).collect()}
    assert {k: (r.n_turns, r.n_examples, r.loss_chars) for k, r in got.items()} == {1: (3, 2, 6), None: (1, 0, 0), 2: (1, 0, 0), 3: (2, 2, 4)}
    assert got[3].loss_sha256 == hashlib.sha256(b"okok").hexdigest()
    assert chat.examples(df.limit(0)).count() == 0


# 2 media


def test_media_round_trip(odd, empty):
    got = media.describe(media.to_pcm(media.to_media(odd))).collect()
    assert len(got) == len(ODD)
    want = Counter()
    for doc, text, *_ in ODD:
        raw = (text or "").encode()
        payload = media.padded(raw)
        assert len(payload) % 64 == 0 and payload and payload[: len(raw)] == raw
        want[(doc, len(raw), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    assert media.describe(media.to_pcm(media.to_media(empty))).count() == 0
    for r in media.to_pcm(media.to_media(odd)).collect():
        assert r.pcm == slow_pcm(r.media)
        own = np.frombuffer(r.pcm, "<i2").astype(int)
        told = next(x.feature for x in got if x.doc_id == r.doc_id and x.media_sha256 == hashlib.sha256(r.media).hexdigest())
        turns = int((np.diff(own < 0) != 0).sum())
        assert told.split(";", 1)[1] == f"rate=16000;n={len(own)};energy={int((own**2).sum()) // len(own)};peak={abs(own).max()};turns={turns}"


def slow_pcm(stored):
    """Sample by sample: decode, then halve the step by linear interpolation."""
    s = media.sound(stored)
    pcm = []
    if s.codec == "ima_adpcm":
        for at in range(0, len(s.data), s.align):
            block = bytes(s.data[at : at + s.align])
            value, index = int.from_bytes(block[:2], "little", signed=True), block[2]
            pcm.append(value)
            for code in (c for byte in block[4:] for c in (byte & 15, byte >> 4)):
                step = int(media.STEPS[index])
                change = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
                value = max(-32768, min(32767, value - change if code & 8 else value + change))
                index = max(0, min(88, index + int(media.SHIFT[code])))
                pcm.append(value)
    else:
        pcm = [int(media.TABLES[s.codec][b]) for b in s.data]
    out = [x for a, b in zip(pcm, [*pcm[1:], pcm[-1]], strict=True) for x in (a, (a + b) >> 1)]
    return np.array(out, "<i2").tobytes()


def test_damaged_and_foreign_media(spark):
    payload = media.padded(b"some text" * 30)
    law, adpcm = media.wav(payload, "mulaw"), media.wav(payload, "ima_adpcm")
    stereo = bytearray(law)
    stereo[22:24], stereo[24:28] = (2).to_bytes(2, "little"), (44_100).to_bytes(4, "little")
    double = bytearray(adpcm)
    double[22:24] = (2).to_bytes(2, "little")
    bad = {1: None, 2: b"", 3: b"RIFF", 4: law[:-7], 5: adpcm[:-9], 6: bytes(double), 7: law[:20] + b"\x63\0" + law[22:], 8: law[:30]}
    files = [*bad.items(), (20, bytes(stereo)), (21, law), (22, adpcm)]
    df = spark.createDataFrame([(k, bytearray(v) if v is not None else None) for k, v in files], "doc_id int, media binary")
    got = {r.doc_id: r.pcm for r in media.to_pcm(df).collect()}
    assert all(got[k] is None for k in bad) and got[21] == slow_pcm(law) and got[22] == slow_pcm(adpcm)
    left = media.TABLES["mulaw"][np.frombuffer(payload, np.uint8)].reshape(-1, 2).astype(int).sum(1) // 2
    assert len(got[20]) // 2 == len(left) * 16_000 // 44_100 and np.frombuffer(got[20], "<i2")[0] == left[0]
    told = {r.doc_id: r for r in media.describe(media.to_pcm(df)).collect()}
    assert told[4].payload_bytes is None and told[4].media_bytes == len(law) - 7 and told[1].media_bytes is None
    assert told[22].payload_sha256 == hashlib.sha256(payload).hexdigest()


def test_codecs():
    assert media.TABLES["mulaw"][[0xFF, 0x00, 0x80]].tolist() == [0, -32124, 32124]
    assert media.TABLES["alaw"][[0xD5, 0x2A, 0xAA]].tolist() == [8, -32256, 32256]
    payload = media.padded(np.random.default_rng(1).bytes(1000))
    for codec in media.CODECS:
        got = media.sound(media.wav(payload, codec))
        assert got.codec == codec and got.rate == media.RATE and media.payload_of(got) == payload
    blocks = np.random.default_rng(2).integers(0, 256, (5, media.HEADER + media.UNIT), np.uint8)
    blocks[:, 2] %= 89
    for i, out in enumerate(media.decode_adpcm(blocks)):
        value, index, want = int(np.frombuffer(blocks[i, :2].tobytes(), "<i2")[0]), int(blocks[i, 2]), []
        want.append(value)
        for byte in blocks[i, 4:].tolist():
            for code in (byte & 15, byte >> 4):
                step = int(media.STEPS[index])
                change = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
                value = max(-32768, min(32767, value - change if code & 8 else value + change))
                index = max(0, min(88, index + int(media.SHIFT[code])))
                want.append(value)
        assert out.tolist() == want


# 4 language


def test_phrases_by_brute_force(monkeypatch):
    """Phrases are those of whole texts, over many blocks; also where walks never meet, as in periodic texts."""
    monkeypatch.setattr(language, "BLOCK", 16)
    samples = {"x": "abracadabra alakazam " * 4, "y": "the quick brown fox jumps " * 4, "z": "日本語の文字を 学ぶ人は 한국어 " * 5}
    model, rng = language.Languages(samples), np.random.default_rng(4)
    parts = ["abra the foxes ", "zzz 1", "quick cadabra", "a", "日本語 の文", "한국", "fox jumps the "]
    texts = ["", "--", "long " * 60, "a" * 100, "abracadabra alakazam " * 9, *("".join(rng.choice(parts, 20)) for _ in range(60)), *parts]
    want = {name: [] for name in samples}
    for text in texts:
        codes = "".join(map(chr, model.symbols(text)[0]))
        for name in samples:
            known, count, at = "".join(map(chr, model.symbol[language.fold(samples[name])])), 1, 0
            for end in range(1, len(codes) + 1):  # a phrase ends where its extension is not found
                if codes[at:end] not in known:
                    count, at = count + 1, end - 1 if codes[end - 1] in known else end
            want[name].append(count)
    names, _, rates = model.parse(texts)
    for i, text in enumerate(texts):
        if any(c.isalpha() for c in text):
            cost = [want[n][i] * model.bits[k] for k, n in enumerate(model.names)]
            assert names[i] == model.names[int(np.argmin(cost))]
            assert rates[i] == want[names[i]][i] / len(model.symbols(text)[0])
        else:
            assert names[i] == "und"


def test_letters_lie_below_the_bound():
    assert not any(chr(k).isalpha() for k in range(language._CODES, 0x110000))
    assert language.fold("Éa1 2b").tolist() == [0xE9, 0x61, 0, 0x62]


def test_every_label_is_learned(spark, monkeypatch):
    """70 languages of one script, each with a stock of words of its own."""
    rng = np.random.default_rng(2)
    stock = [["".join(map(chr, rng.integers(0x4E00, 0x4F00, 3))) for _ in range(40)] for _ in range(70)]
    rows = [(70 * j + k, "".join(rng.choice(stock[k], 30)), f"l{k}", None) for j in range(6) for k in range(70)]
    df = frame(spark, rows)
    samples = language.learn(language.training_rows(df))
    assert len(samples) == 70
    got = language.identify(df.select("doc_id", "lang", "text"), samples).collect()
    assert all(r.lang_pred == r.lang for r in got)
    monkeypatch.setattr(language, "LABELS", 69)
    with pytest.raises(ValueError):
        language.learn(df)


def test_language_edges_and_accuracy(spark, odd, empty):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    samples = language.learn(language.training_rows(d))
    got = language.identify(odd, samples).collect()
    assert len(got) == len(ODD) and {r.lang_pred for r in got if not re.search(r"[^\W\d_]", r.text or "")} == {"und"}
    assert all(0 <= r.score <= 1 for r in got)
    assert language.identify(empty, samples).count() == 0
    assert {r.lang_pred for r in language.identify(odd, {}).collect()} == {"und"}
    held = language.op4_language(spark, SF).where("held_out").join(d.where("lang is not null and length(text) > 40"), "doc_id")
    assert held.where("lang_pred = lang").count() >= 0.95 * held.count()


# 5 packing


def test_tightest_window_by_brute_force():
    r = np.random.default_rng(3)
    for size in (10, 64, 100):
        lengths = r.integers(1, size + 1, 200)
        window, offset = packing.best_fit_decreasing(lengths, size)
        room, want = [], {}
        for i in np.argsort(-lengths, kind="stable").tolist():
            fits = [x for x in room if x >= lengths[i]]
            left = min(fits) if fits else size
            if fits:
                room.remove(left)
            room.append(left - lengths[i])
            want[i] = size - left
        assert offset.tolist() == [want[i] for i in range(200)] and window.max() + 1 == len(room)


def test_packing_edges(odd, empty):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = packing.pack(odd).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    for doc, text in {d: t for d, t, *_ in ODD if d not in (None, 5)}.items():
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 2]
        parts = sorted(by_doc[doc], key=lambda r: r.start)
        assert parts[0].start == 0 and sum(p.length for p in parts) == len(ids) == parts[0].doc_tokens
        for p in parts:
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
    assert len(by_doc[5]) == 2
    windows = {}
    for r in rows:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
    assert packing.pack(empty).count() == 0


# 6 fingerprints


def test_fingerprints_by_brute_force(spark, odd, empty):
    long = [f"paragraph {i} has words" for i in range(400)]
    rows = [(10, "\n".join(long), None, None), (11, "\n".join(long[:200] + ["new"] + long[200:]), None, None), (12, "\n".join(f"other {i}" for i in range(300)), None, None), *ODD]
    df = frame(spark, rows)
    got = fingerprints.fingerprints(df).collect()
    assert len(got) == len(rows)
    cut = lambda t: {u for u in re.split(fingerprints.SENTENCES, t) if u.strip(" ")}
    jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    order = sorted(((d if d is not None else -(1 << 63), t or "") for d, t, *_ in rows), reverse=True)
    want = Counter()
    for i, (doc, text) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        k = len(text) // 3
        edited = text[: len(text) - k] + after[:k]
        near, own_next = jaccard(cut(text), cut(edited)), jaccard(cut(text), cut(after))
        want[(doc, hashlib.sha256(edited.encode()).hexdigest(), round(near, 9), round(own_next, 9))] += 1
    assert Counter((r.doc_id if r.doc_id is not None else -(1 << 63), r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == want
    assert len({r.fingerprint for r in got if r.doc_id in (1, 8)}) == 1
    assert fingerprints.fingerprints(empty).count() == 0


def test_likeness_does_not_depend_on_length(spark):
    line = " ".join(f"Sentence number {i} stands here." for i in range(300))  # one line of over 4000 characters
    near = lambda n: "\n".join(f"First of {i} is here. Second of {i} is there." for i in range(95))[:n]
    df = frame(spark, [(1, near(3950), None, None), (2, near(4010), None, None), (3, line, None, None)])
    got = {r.doc_id: r for r in fingerprints.fingerprints(df).collect()}
    assert len(near(4010)) == 4010 and 0.4 < got[3].near_edited < 0.7 and got[2].near_next > 0.9


# 7 toxicity


def test_network_gradients():
    r = np.random.default_rng(0)
    net = toxicity.Network(1)
    t, n = 5, 3
    sig = r.normal(size=(t, n, toxicity.SIGNALS)).astype(np.float32)
    word, chars = r.integers(1, 50, (t, n)), r.integers(0, 40, (t, n, toxicity.CHARS))
    mask, label = np.ones((t, n, 1), np.float32), np.array([0, 1, 1], np.float32)

    def loss():
        x = net.inputs(sig, word, chars)
        y = toxicity.squash(net.logits({d: x @ net.p[f"W{d}"] + net.p[f"b{d}"] for d in "fb"}, mask))
        return -np.mean(np.where(label, np.log(y), np.log(1 - y)))

    before = loss()
    state = {}
    for _ in range(30):
        net.learn(sig, word, chars, mask, label, state, 0.02)
    assert loss() < before / 2


def test_toxicity_edges_and_accuracy(spark, odd, empty):
    sf = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(toxicity.training_rows(d), toxicity.training_rows(labels))
    got = toxicity.score(odd, model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert toxicity.score(empty, model).count() == 0
    held = toxicity.score(d.select("doc_id", "text"), model).join(labels, "doc_id").where(common.crc_remainder(F.col("doc_id"), 4) == 2).select("score", "toxic").collect()
    good, bad = [r.score for r in held if not r.toxic], [r.score for r in held if r.toxic]
    assert np.mean([[b > g for g in good] for b in bad]) > 0.9
    nothing = toxicity.fit(d.limit(0), labels.limit(0))
    assert {r.score for r in toxicity.score(odd, nothing).collect()} == {0.0}


def test_training_holds_few_windows_at_once():
    r = np.random.default_rng(3)
    words = np.array([f"w{i}x" for i in range(3000)])
    given = [" ".join(r.choice(words, 4000)) + " vile" * (i % 2) for i in range(100)]  # 10,000 windows
    tracemalloc.start()
    try:
        toxicity.train(given, np.arange(100) % 2, epochs=1)
        assert tracemalloc.get_traced_memory()[1] < 50e6
    finally:
        tracemalloc.stop()


def test_stored_tables_have_no_marker(spark):
    out = common.stored(spark.range(5).toDF("a"))
    names = [x.lstrip(".") for x in os.listdir(out.stored_path.removeprefix("file://"))]
    assert names and all(x.startswith("part-") for x in names) and out.count() == 5
    common.discard(out)


def slow_score(model, text):
    """One window at a time, from the parameters alone; no table of words, no batches."""
    net = toxicity.Network()
    net.p = model["p"]
    forms, best = [toxicity.clean(w) for w in toxicity.split(text)], -np.inf
    sig = lambda x: 1 / (1 + np.exp(-x))
    for a in toxicity.windows(len(forms)):
        own = forms[a : a + toxicity.WINDOW] or []
        states = {}
        for d in "fb":
            h, states[d] = np.zeros(toxicity.HIDDEN), [None] * len(own)
            for t in range(len(own)) if d == "f" else reversed(range(len(own))):
                found, whole = toxicity.grams([own[t]])
                tables = [x.astype(np.float32) for x in model["tables"]]
                x = net.inputs(toxicity.signals(tables, found, whole, 1), whole % toxicity.SMALL, toxicity.characters(found, 1))[0]
                g, u = x @ net.p[f"W{d}"] + net.p[f"b{d}"], h @ net.p[f"U{d}"]
                n = toxicity.HIDDEN
                z, r = sig(g[:n] + u[:n]), sig(g[n : 2 * n] + u[n : 2 * n])
                h = (1 - z) * h + z * np.tanh(g[2 * n :] + r * u[2 * n :])
                states[d][t] = h
        both = np.array([np.r_[f, b] for f, b in zip(states["f"], states["b"], strict=True)]).reshape(len(own), 2 * toxicity.HIDDEN)
        weight = np.exp(np.tanh(both @ net.p["query"]) @ net.p["value"])
        pooled = (weight[:, None] * both).sum(0) / weight.sum() if len(own) else np.zeros(2 * toxicity.HIDDEN)
        best = max(best, pooled @ net.p["out"] + net.p["bias"][0])
    return 1 / (1 + np.exp(-np.clip(model["slope"] * best + model["shift"], -30, 30)))


def test_scores_by_a_slow_scorer_whole_and_in_parts(spark, monkeypatch):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = pickle.loads(toxicity.fit(toxicity.training_rows(d), toxicity.training_rows(labels)))
    some = [r.text or "" for r in d.orderBy("doc_id").limit(12).collect()]
    texts = ["", "one", *some[:6], " ".join(some)[:9000], " ".join(some).replace(" ", "")[:2000]]
    want = [slow_score(model, t) for t in texts]
    assert toxicity.Scorer(model).score(texts) == pytest.approx(want, rel=1e-3, abs=1e-7)
    for part in (toxicity.WINDOW, 100, 1000):
        monkeypatch.setattr(toxicity, "PART", part)
        assert toxicity.Scorer(model).score(texts) == pytest.approx(want, rel=1e-3, abs=1e-7)


def test_toxic_passages_late_in_unspaced_texts(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(toxicity.training_rows(d), toxicity.training_rows(labels))
    rows = d.join(labels, "doc_id").where("length(text) between 500 and 3000").orderBy("doc_id").select("text", "toxic").collect()
    scored = list(zip(toxicity.scorer(model).score([r.text for r in rows]), rows, strict=True))
    bad, good = max(scored, key=lambda x: x[0])[1].text, min(scored, key=lambda x: x[0])[1].text
    for mark in ("_", "/", ""):
        plain = mark.join(good.split())
        late = plain + mark + mark.join(bad.split()) + mark + plain
        a, b = toxicity.scorer(model).score([plain, late])
        assert b > (a + 0.1 if mark else 3 * a), (mark, a, b)  # words run together are seen by their inner n-grams alone
    for text in ("x" * 64, "İ" * 64, "-" * 99, "ab" * 500 + " cd " + "文字" * 300):
        pieces = [toxicity.clean(w) for w in toxicity.split(text)]
        assert all(len(x) <= toxicity.LONG for x in pieces)
        for w in re.split(r"[-\s]+", text.lower()):
            assert all(any(w[i : i + 5] in x for x in pieces) for i in range(len(w)))


# 8 language model


def test_language_model(spark, odd, empty):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    train = d.where(common.crc_remainder(d["doc_id"], 7) != 2)
    words = lambda t: WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    count, docs = Counter(), 0
    for r in train.collect():
        count.update(words(r.text))
        docs += 1
    n, v = sum(count.values()) + docs, len(count) + 1
    known_base = {}
    for df in (d, odd):
        for r in language_model.score(df, train).collect():
            known_base[(r.doc_id, r.n_tokens)] = (r.n_known, r.base_score, r.score, r.train_tokens)
    for doc, text in [*((r.doc_id, r.text) for r in d.collect()), *((x[0], x[1]) for x in ODD)]:
        own = words(text)
        base = sum(math.log10(count[w] + 1) for w in own) + math.log10(docs + 1) - (len(own) + 1) * math.log10(n + v + 1)
        known, found, score, total = known_base[(doc, len(own) + 1)]
        assert known == sum(w in count for w in own) + 1 and total == n and found == pytest.approx(base, rel=1e-9)
        assert score < 0
    assert language_model.score(empty, train).count() == 0
    assert {r.n_known for r in language_model.score(odd, d.limit(0)).collect()} == {0}


NONE = (np.zeros(0, np.uint64), np.zeros(0))


@pytest.fixture(scope="module")
def small_model():
    rng = np.random.default_rng(3)
    words = [a + b for a in "bcdfghjk" for b in ("at", "in", "op", "un", "ed", "ill")]
    texts = [" ".join(rng.choice(words, 60)) + " the cat sat on the mat and the dog ran" for _ in range(40)]
    tokens = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
    return language_model.train(texts, tokens, steps=60), tokens, texts


def test_probabilities_sum_to_one(small_model):
    model, tokens, _ = small_model
    s = language_model.Scorer(model, tokens, NONE)
    ids, end = s.v.ids(["cat"])[0], s.v.end
    streams = np.array([[end, ids[0], i] for i in range(s.v.size)]).ravel()
    both = s.log_probabilities(streams, np.full(s.v.size, 3))
    first = s.log_probabilities(np.array([end, ids[0]]), np.array([2]))[0]
    assert np.exp(both - first).sum() == pytest.approx(1, abs=1e-3)


def slow_log_probability(model, stream):
    """Each id by itself, from all of the one window that has the longest context for it; sums over all branches."""
    p, tree, d, k = model["p"], model["tree"], language_model.WIDTH, language_model.CLASSES
    starts, total = range(0, max(1, len(stream) - 1 - language_model.WINDOW + language_model.STRIDE), language_model.STRIDE), 0.0
    for at in range(len(stream) - 1):
        first = min(a for a in starts if a <= at < a + language_model.WINDOW)
        x = np.array([p["E"][model["inputs"][i]] + p["P"][j] for j, i in enumerate(stream[first : at + 1])], float)
        q, key, v = x[-1] @ p["A"][:, :d], x @ p["A"][:, d : 2 * d], x @ p["A"][:, 2 * d :]
        weight = np.exp(key @ q / d**0.5 - (key @ q / d**0.5).max())
        out = (weight / weight.sum()) @ v @ p["O"] + p["E"][model["inputs"][stream[at]]] @ p["R"]
        target = stream[at + 1]
        if not model["has"][target]:
            total += model["absent"]
            continue
        z = out[:k] + p["b"]
        total += model["present"] + z[model["cls"][target]] - np.log(np.exp(z).sum())
        for i in range(tree.start[target], tree.start[target] + tree.depth[target]):
            total -= np.log1p(np.exp(-tree.sign[i] * (out[k:] @ p["N"][tree.node[i]] + p["n"][tree.node[i]])))
    return total


def test_windows_by_a_slow_scorer(small_model):
    model, tokens, texts = small_model
    s = language_model.Scorer(model, tokens, NONE)
    given = ["", "cat", *texts[:3], " ".join(texts[:4]), "walrus zebra quartz " * 12]
    streams = [np.r_[s.v.end, np.concatenate([np.zeros(0, np.int64), *s.v.ids(t.split())]), s.v.end].astype(np.int64) for t in given]
    want = [slow_log_probability(model, x) for x in streams]
    got = s.log_probabilities(np.concatenate(streams), np.array([len(x) for x in streams]))
    assert got == pytest.approx(want, rel=1e-4)
    s.calm = s.calm_head = False
    assert s.log_probabilities(np.concatenate(streams), np.array([len(x) for x in streams])) == pytest.approx(want, rel=1e-4)


def test_steps_lower_the_loss(small_model):
    model, tokens, texts = small_model
    before = language_model.train(texts, tokens, steps=0)
    score = lambda m: language_model.Scorer(m, tokens, NONE).score(texts)[4].sum()
    assert score(model) > score(before)
    p, r = model["p"], np.random.default_rng(1)
    some = r.choice(np.flatnonzero(model["has"]), (2, language_model.WINDOW + 1))
    copy = lambda: {k: v.astype(np.float64) for k, v in p.items()}
    for name in ("N", "A", "O", "E", "P"):  # the step's direction against differences of the loss
        own, state = copy(), {}
        language_model.learn(own, model, some, state, 0.0)
        g = state[name][0] / 0.1
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        loss = []
        for move in (1e-5, -1e-5):
            moved = copy()
            moved[name][at] += move
            loss.append(language_model.learn(moved, model, some, {}, 0.0))
        assert (loss[0] - loss[1]) / 2e-5 == pytest.approx(g[at], rel=2e-2)


class Counted(np.ndarray):
    """Counts the multiply-adds of matrix products that it takes part in."""

    products = 0

    def __array_ufunc__(self, ufunc, method, *given, out=(), **more):
        bare = lambda x: x.view(np.ndarray) if isinstance(x, Counted) else x
        found = getattr(ufunc, method)(*map(bare, given), **({"out": tuple(map(bare, out))} if out else {}), **more)
        if ufunc is np.matmul:
            Counted.products += np.size(found) * given[0].shape[-1]
        return found.view(Counted) if isinstance(found, np.ndarray) else found


def test_a_step_makes_products_once_for_each_input(small_model, monkeypatch):
    """Inputs that occur often cost no products of their own; gradients are those of the loss, and what lies past a
    stream's end has none."""
    model, tokens, _ = small_model
    w, r = language_model.WINDOW, np.random.default_rng(2)
    some = r.choice(r.choice(np.flatnonzero(model["has"]), 40), (64, w + 1))
    p = {k: v.astype(np.float64).view(Counted) for k, v in model["p"].items()}
    monkeypatch.setattr(Counted, "products", 0)
    language_model.gradients(p, model, some)
    assert 0 < Counted.products < 29_000 * 64 * w  # 34,000 an id with all products made for each position
    real = np.arange(w) < np.r_[w, 1, 5, r.integers(1, w, 61)][:, None]
    other = np.where(np.c_[np.ones(64, bool), real], some, model["has"].argmin())
    p = {k: v.view(np.ndarray) for k, v in p.items()}
    g, loss, total = language_model.gradients(p, model, some, real)
    again, same, _ = language_model.gradients(p, model, other, real)
    assert same == pytest.approx(loss) and total == real.sum() and g["E"][2].sum() == real.sum()
    for name, (rows, d, times) in g.items():
        assert again[name][1] == pytest.approx(d, abs=1e-12) and np.array_equal(again[name][0], rows) and np.array_equal(again[name][2], times)
        full = np.zeros(p[name].shape)
        full[slice(None) if rows is None else rows] = d
        for _ in range(3):
            way, moved = r.normal(size=full.shape), []
            for move in (1e-5, -1e-5):
                moved.append(language_model.gradients(p | {name: p[name] + move * way}, model, some, real)[1])
            assert (moved[0] - moved[1]) / 2e-5 == pytest.approx((full * way).sum(), rel=1e-3, abs=1e-6)


def test_counts_of_every_training_text(spark, monkeypatch):
    rng = np.random.default_rng(3)
    some = lambda n: " ".join(rng.choice([a + b for a in "bcdfghjk" for b in ("at", "in", "op", "un", "ed", "ill")], n))
    rows = [(i, some(40)) for i in range(30)] + [(90, some(4000) + " walrus zebra quartz" * 20)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    tokens = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
    words = Counter(w for _, t in rows for w in language_model.lowered(t))
    every = language_model.counted(df)
    assert {bytes(r.word): r.c for r in every.collect()} == words
    tok = Tokenizer.from_str(tokens)
    want = Counter(i for _, t in rows for i in tok.encode(t, add_special_tokens=False).ids)
    got = {r.h: r.c for r in language_model.tallied(every, tokens).where(F.col("kind") == language_model.ID).groupBy("h").agg(F.sum("c").alias("c")).collect()}
    assert got == want
    monkeypatch.setattr(language_model, "SAMPLE", 5)
    text = spark.createDataFrame([(1, "walrus zebra quartz"), (2, "badger violin oxygen")], "doc_id bigint, text string")
    found = {r.doc_id: r.score for r in language_model.score(text, df).collect()}
    assert found[1] > found[2] + 1  # words of a text of over LONGEST characters alone, and of none


def test_texts_outside_the_sample_teach_order(spark, monkeypatch):
    """The order of words is learned from texts that no sample holds, and from all of a text of over LONGEST characters."""
    rng = np.random.default_rng(3)
    words = ["walrus", "zebra", "quartz", "badger", "violin", "oxygen"]
    rows = [(i, " ".join(rng.permutation(words))) for i in range(20)]
    rows += [(100, " ".join(rng.permutation(words * 2000)) + " walrus zebra quartz badger violin oxygen" * 10_000)]
    monkeypatch.setattr(language_model, "SAMPLE", 2)
    monkeypatch.setattr(language_model, "window_of", lambda text, order: F.substring(text, 1, language_model.LONGEST))
    asked = spark.createDataFrame([(1, " ".join(words * 5)), (2, " ".join(words[::-1] * 5))], "doc_id bigint, text string")
    found = {r.doc_id: r.score for r in language_model.score(asked, spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert found[1] > found[2] + 5  # the same words, so the same by counts


def test_every_id_of_every_training_text_is_in_a_step(spark, small_model, monkeypatch):
    model, tokens, texts = small_model
    rows = [(i, t) for i, t in enumerate([*texts, "", None, "cat", " ".join([*texts, *texts])])] + [(None, "the dog"), (0, texts[0])]
    df, end = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), language_model.Vocabulary(tokens).end
    tok = Tokenizer.from_str(tokens)
    streams = [[end, *tok.encode(t or "", add_special_tokens=False).ids, end] for _, t in rows]
    encoded = language_model.encoded(df, F.xxhash64(F.col("doc_id").cast("string"), "text"), "text", tokens)
    common = np.array(sorted(set(chain.from_iterable(streams)))[:5])
    near = Counter()
    for x in streams:
        for a, b in zip(x[:-1], x[1:], strict=True):
            place = lambda i: common.tolist().index(i) if i in common else 5
            near.update([b * 12 + place(a), a * 12 + 6 + place(b)])
    monkeypatch.setattr(language_model, "SHARD", 4000)
    keys, times = language_model.all_neighbours(encoded, common, end + 1)
    assert dict(zip(keys.tolist(), times.tolist(), strict=True)) == near
    n = sum(len(x) - 1 for x in streams)
    moved = [r for r in language_model.shards(encoded, model, n, end).collect() if r.name in ("A", "E")]
    assert len({r.shard for r in moved}) > 1
    assert sum(np.frombuffer(r.used)[0] for r in moved if (r.name, r.first) == ("A", 0)) == n
    met = Counter(model["inputs"][i] for x in streams for i in x[:-1])
    used = Counter()
    for r in moved:
        if r.name == "E":
            used.update({r.first + i: c for i, c in enumerate(np.frombuffer(r.used).tolist()) if c})
    assert used == met
    first = language_model.taught(encoded, model, n, end)
    again = language_model.taught(encoded.repartition(2), model, n, end)
    assert all(np.array_equal(first["p"][k], again["p"][k]) for k in model["p"])
    assert any(not np.array_equal(first["p"][k], model["p"][k]) for k in model["p"])


def test_long_streams_come_in_pieces(monkeypatch):
    """The same windows and pairs whether or not a text is longer than a pool."""
    rng, w, end = np.random.default_rng(1), language_model.WINDOW, 500
    texts = [rng.integers(0, end, n) for n in (0, 1, 3, w - 1, w, 8 * w - 2, 8 * w - 1, 8 * w, 8 * w + 1, 40 * w + 5)]
    batch = pa.RecordBatch.from_arrays([pa.array([x.astype("<u2").tobytes() for x in texts], pa.binary())], names=["ids"])

    def told():
        seen, near, most = [], Counter(), 0
        for stream, sizes in language_model.pooled([batch], end):
            some, real = language_model.windows(stream, sizes)
            seen += [tuple(x[np.r_[True, r]].tolist()) for x, r in zip(some, real, strict=True)]
            near.update(dict(zip(*(x.tolist() for x in language_model.neighbours(stream, sizes, np.arange(5), end + 1)), strict=True)))
            most = max(most, len(stream))
        return Counter(seen), near, most

    whole = told()
    monkeypatch.setattr(language_model, "POOL", 8 * w)
    cut = told()
    assert whole[:2] == cut[:2] and cut[2] < 17 * w < whole[2]
    assert sum(n * (len(x) - 1) for x, n in whole[0].items()) == sum(len(x) + 1 for x in texts)


def test_words_are_forgotten_and_met_again(small_model, monkeypatch):
    model, tokens, texts = small_model
    odd = ["Éa, œuf! naïve…", "日本 x", "a" * 300, "ABC-def's (q)", "\u2003 ß İ"]
    given = [*texts[:5], *odd, *texts[5:10], *odd]
    want = language_model.Scorer(model, tokens, NONE).score(given)
    s = language_model.Scorer(model, tokens, NONE)
    monkeypatch.setattr(language_model, "CACHED", 10)
    got = [s.score([t]) for t in given]
    for i in (0, 1, 2, 4):
        assert np.concatenate([g[i] for g in got]) == pytest.approx(want[i])
    assert all(np.array_equal(g[3][0], w) for g, w in zip(got, want[3], strict=True))
    tok = Tokenizer.from_str(tokens)
    for w in {w for t in given for w in language_model.lowered(t)}:
        assert s.v.ids([w.decode()])[0].tolist() == tok.encode(w.decode(), add_special_tokens=False).ids


def test_attention_says_more_than_the_last_id(spark):
    """Held-out texts are likelier by the model than by the base, and than by a model whose attention gathers nothing."""
    sf = "/root/testdata/sf0.01"
    d = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rest = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    train, held = [t for i, t in d if not rest(i)], [t for i, t in d if rest(i)][:60]
    tokens = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
    model = language_model.train([t[:4000] for t in train], tokens, steps=400)
    with_it = language_model.Scorer(model, tokens, NONE).score(held)[4].sum()
    blind = model | {"p": model["p"] | {"A": model["p"]["A"] * (np.arange(3 * language_model.WIDTH) < 2 * language_model.WIDTH).astype(np.float32)}}
    assert with_it > language_model.Scorer(blind, tokens, NONE).score(held)[4].sum()


# 9 mixing


def brute_mix(rows):
    size = {}
    for _, text, _, source in rows:
        size[source] = size.get(source, 0) + len(WORD.findall(text or ""))
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight, target, open_ = {s: i % 3 + 1 for i, s in enumerate(order)}, {}, set(order)
    left = sum(size.values())
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * unit > 3 * size[s]}
        if not full:
            target |= {s: weight[s] * unit for s in open_}
            break
        for s in full:
            target[s] = 3 * size[s]
            left -= target[s]
        open_ -= full
    return size, target


def test_mixing_edges(spark, odd, empty):
    rows = [*ODD, *((100 + i, "w " * (i % 40 + 1), "en", f"s{i % 7}") for i in range(700))]
    got = mixing.mix(frame(spark, rows)).collect()
    size, target = brute_mix(rows)
    key = {}
    for d, t, _, s in rows:
        key[(d, len(WORD.findall(t or "")))] = s
    taken = Counter()
    for r in got:
        s = key[(r.doc_id, r.size)]
        assert r.source_size == size[s] and r.target == pytest.approx(target[s]) and 0 <= r.copies <= 3
        taken[s] += r.size * r.copies
    for s in (f"s{i}" for i in range(7)):
        assert abs(taken[s] - target[s]) <= 60
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(frame(spark, rows)).collect()))
    assert mixing.mix(empty).count() == 0
    assert {r.copies for r in mixing.mix(odd.where("doc_id in (2, 3)")).collect()} == {0}


# 10 near-duplicates


def brute_components(rows, words, percent):
    sets = {}
    for d, t, *_ in rows:
        w = [("".join(c.lower() if "A" <= c <= "Z" else c for c in x)) for x in WORD.findall(t or "")]
        own = {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
        sets.setdefault(d, []).append(own)
    ids = [d for d in sets if d is not None]
    part = {d: d for d in ids}

    def root(d):
        while part[d] != d:
            d = part[d]
        return d

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = root(a), root(b)
                part[max(x, y)] = min(x, y)
    return {d: root(d) for d in ids}


def test_neardup_by_brute_force(spark, empty):
    r = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, n = list(ODD), 20
    for _ in range(25):
        base = r.choice(vocabulary, 120).tolist()
        for k in range(int(r.integers(1, 5))):
            own = list(base)
            for at in r.integers(0, 120, k):
                own[at] = "changed"
            rows.append((n, " ".join(own), None, None))
            n += 1
    rows += [(n + i, "Same text for all of these ones", None, None) for i in range(60)]
    for words, percent in ((3, 85), (5, 80)):
        got = neardup.near_duplicates(frame(spark, rows), words=words, percent=percent).collect()
        assert len(got) == len(rows)
        want = brute_components(rows, words, percent)
        for x in got:
            assert x.component_id == (want[x.doc_id] if x.doc_id is not None else None)
            assert x.kept == (x.doc_id is None or x.component_id == x.doc_id)
    assert neardup.near_duplicates(empty).count() == 0


def test_pigeonhole_keys_meet():
    """Two signatures that differ in RADIUS symbols share a key, wherever the errors lie."""
    r = np.random.default_rng(6)
    keys = lambda s: {(j, t, s[j * neardup.WIDTH : (j + 1) * neardup.WIDTH][:t].tobytes(), s[j * neardup.WIDTH : (j + 1) * neardup.WIDTH][t + 1 :].tobytes()) for j in range(neardup.CHUNKS) for t in range(neardup.WIDTH)}
    for _ in range(300):
        a = r.integers(0, 1 << 16, neardup.SYMBOLS).astype(np.uint16)
        b = a.copy()
        b[r.choice(neardup.SYMBOLS, neardup.RADIUS, replace=False)] ^= 1
        assert keys(a) & keys(b)


def test_distance_of_packed_signatures(spark):
    """``within`` holds at RADIUS symbols apart and not at one more, wherever and by whichever bits they differ."""
    r, rows, want = np.random.default_rng(8), [], []
    pack = lambda s: np.frombuffer(s.tobytes().ljust(8 * neardup.NUMBERS, b"\0"), np.int64).tolist()
    for i in range(200):
        a = r.integers(0, 1 << 16, neardup.SYMBOLS).astype(np.uint16)
        b, apart = a.copy(), int(r.integers(neardup.RADIUS - 2, neardup.RADIUS + 3))
        b[r.choice(neardup.SYMBOLS, apart, replace=False)] ^= (np.uint16(1) << r.integers(0, 16, apart).astype(np.uint16))
        rows.append((i, *pack(a), *pack(b)))
        want.append(apart <= neardup.RADIUS)
    names = ["i", *(f"g{k}_{x}" for x in "ab" for k in range(neardup.NUMBERS))]
    got = spark.createDataFrame(rows, ", ".join(f"{x} bigint" for x in names)).select("i", neardup.within().alias("ok")).collect()
    assert [r.ok for r in sorted(got)] == want


def test_boilerplate_shared_by_half(spark):
    """Links hidden in texts of which half share one long block: equal to brute force over all pairs."""
    r = np.random.default_rng(9)
    vocabulary, block, rows = [f"v{i}" for i in range(4000)], " ".join(f"block{i}" for i in range(60)), []
    while len(rows) < 700:
        own = r.choice(vocabulary, int(r.integers(5, 60))).tolist()
        for k in range(int(r.integers(1, 4))):
            some = list(own)
            some[int(r.integers(0, len(own)))] = f"edit{k}"
            text = " ".join(some) if len(rows) % 2 else f"{block} {' '.join(some)}"
            rows.append((len(rows), text, None, None))
    got = {x.doc_id: x.component_id for x in neardup.near_duplicates(frame(spark, rows), words=3, percent=85).collect()}
    assert got == brute_components(rows, 3, 85)


def test_pairs_in_a_large_group_of_near_copies(spark, monkeypatch):
    """Near copies whose changes few others share, many of them under the threshold from all others: components are
    those of brute force, and the pairs compared grow with the group, not with its square."""
    r, rows = np.random.default_rng(10), []
    while len(rows) < 500:
        own = [f"b{i}" for i in range(150)]
        for _ in range(int(r.integers(0, 12))):
            at = int(r.integers(0, 50)) * 3
            own[at] = f"c{at}-{r.integers(0, 20)}"
        rows.append((len(rows), " ".join(own), None, None))
    pairs, confirmed = [], neardup.confirmed
    monkeypatch.setattr(neardup, "confirmed", lambda p, *more: (pairs.append(p.count()), confirmed(p, *more))[1])
    got = {x.doc_id: x.component_id for x in neardup.near_duplicates(frame(spark, rows), words=3, percent=85).collect()}
    assert got == brute_components(rows, 3, 85)
    assert len(set(got.values())) > 100
    assert sum(pairs) < 50 * len(rows), pairs


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(0, 90)] + [(200, 201), (201, 202), (202, 200), (5, 5), (None, 3)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(91)}, 200: 200, 201: 200, 202: 200}
