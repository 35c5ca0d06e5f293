"""Operators that look at each text alone, against plain Python."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from emberline.llm import audio, bpe, packing, quality, queries, sampling, secret_scan, simhash, toxicity, vectext

os.environ["TOKENIZERS_PARALLELISM"] = "false"
ODD = ["", None, " ", "\n\n", "a", "it's 'll 've'd  x\t\n y", "é" * 40, "日本語 テキスト", "<|endoftext|> a<|endoftext|>", "x" * 5000, "word " * 3000]
CLASH = "doc_id long, text string, start string, score string, fingerprint string, spans string, media string, gone string"


def odd_documents(spark):
    return spark.createDataFrame([(k, t, "s", "t", "u", "v", "w", "x") for k, t in enumerate(ODD)] + [(None, "null id", "s", "t", "u", "v", "w", "x")] + [(4, "a", "s", "t", "u", "v", "w", "x")] * 2, CLASH)


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(queries.RANKS, queries.PATTERN, queries.TOKENIZER)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


PIECES = ["'s", "'", "t", "re", "ll", "'ll", " ", "  ", "\n", "\t", "1", "٣", "é", "ß", "A", "!", "日", " ", "😀", "'ve", "'d", "’", "_", "<|endoftext|>", "\x1c", "\x85", "²", "ſ"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(PIECES), st.text(max_size=3)), max_size=12))
def test_ids_are_those_of_the_tokenizer(encoder, tokenizer, pieces):
    text = "".join(pieces).replace("\0", "")
    data, offsets = vectext.flat(pa.array(["a b", text, "c"]))
    ids, begins = encoder.encode_texts(data, offsets, 1)
    assert ids[begins[1] : begins[2]].tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 0]


def test_packing_covers_each_id_once(spark, tokenizer):
    rows = queries.packed(odd_documents(spark)).collect()
    whole = {k: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for k, t in [*enumerate(ODD), (None, "null id")]}
    by_doc: dict = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert by_doc.keys() == whole.keys()
    for k, ids in whole.items():
        copies = 3 if k == 4 else 1
        assert sum(r.length for r in by_doc[k]) == copies * len(ids) and {r.doc_tokens for r in by_doc[k]} == {len(ids)}
        for r in by_doc[k]:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
        if copies == 1:
            at = 0
            for r in sorted(by_doc[k], key=lambda r: r.start):
                assert r.start == at
                at += r.length
    sequences: dict = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024 and at & (at - 1) == 0
    assert queries.packed(odd_documents(spark).where("false")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 63), max_size=120), st.integers(2, 40))
def test_level_rule_is_least_sum_of_squares(sizes, most_open):
    packer = packing.Packer(64, 0, most_open)
    for size in sizes:
        before = packer.level.copy()
        best = min(
            (int((moved**2).sum()), -h)
            for h in range(0, 64 - size + 1)
            if h == 0 or before[h]
            for moved in [before + np.bincount([h + size], minlength=65)[:64] - (np.bincount([h], minlength=64) if h else 0)]
        )
        assert -packer.best_level(size) == best[1]
        packer.add("d", np.arange(size, dtype=np.int32))
    packer.flush()
    done = packer.taken()
    assert sum(p[2] for p in done) == sum(sizes)
    fill: dict = {}
    for _, _, length, _, _, sequence, offset in done:
        fill.setdefault(sequence, []).append((offset, length))
    for pieces in fill.values():
        total = sum(n for _, n in pieces)
        assert total <= 64 and total & (total - 1) == 0
        assert sorted(o for o, _ in pieces) == list(np.cumsum([0, *[n for _, n in sorted(pieces)][:-1]]))


def slow_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_fingerprints(spark):
    got = simhash.fingerprints(odd_documents(spark)).collect()
    texts = {**dict(enumerate(ODD)), None: "null id"}
    assert {r.doc: r.fp & (1 << 64) - 1 for r in got} == {k: slow_fingerprint(t) for k, t in texts.items()}
    long = "q " * 130_000 + "end of it"
    assert int(simhash._text_fingerprints([long.encode()])[0]) == slow_fingerprint(long)


SECRETS = [
    'PassWord="hunter2hunter" and api-key: x, api_key = "abcdef12"', "token:short", "secret=abcdef token=secret=zzzzzz", "AKIA" + "A1" * 8, "AKIAAKIA" + "B" * 11, "xAKIA" + "C" * 16,
    "f" * 23 + " " + "0" * 24 + "g" + "ab" * 20, "é password: ſecret passwd='0123456'", "key q8Zr2LxV9mKp4TnWb7YdJ5sHf3Gc1", "d41d8cd98f00b204e9800998ecf8427e", "123e4567-e89b-12d3-a456-426614174000",
    "a-long-but-plain-sentence-with-2-dashes", "1234567890123456789012345",
]


def slow_base(text):
    out = []
    for m in re.finditer(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        out += [(m.start(), "assign", m.end())] * (len(m[2]) >= 6)
    out += [(m.start(), "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return out


def test_training_texts_are_whole(spark):
    texts = ["plain words " * 2500 + f"passage {k}" for k in range(8)]
    documents = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(8)], "doc_id long, toxic int")
    got = sampling.labelled(documents, labels, "toxic", 1, -1, 8, 40_000)
    assert dict(zip(got["doc"].to_pylist(), got["text"].to_pylist())) == dict(enumerate(texts))
    few = sampling.labelled(documents, labels, "toxic", 1, -1, 8, 10_000)
    assert few.num_rows == 2 and set(few["text"].to_pylist()) <= set(texts) and set(few["y"].to_pylist()) == {0, 1}
    assert sampling.labelled(documents, labels.where("false"), "toxic", 1, -1, 8).num_rows == 0


def test_random_parts_of_runs():
    rng = random.Random(3)
    scanner = secret_scan._scanner(queries.RANKS, queries.PATTERN, 2.0, frozenset(secret_scan.NOTHING))
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    for before in ("/internal/production/configuration/service/credentials/", "deployment_authorization_credential="):
        for n in (24, 40):
            found = 0
            for _ in range(100):
                text = f"see {before}{''.join(rng.choice(letters) for _ in range(n))} for it"
                ends = [s for s in scanner.spans(text) if s[1] == "random" and s[2] == len(text) - 7]
                found += bool(ends) and ends[0][0] in (4, len(before) + 4)
            assert found >= 90, (before, n, found)
    for text in ("/internal/production/configuration2/service/credentials/", "/objects/da39a3ee5e6b4b0d3255bfef95601890afd80709/internal/configuration"):
        assert not [s for s in scanner.spans(text) if s[1] == "random"]


def test_precision_and_recall_of_random_spans():
    """Planted random strings of several alphabets, among words, names, paths, identifiers and digests that are known or called so."""
    rng = random.Random(8)
    scanner = secret_scan._scanner(queries.RANKS, queries.PATTERN, 2.0, frozenset(secret_scan.NOTHING))
    syllables = ["an", "th", "er", "schaf", "heit", "lich", "que", "eau", "tion", "ing", "ver", "ouan"]
    names = ["getResponseCodeFromServerConnection", "MAX_CONNECTIONS_PER_HOST_AND_USER", "/usr/share/documentation/packages/readme", "internationalization-and-localization", "test_case_variant_number_two"]
    hexed = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    found = wrong = clean = 0
    kinds = ("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789abcdef", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/")
    for k in range(400):
        secret = "".join(rng.choice(kinds[k % 4]) for _ in range(rng.choice((24, 32, 40, 64))))
        others = ["".join(rng.choice(syllables) for _ in range(9)), rng.choice(names), rng.choice(secret_scan.NOTHING), f"sha256: {hexed(64)}", f"commit {hexed(40)}", f"{hexed(8)}-{hexed(4)}-{hexed(4)}-{hexed(4)}-{hexed(12)}", str(rng.getrandbits(90))]
        rng.shuffle(others)
        text = " ".join([*others[:4], f"value {secret} and", *others[4:]])
        at = text.index(secret)
        spans = [s for s in scanner.spans(text) if s[1] == "random"]
        hit = [s for s in spans if s[0] < at + len(secret) and s[2] > at]
        found += bool(hit)
        wrong += len(spans) - len(hit)
        clean += len(others)
    assert found >= 380 and wrong <= 0.002 * clean, (found, wrong, clean)


def test_random_strings_of_the_tables_are_found(spark):
    """The ratio decides on the tables' own random strings, which look like digests but are called tokens."""
    rows = spark.createDataFrame([(1, 'erti token = "cb1a9fee807a05366fcb8b6c95c7c565ede51a72" the'), (2, "neinerheit\u00fc einschachch\u00df chpfheitschverheiten den"), (3, "le les queelleaiierelletion la")], "doc_id long, text string")
    got = {r.doc_id: [(s.start, s.kind) for s in r.spans] for r in secret_scan.scan(rows, queries.RANKS, queries.PATTERN).collect()}
    assert (14, "random") in got[1] and not got[2] and not got[3]


def test_secret_spans(spark):
    texts = SECRETS + [t for t in ODD]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: [(s.start, s.kind, s.end) for s in r.spans] for r in secret_scan.scan(rows, queries.RANKS, queries.PATTERN).collect()}
    for k, t in enumerate(texts):
        assert sorted(s for s in got[k] if s[1] != "random") == sorted(slow_base(t or "")), t
    assert [s[1] for s in got[8]] == ["random"]
    assert not [s for k in (9, 10, 11, 12) for s in got[k] if s[1] == "random"]
    known = secret_scan.scan(rows.where("doc_id = 8"), queries.RANKS, queries.PATTERN, known_digests=("Q8ZR2lxv9mkp4tnwb7ydj5shf3gc1",)).first()
    assert known.spans == []


def test_audio_round_trip_and_features(spark):
    media = audio.audio(odd_documents(spark))
    rows = {r.doc_id: r for r in audio.digests(media).collect()}
    raw = {r.doc_id: bytes(r.payload) for r in audio.readings(media).collect()}
    for k, t in [*enumerate(ODD), (None, "null id")]:
        text = (t or "").encode()
        payload = text + b"\xff" * (max(576, -(-len(text) // 576) * 576) - len(text))
        assert raw[k] == payload and rows[k].payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert rows[k].n_bytes == len(text) and rows[k].payload_bytes == len(payload) and rows[k].tail_crc32 == zlib.crc32(payload[-32:])
        stored = audio.to_wav(payload)
        assert rows[k].media_bytes == len(stored) and rows[k].media_sha256 == hashlib.sha256(stored).hexdigest()
    assert rows[0].feature == rows[1].feature != rows[9].feature
    tensors = audio.to_tensors(media.select("patches").toArrow().column(0))
    assert tensors.schema.field("log_mel").type == pa.fixed_shape_tensor(pa.float32(), (audio.PATCH, audio.MELS), dim_names=("frame", "mel"))
    assert tensors.num_rows >= len(ODD) and audio.audio(odd_documents(spark).where("false")).count() == 0


def test_resampling_keeps_a_tone():
    t = np.arange(16000) / 16000
    out = audio.resample(np.sin(2 * np.pi * 440 * t).astype(np.float32))
    assert len(out) == 12000
    spectrum = np.abs(np.fft.rfft(out[1000:11000] * np.hanning(10000)))
    assert abs(spectrum.argmax() * 12000 / 10000 - 440) < 2 and abs(np.abs(out[2000:10000]).max() - 1) < 0.05
    high = audio.resample(np.sin(2 * np.pi * 7500 * t).astype(np.float32))
    assert np.abs(high[2000:10000]).max() < 0.05


def test_stretches_are_resampled_like_the_whole(monkeypatch):
    stored = audio.to_wav(np.random.default_rng(0).integers(0, 256, 40_000, np.uint8).tobytes())
    whole = audio.features(stored)
    monkeypatch.setattr(audio, "STRETCH", 4_096)
    cut = audio.features(stored)
    assert whole["frames"] == cut["frames"] and np.allclose(whole["patches"][1]["log_mel"], cut["patches"][1]["log_mel"], atol=1e-5)


def test_hysteresis():
    level = np.array([0, 0, 0, 1, 2, 1, 0, 1, 0, 3, 0.6, 0.4, 0, 0, 0])
    assert audio.segments(level) == [(4, 6), (9, 11)]


def corpus(n=400, seed=0):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    out = []
    for k in range(n):
        lines = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 20))).capitalize() + "." for _ in range(rng.randint(1, 6))]
        bad, toxic = k % 4 == 0, k % 5 == 0
        if bad:
            lines = [x.upper().replace(" ", "!! ") for x in lines] if k % 8 else [" ".join([x.split()[0]] * 30) for x in lines]
        if toxic:
            lines[0] = lines[0].replace(" ", f" {rng.choice(['grumblo', 'snarkil', 'vexatu'])} ", 1)
        out.append((k, "\n".join(lines), rng.choice(["en", "de"]), int(not bad), int(toxic)))
    return out


@pytest.fixture(scope="module")
def labelled(spark):
    rows = spark.createDataFrame(corpus(), "doc_id long, text string, lang string, quality int, toxic int")
    return rows.select("doc_id", "text", "lang").cache(), rows.select("doc_id", "quality", "toxic").cache()


def test_quality_on_held_out_documents(spark, labelled):
    documents, labels = labelled
    chain = quality.fit(documents, labels)
    rows = quality.score(documents, chain).join(labels, "doc_id").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(r.held_out == (r in held) for r in rows) and len(held) > 40
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.95
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    kept = {r.doc_id for r in quality.keep(documents, chain).collect()}
    assert kept == {r.doc_id for r in rows if r.predicted}
    odd = quality.score(odd_documents(spark).drop("score"), chain).collect()
    assert len(odd) == len(ODD) + 3 and all(0 <= r.score <= 1 for r in odd)
    assert quality.score(documents.where("false"), chain).count() == 0


def test_marginals_match_enumeration():
    rng = np.random.default_rng(1)
    score, pair = rng.normal(size=(7, 2)), rng.normal(size=(2, 2))
    begin, count = np.array([0, 4, 5]), np.array([4, 1, 2])
    p, pairs = quality.marginals(score, pair, begin, count)
    want, joint = np.zeros(7), np.zeros((2, 2))
    for b, n in zip(begin, count, strict=True):
        weights = {}
        for k in range(2**n):
            y = [k >> i & 1 for i in range(n)]
            weights[tuple(y)] = np.exp(sum(score[b + i, y[i]] for i in range(n)) + sum(pair[y[i], y[i + 1]] for i in range(n - 1)))
        total = sum(weights.values())
        for y, w in weights.items():
            for i in range(n):
                want[b + i] += w / total * y[i]
            for i in range(n - 1):
                joint[y[i], y[i + 1]] += w / total
    assert np.allclose(p, want) and np.allclose(pairs, joint)


def test_line_features_do_not_depend_on_the_batch():
    texts = ["a b\nc!! D", "", "x " * 50, "\n", "é ü\n\nlast"]
    whole = vectext.flat(pa.array(texts))
    starts, ends, owner = quality.lines(*whole)
    assert owner.tolist() == [0, 0, 1, 2, 3, 3, 4, 4, 4]
    together = quality.line_features(whole[0], starts, ends)
    at = 0
    for t in texts:
        one = vectext.flat(pa.array([t]))
        s, e, _ = quality.lines(*one)
        alone = quality.line_features(one[0], s, e)
        assert np.allclose(together[at : at + len(alone)], alone)
        at += len(alone)


def test_toxicity_on_held_out_documents(spark, labelled):
    documents, labels = labelled
    net = toxicity.fit(documents, labels)
    rows = toxicity.score(documents, net).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    assert sum(r.predicted == r.toxic for r in held) / len(held) > 0.93
    odd = toxicity.score(odd_documents(spark).drop("score"), net, lang_column=None).collect()
    assert len(odd) == len(ODD) + 3 and {r.score for r in odd if r.doc_id in (0, 1)} == {net.scores(*vectext.flat(pa.array([""])))[0]}


def test_long_texts_score_like_short_ones_joined():
    data = corpus(120, 3)
    net = toxicity.train(pa.array([r[1] for r in data]), np.array([r[4] for r in data]), epochs=2, least_steps=20)
    long = "plain words here " * 60_000
    assert net.scores(*vectext.flat(pa.array([long + "grumblo"])))[0] == pytest.approx(net.scores(*vectext.flat(pa.array(["plain words here " * 3 + "grumblo"])))[0], abs=1e-5)


def test_training_with_one_label(spark):
    assert quality.train(pa.array(["a", "b"]), np.array([1, 1])).scores(*vectext.flat(pa.array(["x"])))[0] > 0.9
    assert toxicity.train(pa.array(["a"]), np.array([0])).scores(*vectext.flat(pa.array(["x"])))[0] < 0.1
    documents = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.score(documents, quality.fit(documents, labels)).count() == 0
    assert toxicity.score(documents, toxicity.fit(documents, labels)).select(F.count("*")).first()[0] == 0
