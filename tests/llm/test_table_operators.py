"""Operators over whole tables, against brute force."""

import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from emberline.llm import ann, chat, line_dedup, mixing, queries, simhash
from emberline.operators.components import connected
from tests.llm.test_text_operators import slow_fingerprint

ROLES = ["system", "user", "assistant", None, "to\\ol\n</s>"]
BITS = ["</s>", "[INST]", "<s>", "\\", "<", "/", "s>", "<<SYS>>", "[/INST]", "INST]", "\n", "hello ", "é", "", "[", "</\\s>", "<\\\\s>"]


def talks(seed=1, n=60):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(1, 14)):
            role = "system" if turn == 0 and rng.random() < 0.5 else rng.choice(ROLES)
            text = None if rng.random() < 0.05 else "".join(rng.choice(BITS) for _ in range(rng.randint(0, 60)))
            rows.append((conv, turn, role, text))
    return rows + [(None, 0, "user", "x"), (3, 0, "user", "again"), (3, 0, "user", "again")]


def test_chat_round_trip_and_budget(spark):
    rows = talks()
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit(1))
    made = chat.windows(frame, 120, 40).cache()
    got = {r.conv: r for r in chat.read_back(made).collect()}
    order = lambda r: ((r[1] is not None, r[1] or 0), r[2] or "", r[3] or "")
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=order)
        assert [(t.role, t.text) for t in got[conv].turns] == [(r[2] or "", r[3] or "") for r in turns]
        assert list(got[conv].targets) == [r[3] or "" for r in turns if r[2] == "assistant"]
    many = False
    for w in made.collect():
        parts = w.text.split("</s>\n")[:-1]
        many |= w.window > 0
        system = got[w.conv].turns[0].role == "system"
        if system:
            assert parts[0].startswith("<s>system\n")
        assert w.tokens <= 120 or len(parts) - max(w.repeated, int(system)) <= 1
        if w.window:
            assert w.repeated >= int(system)
        assert all(0 <= s.start <= s.end <= len(w.text) for s in w.loss)
    assert many and chat.windows(frame.where("false")).count() == 0


def test_escape_is_reversible_and_hides_controls(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 12))) for _ in range(2000)]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    for r in frame.select("t", "e", chat.unescape(F.col("e")).alias("b")).collect():
        assert r.b == r.t
        assert not any(c in r.e for c in ("</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"))


def test_forest_finds_the_nearest(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(700, 24)) * rng.uniform(0.5, 2, size=(700, 1))
    x[40:60] = x[7]
    rows = [(k, [float(v) for v in x[k]]) for k in range(700)]
    bad = [(700, None), (701, [0.0] * 24), (702, [float("nan")] * 24), (703, [None] * 24), (None, rows[1][1]), (704, [1.0] * 3), (720, [float("inf")] * 24)]
    frame = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    got = {}
    for r in ann.search(frame).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert got.keys() == {k for k in range(0, 700, 20)}
    hits = 0
    for q, found in got.items():
        exact = sorted(((-float((x[k] * x[q]).sum()), k) for k in range(700) if k != q))[:20]
        found = sorted(found)
        assert [f[0] for f in found] == list(range(1, 21))
        assert [(-f[2], f[1]) for f in found] == sorted((-f[2], f[1]) for f in found)
        for _, k, s in found:
            assert s == pytest.approx(float((x[k] * x[q]).sum()), abs=1e-9)
        hits += len({k for _, k in exact} & {f[1] for f in found})
    assert hits / (20 * len(got)) > 0.9
    few = ann.search(frame.where("vec_id < 5"))
    assert few.count() == 4 and ann.search(frame.where("false")).count() == 0


def test_forest_scores_a_falling_share_of_larger_shards():
    """Independent dimensions, where hashes tell least: recall stays over 0.9 while the share of the rows that is scored falls."""
    rng = np.random.default_rng(4)
    shares = []
    for n in (3000, 50_000):
        x = rng.normal(size=(n, 64))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        forest, asked = ann.Forest(np.arange(n), x, np.zeros(n)), np.arange(0, n, n // 60)
        exact = x[asked] @ x.T
        exact[np.arange(len(asked)), asked] = -9
        query, found, score = forest.best(x[asked], asked, 20, ann.ENTRIES)
        hits = sum(len(set(found[query == q]) & set(np.argsort(-exact[k])[:20])) for k, q in enumerate(asked))
        assert hits >= 0.9 * 20 * len(asked) and np.allclose(score, (x[query] * x[found]).sum(axis=1))
        shares.append(np.mean([len(m) for m in forest.candidates(x[asked], ann.ENTRIES)]) / n)
    assert shares[1] < 0.25 < shares[0]


def test_shards_and_blocks_find_the_same(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 16))
    frame = spark.createDataFrame([(k, [float(v) for v in x[k]]) for k in range(900)], "vec_id long, embedding array<double>")
    want = {(k, r, int(c)) for k in range(0, 900, 20) for r, c in enumerate([c for c in np.argsort(-(x[k] @ x.T), kind="stable") if c != k][:20], 1)}
    monkeypatch.setattr(ann, "SHARD_ROWS", 200)
    monkeypatch.setattr(ann, "BLOCK_ROWS", 10)
    got = {(r.query_id, r.rank, r.vec_id) for r in ann.search(frame, entries=1 << 30).collect()}
    assert got == want


def near_texts(seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    out = []
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(3, 150))]
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):
            edit = list(base)
            edit[rng.randrange(len(edit))] = rng.choice(words)
            out.append(" ".join(edit))
    return [*out, out[0], out[0].upper(), "", None, "   ", "one two"]


def closure(n, linked):
    group = list(range(n))
    for a, b in linked:
        i, j = sorted((group[a], group[b]))
        group = [i if g == j else g for g in group]
    return group


@pytest.mark.parametrize("longest", [4096, 3])
def test_near_duplicates_match_all_pairs(spark, longest):
    texts = near_texts()
    rows = [(k, t) for k, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    fp = [slow_fingerprint(t) for t in texts]
    want = closure(len(texts), [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if (fp[a] ^ fp[b]).bit_count() <= 3])
    prints = simhash.fingerprints(frame)
    got = {r.doc: r.component for r in prints.join(simhash.classes(prints, 3, longest), "fp").collect()}
    assert [got[k] for k in range(len(texts))] == want
    if longest == 4096:
        rows = {r.doc_id: r for r in simhash.near_duplicates(frame).collect()}
        assert all(rows[k].fingerprint == f"{fp[k]:016x}" and rows[k].component_id == want[k] for k in rows)
        assert {r.doc_id for r in simhash.keep_one(frame.withColumn("fingerprint", F.lit(1))).collect()} == set(want)
        assert simhash.near_duplicates(frame.where("false")).count() == 0


def test_random_fingerprints_with_planted_links(spark):
    rng = random.Random(9)
    fp = [rng.getrandbits(64) for _ in range(300)]
    fp += [f ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))) for f in fp[:200]]
    signed = [(k, f - (1 << 64) if f >> 63 else f) for k, f in enumerate(fp)]
    want = closure(len(fp), [(a, b) for a, b in itertools.combinations(range(len(fp)), 2) if (fp[a] ^ fp[b]).bit_count() <= 3])
    prints = spark.createDataFrame(signed, "doc long, fp long")
    for longest in (4096, 1):
        got = {r.doc: r.component for r in prints.join(simhash.classes(prints, 3, longest), "fp").collect()}
        assert [got[k] for k in range(len(fp))] == want


def slow_set(line):
    line = line.lower()
    return {line[k : k + 5] for k in range(max(1, len(line) - 4))}


def alike(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def slow_lines(docs):
    """(doc, text, number of lines, number dropped) by all pairs of distinct lines."""
    lines = [(d, p, x) for d, t in docs for p, x in enumerate((t or "").split("\n")) if x.strip(" ")]
    distinct = sorted({x for _, _, x in lines})
    sets = [slow_set(x) for x in distinct]
    want = dict(zip(distinct, closure(len(distinct), [(a, b) for a, b in itertools.combinations(range(len(distinct)), 2) if alike(sets[a], sets[b])]), strict=True))
    first: dict = {}
    for d, p, x in sorted(set(lines), key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2])):
        first.setdefault(want[x], (d, p))
    out = []
    for d, t in docs:
        parts = None if t is None else t.split("\n")
        kept = None if t is None else [x for p, x in enumerate(parts) if not x.strip(" ") or first[want[x]] == (d, p)]
        out.append((d, None if t is None else "\n".join(kept), len(parts or []), len(parts or []) - len(kept or [])))
    return sorted(out, key=str)


@pytest.mark.parametrize("split_rows", [10_000, 1])
def test_lines_match_all_pairs(spark, split_rows, monkeypatch):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(12, 40))) for _ in range(40)]

    def edited(line):
        w = line.split(" ")
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = rng.choice(words)
        return " ".join(w)

    docs = [(k, "\n".join([edited(rng.choice(base)) if rng.random() < 0.6 else rng.choice(["short", "Short", "", "  ", "x" * 30 + str(k)]) for _ in range(rng.randint(1, 6))])) for k in range(60)]
    docs += [(60, None), (61, ""), (62, docs[0][1]), (62, docs[0][1]), (None, docs[1][1] + "\nonly here and nowhere else, a line"), (63, "long " * 20_000), (64, "\n".join(["long " * 19_000] * 2 + ["\n" * 3000, "tail"])), (65, "一二三四五六七八九十" * 3 + "\n" + "一二三四五六七八九十" * 3 + "。")]
    # each bucket in parts, as if it held much of the corpus
    monkeypatch.setattr(line_dedup, "SPLIT_ROWS", split_rows)
    monkeypatch.setattr(line_dedup, "PROBE", 1 if split_rows == 1 else 64)
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("gone", F.lit(1)).withColumn("n_lines", F.lit("x"))
    got = sorted(((r.doc_id, r.text, r.n_lines_1, r.n_dropped) for r in line_dedup.dedup(frame).collect()), key=str)
    assert got == slow_lines(docs)
    assert line_dedup.dedup(frame.where("false")).count() == 0


def test_lines_with_one_letter_changed_are_found(spark):
    """Of short lines too: all pairs that character shingles make alike."""
    rng = random.Random(3)
    made = []
    for k in range(1500):
        line = " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(3, 8))) for _ in range(rng.choice((8, 12, 18))))
        at = rng.randrange(len(line))
        made.append((line, line[:at] + "#" + line[at + 1 :]))
    rows = [(2 * k + j, x) for k, pair in enumerate(made) for j, x in enumerate(pair)]
    classes = {r.node: r.component for r in connected(line_dedup.links(spark.createDataFrame(rows, "id long, line string"))).collect()}
    near = [k for k, (x, y) in enumerate(made) if alike(slow_set(x), slow_set(y))]
    found = [k for k in near if classes.get(2 * k + 1) == 2 * k]
    assert len(near) > 1000 and len(found) >= 0.99 * len(near)
    assert not [k for k in set(range(1500)) - set(near) if 2 * k in classes]


def test_minima_do_not_depend_on_how_many_shingles_meet_them_at_once(spark, monkeypatch):
    lines = spark.createDataFrame([(n, "Ä😀 xyz of some words"[:n]) for n in range(20)], "id long, line string")
    seen = []
    for together in (2, 3, 4):
        monkeypatch.setattr(line_dedup, "TOGETHER", together)
        seen.append(sorted((r.id, tuple(r["keys"]), r.x, r.y) for r in line_dedup._band_keys(lines).collect()))
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) == 20


def test_lines_of_large_buckets_are_all_joined(spark):
    """2,000 copies of a line, each with another word at some place, are alike to the line itself and mostly not to each other."""
    rng = random.Random(11)
    words = [f"w{k}x{rng.randrange(10**6)}" for k in range(25)]
    copies = [" ".join([*words[: k % 25], f"other{k}", *words[k % 25 + 1 :]]) for k in range(2000)]
    lines = spark.createDataFrame(list(enumerate([*copies, " ".join(words)])), "id long, line string")
    found = line_dedup.links(lines, 0.8)
    classes = {r.node: r.component for r in connected(found).collect()}
    sets = [slow_set(x) for x in [*copies, " ".join(words)]]
    assert all(alike(sets[r.a], sets[r.b]) for r in found.collect())
    near = [k for k in range(2000) if alike(sets[k], sets[2000])]
    assert len(near) > 1900 and sum(classes.get(k) == classes[2000] for k in near) >= 0.995 * len(near)


def test_groups_without_a_middle_are_joined(spark):
    """A chain of lines, each alike to the next alone, and variants of which no line is near the most."""
    rng = random.Random(12)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    chain = [letters(400)]
    for _ in range(200):
        chain.append(chain[-1][25:] + letters(25))
    lines = spark.createDataFrame(list(enumerate(chain)), "id long, line string")
    assert all(alike(slow_set(a), slow_set(b)) for a, b in itertools.pairwise(chain))
    classes = {r.node: r.component for r in connected(line_dedup.links(lines)).collect()}
    assert sum(classes.get(k) == classes.get(k + 1) for k in range(200)) >= 199


def test_mixture_budgets_and_prefixes(spark):
    leaves = [("a", "x", 100), ("a", "y", 1000), ("b", "x", 50), ("b", "y", 50), ("c", None, 10_000)]
    frame = spark.createDataFrame(leaves, "d string, s string, capacity long")
    got = {(r.d, r.s): r.budget for r in mixing.budgets(frame, ["d", "s"], [{"a": 2, "b": 1, "c": 1}, {}], 1200).collect()}
    # b can use 100 of its 300: a and c share 1100 by 2 to 1; within a, x is short and y takes over
    assert got == {("a", "x"): 100, ("a", "y"): 633, ("b", "x"): 50, ("b", "y"): 50, ("c", None): 366}
    assert {r.budget for r in mixing.budgets(frame, ["d", "s"], [{}, {}], 0).collect()} == {0}
    zero = {r.d for r in mixing.budgets(frame, ["d", "s"], [{"c": 0}, {}], 500).collect()}
    assert zero == {"a", "b"}


def test_mixture_takes_seeded_prefixes(spark):
    rng = random.Random(8)
    rows = [(k, None if k == 5 else "w" * rng.randint(0, 200), rng.choice(["en", "de", None]), rng.choice(["src0", "src0", "src1"])) for k in range(500)] + [(5, "dup", "en", "src0")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("epoch", F.lit("mine")).withColumns({c: F.lit("x") for c in ("name", "size", "place", "level_0", "bucket")})
    out = mixing.mix(docs, ["lang", "source"], [{"en": 3}, {}], 0.8, epochs=2).collect()
    size = lambda t: -(-len(t or "") // 4)
    total = sum(size(r[1]) for r in rows)
    leaves: dict = {}
    for r in rows:
        leaves.setdefault((r[2], r[3]), []).append(r)
    budget = {(r.lang, r.source): r.budget for r in mixing.budgets(spark.createDataFrame([(*k, 2 * sum(size(r[1]) for r in v)) for k, v in leaves.items()], "lang string, source string, capacity long"), ["lang", "source"], [{"en": 3}, {}], int(total * 0.8)).collect()}
    want = []
    for leaf, docs_ in leaves.items():
        order = sorted(((e, hashlib.md5(f"17:{e}:{r[0]}".encode()).hexdigest(), str(r[0]), r) for e in (0, 1) for r in docs_), key=lambda x: x[:3])
        used = 0
        for _, group in itertools.groupby(order, key=lambda x: x[:3]):
            group = list(group)
            used += sum(size(g[3][1]) for g in group)
            if used > budget[leaf]:
                break
            want += [(g[3][0], g[0], size(g[3][1])) for g in group]
    assert sorted((r.doc_id, r.epoch_1, r.tokens) for r in out) == sorted(want)
    assert {r.epoch for r in out} == {"mine"}
    assert mixing.mix(docs.where("false"), ["lang", "source"], [{}, {}], 0.5).count() == 0


def test_mixture_keeps_columns_of_the_same_names(spark, tmp_path):
    docs = spark.createDataFrame([(k, "w" * 40 * (k % 5), "en", f"src{k % 12}") for k in range(200)], "doc_id long, text string, lang string, source string")
    mine = docs.withColumns({"domain": F.lit("mine"), "tokens": F.lit("t"), "epoch": F.lit("e")})
    for name, frame in (("plain", docs), ("mine", mine)):
        frame.write.parquet(str(tmp_path / name / "documents.parquet"))
    got = [queries.op6_hierarchical_mixture(spark, str(tmp_path / name)) for name in ("plain", "mine")]
    assert got[0].columns == got[1].columns == ["doc_id", "domain", "lang", "source", "epoch", "tokens"]
    rows = [sorted(map(tuple, g.collect())) for g in got]
    assert rows[0] == rows[1] and rows[0]
    kept = corpus_pipeline.mixture(spark, mine, "")
    assert kept.columns == mine.columns and {(r.domain, r.tokens, r.epoch) for r in kept.collect()} == {("mine", "t", "e")}


def test_pipeline_stages_keep_columns_and_take_effect(spark, tmp_path):
    docs = spark.createDataFrame(
        [(k, ("Good plain words stand here, one after another, number %d of many. " % (k % 90)) * (1 + k % 3) if k % 5 else "BAD!! " * 40, "en", f"src{k % 4}", 1) for k in range(300)], "doc_id long, text string, lang string, source string, n_chars long"
    )
    labels = docs.select("doc_id", (F.col("doc_id") % 5 != 0).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    now, counts = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        before = now
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        counts.append(now.count())
        if name != "packing":
            assert now.columns == docs.columns
            assert now.join(before, "doc_id", "left_anti").count() == 0
        if name == "quality":
            assert now.where("doc_id % 5 = 0").count() == 0 and counts[-1] == 240
    assert counts[0] == counts[1] > counts[2] > counts[3]
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert whole.count() == counts[-1] and set(whole.columns) >= {"doc_id", "start", "length", "sequence_id", "offset"}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_duplicates", "mixture", "packing"]
    assert len([n for n in queries.queries() if n.startswith("op")]) == 10


def test_stored_gives_memory_of_the_driver_back(spark, monkeypatch):
    from emberline import session

    assert session.give_back(spark)
    calls, real = [], session.give_back
    monkeypatch.setattr(session, "give_back", lambda s: calls.append(real(s)))
    kept = session.stored(spark.range(5), "some")
    assert calls == [True] and kept.count() == 5
    session.discard(kept)


def test_equal_lines_are_one_before_their_shingles_are_made(spark):
    rows = [(k, f"a line of its own with the number {k}") for k in range(20)]
    once, often = (spark.createDataFrame(rows * n, "id long, line string") for n in (1, 7))
    seen = [sorted((r.id, tuple(r["keys"]), r.x, r.y) for r in line_dedup._band_keys(lines).collect()) for lines in (once, often)]
    assert seen[0] == seen[1] and len(seen[0]) == 20
    plan = line_dedup._band_keys(often)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Exchange") > plan.index("Generate explode")


def test_sketches_tell_minima_apart_by_three_bits(spark):
    """16 of 40 minima may differ in their last three bits, whichever of the bits it is."""
    rng = random.Random(17)
    rows = []
    for others in (0, 15, 16, 17, 40):
        for _ in range(20):
            own = [rng.randrange(8) for _ in range(40)]
            apart = set(rng.sample(range(40), others))
            other = [v ^ rng.randrange(1, 8) if k in apart else v for k, v in enumerate(own)]
            rows.append((others, *(sum(v << 3 * k for k, v in enumerate(half)) for half in (own[:20], own[20:], other[:20], other[20:]))))
    frame = spark.createDataFrame(rows, "others int, x1 long, y1 long, x2 long, y2 long")
    assert all(r.fit == (r.others <= 16) for r in frame.select("others", F.expr(line_dedup._PLAUSIBLE).alias("fit")).collect())
