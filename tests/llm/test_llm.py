"""Small brute-force comparisons and edge cases of the ten operators."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from inkstone.llm import queries as llm_queries
from inkstone.llm import chat, hmm, html, linededup, mixing, neardup, neighbours, passages, quality
from inkstone.llm.bpe import Bpe, decode_ids, encode_texts
from inkstone.llm.common import words_of

P = pytest.importorskip("public_tokenizers")
RANKS = P.path("byte_bpe_50k.tiktoken")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed, n):
    draw = random.Random(seed)
    return ["".join(draw.choices("abcdefghij", k=draw.randint(2, 7))) for _ in range(n)]


def corpus():
    base, long = words(1, 120), words(2, 3000)
    near = base[:60] + ["changed"] + base[61:]
    texts = [" ".join(base), " ".join(near), " ".join(base), None, "", " \n\t ", "few words here", " ".join(words(3, 90)) + "\n" + " ".join(base[:70]), " ".join(long), "### $$$ %%% " * 60, "same line of text here\nsame line of text here\n" + " ".join(words(5, 80))]
    return [(i, t, ["en", "de", None][i % 3], [None, "s1", "s2"][i % 3], 0) for i, t in enumerate(texts)] + [(None, "no id " * 30, "en", "s1", 0)]


@pytest.fixture(scope="module")
def docs(spark):
    clash = {c: F.lit("x") for c in ("node", "key", "kept", "line", "size", "taken", "n_words", "c")}
    return spark.createDataFrame(corpus(), DOCS).withColumns(clash)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def shingles(text):
    w = words_of(text, True)
    return {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicates(docs, empty):
    got = {r.doc_id: r for r in neardup.near_duplicates(docs).collect()}
    sets = {r[0]: shingles(r[1]) for r in corpus() if r[0] is not None}
    parent = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                low, high = sorted((parent[a], parent[b]))
                parent = {k: low if v == high else v for k, v in parent.items()}
    assert {i: got[i].component_id for i in sets} == parent
    assert got[None].kept and got[None].component_id is None and got[3].n_shingles == 0
    assert neardup.near_duplicates(empty).count() == 0


def test_stars_in_long_chains(spark):
    from inkstone.llm.components import stars

    edges = spark.createDataFrame([(i, i + 1) for i in range(60)], "u long, v long")
    assert {r.v for r in stars(edges).collect()} == {0}


def test_quality(docs, empty):
    got = {r.doc_id: r for r in quality.quality_rules(docs).collect()}
    assert got[3].base_failed and not got[3].kept and got[6].n_words == 3
    assert got[0].kept and got[10].n_dup_lines == 1
    assert got[9].n_symbols == 540 and got[9].n_repeat_words == 180 and got[9].base_failed
    assert quality.quality_rules(empty).count() == 0
    assert set(quality.keep_good(docs).columns) == set(docs.columns)


def test_rows_without_id_or_with_a_shared_one_are_judged_by_their_text(spark):
    good, bad = " ".join(words(11, 90)), "bad " * 60
    rows = [(None, good, "en", "s", 0), (None, bad, "en", "s", 1), (1, good, "en", "s", 2), (1, bad, "en", "s", 3), (2, None, None, None, 4), (3, good, None, None, 5), (3, good, None, None, 5)]
    assert sorted(r.n_chars for r in quality.keep_good(spark.createDataFrame(rows, DOCS)).collect()) == [0, 2, 5, 5]


def test_broadcasts_carry_no_classes_of_the_package():
    import pickle

    model = hmm.Model.first(np.ones(5))
    assert b"inkstone" not in pickle.dumps(model.arrays()) and (hmm.Model(*model.arrays()).emit == model.emit).all()
    curves = neighbours.Curves([np.arange(8.0) + i for i in range(30)])
    x = np.random.default_rng(1).normal(size=(5, 8))
    assert b"inkstone" not in pickle.dumps(curves.parts()) and (neighbours.Curves.of_parts(*curves.parts()).keys(x, 1) == curves.keys(x, 1)).all()


def _features(spark, rows):
    return spark.createDataFrame([(i, 100, *r) for i, r in enumerate(rows)], f"{quality.FEATURES}, lang string, source string")


def test_quantile_sketch_matches_sorted_values(spark):
    values = np.random.default_rng(4).gamma(3.0, 2.0, 500)
    hi = quality.thresholds(quality.sketch(_features(spark, [(int(100 * v), 0, 0, 0, 1, "en", "s") for v in values]))).first().word_length_hi
    x = np.sort([int(100 * v) / 100 for v in values])
    assert math.isclose(hi, x[249] + 8 * max(x[249] - x[49], 0.15), rel_tol=0.05)


def test_limits_follow_language_and_source(spark):
    """Symbols and repeats are natural in one source and junk in another; limits differ, and a small source leans on its language."""
    draw = np.random.default_rng(9)
    rows = [(500, int(x), 0, int(y), 1, "en", "code") for x, y in zip(draw.integers(20, 60, 600), draw.integers(0, 40, 600))]
    rows += [(500, 0 if i % 10 else 45, 0, 0, 1, "en", "news") for i in range(600)]
    rows += [(500, 0, 0, 0, 1, "en", "small") for _ in range(3)] + [(500, 0, 0, 0, 1, None, None)]
    got = {r.source: r for r in quality.thresholds(quality.sketch(_features(spark, rows))).collect()}
    assert got["code"].symbol_share_hi > 0.6 and 0.05 < got["news"].symbol_share_hi < 0.45
    # beside 100 documents' worth of its language three documents weigh little
    assert got["news"].symbol_share_hi < got["small"].symbol_share_hi and None in got


def test_bpe(spark, docs, empty):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    whole = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = encode_texts(docs, RANKS, P.PATTERN, keep_ids=True)
    for r in out.collect():
        text = next(t for i, t, *_ in corpus() if i == r.doc_id) or ""
        assert r.ids == whole.encode_ordinary(text) and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    raw = {r.doc_id: bytes(r.raw) for r in decode_ids(out, RANKS, P.PATTERN).collect()}
    assert raw[0].decode() == corpus()[0][1]
    assert encode_texts(empty, RANKS, P.PATTERN).count() == 0


def _tiktoken():
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_merges_by_rank():
    whole, bpe, draw = _tiktoken(), Bpe(open(RANKS, "rb").read(), P.PATTERN), random.Random(7)
    for n in [*range(1, 60), 255, 256, 257, 700, 5000]:
        for letters in ("abcdeé", "a", "the "):
            text = "".join(draw.choice(letters) for _ in range(n))
            assert bpe.encode_pieces(bpe.split(text)) == whole.encode_ordinary(text)
            assert [bpe.merge(p.encode()) for p in bpe.split(text)] == [tuple(whole.encode_ordinary(p)) for p in bpe.split(text)]
    for _ in range(100):
        text = "".join(draw.choice(["a", "é", " ", "  ", "\n", "1", "'s", "'", "!", "<|endoftext|>", "字", "aaaa" * 9]) for _ in range(draw.randint(0, 300)))
        assert [x for part in bpe.serial(text, draw.randint(3, 30)) for x in part] == bpe.split(text)


def test_chunks_stitch(spark):
    """Small and default chunks, words longer than the overlap, white-space runs across seams, repeated rows, null ids."""
    whole, draw = _tiktoken(), random.Random(8)
    atoms = ["a", "é", " ", "  ", "\n", "1", "'s", "'re", "'", "!", "<|endoftext|>", "字", "don't ", "word "]
    texts = ["".join(draw.choices(atoms, k=draw.randint(0, 400))) for _ in range(60)] + ["x" * 300 + " tail" * 40, " " * 200 + "a" + " " * 199, "ab " * 90, None, ""]
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts)] + [(2, texts[2])] * 2 + [(2, texts[3])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("chunk", "piece", "print", "ids", "copies")})
    key = lambda doc, ids: (-1 if doc is None else doc, tuple(ids))
    want = sorted(key(i, whole.encode_ordinary(t or "")) for i, t in rows)
    for chunk, overlap, dealt in ((16, 8, 2), (40, 20, 1000)):
        got = encode_texts(frame, RANKS, P.PATTERN, keep_ids=True, chunk=chunk, overlap=overlap, dealt=dealt).collect()
        assert sorted(key(r.doc_id, r.ids) for r in got) == want
    long = " ".join(words(4, 9000)) + " " + "y" * 2000 + "\n" * 700 + " ".join(words(5, 4000))
    long_rows = [(1, long), (2, long[:20_000]), (2, long[:20_000]), (3, " ".join(words(6, 5000)))]
    got = encode_texts(spark.createDataFrame(long_rows, "doc_id long, text string"), RANKS, P.PATTERN).collect()
    digest = lambda t: hashlib.sha256(" ".join(map(str, whole.encode_ordinary(t))).encode()).hexdigest()
    assert sorted((r.doc_id, r.ids_sha256, r.decoded_sha256) for r in got) == sorted((i, digest(t), hashlib.sha256(t.encode()).hexdigest()) for i, t in long_rows)


def test_mix(spark, docs, empty):
    rows = [(i, " ".join(["w"] * (5 + i % 90)), "en", ["a", "b", "c", None][min(3, i % 7)], 0) for i in range(600)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS), shard_words=2000).toPandas()
    by = got.groupby("source", dropna=False).agg(size=("size", "sum"), source_size=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (by["size"] == by.source_size).all() and (abs(by.taken - by.target) <= 64).all() and (got.taken <= 2 * got["size"]).all()
    assert math.isclose(by.target.sum(), 1.5 * by.source_size.sum())
    again = mixing.mix(spark.createDataFrame(rows[::-1], DOCS), shard_words=2000).toPandas()
    assert dict(zip(got.doc_id, got.taken)) == dict(zip(again.doc_id, again.taken))
    assert mixing.mix(docs).count() == len(corpus()) and mixing.mix(empty).count() == 0


def test_mix_against_brute_force(spark):
    """Targets, quotas of blocks by source, part and shard, and the words taken of every document, by plain loops over the same seeded orders."""
    draw = random.Random(12)
    sizes = [draw.randint(0, 90) for _ in range(400)]
    rows = [(i, " ".join(["w"] * n) or None, None, [None, "a", "a", "a", "b", "c", "d"][draw.randrange(7)], 0) for i, n in enumerate(sizes)]
    rows += [rows[5], rows[5]]
    block, shard_words = 16, 400
    docs_ = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(docs_, block=block, shard_words=shard_words).collect()
    sizes_of = defaultdict(int)
    for _, t, _, s, _ in rows:
        sizes_of[s] += len((t or "").split())
    order = sorted(sizes_of, key=lambda s: (s is None, s or ""))
    weights, total, target, left = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, 1.5 * sum(sizes_of.values()), {}, list(order)
    while left:  # sources above their cap stop there, the excess is shared anew
        share = (total - sum(target.values())) / sum(weights[s] for s in left)
        full = [s for s in left if share * weights[s] >= 2 * sizes_of[s]]
        if not full:
            target |= {s: share * weights[s] for s in left}
            break
        target |= {s: 2.0 * sizes_of[s] for s in full}
        left = [s for s in left if s not in full]

    def quotas(votes, seats):  # highest quotients
        taken = dict.fromkeys(votes, 0)
        for _ in range(seats):
            best = min((k for k in votes if votes[k] > 0), key=lambda k: (-votes[k] / (2 * taken[k] + 1), str(type(k)), *(k if isinstance(k, tuple) else (k is None, k or ""))))
            taken[best] += 1
        return taken

    assert all(math.isclose(r.target, target[r.source]) for r in got)
    seats = math.floor(sum(target.values()) / block + 0.5)
    of_source = quotas(target, seats)
    words_of_source = {s: min(of_source[s] * block, 2 * sizes_of[s]) for s in target}
    numbered = [(r[0], r[3], len((r[1] or "").split()), 1 + sum(q[0] == r[0] for q in rows[:k])) for k, r in enumerate(rows)]
    keyed = spark.createDataFrame(numbered, "doc_id long, source string, size long, copy int")
    shards = {s: max(1, math.ceil(sizes_of[s] / shard_words)) for s in sizes_of}
    lookup = spark.createDataFrame([(s, n) for s, n in shards.items()], "s string, shards long")
    placed = keyed.join(lookup, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "source", "size", "copy", F.pmod(F.xxhash64(F.lit(17), "doc_id", "copy"), "shards").alias("shard"), F.xxhash64(F.lit(18), "doc_id", "copy").alias("place")).collect()
    want = {}
    for s in sizes_of:
        members = defaultdict(list)
        for r in placed:
            if r.source == s:
                members[r.shard].append(r)
        weight = {k: float(sum(r["size"] for r in v)) for k, v in members.items()}
        share = quotas(weight, math.floor(words_of_source[s] / block + 0.5)) if sum(weight.values()) else dict.fromkeys(weight, 0)
        for k, v in members.items():
            size = int(weight[k])
            due = share[k] * block + (words_of_source[s] - math.floor(words_of_source[s] / block + 0.5) * block if k == min(members) else 0)
            due = max(0, min(due, 2 * size))
            rest = due - due // size * size if size else 0
            n_blocks = -(-size // block)
            ranks = spark.createDataFrame([(s, k, b) for b in range(n_blocks)], "source string, shard long, block long").select("block", F.xxhash64(F.lit(19), "source", "shard", "block").alias("h")).collect() if rest else []
            chosen, room = {}, rest
            for r in sorted(ranks, key=lambda r: (r.h, r.block)):
                got_ = min(min(block, size - r.block * block), room)
                if got_ <= 0:
                    break
                chosen[r.block], room = got_, room - got_
            at = 0
            for r in sorted(v, key=lambda r: (r.place, r.doc_id, r["copy"])):
                inside = sum(1 for w in range(at, at + r["size"]) if w % block < chosen.get(w // block, 0))
                want.setdefault(r.doc_id, []).append(r["size"] * (due // size if size else 0) + inside)
                at += r["size"]
    have = defaultdict(list)
    for r in got:
        have[r.doc_id].append(r.taken)
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}


def test_highest_quotients(spark):
    votes = {"a": 53000.0, "b": 24000.0, "c": 23000.0}
    p = spark.createDataFrame(list(votes.items()), "key string, weight double")
    got = {r.key: r.quota for r in mixing.sainte_lague(p, F.lit(7), [], ["key"]).collect()}
    best = sorted(((v / (2 * s - 1), k) for k, v in votes.items() for s in range(1, 8)), reverse=True)[:7]
    assert got == {k: sum(x[1] == k for x in best) for k in votes}


def test_lines(spark, docs, empty):
    draw, lines = random.Random(6), []
    for _ in range(60):
        line = [draw.choice("abcdef ") for _ in range(draw.randint(15, 40))]
        lines.append("".join(line))
        line[draw.randrange(len(line))] = "é"
        lines.append("".join(line))
    texts = ["\n".join(draw.choices(lines, k=6)) for _ in range(40)]
    got = {r.doc_id: r.dropped for r in linededup.line_report(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).collect()}

    def distance(x, y):
        row = list(range(len(y) + 1))
        for i, a in enumerate(x, 1):
            last, row[0] = row[0], i
            for j, b in enumerate(y, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
        return row[-1]

    seen = []
    for i, t in enumerate(texts):
        gone = []
        for k, line in enumerate(t.split("\n")):
            if not line.strip():
                continue
            if line in seen:
                gone.append(k)
                continue
            if len(line) >= 20 and any(len(s) >= 20 and distance(s, line) <= 2 for s in seen):
                gone.append(k)
            seen.append(line)
        assert [int(x) for x in got[i].split(",") if x] == gone
    assert linededup.without_duplicate_lines(docs).count() == len(corpus()) and linededup.line_report(empty).count() == 0


def test_passages(docs, empty):
    got = passages.repeated_passages(docs).collect()
    assert {r.doc_id for r in got} == {0, 1, 2, 7}
    assert any((r.doc_id, r.partner_id, r.start_word, r.n_words) == (7, 0, 90, 70) for r in got)
    assert passages.repeated_passages(empty).count() == 0
    values = np.random.default_rng(1).permutation(300).astype(np.uint64)
    for left, c, right in passages.compact_windows(values, 40):
        assert values[left : right + 1].argmin() + left == c and right - left + 1 >= 40


def test_passages_of_middle_documents_meet(spark):
    """The first and the last document hold every shingle of a passage, but never the passage."""
    draw = np.random.default_rng(3)
    noise = lambda n: [f"n{x}" for x in draw.integers(0, 10**9, n)]
    passage = noise(60)
    apart = lambda: " ".join(w for _ in range(12) for i in range(56) for w in [*noise(50), *passage[i : i + 5]])
    rows = [(0, apart()), (99, apart())] + [(i, " ".join([*noise(80), *passage, *noise(80)])) for i in (10, 11, 12)]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got} == {10, 11, 12} and {r.class_id for r in got} == {10}
    assert all((r.start_word, r.n_words) == (80, 60) for r in got)


def test_passages_parted_by_an_insertion_meet_beside_a_document_of_all_their_shingles(spark):
    """The first document holds every shingle of a passage but never the passage; two others hold it, one with a word more in the middle."""
    draw = np.random.default_rng(4)
    noise = lambda n: [f"n{x}" for x in draw.integers(0, 10**9, n)]
    rows = []
    for k in range(4):
        passage = noise(52)
        rows.append((k, " ".join(w for _ in range(12) for i in range(48) for w in [*noise(50), *passage[i : i + 5]])))
        rows += [(10 + 2 * k, " ".join([*noise(80), *passage, *noise(80)])), (11 + 2 * k, " ".join([*noise(70), *passage[:26], "more", *passage[26:], *noise(90)]))]
    got = {(r.doc_id, r.partner_id): r for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {p for k in range(4) for p in ((10 + 2 * k, 11 + 2 * k), (11 + 2 * k, 10 + 2 * k))}
    assert all(r.class_id == min(p) and r.similarity == 44 / 53 for p, r in got.items())


def test_every_shared_run_has_a_common_window():
    """The anchors are the leftmost minima of all runs, whatever repeats."""
    draw = np.random.default_rng(8)
    for k in range(60):
        values = np.concatenate(([0], draw.integers(1, (3, 30, 10**9)[k % 3], 80), [0, 0], draw.integers(1, 40, 30), [0])).astype(np.uint64)
        runs = ((a, values[a : a + passages.RUN]) for a in range(len(values) - passages.RUN + 1))
        assert passages._selected(values, passages.RUN).tolist() == sorted({a + int(run.argmin()) for a, run in runs if (run > 0).all()})


def test_all_windows_of_two_classes_meet_in_blocks(spark, monkeypatch):
    """Values of more windows than a block meet by pairs of blocks, each pair of windows once."""
    draw = np.random.default_rng(9)
    noise = lambda n: [f"n{x}" for x in draw.integers(0, 10**9, n)]
    run = noise(30)
    rows = [(i, " ".join([*noise(40), *run, *noise(40)])) for i in range(40)]
    monkeypatch.setattr(passages, "BLOCK", 7)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    label = spark.createDataFrame([(i, i % 3) for i in range(3, 40)], "u long, v long")
    dealt = passages._shared_runs(docs, label, 50)
    assert dealt.select("u").distinct().count() > 3
    met = dealt.repartition(3, "key", "u", "v").sortWithinPartitions("key", "u", "v").mapInArrow(passages._cross_meet, "p long, q long").distinct().collect()
    assert {(r.p, r.q) for r in met} == {(p, q) for q in range(40) for p in range(q) if p % 3 != q % 3}


@pytest.mark.parametrize("block", [7, 4096])
def test_a_common_phrase_brings_no_documents_together(spark, monkeypatch, block):
    """Sixty documents share a phrase of 45 words, which is no passage: only the two that share a passage around it meet, though its words differ in three places."""
    draw = np.random.default_rng(23)
    noise = lambda n: [f"n{x}" for x in draw.integers(0, 10**9, n)]
    phrase, passage = noise(45), noise(120)
    changed = [f"c{i}" if i in (10, 40, 100) else w for i, w in enumerate(passage)]
    rows = [(i, " ".join([*noise(80), *phrase, *noise(80)])) for i in range(60)]
    rows += [(60 + k, " ".join([*noise(30), *text[:60], *phrase, *text[60:], *noise(30)])) for k, text in enumerate((passage, changed))]
    monkeypatch.setattr(passages, "BLOCK", block)
    dealt = passages._shared_runs(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(0, 0)], "u long, v long"), 50, passages.HELD, passages.SPREAD)
    met = dealt.repartition(3, "key", "u", "v").sortWithinPartitions("key", "u", "v").mapInArrow(passages._cross_meet, "p long, q long").distinct().collect()
    assert [(r.p, r.q) for r in met] == [(60, 61)]


def test_pairs_without_a_passage_are_told_before_they_are_aligned(monkeypatch):
    """A pair that shares a passage is never turned away; one that shares 45 equal words and one that differs in every fifteenth word are."""
    draw = np.random.default_rng(21)
    some = [draw.permutation(60) + 100 * k for k in range(6)] + [np.full(40, 7)]
    shingled = lambda x: passages.shingle_hashes(np.asarray(x).astype(np.uint64) + np.uint64(1))
    kept = 0
    for _ in range(150):
        x, y = (shingled(np.concatenate([some[k][draw.integers(0, 9) :] for k in draw.integers(0, 7, 5)])) for _ in range(2))
        if passages.passages_of(1, x, 2, y, 46, 75):
            kept += 1
            assert passages._may_share(x, passages._sorted_with_gaps(x), y, 46, 75)
    assert kept > 50
    told = lambda x, y: passages._may_share(x, passages._sorted_with_gaps(x), y, 46, 75)
    words = np.arange(1000, 1300)
    assert not told(shingled([*words[:50], *[5] * 49, *words[50:90]]), shingled([*words[100:150], *[5] * 49, *words[150:190]]))
    changed = words.copy()
    changed[::15] += 5000
    assert not told(shingled(words), shingled(changed)) and told(shingled(words), shingled(words[100:160]))
    # all places of one shingle at once give the same chain as one after another
    for n in (3, 40):
        x, y = draw.integers(0, n, 300).astype(np.uint64), draw.integers(0, n, 260).astype(np.uint64)
        i, j = passages._places(x, y, False)
        monkeypatch.setattr(passages, "MANY", 0)
        by_rows = passages._longest(i, j)
        monkeypatch.setattr(passages, "MANY", 10**9)
        assert by_rows == passages._longest(i, j)


def test_a_repeated_word_has_two_anchors(spark):
    """Stretches that repeat with a short period make two windows, not one for each place, and texts that share one with its surroundings still meet."""
    draw = np.random.default_rng(22)
    noise = lambda n: [f"n{x}" for x in draw.integers(0, 10**9, n)]
    tail = noise(30)
    docs = spark.createDataFrame([(i, " ".join([*noise(60), *["thor", "of"][: 1 + i % 2] * 60, *tail, *noise(40)])) for i in range(8)], "doc_id long, text string")
    dealt = passages._shared_runs(docs, spark.createDataFrame([(0, 0)], "u long, v long"), 50)
    assert dealt.groupBy("key", "doc_id").count().agg({"count": "max"}).first()[0] == 2
    met = dealt.repartition(3, "key", "u", "v").sortWithinPartitions("key", "u", "v").mapInArrow(passages._cross_meet, "p long, q long").distinct().collect()
    assert {(p, q) for q in range(8) for p in range(q) if (q - p) % 2 == 0} <= {(r.p, r.q) for r in met}


def test_chains_span_an_inserted_sentence():
    words = np.random.default_rng(5).permutation(200).astype(np.uint64)
    x, y = passages.shingle_hashes(np.concatenate((words[:44], words[150:166], words[44:88]))), passages.shingle_hashes(words[:88])
    assert passages._chains(x, y, 46, 75, False) == [(0, 100, 0, 84)]
    far = passages.shingle_hashes(np.concatenate((words[:44], words[100:200], words[44:88])))
    assert passages._chains(far, y, 46, 75, False) == []


def test_chains_pass_over_stray_copies_and_repetitions():
    words = np.random.default_rng(6).permutation(10**5).astype(np.uint64)
    same = lambda n: np.full(n, 7, np.uint64)

    def found(x, y):
        return [tuple(r) for r in passages.passages_of(1, passages.shingle_hashes(np.concatenate(x)), 2, passages.shingle_hashes(np.concatenate(y)), 46, 75)]

    first, phrase, second, noise = words[:44], words[50:55], words[60:104], words[200:300]
    # a stray copy of the phrase between the halves stands before them in the other text
    assert found((first, phrase, second), (phrase, noise, first, second)) == [(1, 0, 93, 2, 105, 193, 80, 93)]
    # runs of one word, of several lengths and beside shorter ones
    assert found((noise, same(60), words[300:340]), (words[400:450], same(54), words[500:530])) == [(1, 100, 154, 2, 50, 104, 1, 1)]
    assert found((noise, same(20), words[300:340], same(54), words[340:380], same(20)), (words[400:450], same(54), words[500:530])) == [(1, 160, 214, 2, 50, 104, 1, 1)]
    # passages in another order
    assert found((words[1000:1100], words[2000:2060]), (words[2000:2060], words[1000:1100])) == [(1, 0, 100, 2, 60, 160, 96, 96), (1, 100, 160, 2, 0, 60, 56, 56)]
    # a line that both texts hold hundreds of times
    lines = lambda n, at: tuple(np.concatenate((words[3000:3060], words[at + 3 * k : at + 3 * k + 3])) for k in range(n))
    got = found(lines(300, 5000), lines(200, 9000))
    assert got and all(r[2] - r[1] >= 50 and 100 * r[6] >= 75 * r[7] for r in got)


def test_every_exact_stretch_is_found_whatever_repeats():
    """Random texts of few words: wherever two share 46 shingles or more in a row, a passage is found there, and every passage is long and similar."""
    for seed in range(60):
        draw = np.random.default_rng(seed)
        some = [draw.integers(0, 2 + seed % 5, int(draw.integers(3, 70))) for _ in range(6)]
        x, y = (passages.shingle_hashes(np.concatenate([some[k] for k in draw.integers(0, 6, 7)]).astype(np.uint64) + np.uint64(1)) for _ in range(2))
        alike = np.zeros((len(x) + 1, len(y) + 1), int)
        for a in range(len(x)):
            alike[a + 1, 1:] = np.where(y == x[a], alike[a, :-1] + 1, 0)
        got = passages.passages_of(1, x, 2, y, 46, 75)
        assert bool(got) or alike.max() < 46
        for _, a, b, _, c, d, both, either in got:
            sets = set(x[a : b - 4].tolist()), set(y[c : d - 4].tolist())
            assert min(b - a, d - c) >= 50 and both == len(sets[0] & sets[1]) and either == len(sets[0] | sets[1]) and 100 * both >= 75 * either


def test_hash_functions_find_alike_passages():
    from math import comb

    n = passages.HASHES
    assert sum(comb(n, k) * 0.75**k * 0.25 ** (n - k) for k in range(passages.AGREE)) < 0.0005


def test_interval_join_needs_overlap_and_two_functions():
    """Nested intervals keep a run going up to the farthest end; equal values of one function count once."""
    pack = lambda low, high, f: (low + 5 << 35) | (5 << 19) | (high - low - 5 << 3) | f
    cases = [
        ([(0, 100, 0), (10, 20, 0), (50, 90, 1)], True),  # the second interval ends before the third begins, the first goes on
        ([(0, 100, 0), (10, 20, 0), (50, 90, 0)], False),
        ([(0, 20, 0), (30, 60, 1)], False),
        ([(0, 20, 0), (20, 60, 1)], True),
        ([(0, 20, 3)], False),
    ]
    rows = [(1, k, pack(*i)) for k, (intervals, _) in enumerate(cases) for i in intervals]
    got = passages.agreeing(*(np.array(x, np.int64) for x in zip(*sorted(rows))))
    assert sorted(got[1].tolist()) == [k for k, (_, ok) in enumerate(cases) if ok]


def test_alphas_are_scaled_now_and_then(monkeypatch):
    """Scaling at every eighth token and at the ends gives what scaling at every token gives, also for the rarest classes."""
    draw = np.random.default_rng(12)
    lengths = draw.integers(1, 400, 60)
    starts, classes = np.cumsum(lengths) - lengths, draw.integers(0, 40, lengths.sum())
    model = hmm.Model.first(10.0 ** draw.integers(0, 12, 40))
    scaled = sum(len(x[-1]) for x in hmm._sweep(model.move, np.ascontiguousarray(model.emit.T), classes, lengths, starts, np.repeat(model.start[None, None], 60, 0)))
    assert scaled <= lengths.sum() / hmm.SCALED + len(lengths)
    got = hmm.forward(model, classes, lengths, starts, 64), *hmm.expected_counts(model, classes, lengths, starts, 64)
    monkeypatch.setattr(hmm, "SCALED", 1)
    want = hmm.forward(model, classes, lengths, starts, 64), *hmm.expected_counts(model, classes, lengths, starts, 64)
    assert all(np.isfinite(x).all() and np.allclose(x, y, rtol=1e-9) for x, y in zip(got, want))


def _dup(spark, rows):
    return sorted(map(tuple, passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()))


def test_passages_do_not_depend_on_batches(spark, monkeypatch):
    draw = np.random.default_rng(11)
    noise = lambda n: [f"n{x}" for x in draw.integers(0, 10**9, n)]
    shared = [noise(70) for _ in range(4)]
    rows = [(i, " ".join(noise(40) + shared[i % 4] + noise(30) + (shared[(i + 1) % 4] if i % 3 else []))) for i in range(60)]
    want = _dup(spark, rows)
    frame = spark.createDataFrame(draw.permutation(np.array(rows, object)).tolist(), "doc_id long, text string")
    assert {r[0] for r in want} == set(range(60))
    assert sorted(map(tuple, passages.repeated_passages(frame.repartition(9)).collect())) == want
    # the same classes if every value is dealt to several tasks
    monkeypatch.setattr(passages, "_hot_values", lambda docs, n, keep: np.array([r.key for r in docs.mapInArrow(passages._windows(n, np.zeros(0, np.int64)), passages._ROWS).select("key").distinct().collect()], np.int64))
    assert {(r[0], r[-1]) for r in _dup(spark, rows)} == {(r[0], r[-1]) for r in want}


def test_passages_found_against_brute_force(spark):
    """Planted passages of 50 to 120 words with 0 to 7 % of their words changed: all pairs of one class whose true similarity reaches 0.75, and 98 % of them at least."""
    draw = np.random.default_rng(21)
    noise = lambda n: [f"n{x}" for x in draw.integers(0, 10**9, n)]
    rows, planted = [], []
    for k in range(150):
        passage = noise(int(draw.integers(50, 121)))
        changed = [w if draw.random() > 0.01 * (k % 8) else f"c{draw.integers(0, 10**9)}" for w in passage]
        sets = [{tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (passage, changed)]
        rows += [(2 * k, " ".join(noise(60) + passage + noise(60))), (2 * k + 1, " ".join(noise(45) + changed + noise(80)))]
        # the ends that differ are no part of the alignment, so the passage must be long enough without them
        same = [i for i, (a, b) in enumerate(zip(passage, changed)) if all(x == y for x, y in zip(passage[i : i + 5], changed[i : i + 5])) and i + 5 <= len(passage)]
        planted.append(same and same[-1] - same[0] + 5 >= 50 and 100 * len(sets[0] & sets[1]) >= 75 * len(sets[0] | sets[1]))
    got = {(min(r[0], r[3]), max(r[0], r[3])) for r in _dup(spark, rows)}
    want = {(2 * k, 2 * k + 1) for k, ok in enumerate(planted) if ok}
    assert len(want) > 60 and got <= {(2 * k, 2 * k + 1) for k in range(150)}
    assert len(got & want) >= 0.98 * len(want)
    exact = {(2 * k, 2 * k + 1) for k in range(0, 150, 8)}
    assert exact <= got


def test_passages_of_repeated_rows_and_long_texts(spark):
    """Rows that share a doc_id: the largest text counts, however often it comes; a long text meets its piece."""
    long, other = words(31, 30_000), words(32, 200)
    rows = [(1, " ".join(long))] * 3 + [(2, " ".join(words(33, 80) + long[15_000:15_090] + words(34, 80))), (3, " ".join(other[:60])), (3, " ".join(other)), (4, " ".join(other[120:200])), (None, " ".join(other))]
    assert [(r[0], r[3], r[1], r[2]) for r in _dup(spark, rows)] == [(1, 2, 15_000, 90), (2, 1, 80, 90), (3, 4, 120, 80), (4, 3, 0, 80)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("p", "q", "key", "rep", "n", "rows", "words")})
    assert passages.repeated_passages(frame).count() == 4


def test_sql_on_a_small_fixture(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    draw = np.random.default_rng(2)
    rows = [(i, *r[1:]) for i, r in enumerate(corpus())]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    vectors = [(i, [float(x) for x in draw.standard_normal(8)]) for i in range(203)] + [(300, [0.0] * 8), (301, None), (302, [float("nan")] * 8), (303, [None] * 8)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    for name in ("documents", "embeddings"):
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    for name in ("op2_quality_rules", "op5_minhash_near_dedup", "op10_hilbert_neighbours"):
        got = llm_queries.QUERIES[name](spark, str(tmp_path))
        want = con.execute(f"select {', '.join(got.columns)} from ({llm_queries.ORACLE_SQL[name]})").fetchall()
        assert want and sorted(map(tuple, got.collect())) == sorted(want), name


PAGES = "page_id long, url string, html string"


def _lcs(a, b):
    table = defaultdict(int)
    for i in range(len(a)):
        for j in range(len(b)):
            table[i, j] = table[i - 1, j - 1] + 1 if a[i] == b[j] else max(table[i - 1, j], table[i, j - 1])
    return table


def test_html(spark):
    page = "<html><head><title>x</title><style>p{}</style></head><body><nav><a>menu</a></nav><div class='ad'>buy</div><article><h1>A &amp; B</h1><p>one\n two<br>three<aside>side</aside><p>four</article><footer>f</footer></body></html>"
    plain = "<body><div>site name</div><p>only {} here</p><div>imprint</div></body>"
    rows = [(1, "https://h/a/1", page), (2, "https://g/a/1", plain.format("apples")), (3, "https://g/a/2", plain.format("pears")), (4, None, None), (5, "https://g/a/3", ""), (1, "https://h/a/1", page)]
    frame = spark.createDataFrame(rows, PAGES).withColumns({c: F.lit("x") for c in ("row", "host", "path", "lines", "text", "gone", "block")})
    got = html.main_text(frame).collect()
    text = {r.page_id: r.text for r in got}
    assert len(got) == 6 and text[1] == "A & B\none two three\nfour" and text[2] == "only apples here" and text[3] == "only pears here" and text[4] == text[5] == ""
    assert html.main_text(frame.limit(0)).count() == 0
    draw = random.Random(3)
    for _ in range(200):
        a, b = [draw.randint(0, 4) for _ in range(draw.randint(0, 9))], [draw.randint(0, 4) for _ in range(draw.randint(0, 9))]
        assert len(html.shared_lines(a, b)) == _lcs(a, b)[len(a) - 1, len(b) - 1]


def test_difference_of_unmarked_pages_against_brute_force(spark):
    """Pages without article elements, with template lines, copied articles and copies of whole pages, over several blocks and hosts."""
    draw, rows = random.Random(4), []
    words_ = lambda n: " ".join(draw.choice("abcdefghij") * draw.randint(2, 6) for _ in range(n))
    for host, n in (("h", 300), ("g", 12), ("one", 1), ("two", 2)):
        top, bottom, copied = words_(3), words_(4), [words_(9) for _ in range(3)]
        for k in range(n):
            own = copied + [words_(7)] if k % 5 == 0 else [words_(8) for _ in range(draw.randint(1, 5))]
            if k % 40 == 7:
                own = rows[-1][3]
            rows.append((len(rows), f"https://{host}/p/{draw.randint(0, 3)}/{k}", "".join(f"<p>{x}</p>" for x in [top, *own, bottom]), own))
    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame([r[:3] for r in rows], PAGES)).collect()}
    by_host = defaultdict(list)
    for i, url, page, _ in rows:
        host, path = url.split("//")[1].split("/", 1)
        by_host[host].append(("/" + path, i, [x for x in page.replace("<p>", "").split("</p>") if x]))
    for pages in by_host.values():
        pages.sort(key=lambda x: (x[0], x[1]))
        for at, (path, i, lines) in enumerate(pages):
            near = [(g, *p) for g, p in enumerate(pages) if g != at and abs(g - at) <= 8]
            prefix = lambda x: next((k for k, (a, b) in enumerate(zip(x, path)) if a != b), min(len(x), len(path)))
            near.sort(key=lambda x: (-prefix(x[1]), abs(x[0] - at), x[0]))
            others = [x[3] for x in near if sum(len(y) for y in lines if y in x[3]) < 0.9 * sum(map(len, lines))]
            common = [x for x in lines if others and 2 * sum(x in o for o in others) >= len(others)]
            want, table = [], _lcs(lines, others[0]) if others else {}
            shared, a, b = set(), len(lines) - 1, len(others[0]) - 1 if others else -1
            while a >= 0 and b >= 0:
                if lines[a] == others[0][b]:
                    shared.add(a)
                    a, b = a - 1, b - 1
                elif table[a - 1, b] == table[a, b]:
                    a -= 1
                else:
                    b -= 1
            want = [x for k, x in enumerate(lines) if not (k in shared and x in common)]
            assert got[i] == "\n".join(want), (i, got[i], want)
    assert sum(got[i] == "\n".join(own) for i, _, _, own in rows) >= 0.95 * len(rows)


def test_markup_breaks_ties(spark):
    """Containers named like adverts count only where neighbours have them; ids that headings get from their words drop nothing."""
    page = "<body><article><h2 id='search-for-gold'>{0} gold</h2><section id='notice'>{0} note</section><div class='comments'><p>reader {0}</p></div></article><p>{0} outside</p></body>"
    other = "<body><article><p>{0} text</p><div class='comments'><p>other {0}</p></div></article></body>"
    rows = [(i, f"https://h/{i}", (page if i == 3 else other).format(f"w{i}")) for i in range(6)] + [(9, "https://lone/1", "<!-- no <article> here --><header>site</header><p>a&nbsp;b</p><p>1 < 2")]
    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert got[3] == "w3 gold\nw3 note" and got[1] == "w1 text" and got[9] == "a b\n1 < 2"


def test_forms_formulas_and_pages_without_neighbours(spark):
    """A form around the whole page is its frame; forms beside or in the article go; formulas stay; comments on a page without neighbours go, a named frame does not."""
    body, sign_up = "<p>{0} one</p><p>x <math><mi>y</mi><mo>+</mo><mn>1</mn></math> z</p>", "<form><label>mail</label></form>"
    comments = "<div class='comments'><p>reader</p></div>"
    pages = [
        f"<form action='/'><nav>menu</nav><article>{body}{sign_up}</article>{sign_up}</form>",
        f"<form>{body}</form>{sign_up}",
        f"<article>{body}{comments}</article>",
        f"<div class='main header'>{body}</div>{comments}",
        f"<article>{body}</article><form><article></article>{body}</form>",
    ]
    rows = [(i, f"https://lone{i}/a", x.format("w")) for i, x in enumerate(pages)]
    rows += [(i, f"https://copies/{i}", f"<article>{body}{comments}</article>".format("w")) for i in range(10, 13)] + [(20, None, pages[2].format("w"))]
    got = html.main_text(spark.createDataFrame(rows, PAGES)).collect()
    assert len(got) == 9 and {r.text for r in got} == {"w one\nx y+1 z"}


def test_broken_pages_take_linear_time():
    import time

    for broken in ('<a b="c ' * 125_000, "<div>" * 100_000 + "</span>" * 100_000, '<p title="x>' + "y<b>z</b>" * 100_000, "<!--" * 250_000, "<script>" * 125_000):
        began = time.time()
        html.blocks(broken)
        assert time.time() - began < 20


def test_chat(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (2, 0, "user", "alone"), (3, 1, "assistant", None), (3, 0, None, "x"), (None, 0, "user", "y"), (1, 1, "assistant", "hello")]
    turns = chat.turns_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.pair_id: r for r in chat.preferences(chat.parroted(turns)).collect()}
    assert set(got) == {1, 3} and got[1].prompt == "<|user|>\nhi<|end|>\n" and got[1].chosen == "<|assistant|>\nhello<|end|>\n" and got[1].rejected == "<|assistant|>\nhi<|end|>\n"
    assert [s.text for s in got[1].chosen_segments if s.train] == ["hello<|end|>\n"]


def test_hidden_markov(spark, docs, empty):
    model = hmm.Model(np.full(8, 1 / 8), np.full((8, 8), 1 / 8), np.random.default_rng(1).dirichlet(np.ones(3), 8))
    total = sum(10 ** hmm.forward(model, np.array([a, b, c]), np.array([3]), np.array([0]))[0] for a in range(3) for b in range(3) for c in range(3))
    assert math.isclose(total, 1.0)
    got = {r.doc_id: r for r in hmm.lm_scores(docs).collect()}
    counts, n = defaultdict(int), 0
    for i, t, *_ in corpus():
        if not hmm.held_out(i):
            n += 1
            for w in words_of(t, True):
                counts[w] += 1
    size, kinds = sum(counts.values()) + n, len(counts) + 1
    for i, t, *_ in corpus():
        seen = [counts[w] if w in counts else 0 for w in words_of(t, True)] + [n]
        assert math.isclose(got[i].base_score, sum(math.log10((c + 1) / (size + kinds + 1)) for c in seen)) and got[i].n_known == sum(c > 0 for c in seen) and got[i].train_tokens == size
        assert np.isfinite(got[i].score) and got[i].score <= 0
    assert hmm.lm_scores(empty).count() == 0


def test_expected_counts_and_scores_sum_over_all_paths():
    """Three states: forward and Baum-Welch equal sums over every path of states, wherever texts are cut into stretches."""
    from itertools import product

    draw, k, n_classes = np.random.default_rng(3), 3, 4
    model = hmm.Model(draw.dirichlet(np.ones(k)), draw.dirichlet(np.ones(k), k), draw.dirichlet(np.ones(n_classes), k))
    lengths = np.array([7, 1, 5, 8])
    classes, starts = draw.integers(0, n_classes, lengths.sum()), np.cumsum(lengths) - lengths
    begun, moved, emitted, scores = np.zeros(k), np.zeros((k, k)), np.zeros((k, n_classes)), []
    for n, a in zip(lengths, starts):
        seen = classes[a : a + n]
        paths = {}
        for path in product(range(k), repeat=int(n)):
            paths[path] = model.start[path[0]] * model.emit[path[0], seen[0]] * np.prod([model.move[i, j] * model.emit[j, c] for i, j, c in zip(path, path[1:], seen[1:])])
        total = sum(paths.values())
        scores.append(math.log10(total))
        for path, p in paths.items():
            begun[path[0]] += p / total
            for t in range(n):
                emitted[path[t], seen[t]] += p / total
                if t:
                    moved[path[t - 1], path[t]] += p / total
    for size in (1, 2, 3, 100):
        assert np.allclose(hmm.forward(model, classes, lengths, starts, size), scores)
        for got, want in zip(hmm.expected_counts(model, classes, lengths, starts, size), (begun, moved, emitted)):
            assert np.allclose(got, want)


def test_counts_come_back_to_every_pack(spark, monkeypatch):
    """Small packs and few sent words give the same base scores; all texts held out, repeated rows, clashing columns."""
    rows = [(i, " ".join(words(i % 7, 40) + [f"only{i}"])) for i in range(60)] + [(3, " ".join(words(3, 40)))] * 2
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("score", "held_out", "pack", "h", "c", "at")})
    key = lambda df: sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in df.collect())
    want = key(hmm.lm_scores(frame, rounds=1))
    assert len(want) == 62
    monkeypatch.setattr(hmm, "SENT", 5)
    assert key(hmm.lm_scores(frame.repartition(7), rounds=1)) == want
    out = [(i, "a b c") for i in range(80) if hmm.held_out(i)]
    got = hmm.lm_scores(spark.createDataFrame(out, "doc_id long, text string")).collect()
    assert len(got) == len(out) and all(r.train_tokens == 0 and r.n_known == 0 and np.isfinite(r.score) for r in got)


def _nearest_by_force(ids, x, q, k):
    d = np.sqrt(((x - x[q]) ** 2).sum(1))
    d[q] = np.inf
    return ids[np.lexsort((ids, d))[:k]].tolist()


def test_neighbours(spark):
    draw = np.random.default_rng(5)
    x = draw.normal(size=(700, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(700, None), (800, [0.0] * 16), (900, [float("nan")] * 16), (1000, [None] * 16), (None, x[3].tolist()), (1, x[1].tolist())]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in ("rep", "key", "score", "rank", "g", "window")})
    got = neighbours.nearest(v, least=1024).toPandas()
    for q in range(0, 700, 100):
        assert got[got.query_id == q].sort_values("rank").vec_id.tolist() == _nearest_by_force(np.arange(700), x, q, 10)
    assert set(got.query_id) == set(range(0, 700, 100))
    cells = np.array([[a, b] for a in range(4) for b in range(4)])
    order = cells[np.argsort(neighbours.hilbert_keys(cells, 2))]
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()
    assert neighbours.nearest(v.limit(0)).count() == 0


def test_neighbours_ties_lengths_and_few_rows(spark):
    """Equal distances go to the smaller id, vectors of other lengths never meet, fewer candidates than k give all."""
    rows = [(0, [1.0, 0.0]), (5, [1.0, 2.0]), (3, [1.0, -2.0]), (9, [3.0, 0.0]), (100, [2.0, 2.0, 2.0]), (7, [1.0, 1.0, 1.0]), (200, [4.0])]
    got = sorted(map(tuple, neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()))
    assert got == [(0, 1, 3, 2.0), (0, 2, 5, 2.0), (0, 3, 9, 2.0), (100, 1, 7, math.sqrt(3.0))]


def test_neighbours_of_a_common_vector(spark):
    """A third of all rows are one vector: the tie goes to the smallest ids, each query leaves out itself only."""
    x = np.random.default_rng(8).normal(size=(900, 8))
    x[::3] = x[0]
    got = neighbours.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).toPandas()
    for q in (0, 300, 600):
        assert got[got.query_id == q].sort_values("rank").vec_id.tolist() == _nearest_by_force(np.arange(900), x, q, 10)
    assert set(got.query_id) == set(range(0, 900, 100))


def test_windows_find_nine_in_ten(spark):
    """Recall against brute force on 20,000 vectors without structure, and on clustered ones, where short windows do."""
    draw = np.random.default_rng(12)
    plain = draw.normal(size=(20_000, 64))
    clustered = draw.normal(size=(200, 64))[draw.integers(0, 200, 20_000)] + 0.2 * draw.normal(size=(20_000, 64))
    for x in (plain, clustered):
        got = neighbours.nearest(spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>"), every=200).toPandas()
        found = got.groupby("query_id").vec_id.agg(set)
        hits = [len(found[q] & set(_nearest_by_force(np.arange(20_000), x, q, 10))) for q in range(0, 20_000, 200)]
        assert np.mean(hits) >= 9.0


def test_neighbours_of_repeated_rows(spark):
    x = np.random.default_rng(6).normal(size=(60, 16))
    once = [(i, v.tolist()) for i, v in enumerate(x)]
    near = [(60, (x[0] + 0.001).tolist())]
    frame = lambda rows: neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    want = sorted(map(tuple, frame(once + near).collect()))
    assert len(want) == 10 and sorted(map(tuple, frame(once * 2 + near * 10).collect())) == want
    assert [r[2] for r in want] == _nearest_by_force(np.arange(61), np.vstack((x, x[0] + 0.001)), 0, 10)


def test_repeated_rows_and_clashing_columns(spark):
    """Rows that come twice: verdicts, groups, lines, preferences and ties among equal lines and documents."""
    base = "\n".join(" ".join(words(k, 12)) for k in range(8))
    rows = [(4, base, "en", "s", 0), (2, base, "en", "s", 0), (4, base, "en", "s", 0), (3, "", "en", "s", 0), (None, base, None, None, 0)]
    frame = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in ("node", "sketch", "a", "b", "label", "first", "key", "filed", "id", "rest", "lo", "hi", "bucket")})
    assert sorted((r.doc_id or 0, r.kept) for r in quality.quality_rules(frame).collect()) == [(0, True), (2, True), (3, False), (4, True), (4, True)]
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in neardup.near_duplicates(frame).collect()) == [(0, 0, True), (2, 2, True), (3, 3, True), (4, 2, False), (4, 2, False)]
    assert sorted((r.doc_id or 0) for r in neardup.keep_first(frame).collect()) == [0, 2, 3]
    # of equal lines the smallest document's first is the earliest
    report = {r.doc_id: (r.n_lines, r.n_equal, r.dropped) for r in linededup.line_report(frame).collect()}
    assert report[2] == (8, 0, "") and report[4] == (8, 8, "0,1,2,3,4,5,6,7") and report[None] == (8, 0, "")
    assert sorted((r.doc_id or 0, len(r.text)) for r in linededup.without_duplicate_lines(frame).collect()) == [(0, len(base)), (2, len(base)), (3, 0), (4, 0), (4, 0)]


def test_preferences_of_any_sides(spark):
    """A null side, prefixes of unequal length, equal sides, clashing columns, an empty table."""
    turns = "array<struct<role: string, text: string>>"
    u, a, b = ("user", "q"), ("assistant", "yes"), ("assistant", "no")
    rows = [(1, [u, a], None), (2, [u, a, u, a], [u, a]), (3, [u, a], [u, a]), (4, None, None), (5, [u, a], [u, b])]
    frame = spark.createDataFrame(rows, f"pair_id long, chosen {turns}, rejected {turns}").withColumns({c: F.lit("x") for c in ("prompt", "n_prompt", "prefers", "chosen_tail")})
    got = {r.pair_id: r for r in chat.preferences(frame).collect()}
    assert {k: (r.n_prompt_turns, r.prefers) for k, r in got.items()} == {1: (0, True), 2: (2, True), 3: (2, False), 4: (0, False), 5: (1, True)}
    assert got[1].rejected == "" and got[5].chosen == "<|assistant|>\nyes<|end|>\n" and got[2].chosen.startswith("<|user|>")
    assert chat.preferences(frame.limit(0)).count() == 0
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.preferences(chat.parroted(chat.turns_of(empty))).count() == 0


def test_edit_distance_is_banded_and_exact(spark):
    """The bit-parallel distance, with common ends left out, against Spark's own; crowded keys split without losing a pair."""
    draw, rows = random.Random(13), []
    for _ in range(300):
        x = "".join(draw.choice("abcé ") for _ in range(draw.randint(20, 60)))
        y = list(x)
        for _ in range(draw.randint(0, 4)):
            k = draw.randrange(len(y))
            y[k : k + draw.randint(0, 1)] = draw.choice(["", "z", "q"])
        rows.append((x, "".join(y) + "x" * max(0, 20 - len(y))))
    pairs = spark.createDataFrame(rows, "x string, y string").withColumn("true", F.levenshtein("x", "y")).filter("abs(length(x) - length(y)) <= 2")
    for r in linededup.trimmed(pairs, "x", "y", 2).withColumn("d", linededup.banded_distance(F.col("x"), F.col("y"), 2)).collect():
        assert r.d == r.true if r.true <= 2 else r.d > 2
    head = "the very same beginning of every line, "
    lines = [head + "".join(draw.choice("abcdefgh") for _ in range(30)) for _ in range(150)]
    near = [x[:45] + "Z" + x[46:] for x in lines[::10]]
    frame = spark.createDataFrame([(0, "\n".join(lines)), (1, "\n".join(near))], "doc_id long, text string")
    got = {r.doc_id: r.n_near for r in linededup.line_report(frame).collect()}
    assert got == {0: 0, 1: len(near)}


def test_pipeline(spark, docs):
    now = docs.drop("node", "key", "kept", "line", "size", "taken", "n_words", "c")
    stages = dict(corpus_pipeline.STAGES)
    good = {r.doc_id for r in stages["quality_rules"](spark, now, "").collect()}
    assert {0, 1, 2, 8} <= good and 9 not in good and 3 not in good
    assert {r.doc_id for r in stages["minhash_near_dedup"](spark, now, "").filter("doc_id < 3").collect()} == {0}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, now, "").columns == now.columns, name


def test_pipeline_end_to_end_against_brute_force(spark, tmp_path):
    """run() over a small table: each stage's rows by the operators' brute-force counterparts, chained."""
    import re

    draw = random.Random(15)
    text = lambda k, n=9: "\n".join(" ".join(words(1000 * k + j, 14)) for j in range(n))
    rows = [(i, text(i), "en", ["a", "b", None][i % 3], 0) for i in range(30)]
    rows += [(30, rows[3][1], "en", "a", 0), (31, rows[4][1] + "\n" + text(77, 1), "en", "b", 0), (32, "### " * 200, "en", "a", 0), (33, None, "en", "a", 0), (34, "few words", "en", "a", 0), (35, text(50, 4) + "\n" + rows[6][1].split("\n")[0], "en", "b", 0)]
    draw.shuffle(rows)
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    got = {(r.doc_id, r.n_tokens, r.decoded_sha256) for r in out}
    # quality: too few words, or a symbol for every word
    left = {i: t for i, t, *_ in rows if t and len(t.split()) >= 50 and "#" not in t}
    # lines: a line goes if it was seen before (no two others here are within two edits)
    seen = set()
    for i in sorted(left):
        lines = [x for x in left[i].split("\n") if not (re.search(r"\S", x) and x in seen)]
        seen |= set(left[i].split("\n"))
        left[i] = "\n".join(lines)
    # near copies: after line dedup nothing but empty texts is alike, and these are linked with nothing
    sets = {i: shingles(t) for i, t in left.items()}
    assert not any(a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) for a in sets for b in sets)
    # mixing: documents without words are out, the others appear as often as the words taken from them come to, two times at most
    encode = _tiktoken().encode_ordinary
    possible = {(i, len(encode(t)), hashlib.sha256(t.encode()).hexdigest()) for i, t in left.items() if t}
    assert got <= possible and len(got) >= 0.6 * len(possible)
    counts = defaultdict(int)
    for r in out:
        counts[r.doc_id] += 1
    taken = mixing.mix(spark.createDataFrame([(i, t, None, next(r[3] for r in rows if r[0] == i), 0) for i, t in left.items()], DOCS)).collect()
    for r in taken:
        assert counts.get(r.doc_id, 0) in ({0} if not r["size"] else {r.taken // r["size"], -(-r.taken // r["size"])})
    assert {k for k, _, _ in got} == {k for k in counts}
