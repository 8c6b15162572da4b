"""LM scoring by a hidden Markov model: Baum-Welch over partitions, scaled forward recursion.

Vocabulary and emissions. A word belongs to one class: the MOST_FREQUENT commonest training words are classes of
their own, every other word shares one of TAILS classes chosen by a hash of its last three bytes. A state emits a class, and a
class emits a word w with (c(w) + 1) / (c(class) + distinct(class) + 1), so words never seen keep a share in each class.
The end of a text is a token of its own with a class of its own. The table of emissions has at most
STATES x (MOST_FREQUENT + TAILS + 1) numbers at any size of corpus, while the counts behind it cover all training text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, slices, words_of

STATES, MOST_FREQUENT, TAILS, ROUNDS = 8, 4096, 1024, 6
#: A long text's stretches of this many tokens are worked through side by side; what one hands to the next is carried exactly.
STRETCH = 1024
#: Counts of the commonest words are sent to all tasks (16 bytes each), so that no common word is a row for every pack in one task.
SENT = 65_536
#: Stretches that are worked through at once.
TOGETHER = 4096
#: Alphas are scaled at every so many tokens and at a stretch's last: between, no product of so few probabilities leaves the range of doubles.
SCALED = 8
#: Bytes of text whose tokens share one dictionary.
PACK = 6_000_000
_END = -1


def held_out(doc_id: int | None) -> bool:
    """crc32 of the id's decimal digits, mod 7, is 2 (no id: false)."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def _encode(batches: Iterator) -> Iterator:
    """Packs of documents: a dictionary of words with hash, tail class and training count, and documents as places in it.

    The end of text is not in the dictionary; place -1 stands for it.
    """
    import pyarrow as pa
    import xxhash

    def packed(ids, lengths, places, words):
        order = list(words)
        places, use = np.concatenate(places), np.array([not held_out(i) for i in ids], bool)
        counts = np.bincount(places[np.repeat(use, lengths) & (places != _END)], minlength=len(order))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, order), np.uint64, len(order))
        tails = np.fromiter((xxhash.xxh32_intdigest(w[-3:]) % TAILS for w in order), np.int32, len(order))
        pack = int(xxhash.xxh64_intdigest(np.concatenate((np.array([i if i is not None else -1 for i in ids], np.int64).view(np.uint64), hashes)).tobytes())) >> 1
        one = lambda x, t: pa.array([x], pa.list_(t))
        return pa.RecordBatch.from_pydict({
            "pack": pa.array([pack], pa.int64()), "ids": one(ids, pa.int64()), "lengths": one(lengths, pa.int32()), "places": one(places, pa.int32()),
            "hashes": one(hashes.view(np.int64), pa.int64()), "tails": one(tails, pa.int32()), "counts": one(counts, pa.int64())})

    state, size = None, 0
    for batch in slices(batches, "text", 1_000_000):
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            if state is None:
                state, size = ([], [], [], {}), 0
            ids, lengths, places, words = state
            found = words_of(text, lower=True)
            at = list(map(words.get, found))
            if None in at:
                at = [words.setdefault(w, len(words)) for w in found]
            ids.append(doc)
            lengths.append(len(at) + 1)
            places.append(np.array([*at, _END], np.int32))
            size += len(text or "") + 8
            if size >= PACK:
                yield packed(*state)
                state = None
    if state is not None:
        yield packed(*state)


_PACKS = "pack long, ids array<long>, lengths array<int>, places array<int>, hashes array<long>, tails array<int>, counts array<long>"


class Model:
    """Start, transition and class emission probabilities; classes: 0 the end, then frequent words, then tails."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What is sent to the executors, which need no copy of this class."""
        return self.start, self.move, self.emit

    @classmethod
    def first(cls, class_counts: np.ndarray, seed: int = 7) -> Model:
        """Corpus shares of the classes, tilted apart state by state, and states that tend to stay."""
        draw = np.random.default_rng(seed)
        emit = (class_counts + 0.5)[None, :] * draw.gamma(4.0, 0.25, (STATES, len(class_counts)))
        move = np.full((STATES, STATES), 0.1 / max(1, STATES - 1))
        np.fill_diagonal(move, 0.9)
        return cls(np.full(STATES, 1 / STATES), move, emit / emit.sum(1, keepdims=True))

    @classmethod
    def of(cls, start: np.ndarray, move: np.ndarray, emit: np.ndarray, class_counts: np.ndarray) -> Model:
        """From expected counts, each state's emissions smoothed by half a count spread as in the corpus."""
        prior = (class_counts + 0.5) / (class_counts + 0.5).sum()
        emit = emit + 50 * prior[None, :]
        return cls((start + 0.5) / (start + 0.5).sum(), (move + 0.5) / (move + 0.5).sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))


class Stretches(NamedTuple):
    """Texts cut after each STRETCH tokens: length, start and text of each stretch, and whether it begins its text."""

    lengths: np.ndarray
    starts: np.ndarray
    text: np.ndarray
    first: np.ndarray


def stretches(lengths: np.ndarray, starts: np.ndarray, size: int = STRETCH) -> Stretches:
    parts = -(-lengths // size)
    text = np.repeat(np.arange(len(lengths)), parts)
    step = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
    return Stretches(np.minimum(size, lengths[text] - step * size), starts[text] + step * size, text, step == 0)


def _sweep(move: np.ndarray, emit: np.ndarray, classes: np.ndarray, lengths: np.ndarray, starts: np.ndarray, prior: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """The forward recursion over stretches side by side, step by step: (which stretches, their tokens' classes, emissions there, alphas, due, scales).

    prior (n, k, STATES): what each of a stretch's k chains expects of its first token. The alphas from place `due` on are scaled to a sum of one:
    all of them at every SCALED-th token, else those of the stretches that end there.
    """
    order = np.argsort(-lengths, kind="stable")
    left = np.searchsorted(-lengths[order], -np.arange(1, (lengths.max() if len(lengths) else 0) + 1), side="right")
    begin, alpha, ones = starts[order], None, np.ones(prior.shape[1] * prior.shape[2])
    for t, n in enumerate(left):
        seen = classes[begin[:n] + t]
        here = emit[seen]
        alpha = prior[order] if alpha is None else (alpha[:n].reshape(-1, len(move)) @ move).reshape(n, *alpha.shape[1:])
        alpha *= here[:, None, :]
        due = 0 if t % SCALED == SCALED - 1 else left[t + 1] if t + 1 < len(left) else 0
        scale = alpha[due:].reshape(n - due, len(ones)) @ ones  # a product sums short rows faster than sum() does
        alpha[due:] /= scale[:, None, None]
        yield order[:n], seen, here, alpha, due, scale


def _boundaries(model: Model, classes: np.ndarray, s: Stretches) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What each stretch is handed: the alphas before it, what they make expected at its first token, and the backward value after its last.

    A stretch acts on the alphas before it as one matrix (chains begun in each state); the product of a text's matrices, in
    either direction, gives both. Only stretches that continue a text need a matrix.
    """
    n, k = len(s.text), len(model.start)
    handed, prior, beyond = np.zeros((n, k)), np.repeat(model.start[None, :], n, 0), np.ones((n, k))
    more = np.nonzero(~s.first)[0]
    if not len(more):
        return handed, prior, beyond
    emit = np.ascontiguousarray(model.emit.T)
    through = np.empty((len(more), k, k))
    for which, _, _, alpha, due, _ in _sweep(model.move, emit, classes, s.lengths[more], s.starts[more], np.repeat(model.move[None], len(more), 0)):
        through[which[due:]] = alpha[due:]
    heads = more[s.first[more - 1]] - 1
    ends = np.empty((n, k))
    for which, _, _, alpha, due, _ in _sweep(model.move, emit, classes, s.lengths[heads], s.starts[heads], prior[heads][:, None, :]):
        ends[heads[which[due:]]] = alpha[due:, 0]
    of = np.full(n, -1)
    of[more] = np.arange(len(more))
    now = heads
    while len(now := now[(now + 1 < n)][~s.first[now[now + 1 < n] + 1]]):  # the texts that go on, one stretch further
        step = now + 1
        handed[step] = ends[now]
        prior[step] = ends[now] @ model.move
        onward = np.einsum("ni,nij->nj", ends[now], through[of[step]])
        ends[step] = onward / onward.sum(1, keepdims=True)
        now = step
    last = np.nonzero(np.append(s.first[1:], True))[0]
    now = last[~s.first[last]]
    while len(now):
        back = np.einsum("nij,nj->ni", through[of[now]], beyond[now])
        beyond[now - 1] = back / (ends[now - 1] * back).sum(1, keepdims=True)
        now = (now - 1)[~s.first[now - 1]]
    return handed, prior, beyond


def forward(model: Model, classes: np.ndarray, lengths: np.ndarray, starts: np.ndarray, size: int = STRETCH) -> np.ndarray:
    """log10 probability of each text's classes, by the forward recursion, scaled as it goes."""
    s = stretches(lengths, starts, size)
    _, prior, _ = _boundaries(model, classes, s)
    total, emit = np.zeros(len(s.text)), np.ascontiguousarray(model.emit.T)
    for which, _, _, _, due, scale in _sweep(model.move, emit, classes, s.lengths, s.starts, prior[:, None, :]):
        total[which[due:]] += np.log10(scale)
    return np.bincount(s.text, weights=total, minlength=len(lengths))


def expected_counts(model: Model, classes: np.ndarray, lengths: np.ndarray, starts: np.ndarray, size: int = STRETCH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Baum-Welch's expected starts, moves and emissions over whole texts, by scaled forward and backward passes."""
    k, move, emit = len(model.start), model.move, np.ascontiguousarray(model.emit.T)
    begun, moved, emitted = np.zeros(k), np.zeros((k, k)), np.zeros((k, model.emit.shape[1]))
    s = stretches(lengths, starts, size)
    handed, prior, beyond = _boundaries(model, classes, s)
    for a in range(0, len(s.text), TOGETHER):
        part = slice(a, a + TOGETHER)
        steps = [(seen, here, alpha[:, 0], due, scale) for _, seen, here, alpha, due, scale in _sweep(move, emit, classes, s.lengths[part], s.starts[part], prior[part][:, None, :])]
        order, ahead, over = np.argsort(-s.lengths[part], kind="stable"), None, np.zeros((k, k))
        seen = np.concatenate([x[0] for x in steps])
        gamma, at = np.empty((len(seen), k)), len(seen)
        beta = beyond[part][order]  # of each stretch, as yet after its last token
        for t in range(len(steps) - 1, -1, -1):
            _, here, alpha, due, scale = steps[t]
            n = len(here)
            if ahead is not None:
                m = len(ahead)
                over += alpha[:m].T @ ahead
                beta[:m] = ahead @ move.T
            at -= n
            np.multiply(alpha, beta[:n], out=gamma[at : at + n])
            ahead = beta[:n] * here
            ahead[due:] /= scale[:, None]
        first = s.first[part][order]
        begun += gamma[: len(first)][first].sum(0)
        # the move over a boundary goes from what the stretch before handed on
        over += handed[part][order][~first].T @ ahead[~first]
        moved += move * over
        for i in range(k):
            emitted[i] += np.bincount(seen, weights=gamma[:, i], minlength=emitted.shape[1])
    return begun, moved, emitted


def _array(column, i: int = 0) -> np.ndarray:
    return column[i].values.to_numpy(zero_copy_only=False)


_CLASSED = "lengths array<int>, classes binary"  # 16 bits a token, as bytes: arrays of a million elements are slow to write and read


def _classed(shared):
    """Classes of the tokens of training texts, which do not change from round to round."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        keys, classes_of = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                ids, lengths = batch.column("ids")[i].as_py(), _array(batch.column("lengths"), i).astype(np.int64)
                use = np.array([not held_out(x) for x in ids], bool)
                places = _array(batch.column("places"), i)[np.repeat(use, lengths)]
                classes = _classes(_array(batch.column("hashes"), i), _array(batch.column("tails"), i), keys, classes_of)[places]
                yield pa.RecordBatch.from_pydict({"lengths": pa.array([lengths[use]], pa.list_(pa.int32())), "classes": pa.array([classes.astype("<i2").tobytes()], pa.binary())})

    return run


def _trainer(shared):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        model, sums = Model(*shared.value), None
        for batch in batches:
            for i in range(batch.num_rows):
                lengths = _array(batch.column("lengths"), i).astype(np.int64)
                if len(lengths):
                    got = expected_counts(model, np.frombuffer(batch.column("classes")[i].as_buffer(), "<i2").astype(np.int64), lengths, np.cumsum(lengths) - lengths)
                    sums = got if sums is None else tuple(x + y for x, y in zip(sums, got))
        if sums is not None:
            from pyspark import TaskContext

            flat = np.concatenate([x.ravel() for x in sums])
            salt = TaskContext.get().partitionId() % _SALTS
            pieces = [flat[i : i + _PIECE] for i in range(0, len(flat), _PIECE)]
            yield pa.RecordBatch.from_pydict({"slot": pa.array([k * _SALTS + salt for k in range(len(pieces))], pa.int32()), "sums": pa.array([x.tolist() for x in pieces], pa.list_(pa.float64()))})

    return run


def _sorted(keys: list[int], values) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(np.array(keys, np.int64))
    return np.array(keys, np.int64)[order], np.array(list(values), np.int64)[order]


def _found(hashes: np.ndarray, keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which hashes are among the sorted keys, and the values there."""
    if not len(keys):
        return np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    return keys[at] == hashes, values[at]


def _classes(hashes: np.ndarray, tails: np.ndarray, keys: np.ndarray, classes_of: np.ndarray) -> np.ndarray:
    """Class of each dictionary word, and class 0 at the end for place -1."""
    known, own = _found(hashes, keys, classes_of)
    return np.concatenate((np.where(known, own, 1 + MOST_FREQUENT + tails), [0])).astype(np.int64)


#: Sums travel in pieces of so many places, each to one of so many tasks.
_PIECE, _SALTS = 4096, 8


def _added(batches: Iterator) -> Iterator:
    """One sum for each slot of a partition."""
    import pyarrow as pa

    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, slot in enumerate(batch.column("slot").to_pylist()):
            x = _array(batch.column("sums"), i)
            sums[slot] = sums[slot] + x if slot in sums else x
    if sums:
        yield pa.RecordBatch.from_pydict({"slot": pa.array(list(sums), pa.int32()), "sums": pa.array([x.tolist() for x in sums.values()], pa.list_(pa.float64()))})


def _summed(parts: DataFrame, width: int) -> np.ndarray:
    """Sum of the tasks' arrays: added piece by piece in parallel; what reaches the driver is _SALTS arrays of bounded width at most."""
    out = np.zeros(width)
    for slot, x in parts.repartition("slot").mapInArrow(_added, "slot int, sums array<double>").collect():
        at = slot // _SALTS * _PIECE
        out[at : at + len(x)] += x
    return out


def lm_scores(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Scores of every row of (doc_id, text) under a model learnt from those not held out.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; scores are log10 probabilities, base_score those of
    single words by add-one counts, score those of the hidden Markov model.

    1. Texts become packs of about 6 MB with a dictionary each, written once.
    2. Corpus counts c(w) are summed by word with partial sums; N, V and sums per class follow. The SENT commonest words' counts are sent to all tasks; of
       the others only those that occur outside of a pack too return to it, keyed by pack, so no word is a row for every pack.
    3. Baum-Welch over whole texts: every round adds the partitions' expected counts place by place.
    4. The scaled forward recursion runs over each whole text; word-within-class probabilities come on top.

    Null or empty texts have the end token only; rows without doc_id are training text. Repeated rows each count and get a
    score. An empty table gives no rows; a table all held out has N = 0 and uniform shares. Extra columns are ignored.
    """
    spark = docs.sparkSession
    packs = keep(docs.select("doc_id", "text").mapInArrow(_encode, _PACKS), "packs", large_rows=True)
    entries = packs.select("pack", F.posexplode(F.arrays_zip("hashes", "tails", "counts")).alias("at", "z")).select("pack", "at", F.col("z.hashes").alias("h"), "z.tails", "z.counts")
    counted = keep(entries.groupBy("h").agg(F.sum("counts").alias("c"), F.min("tails").alias("tail")).filter("c > 0"), "counts")
    trained = docs.agg(F.count_if(F.col("doc_id").isNull() | (F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) != 2))).first()[0]
    tokens, distinct = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    total, vocabulary = tokens + trained, distinct + (trained > 0)
    sent = keep(counted.orderBy(F.col("c").desc(), "h").limit(SENT), "sent-words")
    sent_rows = sorted(sent.collect(), key=lambda r: (-r.c, r.h))
    top = sent_rows[:MOST_FREQUENT]
    frequent = _sorted([r.h for r in top], range(1, 1 + len(top)))
    common = _sorted([r.h for r in sent_rows], [r.c for r in sent_rows])
    own = {r.tail: (r.n, r.v) for r in counted.groupBy("tail").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    class_tokens, class_words = np.zeros(1 + MOST_FREQUENT + TAILS), np.zeros(1 + MOST_FREQUENT + TAILS)
    class_tokens[0], class_words[0] = trained, 1
    for tail, (n, v) in own.items():
        class_tokens[1 + MOST_FREQUENT + tail], class_words[1 + MOST_FREQUENT + tail] = n, v
    for i, r in enumerate(top):
        class_tokens[1 + i], class_words[1 + i] = r.c, 1
        class_tokens[1 + MOST_FREQUENT + r.tail] -= r.c
        class_words[1 + MOST_FREQUENT + r.tail] -= 1

    model = Model.first(class_tokens)
    width = STATES + STATES * STATES + STATES * len(class_tokens)
    if trained:
        classed = keep(packs.select("ids", "lengths", "places", "hashes", "tails").mapInArrow(_classed(spark.sparkContext.broadcast(frequent)), _CLASSED), "classes", large_rows=True)
        for _ in range(rounds):
            shared = spark.sparkContext.broadcast(model.arrays())
            sums = _summed(classed.mapInArrow(_trainer(shared), "slot int, sums array<double>"), width)
            model = Model.of(sums[:STATES], sums[STATES : STATES + STATES**2].reshape(STATES, STATES), sums[STATES + STATES**2 :].reshape(STATES, -1), class_tokens)
            shared.unpersist()

    # both lists are gathered row by row, so the k-th place belongs to the k-th count
    rest = entries.join(F.broadcast(sent.select("h")), "h", "left_anti").join(counted.select("h", "c"), "h").filter("c <> counts")
    answers = rest.groupBy("pack").agg(F.collect_list("at").alias("at"), F.collect_list("c").alias("c")).withColumnRenamed("pack", "_pack")
    joined = packs.join(answers, packs["pack"] == answers["_pack"], "left").select("ids", "lengths", "places", "hashes", "tails", "counts", "at", "c")
    shared = spark.sparkContext.broadcast((model.arrays(), frequent, common, class_tokens, class_words, total, vocabulary, trained))
    out = joined.mapInArrow(_scorer(shared), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def _scorer(shared):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        arrays, (keys, classes_of), common, class_tokens, class_words, total, vocabulary, trained = shared.value
        model = Model(*arrays)
        for batch in batches:
            for i in range(batch.num_rows):
                ids, lengths = batch.column("ids")[i].as_py(), _array(batch.column("lengths"), i).astype(np.int64)
                places = _array(batch.column("places"), i)
                hashes = _array(batch.column("hashes"), i)
                c = np.append(_array(batch.column("counts"), i), 0).astype(np.float64)  # right for words of this pack alone
                known, sent = _found(hashes, *common)
                c[:-1][known] = sent[known]
                if batch.column("c")[i].is_valid:
                    c[_array(batch.column("at"), i)] = _array(batch.column("c"), i)
                c[-1] = trained
                of = _classes(hashes, _array(batch.column("tails"), i), keys, classes_of)
                base = np.log10((c + 1) / (total + vocabulary + 1))
                # a frequent word has a class of its own; the other classes keep a share for words never seen
                within = np.log10((c + 1) / (class_tokens[of] + class_words[of] + 1))
                within[(of > 0) & (of <= MOST_FREQUENT)] = 0.0
                within[-1] = 0.0
                starts = np.cumsum(lengths) - lengths
                add = lambda x: np.add.reduceat(x[places], starts) if len(starts) else np.zeros(0)
                score = forward(model, of[places], lengths, starts) + add(within)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(ids, pa.int64()), "held_out": pa.array([held_out(x) for x in ids], pa.bool_()), "n_tokens": pa.array(lengths, pa.int64()),
                    "n_known": pa.array(add((c > 0).astype(np.int64)), pa.int64()), "base_score": pa.array(add(base), pa.float64()), "score": pa.array(score, pa.float64())})

    return run
