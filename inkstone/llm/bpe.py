"""Byte-level BPE: overlapping chunk encoding, and decoding to raw bytes."""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, slices

#: Characters of a chunk, and how many more it runs into the next one.
CHUNK, OVERLAP = 8192, 512
#: A text of more than so many chunks is dealt to several tasks.
DEALT = 64
#: A pre-token that ends so many characters before the end of a chunk is one of the whole text: the pattern looks two characters ahead at most ('re).
AHEAD = 2
_NEVER = 1 << 62


class Bpe:
    """A rank file's encoder and decoder; pre-tokens are encoded separately, and remembered in a bounded dictionary."""

    def __init__(self, ranks_file: bytes, pattern: str, limit: int = 500_000):
        import regex

        self._ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines()) if a}
        self._bytes = {v: k for k, v in self._ranks.items()}
        self.text_of = {i: str(i) for i in self._bytes}
        self._pattern = regex.compile(pattern)
        self._known: dict[str, tuple[int, ...]] = {}
        self._limit = limit

    def split(self, text: str) -> list[str]:
        """Pre-tokens of a text from its start on."""
        return self._pattern.findall(text)

    def merge(self, raw: bytes) -> tuple[int, ...]:
        """Ids of one pre-token: of all neighbouring parts, the pair of lowest rank merges first, the leftmost of equals."""
        ranks = self._ranks
        if raw in ranks:
            return (ranks[raw],)
        if len(raw) > 256:
            return self._merge_long(raw)
        parts = [raw[i : i + 1] for i in range(len(raw))]
        rank = [ranks.get(a + b, _NEVER) for a, b in zip(parts, parts[1:])]
        while rank and (least := min(rank)) < _NEVER:
            i = rank.index(least)
            parts[i] += parts.pop(i + 1)
            del rank[i]
            if i:
                rank[i - 1] = ranks.get(parts[i - 1] + parts[i], _NEVER)
            if i < len(rank):
                rank[i] = ranks.get(parts[i] + parts[i + 1], _NEVER)
        return tuple(map(ranks.__getitem__, parts))

    def _merge_long(self, raw: bytes) -> tuple[int, ...]:
        """The same with a heap of pairs and linked parts, for pre-tokens of any length."""
        ranks, n = self._ranks, len(raw)
        part = [raw[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 1, 1) for i in range(n - 1) if (r := ranks.get(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, m, k = heapq.heappop(heap)
            j = after[i]
            if part[i] is None or j >= n or len(part[i]) != m or len(part[j]) != k:
                continue  # one of the two has merged since
            part[i] += part[j]
            part[j] = None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] < n and (r := ranks.get(part[a] + part[after[a]])) is not None:
                    heapq.heappush(heap, (r, a, len(part[a]), len(part[after[a]])))
        return tuple(ranks[p] for p in part if p is not None)

    def encode_pieces(self, pieces: list[str]) -> list[int]:
        """Ids of pre-tokens, joined."""
        known, get = self._known, self._known.get
        if len(known) > self._limit:
            known.clear()
        out = [get(p) for p in pieces]
        if None in out:
            for i, ids in enumerate(out):
                if ids is None:
                    piece = pieces[i]
                    out[i] = ids = known.get(piece) or self.merge(piece.encode("utf-8"))
                    if len(piece) < 64:
                        known[piece] = ids
        return [i for ids in out for i in ids]

    def serial(self, text: str, chunk: int = 1 << 16) -> Iterator[list[str]]:
        """Pre-tokens of a text in order, some `chunk` characters at a time; a chunk without a certain end grows until it has one."""
        n, start = len(text), 0
        while start < n:
            end = start + chunk
            while True:
                found = self.split(text[start:end])
                if end < n:
                    upto = np.cumsum([len(x) for x in found]) + start
                    found = found[: int(np.searchsorted(upto, end - AHEAD, "right"))]
                if found:
                    break
                end += end - start
            yield found
            start += sum(map(len, found))

    def stitched(self, text: str, chunk: int, overlap: int) -> Iterator[list[str]]:
        """Pre-tokens of a text, chunk by chunk: each chunk is pre-tokenised by itself and gives what lies between its seams with its neighbours."""
        if len(text) <= chunk + overlap:
            yield self.split(text)
            return
        last = -(-(len(text) - overlap) // chunk) - 1
        before, seam = None, 0
        for i in range(last + 1):
            piece = text[i * chunk : (i + 1) * chunk + overlap]
            found = self.split(piece)
            sizes, ends, head, tail = shared_ends(found, len(piece), i == last, chunk, overlap)
            if before is not None:
                meet = np.intersect1d(before[2], head, assume_unique=True)
                if not len(meet):  # a word longer than the overlap: the rest goes in order from the last certain place
                    start = (i - 1) * chunk + seam
                    yield from self.serial(text[start:])
                    return
                yield own_pieces(before[0], before[1], seam, chunk + int(meet[0]))
                seam = int(meet[0])
            before = (found, ends, tail)
        yield own_pieces(before[0], before[1], seam, None)

    def decode(self, ids: list[int]) -> bytes:
        """Raw bytes of ids, joined without regard to character boundaries."""
        return b"".join(map(self._bytes.__getitem__, ids))


def shared_ends(pieces: list[str], size: int, last: bool, chunk: int, overlap: int) -> tuple[np.ndarray, ...]:
    """Lengths of a chunk's pre-tokens, where they end, and the certain ends in the parts that it shares with the chunk before and the chunk after."""
    sizes = np.fromiter(map(len, pieces), np.int32, len(pieces))
    ends = np.cumsum(sizes)
    certain = ends[: np.searchsorted(ends, size - (0 if last else AHEAD), "right")]
    return sizes, ends, certain[: np.searchsorted(certain, overlap, "right")], certain[np.searchsorted(certain, chunk, "left") :] - chunk


def own_pieces(pieces: list[str], ends: np.ndarray, seam: int, upto: int | None) -> list[str]:
    """A chunk's pre-tokens from its seam with the chunk before to that with the chunk after."""
    first = int(np.searchsorted(ends, seam, "right")) if seam else 0
    return pieces[first:] if upto is None else pieces[first : int(np.searchsorted(ends, upto, "right"))]


_SHARED: dict[tuple[bytes, str], Bpe] = {}


def _of(ranks_file: bytes, pattern: str) -> Bpe:
    """The worker's encoder; a reused worker keeps what it has learnt."""
    key = (hashlib.sha256(ranks_file).digest(), pattern)
    if key not in _SHARED:
        _SHARED.clear()
        _SHARED[key] = Bpe(ranks_file, pattern)
    return _SHARED[key]


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


class _Digest:
    """Number of ids, and hashes of their decimal text and of the decoded bytes, as ids come in."""

    def __init__(self, bpe: Bpe, keep_ids: bool):
        self.n, self.bpe, self.keep = 0, bpe, keep_ids
        self.ids_hash, self.bytes_hash, self.ids = hashlib.sha256(), hashlib.sha256(), []

    def add(self, ids: list[int]) -> None:
        if not ids:
            return
        self.ids_hash.update((" " * (self.n > 0) + " ".join(map(self.bpe.text_of.__getitem__, ids))).encode())
        self.bytes_hash.update(self.bpe.decode(ids))
        self.n += len(ids)
        if self.keep:
            self.ids += ids

    def row(self) -> tuple:
        return self.n, self.ids_hash.hexdigest(), self.bytes_hash.hexdigest(), self.ids


def _batch(rows: list[tuple], keys: dict, keep_ids: bool):
    import pyarrow as pa

    out = {**keys, "n_tokens": pa.array([r[0] for r in rows], pa.int64()), "ids_sha256": pa.array([r[1] for r in rows], pa.string()), "decoded_sha256": pa.array([r[2] for r in rows], pa.string())}
    return pa.RecordBatch.from_pydict(out | ({"ids": pa.array([r[3] for r in rows], pa.list_(pa.int32()))} if keep_ids else {}))


def _cut(chunk: int, overlap: int):
    """Overlapping chunks of each text, and a hash that tells texts of one doc_id apart."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        for batch in slices(batches, "text"):
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                print_ = xxhash.xxh3_64_intdigest(text.encode("utf-8")) - (1 << 63)
                last = max(0, -(-(len(text) - overlap) // chunk) - 1)
                rows += [(doc, print_, i, i == last, text[i * chunk : (i + 1) * chunk + overlap]) for i in range(last + 1)]
            types = (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.string())
            for a in range(0, len(rows), 256):
                yield pa.RecordBatch.from_pydict({n: pa.array([r[k] for r in rows[a : a + 256]], t) for k, (n, t) in enumerate(zip(("doc_id", "print", "chunk", "last", "piece"), types))})

    return run


def _pretokenise(shared, pattern: str, chunk: int, overlap: int):
    """Lengths of each chunk's pre-tokens, and where they end in the parts that it shares with the chunks before and after it."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        bpe = _of(shared.value, pattern)
        for batch in batches:
            lengths, heads, tails = [], [], []
            for piece, last in zip(batch.column("piece").to_pylist(), batch.column("last").to_pylist()):
                sizes, _, head, tail = shared_ends(bpe.split(piece), len(piece), last, chunk, overlap)
                lengths.append(sizes.tobytes())
                heads.append(head)
                tails.append(tail)
            more = {"lengths": pa.array(lengths, pa.binary()), "head": pa.array(heads, pa.list_(pa.int32())), "tail": pa.array(tails, pa.list_(pa.int32()))}
            yield pa.RecordBatch.from_arrays([*batch.columns, *more.values()], [*batch.schema.names, *more])

    return run


def _encode_chunks(shared, pattern: str, chunk: int):
    """Ids of each chunk's own pre-tokens, from its seam with the chunk before to that with the chunk after."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        bpe = _of(shared.value, pattern)
        for batch in batches:
            out = []
            for piece, lengths, first, after in zip(*(batch.column(c).to_pylist() for c in ("piece", "lengths", "seam", "next_seam"))):
                ends = np.cumsum(np.frombuffer(lengths, np.int32))
                at = [0, *ends.tolist()]
                own = own_pieces([piece[a:b] for a, b in zip(at, at[1:])], ends, first or 0, None if after is None else chunk + after)
                out.append(np.array(bpe.encode_pieces(own), np.int32).tobytes())
            keys = {c: batch.column(c) for c in ("doc_id", "print", "chunk", "copies")}
            yield pa.RecordBatch.from_pydict(keys | {"part": pa.array(out, pa.binary())})

    return run


def _join(shared, pattern: str, keep_ids: bool):
    """One row per text from its chunks' ids, which arrive in order."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        bpe = _of(shared.value, pattern)
        now, state, copies = None, None, 0

        def out():
            return _batch([state.row()], {"doc_id": pa.array([now[0]], pa.int64()), "copies": pa.array([copies], pa.int64())}, keep_ids)

        for batch in batches:
            for doc, print_, n, part in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "print", "copies", "part"))):
                if now != (doc, print_):
                    if state:
                        yield out()
                    now, state, copies = (doc, print_), _Digest(bpe, keep_ids), n
                state.add(np.frombuffer(part, np.int32).tolist())
        if state:
            yield out()

    return run


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str, keep_ids: bool = False, chunk: int = CHUNK, overlap: int = OVERLAP, dealt: int = DEALT) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text (null: as empty), and ids on demand.

    1. Texts are cut into chunks of `chunk` characters that run `overlap` characters into the next, and each is pre-tokenised by itself. The chunks of a text
       that has more than `dealt` of them are rows that go to several tasks, so that no task gets a very long text whole; those of others stay where they lie.
    2. Two neighbours are stitched at the first place in their overlap where pre-tokens of both end: what follows from there depends on the text
       ahead only, so both go on alike. A text with neighbours that never meet (a word longer than the overlap) is pre-tokenised in order instead.
    3. Each chunk encodes the pre-tokens between its two seams by the ranks; a text's ids and bytes are hashed in the order of its chunks, as they stream by.

    The rank file (under 1 MB) is read once on the driver and sent along, so executors need not have it. Repeated rows are encoded once and
    given as often as they come; null ids are like any other; extra columns are ignored; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_read(ranks_path))
    docs = docs.select("doc_id", "text")
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids

    def whole(batches: Iterator) -> Iterator:
        bpe = _of(shared.value, pattern)
        for batch in slices(batches, "text"):
            rows = []
            for text in batch.column("text").to_pylist():
                state = _Digest(bpe, keep_ids)
                for pieces in bpe.stitched(text, chunk, overlap) if text else ():
                    state.add(bpe.encode_pieces(pieces))
                rows.append(state.row())
            yield _batch(rows, {"doc_id": batch.column("doc_id")}, keep_ids)

    is_long = F.coalesce(F.length("text"), F.lit(0)) > dealt * chunk
    short = docs.filter(~is_long).mapInArrow(whole, schema)
    long = docs.filter(is_long)
    cut = long.mapInArrow(_cut(chunk, overlap), "doc_id long, print long, chunk int, last boolean, piece string")
    by = ["doc_id", "print", "chunk"]
    # one shuffle deals the chunks and makes equal rows one
    spread = cut.groupBy(*by).agg(F.any_value("last").alias("last"), F.any_value("piece").alias("piece"), F.count(F.lit(1)).alias("copies"))
    chunks = spread.mapInArrow(_pretokenise(shared, pattern, chunk, overlap), "doc_id long, print long, chunk int, last boolean, piece string, copies long, lengths binary, head array<int>, tail array<int>")
    chunks = keep(chunks, "chunks")
    same = lambda x, y, on: _null_safe([(f"{x}.{c}", f"{y}.{c}") for c in on])
    before = chunks.select("doc_id", "print", (F.col("chunk") + 1).alias("chunk"), "tail").alias("b")
    met = chunks.filter("chunk > 0").select(*by, "head").alias("a").join(before, same("a", "b", by))
    seams = keep(met.select("a.doc_id", "a.print", "a.chunk", F.array_min(F.array_intersect("head", "tail")).alias("seam")), "seams")
    apart = seams.filter("seam is null").select("doc_id", "print").distinct().alias("x")
    c, s = chunks.drop("head", "tail").alias("c"), seams.alias("s")
    after = seams.select("doc_id", "print", (F.col("chunk") - 1).alias("chunk"), F.col("seam").alias("next_seam")).alias("n")
    own = c.join(s, same("c", "s", by), "left").join(after, same("c", "n", by), "left").join(apart, same("c", "x", by[:2]), "left_anti")
    own = own.select(*[f"c.{x}" for x in by], "copies", "piece", "lengths", "seam", "next_seam")
    parts = own.mapInArrow(_encode_chunks(shared, pattern, chunk), "doc_id long, print long, chunk int, copies long, part binary")
    ordered = parts.repartition("doc_id", "print").sortWithinPartitions(*by)
    joined = ordered.mapInArrow(_join(shared, pattern, keep_ids), schema.replace("doc_id long", "doc_id long, copies long"))
    joined = joined.withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copies")
    # texts whose chunks don't all meet
    left = apart.select("doc_id").distinct().alias("l")
    again = long.alias("d").join(left, same("d", "l", ["doc_id"]), "left_semi").select("doc_id", "text")
    split = apart.select("doc_id", F.col("print").alias("_print")).alias("p")
    again = again.mapInArrow(_printed, "doc_id long, text string, _print long").alias("q").join(split, same("q", "p", ["doc_id", "_print"]), "left_semi")
    return short.unionByName(joined).unionByName(again.select("doc_id", "text").mapInArrow(whole, schema))


def _null_safe(pairs: list[tuple[str, str]]):
    on = F.lit(True)
    for a, b in pairs:
        on = on & F.col(a).eqNullSafe(F.col(b))
    return on


def _printed(batches: Iterator) -> Iterator:
    import pyarrow as pa
    import xxhash

    for batch in slices(batches, "text"):
        prints = [xxhash.xxh3_64_intdigest(x.encode("utf-8")) - (1 << 63) for x in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints, pa.int64())], [*batch.schema.names, "_print"])


def decode_ids(rows: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id and the decoded bytes of each row's array `ids` (null: as empty)."""
    shared = rows.sparkSession.sparkContext.broadcast(_read(ranks_path))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        bpe = _of(shared.value, pattern)
        for batch in batches:
            raw = pa.array([bpe.decode(x or []) for x in batch.column("ids").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "raw": raw})

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, raw binary")
