"""Windows of passages on their way between tasks."""

import numpy as np
import pyarrow as pa

from inkstone.llm import common, passages


def test_overlapping_windows_of_a_pair_are_joined_where_they_meet():
    """A task's windows of one pair go on as few rows, not as one each, and the pairs found stay the same."""
    rng = np.random.default_rng(5)
    texts = [" ".join(map(str, rng.integers(0, 10**6, 3000))) for _ in range(3)]
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3, 4, None], "text": [texts[0], texts[0] + " end", texts[1], texts[2] + " \x0b" + texts[1], texts[0]]})
    none = np.zeros(0, np.int64)
    plain = pa.Table.from_batches(list(passages._windows(50, none)(iter([batch]))))
    dealt = pa.Table.from_batches(list(passages._bucketed(50, none, 7)(iter([batch])))).sort_by("bucket")
    keys = np.frombuffer(b"".join(dealt["key"].to_pylist()), np.int64)
    assert sorted(keys.tolist()) == sorted(plain["key"].to_pylist()) and len(dealt) == 7
    met = pa.Table.from_batches(list(passages._meet(True)(iter(dealt.combine_chunks().to_batches(max_chunksize=2)))))
    assert len(met) <= 4
    found = passages._found_pairs(*(met.sort_by([("p", "ascending"), ("q", "ascending")])[n].to_numpy() for n in ("p", "q", "low", "high", "held")))
    assert list(zip(*(x.tolist() for x in found))) == [(1, 2), (3, 4)]


def test_runs_joined_early_are_those_joined_at_the_end():
    rng = np.random.default_rng(6)
    for _ in range(200):
        n = int(rng.integers(1, 60))
        low = rng.integers(0, 60, n)
        rows = [rng.integers(0, 3, n), rng.integers(0, 3, n), low, low + rng.integers(0, 12, n), 1 << rng.integers(0, 3, n)]
        cut = int(rng.integers(0, n + 1))
        parts = [passages._joined(*(x[part] for x in rows)) for part in (slice(0, cut), slice(cut, None))]
        early = passages._found_pairs(*(np.concatenate(x) for x in zip(*parts)))
        packed = (rows[2] << 35) | ((rows[3] - rows[2]) << 3) | np.log2(rows[4]).astype(np.int64)
        order = np.lexsort((packed, rows[1], rows[0]))
        late = passages.agreeing(*(x[order] for x in (rows[0], rows[1], packed)))
        brute = set()
        for p, q in {(a, b) for a, b in zip(rows[0].tolist(), rows[1].tolist())}:
            far, held = -1, 0
            for _, a, b, f in sorted((lo, lo, hi, f) for x, y, lo, hi, f in zip(*(c.tolist() for c in rows)) if (x, y) == (p, q)):
                far, held = (max(far, b), held | f) if a <= far else (b, f)
                if held.bit_count() >= passages.AGREE:
                    brute.add((p, q))
        assert set(zip(*(x.tolist() for x in early))) == set(zip(*(x.tolist() for x in late))) == brute


def test_words_of_a_column_are_hashed_as_single_texts_are():
    texts = ["", None, "  a  b ", "\x0b\x0c\r\nA\x1cB\x85C\u3000D e  ", "x", " ", "\u00c0B \u00c9C", "\x1f a\x00b"]
    one = common.WordHasher()
    expected = [one(common.words_of(x, lower=True)).tolist() for x in texts]
    hashes, sizes = common.hashed_words(pa.array(texts))
    assert sizes.tolist() == [len(x) for x in expected] and hashes.tolist() == sum(expected, [])
    assert [len(x) for x in common.hashed_words(pa.array([None, " "]))] == [0, 2]
