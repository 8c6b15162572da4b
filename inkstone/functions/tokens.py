"""Token counts by a byte-level tokenizer's rank file, as another measure of evidence cost."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from inkstone.functions.text import token_cost

#: Fixed value: the published pattern of pre-tokens of the common byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NAMES = ("auto", "tiktoken", "chars")
#: The session's setting that names the rank file of "auto".
SETTING = "spark.inkstone.ranks"
#: Texts that are encoded in one call.
TOGETHER = 256


def _encoding(ranks_file: bytes, pattern: str):
    import base64

    import tiktoken

    ranks = {base64.b64decode(word): int(rank) for word, rank in (line.split() for line in ranks_file.splitlines() if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def ranks_cost(path: str, pattern: str = PATTERN) -> Callable[[Column], Column]:
    """A cost function like token_cost: tokens of each text, one at least, none of them special.

    The rank file (some MB) is read on the driver and sent to the executors, where a task makes one encoder of it for all its batches.
    """
    with open(path, "rb") as f:
        shared = SparkSession.active().sparkContext.broadcast(f.read())

    @F.pandas_udf("long")
    def cost(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding = _encoding(shared.value, pattern)
        for texts in batches:
            said, counts = texts.fillna("").tolist(), []
            for a in range(0, len(said), TOGETHER):
                counts += [max(1, len(ids)) for ids in encoding.encode_ordinary_batch(said[a : a + TOGETHER], num_threads=1)]
            yield pd.Series(counts, dtype="int64")

    return cost


def counter(name: str = "auto", ranks: str | None = None) -> tuple[Callable[[Column], Column], str]:
    """Cost function and label of a counter: "chars" estimates, "tiktoken" needs a rank file, "auto" takes the rank file that is given or that the session's setting names, and else estimates."""
    if name not in NAMES:
        raise ValueError(f"tokenizer must be one of {NAMES}")
    if name == "auto" and not ranks:
        active = SparkSession.getActiveSession()
        ranks = active.conf.get(SETTING, None) if active else None
    if name == "tiktoken" and not ranks:
        raise ValueError("tiktoken needs a rank file")
    if name == "chars" or not ranks:
        return token_cost, "conservative-char-v1"
    return ranks_cost(ranks), "tiktoken-ranks"
