"""Problem 6: filling fixed-capacity containers with texts.

Method: first-fit decreasing.  The leftmost container with room is found by a tournament tree over the containers' free
capacities, in O(log n) an item; it runs independently in randomised groups of documents.

Scale: texts are read once and never shuffled - only (doc_id, size) is.  The group of a document is a hash of its id
modulo a number of groups that grows with the corpus, so groups have about ``group_rows`` documents whatever the data
look like, and each leaves about one container part-filled.

Defined results: null or empty text - one entry of no tokens, in the group's first container; rows of one doc_id are one
document (the longest); null doc_id - ignored; a text over the capacity is cut into full containers and a rest, which is
packed like any other item.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.lru_cache(maxsize=2)
def encoding(path: str):
    """The tokenizer of a rank file; loaded once in each Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, *, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens)`` of each row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(vocabulary)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["i"], "n_tokens": [len(enc.encode_ordinary(t)) if t else 0 for t in pdf["t"]]})

    return documents.select(F.col(id_col).cast("bigint").alias("i"), F.col(text_col).alias("t")).where("i is not null").mapInPandas(run, "doc_id bigint, n_tokens bigint")


class TournamentTree:
    """Free capacities of containers that are opened as needed; ``place`` gives the first that has room."""

    def __init__(self, capacity: int):
        self.capacity, self.width, self.opened = capacity, 1, 0
        self.tree = [capacity, capacity]

    def place(self, size: int) -> int:
        if self.tree[1] < size:  # none has room, not even those that are not opened: twice as many
            old, w = self.tree, self.width
            self.width = 2 * w
            self.tree = [0] * (2 * self.width)
            self.tree[self.width : self.width + w] = old[w:]
            self.tree[self.width + w :] = [self.capacity] * w
            for i in range(self.width - 1, 0, -1):
                self.tree[i] = max(self.tree[2 * i], self.tree[2 * i + 1])
        tree, i = self.tree, 1
        while i < self.width:
            i *= 2
            if tree[i] < size:
                i += 1
        tree[i] -= size
        at = i - self.width
        self.opened = max(self.opened, at + 1)
        i //= 2
        while i:
            tree[i] = max(tree[2 * i], tree[2 * i + 1])
            i //= 2
        return at


def first_fit_decreasing(items: list[tuple[int, int]], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """``items``: (id, size).  Gives (container, position, id, start, end); ties in size are broken by id and start."""
    pieces = []
    for i, n in items:
        full = n // capacity * capacity
        pieces += [(capacity, i, s) for s in range(0, full, capacity)]
        if n > full or n == 0:
            pieces.append((n - full, i, full))
    pieces.sort(key=lambda p: (-p[0], p[1], p[2]))
    tree, filled, out = TournamentTree(capacity), {}, []
    for n, i, s in pieces:
        c = tree.place(n) if n else 0
        filled[c] = filled.get(c, -1) + 1
        out.append((c, filled[c], i, s, s + n))
    return out


def pack(documents: DataFrame, *, capacity: int = 2048, vocabulary: str = VOCABULARY, group_rows: int = 8192, seed: int = 7) -> DataFrame:
    """``(container, position, doc_id, token_start, token_end)``; the container's number holds its group in the upper bits."""
    sizes = token_counts(documents, vocabulary=vocabulary).groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens"))
    groups = max(1, round(documents.select("doc_id").count() / group_rows))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g = int(pdf["g"].iloc[0])
        rows = first_fit_decreasing(list(zip(pdf["doc_id"].tolist(), pdf["n_tokens"].tolist())), capacity)
        out = pd.DataFrame(rows, columns=["container", "position", "doc_id", "token_start", "token_end"])
        out["container"] += g << 32
        return out

    return sizes.withColumn("g", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(groups))).groupBy("g").applyInPandas(run, "container bigint, position int, doc_id bigint, token_start bigint, token_end bigint")
