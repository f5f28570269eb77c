"""Problem 7: passages of evaluation texts in training text.

Method: spaced-seed hashing.  Fixed masks select some of the words of a window and ignore the others; hashes of test
windows and of training windows under the same mask are joined, and the two texts are then compared word by word
along the whole diagonal of the hit, once exactly and once with substitutions.  A mask that ignores a word still hits where
that word was replaced; every mask spans ``min_words`` words at most, so each of them alone hits every exact run.

Scale: the test side is a stated query set; it is cut into blocks of a bounded number of words, each broadcast to one
narrow, vectorised pass over the corpus.  Nothing of the corpus is shuffled but the final rows, so a passage that is in a
third of all documents is no hot key.  A bitmap rejects nearly all windows before the exact lookup.  Hits are verified in
portions of bounded size, so a passage that many test items share fills no memory; a diagonal is compared as a whole
whichever of its hits is looked at, so portions do not change the result.

Defined results: null or empty texts and texts shorter than ``min_words`` share nothing; rows of one doc_id or item_id
are one text each (their results are merged); several hits of one pair give one row, with its longest overlap.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The spaced masks, 1 for a word that counts and 0 for one that is ignored.
MASKS = ("110110101101", "101101110110", "111001011011")
#: Words of test texts in one block.
BLOCK_WORDS = 2_000_000
#: Hits that are verified at once.
PORTION = 500_000
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Maximal runs of Unicode letters and digits, lower-cased."""
    return _WORD.findall(text.lower()) if text else []


def _hashes(ids: np.ndarray, mask: str, factors: np.ndarray) -> np.ndarray:
    """The hash of the window at each place of ``ids``; windows that reach beyond the end are left out."""
    n = len(ids) - len(mask) + 1
    h = np.zeros(max(0, n), dtype=np.uint64)
    if n > 0:
        for k, bit in enumerate(mask):
            if bit == "1":
                h += ids[k : k + n] * factors[k]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h


class _Index:
    """Test windows of one block, under all masks."""

    def __init__(self, items: list[tuple[int, str]], masks: tuple[str, ...]):
        self.masks, self.span = masks, len(masks[0])
        rng = np.random.default_rng(11)
        self.factors = rng.integers(1, 2**63, size=self.span, dtype=np.uint64) | np.uint64(1)
        self.vocab: dict[str, int] = {}
        gap, starts, flat = [0] * self.span, [], []
        for _, t in items:
            starts.append(len(flat))
            flat += [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words(t)] + gap
        self.ids = np.array(flat, dtype=np.int64)
        self.item = np.array([i for i, _ in items], dtype=np.int64)
        self.starts = np.array(starts, dtype=np.int64)
        self.code = rng.integers(1, 2**63, size=len(self.vocab) + 1, dtype=np.uint64)
        self.tables = []
        bad = np.concatenate([[0], np.cumsum(self.ids == 0)])
        for m in masks:
            h = _hashes(self.code[self.ids], m, self.factors)
            whole = np.flatnonzero(bad[self.span : self.span + len(h)] == bad[: len(h)]) if len(h) else np.zeros(0, dtype=np.int64)
            order = whole[np.argsort(h[whole], kind="stable")]
            bits = np.zeros(1 << 22, dtype=bool)
            bits[(h[whole] >> np.uint64(42)).astype(np.int64)] = True
            self.tables.append((h[order], order, bits))

    def hits(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place in ``ids``, place in the test words) of all windows that agree under a mask, in portions."""
        code = self.code[ids]
        # Word 0 stands for every word that no test text has, and for the gap between texts; verification rejects it.
        for m, (keys, order, bits) in zip(self.masks, self.tables):
            h = _hashes(code, m, self.factors)
            c = np.flatnonzero(bits[(h >> np.uint64(42)).astype(np.int64)]) if len(h) else np.zeros(0, dtype=np.int64)
            lo = np.searchsorted(keys, h[c], "left")
            n = np.searchsorted(keys, h[c], "right") - lo
            c, lo, n = c[n > 0], lo[n > 0], n[n > 0]
            part = np.cumsum(n) // PORTION
            for p in range(int(part[-1]) + 1 if len(part) else 0):
                a, b = np.searchsorted(part, p, "left"), np.searchsorted(part, p, "right")
                k = n[a:b]
                yield np.repeat(c[a:b], k), order[np.repeat(lo[a:b], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)]

    def verify(self, ids: np.ndarray, starts: np.ndarray, at: np.ndarray, to: np.ndarray, most_wrong: float, done: set | None = None) -> pd.DataFrame:
        """For each diagonal of a text of ``ids`` (they begin at ``starts``) and a test text that was hit: the longest run of equal
        words, and the longest overlap with substitutions around it.  ``text`` is the number of the text.  Diagonals in ``done`` are
        left out, the others added to it."""
        out = []
        done = set() if done is None else done
        text, test = np.searchsorted(starts, at, "right") - 1, np.searchsorted(self.starts, to, "right") - 1
        begin, test_begin = starts[text] if len(text) else text, self.starts[test] if len(test) else test
        # A diagonal by its place: how far the test text begins before or after the text.
        shift = (at - begin) - (to - test_begin)
        ends, test_ends = np.r_[starts[1:], len(ids)] - self.span, np.r_[self.starts[1:], len(self.ids)] - self.span
        for x, y, d in np.unique(np.stack([text, test, shift], axis=1), axis=0).tolist() if len(at) else ():
            if (x, y, d) in done:
                continue
            done.add((x, y, d))
            a, t = starts[x] + max(0, d), self.starts[y] + max(0, -d)
            n = min(ends[x] - a, test_ends[y] - t)
            same = ids[a : a + n] == self.ids[t : t + n]
            edge = np.flatnonzero(np.diff(np.r_[0, same.view(np.int8), 0]))
            runs = edge[1::2] - edge[::2]
            if len(runs) == 0:
                continue
            longest = int(np.argmax(runs))
            s, e, wrong = _grow(edge[::2].tolist(), edge[1::2].tolist(), longest, most_wrong)
            out.append((x, int(self.item[y]), int(runs[longest]), e - s, wrong))
        return pd.DataFrame(out, columns=["text", "item_id", "run", "overlap", "wrong"])


def _grow(begins: list[int], ends: list[int], k: int, most_wrong: float) -> tuple[int, int, int]:
    """(from, to, wrong) of the overlap that grows from run ``k`` over single differing words while few words in it differ."""
    left = right = k
    wrong = 0
    while True:
        before = (left, right)
        for step in (1, -1):
            nxt = right + 1 if step == 1 else left - 1
            if not 0 <= nxt < len(begins):
                continue
            gap = begins[nxt] - ends[right] if step == 1 else begins[left] - ends[nxt]
            # The first word after the gap has to make up for the differing one.
            if gap == 1 and wrong + 1 <= most_wrong * (ends[right] - begins[left] + 2):
                wrong += 1
                left, right = (left, nxt) if step == 1 else (nxt, right)
        if (left, right) == before:
            return begins[left], ends[right], wrong


def find_leaks(documents: DataFrame, eval_items: DataFrame, *, min_words: int = 12, masks: tuple[str, ...] = MASKS, most_wrong: float = 0.2, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``(doc_id, item_id, exact_run, overlap, substituted)`` of each pair with at least ``min_words`` overlapping words, of which at
    most the share ``most_wrong`` is substituted; ``exact_run`` is the longest run of equal words (runs are followed to their ends)."""
    if any(len(m) != len(masks[0]) or len(m) > min_words or m[0] != "1" for m in masks):
        raise ValueError("masks must be equally long, start with 1 and span at most min_words words")
    blocks: list[list[tuple[int, str]]] = [[]]
    size = 0
    for r in eval_items.select(F.col("item_id").cast("bigint"), "text").where("item_id is not null and text is not null").distinct().toLocalIterator():
        n = len(words(r[1]))
        if blocks[-1] and size + n > block_words:
            blocks.append([])
            size = 0
        if n >= min_words:
            blocks[-1].append((r[0], r[1]))
            size += n
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    sc = documents.sparkSession.sparkContext
    found: DataFrame | None = None
    for items in blocks:
        index = sc.broadcast(_Index(sorted(items), masks))

        def run(batches: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            ix = index.value
            look, gap = ix.vocab.get, [0] * ix.span
            for pdf in batches:
                flat: list[int] = []
                starts, keep = [], []
                for d, t in zip(pdf["doc_id"].tolist(), pdf["text"]):
                    ws = _WORD.findall(t.lower())
                    if len(ws) >= min_words:
                        starts.append(len(flat))
                        keep.append(d)
                        flat += [look(w, 0) for w in ws]
                        flat += gap
                ids = np.array(flat, dtype=np.int64)
                done: set = set()
                for at, to in ix.hits(ids):
                    v = ix.verify(ids, np.array(starts, dtype=np.int64), at, to, most_wrong, done)
                    v = v[(v["overlap"] >= min_words)]
                    doc = np.array(keep, dtype=np.int64)[v["text"].to_numpy()] if len(v) else []
                    yield pd.DataFrame({"doc_id": doc, "item_id": v["item_id"].to_numpy(), "exact_run": v["run"].to_numpy(), "overlap": v["overlap"].to_numpy(), "substituted": v["wrong"].to_numpy()})

        part = docs.mapInPandas(run, "doc_id bigint, item_id bigint, exact_run int, overlap int, substituted int")
        found = part if found is None else found.unionByName(part)
    return found.groupBy("doc_id", "item_id").agg(F.max("exact_run").alias("exact_run"), F.max(F.struct("overlap", -F.col("substituted"))).alias("x")).select("doc_id", "item_id", "exact_run", F.col("x.overlap").alias("overlap"), (-F.col("x.col2")).alias("substituted"))
