"""Problem 2: splitting oversized texts at natural boundaries.

Method: a recursive hierarchy of separators - section, paragraph, line and sentence, word, character.  A span that fits
is left whole, a span that does not is split by the next finer separator; the units are packed greedily up to the limit,
and each piece repeats the tail of the one before, cut at a sentence or word where it has one.

Every byte of the text comes out: ``piece[overlap:]`` of all pieces, joined, is the text.

Scale: one narrow pass, linear in the text.  Texts within the limit stay in the JVM.  Only texts of keys that occur more than
once are shuffled, to find the one that counts, and before they are split; pieces are never shuffled.

Defined results: null text - no piece; a text within the limit, the empty one included - one piece, unchanged; exact
copies of a row give their pieces once; if rows of one key differ, the pieces of the text with the greatest hash are kept.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators.lineage import bounded

#: Where a text breaks, from coarse to fine; a cut is made at the start of the match's group ``b`` or at its end.
_LEVELS = (
    re.compile(r"\n(?=#{1,6}[ \t])|\n(?=[^\n]+\n(?:={3,}|-{3,})[ \t]*(?:\n|$))"),  # section
    re.compile(r"\r?\n(?:[ \t]*\r?\n)+"),  # paragraph
    re.compile(r"\r?\n|(?<=[.!?…。！？])[\"'”’)\]]*[ \t]+"),  # line and sentence
    re.compile(r"\s+"),  # word
)


def _nbytes(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass"))


def _chars(text: str, limit: int) -> Iterator[str]:
    """Pieces of at most ``limit`` bytes, cut between characters, not before a combining mark where that can be."""
    at, n = 0, len(text)
    while at < n:
        end = min(n, at + limit)
        while _nbytes(text[at:end]) > limit:
            end = at + max(1, (end - at) * limit // _nbytes(text[at:end]))
        while end < n and _nbytes(text[at : end + 1]) <= limit:
            end += 1
        back = end
        while back < n and back - 1 > at and end - back < 16 and (unicodedata.combining(text[back]) or text[back] in "‍️" or text[back - 1 : back + 1] == "\r\n"):
            back -= 1
        if back < n and not unicodedata.combining(text[back]):
            end = back
        yield text[at:end]
        at = end


def units(text: str, limit: int, level: int = 0) -> Iterator[str]:
    """``text`` in units of at most ``limit`` bytes, as coarse as the limit allows."""
    if _nbytes(text) <= limit:
        if text:
            yield text
        return
    if level == len(_LEVELS):
        yield from _chars(text, limit)
        return
    at = 0
    for m in _LEVELS[level].finditer(text):
        if m.end() > at:
            yield from units(text[at : m.end()], limit, level + 1)
            at = m.end()
    yield from units(text[at:], limit, level + 1)


def _tail(piece: str, overlap: int) -> str:
    """At most ``overlap`` trailing bytes of ``piece``, from the start of a sentence or else a word or else a character."""
    if overlap <= 0 or not piece:
        return ""
    tail = piece[-overlap:]
    while _nbytes(tail) > overlap:
        tail = tail[max(1, (_nbytes(tail) - overlap) // 4) :]
    if len(tail) == len(piece):
        tail = tail[1:]
    for rx in (_LEVELS[2], _LEVELS[3]):
        cut = [m.end() for m in rx.finditer(tail) if m.end() < len(tail)]
        if cut:
            return tail[cut[0] :]
    while tail and unicodedata.combining(tail[0]):
        tail = tail[1:]
    return tail


def split_text(text: str, max_bytes: int = 3000, overlap: int = 200) -> list[tuple[str, int]]:
    """The pieces of ``text`` in order, each with the bytes that it repeats of the one before."""
    if not 0 <= overlap <= max_bytes - 8:
        raise ValueError("overlap must leave room for a character of text in each piece")
    if _nbytes(text) <= max_bytes:
        return [(text, 0)]
    out: list[tuple[str, int]] = []
    fresh: list[str] = []
    size, head = 0, ""
    for u in units(text, max_bytes - overlap):
        n = _nbytes(u)
        if fresh and _nbytes(head) + size + n > max_bytes:
            body = "".join(fresh)
            out.append((head + body, _nbytes(head)))
            head, fresh, size = _tail(head + body, overlap), [], 0
        fresh.append(u)
        size += n
    out.append((head + "".join(fresh), _nbytes(head)))
    return out


def one_per_key(df: DataFrame) -> DataFrame:
    """``(k, t)`` with one row for each k: its text of the greatest hash.  The texts of keys that occur once are not shuffled."""
    many = bounded(df.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k"))
    once = df.join(many, "k", "left_anti")
    best = df.join(many, "k", "left_semi").groupBy("k").agg(F.max_by("t", F.struct(F.xxhash64("t"), "t")).alias("t"))
    return once.unionByName(best)


def split(df: DataFrame, key: str, text: str, *, max_bytes: int = 3000, overlap: int = 200, with_text: bool = True) -> DataFrame:
    """``(item_key, piece_no, n_pieces, start_byte, end_byte, overlap_bytes, piece)`` of each row of ``df``; ``piece`` is null without ``with_text``."""
    cols = ["item_key", "piece_no", "n_pieces", "start_byte", "end_byte", "overlap_bytes", "piece"]
    types = ["string", "int", "int", "bigint", "bigint", "int", "string"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, t in zip(pdf["k"], pdf["t"]):
                at, ps = 0, split_text(t, max_bytes, overlap)
                for i, (p, o) in enumerate(ps):
                    n = _nbytes(p)
                    rows.append((k, i, len(ps), at - o, at - o + n, o, p if with_text else None))
                    at += n - o
            yield pd.DataFrame(rows, columns=cols)

    texts = one_per_key(df.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t")).where("k is not null and t is not null"))
    size = F.octet_length("t")
    # Texts of megabytes need small batches, which the session's spark.sql.execution.arrow.maxBytesPerBatch sees to.
    cut = texts.where(size > max_bytes).mapInPandas(run, ", ".join(f"{c} {t}" for c, t in zip(cols, types)))
    whole = [F.col("k"), F.lit(0), F.lit(1), F.lit(0), size, F.lit(0), F.col("t") if with_text else F.lit(None)]
    return cut.unionByName(texts.where(size <= max_bytes).select(*[v.cast(t).alias(c) for v, c, t in zip(whole, cols, types)]))
