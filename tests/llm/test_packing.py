from hypothesis import given, settings
from hypothesis import strategies as st

from cairn.llm.packing import encoding, first_fit_decreasing, pack


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=60))
def test_first_fit(sizes):
    rows = first_fit_decreasing(list(enumerate(sizes)), 20)
    used, by_id = {}, {}
    for c, _p, i, s, e in rows:
        used[c] = used.get(c, 0) + e - s
        by_id.setdefault(i, []).append((s, e))
    assert all(u <= 20 for u in used.values()) and set(by_id) == set(range(len(sizes)))
    for i, n in enumerate(sizes):
        parts = sorted(by_id[i])
        assert parts[0][0] == 0 and parts[-1][1] == n and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
        assert len(parts) == max(1, -(-n // 20))
    assert sorted({(c, p) for c, p, *_ in rows}) == sorted((c, p) for c, p, *_ in rows)
    # The brute-force version: scan all open containers for the first with room.
    pieces = sorted(((min(20, n - s), i, s) for i, n in enumerate(sizes) for s in range(0, n, 20)), key=lambda p: (-p[0], p[1], p[2]))
    bins, want = [], {}
    for n, i, s in pieces:
        at = next((b for b, u in enumerate(bins) if u + n <= 20), len(bins))
        bins[at:at + 1] = [(bins[at] if at < len(bins) else 0) + n]
        want[i, s] = at
    assert {(i, s): c for c, _p, i, s, e in rows if e > s} == want


def test_table(spark):
    rows = [(1, "word " * 5000, "a"), (2, None, "b"), (3, "", None), (4, "short text", "c"), (4, "short text", "c"), (None, "x", "d"), (5, "<|endoftext|> is text", "e")]
    got = pack(spark.createDataFrame(rows, "doc_id bigint, text string, container string"), capacity=64).collect()
    assert {r.doc_id for r in got} == {1, 2, 3, 4, 5}
    n = len(encoding("/opt/tokenizers/byte_bpe_50k.tiktoken").encode_ordinary(rows[0][1]))
    assert sum(r.token_end - r.token_start for r in got if r.doc_id == 1) == n and sum(r.doc_id == 4 for r in got) == 1
    assert pack(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
