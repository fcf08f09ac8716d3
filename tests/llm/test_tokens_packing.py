import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tandemlake.llm import packing, token_counts, tokens

from .helpers import DOCS, ODD, clashing, docs


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t.,'aBcdé漢<|endoftext|>s\x01"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_encoders_agree(text):
    assert tokens.encode(text).tolist() == tokens.library().encode(text, add_special_tokens=False).ids


def test_counts_stitch_documents_over_small_blocks(spark):
    frame = docs(spark, ODD + [(100 + i, "word " * (i * 7 % 23)) for i in range(40)])
    want = sorted((i is None, i or 0, len(tokens.encode_ordinary(t or ""))) for i, t in [(r.doc_id, r.text) for r in frame.collect()])
    for block, stripe in ((16, 2), (40, 3), (1 << 18, 1024)):
        found = token_counts.counted(clashing(frame.repartition(3)), block, stripe).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in found) == want
        assert all(r.ended for r in found)
        assert len({(r.file, r.doc_index) for r in found}) == len(found)


def test_flat_files_and_open_ends(spark, tmp_path):
    end = tokens.END_OF_TEXT
    ids = np.array([5, 6, end, end, 7, 8, 9], "<u2")
    (tmp_path / "a.bin").write_bytes(ids.tobytes())
    (tmp_path / "b.bin").write_bytes(b"")
    for block in (2, 4, 64):
        found = token_counts.documents(token_counts.scan(token_counts.blocks_of(spark, str(tmp_path), block)), 2)
        assert sorted((r.file, r.doc_index, r.start, r.n_tokens, r.ended) for r in found.collect()) == [(0, 0, 0, 2, True), (0, 1, 3, 0, True), (0, 2, 4, 3, False)]


def test_no_documents(spark):
    empty = spark.createDataFrame([], DOCS)
    assert token_counts.counted(empty).collect() == []
    assert packing.packed(empty).collect() == []


@pytest.mark.parametrize("chunk", [2000, 1 << 18])
def test_packing_round_trip(spark, chunk):
    frame = docs(spark, ODD + [(100 + i, "A sentence of words. Another one! " * (i % 60)) for i in range(150)]).repartition(2)
    found = packing.packed(clashing(frame), packing.Packing(chunk=chunk)).collect()
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append(r)
    padding = 0
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r.offset)
        assert [p.offset for p in pieces] == np.cumsum([0, *[p.length for p in pieces]])[:-1].tolist()
        size = sum(p.length for p in pieces)
        assert 0 < size <= 1024
        padding += 0 if size & (size - 1) == 0 else 1024 - size
    total = sum(r.length for r in found)
    if chunk > 2000:
        assert padding <= 0.02 * total
    want = {}
    for r in frame.collect():
        ids = np.append(tokens.encode(r.text or ""), 0).astype("<u4").tobytes()
        want.setdefault(r.doc_id, [ids, 0])[1] += 1
    for doc_id, (ids, copies) in want.items():
        held = b"".join(bytes(r.ids) for r in sorted((r for r in found if r.doc_id == doc_id), key=lambda r: (r.sequence_id, r.offset)))
        assert held == ids * copies
        assert all(r.doc_tokens * 4 == len(ids) and bytes(r.ids) == ids[4 * r.start : 4 * (r.start + r.length)] for r in found if r.doc_id == doc_id)


def test_most_sequences_end_with_a_document_or_sentence(spark):
    words = "the river ran along a wide valley and under old bridges where people of every village met to trade".split()
    text = lambda i: " ".join(" ".join(words[(i * 7 + k * k + j) % len(words)] for j in range(5 + (i + k) % 23)) + "." for k in range(3 + i % 80))
    frame = docs(spark, [(i, text(i)) for i in range(400)]).coalesce(1)
    found = packing.packed(frame).orderBy("sequence_id", "offset").collect()
    last = {r.sequence_id: r for r in found}
    size = {}
    for r in found:
        size[r.sequence_id] = size.get(r.sequence_id, 0) + r.length
    assert len(last) > 100
    assert sum(r.cut != "inner" for r in last.values()) >= 0.85 * len(last)
    assert sum(0 if n & (n - 1) == 0 else 1024 - n for n in size.values()) <= 0.015 * sum(size.values())
    ends = packing.sentence_ends()
    for r in found:
        at_end = ends[min(int.from_bytes(r.ids[-4:], "little"), len(ends) - 1)]
        assert r.cut == ("document" if r.start + r.length == r.doc_tokens else "sentence" if at_end else "inner")


def brute(places, penalty, how):
    best = [0] + [None] * (len(places) - 1)
    for i in range(1, len(places)):
        for j in range(i):
            for m in how.runs:
                size = places[i] - places[j]
                if (m - 1) * how.length < size <= m * how.length:
                    cost = best[j] + m * how.length - size + (m - 1) * how.inner_cut + penalty[i]
                    best[i] = cost if best[i] is None else min(best[i], cost)
    return best[-1]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 12), st.integers(0, 4)), min_size=1, max_size=25))
def test_cuts_cost_least(steps):
    how = packing.Packing(length=12, inner_cut=3)
    places = np.cumsum([0, *[s for s, _ in steps]])
    penalty = np.array([0, *[p for _, p in steps]])
    ends = packing.cuts(places, penalty, how)
    at = dict(zip(places.tolist(), penalty.tolist(), strict=True))
    cost = sum(12 - (b - a) for a, b in zip([0, *ends], ends, strict=False)) + sum(min(at.get(e, 3), 3) for e in ends)  # a cut anywhere costs 3
    assert ends[-1] == places[-1]
    assert cost <= brute(places.tolist(), penalty.tolist(), how)
