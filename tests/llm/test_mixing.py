import re
from collections import defaultdict

from tandemlake.llm import mixing

from .helpers import DOCS, LONG, clashing, docs, rows


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, open_, target = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not full:
            target.update({s: level * weight[s] for s in open_})
            break
        target.update({s: 2.0 * sizes[s] for s in full})
        left -= sum(2 * sizes[s] for s in full)
        open_ -= full
    return target


def test_mix_meets_targets(spark):
    data = [(i, "word " * (1 + i * 13 % 40), None, None if i % 11 == 0 else f"s{'aabcz'[i % 5]}") for i in range(400)] + [(900, None, None, "sa"), (901, "", None, "q"), (902, LONG, None, "sz"), (None, "no id", None, "sb")]
    frame = docs(spark, data)
    found = mixing.report(clashing(frame)).collect()
    assert len(found) == len(data)
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in found:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r.size
    text = {i: t for i, t, _, _ in data}
    assert all(r.size == len(re.findall(r"[^\x20\x09-\x0D]+", text[r.doc_id] or "")) for r in found)
    for source, want in brute_targets(dict(sizes)).items():
        assert abs(target[source] - want) < 1e-4
        largest = max(r.size for r in found if r.source == source)
        assert abs(taken[source] - want) <= largest / 2 + 1
    assert rows(mixing.report(frame)) == rows(mixing.report(frame.repartition(5)))


def test_mix_repeats_rows_with_their_columns(spark):
    frame = clashing(docs(spark, [(i, "w " * (i + 1), "en", f"s{i % 2}") for i in range(30)]))
    copies = {r.doc_id: r.copies for r in mixing.report(frame).collect()}
    out = mixing.mixed(frame)
    assert out.columns == frame.columns
    counts = defaultdict(int)
    for r in out.collect():
        counts[r.doc_id] += 1
    assert {k: v for k, v in copies.items() if v} == dict(counts)


def test_empty_and_wordless_tables(spark):
    assert mixing.report(spark.createDataFrame([], DOCS)).collect() == []
    found = mixing.report(docs(spark, [(1, None, None, "a"), (2, " ", None, None)])).collect()
    assert [(r.size, r.target, r.taken) for r in found] == [(0, 0.0, 0)] * 2


def test_rows_of_one_id_are_taken_one_by_one(spark):
    equal = [(7, "w w w w w", "en", "a")] * 100 + [(8, "w " * 5 + "x", "en", "b")] * 30 + [(9, f"w{i} w w", "en", "b") for i in range(20)]
    frame = docs(spark, equal).repartition(4)
    found = mixing.report(frame).collect()
    taken, target = defaultdict(int), {}
    for r in found:
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.copies <= 2
    assert len(found) == len(equal)
    assert all(abs(taken[s] - target[s]) <= 3 for s in target), (dict(taken), target)
    assert rows(mixing.report(frame)) == rows(mixing.report(frame.repartition(2)))
    out = mixing.mixed(clashing(frame))
    assert out.columns == clashing(frame).columns
    assert out.count() == sum(r.copies for r in found)


def test_ranges_of_any_number_agree(spark):
    frame = docs(spark, [(i, "w " * (1 + i % 9), None, f"s{i % 3}") for i in range(300)])
    assert rows(mixing.report(frame)) == rows(mixing.report(frame, mixing.Mix(range_rows=1)))
