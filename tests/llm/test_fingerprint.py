import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tandemlake.llm import fingerprint as fp

from .helpers import DOCS, LONG, clashing, docs


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abé漢", max_size=30), st.text(alphabet="abé漢", max_size=30), st.data())
def test_spans_and_extensions(a, b, data):
    x, y = fp.PrefixHash(a), fp.PrefixHash(b)
    i, j = data.draw(st.integers(0, len(a))), data.draw(st.integers(0, len(b)))
    n = data.draw(st.integers(0, 10))
    assert x.equal(i, y, j, n) == (i + n <= len(a) and j + n <= len(b) and a[i : i + n] == b[j : j + n])
    want = 0
    while i + want < len(a) and j + want < len(b) and a[i + want] == b[j + want]:
        want += 1
    assert x.longest_common_extension(i, y, j) == want
    back = 0
    while back < min(i, j) and a[i - back - 1] == b[j - back - 1]:
        back += 1
    assert x.longest_common_backward(i, y, j) == back
    assert x.span(min(i, i + n), min(len(a), i + n)) == int(x.spans(np.array([i]), np.array([min(len(a), i + n)]))[0])


def test_windows_match_spans():
    text = "the quick brown fox jumps" * 3
    x = fp.PrefixHash(text)
    n = len(text) - 16 + 1
    assert (x.windows(16) == x.spans(np.arange(n), np.arange(n) + 16)).all()


def test_edited_texts(spark):
    data = [(5 * i, f"document {i} says something of its own, number {i * i}. " * (1 + i % 4)) for i in range(120)]
    data += [(3, None), (4, ""), (1000, "x"), (1001, LONG), (None, "first of all"), (7, "tie b"), (7, "tie a"), (8, "tie a")]
    frame = docs(spark, data)
    order = sorted(((i is not None, i or 0, t or ""), i, t or "") for i, t in data)
    for rows in (20_000, 10):
        found = fp.edited(clashing(frame.repartition(3)), rows).collect()
        assert len(found) == len(data)
        got = sorted(((r.doc_id is not None, r.doc_id or 0, r.n_chars, r.edited_sha256) for r in found))
        want = []
        for k, (_, i, t) in enumerate(order):
            following, cut = order[(k + 1) % len(order)][2], len(t) // 2
            text = t[: len(t) - cut] + following[:cut]
            want.append((i is not None, i or 0, len(t), hashlib.sha256(text.encode()).hexdigest()))
        assert got == sorted(want)
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in found)
        long = [r for r in found if r.n_chars > 100]
        assert sum(r.near_edited > 0.2 for r in long) == len(long)
    prints = {r.fingerprint for r in found if r.n_chars == 5}
    assert len(prints) == 2  # "tie a" twice, "tie b"


def test_likeness_across_widths(spark):
    text = "of all the windows in this text of one hundred code points some must stay when its end is cut away!!"
    for size in (128, 100, 64, 40, 20):
        for following in (None, "", "0123456789"):
            long = (text * 2)[:size]
            near = {r.doc_id: r.near_edited for r in fp.edited(docs(spark, [(1, long), (2, following)])).collect()}
            assert near[1] > 0.3, (size, following)
    data = [(1, text[:66]), (2, text[:63]), (3, text[:31]), (4, "0123456789" * 7)]
    near = [r.near_next for r in sorted(fp.edited(docs(spark, data)).collect())]
    assert near[0] > 0.8 and near[1] > 0.4 and near[2] == 0.0


def test_one_row_and_none(spark):
    assert fp.edited(spark.createDataFrame([], DOCS)).collect() == []
    (r,) = fp.edited(docs(spark, [(1, "abcd")])).collect()
    assert r.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and r.near_next == 1.0
    empty, a = fp.Print(fp.code_points("")), fp.Print(fp.code_points("a"))
    assert (fp.alike(empty, empty), fp.alike(empty, a), fp.shared(empty, empty), fp.shared(empty, a)) == (1.0, 0.0, 1.0, 0.0)


def windows(text, width):
    """Of a text between signs, as code points."""
    points = [fp.END] * (width - 1) + [ord(c) for c in text] + [fp.END] * (width - 1)
    return {tuple(points[i : i + width]) for i in range(len(points) - width + 1)} if text else set()


def plain_hash(window):
    out = 0
    for base, prime in zip(fp.BASES, fp.MODULI, strict=True):
        out = out << 31 | sum((c + 1) * pow(base, k, prime) for k, c in enumerate(window)) % prime
    return out


def plain_mix(x):
    """The 64-bit finaliser in whole numbers."""
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 % 2**64
    x ^= x >> 27
    x = x * 0x94D049BB133111EB % 2**64
    return x ^ x >> 31


def plain_print(text):
    slots = [0] * fp.SLOTS
    for window in windows(text, fp.WINDOW):
        h = plain_mix((plain_hash(window) + fp.WINDOW) % 2**64)
        slot, low = (h >> 32) % fp.SLOTS, max(1, h & 0xFFFFFFFF)
        slots[slot] = min(slots[slot] or low, low)
    return "".join(f"{x:08x}" for x in slots)


def plain_likeness(a, b):
    pairs = [(a[k : k + 8], b[k : k + 8]) for k in range(0, len(a), 8)]
    used = [p for p in pairs if p != ("0" * 8, "0" * 8)]
    same = sum(x == y for x, y in used) / len(used) if used else 1.0
    return 2 * same / (1 + same)


def test_whole_result_by_brute_force(spark):
    """Fingerprints made of windows one by one, and likeness by the returned strings alone."""
    base = "of all the windows in this text of one hundred code points some must stay when its end is cut away!!"
    data = [(1, base), (2, "abc"), (3, None), (4, ""), (5, "x"), (6, base[:64]), (7, base[:63]), (8, base[:31]), (9, "Ünïcode 漢字 text " * 9), (10, "ab"), (11, "ab"), (12, base + " and more"), (None, base)]
    found = {r.doc_id: r for r in fp.edited(docs(spark, data).repartition(3)).collect()}
    order = sorted(data, key=lambda d: (d[0] is not None, d[0] or 0))
    for k, (i, text) in enumerate(order):
        own, following = text or "", order[(k + 1) % len(order)][1] or ""
        cut = len(own) // 2
        edited = own[: len(own) - cut] + following[:cut]
        r = found[i]
        assert (r.fingerprint, r.edited_fingerprint) == (plain_print(own), plain_print(edited))
        assert abs(r.near_edited - plain_likeness(r.fingerprint, r.edited_fingerprint)) < 1e-12
        assert abs(r.near_next - plain_likeness(r.fingerprint, found[order[(k + 1) % len(order)][0]].fingerprint)) < 1e-12
        assert fp.as_text(fp.of_text(r.fingerprint)) == r.fingerprint
    assert found[1].near_edited > 0.3 and found[5].near_edited == 1.0


def test_likeness_by_brute_force():
    """The estimate from slots against the share of common windows, and covered spans against the planted ones."""
    rng = np.random.default_rng(3)
    word = lambda n: "".join(rng.choice(list("abcdefghij "), n))
    errors = []
    for common in (0, 100, 400, 900, 1500, 2000):
        for _ in range(6):
            passage, tail, other = word(common), word(2000 - common), word(2000 - common)
            a, b = word(40) + passage + tail, passage + other
            x, y = windows(a, fp.WINDOW), windows(b, fp.WINDOW)
            want = 2 * len(x & y) / (len(x) + len(y))
            p, q = fp.Print(fp.code_points(a)), fp.Print(fp.code_points(b))
            errors.append(abs(fp.alike(p, q) - want))
            if common >= 400:
                # what is shared by chance at the passage's ends adds a few letters
                assert abs(fp.shared(p, q) - 2 * common / (len(a) + len(b))) < 0.01
            assert fp.shared(p, p) == 1.0 and fp.alike(p, p) == 1.0
    assert np.mean(errors) < 0.05 and max(errors) < 0.2


def test_ids_stay_whole_beside_a_null(spark):
    big = 9007199254740993
    found = fp.edited(docs(spark, [(big, "text of a large id"), (None, "no id"), (big, "text of a large id"), (big, "another")]), 1).collect()
    assert sorted((r.doc_id or 0, r.n_chars) for r in found) == [(0, 5), (big, 7), (big, 18), (big, 18)]


def test_one_id_may_hold_many_rows(spark):
    texts = [f"{chr(97 + i % 26)} text {i}" for i in range(200)]
    found = fp.edited(docs(spark, [(5, t) for t in texts]).repartition(3), 20).collect()
    order = sorted(texts)
    want = {hashlib.sha256((t[: len(t) - len(t) // 2] + order[(k + 1) % 200][: len(t) // 2]).encode()).hexdigest() for k, t in enumerate(order)}
    assert {r.edited_sha256 for r in found} == want and len(found) == 200
