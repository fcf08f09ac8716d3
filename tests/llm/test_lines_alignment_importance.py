"""Line deduplication, alignment of two tokenizers and importance resampling against plain versions."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tandemlake.llm import importance, line_dedup, perfect_hash, token_alignment, tokens

from .helpers import DOCS, LONG, ODD, clashing, docs, rows

LINES = [(20 + i, "\n".join(["Menu", f"  HOME | about{'' if i % 2 else ' '}", f"own line {i}", "own line again", "own line again", "ÄRA x" if i % 3 else "ära x", "\x0b\t", "ok"][: 3 + i % 6])) for i in range(12)]


# --- lines ---------------------------------------------------------------------------------------------------------


def plain_lines(frame, how):
    """Place of a line: (no id, id, line)."""
    held, first = Counter(), {}
    for r in frame:
        seen = set()
        for at, line in enumerate((r.text or "").split("\n")):
            key = line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
            if len(key) >= max(1, how.min_chars):
                if key not in seen:
                    held[key] += 1
                seen.add(key)
                place = (r.doc_id is None, r.doc_id or 0, at)
                first[key] = min(first.get(key, place), place)
    out = []
    for r in frame:
        lines = (r.text or "").split("\n")
        kept = []
        for at, line in enumerate(lines):
            key = line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
            repeated = len(key) >= max(1, how.min_chars) and held[key] >= how.min_docs
            if not repeated or (how.keep_first and first[key] == (r.doc_id is None, r.doc_id or 0, at)):
                kept.append(line)
        out.append((r.doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("how", [line_dedup.Lines(), line_dedup.Lines(3), line_dedup.Lines(2, most_bits=1), line_dedup.Lines(3, broadcast_bytes=0), line_dedup.Lines(3, 4, keep_first=True), line_dedup.Lines(2, keep_first=True, broadcast_bytes=0)])
def test_lines_against_a_plain_version(spark, how):
    frame = docs(spark, ODD + LINES + [(None, "a row without an id of its own\nMenu"), (90, "\n\n"), (91, LONG + "\nmenu\n" + LONG)]).repartition(3)
    assert rows(line_dedup.dropped(clashing(frame), how)) == plain_lines(frame.collect(), how)


def test_lines_pass_columns_through(spark):
    frame = clashing(docs(spark, ODD + LINES).repartition(2))
    found = line_dedup.cleaned(frame, line_dedup.Lines(3))
    assert found.columns == frame.columns
    texts = {(i, t) for i, _, _, t in plain_lines(frame.collect(), line_dedup.Lines(3))}
    assert {(r.doc_id, r.text or "") for r in found.collect()} == texts
    assert {r.doc_id for r in found.collect() if r.text is None} == {1}


def test_filters_lose_no_repeat():
    rng = np.random.default_rng(3)
    found = [b"%d" % k for k in rng.integers(0, 5000, 9000)]
    halves = []
    for part in (found[::2], found[1::2]):
        once, twice = np.zeros(1024, np.uint64), np.zeros(1024, np.uint64)
        for at in range(0, len(part), 700):
            line_dedup.seen(once, twice, *line_dedup.places(part[at : at + 700], 1024))
        halves.append((once, twice))
    (a, b), (x, y) = halves
    suspects = line_dedup._suspects(list(set(found)), b | y | (a & x))
    held = Counter(found)
    told = dict(zip(set(found), suspects, strict=True))
    assert all(told[k] for k, n in held.items() if n > 1)
    assert sum(told.values()) < 1.3 * sum(n > 1 for n in held.values())


# --- alignment -----------------------------------------------------------------------------------------------------


@settings(max_examples=40, deadline=None)
@given(st.sets(st.integers(0, 2**62), max_size=2000))
def test_perfect_hash_numbers_its_keys(keys):
    held = np.array(sorted(keys), np.int64)
    shard = perfect_hash.shard_of(held)
    made = [(int(k), level, bits.tobytes(), stay.tobytes()) for k in np.unique(shard) for level, (bits, stay) in enumerate(perfect_hash.built(held[shard == k]))]
    table = perfect_hash.PerfectHash(iter(made))
    assert sorted(table.number(held).tolist()) == list(range(len(held)))
    others = np.setdiff1d(np.arange(-500, 500), held)
    assert (table.number(others) == -1).all()
    assert len(table.bits) * 64 <= 64 * perfect_hash.SHARDS * 16 + 6 * len(held)


def plain_alignment(frame):
    first, second = token_alignment.vocabularies()
    made = []
    for r in frame:
        text = r.text or ""
        a = tokens.library().encode(" " + text, add_special_tokens=False).ids if "<|" not in text else tokens.encode_ordinary(" " + text).tolist()
        b = token_alignment.pieces().encode(text)
        raw = (" " + text).encode()
        if not text or b"".join(first[i] for i in a) != raw or b"".join(second[i] for i in b) != raw:
            made.append((r.doc_id, [], [], [], ""))
            continue
        spans = [[], []]
        for out, ids, vocabulary in ((spans[0], a, first), (spans[1], b, second)):
            at = 0
            for i in ids:
                out.append((at, at + len(vocabulary[i]), i))
                at += len(vocabulary[i])
        links, j = [], 0
        for s, e, i in spans[0]:
            j = max(0, j - 2)
            while j < len(spans[1]) and spans[1][j][0] < e:
                if spans[1][j][1] > s:
                    links.append((i, spans[1][j][2]))
                j += 1
        common = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, begin = [], 0
        for end in common:
            groups.append("|".join(",".join(str(i) for s, e, i in side if begin <= s and e <= end) for side in spans) if len(text) < 300 else "")
            begin = end
        made.append((r.doc_id, a, b, links, ";".join(groups)))
    held = Counter(pair for _, _, _, links, _ in made for pair in set(links))
    best = defaultdict(int)
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    return sorted(((doc, len(a), len(b), len(groups.split(";")) if groups else 0, len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links), groups) for doc, a, b, links, groups in made), key=repr)


TEXTS = [(100 + i, t) for i, t in enumerate(["A plain sentence, with words.", "Straße und Öl, naïve café", "漢字かな交じり文", "<|endoftext|> and <s> as text", "two  spaces\n\nand lines\t", " leading", "▁ is rewritten", "emoji 🙂🙂", "a" * 50, "x\x00y"])]


@pytest.mark.parametrize("most", [token_alignment.MOST_PAIRS, 0])
def test_alignment_against_a_plain_version(spark, most):
    frame = docs(spark, ODD + TEXTS * 2 + [(50 + i, f"words of number {i} go together, as do words") for i in range(20)]).repartition(3)
    cut = lambda found: [(*r[:3], *((r[3], r[7]) if len(r[7]) < 1500 else ("", "")), *r[4:7]) for r in found]  # noqa: E731 the plain version writes no long groups
    found, want = rows(token_alignment.linked(clashing(frame), most)), plain_alignment(frame.collect())
    short = {r[0] for r in want if r[4] and not r[7].strip(";")}  # long texts
    assert cut([r for r in found if r[0] not in short]) == cut([r for r in want if r[0] not in short])
    assert [(*r[:3], *r[4:7]) for r in found if r[0] in short] == [(*r[:3], *r[4:7]) for r in want if r[0] in short]
    assert any(r[1] for r in found)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from([" ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "\u3000", "\r\n", "'s", "123", ".", "!?", "<s>", "<|endoftext|>", "▁", "ﬁ", "the", "Ab"]), st.text(max_size=4)), max_size=20))
def test_chunks_are_encoded_like_the_whole(parts):
    text = "".join(parts).encode("utf-8", "ignore").decode()
    cut = token_alignment.chunks(text)
    assert "".join(" " + c for c in cut) == " " + text
    assert [i for c in cut for i in tokens.encode_ordinary(" " + c).tolist()] == tokens.encode_ordinary(" " + text).tolist()
    whole, apart = token_alignment.pieces().encode(text), [i for c in cut for i in token_alignment.pieces().encode(c)]
    raw = lambda ids: b"".join(token_alignment.vocabularies()[1][i] for i in ids)
    assert (raw(whole) == (" " + text).encode()) == (raw(apart) == (" " + text).encode())
    assert whole == apart or raw(whole) != (" " + text).encode()


def test_memory_begins_anew(monkeypatch):
    texts = [" ".join(f"w{(i * k) % 17}" for k in range(30)) + (" \x00▁x" if i == 5 else " " if i == 7 else "") for i in range(12)] + [None, "", "▁"]
    monkeypatch.setattr(token_alignment, "SLICE", 50)
    seen = []
    for known in (5, 1 << 18):
        monkeypatch.setattr(token_alignment, "KNOWN", known)
        memory = token_alignment.Memory()
        found = []
        for at, numbers, ends in memory.documents(pa.array(texts)):
            sizes, named = token_alignment._described(memory, numbers, ends)
            keys, n = token_alignment._document_pairs(memory, numbers, ends)
            found += list(zip(at.tolist(), sizes.tolist(), named, [sorted(zip((keys[keys >> 32 == k] & 0xFFFFFFFF).tolist(), n[keys >> 32 == k].tolist(), strict=True)) for k in range(len(at))], strict=True))
        seen.append(found)
    assert seen[0] == seen[1]
    assert [r[0] for r in seen[0]] == [0, 1, 2, 3, 4, 6, 7, 8, 9, 10, 11]


# --- importance ----------------------------------------------------------------------------------------------------


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def plain_resampling(frame, target, how):
    def features(text):
        w = plain_words(text)
        return [" ".join(w[k : k + n]) for n in range(1, how.longest + 1) for k in range(len(w) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % how.buckets
    s, t = Counter(bucket(f) for r in frame for f in features(r.text)), Counter(bucket(f) for x in target for f in features(x))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + how.buckets) / ((s[b] + 1) * (t_all + how.buckets))))
    out = []
    for r in frame:
        held = features(r.text)
        weight = sum(gain(bucket(f)) for f in held) // max(1, len(held))
        h = int(hashlib.sha256(f"{how.seed}:{'null' if r.doc_id is None else r.doc_id}".encode()).hexdigest()[:8], 16)
        out.append([r.doc_id, len(held), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(plain_words(r.text))])
    open_ = sorted((r for r in out if r[5] >= how.min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(open_[: how.percent * len(open_) // 100]):
        r[4] = rank + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


@pytest.mark.parametrize("how", [importance.Resampling(), importance.Resampling(buckets=50, longest=3, min_words=2, percent=90, seed=1), importance.Resampling(min_words=0, percent=100), importance.Resampling(percent=0)])
def test_resampling_against_a_plain_version(spark, how, monkeypatch):
    monkeypatch.setattr(importance, "TILE", 8)
    frame = docs(spark, [r for r in ODD if r[0] != 7] + [(8, "The Target's WORDS, again and again; Größe 12 % of-it " * 3)] + [(20 + i, f"word{i % 7} and other words of no. {i} " * (i % 9)) for i in range(60)]).repartition(3)
    target = ["target's words again", None, "", "größe 12 and no other words of it"]
    aim = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    assert rows(importance.resampled(clashing(frame), aim, how)) == plain_resampling(frame.collect(), target, how)


def test_repeated_rows_are_ranked_one_by_one(spark):
    frame = docs(spark, [(1, "many words " * 20)] * 8 + [(None, "some words " * 20)] * 4)
    found = importance.resampled(frame, frame.select("text"), importance.Resampling(percent=50)).collect()
    assert sorted(r.rank for r in found if r["rank"]) == [1, 2, 3, 4, 5, 6]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=3), max_size=200), st.sampled_from([1, 3, 2**64 - 1]))
def test_interning_verifies_bytes(grams, values):
    """Keys of few values: only the bytes tell n-grams apart."""
    table = importance.Interned(grams, 10, digest=lambda g: zlib.crc32(g) % values)
    assert len(set(table.slots.tolist())) == len(set(grams))
    assert {(g, s) for g, s in zip(grams, table.slots.tolist(), strict=True)} == set(dict(zip(grams, table.slots.tolist(), strict=True)).items())
    assert all(table.count[s] == Counter(grams)[g] and table.bucket[s] == zlib.crc32(g) % 10 for g, s in zip(grams, table.slots.tolist(), strict=True))


def test_long_texts_in_pieces(monkeypatch):
    text = ("Words and MoreWords, " * 50 + "Ω" * 30).encode()
    whole = [w for part in importance.words(text) for w in part]
    monkeypatch.setattr(importance, "SLICE", 7)
    assert [w for part in importance.words(text) for w in part] == whole == [w.encode() for w in plain_words(text.decode())]
    how = importance.Resampling(longest=3)
    made = list(importance.interned(pa.array([text.decode(), None, "a b"]), how))
    assert sum(int(sizes.sum()) for _, (sizes, _), _ in made) == 3 * len(whole) - 3 + 3


def test_no_documents(spark):
    empty = spark.createDataFrame([], DOCS)
    for found in (line_dedup.dropped(empty), line_dedup.cleaned(empty), token_alignment.linked(empty), token_alignment.linked(empty, 0), importance.resampled(empty, empty.select("text"))):
        assert found.collect() == []
