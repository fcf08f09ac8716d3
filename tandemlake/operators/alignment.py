"""Pairwise alignment of circular sequences as NumPy kernels over batches of pairs.

Scores are 2 for a match, -1 for a mismatch and -2 for a gap's letter. A semiglobal alignment takes one sequence from end
to end and any stretch of the other, which is written twice in a row where it is a circle. A cell prefers the diagonal,
then a gap in the second sequence, then one in the first, each only where better.

Cells of one antidiagonal don't depend on each other, so that a step works on an antidiagonal of all pairs at once. A cell
is one number: its score above the preferred move above the matches on the way, so that the greatest of three numbers is
the chosen move with its matches, and identities need no traceback.

Where only identities from some value on are of interest, pairs are dismissed before that by what bounds their matches: the
lengths, the letters that both have, and the longest common subsequence, which is found with a bit for each letter.
"""

from __future__ import annotations

import numpy as np

MATCH, MISMATCH, GAP = 2, -1, -2
#: Bits of the matches in a cell of 32 and of 64 bits; above them two for the move, then the score.
_NARROW, _WIDE = 12, 24
#: Pairs bounded at once, and the share of the letters from which on their order is looked at.
_BOUNDED, _TIGHT = 2048, 0.86
_COMPLEMENT = str.maketrans("ACGTNacgtn", "TGCANtgcan")


def revcomp(seq: str) -> str:
    return seq.translate(_COMPLEMENT)[::-1]


def letters(seqs: list[str], pad: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes padded with `pad`, lengths)."""
    lengths = np.array([len(s) for s in seqs])
    out = np.full((len(seqs), int(lengths.max(initial=0))), pad, np.uint8)
    for row, seq in enumerate(seqs):
        out[row, : len(seq)] = np.frombuffer(seq.encode("latin-1"), np.uint8)
    return out, lengths


def common_letters(a: list[str], b: list[str]) -> np.ndarray:
    """The most matches that any alignment of each pair can have: the length of the longest common subsequence.

    A bit for each letter of a, 64 in a word, is cleared where another letter of the subsequence ends; a letter of b is one
    addition over all words.
    """
    out = np.zeros(len(a), np.int64)
    one = np.uint64(1)
    for at in range(0, len(a), _BOUNDED):
        x, x_lengths = letters(a[at : at + _BOUNDED], 0)
        y, _ = letters(b[at : at + _BOUNDED], 1)
        n, words = len(x), -(-max(1, x.shape[1]) // 64)
        kinds, code = np.unique(y, return_inverse=True)
        code = np.ascontiguousarray(code.reshape(y.shape).T)
        holds = np.zeros((len(kinds), words, n), np.uint64)
        for k, kind in enumerate(kinds.tolist()):
            held = np.zeros((n, 64 * words), np.uint8)
            held[:, : x.shape[1]] = x == kind
            holds[k] = np.packbits(held, axis=1, bitorder="little").view(np.uint64).T
        open_, pair = np.full((words, n), np.iinfo(np.uint64).max, np.uint64), np.arange(n)
        for letter in code:
            carry = np.zeros(n, np.uint64)
            for w in range(words):
                row, mask = open_[w], holds[letter, w, pair]
                part = row + (row & mask)
                over = part < row
                total = part + carry
                carry = (over | (total < part)).astype(np.uint64)
                open_[w] = total | (row & ~mask)
        for w in range(words):
            size = np.clip(x_lengths - 64 * w, 0, 64).astype(np.uint64)
            inside = np.where(size >= 64, np.iinfo(np.uint64).max, (one << (size & np.uint64(63))) - one)
            out[at : at + n] += np.bitwise_count(~open_[w] & inside)
    return out


def _promising(whole: list[str], stretch: list[str], need: np.ndarray) -> np.ndarray:
    """Numbers of the pairs that may have the matches needed."""
    sizes = np.array([[len(x), len(y)] for x, y in zip(whole, stretch, strict=True)], np.int64).reshape(-1, 2)
    left = np.flatnonzero(sizes.min(axis=1) >= need)
    counts = [np.array([[s.count(c) for c in "ACGTN"] for s in side], np.int64).reshape(-1, 5) for side in ([whole[k] for k in left], [stretch[k] for k in left])]
    # other letters count as if they matched
    other = sizes[left, 0] - counts[0].sum(axis=1)
    left = left[np.minimum(*counts).sum(axis=1) + other >= need[left]]
    # a sequence finds most of its letters, in order, in one twice as long: where that would do, the alignment has to tell
    tight = (need[left] >= _TIGHT * sizes[left, 0]) | (sizes[left, 1] <= 1.75 * sizes[left, 0])
    far = left[tight]
    far = far[common_letters([whole[k] for k in far], [stretch[k] for k in far]) >= need[far]]
    return np.sort(np.concatenate([left[~tight], far]))


def semiglobal_matches(whole: list[str], stretch: list[str], need: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(score, matches) of each pair: `whole` from end to end against a stretch of the other.

    need: the matches that are of interest for each pair; fewer may come back as -1.
    """
    n = len(whole)
    if need is not None:
        score, same = np.zeros(n, np.int64), np.full(n, -1, np.int64)
        kept = _promising(whole, stretch, need)
        score[kept], same[kept] = semiglobal_matches([whole[k] for k in kept], [stretch[k] for k in kept])
        return score, same
    a, a_lengths = letters(whole, 0)
    b, b_lengths = letters(stretch, 1)
    rows, columns = a.shape[1], b.shape[1]
    kind, bits = (np.int32, _NARROW) if rows < 1 << _NARROW else (np.int64, _WIDE)
    if rows >= 1 << _WIDE:
        raise ValueError("sequences are too long to align")
    up = 1 << bits
    move, shift = 3 << bits, bits + 2
    equal, other, gap = kind(((MATCH - MISMATCH) << shift) + 1), kind((MISMATCH << shift) + 2 * up), kind(GAP << shift)
    # pairs lie side by side; the second sequence backwards, as an antidiagonal meets it
    a, b = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T[::-1])
    before, last, now = (np.zeros((rows + 1, n), kind) for _ in range(3))
    match, side = np.zeros((rows, n), bool), np.zeros((rows + 1, n), kind)
    pair, first = np.arange(n), int(a_lengths.min(initial=0))
    best, same = np.where(a_lengths == 0, 0, np.iinfo(kind).min), np.zeros(n, np.int64)
    for t in range(1, rows + columns + 1):
        before, last, now = last, now, before
        low, high = max(1, t - columns), min(rows, t - 1)
        k = high - low + 1
        if k > 0:
            cells, near = now[low : high + 1], side[: k + 1]
            np.equal(a[low - 1 : high], b[columns - t + low : columns - t + high + 1], out=match[:k])
            np.multiply(match[:k], equal, out=cells)
            cells += before[low - 1 : high]
            cells += other
            np.add(last[low - 1 : high + 1], gap, out=near)
            np.maximum(cells, near[1:], out=cells)
            near[:-1] += kind(up)
            np.maximum(cells, near[:-1], out=cells)
            cells &= kind(~move)
        now[0] = 0
        if t <= rows:
            now[t] = t * gap
        if t >= first:
            ends = now[np.minimum(a_lengths, min(rows, t)), pair]
            better = (a_lengths <= t) & (t - a_lengths <= b_lengths) & (ends >> shift > best)
            best, same = np.where(better, ends >> shift, best), np.where(better, ends & (up - 1), same)
    return best.astype(np.int64), same


def identities(a: list[str], b: list[str], least: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(identity, whether forward) of each a against its b as a circle, in the better direction; forward wins ties.

    least: the identity that is of interest; lower ones may come back as any lower one.
    """
    lengths = np.maximum([len(x) for x in a], [len(y) for y in b])
    need = None if least is None else np.ceil(least * lengths - 1e-6).astype(np.int64)
    _, forward = semiglobal_matches(a, [y + y for y in b], need)
    _, backward = semiglobal_matches(a, [revcomp(y) + revcomp(y) for y in b], need)
    whole = np.maximum(lengths, 1)
    f, r = forward / whole, backward / whole
    return np.maximum(np.maximum(f, r), 0.0), f >= r


def traced(a: str, b: str, free: bool) -> tuple[int, str, str, int, int]:
    """(score, gapped a, gapped b, first and last + 1 of b's letters used): global, or with b's ends free."""
    n, m = len(a), len(b)
    x, y = (np.frombuffer(s.encode("latin-1"), np.uint8) for s in (a, b))
    slope = 2 * np.arange(m + 1)
    row = np.zeros(m + 1, np.int64) if free else GAP * np.arange(m + 1)
    moves = np.empty((n + 1, m + 1), np.int8)
    moves[0] = 2  # left
    for i in range(1, n + 1):
        up = row + GAP
        t, move = up.copy(), np.ones(m + 1, np.int8)
        diagonal = row[:-1] + np.where(x[i - 1] == y, MATCH, MISMATCH)
        better = diagonal >= up[1:]
        t[1:][better], move[1:][better] = diagonal[better], 0
        row = np.maximum.accumulate(t + slope) - slope
        move[row > t] = 2
        moves[i] = move
    j = int(row.argmax()) if free else m
    score, end, i = int(row[j]), j, n
    left, right, used = [], [], []
    while i > 0 or (j > 0 and not free):
        move = moves[i, j]
        i, j = i - (move != 2), j - (move != 1)
        left.append(a[i] if move != 2 else "-")
        right.append(b[j] if move != 1 else "-")
        if move != 1:
            used.append(j)
    return score, "".join(left[::-1]), "".join(right[::-1]), min(used, default=end), max(used, default=end - 1) + 1


def gapped_identity(a: str, b: str, length: int) -> float:
    return sum(p == q != "-" for p, q in zip(a, b, strict=True)) / length if length else 0.0


def blocks(a: str, b: str, width: int = 120) -> str:
    """Two gapped sequences one above the other in blocks of the width, with bars between equal letters."""
    bars = "".join("|" if x == y != "-" else " " for x, y in zip(a, b, strict=True))
    return "\n\n".join("\n".join(row[i : i + width] for row in (a, bars, b)) for i in range(0, len(a), width))


def framed(reference: str, member: str) -> dict:
    """The rotation and direction of a circular member that fit the reference best, and their global alignment."""
    best = None
    for direction, seq in (("forward", member), ("reverse-complement", revcomp(member))):
        score, r, s, start, _ = traced(reference, seq + seq, free=True) if member else (0, "", "", 0, 0)
        start = start % len(seq) if seq else 0
        turned = seq[start:] + seq[:start]
        total, aligned_r, aligned_s, _, _ = traced(reference, turned, free=False)
        length = max(len(reference), len(member))
        found = {
            "orientation": direction, "rotation_start": start, "rotated": turned, "semiglobal_score": score, "global_score": total,
            "frame_identity": gapped_identity(r, s, length), "global_identity": gapped_identity(aligned_r, aligned_s, length), "aligned_reference": aligned_r, "aligned_member": aligned_s,
        }
        rank = (total, found["global_identity"], score, found["frame_identity"])
        if best is None or rank > best[0]:
            best = rank, found
        if not member:
            break
    return best[1]
