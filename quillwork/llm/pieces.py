"""SentencePiece encoding and decoding by a Viterbi search in batches of equal-length words.

The path scores depend on the kind of model. Of a unigram model, the best path has the
greatest sum of piece scores, and a longer last piece wins a tie. Of a merge model, a
step from one piece to the next scores 0 where merging leaves the two apart and minus
infinity where it does not, so the one path of score 0 is what replaying the merges
gives. Characters without a piece fall back to byte pieces.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._text import BASE, column_bytes, prefix_hash, slices, span_hash

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = 0x2581
#: Stands for a literal U+2581 of the text, so that it is not taken for a space.
LITERAL = 0x110000
UNKNOWN_PENALTY = 10.0
#: Words whose pieces a task remembers between batches, at most.
CACHED_WORDS = 600_000
#: Characters of new words that are searched together; a longer word is searched alone.
AT_ONCE = 200_000
#: Ids of a substring that is no piece, and of a character without one.
NO_PIECE, LONE = -1, -2
#: Pairs of pieces whose look-up is remembered: two to this power.
SEEN_BITS = 19
#: A longer word is searched alone, position by position.
LONG_WORD = 512


class Merges:
    """Which two pieces of a merge model can stand side by side, told by the order of its merges.

    Pieces are numbered in the order in which merging makes them, single characters
    first. ``left`` and ``right`` are the two pieces that a piece is last merged from,
    itself for a character.
    """

    def __init__(self, ranked: list[str], ids: list[int]):
        number = {p: i for i, p in enumerate(ranked)}
        n = len(ranked)
        self.number = np.full(max(ids, default=-1) + 1, -1, np.int64)
        self.number[ids] = np.arange(n)
        left, right = list(range(n)), list(range(n))
        joined: dict[tuple[int, int], int] = {}
        self.unmade: list[int] = []
        for i, piece in enumerate(ranked):
            for cut in range(len(piece) - 1, 0, -1):
                a, b = number.get(piece[:cut], n), number.get(piece[cut:], n)
                if a < i and b < i and _stay_apart(a, b, joined, left, right):
                    joined[a, b], left[i], right[i] = i, a, b
                    break
            else:
                if len(piece) > 1:
                    self.unmade.append(ids[i])  # no order of merges ends in this piece
        self.left, self.right = np.array(left, np.int64), np.array(right, np.int64)
        pairs = sorted((a * n + b, i) for (a, b), i in joined.items())
        self.pair = np.array([x for x, _ in pairs] or [-1], np.int64)
        self.into = np.array([x for _, x in pairs] or [n], np.int64)
        self.seen: tuple[np.ndarray, np.ndarray] | None = None

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves the pieces ``a`` and ``b`` (their ids, under 0: a lone character) side by side.

        A table of fixed size remembers the pairs last looked at.
        """
        if self.seen is None:  # made where it is used, not sent
            self.seen = np.full(1 << SEEN_BITS, -1, np.int64), np.zeros(1 << SEEN_BITS, bool)
        seen, told = self.seen
        n = len(self.left)
        lone = (a < 0) | (b < 0)
        x, y = self.number[np.where(lone, 0, a)], self.number[np.where(lone, 0, b)]
        pair = x * n + y
        slot = ((pair.view(np.uint64) * BASE) >> np.uint64(64 - SEEN_BITS)).view(np.int64)
        out = told[slot] | lone
        new = np.flatnonzero((seen[slot] != pair) & ~lone)
        if len(new):
            out[new] = self._looked_at(x[new], y[new])
            seen[slot[new]] = pair[new]
            told[slot[new]] = out[new]
        return out

    def _looked_at(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """``apart`` by numbers: the two are taken apart again, the later made of them first; a merge
        across the seam that comes before the pieces on both sides of it were made joins them."""
        n = len(self.left)
        out = np.ones(len(x), bool)
        on = np.arange(len(x))
        limit = np.full(len(on), n)
        while len(on):
            key = x * n + y
            slot = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
            joins = (self.pair[slot] == key) & (self.into[slot] < limit)
            out[on[joins]] = False
            base_x, base_y = self.right[x] == x, self.left[y] == y
            take_x = ~base_x & ((x > y) | base_y)
            go = ~joins & ~(base_x & base_y)
            limit = np.where(take_x, x, y + 1)
            x, y = np.where(take_x, self.right[x], x), np.where(take_x, y, self.left[y])
            on, x, y, limit = on[go], x[go], y[go], limit[go]
        return out


def _stay_apart(x: int, y: int, joined: dict[tuple[int, int], int], left: list[int], right: list[int]) -> bool:
    """``Merges.apart`` for one pair of numbers, while the tables are made."""
    limit = len(left)
    while True:
        if joined.get((x, y), limit) < limit:
            return False
        base_x, base_y = right[x] == x, left[y] == y
        if base_x and base_y:
            return True
        if not base_x and (x > y or base_y):
            limit, x = x, right[x]
        else:
            limit, y = y + 1, left[y]


@dataclass
class Pieces:
    """A model's pieces and their beginnings as sorted hash keys for each length, and the pieces' bytes by id."""

    keys: list[np.ndarray]
    ids: list[np.ndarray]
    scores: list[np.ndarray]
    unknown: float
    byte_ids: np.ndarray
    table: np.ndarray
    offsets: np.ndarray
    #: None for a unigram model.
    merges: Merges | None
    #: Pieces that are runs of spaces, by length: id and score. Merge models make them after all others.
    blanks: dict[int, tuple[int, float]]

    def blank_run(self, n: int) -> list[int]:
        """The pieces of ``n`` spaces that nothing else takes in: merged best score first, then leftmost."""
        size, after = [1] * n, list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = []

        def offer(i: int) -> None:
            j = after[i] if i >= 0 else n
            if i >= 0 and j < n and size[i] + size[j] in self.blanks:
                heapq.heappush(heap, (-self.blanks[size[i] + size[j]][1], i, size[i], size[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if size[i] else n
            if size[i] != a or j >= n or size[j] != b:
                continue
            size[i], size[j], after[i] = a + b, 0, after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [self.blanks[x][0] for x in size if x]


def merge_order(pieces: dict[str, tuple[int, float]]) -> Merges | None:
    """The merges of a model whose scores are the order of its merges; None for a unigram model.

    Trained merge models number their merges by whole scores, 0, -1, -2 and so on, each
    used once; only runs of spaces may share one.
    """
    made = [p for p in pieces if len(p) > 1 and p.strip(chr(SPACE))]
    scores = {pieces[p][1] for p in made}
    if not made or len(scores) < len(made) or any(x != int(x) for x in scores):
        return None
    ranked = [p for p in pieces if len(p) == 1] + sorted(made, key=lambda p: -pieces[p][1])
    return Merges(ranked, [pieces[p][0] for p in ranked])


def piece_keys(pieces: dict[str, tuple[int, float]]) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Sorted hash keys, ids and scores of pieces and of their beginnings, by length; a mere beginning has the id -1."""
    by: list[dict[int, tuple[int, float]]] = [{} for _ in range(max(map(len, pieces)))]
    for piece in sorted(pieces, key=len):
        cps = np.array([ord(c) for c in piece], np.int64)
        prefix, none = prefix_hash(cps), np.zeros(len(cps), np.int64)
        for k, key in enumerate(span_hash(prefix, none, np.arange(1, len(cps) + 1)).tolist()):
            by[k].setdefault(key, (-1, -np.inf))
        by[k][key] = pieces[piece]
    lists = [sorted((key, i, score) for key, (i, score) in one.items()) for one in by]
    return tuple([np.array([x[n] for x in one], t) for one in lists] for n, t in enumerate((np.uint64, np.int32, np.float64)))  # type: ignore[return-value]


def load_pieces(path: str = MODEL) -> Pieces:
    """Read a model file; the driver reads it and sends the tables, whose size is the model's."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.vocab_size()
    body, byte_ids, lowest = [b""] * n, np.full(256, -1, np.int64), 0.0
    pieces: dict[str, tuple[int, float]] = {}
    for i in range(n):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            body[i] = bytes([int(piece[3:5], 16)])
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            pieces[piece] = (i, model.get_score(i))
            body[i] = piece.replace(chr(SPACE), " ").encode()
            lowest = min(lowest, model.get_score(i))
    merges = merge_order(pieces)
    blanks = {len(p): v for p, v in pieces.items() if not p.strip(chr(SPACE))}
    left_out = set() if merges is None else set(merges.unmade) | {i for k, (i, _) in blanks.items() if k > 1}
    kept = {p: (i, score if merges is None else 0.0) for p, (i, score) in pieces.items() if i not in left_out}
    if merges is not None and any(chr(SPACE) in p.lstrip(chr(SPACE)) for p in pieces):
        raise ValueError("a piece goes on after a space, so words cannot be encoded apart")
    keys, ids, scores = piece_keys(kept)
    sizes = np.array([len(b) for b in body])
    return Pieces(
        keys,
        ids,
        scores,
        lowest - UNKNOWN_PENALTY if merges is None else 0.0,
        byte_ids,
        np.frombuffer(b"".join(body), np.uint8),
        np.concatenate([[0], np.cumsum(sizes)]),
        merges,
        blanks,
    )


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes and the byte at which each starts."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at].astype(np.int64)
    size = 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
    cps = np.where(size == 1, lead, lead & (0xFF >> (size + 1)))
    for k in (1, 2, 3):
        on = np.flatnonzero(size > k)
        cps[on] = (cps[on] << 6) | (data[at[on] + k] & 0x3F)
    return cps, at


def utf8_of(cp: int) -> bytes:
    return (chr(SPACE) if cp == LITERAL else chr(cp)).encode()


def segment_words(cps: np.ndarray, starts: np.ndarray, lengths: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of every word (flat), and the offsets of the words in them.

    Substrings are hashed and looked up in the sorted keys of their length, as long as
    a piece begins like them; then words of one length advance together, place by
    place, and keep the best score and the length of its last piece.
    """
    n = len(cps)
    prefix = prefix_hash(cps)
    word = np.repeat(np.arange(len(starts)), lengths)
    left = (starts + lengths)[word] - np.arange(n)  # characters from here to the end of the word
    longest = len(pieces.keys)
    found = np.full((longest, n), NO_PIECE, np.int32)
    score = None if pieces.merges is not None else np.full((longest, n), -np.inf)
    at = np.arange(n)
    for k in range(1, longest + 1):
        at = at[left[at] >= k]
        if not len(at):
            break
        h = span_hash(prefix, at, at + k)
        slot = np.minimum(np.searchsorted(pieces.keys[k - 1], h), len(pieces.keys[k - 1]) - 1)
        begun = pieces.keys[k - 1][slot] == h
        at, slot = at[begun], slot[begun]
        found[k - 1, at] = pieces.ids[k - 1][slot]
        if score is not None:
            score[k - 1, at] = pieces.scores[k - 1][slot]
    alone = found[0] == NO_PIECE
    found[0, alone] = LONE
    if score is not None:
        score[0, alone] = pieces.unknown
    got_word, got_end, got_id = [], [], []

    def take(words: np.ndarray, ends: np.ndarray, used: np.ndarray) -> None:
        got_word.append(words)
        got_end.append(ends)
        got_id.append(found[used - 1, starts[words] + ends - used])

    for size in np.unique(lengths):
        words = np.flatnonzero(lengths == size)
        if size > LONG_WORD:
            for w in words:
                take(*_one_long(int(w), int(starts[w]), int(size), score, found, pieces))
            continue
        for group in np.array_split(words, max(1, len(words) * int(size) // 200_000)):
            places = np.arange(size)[:, None] + starts[group]
            if score is None:
                back = _joined_paths(found[:, places], pieces.merges)
            else:
                best, back = np.full((size + 1, len(group)), -np.inf), np.zeros((size + 1, len(group)), np.int8)
                best[0] = 0.0
                for j in range(1, size + 1):
                    for k in range(min(j, longest), 0, -1):  # the longest first: it wins ties
                        cand = best[j - k] + score[k - 1, places[j - k]]
                        better = cand > best[j]
                        best[j] = np.where(better, cand, best[j])
                        back[j] = np.where(better, k, back[j])
            end = np.full(len(group), size)
            on = np.arange(len(group))
            while len(on):
                used = back[end[on], on].astype(np.int64)
                take(group[on], end[on].copy(), used)
                end[on] -= used
                on = on[end[on] > 0]
    w, e, i = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (got_word, got_end, got_id))
    order = np.lexsort((e, w))
    w, e, i = w[order], e[order], i[order].astype(np.int64)
    lost = np.flatnonzero(i < 0)
    if len(lost):  # byte pieces of characters that have none of their own
        bodies = [utf8_of(int(c)) for c in cps[starts[w[lost]] + e[lost] - 1]]
        repeat = np.ones(len(i), np.int64)
        repeat[lost] = [len(b) for b in bodies]
        flags = np.repeat(i < 0, repeat)
        w, i = np.repeat(w, repeat), np.repeat(i, repeat)
        i[flags] = pieces.byte_ids[np.frombuffer(b"".join(bodies), np.uint8)]
    return i, np.concatenate([[0], np.cumsum(np.bincount(w, minlength=len(starts)))])


def _joined_paths(found: np.ndarray, merges: Merges) -> np.ndarray:
    """The length of the last piece on the best path to each place; ``found`` has pieces by length, place and word.

    Of a merge model a path scores 0 or minus infinity, and one path to each place
    scores 0, so the maximum over the last piece is the first found that scores 0.
    """
    longest, size, n = found.shape
    back = np.zeros((size + 1, n), np.int8)
    last = np.full((size + 1, n), LONE, np.int32)
    for j in range(1, size + 1):
        open_ = np.ones(n, bool)
        for k in range(min(j, longest), 0, -1):
            piece = found[k - 1, j - k]
            on = np.flatnonzero(open_ & (piece != NO_PIECE))
            if len(on) and j > k:
                on = on[merges.apart(last[j - k, on], piece[on])]
            if len(on):
                back[j, on] = k
                last[j, on] = piece[on]
                open_[on] = False
                if len(on) == n:
                    break
    return back


def _one_long(word: int, start: int, size: int, score: np.ndarray | None, found: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same search for one long word, over its table of scores; pairs of pieces are looked at once each."""
    longest = len(found)
    best, back, apart = [0.0] + [-np.inf] * size, [0] * (size + 1), {}
    block = 1 << 16  # places whose table is held as lists
    for s in range(0, size, block):
        here = slice(start + s, start + min(s + block, size))
        names = found[:, here].T.tolist()
        table = (np.where(found[:, here] == NO_PIECE, -np.inf, 0.0) if score is None else score[:, here]).T.tolist()
        for p, (row, name) in enumerate(zip(table, names), s):
            base, used = best[p], back[p]
            last = int(found[used - 1, start + p - used]) if used else LONE
            for k in range(min(longest, size - p) - 1, -1, -1):
                if base + row[k] > best[p + k + 1] or (base + row[k] == best[p + k + 1] > -np.inf and k + 1 > back[p + k + 1]):
                    if pieces.merges is not None and last >= 0 and name[k] >= 0:
                        pair = (last, name[k])
                        if pair not in apart:
                            apart[pair] = bool(pieces.merges.apart(np.array([pair[0]]), np.array([pair[1]]))[0])
                        if not apart[pair]:
                            continue
                    best[p + k + 1], back[p + k + 1] = base + row[k], k + 1
    ends, used, e = [], [], size
    while e:
        ends.append(e)
        used.append(back[e])
        e -= back[e]
    return np.full(len(ends), word), np.array(ends), np.array(used)


class Encoder:
    """Encodes and decodes columns of texts; remembers the pieces of words it has seen."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.place = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int64)
        self.spelt = np.zeros(0, np.int64)  # where the characters of each word stand
        self.wide = np.zeros(0, np.int64)
        self.chars = np.zeros(0, np.int32)

    def _segment(self, cps: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of words (flat) and their offsets; spaces before a word's own are merged after it."""
        size = ends - starts
        lead = np.zeros(len(starts), np.int64)
        if self.pieces.merges is not None:
            two = np.flatnonzero((size > 1) & (cps[np.minimum(starts + 1, len(cps) - 1)] == SPACE))
            for w in two.tolist():
                own = cps[starts[w] : ends[w]]
                other = np.flatnonzero(own != SPACE)
                lead[w] = (other[0] if len(other) else len(own)) - 1
        n = size - lead
        at = np.cumsum(n) - n
        chars = cps[np.arange(int(n.sum())) + np.repeat(starts + lead - at, n)]
        flat, offs = segment_words(chars, at, n, self.pieces)
        if not lead.any():
            return flat, offs
        out, bare = np.split(flat, offs[1:-1]), self.pieces.blanks[1][0]
        for w in np.flatnonzero(lead).tolist():
            free = out[w][0] == bare
            out[w] = np.concatenate([self.pieces.blank_run(int(lead[w] + free)), out[w][int(free) :]]).astype(np.int64)
        return np.concatenate(out), np.concatenate([[0], np.cumsum([len(x) for x in out])])

    def _learn(self, cps: np.ndarray, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Segment new words, a bounded number of characters at a time, and remember them."""
        size = ends - starts
        group = np.cumsum(size) // AT_ONCE
        cuts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        places, sizes, flats, base = [], [], [self.flat], len(self.flat)
        for a, b in zip(cuts, np.append(cuts[1:], len(size))):
            flat, offs = self._segment(cps, starts[a:b], ends[a:b])
            places.append(base + offs[:-1])
            sizes.append(np.diff(offs))
            flats.append(flat)
            base += len(flat)
        known = np.concatenate([self.known, keys])
        order = np.argsort(known, kind="stable")
        letters = np.cumsum(size) - size
        self.spelt = np.concatenate([self.spelt, len(self.chars) + letters])[order]
        self.wide = np.concatenate([self.wide, size])[order]
        self.chars = np.concatenate([self.chars, cps[np.arange(int(size.sum())) + np.repeat(starts - letters, size)].astype(np.int32)])
        self.place = np.concatenate([self.place, *places])[order]
        self.size = np.concatenate([self.size, *sizes])[order]
        self.known, self.flat = known[order], np.concatenate(flats)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat piece ids of all texts, and the offsets of the texts in them."""
        n = len(offsets) - 1
        cps, at = code_points(data)
        first = np.searchsorted(at, offsets)  # in code points
        filled = np.flatnonzero(np.diff(first))
        cps[cps == SPACE] = LITERAL
        cps[cps == 0x20] = SPACE
        cps = np.insert(cps, first[filled], SPACE)  # each text that is not empty starts with a space
        count = np.diff(first)
        count[filled] += 1
        first = np.concatenate([[0], np.cumsum(count)])
        space = cps == SPACE
        opens = space & ~np.append(False, space[:-1])
        opens[first[:-1][filled]] = True
        starts = np.flatnonzero(opens)
        ends = np.append(starts[1:], len(cps))
        h = span_hash(prefix_hash(cps), starts, ends) if len(starts) else np.zeros(0, np.uint64)
        uniq, one, which = np.unique(h, return_index=True, return_inverse=True)
        if len(self.known) > CACHED_WORDS:
            self._forget()
        slot = np.minimum(np.searchsorted(self.known, uniq), max(len(self.known) - 1, 0))
        new = self.known[slot] != uniq if len(self.known) else np.ones(len(uniq), bool)
        if new.any():
            self._learn(cps, uniq[new], starts[one[new]], ends[one[new]])
        slot = np.searchsorted(self.known, uniq)[which]
        size = self.size[slot]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.arange(int(total[-1])) + np.repeat(self.place[slot] - total[:-1], size)]
        letters = np.minimum(np.arange(len(cps)) + np.repeat(self.spelt[slot] - starts, ends - starts), len(self.chars) - 1)
        other = np.flatnonzero(self.chars[letters] != cps) if len(cps) else letters
        odd = np.unique(np.append(np.searchsorted(starts, other, "right") - 1, np.flatnonzero(self.wide[slot] != ends - starts)))
        if len(odd):  # words of one hash that are not one word
            own, own_at = self._segment(cps, starts[odd], ends[odd])
            parts = np.split(ids, total[1:-1])
            for i, w in enumerate(odd.tolist()):
                parts[w] = own[own_at[i] : own_at[i + 1]]
            ids, total = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        words = np.searchsorted(starts, first)
        return ids, total[words]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of all texts, and their offsets; the space before each text is dropped."""
        p = self.pieces
        size = np.diff(p.offsets)[ids]
        total = np.concatenate([[0], np.cumsum(size)])
        out = p.table[np.arange(int(total[-1])) + np.repeat(p.offsets[ids] - total[:-1], size)]
        at = total[offsets]
        drop = at[:-1][np.diff(offsets) > 0]
        return np.delete(out, drop), at - np.searchsorted(drop, at)


def tokens(docs: DataFrame, path: str = MODEL, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Encode every whole text and decode it again.

    Returns id, n_bytes, n_tokens, ids_sha256 (ids as little-endian 32-bit integers),
    decoded_sha256 (of the decoded UTF-8), round_trip, and token_ids if asked for. With a
    merge model the ids are those of the model's own encoder. Defined cases: a null or empty text has no tokens; a literal U+2581 is kept by byte
    pieces; runs of spaces and spaces at either end are kept; repeated rows each give
    a row; an empty table gives none; other columns are not looked at.
    """
    sent = docs.sparkSession.sparkContext.broadcast(load_pieces(path))
    names = ["id", "n_bytes", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip", *["token_ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(sent.value)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                data, offsets = column_bytes(part.column("text"))
                ids, at = encoder.encode(data, offsets)
                back, back_at = encoder.decode(ids, at)
                raw, small = back.tobytes(), ids.astype("<i4")
                raw_ids, source = small.tobytes(), data.tobytes()
                rows = []
                for i in range(part.num_rows):
                    text = raw[back_at[i] : back_at[i + 1]]
                    rows.append((int(offsets[i + 1] - offsets[i]), int(at[i + 1] - at[i]), hashlib.sha256(raw_ids[4 * at[i] : 4 * at[i + 1]]).hexdigest(), hashlib.sha256(text).hexdigest(), text == source[offsets[i] : offsets[i + 1]]))
                cols = [part.column("id"), *(pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_())))]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(small)))
                yield pa.record_batch(cols, names)

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, n_bytes long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean"
    return rows.mapInArrow(run, schema + ", token_ids array<int>" * with_ids)


def op10_batched_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` encoded and decoded."""
    return tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False).withColumnRenamed("id", "doc_id")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: the token ids of every document, and whether they decode to its text.

    Every row of the stage before gives a row: a null or empty text one without tokens,
    a null id one with a null id, a very long text one as any other, repeated rows one
    each; an empty table gives none; other columns are not looked at.
    """
    return tokens(docs).select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", "ids_sha256", "round_trip", "token_ids")
