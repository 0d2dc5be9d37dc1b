"""Token ids of texts, each distinct stretch of text encoded once a worker.

A tokenizer splits a text into pieces that it encodes one by one. A chunk of
texts is cut at places where a piece surely ends, each distinct cut is encoded
by the library once, and ids are put together again in place. Encoded cuts are
kept, up to a fixed number, while the worker lives.

Three rules of cutting: ``ByteLevelEncoder`` for byte-level BPE that keeps
blanks, ``WordEncoder`` for word BPE that drops them, ``PieceEncoder`` for
SentencePiece models whose pieces hold a blank only at their start.
"""

from __future__ import annotations

import os

import numpy as np

from tessera.llm.words import _BASE, _BYTE_VALUE, _INVERSE, _power, mix, ranges, row_sums

KEPT_CUTS = 1 << 21
SLOTS = 1 << 22

# byte classes: 1 ASCII letter, 2 ASCII digit, 3 other ASCII that is seen but the apostrophe, 4 apostrophe, 5 space, 6 other blanks and controls, 7 not ASCII
_KIND = np.full(256, 7, np.uint8)
_KIND[:128] = [6 if c < 33 or c == 127 else 1 if chr(c).isalpha() else 2 if chr(c).isdigit() else 3 for c in range(128)]
_KIND[39], _KIND[32] = 4, 5
_CUT = np.zeros((8, 8), bool)
#: a space begins a piece if what stands before it is seen; so does a letter, digit or sign after one of another kind
_CUT[[1, 2, 3, 4], 5] = True
for _a in (1, 2, 3):
    for _b in (1, 2, 3):
        _CUT[_a, _b] = _a != _b
#: a line feed right after a seen ASCII character, and what is seen right after a line feed
_CUT[[1, 2, 3, 4], 6] = True

#: white space of ASCII, which word BPE drops, and signs that end a word of letters
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".,;:!?)")] = True


def kinds(data: np.ndarray) -> np.ndarray:
    kind = _KIND[data]
    # the letters of Latin-1 count as letters: two bytes, the first of them 0xC3
    lead = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7))
    kind[lead] = kind[lead + 1] = 1
    return kind


def occurrences(data: np.ndarray, text: np.ndarray, string: bytes) -> np.ndarray:
    """Starts of the leftmost non-overlapping occurrences of ``string`` that lie within a row."""
    raw, out, at = data.tobytes(), [], -1
    while (at := raw.find(string, at + 1 if at < 0 else at)) >= 0:
        row_end = text[np.searchsorted(text, at, side="right")]
        whole = at + len(string) <= row_end
        if whole:
            out.append(at)
        at += len(string) if whole else 1
    return np.array(out, np.int64)


def cut_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each cut, and a second one over its length and first and last eight bytes."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[data] * _power(_BASE, n + 1, "base")[:n], out=sums[1:])
    h = mix((sums[end] - sums[start]) * _power(_INVERSE, n + 1, "inverse")[start], 1)
    padded = np.zeros(n + 16, np.uint8)
    padded[8:n + 8] = data
    eight = np.ndarray(n + 9, np.dtype("<u8"), padded, strides=(1,))
    size = end - start
    shift = (np.maximum(8 - size, 0) * 8).astype(np.uint64)
    head = eight[start + 8] << shift
    tail = eight[end] >> shift
    return h, mix(head ^ mix(tail + size.astype(np.uint64), 5), 3)


class CutEncoder:
    """Ids of cuts, each distinct one encoded once.

    A table of ``slots`` places finds most cuts in one look; those whose place
    is taken are found in a sorted list. Identity is a 64-bit hash, checked
    against the length and the first and last eight bytes.
    """

    def __init__(self, kept: int | None = None, slots: int | None = None):
        self.kept, self.slots = kept or KEPT_CUTS, slots or SLOTS
        self.clear()

    def split(self, data: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the cuts of a chunk; no cut crosses a row."""
        raise NotImplementedError

    def alone(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Cuts that the tokenizer doesn't split into pieces."""
        return np.zeros(len(start), bool)

    def cut_ids(self, cut: list[str], single: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of the cuts, how many each has, and whether they spell the cut; ``single``: each cut is one piece."""
        raise NotImplementedError

    def clear(self) -> None:
        self.place = np.full(self.slots, -1, np.int32)
        self.sorted = np.empty(0, np.uint64)
        self.sorted_cut = np.empty(0, np.int64)
        self.n = 0
        self.hash = np.empty(1 << 16, np.uint64)
        self.check = np.empty(1 << 16, np.uint64)
        self.exact = np.empty(1 << 16, bool)
        self.start = np.zeros((1 << 16) + 1, np.int64)
        self.ids = np.empty(1 << 18, np.int32)

    def _room(self, name: str, n: int) -> None:
        have = getattr(self, name)
        if len(have) < n:
            grown = np.zeros(max(n, 2 * len(have)), have.dtype)
            grown[:len(have)] = have
            setattr(self, name, grown)

    def _find(self, h: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Number of each cut, -1 if it isn't known."""
        if not self.n:
            return np.full(len(h), -1, np.int64)
        got = self.place[(h & np.uint64(self.slots - 1)).astype(np.int64)].astype(np.int64)
        wrong = np.flatnonzero((got < 0) | (self.hash[got] != h) | (self.check[got] != check))
        got[wrong] = -1
        if len(wrong) and len(self.sorted):
            at = np.minimum(np.searchsorted(self.sorted, h[wrong]), len(self.sorted) - 1)
            cut = self.sorted_cut[at]
            got[wrong] = np.where((self.sorted[at] == h[wrong]) & (self.check[cut] == check[wrong]), cut, -1)
        return got

    def _add(self, h: np.ndarray, check: np.ndarray, cut: list[str], single: bool) -> None:
        if not cut:
            return
        n, new = self.n, len(h)
        ids, size, exact = self.cut_ids(cut, single)
        end = self.start[n] + np.cumsum(size)
        for name, need in (("hash", n + new), ("check", n + new), ("exact", n + new), ("start", n + new + 1), ("ids", int(end[-1]))):
            self._room(name, need)
        self.hash[n:n + new], self.check[n:n + new], self.exact[n:n + new] = h, check, exact
        self.ids[self.start[n]:end[-1]] = ids
        self.start[n + 1:n + new + 1] = end
        number = np.arange(n, n + new)
        slot = (h & np.uint64(self.slots - 1)).astype(np.int64)
        free = self.place[slot] < 0
        self.place[slot[free]] = number[free]
        apart = self.place[slot] != number
        keys, cuts_ = np.concatenate([self.sorted, h[apart]]), np.concatenate([self.sorted_cut, number[apart]])
        order = np.argsort(keys, kind="stable")
        self.sorted, self.sorted_cut = keys[order], cuts_[order]
        self.n += new

    def encode_checked(self, data: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the rows of a chunk, one row after the other, their row offsets, and whether a row's ids spell its text."""
        rows = len(text) - 1
        if not len(data):
            return np.empty(0, np.int32), np.zeros(rows + 1, np.int64), np.ones(rows, bool)
        if self.n > self.kept:
            self.clear()
        start, end = self.split(data, text)
        if not len(start):
            return np.empty(0, np.int32), np.zeros(rows + 1, np.int64), np.diff(text) == 0
        h, check = cut_hashes(data, start, end)
        got = self._find(h, check)
        new = np.flatnonzero(got < 0)
        if len(new):
            _, first = np.unique(h[new], return_index=True)
            one = new[first]
            raw = data.tobytes()
            alone = self.alone(data, start[one], end[one])
            for single in (True, False):
                k = one[alone == single]
                self._add(h[k], check[k], [raw[a:b].decode() for a, b in zip(start[k].tolist(), end[k].tolist(), strict=True)], single)
            got[new] = self._find(h[new], check[new])
            for k in np.flatnonzero(got < 0).tolist():  # two new cuts of one hash
                self._add(h[k:k + 1], check[k:k + 1], [raw[start[k]:end[k]].decode()], False)
                got[k] = self.n - 1
        size = self.start[got + 1] - self.start[got]
        total = np.concatenate([[0], np.cumsum(size)])
        at = np.searchsorted(start, text)
        return self.ids[ranges(self.start[got], size)], total[at], row_sums(~self.exact[got], at) == 0

    def encode(self, data: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the rows of a chunk, one row after the other, and their row offsets."""
        return self.encode_checked(data, text)[:2]


class _Library(CutEncoder):
    """Cuts by a file of the tokenizers library.

    ``specials``: strings of special tokens in a text become their ids, as the
    library does unless told otherwise; else they are ordinary text.
    """

    def __init__(self, path: str, specials: bool = True, kept: int | None = None, slots: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.path = path
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = not specials
        self.special = [t.content.encode() for t in self.whole.get_added_tokens_decoder().values()] if specials else []
        super().__init__(kept, slots)

    def apart(self, data: np.ndarray, text: np.ndarray, begin: np.ndarray) -> None:
        """No cut inside the string of a special token, and one at each of its ends."""
        for string in self.special:
            for at in occurrences(data, text, string).tolist():
                begin[at + 1:at + len(string)] = False
                begin[at] = begin[at + len(string)] = True

    def cut_ids(self, cut: list[str], single: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.whole.encode_batch(cut, add_special_tokens=False)]
        return np.fromiter((i for x in ids for i in x), np.int32), np.fromiter(map(len, ids), np.int64, len(ids)), np.ones(len(cut), bool)


class ByteLevelEncoder(_Library):
    """Byte-level BPE that keeps blanks: a piece is a word, number or run of signs with at most one space before it."""

    def __init__(self, path: str, specials: bool = True, kept: int | None = None, slots: int | None = None):
        super().__init__(path, specials, kept, slots)
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel
        self.piece = Tokenizer.from_file(path)
        self.piece.encode_special_tokens = True
        self.piece.pre_tokenizer = ByteLevel(add_prefix_space=False, use_regex=False)

    def split(self, data: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kind = kinds(data)
        begin = np.zeros(len(data) + 1, bool)
        begin[1:-1] = _CUT[kind[:-1], kind[1:]]
        self.apart(data, text, begin)
        begin[text] = True
        start = np.flatnonzero(begin[:-1])
        return start, np.append(start[1:], len(data))

    def alone(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Cuts of letters, digits or signs only, after a space or not."""
        kind = kinds(data)
        changes = np.concatenate([[0], np.cumsum(kind[1:] != kind[:-1])])
        begin = start + ((kind[start] == 5) & (end - start > 1))
        return (changes[end - 1] == changes[begin]) & (kind[begin] <= 3)

    def cut_ids(self, cut: list[str], single: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not single:
            return super().cut_ids(cut, single)
        got = self.piece.encode(cut, is_pretokenized=True, add_special_tokens=False)
        return np.array(got.ids, np.int32), np.bincount(np.array(got.word_ids, np.int64), minlength=len(cut)), np.ones(len(cut), bool)

    def token_bytes(self) -> list[bytes]:
        """The bytes that each id stands for."""
        own = bytes_of_characters()
        vocab = self.whole.get_vocab(with_added_tokens=False)
        out = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            out[i] = bytes(own[c] for c in token)
        return out


def bytes_of_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: seen characters for themselves, the others from 256 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(rest)}


class WordEncoder(_Library):
    """Word BPE that drops white space: a piece ends at a blank, and a word of ASCII letters before a stop."""

    def split(self, data: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        blank = _BLANK[data]
        begin = np.zeros(len(data) + 1, bool)
        begin[1:-1] = (blank[1:] != blank[:-1]) | (_STOP[data[1:]] & (_KIND[data[:-1]] == 1))
        self.apart(data, text, begin)
        begin[text] = begin[len(data)] = True
        edge = np.flatnonzero(begin)
        seen = ~blank[edge[:-1]]
        return edge[:-1][seen], edge[1:][seen]


class PieceEncoder(CutEncoder):
    """SentencePiece model that writes a space as U+2581, adds one before a text and has no piece with one after another character.

    Rows are texts with that space already before them.
    """

    def __init__(self, path: str, kept: int | None = None, slots: int | None = None):
        import sentencepiece
        self.path = path
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = self.token_bytes()
        if any(b" " in t.lstrip(b" ") for t in self.bytes):
            raise ValueError(f"{path} has pieces with a blank inside")
        super().__init__(kept, slots)

    def token_bytes(self) -> list[bytes]:
        """The bytes that each id stands for."""
        m = self.model
        pieces = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        return [bytes([int(p[3:5], 16)]) if m.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]

    def split(self, data: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        space = data == 32
        begin = np.zeros(len(data) + 1, bool)
        begin[1:-1] = space[1:] & ~space[:-1]
        begin[text] = True
        start = np.flatnonzero(begin[:-1])
        return start, np.append(start[1:], len(data))

    def cut_ids(self, cut: list[str], single: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        # the model adds the first space; of a text that is nothing else it makes no piece
        lone = self.model.piece_to_id("▁")
        ids = [x or [lone] for x in self.model.encode([c[1:] for c in cut], num_threads=1)]
        exact = [b"".join(map(self.bytes.__getitem__, x)) == c.encode() for x, c in zip(ids, cut, strict=True)]
        return np.fromiter((i for x in ids for i in x), np.int32), np.fromiter(map(len, ids), np.int64, len(ids)), np.array(exact, bool)


_encoders: dict[tuple, CutEncoder] = {}


def encoder(kind: type[CutEncoder], path: str, **options) -> CutEncoder:
    """One encoder of each kind, file and options a worker."""
    key = (kind, path, *sorted(options.items()))
    if key not in _encoders:
        _encoders[key] = kind(path, **options)
    return _encoders[key]
