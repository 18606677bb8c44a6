"""Token ids of whole texts, through the tokenizers library with a table of pieces.

The vocabulary's pre-tokenizer never joins characters over white space, so a text's ids are those of its words in turn.
Words are cut out of the texts' bytes by numpy. A word of letters with closing punctuation is two pieces of the
pre-tokenizer; any other word is one piece, whatever it holds. Letters whose normal form has anything but letters
(a base and a mark) are never parted from what follows. Distinct pieces are encoded by the library once for each worker
and looked up by their bytes afterwards.
"""

from __future__ import annotations

import os
import unicodedata

import numpy as np

#: Pieces kept by a worker; beyond, those that were not met again go (bounds memory, not results).
KEPT_PIECES = 1_000_000
#: Closing characters that are a pre-token of their own behind letters; apostrophes and angle brackets are not among them.
TAIL = ".,!?;:|#$%&*"
#: Pieces that one call of the library encodes, and bytes of text that are cut at once.
JOIN, SLICE = 4000, 4 << 20
#: Bytes of a piece that the table holds; longer ones are in a dict.
LANES = 3
WIDE = 8 * LANES

# Classes of bytes: blanks between words, letters (or parts of any other character), closing punctuation, others.
_BLANK, _LETTER, _CLOSING, _OTHER = range(4)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[list(b" \n\t")] = _BLANK
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = _LETTER
_CLASS[list(TAIL.encode())] = _CLOSING
_MASK = np.array([(1 << 8 * min(n, 8)) - 1 for n in range(9)], np.uint64)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _plain(text: str) -> bool:
    """Only characters up to U+00FF, among which there are no marks to compose."""
    if not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
    return True


def _lowered(text: str) -> str:
    """Lower case where that surely changes no id."""
    return text.lower() if _plain(text) else text


def stands_alone(letters: str) -> bool:
    """Whether a piece is letters only in the normal form too, so that nothing behind it can join it."""
    if _plain(letters):  # nothing composes or falls apart
        return letters.isalpha() or letters.isascii()
    return "".join(c.lower() for c in unicodedata.normalize("NFC", letters)).isalpha()


class Table:
    """Keys of LANES unsigned numbers -> places 0, 1, 2 ... in the order of their coming; open addressing."""

    def __init__(self, bits: int = 12):
        self.keys, self.count = np.zeros((LANES, 0), np.uint64), 0
        self._resize(bits)

    def _resize(self, bits: int) -> None:
        self.bits, self.slots = bits, np.full(1 << bits, -1, np.int32)
        if self.count:
            self._put(np.arange(self.count, dtype=np.int32))

    def _home(self, keys: np.ndarray) -> np.ndarray:
        h = keys[0] * _ODD[0]
        for k, odd in zip(keys[1:], _ODD[1:], strict=True):
            h ^= (k ^ (h >> np.uint64(29))) * odd
        return (((h ^ (h >> np.uint64(32))) * _ODD[0]) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _put(self, places: np.ndarray) -> None:
        at, full = self._home(self.keys[:, places]), (1 << self.bits) - 1
        while len(places):
            free = self.slots[at] < 0
            self.slots[at[free]] = places[free]  # of several for one slot the last one stays
            lost = self.slots[at] != places
            places, at = places[lost], (at[lost] + 1) & full

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, -1 for unknown ones."""
        at, full = self._home(keys), (1 << self.bits) - 1
        out = self.slots[at]
        known = np.maximum(out, 0)
        wrong = out >= 0
        if self.count:
            wrong &= np.logical_or.reduce([mine[known] != k for mine, k in zip(self.keys, keys, strict=True)])
        left = np.flatnonzero(wrong)
        at = at[left]
        while len(left):
            at = (at + 1) & full
            got = self.slots[at]
            out[left] = got
            on = (got >= 0) & (self.keys[:, np.maximum(got, 0)] != keys[:, left]).any(axis=0)
            left, at = left[on], at[on]
        return out

    def add(self, keys: np.ndarray) -> np.ndarray:
        """Keys that are not in the table, in some order and repeated -> the place in `keys` of each new one."""
        order = np.lexsort(keys)
        ordered = keys[:, order]
        first = np.append([True], (ordered[:, 1:] != ordered[:, :-1]).any(axis=0))
        new = order[first]
        self.keys = np.concatenate([self.keys, keys[:, new]], axis=1)
        places = np.arange(self.count, self.count + len(new), dtype=np.int32)
        self.count += len(new)
        if 2 * self.count > len(self.slots):
            self._resize((2 * self.count).bit_length() + 1)
        else:
            self._put(places)
        return new

    def keep(self, places: np.ndarray) -> None:
        """Only these places stay, numbered anew."""
        self.keys, self.count = self.keys[:, places], len(places)
        self._resize(max(12, (2 * self.count).bit_length() + 1))


class Runs:
    """Ids of pieces, on end."""

    def __init__(self):
        self.flat, self.starts, self.lens = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def add(self, ids: np.ndarray, lens: np.ndarray) -> None:
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lens) - lens])
        self.lens = np.concatenate([self.lens, lens.astype(np.int32)])
        self.flat = np.concatenate([self.flat, ids.astype(np.uint32)])

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces `at` on end, and how many there are before each, and in all."""
        lens = self.lens[at]
        ends = np.cumsum(lens, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.starts[at] - (ends - lens), lens) + np.arange(total)], np.append(0, ends)

    def keep(self, places: np.ndarray) -> None:
        ids, ends = self.gather(places)
        self.flat, self.starts, self.lens = ids, ends[:-1], self.lens[places]


class WordEncoder:
    """encode(texts) -> (ids of all texts on end, number of ids of each)."""

    def __init__(self, path: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path or default_vocabulary())
        #: For letters that are in lower case and composed already: the same model, without the steps that leave them alone.
        self.bare = Tokenizer.from_file(path or default_vocabulary())
        self.bare.normalizer = None
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.bare.model._resize_cache(0)
        vocab = self.tok.get_vocab()
        self.closes = np.zeros(max(vocab.values()) + 1, bool)
        for piece, i in vocab.items():
            self.closes[i] = piece.endswith("</w>")
        self.clear()

    def clear(self) -> None:
        self.table, self.runs = Table(), Runs()
        #: Of each piece of the table: whether it may be parted from what closes it, and whether it was met again.
        self.alone, self.again = np.zeros(0, bool), np.zeros(0, bool)
        self.long: dict[bytes, tuple[np.ndarray, bool]] = {}

    def encode_plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_pieces(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids on end and their number for each piece. Letters are encoded many at once and cut where a word ends; if
        the cuts don't fit, one by one."""
        ids, lens = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for at in range(0, len(new), JOIN):
            part = new[at : at + JOIN]
            joined, ends = " ".join(part), []
            if joined.replace(" ", "").isalpha():
                tok = self.bare if _plain(joined) and joined == joined.lower() else self.tok
                found = np.array(tok.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.int64)
                ends = np.flatnonzero(self.closes[found]) + 1
            if len(ends) == len(part):
                ids.append(found.astype(np.uint32))
                lens.append(np.diff(ends, prepend=0))
            else:
                each = self.encode_plain(part)
                ids.append(np.array([x for y in each for x in y], np.uint32))
                lens.append(np.fromiter(map(len, each), np.int64, len(each)))
        return np.concatenate(ids), np.concatenate(lens)

    def _shrink(self) -> None:
        keep = np.flatnonzero(self.again)
        keep = keep[: KEPT_PIECES // 2]
        self.table.keep(keep)
        self.runs.keep(keep)
        self.alone, self.again = self.alone[keep], np.zeros(len(keep), bool)

    def _learn(self, keys: np.ndarray, data: bytes, starts: np.ndarray, ends: np.ndarray) -> None:
        """Encode pieces that the table does not hold; letters come first, so that they go to the library together."""
        new = self.table.add(keys)
        pieces = [data[a:b].decode() for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)]
        letters = np.fromiter(map(str.isalpha, pieces), bool, len(pieces))
        order = np.argsort(~letters, kind="stable")
        ids, lens = self._encode_pieces([pieces[i] for i in order.tolist()])
        fresh = Runs()
        fresh.add(ids, lens)
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        ids, _ = fresh.gather(back)
        self.runs.add(ids, fresh.lens[back])
        alone = np.fromiter(map(stands_alone, pieces), bool, len(pieces))
        self.alone = np.concatenate([self.alone, alone])
        self.again = np.concatenate([self.again, np.zeros(len(new), bool)])

    def _places(self, data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Place of each piece in the runs; none is longer than WIDE."""
        lens, keys = ends - starts, []
        for lane in range(LANES):
            words = np.ndarray((len(data) - WIDE + 1,), "<u8", data, 8 * lane if lane else 0, (1,))
            keys.append(words[starts] & _MASK[np.clip(lens - 8 * lane, 0, 8)])
        keys = np.stack(keys)
        at = self.table.find(keys)
        new = np.flatnonzero(at < 0)
        self.again[at[at >= 0]] = True
        if len(new):
            self._learn(keys[:, new], data, starts[new], ends[new])
            at[new] = self.table.find(keys[:, new])
        return at

    def _cut(self, data: bytes, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the pieces of data[a:b], and whether what closes the piece before it is all it is."""
        kind = _CLASS[np.frombuffer(data, np.uint8, b - a, a)]
        starts = np.flatnonzero(np.append([True], kind[1:] != kind[:-1]))
        ends = np.append(starts[1:], b - a)
        kind = kind[starts]
        full = kind != _BLANK
        first = full & np.append([True], ~full[:-1])
        starts, ends, kind, first = starts[full], ends[full], kind[full], first[full]
        begins = np.flatnonzero(first)
        n = np.diff(np.append(begins, len(first)))
        parts = (n == 1) | ((n == 2) & (kind[begins] == _LETTER) & (np.append(kind, 0)[np.minimum(begins + 1, len(kind))] == _CLOSING))
        ends[begins[~parts]] = ends[(begins + n - 1)[~parts]]
        keep = first | np.repeat(parts, n)
        return starts[keep] + a, ends[keep] + a, ~first[keep]

    def _slice(self, data: bytes, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of the pieces of data[a:b], their ids on end, and the number of ids before each and in all."""
        starts, ends, closing = self._cut(data, a, b)
        if not len(starts):
            return starts, np.zeros(0, np.uint32), np.zeros(1, np.int64)
        if self.table.count > KEPT_PIECES:
            self._shrink()
        wide = np.flatnonzero(ends - starts > WIDE)
        # a long piece stands for itself, together with what closes it
        glued = wide[np.append(closing, False)[wide + 1]]
        at = np.full(len(starts), -1, np.int64)
        narrow = np.ones(len(starts), bool)
        narrow[wide] = False
        narrow[glued + 1] = False
        at[narrow] = self._places(data, starts[narrow], ends[narrow])
        bad = np.flatnonzero(closing[1:] & narrow[1:] & narrow[:-1] & ~self.alone[at[:-1]])
        if len(bad):  # letters that may not be parted from what closes them
            short = bad[ends[bad + 1] - starts[bad] <= WIDE]
            at[short] = self._places(data, starts[short], ends[short + 1])
            over = bad[ends[bad + 1] - starts[bad] > WIDE]
            wide, glued = np.concatenate([wide, over]), np.concatenate([glued, over])
        gone = np.concatenate([glued, bad]) + 1
        ends[np.concatenate([glued, bad])] = ends[gone]
        if not len(wide):
            keep = np.ones(len(starts), bool)
            keep[gone] = False
            ids, before = self.runs.gather(at[keep])
            return starts[keep], ids, before
        keep = np.ones(len(starts), bool)
        keep[gone] = False
        single = np.zeros(len(starts), bool)
        single[wide] = True
        starts, ends, at, single = starts[keep], ends[keep], at[keep], single[keep]
        own = np.flatnonzero(single)
        each = self.encode_plain([data[a:b].decode() for a, b in zip(starts[own].tolist(), ends[own].tolist(), strict=True)])
        extra = Runs()
        extra.flat, extra.starts, extra.lens = self.runs.flat, self.runs.starts, self.runs.lens
        extra.add(np.array([x for y in each for x in y], np.uint32), np.fromiter(map(len, each), np.int64, len(each)))
        at[own] = len(self.runs.lens) + np.arange(len(own))
        ids, before = extra.gather(at)
        return starts, ids, before

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [_lowered(t).encode() for t in texts]
        offsets = np.cumsum([0] + [len(x) + 1 for x in raw])
        data = b"\n".join(raw) + b"\n"
        size = len(data)
        data += bytes(WIDE + 8)
        ids, before, total, a = [np.zeros(0, np.uint32)], np.zeros(len(texts) + 1, np.int64), 0, 0
        while a < size:
            b = min(size, a + SLICE)
            if b < size:
                cut = max(data.rfind(c, a, b) for c in (b" ", b"\n", b"\t"))
                if cut < 0:  # one word that is longer than a slice
                    cut = min(x for c in (b" ", b"\n", b"\t") if (x := data.find(c, b, size)) >= 0)
                b = cut + 1
            starts, found, counts = self._slice(data, a, b)
            inside = slice(int(np.searchsorted(offsets, a)), int(np.searchsorted(offsets, b)))
            own = offsets[inside]
            before[inside] = total + counts[np.searchsorted(starts, own)]
            ids.append(found)
            total += len(found)
            a = b
        before[-1] = total
        return np.concatenate(ids), np.diff(before)


_encoders: dict[str | None, WordEncoder] = {}


def encoder(path: str | None = None) -> WordEncoder:
    """One encoder for each worker and vocabulary."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
