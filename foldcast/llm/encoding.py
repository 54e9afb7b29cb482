"""Token ids of whole texts, working out each distinct word once while it is remembered."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa

from foldcast.llm.common import slices, tokenizer_path

#: Characters handled at a time, and words that a worker remembers; beyond, it forgets all.
SLICE, MEMORY = 3_000_000, 600_000

_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Classes of bytes for ``piece_starts``.
LETTER, DIGIT, MARK = 1, 2, 3


def byte_kinds(besides: str = "") -> np.ndarray:
    """The class of each byte, 0 for those of no class: white space, bytes of more than ASCII, the
    apostrophe (which begins contractions), and all of ``besides`` but letters."""
    kinds = np.zeros(256, np.uint8)
    kinds[33:127] = MARK
    kinds[48:58] = DIGIT
    kinds[[*range(65, 91), *range(97, 123)]] = LETTER
    for char in "'" + besides:
        if char.isascii() and not char.isalpha():
            kinds[ord(char)] = 0
    return kinds


def kinds_of(data: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """The class of each byte of ``data`` (UTF-8): the Latin letters of two bytes, from U+00C0 to
    U+024F, are letters too."""
    out = kinds[data]
    at = np.flatnonzero((data >= 0xC3) & (data <= 0xC9))
    second = data[at + 1]
    lead = data[at]
    at = at[((lead > 0xC3) | ((second != 0x97) & (second != 0xB7))) & ((lead < 0xC9) | (second <= 0x8F))]
    out[at] = out[at + 1] = LETTER
    return out


def bytes_behind_blanks(added: Sequence[str] = ()) -> np.ndarray:
    """Which bytes begin a character that is no white space and that no ``added`` token begins with; not those that
    begin both white space and others (C2 and E1 to E3)."""
    good = ~_WHITE
    good[128:0xC3] = good[0xE1:0xE4] = False
    good[[token.encode()[0] for token in added if token]] = False
    return good


def piece_starts(data: np.ndarray, kinds: np.ndarray, behind: np.ndarray) -> np.ndarray:
    """Whether a byte-level pre-tokenizer gives the same when the text is cut in front of each byte. ``data`` begins
    and ends with a line break that belongs to no text; ``kinds`` and ``behind`` are tables of all bytes.

    Letters, digits and marks part from each other. White space parts from what stands before it. The last blank or
    line break before a byte of ``behind`` parts from white space before it, a line break also from what follows.
    Beside characters of which some are white space it makes no cut; the pieces only get longer."""
    kind = kinds_of(data, kinds)
    starts = np.zeros(len(data), bool)
    starts[1:] = (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
    at = np.flatnonzero((data == 32) | (data == 10))[:-1]
    before, second, followed = data[at - 1], data[at - 2], behind[data[at + 1]]
    parts = np.where(before < 128, ~_WHITE[before], (second >= 0xC3) & (second <= 0xDF))
    starts[at[parts | followed]] = True
    starts[at[followed & (data[at] == 10)] + 1] = True
    return starts


def cuts_at_white_space(data: np.ndarray) -> np.ndarray:
    """Places of ASCII white space, which becomes a blank in ``data``."""
    at = np.flatnonzero((data == 32) | ((data >= 9) & (data <= 13)))
    data[at] = 32
    return at


def words_of(texts: Sequence[str], cuts: Callable[[np.ndarray], np.ndarray]) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """All words of ``texts`` in UTF-8, and the number of words before each text.

    Each word has one byte more in front: the blank at which ``cuts`` parted it from the word
    before, or for the first word of a text (which may be empty) what stands for its border."""
    codes = [t.encode() for t in texts]
    joined = b"\n".join([b"", *codes])
    data = np.frombuffer(joined, np.uint8).copy()
    borders = np.concatenate([[0], np.cumsum(np.fromiter(map(len, codes), np.int64, len(codes)) + 1)])
    is_start = np.zeros(len(data), bool)
    is_start[cuts(data)] = is_start[borders[:-1]] = True
    at = np.flatnonzero(is_start)
    offsets = np.append(at, len(data)).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return words, np.searchsorted(at, borders)


class WordMemory:
    """Maps words to rows of numbers (token ids) and whole texts to the rows of their words.

    ``learn`` gets new words, as text and whether a blank stood before them, and returns
    their rows. Words are recognised by their bytes.
    """

    def __init__(
        self, cuts: Callable, learn: Callable[[list[tuple[str, bool]]], Sequence[Sequence[int]]], limit: int = MEMORY
    ):
        self._cuts, self._learn, self._limit = cuts, learn, limit
        self._forget()

    def _forget(self) -> None:
        self._slot: dict[bytes, int] = {}
        self._pool = np.zeros(1 << 16, np.uint32)
        self._ends = np.zeros(1 << 14, np.int64)  # of each slot's row in the pool
        self._used = 0

    def _add(self, words: list[bytes], rows: Sequence[Sequence[int]]) -> None:
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        self._store(words, np.fromiter(chain.from_iterable(rows), np.uint32, int(sizes.sum())), sizes)

    def _store(self, words: list[bytes], flat: np.ndarray, sizes: np.ndarray) -> None:
        """Add words whose rows stand one after another in ``flat``."""
        first = len(self._slot)
        while self._used + len(flat) > len(self._pool):
            self._pool = np.concatenate([self._pool, np.zeros_like(self._pool)])
        while first + len(words) + 1 > len(self._ends):
            self._ends = np.concatenate([self._ends, np.zeros_like(self._ends)])
        self._pool[self._used : self._used + len(flat)] = flat
        self._ends[first + 1 : first + 1 + len(words)] = self._used + np.cumsum(sizes)
        self._used += len(flat)
        self._slot.update(zip(words, range(first, first + len(words))))

    def slots(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """The slot of each word of ``texts``, and the number of words before each text."""
        if len(self._slot) > self._limit:
            self._forget()
        words, before = words_of(texts, self._cuts)
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        found = list(map(self._slot.get, distinct))
        new = [i for i, slot in enumerate(found) if slot is None]
        if new:
            keys = [distinct[i] for i in new]
            next_slot = len(self._slot)
            self._add(keys, self._learn([(k[1:].decode(), k[0] == 32) for k in keys]))
            for n, i in enumerate(new):
                found[i] = next_slot + n
        return np.array(found, np.int64)[coded.indices.to_numpy()], before

    def rows(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """All numbers of ``texts`` one after another, and where each text's begin and end."""
        slots, words = self.slots(texts)
        begins = self._ends[slots]
        sizes = self._ends[slots + 1] - begins
        total = np.concatenate([[0], np.cumsum(sizes)])
        flat = np.repeat(begins - total[:-1], sizes) + np.arange(total[-1])
        return self._pool[flat], total[words]


_coders: dict[str, PieceMemory] = {}


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte (fixed by their format):
    printable bytes stand for themselves, the others for the letters from 256 on, in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + n) for n, b in enumerate(hidden)}


class PieceMemory(WordMemory):
    """A ``WordMemory`` of the pieces that ``piece_starts`` cuts texts into.

    Pieces of one class are one pre-token each, so the model alone can encode them: many at a time, parted by
    a byte that is in no text and that the model never merges, as merges beside it do not depend on one another."""

    #: Pieces that the model gets at a time.
    TOGETHER = 64

    def __init__(self, tokenizer, limit: int = MEMORY):
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        self._tokenizer, self._limit = tokenizer, limit
        added = [token.content for token in tokenizer.get_added_tokens_decoder().values()]
        self._kinds, self._behind = byte_kinds("".join(added)), bytes_behind_blanks(added)
        letters = byte_letters()
        vocab = tokenizer.get_vocab(with_added_tokens=False)
        merged = set("".join(token for token in vocab if len(token) > 1))
        unused = (0xC0, 0xC1, *range(0xF5, 0x100))  # in no text
        borders = [b for b in unused if letters[b] in vocab and letters[b] not in merged]
        model = tokenizer.model
        alike = isinstance(model, BPE) and not (
            model.dropout or model.unk_token or model.ignore_merges
            or model.continuing_subword_prefix or model.end_of_word_suffix or any(map(str.isalpha, added))
        )
        self._border = borders[0] if borders and alike else None
        self._border_id = vocab[letters[self._border]] if self._border else None
        self._alone = Tokenizer(model)
        self._letters = np.array([ord(letters[b]) for b in range(256)], "<u2")
        self._forget()

    def _forget(self) -> None:
        super()._forget()
        self._store([b""], np.zeros(0, np.uint32), np.zeros(1, np.int64))

    def _simple(self, data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Which of the pieces are of one class, but for a blank in front."""
        if self._border is None:
            return np.zeros(len(begins), bool)
        kind = kinds_of(np.append(data, np.uint8(10)), self._kinds)
        blank = begins[(data[begins] == 32) & (ends - begins > 1)]
        kind[blank] = kind[blank + 1]
        low = np.minimum.reduceat(kind[:-1], begins)
        return (low > 0) & (low == np.maximum.reduceat(kind[:-1], begins))

    def _learn_pieces(self, pieces: list[bytes]) -> None:
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(sizes)
        simple = self._simple(np.frombuffer(b"".join(pieces), np.uint8), ends - sizes, ends)
        plain = [p for p, is_simple in zip(pieces, simple) if is_simple]
        if plain:
            border = bytes([self._border])
            groups = [plain[a : a + self.TOGETHER] for a in range(0, len(plain), self.TOGETHER)]
            coded = self._alone.encode_batch_fast(
                [
                    self._letters[np.frombuffer(border.join([*g, b""]), np.uint8)].tobytes().decode("utf-16-le")
                    for g in groups
                ],
                add_special_tokens=False,
            )
            ids = np.concatenate([np.array(e.ids, np.uint32) for e in coded])
            is_border = ids == self._border_id
            self._store(plain, ids[~is_border], np.diff(np.flatnonzero(is_border), prepend=-1) - 1)
        if len(plain) < len(pieces):
            others = [p for p, is_simple in zip(pieces, simple) if not is_simple]
            coded = self._tokenizer.encode_batch_fast([p.decode() for p in others], add_special_tokens=False)
            self._add(others, [e.ids for e in coded])

    def slots(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """The slot of each piece of ``texts`` (a first one without ids for each text), and the number of
        pieces before each text."""
        if len(self._slot) > self._limit:
            self._forget()
        codes = [t.encode() for t in texts]
        data = np.frombuffer(b"\n".join([b"", *codes, b""]), np.uint8)
        borders = np.concatenate([[0], np.cumsum(np.fromiter(map(len, codes), np.int64, len(codes)) + 1)])
        starts = piece_starts(data, self._kinds, self._behind)
        starts[borders] = starts[borders[:-1] + 1] = True
        at = np.flatnonzero(starts)  # the last one is the border behind all texts
        pieces = pa.Array.from_buffers(
            pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)]
        )
        coded = pieces.dictionary_encode()
        _, ends, held = coded.dictionary.buffers()
        ends, held = np.frombuffer(ends, np.int64)[: len(coded.dictionary) + 1].tolist(), held.to_pybytes()
        distinct = [held[a:b] for a, b in zip(ends, ends[1:])]
        found = list(map(self._slot.get, distinct))
        new = [n for n, slot in enumerate(found) if slot is None]
        if new:
            self._learn_pieces([distinct[n] for n in new])
            for n in new:
                found[n] = self._slot[distinct[n]]
        slots = np.array(found, np.int64)[coded.indices.to_numpy()]
        before = np.searchsorted(at, borders)
        slots[before[:-1]] = 0
        return slots, before


def byte_level_coder(name: str) -> PieceMemory:
    """This worker's coder for a byte-level tokenizer file of the ``tokenizers`` library. It
    gives exactly what the library gives for whole texts, special tokens not added."""
    if name not in _coders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_path(name))
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _coders[name] = PieceMemory(tokenizer)
    return _coders[name]


#: Added to the letter of a word's last byte in ``run_model``.
_LAST = 0x1000


def run_model(tokenizer):
    """The byte pair model of ``tokenizer``, which marks ends of words, for words that stand one behind the other, in
    which the last byte of each has a letter of its own, ``_LAST`` further on; and which ids end a word. None where the two
    may differ: a merge behind an end of word, or an end of word that is merged from its letters."""
    from tokenizers.models import BPE

    spec = json.loads(tokenizer.to_str())["model"]
    mark, vocab = spec.get("end_of_word_suffix"), spec["vocab"]
    if spec["type"] != "BPE" or not mark:
        return None
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["merges"]]

    def ends(token: str) -> bool:
        return token.endswith(mark) and token != mark

    def renamed(token: str) -> str:
        return token[: -len(mark) - 1] + chr(ord(token[-len(mark) - 1]) + _LAST) if ends(token) else token

    names = {renamed(token): i for token, i in vocab.items()}
    if (
        any(spec.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "ignore_merges"))
        or any(x not in vocab or x + mark not in vocab for x in byte_letters().values())
        or any(mark in a or ends(a + b) != ends(b) for a, b in merges)
        or len(names) < len(vocab)
    ):
        return None
    ends_word = np.zeros(max(vocab.values()) + 1, bool)
    ends_word[[i for token, i in vocab.items() if ends(token)]] = True
    return BPE(vocab=names, merges=[(renamed(a), renamed(b)) for a, b in merges]), ends_word


class StemMemory(WordMemory):
    """A ``WordMemory`` of stretches of letters, stretches of marks and single digits, for a tokenizer with an
    end-of-word mark (lower case, white space dropped).

    Each of these is one pre-token, so the model alone can encode it: many at a time, by ``run_model``. Stretches
    beside or of other characters go through the whole tokenizer."""

    #: Pieces that the model gets at a time.
    TOGETHER = 64

    def __init__(self, tokenizer, limit: int = MEMORY):
        from tokenizers import Tokenizer

        self._tokenizer, self._limit = tokenizer, limit
        added = [token.content for token in tokenizer.get_added_tokens_decoder().values()]
        self._kinds = byte_kinds("".join(added))
        self._letters = np.array([ord(letter) for _, letter in sorted(byte_letters().items())], "<u2")
        run = None if any(map(str.isalpha, added)) else run_model(tokenizer)
        self._alone, self._ends_word = (Tokenizer(run[0]), run[1]) if run else (None, None)
        self._forget()

    def _learn_pieces(self, pieces: list[bytes], simple: list[bool]) -> None:
        if self._alone is None:
            simple = [False] * len(pieces)
        plain = [p for p, is_simple in zip(pieces, simple) if is_simple]
        if plain:
            data = np.frombuffer(b" ".join([*plain, b""]).decode().lower().encode(), np.uint8)
            blanks = np.flatnonzero(data == 32)
            letters = self._letters[data]
            letters[blanks - 1] += _LAST
            run = letters[data != 32].tobytes().decode("utf-16-le")
            ends = (blanks - np.arange(len(blanks)))[self.TOGETHER - 1 :: self.TOGETHER].tolist()
            coded = self._alone.encode_batch_fast(
                [run[a:b] for a, b in zip([0, *ends], [*ends, len(run)])], add_special_tokens=False
            )
            ids = np.concatenate([np.array(e.ids, np.uint32) for e in coded])
            self._store(plain, ids, np.diff(np.flatnonzero(self._ends_word[ids]), prepend=-1))
        if len(plain) < len(pieces):
            others = [p for p, is_simple in zip(pieces, simple) if not is_simple]
            coded = self._tokenizer.encode_batch_fast([p.decode() for p in others], add_special_tokens=False)
            self._add(others, [e.ids for e in coded])

    def slots(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """The slot of each piece of ``texts``, and the number of pieces before each text."""
        if len(self._slot) > self._limit:
            self._forget()
        codes = [t.encode() for t in texts]
        data = np.frombuffer(b"\n".join([b"", *codes, b""]), np.uint8)
        borders = np.concatenate([[0], np.cumsum(np.fromiter(map(len, codes), np.int64, len(codes)) + 1)])
        kind = kinds_of(data, self._kinds)
        dotted = np.flatnonzero((data[:-1] == 0xC4) & (data[1:] == 0xB0))  # its lower case ends with a mark
        kind[dotted] = kind[dotted + 1] = 0
        white = (data == 32) | ((data >= 9) & (data <= 13))
        starts = np.zeros(len(data), bool)
        starts[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        starts[1:] &= (kind[1:] > 0) & (kind[:-1] > 0)
        starts[1:] |= white[:-1]
        starts &= ~white
        before = np.searchsorted(np.flatnonzero(starts), borders)
        data, kind, starts = data[~white], kind[~white], starts[~white]
        at = np.flatnonzero(starts)
        simple = np.ones(len(at), bool)
        simple[np.searchsorted(at, np.flatnonzero(kind == 0), "right") - 1] = False
        upper = np.flatnonzero((data >= 65) & (data <= 90))
        data[upper[simple[np.searchsorted(at, upper, "right") - 1]]] += 32
        pieces = pa.Array.from_buffers(
            pa.large_binary(), len(at), [None, pa.py_buffer(np.append(at, len(data)).astype(np.int64)), pa.py_buffer(data)]
        )
        coded = pieces.dictionary_encode()
        indices = coded.indices.to_numpy()
        _, ends, held = coded.dictionary.buffers()
        ends, held = np.frombuffer(ends, np.int64)[: len(coded.dictionary) + 1].tolist(), held.to_pybytes()
        distinct = [held[a:b] for a, b in zip(ends, ends[1:])]
        found = list(map(self._slot.get, distinct))
        new = [n for n, slot in enumerate(found) if slot is None]
        if new:
            alike = np.zeros(len(distinct), bool)
            alike[indices] = simple
            self._learn_pieces([distinct[n] for n in new], alike[new].tolist())
            for n in new:
                found[n] = self._slot[distinct[n]]
        return np.array(found, np.int64)[indices], before


_word_end_coders: dict[str, StemMemory] = {}


def word_end_coder(name: str) -> StemMemory:
    """This worker's coder for a tokenizer file of the ``tokenizers`` library with an end-of-word mark (lower
    case, white space dropped). It gives exactly what the library gives for whole texts,
    special tokens not added."""
    if name not in _word_end_coders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_path(name))
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _word_end_coders[name] = StemMemory(tokenizer)
    return _word_end_coders[name]


def in_slices(texts: Sequence[str], limit: int = SLICE):
    """``texts`` in lists of about ``limit`` characters."""
    for start, end in slices(texts, limit):
        yield start, texts[start:end]
