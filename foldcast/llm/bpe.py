"""Exact byte pair encoding by dynamic programming over prefixes.

Of all ways to write a prefix of a word as tokens, byte pair encoding gives one, and that of a longer
prefix differs from that of a shorter one only at the end. So it is enough to store the last
token of every prefix: it is the one token that ends the prefix and may stand behind the
last token of what is left, in the sense that merging the two by rank gives back these two.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldcast.llm.common import tokenizer_path, whole
from foldcast.llm.encoding import WordMemory, byte_letters, cuts_at_white_space, in_slices

#: Symbols of the words that are worked out at a time.
BATCH_SYMBOLS = 1 << 18
#: Words that a worker remembers, and characters handled at a time.
MEMORY, SLICE = 300_000, 1_000_000
#: Unicode's white space (a fixed list).
_SPACE = "\t-\r \x85\xa0  -     　"
#: How the vocabulary's texts are split into words (fixed by the tokenizer file).
_WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+"


class IntMap:
    """Whole arrays of 64-bit keys looked up at once, by open addressing; -1 if absent."""

    def __init__(self, keys: Sequence[int], values: Sequence[int]):
        self._bits = max(8, int(len(keys) * 6).bit_length())
        self._keys = np.full(1 << self._bits, -1, np.int64)
        self._values = np.full(1 << self._bits, -1, np.int32)
        keys, values = np.asarray(keys, np.int64), np.asarray(values, np.int32)
        left, self._probes = np.arange(len(keys)), 0
        place = self._place(keys)
        while len(left):
            free = self._keys[place[left]] == -1
            self._keys[place[left[free]]] = keys[left[free]]
            won = self._keys[place[left]] == keys[left]
            self._values[place[left[won]]] = values[left[won]]
            left = left[~won]
            place[left] = (place[left] + 1) & ((1 << self._bits) - 1)
            self._probes += 1

    def _place(self, keys: np.ndarray) -> np.ndarray:
        spread = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (spread >> np.uint64(64 - self._bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        place = self._place(keys)
        out = np.where(self._keys[place] == keys, self._values[place], -1)
        for _ in range(self._probes - 1):
            open_ = np.flatnonzero(out < 0)
            if not len(open_):
                break
            place[open_] = (place[open_] + 1) & ((1 << self._bits) - 1)
            out[open_] = np.where(self._keys[place[open_]] == keys[open_], self._values[place[open_]], -1)
        return out


class PrefixBpe:
    """A vocabulary with byte letters and an end-of-word mark. A word is a row of symbols: its
    bytes, 256 more for the last one."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            self.spec = json.load(file)
        model = self.spec["model"]
        end, vocab = model["end_of_word_suffix"], model["vocab"]
        self.special = {t["content"]: t["id"] for t in self.spec["added_tokens"]}
        bytes_of = {letter: b for b, letter in byte_letters().items()}
        n = max([*vocab.values(), *self.special.values()]) + 1
        self.strings = [""] * n
        for token, i in (vocab | self.special).items():
            self.strings[i] = token
        self._length = np.zeros(n, np.int32)
        self._rank = np.full(n, -1, np.int64)
        self._left, self._right = np.zeros(n, np.int32), np.zeros(n, np.int32)
        base = np.zeros(512, np.int32)
        pairs, made = [], {}
        for rank, (a, b) in enumerate(model["merges"]):
            a_id, b_id, token = vocab[a], vocab[b], vocab[a + b]
            pairs.append((a_id << 20 | b_id, rank))
            if token not in made:
                made[token] = (a_id, b_id, rank)
        for token, (a_id, b_id, rank) in made.items():
            self._left[token], self._right[token], self._rank[token] = a_id, b_id, rank
        # a trie of the tokens read backwards: node and symbol to node, and the token a node ends
        edges: dict[int, int] = {}
        ends = [-1]
        for token, i in vocab.items():
            if token in self.special:
                continue
            marked = token.endswith(end)
            letters = token[: -len(end)] if marked else token
            if any(c not in bytes_of for c in letters) or not letters:
                continue
            symbols = [bytes_of[c] for c in letters]
            symbols[-1] += 256 * marked
            if len(symbols) == 1:
                base[symbols[0]] = i
            elif i not in made:
                continue
            self._length[i] = len(symbols)
            node = 0
            for s in reversed(symbols):
                key = node << 10 | s
                if key not in edges:
                    edges[key] = len(ends)
                    ends.append(-1)
                node = edges[key]
            ends[node] = i
        self._edges = IntMap(list(edges), list(edges.values()))
        self._ends = np.array(ends, np.int32)
        self._merges = IntMap([k for k, _ in pairs], [r for _, r in pairs])
        self._longest = int(self._length.max())
        spelled = [(s + " ").encode() for s in self.strings]
        self._spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self._spelled_ends = np.concatenate([[0], np.cumsum([len(s) for s in spelled])])

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the symbols of a and b by rank gives a and b. The merges that made them are
        undone, the latest first; the tokens that then touch must not merge before that one does
        (of equal ranks the left pair merges first)."""
        a, b = a.copy(), b.copy()
        good = np.ones(len(a), bool)
        limit = np.full(len(a), 1 << 40, np.int64)
        open_ = np.arange(len(a))
        while len(open_):
            x, y = a[open_], b[open_]
            rank = self._merges.get(x.astype(np.int64) << 20 | y)
            clash = (rank >= 0) & (rank < limit[open_])
            good[open_[clash]] = False
            made_x, made_y = self._rank[x], self._rank[y]
            more = ~clash & ((made_x >= 0) | (made_y >= 0))
            open_, x, y, made_x, made_y = open_[more], x[more], y[more], made_x[more], made_y[more]
            left = made_x > made_y
            limit[open_] = np.where(left, made_x, made_y + 1)
            a[open_] = np.where(left, self._right[x], x)
            b[open_] = np.where(left, y, self._left[y])
        return good

    def encode_words(self, words: Sequence[bytes]) -> list[np.ndarray]:
        """Token ids of words, each a stretch of bytes without the end mark."""
        out: list[np.ndarray] = []
        start = held = 0
        for at, word in enumerate(words):
            if held and held + len(word) > BATCH_SYMBOLS:
                out += self._encode(words[start:at])
                start, held = at, 0
            held += len(word)
        return out + self._encode(words[start:])

    def _encode(self, words: Sequence[bytes]) -> list[np.ndarray]:
        if not words:
            return []
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        symbols = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        symbols[ends[sizes > 0] - 1] += 256
        # all tokens that end at each place, by length
        inside = np.arange(len(symbols)) - np.repeat(starts, sizes)
        ending, place, node = [], np.arange(len(symbols)), np.zeros(len(symbols), np.int64)
        for back in range(self._longest):
            keep = inside[place] >= back
            place, node = place[keep], node[keep]
            node = self._edges.get(node << 10 | symbols[place - back]).astype(np.int64)
            place, node = place[node >= 0], node[node >= 0]
            if not len(place):
                break
            token = np.full(len(symbols), -1, np.int32)
            token[place] = self._ends[node]
            ending.append(token)
        # the last token of every prefix, for all words side by side
        last = np.full(len(symbols), -1, np.int32)
        order = np.argsort(-sizes, kind="stable")
        by_size = -sizes[order]
        for i in range(int(sizes.max(initial=0))):
            at = starts[order[: np.searchsorted(by_size, -i, side="left")]] + i
            for back, token in enumerate(ending[: i + 1]):
                here = token[at]
                could = here >= 0
                if back < i and could.any():
                    tried = np.flatnonzero(could)
                    could[tried] = self.compatible(last[at[tried] - back - 1], here[tried])
                last[at[could]] = here[could]
                at = at[~could]
                if not len(at):
                    break
            if len(at):
                raise ValueError("a word has no encoding in this vocabulary")
        # back from the end of each word
        word, place = np.flatnonzero(sizes > 0), ends[sizes > 0] - 1
        steps = []
        while len(word):
            token = last[place]
            steps.append((word, token))
            place = place - self._length[token]
            keep = place >= starts[word]
            word, place = word[keep], place[keep]
        if not steps:
            return [np.zeros(0, np.int32)] * len(words)
        owner = np.concatenate([w for w, _ in reversed(steps)])
        token = np.concatenate([t for _, t in reversed(steps)])
        token = token[np.argsort(owner, kind="stable")]
        return np.split(token, np.cumsum(np.bincount(owner, minlength=len(words)))[:-1])

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The decoded text of each stretch of ids: its tokens, special ones too, with single
        blanks between, as the tokenizer file names no other way."""
        begins = self._spelled_ends[ids]
        sizes = self._spelled_ends[ids.astype(np.int64) + 1] - begins
        total = np.concatenate([[0], np.cumsum(sizes)])
        flat = np.repeat(begins - total[:-1], sizes) + np.arange(total[-1])
        data = memoryview(self._spelled[flat].tobytes())
        return [bytes(data[a : max(a, b - 1)]) for a, b in zip(total[ends[:-1]].tolist(), total[ends[1:]].tolist())]


_coders: dict[str, tuple[PrefixBpe, WordMemory]] = {}


def word_coder(name: str) -> tuple[PrefixBpe, WordMemory]:
    """This worker's coder for a tokenizer file with an end-of-word mark: lower case, composed
    form, white space dropped."""
    if name not in _coders:
        import regex

        bpe = PrefixBpe(tokenizer_path(name))
        words = regex.compile(_WORDS)
        special = regex.compile("(" + "|".join(map(regex.escape, sorted(bpe.special))) + ")")
        stems: dict[str, np.ndarray] = {}
        stems_of_special = {t: np.array([i], np.int32) for t, i in bpe.special.items()}

        def plain(text: str) -> list[str]:
            # lower case is taken letter by letter, so a capital sigma never becomes a final one
            return words.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

        def parts(text: str) -> list[str]:
            if "<|" not in text:
                return plain(text)
            found = []
            for piece in special.split(text):
                found += [piece] if piece in bpe.special else plain(piece)
            return found

        def learn(new: list[tuple[str, bool]]) -> list[np.ndarray]:
            if len(stems) > MEMORY // 2:
                stems.clear()
            stems.update(stems_of_special)
            found = [parts(word) for word, _ in new]
            unknown = list({p for f in found for p in f}.difference(stems))
            stems.update(zip(unknown, bpe.encode_words([w.encode() for w in unknown])))
            none = np.zeros(0, np.int32)
            return [stems[f[0]] if len(f) == 1 else np.concatenate([none, *[stems[p] for p in f]]) for f in found]

        _coders[name] = bpe, WordMemory(cuts_at_white_space, learn, MEMORY)
    return _coders[name]


def encode_texts(docs: DataFrame, key: str = "doc_id", text: str = "text",
                 tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    """(key, ids, decoded) of every whole text. Null texts count as empty ones and have no ids; rows that
    repeat come out as often; an empty table gives no rows."""

    def coded(batches):
        bpe, memory = word_coder(tokenizer)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for start, some in in_slices(texts, SLICE):
                ids, ends = memory.rows(some)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int32)))
                decoded = pa.array(bpe.decode(ids, ends), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(some)), lists, decoded], ["key", "ids", "decoded"]
                )

    kind = docs.select(F.col(key).alias("key"), whole(F.col(text)).alias("text"))
    return kind.mapInArrow(coded, f"key {kind.schema['key'].dataType.simpleString()}, ids array<int>, decoded string")


def encoding_digests(docs: DataFrame, key: str = "doc_id", text: str = "text",
                     tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): as ``encode_texts``, with digests of the ids (as
    little-endian unsigned 32-bit integers) and of the decoded text in UTF-8, taken in the same task."""
    import hashlib

    def coded(batches):
        bpe, memory = word_coder(tokenizer)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for start, some in in_slices(texts, SLICE):
                ids, ends = memory.rows(some)
                data = memoryview(ids.astype("<u4").tobytes())
                spans = list(zip((4 * ends[:-1]).tolist(), (4 * ends[1:]).tolist()))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, len(some)), pa.array(np.diff(ends).astype(np.int64)),
                        pa.array([hashlib.sha256(data[a:b]).hexdigest() for a, b in spans]),
                        pa.array([hashlib.sha256(d).hexdigest() for d in bpe.decode(ids, ends)]),
                    ],
                    ["key", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    kind = docs.select(F.col(key).alias("key"), whole(F.col(text)).alias("text"))
    return kind.mapInArrow(
        coded,
        f"key {kind.schema['key'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string",
    )
