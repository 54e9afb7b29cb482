import hashlib
import random

import numpy as np

from foldcast.llm.bpe import encode_texts, encoding_digests, word_coder
from foldcast.llm.common import tokenizer_path
from tests.llm.conftest import awkward_rows

NAME = "word_bpe_49k.json"


def library():
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(tokenizer_path(NAME))
    out.no_truncation()
    out.no_padding()
    return out


def test_ids_and_decoded_texts_equal_the_library(small_docs):
    rng = random.Random(4)
    syllables = ["in", "ing", "the", "er", "re", "an", "on", "st", "ies", "ment", "tion", "é", "'s", "3"]
    texts = [r["text"] for r in small_docs.collect()] + [r[1] or "" for r in awkward_rows()] + [
        "a<|endoftext|> b <|startoftext|>c <|x", "x  y 　z", "it's  we'll 12 3 Ⅷ²", "a\r\n b", "ΑΣ ß ẞ İ",
        "\x1c x\x1c y \x85 z", "a" * 3000, "abab" * 50, "----....!!!!", "中文é́",
    ]
    texts += ["".join(rng.choice("abcdeinrsthou ") for _ in range(300)) for _ in range(100)]
    texts += ["".join(rng.choice(syllables) + " " * (rng.random() < 0.2) for _ in range(100)) for _ in range(100)]
    bpe, memory = word_coder(NAME)
    ids, ends = memory.rows(texts)
    decoded = bpe.decode(ids, ends)
    for i, text in enumerate(texts):
        want = library().encode(text, add_special_tokens=False).ids
        assert ids[ends[i] : ends[i + 1]].tolist() == want
        assert decoded[i].decode() == library().decode(want, skip_special_tokens=False)


def test_pairs_are_compatible_if_merging_keeps_them():
    bpe, _ = word_coder(NAME)
    rng = np.random.default_rng(3)
    plain = [i for i, s in enumerate(bpe.strings) if s.isascii() and s.isalpha()]
    a, b = rng.choice(plain, 400).astype(np.int32), rng.choice(plain, 400).astype(np.int32)
    a[:5], b[:5] = plain[:5], plain[:5]
    ranks = {tuple(m): r for r, m in enumerate(bpe.spec["model"]["merges"])}
    for x, y, good in zip(a, b, bpe.compatible(a, b)):
        word = list(bpe.strings[x] + bpe.strings[y])
        while True:
            found = [(ranks.get((word[i], word[i + 1]), 1 << 40), i) for i in range(len(word) - 1)]
            rank, i = min(found)
            if rank == 1 << 40:
                break
            word[i : i + 2] = [word[i] + word[i + 1]]
        assert good == (word == [bpe.strings[x], bpe.strings[y]])


def test_digests_of_awkward_rows(awkward, clashing, empty_docs):
    want = []
    for r in awkward_rows():
        ids = library().encode(r[1] or "", add_special_tokens=False).ids
        text = library().decode(ids, skip_special_tokens=False)
        want.append((r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    for docs in (awkward, clashing):
        assert sorted(map(str, map(tuple, encoding_digests(docs).collect()))) == sorted(map(str, want))
    rows = encode_texts(awkward).collect()
    assert sorted((len(r["ids"]) for r in rows)) == sorted(w[1] for w in want)
    assert encoding_digests(empty_docs).count() == 0 and encode_texts(empty_docs).count() == 0


def thue_morse(n):
    """A word over a and b and its complement; every polynomial hash modulo 2^64 is the same for both."""
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_words_with_equal_polynomial_hashes_keep_their_own_ids():
    from tokenizers import Tokenizer

    from foldcast.llm.encoding import byte_level_coder, word_end_coder
    from foldcast.llm.jaccard_join import shingle_sets

    first, second = thue_morse(2048)
    texts = [first, second, f"x {first} y", f"x {second} y", "", " ", "\n", "a ", " a", "a&&& b<|endoftext|>c d'll"]
    for name, coder in (
        (NAME, word_end_coder(NAME)), (NAME, word_coder(NAME)[1]),
        ("byte_bpe_50k.json", byte_level_coder("byte_bpe_50k.json")),
    ):
        plain = Tokenizer.from_file(tokenizer_path(name))
        plain.no_truncation()
        plain.no_padding()
        ids, ends = coder.rows(texts)
        for i, text in enumerate(texts):
            assert ids[ends[i] : ends[i + 1]].tolist() == plain.encode(text, add_special_tokens=False).ids
    values, ends = shingle_sets([first, second, "", f"A {first}", f"a {first}"], 3)
    sets = [set(values[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:])]
    assert len(sets[0]) == len(sets[1]) == 1 and sets[0] != sets[1]
    assert sets[2] == set() and sets[3] == sets[4]
