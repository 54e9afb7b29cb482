"""Language of texts, and spans of languages in mixed texts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldcast.llm.common import held_out, share_below, whole
from foldcast.llm.encoding import in_slices, mixed

#: About this many texts per language are learnt from at most, chosen by hash, and this many
#: characters of all texts of a batch of them are counted at a time.
SAMPLE = 4_000
#: Hashed counts of letter pairs and triples per language.
BUCKETS = 1 << 17
#: Log-odds that a change of language within a text costs.
SWITCH = 12.0
#: Answer for texts without letters.
UNDETERMINED = "und"

#: Scripts by their first and last code points (fixed ranges of Unicode). Letters elsewhere
#: belong to a script of their own, number 0.
SCRIPTS = [
    ("latin", 0x41, 0x24F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("armenian", 0x530, 0x58F),
    ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x77F), ("devanagari", 0x900, 0x97F), ("bengali", 0x980, 0x9FF),
    ("tamil", 0xB80, 0xBFF), ("thai", 0xE00, 0xE7F), ("georgian", 0x10A0, 0x10FF), ("hangul jamo", 0x1100, 0x11FF),
    ("latin", 0x1E00, 0x1EFF), ("greek", 0x1F00, 0x1FFF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF),
    ("hangul", 0xAC00, 0xD7AF), ("han", 0x20000, 0x3FFFF),
]
_NAMES = sorted({name for name, *_ in SCRIPTS})
_LOW = np.array([low for _, low, _ in SCRIPTS])
_HIGH = np.array([high for *_, high in SCRIPTS])
_NUMBER = np.array([_NAMES.index(name) + 1 for name, *_ in SCRIPTS])
#: Number of script classes, the unlisted one included.
N_SCRIPTS = len(_NAMES) + 1


@dataclass(frozen=True)
class LanguageModel:
    """``weights``: log probability of each hashed letter group per language (bucket, language);
    ``uses``: which scripts a language is written in (script, language)."""

    languages: list[str]
    weights: np.ndarray
    uses: np.ndarray


def script_of(points: np.ndarray) -> np.ndarray:
    """Script class of each code point."""
    at = np.searchsorted(_LOW, points, side="right") - 1
    inside = (at >= 0) & (points <= _HIGH[np.maximum(at, 0)])
    return np.where(inside, _NUMBER[np.maximum(at, 0)], 0)


@dataclass
class Words:
    """Words (stretches of letters) of several texts: text number, place of the first and behind the
    last letter in the joined code points, and script of the first letter."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    script: np.ndarray
    groups: np.ndarray  # hashed letter groups, two per letter


_letters: list[np.ndarray] = []


def _is_letter(points: np.ndarray) -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(p).isalpha() for p in range(0x10000)), bool, 0x10000))
    out = _letters[0][np.minimum(points, 0xFFFF)]
    far = np.flatnonzero(points > 0xFFFF)
    out[far] = [chr(p).isalpha() for p in points[far].tolist()]
    return out


def words_of(texts: Sequence[str]) -> Words:
    """All words of ``texts`` in lower case. A letter's groups are itself with the letter before,
    and with the two before; places before a word count as one blank."""
    codes = ["\0" + t.lower() for t in texts]
    points = np.frombuffer("".join([*codes, "\0"]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    owner = np.repeat(np.arange(len(codes)), np.fromiter(map(len, codes), np.int64, len(codes)))
    letter = _is_letter(points)
    edge = np.flatnonzero(np.diff(letter.astype(np.int8)))
    start, end = edge[::2] + 1, edge[1::2] + 1
    here = np.flatnonzero(letter)
    blank = np.where(letter, points, 0)
    first = blank[here - 1]
    second = np.where(first > 0, blank[here - 2], 0)
    pair = (first << 21 | blank[here]).astype(np.uint64)
    triple = pair | (second.astype(np.uint64) << np.uint64(42)) | np.uint64(1 << 63)
    groups = np.stack([mixed(pair), mixed(triple)], axis=1) & np.uint64(BUCKETS - 1)
    return Words(owner[start], start, end, script_of(points[start]), groups.astype(np.int64))


def fit_languages(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
                  sample: int = SAMPLE) -> LanguageModel:
    """Count hashed letter groups and scripts per language in a sample of the labelled documents that
    are not held out: about ``sample`` per language at most, chosen by a hash of the key. Each
    text counts its groups as shares, so that long texts weigh no more than short ones.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key)))
    counts = {r[0]: r[1] for r in known.groupBy(F.col(lang)).count().collect()}
    languages = sorted(counts)
    share = F.lit(0.0)
    for name in languages:
        share = F.when(F.col(lang) == name, sample / max(sample, counts[name])).otherwise(share)
    number = {name: i for i, name in enumerate(languages)}

    def counted(batches):
        total = np.zeros((len(languages), BUCKETS))
        scripts = np.zeros((len(languages), N_SCRIPTS))
        for batch in batches:
            names = np.array([number[x] for x in batch.column(1).to_pylist()], np.int64)
            texts = batch.column(0).to_pylist()
            for at, some in in_slices(texts):
                words = words_of(some)
                if not len(words.start):
                    continue
                mine = names[at : at + len(some)]
                size = words.end - words.start
                per_text = np.bincount(words.text, size, len(some))
                of_letter = np.repeat(words.text, size)
                weight = 500.0 / np.maximum(per_text, 1)[of_letter]
                for k in (0, 1):
                    np.add.at(total, (mine[of_letter], words.groups[:, k]), weight)
                np.add.at(scripts, (mine[words.text], words.script), 1.0 / np.maximum(per_text, 1)[words.text])
        for i in range(len(languages)):
            used = np.flatnonzero(total[i])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(used) + N_SCRIPTS, i, np.int32)),
                 pa.array(np.concatenate([used, BUCKETS + np.arange(N_SCRIPTS)]).astype(np.int32)),
                 pa.array(np.concatenate([total[i][used], scripts[i]]))],
                ["language", "bucket", "weight"],
            )

    rows = (
        known.where(share_below(F.col(key), 13, share))
        .select(F.col(text).alias("text"), F.col(lang).alias("lang"))
        .mapInArrow(counted, "language int, bucket int, weight double")
        .groupBy("language", "bucket").agg(F.sum("weight").alias("weight"))
        .toPandas()
    )
    table = np.zeros((len(languages), BUCKETS + N_SCRIPTS))
    table[rows["language"], rows["bucket"]] = rows["weight"]
    groups, scripts = table[:, :BUCKETS], table[:, BUCKETS:]
    # pairs and triples fall into the same buckets; a group's share is smoothed towards all languages'
    everywhere = groups.sum(axis=0) + 0.5
    everywhere /= everywhere.sum()
    smooth = 200.0
    shares = (groups + smooth * everywhere) / (groups.sum(axis=1, keepdims=True) + smooth)
    uses = scripts > 0.01 * scripts.sum(axis=1, keepdims=True)
    return LanguageModel(languages, np.log(shares).T.astype(np.float32).copy(), uses.T.copy())


def best_paths(scores: np.ndarray, first: np.ndarray, switch: float) -> np.ndarray:
    """Viterbi: the language of each word (rows of ``scores``, texts one after another from the rows
    ``first`` on) that adds up to the highest score of its text, with ``switch`` taken off for
    each change. Ties keep the language, then the first one.

    Totals of all texts go on by one word at a time, so that an array call serves every text that is
    long enough; behind which words a path changes is read off all totals at once."""
    n = len(scores)
    sizes = np.diff(first, append=n)
    rank = np.argsort(np.argsort(-sizes, kind="stable"))
    number = np.arange(n) - np.repeat(first, sizes)
    begin = np.concatenate([[0], np.cumsum(np.bincount(number))])  # rows of each word number, longest texts first
    place = begin[number] + np.repeat(rank, sizes)
    totals = np.empty(scores.shape)
    totals[place] = scores
    begin = begin.tolist()
    for a, b, c in zip(begin, begin[1:], begin[2:]):
        before = totals[a : a + c - b]
        totals[b:c] += np.maximum(before, before.max(axis=1, keepdims=True) - switch)
    totals = totals[place]
    rows = np.arange(n, dtype=np.int32 if n < 1 << 31 else np.int64)
    top = totals.argmax(axis=1)
    change = totals[rows, top][:, None] - switch > totals
    # the last word so far behind which a path to each language comes from the top one
    left = np.maximum.accumulate(np.where(change, rows[:, None], -1), axis=0)
    path = np.empty(n, np.int32)
    for start, end in zip(first.tolist(), (first + sizes).tolist()):
        while end > start:
            lang = top[end - 1]
            begun = max(left[end - 2, lang] + 1, start) if end - 1 > start else start
            path[begun:end] = lang
            end = begun
    return path


def best_path(scores: np.ndarray, switch: float) -> np.ndarray:
    """``best_paths`` of one text."""
    return best_paths(scores, np.zeros(1, np.int64), switch)


def label_words(texts: Sequence[str], model: LanguageModel, switch: float = SWITCH) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words of ``texts``, the language number of each, and per word and language its score.

    A word's score in a language adds the log shares of its letter groups. Its script narrows
    the languages: one that is not written in it loses 50, unless none is. Most texts
    are in one language throughout, and for them the scan is not needed. A path that visits the best
    single language pays a switch for each stretch in others; one that never does pays one switch
    less than it has stretches, the first of them at the start of the text and the last at its
    end. So if no stretch gains more than a switch in any other language, and no start and
    end do so together, the best single language is the best path.
    """
    words = words_of(texts)
    k = len(model.languages)
    if not len(words.start) or not k:
        return words, np.zeros(len(words.start), np.int32), np.zeros((len(words.start), k))
    size = words.end - words.start
    begin = np.concatenate([[0], np.cumsum(size)[:-1]])
    scores = np.add.reduceat(model.weights[words.groups[:, 0]] + model.weights[words.groups[:, 1]], begin, axis=0)
    allowed = model.uses[words.script]
    scores = scores.astype(np.float64) - 50.0 * (~allowed & allowed.any(axis=1, keepdims=True))
    first = np.flatnonzero(np.diff(words.text, prepend=-1))
    ends = np.append(first[1:], len(words.text))
    total = np.add.reduceat(scores, first, axis=0)
    main = total.argmax(axis=1)
    of_text = np.repeat(np.arange(len(first)), ends - first)
    path = main[of_text].astype(np.int32)
    gain = scores - scores[np.arange(len(path)), path][:, None]
    # largest gain of a stretch: running sum less its minimum so far, texts set apart by a drop
    drop = 2 * np.abs(gain).sum(axis=0).max() + 1
    at_start, at_end = np.zeros(len(first)), np.zeros(len(first))
    for j in range(k):
        run = np.cumsum(gain[:, j])
        run -= np.repeat(np.concatenate([[0], run[ends[:-1] - 1]]), ends - first)
        earlier = np.concatenate([[0], run[:-1]])
        earlier[first] = 0
        at_start = np.maximum(at_start, np.maximum.reduceat(run, first))
        at_end = np.maximum(at_end, run[ends - 1] - np.minimum.reduceat(earlier, first))
        apart = run - drop * of_text
        before = np.concatenate([[0], apart[:-1]])
        before[first] = -drop * np.arange(len(first))
        low = np.minimum.accumulate(before)
        mixed_texts = np.unique(of_text[apart - low > switch])
        for i in mixed_texts.tolist():
            path[first[i] : ends[i]] = -1
    path[(at_start + at_end > switch)[of_text]] = -1
    scanned = path < 0
    if scanned.any():
        path[scanned] = best_paths(scores[scanned], np.flatnonzero(np.diff(of_text[scanned], prepend=-1)), switch)
    return words, path, scores


def identify_languages(docs: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text",
                       switch: float = SWITCH) -> DataFrame:
    """One row per document: (key, held_out, lang_pred, score, spans).

    ``spans`` are (lang, first_word, last_word): stretches of one language, words counted from 0.
    ``lang_pred`` is the language with the most letters in them, the first by name on ties, and
    ``score`` its share of the letters. Null, empty and letterless texts are ``und`` with
    score 0 and no spans, as is every text if nothing was learnt. A null key is never held out.
    """
    kind = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int32()), ("last_word", pa.int32())]))
    names, k = model.languages, len(model.languages)

    def labelled(batches):
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for at, some in in_slices(texts, 1_000_000):
                words, path, _ = label_words(some, model, switch)
                n = len(some)
                pred, score, spans = [UNDETERMINED] * n, np.zeros(n), [[] for _ in range(n)]
                if len(path) and k:
                    letters = np.bincount(words.text * k + path, words.end - words.start, n * k).reshape(n, k)
                    best, whole_ = letters.argmax(axis=1), letters.sum(axis=1)
                    for i in np.flatnonzero(whole_).tolist():
                        pred[i], score[i] = names[best[i]], letters[i, best[i]] / whole_[i]
                    turn = np.flatnonzero((np.diff(words.text, prepend=-1) != 0) | (np.diff(path, prepend=-1) != 0))
                    stop = np.append(turn[1:], len(path)) - 1
                    start = np.searchsorted(words.text, words.text[turn])
                    for i, lang, a, b in zip(
                        words.text[turn].tolist(), path[turn].tolist(), (turn - start).tolist(), (stop - start).tolist()
                    ):
                        spans[i].append({"lang": names[lang], "first_word": a, "last_word": b})
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, n), batch.column(1).slice(at, n), pa.array(pred), pa.array(score), pa.array(spans, kind)],
                    ["key", "held_out", "lang_pred", "score", "spans"],
                )

    rows = docs.select(F.col(key).alias("key"), held_out(F.col(key)).alias("held_out"), whole(F.col(text)).alias("text"))
    return rows.mapInArrow(
        labelled,
        f"key {rows.schema['key'].dataType.simpleString()}, held_out boolean, lang_pred string, score double, "
        "spans array<struct<lang: string, first_word: int, last_word: int>>",
    )
