"""The pipeline, stage by stage, against brute force on the smallest tables."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from foldcast.llm import toxicity
from tests.llm.test_jaccard_join import WORD, brute

SF_DIR = "/root/testdata/sf0.001"


def targets(sizes):
    """150 % of all words shared by weights 5, 2, 1, ..., none above twice its source's size."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    out, left = {}, 1.5 * sum(sizes.values())
    while True:
        open_ = [s for s in order if s not in out]
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not above:
            return out | share
        for s in above:
            out[s] = 2.0 * sizes[s]
            left -= out[s]


def test_pipeline_matches_brute_force(spark, monkeypatch):
    stored, write = [], corpus_pipeline.materialise

    def kept(df, name):
        stored.append((name, write(df, name)))
        return stored[-1][1]

    monkeypatch.setattr(corpus_pipeline, "materialise", kept)
    result = corpus_pipeline.run(spark, SF_DIR).collect()
    assert [n for n, _ in stored] == [n for n, _ in corpus_pipeline.STAGES[:-1]]
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    assert all(t.columns == docs.columns for _, t in stored)
    rows, clean, single, apart, mixed = (t.collect() for t in [docs, *(t for _, t in stored)])

    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{SF_DIR}/labels.parquet"))
    assert Counter(clean) == Counter(r for r in rows if toxicity.judged(r.text, model)[0] < toxicity.THRESHOLD)

    last = {}
    for r in clean:
        last[r.text or ""] = max(last.get(r.text or "", r.doc_id), r.doc_id)
    assert Counter(single) == Counter(r for r in clean if last[r.text or ""] == r.doc_id)

    firsts = {k for k, _, component in brute([(r.doc_id, r.text) for r in single], 80, 5) if k == component}
    assert Counter(apart) == Counter(r for r in single if r.doc_id in firsts)

    def words(table):
        out = Counter()
        for r in table:
            out[r.source] += len(WORD.findall(r.text or ""))
        return out

    sizes, taken = words(apart), words(mixed)
    wanted = targets(sizes)
    assert all(abs(taken[s] - wanted[s]) <= 1 for s in sizes) and set(taken) <= set(sizes)
    size = {r.doc_id: len(WORD.findall(r.text or "")) for r in apart}
    times = Counter()
    for r in mixed:
        times[r.doc_id] += len(WORD.findall(r.text or ""))
    assert all(n <= 2 * size[d] for d, n in times.items())

    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    expected = Counter()
    for r in mixed:
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        expected[
            r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
            hashlib.sha256(decoded.encode()).hexdigest(),
        ] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in result) == expected
