import hashlib
import re
from collections import Counter, defaultdict

from foldcast.llm.exact_dedup import drop_copies, exact_dedup, merge_runs
from foldcast.llm.line_dedup import line_dedup, repeated_runs
from tests.llm.conftest import awkward_rows


def test_exact_dedup_matches_brute_force(awkward):
    groups = defaultdict(list)
    for row in awkward_rows():
        groups[row[1] or ""].append(row[0])
    want = Counter()
    for text, keys in groups.items():
        best = max(keys, key=lambda k: (k is not None, k or 0))
        for n, k in enumerate(sorted(keys, key=lambda k: (k is not None, k or 0), reverse=True)):
            want[(k, hashlib.sha256(text.encode()).digest(), best, len(keys), n == 0)] += 1
    got = Counter(
        (r["key"], bytes(r["digest"]), r["keep_key"], r["copies"], r["kept"]) for r in exact_dedup(awkward).collect()
    )
    assert got == want


def test_exact_dedup_smallest_and_many_nodes(spark):
    docs = spark.range(0, 3000, 1, 40).selectExpr("id AS doc_id", "CAST(IF(id % 3 = 0, 0, id % 700) AS STRING) AS text")
    rows = exact_dedup(docs, keep="smallest").where("kept").collect()
    texts = {"0" if i % 3 == 0 else str(i % 700): None for i in range(3000)}
    assert len(rows) == len(texts) and all(r["key"] == r["keep_key"] for r in rows)
    assert sum(r["copies"] for r in rows) == 3000


def test_drop_copies_keeps_columns(clashing, empty_docs):
    left = drop_copies(clashing)
    assert left.columns == clashing.columns
    assert left.count() == len({r[1] or "" for r in awkward_rows()})
    assert drop_copies(empty_docs).count() == 0 and exact_dedup(empty_docs).count() == 0


def brute_lines(rows, min_run, long_line):
    rows = sorted({(r[0], r[1]) for r in rows if r[1]}, key=lambda r: (r[0] is not None, r[0] or 0))
    seen, out = set(), {}
    for key, text in rows:
        lines = text.split("\n")
        at = [i for i, x in enumerate(lines) if x.strip(" \t\r\n\x0b\x0c")]
        width, gone = min(min_run, len(at)), set()
        spans = [at[s : s + width] for s in range(len(at) - width + 1 if at else 0)]
        if width > 1:
            spans += [[i] for i in at if len(re.findall(r"[^\x20\x09-\x0D]+", lines[i])) >= long_line]
        for span in spans:
            content = tuple(lines[i] for i in span)
            if content in seen:
                gone.update(span)
            seen.add(content)
        out[key, text] = (len(at), len(gone), "\n".join(x for i, x in enumerate(lines) if i not in gone))
    return out


def test_line_dedup_matches_brute_force(clashing, small_docs, empty_docs):
    cases = ((clashing, 2, 10), (clashing, 1, 10), (clashing, 3, 2), (small_docs, 2, 10), (small_docs, 3, 4))
    for docs, min_run, long_line in cases:
        rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        want = brute_lines(rows, min_run, long_line)
        out = line_dedup(docs, min_run=min_run, long_line=long_line)
        names = out.columns[-3:]
        for r in out.collect():
            got = tuple(r[n] for n in names)
            assert got == (want[r["doc_id"], r["text"]] if r["text"] else (0, 0, r["text"]))
        assert out.columns[: len(docs.columns)] == docs.columns
    assert line_dedup(empty_docs).count() == 0


def test_long_single_lines_count_between_other_neighbours(spark):
    long, short = " ".join(f"w{i}" for i in range(60)), "too short to count"
    docs = spark.createDataFrame(
        [(1, f"a\n{long}\nb\n{short}"), (2, f"{short}\nc\n{long}\nd"), (3, long), (4, f"{long}\ne\n{long}")],
        "doc_id long, text string",
    )
    got = {r["doc_id"]: (r["n_removed"], r["clean_text"]) for r in line_dedup(docs).collect()}
    assert got == {1: (0, f"a\n{long}\nb\n{short}"), 2: (1, f"{short}\nc\nd"), 3: (1, ""), 4: (2, "e")}


def test_runs_extend_along_a_diagonal(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc\nd\ne"), (2, "x\nb\nc\n\nd\ny")], "doc_id long, text string")
    [run] = repeated_runs(docs).collect()
    assert (run["key"], run["first"], run["n_lines"], run["from_key"], run["from_first"]) == (2, 1, 3, 1, 1)


def test_verification_tells_equal_digests_apart(spark):
    rows = spark.createDataFrame(
        [(1, 1, 0, b"d", 3, 7), (2, 2, 1, b"d", 4, 7), (3, 3, 1, b"d", 3, 7)],
        "key long, row long, node int, digest binary, n_bytes long, check long",
    )
    assert sorted((r["keep_key"], r["copies"]) for r in merge_runs(rows).collect()) == [(2, 1), (3, 2)]


def test_removed_lines_are_those_of_the_extended_runs(small_docs):
    runs = repeated_runs(small_docs).collect()
    want = defaultdict(set)
    for r in runs:
        want[r["key"]].update(range(r["first"], r["first"] + r["n_lines"]))
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup(small_docs).where("n_removed > 0").collect()}
    assert got and got == {k: len(v) for k, v in want.items()}
