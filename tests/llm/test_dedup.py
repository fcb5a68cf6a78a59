"""Exact, line and near-duplicate removal against brute force."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from limner.llm import ngram_join as N
from limner.llm.components import components, stars
from limner.llm.exact_dedup import exact_duplicates
from limner.llm.line_dedup import line_bitmaps, line_report, without_repeated_lines
from limner.llm.words import shingle_sets, word_endings, word_hashes

SPACES = " \t\n\x0b\x0c\r"


def lower(text: str) -> str:
    return text.translate({i: i + 32 for i in range(65, 91)})


def expected_groups(rows, percent=75):
    """Component of every (doc_id, text), by comparing all pairs of sets."""
    sets = []
    for _, text in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0d]+", lower(text or "")) if x]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and rows[i][0] is not None and rows[j][0] is not None:
                if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                    parent[find(i)] = find(j)
    least: dict[int, int] = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted(((doc, len(s), least[find(i)] if doc is not None else None) for i, ((doc, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def groups(df, **kw):
    return sorted((tuple(r) for r in N.shingle_groups(df, **kw).collect()), key=repr)


def test_groups_match_all_pairs(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert groups(docs) == expected_groups(rows)


def test_groups_of_awkward_rows(awkward, nothing):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    assert groups(awkward) == expected_groups(rows)
    assert groups(nothing) == []


def test_groups_with_small_blocks_and_few_counters(spark, monkeypatch):
    """A chain of edits: long lists, blocks, shares and both rounds of crossing pairs."""
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    rows, text = [], [words[i] for i in rng.integers(0, 400, 60)]
    for doc in range(70):
        at = int(rng.integers(0, 60))
        text = [*text[:at], words[int(rng.integers(0, 400))], *text[at + 1 :]]
        rows.append((doc, " ".join(text)))
    monkeypatch.setattr(N, "BLOCK", 4)
    monkeypatch.setattr(N, "SHARES", 3)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert groups(df, counters=40) == expected_groups(rows)


def test_components_of_a_long_chain(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 150), (7, 7)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(chain, "u long, v long")).collect())
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 200: 100, 150: 100}


def test_new_links_are_taken_in_by_known_components(spark):
    """Few jobs for a chain of near duplicates: stars are checked in one pass, and later links join those that were found."""
    known = stars(spark.createDataFrame([(3, 1), (2, 1), (9, 5)], "u long, v long"))
    assert sorted(tuple(r) for r in stars(known.union(spark.createDataFrame([(9, 3), (8, 7)], "u long, v long"))).collect()) == [(2, 1), (3, 1), (5, 1), (8, 7), (9, 1)]
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(words[:i] + [f"x{k}" for k in range(i)] + words[2 * i :])) for i in range(8)] + [(20 + i, " ".join(words[i : i + 45])) for i in range(16)]
    group = "test_new_links_are_taken_in_by_known_components"
    spark.sparkContext.setJobGroup(group, group)
    try:
        got = groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == expected_groups(rows)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) <= 130  # 174 when every search began anew


def test_word_hashes_follow_words():
    texts = ["The  cat\tsat", "", None, "THE cat", "x" * 9000 + " cat", "the\x1ccat"]
    hashes, before = word_hashes(pa.array(texts))
    words = [w for t in texts for w in (t or "").encode().lower().split()]
    assert len(hashes) == len(words) and before.tolist() == [0, 3, 3, 3, 5, 7, 8]
    by_word = defaultdict(set)
    for w, h in zip(words, hashes.tolist(), strict=True):
        by_word[w].add(h)
    assert all(len(h) == 1 for h in by_word.values()) and len({h for hs in by_word.values() for h in hs}) == len(by_word)
    endings = word_endings(pa.array(["cat bat at the"]))
    assert endings[0] != endings[1] and len(endings) == 4
    assert word_endings(pa.array(["xcat ycat"])).tolist()[0] == word_endings(pa.array(["cat"])).tolist()[0]
    values, bounds = shingle_sets(*word_hashes(pa.array(["a b c d e f", "a b", "", "a b c d e a b c d e"])))
    assert np.diff(bounds).tolist() == [2, 1, 0, 5] and len(values) == 8


def expected_exact(rows):
    out, members = [], defaultdict(list)
    norm = [re.sub(r"[\x20\x09-\x0d]", "", t or "") for _, t in rows]
    for i, n in enumerate(norm):
        members[n].append(i)
    for i, n in enumerate(norm):
        best = min(members[n], key=lambda j: (-len(rows[j][1] or ""), rows[j][0] is None, rows[j][0] or 0))
        kept = rows[i][0] == rows[best][0] and len(rows[i][1] or "") == len(rows[best][1] or "")
        out.append((rows[i][0], rows[best][0], len(members[n]), kept, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_exact_duplicates(docs, awkward, nothing):
    for df in (docs, awkward):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        for support in (1 / 2048, 0.2):  # without and with frequent digests
            assert sorted((tuple(r) for r in exact_duplicates(df, support).collect()), key=repr) == expected_exact(rows)
    assert exact_duplicates(nothing).count() == 0


def expected_lines(rows):
    key = lambda line: lower(line.strip(SPACES))
    first: dict[str, int] = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if doc is not None and len(key(line)) >= 10:
                first[key(line)] = min(doc, first.get(key(line), doc))
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc is None or len(key(x)) < 10 or first[key(x)] == doc]
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_repeated_lines(spark, docs, awkward, nothing):
    for df in (docs, awkward):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        assert sorted((tuple(r) for r in line_report(df).collect()), key=repr) == expected_lines(rows)
    assert line_report(nothing).count() == 0


def test_a_line_of_many_ranges(spark):
    """One line holds most rows, so that its hash spans several ranges."""
    rows = [(doc, "a line that is everywhere\n" * 20 + f"own line number {doc}") for doc in range(300)]
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = sorted((tuple(r) for r in line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == expected_lines(rows)


def test_text_without_repeated_lines_keeps_columns(awkward):
    wide = awkward.withColumns({"keep": F.lit("mine"), "n_lines": F.lit(7), "text_key": F.lit(1.5)})
    out = without_repeated_lines(wide)
    assert out.columns == wide.columns and out.count() == wide.count()
    rows = {(r.doc_id, r.source): r for r in out.where("doc_id IN (4, 5, 6)").collect()}
    assert rows[5, "s"].text == "" and rows[5, "s"].n_chars == 0 and rows[5, "s"].keep == "mine"
    assert rows[6, None].text.startswith("AND ANOTHER") is False and rows[6, None].n_lines == 7
    assert line_bitmaps(awkward).where("doc_id IS NULL").count() == 0


def test_copies_of_a_set_do_not_multiply_its_fragments(spark):
    parts = spark.createDataFrame([(100 * d + i, d, f, bytes(8)) for d in (1, 2) for i in range(30) for f in (0, 3)], "row_no long, d long, fragment int, part binary")
    met = N._met(parts, spark.createDataFrame([(1, 2)], "a long, b long"))
    assert sorted((r.a, r.b, r.fragment) for r in met.collect()) == [(1, 2, 0), (1, 2, 3)]
