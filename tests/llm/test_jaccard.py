"""Near-duplicates by Jaccard similarity against brute force."""

import random

import numpy as np
import pytest

import corpus_pipeline
from fathomline.llm import jaccard, simhash


def brute(rows, width, threshold):
    """The smallest id of each row's component, over all pairs."""
    def cut(text):
        words = (text or "").lower().split()
        return {" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()

    sets, up = [cut(t) for _, t in rows], list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if x == sets[j] or len(x & sets[j]) >= threshold * len(x | sets[j]):
                up[max(top(i), top(j))] = min(top(i), top(j))
    return {rows[i][0]: rows[top(i)][0] for i in range(len(rows))}


def family_rows():
    """Rows with ascending ids: families of copies with up to 12 words changed, a line that all families share, odd texts."""
    r = random.Random(5)
    word = lambda: f"w{r.randrange(3000)}"
    line = [word() for _ in range(30)]
    texts = [None, "", "  ", "one", "One", "one two"]
    for size in (90, 5, 2, 2, 1, 1):
        base = [word() for _ in range(r.randrange(60, 200))] + line
        for _ in range(size):
            copy = list(base)
            for _ in range(r.randrange(0, 13)):
                copy[r.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    r.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("full", [4, 64, 1000])
def test_components_are_those_of_all_pairs(spark, full, monkeypatch):
    monkeypatch.setattr(jaccard, "FULL", full)
    monkeypatch.setattr(jaccard, "A_TASK", 8)
    rows = family_rows()
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == brute(rows, 5, 0.8)


def test_pipeline_stage_drops_near_copies(spark):
    """One word in 200 changed three times: similarity 0.86, but more than 3 bits of a fingerprint."""
    rows = []
    for k in range(20):
        r = random.Random(k)
        words = [f"v{r.randrange(5000)}" for _ in range(200)]
        copy = list(words)
        for i in (40, 100, 160):
            copy[i] = "changed"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(copy))]
    out = corpus_pipeline.near_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in out.collect()) == list(range(0, 40, 2))


def test_set_fingerprints_by_definition():
    def extended(h, k):
        x = (h + k * 0x9E3779B97F4A7C15) % 2**64
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
        x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
        return (x ^ x >> 31).to_bytes(8, "little")

    r = random.Random(3)
    for n in (0, 1, 2, 255, 256, 5000):
        hashes = [r.getrandbits(64) for _ in range(n)]
        rows = [b"".join(extended(h, k) for k in range(1, simhash.WORDS + 1)) for h in hashes]
        want = [sum(row[i] >> 7 - b & 1 for row in rows) * 2 > n for i in range(8 * simhash.WORDS) for b in range(8)]
        got = simhash.set_fingerprint(np.array(hashes, np.uint64).view(np.int64))
        assert np.unpackbits(got).astype(bool).tolist() == want
        values = simhash.cells(np.array(hashes, np.uint64).view(np.int64))
        assert values.tolist() == [int.from_bytes(got[i : i + 3].tobytes(), "little") for i in range(0, 126, 3)]


@pytest.mark.parametrize("full", [4, 1000])
def test_cells_and_prefixes_give_the_components_of_all_pairs(spark, full, monkeypatch):
    monkeypatch.setattr(jaccard, "FULL", full)
    rows = family_rows()
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), cells=simhash.cells).collect()
    assert {r.doc_id: r.component_id for r in got} == brute(rows, 5, 0.8)


def test_pipeline_stage_links_by_fingerprints(spark, monkeypatch):
    """Without prefixes, the segments of fingerprints find near copies: 20 of similarity 0.95."""
    monkeypatch.setattr(jaccard, "_prefix", lambda n, threshold: 0)
    rows = []
    for k in range(20):
        r = random.Random(k)
        words = [f"v{r.randrange(5000)}" for _ in range(200)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words[:100], "changed", *words[101:]]))]
    out = corpus_pipeline.near_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in out.collect()) == list(range(0, 40, 2))


def test_a_large_group_is_dealt_to_several_tasks(spark):
    """All pairs of leaders and members come once, from more than one partition."""
    from pyspark.sql import functions as F

    members = spark.range(500).select(F.lit(7).cast("long").alias("h"), F.col("id").alias("key"), F.lit(9).alias("n"), F.lit(0).alias("i"))
    leaders = members.where("key < 2")
    both = jaccard._for_all(leaders.select("h")).join(jaccard._salted(members), ["h", "salt"])
    assert both.count() == 1000 and both.select("salt").distinct().count() == jaccard.SALTS
    got = jaccard._pairs(leaders, members, 0.8, True).collect()
    assert {tuple(r) for r in got} == {(a, b) for a in (0, 1) for b in range(a + 1, 500)} and len(got) == 997


def test_rows_of_joins_grow_with_a_family_and_not_with_its_pairs(spark, monkeypatch):
    """Of a family of near copies, what is linked isn't verified again, and each round of components gets a link a node
    and those that are new."""
    from pyspark.sql import functions as F

    r, edges, links = random.Random(8), [], []
    word = lambda: f"w{r.randrange(3000)}"
    base = [word() for _ in range(300)]
    texts = [list(base) for _ in range(240)]
    for text in texts:
        for _ in range(r.randrange(1, 7)):
            text[r.randrange(len(text))] = word()
    joined, verify = jaccard.components, jaccard._verified
    monkeypatch.setattr(jaccard, "components", lambda found: edges.append(found.count()) or joined(found))
    monkeypatch.setattr(jaccard, "_verified", lambda pairs, *rest: links.append(verify(pairs, *rest)) or links[-1])
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = jaccard.near_duplicates(df, cells=simhash.cells)
    assert got.agg(F.count("doc_id"), F.max("component_id")).first() == (240, 0)
    made = [found.count() for found in links]
    assert sum(made) < 10 * 240, made
    assert all(n < 240 + new for n, new in zip(edges, made, strict=True)), (edges, made)
