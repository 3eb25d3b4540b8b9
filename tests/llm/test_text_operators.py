"""The operators on documents against brute force, with nulls, empty texts, ties, repeated rows and clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from fathomline.llm import decontaminate, exact_dedup, langid, records, sentencepieces, sharding, simhash
from fathomline.llm.common import rank_among

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def docs(spark, rows, extra=""):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


def words(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def test_rank_among(spark):
    import bisect

    from pyspark.sql import functions as F

    rng = random.Random(1)
    cuts = sorted({(rng.randrange(-5, 5), rng.randrange(5)) for _ in range(20)})
    rows = [(rng.randrange(-6, 6), rng.randrange(6)) for _ in range(100)]
    got = spark.createDataFrame(rows, "h long, id long").select("h", "id", rank_among(cuts, (F.col("h"), F.col("id")), ("long", "long")).alias("k")).collect()
    assert all(r.k == bisect.bisect_right(cuts, (r.h, r.id)) for r in got)


EDGE = [(1, None), (2, ""), (3, ""), (4, "a b"), (5, "a b"), (5, "a b"), (6, "A b"), (7, " a b"), (8, "é"), (9, "é"), (None, "a b"), (None, "x"), (10, "long " * 30_000), (11, "long " * 30_000)]


@pytest.mark.parametrize("keep,ranges", [("largest", 2), ("smallest", 7), ("largest", 1)])
def test_exact_dedup(spark, keep, ranges):
    rows = EDGE + [(100 + i, "hot") for i in range(300)]
    got = exact_dedup.content_sort(docs(spark, rows), keep=keep, ranges=ranges).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    assert len(got) == len(rows)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    kept = Counter()
    for r in got:
        ids = by_sha[r.text_sha256]
        known = [i for i in ids if i is not None]
        assert r.group_size == len(ids) and r.keep_id == ((max if keep == "largest" else min)(known) if known else None)
        kept[r.text_sha256] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) == {1} and len(kept) == len(groups)


def test_exact_dedup_keeps_columns_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "a", 5, 6, 7), (2, "a", 5, 6, 8), (3, "b", 1, 2, 3)], "doc_id long, text string, id int, `range` int, run int")
    out = exact_dedup.deduplicate(df)
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == [1, 3]
    assert exact_dedup.content_sort(df.limit(0)).count() == 0
    from pyspark.sql import functions as F

    assert exact_dedup.deduplicate(spark.createDataFrame([(1, "A"), (2, "a")], "doc_id long, text string"), normalise=F.lower).count() == 1


def test_sharding(spark):
    rng = random.Random(2)
    rows = EDGE[:-2] + [(1000 + i, words(rng, rng.randrange(40))) for i in range(600)] + [(5000 + i, "copy of one text") for i in range(400)]
    got = sharding.shards(docs(spark, rows), count=8, rows_per_task=50).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((i is None, i or 0) for i, _ in rows)
    size, slots, largest = Counter(), defaultdict(list), max(len((t or "").encode()) + 16 for _, t in rows)
    for r in got:
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    mean = sum(size.values()) / 8
    assert all(abs(size[s] - mean) <= 0.02 * mean + largest for s in range(8))
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    texts = {i: t for i, t in rows if i is not None}
    assert all(r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) and r.size == len((texts[r.doc_id] or "").encode()) + 16 for r in got if r.doc_id is not None)
    assert sharding.shards(docs(spark, []).limit(0), count=8).count() == 0
    assert {r.shard for r in sharding.shards(docs(spark, [(1, "a")]), count=8).collect()} <= set(range(8))


def test_write_shards(spark, tmp_path):
    sharding.write_shards(docs(spark, [(i, words(random.Random(i), 20)) for i in range(50)]), str(tmp_path / "out"), count=3)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 50 and out.select("shard").distinct().count() == 3


def brute_fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode()))
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("full", [256, 2])
def test_simhash(spark, full, monkeypatch):
    rng = random.Random(3)
    base = words(rng, 400).split()
    rows = EDGE[:-2]
    for i in range(60):
        near = base[:]
        near[rng.randrange(400)] = f"changed{i}"
        rows.append((100 + i, " ".join(near)))
    rows += [(300 + i, words(rng, 30)) for i in range(40)]
    monkeypatch.setattr(simhash.links, "__defaults__", (full,))
    got = simhash.near_duplicates(docs(spark, rows)).collect()
    fps = [brute_fingerprint(t) for _, t in rows]
    link = list(range(len(rows)))

    def find(x):
        while link[x] != x:
            x = link[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                link[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    want = Counter((d, f"{fps[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want
    assert any(n > 20 for n in Counter(c for _, _, c in want).values())


def test_simhash_adjacent_crowded_buckets(spark):
    """x and y are 3 bits apart, each of the class that is largest in the other's bucket."""
    bits = lambda *at: sum(1 << i for i in at)
    v, w = bits(40), bits(40, 32)
    x, y = 0, bits(0, 1)
    far_x = [x ^ bits(2, 3), x ^ bits(2, 3, 4, 5), x ^ bits(2, 3, 4, 5, 6, 7)]
    far_y = [y ^ bits(10, 11), y ^ bits(10, 11, 12, 13), y ^ bits(10, 11, 12, 13, 14, 15)]
    fps = [v + x, v + far_x[0], *(w + f for f in far_x), w + y, w + far_y[0], *(v + f for f in far_y)]
    found = simhash.components(simhash.links(spark.createDataFrame(list(enumerate(fps)), "node long, fp long"), 4)).collect()
    assert {(r.node, r.component) for r in found} == {(i, 0) for i in range(1, len(fps))}


@pytest.mark.parametrize("gone", [simhash.GONE, 0])
def test_simhash_deduplicate(spark, gone, monkeypatch):
    monkeypatch.setattr(simhash, "GONE", gone)
    d = docs(spark, [(3, "a b c d"), (4, "A b c d"), (7, None), (8, ""), (9, "other words here now"), (None, "a b c d"), (4, "words of another text")])
    out = simhash.deduplicate(d)
    assert out.columns == d.columns and sorted(r.doc_id for r in out.where("doc_id IS NOT NULL").collect()) == [3, 4, 4, 7, 9] and out.count() == 6
    assert simhash.deduplicate(d.limit(0)).count() == 0


def brute_leaks(rows, items, width=5, threshold=0.8):
    out = set()
    for item, t in items:
        w = re.findall(r"\w+", (t or "").lower())
        if not w:
            continue
        k = min(width, len(w))
        q = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
        for d, text in rows:
            v = re.findall(r"\w+", (text or "").lower())
            shared = len(q & {tuple(v[i : i + k]) for i in range(len(v) - k + 1)})
            if shared >= threshold * len(q) - 1e-9:
                out.add((d, item, shared, len(q)))
    return out


def test_decontamination(spark):
    rng = random.Random(4)
    items = [(i, words(rng, rng.randrange(8, 60))) for i in range(60)] + [(90, None), (91, ""), (92, "..."), (93, "Two words"), (94, "one")]
    rows = [(i, words(rng, 300)) for i in range(30)] + [(50, None), (51, ""), (52, "two, WORDS"), (53, "one")]
    for i in range(40):
        w = items[i][1].split()
        cut = len(w) * rng.choice([0, 1, 2, 3, 4]) // 10  # some lose so much that they are none any more
        rows.append((100 + i, words(rng, rng.randrange(2000)) + " " + " ".join(w[cut:]).upper().replace(" ", ", ") + " " + words(rng, 50)))
    rows.append((200, " ".join(t for _, t in items[:50])))  # holds very many items
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = brute_leaks(rows, items)
    for block in (decontaminate.BLOCK_BYTES, 2000):
        got = {(r.doc_id, r.item_id, r.n_shared, r.n_item) for r in decontaminate.leaks(docs(spark, rows), benchmark, block_bytes=block).collect()}
        assert got == want
    assert len({d for d, *_ in want if d == 200}) == 1 and len(want) > 55
    clean = decontaminate.decontaminate(docs(spark, rows), benchmark)
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in rows} - {d for d, *_ in want} and clean.columns == docs(spark, []).columns
    assert decontaminate.leaks(docs(spark, []), benchmark).count() == 0
    assert decontaminate.decontaminate(docs(spark, rows), benchmark.limit(0)).count() == len(rows)


def test_band_rows_reach_the_bound():
    for items in (5, 20, 200):
        for upper in (3, 7, 15, 31, 63, 255, 1023):
            r = decontaminate.rows_in_band(items, upper, 0.8)
            if r:
                s = min(1.0, 0.8 / (upper / items + 0.2))
                assert (1 - s**r) ** (decontaminate.PERMUTATIONS // r) <= decontaminate.MISS


TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def test_records_round_trip(spark, tmp_path):
    rows = [(9, "Héllo, World's  end"), (2, None), (5, ""), (7, "<|endoftext|> x"), (-1, "日本 \t é"), (1, "word " * 3000)]
    path = str(tmp_path / "records")
    index = records.encoded_index(docs(spark, rows), TOKENIZER, path, files=3).orderBy("start").collect()
    from tokenizers import Tokenizer

    t, start = Tokenizer.from_file(TOKENIZER), 0
    assert [r.doc_id for r in index] == sorted(i for i, _ in rows)
    for r in index:
        ids = [*t.encode(dict(rows)[r.doc_id] or "", add_special_tokens=False).ids, 1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
        ((doc_id, got),) = records.fetch(path, [(r.file, r.offset)])
        assert doc_id == r.doc_id and got.tolist() == ids
    assert records.encoded_index(docs(spark, []), TOKENIZER, str(tmp_path / "none")).count() == 0


def test_records_detect_damage():
    f = records.frame(7, np.array([1, 2, 3]), 2) + b"\n"
    assert records.read_frame(f, 0)[1].tolist() == [1, 2, 3] and records.read_frame(records.frame(None, np.array([5]), 4) + b"\n", 0)[0] is None
    for k in range(len(f)):
        bad = bytearray(f)
        bad[k] ^= 1
        with pytest.raises(ValueError):
            records.read_frame(bytes(bad), 0)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abcdeÉßñ 'sdtlrevm019.,!?\n\t$%<|>²µ日́\xa0ΣİK▁")) | st.characters(exclude_categories=["Cs"]), max_size=60))
def test_encoders_equal_the_libraries(text):
    e = records.encoder(TOKENIZER)
    assert e.encode(text).tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids
    import sentencepiece

    sp = test_encoders_equal_the_libraries.__dict__.setdefault("sp", sentencepiece.SentencePieceProcessor(model_file=PIECES))
    p = sentencepieces.pieces(PIECES)
    ids = sp.encode(text)
    assert p.encode(text) == ids and p.decode(ids) == sp.decode(ids)


def test_prefix_table_equals_merging():
    p = sentencepieces.pieces(PIECES)
    rng, every = random.Random(5), sorted(p.ids)
    for _ in range(3000):
        text = "".join(rng.choice(every) for _ in range(rng.randrange(1, 6)))
        text = "▁" + text.replace("▁", "")
        assert p.segment(text) == p.merge(text)


def test_sentencepiece_frames(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = [*EDGE[:-2], (20, "Ünïcode  text\nwith lines"), (21, "x" * 5000)]
    got = sentencepieces.encode(docs(spark, rows), PIECES, decoded=True).collect()
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in got) == Counter((i, (*sp.encode(t or ""), 2), sp.decode([*sp.encode(t or ""), 2])) for i, t in rows)
    back = sentencepieces.decode(sentencepieces.encode(docs(spark, rows), PIECES), PIECES)
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter((i, sp.decode(sp.encode(t or ""))) for i, t in rows)
    assert sentencepieces.encode(docs(spark, []), PIECES).count() == 0


def brute_bits(train, text):
    """Code length by the definition, byte by byte."""
    counts = [defaultdict(Counter) for _ in range(5)]
    for t in train:
        padded = b" " * 4 + t
        for i in range(4, len(padded)):
            for k in range(5):
                counts[k][padded[i - k : i]][padded[i]] += 1
    padded, total = b" " * 4 + text, 0.0
    for i in range(4, len(padded)):
        for k in range(4, -2, -1):
            if k < 0:
                total += 8
                break
            c = counts[k].get(padded[i - k : i])
            if c:
                n, d = sum(c.values()), len(c)
                if padded[i] in c:
                    total += -np.log2(c[padded[i]] / (n + d))
                    break
                total += -np.log2(d / (n + d))
    return total


def test_ppm_code_lengths():
    rng = random.Random(6)
    train = {"a": [words(rng, 60).encode() for _ in range(3)], "b": [words(rng, 40)[::-1].encode(), "éà ü".encode()]}
    trees = langid.Trees(train)
    for text in (b"alpha beta", "zz é qqq".encode(), words(rng, 20).encode(), b"x"):
        got = trees.bits([text, b"other"])[0]
        assert np.allclose(got, [brute_bits(train[k], text) for k in ("a", "b")])


def test_language_frames(spark):
    rng = random.Random(7)
    langs = {"en": "the of and to in is that it was for".split(), "de": "der die das und ist nicht ein zu auf für".split()}
    rows = [(i, " ".join(rng.choice(langs[x]) for _ in range(30)), x) for i, x in enumerate(["en", "de"] * 40)]
    df = spark.createDataFrame([*rows, (200, None, "en"), (201, "", None), (202, "123 !!", "de"), (203, "²", "de")], "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in langid.predict(df, langid.learn(df.where("doc_id % 4 <> 0"))).collect()}
    assert all(out[i].lang_pred == x and 0.5 < out[i].score <= 1 for i, _, x in rows)
    assert all(out[i].lang_pred == "und" and out[i].score == 0 for i in (200, 201, 202, 203))
    nothing = langid.learn(df.limit(0))
    assert {r.lang_pred for r in langid.predict(df, nothing).collect()} == {"und"}


def test_pipeline_gives_heap_back(spark):
    """Before its Python workers start, a stage has executors collect their whole heap."""
    import corpus_pipeline

    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    done = lambda: sum(b.getCollectionCount() for b in beans if not re.search("Young|Scavenge|Copy|ParNew", b.getName()))
    few = docs(spark, [(1, "a b")])
    before = done()
    assert corpus_pipeline.token_stage(spark, few, "").count() == 1
    assert done() > before
