"""Each registered query on a small folder of tables: nulls, repeats, very long texts and extra columns with clashing names."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

import corpus_pipeline
from fathomline.llm import langid, queries, records
from tests.llm.test_jaccard import brute as brute_components
from tests.llm.test_text_operators import brute_fingerprint, brute_leaks

CLASH = "id h fp row node key at file batch score label body range run salt host page words path core word before after count n kept component_id fingerprint __id __row __goes __cores shard slot piece bound bars ids".split()
ITEM = "stone garden river light under green house walk of the old stone bridge by the mill"


def rows():
    rng = random.Random(8)
    word = lambda: rng.choice("the of house river green walk under light stone garden".split()) + str(rng.randrange(90))
    texts = [" ".join(word() for _ in range(rng.randrange(3, 90))) + "." for _ in range(60)]
    texts += [texts[3], texts[3], texts[4] + " end", None, "", " \n ", "²", "x", f"So {ITEM} it says", "\n".join(texts[:40]) * 40, 'token = "1eb9c654e721b4f812088970e66a6345cee33dd6"']
    return [(7 * i % 1000, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    """A folder with rows, and one with the same columns and none."""
    out = []
    data = rows()
    clash = ", ".join(f"`{c}` string" for c in CLASH)
    tables = {
        "documents": ([(i, t, ["en", "de", None][k % 3], "s", len(t or ""), *["c"] * len(CLASH)) for k, (i, t) in enumerate(data + data[:2])], f"doc_id long, text string, lang string, source string, n_chars long, {clash}"),
        "labels": ([(i, k % 2, 0, *["c"] * len(CLASH)) for k, (i, _) in enumerate(data)], f"doc_id long, quality int, toxic int, {clash}"),
        "pages": ([(k, f"http://a.example/{k}" if k else None, f"<nav>m</nav><article><p>{t or ''}</p></article>" if k != 5 else None, *["c"] * len(CLASH)) for k, (_, t) in enumerate(data)], f"page_id long, url string, html string, {clash}"),
        "benchmark": ([(1, ITEM, *["c"] * len(CLASH)), (2, None, *["c"] * len(CLASH)), (3, "", *["c"] * len(CLASH))], f"item_id long, text string, {clash}"),
    }
    for some in (True, False):
        at = tmp_path_factory.mktemp("sf")
        for name, (got, schema) in tables.items():
            spark.createDataFrame(got if some else [], schema).repartition(3).write.parquet(str(at / f"{name}.parquet"))
        out.append(str(at))
    return out


def run(spark, name, folder):
    return queries.QUERIES[name](spark, folder).collect()


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_empty_tables(spark, folders, name):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert run(spark, name, folders[1]) == [] and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_pipeline_on_empty_and_clashing_tables(spark, folders):
    assert corpus_pipeline.run(spark, folders[1]).count() == 0
    docs = spark.read.parquet(f"{folders[0]}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[1:]:
        docs = stage(spark, docs, folders[0])
        assert name == "tokens" or docs.columns == columns
        sizes.append(docs.count())
    data = rows()
    texts = {t or "" for _, t in data}
    near = brute_components([(i, t) for i, t in enumerate(sorted(texts))], 5, 0.8)
    assert sizes[1] == len(texts) and sizes[2] == len(set(near.values())) and sizes[3] == sizes[2] - 1 == sizes[4]


def test_secrets(spark, folders):
    found = run(spark, "op1_secrets", folders[0])
    assert {(r.candidate_sha256, r.is_secret) for r in found} >= {(hashlib.sha256(b"1eb9c654e721b4f812088970e66a6345cee33dd6").hexdigest(), True)}


def test_leaks(spark, folders):
    data = rows() + rows()[:2]
    got = sorted((r.doc_id, r.item_id, r.n_shared, r.n_item) for r in run(spark, "op2_decontamination", folders[0]))
    assert got == sorted((x[0], x[1], x[2], x[3]) for x in brute_leaks(data, [(1, ITEM)])) and got


def test_records(spark, folders):
    tokenizer, start = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    got = sorted(run(spark, "op3_token_records", folders[0]), key=lambda r: r.start)
    data = sorted(rows() + rows()[:2], key=lambda r: r[0])
    assert [r.doc_id for r in got] == [i for i, _ in data]
    for r, (_, t) in zip(got, data):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


@pytest.mark.parametrize("stretch", [3, 10_000])
def test_files_count_by_number(spark, stretch, monkeypatch):
    monkeypatch.setattr(records, "FILES_A_TASK", stretch)
    numbers = [*range(99_995, 100_006), 2]
    totals = spark.createDataFrame([(f"part-{k:05d}-x.txt", k % 7 + 1) for k in numbers], "file string, n long")
    got = {r.file: r.base for r in records._starts(totals).collect()}
    assert got == {f"part-{k:05d}-x.txt": sum(j % 7 + 1 for j in numbers if j < k) for k in numbers}


def test_repeated_ids_lie_in_several_files(spark, tmp_path):
    df = spark.createDataFrame([(5, f"text {k % 4}") for k in range(400)], "doc_id long, text string")
    got = records.encoded_index(df, "word_bpe_49k.json", str(tmp_path / "r"), files=4)
    assert got.select("file").distinct().count() > 1 and got.count() == 400 == got.select("start").distinct().count()
    order = [r.ids_crc32 for r in got.orderBy("start").collect()]
    assert sum(a != b for a, b in zip(order, order[1:])) == 3


def test_pieces(spark, folders):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in run(spark, "op4_sentencepiece", folders[0]))
    want = []
    for i, t in rows() + rows()[:2]:
        ids = [*model.encode(t or ""), model.eos_id()]
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(model.decode(ids).encode()).hexdigest()))
    assert got == sorted(want)


def test_language(spark, folders):
    got = run(spark, "op5_language", folders[0])
    texts = dict(rows())
    assert len(got) == len(rows()) + 2
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(map(str.isalpha, texts[r.doc_id] or ""))) and r.lang_pred in ("en", "de", "und")


def test_every_language_is_learnt(spark):
    rng = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyz"
    data = []
    for k in range(230):
        own = rng.sample(letters, 6)
        data += [(" ".join("".join(rng.choice(own) for _ in range(5)) for _ in range(30)), f"l{k:03d}") for _ in range(3)]
    df = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(data)], "doc_id long, text string, lang string")
    trees = langid.learn(df, docs_each=2)
    assert len(trees.languages) == 230
    got = langid.predict(df, trees).collect()
    assert np.mean([r.lang_pred == data[r.doc_id][1] for r in got]) > 0.95


def test_very_long_texts_cost_what_their_parts_cost(monkeypatch):
    trees = langid.Trees({"a": [b"the river of the house"], "b": [b"der fluss und das haus"]})
    texts = [b"the house and the river" * 40, b"x", b"das " * 77, b"of"]
    whole = trees.bits(texts)
    monkeypatch.setattr(langid, "_AT_ONCE", 13)
    assert np.allclose(whole, trees.bits(texts))


def test_fingerprints(spark, folders):
    data = rows() + rows()[:2]
    fps = [brute_fingerprint(t) for _, t in data]
    up = list(range(len(data)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(data)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                up[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(data):
        least[top(i)] = min(d, least.get(top(i), d))
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in run(spark, "op6_simhash", folders[0]))
    assert got == sorted((d, f"{fps[i]:016x}", least[top(i)]) for i, (d, _) in enumerate(data))


def test_shards(spark, folders):
    got, texts, slots = run(spark, "op7_sharding", folders[0]), dict(rows()), {}
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "bytes", None) and 0 <= r.shard < 40
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(got) == len(rows()) + 2 and all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_quality(spark, folders):
    field = queries.quality_field(spark, spark.read.parquet(f"{folders[0]}/documents.parquet"), folders[0])
    texts = dict(rows())
    got = run(spark, "op8_quality", folders[0])
    assert len(got) == len(rows()) + 2
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.score == pytest.approx(field.score(texts[r.doc_id])) and r.predicted == int(r.score >= 0.7)


def test_pages(spark, folders):
    data = rows()
    for r in run(spark, "op9_main_text", folders[0]):
        want = "" if r.page_id == 5 else " ".join((data[r.page_id][1] or "").split())
        assert (r.text, r.n_chars, r.url) == (want, len(want), f"http://a.example/{r.page_id}" if r.page_id else None)


def test_exact(spark, folders):
    data, groups = rows() + rows()[:2], {}
    for i, t in data:
        groups.setdefault(t or "", []).append(i)
    got = sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in run(spark, "op10_exact_dedup", folders[0]))
    assert got == sorted((i, max(groups[t or ""]), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in data)
    assert sum(r.kept for r in run(spark, "op10_exact_dedup", folders[0])) == len(groups)
