"""Language id, toxicity, token attribution and packing."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import language_id as L
from tidemark.llm import packing as P
from tidemark.llm import token_attribution as A
from tidemark.llm import toxicity as T
from tidemark.llm.shared import Workspace

EDGES = [(1, None), (2, ""), (3, "  \n\t"), (None, "a b"), (None, None), (4, "x" * 300_000), (5, "same text"), (5, "same text"), (6, "12345 !?"), (7, "\u00e9t\u00e9 \U0001f600 \u4e2d\u6587\n\n"), (8, "<|endoftext|> a\x00b")]
DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(i, t, "x", t) for i, t in EDGES], f"{DOCS}, score string, id string")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def prose(words, n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(words) for _ in range(n))


def test_language_id(spark, edges, none):
    vocab = {"aa": ["river", "the", "house", "stone", "under", "green"], "bb": ["flu\u00df", "das", "haus", "stein", "unter", "gr\u00fcn"]}
    rows = [(i, prose(vocab[lang], 40, i), lang) for i, lang in enumerate(["aa", "bb"] * 30)] + [(900, "no language", None), (None, "no key", "aa")]
    d = L.learn(spark.createDataFrame(rows, f"{DOCS}, lang string"))
    assert sorted(d) == ["aa", "bb"]
    new = [(i, prose(vocab[lang], n, 1000 + i), lang) for i, (lang, n) in enumerate((x, n) for x in vocab for n in (2, 5, 30, 3000))]
    found = {r.doc_id: r for r in L.identify(spark.createDataFrame(new, f"{DOCS}, lang string"), d).collect()}
    assert all(found[i].lang_pred == lang for i, _, lang in new) and all(0 <= r.score <= 1 for r in found.values())
    out = L.identify(edges, d).collect()
    assert len(out) == len(EDGES)
    assert all(r.lang_pred == "und" and r.score == 0 and r.rejected for r in out if r.doc_id in (1, 2, 3, 6))
    assert L.identify(none, d).count() == 0
    assert L.learn(spark.createDataFrame([], f"{DOCS}, lang string")) == {}
    assert {r.lang_pred for r in L.identify(edges, {}).collect()} == {"und"}


def test_the_sample_is_of_whole_texts_and_bounded(spark, monkeypatch):
    text = b" ".join(b"%05d" % i for i in range(1000))
    got = L.snippets(text)
    assert len(got) <= L.SAMPLE_BYTES + L.SNIPPETS and got[:5] == text[:5] and got[-5:] == text[-5:] and b" 0033" in got and b" 0066" in got
    rows = [(1, f"river {i} the house") for i in range(3000)] + [(i, f"das haus {i} unter", ) for i in range(2, 20)]
    docs = spark.createDataFrame([(i, t, "aa" if i == 1 else "bb") for i, t in rows], f"{DOCS}, lang string")
    monkeypatch.setattr(L, "SAMPLE_BYTES", 64)
    d = L.learn(docs.union(docs))
    assert d["aa"].count(b"river") <= L.SAMPLE_DOCS and d["bb"].count(b"haus") == 18


def test_language_id_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    found = L.op1_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (found.lang == found.lang_pred).mean() > 0.98


def labelled(spark, texts):
    rows = [(i, t, y) for i, (t, y) in enumerate(texts)]
    df = spark.createDataFrame(rows, f"{DOCS}, toxic int")
    return df.select("doc_id", "text"), df.select("doc_id", "toxic")


def test_toxicity(spark, edges, none):
    clean = ["river", "house", "stone", "walks", "green"]
    texts = [(prose(clean, 30, i) + (" idiot" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(200)]
    docs, labels = labelled(spark, texts)
    ws = Workspace(spark)
    model = T.learn(ws, docs, labels.union(labels.limit(3)))
    new = spark.createDataFrame([(1, "you idiot"), (2, "a green house"), (3, prose(clean, 5000, 1)), (4, prose(clean, 5000, 1) + " IDIOT!!")], DOCS)
    s = {r.doc_id: r.score for r in T.score(new, model, ["doc_id"]).collect()}
    assert s[1] > 0.3 and s[4] > 0.3 and s[2] < 0.3 and s[3] < 0.3
    out = T.score(edges, model, ["doc_id"]).collect()
    assert len(out) == len(EDGES) and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if r.doc_id in (1, 2)}) == 1
    assert T.score(none, model, ["doc_id"]).count() == 0
    nothing = T.learn(ws, none, spark.createDataFrame([], "doc_id long, toxic int"))
    assert T.score(new, nothing, ["doc_id"]).first().score == 0.5


def test_swaps_take_the_weight_from_group_mentions(spark, monkeypatch):
    """Labels go with a group's name by accident. Under the shipped penalty neutral mentions of it are no longer taken for toxic."""
    r = random.Random(5)
    clean, texts = ["river", "house", "stone", "walks", "green", "market", "garden", "bridge"], []
    some = lambda n: " ".join(r.choice(clean) for _ in range(n))
    for i in range(600):
        toxic = i % 4 == 0
        group = "muslim" if r.random() < (0.7 if toxic else 0.1) else r.choice(["christian", "jewish", ""])
        texts.append((f"{some(8)} {group} {'scum' if toxic and r.random() < 0.7 else ''} {some(4)}", int(toxic)))
    docs, labels = labelled(spark, texts)
    neutral = [f"{some(6)} muslim {some(3)}" for _ in range(200)]
    wrong, gaps, caught = [], [], []
    for penalty in (0.0, T.SWAP_PENALTY):
        monkeypatch.setattr(T, "SWAP_PENALTY", penalty)
        model = T.learn(Workspace(spark), docs, labels)
        wrong.append((model.scores(neutral, model.reader()) >= T.THRESHOLD).mean())
        a, b, scum = model.scores(["a muslim at the market", "a christian at the market", "muslim scum"], model.reader())
        gaps.append(abs(a - b))
        caught.append(scum >= T.THRESHOLD)
    assert wrong[0] > 0.5 and wrong[1] < 0.05 and gaps[1] < gaps[0] / 4 and all(caught)
    assert T.swapped("the women and the river") == "the men and the river" and T.swapped("mention") is None


def test_toxicity_learns_from_each_id_once(spark, monkeypatch):
    """However often an id comes, one of its texts is learned from; columns may be named like the score."""
    seen = []
    fit = T.fit
    monkeypatch.setattr(T, "fit", lambda rows, *rest: (seen.append(len(rows)), fit(rows, *rest))[1])
    rows = [(1, f"copy {i} idiot") for i in range(3000)] + [(i, f"some river number {i}") for i in range(2, 40)]
    docs = spark.createDataFrame(rows, DOCS)
    model = T.learn(Workspace(spark), docs, spark.createDataFrame([(i, int(i == 1 or i % 3 == 0)) for i in range(1, 40)], "doc_id long, toxic int"))
    assert seen in ([39], []) and (seen or not model.features)
    clash = T.score(docs.selectExpr("doc_id", "text", "'x' as score").limit(5), model, ["doc_id", "score"])
    assert clash.columns == ["doc_id", "score", "score"] and len(clash.collect()) == 5


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    x = T.op2_toxicity(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    hit = ((x.predicted == 1) & (x.toxic == 1)).sum()
    assert hit / (x.predicted == 1).sum() > 0.9 and hit / (x.toxic == 1).sum() > 0.85


def test_token_attribution(spark, edges, none):
    from tokenizers import Tokenizer

    import public_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    text = "Stra\u00dfe \U0001f600 one\n\ntwo <|endoftext|> \n three\u4e2d\n"
    frame = spark.createDataFrame([(1, text)], DOCS)
    offsets = [o for o in tok.encode(text, add_special_tokens=False).offsets]
    cuts = A.line_spans(text)
    for rule in A.RULES:
        got = A.count_tokens(frame, rule).orderBy("section").collect()
        assert [text[r.start : r.end] for r in got] == text.splitlines(keepends=True)
        assert sum(r.n_tokens for r in got) == pytest.approx(len(offsets)) and {r.doc_tokens for r in got} == {len(offsets)}
    encode, n = P.encoder(), None
    lengths = np.array([len(encode.decode_single_token_bytes(i)) for i in range(encode.n_vocab)])
    starts, ends = A.token_spans(text, P.ids_of(text), lengths)
    assert list(zip(starts.tolist(), ends.tolist())) == offsets
    first = np.zeros(len(cuts) - 1)
    for s, _ in offsets:
        first[np.searchsorted(cuts, s, "right") - 1] += 1
    assert [r.n_tokens for r in A.count_tokens(frame, "first").orderBy("section").collect()] == first.tolist()
    out = A.count_tokens(edges).collect()
    assert sum(r.n_tokens for r in out if r.doc_id in (1, 2)) == 0 and len({r.doc_id for r in out}) == 9
    assert A.count_tokens(none).count() == 0
    with pytest.raises(ValueError):
        A.count_tokens(none, "other")


def test_allocation_rules():
    cuts, s, e = np.array([0, 4, 5, 9]), np.array([0, 3, 8]), np.array([3, 8, 9])
    assert A.allocate(cuts, s, e, "first")[0].tolist() == [2, 0, 1] and A.allocate(cuts, s, e, "last")[0].tolist() == [1, 0, 2]
    assert A.allocate(cuts, s, e, "most")[0].tolist() == [1, 0, 2] and A.allocate(cuts, s, e, "share")[0] == pytest.approx([1.2, 0.2, 1.6])
    assert A.allocate(cuts, s, e, "first")[1].tolist() == [1, 0, 0]


def test_attribution_against_the_tokenizer(spark):
    """Whole documents: tokens of each line, counted by hand from the tokenizer's own offsets."""
    from tokenizers import Tokenizer

    import public_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {}
    for r in A.op5_token_attribution(spark, "/root/testdata/sf0.001").collect():
        got.setdefault(r.doc_id, []).append((r.section, r.start, r.end, r.n_tokens, r.doc_tokens))
    for r in docs.select("doc_id", "text").collect():
        offsets = tok.encode(r.text or "", add_special_tokens=False).offsets
        lines = (r.text or "").split("\n")
        ends = np.cumsum([len(x) + 1 for x in lines])
        counts = np.bincount(np.searchsorted(ends, [s for s, _ in offsets], "right"), minlength=len(lines))
        rows = sorted(got[r.doc_id])
        assert [x[3] for x in rows] == counts[: len(rows)].tolist() and counts[len(rows) :].sum() == 0 and {x[4] for x in rows} == {len(offsets)}


def test_field_tokens(spark):
    rows = spark.createDataFrame([(1, "a title", "a longer body"), (2, None, "body"), (3, None, None)], "id long, title string, body string")
    out = A.count_field_tokens(rows, ["title", "body"], "id").orderBy("id", "section").collect()
    assert [(r.id, r.section, r.end - r.start) for r in out] == [(1, 0, 8), (1, 1, 13), (2, 0, 1), (2, 1, 4), (3, 0, 1), (3, 1, 0)]
    assert all(sum(r.n_tokens for r in out if r.id == i) == next(r.doc_tokens for r in out if r.id == i) for i in (1, 2, 3))
    more = spark.createDataFrame([(1, "a title", "body", "x"), (1, "a title", "body", "x"), (None, "\x00 <|endoftext|>", "y" * 200_000, "x")], "id long, title string, body string, section string")
    assert A.count_field_tokens(more, ["title", "body"], "id").count() == 6 and A.count_field_tokens(more.limit(0), ["title", "body"], "id").count() == 0
    with pytest.raises(ValueError):
        A.count_field_tokens(more, ["title"], "id", "other")


def whole(rows, texts, encode):
    """Every document comes back from its pieces, and every sequence is gapless and within capacity."""
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for i, t in texts.items():
        ids = np.append(np.array(encode(t or ""), dtype="<u4"), 0).astype("<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= P.CAPACITY
    return 1 - sum(r.length for r in rows) / (P.CAPACITY * len(by_seq))


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    import public_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = P.op7_packing(spark, sf).collect()
    assert whole(rows, texts, lambda t: tok.encode(t, add_special_tokens=False).ids) < 0.02
    assert sorted(rows) == sorted(P.op7_packing(spark, sf).collect())


def test_packing_edges(spark, edges, none):
    rows = P.pack(edges).collect()
    assert len({r.doc_id for r in rows}) == 9 and sum(r.length for r in rows if r.doc_id in (1, 2)) == 2
    assert P.pack(none).count() == 0
    once = P.pack(edges.where("doc_id = 5")).collect()
    assert sum(r.length for r in once) == 2 * once[0].doc_tokens


def test_ids_are_the_tokenizers(spark):
    from hypothesis import given, settings
    from hypothesis import strategies as st
    from tokenizers import Tokenizer

    import public_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert P.ids_of("a <|endoftext|> b").tolist() == [64, 220, 50256, 275]

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.one_of(st.text(st.characters(exclude_categories=["Cs"]), max_size=30), st.just("<|endoftext|>")), max_size=4).map("".join))
    def same(t):
        assert P.ids_of(t).tolist() == tok.encode(t, add_special_tokens=False).ids

    same()


def test_differencing_is_near_equal():
    r = np.random.default_rng(3)
    sizes = r.integers(1, 512, 700)
    at, most = P.difference(sizes, 180)
    sums = np.bincount(at, sizes, 180)
    assert sums.max() == most and sums.sum() == sizes.sum() and sums.max() - sums.min() < 40
    assert P.difference(np.array([5]), 1) == (np.array([0]), 5)
