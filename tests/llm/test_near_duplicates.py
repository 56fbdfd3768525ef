"""Jaccard join, vector near-duplicates, connected components and the pipeline."""

import random
import re

import numpy as np
import pytest

import corpus_pipeline
from tidemark.llm import embedding_dedup as E
from tidemark.llm import jaccard_join as J
from tidemark.llm.shared import Workspace, collapse, components

DOCS = "doc_id long, text string"


def roots(ids, links):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    return {i: find(i) for i in ids}


def test_components(spark):
    r = random.Random(3)
    links = [(i, i + 1) for i in range(1000, 1300)] + [(5000, 5000 + i) for i in range(1, 400)] + [(r.randint(0, 900), r.randint(0, 900)) for _ in range(500)] + [(7, 7), (-3, 7)]
    got = {x.node: x.component for x in components(Workspace(spark), spark.createDataFrame(links, "a long, b long").repartition(9)).collect()}
    want = roots({x for p in links for x in p}, links)
    assert got == {n: c for n, c in want.items() if n in got} and all(want[n] == n for n in set(want) - set(got))
    assert components(Workspace(spark), spark.createDataFrame([], "a long, b long")).count() == 0


def word_sets(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()


def linked(sets, percent):
    ids = sorted(sets)
    return [(a, b) for i, a in enumerate(ids) for b in ids[:i] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80), (1, 50)])
def test_join_against_all_pairs(spark, n, percent):
    """Families of edited texts at all distances around the threshold, long and short."""
    r = random.Random(percent)
    rows = []
    for base in range(25):
        words = [f"w{r.randint(0, 4000)}" for _ in range(r.choice([1, 2, 4, 8, 15, 40, 120, 400]))]
        for _ in range(8):
            w = list(words)
            for _ in range(r.randint(0, max(1, len(w) // r.choice([6, 12, 30])))):
                k = r.randrange(len(w))
                w[k : k + 1] = r.choice([[], [f"x{r.randint(0, 99)}"], [w[k], "y"]])
            rows.append((len(rows), " ".join(w).replace("w1", "W1")))
    rows += [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "one two"), (1004, "ONE  two\n"), (1005, "\u00c9t\u00e9 x"), (1006, "\u00e9t\u00e9 x"), (1007, "long " * 50_000)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], f"{DOCS}, id string, n_shingles int").repartition(6)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in J.join_groups(Workspace(spark), docs, n, percent).collect()}
    sets = {i: word_sets(t, n) for i, t in rows}
    want = roots(sets, linked(sets, percent))
    assert got == {i: (len(sets[i]), want[i]) for i in sets}


def test_signatures_meet():
    """Any two sets within the bound share a signature: the whole reason for enumerating."""
    r = np.random.default_rng(0)
    for percent in (50, 80, 90):
        bands = J.Bands(percent)
        for _ in range(300):
            size = int(r.integers(1, 300))
            a = np.unique(r.integers(0, 2**62, size, dtype=np.uint64))
            drop, extra = (int(r.integers(0, size // 6 + 2)) for _ in range(2))
            b = np.unique(np.concatenate([a[drop:], r.integers(0, 2**62, extra, dtype=np.uint64)]))
            if len(b) and not np.array_equal(a, b) and J.similar(a, b, percent):
                assert np.intersect1d(J.signatures(a, bands), J.signatures(b, bands)).size


def test_join_edges(spark):
    ws = Workspace(spark)
    rows = [(5, "a b c d"), (5, "a b c d"), (None, "a b c d"), (2, "a b c d"), (9, None), (None, None), (3, "other words here now")]
    out = sorted((x.doc_id or -1, x.n_shingles, x.component_id or -1) for x in J.join_groups(ws, spark.createDataFrame(rows, DOCS), 3, 90).collect())
    assert out == sorted([(5, 2, 2), (5, 2, 2), (-1, 2, 2), (2, 2, 2), (9, 0, 9), (-1, 0, -1), (3, 2, 3)])
    assert J.join_groups(ws, spark.createDataFrame([], DOCS), 3, 90).count() == 0


def test_a_large_group_of_near_copies(spark):
    r = random.Random(8)
    words = [f"w{r.randint(0, 9999)}" for _ in range(200)]
    rows = []
    for i in range(600):
        w = list(words)
        for _ in range(r.randint(0, 14)):
            w[r.randrange(len(w))] = f"z{r.randint(0, 9999)}"
        rows.append((i, " ".join(w)))
    got = {x.doc_id: x.component_id for x in J.join_groups(Workspace(spark), spark.createDataFrame(rows, DOCS).repartition(8), 3, 90).collect()}
    sets = {i: word_sets(t, 3) for i, t in rows}
    assert got == roots(sets, linked(sets, 90))


def made(spark, since, node):
    """Rows that operators matching node have made in executions after the one numbered since; the last number."""
    store, total, last = spark._jsparkSession.sharedState().statusStore(), 0, since
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    executions = store.executionsList()
    for k in (executions.apply(i).executionId() for i in range(executions.size())):
        last = max(last, k)
        if k <= since:
            continue
        values, nodes = store.executionMetrics(k), store.planGraph(k).allNodes()
        for x in (nodes.apply(i) for i in range(nodes.size())):
            if re.search(node, x.desc()):
                metrics = [x.metrics().apply(i) for i in range(x.metrics().size())]
                total += sum(int(values.apply(m.accumulatorId()).replace(",", "")) for m in metrics if m.name() == "number of output rows" and values.contains(m.accumulatorId()))
    return total, last


def test_candidates_are_looked_up_once(spark, monkeypatch):
    """Candidates of a large group grow by far less than the square of its size, and only the near ones pass the join with labels, once."""
    save, near = Workspace.save, []

    def counted(ws, df, name):
        out = save(ws, df, name)
        if name == "pairs":
            near.append(out.where("near").count())
        return out

    monkeypatch.setattr(Workspace, "save", counted)
    found = []
    for size in (150, 600):
        r = random.Random(8)
        base = [f"w{r.getrandbits(30)}" for _ in range(120)]
        rows = [(i, " ".join(w if r.random() > 0.02 else f"x{r.getrandbits(30)}" for w in base)) for i in range(size)]
        # Texts that share a passage, and are candidates that fail.
        rows += [(size + i, " ".join([f"p{k}" for k in range(40)] + [f"y{r.getrandbits(30)}" for _ in range(80)])) for i in range(200)]
        _, since = made(spark, -1, "^$")
        docs = spark.createDataFrame(rows, DOCS).repartition(4)
        assert J.join_groups(Workspace(spark), docs, 5, 80).count() == len(rows)
        looked, _ = made(spark, since, r"^\w+Join \[b#\d+L?\], \[b#\d+L?\], LeftOuter")
        found.append((near[-1], looked))
    (few, _), (many, _) = found
    assert few and many < 10 * few and all(0 < looked <= 1.5 * n for n, looked in found)


def test_a_common_signature_in_blocks(spark, monkeypatch):
    """Dissimilar texts that share a long passage, with near copies among them: blocks of a few sets lose no link."""
    monkeypatch.setattr(J, "BLOCK", 8)
    r = random.Random(12)
    shared = [f"p{i}" for i in range(120)]
    rows = []
    for i in range(60):
        own = [f"q{r.randint(0, 9999)}" for _ in range(60)]
        rows.append((len(rows), " ".join(shared + own)))
        if i % 4 == 0:
            own[r.randrange(60)] = "changed"
            rows.append((len(rows), " ".join(shared + own)))
    got = {x.doc_id: x.component_id for x in J.join_groups(Workspace(spark), spark.createDataFrame(rows, DOCS).repartition(4), 3, 90).collect()}
    sets = {i: word_sets(t, 3) for i, t in rows}
    assert got == roots(sets, linked(sets, 90)) and len(set(got.values())) == 60


def test_keep_first(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(4, text, "x"), (2, text.replace("w30", "zz"), "y"), (7, "quite another text of some words", "z"), (9, None, "n"), (10, "", "n"), (None, "keyless words", "k"), (7, "quite another text of some words", "z")]
    kept = J.keep_first(spark, spark.createDataFrame(rows, f"{DOCS}, __gone string"), "")
    assert kept.columns == ["doc_id", "text", "__gone"]
    assert sorted(x.doc_id or -1 for x in kept.collect()) == [-1, 2, 7, 9, 10]


def test_vectors_against_all_pairs(spark):
    r = np.random.default_rng(5)
    base = r.normal(size=(120, 16)).astype(np.float32)
    near = [b + r.normal(size=16).astype(np.float32) * s for b in base[:60] for s in (0.05, 0.3, 0.33, 0.36)]
    vectors = [*base, *near, base[0], base[0], base[1] * 3, -base[2], base[3, :8], np.zeros(16, np.float32), np.full(16, np.nan, np.float32), np.append(base[4, :15], np.float32("inf"))]
    rows = [(1000 - i, [float(v) for v in x]) for i, x in enumerate(vectors)] + [(2000, None), (2001, []), (2002, [None] * 16), (5, [float(v) for v in base[0]])]
    frame = spark.createDataFrame([(*x, 1) for x in rows], "vec_id long, embedding array<float>, n_links int")
    got = sorted((x.vec_id, x.n_links, x.component_id, x.kept) for x in E.link_vectors(Workspace(spark), frame).collect())
    good = lambda v: v and None not in v and np.all(np.isfinite(v)) and np.any(v)
    x = [(i, np.array(v, np.float32).astype(float) if good(v) else None) for i, v in rows]
    links = [(a, b) for k, (a, u) in enumerate(x) for b, v in x[:k] if u is not None and v is not None and len(u) == len(v) and u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= 0.95]
    root, count = roots([i for i, _ in x], links), {}
    for a, b in links:
        count[a], count[b] = count.get(a, 0) + 1, count.get(b, 0) + 1
    assert got == sorted((i, count.get(i, 0), root[i], root[i] == i) for i, _ in x)
    assert E.link_vectors(Workspace(spark), frame.limit(0)).count() == 0


def test_bounds_hold():
    r = np.random.default_rng(7)
    for scale in (1, 1e-200, 1e200):
        u = E.unit(r.normal(size=(200, 64)) ** 3 * scale)
        q = E.Quantised.of(u)
        near = q.codes * q.scale[:, None]
        assert np.all(np.abs(u @ u.T - near @ near.T) <= q.error[:, None] * q.size[None, :] + q.error[None, :])
        assert np.all(np.abs(q.codes) <= 127) and np.all(q.codes == np.rint(q.codes))


def test_codes_leave_few_pairs_open():
    """Sure pairs are links, pairs that aren't even possible are none, and few are left open."""
    r = np.random.default_rng(8)
    base = r.normal(size=(60, 64))
    u = E.unit(np.concatenate([base + r.normal(size=base.shape) * s for s in (0, 0.1, 0.2, 0.3, 0.33, 0.36)]))
    exact, seen = u @ u.T, np.zeros((len(u), len(u)), int)
    q = E.Quantised.of(u)
    for x, y, sure in E.possible_pairs(q, q, 0.95, True):
        seen[x, y] = 1 + sure
    upper = np.triu(np.ones_like(seen, bool), 1)
    assert np.all(exact[seen == 2] >= 0.95) and np.all(exact[upper & (seen == 0)] < 0.95) and not seen[~upper].any()
    assert 0 < (seen == 1).sum() < 0.01 * upper.sum()


def test_collapse():
    nodes, low = collapse(np.array([5, 9, 2, 8]), np.array([9, 7, 2, 3]))
    assert dict(zip(nodes.tolist(), low.tolist())) == {2: 2, 3: 3, 5: 5, 7: 5, 8: 3, 9: 5}


def test_pipeline_stages(spark):
    """Each stage's decisions take effect, on the documents that the stage before has kept."""
    sf, ws = "/root/testdata/sf0.01", Workspace(spark)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before[name] = {r.doc_id: r for r in docs.collect()}
        docs = ws.save(stage(spark, docs, sf), name)
        assert docs.columns == columns
    mixed = docs.collect()
    left = before["near_duplicates"]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    gone = set(before["toxicity"]) - set(left)
    assert len([i for i in gone if labels.get(i) == 0]) <= 3 and len([i for i in gone if labels.get(i) == 1]) >= 35
    sets = {i: word_sets(r.text, 5) for i, r in left.items()}
    root = roots(sets, linked(sets, 80))
    assert set(before["private_data"]) == {i for i in left if root[i] == i}
    private = before["mixing"]
    assert set(private) == set(before["private_data"]) and all(r.n_chars == len(r.text) for r in private.values())
    copies = {}
    for r in mixed:
        assert r.text == private[r.doc_id].text
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert max(copies.values()) <= 3
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    whole = {}
    for p in pieces:
        whole[p.doc_id] = whole.get(p.doc_id, 0) + p.length
        assert p.offset + p.length <= 1024
    assert whole == {i: c * next(p.doc_tokens for p in pieces if p.doc_id == i) for i, c in copies.items()}
