"""Whitening, Merkle manifest and Jaccard join beside plain loops, and on odd rows."""

import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from barframe.llm import jaccard, manifest, queries, whitening
from barframe.llm.common import fold

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, node string, rank string, g string"
ODD = [
    (1, "the same text of some words here and there", "en", "a", 5),
    (2, "the same text of some words here and there", "en", "a", 5),
    (2, "the same text of some words here and there", "en", "a", 5),
    (2, "another text", "en", "a", 5),
    (3, None, None, None, None),
    (4, "", "en", "a", 0),
    (5, " \n\t ", "", "b", 3),
    (None, "the same text of some words here and there", "en", None, 1),
    (None, None, None, None, None),
    (None, None, None, None, None),
    (6, "Mot é ünd 漢字 <|endoftext|> \x85 x" * 3, "fr", "b", 9),
    (7, "long " * 30000, "en", "c", 150000),
    (8, "x" * 300000, "en", "c", 300000),
    (-8, "one", "en", "a", 3),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "w", "x", "y", "z") for r in ODD], SCHEMA)


# --- whitening --------------------------------------------------------------


def test_whitening_beside_numpy(spark):
    rows = [r for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    x = np.array([[np.floor(64.0 * float(c)) + 1_000_000 for c in r["embedding"]] for r in rows])
    n, total = len(x), x.sum(axis=0)
    e, u = np.linalg.eigh(np.cov(x.T, bias=True))
    e, u = e[::-1][:32], u[:, ::-1][:, :32]
    want = (x - total / n) @ u / np.sqrt(e)
    got = defaultdict(dict)
    for r in queries.op11_whitening(spark, SF).collect():
        got[r["vec_id"]][r["component"]] = r
    assert set(got) == {r["vec_id"] for r in rows}
    signs = np.sign([got[rows[0]["vec_id"]][k]["whitened"] * want[0, k - 1] for k in range(1, 33)])
    for i, r in enumerate(rows):
        mine = got[r["vec_id"]]
        assert sorted(mine) == list(range(1, 33))
        assert np.allclose([mine[k]["whitened"] for k in range(1, 33)] * signs, want[i], atol=1e-6)
        one = mine[1]
        assert one["n"] == n and one["deviation"] == int(((n * x[i] - total) ** 2).sum()) and one["identity_error"] < 1e-9
    explained = [got[rows[0]["vec_id"]][k]["explained"] for k in range(1, 33)]
    assert np.allclose(explained, e / np.trace(np.cov(x.T, bias=True)), rtol=1e-9)


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(3)
    fine = [[float(v) for v in rng.normal(size=3)] for _ in range(20)]
    fine = [[a, b, c, a] for a, b, c in fine]  # a dimension twice: one component less
    odd = [None, [], [1.0, None, 2.0, 3.0], [float("nan"), 0.0, 0.0, 0.0], [float("inf"), 0.0, 0.0, 0.0], [1e30, 0.0, 0.0, 0.0], [1.0, 2.0]]
    rows = [(i, v, "x") for i, v in enumerate(fine)] + [(100 + i, v, "x") for i, v in enumerate(odd)] + [(None, fine[0], "y"), (0, fine[0], "z")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id string")
    out = whitening.whiten(df).collect()
    assert Counter(r["id"] for r in out) == Counter({**{i: 3 for i in range(1, 20)}, 0: 6, None: 3})
    assert all(r["n"] == 22 and r["identity_error"] < 1e-9 for r in out)
    assert whitening.whiten(df.limit(0)).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(4)], "vec_id long, embedding array<float>")
    assert whitening.whiten(same).count() == 0
    with pytest.raises(ValueError):
        whitening.learn(whitening.usable(df), max_dims=3)


def test_factor_and_rotation():
    a = np.random.default_rng(1).normal(size=(300, 7))
    v = np.cov(np.concatenate([a, a[:, :2]], axis=1).T)
    factor = whitening.cholesky(v)
    assert factor.shape == (9, 7) and np.allclose(factor @ factor.T, v)
    values, components = whitening.jacobi(factor)
    assert np.allclose(values, np.linalg.eigvalsh(v)[::-1][:7]) and np.allclose(components.T @ components, np.eye(7))
    wide = whitening.Whitening(2**40, np.array([0]), np.array([1]), np.empty(0), np.empty((1, 0)), 0.0)
    assert [int(d) for d in wide.deviations(np.array([[5]]))] == [(5 * 2**40 - 1) ** 2]


# --- manifest ---------------------------------------------------------------


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(r, more=0):
    n = None if r["n_chars"] is None else r["n_chars"] + more
    values = [r["doc_id"], r["source"], r["lang"], n, r["text"]]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(nodes):
    """Top, and for each node its siblings with whether they stand left."""
    paths, place = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, path in enumerate(paths):
            other = place[i] ^ 1
            path.append((nodes[other] if other < len(nodes) else "", other < place[i]))
            place[i] >>= 1
        nodes = [h(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
    return nodes[0], paths


@pytest.mark.parametrize("bits", [10, 2])
def test_manifest_beside_loops(spark, bits):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted(docs.collect(), key=lambda r: r["doc_id"])
    by = defaultdict(list)
    for r in rows:
        by[r["lang"]].append(r)
    langs = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    sub = {g: tree([leaf_of(r) for r in by[g]]) for g in langs}
    root, top = tree([sub[g][0] for g in langs])
    want = {}
    for k, g in enumerate(langs):
        for r, path in zip(by[g], sub[g][1]):
            node = leaf_of(r, zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0)
            for sibling, left in path + top[k]:
                node = h(sibling, node) if left else h(node, sibling)
            want[r["doc_id"]] = (leaf_of(r), sub[g][0], root, h(*[s for s, _ in path + top[k]]), node, node == root)
    if bits == 10:
        got = queries.op12_manifest(spark, SF).collect()
    else:
        got = manifest.manifest(docs, tampered={"n_chars": F.col("n_chars") + 1}, where=fold(7) == 0, bits=bits).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == want and 0 < sum(not v[-1] for v in want.values()) < len(want)


def test_manifest_of_odd_rows(spark, odd):
    def made(df):
        return sorted(manifest.manifest(df, bits=2).collect(), key=str)

    out = made(odd)
    assert Counter((r["id"], r["leaf"]) for r in out) == Counter(
        (r[0], leaf_of(dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r)))) for r in ODD
    )
    assert all(r["verified"] for r in out) and len({r["root"] for r in out}) == 1
    # null ids first, then ids, equal ones by a hash of the leaf: the same root whatever the order of the rows
    assert made(odd.repartition(5, "text")) == out
    english = [r for r in ODD if r[2] == "en"]
    leaves = [leaf_of(dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r))) for r in sorted(english, key=lambda r: (r[0] is not None, r[0] or 0))]
    roots = {r["subroot"] for r in out if r["leaf"] == leaves[0]}
    at = [i for i, r in enumerate(sorted(english, key=lambda r: (r[0] is not None, r[0] or 0))) if r[0] == 2]
    same = [leaves[i] for i in at]
    orders = [[*leaves[: at[0]], *order, *leaves[at[-1] + 1 :]] for order in ([same[0], same[1], same[2]], [same[2], same[0], same[1]])]
    assert roots <= {tree(o)[0] for o in orders}
    assert made(odd.limit(0)) == []
    one = made(odd.where("doc_id = 7"))
    assert len(one) == 1 and one[0]["root"] == one[0]["leaf"] == one[0]["subroot"] and one[0]["proof_sha256"] == h("")


# --- jaccard join -----------------------------------------------------------


def slow_components(texts):
    """(id, text) rows to (id, set size, smallest id reachable), by all pairs that share a shingle."""
    sets = []
    for _, text in texts:
        words = [w for w in re.split(r"[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set()))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = defaultdict(list)
    for k, s in enumerate(sets):
        for token in s:
            holders[token].append(k)
    for a, b in {(a, b) for ks in holders.values() for i, a in enumerate(ks) for b in ks[i + 1 :]}:
        shared = len(sets[a] & sets[b])
        if 100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared):
            root[find(a)] = find(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(texts):
        least[find(k)].append(i)
    return Counter((i, len(sets[k]), min((x for x in least[find(k)] if x is not None), default=None)) for k, (i, _) in enumerate(texts))


def joined(df, **settings):
    return Counter(tuple(r) for r in jaccard.near_sets(df, rules=jaccard.Settings(**settings)).collect())


def test_jaccard_join(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert Counter(tuple(r) for r in queries.op13_ngram_join(spark, SF).collect()) == slow_components(texts)


def families():
    """Texts with zero to six words changed, some of shared passages, at lengths around the bounds."""
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(3000)]

    def words(n):
        return [vocabulary[int(k)] for k in rng.integers(0, 3000, n)]

    passage, texts = words(60), []
    for n, copies in ((6, 6), (9, 8), (25, 40), (60, 60), (150, 60), (400, 25)):
        base = words(n)
        for _ in range(copies):
            text = list(base)
            for at in rng.integers(0, n, int(rng.integers(0, 7)) if n > 9 else int(rng.integers(0, 2))):
                text[int(at)] = words(1)[0]
            texts.append(text)
    for _ in range(60):
        texts.append(words(int(rng.integers(0, 40))) + passage[: int(rng.integers(30, 61))] + words(int(rng.integers(0, 40))))
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("settings", [{}, {"rare": 2, "long": 40}, {"rare": 4, "long": 10**6, "most_frequent": 50}])
def test_families_lose_no_link(spark, settings):
    texts = families()
    want = slow_components(texts)
    assert 20 < len({c for _, _, c in want}) < len(texts)
    assert joined(spark.createDataFrame(texts, "doc_id long, text string"), **settings) == want


def test_jaccard_of_odd_rows(spark, odd):
    want = slow_components([r[:2] for r in ODD])
    # sets without words are linked with nothing, not even with each other
    assert joined(odd) == joined(odd, rare=1) == want
    assert sum(joined(odd.limit(0)).values()) == 0


def test_sets_in_pieces_and_batches():
    texts = [t.encode() for _, t in families()] + [b"", b" ", b"One  two\tthree\x0bfour five\x0csix\r", "漢字 \x85 é  x A b".encode(), b"y" * 5000]
    small, large = list(jaccard.TokenSets(5, 50).of(texts)), list(jaccard.TokenSets(5).of(texts))
    assert len(small) == len(texts) and all((a == b).all() and len(a) == len(b) for a, b in zip(small, large))
    assert (jaccard.tokens("ONE two three four five six") == jaccard.tokens("one two three\nfour five six")).all()
    assert len(np.intersect1d(jaccard.tokens("ab c d e f"), jaccard.tokens("a bc d e f"))) == 0
    assert [len(s) for s in large[-5:]] == [0, 0, 2, 2, 1]


def test_later_links_join_components(spark):
    """Chains joined by later links, new nodes and links within a component, beside all links counted at once."""
    from barframe.llm.common import components

    old = spark.createDataFrame([(9, 8), (8, 7), (5, 4), (3, 2)], "a long, b long")
    new = spark.createDataFrame([(9, 5), (7, 9), (20, 21), (21, 3), (30, 31)], "a long, b long")
    got = {r.node: r.root for r in jaccard.joined_roots(components(old), new).collect()}
    assert got == {r.node: r.root for r in components(old.union(new)).collect()} and got[9] == 4 and got[20] == 2 and got[31] == 30


def test_crowded_rest_writes_only_keys_of_several_components(spark, monkeypatch):
    """Of 500 rows under keys of one component and 2 under a key of two, only the latter and their key are written again."""
    rows = [(k, 10 + i, 1, 10, 1) for k in range(50) for i in range(10)] + [(99, 10, 1, 10, 1), (99, 70, 1, 10, 1)]
    shared = spark.createDataFrame(rows, "key long, node long, at long, c_node long, c_at long")
    roots = spark.createDataFrame([(10 + i, 10) for i in range(10)], "node long, root long")
    written, write = [], jaccard.checkpointed

    def counting(df):
        out = write(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "checkpointed", counting)
    rules = jaccard.Settings()
    monkeypatch.setattr(jaccard.Settings, "possible", lambda *_: F.lit(True))
    assert [tuple(r) for r in jaccard.crowded_rest(shared, roots, rules).collect()] == [(10, 70)]
    assert sum(written) == 3


def test_few_edges_lie_in_few_partitions(spark, monkeypatch):
    """Components of a long path, a star and a loop by rounds of few partitions and, with none counted as few, by exchanges."""
    from barframe.llm import common

    edges = [(k, k + 1) for k in range(100, 140)] + [(200, 200 + k) for k in range(1, 30)] + [(5, 6), (6, 7), (7, 5), (9, 9)]
    links = spark.createDataFrame(edges, "a long, b long").repartition(23)
    parts, write = [], common.checkpointed

    def counting(df):
        out = write(df)
        parts.append(out.rdd.getNumPartitions())
        return out

    monkeypatch.setattr(common, "checkpointed", counting)
    want = {n: 100 for n in range(100, 141)} | {200 + k: 200 for k in range(30)} | {5: 5, 6: 5, 7: 5}
    assert {r.node: r.root for r in common.components(links).collect()} == want
    assert len(parts) > 2 and max(parts[1:]) == 1
    monkeypatch.setattr(common, "FEW_EDGES", -1)
    assert {r.node: r.root for r in common.components(links).collect()} == want
