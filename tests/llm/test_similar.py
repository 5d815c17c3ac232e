import numpy as np
import pytest
import xxhash

from wayfold.llm.common import components
from wayfold.llm import common, embed_dedup, simhash, topk


def brute_print(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    count = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for i in range(64):
            count[i] += h >> i & 1
    return sum((2 * c > len(shingles)) << i for i, c in enumerate(count))


def groups(links):
    f = simhash.Forest(len(links))
    f.join(*np.nonzero(links))
    return f.find(np.arange(len(links)))


def test_fingerprints_and_groups(spark, docs, texts, no_docs):
    more = [t.replace("of", "off", 1) for t in texts[6:8]]
    rows = docs.select("doc_id", "text").collect() + [(1000 + i, t) for i, t in enumerate(more)]
    df = spark.createDataFrame([tuple(r) for r in rows], "doc_id long, text string").where("doc_id is not null")
    rows = [r for r in rows if r[0] is not None]
    prints = np.array([brute_print(r[1]) for r in rows], np.uint64)
    root = groups(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4)
    least = {}
    for k, r in zip(root, rows):
        least[k] = min(r[0], least.get(k, r[0]))
    want = {r[0]: (f"{p:016x}", least[k]) for r, p, k in zip(rows, prints.tolist(), root)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.digest(df).collect()} == want
    assert simhash.digest(no_docs).count() == 0


def test_one_of_each(spark, docs, texts, no_docs):
    twice = docs.unionByName(docs.where("doc_id = 9"))
    kept = simhash.one_of_each(twice)
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert kept.columns == docs.columns and len(ids) == len(set(ids))
    assert None in ids and 0 in ids and not {1, 2, 3} & set(ids)  # null and blank texts are one group
    assert simhash.one_of_each(no_docs).count() == 0


@pytest.mark.parametrize("depth", [0, 1, 3, 5])
def test_shards_lose_no_link(depth):
    rng = np.random.default_rng(depth)
    base = rng.integers(0, 1 << 63, 700, dtype=np.uint64)
    near = base[rng.integers(0, 700, 500)]
    for _ in range(3):
        near = near ^ (np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64))
    fps = np.unique(np.concatenate([base, near, base[0] ^ np.arange(256, dtype=np.uint64)]))
    want = groups(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4)
    tree = simhash.Tree(fps[::5], depth)
    idx, shard, visits = tree.route(fps)
    at, forest = {x: i for i, x in enumerate(fps.tolist())}, simhash.Forest(len(fps))
    for s in range(2**depth):
        u, v = simhash.join_shard(fps[idx[(shard == s) & ~visits]], fps[idx[(shard == s) & visits]])
        forest.join(np.array([at[x] for x in u.tolist()], int), np.array([at[x] for x in v.tolist()], int))
    assert np.count_nonzero(~visits) == len(fps)
    assert (forest.find(np.arange(len(fps))) == want).all()


def test_components_of_a_long_path_and_a_star(spark):
    rows = [(i, i + 1) for i in range(0, 60)] + [(1000, i) for i in range(1001, 1200)] + [(5, 5), (7, 6)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(rows, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 1000 for i in range(1000, 1200)}}
    assert common.components(spark.createDataFrame([], "u long, v long")).count() == 0


def vectors(n=260, d=12):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, d))
    x = centres[rng.integers(0, 12, n)] + rng.normal(size=(n, d)) * rng.choice([0.05, 0.3, 1.0], (n, 1))
    x[10:14] = x[9]
    return x.astype(np.float32)


def frame(spark, x):
    odd = [(9001, None), (9002, []), (9003, [0.0] * 12), (9004, [float("nan")] * 12), (9005, [None] + [1.0] * 11), (9006, [float("inf")] * 12), (9007, [1.0, 2.0]), (9008, [2.0, 4.0])]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + odd
    return spark.createDataFrame([(*r, 3, 4, 5) for r in rows], "vec_id long, embedding array<float>, id long, n long, pair long")


@pytest.mark.parametrize("tile", [4096, 40])
def test_embedding_groups(spark, tile):
    x = vectors()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    links = u @ u.T >= 0.9
    np.fill_diagonal(links, False)
    root = groups(links)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.group(frame(spark, x), tile=tile).collect()}
    for i in range(len(x)):
        assert got[i] == (links[i].sum(), root[i], root[i] == i)
    assert got[9007] == (1, 9007, True) and got[9008] == (1, 9007, False)
    assert all(got[i] == (0, i, True) for i in range(9001, 9007))
    assert embed_dedup.group(frame(spark, x).limit(0)).count() == 0


def test_embedding_ids_of_any_kind(spark):
    """Null, int and string ids, and one id on different vectors."""
    a, b, c, d = [1.0, 0.0, 0.1], [0.0, 1.0, 0.0], [1.0, 0.0, 0.2], [0.0, 0.0, -1.0]
    for kind, name in (("int", int), ("string", str), ("bigint", int)):
        rows = [(name(1), a), (name(1), b), (name(2), c), (name(3), b), (None, d), (None, a), (None, None), (name(4), None)]
        df = spark.createDataFrame([(*r, "x") for r in rows], f"vec_id {kind}, embedding array<double>, h1 string")
        got = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in embed_dedup.group(df).collect())
        want = [("1", 2, "1", True), ("1", 1, "1", True), ("2", 2, "1", False), ("3", 1, "1", False), ("None", 0, "None", True), ("None", 2, "1", False), ("None", 0, "None", True), ("4", 0, "4", True)]
        assert got == sorted(want), kind


def test_embeddings_of_very_many_lengths(spark):
    """More lengths than any list of them should hold: links only within a length, none lost."""
    rng = np.random.default_rng(8)
    rows = []
    for width in range(1, 1101):
        x = rng.normal(size=width)
        rows += [(2 * width, x.tolist()), (2 * width + 1, (x * 3).tolist())]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.group(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {i: (1, i - i % 2) for i, _ in rows}


def test_tiles_far_apart_are_left_out():
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(16, 24))
    x = np.repeat(centres, 60, axis=0) + rng.normal(size=(960, 24)) * 0.05
    x /= np.linalg.norm(x, axis=1)[:, None]
    t = embed_dedup.Tiles(x, 4)
    at = t.tile(x @ t.basis)
    own = [x[at == k] @ t.basis for k in range(16)]
    t.low, t.high = (np.array([f(r) if len(r) else np.full(24, e) for r in own]) for f, e in ((lambda r: r.min(0), np.inf), (lambda r: r.max(0), -np.inf)))
    pairs = {(k, o) for k in range(16) for o in t.partners(k, embed_dedup.reach_of(0.9)).tolist()}
    assert len(pairs) < 80
    for i, j in np.argwhere(x @ x.T >= 0.9):
        assert (at[i], at[j]) in pairs


@pytest.mark.parametrize("rows", [8192, 37])
def test_top_k(spark, rows):
    x = vectors()
    df = frame(spark, x).where("vec_id < 9007")
    df = df.unionByName(df.where("vec_id = 20"))  # a query that stands twice
    v = np.floor(1024 * x.astype(float)).astype(np.int64)
    got = {}
    for r in topk.top_k(df, df.where("vec_id % 20 = 0"), k=10, rows=rows).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    every = [*range(len(x)), 20]
    zero = {9003: 0}
    for q in range(0, len(x), 20):
        found = [(i, int(v[i] @ v[q])) for i in every if i != q] + [(i, 0) for i in zero]
        want = sorted(found, key=lambda t: (-t[1], t[0]))[:10]
        assert sorted(got[q]) == [(k + 1, *t) for k, t in enumerate(want)]
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0
    few = df.where("vec_id < 3")
    assert topk.top_k(few, few.where("vec_id = 0")).count() == 2


def test_top_k_without_ids_and_beyond_64_bits(spark):
    rows = [(None, [9.0, 9.0]), (0, [1.0, 1.0]), (1, [1.0]), (2, [-1.0, 2.0]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df, df, k=2, scale=1)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()) == [(0, 1, 1, 1), (0, 2, 2, 1), (1, 1, 0, 1), (1, 2, 2, -1), (2, 1, 0, 1), (2, 2, 1, -1)]
    assert got.schema["score"].dataType.simpleString() == "bigint"
    rows = [(0, [3e38, 1.0]), (1, [2.0, -1.0]), (2, [-3e38, 7.0]), (3, [1.0, 1.0]), (4, [1e300, 0.0]), (5, [-5.0, 2.0])]
    large = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    exact = {i: [int(x) for x in v] for i, v in rows}
    found = topk.top_k(large, large, k=3, scale=1).collect()
    for q in exact:
        scores = sorted(((sum(a * b for a, b in zip(exact[q], v)), -i) for i, v in exact.items() if i != q), reverse=True)[:3]
        want = [(-i, s if -(2**63) <= s < 2**63 else None) for s, i in scores]
        assert [(r.vec_id, r.score) for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == q] == want
    assert None in {r.score for r in found}
    wide = spark.createDataFrame([(0, [2.0**29 + 1]), (1, [2.0**30 + 1])], "vec_id long, embedding array<double>")
    assert {r.score for r in topk.top_k(wide, wide, scale=1).collect()} == {(2**29 + 1) * (2**30 + 1)}


def test_lists_stop_early_and_stay_exact():
    rng = np.random.default_rng(1)
    for spread in (1, np.array([500, 60, 1, 1, 1, 1])):  # even dimensions, and two that carry the scores
        rows = (rng.integers(-9, 10, (2000, 6)) * spread).astype(float)
        lists = topk.Lists(np.arange(2000), rows)
        asked = np.arange(0, 2000, 25)
        for q in asked:
            ids, scores = lists.top(q, rows[q], 10)
            s = rows @ rows[q]
            want = sorted((i for i in range(2000) if i != q), key=lambda i: (-s[i], i))[:10]
            assert ids.tolist() == want and scores.tolist() == s[want].tolist()
        assert 0 < lists.read[0] <= lists.read[1]
    assert lists.read[0] < 0.6 * lists.read[1]  # reading stopped where the scores allow it


def test_cuts_can_be_cleared(spark, docs):
    import os

    frame_ = common.cut(docs.select("doc_id"), "probe")
    path = frame_._wayfold_path
    assert frame_.count() == docs.count() and os.path.isdir(path)
    assert common.clear(spark) > 0 and not os.path.exists(path) and common.clear(spark) == 0


def test_large_shards_are_compared_in_blocks(spark, monkeypatch):
    """Tiny shards, a shallow tree and few samples: bounded groups and every link."""
    r = np.random.default_rng(8)
    fps = np.unique(r.integers(0, 1 << 63, 900, dtype=np.uint64))
    near = fps[:300] ^ (np.uint64(1) << r.integers(0, 64, 300).astype(np.uint64))
    fps = np.unique(np.concatenate([fps, near, near ^ np.uint64(7)]))
    classes = spark.createDataFrame([(int(i), int(f)) for i, f in enumerate(fps.view(np.int64))], "least long, fp long").repartition(3)
    want = {frozenset((int(i), int(j))) for i, j in zip(*np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4)) if i < j}
    monkeypatch.setattr(simhash, "SHARD", 50), monkeypatch.setattr(simhash, "DEPTH", 2), monkeypatch.setattr(simhash, "SAMPLE", 40)
    found = simhash.links(classes).collect()
    forest = simhash.Forest(len(fps))
    forest.join(np.array([x.u.least for x in found]), np.array([x.v.least for x in found]))
    whole = simhash.Forest(len(fps))
    whole.join(np.array([min(p) for p in want]), np.array([max(p) for p in want]))
    every = np.arange(len(fps))
    assert (forest.find(every) == whole.find(every)).all()


def test_large_tiles_are_compared_in_blocks(spark, monkeypatch):
    x = vectors()
    df = frame(spark, x)
    want = sorted(map(tuple, embed_dedup.group(df).collect()), key=repr)
    monkeypatch.setattr(embed_dedup, "DEPTH", 1)
    for tile in (20, 64):
        assert sorted(map(tuple, embed_dedup.group(df, tile=tile).collect()), key=repr) == want


def test_components_end_when_all_are_stars(spark):
    """Paths, circles, stars, loops, repeats and no edges, against a plain union of sets."""
    rng = np.random.default_rng(7)
    edges = [(k, k + 1) for k in range(100, 140)] + [(200, k) for k in range(201, 230)] + [(300, 301), (301, 302), (302, 300), (5, 5), (300, 301)]
    edges += [tuple(x) for x in rng.integers(1000, 1200, (120, 2)).tolist()]
    root = {x: x for e in edges for x in e}
    for _ in root:
        for u, v in edges:
            root[u] = root[v] = min(root[u], root[v])
    want = {x: r for x, r in root.items() if any(x in e and e[0] != e[1] for e in edges)}
    got = components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r.node: r.root for r in got} == want and len(got) == len(want)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_edges_are_joined_inside_tasks_before_any_round(spark, monkeypatch):
    """A chain, a star and a circle of which one task has all edges: one frame of edges is written."""
    written = []
    monkeypatch.setattr(common, "cut", lambda df, name="cut", f=common.cut: written.append(name) or f(df, name))
    edges = [(i, i + 1) for i in range(100, 140)] + [(200, 201 + i) for i in range(30)] + [(300 + i, 300 + (i + 1) % 9) for i in range(9)]
    node = lambda x: (x % 2 == 0, str(x) if x % 3 else None, x)
    kind = "struct<none:boolean,least:string,fp:long>"
    rows = [(node(a), node(b)) for a, b in edges]
    got = {r.node.fp: r.root.fp for r in common.components(spark.createDataFrame(rows, f"u {kind}, v {kind}").coalesce(1)).collect()}
    order = lambda x: (node(x)[0], node(x)[1] is not None, node(x)[1] or "", x)
    want = {x: min(group, key=order) for group in (range(100, 141), range(200, 231), range(300, 309)) for x in group}
    assert got == want
    assert written == ["edges"]


@pytest.mark.parametrize("rows", [3, 1 << 20])
def test_forests_connect_what_their_edges_connect(spark, rows):
    pairs = np.random.default_rng(3).integers(0, 400, (260, 2))
    edges = spark.createDataFrame(pairs.tolist(), "u long, v long").repartition(5)
    got = common.forests(edges, rows).collect()
    assert len(got) <= len(pairs)
    def roots(edges):
        f = simhash.Forest(400)
        f.join(*np.array(edges, np.int64).reshape(-1, 2).T)
        return f.find(np.arange(400)).tolist()
    assert roots([tuple(r) for r in got]) == roots(pairs)


def test_null_and_nan_nodes_are_not_one():
    """Ranks of Arrow give both the same."""
    t = common.pa.table({"u": [None, float("nan")], "v": [1.0, 2.0]})
    assert common._joined(t).num_rows == 2
    assert len({common._places(common.pa.array([None, float("nan"), 1.0]))[k] for k in range(3)}) == 3
