import json
from zlib import crc32

import numpy as np
import pytest

from wayfold.llm import chat, packing, quality, urls

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"), ("block", "", ""), ("allow", "x.y.z", ""), (None, None, "/")]
URLS = [None, "", "no scheme", "://", "http://NET", "https://a.Example.NET/en/x?q#f", "http://example.net/enx", "ftp://sub.example.com/de/", "http://example.com/DE/", "http://xexample.com/de/", "http://a.org/fr/x", "http://org/fr/", "http://net.com/", "http://example.net?/en/", "a://b://c/d", "http://É.net/ü\n/x", "http://q.x.y.z", "http://" + "a." * 3000 + "net/" + "b/" * 3000]


def judge(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = lambda s, marks: s[: min([len(s), *(s.index(m) for m in marks if m in s)])]
    host = cut(rest, "/?#")
    path = cut(rest[len(host) :], "?#")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in rules if r[1] is not None and (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    best = max(fits, key=lambda r: (len(r[1] + r[2]), len(r[1])), default=None)
    return host, path, best and best[1] + best[2], best[0] if best else "allow"


@pytest.mark.parametrize("array_blocks", [1 << 15, 0])
def test_urls(spark, monkeypatch, array_blocks):
    monkeypatch.setattr(urls, "ARRAY_BLOCKS", array_blocks)
    rules = [r for r in RULES if r[1] != ""]
    more = [("block", f"h{i}.example", "/") for i in range(300)]
    pages = spark.createDataFrame([(i, u, "k", "r") for i, u in enumerate(URLS)] + [(5, URLS[5], "k", "r"), (None, URLS[4], "k", "r")], "page_id long, url string, key string, rule string")
    got = urls.judge(pages, spark.createDataFrame(rules + more, "action string, host string, path string")).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        want = judge(URLS[r.page_id if r.page_id is not None else 4], rules)
        assert (r.host, r.path, r.rule, r.verdict) == want
    none = urls.judge(pages, spark.createDataFrame([], "action string, host string, path string"))
    assert {r.verdict for r in none.collect()} == {"allow"}
    assert urls.judge(pages.limit(0), spark.createDataFrame(rules, "action string, host string, path string")).count() == 0


def test_url_plan_is_native(spark, capsys):
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    urls.judge(pages, spark.createDataFrame(RULES[:4], "action string, host string, path string")).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Cartesian" not in plan


def noisy(n=400):
    rng = np.random.default_rng(6)
    words = ["alpha", "beta", "gamma", "delta", "stone", "river", "cloud", "light"]
    out = []
    for i in range(n):
        body = [str(rng.choice(words)) for _ in range(int(rng.integers(5, 60)))]
        bad = i % 3 == 0
        out.append((i, " ".join(w + "***" if bad and rng.random() < 0.7 else w for w in body), int(not bad)))
    return out


def test_quality_on_held_out_rows(spark, docs):
    rows = noisy()
    df = spark.createDataFrame([(i, t, "s", 0.1) for i, t, _ in rows] + [(9001, None, "s", 0.1), (9002, "", "s", 0.1), (9003, "word " * 20000, "s", 0.1)], "doc_id long, text string, score string, label double")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(0, None), (None, 1), (1, 5), (777777, 1)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.digest(df, labels).collect()}
    assert len(got) == len(rows) + 3 and got[9001].score == got[9002].score
    held = [(got[i].predicted, q) for i, _, q in rows if crc32(str(i).encode()) % 4 == 2]
    assert all(r.held_out == (crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert np.mean([a == b for a, b in held]) > 0.95 and len(held) > 50
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    # labels of held-out rows change nothing
    flipped = labels.withColumn("quality", quality.F.when(quality.held_out(), 1 - quality.F.col("quality")).otherwise(quality.F.col("quality")))
    again = {r.doc_id: r.score for r in quality.digest(df, flipped).collect()}
    assert again == {i: r.score for i, r in got.items()}


def plain_fit(rows, labels, cost=1.0):
    """A dense naive Bayes support vector machine, solved to the end by projected gradients on
    the dual; returns a score function. Same calibration as described: a held quarter."""
    slots = sorted({int(x) for r in rows for x in r})
    place = {s: i for i, s in enumerate(slots)}
    x = np.zeros((len(rows), len(slots)))
    for i, r in enumerate(rows):
        x[i, [place[int(s)] for s in r]] = 1
    y = np.where(np.array(labels) == 1, 1.0, -1.0)

    def solve(x, y):
        p, q = 1 + x[y > 0].sum(0), 1 + x[y < 0].sum(0)
        ratio = np.log((p / ((y > 0).sum() + 2)) / (q / ((y < 0).sum() + 2)))
        z = x * ratio
        z = z / np.maximum(np.linalg.norm(z, axis=1), 1e-300)[:, None]
        k = (z @ z.T + 1) * np.outer(y, y)
        a = np.zeros(len(y))
        for _ in range(4000):
            for i in range(len(y)):
                a[i] = min(max(a[i] - (k[i] @ a - 1) / k[i, i], 0), cost)
            g = k @ a - 1
            if np.abs(np.where((a <= 0) & (g > 0) | (a >= cost) & (g < 0), 0, g)).max() < 1e-6:
                break
        return ratio, (a * y) @ z, float((a * y).sum())

    def margin(model, r):
        ratio, w, bias = model
        own = [place[int(s)] for s in r if int(s) in place]
        norm = np.sqrt((ratio[own] ** 2).sum())
        return (float((w[own] * ratio[own]).sum()) / norm if norm else 0.0) + bias

    return margin, solve(x, y)


def test_quality_equals_a_plain_dense_version():
    rng = np.random.default_rng(12)
    rows, labels = [], []
    for i in range(60):
        good = i % 2
        rows.append(np.unique(np.concatenate([rng.choice(40, 8), 40 + rng.choice(20, 4) + 20 * good * (rng.random() < 0.8)])).astype(np.int32))
        labels.append(good)
    model = quality.fit(rows, np.array(labels), rounds=4000)
    margin, plain = plain_fit(rows, labels)
    a, b = np.array([model.margin(r) for r in rows]), np.array([margin(plain, r) for r in rows])
    assert np.abs(a - b).max() < 0.02 and (np.sign(a) == np.sign(b)).mean() > 0.98
    # few rounds, as in production, stay close
    few = np.array([quality.fit(rows, np.array(labels)).margin(r) for r in rows])
    assert np.corrcoef(few, b)[0, 1] > 0.99


def test_quality_doesnt_vary_with_repeated_ids_and_keeps_its_bytes(spark):
    rows = noisy(120)
    df = spark.createDataFrame([(i % 60, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows[:60]], "doc_id long, quality int")
    one, two = (quality.train(d, labels, label="quality") for d in (df, df.repartition(7).orderBy("text")))
    assert np.array_equal(one.by_slot, two.by_slot) and one.intercept == two.intercept
    assert quality.train(df, labels, label="quality", most=3000).intercept != one.intercept  # fewer rows fit
    assert quality.train(df, labels, label="quality", most=0).score(np.zeros(0, np.int32)) > 0.9  # none does


def test_quality_without_labels_or_rows(spark):
    df = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    no_labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.digest(df, no_labels).first().predicted == 1
    one = spark.createDataFrame([(1, 0)], "doc_id long, quality int")
    assert quality.digest(df, one).first().predicted == 0
    assert quality.digest(df.limit(0), one).count() == 0


def test_coordinate_descent_reaches_the_margin():
    rows = [np.array([k % 2, 5 + k % 3]) for k in range(40)]
    model = quality.fit(rows, np.array([k % 2 for k in range(40)]))
    assert model.score(np.array([1])) > 0.6 > 0.4 > model.score(np.array([0]))


def plain_chat(rows):
    """The same in plain Python, a conversation at a time."""
    parsed, first = [], {}
    for c, t, role, text in rows:
        try:
            body = json.loads(text) if (text or "").lstrip().startswith("{") else None
        except ValueError:
            body = None
        body = body if isinstance(body, dict) else {}
        calls = body.get("tool_calls") if role == "assistant" and isinstance(body.get("tool_calls"), list) else None
        ref = body.get("tool_call_id") if role == "tool" and isinstance(body.get("tool_call_id"), str) else None
        for call in calls or []:
            inner = call.get("function", call) if isinstance(call, dict) else {}
            if isinstance(inner.get("arguments"), str):
                try:
                    inner["arguments"] = json.loads(inner["arguments"])
                except ValueError:
                    pass
        message = body | {"role": role} if calls is not None or ref is not None else {"content": text or "", "role": role or "unknown"}
        parsed.append((c, t, role or "unknown", ref, calls, json.dumps(message, sort_keys=True, separators=(",", ":"), ensure_ascii=False)))
        for k, call in enumerate(calls or []):
            i = call.get("id") if isinstance(call, dict) else None
            if isinstance(i, str) and c is not None and t is not None:
                first[c, i] = min(first.get((c, i), (t, k)), (t, k))
    waits = {}
    for c, t, _, _, calls, _ in parsed:
        for call in calls or []:
            for i in call.get("depends_on", []) if isinstance(call, dict) else []:
                if (c, i) in first and t is not None:
                    waits.setdefault((c, t), set()).add((c, first[c, i][0]))
    place, todo = {}, dict(waits)
    while True:
        ready = {m for m, on in todo.items() if all(x in place or x not in waits for x in on)}
        if not ready:
            break
        for m in ready:
            place[m] = max([(m[1], 0), *((a, d + 2) for a, d in (place.get(x, (x[1], 0)) for x in todo[m]))])
        todo = {m: on for m, on in todo.items() if m not in ready}
    out = []
    for c, t, role, ref, calls, message in parsed:
        at = first.get((c, ref)) if ref is not None and t is not None else None
        m = (c, at[0]) if at else (c, t)
        anchor, depth = place.get(m, (m[1], 0)) if at or calls is not None else (t, 0)
        out.append([c, t, role, None, anchor, depth + bool(at), len(calls or []), at is not None, (c, t) in todo and calls is not None, message, (anchor, depth + bool(at), at[1] + 1 if at else 0, ref is not None, t)])
    for c in {r[0] for r in out} - {None}:
        for k, r in enumerate(sorted((r for r in out if r[0] == c and r[1] is not None), key=lambda r: r[-1]), 1):
            r[3] = k
    return [tuple(r[:-1]) for r in out]


CHAT = [
    (1, 0, "user", 'hi "x"\n'),
    (1, 1, "assistant", '{"content":"ok","tool_calls":[{"id":"a","name":"search","arguments":{"query":"z","limit":3}},{"id":"b","name":"lookup","arguments":{"id":"x"}},{"id":"c","name":"lookup","arguments":{"id":4}}]}'),
    (1, 2, "user", "wait"),
    (1, 3, "tool", '{"tool_call_id":"b","content":"r2"}'),
    (1, 4, "tool", '{"tool_call_id":"a","content":{"z":1.5,"a":[1,"2",null,true]},"name":"search","is_error":false}'),
    (1, 5, "tool", '{"tool_call_id":"zz","content":"none"}'),
    (1, 6, "assistant", '{"tool_calls":[{"id":"a","name":"search","arguments":{"query":"again"}}]}'),
    (1, 9, "tool", '{"tool_call_id":"a","content":7}'),
    (2, 0, None, None),
    (2, 1, "assistant", "{bad json"),
    (2, 2, "assistant", "[1]"),
    (2, 3, "tool", '{"tool_call_id":"late","content":"early"}'),
    (2, 4, "assistant", '{"tool_calls":[{"id":"late","name":"calculate","arguments":{"expression":"1+1","digits":2.5}},{"id":"q","name":"nobody","arguments":{}}]}'),
    (2, 5, "user", "word " * 5000),
    (2, 5, "user", "word " * 5000),
    # arguments as JSON text, below function, and text that is no JSON
    (3, 0, "assistant", '{"content":null,"tool_calls":[{"type":"function","id":"f","function":{"name":"lookup","arguments":"{\\"id\\": 5}"}},{"id":"g","name":"search","arguments":"{not json"},{"id":"g","name":"search","arguments":{"query":"twice"}}],"extra":{"b":1,"a":2}}'),
    (3, 1, "tool", '{"tool_call_id":"g","content":"first of two"}'),
    (3, 2, "tool", '{"tool_call_id":"f","content":1}'),
    # a chain of waiting, a circle, one behind it, and waiting for nobody
    (4, 0, "assistant", '{"tool_calls":[{"id":"w0","name":"lookup","arguments":{"id":1},"depends_on":["w2"]}]}'),
    (4, 1, "tool", '{"tool_call_id":"w0","content":"r0"}'),
    (4, 2, "assistant", '{"tool_calls":[{"id":"w2","name":"lookup","arguments":{"id":1},"depends_on":["w5","w4"]}]}'),
    (4, 3, "tool", '{"tool_call_id":"w2","content":"r2"}'),
    (4, 4, "assistant", '{"tool_calls":[{"id":"w4","name":"lookup","arguments":{"id":1},"depends_on":["nobody"]}]}'),
    (4, 5, "assistant", '{"tool_calls":[{"id":"w5","name":"lookup","arguments":{"id":1},"depends_on":["w4"]}]}'),
    (4, 6, "user", "next"),
    (4, 7, "tool", '{"tool_call_id":"w5","content":"r5"}'),
    (5, 0, "assistant", '{"tool_calls":[{"id":"x","name":"lookup","arguments":{"id":1},"depends_on":["y"]}]}'),
    (5, 1, "assistant", '{"tool_calls":[{"id":"y","name":"lookup","arguments":{"id":1},"depends_on":["x"]}]}'),
    (5, 2, "assistant", '{"tool_calls":[{"id":"z","name":"lookup","arguments":{"id":1},"depends_on":["x"]}, 5]}'),
    (5, 3, "tool", '{"tool_call_id":"y","content":"ry"}'),
    (None, 1, "tool", '{"tool_call_id":"x","content":"no conversation"}'),
    (5, None, "tool", '{"tool_call_id":"x","content":"no turn"}'),
]


@pytest.mark.parametrize("partitions", [1, 6])
def test_chat(spark, partitions):
    df = spark.createDataFrame([(*r, "x", 1) for r in CHAT], "conv_id long, turn long, role string, text string, message string, calls int").repartition(partitions)
    got = chat.format_chat(df).collect()
    names = ("conv_id", "turn", "role", "position", "anchor_turn", "depth", "n_calls", "linked", "cyclic", "message")
    key = lambda r: tuple((x is not None, x) for x in r)
    for a, b in zip(sorted((tuple(r[n] for n in names) for r in got), key=key), sorted(plain_chat(CHAT), key=key), strict=True):
        assert a == b
    assert {(r.conv_id, r.turn): r.n_valid for r in got if r.n_calls} == {(1, 1): 2, (1, 6): 1, (2, 4): 1, (3, 0): 2, **{(4, t): 1 for t in (0, 2, 4, 5)}, (5, 0): 1, (5, 1): 1, (5, 2): 1}
    turns = lambda c: [r.turn for r in sorted((r for r in got if r.conv_id == c and r.position), key=lambda r: r.position)]
    assert turns(1) == [0, 1, 4, 9, 3, 2, 5, 6] and turns(4) == [4, 5, 7, 2, 3, 0, 1, 6]
    assert chat.format_chat(df.limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as p

    rows = noisy(120)
    texts = [(i, t + (" write to a@b.cc" if i == 5 else ""), "en", "s", len(t)) for i, t, _ in rows]
    texts += [(1000, texts[7][1], "en", "s", 1), (1001, None, None, None, None)]
    folder = str(tmp_path)
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (name, stage) in enumerate(p.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k < 3:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    kept = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/2").collect()}
    clean = {i for i, _, q in rows if q}
    assert len(clean & set(kept)) >= 0.95 * len(clean) and len(set(kept) - clean - {1001}) <= 4 and 1000 not in kept
    assert all("a@b.cc" not in (t or "") for t in kept.values())
    assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} == set(kept)
    assert p.run(spark, folder).count() == docs.count()
    assert packing.LENGTH >= docs.agg({"length": "max"}).first()[0]


def _waiting(spark, waits, conv=7):
    """Messages by turn, each with one call, waiting for the calls of other turns."""
    import json

    rows = [(conv, t, "assistant", json.dumps({"tool_calls": [{"id": f"c{t}", "name": "lookup", "arguments": {"id": t}, "depends_on": [f"c{f}" for f in fs]}]})) for t, fs in waits.items()]
    return spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")


def _plain_places(waits):
    """(anchor, depth, cyclic) of each turn, one after the other."""
    def circle(t, path):
        return t in path or any(circle(f, path | {t}) for f in waits.get(t, ()) if f in waits)

    held = {}

    def place(t):
        if t not in held:
            held[t] = max([(t, 0), *((a, d + 2) for a, d in (place(f) for f in waits[t] if f in waits))])
        return held[t]

    cyclic = {t: circle(t, frozenset()) for t in waits} if len(waits) < 100 else dict.fromkeys(waits, False)
    return {t: (t, 0, True) if cyclic[t] else (*place(t), False) for t in sorted(waits)}


def test_chat_places_of_any_graph(spark):
    import random

    r = random.Random(3)
    for _ in range(3):
        waits = {t: sorted({r.randrange(24) for _ in range(r.choice([0, 1, 1, 1, 2]))}) for t in range(24)}
        got = {x.turn: (x.anchor_turn, x.depth, x.cyclic) for x in chat.format_chat(_waiting(spark, waits)).collect()}
        assert got == _plain_places(waits)
    circle = {0: [2], 1: [0], 2: [1], 3: [2], 4: [3], 5: [], 6: [5]}
    got = {x.turn: (x.anchor_turn, x.depth, x.cyclic) for x in chat.format_chat(_waiting(spark, circle)).collect()}
    assert got == _plain_places(circle)


def test_chat_chain_of_a_thousand(spark):
    import time

    from wayfold.llm import common

    waits = {t: [t + 1] if t < 999 else [] for t in range(1000)}
    common.clear(spark)
    start = time.time()
    got = {x.turn: (x.anchor_turn, x.depth) for x in chat.format_chat(_waiting(spark, waits)).collect()}
    assert time.time() - start < 60
    assert got == {t: (999, 2 * (999 - t)) for t in waits}
    assert common.clear(spark) <= 5
