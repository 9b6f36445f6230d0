"""op1, op4, op8 and the pipeline against brute force and on edge cases."""

import random

import numpy as np
import pyarrow as pa
import pytest
import tiktoken

from quire.llm import components, embedding_dedup, order_minhash, string_tiling


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def test_alignment_is_the_edit_distance():
    rnd = random.Random(1)
    for _ in range(300):
        a = [rnd.randint(0, 5) for _ in range(rnd.randint(0, 30))]
        b = [x for x in a if rnd.random() > 0.1]
        for _ in range(rnd.randint(0, 4)):
            b.insert(rnd.randint(0, len(b)), rnd.randint(0, 5))
        x, y = np.array(a, np.uint64), np.array(b, np.uint64)
        longest = max(len(a), len(b))
        d = _edits(a, b)
        got = order_minhash.aligned(x, y, 0.7)
        if longest and d <= int(0.3 * longest + 1e-9):
            assert got == pytest.approx(1 - d / longest)
        elif longest:
            assert got is None
        if len(a) and len(b):
            assert order_minhash.chained(x, y, order_minhash.shingles(x), order_minhash.shingles(y)) >= d


def _families(seed=4, families=12):
    rnd = random.Random(seed)
    words = [f"t{i}" for i in range(400)]
    rows, i = [], 0
    for f in range(families):
        base = [rnd.choice(words) for _ in range(rnd.randint(60, 200))]
        for c in range(rnd.randint(1, 6)):
            copy = list(base)
            for _ in range(c):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            rows.append((i, " ".join(copy), f))
            i += 1
    return rows


def test_near_duplicates(spark):
    rows = _families()
    extra = [(900, None, -1), (901, "", -2), (902, "  ", -3), (None, rows[0][1], -4), (903, "one two", -5), (904, "one two", -5), (905, "One TWO", -5), (906, "one three", -6), (rows[0][0], rows[0][1], rows[0][2])]
    df = spark.createDataFrame([(a, b) for a, b, _ in rows + extra], "doc_id long, text string")
    found = order_minhash.near_duplicates(df).collect()
    assert len(found) == len(rows) + len(extra)
    least = {}
    for i, _, f in rows + extra:
        if i is not None:
            least[f] = min(least.get(f, i), i)
    by_id = {r["id"]: r for r in found}
    for i, _, f in rows + extra:
        if i is not None:
            assert by_id[i]["class_id"] == least[f], (i, f)
            assert by_id[i]["kept"] == (i == least[f])
    assert by_id[None]["class_id"] is None and by_id[None]["n_links"] == 0 and by_id[None]["kept"]
    assert order_minhash.near_duplicates(df.limit(0)).collect() == []


def test_members_of_one_band_that_differ(spark):
    """A passage that many texts share brings them together, but doesn't make them copies."""
    rnd = random.Random(8)
    words = [f"u{i}" for i in range(3000)]
    shared = " ".join(rnd.choice(words) for _ in range(60))
    rows = [(i, " ".join(rnd.choice(words) for _ in range(60)) + " " + shared + " " + " ".join(rnd.choice(words) for _ in range(60))) for i in range(40)]
    rows += [(100 + i, rows[i][1] + " more") for i in range(10)]
    found = {r["id"]: r["class_id"] for r in order_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(found[i] == i for i in range(40)) and all(found[100 + i] == i for i in range(10))


def test_copies_that_share_any_band_are_one_class(spark):
    """Whether or not they are like the hub of their group, or share further bands."""
    rnd = random.Random(9)
    texts = []
    for f in range(250):
        now = [f"f{f}w{i}" for i in range(100)]
        for c in range(5):  # each is like the next only
            texts.append(" ".join(now))
            now[15 * c : 15 * c + 15] = [f"f{f}c{c}w{i}" for i in range(15)]
    rnd.shuffle(texts)
    found = {r["id"]: r["class_id"] for r in order_minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    _, t, first, _, _ = order_minhash.text_words(pa.array(texts))
    bands = order_minhash.sketches(t, first)
    groups = {}
    for i in range(len(texts)):
        for at, sketch in enumerate(bands[i].tolist()):
            groups.setdefault((at, sketch), []).append(i)
    words = [t[first[i] : first[i + 1]] for i in range(len(texts))]
    pairs = {(i, j) for g in groups.values() for i in g for j in g if i < j}
    like = [(i, j) for i, j in pairs if order_minhash.alike(words[i], words[j], order_minhash.SIMILARITY)]
    assert len(like) > 500 and [(i, j) for i, j in like if found[i] != found[j]] == []


def test_recall_against_all_pairs(spark):
    """Of pairs that are copies by the operator's own criterion, at edit similarities from 0.98 down to 0.82, nearly all are linked."""
    rnd = random.Random(21)
    rates = [(60, 1), (60, 4), (60, 6), (60, 9), (200, 20), (200, 36)]
    rows = []
    for size, edits in rates:
        for _ in range(100):
            words = [f"w{rnd.randrange(10**6)}" for _ in range(size)]
            other = list(words)
            for at in rnd.sample(range(size), edits):
                other[at] = f"x{rnd.randrange(10**6)}"
            rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(other))]
    found = {r["id"]: r["class_id"] for r in order_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k in range(len(rates)):
        assert sum(found[i + 1] == i for i in range(200 * k, 200 * k + 200, 2)) >= 95, rates[k]
    assert all(found[i] == i for i in range(0, len(rows), 2))


def test_words_that_polynomials_confuse(spark):
    bits = [bin(i).count("1") % 2 for i in range(4096)]
    one, other = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
    found = {r["id"]: r["class_id"] for r in order_minhash.near_duplicates(spark.createDataFrame([(1, one), (2, other)], "doc_id long, text string")).collect()}
    assert found == {1: 1, 2: 2}
    item, doc = [(1, f"v w x y {one}")], [(1, f"v w x y {one}"), (2, f"v w x y {other}")]
    got = string_tiling.decontaminate(spark.createDataFrame(doc, "doc_id long, text string"), spark.createDataFrame(item, "item_id long, text string")).collect()
    assert {r["doc_id"]: r["leak_contaminated"] for r in got} == {1: True, 2: False}


def _scattered(rate, n, seed, size=200):
    rng = np.random.default_rng(seed)
    for _ in range(n):
        a = rng.integers(1, 2**62, size).astype(np.uint64)
        b = a.copy()
        at = rng.choice(size, round(rate * size), replace=False)
        b[at] = rng.integers(1, 2**62, len(at)).astype(np.uint64)
        yield a, b


@pytest.mark.parametrize("rate,least", [(0.1, 0.99), (0.15, 0.97), (0.2, 0.95)])
def test_near_copies_down_to_the_threshold_meet(rate, least):
    pairs = list(_scattered(rate, 400, 11))
    t = np.concatenate([x for p in pairs for x in p])
    found = order_minhash.sketches(t, np.arange(0, len(t) + 1, 200))
    assert (found[::2] == found[1::2]).any(axis=1).mean() >= least
    assert all(order_minhash.alike(a, b, 0.8) for a, b in pairs)
    assert not any(order_minhash.alike(a, b, 0.8) for a, b in _scattered(0.21, 50, 12))


def test_alike_is_the_edit_similarity():
    rnd = random.Random(13)
    for _ in range(300):
        a = [rnd.randint(0, 40) for _ in range(rnd.randint(1, 40))]
        b = [x for x in a if rnd.random() > 0.08] or [1]
        for _ in range(rnd.randint(0, 6)):
            b[rnd.randrange(len(b))] = rnd.randint(0, 40)
        longest = max(len(a), len(b))
        x, y = np.array(a, np.uint64), np.array(b, np.uint64)
        assert order_minhash.alike(x, y, 0.8) == (_edits(a, b) <= int(0.2 * longest + 1e-9)), (a, b)


def test_components(spark):
    rnd = random.Random(3)
    edges = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(150)] + [(i, i + 1) for i in range(400, 480)] + [(1000, i) for i in range(1001, 1100)] + [(7, 7)]
    parent = {x: x for e in edges if e[0] != e[1] for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    found = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in found} == {x: root(x) for x in parent} and len(found) == len(parent)
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_embeddings(spark):
    rnd = np.random.default_rng(0)
    base = rnd.normal(size=(40, 16))
    rows, i = [], 0
    for b in base:
        for _ in range(rnd.integers(1, 5)):
            rows.append((i, (b + rnd.normal(size=16) * rnd.choice([0, 0.05, 0.25])).tolist()))
            i += 1
    rows += [(900, None), (901, [0.0] * 16), (902, [1.0] * 15 + [float("nan")]), (903, [1.0, None] + [0.0] * 14), (904, []), (905, [1.0, 2.0]), (906, [2.0, 4.0]), (907, rows[0][1]), (None, rows[0][1])]
    good = [(k, np.array(v)) for k, v in rows if k is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    links = {k: [] for k, _ in good}
    for a, (k, x) in enumerate(good):
        for m, y in good[a + 1 :]:
            if len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.95:
                links[k].append(m)
                links[m].append(k)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for tile, pivots in ((2048, 64), (7, 5), (16, 1)):
        found = {r["id"]: r for r in embedding_dedup.embedding_dedup(df, tile=tile, pivots=pivots).collect()}
        assert len(found) == len(rows)
        for k, own in links.items():
            seen, todo = {k}, [k]
            while todo:
                for m in links[todo.pop()]:
                    if m not in seen:
                        seen.add(m)
                        todo.append(m)
            assert (found[k]["n_links"], found[k]["component_id"], found[k]["kept"]) == (len(own), min(seen), min(seen) == k), k
        for k in (900, 901, 902, 903, 904):
            assert (found[k]["n_links"], found[k]["component_id"], found[k]["kept"]) == (0, k, True)
    assert embedding_dedup.embedding_dedup(df.limit(0)).collect() == []


def test_vectors_of_one_id_and_of_any_length(spark, monkeypatch):
    big = float(np.finfo("f8").max) / 4
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.1]), (3, [0.1, 1.0]), (1, [1.0, 0.0])]
    df = lambda r: spark.createDataFrame(r, "vec_id long, embedding array<double>")
    found = sorted((r["id"], r["n_links"], r["component_id"]) for r in embedding_dedup.embedding_dedup(df(rows)).collect())
    assert found == [(1, 1, 1), (1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1)]
    twice = embedding_dedup.embedding_dedup(df([(5, [1.0, 2.0]), (5, [1.0, 2.0])])).collect()
    assert [(r["n_links"], r["component_id"], r["kept"]) for r in twice] == [(0, 5, True)] * 2
    far = [[1e200, 0.0], [2e200, 1e190], [0.0, 1e-200, 0.0], [0.0, 2e-200, 0.0], [0.0, 0.0, 0.0, 5e-324], [0.0, 0.0, 0.0, big]]
    assert [r["n_links"] for r in embedding_dedup.embedding_dedup(df(list(enumerate(far)))).collect()] == [1] * 6
    # blocks of few tiles find what one block does
    rnd = np.random.default_rng(3)
    rows = [(i, (rnd.normal(size=8) + 2).tolist()) for i in range(200)]
    want = sorted(map(tuple, embedding_dedup.embedding_dedup(df(rows)).collect()))
    monkeypatch.setattr(embedding_dedup, "BLOCK_BYTES", 16 * 8 * 40 * 2)
    assert sorted(map(tuple, embedding_dedup.embedding_dedup(df(rows), tile=40, pivots=2).collect())) == want
    # many dimensions without pivots
    rows = [(10 * n + k, [float(k < 2)] + [1.0] * n) for n in range(1, 6) for k in range(3)]
    got = {r["id"]: r["n_links"] for r in embedding_dedup.embedding_dedup(df(rows), pivots=1).collect()}
    assert all(got[10 * n] >= 1 and got[10 * n + 1] == got[10 * n] for n in range(1, 6))


def test_quantisation_bound():
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(200, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q, scale, length, error = embedding_dedup.quantise(x)
    near = (q.astype(float) @ q.T.astype(float)) * scale[:, None] * scale[None, :]
    bound = error[:, None] * (length + error)[None, :] + error[None, :] * length[:, None]
    assert (np.abs(x @ x.T - near) <= bound + 1e-12).all()


def _slow_tiles(item, doc, least):
    """Greedy string tiling by looking at every pair of places."""
    mi, md, tiles = [False] * len(item), [False] * len(doc), []
    while True:
        best = None
        for d in range(len(doc)):
            for i in range(len(item)):
                k = 0
                while i + k < len(item) and d + k < len(doc) and item[i + k] == doc[d + k] and not mi[i + k] and not md[d + k]:
                    k += 1
                if k >= least and (best is None or k > best[0]):
                    best = (k, i, d)
        if best is None:
            return tiles
        tiles.append(best)
        for x in range(best[0]):
            mi[best[1] + x] = md[best[2] + x] = True


def test_tiles_are_greedy():
    rnd = random.Random(6)
    for _ in range(100):
        item = [rnd.randint(0, 4) for _ in range(rnd.randint(0, 25))]
        doc = [rnd.randint(0, 4) for _ in range(rnd.randint(0, 40))]
        a, b = string_tiling.greedy_tiles(item, doc, 3), _slow_tiles(item, doc, 3)
        assert sorted(x[0] for x in a) == sorted(x[0] for x in b)


def test_decontamination(spark, monkeypatch):
    rnd = random.Random(9)
    words = [f"v{i}" for i in range(800)]
    items = [(i, " ".join(rnd.choice(words) for _ in range(40))) for i in range(20)]
    other = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    w = items[3][1].split()
    moved = " ".join(w[20:] + ["and", "so"] + w[:20]).upper().replace(" ", ", ")
    rows = [(1, other(300)), (2, f"{other(50)} {items[0][1]} {other(90)}"), (3, f"{other(30)}\n{moved}"), (4, " ".join(w[:10]) + " " + other(100)), (5, None), (6, ""), (7, items[1][1] + " " + items[2][1]), (7, items[1][1] + " " + items[2][1]), (None, items[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("found", string_tiling.F.lit("x"))
    bench = spark.createDataFrame(items + [(50, None), (51, ""), (52, "too few"), (None, other(30)), (0, items[0][1])], "item_id long, text string")
    for size in (string_tiling.BLOCK_BYTES, 500):
        monkeypatch.setattr(string_tiling, "BLOCK_BYTES", size)
        found = string_tiling.decontaminate(df, bench).collect()
        got = sorted(((r["doc_id"], r["leak_contaminated"], r["leak_item_id"]) for r in found), key=repr)
        assert got == sorted([(1, False, None), (2, True, 0), (3, True, 3), (4, False, None), (5, False, None), (6, False, None), (7, True, 1), (7, True, 1), (None, True, 0)], key=repr)
        assert all(r["found"] == "x" for r in found)
    assert string_tiling.decontaminate(df, bench.limit(0)).where("leak_contaminated").isEmpty()
    assert string_tiling.decontaminate(df.limit(0), bench).collect() == []


def test_pipeline(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["language_id", "near_dedup", "substring_dedup", "decontamination", "bpe_encoding"]
    sf = "/root/testdata/sf0.001"
    found = P.run(spark, sf).collect()
    ids = [r["doc_id"] for r in found]
    assert len(set(ids)) == len(ids) and 100 < len(ids) < docs.count()
    assert all(r["decoded_text"] == r["text"] for r in found) and all(len(r["token_ids"]) == 4 * r["n_tokens"] for r in found)
    for _, stage in P.STAGES[:-1]:
        empty = stage(spark, docs.limit(0), sf)
        assert empty.columns == list(P.COLUMNS) and empty.collect() == []
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0)], docs.schema)
    for name, stage in P.STAGES:
        kept = stage(spark, odd, sf).collect()
        assert len(kept) == (0 if name == "language_id" else 2)


def test_pipeline_against_brute_force(spark, tmp_path):
    """Documents whose fate in each stage is known, and the stages' brute-force versions."""
    import corpus_pipeline as P
    from quire.llm import bpe_tree, suffix_tree

    rnd = random.Random(12)
    english = "the of and to in is that it was for on are as with his they at be this from have or by one had not but what all were when we there can an your which".split()
    german = "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch".split()
    other = lambda words, n: " ".join(rnd.choice(words) + rnd.choice(["", "", "s", "en", str(rnd.randrange(99))]) for _ in range(n))
    rows = []
    for i in range(60):
        rows.append([i, other(english if i % 3 else german, rnd.randint(60, 140)), "en" if i % 3 else "de", "s", 0])
    passage = other(english, 45)
    for i in (4, 7, 10):
        rows[i][1] += " " + passage
    items = [(k, other(english, 30)) for k in range(4)]
    rows[13][1] += " " + items[2][1]
    families = {0: 100, 1: 101, 13: 102}
    for old, new in families.items():
        words = rows[old][1].split()
        words[len(words) // 2] = "changed"
        rows.append([new, " ".join(words), rows[old][2], "s", 0])
    rows += [[200, None, None, None, None], [201, "", "en", "s", 0], [202, "12 34 !?", "en", "s", 0], [3, rows[3][1], "de", "s", 0]]
    docs = spark.createDataFrame([tuple(r) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = [(r[0], r[1]) for r in rows[:60]]  # no letters: rejected; copies and the repeated row: one stays
    slow = {r[0]: r for r in suffix_tree.brute_force(kept)}
    found = {r["doc_id"]: r for r in P.run(spark, str(tmp_path)).collect()}
    assert sorted(found) == [i for i, _ in kept if i != 13]
    path, pattern = bpe_tree.default_vocabulary()
    with open(path, "rb") as f:
        library = tiktoken.Encoding("library", pat_str=pattern, mergeable_ranks=bpe_tree.encoder(f.read(), pattern).ranks, special_tokens={})
    for i, text in kept:
        if i == 13:
            continue
        want = text if not slow[i][2] else text.replace(" " + passage, "")
        assert found[i]["text"] == want == found[i]["decoded_text"]
        assert np.frombuffer(found[i]["token_ids"], "<u4").tolist() == library.encode_ordinary(want)
    assert [i for i in slow if slow[i][2]] == [4, 7, 10]
