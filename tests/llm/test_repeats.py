"""op3 and op9 against looking at every window."""

import random

import pytest
from pyspark.sql import functions as F

from quire.llm import exchange as X
from quire.llm import repeats as R
from quire.llm import suffix_array as A
from quire.llm import suffix_tree as S

SCHEMA = "doc_id long, text string"


def _documents():
    rnd = random.Random(7)
    words = [f"w{i}é" for i in range(60)]
    line = " ".join(rnd.choice(words) for _ in range(50))
    rows = [(None, line), (1, None), (2, ""), (2, "a"), (3, "x" * 400), (5, "ab" * 300), (4, "ab" * 300)]
    for i in range(60):
        body = " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 160)))
        if i % 3 == 0:
            body = f"{body} {line} {body[:40]}"
        rows.append((100 - i, body))
    rows += [(7, rows[-1][1]), (rows[-1][0], rows[-1][1]), (8, "  " + line + "\n\t" + line.replace(" ", "  "))]
    return rows


def _as_tuples(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def _array(spark, rows, **options):
    from pyspark.sql import functions as F

    found = A.suffix_array_dedup(spark.createDataFrame(rows, SCHEMA).coalesce(1), **options)
    return found.select("id", "n_bytes", "n_removed", F.size("spans").alias("n"), F.sha2("kept", 256))


def _tree(spark, rows, **options):
    from pyspark.sql import functions as F

    found = S.substring_dedup(spark.createDataFrame(rows, SCHEMA).coalesce(1), **options)
    return found.select("doc_id", "dedup_n_words", "dedup_n_removed", F.sha2(F.col("dedup_kept").cast("binary"), 256))


@pytest.mark.parametrize("hot", [1, 64])
@pytest.mark.parametrize("chunk", [3_000, 2_000_000])
def test_against_brute_force(spark, monkeypatch, hot, chunk):
    monkeypatch.setattr(X, "CHUNK_BYTES", chunk)
    rows = _documents()
    assert _as_tuples(_array(spark, rows, hot_chunks=hot)) == sorted(A.brute_force(rows), key=repr)
    assert _as_tuples(_tree(spark, rows, hot_chunks=hot)) == sorted(S.brute_force(rows), key=repr)


def test_hot_anchors_in_workers(spark):
    """Many chunks hold one line, so its windows are dealt one by one."""
    import numpy as np
    import pyarrow as pa

    line = bytes(range(40, 120))
    spec = R.Repeats("bytes", 50, 24, True)
    texts = [f"{i:060d}".encode() + line + f"{i * 7919:055d}".encode() for i in range(6)]
    batch = pa.RecordBatch.from_pydict({"id": pa.array(range(6), pa.int64()), "text": pa.array([t.decode() for t in texts])})
    raw, at = X.text_buffer(batch.column("text"))
    _, length, _, _, keys, _, _, _ = R._run_keys(spec, raw, at, 40)
    assert length.sum() == sum(len(t) - 49 for t in texts)
    hot = R.suffixes(spec, batch, {0: X.pack(np.full(len(keys), 2, np.uint8))}, 40, "text", "id")
    assert set(hot.length) == {1} and hot.hot.all()
    calm = R.suffixes(spec, batch, {0: X.pack(np.full(len(keys), 1, np.uint8))}, 40, "text", "id")
    assert calm.length.max() > 1


def test_windows_have_one_anchor(monkeypatch):
    import numpy as np

    monkeypatch.setattr(R, "SLICE", 700)

    rnd = random.Random(3)
    raw = np.frombuffer(bytes(rnd.choice(b"ab") for _ in range(3000)), np.uint8)
    at = np.array([0, 10, 10, 700, 760, 3000])
    spec = R.Repeats("bytes", 50, 24, True)
    first, length, h, off = spec.runs(raw, at)
    windows = {}
    for f, n, a, o in zip(first, length, h, off):
        for j in range(n):
            assert f + j not in windows
            windows[f + j] = (raw[f + j : f + j + 50].tobytes(), o - j)
            assert 0 <= o - j <= 26
    assert sorted(windows) == [i for a, b in zip(at[:-1], at[1:]) for i in range(a, b - 49)]
    by_content = {}
    for content, place in windows.values():
        assert by_content.setdefault(content, place) == place


def _thue_morse(n):
    """n bytes and their complement: strings that polynomial hashes modulo a power of two can't tell apart."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [512, 1024, 4096])
def test_words_that_polynomials_confuse(spark, n):
    one, other = _thue_morse(n)
    words = [f"x{i}" for i in range(34)]
    rows = [(1, " ".join([*words, one])), (2, " ".join([*words, other])), (3, " ".join([one, *words])), (4, " ".join([one, *words]))]
    assert _as_tuples(_tree(spark, rows)) == sorted(S.brute_force(rows), key=repr)
    assert _as_tuples(_array(spark, rows)) == sorted(A.brute_force(rows), key=repr)
    swapped = [(1, " ".join(one if w == "a" else other for w in one[:n])), (2, " ".join(one if w == "a" else other for w in other[:n]))] if n == 512 else []
    assert _as_tuples(_tree(spark, swapped)) == sorted(S.brute_force(swapped), key=repr)


def test_word_hashes_tell_words_apart():
    import numpy as np

    rnd = random.Random(5)
    words = list({bytes(rnd.choice(b"ab\0") for _ in range(rnd.choice([1, 2, 7, 8, 9, 16, 17, 511, 512, 513, 3000]))) for _ in range(3000)})
    ends = np.cumsum([len(w) for w in words])
    raw = np.frombuffer(b"".join(words), np.uint8)
    hashes = R.word_hashes(raw, ends - [len(w) for w in words], ends)
    assert len(set(hashes.tolist())) == len(words)
    alone = [int(R.word_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0]) for w in words[:200]]
    assert alone == hashes[:200].tolist()


def test_chunks_grow_with_the_text(spark, monkeypatch):
    monkeypatch.setattr(X, "CHUNK_BYTES", 2_000)
    monkeypatch.setattr(X, "BUCKET_BYTES", 2_000)
    rows = _documents()
    small = X.make_chunks(spark.createDataFrame(rows, SCHEMA).coalesce(1))
    monkeypatch.setattr(X, "GROWS_FROM", small[2] // 9)
    large = X.make_chunks(spark.createDataFrame(rows, SCHEMA).coalesce(1))
    assert X.times(small[2]) == 3 and large[2] == small[2] and 2 * large[1] < small[1]
    assert sum(X.bytes_batch(r["data"]).num_rows for r in large[0].collect()) == len(rows)
    assert _as_tuples(_array(spark, rows)) == sorted(A.brute_force(rows), key=repr)


def test_empty_table_and_clashing_names(spark):
    assert _as_tuples(_array(spark, [])) == []
    assert _as_tuples(_tree(spark, [])) == []
    df = spark.createDataFrame([(1, "a b", 2, "z", "q")], "doc_id long, text string, chunk_id int, data string, c0 string")
    found = S.substring_dedup(df)
    assert found.columns[:5] == df.columns
    assert found.first()[:5] == (1, "a b", 2, "z", "q")


def test_no_repeats_at_all(spark):
    rows = [(i, f"{i} " * 3) for i in range(5)]
    assert _as_tuples(_array(spark, rows)) == sorted(A.brute_force(rows), key=repr)


def test_multikey_sorts(spark):
    import numpy as np

    rnd = np.random.default_rng(1)
    cols = rnd.integers(0, 3, (500, 5)).astype(np.uint64)
    order, common = R.multikey(cols)
    rows = [tuple(r) for r in cols[order]]
    assert rows == sorted(rows)
    for i in range(1, len(rows)):
        n = next((k for k in range(5) if rows[i][k] != rows[i - 1][k]), 5)
        assert common[i] == n


def test_very_long_texts(spark):
    """Longer than a chunk and than a slice of one."""
    rnd = random.Random(11)
    long = " ".join(f"{rnd.randrange(1 << 30):x}" for _ in range(330_000))
    assert len(long) > X.CHUNK_BYTES
    rows = [(5, long), (2, "x " + long), (9, "short")]
    found = {r[0]: tuple(r[1:3]) for r in _array(spark, rows).collect()}
    assert found == {2: (len(long) + 2, 0), 5: (len(long), len(long)), 9: (5, 0)}
    found = {r[0]: tuple(r[1:3]) for r in _tree(spark, rows).collect()}
    assert found == {2: (330_001, 330_000), 5: (330_000, 330_000), 9: (1, 0)}


def test_shuffle_files_go_with_their_action(spark):
    counted = spark.range(100).groupBy((F.col("id") % 7).alias("k")).count()
    mode = lambda df: df._jdf.queryExecution().shuffleCleanupMode().toString()
    assert mode(X.once(counted)).startswith("RemoveShuffleFiles") and mode(counted).startswith("DoNotCleanup")
    assert spark.conf.get(X.CLEANUP, None) is None
    assert X.checkpoint(counted).count() == counted.count() == 7
