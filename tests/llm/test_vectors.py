"""Operators 11, 12 and 13 against brute force on small tables."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from epispark.llm.exact_topk import exact_topk
from epispark.llm.periodic_runs import periodic_runs
from epispark.llm.queries import QUERIES, repeated_tails
from epispark.llm.vector_codes import vector_codes

SMOKE = "/root/testdata/sf0.001"


# --- 11: periodic runs -----------------------------------------------------

def all_runs(words, least=4, short=6):
    """(start, length, period) of every run, by comparing at every lag."""
    found = []
    for q in range(1, len(words) // least + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            n = j - i + q
            if j > i and n >= max(short, least * q) and not any(s <= i and s + m >= i + n for s, m, _ in found):
                found.append((i, n, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def run_texts(seed, n=120):
    """Texts of repeated units, words between them, and odd cases."""
    rnd = random.Random(seed)
    vocab = ["a", "b", "é", "dd", "日本"]
    texts = []
    for _ in range(n):
        words = []
        for _ in range(rnd.randint(0, 6)):
            if rnd.random() < 0.6:
                unit = [rnd.choice(vocab) for _ in range(rnd.randint(1, 7))]
                words += [unit[i % len(unit)] for i in range(rnd.randint(1, 40))]
            else:
                words += [rnd.choice(vocab[:rnd.randint(2, 5)] + ["z1", "z2"]) for _ in range(rnd.randint(0, 10))]
        texts.append("".join(w + rnd.choice([" ", "  ", "\n", "\t\x0b"]) for w in words))
    return texts + [None, "", " \n", texts[0], "x " * 5, "x " * 6, " ".join(f"w{i % 700}" for i in range(5000)), "α β γ δ " * 3 + "α β γ"]


def test_periodic_runs_against_every_lag(spark):
    texts = run_texts(5)
    rows = [(i if i % 9 else None, t, "x", [1], "y") for i, t in enumerate(texts)] + [(3, texts[3], "x", [1], "y")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string, collapsed array<int>, n_words string")
    got = periodic_runs(df).collect()
    assert len(got) == len(rows)
    want = []
    for i, t, *_ in rows:
        words = (t or "").split()
        runs = all_runs(words)
        want.append((i, len(words), tuple(runs), collapsed(words, runs)))
    assert sorted(want, key=str) == sorted(((r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in got), key=str)
    assert sum(len(w[2]) for w in want) > 100


def test_periodic_runs_other_limits_and_empty_table(spark):
    texts = run_texts(6, 40)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in periodic_runs(df, least_repeats=3, shortest=9).collect():
        words = (texts[r.doc_id] or "").split()
        assert [tuple(x) for x in r.runs] == all_runs(words, 3, 9)
    assert periodic_runs(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        periodic_runs(df, least_repeats=2)


def test_repeated_tails_and_query_columns(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.choice([None, "", " ", " ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 90)))])) for i in range(300)] + [(None, "a b"), (-7, "p q r s " * 9)]
    got = {r.doc_id: r.text for r in repeated_tails(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    planted = 0
    for i, t in rows:
        words = (t or "").split()
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            assert got[i].split() == [words[j] if j < a else words[a + (j - a) % p] for j in range(n)]
            planted += 1
        else:
            assert got[i] == t
    assert planted > 5


def test_op11_query_on_a_given_table(spark):
    got = QUERIES["op11_periodic_runs"](spark, SMOKE).collect()
    texts = {r.doc_id: r.text for r in repeated_tails(spark.read.parquet(f"{SMOKE}/documents.parquet")).collect()}
    assert len(got) == len(texts)
    for r in got:
        words = (texts[r.doc_id] or "").split()
        if len(words) > 1500:
            continue  # the lag by lag comparison is quadratic
        runs = all_runs(words)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()


# --- 12 and 13: integer vectors -------------------------------------------

VECTORS = "vec_id long, embedding array<double>, label int, _v string, score string, tile int"


def ints(v):
    if v is None or any(x is None or not math.isfinite(x) for x in v):
        return None
    return [math.floor(256 * x) for x in v]


def vector_rows(seed, n=260, dim=32):
    """Vectors with copies, nulls, odd lengths and components, large ones,
    repeated rows and null ids."""
    rnd = random.Random(seed)
    rows = [[i, [rnd.uniform(-1, 1) for _ in range(dim)], rnd.choice([None, 1, 2, 3])] for i in range(n)]
    same = rows[7][1]
    for i in range(100, 190):  # a third are copies
        rows[i][1] = same
    rows[20][1], rows[21][1], rows[22][1] = None, [None] + same[1:], [float("nan")] + same[1:]
    rows[23][1], rows[24][1], rows[25][1], rows[26][1] = [float("inf")] + same[1:], [0.0] * dim, [], same[:dim // 2]
    rows[27][1], rows[28][1], rows[29][1] = [1e300] + same[1:], [8e6] + same[1:], [-8e6] + same[1:]
    rows += [list(rows[50]), list(rows[50]), [None, same, 3], [None, None, None], [-50, same, None]]
    return [(*r, "v", "s", 1) for r in rows]


def fits(v):
    return v is not None and all(abs(x) < 1 << 31 for x in v)


@pytest.mark.parametrize("k", [5, 400])
def test_exact_topk_against_all_products(spark, k):
    rows = vector_rows(3)
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    got = exact_topk(df, F.col("vec_id") % 50 == 0, k=k, block_tiles=1, fan=2).collect()
    held = [(r[0], ints(r[1])) for r in rows if r[0] is not None and fits(ints(r[1]))]
    want = []
    for i, q in held:
        if i % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in held if j != i and len(v) == len(q))
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored[:k])]
    assert sorted(map(tuple, got)) == sorted(want)


def test_exact_topk_of_many_small_tiles(spark, monkeypatch):
    """The merge over several blocks, tiles and levels gives the same rows."""
    from epispark.llm import exact_topk as module
    df = spark.createDataFrame(vector_rows(4), VECTORS).repartition(6)
    want = sorted(map(tuple, exact_topk(df, F.col("vec_id") % 20 == 0).collect()))
    made = module.tiles
    # Nine partitions make nine tiles, and as many blocks of queries.
    monkeypatch.setattr(module, "tiles", lambda rows, per_block=1: made(rows.repartition(9), 1))
    assert sorted(map(tuple, exact_topk(df, F.col("vec_id") % 20 == 0, fan=2).collect())) == want


def test_exact_topk_of_extreme_components(spark):
    big = float((1 << 31) - 1) / 256
    rows = [(0, [big] * 3), (1, [big] * 3), (2, [-big] * 3), (3, [2.0 ** 40] * 3), (4, [big, 0.0, -0.001])]
    got = exact_topk(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()
    m = (1 << 31) - 1
    assert [(r.rank, r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 1, (1 << 63) - 1), (2, 4, m * m - m), (3, 2, -(1 << 63))]


def test_vectors_of_empty_tables(spark):
    for rows in ([], [(1, None, None), (None, None, 1)]):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
        assert exact_topk(df, F.col("vec_id") % 50 == 0).collect() == []
        assert vector_codes(df).collect() == []


def lloyd(rows, parts, entries, rounds):
    """Codes, errors and final codebooks of (id, ints, label) rows, one by one."""
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    dim = len(rows[0][1]) // parts
    cut = lambda v, p: v[p * dim:(p + 1) * dim]
    books = [[cut(r[1], p) for r in order[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for _, v, _ in rows:
                members.setdefault(near(cut(v, p), books[p])[1], []).append(cut(v, p))
            books[p] = [[sum(x) // len(x) for x in zip(*members[e])] if e in members else c for e, c in enumerate(books[p])]
    out = []
    for i, v, label in rows:
        found = [near(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), label))
    return out, ",".join(str(x) for book in books for c in book for x in c)


@pytest.mark.parametrize("owner_rows,parts,entries,rounds", [(20_000, 16, 64, 2), (30, 4, 9, 3), (1000, 8, 400, 1)])
def test_vector_codes_against_plain_lloyd(spark, owner_rows, parts, entries, rounds):
    rows = vector_rows(8)
    got = vector_codes(spark.createDataFrame(rows, VECTORS).repartition(4), parts=parts, entries=entries, rounds=rounds, owner_rows=owner_rows).collect()
    held = [(r[0], ints(r[1]), r[2]) for r in rows if fits(ints(r[1])) and len(r[1]) == 32]
    want, books = lloyd(held, parts, entries, rounds)
    total = {}
    for _, _, error, label in want:
        total[label] = total.get(label, 0) + error
    width = 2 if entries <= 256 else 3
    if width == 2:
        assert sorted(map(str, got)) == sorted(f"Row(vec_id={i}, code='{c}', error={e}, label_error={total[label]}, codebooks='{books}')" for i, c, e, label in want)
    else:
        assert sorted((r.vec_id or 0, r.error, r.label_error) for r in got) == sorted((i or 0, e, total[label]) for i, _, e, label in want)


def test_op12_and_op13_on_a_given_table(spark):
    table = [(r.vec_id, ints(r.embedding), r.label) for r in spark.read.parquet(f"{SMOKE}/embeddings.parquet").collect()]
    got = sorted(map(tuple, QUERIES["op12_exact_topk"](spark, SMOKE).collect()))
    held = np.array([v for _, v, _ in table], dtype=np.int64)
    want = []
    for i, q, _ in table:
        if i % 50 == 0:
            scored = sorted((-int(s), j) for s, (j, _, _) in zip(held @ np.array(q), table) if j != i)
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored[:5])]
    assert got == sorted(want)
    codes, books = lloyd(table, 16, 64, 2)
    total = {}
    for _, _, error, label in codes:
        total[label] = total.get(label, 0) + error
    digest = hashlib.sha256(books.encode()).hexdigest()
    assert sorted(map(tuple, QUERIES["op13_vector_codes"](spark, SMOKE).collect())) == sorted((i, c, e, total[label], digest) for i, c, e, label in codes)
