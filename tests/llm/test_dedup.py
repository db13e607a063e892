"""Operators 1, 3, 9 and 10 against brute force on small tables."""

import hashlib
import random
import tempfile

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from epispark.llm.line_dedup import line_dedup, within_edits
from epispark.llm.queries import QUERIES
from epispark.llm.simhash_dedup import links, simhash_groups
from epispark.llm.substring_dedup import substring_dedup
from epispark.llm.suffix_dedup import suffix_dedup, suffix_groups

SMOKE = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, _t string, _id string, _shard int, a int, h int"


def table(spark, rows):
    """Documents with extra columns whose names clash with internal ones."""
    return spark.createDataFrame([(i, t, "x", "y", 1, 2, 3) for i, t in rows], DOCS)


def sample_texts(seed, words, n=60, spaces=(" ", "  ", "\n", "\t ")):
    """Texts that share passages, with copies, nulls, empties and repeats."""
    rnd = random.Random(seed)
    vocab = ["a", "be", "sé", "dog", "été", "x1", "The", "of", "日本", "k"]
    passages = [[rnd.choice(vocab) for _ in range(rnd.randint(words, 3 * words))] for _ in range(5)]
    rows = []
    for i in range(n):
        body = [rnd.choice(vocab) for _ in range(rnd.randint(0, words))] + rnd.choice([[], rnd.choice(passages)]) + [rnd.choice(vocab) for _ in range(rnd.randint(0, words))]
        rows.append((i, "".join(w + rnd.choice(spaces) for w in body)))
    rows += [(100, rows[3][1]), (101, rows[3][1]), (3, rows[3][1]), (102, None), (103, ""), (104, " \n\t "), (None, rows[3][1]), (None, None),
             (105, "word " * 400), (5, "be " * 90)]
    return rows


def gone_by_window(items, windows, size, i):
    hit = np.zeros(len(items), bool)
    for k in range(len(items) - size + 1):
        if i is not None and windows.get(tuple(items[k:k + size]), i) < i:
            hit[k:k + size] = True
    return hit


def first_starts(rows, cut, size):
    first = {}
    for i, t in rows:
        items = cut(t)
        for k in range(len(items) - size + 1):
            w = tuple(items[k:k + size])
            if i is not None:
                first[w] = min(first.get(w, i), i)
    return first


@pytest.mark.parametrize("shard_bytes", [700, 1 << 20])
def test_substring_dedup(spark, shard_bytes):
    rows = sample_texts(1, 12)
    cut = lambda t: (t or "").encode().split()
    first = first_starts(rows, cut, 10)
    want = []
    for i, t in rows:
        hit = gone_by_window(cut(t), first, 10, i)
        want.append((i, len(hit), int(hit.sum()), b" ".join(w for w, h in zip(cut(t), hit) if not h).decode()))
    got = substring_dedup(table(spark, rows), window=10, shard_bytes=shard_bytes).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=key) == sorted(want, key=key)
    for r in got:
        assert sum(int(b) - int(a) for a, b in (s.split(":") for s in r.spans.split(",") if s)) == r.n_removed


@pytest.mark.parametrize("shard_bytes, split_above", [(500, 10**6), (500, 3), (1 << 20, 10**6)])
def test_suffix_dedup(spark, shard_bytes, split_above):
    rows = sample_texts(2, 12)
    cut = lambda t: (t or "").encode()
    first = first_starts(rows, cut, 24)
    want = []
    for i, t in rows:
        hit = gone_by_window(cut(t), first, 24, i)
        runs = int((np.diff(np.r_[0, hit.astype(int)]) == 1).sum())
        want.append((i, len(hit), int(hit.sum()), runs, hashlib.sha256(bytes(b for b, h in zip(cut(t), hit) if not h)).hexdigest()))
    got = suffix_dedup(table(spark, rows), size=24, shard_bytes=shard_bytes, split_above=split_above)
    got = got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_suffix_order_is_the_order_of_the_strings():
    rnd = np.random.default_rng(4)
    raw = rnd.choice(np.frombuffer(b"ab", np.uint8), 900)
    order, rank = suffix_groups(raw, np.full(900, 900), 20)
    strings = [raw[p:p + 20].tobytes() for p in order]
    assert strings == sorted(strings) and len(strings) == 881
    assert [a == b for a, b in zip(strings, strings[1:])] == (rank[1:] == rank[:-1]).tolist()


def simhash(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [b" ".join(words[i:i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    counts = [sum(xxhash.xxh64_intdigest(g, 42) >> b & 1 for g in grams) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(grams))


def test_simhash_groups(spark):
    rnd = random.Random(5)
    rows = sample_texts(3, 8)
    base = "the quick brown fox jumps over a lazy dog and runs far away from the old red barn " * 12
    for i in range(200, 260):
        words = base.split()
        words[rnd.randrange(len(words))] = rnd.choice(["cat", "hen"])
        rows.append((i, " ".join(words)))
    prints = [simhash(t) for _, t in rows]
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    distinct = sorted(set(prints))
    pairs = {(a, b) for a in distinct for b in distinct if a < b and bin(a ^ b).count("1") <= 2}
    assert pairs, "the sample has links"
    for a, b in pairs:
        root[find(a)] = find(b)
    least = {}
    for (i, _), p in zip(rows, prints):
        if i is not None:
            least[find(p)] = min(least.get(find(p), i), i)
    got = simhash_groups(table(spark, rows)).collect()
    want = [(i, f"{p:016x}", least.get(find(p))) for (i, _), p in zip(rows, prints)]
    key = lambda r: (r[0] is None, r[0] or 0, r[1], str(r[2]))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("bits", [0, 1, 2, 3])
def test_links_find_every_pair(spark, bits):
    rnd = random.Random(bits)
    prints = {rnd.getrandbits(64) for _ in range(30)}
    for p in list(prints):
        for n in range(1, 5):
            prints.add(p ^ sum(1 << b for b in rnd.sample(range(64), n)))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = {frozenset((r.a, r.b)) for r in links(spark.createDataFrame([(p,) for p in signed], "fp long"), bits).collect()}
    want = {frozenset((a, b)) for a in signed for b in signed if a != b and bin((a ^ b) & (2**64 - 1)).count("1") <= bits}
    assert got == want


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("edits", [0, 1, 2])
def test_line_dedup(spark, edits):
    rnd = random.Random(7 + edits)
    base = ["".join(rnd.choice("abcé ") for _ in range(rnd.randint(7, 14))) for _ in range(25)]
    rows = []
    for i in range(90):
        lines = []
        for _ in range(rnd.randint(0, 4)):
            line = list(rnd.choice(base))
            for _ in range(rnd.choice([0, 0, 1, 2, 3])):
                k = rnd.randrange(len(line))
                line[k:k + rnd.randint(0, 1)] = rnd.choice(["", "a", "é"])
            lines.append("".join(line))
        rows.append((i, "\n".join(lines)))
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, rows[4][1]), (204, "\n".join([base[0]] * 50)), (5, rows[5][1]), (None, rows[6][1] + "\nno other line is like this")]
    inf = 1 << 62
    occur = [(inf if i is None else i, n, x.encode()) for i, t in rows if t is not None for n, x in enumerate(t.split("\n")) if len(x.encode()) >= 8]
    first = {}
    for i, n, x in sorted(occur):
        first.setdefault(x, (i, n))
    near = {x: [y for y in first if y != x and distance(x, y) <= edits] for x in first}
    want = []
    for i, t in rows:
        if t is None:
            want.append((i, 0, 0, 0, i, None))
            continue
        lines = [x.encode() for x in t.split("\n")]
        long = [x for x in lines if len(x) >= 8]
        early = {x: min([first[x], *(first[y] for y in near[x])]) for x in long}
        kept = [x for n, x in enumerate(lines) if len(x) < 8 or not early[x] < (inf if i is None else i, n)]
        ids = [e[0] for e in early.values() if e[0] < inf] + ([] if i is None else [i])
        want.append((i, len(lines), len(lines) - len(kept), sum(len(near[x]) for x in set(long)), min(ids, default=None), b"\n".join(kept).decode()))
    got = line_dedup(table(spark, rows), max_edits=edits, min_bytes=8, keep=("a", "_shard")).collect()
    key = lambda r: (r[0] is None, r[0] or 0, str(r[1:]))
    assert sorted(((r.doc_id, r.n_lines, r.n_removed, r.n_links, r.class_id, r.kept) for r in got), key=key) == sorted(want, key=key)
    assert {(r.a, r._shard) for r in got} == {(2, 1)}


def brute_lines(rows, edits, least):
    """(id, removed, links) of every row, by comparing every two lines."""
    first, long = {}, sorted({x for _, t in rows for x in t.encode().split(b"\n") if len(x) >= least})
    for i, t in rows:
        for n, x in enumerate(t.encode().split(b"\n")):
            first[x] = min(first.get(x, (i, n)), (i, n))
    near = {x: [y for y in long if x != y and abs(len(x) - len(y)) <= edits and distance(x, y) <= edits] for x in long}
    out = []
    for i, t in rows:
        lines = t.encode().split(b"\n")
        own = [x for x in lines if len(x) >= least]
        gone = [n for n, x in enumerate(lines) if len(x) >= least and min([first[x], *(first[y] for y in near[x])]) < (i, n)]
        out.append((i, len(gone), sum(len(near[x]) for x in set(own))))
    return sorted(out)


@pytest.mark.parametrize("edits,hot", [(2, 2), (1, 3), (3, 5)])
def test_line_families(spark, edits, hot):
    """Lines of templates with short and long fields at any place, more than
    one field, and lines unlike any other that share a segment with them."""
    rnd = random.Random(edits)
    letters = "abcdefgh é"
    lines = []
    for _ in range(4):
        head, tail = ("".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40))) for _ in range(2))
        for _ in range(22):
            field = str(rnd.randint(0, 10 ** rnd.randint(1, 5)))
            lines.append(f"{head}{field}{tail}" if rnd.random() < 0.8 else f"{head}{field}{tail}{rnd.randint(0, 99)}")
        for _ in range(8):  # the head, then a rest of its own
            lines.append(head + "".join(rnd.choice(letters) for _ in range(len(tail) + 3)))
    core = "".join(rnd.choice(letters) for _ in range(60))
    for _ in range(30):  # one long field changed in a few places
        line = list(core)
        for _ in range(rnd.randint(0, 4)):
            k = rnd.randrange(len(line))
            line[k:k + rnd.randint(0, 1)] = rnd.choice(["", "x", "yz"])
        lines.append("the same start of all of these lines " + "".join(line))
    lines += ["ab" * 20 + "c" * k + "ab" * 20 for k in range(12)]
    rnd.shuffle(lines)
    rows = [(i, "\n".join(lines[4 * i:4 * i + 4])) for i in range(-(-len(lines) // 4))]
    got = line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), max_edits=edits, min_bytes=8, hot=hot).collect()
    want = brute_lines(rows, edits, 8)
    assert sorted((r.doc_id, r.n_removed, r.n_links) for r in got) == want
    assert sum(r[2] for r in want) > 100


def test_within_edits_of_long_strings(spark):
    """Pairs of a few to tens of thousands of bytes against plain distance or
    edits made by hand."""
    rnd = random.Random(4)
    made = []
    for n in (0, 1, 2, 3, 5, 9, 30):
        for _ in range(40):
            a = "".join(rnd.choice("ab") for _ in range(n))
            b = list(a)
            for _ in range(rnd.randint(0, 5)):
                k = rnd.randint(0, len(b))
                b[k:k + rnd.randint(0, 1)] = rnd.choice(["", "a", "b"])
            made.append((a, "".join(b)))
    rows = [(a, b, distance(a, b)) for a, b in made]
    long = "".join(rnd.choice("abcdef ") for _ in range(40_000))
    rows += [(long, long, 0), (long, long[:7] + "#" + long[8:30_000] + long[30_001:], 2), (long, "#" + long[:20_000] + "##" + long[20_000:], 3), (long, long[3:] + "###", 6)]
    df = spark.createDataFrame(rows, "a string, b string, d int").select("d", *[F.col(c).cast("binary") for c in "ab"])
    for edits in (1, 2, 3):
        assert [r for r in df.select("a", "b", "d", within_edits(F.col("a"), F.col("b"), edits).alias("near")).collect() if r.near != (r.d <= edits)] == []


def test_equal_short_lines_go_too(spark):
    import corpus_pipeline as cp

    long = "a line of more than thirty bytes, number "
    rows = [(1, f"All rights reserved.\n\nOf.\n{long}1"), (2, f"Of.\n\n \nOff.\n{long}2\nAll rights reserved."), (3, "x\nx\n \n")]
    got = {r.doc_id: (r.n_removed, r.kept) for r in line_dedup(table(spark, rows), max_edits=2, min_bytes=1, edit_bytes=30).collect()}
    want = {1: (0, rows[0][1]), 2: (3, "\n \nOff."), 3: (1, "x\n \n")}
    assert got == want
    docs = spark.createDataFrame([(*r, "en", "s", len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id: r.text for r in cp.line_stage(spark, docs, SMOKE).collect()} == {i: t for i, (_, t) in want.items()}
    docs.select("doc_id", "text").write.mode("overwrite").parquet(f"{(folder := tempfile.mkdtemp())}/documents.parquet")
    assert {r.doc_id: r.n_removed for r in QUERIES["op3_line_dedup"](spark, folder).collect()} == {i: n for i, (n, _) in want.items()}


def test_edit_automaton_on_long_strings(spark):
    rnd = random.Random(3)
    rows = []
    for _ in range(40):
        a = [rnd.choice("ab") for _ in range(rnd.randint(100, 200))]
        b = list(a)
        for _ in range(rnd.randint(0, 4)):
            k = rnd.randrange(len(b))
            b[k:k + rnd.randint(0, 1)] = rnd.choice(["", "a", "b"])
        rows.append(("".join(a), "".join(b)))
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", within_edits(F.col("a").cast("binary"), F.col("b").cast("binary"), 2).alias("w")).collect()
    assert [r.w for r in got] == [distance(r.a, r.b) <= 2 for r in got]


@pytest.mark.parametrize("run", [substring_dedup, suffix_dedup, simhash_groups, line_dedup])
def test_empty_table(spark, run):
    assert run(table(spark, [])).collect() == []
    nulls = run(table(spark, [(1, None), (None, None), (1, None)])).collect()
    assert len(nulls) == 3


@pytest.mark.parametrize("name", ["op1_substring_dedup", "op9_suffix_dedup"])
def test_registered_query_matches_brute_force(spark, name):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMOKE}/documents.parquet").collect()]
    words = name.startswith("op1")
    cut = (lambda t: t.encode().split()) if words else (lambda t: t.encode())
    first = first_starts(rows, cut, 50)
    want = {}
    for i, t in rows:
        hit = gone_by_window(cut(t), first, 50, i)
        rest = [x for x, h in zip(cut(t), hit) if not h]
        want[i] = (len(hit), int(hit.sum()), hashlib.sha256(b" ".join(rest) if words else bytes(rest)).hexdigest())
    got = QUERIES[name](spark, SMOKE).collect()
    assert {r[0]: (r[1], r[2], r.kept_sha256) for r in got} == want
