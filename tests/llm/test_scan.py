"""Operators 2, 4, 5, 6, 7 and 8 against brute force or held-out accuracy."""

import hashlib
import math
import random
import re
import zlib
from heapq import nlargest

import numpy as np
import pytest
from pyspark.sql import functions as F

from epispark.llm.decontaminate import FMIndex, decontaminate, suffix_order
from epispark.llm.html_extract import extract, main_text
from epispark.llm.language_id import language_id, train
from epispark.llm.nearest import nearest
from epispark.llm.queries import QUERIES
from epispark.llm.secret_scan import KINDS, learn, scan_text, secret_scan
from epispark.llm.source_mix import apportion, mix_sources

SMOKE, SMALL = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


# --- 2: mixing -------------------------------------------------------------

def level_targets(sizes, weights, most):
    """Targets by sharing again and again until none is above its cap."""
    total, capped = sum(sizes), set()
    while True:
        rest = total - sum(most * sizes[i] for i in capped)
        free = [i for i in range(len(sizes)) if i not in capped]
        share = {i: rest * weights[i] / sum(weights[j] for j in free) for i in free}
        over = {i for i in free if share[i] > most * sizes[i]}
        if not over:
            return [most * sizes[i] if i in capped else share[i] for i in range(len(sizes))]
        capped |= over


def mix_rows(seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(300):
        source = rnd.choice(["b", "b", "b", "a", "é", "Z", "tiny", None])
        n = rnd.randint(0, 3) if source == "tiny" else rnd.randint(0, 80)
        rows.append((i, "\t".join(["w"] * n) if n else rnd.choice([None, "", " \n"]), source, 7))
    return rows + [(None, "x y z " * 9, "b", 7), (5, "x y " * 40, "a", 7), (5, "x y " * 40, "a", 7), (6, "q " * 3000, "b", 7)]


def test_mix_sources(spark):
    rows = mix_rows(1)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mix_sources(df, shard_docs=40).collect()
    assert len(got) == len(rows)
    size = {}
    for _, t, s, _ in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    order = sorted((s for s in size if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    want = dict(zip(order, level_targets([size[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))], 3)))
    taken = {}
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s in size:
        assert abs(taken[s] - want[s]) <= 16 * 4 + 0.02 * want[s]
    again = mix_sources(df.repartition(7), shard_docs=40).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mix_of_empty_and_blank_tables(spark):
    schema = "doc_id long, text string, source string"
    assert mix_sources(spark.createDataFrame([], schema)).collect() == []
    got = mix_sources(spark.createDataFrame([(1, None, None), (2, " ", "a")], schema)).collect()
    assert [(r["size"], r.taken, r.target) for r in got] == [(0, 0, 0.0)] * 2


@pytest.mark.parametrize("seats", [0, 1, 7, 100])
def test_apportion_awards_the_highest_quotients(spark, seats):
    rnd = random.Random(seats)
    votes = [rnd.choice([0, 3, 50, 1000, 7, 7]) for _ in range(9)]
    cells = spark.createDataFrame([(i, float(v), seats) for i, v in enumerate(votes)], "n int, votes double, seats long")
    got = {r.n: r.quota for r in apportion(cells, "votes", "seats", [], "n").collect()}
    best = nlargest(seats, ((v / (2 * k + 1), -i) for i, v in enumerate(votes) if v for k in range(seats)))
    assert got == {i: sum(-n == i for _, n in best) for i in range(9)}


# --- 4: language -----------------------------------------------------------

def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    out = [r for r in got if r.held_out]
    assert sum(r.lang_pred == r.lang for r in out) / len(out) > 0.97


def test_language_edges(spark):
    rows = [(i, "the cat and the dog are here", "en", 1) for i in range(8)] + [(i, "le chat et le chien sont ici", "fr", 1) for i in range(8, 16)]
    rows += [(20, None, "en", 1), (21, "", "fr", 1), (22, "123 ... 4", "en", 1), (23, "le chien", None, 1), (None, "the dog", "xx", 1), (24, "chatte", "en", 1), (24, "chatte", "en", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = language_id(df).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    assert [by[i].lang_pred for i in (20, 21, 22)] == ["und"] * 3
    assert by[23].lang_pred == "fr" and by[None].lang_pred == "en" and by[None].held_out is False
    assert "xx" not in {r.lang_pred for r in got}  # a null id is not learned from
    assert language_id(df.limit(0)).collect() == []
    assert {r.lang_pred for r in language_id(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_scores_by_the_formula(spark):
    """Predictions and scores recomputed from plain counts, with more
    languages than a share of the limits and one text of every kind."""
    rnd = random.Random(3)
    langs = [f"l{i}" for i in range(9)]
    vocab = {lang: ["".join(rnd.choice("abcdeféghij"[i % 4:i % 4 + 6]) for _ in range(rnd.randint(1, 7))) for _ in range(40)] for i, lang in enumerate(langs)}
    rows = [(i, " ".join(rnd.choice(vocab[langs[i % 9]]) for _ in range(rnd.randint(1, 30))), langs[i % 9] if i % 11 else None) for i in range(150)]
    rows += [(200 + i, "".join(rnd.choice("abcdxyz ") for _ in range(40)), None) for i in range(20)] + [(300, " ".join(vocab["l3"] * 2000), None)]
    got = {r.doc_id: r for r in language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most_words=90, most_grams=180).collect()}
    learned = [(t, lang) for i, t, lang in rows if lang and zlib.crc32(str(i).encode()) % 4 != 2]
    words, grams = {lang: {} for lang in langs}, {lang: {} for lang in langs}
    for t, lang in learned:
        for w in re.findall(r"[^\W\d_]+", t.lower()):
            words[lang][w] = words[lang].get(w, 0) + 1
            for n in range(1, 6):
                for k in range(len(w) + 3 - n):
                    g = f"<{w}>"[k:k + n]
                    grams[lang][g] = grams[lang].get(g, 0) + 1

    def logs(counts, share):
        keys = {k for c in counts.values() for k in sorted(c, key=lambda k: (-c[k], k))[:share]}
        total = {lang: sum(counts[lang].get(k, 0) + 0.5 for k in keys) for lang in langs}
        return {k: [math.log((counts[lang].get(k, 0) + 0.5) / total[lang]) for lang in langs] for k in keys}

    word_logs, gram_logs = logs(words, 10), logs(grams, 20)
    for i, t, _ in rows:
        total = np.zeros(9)
        for w in re.findall(r"[^\W\d_]+", t.lower()):
            if w in word_logs:
                total += word_logs[w]
                continue
            for n in range(5, 0, -1):
                found = [gram_logs[g] for k in range(len(w) + 3 - n) if (g := f"<{w}>"[k:k + n]) in gram_logs]
                if found:
                    total += np.mean(found, axis=0)
                    break
        best = int(np.argmax(total))
        assert got[i].score == pytest.approx(1 / np.exp(total - total[best]).sum(), rel=1e-6)
        assert got[i].lang_pred == langs[best] or np.sort(total)[-2] > total[best] - 1e-9


def test_every_language_is_learned(spark):
    """600 languages, one of them large, keep their own words."""
    rows = [(i * 1000 + k, f"{a}{b}{c}q", f"{a}{b}{c}") for k in range(6) for i, (a, b, c) in enumerate((a, b, c) for a in "bcdfghjklm" for b in "aeiouyzxwv" for c in "npqrst")]
    rows += [(10 ** 6 + i, "the big language has many words here", "big") for i in range(300)]
    model = train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most_words=1200, most_grams=600 * 30)
    assert len(model.languages) == 601
    assert all(model.predict(f"{lang}q")[0] == lang for lang in model.languages if lang != "big")


# --- 5: neighbours ---------------------------------------------------------

def brute_nearest(rows, k):
    use = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = {}
    for q, x in use:
        if q % 5 == 0:
            out[q] = sorted((float(np.sqrt(((y - x) ** 2).sum())), i) for i, y in use if i != q)[:k]
    return out


def test_nearest(spark):
    rnd = np.random.default_rng(1)
    centres = rnd.normal(size=(6, 16))
    rows = [(i, (centres[i % 6] + 0.2 * rnd.normal(size=16)).astype("float32").tolist()) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(30)]  # ties
    rows += [(2000, None), (2005, [0.0] * 16), (2010, [float("nan")] + [1.0] * 15), (2015, [None] + [1.0] * 15), (2020, [float("inf")] * 16), (None, rows[1][1]), (2025, [])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    got = {}
    for r in nearest(df, F.col("vec_id") % 5 == 0, block=40).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
    want = brute_nearest(rows, 10)
    assert set(got) == set(want)
    hit = 0
    for q, near in want.items():
        mine = sorted(got[q])
        assert [n for n, _, _ in mine] == list(range(1, 11))
        assert [x[1:] for x in mine] == sorted(x[1:] for x in mine)
        hit += len({i for _, i in near} & {i for _, _, i in mine})
    assert hit >= 0.95 * 10 * len(want)
    assert [(i, s) for _, s, i in sorted(got[0])] == [(i, s) for s, i in want[0]]


def test_nearest_of_few_rows(spark):
    schema = "vec_id long, embedding array<float>"
    q = F.col("vec_id") % 5 == 0
    assert nearest(spark.createDataFrame([], schema), q).collect() == []
    assert nearest(spark.createDataFrame([(0, [1.0, 2.0])], schema), q).collect() == []
    got = nearest(spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 2.0]), (2, [-1.0, 2.0])], schema), q).collect()
    assert sorted((r["rank"], r.vec_id, r.score) for r in got) == [(1, 1, 2.0), (2, 2, 2.0)]


def test_registered_recall(spark):
    got = {}
    for r in QUERIES["op5_nearest"](spark, SMALL).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    x = np.array([v for _, v in rows], float)
    ids = np.array([i for i, _ in rows])
    hit = 0
    for q in got:
        far = ((x - x[ids == q][0]) ** 2).sum(axis=1)
        far[ids == q] = np.inf
        hit += len(got[q] & set(ids[np.lexsort((ids, far))[:10]].tolist()))
    assert set(got) == {i for i in ids.tolist() if i % 100 == 0} and hit >= 9 * len(got)


# --- 6: secrets ------------------------------------------------------------

def base_by_hand(text):
    found = []
    for m in re.finditer(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[1]) >= 8:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(found))


def test_secret_scan(spark):
    rnd = random.Random(2)
    hexa = lambda n: "".join(rnd.choice("0123456789abcdef") for _ in range(n))
    mixed = lambda n: "".join(rnd.choice("abcdefghijkmnpqrstuvwxyzABCDEFGH23456789") for _ in range(n))
    texts = ["", None, 'é token = "' + hexa(40) + '" x', "PassWord:short", "password='" + mixed(20) + "' Api_Key=" + mixed(9), "AKIA" + "A1" * 6 + " AKIAX AKIAAKIA" + "Z" * 12,
             hexa(31) + "g" + hexa(32), "paſſword=" + mixed(12), "secret=token=" + mixed(10), "plain words only, nothing_to_see_here_at_all " * 30, "key " + mixed(40)]
    rows = [(i, t, 5) for i, t in enumerate(texts)] + [(2, texts[2], 5), (None, texts[4], 5)]
    got = secret_scan(spark.createDataFrame(rows, "doc_id long, text string, n_hex int")).collect()
    assert sorted((str(r.doc_id), r.base) for r in got) == sorted((str(i), base_by_hand(t or "")) for i, t, _ in rows)
    for r in got:
        assert [r.n_assign, r.n_access, r.n_hex] == [r.base.count(k + ":") for k in KINDS[:3]]
        assert set(r.base.split(",")) <= set(r.spans.split(","))
    assert secret_scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_markov_ratio_tells_random_from_names():
    size = 69 * 68
    ratios = {"random": np.zeros(size), "ordinary": np.zeros(size)}
    from epispark.llm.secret_scan import _pairs
    rnd = random.Random(1)
    names = ["get_user_name", "file_count", "max_value_index", "compute_total", "user_file_name"]
    for _ in range(400):
        np.add.at(ratios["random"], _pairs("".join(rnd.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(30))), 1)
        np.add.at(ratios["ordinary"], _pairs(rnd.choice(names) + str(rnd.randint(0, 9))), 1)
    learned = learn(ratios)
    assert scan_text("call user_file_name_count_2 now", learned) == []
    assert scan_text("use x9Kq2LmZt7Bv4Rw8Yp3N now", learned) == [(4, 3, 24)]


def test_markov_spans_against_plain_models(spark):
    """Spans recomputed from counts and ratios kept in plain dicts; strings
    without a digit or a letter, and beside fixed patterns, are judged too."""
    rnd = random.Random(6)
    anything = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    key = lambda n, a=anything: "".join(rnd.choice(a) for _ in range(n))
    name = lambda: "_".join(rnd.choice(["get", "user", "name", "count", "total", "value", "list"]) for _ in range(4))
    texts = [f"{name()} token = {key(24)} {name()} {key(20)} end {key(30, anything[:52])} {key(18, '0123456789')}" for _ in range(40)]
    texts += [f"password={key(12)} {key(40)}/{name()}", f"{key(20)}=secret:{key(9)}", None, "", "a" * 15, key(16) + "é" + key(15), " ".join(name() for _ in range(30_000)) + " " + key(32)]
    rows = list(enumerate(texts))
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
    run = f"[{re.escape(letters)}]"
    pairs, singles = [{}, {}], [dict.fromkeys(letters, 0.5), dict.fromkeys(letters, 0.5)]
    for t in texts:
        base = [tuple(map(int, x.split(":")[1:])) for x in base_by_hand(t or "").split(",") if x]
        values = set(re.findall(r"(?:token|password|secret)[\"']? *[:=] *[\"']?([A-Za-z0-9+/_.=-]{8,})", t or "", re.I)) | set(re.findall("AKIA[A-Z0-9]{12,}|[0-9a-f]{32,}", t or ""))
        names = [m[0] for m in re.finditer(run + "{6,}", t or "") if not any(m.start() < e and s < m.end() for s, e in base)]
        for k, strings in enumerate((values, names)):
            for x in strings:
                for a, b in zip("^" + x, x):
                    pairs[k][a, b] = pairs[k].get((a, b), 0) + 1
                    singles[k][b] += 1

    def log(k, a, b):
        single = singles[k][b] / sum(singles[k].values())
        return math.log((pairs[k].get((a, b), 0) + 4 * single) / (sum(n for (x, _), n in pairs[k].items() if x == a) + 4))

    memo = {(a, b): log(0, a, b) - log(1, a, b) for a in "^" + letters for b in letters}
    got = {r.doc_id: r.spans for r in secret_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    markov = 0
    for i, t in rows:
        base = [(int(x.split(":")[1]), KINDS.index(x.split(":")[0]), int(x.split(":")[2])) for x in base_by_hand(t or "").split(",") if x]
        want = list(base)
        covered = {p for s, _, e in base for p in range(s, e)}
        for m in re.finditer(run + "{16,}", t or ""):
            for part in re.finditer("1+", "".join("0" if p in covered else "1" for p in range(*m.span()))):
                s, e = m.start() + part.start(), m.start() + part.end()
                if e - s >= 16 and np.mean([memo[a, b] for a, b in zip("^" + t[s:e], t[s:e])]) >= 0.5:
                    want.append((s, 3, e))
        markov += len(want) - len(base)
        assert got[i] == ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(want)), i
    assert markov > 10


def test_registered_secrets(spark):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SMOKE}/documents.parquet").collect()}
    for r in QUERIES["op6_secret_scan"](spark, SMOKE).collect():
        assert r.base_sha256 == hashlib.sha256(base_by_hand(text[r.doc_id]).encode()).hexdigest()


# --- 7: decontamination ----------------------------------------------------

_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def cut(text):
    return _WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def hits(docs, items, size):
    phrases = {}
    for name, t in items:
        w = cut(t)
        for k in range(max(len(w) - size + 1, 1) if w else 0):
            phrases.setdefault(tuple(w[k:k + size]), set()).update([] if name is None else [str(name)])
    out = []
    for i, t in docs:
        w, hit, names = cut(t), np.zeros(len(cut(t)), bool), set()
        for n in {len(p) for p in phrases}:
            for k in range(len(w) - n + 1):
                found = phrases.get(tuple(w[k:k + n]))
                if found is not None:
                    hit[k:k + n] = True
                    names |= found
        out.append((i, len(w), int(hit.sum()), len(names), ",".join(sorted(names))))
    return out


@pytest.mark.parametrize("shard_bytes, block_bytes", [(300, 1 << 20), (1 << 20, 1 << 20), (1 << 20, 150)])
def test_decontaminate(spark, shard_bytes, block_bytes):
    rnd = random.Random(9)
    vocab = ["A", "be", "Sé", "dog", "été", "x1", "the", "of", "日本"]
    text = lambda n: "".join(rnd.choice(vocab) + rnd.choice([" ", ", ", "\n"]) for _ in range(n))
    items = [(i, text(rnd.randint(0, 14))) for i in range(25)] + [(30, None), (31, "dog"), (None, "of"), (2, text(6)), (100, "never seen words")]
    docs = [(i, text(rnd.randint(0, 40))) for i in range(80)]
    docs += [(90, None), (91, ""), (92, items[3][1].upper()), (93, "dog " * 300), (94, items[3][1] * 40), (5, docs[5][1]), (None, "dog")]
    got = decontaminate(spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, spans int, _h int"),
                        spark.createDataFrame(items, "item_id long, text string"), window=5, shard_bytes=shard_bytes, block_bytes=block_bytes).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r["items"]) for r in got), key=key) == sorted(hits(docs, items, 5), key=key)


@pytest.mark.parametrize("block_bytes", [1 << 20, 8])
def test_decontaminate_item_ids_of_any_form(spark, block_bytes):
    """Null ids hit without a name; commas and the empty string are one id."""
    items = [("x", "aa bb"), (None, "cc dd"), ("a,b", "ee ff"), ("", "gg hh"), ("x", "aa bb"), (None, None), ("y", "")]
    docs = [(1, "aa bb cc dd"), (2, "ee ff"), (3, "gg hh"), (4, "cc dd"), (5, "gg hh ee ff"), (6, "aa cc")]
    got = decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string"),
                        window=10, block_bytes=block_bytes).collect()
    assert {r.doc_id: (r.n_hit, r.n_items, r["items"]) for r in got} == {
        1: (4, 1, "x"), 2: (2, 1, "a,b"), 3: (2, 1, ""), 4: (2, 0, ""), 5: (4, 2, ",a,b"), 6: (0, 0, "")}
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r["items"]) for r in got) == sorted(hits(docs, items, 10))


def test_decontaminate_very_long_text(spark):
    rnd = random.Random(4)
    words = [f"w{rnd.randint(0, 3000)}" for _ in range(200_000)]
    docs, items = [(1, " ".join(words))], [(7, " ".join(words[150_000:150_030])), (8, "absent " * 12)]
    got = decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert [(r.n_words, r.n_hit, r["items"]) for r in got] == [(200_000, 30, "7")]


def test_fm_index_locates_every_occurrence():
    rnd = np.random.default_rng(2)
    symbols = np.r_[rnd.integers(0, 4, 600), 0]
    order = suffix_order(symbols)
    assert sorted(order) == list(range(601))
    index = FMIndex(symbols)
    assert sorted(index.locate(np.flatnonzero(symbols[order] > 0)).tolist()) == np.flatnonzero(symbols > 0).tolist()


def test_decontaminate_without_rows(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert [(r.n_words, r.n_hit, r["items"]) for r in decontaminate(docs, none).orderBy("doc_id").collect()] == [(2, 0, ""), (0, 0, "")]
    assert decontaminate(docs.limit(0), none).collect() == []


def test_registered_decontamination(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMOKE}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMOKE}/benchmark.parquet").collect()]
    got = QUERIES["op7_decontaminate"](spark, SMOKE).collect()
    want = {i: (n, h, k, hashlib.sha256(names.encode()).hexdigest(), h > 0) for i, n, h, k, names in hits(docs, items, 10)}
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got} == want


# --- 8: pages --------------------------------------------------------------

PAGES = [
    (None, ""), ("", ""), ("<p>one", "one"), ("plain &amp; simple", "plain & simple"), ("<div class='ad'>buy now, today.</div>", ""),
    ("<header>site</header><nav><a href=x>home</a></nav><article><header><h1>T</h1></header><p>a<b>b</b>c&nbsp;d,\n e.</p><ul><li>x<li>y</ul></article><footer>f</footer>", "T abc d, e. x y"),
    ("<div id='main'><h1>News of today</h1><p>It is long, and it goes on, as text does.</p><p>More of it, here, too.</p></div><div class='comments'><p>I agree, fully, with that.</p></div><aside>s</aside>",
     "News of today It is long, and it goes on, as text does. More of it, here, too."),
    ("<main><p>kept, text.</p><form><label>name</label></form><section class='user-comments'><p>hi, all.</p></section><script>var a='</p>';</script><style>p{}</style></main>", "kept, text."),
    ("<p title=it's>quotes, here</p>", "quotes, here"), ("<article><p>1 < 2, and 3 > 2.</p></article>", "1 < 2, and 3 > 2."),
    ("<article><p>a<br>b</p><!-- no --><p>c</article>", "a b c"), ("<div role=navigation>menu</div><p>text, then.</p>", "text, then."),
]


def test_main_text(spark):
    assert [main_text(h) for h, _ in PAGES] == [t for _, t in PAGES]
    rows = [(i, None if i % 2 else "u", h, "clash") for i, (h, _) in enumerate(PAGES)] + [(None, None, PAGES[2][0], "clash")] * 2
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    want = [(i, u, main_text(h), len(main_text(h))) for i, u, h, _ in rows]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_path_scores_choose_within_an_article():
    prose = "<p>It is long, and it goes on, as text does; more of it follows here, too.</p>" * 3
    links = "<h3>More</h3><ul>" + "<li><a href=x>Another story of the day</a></li>" * 4 + "</ul>"
    table = "<h2>Figures</h2><table><tr><th>Year</th><th>Cases</th></tr><tr><td>2020</td><td>17 in all</td></tr></table>"
    for around in ("<article>{}</article>", "<div>{}</div>"):
        text = main_text(around.format(f"<h1>Title</h1>{prose}{table}{prose}{links}"))
        assert "Another story" not in text and "More" not in text
        assert text.startswith("Title It is long,") and "Figures Year Cases 2020 17 in all It is" in text and text.count("too.") == 6


PROSE = "<p>It is long, and it goes on, as text does; more of it follows here, too.</p>" * 2
WANT = "It is long, and it goes on, as text does; more of it follows here, too. " * 2


@pytest.mark.parametrize("page, want", [
    (f"<article><header class='entry-header'><h1>Title</h1></header>{PROSE}</article>", f"Title {WANT}"),
    (f"<article><div class='article-header'><h1>Title</h1></div>{PROSE}</article>", f"Title {WANT}"),
    (f"<article><div class='header'><h1>Title</h1><p>In short, it goes on.</p></div>{PROSE}</article>", f"Title In short, it goes on. {WANT}"),
    (f"<div class='sidebar'><h3>Links</h3><p>One, or two.</p></div><h1>Title</h1>{PROSE}", f"Title {WANT}"),
    (f"<article><h1 class='banner'>Title</h1>{PROSE}</article>", f"Title {WANT}"),
    (f"<article>{PROSE}<p class='share-price'>The price, at noon, was 7.</p></article>", f"{WANT}The price, at noon, was 7."),
    (f"<article>{PROSE}<section class='related-work'>{PROSE}</section></article>", WANT * 2),
    (f"<div class='menu-open page'><article>{PROSE}</article></div>", WANT),
    (f"<div class='widget'><main><div id='social'><article>{PROSE}</article></div></main></div>", WANT),
    (f"<article class='post category-social'>{PROSE}</article>", WANT),
    (f"<div class='post category-social'>{PROSE}</div>", WANT),
    (f"<main><article>{PROSE}</article><section class='comments'><article><p>I agree, fully, with it.</p></article></section></main>", WANT),
    (f"<article>{PROSE}<h2>Comments</h2><div class='user-comments'><p>I agree, fully, with it.</p></div></article>", WANT),
    (f"<div class='site-header'>A site, as others are.</div><div>{PROSE}</div>", WANT),
])
def test_class_names_drop_no_article_text(page, want):
    assert main_text(page) == want.strip()


NOTICE = "<div><p>We keep some data, as all sites do; read on, and agree, or leave now, please. It is long, too.</p></div>"


@pytest.mark.parametrize("page, want", [
    (f"<article>{PROSE}<div class=x>tail</div></article>", f"{WANT}tail"),
    (f"<article><h1>Title</h1><p>first short line</p><p>then another</p></article>{NOTICE * 3}", "Title first short line then another"),
    (f"<article>{PROSE}<p>Press <button>Go</button> now.</p><button>Like</button></article>", f"{WANT}Press Go now."),
    (f"<article>{PROSE}<p>See <a href=x>this</a> for more</p><ul><li><a href=y>Other story</a></li></ul></article>", f"{WANT}See this for more"),
    (f"<main><article>{PROSE}<figure><figcaption>A view</figcaption></figure><p>End</p></article></main>", f"{WANT}A view End"),
])
def test_article_text_stays_however_short(page, want):
    assert main_text(page) == want.strip()


def test_very_long_page():
    assert main_text("<article>" + PROSE * 20_000 + "</article>") == (WANT * 20_000).strip()


def test_deep_and_broken_markup_is_linear():
    assert main_text("<div>" * 20000 + "deep, text.") == "deep, text."
    assert main_text("<a href='" * 20000 + ">z") == "z"
    assert main_text("<" * 50000).startswith("<<")


def test_registered_pages_hold_the_article(spark):
    html = {r.page_id: r.html for r in spark.read.parquet(f"{SMOKE}/pages.parquet").collect()}
    from html import unescape
    for r in QUERIES["op8_html_extract"](spark, SMOKE).collect():
        inner = re.search("<article>(.*)</article>", html[r.page_id], re.S)[1]
        inner = re.sub("</?b>", "", re.sub("</?(?:p|h1|br)>", " ", inner))
        assert r.text == " ".join(unescape(inner).split()) and r.n_chars == len(r.text)


def test_language_learns_from_every_labelled_document(spark):
    """More documents of a language than any sample held; rows repeated whole
    count once, and the fits are of all texts."""
    from epispark.llm.language_id import least_fits

    rows = [(i, "comum " + ("zzqx" if i % 10 == 0 else "palavra"), "pt") for i in range(4000)]
    learned = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    docs = spark.createDataFrame(rows + rows[:50], "doc_id long, text string, lang string")
    model = train(docs)
    held = {w: model.counts[model.first[i]] for w, i in model.words.items()}
    assert held == {"comum": len(learned), "palavra": sum(r[0] % 10 != 0 for r in learned), "zzqx": sum(r[0] % 10 == 0 for r in learned)}
    fits = np.array([model.fit(r[1], "pt") for r in learned])
    low, mid = np.quantile(fits, [0.05, 0.5])
    assert abs(least_fits(docs, model)["pt"] - (mid - max(1.5, 4 * (mid - low)))) < 1e-3
