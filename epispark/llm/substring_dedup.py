"""Substring dedup over word windows (operator 1).

Every window of 50 words gets a Rabin-Karp hash; Spark counts hashes over
shards, and windows whose words also start in a document with a smaller id
merge into maximal removal intervals.

Two equal windows contain the same least hash of a 25-word gram (their
anchor).  So the anchors, about one per 13 windows, are counted first, and
only windows whose anchor occurs in two documents are hashed, shuffled and
counted: the others cannot repeat.  This loses no repeat.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from epispark.llm import shards as S
from epispark.llm.words import inside, rolling, sliding_min, space_words, word_codes


def _windows(texts: list[bytes], a: int, b: int, size: int):
    """Of the texts a..b: word rows, first word of every window, its hash,
    and its anchor."""
    raw, offsets = S.joined(texts[a:b])
    starts, ends, rows = space_words(raw, offsets)
    codes = word_codes(raw, starts, ends)
    whole = inside(rows, size)
    at = np.flatnonzero(whole)
    gram = (size + 1) // 2
    return rows + a, at, rolling(codes, size)[at], sliding_min(rolling(codes, gram), size - gram + 1)[at]


def _anchors(size: int):
    def run(shard: pa.Table) -> pa.Table:
        ids, texts = S.texts_of(shard)
        source, _ = S.bounds(ids)
        keys, own = [], []
        for a, b in S.slices(texts):
            rows, at, _, anchor = _windows(texts, a, b, size)
            keys.append(anchor)
            own.append(source[rows[at]])
        key, least, most = S.least_by(np.concatenate(keys), np.concatenate(own)) if keys else (np.zeros(0, np.uint64),) * 3
        where = shard.column("_shard")[0].as_py()
        return pa.table({"a": pa.array(key.view(np.int64)), "_shard": pa.array(np.full(len(key), where, np.int64)), "several": pa.array(least < most)})
    return run


def _candidates(size: int):
    def run(shard: pa.Table, repeated: pa.Table) -> pa.Table:
        keys, own = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        if shard.num_rows and repeated.num_rows:
            known = np.sort(repeated.column("a").to_numpy().view(np.uint64))
            ids, texts = S.texts_of(shard)
            source, _ = S.bounds(ids)
            for a, b in S.slices(texts):
                rows, at, hashes, anchor = _windows(texts, a, b, size)
                may = S.found_in(anchor, known) >= 0
                keys.append(hashes[may])
                own.append(source[rows[at[may]]])
        key, least, _ = S.least_by(np.concatenate(keys), np.concatenate(own))
        where = shard.column("_shard")[0].as_py() if shard.num_rows else 0
        return pa.table({"h": pa.array(key.view(np.int64)), "_shard": pa.array(np.full(len(key), where, np.int64)), "least": pa.array(least)})
    return run


def _removal(size: int):
    def run(shard: pa.Table, before: pa.Table) -> pa.Table:
        if not shard.num_rows:
            return _RESULT.empty_table()
        ids, texts = S.texts_of(shard)
        source, reader = S.bounds(ids)
        parts = [_windows(texts, a, b, size)[:3] for a, b in S.slices(texts)]
        hashes = np.concatenate([p[2] for p in parts]) if parts else np.zeros(0, np.uint64)
        own = np.concatenate([p[0][p[1]] for p in parts]) if parts else np.zeros(0, np.int64)
        key, first, _ = S.least_by(hashes, source[own])
        if before.num_rows:  # an earlier document in another shard
            at = S.found_in(before.column("h").to_numpy().view(np.uint64), key)
            first[at] = np.minimum(first[at], before.column("first").to_numpy())
        gone = first[np.searchsorted(key, hashes)] < reader[own] if len(key) else np.zeros(0, bool)
        kept, spans, counts, removed = [], [], [], []
        done = 0
        for (a, b), (rows, at, _) in zip(S.slices(texts), parts):
            hit = S.covered_by(at[gone[done:done + len(at)]], size, len(rows))
            done += len(at)
            edges = np.searchsorted(rows, np.arange(a, b + 1))
            for i in range(a, b):
                flags = hit[edges[i - a]:edges[i - a + 1]]
                words = texts[i].split()
                if flags.any():
                    starts, ends = S.runs(flags)
                    spans.append(",".join(f"{s}:{e}" for s, e in zip(starts, ends)))
                    words = [w for w, f in zip(words, flags.tolist()) if not f]
                else:
                    spans.append("")
                kept.append(b" ".join(words))
                counts.append(len(flags))
                removed.append(int(flags.sum()))
        return pa.Table.from_arrays([ids, pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.string()),
                                     pa.array(kept, pa.binary()).cast(pa.string())], schema=_RESULT)
    return run


_RESULT = pa.schema([("_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.string()), ("kept", pa.string())])


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50,
                    shard_bytes: int = 8 << 20) -> DataFrame:
    """One row per input row: ``id_col``, ``n_words``, ``n_removed``,
    ``spans`` (removed word intervals ``start:end``, comma-joined) and
    ``kept`` (the kept words joined by one space).

    Words are ``[^\\x20\\x09-\\x0D]+``.  A word goes if a window of
    ``window`` consecutive words covers it whose sequence also starts in a row
    with a smaller id; windows are judged on the input.  Hashes are 64 bits.

    A null text has no words.  Texts shorter than a window keep all words.  A
    null id is never the smaller one and loses nothing.  Rows with one id do
    not remove from each other; an empty table gives no rows.
    """
    shards = S.sharded(docs, id_col, text_col, S.shard_count(docs, text_col, shard_bytes))
    by_shard = shards.groupBy("_shard")
    anchors = by_shard.applyInArrow(_anchors(window), "a long, _shard long, several boolean")
    same = W.partitionBy("a")
    repeated = (anchors.withColumn("n", F.count("*").over(same)).where("n > 1 or several").select("_shard", "a"))
    windows = (by_shard.cogroup(repeated.groupBy("_shard"))
               .applyInArrow(_candidates(window), "h long, _shard long, least long"))
    first = (windows.withColumn("first", F.min("least").over(W.partitionBy("h")))
             .where("first < least").select("_shard", "h", "first"))
    out = (by_shard.cogroup(first.groupBy("_shard"))
           .applyInArrow(_removal(window), "_id long, n_words long, n_removed long, spans string, kept string"))
    return out.withColumnRenamed("_id", id_col)
