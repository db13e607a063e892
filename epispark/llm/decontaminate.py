"""Benchmark decontamination with an FM-index per training shard (operator 7).

A shard is a few megabytes of documents.  Its words become symbols: words of
the benchmark get numbers, all others end a run; runs shorter than the
shortest phrase are left out, since no phrase can occur in them.  The runs'
suffix array gives the Burrows-Wheeler transform, kept as a wavelet matrix;
all phrases are searched backward at once, occurrences are located from
sampled suffix positions, and the hit words merge into removal spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from epispark.llm.common import map_batches, text_slices
from epispark.llm.shards import found_in, runs
from epispark.llm.words import rolling, spans, text_bytes, word_codes

SAMPLE = 8  # every eighth suffix position is kept
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, dtype=bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True


def lowered_words(column: pa.Array):
    """A-Z lower-cased; words of digits, letters and bytes from 0x80 on: their
    hashes, rows, and the number of words of every row."""
    raw, offsets = text_bytes(column)
    raw = _LOWER[raw]
    starts, ends, rows = spans(_WORD[raw], offsets)
    return word_codes(raw, starts, ends), rows, np.bincount(rows, minlength=len(offsets) - 1)


class Phrases:
    """The distinct windows of a block of benchmark items (columns ``name``,
    which may be null, and ``t``): places in one array of symbols, not texts.
    Windows are told apart by 64-bit hashes of their words' hashes."""

    def __init__(self, items: pa.Table, window: int = 10):
        parts = [(*lowered_words(piece.column(1)), piece.column(0).to_pylist()) for piece in text_slices(items.to_batches(), "t")]
        codes = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.uint64)
        counts = np.concatenate([p[2] for p in parts]) if parts else np.zeros(0, np.int64)
        names = [n for p in parts for n in p[3]]
        del parts
        self.window = window
        self.words = np.unique(codes)
        self.symbols = (found_in(codes, self.words) + 1).astype(np.int32)
        begin = np.cumsum(counts) - counts
        # An item's windows start at each of its words but the last ones.
        many = np.where(counts > 0, np.maximum(counts - window, 0) + 1, 0)
        start = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many - begin, many)
        length = np.repeat(np.minimum(counts, window), many)
        key = np.zeros(len(start), np.uint64)
        full = length == window
        if full.any():
            key[full] = rolling(codes, window)[start[full]]
        for n in np.unique(length[~full]).tolist():
            key[length == n] = rolling(codes, n)[start[length == n]] ^ np.uint64(n)
        _, first, which = np.unique(key, return_index=True, return_inverse=True)
        self.starts, self.lengths = start[first], length[first].astype(np.int32)
        # The named items of every phrase, each once.
        self.names = sorted({n for n in names if n is not None})
        place = {n: i for i, n in enumerate(self.names)}
        item = np.repeat(np.array([place.get(n, -1) if n is not None else -1 for n in names], np.int64), many)
        pair = np.unique(which[item >= 0] * np.int64(max(len(self.names), 1)) + item[item >= 0])
        phrase, self.items = pair // max(len(self.names), 1), pair % max(len(self.names), 1)
        self.first_item = np.searchsorted(phrase, np.arange(len(self.starts) + 1))

    def within(self, present: np.ndarray) -> np.ndarray:
        """Phrases all of whose symbols are present."""
        which = np.arange(len(self.starts))
        for step in range(1, self.window + 1):
            at = np.maximum(self.starts[which] + self.lengths[which] - step, self.starts[which])
            which = which[present[self.symbols[at]]]
        return which


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffix array by Larsson-Sadakane refinement; a 0 ends a suffix, and
    suffixes that are equal up to their 0 stay in order of position."""
    n = len(symbols)
    bits = max(int(symbols.max()).bit_length(), 1)
    ends = np.flatnonzero(symbols == 0)
    left = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)  # symbols before the 0
    depth = max(62 // bits, 1)
    key, on = np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
    padded = np.r_[symbols, np.zeros(depth, symbols.dtype)]
    for j in range(depth):
        read = np.where(on, padded[j:j + n], 0)
        key = (key << bits) | read
        on &= read != 0
    order = np.argsort(key, kind="stable")
    value = key[order]
    fresh = np.r_[True, (value[1:] != value[:-1]) | (left[order][1:] < depth)]
    place = np.arange(n)
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, place, 0))
    todo = np.arange(n)
    while True:
        old = rank[order[todo]]
        same = old[1:] == old[:-1]
        tied = np.zeros(len(todo), dtype=bool)
        tied[1:] |= same
        tied[:-1] |= same
        todo, old = todo[tied], old[tied]
        if not len(todo):
            return order
        at = order[todo]
        # A suffix that ends within the depth has a rank of its own already.
        key = old * np.int64(n + 1) + rank[at + depth]
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[todo] = at
        ended = left[at] < 2 * depth
        fresh = np.r_[True, (key[1:] != key[:-1]) | ended[1:]]
        opens = np.r_[True, old[1:] != old[:-1]]
        place = np.arange(len(todo))
        group = np.maximum.accumulate(np.where(opens, place, 0))
        rank[at] = old + np.maximum.accumulate(np.where(fresh, place, 0)) - group
        depth *= 2


class FMIndex:
    """Wavelet matrix of the transform, symbol counts, sampled positions."""

    def __init__(self, symbols: np.ndarray):
        order = suffix_order(symbols)
        self.n = len(symbols)
        self.transform = symbols[order - 1]
        self.less = np.searchsorted(np.sort(symbols), np.arange(int(symbols.max()) + 2))
        self.levels = []
        level = self.transform
        for bit in range(max(int(symbols.max()).bit_length(), 1) - 1, -1, -1):
            ones = (level >> bit) & 1
            before = np.zeros(self.n + 1, dtype=np.int32)
            np.cumsum(ones, out=before[1:])
            self.levels.append((bit, before, self.n - int(before[-1])))
            flags = ones.astype(bool)
            level = np.concatenate([level[~flags], level[flags]])
        # Positions of every SAMPLE-th symbol and of every run's start.
        start = np.r_[True, symbols[:-1] == 0]
        self.kept = (order % SAMPLE == 0) | start[order]
        self.kept_before = np.r_[0, np.cumsum(self.kept)]
        self.positions = order[self.kept]

    def rank(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol in the transform before each row."""
        begin, at = np.zeros(len(row), dtype=np.int64), row
        for bit, before, zeros in self.levels:
            one = ((symbol >> bit) & 1).astype(bool)
            ones_at, ones_begin = before[at], before[begin]
            at = np.where(one, zeros + ones_at, at - ones_at)
            begin = np.where(one, zeros + ones_begin, begin - ones_begin)
        return at - begin

    def search(self, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases that occur, with their ranges of rows (backward search)."""
        present = np.zeros(len(phrases.words) + 1, dtype=bool)
        present[self.transform] = True
        which = phrases.within(present)
        low, high = np.zeros(len(which), dtype=np.int64), np.full(len(which), self.n, dtype=np.int64)
        done = [(which[:0], low[:0], high[:0])]
        for step in range(1, phrases.window + 1):
            symbol = phrases.symbols[phrases.starts[which] + phrases.lengths[which] - step]
            low, high = self.less[symbol] + self.rank(symbol, low), self.less[symbol] + self.rank(symbol, high)
            live = high > low
            which, low, high = which[live], low[live], high[live]
            over = phrases.lengths[which] == step
            done.append((which[over], low[over], high[over]))
            which, low, high = which[~over], low[~over], high[~over]
        return tuple(np.concatenate(x) for x in zip(*done))

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Text positions of rows: steps back to a kept position."""
        row, steps = row.copy(), np.zeros(len(row), dtype=np.int64)
        while len(todo := np.flatnonzero(~self.kept[row])):
            symbol = self.transform[row[todo]]
            row[todo] = self.less[symbol] + self.rank(symbol, row[todo])
            steps[todo] += 1
        return self.positions[self.kept_before[row]] + steps


def shard_hits(column: pa.Array, phrases: Phrases) -> tuple[np.ndarray, list[str], list[list[str]]]:
    """Per text of a shard: number of words, hit spans, names of the items."""
    codes, rows, counts = lowered_words(column)
    spans_of, names_of = [""] * len(counts), [[] for _ in range(len(counts))]
    if not len(codes) or not len(phrases.lengths):
        return counts, spans_of, names_of
    symbol = found_in(codes, phrases.words) + 1
    # Runs of benchmark words within one text that can hold a phrase.
    ahead = np.r_[rows[1:] != rows[:-1], True]
    begin, end = _runs_by_row(symbol > 0, ahead)
    long = end - begin >= phrases.lengths.min()
    begin, length = begin[long], (end - begin)[long]
    if not len(begin):
        return counts, spans_of, names_of
    at = np.cumsum(length + 1) - (length + 1)
    word = np.arange(int((length + 1).sum())) - np.repeat(at - begin, length + 1)  # text position -> word
    text = symbol[np.minimum(word, len(symbol) - 1)]
    text[at + length] = 0
    index = FMIndex(text)
    which, low, high = index.search(phrases)
    if not len(which):
        return counts, spans_of, names_of
    many = high - low
    which = np.repeat(which, many)
    first = word[index.locate(np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many))]
    edge = np.zeros(len(codes) + 1, dtype=np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, first + phrases.lengths[which], -1)
    hit = np.cumsum(edge[:-1]) > 0
    pair = np.unique(rows[first] * np.int64(len(phrases.lengths)) + which)
    row, which = pair // len(phrases.lengths), pair % len(phrases.lengths)
    n = np.diff(phrases.first_item)[which]
    item = phrases.items[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(phrases.first_item[which], n)]
    pair = np.unique(np.repeat(row, n) * np.int64(max(len(phrases.names), 1)) + item)
    begin = np.cumsum(counts) - counts
    for r in np.unique(row).tolist():
        s, e = runs(hit[begin[r]:begin[r] + counts[r]])
        spans_of[r] = ",".join(f"{a}:{b}" for a, b in zip(s, e))
        own = pair[np.searchsorted(pair, r * len(phrases.names)):np.searchsorted(pair, (r + 1) * len(phrases.names))]
        names_of[r] = [phrases.names[i % len(phrases.names)] for i in own.tolist()]
    return counts, spans_of, names_of


def _runs_by_row(flags: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of true flags that also end at every row's last word."""
    opens = flags & np.r_[True, ~flags[:-1] | last[:-1]]
    closes = flags & np.r_[~flags[1:] | last[:-1], True]
    return np.flatnonzero(opens), np.flatnonzero(closes) + 1


def _scan(source: DataFrame, schema: str, phrases: Phrases, shard_bytes: int) -> DataFrame:
    shared = source.sparkSession.sparkContext.broadcast(phrases)  # one block of the benchmark

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in text_slices(batches, "_t", shard_bytes):
            counts, hit, names = shard_hits(batch.column(batch.num_columns - 1), shared.value)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(counts, pa.int64()), pa.array(hit, pa.string()), pa.array(names, pa.list_(pa.string()))],
                names=[*batch.schema.names[:-1], "n_words", "spans", "items"])

    return map_batches(source, run, f"{schema}, n_words long, spans string, items array<string>")


def _span_words() -> str:
    """All hit word numbers of the spans, sorted and distinct."""
    return ("array_sort(array_distinct(flatten(transform(filter(flatten(collect_set(split(spans, ','))), x -> x != ''), "
            "x -> sequence(cast(split_part(x, ':', 1) as long), cast(split_part(x, ':', 2) as long) - 1)))))")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", window: int = 10,
                  shard_bytes: int = 4 << 20, block_bytes: int = 16 << 20) -> DataFrame:
    """One row per input row: ``id_col``, ``n_words``, ``n_hit``, ``spans``
    (hit words ``start:end``, merged, comma-joined), ``items`` (item ids with
    occurring windows, sorted as strings, comma-joined), ``n_items``.

    A phrase is ``window`` consecutive words of an item, or a shorter item as
    a whole; a document word is hit if it lies in any occurrence.  Words are
    compared by 64-bit hashes.  Null texts have no words, items without words
    no phrases; an empty benchmark hits nothing.  Items with a null id hit
    words like any other, but are not counted or named; every other id, the
    empty string too, counts once however many commas it holds.  Repeated rows
    give repeated rows, an empty table none.

    The benchmark is read in blocks of about ``block_bytes`` (an item is never
    split); only one block is on the driver and broadcast at a time, as arrays
    of numbers, and the documents are passed over once per block.
    """
    items = benchmark.where(F.col(item_text_col).isNotNull()).select(
        F.col(item_col).cast("string").alias("name"), F.col(item_text_col).alias("t")).distinct()
    total = items.agg(F.sum(F.octet_length("t").cast("long"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    kind = docs.schema[id_col].dataType.simpleString()

    def phrases(block: int) -> Phrases:
        own = items if blocks == 1 else items.where(F.pmod(F.xxhash64("name", "t"), F.lit(blocks)) == block)
        return Phrases(own.toArrow(), window)

    if blocks == 1:
        found = _scan(docs.select(id_col, F.col(text_col).alias("_t")), f"`{id_col}` {kind}", phrases(0), shard_bytes)
    else:
        source = docs.select(id_col, F.xxhash64(text_col).alias("_h"), F.col(text_col).alias("_t"))
        passes = None
        for block in range(blocks):
            own = _scan(source, f"`{id_col}` {kind}, _h long", phrases(block), shard_bytes)
            passes = own if passes is None else passes.unionByName(own)
        merged = passes.groupBy(id_col, "_h").agg(
            F.expr(f"cast(count(*) / {blocks} as int)").alias("_rows"), F.first("n_words").alias("n_words"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), F.expr(_span_words()).alias("_w"))
        starts = F.filter("_w", lambda x, i: (i == 0) | (F.get("_w", i - 1) != x - 1))
        ends = F.filter("_w", lambda x, i: (i == F.size("_w") - 1) | (F.get("_w", i + 1) != x + 1))
        found = (merged.withColumn("spans", F.array_join(F.transform(F.arrays_zip(starts.alias("s"), ends.alias("e")),
                                                                     lambda p: F.concat_ws(":", p["s"], p["e"] + 1)), ","))
                 .withColumn("_row", F.explode(F.sequence(F.lit(1), "_rows"))).select(id_col, "n_words", "spans", "items"))
    widths = F.transform(F.filter(F.split("spans", ","), lambda x: x != ""),
                         lambda x: F.split_part(x, F.lit(":"), F.lit(2)).cast("long") - F.split_part(x, F.lit(":"), F.lit(1)).cast("long"))
    return found.select(id_col, "n_words", F.aggregate(widths, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_hit"), "spans",
                        F.array_join("items", ",").alias("items"), F.size("items").cast("long").alias("n_items"))
