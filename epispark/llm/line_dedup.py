"""Line dedup by a segment-partition edit join (operator 3), in DataFrame
functions only.

A line goes where an equal line, or one within ``max_edits`` edits, occurs
earlier.  Distinct lines are cut into ``max_edits + 1`` segments; two lines
within the distance share a segment exactly, at a place that the lengths
bound, so a segment index by length is probed with few substrings.  A first
pass only marks the lines that share a segment with another line; among those
a join pairs lines that also pass a letter-parity test, and a banded
bit-parallel automaton verifies the pairs.

Where more than ``hot`` lines hold one segment they are not paired by it.
What all of them share beyond the segment is taken off both sides, and the
remaining cores go through the same join within that group; cores of a few
bytes meet by the strings that up to ``max_edits`` deletions leave.  So the
pairs that are verified stay near the number of links, even in a family of
lines that differ in one place only.

Texts shuffle once, keyed by row; everything else is hashes and positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from epispark.llm.common import landed

PARITY = "etaoinshrdlucmfwygpbvk"
CORE_BYTES = 24  # cores up to this length meet by deletions
_BETWEEN = b"\xff"  # in no UTF-8 text


def probe_plan(edits: int) -> list[tuple[int, int, int]]:
    """(less, segment, shift): where a line may hold a segment of a line that
    is shorter by ``less``.  If the first ``i`` segments hold at most ``i``
    edits and the later ones the rest, the shift is bounded from both ends;
    only starts within both bounds are probed.  With less and shift 0 the
    substring is the line's own segment, its entry in the index."""
    return [(less, i, shift) for less in range(edits + 1) for i in range(edits + 1)
            for shift in range(max(-i, less - (edits - i)), min(i, less + (edits - i)) + 1)]


def with_keys(lines: DataFrame, edits: int) -> DataFrame:
    """A row per line and planned substring: the line's columns but the text,
    ``own`` (whether it is the line's own segment), the line's ``_bytes``, the
    substring's place ``_at`` and ``_size``, and ``key``, a hash of segment number, length and
    substring (and of the group ``_of``, if there is that column).  A line of
    n bytes has even segments, the longer ones last."""
    parts = edits + 1
    kept = [c for c in lines.columns if c != "_line"]
    within = [c for c in kept if c == "_of"]
    spots = F.array(*[F.struct(F.lit(less).alias("less"), F.lit(i).alias("i"), F.lit(shift).alias("shift")) for less, i, shift in probe_plan(edits)])
    line = lines.select(*kept, F.col("_line").cast("binary").alias("_b"), F.octet_length("_line").alias("_bytes"))
    spread = line.select("*", F.explode(spots).alias("_p")).select(
        *kept, "_b", "_bytes", F.col("_p.i").alias("_i"), F.col("_p.shift").alias("_s"), (F.col("_bytes") - F.col("_p.less")).alias("_other"))
    spread = spread.select("*", F.expr(f"cast(_other div {parts} as int)").alias("_short"), (F.col("_i") - (parts - F.col("_other") % parts)).alias("_over"))
    spread = spread.select("*", (F.col("_short") * F.col("_i") + F.greatest(F.col("_over"), F.lit(0)) + 1 + F.col("_s")).alias("_at"),
                           (F.col("_short") + F.when(F.col("_over") >= 0, 1).otherwise(0)).alias("_size"))
    inside = (F.col("_at") >= 1) & (F.col("_at") + F.col("_size") - 1 <= F.col("_bytes"))
    return spread.where(inside).select(*kept, ((F.col("_s") == 0) & (F.col("_other") == F.col("_bytes"))).alias("own"), "_bytes", "_at", "_size",
                                       F.xxhash64(*within, "_i", "_other", F.substr("_b", F.col("_at"), F.col("_size"))).alias("key"))


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value evaluated once: a lambda in ``use`` would
    evaluate the expression again for every element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def parity(line: Column) -> Column:
    """One bit per letter: whether it occurs an odd number of times.  An edit
    changes at most two bits."""
    bits = F.lit(0)
    for i, letter in enumerate(PARITY):
        odd = (F.octet_length(line) - F.octet_length(F.replace(line, F.lit(letter), F.lit("")))).bitwiseAND(F.lit(1))
        bits = bits.bitwiseOR(F.shiftleft(odd, i))
    return bits


_POWERS = [1 << k for k in range(30, -1, -1)]


def shared_start(a: Column, b: Column, most: Column) -> Column:
    """Bytes that two byte strings share at their start, ``most`` at most:
    ever smaller powers of two are added while those bytes are equal."""
    return F.aggregate(F.array(*map(F.lit, _POWERS)), F.lit(0), lambda at, k: F.when(
        (at + k <= most) & (F.substr(a, at + 1, k) == F.substr(b, at + 1, k)), at + k).otherwise(at))


def shared_end(a: Column, b: Column, most: Column) -> Column:
    """As ``shared_start``, at the end."""
    return F.aggregate(F.array(*map(F.lit, _POWERS)), F.lit(0), lambda at, k: F.when(
        (at + k <= most) & (F.substr(a, F.length(a) - at - k + 1, k) == F.substr(b, F.length(b) - at - k + 1, k)), at + k).otherwise(at))


def within_edits(a: Column, b: Column, edits: int) -> Column:
    """Whether the edit distance of two byte strings is at most ``edits``.

    What they share at either end is taken off, which leaves the distance.
    Then a bit-parallel automaton in a band: bit ``s`` of state ``d`` says
    that, after j bytes of b, the first j + s - edits bytes of a match with at
    most d edits.  Consuming a byte keeps a bit on a match or a substitution,
    moves it down on an insertion, and up on a deletion; the band is
    2 * edits + 1 bits wide, however long the strings are.  The states lie side
    by side in one number, which is 0 at the top once no match is left.
    """
    width, states = 2 * edits + 1, edits + 1
    each = lambda bits: sum(bits << (d * width) for d in range(states))
    full, no_top, no_bottom = each((1 << width) - 1), each((1 << (width - 1)) - 1), each((1 << width) - 2)
    start, state = 0, 1 << edits
    for d in range(states):
        start |= state << (d * width)
        state |= (state << 1) & ((1 << width) - 1)

    def core(p: Column, s: Column) -> Column:
        m, n = F.length(a) - p - s, F.length(b) - p - s

        def step(held: Column, j: Column) -> Column:
            byte = F.substr(b, p + j + 1, F.lit(1))
            match = F.lit(0)
            for k in range(width):
                at = j + (k - edits + 1)
                match = match.bitwiseOR(F.when((at >= 1) & (at <= m) & (F.substr(a, p + at, F.lit(1)) == byte), 1 << k).otherwise(0))

            def moved(match: Column) -> Column:
                below = F.shiftleft(held, width).bitwiseAND(F.lit(full))
                made = held.bitwiseAND(match * each(1)).bitwiseOR(below).bitwiseOR(F.shiftright(below, 1).bitwiseAND(F.lit(no_top)))
                for _ in range(edits):
                    made = _bound(made, lambda x: x.bitwiseOR(F.shiftleft(x, width + 1).bitwiseAND(F.lit(no_bottom & full))))
                return made

            return F.when(held < (1 << (edits * width)), held).otherwise(_bound(match, moved))

        final = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(start), step)
        ends = F.array(*[F.lit(1 << (edits * width + k)) for k in range(width)])
        return F.when((m == 0) | (n == 0), F.greatest(m, n) <= edits).otherwise(final.bitwiseAND(F.get(ends, m - n + edits)) != 0)

    least = F.least(F.length(a), F.length(b))
    return F.when(F.abs(F.length(a) - F.length(b)) > edits, F.lit(False)).otherwise(
        _bound(shared_start(a, b, least), lambda p: _bound(F.struct(p.alias("p"), shared_end(a, b, least - p).alias("s")), lambda x: core(x["p"], x["s"]))))


def deletions(text: Column, edits: int) -> Column:
    """Every string that up to ``edits`` deletions leave of a byte string."""
    drop = lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1))),
                                 lambda i: F.concat(F.substr(t, F.lit(1), i - 1), F.substr(t, i + 1, F.length(t))))
    made = all_made = F.array(text)
    for _ in range(edits):
        made = F.array_distinct(F.flatten(F.transform(made, drop)))
        all_made = F.concat(all_made, made)
    return F.array_distinct(all_made)


def _cores(members: DataFrame) -> DataFrame:
    """Members of groups ``key`` (``_left`` and ``_right`` of the shared
    segment) without what all members share at the ends of either side."""
    model = members.groupBy("key").agg(F.min(F.struct("_h", "_left", "_right")).alias("m")).select(
        "key", F.col("m._left").alias("_ml"), F.col("m._right").alias("_mr"))
    near = members.join(model, "key")
    for side, own, other in (("l", "_left", "_ml"), ("r", "_right", "_mr")):
        # The model, and what equals it, would leave nothing for the end.
        least = F.when(F.col(own) != F.col(other), F.least(F.length(own), F.length(other)))
        near = near.withColumn(f"_{side}p", F.when(least.isNotNull(), shared_start(F.col(own), F.col(other), least)))
        near = near.withColumn(f"_{side}s", F.when(least.isNotNull(), shared_end(F.col(own), F.col(other), least - F.col(f"_{side}p"))))
    common = near.groupBy("key").agg(*[F.coalesce(F.min(f"_{side}p"), F.max(F.length(own))).alias(f"_{side}p_all") for side, own in (("l", "_left"), ("r", "_right"))],
                                     *[F.coalesce(F.min(f"_{side}s"), F.lit(0)).alias(f"_{side}s_all") for side in "lr"])
    cut = lambda text, p, s: F.substr(F.col(text), F.col(p) + 1, F.length(text) - F.col(p) - F.col(s))
    return members.join(common, "key").select(
        F.col("key").alias("_of"), "_h", "_len", "_bits",
        F.concat(cut("_left", "_lp_all", "_ls_all"), F.lit(_BETWEEN), cut("_right", "_rp_all", "_rs_all")).alias("_line")).distinct()


def candidate_pairs(lines: DataFrame, edits: int, hot: int) -> DataFrame:
    """Pairs ``a, a_len, b, b_len`` of unlike lines (``_h, _len, _bits,
    _line``) that may be within ``edits``: all that are, and few others."""
    lines = lines.withColumn("_of", F.lit(0).cast("long")).withColumn("_line", F.col("_line").cast("binary"))
    side = lambda df, s: df.select("key", F.struct("_len", "_h").alias(s), F.col("_bits").alias(f"_{s}"), F.col("_bytes").alias(f"_n{s}"))
    found = []

    def meet(index: DataFrame, probes: DataFrame) -> None:
        # Texts of one length meet in both orders, others only as they probe.
        unlike = F.when((F.col("_nx") == F.col("_ny")) | F.lit(index is probes), F.col("x") < F.col("y")).otherwise(F.col("x") != F.col("y"))
        close = F.bit_count(F.col("_x").bitwiseXOR(F.col("_y"))) <= 2 * edits
        found.append(side(index, "x").join(side(probes, "y"), "key").where(unlike & close)
                     .select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")))

    while True:
        lines = lines.withColumn("_item", F.xxhash64("_of", "_h", "_len", "_line"))
        keys = landed(with_keys(lines, edits), "line-keys")
        crowded = keys.where("own").groupBy("key").agg(F.count("*").alias("_n")).where(F.col("_n") > hot).select("key")
        crowded = landed(crowded, "hot-keys")
        some = not crowded.isEmpty()
        few = keys.join(crowded, "key", "left_anti") if some else keys
        meet(few.where("own"), few)
        if not some:
            break
        members = keys.join(crowded, "key", "left_semi").select("key", "_item", "_at", "_size").join(lines, "_item").select(
            "key", "_h", "_len", "_bits", F.substr("_line", F.lit(1), F.col("_at") - 1).alias("_left"),
            F.substr("_line", F.col("_at") + F.col("_size"), F.octet_length("_line")).alias("_right"))
        cores = landed(_cores(landed(members, "line-family")), "line-cores")
        size = F.octet_length("_line")
        short = cores.where(size <= CORE_BYTES).select("_of", "_h", "_len", "_bits", F.explode(deletions(F.col("_line"), edits)).alias("_left"))
        short = short.select(F.xxhash64("_of", "_left").alias("key"), "_h", "_len", "_bits", F.lit(0).alias("_bytes"))
        meet(short, short)
        lines = cores.where(size > CORE_BYTES - edits)
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    return pairs.distinct().select(F.col("x._h").alias("a"), F.col("x._len").alias("a_len"), F.col("y._h").alias("b"), F.col("y._len").alias("b_len"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_edits: int = 2,
               min_bytes: int = 30, keep: tuple[str, ...] = (), edit_bytes: int | None = None, hot: int = 512) -> DataFrame:
    """One row per input row: ``id_col``, ``n_lines``, ``n_removed``,
    ``n_links`` (pairs of its distinct lines with other lines within the
    distance), ``class_id`` (least id holding a line equal or linked to one of
    its own), ``kept`` (the text without the removed lines) and the columns
    ``keep``.

    Lines are what ``\\n`` separates.  A line of at least ``min_bytes`` bytes
    goes if, in order of (id, line number), an equal line or one at an edit
    distance of at most ``max_edits`` occurs earlier, removed or not.  Only
    lines of at least ``edit_bytes`` (``min_bytes`` unless given) are linked
    by edits; below it lines of white space stay, as do all lines shorter
    than ``min_bytes``.  Equality is by 64-bit hash and length.  A segment that
    more than ``hot`` lines hold pairs none of them by itself; the result does
    not depend on it.

    A null text has no lines and stays null; an empty text has one, which
    stays.  Null ids come last in the order.  Rows that are repeated whole are
    judged as one and all returned; an empty table gives no rows.
    """
    edit_bytes = min_bytes if edit_bytes is None else edit_bytes
    if not 0 <= max_edits <= 3 or edit_bytes <= max_edits or edit_bytes < min_bytes:
        raise ValueError("max_edits must be 0 to 3 and less than edit_bytes, and min_bytes at most edit_bytes")
    kept_cols = [F.col(c) for c in keep]
    last = F.lit((1 << 63) - 1)
    every = [F.col(id_col), F.col(text_col), *kept_cols]
    marks = [c.isNull() for c in every]  # a hash passes over nulls
    row_key = [F.xxhash64(*every, *marks).alias("_k"), F.xxhash64(F.lit(1), *every, *marks).alias("_g")]
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"), *row_key)
    lines = F.split("_t", "\n")
    found = (rows.select(F.coalesce("_id", last).alias("_o"), "_k", "_g", F.posexplode(lines).alias("_n", "_line"))
             .where((F.octet_length("_line") >= edit_bytes) | (F.octet_length("_line") >= min_bytes) & F.col("_line").rlike(r"\S"))
             .select("_o", "_k", "_g", "_n", F.xxhash64("_line").alias("_h"), F.octet_length("_line").alias("_len")))
    found = landed(found, "line-places")
    # One row per distinct line: where it occurs first, and how often.
    distinct = landed(found.groupBy("_h", "_len").agg(F.min(F.struct("_o", "_n", "_k", "_g")).alias("f"), F.count("*").alias("_times"))
                      .select("_h", "_len", "_times", "f.*"), "lines")

    def texts(wanted: DataFrame) -> DataFrame:
        """The wanted distinct lines (rows of ``distinct``) with their text."""
        places = (wanted.groupBy("_k", "_g").agg(F.collect_list(F.struct("_n", "_h", "_len")).alias("_p"))
                  .withColumnRenamed("_k", "_pk").withColumnRenamed("_g", "_pg"))
        held = rows.join(places.hint("shuffle_hash"), (F.col("_k") == F.col("_pk")) & (F.col("_g") == F.col("_pg")), "left")
        own = _bound(F.struct(lines.alias("l"), F.col("_p").alias("p"), F.col("_id").alias("id")), lambda r: F.transform(r["p"], lambda p: F.struct(
            p["_h"].alias("_h"), p["_len"].alias("_len"), F.get(r["l"], p["_n"]).alias("_line"), r["id"].alias("_id"))))
        # Of rows that are repeated whole, one; they share a partition already.
        single = held.where("_p is not null").withColumn("_r", F.row_number().over(W.partitionBy("_k", "_g").orderBy("_k"))).where("_r = 1")
        return single.select(F.explode(own).alias("l")).select("l.*")

    if max_edits:
        # Lines that share a segment with another line; no pair is made yet.
        keys = with_keys(texts(distinct.where(F.col("_len") >= edit_bytes)).select("_h", "_len", "_line"), max_edits)
        same = W.partitionBy("key")
        other = lambda h: (F.min(h).over(same) != F.col("_h")) | (F.max(h).over(same) != F.col("_h"))
        shared = (keys.select("key", "_h", "own", F.when(F.col("own"), F.col("_h")).alias("_x"))
                  .withColumn("_live", F.when(F.col("own"), other("_h")).otherwise(other("_x"))).where("_live").select("_h").distinct())
        near_lines = landed(texts(distinct.where(F.col("_len") >= edit_bytes).join(shared, "_h", "left_semi")).select("_h", "_len", "_line", parity(F.col("_line")).alias("_bits")), "near-lines")
        pairs = candidate_pairs(near_lines, max_edits, hot)
        a = near_lines.select(F.col("_h").alias("a"), F.col("_len").alias("a_len"), F.col("_line").cast("binary").alias("a_line"))
        b = near_lines.select(F.col("_h").alias("b"), F.col("_len").alias("b_len"), F.col("_line").cast("binary").alias("b_line"))
        linked = landed(pairs.join(a, ["a", "a_len"]).join(b, ["b", "b_len"]).where(within_edits(F.col("a_line"), F.col("b_line"), max_edits))
                        .select("a", "a_len", "b", "b_len"), "line-links")
        both = linked.select(F.col("a").alias("_h"), F.col("a_len").alias("_len"), F.col("b").alias("h2"), F.col("b_len").alias("len2")).unionByName(
            linked.select(F.col("b").alias("_h"), F.col("b_len").alias("_len"), F.col("a").alias("h2"), F.col("a_len").alias("len2")))
        firsts = distinct.select(F.col("_h").alias("h2"), F.col("_len").alias("len2"), F.struct("_o", "_n").alias("f2"))
        near = both.join(firsts, ["h2", "len2"]).groupBy("_h", "_len").agg(F.min("f2").alias("f2"), F.count("*").alias("_links"))
    else:
        near = distinct.select("_h", "_len", F.struct("_o", "_n").alias("f2"), F.lit(0).cast("long").alias("_links")).where(F.lit(False))
    first = (distinct.join(near, ["_h", "_len"], "left").where("_times > 1 or f2 is not null")
             .select("_h", "_len", F.least(F.struct("_o", "_n"), "f2").alias("_first"), F.coalesce("_links", F.lit(0)).alias("_links")))
    gone = F.col("_first") < F.struct("_o", "_n")
    per_row = (found.join(first, ["_h", "_len"]).groupBy("_k", "_g").agg(
        F.collect_set(F.when(gone, F.col("_n"))).alias("_gone"), F.collect_set(F.struct("_h", "_len", "_links")).alias("_l"),
        F.min(F.col("_first")["_o"]).alias("_class"))
        .select(F.col("_k").alias("_pk"), F.col("_g").alias("_pg"), "_gone", "_class",
                F.aggregate("_l", F.lit(0).cast("long"), lambda s, x: s + x["_links"]).alias("n_links")))
    out = rows.join(per_row.hint("shuffle_hash"), (F.col("_k") == F.col("_pk")) & (F.col("_g") == F.col("_pg")), "left")
    some_gone = F.size("_gone") > 0  # null where nothing was found
    kept = _bound(lines, lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("_gone")), lambda i: F.get(x, i)), "\n"))
    n_lines = F.octet_length("_t") - F.octet_length(F.replace("_t", F.lit("\n"), F.lit(""))) + 1
    out = out.select(F.col("_id").alias(id_col), F.coalesce(n_lines, F.lit(0)).cast("long").alias("n_lines"),
                     F.coalesce(F.when(some_gone, F.size("_gone")), F.lit(0)).cast("long").alias("n_removed"),
                     F.coalesce("n_links", F.lit(0)).alias("n_links"),
                     F.least("_id", F.when(F.col("_class") < last, F.col("_class"))).alias("class_id"),
                     F.when(some_gone, kept).otherwise(F.col("_t")).alias("kept"),
                     *([F.col("_k"), F.col("_g")] if keep else []))
    if not keep:
        return out
    others = docs.select(*row_key, *kept_cols).distinct()
    return out.join(others, ["_k", "_g"]).drop("_k", "_g")
