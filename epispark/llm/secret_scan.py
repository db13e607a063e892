"""Secrets in text: fixed patterns, and Markov models of strings (operator 6)."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from epispark.llm.common import map_batches, text_slices

# The patterns of the contract, with the least length of group 2
# (assign) or of the match.  Letters of assign match in either case, ASCII only.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
STRING = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
_NAME = re.compile(r"[A-Za-z0-9+/_.=-]{6,}")
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_CODE = np.full(128, -1)
_CODE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))
# Byte classes for quick tests of whether a text can hold a long run at all.
_HEX_RUN = bytes(120 if chr(b) in "0123456789abcdef" else 32 for b in range(256))
_STRING_RUN = bytes(120 if chr(b) in ALPHABET else 32 for b in range(256))


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, place of the kind in KINDS, end, value) of the fixed patterns,
    leftmost and non-overlapping per kind, by start and kind."""
    found = []
    lowered = text.lower()
    if any(k in lowered for k in _KEYWORDS):
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if b"x" * 32 in text.encode("utf-8", "surrogatepass").translate(_HEX_RUN):
        found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text) if m.end() - m.start() >= 32]
    return sorted(found)


def _pairs(value: str) -> np.ndarray:
    """Codes of neighbouring characters; the first follows a start state."""
    codes = _CODE[np.frombuffer(value.encode("ascii"), np.uint8)]
    return np.r_[len(ALPHABET), codes[:-1]] * len(ALPHABET) + codes


def learn(counts: dict[str, np.ndarray]) -> np.ndarray:
    """Log-likelihood ratio, random over ordinary, of each character pair.
    Pairs are smoothed towards the single characters' shares, and those
    towards uniform, which is what a model without samples is."""
    n = len(ALPHABET)
    logs = []
    for kind in ("random", "ordinary"):
        m = counts[kind].reshape(n + 1, n)
        single = (m.sum(axis=0) + 0.5) / (m.sum() + 0.5 * n)
        logs.append(np.log((m + 4 * single) / (m.sum(axis=1, keepdims=True) + 4)))
    return (logs[0] - logs[1]).ravel()


def _labelled(text: str) -> tuple[list[str], list[str]]:
    """The strings that a text labels: values of the fixed patterns are
    random, other names (six or more characters, outside them) ordinary."""
    spans = base_spans(text)
    taken = [(s, e) for s, _, e, _ in spans]
    names = [m[0] for m in _NAME.finditer(text) if not any(m.start() < e and s < m.end() for s, e in taken)]
    return sorted({v for *_, v in spans}), names


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", documents: int = 4000) -> np.ndarray:
    """Pair ratios from the labelled strings of at most ``documents`` texts
    (the least hashes of id and text)."""
    marked = docs.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("_t"), F.xxhash64(id_col, text_col).alias("_h"))
    most = marked.select("_h").orderBy("_h").limit(documents).agg(F.max("_h")).first()[0]
    size = (len(ALPHABET) + 1) * len(ALPHABET)
    counts = {"random": np.zeros(size), "ordinary": np.zeros(size)}
    if most is None:
        return learn(counts)

    def count(batches):
        own = {k: np.zeros(size, np.int64) for k in counts}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for kind, strings in zip(("random", "ordinary"), _labelled(text)):
                    for s in strings:
                        np.add.at(own[kind], _pairs(s), 1)
        for kind, c in own.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_pydict({"kind": pa.array([kind] * len(at), pa.string()), "pair": pa.array(at, pa.int64()), "n": pa.array(c[at], pa.int64())})

    sample = marked.where(F.col("_h") <= F.lit(most)).select("_t").limit(documents)
    rows = map_batches(sample, count, "kind string, pair long, n long").groupBy("kind", "pair").agg(F.sum("n").alias("n"))
    for kind, pair, n in rows.collect():  # at most two rows per character pair
        counts[kind][pair] = n
    return learn(counts)


def scan_text(text: str, ratios: np.ndarray, least: float = 0.5) -> list[tuple[int, int, int]]:
    """(start, place of the kind, end): the fixed patterns' spans, and strings
    of 16 or more characters, or what the spans leave of them if that is as
    long, whose mean log-likelihood ratio per character is at least ``least``."""
    spans = [(s, k, e) for s, k, e, _ in base_spans(text)]
    if b"x" * 16 in text.encode("utf-8", "surrogatepass").translate(_STRING_RUN):
        found = []
        for m in STRING.finditer(text):
            at, end = m.span()
            for s, _, e in [x for x in spans if x[0] < end and at < x[2]] + [(end, 3, end)]:
                if s - at >= 16 and ratios[_pairs(text[at:s])].mean() >= least:
                    found.append((at, 3, s))
                at = max(at, e)
        spans += found
    return sorted(spans)


def _text(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5,
                documents: int = 4000) -> DataFrame:
    """One row per input row: ``id_col``, ``n_assign``, ``n_access``,
    ``n_hex``, ``n_markov``, ``base`` and ``spans`` (``kind:start:end``, code
    points, end exclusive, by start and then kind, comma-joined).

    A null or empty text has no spans.  Whole texts are scanned, each in one
    task; repeated rows give repeated rows, an empty table none.  The two
    Markov models are learned from a bounded sample (see ``train``).
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, id_col, text_col, documents))  # one table of character pairs

    def run(batches):
        for batch in text_slices(batches, "_t"):
            made = [scan_text(t or "", shared.value, least) for t in batch.column(1).to_pylist()]
            counts = [pa.array([sum(k == kind for _, k, _ in m) for m in made], pa.int64()) for kind in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, pa.array([_text([x for x in m if x[1] < 3]) for m in made], pa.string()),
                 pa.array([_text(m) for m in made], pa.string())],
                names=[id_col, "n_assign", "n_access", "n_hex", "n_markov", "base", "spans"])

    source = docs.select(id_col, F.col(text_col).alias("_t"))
    schema = T.StructType([source.schema[0], *[T.StructField(f"n_{k}", T.LongType()) for k in KINDS],
                           T.StructField("base", T.StringType()), T.StructField("spans", T.StringType())])
    return map_batches(source, run, schema)
