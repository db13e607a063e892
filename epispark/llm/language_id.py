"""Language identification by words, backing off to characters (operator 4)."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql import types as T

from epispark.llm.common import landed, map_batches, text_slices

_LETTERS = re.compile(r"[^\W\d_]+")
MOST_GRAM = 5
MOST_HELD = 200_000  # distinct words or grams that a task counts before it passes them on


def letter_words(text: str) -> list[str]:
    """Lower-cased runs of letters."""
    return _LETTERS.findall(text.lower())


def word_grams(word: str, n: int) -> list[str]:
    edged = f"<{word}>"
    return [edged[i:i + n] for i in range(len(edged) - n + 1)]


class Model:
    """Log frequencies per language of words and of 1- to 5-character grams.

    ``words`` and ``grams`` are ``(keys, key numbers, language numbers,
    counts)`` of the counts that are not 0.  A log frequency is add-half
    smoothed over the keys of its kind; held are its excesses over that of a
    count of 0, so the size follows the counts and not keys times languages.
    """

    def __init__(self, languages: list[str], words: tuple, grams: tuple):
        self.languages = languages
        self.words = {k: i for i, k in enumerate(words[0])}
        self.grams = {k: i + len(words[0]) for i, k in enumerate(grams[0])}
        row = np.concatenate([words[1], grams[1] + len(words[0])])
        order = np.argsort(row, kind="stable")
        self.first = np.searchsorted(row[order], np.arange(len(words[0]) + len(grams[0]) + 1))
        self.language = np.concatenate([words[2], grams[2]])[order]
        self.counts = np.concatenate([words[3], grams[3]])[order].astype(float)
        self.excess = np.log(self.counts + 0.5) - math.log(0.5)
        self.base = [math.log(0.5) - np.log(np.bincount(k[2], weights=k[3], minlength=len(languages)) + 0.5 * len(k[0]))
                     if len(k[0]) else np.zeros(len(languages)) for k in (words, grams)]
        self.unseen: dict[str, list[int]] = {}
        self.near: list[dict[str, float] | None] = [None] * len(languages)
        self.fits: list[dict[str, tuple[float, int]]] = [{} for _ in languages]

    def _known_grams(self, word: str) -> list[int]:
        """Rows of an unseen word's known grams, of the longest length that
        has any."""
        edged, get = f"<{word}>", self.grams.get
        for n in range(MOST_GRAM, 0, -1):
            if rows := [g for i in range(len(edged) - n + 1) if (g := get(edged[i:i + n])) is not None]:
                return rows
        return []

    def predict(self, text: str | None) -> tuple[str, float]:
        """The best language and its share of the likelihood.  A known word
        adds its logs, an unseen one the mean logs of its known grams."""
        words = Counter(letter_words(text or ""))
        if not any(c.isalpha() for w in words for c in w) or not self.languages:
            return "und", 0.0
        rows, times, known, backed = [], [], 0, 0
        get, unseen = self.words.get, self.unseen
        for word, n in words.items():
            if (row := get(word)) is not None:
                rows.append(row)
                times.append(n)
                known += n
                continue
            if (grams := unseen.get(word)) is None:
                if len(unseen) > 100_000:
                    unseen.clear()
                grams = unseen[word] = self._known_grams(word)
            if grams:
                rows += grams
                times += [n / len(grams)] * len(grams)
                backed += n
        row = np.array(rows, dtype=np.int64)
        many = self.first[row + 1] - self.first[row]
        at = np.repeat(self.first[row] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
        total = known * self.base[0] + backed * self.base[1] + np.bincount(
            self.language[at], weights=np.repeat(times, many) * self.excess[at], minlength=len(self.languages))
        best = int(np.argmax(total))
        return self.languages[best], float(1 / np.exp(total - total[best]).sum())

    def _own(self, language: int) -> dict[str, float]:
        """The language's counts of grams of up to three characters."""
        if (own := self.near[language]) is None:
            own = self.near[language] = {}
            for gram, i in self.grams.items():
                if len(gram) <= 3:
                    held = self.language[self.first[i]:self.first[i + 1]]
                    if len(at := np.flatnonzero(held == language)):
                        own[gram] = float(self.counts[self.first[i] + at[0]])
            own[""] = sum(n for gram, n in own.items() if len(gram) == 1)
        return own

    def fit(self, text: str | None, lang: str) -> float:
        """Mean log-likelihood of a character of the text's words after the
        two before it, in one language, backing off to one and none; it does
        not depend on the text's length."""
        language = self.languages.index(lang)
        own, times_of = self.fits[language], self._own(language).get
        total, n = 0.0, 0
        for word, times in Counter(letter_words(text or "")).items():
            if (found := own.get(word)) is None:
                if len(own) > 100_000:
                    own.clear()
                edged, logs = f"<{word}>", 0.0
                for i in range(len(edged) - 2):
                    a, b, c = edged[i:i + 3]
                    p = (times_of(c, 0.0) + 0.5) / (times_of("") + 100)
                    p = (times_of(b + c, 0.0) + 10 * p) / (times_of(b, 0.0) + 10)
                    p = (times_of(a + b + c, 0.0) + 5 * p) / (times_of(a + b, 0.0) + 5)
                    logs += math.log(p)
                found = own[word] = logs, len(edged) - 2
            total += times * found[0]
            n += times * found[1]
        return total / n if n else -math.inf


def _learnable(docs: DataFrame, id_col: str, lang_col: str) -> DataFrame:
    return docs.where(F.col(lang_col).isNotNull() & (F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) != 2))


def _labelled(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """Language and text of every learnable document; rows repeated whole
    count once.  Only hashes are shuffled, and the texts of repeated rows."""
    marked = _learnable(docs, id_col, lang_col).select(
        F.col(lang_col).alias("_l"), F.col(text_col).alias("_t"), F.xxhash64(id_col, text_col).alias("_h"))
    repeated = landed(marked.groupBy("_l", "_h").agg(F.count("*").alias("_n")).where("_n > 1").select("_l", "_h"), "repeated")
    if repeated.isEmpty():
        return marked.select("_l", "_t")
    once = marked.join(repeated, ["_l", "_h"], "left_semi").dropDuplicates(["_l", "_h"])
    return marked.join(repeated, ["_l", "_h"], "left_anti").unionByName(once).select("_l", "_t")


def _summed(df: DataFrame, found) -> DataFrame:
    """``_l, g, n``: the sums of what ``found`` counts, per row of ``df`` a
    language, a Counter to add to and the row's other columns."""
    def run(batches):
        held: dict[str, Counter] = {}

        def rows():
            flat = [(lang, g, n) for lang, c in held.items() for g, n in c.items()]
            held.clear()
            return pa.RecordBatch.from_pydict({"_l": pa.array([r[0] for r in flat], pa.string()), "g": pa.array([r[1] for r in flat], pa.string()),
                                               "n": pa.array([r[2] for r in flat], pa.int64())})

        for batch in batches:
            for lang, *row in zip(*[c.to_pylist() for c in batch.columns]):
                found(held.setdefault(lang, Counter()), *row)
            if sum(map(len, held.values())) > MOST_HELD:
                yield rows()
        yield rows()

    return map_batches(df, run, "_l string, g string, n long").groupBy("_l", "g").agg(F.sum("n").alias("n"))


def _add_words(counts: Counter, text: str | None) -> None:
    counts.update(letter_words(text or ""))


def _add_grams(counts: Counter, word: str, n: int) -> None:
    grams = [g for size in range(1, MOST_GRAM + 1) for g in word_grams(word, size)]
    if n == 1:  # most distinct words
        counts.update(grams)
        return
    for g in grams:
        counts[g] += n


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          most_words: int = 80_000, most_grams: int = 240_000) -> Model:
    """A model from all learnable documents: their words are counted, then the
    grams of the distinct words.  Every language is learned, and each brings
    an equal share of ``most_words`` words and ``most_grams`` grams, its own
    most frequent ones (one at least), so that a small language keeps its
    words beside a large one.  Documents whose crc32 of the id modulo 4 is 2,
    null languages and null ids are never read.
    """
    words = landed(_summed(_labelled(docs, id_col, text_col, lang_col), _add_words), "words")
    counts = words.select(F.lit(0).alias("kind"), "g", "_l", "n").unionByName(_summed(words, _add_grams).select(F.lit(1).alias("kind"), "g", "_l", "n"))
    counts = landed(counts, "grams")
    languages = sorted(r[0] for r in counts.select("_l").distinct().collect())
    share = F.when(F.col("kind") == 0, -(-most_words // max(len(languages), 1))).otherwise(-(-most_grams // max(len(languages), 1)))
    own = counts.withColumn("_r", F.row_number().over(W.partitionBy("_l", "kind").orderBy(F.desc("n"), "g")))
    chosen = own.where(F.col("_r") <= F.greatest(F.lit(most_words), F.lit(most_grams))).where(F.col("_r") <= share).select("kind", "g").distinct()
    table = counts.join(chosen, ["kind", "g"], "left_semi").toArrow()  # bounded by the two limits and the languages that share a key
    place = {lang: i for i, lang in enumerate(languages)}

    def of_kind(kind: int) -> tuple:
        rows = table.filter(pc.equal(table.column("kind"), kind))
        keys = sorted(pc.unique(rows.column("g")).to_pylist())
        number = {g: i for i, g in enumerate(keys)}
        return (keys, np.array([number[g] for g in rows.column("g").to_pylist()], dtype=np.int64),
                np.array([place[x] for x in rows.column("_l").to_pylist()], dtype=np.int64), rows.column("n").to_numpy())

    return Model(languages, of_kind(0), of_kind(1))


def least_fits(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
               margin: float = 1.5) -> dict[str, float]:
    """Per language the least ``fit`` of its texts, from all documents that
    ``train`` reads: four times as far under their median as the lowest
    twentieth, and at least ``margin``.  The fits are counted to four decimals,
    so that the quantiles of any number of documents need a small table."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            rows = [(lang, shared.value.fit(text, lang)) for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                    if lang in shared.value.languages]
            yield pa.RecordBatch.from_pydict({"_l": pa.array([r[0] for r in rows], pa.string()), "fit": pa.array([r[1] for r in rows], pa.float64())})

    fits = map_batches(_labelled(docs, id_col, text_col, lang_col), run, "_l string, fit double").where(F.col("fit") > -math.inf)
    counted = fits.groupBy("_l", F.round("fit", 4).alias("fit")).agg(F.count("*").alias("n"))
    found = counted.groupBy("_l").agg(F.percentile("fit", F.array(F.lit(0.05), F.lit(0.5)), F.col("n")).alias("q")).collect()
    return {r["_l"]: r.q[1] - max(margin, 4 * (r.q[1] - r.q[0])) for r in found}


def identify(docs: DataFrame, model: Model, id_cols: list[str], text_col: str = "text", with_fit: bool = False) -> DataFrame:
    """``id_cols`` with ``lang_pred`` and ``score`` of every whole text, and
    its ``fit`` in that language if asked for.

    A null text, a text without a letter, or an empty model gives ``und`` and
    0; the score is the predicted language's share of the likelihood.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the model's two limits

    source = docs.select(*id_cols, *([] if text_col in id_cols else [text_col]))

    def run(batches):
        for batch in text_slices(batches, text_col):
            made = [shared.value.predict(t) for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            columns = [pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64())]
            if with_fit:
                texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
                columns.append(pa.array([None if m[0] == "und" else shared.value.fit(t, m[0]) for m, t in zip(made, texts)], pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(id_cols)], *columns], names=[*id_cols, *names])

    names = ["lang_pred", "score", *(["fit"] if with_fit else [])]
    schema = T.StructType([*source.schema.fields[:len(id_cols)], T.StructField("lang_pred", T.StringType()),
                           *[T.StructField(n, T.DoubleType()) for n in names[1:]]])
    return map_batches(source, run, schema)


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **limits) -> DataFrame:
    """Train and predict: ``id_col``, ``held_out``, ``lang_pred``, ``score``.

    Words known from training score by their log frequency in each language;
    other words by their known grams of five characters, or else four, down
    to one.  The language, source and id never enter a prediction.  A null id
    is not held out and not learned from.  One row per input row.
    """
    found = identify(docs, train(docs, id_col, text_col, lang_col, **limits), [id_col], text_col)
    held_out = F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2, F.lit(False))
    return found.select(id_col, held_out.alias("held_out"), "lang_pred", "score")
