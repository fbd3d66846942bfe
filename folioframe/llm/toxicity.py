"""Toxicity of deobfuscated text: a noisy channel, a character language model and a learned lexicon (operator 10)."""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import mapped, saved

#: Letters that a sign can stand for (fixed values of the channel).
SIGNS = {"0": "o", "1": "il", "!": "i", "|": "il", "3": "e", "4": "a", "@": "a", "5": "s", "$": "s", "7": "t", "+": "t", "8": "b", "9": "g", "6": "gb", "2": "z", "(": "c"}
#: Letters of other scripts that look like Latin ones, and signs without width.
LOOKALIKES = str.maketrans("аеорсхуіј", "aeopcxyij", "​‌‍⁠﻿­")
#: Natural logarithms of the channel's probabilities, negated: a sign for a letter, a sign for nothing, a letter said again.
COST_SIGN, COST_NOISE, COST_AGAIN = 1.0, 4.0, 0.3
#: The same for what stands between spaced letters: nothing, or a space between words.
COST_JOIN, COST_SPACE = 0.5, 2.0
#: Symbols of the language model: 0 for white space, 1 to 26 for letters, 27 for the rest.
SYMBOLS = 28
SYMBOL = np.full(256, 27, np.int64)
SYMBOL[list(b" \t\n\r\x0b\x0c")] = 0
SYMBOL[np.arange(97, 123)] = np.arange(1, 27)
#: Labelled rows that the lexicon is learned from at most, by ascending hash of the id.
LABELLED = 20_000
#: Toxic texts that a sign stands in at least, and the least share of toxic ones among all texts with it.
LEAST_TEXTS, LEAST_SHARE = 4, 0.5
#: Share of the toxic texts that a sign is the strongest sign of, or that a nearly faultless sign stands in.
LEAST_CREDIT, CLEAR = 0.01, 0.05
#: Letters of the shortest and the longest stem.
STEM = 4, 8
#: How often a word or stem stands in a text counts in these steps.
STEPS = 2, 3, 5
THRESHOLD = 0.7
#: Words that a worker keeps the restored forms of.
KEPT = 600_000

EDGES = ".,;:!?\"'()[]{}<>«»„“”…"
#: Signs said twice or more at an end of a word.
ORNAMENT = re.compile(r"^([^\w\s])\1+|([^\w\s])\2+$")
AGAIN = re.compile(r"([a-z])\1\1")
ODD = re.compile(r"[^a-zª-￿.,;:!?\"'()\[\]{}<>-]|[a-z][^a-zª-￿]+[a-z]")
#: Three or more single characters with one separator between each two: i d i o t, i.d.i.o.t
SPACED = re.compile(r"(?<![^\s])[a-z0-9@$!|](?:([ .\-_*~/,])[a-z0-9@$!|])(?:\1[a-z0-9@$!|])+(?![^\s.,;:!?])")


def trigram_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Symbol trigrams of every whole text; a partition sends its table of fixed size, Spark sums the tables."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(SYMBOLS**3, np.int64)
        for b in batches:
            for text in b.column(0).cast(pa.large_binary()):
                if not text.is_valid:
                    continue
                s = np.concatenate([[0, 0], SYMBOL[np.frombuffer(text.as_py().lower(), np.uint8)], [0]])
                n += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)
        k = np.nonzero(n)[0]
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(n[k])], ["gram", "n"])

    found = mapped(docs.select(F.col(text_col).cast("string")), count, "gram int, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SYMBOLS**3, np.int64)
    out[found.column("gram").to_numpy()] = found.column("n").to_numpy()
    return out.reshape(SYMBOLS, SYMBOLS, SYMBOLS)


def log_probabilities(counts: np.ndarray) -> np.ndarray:
    """log P(third | first two), each order smoothed with the one below."""
    one = (counts.sum((0, 1)) + 1.0) / (counts.sum() + SYMBOLS)
    two = counts.sum(0)
    two = (two + 5 * one) / (two.sum(1, keepdims=True) + 5)
    return np.log((counts + 5 * two) / (counts.sum(2, keepdims=True) + 5))


class Channel:
    """Restores words with the language model; the best letters of a lattice by Viterbi's algorithm."""

    def __init__(self, logs: np.ndarray):
        self.logs = logs.tolist()

    def choices(self, word: str) -> Iterator[list[tuple[int | None, float, str]]]:
        """For each run of a sign or letter: the symbols it can stand for (None: nothing), and the cost."""
        for m in re.finditer(r"(.)\1*", word, re.S):
            sign, n = m[1], len(m[0])
            if "a" <= sign <= "z":
                k = ord(sign) - 96
                yield [(k, 0.0, sign)]
                for _ in range(min(n, 3) - 1):  # of three and more, one or two may be meant
                    yield [(k, 0.0, sign), (None, COST_AGAIN, "")] if n > 2 else [(k, 0.0, sign)]
            elif sign in SIGNS:
                inside = m.end() < len(word)  # at the end a sign may mean nothing
                for i in range(min(n, 3)):
                    nothing = [(None, COST_AGAIN, "")] if i and n > 2 else [] if inside else [(None, COST_NOISE, "")]
                    yield [(ord(x) - 96, COST_SIGN, x) for x in SIGNS[sign]] + nothing
            elif sign.isalnum():
                yield from [[(27, 0.0, sign)]] * min(n, 2)
            else:
                yield [(None, 0.0, "")]

    def spaced(self, letters: str) -> Iterator[list[tuple[int | None, float, str]]]:
        """The same for spaced letters: between each two, nothing or a space."""
        for k, sign in enumerate(letters):
            if k:
                yield [(None, COST_JOIN, ""), (0, COST_SPACE, " ")]
            if "a" <= sign <= "z":
                yield [(ord(sign) - 96, 0.0, sign)]
            elif sign in SIGNS:
                yield [(ord(x) - 96, COST_SIGN, x) for x in SIGNS[sign]]
            else:
                yield [(27, 0.0, sign)]

    def likeliest(self, lattice: Iterator[list[tuple[int | None, float, str]]]) -> str:
        """The best path by Viterbi's algorithm; a state is the last two symbols."""
        best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for options in lattice:
            new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (score, path) in best.items():
                row = self.logs[a][b]
                for k, cost, letter in options:
                    to, s, p = ((a, b), score - cost, path) if k is None else ((b, k), score + row[k] - cost, (letter, path))
                    if to not in new or new[to][0] < s:
                        new[to] = s, p
            best = new
        path = max(((s + self.logs[a][b][0], p) for (a, b), (s, p) in best.items()), key=lambda x: x[0])[1]
        letters = []
        while path:
            letters.append(path[0])
            path = path[1]
        return "".join(reversed(letters))

    def restore(self, word: str) -> str:
        return self.likeliest(self.choices(word))

    def restore_spaced(self, letters: str) -> list[str]:
        return self.likeliest(self.spaced(letters)).split()


class Restorer(dict):
    """Restored form by lower-case word."""

    def __init__(self, channel: Channel):
        self.channel = channel

    def __missing__(self, word: str) -> str:
        plain = word
        if not word.isascii():  # look-alikes and full-width forms
            plain = unicodedata.normalize("NFKC", word.translate(LOOKALIKES)).lower()
        core = ORNAMENT.sub("", plain).strip(EDGES)
        odd = AGAIN.search(core) or ODD.search(core)
        if odd and re.search("[a-z]", core) and len(core) > 2:
            core = self.channel.restore(core)
        if len(self) < KEPT:
            self[word] = core
        return core

    def words(self, text: str) -> list[str]:
        """Restored words of a text, runs of spaced single characters as one word beside the others."""
        low = text.lower()
        out = list(map(self.__getitem__, low.split()))
        for m in SPACED.finditer(low):
            letters = m[0][::2]
            if re.search("[a-z]", letters):
                found = self.channel.restore_spaced(letters)
                out += [x for x in found if len(x) > 2]
        return out


def signs(word: str) -> list[str]:
    """The word itself, and its beginnings, so that one stem is known in all its forms."""
    return [word, *(word[:k] + "*" for k in range(STEM[0], min(len(word), STEM[1] + 1)))] if word else []


def features(restored: list[str]) -> set[str]:
    """What a text shows: its words and stems, and with a number those that come so often or more."""
    n = Counter(restored)
    stems: Counter[str] = Counter()
    for w, k in n.items():
        for x in signs(w):
            stems[x] += k
    return stems.keys() | {f"{x}{step}" for x, k in stems.items() if k > 1 for step in STEPS if k >= step}


def family(restored: list[str]) -> int:
    """Least hash of a text's four-word shingles: near copies mostly share it."""
    return min((zlib.crc32(" ".join(restored[i : i + 4]).encode()) for i in range(max(1, len(restored) - 3))), default=0)


def lexicon(labelled: DataFrame, logs: np.ndarray, *, text_col: str = "text", label_col: str = "toxic") -> tuple[dict[str, float], float]:
    """(sign -> probability of toxicity, probability without any sign), learned from labelled rows.

    Copies count once: of rows with one label and one family one stays. A sign is kept if its share of
    toxic texts, smoothed, reaches LEAST_SHARE and if it is clear: either the strongest sign of
    LEAST_CREDIT of the toxic texts, or one that stands in CLEAR of them and nearly nowhere else. The
    labelled rows are bounded, and so is what comes to the driver: signs of LEAST_CREDIT of the toxic
    texts, counted.
    """
    sent = labelled.sparkSession.sparkContext.broadcast(logs)

    def restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(Channel(sent.value))
        for b in batches:
            rows = [restorer.words(x or "") for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(list(map(family, rows)), pa.int64()), pa.array([" ".join(w) for w in rows], pa.string())], ["label", "family", "words"])

    rows = mapped(labelled.select(text_col, F.col(label_col).cast("int")), restored, "label int, family bigint, words string")
    rows = saved(rows.groupBy("label", "family").agg(F.min("words").alias("words")), "labelled")
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    n_bad, n_good = sizes.get(1, 0), sizes.get(0, 0)
    if not n_bad or not n_good:
        return {}, float(n_bad > 0)

    def counted(wanted=None):
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n: Counter[str] = Counter()
            for b in batches:
                for x in b.column(0).to_pylist():
                    found = features((x or "").split())
                    n.update(found if wanted is None else found & wanted.value.keys())
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["sign", "n"])

        return count

    toxic = rows.where("label = 1").select("words")
    least = max(LEAST_TEXTS, LEAST_CREDIT * n_bad)
    bad = {r[0]: r[1] for r in mapped(toxic, counted(), "sign string, n bigint").groupBy("sign").agg(F.sum("n").alias("n")).where(F.col("n") >= least).toLocalIterator()}
    wanted = labelled.sparkSession.sparkContext.broadcast(bad)
    good = {r[0]: r[1] for r in mapped(rows.where("label = 0").select("words"), counted(wanted), "sign string, n bigint").groupBy("sign").agg(F.sum("n").alias("n")).toLocalIterator()}
    share = {x: (n + 0.5) / (n + good.get(x, 0) + 1) for x, n in bad.items()}
    strength = labelled.sparkSession.sparkContext.broadcast({x: (bad[x] * p, x) for x, p in share.items() if p >= LEAST_SHARE})

    def strongest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = strength.value
        for b in batches:
            best = [max((known[x] for x in features((t or "").split()) & known.keys()), default=(0, None))[1] for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(best, pa.string())], ["sign"])

    credit = {r["sign"]: r["count"] for r in mapped(toxic, strongest, "sign string").groupBy("sign").count().toLocalIterator()}
    kept = {x: p for x, p in share.items() if p >= LEAST_SHARE and (credit.get(x, 0) >= least or p >= 0.9 and bad[x] >= CLEAR * n_bad)}
    return kept, credit.get(None, 0) / (credit.get(None, 0) + n_good)


class Scorer:
    """Scores of texts: the surest sign's probability."""

    def __init__(self, logs: np.ndarray, lexicon: dict[str, float], rest: float):
        self.restorer, self.lexicon, self.rest = Restorer(Channel(logs)), lexicon, rest
        self.stems = {x.rstrip("".join(map(str, STEPS))) for x in lexicon}
        self.known: dict[str, tuple[str, ...]] = {}

    def score(self, text: str) -> float:
        seen: Counter[str] = Counter()
        for w in self.restorer.words(text):
            if (hits := self.known.get(w)) is None:
                hits = tuple(x for x in signs(w) if x in self.stems)
                if len(self.known) < KEPT:
                    self.known[w] = hits
            if hits:
                seen.update(hits)
        get = self.lexicon.get
        return max([self.rest, *(get(x, 0.0) for x in seen), *(get(f"{x}{step}", 0.0) for x, k in seen.items() for step in STEPS if k >= step)])


def score_texts(docs: DataFrame, logs: np.ndarray, signs: dict[str, float], rest: float, *, text_col: str = "text") -> DataFrame:
    """docs with _score: the probability of the surest sign in the text, `rest` without one."""
    sent = docs.sparkSession.sparkContext.broadcast((logs, signs))
    at = docs.columns.index(text_col)
    schema = StructType(list(docs.schema.fields)).add("_score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*sent.value, rest)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([scorer.score(x or "") for x in b.column(at).to_pylist()], pa.float64())], schema.names)

    return mapped(docs, run, schema)


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", labelled: int = LABELLED) -> DataFrame:
    """(id, held_out, score, predicted) per row of docs.

    The character model counts every text of docs; the lexicon is learned from at most `labelled` rows
    of labels that aren't held out, those with the least hash of the id; null labels, other labels than
    0 and 1, and ids with several labels are left out. Null and empty texts get the score of a text
    without any sign. A null id is not held out. Other columns are ignored; without usable labels
    every score is 0, or 0.5 if all are toxic. Very long texts are read whole; a word's lattice grows with
    its length alone.
    """
    logs = log_probabilities(trigram_counts(docs, text_col))
    known = labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").alias("_label_id")).agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most"))
    chosen = known.where("toxic = most").orderBy(F.xxhash64("_label_id"), "_label_id").limit(labelled).select("_label_id", "toxic")
    rows = docs.select(F.col(id_col).alias("_label_id"), F.col(text_col).cast("string").alias("_text")).join(chosen, "_label_id")
    found, share = lexicon(rows, logs, text_col="_text")
    rest = min(share, 0.5)
    scored = score_texts(docs.select(id_col, F.col(text_col).cast("string").alias("_text")), logs, found, rest, text_col="_text")
    return scored.select(id_col, held_out(F.col(id_col)).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
