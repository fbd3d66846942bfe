"""Language identification by Bayesian fusion of text, markup, address and host evidence (operator 7)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT, dropped, mapped, saved

#: Buckets of byte trigrams.
GRAMS = 1 << 16
#: Trigrams of text that count in full; the likelihood of a longer text weighs as much as this many, so that other evidence is heard.
HEARD = 40
#: Characters of a text whose trigrams are taken at once.
STRIP = 1 << 16
#: Pseudo-counts with which a host leans on its domain, a domain on all pages, and all pages on an even share.
LEAN = 5.0
#: The class of texts in no known language, and its prior share.
UNKNOWN, UNKNOWN_SHARE = "und", 0.01

#: Elements whose content is no text.
DROP = ("script", "style", "noscript", "template")
NAME = re.compile(r"<([A-Za-z][A-Za-z0-9]*)")
CLOSE = re.compile(r"\s*>")
LANG = re.compile(r"\blang\s*=\s*[\"']?([A-Za-z]+)", re.I)
#: Upper-case ASCII letters to lower case: places stay what they are.
LOW = {c: c + 32 for c in range(65, 91)}


def visible(html: str) -> tuple[str, str | None]:
    """(text, declared language) of a page, read from left to right once.

    A tag ends at the next '>'; one without an end is text. Comments and the content of DROP elements go;
    where their end is missing, they are tags like others, and it isn't looked for again.
    """
    low, out, i, declared, endless = html.translate(LOW), [], 0, None, set()
    while (j := html.find("<", i)) >= 0:
        out.append(html[i:j])
        if "!--" not in endless and html.startswith("<!--", j):
            if (k := html.find("-->", j + 4)) >= 0:
                i = k + 3
                out.append(" ")
                continue
            endless.add("!--")
        if (k := html.find(">", j + 1)) < 0:
            i = j
            break
        i = k + 1
        out.append(" ")
        if (m := NAME.match(low, j, k)) is None:
            continue
        name = m[1]
        if name == "html" and declared is None and (m := LANG.search(html, j, k)):
            declared = m[1].lower()
        if name in DROP and name not in endless:
            end = low.find(f"</{name}", i)
            while end >= 0 and (m := CLOSE.match(low, end + len(name) + 2)) is None:
                end = low.find(f"</{name}", end + 1)
            if end < 0:
                endless.add(name)
            else:
                i = m.end()
    out.append(html[i:])
    return unescape("".join(out)), declared


def gram_strips(text: str) -> Iterator[np.ndarray]:
    """Buckets of the byte trigrams of the lower-case letters and spaces of a text, a bounded number at a time; digits and signs become spaces."""
    before = np.full(1, 32, np.uint8)
    for i in range(0, max(1, len(text)), STRIP):
        part = text[i : i + STRIP].lower()
        low = part if part.isascii() else "".join(c if c.isalpha() else " " for c in part)
        last = " " if i + STRIP >= len(text) else ""
        b = np.concatenate([before, np.frombuffer((low + last).encode("utf-8", "replace"), np.uint8)])
        before = b[-2:]
        letter = (b >= 97) & (b <= 122) | (b >= 128)
        b = np.where(letter, b, 32).astype(np.uint32)
        keep = letter[:-2] | letter[1:-1] | letter[2:] if len(b) > 2 else np.zeros(0, bool)
        yield ((b[:-2] * 961 + b[1:-1] * 31 + b[2:]) & (GRAMS - 1))[keep]


def profiles(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages, log P(gram | language)) from every labelled text; the last row is UNKNOWN, all grams alike.

    A partition sends one table of fixed size a language; Spark sums them.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[str, np.ndarray] = {}
        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if text and lang:
                    n.setdefault(lang, np.zeros(GRAMS, np.int64))
                    for g in gram_strips(text):
                        n[lang] += np.bincount(g, minlength=GRAMS)
        for lang, table in n.items():
            k = np.nonzero(table)[0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k)), pa.array(k.astype(np.int32)), pa.array(table[k])], ["lang", "gram", "n"])

    found = mapped(docs.select(F.col(text_col).cast("string"), F.col(lang_col).cast("string")), count, "lang string, gram int, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(found["lang"].unique())
    table = np.zeros((len(langs), GRAMS))
    for k, lang in enumerate(langs):
        part = found[found["lang"] == lang]
        table[k, part["gram"]] = part["n"]
    smooth = (table + 0.1) / (table.sum(1, keepdims=True) + 0.1 * GRAMS)
    return langs + [UNKNOWN], np.log(np.vstack([smooth, np.full((1, GRAMS), 1 / GRAMS)]))


def text_evidence(rows: DataFrame, model: tuple[list[str], np.ndarray], *, markup: bool) -> DataFrame:
    """rows (_id, _text, _declared, ...) with _logs: the tempered log-likelihood by class, and _grams.

    markup: _text is HTML; its visible text is judged and its declared language replaces _declared.
    """
    sent = rows.sparkSession.sparkContext.broadcast(model[1])
    names = rows.columns
    at, said = names.index("_text"), names.index("_declared")
    out = [c for c in names if c != "_text"] + ["_logs", "_grams"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text"), "_logs array<double>, _grams bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for b in batches:
            logs, sizes, declared = [], [], []
            for text, lang in zip(b.column(at).to_pylist(), b.column(said).to_pylist()):
                text = text or ""
                if markup:
                    text, lang = visible(text)
                size, likely = 0, np.zeros(len(table))
                for g in gram_strips(text):
                    size += len(g)
                    likely += table[:, g].sum(1)
                sizes.append(size)
                declared.append(lang.lower() if lang else None)
                logs.append((likely * (min(HEARD, size) / max(1, size))).tolist())
            columns = [pa.array(declared, pa.string()) if k == said else c for k, c in enumerate(b.columns) if k != at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(logs, pa.list_(pa.float64())), pa.array(sizes, pa.int64())], out)

    return mapped(rows, run, schema)


def fuse(judged: DataFrame, langs: list[str]) -> DataFrame:
    """judged (_declared, _host, _domain, _suffix, _logs, _grams) with _lang, _probability, _text_lang.

    Every page votes with the class its text alone makes likeliest. Votes are summed by host, domain
    and overall; each level's shares are smoothed with the next, a page's own vote taken out, so that
    it doesn't confirm itself. How often votes of a class declare a language gives P(declared |
    class), and likewise P(suffix | class). The logs add up; the posterior is normalised over the classes.
    Groups are aggregated before they meet the pages: one row a host and class.
    """
    n = len(langs)
    best = F.array_position("_logs", F.array_max("_logs")).cast("int") - 1
    rows = judged.withColumns({"_vote": F.when(F.col("_grams") > 0, best), **{c: F.coalesce(F.col(c), F.lit("")) for c in ("_declared", "_host", "_domain", "_suffix")}})
    votes = saved(rows.where("_vote is not null").groupBy("_host", "_domain", "_suffix", "_declared", "_vote").agg(F.count("*").alias("n")), "votes")

    def by(*keys: str) -> DataFrame:
        """One row a key: votes by class as an array."""
        counts = [F.sum(F.when(F.col("_vote") == k, F.col("n")).otherwise(0)).cast("double") for k in range(n)]
        return votes.groupBy(*keys).agg(F.array(*counts).alias("v"))

    whole = by().first()
    total = whole["v"] if whole and whole["v"] and whole["v"][0] is not None else [0.0] * n
    for name in ("_host", "_domain", "_suffix", "_declared"):
        # Hot names, HOT at most, are broadcast; rows that have such a one, or none, are spread over the other join.
        group = by(name).where(F.col(name) != "")
        hot = F.aggregate("v", F.lit(0.0), lambda a, x: a + x) > sum(total) / HOT
        rows = rows.join(F.broadcast(group.where(hot).withColumnRenamed("v", "_hot")), name, "left")
        rows = rows.withColumn("_key", F.when(F.col("_hot").isNotNull() | (F.col(name) == ""), F.concat(F.lit("\0"), F.xxhash64("_id", "_grams", "_logs").cast("string"))).otherwise(F.col(name)))
        rows = rows.join(group.where(~hot).select(F.col(name).alias("_key"), F.col("v").alias("_few")), "_key", "left")
        rows = rows.withColumn(f"{name}_v", F.coalesce("_hot", "_few")).drop("_hot", "_few", "_key")
    empty = F.array(*[F.lit(0.0)] * n)
    level = {name: F.coalesce(F.col(f"{name}_v"), empty) for name in ("_host", "_domain", "_suffix", "_declared")}

    def own(k: int) -> Column:
        return F.when(F.col("_vote") == k, 1.0).otherwise(0.0)

    any_vote = F.when(F.col("_vote").isNotNull(), 1.0).otherwise(0.0)

    def prior(k: int) -> Column:
        share = UNKNOWN_SHARE if k == n - 1 else (1 - UNKNOWN_SHARE) / max(1, n - 1)
        p = (F.lit(total[k]) - own(k) + LEAN * share) / (F.lit(sum(total)) - any_vote + LEAN)
        for name in ("_domain", "_host"):
            votes_here = F.aggregate(level[name], F.lit(0.0), lambda a, x: a + x) - any_vote
            p = F.when(F.col(name) == "", p).otherwise((level[name][k] - own(k) + LEAN * p) / (votes_here + LEAN))
        return p

    def given(name: str, k: int) -> Column:
        """P(this page's value | class k); no value says nothing."""
        return F.when(F.col(name) == "", 1.0).otherwise((level[name][k] - own(k) + 0.5) / (F.lit(total[k]) - own(k) + 10.0))

    logs = [F.col("_logs")[k] + F.log(F.greatest(prior(k), F.lit(1e-9))) + F.log(given("_declared", k)) + F.log(given("_suffix", k)) for k in range(n)]
    fused = rows.withColumn("_fused", F.array(*logs)).withColumn("_top", F.array_max("_fused"))
    names = F.array(*map(F.lit, langs))
    return fused.withColumns(
        {
            "_lang": F.element_at(names, F.array_position("_fused", F.col("_top")).cast("int")),
            "_probability": 1 / F.aggregate("_fused", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("_top"))),
            "_text_lang": F.when(F.col("_vote").isNotNull(), F.element_at(names, F.col("_vote") + 1)),
        }
    )


def identify_pages(pages: DataFrame, train: DataFrame, *, least: float = 0.5) -> DataFrame:
    """(page_id, lang, probability, text_lang, declared, host, accepted) per row of pages (page_id, url, html).

    The profiles come from every labelled text of train (text, lang). A null or empty page has no text
    evidence and gets its language from markup and host alone; a null url has no host; a page without
    letters is never accepted; a page of any length, closed or not, is read once. Rows with equal ids stay apart; extra columns are ignored; without labelled
    texts every page is 'und'.
    """
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    labels = F.split(host, r"\.")
    rows = pages.select(
        F.col("page_id").alias("_id"), F.col("html").cast("string").alias("_text"), F.lit(None).cast("string").alias("_declared"), host.alias("_host"),
        F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".").alias("_domain"), F.element_at(labels, -1).alias("_suffix"),
    )
    model = profiles(train)
    judged = saved(text_evidence(rows, model, markup=True), "judged")
    return fuse(judged, model[0]).select(
        F.col("_id").alias("page_id"), F.col("_lang").alias("lang"), F.col("_probability").alias("probability"), F.col("_text_lang").alias("text_lang"),
        F.nullif(F.col("_declared"), F.lit("")).alias("declared"), F.nullif(F.col("_host"), F.lit("")).alias("host"),
        ((F.col("_lang") != UNKNOWN) & (F.col("_probability") >= least) & (F.col("_grams") > 0)).alias("accepted"),
    )


def accepted_documents(docs: DataFrame, *, least: float = 0.5, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of docs whose language is known: same columns.

    The document's source stands for the host and its lang column for the declared language. A document
    goes if it has no letters, if no known language is likelier than noise, or if the likeliest has a
    posterior below `least`. Equal rows are judged alike.
    """
    model = profiles(docs, text_col, lang_col)
    # The judgement travels by a hash of what is judged, the document itself stays where it is.
    key = F.xxhash64(F.col(text_col), F.col(lang_col), F.col(source_col))
    rows = docs.select(key.alias("_id"), F.col(text_col).cast("string").alias("_text"), F.col(lang_col).cast("string").alias("_declared"), F.col(source_col).cast("string").alias("_host"), F.lit("").alias("_domain"), F.lit("").alias("_suffix"))
    judged = saved(text_evidence(rows, model, markup=False), "judged")
    fused = fuse(judged, model[0])
    bad = fused.where((F.col("_lang") == UNKNOWN) | (F.col("_probability") < least) | (F.col("_grams") == 0)).select(F.col("_id").alias("_key")).distinct()
    bad = saved(bad, "rejected")  # written, so that its size is known: a small one is broadcast and no text is shuffled
    dropped(judged)
    return docs.withColumn("_key", key).join(bad, "_key", "left_anti").drop("_key")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/documents.parquet"))
