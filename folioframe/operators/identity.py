"""Duplicate keys, matching to stored rows, resolution of dimensions, upserts."""

from __future__ import annotations

from collections import Counter
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.folders import folder
from .likeness import ratios
from .postings import held_in, may_meet


def strongest_key(doi: Column, source: Column, external_id: Column, title: Column, year: Column, authors: Column | None = None, first: int = 3) -> Column:
    """DOI, else source and external id, else title, year and the first authors; all case-folded."""
    tail = [S.identity_title(title), year.cast("string")]
    if authors is not None:
        tail.append(F.array_join(F.transform(F.slice(authors, 1, first), S.identity), "|"))
    by_title = F.when(S.identity_title(title).isNotNull(), F.concat(F.lit("title:"), F.concat_ws(":", *tail)))
    by_id = F.when(S.clean(external_id).isNotNull(), F.concat(F.lit("id:"), F.concat_ws(":", F.lower(source), F.lower(S.clean(external_id)))))
    return F.coalesce(F.concat(F.lit("doi:"), S.doi(doi)), by_id, by_title)


def first_kept(df: DataFrame, key: str, order: list[str], action: str = "action") -> DataFrame:
    """Marks the first row of each key as kept and later ones as duplicates; rows without a key are kept.

    The first place comes from a grouped minimum that is joined back, so that a key that many rows share
    isn't sorted in one task.
    """
    place = F.struct(*[F.col(c) for c in order])
    lowest = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(place).alias("_first"))
    out = df.join(lowest, key, "left")
    return out.withColumn(action, F.when(F.col("_first").isNull() | (place == F.col("_first")), "kept").otherwise("duplicate")).drop("_first")


def likeness(left: pd.Series, right: pd.Series, needed: pd.Series) -> pd.Series:
    out = []
    for a, b, least in zip(left, right, needed):
        m = SequenceMatcher(None, a or "", b or "")
        out.append(m.ratio() if m.real_quick_ratio() >= least and m.quick_ratio() >= least else 0.0)
    return pd.Series(out)


def ratio(a: str, b: str, needed: Column | float = 0.0) -> Column:
    """Likeness of two texts, or 0 where cheap bounds show that it is less than needed."""
    return F.pandas_udf(likeness, "double")(a, b, F.lit(needed) if isinstance(needed, float) else needed)


def long_enough(a: Column, b: Column, least: float) -> Column:
    """Whether two texts' lengths allow a ratio of `least`: loses no pair."""
    x, y = F.length(a), F.length(b)
    return 2 * F.least(x, y) >= least * (x + y)


def letter_shares(titles: DataFrame, column: str, most: int = 512) -> dict[str, float]:
    """How much of all text each of the `most` most frequent characters makes up; what is left out counts as rarest. It orders prefixes and decides nothing else."""
    each = titles.select(F.explode(F.split(column, "")).alias("c")).where("c <> ''").groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "c").limit(most).collect()
    total = sum(r.n for r in each) or 1
    return {r.c: r.n / total for r in each}


def letter_prefix(title: Column, least: float, shares: dict[str, float]) -> Column:
    """The rarest numbered letters of a title, as many as a title like it must share one of.

    A title is the set of its letters, each with its number among equal ones ("e" for the first, the second, ...). The ratio is twice
    the matched characters to both lengths, and no more can match than the sets share. So a pair that reaches
    `least` shares n * least / (2 - least) of a title's n letters at least, whatever the other's length, and
    in any order of all letters each one's first n - that + 1 hold one in common.
    """
    known = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair]) if shares else F.create_map(F.lit(""), F.lit(1.0))
    letters = F.array_sort(F.array_remove(F.split(title, ""), ""))
    # The more often a letter stands before, and the rarer it is, the rarer is this one of them. Through an array of one, so that the letters are sorted once and not for each of them.
    def each(letters: Column) -> Column:
        return F.transform(letters, lambda c, i: F.struct((-(i - F.array_position(letters, c) + 2) / (F.coalesce(F.try_element_at(known, c), F.lit(0.0)) + 1e-4)).alias("order"), F.concat(c, (i - F.array_position(letters, c) + 1).cast("string")).alias("letter")))

    numbered = F.flatten(F.transform(F.array(letters), each))
    n = F.length(title)
    shared = F.ceil(n * least / (2 - least) - 1e-9).cast("int")
    return F.transform(F.slice(F.array_sort(numbered), F.lit(1), n - shared + 1), lambda x: x["letter"])


def alike_titles(records: DataFrame, stored: DataFrame, *, least: float) -> DataFrame:
    """(record_id, publication_id, score) of titles of one block with a matching ratio of `least` and more; none is missed.

    records: (record_id, block, key_title, size), stored: (publication_id, block, key_title), no nulls; a record meets
    stored titles of `size` characters. A title is copied once for each letter of its prefix (15 % of its
    length), and a pair meets by the first letter that both prefixes have. Two empty titles are equal.
    """
    shares = letter_shares(records.select("record_id", "key_title").distinct(), "key_title")
    a = records.select("record_id", "block", "size", "key_title", letter_prefix(F.col("key_title"), least, shares).alias("p")).select("*", F.explode("p").alias("letter"))
    b = stored.join(F.broadcast(records.select("block", "size").distinct()), (stored.block == records.block) & (F.length(stored.key_title) == F.col("size")), "left_semi")
    b = b.select("publication_id", "block", F.length("key_title").alias("size"), F.col("key_title").alias("other"), letter_prefix(F.col("key_title"), least, shares).alias("q")).select("*", F.explode("q").alias("letter"))
    pairs = a.join(b, ["block", "size", "letter"]).where(F.get(F.array_intersect("p", "q"), F.lit(0)) == F.col("letter"))
    empty = records.where("key_title = '' and size = 0").join(stored.where("key_title = ''").select("publication_id", "block"), "block")
    return scored_titles(pairs, least).unionByName(empty.select("record_id", "publication_id", F.lit(1.0).alias("score")))


def scored_titles(pairs: DataFrame, least: float) -> DataFrame:
    """(record_id, publication_id, score) of pairs (record_id, publication_id, key_title, other) that reach a ratio of `least`.

    The ratio is taken where the edit distance, which is never over the unmatched characters, allows it.
    """
    unlike = F.floor((1 - least) * (F.length("key_title") + F.length("other")) + 1e-6).cast("int")
    near = pairs.where(long_enough(F.col("key_title"), F.col("other"), least)).where(F.call_function("levenshtein", F.col("key_title"), F.col("other"), unlike) >= 0)
    near = near.select("record_id", "publication_id", "key_title", "other").distinct()
    return near.withColumn("score", ratio("key_title", "other", least)).where(F.col("score") >= least).select("record_id", "publication_id", "score")


#: Characters of a title's core at most, if it is to meet others by it.
CORE = 24


def telling_letters(titles: DataFrame, column: str, most: int = 4000) -> str:
    """Characters to which titles are cut down so that what is left is short and tells them apart.

    Of the digits, the rarest characters (eight a title) and all of them, those that let the fewest of at most `most` titles
    meet with one left out of each. It chooses a key and decides nothing else.
    """
    found = [r[0] for r in titles.select(column).distinct().orderBy(F.xxhash64(column)).limit(most).collect()]
    counts = Counter(c for t in found for c in t)
    rare, n = "", 0
    for c, k in sorted(counts.items(), key=lambda x: (x[1], x[0])):
        if n < 8 * len(found):
            rare, n = rare + c, n + k

    def meetings(letters: str) -> int:
        kept = set(letters)
        cores = [c for t in found if len(c := "".join(x for x in t if x in kept)) <= CORE]
        met = Counter(k for c in cores for k in {c, *(c[:i] + c[i + 1 :] for i in range(len(c)))})
        return sum(k * k for k in met.values()) + (len(found) - len(cores)) * len(found)

    return min(["".join(sorted(c for c in counts if c.isdigit())), rare, "".join(sorted(counts))], key=meetings)


def core(title: Column, letters: str) -> Column:
    """What is left of a title if only the given characters stay."""
    return F.regexp_replace(title, "[^" + "".join(f"\\x{{{ord(c):x}}}" for c in letters) + "]", "") if letters else F.lit("")


def with_some_left_out(text: Column, most: int) -> Column:
    """A text and all texts that it gives if up to `most` characters are left out, one or two."""
    gone = lambda t, i: F.concat(F.left(t, i - 1), F.substring(t, i + 1, F.length(t)))
    at = lambda t, i: F.when(F.length(t) >= i, F.sequence(i, F.length(t))).otherwise(F.array().cast("array<int>"))
    one = F.transform(at(text, F.lit(1)), lambda i: gone(text, i))
    parts = [F.array(text), one]
    if most > 1:  # the later one goes first, so that the earlier one's place stands
        parts.append(F.flatten(F.transform(at(text, F.lit(2)), lambda j: F.transform(F.sequence(F.lit(1), j - 1), lambda i: gone(gone(text, j), i)))))
    return F.array_distinct(F.concat(*parts))


def best_titles(records: DataFrame, stored: DataFrame, *, least: float) -> DataFrame:
    """(record_id, publication_id, score): the stored title of the record's block that is likest, of `least` and more; the lowest id of equal ones.

    records: (record_id, block, key_title), stored: (publication_id, block, key_title), no nulls. Exact, in passes, of which each takes the
    records that the one before left open. If of two titles characters are left out until the rest is equal, then the same ones
    left out of their cores (see `core`) leave equal cores. So a pass that joins cores with up to e characters left out
    finds all pairs but those where one core loses e + 1 characters or more; by the lengths of both that bounds the ratio of
    what it can't find, and a record whose best is above the bound is done. What no pass settles meets by letters, at lengths that may
    still hold something as like.
    """
    spark = records.sparkSession
    letters = telling_letters(records, "key_title")
    path = folder(spark, "alike")
    cored = lambda df, *own: df.select(*own, core(F.col("key_title"), letters).alias("core"))
    # Dealt anew: the rows of one small file are many keys.
    cored(stored, "publication_id", "block", F.col("key_title").alias("other")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).write.parquet(f"{path}/stored")
    cored(records, "record_id", "block", "key_title").write.parquet(f"{path}/records")
    held, asked = spark.read.parquet(f"{path}/stored"), spark.read.parquet(f"{path}/records")
    held.groupBy("block", F.length("other").alias("size"), F.length("core").alias("core_size")).agg(F.count("*").alias("n")).write.parquet(f"{path}/sizes")
    sizes = spark.read.parquet(f"{path}/sizes")

    def keys(df: DataFrame, e: int) -> DataFrame:
        return df.select("*", F.explode(with_some_left_out(F.col("core"), e)).alias("_left")).select("*", F.xxhash64("block", "_left").alias("_h")).drop("_left", "core")

    def open_(found: DataFrame | None, e: int) -> DataFrame:
        """(record_id, size): lengths of stored titles that may be as like as the best so far, or liker, and weren't sure to be found."""
        size, own = F.length("key_title"), F.length("core")
        apart = F.abs(own - F.col("core_size"))
        losing = F.greatest(apart, F.when(own <= CORE - e, 2 * (e + 1) - apart).otherwise(0)) if e else apart
        losing = losing + F.abs(size - own - F.col("size") + F.col("core_size"))
        both = asked.join(F.broadcast(sizes), "block").withColumn("bound", F.coalesce((size + F.col("size") - losing) / F.nullif(size + F.col("size"), F.lit(0)), F.lit(1.0))).where(F.col("bound") >= least - 1e-9)
        if found is not None:
            both = both.join(found.groupBy("record_id").agg(F.max("score").alias("score")), "record_id", "left").where("score is null or bound >= score - 1e-9")
        return both.select("record_id", "size").distinct()

    found = None
    for e in (1, 2):
        left = asked.join(open_(found, e - 1).select("record_id").distinct(), "record_id", "left_semi").where(F.length("core") <= CORE - e)
        left = keys(left, e)
        pairs = left.join(may_meet(keys(held.where(F.length("core") <= CORE), e), left, "_h"), ["block", "_h"])
        scored_titles(pairs, least).write.parquet(f"{path}/found-{e}")
        now = spark.read.parquet(f"{path}/found-{e}")
        found = now if found is None else found.unionByName(now)
    open_(found, 2).join(asked, "record_id").select("record_id", "block", "key_title", "size").write.parquet(f"{path}/open")
    rest = spark.read.parquet(f"{path}/open")
    if rest.limit(1).count():
        found = found.unionByName(alike_titles(rest, held.select("publication_id", "block", F.col("other").alias("key_title")), least=least))
    best = found.groupBy("record_id").agg(F.min(F.struct((-F.col("score")).alias("n"), "publication_id")).alias("b"))
    return best.select("record_id", "b.publication_id", (-F.col("b.n")).alias("score"))


def match(records: DataFrame, stored: DataFrame, *, least: float = 0.92) -> DataFrame:
    """(record_id, publication_id, matched_by, score): the best stored row of each record, if any.

    By DOI, then source and external id, then title, year and first author, then title likeness to
    any of the year's stored rows that aren't deleted. Both sides have the columns doi, source,
    external_id, key_title, publication_year, first_author; stored also is_deleted.

    Titles meet by year and what is left of them without a few characters, else by a letter of their prefixes (see `best_titles`).
    """
    r, s = records, stored
    found = None
    rules = (("doi", ["doi"]), ("external_id", ["source", "external_id"]), ("title_year_author", ["key_title", "publication_year", "first_author"]))
    for rank, (name, keys) in enumerate(rules):
        some = [F.col(k).isNotNull() for k in keys]
        a, b = r, s
        for c in some:
            a, b = a.where(c), b.where(c)
        hit = a.select("record_id", *keys).join(b.groupBy(*keys).agg(F.min("publication_id").alias("publication_id")), keys)
        hit = hit.select("record_id", "publication_id", F.lit(name).alias("matched_by"), F.lit(rank).alias("rank"), F.lit(1.0).alias("score"))
        found = hit if found is None else found.unionByName(hit)
    path = folder(records.sparkSession, "matched")  # read twice, and each time else from all stored rows
    found.write.parquet(path)
    found = records.sparkSession.read.parquet(path)
    live = s.where(~F.col("is_deleted") & F.col("publication_year").isNotNull() & F.col("key_title").isNotNull()).select("publication_id", F.col("publication_year").alias("block"), "key_title")
    left = r.join(found.select("record_id").distinct(), "record_id", "left_anti").where("publication_year is not null and key_title is not null").select("record_id", F.col("publication_year").alias("block"), "key_title")
    likely = best_titles(left, live, least=least)
    found = found.unionByName(likely.select("record_id", "publication_id", F.lit("title_ratio").alias("matched_by"), F.lit(len(rules)).alias("rank"), "score"))
    best = found.groupBy("record_id").agg(F.min(F.struct("rank", (-F.col("score")).alias("n"), "publication_id", "matched_by", "score")).alias("b"))
    return best.select("record_id", "b.publication_id", "b.matched_by", "b.score")


def doi_classes(pubs: DataFrame) -> DataFrame:
    """(doi, class_id, records): the least id of those with one DOI, case aside, and how many they are."""
    return pubs.where("doi is not null").groupBy(F.lower("doi").alias("doi")).agg(F.min("publication_id").alias("class_id"), F.count("*").alias("records"))


def duplicate_pairs(pubs: DataFrame, *, least: float = 0.65, lead: int = 4, path: str | None = None) -> DataFrame:
    """Scored candidate pairs (first_id < second_id); never merges.

    Candidates: a title holds the other's first `lead` words (all of a shorter one) anywhere, inside words too; titles meet before
    their records do, and records by an author in common or titles alike enough without; records with is_deleted (if there is that column) aren't held against
    others. Equal DOIs score 1: each record is paired with the least id of its DOI, so that n records give n - 1 pairs and
    not all of them; `doi_classes` has the members. Else 0.4 title + 0.3 abstract likeness + 0.2 author
    overlap + 0.1 year. Rows of one class_id (if there is that column)
    are duplicates already and aren't paired. Pairs that can't reach the score by lengths, authors and years go at once.
    Tables between steps are written to `path`, or to a new shared folder.
    """
    spark = pubs.sparkSession
    path = path or folder(spark, "pairs")
    classed = ["class_id"] if "class_id" in pubs.columns else []
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    live = F.coalesce(~F.col("is_deleted"), F.lit(False)) if "is_deleted" in pubs.columns else F.lit(True)
    facts = pubs.select(F.col("publication_id").alias("id"), F.lower("doi").alias("doi"), "authors", F.col("publication_year").alias("year"), *classed, "key_title", F.length("key_title").alias("t"), F.length("abstract").alias("a"), live.alias("live"), "abstract")
    facts.repartition(parts, "id").write.parquet(f"{path}/records")
    records = spark.read.parquet(f"{path}/records")
    texts = records.where("abstract is not null").select("id", F.col("abstract").alias("text"))
    records = records.drop("abstract")
    titles = records.where("key_title is not null").groupBy(F.col("key_title").alias("text")).agg(F.min("id").alias("id"))
    titles.repartition(parts, "id").write.parquet(f"{path}/titles")
    titles = spark.read.parquet(f"{path}/titles").withColumn("t", F.length("text"))
    own = F.filter(F.split(F.col("text"), " "), lambda w: w != "")
    held = held_in(titles, titles.select(F.col("id").alias("query_id"), F.array_join(F.slice(own, 1, lead), " ").alias("needle")), "t")

    def bound(m: Column, n: Column) -> Column:
        return F.when(m.isNotNull() & n.isNotNull(), 2 * F.least(m, n) / F.greatest(F.lit(1), m + n))

    # Titles in pairs: what neither authors, year nor abstracts can lift to the score goes before records are looked at.
    held = held.join(titles.select(F.col("id").alias("query_id"), F.col("t").alias("own_t")), "query_id").withColumn("alike", bound(F.col("t"), F.col("own_t"))).where(F.col("alike") >= (least - 0.6) / 0.4 - 1e-9)
    both = held.groupBy(F.least("query_id", "id").alias("x"), F.greatest("query_id", "id").alias("y")).agg(F.max(F.col("query_id") <= F.col("id")).alias("holds_y"), F.max(F.col("query_id") >= F.col("id")).alias("holds_x"), F.first("alike").alias("alike"))
    both.write.parquet(f"{path}/held")
    both = spark.read.parquet(f"{path}/held")
    titled = records.join(titles.select(F.col("text").alias("key_title"), F.col("id").alias("title")), "key_title").drop("key_title")
    side = lambda df, n: df.select(*[F.col(c).alias(f"{n}_{c}") for c in df.columns])
    shared = F.array_intersect("x_authors", "y_authors")

    def likely(df: DataFrame) -> DataFrame:
        """Pairs of records, the lower id first, that lengths, authors and years allow."""
        df = df.where(((F.col("x") != F.col("y")) | (F.col("x_id") < F.col("y_id"))) & ((F.col("holds_y") & F.col("y_live")) | (F.col("holds_x") & F.col("x_live"))))
        if classed:
            df = df.where(~F.col("x_class_id").eqNullSafe(F.col("y_class_id")))
        gap = F.abs(F.col("x_year") - F.col("y_year"))
        cheap = 0.2 * F.coalesce(S.overlap(F.col("x_authors"), F.col("y_authors")), F.lit(0.0)) + 0.1 * F.when(gap == 0, 1.0).when(gap == 1, 0.5).otherwise(0.0)
        near = F.coalesce(bound(F.col("x_a"), F.col("y_a")), F.lit(0.0))
        kept = df.withColumns({"cheap": cheap, "near": near}).where(F.col("cheap") + 0.3 * F.col("near") + 0.4 * F.col("alike") >= least - 1e-9)
        return kept.select(F.least("x_id", "y_id").alias("first_id"), F.greatest("x_id", "y_id").alias("second_id"))

    # With an author in common: by title and author. Without: titles alike enough for that, a title's records dealt over sixteen tasks.
    by_author = titled.withColumn("author", F.explode(F.array_distinct("authors")))
    has = by_author.select(F.col("title").alias("y"), "author").distinct()
    x, y = side(by_author, "x"), side(by_author, "y")
    writers = both.join(has, "y").join(x, (F.col("x") == F.col("x_title")) & F.col("author").eqNullSafe(F.col("x_author"))).join(y, (F.col("y") == F.col("y_title")) & F.col("author").eqNullSafe(F.col("y_author")))
    writers = likely(writers.where(F.get(shared, F.lit(0)).eqNullSafe(F.col("author"))))
    x, y = side(titled, "x").withColumn("part", F.pmod(F.xxhash64("x_id"), F.lit(16)).cast("int")), side(titled, "y")
    spread = both.where(F.col("alike") >= (least - 0.4) / 0.4 - 1e-9).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(15))))
    others = spread.join(x, (F.col("x") == F.col("x_title")) & (spread.part == x.part)).drop(x.part).join(y, F.col("y") == F.col("y_title"))
    others = likely(others.where(F.coalesce(F.size(shared) <= 0, F.lit(True))))

    known = records.where("live and doi is not null").select("doi", F.col("id").alias("second_id"), *classed)
    of = doi_classes(records.where("live").select("doi", F.col("id").alias("publication_id"))).where("records > 1").select("doi", F.col("class_id").alias("first_id"))
    by_doi = known.join(of, "doi").where("first_id < second_id")
    if classed:
        by_doi = by_doi.join(records.select(F.col("id").alias("first_id"), F.col("class_id").alias("_class")), "first_id").where(~F.col("_class").eqNullSafe(F.col("class_id")))
    pairs = writers.unionByName(others).unionByName(by_doi.select("first_id", "second_id")).distinct()
    first, second = side(records.drop("live", *classed), "first"), side(records.drop("live", *classed), "second")
    both = pairs.join(first, "first_id").join(second, "second_id")
    gap = F.abs(F.col("first_year") - F.col("second_year"))
    cheap = 0.2 * F.coalesce(S.overlap(F.col("first_authors"), F.col("second_authors")), F.lit(0.0)) + 0.1 * F.when(gap == 0, 1.0).when(gap == 1, 0.5).otherwise(0.0)
    both = both.withColumns({"same": F.coalesce(F.col("first_doi") == F.col("second_doi"), F.lit(False)), "cheap": cheap, "near": 0.3 * F.coalesce(bound(F.col("first_a"), F.col("second_a")), F.lit(0.0))})
    equal = F.coalesce(F.col("first_key_title") == F.col("second_key_title"), F.lit(False))
    alike = both.where(equal).withColumn("by_title", F.lit(0.4)).unionByName(both.where(~equal).withColumn("by_title", 0.4 * ratio("first_key_title", "second_key_title", (least - 1e-9 - F.col("cheap") - F.col("near")) / 0.4)))
    alike = alike.where(F.col("same") | (F.col("cheap") + F.col("near") + F.col("by_title") >= least - 1e-9))
    alike.select("first_id", "second_id", "same", "cheap", "by_title", (~F.col("same") & (F.col("near") > 0)).alias("asked")).repartition(parts).write.parquet(f"{path}/alike")
    alike = spark.read.parquet(f"{path}/alike")
    asked = alike.where("asked").withColumn("needed", (least - 1e-9 - F.col("cheap") - F.col("by_title")) / 0.3)
    found = asked.join(ratios(asked.select("first_id", "second_id", "needed"), texts), ["first_id", "second_id"])
    every = alike.where("not asked").withColumn("ratio", F.lit(0.0)).unionByName(found.drop("needed"))
    scored = every.withColumn("score", F.when(F.col("same"), 1.0).otherwise(F.col("by_title") + 0.3 * F.col("ratio") + F.col("cheap")))
    return scored.where(F.col("score") >= least).select("first_id", "second_id", F.bround("score", 4).alias("score"))


def resolved(rows: DataFrame, dimension: DataFrame, keys: list[Column], dimension_keys: list[str], id_col: str) -> DataFrame:
    """rows with id_col from the first key that the dimension knows, and _new where a new entry is due.

    A new entry's id is the hash of its last key, the same in every run.
    """
    out, ids = rows, []
    for k, (value, name) in enumerate(zip(keys, dimension_keys)):
        known = dimension.where(F.col(name).isNotNull()).groupBy(F.col(name).alias(f"_k{k}")).agg(F.min(id_col).alias(f"_id{k}"))
        out = out.withColumn(f"_v{k}", value).join(known, F.col(f"_v{k}") == F.col(f"_k{k}"), "left").drop(f"_k{k}")
        ids.append(f"_id{k}")
    new = F.left(F.sha2(F.col(f"_v{len(keys) - 1}").cast("string"), 256), F.lit(32))
    out = out.withColumn("_new", F.coalesce(*ids).isNull() & F.col(f"_v{len(keys) - 1}").isNotNull())
    return out.withColumn(id_col, F.coalesce(*[F.col(i).cast("string") for i in ids], new)).drop(*ids, *[f"_v{k}" for k in range(len(keys))])


def missing_links(wanted: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Links to add: those that aren't stored; none is ever taken away."""
    return wanted.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti")


def upserted(old: DataFrame, new: DataFrame, key: str, fields: list[str], *, keep: tuple[str, ...] = ()) -> DataFrame:
    """old and new as one table with action (created, updated, unchanged, kept); fields in keep stay where new has null."""
    n = new.select(F.col(key), *[F.col(f).alias(f"_n_{f}") for f in fields], F.lit(True).alias("_in_new"))
    both = old.withColumn("_in_old", F.lit(True)).join(n, key, "full_outer")
    differs = F.lit(False)
    for f in fields:
        value = F.coalesce(f"_n_{f}", f) if f in keep else F.col(f"_n_{f}")
        differs = differs | ~value.eqNullSafe(F.col(f))
    action = F.when(F.col("_in_old").isNull(), "created").when(F.col("_in_new").isNull(), "kept").when(differs, "updated").otherwise("unchanged")
    value = lambda f: F.when(F.col("_in_new").isNull(), F.col(f)).otherwise(F.coalesce(f"_n_{f}", f) if f in keep else F.col(f"_n_{f}")).alias(f)
    return both.select(key, *[value(f) for f in fields], action.alias("action"))


def validated(rows: DataFrame, errors: dict[str, Column], warnings: dict[str, Column]) -> DataFrame:
    """rows with issues (field, severity) and valid: an error makes a row invalid, a warning does not."""
    checks = [F.when(bad, F.struct(F.lit(f).alias("field"), F.lit(level).alias("severity"))) for level, group in (("error", errors), ("warning", warnings)) for f, bad in group.items()]
    out = rows.withColumn("issues", F.array_compact(F.array(*checks)))
    return out.withColumn("valid", ~F.exists("issues", lambda i: i["severity"] == "error"))


def tombstoned(stored: DataFrame, deletions: DataFrame, key: str) -> DataFrame:
    """stored with the rows that deletions name marked as deleted, and a row for each deletion that names none."""
    gone = deletions.select(F.col(key), F.lit(True).alias("_gone")).dropDuplicates([key])
    both = stored.join(gone, key, "full_outer")
    return both.withColumn("is_deleted", F.coalesce("_gone", "is_deleted")).drop("_gone")


def current_reports(old: DataFrame, new: DataFrame, key: str, fields: list[str], at: str) -> DataFrame:
    """Report history: an unchanged report goes on; a changed one closes the current row and adds another."""
    n = new.select(key, *[F.col(f).alias(f"_n_{f}") for f in fields], F.col(at).alias("_n_at"))
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f).eqNullSafe(F.col(f"_n_{f}"))
    joined = old.where("is_current").join(n, key, "left").withColumn("_changed", F.col("_n_at").isNotNull() & ~same)
    kept = joined.select(key, *fields, at, (~F.col("_changed")).alias("is_current"))
    due = n.join(joined.where(~F.col("_changed")).select(key), key, "left_anti")
    added = due.select(key, *[F.col(f"_n_{f}").alias(f) for f in fields], F.col("_n_at").alias(at), F.lit(True).alias("is_current"))
    return old.where("not is_current").select(key, *fields, at, "is_current").unionByName(kept).unionByName(added)
