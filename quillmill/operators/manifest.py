"""Download manifest: summary, resume, title matching and file choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions import scalars as S
from quillmill.session import broadcast_if_small

GRAM = 8


def summary(entries: DataFrame) -> DataFrame:
    """(author, source, n_files, n_duplicates, megabytes) by last name of the author and source."""
    last = F.lower(F.element_at(F.split(F.coalesce("author", F.lit("unknown")), " "), -1))
    return entries.groupBy(last.alias("author"), "source").agg(F.count("*").alias("n_files"), F.count("duplicate_of").alias("n_duplicates"), (F.sum(F.coalesce("file_size", F.lit(0))) / 1048576).alias("megabytes"))


def pending(candidates: DataFrame, entries: DataFrame) -> DataFrame:
    """Candidates whose url is not in the manifest; null urls are always pending."""
    known = entries.select(F.col("url").alias("_u")).filter("_u is not null").distinct()
    return candidates.join(known, F.col("url") == F.col("_u"), "left_anti")


def latest(entries: DataFrame) -> DataFrame:
    """Of each url the entry downloaded last (the highest entry_id among equals)."""
    return entries.groupBy("url").agg(F.max_by("entry_id", F.struct("download_date", "entry_id")).alias("entry_id"), F.count("*").alias("n_downloads"))


def containments(a: DataFrame, b: DataFrame, least: int = 1) -> DataFrame:
    """(a_id, b_id): pairs in which the key of `a` (at least `least` long) is a substring of the key of `b`.

    All 8-grams of a substring are 8-grams of the text around it, so the candidates come from an equi-join on the one
    that the fewest texts have, and a common beginning joins nothing. Shorter keys are joined on the substrings of
    their length. Empty keys match nothing.
    """
    a = a.filter(F.length("key") >= max(1, least))
    grams = F.expr(f"array_distinct(transform(sequence(1, length(key) - {GRAM - 1}), i -> substring(key, i, {GRAM})))")
    wide_b = b.filter(F.length("key") >= GRAM).select(F.col("id").alias("b_id"), F.col("key").alias("b_key"), F.explode(grams).alias("gram"))
    counts = wide_b.groupBy("gram").agg(F.count("*").alias("_n"))
    each = a.filter(F.length("key") >= GRAM).select(F.col("id").alias("a_id"), F.col("key").alias("a_key"), F.explode(grams).alias("gram")).join(counts, "gram", "left")
    rarest = each.groupBy("a_id", "a_key").agg(F.min_by("gram", F.struct(F.coalesce("_n", F.lit(0)), "gram")).alias("gram"))
    out = rarest.join(wide_b, "gram").filter(F.col("b_key").contains(F.col("a_key"))).select("a_id", "b_id")
    if least < GRAM:
        short = a.filter(F.length("key") < GRAM).select(F.col("id").alias("a_id"), F.col("key").alias("gram"))
        out = out.union(short.join(_short_parts(b, F.col("id").alias("b_id")), "gram").select("a_id", "b_id"))
    return out


def _short_parts(rows: DataFrame, *columns: Column) -> DataFrame:
    """The columns and `gram`: each distinct substring of the key of fewer than GRAM characters."""
    every = F.expr(f"array_distinct(flatten(transform(sequence(1, least(length(key), {GRAM - 1})), n -> transform(sequence(1, length(key) - n + 1), i -> substring(key, i, n)))))")
    return rows.filter(F.length("key") >= 1).select(*columns, F.explode(every).alias("gram"))


def title_matches(a: DataFrame, b: DataFrame, least: int = 15) -> DataFrame:
    """(a_id, b_id): one key contains the other, which has at least `least` characters."""
    swapped = containments(b, a, least).select(F.col("b_id").alias("a_id"), F.col("a_id").alias("b_id"))
    return containments(a, b, least).union(swapped).distinct()


def cross_source_duplicates(entries: DataFrame) -> DataFrame:
    """(entry_id, duplicate_of): the first other entry with a fuzzy equal title, if its source differs.

    Alike titles are compared once per distinct title, so copies do not multiply. Titles under eight characters, which
    very many others may contain, take the first entry per substring before they are joined.
    """
    titled = entries.select("entry_id", "source", S.alnum_key(F.col("title")).alias("key"))
    titles = titled.filter("key <> ''").groupBy("key").agg(F.min("entry_id").alias("id"), F.min_by(F.struct("entry_id", "source"), "entry_id").alias("f"))
    alike = title_matches(titles.select("id", "key"), titles.select("id", "key"), GRAM)
    long = alike.join(titles.select(F.col("id").alias("a_id"), "key"), "a_id").join(titles.select(F.col("id").alias("b_id"), "f"), "b_id").select("key", "f")
    parts = _short_parts(titles, F.col("key"), F.col("f"))
    short = titles.filter(F.length("key") < GRAM).select(F.col("key").alias("gram"), F.col("f").alias("own"))
    around = parts.groupBy("gram").agg(F.min("f").alias("f")).join(short.select("gram"), "gram").select(F.col("gram").alias("key"), "f")
    inside = parts.select("key", "gram").join(short, "gram").select("key", F.col("own").alias("f"))
    best = long.union(around).union(inside).groupBy("key").agg(F.min("f").alias("f"))
    return titled.join(best, "key").filter((F.col("f.entry_id") < F.col("entry_id")) & (F.col("f.source") != F.col("source"))).select("entry_id", F.col("f.entry_id").alias("duplicate_of"))


def file_key(name: Column) -> Column:
    """First 40 characters of the normalised stem."""
    stem = F.regexp_replace(F.regexp_replace(F.lower(F.element_at(F.split(name, "/"), -1)), r"\.[^.]*$", ""), r"\s*-\s*libgen\.\w+$", "")
    return F.substring(F.trim(F.regexp_replace(stem, r"[_\-\s]+", " ")), 1, 40)


def new_files(candidates: DataFrame, local: DataFrame) -> DataFrame:
    """Candidates whose file key no local file has."""
    return candidates.join(local.select(file_key(F.col("filename")).alias("_k")).distinct(), file_key(F.col("filename")) == F.col("_k"), "left_anti")


def first_of(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row per key: merge of search strategies, ids unique across queries. Combined before the shuffle."""
    first = rows.groupBy(key).agg(F.min_by(F.struct(*[F.col(c) for c in rows.columns if c != key]), F.struct(*order)).alias("_first"))
    return first.select(key, "_first.*").select(*rows.columns)


def author_folder(author: Column, folders: dict[str, str]) -> Column:
    """Folder of the first key that is a substring of the author."""
    out = None
    for key, folder in folders.items():
        out = (F.when if out is None else out.when)(F.lower(author).contains(key), folder)
    return out.otherwise("other")


def pick_file(files: Column) -> Column:
    """Best of ARRAY<STRUCT<name, size>>: a text over 1 KiB without Metadata, then djvu.txt, then a pdf over 10 KiB without thumb."""
    name = lambda f: F.lower(f["name"])
    good = lambda f: F.when(name(f).endswith(".txt") & (f["size"] >= 1024) & ~f["name"].contains("Metadata"), 1).when(name(f).endswith("djvu.txt"), 2).when(name(f).endswith(".pdf") & (f["size"] >= 10240) & ~name(f).contains("thumb"), 3)
    ranked = F.filter(F.transform(files, lambda f, i: F.struct(good(f).alias("rank"), i.alias("at"), f["name"].alias("name"))), lambda x: x["rank"].isNotNull())
    return F.array_min(ranked)["name"]


#: Media types in order of preference.
TEXT_TYPES = ("text/plain; charset=utf-8", "text/plain; charset=us-ascii", "text/plain", "text/plain; charset=iso-8859-1")


def pick_text_url(formats: Column) -> Column:
    """Best text url of MAP<media type, url>: no zip, preferred types first, then any plain text."""
    usable = F.map_filter(formats, lambda k, v: ~v.endswith(".zip"))
    plain = F.array_min(F.transform(F.map_entries(F.map_filter(usable, lambda k, v: k.startswith("text/plain"))), lambda e: e["value"]))
    return F.coalesce(*[F.try_element_at(usable, F.lit(t)) for t in TEXT_TYPES], plain)


def relevant_hits(hits: DataFrame, author: Column) -> DataFrame:
    """Search hits (title, authors) by an author of the query, or with a title that speaks of the subject."""
    by = F.coalesce(S.author_matches(F.col("authors"), author), F.lit(False))
    return hits.filter(by | F.coalesce(S.title_relevant(F.col("title"), author), F.lit(False)))
