"""Pages of passages, and splits that keep them together.

Passages belong to one page if they share the article or a title, along chains. Titles
are compared after undoing entities and percent encoding, composing (NFKC), and writing
every run of blanks, underscores and invisible characters as one blank; letter case and
every other letter count. Only articles that share a title become edges (each to the least
article of the title), so a title or article with a third of all rows is one row here.

Splits: pages are drawn by their sizes only. A bitset holds every total that some choice
of pages of the counted sizes can reach; its set bit closest to the wanted number of rows
gives the choice, first for the test split, then for validation.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.llm.components import components

_ENCODED = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_BLANKS = re.compile(r"[\s_­​-‏⁠﻿]+")
SHARES = {"test": 0.15, "val": 0.15}
#: Bits of a bitset; larger totals are counted in units first, then filled exactly.
FINEST = 1 << 22


def title_key(title: str | None) -> str | None:
    """What all ways to write a title have in common; null for null, blank titles and titles of blanks only."""
    if title is None:
        return None
    for _ in range(3):  # an entity may be percent-encoded and the other way round
        again = html.unescape(_ENCODED.sub(lambda m: unquote(m[0], errors="replace"), title))
        if again == title:
            break
        title = again
    return _BLANKS.sub(" ", unicodedata.normalize("NFKC", title)).strip() or None


@F.pandas_udf(T.StringType())
def title_keys(titles: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for series in titles:
        yield series.map(title_key, na_action="ignore")


def page_labels(passages: DataFrame, article: str = "wiki_id", title: str = "title") -> DataFrame:
    """(article, page) of each article whose page has other articles too; page is the least article."""
    titled = passages.where(F.col(article).isNotNull() & F.col(title).isNotNull()).select(F.col(article).alias("article"), F.col(title).alias("title")).distinct()
    plain = F.col("title").rlike(r"^[A-Za-z0-9()',.-]+( [A-Za-z0-9()',.-]+)*$")
    plainly = titled.where(plain).select("article", F.col("title").alias("key"))
    keyed = plainly.unionByName(titled.where(~plain).select("article", title_keys("title").alias("key"))).where("key is not null").select("article", F.xxhash64("key").alias("h1"), F.hash("key").alias("h2"))
    least = keyed.groupBy("h1", "h2").agg(F.min("article").alias("v"), F.max("article").alias("last")).where("v <> last").drop("last")
    edges = keyed.join(least, ["h1", "h2"]).select(F.col("article").alias("u"), "v")
    return components(edges).select(F.col("vertex").alias("article"), F.col("component").alias("page"))


def pages(passages: DataFrame, article: str = "wiki_id", title: str = "title") -> DataFrame:
    """(article, page) of every article of `passages`; rows with a null article have no page."""
    articles = passages.where(F.col(article).isNotNull()).select(F.col(article).cast("long").alias("article")).distinct()
    return articles.join(page_labels(passages, article, title), "article", "left").select("article", F.coalesce("page", "article").alias("page"))


def split_name(split: str = "split") -> F.Column:
    """train, val or test, or null, however the split is written."""
    name = F.lower(F.trim(F.regexp_replace(split, r"\s+", " ")))
    return F.when(name.isin("train", "val", "test"), name)


def spread_articles(passages: DataFrame, article: str = "wiki_id", title: str = "title", split: str = "split") -> DataFrame:
    """(wiki_id) of every article whose page has passages in more than one split.

    Null and unknown splits count for none. A page is known by its splits alone, as three
    bits, so a page of any size is a few partial rows.
    """
    bit = F.when(split_name(split) == "train", 1).when(split_name(split) == "val", 2).when(split_name(split) == "test", 4).otherwise(0)
    known = passages.where(F.col(article).isNotNull()).groupBy(F.col(article).cast("long").alias("article")).agg(F.bit_or(bit).alias("bits"))
    labelled = known.join(page_labels(passages, article, title), "article", "left").withColumn("page", F.coalesce("page", "article"))
    several = labelled.groupBy("page").agg(F.bit_or("bits").alias("bits")).where(F.bit_count("bits") > 1).select("page")
    return labelled.join(several, "page", "left_semi").select(F.col("article").alias("wiki_id"))


def choose(sizes: dict[int, int], target: int) -> dict[int, int]:
    """Of each size, how many pages to take so that the total comes closest to `target`.

    The bitset has a bit for each total up to the target and a little beyond; each size is
    added by binary portions of its count. Ties go to the smaller total.
    """
    target = max(0, target)
    bound = target + max(sizes, default=0)
    mask = (1 << (bound + 1)) - 1
    reach, steps = 1, []
    for size, count in sorted(sizes.items(), reverse=True):
        count, part = min(count, bound // size), 1
        while count > 0:
            part = min(part, count)
            steps.append((size, part, reach))
            reach = (reach | reach << (size * part)) & mask
            count, part = count - part, part * 2
    below = (reach & ((1 << (target + 1)) - 1)).bit_length() - 1
    above = reach >> (target + 1)
    total = below
    if above:
        up = target + 1 + ((above & -above).bit_length() - 1)
        total = up if up - target < target - below else below
    taken: dict[int, int] = {}
    for size, part, before in reversed(steps):
        if not before >> total & 1:
            total -= size * part
            taken[size] = taken.get(size, 0) + part
    return taken


def choose_from_many(sizes: dict[int, int], target: int, finest: int = FINEST) -> dict[int, int]:
    """As `choose`, for totals beyond `finest`: large pages by the bitset in units, small ones to fill the rest exactly.

    A unit is a `finest`th of the target. Pages of at least a unit are chosen to come close
    to the target from below, less what rounding them may add; what is left is filled with
    smaller pages, the largest size first as long as they fit, and at last once more by an
    exact bitset over what is left of each size, which is less than a few units away. So no
    page is too small to be chosen, and the total is as close as the small pages allow.
    """
    if target <= finest:
        return choose(sizes, target)
    unit = -(-target // finest)
    large = {s: n for s, n in sizes.items() if s >= unit}
    units: dict[int, int] = {}
    for s, n in large.items():
        units[-(-s // unit)] = units.get(-(-s // unit), 0) + n  # rounded up, so that the true total is no more
    small = sum(s * n for s, n in sizes.items() if s < unit)
    wanted = choose(units, target // unit)
    taken: dict[int, int] = {}
    rest = target
    for s in sorted(large, reverse=True):
        n = min(large[s], wanted.get(-(-s // unit), 0))
        if n:
            wanted[-(-s // unit)] -= n
            taken[s], rest = n, rest - s * n
    # Pages whose rounding left room are added while there is more room than small pages can fill.
    for s in sorted(large, reverse=True):
        n = min(large[s] - taken.get(s, 0), max(0, rest - small) // s)
        if n:
            taken[s], rest = taken.get(s, 0) + n, rest - s * n
    for s in sorted((s for s in sizes if s < unit), reverse=True):
        spare = min(rest, 2 * unit)  # kept open for the exact end
        n = min(sizes[s], max(0, rest - spare) // s)
        if n:
            taken[s], rest = n, rest - s * n
    left = {s: sizes[s] - taken.get(s, 0) for s in sizes if sizes[s] > taken.get(s, 0) and s <= 2 * max(rest, 1)}
    if 0 < rest <= finest:
        for s, n in choose(left, rest).items():
            taken[s] = taken.get(s, 0) + n
    elif rest > 0:  # only pages larger than a unit are left: in units again, over what is left
        for s, n in choose_from_many(left, rest, finest).items() if rest < target else ():
            taken[s] = taken.get(s, 0) + n
    return taken


def split_plan(counted: dict[int, int], shares: dict[str, float], finest: int = FINEST) -> list[tuple[int, int, int, str]]:
    """(size, low, high, split): pages of each size from place low to below high go to the split; the others to train.

    counted: the number of pages of each size. Targets are shares of all rows.
    """
    total = sum(size * n for size, n in counted.items())
    left, plan, begun = dict(counted), [], dict.fromkeys(counted, 0)
    for name, share in shares.items():
        for size, take in sorted(choose_from_many({s: n for s, n in left.items() if n}, round(total * share), finest).items()):
            plan.append((size, begun[size], begun[size] + take, name))
            begun[size], left[size] = begun[size] + take, left[size] - take
    return plan


def assign_splits(passages: DataFrame, article: str = "wiki_id", title: str = "title", shares: dict[str, float] | None = None) -> DataFrame:
    """(article, page, new_split): one split for all passages of a page, close to the wanted shares of rows.

    Pages of one size are taken in the order of the hash of their least article. The driver
    gets one row for each page size that occurs, not one for each page. Rows with a null
    article belong to no page and have no row; an empty table gives none.
    """
    shares = SHARES if shares is None else shares
    labelled = pages(passages, article, title)
    rows = passages.where(F.col(article).isNotNull()).groupBy(F.col(article).cast("long").alias("article")).agg(F.count("*").alias("rows"))
    sized = labelled.join(rows, "article").groupBy("page").agg(F.sum("rows").alias("rows"))
    plan = split_plan({r["rows"]: r["n"] for r in sized.groupBy("rows").agg(F.count("*").alias("n")).toLocalIterator()}, shares)
    # The place of a page among those of its size, in two steps so that no task ranks all pages of one size.
    placed = sized.withColumn("h", F.xxhash64("page")).withColumn("part", F.pmod("h", F.lit(4096)))
    before = placed.groupBy("rows", "part").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.partitionBy("rows").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select("rows", "part", F.coalesce("before", F.lit(0)).alias("before"))
    within = placed.withColumn("place", F.row_number().over(Window.partitionBy("rows", "part").orderBy("h", "page")) - 1).join(before, ["rows", "part"])
    taken = passages.sparkSession.createDataFrame(plan, "rows long, low long, high long, name string")
    place = F.col("place") + F.col("before")
    named = within.join(taken, "rows", "left").groupBy("page").agg(F.max(F.when((place >= F.col("low")) & (place < F.col("high")), F.col("name"))).alias("name"))
    return labelled.join(named, "page").select("article", "page", F.coalesce("name", F.lit("train")).alias("new_split"))
