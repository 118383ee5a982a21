"""Queries over a tree of pages: (id, parent_id, level, sort_order, type, create_date, update_date, url, title)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import fields
from quern.operators import submissions
from quern.sources.tables import kept, remove, shared_path


def descendants(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """id, root_id, distance of everything below the roots, level by level until nothing is left.

    Each level is a table in the shared folder, so neither rows nor levels are bounded. A circle, which
    has no last level, raises.
    """
    spark, base = nodes.sparkSession, shared_path(nodes.sparkSession, "tree")
    links = kept(nodes.select(F.col("id").alias("below"), F.col("parent_id").alias("id")).where("id is not null"), f"{base}/links")
    most = links.count()
    level = roots.select("id", F.col("id").alias("root_id"), F.lit(0).alias("distance"))
    paths: list[str] = []
    while True:
        paths.append(f"{base}/{len(paths) + 1}")
        level = kept(level.join(links, "id").select(F.col("below").alias("id"), "root_id", F.lit(len(paths)).alias("distance")), paths[-1])
        if level.isEmpty():
            remove(spark, f"{base}/links")
            return spark.read.schema(level.schema).parquet(*paths)
        # A way down that meets no page twice is no longer than there are links.
        if len(paths) > most or not level.where("id = root_id").isEmpty():
            raise ValueError("the pages below a root form a circle")


def ancestors_or_self(nodes: DataFrame, start: DataFrame) -> DataFrame:
    """id, above, distance: each start and everything above it, a level of joins at a time until no row has a parent."""
    spark, base = nodes.sparkSession, shared_path(nodes.sparkSession, "up")
    links = kept(nodes.where("id is not null and parent_id is not null").select(F.col("id").alias("above"), F.col("parent_id").alias("next")), f"{base}/links")
    most = links.count()
    level = start.select("id", F.col("id").alias("above"), F.lit(0).alias("distance"))
    paths: list[str] = []
    while True:
        paths.append(f"{base}/{len(paths) + 1}")
        level = kept(level, paths[-1])
        if level.isEmpty():
            remove(spark, f"{base}/links")
            return spark.read.schema(level.schema).parquet(*paths)
        if len(paths) > most + 1:
            raise ValueError("the pages above a start form a circle")
        level = level.join(links, "above").select("id", F.col("next").alias("above"), F.lit(len(paths)).alias("distance"))


def below_roots(nodes: DataFrame) -> DataFrame:
    """The nodes that stand below a node without a parent."""
    return nodes.join(descendants(nodes, nodes.where("parent_id is null")).select("id").distinct(), "id", "left_semi")


def in_order(nodes: DataFrame, kind: str, take: int = 3) -> DataFrame:
    """The first pages of a type by sort order; ``take`` from 1 to 12."""
    return nodes.where(F.col("type") == kind).orderBy("sort_order", "id").limit(max(1, min(take, 12)))


#: Behind any step of a path that starts with a hexadecimal digit.
PAST = "g"


def tree_paths(nodes: DataFrame) -> DataFrame:
    """nodes below or at a root with ``path``, a text whose order is that of the document: each page before what is below it, siblings by sort order and id.

    A step is the sort order as 16 hexadecimal digits (its sign bit turned), the id, and a character below all that ids may
    hold. A page's path starts with those of the pages above it, so what is below it is the range from its path to that and PAST.
    Paths double: each round puts the path of the page reached so far in front and goes on from there, so a tree of n
    levels takes log2(n) rounds. Pages without a root above them have no path and are left out; a circle raises.
    """
    spark, base = nodes.sparkSession, shared_path(nodes.sparkSession, "paths")
    turned = F.col("sort_order").cast("long").bitwiseXOR(F.lit(-(1 << 63)))
    step = F.concat(F.lower(F.lpad(F.hex(turned), 16, "0")), F.col("id").cast("string"), F.lit("\x01"))
    level = kept(nodes.where("id is not null").select("id", F.col("parent_id").alias("up"), step.alias("path")), f"{base}/0")
    most, rounds = level.count(), 0
    while not level.where("up is not null").isEmpty():
        if 1 << rounds > 2 * most:
            raise ValueError("the pages above a page form a circle")
        above = level.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("path").alias("head"))
        rounds += 1
        # A parent that isn't there ends a path that no root begins.
        joined = level.where("up is not null").join(above, "up").select("id", F.col("next").alias("up"), F.concat("head", "path").alias("path"))
        new = kept(level.where("up is null").unionByName(joined), f"{base}/{rounds}")
        remove(spark, f"{base}/{rounds - 1}")
        level = new
    return nodes.join(level.select("id", "path"), "id")


def document_order(nodes: DataFrame) -> DataFrame:
    """nodes below or at a root with path, ``place`` (from 0, in document order) and ``last``, the place of the last page below or at it.

    What is below a page has the places after its own up to ``last``; the next page behind all that has ``last`` + 1. Places come from
    one sort over ranges of the pages' paths and of the ends of what is below them, whatever the depth of the tree.
    """
    spark = nodes.sparkSession
    pages = tree_paths(nodes)
    marks = F.explode(F.array(F.struct(F.col("path").alias("at"), F.lit(1).alias("page")), F.struct(F.concat("path", F.lit(PAST)).alias("at"), F.lit(0).alias("page")))).alias("m")
    ordered = pages.select("id", marks).select("id", "m.at", "m.page").repartitionByRange("at").sortWithinPartitions("at")
    ordered = kept(ordered.withColumn("seq", F.monotonically_increasing_id()).withColumn("part", F.shiftright("seq", 33)), shared_path(spark, "order"))
    # A row per part, and then the rows of a part in one task, as the sort had them.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ordered.groupBy("part").agg(F.sum("page").alias("n")).select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = ordered.withColumn("own", F.sum("page").over(inside)).join(F.broadcast(starts), "part").withColumn("count", F.col("before") + F.col("own") - 1)
    is_page = F.col("page") == 1
    places = counted.groupBy("id").agg(F.max(F.when(is_page, F.col("count"))).alias("place"), F.max(F.when(~is_page, F.col("count"))).alias("last"))
    return pages.join(places, "id")


def below_path(path: str) -> Column:
    """Whether a page with a path stands below or at the page of the given path."""
    return (F.col("path") >= path) & (F.col("path") < path + PAST)


def first_of(nodes: DataFrame, kind: str) -> DataFrame:
    """The first page of a type in document order."""
    return tree_paths(nodes).where(F.col("type") == kind).orderBy("path").limit(1).drop("path")


def cards(blocks: DataFrame, title: str, text: str, button: str, icons: tuple[str, ...], default_icon: str) -> DataFrame:
    """Visible blocks with defaults for blank texts and, where no icon is given, the one of their place among those shown.

    Only the first blocks can get an icon by place, so no more of them are numbered.
    """
    shown = visible(blocks, "visible")
    order = Window.orderBy("pos")
    first = shown.orderBy("pos").limit(len(icons)).withColumn("place", F.row_number().over(order) - 1).select("pos", "place")
    placed = shown.join(F.broadcast(first), "pos", "left")
    icon = F.coalesce(fields.non_blank(F.col("icon")), fields.by_position(F.col("place"), icons, default_icon))
    named = [F.coalesce(fields.non_blank(F.col(c)), F.lit(d)).alias(c) for c, d in (("title", title), ("text", text), ("button", button))]
    return placed.select("pos", *named, icon.alias("icon"))


def latest(nodes: DataFrame, kind: str, take: int = 3) -> DataFrame:
    """Newest pages of a type by publish date, else create date; ``take`` from 1 to 12."""
    rows = nodes.where(F.col("type") == kind)
    return rows.orderBy(F.coalesce("publish_date", "create_date").desc(), "id").limit(max(1, min(take, 12)))


def children(nodes: DataFrame, kind: str) -> DataFrame:
    """Direct children of a type with their place under the parent."""
    order = Window.partitionBy("parent_id").orderBy("sort_order", "id")
    return nodes.where(F.col("type") == kind).withColumn("place", F.row_number().over(order))


#: The type of the not-found page, what a document begins and ends with, and how many entries it may have.
NOT_FOUND = "page404"
URLSET = '<?xml version="1.0" encoding="UTF-8"?>\n<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">', "</urlset>"
SITEMAP_INDEX = '<?xml version="1.0" encoding="UTF-8"?>\n<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">', "</sitemapindex>"
MOST_ENTRIES = 50_000


def sitemap(nodes: DataFrame) -> DataFrame:
    """loc, lastmod, priority and place of pages with a template and an address; the not-found page is left out."""
    url = F.col("url")
    kept = nodes.where((F.col("type") != NOT_FOUND) & F.col("has_template") & (F.length(F.trim(url)) > 0) & (url != "#"))
    return kept.select("id", "level", "sort_order", fields.xml_escape(url).alias("loc"), F.date_format("update_date", "yyyy-MM-dd").alias("lastmod"), fields.level_priority(F.col("level")).alias("priority"))


def sitemap_xml(entries: DataFrame) -> DataFrame:
    """A line of XML per entry, in order of level and sort order."""
    line = F.format_string("<url><loc>%s</loc><lastmod>%s</lastmod><priority>%.1f</priority></url>", "loc", "lastmod", "priority")
    return entries.orderBy("level", "sort_order", "id").select(line.alias("value"))


def write_sitemap(nodes: DataFrame, path: str, base_url: str, entries: int = MOST_ENTRIES) -> None:
    """XML documents of at most so many entries, as text files in ``path``/urls/file=<n>, and an index of them in ``path``/index.

    Entries stand by level and sort order, equal ones in document order, from one document to the next; only pages below or at a root are
    entries. A document is one file of one task, as it is bounded; the sort is spread over ranges.
    """
    ordered = tree_paths(nodes)
    placed = submissions.with_ids(sitemap(ordered).join(ordered.select("id", "path"), "id"), -1, "level", "sort_order", "path", name="place")
    tags = [f"    <loc>{base_url}", F.col("loc"), "</loc>\n    <lastmod>", F.col("lastmod"), "</lastmod>\n    <changefreq>weekly</changefreq>\n    <priority>", F.format_string("%.1f", "priority")]
    entry = F.concat(F.lit("  <url>\n"), *[F.lit(t) if isinstance(t, str) else t for t in tags], F.lit("</priority>\n  </url>"))
    file = F.floor(F.col("place") / entries).cast("long").alias("file")
    lines = placed.select(file, "place", entry.alias("value"))
    files = lines.select("file").distinct()
    ends = [files.select("file", F.lit(at).cast("long").alias("place"), F.lit(text).alias("value")) for at, text in zip((-1, (1 << 62)), URLSET, strict=True)]
    whole = lines.unionByName(ends[0]).unionByName(ends[1])
    # A document without entries is written for a tree without pages.
    if files.isEmpty():
        empty = nodes.sparkSession.createDataFrame([(0, k, t) for k, t in enumerate(URLSET)], "file long, place long, value string")
        whole, files = empty, empty.select("file").distinct()
    whole.repartition("file").sortWithinPartitions("file", "place").select("file", "value").write.partitionBy("file").text(f"{path}/urls")
    listed = files.select((F.col("file") + 1).alias("k"), F.concat(F.lit(f"  <sitemap><loc>{base_url}/sitemap-"), F.col("file"), F.lit(".xml</loc></sitemap>")).alias("value"))
    ends = nodes.sparkSession.createDataFrame([(0, SITEMAP_INDEX[0]), (1 << 62, SITEMAP_INDEX[1])], "k long, value string")
    # A row per document.
    listed.unionByName(ends).coalesce(1).sortWithinPartitions("k").select("value").write.text(f"{path}/index")


def is_active(current: Column, target: Column, ancestor_paths: Column) -> Column:
    """A menu entry is active if its path is a prefix of the current one or that of an ancestor."""
    prefix = (current == target) | F.startswith(current, F.concat(target, F.lit("/")))
    return (target != "") & (prefix | F.array_contains(ancestor_paths, target))


def with_parent_url(nodes: DataFrame, default: str) -> DataFrame:
    parents = nodes.select(F.col("id").alias("parent_id"), F.col("url").alias("parent_url"))
    return nodes.join(parents, "parent_id", "left").withColumn("parent_url", F.coalesce(fields.non_blank(F.col("parent_url")), F.lit(default)))


def visible(rows: DataFrame, flag: str, *needed: str) -> DataFrame:
    """Rows whose flag is missing or true and whose named columns are not blank."""
    out = rows.where(F.coalesce(flag, F.lit(True)))
    for column in needed:
        out = out.where(F.length(F.trim(column)) > 0)
    return out


def category_order(categories: DataFrame) -> DataFrame:
    """Visible categories, "all" first, others as they come."""
    shown = visible(categories, "visible", "key", "title").withColumn("_rest", F.col("key") != "all")
    placed = submissions.with_ids(shown, 0, "_rest", "pos")
    return placed.withColumnRenamed("id", "place").withColumn("place", F.col("place").cast("int")).drop("_rest")


def in_category(selected: str) -> Column:
    return F.lit(selected == "all") | (F.col("category") == selected)


def or_defaults(source: DataFrame, shown: DataFrame, defaults: DataFrame) -> DataFrame:
    """Default rows only if the source is empty before any row is hidden."""
    empty = source.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(1).alias("_one"))
    return shown.unionByName(defaults.withColumn("_one", F.lit(1)).join(F.broadcast(empty), "_one").drop("_one"))


def media_or(urls: Column, fallback: list[str]) -> Column:
    """Urls that are not blank, or the fallback if none is left."""
    kept = F.filter(F.coalesce(urls, F.array().cast("array<string>")), lambda u: F.length(F.trim(u)) > 0)
    return F.when(F.size(kept) == 0, F.array(*map(F.lit, fallback))).otherwise(kept)
