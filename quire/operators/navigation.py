"""Reading order, navigation trees, page lists and what a package document is made of.

A tree is adjacency rows: ``path`` is the array of positions from the root, whose order is the tree's pre-order, so the
numbers that a walk would give are row numbers over it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import items as I
from ..workdir import written
from .catalogue import BOOK, first_by, first_ids


def play_order(toc: DataFrame, start_from: int = 1) -> DataFrame:
    w = Window.partitionBy(BOOK).orderBy("path")
    return toc.withColumn("play_order", F.row_number().over(w) + (start_from - 1))


def section_ids(toc: DataFrame) -> DataFrame:
    """``nav_id``: sections are ``sep_N`` by the pre-order number of nodes with children; a document with children uses up a number and keeps its own id."""
    inner = F.col("node_kind").isin("section", "document_section")
    n = F.row_number().over(Window.partitionBy(BOOK, inner).orderBy("path")) - 1
    return toc.withColumn("nav_id", F.when(F.col("node_kind") == "section", F.concat(F.lit("sep_"), n.cast("string"))).otherwise(F.col("uid")))


def inherited_src(toc: DataFrame) -> DataFrame:
    """``src``: a node's link, or for a section without one the first link among the leaves right below it."""
    leaf = toc.where(F.col("node_kind").isin("link", "document") & (F.coalesce("href", F.lit("")) != ""))
    first = leaf.groupBy(BOOK, F.col("parent_path").alias("path")).agg(F.min_by("href", "path").alias("below"))
    return toc.join(first, [BOOK, "path"], "left").withColumn("src", F.coalesce(F.nullif("href", F.lit("")), "below", F.lit(""))).drop("below")


def _jump(nodes: DataFrame, name: str, columns: dict) -> DataFrame:
    """Rows (book, id, up, ...) whose ``up`` is moved to its own ``up`` until none moves: the way left halves each round. What is left with an ``up`` is in a circle, or leads to one."""
    left = None
    while True:
        open_ = nodes.where("up IS NOT NULL").count()
        if open_ in (0, left):
            return nodes
        left = open_
        above = nodes.select(F.col(BOOK).alias("book_"), F.col("id").alias("id_"), F.col("up").alias("up_"), *[F.col(c).alias(f"{c}_") for c in columns])
        met = nodes.join(above, (F.col(BOOK) == F.col("book_")) & (F.col("up") == F.col("id_")), "left")
        moved = {c: F.when(F.col("up").isNull(), F.col(c)).otherwise(how(F.col(f"{c}_"), F.col(c))).alias(c) for c, how in columns.items()}
        nodes = written(met.select(BOOK, "id", F.when(F.col("up").isNotNull(), F.col("up_")).alias("up"), *moved.values()), name)


def _adjacent(nodes: DataFrame, id_: str, parent: str, order: str) -> DataFrame:
    """book, id, parent, ord, and ``orphan``, whether the parent isn't there."""
    own = nodes.select(BOOK, F.col(id_).alias("id"), F.col(parent).alias("parent"), F.col(order).cast("int").alias("ord"))
    known = own.select(F.col(BOOK).alias("book_"), F.col("id").alias("id_"))
    met = own.join(known, (F.col(BOOK) == F.col("book_")) & (F.col("parent") == F.col("id_")), "left")
    return met.select(BOOK, "id", "parent", "ord", (F.col("parent").isNotNull() & F.col("id_").isNull()).alias("orphan"))


def walk(nodes: DataFrame, id_: str = "id", parent: str = "parent", order: str = "ord") -> DataFrame:
    """Adjacency rows (book, id, parent, ord; ids are unique in a book) as ``path`` and ``depth``, by pointer jumping: a tree of any depth takes a logarithmic number of joins.

    ``error`` tells rows that hang on no root, without a path: ``orphan`` (an ancestor isn't there) or ``cycle``. A path is as long as its node is deep; ``preorder`` numbers nodes of deep trees without.
    """
    own = _adjacent(nodes, id_, parent, order)
    start = written(own.select(BOOK, "id", F.when(~F.col("orphan"), F.col("parent")).alias("up"), "orphan", F.array("ord").alias("path")), "nodes")
    done = _jump(start, "paths", {"orphan": lambda above, here: above, "path": lambda above, here: F.concat(above, here)})
    error = F.when(F.col("up").isNotNull(), "cycle").when(F.col("orphan"), "orphan")
    path = F.when(error.isNull(), F.col("path"))
    return done.select(BOOK, "id", path.alias("path"), F.when(error.isNull(), F.size("path")).alias("depth"), error.alias("error"))


def preorder(nodes: DataFrame, id_: str = "id", parent: str = "parent", order: str = "ord") -> DataFrame:
    """Adjacency rows (book, id, parent, ord; ids are unique in a book) as ``number``, their place in pre-order from 1 on in each book, and ``depth``, without paths: memory is linear in chains too.

    The tour down and up each node is a list, and lists are ranked by pointer jumping, so a book takes joins by the logarithm of its nodes. ``error`` is as in ``walk``; nodes of one place go by their ids.
    """
    own = written(_adjacent(nodes, id_, parent, order), "nodes")
    at = lambda side, c: F.concat(F.lit(side), F.col(c).cast("string"))
    above = F.when(~F.col("orphan"), F.col("parent"))
    # Orphans head lists of their own, each by itself.
    group = F.when(F.col("orphan"), F.concat(F.lit("orphan"), F.col("id").cast("string"))).otherwise(F.coalesce(F.concat(F.lit("of"), F.col("parent").cast("string")), F.lit("top")))
    linked = own.withColumn("next", F.lead("id").over(Window.partitionBy(BOOK, group).orderBy("ord", "id"))).withColumn("above", above)
    first = own.where("parent IS NOT NULL AND NOT orphan").groupBy(BOOK, F.col("parent").alias("id")).agg(F.min_by("id", F.struct("ord", "id")).alias("first"))
    linked = linked.join(first, [BOOK, "id"], "left")
    down = linked.select(BOOK, at("d", "id").alias("id"), F.coalesce(at("d", "first"), at("u", "id")).alias("up"), F.lit(1).cast("long").alias("n"), F.lit(1).cast("long").alias("level"), "orphan")
    up = linked.select(BOOK, at("u", "id").alias("id"), F.coalesce(at("d", "next"), at("u", "above")).alias("up"), F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("level"), "orphan")
    plus = lambda there, here: here + there
    ranked = _jump(written(down.unionByName(up), "tour"), "tour", {"n": plus, "level": plus, "orphan": lambda there, here: there})
    entered = ranked.where("id LIKE 'd%'").select(F.col(BOOK).alias("book_"), F.substring("id", 2, 1 << 30).alias("id_"), F.col("up"), "n", "level", F.col("orphan").alias("orphan_"))
    total = entered.where("up IS NULL AND NOT orphan_").groupBy(F.col("book_").alias("book__")).agg(F.max("n").alias("total"))
    met = own.join(entered, (F.col(BOOK) == F.col("book_")) & (F.col("id").cast("string") == F.col("id_"))).join(total, F.col(BOOK) == F.col("book__"), "left")
    error = F.when(F.col("up").isNotNull(), "cycle").when(F.col("orphan_"), "orphan")
    known = lambda c: F.when(error.isNull(), c)
    return met.select(BOOK, "id", known(F.col("total") - F.col("n") + 1).alias("number"), known((1 - F.col("level")).cast("int")).alias("depth"), error.alias("error"))


def _level(number: str, step: int) -> Column:
    """The depth of the node before or after in a book's order, 0 beyond its ends."""
    return F.coalesce((F.lag if step < 0 else F.lead)("depth").over(Window.partitionBy(BOOK).orderBy(number)), F.lit(0))


def _text(nodes: DataFrame, number: str, text: Column) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct(F.col(number).alias("n_"), text.alias("t_"))))
    return nodes.groupBy(BOOK).agg(F.array_join(F.transform(parts, lambda x: x["t_"]), "").alias("text"))


def ncx_text(nodes: DataFrame, number: str = "number") -> DataFrame:
    """book and ``text``: the navigation points of an older navigation file, of nodes (book, number in pre-order, depth from 1, nav_id, title, src). A node's tags close by how much shallower the next one is, so trees
    of any depth are text without a walk."""
    n = nodes.withColumns({"after_": _level(number, 1)})
    ends = F.repeat(F.lit("</navPoint>"), F.greatest(F.col("depth") - F.greatest("after_", F.lit(1)) + 1, F.lit(0)).cast("int"))
    e = lambda c: H.escape(F.coalesce(F.col(c), F.lit("")))
    return _text(n, number, F.concat(F.lit('<navPoint id="'), e("nav_id"), F.lit('"><navLabel><text>'), e("title"), F.lit('</text></navLabel><content src="'), e("src"), F.lit('"/>'), ends))


def nav_text(nodes: DataFrame, number: str = "number") -> DataFrame:
    """book and ``text``: the nested lists of a navigation document, of nodes (book, number in pre-order, depth from 1, title, href); a node without a link is a span."""
    n = nodes.withColumns({"before_": _level(number, -1), "after_": _level(number, 1)})
    e = lambda c: H.escape(F.coalesce(F.col(c), F.lit("")))
    own = F.when(F.coalesce("href", F.lit("")) == "", F.concat(F.lit("<span>"), e("title"), F.lit("</span>"))).otherwise(F.concat(F.lit('<a href="'), e("href"), F.lit('">'), e("title"), F.lit("</a>")))
    up = F.when(F.col("after_") > 0, F.greatest(F.col("depth") - F.col("after_"), F.lit(0))).otherwise(F.col("depth") - 1)
    ends = F.when(F.col("after_") > F.col("depth"), "").otherwise(F.concat(F.lit("</li>"), F.repeat(F.lit("</ol></li>"), up.cast("int")), F.when(F.col("after_") == 0, "</ol>").otherwise("")))
    return _text(n, number, F.concat(F.when(F.col("before_") < F.col("depth"), "<ol>").otherwise(""), F.lit("<li>"), own, ends))


def spine_rows(spine: DataFrame, items: DataFrame) -> DataFrame:
    """Each reference with its item, and ``linear``: "no" if the item or the reference says so; a reference to nothing stays, as "yes"."""
    known = first_ids(items).select(BOOK, F.col("id").alias("idref"), F.col("is_linear"), F.col("file_name"), F.lit(True).alias("found"))
    out = spine.join(known, [BOOK, "idref"], "left")
    no = F.col("found").isNotNull() & (~F.coalesce("is_linear", F.lit(True)) | (F.coalesce("linear", F.lit("yes")) == "no"))
    return out.withColumn("linear", F.when(no, "no").otherwise("yes")).withColumn("found", F.col("found").isNotNull()).drop("is_linear")


def spine_ncx(books: DataFrame, items: DataFrame, toc_id: str = "toc_id") -> DataFrame:
    """Each book's navigation file by the id that its spine names; books whose id leads nowhere are left out."""
    known = first_ids(items).select(BOOK, F.col("id").alias(toc_id), "file_name")
    return books.where(F.col(toc_id).isNotNull()).join(known, [BOOK, toc_id])


def first_of_kind(items: DataFrame, kind: str) -> DataFrame:
    return first_by(items.where(F.col("kind") == kind), [BOOK], ["pos"])


def package_uid(metadata: DataFrame, identifier_id: DataFrame) -> DataFrame:
    """Each book's identifier whose id is the package's; the last of equals."""
    ids = metadata.where((F.col("ns") == I.C.NAMESPACES["DC"]) & (F.col("name") == "identifier")).withColumn("id_", F.get(F.filter("attrs", lambda a: a["k"] == "id"), F.lit(0))["v"])
    own = ids.join(identifier_id, BOOK).where(F.col("id_") == F.col("identifier_id"))
    return own.groupBy(BOOK).agg(F.max_by("value", "seq").alias("uid"))


def split_page(href: Column | str) -> tuple[Column, Column]:
    """(file name, fragment) of a page's link; with no ``#`` or several, the whole link is the file name."""
    h = F.col(href) if isinstance(href, str) else href
    one = F.size(F.split(h, "#")) == 2
    return F.when(one, F.get(F.split(h, "#"), F.lit(0))).otherwise(h), F.when(one, F.get(F.split(h, "#"), F.lit(1)))


def pages_of_documents(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """Pages (book, pos, href, label) joined with their documents by file name (the last of equal names); others are dropped."""
    name, fragment = split_page("href")
    rest = [c for c in documents.columns if c not in (BOOK, "file_name")]
    last = documents.groupBy(BOOK, "file_name").agg(F.max_by(F.struct(*rest), F.struct("pos")).alias("d_"))
    last = last.select(BOOK, "file_name", *[F.col(f"d_.{c}").alias(f"doc_{c}") for c in rest])
    return pages.withColumn("file_name", name).withColumn("fragment", fragment).join(last, [BOOK, "file_name"])


def flatten_pages(documents: DataFrame, pages: str = "pages") -> DataFrame:
    """Each document's pages one after the other: pos counts over the book."""
    own = documents.select(BOOK, F.col("pos").alias("doc_pos"), F.posexplode(pages).alias("n", "page"))
    return own.withColumn("pos", F.row_number().over(Window.partitionBy(BOOK).orderBy("doc_pos", "n")) - 1)


def book_pages(items: DataFrame, pages: str = "pages") -> DataFrame:
    """Pages of documents whose id was given automatically, as ``add_item`` collects them."""
    return flatten_pages(items.where(F.col("id").isNull() & F.col("kind").isin("html", "cover_html", "nav")), pages)


def manifest_rows(items: DataFrame) -> DataFrame:
    """The manifest: href, id, media type, properties, overlay and duration of items that belong in it."""
    plain = ~F.col("kind").isin("nav", "ncx", "cover")
    props = F.when(F.col("kind") == "nav", "nav").when(F.col("kind") == "cover", "cover-image").when(plain & (F.size("properties") > 0), F.array_join("properties", " "))
    return items.where("manifest").select(
        BOOK, "pos", F.col("file_name").alias("href"), F.coalesce("id", F.lit("")).alias("id"), "media_type", props.alias("properties"),
        F.when(plain, F.col("media_overlay")).alias("media_overlay"), F.when(plain, F.col("media_duration")).alias("duration"),
    )


def guide_rows(guide: DataFrame, items: DataFrame) -> DataFrame:
    """Guide references; an item's file name and title go before given ones."""
    known = first_ids(items).select(BOOK, F.col("id").alias("item_id"), F.col("file_name").alias("f_"), F.col("title").alias("t_"), F.lit(True).alias("found_"))
    g = guide.join(known, [BOOK, "item_id"], "left")
    pick = lambda own, given: F.coalesce(F.when(F.col("found_").isNotNull(), F.col(own)).otherwise(F.col(given)), F.lit(""))
    return g.select(BOOK, "pos", F.coalesce("type", F.lit("")).alias("type"), pick("t_", "title").alias("title"), pick("f_", "href").alias("href"))


def landmarks(guide: DataFrame) -> DataFrame:
    """Landmark entries of resolved guide rows: those with a link, under the landmark's name."""
    return guide.where(F.coalesce("href", F.lit("")) != "").withColumn("type", I.landmark_type("type"))


def entry_paths(items: DataFrame, folder: Column | str = "EPUB") -> DataFrame:
    """Where each item is in the container: under the folder if it is in the manifest, else at the root."""
    f = F.lit(folder) if isinstance(folder, str) else folder
    return items.withColumn("entry", F.when(F.col("manifest"), F.concat(f, F.lit("/"), F.col("file_name"))).otherwise(F.col("file_name")))
