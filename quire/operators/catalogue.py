"""Lookups and accumulation over the catalogue tables: items, metadata and their attributes.

All windows are partitioned by book, so the largest group is one book's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import items as I

BOOK = "book"


def items_in_order(items: DataFrame, content: bool = False) -> DataFrame:
    """Items in the order of their books. The sort moves the catalogue alone, unless ``content`` is asked for too."""
    return (items if content else items.drop("content")).orderBy(BOOK, "pos")


def with_type(items: DataFrame) -> DataFrame:
    return items.withColumn("item_type", I.item_type("kind", "file_name"))


def items_of_type(items: DataFrame, item_type: int) -> DataFrame:
    return with_type(items).where(F.col("item_type") == item_type)


def items_of_media_type(items: DataFrame, media_type: str) -> DataFrame:
    return items.where(F.col("media_type") == media_type)


def first_by(df: DataFrame, keys: list[str], order: list[Column | str], keep: list[str] | None = None) -> DataFrame:
    """The first row of each key: an aggregation that combines before its shuffle, not a sort of the group."""
    rest = [c for c in (keep or df.columns) if c not in keys]
    ordered = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    out = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), ordered).alias("first_"))
    return out.select(*keys, *[F.col(f"first_.{c}").alias(c) for c in rest])


def item_with_id(items: DataFrame, uid: str) -> DataFrame:
    """In each book, the first item with the id."""
    return first_by(items.where(F.col("id") == uid), [BOOK], ["pos"])


def item_with_href(items: DataFrame, href: str) -> DataFrame:
    return first_by(items.where(F.col("file_name") == href), [BOOK], ["pos"])


def first_ids(items: DataFrame) -> DataFrame:
    """The first item of each (book, id): the table to join id references with."""
    return first_by(items.where("id IS NOT NULL"), [BOOK, "id"], ["pos"])


def get_metadata(metadata: DataFrame, ns: str | None, name: str) -> DataFrame:
    """The entries of a namespace (short name or URI) and name in order; none for an unknown namespace."""
    uri = C.NAMESPACES.get(ns, ns) if ns else ns
    return metadata.where(F.col("ns").eqNullSafe(F.lit(uri)) & (F.col("name") == name)).orderBy(BOOK, "seq")


def multimap(metadata: DataFrame) -> DataFrame:
    """Each (book, ns, name) with its values in order."""
    pairs = F.array_sort(F.collect_list(F.struct("seq", "value")))
    return metadata.groupBy(BOOK, I.namespace("ns").alias("ns"), "name").agg(F.transform(pairs, lambda x: x["value"]).alias("values"))


def add_metadata(metadata: DataFrame, rows: DataFrame) -> DataFrame:
    """Append ``rows`` (book, ns, name, value, attrs, and ``seq`` for their order) after each book's entries."""
    last = metadata.groupBy(BOOK).agg((F.max("seq") + 1).alias("from_"))
    new = rows.withColumn("n_", F.row_number().over(Window.partitionBy(BOOK).orderBy("seq"))).join(last, BOOK, "left")
    new = new.withColumn("seq", (F.coalesce("from_", F.lit(0)) + F.col("n_") - 1).cast("int")).drop("from_", "n_").withColumn("ns", I.namespace("ns"))
    return metadata.unionByName(new)


def set_unique(writes: DataFrame, keys: list[str], order: list[str], unique: str | None = None) -> DataFrame:
    """Writes to a multimap of which some are unique (replace all before them): the values that stay.

    Without ``unique`` every write is, and the last one of each key stays.
    """
    if unique is None:
        rest = [c for c in writes.columns if c not in keys]
        out = writes.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("last_"))
        return out.select(*keys, *[F.col(f"last_.{c}").alias(c) for c in rest])
    at = F.struct(*order)
    marks = writes.where(unique).groupBy(*keys).agg(F.max(at).alias("mark_"))
    return writes.join(marks, keys, "left").where(F.col("mark_").isNull() | (at >= F.col("mark_"))).drop("mark_")


def auto_ids(items: DataFrame) -> DataFrame:
    """Ids for items that lack one: ``chapter_N``, ``image_N`` or ``static_N``, N counting from 0 in each book."""
    stem = F.coalesce(I.choose(F.col("kind"), C.ID_STEMS), F.lit("static"))
    w = Window.partitionBy(BOOK, stem, F.col("id").isNull()).orderBy("pos")
    made = F.concat(stem, F.lit("_"), (F.row_number().over(w) - 1).cast("string"))
    return items.withColumn("id", F.coalesce("id", made))


def with_media_types(items: DataFrame, encoding_wins: bool = False) -> DataFrame:
    return items.withColumn("media_type", I.media_type_default(F.coalesce("media_type", F.lit("")), "file_name", encoding_wins))


def author_ids(authors: DataFrame) -> DataFrame:
    """``id`` of each author: a given uid, else ``creator``, ``creator_1``, ...; given ones don't advance the count."""
    n = F.row_number().over(Window.partitionBy(BOOK, F.col("uid").isNull()).orderBy("seq")) - 1
    made = F.when(n == 0, "creator").otherwise(F.concat(F.lit("creator_"), n.cast("string")))
    return authors.withColumn("id", F.coalesce("uid", made))


def author_metadata(authors: DataFrame) -> DataFrame:
    """The metadata entries of authors (book, seq, author, file_as, role, uid): the creator and up to two that refine it."""
    own = author_ids(authors)
    attr = lambda **kv: F.array(*[F.struct(F.lit(k.replace("_", "-")).alias("k"), v.alias("v")) for k, v in kv.items()])
    ref = F.concat(F.lit("#"), F.col("id"))
    row = lambda name, ns, value, attrs: F.struct(F.lit(ns).alias("ns"), F.lit(name).alias("name"), value.alias("value"), attrs.alias("attrs"))
    rows = F.array(
        row("creator", C.NAMESPACES["DC"], F.col("author"), attr(id=F.col("id"))),
        F.when(F.col("file_as").isNotNull(), row("meta", None, F.col("file_as"), F.array(F.struct(F.lit("refines").alias("k"), ref.alias("v")), F.struct(F.lit("property").alias("k"), F.lit("file-as").alias("v")), F.struct(F.lit("scheme").alias("k"), F.lit("marc:relators").alias("v"))))),
        F.when(F.col("role").isNotNull(), row("meta", None, F.col("role"), F.array(F.struct(F.lit("refines").alias("k"), ref.alias("v")), F.struct(F.lit("property").alias("k"), F.lit("role").alias("v")), F.struct(F.lit("scheme").alias("k"), F.lit("marc:relators").alias("v"))))),
    )
    out = own.select(BOOK, "seq", F.posexplode(F.filter(rows, lambda r: r.isNotNull())).alias("sub", "m"))
    return out.select(BOOK, "seq", "sub", "m.ns", "m.name", "m.value", "m.attrs")


def links_of_type(items: DataFrame, link_type: str | None = None) -> DataFrame:
    """A row for each link of each document, or of those of one type (a link without a type has the empty one)."""
    found = F.col("links") if link_type is None else F.filter("links", lambda x: F.coalesce(F.try_element_at(x, F.lit("type")), F.lit("")) == link_type)
    return items.select(BOOK, "pos", F.posexplode(found).alias("n", "link"))


def metas(items: DataFrame) -> DataFrame:
    return items.select(BOOK, "pos", F.posexplode("metas").alias("n", "meta"))


def add_property(properties: Column | str, token: str) -> Column:
    """A set of tokens with one more, in order of arrival."""
    have = F.coalesce(F.col(properties) if isinstance(properties, str) else properties, F.array().cast("array<string>"))
    return F.array_union(have, F.array(F.lit(token)))


def add_link(items: DataFrame, where: Column, link: dict[str, str]) -> DataFrame:
    """Append a link to the documents in ``where``; a script sets their ``scripted`` property."""
    new = F.array(F.create_map(*[F.lit(x) for kv in link.items() for x in kv]))
    out = items.withColumn("links", F.when(where, F.concat(F.coalesce("links", F.array().cast("array<map<string,string>>")), new)).otherwise(F.col("links")))
    if link.get("type") == "text/javascript":
        out = out.withColumn("properties", F.when(where, add_property("properties", "scripted")).otherwise(F.col("properties")))
    return out


def add_meta(items: DataFrame, where: Column, meta: dict[str, str]) -> DataFrame:
    new = F.array(F.create_map(*[F.lit(x) for kv in meta.items() for x in kv]))
    return items.withColumn("metas", F.when(where, F.concat(F.coalesce("metas", F.array().cast("array<map<string,string>>")), new)).otherwise(F.col("metas")))


#: What one task takes of the documents of one id: bytes of their links, written out for each of them, and rows.
LINK_BYTES, LINK_ROWS = 64 << 20, 100_000


def attach(documents: DataFrame, attached: DataFrame) -> DataFrame:
    """Links of documents (book, pos, id) to attached items (book, document id, item file_name and item_type): styles become stylesheet links, scripts script links, others nothing.

    Each document of an id gets all links of the id, so rows of a few bytes can become large. Ids whose documents and links are many are dealt to several tasks, each with a copy of the links. Those ids
    alone are broadcast, one for each ``LINK_BYTES`` that are written or ``LINK_ROWS`` documents at most; partitions aren't merged by the bytes that they read.
    """
    link = F.when(F.col("item_type") == C.STYLE, F.struct(F.lit("stylesheet").alias("rel"), F.lit("text/css").alias("type"))).when(F.col("item_type") == C.SCRIPT, F.struct(F.lit(None).cast("string").alias("rel"), F.lit("text/javascript").alias("type")))
    own = attached.withColumn("l", link).where("l IS NOT NULL")
    per = own.groupBy(BOOK, "id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "file_name", "l"))), lambda x: F.concat_ws("|", F.coalesce(x["l"]["rel"], F.lit("")), x["file_name"], x["l"]["type"])).alias("links"),
        F.max((F.col("item_type") == C.SCRIPT).cast("int")).alias("scripted"),
    )
    keyed = F.col(BOOK).isNotNull() & F.col("id").isNotNull()
    sizes = own.groupBy(BOOK, "id").agg(F.sum(F.octet_length("file_name") + 30).alias("size_"))
    rows = documents.where(keyed).groupBy(BOOK, "id").agg(F.count("*").alias("rows_")).join(sizes, [BOOK, "id"], "left")
    parts = rows.select(BOOK, "id", F.greatest(F.ceil(F.col("rows_") * F.coalesce("size_", F.lit(0)) / LINK_BYTES), F.ceil(F.col("rows_") / LINK_ROWS)).alias("parts_")).where("parts_ > 1")
    n, hashed = F.coalesce("parts_", F.lit(1).cast("long")), F.xxhash64("pos")
    dealt = documents.join(F.broadcast(parts), [BOOK, "id"], "left").withColumn("part_", F.when(keyed, F.pmod(hashed, n)).otherwise(hashed)).drop("parts_")
    copies = per.join(F.broadcast(parts), [BOOK, "id"], "left").withColumn("part_", F.explode(F.sequence(F.lit(0).cast("long"), n - 1))).drop("parts_")
    tasks = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(tasks, BOOK, "id", "part_").join(copies, [BOOK, "id", "part_"], "left").drop("part_")


def set_value(items: DataFrame, where: Column, column: str, value: str | bool | None) -> DataFrame:
    """A column of the items in ``where`` set to ``value``: title, lang, direction, media_overlay and so on."""
    return items.withColumn(column, F.when(where, F.lit(value).cast(items.schema[column].dataType)).otherwise(F.col(column)))


def set_language(items: DataFrame, where: Column, lang: str | None) -> DataFrame:
    return set_value(items, where, "lang", lang)


def set_direction(items: DataFrame, where: Column, direction: str | None) -> DataFrame:
    return set_value(items, where, "direction", direction)


def set_template(books: DataFrame, name: str, template: bytes) -> DataFrame:
    """Books whose new documents of a kind (chapter, nav, cover, ncx) start from ``template``."""
    have = F.coalesce("templates", F.create_map().cast("map<string,binary>"))
    return books.withColumn("templates", F.map_concat(F.map_filter(have, lambda k, v: k != name), F.create_map(F.lit(name), F.lit(template))))


def add_prefix(books: DataFrame, name: str, uri: str) -> DataFrame:
    have = F.coalesce("prefixes", F.array().cast("array<string>"))
    return books.withColumn("prefixes", F.concat(have, F.array(I.prefix(F.lit(name), F.lit(uri)))))


def set_identifiers(metadata: DataFrame, uids: DataFrame, identifier_id: str = "id") -> DataFrame:
    """``metadata`` with the one identifier of each book of ``uids`` (book, uid); it replaces all that the book had."""
    own = (F.col("ns").eqNullSafe(F.lit(C.NAMESPACES["DC"]))) & (F.col("name") == "identifier")
    rest = metadata.join(uids.select(BOOK, F.lit(True).alias("new_")), BOOK, "left").where(~(own & F.col("new_").isNotNull())).drop("new_")
    attrs = F.array(F.struct(F.lit("id").alias("k"), F.lit(identifier_id).alias("v")))
    return add_metadata(rest, uids.select(BOOK, F.lit(0).alias("seq"), F.lit("DC").alias("ns"), F.lit("identifier").alias("name"), F.col("uid").alias("value"), attrs.alias("attrs")))


def add_titles(metadata: DataFrame, titles: DataFrame, name: str = "title") -> DataFrame:
    """One more title (or language: ``name``) of each book of ``titles`` (book, value)."""
    none = F.array().cast("array<struct<k:string,v:string>>")
    return add_metadata(metadata, titles.select(BOOK, F.lit(0).alias("seq"), F.lit("DC").alias("ns"), F.lit(name).alias("name"), "value", none.alias("attrs")))


def set_content(items: DataFrame, where: Column, value: bytes) -> DataFrame:
    return items.withColumn("content", F.when(where, F.lit(value)).otherwise(F.col("content")))


def set_cover(items: DataFrame, metadata: DataFrame, covers: DataFrame, create_page: bool = True) -> tuple[DataFrame, DataFrame]:
    """Add each book's cover (``covers``: book, file_name, content): the image, its page unless left out, and the metadata entry that names it."""
    last = items.groupBy(BOOK).agg((F.max("pos") + 1).alias("from_"))
    own = covers.join(last, BOOK, "left").withColumn("from_", F.coalesce("from_", F.lit(0)))
    empty_items = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in items.schema}

    def rows(at: int, **values: Column) -> DataFrame:
        cells = empty_items | {"book": F.col(BOOK), "pos": (F.col("from_") + at).cast("int").alias("pos"), "manifest": F.lit(True).alias("manifest")}
        return own.select(*[values[c].cast(items.schema[c].dataType).alias(c) if c in values else cells[c] for c in items.columns])

    out = items.unionByName(rows(0, kind=F.lit("cover"), id=F.lit("cover-img"), file_name=F.col("file_name"), media_type=I.media_type_default(F.lit(""), "file_name"), is_linear=F.lit(True), content=F.col("content")))
    if create_page:
        out = out.unionByName(rows(1, kind=F.lit("cover_html"), id=F.lit("cover"), file_name=F.lit("cover.xhtml"), media_type=F.lit(C.XHTML_TYPE), title=F.lit("Cover"), is_linear=F.lit(False)))
    entry = covers.select(
        BOOK, F.lit(0).alias("seq"), F.lit(None).cast("string").alias("ns"), F.lit("meta").alias("name"), F.lit("").alias("value"),
        F.array(F.struct(F.lit("name").alias("k"), F.lit("cover").alias("v")), F.struct(F.lit("content").alias("k"), F.lit("cover-img").alias("v"))).alias("attrs"),
    )
    return out, add_metadata(metadata, entry)


def document_languages(items: DataFrame, books: DataFrame) -> DataFrame:
    own = books.select(BOOK, F.col("language").alias("book_language"))
    return items.join(own, BOOK, "left").withColumn("lang", I.language("lang", "book_language")).drop("book_language")
