"""Corpus-shaped views of the star-schema tables, for queries without containers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXTS = (".jpg", ".jpeg", ".png", ".css", ".svg", ".js", ".otf", ".woff", ".mov", ".mp4", ".mp3", ".ogg", ".smil", ".XHTML", ".svg.gz", "", "/.js", ".tar.gz")
MEDIA = ("application/x-dtbncx+xml", "application/smil+xml", "application/xhtml+xml", "image/jpeg", "image/jpg", "image/png", "image/svg+xml", "image/gif", "text/css")
PROPS = ("nav", "cover", "cover-image", "scripted svg", "")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: tuple[str, ...], index) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def items(spark: SparkSession, sf_dir: str, by_source: bool = False) -> DataFrame:
    """Documents as items of a book of their source, with a hundred of them at most; ``by_source``: a source is one book."""
    d, i = read(spark, sf_dir, "documents"), F.col("doc_id")
    book = F.col("source") if by_source else F.concat("source", F.lit("/"), F.expr("(doc_id div 100)").cast("string"))
    return d.select(
        book.alias("book"), i.alias("pos"),
        F.when(i % 7 == 0, "nav").when(i % 7 == 1, "cover").when(i % 7 == 2, "ncx").when(i % 7 < 5, "html").otherwise("item").alias("kind"),
        F.when(i % 4 != 0, F.concat(F.lit("i"), (i % 50).cast("string"))).alias("id"),
        F.concat(F.lit("Text/file_"), i.cast("string"), pick(EXTS, i)).alias("file_name"),
        pick(MEDIA, i).alias("media_type"), (i % 3 != 0).alias("is_linear"), (i % 5 != 0).alias("manifest"),
        F.concat(F.lit("Title "), (i % 10).cast("string")).alias("title"), F.when(i % 2 == 0, F.col("lang")).when(i % 6 == 1, "").alias("lang"),
        F.filter(F.split(pick(PROPS, i), " "), lambda x: x != "").alias("properties"),
        F.when(i % 11 == 0, F.concat(F.lit("smil"), i.cast("string"))).alias("media_overlay"), F.when(i % 11 == 0, "0:01:30").alias("media_duration"),
    )


_ITEMS_SQL = f"""(SELECT {{}} AS book, doc_id AS pos,
  CASE WHEN doc_id % 7 = 0 THEN 'nav' WHEN doc_id % 7 = 1 THEN 'cover' WHEN doc_id % 7 = 2 THEN 'ncx' WHEN doc_id % 7 < 5 THEN 'html' ELSE 'item' END AS kind,
  CASE WHEN doc_id % 4 <> 0 THEN 'i' || (doc_id % 50) END AS id,
  'Text/file_' || doc_id || {list(EXTS)}[doc_id % {len(EXTS)} + 1] AS file_name,
  {list(MEDIA)}[doc_id % {len(MEDIA)} + 1] AS media_type, doc_id % 3 <> 0 AS is_linear, doc_id % 5 <> 0 AS manifest,
  'Title ' || (doc_id % 10) AS title, CASE WHEN doc_id % 2 = 0 THEN lang WHEN doc_id % 6 = 1 THEN '' END AS lang,
  list_filter(string_split({list(PROPS)}[doc_id % {len(PROPS)} + 1], ' '), lambda x: x <> '') AS properties,
  CASE WHEN doc_id % 11 = 0 THEN 'smil' || doc_id END AS media_overlay, CASE WHEN doc_id % 11 = 0 THEN '0:01:30' END AS media_duration
FROM documents)"""
ITEMS_SQL = _ITEMS_SQL.format("source || '/' || (doc_id // 100)")
SOURCE_ITEMS_SQL = _ITEMS_SQL.format("source")

BOOK_OF_URL = "^https?://[^/]+/([^/]+)/"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages as HTML items of a book of their language, with fifty of them at most."""
    p = read(spark, sf_dir, "pages")
    return p.select(F.concat(F.regexp_extract("url", BOOK_OF_URL, 1), F.lit("-"), F.expr("(page_id div 50)").cast("string")).alias("book"), F.col("page_id").alias("pos"), "url", "html")


PAGES_SQL = f"(SELECT regexp_extract(url, '{BOOK_OF_URL}', 1) || '-' || (page_id // 50) AS book, page_id AS pos, url, html FROM pages)"


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as books whose trees are nations and customers."""
    r, n, c = (read(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    n = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey)  # five regions
    k = F.col("n_nationkey")
    top = n.select(
        F.col("r_name").alias("book"), F.array(k.cast("int")).alias("path"), F.array().cast("array<int>").alias("parent_path"), F.lit(1).alias("depth"),
        F.when(k % 2 == 0, "section").otherwise("document_section").alias("node_kind"), F.col("n_name").alias("title"),
        F.when(k % 2 == 0, "").otherwise(F.concat(F.lit("n"), k.cast("string"), F.lit(".xhtml"))).alias("href"), F.concat(F.lit("n"), k.cast("string")).alias("uid"),
    )
    own = c.join(n, c.c_nationkey == n.n_nationkey)
    i = F.col("c_custkey")
    leaf = own.select(
        F.col("r_name").alias("book"), F.array(k.cast("int"), i.cast("int")).alias("path"), F.array(k.cast("int")).alias("parent_path"), F.lit(2).alias("depth"),
        F.lit("link").alias("node_kind"), F.col("c_name").alias("title"), F.when(i % 2 == 0, F.concat(F.lit("c"), i.cast("string"), F.lit(".xhtml"))).otherwise("").alias("href"), F.concat(F.lit("c"), i.cast("string")).alias("uid"),
    )
    return top.unionByName(leaf)


TREE_SQL = """(SELECT r_name AS book, [n_nationkey::INT] AS path, 1 AS depth, CASE WHEN n_nationkey % 2 = 0 THEN 'section' ELSE 'document_section' END AS node_kind, n_name AS title,
  CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE 'n' || n_nationkey || '.xhtml' END AS href, 'n' || n_nationkey AS uid, []::INT[] AS parent_path
 FROM nation JOIN region ON n_regionkey = r_regionkey
 UNION ALL
 SELECT r_name, [n_nationkey::INT, c_custkey::INT], 2, 'link', c_name, CASE WHEN c_custkey % 2 = 0 THEN 'c' || c_custkey || '.xhtml' ELSE '' END, 'c' || c_custkey, [n_nationkey::INT]
 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
