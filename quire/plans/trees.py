"""The document operators in expressions over the whole html of pages: the SQL is that of the same operators on parsed trees (``whole``), and of page marks and elements put into pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import tree as T
from ..operators import trees as X
from .containers import query
from .queries import ORACLES
from .tables import PAGES_SQL, pages
from .whole import _body, _count, _done, _items, _text


@query(ORACLES["whole_body"])
def tree_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.decode("body", "UTF-8")
    return X.bodies(_items(spark, sf_dir)).select("book", F.col("pos").cast("long").alias("pos"), _text(body).alias("digest"), _count(body, "<[a-zA-Z]").alias("n_elements"))


@query(ORACLES["whole_syntax_clean"])
def tree_syntax_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _done(X.clean_items(_items(spark, sf_dir)))
    return done.select("book", "pos", "digest", _count(_body(F.col("c")), "<[a-zA-Z]").alias("n_elements"), _count(F.col("c"), "<meta").alias("n_metas"), _count(F.col("c"), "bgcolor|color=").alias("n_unknown"))


@query(ORACLES["whole_link_rewrite"])
def tree_link_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _done(X.link_items(_items(spark, sf_dir)))
    links = F.regexp_extract_all("c", F.lit("(<a [^>]*>)"), F.lit(1))
    return done.select("book", "pos", F.posexplode(links).alias("n", "a")).select("book", "pos", F.col("n").cast("long").alias("n"), H.href(F.col("a")).alias("href"))


@query(ORACLES["whole_footnotes"])
def tree_footnotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _done(X.footnote_items(_items(spark, sf_dir)))
    return done.select("book", "pos", "digest", F.regexp_extract("c", '<aside id="([^"]*)" epub:type="footnote">', 1).alias("id"), _count(F.col("c"), 'epub:type="noteref"').alias("n_refs"))


@query(ORACLES["whole_render"])
def tree_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _items(spark, sf_dir).withColumn("title", F.concat(F.lit("Page "), F.col("pos").cast("string")))
    done = _done(X.render(own, "en"))
    return done.select("book", "pos", "digest", F.regexp_extract("c", "<title>([^<]*)</title>", 1).alias("title"), _count(F.col("c"), "<style|<script|<meta").alias("n_own"))


@query(f"""WITH m AS (SELECT book, pos, regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 1) AS h, regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 2) AS t FROM {PAGES_SQL}),
u AS (SELECT book, pos, unnest(h) AS h, unnest(t) AS t, generate_subscripts(h, 1) - 1 AS k FROM m)
SELECT book, pos::INT AS doc_pos, (3 * k + j)::INT AS n, ['', 'h', 'i'][j + 1] || h AS fragment, CASE j WHEN 2 THEN 'i' || h ELSE t END AS label FROM u, (SELECT unnest([0, 1, 2]) AS j)""")
def tree_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page marks over whole pages: labels by an element's lead text, its heading, and its id."""
    made = '<li epub:type="pagebreak" id="$1">$2 <a href="$1">x</a></li><li epub:type="pagebreak" id="h$1"><a>y</a><h2> $2 </h2></li><li epub:type="pagebreak" id="i$1"><a>z</a></li>'
    html = F.regexp_replace(F.decode("content", "UTF-8"), '<li><a href="([^"]*)">([^<]*)</a></li>', made)
    src = _items(spark, sf_dir).withColumn("content", F.encode(html, "UTF-8"))
    return X.pages_of(src).select("book", "doc_pos", "n", "fragment", "label")


@query(f"""SELECT book, pos::BIGINT AS pos, name, count(*)::BIGINT AS n, count(DISTINCT parent)::BIGINT AS n_parents FROM (
SELECT book, pos, name, CASE name WHEN 'tr' THEN k ELSE k * 2 + j END AS parent FROM (SELECT book, pos, unnest(range(len(string_split(html, '<p>')) - 1)) AS k FROM {PAGES_SQL}), (SELECT unnest(['tr', 'td', 'td']) AS name, unnest([0, 0, 1]) AS i), (SELECT unnest([0, 1]) AS j)) GROUP BY 1, 2, 3""")
def element_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of whole pages: before each paragraph a table whose cells and rows nothing ends but the next ones; cells lie in rows, and rows in their table."""
    table = "<table><tr><td>1<td>2<tr><td>3<td>4</table><p>"
    src = pages(spark, sf_dir).withColumn("html", F.replace("html", F.lit("<p>"), F.lit(table)))
    found = T.elements(src, ["book", "pos"], "html").where("name IN ('tr', 'td')")
    return found.groupBy("book", "pos", "name").agg(F.count("*").alias("n"), F.countDistinct("parent").alias("n_parents"))
