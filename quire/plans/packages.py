"""Package documents, made from documents in SQL and parsed in expressions: neither side needs Python."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import html as H
from ..functions.package import package_tables
from ..functions.tree import let
from .containers import query
from .queries import _H1
from .tables import PAGES_SQL, pages


def _packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A package document for each book of pages: a title and a subject for each page, in its heading's words, and its file in manifest, spine and guide."""
    p = pages(spark, sf_dir).withColumn("title", F.coalesce(H.heading("html"), F.lit("untitled")))
    n = F.col("pos").cast("string")
    meta = F.concat(F.lit('<dc:subject id="s'), n, F.lit('" opf:role="a&amp;b">'), H.escape(F.col("title")), F.lit("</dc:subject>"))
    item = F.concat(F.lit("<item href='p%20"), n, F.lit(".xhtml' id=\"i"), n, F.when(F.col("pos") % 2 == 0, f'" media-type="{C.XHTML_TYPE}" properties="scripted svg"/>').otherwise('" media-type="image/jpg"></item>'))
    ref = F.concat(F.lit('<itemref idref="i'), n, F.when(F.col("pos") % 3 == 0, '" linear="no"/>').otherwise('"/>'))
    guide = F.concat(F.lit('<reference type="text" title="&lt;'), n, F.lit('&gt;" href="p'), n, F.lit('.xhtml"/>'))
    rows = F.array_sort(F.collect_list(F.struct("pos", meta.alias("m"), item.alias("i"), ref.alias("r"), guide.alias("g"))))
    joined = lambda x, c: F.array_join(F.transform(x, lambda r: r[c]), "\n")
    start = f'<?xml version="1.0"?>\n<package xmlns="{C.NAMESPACES["OPF"]}" version="3.0" unique-identifier="uid"><metadata xmlns:dc="{C.NAMESPACES["DC"]}" xmlns:opf="{C.NAMESPACES["OPF"]}"><dc:identifier id="uid">urn:'
    text = lambda x: F.concat(
        F.lit(start), F.col("book"), F.lit("</dc:identifier><dc:title><![CDATA[<"), F.col("book"), F.lit(">]]></dc:title><!-- no <dc:title> -->"), joined(x, "m"), F.lit("</metadata><manifest>"), joined(x, "i"),
        F.lit('</manifest><spine page-progression-direction="rtl">'), joined(x, "r"), F.lit("</spine><guide>"), joined(x, "g"), F.lit("</guide></package>"),
    )
    return p.groupBy("book").agg(rows.alias("x")).select("book", let(F.col("x"), text).alias("text"))


@query(f"""SELECT book, row_number() OVER (PARTITION BY book ORDER BY pos) + 1 AS seq, '{C.NAMESPACES["DC"]}' AS ns, 'subject' AS name, coalesce({_H1}, 'untitled') AS value, 'id=s' || pos || ';{{{C.NAMESPACES["OPF"]}}}role=a&b' AS attrs FROM {PAGES_SQL}
UNION ALL SELECT book, 0, '{C.NAMESPACES["DC"]}', 'identifier', 'urn:' || book, 'id=uid' FROM {PAGES_SQL} GROUP BY 1 UNION ALL SELECT book, 1, '{C.NAMESPACES["DC"]}', 'title', '<' || book || '>', '' FROM {PAGES_SQL} GROUP BY 1""")
def package_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = package_tables(_packages(spark, sf_dir))["metadata"]
    return m.select("book", F.col("seq").cast("long").alias("seq"), "ns", "name", "value", F.array_join(F.transform("attrs", lambda a: F.concat(a["k"], F.lit("="), a["v"])), ";").alias("attrs"))


@query(f"""SELECT book, row_number() OVER (PARTITION BY book ORDER BY pos) - 1 AS pos, CASE WHEN pos % 2 = 0 THEN 'html' ELSE 'image' END AS kind, 'i' || pos AS id, 'p ' || pos || '.xhtml' AS file_name, CASE WHEN pos % 2 = 0 THEN '{C.XHTML_TYPE}' ELSE 'image/jpeg' END AS media_type,
CASE WHEN pos % 2 = 0 THEN 'scripted svg' ELSE '' END AS properties FROM {PAGES_SQL}""")
def package_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = package_tables(_packages(spark, sf_dir))["items"]
    return i.select("book", F.col("pos").cast("long").alias("pos"), "kind", "id", "file_name", "media_type", F.array_join("properties", " ").alias("properties"))


@query(f"""SELECT s.*, g.href, g.title FROM (SELECT book, row_number() OVER (PARTITION BY book ORDER BY pos) - 1 AS pos, 'i' || pos AS idref, CASE WHEN pos % 3 = 0 THEN 'no' ELSE 'yes' END AS linear FROM {PAGES_SQL}) s
JOIN (SELECT book, row_number() OVER (PARTITION BY book ORDER BY pos) - 1 AS pos, 'p' || pos || '.xhtml' AS href, '<' || pos || '>' AS title FROM {PAGES_SQL}) g USING (book, pos)""")
def package_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spine and guide, joined by their places."""
    t = package_tables(_packages(spark, sf_dir))
    return t["spine"].join(t["guide"], ["book", "pos"]).select("book", F.col("pos").cast("long").alias("pos"), "idref", "linear", "href", "title")


@query(f"SELECT DISTINCT book, '3.0' AS version, 'urn:' || book AS uid, '<' || book || '>' AS title, 'en' AS language, 'rtl' AS direction FROM {PAGES_SQL}")
def package_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return package_tables(_packages(spark, sf_dir))["books"].select("book", "version", "uid", "title", "language", "direction")
