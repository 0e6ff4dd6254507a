"""The engine's own operators as queries over the star-schema tables, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import html as H
from ..functions import items as I
from ..functions import paths as P
from ..operators import catalogue as K
from ..operators import documents as D
from ..operators import navigation as N
from .tables import ITEMS_SQL, PAGES_SQL, SOURCE_ITEMS_SQL, TREE_SQL, items, pages, read, tree

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def case(value: str, table: dict, default: str = "NULL") -> str:
    lit = lambda x: str(x) if isinstance(x, int) else "'" + x + "'"
    return f"CASE {' '.join(f'WHEN {value} = {lit(k)} THEN {lit(v)}' for k, v in table.items())} ELSE {default} END"


EXT = r"lower(regexp_extract({}, '[^/.][^/]*?(\.[^./]*)$', 1))"
_BY_EXT = {e: t for t in reversed(C.EXTENSIONS) for e in C.EXTENSIONS[t]}
TYPE = "CASE WHEN kind IN ('html','cover_html','nav') THEN 9 WHEN kind = 'image' THEN 1 WHEN kind = 'cover' THEN 10 WHEN kind = 'smil' THEN 11 ELSE " + case(EXT.format("file_name"), _BY_EXT, "0") + " END"


@query(f"SELECT pos, file_name, ({case(EXT.format('file_name'), _BY_EXT, '0')})::INT AS item_type FROM {ITEMS_SQL}")
def item_type_by_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("pos", "file_name", I.type_by_extension("file_name").alias("item_type"))


_GIVEN = "CASE WHEN pos % 3 = 0 THEN media_type ELSE '' END"
_GUESS = case(EXT.format("regexp_replace(file_name, '(?i)\\.(gz|bz2|xz|z)$', '')"), C.MEDIA_TYPES)


@query(f"""SELECT pos, CASE WHEN {_GIVEN} <> '' THEN {_GIVEN} ELSE coalesce({_GUESS}, '{C.DEFAULT_MEDIA_TYPE}') END AS media_type,
CASE WHEN {_GIVEN} <> '' THEN {_GIVEN} ELSE coalesce({case(EXT.format('file_name'), C.ENCODINGS)}, {_GUESS}, '{C.DEFAULT_MEDIA_TYPE}') END AS compat FROM {ITEMS_SQL}""")
def media_type_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.when(F.col("pos") % 3 == 0, F.col("media_type")).otherwise("")
    return items(spark, sf_dir).select("pos", I.media_type_default(given, "file_name").alias("media_type"), I.media_type_default(given, "file_name", encoding_wins=True).alias("compat"))


@query(f"""SELECT pos, CASE WHEN media_type = 'image/jpg' THEN 'image/jpeg' ELSE media_type END AS media_type, CASE
 WHEN media_type = '{C.NCX_TYPE}' THEN 'ncx' WHEN media_type = '{C.SMIL_TYPE}' THEN 'smil'
 WHEN media_type = '{C.XHTML_TYPE}' THEN CASE WHEN list_contains(properties, 'nav') THEN 'nav' WHEN list_contains(properties, 'cover') THEN 'cover_html' ELSE 'html' END
 WHEN media_type IN ('image/jpeg','image/jpg','image/png','image/svg+xml') THEN CASE WHEN list_contains(properties, 'cover-image') THEN 'cover' ELSE 'image' END
 ELSE 'item' END AS kind FROM {ITEMS_SQL}""")
def manifest_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("pos", I.manifest_media_type("media_type").alias("media_type"), I.manifest_kind("media_type", "properties").alias("kind"))


@query(f"""WITH i AS (SELECT book, pos, CASE pos % 3 WHEN 0 THEN 'chapter' WHEN 1 THEN 'image' ELSE 'static' END AS stem, CASE WHEN pos % 5 = 0 THEN 'own' || pos END AS id FROM {PAGES_SQL})
SELECT book, pos, coalesce(id, stem || '_' || (row_number() OVER (PARTITION BY book, stem, id IS NULL ORDER BY pos) - 1)) AS id FROM i""")
def auto_item_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("pos")
    src = pages(spark, sf_dir).select("book", "pos", F.when(p % 3 == 0, "html").when(p % 3 == 1, "image").otherwise("item").alias("kind"), F.when(p % 5 == 0, F.concat(F.lit("own"), p.cast("string"))).alias("id"))
    return K.auto_ids(src).select("book", "pos", "id")


@query(f"SELECT book, pos, file_name FROM {ITEMS_SQL} WHERE ({TYPE}) = {C.IMAGE}")
def items_of_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.items_of_type(items(spark, sf_dir), C.IMAGE).select("book", "pos", "file_name")


@query(f"SELECT book, pos, file_name FROM {ITEMS_SQL} WHERE media_type = 'image/jpeg'")
def items_of_media_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.items_of_media_type(items(spark, sf_dir), "image/jpeg").select("book", "pos", "file_name")


@query(f"SELECT book, ({TYPE})::INT AS item_type, count(*)::BIGINT AS n FROM {ITEMS_SQL} GROUP BY ALL")
def item_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.with_type(items(spark, sf_dir)).groupBy("book", "item_type").agg(F.count("*").alias("n"))


@query(f"SELECT book, pos, id FROM {ITEMS_SQL} ORDER BY book, pos")
def items_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.items_in_order(items(spark, sf_dir)).select("book", "pos", "id")


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("book"), F.col("turn").alias("pos"), F.col("role").alias("id"), F.concat("role", F.lit(".xhtml")).alias("file_name"), "text")


@query("SELECT conv_id::VARCHAR AS book, min(turn) AS pos, arg_min(text, turn) AS text FROM conversations WHERE role = 'assistant' GROUP BY 1")
def item_with_id_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.item_with_id(_turns(spark, sf_dir), "assistant").select("book", "pos", "text")


@query("SELECT conv_id::VARCHAR AS book, min(turn) AS pos, arg_min(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY 1")
def item_with_href_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.item_with_href(_turns(spark, sf_dir), "user.xhtml").select("book", "pos", "text")


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("string").alias("book"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 3 == 0, "DC").when(F.col("event_id") % 3 == 1, "http://example.com/ns").alias("ns"), F.col("event_type").alias("name"), F.col("event_id").cast("string").alias("value"), "ts")


_ENTRIES = "(SELECT user_id::VARCHAR AS book, event_id AS seq, CASE event_id % 3 WHEN 0 THEN 'DC' WHEN 1 THEN 'http://example.com/ns' END AS ns, event_type AS name, event_id::VARCHAR AS value, ts FROM events)"


@query(f"SELECT book, {case('ns', C.NAMESPACES, 'ns')} AS ns, name, string_agg(value, ',' ORDER BY seq) AS values_in_order FROM {_ENTRIES} GROUP BY 1, 2, 3")
def metadata_multimap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.multimap(_entries(spark, sf_dir)).select("book", "ns", "name", F.array_join("values", ",").alias("values_in_order"))


@query(f"SELECT book, seq, value FROM {_ENTRIES} WHERE ns = 'DC' AND name = 'click'")
def metadata_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _entries(spark, sf_dir).withColumn("ns", I.namespace("ns"))
    return K.get_metadata(own, "DC", "click").select("book", "seq", "value")


@query(f"SELECT book, name, arg_max(value, (ts, seq)) AS value FROM {_ENTRIES} GROUP BY 1, 2")
def metadata_unique_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.set_unique(_entries(spark, sf_dir).select("book", "name", "ts", "seq", "value"), ["book", "name"], ["ts", "seq"]).select("book", "name", "value")


@query(f"""WITH m AS (SELECT book, name, max(seq) AS mark FROM {_ENTRIES} WHERE seq % 7 = 0 GROUP BY 1, 2)
SELECT e.book, e.name, e.seq, e.value FROM {_ENTRIES} e LEFT JOIN m ON e.book = m.book AND e.name = m.name WHERE m.mark IS NULL OR e.seq >= m.mark""")
def metadata_mixed_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.set_unique(_entries(spark, sf_dir), ["book", "name"], ["seq"], unique="seq % 7 = 0").select("book", "name", "seq", "value")


def _authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, i = read(spark, sf_dir, "customer"), F.col("c_custkey")
    return c.select(F.col("c_nationkey").cast("string").alias("book"), i.alias("seq"), F.col("c_name").alias("author"), F.when(i % 3 == 0, F.col("c_mktsegment")).alias("file_as"), F.when(i % 2 == 0, "aut").alias("role"), F.when(i % 4 == 0, F.concat(F.lit("own"), i.cast("string"))).alias("uid"))


_AUTHORS = """(SELECT book, seq, author, file_as, role, uid, coalesce(uid, CASE WHEN n = 0 THEN 'creator' ELSE 'creator_' || n END) AS id FROM (
 SELECT c_nationkey::VARCHAR AS book, c_custkey AS seq, c_name AS author, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS file_as, CASE WHEN c_custkey % 2 = 0 THEN 'aut' END AS role,
 CASE WHEN c_custkey % 4 = 0 THEN 'own' || c_custkey END AS uid, row_number() OVER (PARTITION BY c_nationkey, c_custkey % 4 = 0 ORDER BY c_custkey) - 1 AS n FROM customer))"""


@query(f"SELECT book, seq, author, id FROM {_AUTHORS}")
def author_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.author_ids(_authors(spark, sf_dir)).select("book", "seq", "author", "id")


@query(f"""SELECT book, seq, 0 AS k, author AS value, 'id=' || id AS attrs FROM {_AUTHORS}
UNION ALL SELECT book, seq, 1, file_as, 'refines=#' || id || ';property=file-as;scheme=marc:relators' FROM {_AUTHORS} WHERE file_as IS NOT NULL
UNION ALL SELECT book, seq, 2, role, 'refines=#' || id || ';property=role;scheme=marc:relators' FROM {_AUTHORS} WHERE role IS NOT NULL""")
def author_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = K.author_metadata(_authors(spark, sf_dir))
    prop = F.get(F.filter("attrs", lambda a: a["k"] == "property"), F.lit(0))["v"]
    return out.select("book", "seq", F.when(prop.isNull(), 0).when(prop == "file-as", 1).otherwise(2).alias("k"), "value", F.array_join(F.transform("attrs", lambda a: F.concat(a["k"], F.lit("="), a["v"])), ";").alias("attrs"))


@query("""SELECT o_orderkey AS pos, 'c' || o_custkey AS idref, CASE WHEN c_custkey IS NOT NULL AND (c_acctbal <= 0 OR o_orderkey % 4 = 0) THEN 'no' ELSE 'yes' END AS linear, c_custkey IS NOT NULL AS found
FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) ON c_custkey = o_custkey""")
def spine_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer").where("c_custkey % 3 <> 0")
    book = lambda k: (F.col(k) % 10).cast("string").alias("book")
    name = lambda k: F.concat(F.lit("c"), F.col(k).cast("string"))
    spine = o.select(book("o_custkey"), F.col("o_orderkey").alias("pos"), name("o_custkey").alias("idref"), F.when(F.col("o_orderkey") % 4 == 0, "no").alias("linear"))
    known = c.select(book("c_custkey"), F.col("c_custkey").alias("pos"), name("c_custkey").alias("id"), (F.col("c_acctbal") > 0).alias("is_linear"), F.col("c_name").alias("file_name"))
    return N.spine_rows(spine, known).select("pos", "idref", "linear", "found")


@query(f"SELECT book, uid, depth, array_to_string(path, '.') AS path FROM {TREE_SQL}")
def toc_preorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tree(spark, sf_dir)
    nodes = t.select("book", F.col("uid").alias("id"), F.when(F.size("parent_path") > 0, F.concat(F.lit("n"), F.element_at("parent_path", -1).cast("string"))).alias("parent"), F.element_at("path", -1).alias("ord"))
    return N.walk(nodes).select("book", F.col("id").alias("uid"), "depth", F.array_join(F.transform("path", lambda x: x.cast("string")), ".").alias("path"))


@query(f"SELECT book, uid, (row_number() OVER (PARTITION BY book ORDER BY path))::INT AS play_order FROM {TREE_SQL}")
def toc_play_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.play_order(tree(spark, sf_dir)).select("book", "uid", "play_order")


@query(f"SELECT book, title, CASE WHEN node_kind = 'section' THEN 'sep_' || (row_number() OVER (PARTITION BY book, node_kind = 'link' ORDER BY path) - 1) ELSE uid END AS nav_id FROM {TREE_SQL}")
def toc_section_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.section_ids(tree(spark, sf_dir)).select("book", "title", "nav_id")


@query(f"""WITH t AS (SELECT * FROM {TREE_SQL}), b AS (SELECT book, parent_path, arg_min(href, path) AS below FROM t WHERE node_kind = 'link' AND href <> '' GROUP BY 1, 2)
SELECT t.book, uid, CASE WHEN href <> '' THEN href ELSE coalesce(below, '') END AS src FROM t LEFT JOIN b ON t.book = b.book AND t.path = b.parent_path""")
def toc_inherit_src(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.inherited_src(tree(spark, sf_dir)).select("book", "uid", "src")


_ANCHORS = f"""(SELECT pos, unnest(a) AS a, generate_subscripts(a, 1) - 1 AS n FROM (SELECT pos, regexp_extract_all(regexp_extract(html, '(?is)<nav[^>]*>(.*?)</nav>', 1), '(?is)(<a\\s[^>]*href="[^"]*"[^>]*>.*?</a>)', 1) AS a FROM {PAGES_SQL}))"""
_HREF = "regexp_extract(a, '(?is)href=\"([^\"]*)\"', 1)"


@query(f"SELECT pos, n::INT AS n, {_HREF} AS href, trim(regexp_replace(regexp_replace(a, '<[^>]*>', '', 'g'), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS title FROM {_ANCHORS}")
def nav_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = pages(spark, sf_dir).select("pos", F.posexplode(H.nav_links("html")).alias("n", "a"))
    return a.select("pos", "n", H.href(F.col("a")).alias("href"), H.text_of(F.col("a")).alias("title"))


@query(f"""SELECT pos, n::INT AS n, h AS href, CASE WHEN regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN h WHEN p = '' THEN h ELSE p || '.xhtml' || f END AS rewritten FROM (
 SELECT pos, n, h, regexp_extract(h, '(#.*)$', 1) AS f, regexp_replace(regexp_replace(regexp_replace(regexp_replace(h, '#.*$', ''), '\\?.*$', ''), '^//[^/]*', ''), ';[^/]*$', '') AS p
 FROM (SELECT pos, n, {_HREF} || ['', '/', '?q=1#x', '#frag', '/#ref'][n % 5 + 1] AS h FROM {_ANCHORS}))""")
def link_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = pages(spark, sf_dir).select("pos", F.posexplode(H.nav_links("html")).alias("n", "a"))
    tail = F.element_at(F.array(*[F.lit(x) for x in ("", "/", "?q=1#x", "#frag", "/#ref")]), F.col("n") % 5 + 1)
    a = a.select("pos", "n", F.concat(H.href(F.col("a")), tail).alias("href"))
    return a.withColumn("rewritten", H.rewrite_link("href"))


_H1 = "nullif(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1(?:\\s[^>]*)?>(.*?)</h1>', 1), '<[^>]*>', '', 'g'), '[\\x20\\x09-\\x0D]+', ' ', 'g')), '')"


@query(f"SELECT book, pos, {_H1} AS heading FROM {PAGES_SQL}")
def page_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("book", "pos", H.heading("html").alias("heading"))


@query(f"SELECT pos, length(b)::INT AS n, md5(b) AS digest FROM (SELECT pos, CASE WHEN regexp_matches(x, '<[A-Za-z]') THEN x ELSE '' END AS b FROM (SELECT pos, regexp_extract(html, '(?is)<body[^>]*>(.*)</body>', 1) AS x FROM {PAGES_SQL}))")
def body_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = pages(spark, sf_dir).select("pos", H.body("html").alias("b"))
    return b.select("pos", F.length("b").alias("n"), F.md5(F.encode("b", "UTF-8")).alias("digest"))


@query(f"SELECT pos, md5(regexp_replace(replace(html, '<p>', '<p><font size=\"2\"><BIG>old</BIG></font><strike/>'), '(?i)</?(?:{'|'.join(C.DEPRECATED_TAGS)})(?:\\s[^>]*)?/?>', '', 'g')) AS digest FROM {PAGES_SQL}")
def deprecated_tag_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = F.replace(F.col("html"), F.lit("<p>"), F.lit('<p><font size="2"><BIG>old</BIG></font><strike/>'))
    return pages(spark, sf_dir).select("pos", F.md5(F.encode(H.strip_deprecated(old), "UTF-8")).alias("digest"))


@query("""SELECT conv_id, turn, 'p' || conv_id || '_' || turn AS id, CASE WHEN turn % 3 = 0 THEN 'p' || conv_id || '_' || turn ELSE role || ' ' || turn END AS label FROM conversations""")
def pagebreak_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    ref, label = F.concat(F.lit("p"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string")), F.concat("role", F.lit(" "), F.col("turn").cast("string"))
    html = F.concat(F.lit("<body><p>"), H.pagebreak(ref, F.when(F.col("turn") % 3 != 0, label)), F.lit("</p></body>"))
    tag = c.select("conv_id", "turn", F.explode(H.page_tags(html)).alias("tag"))
    text = F.nullif(F.trim(F.regexp_replace("tag", H.TAG, "")), F.lit(""))
    return tag.select("conv_id", "turn", H.attribute(F.col("tag"), "id").alias("id"), F.coalesce(text, H.attribute(F.col("tag"), "id")).alias("label"))


@query("""WITH p AS (SELECT event_id AS pos, 'doc' || (event_id % 500) || '.xhtml' || repeat('#f' || event_id, event_id % 3) AS href FROM events),
s AS (SELECT pos, CASE WHEN len(string_split(href, '#')) = 2 THEN string_split(href, '#')[1] ELSE href END AS file_name, CASE WHEN len(string_split(href, '#')) = 2 THEN string_split(href, '#')[2] END AS fragment FROM p),
d AS (SELECT 'doc' || (doc_id % 300) || '.xhtml' AS file_name, max(doc_id) AS doc_pos FROM documents GROUP BY 1)
SELECT pos, file_name, fragment, doc_pos FROM s JOIN d USING (file_name)""")
def page_document_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, d = read(spark, sf_dir, "events"), read(spark, sf_dir, "documents")
    i = F.col("event_id")
    href = F.concat(F.lit("doc"), (i % 500).cast("string"), F.lit(".xhtml"), F.repeat(F.concat(F.lit("#f"), i.cast("string")), (i % 3).cast("int")))
    own = e.select(F.lit("b").alias("book"), i.alias("pos"), href.alias("href"))
    docs = d.select(F.lit("b").alias("book"), F.concat(F.lit("doc"), (F.col("doc_id") % 300).cast("string"), F.lit(".xhtml")).alias("file_name"), F.col("doc_id").alias("pos"))
    return N.pages_of_documents(own, docs).select("pos", "file_name", "fragment", "doc_pos")


def _guide(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i = read(spark, sf_dir, "events"), F.col("event_id")
    kind = F.when(F.col("event_type") == "click", "text").when(F.col("event_type") == "view", "notes").otherwise(F.col("event_type"))
    return e.select((i % 20).cast("string").alias("n"), F.concat(F.lit("src"), (i % 20).cast("string")).alias("book"), i.alias("pos"), F.when(i % 5 != 0, F.concat(F.lit("h"), i.cast("string"))).otherwise("").alias("href"), F.concat(F.lit("t"), i.cast("string")).alias("title"), kind.alias("type"), F.when(i % 4 == 0, F.concat(F.lit("i"), (i % 60).cast("string"))).alias("item_id"))


_GUIDE = f"""(SELECT g.book, g.pos, g.type, CASE WHEN k.file_name IS NOT NULL THEN coalesce(k.title, '') ELSE g.title END AS title, coalesce(k.file_name, g.href) AS href FROM (
 SELECT 'src' || (event_id % 20) AS book, event_id AS pos, CASE WHEN event_id % 5 <> 0 THEN 'h' || event_id ELSE '' END AS href, 't' || event_id AS title,
 CASE event_type WHEN 'click' THEN 'text' WHEN 'view' THEN 'notes' ELSE event_type END AS type, CASE WHEN event_id % 4 = 0 THEN 'i' || (event_id % 60) END AS item_id FROM events) g
 LEFT JOIN (SELECT book, id, arg_min(file_name, pos) AS file_name, arg_min(title, pos) AS title FROM {ITEMS_SQL} WHERE id IS NOT NULL GROUP BY 1, 2) k ON g.book = k.book AND g.item_id = k.id)"""


@query(f"SELECT book, pos, type, title, href FROM {_GUIDE}")
def guide_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.guide_rows(_guide(spark, sf_dir), items(spark, sf_dir))


@query(f"SELECT book, pos, {case('type', C.LANDMARKS, 'type')} AS type, title, href FROM {_GUIDE} WHERE href <> ''")
def landmark_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.landmarks(N.guide_rows(_guide(spark, sf_dir), items(spark, sf_dir)))


_HEADS = ("a/./b/../", "/x//../", "../", "../../a/../../", "//r/", "./", "a//b/..", "")
_PATH = "regexp_replace(url, '^https?://[^/]+/([^?]*).*$', '\\1')"
_NORM = """(CASE WHEN {0} LIKE '//%' AND {0} NOT LIKE '///%' THEN '//' WHEN {0} LIKE '/%' THEN '/' ELSE '' END ||
 ltrim(list_reduce(list_prepend('', list_filter(string_split({0}, '/'), lambda x: x <> '' AND x <> '.')), lambda acc, x: CASE
   WHEN x = '..' AND acc <> '' AND NOT (acc = '/..' OR acc LIKE '%/..') THEN regexp_replace(acc, '/[^/]*$', '')
   WHEN x = '..' AND {0} LIKE '/%' AND acc = '' THEN acc ELSE acc || '/' || x END), '/'))"""


@query(f"SELECT page_id, p, CASE WHEN {_NORM.format('p')} = '' THEN '.' ELSE {_NORM.format('p')} END AS norm FROM (SELECT page_id, {list(_HEADS)}[page_id % {len(_HEADS)} + 1] || {_PATH} AS p FROM pages)")
def path_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.element_at(F.array(*[F.lit(h) for h in _HEADS]), (F.col("page_id") % len(_HEADS) + 1).cast("int"))
    p = read(spark, sf_dir, "pages").select("page_id", F.concat(head, F.regexp_replace("url", r"^https?://[^/]+/([^?]*).*$", "$1")).alias("p"))
    return p.withColumn("norm", P.normpath("p"))


@query(f"""SELECT page_id, CASE page_id % 4 WHEN 0 THEN '../Text/' || p WHEN 1 THEN p WHEN 2 THEN '../../' || p ELSE '../../Text/' || p END AS rel FROM (SELECT page_id, rtrim({_PATH}, '/') AS p FROM pages)""")
def path_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.element_at(F.array(F.lit("Nav"), F.lit("Text"), F.lit("Text/../Text/a/b"), F.lit("Nav/x/.")), (F.col("page_id") % 4 + 1).cast("int"))
    path = F.regexp_replace("url", r"^https?://[^/]+/([^?]*).*$", "$1")
    p = read(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("Text/"), path).alias("p"), start.alias("start"))
    return p.select("page_id", P.relpath("p", "start").alias("rel"))


@query("""SELECT page_id, 'a b+' || replace(url, '/', '//') || 'é%' AS decoded FROM pages""")
def href_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = F.concat(F.lit("a%20b+"), F.replace(F.col("url"), F.lit("/"), F.lit("%2F%2f")), F.lit("%C3%A9%25"))
    return read(spark, sf_dir, "pages").select("page_id", P.url_decode(src).alias("decoded"))


@query("SELECT o_orderkey, strftime(o_orderdate + INTERVAL 30 MINUTE - to_hours((o_orderkey % 5 - 2)::INT), '%Y-%m-%dT%H:%M:%SZ') AS modified FROM orders")
def modified_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", I.modified_utc(F.col("o_orderdate") + F.expr("INTERVAL 30 MINUTES"), F.col("o_orderkey") % 5 - 2).alias("modified"))


@query("SELECT event_id, (year(t) || '-' || month(t) || '-' || day(t) || ' ' || hour(t) || ':' || minute(t) || ':' || second(t)) AS entry_time FROM (SELECT event_id, greatest(CASE WHEN event_id % 3 = 0 THEN TIMESTAMP '1975-03-01 10:11:12' ELSE ts END, TIMESTAMP '1980-01-01 00:00:00') AS t FROM events)")
def entry_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.when(F.col("event_id") % 3 == 0, F.lit("1975-03-01 10:11:12").cast("timestamp")).otherwise(F.col("ts").cast("timestamp"))
    e = read(spark, sf_dir, "events").select("event_id", I.zip_time(t).alias("z"))
    part = lambda n: F.col(f"z.{n}").cast("string")
    return e.select("event_id", F.concat(part("year"), F.lit("-"), part("month"), F.lit("-"), part("day"), F.lit(" "), part("hour"), F.lit(":"), part("minute"), F.lit(":"), part("second")).alias("entry_time"))


_PLAIN = "kind NOT IN ('nav', 'ncx', 'cover')"


@query(f"""SELECT book, pos, file_name AS href, coalesce(id, '') AS id, media_type, CASE WHEN kind = 'nav' THEN 'nav' WHEN kind = 'cover' THEN 'cover-image' WHEN {_PLAIN} AND len(properties) > 0 THEN array_to_string(properties, ' ') END AS properties,
CASE WHEN {_PLAIN} THEN media_overlay END AS media_overlay, CASE WHEN {_PLAIN} THEN media_duration END AS duration FROM {ITEMS_SQL} WHERE manifest""")
def manifest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.manifest_rows(items(spark, sf_dir))


@query(f"SELECT book, pos, CASE WHEN manifest THEN 'EPUB/' || file_name ELSE file_name END AS entry FROM {ITEMS_SQL}")
def entry_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.entry_paths(items(spark, sf_dir)).select("book", "pos", "entry")


@query(f"SELECT book, pos, CASE WHEN lang <> '' THEN lang ELSE 'book-' || book END AS lang FROM {ITEMS_SQL}")
def document_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = items(spark, sf_dir)
    books = src.select("book").distinct().withColumn("language", F.concat(F.lit("book-"), "book"))
    return K.document_languages(src, books).select("book", "pos", "lang")


@query(f"""WITH a AS (SELECT book, id, string_agg(CASE WHEN t = 2 THEN 'stylesheet|' || file_name || '|text/css' ELSE '|' || file_name || '|text/javascript' END, ';' ORDER BY pos) AS links, max(CASE WHEN t = 3 THEN 1 ELSE 0 END) AS scripted FROM (SELECT *, {TYPE} AS t FROM {SOURCE_ITEMS_SQL} WHERE kind = 'item') WHERE t IN (2, 3) AND id IS NOT NULL GROUP BY 1, 2)
SELECT d.book, d.pos, a.links, a.scripted::INT AS scripted FROM {SOURCE_ITEMS_SQL} d LEFT JOIN a ON d.book = a.book AND d.id = a.id WHERE d.kind = 'html'""")
def script_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the links of all styles and scripts in its source that have its id."""
    src = K.with_type(items(spark, sf_dir, by_source=True))
    attached = src.where("kind = 'item' AND id IS NOT NULL").select("book", "id", "file_name", "item_type", F.col("pos").alias("seq"))
    out = K.attach(src.where("kind = 'html'").select("book", "pos", "id"), attached)
    return out.select("book", "pos", F.array_join("links", ";").alias("links"), "scripted")


@query(f"SELECT book, arg_min(pos, pos) AS pos, arg_min(file_name, pos) AS file_name FROM {ITEMS_SQL} WHERE kind = 'nav' GROUP BY 1")
def first_nav_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.first_of_kind(items(spark, sf_dir), "nav").select("book", "pos", "file_name")


@query(f"""SELECT s.book, k.file_name FROM (SELECT DISTINCT book FROM {ITEMS_SQL}) s JOIN (SELECT book, id, arg_min(file_name, pos) AS file_name FROM {ITEMS_SQL} WHERE id IS NOT NULL GROUP BY 1, 2) k ON k.book = s.book AND k.id = 'i' || length(s.book)""")
def spine_ncx_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = items(spark, sf_dir)
    books = src.select("book").distinct().withColumn("toc_id", F.concat(F.lit("i"), F.length("book").cast("string")))
    return N.spine_ncx(books, src).select("book", "file_name")


@query("SELECT user_id::VARCHAR AS book, arg_max(event_id::VARCHAR, event_id) AS uid FROM events WHERE event_type = 'view' AND event_id % 4 = 1 GROUP BY 1")
def package_identifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _entries(spark, sf_dir).withColumns({"ns": F.lit(C.NAMESPACES["DC"]), "name": F.when(F.col("name") == "view", "identifier").otherwise(F.col("name"))})
    e = e.withColumn("attrs", F.array(F.struct(F.lit("id").alias("k"), F.concat(F.lit("id"), (F.col("seq") % 4).cast("string")).alias("v"))))
    return N.package_uid(e, e.select("book").distinct().withColumn("identifier_id", F.lit("id1")))


@query("""SELECT book, (row_number() OVER (PARTITION BY book ORDER BY turn, n) - 1)::INT AS pos, page FROM (SELECT conv_id::VARCHAR AS book, turn, unnest(w) AS page, generate_subscripts(w, 1) AS n FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS w FROM conversations WHERE turn % 2 = 0))""")
def book_page_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _turns(spark, sf_dir).select("book", "pos", F.lit("html").alias("kind"), F.when(F.col("pos") % 2 == 1, "given").alias("id"), F.split("text", "\n").alias("pages"))
    return N.book_pages(t).select("book", "pos", "page")


@query("""SELECT conv_id, turn, n::INT AS n, href FROM (SELECT conv_id, turn, unnest(['a' || turn, 'b' || turn, 'c' || turn]) AS href, unnest(['text/css', 'text/javascript', '']) AS t, unnest([0, 1, 2]) AS n FROM conversations) WHERE t = CASE turn % 2 WHEN 0 THEN 'text/css' ELSE '' END""")
def links_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("book"), F.col("turn").alias("pos"))
    at = F.col("pos").cast("string")
    links = F.array(F.create_map(F.lit("href"), F.concat(F.lit("a"), at), F.lit("type"), F.lit("text/css")), F.create_map(F.lit("href"), F.concat(F.lit("b"), at), F.lit("type"), F.lit("text/javascript")), F.create_map(F.lit("href"), F.concat(F.lit("c"), at)))
    c = c.withColumn("links", links)
    out = K.links_of_type(c.where("pos % 2 = 0"), "text/css").unionByName(K.links_of_type(c.where("pos % 2 <> 0"), ""))
    at_ = F.when(F.col("link")["type"].isNull(), 2).otherwise(0)
    return out.select(F.col("book").alias("conv_id"), F.col("pos").alias("turn"), at_.alias("n"), F.col("link")["href"].alias("href"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'none' WHEN page_id % 3 = 1 THEN html ELSE 'none' END AS content FROM pages")
def content_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = F.when(F.col("page_id") % 3 == 0, F.lit(b"")).when(F.col("page_id") % 3 == 1, F.encode("html", "UTF-8"))
    return read(spark, sf_dir, "pages").select("page_id", F.decode(I.content(stored, b"none"), "UTF-8").alias("content"))


@query("""SELECT event_id, array_to_string(list_sort(list_filter([CASE WHEN event_id % 2 = 0 THEN 'href=' || event_id END, CASE WHEN event_id % 3 = 0 THEN 'id=' || user_id END, CASE WHEN event_id % 5 = 0 THEN 'xmlns:x=' || user_id WHEN event_id % 5 <> 1 THEN 'style=s' END], lambda x: x IS NOT NULL)), ';') AS attrs FROM events""")
def attribute_whitelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a link may keep of a map of attributes."""
    e, i = read(spark, sf_dir, "events"), F.col("event_id")
    user = F.col("user_id").cast("string")
    attrs = F.create_map(F.when(i % 2 == 0, "href").otherwise("onclick"), i.cast("string"), F.when(i % 3 == 0, "id").otherwise("src"), user, F.when(i % 5 == 0, "xmlns:x").when(i % 5 == 1, "border").otherwise("style"), F.when(i % 5 == 0, user).otherwise("s"))
    kept = F.transform(F.map_entries(D.allowed_attributes(attrs, "a")), lambda x: F.concat(x["key"], F.lit("="), x["value"]))
    return e.select("event_id", F.array_join(F.array_sort(kept), ";").alias("attrs"))


_COVER = f"(SELECT book, max(pos) + 1 AS p FROM {ITEMS_SQL} GROUP BY 1)"


@query(f"""SELECT book, pos::BIGINT AS pos, kind, id, file_name, media_type, is_linear FROM (SELECT book, pos, kind, id, file_name, media_type, is_linear FROM {ITEMS_SQL}
UNION ALL SELECT book, p, 'cover', 'cover-img', book || '.jpg', 'image/jpeg', true FROM {_COVER}
UNION ALL SELECT book, p + 1, 'cover_html', 'cover', 'cover.xhtml', '{C.XHTML_TYPE}', false FROM {_COVER})""")
def cover_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = items(spark, sf_dir).withColumn("content", F.lit(None).cast("binary"))
    covers = src.select("book").distinct().select("book", F.concat("book", F.lit(".jpg")).alias("file_name"), F.lit(b"img").alias("content"))
    meta = spark.createDataFrame([], "book string, seq int, ns string, name string, value string, attrs array<struct<k:string,v:string>>")
    out, _ = K.set_cover(src, meta, covers)
    return out.select("book", "pos", "kind", "id", "file_name", "media_type", "is_linear")


@query(f"""WITH i AS (SELECT book, pos, 'chapter_' || (row_number() OVER (PARTITION BY book ORDER BY pos) - 1) AS id, {_H1} AS heading FROM {PAGES_SQL}),
l AS (SELECT pos, count(*)::BIGINT AS n_links, arg_min({_HREF}, n) AS h FROM {_ANCHORS} GROUP BY 1)
SELECT i.book, i.pos, id, heading, coalesce(n_links, 0)::INT AS n_links, CASE WHEN h IS NULL THEN NULL WHEN h = '' THEN h ELSE h || '.xhtml' END AS first_link FROM i LEFT JOIN l USING (pos)""")
def page_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: pages as a book's documents with their id, heading, number of navigation links and first link rewritten."""
    src = K.auto_ids(pages(spark, sf_dir).select("book", "pos", F.lit("html").alias("kind"), F.lit(None).cast("string").alias("id"), "html"))
    src = src.withColumn("links", H.nav_links("html"))
    return src.select("book", "pos", "id", H.heading("html").alias("heading"), F.size("links").alias("n_links"), H.rewrite_link(H.href(F.try_element_at("links", F.lit(1)))).alias("first_link"))
