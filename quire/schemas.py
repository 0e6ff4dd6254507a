"""Table schemas of a corpus. Lists that have an order carry it as ``pos`` or ``seq``."""

BOOKS = "book string, version string, identifier_id string, uid string, title string, language string, direction string, folder string, prefixes array<string>, namespaces map<string,string>, templates map<string,binary>, error_code int, error string"
METADATA = "book string, seq int, ns string, name string, value string, attrs array<struct<k:string,v:string>>"
ITEMS = "book string, pos int, kind string, id string, file_name string, media_type string, is_linear boolean, manifest boolean, title string, lang string, direction string, media_overlay string, media_duration string, properties array<string>, metas array<map<string,string>>, links array<map<string,string>>, content binary"
SPINE = "book string, pos int, idref string, linear string"
TOC = "book string, path array<int>, parent_path array<int>, depth int, node_kind string, title string, href string, uid string"
GUIDE = "book string, pos int, href string, title string, type string, item_id string"
PAGE_LIST = "book string, pos int, file_name string, fragment string, label string"
BINDINGS = "book string, pos int, attrs map<string,string>"

TABLES = {"books": BOOKS, "metadata": METADATA, "items": ITEMS, "spine": SPINE, "toc": TOC, "guide": GUIDE, "page_list": PAGE_LIST, "bindings": BINDINGS}

#: Books that couldn't be read, and why: 0 for a broken archive, 1 for one that is too large, -1 for parts that are missing or can't be read.
QUARANTINE = "book string, error_code int, error string"
