"""Fixed values of the book model and of the container format."""

from __future__ import annotations

# Item types by name, and extensions by type in the order in which they are looked up.
UNKNOWN, IMAGE, STYLE, SCRIPT, NAVIGATION, VECTOR, FONT, VIDEO, AUDIO, DOCUMENT, COVER, SMIL = range(12)
EXTENSIONS = {
    IMAGE: (".jpg", ".jpeg", ".gif", ".tiff", ".tif", ".png"),
    STYLE: (".css",),
    VECTOR: (".svg",),
    FONT: (".otf", ".woff", ".ttf"),
    SCRIPT: (".js",),
    NAVIGATION: (".ncx",),
    VIDEO: (".mov", ".mp4", ".avi", ".webm"),
    AUDIO: (".mp3", ".ogg"),
    COVER: (".jpg", ".jpeg", ".png"),
    SMIL: (".smil",),
}

# Namespaces by short name.
NAMESPACES = {
    "XML": "http://www.w3.org/XML/1998/namespace",
    "EPUB": "http://www.idpf.org/2007/ops",
    "DAISY": "http://www.daisy.org/z3986/2005/ncx/",
    "OPF": "http://www.idpf.org/2007/opf",
    "CONTAINERNS": "urn:oasis:names:tc:opendocument:xmlns:container",
    "DC": "http://purl.org/dc/elements/1.1/",
    "XHTML": "http://www.w3.org/1999/xhtml",
}
CONTAINER_PATH = "META-INF/container.xml"
OPF_TYPE = "application/oebps-package+xml"
NCX_TYPE = "application/x-dtbncx+xml"
XHTML_TYPE = "application/xhtml+xml"
SMIL_TYPE = "application/smil+xml"
IMAGE_TYPES = ("image/jpeg", "image/jpg", "image/png", "image/svg+xml")

# Media types by extension; pinned, as the standard library's table differs between hosts.
MEDIA_TYPES = {
    ".xhtml": "application/xhtml+xml", ".html": "text/html", ".htm": "text/html", ".css": "text/css", ".js": "text/javascript",
    ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".gif": "image/gif", ".svg": "image/svg+xml", ".tif": "image/tiff", ".tiff": "image/tiff", ".webp": "image/webp",
    ".ttf": "font/ttf", ".otf": "font/otf", ".woff": "font/woff", ".woff2": "font/woff2",
    ".mp3": "audio/mpeg", ".ogg": "audio/ogg", ".mp4": "video/mp4", ".mov": "video/quicktime", ".avi": "video/x-msvideo", ".webm": "video/webm",
    ".txt": "text/plain", ".xml": "application/xml", ".ncx": "application/x-dtbncx+xml", ".smil": "application/smil+xml", ".pdf": "application/pdf", ".json": "application/json",
}
ENCODINGS = {".gz": "gzip", ".bz2": "bzip2", ".xz": "xz", ".z": "compress"}
DEFAULT_MEDIA_TYPE = "application/octet-stream"

KINDS = ("item", "ncx", "cover", "html", "cover_html", "nav", "image", "smil")
HTML_KINDS = ("html", "cover_html", "nav")
#: The start of automatic ids by kind: documents, images, everything else.
ID_STEMS = {"html": "chapter", "cover_html": "chapter", "nav": "chapter", "image": "image"}

#: Guide types that have another name as landmarks.
LANDMARKS = {"notes": "rearnotes", "text": "bodymatter"}

# Deprecated tags that cleaning strips.
DEPRECATED_TAGS = ("acronym", "applet", "basefont", "big", "center", "dir", "font", "frame", "frameset", "isindex", "noframes", "s", "strike", "tt")
