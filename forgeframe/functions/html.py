"""Text functions that need Python: HTML, diffs, versions, HMAC, sniffing.

Each has a plain function and an Arrow-batched UDF over it (``udf``).
"""

from __future__ import annotations

import difflib
import hashlib
import hmac as _hmac
import html as _html
import ipaddress
import re
from collections.abc import Callable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F

from forgeframe.functions import markup
from forgeframe.functions import text as T


def udf(f: Callable, kind: str = "string"):
    """A pandas UDF that maps rows of its columns through ``f``; a row with a null gives null."""

    @F.pandas_udf(kind)
    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([None if any(x is None for x in row) else f(*row) for row in zip(*columns)], dtype=object)

    return run


# ---- links in HTML ------------------------------------------------------------------------

VOID = {"input", "br", "hr", "img", "area", "col", "wbr"}
VERBATIM = {"a", "code", "pre"}


def special_links(text: str, prefix: str, repo_link: str, site: str, subpath: str = "") -> str:
    """As the Column of this name in ``text``."""
    anchor = lambda to, label: f'<a href="{to}">{label}</a>'

    def one(m: re.Match) -> str:
        m = m[0]
        if re.fullmatch(T.MENTION, m):
            lead, _, name = m.rpartition("@")
            return lead + anchor(f"{subpath}/{name}", "@" + name)
        if re.fullmatch(T.ISSUE_NUMBER, m):
            name = m.lstrip(" ([")
            return m[: len(m) - len(name)] + anchor(f"{prefix}/issues/{name[1:]}", name)
        if re.fullmatch(T.CROSS_ISSUE, m):
            name = m.lstrip(" ")
            repo, _, index = name.partition("#")
            return m[: len(m) - len(name)] + anchor(f"{site}{repo}/issues/{index}", name)
        return m if m.isdigit() and int(m) else f'<a href="{repo_link}/commit/{m}"><code>{m[:10]}</code></a>'

    return re.sub(T.SPECIAL, one, text)


class Linker(HTMLParser):
    """Copies HTML; text outside of links and code gets special links, images a link around them."""

    def __init__(self, prefix: str, repo_link: str, site: str):
        super().__init__(convert_charrefs=False)
        self.to, self.prefix, self.repo_link, self.site = [], prefix, repo_link, site
        self.kept: list[str] = []  # open elements below the first verbatim one

    def handle_starttag(self, tag, attrs):
        raw = self.get_starttag_text()
        if self.kept:
            if tag not in VOID:
                self.kept.append(tag)
        elif tag == "img":
            raw = self.image(raw, dict(attrs))
        elif tag in VERBATIM:
            self.kept.append(tag)
        self.to.append(raw)

    def image(self, raw: str, attrs: dict) -> str:
        src = attrs.get("src") or ""
        if not src or src.startswith("data:"):
            return raw
        if re.match(T.LINK, src):
            return f'<a href="{src}">{raw}</a>'
        full = self.prefix.replace("/src/", "/raw/", 1) + ("" if src.startswith("/") else "/") + src
        alt = f' alt="{attrs["alt"]}"' if attrs.get("alt") else ""
        return f'<a href="{full}"><img src="{full.replace(" ", "%20")}"{alt}></a>'

    def handle_startendtag(self, tag, attrs):
        self.to.append(self.get_starttag_text())

    def handle_endtag(self, tag):
        if self.kept:
            self.kept.pop()
        self.to.append(f"</{tag}>")

    def handle_data(self, data):
        self.to.append(data if self.kept else special_links(data, self.prefix, self.repo_link, self.site))

    def handle_entityref(self, name):
        self.to.append(f"&{name};")

    def handle_charref(self, name):
        self.to.append(f"&#{name};")

    def handle_comment(self, data):
        self.to.append(f"<!--{data}-->")

    def handle_decl(self, decl):
        self.to.append(f"<!{decl}>")


def linked_html(text: str, prefix: str = "", repo_link: str = "", site: str = "") -> str:
    """HTML with special links in its text; broken HTML is returned unchanged."""
    parser = Linker(prefix, repo_link, site)
    try:
        parser.feed(text)
        parser.close()
    except AssertionError:
        return text
    return "".join(parser.to)


# ---- sanitising ---------------------------------------------------------------------------

#: What user HTML may hold, elements and their attributes with the values that they may have.
ELEMENTS = set(
    """a abbr acronym area article aside b bdi bdo blockquote br caption cite code col colgroup dd del details dfn div dl dt em figcaption figure h1 h2 h3 h4 h5 h6 hgroup hr i img
    input ins kbd li map mark meter ol p pre progress q rp rt ruby s samp section small span strike strong sub summary sup table tbody td tfoot th thead time tr tt u ul var wbr""".split()
)
NUMBER, SIZE, SIDE, LEVEL = r"[0-9]+", r"[0-9]+%?", r"(?i:center|justify|left|right|char)", r"(?i:baseline|bottom|middle|top)"
PARAGRAPH, WHEN, ANY, REAL = r"[\w\s\-',\[\]!./\\()&]*", r"[0-9T:+.Z -]+", r"(?s:.*)", r"[-+]?[0-9]*\.?[0-9]+"
EVERYWHERE = {"dir": r"(?i:ltr|rtl)", "id": r"[a-zA-Z0-9:\-_.]+", "lang": r"[a-zA-Z]{2,20}", "title": PARAGRAPH}
CELL = {"abbr": PARAGRAPH, "align": SIDE, "valign": LEVEL, "colspan": NUMBER, "rowspan": NUMBER, "height": SIZE, "width": SIZE, "headers": r"[\w -]+", "scope": r"(?i:row|col|rowgroup|colgroup)", "nowrap": r"(?i:|nowrap)"}
ROW = {"align": SIDE, "valign": LEVEL}
ATTRIBUTES = {
    "a": {"href": ANY, "title": ANY}, "area": {"alt": PARAGRAPH, "coords": r"[0-9]+(?:,[0-9]+)+", "href": ANY, "rel": ANY, "shape": r"(?i:default|circle|rect|poly)"}, "map": {"name": r"[\w-]+"},
    "img": {"src": ANY, "alt": ANY, "title": ANY, "width": SIZE, "height": SIZE, "align": r"(?i:left|right|top|texttop|middle|absmiddle|baseline|bottom|absbottom)"},
    "td": CELL, "th": CELL, "tr": ROW, "tbody": ROW, "thead": ROW, "tfoot": ROW, "col": ROW | {"span": NUMBER, "width": SIZE}, "colgroup": ROW | {"span": NUMBER, "width": SIZE},
    "table": {"height": SIZE, "width": SIZE, "summary": PARAGRAPH}, "code": {"class": r"language-\w+"}, "input": {"type": "checkbox", "checked": ANY, "disabled": ANY},
    "ol": {"start": NUMBER, "type": "(?:disc|circle|square|a|A|i|I|1)"}, "ul": {"type": "(?:disc|circle|square)"}, "li": {"type": "(?:disc|circle|square|a|A|i|I|1)", "value": NUMBER},
    "blockquote": {"cite": ANY}, "q": {"cite": ANY}, "del": {"cite": ANY, "datetime": WHEN}, "ins": {"cite": ANY, "datetime": WHEN}, "time": {"datetime": WHEN}, "details": {"open": "(?i:|open)"},
    "meter": {k: REAL for k in ("value", "min", "max", "low", "high", "optimum")}, "progress": {"value": REAL, "max": REAL}, "bdo": {"dir": "(?i:ltr|rtl)"},
}
DROPPED = {"script", "style", "iframe", "object", "embed", "noscript", "template", "textarea", "title", "head"}
SCHEMES = {"http", "https", "mailto"}
SAFE_IMAGES = {"image/png", "image/jpeg", "image/gif", "image/webp", "image/x-icon"}


def safe_url(value: str, schemes: set[str] = SCHEMES) -> bool:
    # browsers leave out control characters and white space in a scheme
    m = re.match(r"([a-zA-Z][a-zA-Z0-9+.-]*):(.*)", re.sub(r"[\x00-\x20]", "", value), re.S)
    if not m:
        return True
    if m[1].lower() == "data":
        return re.split("[;,]", m[2], maxsplit=1)[0].strip().lower() in SAFE_IMAGES
    return m[1].lower() in schemes


class Cleaner(HTMLParser):
    def __init__(self, schemes: set[str]):
        super().__init__(convert_charrefs=False)
        self.to, self.schemes, self.skip, self.open = [], schemes, [], []

    def handle_starttag(self, tag, attrs):
        if self.skip or tag in DROPPED:
            if tag in DROPPED:
                self.skip.append(tag)
            return
        if tag not in ELEMENTS:
            return
        kept = []
        for k, v in attrs:
            v = v or ""
            allowed = ATTRIBUTES.get(tag, {}).get(k) or EVERYWHERE.get(k)
            if allowed is None or not re.fullmatch(allowed, v) or k in ("href", "src", "cite") and not safe_url(v, self.schemes):
                continue
            kept.append(f' {k}="{_html.escape(v)}"')
        if tag in ("a", "area") and any(k.startswith(" href=") for k in kept):
            kept.append(' rel="nofollow"')
        if tag == "a" and not kept or tag == "img" and not any(k.startswith(" src=") for k in kept) or tag == "input" and not kept:
            return
        self.to.append(f"<{tag}{''.join(kept)}>")
        if tag not in VOID:
            self.open.append(tag)

    def handle_endtag(self, tag):
        if self.skip:
            if tag == self.skip[-1]:
                self.skip.pop()
            return
        if tag in self.open:
            self.open.reverse()
            self.open.remove(tag)
            self.open.reverse()
            self.to.append(f"</{tag}>")

    def handle_data(self, data):
        if not self.skip:
            self.to.append(data.replace("<", "&lt;").replace(">", "&gt;"))

    def handle_entityref(self, name):
        if not self.skip:
            self.to.append(f"&{name};")

    def handle_charref(self, name):
        if not self.skip:
            self.to.append(f"&#{name};")


def sanitised(text: str, schemes: set[str] = SCHEMES) -> str:
    """HTML reduced to the allowed elements, attributes and URL schemes; scripts and styles go with their content."""
    parser = Cleaner(schemes)
    parser.feed(text)
    parser.close()
    return "".join(parser.to)


# ---- markup -------------------------------------------------------------------------------


def markdown(text: str, prefix: str = "", repo_link: str = "", site: str = "", hard: bool = False) -> str:
    """Markdown as HTML, then links in its text, then sanitised."""
    return sanitised(linked_html(markup.raw_markdown(text, prefix, site, hard), prefix, repo_link, site))


def org_mode(text: str, prefix: str = "", repo_link: str = "", site: str = "") -> str:
    """Org mode as HTML, then links in its text, then sanitised."""
    return sanitised(linked_html(markup.raw_org(text, prefix, site), prefix, repo_link, site))


# ---- diffs --------------------------------------------------------------------------------


def inline_diff(old: str, new: str, side: str) -> str:
    """One side of two paired lines (signs cut) as HTML, changed characters marked; side: add or delete."""
    sign, kind, css = ("+", "insert", "added-code") if side == "add" else ("-", "delete", "removed-code")
    out = [sign]
    for op, a, b, c, d in difflib.SequenceMatcher(None, old, new, autojunk=False).get_opcodes():
        part = new[c:d] if side == "add" else old[a:b]
        if op == "equal":
            out.append(_html.escape(part))
        elif part and op in (kind, "replace"):
            out.append(f'<span class="{css}">{_html.escape(part)}</span>')
    return "".join(out)


def diff_lines(patch: str, files: int = 100, lines: int = 1000, chars: int = 2000) -> list[dict]:
    """Rows (file, section, kind, left, right, content) of a unified diff; files and lines beyond the display limits are left out, long lines cut."""
    out, name, n_files, n_lines, section, left, right = [], "", 0, 0, 0, 0, 0
    for line in patch.split("\n"):
        if line.startswith("diff --git "):
            n_files += 1
            if n_files > files:
                break
            name, section, n_lines = line.rsplit(" b/", 1)[-1], 0, 0
        elif m := re.match(r"@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@", line):
            section, left, right = section + 1, int(m[1]), int(m[2])
        elif section and line[:1] in ("+", "-", " "):
            kind = {"+": "add", "-": "delete", " ": "plain"}[line[0]]
            n_lines += 1
            if n_lines <= lines:
                out.append({"file": name, "section": section, "kind": kind, "left": left if kind != "add" else 0, "right": right if kind != "delete" else 0, "content": line[1 : chars + 1]})
            left += kind != "add"
            right += kind != "delete"
    return out


DIFF_DDL = "array<struct<file:string,section:int,kind:string,left:int,right:int,content:string>>"

# ---- the rest -----------------------------------------------------------------------------

#: First bytes of file kinds.
MAGIC = [(b"\x89PNG\r\n\x1a\n", "image"), (b"\xff\xd8\xff", "image"), (b"GIF8", "image"), (b"BM", "image"), (b"%PDF-", "pdf"), (b"\x1aE\xdf\xa3", "video"), (b"OggS", "video")]


def file_kind(content: bytes) -> str:
    """image, pdf, video, text or binary, by content; empty content is text."""
    head = bytes(content[:1024])
    for magic, kind in MAGIC:
        if head.startswith(magic):
            return kind
    if head[:4] == b"RIFF" and head[8:12] == b"WEBP":
        return "image"
    if head[4:8] == b"ftyp" or head[:4] == b"RIFF" and head[8:12] == b"AVI ":
        return "video"
    return "binary" if any(b < 9 or 14 <= b < 27 or 28 <= b < 32 for b in head) else "text"


def signature(payload: str, secret: str) -> str:
    """HMAC-SHA256 in hex, as deliveries carry it."""
    return _hmac.new(secret.encode(), payload.encode(), hashlib.sha256).hexdigest()


VERSION = re.compile(r"v?(\d+)(?:\.(\d+))?(?:\.(\d+))?(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?$")


def version_key(v: str):
    if v.count(".") > 2:
        v = ".".join(v.split(".", 3)[:3])
    m = VERSION.match(v.strip())
    if not m:
        return None
    pre = tuple((0, int(p), "") if p.isdigit() else (1, 0, p) for p in m[4].split(".")) if m[4] else ()
    return tuple(int(m[i] or 0) for i in (1, 2, 3)), not pre, pre


def version_compare(a: str, comparison: str, b: str) -> bool:
    """Whether two semantic versions compare so; false if one can't be read."""
    x, y = version_key(a), version_key(b)
    if x is None or y is None:
        return False
    return {"": x == y, "=": x == y, "==": x == y, "!=": x != y, ">": x > y, "<": x < y, ">=": x >= y, "<=": x <= y}.get(comparison.strip(), False)


#: Networks that deliveries may not reach.
BLOCKED = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.88.99.0/24",
    "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "255.255.255.255/32", "::1/128", "fc00::/7", "fe80::/10",
)


def blocked_address(host: str, allowed: tuple[str, ...] = ()) -> bool:
    """Whether an address is local and not allowed. Names aren't resolved here: a name that is no address counts as blocked unless allowed."""
    if "*" in allowed or host in allowed:
        return False
    try:
        ip = ipaddress.ip_address(host)
    except ValueError:
        return True
    return any(ip in ipaddress.ip_network(n) for n in BLOCKED)


def password_hash(password: str, salt: str) -> str:
    """PBKDF2 with SHA-256, 10000 rounds, 50 bytes, in hex."""
    return hashlib.pbkdf2_hmac("sha256", password.encode(), salt.encode(), 10000, 50).hex()


def password_matches(password: str, salt: str, stored: str) -> bool:
    """Whether a password has the stored hash, compared in constant time."""
    return _hmac.compare_digest(password_hash(password, salt).encode(), stored.encode())
