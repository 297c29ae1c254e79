"""Markdown and Org mode to HTML (X8), before links are added and the result is cleaned.

Markdown: headings of both kinds, paragraphs, hard breaks, nested lists and tasks, quotes, fenced and indented
code, tables, rules, emphasis that doesn't break words, strike-through, code, links, images, automatic links,
escapes and raw HTML (which the cleaning reduces afterwards). Org mode: headlines, lists, blocks, tables,
emphasis and links. Both read a text as blocks of lines, then the text of a block as spans; nothing raises, what
fits no rule is text.
"""

from __future__ import annotations

import html as _html
import posixpath
import re

from forgeframe.functions import text as T

LIST_ITEM = re.compile(r"( *)([-*+]|\d{1,9}[.)])( +|$)(.*)")
TABLE_RULE = re.compile(r" *\|? *:?-+:? *(\| *:?-+:? *)*\|? *$")
ESCAPED = r"\\([\\`*_{}\[\]()#+\-.!:|&<>~])"
BARE_URL = r"\bhttps?://[^\s<>\"']*[^\s<>\"'.,;:!?)\]]"
BOX = {"[ ] ": '<input type="checkbox" disabled="" />', "[x] ": '<input type="checkbox" disabled="" checked="" />', "[X] ": '<input type="checkbox" disabled="" checked="" />'}


def escape(s: str) -> str:
    return _html.escape(s, quote=False)


def indent(line: str) -> int:
    return len(line) - len(line.lstrip(" "))


def lines_of(text: str) -> list[str]:
    """Lines without the two characters that ``Spans`` marks places with."""
    return re.sub("[\x00\x01]", "", text).replace("\r\n", "\n").split("\n")


# ---- spans ------------------------------------------------------------------------------


class Spans:
    """Turns a block's text into HTML: what is found first is set aside, so that later rules don't see into it."""

    def __init__(self, prefix: str = "", site: str = "", hard: bool = False):
        self.prefix, self.site, self.hard, self.kept = prefix, site, hard, []

    def keep(self, made: str) -> str:
        self.kept.append(made)
        return f"\x00{len(self.kept) - 1}\x01"

    def restore(self, s: str) -> str:
        while "\x00" in s:
            s = re.sub("\x00(\\d+)\x01", lambda m: self.kept[int(m[1])], s)
        return s

    def target(self, to: str) -> str:
        """Addresses within the site are below the prefix."""
        return to if re.match(T.LINK, to) or to.startswith("#") or not to else posixpath.join(self.prefix, to)

    def automatic(self, url: str) -> str:
        """A bare address: this site's commits and issues are shown short."""
        to = _html.escape(url)
        if self.site and url.startswith(self.site):
            if m := re.search(r"commit/([0-9a-zA-Z]+)", url):
                return f' <code><a href="{to}">{m[1][:10]}</a></code>'
            if m := re.search(r"issues/([0-9]+)", url):
                repo = url[len(self.site) : m.start()].rstrip("/")
                here = repo == self.prefix.strip("/")
                return f'<a href="{to}">{"" if here else escape(repo)}#{m[1]}</a>'
        return f'<a href="{to}">{escape(url)}</a>'

    def anchor(self, to: str, label: str, title: str | None = None) -> str:
        note = f' title="{_html.escape(title)}"' if title else ""
        return f'<a href="{_html.escape(self.target(to))}"{note}>{label}</a>'

    def markdown(self, s: str) -> str:
        s = re.sub(r"(`+)(.+?)(?<!`)\1(?!`)", lambda m: self.keep(f"<code>{escape(m[2].strip())}</code>"), s, flags=re.S)
        s = re.sub(ESCAPED, lambda m: self.keep(escape(m[1])), s)
        s = re.sub(r"<(https?://[^\s<>]+|mailto:[^\s<>]+)>", lambda m: self.keep(f'<a href="{_html.escape(m[1])}">{escape(m[1].removeprefix("mailto:"))}</a>'), s)
        s = re.sub(r"<([\w.+-]+@[\w-]+(?:\.[\w-]+)+)>", lambda m: self.keep(f'<a href="mailto:{m[1]}">{m[1]}</a>'), s)
        s = re.sub(r"</?[a-zA-Z][a-zA-Z0-9]*(?:\s[^<>]*)?/?>|<!--.*?-->", lambda m: self.keep(m[0]), s, flags=re.S)
        s = re.sub(r"&(?:[a-zA-Z]\w*|#\d+|#x[0-9a-fA-F]+);", lambda m: self.keep(m[0]), s)
        address = r"\(\s*<?([^\s<>()]*(?:\([^\s()]*\)[^\s<>()]*)*)>?(?:\s+[\"']([^\"']*)[\"'])?\s*\)"
        s = re.sub(r"!\[([^\[\]]*)\]" + address, lambda m: self.keep(f'<img src="{_html.escape(m[2])}" alt="{_html.escape(m[1])}"' + (f' title="{_html.escape(m[3])}"' if m[3] else "") + " />"), s)
        s = re.sub(r"\[((?:[^\[\]]|\[[^\[\]]*\])+)\]" + address, lambda m: self.keep(self.anchor(m[2], self.spans(m[1]), m[3])), s)
        s = re.sub(BARE_URL, lambda m: self.keep(self.automatic(m[0])), s)
        return self.restore(self.breaks(self.spans(s)))

    def spans(self, s: str) -> str:
        """Emphasis and strike-through; marks inside of words are text."""
        s = escape(s)
        for mark, tag in ((r"\*\*\*", "strong><em"), (r"\*\*", "strong"), ("__", "strong"), ("~~", "del"), (r"\*", "em"), ("_", "em")):
            end = "em></strong" if tag == "strong><em" else tag
            s = re.sub(rf"(?<![\w\\]){mark}(?=\S)(.+?)(?<=\S){mark}(?!\w)", rf"<{tag}>\1</{end}>", s, flags=re.S)
        return s

    def breaks(self, s: str) -> str:
        return re.sub(r"\n" if self.hard else r"(?: {2,}|\\)\n", "<br />\n", s)

    def org(self, s: str) -> str:
        s = re.sub(r"(?<!\w)([=~])(?=\S)(.+?)(?<=\S)\1(?!\w)", lambda m: self.keep(f"<code>{escape(m[2])}</code>"), s)
        s = re.sub(r"\[\[([^\[\]]+)\](?:\[([^\[\]]+)\])?\]", lambda m: self.keep(self.org_link(m[1], m[2])), s)
        s = re.sub(BARE_URL, lambda m: self.keep(self.automatic(m[0])), s)
        s = escape(s)
        for mark, tag in ((r"\*", "strong"), ("/", "em"), ("_", "u"), (r"\+", "del")):
            s = re.sub(rf"(?<![\w]){mark}(?=\S)(.+?)(?<=\S){mark}(?!\w)", lambda m, tag=tag: self.keep(f"<{tag}>") + m[1] + self.keep(f"</{tag}>"), s, flags=re.S)
        return self.restore(s.replace("\\\\\n", "<br />\n"))

    def org_link(self, to: str, label: str | None) -> str:
        to = to.removeprefix("file:")
        if not label and re.search(r"\.(png|jpe?g|gif|svg|webp)$", to, re.I):
            return f'<img src="{_html.escape(to)}" alt="{_html.escape(posixpath.basename(to))}" />'
        return self.anchor(to, escape(label or to))


# ---- Markdown's blocks ------------------------------------------------------------------


def cells(line: str) -> list[str]:
    """The cells of a table's line; escaped bars are text."""
    line = line.strip().removeprefix("|")
    line = line[:-1] if line.endswith("|") and not line.endswith("\\|") else line
    return [c.strip() for c in re.split(r"(?<!\\)\|", line)]


def table(head: list[str], rule: list[str], rows: list[list[str]], inline) -> str:
    sides = ["center" if r.startswith(":") and r.endswith(":") else "right" if r.endswith(":") else "left" if r.startswith(":") else "" for r in rule]
    sides += [""] * len(head)
    row = lambda tag, values: "<tr>" + "".join(f"<{tag}{f' align="{a}"' if a else ''}>{inline(v)}</{tag}>" for v, a in zip(values, sides)) + "</tr>"
    body = "".join(row("td", (r + [""] * len(head))[: len(head)]) for r in rows)
    return f"<table><thead>{row('th', head)}</thead><tbody>{body}</tbody></table>"


def begins_block(line: str) -> bool:
    return bool(re.match(r" {0,3}(#{1,6} |>|```|~~~)", line) or re.match(r" {0,3}([-*_])( *\1){2,} *$", line) or LIST_ITEM.match(line))


def blocks(lines: list[str], spans: Spans, tight: bool = False) -> str:
    out, at = [], 0
    while at < len(lines):
        line = lines[at]
        if not line.strip():
            at += 1
        elif m := re.match(r" {0,3}(```+|~~~+) *([^`]*)$", line):
            end = next((i for i in range(at + 1, len(lines)) if lines[i].strip().startswith(m[1]) and not lines[i].strip().strip(m[1][0])), len(lines))
            word = re.match(r"[\w+#-]+", m[2].strip())
            name = f' class="language-{word[0]}"' if word else ""
            out.append(f"<pre><code{name}>" + "".join(escape(x) + "\n" for x in lines[at + 1 : end]) + "</code></pre>")
            at = end + 1
        elif m := re.match(r" {0,3}(#{1,6}) +(.*?)(?: +#+)? *$", line):
            out.append(f"<h{len(m[1])}>{spans.markdown(m[2])}</h{len(m[1])}>")
            at += 1
        elif re.match(r" {0,3}([-*_])( *\1){2,} *$", line):
            out.append("<hr />")
            at += 1
        elif re.match(r" {0,3}>", line):
            end = at
            while end < len(lines) and lines[end].strip() and (re.match(r" {0,3}>", lines[end]) or not begins_block(lines[end])):
                end += 1
            out.append("<blockquote>" + blocks([re.sub(r"^ {0,3}> ?", "", x) for x in lines[at:end]], spans) + "</blockquote>")
            at = end
        elif LIST_ITEM.match(line):
            made, at = items(lines, at, spans)
            out.append(made)
        elif line.startswith("    ") or line.startswith("\t"):
            end = at
            while end < len(lines) and (lines[end].startswith(("    ", "\t")) or not lines[end].strip()):
                end += 1
            body = [re.sub(r"^(?: {4}|\t)", "", x) for x in lines[at:end]]
            out.append("<pre><code>" + escape("\n".join(body).rstrip("\n")) + "\n</code></pre>")
            at = end
        elif "|" in line and at + 1 < len(lines) and TABLE_RULE.match(lines[at + 1]) and "-" in lines[at + 1] and len(cells(lines[at + 1])) == len(cells(line)):
            end = at + 2
            while end < len(lines) and "|" in lines[end] and lines[end].strip():
                end += 1
            out.append(table(cells(line), cells(lines[at + 1]), [cells(x) for x in lines[at + 2 : end]], lambda v: spans.markdown(v.replace("\\|", "|"))))
            at = end
        elif re.match(r" {0,3}<(?:div|p|table|ul|ol|li|dl|pre|blockquote|h[1-6]|hr|details|center)\b", line, re.I):
            end = next((i for i in range(at, len(lines)) if not lines[i].strip()), len(lines))
            out.append("\n".join(lines[at:end]))
            at = end
        else:
            end, head = at + 1, 0
            while end < len(lines) and lines[end].strip() and not head:
                if m := re.match(r" {0,3}(=+|-+) *$", lines[end]):
                    head = 1 if m[1][0] == "=" else 2
                elif begins_block(lines[end]):
                    break
                end += 1
            text = "\n".join(x.lstrip() for x in lines[at : end - (head > 0)])
            made = spans.markdown(text.rstrip(" "))
            out.append(f"<h{head}>{made}</h{head}>" if head else made if tight else f"<p>{made}</p>")
            at = end
    return "\n".join(out)


def items(lines: list[str], at: int, spans: Spans) -> tuple[str, int]:
    """A list from line ``at``: its HTML, and the line after it."""
    first = LIST_ITEM.match(lines[at])
    ordered, depth, bullet = first[2][0].isdigit(), len(first[1]), first[2][-1]
    found: list[list[str]] = []
    loose = False
    while at < len(lines):
        m = LIST_ITEM.match(lines[at])
        if not m or len(m[1]) > depth + 3 or len(m[1]) < depth or m[2][0].isdigit() != ordered or m[2][-1] != bullet or re.match(r" {0,3}([-*_])( *\1){2,} *$", lines[at]):
            break
        width = len(m[1]) + len(m[2]) + min(max(len(m[3]), 1), 4)
        body, at = [m[4]], at + 1
        while at < len(lines):
            if not lines[at].strip():
                after = next((x for x in lines[at:] if x.strip()), "")
                if indent(after) < max(depth + 2, 2):
                    break
                body.append("")
            elif indent(lines[at]) >= min(width, depth + 2):
                body.append(lines[at][min(width, indent(lines[at])) :])
            elif begins_block(lines[at]):
                break
            else:
                body.append(lines[at].lstrip())
            at += 1
        found.append(body)
        gap = at
        while gap < len(lines) and not lines[gap].strip():
            gap += 1
        more = LIST_ITEM.match(lines[gap]) if gap < len(lines) else None
        if more and gap > at and len(more[1]) == depth and more[2][0].isdigit() == ordered and more[2][-1] == bullet:
            loose, at = True, gap
    out = []
    for body in found:
        box = next((k for k in BOX if body[0].startswith(k)), None)
        inner = blocks([body[0][len(box) :] if box else body[0], *body[1:]], spans, not loose and "" not in body)
        out.append(f"<li>{BOX[box] + ' ' if box else ''}{inner}</li>")
    start = int(first[2][:-1]) if ordered else 1
    tag = "ol" if ordered else "ul"
    return f"<{tag}{f' start="{start}"' if start != 1 else ''}>" + "".join(out) + f"</{tag}>", at


def raw_markdown(text: str, prefix: str = "", site: str = "", hard: bool = False) -> str:
    """HTML of Markdown. hard: every line break of a paragraph is one."""
    return blocks([x.replace("\t", "    ") for x in lines_of(text)], Spans(prefix, site, hard))


# ---- Org mode ---------------------------------------------------------------------------


def raw_org(text: str, prefix: str = "", site: str = "") -> str:
    """HTML of Org mode."""
    spans, out, lines, at = Spans(prefix, site), [], lines_of(text), 0
    while at < len(lines):
        line = lines[at]
        if not line.strip() or re.match(r"\s*#(?: |$)", line) or re.match(r"\s*#\+(?!begin_)", line, re.I):
            title = re.match(r"\s*#\+title: *(.+)", line, re.I)
            if title:
                out.append(f"<h1>{spans.org(title[1])}</h1>")
            at += 1
        elif m := re.match(r"(\*+) +(?:(?:TODO|DONE) +)?(.*?)(?: +:[\w:@]+:)? *$", line):
            level = min(6, len(m[1]) + 1)
            out.append(f"<h{level}>{spans.org(m[2])}</h{level}>")
            at += 1
        elif m := re.match(r"\s*#\+begin_(\w+) *(\S*)", line, re.I):
            kind = m[1].lower()
            end = next((i for i in range(at + 1, len(lines)) if re.match(rf"\s*#\+end_{kind}", lines[i], re.I)), len(lines))
            body = "\n".join(lines[at + 1 : end])
            if kind == "quote":
                out.append(f"<blockquote><p>{spans.org(body)}</p></blockquote>")
            else:
                name = f' class="language-{m[2]}"' if kind == "src" and re.fullmatch(r"\w+", m[2]) else ""
                out.append(f"<pre><code{name}>{escape(body)}\n</code></pre>")
            at = end + 1
        elif line.lstrip().startswith("|"):
            end = at
            while end < len(lines) and lines[end].lstrip().startswith("|"):
                end += 1
            rows = [cells(x) for x in lines[at:end]]
            rule = next((i for i, r in enumerate(lines[at:end]) if re.match(r"\s*\|-", r)), None)
            body = [r for i, r in enumerate(rows) if not re.match(r"\s*\|-", lines[at + i])]
            head = body[0] if rule == 1 else [""] * len(body[0]) if body else []
            out.append(table(head, [""] * len(head), body[1:] if rule == 1 else body, spans.org) if body else "")
            at = end
        elif re.match(r"\s*-{5,}\s*$", line):
            out.append("<hr />")
            at += 1
        elif re.match(r"\s*(?:[-+]|\d+[.)]) ", line):
            made, at = org_items(lines, at, spans)
            out.append(made)
        else:
            end = at + 1
            while end < len(lines) and lines[end].strip() and not re.match(r"\*+ |\s*(?:[-+]|\d+[.)]) |\s*#\+|\s*\|", lines[end]):
                end += 1
            out.append(f"<p>{spans.org(chr(10).join(x.strip() for x in lines[at:end]))}</p>")
            at = end
    return "\n".join(x for x in out if x)


def org_items(lines: list[str], at: int, spans: Spans) -> tuple[str, int]:
    depth, tag, out = indent(lines[at]), "ol" if lines[at].lstrip()[0].isdigit() else "ul", []
    while at < len(lines) and (m := re.match(r"( *)(?:[-+]|\d+[.)]) (.*)", lines[at])) and len(m[1]) == depth and lines[at].lstrip()[0].isdigit() == (tag == "ol"):
        box = {"[ ] ": BOX["[ ] "], "[X] ": BOX["[x] "], "[-] ": BOX["[ ] "]}.get(m[2][:4])
        inner, at = (box + " " if box else "") + spans.org(m[2][4:] if box else m[2]), at + 1
        while at < len(lines) and lines[at].strip() and indent(lines[at]) > depth:
            if re.match(r" *(?:[-+]|\d+[.)]) ", lines[at]):
                nested, at = org_items(lines, at, spans)
                inner += nested
            else:
                inner, at = f"{inner}\n{spans.org(lines[at].strip())}", at + 1
        out.append(f"<li>{inner}</li>")
    return f"<{tag}>" + "".join(out) + f"</{tag}>", at
