"""Line markup: parse to nodes, extract text, title and links, leave out drawings, tell feeds."""

from __future__ import annotations

import re
from dataclasses import dataclass
from urllib.parse import urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

from lanternfish.functions.text import DATED, GLYPHS

NODES = "array<struct<type:string,text:string,meta:string,orig_text:string>>"
DOCUMENT = "struct<text:string,title:string,links:array<string>,is_feed:boolean>"
# fixed values: words in the caption of a preformatted block that tell a drawing
ART_WORDS = ("ascii", "art", "banner", "logo", "title", "news", "capsule", "user", "image", "the", "graphics", "world")
_ART = re.compile(rb"([^ \t\n])\1{3}")


@dataclass
class Node:
    type: str
    text: str
    meta: str = ""
    orig_text: str = ""


def parse_nodes(source: str | None) -> list[Node]:
    out: list[Node] = []
    block: Node | None = None
    lines = (source or "").replace("\r\n", "\n").split("\n")
    if lines and not lines[-1]:
        lines.pop()
    for line in lines:
        if block is not None:
            block.orig_text += line + "\n"
            if line.startswith("```"):
                out.append(block)
                block = None
            else:
                block.text += line + "\n"
        elif line.startswith("```"):
            block = Node("preformatted_text", "", line[3:].strip(), line + "\n")
        elif line.startswith("=>") and line[2:].strip():
            url, _, text = line[2:].strip().replace("\t", " ").partition(" ")
            out.append(Node("link", text.strip(), url, line))
        elif m := re.match(r"(#{1,3})\s*(.*)", line):
            out.append(Node(f"heading{len(m[1])}", m[2].strip(), "", line))
        elif line.startswith("* "):
            out.append(Node("list", line[2:].strip(), "", line))
        elif line.startswith(">"):
            out.append(Node("quote", line[1:].strip(), "", line))
        else:
            out.append(Node("text", line, "", line))
    if block is not None:
        out.append(block)
    return out


def drawn(text: str) -> bool:
    return bool(_ART.search(text.encode())) or any(g in text for g in GLYPHS) or "(_-<" in text or "_ _ _ _" in text


def separator(text: str) -> bool:
    """A line that only parts paragraphs: one byte again and again, equal marks at both ends, or a table's edge."""
    b = text.encode()
    if len(set(b)) == 1:
        return True
    ends = len(b) > 6 and len(set(b[:3])) == 1 and len(set(b[-3:])) == 1 and b[0] not in b" \t" and b[-1] not in b" \t"
    return ends or "│".encode() in b[:5]


def extract(nodes: list[Node], concise: bool = True) -> tuple[str, str, list[str]]:
    """(text, title: the first top heading, links)."""
    parts, title, links, started = [], "", [], False
    for n in nodes:
        if n.type == "link":
            links.append(n.meta)
        if n.type == "heading1" and not title:
            title = n.text
        if concise and n.type == "preformatted_text":
            if not started or any(w in n.meta.lower() for w in ART_WORDS) or drawn(n.text):
                continue
        elif concise and n.type == "text" and n.text:
            started = True
            if separator(n.text):
                continue
        parts.append(n.text)
    return "\n".join(parts), title, links


def is_feed(nodes: list[Node], host: str | None = None, protocol: str = "") -> bool:
    """Three dated links in a row, of one host and protocol where a host is given; other nodes in between don't matter."""
    best = run = 0
    for n in nodes:
        if n.type != "link":
            continue
        ok = bool(DATED.fullmatch(n.text)) and (host is None or bool(n.meta))
        if ok and host is not None:
            u = urlsplit(n.meta) if "//" in n.meta else None
            own_host, own_protocol = (u.hostname or host, u.scheme or protocol) if u else (host, protocol)
            ok = own_host == host and (not protocol or own_protocol == protocol)
        run = run + 1 if ok else 0
        best = max(best, run)
    return best >= 3


def nodes_of(text: Column) -> Column:
    @F.pandas_udf(NODES)
    def parsed(s):
        return s.map(lambda x: [vars(n) for n in parse_nodes(x)])

    return parsed(text)


def document_of(text: Column, concise: bool = True, host: Column | None = None, protocol: str = "gemini") -> Column:
    """Text, title, links and whether it is a feed; with a host, links to other hosts or protocols don't count for a feed."""

    @F.pandas_udf(DOCUMENT)
    def made(s, hosts):
        import pandas as pd

        rows = []
        for x, h in zip(s, hosts):
            nodes = parse_nodes(x)
            t, title, links = extract(nodes, concise)
            rows.append((t, title, links, is_feed(nodes, h, protocol if h else "")))
        return pd.DataFrame(rows, columns=["text", "title", "links", "is_feed"])

    return made(text, F.lit(None).cast("string") if host is None else host)
