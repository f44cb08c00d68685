"""Interleaved document sequences: the texts and media references of HTML pages, in order, with payloads joined by digest.

A page becomes a sequence of items in document order: text (a block's text, white space folded) and media (an element that refers to a
resource or holds one). A reference ends the text before it, so positions say what stands where. An item of kind "media" has the element's name, the absolute
address (null for what stands in the page itself: svg, style, script), a caption and a digest. The caption of a link is its own text; of another element the figcaption of
the figure around it, else its alt or title text. The digest is the SHA-256 of the bytes for resources in the page and data: addresses, of the address without its
fragment else, and is the key of the payloads.

Payloads are the given table (digest, mime, n_bytes, content) and what the pages hold themselves. A first parse gives the digests of each page; those
that a bitmap of the given table's digests lets through, and those of the pages' own payloads, are written. Of these the join by digest is asked for
digests of the given table, and for those whose bytes pages hold in several forms (by type, as text or in base 64), of which the least counts. Only pages that ask are parsed
for the payloads that they hold of these; the given table is thinned to the digests asked for before it is grouped; and what was found goes back
to its pages by a 128-bit key of address and content. Any other payload that a page holds itself has this one form, so it is resolved where the page is parsed, and pages
that don't ask are shuffled nowhere. Pages are parsed a second time for their sequences, which costs less than to keep them all on disk between.

Parsing is by one regular expression over tags, in Python; comments, declarations, templates, scripts, styles and the head's text
are skipped; a head without its end tag ends at the body or its first element; unclosed elements end with the page. `tags` are the elements that count. The table `pages`
refers to other resources by links alone, none of which leads to a page in it; what its query resolves are the style sheets and scripts that the pages hold. A link
to a page of the table has that whole page as its payload.

Defined cases: null and empty pages have an empty sequence; without an address relative references stay as they are; a reference without
an address is dropped; a video's poster is an item after it; of a srcset the first address counts where there is no src; references repeated on a page are items each;
a caption in a figure without media is text; of several payloads of a digest the least content counts; rows of equal or null ids are
pages each; ids are integers; other columns are ignored; broken entities and tags are text.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
from collections.abc import Iterator
from urllib.parse import unquote_to_bytes, urldefrag, urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.bitmaps import bitmap_of, bits_for, mark
from tickloom.llm.shared import integer_id, map_arrow, materialise, need

#: The attributes that hold the address, by element.
ADDRESS = {"img": ("src", "data-src"), "video": ("src",), "audio": ("src",), "source": ("src",), "embed": ("src",), "object": ("data",), "iframe": ("src",), "a": ("href",)}
MEDIA_TAGS = ("img", "video", "audio", "source", "embed", "object", "iframe", "svg")
#: Elements that are payloads themselves.
INLINE_TYPES = {"svg": "image/svg+xml", "style": "text/css", "script": "text/javascript"}
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Possessive quantifiers: an unclosed tag is given up without trying it again from every place.
_BODY = "body|p|div|h[1-6]|main|article|section|nav|header|footer|aside|img|figure|ul|ol|dl|table|form|pre|blockquote"
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|svg)\b[^>]*>(.*?)(?:</\1\s*>|\Z)|<head\b[^>]*>(?:(?!</head\b|<(?:script|style|" + _BODY + r")\b).)*+|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9-]*+)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S | re.I)
_STARTS = re.compile(_BODY, re.I)
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

_PAYLOAD = [("mime", pa.string()), ("n_bytes", pa.int64()), ("content", pa.string())]
ITEM = pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("tag", pa.string()), ("src", pa.string()), ("caption", pa.string()), ("digest", pa.binary()), *_PAYLOAD])
ITEM_SQL = "struct<position: int, kind: string, text: string, tag: string, src: string, caption: string, digest: binary, mime: string, n_bytes: bigint, content: string>"


def data_bytes(src: str) -> bytes | None:
    """The bytes of a data: address; None if it is broken."""
    head, comma, body = src[5:].partition(",")
    if not comma:
        return None
    raw = unquote_to_bytes(body)
    if not head.rstrip().lower().endswith(";base64"):
        return raw
    try:
        return base64.b64decode(raw + b"=" * (-len(raw) % 4))
    except ValueError:
        return None


def address_digest(src: str) -> str:
    if src[:5].lower() == "data:" and (raw := data_bytes(src)) is not None:
        return hashlib.sha256(raw).hexdigest()
    return hashlib.sha256(urldefrag(src)[0].encode("utf-8", "surrogatepass")).hexdigest()


def absolute(base: str | None, src: str) -> str:
    if not base or src[:5].lower() == "data:":
        return src
    try:
        return urljoin(base, src)
    except ValueError:
        return src


def parse(page: str | None, base: str | None, tags: frozenset[str]) -> list[dict]:
    """The items of a page."""
    items: list[dict] = []
    text: list[str] = []
    figures: list[dict] = []  # open figures: their media and captions
    links: list[dict | None] = []  # open links, with their texts
    at = 0
    head = False  # in a head, of which only scripts and styles count

    def flush() -> None:
        folded = " ".join("".join(text).split())
        text.clear()
        if folded:
            items.append({"kind": "text", "text": folded})

    def say(raw: str) -> None:
        s = html.unescape(raw) if "&" in raw else raw
        if figures and figures[-1]["inside"]:
            figures[-1]["caption"].append(s)
        elif links and links[-1] is not None:
            links[-1]["said"].append(s)
        else:
            text.append(s)

    def close_link() -> None:
        link = links.pop()
        if link is not None and (said := " ".join("".join(link.pop("said")).split())):
            link["caption"] = said

    def close_figure(f: dict) -> None:
        if caption := " ".join("".join(f["caption"]).split()):
            for x in f["media"]:
                x["caption"] = caption
            if not f["media"]:
                items.insert(f["at"], {"kind": "text", "text": caption})

    for m in _TAG.finditer(page or ""):
        if m.start() > at and not head:
            say(page[at : m.start()])
        at = m.end()
        name = m[4]
        if m[1] and (raw := m[1].lower()) in tags and raw in INLINE_TYPES:
            body = (m[0] if raw == "svg" else m[2]).encode("utf-8", "surrogatepass")
            if body.strip():
                flush()
                items.append({"kind": "media", "tag": raw, "digest": hashlib.sha256(body).hexdigest(), "body": body})
                if figures and raw == "svg":
                    figures[-1]["media"].append(items[-1])
        if name is None:
            head = head if m[0][:5].lower() != "<head" else True
            continue
        name = name.lower()
        if head:
            if m[3] and name == "head" or _STARTS.fullmatch(name):
                head = False
            else:
                continue
        if name not in INLINE:
            (say if links and links[-1] is not None or figures and figures[-1]["inside"] else text.append)(" ")
            if not (links and links[-1] is not None or figures and figures[-1]["inside"]):
                flush()
        if m[3]:
            if name == "a" and links:
                close_link()
            elif name == "figcaption" and figures:
                figures[-1]["inside"] = False
            elif name == "figure" and figures:
                close_figure(figures.pop())
            continue
        if name == "figure":
            figures.append({"media": [], "caption": [], "inside": False, "at": len(items)})
        elif name == "figcaption" and figures:
            figures[-1] |= {"inside": True, "at": len(items)}
        if name == "a" and links:  # links don't nest
            close_link()
        attrs: dict[str, str] = {}
        if name in tags and m[5]:
            for k, *v in _ATTR.findall(m[5]):
                attrs.setdefault(k.lower(), html.unescape(v[0] or v[1] or v[2]))
        item = None
        found = [next((attrs[k].strip() for k in ADDRESS.get(name, ()) if attrs.get(k, "").strip()), None) if attrs else None]
        if not found[0] and name in ("img", "source") and attrs.get("srcset", "").strip():
            found = [attrs["srcset"].strip().split()[0].rstrip(",")]
        if name == "video" and attrs.get("poster", "").strip():
            found.append(attrs["poster"].strip())
        for src in filter(None, found):
            src = absolute(base, src)
            flush()
            item = {"kind": "media", "tag": name, "src": src, "caption": " ".join((attrs.get("alt") or attrs.get("title") or "").split()) or None, "digest": address_digest(src)}
            items.append(item)
            if figures and name != "a":
                figures[-1]["media"].append(item)
        if name == "a":
            if item is not None:
                item["said"] = []
            links.append(item)
    if page and at < len(page) and not head:
        say(page[at:])
    while links:
        close_link()
    flush()
    while figures:
        close_figure(figures.pop())
    for k, x in enumerate(items):
        x["position"] = k
    return items


def payload_of(item: dict) -> tuple[str, int, str] | None:
    """(mime, n_bytes, content in base 64 or as text) of what an item holds itself."""
    if body := item.get("body"):
        return INLINE_TYPES[item["tag"]], len(body), body.decode("utf-8", "replace")
    src = item.get("src") or ""
    if src[:5].lower() == "data:" and (raw := data_bytes(src)) is not None:
        return src[5:].partition(",")[0].partition(";")[0].lower() or "text/plain", len(raw), base64.b64encode(raw).decode()
    return None


def _item(x: dict) -> dict:
    """An item as it is returned, with the payload that it holds itself."""
    own = payload_of(x) if x["kind"] == "media" else None
    out = {k: v for k, v in x.items() if k != "body"}
    if "digest" in x:
        out["digest"] = bytes.fromhex(x["digest"])
    return out | dict(zip(("mime", "n_bytes", "content"), own)) if own else out


def _parse_batches(tags: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                b = whole.slice(k, 500)
                seq = [[_item(x) for x in parse(p, u, tags)] for p, u in zip(b.column(2).to_pylist(), b.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), b.column(4), pa.array(seq, pa.list_(ITEM))], ["page_id", "k1", "k2", "sequence"])

    return run


def _digest_batches(tags: frozenset[str]):
    """The distinct digests of each page; own: of what it holds itself, what its payload depends on besides the bytes, which the digest stands for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, digests, held = [], [], []
            for i, (page, base) in enumerate(zip(b.column(2).to_pylist(), b.column(1).to_pylist())):
                own = {(x["digest"], None if (p := payload_of(x)) is None else ("text " if "body" in x else "base64 ") + p[0]) for x in parse(page, base, tags) if x["kind"] == "media"}
                at += [i] * len(own)
                digests += [bytes.fromhex(d) for d, _ in own]
                held += [h for _, h in own]
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(3).take(take), b.column(4).take(take), pa.array(digests, pa.binary()), pa.array(held, pa.string())], ["k1", "k2", "digest", "own"])

    return run


def _own_batches(tags: frozenset[str]):
    """The distinct payloads that each page holds itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own: dict[tuple, None] = {}
            for page, base in zip(b.column(2).to_pylist(), b.column(1).to_pylist()):
                own |= {(x["digest"], *p): None for x in parse(page, base, tags) if x["kind"] == "media" and (p := payload_of(x))}
            cols = [pa.array([o[k + 1] for o in own], t) for k, (_, t) in enumerate(_PAYLOAD)]
            yield pa.RecordBatch.from_arrays([pa.array([bytes.fromhex(o[0]) for o in own], pa.binary()), *cols], ["digest", "mime", "n_bytes", "content"])

    return run


def _address_digests(urls: pa.Array) -> pa.Array:
    return pa.array([address_digest(u) for u in urls.to_pylist()], pa.string())


def page_payloads(pages: DataFrame) -> DataFrame:
    """The pages as payloads of their own addresses: (digest, mime, n_bytes, content), the content being the page itself."""
    digest = F.arrow_udf(_address_digests, "string")  # of the addresses alone, so that what asks for digests doesn't carry the pages
    p = pages.where("url is not null and html is not null")
    return p.select(digest("url").alias("digest"), F.lit("text/html").alias("mime"), F.octet_length("html").cast("bigint").alias("n_bytes"), F.col("html").alias("content"))


def media_sequences(pages: DataFrame, payloads: DataFrame, tags: tuple[str, ...] = MEDIA_TAGS) -> DataFrame:
    """(page_id, n_text, n_media, n_resolved, sequence) of every page; payloads: (digest, mime, n_bytes, content)."""
    need(pages, "page_id", "url", "html")
    need(payloads, "digest", "mime", "n_bytes", "content")
    none = F.concat(F.col("url").isNull().cast("string"), F.col("html").isNull().cast("string"))
    d = pages.select(integer_id(pages, "page_id").alias("page_id"), "url", "html", F.xxhash64("url", "html", none).alias("k1"), F.xxhash64(F.lit(7), "html", none, "url").alias("k2"))
    bits = bits_for(payloads.count())
    given = payloads.select(F.unhex("digest").alias("digest"), "mime", "n_bytes", "content").where("digest is not null")  # digests that aren't hexadecimal are nobody's
    refs = d.transform(map_arrow, _digest_batches(frozenset(tags)), "k1 long, k2 long, digest binary, own string")
    refs = mark(refs, [F.col("digest")], bitmap_of(given, [F.col("digest")], bits), "may", bits).where("may or own is not null").drop("may")
    refs = materialise(refs, "payloads-named")
    bits = bits_for(refs.count())
    thin = lambda x, keys: mark(x, [F.col("digest")], bitmap_of(keys, [F.col("digest")], bits), "may", bits).where("may").drop("may")
    several = refs.where("own is not null").groupBy("digest").agg(F.min("own").alias("a"), F.max("own").alias("z")).where("a < z").select("digest")
    asked = refs.join(thin(given.select("digest"), refs).unionAll(several), "digest", "left_semi").select("k1", "k2", "digest")
    asked = materialise(asked, "payloads-asked")  # equal pages ask the same, which the set below folds
    d = mark(d, [F.col("k1"), F.col("k2")], bitmap_of(asked, [F.col("k1"), F.col("k2")], bits), "may", bits)
    d, plain = (d.where(c).select("page_id", "url", "html", "k1", "k2") for c in ("may", "not may"))
    own = d.transform(map_arrow, _own_batches(frozenset(tags)), "digest binary, mime string, n_bytes long, content string")
    store = thin(given, asked).unionAll(thin(own, asked)).groupBy("digest").agg(F.min(F.struct("content", "mime", "n_bytes")).alias("payload"))
    found = asked.join(store, "digest").groupBy("k1", "k2").agg(F.map_from_entries(F.collect_set(F.struct("digest", "payload"))).alias("found"))
    read = lambda x: x.transform(map_arrow, _parse_batches(frozenset(tags)), f"page_id long, k1 long, k2 long, sequence array<{ITEM_SQL}>")
    plain = read(plain).select("page_id", "sequence", F.lit(None).cast(found.schema["found"].dataType).alias("found"))
    full = plain.unionAll(read(d).join(found, ["k1", "k2"], "left").select("page_id", "sequence", "found")).withColumn(
        "sequence",
        F.expr("""transform(transform(sequence, x -> struct(x, if(map_contains_key(found, x.digest), try_element_at(found, x.digest), named_struct('content', x.content, 'mime', x.mime, 'n_bytes', x.n_bytes)) as p)),
                  y -> named_struct('position', y.x.position, 'kind', y.x.kind, 'text', y.x.text, 'tag', y.x.tag, 'src', y.x.src, 'caption', y.x.caption, 'digest', lower(hex(y.x.digest)),
                  'mime', y.p.mime, 'n_bytes', y.p.n_bytes, 'content', y.p.content))"""),
    )
    count = lambda c: F.expr(f"size(filter(sequence, x -> {c}))")
    return full.select("page_id", count("x.kind = 'text'").alias("n_text"), count("x.kind = 'media'").alias("n_media"), count("x.mime is not null").alias("n_resolved"), "sequence")
