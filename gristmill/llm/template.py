"""Main text of web pages, by deducing each host's template from equivalence classes of tokens.

1. Classes. A page becomes a sequence of tokens: its tags, each in the role that its
   containers and, of divisions, its number among the like give it, and the words at either end of a text, in the role of the tag
   before. A role's occurrence vector is how often it occurs on each page of the host.
   Roles with the same vector are an equivalence class; a class is valid if its
   roles occur once on each of their pages, and on at least SUPPORT of the host's.
2. Template. On each page the valid classes nest, those of most pages first: the
   roles of a class must stand in the host's order and within one slot of what is
   nested so far. What lies between neighbouring tokens of the result are the slots.
3. Choice. For each slot of a host the words that aren't the template's are counted, in
   links and outside, and the slot's contents on different pages compared. What varies
   outside links is prose; the innermost container of the template that holds
   most of the host's prose is the article's. Containers of the template within it
   are left out if they hold nothing that varies, or mostly links, or
   stand before the first or after the last slot with prose.
4. Extraction of what remains in the container.

Vectors are never gathered: a role keeps an exclusive-or of hashes of (page,
count), which is equal for equal vectors and is aggregated map-side, so a host of any size
is a few rows for each task; so are the slots' counts. Tags and names that tell boilerplate
(``_BOILERPLATE``, ``_NAMED``) leave their containers out, too, and an article's tag
decides between containers that both hold prose; pages without any of these are extracted by
steps 1 to 3 alone.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_chunks
from .urlfilter import host_of

#: Share of a host's pages on which a class must occur to belong to the template.
SUPPORT = 0.5
#: Share of a host's prose that the article's container must hold; that which one of an article's tag must; and that which tells a part of the article from what stands around it.
MOST, TAGGED, PART = 0.6, 0.25, 0.15
#: Words at either end of a text that are tokens.
ENDS = 4
#: Pages from which on what never varies is the template's.
FEW = 3
_TAG = re.compile(r"<(?:!--.*?(?:--!?>|\Z)|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*>|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*')*+)/?>|(/?)([a-zA-Z][^\s/>]*)([^>]*)>)", re.DOTALL)
#: Elements whose content is no text of the page, up to their end tag.
_RAW = frozenset("script style textarea title noscript iframe xmp template svg math object select option canvas audio video".split())
#: Tags that divide a page, not a text.
_LAYOUT = frozenset("html head body article main section div nav header footer aside form dialog menu fieldset button".split())
#: Containers; only these nest. Others that are left open have no effect beyond a block's end.
_CONTAINERS = frozenset("html head body article main section div nav header footer aside form ul ol dl table figure details dialog menu fieldset button".split())
_BLOCKS = _CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr td th thead tbody tfoot caption blockquote pre hr address figcaption summary center legend".split())
_BOILERPLATE = frozenset("head nav footer aside form menu dialog fieldset button".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_NAMED = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertis\w+|banner|sidebar|side-?bar|menu|nav|navbar|navigation|breadcrumbs?|header|masthead|footer|notices?|cookies?|consent|comments?|commentlist|respond|replies|"
    r"share|sharing|social|related|recommended|promo\w*|popup|modal|newsletter|subscribe|login|signup|widget|sponsor\w*|copyright|disclaimer|pagination|skip-link)(?:$|[\s_-]|\d)",
    re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())


@dataclass
class Token:
    """A tag in its role (0: none), the text up to the next tag, and what is true of that: whether it lies in an article, in boilerplate, in a link, and begins a block; its container and that one's parent; and whether the tag opened the container."""

    role: int
    article: bool
    boilerplate: bool
    block: bool
    container: int
    text: str
    parent: int = 0
    link: bool = False
    opens: bool = False
    layout: bool = False
    heading: bool = False


def _named(attributes: str) -> tuple[str, bool, bool]:
    """(class, whether it names boilerplate, whether it is hidden)."""
    kind, bad, hidden = "", False, False
    for name, *values in _ATTRIBUTE.findall(attributes):
        value, name = "".join(values), name.lower()
        if name == "class":
            kind = value
        hidden |= name == "hidden" or name == "aria-hidden" and value.lower() == "true"
        bad |= bool(_NAMED.search(value)) if name in ("class", "id") else value.lower() in _ROLES
    return kind, bad, hidden


def tokens(page: str) -> list[Token]:
    """The page's tokens in order; the first stands for its beginning."""
    stack: list[tuple[str, int, bool, bool, int]] = []  # (tag, path's hash, in an article, in boilerplate, number)
    alike: dict[tuple[int, str, str], int] = {}  # divisions of the same tag and class so far, in each container
    out = [Token(0, False, False, True, 0, "")]
    at, numbers, heading, link, texts = 0, 0, "", False, []
    while True:
        m = _TAG.search(page, at)
        texts.append(page[at : m.start() if m else len(page)])  # a '<' that begins no tag is text
        if not m:
            break
        at = m.end()
        end, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue  # a comment or declaration: what it divides stays together
        tag = tag.lower()
        out[-1].text = "".join(texts)
        texts = []
        if tag in _RAW and not end:
            if not attributes.endswith("/"):
                close_tag = re.compile(rf"</{tag}\b[^>]*>", re.IGNORECASE).search(page, at)
                at = close_tag.end() if close_tag else len(page)
            top = out[-1]
            out.append(Token(0, top.article, top.boilerplate, tag not in ("svg", "math", "canvas"), top.container, "", top.parent, link))
            continue
        path = stack[-1][1] if stack else 0
        kind, opens = "", False
        if tag in _CONTAINERS:
            link = False
            if end:
                depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
                if depth is not None:
                    path = stack[depth][1]  # the end of what this path began
                    del stack[depth:]
            else:
                kind, bad, hidden = _named(attributes)
                inside, spoiled = (stack[-1][2], stack[-1][3]) if stack else (False, False)
                inside |= tag in ("article", "main")
                spoiled |= hidden or tag in _BOILERPLATE or tag == "header" or (bad and tag not in ("html", "body", "article", "main"))
                numbers += 1
                nth = 0
                if tag in _LAYOUT:
                    nth = alike[path, tag, kind] = alike.get((path, tag, kind), 0) + 1
                path = xxhash.xxh64_intdigest(f"{path}/{tag}.{kind}.{nth}")
                stack.append((tag, path, inside, spoiled, numbers))
                opens = True
        elif tag in _HEADINGS:
            heading = "" if end else tag
        elif tag == "a":
            link = not end
        inside, spoiled, number = stack[-1][2:] if stack else (False, False, 0)
        if spoiled and heading and inside and not any(s[3] and s[0] != "header" for s in stack[:-1]) and stack[-1][0] == "header":
            spoiled = False  # the heading of an article may stand in a header of its own
        role = xxhash.xxh64_intdigest(f"{path}|{end}{tag}|{kind}") >> 1 or 1
        out.append(Token(role, inside, spoiled, tag in _BLOCKS, number, "", stack[-2][4] if len(stack) > 1 else 0, link, opens, opens and tag in _LAYOUT, bool(heading)))
        if tag == "br":
            texts.append(" ")
    out[-1].text = "".join(texts)
    return out


def once(sequence: list[Token]) -> dict[int, int]:
    """Roles that occur once on a page, with the place."""
    seen: dict[int, int] = {}
    for i, t in enumerate(sequence):
        if t.role:
            seen[t.role] = -1 if t.role in seen else i
    return {r: i for r, i in seen.items() if i >= 0}


def _word(role: int, word: str) -> int:
    """The role of a word after a tag."""
    return xxhash.xxh64_intdigest(word, seed=role & 0xFFFFFFFF) >> 1 or 1


def _ends(text: str) -> list[str]:
    """The words at either end of a text."""
    words = text.split()
    return words if len(words) <= 2 * ENDS else words[:ENDS] + words[-ENDS:]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[tuple[str, int], list] = {}

    def flush() -> pa.RecordBatch:
        # all words, too: a task doesn't know how many of its host's other pages have one
        rows = [(h, r, *v) for (h, r), v in found.items()]
        found.clear()
        types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], _COUNT_NAMES)

    for batch in text_chunks(batches, "html"):
        for host, page, text in zip(batch.column("host").to_pylist(), batch.column("page").to_pylist(), batch.column("html").to_pylist(), strict=True):
            sequence = tokens(text)
            counts: dict[int, int] = {}
            for t in sequence:
                if t.role:
                    counts[t.role] = counts.get(t.role, 0) + 1
            places = once(sequence)
            marks = {n: xxhash.xxh64_intdigest(f"{page}|{n}") >> 1 for n in {1, *counts.values()}}
            for role, n in counts.items():
                v = found.setdefault((host, role), [0, 0, 0, 0.0])
                v[0] += 1
                v[1] += n == 1
                v[2] ^= marks[n]
                v[3] += places.get(role, 0) / len(sequence)
            for role, i in places.items():
                ends = _ends(sequence[i].text)
                for w in {w for w in ends if ends.count(w) == 1}:
                    v = found.setdefault((host, _word(role, w)), [0, 0, 0, 0.0])
                    v[0] += 1
                    v[1] += 1
                    v[2] ^= marks[1]
                    v[3] += (i + 0.5) / len(sequence)
        if len(found) > 200_000:
            yield flush()
    if found:
        yield flush()


_COUNT_NAMES = ["host", "role", "pages", "once", "vector", "place"]
_COUNT = "host string, role long, pages long, once long, vector long, place double"


def templates(pages: DataFrame, support: float = SUPPORT) -> DataFrame:
    """(host, template): for each host the roles of its valid classes in order, each with its class and how many pages that is on.

    A class is valid with two roles at least, once each on at least ``support`` of the host's pages.
    """
    counted = pages.select("host", "page", "html").mapInArrow(_count, _COUNT).groupBy("host", "role")
    counted = counted.agg(F.sum("pages").alias("pages"), F.sum("once").alias("once"), F.bit_xor("vector").alias("vector"), F.sum("place").alias("place"))
    sizes = materialize(pages.groupBy("host").agg(F.count("*").alias("all_pages")), "hosts")
    # most words are on few of their host's pages: only what fits is written
    fitting = counted.where("once = pages").join(sizes, "host").where(F.col("pages") >= support * F.col("all_pages"))
    fitting = materialize(fitting, "roles")
    classes = fitting.groupBy("host", "vector").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    member = F.struct((F.col("place") / F.col("pages")).alias("place"), "role", "vector", "pages")
    # roles on half of a host's pages: not many more than a page has
    return fitting.join(classes, ["host", "vector"]).groupBy("host").agg(F.sort_array(F.collect_list(member)).alias("template"))


def nested(sequence: list[Token], template: list[dict]) -> dict[int, int]:
    """The template's tags on a page, by their place: classes of most pages first, each in order and within one slot of those before, or else left out."""
    places = once(sequence)
    classes: dict[int, list[int]] = {}
    pages: dict[int, int] = {}
    for m in template:
        if m["role"] in places:
            classes.setdefault(m["vector"], []).append(places[m["role"]])
            pages[m["vector"]] = m["pages"]
    taken: list[int] = []
    for vector in sorted(classes, key=lambda v: (-pages[v], -len(classes[v]), v)):
        at = classes[vector]
        ordered = all(a < b for a, b in zip(at, at[1:], strict=False))
        if ordered and (not taken or bisect_left(taken, at[0]) == bisect_left(taken, at[-1])):
            taken = sorted([*taken, *at])
    return {i: sequence[i].role for i in taken}


@dataclass
class Part:
    """What a page has of a slot: the role of the template's container that it lies in (0: none), its characters of words outside and in links, whether it is an article's or boilerplate, and a digest of its words; of a slot that a container begins, the container around that."""

    container: int
    prose: int = 0
    links: int = 0
    flags: int = 0
    words: str = ""
    outside: int = 0


def slots(sequence: list[Token], template: list[dict]) -> dict[int, Part]:
    """A page's slots, by the role of the template's tag before them; words of the template aren't counted."""
    marks = nested(sequence, template)
    known, at = {m["role"] for m in template}, once(sequence)
    outer = {0: 0}  # the template's container that each container lies in
    out: dict[int, Part] = {}
    now = None
    for i, t in enumerate(sequence):
        if t.opens:
            outer[t.container] = t.role if i in marks and t.layout else outer.get(t.parent, 0)
        if i in marks:
            now = out[t.role] = Part(outer.get(t.container, 0))
        if now is None or not t.text.strip():
            continue
        if outer.get(t.container, 0) != now.container:
            now = out.setdefault(-outer.get(t.container, 0) or -1, Part(outer.get(t.container, 0)))  # a container's slot that no tag of the template begins
        words = t.text.split()
        if at.get(t.role) == i:  # only then its words at the ends may be the template's
            middle = words[ENDS:-ENDS] if len(words) > 2 * ENDS else []
            ends = [words[:ENDS], words[-ENDS:]] if middle else [words, []]
            first, last = ([w for w in part if _word(t.role, w) not in known] for part in ends)
            words = [*first, *middle, *last]
        size = sum(map(len, words))
        if t.link:
            now.links += size
        elif not t.boilerplate:
            now.prose += size
        now.words = xxhash.xxh64_hexdigest(now.words + " ".join(words))
        now.flags |= int(t.article) | 2 * int(t.boilerplate) | 4 * int(t.heading)
    for i in marks:  # containers without any text are part of the tree, too
        t = sequence[i]
        if t.layout:
            out[t.role].flags |= 8 | 16 * int(t.article)
            out[t.role].outside = outer.get(t.parent, 0)
    return out


_SLOT_NAMES = ["host", "role", "container", "outside", "pages", "prose", "links", "flags", "variety", "place"]
_SLOT = "host string, role long, container long, outside long, pages long, prose long, links long, flags long, variety long, place double"


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[tuple[str, int], list] = {}
    known: dict[str, list[dict]] = {}

    def flush() -> pa.RecordBatch:
        rows = [(h, r, *v) for (h, r), v in found.items()]
        found.clear()
        types = (pa.string(),) + (pa.int64(),) * 8 + (pa.float64(),)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], _SLOT_NAMES)

    for batch in text_chunks(batches, "html"):
        for host, text, k in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), range(batch.num_rows), strict=True):
            if host not in known:
                known.clear() if len(known) > 1000 else None
                known[host] = batch.column("template")[k].as_py() or []
            sequence = tokens(text)
            at = once(sequence)
            for role, part in slots(sequence, known[host]).items():
                v = found.setdefault((host, role), [part.container, part.outside, 0, 0, 0, 0, 0, 0.0])
                v[2] += 1
                v[3] += part.prose
                v[4] += part.links
                v[5] |= part.flags
                v[6] |= 1 << (xxhash.xxh64_intdigest(part.words) % 63)
                v[7] += at.get(role, 0) / len(sequence)
        if len(found) > 100_000:
            yield flush()
    if found:
        yield flush()


_PLAN = "struct<main:bigint,out:array<bigint>>"


def plan(parts: list[dict]) -> dict:
    """(main, out) of a host: the role of the article's container, 0 if there is none, and those of the containers in it to leave out.

    ``parts``: the host's slots, each with its role, container, outside, pages, prose, links, flags, variety and place.
    """
    outside = {p["role"]: p["outside"] for p in parts if p["role"] == p["container"]}
    varied = [p for p in parts if p["variety"] & (p["variety"] - 1)]
    if not any(p["prose"] for p in varied):
        varied = parts  # one page, or pages that are all the same
    prose = dict.fromkeys(outside, 0)
    links, vary = dict(prose), set()

    def around(c: int) -> list[int]:
        """A container and those around it, the innermost first."""
        out = []
        while c in outside and c not in out:
            out.append(c)
            c = outside[c]
        return out

    for p in parts:
        for c in around(p["container"]):
            links[c] += p["links"]
    for p in varied:
        for c in around(p["container"]):
            prose[c] += p["prose"]
            vary |= {c} if p["prose"] else set()
    total = max(prose.values(), default=0)
    if not total:
        return {"main": 0, "out": []}
    flags = {p["role"]: p["flags"] for p in parts}
    depth = {c: len(around(c)) for c in outside}
    fitting = [c for c in outside if prose[c] >= MOST * total]
    tagged = [c for c in outside if flags[c] & 16 and prose[c] >= TAGGED * total]
    main = min(tagged, key=lambda c: (depth[c], -prose[c], c)) if tagged else max(fitting, key=lambda c: (depth[c], prose[c], c))
    inner = [c for c in outside if c != main and main in around(c)]
    place = {p["role"]: p["place"] / p["pages"] for p in parts}
    # slots with prose, and containers that hold a part of it or a heading that varies, are the article's own
    own = [place[p["role"]] for p in varied if p["container"] == main and p["prose"]]
    own += [place[c] for c in inner if prose[c] >= PART * prose[main] or any(p["flags"] & 4 and p["prose"] for p in varied if p["container"] == c)]
    first, last = min(own, default=0.0), max(own, default=1.0)
    many = any(p["pages"] >= FEW for p in parts) and varied is not parts
    out = []
    for c in inner:
        if links[c] > prose[c] or (many and c not in vary) or (not tagged and not first <= place[c] <= last):
            out.append(c)
    return {"main": main, "out": sorted(out)}


def _choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array([plan(r["parts"]) for r in rows], pa.struct([("main", pa.int64()), ("out", pa.list_(pa.int64()))]))], ["host", "plan"])


def plans(pages: DataFrame, known: DataFrame) -> DataFrame:
    """(host, plan) from pages and the templates of their hosts."""
    measured = pages.join(known, "host").select("host", "html", "template").mapInArrow(_measure, _SLOT).groupBy("host", "role")
    totals = [F.sum(c).alias(c) for c in ("pages", "prose", "links", "place")] + [F.bit_or(c).alias(c) for c in ("flags", "variety")]
    measured = measured.agg(F.max("container").alias("container"), F.max("outside").alias("outside"), *totals)
    listed = measured.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("role", "container", "outside", "pages", "prose", "links", "flags", "variety", "place"))).alias("parts"))
    return listed.mapInArrow(_choose, f"host string, plan {_PLAN}")


def _blocks(sequence: list[Token], wanted: list[bool]) -> list[str]:
    """The text of the wanted tokens in blocks, white space made single."""
    out, now = [], []

    def end() -> None:
        words = html.unescape("".join(now)).split()
        if words:
            out.append(" ".join(words))
        now.clear()

    for t, keep in zip(sequence, wanted, strict=True):
        if t.block:
            end()
        if keep:
            now.append(t.text)
    end()
    return out


def _within(sequence: list[Token], container: int) -> list[bool]:
    """Whether each token lies in the container, however deep."""
    inside, out = {container}, []
    for t in sequence:
        # a container's first token comes after its parent's
        if t.parent in inside and t.container != t.parent:
            inside.add(t.container)
        out.append(t.container in inside)
    return out


def extract(page: str, chosen: dict | None) -> tuple[list[str], str]:
    """(blocks, how they were found): the main text of a page by its host's plan, or by its own structure where that has no place here."""
    sequence = tokens(page)
    if chosen and chosen["main"]:
        at = once(sequence)
        if chosen["main"] in at:
            wanted = _within(sequence, sequence[at[chosen["main"]]].container)
            for role in chosen["out"]:
                if role in at:
                    wanted = [w and not x for w, x in zip(wanted, _within(sequence, sequence[at[role]].container), strict=True)]
            blocks = _blocks(sequence, [w and not t.boilerplate for w, t in zip(wanted, sequence, strict=True)])
            if blocks:
                return blocks, "template"
    if any(t.article for t in sequence):
        return _blocks(sequence, [t.article and not t.boilerplate for t in sequence]), "article"
    mass: dict[int, int] = {}
    for t in sequence:
        if not t.boilerplate:
            mass[t.container] = mass.get(t.container, 0) + len(t.text.strip())
    best = max(mass, key=lambda c: (mass[c], -c), default=0)
    return _blocks(sequence, [w and not t.boilerplate for w, t in zip(_within(sequence, best), sequence, strict=True)]), "largest container"


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_chunks(batches, "html"):
        found = [extract(h, t) for h, t in zip(batch.column("html").to_pylist(), batch.column("plan").to_pylist(), strict=True)]
        arrays = [pa.array([b for b, _ in found], pa.list_(pa.string())), pa.array([h for _, h in found], pa.string())]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), *arrays], ["page_id", "url", "blocks", "found_by"])


def main_text(pages: DataFrame, support: float = SUPPORT) -> DataFrame:
    """(page_id, url, blocks, found_by) for every row: the main text of its whole html, in blocks.

    A null html is empty and has no block. Pages without a host (a null url, or
    none in it) share the empty one. Text that occurs on other pages, too, stays if it
    is the article's. Repeated rows are extracted each; an empty table gives none.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), host_of(F.col("url").cast("string")).alias("host"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("page", F.xxhash64("page_id", "url"))
    # as tables their sizes are known, and the joins broadcast them only if those are small
    known = materialize(templates(rows, support), "templates")
    chosen = materialize(plans(rows, known), "plans")
    return rows.join(chosen, "host", "left").select("page_id", "url", "html", "plan").mapInArrow(_extract, "page_id long, url string, blocks array<string>, found_by string")
