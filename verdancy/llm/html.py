"""Main text of web pages by wrappers inferred from pages of one host.

A page becomes a stream of tags and texts. Runs that repeat in a row fold into repeated groups; streams of one host are
aligned one after another, where what one lacks becomes an optional group and what one repeats a repeated group. Texts
that differ where streams agree make slots; texts that recur there are constants. The result is a union-free
expression, the host's wrapper. It tells which slots hold the article: constants are the host's template, repeated
groups of short links its menus, and pages are read through the slots that vary.
"""

from __future__ import annotations

import html
import json
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdancy.llm.runs import SquareCatcher
from verdancy.llm.storage import frugal, parts, small_batches, stored

FAN = 32  # wrappers of a host that are aligned in one group
HELD_HOSTS = 2_000
HELD_STREAMS = 64  # distinct streams of a host that wait for their alignment
BROADCAST_BYTES = 32 << 20
LONG = 3_000  # rows of an alignment held at a time, the others are worked out again from every LONG-th: bounds memory, changes no result
COMMON = 64  # the bits of a key on more nodes are kept
UNIT = 24  # a repeated unit of more nodes is looked for by its squares
CONSTANTS = 256  # texts of a slot whose pages are counted; a text on more than a few pages in a hundred is among them
SLOT = "#"

# Share of a host's pages from which a recurring text outside an article or main element is template.
RECURS, LEAST_PAGES = 0.6, 3
LINKED, LINK_CHARS = 0.8, 60  # a repeated group with this share of linked text, in links of this mean length at most, is a menu
HOLDS = 0.9  # an element with this share of the text that varies is no side part, whatever its name

# Elements by how HTML treats them, and the names by which pages mark what is no article.
RAW = "script|style|noscript|template|textarea|svg|iframe|object|select"
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSES_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table article section div body nav aside main td th".split())
ASIDE = frozenset("head title nav menu header footer aside form button dialog".split())
MAIN = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ASIDE_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|header|masthead|footer|sidebar|side|aside|widget|cookies?|consent|notice\w*|popup|modal|newsletter|subscribe|signup|login|share|sharing|social|related|recommend\w*|comments?|commentlist|disqus|replies|respond|form)(?:$|[\s_-])"
)

_TOKEN = re.compile(
    rf"<!--(?:.*?-->|.*\Z)|<(?P<raw>{RAW})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>(?:.*?</(?P=raw)\s*>|.*\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>",
    re.S | re.I,
)
_MARK = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)


def stream(page: str) -> Iterator[tuple[str, str]]:
    """Events of a page: ("open", key), ("close", name), ("empty", name) and ("text", text).

    A key is the tag's name with those words of its class, id and role that tell a side part. Other names say nothing
    about place or kind and may change from page to page, so tags align by element and place alone.
    """
    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            yield "text", page[at : m.start()]
        at = m.end()
        if name := m["name"]:
            name = name.lower()
            if m["end"]:
                yield "close", name
            elif name in VOID:
                yield "empty", name
            else:
                marks = " ".join(a or b or c for a, b, c in _MARK.findall(m["rest"])) if m["rest"] else ""
                told = {m[0].strip(" \t\n\r\f_-") for m in ASIDE_NAME.finditer(marks.lower())} if marks else ()
                yield "open", " ".join([name, *sorted(told)])
    if at < len(page):
        yield "text", page[at:]


def placed(page: str) -> Iterator[tuple[str, tuple[str, ...], str]]:
    """The stream with the open elements at each event; elements that HTML closes by itself are closed."""
    path: list[str] = []
    names: list[str] = []

    def close_to(k: int) -> None:
        del path[k:], names[k:]

    for kind, x in stream(page):
        if kind == "open":
            name = x.split(" ", 1)[0]
            if name in CLOSES_P and "p" in names:
                close_to(len(names) - 1 - names[::-1].index("p"))
            for i in range(len(names) - 1, -1, -1):
                if names[i] in CLOSES_SAME.get(name, ()):
                    close_to(i)
                    break
                if names[i] in SCOPES:
                    break
            path.append(x)
            names.append(name)
        elif kind == "close":
            if x in names:
                close_to(len(names) - 1 - names[::-1].index(x))
        yield kind, tuple(path), x


class Texts:
    """What a slot has held: texts, their characters, and for recurring texts (by hash) pages and length."""

    __slots__ = ("texts", "chars", "seen")

    def __init__(self, texts: int, chars: int, seen: dict[int, list[int]]):
        self.texts, self.chars, self.seen = texts, chars, seen

    @classmethod
    def of(cls, text: str) -> Texts:
        return cls(1, len(text), {_text_hash(text): [1, len(text)]})

    def take(self, other: Texts, same_page: bool) -> None:
        """Adds what other has seen on the same page or on other ones. Where too many texts are counted, all counts lose as much as leaves CONSTANTS of them, so that frequent ones stay."""
        self.texts += other.texts
        self.chars += other.chars
        for h, (n, size) in other.seen.items():
            own = self.seen.get(h)
            if own is None:
                self.seen[h] = [n, size]
            else:
                own[0] = max(own[0], n) if same_page else own[0] + n
        if len(self.seen) > 4 * CONSTANTS:
            least = sorted((n for n, _ in self.seen.values()), reverse=True)[CONSTANTS]
            self.seen = {h: [n - least, size] for h, (n, size) in self.seen.items() if n > least}


# A wrapper is a list of nodes (key, load). A key is a tag ("<" and its path), a slot ("#" and its path), or a group
# ("?" or "+", keys) of optional or repeated nodes. The load of a slot is its Texts, that of a group its nodes' loads.
# Loads are updated in place: a wrapper that another takes up is used up.
def _take(load, other, same_page: bool) -> None:
    if isinstance(load, Texts):
        load.take(other, same_page)
    elif load is not None:
        for x, y in zip(load, other, strict=True):
            _take(x, y, same_page)


def _is(key, kind: str) -> bool:
    return not isinstance(key, str) and key[0] == kind


def _group(kind: str, nodes: list) -> tuple:
    return (kind, tuple(k for k, _ in nodes)), [x for _, x in nodes]


def folded(nodes: list, one_page: bool = False) -> list:
    """Runs of nodes that repeat in a row become one repeated group, shortest runs first; units of more than UNIT nodes are told by the squares of the keys."""
    keys, loads = [k for k, _ in nodes], [x for _, x in nodes]
    width = 1
    while width <= len(keys) // 2:
        if width > UNIT:
            catcher = SquareCatcher(2 * UNIT)
            catcher.append(keys)
            width = min((period for _, _, period in catcher.runs() if period >= width), default=len(keys))
            if width > len(keys) // 2:
                break
        out, held, at, changed = [], [], 0, False
        while at < len(keys):
            unit, upto = keys[at : at + width], at + width
            while len(unit) == width and keys[upto : upto + width] == unit:
                _take(loads[at : at + width], loads[upto : upto + width], one_page)
                upto += width
            if upto > at + width:
                again = width == 1 and _is(unit[0], "+")
                out.append(unit[0] if again else ("+", tuple(unit)))
                held.append(loads[at] if again else loads[at : at + width])
                at, changed = upto, True
            else:
                out.append(keys[at])
                held.append(loads[at])
                at += 1
        keys, loads = out, held
        width = 1 if changed else width + 1
    return list(zip(keys, loads, strict=True))


def _repeating(nodes: list, other: list) -> list:
    """nodes with each run that other has as a repeated group put as that group, longest runs first."""
    units: dict[int, set] = defaultdict(set)
    for k, _ in other:
        if _is(k, "+"):
            units[len(k[1])].add(k[1])
    for width in sorted(units, reverse=True):
        out, at, keys = [], 0, [k for k, _ in nodes]
        while at < len(nodes):
            if tuple(keys[at : at + width]) in units[width]:
                out.append(_group("+", nodes[at : at + width]))
                at += width
            else:
                out.append(nodes[at])
                at += 1
        nodes = out
    return folded(nodes)


def _optional(nodes: list) -> list:
    """Each node optional by itself, so that a later stream may have some of them only."""
    return [n if _is(n[0], "?") else _group("?", [n]) for n in nodes]


def matched(a: list, b: list) -> list[tuple[int, int]]:
    """Places of a longest common subsequence of two lists of keys, of any length.

    A row of lengths is the bits of one number: bit j is 0 where b[j] adds to the length, so a row is a few operations
    on long numbers. Every LONG-th row is kept and the rows between are worked out again on the way back.
    """
    begin = end = 0
    while begin < min(len(a), len(b)) and a[begin] == b[begin]:
        begin += 1
    while end < min(len(a), len(b)) - begin and a[-1 - end] == b[-1 - end]:
        end += 1
    ends = [(len(a) - k, len(b) - k) for k in range(end, 0, -1)]
    rows, columns = a[begin : len(a) - end], b[begin : len(b) - end]
    places: dict = defaultdict(list)
    for j, key in enumerate(columns):
        places[key].append(j)
    kept: dict = {}

    def bits(key) -> int:
        if (found := kept.get(key)) is None:
            found = 0
            for j in places.get(key, ()):
                found |= 1 << j
            if len(places.get(key, ())) > COMMON:
                kept[key] = found
        return found

    full = (1 << len(columns)) - 1

    def after(row: int, key) -> int:
        both = row & bits(key) if key in places else 0
        return (row + both | row - both) & full if both else row

    marks, row = [full], full
    for i, key in enumerate(rows, 1):
        row = after(row, key)
        if i % LONG == 0:
            marks.append(row)
    found = []
    i, j = len(rows), len(columns)
    while i and j:
        first = (i - 1) // LONG
        held = [marks[first]]  # rows first * LONG to i
        for key in rows[first * LONG : i]:
            held.append(after(held[-1], key))
        while i > first * LONG and j:
            at = i - first * LONG
            if held[at] >> (j - 1) & 1:
                j -= 1
            else:
                i -= 1
                if held[at - 1] >> (j - 1) & 1:
                    j -= 1
                    found.append((begin + i, begin + j))
    return [(k, k) for k in range(begin)] + found[::-1] + ends


def aligned(a: list, b: list) -> list:
    """The wrapper of what two wrappers of different pages describe."""
    if [k for k, _ in a] != [k for k, _ in b]:
        a, b = _repeating(a, b), _repeating(b, a)
    lone = lambda n: _is(n[0], "?") and len(n[0][1]) == 1
    bare = lambda n: n[0][1] if lone(n) else (n[0],)
    out: list = []
    i = k = 0
    for j, m in [*matched([bare(n) for n in a], [bare(n) for n in b]), (len(a), len(b))]:
        out += _optional(a[i:j]) + _optional(b[k:m])
        if j < len(a):
            x, y = a[j], b[m]
            own, other = (n[1][0] if lone(n) else n[1] for n in (x, y))
            _take(own, other, False)
            out.append(x if lone(x) or not lone(y) else (y[0], [own]))
        i, k = j + 1, m + 1
    return folded(out)


def _text_hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode())


def page_nodes(page: str) -> list:
    """A page's stream as a wrapper of its own. Each node is a tag with the path it stands on, or a slot on its path."""
    nodes: list = []
    for kind, path, x in placed(page):
        if kind == "text":
            if text := " ".join(x.split()):
                key, texts = f"{SLOT}{'>'.join(path)}", Texts.of(text)
                if nodes and nodes[-1][0] == key:
                    nodes[-1][1].take(texts, True)
                else:
                    nodes.append((key, texts))
        elif kind == "open":
            nodes.append((f"<{'>'.join(path)}", None))
    return folded(nodes, True)


def _slots(nodes: Iterable, menu: bool = False) -> Iterator[tuple[str, Texts, bool]]:
    """Path and texts of each slot, and whether it is in a repeated group of short links."""
    for key, load in nodes:
        if isinstance(key, str):
            if key[0] == SLOT:
                yield key[1:], load, menu
        else:
            inside = list(zip(key[1], load, strict=True))
            yield from _slots(inside, menu or key[0] == "+" and _of_links(list(_slots(inside))))


def _name(element: str) -> str:
    return element.split(" ", 1)[0]


def _of_links(slots: list[tuple[str, Texts, bool]]) -> bool:
    linked = [t for path, t, _ in slots if "a" in map(_name, path.split(">"))]
    chars = sum(t.chars for t in linked)
    return bool(linked) and chars >= LINKED * sum(t.chars for _, t, _ in slots) and chars <= LINK_CHARS * sum(t.texts for t in linked)


def _side(element: str) -> bool:
    name, _, marks = element.partition(" ")
    return name in ASIDE or bool(marks and ASIDE_NAME.search(marks))


def article_rule(wrapper: list, pages: int) -> dict[str, list[int]]:
    """Paths of the slots that hold the article, each with the hashes of texts that are template there.

    Slots in an article or main element are taken where the wrapper has any, else those of the body. A slot goes if an
    element of its path (below the article's own element) is a side part by kind or name; an element that holds nearly
    all text that varies is none. Nothing else goes from an article or main element. Outside, a slot goes if all of it
    is in menus, and texts that recur on most pages are template, but only where twice as much text varies: else pages
    are copies of each other. Headings between slots that vary are none. One page shows no template.
    """
    held: dict[str, tuple[Texts, bool]] = {}
    order: dict[str, list[int]] = {}  # first and last place of each path in the wrapper
    for place, (path, texts, menu) in enumerate(_slots(wrapper)):
        order.setdefault(path, [place, place])[1] = place
        if path in held:
            held[path][0].take(texts, False)
            held[path] = held[path][0], held[path][1] and menu
        else:
            held[path] = Texts(texts.texts, texts.chars, {h: list(x) for h, x in texts.seen.items()}), menu
    split = {path: tuple(path.split(">")) for path in held}
    first = {path: next((i for i, k in enumerate(p) if _name(k) in MAIN), None) for path, p in split.items()}
    main = [p for p, i in first.items() if i is not None and not any(_name(k) in ASIDE for k in split[p][:i])]
    for inside, some in ((True, main), (False, list(held))):
        counted = not inside and pages >= LEAST_PAGES
        often = {p: {h: n * size for h, (n, size) in held[p][0].seen.items() if n >= RECURS * pages} if counted else {} for p in some}
        varies = {p: max(0, held[p][0].chars - sum(often[p].values())) for p in some}
        within: dict[tuple[str, ...], int] = defaultdict(int)
        for p in some:
            for i in range(len(split[p])):
                within[split[p][: i + 1]] += varies[p]
        whole = sum(varies.values())

        def kept(p: str, inside: bool = inside, within: dict = within, whole: int = whole) -> bool:
            begin = first[p] + 1 if inside else 0
            return (inside or not held[p][1]) and not any(_side(k) and within[split[p][: i + 1]] < max(1, HOLDS * whole) for i, k in enumerate(split[p]) if i >= begin)

        found = [p for p in some if kept(p)]
        if found:
            template = sum(varies[p] for p in found) >= 2 * sum(sum(often[p].values()) for p in found)
            if not template:
                return {p: [] for p in found}
            varied = [p for p in found if varies[p] > sum(often[p].values())]

            def between(p: str) -> bool:
                """Whether a slot is a heading that slots of its own part which vary stand before and after, or of a part below the body that holds most of what varies."""
                at = next((i for i, k in enumerate(split[p]) if _name(k) in HEADINGS), None)
                if at is None:
                    return False
                part = split[p][:at]
                beside = [q for q in varied if split[q][:at] == part]
                after = any(order[q][1] > order[p][0] for q in beside)
                before = any(order[q][0] < order[p][1] for q in beside)
                own = part and _name(part[-1]) not in ("html", "body") and within[part] >= 0.5 * whole
                return after and bool(before or own)

            return {p: [] if between(p) else sorted(often[p]) for p in found}
    return {}


def _packed(nodes: list, pages: int) -> str:
    def plain(load):
        if isinstance(load, Texts):
            return [load.texts, load.chars, [[h, *x] for h, x in load.seen.items()]]
        return load if load is None else [plain(x) for x in load]

    return json.dumps([pages, [k for k, _ in nodes], [plain(x) for _, x in nodes]], separators=(",", ":"), ensure_ascii=False)


def _unpacked(text: str) -> tuple[list, int]:
    def key(x):
        return x if isinstance(x, str) else (x[0], tuple(map(key, x[1])))

    def load(k, x):
        if isinstance(k, str):
            return Texts(x[0], x[1], {h: [n, size] for h, n, size in x[2]}) if k[0] == SLOT else None
        return [load(a, b) for a, b in zip(k[1], x, strict=True)]

    pages, keys, loads = json.loads(text)
    keys = [key(k) for k in keys]
    return [(k, load(k, x)) for k, x in zip(keys, loads, strict=True)], pages


class _Host:
    """Streams of a host's pages: those of one form meet at once, forms are aligned when there are many and at the end."""

    def __init__(self):
        self.pages = 0
        self.forms: dict[tuple, list] = {}

    def add(self, nodes: list, pages: int) -> None:
        self.pages += pages
        form = tuple(k for k, _ in nodes)
        if form in self.forms:
            for (_, x), (_, y) in zip(self.forms[form], nodes, strict=True):
                _take(x, y, False)
        else:
            self.forms[form] = nodes
        if len(self.forms) > HELD_STREAMS:
            nodes = self.wrapper()
            self.forms = {tuple(k for k, _ in nodes): nodes}

    def wrapper(self) -> list:
        first, *others = (self.forms[f] for f in sorted(self.forms, key=lambda f: (-len(f), str(f))))
        for nodes in others:
            first = aligned(first, nodes)
        return first


@frugal
def _fold_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One wrapper for each host of a partition."""
    held: dict[str, _Host] = {}
    part = TaskContext.get().partitionId()

    def out() -> pa.RecordBatch:
        wrappers = [_packed(h.wrapper(), h.pages) for h in held.values()]
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([part] * len(held), pa.int64()), pa.array(wrappers, pa.string())], ["host", "part", "wrapper"])

    for batch in parts(batches):
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held.setdefault(host, _Host()).add(page_nodes(page or ""), 1)
        if len(held) > HELD_HOSTS:
            yield out()
            held = {}
    yield out()


def _met(wrappers: Iterable[str]) -> _Host:
    host = _Host()
    for text in sorted(wrappers):
        host.add(*_unpacked(text))
    return host


def _fold_group(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    host = _met(pdf["wrapper"])
    return pd.DataFrame({"host": [key[0]], "part": [key[1]], "wrapper": [_packed(host.wrapper(), host.pages)]})


def _rule_of_group(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    host = _met(pdf["wrapper"])
    return pd.DataFrame({"host": [key[0]], "rule": [json.dumps(article_rule(host.wrapper(), host.pages), ensure_ascii=False)]})


def host_of(url: str = "url"):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def infer_rules(pages: DataFrame) -> DataFrame:
    """host and rule (JSON of article_rule) from all pages: wrappers are aligned in each partition, then FAN at a time, so that no group grows with a host."""
    found = stored(pages.select(host_of().alias("host"), F.col("html")).mapInArrow(_fold_partition, "host string, part long, wrapper string"))
    width = (found.agg(F.max("part")).first()[0] or 0) + 1
    while width > FAN:
        width = -(-width // FAN)
        found = stored(found.groupBy("host", F.floor(F.col("part") / FAN).alias("part")).applyInPandas(_fold_group, "host string, part long, wrapper string"))
    return found.groupBy("host").applyInPandas(_rule_of_group, "host string, rule string")


def main_text(page: str, rule: dict[str, frozenset[int]] | None) -> str:
    """Text in the slots of a rule without its template; where the page has none of these slots, in those of its own wrapper."""
    events = list(placed(page))
    if rule is None or not any(k == "text" and not x.isspace() and ">".join(p) in rule for k, p, x in events):
        rule = {p: frozenset(h) for p, h in article_rule(page_nodes(page), 1).items()}
    blocks, block = [], []

    def end() -> None:
        if block and (text := " ".join(html.unescape("".join(block)).split())):
            blocks.append(text)
        block.clear()

    for kind, path, x in events:
        if kind == "text":
            template = rule.get(">".join(path))
            if template is not None and not (template and _text_hash(" ".join(x.split())) in template):
                block.append(x)
        elif kind == "empty" and x not in ("br", "hr"):
            pass
        elif x.split(" ", 1)[0] not in INLINE:
            end()
    end()
    return "\n".join(blocks)


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    Null or empty html gives empty text; pages without a host share one wrapper; repeated pages are read each. Broken
    markup is read as far as tags can be told. Very long pages are read whole; an empty table gives an empty result.
    Extra columns are ignored.
    """
    small_batches(pages.sparkSession)
    rules = stored(infer_rules(pages))
    size = rules.agg(F.sum(F.octet_length("rule") + F.octet_length("host"))).first()[0] or 0
    own = rules.withColumnRenamed("host", "of")
    rows = pages.select("page_id", "url", "html", host_of().alias("host")).join(F.broadcast(own) if size <= BROADCAST_BYTES else own, F.col("host") == F.col("of"), "left")

    @frugal
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict[str, frozenset[int]]] = {}
        for batch in parts(batches):
            out = []
            for page, rule in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if rule is not None and rule not in known:
                    if len(known) > HELD_HOSTS:
                        known.clear()
                    known[rule] = {p: frozenset(h) for p, h in json.loads(rule).items()}
                out.append(main_text(page or "", known.get(rule)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.select(F.col("page_id").cast("long"), "url", "html", "rule").mapInArrow(read, "page_id long, url string, text string, n_chars long")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
