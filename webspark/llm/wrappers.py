"""Problem 3: page boilerplate mixed with main content.

Wrappers by union-free regular expressions. Pages become streams of line tokens (markup and text).
Texts that stand on many pages of a site, or on pages of several sites once the site's own name is
masked, are constants. The streams of a site are aligned one after the other with its wrapper: a
token both have is matched, one that only some pages have becomes optional, a run of the same token
becomes a repeated group, and text that differs becomes a slot of its markup, or, where its first
word stays the same, a slot behind a constant. Partial wrappers of bounded groups of pages are made
first and aligned with each other, so a hot site never meets in one task. What a page matches to
constants, to slots before the title, to link groups into the site and to slots behind constants is
boilerplate; the other slots are the main body.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webspark.io import materialize
from webspark.llm.words import LINK, WORD

#: A text is a constant of a site on so many of its pages (a quarter of them where that is less, but
#: no fewer than the second number), or on pages of so many sites.
SITE_PAGES, LEAST_PAGES, SITES = 8, 4, 6
#: A leading word that is a constant on so many sites is one on all.
LEAD_SITES = 2
#: Pages aligned in one group before the wrappers themselves are aligned.
GROUP_PAGES = 400
#: Partial wrappers of a site aligned in one step.
FAN = 64
#: Pages with no more words than this are a notice, not a page of the template.
NOTICE_WORDS = 40

#: Token kinds by markup and form; slots take the kind's number as their symbol.
TITLE, HEADING, ITEM, STARRED, INNER_LINK, OUTER_LINK, TABLE, QUOTE, SENTENCE, PHRASE = range(10)
#: Symbols of slots: the kind, 16 more before the title, 32 more behind a constant.
BEFORE, BEHIND = 16, 32

_CODE = regex.compile(r"^\s*```")
_EMPHASIS = " *_…»>→-–—↗›|\t"
_ENDED = regex.compile(r"[.!?。！？…][\"'”’»)\]*_\s]*$")
_LETTERS = regex.compile(r"\P{L}+")


def page_site(url: Column) -> Column:
    """The site of an address: the last two labels of its cleaned host; null if there is none."""
    clean = F.lower(F.regexp_replace(url, r"[\s\p{Z}\p{Cc}\p{Cf}]+", ""))
    site = F.regexp_extract(clean, r"^[^:/?#]*://(?:[^/?#@]*@)?(?:[^/?#:]*\.)?([^/?#:.]+\.[^/?#:.]+)(?:[:/?#]|$)", 1)
    return F.when(site != "", site)


def _hash(text: str) -> int:
    # symbols under 64 are slots
    return xxhash.xxh3_64_intdigest(text) >> 1 | 64


def _inner(target: str, site: str) -> bool:
    if target.startswith(("/", "#", "?", ".")) and not target.startswith("//"):
        return True
    m = target.lower().split("://", 1)[-1].lstrip("/").split("/", 1)[0].split(":")[0]
    return m == site or m.endswith("." + site)


def line_tokens(markdown: str, site: str) -> list[tuple[int, int, int, int, bool]]:
    """(line_no, kind, constant symbol, lead symbol, before the title) of each line that is no blank
    and no code. The lead is the first word of a phrase, or the first two of a sentence that names the
    site; 0 for other lines. Pages of NOTICE_WORDS words or fewer have none."""
    if len(WORD.findall(markdown[:2000])) <= NOTICE_WORDS and len(WORD.findall(markdown)) <= NOTICE_WORDS:
        return []
    name = "".join(c for c in site.rsplit(".", 1)[0] if c.isalpha())
    out: list[tuple[int, int, int, int, bool]] = []
    lines = markdown.split("\n")
    title = next((i for i, l in enumerate(lines) if l.lstrip().startswith("# ")), -1)
    fences = [i for i, l in enumerate(lines) if _CODE.match(l)]
    code = set()
    for a, b in zip(fences[0::2], fences[1::2]):
        code.update(range(a, b + 1))
    for i, line in enumerate(lines):
        s = line.strip()
        if not s or i in code:
            continue
        text, linked = s, False
        if "](" in s:
            found = LINK.findall(s)
            rest = LINK.sub("", s)
            linked = bool(found) and not WORD.search(rest)
            text = LINK.sub(r"\1", s)
        letters = _LETTERS.sub("", text.lower())
        if name and len(name) > 3:
            letters = letters.replace(name, "\x01")
        lead = ""
        named = "\x01" in letters
        if i == title:
            kind = TITLE
        elif linked:
            kind = INNER_LINK if all(_inner(t, site) for _, t in found) else OUTER_LINK
        elif s.startswith("#"):
            kind = HEADING
        elif s.startswith("- "):
            kind = ITEM
        elif s.startswith("* "):
            kind = STARRED
        elif s.startswith("|"):
            kind = TABLE
        elif s.startswith(">"):
            kind = QUOTE
        elif _ENDED.search(text.rstrip(_EMPHASIS)):
            kind = SENTENCE
            if named:
                lead = " ".join(w.lower() for w in WORD.findall(text)[:2])
        else:
            kind = PHRASE
            m = WORD.search(text)
            lead = ("←" if text.lstrip(" *_").startswith("←") else "") + (m[0].lower() if m else "")
        out.append((i + 1, kind, _hash(letters) if letters else 0, _hash("lead " + lead) if lead else 0, i < title))
    return out


def token_table(pages: DataFrame) -> DataFrame:
    """(site, id, line_no, kind, text, lead, before, new_text, new_lead): the tokens of all pages;
    new_... mark the first place of a text or lead on its page. pages: id, url, markdown."""
    kind = pages.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows, take = [], []
                for r, (site, text) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist())):
                    seen: set[int] = set()
                    for n, k, key, lead, before in line_tokens(text, site):
                        rows.append((n, k, key, lead, before, key not in seen, lead not in seen))
                        seen.add(key)
                        seen.add(lead)
                        take.append(r)
                if rows:
                    n, k, key, lead, before, first, new = zip(*rows)
                    take = pa.array(take)
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column(1).take(take), part.column(0).take(take), pa.array(n, pa.int64()), pa.array(k, pa.int32()), pa.array(key, pa.int64()),
                            pa.array(lead, pa.int64()), pa.array(before, pa.bool_()), pa.array(first, pa.bool_()), pa.array(new, pa.bool_()),
                        ],
                        ["site", "id", "line_no", "kind", "text", "lead", "before", "new_text", "new_lead"],
                    )

    schema = f"site string, id {kind}, line_no bigint, kind int, text bigint, lead bigint, before boolean, new_text boolean, new_lead boolean"
    return pages.where("markdown is not null").select(page_site(F.col("url")).alias("site"), "id", "markdown").where("site is not null").select("id", "site", "markdown").mapInArrow(run, schema)


def constants(tokens: DataFrame) -> DataFrame:
    """(site, symbol): texts and leads that are constants of a site. Counting is by site first, so a
    text on a third of all pages reaches the shuffle as one row per map task."""
    n_pages = tokens.select("site", "id").distinct().groupBy("site").agg(F.count(F.lit(1)).alias("pages"))
    enough = F.greatest(F.lit(LEAST_PAGES), F.least(F.lit(SITE_PAGES), F.ceil(F.col("pages") / 4)))
    texts = tokens.where(f"new_text and text <> 0 and kind <> {TITLE}").groupBy("site", "text").agg(F.count(F.lit(1)).alias("n"))
    leads = tokens.where("new_lead and lead <> 0").groupBy("site", "lead").agg(F.count(F.lit(1)).alias("n"))
    shared = texts.groupBy("text").agg(F.count(F.lit(1)).alias("sites")).where(F.col("sites") >= SITES).select("text", F.lit(True).alias("shared"))
    ours = texts.join(shared, "text", "left").join(n_pages, "site").where(F.col("shared") | (F.col("n") >= enough)).select("site", F.col("text").alias("symbol"))
    # a lead that is a constant of several sites is one of all
    own = leads.join(n_pages, "site").withColumn("enough", F.col("n") >= enough)
    common = own.where("enough").groupBy("lead").agg(F.count(F.lit(1)).alias("sites")).where(F.col("sites") >= LEAD_SITES).select("lead", F.lit(True).alias("shared"))
    led = own.join(common, "lead", "left").where(F.col("enough") | F.col("shared")).select("site", F.col("lead").alias("symbol"))
    return ours.unionByName(led)


class Wrapper:
    """A union-free regular expression over symbols: an order, and for each symbol the pages that
    have it, those that repeat it, and its places before the title."""

    def __init__(self) -> None:
        self.order: list[int] = []
        self.place: dict[int, int] = {}
        self.stats: dict[int, list[int]] = {}
        self.pages = 0

    def align(self, symbols: list[int], stats: dict[int, list[int]], pages: int) -> None:
        """Match a sequence of distinct symbols by a longest common subsequence; symbols it lacks are
        put in as optional ones behind the match before them."""
        known = [(i, self.place[s]) for i, s in enumerate(symbols) if s in self.place]
        keep = _rising([p for _, p in known])
        matched = {known[k][0] for k in keep}
        fresh, at = False, -1
        inserts: list[tuple[int, int]] = []
        for i, s in enumerate(symbols):
            if i in matched:
                at = self.place[s]
            elif s not in self.place:
                inserts.append((at, s))
                fresh = True
        if fresh:
            behind: dict[int, list[int]] = {}
            for p, s in inserts:
                behind.setdefault(p, []).append(s)
            order = list(behind.get(-1, ()))
            for p, s in enumerate(self.order):
                order.append(s)
                order += behind.get(p, ())
            self.order = order
            self.place = {s: p for p, s in enumerate(order)}
        for s, add in stats.items():
            have = self.stats.setdefault(s, [0, 0, 0])
            for i in range(3):
                have[i] += add[i]
        self.pages += pages


def _rising(values: list[int]) -> list[int]:
    """Positions of a longest increasing subsequence."""
    tails: list[int] = []
    where: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        back[i] = where[k - 1] if k else -1
        if k == len(tails):
            tails.append(v)
            where.append(i)
        else:
            tails[k], where[k] = v, i
    out, i = [], where[-1] if where else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def page_symbols(kind: list[int], text: list[int], lead: list[int], before: list[bool], constant: list[bool], led: list[bool]) -> list[int]:
    """The symbol of each token of a page: its constant, its leading constant, or a slot."""
    out = []
    behind = False
    for k, t, l, b, c, h in zip(kind, text, lead, before, constant, led):
        if k == TITLE:
            s, behind = TITLE, False
        elif c:
            s, behind = t, True
        elif h:
            s, behind = l, True
        else:
            if k not in (STARRED, INNER_LINK):
                behind = False
            s = k + (BEFORE if b else 0) + (BEHIND if behind else 0)
        out.append(s)
    # a starred run that comes to a constant is one repeated group, whichever item is constant
    behind = False
    for i in range(len(out) - 1, -1, -1):
        if kind[i] in (STARRED, INNER_LINK):
            if out[i] >= 64:
                behind = True
            elif behind and not out[i] & BEHIND:
                out[i] += BEHIND
        else:
            behind = False
    return out


def _node_rows(site: str, part: int, w: Wrapper) -> list[tuple]:
    return [(site, part, s, p, *w.stats[s], w.pages) for p, s in enumerate(w.order)]


_NODE_FIELDS = [
    ("site", pa.string()), ("part", pa.int32()), ("symbol", pa.int64()), ("place", pa.int32()),
    ("n_pages", pa.int64()), ("n_repeated", pa.int64()), ("n_before", pa.int64()), ("total", pa.int64()),
]
_NODE_SCHEMA = "site string, part int, symbol bigint, place int, n_pages bigint, n_repeated bigint, n_before bigint, total bigint"


def _aligned(table: pa.Table) -> pa.Table:
    """Of a group of pages of one site: their tokens with symbols, and their partial wrapper (rows
    with a place). Rows that share an id are taken as one page."""
    order = table.sort_by([("id", "ascending"), ("line_no", "ascending")])
    ids = order.column("id").to_pylist()
    names = ("kind", "text", "lead", "before", "constant", "led")
    columns = {c: order.column(c).to_pylist() for c in names}
    site, part = order.column("site")[0].as_py(), order.column("part")[0].as_py()
    w = Wrapper()
    symbols: list[int] = []
    at = 0
    while at < len(ids):
        end = at + 1
        while end < len(ids) and ids[end] == ids[at]:
            end += 1
        page = page_symbols(*(columns[c][at:end] for c in names))
        symbols += page
        stats: dict[int, list[int]] = {}
        for s, b in zip(page, columns["before"][at:end]):
            if s in stats:
                stats[s][1] = 1
                stats[s][2] += b
            else:
                stats[s] = [1, 0, int(b)]
        w.align(list(stats), stats, 1)
        at = end
    n, nodes = len(ids), _node_rows(site, part, w)
    lines = {"site": [site] * n, "symbol": symbols}
    out = {f: pa.array([*lines.get(f, [None] * n), *(row[k] for row in nodes)], t) for k, (f, t) in enumerate(_NODE_FIELDS)}
    gap = pa.nulls(len(nodes), order.schema.field("id").type)
    out["id"] = pa.concat_arrays([order.column("id").combine_chunks(), gap])
    out["line_no"] = pa.array([*order.column("line_no").to_pylist(), *[None] * len(nodes)], pa.int64())
    return pa.table(out)


def _merged(table: pa.Table) -> pa.Table:
    """Of partial wrappers of one site, told apart by part: the wrapper they align to, as part "up"."""
    rows = table.sort_by([("part", "ascending"), ("place", "ascending")]).to_pylist()
    w = Wrapper()
    at = 0
    while at < len(rows):
        end = at
        while end < len(rows) and rows[end]["part"] == rows[at]["part"]:
            end += 1
        one = rows[at:end]
        w.align([r["symbol"] for r in one], {r["symbol"]: [r["n_pages"], r["n_repeated"], r["n_before"]] for r in one}, one[0]["total"])
        at = end
    nodes = _node_rows(rows[0]["site"], rows[0]["up"], w)
    return pa.table({f: pa.array([r[k] for r in nodes], t) for k, (f, t) in enumerate(_NODE_FIELDS)})


def infer(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tokens, wrappers). tokens: site, id, line_no, symbol. wrappers: site, place, symbol, n_pages,
    n_repeated, n_before, total - one row a node, in order; optional where n_pages < total."""
    kind = pages.schema["id"].dataType.simpleString()
    tokens = materialize(token_table(pages), "p3-tokens")
    known = materialize(constants(tokens), "p3-constants")
    texts = known.select("site", F.col("symbol").alias("text"), F.lit(True).alias("constant"))
    leads = known.select("site", F.col("symbol").alias("lead"), F.lit(True).alias("led"))
    groups = tokens.select("site", "id").distinct().groupBy("site").agg(F.ceil(F.count(F.lit(1)) / GROUP_PAGES).cast("int").alias("groups"))
    groups = materialize(groups, "p3-groups")
    phrases = tokens.where("lead <> 0").join(leads, ["site", "lead"], "left")
    others = tokens.where("lead = 0").withColumn("led", F.lit(None).cast("boolean"))
    marked = (
        phrases.unionByName(others).join(texts, ["site", "text"], "left").join(groups, "site")
        .select(
            "site", F.pmod(F.xxhash64("id"), F.col("groups")).cast("int").alias("part"), "id", "line_no", "kind", "text", "lead", "before",
            F.coalesce("constant", F.lit(False)).alias("constant"), F.coalesce("led", F.lit(False)).alias("led"),
        )
    )
    aligned = materialize(marked.groupBy("site", "part").applyInArrow(_aligned, f"{_NODE_SCHEMA}, id {kind}, line_no bigint"), "p3-aligned")
    nodes = aligned.where("place is not null").drop("id", "line_no")
    most = groups.agg(F.max("groups")).first()[0] or 1
    while most > 1:
        nodes = materialize(nodes.withColumn("up", F.floor(F.col("part") / FAN).cast("int")).groupBy("site", "up").applyInArrow(_merged, _NODE_SCHEMA), "p3-nodes")
        most = -(-most // FAN)
    return aligned.where("line_no is not null").select("site", "id", "line_no", "symbol"), nodes.drop("part")


def outside_lines(pages: DataFrame) -> DataFrame:
    """(id, line_no) of every line that is boilerplate; pages: id, url, markdown.

    Read off the node of the site's wrapper that a line matches: constants and slots behind a
    leading constant, slots before the title, groups of links into the site and starred items that
    run together with a constant. Blank lines and code are never reported. Pages without markdown or
    without a host have no wrapper and nothing outside; notices of NOTICE_WORDS words or fewer are
    all body; rows that share an id are taken as one page.
    """
    tokens, wrappers = infer(pages.select("id", "url", "markdown"))
    symbol = F.col("symbol")
    kind = symbol.bitwiseAND(F.lit(15))
    fixed = symbol >= 64
    early = (symbol < 64) & (symbol.bitwiseAND(F.lit(BEFORE)) != 0) & (2 * F.col("n_before") > F.col("n_pages"))
    group = (symbol < 64) & ((kind == INNER_LINK) | ((kind == STARRED) & (symbol.bitwiseAND(F.lit(BEHIND)) != 0)))
    outer = wrappers.where((symbol != TITLE) & (fixed | early | group)).select("site", "symbol")
    return tokens.join(outer, ["site", "symbol"], "left_semi").select("id", "line_no").distinct()


def main_bodies(pages: DataFrame) -> DataFrame:
    """``pages`` with markdown reduced to the main body and ``n_outside``; the kept lines stay in
    order, further columns stay, a column n_outside of the input is replaced. Null and empty
    markdown come out as they were."""
    drop = outside_lines(pages).groupBy(F.col("id").alias("ws_id")).agg(F.collect_set("line_no").alias("ws_drop"))
    joined = pages.drop("n_outside").join(drop, F.col("id") == F.col("ws_id"), "left")
    kept = F.array_join(F.filter(F.split("markdown", "\n"), lambda x, i: ~F.array_contains(F.col("ws_drop"), (i + 1).cast("bigint"))), "\n")
    return (
        joined.withColumn("markdown", F.when(F.col("ws_drop").isNull(), F.col("markdown")).otherwise(kept))
        .withColumn("n_outside", F.coalesce(F.size("ws_drop"), F.lit(0)).cast("bigint"))
        .drop("ws_id", "ws_drop")
    )


def wrapper_expressions(wrappers: DataFrame) -> DataFrame:
    """(site, expression, n_nodes, n_pages): each site's wrapper as text. A constant is c and its
    number, a slot its kind; ? marks what only some pages have, + what repeats."""
    names = F.create_map(*[x for i, n in enumerate("TITLE HEADING ITEM STARRED INNER OUTER TABLE QUOTE SENTENCE PHRASE".split()) for x in (F.lit(i), F.lit(n))])
    slot = F.element_at(names, F.col("symbol").bitwiseAND(F.lit(15)).cast("int"))
    node = F.concat(
        F.when(F.col("symbol") >= 64, F.concat(F.lit("c"), F.pmod("symbol", F.lit(10000)))).otherwise(slot),
        F.when(F.col("n_repeated") > 0, "+").otherwise(""), F.when(F.col("n_pages") < F.col("total"), "?").otherwise(""),
    )
    listed = wrappers.select("site", "total", F.struct("place", node.alias("node")).alias("n")).groupBy("site").agg(F.sort_array(F.collect_list("n")).alias("nodes"), F.max("total").alias("n_pages"))
    return listed.select("site", F.array_join(F.transform("nodes", lambda x: x["node"]), " ").alias("expression"), F.size("nodes").alias("n_nodes"), "n_pages")
