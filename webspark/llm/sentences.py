"""Problem 9: sentence boundaries across languages and scripts.

Follows the standard sentence-break rules by character property (terminators of all scripts from
Unicode's Sentence_Break property, closing marks, following space, lower-case continuation), with
suppression after abbreviations of the text's language and with quotations kept inside the
sentence around them. Paragraphs, headings, list items and Thai spacing follow TESTDATA.md.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Abbreviations after which a name or a number follows; never the end of a sentence.
BEFORE_NAME = {
    "en": "dr mr mrs ms prof st mt sen rep gen col capt lt sgt rev hon messrs gov pres fr",
    "de": "dr hr fr prof st frl hrn",
    "fr": "m mm dr pr me st ste mgr",
    "es": "sr sra srta sres dr dra d dña ud uds prof profa lic ing",
    "ru": "г-н г-жа проф акад ул им гр тов",
    "el": "κ κκ κα δρ καθ αγ",
    "ar": "د أ م",
    "hi": "डॉ श्री सुश्री प्रो पं",
    "th": "ดร นพ พญ",
}
#: Abbreviations that end no sentence unless a capital opens the next word.
INSIDE = {
    "en": "etc vs cf approx min max sec hr ltd inc co corp jr sr dept est ave blvd jan feb mar apr jun jul aug sep sept oct nov dec",
    "de": "bzw usw ca evtl ggf inkl vgl sog etc zzgl abzgl str tel mio mrd",
    "fr": "env etc cf art ex av éd bd tél min max",
    "es": "aprox etc pág págs ej av cap tel núm avda",
    "ru": "г гг в вв д е п т с тыс млн млрд руб стр рис табл см др пр",
    "el": "π χ μ κ ο δηλ βλ κλπ αρ σελ",
}
#: Abbreviations before a number.
BEFORE_NUMBER = {
    "en": "no nos fig figs vol pp p ch sec eq vs v approx ca cf art par",
    "de": "nr abb s bd kap ca abs art ziff a vgl",
    "fr": "n no fig art env vol p pp chap cf",
    "es": "núm n no fig pág págs art cap vol aprox p",
    "ru": "рис стр табл гл п ст с см",
    "el": "αρ σελ εικ κεφ",
}
#: Languages whose ordinals are written as a number and a full stop.
ORDINALS = {"de"}

#: Terminators of all scripts, by character property.
_HARD = r"\p{Sentence_Break=STerm}\p{Sentence_Break=ATerm}"
_CLOSE = "\"'’”»›)\\]}」』〉》】〕〗〙）］｝｣‘“«‹*_~"
_TERMINATOR = regex.compile(f"[.…{_HARD};;]+")
_WIDE = frozenset("。！？｡．")
_LINE = regex.compile(r"\r\n|[\n\r\x0b\x0c\x85  ]")
_ITEM = regex.compile(r"[^\S\r\n]*(?:[-*+•‣▪◦·–—]|\(?\d{1,3}[.)]|\(?\p{L}\))[^\S\r\n]+\S")
_HEADING = regex.compile(r"[^\S\r\n]*#{1,6}[^\S\r\n]+\S")
_BLANK = regex.compile(r"[\s\p{Cf}]*")
_NEXT = regex.compile(r"[\s\p{Cf}]*([\p{Ps}\p{Pi}\p{Pd}\"'¿¡*_«»„“‘‚\s]*)(.?)", regex.S)
_WORD_BEFORE = regex.compile(r"(?r)[\p{L}\p{M}\p{N}\-]+")
_DOTTED = regex.compile(r"(?r)(?:\p{L}\.\s?)+\p{L}")
_THAI = regex.compile(r"(?<=\p{Thai})\s+(?=\p{Thai})")
_THAI_LETTER = regex.compile(r"\p{Thai}")
_PAIRS = {"«": "»", "“": "”", "「": "」", "『": "』", "„": "“", "‘": "’", "‹": "›", "‚": "‘", "《": "》", "〈": "〉", "（": "）", "(": ")", "【": "】", "[": "]"}
_QUOTE_MARK = regex.compile("[" + regex.escape("".join(_PAIRS) + "".join(_PAIRS.values()) + "\"'") + "]")
_CASELESS = regex.compile(r"[\p{Lo}\p{Lm}]")
_CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]")


def language_of(lang: str | None, text: str) -> str:
    """The language whose abbreviations apply: the script decides, the label only among languages
    of the Latin script (there by its first letters; unknown or missing labels by frequent words)."""
    other = _OTHER_SCRIPT.search(text)
    latin = sum(map(len, _SCRIPTS["Latin"].findall(text))) if other else 0
    for script, code in _BY_SCRIPT if other else ():
        hits = sum(map(len, _SCRIPTS[script].findall(text)))
        if hits and hits * 4 >= latin:
            return code
    count = dict.fromkeys(_COMMON, 0)
    for word in _FREQUENT.findall(text.lower()):
        for code in _LANGUAGES_OF.get(word, ()):
            count[code] += 1
    best = max(count, key=lambda c: (count[c], c == "en"))
    if count[best]:
        return best
    code = regex.split(r"[^a-z]", (lang or "").strip().lower())[0]
    return code if code in _COMMON else "en"


_BY_SCRIPT = (("Cyrillic", "ru"), ("Greek", "el"), ("Arabic", "ar"), ("Devanagari", "hi"), ("Thai", "th"), ("Hiragana", "ja"), ("Han", "zh"))
_SCRIPTS = {s: regex.compile(rf"\p{{{s}}}+") for s in ("Cyrillic", "Greek", "Arabic", "Devanagari", "Thai", "Hiragana", "Han", "Latin")}
_OTHER_SCRIPT = regex.compile("[" + "".join(rf"\p{{{s}}}" for s, _ in _BY_SCRIPT) + "]")
_FREQUENT = regex.compile(r"\p{L}+")
#: Very frequent words, to tell Latin-script languages apart.
_COMMON = {
    "en": frozenset("the of and to in a is was that it for on with as by".split()),
    "de": frozenset("der die das und in den von zu mit ist im nicht ein eine auf wurden".split()),
    "fr": frozenset("le la les de des et en un une du est que qui dans pour ses".split()),
    "es": frozenset("el la los las de y en un una del es que se por con para".split()),
}
_LANGUAGES_OF = {w: [c for c, own in _COMMON.items() if w in own] for w in frozenset().union(*_COMMON.values())}


def _sets(lang: str) -> tuple[frozenset, frozenset, frozenset]:
    if lang not in _CACHE:
        _CACHE[lang] = tuple(frozenset(table.get(lang, "").split()) for table in (BEFORE_NAME, INSIDE, BEFORE_NUMBER))
    return _CACHE[lang]


_CACHE: dict[str, tuple] = {}


def _quoted(text: str) -> list[tuple[int, int]]:
    """Spans of closed quotations and brackets of a paragraph, outermost only, ends exclusive.

    One pass: a closing mark meets the last mark it can close, and what was opened after that one and
    not closed opens nothing, like a mark that is never closed. Each mark is put on the stack and
    taken off once, whatever the number of open ones.
    """
    closed: list[tuple[int, int]] = []
    stack: list[tuple[str, int]] = []
    waiting: dict[str, int] = {}
    n = len(text)
    for m in _QUOTE_MARK.finditer(text):
        i, c = m.start(), m[0]
        inside = 0 < i < n - 1 and text[i - 1].isalnum() and text[i + 1].isalnum()
        if waiting.get(c) and not (c in "’'" and inside):
            while True:
                wanted, start = stack.pop()
                waiting[wanted] -= 1
                if wanted == c:
                    break
            closed.append((start, i + 1))
        elif c in _PAIRS or c == '"' or (c == "'" and i + 1 < n and text[i + 1].isalnum() and not (i and text[i - 1].isalnum())):
            if c == "‘" and inside:
                continue
            wanted = _PAIRS.get(c, c)
            stack.append((wanted, i))
            waiting[wanted] = waiting.get(wanted, 0) + 1
    spans: list[tuple[int, int]] = []
    for a, b in sorted(closed):
        if not spans or a >= spans[-1][1]:
            spans.append((a, b))
    return spans


@lru_cache(1 << 13)
def _is_cjk(char: str) -> bool:
    return bool(_CJK.match(char))


@lru_cache(1 << 12)
def _mark_kind(mark: str) -> tuple[bool, bool, bool, bool]:
    """Of a run of terminators: only semicolons, only dots, one that needs no blank, only ellipses."""
    signs = set(mark)
    return signs <= {";", "\u037e"}, signs <= {".", "…"}, bool(signs & _WIDE), signs == {"…"}


def _ends_sentence(text: str, start: int, end: int, after: int, lang: str) -> bool:
    """Whether the terminator text[start:end], whose closing marks end at ``after``, ends a sentence."""
    mark = text[start:end]
    rest = _NEXT.match(text, after)
    nxt, openers = rest[2], rest[1]
    spaced = after >= len(text) or text[after].isspace() or text[after] in "​﻿"
    before = text[start - 1] if start else ""
    if not nxt and not openers.strip():
        return True
    semicolon, only_dots, wide, ellipsis = _mark_kind(mark)
    if semicolon:
        return lang == "el" and spaced and not nxt.islower()
    wide = wide or (not only_dots and _is_cjk(before or " "))
    if not spaced and not wide:
        # blanks may be missing: only letters of different sentences, never names with dots
        if only_dots:
            if mark != "." or not before or not nxt.isupper() or openers:
                return mark == "." and _is_cjk(before or " ") and _is_cjk(nxt or " ")
            word = _WORD_BEFORE.search(text, 0, start)
            return bool(word and len(word[0]) > 1 and word[0].islower() and "." not in text[max(0, word.start() - 1) : word.start()])
        return nxt.isupper() or bool(openers.strip()) or (bool(_CASELESS.match(nxt or " ")))
    if nxt.islower():
        return False
    if ellipsis and _is_cjk(before or " "):
        return False
    if only_dots and len(mark) == 1 and mark == "." and after == end:
        word = _WORD_BEFORE.search(text, 0, start)
        if word and word.end() == start:
            name, inside, number = _sets(lang)
            w = word[0].lower()
            if w in name:
                return False
            if nxt.isnumeric() and (w in number or w in inside):
                return False
            if w.isnumeric():
                if lang in ORDINALS and len(w) <= 2 and nxt.isalpha():
                    return False
            elif len(w) == 1 and w.isalpha():
                if _LETTER_DOT.match(text, rest.start(2)):
                    return False  # z. B., J. K.
                if word[0].isupper():  # an initial, or the last letter of U.S.
                    dotted = _DOTTED.search(text, max(0, start - 12), start)
                    chain = dotted and "." in dotted[0] and " " not in dotted[0]
                    return bool(chain and lang == "en" and nxt.isupper() and _opens(text, rest.start(2)))
                if _CASELESS.match(w):
                    return False
                dotted = _DOTTED.search(text, max(0, start - 12), start)
                if dotted and "." in dotted[0]:
                    tail = dotted[0].replace(" ", "").lower()
                    if tail in _NEVER:
                        return False
    return True


#: Dotted abbreviations that always lead on.
_NEVER = frozenset(["e.g", "i.e", "z.b", "d.h", "u.a", "p.ex", "p.ej", "т.е", "π.χ", "o.ä", "v.a"])
_LETTER_DOT = regex.compile(r"\p{L}\.")
#: English words of closed classes, which no name after a dotted abbreviation begins with.
_OPENS = frozenset(
    """a an the this that these those each every either neither both all any some no none many much most more few fewer several
    another other such enough half
    i you he she it we they one my your his her its our their mine yours hers ours theirs there here
    somebody someone something anybody anyone anything nobody nothing everybody everyone everything
    what who whom whose which when where why how whatever whoever whichever whenever wherever however
    about above across after against along although amid among and around as at because before behind below beneath beside
    besides between beyond but by despite down during except for from if in inside into like near nor of off on once onto or
    out outside over past per since so than though through throughout till to toward towards under underneath unless unlike
    until up upon via whereas whether while with within without yet
    am is are was were be been being do does did have has had can could may might must shall should will would
    not never always often sometimes usually rarely seldom again also even just only still then now soon later earlier today
    yesterday tomorrow meanwhile moreover therefore thus hence instead nevertheless nonetheless otherwise perhaps maybe
    finally eventually recently afterwards indeed""".split()
)
_CAPITAL_NEXT = regex.compile(r"\s+\p{Lu}")
_WORD_AT = regex.compile(r"\p{L}[\p{L}\p{M}'’]*")


@lru_cache(2)
def _words_as_written(text: str) -> frozenset[str]:
    return frozenset(_RUN.findall(text))


_RUN = regex.compile(r"[\p{L}\p{N}]+")


def _opens(text: str, at: int) -> bool:
    """Whether the capitalised word at a position begins a sentence: it is of a closed class, or the
    text has it in lower case elsewhere, so that it is no name. Else it goes on (U.S. Senate)."""
    m = _WORD_AT.match(text, at)
    if not m:
        return False
    low = regex.split("['’]", m[0].lower())[0]
    if low in _OPENS:
        return True
    titled = _CAPITAL_NEXT.match(text, m.end())  # State Department
    return len(low) > 1 and not titled and low in _words_as_written(text)


def _paragraph(text: str, base: int, lang: str, out: list[tuple[int, int]]) -> None:
    """Units of a stretch of sentences without blank lines, headings or list items."""
    quoted = _quoted(text)
    cuts, at, q = [], 0, 0
    begin = 0  # of the current sentence
    n = len(text)
    while True:
        m = _TERMINATOR.search(text, at)
        if not m:
            break
        start, end = m.span()
        while q < len(quoted) and quoted[q][1] <= start:
            q += 1
        if q < len(quoted) and quoted[q][0] < start:
            # inside a quotation: nothing ends before it closes, and then only if its last mark is one
            a, b = quoted[q]
            at = b
            last = _BEFORE_CLOSE.search(text, a, b)
            if not last:
                continue
            after = _closers(text, b)
            if _after_quote(text, a, b, last.start(1), last.end(1), after, lang, begin):
                cuts.append(after)
                at = begin = after
            else:
                at = max(b, at)
            continue
        at = end
        after = _closers(text, end)
        # a quotation may open right behind the mark; its opening sign isn't a closing one
        if after > end and q < len(quoted):
            for a, b in quoted[q : q + 3]:
                if end <= a < after:
                    after = a
        if _ends_sentence(text, start, end, after, lang):
            cuts.append(after)
            at = begin = max(after, end)
    if _THAI_LETTER.search(text):
        cuts += [m.start() for m in _THAI.finditer(text)]
    prev = 0
    for c in [*sorted(set(cuts)), n]:
        _unit(text, prev, c, base, out)
        prev = c


_BEFORE_CLOSE = regex.compile(rf"(?r)([.…{_HARD};;]+)[\s{_CLOSE}]*")


def _closers(text: str, at: int) -> int:
    """The end of closing marks that follow a position, blanks before a French closing mark too."""
    n = len(text)
    while at < n:
        c = text[at]
        if c in _CLOSERS or (c in "\"'" and (at + 1 >= n or not text[at + 1].isalnum())):
            at += 1
        elif c in "   " and at + 1 < n and text[at + 1] in "»›":
            at += 2
        else:
            break
    return at


_CLOSERS = frozenset("’”»›)]}」』〉》】〕〗〙）］｝｣“")


def _after_quote(text: str, a: int, b: int, ms: int, me: int, after: int, lang: str, begin: int) -> bool:
    """Whether a sentence ends with the quotation text[a:b], whose last mark is text[ms:me]."""
    if text[me:b].strip("   " + "".join(_CLOSERS) + "\"'*_"):
        return False  # the last mark isn't at the end of the quotation
    rest = _NEXT.match(text, after)
    nxt, openers = rest[2], rest[1]
    if not nxt and not openers.strip():
        return True
    if nxt.islower() or nxt in ",;:،؛，；：、.!?。！？…":
        return False
    bracket = text[a] in "([（【"
    if bracket and not _BLANK.fullmatch(text, begin, a):
        return False
    if _CASELESS.match(nxt):
        opened = bool(_BLANK.fullmatch(text, begin, a))
        if _CJK.match(nxt):
            if opened and not bracket:
                return False  # the speaker follows
            if nxt in "とってのがはをにも" and text[a] in "「『":
                return False
            return True
        return not opened or bracket
    if openers.strip() and openers.strip()[0] in "—–-" and not nxt.isupper():
        return False
    return after >= len(text) or text[after].isspace() or nxt.isupper()


def _unit(text: str, a: int, b: int, base: int, out: list[tuple[int, int]]) -> None:
    a = _BLANK.match(text, a, b).end()
    while b > a and (text[b - 1].isspace() or text[b - 1] in "﻿​⁠"):
        b -= 1
    if b > a:
        out.append((base + a, base + b))


def sentence_spans(text: str | None, lang: str | None = None) -> list[tuple[int, int]]:
    """(start, end) of every unit of a text, in code points, end exclusive, no blanks around.

    Null, empty and blank texts have none. A blank line always ends a unit; a heading or a list
    item with its marker is one; elsewhere a line break is a blank like others.
    """
    if not text:
        return []
    code = language_of(lang, text)
    out: list[tuple[int, int]] = []
    lines, at = [], 0
    for m in _LINE.finditer(text):
        lines.append((at, m.start()))
        at = m.end()
    lines.append((at, len(text)))
    block: list[tuple[int, int]] = []
    kind = ""

    def flush() -> None:
        nonlocal kind
        if block:
            a, b = block[0][0], block[-1][1]
            if kind == "text":
                _paragraph(text[a:b], a, code, out)
            else:
                _unit(text, a, b, 0, out)
        block.clear()
        kind = ""

    for a, b in lines:
        if _BLANK.fullmatch(text, a, b):
            flush()
        elif _HEADING.match(text, a, b):
            flush()
            _unit(text, a, b, 0, out)
        elif _ITEM.match(text, a, b) and (kind != "text" or not block or _item_may_start(text, block, a, b)):
            flush()
            block.append((a, b))
            kind = "item"
        elif kind == "item" and _ended(text, *block[-1]):
            flush()
            block.append((a, b))
            kind = "text"
        else:
            block.append((a, b))
            kind = kind or "text"
    flush()
    return out


_DASH = regex.compile(r"[^\S\r\n]*[–—][^\S\r\n]")


def _item_may_start(text: str, block: list[tuple[int, int]], a: int, b: int) -> bool:
    """Whether a marker inside running lines opens a list: not where a line was merely wrapped
    before a dash or a number."""
    return not _DASH.match(text, a, b) and (_ended(text, *block[-1]) or text[block[-1][1] - 1] in ":：" or not _ITEM_NUMBER.match(text, a, b))


_ITEM_NUMBER = regex.compile(r"[^\S\r\n]*\(?\d{1,3}[.)]")
_END = regex.compile(rf"(?r)[.…{_HARD};;][\s\p{{Cf}}{_CLOSE}]*")


def _ended(text: str, a: int, b: int) -> bool:
    m = _END.search(text, a, b)
    return bool(m and m.end() == b)


def split_sentences(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """(id, start_pos, end_pos), one row for each unit of each text.

    A narrow map over Arrow batches, then an explode: no shuffle. Null and blank texts give no rows;
    repeated rows give their units again; further columns are ignored whatever their names.
    """

    @F.arrow_udf("array<struct<start_pos:bigint,end_pos:bigint>>")
    def spans(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, langs in batches:
            found = [sentence_spans(t, l) for t, l in zip(texts.to_pylist(), langs.to_pylist())]
            flat = np.array(list(chain.from_iterable(found)), np.int64).reshape(-1, 2)
            ends = np.cumsum([0, *map(len, found)], dtype=np.int64)
            pairs = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["start_pos", "end_pos"])
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)

    lang = F.col(lang_col) if lang_col else F.lit(None).cast("string")
    return (
        df.where(F.col(text_col).isNotNull())
        .select(F.col(id_col).alias("ws_id"), F.explode(spans(F.col(text_col), lang.cast("string"))).alias("u"))
        .select(F.col("ws_id").alias(id_col), "u.start_pos", "u.end_pos")
    )


def sentence_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """(id, sentence_no, sentence): the units of each text themselves, numbered from 1."""

    @F.arrow_udf("array<string>")
    def units(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, langs in batches:
            yield pa.array([[t[a:b] for a, b in sentence_spans(t, l)] for t, l in zip(texts.to_pylist(), langs.to_pylist())], pa.list_(pa.string()))

    lang = F.col(lang_col) if lang_col else F.lit(None).cast("string")
    return (
        df.where(F.col(text_col).isNotNull())
        .select(F.col(id_col).alias("ws_id"), F.posexplode(units(F.col(text_col), lang.cast("string"))).alias("pos", "sentence"))
        .select(F.col("ws_id").alias(id_col), (F.col("pos") + 1).alias("sentence_no"), "sentence")
    )
