"""Problem 10: sentence boundaries across languages and scripts, by document-centred disambiguation.

A full stop is ambiguous after an abbreviation, an initial or a number. What the word before it and the word after it
are is read off unambiguous places: first in the same document (the word stands elsewhere before a small letter or a
comma, or without its stop; the next word stands elsewhere capitalised in mid-sentence). Where the document is silent or
shows both, statistics of the whole corpus tell (a word before a full stop that never ends a block can't end a sentence;
a small-lettered word that begins blocks can begin sentences). Marks of scripts with their own terminators decide by themselves, and Thai
ends a sentence at a space between Thai letters.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lumenq.session import written

# Terminators by script, and paired marks.
FULL_WIDTH = "。！？｡"
OWN_SCRIPT = "։።፧፨؟۔।॥။៕"
MARKS = ".!?…‼⁇⁈⁉;;" + FULL_WIDTH + OWN_SCRIPT
PAIRS = {"(": ")", "[": "]", "{": "}", "«": "»", "‹": "›", "“": "”", "‘": "’", "„": "“”", "‚": "‘’", "「": "」", "『": "』", "（": "）", "【": "】", "《": "》", "〈": "〉", "［": "］", '"': '"'}
CLOSERS = set("".join(PAIRS.values())) | set("*_")
OPENERS = set(PAIRS) | set("¿¡*_#-–—•")
QUOTED_ON = "とっのはがをにでも"  # Japanese particles that carry a quotation on into its sentence

_RUN = re.compile(rf"(?:[{re.escape(MARKS.replace('.', ''))}]|\.(?![0-9A-Za-z_/]))[{re.escape(MARKS)}]*")  # no full stop within a word
_PAIRED = re.compile("[" + re.escape("".join(set(PAIRS) | (CLOSERS - set("*_")))) + "]")
_THAI_GAP = re.compile(r"(?<=[ก-ฺเ-๎])\s+(?=[ก-ฺเ-๎])")
_LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n|$)")
_ITEM = re.compile(r"\s*(?:(?:#{1,6}(?=\s)|[-*•+‣◦·–—](?=\s)|\(?\d{1,4}[.)](?=\s))\s*)+")
_TOKEN = re.compile(r"\S+")
_GAP = re.compile(r"(?>\r\n|\r|\n)[^\S\r\n]*(?>\r\n|\r|\n)\s*")
_CJK = re.compile(r"[぀-ヿ㐀-䶿一-鿿豈-﫿々]")
_STRIP_L = "".join(OPENERS | CLOSERS) + ","
_LEADING = "".join(OPENERS)
_MARKED = frozenset(_STRIP_L)
_OPEN = "[" + re.escape("".join(sorted(OPENERS))) + r"\s]*"
_STOP = re.compile(rf"(?<!\S)(\S++)(?:(?<=[^\s.]\.)|(?<=[^\s.]\.[,;]))(?:(?=\s{_OPEN}(\S+))|(?=\s|\Z))")  # a token that ends in a full stop, what follows
_SHORTENED = re.compile(rf"[^\s.]\.(?:[,;](?=\s|\Z)|(?=\s{_OPEN}([^\sA-Z0-9]\S*)))")  # a full stop that a small letter may follow
_HEAD = re.compile(rf"{_OPEN}(\S+)")
_WITHIN = re.compile(rf"(?<=[\w,]){_OPEN.replace('*', '+')}(\w[\w\u0300-\u036f]*)")  # a word after a word or a comma
_THAI = re.compile("[ก-๎]")
_STRIP_R = "".join(CLOSERS) + "".join(OPENERS) + MARKS + ",:："

#: Occurrences that say something about a word, in a corpus of any size.
LEAST = 3

#: Words of a lexicon that is sent to every task (some 100 bytes a word); a larger one is joined.
MOST = 1_000_000

NEVER, MAY_END = 1, 2  # classes of words before a full stop; all others are ordinary


@dataclass
class Lexicon:
    """abbreviations: word -> NEVER (ends a sentence) or MAY_END. starts: word -> (times at a block's start, within)."""

    abbreviations: dict[str, int] = field(default_factory=dict)
    starts: dict[str, tuple[int, int]] = field(default_factory=dict)

    def small_start(self, word: str) -> bool:
        """A word in small letters (or a sign) that begins sentences."""
        s, m = self.starts.get(word, (0, 0))
        return s >= LEAST and s > 0.1 * (s + m)

    def inner(self, word: str) -> bool | None:
        """Whether a capitalised word belongs within sentences (a name, a noun); None if unknown."""
        s, m = self.starts.get(word, (0, 0))
        return None if s + m < LEAST else s < 0.02 * (s + m)

    def only_inner(self, word: str) -> bool:
        """Whether a word is frequent and never begins a block, as a weekday or a surname; the names of things, which
        begin sentences now and then, are not."""
        s, m = self.starts.get(word, (0, 0))
        return s == 0 and m >= 20 * LEAST


def blocks(text: str) -> list[tuple[int, int]]:
    """Spans between blank lines, outside fenced code, without white space at the ends."""
    if "```" not in text:
        a, z = len(text) - len(text.lstrip()), len(text.rstrip())
        spans = []
        for m in _GAP.finditer(text, a, z):
            e = m.start()
            while text[e - 1].isspace():
                e -= 1
            spans.append((a, e))
            a = m.end()
        if a < z:
            spans.append((a, z))
        return spans
    out, at, end, fence = [], -1, 0, False
    for m in _LINE.finditer(text):
        a, z = m.span()
        if text.startswith("```", a):
            fence = not fence
            blank = True
        else:
            blank = fence or not text[a:z].strip()
        if blank:
            if at >= 0:
                out.append((at, end))
            at = -1
        else:
            if at < 0:
                at = a + len(text[a:z]) - len(text[a:z].lstrip())
            end = a + len(text[a:z].rstrip())
    if at >= 0:
        out.append((at, end))
    return out


def enclosed(text: str, a: int, z: int) -> list[tuple[int, int]]:
    """Outermost closed quotations and brackets of a block, as (opening, closing) positions."""
    stack: list[int] = []
    wait: Counter = Counter()  # openings on the stack by what closes them, so that no search is in vain
    found: list[tuple[int, int]] = []
    for m in _PAIRED.finditer(text, a, z):
        i, c = m.start(), m.group()
        close = next(k for k in range(len(stack) - 1, -1, -1) if c in PAIRS[text[stack[k]]]) if wait[c] else -1
        if c in "’‘" and close >= 0 and i + 1 < z and text[i + 1].isalnum():
            continue  # an apostrophe
        if c == '"':
            opens = close < 0 and (i == a or not text[i - 1].isalnum()) and i + 1 < z and not text[i + 1].isspace()
            if close < 0 and not opens:
                continue
        if close >= 0:
            found.append((stack[close], i))
            for o in stack[close:]:
                wait.subtract(PAIRS[text[o]])
            del stack[close:]
        elif c in PAIRS and not (c == "‘" and i > a and text[i - 1].isalnum()):
            stack.append(i)
            wait.update(PAIRS[c])
    found.sort()
    out: list[tuple[int, int]] = []
    for x in found:
        if not out or x[0] > out[-1][1]:
            out.append(x)
    return out


def wordy(c: str) -> bool:
    """A letter, a digit or a mark that combines with one."""
    return c.isalnum() or unicodedata.category(c)[0] == "M"


def cased(word: str) -> bool:
    return word.lower() != word.upper()


def norm(word: str) -> str:
    return word if word.isascii() else unicodedata.normalize("NFC", word)


def before_stop(text: str, a: int, i: int) -> str:
    """The word that ends at ``i``, without opening marks, however long it is."""
    if i == a or text[i - 1].isspace():
        return ""
    n = 32
    part = text[max(a, i - n) : i].rsplit(None, 1)[-1]
    while len(part) == n:
        n *= 8
        part = text[max(a, i - n) : i].rsplit(None, 1)[-1]
    return norm(part.lstrip(_STRIP_L))


def after_openers(text: str, i: int, z: int) -> int:
    """Past opening marks at ``i``, and past white space behind them (as in « x »)."""
    while i < z and (text[i] in OPENERS or text[i].isspace()):
        i += 1
    return i


def stripped(token: str) -> str:
    """A token without marks around it; its own signs ($, @, .) stay."""
    return norm(token.lstrip(_STRIP_L).rstrip(_STRIP_R))


def word_at(text: str, i: int, z: int) -> str:
    """The word that begins at ``i``, ``stripped``."""
    m = _TOKEN.match(text, after_openers(text, i, z), z)
    return stripped(m.group()) if m else ""


def plain_shape(word: str) -> bool:
    """The guess where neither document nor corpus tells: a word of more than six letters without a full stop within
    is an ordinary word; a shorter one may be shortened."""
    return len(word) > 6 and "." not in word


def proof(word: str) -> int:
    """How many occurrences show that a word is an abbreviation: the longer, the more, without a limit."""
    return 1 if "." in word else 1 + (len(word) - 1) // 6


class Evidence:
    """Unambiguous occurrences of words in one document. Each kind is gathered in one pass, when it is first asked for."""

    def __init__(self, text: str, spans: list[tuple[int, int]], lex: Lexicon):
        self.text, self.spans, self.lex = text, spans, lex
        self._stops: dict[str, int] | None = None
        self._plain: Counter | None = None
        self._inner: set[str] | None = None
        self._heads: set[str] | None = None

    def shortened(self, word: str) -> int:
        """How often it stands, with its full stop, before a small letter or a comma."""
        if self._stops is None:
            self._stops = {}
            for a, z in self.spans:
                for m in _SHORTENED.finditer(self.text, a, z):
                    after, i = m[1], m.start() + 1
                    if after is not None:
                        if not after[:1].islower() or self.lex.small_start(stripped(after)):
                            continue
                        w = before_stop(self.text, a, i)
                        if not cased(w):
                            continue
                    else:
                        w = before_stop(self.text, a, i)
                    self._stops[w] = self._stops.get(w, 0) + 1
        return self._stops.get(word, 0)

    def plain(self, word: str) -> int:
        """How often it stands without a full stop, in front of white space."""
        if self._plain is None:
            found = Counter([w for a, z in self.spans for w in self.text[a:z].split()])
            composed = self.text.isascii() or unicodedata.is_normalized("NFC", self.text)
            for token in [w for w in found if w[0] in _MARKED or not composed]:
                n = found.pop(token)
                found[norm(token.lstrip(_STRIP_L))] += n
            self._plain = found
        return self._plain[word]

    def inner(self, word: str) -> bool:
        """It stands within a sentence, after a word or a comma."""
        if self._inner is None:
            self._inner = {norm(w) for a, z in self.spans for w in _WITHIN.findall(self.text, a, z)}
        return word in self._inner

    def start(self, word: str) -> bool:
        """It begins a block."""
        if self._heads is None:
            self._heads = {word_at(self.text, m.end() if (m := _ITEM.match(self.text, a, z)) else a, z) for a, z in self.spans}
        return word in self._heads


_INSIDE = ",;:)]}、，；：）」』”’»"  # no sentence begins with these


def small(sign: str) -> bool:
    """A small letter, or a sign that a sentence does not begin with."""
    return sign.islower() or not (sign.isalnum() or sign in "@.#/&%'" or unicodedata.category(sign)[0] == "S")


class Splitter:
    def __init__(self, lex: Lexicon):
        self.lex = lex

    def spans(self, text: str) -> list[tuple[int, int]]:
        """(start, end) of each sentence in code points."""
        if not text or text.isspace():
            return []
        parts = blocks(text)
        self.text, self.parts, self.seen, self.thai = text, parts, None, bool(_THAI.search(text))
        return [s for a, z in parts for s in self.block(a, z)]

    @property
    def doc(self) -> Evidence:
        if self.seen is None:
            self.seen = Evidence(self.text, self.parts, self.lex)
        return self.seen

    def block(self, a: int, z: int) -> list[tuple[int, int]]:
        text = self.text
        item = _ITEM.match(text, a, z)
        body = item.end() if item else a
        shut = enclosed(text, a, z) if _PAIRED.search(text, a, z) else []
        closing = {c: o for o, c in shut}
        cuts: list[int] = []
        at, k = a, 0
        for m in _RUN.finditer(text, body, z):
            i, j = m.span()
            if not shut and j < z and text[j] == " ":  # nothing closes behind the marks
                if self.ends(at, i, j, j, z, -1):
                    cuts.append(j)
                    at = j
                continue
            while k < len(shut) and shut[k][1] < i:
                k += 1
            e, opened = j, -1
            while e < z and text[e] in CLOSERS:
                if e in closing:
                    opened = closing[e]
                elif text[e] in '"“‘' or (text[e] in "*_" and e + 1 < z and text[e + 1].isalnum()):
                    break
                e += 1
            if e >= z:
                break
            if k < len(shut) and shut[k][0] < e <= shut[k][1]:
                continue  # inside a quotation or bracket
            if text[e] in MARKS:
                continue  # more marks follow the closing ones
            if self.ends(at, i, j, e, z, opened):
                cuts.append(e)
                at = e
        opens = [o for o, _ in shut]
        for m in _THAI_GAP.finditer(text, body, z) if self.thai else ():
            k = bisect.bisect_right(opens, m.start()) - 1
            if k < 0 or shut[k][1] < m.start():
                cuts.append(m.start())
        out, at = [], a
        for c in [*(sorted(set(cuts)) if self.thai else cuts), z]:  # no white space before a cut
            s = at
            while s < c and text[s].isspace():
                s += 1
            if s < c:
                out.append((s, c))
            at = c
        return out

    def ends(self, at: int, i: int, j: int, e: int, z: int, opened: int) -> bool:
        """Whether the marks text[i:j], with closing marks up to ``e``, end the sentence that began at ``at``."""
        text = self.text
        run, spaced = text[i:j], text[e].isspace()
        t = e + 1 if spaced else e
        while t < z and text[t].isspace():
            t += 1
        if t >= z:
            return True
        sign, first = text[t], t
        if sign in OPENERS:
            first = after_openers(text, t, z)
            if first >= z:
                return False
            sign = text[first]
        if run == "." and opened < 0 and spaced:
            if text[t] in _INSIDE and text[t] not in PAIRS:
                return False
            return self.full_stop(at, i, first, z, sign)
        cjk = bool(_CJK.match(text[i - 1])) if i else False
        before_cjk = cjk or (i and text[i - 1] in "）」』”》】％")
        if any(c in FULL_WIDTH for c in run):
            own = True
        elif run[-1] in OWN_SCRIPT:
            own = True
        elif "……" in run or (run.startswith("…") and not spaced and (before_cjk or _CJK.match(sign))):
            own = not sign.islower()
            if not own:
                return False
        else:
            own = False
        if not spaced and not own:
            if not (run[-1] in "!?" and cjk and _CJK.match(sign)):
                return False
            own = True
        if text[t] in _INSIDE and text[t] not in PAIRS:
            return False
        if opened >= 0:
            return self.after_quote(at, opened, e, t, z, sign, spaced)
        if own:
            return not (spaced and sign.islower() and run[-1] not in OWN_SCRIPT and not self.starter(first, z))
        if run in (";", "\u037e"):
            return self.greek(at, i) and not sign.islower()
        if ";" in run:
            return False
        if run != ".":
            if "…" in run or ".." in run:
                apart = i > 0 and text[i - 1].isspace()
                if sign.isdigit():
                    return not apart
            return not small(sign) or self.starter(first, z)
        return self.full_stop(at, i, first, z, sign)

    def starter(self, first: int, z: int) -> bool:
        """Whether the word at ``first`` begins sentences though it has no capital."""
        return self.lex.small_start(word_at(self.text, first, z))

    def full_stop(self, at: int, i: int, first: int, z: int, sign: str) -> bool:
        """Whether a full stop at ``i``, before white space and the word at ``first``, ends a sentence.

        What the document shows without doubt comes first, of the word before the stop and of the one behind it; the
        corpus is asked where the document is silent or shows both.
        """
        text, lex = self.text, self.lex
        w = before_stop(text, at, i)
        if not w or not (w.isalnum() or wordy(w[-1]) and any(map(str.isalnum, w))):
            return not small(sign) or self.starter(first, z)
        if not w[-1].isalpha() and w[-1].isdigit() and w.lstrip("#№").replace(",", "").replace(".", "").isdigit():  # a number
            if sign.islower():
                return self.starter(first, z)
            if sign.isupper() and w.isdigit() and len(w) <= 3:
                return not self.names(word_at(text, first, z))
            return True
        doc, kind = self.doc if self.seen is None else self.seen, lex.abbreviations.get(w)
        if len(w) == 1 and w.isalpha():
            if w.isupper():  # an initial
                return kind == MAY_END and not sign.isdigit() and not self.names(word_at(text, first, z)) and (not small(sign) or self.starter(first, z))
            if kind is None and sign.islower():
                kind = MAY_END
        shown = doc.shortened(w) if doc._stops is None else doc._stops.get(w, 0)
        if kind is None and not shown:
            return sign.isalpha() and not sign.islower() or not small(sign) or not cased(w) or self.starter(first, z) or plain_shape(w) or doc.plain(w) > 0
        plain = doc.plain(w)
        if shown >= proof(w) and not plain:
            kind = kind or MAY_END  # an abbreviation, and no word, of this document
        elif plain >= 2 and not shown and len(w) > 1 and sign.isupper() and not doc.inner(word_at(text, first, z)):
            return True  # a word of this document, whatever it is elsewhere, and behind it no name
        elif kind == MAY_END and plain and not shown and len(w) > 3 and w.isalpha():
            kind = None
        if kind is None:
            if cased(w) and small(sign) and not self.starter(first, z):
                return plain_shape(w) or plain > 0 and not shown
            return True
        if kind == NEVER:
            return False
        if not sign.isupper() and self.starter(first, z):
            return True
        if small(sign) or sign.isdigit():
            return False
        word = word_at(text, first, z)
        return doc.start(word) or not lex.only_inner(word)

    def names(self, word: str) -> bool:
        """Whether a capitalised word after an ambiguous full stop is a name or noun that needs no sentence start: as it
        stands elsewhere in the document, or else in the corpus."""
        if self.doc.start(word):
            return False
        known = self.lex.inner(word)
        if word and known is not False and self.doc.inner(word) and self.lex.abbreviations.get(word) != NEVER:
            return True
        return bool(known)

    def after_quote(self, at: int, opened: int, e: int, t: int, z: int, sign: str, spaced: bool) -> bool:
        """Whether a sentence ends with a quotation or bracket that closes on a terminator."""
        text = self.text
        if sign.isupper() or sign in "$":
            return True
        if sign.islower() or sign.isdigit() and not _CJK.search(text, at, e):
            return self.lex.small_start(word_at(text, t, z)) if sign.islower() else False
        if sign in QUOTED_ON:
            return False
        p = opened - 1
        while p > at and text[p].isspace():
            p -= 1
        if p > at and text[p] in ":：":
            return True  # the quotation is introduced and ends its sentence
        whole = p <= at or not any(map(str.isalnum, text[at:opened]))
        return whole if (_CJK.search(text, at, e) or text[opened] in "([（") else False

    def greek(self, at: int, i: int) -> bool:
        part = self.text[at:i]
        g = sum("Ͱ" <= c <= "Ͽ" or "ἀ" <= c <= "῿" for c in part)
        return 3 * g >= sum(map(str.isalpha, part)) and g > 0


class Tally:
    """Counts of unambiguous occurrences: of words before full stops, and of words by position.

    Keys: ("w", word, how): how a word with a full stop goes on: e at a block's end, u capital or caseless, d digit,
    c comma. ("p", word, next): before a small letter. ("t", word, s or m): a word at a block's start or elsewhere.
    Words are counted whole, whatever their length.
    """

    def __init__(self):
        self.tokens: Counter = Counter()  # as they stand, made words of when all are counted
        self.heads: Counter = Counter()
        self.stops: Counter = Counter()  # (token with its full stop, token behind it)

    def __len__(self) -> int:
        return len(self.tokens) + len(self.stops)

    def add(self, text: str) -> None:
        tokens, stops = [], []
        for a, z in blocks(text):
            item = _ITEM.match(text, a, z)
            body = item.end() if item else a
            words = text[body:z].split()
            tokens += words
            if m := _HEAD.match(text, body, z):
                self.heads[m[1]] += 1
            shut = enclosed(text, a, z) if _PAIRED.search(text, a, z) else []
            if not shut:
                stops += [(w, after) for w, after in zip(words, [*words[1:], ""]) if w[-1] in ".,;"]
                continue
            k = 0
            for m in _STOP.finditer(text, body, z):
                t = m.end()
                while k < len(shut) and shut[k][1] < t:
                    k += 1
                if k == len(shut) or shut[k][0] >= t or m[1][-1] != "." or m[2] is None:
                    stops.append((m[1], m[2] or ""))
        self.tokens.update(tokens)
        self.stops.update(stops)

    def counts(self) -> Counter:
        out: Counter = Counter()
        for (token, after), n in self.stops.items():
            comma = token[-1] != "."
            if comma and token[-2:-1] != ".":
                continue
            word = norm(token[: -1 - comma].lstrip(_STRIP_L))
            if not word or not wordy(word[-1]):
                continue
            if after and after[0] in OPENERS and not (after := after.lstrip(_LEADING)):
                continue  # an opening mark that stands alone
            if comma:
                out["w", word, "c"] += n
            elif not after:
                out["w", word, "e"] += n
            elif after[0].islower():
                out["p", word, stripped(after)] += n
            else:
                out["w", word, "d" if after[0].isdigit() else "u"] += n
        for raw, n in self.tokens.items():
            if word := stripped(raw):
                out["t", word, "m"] += n
        for raw, n in self.heads.items():
            if word := stripped(raw):
                out["t", word, "s"] += n
                out["t", word, "m"] -= n
        return out


_TALLY = pa.schema([("kind", pa.string()), ("x", pa.string()), ("y", pa.string()), ("n", pa.int64())])


def _tallies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tally = Tally()

    def rows() -> pa.RecordBatch:
        counts = tally.counts()  # empty if there are tokens but no words, as in texts of marks or without spaces
        kind, x, y = zip(*counts) if counts else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(kind, pa.string()), pa.array(x, pa.string()), pa.array(y, pa.string()), pa.array(list(counts.values()), pa.int64())], schema=_TALLY)

    for b in batches:
        for t in b.column(0).to_pylist():
            if t:
                tally.add(t)
                if len(tally) > 300_000:
                    yield rows()
                    tally = Tally()
    if len(tally):
        yield rows()


def classify(word: str, a: int, u: int, d: int, e: int) -> int | None:
    """The class of a word that stood before a full stop ``a`` times before small letters or commas, ``u`` capitals,
    ``d`` digits and ``e`` times at a block's end. Longer words need more of it, as ``proof`` says."""
    n, least = a + u + d + e, LEAST * proof(word)
    if not any(map(str.isalpha, word)):
        return None
    if plain_shape(word):
        return NEVER if e == 0 and a >= max(least, 0.5 * n) else None
    if e <= 0.005 * n and (a + d >= max(least, 0.3 * n) or n >= 12):
        return NEVER
    if not cased(word):
        return None  # of a script without capitals: a small letter of another script after it says nothing
    return MAY_END if e and a >= 2 and a >= 0.03 * n else None


_CLASSED = "word string, class int"


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [(w, k) for w, *c in zip(*(x.to_pylist() for x in b.columns)) if (k := classify(w, *c))]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.string()), pa.array([k for _, k in found], pa.int32())], names=["word", "class"])


def lexicon_table(df: DataFrame, text: str = "text") -> DataFrame:
    """(word, s, m, class): statistics over all documents, combined in each partition and then by word.

    ``s`` and ``m``: times at a block's start and elsewhere, of words of ``LEAST`` occurrences, else null. ``class``: of
    abbreviations. The bound is the same whatever the size of the corpus, so a document is split no worse in a larger one.
    """
    rows = df.select(text).mapInArrow(_tallies, "kind string, x string, y string, n bigint")
    n = lambda y: F.sum(F.when(F.col("y") == y, F.col("n")).otherwise(0)).alias(y)
    follows = F.when(F.col("kind") == "p", F.col("y")).otherwise("")
    by = written(rows.groupBy("kind", "x", follows.alias("follows")).agg(*map(n, "eudcsm"), F.sum("n").alias("n")), "tally")
    starts = by.filter(f"kind = 't' and s + m >= {LEAST}").select(F.col("x").alias("word"), "s", "m")
    first = F.substr("word", F.lit(1), F.lit(1))
    small = starts.filter(f"s >= {LEAST} and s > 0.1 * (s + m)").filter(first == F.lower(first)).select(F.col("word").alias("follows"))
    pairs = by.filter("kind = 'p'").join(small, "follows", "left_anti").select("x", F.col("n").alias("a"), *[F.lit(0).alias(c) for c in "ude"])
    words = by.filter("kind = 'w'").select("x", F.col("c").alias("a"), "u", "d", "e").unionByName(pairs)
    words = words.groupBy("x").agg(*[F.sum(c).alias(c) for c in "aude"]).withColumn("n", F.expr("a + u + d + e"))
    # what ``classify`` may take for abbreviations
    words = words.filter(f"n >= {LEAST} and (e <= 0.005 * n and (a + d >= 0.3 * n or n >= 12) or e > 0 and a >= 2 and a >= 0.03 * n)").select("x", *"aude")
    return written(starts.join(words.mapInArrow(_classes, _CLASSED), "word", "full").select("word", "s", "m", "class"), "lexicon")


def lexicon_of(rows: pa.Table | list[dict]) -> Lexicon:
    rows = rows.to_pylist() if isinstance(rows, pa.Table) else rows
    return Lexicon({r["word"]: r["class"] for r in rows if r["class"]}, {r["word"]: (r["s"], r["m"]) for r in rows if r["s"] is not None})


def corpus_lexicon(df: DataFrame, text: str = "text") -> Lexicon:
    """The whole table on the driver, for corpora known to be small."""
    return lexicon_of(lexicon_table(df, text).toArrow())


def asked(text: str) -> set[str]:
    """All words a ``Splitter`` may look up for a text: those before and behind marks."""
    words: set[str] = set()
    for a, z in blocks(text):
        for m in _RUN.finditer(text, a, z):
            words.add(before_stop(text, a, m.start()))
            e = m.end()
            while e < z and (text[e] in CLOSERS or text[e].isspace()):
                e += 1
                words.add(word_at(text, e, z))
            words.add(word_at(text, m.end(), z))
        words.update(stripped(after) for _, after in _STOP.findall(text, a, z))
    return words - {""}


def _asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [(d, w) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if t for w in asked(t)]
        yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.string()), pa.array([w for _, w in found], pa.string())], names=["digest", "word"])


def _splitting(lex: Lexicon | None):
    """Splits c1; without a lexicon each row has its own in c2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(lex)
        for b in batches:
            at, start, end = [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                if t and lex is None:
                    splitter = Splitter(lexicon_of(b.column(2)[i].as_py() or []))
                for s, e in splitter.spans(t) if t else ():
                    at.append(i)
                    start.append(s)
                    end.append(e)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(start, pa.int64()), pa.array(end, pa.int64())], names=["c0", "start_char", "end_char"])

    return run


def sentences(df: DataFrame, key: str = "doc_id", text: str = "text", lexicon: Lexicon | None = None, most: int = MOST) -> DataFrame:
    """(key, start_char, end_char): one row per sentence, in code points, without white space at the ends.

    Every visible character outside fenced code is in exactly one sentence. Null, empty and blank texts and texts
    that are all code have no row; repeated rows are split each; null keys stay. Texts are split whole. ``lexicon``
    is taken from ``df`` itself, all of it, if not given: a table of up to ``most`` words goes to every task, of a larger
    one each text gets the words it asks for, by a join. Both give the same sentences.
    """
    rows = df.select(F.col(key).alias("c0"), F.col(text).alias("c1"))
    out = f"c0 {rows.schema[0].dataType.simpleString()}, start_char bigint, end_char bigint"
    if lexicon is None:
        words = lexicon_table(df, text)
        if words.limit(most + 1).count() > most:
            wanted = rows.select(F.md5("c1").alias("digest"), "c1").mapInArrow(_asking, "digest string, word string").distinct()
            own = wanted.join(words, "word").groupBy("digest").agg(F.collect_list(F.struct("word", "s", "m", "class")).alias("c2"))
            joined = rows.withColumn("digest", F.md5("c1")).join(own, "digest", "left").select("c0", "c1", "c2")
            return joined.mapInArrow(_splitting(None), out).withColumnRenamed("c0", key)
        lexicon = lexicon_of(words.toArrow())
    return rows.mapInArrow(_splitting(lexicon), out).withColumnRenamed("c0", key)
