"""Personal data: base patterns, and offset-preserving deobfuscation."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from hashlib import sha256
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from orrery.llm.frames import add_columns, documents

KINDS = ("email", "ip", "card", "phone")

# The four base patterns. Runs that no later start could match differently are possessive or anchored at
# their beginning, which leaves the matches as they are and keeps the scan linear.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL_RUN = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


class Span(NamedTuple):
    start: int
    kind: int
    end: int

    def __str__(self) -> str:
        return f"{KINDS[self.kind]}:{self.start}:{self.end}"


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    for d in digits[-2::-2]:
        total += 2 * int(d) - 9 * (d > "4")
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    found, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        free = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append(Span(start, 0, m.end()))
            free = m.end()
        at = text.find("@", free)
    return found


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def detect(text: str) -> list[Span]:
    """Base spans of a text in code points, by start and then kind; matches that fail their test are dropped without another try."""
    found = _emails(text) if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            found += [Span(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_octet, m[0].split(".")))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append(Span(m.start(), 2, m.end()))
        if "+" in text:
            found += [Span(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum(map(str.isdecimal, m[0])) <= 15]
    return sorted(found)


# Letters, digits and signs that look like ASCII ones. Full-width forms and digits of other scripts come from Unicode's own tables.
_LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p",
    "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԝ": "w", "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J",
    "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o",
    "ρ": "p", "υ": "u", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Χ": "X", "Υ": "Y", "ı": "i", "ⅼ": "l", "․": ".", "。": ".", "｡": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-",
    "—": "-", "−": "-", "﹣": "-", "﹫": "@", " ": " ", " ": " ", " ": " ", " ": " ",
}
_INVISIBLE = "­​‌‍⁠﻿"

# Digits as words in English, German, French and Spanish.
_SPELLED = {
    "0": "zero oh null zéro cero", "1": "one eins un uno", "2": "two zwei deux dos", "3": "three drei trois tres", "4": "four vier quatre cuatro",
    "5": "five fünf cinq cinco", "6": "six sechs seis", "7": "seven sieben sept siete", "8": "eight acht huit ocho", "9": "nine neun neuf nueve",
}
_WORDS = {w: d for d, ws in _SPELLED.items() for w in ws.split()}
_ANY = "(?:" + "|".join(sorted(_WORDS, key=lambda w: (-len(w), w))) + "|[0-9])"
_JOIN = r"(?:[\x20,-]{1,2})"
#: At least seven digits in words or figures, three or more of them words, are a number; four groups with dots between are an address.
_NUMBER = re.compile(rf"(?i)(?<!\w)(?:plus{_JOIN})?{_ANY}(?:{_JOIN}?(?<!\w\w\w\w\w\w\w\w){_ANY}){{6,}}(?!\w)")
_GROUP = rf"(?:[0-9]{{1,3}}(?![0-9])|{_ANY}(?:{_JOIN}{_ANY}){{0,2}})"
_ADDRESS = re.compile(rf"(?i)(?<!\w){_GROUP}(?:\x20(?:dot|point|punkt|punto)\x20{_GROUP}){{3}}(?!\w)")
_ITEM = re.compile(r"(?i)[^\W\d_]+|[0-9]")
_AT = r"(?:at|ät|arroba|arobase|\(a\)|@)"
_DOT = r"(?:dot|punkt|punto|point|\.)"
_OPEN, _CLOSE = r"[\(\[\{<]\x20?", r"\x20?[\)\]\}>]"
_BRACKET_DOT = re.compile(rf"(?i)(?<=[A-Za-z0-9])\x20?{_OPEN}{_DOT}{_CLOSE}\x20?(?=[A-Za-z0-9])")
# Last labels that an address in words must have, so that prose with "at" and "dot" stays: those of countries, and generic ones.
_COUNTRIES = (
    "ac|ad|ae|af|ag|ai|al|am|ao|aq|ar|as|at|au|aw|ax|az|ba|bb|bd|be|bf|bg|bh|bi|bj|bm|bn|bo|br|bs|bt|bw|by|bz|ca|cc|cd|cf|cg|ch|ci|ck|cl|cm|cn|co|cr|cu|cv|cw|cx|cy|cz|"
    "de|dj|dk|dm|do|dz|ec|ee|eg|er|es|et|eu|fi|fj|fk|fm|fo|fr|ga|gd|ge|gf|gg|gh|gi|gl|gm|gn|gp|gq|gr|gs|gt|gu|gw|gy|hk|hm|hn|hr|ht|hu|id|ie|il|im|in|io|iq|ir|is|it|je|jm|jo|jp|"
    "ke|kg|kh|ki|km|kn|kp|kr|kw|ky|kz|la|lb|lc|li|lk|lr|ls|lt|lu|lv|ly|ma|mc|md|me|mg|mh|mk|ml|mm|mn|mo|mp|mq|mr|ms|mt|mu|mv|mw|mx|my|mz|na|nc|ne|nf|ng|ni|nl|no|np|nr|nu|nz|"
    "om|pa|pe|pf|pg|ph|pk|pl|pm|pn|pr|ps|pt|pw|py|qa|re|ro|rs|ru|rw|sa|sb|sc|sd|se|sg|sh|si|sk|sl|sm|sn|so|sr|ss|st|su|sv|sx|sy|sz|tc|td|tf|tg|th|tj|tk|tl|tm|tn|to|tr|tt|tv|tw|tz|"
    "ua|ug|uk|us|uy|uz|va|vc|ve|vg|vi|vn|vu|wf|ws|ye|yt|za|zm|zw"
)
_GENERIC = "com|org|net|edu|gov|mil|int|info|biz|app|dev"
_NEW_GENERIC = (
    "academy|aero|agency|art|asia|bank|bar|berlin|bike|bio|blog|build|business|cafe|camp|capital|care|cat|center|church|city|click|clinic|cloud|club|codes|coffee|college|community|company|"
    "consulting|cool|coop|day|design|digital|direct|download|earth|education|email|energy|engineer|engineering|events|expert|family|farm|finance|fit|foundation|fun|fund|fyi|gallery|games|global|"
    "gmbh|group|guide|guru|hamburg|health|host|hotel|house|icu|institute|international|jobs|koeln|law|legal|life|link|live|lol|london|ltd|market|marketing|media|mobi|monster|museum|name|network|"
    "news|ngo|nyc|one|ong|online|page|paris|partners|party|photo|photography|photos|pics|plus|post|press|pro|properties|pub|review|reviews|rocks|run|school|science|services|shop|show|site|social|"
    "software|solutions|space|store|studio|support|systems|team|tech|technology|tel|tips|today|tokyo|tools|top|tours|travel|university|vip|website|wien|wiki|win|work|works|world|wtf|xxx|xyz|zone"
)
_TLDS = f"(?:{_COUNTRIES}|{_GENERIC}|{_NEW_GENERIC})(?![\\w-])"
#: (a) counts its letter in prose more often than it is a sign: a whole host must follow.
_HOST_NEXT = rf"(?=[A-Za-z0-9-]+(?:(?:\.|\x20?{_OPEN}{_DOT}{_CLOSE}\x20?)[A-Za-z0-9-]+)*(?:\.|\x20?{_OPEN}{_DOT}{_CLOSE}\x20?){_TLDS})"
_BRACKET_AT = re.compile(rf"(?i)(?<=[A-Za-z0-9])\x20?(?:{_OPEN}{_AT}{_CLOSE}\x20?(?=[A-Za-z0-9])|\(a\)\x20?{_HOST_NEXT})")
_SPOKEN_DOT = r"(?:\x20(?:dot|punkt|punto|point|\.)\x20|_dot_)"
#: name at host dot tld, all in words; both signs must be disguised or spaced. Signs that are no English word take any last label after a
#: spoken dot. After "at", where "point" and a lone dot are prose too ("at this point in", "at noon . so we"), words of prose are no last labels.
#: The sign is found first, then the host after it, then the name before it, so that a text is read a few times at most.
_SAID_AT = re.compile(r"(?i)(?P<at>\x20at\x20)|(?P<sign>\x20(?:@|ät|arroba|arobase)\x20|_at_)")
_LABEL = r"[A-Za-z0-9-]++"
_LABEL_DOT = re.compile(rf"(?i){_SPOKEN_DOT}|\.")
_SAID_LABEL = re.compile(_LABEL)
#: What may stand before a last label, and the label; each in its own words.
_SAID_LAST = re.compile(
    rf"(?i)(?:\x20(?:dot|punkt|punto)\x20|_dot_){_TLDS}"
    rf"|\x20point\x20(?!(?:am|as|at|be|by|do|in|is|it|me|my|no|so|to|us)\b)(?:{_COUNTRIES}|{_GENERIC})(?![\w-])"
    rf"|\x20\.\x20(?!(?:am|as|by|do|my|so|to)\b)(?:{_COUNTRIES}|{_GENERIC})(?![\w-])"
)
_SAID_LAST_ANY = re.compile(r"(?i)(?:\x20(?:dot|punkt|punto|point)\x20|_dot_)[A-Za-z]{2,}(?![\w-])")
_NAME_DOTS = ("\x20dot\x20", "\x20point\x20", "\x20punkt\x20", "\x20punto\x20", ".")
_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_%+-")
#: One of these is in every match of _SAID; of _ADDRESS. In lower case, where (?i) takes i with a dot and long s as well.
_SAID_HINTS = (" at ", " @ ", "_at_", " ät ", " arroba ", " arobase ")
_DOT_HINTS = (" dot ", " point ", " punkt ", " punto ")
_SAID_DOT = re.compile(rf"(?i){_SPOKEN_DOT}")
_SPACED_AT = re.compile(r"(?<=[A-Za-z0-9])(?:\x20@\x20?|\x20?@\x20)(?=[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}\b)")


class Traced:
    """A text that transducers rewrite, each character with the span of the source that it stands for."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends = text, list(range(len(text))), list(range(1, len(text) + 1))

    def rewrite(self, pattern: re.Pattern, to: Callable[[re.Match], str]) -> None:
        self.replace((*m.span(), to(m)) for m in pattern.finditer(self.text))

    def replace(self, edits: Iterable[tuple[int, int, str]]) -> None:
        """edits: places in ascending order with their new text."""
        parts, starts, ends, at = [], [], [], 0
        for a, b, new in edits:
            if new == self.text[a:b]:
                continue
            parts += [self.text[at:a], new]
            starts += self.starts[at:a] + [self.starts[a]] * len(new)
            ends += self.ends[at:a] + [self.ends[b - 1]] * len(new)
            at = b
        if at:
            self.text = "".join(parts) + self.text[at:]
            self.starts, self.ends = starts + self.starts[at:], ends + self.ends[at:]


def _plain(m: re.Match) -> str:
    c = m[0]
    if c in _INVISIBLE:
        return ""
    if (to := _LOOKALIKES.get(c)) is not None:
        return to
    if (d := unicodedata.digit(c, None)) is not None and unicodedata.category(c) == "Nd":
        return str(d)
    return unicodedata.normalize("NFKC", c)


_CHANGED = re.compile("[" + "".join(_LOOKALIKES) + "０-９Ａ-Ｚａ-ｚ＠．＋＿％" + _INVISIBLE + r"]|(?![0-9])\d")


def _spoken(m: re.Match) -> str:
    items = _ITEM.findall(m[0])
    digits = [_WORDS.get(i.lower(), i) for i in items if i.lower() != "plus"]
    if sum(len(i) > 1 for i in items) < 3:
        return m[0]
    return ("+" if items[0].lower() == "plus" else "") + "".join(digits)


def _address(m: re.Match) -> str:
    return "".join("." if i.lower() in ("dot", "point", "punkt", "punto") else _WORDS.get(i.lower(), i) for i in _ITEM.findall(m[0]))


def _host_end(text: str, at: int, any_label: bool) -> int:
    """Where the host that begins at `at` ends: after its last label that may be a last one; -1 if none may."""
    if (m := _SAID_LABEL.match(text, at)) is None:
        return -1
    end, here = -1, m.end()
    while True:
        if m := _SAID_LAST.match(text, here) or any_label and _SAID_LAST_ANY.match(text, here):
            end = m.end()
        if (dot := _LABEL_DOT.match(text, here)) is None or (m := _SAID_LABEL.match(text, dot.end())) is None:
            return end
        here = m.end()


def _name_start(text: str, at: int, free: int) -> int:
    """Where the name that ends at `at` begins, not before `free`; `at` if there is none."""
    start = at
    while True:
        here = start
        if start < at:  # a dot must stand between this label and the one before
            here = next((start - len(d) for d in _NAME_DOTS if start - len(d) > free and text[start - len(d) : start].lower() == d), start)
            if here == start:
                return start
        end = here
        while here > free and text[here - 1] in _NAME:
            here -= 1
        if here == end:
            return start
        start = here


def said(text: str) -> Iterator[tuple[int, int, str]]:
    """Addresses in words, with their plain form."""
    free = 0
    m = _SAID_AT.search(text)
    while m:
        a, b = m.span()
        after = a + 1
        if (end := _host_end(text, b, m.lastgroup == "sign")) >= 0 and (start := _name_start(text, a, free)) < a:
            yield start, end, _SAID_DOT.sub(".", text[start:a]) + "@" + _SAID_DOT.sub(".", text[b:end])
            free = after = end
        m = _SAID_AT.search(text, after)


def disguised(text: str) -> bool:
    """Whether deobfuscation may add a span: a transducer matches the text without look-alikes, or those alone hid a span.

    Each pattern is tried only where the text has what all its matches have.
    """
    plain = text if text.isascii() else _CHANGED.sub(_plain, text)
    low = plain.lower().replace("i̇", "i").replace("ſ", "s")
    return (
        any(w in low for w in _SAID_HINTS) and next(said(plain), None) is not None
        or any(c in low for c in "([{<") and (_BRACKET_AT.search(plain) or _BRACKET_DOT.search(plain)) is not None
        or (" @" in low or "@ " in low) and _SPACED_AT.search(plain) is not None
        or any(w in low for w in _DOT_HINTS) and _ADDRESS.search(plain) is not None
        or sum(map(low.count, (*_WORDS, "plus"))) >= 3 and any(_spoken(m) != m[0] for m in _NUMBER.finditer(plain))
        or plain != text and bool(detect(plain))
    )


def deobfuscated(text: str, base: list[Span]) -> list[Span]:
    """Spans that show only after normalising, in the source's code points; none inside a base span of its kind."""
    t = Traced(text)
    t.rewrite(_CHANGED, _plain)
    t.rewrite(_ADDRESS, _address)
    t.rewrite(_NUMBER, _spoken)
    t.rewrite(_BRACKET_AT, lambda m: "@")
    t.rewrite(_BRACKET_DOT, lambda m: ".")
    t.replace(said(t.text))
    t.rewrite(_SPACED_AT, lambda m: "@")
    if t.text == text:
        return []
    more = []
    for s in detect(t.text):
        a, b = t.starts[s.start], t.ends[s.end - 1]
        shown = t.text[s.start : s.end]
        if text[a:b] == shown or s.kind == 0 and not re.search(r"\.[A-Za-z]{2,}\Z", shown):
            continue
        if not any(x.kind == s.kind and x.start <= a and b <= x.end for x in base):
            more.append(Span(a, s.kind, b))
    return sorted(set(more))


def redacted(text: str, spans: list[Span], hidden: list[tuple[int, int]] = ()) -> str:
    """The text with each run of overlapping spans and secrets replaced by the first one's kind in angle brackets."""
    parts, at = [], 0
    for start, end, name in sorted([*((s.start, s.end, KINDS[s.kind].upper()) for s in spans), *((a, b, "SECRET") for a, b in hidden)]):
        if start >= at:
            parts += [text[at:start], f"<{name}>"]
        at = max(at, end)
    return "".join(parts) + text[at:]


# Names under which secrets are set, and the shapes of keys that tell themselves.
_SET = re.compile(r"""(?ai)(?<![a-z0-9])(?:token|secret|password|passwd|api[_-]?key|access[_-]?key|private[_-]?key)["']?\s{0,3}[:=]\s{0,3}["']?(?P<value>[a-z0-9_/+=.-]{12,})""")
_KEYS = re.compile(r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b|\bgh[pousr]_[A-Za-z0-9]{36,}\b|\bsk_(?:live|test)_[A-Za-z0-9]{16,}\b|\bxox[abprs]-[A-Za-z0-9-]{10,}|-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----")
#: One of these is in every match of _SET, in lower case; of _KEYS, as it stands.
_SET_HINTS, _KEY_HINTS = ("token", "secret", "passw", "key"), ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk_", "xox", "-----BEGIN ")


def secrets(text: str) -> list[tuple[int, int]]:
    """Places of secrets, which are no personal data and so no spans: values of twelve signs or more that hold a digit, and known keys."""
    found, low = [], text.lower()
    if any(w in low for w in _SET_HINTS):
        found += [m.span("value") for m in _SET.finditer(text) if any(map(str.isdigit, m["value"]))]
    if any(w in text for w in _KEY_HINTS):
        found += [m.span() for m in _KEYS.finditer(text)]
    return sorted(found)


FIELDS = [T.StructField(f"n_{k}", T.LongType()) for k in KINDS] + [
    T.StructField("base_sha256", T.StringType()),
    T.StructField("spans", T.StringType()),
    T.StructField("n_added", T.LongType()),
    T.StructField("n_secrets", T.LongType()),
    T.StructField("n_found", T.LongType()),
    T.StructField("redacted_text", T.StringType()),
]


def find_personal_data(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_added, n_secrets, n_found and redacted_text appended.

    spans joins kind:start:end of the base spans and of those that deobfuscation adds, by start and then kind; n_added counts the
    latter. base_sha256 hashes the base spans, joined likewise. n_secrets counts secrets (see secrets()), n_found spans and secrets.
    redacted_text has every span and secret replaced. Null and empty texts have no spans (counts 0, the hash of nothing, a null text's
    redacted_text null). Texts of any length are scanned whole, in time that grows with their length. Row by row, without a shuffle: repeated
    rows get the same result, an empty table gives no rows, extra columns pass through, and columns named as the results are replaced.
    """

    def compute(texts: list) -> list[list]:
        out: list[list] = [[] for _ in FIELDS]
        for text in texts:
            base = detect(text or "")
            more = deobfuscated(text, base) if text and disguised(text) else []
            spans = sorted(base + more) if more else base
            values = [sum(s.kind == k for s in base) for k in range(4)] if base else [0] * 4
            hidden = secrets(text) if text else []
            values += [sha256(",".join(map(str, base)).encode()).hexdigest(), ",".join(map(str, spans)), len(more), len(hidden), len(spans) + len(hidden)]
            values.append(redacted(text, spans, hidden) if spans or hidden else text)
            for column, value in zip(out, values, strict=True):
                column.append(value)
        return out

    return add_columns(docs, [text_col], FIELDS, compute)


def op4_personal_data(spark, sf_dir: str) -> DataFrame:
    return find_personal_data(documents(spark, sf_dir).select("doc_id", "text")).drop("text", "redacted_text")
