"""Code pages, and how text reads if it was written in one and decoded by another.

All single-byte pages that Python knows and that keep ASCII are used, found by rule; none is singled out. Of pages with the
same characters one stands for all.
"""

from __future__ import annotations

import codecs
import encodings
import pkgutil
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

# Pages named first where several read a text alike; encodings of more than one byte.
FIRST = ["cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "iso8859_2", "iso8859_15", "cp1254", "cp1251", "koi8_r", "cp866", "cp1253", "cp1257"]
WIDE = ["gb18030", "cp932", "big5", "euc_jp", "euc_kr"]
UNDEFINED = 48  # bytes that a single-byte page may leave open; encodings of several bytes leave open more
LOST = "�"
_STEP = re.compile(rb"[\x00-\x7f]|[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")
_CUT_OFF = re.compile(rb"[\xc2-\xf4][\x80-\xbf]*|[\x80-\xbf]+|.", re.DOTALL)  # a letter that lacks bytes
_WIDE_SIGN = re.compile(r"[⺀-鿿가-힣｡-ﾟ぀-ヿ]")
_ODD_KINDS = ("Co", "Cn", "Cs")


@lru_cache(1)
def pages() -> dict[str, str]:
    """The 256 characters of each page; bytes it leaves open stand for themselves, as lenient decoders have it."""
    out: dict[str, str] = {}
    for name in dict.fromkeys([*FIRST, *sorted(m.name for m in pkgutil.iter_modules(encodings.__path__))]):
        try:
            if "escape" in name or not codecs.lookup(name)._is_text_encoding or bytes(range(128)).decode(name) != "".join(map(chr, range(128))):
                continue
        except (LookupError, UnicodeError, AttributeError, ImportError):
            continue
        high, undefined = [], 0
        for b in range(128, 256):
            try:
                high.append(bytes([b]).decode(name))
            except UnicodeError:
                high.append(chr(b))
                undefined += 1
        if undefined <= UNDEFINED and all(len(c) == 1 and ord(c) > 127 for c in high):
            text = "".join(map(chr, range(128))) + "".join(high)
            if text not in out.values():
                out[name] = text
    return out


def letters_of(raw: bytes, code: str) -> list[tuple[int, str]]:
    """Where each letter of ``raw`` ends, and the letter; a byte that is none is a lost one."""
    out, at = [], 0
    if code == "utf-8":
        while at < len(raw):
            m = _STEP.match(raw, at)
            try:
                letter = m.group().decode() if m else LOST
            except UnicodeDecodeError:
                letter = LOST
            at = (m or _CUT_OFF.match(raw, at)).end()
            out.append((at, letter))
        return out
    while at < len(raw):
        for width in (1, 2, 3, 4):
            try:
                letter = raw[at : at + width].decode(code)
            except UnicodeDecodeError:
                continue
            if len(letter) == 1:
                break
        else:
            letter, width = LOST, 1
        at += width
        out.append((min(at, len(raw)), letter))
    return out


def blocks(units: list[tuple[int, str]], letters: list[tuple[int, str]]) -> Iterator[tuple[str, str]]:
    """Least stretches of foreign characters and of letters that are the same bytes; both lists tell where each ends."""
    i = j = a = b = 0
    while i < len(units) and j < len(letters):
        if units[i][0] == letters[j][0]:
            yield "".join(c for _, c in units[a : i + 1]), "".join(c for _, c in letters[b : j + 1])
            i, j = i + 1, j + 1
            a, b = i, j
        elif units[i][0] < letters[j][0]:
            i += 1
        else:
            j += 1
    if a < len(units):
        yield "".join(c for _, c in units[a:]), "".join(c for _, c in letters[b:])


class Pages:
    """Tables and patterns of all pages, built where they are used; readings of a run are remembered."""

    def __init__(self) -> None:
        self.chars = pages()
        self.bytes = {n: {c: b for b, c in reversed(list(enumerate(t)))} for n, t in self.chars.items()}
        self.pattern = {n: self._pattern(t) for n, t in self.chars.items()}
        leads = {c for t in self.chars.values() for c in t[0xC2:0xF5] if ord(c) > 127}
        self.lead = re.compile("[" + "".join(re.escape(c) for c in sorted(leads)) + "]")
        self.unit = lru_cache(50_000)(self._unit)
        self.read = lru_cache(200_000)(self._read)
        self.read_wide = lru_cache(50_000)(self._read_wide)

    @staticmethod
    def _pattern(chars: str) -> re.Pattern:
        of = lambda a, b: "[" + "".join(re.escape(c) for c in chars[a : b + 1]) + "]"
        more = of(0x80, 0xBF)
        return re.compile(f"(?:{of(0xC2, 0xDF)}{more}|{of(0xE0, 0xEF)}{more}{{2}}|{of(0xF0, 0xF4)}{more}{{3}})+")

    def _decoded(self, text: str, code: str) -> str | None:
        table = self.bytes[code]
        try:
            plain = bytes(table[c] for c in text).decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            return None
        return None if any(unicodedata.category(c) in _ODD_KINDS for c in plain) else plain

    def _unit(self, letter: str, code: str, depth: int) -> str:
        for _ in range(depth):
            letter = "".join(self.chars[code][b] for b in letter.encode("utf-8", "surrogatepass"))
        return letter

    def _read(self, run: str) -> tuple[tuple[int, int, str, int, str], ...]:
        """Parts of a run without ASCII that are UTF-8 under some page: start, end, page, how many times, and the plain text."""
        found: dict[tuple[int, int, str], tuple[str, int]] = {}
        if self.lead.search(run):
            for code, pattern in self.pattern.items():
                for m in pattern.finditer(run):
                    plain, depth = self._decoded(m.group(), code), 1
                    while plain is not None:
                        found.setdefault((m.start(), m.end(), plain), (code, depth))
                        plain, depth = self._decoded(plain, code) if pattern.fullmatch(plain) else None, depth + 1
        return tuple((a, b, code, depth, plain) for (a, b, plain), (code, depth) in found.items())

    def _read_wide(self, run: str) -> tuple[str, tuple[tuple[str, str], ...]] | None:
        """A run without ASCII as UTF-8 under an encoding of several bytes: its name and the units with their letters."""
        if not _WIDE_SIGN.search(run):
            return None
        for code in WIDE:
            try:
                raw = run.replace(LOST, "?").encode(code)
            except UnicodeEncodeError:
                continue
            plain = raw.decode("utf-8", "replace")
            if 2 * plain.count(LOST) > len(plain):  # most runs are sound text of their own
                continue
            units, at = [], 0
            for c in run:
                at += 1 if c == LOST else len(c.encode(code))
                units.append((at, c))
            letters = letters_of(raw, "utf-8")
            good = sum(ord(c) > 127 and c != LOST for _, c in letters)
            bad = sum(c in (LOST, "?") for _, c in letters)
            if good and good >= 2 * bad and (bad == 0 or good >= 2) and not any(unicodedata.category(c) in _ODD_KINDS for _, c in letters):
                return code, tuple(blocks(units, letters))
        return None
