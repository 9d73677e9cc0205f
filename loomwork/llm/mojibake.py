"""Text garbled by decoding with the wrong character encoding: found, and restored where nothing was lost.

Each way of decoding wrongly is a substitution cipher: a letter became a unit of one or more foreign characters. Which
ciphers a source has, and which letter a unit stands for there, is learned by expectation-maximization against a bigram
model of the corpus's own letters, apart for every source and cipher (``ciphers.py``). All code pages that Python knows
serve as starting points (``pages.py``); characters that no page explains are learned as a free cipher from random keys.
What is learned is a table of units and letters, and texts are restored by that table, as by ``translate()``. An exact
check follows: bytes must agree, and what merely stands in quotes is no case. Replacement characters mark what is lost.

Three passes: letters are counted over all texts; texts with suspect units are written once with those units; the table
is learned from the counted units and joined to the suspect texts, the units of each text apart.

Results for odd input: null and empty texts are sound; text garbled several times by one page is restored by so many
steps; half-escaped units (``&Atilde;©``) count as their characters; sources that are null form a source of their own;
documents without id are skipped.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.functions.shared import written
from loomwork.llm.ciphers import Model, learn_key, letter_class, script
from loomwork.llm.pages import LOST, WIDE, Pages, blocks, letters_of

ROUNDS = 12
LINE_GAIN = 6.0  # what a reading of a line must gain, in nats, before its units are counted
UNREADABLE = -4.5  # nats a character from which a reading is none
WORD_GAIN = 1.0  # what it must gain for a word, to change it
CIPHER_GAIN = 30.0  # what a cipher must gain over its different contexts in a source: the price of assuming one more
SIGN_COST = 6.0  # what reading a letter as no letter costs
LOST_COST = 9.0  # what a lost letter costs, in nats, where readings are compared
FREE = "?"  # the cipher of characters that no page explains
FREE_GAIN = 0.7  # what a free cipher must gain per pair of characters
_QUOTES = {"“": "”", '"': '"', "`": "`", "'": "'", "‘": "’", "«": "»", "„": "“", "‹": "›", "「": "」", "(": ")", "[": "]"}
_FLAT = re.compile(r"(?<=[a-zà-ÿ])Ã (?=( ?))")
_ENTITY = re.compile(r"&(?:[A-Za-z]{2,8}|#\d{2,5}|#x[0-9A-Fa-f]{2,4});")
_HIGH = re.compile(r"[^\x00-\x7f]+")
_TOKEN = re.compile(r"[^ \t\n\r\f\v]*[^\x00-\x7f][^ \t\n\r\f\v]*")
# Ranges of Unicode in wide use: Latin, Greek, Cyrillic, punctuation, currency, arrows, boxes, signs, East Asian scripts, pictures.
_IN_USE = re.compile("[\x00-\u024f\u0370-\u045f\u1e00-\u20bf\u2100-\u27bf\u3000-\u30ff\u4e00-\u9fff\uac00-\ud7a3\uff00-\uffef\U0001f300-\U0001faff]+")
_NARROW = re.compile("[\x80-⹿]")
_STRAY = re.compile("[\x80-\x84\x86-\x9f]")
UNITS = "array<struct<cipher:string,unit:string,letter:string,before:string,after:string,n:long>>"
Unit = tuple[str, str, str, str, str]


def _plain_entities(text: str) -> str:
    def sign(m: re.Match) -> str:
        c = html.unescape(m.group())
        return c if len(c) == 1 and ord(c) > 127 else m.group()

    return _ENTITY.sub(sign, text) if "&" in text else text


def quoted(text: str, a: int, b: int) -> bool:
    """Whether just this run stands between quotes."""
    return a > 0 and b < len(text) and _QUOTES.get(text[a - 1]) == text[b]


class Reader:
    """Reads texts for suspect units, with one model of letters; what it learns of words is remembered."""

    def __init__(self, model: Model):
        self.model, self.pages = model, Pages()
        self.names = list(self.pages.chars)
        signs = sorted({c for t in self.pages.chars.values() for c in t if ord(c) > 127} | {chr(i) for i in range(128)})
        classes: dict[str, int] = {}
        index = {c: classes.setdefault(c.lower() if len(c.lower()) == 1 else c, len(classes)) for c in signs}
        shown = list(classes)
        self.links = model.matrix(shown, shown)
        self.classes = np.array([[index[c] for c in t] for t in self.pages.chars.values()], dtype=np.int32)
        case = lambda c: 1 if c.islower() else 2 if c.isupper() else 0
        self.case = np.array([[case(c) for c in t] for t in self.pages.chars.values()], dtype=np.int8)
        self.letter = np.array([[c.isalpha() for c in t] for t in self.pages.chars.values()], dtype=bool)
        self.space = index[" "]
        self.strange = lru_cache(200_000)(self._strange)
        self.class_link = lru_cache(500_000)(lambda a, b: model.step(a, b, of_class=True))
        self.readings = lru_cache(4_000)(self._readings)
        self.gain = lru_cache(100_000)(self._gain)

    # ---- runs that are UTF-8 under some page

    def runs(self, text: str) -> Iterator[tuple[int, int, str, int, str]]:
        for m in _HIGH.finditer(text):
            for a, b, code, depth, plain in self.pages.read(m.group()):
                yield m.start() + a, m.start() + b, code, depth, plain

    def wide_runs(self, text: str) -> Iterator[tuple[int, int, str, tuple[tuple[str, str], ...]]]:
        for m in _HIGH.finditer(text):
            if found := self.pages.read_wide(m.group()):
                yield m.start(), m.end(), found[0], found[1]

    def explained(self, run: str) -> bool:
        """Whether every character of a run is part of something that is UTF-8 under a page, of letters that are known."""
        at = 0
        for a, b, _, _, plain in sorted(self.pages.read(run), key=lambda r: (r[0], -r[1])):
            if a <= at < b and all(self.model.before.get(letter_class(c), 0) > 1 for c in plain):
                at = b
        return at >= len(run)

    def known(self, plain: str) -> bool:
        """Whether any letter of a reading occurs elsewhere; one that holds none has nothing to speak for it."""
        return any(c.isascii() or self.model.before.get(letter_class(c), 0) > 1 for c in plain)

    # ---- words of older pages

    def _strange(self, token: str) -> bool:
        """Whether a word reads badly where it leaves ASCII, mixes letters and signs beyond it or is all accented; and no page explains it."""
        if not _NARROW.search(token):  # no page has any of it
            return False
        worst, last = [], " "
        for c in token + " ":
            if not c.isascii() or not last.isascii():
                worst.append(self.class_link(letter_class(last), letter_class(c)))
            last = c
        high = [c for c in token if not c.isascii()]
        letters = sum(c.isalpha() and c < "⺀" for c in high)
        mixed = len(high) >= 4 and 0 < letters <= 0.85 * len(high)
        latin = sum(script(c) == "LATIN" for c in high)
        bare = latin >= 3 and latin >= 0.6 * len(token)  # no Latin script does without the plain letters
        return (mixed or bare or sum(worst) < -4.6 * len(worst)) and not all(self.explained(m) for m in _HIGH.findall(token))

    def words(self, line: str) -> list[tuple[int, int, bool]]:
        """Places of the words beyond ASCII of a line in which any reads badly, and which do; those that a page explains aside."""
        found = [(*m.span(), self.strange(m.group())) for m in _TOKEN.finditer(line)]
        if not any(s for _, _, s in found):
            return []
        return [(a, b, s) for a, b, s in found if s or not all(self.explained(r) for r in _HIGH.findall(line[a:b]))]

    def _readings(self, word: str) -> tuple[np.ndarray, dict[str, float]]:
        """What every pair of a page (row) and an older page (column) gains for a word; and so for wide encodings."""
        out = np.zeros((len(self.names), len(self.names)), dtype=np.float32)
        wide: dict[str, float] = {}
        as_is = self.model.path(" ", word, " ")
        done: dict[bytes, int] = {}
        for d, name in enumerate(self.names):
            table = self.pages.bytes[name]
            raw = bytes(table.get(c, 0x1A) for c in word) + b" "
            if raw.count(0x1A) > 0.02 * len(word):
                continue
            if raw in done:
                continue
            done[raw] = d
            at = np.frombuffer(raw, dtype=np.uint8)
            ids, case = self.classes[:, at], self.case[:, at]
            before = np.concatenate([np.full((len(ids), 1), self.space, dtype=np.int32), ids[:, :-1]], axis=1)
            score = self.links[before, ids].sum(axis=1)
            score -= 1.5 * ((case[:, :-1] == 1) & (case[:, 1:] == 2)).sum(axis=1)
            score -= SIGN_COST * (self.letter[d, at][None, :] & ~self.letter[:, at]).sum(axis=1)
            out[d] = np.maximum(score - as_is, 0)
            out[d, d] = 0
            for e in WIDE:
                if letters := self.wide_letters(word, e, name):
                    wide[f"{e}<{name}"] = max(0.0, self.worth(letters) - as_is)
        return out, wide

    def cipher(self, words: list[str]) -> str:
        """The pair of pages that reads the strange words of a line best; the free cipher if none does, or none."""
        read = [self.readings(w) for w in words]
        whole = sum(r for r, _ in read)
        wide: Counter = Counter()
        for _, r in read:
            wide.update(r)
        d, e = np.unravel_index(int(whole.argmax()), whole.shape)
        best, gain = f"{self.names[e]}<{self.names[d]}", float(whole[d, e])
        if wide and max(wide.values()) > gain:
            best, gain = max(wide.items(), key=lambda c: c[1])
        if gain > LINE_GAIN:
            changed = [w for w in words if self.gain(w, best) > WORD_GAIN]
            scored = sum(self.gain(w, best) + self.model.path(" ", w, " ") for w in changed)
            if scored > UNREADABLE * sum(len(w) + 1 for w in changed):
                return best
        return FREE if any(self.dense(w) for w in words) else ""

    def _gain(self, word: str, cipher: str) -> float:
        """What a pair of pages gains for a word."""
        e, d = cipher.split("<")
        plain = self.wide_letters(word, e, d) if e in WIDE else self._letters(word, cipher)
        return self.worth(plain) - self.model.path(" ", word, " ") if plain else 0.0

    @staticmethod
    def dense(word: str) -> bool:
        """Whether a word is mostly letters beyond ASCII of small scripts, with nothing lost."""
        return LOST not in word and sum("\x7f" < c < "⺀" and c.isalpha() for c in word) >= max(3, 0.6 * len(word))

    def worth(self, word: str) -> float:
        """How well a word reads whose lost letters cost something each."""
        return self.model.path(" ", word.replace(LOST, ""), " ") - LOST_COST * word.count(LOST)

    def wide_letters(self, word: str, e: str, d: str) -> str:
        """A word read as an encoding of several bytes; empty if most of it is no wide letter."""
        plain = bytes(self.pages.bytes[d].get(c, 0x3F) for c in word).decode(e, "replace")
        high = [c for c in plain if ord(c) > 127]
        good = sum(script(c) in ("CJK", "HIRAGANA", "KATAKANA", "HANGUL", "HALFWIDTH", "FULLWIDTH", "KATAKANA-HIRAGANA") or "　" <= c <= "〿" or "＀" <= c <= "￯" for c in high)
        if not high or good < 0.9 * sum(c != LOST for c in high) or plain.count(LOST) > 0.05 * len(plain) + 1:
            return ""
        return plain

    def units(self, word: str, cipher: str) -> list[tuple[str, str]]:
        """Units of a word and the letters that the cipher's pages give them; plain characters are no units."""
        if cipher == FREE:
            return [(c, "") for c in word if ord(c) > 127]
        e, d = cipher.split("<")
        if e not in WIDE:
            old, table = self.pages.chars[e], self.pages.bytes[d]
            return [(c, old[table[c]] if c in table else LOST) for c in word if ord(c) > 127]
        table = self.pages.bytes[d]
        raw = bytes(table.get(c, 0x3F) for c in word)
        return [(u, x) for u, x in blocks([(i + 1, c) for i, c in enumerate(word)], letters_of(raw, e)) if not u.isascii() or u != x]

    def suspects(self, text: str) -> Iterator[Unit]:
        """Every unit that may stand for a letter: cipher, unit, letter, and the classes of what stands before and after it."""
        taken: list[tuple[int, int]] = []
        for a, b, cipher, words in self.older(text):
            taken.append((a, b))
            word = words
            single = cipher == FREE or cipher.split("<")[0] not in WIDE
            if single:
                around = " " + word + " "
                for i, (c, x) in enumerate(zip(word, self._letters(word, cipher))):
                    if ord(c) > 127:
                        yield cipher, c, x, around[i], around[i + 2]
            else:
                units = self.units(word, cipher)
                for i, (u, x) in enumerate(units):
                    yield cipher, u, x, letter_class(units[i - 1][1][-1:] or " ") if i else " ", letter_class(units[i + 1][1][:1] or " ") if i + 1 < len(units) else " "
        for a, b, code, depth, plain in self.runs(text):
            if any(a < d and c < b for c, d in taken) or not self.known(plain):
                continue
            before, after = letter_class(text[a - 1 : a] or " "), letter_class(text[b : b + 1] or " ")
            for i, letter in enumerate(plain):
                yield (
                    f"{code}/{depth}", self.pages.unit(letter, code, depth), letter,
                    letter_class(plain[i - 1]) if i else before, letter_class(plain[i + 1]) if i + 1 < len(plain) else after,
                )
        for a, b, code, units in self.wide_runs(text):
            before, after = letter_class(text[a - 1 : a] or " "), letter_class(text[b : b + 1] or " ")
            kept = [(u, x) for u, x in units if x.strip(LOST + "?")]
            for i, (u, x) in enumerate(kept):
                yield (
                    code, u, x, letter_class(kept[i - 1][1][-1]) if i else before, letter_class(kept[i + 1][1][0]) if i + 1 < len(kept) else after,
                )

    def _letters(self, word: str, cipher: str) -> str:
        if cipher == FREE:
            return word
        e, d = cipher.split("<")
        old, table = self.pages.chars[e], self.pages.bytes[d]
        return "".join(c if ord(c) < 128 else old[table[c]] if c in table else LOST for c in word)

    def older(self, text: str) -> Iterator[tuple[int, int, str, str]]:
        """Words that read badly, with the pair of pages that reads their line best."""
        at = 0
        for line in text.split("\n"):
            if not line.isascii():
                places = [(a, b, s) for a, b, s in self.words(line) if not quoted(line, a, b)]
                strange = [line[a:b] for a, b, s in places if s]
                cipher = self.cipher(strange) if strange else ""
                for a, b, s in places if cipher else ():
                    word = line[a:b]
                    if s and self.dense(word) if cipher == FREE else self.gain(word, cipher) > WORD_GAIN:
                        yield at + a, at + b, cipher, word
            at += len(line) + 1


# ---- the model of letters


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    pages = Pages()

    @lru_cache(200_000)
    def cut(run: str) -> str:
        """Nothing in place of a run that is wholly UTF-8 under a page, of characters in wide use."""
        found = pages.read(run) if len(run) > 1 else ()
        return "\n" if any(b - a == len(run) and _IN_USE.fullmatch(plain) for a, b, _, _, plain in found) else run

    for batch in batches:
        texts = [t if t.isascii() else _HIGH.sub(lambda m: cut(m.group()), t) for t in map(_plain_entities, batch["text"])]
        codes = np.frombuffer(("\n" + "\n".join(texts)).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        seen = np.bincount(codes)
        present = np.flatnonzero(seen)
        classes: dict[str, int] = {}
        to_class = np.zeros(len(seen), dtype=np.int64)
        for c in present:
            to_class[c] = classes.setdefault(letter_class(chr(c)), len(classes))
        ids = to_class[codes]
        names, k = list(classes), len(classes)
        pairs = np.bincount(ids[:-1] * k + ids[1:], minlength=k * k)
        rows = [(names[p // k], names[p % k], int(pairs[p])) for p in np.flatnonzero(pairs)]
        rows += [(None, chr(c), int(seen[c])) for c in present if len(letter_class(chr(c))) > 1]
        yield pd.DataFrame(rows, columns=["a", "b", "n"])


def letter_model(documents: DataFrame) -> Model:
    """The bigram model of all texts, without the runs that some page would explain.

    Its tables are collected: at most a row per pair of about a thousand classes and per character of Unicode.
    """
    texts = documents.select("text").filter(F.length("text") > 0)
    counted = texts.mapInPandas(_count, "a string, b string, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    bigrams, singles = {}, {}
    for r in counted.toLocalIterator():
        if r.a is None:
            singles[r.b] = r.n
        else:
            bigrams[(r.a, r.b)] = r.n
    return Model(bigrams, singles)


# ---- the table of units


def _suspect(model_of):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(model_of.value)
        for batch in batches:
            out = []
            for doc, source, text in zip(batch["doc_id"], batch["__source"], batch["text"]):
                if text.isascii() and "&" not in text:
                    continue
                text = _plain_entities(text)
                found = Counter(reader.suspects(text))
                if found or LOST in text or _FLAT.search(text) or _STRAY.search(text):
                    out.append((doc, source, text, [(*u, n) for u, n in found.items()]))
            yield pd.DataFrame(out, columns=["doc_id", "__source", "text", "units"])

    return read


def _learn(model_of):
    """EM for one source and cipher over its distinct units in context."""

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        model: Model = model_of.value
        source, cipher = group["__source"].iloc[0], group["cipher"].iloc[0]
        single = cipher == FREE or "<" in cipher and cipher.split("<")[0] not in WIDE
        rows = (_learn_key if single else _learn_units)(model, cipher, group)
        return pd.DataFrame([(source, cipher, *r) for r in rows], columns=["source", "cipher", "unit", "letter", "p", "n"])

    return learn


def _learn_key(model: Model, cipher: str, group: pd.DataFrame) -> list[tuple]:
    """A cipher of one character for one letter: a free table, from the letters of the pages or from random keys."""
    pairs: Counter = Counter()
    counts: Counter = Counter()
    start = {}
    for u, x, b, a, n in zip(group["unit"], group["letter"], group["before"], group["after"], group["n"]):
        pairs[(b, u)] += n
        counts[u] += n
        if a.isascii():
            pairs[(u, a)] += n
        if cipher != FREE and x != LOST:
            start[u] = x.lower() if len(x.lower()) == 1 else x
    key = learn_key(pairs, sorted(counts), start, model)
    gains = key.gains(pairs, model)
    if sum(gains.values()) - key.price(start, len(model.alphabet())) < CIPHER_GAIN + (FREE_GAIN * len(pairs) if cipher == FREE else 0):
        return []
    shown = dict(zip(group["unit"], group["letter"]))
    out = []
    for u, x in key.letters.items():
        was = shown[u]
        letter = was if cipher != FREE and letter_class(was) == letter_class(x) else x
        p = key.sure[u] if gains.get(u, 0) > 0 else 0.0
        out.append((u, letter, p, counts[u]))
    return out


def _learn_units(model: Model, cipher: str, group: pd.DataFrame) -> list[tuple]:
    """A cipher whose units are several characters: whether each stands for its letter, weighed over all its contexts."""
    n = group["n"].to_numpy(float)
    plain = np.array([model.path(b, x.replace(LOST, "").replace("?", "") or x, a) for b, x, a in zip(group["before"], group["letter"], group["after"])])
    as_is = np.array([model.path(b, u, a) for b, u, a in zip(group["before"], group["unit"], group["after"])])
    gain = np.clip(plain - as_is, -60, 60)
    pair, pairs = pd.factorize(group["unit"] + "\x1f" + group["letter"])
    weight, fits = 0.5, np.full(len(pairs), 0.5)
    for _ in range(ROUNDS):
        odds = gain + np.log(weight / (1 - weight)) + np.log(fits[pair] / (1 - fits[pair]))
        p = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        weight = float(np.clip((p @ n + 0.5) / (n.sum() + 1), 0.02, 0.98))
        fits = np.clip((np.bincount(pair, p * n) + 0.5) / (np.bincount(pair, n) + 1), 0.02, 0.98)
    sure, whole = np.bincount(pair, p * n), np.bincount(pair, n)
    return [(*pairs[i].split("\x1f"), float(sure[i] / whole[i]), int(whole[i])) for i in range(len(pairs))]


def learned_units(documents: DataFrame) -> tuple[DataFrame, DataFrame, Model]:
    """Per source and cipher what each unit stands for, ``source, cipher, unit, letter, p, n``; the suspect texts with
    their units; and the letter model."""
    model = letter_model(documents)
    sent = documents.sparkSession.sparkContext.broadcast(model)
    named = documents.withColumn("__source", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    texts = named.select("doc_id", "__source", "text").filter((F.length("text") > 0) & F.col("doc_id").isNotNull())
    suspect = written(texts.mapInPandas(_suspect(sent), f"doc_id long, __source string, text string, units {UNITS}"), "suspect")
    units = suspect.select("__source", F.inline("units"))
    types = units.groupBy("__source", "cipher", "unit", "letter", "before", "after").agg(F.sum("n").alias("n"))
    table = types.groupBy("__source", "cipher").applyInPandas(_learn(sent), "source string, cipher string, unit string, letter string, p double, n long")
    return table, suspect, model


# ---- restoring by the table


def restore(text: str, reader: Reader, table: dict[str, dict[str, str]]) -> tuple[str, int, int]:
    """The restored text, the number of garbled runs and how many of them are lost."""
    model = reader.model
    taken: list[tuple[int, int, str]] = []
    keys = {c: str.maketrans({u: x for u, x in t.items() if len(u) == 1}) for c, t in table.items() if c == FREE or "<" in c and c.split("<")[0] not in WIDE}
    at = 0
    for line in text.split("\n"):
        places = [] if line.isascii() else [(a, b) for a, b, _ in reader.words(line) if not quoted(line, a, b)]
        best, whole = [], 0.0
        for cipher in table if places else ():
            if cipher not in keys and "<" not in cipher:
                continue
            read, total = [], 0.0
            for a, b in places:
                word = line[a:b]
                plain = word.translate(keys[cipher]) if cipher in keys else by_units(reader.units(word, cipher), word, table[cipher])
                if plain is None or plain == word:
                    continue
                gain = reader.worth(plain) - model.path(" ", word, " ")
                if cipher == FREE:  # the model has learned these words as they stand, so they are judged by how they read
                    gain = reader.worth(plain) - UNREADABLE * (len(word) + 1) if reader.strange(word) else 0.0
                if gain > WORD_GAIN:
                    read.append((at + a, at + b, plain))
                    total += gain
            if total > whole:
                best, whole = read, total
        taken += best
        at += len(line) + 1
    runs = [(a, b, f"{code}/{depth}", [(reader.pages.unit(c, code, depth), c) for c in plain]) for a, b, code, depth, plain in reader.runs(text)]
    wide = [(a, b, code, list(units)) for a, b, code, units in reader.wide_runs(text)]
    order = {n: i for i, n in enumerate(reader.names)}
    for a, b, cipher, units in sorted(runs + wide, key=lambda r: (r[0] - r[1], -int(r[2].partition("/")[2] or 0), order.get(r[2].split("/")[0], 99))):
        if any(a < d and c < b for c, d, _ in taken) or quoted(text, a, b):
            continue
        known = table.get(cipher, {})
        if cipher in WIDE:
            plain = by_units(units, text[a:b], known)
            before, after = text[a - 1 : a] or " ", text[b : b + 1] or " "
            kept = (plain or "").replace(LOST, "").replace("?", "")
            if plain and kept and model.path(before, kept, after) / len(kept) > model.path(before, text[a:b], after) / (b - a):
                taken.append((a, b, plain))
            continue
        if all(u in known for u, _ in units):
            taken.append((a, b, "".join(known[u] for u, _ in units)))
    for m in _FLAT.finditer(text):  # the second byte, a no-break space, became a plain one
        if not any(c <= m.start() < d for c, d, _ in taken):
            taken.append((m.start(), m.end(), "à" if m.group(1) else "à "))
    lost = sum(not quoted(text, m.start(), m.end()) for m in re.finditer(LOST + "+", text) if not any(c <= m.start() < d for c, d, _ in taken))
    lost += sum(LOST in p for _, _, p in taken)
    swap = {}
    for m in _STRAY.finditer(text):  # bytes of the common Windows page, taken for Latin-1
        c = bytes([ord(m.group())]).decode("cp1252", "ignore")
        if c and not any(x <= m.start() < y for x, y, _ in taken) and not quoted(text, m.start(), m.end()):
            swap[ord(m.group())] = c
    for a, b, plain in sorted(taken, reverse=True):
        text = text[:a] + plain + text[b:]
    return text.translate(swap), len(taken) + lost + len(swap), lost


def by_units(units: list[tuple[str, str]], text: str, known: dict[str, str]) -> str | None:
    """``text`` with its units replaced by the table; the pages' letters stand in for single units it lacks, if it has most."""
    if not units or 2 * sum(known.get(u) is not None for u, _ in units) <= sum(x.strip(LOST + "?") != "" for _, x in units):
        return None
    out, at = [], 0
    for u, x in units:
        i = text.index(u, at)
        out += [text[at:i], known.get(u, x)]
        at = i + len(u)
    return "".join([*out, text[at:]])


def restored(documents: DataFrame) -> DataFrame:
    """The affected documents: ``doc_id, garbled_runs, lost_runs, text`` with everything restored that can be."""
    learned, suspect, model = learned_units(documents)
    sent = documents.sparkSession.sparkContext.broadcast(model)
    key = ["__source", "cipher", "unit"]
    named = suspect.withColumn("__doc", F.xxhash64("doc_id", "text"))
    held = named.select("__doc", "__source", F.inline("units")).select("__doc", *key).distinct()
    best = learned.filter(F.col("p") > 0.5).groupBy(F.col("source").alias("__source"), "cipher", "unit").agg(F.max_by("letter", F.struct("n", "letter")).alias("letter"))
    tables = held.join(best, key).groupBy("__doc").agg(F.collect_list(F.struct("cipher", "unit", "letter")).alias("table"))

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(sent.value)
        for batch in batches:
            out = []
            for doc, text, rows in zip(batch["doc_id"], batch["text"], batch["table"]):
                table: dict[str, dict[str, str]] = defaultdict(dict)
                for r in rows if rows is not None else ():
                    table[r["cipher"]][r["unit"]] = r["letter"]
                whole, n, lost = restore(text, reader, dict(table))
                if n:
                    out.append((doc, n, lost, whole))
            yield pd.DataFrame(out, columns=["doc_id", "garbled_runs", "lost_runs", "text"])

    joined = named.join(tables, "__doc", "left").select("doc_id", "text", "table")
    return joined.mapInPandas(apply, "doc_id long, garbled_runs int, lost_runs int, text string")
