"""Substitution ciphers learned from how letters follow each other.

A cipher turned every letter into a unit of its own. What is known of the garbled text is how often each unit stands
between which neighbours; the key, which letter a unit stands for, is the hidden variable. Expectation-maximization keeps
for every unit a distribution over all letters (the free table), weighs every letter by the bigrams that it would form
with the neighbours as they are believed at present, and sets the distribution anew, first softly, then sharply. A code
page may give the letters to start from; without one the table starts from several random keys and the best is kept.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from functools import lru_cache

import numpy as np

RESTARTS = 24
FINALISTS = 4  # keys of the best restarts that are refined
ROUNDS = 40
SHARED = 25.0  # nats that a letter of two units costs: a cipher turns each letter into a unit of its own, but for case
PLAIN_LEAST = 9.0  # nats beyond which strangeness of plain text is no further evidence
START = 0.98  # belief in the letter of the starting page
_FLOOR = 0.002  # chance of a letter after a little known one of its script
_KNOWN = 200  # occurrences from which a letter is known


@lru_cache(200_000)
def letter_class(c: str) -> str:
    """The class of a character in the bigram model: itself where scripts are small, else its kind; classes stay as they are."""
    if len(c) > 1:
        return c
    o = ord(c)
    if c.isspace():
        return " "
    if o < 128:
        return "0" if c.isdigit() else c.lower()
    if 0x4E00 <= o <= 0x9FFF or 0x3400 <= o <= 0x4DBF:
        return "<han>"
    if 0x3040 <= o <= 0x309F:
        return "<hira>"
    if 0x30A0 <= o <= 0x30FF:
        return "<kata>"
    if 0xAC00 <= o <= 0xD7A3:
        return "<hangul>"
    if o < 0x250 or 0x370 <= o < 0x500 or 0x2010 <= o < 0x2070:
        return c.lower()
    return "<" + unicodedata.category(c) + ">"


@lru_cache(20_000)
def script(c: str) -> str:
    """The script of a letter, by its name; empty for other characters."""
    return unicodedata.name(c, "").split(" ")[0] if len(c) == 1 and c.isalpha() else ""


class Model:
    """Bigrams of classes, and for collapsed classes their characters; small by the number of classes and characters."""

    def __init__(self, bigrams: dict[tuple[str, str], int], singles: dict[str, int]):
        self.bigrams, self.singles = bigrams, singles
        self.after: Counter = Counter()
        self.before: Counter = Counter()
        self.kinds: Counter = Counter()
        for (a, b), n in bigrams.items():
            self.after[a] += n
            self.before[b] += n
        for c, n in singles.items():
            self.kinds[letter_class(c)] += n
        self.total = sum(self.before.values())
        self.known: dict[tuple[str, str], float] = {}

    def step(self, a: str, b: str, of_class: bool = False) -> float:
        """Log probability of ``b``, or of its class only, after ``a``, leaning on how common ``b`` is where the pair is rare."""
        x, y = letter_class(a), letter_class(b)
        alone = (self.before.get(y, 0) + 0.01) / (self.total + 20)
        if not b.isascii() and script(b) and script(a) == script(b) and self.after.get(x, 0) < _KNOWN:
            alone = max(alone, _FLOOR)
        p = math.log((self.bigrams.get((x, y), 0) + 4 * alone) / (self.after.get(x, 0) + 4))
        if y[0] == "<" and len(y) > 1 == len(b) and not of_class:
            p += math.log((self.singles.get(b, 0) + 0.02) / (self.kinds.get(y, 0) + 0.02 * 8000))
        if b.isupper() and a.islower():
            p -= 1.5
        return p

    def link(self, a: str, b: str) -> float:
        p = self.known.get((a, b))
        if p is None:
            p = self.step(a, b)
            if len(self.known) < 2_000_000:
                self.known[(a, b)] = p
        return p

    def path(self, before: str, text: str, after: str) -> float:
        total, last, known = 0.0, before, self.known
        for c in (*text, after):
            p = known.get((last, c))
            total += self.link(last, c) if p is None else p
            last = c
        return total

    def matrix(self, left: list[str], right: list[str]) -> np.ndarray:
        """Log probabilities of every character of ``right`` after every one of ``left``, as ``link`` gives them."""
        rows: dict[str, list[int]] = {}
        columns: dict[str, list[int]] = {}
        for i, c in enumerate(left):
            rows.setdefault(letter_class(c), []).append(i)
        for j, c in enumerate(right):
            columns.setdefault(letter_class(c), []).append(j)
        counts = np.zeros((len(left), len(right)))
        for (a, b), n in self.bigrams.items():
            if a in rows and b in columns:
                counts[np.ix_(rows[a], columns[b])] = n
        classes = [letter_class(c) for c in right]
        alone = np.array([(self.before.get(y, 0) + 0.01) / (self.total + 20) for y in classes])
        after = np.array([self.after.get(letter_class(c), 0) for c in left])
        of = lambda side: np.array([script(c) for c in side], dtype=object)
        foreign = np.array([bool(script(c)) and not c.isascii() for c in right], dtype=bool)
        little = (of(left)[:, None] == of(right)[None, :]) & foreign[None, :] & (after < _KNOWN)[:, None]
        alone = np.where(little, np.maximum(alone, _FLOOR)[None, :], alone[None, :])
        out = np.log((counts + 4 * alone) / (after[:, None] + 4))
        for j, (c, y) in enumerate(zip(right, classes)):
            if y[0] == "<" and len(y) > 1 == len(c):
                out[:, j] += math.log((self.singles.get(c, 0) + 0.02) / (self.kinds.get(y, 0) + 0.02 * 8000))
        lower, upper = np.array([c.islower() for c in left], dtype=bool), np.array([c.isupper() for c in right], dtype=bool)
        return out - 1.5 * (lower[:, None] & upper[None, :])

    def alphabet(self) -> list[str]:
        """The letters beyond ASCII that the model has seen more than once."""
        return sorted(c for c, n in self.before.items() if len(c) == 1 and ord(c) > 127 and n > 1)

    def __getstate__(self):
        return self.bigrams, self.singles

    def __setstate__(self, state):
        self.__init__(*state)


class Key:
    """A learned key: per unit its letter and how sure it is."""

    def __init__(self, letters: dict[str, str], sure: dict[str, float]):
        self.letters, self.sure = letters, sure

    def gains(self, pairs: Counter, model: Model) -> dict[str, float]:
        """What each unit gains over itself as plain text, over its different neighbours; copies are no further evidence.

        As plain text a pair is judged by all other text: its occurrences in the cipher are taken out of the model.
        """
        own, after, before = Counter(), Counter(), Counter()
        for (a, b), n in pairs.items():
            x, y = letter_class(a), letter_class(b)
            own[(x, y)] += n
            after[x] += n
            before[y] += n
        out: Counter = Counter()
        for a, b in pairs:
            x, y = letter_class(a), letter_class(b)
            alone = (max(0, model.before.get(y, 0) - before[y]) + 0.01) / (model.total + 20)
            rest = max(0, model.bigrams.get((x, y), 0) - own[(x, y)]), max(0, model.after.get(x, 0) - after[x])
            plain = math.log((rest[0] + 4 * alone) / (rest[1] + 4))
            hidden = [c for c in (a, b) if c in self.letters]
            for c in hidden:
                gain = model.link(self.letters.get(a, a), self.letters.get(b, b)) - max(plain, -PLAIN_LEAST)
                out[c] += gain / len(hidden)
        return dict(out)

    def price(self, start: dict[str, str], letters: int) -> float:
        """The price of the letters that were chosen and not given."""
        return sum(start.get(u) != x for u, x in self.letters.items()) * math.log(max(2, letters))


def learn_key(pairs: Counter, units: list[str], start: dict[str, str], model: Model, seed: int = 7) -> Key:
    """The key of a cipher from how often characters follow each other in it.

    ``pairs`` counts neighbours, of which those in ``units`` are hidden and all others plain; ``start`` gives the letters
    to start from, none to start from random keys.
    """
    letters = sorted(set(model.alphabet()) | set(start.values()))
    plain = sorted({c for p in pairs for c in p if c not in set(units)})
    at = {c: i for i, c in enumerate([*units, *plain])}
    k, m = len(units), len(letters)
    if not k or not m:
        return Key({}, {})
    counts = np.zeros((len(at), len(at)), dtype=np.float64)
    for (a, b), n in pairs.items():
        counts[at[a], at[b]] += n
    inner = model.matrix(letters, letters).astype(np.float64)
    fixed = counts[k:, :k].T @ model.matrix(plain, letters) + counts[:k, k:] @ model.matrix(letters, plain).T if plain else np.zeros((k, m))
    within = counts[:k, :k]
    own = np.diagonal(within).copy()
    held = np.full((k, m), math.log((1 - START) / max(1, m - 1)))
    where = {c: i for i, c in enumerate(letters)}
    for i, u in enumerate(units):
        if u in start:
            held[i, where[start[u]]] = math.log(START)
    if not start:
        held[:] = 0.0

    def settle(q: np.ndarray) -> np.ndarray:
        for r in range(ROUNDS):
            field = fixed + within.T @ q @ inner + within @ q @ inner.T + held
            field -= own[:, None] * (q @ inner + q @ inner.T)  # a unit beside itself is one letter, not two
            field += own[:, None] * np.diagonal(inner)[None, :]
            sharp = min(1.0, 0.05 * 1.12**r) if not start else 1.0
            field = sharp * (field - field.max(axis=1, keepdims=True))
            new = np.exp(field)
            new /= new.sum(axis=1, keepdims=True)
            moved = np.abs(new - q).max()
            q = 0.5 * q + 0.5 * new
            if moved < 1e-4 and sharp == 1.0:
                break
        return q

    def worth(best: np.ndarray) -> float:
        shared = k - len(set(best.tolist()))
        return float(fixed[np.arange(k), best].sum() + (within * inner[np.ix_(best, best)]).sum() + held[np.arange(k), best].sum()) - SHARED * shared

    def climb(best: np.ndarray) -> np.ndarray:
        """Gives single units their best letter beside all others in turn, until nothing moves: what EM leaves on a ledge."""
        diagonal = np.diagonal(inner)
        for _ in range(20):
            moved = False
            for i in range(k):
                out, into = within[i].copy(), within[:, i].copy()
                out[i] = into[i] = 0
                field = fixed[i] + held[i] + into @ inner[best] + inner[:, best] @ out + own[i] * diagonal
                field -= SHARED * np.isin(np.arange(m), np.delete(best, i))
                x = int(field.argmax())
                if field[x] > field[best[i]] + 1e-9:
                    best[i], moved = x, True
            if not moved:
                break
        return best

    def swap(best: np.ndarray) -> np.ndarray:
        """Lets two units exchange their letters while the whole gains by it."""
        value, before = worth(best), -np.inf
        while value > before + 1e-9:
            before = value
            for i in range(k):
                for j in range(i):
                    trial = best.copy()
                    trial[i], trial[j] = best[j], best[i]
                    if (v := worth(trial)) > value + 1e-9:
                        best, value = trial, v
            best = climb(best)
            value = worth(best)
        return best

    if start:
        q = np.exp(held)
        q = settle(q / q.sum(axis=1, keepdims=True))
        best = q.argmax(axis=1)
    else:
        rng, found = np.random.default_rng(seed), []
        for _ in range(RESTARTS):
            trial = climb(settle(rng.dirichlet(np.ones(m), size=k)).argmax(axis=1))
            found.append((worth(trial), tuple(trial)))
        best = max((swap(np.array(t)) for _, t in sorted(found, reverse=True)[:FINALISTS]), key=worth)
        q = np.zeros((k, m))
        q[np.arange(k), best] = 1.0
    key = {u: letters[best[i]] for i, u in enumerate(units)}
    return Key(key, {u: float(q[i, best[i]]) for i, u in enumerate(units)})
