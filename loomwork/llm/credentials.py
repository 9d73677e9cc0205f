"""Credentials in code, configuration and prose: where they stand, and the text with only their values masked.

Text is read as lexical tokens: names, operators, quoted and bare literals. A literal counts if it is assigned or passed to
a name whose last words mean a credential, follows an authorisation scheme, stands as the password of an address, has the
form that an issuer gives its keys, or is a private key block; placeholders, references, masked values, plain numbers and
words do not. Masking replaces the literal's own characters, never its quotes, escapes or name.

Results for odd input: null texts, blocks and messages hold nothing; a value found by several rules counts once, the widest
reading winning; a private key without its END line is no block; a row delivered several times counts once.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.lexer import Token, masked_literal, tokens

# Words that end the name of a credential, alone or as a pair.
ALONE = {"password", "passwd", "pwd", "passphrase", "passwort", "secret", "token", "apikey", "authtoken", "credential", "credentials", "auth", "secretkey", "accesskey", "accountkey", "privatekey", "pat"}
PAIRS = {("api", "key"), ("secret", "key"), ("access", "key"), ("private", "key"), ("signing", "key"), ("account", "key"), ("auth", "key"), ("encryption", "key"), ("master", "key"), ("service", "key"), ("deploy", "key"), ("shared", "key"), ("storage", "key"), ("webhook", "key"), ("client", "key"), ("license", "key"), ("hmac", "key"), ("session", "key"), ("admin", "pass"), ("db", "pass"), ("user", "pass"), ("root", "pass")}
# Words after a credential's name that tell several apart; words that end in pass and mean none; callees whose second argument is a password.
QUALIFIERS = {"v", "base", "old", "new", "prod", "dev", "staging"}
NO_PASS = {"bypass", "compass", "surpass", "overpass", "underpass"}
SIGN_IN = {"login", "signin", "authenticate", "log_in", "sign_in"}
# Forms of keys that issuers give out.
_FORMS = (
    (r"(?:AKIA|ASIA)", r"[0-9A-Z]{16}"), (r"gh[pousr]_", r"[A-Za-z0-9]{30,}"), (r"github_pat_", r"[A-Za-z0-9_]{30,}"), (r"glpat-", r"[A-Za-z0-9_-]{18,}"), (r"npm_", r"[A-Za-z0-9]{30,}"),
    (r"pypi-", r"[A-Za-z0-9_-]{30,}"), (r"sk-", r"(?:[A-Za-z0-9]+-)*[A-Za-z0-9_]{20,}"), (r"(?:sk|pk|rk|pk\d)_(?:live|test)_", r"[A-Za-z0-9]{16,}"), (r"xox[abeoprs]-", r"[A-Za-z0-9-]{10,}"), (r"AIza", r"[0-9A-Za-z_-]{35}"),
    (r"hf_", r"[A-Za-z0-9]{30,}"), (r"SG\.", r"[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}"), (r"dop_v1_", r"[0-9a-f]{40,}"), (r"eyJ", r"[A-Za-z0-9_-]{5,}\.eyJ[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]{8,}"),
)
ISSUED = "|".join(start + rest for start, rest in _FORMS)
# What a text needs for each rule. A name's last word may be cut in two (``pass_word``) and no letter follows it; the last word of a pair stands whole.
_NAMES = sorted("[^a-z\\s]*".join(w) + "(?![a-z])" for w in ALONE) + sorted({w for _, w in PAIRS})
_SIGNS = ["pass", *sorted(SIGN_IN), "pwd", "secret", "token", "auth", "bearer", "basic", "credential", "://", r"-u[ \t=]", "--(?:proxy-)?user"]
#: A text without any of these holds no credential.
HINT = "(?i)" + "|".join(dict.fromkeys([*_SIGNS, *_NAMES, *(start.replace(r"\d", ".") for start, _ in _FORMS)]))

_QUOTE = r"""\\*["'`]"""
_LINE = r"(?:[ \t]*(?:\d+→|[\w./-]+:\d+:))?"
_BARE = re.compile(r"""[^\s"'`,;|(){}\[\]<>&\\]+""")
_OPTION = re.compile(rf"""(?<!\S)--?(?P<name>[A-Za-z][\w-]*)[ \t]+(?:(?P<q>{_QUOTE})(?P<inner>(?:(?!(?P=q))[^\n])*?)(?P=q)|(?P<bare>[^\s"'`,;|(){{}}\[\]<>&\\-][^\s"'`,;|(){{}}\[\]<>&\\]*))""")
_SPOKEN = re.compile(
    r"""(?i)(?<![\w.-])(?:pass(?:word|wd|phrase)|pwd|secret(?:[ _]key)?|(?:access|auth|api|refresh|bearer)[ _-]?(?:token|key)|token|credentials?)(?=[ \t(:=|])"""
    r"""(?:[ \t]*\([^()\n]{0,60}\))?(?:[ \t]+(?:for|of|to|on)[ \t]+(?:[\w.'-]+[ \t]+){1,6}?(?=(?:is|was|=|:)))?[ \t]*(?:\b(?:is|was)\b|:|=|\|)?[ \t]*(?:now[ \t]+)?[`'"*]{0,2}(?P<bare>[^\s`"|<>()\[\]{},;]{6,})"""
)
_SCHEME = re.compile(r"""(?i)(?<![\w-])(?:(?P<head>(?:proxy-)?authorization)["']?[ \t]*[:=]?[ \t]*\\*["']?[ \t]*)?(?P<scheme>bearer|basic|token|apikey|digest)[ \t]+(?P<bare>[A-Za-z0-9+/=_.~:-]{8,})""")
_ADDRESS = re.compile(r"""(?i)\b[a-z][a-z0-9+.-]*://(?P<user>[^\s:/@"'`<>]*):(?P<bare>[^\s/@"'`<>]+)@""")
_USER = re.compile(r"""(?<!\S)(?:-u|--user|--proxy-user)(?:[ \t]+|=)(?:[\w.@-]+:(?:(?P<q>["'])(?P<inner>[^"'\n]+)(?P=q)|(?P<bare>[^\s"'`]+))|(?P<q2>["'])[\w.@-]+:(?P<inner2>[^"'\n]+)(?P=q2))""")
_TAG = re.compile(r"<(?P<name>[A-Za-z][\w.-]*)>(?P<inner>[^<>\n]+)</(?P=name)>")
_ENTRY = re.compile(rf"""(?m)\bname:[ \t]*["']?(?P<name>[A-Za-z_][\w.-]*)["']?[ \t]*\n{_LINE}[ \t-]*value:[ \t]*(?:(?P<q>["'])(?P<inner>[^"'\n]+)(?P=q)|(?P<bare>[^\s"'`]+))""")
_ISSUED = re.compile(rf"(?<![A-Za-z0-9_.+/-])(?:{ISSUED})(?![A-Za-z0-9_+/-])|(?<=[\\/]n)(?:{ISSUED})(?![A-Za-z0-9_+/-])")
_BLOCK = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----.*?-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----", re.DOTALL)

_ASSIGN = ("=", ":", ":=", "=>", "==")
_INSIDE = re.compile(r"[=:(]")  # what a literal needs to hold an assignment or a call
_USED = re.compile(r"[ \t]*(?:\.\w|\[)")  # a literal of which something else is made
_NAME = re.compile(r"[A-Za-z_$][\w$.-]*")
_PASSWORD = re.compile(r"(?i)pass|pwd")
_PLAIN_ESCAPE = re.compile(r"\\([\"'`\\/])")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_STAND_IN = re.compile(
    r"""(?ix)^(?: \$\{?[a-z_]\w*\}? | [{<\[(] .* | %[a-z_]\w*% | .*(?:\$\{|\{\{|\$\(|%\() .* | [x*.•·_#?-]+ | .*(?:\*{3,}|…|\.{3,}|x{6,}|•{3,}) .*
    | your[-_ ].* | (?:insert|replace|enter|put)[-_ ](?:me|my|your|the|here|this).* | change[-_]?me.* | placeholder.* | redacted.* | dummy.* | todo.*
    | none | null | nil | true | false | undefined | n/a | example | string | secret | password | token | [\d.,:+\s-]+ | 0x[0-9a-f]+ )$"""
)
_REFERENCE = re.compile(r"[a-z_$]\w*(?:(?:\.|::|->|\?\.)[A-Za-z_]\w*)+$")  # a member of something, not a literal
_WORDLIKE = re.compile(r"_?[A-Za-z]?[a-z]*(?:_?[A-Z]?[a-z]{2,})*_?\d{0,2}$")  # an identifier made of words
_PLACE = re.compile(r"[\w.-]*/[\w./-]*(?::\d+)*$|[\w.-]+\.(?:py|tsx?|jsx?|go|rs|md|json|ya?ml|sh|sql|toml|txt|java|c|h|css|html|ini|cfg|lock|log)(?::\d+)*$")  # a file, maybe with line and column


@lru_cache(100_000)
def names_credential(name: str) -> bool:
    """Whether the last word or words of a name mean a credential; words and numbers that tell versions apart don't matter."""
    words = [w.lower() for w in _WORDS.findall(name)]
    while len(words) > 1 and (words[-1].isdigit() or words[-1] in QUALIFIERS):
        words.pop()
    if not words:
        return False
    return words[-1] in ALONE or tuple(words[-2:]) in PAIRS or "".join(words[-2:]) in ALONE or len(words[-1]) > 4 and words[-1].endswith("pass") and words[-1] not in NO_PASS


def is_place(value: str) -> bool:
    """Whether a value is a file or folder, and no key of random letters in which slashes happen to stand."""
    if not _PLACE.match(value):
        return False
    parts = re.split(r"[/=]", value)
    return "." in value or len(value) < 32 or all(_WORDLIKE.match(p) for p in parts if len(p) >= 6) or not any(c.isdigit() for c in value)


def is_value(text: str, quoted: bool, name: str = "") -> bool:
    """Whether a literal can be a credential: neither a stand-in nor a plain number or word."""
    text = _PLAIN_ESCAPE.sub(lambda m: m.group(1), text) if "\\" in text else text
    if len(text) < 4 or not text.isprintable() or _STAND_IN.match(text):
        return False
    letters = any(c.isalpha() for c in text)
    digits = any(c.isdigit() for c in text)
    odd = any(c in "!#$%^&*~?" for c in text[:-1])
    mixed = any(c.islower() for c in text) and any(c.isupper() for c in text)
    if any(c.isspace() for c in text):  # a pass phrase: a few words with digits and signs, and nothing that reads as a sentence
        return quoted and letters and digits and odd and len(text) >= 10 and len(text.split()) <= 4 and bool(_PASSWORD.search(name))
    if len(text) < 6:
        return quoted and letters and digits and bool(_PASSWORD.search(name))
    if letters and digits:
        return len(text) >= (6 if quoted else 8)
    if odd and letters and (mixed and len(text) >= 10 or quoted and len(text) >= 8):
        return True
    return quoted and mixed and len(text) >= 16 and text.isalnum() and not _WORDLIKE.match(text)


def _user_and_password(value: str) -> bool:
    """Whether a value is an encoded user and password."""
    try:
        return b":" in base64.b64decode(value, validate=True)[1:]
    except ValueError:
        return False


def assigned(text: str, start: int = 0, end: int | None = None) -> list[tuple[int, int]]:
    """Literals that are assigned or passed to a credential-named identifier, by the tokens of the text.

    A literal that doesn't count is read again for what it holds itself.
    """
    found: list[tuple[int, int]] = []
    row = list(tokens(text, start, end))
    row += [Token("op", -1, -1, -1, -1)] * 4  # so that looking ahead never leaves the row
    said = lambda t: text[t.start : t.end] if t.start >= 0 else "\n"
    taken: set[int] = set()

    def literals(i: int, name: str, closing: str = "") -> None:
        """Takes the literal at ``i`` and those joined to it; up to ``closing`` all that are no keys."""
        depth = 0
        while i < len(row) - 4:
            t = row[i]
            if t.kind == "literal":
                if said(row[i + 1]) not in (":", "=>") and not _USED.match(text, t.close) and counts(t, name):
                    found.append((t.start, t.end))
                    taken.add(i)
            elif not closing and said(t) != "+":
                return
            elif t.kind == "op":
                depth += (said(t) in "([{") - (said(t) in ")]}")
                if depth < 0 or closing and said(t) == "\n" and closing == ")":
                    return
            i += 1

    def counts(t: Token, name: str) -> bool:
        value = text[t.start : t.end]
        return "://" not in value and is_value(value, True, name) and not (said(t) and _WORDLIKE.match(value) and not _PASSWORD.search(name))

    for i, t in enumerate(row[:-4]):
        key = t.kind == "literal" and t.end - t.start <= 60 and i not in taken and _NAME.fullmatch(text, t.start, t.end)
        if not key and t.kind != "name" or not names_credential(said(t)):
            if t.kind == "name" and said(row[i + 1]) == "(" and said(t).rpartition(".")[2].lower() in SIGN_IN:
                row_of = [j for j in range(i + 2, min(i + 12, len(row) - 4)) if row[j].kind == "literal"]
                if len(row_of) >= 2 and all(said(row[j]) == "," for j in range(row_of[0] + 1, row_of[1])) and is_value(said(row[row_of[1]]), True, "password"):
                    found.append((row[row_of[1]].start, row[row_of[1]].end))
                    taken.add(row_of[1])
            continue
        name, j = said(t), i + 1
        if t.kind == "name" and t.outer and (text[t.outer - 1] in "\\" or text[t.outer - 1].isdigit()) and text[t.outer - 2 : t.outer] not in ("\\n", "\\t"):
            continue
        while said(row[j]) == "]" or said(row[j]) in "?!" and t.kind == "name":
            j += 1
        op = said(row[j])
        if op == ":" and row[j + 1].kind == "name" and said(row[j + 2]) == "=":
            j, op = j + 2, "="  # a type stands between
        if op == "(" and t.kind == "name":
            literals(j + 1, name, ")")
            continue
        if op not in _ASSIGN and not (op == "," and key):
            continue
        value = row[j + 1]
        if value.kind == "name" and said(value).lower() in ("b", "f", "r", "u", "rb", "br") and row[j + 2].kind == "literal" and row[j + 2].outer == value.close:
            literals(j + 2, name)
        elif value.kind == "literal":
            literals(j + 1, name)
        elif said(value) == "[" and op != ",":
            literals(j + 2, name, "]")
        elif value.start >= 0 and op != "," and said(value) != "\n" and t.kind != "literal" or value.kind == "other" and op != ",":
            m = _BARE.match(text, value.start)
            word = m.group() if m else ""
            if word and not (_WORDLIKE.match(word) or _REFERENCE.match(word) or is_place(word)) and text[m.end() : m.end() + 1] not in tuple("([{"):
                if "://" not in word and word.lower() not in ("bearer", "basic", "token") and is_value(word, False):
                    found.append(m.span())
    for i, t in enumerate(row[:-4]):
        if t.kind == "literal" and i not in taken and t.end - t.start >= 8 and _INSIDE.search(text, t.start, t.end):
            found += assigned(text, t.start, t.end)
    return found


def find(text: str) -> list[tuple[int, int]]:
    """Spans of all credentials in ``text``, in order and apart from each other."""
    spans: list[tuple[int, int]] = [m.span() for m in _BLOCK.finditer(text)]
    plain = list(spans)

    def add(m: re.Match, *groups: str, trim: bool = False) -> None:
        for g in groups:
            if m.group(g) is not None:
                a, b = m.span(g)
                if trim:
                    while b > a and text[b - 1] in ".,;:?)'\"*`\\":
                        b -= 1
                if is_value(text[a:b], g.startswith("inner")):
                    spans.append((a, b))

    spans += assigned(text)
    for m in _TAG.finditer(text):
        if names_credential(m.group("name")):
            add(m, "inner")
    for m in _OPTION.finditer(text):
        if names_credential(m.group("name")):
            add(m, "inner", "bare")
    for m in _ENTRY.finditer(text):
        if names_credential(m.group("name")):
            add(m, "inner", "bare")
    for m in _SPOKEN.finditer(text):
        value = m.group("bare").rstrip(".,;:!?'\"*`")
        if any(c.isdigit() for c in value) and "=" not in value[:-2] and "://" not in value and not is_place(value) and not _WORDLIKE.match(value) and not _REFERENCE.match(value):
            add(m, "bare", trim=True)
    for m in _SCHEME.finditer(text):
        value = m.group("bare").rstrip(".:")
        if m.group("head") or m.group("scheme").lower() in ("bearer", "basic"):
            if any(c.isdigit() for c in value) or value.endswith("=") or _user_and_password(value) or len(value) >= 20 and any(c.isupper() for c in value):
                a = m.start("bare")
                if m.group("head") or len(value) >= 16:
                    spans.append((a, a + len(value)))
    for m in _ADDRESS.finditer(text):
        a, b = m.span("bare")
        if not _STAND_IN.match(text[a:b]) and not text[a:b].isdigit() and not re.search(r"[{}$]", text[a:b]):
            spans.append((a, b))
    for m in _USER.finditer(text):
        add(m, "inner", "bare", "inner2")
    for m in _ISSUED.finditer(text):
        if not re.match(r"[*…]", text[m.end() : m.end() + 1]):
            spans.append(m.span())
    spans = sorted(set(spans), key=lambda s: (s[0] - s[1], s[0]))
    kept: list[tuple[int, int]] = []
    for a, b in spans:  # the widest reading wins
        if all(b <= c or a >= d for c, d in kept) and (text[a:b] or (a, b) in plain):
            kept.append((a, b))
    return sorted(kept)


def masked(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` with the values masked; their escapes, line breaks and what surrounds them stay."""
    out, at = [], 0
    for a, b in spans:
        out += [text[at:a], masked_literal(text[a:b])]
        at = b
    return "".join([*out, text[at:]])


def texts(subagent: DataFrame) -> DataFrame:
    """Every text of every block: ``row_id, block_no, part, value``; part is text, content or the item's number."""
    blocks = subagent.select("row_id", F.posexplode("message.content").alias("block_no", "b"))
    part = lambda name, value: F.struct(F.lit(name).cast("string").alias("part"), value.alias("value"))
    items = F.transform(F.coalesce(F.col("b.items"), F.array()), lambda i, n: F.struct(n.cast("string").alias("part"), i["text"].alias("value")))
    parts: Column = F.concat(F.array(part("text", F.col("b.text")), part("content", F.col("b.content"))), items)
    return blocks.select("row_id", "block_no", F.inline(F.filter(parts, lambda p: F.length(p["value"]) > 0)))


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for row, block, part, value in batch.itertuples(index=False, name=None):
            spans = find(value)
            if spans:
                out.append((row, block, part, [value[a:b] for a, b in spans], [a for a, _ in spans], masked(value, spans)))
        yield pd.DataFrame(out, columns=["row_id", "block_no", "part", "secrets", "starts", "masked"])


def scanned(subagent: DataFrame) -> DataFrame:
    """Texts that hold credentials: ``row_id, block_no, part, secrets, starts, masked``; starts count code points."""
    return texts(subagent).filter(F.col("value").rlike(HINT)).mapInPandas(_scan, "row_id long, block_no int, part string, secrets array<string>, starts array<int>, masked string")


def credentials(subagent: DataFrame) -> DataFrame:
    """Each credential with its place: ``row_id, block_no, part, start, secret``, once per row however often delivered."""
    found = scanned(subagent).select("row_id", "block_no", "part", F.inline(F.arrays_zip("starts", "secrets")))
    return found.select("row_id", "block_no", "part", F.col("starts").alias("start"), F.col("secrets").alias("secret")).distinct()


def masked_texts(subagent: DataFrame) -> DataFrame:
    """The texts that hold credentials, masked: ``row_id, block_no, part, n_secrets, text``."""
    return scanned(subagent).select("row_id", "block_no", "part", F.size("secrets").alias("n_secrets"), F.col("masked").alias("text")).distinct()
