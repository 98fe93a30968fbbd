"""Operator 10: secrets in texts, with a random forest that removes false positives.

Candidates are unbroken runs of at least ``SHORTEST`` key characters with letters and digits, headers of private keys,
passwords in addresses (``scheme://user:password@host``), and, at any length and of any characters, the quoted or
assigned value beside a key word (password, token, Kennwort, contraseña, ...). An unquoted value ends where the next
assignment to a key word begins. Each candidate is described by its length, character classes and the changes between them,
entropy, how much of it dictionary words cover, the path or source it stands in, and the words beside it. The dictionary
holds the corpus's own frequent words. The forest is trained on labelled findings, made by a seeded rule: random keys as
they are put in configuration, against identifiers, hashes of commits and files, host names, numbers, words run together and
placeholders. Secrets that overlap are joined to one finding.

``scan`` adds the findings of each text, ``redact`` replaces those judged secret. A null or empty text has no
finding, a null path counts as unknown. A text of any length is scanned whole, in time in proportion to it, and a candidate
of any length is described whole. Rows are independent: repeated rows get
repeated results, an empty table an empty one; other columns ride along (one named like an output column is replaced).
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import read_table, with_columns

SHORTEST = 16
TREES, DEPTH, FINDINGS, SEED = 40, 9, 6000, 23
MARK = "[SECRET]"
RUN = re.compile(r"[A-Za-z0-9+/_\-=.~]{%d,}|-----BEGIN [A-Z ]*PRIVATE KEY-----" % SHORTEST)
NEAR_SECRET = re.compile(r"token|secret|passw|pwd|kennwort|contrase|clave|mot.?de.?passe|mdp|jeton|geheim|api.?key|apikey|auth|credential|bearer|private|access.?key|client.?key|signing|encrypt", re.I)
NEAR_OTHER = re.compile(r"commit|sha\d*|md5|hash|checksum|digest|uuid|guid|version|build|revision|integrity|file|page|image|phone|call|account number|isbn", re.I)
PLACEHOLDER = re.compile(r"example|sample|your|placeholder|changeme|dummy|xxxx|test|0000|1234|abcd|redacted", re.I)
#: Key words, in the languages of the tables, by which a value of any length is a candidate; "key" only after one of KEY_OF.
KEY_WORDS = ("token", "secret", "passw", "passphrase", "pwd", "credential", "bearer", "auth", "kennwort", "geheim", "contraseña", "contrasena", "clave", "mot de passe", "motdepasse", "mdp", "jeton", "key")
KEY_OF = re.compile(r"(?:api|access|private|client|secret|signing|encrypt\w{0,4}|auth)[_\-. ]?$")
#: The dictionary: so many of the most frequent words of all texts.
DICTIONARY = 4_000
_LEAD = r"(?!ar[iy]|ors?\b|orit)[\w.\-]{0,24}[\"'`\])]{0,2}\s{0,3}"
_SIGN = r"(?::=|=>|==|[=:])"
QUOTED = re.compile(
    _LEAD + _SIGN + r"?[!#$%&*]{0,3}\s{0,3}(?:\"(?P<a>(?:\\.|[^\"\\\n])+)\"|'(?P<b>(?:\\.|[^'\\\n])+)'|`(?P<c>[^`\n]+)`)",
    re.I,
)
ASSIGNS = re.compile(_LEAD + _SIGN + r"\s{0,3}(?:[!#$%&*]{1,3}\s{1,3})?(?:(?:bearer|basic)\s{1,3})?", re.I)
BARE = re.compile(r"[^\s\"'`]+")
BEARER = re.compile(r"\s{1,3}")
#: The password of an address, after its "://".
ADDRESS = re.compile(r"[^\s:@/\"'`]{0,64}:(?P<d>[^\s@/\"'`]{1,256})@")
BESIDE = re.compile(r"(?:token|secret|passw|passphrase|pwd|credential|bearer|auth|kennwort|geheim|contrase[ñn]a|clave|mot ?de ?passe|mdp|jeton|key)[\w.\-]{0,24}[\"'`\])]{0,2}\s{0,3}" + _SIGN + r"?\s{0,3}(?:[!#$%&*]{1,3}\s{0,3})?(?:(?:bearer|basic)\s{1,3})?[\"'`]?$", re.I)
PASSWORD = re.compile(r"(?:passw|passphrase|pwd|kennwort|contrase[ñn]a|clave|mot ?de ?passe|mdp|://[^\s:@/]{0,50})[\w.\-]{0,24}\W{0,8}$", re.I)
TEMPLATE = re.compile(r"^[<\[{(]|^[$%][{(A-Z]|[()]|^(?:none|null|nil|true|false|undefined|required|optional|string|str|text|hidden|\*+)[,;.]?$", re.I)
PATHS = re.compile(r"test|example|sample|doc|fixture|mock|readme|tutorial", re.I)
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "glpat-", "sk-", "sk_live_", "xoxb-", "xoxp-", "AIza", "eyJ", "-----BEGIN")
WORDS = (
    "about access account action admin after again application array based before begin block build button cache call change check class client close code color "
    "commit config content count create data date default delete detail device document error event example field file filter first folder format from function "
    "global group handler hash header height hello host image index input item java key label last layer left length level library line link list load local "
    "lock login main manager map master message method mode model module name network node null number object open option order package page param parent parser "
    "part password path plain plugin point print private process product project property public query queue read record release remote report request reset "
    "resource response result return right root route sample screen script search second secret section select server service session set setting size some "
    "source space start state static status step stop store stream string style submit system table target task template test text that the thread time title "
    "token total type update upload user value version view width window with word work world write your"
).split()
COMMON = frozenset(w for w in WORDS if len(w) > 2)
CLASSES = {**dict.fromkeys(string.ascii_lowercase, 0), **dict.fromkeys(string.ascii_uppercase, 1), **dict.fromkeys(string.digits, 2)}


def covered(value: str, words: frozenset[str]) -> int:
    """Characters in dictionary words, the longest from the left."""
    low, at, out = value.lower(), 0, 0
    while at < len(low) - 2:
        for size in range(min(16, len(low) - at), 2, -1):
            if low[at : at + size] in words:
                out += size
                at += size
                break
        else:
            at += 1
    return out


def features(value: str, before: str, after: str, path: str, words: frozenset[str] = COMMON) -> list[float]:
    n = len(value)
    kinds = [CLASSES.get(c, 3) for c in value]
    counts = np.bincount(kinds, minlength=4) / n
    chars = np.array(list(Counter(value).values())) / n
    changes = sum(a != b for a, b in zip(kinds, kinds[1:])) / max(1, n - 1)
    near = " ".join(before.split()[-4:])
    return [
        float(n),
        *counts.tolist(),
        float(-(chars * np.log2(chars)).sum()),
        changes,
        covered(value, words) / n,
        sum(c in "aeiouAEIOU" for c in value) / n,
        float(all(c in "0123456789abcdef" for c in value) or all(c in "0123456789ABCDEF" for c in value)),
        float(value.startswith(PREFIXES)),
        float(bool(PLACEHOLDER.search(value))),
        value.count(".") / n,
        value.count("-") / n,
        max(len(m) for m in re.split(r"[^0-9]+", value)) / n,
        float(bool(NEAR_SECRET.search(near))),
        float(bool(NEAR_OTHER.search(near))),
        float(bool(re.search(r"[=:][!#$%&*]*\s*[\"'`]?$", before))),
        float(before[-1:] in "\"'`" and after[:1] in "\"'`" and bool(before)),
        float(before[-1:] == "@" or after[:1] == "@" or "://" in before[-12:]),
        float(bool(re.search(r"://[^\s:@/]{0,50}:$", before)) and after[:1] == "@"),
        float(bool(PATHS.search(path))),
        float(bool(BESIDE.search(before))),
        float(bool(PASSWORD.search(before))),
        float(before.rstrip("\"'`")[-1:] == "="),
        float(bool(TEMPLATE.search(value))),
        sum(c.isspace() for c in value) / n,
    ]


def labelled_findings(count: int = FINDINGS, seed: int = SEED) -> list[tuple[str, str, str, str, int]]:
    """``(value, before, after, path, secret)``: findings with labels, always the same for a seed."""
    rng = random.Random(seed)
    hexes, base = "0123456789abcdef", string.ascii_letters + string.digits + "+/"
    pick = lambda chars, low, high: "".join(rng.choices(chars, k=rng.randrange(low, high)))
    syllables = ["th", "er", "on", "an", "re", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it", "st", "io", "le", "is", "ou", "ar", "as", "de", "rt", "ve"]
    filler = lambda: " ".join("".join(rng.choices(syllables, k=rng.randrange(1, 4))) for _ in range(rng.randrange(0, 5)))
    keys = ["token", "secret", "api_key", "apikey", "password", "auth_token", "access_key", "client_secret", "SECRET_KEY", "Authorization: Bearer", "credentials", "private_key", "jeton", "clave_api", "Geheimnis"]
    others = ["commit", "sha256", "md5", "checksum", "uuid", "id", "version", "file", "image", "page", "build", "call", "url", "integrity"]
    paths = ["src/app", "config/prod", "deploy", "web", "src3", "", "forum", "blog"]
    quiet = ["docs/example", "tests/unit", "samples", "README", "fixtures"]
    marks, passwords = "!@#$%^&*?", ["password", "passwd", "pwd", "PASSWORD", "db_password", "passphrase", "Passwort", "kennwort", "contraseña", "mot de passe", "mdp"]
    word = lambda: rng.choice(WORDS) if rng.random() < 0.5 else "".join(rng.choices(syllables, k=rng.randrange(1, 5)))

    def beside() -> tuple[str, str, str, str, int]:
        """A value of any length and alphabet beside a key word."""
        if rng.random() < 0.05:
            value = f"-----BEGIN {rng.choice(['', '', 'RSA ', 'EC ', 'DSA ', 'OPENSSH ', 'ENCRYPTED '])}PRIVATE KEY-----"
            return value, rng.choice([f"{filler()} ", f"{filler()}\n", f"{rng.choice(keys)} = \""]), "\n" + filler(), rng.choice(paths + quiet), 1
        quote, sign = rng.choice("\"\"'"), rng.choice([" = ", "=", ": ", ":", " := ", " => "])
        path, key = rng.choice(paths), rng.choice(keys[:8] + ["secret_key"])
        kind = rng.randrange(10)
        if kind < 5:
            own = rng.choice(passwords)
            bare = rng.random() < 0.4
            if kind == 0:
                value = rng.choice([word().title(), word(), word().title() + word().title()]) + str(rng.randrange(1, 10 ** rng.randrange(1, 5) + 1)) + rng.choice(["", "", "x", "!", "ab", "?", "$"])
            elif kind == 1:
                value = pick(base[:-2] + marks * 2, 5, 25) + rng.choice(marks) + pick(base[:-2], 1, 6)
                own = rng.choice(passwords + keys[:6])
            elif kind == 2:
                value = pick(base[:-2], 6, 16) + str(rng.randrange(10))
                own = rng.choice(passwords + keys[:6])
            elif kind == 3:
                value, bare = pick(string.ascii_letters, 8, 30) if rng.random() < 0.5 else word() + word(), False
                if rng.random() < 0.4:
                    bare, sign = True, "="
            else:
                value = pick(string.digits, 4, 20)
            if "=" not in sign and ":" not in sign:
                sign = "="
            quote = "" if bare else quote
            return value, f"{filler()} {own}{sign}{quote}", quote + " " + filler(), path, 1
        key = rng.choice([key, rng.choice(passwords)])
        if kind == 5:
            value, quote, sign = word().title() if rng.random() < 0.3 else word(), "", rng.choice([": ", ": ", " : "])
        elif kind == 6:
            value = rng.choice(["<password>", "${DB_PASSWORD}", "{{ secret }}", "None", "null", "true", "false", "os.getenv(NAME)", "get_secret()", "********", "$PASSWORD", "your-password", "changeme", "required", "[REDACTED]", "example"])
            quote = quote if rng.random() < 0.5 else ""
        elif kind == 7:
            value, sign = " ".join(word() for _ in range(rng.randrange(1, 6))), " "
        elif kind == 8:
            value, quote, key = str(rng.randrange(1, 100000)), "", rng.choice(["token", "tokens", "max_tokens", "auth_timeout", "secret_version"])
        else:
            value = " ".join(word() for _ in range(rng.randrange(3, 9)))
        return value, f"{filler()} {key}{sign}{quote}", quote + " " + filler(), path, 0

    def prefixed() -> str:
        """A key that tells by its beginning what it is."""
        letters = base[:-2]
        kinds = [("xoxb-", 1), ("xoxp-", 1), ("glpat-", 0), ("AIza", 0), ("sk_live_", 0), ("gho_", 0), ("eyJ", 2)]
        start, parts = rng.choice(kinds)
        if parts == 1:
            return start + "-".join([pick(string.digits, 10, 13), pick(string.digits, 10, 13), pick(letters, 20, 30)])
        return start + (".".join(pick(letters, 20, 60) for _ in range(3)) if parts else pick(letters + "-_", 20, 40))

    def address() -> tuple[str, str, str, str, int]:
        """The password of an address, or one that only stands for it."""
        scheme, user, host = rng.choice(["postgres", "mysql", "https", "amqp", "redis", "mongodb", "ftp"]), rng.choice([word(), "admin", "root", ""]), word() + rng.choice([".example.com", ".internal", "", ".net"])
        secret = rng.random() < 0.7
        value = rng.choice([pick(base[:-2] + marks[:1] + marks[2:], 6, 24), word() + str(rng.randrange(10000)), pick(hexes, 12, 33)]) if secret else rng.choice(["password", "<password>", "${PASSWORD}", "$PASS", "xxxx", "****", "{password}", "pass", "your-password"])
        return value, f"{filler()} {scheme}://{user}:", f"@{host}/{word()}", rng.choice(paths), int(secret)

    out = []
    for _ in range(count):
        kind = rng.random()
        if kind < 0.35:
            out.append(beside())
            continue
        if kind < 0.40:
            out.append(address())
            continue
        quote = rng.choice(["\"", "\"", "'", ""])
        sign = rng.choice([" = ", "=", ": ", ":", " := ", " => "])
        if rng.random() < 0.15:  # marks that have got between a key and its value
            noise = rng.choice("!#$%&*") * rng.randrange(1, 4)
            sign = rng.choice([noise + sign, sign.rstrip() + noise + " "])
        secret = rng.random() < 0.5
        path = rng.choice(paths if rng.random() < (0.9 if secret else 0.6) else quiet)
        if secret:
            value = rng.choice([lambda: pick(hexes, 32, 65), lambda: pick(hexes, 40, 41), lambda: pick(hexes.upper(), 32, 65), lambda: pick(base, 20, 65), lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, 16, 17), lambda: "ghp_" + pick(base[:-2], 36, 37), lambda: "sk-" + pick(base[:-2], 32, 49), lambda: prefixed(), lambda: pick(base[:-2], 24, 41)])()
            known = value.startswith(PREFIXES)
            before = f"{filler()} {rng.choice(keys)}{sign}{quote}" if rng.random() < (0.6 if known else 0.97) else f"{filler()} {quote}"
        else:
            kind = rng.randrange(9)
            if kind == 0:
                value = pick(hexes, 40, 41) if rng.random() < 0.5 else pick(hexes, 32, 65)
            elif kind == 1:
                value = "-".join(pick(hexes, n, n + 1) for n in (8, 4, 4, 4, 12))
            elif kind == 2:
                value = "".join(rng.choice(WORDS).title() for _ in range(rng.randrange(3, 6))) + str(rng.randrange(100))
            elif kind == 3:
                value = "".join(rng.choices(syllables, k=rng.randrange(8, 20))) + str(rng.randrange(1000))
            elif kind == 4:
                value = f"{rng.choice(WORDS)}{rng.randrange(10)}.{rng.choice(WORDS)}.{rng.choice(['com', 'org', 'net'])}"
            elif kind == 5:
                value = "/".join(rng.choice(WORDS) for _ in range(4)) + f"/{rng.randrange(10000)}"
            elif kind == 6:
                value = rng.choice(["your-token-here-1234", "xxxxxxxxxxxxxxxx0000", "example-secret-key-1", "changeme1234567890ab", "test_token_0123456789", "sk-test-example-0000"])
            elif kind == 7:
                value = f"v{rng.randrange(9)}.{rng.randrange(99)}.{rng.randrange(99)}-" + pick(string.ascii_lowercase, 4, 9) + f".{rng.randrange(20250101, 20261231)}"
            else:
                value = "_".join(rng.choice(WORDS) for _ in range(4)) + f"_{rng.randrange(99)}"
            if len(value) < SHORTEST:
                value += "-" + "-".join(rng.choice(WORDS) for _ in range(3))
            near_key = rng.random() < (0.5 if kind in (2, 5, 6, 8) else 0.0)
            before = f"{filler()} {rng.choice(keys) if near_key else rng.choice(others)}{sign if rng.random() < 0.6 else ' '}{quote}" if near_key or rng.random() < 0.7 else f"{filler()} {quote if kind != 0 else ''}"
            if kind == 4 and rng.random() < 0.6:
                before += "mail@"
        out.append((value, before, quote + " " + filler(), path, int(secret)))
    return out


class Forest:
    """Bagged trees on random feature subsets; arrays only, so that it travels in a few kilobytes."""

    def __init__(self):
        self.trees: list[tuple[np.ndarray, ...]] = []
        self.words: frozenset[str] = COMMON

    def fit(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> Forest:
        rng = np.random.default_rng(seed)
        for _ in range(trees):
            rows = rng.integers(0, len(x), len(x))
            nodes: list[list[float]] = []
            self._grow(nodes, x[rows], y[rows], depth, rng)
            table = np.array(nodes, float)
            self.trees.append((table[:, 0].astype(int), table[:, 1], table[:, 2].astype(int), table[:, 3].astype(int), table[:, 4]))
        return self

    def _grow(self, nodes, x, y, depth, rng) -> int:
        at = len(nodes)
        nodes.append([-1, 0.0, 0, 0, float(y.mean())])
        if depth == 0 or len(y) < 8 or y.min() == y.max():
            return at
        best = (1e-9, -1, 0.0)
        impurity = y.mean() * (1 - y.mean())
        for f in rng.choice(x.shape[1], max(1, round(math.sqrt(x.shape[1])) + 1), replace=False):
            order = np.argsort(x[:, f], kind="stable")
            v, ones = x[order, f], np.cumsum(y[order])
            cut = np.flatnonzero(v[1:] > v[:-1])
            if not len(cut):
                continue
            n = cut + 1.0
            left, right = ones[cut] / n, (ones[-1] - ones[cut]) / (len(y) - n)
            gain = impurity - (n * left * (1 - left) + (len(y) - n) * right * (1 - right)) / len(y)
            k = gain.argmax()
            if gain[k] > best[0]:
                middle = (v[cut[k]] + v[cut[k] + 1]) / 2
                best = (gain[k], f, middle if middle < v[cut[k] + 1] else v[cut[k]])
        if best[1] >= 0:
            goes = x[:, best[1]] <= best[2]
            left = self._grow(nodes, x[goes], y[goes], depth - 1, rng)
            right = self._grow(nodes, x[~goes], y[~goes], depth - 1, rng)
            nodes[at][:4] = [best[1], best[2], left, right]
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, cut, left, right, value in self.trees:
            node = np.zeros(len(x), int)
            while True:
                inner = feature[node] >= 0
                if not inner.any():
                    break
                goes = x[np.arange(len(x)), np.maximum(feature[node], 0)] <= cut[node]
                node = np.where(inner, np.where(goes, left[node], right[node]), node)
            total += value[node]
        return total / max(1, len(self.trees))


def dictionary(docs: DataFrame, text: str = "text", size: int = DICTIONARY) -> frozenset[str]:
    """The corpus's most frequent words of four letters or more, by the number of rows whose text has them, and ``WORDS``.

    All texts are counted, in the cluster: a task sends on one row for each word it has met, and no text is moved. ``size``
    words come to the driver.
    """
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(?<!\p{L})(\p{L}{4,16})(?!\p{L})")))).alias("w"))
    found = words.groupBy("w").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "w").limit(size)
    return COMMON | {r.w for r in found.collect()}


def train(words: frozenset[str] = COMMON) -> Forest:
    """The forest, which keeps the dictionary that its features came from."""
    found = labelled_findings()
    forest = Forest().fit(np.array([features(*f[:4], words) for f in found]), np.array([f[4] for f in found], float))
    forest.words = words
    return forest


def values_beside(text: str) -> list[tuple[int, int]]:
    """Spans of the quoted or assigned values beside key words, of any length, and of addresses' passwords."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    found = []
    for word in KEY_WORDS:
        at = low.find(word)
        while at >= 0:
            end = at + len(word)
            if word != "key" or KEY_OF.search(low[max(0, at - 12) : at]):
                found.append((at, end, word))
            at = low.find(word, end)
    found.sort()
    signs = [ASSIGNS.match(text, end) for _, end, _ in found]
    starts = [at for (at, _, _), sign in zip(found, signs) if sign]
    out = []
    for (_, end, word), sign in zip(found, signs):
        m = QUOTED.match(text, end)
        if m:
            begin, value = m.start(m.lastgroup), m.group(m.lastgroup)
        else:
            sign = sign or (BEARER.match(text, end) if word == "bearer" else None)
            if not sign:
                continue
            # an unquoted value ends where the next assignment begins, so that no stretch is read again and again
            begin, after = sign.end(), bisect_left(starts, sign.end())
            m = BARE.match(text, begin, starts[after] if after < len(starts) else len(text))
            value = m.group().rstrip(".,;&") if m else ""
        if value.strip():
            out.append((begin, begin + len(value)))
    at = text.find("://")
    while at >= 0:
        m = ADDRESS.match(text, at + 3)
        if m:
            out.append(m.span("d"))
        at = text.find("://", at + 3)
    return out


def candidates(text: str) -> list[tuple[int, int]]:
    out = set(values_beside(text))
    if "-----BEGIN" in text or max(map(len, text.split()), default=0) >= SHORTEST:
        for m in RUN.finditer(text):
            value = m.group().strip("=./-~") if not m.group().startswith("-----") else m.group()
            begin = m.start() + m.group().find(value)
            if value.startswith("-----") or len(value) >= SHORTEST and any(c.isdigit() for c in value) and any(c.isalpha() for c in value):
                out.add((begin, begin + len(value)))
    return sorted(out)


def joined(found: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """``(begin, end, score)`` with secrets that overlap joined to one; all others stay."""
    out: list[tuple[int, int, float]] = []
    for begin, end, score in sorted(f for f in found if f[2] >= 0.5):
        if out and begin < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]), max(score, out[-1][2]))
        else:
            out.append((begin, end, score))
    return sorted(out + [f for f in found if f[2] < 0.5])


FINDING = T.ArrayType(
    T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType()), T.StructField("is_secret", T.BooleanType()), T.StructField("value_sha256", T.StringType())])
)
_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("is_secret", pa.bool_()), ("value_sha256", pa.string())]))


def scan(spark: SparkSession, df: DataFrame, forest: Forest, text: str = "text", path: str | None = "source", out: str = "findings", drop: tuple[str, ...] = (), redacted: str | None = None, mark: str = MARK) -> DataFrame:
    """``df`` with ``out``: spans (in characters) of all candidates, with the forest's share of trees.

    ``redacted`` names a column (it may be ``text``) for the text with ``mark`` in place of its secrets, as ``redact``
    gives it: in the same pass, since each pass over the rows has a Python process of its own for each task that runs.
    """
    shared = spark.sparkContext.broadcast(forest)

    def make():
        own = shared.value

        def run(batch):
            column = lambda c: batch.column(batch.schema.get_field_index(c)).to_pylist()
            places = column(path) if path else [""] * batch.num_rows
            spans, rows, result = [], [], []
            held = column(text)
            for k, (t, p) in enumerate(zip(held, places)):
                result.append([])
                for begin, end in candidates(t or ""):
                    spans.append((k, begin, end))
                    rows.append(features(t[begin:end], t[max(0, begin - 60) : begin], t[end : end + 10], str(p or ""), own.words))
            if rows:
                for (k, begin, end), s in zip(spans, own.predict(np.array(rows)).tolist()):
                    result[k].append((begin, end, s))
            for k, (t, found) in enumerate(zip(held, result)):
                result[k] = [{"start": b, "end": e, "score": s, "is_secret": s >= 0.5, "value_sha256": hashlib.sha256(t[b:e].encode()).hexdigest()} for b, e, s in joined(found)]
            columns = [pa.array(result, _ARROW)]
            if redacted:
                columns.append(pa.array([masked(t, found, mark) for t, found in zip(held, result)], pa.string()))
            return columns

        return run

    return with_columns(df, [T.StructField(out, FINDING), *([T.StructField(redacted, T.StringType())] if redacted else [])], make, drop)


def redact(df: DataFrame, text: str = "text", findings: str = "findings", mark: str = MARK) -> DataFrame:
    """``df`` with ``mark`` in place of each span of ``findings`` that is a secret."""

    def make():
        def run(batch):
            column = lambda c: batch.column(batch.schema.get_field_index(c)).to_pylist()
            return [pa.array([masked(t, found or [], mark) for t, found in zip(column(text), column(findings))], pa.string())]

        return run

    own = {f.name.lower() for f in df.schema.fields}
    new = next(n for n in ("_masked", *(f"_masked{k}" for k in range(len(own) + 1))) if n not in own)
    return with_columns(df, [T.StructField(new, T.StringType())], make).withColumn(text, F.col(new)).drop(new)


def masked(text: str | None, found: list[dict], mark: str) -> str | None:
    if text is None:
        return None
    parts, at = [], 0
    for f in found:
        if f["is_secret"]:
            parts += [text[at : f["start"]], mark]
            at = f["end"]
    return "".join([*parts, text[at:]]) if parts else text


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each candidate found, with the forest's judgement."""
    docs = read_table(spark, sf_dir, "documents")
    found = scan(spark, docs.select("doc_id", "source", "text"), train(dictionary(docs)), drop=("text",))
    return found.select("doc_id", F.explode("findings").alias("f")).select("doc_id", "f.start", "f.end", "f.score", "f.is_secret", "f.value_sha256")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: secrets are replaced; documents stay."""
    done = scan(spark, docs, train(dictionary(docs)), out="_findings", redacted="text")
    return done.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long"))).select(docs.columns)


QUERIES = {"op10_secret_scan": op10_secret_scan}
ORACLE_SQL: dict[str, str] = {}
