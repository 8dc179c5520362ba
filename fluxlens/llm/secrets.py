"""Secrets in text: candidates, features of their form and surroundings, and a random forest that drops false positives.

Candidates are runs of key-like signs that hold a digit, whole values that are assigned to a telling name, whatever their
signs, tokens after `Bearer` or `Basic`, passwords in addresses and blocks of private keys. The forest is trained by
Spark ML on labelled findings (value, what stands before and after, path, label); its trees are then small arrays that
every task evaluates where the text is, so texts are not shuffled.
"""

from __future__ import annotations

import json
import math
import random
import re
import string
from bisect import bisect_left
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxlens.llm.tasks import pieces
from fluxlens.session import work_folder

LEAST_LENGTH = 8
#: Signs before and after a candidate that count as its surroundings.
REACH = 60
TREES = 20
DEPTH = 8
REPLACEMENT = "[secret]"

#: Names to which secrets are assigned, words that mark other long strings, and folders with made-up values.
SECRET_NAMES = ("password", "passwd", "passphrase", "pwd", "pass", "secret", "token", "apikey", "api_key", "access_key", "private_key", "credential", "auth", "bearer", "key")
OTHER_NAMES = ("commit", "sha", "sha1", "sha256", "md5", "checksum", "hash", "digest", "uuid", "guid", "id", "version", "build", "phone", "tel", "fax", "card", "mail", "ip", "address", "order", "invoice", "serial", "revision", "etag", "date", "time", "page")
MADE_UP = ("example", "sample", "placeholder", "changeme", "dummy", "your", "fake", "xxxx", "insert", "replace", "todo", "redacted")
MADE_UP_PATHS = ("test", "tests", "example", "examples", "docs", "doc", "sample", "samples", "fixtures", "mock")

_VALUE = frozenset(string.ascii_letters + string.digits + "_+/.~-")
_DIGIT_OR_SIGN = re.compile(r"[0-9=:]")
_NAME_END = re.compile(r"([A-Za-z_][A-Za-z_-]*)[0-9]{0,3}[\"']?\s{0,3}$")
_ASSIGNS = re.compile(r"[\"']?\s{0,3}[=:]")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_UNQUOTED = re.compile(r"\S*")
_BEARER = re.compile(r"\b(?:[Bb]earer|[Bb]asic|BEARER|BASIC)[ \t]+[\"']?$")
_SPECIAL = re.compile(
    r"(?P<key>-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----)"
    r"|://[^\s/:@\"'<>]{0,256}:(?P<url>[^\s\"'<>]{4,1024})@(?=[A-Za-z0-9.\[\]-]+(?:[:/?#,;\s\"'<>)]|\Z))"
    r"|\b(?:[Bb]earer|[Bb]asic|BEARER|BASIC)[ \t]+[\"']?(?P<bearer>[^\s\"'<>,;]{16,})"
)
_KEY_END = re.compile(r"-----END [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----")
_NOT_IN_KEY = re.compile(r"[^A-Za-z0-9+/=\s:,.\\-]")
_KEY_LINES = re.compile(r"[A-Za-z0-9+/=\s\\]*")
_OPENING = re.compile(r"\s{0,3}[\"']?")
_WORD = re.compile(r"[A-Za-z_]+")
_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_NUMBERS = re.compile(r"[0-9]+([./:-][0-9]+)*")
_KEY_PREFIX = re.compile(r"(AKIA|ASIA|gh[pousr]_|xox[abprs]-|sk_live_|glpat-|AIza|eyJ)")

FEATURES = (
    "length", "digits", "upper", "lower", "signs", "changes", "entropy", "variety", "hex", "pairs", "coverage", "longest_digits",
    "numbers_only", "uuid", "key_prefix", "assigned", "secret_near", "other_near", "made_up", "made_up_path", "mail_or_host", "quoted", "bearer", "url_password", "private_key",
)


def _special_spans(text: str) -> list[tuple[int, int]]:
    """Private key blocks, passwords in addresses and bearer tokens, from left to right without overlap.

    A key block reaches to the next end line if only signs of a key lie before it, else as far as lines of a key go. End
    lines and foreign signs are looked for once, however many headers there are.
    """
    found: list[tuple[int, int]] = []
    ends = [m.span() for m in _KEY_END.finditer(text)]
    foreign = -1
    at, m = 0, _SPECIAL.search(text)
    while m:
        if m["key"]:
            if foreign < m.end():
                other = _NOT_IN_KEY.search(text, m.end())
                foreign = other.start() if other else len(text)
            following = bisect_left(ends, (m.end(), 0))
            whole = following < len(ends) and ends[following][0] <= foreign
            span = m.start(), ends[following][1] if whole else _KEY_LINES.match(text, m.end()).end()
            at = span[1]
        else:
            span = m.span("url" if m["url"] else "bearer")
            at = m.end()
        found.append(span)
        m = _SPECIAL.search(text, at)
    return found


def candidates(text: str) -> list[tuple[int, int]]:
    """Start and end of every candidate, in order and without overlap."""
    found: list[tuple[int, int]] = []
    special = [*_special_spans(text), (len(text) + 1, 0)]
    following = done = 0
    for hit in _DIGIT_OR_SIGN.finditer(text):
        at = hit.start()
        while special[following][0] <= at:
            if special[following][0] >= done:
                found.append(special[following])
                done = special[following][1]
            following += 1
        if at < done:
            continue
        assigned = not hit[0].isdigit()
        if not assigned:
            start = at
            while start > done and text[start - 1] in _VALUE:
                start -= 1
            end = start
            while end < len(text) and text[end] in _VALUE:
                end += 1
            while end > start and text[end - 1] in "./-":
                end -= 1
            stop = end
            while stop < len(text) and text[stop] == "=" and stop - end < 2:
                stop += 1
            name = _NAME_END.search(text[max(start, end - REACH) : end])
            if name and _secret_name(name[1]) and _ASSIGNS.match(text, end):
                done = max(done, end)
                continue  # a name such as db2_password, its value follows
        else:
            name = _NAME_END.search(text[max(0, at - REACH) : at])
            if not name or not _secret_name(name[1]):
                continue
            start = _OPENING.match(text, at + 1).end()
            end = stop = _value_end(text, start)
        if special[following][0] < stop:
            if not assigned:
                done = special[following][0]
                continue
            end = stop = max(stop, special[following][1])
        if end - start >= LEAST_LENGTH:
            found.append((start, stop))
        done = max(done, stop)
    return found + [span for span in special[following:-1] if span[0] >= done]


def _value_end(text: str, start: int) -> int:
    """The end of an assigned value: its closing quote on the same line, or else white space without closing signs."""
    quote = text[start - 1]
    if quote in "\"'":
        line = text.find("\n", start)
        end = text.find(quote, start, line if line >= 0 else len(text))
        while end > start and text[end - 1] == "\\":
            end = text.find(quote, end + 1, line if line >= 0 else len(text))
        if end >= 0:
            return end
    value = _UNQUOTED.match(text, start)[0]
    unopened = "".join(close for open_, close in ("()", "[]", "{}", "<>") if open_ not in value)
    return start + len(value.rstrip("./-,;:\"'`" + unopened))


def _secret_name(name: str) -> bool:
    name = _CAMEL.sub("_", name).lower()
    return any(name == s or name.endswith(("_" + s, "-" + s)) for s in SECRET_NAMES)


@lru_cache(maxsize=2)
def _language(path: str) -> tuple[frozenset[str], dict[str, float]]:
    """Words of a public vocabulary, and how usual each pair of neighbouring letters is in them (logarithm)."""
    with open(path, encoding="utf-8") as file:
        entries = json.load(file)["model"]["vocab"]
    known = frozenset(w for e in entries if e.endswith("</w>") and len(w := e[:-4]) >= 4 and w.isascii() and w.isalpha())
    counts: dict[str, int] = {}
    for word in known:
        for a, b in zip(word, word[1:], strict=False):
            counts[a + b] = counts.get(a + b, 0) + 1
    total = sum(counts.values())
    return known, {pair: math.log(n * 676 / total) for pair, n in counts.items()}


def _kind(sign: str) -> int:
    return 0 if sign.islower() else 1 if sign.isupper() else 2 if sign.isdigit() else 3


def _coverage(value: str, known: frozenset[str]) -> float:
    """Share of the letters that the longest known words cover, from left to right."""
    lower, at, covered = value.lower(), 0, 0
    while at < len(lower):
        size = next((n for n in range(min(14, len(lower) - at), 3, -1) if lower[at : at + n] in known), 0)
        covered += size
        at += size or 1
    return covered / max(1, sum(c.isalpha() for c in value))


def describe(value: str, before: str, after: str, path: str | None, vocabulary: str) -> list[float]:
    """The features of one candidate, in the order of FEATURES. Very long values are described by all their signs."""
    known, pairs = _language(vocabulary)
    n = len(value)
    kinds = [_kind(c) for c in value]
    shares = [kinds.count(k) / n for k in range(4)]
    counts = {c: value.count(c) for c in set(value)}
    lower = value.lower()
    letters = [lower[i : i + 2] for i in range(n - 1) if kinds[i] < 2 and kinds[i + 1] < 2]
    name = _NAME_END.search(re.sub(r"\s*[=:]\s*[\"']?$", "", before))
    near_before, near_after = (_WORD.findall(t) for t in (before, after))
    named = near_before[-6:] + near_after[:3]
    near = [w.lower() for w in named]
    runs = re.findall(r"[0-9]+", value)
    return [
        float(n), shares[2], shares[1], shares[0], shares[3],
        sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / max(1, n - 1),
        -sum(c / n * math.log2(c / n) for c in counts.values()),
        len(counts) / min(n, 64),
        float(bool(_HEX.fullmatch(value))),
        sum(pairs.get(p, -4.0) for p in letters) / len(letters) if letters else 0.0,
        _coverage(value, known),
        max(map(len, runs), default=0) / n,
        float(bool(_NUMBERS.fullmatch(value))),
        float(bool(_UUID.fullmatch(value))),
        float(bool(_KEY_PREFIX.match(value))),
        float(bool(re.search(r"[=:]\s*[\"']?$", before)) and bool(name) and _secret_name(name[1])),
        float(sum(_secret_name(w) for w in named)),
        float(sum(w in OTHER_NAMES for w in near)),
        float(any(m in lower for m in MADE_UP) or any(w in MADE_UP for w in near)),
        float(any(p in MADE_UP_PATHS for p in re.split(r"[/._-]", (path or "").lower()))),
        float(after[:1] == "@" or before[-1:] == "@" or "://" in before[-12:]),
        float(before[-1:] in ("'", '"') and after[:1] in ("'", '"')),
        float(bool(_BEARER.search(before[-24:]))),
        float(after[:1] == "@" and bool(re.search(r"://[^\s/@]*:$", before))),
        float(value.startswith("-----BEGIN ") and "PRIVATE KEY" in value[:80]),
    ]


def labelled_findings(seed: int = 7, rows: int = 6_000) -> list[tuple[str, str, str, str, int]]:
    """Labelled findings (value, before, after, path, label) of the usual kinds, for want of a reviewed table of one's own."""
    rng = random.Random(seed)
    pick = lambda signs, n: "".join(rng.choices(signs, k=n))
    hexa, upper, mixed = "0123456789abcdef", string.ascii_uppercase + string.digits, string.ascii_letters + string.digits
    word = lambda: pick("aeionrst", 1) + pick(string.ascii_lowercase, rng.randrange(1, 8))
    plain = ("report", "chapter", "server", "backup", "release", "module", "window", "history", "package", "summary", "network", "library")
    password = lambda: "".join(rng.sample(pick(mixed, rng.randrange(6, 14)) + pick("!@#$%^&*?+", rng.randrange(1, 4)), k=7)) + rng.choice(plain)[: rng.randrange(1, 8)] + pick("!#%&@$", rng.randrange(2))
    secret_values = (
        lambda: "AKIA" + pick(upper, 16),
        lambda: pick(hexa, rng.choice((16, 18, 24, 32, 40, 64))),
        lambda: "ghp_" + pick(mixed, 36),
        lambda: "xoxb-" + pick(string.digits, 11) + "-" + pick(mixed, 24),
        lambda: "eyJ" + pick(mixed, 30) + "." + pick(mixed, 60) + "." + pick(mixed + "_-", 40),
        lambda: pick(mixed + "+/", 40),
        lambda: pick(mixed + "_-", rng.randrange(16, 48)),
        lambda: pick(mixed + "+/", 43) + "=",
        lambda: pick(string.ascii_letters, rng.randrange(4, 9)) + pick(string.digits, rng.randrange(2, 5)) + pick(string.ascii_letters, rng.randrange(2, 6)),
        password,
    )
    other_values = (
        lambda: ("commit ", pick(hexa, 40), ""),
        lambda: (rng.choice(("sha256:", "md5: ", "checksum ", "etag \"", "digest=", "hash ")), pick(hexa, rng.choice((32, 40, 64))), ""),
        lambda: ("", "-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12)), ""),
        lambda: (rng.choice(("", "card ", "order ", "")), pick("123456789", 1) + pick(string.digits, rng.randrange(7, 19)), ""),
        lambda: ("+1 (" + pick(string.digits, 3) + ") ", pick(string.digits, 3) + "-" + pick(string.digits, 4), ""),
        lambda: ("", ".".join(str(rng.randrange(1, 255)) for _ in range(4)), ""),
        lambda: ("", word() + "." + pick(string.digits, 2), "@" + word() + ".example.com"),
        lambda: (word() + "@", word() + pick(string.digits, 1) + ".example.com", ""),
        lambda: ("", f"20{pick('012', 1)}{pick(string.digits, 1)}-0{pick('123456789', 1)}-1{pick(string.digits, 1)}", rng.choice(("", "T12:00:01"))),
        lambda: ("version ", ".".join(pick(string.digits, 2) for _ in range(4)), ""),
        lambda: ("https://", "www." + word() + ".org/" + rng.choice(plain) + "/" + pick(string.digits, 5), ""),
        lambda: ("", rng.choice(plain) + "_" + rng.choice(plain) + "_" + pick(string.digits, 2), rng.choice(("", ".py", ".txt"))),
        lambda: ("", rng.choice(plain).title() + rng.choice(plain).title() + pick(string.digits, 1), ""),
        lambda: (rng.choice(("password=", "token: ", "api_key = \"", "secret=")), rng.choice(("changeme123", "your_token_here", "xxxxxxxxxxxx", "example-password-1", "replace_me_please", "dummy-secret-value")), ""),
        lambda: (rng.choice(("token = ", "key: ", "auth=", "pass: ")), rng.choice(("authenticate", "authorization", "primary_key_column", "passthrough", "settings.token_name", "os.environ")), ""),
        lambda: ("", pick(string.ascii_lowercase, rng.randrange(6, 14)) + pick(string.digits, 1), ""),
        lambda: ("", pick("0123456789", rng.randrange(8, 30)), ""),
        lambda: (rng.choice(("password: ", "token=", "apiKey = ", "secret: ")), rng.choice((f"get_{rng.choice(plain)}()", f"${{{rng.choice(plain).upper()}_TOKEN}}", f"<your-{rng.choice(plain)}>", f"self.{rng.choice(plain)}.token", f"config['{rng.choice(plain)}']", f"process.env.{rng.choice(plain).upper()}")), ""),
        lambda: (rng.choice(("password: \"", "key=\"", "token: \"", "pass = \"")), " ".join(word() if rng.random() < 0.3 else rng.choice(plain) for _ in range(rng.randrange(2, 9))), "\""),
        lambda: ("uuid=", "-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12)), ""),
        lambda: ("", pick("0123456789", 2) + pick(string.ascii_lowercase, 6) + "-" + rng.choice(plain), ""),
    )
    base64 = lambda n: "\n".join(pick(mixed + "+/", 64) for _ in range(n)) + "\n" + pick(mixed + "+/", rng.randrange(8, 60)) + "=="
    opaque = lambda: rng.choice((pick(mixed, rng.randrange(20, 64)), pick(mixed + "_-", rng.randrange(20, 64)), pick(hexa, rng.choice((32, 40, 64))), pick(string.ascii_letters, rng.randrange(20, 40)), pick(mixed + "+/", 43) + "="))
    kind = lambda: rng.choice(("", "RSA ", "EC ", "DSA ", "ENCRYPTED "))

    def private_key() -> tuple[str, str, str]:
        k, body = kind(), base64(rng.randrange(1, 26))
        return rng.choice(("", "\n", "key: ")), f"-----BEGIN {k}PRIVATE KEY-----\n{body}" + rng.choice((f"\n-----END {k}PRIVATE KEY-----", "")), "\n"

    # secrets that are not assigned to a name
    placed = (
        lambda: (rng.choice(("Authorization: ", "authorization: ", "-H 'Authorization: ", "")) + rng.choice(("Bearer ", "bearer ", "Basic ")), opaque(), rng.choice(("", "'", "\n", '"'))),
        private_key,
        lambda: (rng.choice(("postgres", "mysql", "https", "amqp", "mongodb")) + "://" + rng.choice(("admin", "app", "root", word())) + ":", rng.choice((password(), opaque(), pick(mixed, rng.randrange(6, 16)), rng.choice(plain) + pick(string.digits, 3))), "@" + word() + rng.choice((".example.com", ".internal", "", ":5432")) + "/" + word()),
        lambda: (rng.choice(("api key", "secret", "access token", "the password", "private key", "auth token", "Secret key", "credential")) + rng.choice((":\n", "\n", " is ", " | ", "\n\n", " `", " ")), rng.choice((opaque(), opaque(), password() + pick(string.digits, 2))), rng.choice(("\n", " |", "`", ""))),
    )
    # look-alikes in the same places
    alike = (
        lambda: (rng.choice(("Authorization: Bearer ", "Basic ", "bearer ")), rng.choice(("<your-access-token>", "your_token_goes_here", "{{access_token_value}}", "$ACCESS_TOKEN_VALUE", "understandings-and-" + rng.choice(plain), "responsibilities")), ""),
        lambda: ("https://" + rng.choice(("user", "name", "admin")) + ":", rng.choice(("password-placeholder", "<password>", "${DB_PASSWORD}", "changeme", "your-password", "xxxxxxxx")), "@" + word() + ".example.com/"),
        lambda: (rng.choice(("the token ", "a secret ", "its key ", "password ")), rng.choice((rng.choice(plain) + "_" + pick(string.digits, 2), rng.choice(plain) + "-" + rng.choice(plain) + "-1", pick(string.digits, 8), f"20{pick(string.digits, 2)}-01-0{pick(string.digits, 1)}")), ""),
        lambda: ("-----BEGIN CERTIFICATE-----\n", pick(mixed + "+/", 64), "\n"),
        lambda: (rng.choice(("\n", " ", "| ")), pick(hexa, rng.choice((32, 40, 64))), rng.choice(("\n", " |", "  file.txt"))),
    )
    names = (
        "password", "passwd", "secret", "token", "api_key", "auth_token", "access_key", "client_secret", "db_password", "private_key",
        "clientSecret", "apiToken", "dbPassword", "accessKey",
    )
    made = []
    for i in range(rows):
        left, right = (" ".join(word() for _ in range(rng.randrange(7))) for _ in range(2))
        path = rng.choice(("src0", "src12", "app/main.py", "conf/settings.ini", "deploy/prod.env", "lib/a.js"))
        if i % 2:
            make = rng.choice(secret_values)
            value = make()
            known = bool(_KEY_PREFIX.match(value))
            if i % 6 == 5:
                before, value, after = rng.choice(placed)()
                before, after = f"{left} {before}", f"{after} {right}"
            elif known and rng.random() < 0.6:
                before, after = left + " ", " " + right
            else:
                quote = rng.choice(("", '"', "'"))
                before, after = f"{left} {rng.choice(names)}{rng.choice(('=', ' = ', ': ', ':'))}{quote}", f"{quote} {right}"
            made.append((value, before, after, path, 1))
        else:
            before, value, after = rng.choice(other_values + alike)()
            if rng.random() < 0.1:
                path = rng.choice(("tests/test_a.py", "docs/intro.md", "examples/run.sh"))
            made.append((value, f"{left} {before}", f"{after} {right}", path, 0))
    return made


@dataclass(frozen=True)
class Forest:
    """Trees as arrays: feature (-1: leaf), threshold, left and right child, probability of a secret."""

    trees: tuple[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], ...]

    def scores(self, features: np.ndarray) -> np.ndarray:
        total = np.zeros(len(features))
        rows = np.arange(len(features))
        for feature, threshold, left, right, chance in self.trees:
            at = np.zeros(len(features), np.int64)
            while len(features) and (inner := feature[at] >= 0).any():
                goes_left = features[rows, np.maximum(feature[at], 0)] <= threshold[at]
                at = np.where(inner, np.where(goes_left, left[at], right[at]), at)
            total += chance[at]
        return total / max(1, len(self.trees))


def train(spark: SparkSession, findings: Sequence[tuple[str, str, str, str, int]], vocabulary: str, trees: int = TREES, depth: int = DEPTH, seed: int = 11) -> Forest:
    """Fit on labelled findings (a bounded list). Without both labels nothing is taken for a secret."""
    rows = [(float(label), describe(value, before[-REACH:], after[:REACH], path, vocabulary)) for value, before, after, path, label in findings]
    if len({r[0] for r in rows}) < 2:
        return Forest(())
    frame = spark.createDataFrame(rows, "label double, features array<double>").coalesce(1)
    frame = frame.select("label", array_to_vector("features").alias("features"))
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt", minInstancesPerNode=2, maxBins=64).fit(frame)
    return forest_of(model, spark)


def forest_of(model: RandomForestClassificationModel, spark: SparkSession) -> Forest:
    """A fitted model's trees as arrays."""
    folder = work_folder(spark, "forest")
    model.save(folder)
    nodes = spark.read.parquet(f"{folder}/data").select("treeID", "nodeData.*").collect()  # at most trees * 2^(depth + 1)
    built = []
    for tree in range(model.getNumTrees):
        own = sorted((r for r in nodes if r["treeID"] == tree), key=lambda r: r["id"])
        stats = np.asarray([r["impurityStats"] for r in own], float)
        built.append((
            np.asarray([r["split"]["featureIndex"] if r["leftChild"] >= 0 else -1 for r in own]),
            np.asarray([r["split"]["leftCategoriesOrThreshold"][0] if r["leftChild"] >= 0 else 0.0 for r in own]),
            np.asarray([r["leftChild"] for r in own]),
            np.asarray([r["rightChild"] for r in own]),
            stats[:, 1] / stats.sum(axis=1),
        ))
    return Forest(tuple(built))


def _found(texts: list[str | None], paths: list[str | None], forest: Forest, vocabulary: str) -> Iterator[tuple[int, int, int, str, float]]:
    """(text, start, end, value, score) of all candidates."""
    places, rows = [], []
    for i, text in enumerate(texts):
        for start, end in candidates(text or ""):
            value = text[start:end]
            places.append((i, start, end, value))
            rows.append(describe(value, text[max(0, start - REACH) : start], text[end : end + REACH], paths[i], vocabulary))
    for place, score in zip(places, forest.scores(np.asarray(rows, float).reshape(-1, len(FEATURES))), strict=True):
        yield (*place, float(score))


def masked(value: str) -> str:
    """The value's first signs and its length, enough to find it again."""
    return f"{value[:4]}...({len(value)})"


def scan(documents: DataFrame, forest: Forest, vocabulary: str, id_column: str = "doc_id", text_column: str = "text", path_column: str = "source") -> DataFrame:
    """One row for each candidate: doc_id, start, length (both in code points), masked, score, is_secret (score 0.5 or more).

    Null or empty texts have no candidates; null identifiers, null paths and repeated rows are taken as they are; other
    columns are not read; an empty table gives no rows.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            owners = batch.column("doc_id").to_pylist()
            rows = [(owners[i], a, b - a, masked(v), s) for i, a, b, v, s in _found(batch.column("text").to_pylist(), batch.column("path").to_pylist(), forest, vocabulary)]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64())
            columns = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "start", "length", "masked", "score"])

    texts = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"), F.col(path_column).cast("string").alias("path"))
    found = texts.mapInArrow(run, "doc_id long, start long, length long, masked string, score double")
    return found.withColumn("is_secret", F.col("score") >= 0.5)


def redact(documents: DataFrame, forest: Forest, vocabulary: str, text_column: str = "text", path_column: str = "source", length_column: str = "n_chars") -> DataFrame:
    """The same rows and columns with every secret replaced by REPLACEMENT; the length column follows changed texts."""
    names = documents.columns
    text_at, path_at, length_at = (names.index(c) for c in (text_column, path_column, length_column))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = batch.column(text_at).to_pylist()
            lengths = batch.column(length_at).to_pylist()
            spans: dict[int, list[tuple[int, int]]] = {}
            for i, start, end, _, score in _found(texts, batch.column(path_at).to_pylist(), forest, vocabulary):
                if score >= 0.5:
                    spans.setdefault(i, []).append((start, end))
            if spans:
                for i, own in spans.items():
                    for start, end in reversed(own):
                        texts[i] = texts[i][:start] + REPLACEMENT + texts[i][end:]
                    lengths[i] = len(texts[i])
                columns = list(batch.columns)
                columns[text_at] = pa.array(texts, batch.schema.field(text_at).type)
                columns[length_at] = pa.array(lengths, batch.schema.field(length_at).type)
                batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield batch

    return documents.mapInArrow(run, documents.schema)
