"""Credentials in source files and event payloads: scored candidates and redacted texts.

Candidates are the places where a credential can stand: private key blocks, passwords of URLs and user:password pairs,
authorization headers, published token formats, and values of assignments, options and settings, of any length. A
logistic regression decides on them. Its features are the likelihood of the characters under two Markov models (the
corpus' own words, and weakly labelled credentials), the composition of the value, the words of the identifier that it
belongs to, how it begins, the kind of place and the path; words, beginnings and paths are hashed, so their weights are
learnt and not listed. Patterns give weak labels, and only where they are sure; what they leave open has no label and
does not enter the fit, and none of the label's tests (token formats, placeholder and name lists) is a feature.

The models are fitted on all candidates and all words of the tables, together with the same SEEDS made-up examples at
every size: the executors add up bigrams and counts of names, then, for each Newton step, gradient and second derivatives
over blocks of feature rows; only these sums go to the driver. Scores are calibrated on the fifth of the candidates (by a
hash of value and name) that the regression leaves out for that. The texts are read once, their candidates are kept and
then scored; candidates with a calibrated score of at least CUTOFF are credentials. Redaction reads the texts a second time.

Redaction replaces the spans of credentials. Another occurrence of a credential in the same text is replaced only where it
is a whole string literal, or where its characters cannot be part of an identifier.

Defined results: null and empty contents, and raw_event values that are not valid JSON, hold none; contents of any
length are scanned whole; rows that repeat an id count once; equal credentials of a record count once; lone surrogates of
a JSON string count as `?`; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import binascii
import json
import math
import re
import zlib
from collections.abc import Callable, Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions import json_walk
from riskloom.runtime import cut

#: Up to so many labelled candidates the driver adds up their blocks itself; the sums are the same.
LOCAL_ROWS = 50_000
#: Rows and characters of the values in a block, rows for a task of a Newton step, and its largest number of tasks.
BLOCK_ROWS, BLOCK_CHARACTERS, TASK_ROWS, TASKS = 4096, 2_000_000, 500_000, 256
#: Made-up examples of each kind that take part in every fit.
SEEDS = 200
CUTOFF = 0.5
MASK = "REDACTED"

#: Languages and endings of program files; settings and options stand without quotes in all others.
PROGRAMS = ("python", "javascript", "typescript")
PROGRAM_PATHS = (".py", ".pyw", ".pyi", ".js", ".mjs", ".cjs", ".jsx", ".ts", ".mts", ".cts", ".tsx")
#: Published formats of tokens.
KNOWN = re.compile(
    r"(?<![A-Za-z0-9_])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9_]{60,}|glpat-[A-Za-z0-9_-]{20}"
    r"|npm_[A-Za-z0-9]{36}|xox[abeoprs]-[A-Za-z0-9-]{10,}|[rs]k_live_[A-Za-z0-9]{16,}|pypi-AgE[A-Za-z0-9_-]{20,}|AIza[A-Za-z0-9_-]{35}"
    r"|SG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43}|hf_[A-Za-z0-9]{34}|dop_v1_[0-9a-f]{64}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})"
    r"(?![A-Za-z0-9_])"
)
PRIVATE_KEY = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----(?:(?!-----BEGIN).)*?-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----", re.DOTALL)
URL = re.compile(r"[A-Za-z][A-Za-z0-9+.-]{1,20}://([^\s/:@\"'<>`]*):([^\s/@\"'`]+)@(?=[\w\[$<{])")
HEADER = re.compile(r"(?i)(?<![A-Za-z0-9_])(bearer|basic)[ ]+([A-Za-z0-9+/=._~-]{6,})")
#: A quoted value behind the end of a separator; the name is read backwards from there.
QUOTED = re.compile(
    r"""[=:,>|?][ \t\r\n]{0,4}[rbu]?(?:"([^"\r\n\\]*+(?:\\[^\r\n][^"\r\n\\]*+)*+)"|'([^'\r\n\\]*+(?:\\[^\r\n][^'\r\n\\]*+)*+)'"""
    r"""|`([^`\r\n\\]*+(?:\\[^\r\n][^`\r\n\\]*+)*+)`)"""
)
SETTING = re.compile(r"(?m)^[ \t]*(?:-[ \t]+)*(?:export[ ]+)?([A-Za-z_][\w.-]*)[ \t]*[=:][ \t]*([^\s\"'][^\r\n]{4,}[^\s\r\n])[ \t]*\r?$")
OPTION = re.compile(r"(?<![\w=/-])(?:--?)?([A-Za-z_][\w.-]*)=([^\s\"'=][^\s\"']{4,}+)|(?<!\S)--([A-Za-z][\w-]*) ([^\s\"'-][^\s\"']{4,}+)")
PAIR = re.compile(r"(?<!\S)(?:-u|--user|--proxy-user)[ =][\"']?([^\s:\"']+):([^\s\"']+)")

_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
SECRET_WORDS = frozenset(
    "password passwd pwd pass passphrase passwort secret token apikey credential credentials auth authtoken pgpassword "
    "sshpassphrase mysqlpwd pin accesskey secretkey privatekey psk".split()
)
KEY_BEFORE = frozenset("api access secret private signing encryption master account storage shared ssh service app client".split())
HASH_WORDS = frozenset(
    "sha sha1 sha256 sha384 sha512 md5 hash checksum digest integrity commit rev revision build etag version public fingerprint "
    "signature pixel image uuid guid resolved crc ref tag id url href src path file name email date time".split()
)
PLACEHOLDER = re.compile(
    r"(?i)^(?:<.*>|\[.*\]|\{\{.*\}\}|\$\{?.*|%.*%|#\{.*\}|x{4,}.*|\*+.*|\.{3,}|-+|_+|0+|null|none|true|false|undefined|n/?a|todo|tbd|fixme"
    r"|.*\*{3,}.*|.*[x•]{5,}.*|.*\.\.\.|change.?me.*|replace.?(?:me|this).*|insert.*here|your[-_ ].*|my[-_ ]?(?:password|secret|token|key)\w*|.*[-_ ]here"
    r"|(?:dummy|fake|sample|example|placeholder|redacted|masked|hidden|removed|test|foo|bar|secret|password|passwd|token|api[-_]?key)(?:[-_ ]?(?:value|password|secret|token|key|\d{1,3}))?)$"
    r"|example(?:key)?$|placeholder|redacted"
)
CALL = re.compile(r"\w\(")
REFERENCE = re.compile(r"(?i)^(?:process\.env|os\.environ|os\.getenv|getenv|env[.(\[:]|vault:|secrets?[.:/]|ssm:|arn:|file:|keyring|config[.(\[]|settings[.(\[]|self\.|this\.)|\$\{|\$\(|\{\w*\}|%\(")
_KNOWN_MARKS = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "npm_", "xox", "k_live_", "pypi-AgE", "AIza", "SG.", "hf_", "dop_v1_", "eyJ")
#: Hashes, ids, addresses, paths, versions and file names.
PUBLIC_SHAPE = re.compile(
    r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$|(?:sha\d+-|md5[-:]|sha\d+:)"
    r"|data:|[A-Za-z]+://|[.~]{1,2}/|/?(?:[a-z0-9_.-]+/)+[a-z0-9_.-]*$|/[a-z0-9_.-]+$|@|[v^~<>=]*\d+(?:\.\d+)+|(?=\S*[/\\])\S*\.\w{1,5}$"
)
#: Identifiers and phrases of plain lower-case words.
PLAIN = re.compile(r"_*[a-z]+(?:[_ -][a-z]+)*_*$|_*[A-Z]+(?:_[A-Z]+)*_*$")
#: A word with a short number behind it, as in the tables of minified files.
NUMBERED = re.compile(r"[a-z]{3,}[0-9a-f]{1,3}")
PLACES = ("key", "url", "bearer", "basic", "bare", "assigned", "setting", "option", "pair", "field")
#: Buckets of the hashed features.
NAME_BUCKETS, BEGIN_BUCKETS, PATH_BUCKETS = 1 << 16, 512, 32
DENSE = 1 + len(PLACES) + 24
#: Stands behind the path of a value in a line of more than LONG characters, as minified files have.
LONG, LONG_LINE = 250, "\0long"
#: Columns of the Markov features.
MARKOV = tuple(range(1 + len(PLACES), 1 + len(PLACES) + 4))
#: Dense columns that also count times the name's score, and times one less it.
CROSSED = (*MARKOV, *range(MARKOV[-1] + 1, DENSE))
WIDE = DENSE + 1 + 2 * len(CROSSED)
WIDTH = WIDE + BEGIN_BUCKETS + PATH_BUCKETS
#: Weights of all columns but the beginnings.
_APART = np.r_[0:WIDE, WIDE + BEGIN_BUCKETS : WIDTH]
_WORD = re.compile(r"[A-Za-z][A-Za-z_]{3,20}")

Candidate = tuple[int, int, str, str]  # start, end, place, name


def candidates(text: str, settings: bool, options: bool) -> list[Candidate]:
    """Places of a text where a credential can stand; of overlapping ones the first in the order of the places."""
    found: list[Candidate] = []
    taken: list[tuple[int, int]] = []

    def add(start: int, end: int, place: str, name: str = "") -> None:
        for a, b in taken:
            if start < b and a < end:
                return
        found.append((start, end, place, name))
        taken.append((start, end))

    if "PRIVATE KEY" in text:
        for m in PRIVATE_KEY.finditer(text):
            add(m.start(), m.end(), "key")
    if "://" in text:
        for m in URL.finditer(text):
            add(m.start(2), m.end(2), "url", m[1])
    if "earer " in text or "asic " in text or "BEARER " in text or "BASIC " in text:
        for m in HEADER.finditer(text):
            if m[1].lower() == "basic" or any(c.isdigit() for c in m[2]):
                add(m.start(2), m.end(2), m[1].lower())
    if any(mark in text for mark in _KNOWN_MARKS):
        for m in KNOWN.finditer(text):
            name = _name_before(text, m.start())
            add(m.start(), m.end(), "assigned" if name else "bare", name)
    if " -u " in text or "-user" in text:
        for m in PAIR.finditer(text):
            add(m.start(2), m.end(2), "pair", "user")
    for m in QUOTED.finditer(text):
        k = m.lastindex
        if k and m.end(k) - m.start(k) >= 6 and (name := _name_of(text, m.start())) and _worth(m[k], name):
            add(m.start(k), m.end(k), "assigned", name)
    if settings:
        for m in SETTING.finditer(text):
            if _worth(m[2], m[1]):
                add(m.start(2), m.end(2), "setting", m[1])
    if options:
        for m in OPTION.finditer(text):
            k = 2 if m[2] else 4
            if _worth(m[k], m[k - 1]):
                add(m.start(k), m.end(k), "option", m[k - 1])
    return found


def _name_of(text: str, at: int) -> str:
    """The name before the separator whose last character stands at `at`."""
    mark = text[at]
    if mark in ">|?":
        if at and text[at - 1] != ("=" if mark == ">" else mark):
            return ""
        at -= 1
    elif mark == "=" and at and text[at - 1] == ":":
        at -= 1
    end = at
    while at - end > -4 and end > 0 and text[end - 1].isspace():
        end -= 1
    last = end
    while last - end < 3 and end > 0 and text[end - 1] in "\"'])":
        end -= 1
    begin = end
    while begin > 0 and (text[begin - 1].isalnum() or text[begin - 1] in "_$.-"):
        begin -= 1
    return text[begin:end].lstrip("0123456789.-")


def _name_before(text: str, at: int) -> str:
    """The name of the value that starts at `at`, quoted or not."""
    k = at - 1
    if k >= 0 and text[k] in "\"'`":
        k -= 1
    while k >= 0 and text[k] in " \t\r\n":
        k -= 1
    return _name_of(text, k) if k >= 0 and text[k] in "=:,>|?" else ""


_MIXES = re.compile(r"(?=\D*\d)(?=[^A-Za-z]*[A-Za-z])\S+\Z")


def _worth(value: str, name: str) -> bool:
    """Whether a value needs a score: it is one word that mixes classes of characters, or its name speaks of a secret."""
    return bool(_MIXES.match(value)) or is_secret_name(name) or _mixed(value)


_names: dict[str, tuple[bool, bool, tuple[int, ...]]] = {}


def _named(name: str) -> tuple[bool, bool, tuple[int, ...]]:
    """(speaks of a secret, speaks of a hash or another public value, buckets of its words, pairs of words, begin and end)."""
    if name in _names:
        return _names[name]
    words = [w.lower() for w in _WORDS.findall(re.sub(r"[_-]?\d+$", "", name))]
    secret = any(
        w in SECRET_WORDS or w == "key" and k and words[k - 1] in KEY_BEFORE or w.endswith(("password", "passwd", "secret", "token", "passphrase"))
        for k, w in enumerate(words)
    )
    public = any(w in HASH_WORDS for w in words)
    joined = "".join(words)
    terms = [*words, *(f"{a} {b}" for a, b in zip(words, words[1:])), "^" + joined[:5], joined[-5:] + "$"]
    buckets = tuple({_bucket(t, NAME_BUCKETS) for t in terms})
    if len(_names) > 100_000:
        _names.clear()
    _names[name] = secret, public, buckets
    return _names[name]


def is_secret_name(name: str) -> bool:
    return _named(name)[0]


def is_placeholder(value: str) -> bool:
    if PLACEHOLDER.search(value) or REFERENCE.search(value) or value.endswith(")") and CALL.search(value):
        return True
    # long values of an alphabet such as hex or base64 have few characters for their length, so the limit ends at 8
    return len(set(value)) <= max(2, min(len(value) // 8, 8))


def _bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("ascii", "replace"), np.uint8) & 0x7F


def bigrams(words: list[str]) -> np.ndarray:
    """Counts of the words' character bigrams."""
    at = _bytes("\n".join(words)).astype(np.int64)
    pairs = at[:-1] * 128 + at[1:]
    pairs = pairs[(at[:-1] != 10) & (at[1:] != 10)] if len(at) else pairs
    return np.bincount(pairs, minlength=128 * 128).reshape(128, 128)


class Markov:
    """Character bigrams; `log` has the log likelihood of each transition."""

    def __init__(self, counts: np.ndarray):
        self.log = np.log((counts + 0.2) / (counts + 0.2).sum(axis=1, keepdims=True))



def _mixed(value: str) -> bool:
    """A long run of letters and signs that changes case within."""
    return len(value) >= 12 and bool(re.fullmatch(r"[A-Za-z0-9+/=_-]+", value)) and len(re.findall(r"[a-z][A-Z]|[A-Z][a-z]", value)) >= len(value) / 5


_CLASS = np.zeros(128, np.int64)  # 0 sign, 1 digit, 2 upper, 3 lower, 4 blank
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123], _CLASS[[9, 10, 13, 32]] = 1, 2, 3, 4
_CLASSES = np.eye(5)[_CLASS]
_TEMPLATE, _ADDRESS, _JOINT = (np.isin(np.arange(128), [ord(c) for c in s]) for s in ("<>{}[]$%*()", "/.:@\\", "_-"))
_HEX = np.isin(np.arange(128), [ord(c) for c in "0123456789abcdef"])
_ARMOUR = re.compile(r"-----[^\r\n-]*-----")


def features(found: list[tuple[str, str, str, str]], words: Markov, secrets: Markov) -> np.ndarray:
    """The dense features of (value, place, name, path), one row each."""
    n_rows = len(found)
    parts = [_bytes(_ARMOUR.sub("", v) if place == "key" else v) for v, place, _, _ in found]
    parts = [p if len(p) > 1 else np.array([32, 32], np.uint8) for p in parts]
    n = np.array([len(p) for p in parts])
    at = np.concatenate(parts).astype(np.int64)
    begins = np.concatenate([[0], np.cumsum(n)[:-1]])
    row = np.repeat(np.arange(n_rows), n)
    counts = np.zeros((n_rows, 128))
    np.add.at(counts, (row, at), 1)
    share = counts / n[:, None]
    entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1)
    kinds = share @ _CLASSES
    # transitions: each row has n - 1 of them; the one that leads over to the next row counts as nothing
    inner = np.append(row[1:] == row[:-1], False)
    following = np.append(at[1:], 32)
    sums = []
    for model in (words, secrets):
        steps = np.where(inner, model.log[at, following], 0.0)
        sums.append((steps, np.add.reduceat(steps, begins) / (n - 1)))
    (steps, plain), (_, odd) = sums
    turns = np.add.reduceat(np.where(inner & (_CLASS[at] != _CLASS[following]), 1.0, 0.0), begins) / (n - 1)
    # mean over the least likely window of 8 transitions; shorter values are one window
    running = np.concatenate([[0.0], np.cumsum(steps)])
    ends = np.minimum(np.arange(len(at)) + 8, len(at))
    window = (running[ends] - running[:-1]) / 8
    position = np.arange(len(at)) - begins[row]
    window = np.where(position <= (n - 9)[row], window, np.inf)
    lowest = np.minimum.reduceat(window, begins)
    lowest = np.where(np.isfinite(lowest), lowest, plain)
    template, address, joint, hexes = (share[:, m].sum(axis=1) for m in (_TEMPLATE, _ADDRESS, _JOINT, _HEX))
    x = np.zeros((n_rows, DENSE))
    x[:, 0] = 1
    x[np.arange(n_rows), [1 + PLACES.index(place) for _, place, _, _ in found]] = 1
    x[:, MARKOV[0] :] = np.column_stack([
        -plain / 3, -odd / 3, odd - plain, -lowest / 3, entropy / 4, np.log(n) / 4, kinds, turns, template, address, joint, hexes,
        (kinds[:, 1] > 0) & (kinds[:, 2] + kinds[:, 3] > 0), (kinds[:, 2] > 0) & (kinds[:, 3] > 0), hexes > 0.999, n < 8, n >= 16, n >= 32, n >= 110,
        [path.endswith(LONG_LINE) for _, _, _, path in found],
    ])
    return x


class Names:
    """How often the terms of names (and places) go with credentials: summed log odds, 0 for terms never seen."""

    def __init__(self) -> None:
        self.counts = np.zeros((2, NAME_BUCKETS))

    @staticmethod
    def terms(place: str, name: str) -> list[int]:
        return [_bucket("\0" + place, NAME_BUCKETS), *_named(name)[2]] if name else [_bucket("\0" + place, NAME_BUCKETS)]

    def add(self, place: str, name: str, holds: bool, weight: float) -> None:
        self.counts[int(holds), self.terms(place, name)] += weight

    def scores(self, found: list[tuple[str, str, str, str]], own: list[tuple[bool, float]] | None = None) -> np.ndarray:
        """Scores from 0 to 1; with `own`, each row's own count is left out, as for a name that the counts have not seen."""
        out, known = np.empty(len(found)), {}
        for k, (_, place, name, _) in enumerate(found):
            key = place, name, own[k] if own else None
            if key not in known:
                counts = self.counts[:, self.terms(place, name)].copy()
                if own:
                    counts[int(own[k][0])] -= own[k][1]
                counts = np.maximum(counts, 0)
                known[key] = np.log((counts[1] + 0.5) / (counts[0] + 0.5)).sum()
            out[k] = known[key]
        return _sigmoid(out)


class Block(NamedTuple):
    """Rows of features, ordered by their beginnings: the dense ones and the name's score, the bucket of the beginning, up to
    two buckets of the path (-1 for none), with the labels and the weight that each row has."""

    part: np.ndarray
    begin: np.ndarray
    path: np.ndarray
    y: np.ndarray
    weight: float


def block(found: list[tuple[str, str, str, str]], words: Markov, secrets: Markov, score: np.ndarray, y: np.ndarray, weight: float) -> Block:
    part = np.hstack([features(found, words, secrets), score[:, None]]).astype(np.float32)
    begin, path = np.empty(len(found), np.int16), np.full((len(found), 2), -1, np.int8)
    for k, (value, _, _, where) in enumerate(found):
        low = where.removesuffix(LONG_LINE).lower()
        begin[k] = _bucket(value[:4], BEGIN_BUCKETS)
        for side, term in enumerate((low.rsplit("/", 1)[-1].rsplit(".", 1)[-1], *low.split("/")[:-1][-1:])):
            path[k, side] = _bucket(term, PATH_BUCKETS)
    order = np.argsort(begin, kind="stable")
    return Block(part[order], begin[order], path[order], y[order], weight)


def _apart(rows: Block) -> np.ndarray:
    """All features but the beginnings: the dense ones, the name's score, dense ones crossed with it, and paths."""
    out = np.zeros((len(rows.y), len(_APART)))
    out[:, : DENSE + 1] = rows.part
    crossed, score = out[:, CROSSED[0] : DENSE], out[:, DENSE, None]
    out[:, DENSE + 1 : DENSE + 1 + len(CROSSED)] = crossed * score
    out[:, DENSE + 1 + len(CROSSED) : WIDE] = crossed * (1 - score)
    for side in (0, 1):
        there = np.flatnonzero(rows.path[:, side] >= 0)
        out[there, WIDE + rows.path[there, side]] = 1
    return out


def logits(rows: Block, weights: np.ndarray) -> np.ndarray:
    return _apart(rows) @ weights[_APART] + weights[WIDE + rows.begin]


def moments(rows: Block, weights: np.ndarray) -> np.ndarray:
    """Log loss, its gradient and its second derivatives, as one row: those among the columns apart from the beginnings,
    those of beginnings with them, and those of each beginning."""
    x = _apart(rows)
    z = x @ weights[_APART] + weights[WIDE + rows.begin]
    p = _sigmoid(z)
    off, curve = (p - rows.y) * rows.weight, p * (1 - p) * rows.weight
    gradient = np.empty(WIDTH)
    gradient[_APART] = off @ x
    gradient[WIDE : WIDE + BEGIN_BUCKETS] = np.bincount(rows.begin, off, BEGIN_BUCKETS)
    bent, across = x * curve[:, None], np.zeros((BEGIN_BUCKETS, len(_APART)))
    starts = np.flatnonzero(np.r_[True, rows.begin[1:] != rows.begin[:-1]])
    across[rows.begin[starts]] = np.add.reduceat(bent, starts, axis=0)
    return np.concatenate([[_loss(z, rows)], gradient, (bent.T @ x).ravel(), across.ravel(), np.bincount(rows.begin, curve, BEGIN_BUCKETS)])


def _loss(z: np.ndarray, rows: Block) -> float:
    return float((np.logaddexp(0, z) - rows.y * z).sum() * rows.weight)


def _unpacked(flat: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss, gradient and matrix of second derivatives of `moments`."""
    n = len(_APART)
    loss, gradient, inner, across, single = np.split(flat, np.cumsum([1, WIDTH, n * n, BEGIN_BUCKETS * n]))
    begins, hessian = np.arange(WIDE, WIDE + BEGIN_BUCKETS), np.zeros((WIDTH, WIDTH))
    hessian[np.ix_(_APART, _APART)] = inner.reshape(n, n)
    hessian[np.ix_(begins, _APART)] = across.reshape(BEGIN_BUCKETS, n)
    hessian[np.ix_(_APART, begins)] = across.reshape(BEGIN_BUCKETS, n).T
    hessian[begins, begins] = single
    return float(loss[0]), gradient, hessian


def scale_moments(rows: Block, weights: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """The same for the two numbers of the calibration."""
    x = np.column_stack([logits(rows, weights), np.ones(len(rows.y))])
    z = x @ scale
    p = _sigmoid(z)
    return np.concatenate([[_loss(z, rows)], ((p - rows.y) * rows.weight) @ x, ((x * (p * (1 - p) * rows.weight)[:, None]).T @ x).ravel()])


def errors(rows: Block, weights: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """(rows, rows decided otherwise than labelled, squared differences) of the rows that are not made up."""
    if rows.weight != 1:
        return np.zeros(3)
    p = _sigmoid(scale[0] * logits(rows, weights) + scale[1])
    return np.array([len(p), ((p >= CUTOFF) != rows.y).sum(), ((p - rows.y) ** 2).sum()])


def _stretches(lengths: list[int]) -> Iterator[slice]:
    """Cuts rows with values of these lengths into blocks."""
    begin = size = 0
    for k, n in enumerate(lengths):
        if k > begin and (k - begin == BLOCK_ROWS or size + n > BLOCK_CHARACTERS):
            yield slice(begin, k)
            begin, size = k, 0
        size += n
    if lengths:
        yield slice(begin, len(lengths))


def _bucket(term: str, buckets: int) -> int:
    return zlib.crc32(term.encode("utf-8", "replace")) % buckets


def weak_label(value: str, place: str, name: str, path: str = "") -> float | None:
    """1 for what patterns surely take for a credential, 0 for what they surely rule out, None where they do not tell."""
    secret, public, _ = _named(name)
    if place == "key":
        return 1.0 if len(re.findall(r"[A-Za-z0-9+/]", value)) > 100 else 0.0
    if is_placeholder(value):
        return 0.0
    if place == "basic":
        return 1.0 if _is_basic(value) else None
    if KNOWN.fullmatch(value):
        return 1.0
    both = any(map(str.isdigit, value)) and any(map(str.isalpha, value))
    if place in ("url", "pair", "bearer"):
        return 1.0 if both and len(value) >= 8 else None
    if PUBLIC_SHAPE.match(value) or PLAIN.match(value) or path.endswith(LONG_LINE) and NUMBERED.fullmatch(value):
        return 0.0
    if secret and not public:
        return 1.0 if both and len(value) >= 10 and not re.search(r"\s", value) else None
    if public and not secret:
        return 0.0
    # a value with another name and no known format: all but a few such values are plain data
    return None if secret else 0.0


def _is_basic(value: str) -> bool:
    try:
        return b":" in base64.b64decode(value, validate=True)
    except (binascii.Error, ValueError):
        return False


class Model:
    def __init__(self, weights: np.ndarray, scale: tuple[float, float], words: Markov, secrets: Markov, names: Names):
        self.weights, self.scale, self.words, self.secrets, self.names = weights, scale, words, secrets, names
        self.report: dict[str, float] = {}

    def scores(self, found: list[tuple[str, str, str, str]]) -> np.ndarray:
        """Calibrated probabilities of (value, place, name, path)."""
        out = np.empty(len(found))
        for at in _stretches([len(one[0]) for one in found]):
            part = found[at]
            # the labels tell where the block has put its rows
            rows = block(part, self.words, self.secrets, self.names.scores(part), np.arange(len(part)), 1.0)
            out[at.start + rows.y] = _sigmoid(self.scale[0] * logits(rows, self.weights) + self.scale[1])
        return out

    def without_markov(self) -> "Model":
        """The same model with the weights of all Markov features set to nothing."""
        weights = self.weights.copy()
        weights[list(MARKOV)] = 0
        for side in (0, 1):
            weights[[DENSE + 1 + side * len(CROSSED) + k for k in range(len(MARKOV))]] = 0
        return Model(weights, self.scale, self.words, self.secrets, self.names)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _newton(ridge: np.ndarray, sums: Callable[[np.ndarray], tuple[float, np.ndarray, np.ndarray]], steps: int = 100) -> np.ndarray:
    """Weights of a logistic regression by Newton steps, halved where they raise the loss; `sums` gives loss, gradient and
    second derivatives over all rows."""
    w, step, least = np.zeros(len(ridge)), np.zeros(len(ridge)), np.inf
    for _ in range(steps):
        loss, gradient, hessian = sums(w)
        loss += (ridge * w * w).sum() / 2
        if loss > least + 1e-9 * abs(least):
            step /= 2
            w += step
            continue
        least = loss
        step = np.linalg.solve(hessian + np.diag(ridge + 1e-9), gradient + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-5:
            return w
    raise ArithmeticError(f"the regression does not settle within {steps} steps")


def seeds() -> list[tuple[str, str, str, str, float]]:
    """(value, place, name, path, label): made-up examples of both kinds, so that a fit never lacks one."""
    rng = np.random.Generator(np.random.PCG64(11))
    mixed = np.array(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"))
    words = "red table of the last city where water runs under long stone bridge and small green field".split()
    secret_names = ("password", "api_key", "auth_token", "client_secret", "access_key")
    other_names = ("", "value", "x", "item", "option")

    def drawn(n: int, least: int = 0, most: int = 62) -> str:
        return "".join(mixed[rng.integers(least, most, n)])

    out = []
    for k in range(SEEDS):
        name, other = secret_names[k % 5], other_names[k % 5]
        word, second = words[k % len(words)], words[(k * 7 + 3) % len(words)]
        formats = (
            "ghp_" + drawn(36), "AKIA" + drawn(16, 0, 26), "glpat-" + drawn(20), "npm_" + drawn(36), "sk_live_" + drawn(24), "AIza" + drawn(35),
            f"xoxb-{rng.integers(10**10)}-{rng.integers(10**10)}-{drawn(24)}", "pypi-AgEI" + drawn(60), f"eyJhbGciOi{drawn(12)}.eyJzdWIi{drawn(30)}.{drawn(43)}",
        )
        hexes = "".join(np.array(list("0123456789abcdef"))[rng.integers(0, 16, 40)])
        out.append((formats[k % 9], "assigned" if other else "bare", other, "src/app.py", 1.0))
        out.append(((drawn(16), hexes[:32], f"{word}-{drawn(9)}", f"{word}.{drawn(12)}", drawn(40))[k // 5 % 5], "assigned", name, "src/app.py", 1.0))
        value = (f"{word}{'_ -'[k % 3]}{second}", "changeme", "${" + name.upper() + "}", "<set-me>", "env:" + name.upper(), f"{word} {second} {word}")[k // 5 % 6]
        out.append((value, "assigned", name, "src/app.py", 0.0))
        out.append(((hexes, drawn(64), f"{word}{k}", hexes[:10], drawn(90))[k // 5 % 5], "assigned", other or "checksum", "src/app.py", 0.0))
        public = ("expected_sha256", "checksum", "commit", "build_id", "content_hash", "integrity", "digest", "etag", "revision")[k % 9]
        ids = (hexes + hexes[:24], hexes, hexes[:32], f"{hexes[:8]}-{hexes[8:12]}-{hexes[12:16]}-{hexes[16:20]}-{hexes[20:32]}", "sha512-" + drawn(86) + "==")
        out.append((ids[k // 9 % 5], "assigned", public, "src/app.py", 0.0))
    return out


class Judged(NamedTuple):
    """A candidate (value, place, name, path) with its weak label, whether it is held out for the calibration, and whether it
    tells that its name is one of credentials."""

    one: tuple[str, str, str, str]
    label: float | None
    held: bool
    holds: bool


def judged(one: tuple[str, str, str, str], label: float | None) -> Judged:
    # a placeholder tells, as a credential does, that its name is one of credentials
    holds = bool(label) or label is not None and is_placeholder(one[0]) and not PLAIN.match(one[0])
    return Judged(one, label, _bucket(f"{one[0]}\0{one[2]}", 5) == 0, holds)


class Counted:
    """What the models but the regression are made of: bigrams of words and of labelled credentials, counts of names."""

    def __init__(self) -> None:
        self.words, self.secrets, self.names = np.zeros((128, 128), np.int64), np.zeros((128, 128), np.int64), Names()
        self.rows = np.zeros(2, np.int64)  # labelled rows: fitted, held out

    def add(self, rows: list[Judged], weight: float) -> None:
        rows = [r for r in rows if r.label is not None]
        for r in rows:
            self.rows[int(r.held)] += 1
            if not r.held:
                self.names.add(r.one[1], r.one[2], r.holds, weight)
        self.secrets += bigrams([_ARMOUR.sub("", r.one[0]) for r in rows if r.label and not r.held])

    def arrays(self) -> dict[str, np.ndarray]:
        """Flat views of the counts."""
        return {"words": self.words.reshape(-1), "secrets": self.secrets.reshape(-1), "names": self.names.counts.reshape(-1), "rows": self.rows}


def blocks(rows: list[Judged], weight: float, words: Markov, secrets: Markov, names: Names) -> Iterator[tuple[bool, Block]]:
    """(held out, block) of the labelled rows."""
    for held in (False, True):
        side = [r for r in rows if r.label is not None and r.held == held]
        for at in _stretches([len(r.one[0]) for r in side]):
            found = [r.one for r in side[at]]
            own = [(r.holds, 0.0 if held else weight) for r in side[at]]
            yield held, block(found, words, secrets, names.scores(found, own), np.array([r.label for r in side[at]]), weight)


def _total(parts: Iterator[np.ndarray]) -> np.ndarray | float:
    total = 0.0
    for part in parts:
        total = total + part
    return total


class Rows:
    """Blocks of labelled rows: some here, others in a table of (held, part, begin, path, y)."""

    def __init__(self, here: list[tuple[bool, Block]], table: DataFrame | None = None):
        self.here, self.table = here, table

    def total(self, held: bool, sums: Callable[[Block], np.ndarray]) -> np.ndarray:
        """The sums of all blocks on one side."""
        parts = [sums(b) for side, b in self.here if side == held]
        if self.table is not None:

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                total = _total(sums(_unpack(r)) for batch in batches for r in batch.to_pylist())
                out = [total.tobytes()] if isinstance(total, np.ndarray) else []
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["sums"])

            parts += [np.frombuffer(r.sums) for r in self.table.where(F.col("held") == held).mapInArrow(run, "sums binary").collect()]
        return _total(iter(parts))


def _packed(held: bool, rows: Block) -> dict:
    return {"held": held, "part": rows.part.tobytes(), "begin": rows.begin.tobytes(), "path": rows.path.tobytes(), "y": rows.y.astype(np.uint8).tobytes()}


def _unpack(r: dict) -> Block:
    part, begin, path = np.frombuffer(r["part"], np.float32), np.frombuffer(r["begin"], np.int16), np.frombuffer(r["path"], np.int8)
    return Block(part.reshape(-1, DENSE + 1), begin, path.reshape(-1, 2), np.frombuffer(r["y"], np.uint8).astype(float), 1.0)


def estimated(counted: Counted, others: Callable[[Markov, Markov, Names], Rows]) -> Model:
    """The model of counts and of the rows that `others` gives for the models of these counts; made-up examples join both."""
    made_up = [judged(tuple(one), label) for *one, label in seeds()]
    counted.add(made_up, 0.5)
    parts = Markov(counted.words), Markov(counted.secrets), counted.names
    rows = others(*parts)
    rows.here += blocks(made_up, 0.5, *parts)
    ridge = np.full(WIDTH, 0.05)
    ridge[WIDE:] = 0.2
    w = _newton(ridge, lambda w: _unpacked(rows.total(False, partial(moments, weights=w))))

    def scale_sums(scale: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        flat = rows.total(True, partial(scale_moments, weights=w, scale=scale))
        return flat[0], flat[1:3], flat[3:].reshape(2, 2)

    scale = _newton(np.full(2, 0.01), scale_sums)  # the made-up examples held out are of both kinds
    model = Model(w, tuple(scale), *parts)
    n, wrong, squares = rows.total(True, partial(errors, weights=w, scale=scale))
    model.report = {"fitted": int(counted.rows[0]), "held_out": int(n), "held_out_wrong": int(wrong), "brier": float(squares / max(n, 1))}
    return model


def fit(found: list[tuple[str, str, str, str]], counts: np.ndarray) -> Model:
    """The model of all these (value, place, name, path) and of the bigram counts of the corpus' words."""
    counted, rows = Counted(), [judged(one, weak_label(*one)) for one in found]
    counted.words += counts.astype(np.int64)
    counted.add(rows, 1.0)
    model = estimated(counted, lambda *parts: Rows(list(blocks(rows, 1.0, *parts))))
    open_ = [r.one for r in rows if r.label is None]
    model.report |= {
        "unlabelled": len(open_),
        "unlabelled_taken": int((model.scores(open_) >= CUTOFF).sum()),
        "changed_without_markov": int(((model.scores(found) >= CUTOFF) != (model.without_markov().scores(found) >= CUTOFF)).sum()),
    }
    return model


class _Frame:
    __slots__ = ("array", "key", "named", "above")

    def __init__(self, array: bool, above: "_Frame | None", key: str):
        self.array, self.above, self.key, self.named = array, above, key, None


_JSON_TOKEN = re.compile(r'"((?:[^"\\]|\\.)*)"|[{}\[\]:,]|[^\s{}\[\]:,"]+', re.DOTALL)
_ESCAPE = re.compile(r"\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\.", re.DOTALL)


class _Decoded:
    """A JSON string's value with the place of each of its characters in the raw text."""

    def __init__(self, raw: str, base: int = 0, outer: "_Decoded | None" = None):
        self.text = json.loads(f'"{raw}"', strict=False) if "\\" in raw else raw
        self.base, self.outer, self.jumps = base, outer, []
        for k, m in enumerate(_ESCAPE.finditer(raw)):
            # (place in the value behind the escape, place in the raw text behind it)
            before = self.jumps[-1] if self.jumps else (0, 0)
            self.jumps.append((before[0] + m.start() - before[1] + 1, m.end()))

    def raw(self, at: int) -> int:
        low, high = 0, len(self.jumps)
        while low < high:
            middle = (low + high) // 2
            if self.jumps[middle][0] <= at:
                low = middle + 1
            else:
                high = middle
        value, raw = self.jumps[low - 1] if low else (0, 0)
        place = self.base + raw + at - value
        return self.outer.raw(place) if self.outer else place


def texts_of(raw: str) -> Iterator[tuple[str, _Decoded]]:
    """(key, string) of every string value in a JSON text; a text that encodes another JSON text stands for that. An entry
    of headers or variables goes by its name: the key of {"name": n, "value": v} is n for the string v."""
    ok, value = json_walk.parse(raw)
    if not ok:
        return
    outer, text = None, raw
    whole = _JSON_TOKEN.match(raw.strip(" \t\r\n"))
    if isinstance(value, (dict, list)) and whole and whole[1] is not None:
        outer = _Decoded(whole[1], raw.index('"') + 1)
        text = outer.text
    found: list[tuple[_Frame, _Decoded]] = []
    frame, wants_key = _Frame(True, None, ""), False
    for m in _JSON_TOKEN.finditer(text):
        mark = m[0]
        if m[1] is not None:
            if wants_key:
                frame.key, wants_key = _Decoded(m[1]).text, False
                continue
            leaf = _Decoded(m[1], m.start() + 1, outer)
            if not frame.array and frame.key in ("name", "key", "header") and (frame.named is None or frame.named[0] > "header name key".index(frame.key)):
                frame.named = ("header name key".index(frame.key), leaf.text)
            spot = _Frame(frame.array, frame.above, frame.key)
            found.append((frame, spot, leaf))
        elif mark in "{[":
            inner = _Frame(mark == "[", frame, frame.key)
            frame, wants_key = inner, mark == "{"
        elif mark in "}]":
            frame, wants_key = frame.above, False
        elif mark == ",":
            wants_key = not frame.array
    for frame, spot, leaf in found:
        key, holder = spot.key, frame
        while holder.array and holder.above is not None:
            holder = holder.above
        yield (holder.named[1] if key.lower() == "value" and holder.named else key), leaf


def record_candidates(origin: str, text: str, language: str, path: str = "") -> Iterator[tuple[int, int, str, str, str, str]]:
    """(start, end, value, place, name, path) of a record's candidates; start and end are places in the text as it stands,
    and the path is marked where the value stands in a long line."""
    if origin == "source_files":
        plain = language not in PROGRAMS and not path.lower().endswith(PROGRAM_PATHS)
        for start, end, place, name in candidates(text, settings=plain, options=plain):
            line = text.find("\n", end)
            wide = (len(text) if line < 0 else line) - text.rfind("\n", 0, start) > LONG + max(0, end - start - LONG)
            yield start, end, text[start:end], place, name, path + LONG_LINE if wide else path
        return
    for key, leaf in texts_of(text):
        found = candidates(leaf.text, settings=False, options=True)
        for start, end, place, name in found:
            yield leaf.raw(start), leaf.raw(end), leaf.text[start:end], place, name, ""
        value = leaf.text
        if not found and len(value) >= 6 and not re.search(r"\s", value) and _worth(value, key) and is_secret_name(key):
            yield leaf.raw(0), leaf.raw(len(value)), value, "field", key, ""


def records(files: DataFrame | None, events: DataFrame | None) -> DataFrame:
    """(origin, record_id, path, language, text) of both tables."""
    parts = []
    if files is not None:
        parts.append(
            files.select(
                F.lit("source_files").alias("origin"), files["file_id"].cast("bigint").alias("record_id"), F.coalesce(files["path"], F.lit("")).alias("path"),
                F.coalesce(F.lower(F.trim(files["language"])), F.lit("")).alias("language"), files["content"].alias("text"),
            )
        )
    if events is not None:
        parts.append(
            events.select(
                F.lit("runtime_observations").alias("origin"), events["id"].cast("bigint").alias("record_id"), F.lit("").alias("path"),
                F.lit("").alias("language"), events["raw_event"].alias("text"),
            )
        )
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


_LOCATED = {
    "origin": pa.string(), "record_id": pa.int64(), "value": pa.string(), "place": pa.string(), "name": pa.string(), "path": pa.string(),
    "label": pa.float64(), "held": pa.bool_(), "holds": pa.bool_(), "counted": pa.string(), "bucket": pa.int32(), "n": pa.float64(),
}


def located(rows: DataFrame) -> DataFrame:
    """All candidates of the records with what `judged` says of them, and (counted, bucket, n) of `Counted` over each task's
    texts. The texts are read here only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = Counted()
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                out, marks, words = [], [], []
                for origin, key, path, language, text in zip(*(c.to_pylist() for c in batch.slice(begin, 500).columns)):
                    for _, _, value, place, name, where in record_candidates(origin, text, language, path):
                        one = _text(value), place, _text(name), where
                        r = judged(one, weak_label(*one))
                        marks.append(r)
                        out.append((origin, key, *r.one, r.label, r.held, r.holds, None, None, None))
                    words += _WORD.findall(text)
                    if len(words) > 100_000:
                        counted.words += bigrams(words)
                        words = []
                counted.words += bigrams(words)
                counted.add(marks, 1.0)
                yield _batch(out)
        for kind, flat in counted.arrays().items():
            yield _batch([(*[None] * 9, kind, int(k), float(flat[k])) for k in np.flatnonzero(flat)])

    columns = ", ".join(f"{name} {_SPARK[kind]}" for name, kind in _LOCATED.items())
    rows = rows.where("text IS NOT NULL AND text <> ''").select("origin", "record_id", "path", "language", "text")
    return cut(rows.mapInArrow(run, columns))


_SPARK = {pa.string(): "string", pa.int64(): "bigint", pa.float64(): "double", pa.bool_(): "boolean", pa.int32(): "int"}


def _batch(out: list[tuple]) -> pa.RecordBatch:
    columns = zip(*out) if out else [[]] * len(_LOCATED)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _LOCATED.values())], names=list(_LOCATED))


def _text(value: str) -> str:
    """The text with `?` for lone surrogates, which JSON strings may hold and columns may not."""
    return value if value.isascii() else value.encode("utf-8", "replace").decode()


def _learnt(found: DataFrame) -> Model:
    """The model of all candidates of `located`."""
    counted = Counted()
    sums = found.where("counted IS NOT NULL").groupBy("counted", "bucket").agg(F.sum("n").alias("n")).toArrow()
    flats = counted.arrays()
    kinds, buckets, n = (sums.column(k).to_numpy() for k in range(3))
    for kind, flat in flats.items():
        flat[buckets[kinds == kind]] = n[kinds == kind]
    size = int(counted.rows.sum())

    def others(words: Markov, secrets: Markov, names: Names) -> Rows:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                columns = [c.to_pylist() for c in batch.columns]
                rows = [Judged(one, *marks) for one, marks in zip(zip(*columns[:4]), zip(*columns[4:]))]
                out = [_packed(held, b) for held, b in blocks(rows, 1.0, words, secrets, names)]
                yield pa.RecordBatch.from_pylist(out, pa.schema([("held", pa.bool_()), *((k, pa.binary()) for k in ("part", "begin", "path", "y"))]))

        plain = found.where("label IS NOT NULL").select("value", "place", "name", "path", "label", "held", "holds")
        table = plain.mapInArrow(run, "held boolean, part binary, begin binary, path binary, y binary")
        if size <= LOCAL_ROWS:
            return Rows([(r.held, _unpack(r.asDict())) for r in table.collect()])
        tasks = min(TASKS, max(found.sparkSession.sparkContext.defaultParallelism, size // TASK_ROWS))
        return Rows([], cut(table).coalesce(tasks))

    return estimated(counted, others)


def trained(files: DataFrame | None, events: DataFrame | None) -> Model:
    """The model fitted on all rows."""
    return _learnt(located(records(files, events)))


def scored_credentials(found: DataFrame, model: Model, cutoff: float = CUTOFF) -> DataFrame:
    """(origin, record_id, secret, kind, name, score): distinct credentials of each record, of the candidates of `located`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.scores(list(zip(*(batch.column(k).to_pylist() for k in range(2, 6)))))
            kept = pa.Table.from_batches([batch]).append_column("score", pa.array(scores)).filter(pa.array(scores >= cutoff))
            yield from kept.select(["origin", "record_id", "value", "place", "name", "score"]).to_batches()

    plain = found.where("place IS NOT NULL").select("origin", "record_id", "value", "place", "name", "path")
    scored = plain.mapInArrow(run, "origin string, record_id bigint, value string, place string, name string, score double")
    return scored.groupBy("origin", "record_id", F.col("value").alias("secret")).agg(
        F.min("place").alias("kind"), F.min("name").alias("name"), F.max("score").alias("score")
    )


def find_credentials(files: DataFrame | None, events: DataFrame | None) -> DataFrame:
    found = located(records(files, events))
    return scored_credentials(found, _learnt(found))


def redact_text(origin: str, text: str, language: str, path: str, model: Model, cutoff: float = CUTOFF) -> str:
    """The text with the spans of its credentials masked; quotes, names and line structure stay as they are."""
    found = list(record_candidates(origin, text, language, path))
    scores = model.scores([one[2:] for one in found])
    hits = [(one[0], one[1]) for one, s in zip(found, scores) if s >= cutoff]
    for secret in {text[a:b] for a, b in hits}:
        edge = re.escape(secret)
        if re.fullmatch(r"[\w$]+", secret):  # may be an identifier elsewhere: only where it is a whole string literal
            pattern = rf"(?<=[\"'`]){edge}(?=[\"'`\\])"
        else:
            pattern = rf"(?<![\w$]){edge}(?![\w$])"
        hits += [m.span() for m in re.finditer(pattern, text)]
    pieces, at = [], 0
    for start, end in sorted(set(hits)):
        if start >= at:
            pieces += [text[at:start], MASK]
            at = end
    return "".join([*pieces, text[at:]])


def redacted(files: DataFrame | None, events: DataFrame | None) -> DataFrame:
    """(origin, record_id, text): the text of every record that is not empty, credentials masked."""
    rows = records(files, events).where("text IS NOT NULL AND text <> ''")
    model = trained(files, events)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                texts = [
                    redact_text(origin, text, language, path, model)
                    for origin, path, language, text in zip(*(part.column(k).to_pylist() for k in (0, 2, 3, 4)))
                ]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["origin", "record_id", "text"])

    plain = rows.select("origin", "record_id", "path", "language", "text")
    return plain.mapInArrow(run, "origin string, record_id bigint, text string")
