"""Secret scans: candidates in texts, and a random forest that removes false positives.

Candidates are runs of letters, digits and ``+/_-.~`` within a word, with a digit
and 12 characters or more, or in a known format; and values of 6 or more behind ``=`` or ``:``, in the same
word or at the end of the one before. Values take other signs too: in quotation
marks up to the closing one, else up to a bracket, comma or semicolon. The forest looks at a
candidate's length, its characters and their transitions, how much of it a
dictionary covers, whether it stands in a path, and the words around it. It is
trained here from labelled findings, which a seeded generator writes in the
formats that public scanners list: credentials on one side, and on the other what
is mistaken for them (hashes of commits and files, card and telephone numbers,
identifiers, paths, versions, placeholders, long words).
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldmill.llm.common import Sent, Words, batches, of_rows, pieces, table

#: Labelled findings of either kind; trees, their depth, and the least findings of a leaf.
FINDINGS, TREES, DEPTH, LEAF = 3000, 40, 10, 4
THRESHOLD = 0.5
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
RUN = re.compile(rb"[A-Za-z0-9+/_\-.~]{6,}={0,2}")
#: A value behind a sign of assignment, quoted or not.
VALUE = re.compile(rb"\"([^\s\"=:][^\s\"]{5,})|'([^\s'=:][^\s']{5,})|[\"']*((?:[^\s\"'`<>()\[\]{},;&=:]|&(?![\w.\-]*=))(?:[^\s\"'`<>()\[\]{},;&]|&(?![\w.\-]*=)){5,})")
SIGN = re.compile(rb"[=:](?![=:])")
KEYWORD = re.compile(rb"pass(?:wd|word|phrase)?|pwd|secret|token|api_?-?key|apikey|access_?key|private_?key|auth|bearer|credential|client_secret|signature", re.I)
BENIGN = re.compile(rb"commit|sha\d*|md5|checksum|digest|hash|uuid|guid|version|release|example|sample|test|dummy|placeholder|card|phone|tel|order|invoice|isbn|issue|ticket|image|file|etag|revision|build", re.I)
KNOWN = re.compile(rb"AKIA[0-9A-Z]{16}$|ASIA[0-9A-Z]{16}$|gh[pousr]_[A-Za-z0-9]{36}$|sk_(?:live|test)_[A-Za-z0-9]{24,}$|xox[abprs]-[A-Za-z0-9-]{20,}$|AIza[0-9A-Za-z_\-]{35}$|eyJ[A-Za-z0-9_\-]+\.eyJ[A-Za-z0-9_\-.]+$|glpat-[A-Za-z0-9_\-]{20}$|npm_[A-Za-z0-9]{36}$")
#: Bytes of the shortest of these; they need no digit.
SHORTEST_KNOWN = 20
AROUND = 3
OUT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("value", pa.string()), ("score", pa.float64()), ("is_secret", pa.bool_())])


@dataclass
class Finding:
    """A candidate in its word, and the words before and after."""

    value: bytes
    word: bytes
    start: int
    before: list[bytes]
    after: list[bytes]


def assigns(before: list[bytes]) -> bool:
    """Whether the word before ends in a sign of assignment."""
    return bool(before) and before[-1].endswith((b"=", b":"))


def candidates(word: bytes, before: list[bytes], after: list[bytes]) -> Iterator[Finding]:
    """Runs, and assigned values; of those that begin at the same byte the longest."""
    found: dict[int, bytes] = {}
    for m in RUN.finditer(word):
        value = m.group().rstrip(b".")
        if len(value) >= 12 and any(48 <= c <= 57 for c in value) or KNOWN.match(value):
            found[m.start()] = value
    signs = [m.end() for m in SIGN.finditer(word)]
    for at in [0, *signs] if assigns(before) else signs:
        m = VALUE.match(word, at)
        if m:
            value = m.group(m.lastindex)
            value = value.rstrip(b".") if m.lastindex == 3 else value
            if len(value) >= 6 and len(value) > len(found.get(m.start(m.lastindex), b"")):
                found[m.start(m.lastindex)] = value
    end = 0
    for start, value in sorted(found.items()):
        inside = start + len(value) <= end and start not in signs and word[start - 1 : start] not in (b'"', b"'") and not KNOWN.match(value)
        if not inside:
            yield Finding(value, word, start, before, after)
        end = max(end, start + len(value))


def kinds(value: bytes) -> np.ndarray:
    a = np.frombuffer(value, np.uint8)
    out = np.full(len(a), 3)
    out[(a >= 48) & (a <= 57)] = 0
    out[(a >= 65) & (a <= 90)] = 1
    out[(a >= 97) & (a <= 122)] = 2
    return out


@dataclass
class Reader:
    """The dictionary and the transitions that features are counted with."""

    words: frozenset[bytes]
    transitions: np.ndarray

    def covered(self, value: bytes) -> float:
        """The share of letters in dictionary words, the longest first."""
        low, at, hit, letters = value.lower(), 0, 0, 0
        while at < len(low):
            if not 97 <= low[at] <= 122:
                at += 1
                continue
            end = at
            while end < len(low) and 97 <= low[end] <= 122:
                end += 1
            letters += end - at
            while at < end:
                n = next((n for n in range(min(12, end - at), 2, -1) if low[at : at + n] in self.words), 0)
                hit += n
                at += n or 1
        return hit / max(1, letters) if letters >= 3 else 0.0

    def features(self, f: Finding) -> list[float]:
        v, k = f.value, kinds(f.value)
        a = np.frombuffer(v.lower(), np.uint8) & 127
        share = np.bincount(k, minlength=4) / len(v)
        p = np.array(list(Counter(v).values())) / len(v)
        near = b" ".join([*f.before, f.word[: f.start]])
        around = near + b" " + f.word[f.start + len(v) :] + b" " + b" ".join(f.after[:2])
        hexa = all(c in b"0123456789abcdefABCDEF-" for c in v)
        return [
            len(v),
            *share.tolist(),
            float((k[1:] != k[:-1]).mean()) if len(v) > 1 else 0.0,
            float(self.transitions[a[:-1], a[1:]].mean()) if len(v) > 1 else 0.0,
            float(-(p * np.log2(p)).sum()),
            self.covered(v),
            v.count(b"/") + f.word[: f.start].count(b"/") + 2 * (b"://" in f.word),
            v.count(b".") + v.count(b"-"),
            float(bool(KEYWORD.search(near))),
            float(bool(BENIGN.search(around))),
            float(bool(KNOWN.match(v))),
            float(hexa),
            float((head := f.word[: f.start].rstrip(b"\"'")).endswith((b"=", b":")) or (not head and assigns(f.before))),
        ]


def transitions_of(texts: list[bytes]) -> np.ndarray:
    """Logarithms of the chance of each ASCII character after another."""
    n = np.full((128, 128), 0.1)
    for t in texts:
        a = np.frombuffer(t.lower(), np.uint8) & 127
        np.add.at(n, (a[:-1], a[1:]), 1)
    return np.log(n / n.sum(1, keepdims=True))


def dictionary(path: str = PIECES) -> list[bytes]:
    """Words of three letters or more of a public vocabulary."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {model.id_to_piece(i).replace("▁", "").lower() for i in range(model.get_piece_size())}
    return sorted(x.encode() for x in found if len(x) >= 3 and x.isascii() and x.isalpha())


def labelled_findings(words: list[bytes], n: int = FINDINGS, seed: int = 17) -> list[tuple[Finding, int]]:
    """n findings of either kind, each from a line that holds one; formats are fixed values of public scanners' rules."""
    rng = random.Random(seed)
    text = lambda alphabet, k: "".join(rng.choice(alphabet) for _ in range(k))
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    hexa, alnum = digits + "abcdef", lower + upper + digits
    word = lambda: rng.choice(words).decode()
    key = lambda: rng.choice(["password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "access_key", "auth_token", "client_secret", "DB_PASSWORD", "API_TOKEN"])
    join = lambda: rng.choice(["=", " = ", ": ", ":", '="', ' = "', ": '"])
    uuid = lambda: "-".join(text(hexa, k) for k in (8, 4, 4, 4, 12))
    secrets_ = [
        lambda: "AKIA" + text(upper + digits, 16),
        lambda: f"aws_access_key_id{join()}AKIA" + text(upper + digits, 16),
        lambda: "gh" + rng.choice("pousr") + "_" + text(alnum, 36),
        lambda: "sk_live_" + text(alnum, rng.choice([24, 32])),
        lambda: f"xoxb-{text(digits, 11)}-{text(digits, 12)}-{text(alnum, 24)}",
        lambda: "AIza" + text(alnum + "_-", 35),
        lambda: f"eyJ{text(alnum, 20)}.eyJ{text(alnum, 60)}.{text(alnum + '_-', 43)}",
        lambda: "glpat-" + text(alnum, 20),
        lambda: f"{key()}{join()}{text(hexa, rng.choice([16, 18, 20, 32, 40, 64]))}",
        lambda: f"{key()}{join()}{text(alnum, rng.randrange(10, 44))}",
        lambda: f"{key()}{join()}{text(alnum + '+/', 40)}",
        lambda: f"{key()}{join()}{text(alnum + '-_.~', rng.randrange(10, 30))}",
        lambda: f"Authorization: Bearer {text(alnum + '-_', rng.choice([32, 40, 64]))}",
        lambda: f"{key()}{join()}{uuid()}",
        lambda: f"{key()}{join()}{text(alnum, 3)}{text(digits, 2)}{text(alnum, rng.randrange(3, 7))}",
        lambda: f"{key()}{join()}{text(alnum, 3)}{rng.choice('!@#$%^*?')}{text(alnum + '!@#$%^*?', rng.randrange(4, 12))}{text(digits, 2)}",
        lambda: f"{key()}{join()}{word()}{text(digits, rng.randrange(1, 4))}{text(lower, rng.randrange(2, 5))}",
        lambda: f"{key()}{join()}{word().title()}{rng.choice(['', '!', '@', '#'])}{text(digits, rng.randrange(3, 6))}{rng.choice(['', '!', '$', '?'])}",
    ]
    others = [
        lambda: f"{rng.choice(['commit', 'revision', 'merge', 'sha1', 'etag'])}{rng.choice([' ', ': ', '='])}{text(hexa, 40)}",
        lambda: f"{text(hexa, rng.choice([32, 40, 64]))} {word()}.{rng.choice(['tar.gz', 'iso', 'txt'])}",
        lambda: f"{rng.choice(['md5', 'sha256', 'checksum', 'digest'])}{join()}{text(hexa, rng.choice([32, 64]))}",
        lambda: f"{rng.choice(['id', 'uuid', 'guid', 'session', 'ref'])}{join()}{uuid()}",
        uuid,
        lambda: rng.choice("3456") + text(digits, 15),
        lambda: f"{rng.choice(['card', 'phone', 'order', 'isbn', 'invoice', 'id'])}{join()}{text(digits, rng.randrange(9, 17))}",
        lambda: f"+{text(digits, 2)}-{text(digits, 3)}-{text(digits, 7)}",
        lambda: f"{text(digits, 4)}-{text(digits, 2)}-{text(digits, 2)}T{text(digits, 2)}:{text(digits, 2)}",
        lambda: f"https://www.{word()}.com/{word()}/{text(digits, 4)}/{word()}-{word()}-{text(digits, 5)}.html",
        lambda: f"/usr/{word()}/{word()}{text(digits, 2)}/{word()}_{word()}.{rng.choice(['py', 'so', 'h'])}",
        lambda: f"{word()}.{text(digits, 2)}@{word()}{text(digits, 1)}.example.com",
        lambda: f"{word().title()}{word().title()}{word().title()}{text(digits, 1)}",
        lambda: f"{word()}_{word()}_{word()}{text(digits, 2)}",
        lambda: f"version{join()}{text(digits, 1)}.{text(digits, 2)}.{text(digits, 1)}-{word()}.{text(digits, 3)}",
        lambda: f"{key()}{join()}{rng.choice(['changeme', 'your_password', 'example123', 'xxxxxxxxxxxx', 'placeholder', 'password1', 'test1234', '********', 'none', 'os.environ', 'REPLACE_ME'])}",
        lambda: f"{key()}{join()}{word()}.{word()}",
        lambda: f"{key()}{join()}{word()}_{word()}",
        lambda: f"{word()}{join()}{word()}{word()}",
        lambda: f"{word()}{word()}{word()}{text(digits, 1)}",
        lambda: f"{text(digits, 3)}.{text(digits, 3)}.{text(digits, 2)}.{text(digits, 2)}",
    ]
    out: list[tuple[Finding, int]] = []
    for makers, label in ((secrets_, 1), (others, 0)):
        k = 0
        while k < n:
            sides = [" ".join(word() for _ in range(rng.randrange(5))) for _ in range(2)]
            close = lambda x: x + ('"' if x.count('"') % 2 else "'" if x.count("'") % 2 else "")
            made = close(rng.choice(makers)()) + rng.choice(["", "", ".", ",", ";"])
            line = " ".join([sides[0], made, sides[1]]).encode().split()
            found = [f for i, w in enumerate(line) for f in candidates(w, line[max(0, i - AROUND) : i], line[i + 1 : i + 1 + AROUND])]
            if label and not found:
                raise ValueError(f"no candidate in {line}")
            if found:
                out.append((max(found, key=lambda f: len(f.value)), label))
                k += 1
    return out


@dataclass
class Tree:
    """Nodes by number: feature (-1 at a leaf), threshold, children, share of secrets."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        for _ in range(DEPTH + 1):
            inner = self.feature[at] >= 0
            low = x[np.arange(len(x)), np.maximum(self.feature[at], 0)] <= self.threshold[at]
            at = np.where(inner, np.where(low, self.left[at], self.right[at]), at)
        return self.value[at]


def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> Tree:
    """A tree on a bootstrap sample; each split looks at a random choice of features for the least Gini impurity."""
    own = rng.integers(0, len(y), len(y))
    nodes: list[list[float]] = []

    def split(rows: np.ndarray, depth: int) -> int:
        me = len(nodes)
        nodes.append([-1, 0.0, 0, 0, float(y[rows].mean())])
        if depth == DEPTH or len(rows) < 2 * LEAF or nodes[me][4] in (0.0, 1.0):
            return me
        best = (1e-9, -1, 0.0)
        total, n = y[rows].sum(), len(rows)
        for f in rng.permutation(x.shape[1])[: math.ceil(math.sqrt(x.shape[1])) + 1]:
            order = rows[np.argsort(x[rows, f], kind="stable")]
            v, ones = x[order, f], np.cumsum(y[order])
            k = np.arange(LEAF, n - LEAF + 1)
            k = k[v[k - 1] < v[k]] if len(k) and k[-1] < n else k[:-1][v[k[:-1] - 1] < v[k[:-1]]]
            if not len(k):
                continue
            a, b = ones[k - 1], total - ones[k - 1]
            gain = a * a / k + (k - a) ** 2 / k + b * b / (n - k) + (n - k - b) ** 2 / (n - k) - (total**2 + (n - total) ** 2) / n
            at = int(gain.argmax())
            if gain[at] > best[0]:
                best = float(gain[at]), int(f), float((v[k[at] - 1] + v[k[at]]) / 2)
        if best[1] >= 0:
            low = x[rows, best[1]] <= best[2]
            left, right = split(rows[low], depth + 1), split(rows[~low], depth + 1)
            nodes[me][:4] = [best[1], best[2], left, right]
        return me

    split(own, 0)
    kinds_ = (np.int64, np.float64, np.int64, np.int64, np.float64)
    return Tree(*(np.array([node[k] for node in nodes], kind) for k, kind in enumerate(kinds_)))


@dataclass
class Forest:
    reader: Reader
    trees: list[Tree]

    def scores(self, found: list[Finding]) -> np.ndarray:
        if not found:
            return np.empty(0)
        x = np.array([self.reader.features(f) for f in found])
        return np.mean([t.scores(x) for t in self.trees], axis=0)


def fit(findings: list[tuple[Finding, int]], words: list[bytes], seed: int = 5) -> Forest:
    reader = Reader(frozenset(words), transitions_of(words))
    x = np.array([reader.features(f) for f, _ in findings])
    y = np.array([float(label) for _, label in findings])
    rng = np.random.default_rng(seed)
    return Forest(reader, [grow(x, y, rng) for _ in range(TREES)])


def findings_in(w: Words) -> tuple[list[Finding], list[int], list[int]]:
    """All candidates of some texts, their rows and first bytes within them."""
    digit = np.concatenate([[0], np.cumsum((w.data >= 48) & (w.data <= 57))])
    sign = np.concatenate([[0], np.cumsum((w.data == 61) | (w.data == 58))])
    size = w.end - w.start
    has = lambda total: total[w.end] > total[w.start]
    maybe = (size >= 12) & has(digit) | (size >= SHORTEST_KNOWN) | (size >= 7) & has(sign)
    last = w.data[w.end - 1]
    maybe[1:] |= (w.row[1:] == w.row[:-1]) & (size[1:] >= 6) & ((last == 61) | (last == 58))[:-1]
    raw = w.data.tobytes()
    found, rows, starts = [], [], []
    for i in np.flatnonzero(maybe).tolist():
        r = int(w.row[i])
        lo, hi = max(w.first[r], i - AROUND), min(w.first[r + 1], i + 1 + AROUND)
        near = [raw[w.start[k] : w.end[k]] for k in range(lo, hi)]
        for f in candidates(near[i - lo], near[: i - lo], near[i - lo + 1 :]):
            found.append(f)
            rows.append(r)
            starts.append(int(w.start[i] - w.off[r]) + f.start)
    return found, rows, starts


def scan(docs: DataFrame, forest: Forest, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, start, length, value, score, is_secret) for each candidate of each text; start and length count UTF-8 bytes.

    Null and empty texts have none. A null doc_id stays null, repeated rows have
    repeated findings, and an empty table has none. A very long text is read whole,
    alone in its batch; other columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    batches(spark)
    held = Sent(spark, forest)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for part in pieces(batch):
                found, rows, starts = findings_in(of_rows(part))
                score = held.value.scores(found)
                if found:
                    yield table({"doc_id": part.column(0).take(pa.array(rows)), "start": starts, "length": [len(f.value) for f in found], "value": [f.value.decode(errors="replace") for f in found], "score": score, "is_secret": score >= threshold}, OUT)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, start long, length long, value string, score double, is_secret boolean")


def trained(path: str = PIECES) -> Forest:
    """The forest of the generated findings, with a public vocabulary as dictionary."""
    words = dictionary(path)
    return fit(labelled_findings(words), words)
