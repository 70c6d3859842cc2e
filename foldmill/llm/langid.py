"""Language identification by unigram pieces, with all segmentations of a word summed.

The pieces are those of a fixed public vocabulary; each language has its own
probabilities of them, learned by expectation maximisation on a bounded sample of
labelled texts. The probability of a word is the sum over all its segmentations,
which the forward algorithm makes for all distinct words of a batch at once; a
text's score adds its words' logarithms. Words are runs of letters and the marks on them, in lower case.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldmill.llm.common import BASE, U64, batches, mix, powers, table
from foldmill.llm.learning import sampled

PIECES = "/opt/tokenizers/piece_bpe_32k.model"
#: Labelled documents of each language that probabilities are learned from (at most twice as many).
TRAIN_ROWS = 400
ROUNDS = 4
#: Longer words are not learned from, and scored by a forward pass that holds a few positions at a time, of so many letters of all words.
LONGEST_WORD, STRETCH = 32, 1 << 20
#: The probability of a letter that is no piece.
UNKNOWN = 1e-7
BEFORE = 0x2581
CACHE = 400_000
TEXT_CHARS = 1 << 21
OUT = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

_letters: list[np.ndarray] = []


def letters() -> tuple[np.ndarray, np.ndarray]:
    """Which code points are letters, and which are letters or marks."""
    if not _letters:
        kind = [unicodedata.category(chr(c))[0] for c in range(0x110000)]
        _letters.extend(np.fromiter((k in of for k in kind), bool, 0x110000) for of in ("L", "LM"))
    return _letters[0], _letters[1]


def load_pieces(path: str = PIECES) -> list[str]:
    """The vocabulary's pieces of lower-case letters, with the mark of a word's start where they have it."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out = set()
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        piece = model.id_to_piece(i).lower()
        body = piece[1:] if piece[0] == chr(BEFORE) else piece
        if all(letters()[1][ord(c)] for c in body) and piece:
            out.add(piece)
    return sorted(out)


class Lexicon:
    """Numbers of pieces by the hash of their code points, in a table with linear probing."""

    SLOTS = 1 << 19

    def __init__(self, pieces: list[str]):
        self.size, self.longest = len(pieces), max(map(len, pieces))
        self.key = np.zeros(self.SLOTS + 64, U64)
        self.number = np.full(self.SLOTS + 64, self.size, np.int32)
        points = [np.array([ord(c) for c in p], U64) for p in pieces]
        flat = np.concatenate(points)
        end = np.cumsum([len(p) for p in points])
        start = end - np.array([len(p) for p in points])
        self.probes = 1
        for k, h in enumerate(prefix_hash(flat)(start, end).tolist()):
            at = probe = h >> 45
            while self.key[at]:
                at += 1
            self.key[at], self.number[at] = h, k
            self.probes = max(self.probes, at - probe + 1)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The piece of each hash; ``size`` where there is none."""
        at = (h >> U64(45)).astype(np.int64)
        out = np.full(len(h), self.size, np.int32)
        open_ = np.arange(len(h))
        for _ in range(self.probes):
            key = self.key[at[open_]]
            hit = key == h[open_]
            out[open_[hit]] = self.number[at[open_[hit]]]
            open_ = open_[~hit & (key != 0)]
            if not len(open_):
                break
            at[open_] += 1
        return out


def prefix_hash(points: np.ndarray):
    up, down = powers(len(points))
    prefix = np.zeros(len(points) + 1, U64)
    np.cumsum((points.astype(U64) + U64(1)) * up[: len(points)], out=prefix[1:])
    return lambda a, b: mix((prefix[b] - prefix[a]) * down[a] + (b - a).astype(U64) * U64(BASE)) | U64(1)


def word_spans(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the lower-case texts; starts, ends and rows of their words, which have a letter at least."""
    low = [t.lower() for t in texts]
    points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    off = np.concatenate([[0], np.cumsum([len(t) for t in low])]).astype(np.int64)
    inside = letters()[1][points]
    edge = np.zeros(len(points) + 1, bool)
    edge[off] = True
    first, last = inside.copy(), inside.copy()
    if len(points):
        first[1:] &= ~inside[:-1] | edge[1:-1]
        last[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    own = np.concatenate([[0], np.cumsum(letters()[0][points])])
    start, end = (v[own[end] > own[start]] for v in (start, end))
    return points, start, end, np.searchsorted(off, start, "right") - 1


def by_length(points: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The words of each length, as a matrix of code points after the mark of a word's start."""
    size = end - start
    for n in np.unique(size):
        which = np.flatnonzero(size == n)
        rows = points[start[which][:, None] + np.arange(n)]
        yield which, np.column_stack([np.full(len(which), BEFORE, np.uint32), rows])


def spans(words: np.ndarray, lexicon: Lexicon) -> dict[tuple[int, int], np.ndarray]:
    """The piece that each span of the words' letters is; the mark and a first letter that is no piece stand for themselves."""
    n, width = words.shape
    h = prefix_hash(words.ravel())
    base = np.arange(n) * width
    out = {}
    for j in range(1, width + 1):
        for i in range(max(0, j - lexicon.longest), j):
            found = lexicon.find(h(base + i, base + j))
            if (found < lexicon.size).any():
                out[i, j] = found
    return out


def forward(found: dict, n: int, width: int, prob: np.ndarray) -> np.ndarray:
    """alpha[j]: the summed probability of the segmentations of the first j letters, for each word and language."""
    alpha = np.zeros((width + 1, n, len(prob)))
    alpha[0] = 1.0
    table_ = np.ascontiguousarray(prob.T)
    for j in range(1, width + 1):
        alpha[j] = alpha[j - 1] * UNKNOWN
        for i in range(j):
            if (i, j) in found:
                alpha[j] += alpha[i] * table_[found[i, j]]
    return alpha


def forward_long(words: np.ndarray, lexicon: Lexicon, prob: np.ndarray) -> np.ndarray:
    """The logarithm of what ``forward`` ends with, for words of any length: alpha is scaled as it goes, and few of its values are held."""
    n, width = words.shape
    longest, table_ = lexicon.longest, np.ascontiguousarray(prob.T)
    step = max(4 * longest, STRETCH // n)
    length = np.arange(1, longest + 1)
    last, scale = np.zeros((longest, n, len(prob))), np.zeros((n, len(prob)))
    last[-1] = 1.0
    for lo in range(0, width, step):
        hi, back = min(width, lo + step), max(0, lo - longest)
        part = np.ascontiguousarray(words[:, back:hi])
        h, m = prefix_hash(part.ravel()), hi - back
        at = (np.arange(n)[:, None] * m + np.arange(m)).ravel()
        found = np.full((longest, n, m), lexicon.size, np.int32)
        for k in range(min(longest, m)):
            whole = (at % m) + k < m
            found[k].ravel()[whole] = lexicon.find(h(at[whole], at[whole] + k + 1))
        for j in range(lo + 1, hi + 1):
            use = min(longest, j)
            # pieces of 1 to ``use`` letters that end at j, and alpha where they begin
            piece = found[length[:use] - 1, :, j - length[:use] - back]
            new = last[-1] * UNKNOWN + (last[::-1][:use] * table_[piece]).sum(0)
            last = np.concatenate([last[1:], new[None]])
            if j % 8 == 0:
                top = last.max(0)
                last /= top
                scale += np.log(top)
    return np.log(last[-1]) + scale


def backward(found: dict, n: int, width: int, prob: np.ndarray) -> np.ndarray:
    beta = np.zeros((width + 1, n, len(prob)))
    beta[width] = 1.0
    table_ = np.ascontiguousarray(prob.T)
    for i in range(width - 1, -1, -1):
        beta[i] = beta[i + 1] * UNKNOWN
        for j in range(i + 1, width + 1):
            if (i, j) in found:
                beta[i] += beta[j] * table_[found[i, j]]
    return beta


@dataclass
class Model:
    """Languages, their shares, and the pieces' probabilities with a last column of zeros for what is no piece."""

    pieces: list[str]
    langs: list[str]
    prior: np.ndarray
    prob: np.ndarray


class Scorer:
    """Logarithms of words' probabilities, with the words seen last kept by their hash."""

    def __init__(self, model: Model):
        self.model, self.lexicon = model, Lexicon(model.pieces)
        self.forget()

    def forget(self) -> None:
        self.known, self.value = np.empty(0, U64), np.empty((0, len(self.model.langs)))

    def words(self, points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = np.empty((len(start), len(self.model.langs)))
        for which, rows in by_length(points, start, end):
            long = rows.shape[1] > LONGEST_WORD + 1
            step = max(1, STRETCH // rows.shape[1]) if long else 20_000
            for k in range(0, len(rows), step):
                part = rows[k : k + step]
                if long:
                    out[which[k : k + step]] = forward_long(part, self.lexicon, self.model.prob)
                else:
                    out[which[k : k + step]] = np.log(forward(spans(part, self.lexicon), len(part), part.shape[1], self.model.prob)[-1])
        return out

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per text, each language's logarithm and the number of words."""
        points, start, end, row = word_spans(texts)
        n = np.bincount(row, minlength=len(texts))
        out = np.zeros((len(texts), len(self.model.langs)))
        if not len(start):
            return out, n
        h, first, at = np.unique(prefix_hash(points)(start, end), return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(self.known, h), max(0, len(self.known) - 1))
        old = self.known[place] == h if len(self.known) else np.zeros(len(h), bool)
        value = np.empty((len(h), len(self.model.langs)))
        value[old] = self.value[place[old]]
        new = np.flatnonzero(~old)
        if len(new):
            value[new] = self.words(points, start[first[new]], end[first[new]])
            if len(self.known) + len(new) > CACHE:
                self.forget()
            merged = np.concatenate([self.known, h[new]])
            order = np.argsort(merged)
            self.known, self.value = merged[order], np.concatenate([self.value, value[new]])[order]
        for k in range(out.shape[1]):
            out[:, k] = np.bincount(row, value[at, k], len(texts))
        return out, n


def expectation_maximisation(words: list[str], count: np.ndarray, pieces: list[str], rounds: int = ROUNDS) -> np.ndarray:
    """Probabilities of the pieces (languages x pieces) from words and their counts (languages x words)."""
    lexicon = Lexicon(pieces)
    points, start, end, _ = word_spans(words)
    prob = np.full((len(count), len(pieces) + 1), 1.0 / len(pieces))
    prob[:, -1] = 0
    groups = []
    for which, rows in by_length(points, start, end):
        for k in range(0, len(rows), 20_000):
            part = rows[k : k + 20_000]
            groups.append((which[k : k + 20_000], spans(part, lexicon), part.shape))
    for _ in range(rounds):
        total = np.zeros_like(prob)
        for which, found, (n, width) in groups:
            alpha, beta = forward(found, n, width, prob), backward(found, n, width, prob)
            share = count[:, which].T / np.maximum(alpha[-1], 1e-300)
            for (i, j), piece in found.items():
                use = alpha[i] * beta[j] * share
                for k in range(len(prob)):
                    total[k] += np.bincount(piece, use[:, k] * prob[k][piece], prob.shape[1])
        total[:, -1] = 0
        total[:, :-1] += 0.01
        prob = total / total.sum(1, keepdims=True)
    return prob


def fit(docs: DataFrame, train_rows: int = TRAIN_ROWS, path: str = PIECES) -> Model | None:
    """The model of a bounded sample of (doc_id, text, lang); None if no row has a language and letters. Words of over LONGEST_WORD letters are not learned from."""
    batches(docs.sparkSession)
    sample, counts = sampled(docs.select("doc_id", "text", "lang").where("text is not null"), "lang", train_rows)

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            got: dict[tuple[str, str], int] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                points, start, end, _ = word_spans([text])
                start, end = (v[end - start <= LONGEST_WORD] for v in (start, end))
                raw = points.tobytes()
                for a, b in zip((4 * start).tolist(), (4 * end).tolist(), strict=True):
                    key = lang, raw[a:b].decode("utf-32-le", "replace")
                    got[key] = got.get(key, 0) + 1
            yield pa.RecordBatch.from_pydict({"lang": [k[0] for k in got], "word": [k[1] for k in got], "n": list(got.values())}, pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())]))

    rows = sample.select("text", "lang").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).orderBy("lang", "word").toArrow()
    langs = sorted(set(rows.column(0).to_pylist()))
    if not langs:
        return None
    words = sorted(set(rows.column(1).to_pylist()))
    number = {w: k for k, w in enumerate(words)}
    table_ = np.zeros((len(langs), len(words)))
    for lang, word, n in zip(*(rows.column(k).to_pylist() for k in range(3)), strict=True):
        table_[langs.index(lang), number[word]] = n
    pieces = load_pieces(path)
    share = np.array([counts[lang] for lang in langs], float)
    return Model(pieces, langs, share / share.sum(), expectation_maximisation(words, table_, pieces))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score) for each row of docs; score is the language's posterior probability.

    A null text, or one without a letter, is ``und`` with score 0, as is every text
    where there was nothing to learn from. Null ids and repeated rows stay; a very long text or word is scored whole;
    other columns are not read, whatever their names. An empty table gives an empty one.
    """
    batches(docs.sparkSession)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model) if model else None
        for batch in parts:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            size = np.cumsum([0, *map(len, texts)])
            at = 0
            while at < len(texts):
                to = max(at + 1, int(np.searchsorted(size, size[at] + TEXT_CHARS, "right")) - 1)
                pred, score = ["und"] * (to - at), np.zeros(to - at)
                if scorer:
                    z, n = scorer.texts(texts[at:to])
                    z = z + np.log(model.prior)
                    p = np.exp(z - z.max(1, keepdims=True))
                    p /= p.sum(1, keepdims=True)
                    best = p.argmax(1)
                    pred = [model.langs[b] if k else "und" for b, k in zip(best, n, strict=True)]
                    score = np.where(n > 0, p[np.arange(len(p)), best], 0.0)
                yield table({"doc_id": batch.column(0).slice(at, to - at), "lang_pred": pred, "score": score}, OUT)
                at = to

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
