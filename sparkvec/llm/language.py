"""Missing or wrong language labels: a language with a confidence for every document, paragraph and stretch.

Segmentation-marginalised unigrams: each language has a probability for every piece of a fixed public vocabulary (byte-level,
read from a file whose path is a parameter). A word's probability in a language is the sum over all its segmentations into
pieces, however long, by a forward pass over its bytes that takes many words at once. The sentences of a document form a chain in
which staying in a language is likelier than changing it, within a line and from line to line; the best chain gives the
stretches. Within a sentence the language may change between words, at a higher cost. A line's language is the one that
most of its words are in.

Confidence is the posterior of the language given the words of the stretch (line) alone, all languages equally likely before.
Words of a sentence aren't independent, so the scores are divided by a temperature, fitted on labelled lines that took no part
in the counts, and on their beginnings of one to eight words.

Fitting. Piece probabilities come from a bounded sample: for each language at most ``SAMPLE_DOCS`` labelled documents of at
most ``SAMPLE_CHARS`` characters, those with the smallest hashes. They are fitted by expectation maximisation: each piece's
expected count over all segmentations of the words, by forward and backward passes. Labels may be wrong, so it is fitted
``ROUNDS`` times, each time without the lines that the model before assigned clearly to another language. Words count again without
their accents, at a lower weight, so that texts which lost theirs are still known. The model has languages x vocabulary
numbers, whatever the number of documents. Scoring covers all documents, whole texts, in one pass without a shuffle.

Lines of code, logs or settings have no language: those in which less than ``NATURAL`` of the pieces between white space,
without a list marker in front, are words of letters only.

Defined cases
    Null and blank texts give no rows. Lines end at a line feed; blank ones aren't counted. Lines without natural words have a
    null language. Equal scores go to the language first in the alphabet. Without any labelled document every language is
    equally likely and the first is given, with confidence 1/8. A label names a language by code (two or three letters, with
    or without a region) or by its English or own name, in any case; all others name none. Rows that repeat an id and its text
    come once from :func:`found` and as often as given from the others. A word above ``PART`` bytes is scored in parts of that
    length. Other columns are ignored.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
LANGS = ("de", "en", "es", "fr", "it", "nl", "pt", "ru")
#: fixed values: codes and names of the languages
NAMES = {
    "de": ("de", "deu", "ger", "german", "deutsch"), "en": ("en", "eng", "english"), "es": ("es", "spa", "spanish", "español", "castellano"),
    "fr": ("fr", "fra", "fre", "french", "français"), "it": ("it", "ita", "italian", "italiano"), "nl": ("nl", "nld", "dut", "dutch", "nederlands"),
    "pt": ("pt", "por", "portuguese", "português"), "ru": ("ru", "rus", "russian", "русский"),
}
SAMPLE_DOCS = 400
SAMPLE_CHARS = 20_000
ROUNDS = 3
PRIOR = 60.0  # strength of the pooled distribution that smooths each language's
UNACCENTED = 0.3
STEPS = 3  # of expectation maximisation in a round
CHANGE = 5.0  # cost of another language in the next sentence
LINE = 1.5  # cost of another language in the next line
INSIDE = 14.0  # cost of another language in the next word of a sentence
NAME = 8.0  # a word may be a name or misspelt, likely alike in every language, with weight exp(-NAME)
PART = 1024  # bytes
FLUSH = 1 << 17  # words that are scored at once
NATURAL = 0.6
WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*\Z")
MARKER = re.compile(r"\s*(?:[#>*\-•]+|\d{1,3}[.)])\s+")
SENTENCE = re.compile(r"(?<=[.!?…])\s+")
ENDS = ".,!?;:…\"'()[]«»“”„‘’¿¡"
CACHE = 200_000


def labelled(lang: Column) -> Column:
    """The two-letter code that a label names, or null."""
    name = F.lower(F.trim(lang))
    primary = F.when(name.rlike(r"^[a-z]{2,3}[-_][a-z0-9]{2,8}$"), F.regexp_extract(name, r"^([a-z]+)", 1)).otherwise(name)
    out = F.when(F.lit(False), F.lit(""))
    for code, names in NAMES.items():
        out = out.when(primary.isin(*names), code)
    return out


def natural(piece: str) -> str:
    """The lower-cased word of a piece between white space; empty if it isn't one of letters only."""
    w = piece.strip(ENDS)
    return w.lower() if w and '":' not in piece and WORD.match(w) else ""


@lru_cache(maxsize=2)
def vocabulary(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def beginnings(path: str) -> frozenset[bytes]:
    return frozenset(b[:i] for b in vocabulary(path) for i in range(1, len(b) + 1))


class Lattice:
    """All pieces in some words, as edges ``(word, from byte, to byte, piece)``, ordered by where they end."""

    def __init__(self, words: list[bytes], path: str):
        pieces, starts = vocabulary(path), beginnings(path)
        w, a, b, v = [], [], [], []
        for n, word in enumerate(words):
            for i in range(len(word)):
                for j in range(i + 1, len(word) + 1):
                    part = word[i:j]
                    if part not in starts:
                        break
                    if (p := pieces.get(part)) is not None:
                        w.append(n)
                        a.append(i)
                        b.append(j)
                        v.append(p)
        self.length = np.array([len(x) for x in words], np.int64)
        self.place = np.concatenate([[0], np.cumsum(self.length + 1)])[:-1]
        self.word, self.begin, self.end, self.piece = (np.array(x, np.int64) for x in (w, a, b, v))

    def sums(self, p: np.ndarray, top: np.ndarray, back: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(m, l): for every byte place of every word the sum over the segmentations before it (behind it) is ``m * exp(l)``, each language's.

        ``p`` are the pieces' probabilities, divided by ``exp(top)``.
        """
        begin, end = (self.length[self.word] - self.end, self.length[self.word] - self.begin) if back else (self.begin, self.end)
        order = np.lexsort((self.word, end))
        src, dst, v = self.place[self.word[order]] + begin[order], self.place[self.word[order]] + end[order], self.piece[order]
        m, l = np.zeros((int((self.length + 1).sum()), p.shape[1])), np.full(int((self.length + 1).sum()), -np.inf)
        m[self.place], l[self.place] = 1.0, 0.0
        cuts = np.searchsorted(end[order], np.arange(1, int(self.length.max(initial=0)) + 2))
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            if x == y:
                continue
            s, d = src[x:y], dst[x:y]
            first = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
            height = l[s] + top[v[x:y]]
            high = np.maximum.reduceat(height, first)
            high = np.where(np.isfinite(high), high, 0.0)
            share = np.exp(height - np.repeat(high, np.diff(np.append(first, y - x))))
            total = np.add.reduceat(m[s] * p[v[x:y]] * share[:, None], first, axis=0)
            most = total.max(1)
            m[d[first]] = total / np.where(most > 0, most, 1.0)[:, None]
            l[d[first]] = np.where(most > 0, high + np.log(np.where(most > 0, most, 1.0)), -np.inf)
        return m, l

    def log_totals(self, p: np.ndarray, top: np.ndarray) -> np.ndarray:
        """(words, languages) log-probabilities."""
        m, l = self.sums(p, top)
        at = self.place + self.length
        with np.errstate(divide="ignore"):
            return np.log(m[at]) + l[at][:, None]

    def expected(self, p: np.ndarray, top: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """(vocabulary, languages) expected counts of the pieces, for words that occur ``counts (words, languages)`` times."""
        m, l = self.sums(p, top)
        n, h = self.sums(p, top, back=True)
        at, end = self.place[self.word], self.place + self.length
        rest = at + self.length[self.word] - self.end
        c = np.zeros_like(p)
        for a in range(0, len(at), 1 << 18):
            e = slice(a, a + (1 << 18))
            w = self.word[e]
            i, r = at[e] + self.begin[e], rest[e]
            lift = np.exp(l[i] + h[r] + top[self.piece[e]] - l[end[w]])
            part = m[i] * p[self.piece[e]] * n[r] * lift[:, None] / np.maximum(m[end[w]], 1e-300) * counts[w]
            for lang in range(p.shape[1]):
                c[:, lang] += np.bincount(self.piece[e], part[:, lang], len(c))
        return c


class Model:
    """The pieces' probabilities in each language, and the temperature of the confidence."""

    def __init__(self, p: np.ndarray, temperature: float = 1.0):
        self.p, self.temperature = p, temperature
        high = p.max(1)
        self.top, self.scaled = np.log(high), p / high[:, None]

    def log_probabilities(self, words: list[str], path: str) -> np.ndarray:
        """(words, languages); words above ``PART`` bytes in parts."""
        coded = [b" " + w.encode() for w in words]
        parts = [c[i : i + PART] for c in coded for i in range(0, len(c), PART)]
        n = np.array([-(-len(c) // PART) for c in coded], np.int64)
        out = Lattice(parts, path).log_totals(self.scaled, self.top)
        return np.add.reduceat(out, np.concatenate([[0], np.cumsum(n)])[:-1], axis=0) if len(words) else out

    def confidence(self, scores: np.ndarray, lang: int) -> float:
        e = np.exp((scores - scores.max()) / self.temperature)
        return float(e[lang] / e.sum())


class Scorer:
    """Scores of texts: each distinct piece between white space is looked at once."""

    def __init__(self, model: Model, path: str):
        self.model, self.path = model, path
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}  # piece -> number of its word, -1 if it isn't one
        self.words: dict[str, int] = {}
        self.rows = np.zeros((0, len(LANGS)))

    def number(self, piece: str) -> int:
        w = natural(piece)
        n = self.known[piece] = self.words.setdefault(w, len(self.words)) if w else -1
        return n

    def sentences(self, line: str) -> tuple[list[tuple[int, int, list[int]]], bool]:
        """(start, end, numbers of words) of the line's sentences, and whether the line has a language at all."""
        m = MARKER.match(line)
        at, out, n, k = m.end() if m else 0, [], 0, 0
        known = self.known
        for x in [*SENTENCE.finditer(line, at), None]:
            a, b = x.span() if x else (len(line), len(line))
            pieces = line[at:a].split()
            if pieces:
                ids = [i for p in pieces if (i := known[p] if p in known else self.number(p)) >= 0]
                n, k = n + len(pieces), k + len(ids)
                out.append((at, a, ids))
            at = b
        return out, k > 0 and k >= NATURAL * n

    def score_new(self) -> None:
        new = list(self.words)[len(self.rows) :]
        if new:
            self.rows = np.concatenate([self.rows, robust(self.model.log_probabilities(new, self.path))])


def robust(rows: np.ndarray) -> np.ndarray:
    """Words' scores if any of them may be a name or misspelt."""
    return np.logaddexp(rows, rows.max(1, keepdims=True) - NAME)


def best_chain(s: np.ndarray, change: list[float]) -> list[int]:
    """The best languages of a chain of scores, where another language than the one before costs ``change``."""
    best, back = s[0], []
    for row, cost in zip(s[1:], change, strict=True):
        top = int(np.argmax(best))
        moved = best[top] - cost
        back.append(np.where(best >= moved, np.arange(len(row)), top))
        best = np.maximum(best, moved) + row
    path = [int(np.argmax(best))]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def chained(parts: list) -> list[int]:
    """The best languages of a document's sentences, or parts of them."""
    lines_ = [id(h[0]) for h, ps in parts for _ in ps]
    return best_chain(np.array([p[3] for _, ps in parts for p in ps]), [CHANGE if a == b else LINE for a, b in zip(lines_, lines_[1:])])


Stretch = tuple[int, int, int, int, np.ndarray]


def within(line: str, a: int, b: int, rows: np.ndarray) -> list[tuple[int, int, int, np.ndarray]]:
    """(start, end, words, scores) of a sentence's parts between changes of language."""
    path = best_chain(rows, [INSIDE] * (len(rows) - 1))
    ends = [i for i in range(1, len(path)) if path[i] != path[i - 1]]
    if not ends:
        return [(a, b, len(rows), rows.sum(0))]
    spans = [x.span() for x in re.finditer(r"\S+", line[a:b]) if natural(x.group())]
    cuts = [0, *ends, len(path)]
    starts = [a, *(a + spans[i][0] for i in ends), b]
    return [(starts[i], starts[i + 1], cuts[i + 1] - cuts[i], rows[cuts[i] : cuts[i + 1]].sum(0)) for i in range(len(cuts) - 1)]


def stretches(scorer: Scorer, texts: list[str]) -> list[list[tuple[int, int, list[Stretch]]]]:
    """For each text its lines ``(number, start, stretches)``; a stretch is (start, end, language, words, scores), places within the line.

    Lines without a language have no stretches.
    """
    out: list[list[tuple[int, int, list[Stretch]]]] = []
    held: list[tuple[list[Stretch], str, int, int, int]] = []  # stretches of its line, line, start, end, text
    ids: list[int] = []
    counts: list[int] = []

    def flush() -> None:
        scorer.score_new()
        if held:
            rows = scorer.rows[np.array(ids, np.int64)] if ids else np.zeros((0, len(LANGS)))
            n = np.array(counts, np.int64)
            first = np.cumsum(n) - n
            full = np.flatnonzero(n)
            s, peak = np.zeros((len(n), len(LANGS))), np.zeros(len(n))
            if len(full):
                s[full] = np.add.reduceat(rows, first[full], axis=0)
                peak[full] = np.add.reduceat(rows.max(1), first[full])
            mixed = peak - s.max(1) > INSIDE  # no more can be gained by changes
            top = s.argmax(1)
            owner = np.array([h[4] for h in held])
            cut = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            for x, y in zip(cut, np.append(cut[1:], len(owner)), strict=True):
                parts = [(h, [(h[2], h[3], int(n[i]), s[i])] if not mixed[i] else within(h[1], h[2], h[3], rows[first[i] : first[i] + n[i]])) for i, h in zip(range(x, y), held[x:y], strict=True)]
                plain = not mixed[x:y].any() and (top[x:y][n[x:y] > 0] == top[x]).all() and n[x] > 0
                path = iter([int(top[x])] * (y - x) if plain else chained(parts))
                for h, ps in parts:
                    for a, b, words, row in ps:
                        own, lang = h[0], next(path)
                        if own and own[-1][2] == lang:
                            z = own[-1]
                            own[-1] = (z[0], b, lang, z[3] + words, z[4] + row)
                        else:
                            own.append((a, b, lang, words, row))
        held.clear()
        ids.clear()
        counts.clear()

    for t, text in enumerate(texts):
        mine: list[tuple[int, int, list[Stretch]]] = []
        for no, at, line in lines(text):
            parts, any_ = scorer.sentences(line)
            own: list[Stretch] = []
            mine.append((no, at, own))
            if any_:
                for a, b, words in parts:
                    held.append((own, line, a, b, t))
                    ids.extend(words)
                    counts.append(len(words))
        out.append(mine)
        if len(ids) >= FLUSH:
            flush()
    flush()
    return out


def lines(text: str) -> Iterator[tuple[int, int, str]]:
    """(number from 1, start, line) of the non-blank lines."""
    at = n = 0
    for line in text.split("\n"):
        if line.strip():
            n += 1
            yield n, at, line
        at += len(line) + 1


# ---------------------------------------------------------------- fitting
def sample(documents: DataFrame, docs: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> list[tuple[str, str]]:
    """(language, text): at most ``docs`` labelled documents of each language."""
    from pyspark.sql import Window as W

    rows = documents.select(labelled(F.col("lang")).alias("l"), "text").where(F.col("l").isNotNull() & (F.length("text") <= chars) & (F.regexp_replace("text", r"(?U)\s", "") != ""))
    n = {r[0]: r[1] for r in rows.groupBy("l").count().collect()}  # one row a language
    h = F.xxhash64("text")
    share = F.lit(0.0)
    for code, m in n.items():
        share = F.when(F.col("l") == code, min(1.0, 2.0 * docs / m + 50.0 / m)).otherwise(share)
    few = rows.withColumn("h", h).where((F.col("h").cast("double") / 2.0**64 + 0.5) <= share)
    first = few.withColumn("r", F.row_number().over(W.partitionBy("l").orderBy("h", "text"))).where(F.col("r") <= docs)
    return sorted((r[0], r[1]) for r in first.select("l", "text").collect())


def unaccented(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


def learn(texts: Iterable[tuple[str, str]], path: str = VOCABULARY, rounds: int = ROUNDS) -> Model:
    """Probabilities of the pieces by expectation maximisation, and the temperature of the confidence."""
    size = max(vocabulary(path).values()) + 1
    model = Model(np.full((size, len(LANGS)), 1.0 / size))
    scorer = Scorer(model, path)
    owner, lang, ids = [], [], []
    for code, text in texts:
        for _, _, line in lines(text):
            parts, any_ = scorer.sentences(line)
            if any_:
                own = [i for _, _, words in parts for i in words]
                owner += [len(lang)] * len(own)
                ids += own
                lang.append(LANGS.index(code))
    if not lang:
        return model
    line_of, word, label = np.array(owner), np.array(ids), np.array(lang)
    start = np.searchsorted(line_of, np.arange(len(label)))
    words = list(scorer.words)
    plain = [unaccented(w) for w in words]
    every = {w: i for i, w in enumerate(dict.fromkeys(words + plain))}
    alias = np.array([every[w] for w in plain])
    parts = [(b" " + w.encode())[i : i + PART] for w in every for i in range(0, len(w.encode()) + 1, PART)]
    part_of = np.repeat(np.arange(len(every)), [-(-(len(w.encode()) + 1) // PART) for w in every])
    lattice = Lattice(parts, path)

    def totals(m: Model) -> np.ndarray:
        out = np.zeros((len(every), len(LANGS)))
        np.add.at(out, part_of, lattice.log_totals(m.scaled, m.top))
        return out

    held_out = np.arange(len(label)) % 5 == 4
    keep = np.ones(len(label), bool)
    for turn in range(rounds):
        n = np.zeros((len(every), len(LANGS)))
        use = (keep & ~held_out)[line_of]
        np.add.at(n, (word[use], label[line_of[use]]), 1.0)
        bare = np.zeros_like(n)
        np.add.at(bare, alias, n[: len(words)] * (alias != np.arange(len(words)))[:, None] * UNACCENTED)
        n += bare
        for _ in range(STEPS):
            c = lattice.expected(model.scaled, model.top, n[part_of])
            pooled = c.sum(1) + 0.01
            pooled /= pooled.sum()
            model = Model((c + PRIOR * pooled[:, None]) / (c.sum(0) + PRIOR))
        score = np.add.reduceat(robust(totals(model))[word], start, axis=0)
        keep = score[np.arange(len(label)), label] >= score.max(1) - 2 * CHANGE
    model.temperature = temperature(robust(totals(model))[word], line_of, start, label, held_out)
    return model


def temperature(rows: np.ndarray, line_of: np.ndarray, start: np.ndarray, label: np.ndarray, held_out: np.ndarray) -> float:
    """The likeliest of the held-out lines' labels, of which an unknown part is wrong, for whole lines and their first words."""
    place = np.arange(len(rows)) - start[line_of]
    length = np.bincount(line_of, minlength=len(label))
    scores, want = [], []
    for n in (1, 2, 3, 5, 8, None):
        own = held_out & (length >= (n or 1))
        at = own[line_of] & (place < n if n else True)
        if at.any():
            lines_, first = np.unique(line_of[at], return_index=True)
            scores.append(np.add.reduceat(rows[at], first, axis=0))
            want.append(label[lines_])
    if not scores:
        return 1.0
    s, y = np.concatenate(scores), np.concatenate(want)
    s = s - s.max(1, keepdims=True)
    best = (-np.inf, 1.0)
    for t in np.geomspace(0.5, 8, 25):
        e = np.exp(s / t)
        q = e[np.arange(len(y)), y] / e.sum(1)
        for wrong in (0.01, 0.03, 0.06, 0.1, 0.15, 0.2, 0.3):
            best = max(best, (float(np.log((1 - wrong) * q + wrong / len(LANGS)).sum()), float(t)))
    return best[1]


# ---------------------------------------------------------------- scoring
SEGMENTS = "doc_id bigint, para_no bigint, segment_no bigint, start bigint, end bigint, words bigint, lang string, confidence double"
PARAGRAPHS = "doc_id bigint, label string, para_no bigint, lang string, confidence double, words bigint"


def fit(documents: DataFrame, path: str = VOCABULARY) -> Model:
    return learn(sample(documents), path)


def segments(documents: DataFrame, model: Model | None = None, path: str = VOCABULARY) -> DataFrame:
    """Every stretch of one language within a line: positions in the text, words, language, confidence."""
    m = fit(documents, path) if model is None else model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(m, path)
        for b in batches:
            rows = []
            if len(scorer.known) > CACHE:
                scorer.clear()
            for doc, found_ in zip(b.column(0).to_pylist(), stretches(scorer, [t or "" for t in b.column(1).to_pylist()]), strict=True):
                for no, at, own in found_:
                    for i, (a, e, lang, words, s) in enumerate(own):
                        rows.append((doc, no, i + 1, at + a, at + e, words, LANGS[lang], m.confidence(s, lang)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:6]], pa.array(cols[6], pa.string()), pa.array(cols[7], pa.float64())], names=[x.split()[0] for x in SEGMENTS.split(", ")])

    return documents.select("doc_id", "text").mapInArrow(run, SEGMENTS)


def paragraphs(documents: DataFrame, model: Model | None = None, path: str = VOCABULARY) -> DataFrame:
    """Every non-blank line with the language that most of its words are in (null for code), beside the document's label."""
    m = fit(documents, path) if model is None else model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(m, path)
        for b in batches:
            rows = []
            if len(scorer.known) > CACHE:
                scorer.clear()
            for doc, label, found_ in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), stretches(scorer, [t or "" for t in b.column(2).to_pylist()]), strict=True):
                for no, _, own in found_:
                    if not own:
                        rows.append((doc, label, no, None, None, 0))
                    elif len(own) == 1:
                        rows.append((doc, label, no, LANGS[own[0][2]], m.confidence(own[0][4], own[0][2]), own[0][3]))
                    else:
                        words = np.bincount([x[2] for x in own], [x[3] for x in own], len(LANGS))
                        lang = int(np.argmax(words))
                        rows.append((doc, label, no, LANGS[lang], m.confidence(np.sum([x[4] for x in own if x[2] == lang], 0), lang), int(words.sum())))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in PARAGRAPHS.split(", ")])

    return documents.select("doc_id", labelled(F.col("lang")).alias("label"), "text").mapInArrow(run, PARAGRAPHS)


def languages(documents: DataFrame, model: Model | None = None, path: str = VOCABULARY) -> DataFrame:
    """``(doc_id, label, lang, confidence, other_words)``: each document's language by words; how many are in others."""
    x = paragraphs(documents, model, path).where("lang is not null and doc_id is not null")
    per = x.groupBy("doc_id", "lang").agg(F.max("label").alias("label"), F.sum("words").alias("words"), (F.sum(F.col("confidence") * F.col("words")) / F.sum("words")).alias("confidence"))
    best = per.groupBy("doc_id").agg(F.max(F.struct("words", "lang", "confidence")).alias("b"), F.sum("words").alias("all"), F.max("label").alias("label"))
    return best.select("doc_id", "label", "b.lang", "b.confidence", (F.col("all") - F.col("b.words")).alias("other_words"))


def found(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """Paragraphs whose language isn't the one that the document's label names (p9_found)."""
    x = paragraphs(documents, path=path).where("doc_id is not null and lang is not null and (label is null or label <> lang)")
    return x.select("doc_id", "para_no", "lang").distinct()
