"""Language of mixed-language text: script ranges narrow the candidates of each word, Viterbi over word scores labels spans.

Learning counts letter trigrams (with word ends) per language over all training rows, in partial sums; the model keeps
every language and every trigram, as one entry per (trigram, language) that was counted. A word's score
for a language is the sum of the log-probabilities of its trigrams. A language is a candidate for a word only if its
training text was written in the word's script; a word in no known script scores nothing. Over a document's words, the
best path with a penalty for each switch of language labels spans, and the language whose spans hold most letters wins.

Null texts and texts without a letter: ``und``, score 0, no spans. With no training rows every text is ``und``.
"""

from __future__ import annotations

import math
import uuid
from bisect import bisect_right
from collections import Counter, defaultdict
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm.bpe import HashTable
from weirflow.llm.common import _col, arrow_map

#: First code points of script ranges, in order; a range ends where the next begins.
SCRIPTS = [
    (0x0000, "Common"), (0x0041, "Latin"), (0x005B, "Common"), (0x0061, "Latin"), (0x007B, "Common"), (0x00AA, "Latin"), (0x00AB, "Common"), (0x00BA, "Latin"), (0x00BB, "Common"), (0x00C0, "Latin"),
    (0x02B0, "Common"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0700, "Syriac"), (0x0750, "Arabic"), (0x0780, "Thaana"), (0x0900, "Devanagari"),
    (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"),
    (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Cherokee"), (0x1400, "Common"), (0x1780, "Khmer"), (0x1800, "Mongolian"),
    (0x18B0, "Common"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Common"), (0x3040, "Kana"), (0x3100, "Bopomofo"), (0x3130, "Hangul"), (0x3190, "Common"), (0x3400, "Han"), (0x4DC0, "Common"),
    (0x4E00, "Han"), (0xA000, "Yi"), (0xA4D0, "Common"), (0xAC00, "Hangul"), (0xD7B0, "Common"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB13, "Armenian"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"),
    (0xFE00, "Common"), (0xFE70, "Arabic"), (0xFF00, "Common"), (0xFF21, "Latin"), (0xFF3B, "Common"), (0xFF41, "Latin"), (0xFF5B, "Common"), (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0xFFE0, "Common"), (0x20000, "Han"), (0x30000, "Common"),
]
_STARTS = [a for a, _ in SCRIPTS]
LETTERS = regex.compile(r"[\p{L}\p{M}]+")


def script_of(word: str) -> str:
    """The script of most letters of a word; of equally many, the one met first."""
    if word.isascii():
        return "Latin"
    seen = Counter(SCRIPTS[bisect_right(_STARTS, ord(c)) - 1][1] for c in word)
    seen.pop("Common", None)
    return max(seen, key=seen.get) if seen else "Common"


def words_of(token: str) -> list[str]:
    """The runs of letters of a lower-cased token; words with at most a mark behind them need no pattern."""
    if token.isalpha():
        return [token]
    if token[:-1].isalpha() and token[-1] in ".,;:!?":
        return [token[:-1]]
    return LETTERS.findall(token)


def gram_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Trigrams of words with a space at either end, as numbers, and where each word's begin: as many as it has letters."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    codes = np.frombuffer(" ".join(["", *(f"{w} " for w in words)]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    # each word takes its length and two spaces; its trigrams start at all places but the last two
    ends = np.cumsum(size + 2)
    inside = np.ones(len(codes), bool)
    inside[ends - 1] = inside[ends - 2] = False
    at = np.flatnonzero(inside)
    return (codes[at] << np.uint64(42)) | (codes[at + 1] << np.uint64(21)) | codes[at + 2], np.r_[0, np.cumsum(size)[:-1]]


def gram_text(key: int) -> str:
    return "".join(chr(key >> k & 0x1FFFFF) for k in (42, 21, 0))


def gram_key(gram: str) -> int:
    return ord(gram[0]) << 42 | ord(gram[1]) << 21 | ord(gram[2])


@dataclass
class Model:
    langs: list[str]
    #: Trigrams as sorted numbers; the entries of number k are at starts[k] to starts[k + 1]: a language and how much its log-probability is above the floor.
    keys: np.ndarray
    starts: np.ndarray
    of: np.ndarray
    gain: np.ndarray
    floor: np.ndarray
    scripts: dict[str, tuple[bool, ...]]

    def prepared(self) -> HashTable:
        """Trigrams by number."""
        return HashTable(self.keys, np.arange(len(self.keys)))


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", alpha: float = 0.5) -> Model:
    """Counts over all rows given; a trigram's probability is smoothed by ``alpha``."""

    def count(batches):
        words: dict[str, Counter] = defaultdict(Counter)
        held = 0

        def flush():
            total: dict[tuple, int] = {}
            for name, seen in words.items():
                each, n, scripts = [], [], Counter()
                for token, k in seen.items():
                    for w in words_of(token):
                        each.append(w)
                        n.append(k)
                        scripts["Latin" if w.isascii() else script_of(w)] += k * len(w)
                total |= {(name, "s", x): k for x, k in scripts.items()}
                if each:
                    keys, starts = gram_keys(each)
                    size = np.diff(np.r_[starts, len(keys)])
                    found, place = np.unique(keys, return_inverse=True)
                    sums = np.bincount(place, weights=np.repeat(np.array(n, np.float64), size))
                    total |= {(name, "g", gram_text(int(g))): int(v) for g, v in zip(found, sums)}
            words.clear()
            keys = list(total)
            for at in range(0, len(keys), 50_000):
                part = keys[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in part], pa.string()) for i in range(3)] + [pa.array([total[k] for k in part], pa.int64())], names=["lang", "kind", "what", "n"])

        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                for t, name in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    words[name].update(t.lower().split())
                held = sum(map(len, words.values()))
                if held > 250_000:
                    yield from flush()
        yield from flush()

    rows = docs.select(_col(docs, text).alias("t"), _col(docs, lang).cast("string").alias("l")).filter("t is not null and l is not null").mapInArrow(count, "lang string, kind string, what string, n long")
    sums = rows.groupBy("kind", "what", "lang").agg(F.sum("n").alias("n"))
    # one row per script or trigram, and language
    kept = sums.toArrow()
    is_script = pc.equal(kept["kind"], "s")
    letters: Counter = Counter()
    by_script: dict[str, Counter] = defaultdict(Counter)
    for r in kept.filter(is_script).to_pylist():
        letters[r["lang"]] += r["n"]
        by_script[r["what"]][r["lang"]] += r["n"]
    langs = sorted(letters)
    scripts = {x: may for x, n in sorted(by_script.items()) if x != "Common" and any(may := tuple(n[k] >= 0.01 * letters[k] for k in langs))}
    grams = kept.filter(pc.invert(is_script))
    names = grams["lang"].combine_chunks().dictionary_encode()
    place = {x: k for k, x in enumerate(langs)}
    of = np.array([place[x] for x in names.dictionary.to_pylist()], np.int32)[names.indices.to_numpy()] if len(names) else np.zeros(0, np.int32)
    key = np.fromiter(map(gram_key, grams["what"].to_pylist()), np.uint64, len(of))
    n = grams["n"].to_numpy().astype(np.float64)
    order = np.lexsort((of, key))
    of, key, n = of[order], key[order], n[order]
    keys, starts = np.unique(key, return_index=True)
    size = np.bincount(of, weights=n, minlength=len(langs)) + alpha * (len(keys) + 1)
    return Model(langs, keys, np.r_[starts, len(key)], of, np.log((n + alpha) / alpha), np.log(alpha / size), scripts)


def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """The best path of labels: the sum of scores less ``penalty`` for each switch. Ties go to staying, then to the lower label."""
    n, m = scores.shape
    if m == 1:
        return np.zeros(n, np.int64)
    total = scores.sum(0)
    stay = int(total.argmax())
    if np.isfinite(total[stay]):
        # a stretch elsewhere costs one switch at either end of the text and two inside; if none gains that much, the path stays
        gain = np.cumsum(scores.max(1) - scores[:, stay])
        low = np.minimum.accumulate(np.r_[0.0, gain[:-1]])
        if gain.max() <= penalty and gain[-1] - low.min() <= penalty and (gain - low).max() <= 2 * penalty:
            return np.full(n, stay, np.int64)
    last, came, moved = _steps(m)(scores.tolist(), penalty)
    k = last.index(max(last))
    path = [k]
    for j, bits in zip(reversed(came), reversed(moved)):
        if bits >> k & 1:
            k = j
        path.append(k)
    return np.array(path[::-1], np.int64)


@lru_cache(maxsize=16)
def _steps(m: int):
    """The forward pass for m labels, its loop over labels written out: last values, best labels, and who came from them (bits)."""
    labels = range(m)
    lines = [
        "def steps(rows, penalty):",
        "    came, moved = [], []",
        f"    {', '.join(f'v{k}' for k in labels)} = rows[0]",
        f"    for {', '.join(f's{k}' for k in labels)} in rows[1:]:",
        "        best, j, bits = v0, 0, 0",
        *(f"        if v{k} > best: best, j = v{k}, {k}" for k in labels[1:]),
        "        away = best - penalty",
    ]
    for k in labels:
        lines += [f"        if away > v{k}: v{k}, bits = away + s{k}, bits | {1 << k}", f"        else: v{k} += s{k}"]
    lines += ["        came.append(j)", "        moved.append(bits)", f"    return [{', '.join(f'v{k}' for k in labels)}], came, moved"]
    scope: dict = {}
    exec("\n".join(lines), scope)
    return scope["steps"]


class Labeller:
    """Spans and languages of texts; word scores are kept up to a bounded number of words."""

    LIMIT = 200_000

    def __init__(self, model: Model, penalty: float):
        self.model, self.penalty = model, penalty
        self.table = model.prepared() if model.langs else None
        self.limit = self.LIMIT * 64 // max(64, len(model.langs))
        self._reset()

    def _reset(self) -> None:
        self.place: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.model.langs)))
        self.letters = np.zeros(0, np.int64)
        self.scored = np.zeros(0, bool)

    def study(self, tokens: set[str]) -> None:
        """Scores tokens that aren't known yet, all side by side: sums over their trigrams, -inf where the script rules a language out."""
        if len(self.place) > self.limit:
            self._reset()
        new = [t for t in tokens if t not in self.place]
        if not new or not self.model.langs:
            return
        words, of = [], []
        for k, t in enumerate(new):
            for w in words_of(t.lower()):
                words.append(w)
                of.append(k)
        m = len(self.model.langs)
        scores, letters, scored = np.zeros((len(new), m)), np.zeros(len(new), np.int64), np.zeros(len(new), bool)
        if words:
            keys, starts = gram_keys(words)
            each = self._sums(keys, np.diff(np.r_[starts, len(keys)]))
            may = [self.model.scripts.get("Latin" if w.isascii() else script_of(w)) for w in words]
            known = np.array([x is not None for x in may])
            masks = np.array([x or (True,) * m for x in may], bool)
            each[~masks] = -np.inf
            of = np.array(of)
            np.add.at(letters, of, np.fromiter(map(len, words), np.int64, len(words)))
            np.add.at(scores, of[known], each[known])
            scored[of[known]] = True
            scored &= np.isfinite(scores).any(1)
            scores[~scored] = 0
        base = len(self.place)
        self.place.update((t, base + k) for k, t in enumerate(new))
        self.scores, self.letters, self.scored = np.concatenate([self.scores, scores]), np.concatenate([self.letters, letters]), np.concatenate([self.scored, scored])

    def _sums(self, keys: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Of words with ``size`` trigrams each, the log-probabilities by language: the floor for each trigram, and the entries' gains."""
        model, m = self.model, len(self.model.langs)
        row = self.table.get(keys)
        word, row = np.repeat(np.arange(len(size)), size)[row >= 0], row[row >= 0]
        n = model.starts[row + 1] - model.starts[row]
        at = np.repeat(model.starts[row] - np.cumsum(n) + n, n) + np.arange(n.sum())
        gains = np.bincount(np.repeat(word, n) * m + model.of[at], weights=model.gain[at], minlength=len(size) * m)
        return gains.reshape(len(size), m) + size[:, None] * model.floor

    def label(self, text: str | None) -> tuple[str, float, list[tuple[int, int, str]]]:
        """Language, its share of the letters in labelled words, and spans (from, to, language) over the text's tokens."""
        tokens = text.split() if text else []
        if not tokens or not self.model.langs:
            return "und", 0.0, []
        try:
            at = np.fromiter(map(self.place.__getitem__, tokens), np.int64, len(tokens))
        except KeyError:
            self.study(set(tokens))
            at = np.fromiter(map(self.place.__getitem__, tokens), np.int64, len(tokens))
        letters = self.letters[at]
        if not letters.sum():
            return "und", 0.0, []
        use = np.flatnonzero(self.scored[at])
        if not len(use):
            return self.model.langs[0], 0.0, []  # letters, but in no script that was learned
        path = viterbi(self.scores[at[use]], self.penalty)
        held = np.bincount(path, weights=letters[use], minlength=len(self.model.langs))
        k = int(held.argmax())
        cut = np.flatnonzero(np.diff(path)) + 1
        starts, ends = np.r_[0, cut], np.r_[cut, len(path)]
        spans = [(int(use[a]), int(use[b - 1]) + 1, self.model.langs[path[a]]) for a, b in zip(starts, ends)]
        return self.model.langs[k], float(held[k] / held.sum()), spans


def languages(docs: DataFrame, model: Model, text: str = "text", penalty: float = 40.0, keep: list[str] | None = None) -> DataFrame:
    """Adds ``lang_pred``, ``score`` (0 to 1) and ``spans`` to every row; only the text is looked at.

    ``penalty``, in nats: a switch needs the evidence of about three words, so that no lone borrowed word makes a span.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    tag = uuid.uuid4().hex

    def predict(texts):
        labeller = _labeller(tag, lambda: Labeller(shared.value, penalty))
        tokens: set[str] = set()
        for t in texts:
            if t:
                tokens.update(t.split())
        labeller.study(tokens)
        out: list[list] = [[], [], []]
        for t in texts:
            lang, score, spans = labeller.label(t)
            out[0].append(lang)
            out[1].append(score)
            out[2].append([{"from": a, "to": b, "lang": x} for a, b, x in spans])
        return out

    return arrow_map(docs, [text], predict, "lang_pred string, score double, spans array<struct<`from`:int,`to`:int,lang:string>>", keep)


_LABELLERS: dict[str, Labeller] = {}


def _labeller(tag: str, make) -> Labeller:
    """One per worker process and model, so that what it has learned about words serves all tasks that the process runs."""
    if tag not in _LABELLERS:
        _LABELLERS.clear()
        _LABELLERS[tag] = make()
    return _LABELLERS[tag]
