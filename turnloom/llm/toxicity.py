"""Toxicity: a weighted lexicon, matched by an Aho-Corasick automaton in folded text.

Folding undoes disguises: look-alike letters of other alphabets, full-width and other compatibility forms, digits and signs
that stand for letters (c1own, id10t), and invisible characters. A term is the beginning of a word, or a whole word; it
weighs the logarithm of how much more often it occurs in toxic texts. Exception phrases, whole words or pairs of words that
hold a term but are at home in clean texts, take back the terms inside them. A text's score is a logistic function of the
weight of its terms, by the word and in all. Terms, weights, exceptions and the function are learned from labelled rows.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass, field
from math import exp, log, log1p

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import ship
from .common import Words, arrow_map, chunks, texts_of

#: Labelled documents that are learned from, at most about: a sample by a hash of id and text.
TRAIN_DOCS = 8000

#: Letters of a term, at least and (for the beginning of a word) at most.
SHORTEST, LONGEST = 4, 12

#: A term occurs so many times as often in toxic texts, at least, and in so many of them.
LIFT, SUPPORT = 5.0, 3

# ---- fixed values: characters that look like a Latin letter, by the letter ----
LOOKALIKES = {
    "a": "аαɑ", "b": "ЬƄ", "c": "сϲ", "d": "ԁ", "e": "еєҽ", "g": "ɡ", "h": "һ", "i": "іıɩι", "j": "ј", "k": "кκ", "l": "ӏǀ", "m": "м",
    "n": "ո", "o": "оοσօ", "p": "рρ", "q": "ԛ", "r": "г", "s": "ѕ", "t": "тτ", "u": "υս", "v": "ѵν", "w": "ԝѡ", "x": "хχ", "y": "уγ",
}
#: Digits and signs that stand for a letter.
STANDS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i"}
#: Characters without a width.
INVISIBLE = "­​‌‍⁠﻿"
# ---- end of fixed values ----

_LETTERS = str.maketrans({x: letter for letter, all_ in LOOKALIKES.items() for x in all_} | dict.fromkeys(INVISIBLE))
_STANDING = re.compile("[" + re.escape("".join(STANDS_FOR)) + r"]+(?=[^\W\d_])")
_STANDS = str.maketrans(STANDS_FOR)
_BETWEEN = re.compile(r"[\W_]+")


def fold(text: str) -> str:
    """Words in lower case without disguises, a space before and after each: ' one two '. No words: ' '.

    i and l are one letter, as both are written 1 or |. Digits and signs are letters where a letter follows.
    """
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = text.lower()
    if not text.isascii():
        text = text.translate(_LETTERS)
    text = _STANDING.sub(lambda m: m[0].translate(_STANDS), text)
    return " " + _BETWEEN.sub(" ", text.replace("l", "i")).strip() + " " if text else " "


@dataclass
class Lexicon:
    """terms: folded, with the space before the word, and after it if the whole word counts. exceptions: ' word ' or ' one two '."""

    terms: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    bias: float = 0.0
    by_word: float = 0.0
    in_all: float = 0.0

    def automaton(self) -> ahocorasick.Automaton:
        made = ahocorasick.Automaton()
        entries: dict[str, tuple] = {t: (t, w) for t, w in self.terms.items()}
        entries |= {e: (e, None) for e in self.exceptions}  # a term that is excepted as a whole never counts
        for key, value in entries.items():
            made.add_word(key, value)
        if entries:
            made.make_automaton()
        return made

    def score(self, weight: float, words: int) -> float:
        z = self.bias + self.by_word * density(weight, words) + self.in_all * log1p(weight)
        return 1 / (1 + exp(-min(max(z, -35.0), 35.0)))


def density(weight: float, words: int) -> float:
    """Weight by the word; short texts count as somewhat longer, and above one in ten all is the same."""
    return min(10 * weight / (words + 10), 10.0)


def hits(found: ahocorasick.Automaton, folded: str) -> list[tuple[int, str, float]]:
    """(start, term, weight) of the terms in folded text, in order, without those inside exceptions."""
    if not len(found):
        return []
    terms, excepted = [], []
    for last, (key, weight) in found.iter(folded):
        begin = last + 1 - len(key)
        if weight is None:
            excepted.append((begin, last + 1))
        else:
            terms.append((begin, key, weight))
    if excepted:
        excepted.sort()
        reach, kept, k = -1, [], 0
        for t in sorted(terms):
            while k < len(excepted) and excepted[k][0] <= t[0]:
                reach = max(reach, excepted[k][1])
                k += 1
            if t[0] + len(t[1].rstrip()) > reach:
                kept.append(t)
        terms = kept
    return sorted(terms)


def _unlike(texts: list[str], labels: list[int]) -> tuple[list[str], list[int]]:
    """Leaves out copies: texts that share one of three least hashes of three words with an earlier one of their label.
    Terms would else be learned from a passage that was copied."""
    seen: set[tuple] = set()
    out_t, out_l = [], []
    raw = [t.encode() for t in texts]
    for k, end in chunks(map(len, raw)):
        words = Words(raw[k:end])
        at = np.flatnonzero(words.left >= 3)
        h = words.grams(at, 3)
        text_no = np.repeat(np.arange(end - k), words.counts)[at]
        firsts = np.flatnonzero(np.concatenate(([True], text_no[1:] != text_no[:-1]))) if len(at) else at
        least = [np.minimum.reduceat(h * np.uint64(m), firsts) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)] if len(at) else []
        signs = {int(n): [int(x[i]) for x in least] for i, n in enumerate(text_no[firsts])}
        for n in range(end - k):
            keys = [(labels[k + n], i, x) for i, x in enumerate(signs.get(n, [hash(texts[k + n])]))]
            if not any(x in seen for x in keys):
                out_t.append(texts[k + n])
                out_l.append(labels[k + n])
            seen.update(keys)
    return out_t, out_l


def _beginnings(words: Iterable[str], known: Counter | None = None) -> dict[str, int]:
    """How many of the words have each beginning, three at most; a word as a whole counts once. known: no others than these."""
    out: dict[str, int] = {}
    for w in words:
        for k in range(SHORTEST, min(len(w), LONGEST) + 1):
            p = w[:k]
            if known is not None and p not in known:  # then no longer one is
                break
            out[p] = min(out.get(p, 0) + 1, 3)
        if len(w) >= SHORTEST and (known is None or w + " " in known):
            out[w + " "] = 1
    return out


def choose_terms(texts: list[str], labels: list[int]) -> dict[str, float]:
    """Terms from folded texts, with their weights.

    A candidate counts by the log-likelihood ratio of its occurrences in toxic and clean texts, which has to be beyond what
    chance gives the best of so many candidates. Of candidates that contain each other the best one stays, of equals the
    longest beginning.
    """
    n_bad, n_good = sum(labels), len(labels) - sum(labels)
    if not n_bad or not n_good:
        return {}
    bad, good, texts_with = Counter(), Counter(), Counter()
    size = [0, 0]
    held = [(t.split(), y) for t, y in zip(texts, labels, strict=True)]
    for words, y in held:  # clean texts only matter for what toxic ones have
        size[y] += len(words)
        if y:
            found = _beginnings(set(words))
            bad.update(found)
            texts_with.update(found.keys())
    for p in [p for p, n in texts_with.items() if n < SUPPORT]:
        del bad[p]
    for words, y in held:
        if not y:
            good.update(_beginnings(set(words), bad))
    share = n_bad / (n_bad + n_good)
    least = 2 * log(max(len(bad), 2)) + 2

    def evidence(p: str) -> float:
        a, b = bad[p], good[p]
        if (a / n_bad) / ((b + 0.5) / n_good) < LIFT:
            return 0.0
        return 2 * (a * log(a / ((a + b) * share)) + (b * log(b / ((a + b) * (1 - share))) if b else 0.0))

    ranked = sorted(((evidence(p), p) for p in bad), key=lambda x: (-round(x[0], 6), x[1].endswith(" "), -len(x[1]), x[1]))
    chosen: dict[str, float] = {}
    below: set[str] = set()  # all beginnings of what is chosen
    for g, p in ranked:
        if g < least:
            break
        if p in below or any(p[:k] in chosen for k in range(1, len(p))):
            continue
        chosen[p] = g
        below.update(p[:k] for k in range(1, len(p) + 1))
    found = Lexicon({" " + p: 1.0 for p in chosen}).automaton()
    times = [Counter(), Counter()]
    for text, y in zip(texts, labels, strict=True):
        times[y].update(t for _, t, _ in hits(found, text))
    rate = lambda t, y: (times[y][t] + 0.5) / (size[y] + 100)
    return {t: min(max(log(rate(t, 1) / rate(t, 0)), 0.5), 6.0) for t in (" " + p for p in chosen)}


def choose_exceptions(texts: list[str], labels: list[int], terms: dict[str, float]) -> list[str]:
    """Words, and pairs of words, that hold a term but are in at least two clean texts and in no larger a share of toxic ones."""
    found = Lexicon(terms).automaton()
    seen, n = [Counter(), Counter()], [max(1, len(labels) - sum(labels)), max(1, sum(labels))]
    for text, y in zip(texts, labels, strict=True):
        phrases = set()
        for begin, term, _ in hits(found, text):
            end = text.index(" ", begin + len(term.rstrip()))
            before, after = text.rfind(" ", 0, begin) if begin else -1, text.find(" ", end + 1)
            phrases.add(text[begin : end + 1])
            if before >= 0:
                phrases.add(text[before : end + 1])
            if after >= 0:
                phrases.add(text[begin : after + 1])
        seen[y].update(phrases)
    return sorted(p for p, k in seen[0].items() if k >= 2 and seen[1][p] / n[1] <= k / n[0])


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression with a small ridge, by Newton's method; those of the features are not negative."""
    use = list(range(x.shape[1]))
    while True:
        w, a = np.zeros(len(use)), x[:, use]
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -35, 35)))
            ridge = 0.02 * np.array([float(k > 0) for k in use])
            step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(ridge + 1e-6), a.T @ (y - p) - ridge * w)
            w += np.clip(step, -3, 3)
            if np.abs(step).max() < 1e-9:
                break
        wrong = [k for k, v in zip(use, w, strict=True) if k and v < 0]
        if not wrong:
            out = np.zeros(x.shape[1])
            out[use] = w
            return out
        use = [k for k in use if k not in wrong]


def fit_lexicon(texts: list[str], labels: list[int], exceptions: Iterable[str] = ()) -> Lexicon:
    """A lexicon from texts as they are; exceptions: further phrases that never count."""
    given = sorted({e for e in map(fold, exceptions) if e.strip()})
    folded, kept = _unlike([fold(t) for t in texts], labels)
    if not kept:
        return Lexicon(exceptions=given)
    terms = choose_terms(folded, kept)
    made = Lexicon(terms, sorted({*given, *choose_exceptions(folded, kept, terms)}))
    found = made.automaton()
    rows = [(sum(w for _, _, w in hits(found, t)), t.count(" ") - 1) for t in folded]
    x = np.array([(1.0, density(w, n), log1p(w)) for w, n in rows])
    made.bias, made.by_word, made.in_all = _logistic(x, np.array(kept, float)).tolist()
    return made


def train_toxicity(train: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", docs: int = TRAIN_DOCS, exceptions: Iterable[str] = ()) -> Lexicon:
    """Learns in one task from at most about `docs` labelled rows. Null labels are skipped; any other than 0 is toxic."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = train.where(F.col(label_col).isNotNull()).select(text.alias("body"), (F.col(label_col) != 0).cast("int").alias("label"), F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), text).alias("h"))
    n, given = rows.count(), list(exceptions)
    if not n:
        return Lexicon(exceptions=sorted({e for e in map(fold, given) if e.strip()}))
    # rows that are the same in all of these count once, so that the task's rows are bounded
    picked = rows.where(F.pmod("h", F.lit(2**32)) < min(1.0, docs / n) * float(2**32)).distinct().withColumn("all", F.lit(0))

    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by([("h", "ascending"), ("body", "ascending"), ("label", "ascending")])
        made = fit_lexicon(table["body"].to_pylist(), table["label"].to_pylist(), given)
        return pa.table({"lexicon": [json.dumps(asdict(made))]})

    ship(train.sparkSession)
    return Lexicon(**json.loads(picked.groupBy("all").applyInArrow(learn, "lexicon string").first()["lexicon"]))


def score_toxicity(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_docs: int = TRAIN_DOCS, exceptions: Iterable[str] = ()) -> DataFrame:
    """Scores every whole text, from 0 to 1; higher: toxic is likelier.

    Returns the columns of docs, score and terms (array of term, weight: the terms that count, in order), which replace
    columns of these names. A null text scores as an empty one: by the bias alone; a long one is scored whole. Without
    labels, or with one label only, there are no terms. Equal texts get equal scores, repeated rows are kept, and an empty
    table has an empty result. exceptions: phrases of one or more words that never count.
    """
    shared = docs.sparkSession.sparkContext.broadcast(asdict(train_toxicity(train, id_col, text_col, label_col, train_docs, exceptions)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(**shared.value)
        found = lexicon.automaton()
        for b in batches:
            score, terms = [], []
            for t in texts_of(b.column(0)):
                folded = fold(t.decode("utf-8", "replace"))
                mine = hits(found, folded)
                score.append(lexicon.score(sum(w for _, _, w in mine), folded.count(" ") - 1))
                terms.append([{"term": x.strip(), "weight": w} for _, x, w in mine])
            kind = pa.list_(pa.struct([("term", pa.string()), ("weight", pa.float64())]))
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(score, pa.float64()), pa.array(terms, kind)], names=["extra", "score", "terms"])

    keep = [c for c in docs.columns if c not in ("score", "terms")]
    own = docs.select(F.col(f"`{text_col}`").cast("string").alias("body"), F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(keep)]).alias("extra"))
    out = arrow_map(own, run, f"extra {own.schema['extra'].dataType.simpleString()}, score double, terms array<struct<term: string, weight: double>>")
    return out.select(*[F.col(f"extra.c{k}").alias(c) for k, c in enumerate(keep)], "score", "terms")
