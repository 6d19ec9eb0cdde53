"""Toxicity by a lexicon trie under Levenshtein automata (operator 4).

The lexicon is a short list of general insults and the terms (words or word
beginnings) that the training labels single out: a greedy cover of the toxic
documents by terms that clean documents lack.  Beginnings of which toxic documents
use many different words, and clean ones a few by chance, are families.  Lexicon
terms form a trie; the
Levenshtein automaton of a word runs against all of the trie at once, as sets of
(trie node, edits so far) whose transitions are remembered, so most words die
after two or three letters.  Terms and word beginnings of 4 letters or more may be
misspelled in one place, of 9 or more in two; two neighbours that change places
are one place.  Words that are near a term but occur in clean training documents
are no misspellings, and a term that any word of a clean training document is two
places from may be misspelled in one place only.

Around each hit a window of words is looked at: a pair of quotation marks around
the hit or a word of report before it, with no word of address between, make it a
quotation, which counts little.
Marks before a word open, marks behind it close what the like mark opened last,
marks within words are apostrophes.  Words of families count by the chance that a
clean text of the same length has as many different ones (Poisson, at the rate of
the clean training documents).  A logistic score has log odds of its own for texts
with no hit, quotations only, one or several misspelled terms (apart for distinct
terms, which clean texts are hardly ever near to, and others), plain terms, and
families that are likely, unlikely or very unlikely in a clean text, trained in
numpy from a prior that labels move.  Labelled texts with typing errors are rare,
so each toxic training text counts again with one of its terms misspelled (a
distinct one also twice) and its other hits left out; a clean training text is
held against the words of the other texts, so that its own words do not excuse it.

The sample holds at most TOXIC toxic and CLEAN clean labelled documents, those of
least hash of the id, whole texts; of an id with several texts the one of least
hash.  Of its words those of at most LETTERS letters are learned from; the lexicon
holds at most TERMS of the CANDIDATES most frequent terms.  Labels are read
outside the held-out fold only.  Null, empty and blank texts get the score of a text without hits.
Repeated rows are scored alike; rows without id are scored but not learned from.
Without labels the prior and the general insults decide.  An empty table gives
an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sampling import least_of_each
from .scratch import materialise, slices, table

TOXIC, CLEAN, FOLDS, HELD, THRESHOLD = 3000, 6000, 3, 1, 0.7
#: Terms each toxic document should have, least support of a term, most clean documents among those with it; terms, candidates for them and letters of a learned word at most.
COVER, LEAST, IMPURE, TERMS, CANDIDATES, LETTERS = 3, 4, 0.005, 500, 10_000, 40
#: A distinct term: toxic texts that have it, at least, and as many more for each clean text with a word near it that no other text excuses. General insults start with the least.
DISTINCT, FALSE = 10, 30
#: A family: toxic texts that have it and words of it that LEAST of them have, at least; most clean texts among those with it, most toxic texts that one word may make up; and the chances that count as unlikely.
FAMILY, KINDS, LOOSE, ALONE, CHANCES = 10, 8, 0.6, 0.5, (1e-2, 1e-4)
#: Stands for the distance of a word of a family.
KIN = 9
BEGINNINGS, WINDOW, CACHE = (4, 5, 6, 7), 6, 200_000

# General insults, words of report, and of address, in four languages.
INSULTS = ("bastard", "clown", "disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless")
REPORT = frozenset("said says wrote writes called quoted quotes quote word term dit écrit mot sagte schrieb wort dijo escribió palabra".split())
ADDRESS = frozenset("you your you're u tu toi vous t'es du dich ihr tú usted ustedes eres".split())
QUOTES = "\"'“”‘’«»„‹›"
MARKS = frozenset(QUOTES)
#: The marks that close what each one opens; one that stands alone closes if it can.
CLOSING = {'"': '"', "'": "'", "“": "”", "”": "”", "‘": "’", "’": "’", "«": "»", "»": "«", "„": "“”", "‹": "›", "›": "‹"}
EDGE = ".,;:!?()[]{}*#$%&|~^_=+<>/\\-…" + QUOTES
# Digits and signs that stand for letters.
SIGNS = str.maketrans("013457@$", "oieastas")


class Lexicon:
    """Terms as a trie; a term that ends in * is a word beginning.

    loose: two neighbours that change places are one edit, and terms of 4 letters
    and beginnings may have edits too.
    """

    def __init__(self, terms, loose: bool = False):
        self.loose = loose
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[str | None] = [None]
        self.edits = [0]  # most edits that a term below may have
        for term in sorted(terms):
            begins, word = term.endswith("*"), term.rstrip("*")
            node, most = 0, self.most(term)
            self.edits[0] = max(self.edits[0], most)
            for letter in word:
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.ends)
                    self.children.append({})
                    self.ends.append(None)
                    self.edits.append(0)
                node = self.children[node][letter]
                self.edits[node] = max(self.edits[node], most)
            if self.ends[node] is None or begins:
                self.ends[node] = term
        self.start = self._closed({0: 0})
        self.moves: dict = {}
        self.begun: dict = {}

    @staticmethod
    def allowed(word: str) -> int:
        return 0 if len(word) < 5 else 1 if len(word) < 9 else 2

    def most(self, term: str) -> int:
        """The most edits that a term may have here."""
        if self.loose:
            return max(self.allowed(term.rstrip("*")), int(len(term.rstrip("*")) >= 4))
        return 0 if term[-1] == "*" else self.allowed(term)

    def _closed(self, state: dict) -> frozenset:
        """With letters of the term left out."""
        todo = [x for x in state.items() if type(x[0]) is int]
        while todo:
            node, e = todo.pop()
            for child in self.children[node].values():
                if e + 1 <= self.edits[child] and e + 1 < state.get(child, 99):
                    state[child] = e + 1
                    todo.append((child, e + 1))
        return frozenset(state.items())

    def _step(self, state: frozenset, letter: str) -> frozenset:
        out: dict = {}
        for node, e in state:
            if type(node) is tuple:  # behind two changed places, if this letter is the first of them
                if node[1] == letter:
                    out[node[0]] = min(e, out.get(node[0], 99))
                continue
            for own, child in self.children[node].items():
                if self.loose and own != letter and (both := self.children[child].get(letter)) is not None and e + 1 <= self.edits[both]:
                    out[both, own] = min(e + 1, out.get((both, own), 99))
                cost = e + (own != letter)
                if cost <= self.edits[child] or cost == e:
                    out[child] = min(cost, out.get(child, 99))
            if e + 1 <= self.edits[node]:  # a letter too many
                out[node] = min(e + 1, out.get(node, 99))
        return self._closed(out)

    def find(self, word: str) -> tuple[str, int] | None:
        """The nearest term and its distance."""
        state, begun = self.start, None
        for letter in word:
            to = self.moves.get((state, letter))
            if to is None:
                if len(self.moves) > CACHE:
                    self.moves.clear()
                to = self.moves[state, letter] = self._step(state, letter)
            if not to:
                break
            state = to
            if begun is None or begun[0]:
                near = self.begun.get(state, 0)
                if near == 0:
                    if len(self.begun) > CACHE:
                        self.begun.clear()
                    near = self.begun[state] = self._ended(state, True)
                if near and (begun is None or near < begun):
                    begun = near
        else:
            best = self._ended(state, False)
            if best and (begun is None or best[0] == 0 or best[0] <= begun[0] > 0):
                return best[1], best[0]
        return (begun[1], begun[0]) if begun else None

    def _ended(self, state: frozenset, begins: bool) -> tuple[int, str] | None:
        """The nearest word beginning, or else whole term, that ends here."""
        return min(((e, t) for n, e in state if type(n) is int and (t := self.ends[n]) and (t[-1] == "*") == begins and e <= self.most(t)), default=None)


class Finder:
    """Hits of whole texts: (place, term, distance, quoted)."""

    def __init__(self, lexicon: Lexicon, innocent: frozenset = frozenset(), families: frozenset = frozenset(), strict: frozenset = frozenset()):
        self.lexicon, self.innocent, self.families, self.strict = lexicon, innocent, families, strict
        self.sizes = sorted({len(f) for f in families})
        self.known: dict[str, tuple | None] = {}

    def _near(self, word: str) -> tuple[str, int] | None:
        hit = None if word in self.innocent else self.lexicon.find(word)
        if hit and hit[1] == 0:
            return hit
        kin = next((word[:n] for n in self.sizes if len(word) > n and word[:n] in self.families), None)
        if kin:
            return f"{kin}*", KIN
        return None if hit and hit[1] == 2 and hit[0] in self.strict else hit

    def _of(self, token: str):
        if token not in self.known:
            if len(self.known) >= CACHE:
                self.known.clear()
            word = token.strip(EDGE)
            hit = self._near(word) if word else None
            if hit is None and word and not word.isalpha() and (plain := word.translate(SIGNS)) != word and plain.isalpha():
                hit = self._near(plain)
                hit = hit and (hit[0], max(1, hit[1]))
            self.known[token] = hit and (*hit, word)
        return self.known[token]

    def hits(self, text: str | None) -> list[tuple[int, str, int, bool, str]]:
        tokens = (text or "").lower().split()
        get, own = self.known.get, {}
        for token in set(tokens):
            hit = get(token, 0)
            if hit == 0:
                hit = self._of(token)
            if hit:
                own[token] = hit
        if not own:
            return []
        pairs, found = self._pairs(tokens), []
        for k, token in enumerate(tokens):
            if token in own:
                term, distance, word = own[token]
                found.append((k, term, distance, self._quoted(tokens, k, pairs), word))
        return found

    @staticmethod
    def _pairs(tokens: list[str]) -> list[tuple[int, int]]:
        """First and last word of each quotation of at most 2 WINDOW + 1 words, by last word."""
        pairs, opened = [], {}  # opened: closing mark to the place of its opening one

        def close(mark: str, at: int) -> bool:
            start = opened.pop(mark, None)
            if start is None:
                return False
            for m in [m for m, x in opened.items() if x == start and mark in "“”" and m in "“”"]:
                del opened[m]  # the other mark that could have closed it
            if at - start <= 2 * WINDOW:
                pairs.append((start, at))
            return True

        for k, token in enumerate(tokens):
            if MARKS.isdisjoint(token):
                continue
            core = token.strip(EDGE)
            left, _, right = token.partition(core) if core else ("", "", "")
            for mark in left:
                for end in CLOSING.get(mark, ""):
                    opened[end] = k
            for mark in right:
                close(mark, k)
            for mark in "" if core else token:
                if mark in CLOSING and not close(mark, k):
                    for end in CLOSING[mark]:
                        opened[end] = k
        return pairs

    @staticmethod
    def _quoted(tokens: list[str], at: int, pairs: list[tuple[int, int]]) -> bool:
        first = bisect_left(pairs, (at,), key=lambda x: (x[1],))
        for start, end in islice(pairs, first, None):
            if end > at + WINDOW:
                break
            if at - WINDOW <= start <= at:
                return True
        for token in reversed(tokens[max(0, at - 3) : at]):
            word = token.strip(EDGE)
            if word in REPORT:
                return True
            if word in ADDRESS:  # said to someone, not of someone
                return False
        return False


#: Log odds of a text with no hit, quotations only, one misspelled term that is not distinct, several of those, one misspelled distinct term, several of those, a plain term; for each further plain hit; and of families as by chance, unlikely, very unlikely.
_PRIOR = np.array([-4.0, -2.5, -2.0, -1.0, 0.0, 2.0, 3.0, 0.5, -2.0, 0.0, 2.0])


def chance(k: int, mean: float) -> float:
    """That a Poisson number of this mean is k or more."""
    below = term = math.exp(-mean)
    for i in range(1, k):
        term *= mean / i
        below += term
    return max(0.0, 1.0 - below) if k else 1.0


def features(hits: list, distinct: frozenset, words: int = 0, rate: float = 0.0) -> np.ndarray:
    """words: the length of the text; rate: different words of families for each word of a clean text."""
    plain = sum(1 for h in hits if h[2] == 0 and not h[3])
    wrong = [h[1] for h in hits if 0 < h[2] < KIN and not h[3]]
    sure = sum(t in distinct for t in wrong)
    kin = len({h[4] for h in hits if h[2] == KIN and not h[3]})
    odd = sum(chance(kin, rate * words) < c for c in CHANCES) if kin else -1
    kind = (6 if plain else 10 if odd == 2 else 3 + min(sure, 2) if sure else 9 if odd == 1
            else 2 + (len(wrong) > 1) if wrong else 8 if odd == 0 else 1 if hits else 0)
    out = np.zeros(len(_PRIOR))
    out[kind], out[7] = 1, min(max(plain - 1, 0), 4)
    return out


def misspelled(word: str, draw: int) -> str:
    """The word with one typing error: neighbours changed, a letter left out, doubled or another one."""
    draw, at = divmod(draw, max(1, len(word) - 1))
    draw, kind = divmod(draw, 4)
    a, b = word[at : at + 1], word[at + 1 : at + 2]
    return word[:at] + (b + a, b, a + a + b, chr(97 + draw % 26) + b)[kind] + word[at + 2 :]


def calibration(rows: list, lexicon: Lexicon) -> tuple[frozenset, frozenset, frozenset, float, np.ndarray, np.ndarray]:
    """Innocent words, distinct and strict terms, the rate of families, features and labels from (toxic, hits, words) of the sample.

    Each text is held against what the other texts say of its words.
    """
    near = lambda hits: [h for h in hits if 0 < h[2] < KIN]
    seen, texts, false = {0: Counter(), 1: Counter()}, Counter(), Counter()
    for y, hits, _ in rows:
        seen[y].update({h[4] for h in near(hits)})
    innocent = frozenset(w for w, n in seen[0].items() if n >= seen[1][w])
    strict = frozenset(h[1] for y, hits, _ in rows if not y for h in near(hits) if h[2] == 2)
    clean = [(len({h[4] for h in hits if h[2] == KIN}), n) for y, hits, n in rows if not y]
    rate = (sum(k for k, _ in clean) + 1) / (sum(n for _, n in clean) + 1e4)
    held = []
    for y, hits, n in rows:
        others = {h[4]: seen[0][h[4]] - (1 - y) for h in near(hits)}
        held.append((y, [h for h in hits if h[4] not in others or (others[h[4]] < max(1, seen[1][h[4]] - y) and not (h[2] == 2 and h[1] in strict))], n))
        if y:
            texts.update({h[1] for h in hits if h[2] == 0})
        else:
            false.update({h[1] for h in near(held[-1][1])})
    texts.update({t: DISTINCT for t in INSULTS})
    distinct = frozenset(t for t, n in texts.items() if DISTINCT + FALSE * false[t] <= n)
    x, labels = [], []
    for y, hits, n in held:
        x.append(features(hits, distinct, n, rate))
        labels.append(y)
        plain = [h for h in hits if h[2] == 0 and not h[3]]
        if y and plain:
            word = plain[crc32("".join(h[4] for h in plain).encode()) % len(plain)][4]
            wrong = misspelled(word, crc32(f"{len(plain)} {word}".encode()))
            hit = lexicon.find(wrong)
            if hit and hit[1] and wrong not in innocent and not (hit[1] == 2 and hit[0] in strict):
                for k in (1, 2) if hit[0] in distinct else (1,):  # a doubtful word is as doubtful twice
                    x.append(features([(0, *hit, False, wrong)] * k, distinct))
                    labels.append(1)
    return innocent, distinct, strict, rate, np.stack(x) if x else np.empty((0, len(_PRIOR))), np.array(labels, float)


def fit_logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray = _PRIOR, strength: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights of largest posterior chance under a normal prior, by Newton's steps."""
    w = prior.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + strength * (w - prior)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + strength * np.eye(len(w)), gradient)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def _terms(text: str) -> set[str]:
    """The words of a text and the beginnings of longer ones."""
    words = {w for t in set(text.lower().split()) if (w := t.strip(EDGE)) and 3 <= len(w) <= LETTERS and w.isalpha()}
    return words | {w[:n] + "*" for w in words for n in BEGINNINGS if len(w) > n}


def covering(toxic: list[set[str]], candidates: dict[str, float]) -> list[str]:
    """Terms by greedy cover; candidates: term to the share of clean documents among those that have it."""
    need = np.full(len(toxic), COVER)
    docs: dict[str, list[int]] = {}
    for k, terms in enumerate(toxic):
        for t in terms:
            docs.setdefault(t, []).append(k)
    left = {t: np.array(d) for t, d in docs.items() if t in candidates}
    chosen: list[str] = []
    while left and len(chosen) < TERMS:
        # of equal gains the longer term, so that a beginning takes in no more than it has to
        gain, _, term = max((int((need[d] > 0).sum()), len(t), t) for t, d in left.items())
        if gain < LEAST:
            break
        if term[-1] == "*":  # the longest beginning that does nearly as much
            near = [t for t, d in left.items() if t[-1] == "*" and t.startswith(term[:-1]) and (need[d] > 0).sum() >= 0.9 * gain]
            term = max(near, key=lambda t: (len(t), t))
        chosen.append(term)
        need[left.pop(term)] -= 1
        if len(left) > 4 * TERMS:
            left = {t: d for t, d in left.items() if (need[d] > 0).sum() >= LEAST}
    return chosen


def families(counts: dict[str, tuple[int, int]]) -> frozenset:
    """Beginnings (without *) that are families; counts: term to the texts, and toxic texts, that have it."""
    words: dict[str, list[int]] = {}  # toxic texts with each word of each beginning
    for t, (_, bad) in counts.items():
        for n in BEGINNINGS if t[-1] != "*" else ():
            if len(t) > n:
                words.setdefault(t[:n], []).append(bad)
    found = {t[:-1]: bad for t, (n, bad) in counts.items()
             if t[-1] == "*" and bad >= FAMILY and IMPURE * n < n - bad <= LOOSE * n and len(own := words.get(t[:-1], ())) >= KINDS and max(own) <= ALONE * bad}
    # of beginnings of each other the longest that does nearly as much
    return frozenset(t for t, bad in found.items() if not any(u != t and u.startswith(t) and found[u] >= 0.9 * bad for u in found) and not any(t != u and t.startswith(u) and bad < 0.9 * found[u] for u in found))


class Scorer:
    def __init__(self, terms: list[str], innocent: frozenset, distinct: frozenset, weights: np.ndarray, kin: frozenset = frozenset(), strict: frozenset = frozenset(), rate: float = 0.0):
        self.terms, self.innocent, self.distinct, self.weights, self.kin, self.strict, self.rate = terms, innocent, distinct, weights, kin, strict, rate

    def ready(self) -> Finder:
        return Finder(Lexicon(self.terms, loose=True), self.innocent, self.kin, self.strict)

    def score(self, hits: list, text: str | None = None) -> float:
        """text is looked at for its length, where words of families are among the hits."""
        words = len((text or "").split()) if any(h[2] == KIN for h in hits) else 0
        return float(1 / (1 + np.exp(-(features(hits, self.distinct, words, self.rate) @ self.weights))))


def _sampled(docs: DataFrame, labels: DataFrame, most_toxic: int = TOXIC, most_clean: int = CLEAN) -> DataFrame:
    """toxic and text of the bounded sample, materialised."""
    own = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS)) != HELD, F.lit(False))
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).where(own).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    of_class = lambda y, most: least_of_each(marked.where(F.col("toxic") == y), F.col("toxic"), F.col("doc_id"), F.lit(0).cast("long"), most)
    chosen = materialise(of_class(1, most_toxic).unionByName(of_class(0, most_clean)), "toxicity-chosen")
    # no more ids than the sample's bound, so no text moves
    chosen = F.broadcast(chosen.select(F.col("id").alias("doc_id"), F.col("label").cast("int").alias("toxic")))
    rows = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # of an id with several texts the one of least hash, so that rows are bounded as ids are
    one = rows.join(chosen, "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("key"), "text")).alias("least"))
    return materialise(one.groupBy("least.key").agg(F.max("toxic").alias("toxic"), F.first("least.text").alias("text")).drop("key"), "toxicity-sample")


def fit(docs: DataFrame, labels: DataFrame) -> Scorer:
    """Lexicon, innocent neighbours, distinct terms and weights from the labelled rows outside the held-out fold."""
    sample = _sampled(docs, labels)

    def terms(batches):
        for batch in batches:
            toxic, term = [], []
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = _terms(text.as_py())
                toxic += [y] * len(own)
                term += own
            yield pa.RecordBatch.from_arrays([pa.array(term, pa.string()), pa.array(toxic, pa.int32())], names=["term", "toxic"])

    counts = (sample.select("toxic", "text").mapInArrow(terms, "term string, toxic int").groupBy("term").agg(F.sum("toxic").cast("long").alias("bad"), F.count("*").alias("n"))
              .where((F.col("bad") >= LEAST) & (F.col("n") - F.col("bad") <= LOOSE * F.col("n"))))
    # a cover takes at most TERMS of them
    found = {r["term"]: (r["n"], r["bad"]) for r in counts.orderBy(F.desc("bad"), "term").limit(CANDIDATES).collect()}
    kin = families(found)
    of_kin = lambda t: any(len(t) > n and t[:n] in kin for n in BEGINNINGS)
    candidates = {t: 1 - bad / n for t, (n, bad) in found.items() if n - bad <= IMPURE * n and not of_kin(t.rstrip("*"))}

    def members(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sorted(_terms(t.as_py()) & candidates.keys()) for t in batch.column(0)], pa.list_(pa.string()))], names=["terms"])

    bad = sample.where("toxic = 1").select("text").mapInArrow(members, "terms array<string>").collect() if candidates else []
    lexicon = sorted(set(covering([set(r[0]) for r in bad], candidates)) | set(INSULTS))

    def look(batches):
        finder = Finder(Lexicon(lexicon, loose=True), families=kin)
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(1)]
            flat = [[f"{h[1]}\t{h[2]}\t{int(h[3])}\t{h[4]}" for h in finder.hits(t)] for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(flat, pa.list_(pa.string())), pa.array([len(t.split()) for t in texts], pa.int64())], names=["toxic", "hits", "n"])

    rows = [(r[0], [(0, t, int(d), q == "1", w) for t, d, q, w in (h.split("\t") for h in r[1])], r[2]) for r in sample.select("toxic", "text").mapInArrow(look, "toxic int, hits array<string>, n long").collect()]
    innocent, distinct, strict, rate, x, y = calibration(rows, Lexicon(lexicon, loose=True))
    return Scorer(lexicon, innocent, distinct, fit_logistic(x, y), kin, strict, rate)


def score(docs: DataFrame, scorer: Scorer, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted, n_hits, n_quoted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches):
        scorer = shared.value
        finder = scorer.ready()
        for batch in slices(batches):
            texts = [t.as_py() for t in batch.column(1)]
            hits = [finder.hits(t) for t in texts]
            p = [scorer.score(h, t) for h, t in zip(hits, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(p, pa.float64()), pa.array([int(x >= threshold) for x in p], pa.int32()),
                pa.array([len(h) for h in hits], pa.int32()), pa.array([sum(x[3] for x in h) for h in hits], pa.int32())], names=["doc_id", "score", "predicted", "n_hits", "n_quoted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int, n_hits int, n_quoted int")


def accepted(docs: DataFrame, scorer: Scorer, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, that score below the threshold; no row moves."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches):
        scorer = shared.value
        finder = scorer.ready()
        for batch in slices(batches):
            texts = [t.as_py() for t in batch.column("text")]
            yield batch.filter(pa.array([scorer.score(finder.hits(t), t) < threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS)) == HELD, F.lit(False))
    return score(docs, fit(docs, table(spark, sf_dir, "labels"))).select("doc_id", held.alias("held_out"), "score", "predicted", "n_hits", "n_quoted")


QUERIES = {"op4_toxicity": op4_toxicity}
SQL: dict[str, str] = {}
