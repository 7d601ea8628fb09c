"""Language identification by unigram pieces, summed over all segmentations.

A word (lower case, led by the vocabulary's word mark) is a sequence of pieces of a fixed public
vocabulary; a language gives each piece a probability, and the forward algorithm sums over all ways
to cut the word into pieces. A text's log-likelihood is the sum over its words. Piece probabilities are learnt by
expectation-maximisation from word counts of a bounded sample of labelled texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.kernels import PIECE, U, hasher, mix, pieces, text_bytes, words
from tidemark.llm.sampling import MOST_LABELS, bounded, held_out
from tidemark.llm.tables import dropped, small_batches, written

UNKNOWN = "und"
MARK = "▁"
#: Words of up to so many characters need no rescaling.
SEGMENT = 32
#: Longer words up to so many characters are scored together; beyond that each on its own, in blocks.
TOGETHER, BLOCK, STEPS = 512, 1 << 16, 256
#: Probability of a character that is no piece, and what every piece is counted besides its sightings.
STRAY, BESIDES = 1e-7, 0.02
#: Words whose scores a worker remembers; then those stay that have come again.
REMEMBERED = 800_000


def vocabulary(path: str) -> list[str]:
    """The pieces of a sentencepiece model that stand for text, in lower case, each once."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = (sp.id_to_piece(i).lower() for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)))
    return list(dict.fromkeys(x for x in got if x))


class Lattice:
    """Looks up pieces by polynomial hash in one large table, for many words of one length at a time."""

    def __init__(self, pieces_: list[str]):
        self.n, self.longest = len(pieces_), max(map(len, pieces_), default=1)
        self.hash = np.zeros(self.n + 1, U)
        for size in {len(p) for p in pieces_}:
            own = [i for i, p in enumerate(pieces_) if len(p) == size]
            self.hash[own] = self._extend([pieces_[i] for i in own], size)
        self.slots = np.full((2, 1 << 20), self.n, np.int32)
        left = np.arange(self.n)
        for k in range(2):  # what finds its slot taken goes to the second table, then to the list
            slot = self._slot(self.hash[left], k)
            _, first = np.unique(slot, return_index=True)
            self.slots[k, slot[first]] = left[first]
            left = np.delete(left, first)
        self.rest = {int(self.hash[i]): int(i) for i in left}

    @staticmethod
    def codes(texts: list[str]) -> np.ndarray:
        return np.array([list(map(ord, t)) for t in texts], U)

    def _extend(self, texts: list[str], size: int) -> np.ndarray:
        c, h = self.codes(texts), np.zeros(len(texts), U)
        for i in range(size):
            h = self.step(h, c[:, i])
        return h

    @staticmethod
    def step(h: np.ndarray, c: np.ndarray) -> np.ndarray:
        return (h + c + U(1)) * U(0x9E3779B97F4A7C15) ^ (h >> U(29))

    @staticmethod
    def _slot(h: np.ndarray, k: int) -> np.ndarray:
        return (mix(h) >> U(44 - 20 * k)).astype(np.int64) & 0xFFFFF

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece numbers; n where there is none. An empty first slot means none."""
        got = self.slots[0, self._slot(h, 0)]
        other = self.hash[got] != h
        miss = np.flatnonzero(other & (got < self.n))
        got[other] = self.n
        second = self.slots[1, self._slot(h[miss], 1)]
        got[miss] = np.where(self.hash[second] == h[miss], second, self.n)
        if self.rest:
            for i in miss[got[miss] == self.n]:
                got[i] = self.rest.get(int(h[i]), self.n)
        return got

    def arcs(self, texts: list[str]) -> dict[tuple[int, int], np.ndarray]:
        """For words of one length: (start, end) -> piece of each word."""
        c, out = self.codes(texts), {}
        for i in range(c.shape[1]):
            h = np.zeros(len(texts), U)
            for j in range(i, min(c.shape[1], i + self.longest)):
                h = self.step(h, c[:, j])
                got = self.find(h)
                if j == i or (got < self.n).any():
                    out[i, j + 1] = got
        return out


def _weights(prob: np.ndarray) -> np.ndarray:
    return np.vstack([prob, np.zeros(prob.shape[1])])  # no piece: nothing


def _arc(p: np.ndarray, got: np.ndarray, size: int, none: int) -> np.ndarray:
    w = p[got]
    if size == 1:
        w[got == none] = STRAY
    return w


def forward(lattice: Lattice, p: np.ndarray, texts: list[str]) -> tuple[list[np.ndarray], dict]:
    """Sums over all segmentations of each beginning of words of one length, by language."""
    arcs, n = lattice.arcs(texts), len(texts[0])
    alpha = [np.ones((len(texts), p.shape[1]))] + [np.zeros((len(texts), p.shape[1])) for _ in range(n)]
    for (i, j), got in arcs.items():  # by start, so alpha[i] is complete
        alpha[j] += alpha[i] * _arc(p, got, j - i, lattice.n)
    return alpha, arcs


def marked(word: str) -> str:
    return MARK + word.lower()


def padded_scores(lattice: Lattice, p: np.ndarray, texts: list[str]) -> np.ndarray:
    """Logarithms of the sums over all segmentations, for words of different lengths at a time. Only the sums that a
    piece can still reach are held, and they are rescaled on the way, so that none underflows."""
    size = np.array(list(map(len, texts)))
    n, wide = int(size.max()), lattice.longest + 1
    c = np.zeros((len(texts), n), U)
    for row, t in zip(c, texts, strict=True):
        row[: len(t)] = np.frombuffer(t.encode("utf-32-le"), np.uint32)
    ring, scale = np.zeros((wide, len(texts), p.shape[1])), np.zeros((len(texts), p.shape[1]))
    ring[0], out = 1, np.zeros(scale.shape)
    for i in range(n + 1):
        now = ring[i % wide].copy()
        ended = size == i
        out[ended] = np.log(now[ended]) + scale[ended]
        ring[i % wide] = 0
        h = np.zeros(len(texts), U)
        for k in range(1, min(lattice.longest, n - i) + 1):
            h = lattice.step(h, c[:, i + k - 1])
            got = lattice.find(h)
            if k == 1 or (got < lattice.n).any():
                ring[(i + k) % wide] += now * _arc(p, got, k, lattice.n)
        if i % 8 == 7 and i < n:
            top = ring.max(0)
            ring /= top
            scale += np.log(top)
    return out


def long_score(lattice: Lattice, p: np.ndarray, text: str) -> np.ndarray:
    """The same for one very long word. The sums at a place follow linearly from those at the last few places, so a
    block's stretches of STEPS characters become matrices all at once, which are then multiplied in order."""
    wide, n_lang = lattice.longest, p.shape[1]
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(U)
    v, scale = np.zeros((n_lang, wide)), np.zeros(n_lang)  # the sum at place j is in slot j % wide
    v[:, 0] = 1
    step = STEPS // wide * wide or wide
    block = BLOCK // step * step or step
    for a in range(0, len(c), block):
        z = min(len(c), a + block)
        before = min(a, wide - 1)
        own = c[a - before : z]
        ending = np.zeros((z - a, wide, n_lang))  # of pieces that end at a + 1, ..., by the slot of their beginning
        h = np.zeros(len(own), U)
        for k in range(1, wide + 1):
            h = lattice.step(h[: len(own) - k + 1], own[k - 1 :])
            got = lattice.find(h)
            first = np.arange(a - before, z - k + 1)
            inside = first + k > a
            ending[first[inside] + k - a - 1, first[inside] % wide] = _arc(p, got[inside], k, lattice.n)
        many = (z - a) // step
        m = np.broadcast_to(np.eye(wide), (many, n_lang, wide, wide)).copy()
        sums = np.zeros((many, n_lang))
        part = ending[: many * step].reshape(many, step, wide, n_lang)
        for j in range(step if many else 0):
            m[..., (a + j + 1) % wide] = np.einsum("klbs,ksl->klb", m, part[:, j])
            if j % 16 == 15 or j == step - 1:
                top = m.max((2, 3))
                m /= top[:, :, None, None]
                sums += np.log(top)
        for k in range(many):
            v = np.einsum("lb,lbs->ls", v, m[k])
            top = v.max(1)
            v, scale = v / top[:, None], scale + np.log(top) + sums[k]
        for j in range(many * step, z - a):
            v[:, (a + j + 1) % wide] = np.einsum("ls,sl->l", v, ending[j])
            top = v.max(1)
            v, scale = v / top[:, None], scale + np.log(top)
    return np.log(v[:, len(c) % wide]) + scale


def long_sightings(lattice: Lattice, p: np.ndarray, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of one word of any length and how often each is expected in it, over all segmentations; p is of one language.
    Sums are held as logarithms; pieces are looked up for many places at once, forwards and again backwards."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(U)
    n, wide = len(c), lattice.longest
    weights = np.append(np.log(np.maximum(p[:-1, 0], 1e-300)), -np.inf)

    def looked_up(a: int, z: int) -> tuple[np.ndarray, np.ndarray]:
        """For the places from a to z the pieces that begin there, by length, and the logarithms of their probabilities."""
        got, h = np.full((z - a, wide), lattice.n), np.zeros(z - a, U)
        for k in range(min(wide, n - a)):
            here = np.arange(a, min(z, n - k)) - a
            h[here] = lattice.step(h[here], c[a + k + here])
            got[here, k] = lattice.find(h[here])
        out = weights[got]
        out[got[:, 0] == lattice.n, 0] = np.log(STRAY)
        return got, out

    ahead, back = np.full(n + wide + 1, -np.inf), np.full(n + wide + 1, -np.inf)
    ahead[0] = back[n] = 0
    for a in range(0, n, BLOCK):
        _, w = looked_up(a, min(n, a + BLOCK))
        for i in range(len(w)):
            to = slice(a + i + 1, a + i + 1 + wide)
            ahead[to] = np.logaddexp(ahead[to], ahead[a + i] + w[i])
    sums = np.zeros(lattice.n + 1)
    for a in reversed(range(0, n, BLOCK)):
        got, w = looked_up(a, min(n, a + BLOCK))
        for i in reversed(range(len(w))):
            back[a + i] = np.logaddexp.reduce(w[i] + back[a + i + 1 : a + i + 1 + wide])
        to = np.arange(a, a + len(w))[:, None] + np.arange(1, wide + 1)
        np.add.at(sums, got, np.exp(ahead[a : a + len(w), None] + w + back[to] - ahead[n]))
    some = np.flatnonzero(sums[:-1])
    return some, sums[some]


def by_length(texts: list[str]) -> Iterator[np.ndarray]:
    size = np.array(list(map(len, texts)))
    for n in np.unique(size):
        yield np.flatnonzero(size == n)


class Model:
    def __init__(self, languages: list[str], pieces_: list[str], prob: np.ndarray):
        self.languages, self.pieces, self.prob = languages, pieces_, prob
        self.lattice: Lattice | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"lattice": None}

    def ready(self) -> None:
        if self.lattice is None:
            self.lattice, self.p = Lattice(self.pieces), _weights(self.prob)
            self.known, self.scores, self.again = np.zeros(0, U), np.zeros((0, len(self.languages)), np.float32), np.zeros(0, bool)

    def word_scores(self, texts: list[str]) -> np.ndarray:
        """Log-likelihood of words by language."""
        self.ready()
        own_ = [marked(w) for w in texts]
        out = np.zeros((len(texts), len(self.languages)))
        size = np.array(list(map(len, own_)))
        short = np.flatnonzero(size <= SEGMENT)
        for own in by_length([own_[i] for i in short]):
            for k in range(0, len(own), 4096):
                some = short[own[k : k + 4096]]
                alpha, _ = forward(self.lattice, self.p, [own_[i] for i in some])
                out[some] = np.log(alpha[-1])
        longer = np.flatnonzero((size > SEGMENT) & (size <= TOGETHER))
        longer = longer[np.argsort(size[longer], kind="stable")]
        for k in range(0, len(longer), 256):
            some = longer[k : k + 256]
            out[some] = padded_scores(self.lattice, self.p, [own_[i] for i in some])
        for i in np.flatnonzero(size > TOGETHER):
            out[i] = long_score(self.lattice, self.p, own_[i])
        return out

    def text_scores(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihood of whole texts by language, and their number of word bytes."""
        self.ready()
        n = len(bounds) - 1
        start, end, text = words(data, bounds)
        if not len(start):
            return np.zeros((n, len(self.languages))), np.zeros(n)
        h = hasher(1)
        distinct, some, which = np.unique(h.of_ranges(data, start, end), return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(self.known, distinct), max(0, len(self.known) - 1))
        there = self.known[place] == distinct if len(self.known) else np.zeros(len(distinct), bool)
        scores = np.zeros((len(distinct), len(self.languages)), np.float32)
        scores[there] = self.scores[place[there]]
        self.again[place[there]] = True
        if not there.all():
            whole, new = data.tobytes(), np.flatnonzero(~there)
            scores[new] = self.word_scores([whole[s:e].decode("utf-8", "replace") for s, e in zip(start[some[new]], end[some[new]], strict=True)])
            if len(self.known) + len(new) > REMEMBERED:
                keep = self.again & (self.again.sum() <= REMEMBERED // 2)
                self.known, self.scores, self.again = self.known[keep], self.scores[keep], np.zeros(keep.sum(), bool)
            at = np.searchsorted(self.known, distinct[new])
            self.known, self.scores, self.again = np.insert(self.known, at, distinct[new]), np.insert(self.scores, at, scores[new], axis=0), np.insert(self.again, at, False)
        sums = [np.bincount(text, scores[which, k], minlength=n) for k in range(len(self.languages))]
        return np.stack(sums, axis=1), np.bincount(text, end - start, minlength=n)


def learn(docs: DataFrame, vocabulary_path: str, per_language: int = 400, rounds: int = 2, most_languages: int = MOST_LABELS, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Fits piece probabilities from about per_language rows of each language that are not held out (where there are more
    than most_languages, of the most frequent ones: a model has a number for each language and piece).

    Rows with a null text, language or id are left out; empty texts teach nothing; a very long text is read in its turn and
    gives one row for each distinct word; repeated rows and ids count each; other columns are ignored. Without rows, or
    over an empty table, the model has no language.
    """
    small_batches(docs.sparkSession)
    able = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(doc_id)).select(F.col(doc_id).alias("d"), F.col(text).alias("t"), F.col(lang).cast("string").alias("l"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, bounds = text_bytes(b.column(1))
            for i, j in pieces(bounds):
                own = data[bounds[i] : bounds[j]]
                start, end, text_no = words(own, bounds[i : j + 1] - bounds[i])
                raw, l = own.tobytes(), b.column(0).slice(i, j - i).to_pylist()
                n = Counter((l[k], marked(raw[x:y].decode("utf-8", "replace"))) for x, y, k in zip(start.tolist(), end.tolist(), text_no.tolist(), strict=True))
                if n:
                    yield pa.RecordBatch.from_arrays([pa.array([l for l, _ in n]), pa.array([w for _, w in n]), pa.array(list(n.values()), pa.int64())], ["l", "s", "n"])

    found = bounded(able, "l", "d", per_language, most_languages).select("l", "t").mapInArrow(counted, "l string, s string, n long")
    seen = written(found.groupBy("l", "s").agg(F.sum("n").alias("n")), "words")
    languages = sorted(r[0] for r in seen.select("l").distinct().collect())
    pieces_ = vocabulary(vocabulary_path)
    prob = np.full((len(pieces_), len(languages)), 1 / max(1, len(pieces_)))
    for _ in range(rounds if languages else 0):
        now = prob

        def expected(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """Expected sightings of pieces, from all segmentations of the words of a batch."""
            lattice, p = Lattice(pieces_), _weights(now)
            for b in batches:
                for l, g in b.groupby("l"):
                    k = languages.index(l)
                    texts, n, sums = g["s"].tolist(), g["n"].to_numpy(float), np.zeros(len(pieces_) + 1)
                    for own in by_length(texts):
                        if len(texts[own[0]]) > SEGMENT:
                            for i in own:
                                some, seen_ = long_sightings(lattice, p[:, k : k + 1], texts[i])
                                sums[some] += n[i] * seen_
                            continue
                        alpha, arcs = forward(lattice, p[:, k : k + 1], [texts[i] for i in own])
                        beta = [np.zeros(len(own)) for _ in alpha]
                        beta[-1] += n[own] / alpha[-1][:, 0]
                        for (i, j), got in sorted(arcs.items(), reverse=True):
                            w = _arc(p[:, k : k + 1], got, j - i, lattice.n)[:, 0] * beta[j]
                            np.add.at(sums, got, alpha[i][:, 0] * w)
                            beta[i] += w
                    some = np.flatnonzero(sums[:-1])
                    yield pd.DataFrame({"k": k, "piece": some, "n": sums[some]})

        got = seen.repartition("s").mapInPandas(expected, "k int, piece int, n double").groupBy("k", "piece").agg(F.sum("n").alias("n")).toPandas()
        prob = np.full(prob.shape, BESIDES)
        np.add.at(prob, (got["piece"], got["k"]), got["n"])
        prob /= prob.sum(0)
    dropped(docs.sparkSession, seen)
    return Model(languages, pieces_, prob)


def identify(docs: DataFrame, model: Model, sure: int = 48, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """lang_pred and score besides all columns of docs; columns of these names are replaced, others stay as they are.

    lang_pred is the language of the highest log-likelihood over the whole text (ties: the first by
    name), or und, with score 0, where the text is null or has no letter (an empty one, too) or nothing was learnt. score is
    its posterior probability under equal priors, with the evidence counted as that of at most sure bytes:
    characters depend on each other, so the plain posterior would be too certain. Very long texts and words are scored
    whole; repeated rows get equal results each; null ids don't matter; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    kept = docs.drop("lang_pred", "score")
    schema = kept.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    letters = kept.withColumn("score", F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _resident(model)
        at = letters_names.index(text)
        for b in batches:
            data, bounds = text_bytes(b.column(at))
            pred, score = np.full(b.num_rows, len(m.languages)), np.zeros(b.num_rows)
            if m.languages:
                for i, j in pieces(bounds, 4 * PIECE):  # many new words at a time
                    s, n = m.text_scores(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
                    z = s * (np.minimum(n, sure) / np.maximum(n, 1))[:, None]
                    z = np.exp(z - z.max(1, keepdims=True))
                    pred[i:j] = s.argmax(1)
                    score[i:j] = z[np.arange(j - i), pred[i:j]] / z.sum(1)
            no = ~b.column(b.num_columns - 1).to_numpy(zero_copy_only=False)
            pred[no], score[no] = len(m.languages), 0.0
            names = pa.array([*m.languages, UNKNOWN])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], names.take(pa.array(pred)), pa.array(score)], [*letters_names[:-1], "lang_pred", "score"])

    letters_names = letters.columns
    return letters.mapInArrow(run, schema)


_HELD: dict = {}


def _resident(model: Model) -> Model:
    """One copy of a model in a worker, with what it remembers of words."""
    key = (TaskContext.get().getLocalProperty("spark.app.id"), tuple(model.languages), model.prob.tobytes()[:4096], float(model.prob.sum()), float((model.prob**2).sum()))
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = model
    return _HELD[key]
