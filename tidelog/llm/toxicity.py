"""Toxic spans by a linear-chain conditional random field.

Labels are given for documents; token labels are derived from them: Spark counts in how many toxic and other labelled
documents each word, and each beginning of four or five letters, stands, and a word of a toxic document is labelled toxic if it is significantly tied to toxic
documents (likelihood ratio over a threshold that grows with the number of words, and at least half of its documents
toxic). A two-state chain with a weight for each informative word, and for its neighbours, is trained by gradient ascent
in numpy on the
surroundings of informative words in at most ``SAMPLE`` labelled documents. Every document is then tagged whole: forward-backward marginals give
each token's probability; their largest and their sum go through a logistic function, fitted on the same sample, to the
document's score, and tokens over ``SPAN`` give the offending offsets.

Nulls: null and empty texts have no tokens and get the score of a document without any; labels that are null are not
used, nor are rows without an id. Rows equal in id and text are scored alike; an id labelled twice counts as toxic if
any of its labels says so. Empty tables give empty results. With no labels the score is 0.5 x the smallest step above
none, that is 0. Columns other than id, text and label play no part.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import materialize, pick

# Labelled documents the weights are fitted on, of each label at most half of it.
SAMPLE = 4000
# Informative words and beginnings of words of the model.
WORDS = 4096
# Words whose ids a task keeps.
CACHE = 500_000
SPAN = 0.5
CUT = 0.3
STEPS = 60
# Tokens on either side of an informative word that the weights are fitted on.
AROUND = 8
# Most of these per sampled document.
EXCERPT = 128
# Runs of uninformative tokens this long leave no trace of what was before them.
_FORGOTTEN = 4096

# Punctuation and digits around and within words count as blanks.
_SPLIT = bytes(c if chr(c).isalpha() or c >= 128 else 32 for c in range(256))


def _tokens(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().translate(_SPLIT).split()


def _features(word: bytes) -> list[str]:
    """The word, and its first five and four letters, which catch inflected and compound forms."""
    text = word.decode()
    return [text, *[text[:n] + "-" for n in (5, 4) if len(text) >= n]]


class _Ids(dict):
    """Feature id by word: of the first of its features that is informative, else 0; filled as words come."""

    def __init__(self, features: dict[str, int]):
        super().__init__()
        self.features = features

    def __missing__(self, word: bytes) -> int:
        found = next((self.features[f] for f in _features(word) if f in self.features), 0)
        if len(self) < CACHE:
            self[word] = found
        return found

    def of(self, text: str | None) -> np.ndarray:
        return np.array([self[w] for w in _tokens(text)], dtype=np.int64)


def _places(text: str) -> list[tuple[int, int]]:
    """Code point offsets of the tokens."""
    raw = text.encode().lower().translate(_SPLIT)
    out, at = [], 0
    for word in raw.split():
        at = raw.index(word, at)
        start = len(text.encode()[:at].decode()) if not text.isascii() else at
        out.append((start, start + len(word.decode())))
        at += len(word)
    return out


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(id, text, toxic) of the labelled rows."""
    marks = labels.select(labels[id_col].alias("id"), labels[label_col].alias("toxic")).filter(
        "id is not null and toxic is not null").groupBy("id").agg(F.max("toxic").alias("toxic"))
    # Labels grow with the corpus, so they are joined by shuffle at every size.
    return pick(docs, id_col, text_col).toDF("id", "text").join(marks.hint("merge"), "id")


def word_labels(rows: DataFrame) -> DataFrame:
    """(word, toxic, other): labelled documents of each kind with the word; one row, word '', has the totals."""

    def batches(parts):
        for part in parts:
            toxic: dict[str, int] = {"": 0}
            other: dict[str, int] = {"": 0}
            for text, mark in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist()):
                into = toxic if mark == 1 else other
                for f in {"", *[f for w in set(_tokens(text)) for f in _features(w)]}:
                    into[f] = into.get(f, 0) + 1
            words = list(toxic.keys() | other.keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(words, pa.string()),
                 pa.array([toxic.get(w, 0) for w in words], pa.int64()),
                 pa.array([other.get(w, 0) for w in words], pa.int64())], names=["word", "toxic", "other"])

    return rows.select("text", "toxic").mapInArrow(batches, "word string, toxic bigint, other bigint").groupBy(
        "word").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def informative(counts: DataFrame, most: int = WORDS) -> list[tuple[str, float]]:
    """The words most tied to toxic documents, with their likelihood ratio; toxic words are a prefix of the list."""
    total = counts.filter("word = ''").first()
    if total is None or not total["toxic"] or not total["other"]:
        return []
    a, b = float(total["toxic"]), float(total["other"])
    n = counts.count()
    t, o = F.col("toxic").cast("double"), F.col("other").cast("double")
    share = (t + o) * (a / (a + b))
    part = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    ratio = 2 * (part(t, share) + part(o, t + o - share))
    tied = counts.filter("word <> ''").withColumn("ratio", ratio).filter(
        (t > share) & (F.col("ratio") >= 2 * math.log(max(2, n)) + 4) & (t >= o))
    return [(r["word"], r["ratio"]) for r in
            tied.orderBy(F.col("ratio").desc(), "word").limit(most).select("word", "ratio").collect()]


class Chain:
    """Two states, other and toxic; features of a token are its word's id (0: not informative) and its neighbours'."""

    def __init__(self, n_words: int):
        # Weight of the toxic state by word, of an informative word before and after, and of the four transitions.
        self.word = np.zeros(n_words + 1)
        self.near = np.zeros(2)
        self.move = np.zeros((2, 2))
        self.logistic = np.zeros(3)

    def weights(self, ids: np.ndarray) -> np.ndarray:
        """Log weight of the toxic state of each token in a padded batch (rows: documents)."""
        known = ids > 0
        before, after = np.zeros_like(known), np.zeros_like(known)
        before[:, 1:], after[:, :-1] = known[:, :-1], known[:, 1:]
        return self.word[ids] + self.near[0] * before + self.near[1] * after

    def marginals(self, ids: np.ndarray, lengths: np.ndarray):
        """Probability of the toxic state at each place, and expected counts of transitions."""
        emit = np.exp(np.clip(self.weights(ids), -30, 30))
        move = np.exp(self.move)
        n, width = ids.shape
        inside = np.arange(width)[None, :] < lengths[:, None]
        forward = np.zeros((width, n, 2))
        state = np.ones((n, 2))
        for t in range(width):
            new = (state @ move if t else state) * np.stack([np.ones(n), emit[:, t]], axis=1)
            new /= new.sum(axis=1, keepdims=True)
            state = np.where(inside[:, t:t + 1], new, state)
            forward[t] = state
        backward = np.ones((n, 2))
        toxic, moves = np.zeros((n, width)), np.zeros((2, 2))
        for t in range(width - 1, -1, -1):
            both = forward[t] * backward
            toxic[:, t] = both[:, 1] / both.sum(axis=1) * inside[:, t]
            if t:
                after = backward * np.stack([np.ones(n), emit[:, t]], axis=1)
                pair = forward[t - 1][:, :, None] * move[None] * after[:, None, :]
                pair /= pair.sum(axis=(1, 2), keepdims=True)
                moves += pair[inside[:, t]].sum(axis=0)
                new = after @ move.T
                new /= new.sum(axis=1, keepdims=True)
                backward = np.where(inside[:, t:t + 1], new, backward)
        return toxic, moves

    def fit(self, docs: list[np.ndarray], tags: list[np.ndarray]) -> None:
        """Gradient ascent on the likelihood of the tags, with a small quadratic penalty."""
        batches, pairs = [], np.zeros((2, 2))
        for rows, ids, lengths in _padded(docs):
            gold = np.zeros(ids.shape)
            for i, r in enumerate(rows):
                gold[i, :lengths[i]] = tags[r]
                state = tags[r].astype(int)
                pairs += np.bincount(2 * state[:-1] + state[1:], minlength=4).reshape(2, 2)
            batches.append((ids, lengths, gold))
        rate, memory = 0.5, None
        for _ in range(STEPS):
            g_word, g_near, g_move = -0.01 * self.word, -0.01 * self.near, pairs - 0.01 * self.move
            for ids, lengths, gold in batches:
                toxic, moves = self.marginals(ids, lengths)
                g_move -= moves
                gap = gold - toxic
                g_word += np.bincount(ids.ravel(), weights=gap.ravel(), minlength=len(g_word))
                known = ids > 0
                g_near[0] += (gap[:, 1:] * known[:, :-1]).sum()
                g_near[1] += (gap[:, :-1] * known[:, 1:]).sum()
            flat = np.concatenate([g_word, g_near, g_move.ravel()])
            memory = flat * flat if memory is None else memory * 0.9 + flat * flat * 0.1
            step = rate * flat / (np.sqrt(memory) + 1e-8)
            rate *= 0.98
            self.word += step[:len(self.word)]
            self.near += step[len(self.word):len(self.word) + 2]
            self.move += step[-4:].reshape(2, 2)

    def events(self, docs: list[np.ndarray]):
        """Marginals at the informative words and their neighbours, exact for the whole of each document.

        The tokens between are all alike, so a run of m of them is the m-th power of one step's matrix.
        Returns, per document, the places and their probabilities.
        """
        out = [(np.zeros(0, dtype=np.int64), np.zeros(0))] * len(docs)
        places = []
        for d in docs:
            hits = np.flatnonzero(d)
            near = np.unique(np.concatenate([hits - 1, hits, hits + 1])) if len(hits) else hits
            places.append(near[(near >= 0) & (near < len(d))])
        powers = self._powers()
        for rows, at, counts in _padded(places):
            n, width = at.shape
            inside = np.arange(width)[None, :] < counts[:, None]
            lengths = np.array([len(docs[r]) for r in rows])
            emit = np.ones((n, width))
            for i, r in enumerate(rows):
                emit[i, :counts[i]] = np.exp(np.clip(self.weights(docs[r][None, :])[0, places[r]], -30, 30))
            gaps = np.maximum(np.diff(at, axis=1, prepend=-1) - 1, 0)
            tails = lengths - 1 - at[np.arange(n), counts - 1]
            move = np.exp(self.move)
            plain = np.array([1.0, np.exp(np.clip(self.word[0], -30, 30))])
            forward, state = np.zeros((width, n, 2)), np.ones((n, 2))
            between = np.zeros((width, n, 2, 2))
            for t in range(width):
                if t:
                    between[t] = powers[np.minimum(gaps[:, t], _FORGOTTEN)] @ move
                    new = np.einsum("ni,nij->nj", state, between[t])
                else:
                    led = np.einsum("i,nij->nj", plain, powers[np.clip(gaps[:, 0] - 1, 0, _FORGOTTEN)]) @ move
                    new = np.where(gaps[:, :1] > 0, led, 1.0)
                new *= np.stack([np.ones(n), emit[:, t]], axis=1)
                new /= new.sum(axis=1, keepdims=True)
                state = np.where(inside[:, t:t + 1], new, state)
                forward[t] = state
            backward = powers[np.minimum(tails, _FORGOTTEN)].sum(axis=2)
            toxic = np.zeros((n, width))
            for t in range(width - 1, -1, -1):
                both = forward[t] * backward
                toxic[:, t] = both[:, 1] / both.sum(axis=1)
                if t:
                    after = backward * np.stack([np.ones(n), emit[:, t]], axis=1)
                    new = np.einsum("nij,nj->ni", between[t], after)
                    new /= new.sum(axis=1, keepdims=True)
                    backward = np.where(inside[:, t:t + 1], new, backward)
            for i, r in enumerate(rows):
                out[r] = (places[r], toxic[i, :counts[i]])
        return out

    def _powers(self) -> np.ndarray:
        """Powers of the matrix of one uninformative token, each scaled to sum one; the last stands for all above."""
        step = np.exp(self.move) * np.array([1.0, np.exp(np.clip(self.word[0], -30, 30))])
        powers = np.zeros((_FORGOTTEN + 1, 2, 2))
        powers[0] = np.eye(2) / 2
        for m in range(1, len(powers)):
            powers[m] = powers[m - 1] @ step
            powers[m] /= powers[m].sum()
        return powers

    def summary(self, docs: list[np.ndarray]):
        """Per document (1, log odds of the largest marginal, log of 1 + their sum), and the marginals by place."""
        each = self.events(docs)
        out = np.zeros((len(docs), 3))
        for r, (_, p) in enumerate(each):
            top = float(np.clip(p.max(), 1e-4, 1 - 1e-4)) if len(p) else 1e-4
            out[r] = 1.0, math.log(top / (1 - top)), math.log1p(p.sum())
        return out, each

    def calibrate(self, summary: np.ndarray, marks: np.ndarray) -> None:
        """Logistic regression by Newton's steps, with a small quadratic penalty."""
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(summary @ self.logistic, -30, 30)))
            grad = summary.T @ (marks - p) - 0.01 * self.logistic
            hess = (summary * (p * (1 - p))[:, None]).T @ summary + 0.01 * np.eye(3)
            self.logistic = self.logistic + np.linalg.solve(hess, grad)

    def scores(self, summary: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(summary @ self.logistic, -30, 30)))


def _padded(docs: list[np.ndarray], room: int = 400_000):
    """Batches of documents of similar length: (row numbers, padded ids, lengths)."""
    order = np.argsort([len(d) for d in docs], kind="stable")
    order = order[[len(docs[i]) > 0 for i in order]] if len(order) else order
    at = 0
    while at < len(order):
        stop = at + 1
        while stop < len(order) and stop - at < 512 and (stop - at + 1) * len(docs[order[stop]]) <= room:
            stop += 1
        rows = order[at:stop]
        lengths = np.array([len(docs[r]) for r in rows])
        ids = np.zeros((len(rows), lengths.max()), dtype=np.int64)
        for i, r in enumerate(rows):
            ids[i, :lengths[i]] = docs[r]
        yield rows, ids, lengths
        at = stop


def _around(ids: np.ndarray) -> np.ndarray:
    """Places within ``AROUND`` of an informative word; the first ones where there is none."""
    hits = np.flatnonzero(ids)
    if not len(hits):
        return np.arange(min(len(ids), 2 * AROUND))
    near = np.unique((hits[:, None] + np.arange(-AROUND, AROUND + 1)[None, :]).ravel())
    return near[(near >= 0) & (near < len(ids))][:EXCERPT]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic") -> tuple[dict[str, int], Chain]:
    """Ids of the informative words, and the fitted chain."""
    rows = materialize(labelled(docs, labels, id_col, text_col, label_col), "tox-labelled")
    words = informative(materialize(word_labels(rows), "tox-words"))
    ids = {w: i + 1 for i, (w, _) in enumerate(words)}
    chain = Chain(len(ids))
    sample = []
    for mark in (0, 1):
        of = rows.filter(F.when(F.col("toxic") == 1, 1).otherwise(0) == mark)
        chosen = [r[0] for r in of.orderBy(F.xxhash64("id"), "id").select("id").limit(SAMPLE // 2).collect()]
        sample += [(r["text"], mark) for r in of.filter(F.col("id").isin(chosen)).limit(SAMPLE // 2).toLocalIterator()]
    if not ids or not sample:
        chain.logistic[0] = -30.0
        return ids, chain
    known = _Ids(ids)
    found = [known.of(t) for t, _ in sample]
    tags = [(f > 0) * float(mark) for f, (_, mark) in zip(found, sample)]
    excerpts = [_around(f) for f in found]
    chain.fit([f[x] for f, x in zip(found, excerpts)], [g[x] for g, x in zip(tags, excerpts)])
    # The sample holds labels in other shares than the table; the constant is set right for that.
    summary, _ = chain.summary(found)
    marks = np.array([m for _, m in sample], dtype=np.float64)
    chain.calibrate(summary, marks)
    shares = {r["t"]: r["n"] for r in rows.groupBy(F.when(F.col("toxic") == 1, 1).otherwise(0).alias("t")).agg(
        F.count("*").alias("n")).collect()}
    if shares.get(1) and shares.get(0) and 0 < marks.sum() < len(marks):
        chain.logistic[0] += math.log(shares[1] / shares[0]) - math.log(marks.sum() / (len(marks) - marks.sum()))
    return ids, chain


def tag(docs: DataFrame, model: tuple[dict[str, int], Chain], id_col: str = "doc_id",
        text_col: str = "text") -> DataFrame:
    """(id, score, offsets): offsets are {start, stop} in code points of tokens that are likely toxic."""
    docs = pick(docs, id_col, text_col).toDF("id", "text")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def batches(parts):
        ids, chain = sent.value
        known = _Ids(ids)
        for part in parts:
            texts = part.column("text").to_pylist()
            found = [known.of(t) for t in texts]
            summary, each = chain.summary(found)
            spans = []
            for text, p in zip(texts, each):
                hits = p[0][p[1] >= SPAN]
                places = _places(text) if len(hits) else []
                spans.append([{"start": places[i][0], "stop": places[i][1]} for i in hits])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(chain.scores(summary), pa.float64()), pa.array(spans, kind)],
                names=["id", "score", "offsets"])

    kind = docs.schema["id"].dataType.simpleString()
    out = docs.mapInArrow(batches, f"id {kind}, score double, offsets array<struct<start:bigint,stop:bigint>>")
    return out.withColumnRenamed("id", id_col)
