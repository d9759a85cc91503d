"""Language-model scores from a gated recurrent network in numpy with a class-factored output.

Word counts of all training documents are summed by Spark. The ``EXPLICIT`` most frequent tokens are words of the
network, in classes of ``CLASS_WORDS`` by frequency; all others fall into bands by frequency, which are classes too,
and within a band a word has its share of the band's counts (plus one; all unseen words together one more). A token's
probability is its class's softmax times its softmax within the class, or times that share.

Training: every partition runs truncated backpropagation over all its training documents, from common weights that
were fitted on a small sample; the weights are then averaged by tokens seen, in chunks, so that no task holds more than
one chunk of all of them. Scoring: documents are read whole, longest first side by side, window by window with the
state carried on. Words beyond the ``HOT`` table that is sent to the tasks only need their counts, which a join adds.

Nulls: a null or empty text has one token, the end. A null id counts as text '' in the choice of training rows. Rows
equal in id and text have equal scores. An empty table gives an empty result. With no training rows every count is
zero. Columns other than id and text play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import materialize, pick

# Words sent to all tasks with their counts; tokens of the network; words of a class; width of the state.
HOT = 1 << 18
EXPLICIT = 512
CLASS_WORDS = 32
HIDDEN = 16
# Ranks at which bands end; the last band holds whatever is not in the hot table.
BANDS = (4096, 32768, HOT)
WINDOW = 32
LANES = 1024
RATE = 0.01
# Documents that the common starting weights are fitted on.
START_DOCS = 200
CHUNK = 4096
# Texts whose words are held at a time.
SLICE = 2048

END = ""


def _words(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Blank-separated words of all texts, A-Z in lower case, without ends; the place of each one's text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(text, "")))
    words, owner = lists.flatten(), pc.list_parent_indices(lists)
    full = pc.greater(pc.binary_length(words), 0)
    return words.filter(full), owner.filter(full).to_numpy().astype(np.int64)


def _slices(part: pa.RecordBatch):
    """Parts of a batch; what Arrow has freed of one is given back before the next."""
    for i in range(0, part.num_rows, SLICE):
        yield part.slice(i, SLICE)
        pa.default_memory_pool().release_unused()


class Vocabulary:
    """Hot words by frequency with counts, and what the bands hold; made once, sent to tasks."""

    def __init__(self, hot: list[tuple[str, int]], total: int, distinct: int):
        hot = sorted(hot, key=lambda x: (-x[1], x[0]))
        if not any(w == END for w, _ in hot):
            hot.append((END, 0))
        # The end is always a word of the network.
        hot = [x for x in hot if x[0] == END] + [x for x in hot if x[0] != END]
        self.total, self.distinct = total, distinct
        self.words = pa.array([w for w, _ in hot], pa.string())
        self.count = np.array([c for _, c in hot], dtype=np.float64)
        ends = (EXPLICIT, *BANDS)
        inside = [self.count[a:b] for a, b in zip(ends, ends[1:])]
        self.mass = np.array([max(1.0, (c + 1).sum()) for c in inside] + [
            (total - self.count.sum()) + max(0, distinct - int((self.count > 0).sum())) + 1])
        # Network id of each hot word: itself, or its band.
        ranks = np.arange(len(hot))
        self.net = np.where(ranks < EXPLICIT, ranks, EXPLICIT + np.searchsorted(np.array(BANDS), ranks, side="right"))
        self.tail = EXPLICIT + len(BANDS)
        self.n_in = self.tail + 1
        self.classes = EXPLICIT // CLASS_WORDS + len(BANDS) + 1
        # log10 of the share within a band; 0 for words of the network.
        self.share = np.where(ranks < EXPLICIT, 0.0,
                              np.log10(self.count + 1) - np.log10(self.mass[np.maximum(self.net - EXPLICIT, 0)]))


def start_weights(v: Vocabulary) -> dict[str, np.ndarray]:
    """Random state weights; output biases such that the untrained model has the words' frequencies."""
    draw = np.random.default_rng(5)
    rows = EXPLICIT // CLASS_WORDS
    c = np.full(EXPLICIT, 0.0)
    c[:min(EXPLICIT, len(v.count))] = v.count[:EXPLICIT] + 1
    per_class = np.concatenate([c.reshape(rows, CLASS_WORDS).sum(axis=1), v.mass])
    with np.errstate(divide="ignore"):
        inner = np.maximum(np.log(c.reshape(rows, CLASS_WORDS)), -60.0)
        outer = np.maximum(np.log(per_class / per_class.sum()), -60.0)
    small = lambda *shape: draw.normal(0, 0.1, shape)
    w = {"W": small(v.n_in, 3 * HIDDEN), "U": small(HIDDEN, 3 * HIDDEN), "b": np.zeros(3 * HIDDEN),
         "C": np.zeros((HIDDEN, v.classes)), "c": outer, "D": np.zeros((rows, HIDDEN, CLASS_WORDS)), "d": inner}
    return {k: x.astype(np.float32) for k, x in w.items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.exp(np.negative(x, out=x), out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _gates(w: dict) -> list[np.ndarray]:
    """Tables of inputs, biases added, and of states, each gate's apart, so that all steps work on whole arrays."""
    return [np.ascontiguousarray(m[:, i:i + HIDDEN]) for m in (w["W"] + w["b"], w["U"])
            for i in (0, HIDDEN, 2 * HIDDEN)]


def _step(gates: list[np.ndarray], x: np.ndarray, h: np.ndarray):
    """One step of all lanes: new state and what the way back needs."""
    az, ar, an, uz, ur, un = gates
    z, r, n, m = az.take(x, axis=0), ar.take(x, axis=0), an.take(x, axis=0), h @ un
    z += h @ uz
    r += h @ ur
    z, r = _sigmoid(z), _sigmoid(r)
    n += r * m
    np.tanh(n, out=n)
    new = h - n
    new *= z
    new += n
    return new, (h, z, r, n, m)


def _log_softmax(x: np.ndarray) -> np.ndarray:
    """Of each column, in place."""
    x -= x.max(axis=0)
    x -= np.log(np.exp(x).sum(axis=0))
    return x


def _class_of(y: np.ndarray) -> np.ndarray:
    return np.where(y < EXPLICIT, y // CLASS_WORDS, y - EXPLICIT + EXPLICIT // CLASS_WORDS)


def _output(w: dict, h: np.ndarray, y: np.ndarray, grad: dict | None = None):
    """Natural log probability of each target's network id; with ``grad``, adds gradients and returns that of ``h``."""
    k = _class_of(y)
    # Columns are targets: sums over classes then run along whole rows.
    logs = _log_softmax(w["C"].T @ h.T + w["c"][:, None])
    at = np.arange(len(y))
    out = logs[k, at]
    order = np.argsort(k.astype(np.int16), kind="stable")
    ends = np.searchsorted(k[order], np.arange(EXPLICIT // CLASS_WORDS + 1))
    order = order[:ends[-1]]
    sorted_h, inner, found = h.take(order, axis=0), y[order] % CLASS_WORDS, np.empty(len(order), dtype=out.dtype)
    back = sorted_back = None
    if grad is not None:
        delta = np.exp(logs)
        delta[k, at] -= 1
        grad["C"] += (delta @ h).T
        grad["c"] += delta.sum(axis=1)
        back, sorted_back = delta.T @ w["C"].T, np.empty_like(sorted_h)
    for c in range(EXPLICIT // CLASS_WORDS):
        rows = slice(ends[c], ends[c + 1])
        hs, target = sorted_h[rows], (inner[rows], np.arange(ends[c + 1] - ends[c]))
        if not len(hs):
            continue
        logs = _log_softmax(w["D"][c].T @ hs.T + w["d"][c][:, None])
        found[rows] = logs[target]
        if grad is not None:
            delta = np.exp(logs)
            delta[target] -= 1
            grad["D"][c] += (delta @ hs).T
            grad["d"][c] += delta.sum(axis=1)
            sorted_back[rows] = delta.T @ w["D"][c].T
    out[order] += found
    if grad is not None:
        back[order] += sorted_back
    return out, back


class Trainer:
    """Truncated backpropagation with Adam."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = {k: x.copy() for k, x in weights.items()}
        self.m = {k: np.zeros_like(x) for k, x in self.w.items()}
        self.v = {k: np.zeros_like(x) for k, x in self.w.items()}
        self.turn = self.seen = 0

    def fit(self, docs: list[np.ndarray]) -> None:
        """One pass over the documents, laid end to end and cut into lanes; states start anew with each document."""
        if not docs:
            return
        y = np.concatenate(docs)
        first = np.zeros(len(y), dtype=bool)
        first[np.cumsum([0] + [len(d) for d in docs[:-1]])] = True
        x = np.roll(y, 1)
        x[first] = 0  # the end stands before the first word
        self.seen += len(y)
        lanes = max(1, min(LANES, len(y) // WINDOW))
        length = -(-len(y) // lanes)
        pad = lanes * length - len(y)
        shape = lambda a, fill: np.concatenate([a, np.full(pad, fill, a.dtype)]).reshape(lanes, length).T
        x, y, first = shape(x, 0), shape(y, -1), shape(first, True)
        h = np.zeros((lanes, HIDDEN), dtype=np.float32)
        for t in range(0, length, WINDOW):
            h = self._window(x[t:t + WINDOW], y[t:t + WINDOW], first[t:t + WINDOW], h)

    def _window(self, x, y, first, h):
        w, kept, states = self.w, [], []
        gates = _gates(w)
        firsts = [np.flatnonzero(f) for f in first]
        for t in range(len(x)):
            h = h.copy()
            h[firsts[t]] = 0
            h, memory = _step(gates, x[t], h)
            kept.append(memory)
            states.append(h)
        used = y.ravel() >= 0
        flat = np.concatenate(states)
        grad = {k: np.zeros_like(a) for k, a in w.items()}
        n = max(1, int(used.sum()))
        _, back = _output(w, flat[used], y.ravel()[used], grad)
        dh_out = np.zeros_like(flat)
        dh_out[used] = back
        dh_out = dh_out.reshape(len(x), -1, HIDDEN)
        dh = np.zeros_like(h)
        # Gradients of the inputs of the gates, and of the state's part in the new one, by step.
        dz, dr, dn, dm = (np.empty_like(dh_out) for _ in range(4))
        turned = [np.ascontiguousarray(u.T) for u in gates[3:]]
        for t in range(len(x) - 1, -1, -1):
            before, z, r, g, m = kept[t]
            dh += dh_out[t]
            rest = 1 - z
            np.multiply(dh, rest, out=dn[t])
            rest *= z
            rest *= dh
            np.multiply(before - g, rest, out=dz[t])
            dn[t] *= 1 - g * g
            np.multiply(dn[t], r, out=dm[t])
            np.multiply(dm[t], m, out=dr[t])
            dr[t] *= 1 - r
            dh *= z
            for part, u in zip((dz, dr, dm), turned):
                dh += part[t] @ u
            dh[firsts[t]] = 0
        before = np.concatenate([k[0] for k in kept]).T
        flat_of = lambda a: a.reshape(-1, HIDDEN)
        grad["U"] += np.concatenate([before @ flat_of(a) for a in (dz, dr, dm)], axis=1)
        ids = x.ravel()
        order = np.argsort(ids.astype(np.int16), kind="stable")
        starts = np.flatnonzero(np.diff(ids[order], prepend=-1))
        for i, a in enumerate((dz, dr, dn)):
            sums = np.add.reduceat(flat_of(a).take(order, axis=0), starts, axis=0)
            grad["W"][ids[order][starts], i * HIDDEN:(i + 1) * HIDDEN] = sums
        grad["b"] += grad["W"].sum(axis=0)
        self._update(grad, n)
        return h

    def _update(self, grad: dict, n: int) -> None:
        self.turn += 1
        fix1, fix2 = 1 - 0.9 ** self.turn, 1 - 0.999 ** self.turn
        for k, g in grad.items():
            g /= n
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.w[k] -= RATE * (self.m[k] / fix1) / (np.sqrt(self.v[k] / fix2) + 1e-8)


def score_docs(w: dict, docs: list[np.ndarray]) -> np.ndarray:
    """Natural log probability of each document's network ids, state carried across windows."""
    total, gates = np.zeros(len(docs)), _gates(w)
    order = np.argsort([-len(d) for d in docs], kind="stable")
    for i in range(0, len(docs), LANES):
        total[order[i:i + LANES]] = _score_block(w, gates, [docs[j] for j in order[i:i + LANES]])
    return total


def _score_block(w: dict, gates: list[np.ndarray], docs: list[np.ndarray]) -> np.ndarray:
    """As ``score_docs``, for some documents, longest first, side by side."""
    lengths = np.array([len(d) for d in docs])
    starts = np.cumsum(lengths) - lengths
    # All documents end to end, targets and the tokens before them; windows are cut out of these by place.
    flat = np.concatenate([*docs, np.zeros(WINDOW, dtype=docs[0].dtype)])
    before = np.roll(flat, 1)
    before[starts] = 0
    total, h = np.zeros(len(docs)), np.zeros((len(docs), HIDDEN), dtype=np.float32)
    for t in range(0, int(lengths[0]), WINDOW):
        live = int((lengths > t).sum())
        steps = np.arange(t, min(t + WINDOW, int(lengths[0])))[:, None]
        at = starts[:live] + steps
        used = (steps < lengths[:live]).ravel()
        xs, y = before[at], flat[at].ravel()
        h, states = h[:live], []
        for x in xs:
            h, _ = _step(gates, x, h)
            states.append(h)
        logs = np.zeros(len(used))
        logs[used], _ = _output(w, np.concatenate(states)[used], y[used])
        total[:live] += logs.reshape(len(xs), live).sum(axis=0)
    return total


def _pack(w: dict) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in sorted(w)])


def _unpack(flat: np.ndarray, like: dict) -> dict:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at:at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def _training(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 7 != 2


def count_words(docs: DataFrame) -> DataFrame:
    """(word, count) over the texts, the end included; summed per slice, and by Spark before the shuffle."""

    def batches(parts):
        for part in (some for whole in parts for some in _slices(whole)):
            found = pc.value_counts(_words(part.column("text"))[0])
            words, counts = found.field("values").cast(pa.string()), found.field("counts").cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([words, pa.array([END], pa.string())]),
                 pa.concat_arrays([counts, pa.array([part.num_rows], pa.int64())])], names=["word", "count"])

    return docs.select("text").mapInArrow(batches, "word string, count bigint").groupBy("word").agg(
        F.sum("count").alias("count"))


def _hot(counts: DataFrame) -> list[tuple[str, int]]:
    """Words at or over the lowest count that at most ``HOT`` words reach."""
    levels = counts.groupBy("count").agg(F.count("*").alias("n")).orderBy(F.col("count").desc()).limit(HOT).collect()
    total, least = 0, None
    for count, n in levels:
        total += n
        if total > HOT - 1:
            break
        least = count
    if least is None:
        return []
    return [(r["word"], r["count"]) for r in counts.filter(F.col("count") >= least).collect()]


class Tokens:
    """Tokens of some texts end to end, as places in the hot table (-1 for others), and the words that are not in it."""

    def __init__(self, text: pa.Array, v: Vocabulary):
        words, owner = _words(text)
        rank = pc.fill_null(pc.index_in(words, value_set=v.words.cast(words.type)), -1).to_numpy()
        n = np.bincount(owner, minlength=len(text))
        # The end, first of the hot words, closes each text.
        self.rank, self.n = np.insert(rank, np.cumsum(n), 0), n + 1
        self.starts = np.cumsum(self.n) - self.n
        others = rank < 0
        self.others, self.owner = words.filter(pa.array(others)).cast(pa.string()), owner[others]
        # The last entry stands for -1.
        self.ids = np.append(v.net, v.tail).astype(np.int16)[self.rank]

    def docs(self) -> list[np.ndarray]:
        """Network ids by text."""
        return np.split(self.ids, self.starts[1:]) if len(self.n) else []

    def sums(self, of_hot: np.ndarray) -> np.ndarray:
        """Sum of a value of hot words over each text."""
        return np.add.reduceat(np.append(of_hot, 0.0)[self.rank], self.starts) if len(self.n) else np.zeros(0)

    def rest(self) -> pa.Array:
        """(word, n) of the distinct words of each text that are not in the hot table."""
        coded = self.others.dictionary_encode()
        size = max(1, len(coded.dictionary))
        keys, n = np.unique(self.owner * size + coded.indices.to_numpy(), return_counts=True)
        cuts = np.searchsorted(keys, np.arange(len(self.n) + 1) * size)
        items = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(keys % size)), pa.array(n.astype(np.int64))],
                                           names=["word", "n"])
        return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), items)


def train(docs: DataFrame, v: Vocabulary) -> dict[str, np.ndarray]:
    """Weights averaged over partitions, each trained on all its documents."""
    spark = docs.sparkSession
    trainer = Trainer(start_weights(v))
    sample = docs.orderBy(F.xxhash64("id"), "id").select("id").limit(START_DOCS).collect()
    some = docs.filter(F.col("id").isin([r["id"] for r in sample])).limit(START_DOCS).select("text")
    trainer.fit(Tokens(pa.array([r["text"] for r in some.toLocalIterator()], pa.string()), v).docs())
    like = trainer.w
    sent = spark.sparkContext.broadcast((v, like))

    def batches(parts):
        vocabulary, start = sent.value
        own = Trainer(start)
        for part in parts:
            own.fit([d for some in _slices(part) for d in Tokens(some.column("text"), vocabulary).docs()])
        flat = _pack(own.w)
        cuts = range(0, len(flat), CHUNK)
        yield pa.RecordBatch.from_arrays(
            [pa.array([i // CHUNK for i in cuts], pa.int32()),
             pa.array([flat[i:i + CHUNK] for i in cuts], pa.list_(pa.float32())),
             pa.array([own.seen] * len(cuts), pa.int64())], names=["chunk", "w", "seen"])

    def mean(table: pa.Table) -> pa.Table:
        seen = table.column("seen").to_numpy().astype(np.float64)
        rows = np.stack(table.column("w").to_numpy(zero_copy_only=False))
        average = (rows * seen[:, None]).sum(axis=0) / max(1.0, seen.sum())
        if not seen.sum():
            average = rows[0]
        return pa.table({"chunk": table.column("chunk")[:1], "w": pa.array([average.astype(np.float32)],
                                                                           pa.list_(pa.float32()))})

    parts = docs.select("text").mapInArrow(batches, "chunk int, w array<float>, seen bigint")
    chunks = sorted(parts.groupBy("chunk").applyInArrow(mean, "chunk int, w array<float>").collect())
    flat = np.concatenate([np.array(c["w"], dtype=np.float32) for c in chunks]) if chunks else _pack(like)
    return _unpack(flat, like)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row; scores are log10."""
    docs = pick(docs, id_col, text_col).toDF("id", "text")
    spark = docs.sparkSession
    learn = docs.filter(_training(docs["id"]))
    counts = materialize(count_words(learn), "lm-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count("*")).first()
    v = Vocabulary(_hot(counts), total, distinct)
    weights = train(learn, v)
    sent = spark.sparkContext.broadcast((v, weights))

    def batches(parts):
        vocabulary, w = sent.value
        for part in (some for whole in parts for some in _slices(whole)):
            tokens = Tokens(part.column("text"), vocabulary)
            known = tokens.sums((vocabulary.count > 0).astype(float)).astype(np.int64)
            logs, share = tokens.sums(np.log10(vocabulary.count + 1)), tokens.sums(vocabulary.share)
            net = score_docs(w, tokens.docs()) / np.log(10)
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("row_key"), *map(pa.array, (tokens.n, known, logs, share, net)), tokens.rest()],
                names=["id", "row_key", "n_tokens", "known", "logs", "share", "net", "rest"])

    kind = docs.schema["id"].dataType.simpleString()
    keyed = docs.withColumn("row_key", F.xxhash64("id", F.coalesce("text", F.lit(""))))
    scored = materialize(keyed.mapInArrow(
        batches, f"id {kind}, row_key bigint, n_tokens bigint, known bigint, logs double, share double, net double, "
        "rest array<struct<word:string,n:bigint>>"), "lm-scored")
    # Words beyond the hot table: known ones add their counts, unseen ones none.
    rest = scored.filter(F.size("rest") > 0).select("row_key", "rest").dropDuplicates(["row_key"]).select(
        "row_key", F.inline("rest"))
    found = rest.join(counts.withColumnRenamed("count", "c"), "word").groupBy("row_key").agg(
        F.sum("n").alias("more_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("more_logs"))
    n_rest = F.aggregate("rest", F.lit(0).cast("bigint"), lambda a, x: a + x["n"])
    more_logs = F.coalesce("more_logs", F.lit(0.0))
    below = float(np.log10(max(1.0, total + distinct + 1)))
    return scored.join(found, "row_key", "left").select(
        F.col("id").alias(id_col), (~_training(F.col("id"))).alias("held_out"), "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("logs") + more_logs - F.col("n_tokens") * below).alias("base_score"),
        (F.col("net") + F.col("share") + more_logs - n_rest * float(np.log10(v.mass[-1]))).alias("score"))
