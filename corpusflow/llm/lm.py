"""Operator 8: masked pseudo-likelihood with a bidirectional window network.

Every word is predicted from the ``SIDE`` words on each side of it, as if it were masked; the sum of the
conditional log-probabilities scores a document. A word's probability has two factors:

* P(class | neighbours) from a network (an embedding for each neighbour's place, a hidden layer, a softmax).
  The most frequent words have a class each; the others share classes by their shape and ending.
* P(word | class) from the frequencies of all words of the corpus: n(word) / (n(class) + 1), where the one
  stands for all words that the corpus doesn't have. So the probabilities of all words add up to one.

What is gathered grows with the corpus: a table of all distinct words with their frequencies, which stays
a table. Its most frequent words (at most ``HEAD`` of at most ``KEPT_BYTES`` bytes) are sent to the tasks;
all other words of a document are joined to the table by the word. A word that occurs once, like an
unknown one, adds nothing to the sum of log n(word), so words of frequency 1 needn't be joined.

The network is trained in numpy on all windows of the corpus: each task runs mini-batches over the
classes of its own part, from the same start, and the tasks' weights are averaged, in tasks as well.

Edge cases: null and empty texts have no words, sums of 0 and no means; repeated rows get equal results;
an empty corpus trains nothing and all predictions are even; ids may have any type; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import lists, map_columns, most_frequent, saved, utf8
from corpusflow.llm.pretokens import Table

#: Class 0 is the text's edge; then frequent words; then shapes.
CLASSES = 128
SHAPES = 64
FREQUENT = CLASSES - SHAPES - 1
#: Words on each side.
SIDE = 2
HIDDEN = 32
BATCH = 1024
_ROWS = 32
#: A task whose part has fewer batches goes over it again until it has made so many steps.
LEAST_STEPS = 300
RATE = 0.1
#: Words whose frequencies are sent to the tasks, and the length of the longest one.
HEAD = 200_000
KEPT_BYTES = 64
_DIGITS = bytes(range(48, 58))
_SIGNS = bytes([*range(48), *range(58, 65)])
#: Words that are numbered at once.
_GROUP = 1 << 20


def shape(word: bytes) -> int:
    """The class of a word that isn't frequent: by its ending and the kinds of its characters."""
    alpha = word.isalpha()
    kinds = (alpha, not alpha and len(word.translate(None, _DIGITS)) < len(word), not alpha and len(word.translate(None, _SIGNS)) < len(word), len(word) > 12)
    return 1 + FREQUENT + zlib.crc32(word[-2:] + bytes(kinds)) % SHAPES


def class_table(frequent: list[bytes]) -> Table:
    """Words to classes."""
    own = {w: 1 + i for i, w in enumerate(frequent)}
    return Table(lambda w: own.get(w) or shape(w))


def words_of(text: bytes | None) -> list[bytes]:
    """The words of a text, A-Z in lower case."""
    return (text or b"").lower().split()


def numbered(texts: list[bytes | None]) -> Iterator[tuple[list[bytes], np.ndarray, list[int]]]:
    """For groups of texts: the distinct words, the number of each place's word, and the number of words of each text."""
    held: list[bytes] = []
    sizes: list[int] = []

    def flush() -> tuple[list[bytes], np.ndarray, list[int]]:
        coded = pa.array(held, pa.binary()).dictionary_encode()
        return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False), sizes

    for text in texts:
        own = words_of(text)
        held += own
        sizes.append(len(own))
        if len(held) > _GROUP:
            yield flush()
            held, sizes = [], []
    if sizes:
        yield flush()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): all words of all documents; each group of texts sends a row for each of its distinct words."""

    def make():
        def run(texts: list) -> list[list]:
            words, counts = [], []
            for distinct, codes, _ in numbered(texts):
                words += distinct
                counts += np.bincount(codes, minlength=len(distinct)).tolist()
            return [words, counts]

        return run

    return map_columns(docs.select(utf8("text")), make, "word binary, n long", rows_at_once=None).groupBy("word").agg(F.sum("n").alias("n"))


def class_sizes(words: DataFrame, frequent: list[bytes]) -> np.ndarray:
    """How many places of the corpus hold a word of each class."""

    def make():
        table = class_table(frequent)

        def run(own: list, n: list) -> list[list]:
            total = np.bincount(np.fromiter(map(table.__getitem__, own), np.int64, len(own)), weights=n, minlength=CLASSES)
            return [list(range(CLASSES)), total.astype(np.int64).tolist()]

        return run

    out = np.zeros(CLASSES, np.int64)
    for kind, n in map_columns(words.select("word", "n"), make, "kind int, n long", rows_at_once=None).groupBy("kind").agg(F.sum("n")).collect():
        out[kind] = n
    return out


def _blocks(a: np.ndarray) -> np.ndarray:
    """The array's whole blocks of rows: [block, row, column]."""
    return a[: len(a) // _ROWS * _ROWS].reshape(-1, _ROWS, a.shape[1])


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b, in one call, by blocks so small that the BLAS library starts no threads: the tasks use all cores already."""
    out = np.empty((len(a), b.shape[1]), np.float32)
    whole = len(a) // _ROWS * _ROWS
    np.matmul(_blocks(a), b, out=_blocks(out))
    if whole < len(a):
        np.matmul(a[whole:], b, out=out[whole:])
    return out


def _inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a.T @ b, in the same way."""
    whole = len(a) // _ROWS * _ROWS
    out = np.matmul(_blocks(a).transpose(0, 2, 1), _blocks(b)).sum(axis=0)
    if whole < len(a):
        out += np.matmul(a[whole:].T, b[whole:])
    return out


@dataclass
class Network:
    """Embeddings of the neighbours by place, a hidden layer and a softmax over classes."""

    near: np.ndarray  # [place, class, hidden]
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @staticmethod
    def start(sizes: np.ndarray | None = None, seed: int = 0) -> Network:
        """Random embeddings; before training it predicts the classes' frequencies."""
        r = np.random.default_rng(seed)
        w = lambda *s: (r.standard_normal(s) / np.sqrt(HIDDEN)).astype(np.float32)
        free = np.zeros(CLASSES) if sizes is None else np.log(sizes + 0.5) - np.log((sizes + 0.5).sum())
        return Network(w(2 * SIDE, CLASSES, HIDDEN), np.zeros(HIDDEN, np.float32), np.zeros((HIDDEN, CLASSES), np.float32), free.astype(np.float32))

    def weights(self) -> list[np.ndarray]:
        return [self.near, self.bias, self.out, self.out_bias]

    def hidden(self, context: np.ndarray) -> np.ndarray:
        h = self.near[0].take(context[:, 0], axis=0)
        h += self.bias
        for k in range(1, 2 * SIDE):
            h += self.near[k].take(context[:, k], axis=0)
        return np.tanh(h, out=h)

    def scores(self, h: np.ndarray) -> np.ndarray:
        """What the softmax is taken of; shifted where its exponentials could overflow."""
        z = _product(h, self.out)
        z += self.out_bias
        if np.abs(self.out).sum(axis=0).max() + np.abs(self.out_bias).max() > 80:
            z -= z.max(axis=1, keepdims=True)
        return z

    def log_prob(self, context: np.ndarray, middle: np.ndarray) -> np.ndarray:
        """log P(class of the middle | neighbours), for contexts [window, place]."""
        z = self.scores(self.hidden(context))
        own = z[np.arange(len(middle)), middle]
        np.exp(z, out=z)
        return own - np.log(z.sum(axis=1))

    def gradients(self, context: np.ndarray, middle: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], list[np.ndarray]]:
        """The classes' sums and the middles' scores, from which the loss follows, and the gradients of its mean over the windows."""
        n, h = len(middle), self.hidden(context)
        e = self.scores(h)
        own = e[np.arange(n), middle]
        np.exp(e, out=e)
        total = e.sum(axis=1)
        e *= (1 / (total * n))[:, None]
        e[np.arange(n), middle] -= 1 / n
        dh = _product(e, self.out.T)
        dh *= 1 - h * h
        row = (context + CLASSES * np.arange(2 * SIDE, dtype=np.uint16)).ravel("F")  # of all embeddings, one under another
        order = np.argsort(row, kind="stable")
        row = row[order]
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        near = np.zeros_like(self.near).reshape(-1, HIDDEN)
        near[row[first]] = np.add.reduceat(dh.take(order % n, axis=0), first, axis=0)
        return (total, own), [near.reshape(self.near.shape), dh.sum(axis=0), _inner(h, e), e.sum(axis=0)]


def windows(classes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The contexts and the middles of all words of texts that are given as one byte a word."""
    edge = bytes(SIDE)
    flat = np.frombuffer(b"".join(x for own in classes for x in (edge, own)) + edge, np.uint8)
    starts = np.cumsum([0, *(len(own) + SIDE for own in classes)])
    inner = np.ones(len(flat), bool)
    for k in range(SIDE):
        inner[starts + k] = False
    place = np.flatnonzero(inner)
    return np.stack([flat[place + d] for d in (*range(-SIDE, 0), *range(1, SIDE + 1))], axis=1), flat[place]


def trained(net: Network, classes: list[bytes], rate: float = RATE) -> tuple[Network, int]:
    """Mini-batches of Adagrad over all windows of the texts; the number of windows."""
    own = [c for c in classes if c]
    n = sum(map(len, own))
    steps, done = max(LEAST_STEPS, n // BATCH) if n else 0, 0
    squares = [np.full_like(w, 1e-6) for w in net.weights()]
    while done < steps:
        for at in range(0, len(own), 512):
            context, middle = windows(own[at : at + 512])
            order = np.random.default_rng(at).permutation(len(middle))
            for k in range(0, len(order), BATCH):
                some = order[k : k + BATCH]
                _, grads = net.gradients(context[some], middle[some])
                done += 1
                for w, g, v in zip(net.weights(), grads, squares, strict=True):
                    v += g * g
                    g *= rate
                    g /= np.sqrt(v)
                    w -= g
    return net, n


def _averaged(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for all weights of a partition: their mean, by the number of windows."""
    total, n = None, 0
    for part in parts:
        for data, own in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            w = np.frombuffer(data, "<f4").astype(np.float64) * own
            total, n = w if total is None else total + w, n + own
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([(total / n).astype("<f4").tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["weights", "n"])


def train(rows: DataFrame, sizes: np.ndarray) -> Network:
    """The network of all windows of ``rows`` (classes); no more than 64 tasks' weights meet in one place."""
    schema = "weights binary, n long"

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [c for part in parts for c in part.column(0).to_pylist()]  # a byte a word
        net, n = trained(Network.start(sizes), own)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(w.astype("<f4").tobytes() for w in net.weights())], pa.binary()), pa.array([n], pa.int64())], names=["weights", "n"])

    found = saved(rows.select("classes").mapInArrow(run, schema), "lm-weights")
    while (count := found.count()) > 64:
        found = saved(found.repartition(-(-count // 64)).mapInArrow(_averaged, schema), "lm-weights")
    net = Network.start()
    last = list(_averaged(iter(found.toArrow().to_batches())))
    flat, at = np.frombuffer(last[0].column(0)[0].as_py(), "<f4") if last else None, 0
    for w in net.weights():
        w[...] = 0 if flat is None else flat[at : at + w.size].reshape(w.shape)
        at += w.size
    return net


@dataclass
class Scorer:
    """The trained model: the table of words, and what is sent to the tasks, of bounded size."""

    words: DataFrame
    frequent: list[bytes]
    sizes: np.ndarray
    head: dict[bytes, int]
    net: Network | None = None


def counted(docs: DataFrame) -> Scorer:
    """The model without its network: what is counted over all documents."""
    words = saved(word_counts(docs), "lm-words")
    frequent = [bytes(r.word) for r in words.orderBy(F.desc("n"), "word").limit(FREQUENT).collect()]
    top = most_frequent(words.where(F.octet_length("word") <= KEPT_BYTES), "n", HEAD).toArrow()
    head = dict(zip(map(bytes, top["word"].to_pylist()), top["n"].to_pylist(), strict=True))
    return Scorer(words, frequent, class_sizes(words, frequent), head)


def classified(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """(row, doc_id, classes, known, words, times): a byte for each word, the sum of log n of the head's words, and the other words."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast((scorer.frequent, scorer.head))

    def make():
        frequent, head = sent.value
        table = class_table(frequent)

        def run(ids: list, texts: list) -> list[list]:
            classes, known, words, times, rows = [], [], [], [], [np.zeros(1, np.int64)]
            for distinct, codes, sizes in numbered(texts):
                kinds = np.fromiter(map(table.__getitem__, distinct), np.uint8, len(distinct))[codes]
                n = np.fromiter((head.get(w, 0) for w in distinct), np.int64, len(distinct))
                log_n, rest = np.log(np.maximum(n, 1))[codes], n[codes] == 0
                ends = np.cumsum([0, *sizes])
                sums = np.concatenate([[0.0], np.cumsum(log_n)])
                classes += [kinds[a:b].tobytes() for a, b in zip(ends.tolist(), ends[1:].tolist())]
                known += (sums[ends[1:]] - sums[ends[:-1]]).tolist()
                text, width = np.repeat(np.arange(len(sizes)), sizes)[rest], max(1, len(distinct))
                pairs, count = np.unique(text * width + codes[rest], return_counts=True)
                text, other = np.divmod(pairs, width)
                rows.append(rows[-1][-1] + np.searchsorted(text, np.arange(1, len(sizes) + 1)))
                words.append(pa.array(distinct, pa.binary()).take(pa.array(other)))
                times.append(count)
            ends = np.concatenate(rows)
            return [ids, classes, known, lists(pa.concat_arrays(words), ends), lists(pa.array(np.concatenate(times)), ends)]

        return run

    found = map_columns(docs.select("doc_id", utf8("text")), make, f"doc_id {kind}, classes binary, known double, words array<binary>, times array<long>", rows_at_once=None)
    return saved(found.withColumn("row", F.monotonically_increasing_id()), "lm-classes")  # written, so a row keeps its number


def fit(docs: DataFrame) -> tuple[Scorer, DataFrame]:
    """The model of all documents, and the documents as classes, which ``score`` can take again."""
    scorer = counted(docs)
    rows = classified(docs, scorer)
    scorer.net = train(rows, scorer.sizes)
    return scorer, rows


def score(rows: DataFrame, scorer: Scorer) -> DataFrame:
    """(doc_id, n_tokens, log_prob, mean_log_prob, class_log_prob, mean_word_log_prob) of classified documents."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    sent = rows.sparkSession.sparkContext.broadcast((scorer.net, np.log(scorer.sizes + 1.0)))

    def make():
        net, log_size = sent.value

        def run(keys: list, ids: list, classes: list, known: list) -> list[list]:
            size = np.array([len(c) for c in classes])
            by_class, within = np.zeros(len(keys)), np.array(known, np.float64)
            for at in range(0, len(classes), 256):
                context, middle = windows(classes[at : at + 256])
                logp = np.zeros(len(middle) + 1)
                for k in range(0, len(middle), BATCH):
                    own = middle[k : k + BATCH]
                    logp[k + 1 : k + 1 + len(own)] = net.log_prob(context[k : k + BATCH], own)
                ends = np.cumsum([0, *size[at : at + 256]])
                for total, values in ((by_class, logp), (within, np.concatenate([[0.0], -log_size[middle]]))):
                    sums = np.cumsum(values)
                    total[at : at + 256] += sums[ends[1:]] - sums[ends[:-1]]
            return [keys, ids, size, by_class, within]

        return run

    whole = map_columns(rows.select("row", "doc_id", "classes", "known"), make, f"row long, doc_id {kind}, n_tokens long, class_log_prob double, within double")
    pairs = rows.select("row", F.explode(F.arrays_zip("words", "times")).alias("p")).select("row", F.col("p.words").alias("word"), F.col("p.times").alias("times"))
    often = scorer.words.where("n > 1").select("word", F.log("n").alias("log_n"))
    found = pairs.join(often, "word").select("row", (F.col("times") * F.col("log_n")).alias("within"))
    parts = whole.select("row", "within", F.struct("doc_id", "n_tokens", "class_log_prob").alias("one")).unionByName(found, allowMissingColumns=True)
    sums = parts.groupBy("row").agg(F.sum("within").alias("within"), F.first("one", ignorenulls=True).alias("one")).select("one.*", "within")
    n = F.nullif(F.col("n_tokens"), F.lit(0))
    total = F.col("class_log_prob") + F.col("within")
    return sums.select("doc_id", "n_tokens", total.alias("log_prob"), (total / n).alias("mean_log_prob"), "class_log_prob", (F.col("within") / n).alias("mean_word_log_prob"))


def scores(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """The scores of any documents."""
    return score(classified(docs, scorer), scorer)
