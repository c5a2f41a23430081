"""Language identification by a linear-chain conditional random field over words.

Every word of a text gets a label, so code-switched text is labelled piece by
piece. A word's features are its affixes and inner n-grams (byte n-grams of the
word with its borders, hashed into a table of ``FEATURES`` weights) and its place
in the languages' lexicons, the most frequent words counted over all training
documents. Transitions are learned with the weights, by forward-backward, on a
bounded sample of labelled documents (``SAMPLE_DOCS`` different texts per language, or all
if it has fewer; of a text longer than ``SAMPLE_BYTES`` a run of its words) from which mixed sequences are put together. A text's language has the
largest sum of word probabilities; the score is its share.

Defined results: a null text or one without a letter is ``und`` with score 0; so is every
text where no language could be learned; training rows with a null language are not used; equal rows are
judged one by one; other columns pass through, those named like the added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perilscope.llm import counts as C
from perilscope.llm import words as W
from perilscope.llm.chain import Blocks
from perilscope.session import materialise

FEATURES = 1 << 18
GRAMS = (2, 3, 4)
SAMPLE_DOCS = 300
SAMPLE_BYTES = 32 << 10
LEXICON = 4000  # words per language
SLICE_BYTES = 512 << 10  # of texts labelled together: features take some hundred times the bytes of new words
SEGMENT = 24  # words of one language in a row, in the mixed training sequences
SEGMENTS = 6
STEPS = 40
PENALTY = 1e-4
UNKNOWN = "und"

_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = _LETTER[65:91] = True
_BEGIN, _END = 1, 2


@dataclass
class Lexicon:
    """Frequent words of all languages: sorted hashes and one feature number per word."""

    hashes: np.ndarray
    feature: np.ndarray

    @classmethod
    def of(cls, tops: list[tuple[np.ndarray, np.ndarray]]) -> Lexicon:
        """The feature tells the language with the largest share and by how many doublings it leads."""
        hashes = np.unique(np.concatenate([h for h, _ in tops])) if tops else np.zeros(0, np.uint64)
        share = np.full((len(hashes), len(tops)), 1e-9)
        for k, (h, n) in enumerate(tops):
            share[np.searchsorted(hashes, h), k] += n / max(n.sum(), 1)
        order = np.sort(share, axis=1)
        lead = np.log2(order[:, -1] / order[:, -2]) if len(tops) > 1 else np.zeros(len(hashes))
        return cls(hashes, share.argmax(axis=1) * 8 + np.clip(lead, 0, 7).astype(np.int64) if len(hashes) else np.zeros(0, np.int64))


@dataclass
class Features:
    """Feature numbers of word types, one after the other, and where each type's begin."""

    number: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, lexicon: Lexicon) -> Features:
        size = ends - starts
        width = size + 2
        first = np.cumsum(width) - width
        text = np.empty(int(width.sum()), dtype=np.uint64)
        text[first], text[first + width - 1] = _BEGIN, _END
        inner = np.ones(len(text), dtype=bool)
        inner[first] = inner[first + width - 1] = False
        text[inner] = data[W.ragged(size, starts)]
        type_ = np.repeat(np.arange(len(starts)), width)
        left = np.repeat(width, width) - (np.arange(len(text)) - first[type_])
        numbers, owners = [], []
        gram = np.zeros(len(text), dtype=np.uint64)
        padded = np.concatenate([text, np.zeros(max(GRAMS), np.uint64)])
        for k in range(max(GRAMS)):
            gram = (gram << np.uint64(8)) | padded[k : k + len(text)]
            if k + 1 in GRAMS:
                at = np.flatnonzero(left > k)
                numbers.append(W.mix(gram[at] + np.uint64((k + 1) << 40)) % np.uint64(FEATURES))
                owners.append(type_[at])
        place = W.known(lexicon.hashes, hashes)
        held = np.flatnonzero(place >= 0)
        numbers.append(W.mix(lexicon.feature[place[held]].astype(np.uint64) + np.uint64(1 << 60)) % np.uint64(FEATURES))
        owners.append(held)
        number, owner = np.concatenate(numbers).astype(np.int64), np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        return cls(number[order], np.searchsorted(owner[order], np.arange(len(starts) + 1)))

    def scores(self, weights: np.ndarray) -> np.ndarray:
        if len(self.first) == 1:
            return np.zeros((0, weights.shape[1]))
        return np.add.reduceat(weights[self.number], self.first[:-1], axis=0)


@dataclass
class Model:
    languages: list[str]
    lexicon: Lexicon
    weights: np.ndarray
    initial: np.ndarray
    transition: np.ndarray  # scores

    def label(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word probabilities of every language, marks of words with a letter, and the rows' bounds."""
        first, type_, types, letter = _types(data, offsets, self.lexicon)
        scores = types.scores(self.weights)
        scores[~letter] = 0
        potential = np.exp(scores - scores.max(axis=1, keepdims=True)).astype(float)
        _, gamma, _, _ = Blocks(first).posteriors(potential[type_], np.exp(self.transition), _softmax(self.initial))
        return gamma, letter[type_], first

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        gamma, letter, first = self.label(data, offsets)
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        n = len(offsets) - 1
        total = np.stack([np.bincount(row, gamma[:, k] * letter, minlength=n) for k in range(len(self.languages))], 1)
        words = np.bincount(row, letter, minlength=n)
        best = total.argmax(axis=1)
        share = np.where(words > 0, total[np.arange(n), best] / np.maximum(words, 1), 0.0)
        has = _has_letter(data, offsets)
        names = [self.languages[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), has.tolist())]
        return names, np.where(has, np.clip(share, 0.0, 1.0), 0.0)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def _types(data: np.ndarray, offsets: np.ndarray, lexicon: Lexicon):
    """Rows' bounds, the type of each word, the features of the types, and which have a letter."""
    data = W.lowered(data)
    starts, ends, first = W.spans(data, offsets, W.ALNUM)
    hashes = W.hashes(data, starts, ends)
    kept, at, type_ = np.unique(hashes, return_index=True, return_inverse=True)
    starts, ends = starts[at], ends[at]
    mark = np.concatenate([[0], np.cumsum(_LETTER[data] | (data > 127))])
    return first, type_, Features.of(data, starts, ends, kept, lexicon), mark[ends] > mark[starts]


def _has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    mark = np.concatenate([[0], np.cumsum(_LETTER[data])])
    has = mark[offsets[1:]] > mark[offsets[:-1]]
    for row in np.flatnonzero(~has).tolist():  # no ASCII letter: look at the rest
        text = data[offsets[row] : offsets[row + 1]].tobytes().decode("utf-8", "replace")
        has[row] = any(c.isalpha() for c in text)
    return has


def fit(texts: list[str], labels: np.ndarray, languages: list[str], lexicon: Lexicon, steps: int = STEPS, seed: int = 3) -> Model:
    """Maximise the penalised log-likelihood of mixed sequences by Adam steps over the whole sample."""
    data, offsets = W.buffer(pa.array(texts, pa.large_string()))
    first, type_, types, letter = _types(data, offsets, lexicon)
    label = np.repeat(labels, np.diff(first))
    # pieces of SEGMENT words, dealt into sequences of SEGMENTS pieces
    size = np.diff(first)
    begins = np.concatenate([np.arange(a, b, SEGMENT) for a, b in zip(first[:-1], first[1:])] or [np.zeros(0, np.int64)]).astype(np.int64)
    row = np.searchsorted(first, begins, side="right") - 1
    lengths = np.minimum(first[row + 1] - begins, SEGMENT)
    order = np.random.default_rng(seed).permutation(len(begins))
    token = W.ragged(lengths[order], begins[order])
    bounds = np.concatenate([[0], np.cumsum(lengths[order])])[np.append(np.arange(0, len(order), SEGMENTS), len(order))]
    type_, label = type_[token], label[token]
    blocks = Blocks(bounds)
    n, m = len(languages), len(types.first) - 1
    truth = np.eye(n)[label]
    opens = bounds[:-1]
    inner = np.ones(len(label), dtype=bool)
    inner[opens] = False
    moves = np.zeros((n, n))
    np.add.at(moves, (label[np.flatnonzero(inner) - 1], label[inner]), 1)
    starts = truth[opens].sum(axis=0)
    parameters = [np.zeros((FEATURES, n)), np.zeros(n), np.zeros((n, n))]
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in parameters]
    owner = np.repeat(np.arange(m), np.diff(types.first))
    total = max(len(label), 1)
    for step in range(1, steps + 1):
        weights, initial, transition = parameters
        scores = types.scores(weights)
        scores[~letter] = 0
        potential = np.exp(scores - scores.max(axis=1, keepdims=True))[type_]
        _, gamma, xi, begun = blocks.posteriors(potential, np.exp(transition), _softmax(initial))
        miss = truth - gamma
        by_type = np.stack([np.bincount(type_, miss[:, k], minlength=m) for k in range(n)], 1)
        by_type[~letter] = 0
        gradient = np.stack([np.bincount(types.number, by_type[owner, k], minlength=FEATURES) for k in range(n)], 1)
        gradients = [gradient / total - PENALTY * weights, (starts - begun) / total, (moves - xi) / total]
        for k, (g, (mean, square)) in enumerate(zip(gradients, state)):
            mean += 0.1 * (g - mean)
            square += 0.02 * (g * g - square)
            move = mean / (1 - 0.9**step) / (np.sqrt(square / (1 - 0.98**step)) + 1e-9)
            parameters[k] = parameters[k] + 0.1 * np.where(g == 0, 0, move)
    return Model(languages, lexicon, parameters[0].astype(np.float32), parameters[1], parameters[2])


def _smallest(hashes: DataFrame, seen: dict[str, int], n: int) -> list[tuple[str, int]]:
    """The ``n`` smallest of each label's different hashes (all if it has fewer), in the order of their low bits."""
    out, times = [], 2
    missing = dict(seen)
    low = F.pmod(F.col("place"), F.lit(1 << 30))
    while missing:
        cut = F.create_map(*[F.lit(x) for l, c in missing.items() for x in (l, times * n * (1 << 30) // c + 1)])
        found: dict[str, list[int]] = {}
        for r in hashes.where(F.col("label").isin(list(missing)) & (low < cut[F.col("label")])).collect():
            found.setdefault(r["label"], []).append(r["place"])
        for label, places in found.items():
            if len(places) >= min(n, missing[label]):
                out += [(label, p) for p in sorted(places, key=lambda p: (p % (1 << 30), p))[:n]]
                del missing[label]
        times *= 2
    return out


def _run(text: str) -> Column:
    """The text, or of one longer than ``SAMPLE_BYTES`` the whole words of a run of at most as many bytes, begun at a hashed place."""
    size = SAMPLE_BYTES // 4  # characters
    begin = F.pmod(F.xxhash64(F.lit("run"), text), F.char_length(text) - size + 1).cast("int") + 1
    run = F.regexp_replace(F.substr(F.col(text), begin, F.lit(size)), r"^\S*\s+|\s+\S*$", "")
    return F.when(F.octet_length(text) <= SAMPLE_BYTES, F.col(text)).otherwise(run)


def train(docs: DataFrame, text: str = "text", label: str = "lang", sample_docs: int = SAMPLE_DOCS) -> Model | None:
    """Learn from all rows given: lexicons from all of them, weights from the sample. None without a label."""
    spark = docs.sparkSession
    docs = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(label).cast("string").alias("label"))
    place = F.xxhash64(F.lit("sample"), "text")
    hashes = materialise(docs.select("label", place.alias("place")).distinct(), "hashes")
    seen = {r["label"]: r["n"] for r in hashes.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(seen)
    if not languages:
        return None
    group = (F.array_position(F.array(*map(F.lit, languages)), F.col("label")) - 1).cast("int")
    n_buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // len(languages))
    counted = C.count_words(docs.select("text", group.alias("group")), "text", "group", n_buckets, W.ALNUM)
    lexicon = Lexicon.of([C.frequent(counted, k, n_buckets, LEXICON)[:2] for k in range(len(languages))])
    drawn = spark.createDataFrame(_smallest(hashes, seen, sample_docs), "label string, place long")
    rows = docs.select("label", place.alias("place"), _run("text").alias("text")).join(F.broadcast(drawn), ["label", "place"])
    rows = rows.groupBy("label", "place").agg(F.min("text").alias("text")).orderBy("label", "text", "place").collect()
    labels = np.array([languages.index(r["label"]) for r in rows], dtype=np.int64)
    return fit([r["text"] for r in rows], labels, languages, lexicon)


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``."""
    docs = docs.drop("lang_pred", "score")
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.let_go()
        for batch, data, offsets in W.batches(stream, text, SLICE_BYTES):
            if shared.value is None:
                names, scores = [UNKNOWN] * len(batch), np.zeros(len(batch))
            elif len(data):
                names, scores = shared.value.predict(data, offsets)
            else:
                names, scores = [UNKNOWN] * len(batch), np.zeros(len(batch))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[f.name for f in schema.fields]
            )

    return docs.mapInArrow(run, schema)
