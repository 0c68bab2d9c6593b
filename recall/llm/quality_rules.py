"""Quality rules: counts over the whole text, and a linear-chain CRF over its lines.

Each line is content or boilerplate. Its features (share of symbols, capitals, repeated words,
a line seen before, and so on) give it a score, neighbouring labels a transition score, and Viterbi
decoding finds the best labelling of the whole text. The share of characters in
content lines decides: a document with less than ``CONTENT_SHARE`` of them goes.

The weights are fitted by maximum likelihood (forward-backward) on the lines of at most ``SAMPLE`` labelled documents
outside fold 0, drawn by a hash of the id: as many whole ones, in the hashes' order, as have ``SAMPLE_LINES`` lines together. A
document's quality label counts for all its lines. As labelled documents are all content or all boilerplate, the switches between
the two are learnt from mixtures: into every other good document a run of lines of a bad one is
spliced, at its beginning, end or anywhere between. Only line features reach the driver, two bytes a line, never texts.

Defined cases: a null text has no words and fails the base rules, as does any text under ten words;
without labelled rows all lines are content; ids and labels that are null are not learnt from; repeated rows
are judged alike; of several texts of a sampled id the smallest is learnt from; an empty table gives an empty result; further
columns, whatever their names, are carried along. Very long texts: all lines of one text are held at once, none is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recall.llm.rows import label_sample, written

SAMPLE = 4000
SAMPLE_LINES = 1 << 20
GROUP_LINES = 1 << 20
PIECE_LINES = 1024  # a longer text is fitted in pieces: all its lines, without the steps between the pieces
SEED = 11
CONTENT_SHARE = 0.5
STEPS = 150
RATE = 0.2
RIDGE = 1e-3
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
FEATURES = ("bias", "some symbols", "many symbols", "bars", "exclamations", "capitals", "repeats", "few distinct words",
            "seen before", "one or two words", "sentence end", "short words", "long words", "digits", "link", "blank")


def raw_words(text: str) -> list[bytes]:
    """Words between blanks, tabs and line ends (not between other Unicode spaces)."""
    return text.encode("utf-8", "surrogatepass").split()


def repeated_words(words: list[bytes]) -> int:
    """Words covered by ``WINDOW``-word windows that occur at least twice."""
    if len(words) <= WINDOW:
        return 0
    known: dict[bytes, int] = {}
    one = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    if len(known) == len(words):
        return 0

    def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.unique(a * (len(words) + 1) + b, return_inverse=True)[1]

    two = joined(one[:-1], one[1:])
    four = joined(two[:-2], two[2:])
    _, five, count = np.unique(four[:-1] * (len(words) + 1) + one[4:], return_inverse=True, return_counts=True)
    starts = np.flatnonzero(count[five] > 1)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    return int((np.cumsum(edge) > 0).sum())


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = raw_words(text)
    seen: set[str] = set()
    repeats = 0
    for line in text.split("\n"):
        if line in seen:
            repeats += bool(line.strip(SPACES))
        seen.add(line)
    return (len(words), len(text) - sum(text.count(c) for c in SPACES), sum(text.count(c) for c in SYMBOLS),
            repeats, repeated_words(words))


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 10 or 100 * n_repeat_words > 20 * n_words


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Features (lines, len(FEATURES)) as 0 or 1, and each line's characters in words."""
    rows, sizes, seen = [], [], set()
    for line in (text or "").split("\n"):
        raw = line.encode("utf-8", "surrogatepass")
        words = raw.split()
        size, n = sum(map(len, words)), len(words)
        symbols = sum(raw.count(c) for c in (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">"))
        upper = len(raw) - len(raw.translate(None, UPPER))
        lower = len(raw) - len(raw.translate(None, LOWER))
        digits = len(raw) - len(raw.translate(None, DIGITS))
        repeats = sum(a == b for a, b in zip(words, words[1:]))
        last = raw.rstrip()[-1:]
        rows.append((
            True, symbols * 50 > size, symbols * 10 > size, symbols > 0 and raw.count(b"|") * 4 >= n, raw.count(b"!") * 4 > n,
            upper > lower, repeats * 4 > n, n >= 8 and len(set(words)) * 3 < n, line in seen and n > 0, 0 < n < 3,
            last in (b".", b"?"), n > 0 and size < 3 * n, size > 12 * n, digits * 5 > size, b"://" in raw or b"www." in raw, n == 0))
        sizes.append(size)
        if n:
            seen.add(line)
    return np.array(rows, np.float64).reshape(-1, len(FEATURES)), np.array(sizes, np.int64)


UPPER, LOWER, DIGITS = (bytes(range(a, b + 1)) for a, b in ((65, 90), (97, 122), (48, 57)))


@dataclass
class Chain:
    """Label 1 is boilerplate. ``weights``: its score by feature; ``steps[a, b]``: from label a to b."""
    weights: np.ndarray
    steps: np.ndarray

    def boilerplate(self, features: np.ndarray) -> np.ndarray:
        """The best labelling of one text's lines (Viterbi); of equals the one with more content."""
        own = features @ self.weights
        (s00, s01), (s10, s11) = self.steps.tolist()
        content, boiler = 0.0, float(own[0])
        back = []
        for x in own[1:].tolist():
            a, b = content + s00, boiler + s10
            c, d = content + s01, boiler + s11
            back.append((a < b, c < d))
            content, boiler = max(a, b), max(c, d) + x
        labels = [boiler > content]
        for came in reversed(back):
            labels.append(came[labels[-1]])
        return np.array(labels[::-1], bool)


def content_share(chain: Chain, text: str | None) -> float:
    features, sizes = line_features(text)
    if not sizes.sum():
        return 0.0
    return float(sizes[~chain.boilerplate(features)].sum() / sizes.sum())


def line_codes(features: np.ndarray) -> np.ndarray:
    """Each line's features as the bits of one number, the first feature highest."""
    return np.packbits(features.astype(bool), axis=1).view(">u2").ravel().astype(np.uint16)


CODES = 1 << 16  # len(FEATURES) bits


def groups_of(texts: list[np.ndarray], y) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Texts (line codes), longest first, in groups of about ``GROUP_LINES`` lines: (codes, ends, labels).

    ``y``: each text's label, or its lines' labels. A group's codes and labels are all first lines, then all second lines, and so on;
    position ``p`` is ``codes[ends[p]:ends[p + 1]]``, the first so many of the group's texts, so nothing is padded.
    """
    lines = [np.broadcast_to(label, len(t)).astype(bool) for label, t in zip(y, texts)]
    order = np.argsort([-len(t) for t in texts], kind="stable")
    lengths = np.array([len(texts[i]) for i in order])
    number = (np.cumsum(lengths) - lengths) // GROUP_LINES
    out = []
    for own in np.split(np.arange(len(order)), np.flatnonzero(np.diff(number)) + 1):
        position = np.concatenate([np.arange(n) for n in lengths[own]])
        by_position = np.argsort(position, kind="stable")
        codes, labels = (np.concatenate([x[i] for i in order[own]])[by_position] for x in (texts, lines))
        out.append((codes, np.concatenate([[0], np.cumsum(np.bincount(position))]), labels))
    return out


def lines_before(ends: np.ndarray) -> np.ndarray:
    """For each line after the texts' first ones, the place of the line before it."""
    live = np.diff(ends)
    return np.arange(ends[1], ends[-1]) - np.repeat(live[:-1], live[1:])


def mixtures(texts: list[np.ndarray], y: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Texts with runs of boilerplate lines spliced in, and their lines' labels: one for every other text of content."""
    rng = np.random.default_rng(SEED)
    good, bad = [t for t, label in zip(texts, y) if not label], [t for t, label in zip(texts, y) if label]
    out, labels = [], []
    for i, t in enumerate(good[::2] if bad else []):
        junk = bad[i % len(bad)]
        first = rng.integers(0, len(junk))
        run = junk[first:first + rng.integers(1, len(junk) - first + 1)]
        at = int(rng.choice([0, len(t), rng.integers(0, len(t) + 1)]))
        out.append(np.concatenate([t[:at], run, t[at:]]))
        labels.append(np.concatenate([np.zeros(at), np.ones(len(run)), np.zeros(len(t) - at)]))
    return out, labels


def pieces(texts: list[np.ndarray], labels: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    cut = [(t[a:a + PIECE_LINES], label[a:a + PIECE_LINES]) for t, label in zip(texts, labels) for a in range(0, len(t), PIECE_LINES)]
    return [t for t, _ in cut], [label for _, label in cut]


def expected(own: np.ndarray, steps: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each line's probability of label 1, and the expected number of steps from label to label, by forward-backward.

    ``own``: the lines' scores in the order of ``groups_of``. Messages are log odds of label 1 against 0.
    """
    (s00, s01), (s10, s11) = steps
    forward, ahead = own.copy(), own.copy()  # what the lines up to one say of it; what those from one on say of it
    cuts = ends.tolist()
    for a, b, c in zip(cuts, cuts[1:], cuts[2:]):
        before = forward[a:a + c - b]
        forward[b:c] += np.logaddexp(s01, before + s11) - np.logaddexp(s00, before + s10)
    for a, b, c in reversed(list(zip(cuts, cuts[1:], cuts[2:]))):
        after = ahead[b:c]
        ahead[a:a + c - b] += np.logaddexp(s10, after + s11) - np.logaddexp(s00, after + s01)
    share = 1 / (1 + np.exp(-np.clip(forward + ahead - own, -500, 500)))
    f, g = forward[lines_before(ends)], ahead[ends[1]:]
    pairs = np.stack([np.full(len(f), s00), s01 + g, f + s10, f + s11 + g])
    pairs = np.exp(pairs - pairs.max(axis=0)) if len(f) else pairs
    return share, (pairs / pairs.sum(axis=0)).sum(axis=1).reshape(2, 2)


def fit_codes(texts: list[np.ndarray], y) -> Chain:
    """Weights of the highest likelihood for the lines (as codes) of each text being labelled ``y`` (for a text, or for each of its lines)."""
    n_features = len(FEATURES)
    chain = Chain(np.zeros(n_features), np.zeros((2, 2)))
    if len(texts) == 0 or min(np.min(label) for label in y) == max(np.max(label) for label in y):
        chain.weights[0] = -1.0  # no contrast to learn from: all content
        return chain
    groups = groups_of(texts, y)
    used = np.flatnonzero(sum(np.bincount(codes, minlength=CODES) for codes, _, _ in groups))
    bits = np.unpackbits(used.astype(">u2").view(np.uint8).reshape(-1, 2), axis=1)[:, :n_features].astype(np.float64)
    total = sum(len(t) for t in texts)
    moment = [[np.zeros(n_features), np.zeros(n_features)], [np.zeros((2, 2)), np.zeros((2, 2))]]
    for step in range(1, STEPS + 1):
        score = np.zeros(CODES)
        score[used] = bits @ chain.weights
        d_weights, d_steps = np.zeros(n_features), np.zeros((2, 2))
        for codes, ends, own in groups:
            share, steps = expected(score[codes], chain.steps, ends)
            d_weights += np.bincount(codes, own - share, CODES)[used] @ bits
            seen = np.bincount(2 * own[lines_before(ends)] + own[ends[1]:], minlength=4)
            d_steps += seen.reshape(2, 2) - steps
        for value, gradient, (m, v) in ((chain.weights, d_weights / total - RIDGE * chain.weights, moment[0]),
                                        (chain.steps, d_steps / total - RIDGE * chain.steps, moment[1])):
            m += 0.1 * (gradient - m)        # Adam
            v += 0.01 * (gradient ** 2 - v)
            value += RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return chain


def fit(texts: list[np.ndarray], y: np.ndarray) -> Chain:
    """``fit_codes`` of line features."""
    return fit_codes([line_codes(t) for t in texts], y)


def learn(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Chain:
    """The chain fitted on a bounded sample of the labelled rows of ``docs(doc_id, text)``."""
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [line_codes(line_features(t.as_py())[0]).astype("<u2").tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(found, pa.binary())],
                                             names=["doc_id", "label", "lines"])

    ids = F.broadcast(label_sample(labels, "quality", most))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id")
    rows = rows.groupBy("doc_id", "label").agg(F.min("text").alias("text"))  # one row an id, however often it is repeated
    rows = written(rows.mapInArrow(features, "doc_id long, label int, lines binary"), "labelled-lines")
    # At most ``most`` rows; those that fit are collected.
    so_far = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fitting = rows.select("doc_id", F.sum(F.octet_length("lines") / 2).over(so_far).alias("n")).filter(F.col("n") <= SAMPLE_LINES)
    got = rows.join(F.broadcast(fitting.select("doc_id")), "doc_id").toPandas().sort_values("doc_id")
    texts, y = [np.frombuffer(x, "<u2") for x in got["lines"]], 1 - got["label"].to_numpy()
    mixed, labels_ = mixtures(texts, y)
    return fit_codes(*pieces(texts + mixed, [np.full(len(t), label) for t, label in zip(texts, y)] + labels_))


def keeps(chain: Chain, text: str | None, share: float) -> bool:
    counts = base_counts(text)
    return not base_failed(counts[0], counts[4]) and content_share(chain, text) >= share


RESULT = ("at struct<file:string,row:bigint>, doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
          "n_repeat_words long, base_failed boolean, content_share double, kept boolean")


def judge(source: DataFrame, chain: Chain, share: float = CONTENT_SHARE) -> DataFrame:
    """The columns of ``RESULT`` for each row of ``located(docs)``."""
    shared = source.sparkSession.sparkContext.broadcast(chain)
    names = [column.split()[0] for column in RESULT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            out = []
            for text in batch.column("text"):
                counts = base_counts(text.as_py())
                failed = base_failed(counts[0], counts[4])
                content = content_share(model, text.as_py())
                out.append((*counts, failed, content, not failed and content >= share))
            yield pa.RecordBatch.from_arrays([batch.column("at"), batch.column("doc_id"), *[pa.array(c) for c in zip(*out)]], names=names)

    return source.select("at", F.col("doc.doc_id").cast("long").alias("doc_id"), "doc.text").mapInArrow(run, RESULT)


def drop_low_quality(docs: DataFrame, labels: DataFrame, share: float = CONTENT_SHARE) -> DataFrame:
    """``docs`` without the rows that fail the base rules or have too little content; one pass, rows stay where they are."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = shared.value
        for batch in batches:
            yield batch.filter(pa.array([keeps(chain, t.as_py(), share) for t in batch.column("text")], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
