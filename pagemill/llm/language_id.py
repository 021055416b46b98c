"""Language ID by a linear-chain conditional random field over words.

A word's features are byte n-grams, affixes (n-grams that touch a word's end, and longer ones on their own), and its
membership in a lexicon of the sample's frequent words. Weights of features and of transitions between labels are
learned together by the likelihood of labelled word sequences, which splice pieces of documents in several languages,
so that switching is learned too. Forward-backward over all of a text's words gives each word's label probabilities;
the text's language is the label with the largest share.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import cut
from .common import small_batches, stored, without

FEATURES = 1 << 16
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: Bounds of the sample that the model is fitted on, for each label: documents; of a longer one, pieces from all over it,
#: and characters of a piece.
SAMPLE_DOCS, PIECES, PIECE_CHARS = 200, 6, 300
LEXICON = 300
#: Words of a part of a chain; parts of all chains of a block are worked on side by side.
PART = 128


def words_of(text: str) -> list[str]:
    """Runs of letters, lower-cased."""
    return WORD.findall(text.lower())


def featured(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all words, one after the other, and where each word's start (and the end)."""
    raw = "".join(f"\x02{w}\x03" for w in words).encode()
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    word = np.cumsum(b == 2) - 1
    found, owner = [], []
    for n in (2, 3, 4, 5, 6):
        size = len(b) - n + 1
        if size <= 0:
            break
        h = np.full(size, n, np.uint32)
        for k in range(n):
            h = h * np.uint32(0x01000193) ^ b[k : k + size]
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        ok = word[:size] == word[n - 1 :]
        if n > 4:  # longer ones only as affixes
            ok &= (b[:size] == 2) | (b[n - 1 :] == 3)
        found.append((h[ok] >> np.uint32(16)) % np.uint32(FEATURES))
        owner.append(word[:size][ok])
    listed = np.array([lexicon.get(w, -1) for w in words], np.int64)
    has = np.flatnonzero(listed >= 0)
    found += [np.zeros(len(words), np.int64) + FEATURES, listed[has] + FEATURES + 1]  # a bias, then the lexicon
    owner += [np.arange(len(words)), has]
    f, o = np.concatenate(found).astype(np.int64), np.concatenate(owner)
    order = np.argsort(o, kind="stable")
    return f[order], np.concatenate(([0], np.cumsum(np.bincount(o, minlength=len(words)))))


def scores(words: list[str], model: dict) -> np.ndarray:
    """A row of label scores for each word: the mean weight of its features."""
    if not words:
        return np.zeros((0, len(model["labels"])))
    f, at = featured(words, model["lexicon"])
    return np.add.reduceat(model["weights"][f], at[:-1], axis=0) / np.diff(at)[:, None]


def marginals(score: np.ndarray, counts: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """Label probabilities of every word of chains that lie one after the other; counts: their words.

    Exact forward-backward: parts of PART words are first reduced to their transfer matrices side by side, the chains
    are then run over parts, and each part is filled in from its known ends.
    """
    n, labels = score.shape
    if not n:
        return score
    emit = np.exp(score - score.max(axis=1, keepdims=True))
    move = np.exp(transition - transition.max())
    parts_of = -(-counts // PART)
    chain = np.repeat(np.arange(len(counts)), parts_of)
    rank = np.arange(len(chain)) - np.repeat(np.cumsum(parts_of) - parts_of, parts_of)
    start = (np.cumsum(counts) - counts)[chain] + rank * PART
    size = np.minimum(counts[chain] - rank * PART, PART)
    p = len(chain)
    grid = np.minimum(start[:, None] + np.arange(PART), n - 1)
    live = np.arange(PART) < size[:, None]
    own = np.where(live[:, :, None], emit[grid], 1.0)  # part, step, label
    opens = rank == 0
    through = np.broadcast_to(np.eye(labels), (p, labels, labels)).copy()
    for t in range(PART):
        step = through @ move
        if t == 0:
            step[opens] = through[opens]
        step *= own[:, t, None, :]
        step /= step.sum(axis=(1, 2), keepdims=True)
        on = live[:, t]
        through[on] = step[on]
    before, after = np.ones((p, labels)), np.ones((p, labels))
    first = np.cumsum(parts_of) - parts_of
    for r in range(1, int(parts_of.max())):
        here = first[parts_of > r] + r
        x = np.einsum("pi,pij->pj", before[here - 1], through[here - 1])
        before[here] = x / x.sum(axis=1, keepdims=True)
    for r in range(1, int(parts_of.max())):
        here = (first + parts_of - 1 - r)[parts_of > r]
        x = np.einsum("pij,pj->pi", through[here + 1], after[here + 1])
        after[here] = x / x.sum(axis=1, keepdims=True)
    ahead = np.empty((p, PART, labels))
    x = before
    for t in range(PART):
        y = x @ move
        if t == 0:
            y[opens] = x[opens]
        y *= own[:, t]
        x = np.where(live[:, t, None], y / y.sum(axis=1, keepdims=True), x)
        ahead[:, t] = x
    x = after
    for t in range(PART - 1, -1, -1):
        ahead[:, t] *= x
        y = (x * own[:, t]) @ move.T
        x = np.where(live[:, t, None], y / y.sum(axis=1, keepdims=True), x)
    out = ahead[live]
    return out / out.sum(axis=1, keepdims=True)


def transitions(alpha: np.ndarray, ahead: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Expected numbers of transitions of chains of one length: alpha and ahead (emissions times beta) by chain, step, label."""
    left, right = alpha[:, :-1], ahead[:, 1:]
    left = left / ((left @ move) * right).sum(axis=2, keepdims=True)
    return np.einsum("bti,btj->ij", left, right) * move


def fit(sample: list[tuple[str, str]], length: int = 64, sequences: int = 1200, rounds: int = 10, rate: float = 0.3, seed: int = 7) -> dict:
    """A model from (label, text) pairs: labels, weights, transition, lexicon.

    Every label with a word in its texts is learned, in the order of names; without a word in any the model has none.
    Equally frequent words enter the lexicon in their own order, and a word of several labels counts once, so that equal
    samples give equal models. More labels than usual get more sequences.
    """
    pools: dict[str, list[str]] = {}
    for label, text in sample:
        pools.setdefault(label, []).extend(words_of(text))
    labels = sorted(k for k, v in pools.items() if v)
    lexicon: dict[str, int] = {}
    for k in labels:
        names, often = np.unique(np.array(pools[k]), return_counts=True)
        for w in names[np.argsort(-often, kind="stable")][:LEXICON].tolist():
            lexicon.setdefault(w, len(lexicon))
    model = {"labels": labels, "lexicon": lexicon, "weights": np.zeros((FEATURES + 1 + len(lexicon), len(labels))), "transition": np.zeros((len(labels), len(labels)))}
    if len(labels) < 2:
        return model
    rng = np.random.default_rng(seed)
    sequences = max(sequences, 60 * len(labels))
    words, gold = [], []
    for _ in range(sequences):  # pieces of 5 words to a whole sequence, each of one label
        line: list[str] = []
        tags: list[int] = []
        while len(line) < length:
            k = int(rng.integers(len(labels)))
            pool = pools[labels[k]]
            n = int(rng.choice([5, 10, 20, length]))
            at = int(rng.integers(max(1, len(pool) - n)))
            piece = pool[at : at + n][: length - len(line)]
            line += piece
            tags += [k] * len(piece)
        words.append(line)
        gold.append(tags)
    weights, transition = model["weights"], model["transition"]
    seen_w, seen_t = np.full(weights.shape, 1e-8), np.full(transition.shape, 1e-8)  # AdaGrad
    tags = np.array(gold)
    batch = 60
    prepared = []
    for lo in range(0, sequences, batch):
        flat = [w for line in words[lo : lo + batch] for w in line]
        prepared.append((*featured(flat, lexicon), tags[lo : lo + batch]))
    for _ in range(rounds):
        for b in rng.permutation(len(prepared)).tolist():
            f, at, y = prepared[b]
            rows, size = len(y), np.diff(at)
            score = (np.add.reduceat(weights[f], at[:-1], axis=0) / size[:, None]).reshape(rows, length, -1)
            emit = np.exp(score - score.max(axis=2, keepdims=True))
            move = np.exp(transition - transition.max())
            alpha, beta = np.empty_like(emit), np.ones_like(emit)
            alpha[:, 0] = emit[:, 0] / emit[:, 0].sum(axis=1, keepdims=True)
            for t in range(1, length):
                x = (alpha[:, t - 1] @ move) * emit[:, t]
                alpha[:, t] = x / x.sum(axis=1, keepdims=True)
            for t in range(length - 2, -1, -1):
                x = (beta[:, t + 1] * emit[:, t + 1]) @ move.T
                beta[:, t] = x / x.sum(axis=1, keepdims=True)
            one = alpha * beta
            one /= one.sum(axis=2, keepdims=True)
            two = transitions(alpha, emit * beta, move)
            hot = np.eye(len(labels))[y]
            slope = ((hot - one).reshape(rows * length, -1)) / size[:, None]
            g = np.zeros_like(weights)
            np.add.at(g, f, np.repeat(slope, size, axis=0))
            g = g / rows - 1e-4 * weights
            seen_w += g * g
            weights += rate * g / np.sqrt(seen_w)
            g = (np.einsum("bti,btj->ij", hot[:, :-1], hot[:, 1:]) - two) / rows - 1e-4 * transition
            seen_t += g * g
            transition += rate * g / np.sqrt(seen_t)
    return model


def sampled(docs: DataFrame, text_col: str, label_col: str, id_col: str) -> list[tuple[str, str]]:
    """(label, text) of at most SAMPLE_DOCS documents of every label, the same for the same rows in any order.

    Documents are chosen by a hash of id and text: of each label those with the smallest. A text of more than PIECES *
    PIECE_CHARS characters gives as many pieces, at places that hashes choose over its whole length. Rows without label
    or text are not used, a null id is an id like any other, repeated rows count once. An empty table gives no pair. The
    driver receives SAMPLE_DOCS * PIECES * PIECE_CHARS characters of a label at most.
    """
    label, text = F.col(label_col), F.col(text_col)
    usable = docs.where(label.isNotNull() & text.isNotNull()).select(label.alias("label"), text.alias("text"), F.xxhash64(F.col(id_col).cast("string"), text).alias("h"))
    known = usable.groupBy("label").agg(F.approx_count_distinct("h").alias("n"))
    share = 1 << 40
    # a label costs the model half a megabyte, which every task holds: its row here is nothing beside that
    few = usable.join(F.broadcast(known), "label").where(F.pmod("h", F.lit(share)) <= F.lit(4.0 * SAMPLE_DOCS * share) / F.col("n"))
    span = F.length("text") - PIECE_CHARS + 1
    pieces = [F.substring(F.col("text"), F.pmod(F.xxhash64(F.col("h"), F.lit(k)), span) + 1, F.lit(PIECE_CHARS)) for k in range(PIECES)]
    whole_words = [F.regexp_replace(x, r"(?s)^\S*\s(.*)\s\S*$", "$1") for x in pieces]
    short = few.select("label", "h", F.when(F.length("text") <= PIECES * PIECE_CHARS, F.col("text")).otherwise(F.concat_ws("\n", *whole_words)).alias("text"))
    once = stored(short.groupBy("label", "h").agg(F.min("text").alias("text")), "sample")  # some 4 * SAMPLE_DOCS rows of a label
    first = once.withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy("h", "text"))).where(F.col("k") <= SAMPLE_DOCS)
    rows = first.orderBy("label", "h", "text").select("label", "text").toArrow()
    return list(zip(*(c.to_pylist() for c in rows.columns)))


def identify(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """The columns of docs, and lang_pred and score (the share of the predicted label in the words' probabilities).

    lang_pred is `und` and score 0 if the text is null or has no letter, or the model has no label. Every word of every
    text counts. Repeated rows are judged each, and null ids carried; an empty table gives an empty result. Columns of
    docs that have an output's name give way to it.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = without(docs, "lang_pred", "score")
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    held = spark.sparkContext.broadcast(model)  # bounded by FEATURES and LEXICON, for each label

    def rows(batches):
        model = held.value
        labels = model["labels"]
        for table in cut(batches, at, (1 << 23) // max(4, len(labels))):
            number: dict[str, int] = {}
            lists = []
            for x in table.column(at):
                found = words_of(x.as_py() or "") if labels else []
                lists.append(np.fromiter((number.setdefault(w, len(number)) for w in found), np.int64, len(found)))
            counts = np.fromiter(map(len, lists), np.int64, len(lists))
            full = np.flatnonzero(counts)
            pred, score = ["und"] * len(lists), np.zeros(len(lists))
            if len(full):
                each = marginals(scores(list(number), model)[np.concatenate(lists)], counts[full], model["transition"])
                share = np.add.reduceat(each, np.cumsum(counts[full]) - counts[full], axis=0) / counts[full][:, None]
                best = share.argmax(axis=1)
                score[full] = np.clip(share[np.arange(len(full)), best], 0, 1)
                for i, k in zip(full.tolist(), best.tolist()):
                    pred[i] = labels[k]
            for b in pa.Table.from_arrays([*table.columns, pa.array(pred, pa.string()), pa.array(score)], names=[f.name for f in schema.fields]).to_batches():
                yield b

    return docs.mapInArrow(rows, schema)
