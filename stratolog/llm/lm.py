"""LM scoring: subword lattice likelihood over an existing vocabulary.

A text is its lowered words and one end. A word's lattice has its segmentations into pieces of the
vocabulary, weighted from the vocabulary's scores, and arcs for the whole word where training texts have it;
the forward recursion sums over all of them in log space. A text's probability is marginal over all its
words' segmentations and over the classes of texts that the model mixes (by default one per language of
the training texts), whose weights are their shares. In a class z the weights are

    whole word: (c_z - d_z)+ / N_z,  and all else entered with d_z * V_z / N_z:
    whole word: (c - d)+ / M,        and all else entered with d * V / M:
    pieces under the weights of class k, entered with share_k;      end of text: D_z / N_z

with c counts, N training tokens, M = N - D, D texts, V word types and d the absolute discount, so that what
discounts take from known words enters the pieces. Piece weights start from the vocabulary's scores and are
refitted by EM to the word types of class k. All texts together have probability 1. A text's own class,
language or source is not looked at when it is scored.

Null text is empty and scores P(end). Repeated rows score equally, each in a row of its own. With no
training row only the lattice of the vocabulary's own weights scores, an end counting one half; an empty
table gives an empty one. Columns beside those named are ignored. A word of any length is scored whole.
"""

from __future__ import annotations

import math

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratolog.llm.lattice import BatchLattice, PieceVocab, WordModel, log_sums, refit, word_model
from stratolog.llm.shared import Workspace, gathered, held_out, sliced

VOCABULARY = "piece_bpe_32k.model"
EM_ROUNDS = 3
#: Size of the mixture: classes with a component of their own, besides the component that all others share.
CLASSES = 7
#: At most so many words, the most frequent ones, are looked up in a broadcast and not by a join.
FREQUENT = 200_000
#: Bytes of texts whose words a task counts or looks up at once; a longer text makes a step of its own.
STEP_BYTES = 8 << 20
#: Distinct words whose lattices are worked on at once.
STEP_WORDS = 100_000


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The words of texts with A-Z lowered, and the place of each one's text; null is empty."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    rows, words = pc.list_parent_indices(lists), pc.list_flatten(lists)
    some = pc.greater(pc.binary_length(words), 0)  # white space at an end of a text leaves an empty word there
    return rows.filter(some).to_numpy(), words.filter(some).cast(pa.binary())


def count_words(docs: DataFrame, classes: int) -> DataFrame:
    """(word, n, c0, c1, ...): counts in all texts and in training texts by class; docs has text and class (-1: not for training)."""
    names = ["word", "n", *[f"c{k}" for k in range(classes)]]

    def counted(held):
        words = pa.concat_arrays([w for w, _ in held]).dictionary_encode()
        at = words.indices.to_numpy().astype(np.int64) * (classes + 1) + np.concatenate([c for _, c in held])
        got = np.bincount(at, minlength=len(words.dictionary) * (classes + 1)).reshape(-1, classes + 1)
        return pa.RecordBatch.from_arrays([words.dictionary, pa.array(got.sum(axis=1)), *[pa.array(c) for c in got.T[1:].copy()]], names)

    def count(batches):
        held, size = [], 0
        for b in sliced(batches, "text", STEP_BYTES):
            rows, words = words_of(b["text"])
            held.append((words, b["class"].to_numpy()[rows] + 1))
            size += words.nbytes
            if size > STEP_BYTES:
                yield counted(held)
                held, size = [], 0
        if held:
            yield counted(held)

    parts = docs.select("text", "class").mapInArrow(count, "word binary, n long, " + ", ".join(f"c{k} long" for k in range(classes)))
    return parts.groupBy("word").agg(*[F.sum(c).alias(c) for c in names[1:]])


def _texts(column) -> list[str]:
    return [w.decode("utf-8", "surrogateescape") for w in column.to_pylist()]


def _expect(vocab: PieceVocab, models: list[WordModel]):
    def run(batches):
        lattice = BatchLattice(vocab, models)
        sums: list = [None] * len(models)
        for b in gathered(batches, STEP_WORDS):
            words, counts = _texts(b["word"]), [b[f"c{k}"].to_pylist() for k in range(len(models))]
            for k in range(len(models)):
                own = [w for w, c in zip(words, counts[k]) if c]
                if own:
                    got = (*map(np.asarray, lattice.expected(own, k)), np.array([len(own)], float))
                    sums[k] = got if sums[k] is None else tuple(x + y for x, y in zip(sums[k], got))
        flat = [(k, part, i, v) for k, s in enumerate(sums) if s for part, x in enumerate(s) for i, v in enumerate(x.tolist()) if v]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in flat], t) for j, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.float64()))], ["class", "part", "i", "v"])

    return run


def fit_pieces(words: DataFrame, vocab: PieceVocab, classes: int, rounds: int = EM_ROUNDS) -> list[WordModel]:
    """EM over each class's distinct words; what comes back each round is a row per class and piece."""
    models = [word_model(vocab)] * classes
    initial, further = [*models[0].initial], [*models[0].further]
    for _ in range(rounds):
        got = words.mapInArrow(_expect(vocab, models), "class int, part int, i int, v double").groupBy("class", "part", "i").agg(F.sum("v").alias("v")).toPandas()
        for k in range(classes):
            own = got[got["class"] == k]
            of = [dict(zip(x["i"], x["v"])) for x in (own[own["part"] == p] for p in range(4))]
            if of[3]:
                models[k] = refit(models[k], {initial[i]: v for i, v in of[0].items()}, {further[i]: v for i, v in of[1].items()}, [of[2].get(i, 0.0) for i in range(256)], of[3][0])
        models = [*models]
    return models


def _class_of(docs: DataFrame, by, held, classes: int) -> tuple[DataFrame, int, list[int]]:
    """docs with a class number, -1 where held out; the number of classes; training texts by class."""
    name = F.coalesce(by.cast("string"), F.lit("")) if by is not None else F.lit("")
    counted = docs.withColumn("_name", name).filter(~held).groupBy("_name").count()
    top = [r["_name"] for r in counted.orderBy(F.desc("count"), "_name").limit(classes).collect()]
    total = counted.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    number = F.lit(len(top))
    for k, x in enumerate(top):
        number = F.when(name == x, k).otherwise(number)
    docs = docs.withColumn("class", F.when(held, -1).otherwise(number))
    sizes = {r["class"]: r["count"] for r in docs.filter("class >= 0").groupBy("class").count().collect()} if total else {}
    return docs, len(top) + 1, [sizes.get(k, 0) for k in range(len(top) + 1)]


def score_texts(docs: DataFrame, held, by=None, vocabulary: str | None = None, id: str = "doc_id", text: str = "text", classes: int = CLASSES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each text.

    held is the condition for a row not to be learned from, by an optional column of training classes; the
    `classes` most frequent ones have a component of the mixture each, the others share one.
    """
    spark = docs.sparkSession
    space = Workspace(spark)
    held = F.coalesce(held, F.lit(False))
    docs, k_all, texts_of = _class_of(docs, by, held, classes)
    docs = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"), "class")
    words = space.table(count_words(docs, k_all), "words")
    c_k = [F.col(f"c{k}") for k in range(k_all)]
    sum_of = lambda x: F.coalesce(F.sum(x), F.lit(0))
    is_ = lambda x: x.cast("long")
    every = [sum(c_k, F.lit(0)), *c_k]
    s = words.agg(*[sum_of(f(c)) for c in every for f in (lambda c: c, lambda c: is_(c > 0), lambda c: is_(c == 1), lambda c: is_(c == 2))]).first()
    counts = [s[4 * i : 4 * i + 4] for i in range(k_all + 1)]
    texts = sum(texts_of)
    tokens, types = counts[0][0] + texts, counts[0][1] + (texts > 0)
    below = tokens + 0.1 * (types + 1)
    d = [n1 / (n1 + 2 * n2) if n1 and n2 else 0.5 for _, _, n1, n2 in counts]
    vocab = PieceVocab.load(vocabulary or public_tokenizers.path(VOCABULARY))
    models = fit_pieces(words, vocab, k_all)
    live = [k for k in range(k_all) if texts_of[k]]
    share = np.array([max(counts[k + 1][1], 0) for k in range(k_all)], float)
    share = share / share.sum() if share.sum() else np.full(k_all, 1 / k_all)
    used = live or [0]
    prior = np.log10([texts_of[k] / texts for k in live]) if live else np.zeros(1)
    p_end = np.log10([texts_of[k] / (counts[k + 1][0] + texts_of[k]) for k in live]) if live else np.log10([0.5])
    base_end = math.log10((texts + 0.1) / below)

    log = lambda x: np.log(np.maximum(x, 0), where=np.asarray(x) > 0, out=np.full(np.shape(x), -np.inf))
    m = counts[0][0]
    enter = log(share) + (math.log(d[0] * counts[0][1] / m) if m else 0.0)

    def scores(words: list[str], c: np.ndarray, of: np.ndarray, lattice: BatchLattice) -> tuple[np.ndarray, np.ndarray]:
        """log10 of base and of each used class; c: counts, of: counts by class."""
        inner = lattice.marginal(words, log((c - d[0]) / max(m, 1)), enter)
        out = np.empty((len(c), len(used)))
        for j, k in enumerate(used):
            n = counts[k + 1][0] + texts_of[k]
            if not live:
                out[:, j] = inner + math.log(0.5)
            elif counts[k + 1][0]:
                out[:, j] = log_sums([log((of[:, k] - d[k + 1]) / n), inner + math.log(d[k + 1] * counts[k + 1][1] / n)])
            else:
                out[:, j] = inner + math.log(1 / (n + 1))
        return np.log10((c + 0.1) / below), out / math.log(10)

    lp = [f"lp{j}" for j in range(len(used))]

    def weigh(batches):
        lattice = BatchLattice(vocab, models)
        for b in gathered(batches, STEP_WORDS):
            of = np.column_stack([b[f"c{k}"].to_numpy() for k in range(k_all)])
            base, out = scores(_texts(b["word"]), of.sum(axis=1), of, lattice)
            yield pa.RecordBatch.from_arrays([b["word"], b["n"], pa.array(of.sum(axis=1) > 0), pa.array(base), *[pa.array(x) for x in out.T.copy()]], ["word", "n", "seen", "base", *lp])

    table = space.table(words.mapInArrow(weigh, "word binary, n long, seen boolean, base double, " + ", ".join(f"{x} double" for x in lp)), "weights")
    least = _frequency_bound(table)
    frequent = table.filter(F.col("n") > least).toPandas()
    head = spark.sparkContext.broadcast((pa.array([bytes(w) for w in frequent["word"]], pa.binary()), frequent[["seen", "base", *lp]].to_numpy(float)))
    value_names = ["known", "base", *lp]
    ends = np.array([float(texts > 0), base_end, *p_end])
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.int64(), *[pa.float64()] * len(value_names)]
    names = ["row", "doc_id", "held", "word", "n", *value_names]

    def look_up(batches):
        first, values = head.value
        columns = values.T.copy()
        for b in sliced(batches, "text", STEP_BYTES):
            at, words = words_of(b["text"])
            coded = pa.concat_arrays([first, words]).dictionary_encode()  # so frequent words keep their places
            code = coded.indices.to_numpy()[len(first) :].astype(np.int64)
            fine = code < len(first)
            rows, known = at[fine], code[fine]
            sums = [pa.array(np.bincount(rows, c[known], len(b)) + e) for c, e in zip(columns, ends)]
            keys = pa.array([b" %d" % r for r in b["row"].to_pylist()], pa.binary())  # no word holds a space
            yield pa.RecordBatch.from_arrays([b["row"], b["doc_id"], pc.less(b["class"], 0), keys, pa.array(np.bincount(rows, minlength=len(b)) + 1), *sums], names)
            pairs, n = np.unique(at[~fine].astype(np.int64) * len(coded.dictionary) + code[~fine], return_counts=True)
            for lo in range(0, len(pairs), 100_000):
                row, word = np.divmod(pairs[lo : lo + 100_000], len(coded.dictionary))
                none = [pa.nulls(len(row), t) for t in kinds]
                none[0], none[3], none[4] = b["row"].take(pa.array(row)), coded.dictionary.take(pa.array(word)), pa.array(n[lo : lo + 100_000])
                yield pa.RecordBatch.from_arrays(none, names)

    rows = docs.withColumn("row", F.monotonically_increasing_id()).mapInArrow(look_up, "row long, doc_id long, held boolean, word binary, n long, " + ", ".join(f"{x} double" for x in value_names))
    t = table.select("word", *[F.col(c).cast("double").alias(f"_{c}") for c in ("seen", "base", *lp)])
    n, whole = F.col("n"), F.col("base").isNotNull()
    met = rows.join(t, "word", "left").select("row", "doc_id", "held", "n", *[F.when(whole, F.col(c)).otherwise(n * F.col(f"_{'seen' if c == 'known' else c}")).alias(c) for c in value_names])
    sums = met.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("held").alias("held_out"), *[F.sum(c).alias(c) for c in ("n", *value_names)])
    parts = [F.col(x) + float(p) for x, p in zip(lp, prior)]
    top = F.greatest(*parts) if len(parts) > 1 else parts[0]
    score = top + F.log10(sum((F.pow(F.lit(10.0), x - top) for x in parts), F.lit(0.0)))
    return sums.select("doc_id", "held_out", F.col("n").alias("n_tokens"), F.round("known").cast("long").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), score.alias("score"))


def _frequency_bound(table: DataFrame) -> int:
    """A count that at most FREQUENT words exceed, from the histogram of counts."""
    above, bound = 0, 0
    hist = table.groupBy(F.floor(F.log2("n") * 8).cast("int").alias("level")).count().collect()  # a few hundred levels
    for r in sorted(hist, key=lambda r: -r["level"]):
        above += r["count"]
        if above > FREQUENT:
            bound = math.ceil(2 ** ((r["level"] + 1) / 8))
            break
    return bound


def query(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.schema("doc_id long, text string, lang string").parquet(f"{sf}/documents.parquet")
    return score_texts(docs, held_out(modulus=10, remainder=0), F.col("lang"))
