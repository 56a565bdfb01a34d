"""Operators that score, filter or code each text by itself."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratolog.llm import chat, lm, packing, pieces, quality, toxicity
from stratolog.llm.lattice import BatchLattice, PieceVocab, word_model
from stratolog.llm.shared import kept, trimmed
from stratolog.llm.tokens import WordTokenizer


# quality
def stats(t):
    w = [x for x in re.split("[ \t-\r]+", t or "") if x]
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (t or "").split("\n") if re.search("[^ \t-\r]", x)]
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_of_odd_rows(odd, odd_rows):
    got = quality.quality_verdict(odd.select("doc_id", "text")).collect()
    assert len(got) == len(odd_rows)
    for r in got:
        n = stats(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert not (r.kept and r.base_failed)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\x0b\x1c", max_size=40), max_size=8))
def test_quality_on_random_texts(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality.quality_stats(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == stats(r.text)


def test_quality_filter_keeps_clean_and_columns(spark, sf, odd, empty):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    kept = quality.quality_filter(docs)
    assert kept.columns == docs.columns
    both = quality.quality_verdict(docs).join(labels, "doc_id").filter("not base_failed").select("kept", "quality").collect()
    assert all(r.kept for r in both if r.quality == 1)
    assert sum(not r.kept for r in both if r.quality == 0) >= 0.8 * sum(r.quality == 0 for r in both)
    assert quality.quality_filter(odd).columns == odd.columns and quality.quality_filter(empty).count() == 0


# chat
def log(spark, *rows):
    return spark.createDataFrame(list(rows), "conv_id long, message long, seq long, kind string, role string, text string")


def test_events_fold_to_final_messages(spark):
    e = log(
        spark,
        (1, 1, 1, "delta", "user", "Hel"), (1, 1, 2, "delta", "user", "lo"),
        (1, 2, 3, "delta", "assistant", "bad"), (1, 2, 4, "regenerate", "assistant", ""), (1, 2, 5, "delta", "assistant", "goo"), (1, 2, 6, "delta", "assistant", "d"),
        (1, 1, 7, "edit", "user", "Hi"), (2, 1, 1, "delta", None, None),
    )
    got = {(r.conv_id, r.message): (r.role, r.text) for r in chat.fold_events(e).collect()}
    assert got == {(1, 1): ("user", "Hi"), (1, 2): ("assistant", "good"), (2, 1): ("", "")}
    back = {r.conv_id: ([(t.role, t.text) for t in r.turns], r.loss_text) for r in chat.read_back(chat.render(chat.fold_events(e))).collect()}
    assert back == {1: ([("user", "Hi"), ("assistant", "good")], "good"), 2: ([("", "")], "")}
    assert chat.read_back(chat.render(chat.fold_events(log(spark).limit(0)))).count() == 0


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a: b", "#<\\"]), st.text(alphabet="\\<#:lhc/turn>\n aé", max_size=12)), min_size=1, max_size=6))
def test_rendering_is_reversible(spark, turns):
    e = log(spark, *[(5, i, i, "delta", r, t) for i, (r, t) in enumerate(turns)])
    row = chat.read_back(chat.render(chat.fold_events(e))).first()
    assert [(t.role, t.text) for t in row.turns] == turns
    assert row.loss_text == "".join(t for r, t in turns if r == "assistant")


# toxicity
def test_grammar_tells_clauses_apart():
    g = toxicity.Grammar({"moron": 2.0, "lowei*": 3.0})
    of = lambda t: dict(zip(toxicity.KINDS, g.features(t)))
    assert of("The MORON came. A loweiab!") == {"plain": 5.0, "directed": 0, "negated": 0, "reported": 0, "threat": 0}
    assert of("you are a moron")["directed"] == 2.0 and of("he said moron")["reported"] == 2.0 and of("not a moron")["negated"] == 2.0
    assert sum(of("nothing here; at all").values()) == 0 and sum(of("").values()) == 0
    a = toxicity.Composition(toxicity._negation, toxicity._report)
    s, out = a.step(a.start, toxicity.Symbol("negation"))
    assert a.step(s, toxicity.Symbol("insult"))[1].marks == {"negated"}


def test_targets_direct_from_either_side():
    g = toxicity.Grammar({"moron": 2.0})
    of = lambda t: dict(zip(toxicity.KINDS, g.features(t)))
    for t in ("I will kill you", "hurt them", "you, I will kill", "We shall destroy all of you!"):
        assert of(t)["threat"] == 1.0 and toxicity.UNTAUGHT.score(g.features(t)) >= toxicity.THRESHOLD
    for t in ("kill the process", "Kill the process. You saw it.", "You saw it: kill the process"):
        assert sum(g.features(t)) == 0
    assert of("moron, that is what you are")["directed"] == 2.0 and of("a moron came. You saw it")["plain"] == 2.0


def plain_features(text, insults):
    """The grammar's rules said plainly, clause by clause, for words alone."""
    sums = dict.fromkeys(toxicity.KINDS, 0.0)
    for clause in re.split(r"[.!?;:\n]", text.lower()):
        w = re.findall(r"\w[\w']*", clause)
        targets = [j for j, x in enumerate(w) if x in toxicity.TARGETS]
        best = {}
        for i, x in enumerate(w):
            behind = any(j > i for j in targets)
            directed = any(i - 6 <= j < i for j in targets)
            if x in toxicity.THREATS:
                if directed or behind:
                    best["threat"] = 1.0
            elif x in insults and x not in (*toxicity.REPORTS, *toxicity.NEGATIONS, *toxicity.TARGETS):
                kind = "directed" if directed or behind else "plain"
                if any(y in toxicity.NEGATIONS for y in w[max(0, i - 4) : i]):
                    kind = "negated"
                if any(y in toxicity.REPORTS for y in w[:i]):
                    kind = "reported"
                best[kind] = max(best.get(kind, 0.0), insults[x])
        for k, v in best.items():
            sums[k] += v
    return [sums[k] for k in toxicity.KINDS]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from("you them kill hurt moron clod said not never nor a b c d . ; ,".split()), max_size=40))
def test_grammar_by_plain_rules(words):
    insults = {"moron": 2.0, "clod": 3.5}
    text = " ".join(words)
    assert toxicity.Grammar(insults).features(text) == plain_features(text, insults)
    z = -4.0 + sum(w * min(x, toxicity.MOST) for w, x in zip(toxicity.UNTAUGHT.weights, plain_features(text, insults)))
    assert math.isclose(toxicity.ToxicityModel(insults, -4.0, toxicity.UNTAUGHT.weights).score(toxicity.Grammar(insults).features(text)), 1 / (1 + math.exp(-z)))


def test_toxicity_query_by_plain_rules(spark, sf, texts):
    """The query's scores are those of the plain rules under the model that it learned."""
    model = toxicity.model_for(spark, sf)
    words = {w for _, t in texts for w in re.findall(r"\w[\w']*", t.lower())}
    grammar = toxicity.Grammar(model.insults)
    insults = {w: grammar.weight(w) for w in words if grammar.weight(w)}
    got = {r.doc_id: r for r in toxicity.query(spark, sf).collect()}
    assert len(got) == len(texts)
    for d, t in texts:
        z = model.bias + sum(w * min(x, toxicity.MOST) for w, x in zip(model.weights, plain_features(t, insults)))
        want = 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))
        assert math.isclose(got[d].score, want, rel_tol=1e-9) and got[d].predicted == (want >= 0.3)
        assert got[d].held_out == (zlib.crc32(str(d).encode()) % 4 == 2)


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.query(spark, sf).join(labels, "doc_id").select("held_out", "predicted", "toxic", "score").collect()
    assert docs.count() >= len(got) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out]
    hit = sum(r.predicted and r.toxic for r in held)
    assert hit >= 0.85 * sum(r.toxic for r in held) and hit >= 0.8 * sum(r.predicted for r in held)


def test_threats_count_where_the_sample_has_none(spark):
    model = toxicity.model_for(spark, "/root/testdata/sf0.01")
    score = lambda t: model.score(toxicity.Grammar(model.insults).features(t))
    assert score("I will kill you") >= toxicity.THRESHOLD > score("kill the process") == score("")


def test_toxicity_of_odd_rows(spark, odd, empty, odd_rows):
    labels = spark.createDataFrame([(4, 1), (4, 0), (5, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.learn(odd, labels, F.lit(True))
    scored = toxicity.score_texts(odd, model)
    assert scored.columns == [c for c in odd.columns if c.lower() != "score"] + ["score"] and all(0 <= r[-1] <= 1 for r in scored.collect()) and scored.count() == len(odd_rows)
    assert toxicity.toxicity_filter(odd, model).columns == odd.columns
    assert toxicity.learn(empty, labels, F.lit(True)) == toxicity.UNTAUGHT
    assert toxicity.toxicity_filter(empty, toxicity.UNTAUGHT).count() == 0


# language model
@pytest.fixture(scope="module")
def vocab():
    return PieceVocab.load(public_tokenizers.path(lm.VOCABULARY))


def test_lattice_sums_all_segmentations(vocab):
    m = word_model(vocab)

    def brute(w, first=True):
        total = 0.0
        if not w and not first:
            return math.exp(m.stop)
        if first and "" in m.initial:
            total += math.exp(m.initial[""]) * (brute(w, False) if w else math.exp(m.stop))
        for j in range(1, len(w) + 1):
            p = (m.initial if first else m.further).get(w[:j])
            if p is not None:
                total += math.exp(p) * brute(w[j:], False)
        return total

    for w in ("the", "thing", "ab", "é"):
        assert math.isclose(m.log_probability(w), math.log(brute(w)), rel_tol=1e-9)
    words = ["the", "thing", "日本", "x" * 40, "naïve", "\x01", "a"]
    got = BatchLattice(vocab, [m, m]).log_probabilities(words)
    assert np.allclose(got[:, 1], [m.log_probability(w) for w in words], atol=1e-9)
    i, f, _ = BatchLattice(vocab, [m]).expected(words, 0)
    assert math.isclose(i.sum(), len(words), rel_tol=1e-9)


def test_lm_words_are_those_of_the_pattern():
    texts = [b" A\xff b", None, b"", b"\x1c\xc2\xa0  Q\x0b\x0cz\r\n", b"\t", "ÄA\u2003b".encode()]
    rows, words = lm.words_of(pa.array(texts, pa.binary()).view(pa.string()))
    want = [(k, w.lower()) for k, t in enumerate(texts) for w in re.findall(rb"[^\x20\x09-\x0D]+", t or b"")]
    assert [*zip(rows.tolist(), words.to_pylist())] == want
    assert len(lm.words_of(pa.array([], pa.string()))[1]) == 0


def test_lm_base_score_by_brute_force(spark, sf, texts):
    got = {r.doc_id: r for r in lm.query(spark, sf).collect()}
    c = Counter()
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in texts}
    for d, t in texts:
        if not held[d]:
            c.update([*t.encode().lower().split(), None])
    n, v = sum(c.values()), len(c)
    for d, t in texts:
        w, r = [*t.encode().lower().split(), None], got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(w), sum(c[x] > 0 for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), rel_tol=1e-9)
        assert r.score < 0
    assert len(got) == len(texts)


def segmentations(model, word, at=-1):
    """Probability of word from at on, by walking every segmentation; -1: before the initial piece."""
    if at == len(word):
        return math.exp(model.stop)
    total = 0.0
    if at < 0:
        return sum(math.exp(lp) * segmentations(model, word, len(p)) for p, lp in model.initial.items() if word.startswith(p))
    for end in range(at + 1, len(word) + 1):
        if word[at:end] in model.further:
            total += math.exp(model.further[word[at:end]]) * segmentations(model, word, end)
    if word[at] not in model.further:
        total += math.prod(math.exp(model.of_bytes[b]) for b in word[at].encode()) * segmentations(model, word, at + 1)
    return total


@pytest.mark.parametrize(("classes", "frequent"), [(7, lm.FREQUENT), (1, 3)])
def test_lm_score_by_brute_force(spark, monkeypatch, classes, frequent):
    """Scores equal the sum over classes of the product of the words' sums over all segmentations, wherever words are looked up."""
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    rows = [(1, "the old cat sat on the mat", "en"), (2, "the cat and the dog", "en"), (3, "le chat est sur la table", "fr"), (4, "le chien et le chat", "fr"), (5, "ein hund", "de"), (11, "THE unseen dogcat le 木", "fr"), (12, "", "en"), (13, None, None), (14, "catcat catcat", "de")]
    held = {11, 12, 14}
    models, fit = [], lm.fit_pieces
    monkeypatch.setattr(lm, "fit_pieces", lambda *a, **k: models.append(fit(*a, **k)) or models[-1])
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in lm.score_texts(df, F.col("doc_id").isin(*held), F.col("lang"), classes=classes).collect()}
    split = lambda t: (t or "").lower().split()
    names = sorted({g or "" for d, _, g in rows if d not in held}, key=lambda g: (-sum((x or "") == g and d not in held for d, _, x in rows), g))[:classes]
    of = {d: names.index(g or "") if (g or "") in names else len(names) for d, _, g in rows}
    k = len(names) + 1
    c = [Counter(w for d, t, _ in rows if d not in held and of[d] == z for w in split(t)) for z in range(k)]
    texts = [sum(of[d] == z for d, _, _ in rows if d not in held) for z in range(k)]
    every = sum(c, Counter())

    def discount(x):
        n = Counter(x.values())
        return n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5

    types = sum(len(x) for x in c)

    def word(w, z):
        sub = sum(len(x) / types * segmentations(m, w) for x, m in zip(c, models[0]))
        m, n = sum(every.values()), sum(c[z].values()) + texts[z]
        q = max(every[w] - discount(every), 0) / m + discount(every) * len(every) / m * sub
        return max(c[z][w] - discount(c[z]), 0) / n + discount(c[z]) * len(c[z]) / n * q if c[z] else q / (n + 1)

    for d, t, _ in rows:
        want = sum(texts[z] / sum(texts) * math.prod(word(w, z) for w in split(t)) * texts[z] / (sum(c[z].values()) + texts[z]) for z in range(k) if texts[z])
        assert abs(got[d].score - math.log10(want)) < 1e-9 * max(1, abs(got[d].score)), (d, got[d].score, math.log10(want))


def test_lm_scores_held_out_texts_well(spark):
    """Above the base, which gives no probability to how an unknown word is spelled, once there are words to learn from."""
    s = lm.query(spark, "/root/testdata/sf0.1").filter("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert s[0] / s[2] > s[1] / s[2]


def test_lm_of_odd_rows(odd, empty, odd_rows):
    got = lm.score_texts(odd, F.col("doc_id") == 9, F.col("lang")).collect()
    assert len(got) == len(odd_rows) and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in got)
    assert lm.score_texts(odd, F.lit(True)).count() == len(odd_rows)
    assert lm.score_texts(empty, F.lit(False)).count() == 0


# pieces
def test_pieces_are_lossless_and_reproducible(odd, odd_rows, empty):
    coded = pieces.encode(odd)
    assert coded.columns == [c for c in odd.columns if c != "ids"] + ["ids"]
    coded = coded.select("doc_id", "text", "ids", "`a b`")
    first = {r.doc_id: (r.text, r.ids) for r in coded.collect()}
    again = {r.doc_id: (r.text, r.ids) for r in pieces.encode(odd.select("doc_id", "text").repartition(1)).collect()}
    assert first == again
    for r in pieces.decode(coded).collect():
        assert r.decoded == (r.text or "") and bool(r.ids) == bool(r.text)
    assert pieces.encode(empty.select("doc_id", "text")).count() == 0


def test_pieces_query_by_single_draws(spark, sf, texts):
    """Each chunk drawn by itself in log space; the vocabulary's own pieces give the text back."""
    s = pieces.Sampler(public_tokenizers.path(pieces.VOCABULARY))
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.VOCABULARY))
    got = {r.doc_id: r for r in pieces.query(spark, sf).collect()}
    assert len(got) == len(texts)
    for d, t in texts[:60]:
        first = int(pieces.mix(np.array([d], np.uint64))[0])
        seeds = pieces.mix(np.array([first + k * int(pieces._STEP) & (1 << 64) - 1 for k in range(len(s._split(t)) if t else 0)], np.uint64))
        ids = [x for chunk, seed in zip(s._split(t) if t else [], seeds.tolist()) for x in s._draw_one(chunk, seed)]
        back = b"".join(bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace("▁", " ").encode() for i in ids)[1:]
        r = got[d]
        assert back.decode() == t and r.lossless and r.n_bytes == len(t.encode())
        assert (r.n_pieces, r.ids_crc32, r.decoded_sha256) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), hashlib.sha256(t.encode()).hexdigest())


def test_pieces_are_drawn_by_weight():
    s = pieces.Sampler(public_tokenizers.path(pieces.VOCABULARY))
    word, p = "▁this", {}

    def walk(j, ids, w):
        if j == len(word):
            p[tuple(ids)] = math.exp(w)
        for k in range(j + 1, len(word) + 1):
            if word[j:k] in s.log_w:
                walk(k, [*ids, s.names[word[j:k]]], w + s.log_w[word[j:k]])

    walk(0, [], 0.0)
    total, n = sum(p.values()), 4000
    ids, size = s.encode(["this"] * n, list(range(n)))
    got = Counter(tuple(x.tolist()) for x in np.split(ids, np.cumsum(size)[:-1]))
    for k, v in p.items():
        assert abs(got[k] / n - v / total) < 0.03
    assert s._draw_one("▁this", 12345) in [list(k) for k in p]


# tokens and packing
@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("abcXYZ '\"12½ \n\t.,!?éÀßİŉ<|>\x1c\x85\xa0ﬁ日́"), st.characters(exclude_categories=["Cs"])), max_size=30), max_size=5))
def test_cached_tokens_equal_the_library(library, texts):
    ids, n = library.encode(texts)
    for t, own in zip(texts, np.split(ids, np.cumsum(n)[:-1]) if len(n) else []):
        assert own.tolist() == library.library.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["aƁb xƝ", "it's 's's'll \"'s 5'd 'sam'", "ÉTÉ'S ½½²a", "''re'vex l'l"])
def test_parts_are_those_of_the_pattern(library, text):
    """Letters whose small forms lie beyond the table are letters still; contractions count outside signs only."""
    ids, n = library.encode(["", text, text + "<|endoftext|>", text])
    for t, own in zip(["", text, text + "<|endoftext|>", text], np.split(ids, np.cumsum(n)[:-1])):
        assert own.tolist() == library.library.encode(t, add_special_tokens=False).ids


def test_workers_let_the_tokenizer_go_after_coding(spark, sf):
    """Python workers live on, and the stages behind packing's first one need the room."""
    import gc

    def look(batches):
        for _ in batches:
            pass
        yield pa.RecordBatch.from_arrays([pa.array([sum(isinstance(x, WordTokenizer) for x in gc.get_objects())])], ["n"])

    packing.pack(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").repartition(4)).collect()
    assert {r.n for r in spark.range(0, 8, 1, 4).mapInArrow(trimmed(look), "n long").collect()} == {0}


def test_a_step_keeps_its_own_from_task_to_task():
    made = []
    task = trimmed(lambda _: iter([kept("coding", "x", lambda: made.append(1))]), "coding")
    [*task([]), *task([])]
    assert len(made) == 1
    [*trimmed(lambda _: iter([]))([]), *task([])]
    assert len(made) == 2


def test_a_word_is_looked_up_once_a_call():
    class Counted(dict):
        asked = 0

        def get(self, *key):
            Counted.asked += 1
            return dict.get(self, *key)

    tokens = WordTokenizer(public_tokenizers.path(packing.VOCABULARY))
    tokens.encode(["one two"])
    tokens.index = Counted(tokens.index)
    ids, n = tokens.encode(["one two two"] * 1000)
    assert n.tolist() == [3] * 1000 and len(ids) == 3000 and Counted.asked <= 4


@pytest.fixture(scope="module")
def library():
    return WordTokenizer(public_tokenizers.path(packing.VOCABULARY), held=50)


def check_pieces(rows, ids_of):
    """Each document's ids lie in one piece each, sequences have no gap, and little is padded."""
    docs, seqs = {}, {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for d, own in docs.items():
        at, ids = 0, np.array(ids_of[d], np.uint32)
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].astype("<u4").tobytes())
            at += r.length
        assert at == len(ids)
    sizes = []
    for own in seqs.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        sizes.append(at)
    assert set(docs) == set(ids_of) and max(sizes) <= 2048
    assert all(n & (n - 1) == 0 for n in sizes)


def test_packing_of_documents(spark, sf, texts, library):
    ids = {d: [*library.library.encode(t, add_special_tokens=False).ids, 1] for d, t in texts}
    check_pieces(packing.query(spark, sf).collect(), ids)


def test_packing_of_odd_rows(odd, empty, odd_rows, library):
    rows = odd.filter("doc_id is not null").dropDuplicates(["doc_id"])
    ids = {r.doc_id: [*library.library.encode(r.text or "", add_special_tokens=False).ids, 1] for r in rows.collect()}
    check_pieces(packing.pack(rows).collect(), ids)
    assert sum(r.length for r in packing.pack(odd).collect() if r.doc_id == 5) == 3 * len(ids[5])
    assert packing.pack(empty).count() == 0


def test_neighbours_are_lexical():
    a, b = np.arange(100, 160, dtype=np.uint32), np.arange(500, 560, dtype=np.uint32)
    index = packing.ShardIndex([a, b, a[:50], b[:50], np.arange(900, 930, dtype=np.uint32)])
    unused = np.ones(5, bool)
    unused[0] = False
    assert index.neighbours(0, unused).tolist() == [2] and index.neighbours(1, np.array([1, 0, 1, 1, 1], bool)).tolist() == [3]


@pytest.mark.parametrize("shard", [packing.SHARD_TOKENS, 6000])
def test_packing_joins_related_documents_of_all_partitions(spark, monkeypatch, library, shard):
    """Two texts of one topic fill a window, and lie in different partitions."""
    one = shard == packing.SHARD_TOKENS
    monkeypatch.setattr(packing, "SHARD_TOKENS", shard)
    rnd = random.Random(4)
    words = sorted(w[:-4] for w in library.library.get_vocab() if re.fullmatch("[a-z]{5,7}</w>", w))[:2000]
    topics = [rnd.sample(words, 60) for _ in range(60)]
    rows = [(100 * half + k, " ".join(rnd.choice(t) for _ in range(255))) for half in (0, 1) for k, t in enumerate(topics)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def together(df):
        of = {}
        for r in packing.pack(df, window=512).collect():
            of.setdefault(r.doc_id, set()).add(r.sequence_id)
        return {k for k in range(60) if of[k] & of[100 + k]}

    parts = docs.filter("doc_id < 100").coalesce(1).unionAll(docs.filter("doc_id >= 100").coalesce(1))
    got = together(parts)
    assert len(got) >= (54 if one else 45)
    if one:  # a leaf too large for a shard is salted by row
        assert together(docs.repartition(5)) == got


def test_shards_are_bounded():
    first, parts = packing.shard_plan(np.array([3, 4, 5, 25, 1, 9, 2]), 10)
    assert first.tolist() == [0, 0, 1, 2, 5, 5, 6] and parts.tolist() == [1, 1, 1, 3, 1, 1, 1]
    a, b = np.arange(100, 160, dtype=np.uint32), np.arange(500, 560, dtype=np.uint32)
    df = np.full(600, 3)
    df[100:160] = 900
    # a term of most texts of the corpus counts little, though few of the shard hold it
    index = packing.ShardIndex([np.concatenate((a, b[:2])), a[:50], b[:2], b[30:]], packing.Corpus(1000, 60.0, df))
    assert index.neighbours(0, np.array([0, 1, 1, 1], bool)).tolist()[0] == 2
