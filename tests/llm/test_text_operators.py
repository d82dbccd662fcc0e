"""Language ID, toxicity, quality, decontamination and the suffix tree on small tables."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("matchloom.llm.queries")

from matchloom.llm import decontaminate, langid, quality_mil, suffix_tree, toxicity  # noqa: E402
from matchloom.llm.common import bounded_sample, remainder  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.01"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], DOCS)


def edge_rows():
    """Null and empty texts, no letters, a very long text, repeated rows, a null id and a null language."""
    return [(1, None, "en"), (2, "", "en"), (3, "12 34 !!", "en"), (4, "the cat " * 60_000, "en"), (5, "der hund", "de"),
            (5, "der hund", "de"), (None, "the dog", "en"), (6, "le chat", None)]


def crc(i, k):
    return zlib.crc32(str(i).encode()) % k


def test_language_on_held_out_documents(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    out = langid.identify(table.select("doc_id", "text", "lang"), langid.train(table)).where(
        remainder("doc_id", 5) == 0).toPandas()
    assert len(out) > 100 and (out.lang == out.lang_pred).mean() > 0.97


def test_language_mixture_and_edges(spark):
    rng = random.Random(1)
    words = {"aa": ["bebo", "bobe", "bebi", "bibo"], "zz": ["kuzu", "zuku", "zukk", "kkuz"]}
    train = [(i, " ".join(rng.choices(words[lang], k=30)), lang) for i in range(80) for lang in [("aa", "zz")[i % 2]]]
    model = langid.train(docs(spark, train))
    assert model["names"] == ["aa", "zz"]
    mixed = "bebo bobe bebi " * 10 + "kuzu zuku " * 5
    rows = edge_rows() + [(20, mixed, "aa")]
    table = docs(spark, rows).withColumnRenamed("n_chars", "lang_score_").withColumnRenamed("source", "row")
    out = langid.identify(table.select("doc_id", "text"), model).toPandas()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out.itertuples()}
    assert all(by[i].lang_pred == "und" and by[i].lang_score == 0 for i in (1, 2, 3))
    assert by[20].lang_pred == "aa" and abs(by[20].lang_score - 0.75) < 0.05
    kept = langid.filter_stage(docs(spark, train + [(100, "", "aa"), (105, None, "aa")]))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"] and kept.count() == len(train)
    # Nothing to learn from: every text is undetermined; an empty table stays one.
    none = langid.train(docs(spark, [(1, "abc", None)]))
    assert {r.lang_pred for r in langid.identify(docs(spark, rows).select("doc_id", "text"), none).collect()} == {"und"}
    assert langid.filter_stage(docs(spark, [])).count() == 0


def test_sample_is_bounded_and_repeatable(spark):
    table = spark.range(5000)
    first = {r.id for r in bounded_sample(table, "id", 300).collect()}
    assert len(first) == 300 and first == {r.id for r in bounded_sample(table.repartition(7), "id", 300).collect()}


def toxic_table(spark, n=900, seed=2):
    rng = random.Random(seed)
    plain = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "theta"]
    rows, labels = [], []
    for i in range(n):
        text = rng.choices(plain, k=40)
        bad = i % 6 == 0
        if bad:
            text[5] = "you"
            text[7] = rng.choice(["grumbo", "snarfle", "vexaa" + rng.choice("abcdef")])
            text[20] = "snarfle"
        rows.append((i, " ".join(text), "en"))
        labels.append((i, 1, int(bad)))
    return docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


def test_toxicity_learns_its_lexicon(spark):
    table, labels, truth = toxic_table(spark)
    model = toxicity.train(table, labels)
    assert "snarfle$" in model.lexicon and "vexa" in model.lexicon and "alpha$" not in model.lexicon
    out = {r.doc_id: r.toxic_score for r in model.score(table.select("doc_id", "text")).collect()}
    held = [(out[i], t) for i, _, t in truth if crc(i, 3) == 1]
    assert all(s >= 0.7 for s, t in held if t) and all(s < 0.7 for s, t in held if not t)
    veiled = docs(spark, [(5000, "beta alpha you sn@rfl3 gamma", "en"), (5001, "beta alpha gamma theta delta", "en")])
    scored = {r.doc_id: r.toxic_score for r in model.score(veiled.select("doc_id", "text")).collect()}
    assert scored[5000] > scored[5001]
    rows = edge_rows()
    edge = model.score(docs(spark, rows), keep=True)
    assert edge.count() == len(rows) and edge.where("toxic_score between 0 and 1").count() == len(rows)
    assert toxicity.filter_stage(table, labels).count() == 750


def test_toxicity_without_both_classes(spark):
    table = docs(spark, edge_rows())
    for rows, want in [([], 0.0), ([(1, 0, 0), (2, 1, 0)], 0.0), ([(i, 1, 1) for i in range(1, 6)] + [(6, 0, None)], 1.0)]:
        labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
        assert {r.toxic_score for r in toxicity.train(table, labels).score(table.select("doc_id", "text")).collect()} == {want}
    assert toxicity.filter_stage(docs(spark, []), labels).count() == 0


def test_quality_gradient_is_right():
    rng = np.random.default_rng(3)
    x, begin, y = rng.normal(size=(11, len(quality_mil.NAMES))), np.array([0, 3, 4, 9]), np.array([1.0, 0, 1, 0])
    model = quality_mil.Attention(np.zeros(x.shape[1]), np.ones(x.shape[1]))

    def loss():
        logit = model.forward(x, begin)[0]
        return float(np.mean(np.log1p(np.exp(logit)) - y * logit))

    logit, state = model.forward(x, begin)
    grad = model.gradient(state, (1 / (1 + np.exp(-logit)) - y) / len(y))
    for name, value in model.p.items():
        at = (0,) * np.ndim(value)
        kept = np.array(value, copy=True)
        sides = []
        for step in (1e-5, -1e-5):
            moved = kept.copy()
            moved[at] += step
            model.p[name] = moved
            sides.append(loss())
        model.p[name] = kept
        assert abs((sides[0] - sides[1]) / 2e-5 - np.asarray(grad[name])[at]) < 1e-6, name


def test_quality_on_held_out_documents(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality_mil.train(table, labels)
    out = quality_mil.score(table, model).join(labels, "doc_id").where(remainder("doc_id", 5) == 0).toPandas()
    assert ((out.quality_score >= 0.3) == (out.quality == 1)).mean() > 0.95
    rows = edge_rows()
    edge = quality_mil.score(docs(spark, rows).select("doc_id", "text"), model)
    assert edge.count() == len(rows) and edge.where("quality_score between 0 and 1").count() == len(rows)
    one = quality_mil.train(table, labels.where("quality = 1"))
    assert one == 1.0 and quality_mil.train(table, labels.limit(0)) == 0.0
    assert quality_mil.score(docs(spark, []).select("doc_id", "text"), one).count() == 0


def edits_inside(item, text):
    """Least edits that turn the item into some part of the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        last, row = row, [i] + [0] * len(text)
        for j, b in enumerate(text, 1):
            row[j] = min(last[j - 1] + (a != b), last[j] + 1, row[j - 1] + 1)
    return min(row)


def spelled(text):
    return "".join(map(chr, decontaminate.normal(text)))


def test_decontamination_finds_what_brute_force_finds():
    rng = random.Random(5)
    letters = "abcdefghijklmno"
    word = lambda: "".join(rng.choices(letters, k=rng.randint(2, 8)))
    items = [" ".join(word() for _ in range(n)) for n in (9, 14, 30, 5)]
    index = decontaminate.Index(list(range(4)), items)
    texts = []
    for i in range(60):
        body = [word() for _ in range(rng.randint(0, 60))]
        item = list(items[i % 4])
        for _ in range(rng.randint(0, 9)):
            at = rng.randrange(len(item))
            kind = rng.random()
            if kind < 0.4:
                item[at] = rng.choice(letters)
            elif kind < 0.7:
                del item[at]
            else:
                item.insert(at, rng.choice(letters))
        body.insert(rng.randint(0, len(body)), "".join(item))
        texts.append("  ".join(body).title())
    texts += [None, "", "short", items[2].upper(), " ".join(items[:2]), items[0].replace(" ", " --\n ")]
    found = decontaminate.matches(index, texts)
    hits = 0
    for text, got in zip(texts, found):
        plain = spelled(text)
        for i, item in enumerate(index.codes):
            least = edits_inside("".join(map(chr, item)), plain)
            assert (i in got) == (least <= index.edits[i]), (i, least, index.edits[i])
            if i in got:
                hits += 1
                edits, start, end = got[i]
                assert edits == least
                assert edits_inside("".join(map(chr, item)), plain[start:end]) == least
    assert hits > 25


def test_decontamination_of_long_texts(monkeypatch):
    monkeypatch.setattr(decontaminate, "PIECE", 500)
    rng = random.Random(6)
    item = "".join(rng.choices("abcdefgh ", k=120)).strip()
    index = decontaminate.Index([7], [item])
    filler = "".join(rng.choices("mnopqrst ", k=5000))
    for at in (0, 380, 495, 505, 990, 4990):
        got = decontaminate.matches(index, [filler[:at] + " " + item + " " + filler[at:], filler])
        assert got[0][0][0] == 0 and not got[1]


def test_decontamination_tables(spark):
    item = "one long benchmark question about rivers and their many names"
    bench = spark.createDataFrame([(3, item), (4, None), (5, "tiny"), (6, item)], "item_id long, text string")
    rows = edge_rows() + [(30, f"so: {item.upper()}!", "en"), (30, f"so: {item.upper()}!", "en"), (31, item[:30], "en")]
    table = docs(spark, rows)
    out = decontaminate.contaminated(table, bench).collect()
    assert sorted((r.doc_id, r.item_id, r.edits) for r in out) == [(30, 3, 0), (30, 3, 0), (30, 6, 0), (30, 6, 0)]
    kept = decontaminate.filter_stage(table, bench)
    assert kept.columns == table.columns and kept.count() == len(rows) - 2
    # Blocks of the benchmark together find the same; an empty benchmark or table is no error.
    assert sum(len(b.ids) for b in decontaminate.blocks(bench, 50)) == 2
    empty = bench.limit(0)
    assert decontaminate.contaminated(table, empty).count() == 0
    assert decontaminate.filter_stage(table, empty).count() == len(rows)
    assert decontaminate.contaminated(docs(spark, []), bench).count() == 0


def corpus(n=400, seed=9):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)]
    line = "the same line stands here again and again".split()
    rows = []
    for i in range(n):
        text = rng.choices(vocabulary, weights=[1 / (k + 1) for k in range(40)], k=rng.randint(0, 40)) + [f"rare{i % 290}"]
        if i % 3 == 0:
            text += line
        rows.append((i, " ".join(w.title() for w in text) + rng.choice(["", " \t\n"]), "en"))
    return rows


def brute_base(rows):
    count = Counter()
    for i, text, _ in rows:
        if i is not None and crc(i, 7) != 2:
            count.update((text or "").encode().lower().split() + [None])
    total, kinds = sum(count.values()), len(count)
    out = {}
    for i, text, _ in rows:
        tokens = (text or "").encode().lower().split() + [None]
        out[i] = (len(tokens), sum(count[w] > 0 for w in tokens), total,
                  sum(math.log10((count[w] + 1) / (total + kinds + 1)) for w in tokens))
    return out


def test_suffix_tree_against_brute_force(spark):
    rows = corpus() + [(1000, None, "en"), (1001, "", "en"), (1002, "Ä\u00a0x\x0by unknownword", "en"), (None, "w1 w2", "en")]
    out = suffix_tree.score(docs(spark, rows)).toPandas()
    assert len(out) == len(rows)
    want = brute_base(rows)
    held_score = held_base = 0.0
    for r in out.itertuples():
        i = None if r.doc_id != r.doc_id else int(r.doc_id)
        tokens, known, total, base = want[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (tokens, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.held_out == (i is None or crc(i, 7) == 2)
        if r.held_out:
            held_score, held_base = held_score + r.score, held_base + r.base_score
    assert held_score > held_base + 1


def test_suffix_tree_states_sum_to_one(spark):
    rows = corpus()
    table = docs(spark, rows)
    from pyspark.sql import functions as F
    learn = table.select("doc_id", F.lit(True).alias("train"), "text")
    counts = suffix_tree.word_counts(learn)
    known = suffix_tree.vocabulary(counts, len(rows))
    shared = spark.sparkContext.broadcast(known)
    coded = suffix_tree.encode(learn, shared).cache()
    tree = suffix_tree.grow(coded, known)
    kept = [k.sum() for k in tree.kept]
    assert kept[0] > 3 and kept[1] > 1 and len(tree.keys) == suffix_tree.ORDER
    words = np.arange(len(known.count))
    every = counts.toPandas()["n"].to_numpy()
    rare = every[every < known.count[1:].min()]
    rest = known.discount * known.kinds / known.total + sum(10 ** known.root(rare))
    assert sum(10 ** known.root(known.count)) + rest == pytest.approx(1)
    for state in np.flatnonzero(tree.kept[0])[:10]:
        listed = 10 ** tree.log(1, np.full(len(words), state), words)
        assert listed.sum() + rest * 10 ** tree.left[0][state] == pytest.approx(1, abs=1e-9)
    # The vectorised scorer and the recursive definition agree.
    number = known.number
    seq = np.array([number[w.encode()] for w in "the same line stands here again".split()] + [0])
    direct = tree.score(seq)
    runs = tree.runs(seq)
    for i in range(1, len(seq)):
        best = 0.0
        for level in range(len(tree.keys), 0, -1):
            state = runs[level - 1][i - 1]
            if state >= 0:
                best = tree.log(level, np.array([state]), seq[i:i + 1])[0]
                break
        else:
            best = known.root(known.count[seq[i:i + 1]])[0]
        assert direct[i] == pytest.approx(best)


def test_suffix_tree_without_training(spark):
    only = [(i, "a b", "en") for i in range(200) if crc(i, 7) == 2][:2]
    out = suffix_tree.score(docs(spark, only)).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in out] == [(3, 0, 0, 0.0, 0.0)] * 2
    assert suffix_tree.score(docs(spark, [])).count() == 0


def passage(n=5, filler=0):
    """A passage in ``n`` training documents and one held out, and training text without it."""
    line = " ".join(f"p{i}" for i in range(30))
    learn = [i for i in range(400) if crc(i, 7) != 2]
    held = next(i for i in range(400, 500) if crc(i, 7) == 2)
    return held, [(i, line, "en") for i in learn[:n]] + [(held, line, "en"), (learn[n], " ".join(["fill"] * filler), "en")]


@pytest.mark.parametrize("head", [2e-6, 0.5])
def test_suffix_tree_keeps_its_contexts_in_a_large_corpus(spark, monkeypatch, head):
    monkeypatch.setattr(suffix_tree, "HEAD", head)
    held, rows = passage(filler=1_200_000)
    out = {r.doc_id: r for r in suffix_tree.score(docs(spark, rows)).collect()}
    # 30 words, of which all but the first follow a known context with probability 0.9.
    assert out[held].score > 29 * math.log10(0.9) + math.log10(5 / 1_200_000) - 1
    assert out[held].base_score < -100


@pytest.mark.parametrize("head, held_runs", [(2e-6, 500_000), (0.02, 500_000), (2e-6, 60), (0.02, 0)])
def test_suffix_tree_tables_equal_the_tree_in_memory(spark, monkeypatch, head, held_runs):
    from pyspark.sql import functions as F
    rows = corpus(900)
    learn = docs(spark, rows).select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 7 != 2).alias("train"), "text")
    known = suffix_tree.vocabulary(suffix_tree.word_counts(learn.where("train")), learn.where("train").count())
    tree = suffix_tree.grow(suffix_tree.encode(learn, spark.sparkContext.broadcast(known)).cache(), known)
    count = Counter(w for i, t, _ in rows if crc(i, 7) != 2 for w in t.encode().lower().split())
    want = {}
    for i, text, _ in rows:
        text = text.encode().lower().split()
        seq = np.array([known.number.get(w, -1) for w in text] + [0])
        want[i] = tree.score(seq).sum() + sum(float(known.root(count[w])) for w, s in zip(text, seq) if s < 0)
    assert sum(k.sum() for k in tree.kept) > 10
    monkeypatch.setattr(suffix_tree, "HEAD", head)
    monkeypatch.setattr(suffix_tree, "HELD_RUNS", held_runs)
    for r in suffix_tree.score(docs(spark, rows)).collect():
        assert r.score == pytest.approx(want[r.doc_id], rel=1e-9)


def test_suffix_tree_pieces_ask_packed_and_small(spark, monkeypatch):
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 64, 100_000, dtype=np.uint64, endpoint=False))
    asked = suffix_tree._asked(7, keys, 32, np.ones(len(keys), np.uint32))
    assert sum(len(k) for k in asked.column("keys").to_pylist()) < 6.5 * len(keys)
    assert (suffix_tree._keys(asked.column("keys"))[0] == keys).all()
    # Many small pieces, words of more than LONG bytes and a piece without words give what one piece gives.
    rows = corpus() + [(2000 + i, "Z" * 70 + f" {'y' * 65} a b", "en") for i in range(9)] + [(3000, " \t", "en")]
    whole = {r.doc_id: r for r in suffix_tree.score(docs(spark, rows)).collect()}
    monkeypatch.setattr(suffix_tree, "PIECE", 500)
    for r in suffix_tree.score(docs(spark, rows)).collect():
        assert r[:5] == whole[r.doc_id][:5] and r[5:] == pytest.approx(whole[r.doc_id][5:], rel=1e-9)
    base = brute_base(rows)
    assert all((r.n_tokens, r.n_known) == base[i][:2] for i, r in whole.items())
