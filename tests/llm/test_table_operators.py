"""SimHash, WARC, nearest neighbours, mixing, URLs and the pipeline on small tables."""

import base64
import hashlib
import os
import random

import numpy as np
import pandas as pd
import pytest
import xxhash

pytest.importorskip("matchloom.llm.queries")

import corpus_pipeline  # noqa: E402
from matchloom.llm import ann, decontaminate, langid, mixing, simhash, toxicity, url_filter, warc  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps):
    """Smallest id reachable, by comparing everything with everything."""
    ids = list(fps)
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if (fps[a] ^ fps[b]).bit_count() <= 2 and label[b] < label[a]:
                    label[a] = label[b]
                    changed = True
    return label


def near_copies(n=60, seed=4):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    base = [word() for _ in range(400)]
    rows = []
    for i in range(n):
        text = list(base) if i % 2 else [word() for _ in range(rng.randint(0, 30))]
        if i % 2 and i > 5:
            text[rng.randrange(400)] = word()
        rows.append((i, " ".join(text).title(), "a"))
    return rows + [(200, None, "a"), (201, "", "b"), (202, " \t\n", "b"), (203, "One", "b"), (204, "one  ", "b"), (205, "x y", None)]


@pytest.mark.parametrize("crowded", [1, 32])
def test_simhash_against_brute_force(spark, monkeypatch, crowded):
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    rows = near_copies()
    want = {i: slow_fingerprint(t) for i, t, _ in rows}
    label = slow_components(want)
    got = simhash.groups(docs(spark, rows)).select("doc_id", simhash.hex16(simhash.F.col("fp")).alias("h"), "component_id").collect()
    assert {r.doc_id: r.h for r in got} == {i: f"{f:016x}" for i, f in want.items()}
    assert {r.doc_id: r.component_id for r in got} == label
    assert len(set(label.values())) < len(rows) - 10


def test_simhash_links_chains_and_hot_groups(spark):
    rng = random.Random(8)
    fps = {0, 3, 15, 63, (1 << 64) - 1, (1 << 64) - 1 - (1 << 63)}
    for _ in range(3):
        value = rng.getrandbits(64)
        for _ in range(120):
            fps.add(value)
            value ^= 1 << rng.randrange(64)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    links = simhash.links(spark.createDataFrame(signed, "fp long"))
    out = {r.node: r.label for r in simhash.components(links).collect()}
    label = slow_components({s: s & ((1 << 64) - 1) for (s,) in signed})
    assert {s: out.get(s, s) for (s,) in signed} == label


def test_simhash_stage_keeps_one_of_each(spark):
    text = "a passage that stands here word for word and once more"
    rows = [(5, text, "a"), (3, text, "b"), (3, text, "b"), (None, text, "a"), (None, "alone without id", "a"),
            (None, "alone without id", "a"), (9, None, "a"), (10, "", "a"), (11, "other words here entirely new", "a")]
    table = docs(spark, rows)
    out = simhash.drop_copies(table)
    assert out.columns == table.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(
        [(3, text), (None, "alone without id"), (9, None), (11, "other words here entirely new")], key=str)
    assert simhash.drop_copies(docs(spark, [])).count() == 0 and simhash.groups(docs(spark, [])).count() == 0


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_warc_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FRAME", 400)
    monkeypatch.setattr(warc, "BUNDLE", 3000)
    rng = random.Random(1)
    rows = [(i, f"http://a.org/{i}%\r\n?ü", "é" * rng.randint(0, 300)) for i in range(40)]
    rows += [(50, None, None), (51, "u", ""), (52, "u", "same"), (53, "u", "same"), (None, "u", "same"), (None, None, "lone"),
             (60, "u", "\r\n\r\nWARC/1.1\r\n" * 100_000)]
    index = warc.write(pages(spark, rows), str(tmp_path / "w"))
    assert index.count() == len(rows) and index.select("bundle").distinct().count() > 3
    got = {}
    for r in warc.read_all(spark, index).collect():
        got.setdefault(r.page_id, []).append(r)
    keeper = {}
    for i, _, html in rows:
        if i is not None:
            keeper[html or ""] = max(i, keeper.get(html or "", -1))
    for i, url, html in rows:
        payload = (html or "").encode()
        refers = keeper.get(html or "")
        refers = None if refers == i else refers
        assert any((r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.url) == (
            len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(),
            "revisit" if refers is not None else "response", refers, url) for r in got[i]), i
    one = warc.lookup(index, spark.createDataFrame([(7,), (60,), (52,), (999,)], "page_id long")).collect()
    assert {(r.page_id, bytes(r.payload)) for r in one} == {(7, rows[7][2].encode()), (60, rows[-1][2].encode()), (52, b"")}
    # The seek table alone finds a record: offsets are relative to the unpacked frame.
    row = index.where("page_id = 20").first()
    headers, block = warc.BundleReader(row.bundle).record(row.frame, row.offset)
    assert headers["WARC-Record-ID"] == "<urn:page:20>"
    reader = warc.BundleReader(row.bundle)
    assert sum(f[2] for f in reader.frames) == sum(len(reader.frame(n)) for n in range(len(reader.frames)))


def test_warc_of_an_empty_table_and_least_size(spark):
    assert warc.read_all(spark, warc.write(pages(spark, []))).count() == 0
    rows = pages(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")])
    out = {r.page_id: r.record_type for r in warc.read_all(spark, warc.write(rows, least=5)).collect()}
    assert out == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def slow_neighbours(rows, k=20):
    data = {i: np.array(v, np.float32).astype(np.float64) for i, v, _ in rows}
    out = {}
    for q in data:
        if q % 20 == 0:
            scored = sorted((-float((data[q] * v).sum()), i) for i, v in data.items() if i != q)
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def test_neighbours_recall_and_copies(spark):
    rng = np.random.default_rng(2)
    data = rng.normal(size=(1500, 16)) * rng.uniform(0.5, 2, size=(1500, 1))
    data[300:420] = data[300]
    rows = [(i, [float(np.float32(x)) for x in v], 0) for i, v in enumerate(data)]
    out = ann.search(vectors(spark, rows)).toPandas()
    want = slow_neighbours(rows)
    found = total = 0
    for q, g in out.groupby("query_id"):
        g = g.sort_values("rank")
        assert list(g["rank"]) == list(range(1, 21))
        scores = list(g["score"])
        assert all(a > b or (a == b and i < j) for a, b, i, j in zip(scores, scores[1:], g.vec_id, g.vec_id[1:]))
        found += len(set(g.vec_id) & {i for i, _ in want[q]})
        total += 20
    assert total == 20 * len(want) and found / total >= 0.9
    # A query among copies finds the copies with the smallest ids first.
    copies = out[out.query_id == 320].sort_values("rank")
    assert [i for i in copies.vec_id if 300 <= i < 420] == list(range(300, 320))[:len([i for i in copies.vec_id if 300 <= i < 420])]


def test_neighbours_edges(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0], 1), (20, [1.0, 0.0], 1), (1, [0.5, 0.5], 1), (2, None, 1), (3, [0.0, 0.0], 1), (4, [nan, 1.0], 1),
            (5, [1.0, inf], 1), (6, [None, 1.0], 1), (7, [], 1), (8, [1.0], 1), (None, [1.0, 1.0], 1), (1, [0.5, 0.5], 1)]
    out = ann.search(vectors(spark, rows)).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in out] == [
        (0, 1, 20, 1.0), (0, 2, 1, 0.5), (20, 1, 0, 1.0), (20, 2, 1, 0.5)]
    assert ann.search(vectors(spark, rows[3:6])).count() == 0
    assert ann.search(vectors(spark, [])).count() == 0


def test_neighbours_blocks_of_a_leaf(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 7)
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in v], 0) for i, v in enumerate(rng.normal(size=(300, 4)))]
    out = ann.search(vectors(spark, rows), share=50.0, depth=3, trees=4)
    got = {}
    for r in out.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {q: [i for i, _ in w] for q, w in slow_neighbours(rows).items()}


def test_mixing_fills_its_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKETS", 16)
    rng = random.Random(3)
    rows = [(i, " ".join(["wörd"] * rng.randint(0, 90)), rng.choice("aaaaabbbcd")) for i in range(500)]
    rows += [(900, "few words here", None), (901, None, "e"), (902, "", "a"), (902, "", "a"), (None, "no id " * 9, "b")]
    out = mixing.mix(docs(spark, rows)).toPandas()
    assert len(out) == len(rows) and ((out.taken >= 0) & (out.taken <= 2 * out["size"])).all()
    total = out["size"].sum()
    sources = out.groupby(out.source.fillna("~"))
    targets = sources.target.first()
    assert abs(targets.sum() - min(1.5 * total, 2 * total)) < 1e-6
    assert ((sources.taken.sum() - targets).abs() <= 1).all()
    assert (targets <= 2 * sources["size"].sum() + 1e-9).all()
    # Sources below their cap share one level by weight: 3, 1, 2, repeating in order of name, null last.
    weight = dict(zip(["a", "b", "c", "d", "e", "~"], [3, 1, 2, 3, 1, 2]))
    free = [targets[s] / weight[s] for s in targets.index if targets[s] < 2 * sources["size"].sum()[s] - 1e-9]
    assert max(free) - min(free) < 1e-6 and all(
        targets[s] / weight[s] <= max(free) + 1e-6 for s in targets.index)
    again = mixing.mix(docs(spark, rows).repartition(5)).toPandas()
    key = ["doc_id", "source", "size", "taken"]
    assert sorted(map(str, out[key].values.tolist())) == sorted(map(str, again[key].values.tolist()))
    assert mixing.mix(docs(spark, [])).count() == 0


def test_mixing_prefers_quality(spark):
    rows = [(i, "word " * 20 if i % 2 else "w0#1 " * 20, "a") for i in range(400)] + [(i, "x " * 100, "b") for i in range(400, 600)]
    out = mixing.mix(docs(spark, rows)).where("source = 'a'").toPandas()
    epochs = (out.taken // out["size"]).min()
    more = out[out.taken > epochs * out["size"]]
    if 0 < len(more) < len(out):
        assert (more.doc_id % 2).mean() > 0.6


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["op2_warc", "op8_mixing"])
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as entry
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SF}/{file}'")
    want = con.execute(entry.oracle_sql()[name]).df()
    got = entry.queries()[name](spark, SF).toPandas()[list(want.columns)]
    rows = [sorted(tuple("-" if pd.isna(v) else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r)
                   for r in t.astype(object).itertuples(index=False)) for t in (got, want)]
    number = [[tuple(float(v) if v.replace(".", "", 1).isdigit() else v for v in r) for r in t] for t in rows]
    assert number[0] == number[1]


def slow_url(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = rest[:cut], rest[cut:]
    path = tail[:min([tail.index(c) for c in "?#" if c in tail] or [len(tail)])]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits) if fits else (0, None, None)
    return host, path, best[1], best[2]


URLS = [None, "", "no scheme", "http://", "http://example.org", "https://Example.ORG/es/1", "http://x.example.org/en/15?a=b&c",
        "http://xexample.org/es/", "http://org/", "ftp://a.COM/fr/\n/x", "http://a.com/de/é#x?y", "http://a.com/DE/", "a://b://c/d",
        "http://ÄB.com/fr/?q", "http://a.com?x=/fr/", "http://a.net/" + "x" * 50_000, "http://example.org/en/1", "http://example.org/en/2"]


def test_urls_against_brute_force(spark):
    rows = [(i, u) for i, u in enumerate(URLS * 3)]
    out = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")).select(
        "row.page_id", "row.url", "host", "path", "rule", "verdict").collect()
    assert len(out) == len(rows)
    for r in out:
        host, path, rule, verdict = slow_url(r.url)
        assert (r.host, r.path, r.rule) == (host, path, rule), r.url
        assert r.verdict == verdict if rule else r.verdict in ("allow", "block")


def test_urls_learn_from_given_labels(spark):
    rng = random.Random(1)
    rows = [(i, f"http://site{i % 9}.net/p/{i}" if i % 2 else f"http://win-{i}-{i * 7}.net/?a={i}&b={i}&c=1") for i in range(400)]
    labels = spark.createDataFrame([(u, int(i % 2 == 0)) for i, u in rows if rng.random() < 0.6], "url string, block int")
    # Clashing names in the input stay apart in the struct `row`.
    table = spark.createDataFrame([(i, u, "h", 1.0) for i, u in rows], "page_id long, url string, host string, length double")
    out = url_filter.judge(table, labels, rules=[]).select("row.page_id", "verdict").collect()
    assert sum((r.verdict == "block") == (r.page_id % 2 == 0) for r in out) > 390
    one = url_filter.judge(table, labels.where("block = 1"), rules=[])
    assert {r.verdict for r in one.collect()} == {"block"}
    none = url_filter.judge(table, labels.limit(0), rules=[])
    assert {r.verdict for r in none.collect()} == {"allow"}
    assert url_filter.judge(table.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pipeline_stage_by_stage(spark):
    """Each stage against a plain decision over what came before it."""
    table = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    now, columns = table, table.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, SF).cache()
        before = {r.doc_id: r.text for r in now.collect()}
        after = [r.doc_id for r in out.collect()]
        assert out.columns == columns and len(after) == len(set(after)) and set(after) <= set(before)
        if name == "language_id":
            want = {r.doc_id for r in langid.identify(now.select("doc_id", "text"), langid.train(now)).collect()
                    if r.lang_pred != "und" and r.lang_score >= 0.34}
        elif name == "toxicity":
            want = {r.doc_id for r in toxicity.train(now, labels).score(now.select("doc_id", "text")).collect() if r.toxic_score < 0.7}
        elif name == "simhash_near_dedup":
            fps = {i: slow_fingerprint(t) for i, t in before.items()}
            want = {i for i, c in slow_components(fps).items() if i == c}
            assert len(want) < len(before)
        else:
            items = [decontaminate.normal(r.text).tobytes() for r in bench.collect()]
            leaks = {i for i, t in before.items() if any(b in decontaminate.normal(t).tobytes() for b in items)}
            want = set(before) - leaks
            assert leaks and not leaks & set(after)
        assert set(after) == want, name
        now = out
    mixed = corpus_pipeline.STAGES[-1][1](spark, now, SF)
    assert mixed.count() == now.count()
    assert corpus_pipeline.run(spark, SF).count() == now.count()


def test_neighbours_ties_at_the_edge_of_a_block(spark):
    # All products with the query are equal, and no two vectors.
    rows = [(i, [1.0, float(i)], 0) for i in range(1, 400) if i % 20] + [(1000, [1.0, 0.0], 0)]
    random.Random(1).shuffle(rows)
    out = ann.search(vectors(spark, rows).repartition(7), share=50.0, depth=1, trees=2).orderBy("rank").collect()
    assert [r.vec_id for r in out] == [i for i in range(1, 400) if i % 20][:20]


def test_neighbours_queries_of_a_leaf_are_dealt_out(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in v], 0) for i, v in enumerate(rng.normal(size=(600, 4)))]
    for name, value in (("BLOCK", 70), ("ASKED", 5), ("SLICE", 2)):
        monkeypatch.setattr(ann, name, value)
    out = ann.search(vectors(spark, rows), share=50.0, depth=1, trees=2)
    got = {}
    for r in out.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {q: [i for i, _ in w] for q, w in slow_neighbours(rows).items()}


def test_simhash_stage_decides_each_row_of_a_repeated_id(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(200)) for x in "abc")
    assert (slow_fingerprint(a) ^ slow_fingerprint(b)).bit_count() > 2 < (slow_fingerprint(b) ^ slow_fingerprint(c)).bit_count()
    # Both texts of 5 are alone; of 7, one is a copy of 3's; those of 9 are one group.
    near = next(t for i in range(200) for t in [c.replace(f"c{i} ", "")]
                if 0 < (slow_fingerprint(t) ^ slow_fingerprint(c)).bit_count() <= 2)
    d = " ".join(f"d{i}" for i in range(200))
    rows = [(5, a, "a"), (5, b, "a"), (5, b, "b"), (3, d, "a"), (7, d, "a"), (7, "alone with its own words", "a"), (9, c, "a"), (9, near, "a")]
    out = sorted((r.doc_id, r.text) for r in simhash.drop_copies(docs(spark, rows)).collect())
    assert [r for r in out if r[0] != 9] == sorted([(3, d), (5, a), (5, b), (7, "alone with its own words")])
    assert [r for r in out if r[0] == 9] in ([(9, c)], [(9, near)])
