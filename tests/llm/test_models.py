"""Classifiers, vector search, extraction and the pipeline: held-out accuracy, brute force, and defined results for odd input."""

import os
import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from test_documents import SCHEMA, messy

import corpus_pipeline
from leafmill.llm import extraction, quality, queries, toxicity, training, vectors

SF = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def labelled_text(r: random.Random, bad: bool, toxic: bool) -> str:
    words = [r.choice("the a river stone and light over under forest small of to".split()) + r.choice(["", "", "er", "ing"]) for _ in range(r.randint(30, 120))]
    if bad:
        words = [w + "***" for w in words]
    if toxic:
        words[r.randrange(len(words))] = r.choice(["grumbo", "zwarkly", "blixen" + r.choice("abcdef") + "o"])
    return " ".join(words)


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(4)
    rows = [(i, int(r.random() < 0.7), int(r.random() < 0.3)) for i in range(500)]
    docs = spark.createDataFrame([(i, labelled_text(r, not q, bool(t))) for i, q, t in rows], "doc_id long, text string")
    return docs, spark.createDataFrame(rows, "doc_id long, quality int, toxic int"), {i: (q, t) for i, q, t in rows}


@pytest.mark.parametrize("score,place,threshold", [(quality.score_quality, 0, 0.7), (toxicity.score_toxicity, 1, 0.3)])
def test_held_out_accuracy(labelled, score, place, threshold):
    docs, labels, truth = labelled
    rows = score(docs, labels).collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert {r.doc_id for r in rows if r.held_out} == {r.doc_id for r in held}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= threshold) for r in rows)
    assert np.mean([r.predicted == truth[r.doc_id][place] for r in held]) >= 0.93


def test_labels_of_held_out_rows_are_not_learned(labelled, spark):
    docs, labels, _ = labelled
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 4 = 2, 1 - quality, quality) as quality", "toxic")
    assert training.sample(docs, labels, "quality") == training.sample(docs, flipped, "quality")


def test_sample_is_bounded_by_ids(labelled, spark):
    docs, labels, _ = labelled
    once = training.sample(docs, labels, "quality")
    copies = spark.range(50).select("id")
    many = docs.unionByName(docs.where("doc_id < 5").crossJoin(copies).select("doc_id", "text"))
    assert training.sample(many, labels.unionByName(labels), "quality") == once
    assert len(training.sample(many, labels, "quality", rows=3)) == 3


def test_sample_is_drawn_from_what_is_there(labelled, spark):
    docs, labels, _ = labelled
    once = training.sample(docs, labels, "quality", rows=20)
    others = spark.range(100_000, 130_000).selectExpr("id as doc_id", "1 as quality", "0 as toxic")
    long = docs.unionByName(spark.range(100_000, 100_300).selectExpr("id as doc_id", "repeat('long ', 8000) as text"))
    assert len(once) == 20 and training.sample(long, labels.select("doc_id", "quality", "toxic").unionByName(others), "quality", rows=20) == once


@pytest.mark.parametrize("score,keep", [(quality.score_quality, quality.keep_quality), (toxicity.score_toxicity, toxicity.drop_toxic)])
def test_classifiers_take_odd_rows(labelled, spark, score, keep):
    _, labels, _ = labelled
    docs = spark.createDataFrame(messy(), SCHEMA)
    rows = score(docs, labels).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in messy())
    blank = {r.score for r in rows if r.doc_id in (40, 41, 42)}
    assert len(blank) == 1 and all(np.isfinite(r.score) for r in rows)
    assert keep(docs, labels).columns == docs.columns
    none = spark.createDataFrame([], SCHEMA)
    assert score(none, labels).count() == 0 and keep(none, labels).count() == 0
    empty = spark.createDataFrame([], labels.schema)
    assert score(docs, empty).count() == len(messy())


@pytest.mark.parametrize("model,none", [(quality.QualityModel, 0.5), (toxicity.ToxicityModel, 0.0)])
def test_labels_of_one_kind_give_their_share(model, none):
    texts = ["", "some words", "other words ***"]
    for rows, want in (([], none), ([("some words", 1)] * 9, 1.0), ([("some words", 0), ("", 0)], 0.0)):
        assert model(rows).score(texts).tolist() == [want] * 3


def test_gradients():
    r = np.random.default_rng(1)
    rows = [("bad words here " * 3, 1), ("good words there " * 4, 0)] * 4
    model = toxicity.ToxicityModel(rows)
    model.weights = {k: (v + r.normal(0, 0.3, v.shape)).astype(np.float64) for k, v in model.weights.items()}
    ids, words = model.arranged([["bad", "words", "x"], ["good", "there"]])
    y = np.array([1.0, 0.0])

    def loss() -> float:
        z = model.logits(ids, model.inputs(words)[0].astype(np.float64)).astype(np.float64)
        return float(np.mean(np.logaddexp(0, z) - y * z))

    gradients = model.gradients(ids, y, model.inputs(words))
    for name in ("wo", "va", "wa", "uf", "ub", "xf", "xb", "cf", "ba"):
        at = tuple(r.integers(n) for n in model.weights[name].shape)
        model.weights[name][at] += 1e-2
        up = loss()
        model.weights[name][at] -= 2e-2
        down = loss()
        model.weights[name][at] += 1e-2
        assert abs((up - down) / 2e-2 - gradients[name][at]) < 2e-4 + 0.03 * abs(gradients[name][at]), name


def test_windows_cover_every_word():
    for n in (1, 16, 17, 32, 33, 48, 49, 500):
        starts = toxicity.windows(n)
        assert {i for s in starts for i in range(s, min(n, s + toxicity.WORDS))} == set(range(n))
    assert not toxicity.windows(0)


# ---- Vectors


@pytest.fixture(scope="module")
def embeddings(spark):
    r = np.random.default_rng(6)
    rows = [(i, [float(x) for x in r.normal(0, 0.2, 16)], 1) for i in range(700)]
    rows[40] = (40, rows[20][1], 1)
    rows += [(700 + i, rows[60][1], 1) for i in range(60)]  # one vector that is common
    rows += [(900, None, 1), (920, [float("nan")] * 16, 1), (940, [0.0] * 16, 1), (960, [1.0, None] + [0.0] * 14, 1), (980, [], 1), (None, rows[1][1], 1), (1000, [0.5, 0.5], 1), (1001, [0.1, 0.9], None), (1002, [float("inf")] * 16, 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5), rows


def brute(rows, whole: bool) -> dict[int, list]:
    valid = {}
    for i, v, _ in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and (whole or any(v)):
            v = np.array(v, np.float32).astype(float)
            valid[i] = np.floor(64 * v).astype(int) if whole else v
    out = {}
    for q, v in valid.items():
        if q % 20 == 0:
            scores = sorted((-(int(v @ u) if whole else float((u * v).sum())), i) for i, u in valid.items() if i != q and len(u) == len(v))
            out[q] = [(i, -s) for s, i in scores[:20]]
    return out


def test_maxscore_is_exact(embeddings, spark):
    df, rows = embeddings
    v = vectors.whole_components(vectors.valid_vectors(df, zero=True))
    found = Counter((r.query_id, r.rank, r.vec_id, r.score) for r in vectors.top_scores(v, v.where("vec_id % 20 = 0")).collect())
    assert found == Counter((q, k + 1, i, s) for q, best in brute(rows, True).items() for k, (i, s) in enumerate(best))
    none = vectors.whole_components(vectors.valid_vectors(spark.createDataFrame([], df.schema), zero=True))
    assert vectors.top_scores(none, none).count() == 0


def test_maxscore_of_any_size(spark):
    r = random.Random(13)
    sizes = [0.01, 0.3, 5.0, 1e5, 3e7, 1e12, 3e30, 1e200, 1.7e308]
    rows = [(i, [r.choice([0.0, r.uniform(-1, 1) * r.choice(sizes[: 1 + i % 9])]) for _ in range(8)]) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    v = vectors.whole_components(vectors.valid_vectors(df, zero=True))
    most = float(np.finfo(float).max)
    whole = {i: [int(np.floor(max(-most, min(most, 64 * x)))) for x in e] for i, e in rows}

    def score(a, b):
        return max(-vectors.MOST_LONG, min(vectors.MOST_LONG, sum(x * y for x, y in zip(a, b, strict=True))))

    want = Counter()
    for q in range(0, 120, 20):
        best = sorted((-score(whole[q], u), i) for i, u in whole.items() if i != q)[:20]
        want.update((q, k + 1, i, -s) for k, (s, i) in enumerate(best))
    assert Counter((x.query_id, x.rank, x.vec_id, x.score) for x in vectors.top_scores(v, v.where("vec_id % 20 = 0")).collect()) == want


def test_permutation_index(embeddings, spark, monkeypatch):
    monkeypatch.setattr(vectors, "ROW_BLOCK", 256)
    monkeypatch.setattr(vectors, "LEAST_RERANKED", 96)
    df, rows = embeddings
    v = vectors.valid_vectors(df, zero=False)
    found: dict = {}
    for r in vectors.nearest(v, v.where("vec_id % 20 = 0")).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute(rows, False)
    assert set(found) == {q for q in want if want[q]}
    assert np.mean([len({i for _, i, _ in found[q]} & {i for i, _ in want[q]}) / len(want[q]) for q in found]) >= 0.9
    for q, got in found.items():
        got.sort()
        assert [k for k, _, _ in got] == list(range(1, len(want[q]) + 1))
        assert [(-s, i) for _, i, s in got] == sorted((-s, i) for _, i, s in got)
    none = vectors.valid_vectors(spark.createDataFrame([], df.schema), zero=False)
    assert vectors.nearest(none, none).count() == 0


@pytest.mark.parametrize("every,factor", [(100, 20.0), (2000, 1e9), (1, None)])
def test_permutation_index_of_uneven_norms(spark, monkeypatch, every, factor):
    monkeypatch.setattr(vectors, "LEAST_RERANKED", 256)
    r = np.random.default_rng(9)
    data = r.normal(0, 1, (2000, 64))
    data /= np.sqrt((data * data).sum(axis=1, keepdims=True))
    data[::every] *= factor or r.lognormal(0, 0.5, (2000, 1))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(data.tolist())], "vec_id long, v array<double>")
    found: dict = {}
    for x in vectors.nearest(df, df.where("vec_id % 20 = 1")).collect():
        found.setdefault(x.query_id, set()).add(x.vec_id)
    recall = []
    for q in range(1, 2000, 20):
        scores = data @ data[q]
        scores[q] = -np.inf
        recall.append(len(found[q] & set(np.argsort(-scores)[:20].tolist())) / 20)
    print("recall", every, factor, np.mean(recall))
    assert np.mean(recall) >= 0.9


# ---- Pages

PAGE = """<!DOCTYPE html><html><head><title>Not this</title><style>p{margin:0}</style></head><body>
<header><a href="/">Home</a> Site name</header><nav><ul><li><a href="/a">A</a></li></ul></nav>
<div class="cookie-notice">We use cookies on this site.</div>
<article><h1>The &amp; title</h1><p>First   paragraph of the
text, with <a href="x">a link</a> &mdash; and more.</p><div class="ad">Buy now!</div><p>Short.<br>Line<script>var t="</p>";</script></p>
<form><input name=q><button>Send</button></form></article>
<aside class="sidebar">Related things to read</aside><section id="comments"><p>A reader's comment that is long enough to look like content, with the words of a sentence in it.</p></section>
<footer>&copy; 2020 Site</footer></body></html>"""


def test_extraction():
    assert extraction.main_text(PAGE) == "The & title\nFirst paragraph of the text, with a link — and more.\nShort. Line"
    assert extraction.main_text(None) == "" and extraction.main_text("") == "" and extraction.main_text("<p") == ""
    assert extraction.main_text("<p>a < b and the c") == "a < b and the c"
    assert extraction.main_text('<p class="x>one</p><p title="a<b">two</p><p>three</p>') == "one\ntwo\nthree"
    assert extraction.main_text('<a "' * 20000 + "<p>end</p>") == ""  # one long tag of a link
    long = "<p>" + "The words of this paragraph are the words that a reader of the page came for. " * 5 + "</p>"
    plain = f"<body><div><a href=a>one</a> <a href=b>two</a></div>{long}<p>Short one.</p>{long}<div><a href=c>three</a></div></body>"
    assert extraction.main_text(plain).split("\n")[1] == "Short one." and "two" not in extraction.main_text(plain)


@pytest.mark.parametrize("name", ["post type-post category-notices", "tag-alert", "category-legal", "tag-social", "comment-open", "entry has-sidebar"])
def test_what_an_article_is_about_marks_nothing(name):
    text = "The words of this text are here for a reader of it, and so they stay."
    for element in ("article", "main"):
        assert extraction.main_text(f'<nav><a href=x>m</a></nav><{element} class="{name}"><h1>Title</h1><p>{text}</p></{element}>') == f"Title\n{text}"
    assert extraction.main_text(f'<article><p>{text}</p><article class="comment"><p>{text} Not.</p></article></article>') == text


def test_pages_of_any_depth_take_linear_time():
    deep = ("<div>x", "<head>", "<span class=ad>", "<li><td>", "</div>x", "<a>x", "<p><div><center>", "<article>x")
    began = time.process_time()
    for part in deep:
        extraction.main_text(part * 50000)
    extraction.main_text("<p><div>" + "<center>" * 50000 + "<p></p>" * 50000)
    assert time.process_time() - began < 30


def slow_labels(blocks: list) -> list[str]:
    """The second pass by looking at all decided blocks each time."""
    first, out = [extraction.first_pass(b)[0] for b in blocks], []
    good, bad = extraction.GOOD, extraction.BAD
    for i, b in enumerate(blocks):
        seen = [j for j, x in enumerate(first) if x in (good, bad) and (not b.article or blocks[j].article == b.article)]
        before, after = [j for j in seen if j < i], [j for j in seen if j > i]
        sides = [first[x] for x in ([before[-1]] if before else []) + ([after[0]] if after else [])]
        if first[i] in (good, bad):
            out.append(first[i])
        elif b.article:
            out.append(bad if sides == [bad, bad] else good)
        elif len(sides) < 2:
            out.append(sides[0] if sides and first[i] == extraction.SHORT else good)
        elif sides[0] == sides[1]:
            keep = sides[0] == good or (first[i] == extraction.NEAR and len(b.text) > extraction.LONG)
            out.append(good if keep else bad)
        elif b.heading and sides[1] == good:
            out.append(good)
        elif i - before[-1] != after[0] - i:
            out.append(sides[0] if i - before[-1] < after[0] - i else sides[1])
        else:
            out.append(good if first[i] == extraction.NEAR else bad)
    return out


def test_second_pass_against_a_slow_form():
    r = random.Random(17)
    prose_ = "The words of this paragraph are the words that a reader of the page came for. "
    for _ in range(300):
        blocks = []
        for _ in range(r.randint(0, 40)):
            text = r.choice(["short", "Xyz qwe " * 10, prose_, prose_ * 4, "Xyz qwe " * 40, "© 2020 x"])
            blocks.append(extraction.Block(text, r.choice([0, 0, len(text)]), r.choice([0, 0, 1, 2]), r.random() < 0.2, r.random() < 0.2))
        want = slow_labels(blocks)
        assert [b.label for b in extraction.labelled(blocks)] == want


def test_articles_of_random_pages_come_out_whole():
    r = random.Random(18)
    kinds = ["<p>{}</p>", "<li>{}</li>", "<h2>{}</h2>", "<blockquote><p>{}</p></blockquote>", "<td>{}</td>", "<div><div>{}</div></div>", "<pre>{}</pre>"]
    bad = ["<nav><ul><li><a href=x>{}</a></ul></nav>", '<div class="ad">{}</div>', "<aside>{}</aside>", "<footer><p>{}</footer>", "<form>{}</form>", '<section id="comments"><p>{}</section>', "<script>var a='</p>{}'</script>", "<header>{}</header>", "<!-- {} -->", '<div role="navigation">{}</div>']
    for n in range(200):
        words = iter(range(10**6))

        def text(most: int) -> str:
            return " ".join(f"{r.choice(['the', 'of', 'word', 'is', 'rare'])}{next(words) if r.random() < 0.3 else ''}" for _ in range(r.randint(1, most)))

        inside = [(r.choice(kinds), text(60), True) if r.random() < 0.8 else (r.choice(bad[1:4] + bad[6:7]), text(40), False) for _ in range(r.randint(1, 12))]
        outside = [r.choice(bad).format(text(40)) for _ in range(r.randint(0, 6))]
        page = "".join(outside[:3]) + "<article>" + "".join(k.format(t) for k, t, _ in inside) + "</article>" + "".join(outside[3:])
        assert extraction.main_text(page) == "\n".join(t for _, t, good in inside if good), n


def test_long_runs_of_short_blocks_follow_their_neighbours():
    link = "<div><a href=a>one two three</a></div>"
    assert extraction.main_text(f"<body>{link}{'<p>Item</p>' * 600}{link}</body>") == ""


def test_extract_takes_odd_rows(spark):
    rows = [(1, "u", PAGE, "x", 3), (1, "u", PAGE, "x", 3), (2, None, None, None, None), (None, "v", "", "y", 1), (3, "w", "<div>" * 50000 + "deep", "y", 1)]
    schema = "page_id long, url string, html string, text string, n_chars int"
    got = extraction.extract(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 5 and all(r.n_chars == len(r.text) for r in got)
    assert {r.text for r in got if r.page_id == 2} == {""} and extraction.extract(spark.createDataFrame([], schema)).count() == 0


# ---- Queries


@tables
def test_pipeline_stages(spark):
    from leafmill.llm.common import stage, table

    docs = table(spark, SF, "documents")
    before = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, function in corpus_pipeline.STAGES[:-1]:
        after = stage(function(spark, docs, SF))
        assert after.columns == docs.columns and after.dtypes == docs.dtypes, name
        ids = {r.doc_id for r in after.select("doc_id").collect()}
        assert ids <= before and len(ids) > 0.7 * len(before), name
        docs, before = after, ids
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= len(before)


def written(spark, path, docs, labels) -> str:
    docs.write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_pipeline_takes_odd_rows(spark, tmp_path, labelled):
    docs = spark.createDataFrame(messy(), SCHEMA)
    rows = corpus_pipeline.run(spark, written(spark, tmp_path / "messy", docs, labelled[1])).collect()
    by = Counter((r.sequence_id, r.offset) for r in rows)
    assert rows and max(by.values()) == 1 and {r.doc_id for r in rows} <= {r[0] for r in messy()}
    nothing, unlabelled = docs.limit(0), labelled[1].limit(0)
    assert corpus_pipeline.run(spark, written(spark, tmp_path / "empty", nothing, unlabelled)).count() == 0
    assert corpus_pipeline.run(spark, written(spark, tmp_path / "unlabelled", docs, unlabelled)).count() >= 0


def test_pipeline_against_brute_force(spark, tmp_path, labelled):
    import public_tokenizers
    from test_documents import brute_cut
    from tokenizers import Tokenizer

    from leafmill.llm import chunks, neardup

    docs, labels, _ = labelled
    held = [(r.doc_id, r.text) for r in docs.collect()]
    r = random.Random(41)
    plain = [labelled_text(r, False, False) for _ in range(19)]
    more = [(600 + i, f"{t} the a stone") for i, (_, t) in enumerate(held[:40])] + [(700 + i, f"{plain[i]} {plain[18] * 2} {plain[9 + i]}") for i in range(9)]
    rows = held + more
    table = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    path = written(spark, tmp_path / "plain", table, labels)
    stage = dict(corpus_pipeline.STAGES)

    known = {r.doc_id: r for r in labels.collect()}
    for name, model, label, keep in (("toxicity", toxicity.ToxicityModel, "toxic", lambda s: s < 0.3), ("quality classifier", quality.QualityModel, "quality", lambda s: s >= 0.7)):
        there = [(d, t) for d, t in rows if d in known and zlib.crc32(str(d).encode()) % 4 != 2]
        scores = model([(t, known[d][label]) for d, t in sorted(there)]).score([t for _, t in rows])
        table = stage[name](spark, table, path).cache()
        assert sorted(r.doc_id for r in table.collect()) == [d for (d, _), s in zip(rows, scores.tolist(), strict=True) if keep(s)], name
        kept = {r.doc_id for r in table.collect()}
        rows = [r for r in rows if r[0] in kept]

    sets = {d: set(neardup.shingle_hashes(neardup.words_of(t.encode()), 5).tolist()) for d, t in rows}
    label = {d: d for d in sets}
    for _ in range(4):
        for a in sets:
            for b in sets:
                if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    table = stage["SimHash near-dedup"](spark, table, path).cache()
    assert sorted(r.doc_id for r in table.collect()) == sorted(d for d in label if label[d] == d) and len(table.collect()) < len(rows)

    rows = [r for r in rows if label[r[0]] == r[0]]
    want = brute_cut(rows)
    table = stage["substring dedup"](spark, table, path).cache()
    assert sorted((r.doc_id, r.text, r.n_chars) for r in table.collect()) == sorted((d, want[d, t], len(want[d, t])) for d, t in rows)
    assert any(want[d, t] != t for d, t in rows) and chunks.MIN_WORDS == 20

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sizes = {d: len(tokenizer.encode(want[d, t], add_special_tokens=False).ids) + 1 for d, t in rows}
    pieces = stage["best-fit packing"](spark, table, path).collect()
    assert {d: sum(p.length for p in pieces if p.doc_id == d) for d in sizes} == sizes
    fill: Counter = Counter()
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == fill[p.sequence_id]
        fill[p.sequence_id] += p.length
    assert max(fill.values()) <= 1024 and len(fill) <= 1 + -(-sum(sizes.values()) // 1024)


@tables
def test_queries_match_sql(spark):
    import duckdb

    for name, sql in queries.oracle_sql().items():
        con = duckdb.connect()
        con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
        cursor = con.execute(sql)
        columns = [d[0] for d in cursor.description]
        want = Counter(cursor.fetchall())
        assert Counter(tuple(r[c] for c in columns) for r in queries.queries()[name](spark, SF).collect()) == want


def test_every_operator_has_a_query():
    assert [int(n[2:].split("_")[0]) for n in queries.queries()] == list(range(1, 11))
